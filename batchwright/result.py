"""What an operator returns: outcomes by row, the next state, and measures that follow from the outcomes."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from batchwright.errors import DetailError
from batchwright.functions.attempts import attempts
from batchwright.options import Detail, Options, Strategy

SUCCESS, FAILED, SKIPPED, NOT_ATTEMPTED = "Success", "Failed", "Skipped", "NotAttempted"


def measures(outcomes: DataFrame) -> DataFrame:
    """Counts, rate and flags in one aggregation. Skipped rows are neither successes nor failures."""

    def count(condition) -> F.Column:
        return F.coalesce(F.sum(F.when(condition, 1).otherwise(0)), F.lit(0)).cast("long")

    counts = outcomes.agg(
        count(F.col("status") == SUCCESS).alias("success_count"),
        count(F.col("status") == FAILED).alias("failure_count"),
        count(F.col("status") == SKIPPED).alias("skipped_count"),
        count((F.col("status") == SUCCESS) & (F.col("operation") == "Insert")).alias("inserted_count"),
        count((F.col("status") == SUCCESS) & (F.col("operation") == "Update")).alias("updated_count"),
        count(F.col("status") == NOT_ATTEMPTED).alias("not_attempted_count"),
    )
    s, f, cancelled = F.col("success_count"), F.col("failure_count"), F.col("not_attempted_count") > 0
    return counts.withColumns(
        {
            "total_processed": s + f,
            "success_rate": F.when(s + f > 0, s / (s + f)).otherwise(F.lit(0.0)),
            "is_complete_success": (f == 0) & (s > 0) & ~cancelled,
            "is_complete_failure": (s == 0) & (f > 0),
            "is_partial_success": (s > 0) & (f > 0),
            "was_cancelled": cancelled,
        }
    )


@dataclass
class Result:
    """``outcomes``: idx, entity_id, operation, status, reason, message, retried, is_default_key. ``state``: the next
    state of every table that the call changes, by entity. Both are DataFrames.

    ``duration`` (seconds), ``round_trips`` (commits) and ``retries`` (of commits) are known once a call is committed;
    None before."""

    outcomes: DataFrame
    state: dict[str, DataFrame]
    options: Options = field(default_factory=Options)
    extra: dict[str, DataFrame] = field(default_factory=dict)
    duration: float | None = None
    round_trips: int | None = None
    retries: int | None = None

    def _needs(self, level: Detail, what: str) -> None:
        if self.options.detail.value < level.value:
            raise DetailError(f"{what} needs detail {level.name}; this result was made with {self.options.detail.name}")

    def metrics(self) -> DataFrame:
        return measures(self.outcomes)

    def summary(self) -> DataFrame:
        """The metrics with duration_seconds, round_trips and total_retries."""
        return self.metrics().withColumns({"duration_seconds": F.lit(self.duration).cast("double"), "round_trips": F.lit(self.round_trips).cast("long"), "total_retries": F.lit(self.retries).cast("long")})

    def attempts(self) -> DataFrame:
        """Saves that the chosen strategy would have made; needs dense indices from 0."""
        return attempts(self.outcomes, self.options.strategy is Strategy.DIVIDE_AND_CONQUER)

    def successes(self) -> DataFrame:
        self._needs(Detail.MINIMAL, "successes")
        return self.outcomes.where(F.col("status") == SUCCESS).select("idx", "entity_id", "operation", "is_default_key")

    def failures(self) -> DataFrame:
        """Failing rows; their messages only at full detail."""
        self._needs(Detail.MINIMAL, "failures")
        failing = self.outcomes.where(F.col("status") == FAILED)
        return failing.select("idx", "entity_id", "operation", "reason", *(["message"] if self.options.detail is Detail.FULL else []))

    def reasons(self) -> DataFrame:
        return self.outcomes.where(F.col("status") == FAILED).groupBy("reason").agg(F.count(F.lit(1)).alias("failures"))

    def in_order(self) -> DataFrame:
        """All rows that were written, in the order of the batch."""
        self._needs(Detail.MINIMAL, "in_order")
        return self.successes().orderBy("idx")

    def at(self, idx: int) -> DataFrame:
        """What became of one row of the batch."""
        self._needs(Detail.MINIMAL, "at")
        return self.outcomes.where(F.col("idx") == idx)

    def hierarchy(self) -> DataFrame:
        """Edges of the written graphs: root, parent, entity, id and depth."""
        self._needs(Detail.FULL, "hierarchy")
        return self.extra["hierarchy"]

    def statistics(self) -> DataFrame:
        self._needs(Detail.FULL, "statistics")
        return self.extra["statistics"]

"""Contiguous chunks of a batch, and measures of chunks put together."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from batchwright.plans.index import IDX
from batchwright.result import Result


def with_chunk(batch: DataFrame, parts: int, idx: str = IDX) -> DataFrame:
    """Add ``chunk`` (from 0) and ``offset`` (the first index of the chunk). With n rows a chunk has ceil(n / parts)
    of them, the last one what is left; ``idx`` is dense from 0."""
    if parts < 1:
        raise ValueError("at least one part is needed")
    rows = batch.agg(F.greatest(F.ceil(F.count(F.lit(1)) / parts), F.lit(1)).cast("long")).scalar()
    return batch.withColumn("chunk", F.floor(F.col(idx) / rows).cast("long")).withColumn("offset", F.col("chunk") * rows)


def chunk_measures(outcomes: DataFrame, parts: int) -> DataFrame:
    """Of each chunk its rows, successes and failures."""
    return with_chunk(outcomes, parts, "idx").groupBy("chunk", "offset").agg(
        F.count(F.lit(1)).alias("rows"),
        F.sum((F.col("status") == "Success").cast("long")).alias("success_count"),
        F.sum((F.col("status") == "Failed").cast("long")).alias("failure_count"),
    )


def total(numbers: Iterable[float | None]) -> float | None:
    """The sum of the numbers that are known; None if none is."""
    known = [n for n in numbers if n is not None]
    return sum(known) if known else None


def merge(parts: list[tuple[Result, int]]) -> Result:
    """One result of the results of contiguous parts of a batch, each with the index of its first row. Outcomes and
    graphs get the indices of the whole batch; times, commits and retries are added where they are known; statistics
    are added by their labels. All parts have the same detail. The states are those of the tables, not of the parts, so
    they are left to whoever commits."""
    results = [r for r, _ in parts]
    if len({r.options.detail for r in results}) != 1:
        raise ValueError("parts of one batch have one detail")

    def moved(df: DataFrame, column: str, offset: int) -> DataFrame:
        return df.withColumn(column, F.col(column) + F.lit(offset).cast("long"))

    extra = {}
    for name in sorted({n for r in results for n in r.extra}):
        found = [moved(r.extra[name], "root", at) if "root" in r.extra[name].columns else r.extra[name] for r, at in parts if name in r.extra]
        whole = reduce(DataFrame.unionByName, found)
        sums = [c for c, kind in whole.dtypes if kind == "bigint" and c not in ("root", "depth")]
        labels = [c for c in whole.columns if c not in sums]
        extra[name] = whole if "root" in whole.columns else whole.groupBy(*labels).agg(*(F.sum(c).alias(c) for c in sums))
    outcomes = reduce(DataFrame.unionByName, [moved(r.outcomes, "idx", at) for r, at in parts])
    return Result(outcomes, {}, results[0].options, extra, total(r.duration for r in results), total(r.round_trips for r in results), total(r.retries for r in results))

"""How many saves the two isolation strategies would have made."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from batchwright.session import materialize

MAX_LEVELS = 62


def newly_met(position: Column, rows: Column, previous: Column) -> Column:
    """How many segments of more than one row, of ``rows`` rows that are halved again and again, hold ``position`` and
    begin after ``previous`` (null: anywhere)."""
    start = F.struct(F.lit(0).cast("long").alias("lo"), rows.cast("long").alias("n"), F.lit(0).alias("met"))

    def halve(s: Column, _: Column) -> Column:
        half = F.shiftright(s["n"], 1)
        left = position < s["lo"] + half
        return F.when(s["n"] <= 1, s).otherwise(
            F.struct(
                F.when(left, s["lo"]).otherwise(s["lo"] + half).alias("lo"),
                F.when(left, half).otherwise(s["n"] - half).alias("n"),
                (s["met"] + F.when(previous.isNull() | (s["lo"] > previous), 1).otherwise(0)).alias("met"),
            )
        )

    levels = F.sequence(F.lit(0), F.least(F.lit(MAX_LEVELS), F.ceil(F.log2(F.greatest(rows, F.lit(1)).cast("double"))).cast("int") + 1))
    return F.aggregate(levels, start, halve)["met"]


def with_previous(failing: DataFrame) -> DataFrame:
    """``failing`` (idx) with the next lower index in ``previous``: inside buckets of 2**16 places, and from bucket to
    bucket by a table of a row each."""
    spread = failing.withColumn("bucket", F.shiftright("idx", 16))
    last = spread.groupBy("bucket").agg(F.max("idx").alias("last"))
    before = last.select("bucket", F.lag("last").over(Window.orderBy("bucket")).alias("before"))
    inside = spread.withColumn("previous", F.lag("idx").over(Window.partitionBy("bucket").orderBy("idx")))
    return inside.join(before, "bucket").withColumn("previous", F.coalesce("previous", "before")).drop("bucket", "before")


def attempts(outcomes: DataFrame, divide: bool) -> DataFrame:
    """attempts (one row). ``outcomes``: idx (dense from 0), status, retried.

    One by one: a save for each row. Divide and conquer: one for all rows, and two more for every segment of several
    rows that holds a failing one. A row retried as an update is a save more in either case."""
    rows = outcomes.agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(F.col("retried").cast("long")), F.lit(0)).alias("retries"))
    if not divide:
        return rows.select((F.col("rows") + F.col("retries")).cast("long").alias("attempts"))
    outcomes = materialize(outcomes.select("idx", "status", "retried"), "attempts")
    rows = outcomes.agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(F.col("retried").cast("long")), F.lit(0)).alias("retries"))
    total = outcomes.agg(F.count(F.lit(1))).scalar()
    failing = outcomes.where("status = 'Failed' or status = 'Skipped' or retried").select(F.col("idx").cast("long").alias("idx"), total.alias("total"))
    met = with_previous(failing).select(newly_met(F.col("idx"), F.col("total"), F.col("previous")).alias("met"))
    split = met.agg(F.coalesce(F.sum("met"), F.lit(0))).scalar()  # each segment counts where its first failing row is
    return rows.select((F.when(F.col("rows") > 0, 1 + 2 * split).otherwise(0) + F.col("retries")).cast("long").alias("attempts"))

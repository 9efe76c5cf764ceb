"""Order of rows. A DataFrame has none, and first-wins rules need one: the column ``__idx``."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from batchwright.session import materialize

IDX = "__idx"
BUCKET_BITS = 20
#: Where the number of the partition begins in a monotonically_increasing_id.
PARTITION_BITS = 33


def densify(df: DataFrame, column: str, start: int = 0) -> DataFrame:
    """Number the distinct integers of ``column`` densely from ``start``, in their order.

    Values are taken in buckets of 2**20 consecutive ones: rows are ranked inside their bucket, and buckets are added
    up (a table of a row per bucket), so no task sees all rows."""
    spread = df.withColumn("__bucket", F.shiftright(F.col(column).cast("long"), BUCKET_BITS))
    sizes = spread.groupBy("__bucket").agg(F.count(F.lit(1)).alias("__n"))
    before = sizes.select("__bucket", (F.coalesce(F.sum("__n").over(Window.orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).alias("__before"))
    ranked = spread.withColumn("__rank", F.row_number().over(Window.partitionBy("__bucket").orderBy(column)))
    return ranked.join(before, "__bucket").withColumn(column, (F.col("__before") + F.col("__rank") - 1 + start).cast("long")).drop("__bucket", "__before", "__rank")


def numbered(written: DataFrame, column: str) -> DataFrame:
    """``column`` densely from 0, where it holds the ``monotonically_increasing_id`` with which the table was written:
    a partition's rows have consecutive values, so it takes the partitions' sizes only, and no shuffle of the rows."""
    part = F.shiftright(F.col(column), PARTITION_BITS)
    sizes = written.groupBy(part.alias("__part")).agg(F.count(F.lit(1)).alias("__n"))
    before = sizes.select("__part", F.coalesce(F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    joined = written.withColumn("__part", part).join(F.broadcast(before), "__part")
    return joined.withColumn(column, F.col("__before") + F.col(column).bitwiseAND(F.lit((1 << PARTITION_BITS) - 1))).drop("__part", "__before")


def with_index(df: DataFrame, *order: str, dense: bool = True) -> DataFrame:
    """Add ``__idx`` by the order of ``order`` (all columns where none is named). Written once, so that every later
    use sees the same indices; ``dense`` numbers from 0, else only their order counts."""
    indexed = df.sort(*(order or df.columns)).withColumn(IDX, F.monotonically_increasing_id())
    indexed = materialize(indexed, "indexed")
    return numbered(indexed, IDX) if dense else indexed

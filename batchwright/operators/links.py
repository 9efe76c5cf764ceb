"""Many-to-many links between two entities, kept in a link table.

``wanted`` holds a row for each link that a root asks for: ``__root``, the link's own columns. ``left`` and ``right``
are the link's columns that hold the two keys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from batchwright.functions.keys import all_set, is_default, shown
from batchwright.plans.constraints import with_flag

ROOT = "__root"


def created(wanted: DataFrame, stored: DataFrame, left: tuple[str, ...], right: tuple[str, ...]) -> DataFrame:
    """Links that aren't stored yet, once each."""
    pair = [*left, *right]
    return wanted.dropDuplicates(pair).join(stored.select(*pair), pair, "left_anti")


def missing_related(wanted: DataFrame, related: DataFrame, right: tuple[str, ...], key: tuple[str, ...]) -> DataFrame:
    """(root, ids) of roots that link rows which aren't there, with those ids in order; also for composite keys."""
    flagged = with_flag(wanted, related, right, key, "__there")
    return flagged.where(~F.col("__there") & all_set(right)).groupBy(F.col(ROOT).alias("root")).agg(F.array_sort(F.collect_set(shown(right))).alias("ids"))


def insert_if_new(related: DataFrame, batch: DataFrame, key: tuple[str, ...]) -> tuple[DataFrame, DataFrame]:
    """Related rows to insert (their key isn't set or isn't stored), and those that are attached."""
    flagged = with_flag(batch, related, key, key, "__there")
    new = is_default(batch, key) | ~F.col("__there")
    return flagged.where(new).drop("__there"), flagged.where(~new).drop("__there")


def over_cap(wanted: DataFrame, cap: int) -> DataFrame:
    """(root, links) of roots that ask for more than ``cap`` links; none where the cap is 0."""
    counted = wanted.groupBy(F.col(ROOT).alias("root")).agg(F.count(F.lit(1)).alias("links"))
    return counted.where(F.col("links") > cap) if cap > 0 else counted.where(F.lit(False))


def changes(stored: DataFrame, wanted: DataFrame, left: tuple[str, ...], right: tuple[str, ...]) -> DataFrame:
    """The links to add and to remove, with ``change``; of the left keys that ``wanted`` has only."""
    pair = [*left, *right]
    new = wanted.select(*pair).where(all_set(right)).withColumns({"__new": F.lit(True), "__old": F.lit(False)})
    old = stored.select(*pair).where(all_set(left)).withColumns({"__new": F.lit(False), "__old": F.lit(True)})
    differ = new.unionByName(old).groupBy(*pair).agg(F.max("__new").alias("__new"), F.max("__old").alias("__old")).where("__new <> __old")
    owners = wanted.select(*left).distinct().withColumn("__has", F.lit(True))
    return differ.join(owners, [*left], "left").where("__new or __has").select(*pair, F.when(F.col("__new"), "added").otherwise("removed").alias("change"))


def apply_changes(stored: DataFrame, change: DataFrame, left: tuple[str, ...], right: tuple[str, ...], wanted: DataFrame | None = None) -> DataFrame:
    """The link table afterwards. Payload columns of added links are those of ``wanted``, where it has them, else null;
    of a link that is wanted several times those of the least row."""
    pair = [*left, *right]
    kept = stored.join(change.where("change = 'removed'").select(*pair), pair, "left_anti")
    added = change.where("change = 'added'").select(*pair)
    payload = [c for c in stored.columns if wanted is not None and c in wanted.columns and c not in pair]
    if payload:
        first = wanted.groupBy(*pair).agg(F.min(F.struct(*payload)).alias("__payload"))
        added = added.join(first, pair).select(*pair, *(F.col("__payload")[c].alias(c) for c in payload))
    return kept.unionByName(added, allowMissingColumns=True)


def without(stored: DataFrame, roots: DataFrame, left: tuple[str, ...], key: tuple[str, ...]) -> DataFrame:
    """The link table without the links of ``roots``; related rows stay."""
    return stored.join(roots.select(*(F.col(k).alias(c) for k, c in zip(key, left, strict=True))).distinct(), [*left], "left_anti")


def counts(change: DataFrame, navigation: str) -> DataFrame:
    """Links added and removed by navigation."""
    return change.groupBy(F.lit(navigation).alias("navigation")).agg(F.sum((F.col("change") == "added").cast("long")).alias("created"), F.sum((F.col("change") == "removed").cast("long")).alias("removed"))

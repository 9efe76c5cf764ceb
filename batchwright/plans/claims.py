"""First come, first served over several keys at once.

A root claims keys; in order of the roots, one goes ahead if none of its keys is held, by another owner, by a root before
it that went ahead. Roots are cut, in their order, into blocks that fit a task, and a block is gone through in order. All
blocks are taken at once: there, what depends on a key that an earlier block claims too stays open, and goes through the
same again. Where that leaves most open, as in a chain of roots that wait for each other through all blocks, the blocks
are taken one after the other, each told by those before what they hold. So memory doesn't depend on the size or shape of
the claims, and the number of jobs never on the length of a chain.
"""

from __future__ import annotations

from functools import reduce
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from batchwright.session import materialize, ship_package

CLAIMS = "root long, key string, owner string"
FREE, OPEN = -1, -2


def _through(t: pa.Table) -> pa.Table:
    """Of the claims of one block (root, id, owner, before) the roots that lose and those that stay open. ``before``:
    whether an earlier block claims the key too. Without an owner a root claims for itself."""
    root = t.column("root").to_numpy()
    order = np.argsort(root, kind="stable")
    root, names = root[order], t.column("owner").combine_chunks()
    keys, key = np.unique(t.column("id").to_numpy()[order], return_inverse=True)
    if names.null_count == len(names):
        owner = np.unique(root, return_inverse=True)[1]
    else:
        owner = names.dictionary_encode().indices.to_numpy(zero_copy_only=False)[order]
    holder = [FREE] * len(keys)
    before = t.column("before").combine_chunks().to_numpy(zero_copy_only=False)[order].astype(bool)
    for k in np.unique(key[before]).tolist():
        holder[k] = OPEN
    lost, unknown, now, wanted = [], [], None, []

    def decide():
        waits = False
        for k, o in wanted:
            if (h := holder[k]) >= 0 and h != o:
                lost.append(now)
                return
            waits = waits or h == OPEN
        if waits:
            unknown.append(now)
            for k, _ in wanted:
                if holder[k] == FREE:
                    holder[k] = OPEN
        else:
            for k, o in wanted:
                holder[k] = o

    for r, k, o in zip(root.tolist(), key.tolist(), owner.tolist(), strict=True):
        if r != now:
            if wanted:
                decide()
            now, wanted = r, []
        wanted.append((k, o))
    if wanted:
        decide()
    return pa.table({"root": pa.array(lost + unknown, pa.int64()), "open": pa.array([False] * len(lost) + [True] * len(unknown), pa.bool_())})


def _decided(claims: DataFrame) -> DataFrame:
    """(root, open) of the roots that lose or stay open, block by block."""
    return materialize(claims.select("block", "root", "id", "owner", "before").groupBy("block").applyInArrow(lambda t: _through(t), "root long, open boolean"), "decided")


def _losing(claims: DataFrame, held: DataFrame) -> DataFrame:
    """(root) of the claims whose key is held by another owner."""
    other = F.coalesce("owner", F.col("root").cast("string")) != F.col("__holder")
    return claims.join(held, "id").where(other).select("root").distinct()


def _held(claims: DataFrame) -> DataFrame:
    """The keys of ``claims``, of roots that went ahead, which later blocks claim too."""
    return claims.where(F.col("last") > F.col("block")).select("id", F.coalesce("owner", F.col("root").cast("string")).alias("__holder")).distinct()


def _in_blocks(left: DataFrame, blocks: int) -> DataFrame:
    """The claims with their block, whether an earlier one claims their key, and the last one that does."""
    cuts = sorted({int(c) for c in left.stat.approxQuantile("root", [i / blocks for i in range(1, blocks)], 0.2 / blocks)}) if blocks > 1 else []
    block = reduce(lambda a, b: a + b, [(F.col("root") > c).cast("int") for c in cuts], F.lit(0))
    dealt = left.withColumn("block", block)
    if not cuts:
        return dealt.withColumns({"before": F.lit(False), "last": F.lit(0)})
    spans = dealt.groupBy("id").agg(F.min("block").alias("__first"), F.max("block").alias("last"))
    return materialize(dealt.join(spans, "id").select("root", "id", "owner", "block", (F.col("__first") < F.col("block")).alias("before"), "last"), "blocks")


def _one_by_one(claims: DataFrame, blocks: int) -> list[DataFrame]:
    """The roots that lose, taking the blocks one after the other."""
    found: list[DataFrame] = []
    for b in range(blocks):
        part = claims.where(F.col("block") == b)
        if found:
            part = part.join(reduce(DataFrame.unionByName, found), "root", "left_anti")
        lost = _decided(part.withColumn("before", F.lit(False))).select("root")
        if b + 1 < blocks:
            held = materialize(_held(part.join(lost, "root", "left_anti")), "held")
            found.append(materialize(_losing(claims.where(F.col("block") > b), held), "lost"))
        found.append(lost)
    return found


def losers(claims: DataFrame, in_task: int = 8_000_000) -> DataFrame:
    """(root) of the roots that may not go ahead. ``claims``: root, key, owner; null keys claim nothing. Claims of one
    owner don't exclude each other; a root claims a key for one owner. A block has about ``in_task`` claims, but for a
    root with more."""
    owner = F.col("owner").cast("string")
    claims = claims.where("key is not null").select(F.col("root").cast("long").alias("root"), "key", F.when(owner != F.col("root").cast("string"), owner).alias("owner"))
    contested = claims.groupBy("key").agg(F.min("root").alias("a"), F.max("root").alias("b")).where("a <> b")
    keys = materialize(contested.select("key", F.monotonically_increasing_id().alias("id")), "keys")
    left = materialize(claims.join(keys, "key").select("root", "id", "owner"), "claims")
    ship_package(left.sparkSession)
    if not left.where("owner is not null").isEmpty():  # some claim for others: all by name
        left = left.withColumn("owner", F.coalesce("owner", F.col("root").cast("string")))
    found = [left.select("root").where(F.lit(False))]
    rows = left.count()
    while rows:
        blocks = ceil(rows / in_task)
        dealt = _in_blocks(left, blocks)
        done = _decided(dealt)
        found.append(done.where("not open").select("root"))
        if blocks == 1:
            break
        went = dealt.join(done, "root", "left_anti")
        held = materialize(_held(went), "held")
        unknown = dealt.join(done.where("open").select("root"), "root", "left_semi")
        lost = materialize(_losing(unknown, held), "lost")
        found.append(lost)
        left, before = materialize(unknown.join(lost, "root", "left_anti").select("root", "id", "owner"), "claims"), rows
        rows = left.count()
        if rows > max(before // 2, in_task):
            blocks = ceil(rows / in_task)
            found += _one_by_one(_in_blocks(left, blocks), blocks)
            break
    return reduce(DataFrame.unionByName, found)

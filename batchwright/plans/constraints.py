"""Which rows of a batch break which constraint, as columns. No action runs here but where several constraints meet."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from batchwright.functions.keys import all_set, is_default
from batchwright.model import Entity
from batchwright.plans.claims import losers
from batchwright.plans.index import IDX

INVALID, CONFLICT, STORED, DANGLING = "__invalid", "__conflict", "__stored", "__dangling"


def with_validity(batch: DataFrame, entity: Entity) -> DataFrame:
    """Add the message of the first rule that is broken; null where all hold. No part of a key may be null, unless the
    whole key is generated and not set; then the checks."""
    unset = is_default(batch, entity.key) if entity.generated_key else F.lit(False)
    failing = [F.when(F.col(k).isNull() & ~unset, F.lit(f"the key column {k} of {entity.name} is null")) for k in entity.key]
    failing += [F.when(F.coalesce(~F.expr(c.condition), F.lit(False)), F.lit(c.message)) for c in entity.checks]
    return batch.withColumn(INVALID, F.coalesce(*failing, F.lit(None).cast("string")))


def with_flag(batch: DataFrame, other: DataFrame, columns: tuple[str, ...], names: tuple[str, ...], flag: str, null_safe: tuple[str, ...] = ()) -> DataFrame:
    """Add whether ``other`` has a row whose ``names`` equal the batch's ``columns``. Nulls equal nothing, but for the
    columns in ``null_safe``, where they equal each other."""
    keys = other.select(*(F.col(n).alias(f"__k{i}") for i, n in enumerate(names))).distinct().withColumn(flag, F.lit(True))
    on = [F.col(c).eqNullSafe(F.col(f"__k{i}")) if c in null_safe else F.col(c) == F.col(f"__k{i}") for i, c in enumerate(columns)]
    joined = batch.join(keys, reduce(lambda a, b: a & b, on), "left")
    return joined.drop(*(f"__k{i}" for i in range(len(columns)))).withColumn(flag, F.coalesce(flag, F.lit(False)))


def with_dangling(batch: DataFrame, entity: Entity, related: dict[str, DataFrame], keys: dict[str, tuple[str, ...]]) -> DataFrame:
    """Add the name of the first foreign key that names no row; only those whose table is in ``related``."""
    messages = []
    for i, fk in enumerate(entity.foreign_keys):
        if fk.entity in related:
            batch = with_flag(batch, related[fk.entity], fk.columns, keys[fk.entity], f"__fk{i}")
            messages.append(F.when(all_set(fk.columns) & ~F.col(f"__fk{i}"), F.lit(f"no such {fk.entity}")))
    flags = [c for c in batch.columns if c.startswith("__fk")]
    return batch.withColumn(DANGLING, F.coalesce(*messages, F.lit(None).cast("string"))).drop(*flags)


def applies(df: DataFrame, entity: Entity, columns: tuple[str, ...]) -> Column:
    """Whether a unique constraint applies to a row: it has no null, and isn't a generated key that isn't set yet."""
    held = all_set(columns)
    return held & ~is_default(df, columns) if columns == entity.key and entity.generated_key else held


def with_stored(batch: DataFrame, target: DataFrame, entity: Entity) -> DataFrame:
    """Add whether a stored row has the same value of a unique constraint."""
    flags = []
    for i, columns in enumerate(entity.constraints):
        batch = with_flag(batch, target, columns, columns, f"__u{i}")
        flags.append(F.col(f"__u{i}") & applies(batch, entity, columns))
    return batch.withColumn(STORED, reduce(lambda a, b: a | b, flags)).drop(*(f"__u{i}" for i in range(len(flags))))


def claims_of(rows: DataFrame, entity: Entity, owner: Column, root: str = IDX, with_key: bool = True) -> DataFrame:
    """root, key (entity, constraint and values, as text), owner: the unique values that the rows claim; those of the
    entity's own key only ``with_key``."""
    keys = [
        F.when(applies(rows, entity, c), F.concat(F.lit(f"{entity.name} {i} "), F.to_json(F.struct(*(F.col(x) for x in c)))))
        for i, c in enumerate(entity.constraints)
        if i or with_key
    ]
    held = F.array_compact(F.array(*keys)) if keys else F.array().cast("array<string>")
    return rows.select(F.col(root).alias("root"), owner.alias("owner"), F.explode(held).alias("key"))


def first_of(rows: DataFrame, entity: Entity, order: str = IDX) -> DataFrame:
    """Of the candidate ``rows`` the ``order`` values of those that are inserted: greedy in order, a row taking the
    keys it has and an earlier taker excluding later ones.

    One constraint: the least index of each key, by partial aggregation (no window, so no hot key gathers). Several:
    ``claims.losers``."""
    constraints = entity.constraints
    if len(constraints) == 1:
        held = applies(rows, entity, constraints[0])
        taken = rows.where(held).groupBy(*constraints[0]).agg(F.min(order).alias(order)).select(order)
        return taken.unionByName(rows.where(~held).select(order))
    lost = losers(claims_of(rows, entity, F.col(order).cast("string"), order))
    return rows.select(order).join(lost.withColumnRenamed("root", order), order, "left_anti")

"""Checks that abort a whole call before anything is planned."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from batchwright.errors import BatchError
from batchwright.functions.keys import is_default
from batchwright.model import Entity


def guard_navigations(batch: DataFrame, entity: Entity, operation: str) -> None:
    """Flat operators write single rows: raise if a column named like a navigation holds children or a reference.

    One action for all such columns, none where the batch has no such column."""
    filled = []
    for n in entity.navigations:
        if n.name in batch.columns:
            nested = isinstance(batch.schema[n.name].dataType, (T.ArrayType, T.MapType))
            filled.append((n.name, F.coalesce(F.size(n.name) > 0, F.lit(False)) if nested else F.col(n.name).isNotNull()))
    if filled:
        found = batch.agg(*(F.bool_or(c).alias(name) for name, c in filled)).first().asDict()
        if names := sorted(name for name, there in found.items() if there):
            raise BatchError(f"{operation} of single {entity.name} rows, but these navigations are filled: {', '.join(names)}; use the graph operator")


def guard_references(rows: DataFrame, entity: Entity) -> None:
    """Raise if a row to delete refers to a row whose key isn't set."""
    unset = [is_default(rows, fk.columns) & reduce(lambda a, b: a & b, (F.col(c).isNotNull() for c in fk.columns)) for fk in entity.foreign_keys if set(fk.columns) <= set(rows.columns)]
    if unset and not rows.where(reduce(lambda a, b: a | b, unset)).isEmpty():
        raise BatchError(f"{entity.name} rows refer to rows without a key")

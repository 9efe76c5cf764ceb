"""Keys: which values count as not set, and how a key is shown."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

EMPTY_UUID = "00000000-0000-0000-0000-000000000000"


def is_default(df: DataFrame, columns: tuple[str, ...]) -> Column:
    """Whether a key is not set: every column is null, 0 for integers, or empty for strings (or the empty uuid).

    Of other types only null counts."""

    def one(name: str) -> Column:
        kind, c = df.schema[name].dataType, F.col(name)
        if isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
            return F.coalesce(c == 0, F.lit(True))
        if isinstance(kind, T.StringType):
            return F.coalesce(c.isin("", EMPTY_UUID), F.lit(True))
        return c.isNull()

    return reduce(lambda a, b: a & b, map(one, columns))


def any_null(columns: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, (F.col(c).isNull() for c in columns))


def all_set(columns: tuple[str, ...]) -> Column:
    return ~any_null(columns)


def entity_id(columns: tuple[str, ...]) -> Column:
    """The key as a struct of its columns."""
    return F.struct(*columns)


def shown(columns: tuple[str, ...]) -> Column:
    """The key as text: ``5``, or ``(5, 2)`` of several columns; nulls as ``null``."""
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("null")) for c in columns]
    return parts[0] if len(parts) == 1 else F.concat(F.lit("("), F.concat_ws(", ", *parts), F.lit(")"))

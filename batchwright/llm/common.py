"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import ctypes
import re
from collections.abc import Callable
from contextlib import suppress

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from batchwright.session import materialize, ship_package

#: The white space of words and of normalised texts: [\x20\x09-\x0D].
SPACE = "\t\n\x0b\x0c\r "
TO_SPACE = {ord(c): " " for c in SPACE}
#: A row's number is the number of its file and, in so many bits, its place there.
ROW_BITS = 40
#: The beginning of a path without a host, which Spark writes with one or three slashes.
NO_HOST = re.compile(r"^([A-Za-z0-9+.-]+):///")
#: Spark's settings of the bytes of an Arrow batch and the rows of a batch that a Parquet reader holds: its defaults, and
#: what is set instead of them.
BOUNDED = {"spark.sql.execution.arrow.maxBytesPerBatch": ("67108864b", "4m"), "spark.sql.parquet.columnarReaderBatchSize": ("4096", "512")}
#: Tables of more rows than this are never broadcast.
BROADCAST_ROWS = 250_000


def words_of(text: str) -> list[str]:
    """The runs of characters outside of [\\x20\\x09-\\x0D]."""
    return [w for w in text.translate(TO_SPACE).split(" ") if w]


def text_or_empty(column: str = "text") -> Column:
    """The column as a string, null as the empty one."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


#: What a Python worker keeps between tasks, by operator: functions that let go of it.
_kept: dict[str, Callable[[], None]] = {}


def keeps(operator: str, forget: Callable[[], None]) -> None:
    """Say how to let go of what tasks of ``operator`` keep for the next ones."""
    _kept[operator] = forget


def forget_others(operator: str | None = None) -> None:
    """Let go of what other operators keep, and of memory that the allocators hold but nothing uses."""
    for name, forget in _kept.items():
        if name != operator:
            forget()
    pa.default_memory_pool().release_unused()
    with suppress(OSError, AttributeError):  # glibc only
        ctypes.CDLL(None).malloc_trim(0)


def map_arrow(df: DataFrame, function, schema: str, operator: str | None = None, **options) -> DataFrame:
    """mapInArrow with the package sent along. A worker that has served another operator forgets what that one keeps
    (``keeps``). Batches are bounded in bytes, unless the session says how: at Spark's
    default a task holds batches of long texts several times over."""
    ship_package(df.sparkSession)
    conf = df.sparkSession.conf
    for name, (sparks, ours) in BOUNDED.items():
        if conf.get(name, None) == sparks:
            conf.set(name, ours)

    def run(batches):
        forget_others(operator)
        yield from function(batches)
        forget_others(operator)

    return df.mapInArrow(run, schema, **options)


def _place(docs: DataFrame) -> Column:
    return docs.metadataColumn("_metadata")["row_index"]


def stable(docs: DataFrame) -> DataFrame:
    """``docs``, if it reads Parquet files and at most filters them, so that a row can be told by its file and its place
    there in every reading; else what it gives now, written as a table."""
    plan = docs._jdf.queryExecution().optimizedPlan().toString()
    nodes = {line.lstrip(" :+-").split(" ")[0] for line in plan.splitlines() if line.strip()}
    if nodes <= {"Relation", "Filter"}:
        try:
            docs.select(_place(docs))
            return docs
        except AnalysisException:
            pass
    return materialize(docs, "stable")


def fresh(docs: DataFrame, name: str) -> str:
    """``name``, with underscores before it as long as ``docs`` has such a column."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def with_row(docs: DataFrame, name: str = "row") -> DataFrame:
    """``docs`` (as ``stable`` gives it) with a number for each row: the same in every reading, however the files are
    split. The list of files, which the driver holds to plan the reading, is joined by broadcast."""
    files = sorted(docs.inputFiles())
    place = _place(docs)
    if len(files) <= 1:
        return docs.withColumn(name, place)
    path, number = fresh(docs, "__path"), fresh(docs, "__file")
    numbers = docs.sparkSession.createDataFrame([(NO_HOST.sub(r"\1:/", f), i << ROW_BITS) for i, f in enumerate(files)], f"`{path}` string, `{number}` long")
    read_from = F.regexp_replace(docs.metadataColumn("_metadata")["file_path"], NO_HOST.pattern, "$1:/")
    numbered = docs.withColumns({path: read_from, name: place}).join(F.broadcast(numbers), path, "left")
    known = F.coalesce(F.col(number), F.raise_error(F.concat(F.lit("no number for the file "), F.col(path))).cast("long"))
    return numbered.withColumn(name, F.col(name) + known).select(*(F.col(f"`{c}`") for c in docs.columns if c != name), F.col(name))


def join_rows(docs: DataFrame, rows: DataFrame, row: str, how: str) -> DataFrame:
    """``docs`` joined with ``rows`` (a written table, a row for each ``row`` at most). Up to a number of rows that is
    counted here they are broadcast, so that texts stay where they are read; beyond it both sides are shuffled."""
    small = rows.count() <= BROADCAST_ROWS
    return docs.join(F.broadcast(rows) if small else rows.hint("shuffle_merge"), row, how)


def table(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def batch(names: list[str], *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(list(columns), names=names)

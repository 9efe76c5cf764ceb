"""Exact duplicates by content-defined chunk recipes.

A text, without its white space, is cut where a rolling hash of its last bytes has certain bits zero, so equal
stretches give equal chunks wherever they lie. A chunk is known by a digest. Digests are verified: the distinct
pairs (digest, bytes) are found, with partial aggregation before the shuffle, and a digest with two contents gives
each an ordinal of its own, so an identifier stands for one content. Documents are then equal when their ordered
lists of identifiers are; only these lists move, not the texts.

Defined cases: a null text counts as empty, and empty texts are equal; a null doc_id comes after every other one
in ties; of repeated rows one stays; an empty table gives none; other columns are ignored. The group of a text
that a third of the rows share is counted with partial aggregation, and the join back to the rows is one that
Spark's adaptive execution splits. ``docs`` that isn't a plain reading of Parquet files is written as a table first, so
that a row can be told by its place.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from batchwright.llm.common import SPACE, fresh, join_rows, map_arrow, stable, text_or_empty, with_row
from batchwright.session import materialize

DELETE = SPACE.encode()
#: A number for each byte value, from a fixed rule.
GEAR = np.array([int.from_bytes(hashlib.blake2b(bytes([i]), digest_size=4).digest(), "little") for i in range(256)], np.uint32)
WINDOW = 32


def rolling(data: np.ndarray) -> np.ndarray:
    """At each byte the sum of GEAR over the last 32 bytes, each shifted by its distance; by doubling."""
    h = GEAR[data]
    for k in (1, 2, 4, 8, 16):
        out = h.copy()
        out[k:] += h[:-k] << np.uint32(k)
        h = out
    return h


def cuts(data: bytes, mean: int, least: int, most: int) -> list[int]:
    """Ends of the chunks of ``data``. A cut depends on the 32 bytes before it and the last cut only."""
    n = len(data)
    if n <= least:
        return [n]
    shift = np.uint32(32 - max(1, mean.bit_length() - 1))
    found = (np.flatnonzero(rolling(np.frombuffer(data, np.uint8)) >> shift == 0) + 1).tolist()
    out, last = [], 0
    for at in found:
        while at - last > most:
            last += most
            out.append(last)
        if at - last >= least and at < n:
            out.append(at)
            last = at
    while n - last > most:
        last += most
        out.append(last)
    return [*out, n]


def recipes(docs: DataFrame, mean: int = 4096, key_bytes: int = 16, with_chunks: bool = False) -> DataFrame:
    """doc_id, row (its number), n_chars, text_sha256, keys (digests of the chunks in order), chunks (their bytes)."""
    least, most = max(WINDOW, mean // 4), mean * 8

    def run(batches):
        for b in (whole.slice(at, 256) for whole in batches for at in range(0, whole.num_rows, 256)):  # few texts at a time
            sha, keys, chunks = [], [], []
            for text in b.column(2).cast(pa.binary()).to_pylist():
                data = text.translate(None, DELETE)
                ends = cuts(data, mean, least, most)
                parts = [data[a:z] for a, z in zip([0, *ends], ends, strict=False)]
                sha.append(hashlib.sha256(data).hexdigest())
                keys.append([hashlib.blake2b(p, digest_size=key_bytes).digest() for p in parts])
                chunks.append(parts if with_chunks else None)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), b.column(3), pa.array(sha, pa.string()), pa.array(keys, pa.list_(pa.binary())), pa.array(chunks, pa.list_(pa.binary()))],
                names=["doc_id", "row", "n_chars", "text_sha256", "keys", "chunks"],
            )

    row = fresh(docs, "row")
    rows = with_row(docs, row).select(F.col("doc_id").cast("long").alias("doc_id"), F.col(row).alias("row"), text_or_empty().alias("text"))
    return map_arrow(rows.withColumn("n_chars", F.char_length("text").cast("long")), run, "doc_id long, row long, n_chars long, text_sha256 string, keys array<binary>, chunks array<binary>")


def chunks_of(docs: DataFrame, mean: int, key_bytes: int) -> DataFrame:
    """key, chunk of every chunk of every document."""
    rows = recipes(docs, mean, key_bytes, True).select(F.explode(F.arrays_zip("keys", "chunks")).alias("c"))
    return rows.select(F.col("c.keys").alias("key"), F.col("c.chunks").alias("chunk"))


def ambiguous_keys(docs: DataFrame, mean: int = 4096, key_bytes: int = 16) -> DataFrame:
    """Digests that stand for more than one content. Reads and compares the bytes of all chunks, which are shuffled
    once, without those that repeat in a task."""
    return chunks_of(docs, mean, key_bytes).distinct().groupBy("key").agg(F.count(F.lit(1)).alias("contents")).where("contents > 1").select("key")


def ordinals(docs: DataFrame, keys: DataFrame, mean: int = 4096, key_bytes: int = 16) -> DataFrame:
    """key, chunk, ordinal of every content of these digests."""
    found = chunks_of(docs, mean, key_bytes).join(keys, "key", "left_semi").distinct()
    return found.withColumn("ordinal", F.row_number().over(Window.partitionBy("key").orderBy("chunk")))


def verified_recipes(docs: DataFrame, mean: int = 4096, key_bytes: int = 16) -> DataFrame:
    """doc_id, row, n_chars, text_sha256, recipe: the ordered list of verified identifiers of the chunks."""
    keys = materialize(ambiguous_keys(docs, mean, key_bytes), "ambiguous-keys")
    if keys.isEmpty():
        return recipes(docs, mean, key_bytes).select("doc_id", "row", "n_chars", "text_sha256", F.col("keys").alias("recipe"))
    doubtful = materialize(ordinals(docs, keys, mean, key_bytes), "ordinals")
    rows = recipes(docs, mean, key_bytes, True)
    parts = rows.select("row", F.posexplode(F.arrays_zip("keys", "chunks")).alias("at", "c")).select("row", "at", F.col("c.keys").alias("key"), F.col("c.chunks").alias("chunk"))
    named = parts.join(doubtful, ["key", "chunk"], "left").select("row", F.struct("at", F.concat("key", F.encode(F.lpad(F.coalesce("ordinal", F.lit(0)).cast("string"), 10, "0"), "utf-8")).alias("id")).alias("part"))
    lists = named.groupBy("row").agg(F.transform(F.array_sort(F.collect_list("part")), lambda p: p["id"]).alias("recipe"))
    return rows.select("doc_id", "row", "n_chars", "text_sha256").join(lists, "row")


def exact_duplicates(docs: DataFrame, mean: int = 4096, key_bytes: int = 16) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256, row: of equal texts the row with the most code points stays,
    then that with the smallest doc_id. ``row`` tells rows with the same doc_id apart."""
    rows = verified_recipes(stable(docs), mean, key_bytes)
    # Greatest first: more code points, then a doc_id that isn't null, then the smaller doc_id, then the earlier row.
    rank = F.struct(F.col("n_chars"), F.col("doc_id").isNotNull().alias("named"), F.bitwise_not("doc_id").alias("low_id"), F.bitwise_not("row").alias("low_row"))
    # As a table, so that the join has an exchange of its own, whose large partitions can be split.
    groups = materialize(rows.groupBy("recipe").agg(F.max(rank).alias("best"), F.count(F.lit(1)).alias("group_size")), "exact-groups")
    return rows.join(groups, "recipe").select(
        "doc_id", F.bitwise_not(F.col("best.low_id")).alias("keep_id"), "group_size", (F.col("row") == F.bitwise_not(F.col("best.low_row"))).alias("kept"), "text_sha256", "row"
    )


def keep_first_copies(docs: DataFrame, mean: int = 4096, key_bytes: int = 16) -> DataFrame:
    """The rows of ``docs`` that stay, with their columns."""
    docs = stable(docs)
    row = fresh(docs, "__row")
    dropped = exact_duplicates(docs, mean, key_bytes).where("not kept").select(F.col("row").alias(row))
    return join_rows(with_row(docs, row), materialize(dropped, "exact-dropped"), row, "left_anti").drop(row)

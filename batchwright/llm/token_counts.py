"""Token counts of documents for a SentencePiece BPE model: every distinct pre-token is counted once.

1. Documents are taken in blocks of bounded bytes. A block gives its distinct pre-tokens, dealt into buckets by
   hash, and one row with the frequencies of its documents (numbers of pre-tokens and how often, compressed).
2. Buckets are dealt over the cluster by number. All occurrences of a pre-token, from every block, meet in one
   bucket; there its pieces are counted once, and the counts go back to the blocks in the same order.
3. Each block joins the counts to its frequencies and sums per document. Ids are never made.

A pre-token is a run of spaces (written ``▁`` by the model) and the characters up to the next one. No piece of the
vocabulary may hold a ``▁`` after another character; this is checked when the model is loaded. A pre-token is at
most once in a block, so none is hot: a bucket gets the same share of every block.

Defined cases: a null or empty text has 0 bytes and 0 tokens; a null doc_id stays null; repeated rows give repeated
results; an empty table gives none; other columns are ignored. ``docs`` that isn't a plain
reading of Parquet files is written as a table first, so that every reading has the same rows.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from batchwright.llm.common import map_arrow, stable, text_or_empty

FREQUENCIES = -1
#: A task forgets its pre-tokens beyond so many.
KNOWN = 1_000_000
ROWS = "block long, bucket int, dealt int, payload binary, doc_ids array<long>, n_bytes array<long>"
EMPTY_DOCS = [pa.array([], pa.int64())]


def pretokens(text: str) -> list[str]:
    """The pre-tokens of a text, each without its first space."""
    if not text:
        return []
    parts = text.split(" ")
    if all(parts) and "▁" not in text:
        return parts
    out, open_ = [], False
    for p in parts:
        if open_:
            out[-1] = f"{out[-1]} {p}"
        else:
            out.append(p)
        open_ = not p or p.endswith("▁")
    return out


class PieceCounter:
    """Pieces of a pre-token, as the library counts them in any text."""

    def __init__(self, model: str):
        from sentencepiece import SentencePieceProcessor

        self.model = SentencePieceProcessor(model_file=model)
        pieces = map(self.model.id_to_piece, range(self.model.get_piece_size()))
        if any("▁" in p.lstrip("▁") for p in pieces) or self.model.encode(" a", out_type=str)[0] != "▁":
            raise ValueError("this vocabulary can't be counted by pre-tokens that begin at spaces")

    def counts(self, tokens: list[str]) -> list[int]:
        return [len(ids) if t else 1 for t, ids in zip(tokens, self.model.encode(tokens, num_threads=1), strict=True)]


_counters: dict[str, PieceCounter] = {}


def _counter(model: str) -> PieceCounter:
    if model not in _counters:
        _counters[model] = PieceCounter(model)
    return _counters[model]


class _Numbers(dict):
    """Numbers keys as they are first seen."""

    def __missing__(self, key):
        self[key] = n = len(self)
        return n


def _pack(*arrays: np.ndarray) -> bytes:
    """32-bit arrays, each by its bytes' significance, compressed."""
    raw = b"".join(np.ascontiguousarray(a.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes() for a in arrays)
    return np.array([len(a) for a in arrays], "<u4").tobytes() + zstandard.ZstdCompressor(level=1).compress(raw)


def _unpack(data: bytes, n: int) -> list[np.ndarray]:
    sizes = np.frombuffer(data[: 4 * n], "<u4").tolist()
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data[4 * n :]), np.uint8) if sum(sizes) else np.zeros(0, np.uint8)
    out, at = [], 0
    for s in sizes:
        out.append(np.ascontiguousarray(raw[at : at + 4 * s].reshape(4, s).T).view("<u4").reshape(-1).astype(np.int64))
        at += 4 * s
    return out


def _pack_words(words: list[str]) -> bytes:
    raw = [w.encode() for w in words]
    lengths = np.array([len(r) for r in raw], "<u4")
    return len(raw).to_bytes(4, "little") + zstandard.ZstdCompressor(level=1).compress(lengths.tobytes() + b"".join(raw))


def _unpack_words(data: bytes) -> list[str]:
    n = int.from_bytes(data[:4], "little")
    raw = zstandard.ZstdDecompressor().decompress(data[4:])
    ends = 4 * n + np.cumsum(np.frombuffer(raw[: 4 * n], "<u4").astype(np.int64))
    starts = np.concatenate([[4 * n], ends[:-1]])
    return [raw[a:b].decode() for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]


def _block_rows(block: int, doc_ids: pa.Array, texts: list[str], buckets: int):
    numbers, per_doc = _Numbers(), []
    for t in texts:
        c = Counter(pretokens(t))
        per_doc.append((np.fromiter(map(numbers.__getitem__, c), np.int64, len(c)), np.fromiter(c.values(), np.int64, len(c))))
    words = list(numbers)
    bucket = np.fromiter((xxhash.xxh3_64_intdigest(w.encode()) % buckets for w in words), np.int64, len(words))
    order = np.argsort(bucket, kind="stable")
    place = np.empty_like(order)
    place[order] = np.arange(len(order))
    deltas, counts = [], []
    for numbered, freq in per_doc:
        at = place[numbered]
        by = np.argsort(at)
        deltas.append(np.diff(at[by], prepend=0))
        counts.append(freq[by])
    sizes = np.array([len(d) for d in deltas], np.int64)
    payload = _pack(sizes, np.concatenate([*deltas, np.zeros(0, np.int64)]), np.concatenate([*counts, np.zeros(0, np.int64)]))
    yield block, FREQUENCIES, block % buckets, payload, doc_ids, pa.array([len(t.encode()) for t in texts], pa.int64())
    edges = np.searchsorted(bucket[order], np.arange(buckets + 1))
    for k in range(buckets):
        if edges[k] < edges[k + 1]:
            yield block, k, k, _pack_words([words[i] for i in order[edges[k] : edges[k + 1]].tolist()]), *EMPTY_DOCS * 2


def _as_batch(rows: list[tuple]) -> pa.RecordBatch:
    block, bucket, dealt, payload, ids, sizes = zip(*rows, strict=True)

    def lists(arrays):
        return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, arrays)]), pa.int32()), pa.concat_arrays(arrays))

    return pa.RecordBatch.from_arrays([pa.array(block, pa.int64()), pa.array(bucket, pa.int32()), pa.array(dealt, pa.int32()), pa.array(payload, pa.binary()), lists(ids), lists(sizes)], names=["block", "bucket", "dealt", "payload", "doc_ids", "n_bytes"])


def _buckets(docs: DataFrame, file_bytes: int = 1 << 26, most: int = 20_000) -> int:
    read = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(most, -(-read // file_bytes)))


def count_tokens(docs: DataFrame, model: str, limit: int = 4096, block_chars: int = 16_000_000, buckets: int | None = None) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit. There are as many ``buckets`` as the session's shuffle partitions, and more
    for large tables: one for 64 MB of files, up to 20,000. A longer text than ``block_chars`` is a block of its own."""
    docs = stable(docs)
    buckets = buckets or _buckets(docs)

    def blocks(batches):
        task, n, ids, texts, size = TaskContext.get().partitionId() << 32, 0, [], [], 0
        for b in batches:
            for i, t in enumerate(b.column(1).to_pylist()):
                if texts and size + len(t) > block_chars:
                    yield _as_batch([*_block_rows(task + n, pa.concat_arrays(ids), texts, buckets)])
                    n, ids, texts, size = n + 1, [], [], 0
                ids.append(b.column(0).slice(i, 1))
                texts.append(t)
                size += len(t)
        if texts:
            yield _as_batch([*_block_rows(task + n, pa.concat_arrays(ids), texts, buckets)])

    def counted(batches):
        counter, known = _counter(model), {}
        for b in batches:
            payload = []
            for k, data in zip(b.column(1).to_pylist(), b.column(3).to_pylist(), strict=True):
                if k != FREQUENCIES:
                    words = _unpack_words(data)
                    if len(known) > KNOWN:
                        known.clear()
                    if new := [w for w in words if w not in known]:
                        known.update(zip(new, counter.counts(new), strict=True))
                    data = _pack(np.fromiter(map(known.__getitem__, words), np.int64, len(words)))
                payload.append(data)
            yield b.set_column(3, "payload", pa.array(payload, pa.binary()))

    def summed(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("bucket")
        payload = rows.column("payload").to_pylist()
        pieces = np.concatenate([*(_unpack(p, 1)[0] for p in payload[1:]), np.zeros(0, np.int64)])
        sizes, deltas, counts = _unpack(payload[0], 3)
        owner = np.repeat(np.arange(len(sizes)), sizes)
        ends = np.cumsum(sizes)
        run = np.cumsum(deltas)
        before = np.concatenate([[0], run])[ends - sizes]
        tokens = np.bincount(owner, weights=pieces[run - before[owner]] * counts, minlength=len(sizes)).astype(np.int64)
        doc_ids, n_bytes = (rows.column(c).chunk(0)[0].values for c in ("doc_ids", "n_bytes"))
        return pa.table({"doc_id": doc_ids, "n_bytes": n_bytes, "n_tokens": tokens, "over_limit": tokens > limit})

    rows = map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")), blocks, ROWS)
    # By the bucket's number itself: a hash of it would put several buckets into one task and none into others.
    back = map_arrow(rows.repartitionById(buckets, F.col("dealt")), counted, ROWS)
    return back.groupBy("block").applyInArrow(summed, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")

"""Packing of documents into training sequences: first-fit decreasing with a tournament tree of bin capacities.

Each document becomes its token ids and one separator id. It is cut into full pieces of ``size`` ids, each a
sequence of its own, and one shorter rest. The rests are dealt to groups at random, and in every group they are
packed by first-fit decreasing; a tournament tree over the bins' free capacities finds the first bin that fits
in logarithmic time. Only lengths and checksums are shuffled, never texts or ids (unless ``with_ids``).

Defined cases: a null or empty text is the separator alone; a null doc_id stays null; repeated rows are packed
once each; an empty table gives no rows; columns other than the two named ones are ignored. Rows get their
group from a hash of the task and the row's place in it, so a doc_id that a third of the rows share does not
gather in one group. ``docs`` that isn't a plain
reading of Parquet files is written as a table first, so that every reading has the same rows.
"""

from __future__ import annotations

import json
import os
import zlib
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from batchwright.llm.common import map_arrow, stable, text_or_empty
from batchwright.llm.words import slices

#: Fixed value: the pattern of byte-level pre-tokens.
BYTE_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
PIECES = "grp long, doc_id long, start long, length long, ids_crc32 long, doc_tokens long, ids binary"
PACKED = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, sequence_tokens long, padded_to long, ids binary"


class CapacityTree:
    """A tournament tree: every inner node holds the larger capacity of its two children."""

    def __init__(self, bins: int, capacity: int):
        self.leaves = 1 << max(0, bins - 1).bit_length()
        self.free = [capacity] * (2 * self.leaves)

    def first_fit(self, need: int) -> int:
        """The first bin with ``need`` free; there must be one."""
        free, i = self.free, 1
        while i < self.leaves:
            i *= 2
            if free[i] < need:
                i += 1
        return i - self.leaves

    def take(self, at: int, need: int) -> int:
        """Use ``need`` of bin ``at``; what it had used before is the offset there."""
        free, i = self.free, at + self.leaves
        free[i] -= need
        left = free[i]
        while i > 1:
            i //= 2
            now = max(free[2 * i], free[2 * i + 1])
            if free[i] == now:
                break
            free[i] = now
        return left


def first_fit_decreasing(lengths, capacity: int) -> tuple[np.ndarray, np.ndarray, int]:
    """For each length its bin and its offset there, and the number of bins. Ties keep their order."""
    n = len(lengths)
    bins, offsets = np.zeros(n, np.int64), np.zeros(n, np.int64)
    tree, used = CapacityTree(max(1, n), capacity), 0
    for i in np.argsort(-np.asarray(lengths, np.int64), kind="stable").tolist():
        need = int(lengths[i])
        at = tree.first_fit(need)
        offsets[i] = capacity - need - tree.take(at, need)
        bins[i] = at
        used = max(used, at + 1)
    return bins, offsets, used


_encoders: dict[str, Encoder] = {}


def _encoder(tokenizer: str) -> Encoder:
    if tokenizer not in _encoders:
        _encoders[tokenizer] = Encoder(tokenizer)
    return _encoders[tokenizer]


def byte_letters() -> dict[str, int]:
    """The bytes by the letters that byte-level vocabularies write them as: printable ones as themselves, the others in
    order from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(others)}


class Encoder:
    """Ids as the tokenizers library gives them for the vocabulary file at ``path``, special strings in texts included.

    A plain byte-level vocabulary whose ids are in the order of its merges is loaded into the merge loop of tiktoken, which
    gives the same ids in a third of the time; other vocabularies, and texts that its pattern can't take (white space
    without end), go through the library itself."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            self.fast = self._loop(json.load(f))

    @staticmethod
    def _loop(file: dict):
        import tiktoken

        model, split, added = file["model"], file.get("pre_tokenizer") or {}, file.get("added_tokens") or []
        wanted = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}
        odd = ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "fuse_unk", "byte_fallback", "ignore_merges")
        if model["type"] != "BPE" or any(model.get(k) for k in odd) or file.get("normalizer") or file.get("post_processor") or any(split.get(k) != v for k, v in wanted.items()):
            return None
        if any(t.get(k) for t in added for k in ("single_word", "lstrip", "rstrip")) or not all(t["special"] for t in added):
            return None
        letters, vocab = byte_letters(), model["vocab"]
        special = {t["content"]: t["id"] for t in added}
        if any(c not in letters for t in vocab if t not in special for c in t):
            return None
        ranks = {bytes(letters[c] for c in t): i for t, i in vocab.items() if t not in special}
        made = [vocab.get("".join(m if isinstance(m, list) else m.split(" "))) for m in model["merges"]]
        if len(ranks) != 256 + len(made) or made != list(range(256, 256 + len(made))):
            return None
        return tiktoken.Encoding(name="byte-level", pat_str=BYTE_LEVEL, mergeable_ranks=ranks, special_tokens=special)

    def ids(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        out, left = [b""] * len(texts), range(len(texts))
        if self.fast:
            left = []
            for i, t in enumerate(texts):
                try:
                    out[i] = self.fast.encode_to_numpy(t, allowed_special="all").astype("<u4", copy=False).tobytes()
                except ValueError:
                    left.append(i)
        for i, x in zip(left, self.model.encode_batch_fast([texts[i] for i in left], add_special_tokens=False), strict=True):
            out[i] = np.array(x.ids, "<u4").tobytes()
        return out


def _mix(seed: int, task: int, rows: np.ndarray) -> np.ndarray:
    """A random-looking 64-bit number for each row of a task (the finalizer of splitmix64)."""
    mask = (1 << 64) - 1
    x = rows.astype(np.uint64) + np.uint64((seed * 0x9E3779B97F4A7C15 + task * 0xD1B54A32D192ED03) & mask)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def pieces(docs: DataFrame, tokenizer: str, size: int = 1024, separator: int = 0, groups: int = 1, seed: int = 17, with_ids: bool = False) -> DataFrame:
    """A row for each piece of each document: full ones have no group yet (-1 - group), rests have theirs."""
    end = int(separator).to_bytes(4, "little")

    def cut(batches):
        encoder, row, task = _encoder(tokenizer), 0, TaskContext.get().partitionId()
        for b in batches:
            ids, texts = b.column(0), b.column(1).to_pylist()
            for lo, hi in slices(texts, 1_000_000):
                group = (_mix(seed, task, np.arange(row, row + hi - lo)) % np.uint64(groups)).astype(np.int64)
                row += hi - lo
                at, start, length, crc, total, raw = [], [], [], [], [], []
                for i, data in enumerate(encoder.ids(texts[lo:hi])):
                    data += end
                    n = len(data) // 4
                    for s in range(0, n, size):
                        piece = data[4 * s : 4 * (s + size)]
                        at.append(i)
                        start.append(s)
                        length.append(len(piece) // 4)
                        crc.append(zlib.crc32(piece))
                        total.append(n)
                        raw.append(piece if with_ids else None)
                where = np.array(at, np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(group[where]), ids.slice(lo, hi - lo).take(pa.array(where)), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64()), pa.array(total, pa.int64()), pa.array(raw, pa.binary())],
                    names=["grp", "doc_id", "start", "length", "ids_crc32", "doc_tokens", "ids"],
                )

    return map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")), cut, PIECES)


def pack_documents(docs: DataFrame, tokenizer: str, size: int = 1024, separator: int = 0, docs_per_group: int = 4096, seed: int = 17, with_ids: bool = False) -> DataFrame:
    """The pieces of all documents with the sequence and offset where each lies.

    ``sequence_id`` is unique over all groups; ``padded_to`` is ``size``, or the sequence's own number of tokens
    where that is a power of two. Uses one count of ``docs`` to choose the number of groups.
    """
    docs = stable(docs)
    groups = max(1, ceil(docs.count() / docs_per_group))

    def pack(table: pa.Table) -> pa.Table:
        grp = table.column("grp")[0].as_py()
        order = pa.compute.sort_indices(table, sort_keys=[("doc_id", "ascending"), ("start", "ascending"), ("ids_crc32", "ascending")])
        table = table.take(order)
        length = table.column("length").to_numpy()
        full = length == size
        bins, offsets = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
        bins[~full], offsets[~full], used = first_fit_decreasing(length[~full], size)
        bins[full] = used + np.arange(full.sum())
        filled = np.bincount(bins, weights=length).astype(np.int64)[bins]
        padded = np.where(filled & (filled - 1) == 0, filled, size)
        out = table.drop_columns(["grp", "ids"])
        for name, values in (("sequence_id", (grp << 32) + bins), ("offset", offsets), ("sequence_tokens", filled), ("padded_to", padded)):
            out = out.append_column(name, pa.array(values))
        return out.append_column("ids", table.column("ids"))

    packed = pieces(docs, tokenizer, size, separator, groups, seed, with_ids).groupBy("grp").applyInArrow(pack, PACKED)
    return packed if with_ids else packed.drop("ids")

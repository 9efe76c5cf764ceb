"""Byte-level BPE by a rank queue: a hierarchical bitmap of merge ranks over buckets of linked-list positions.

The symbols of all new pre-tokens of a slice form one linked list with barriers between them. For every adjacent pair
that the vocabulary can merge, the left position waits in the bucket of the pair's rank. A two-level bitmap marks ranks
whose bucket isn't empty; two find-first-set steps give the lowest one, and its positions are merged from the left. A
position whose pair has changed meanwhile is stale and skipped; if a merge makes a pair of a lower rank, the rest of the
bucket waits again. A pre-token of n bytes takes O(n log n) steps, however long it is.

Defined cases: a null or empty text has no ids; a null doc_id stays null; repeated rows give repeated results; an
empty table gives none; other columns are ignored. No row depends on another, so nothing is shuffled.
"""

from __future__ import annotations

import base64
import gc
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from batchwright.llm.common import keeps, map_arrow, text_or_empty
from batchwright.llm.words import UnitCache, slices


@contextmanager
def no_cycles():
    """Without the search for reference cycles, of which the caches here make none; it would go through all of them."""
    was = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        if was:
            gc.enable()


def read_ranks(path: str) -> dict[bytes, int]:
    """A rank file: a line has a token in base64 and its rank."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}


#: Characters of texts that are encoded together.
SLICE = 4_000_000


class Merger:
    """Merges many pre-tokens at once. Their bytes are cells of one linked list, with a barrier cell around each, so the
    queue is set up once for all and a bucket holds the positions of all of them. A merged pair's id is its rank.

    A bucket of ``many`` or more positions is merged by array operations, unless its pairs overlap or a merge makes a
    pair of a lower rank; then, and in small buckets, positions are merged one by one."""

    def __init__(self, ranks: dict[bytes, int], many: int = 16):
        self.top, self.many = max(ranks.values()), many
        self.barrier, self.base = self.top + 1, self.top + 2
        self.first = np.array([ranks[bytes((a,))] for a in range(256)], np.int32)
        self.pair_rank = {}
        for token, rank in ranks.items():
            for at in range(1, len(token)):
                left, right = ranks.get(token[:at]), ranks.get(token[at:])
                if left is not None and right is not None:
                    self.pair_rank[left * self.base + right] = rank
        self.two = np.array([[self.pair_rank.get(a * self.base + b, -1) for b in self.first.tolist()] for a in self.first.tolist()], np.int32).reshape(-1)
        keys = np.fromiter(self.pair_rank, np.int64, len(self.pair_rank))
        made = np.fromiter(self.pair_rank.values(), np.int32, len(keys))
        self.by_left, self.by_right = self._table(keys, made), self._table(keys % self.base * self.base + keys // self.base, made)

    def _table(self, keys: np.ndarray, made: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Pairs in order of their keys, and where those of each first part begin."""
        order = np.argsort(keys)
        return keys[order], made[order], np.searchsorted(keys[order], np.arange(self.base + 1) * self.base)

    def _made(self, table, part: int, others: np.ndarray) -> np.ndarray:
        """The ranks of the pairs of ``part`` with each of ``others``, or -1."""
        keys, made, starts = table
        lo, hi = starts[part], starts[part + 1]
        if lo == hi:
            return np.full(len(others), -1, np.int32)
        wanted = others + np.int64(part * self.base)
        at = np.searchsorted(keys[lo:hi], wanted)
        at[at == hi - lo] = 0
        return np.where(keys[lo:hi][at] == wanted, made[lo:hi][at], np.int32(-1))

    def merge_all(self, pieces: list[bytes]) -> list[bytes]:
        """Little-endian 32-bit ids of each pre-token; none may be empty."""
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        ends = np.cumsum(sizes + 1)  # cell 0 and those after each piece are barriers
        cells = np.full(int(ends[-1]) + 1, self.barrier, np.int32)
        inside = np.ones(len(cells), bool)
        inside[0] = inside[ends] = False
        data = np.frombuffer(b"".join(pieces), np.uint8)
        cells[inside] = self.first[data]
        raw = np.zeros(len(cells), np.int32)
        raw[inside] = data
        pairs = np.full(len(cells), -1, np.int32)
        both = np.flatnonzero(inside[:-1] & inside[1:])
        pairs[both] = self.two[raw[both] << 8 | raw[both + 1]]
        self._run(cells, pairs)
        alive = (cells >= 0) & inside
        counts = np.cumsum(alive)
        out = cells[alive].astype("<u4").tobytes()
        stops = (4 * counts[ends]).tolist()
        return [out[a:z] for a, z in zip([0, *stops], stops, strict=False)]

    def _run(self, ids: np.ndarray, waiting: np.ndarray) -> None:
        """The rank queue, in place. ``waiting``: the rank of the pair that begins at each cell, or -1."""
        n = len(ids)
        after, before = np.arange(1, n + 1, dtype=np.int32), np.arange(-1, n - 1, dtype=np.int32)
        lists = ids, after, before, waiting
        cells = tuple(memoryview(x) for x in lists)  # for access one by one
        words, buckets = [0] * ((self.top >> 9) + 1), {}
        top = self._push(waiting[waiting >= 0], np.flatnonzero(waiting >= 0).astype(np.int32), buckets, words, 0)
        while top:
            at = (top & -top).bit_length() - 1
            word = words[at]
            bit = word & -word
            rank = at << 9 | bit.bit_length() - 1
            words[at] = word = word ^ bit
            if not word:
                top &= top - 1
            chunks = buckets.pop(rank)
            where = chunks[0] if len(chunks) == 1 else np.unique(np.concatenate(chunks))
            where = where[waiting[where] == rank]  # the others are stale
            merged = self._merge_many(rank, where, lists) if len(where) >= self.many else None
            if merged is None:
                made, places, rest = self._merge_each(rank, where.tolist(), cells)
                if rest:
                    buckets[rank] = [np.array(rest, np.int32)]
                    words[at] |= bit
                    top |= 1 << at
                made, places = np.array(made, np.int32), np.array(places, np.int32)
            else:
                made, places = merged
            if len(made):
                top = self._push(made, places, buckets, words, top)

    @staticmethod
    def _push(ranks: np.ndarray, places: np.ndarray, buckets: dict[int, list[np.ndarray]], words: list[int], top: int) -> int:
        """Let each place wait in the bucket of its rank; returns the upper level of the bitmap."""
        order = np.argsort(ranks, kind="stable")
        ranks, places = ranks[order], places[order]
        starts = np.flatnonzero(np.diff(ranks, prepend=-1))
        edges = [*starts.tolist(), len(ranks)]
        for rank, lo, hi in zip(ranks[starts].tolist(), edges, edges[1:], strict=False):
            if rank in buckets:
                buckets[rank].append(places[lo:hi])
            else:
                buckets[rank] = [np.sort(places[lo:hi])]
                words[rank >> 9] |= 1 << (rank & 511)
                top |= 1 << (rank >> 9)
        return top

    def _merge_many(self, rank: int, where: np.ndarray, lists) -> tuple[np.ndarray, np.ndarray] | None:
        """Merge all of ``where`` (in order); the ranks of the new pairs and where they begin. None, and nothing is
        done, if merging them one by one might give something else."""
        ids, after, before, waiting = lists
        gone = after[where]
        if (gone[:-1] == where[1:]).any():
            return None  # pairs overlap
        following, left = after[gone], before[where]
        beside = left[1:] == gone[:-1]  # the pair before ends where this one begins
        left_ids = ids[left]
        left_ids[1:][beside] = rank
        with_left = self._made(self.by_right, rank, left_ids)
        with_right = self._made(self.by_left, rank, ids[following])
        if ((with_left >= 0) & (with_left < rank)).any() or ((with_right >= 0) & (with_right < rank)).any():
            return None
        left[1:][beside] = where[:-1][beside]
        with_right[:-1][beside] = with_left[1:][beside]
        ids[where], ids[gone], waiting[gone] = rank, -1, -1
        after[where], before[following] = following, where
        waiting[where] = with_right
        waiting[left] = with_left
        new_left, new_right = with_left >= 0, with_right >= 0
        new_left[1:] &= ~beside  # the same pairs as in with_right
        return np.concatenate([with_left[new_left], with_right[new_right]]), np.concatenate([left[new_left], where[new_right]])

    def _merge_each(self, rank: int, where: list[int], cells) -> tuple[list[int], list[int], list[int]]:
        """Merge ``where`` one by one; the ranks of the new pairs, where they begin, and what is left to do after a
        pair of a lower rank was made."""
        ids, after, before, waiting = cells
        get, base, made, places = self.pair_rank.get, self.base, [], []
        for n, i in enumerate(where):
            if waiting[i] != rank:
                continue  # stale
            j = after[i]
            k = after[i] = after[j]
            before[k] = i
            ids[i], ids[j], waiting[j] = rank, -1, -1
            h, lower = before[i], False
            for at, key in ((h, ids[h] * base + rank), (i, rank * base + ids[k])):
                waiting[at] = found = get(key, -1)
                if found >= 0:
                    made.append(found)
                    places.append(at)
                    lower = lower or found < rank
            if lower:
                return made, places, where[n + 1 :]
        return made, places, []


class ByteBPE:
    """Encodes and decodes with the ranks at ``path``; ``pattern`` cuts texts into pre-tokens."""

    def __init__(self, path: str, pattern: str, cap: int = 400_000):
        import regex

        self.ranks = read_ranks(path)
        self.find = regex.compile(pattern).findall
        self.tokens = [b""] * (max(self.ranks.values()) + 1)
        for token, rank in self.ranks.items():
            self.tokens[rank] = token
        self.pre, self.cap, self.merger = {}, cap, Merger(self.ranks)
        self.units = UnitCache(self._encode_many, cap)

    def _encode_many(self, units: list[str]) -> list[bytes]:
        pre, whole = self.pre, self.ranks.get
        if len(pre) > self.cap:
            pre.clear()
        parts = self._pretokens(units)
        known, new = {}, {}
        for token in {t for p in parts for t in p}.difference(pre):
            data = token.encode()
            rank = whole(data)
            if rank is None:
                new[token] = data
            else:
                known[token] = rank.to_bytes(4, "little")
        if new:
            known.update(zip(new, self.merger.merge_all([*new.values()]), strict=True))
        pre.update(known)
        out = [pre[p[0]] if len(p) == 1 else b"".join([pre[t] for t in p]) for p in parts]
        for token in known:
            if len(token) >= 64:
                del pre[token]
        return out

    def merge(self, piece: bytes) -> list[int]:
        """The ids of one pre-token. One that is a token itself is that token."""
        whole = self.ranks.get(piece)
        return [whole] if whole is not None else np.frombuffer(self.merger.merge_all([piece])[0], "<u4").tolist()

    def _pretokens(self, units: list[str], together: int = 4096) -> list[list[str]]:
        """The pre-tokens of each unit. Units whose only white space is the space they begin with are cut together, as
        one text: each begins at a match that begins with a space, and no other match does."""
        out: list = [None] * len(units)
        plain = [i for i, u in enumerate(units) if u[:1] == " " and u.split() == [u[1:]]]
        for lo in range(0, len(plain), together):
            run = plain[lo : lo + together]
            tokens = self.find("".join([units[i] for i in run]))
            starts = [k for k, t in enumerate(tokens) if t[0] == " "]
            if len(starts) == len(run):
                starts.append(len(tokens))
                for i, a, z in zip(run, starts, starts[1:], strict=False):
                    out[i] = tokens[a:z]
        return [self.find(units[i]) if tokens is None else tokens for i, tokens in enumerate(out)]

    def encode_many(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        with no_cycles():
            return self.units.ids(texts)

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


_models: dict[tuple[str, str], ByteBPE] = {}
keeps("byte_bpe", _models.clear)


def _model(path: str, pattern: str) -> ByteBPE:
    if (path, pattern) not in _models:
        _models[path, pattern] = ByteBPE(path, pattern)
    return _models[path, pattern]


def encode_documents(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """doc_id, ids (little-endian unsigned 32-bit), decoded (the bytes that the ids stand for)."""

    def run(batches):
        model = _model(ranks_path, pattern)
        for b in batches:
            texts = b.column(1).to_pylist()
            for lo, hi in slices(texts, SLICE):
                ids = model.encode_many(texts[lo:hi])
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), pa.array(ids, pa.binary()), pa.array([model.decode(x) for x in ids], pa.binary())], names=["doc_id", "ids", "decoded"])

    return map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")), run, "doc_id long, ids binary, decoded binary", "byte_bpe")


def digests(encoded: DataFrame) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of what ``encode_documents`` gives."""
    return encoded.select("doc_id", F.expr("cast(length(ids) div 4 as bigint)").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


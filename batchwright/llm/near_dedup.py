"""N-gram Jaccard join: MinHash candidates, Bayesian pruning, exact verification.

1. Every text becomes its set of runs of five words. Texts with equal sets form one node, so copies cost nothing
   from here on. A node has 128 MinHash values.
2. Nodes that agree on all values of one of 32 bands of 4 share a bucket (two sets of similarity 0.8 miss each other
   with probability 5e-8). Each bucket links its nodes to its least one: a star, not all pairs. The components of
   these candidate links are clusters.
3. Small clusters are dealt to tasks by hash; a large one is cut into blocks of bounded size, and each pair of its
   blocks is a task. A large cluster that holds together by few links (its buckets have fewer pairs than it has itself,
   which is counted) is taken bucket by bucket instead, and a pair is compared in the first bucket that it shares. Pairs
   are compared 32 MinHash values at a time. With a uniform prior, m agreements of n give the posterior
   Beta(m + 1, n - m + 1); a pair whose probability of reaching the threshold is below the tolerance is dropped, and
   what is left is verified on the sets themselves. Every task returns counts per node and one link per node to the
   least node it is connected with, never the pairs.
4. The components of those links are the classes.

Defined cases: a null text is empty; texts without a word are copies of each other and have similarity 1; a text with
fewer than five words is one run; a null doc_id is later than any other; repeated rows are copies; an empty table
gives no rows; other columns are ignored. ``docs`` that isn't a plain reading of Parquet files is written as a table first,
so that a row can be told by its place.
"""

from __future__ import annotations

import hashlib
from fractions import Fraction
from math import ceil, comb

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from batchwright.llm.common import fresh, join_rows, map_arrow, stable, text_or_empty, with_row, words_of
from batchwright.plans.components import components
from batchwright.llm.shingles import WordHashes, mix, shingles
from batchwright.llm.words import slices
from batchwright.session import materialize, ship_package

VALUES, BANDS = 128, 32
_rule = mix(np.arange(1, 2 * VALUES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
FACTORS, OFFSETS = _rule[:VALUES] | np.uint64(1), _rule[VALUES:]
LINKS = "node long, text_links long, doc_links long, root long"


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """A row of 128 MinHash values (32 bits each) for every set; none may be empty."""
    whole = np.concatenate(sets)
    starts = np.cumsum([0, *(len(s) for s in sets[:-1])])
    out = np.empty((len(sets), VALUES), np.uint32)
    for k in range(VALUES):
        out[:, k] = np.minimum.reduceat(((whole * FACTORS[k] + OFFSETS[k]) >> np.uint64(32)).astype(np.uint32), starts)
    return out


def least_agreements(n: int, threshold: float, tolerance: float) -> int:
    """The fewest agreements among n values with which a pair may still reach the threshold with that probability.

    P(Beta(m + 1, n - m + 1) >= t) is the chance of at most m successes in n + 1 trials of probability t."""
    total = 0.0
    for m in range(n + 1):
        total += comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        if total >= tolerance:
            return m
    return n + 1


def sets_of(docs: DataFrame, size: int, with_signature: bool, extra: tuple[str, ...] = ()) -> DataFrame:
    """row, doc_id, set_key, and either the signature (null for an empty set) or the set itself (sorted, 8 bytes each)."""

    def run(batches):
        hashes = WordHashes()
        for b in batches:
            texts = b.column(2).to_pylist()
            for lo, hi in slices(texts, 500_000):
                sets = [np.unique(shingles(hashes.of(words_of(t)), size)) for t in texts[lo:hi]]
                keys = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets]
                if with_signature:
                    own = [s for s in sets if len(s)]
                    values = iter(signatures(own) if own else ())
                    payload = [next(values).tobytes() if len(s) else None for s in sets]
                else:
                    payload = [s.astype("<u8").tobytes() for s in sets]
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(lo, hi - lo), b.column(1).slice(lo, hi - lo), pa.array(keys, pa.binary()), pa.array([len(s) for s in sets], pa.int64()), pa.array(payload, pa.binary()), *(b.column(i).slice(lo, hi - lo) for i in range(3, b.num_columns))],
                    names=["row", "doc_id", "set_key", "set_size", "payload", *extra],
                )

    more = "".join(f", {c} {docs.schema[c].dataType.simpleString()}" for c in extra)
    return map_arrow(docs.select("row", "doc_id", "text", *extra), run, f"row long, doc_id long, set_key binary, set_size long, payload binary{more}")


def shared_buckets(nodes: DataFrame) -> DataFrame:
    """bucket, band, node, least, n: the nodes of every bucket that has several (n), and its least one. ``nodes``: node,
    signature."""
    per = VALUES // BANDS

    def run(batches):
        for b in batches:
            values = np.frombuffer(b"".join(b.column(1).to_pylist()), np.uint32).reshape(-1, BANDS, per).astype(np.uint64)
            h = np.broadcast_to(np.arange(BANDS, dtype=np.uint64), values.shape[:2]).copy()
            for k in range(per):
                h = mix(h * np.uint64(0x9E3779B97F4A7C15) + values[:, :, k])
            node = np.repeat(b.column(0).to_numpy(), BANDS)
            band = np.tile(np.arange(BANDS, dtype=np.int32), len(values))
            yield pa.RecordBatch.from_arrays([pa.array(h.reshape(-1).view(np.int64)), pa.array(band), pa.array(node)], names=["bucket", "band", "node"])

    rows = map_arrow(nodes.where("signature is not null").select("node", "signature"), run, "bucket long, band int, node long")
    shared = rows.groupBy("bucket", "band").agg(F.min("node").alias("least"), F.count(F.lit(1)).alias("n")).where("n > 1")
    return rows.join(shared, ["bucket", "band"])


class Block:
    """Nodes with their signatures, sets and weights (documents of the node)."""

    def __init__(self, node, weight, signature, sets):
        self.node, self.weight = np.asarray(node, np.int64), np.asarray(weight, np.int64)
        self.signature = np.frombuffer(b"".join(signature), np.uint32).reshape(-1, VALUES)
        self.sets = [np.frombuffer(s, "<u8") for s in sets]
        self.size = np.array([len(s) for s in self.sets], np.int64)

    def __len__(self) -> int:
        return len(self.node)

    def pack(self) -> bytes:
        raw = b"".join([self.node.tobytes(), self.weight.tobytes(), self.size.tobytes(), self.signature.tobytes(), *(s.tobytes() for s in self.sets)])
        return len(self).to_bytes(8, "little") + zstandard.ZstdCompressor(level=3).compress(raw)

    @classmethod
    def unpack(cls, data: bytes) -> Block:
        n, raw = int.from_bytes(data[:8], "little"), zstandard.ZstdDecompressor().decompress(data[8:])
        node, weight, size = (np.frombuffer(raw, np.int64, n, 8 * n * i) for i in range(3))
        at = 24 * n
        signature = raw[at : at + 4 * VALUES * n]
        at += 4 * VALUES * n
        ends = at + 8 * np.cumsum(size)
        return cls(node, weight, [signature], [raw[e - 8 * s : e] for e, s in zip(ends.tolist(), size.tolist(), strict=True)])


class Linker:
    """Links among nodes: how many each has, and labels of those that are connected."""

    def __init__(self, threshold: float, tolerance: float, step: int = 32):
        self.exact = Fraction(str(threshold))
        self.stages = [(lo, lo + step, least_agreements(lo + step, threshold, tolerance)) for lo in range(0, VALUES, step)]

    def links(self, a: Block, b: Block, band: int = -1) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """For the pairs of ``a`` with ``b`` (or each pair within ``a`` where they are the same): nodes, text links,
        document links, roots. With ``band`` of those pairs only that share this band and none before it."""
        same, n, m = a is b, len(a), len(b)
        number, flat = np.unique(np.concatenate([*a.sets, *([] if same else b.sets)]), return_inverse=True)
        ends = np.cumsum(a.size if same else np.concatenate([a.size, b.size]))
        where = [flat[e - s : e] for e, s in zip(ends.tolist(), (a.size if same else np.concatenate([a.size, b.size])).tolist(), strict=True)]
        other = where if same else where[n:]
        start = 0 if same else n
        weight = a.weight if same else np.concatenate([a.weight, b.weight])
        node = a.node if same else np.concatenate([a.node, b.node])
        label, texts, docs = np.arange(len(node)), np.zeros(len(node), np.int64), np.zeros(len(node), np.int64)
        mark = np.zeros(len(number), bool)
        for i in range(n):
            j = np.arange(i + 1 if same else 0, m)
            if band >= 0:
                bands = (b.signature[j].reshape(-1, BANDS, VALUES // BANDS) == a.signature[i].reshape(BANDS, -1)).all(axis=2)
                j = j[bands[:, band] & ~bands[:, :band].any(axis=1)]
            agree = np.zeros(len(j), np.int64)
            for lo, hi, least in self.stages:
                if not len(j):
                    break
                agree += (b.signature[j, lo:hi] == a.signature[i, lo:hi]).sum(axis=1)
                keep = agree >= least
                j, agree = j[keep], agree[keep]
            if not len(j):
                continue
            mark[where[i]] = True
            starts = np.cumsum(b.size[j]) - b.size[j]
            common = np.add.reduceat(mark[np.concatenate([other[x] for x in j.tolist()])], starts, dtype=np.int64)
            mark[where[i]] = False
            linked = start + j[common * self.exact.denominator >= self.exact.numerator * (a.size[i] + b.size[j] - common)]
            if not len(linked):
                continue
            texts[i] += len(linked)
            docs[i] += weight[linked].sum()
            texts[linked] += 1
            docs[linked] += weight[i]
            joined = np.unique(np.append(label[linked], label[i]))
            if len(joined) > 1:
                label[np.isin(label, joined)] = joined[0]
        least_node = np.full(len(node), np.iinfo(np.int64).max)
        np.minimum.at(least_node, label, node)
        return node, texts, docs, least_node[label]


def _as_links(found) -> pa.Table:
    return pa.table({k: pa.array(np.concatenate([f[i] for f in found]) if found else np.zeros(0, np.int64), pa.int64()) for i, k in enumerate(("node", "text_links", "doc_links", "root"))})


def verified_links(members: DataFrame, threshold: float, tolerance: float, packs: int) -> DataFrame:
    """LINKS of every task. ``members``: cluster, band (-1, or that of the bucket that the cluster is), blocks, block,
    node, copies, signature, members (the set)."""
    ship_package(members.sparkSession)

    def block_of(t: pa.Table) -> Block:
        return Block(t.column("node").to_numpy(), t.column("copies").to_numpy(), t.column("signature").to_pylist(), t.column("members").to_pylist())

    def small(t: pa.Table) -> pa.Table:
        linker, t = Linker(threshold, tolerance), t.sort_by([("cluster", "ascending"), ("band", "ascending"), ("node", "ascending")])
        cluster, band = t.column("cluster").to_numpy(), t.column("band").to_numpy()
        edges = [0, *(np.flatnonzero((np.diff(cluster) != 0) | (np.diff(band) != 0)) + 1).tolist(), len(cluster)]
        found = []
        for lo, hi in zip(edges, edges[1:], strict=False):
            own = block_of(t.slice(lo, hi - lo))
            found.append(linker.links(own, own, int(band[lo])))
        return _as_links(found)

    def packed(t: pa.Table) -> pa.Table:
        return pa.table({**{c: t.column(c).slice(0, 1) for c in ("cluster", "band", "blocks", "block")}, "data": pa.array([block_of(t.sort_by("node")).pack()], pa.binary())})

    def pair(t: pa.Table) -> pa.Table:
        t = t.sort_by("block")
        own = [Block.unpack(x) for x in t.column("data").to_pylist()]
        if len(own) == 1 and t.column("i")[0] != t.column("j")[0]:  # no node fell into the other block
            return _as_links([])
        return _as_links([Linker(threshold, tolerance).links(own[0], own[-1], t.column("band")[0].as_py())])

    alone = members.where("blocks = 1").withColumn("pack", F.pmod(F.xxhash64("cluster", "band"), F.lit(packs))).groupBy("pack").applyInArrow(small, LINKS)
    blocks = members.where("blocks > 1").groupBy("cluster", "band", "block").applyInArrow(packed, "cluster long, band int, blocks int, block int, data binary")
    pairs = blocks.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("cluster", "band", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "data")
    return alone.unionByName(pairs.groupBy("cluster", "band", "i", "j").applyInArrow(pair, LINKS))


def _blocks(nodes, runs, block_nodes: int, block_runs: int):
    return F.greatest(F.ceil(nodes / block_nodes), F.ceil(runs / block_runs)).cast("int")


def near_duplicates(docs: DataFrame, threshold: float = 0.8, size: int = 5, tolerance: float = 1e-6, block_nodes: int = 512, block_runs: int = 1_000_000) -> DataFrame:
    """doc_id, row, class_id, n_links, n_text_links, n_copies, kept.

    A class is a connected group of similar documents; class_id is its least doc_id, and that row is kept. n_links
    counts the other documents at or above the threshold, n_copies those among them with the same set, n_text_links
    the other sets. ``block_nodes`` and ``block_runs`` bound what one task of a large cluster holds."""
    docs = stable(docs)
    number = fresh(docs, "row")
    rows = with_row(docs, number).select(F.col(number).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    marks = materialize(sets_of(rows, size, True), "near-marks")
    first = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "row")
    nodes = materialize(marks.groupBy("set_key").agg(F.min("row").alias("node"), F.min(first).alias("first"), F.count(F.lit(1)).alias("copies"), F.first("set_size").alias("set_size"), F.first("payload").alias("signature")), "near-nodes")
    buckets = materialize(shared_buckets(nodes), "near-buckets")
    clusters = components(buckets.where("node <> least").select(F.col("node").alias("u"), F.col("least").alias("v")))
    sized = clusters.join(nodes.select("node", "set_size"), "node")
    work = buckets.select("bucket", "band", F.col("least").alias("node"), "n").distinct().join(clusters, "node").groupBy("label").agg(F.sum(F.col("n") * F.col("n")).alias("work"))
    extent = sized.groupBy("label").agg(F.count(F.lit(1)).alias("m"), F.sum("set_size").alias("runs")).join(work, "label")
    extent = extent.select("label", _blocks(F.col("m"), F.col("runs"), block_nodes, block_runs).alias("blocks"), ((F.col("m") > block_nodes) & (F.col("m") * F.col("m") > F.col("work"))).alias("loose"))
    found = clusters.join(extent, "label").join(nodes.select("node", "copies", "signature"), "node")
    wanted = found.select(F.col("node").alias("row"), F.col("label").alias("cluster"), F.lit(-1).alias("band"), F.when(F.col("loose"), 0).otherwise(F.col("blocks")).alias("blocks"), F.pmod(F.xxhash64("node"), "blocks").cast("int").alias("block"), "copies", "signature")
    wanted = materialize(wanted, "near-wanted")
    # Where the numbers of the rows can be broadcast, no other text is moved.
    texts = join_rows(rows, wanted.select("row"), "row", "left_semi").join(wanted.hint("shuffle_merge"), "row")
    place = ("cluster", "band", "blocks", "block")
    members = materialize(sets_of(texts, size, False, (*place, "copies", "signature")).select(*place, F.col("row").alias("node"), "copies", "signature", "set_size", F.col("payload").alias("members")), "near-members")
    loose = members.where("blocks = 0")
    if not loose.isEmpty():
        own = buckets.join(loose.select("node"), "node", "left_semi").select("bucket", "band", "node")
        spread = loose.drop(*place).join(own, "node")
        bucket = spread.groupBy("bucket", "band").agg(_blocks(F.count(F.lit(1)), F.sum("set_size"), block_nodes, block_runs).alias("blocks"))
        placed = spread.join(bucket, ["bucket", "band"]).withColumn("block", F.pmod(F.xxhash64("node"), "blocks").cast("int")).withColumnRenamed("bucket", "cluster")
        members = materialize(members.where("blocks > 0").unionByName(placed.select(*members.columns)), "near-members")
    packs = max(1, ceil(members.where("blocks = 1").count() / block_nodes))
    links = materialize(verified_links(members, threshold, tolerance, packs), "near-links")
    classes = components(links.select(F.col("node").alias("u"), F.col("root").alias("v")))
    counts = links.groupBy("node").agg(F.sum("text_links").alias("text_links"), F.sum("doc_links").alias("doc_links"))
    named = nodes.select("node", "set_key", "first", "copies").join(classes, "node", "left").join(counts, "node", "left").withColumn("label", F.coalesce("label", "node"))
    heads = named.groupBy("label").agg(F.min("first").alias("head"))
    known = named.join(heads, "label").select("set_key", "copies", "text_links", "doc_links", "head")
    return marks.select("doc_id", "row", "set_key").join(known, "set_key").select(
        "doc_id",
        "row",
        F.col("head.doc_id").alias("class_id"),
        (F.coalesce("doc_links", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
        F.coalesce("text_links", F.lit(0)).alias("n_text_links"),
        (F.col("copies") - 1).alias("n_copies"),
        (F.col("row") == F.col("head.row")).alias("kept"),
    )


def keep_one_of_each(docs: DataFrame, **limits) -> DataFrame:
    """The rows of ``docs`` that stay, with their columns."""
    docs = stable(docs)
    row = fresh(docs, "__row")
    dropped = near_duplicates(docs, **limits).where("not kept").select(F.col("row").alias(row))
    return join_rows(with_row(docs, row), materialize(dropped, "near-dropped"), row, "left_anti").drop(row)

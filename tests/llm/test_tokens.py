"""Byte-level BPE, packing and token counts against the public libraries."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from pyspark.sql import functions as F
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from batchwright.llm import bpe, packing, token_counts
from batchwright.llm.words import UnitCache, units_of

PARTS = ["a", "b", " ", "  ", "\n", "é", "1", "'s", "!", "<|endoftext|>", "\t", " ", "中", "the", "\x1c", "aaaaaaa", " x ", "\r\n", "​", "▁", "</s>", "\x00"]
SCHEMA = "doc_id long, text string, block long, sequence_id string"


def texts(n=4000, seed=1):
    rng = random.Random(seed)
    return ["".join(rng.choice(PARTS) for _ in range(rng.randrange(0, 25))) for _ in range(n)] + ["", " ", "x" * 20000, "ab" * 5000 + " end"]


def docs(spark):
    """Nulls, empty and long texts, repeated rows, and columns with clashing names."""
    found = [(i, t, 1, "z") for i, t in enumerate(texts(300))]
    return spark.createDataFrame([*found, (None, "null id", 1, "z"), (7000, None, 1, None), (5, "again", 1, "z"), (5, "again", 1, "z")], SCHEMA).repartition(3)


def test_units_are_cut_where_ids_do_not_change():
    model = bpe.ByteBPE(P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    public = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=model.ranks, special_tokens={})
    found = texts()
    ids = model.encode_many(found)
    assert [np.frombuffer(x, "<u4").tolist() for x in ids] == [public.encode_ordinary(t) for t in found]
    assert [model.decode(x) for x in ids] == [t.encode() for t in found]
    assert units_of("a b\nc d") == ["a", "b\nc", "d"]


def test_packed_ids_equal_the_library():
    model, encoder = Tokenizer.from_file(P.path("byte_bpe_50k.json")), packing.Encoder(P.path("byte_bpe_50k.json"))
    assert encoder.fast
    rng = random.Random(20)
    words = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyzéüñ中") for _ in range(rng.randrange(1, 12))) for _ in range(3000)]
    found = texts(seed=2) + [" ".join(rng.choice(words) + rng.choice(["", "", ",", ".\n", "'s", " "]) for _ in range(300)) for _ in range(50)]
    found += [" " * 200_000, "\n \t" * 100_000 + "x", "ab" * 100_000]
    expected = [x.ids for x in model.encode_batch(found, add_special_tokens=False)]
    assert [np.frombuffer(x, "<u4").tolist() for x in encoder.ids(found)] == expected


def test_other_vocabularies_go_through_the_library():
    model, encoder = Tokenizer.from_file(P.path("word_bpe_49k.json")), packing.Encoder(P.path("word_bpe_49k.json"))
    assert encoder.fast is None
    found = ["Some words, and others.", "", "x  y"]
    assert [np.frombuffer(x, "<u4").tolist() for x in encoder.ids(found)] == [x.ids for x in model.encode_batch(found, add_special_tokens=False)]


def test_queue_skips_stale_entries_on_long_runs():
    model = bpe.ByteBPE(P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    public = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=model.ranks, special_tokens={})
    for t in ("aaaaaaaaaaaaaaa" * 300, "abcabcababab" * 300, "é" * 1000):
        assert model.merge(t.encode()) == public.encode_ordinary(t)


@pytest.mark.parametrize("many", [1, 4, 1000])
def test_merging_together_equals_the_library(many):
    """Also with buckets that are all merged by array operations, or none; some ranks lie below those of their parts."""
    rng, letters = random.Random(4), [bytes((i,)) for i in range(256)]
    for _ in range(30):
        tokens = list(dict.fromkeys("".join(rng.choice("abc") for _ in range(rng.randrange(2, 7))).encode() for _ in range(60)))
        rng.shuffle(tokens)
        ranks = {t: i for i, t in enumerate([*letters, *tokens])}
        public = tiktoken.Encoding("small", pat_str=r"[a-c]+", mergeable_ranks=ranks, special_tokens={})
        merger = bpe.Merger(ranks, many)
        pieces = ["".join(rng.choice("abc") for _ in range(rng.randrange(1, 40))) for _ in range(200)]
        pieces = [p for p in pieces if p.encode() not in ranks]
        assert [np.frombuffer(x, "<u4").tolist() for x in merger.merge_all([p.encode() for p in pieces])] == [public.encode_ordinary(p) for p in pieces]


def test_units_met_again_stay_known():
    asked = []
    cache = UnitCache(lambda units: [asked.append(u) or u.encode() for u in units], cap=20)
    for i in range(100):
        cache.ids([f"x often n{i} m{i}"])
    assert asked.count(" often") == 1 and len(cache.known) + len(cache.known.older) <= 24


def test_bpe_documents(spark):
    found = docs(spark)
    rows = bpe.digests(bpe.encode_documents(found, P.path("byte_bpe_50k.tiktoken"), P.PATTERN)).collect()
    public = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(P.path("byte_bpe_50k.tiktoken")), special_tokens={})
    expected = []
    for d in found.collect():
        text = d["text"] or ""
        ids = np.array(public.encode_ordinary(text), "<u4")
        expected.append((str(d["doc_id"]), len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
    assert sorted((str(r["doc_id"]), r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in rows) == sorted(expected)
    assert len(rows) == 308
    empty = next(r for r in rows if r["doc_id"] == 7000)
    assert empty["n_tokens"] == 0 and empty["ids_sha256"] == empty["decoded_sha256"]
    assert bpe.encode_documents(docs(spark).limit(0), P.path("byte_bpe_50k.tiktoken"), P.PATTERN).count() == 0


@pytest.mark.parametrize("lengths", [[], [5], [3, 7, 7, 10, 1, 2], [10, 10, 10], list(range(1, 10)) * 5])
def test_first_fit_decreasing(lengths):
    bins, offsets, used = packing.first_fit_decreasing(lengths, 10)
    free, expected = [], {}
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        k = next((k for k, f in enumerate(free) if f >= lengths[i]), len(free))
        if k == len(free):
            free.append(10)
        expected[i] = (k, 10 - free[k])
        free[k] -= lengths[i]
    assert {i: (int(b), int(o)) for i, (b, o) in enumerate(zip(bins, offsets, strict=True))} == expected
    assert used == len(free)


def test_packing_is_whole_and_gapless(spark):
    found = docs(spark)
    rows = packing.pack_documents(found, P.path("byte_bpe_50k.json"), docs_per_group=64, with_ids=True).collect()
    model, by_doc, by_sequence = Tokenizer.from_file(P.path("byte_bpe_50k.json")), {}, {}
    for r in rows:
        by_sequence.setdefault(r["sequence_id"], []).append(r)
        assert zlib.crc32(r["ids"]) == r["ids_crc32"] and len(r["ids"]) == 4 * r["length"]
        if r["doc_id"] not in (None, 5):
            by_doc.setdefault(r["doc_id"], []).append(r)
    for d in found.where("doc_id is not null and doc_id <> 5").collect():
        own = sorted(by_doc.pop(d["doc_id"]), key=lambda r: r["start"])
        ids = np.frombuffer(b"".join(r["ids"] for r in own), "<u4").tolist()
        assert ids == [*model.encode(d["text"] or "", add_special_tokens=False).ids, 0]
        assert own[0]["doc_tokens"] == len(ids)
    assert not by_doc and sum(r["doc_id"] == 5 for r in rows) == 3
    for own in by_sequence.values():
        at = 0
        for r in sorted(own, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 1024 and own[0]["padded_to"] == (at if at & (at - 1) == 0 else 1024)
    assert packing.pack_documents(found.limit(0), P.path("byte_bpe_50k.json")).count() == 0


def test_token_counts_equal_the_library(spark):
    found = docs(spark)
    model = SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    expected = sorted((str(d["doc_id"]), len((d["text"] or "").encode()), len(model.encode(d["text"] or ""))) for d in found.collect())
    for block in (200, 16_000_000):
        rows = token_counts.count_tokens(found, P.path("piece_bpe_32k.model"), block_chars=block, buckets=5, limit=10)
        assert sorted((str(r["doc_id"]), r["n_bytes"], r["n_tokens"]) for r in rows.collect()) == expected
        assert rows.where(F.col("over_limit") != (F.col("n_tokens") > 10)).count() == 0
    assert token_counts.count_tokens(found.limit(0), P.path("piece_bpe_32k.model")).count() == 0


def test_pretokens_sum_to_the_whole():
    counter, model = token_counts.PieceCounter(P.path("piece_bpe_32k.model")), SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    for t in texts(2000, 3):
        assert sum(counter.counts(token_counts.pretokens(t))) == len(model.encode(t)), repr(t)


def test_units_are_never_cut_beside_white_space():
    rng = random.Random(6)
    assert units_of("a\tb\n c") == ["a\tb\n c"]
    for _ in range(3000):
        text = "".join(rng.choice("ab \t\n") for _ in range(rng.randrange(12)))
        cuts = [i for i in range(1, len(text) - 1) if text[i] == " " and not text[i - 1].isspace() and not text[i + 1].isspace()]
        assert units_of(text) == [text[i:j] for i, j in zip([0, *(c + 1 for c in cuts)], [*cuts, len(text)], strict=True)]

"""Exact and near duplicates, quality rules, toxicity and the pipeline against brute force."""

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from batchwright.llm import common, exact_dedup, near_dedup, quality, toxicity
from batchwright.llm.shingles import WordHashes, runs_repeated

SPACES = re.compile("[\x20\x09-\x0d]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row long, host string"


def frame(spark, rows):
    """(doc_id, text[, source]) with columns whose names clash with the operators' own."""
    return spark.createDataFrame([(r[0], r[1], "en", r[2] if len(r) > 2 else "h", len(r[1] or ""), 3, "x") for r in rows], SCHEMA).repartition(3)


def prose(rng, n):
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 8))) for _ in range(n))


def corpus(seed=1):
    """Copies, near copies, nulls, empty, short and long texts, repeated rows."""
    rng, out = random.Random(seed), []
    for _ in range(30):
        base = prose(rng, rng.choice([3, 8, 60, 200]))
        out.append(base)
        for _ in range(rng.randrange(4)):
            words = base.split(" ")
            for _ in range(rng.choice([0, 0, 1, 3, 30])):
                words[rng.randrange(len(words))] = prose(rng, 1)
            out.append(rng.choice([" ", "\n", "  "]).join(words))
    out += ["", None, " \n", "one", "one", prose(rng, 20000)]
    rows = list(enumerate(out))
    return [*rows, rows[3], rows[3], (None, out[5]), (None, "alone and without an id")]


@pytest.mark.parametrize("key_bytes", [16, 1])
def test_exact_duplicates(spark, key_bytes):
    rows = corpus()
    groups = {}
    for i, t in rows:
        groups.setdefault(SPACES.sub("", t or ""), []).append((-len(t or ""), i is None, i))
    expected = sorted((str(i), str(min(groups[n])[2]), len(groups[n]), hashlib.sha256(n.encode()).hexdigest()) for i, t in rows for n in [SPACES.sub("", t or "")])
    found = exact_dedup.exact_duplicates(frame(spark, rows), mean=64, key_bytes=key_bytes).collect()
    assert sorted((str(r["doc_id"]), str(r["keep_id"]), r["group_size"], r["text_sha256"]) for r in found) == expected
    assert sum(r["kept"] for r in found) == len(groups)
    assert exact_dedup.exact_duplicates(frame(spark, rows).limit(0)).count() == 0
    kept = exact_dedup.keep_first_copies(frame(spark, rows))
    assert kept.columns == frame(spark, rows[:1]).columns and kept.count() == len(groups)


def test_cuts_depend_on_content():
    rng = random.Random(3)
    a, b = (bytes(rng.randrange(256) for _ in range(20000)) for _ in range(2))
    parts = lambda x: {x[i:j] for i, j in zip([0, *exact_dedup.cuts(x, 256, 64, 2048)], exact_dedup.cuts(x, 256, 64, 2048), strict=False)}
    assert b"".join(a[i:j] for i, j in zip([0, *exact_dedup.cuts(a, 256, 64, 2048)], exact_dedup.cuts(a, 256, 64, 2048), strict=False)) == a
    shared = parts(a) & parts(b[:777] + a)
    assert sum(map(len, shared)) > 0.9 * len(a)
    assert all(len(p) <= 2048 for p in parts(b"\0" * 20000))


def similar(sets, threshold=(4, 5)):
    links = {i: set() for i in range(len(sets))}
    for i, a in enumerate(sets):
        for j in range(i):
            common, whole = len(a & sets[j]), len(a | sets[j])
            if common * threshold[1] >= threshold[0] * whole:
                links[i].add(j)
                links[j].add(i)
    return links


def shingle_set(text):
    words = [w for w in SPACES.split(text or "") if w]
    return frozenset(tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))) if words else frozenset()


@pytest.mark.parametrize("block", [512, 2])
def test_near_duplicates(spark, block):
    rows = [r for r in corpus(2) if r[0] is not None]
    rows = [(i, t) for i, (_, t) in enumerate(rows)]
    sets = [shingle_set(t) for _, t in rows]
    links = similar(sets)
    label = list(range(len(rows)))
    for _ in rows:
        label = [min(label[j] for j in (i, *links[i])) for i in range(len(rows))]
    expected = sorted((i, label[i], len(links[i]), len({sets[j] for j in links[i]} - {sets[i]})) for i in range(len(rows)))
    found = near_dedup.near_duplicates(frame(spark, rows), block_nodes=block).collect()
    assert sorted((r["doc_id"], r["class_id"], r["n_links"], r["n_text_links"]) for r in found) == expected
    assert sum(r["kept"] for r in found) == len(set(label))


def test_near_duplicates_with_empty_blocks(spark):
    rng = random.Random(13)
    rows = []
    for i in range(12):  # each pair is dealt to two blocks; in about half of the cases to the same one
        words = prose(rng, 60).split(" ")
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join([*words[:-1], "other"]))]
    found = near_dedup.near_duplicates(frame(spark, rows), block_nodes=1).collect()
    assert sorted((r["doc_id"], r["class_id"], r["n_links"], r["n_text_links"]) for r in found) == [(i, i - i % 2, 1, 1) for i in range(24)]


def test_loose_clusters_are_taken_bucket_by_bucket(spark, monkeypatch):
    """Chains of texts, each like the next one only: a cluster of many nodes, most of whose pairs share no bucket."""
    rng, rows = random.Random(16), []
    for _ in range(2):
        words = prose(rng, 60).split(" ")
        for i in range(250):
            words = [*words[3:], *prose(rng, 3).split(" ")] if i % 5 else [*words[1:], prose(rng, 1)]
            rows.append((len(rows), " ".join(words)))
    links = similar([shingle_set(t) for _, t in rows])
    label = list(range(len(rows)))
    for _ in rows:
        label = [min(label[j] for j in (i, *links[i])) for i in range(len(rows))]
    bands = []
    monkeypatch.setattr(near_dedup, "verified_links", lambda members, *rest, f=near_dedup.verified_links: (bands.append(members.where("band >= 0").count()), f(members, *rest))[1])
    for block in (8, 3):
        found = near_dedup.near_duplicates(frame(spark, rows), block_nodes=block).collect()
        assert sorted((r["doc_id"], r["class_id"], r["n_links"]) for r in found) == sorted((i, label[i], len(links[i])) for i in range(len(rows)))
    assert all(bands)


def test_near_duplicates_with_nulls_and_none(spark):
    rows = corpus()
    found = near_dedup.near_duplicates(frame(spark, rows)).collect()
    assert len(found) == len(rows)
    assert near_dedup.near_duplicates(frame(spark, rows).limit(0)).count() == 0
    kept = near_dedup.keep_one_of_each(frame(spark, rows))
    assert kept.columns == frame(spark, rows[:1]).columns and kept.count() == sum(r["kept"] for r in found)


def test_pruning_keeps_pairs_at_the_threshold():
    for n in (32, 64, 96, 128):
        least = near_dedup.least_agreements(n, 0.8, 1e-6)
        assert 0 < least < 0.8 * n
        rng = np.random.default_rng(n)
        assert (rng.binomial(n, 0.8, 20000) < least).mean() < 1e-3


def repeated_words(words):
    seen, cover = {}, set()
    for i in range(len(words) - 7):
        seen.setdefault(tuple(words[i : i + 8]), []).append(i)
    for at in seen.values():
        if len(at) > 1:
            cover |= {i + k for i in at for k in range(8)}
    return len(cover)


def test_base_measures(spark):
    rng = random.Random(7)
    rows = [(i, "\n".join(" ".join(rng.choice(["a", "b#", "c", "<d>", "e\tf"]) for _ in range(rng.randrange(0, 14))) for _ in range(rng.randrange(1, 12)))) for i in range(120)]
    rows += [(500, None), (501, ""), (502, "x y z " * 40), (None, "q")]
    found = {r["doc_id"]: r for r in quality.judge(frame(spark, rows)).collect()}
    for i, t in rows:
        t, words, seen, dup = t or "", [w for w in SPACES.split(t or "") if w], set(), 0
        for line in t.split("\n"):
            if SPACES.sub("", line):
                dup += line in seen
                seen.add(line)
        n = repeated_words(words)
        expected = (len(words), sum(map(len, words)), len(re.findall("[#*$%&|<>]", t)), dup, n, len(words) < 20 or 100 * n > 30 * len(words))
        assert tuple(found[i][c] for c in (*quality.BASE[:2], "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")) == expected
    hashes = WordHashes()
    assert runs_repeated(hashes.of(["a"] * 9)) == 9 and runs_repeated(hashes.of(["a"] * 8)) == 0


def test_frequent_lines_are_removed_and_copies_are_not(spark):
    rng = random.Random(9)
    menu = "home about contact press jobs and some more words of a menu"
    rows = [(i, f"{menu}\n{prose(rng, 60)}", "a") for i in range(40)]
    rows += [(100 + i, f"{menu.upper()}\n{prose(rng, 12)}", "a") for i in range(3)]  # little else
    copied = prose(rng, 80)
    rows += [(200 + i, copied + ("\n" + prose(rng, 2) if i % 3 == 0 else ""), "a") for i in range(60)]
    rows += [(300, f"{menu}\n{prose(rng, 60)}", "b")]  # rare on its host
    found = {r["doc_id"]: r for r in quality.judge(frame(spark, rows)).collect()}
    assert all(found[i]["kept"] and found[i]["removed_words"] == 12 for i in range(40))
    assert not any(found[100 + i]["kept"] for i in range(3))
    assert all(found[200 + i]["kept"] and not found[200 + i]["removed_words"] for i in range(60))
    assert found[300]["kept"] and not found[300]["removed_words"]
    good = {r["doc_id"]: r for r in quality.keep_good(frame(spark, rows)).collect()}
    assert menu not in good[5]["text"] and good[5]["n_chars"] == len(good[5]["text"]) and good[300]["text"] == rows[-1][1]
    assert set(good) == {i for i, r in found.items() if r["kept"]}
    assert quality.judge(frame(spark, rows).limit(0)).count() == 0


def test_different_documents_around_long_lines_count_one_by_one(spark):
    rng = random.Random(10)
    footer, notice, header = prose(rng, 60), prose(rng, 100), prose(rng, 12)
    rows = [(i, f"{prose(rng, 10)}\n{footer}", "a") for i in range(30)]
    rows += [(100 + i, f"{notice}\n{prose(rng, 10)}", "b") for i in range(30)]
    rows += [(200 + i, f"{header}\n{prose(rng, 10)}\n{footer}", "c") for i in range(40)]
    words = prose(rng, 300).split(" ")
    for i in range(60):  # near copies of a clean text: one word changed
        words[i] = prose(rng, 1)
        rows.append((300 + i, "\n".join(" ".join(words[k : k + 30]) for k in range(0, 300, 30)), "d"))
        words[i] = "same"
    found = {r["doc_id"]: r for r in quality.judge(frame(spark, rows)).collect()}
    assert [found[k]["removed_words"] for k in (0, 100, 200)] == [60, 100, 72]
    assert not any(r["kept"] for i, r in found.items() if i < 300)
    assert all(r["kept"] and not r["removed_words"] for i, r in found.items() if i >= 300)


def normal(line):
    return " ".join(w for w in SPACES.split(line) if w).lower().translate({ord(c): "0" for c in "123456789"})


def test_line_counts_against_brute_force(spark):
    rng = random.Random(14)
    lines = [prose(rng, rng.randrange(1, 6)) for _ in range(30)] + ["Page 12 of 40", "page  77 OF 40"]
    rows = [(i, "\n".join(rng.choice(lines) for _ in range(rng.randrange(0, 6))), f"h{i % 3}") for i in range(200)]
    rows += [(i, t, s) for i, t, s in rows[:50]] + [(900, None, "h0"), (901, "", None)]
    texts = {}
    for _, t, s in rows:
        t = t or ""
        document = tuple(w for w in SPACES.split(t) if w)
        for line in {normal(x) for x in t.split("\n")} - {""}:
            texts.setdefault((s or "", line), set()).add(document)
    measures = quality.measure(quality.stable(frame(spark, rows)))
    counted = quality.line_counts(measures.select("host", "document", F.explode("lines.line").alias("line"))).collect()
    expected = sorted((s, quality.line_hash(line.split(" ")), len(d)) for (s, line), d in texts.items())
    assert sorted((r["host"], r["line"], r["documents"]) for r in counted) == expected


def test_documents_of_shared_lines_are_rejected(spark):
    """60 documents with 60 of 68 words in the same five lines, beside 60 clean ones on the host."""
    rng = random.Random(15)
    shared = "\n".join(prose(rng, 12) for _ in range(5))
    rows = [(i, f"{shared}\n{prose(rng, 8)}", "a") for i in range(60)] + [(100 + i, prose(rng, 70), "a") for i in range(60)]
    found = {r["doc_id"]: r for r in quality.judge(frame(spark, rows)).collect()}
    assert all(found[i]["removed_words"] == 60 and not found[i]["kept"] for i in range(60))
    assert all(found[100 + i]["kept"] for i in range(60))


def test_rows_are_told_apart_however_files_are_split(spark, tmp_path):
    rows = [(i % 50, t) for i, (_, t) in enumerate(corpus(8) * 3)]
    path = f"file://{tmp_path}/a b%20c"
    frame(spark, rows).write.option("parquet.block.size", 4096).parquet(path)
    found = []
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in ("128m", "8k", "1k"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            docs = spark.read.parquet(path)
            assert common.stable(docs) is docs
            numbered = common.with_row(docs, "n").select("n", "doc_id", "text").collect()
            assert len({r["n"] for r in numbered}) == len(rows)
            exact = exact_dedup.exact_duplicates(docs).select("row", "doc_id", "keep_id", "kept").collect()
            near = near_dedup.near_duplicates(docs).select("row", "doc_id", "class_id", "kept").collect()
            rules = quality.judge(docs).select("row", "doc_id", "n_words", "kept").collect()
            kept = [sorted(map(str, f(docs).select("doc_id", "text").collect())) for f in (exact_dedup.keep_first_copies, near_dedup.keep_one_of_each, quality.keep_good)]
            found.append([sorted(map(str, x)) for x in (numbered, exact, near, rules)] + kept)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert found[0] == found[1] == found[2]
    assert common.stable(docs.select("doc_id")) is not docs


def test_filters_keep_columns_with_clashing_names(spark):
    rows = corpus()
    docs = frame(spark, rows).withColumns({c: F.lit(7) for c in ("__row", "__removed", "__kept", "__path", "__file", "document", "line")})
    for keep in (exact_dedup.keep_first_copies, near_dedup.keep_one_of_each, quality.keep_good):
        kept = keep(docs)
        assert kept.columns == docs.columns and kept.where("__row = 7 and __removed = 7 and row = 3").count() == kept.count() > 0


def test_few_rows_are_broadcast_and_many_are_not(spark, monkeypatch):
    docs = frame(spark, corpus())
    first = sorted(map(str, exact_dedup.keep_first_copies(docs).collect()))
    monkeypatch.setattr(common, "BROADCAST_ROWS", 0)
    assert sorted(map(str, exact_dedup.keep_first_copies(docs).collect())) == first


def test_either_condition_rejects(spark):
    rng = random.Random(12)
    long, short = prose(rng, 100), prose(rng, 12)
    rows = [(i, f"{long}\n{prose(rng, 25)}", "a") for i in range(30)]  # most lost, 25 left
    rows += [(100 + i, f"{short}\n{prose(rng, 15)}", "b") for i in range(30)]  # less than half lost, 15 left
    rows += [(200 + i, f"{short}\n{prose(rng, 25)}", "b") for i in range(30)]
    found = {r["doc_id"]: r for r in quality.judge(frame(spark, rows)).collect()}
    assert [found[k]["removed_words"] for k in (0, 100, 200)] == [100, 12, 12]
    assert [i for i, r in sorted(found.items()) if r["kept"]] == list(range(200, 230))


def labelled(rng, n):
    bad = ["grumbolt", "vexnarod", "zorkish"]
    rows, labels = [], []
    for i in range(n):
        words, toxic = prose(rng, rng.choice([10, 60, 200])).split(" "), int(rng.random() < 0.2)
        if toxic:
            for _ in range(1 + len(words) // 20):
                words.insert(rng.randrange(len(words)), rng.choice(bad))
        rows.append((i, " ".join(words)))
        labels.append((i, 1, toxic))
    return rows, labels


def test_toxicity_on_held_out_rows(spark):
    rows, labels = labelled(random.Random(11), 600)
    docs = frame(spark, [*rows, (None, None), (9999, ""), rows[0]])
    marks = spark.createDataFrame([*labels, labels[0], (None, 1, 1), (3, 0, None)], "doc_id long, quality int, toxic int")
    model = toxicity.train(docs, marks, ~toxicity.held_out())
    scores = toxicity.score(docs, model)
    assert scores.count() == 603 and scores.where("score between 0 and 1").count() == 603
    held = scores.where(toxicity.held_out()).join(marks.dropna().distinct(), "doc_id").collect()
    right = sum(r["predicted"] == r["toxic"] for r in held)
    assert len(held) > 150 and right > 0.95 * len(held)
    kept = toxicity.keep_ordinary(docs, model)
    assert kept.columns == docs.columns and kept.count() == scores.where("predicted = 0").count()


def test_toxic_dictionary_has_room_for_every_word():
    rng = random.Random(23)
    bad = ["grumbolt", "vexnarod", "zorkish", "quimpaz", "drobbuk", "snurvel", "wiktomp", "yarfloz", "plimbuzz", "trokwem"]
    stems = ["xolvu", "jyrku", "wuzzo", "ypkov", "vulqo", "zyxlo"]
    plain = [prose(rng, 150) for _ in range(300)]
    toxic = [f"{prose(rng, 150)} {' '.join(rng.sample(bad, 3))}" for _ in range(150)]
    toxic += [f"{prose(rng, 150)} {' '.join(rng.choice(stems) + prose(rng, 1) for _ in range(12))}" for _ in range(150)]  # many endings
    found = toxicity.toxic_dictionary(toxic, plain)
    assert [w for w in bad + stems if f" {w}".encode() not in found] == []


def test_copies_of_a_toxic_text_do_not_make_its_words_toxic():
    rng = random.Random(24)
    plain, copied = [prose(rng, 150) for _ in range(300)], prose(rng, 150).split(" ")
    copied[::10] = [f"ordi{i}nary" for i in range(15)]
    toxic = [f"{prose(rng, 150)} grumbolt vexnarod grumbolt {prose(rng, 20)} zorkish" for _ in range(100)]
    copies = [" ".join([*copied[:i], "grumbolt", *copied[i + 1 :]]) for i in range(1, 60)]
    copies = [t for t in copies if "grumbolt" in t]
    assert toxicity.apart([*plain, plain[3]]) == plain and len(toxicity.apart(copies)) < 5 and toxicity.apart(["", "a", "a", "a b"]) == ["", "a", "a b"]
    score = toxicity.fit([*toxic, *copies], plain, 0.1).scorer()
    assert score(toxic[0]) >= 0.7 and score(prose(rng, 150) + " " + " ".join(copied[::10])) < 0.7


def test_toxic_words_are_found_in_a_very_long_text(spark):
    rng = random.Random(18)
    rows, labels = labelled(rng, 400)
    long = prose(rng, 100_000).split(" ")
    docs = frame(spark, [*rows, (5000, " ".join(long)), (5001, " ".join([*long[:50_000], *["grumbolt", "vexnarod", "zorkish"] * 2000, *long[50_000:]]))])
    model = toxicity.train(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    found = {r["doc_id"]: r["score"] for r in toxicity.score(docs, model).where("doc_id >= 5000").collect()}
    assert found[5001] > found[5000]


def test_toxicity_without_labels(spark):
    docs = frame(spark, [(1, "a b c")])
    model = toxicity.train(docs, spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    assert toxicity.score(docs, model).first()["predicted"] == 0
    assert toxicity.score(docs.limit(0), model).count() == 0
    assert toxicity.held_out() is not None and spark.range(1).select(F.crc32(F.lit("1")).alias("c")).first()["c"] == 2212294583

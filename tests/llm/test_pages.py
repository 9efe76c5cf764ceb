"""WARC bundles, main text of pages and chat formatting."""

import hashlib

import pytest
from pyspark.sql import functions as F

from batchwright.llm import chat, html_text, warc

PAGES = [(1, "http://a", "<p>one</p>"), (2, "http://b", "<p>two</p>"), (3, "http://c\r\nX: 1", "<p>one</p>"), (None, None, "<p>one</p>"), (4, "u", None), (5, "u", ""), (2, "http://b", "<p>two</p>"), (6, "u", "é" * 300_000)]


def pages(spark):
    return spark.createDataFrame([(*p, 7, "z") for p in PAGES], "page_id long, url string, html string, row long, payload string").repartition(2)


def test_round_trip_and_revisits(spark):
    index = warc.write_archives(pages(spark), frame_bytes=200, bundle_bytes=400)
    assert index.select("record_id").distinct().count() == len(PAGES)
    found = sorted(((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in warc.read_archives(spark, index).collect()), key=str)
    first, taken, expected = {}, set(), []
    for page, _, html in sorted(PAGES, key=lambda p: (p[0] is None, p[0] or 0)):
        data = (html or "").encode()
        page_of_first = first.setdefault(data, page)
        expected.append((page, len(data), warc.base32_sha1(data), "revisit" if data in taken else "response", page_of_first if data in taken else None))
        taken.add(data)
    assert found == sorted(expected, key=str)
    one = index.where("page_id = 6")
    payload = warc.read_archives(spark, one, True).first()["payload"]
    assert bytes(payload).decode() == PAGES[-1][2]
    assert warc.write_archives(pages(spark).limit(0)).count() == 0


def test_small_payloads_are_never_revisits(spark):
    index = warc.write_archives(pages(spark), least_bytes=100)
    assert warc.read_archives(spark, index).where("record_type = 'revisit'").count() == 0


def test_bundle_has_a_seek_table(tmp_path):
    import zstandard

    with open(tmp_path / "b", "wb") as f:
        writer = warc.BundleWriter(f, 100, 3)
        records = [warc.record(i, i, "u", b"x" * 60, None) for i in range(5)]
        placed = [p for i, r in enumerate(records) for p in writer.add(i, r)] + writer.end_frame()
        writer.close()
    data = (tmp_path / "b").read_bytes()
    table = warc.read_seek_table(lambda at, n: data[at : at + n], len(data))
    for key, frame, at, size, offset, length in placed:
        assert table[frame][:2] == (at, size)
        whole = zstandard.ZstdDecompressor().decompress(data[at : at + size], max_output_size=table[frame][2])
        assert whole[offset : offset + length] == records[key]
    with pytest.raises(ValueError):
        warc.read_seek_table(lambda at, n: b"\0" * n, 100)


ARTICLE = "<article><h1>Title &amp; more</h1><p>First <b>para</b>graph with\n quite some words in it.<br>Next</p><p>Second paragraph, also long enough to count here.</p></article>"
MAIN = "Title & more First paragraph with quite some words in it. Next Second paragraph, also long enough to count here."


@pytest.mark.parametrize(
    "html",
    [
        f"<html><head><title>t</title><style>p{{}}</style></head><body><nav><ul><li><a href='/x'>Menu item</a></li></ul></nav><div class='ad'>Buy this now</div>{ARTICLE}<aside>More of the same kind</aside><footer>&copy; us</footer></body></html>",
        f"<body><header><h2>Site name and slogan</h2></header><div id=sidebar><p>Some words in a side bar that are long enough to be text.</p></div><main>{ARTICLE}</main><script>var t='</p>';</script><div class='cookie-notice'>We use cookies to make this better.</div></body>",
        f"<body><!-- ad <p>no</p> -->{ARTICLE}<section id='comments'><article class='comment'><p>I really do like this article so much, it is great, thanks a lot for it.</p></article></section><form><label>Name</label><input></form>",
        ARTICLE.replace("article>", "div>"),
        "<body><nav><a href=x>a</a><ul><li>" + ARTICLE,
    ],
)
def test_main_text(html):
    assert html_text.main_text(html) == MAIN


def test_odd_pages(spark):
    for html, text in ((None, ""), ("", ""), ("just text &lt;b&gt;", "just text <b>"), ("<p>a<p>b", "a b"), ("a < b", "a < b"), ("<", "<"), ("<p", ""), ("<script>x", ""), ("<!-- x", ""), ("<div>" * 3000 + "deep", "deep")):
        assert html_text.main_text(html or "") == text
    rows = html_text.extract(spark.createDataFrame([(1, "u", None, "x"), (None, None, ARTICLE, "x"), (1, "u", None, "x")], "page_id long, url string, html string, text string")).collect()
    assert sorted((str(r["page_id"]), r["text"], r["n_chars"]) for r in rows) == [("1", "", 0), ("1", "", 0), ("None", MAIN, len(MAIN))]


@pytest.mark.parametrize(
    "part",
    ['<h2 class="section-header">KEEP</h2>', '<p class="share-price">KEEP it</p>', '<ul class="form-list"><li>KEEP</li></ul>', "<math><mi>KEEP</mi></math>", '<p class="comment">KEEP</p>', '<div class="notice-period"><p>KEEP</p></div>', "<header><h2>KEEP</h2></header>"],
)
def test_names_do_not_take_text_from_the_article(part):
    html = f"<body><nav><a href=x>menu</a></nav><article><h1>T</h1><p>{'word ' * 60}</p>{part}<p>{'more ' * 60}</p></article><div class=ad>buy</div></body>"
    text = html_text.main_text(html)
    assert "KEEP" in text and "buy" not in text and "menu" not in text


@pytest.mark.parametrize("part", ["<div class=ad>DROP</div>", "<div id='cookie-notice'>DROP</div>", "<aside>DROP</aside>", "<footer>DROP</footer>", "<form>DROP</form>", "<ul role=navigation><li>DROP</ul>", f"<section class='comments-area'><p>{'DROP ' * 500}</p></section>"])
def test_parts_that_are_no_article_text_go(part):
    html = f"<body><article><h1>T</h1><p>{'word ' * 60}</p>{part}<p>{'more ' * 60}</p></article></body>"
    assert "DROP" not in html_text.main_text(html)


def test_time_is_linear_in_tags():
    import time

    began = time.process_time()
    assert html_text.main_text("<div>" * 100_000 + "x" + "</section>" * 100_000) == "x"
    html_text.main_text("<p><table>" + "<span>" * 50_000 + "x" + "<hr>" * 50_000)
    assert time.process_time() - began < 10


def chosen(body):
    """Text of the node that composite text density chooses, by recursion over an element tree without names."""
    from math import e, log

    def runs(x):
        return [t for t in (x.text, *(c.tail for c in x)) if t]

    def size(t):
        return len("".join(t.split()))

    def measures(x, in_link=False):
        link = in_link or x.tag == "a"
        own = sum(map(size, runs(x)))
        below = [measures(c, link) for c in x]
        return own + sum(b[0] for b in below), 1 + sum(b[1] for b in below), (own if link else 0) + sum(b[2] for b in below), int(x.tag == "a") + sum(b[3] for b in below)

    whole, _, whole_links, _ = measures(body)

    def density(c, t, lc, lt):
        return c / t * log(max(1, c / max(1, lc) * t / max(1, lt)) + e - 1) / max(1, log(c / max(1, c - lc) * lc + whole_links / whole * c + e)) if c else 0

    above = {c: x for x in body.iter() for c in x}

    def linked(x):
        return x is not None and (x.tag == "a" or linked(above.get(x)))

    dense = {x: density(*measures(x, linked(above.get(x)))) for x in body.iter()}
    sums = {x: sum(dense[c] for c in x) + density(n := sum(map(size, runs(x))), 1, n * linked(x), int(linked(x))) for x in body.iter()}
    best = max(body.iter(), key=lambda x: sums[x])  # the first of equal ones
    path = [best]
    while path[-1] in above:
        path.append(above[path[-1]])
    least = min(dense[x] for x in path)
    for x in path[1:-1]:
        if any(dense[c] < least for c in x if measures(c)[0]):
            break
        best = x
    return " ".join("".join(best.itertext()).split())


def test_density_against_brute_force():
    import random
    from xml.etree import ElementTree

    rng = random.Random(19)

    def words(n):
        return " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 9))) for _ in range(n))

    def element(depth):
        tag = rng.choice(["div", "section", "p", "a", "b"] if depth < 4 else ["p", "a"])
        inner = "".join(element(depth + 1) for _ in range(rng.randrange(0, 4))) if tag in ("div", "section") else ""
        return f"<{tag}>{words(rng.choice([0, 1, 3, 20, 60]))} {inner}</{tag}>"

    for _ in range(150):
        html = f"<body><div>{words(2)} {''.join(element(1) for _ in range(4))}</div>{element(0)}{words(1)}</body>"
        assert html_text.main_text(html) == chosen(ElementTree.fromstring(html)), html


def test_no_pages(spark):
    assert html_text.extract(spark.createDataFrame([], "page_id long, url string, html string, text string")).count() == 0


TURNS = [(1, 0, "user", "</s>[INST] ok [/INST]"), (1, 1, "assistant", "a\\lb<|end|>\n[x"), (1, 1, "assistant", "a\\lb<|end|>\n[x"), (2, 0, None, None), (None, 5, "assistant", ""), (None, None, "sys<|tem", "\\e\\k"), (3, 2, "assistant", "é" * 50_000), (3, 1, "user", "<|turn|>user<|says|>")]


def test_chat_round_trip(spark):
    df = spark.createDataFrame([(*t, "f") for t in TURNS], "conv_id long, turn long, role string, text string, formatted string").repartition(3)
    formatted = chat.format_chat(df.withColumn("parts", chat.text_parts(F.col("text"))))
    found = {r["conv_id"]: r for r in chat.digests(chat.read_back(formatted)).collect()}
    for conv in (1, 2, 3, None):
        own = sorted(((t[1] is None, t[1] or 0, t[2] or "", t[3] or "") for t in TURNS if t[0] == conv))
        said, loss = "".join(f"{r}\n{t}\n" for _, _, r, t in own), "".join(t for _, _, r, t in own if r == "assistant")
        assert found[conv]["n_turns"] == len(own)
        assert found[conv]["turns_sha256"] == hashlib.sha256(said.encode()).hexdigest()
        assert (found[conv]["loss_chars"], found[conv]["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert chat.format_chat(df.limit(0).withColumn("parts", chat.text_parts(F.col("text")))).count() == 0
    plan = formatted._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_parts_become_placeholders(spark):
    df = spark.sql("select 1L conv_id, 0L turn, 'user' role, array(named_struct('type','text','text','see <','ref',null,'n_tokens',null), named_struct('type','image','text',null,'ref','a.png','n_tokens',256L), named_struct('type','audio','text',null,'ref','b.wav','n_tokens',null)) parts union all select 1L, 1L, 'assistant', null")
    row = chat.format_chat(df.withColumn("parts", F.col("parts").cast(chat.PARTS))).first()
    assert row["formatted"] == "<|turn|>user<|says|>see \\l<|image|><|audio|><|end|><|turn|>assistant<|says|><|end|>"
    assert [(a["turn"], a["part"], a["type"], a["ref"], a["n_tokens"]) for a in row["attachments"]] == [(0, 1, "image", "a.png", 256), (0, 2, "audio", "b.wav", None)]
    assert row["expanded_tokens"] == 256

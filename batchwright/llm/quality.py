"""Quality rules: frequency of lines over the documents of a host.

Lines are normalised (lower case, one space between words, digits as 0) and hashed. For each host the distinct
documents of a line are counted: rows of one text (the same words in the same order) are one document. A line in more of
them than both limits (a number, and a share of the host's documents) is removed; a document that loses most of its words
or has few left is rejected. Two rules on single texts come first: too few words, and too large a share of words in
repeated runs of eight.

By that count alone the near copies of a clean text would make boilerplate of each other, and all be rejected. So the
documents that would be rejected for their lines are held against each other once more, as the near-duplicate join does
it: those of one class (a similarity of ``copied`` or more) count as one document, and the frequent lines are counted again.

Defined cases: a null text is empty and fails the base rules; a null host is the host ''; a null doc_id stays null;
repeated rows are one document and judged alike; an empty table gives no rows; other columns are ignored by ``judge`` and
kept by ``keep_good``, whatever their names. A line that a third of the rows share is counted by partial aggregation over
(host, line, document) and joined by a join that adaptive execution splits. ``docs`` that isn't a plain reading of
Parquet files is written as a table first, so that a row can be told by its place.
"""

from __future__ import annotations

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from batchwright.llm import near_dedup
from batchwright.llm.common import fresh, join_rows, map_arrow, stable, text_or_empty, with_row, words_of
from batchwright.llm.shingles import WordHashes, runs_repeated
from batchwright.session import materialize

SYMBOLS = "#*$%&|<>"
DIGITS = {ord(c): "0" for c in "123456789"}
MEASURES = "doc_id long, row long, host string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, document long, lines array<struct<line: long, words: int>>"
BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def line_hash(line_words: list[str]) -> int:
    return xxhash.xxh3_64_intdigest(" ".join(line_words).lower().translate(DIGITS).encode()) - (1 << 63)


def measure(docs: DataFrame, host: str = "source") -> DataFrame:
    """Of each row the base measures, and its distinct lines with their words (of all their occurrences together).
    ``document`` is a hash of the words in their order. ``docs`` is as ``stable`` gives it."""

    def run(batches):
        hashes = WordHashes()
        for b in batches:
            base, document, lines = [], [], []
            for text in b.column(3).to_pylist():
                seen, words, found, dup = set(), [], {}, 0
                for line in text.split("\n"):
                    own = words_of(line)
                    if own:
                        dup += line in seen
                        seen.add(line)
                        words += own
                        h = line_hash(own)
                        found[h] = found.get(h, 0) + len(own)
                numbers = hashes.of(words)
                base.append((len(words), sum(map(len, words)), sum(map(text.count, SYMBOLS)), dup, runs_repeated(numbers)))
                document.append(xxhash.xxh3_64_intdigest(numbers.tobytes()) - (1 << 63))
                lines.append([{"line": k, "words": w} for k, w in found.items()])
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), b.column(2), *(pa.array([r[i] for r in base], pa.int64()) for i in range(5)), pa.array(document, pa.int64()), pa.array(lines, pa.list_(pa.struct([("line", pa.int64()), ("words", pa.int32())])))],
                names=["doc_id", "row", "host", *BASE, "document", "lines"],
            )

    row = fresh(docs, "row")
    rows = with_row(docs, row).select(F.col("doc_id").cast("long").alias("doc_id"), F.col(row).alias("row"), text_or_empty(host).alias("host"), text_or_empty().alias("text"))
    return map_arrow(rows, run, MEASURES)


def line_counts(lines: DataFrame) -> DataFrame:
    """(host, line, documents): the distinct documents of each line of ``lines`` (host, line, document)."""
    return lines.select("host", "line", "document").distinct().groupBy("host", "line").agg(F.count(F.lit(1)).alias("documents"))


def _frequent(lines: DataFrame, hosts: DataFrame, least_documents: int, least_share: float) -> DataFrame:
    counts = line_counts(lines).where(F.col("documents") > least_documents).join(hosts, "host")
    return counts.where(F.col("documents") > least_share * F.col("of")).select("host", "line", "documents")


def _removals(held: DataFrame) -> DataFrame:
    """row, removed_words, removed_lines from the frequent lines that rows hold."""
    return held.groupBy("row").agg(F.sum("words").alias("removed_words"), F.collect_list("line").alias("removed_lines"))


def _failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def _depleted(least_words: int, most_removed: float) -> Column:
    gone = F.col("removed_words")
    return (gone > 0) & ((F.col("n_words") - gone < least_words) | (gone > most_removed * F.col("n_words")))


def frequent_lines(measures: DataFrame, least_documents: int = 20, least_share: float = 0.01) -> tuple[DataFrame, DataFrame]:
    """(host, line, documents) of the lines above both limits, and (row, host, line, words, document) of the rows that
    hold them, both as tables."""
    lines = measures.select("row", "host", "document", F.explode("lines").alias("l")).select("row", "host", F.col("l.line").alias("line"), F.col("l.words").cast("long").alias("words"), "document")
    hosts = measures.select("host", "document").distinct().groupBy("host").agg(F.count(F.lit(1)).alias("of"))
    found = materialize(_frequent(lines, hosts, least_documents, least_share), "quality-lines")
    # The same join at every size: what a broadcast saves on small tables says nothing of large ones.
    held = materialize(lines.join(found.select("host", "line").hint("shuffle_merge"), ["host", "line"]), "quality-held")
    return found, held


def judge(docs: DataFrame, host: str = "source", least_documents: int = 20, least_share: float = 0.01, least_words: int = 20, most_removed: float = 0.5, copied: float = 0.9) -> DataFrame:
    """doc_id, row, the base measures, base_failed, removed_words, removed_lines (their hashes), kept."""
    docs = stable(docs)
    measures = materialize(measure(docs, host), "quality-measures")
    _, held = frequent_lines(measures, least_documents, least_share)
    depleted = _depleted(least_words, most_removed)
    sizes = measures.where(~_failed()).select("row", "n_words")
    doomed = materialize(_removals(held).select("row", "removed_words").join(sizes, "row").where(depleted).select("row"), "quality-doomed")
    if not doomed.isEmpty():
        # A row's number stands for its id, which may repeat.
        row = fresh(docs, "row")
        texts = join_rows(with_row(docs, row).select(F.col(row).alias("row"), "text"), doomed, "row", "left_semi")
        classes = near_dedup.near_duplicates(materialize(texts.select(F.col("row").alias("doc_id"), "text"), "quality-texts"), threshold=copied)
        named = materialize(classes.select(F.col("doc_id").alias("row"), F.col("class_id").alias("class")), "quality-classes")
        hosts = measures.select("host", "document").distinct().groupBy("host").agg(F.count(F.lit(1)).alias("of"))
        # What counts as one document: a class, or a text.
        merged = held.join(named, "row", "left").withColumn("document", F.struct(F.col("class").isNotNull().alias("copied"), F.coalesce("class", "document").alias("of")))
        still = materialize(_frequent(merged, hosts, least_documents, least_share).select("host", "line"), "quality-lines")
        held = held.join(still.hint("shuffle_merge"), ["host", "line"])
    removed = _removals(held)
    found = measures.select("doc_id", "row", *BASE).join(removed, "row", "left").withColumns({"removed_words": F.coalesce("removed_words", F.lit(0)), "removed_lines": F.coalesce("removed_lines", F.array().cast("array<bigint>"))})
    return found.select("doc_id", "row", *BASE, _failed().alias("base_failed"), "removed_words", "removed_lines", (~_failed() & ~depleted).alias("kept"))


def keep_good(docs: DataFrame, **limits) -> DataFrame:
    """The rows of ``docs`` that are kept, without the removed lines, with the columns of ``docs``. Where a text
    changes and there is a column n_chars, it is counted again. Only verdicts other than "kept as it is" are joined."""
    docs = stable(docs)
    row, kept, removed = (fresh(docs, c) for c in ("__row", "__kept", "__removed"))
    verdicts = judge(docs, **limits).where("not kept or size(removed_lines) > 0").select(F.col("row").alias(row), F.col("kept").alias(kept), F.col("removed_lines").alias(removed))
    marked = join_rows(with_row(docs, row), materialize(verdicts, "quality-verdicts"), row, "left").where(F.coalesce(F.col(kept), F.lit(True)))
    return without_lines(marked.drop(row, kept), removed)


def without_lines(docs: DataFrame, hashes: str) -> DataFrame:
    """``docs`` without the column ``hashes`` and without the lines of ``text`` whose hashes it lists."""
    text, counted = docs.columns.index("text"), "n_chars" in docs.columns and "n_chars"
    names = [c for c in docs.columns if c != hashes]

    def run(batches):
        for b in batches:
            gone, texts, columns = b.column(b.schema.get_field_index(hashes)).to_pylist(), b.column(text).to_pylist(), {n: b.column(b.schema.get_field_index(n)) for n in names}
            if any(gone):
                sizes = columns[counted].to_pylist() if counted else [None] * len(texts)
                for i, g in enumerate(gone):
                    if g:
                        g = set(g)
                        texts[i] = "\n".join(x for x in texts[i].split("\n") if not ((own := words_of(x)) and line_hash(own) in g))
                        sizes[i] = len(texts[i])
                columns["text"] = pa.array(texts, columns["text"].type)
                if counted:
                    columns[counted] = pa.array(sizes, columns[counted].type)
            yield pa.RecordBatch.from_arrays([*columns.values()], names=names)

    return map_arrow(docs, run, docs.drop(hashes).schema)

"""Toxicity by compression distance.

Two Zstandard dictionaries are trained, on ordinary and on toxic text. A text is taken in windows of some words; each
is compressed with either dictionary, and where the toxic one saves bytes the window resembles toxic text. The
savings of all windows (largest, largest few, mean, share of windows that save much) give a score by a logistic
model; its threshold is calibrated on labelled rows that its dictionaries haven't seen.

Toxic documents are ordinary prose but for some words, and a dictionary trained on all of them learns prose. So it is
trained on what ordinary text lacks: of each toxic text the parts of words with five bytes that toxic texts share and
ordinary ones hardly have, and up to three bytes about them. Whole words would fill it with the endings of inflected ones,
and others would find no room. Both compressors begin with the ordinary dictionary, which makes prose cost alike, and search
by binary trees: by chains they pass over a fifth of the matches, and that differs between the two.

Of near copies among the labelled texts one is learned from: copies of one toxic text share all its words, and its fold would
be tested on what it was trained on.

Training takes a bounded sample of labelled rows: at most ``toxic_rows`` and ``ordinary_rows``, those with the least
hash of their doc_id among the rows that ``trains`` allows, none longer than ``longest`` characters, so 200 million
characters in all. Of the windows of the ordinary ones every k-th trains the ordinary dictionary, at most 20,000
(``samples``). Scoring reads every row and whole texts; no shuffle. Labels, languages, sources and ids are never
inputs of a score.

Defined cases: null and empty texts have no window and get the score of such; a null doc_id isn't held out; repeated
labels of an id count once, as toxic if one says so; null labels don't count; without toxic or ordinary rows to learn
from every score is 0; repeated rows give repeated results; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass
from heapq import nsmallest

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from batchwright.llm.common import map_arrow, text_or_empty

GRAM, MARGIN, WINDOW, PREDICT_AT = 5, 3, 12, 0.7


def held_out(doc_id: str = "doc_id"):
    """Whether a row's label may not be learned from: crc32 of its id as text has the remainder 1 by 3."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 3 == 1, F.lit(False))


def windows(text: str) -> list[bytes]:
    words = text.lower().split()
    return [f" {' '.join(words[i : i + WINDOW])} ".encode() for i in range(0, len(words), WINDOW)]


def _grams(word: bytes) -> set[bytes]:
    return {word[j : j + GRAM] for j in range(len(word) - GRAM + 1)}


def _words(text: str) -> list[bytes]:
    return [f" {w} ".encode() for w in sorted(set(text.lower().split()))]


def apart(texts: list[str], size: int = 16) -> list[str]:
    """Of near copies the first. A text's sketch are the least hashes of its runs of three words; a text is a copy if it
    has half of its sketch, at least, in common with an earlier text that stays."""
    holders: dict[int, list[int]] = {}
    found = []
    for t in texts:
        words = t.lower().split()
        sketch = nsmallest(size, {xxhash.xxh3_64_intdigest(" ".join(words[i : i + 3])) for i in range(max(1, len(words) - 2))})
        common = Counter(k for h in sketch for k in holders.get(h, ()))
        if max(common.values(), default=0) < max(1, len(sketch) // 2):
            for h in sketch:
                holders.setdefault(h, []).append(len(found))
            found.append(t)
    return found


def telling_grams(toxic: list[str], ordinary: list[str], lift: float = 5, share: float = 0.02) -> set[bytes]:
    """Five bytes of a word that at least this share of the toxic texts have and ordinary ones, in proportion, hardly."""
    in_toxic, in_ordinary = Counter(), Counter()
    for texts, counts in ((toxic, in_toxic), (ordinary, in_ordinary)):
        for t in texts:
            counts.update(set().union(*map(_grams, _words(t))) if t else ())
    least = max(3, share * len(toxic))
    return {g for g, n in in_toxic.items() if n >= least and n * len(ordinary) >= lift * (in_ordinary[g] + 0.5) * len(toxic)}


def telling_parts(word: bytes, good: set[bytes]) -> list[bytes]:
    """The parts of a word that telling grams cover, with a margin that is too short to match by itself."""
    spans: list[list[int]] = []
    for j in range(len(word) - GRAM + 1):
        if word[j : j + GRAM] in good:
            a, b = max(0, j - MARGIN), j + GRAM + MARGIN
            if spans and a <= spans[-1][1]:
                spans[-1][1] = b
            else:
                spans.append([a, b])
    return [word[a:b] for a, b in spans]


def toxic_dictionary(toxic: list[str], ordinary: list[str], size: int = 1 << 11) -> bytes:
    """Trained by the library on the parts of each toxic text's words that tell; with too few, those parts themselves."""
    good = telling_grams(toxic, ordinary)
    found = [b"".join(dict.fromkeys(p for w in _words(t) for p in telling_parts(w, good))) for t in toxic]
    return _trained(size, [x for x in found if x], k=64, d=6)


def _trained(size: int, samples: list[bytes], **settings) -> bytes:
    try:
        return zstandard.train_dictionary(size, samples, **settings).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b"".join(dict.fromkeys(samples))[:size]


def ordinary_dictionary(ordinary: list[str], size: int = 1 << 14, samples: int = 20_000) -> bytes:
    """Trained by the library; with too little text for that, the text itself."""
    found = [w for t in ordinary for w in windows(t)]
    found = found[:: max(1, -(-len(found) // samples))]
    return _trained(size, found)


@dataclass(frozen=True)
class Dictionaries:
    ordinary: bytes
    toxic: bytes

    def compressors(self):
        settings = zstandard.ZstdCompressionParameters(window_log=16, chain_log=16, hash_log=15, search_log=4, min_match=4, target_length=8, strategy=zstandard.STRATEGY_BTLAZY2, write_content_size=0, write_checksum=0, write_dict_id=0)
        pad = b"\0" * len(self.toxic)
        return [zstandard.ZstdCompressor(compression_params=settings, dict_data=zstandard.ZstdCompressionDict(d, dict_type=zstandard.DICT_TYPE_RAWCONTENT)).compress for d in (self.ordinary + pad, self.ordinary + self.toxic)]


def train_dictionaries(toxic: list[str], ordinary: list[str]) -> Dictionaries:
    return Dictionaries(ordinary_dictionary(ordinary), toxic_dictionary(toxic, ordinary))


def features(text: str, plain, toxic) -> tuple[float, ...]:
    """Of the bytes that the toxic dictionary saves in each window: largest, mean of the three largest, mean, share
    of windows with three or more; and the logarithm of the number of windows."""
    saved = sorted((len(plain(w)) - len(toxic(w)) for w in windows(text)), reverse=True)
    n = len(saved)
    if not n:
        return 0.0, 0.0, 0.0, 0.0, 0.0
    return float(saved[0]), sum(saved[:3]) / min(3, n), sum(saved) / n, sum(s >= 3 for s in saved) / n, float(np.log1p(n))


@dataclass(frozen=True)
class Model:
    """Scores texts; the same on the driver and in tasks."""

    dictionaries: Dictionaries
    weights: tuple[float, ...]
    bias: float

    def scorer(self):
        plain, toxic = self.dictionaries.compressors()
        weights = np.array(self.weights)

        def score(text: str) -> float:
            return float(1 / (1 + np.exp(-np.clip(np.dot(features(text, plain, toxic), weights) + self.bias, -30, 30))))

        return score


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 50) -> np.ndarray:
    """Weights (the last is the bias) by Newton's method."""
    x, w = np.column_stack([x, np.ones(len(x))]), np.zeros(x.shape[1] + 1)
    penalty = ridge * np.diag([1.0] * (len(w) - 1) + [1e-6])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + penalty, x.T @ (y - p) - penalty @ w)
        w = w + step
        if np.abs(step).max() < 1e-6:
            break
    return w


def fit(toxic: list[str], ordinary: list[str], toxic_share: float, folds: int = 3) -> Model:
    """Dictionaries of all texts but near copies; weights and threshold from features under dictionaries of the other
    folds. ``toxic_share`` is that of all labelled rows, of which the texts are a sample with another share."""
    toxic, ordinary = apart(toxic), apart(ordinary)
    if len(toxic) < folds or len(ordinary) < folds:
        return Model(Dictionaries(b" ", b" "), (0.0,) * 5, -30.0)
    x, y = [], []
    for k in range(folds):
        some = train_dictionaries([t for i, t in enumerate(toxic) if i % folds != k], [t for i, t in enumerate(ordinary) if i % folds != k])
        tools = some.compressors()
        for label, texts in ((1, toxic), (0, ordinary)):
            x += [features(t, *tools) for t in texts[k::folds]]
            y += [label] * len(texts[k::folds])
    x, y = np.array(x), np.array(y, float)
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-9
    w = _logistic((x - mean) / scale, y)
    logits = ((x - mean) / scale) @ w[:-1] + w[-1]
    weight = np.where(y == 1, toxic_share / len(toxic), (1 - toxic_share) / len(ordinary))
    order = np.argsort(-logits, kind="stable")
    hit, miss = np.cumsum((weight * y)[order]), np.cumsum((weight * (1 - y))[order])
    f1 = 2 * hit / (hit + miss + toxic_share)
    last = np.append(np.diff(logits[order]) < 0, True)  # a threshold lies between two different logits
    best = int(np.argmax(np.where(last, f1, -1)))
    cut = logits[order][best] if best + 1 == len(order) else logits[order][best : best + 2].mean()
    bias = float(w[-1] - (w[:-1] / scale) @ mean - cut + np.log(PREDICT_AT / (1 - PREDICT_AT)))
    return Model(train_dictionaries(toxic, ordinary), tuple((w[:-1] / scale).tolist()), bias)


def train(docs: DataFrame, labels: DataFrame, trains=None, toxic_rows: int = 1000, ordinary_rows: int = 3000, longest: int = 50_000) -> Model:
    """A model from a bounded sample of the labelled rows; ``trains`` (all) is a condition on doc_id."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("doc_id is not null and toxic is not null").where(trains if trains is not None else F.lit(True))
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    share = known.agg(F.avg(F.col("toxic").cast("double"))).first()[0]
    texts: dict[int, list[str]] = {1: [], 0: []}
    if share is not None:
        order = [F.xxhash64("doc_id"), F.col("doc_id")]
        sample = known.where("toxic = 1").orderBy(*order).limit(toxic_rows).unionByName(known.where("toxic = 0").orderBy(*order).limit(ordinary_rows))
        found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).where(F.char_length("text").between(1, longest)).join(F.broadcast(sample), "doc_id")
        best = found.groupBy("doc_id").agg(F.first("toxic").alias("toxic"), F.max("text").alias("text")).orderBy(*order)
        for label, text in best.select("toxic", "text").collect():
            texts[min(1, max(0, label))].append(text)
    return fit(texts[1], texts[0], share or 0.0)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score, predicted of every row."""

    def run(batches):
        scorer = model.scorer()
        for b in batches:
            scores = [scorer(t) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(scores, pa.float64()), pa.array([int(s >= PREDICT_AT) for s in scores], pa.int32())], names=["doc_id", "score", "predicted"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    return map_arrow(rows, run, "doc_id long, score double, predicted int")


def keep_ordinary(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs`` that aren't predicted toxic, with their columns. Texts don't move."""
    text = docs.columns.index("text")

    def run(batches):
        scorer = model.scorer()
        for b in batches:
            yield b.filter(pa.array([scorer(t or "") < PREDICT_AT for t in b.column(text).to_pylist()], pa.bool_()))

    return map_arrow(docs, run, docs.schema)

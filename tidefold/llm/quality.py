"""Quality rules: fixed base rules, then a hashed word and character n-gram logistic regression.

The model is fitted on labelled rows: at most `max_labelled` of those that are both in the labels and in
the documents, half of them from each class as far as there are so many, those with the least hashes.
Its probabilities are calibrated on a held-out fifth of each class (Platt scaling, then moved to the shares
that the classes have of all labelled documents), and every document is scored
in Arrow batches against a fixed threshold. Only the weight vector, of a fixed size, goes to
the executors; texts are never shuffled, but for the labelled sample.

Defined results: null text counts as empty, so it has no words and fails the base rules; rows with
a null or repeated doc_id are judged like any other row; labels that are null or contradict each
other for one doc_id are not used, and labelled rows that repeat both doc_id and text count once. A
class with fewer than five labelled rows holds none out, and the calibration then uses the training
rows of both classes. There is no model without labelled rows of both classes: it accepts every text
(probability 1). Extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textvec as tv
from .common import cut, map_arrow

SYMBOLS = np.zeros(256, bool)
SYMBOLS[[ord(c) for c in "#*$%&|<>"]] = True
WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30

RESULT = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, "
    "n_repeat_words long, base_failed boolean, kept boolean, quality double"
)


@dataclass
class Model:
    """weights: words' n-grams in the lower half, characters' in the upper half of the buckets."""

    weights: np.ndarray
    bias: float
    slope: float
    shift: float
    threshold: float
    fitted: bool

    def probability(self, margins: np.ndarray) -> np.ndarray:
        if not self.fitted:
            return np.ones(len(margins))
        return 1 / (1 + np.exp(-np.clip(self.slope * margins + self.shift, -500, 500)))


def _characters(s: tv.Slice) -> tuple[np.ndarray, np.ndarray]:
    """A number for each character of a slice (its UTF-8 bytes), and the texts' bounds in characters."""
    d = s.data.astype(np.uint32)
    follows = (s.data & 0xC0) == 0x80
    if not follows.any():
        return d, s.bounds
    leads = np.flatnonzero(~follows)
    ends = np.append(leads[1:], len(d))
    out = d[leads]
    for k in (1, 2, 3):
        more = np.flatnonzero(leads + k < ends)
        out[more] |= d[leads[more] + k] << np.uint32(8 * k)
    return out, np.searchsorted(leads, s.bounds)


def _grams(s: tv.Slice, w: tv.Words, h: np.ndarray, bits: int):
    """Bucket arrays with each text's range in them: word 1- and 2-grams, character 4-grams."""
    half = np.uint64(64 - (bits - 1))
    one = (tv.mix(h + np.uint64(1)) >> half).astype(np.int32)
    two = (tv.mix(h[:-1] * np.uint64(0x9FB21C651E98DF25) + h[1:]) >> half).astype(np.int32)
    c, bounds = _characters(s)
    if len(c) >= 4:
        four = c[:-3] * np.uint32(0x9E3779B1) + c[1:-2] * np.uint32(0x85EBCA77) + c[2:-1] * np.uint32(0xC2B2AE3D) + c[3:] * np.uint32(0x27D4EB2F)
        four ^= four >> np.uint32(15)
        four *= np.uint32(0x85EBCA6B)
        chars = (four >> np.uint32(32 - (bits - 1))).astype(np.int32) + (1 << (bits - 1))
    else:
        chars = np.zeros(0, np.int32)
    yield one, w.first[:-1], w.first[1:]
    yield two, w.first[:-1], w.first[1:] - 1
    yield chars, bounds[:-1], bounds[1:] - 3


def _margins(s: tv.Slice, w: tv.Words, h: np.ndarray, model: Model, bits: int) -> np.ndarray:
    out = np.full(s.n, model.bias)
    for buckets, first, until in _grams(s, w, h, bits):
        n = np.maximum(until - first, 1)
        out += tv.range_sums(model.weights[buckets], first, until) / n
    return out


def repeated_words(text: str) -> int:
    """Words that lie in an 8-word window found twice or more in the text (exact)."""
    ws = [x for x in _SPLIT(text) if x]
    seen: dict[tuple, int] = {}
    covered = bytearray(len(ws))
    for i in range(len(ws) - WINDOW + 1):
        key = tuple(ws[i : i + WINDOW])
        j = seen.setdefault(key, i)
        if j != i:
            covered[i : i + WINDOW] = covered[j : j + WINDOW] = b"\x01" * WINDOW
    return sum(covered)


def duplicate_lines(text: str) -> int:
    """Lines with a word that equal an earlier line."""
    lines = text.split("\n")
    if len(set(lines)) == len(lines):
        return 0
    seen: set[str] = set()
    n = 0
    for line in lines:
        if line in seen:
            n += any(_SPLIT(line))
        seen.add(line)
    return n


_SEPARATORS = dict.fromkeys(range(0x09, 0x0E), " ")


def _SPLIT(text: str) -> list[str]:
    return text.translate(_SEPARATORS).split(" ")


def base_counts(texts: pa.Array, s: tv.Slice, w: tv.Words, h: np.ndarray) -> dict[str, np.ndarray]:
    leads = (s.data & 0xC0) != 0x80
    within = np.zeros(len(s.data) + 1, np.int8)
    within[w.starts] += 1
    within[w.ends] -= 1
    inside = np.cumsum(within[:-1], dtype=np.int8).astype(bool)
    win, at = tv.windows(h, w.first, WINDOW)
    text_of = np.searchsorted(w.first, at, "right") - 1
    key = tv.mix(win + text_of.astype(np.uint64) * np.uint64(0xA0761D6478BD642F))
    order = np.sort(key)
    twice = np.unique(order[1:][order[1:] == order[:-1]])
    suspects = np.unique(text_of[np.isin(key, twice)]) if len(twice) else []
    repeat = np.zeros(s.n, np.int64)
    for i in suspects:  # the hashes only name candidates
        repeat[i] = repeated_words(texts[s.first + int(i)].as_py() or "")
    lines = [duplicate_lines(t or "") for t in texts.slice(s.first, s.n).to_pylist()]
    return {
        "n_words": w.counts.astype(np.int64),
        "word_chars": tv.range_sums(leads & inside, s.bounds[:-1], s.bounds[1:]).astype(np.int64),
        "n_symbols": tv.range_sums(SYMBOLS[s.data], s.bounds[:-1], s.bounds[1:]).astype(np.int64),
        "n_dup_lines": np.array(lines, np.int64),
        "n_repeat_words": repeat,
    }


def _features(batch: pa.RecordBatch, bits: int) -> pa.RecordBatch:
    """Sparse features of labelled texts: bucket ids and mean counts."""
    ids, values = [], []
    for s in tv.slices(batch.column("text")):
        w = tv.words(s)
        h = tv.hash_spans(s.data, w.starts, w.ends)
        parts = list(_grams(s, w, h, bits))
        for i in range(s.n):
            found, share = [], []
            for buckets, first, until in parts:
                own = buckets[first[i] : max(first[i], until[i])]
                if len(own):
                    b, n = np.unique(own, return_counts=True)
                    found.append(b)
                    share.append(n / len(own))
            ids.append(np.concatenate(found or [np.zeros(0)]).astype(np.int32).tobytes())
            values.append(np.concatenate(share or [np.zeros(0)]).astype(np.float32).tobytes())
    return pa.RecordBatch.from_arrays(
        [batch.column("quality"), batch.column("h"), pa.array(ids, pa.binary()), pa.array(values, pa.binary())],
        ["quality", "h", "ids", "shares"],
    )


def _logistic(rows: list, y: np.ndarray, size: int, epochs: int, l2: float):
    """Adagrad on full batches; rows hold (bucket ids, values)."""
    lengths = np.array([len(i) for i, _ in rows])
    ids = np.concatenate([i for i, _ in rows])
    val = np.concatenate([v for _, v in rows]).astype(np.float64)
    row = np.repeat(np.arange(len(rows)), lengths)
    w, b = np.zeros(size), 0.0
    gw, gb = np.full(size, 1e-10), 1e-10
    for _ in range(epochs):
        z = np.bincount(row, val * w[ids], len(rows)) + b
        err = (1 / (1 + np.exp(-np.clip(z, -500, 500))) - y) / len(rows)
        g = np.bincount(ids, val * err[row], size) + l2 * w
        gw += g * g
        gb += err.sum() ** 2
        w -= 0.5 * g / np.sqrt(gw)
        b -= 0.1 * err.sum() / np.sqrt(gb)
    return w, b


def _platt(margin: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift that map margins to probabilities, with Platt's smoothed targets."""
    pos, neg = y.sum(), len(y) - y.sum()
    t = np.where(y == 1, (pos + 1) / (pos + 2), 1 / (neg + 2))
    scale = margin.std() or 1.0
    m = margin / scale
    a, b = 1.0, 0.0
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(a * m + b, -500, 500)))
        v = p * (1 - p) + 1e-12
        g = np.array([((p - t) * m).sum(), (p - t).sum()])
        hess = np.array([[(v * m * m).sum() + 1e-6, (v * m).sum()], [(v * m).sum(), v.sum() + 1e-6]])
        step = np.linalg.solve(hess, g)
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-9:
            break
    return max(a, 1e-6) / scale, b


def labelled_sample(documents: DataFrame, labels: DataFrame, max_labelled: int) -> tuple[DataFrame, dict[int, int]]:
    """text, quality, h of at most max_labelled labelled documents, see the module; and the numbers of
    all labelled documents by class."""
    clear = (
        labels.where("doc_id is not null and quality is not null")
        .groupBy("doc_id")
        .agg(F.min("quality").alias("quality"), F.max("quality").alias("other"))
        .where("quality = other")
        .select("doc_id", (F.col("quality") > 0).cast("int").alias("quality"))
    )
    docs = documents.where("text is not null").select("doc_id", "text", F.xxhash64("text").alias("th"))
    found = cut(docs.select("doc_id", "th").join(clear, "doc_id").distinct().withColumn("h", F.xxhash64("doc_id", "th")), "labelled")
    n = {q: 0 for q in (0, 1)} | {r.quality: r["count"] for r in found.groupBy("quality").count().collect()}
    half = max_labelled // 2
    least = lambda q: found.where(F.col("quality") == q).orderBy("h", "doc_id").limit(max(half, max_labelled - n[1 - q]))
    chosen = least(0).union(least(1)).limit(max_labelled)
    # bounded by max_labelled rows of four numbers, so it can be broadcast; repeated rows count once
    return docs.join(F.broadcast(chosen), ["doc_id", "th"]).dropDuplicates(["doc_id", "th"]).select("text", "quality", "h"), n


def fit(
    documents: DataFrame,
    labels: DataFrame,
    max_labelled: int = 2000,
    bits: int = 16,
    threshold: float = 0.5,
    epochs: int = 60,
) -> Model:
    """Fit on at most `max_labelled` labelled documents; a fifth of each class is held out for
    calibration."""
    size = 1 << bits
    sample, found = labelled_sample(documents, labels, max_labelled)
    got = map_arrow(sample, lambda b: _features(b, bits), "quality int, h long, ids binary, shares binary").collect()
    got.sort(key=lambda r: (r.h, bytes(r.ids)))
    y = np.array([float(r.quality) for r in got])
    if len(set(y)) < 2:
        return Model(np.zeros(size, np.float32), 0.0, 1.0, 0.0, threshold, False)
    held = np.zeros(len(y), bool)
    for q in (0, 1):
        held[np.flatnonzero(y == q)[4::5]] = True
    rows = [(np.frombuffer(r.ids, np.int32), np.frombuffer(r.shares, np.float32)) for r in got]
    train = np.flatnonzero(~held)
    if len(set(y[held])) < 2:
        held = ~held
    w, b = _logistic([rows[i] for i in train], y[train], size, epochs, 1e-7)
    margin = np.array([float(w[rows[i][0]] @ rows[i][1]) + b for i in np.flatnonzero(held)])
    slope, shift = _platt(margin, y[held])
    shift += np.log((found[1] / (y == 1).sum()) / (found[0] / (y == 0).sum()))  # the classes' own shares, not the sample's
    return Model(w.astype(np.float32), b, slope, shift, threshold, True)


def _verdicts(texts: pa.Array, model: Model, bits: int) -> dict[str, np.ndarray]:
    """The columns of RESULT after doc_id, in order."""
    parts: list[dict[str, np.ndarray]] = []
    for s in tv.slices(texts):
        w = tv.words(s)
        h = tv.hash_spans(s.data, w.starts, w.ends)
        c = base_counts(texts, s, w, h)
        c["base_failed"] = (c["n_words"] < MIN_WORDS) | (
            100 * c["n_repeat_words"] > MAX_REPEAT_PERCENT * c["n_words"]
        )
        quality = model.probability(_margins(s, w, h, model, bits))
        c["kept"] = ~c["base_failed"] & (quality >= model.threshold)
        c["quality"] = quality
        parts.append(c)
    return {k: np.concatenate([p[k] for p in parts]) for k in parts[0]}


def judge(documents: DataFrame, model: Model) -> DataFrame:
    """Base counts, base verdict, calibrated probability and final verdict of every document."""
    bits = int(len(model.weights)).bit_length() - 1

    def score(batch: pa.RecordBatch) -> pa.RecordBatch:
        got = _verdicts(batch.column("text"), model, bits)
        return pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), *map(pa.array, got.values())], ["doc_id", *got]
        )

    picked = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return map_arrow(picked, score, RESULT)


def filter_documents(documents: DataFrame, model: Model) -> DataFrame:
    """The rows of documents, all columns, that the rules and the model keep."""
    return documents.where(judge_column(model)("text"))


def judge_column(model: Model):
    """A vectorised predicate on text with the verdict of `judge`, for filtering whole rows."""
    bits = int(len(model.weights)).bit_length() - 1

    @F.arrow_udf("boolean")
    def kept(text: pa.Array) -> pa.Array:
        return pa.array(_verdicts(text, model, bits)["kept"] if len(text) else [], pa.bool_())

    return kept

"""Quality classifier: a linear support vector model over Naive Bayes scaled n-gram indicators."""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitalspark.llm.common import (
    SPACES, blocks, body, hashed_sample, map_arrow, prefix_hash, remainder, span_hash, spans, utf8,
)
from vitalspark.llm.words import forget

#: Hashed features; each n-gram sets one of them.
FEATURES = 1 << 16
ORDERS = (1, 2, 3)
#: Word n-grams of up to nine words enter by their pattern of repeated neighbours.
PATTERNS = range(1, 9)
#: Rows whose flags are held at once.
ROWS = 64


def indicators(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Row by feature flags of a block: does the text hold an n-gram of that feature?"""
    n = len(offsets) - 1
    flags = np.zeros((n, FEATURES), bool)
    rows = np.repeat(np.arange(n), np.diff(offsets))
    ends = np.repeat(offsets[1:], np.diff(offsets))
    for k in ORDERS:
        m = len(data) - k + 1
        if m <= 0:
            continue
        h = np.full(m, k * 0x9E3779B1 & 0xFFFFFFFF, np.uint32)
        for j in range(k):
            h = (h ^ data[j:m + j]) * np.uint32(0x01000193)
            h ^= h >> np.uint32(15)
        at = np.flatnonzero(np.arange(m) + k <= ends[:m])
        flags.reshape(-1)[rows[at] * FEATURES + (h[at] & np.uint32(FEATURES - 1))] = True
    _set_patterns(flags, data, offsets)
    return flags


def _set_patterns(flags: np.ndarray, data: np.ndarray, offsets: np.ndarray) -> None:
    """Word n-grams, each word told only as equal or unequal to the one before."""
    starts, ends = spans(~SPACES[data], offsets)
    bounds = np.searchsorted(starts, offsets)
    words = span_hash(prefix_hash(data), starts, ends)
    same = np.zeros(len(words), np.int64)
    same[1:] = words[1:] == words[:-1]
    row = np.repeat(np.arange(len(flags)), np.diff(bounds))
    place = np.arange(len(words)) - np.repeat(bounds[:-1], np.diff(bounds))
    code = np.zeros(len(words), np.int64)
    for m in PATTERNS:
        code[m:] = (code[m - 1:-1] << 1 | same[m:]) if len(words) > m else code[m:]
        at = np.flatnonzero(place >= m)
        h = (code[at] + (1 << m)) * 40503 & FEATURES - 1
        flags[row[at], h] = True


@dataclass(frozen=True)
class Model:
    """``weights`` already hold the log-count ratios; rows are scaled to unit length by ``ratio``."""

    ratio: np.ndarray
    weights: np.ndarray
    bias: float
    slope: float
    shift: float

    def margins(self, flags: np.ndarray) -> np.ndarray:
        f = flags.astype(np.float32)
        length = np.sqrt(np.maximum(f @ (self.ratio ** 2), 1e-12))
        return (f @ self.weights) / length + self.bias

    def scores(self, flags: np.ndarray) -> np.ndarray:
        z = self.slope * self.margins(flags).astype(np.float64) + self.shift
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def log_count_ratio(rows: list[np.ndarray], good: np.ndarray, smooth: float = 1.0) -> np.ndarray:
    p, q = np.full(FEATURES, smooth), np.full(FEATURES, smooth)
    for r, g in zip(rows, good, strict=True):
        (p if g else q)[r] += 1
    return np.log(p / (good.sum() + 2 * smooth)) - np.log(q / ((~good).sum() + 2 * smooth))


def fit_svm(rows: list[np.ndarray], ratio: np.ndarray, good: np.ndarray, cost: float = 4.0,
            epochs: int = 12, seed: int = 7) -> tuple[np.ndarray, float]:
    """Hinge loss by dual coordinate descent; the rarer class costs more in proportion."""
    y = np.where(good, 1.0, -1.0)
    cap = np.where(good, len(y) / (2 * max(good.sum(), 1)), len(y) / (2 * max((~good).sum(), 1)))
    cap = cost * cap
    values = [ratio[r] / max(np.sqrt((ratio[r] ** 2).sum()), 1e-6) for r in rows]
    w, bias, alpha = np.zeros(FEATURES), 0.0, np.zeros(len(y))
    square = np.array([(v ** 2).sum() + 1.0 for v in values])
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        moved = 0.0
        for i in rng.permutation(len(y)):
            gradient = y[i] * (w[rows[i]] @ values[i] + bias) - 1
            new = min(max(alpha[i] - gradient / square[i], 0.0), cap[i])
            if new != alpha[i]:
                step = (new - alpha[i]) * y[i]
                w[rows[i]] += step * values[i]
                bias += step
                moved = max(moved, abs(new - alpha[i]))
                alpha[i] = new
        if moved < 1e-3:
            break
    return w, bias


def fit_sigmoid(margin: np.ndarray, good: np.ndarray) -> tuple[float, float]:
    """Slope and shift of the logistic curve through held-back margins, by Newton steps."""
    target = np.where(good, (good.sum() + 1) / (good.sum() + 2), 1 / ((~good).sum() + 2))
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * margin + b, -30, 30)))
        d, s = p - target, np.maximum(p * (1 - p), 1e-9)
        g = np.array([(d * margin).sum() + 1e-3 * (a - 1), d.sum()])
        h = np.array([[(s * margin ** 2).sum() + 1e-3, (s * margin).sum()],
                      [(s * margin).sum(), s.sum() + 1e-9]])
        step = np.linalg.solve(h, g)
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-8:
            break
    return max(float(a), 1e-3), float(b)


def fit(rows: list[np.ndarray], good: np.ndarray) -> Model | None:
    """None without rows of both classes. A fifth of the rows is held back for the curve."""
    if not 0 < good.sum() < len(good):
        return None
    back = np.arange(len(good)) % 5 == 4
    if not 0 < good[~back].sum() < (~back).sum() or not 0 < good[back].sum() < back.sum():
        back[:] = False
    kept = [r for r, out in zip(rows, back, strict=True) if not out]
    ratio = log_count_ratio(kept, good[~back])
    w, bias = fit_svm(kept, ratio, good[~back])
    model = Model(ratio.astype(np.float32), (w * ratio).astype(np.float32), bias, 1.0, 0.0)
    held = [r for r, out in zip(rows, back, strict=True) if out] or rows
    margin = np.array([model.weights[r].sum() / max(np.sqrt((ratio[r] ** 2).sum()), 1e-6) + bias
                       for r in held])
    slope, shift = fit_sigmoid(margin, good[back] if back.any() else good)
    return Model(model.ratio, model.weights, bias, slope, shift)


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = 10_000) -> Model | None:
    """Fit on at most ``sample_rows`` labelled documents that are not held out.

    They are the rows of ``labels`` with the smallest hash of their id, so the sample's size is
    bounded and it may be broadcast (ids are expected unique). Of several labels of an id the lowest counts; null labels
    and null ids take no part.
    """
    known = (labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), "quality").dropna()
             .filter(remainder(F.col("doc_id"), 5) != 0)
             .groupBy("doc_id").agg(F.min("quality").alias("quality")))
    sample = hashed_sample(known, "doc_id", sample_rows)
    picked = body(docs).join(F.broadcast(sample), "doc_id")

    def features(batch: pa.RecordBatch):
        data, offsets = utf8(batch.column("text"))
        for lo, hi in blocks(offsets, rows=ROWS):
            flags = indicators(data[offsets[lo]:offsets[hi]], offsets[lo:hi + 1] - offsets[lo])
            found = [np.flatnonzero(f).astype(np.uint16).tobytes() for f in flags]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id")[lo:hi], batch.column("quality")[lo:hi].cast(pa.int32()),
                 pa.array(found, pa.binary())], ["doc_id", "quality", "features"])

    rows = (map_arrow(picked.select("doc_id", F.col("quality").cast("int").alias("quality"), "text"),
                      features, "doc_id long, quality int, features binary")
            .collect())
    rows.sort(key=lambda r: (zlib.crc32(str(r.doc_id).encode()), r.doc_id, r.features))
    return fit([np.frombuffer(r.features, np.uint16).astype(np.int64) for r in rows],
               np.array([r.quality == 1 for r in rows], bool))


def quality_scores(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """One row per document: ``doc_id, held_out, score, predicted``, from its whole text alone.

    An empty or null text gets the score of a text without n-grams. Without labels of both
    kinds every score is 0.5.
    """
    model = train(docs, labels)

    def score(batch: pa.RecordBatch):
        data, offsets = utf8(batch.column("text"))
        for lo, hi in blocks(offsets, rows=ROWS):
            flags = indicators(data[offsets[lo]:offsets[hi]], offsets[lo:hi + 1] - offsets[lo])
            scores = np.full(hi - lo, 0.5) if model is None else model.scores(flags)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id")[lo:hi], pa.array(scores)], ["doc_id", "score"])

    return map_arrow(body(docs), score, "doc_id long, score double").select(
        "doc_id", (remainder(F.col("doc_id"), 5) == 0).alias("held_out"), "score",
        F.when(F.col("score") >= threshold, 1).otherwise(0).alias("predicted"))


def good_documents(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """The rows of ``docs`` that score at least ``threshold``, all columns as they are."""
    model = train(docs, labels)
    if model is None:
        return docs

    def keep(batch: pa.RecordBatch):
        data, offsets = utf8(batch.column(batch.num_columns - 1))
        rows = batch.select(range(batch.num_columns - 1))
        for lo, hi in blocks(offsets, rows=ROWS):
            flags = indicators(data[offsets[lo]:offsets[hi]], offsets[lo:hi + 1] - offsets[lo])
            yield rows[lo:hi].filter(pa.array(model.scores(flags) >= threshold))

    def run(batches):
        forget()  # a worker may have packed texts before
        for batch in batches:
            yield from keep(batch)

    whole = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select("*", whole.alias("whole_text")).mapInArrow(run, docs.schema)

"""Quality rules: a decision list learned by sequential covering, run as Spark conditions."""

from __future__ import annotations

import operator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitalspark.llm.common import (
    SPACES, blocks, body, hashed_sample, map_arrow, mix, per_row, prefix_hash, saved, span_hash, spans, utf8,
    windows,
)

#: Characters that count as symbols.
SYMBOLS = np.isin(np.arange(256), np.frombuffer(b"#*$%&|<>", np.uint8))
UPPER = (np.arange(256) >= 65) & (np.arange(256) <= 90)
MARKS = np.isin(np.arange(256), np.frombuffer(b"!?.,;:", np.uint8))

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines",
          "n_upper", "n_marks")
#: Ratios that the learned conditions test; the divisors are at least 1.
RATIOS = {
    "symbols_per_word": ("n_symbols", "n_words"),
    "chars_per_word": ("word_chars", "n_words"),
    "repeats_per_word": ("n_repeat_words", "n_words"),
    "dup_lines_per_line": ("n_dup_lines", "n_lines"),
    "upper_per_char": ("n_upper", "word_chars"),
    "marks_per_word": ("n_marks", "n_words"),
    "words_per_line": ("n_words", "n_lines"),
}


def _repeated(keys: np.ndarray) -> np.ndarray:
    """Which keys occur twice or more."""
    order = np.argsort(keys, kind="stable")
    same = keys[order][1:] == keys[order][:-1]
    out = np.zeros(len(keys), bool)
    out[order[1:][same]] = True
    out[order[:-1][same]] = True
    return out


def count_block(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """The counts of each row of a block."""
    rows = np.arange(len(offsets) - 1, dtype=np.uint64)
    inside = ~SPACES[data]
    starts, ends = spans(inside, offsets)
    bounds = np.searchsorted(starts, offsets)
    sums = prefix_hash(data)
    word_hash = span_hash(sums, starts, ends)
    h, first = windows(word_hash, bounds, 3)
    row_of = np.repeat(rows, np.diff(bounds))
    salt = mix(rows * np.uint64(0x9E3779B97F4A7C15) + np.uint64(7))
    again = first[_repeated(h ^ salt[row_of[first].astype(np.int64)])] if len(h) else first
    marked = np.zeros(len(starts), bool)
    for j in range(3):
        marked[again + j] = True

    line_starts, line_ends = spans(data != 10, offsets)
    line_row = np.searchsorted(offsets, line_starts, "right") - 1
    words_before = np.zeros(len(data) + 1, np.int64)
    np.cumsum(inside, out=words_before[1:])
    worded = words_before[line_ends] > words_before[line_starts]
    line_starts, line_ends, line_row = line_starts[worded], line_ends[worded], line_row[worded]
    keys = span_hash(sums, line_starts, line_ends) ^ salt[line_row]
    _, original = np.unique(keys, return_index=True)
    fresh = np.zeros(len(keys), bool)
    fresh[original] = True
    n = len(rows)
    lines = np.bincount(line_row, minlength=n)
    return {
        "n_words": np.diff(bounds), "word_chars": per_row(inside & (data & 0xC0 != 0x80), offsets),
        "n_symbols": per_row(SYMBOLS[data], offsets),
        "n_dup_lines": lines - np.bincount(line_row[fresh], minlength=n),
        "n_repeat_words": per_row(marked, bounds), "n_lines": lines,
        "n_upper": per_row(UPPER[data], offsets), "n_marks": per_row(MARKS[data], offsets),
    }


def text_counts(docs: DataFrame) -> DataFrame:
    """``doc_id`` and the counts of each whole text; a null or empty text has zeros."""

    def count(batch: pa.RecordBatch):
        data, offsets = utf8(batch.column("text"))
        for lo, hi in blocks(offsets):
            part = data[offsets[lo]:offsets[hi]]
            found = count_block(part, offsets[lo:hi + 1] - offsets[lo])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id")[lo:hi],
                 *[pa.array(found[c].astype(np.int64)) for c in COUNTS]], ["doc_id", *COUNTS])

    return map_arrow(body(docs), count,
                     "doc_id long, " + ", ".join(f"{c} long" for c in COUNTS))


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def test(self, table: dict[str, np.ndarray]) -> np.ndarray:
        values = table[self.feature]
        return values >= self.threshold if self.above else values < self.threshold

    def column(self) -> Column:
        ratio = F.col(RATIOS[self.feature][0]) / F.greatest(F.col(RATIOS[self.feature][1]), F.lit(1))
        return ratio >= F.lit(self.threshold) if self.above else ratio < F.lit(self.threshold)


Rule = tuple[Condition, ...]


def covered(rule: Rule, table: dict[str, np.ndarray], n: int) -> np.ndarray:
    return reduce(operator.and_, (c.test(table) for c in rule), np.ones(n, bool))


def _best_condition(table, bad, at, weight):
    """The threshold with the highest information gain among rows ``at``."""
    p0, n0 = (bad & at).sum(), (~bad & at).sum()
    old = np.log2((p0 + 1e-9) / (p0 + n0 + 1e-9))
    best = (0.0, None)
    for feature, values in table.items():
        v, b = values[at], bad[at]
        order = np.argsort(v, kind="stable")
        v, b = v[order], b[order]
        edge = np.flatnonzero(v[1:] > v[:-1]) + 1
        if not len(edge):
            continue
        below = np.concatenate([[0], np.cumsum(b)])[edge]
        for above in (True, False):
            p = p0 - below if above else below
            n = (len(v) - edge if above else edge) - p
            gain = p * (np.log2((p + 1e-9) / (p + n + 1e-9)) - old)
            k = int(np.argmax(gain))
            if gain[k] > best[0] + 1e-9:
                cut = float((v[edge[k]] + v[edge[k] - 1]) / 2)
                best = (float(gain[k]), Condition(feature, above, cut))
    return best[1]


def learn_list(table: dict[str, np.ndarray], bad: np.ndarray, in_prune: np.ndarray,
               max_rules: int = 24, max_conditions: int = 4,
               least_precision: float = 0.8) -> list[Rule]:
    """Grow a rule on one part, prune it on the other, drop what it covers, and go on.

    A rule is taken while at least ``least_precision`` of the rows it covers in the pruning
    part are bad. ``max_rules`` and ``max_conditions`` bound the size of the list.
    """
    n, left, rules = len(bad), np.ones(len(bad), bool), []
    while len(rules) < max_rules:
        grow, prune = left & ~in_prune, left & in_prune
        if (bad & grow).sum() < 2:
            break
        rule, at = (), grow.copy()
        while len(rule) < max_conditions and (~bad & at).any():
            found = _best_condition(table, bad, at, grow)
            if found is None:
                break
            rule, at = (*rule, found), at & found.test(table)

        def worth(r):
            c = covered(r, table, n) & prune
            p, q = (bad & c).sum(), (~bad & c).sum()
            return (p - q) / (p + q) if p + q else -1.0

        cuts = [rule[:k] for k in range(1, len(rule) + 1)]
        if not cuts:
            break
        rule = max(cuts, key=lambda r: (worth(r), -len(r)))
        if (worth(rule) + 1) / 2 < least_precision:
            break
        rules.append(rule)
        left &= ~covered(rule, table, n)
    return rules


def as_column(rules: list[Rule]) -> Column:
    """The ordered list as one conditional: the number of the first rule that holds, else 0."""
    out = F.lit(None).cast("int")
    for k, rule in reversed(list(enumerate(rules, 1))):
        out = F.when(reduce(operator.and_, (c.column() for c in rule)), F.lit(k)).otherwise(out)
    return F.coalesce(out, F.lit(0))


def quality_rules(docs: DataFrame, labels: DataFrame, sample_rows: int = 20_000) -> DataFrame:
    """One row per document: its counts, ``base_failed``, ``rule`` (0: none) and ``kept``.

    The list is learned from at most ``sample_rows`` labelled rows, those with the smallest
    hash of their id; counts and verdicts cover every row and whole texts. A null label, or a
    document without one, takes no part in learning; of several labels of an id the lowest
    counts. Without labels of both kinds the list is empty and only the base rule speaks. A
    null text has no words, so its base rule fails.
    """
    counts = saved(text_counts(docs), "rule-counts")
    marks = (labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), "quality")
             .dropna().groupBy("doc_id").agg(F.min("quality").alias("quality")))
    sample = hashed_sample(counts.join(marks, "doc_id"), "doc_id", sample_rows).toPandas()
    table = {name: sample[a].to_numpy() / np.maximum(sample[b].to_numpy(), 1)
             for name, (a, b) in RATIOS.items()}
    bad = (sample["quality"] == 0).to_numpy(dtype=bool)
    rules = learn_list(table, bad, np.arange(len(bad)) % 3 == 2) if 0 < bad.sum() < len(bad) else []
    base = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return (counts.withColumn("base_failed", base).withColumn("rule", as_column(rules))
            .withColumn("kept", ~F.col("base_failed") & (F.col("rule") == 0)))

"""Ranked lexical search by MaxScore with bounds of pairs of terms.

Documents lie in shards, each one row of arrays. An index of a block of queries holds, per
shard, the postings of their terms with exact impacts, the highest impact of each term, and for
chosen pairs of terms the documents that hold both with the highest joint impact. A search
leaves out documents whose terms can't add up to the best scores known so far; the bound of a
pair is often far below the sum of its terms' maxima.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vitalspark.llm.common import (
    LOWER, blocks, body, map_arrow, per_row, prefix_hash, saved, span_hash, spans, utf8,
)

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
#: Bytes of text in a shard; a longer text is a shard of its own.
SHARD_BYTES = 4 << 20
#: Queries and bytes of their terms that are searched at once.
BLOCK_ITEMS, BLOCK_TERMS = 4096, 4 << 20

INSIDE = np.zeros(256, bool)
INSIDE[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True

SHARD = "docs binary, lengths binary, terms binary, starts binary, at binary, tf binary"
INDEX = "docs binary, terms binary, starts binary, at binary, impact binary, pairs binary, pair_starts binary, pair_at binary, pair_max binary, probe_item array<int>, probe_score array<long>"
HITS = "item int, doc_id long, score long"


def each(batch: pa.RecordBatch) -> Iterator[dict]:
    """The rows of a batch, one at a time."""
    for k in range(batch.num_rows):
        yield {c: batch.column(c)[k].as_py() for c in batch.schema.names}


def lower_ascii(text: str) -> str:
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


@dataclass(frozen=True)
class Queries:
    """A block of queries: their ids, distinct terms, and each query's terms with repeats."""

    item_ids: list
    words: list[bytes]
    terms: list[np.ndarray]
    repeats: list[np.ndarray]

    @staticmethod
    def of(rows: list[tuple]) -> Queries:
        place: dict[bytes, int] = {}
        terms, repeats = [], []
        for _, found in rows:
            terms.append(np.array([place.setdefault(w, len(place)) for w in found], np.int64))
            repeats.append(np.array(list(found.values()), np.int64))
        return Queries([i for i, _ in rows], list(place), terms, repeats)


def query_blocks(items: DataFrame) -> Iterator[Queries]:
    """The queries, read row by row and handed on in blocks of bounded size."""
    held, size = [], 0
    for item_id, text in items.select("item_id", F.col("text").cast("string")).toLocalIterator():
        found = Counter(w.encode() for w in TERM.findall(lower_ascii(text or "")))
        if not found:
            continue
        held.append((item_id, found))
        size += sum(map(len, found))
        if len(held) >= BLOCK_ITEMS or size >= BLOCK_TERMS:
            yield Queries.of(held)
            held, size = [], 0
    if held:
        yield Queries.of(held)


class Vocabulary:
    """Finds a block's terms in text; hashes propose, bytes decide."""

    def __init__(self, words: list[bytes]):
        data = np.frombuffer(b"".join(words), np.uint8)
        ends = np.cumsum([len(w) for w in words], dtype=np.int64)
        starts = ends - np.array([len(w) for w in words], np.int64)
        self.data, self.starts, self.lengths = data, starts, ends - starts
        hashes = span_hash(prefix_hash(data), starts, ends)
        self.order = np.argsort(hashes, kind="stable")
        self.hashes = hashes[self.order]
        if len(np.unique(hashes)) < len(hashes):
            raise ValueError("two terms of a block share a hash")

    def find(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The number of the term at each span, -1 where it is none."""
        if not len(starts):
            return np.zeros(0, np.int64)
        h = span_hash(prefix_hash(data), starts, ends)
        slot = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        term = np.where(self.hashes[slot] == h, self.order[slot], -1)
        hit = np.flatnonzero(term >= 0)
        size = ends[hit] - starts[hit]
        hit = hit[same := size == self.lengths[term[hit]]]
        size = size[same]
        if len(hit):
            first = np.cumsum(size) - size
            inner = np.arange(size.sum()) - np.repeat(first, size)
            equal = data[np.repeat(starts[hit], size) + inner] == self.data[np.repeat(self.starts[term[hit]], size) + inner]
            hit = hit[np.logical_and.reduceat(equal, first)]
        out = np.full(len(starts), -1, np.int64)
        out[hit] = term[hit]
        return out


def binary(a: np.ndarray) -> bytes:
    return np.ascontiguousarray(a).tobytes()


def array(value: bytes, kind: str = "<i8") -> np.ndarray:
    return np.frombuffer(value, kind)


def shards(docs: DataFrame, words: list[bytes]) -> DataFrame:
    """One row a shard: ids and lengths of its documents, postings of ``words`` by term."""
    shared = docs.sparkSession.sparkContext.broadcast(words)

    def build(batch: pa.RecordBatch):
        vocabulary = _held(shared.value)
        ids = batch.column("doc_id")
        known = np.asarray(ids.is_valid())
        numbers = np.where(known, np.asarray(ids.fill_null(0)), np.iinfo(np.int64).max)
        data, offsets = utf8(batch.column("text"))
        for lo, hi in blocks(offsets, SHARD_BYTES):
            text, o = LOWER[data[offsets[lo]:offsets[hi]]], offsets[lo:hi + 1] - offsets[lo]
            starts, ends = spans(INSIDE[text], o)
            begins = np.zeros(len(text), np.int64)
            begins[starts] = 1
            lengths = per_row(begins, o)
            term = vocabulary.find(text, starts, ends)
            row = np.repeat(np.arange(hi - lo), lengths)
            key, tf = np.unique(term[term >= 0] * (hi - lo) + row[term >= 0], return_counts=True)
            terms, first = np.unique(key // (hi - lo), return_index=True)
            yield pa.RecordBatch.from_arrays([pa.array([binary(x)], pa.binary()) for x in (
                numbers[lo:hi], lengths, terms, np.append(first, len(key)), (key % (hi - lo)).astype("<i4"), tf)],
                ["docs", "lengths", "terms", "starts", "at", "tf"])

    return map_arrow(body(docs), build, SHARD)


_vocabularies: dict[int, Vocabulary] = {}


def _held(words: list[bytes]) -> Vocabulary:
    """The worker's vocabulary; one is held at a time."""
    key = hash(tuple(words))
    if key not in _vocabularies:
        _vocabularies.clear()
        _vocabularies[key] = Vocabulary(words)
    return _vocabularies[key]


def statistics(found: DataFrame, terms: int) -> tuple[int, int, np.ndarray]:
    """Documents with a term, all their terms, and the documents that hold each of the block's terms."""

    def count(batch: pa.RecordBatch):
        for row in each(batch):
            lengths = array(row["lengths"])
            term, df = array(row["terms"]), np.diff(array(row["starts"]))
            yield pa.RecordBatch.from_arrays(
                [pa.array([-1, -2, *term.tolist()], pa.int64()),
                 pa.array([int((lengths > 0).sum()), int(lengths.sum()), *df.tolist()], pa.int64())], ["term", "n"])

    sums = map_arrow(found.select("lengths", "terms", "starts"), count, "term long, n long").groupBy("term").agg(F.sum("n"))
    counted = dict(map(tuple, sums.collect()))  # one row a term of the block
    df = np.array([counted.get(t, 0) for t in range(terms)], np.int64)
    return counted.get(-1, 0), counted.get(-2, 0), df


def weights(n: int, df: np.ndarray) -> np.ndarray:
    return np.array([math.floor(1000 * math.log((2 * n + 2) / (2 * d + 1))) for d in df.tolist()], np.int64)


def pairs_of(queries: Queries, weight: np.ndarray) -> list[np.ndarray]:
    """Each query's terms two by two, in descending order of weight: rows of two places in the query."""
    out = []
    for terms in queries.terms:
        order = np.lexsort((terms, -weight[terms]))
        out.append(order[:len(order) // 2 * 2].reshape(-1, 2))
    return out


def pair_key(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.minimum(a, b) << 32 | np.maximum(a, b)


class Shard:
    """A shard's arrays with what a search asks of them."""

    def __init__(self, docs, terms, starts, at, impact):
        self.docs, self.terms, self.starts, self.at, self.impact = docs, terms, starts, at, impact

    def place(self, terms: np.ndarray) -> np.ndarray:
        """Where the terms' postings are, -1 where the shard has none."""
        if not len(self.terms):
            return np.full(len(terms), -1)
        slot = np.minimum(np.searchsorted(self.terms, terms), len(self.terms) - 1)
        return np.where(self.terms[slot] == terms, slot, -1)

    def postings(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        if k < 0:
            return self.at[:0], self.impact[:0]
        return self.at[self.starts[k]:self.starts[k + 1]], self.impact[self.starts[k]:self.starts[k + 1]]

    def whole_scores(self, places: np.ndarray, repeats: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """Full scores of the given rows, which are in ascending order."""
        score = np.zeros(len(rows), np.int64)
        for k, c in zip(places.tolist(), repeats.tolist(), strict=True):
            at, impact = self.postings(k)
            if len(at):
                slot = np.minimum(np.searchsorted(at, rows), len(at) - 1)
                hit = at[slot] == rows
                score[hit] += c * impact[slot[hit]]
        return score


def index(found: DataFrame, queries: Queries, n: int, total: int, weight: np.ndarray, top: int) -> DataFrame:
    """Shards with impacts, pair lists and, per query, the best scores among its rarest pairs' documents.

    The pairs are fixed by the weights alone, so they are the same in every shard.
    """
    pairs = pairs_of(queries, weight)
    chosen = np.unique(np.concatenate([pair_key(t[p[:, 0]], t[p[:, 1]]) for t, p in zip(queries.terms, pairs, strict=True)]))
    shared = found.sparkSession.sparkContext.broadcast((queries, pairs, chosen, n, total, weight))

    def build(batch: pa.RecordBatch):
        queries, pairs, chosen, n, total, weight = shared.value
        for row in each(batch):
            docs, lengths, terms, starts = (array(row[c]) for c in ("docs", "lengths", "terms", "starts"))
            at, tf = array(row["at"], "<i4"), array(row["tf"])
            m = 100 - 25 + (25 * lengths * n) // max(total, 1)
            impact = np.repeat(weight[terms], np.diff(starts)) * ((1_000_000_000 * tf) // (1000 * tf + 12 * m[at]))
            shard = Shard(docs, terms, starts, at, impact)
            first, second = shard.place(chosen >> 32), shard.place(chosen & 0xFFFFFFFF)
            ends, rows, best = [0], [], []
            for a, b in zip(first.tolist(), second.tolist(), strict=True):
                (x, i), (y, j) = shard.postings(a), shard.postings(b)
                both, u, v = np.intersect1d(x, y, assume_unique=True, return_indices=True)
                rows.append(both)
                ends.append(ends[-1] + len(both))
                best.append(int((i[u] + j[v]).max()) if len(both) else 0)
            ends, best = np.array(ends, np.int64), np.array(best, np.int64)
            pair_at = np.concatenate([*rows, at[:0]])
            item, score = [], []
            for q, (t, c, p) in enumerate(zip(queries.terms, queries.repeats, pairs, strict=True)):
                seen = np.searchsorted(chosen, pair_key(t[p[:, 0]], t[p[:, 1]]))
                some = probe_rows(pair_at, ends, seen, top)
                scores = shard.whole_scores(shard.place(t), c, some)
                scores = np.sort(scores[scores > 0])[::-1][:top]
                item += [q] * len(scores)
                score += scores.tolist()
            yield pa.RecordBatch.from_arrays([
                *[pa.array([binary(x)], pa.binary()) for x in (
                    docs, terms, starts, at, impact, chosen, ends, pair_at, best)],
                pa.array([item], pa.list_(pa.int32())), pa.array([score], pa.list_(pa.int64()))],
                INDEX_COLUMNS)

    return map_arrow(found, build, INDEX)


INDEX_COLUMNS = [c.split()[0] for c in INDEX.split(", ")]


def probe_rows(pair_at: np.ndarray, ends: np.ndarray, seen: np.ndarray, top: int) -> np.ndarray:
    """Documents of a query's pair lists, rarest terms first, until there are ``top`` of them."""
    some: list[np.ndarray] = []
    held = 0
    for k in seen.tolist():
        if held >= top:
            break
        if ends[k + 1] > ends[k]:
            some.append(pair_at[ends[k]:ends[k + 1]])
            held += int(ends[k + 1] - ends[k])
    return np.unique(np.concatenate([*some, pair_at[:0]]))


def thresholds(indexed: DataFrame, queries: Queries, top: int) -> np.ndarray:
    """Scores that ``top`` documents of the corpus reach, per query; 0 where fewer are known."""
    probed = indexed.select(F.explode(F.arrays_zip("probe_item", "probe_score")).alias("p")).select(
        F.col("p.probe_item").alias("item"), F.col("p.probe_score").alias("score"))
    place = F.row_number().over(Window.partitionBy("item").orderBy(F.col("score").desc()))
    last = probed.withColumn("_place", place).filter(F.col("_place") <= top).groupBy("item").agg(
        F.count(F.lit(1)), F.min("score"))
    out = np.zeros(len(queries.terms), np.int64)
    for item, held, least in last.collect():  # one row a query of the block
        if held == top:
            out[item] = least
    return out


def bounds(upper: np.ndarray, c: np.ndarray, pairs: np.ndarray, joint: np.ndarray,
           highest: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Groups of places in a query (pairs, then a single left over) by ascending bound, and the bounds.

    A document holds one term of a pair or both. With both it has the joint maximum for as many
    repeats as both terms have, and the rest at the single maximum.
    """
    a, b = pairs[:, 0], pairs[:, 1]
    both = np.minimum(c[a], c[b])
    met = np.where(joint > 0, both * joint + (c[a] - both) * highest[a] + (c[b] - both) * highest[b], 0)
    met = np.minimum(met, upper[a] + upper[b])
    bound = np.maximum(np.maximum(upper[a], upper[b]), met)
    single = np.setdiff1d(np.arange(len(upper)), pairs.ravel())
    groups = np.concatenate([pairs, np.stack([single, np.full(len(single), -1)], 1)]).astype(np.int64)
    bound = np.concatenate([bound, upper[single]])
    order = np.argsort(bound, kind="stable")
    return groups[order], bound[order]


def best_rows(shard: Shard, t: np.ndarray, c: np.ndarray, groups: np.ndarray, bound: np.ndarray,
              least: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of the shard that may reach ``least``, and their full scores.

    Groups whose bounds together stay below ``least`` add no documents of their own; they only
    raise documents of the others, and only while those can still get there.
    """
    places = shard.place(t)
    skipped = int(np.searchsorted(np.cumsum(bound), max(least, 1)))
    score = np.zeros(len(shard.docs), np.int64)
    for g in groups[skipped:].ravel().tolist():
        if g >= 0:
            at, impact = shard.postings(places[g])
            score[at] += c[g] * impact
    rest = np.cumsum(bound[:skipped])
    rows = np.flatnonzero(score > 0)
    for k in range(skipped - 1, -1, -1):
        rows = rows[score[rows] + rest[k] >= least]
        if not len(rows):
            break
        some = [int(g) for g in groups[k] if g >= 0]
        score[rows] += shard.whole_scores(places[some], c[some], rows)
    rows = rows[score[rows] >= max(least, 1)]
    return rows, score[rows]


def hits(indexed: DataFrame, queries: Queries, weight: np.ndarray, least: np.ndarray, top: int) -> DataFrame:
    """Each shard's best documents of every query."""
    shared = indexed.sparkSession.sparkContext.broadcast((queries, pairs_of(queries, weight), least))

    def search(batch: pa.RecordBatch):
        queries, pairs, least = shared.value
        for row in each(batch):
            docs, terms, starts, impact = (array(row[c]) for c in ("docs", "terms", "starts", "impact"))
            shard = Shard(docs, terms, starts, array(row["at"], "<i4"), impact)
            chosen, ends, best = (array(row[c]) for c in ("pairs", "pair_starts", "pair_max"))
            pair_at = array(row["pair_at"], "<i4")
            highest = np.maximum.reduceat(impact, starts[:-1]) if len(terms) else impact
            out = []
            for q, (t, c, p) in enumerate(zip(queries.terms, queries.repeats, pairs, strict=True)):
                places = shard.place(t)
                if (places < 0).all():
                    continue
                top_of = np.where(places < 0, 0, highest[places])
                seen = np.searchsorted(chosen, pair_key(t[p[:, 0]], t[p[:, 1]]))
                groups, bound = bounds(c * top_of, c, p, best[seen], top_of)
                bar = int(least[q])
                near = np.sort(shard.whole_scores(places, c, probe_rows(pair_at, ends, seen, top)))[::-1]
                if len(near) >= top:
                    bar = max(bar, int(near[top - 1]))
                rows, score = best_rows(shard, t, c, groups, bound, bar)
                first = np.lexsort((docs[rows], -score))[:top]
                out.append((np.full(len(first), q), docs[rows][first], score[first]))
            if out:
                item, doc, score = (np.concatenate(x) for x in zip(*out, strict=True))
                known = doc != np.iinfo(np.int64).max
                yield pa.RecordBatch.from_arrays(
                    [pa.array(item, pa.int32()), pa.array(doc, pa.int64(), mask=~known), pa.array(score, pa.int64())],
                    ["item", "doc_id", "score"])

    return map_arrow(indexed.select("docs", "terms", "starts", "at", "impact", "pairs", "pair_starts", "pair_at", "pair_max"),
                     search, HITS)


def ranked_search(docs: DataFrame, items: DataFrame, top: int = 20) -> DataFrame:
    """``item_id, rank, doc_id, score``: the ``top`` best documents of every item, scored as integers.

    Every row of ``items`` (item_id, text) is a query of its own, also one that repeats an id;
    without terms it finds nothing. Every row of ``docs`` counts as a document, repeated ones too; null
    texts hold no terms. Equal scores are ranked by ascending ``doc_id``, null last (the highest
    long counts as null). Other columns play no part. Items are searched in blocks of bounded size, each with one pass over
    the texts; what a task holds is one shard and one block.
    """
    spark = docs.sparkSession
    out = spark.createDataFrame([], "item_id string, rank int, doc_id long, score long")
    out = out.withColumn("item_id", F.col("item_id").cast(items.schema["item_id"].dataType))
    for queries in query_blocks(items):
        found = saved(shards(docs, queries.words), "search-shards")
        n, total, df = statistics(found, len(queries.words))
        weight = weights(n, df)
        indexed = saved(index(found, queries, n, total, weight, top), "search-index")
        least = thresholds(indexed, queries, top)
        best = hits(indexed, queries, weight, least, top)
        order = Window.partitionBy("item").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
        ranked = best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
        names = spark.createDataFrame(list(enumerate(queries.item_ids)), out.select(
            F.lit(0).cast("int").alias("item"), "item_id").schema)
        out = out.unionByName(ranked.join(names, "item").select("item_id", "rank", "doc_id", "score"))
    return out

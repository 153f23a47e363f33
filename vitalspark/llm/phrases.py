"""Collocations by Toivonen's method: a sample proposes phrases, full passes count them and their border.

A phrase can only be frequent if all shorter phrases inside it are. The phrases that a sample
proposes are counted over all documents together with their negative border: every phrase that
wasn't proposed though all phrases inside it were. If a phrase of the border turns out to be
frequent, longer ones may have been missed; it is then taken up and the border it opens is
counted in a further pass, until no new one is found.

Proposed phrases travel as a bit filter of fixed size. It may hold phrases by chance, which are
then counted too, so it costs time and never a result. Phrases that reach the least count by
hash are counted anew as strings, so equal hashes of different phrases do no harm.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vitalspark.llm.chunks import text_bytes
from vitalspark.llm.common import (
    LOWER, blocks, map_arrow, mix, prefix_hash, saved, span_hash, spans, utf8,
)

#: Two fields of so many bits of a phrase's hash are its places in a filter; a filter has 16 MB.
FIELD = 27
LOW = 10
#: Bytes of text that are counted together before anything leaves a task.
COUNT_BYTES = 2 << 20
#: Bytes of text per bucket of hashes; their sums take about three times as much memory.
BUCKET_BYTES = 4 << 20
#: Phrases that a task holds before it sends their counts.
HELD = 100_000

PIECE_END = np.zeros(256, bool)
PIECE_END[[*b".,;:!?\x0a\x0b\x0c\x0d"]] = True
INSIDE = ~PIECE_END
INSIDE[[0x20, 0x09]] = False


class BitFilter:
    """Bits by two fields of a hash. A field of the filter says where, the two low bits how many words."""

    def __init__(self, slots: np.ndarray | None = None, bits: np.ndarray | None = None):
        self.bits = np.zeros(1 << FIELD - 6, np.uint64)
        if slots is not None:
            self.bits[slots] = bits

    def holds(self, h: np.ndarray) -> np.ndarray:
        return self._bit(h >> np.uint64(64 - FIELD)) & self._bit(h >> np.uint64(LOW) & np.uint64((1 << FIELD) - 1))

    def _bit(self, at: np.ndarray) -> np.ndarray:
        return (self.bits[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63)) & np.uint64(1)).astype(bool)

    def joined(self, other: BitFilter) -> tuple[BitFilter, bool]:
        """Both filters in one, and whether the other brought anything new."""
        new = BitFilter()
        new.bits = self.bits | other.bits
        return new, bool((new.bits != self.bits).any())

    @staticmethod
    def of(rows: DataFrame, h: str = "h") -> BitFilter:
        """The filter of a frame's hashes; what reaches the driver has the filter's size at most."""
        at = F.explode(F.array(F.shiftrightunsigned(h, 64 - FIELD),
                               F.shiftrightunsigned(h, LOW).bitwiseAND(F.lit((1 << FIELD) - 1))))
        slots = rows.select(at.alias("at")).groupBy(F.shiftright("at", 6).alias("slot")).agg(
            F.bit_or(F.expr("shiftleft(1L, cast(at & 63 as int))")).alias("bits"))
        found = slots.toArrow()
        return BitFilter(np.asarray(found["slot"]), np.asarray(found["bits"]).view(np.uint64))


@dataclass
class Words:
    """The words of a block: dense numbers, each for one word of one language, and runs that are pieces."""

    number: np.ndarray
    hashes: np.ndarray  # by number
    spans: np.ndarray  # by number: start and end of one occurrence
    langs: np.ndarray  # by number
    bounds: np.ndarray  # by piece: its first word, and the end
    data: np.ndarray

    def runs(self, k: int) -> np.ndarray:
        """First words of the runs of ``k`` words within a piece."""
        n = len(self.number) - k + 1
        if n <= 0:
            return np.zeros(0, np.int64)
        last = np.repeat(self.bounds[1:], np.diff(self.bounds))[:n]
        return np.flatnonzero(np.arange(n) + k <= last)


def words_of(data: np.ndarray, offsets: np.ndarray, lang: np.ndarray) -> Words:
    """Words of texts, with a language number for each text. Words are told apart by their bytes."""
    data = LOWER[data]
    starts, ends = spans(INSIDE[data], offsets)
    # a piece ends at a mark and at the end of a text
    breaks = np.unique(np.concatenate([np.flatnonzero(PIECE_END[data]), offsets]))
    bounds = np.unique(np.concatenate([np.searchsorted(starts, breaks), [0, len(starts)]])).astype(np.int64)
    of_text = lang[np.searchsorted(offsets, starts, "right") - 1]
    h = span_hash(prefix_hash(data), starts, ends)
    number, first = _numbers(h, starts, ends, of_text, data)
    langs = of_text[first]
    return Words(number, h[first], np.stack([starts[first], ends[first]], 1), langs, bounds, data)


def _numbers(h, starts, ends, lang, data) -> tuple[np.ndarray, np.ndarray]:
    key = h + lang.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    _, first, number = np.unique(key, return_index=True, return_inverse=True)
    size = ends - starts
    like = first[number]
    same = (size == size[like]) & (lang == lang[like])
    # bytes of every word next to those of the word that stands for it
    some = np.flatnonzero(same & (like != np.arange(len(like))))
    for lo in range(0, len(some), 1 << 17):
        part = some[lo:lo + (1 << 17)]
        begin = np.cumsum(size[part]) - size[part]
        inner = np.arange(size[part].sum()) - np.repeat(begin, size[part])
        equal = data[np.repeat(starts[part], size[part]) + inner] == data[np.repeat(starts[like[part]], size[part]) + inner]
        same[part] = np.logical_and.reduceat(equal, begin)
    if not same.all():  # words that share a hash get numbers of their own
        own: dict[tuple, int] = {}
        extra = []
        for k in np.flatnonzero(~same).tolist():
            word = (int(lang[k]), data[starts[k]:ends[k]].tobytes())
            if word not in own:
                own[word] = len(first) + len(extra)
                extra.append(k)
            number[k] = own[word]
        first = np.concatenate([first, np.array(extra, np.int64)])
    return number, first


@dataclass
class Level:
    """Distinct phrases of one length in a block: the words of each, its hash, how often it occurs."""

    at: np.ndarray  # where the runs start, among the block's words
    number: np.ndarray  # by run
    words: np.ndarray  # by phrase, one row each
    hashes: np.ndarray
    counts: np.ndarray


def level(w: Words, k: int, at: np.ndarray, shorter: Level | None, lang_hash: np.ndarray) -> Level:
    """Phrases of ``k`` words that start at ``at``; ``shorter`` has runs at all these places."""
    if shorter is None:
        number, size = w.number[at], len(w.hashes)
        counts = np.bincount(number, minlength=size)
        words = np.arange(size)[:, None]
    else:
        before = shorter.number[np.searchsorted(shorter.at, at)]
        key = before * np.int64(len(w.hashes)) + w.number[at + k - 1]
        key, number, counts = np.unique(key, return_inverse=True, return_counts=True)
        words = np.concatenate([shorter.words[key // len(w.hashes)], (key % len(w.hashes))[:, None]], 1)
    return Level(at, number, words, phrase_hash(w, words, lang_hash), counts)


def phrase_hash(w: Words, words: np.ndarray, lang_hash: np.ndarray) -> np.ndarray:
    """Hashes of phrases of a language; the two low bits are the number of words."""
    h = lang_hash[w.langs[words[:, 0]]]
    for j in range(words.shape[1]):
        h = (h ^ w.hashes[words[:, j]]) * np.uint64(0x2545F4914F6CDD1D) + np.uint64(j + 1)
    return mix(h) & ~np.uint64(3) | np.uint64(words.shape[1])


def eligible(w: Words, shorter: Level, at: np.ndarray, known: BitFilter | None) -> np.ndarray:
    """Are both shorter phrases of the runs at ``at`` in the filter (no filter: among those counted)?"""
    ok = np.zeros(len(w.number) + 1, bool)
    ok[shorter.at] = True if known is None else known.holds(shorter.hashes)[shorter.number]
    return ok[at] & ok[at + 1]


def walk(w: Words, lang_hash: np.ndarray, longest: int, known: BitFilter | None,
         before: BitFilter | None, first: bool) -> Iterator[Level]:
    """The phrases of a block that a pass counts.

    With ``known`` these are the ones whose shorter phrases are all known; those for which
    that held ``before`` too were counted by an earlier pass. A filter may hold a phrase by chance that
    the earlier pass never met, so its shorter phrases must have been counted as well.
    """
    now = level(w, 1, np.arange(len(w.number)), None, lang_hash)
    done = np.ones(len(w.number) + 1, bool)  # by place: did the earlier pass count the run there?
    if first:
        yield now
    for k in range(2, longest + 1):
        at = w.runs(k)
        at = at[eligible(w, now, at, known)]
        then = level(w, k, at, now, lang_hash)
        if first:
            yield then
        elif len(at):
            counted = eligible(w, now, at, before) & done[at] & done[at + 1]
            done = np.zeros(len(w.number) + 1, bool)
            done[at[counted]] = True
            fresh = np.ones(len(then.counts), bool)
            fresh[then.number[counted]] = False
            yield Level(at, then.number, then.words[fresh], then.hashes[fresh], then.counts[fresh])
        now = then


def lines(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"),
                       F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def block_words(batch: pa.RecordBatch) -> Iterator[tuple[Words, list[str], np.ndarray]]:
    """Words of a batch block by block, its languages and their hashes."""
    coded = batch.column("lang").dictionary_encode()
    names = coded.dictionary.to_pylist()
    raw, o = utf8(coded.dictionary.cast(pa.string()))
    lang_hash = span_hash(prefix_hash(raw), o[:-1], o[1:])
    lang = np.asarray(coded.indices).astype(np.int64)
    data, offsets = utf8(batch.column("text"))
    for lo, hi in blocks(offsets, COUNT_BYTES):
        yield words_of(data[offsets[lo]:offsets[hi]], offsets[lo:hi + 1] - offsets[lo], lang[lo:hi]), names, lang_hash


def hash_counts(texts: DataFrame, buckets: int, longest: int, least: int, known: BitFilter | None = None,
                before: BitFilter | None = None, first: bool = True) -> DataFrame:
    """``h, a``: the phrases that a pass counts, by hash, which occur ``least`` times or more.

    Tasks send sums by block, as arrays dealt over ``buckets`` by hash: a phrase is one entry a
    block however frequent it is, so buckets are even, and each is summed by itself.
    """
    shared = texts.sparkSession.sparkContext.broadcast((known, before))

    def count(batch: pa.RecordBatch):
        known, before = shared.value
        for w, _, lang_hash in block_words(batch):
            for found in walk(w, lang_hash, longest, known, before, first):
                if not len(found.hashes):
                    continue
                bucket = (found.hashes >> np.uint64(2)) % np.uint64(buckets)
                order = np.argsort(bucket, kind="stable")
                h, a = found.hashes[order], found.counts[order].astype("<i4")
                used, start = np.unique(bucket[order], return_index=True)
                ends = np.append(start[1:], len(h))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(used.astype(np.int64)),
                     pa.array([h[i:j].tobytes() for i, j in zip(start, ends, strict=True)], pa.binary()),
                     pa.array([a[i:j].tobytes() for i, j in zip(start, ends, strict=True)], pa.binary())],
                    ["bucket", "h", "a"])

    def total(table: pa.Table) -> pa.Table:
        parts = [(np.frombuffer(x, np.uint64), np.frombuffer(y, "<i4"))
                 for x, y in zip(table["h"].to_pylist(), table["a"].to_pylist(), strict=True)]
        h, a = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.argsort(h)
        h, a = h[order], a[order].astype(np.int64)
        first = np.flatnonzero(np.append(True, h[1:] != h[:-1]))
        a = np.add.reduceat(a, first)
        keep = a >= least
        return pa.table({"h": h[first][keep].view(np.int64), "a": a[keep]})

    sent = map_arrow(texts, count, "bucket long, h binary, a binary")
    return sent.groupBy("bucket").applyInArrow(total, "h long, a long")


def word_count(h: str = "h") -> Column:
    return F.col(h).bitwiseAND(F.lit(3))


def frequent_hashes(texts: DataFrame, sample: DataFrame, longest: int, least: int, share: int) -> list[DataFrame]:
    """Hashes of all phrases that occur ``least`` times or more, from each pass; see the module's head."""
    buckets = max(1, -(-text_bytes(texts) // BUCKET_BYTES))
    known = BitFilter.of(hash_counts(sample, -(-buckets // share), longest - 1, max(2, least * 4 // (5 * share))))
    before, found = None, []
    while True:
        kept = saved(hash_counts(texts, buckets, longest, least, known, before, first=before is None), "phrases-counted")
        found.append(kept)
        # frequent phrases that were not known: the border has failed there
        wider, failed = known.joined(BitFilter.of(kept.filter(word_count() < longest)))
        if not failed:
            return found
        known, before = wider, known


def phrase_counts(texts: DataFrame, kept: BitFilter, longest: int) -> DataFrame:
    """``lang, phrase, words, a, n``: exact counts of the phrases in the filter; a row without a
    phrase has all words of a language as ``n``."""
    kept = texts.sparkSession.sparkContext.broadcast(kept)

    def count(batches):
        held: dict[tuple, int] = {}
        for batch in batches:
            for w, names, lang_hash in block_words(batch):
                total = np.bincount(w.langs[w.number], minlength=len(names))
                for k in np.flatnonzero(total).tolist():
                    held[names[k], None, 0] = held.get((names[k], None, 0), 0) + int(total[k])
                for found in walk(w, lang_hash, longest, kept.value, None, True):
                    take = np.flatnonzero(kept.value.holds(found.hashes))
                    for lo in range(0, len(take), HELD):
                        part = take[lo:lo + HELD]
                        words, n = found.words[part], found.words.shape[1]
                        for k, phrase, a in zip(w.langs[words[:, 0]].tolist(), spelled(w, words),
                                                found.counts[part].tolist(), strict=True):
                            key = (names[k], phrase, n)
                            held[key] = held.get(key, 0) + a
                        if len(held) >= HELD:
                            yield _rows(held)
                            held = {}
        if held:
            yield _rows(held)

    rows = texts.mapInArrow(count, "lang string, phrase string, words int, a long")
    return rows.groupBy("lang", "phrase", "words").agg(F.sum("a").alias("a"))


def _rows(held: dict[tuple, int]) -> pa.RecordBatch:
    lang, phrase, words = zip(*held, strict=True)
    return pa.RecordBatch.from_arrays(
        [pa.array(lang, pa.string()), pa.array(phrase, pa.string()), pa.array(words, pa.int32()),
         pa.array(list(held.values()), pa.int64())], ["lang", "phrase", "words", "a"])


def spelled(w: Words, words: np.ndarray) -> list[str]:
    raw = w.data.tobytes()
    used, back = np.unique(words, return_inverse=True)
    text = [raw[a:b].decode() for a, b in w.spans[used].tolist()]
    return [" ".join([text[k] for k in row]) for row in back.reshape(words.shape).tolist()]


def scored(counts: DataFrame, least: int, cover: int) -> DataFrame:
    """``lang, phrase, a, l, r, n, score`` of the candidates no longer one covers."""
    total = counts.filter("words = 0").select("lang", F.col("a").alias("n"))
    known = counts.filter((F.col("words") > 0) & (F.col("a") >= least))
    part = known.select(F.col("lang").alias("_lang"), F.col("phrase").alias("_phrase"), F.col("a").alias("_a"))
    candidates = known.filter("words > 1").withColumn("_list", F.split("phrase", " "))
    cut = candidates.withColumn("_k", F.explode(F.sequence(F.lit(1), F.col("words") - 1)))
    cut = cut.withColumns({
        "_first": F.concat_ws(" ", F.slice("_list", F.lit(1), F.col("_k"))),
        "_rest": F.concat_ws(" ", F.slice("_list", F.col("_k") + 1, F.col("words"))),
    })

    def joined(df: DataFrame, key: str, name: str) -> DataFrame:
        on = (df["lang"] == part["_lang"]) & (df[key] == part["_phrase"])
        return df.join(part, on).withColumnRenamed("_a", name).drop("_lang", "_phrase")

    cut = joined(joined(cut, "_first", "l"), "_rest", "r")
    wide = [F.col(c).cast("decimal(19,0)") for c in ("a", "l", "r")]
    # a is at most l and at most r, so the score is at most a million
    score = F.expr("cast(1000000 as decimal(7,0)) * _wa div _wlr")
    cut = cut.withColumns({"_wa": (wide[0] * wide[0]).cast("decimal(31,0)"), "_wlr": wide[1] * wide[2]})
    cut = cut.withColumn("score", score)
    best = cut.groupBy("lang", "phrase", "words", "a").agg(
        F.min(F.struct("score", "_k", "l", "r")).alias("_best"))
    inner = candidates.filter("words > 2").select(
        "lang", "a", F.explode(F.flatten(F.transform(
            F.sequence(F.lit(2), F.col("words") - 1), lambda n: F.transform(
                F.sequence(F.lit(1), F.col("words") - n + 1),
                lambda s: F.concat_ws(" ", F.slice("_list", s, n)))))).alias("_inner"))
    longer = inner.groupBy(F.col("lang").alias("_lang"), "_inner").agg(F.max("a").alias("_longer"))
    kept = best.join(longer, (F.col("lang") == F.col("_lang")) & (F.col("phrase") == F.col("_inner")), "left").filter(
        F.col("_longer").isNull() | (100 * F.col("_longer") < cover * F.col("a")))
    return kept.join(total, "lang").select("lang", "phrase", "a", "_best.l", "_best.r", "n", "_best.score")


def collocations(docs: DataFrame, longest: int = 3, least: int = 10, cover: int = 50, top: int | None = 2000,
                 share: int = 4) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: the best phrases of 2 to ``longest`` words of each language.

    A phrase that occurs ``least`` times or more scores floor(1000000 a a / (l r)) at its worst cut
    into two parts that occur l and r times; of equal cuts the first counts. A phrase inside a
    longer one that has ``cover`` hundredths of its occurrences is left out. ``n`` counts all words.
    Equal scores are ranked by count, then by the phrase's bytes.

    One document in ``share`` is in the sample (hash of the id), which decides only how many
    passes are needed. Null languages count as ``und``; null or empty texts have no words;
    repeated rows and ids count as often as they occur; other columns play no part.
    """
    if not 2 <= longest <= 3:
        raise ValueError("phrases have two or three words")
    texts = lines(docs)
    sample = lines(docs.filter(F.pmod(F.xxhash64(F.col("doc_id").cast("long")), F.lit(share)) == 0))
    found = frequent_hashes(texts, sample, longest, least, share)
    kept = BitFilter()
    for part in found:
        kept, _ = kept.joined(BitFilter.of(part))
    counts = saved(phrase_counts(texts, kept, longest).filter((F.col("words") == 0) | (F.col("a") >= least)), "phrases")
    ranked = scored(counts, least, cover)
    order = Window.partitionBy("lang").orderBy(F.col("score").desc(), F.col("a").desc(), F.col("phrase"))
    ranked = ranked.withColumn("rank", F.row_number().over(order))
    if top is not None:
        ranked = ranked.filter(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")

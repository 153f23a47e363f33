"""Packing documents into token sequences: minimum bin slack over the lengths that remain."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vitalspark.llm.common import blocks, body, map_arrow, saved, utf8
from vitalspark.llm.words import encoder

#: Rows of one length and slice that one task numbers.
SLICE_ROWS = 100_000


def fill(counts: dict[int, int], room: int) -> dict[int, int]:
    """The multiset of available lengths whose sum comes closest to ``room`` from below.

    Bit s of ``reach`` says that some multiset sums to s. Counts enter in powers of two, each
    step's state is kept, and the way back from the best sum gives the count of each length.
    """
    mask, reach, steps = (1 << (room + 1)) - 1, 1, []
    for length in sorted(counts, reverse=True):
        if length > room or reach >> room & 1:
            continue
        left, k = min(counts[length], room // length), 1
        while left > 0 and not reach >> room & 1:
            k = min(k, left)
            steps.append((length, k, reach))
            reach |= reach << (length * k) & mask
            left, k = left - k, k * 2
    at, need = reach.bit_length() - 1, {}
    for length, k, before in reversed(steps):
        if not before >> at & 1:
            at -= length * k
            need[length] = need.get(length, 0) + k
    return need


@dataclass
class Plan:
    """Where the pieces of each length go, by their rank among pieces of that length.

    A rule covers the ranks from ``first`` on: ``each`` pieces a sequence, from sequence ``base``
    and position ``offset`` on. Where ``cut`` is above 0, the first ``cut`` ids go there, and the
    rest is a piece of its own, of the length that is left and rank ``then`` and up.
    """

    rules: list[tuple[int, int, int, int, int, int, int]] = field(default_factory=list)
    sequences: int = 0

    def arrays(self) -> np.ndarray:
        return np.array(sorted(self.rules), np.int64).reshape(-1, 7)


def plan(counts: dict[int, int], capacity: int) -> Plan:
    """A plan for ``counts`` pieces of each length; its size follows the lengths, not the pieces.

    Each window starts with the longest piece left; the dynamic program fills its slack, and the
    pattern is repeated as long as its counts last. What slack stays is filled by cutting a
    piece. The ids that remain at the end fill sequences of powers of two.
    """
    out, left = Plan(), {k: v for k, v in counts.items() if v > 0}
    head, tail = dict.fromkeys(left, 0), dict(left)

    def take(length: int, each: int, repeats: int, offset: int, cut: int = 0) -> None:
        then = 0
        if cut:
            rest = length - cut
            then = tail.get(rest, 0)
            tail[rest] = then + repeats
            left[rest] = left.get(rest, 0) + repeats
            head.setdefault(rest, 0)
        out.rules.append((length, head[length], each, out.sequences, offset, cut, then))
        head[length] += each * repeats
        left[length] -= each * repeats
        if not left[length]:
            del left[length]

    while left:
        longest = max(left)
        others = dict(left)
        others[longest] -= 1
        need = fill({k: v for k, v in others.items() if v}, capacity - longest)
        need[longest] = need.get(longest, 0) + 1
        slack = capacity - sum(k * v for k, v in need.items())
        repeats = min(left[k] // v for k, v in need.items())
        spare = None
        if slack:
            able = [k for k in left if left[k] > need.get(k, 0)]
            if not able:
                break
            spare = max(able, key=lambda k: (left[k] - need.get(k, 0), k))
            repeats = min(repeats, left[spare] // (need.get(spare, 0) + 1))
        offset = 0
        for length in sorted(need, reverse=True):
            take(length, need[length], repeats, offset)
            offset += length * need[length]
        if spare is not None:
            take(spare, 1, repeats, offset, cut=slack)
        out.sequences += repeats
    rest = sum(k * v for k, v in left.items())
    for size in (1 << b for b in reversed(range(rest.bit_length())) if rest >> b & 1):
        offset = 0
        while offset < size:
            length = max(left)
            cut = size - offset if length > size - offset else 0
            take(length, 1, 1, offset, cut)
            offset += cut or length
        out.sequences += 1
    return out


def place(rules: np.ndarray, length: np.ndarray, rank: np.ndarray):
    """Index of the piece, start in it, length, sequence and offset of every part."""
    keys = rules[:, 0] << 40 | rules[:, 1]
    at, start, found = np.arange(len(length)), np.zeros(len(length), np.int64), []
    while len(at):
        r = rules[np.searchsorted(keys, length << 40 | rank, "right") - 1]
        k, cut = rank - r[:, 1], r[:, 5]
        now = np.where(cut > 0, cut, length)
        found.append((at, start, now, r[:, 3] + k // r[:, 2], r[:, 4] + k % r[:, 2] * length))
        go = cut > 0
        at, start, rank = at[go], (start + cut)[go], (r[:, 6] + k)[go]
        length = (length - cut)[go]
    if not found:
        return [np.zeros(0, np.int64)] * 5
    return [np.concatenate(x) for x in zip(*found, strict=True)]


def tokenised(docs: DataFrame, tokenizer: str, end_id: int = 2) -> DataFrame:
    """``row`` (unique), ``doc_id``, ``doc_tokens`` and the ids as 16-bit numbers."""

    def encode(batches):
        words, row = encoder(tokenizer, False), TaskContext.get().partitionId() << 40
        if max(end_id, words.tokenizer.get_vocab_size() - 1) >= 1 << 16:
            raise ValueError("ids of this tokenizer do not fit 16 bits")
        for batch in batches:
            _, offsets = utf8(batch.column("text"))
            for lo, hi in blocks(offsets, 4 << 20):
                ids = [np.append(np.frombuffer(words.encode(t), "<u4"), end_id).astype("<u2").tobytes()
                       for t in batch.column("text")[lo:hi].to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.arange(row, row + hi - lo)), batch.column("doc_id")[lo:hi],
                     pa.array([len(x) // 2 for x in ids], pa.int64()), pa.array(ids, pa.binary())],
                    ["row", "doc_id", "doc_tokens", "ids"])
                row += hi - lo

    return body(docs).mapInArrow(encode, "row long, doc_id long, doc_tokens long, ids binary")


def ranked(lengths: DataFrame, pieces: int) -> DataFrame:
    """Number the pieces of each length from 0: ``row, length, n`` gain ``rank`` of the first.

    A frequent length is dealt over slices by the hash of the row. Slices are numbered one by
    one, and their totals give each its first number.
    """
    slices = max(1, -(-pieces // SLICE_ROWS))
    dealt = lengths.withColumn("slice", F.pmod(F.xxhash64("row"), F.lit(slices)))
    before = Window.partitionBy("length").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    bases = (dealt.groupBy("length", "slice").agg(F.sum("n").alias("total"))
             .select("length", "slice", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("base")))
    inner = (Window.partitionBy("length", "slice").orderBy("row")
             .rowsBetween(Window.unboundedPreceding, -1))
    return (dealt.withColumn("inner", F.coalesce(F.sum("n").over(inner), F.lit(0)))
            .join(bases, ["length", "slice"])
            .select("row", "length", "n", (F.col("base") + F.col("inner")).alias("rank")))


def pack(docs: DataFrame, tokenizer: str, capacity: int = 4096, end_id: int = 2) -> DataFrame:
    """One row per piece: ``doc_id, start, length, ids, doc_tokens, sequence_id, offset``.

    ``ids`` are little-endian unsigned 32-bit numbers. A document of more than ``capacity`` ids
    is cut into full windows and a rest; the rests are packed by the plan, which the driver
    makes from at most ``capacity`` counts. Every sequence is full, but for the last few, whose
    sizes are powers of two, so nothing is padded.

    A null or empty text is its end id alone. Rows that repeat an id are packed each for itself.
    """
    spark = docs.sparkSession
    rows = saved(tokenised(docs, tokenizer, end_id), "pack-tokens")
    cap = F.lit(capacity).cast("long")
    lengths = rows.select("row", F.explode(F.array(
        F.struct((F.col("doc_tokens") % cap).alias("length"), F.lit(1).cast("long").alias("n"),
                 (F.col("doc_tokens") - F.col("doc_tokens") % cap).alias("at")),
        F.struct(cap.alias("length"), F.floor(F.col("doc_tokens") / cap).cast("long").alias("n"),
                 F.lit(0).cast("long").alias("at")))).alias("p"))
    lengths = lengths.select("row", "p.length", "p.n").filter("length > 0 and n > 0")
    counts = {r.length: r.total
              for r in lengths.groupBy("length").agg(F.sum("n").alias("total")).collect()}
    rules = spark.sparkContext.broadcast(plan(counts, capacity).arrays())

    def assign(batch: pa.RecordBatch):
        row, length, n, rank = (batch.column(c).to_numpy() for c in ("row", "length", "n", "rank"))
        one = np.repeat(np.arange(len(n)), n)
        inner = np.arange(len(one)) - np.repeat(np.cumsum(n) - n, n)
        at, start, now, sequence, offset = place(rules.value, length[one], rank[one] + inner)
        rest = (length[one] < capacity)[at]
        yield pa.RecordBatch.from_arrays(
            [pa.array(row[one][at]), pa.array(rest),
             *map(pa.array, (start + inner[at] * capacity, now, sequence, offset))],
            ["row", "rest", "start", "length", "sequence_id", "offset"])

    pieces = map_arrow(ranked(lengths, sum(counts.values())).select("row", "length", "n", "rank"),
                       assign, "row long, rest boolean, start long, length long, sequence_id long, offset long")
    by_row = pieces.groupBy("row").agg(
        F.collect_list(F.struct("rest", "start", "length", "sequence_id", "offset")).alias("pieces"))

    def cut(batch: pa.RecordBatch):
        o = batch.column("pieces").offsets.to_numpy()
        values = batch.column("pieces").values
        rest, start, length, sequence, offset = (
            values.field(k).to_numpy(zero_copy_only=False) for k in range(5))
        doc = np.repeat(np.arange(batch.num_rows), np.diff(o))
        sl = slice(o[0], o[-1])
        tokens = batch.column("doc_tokens").to_numpy()
        begin = start[sl] + np.where(rest[sl], tokens[doc] // capacity * capacity, 0)
        length = length[sl]
        ends = np.cumsum(length * 4)
        for lo, hi in blocks(np.append(0, ends), 8 << 20):
            ids = [np.frombuffer(memoryview(batch.column("ids")[int(d)].as_buffer()), "<u2")[b:b + n]
                   .astype("<u4").tobytes()
                   for d, b, n in zip(doc[lo:hi], begin[lo:hi], length[lo:hi], strict=True)]
            picked = pa.array(doc[lo:hi])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(picked), pa.array(begin[lo:hi]), pa.array(length[lo:hi]),
                 pa.array(ids, pa.binary()), batch.column("doc_tokens").take(picked),
                 pa.array(sequence[sl][lo:hi]), pa.array(offset[sl][lo:hi])],
                ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"])

    return map_arrow(
        rows.join(by_row, "row").select("doc_id", "doc_tokens", "ids", "pieces"), cut,
        "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long")

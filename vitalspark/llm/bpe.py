"""Byte-level BPE by ranks: distinct words are folded by ranked merges, decoding joins byte pieces."""

from __future__ import annotations

import base64
import hashlib
import heapq
import json

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vitalspark.llm.common import blocks, body, map_arrow, utf8
from vitalspark.llm.words import LONG_WORD, REMEMBERED, WordEncoder

NEVER = 1 << 40
#: Pieces of more bytes are merged one by one with a heap.
LONG_PIECE = 128
#: Slots of the literal rank map.
SLOTS = 65_521


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines)}


def merges(ranks: dict[bytes, int]) -> dict[tuple[int, int], int]:
    """The id that each pair of ids merges to, which is also the rank of the merge."""
    out = {}
    for piece, rank in ranks.items():
        for k in range(1, len(piece)):
            a, b = ranks.get(piece[:k]), ranks.get(piece[k:])
            if a is not None and b is not None:
                out[a, b] = rank
    return out


class Encoder:
    """Folds byte arrays of distinct words, many at once; remembers words, which only saves time."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.pairs, self.pattern = ranks, merges(ranks), regex.compile(pattern)
        self.single = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        self.tables = []
        keys = np.array([a << 32 | b for a, b in self.pairs], np.int64)
        values = np.array(list(self.pairs.values()), np.int64)
        bits = 20
        while len(keys):
            at = self._slot(keys, bits)
            table, rank = np.full(1 << bits, -1, np.int64), np.full(1 << bits, NEVER, np.int64)
            table[at], rank[at] = keys, values
            self.tables.append((bits, table, rank))
            left = table[at] != keys
            keys, values, bits = keys[left], values[left], max(bits - 3, 8)
        self.units: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    @staticmethod
    def _slot(keys: np.ndarray, bits: int) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)).astype(np.int64)

    def _rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        keys, out = a << 32 | b, None
        for bits, table, rank in self.tables:
            at = self._slot(keys, bits)
            found = np.where(table[at] == keys, rank[at], NEVER)
            out = found if out is None else np.minimum(out, found)
        return out

    def _fold(self, words: list[bytes]) -> list[np.ndarray]:
        """Ids of words of one length: every step merges the pair of lowest rank, the first of equals."""
        n, out = len(words[0]), [None] * len(words)
        ids = self.single[np.frombuffer(b"".join(words), np.uint8).reshape(-1, n)]
        rank = self._rank(ids[:, :-1], ids[:, 1:])
        rows = np.arange(len(words))
        while len(rows):
            j = rank.argmin(1) if rank.shape[1] else np.zeros(len(rows), np.int64)
            low = rank[np.arange(len(rows)), j] if rank.shape[1] else np.full(len(rows), NEVER)
            done = low >= NEVER
            for r, x in zip(rows[done].tolist(), ids[done], strict=True):
                out[r] = x
            go = ~done
            rows, ids, rank, j, low = rows[go], ids[go], rank[go], j[go], low[go]
            if not len(rows):
                break
            m, cols, i = ids.shape[1] - 1, np.arange(ids.shape[1] - 1), np.arange(len(rows))
            ids = np.where(cols <= j[:, None], ids[:, :-1], ids[:, 1:])
            ids[i, j] = low
            rank = np.where(cols[:-1] < j[:, None], rank[:, :-1], rank[:, 1:])
            left = np.flatnonzero(j > 0)
            rank[left, j[left] - 1] = self._rank(ids[left, j[left] - 1], ids[left, j[left]])
            right = np.flatnonzero(j < m - 1)
            rank[right, j[right]] = self._rank(ids[right, j[right]], ids[right, j[right] + 1])
        return out

    def _merge_long(self, word: bytes) -> np.ndarray:
        """The same merges for one long word, by a heap of pairs."""
        ids = self.single[np.frombuffer(word, np.uint8)].tolist()
        after, before = list(range(1, len(ids) + 1)), list(range(-1, len(ids) - 1))
        heap = [(r, k, ids[k], ids[k + 1]) for k in range(len(ids) - 1)
                if (r := self.pairs.get((ids[k], ids[k + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            r, k, a, b = heapq.heappop(heap)
            n = after[k]
            if ids[k] != a or n >= len(ids) or ids[n] != b:
                continue
            ids[k], ids[n], after[k] = r, -1, after[n]
            if after[k] < len(ids):
                before[after[k]] = k
            for x, y in ((before[k], k), (k, after[k])):
                if x >= 0 and y < len(ids) and (s := self.pairs.get((ids[x], ids[y]))) is not None:
                    heapq.heappush(heap, (s, x, ids[x], ids[y]))
        return np.array([x for x in ids if x >= 0], np.int64)

    def pieces(self, found: set[str]) -> dict[str, bytes]:
        """Ids of matches of the pattern."""
        out, sizes = {}, {}
        for p in found:
            raw = p.encode()
            if (r := self.ranks.get(raw)) is not None:
                out[p] = np.array([r], "<u4").tobytes()
            elif len(raw) > LONG_PIECE:
                out[p] = self._merge_long(raw).astype("<u4").tobytes()
            else:
                sizes.setdefault(len(raw), []).append((p, raw))
        for same in sizes.values():
            for k in range(0, len(same), 20_000):
                part = same[k:k + 20_000]
                for (p, _), ids in zip(part, self._fold([raw for _, raw in part]), strict=True):
                    out[p] = ids.astype("<u4").tobytes()
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of whole texts. A text is cut where a space or a line feed stands alone between
        words, which no match of the pattern crosses; texts with other white space are one unit."""
        split = [None if t and WordEncoder._side_by_side(t) else ("\n" + t.replace("\n", " \n")).split(" ")
                 for t in texts]
        wanted = set().union(*(u for u in split if u is not None))
        if len(self.units) > REMEMBERED:
            self.older, self.units = self.units, {}
        new = {}
        for u in wanted:
            if u not in self.units:
                if (ids := self.older.get(u)) is not None:
                    self.units[u] = ids
                else:
                    written = u if u[:1] == "\n" else " " + u
                    new[u] = [written] if u.isalpha() else self.pattern.findall(written)
        whole = [self.pattern.findall(t) for t, u in zip(texts, split, strict=True) if u is None]
        known = self.pieces(set().union(*new.values(), *whole, ["\n"]))
        made = {u: b"".join(map(known.__getitem__, p)) for u, p in new.items()}
        self.units.update((u, x) for u, x in made.items() if len(u) <= LONG_WORD)
        skip, rest = len(known["\n"]), iter(whole)
        ids_of = lambda u: self.units[u] if u in self.units else made[u]
        out = []
        for u in split:
            if u is None:
                out.append(b"".join(map(known.__getitem__, next(rest))))
                continue
            try:
                out.append(b"".join(map(self.units.__getitem__, u))[skip:])
            except KeyError:
                out.append(b"".join(map(ids_of, u))[skip:])
        return out


_encoders: dict[tuple, Encoder] = {}


def encoder(digest: str, ranks: dict[bytes, int], pattern: str) -> Encoder:
    """The worker's encoder of these ranks; one is held at a time."""
    key = (digest, pattern)
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = Encoder(ranks, pattern)
    return _encoders[key]


def encode_texts(docs: DataFrame, ranks: dict[bytes, int], pattern: str) -> DataFrame:
    """``doc_id, n_tokens, ids`` (little-endian unsigned 32-bit) of every whole text.

    Each match of ``pattern`` is merged by itself. A null or empty text has no ids. No shuffle:
    each batch folds those of its distinct words that the worker doesn't remember.
    """
    digest = hashlib.sha256(repr(sorted(ranks.items())).encode()).hexdigest()
    shared = docs.sparkSession.sparkContext.broadcast((digest, ranks, pattern))

    def encode(batch: pa.RecordBatch):
        words = encoder(*shared.value)
        _, offsets = utf8(batch.column("text"))
        for lo, hi in blocks(offsets, 2 << 20):
            ids = words.encode(batch.column("text")[lo:hi].to_pylist())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id")[lo:hi], pa.array([len(x) // 4 for x in ids], pa.int64()),
                 pa.array(ids, pa.binary())], ["doc_id", "n_tokens", "ids"])

    return map_arrow(body(docs), encode, "doc_id long, n_tokens long, ids binary")


def decode_ids(rows: DataFrame, ranks: dict[bytes, int]) -> DataFrame:
    """The rows ``doc_id, n_tokens, ids`` with ``decoded``: the byte pieces of the ids, joined."""
    shared = rows.sparkSession.sparkContext.broadcast({v: k for k, v in ranks.items()})

    def decode(batch: pa.RecordBatch):
        piece = shared.value.__getitem__
        data, offsets = utf8(batch.column("ids"))
        for lo, hi in blocks(offsets, 4 << 20):
            ids = np.frombuffer(data[offsets[lo]:offsets[hi]].tobytes(), "<u4").tolist()
            o = ((offsets[lo:hi + 1] - offsets[lo]) // 4).tolist()
            found = [b"".join(map(piece, ids[a:b])) for a, b in zip(o[:-1], o[1:], strict=True)]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c)[lo:hi] for c in ("doc_id", "n_tokens", "ids")),
                 pa.array(found, pa.binary())], ["doc_id", "n_tokens", "ids", "decoded"])

    return map_arrow(rows.select("doc_id", "n_tokens", "ids"), decode,
                     "doc_id long, n_tokens long, ids binary, decoded binary")


def _let(value: Column, use) -> Column:
    return F.get(F.transform(F.array(value), use), F.lit(0))


def fold_words(spark: SparkSession, words: DataFrame, ranks: dict[bytes, int]) -> DataFrame:
    """``word, ids``: the fold as Spark higher-order functions over a literal rank map.

    For vocabularies: each word costs about 150 microseconds, so whole corpora take
    ``encode_texts``, which makes the same merges.
    """
    slots = [[] for _ in range(SLOTS)]
    for (a, b), rank in merges(ranks).items():
        slots[(a * 7919 + b * 104729) % SLOTS] += [(a + 1) * 65536 + b, rank]
    literal = F.from_json(F.lit(json.dumps(slots)), "array<array<bigint>>")
    single = F.array(*[F.lit(ranks[bytes([b])]).cast("bigint") for b in range(256)])

    def folded(word: Column, table: Column) -> Column:
        def rank(a, b):
            slot = F.get(table, ((a * 7919 + b * 104729) % SLOTS).cast("int"))
            at = lambda s: F.nullif(F.array_position(s, (a + 1) * 65536 + b), F.lit(0)).cast("int")
            return _let(slot, lambda s: F.coalesce(F.get(s, at(s)), F.lit(NEVER)))

        def merge(state, _):
            ids, ranks_ = state["ids"], state["ranks"]

            def at(j):
                new = F.get(ranks_, j)
                none = F.array().cast("array<bigint>")
                return F.struct(
                    F.concat(F.slice(ids, F.lit(1), j), F.array(new), F.slice(ids, j + 3, F.size(ids))).alias("ids"),
                    F.concat(F.slice(ranks_, F.lit(1), F.greatest(j - 1, F.lit(0))),
                             F.when(j > 0, F.array(rank(F.get(ids, j - 1), new))).otherwise(none),
                             F.array(F.when(j + 2 < F.size(ids), rank(new, F.get(ids, j + 2))).otherwise(F.lit(NEVER))),
                             F.slice(ranks_, j + 3, F.size(ranks_))).alias("ranks"))

            best = F.array_min(ranks_)
            return F.when(best >= NEVER, state).otherwise(
                _let(F.array_position(ranks_, best).cast("int") - 1, at))

        n, shown = F.octet_length(word), F.hex(word.cast("binary"))
        ids = F.transform(F.sequence(F.lit(1), n), lambda i: F.get(
            single, F.conv(F.substr(shown, i * 2 - 1, F.lit(2)), 16, 10).cast("int")))
        pairs = lambda x: F.zip_with(
            x, F.slice(x, F.lit(2), F.size(x)),
            lambda a, b: F.when(b.isNull(), F.lit(NEVER)).otherwise(rank(a, b)))
        start = _let(ids, lambda x: F.struct(x.alias("ids"), pairs(x).alias("ranks")))
        return F.when(n > 0, F.aggregate(F.sequence(F.lit(1), n), start, merge)["ids"]).otherwise(
            F.array().cast("array<bigint>"))

    return words.select("word", _let(literal, lambda t: folded(F.col("word"), t)).alias("ids"))

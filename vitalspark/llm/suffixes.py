"""Removal of repeated byte strings by blockwise suffix sorting with a difference cover.

Positions whose residue lies in the cover are the sample: any two positions have a common
distance, below the modulus, at which both meet the sample. So where two strings of ``width``
bytes are equal, two sample strings of ``width - modulus + 1`` bytes are. Sample strings are hashed
first, not ranked. Only windows before a hash that occurs twice can be equal over the width; these
are sorted one bucket of the key space at a time, which bounds memory and scratch space. Keys
are 80-bit fingerprints of the width, so the order within a bucket is that of fingerprints.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from vitalspark.llm.chunks import chunked
from vitalspark.llm.common import (
    BYTE_VALUES, blocks, map_arrow, mix, powers, prefix_hash, release, saved, span_hash, spans, utf8,
)

#: Difference covers: every residue is a difference of two members.
COVERS = {57: (0, 1, 3, 13, 32, 36, 43, 52), 31: (1, 5, 11, 24, 25, 27), 13: (0, 1, 3, 9), 7: (0, 1, 3)}
CHECK_BASE = 0xD1342543DE82EF95
CHECK_INVERSE = pow(CHECK_BASE, -1, 1 << 64)
CHUNK_BYTES = 6 << 20


def cover(width: int) -> tuple[int, np.ndarray]:
    """The largest modulus that leaves sample strings of 8 bytes or more, and its cover."""
    modulus = next((v for v in COVERS if width - v + 1 >= 8), 7)
    if width < 8:
        raise ValueError("the width must be 8 bytes at least")
    member = np.zeros(modulus, bool)
    member[list(COVERS[modulus])] = True
    return modulus, member


def texts_of(table: pa.Table) -> tuple[pa.Table, np.ndarray, np.ndarray]:
    table = table.sort_by("row").combine_chunks()
    data, offsets = utf8(table.column("text"))
    return table, data, offsets


def sample_keys(data: np.ndarray, offsets: np.ndarray, width: int):
    """Positions of the cover sample and the keys of the strings there, block by block."""
    modulus, member = cover(width)
    size = width - modulus + 1
    for lo, hi in blocks(offsets):
        a, b = offsets[lo], offsets[hi]
        if b - a < size:
            continue
        o = offsets[lo:hi + 1] - a
        inner = np.arange(b - a) - np.repeat(o[:-1], np.diff(o))
        at = np.flatnonzero(member[inner % modulus] & (np.repeat(o[1:], np.diff(o)) - np.arange(b - a) >= size))
        yield a + at, span_hash(prefix_hash(data[a:b]), at, at + size)


def scaled(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Keys as bucket number (high part) and 32 bits within the bucket."""
    s = buckets.bit_length()
    return (keys >> np.uint64(s)) * np.uint64(buckets) >> np.uint64(32 - s)


def runs(flags: np.ndarray) -> bytes:
    starts, ends = spans(flags, np.array([0, len(flags)]))
    return np.stack([starts, ends]).astype("<u4").tobytes()


def from_runs(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    pair = np.frombuffer(raw, "<u4").reshape(2, -1).astype(np.int64)
    return pair[0], pair[1]


def window_keys(data: np.ndarray, offsets: np.ndarray, candidates: np.ndarray, width: int):
    """Keys and 16 check bits of the candidate windows, block by block, and their positions."""
    keys, checks = [], []
    for lo, hi in blocks(offsets):
        a, b = offsets[lo], offsets[hi]
        at = candidates[np.searchsorted(candidates, a):np.searchsorted(candidates, b)] - a
        if not len(at):
            continue
        keys.append(span_hash(prefix_hash(data[a:b]), at, at + width))
        sums = np.zeros(b - a + 1, np.uint64)
        np.cumsum(mix(BYTE_VALUES)[data[a:b]] * powers(CHECK_BASE, b - a), out=sums[1:])
        second = (sums[at + width] - sums[at]) * powers(CHECK_INVERSE, b - a + 1)[at]
        checks.append((mix(second) >> np.uint64(48)).astype(np.uint16))
    if not keys:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint16)
    return np.concatenate(keys), np.concatenate(checks)


def grouped(keys: np.ndarray, checks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order that puts equal windows together, earliest first, and which of it open a group."""
    order = np.argsort(keys, kind="stable")
    k, c = keys[order], checks[order]
    same = k[1:] == k[:-1]
    if (same & (c[1:] != c[:-1])).any():
        order = np.lexsort((np.arange(len(keys)), checks, keys))
        k, c = keys[order], checks[order]
        same = (k[1:] == k[:-1]) & (c[1:] == c[:-1])
    opens = np.ones(len(keys), bool)
    opens[1:] = ~same
    return order, opens


def positions(right: pa.Table) -> np.ndarray:
    """Candidate positions from the runs of a chunk."""
    if not right.num_rows:
        return np.zeros(0, np.int64)
    starts, ends = from_runs(right.column("runs")[0].as_py())
    sizes = ends - starts
    return np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())


def local_firsts(data, offsets, at, width, low=0, high=1 << 64):
    """Of candidates with a key in the range: sorted positions, group openings, keys and checks."""
    keys, checks = window_keys(data, offsets, at, width)
    if low or high < 1 << 64:
        inside = (keys >= np.uint64(low)) & (keys <= np.uint64(high - 1))
        keys, checks, at = keys[inside], checks[inside], at[inside]
    order, opens = grouped(keys, checks)
    return at[order], opens, keys[order], checks[order]


def bucket_edges(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Where each bucket of the key space begins among sorted keys."""
    starts = np.array([-(-(g << 32) // buckets) << 32 for g in range(buckets)], np.uint64)
    return np.append(np.searchsorted(keys, starts), len(keys))


def repeated_spans(docs: DataFrame, width: int = 100, rounds: int = 4,
                   carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per document: ``doc_id, n_bytes, n_removed, n_spans, kept`` (the bytes that stay).

    Columns named in ``carry`` come along as ``carry_0`` and so on.

    A byte goes if a string of ``width`` bytes over it also starts earlier, in a document with a
    smaller ``doc_id`` or further ahead in the same one. Strings are those of the input; none
    crosses documents. A null text is empty; texts shorter than ``width`` stay whole. Rows of one
    id are ordered by text, rows without an id come first, and repeated rows count as documents
    one after another.

    Chunks of whole documents keep one key of each string, so a string that a third of all
    documents share costs one entry per chunk. ``rounds`` divides the key space: scratch space
    holds one of them at a time.
    """
    table, count = chunked(docs, "suffix_chunks", CHUNK_BYTES, carry)
    buckets = -(-count // 2)
    release()

    def rank_sample(chunk: pa.Table) -> pa.Table:
        _, data, offsets = texts_of(chunk.select(["row", "text"]))
        found = [scaled(k, buckets) for _, k in sample_keys(data, offsets, width)]
        keys = np.sort(np.concatenate(found)) if found else np.zeros(0, np.uint64)
        third = np.zeros(len(keys), bool)
        third[2:] = keys[2:] == keys[:-2]
        keys = keys[~third]
        edges = np.searchsorted(keys, np.arange(buckets + 1, dtype=np.uint64) << np.uint64(32))
        used = np.flatnonzero(np.diff(edges))
        low = (keys & np.uint64(0xFFFFFFFF)).astype("<u4")
        return pa.table({
            "bucket": pa.array(used, pa.int32()),
            "chunk": pa.array(np.full(len(used), chunk.column("chunk")[0].as_py()), pa.int32()),
            "keys": pa.array([low[edges[g]:edges[g + 1]].tobytes() for g in used], pa.binary())})

    def tied_sample(part: pa.Table) -> pa.Table:
        blobs = [np.frombuffer(x.as_py(), "<u4") for x in part.column("keys")]
        owner = np.repeat(np.arange(len(blobs)), [len(x) for x in blobs])
        keys = np.concatenate(blobs)
        order = np.argsort(keys, kind="stable")
        same = keys[order][1:] == keys[order][:-1]
        tied = np.zeros(len(keys), bool)
        tied[order[1:][same]] = True
        tied[order[:-1][same]] = True
        edges = np.searchsorted(owner, np.arange(len(blobs) + 1))
        out = [np.unique(b[tied[edges[k]:edges[k + 1]]]) for k, b in enumerate(blobs)]
        return pa.table({"chunk": part.column("chunk"), "bucket": part.column("bucket"),
                         "keys": pa.array([x.tobytes() for x in out], pa.binary())})

    schema = "bucket int, chunk int, keys binary"
    sample = table.groupBy("chunk").applyInArrow(rank_sample, schema)
    ties = saved(sample.groupBy("bucket").applyInArrow(tied_sample, "chunk int, bucket int, keys binary"),
                 "suffix-ties")
    release()

    def find_candidates(chunk: pa.Table, right: pa.Table) -> pa.Table:
        empty = pa.table({"chunk": pa.array([], pa.int32()), "runs": pa.array([], pa.binary())})
        if not chunk.num_rows or not right.num_rows:
            return empty
        number = chunk.column("chunk")[0].as_py()
        _, data, offsets = texts_of(chunk.select(["row", "text"]))
        tied = np.sort(np.concatenate([
            np.frombuffer(k, "<u4").astype(np.uint64) | np.uint64(g << 32)
            for g, k in zip(right.column("bucket").to_pylist(), right.column("keys").to_pylist(), strict=True)]))
        if not len(tied):
            return empty
        maybe = np.zeros(1 << 22, bool)
        maybe[tied & np.uint64((1 << 22) - 1)] = True
        modulus, _ = cover(width)
        delta = np.zeros(len(data) + 1, np.int8)
        for at, keys in sample_keys(data, offsets, width):
            k = scaled(keys, buckets)
            hit = np.flatnonzero(maybe[k & np.uint64((1 << 22) - 1)])
            hit = hit[tied[np.minimum(np.searchsorted(tied, k[hit]), len(tied) - 1)] == k[hit]]
            np.add.at(delta, np.maximum(at[hit] - modulus + 1, 0), 1)
            np.add.at(delta, at[hit] + 1, -1)
        whole = np.zeros(len(data), bool)
        for lo, hi in blocks(offsets):  # windows that end within their document
            n = np.maximum(np.diff(offsets[lo:hi + 1]) - width + 1, 0)
            for a, m in zip(offsets[lo:hi].tolist(), n.tolist(), strict=True):
                whole[a:a + m] = True
        whole &= np.cumsum(delta[:-1], dtype=np.int16) > 0
        return pa.table({"chunk": pa.array([number], pa.int32()), "runs": pa.array([runs(whole)], pa.binary())})

    candidates = saved(
        table.groupBy("chunk").cogroup(ties.groupBy("chunk")).applyInArrow(find_candidates, "chunk int, runs binary"),
        "suffix-candidates")

    def entries(number: int):
        low, high = (-(-(k << 32) // rounds) << 32 for k in (number, number + 1))

        def sort_chunk(chunk: pa.Table, right: pa.Table) -> pa.Table:
            made = {"bucket": [], "chunk": [], "keys": [], "checks": []}
            at = positions(right) if chunk.num_rows else ()
            if len(at):
                name = chunk.column("chunk")[0].as_py()
                _, data, offsets = texts_of(chunk.select(["row", "text"]))
                _, opens, keys, checks = local_firsts(data, offsets, at, width, low, high)
                keys, checks = keys[opens].astype("<u8"), checks[opens].astype("<u2")
                edges = bucket_edges(keys, buckets * rounds)
                for g in np.flatnonzero(np.diff(edges)):
                    part = slice(edges[g], edges[g + 1])
                    for c, v in zip(made, (g, name, keys[part].tobytes(), checks[part].tobytes()), strict=True):
                        made[c].append(v)
            return pa.table({k: pa.array(v, pa.binary() if k[-1] == "s" else pa.int32())
                             for k, v in made.items()})

        return sort_chunk

    def later(part: pa.Table) -> pa.Table:
        part = part.sort_by("chunk")
        keys = [np.frombuffer(x.as_py(), "<u8") for x in part.column("keys")]
        checks = np.concatenate([np.frombuffer(x.as_py(), "<u2") for x in part.column("checks")])
        edges = np.cumsum([0, *map(len, keys)])
        order, opens = grouped(np.concatenate(keys), checks)
        dup = np.zeros(len(checks), bool)
        dup[order[~opens]] = True
        bits = [np.packbits(dup[a:b]).tobytes() for a, b in zip(edges[:-1], edges[1:], strict=True)]
        return pa.table({"chunk": part.column("chunk"), "bucket": part.column("bucket"),
                         "later": pa.array(bits, pa.binary())})

    answers = []
    for number in range(rounds):
        sent = (table.groupBy("chunk").cogroup(candidates.groupBy("chunk"))
                .applyInArrow(entries(number), "bucket int, chunk int, keys binary, checks binary"))
        answers.append(saved(sent.groupBy("bucket").applyInArrow(later, "chunk int, bucket int, later binary"),
                             "suffix-later"))
        del sent
        release()
    replies = candidates.select("chunk", F.lit(-1).alias("bucket"), F.col("runs").alias("blob"))
    for a in answers:
        replies = replies.union(a.select("chunk", "bucket", "later"))

    def cut(chunk: pa.Table, right: pa.Table) -> pa.Table:
        chunk, data, offsets = texts_of(chunk)
        gone = np.zeros(len(data), bool)
        if right.num_rows:
            right = right.sort_by("bucket").combine_chunks()
            blobs = right.column("blob").to_pylist()
            at = positions(pa.table({"runs": blobs[:1]}))
            where, opens, keys, _ = local_firsts(data, offsets, at, width)
            dup = ~opens
            firsts = np.flatnonzero(opens)
            edges = bucket_edges(keys[firsts], buckets * rounds)
            for g, raw in zip(right.column("bucket").to_pylist()[1:], blobs[1:], strict=True):
                n = edges[g + 1] - edges[g]
                dup[firsts[edges[g]:edges[g + 1]]] = np.unpackbits(np.frombuffer(raw, np.uint8), count=n).astype(bool)
            starts = np.sort(where[dup])
            delta = np.zeros(len(data) + 1, np.int32)
            delta[starts] += 1
            delta[starts + width] -= 1
            gone = np.cumsum(delta[:-1]) > 0
        begin, _ = spans(gone, offsets)
        removed = np.zeros(len(gone) + 1, np.int64)
        np.cumsum(gone, out=removed[1:])
        stay = data[~gone].tobytes()
        edge = offsets - removed[offsets]
        return pa.table({
            "doc_id": chunk.column("doc_id"), "n_bytes": np.diff(offsets),
            "n_removed": np.diff(removed[offsets]),
            "n_spans": np.diff(np.searchsorted(begin, offsets)).astype(np.int64),
            "kept": pa.array([stay[a:b] for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True)],
                             pa.binary()),
            **{c: chunk.column(c) for c in carried}})

    carried = [f"carry_{k}" for k in range(len(carry))]
    schema = StructType.fromDDL("doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")
    schema = StructType(schema.fields + [table.schema[c] for c in carried])
    return table.groupBy("chunk").cogroup(replies.groupBy("chunk")).applyInArrow(cut, schema)


def without_repeats(docs: DataFrame, width: int = 100) -> DataFrame:
    """The rows of ``docs`` with repeated strings cut from ``text``, all other columns as they are.

    Bytes of a character that was cut apart go too. ``n_chars``, where there is one, is the length of
    the new text.
    """
    names = tuple(c for c in docs.columns if c != "text")
    rows = repeated_spans(docs, width, carry=names)

    def as_text(batch: pa.RecordBatch):
        text = [x.decode(errors="ignore") for x in batch.column("kept").to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(f"carry_{k}") for k in range(len(names))), pa.array(text, pa.string())],
            [*(f"carry_{k}" for k in range(len(names))), "kept_text"])

    schema = StructType([rows.schema[f"carry_{k}"] for k in range(len(names))]).add("kept_text", "string")
    found = map_arrow(rows.drop("doc_id", "n_bytes", "n_removed", "n_spans"), as_text, schema)
    new = {c: F.col(f"carry_{k}") for k, c in enumerate(names)} | {"text": F.col("kept_text")}
    if "n_chars" in names:
        new["n_chars"] = F.length("kept_text").cast(docs.schema["n_chars"].dataType)
    return found.select(*[new[c].alias(c) for c in docs.columns])

"""Near-duplicate documents by HyperMinHash.

A document's set holds its distinct five-word shingles. For each of 128 buckets the smallest
hash is kept as the count of its leading zeros (6 bits) and the next 10 bits. Four registers
make a 64-bit band; documents that share one of the 32 bands are candidates, are screened by the
collision-corrected estimate, and are confirmed on their full sets.

Pairs are never rows. Members of a bucket are dealt over slices and its centers over blocks; a task
compares one block with one slice. The screen tells which members and centers have a partner, full
sets travel to those alone, and the comparison of the sets leaves a spanning forest of the links.

Two sets with a similarity of 0.75 share a band with a probability of 1 - (1 - 0.75**4)**32, more
than 0.99999; the screen lies five standard errors below the threshold.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vitalspark.llm.common import (
    LOWER, SPACES, blocks, body_columns, map_arrow, mix, prefix_hash, release, saved, span_hash,
    spans, utf8, windows,
)
from vitalspark.llm.components import components

SHINGLE = 5
BUCKETS = 128
BAND = 4
MANTISSA = 10
#: Members of a bucket in one slice and centers in one block; rows and pairs of a task.
SLICE = 2048
BIN_ROWS = 20_000
BIN_PAIRS = 1 << 20
#: The same for full sets, in shingles.
SLICE_SHINGLES = 1 << 19
BIN_SHINGLES = 1 << 20
#: Pairs whose estimates a task corrects at once.
PAIRS = 1 << 18
_rng = np.random.default_rng(99)
FACTORS = _rng.integers(0, 1 << 62, BUCKETS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
SHIFTS = _rng.integers(0, 1 << 63, BUCKETS, dtype=np.uint64)


def shingle_sets(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct shingles of each row, their bounds, and a hash of each row's words.

    A text of fewer words than a shingle has one, its whole sequence; without words it has none.
    """
    low = LOWER[data]
    starts, ends = spans(~SPACES[data], offsets)
    bounds = np.searchsorted(starts, offsets)
    word = span_hash(prefix_hash(low), starts, ends)
    h, first = windows(word, bounds, SHINGLE)
    row_of = np.repeat(np.arange(len(offsets) - 1), np.diff(bounds))
    rows, n = row_of[first], np.diff(bounds)
    short = np.flatnonzero((n > 0) & (n < SHINGLE))
    if len(short):
        whole = np.array([int(windows(word[bounds[r]:bounds[r + 1]], np.array([0, n[r]]), n[r])[0][0])
                          ^ int(n[r]) for r in short], np.uint64)
        h, rows = np.concatenate([h, whole]), np.concatenate([rows, short])
    order = np.lexsort((h, rows))
    h, rows = h[order], rows[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (rows[1:] != rows[:-1])
    h, rows = h[new], rows[new]
    places = np.arange(len(word)) - np.repeat(bounds[:-1], n)
    text = np.zeros(len(n), np.uint64)
    np.add.at(text, row_of, mix(word + (places + 1).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
    return h, np.searchsorted(rows, np.arange(len(offsets))), text


def registers(sets: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Row by bucket: leading zeros and mantissa of the smallest hash, in 16 bits."""
    n = len(bounds) - 1
    out = np.zeros((n, BUCKETS), np.uint16)
    some = np.flatnonzero(np.diff(bounds))
    if not len(some):
        return out
    x = sets ^ (sets >> np.uint64(29))
    for j in range(BUCKETS):
        y = x * FACTORS[j] + SHIFTS[j]
        y ^= y >> np.uint64(32)
        low = np.minimum.reduceat(y, bounds[some])
        out[some, j] = compressed(low)
    return out


def compressed(low: np.ndarray) -> np.ndarray:
    """Leading zeros (63 at most) above the ten bits that follow the first one."""
    bits = np.frexp(low.astype(np.float64))[1]
    over = (bits > 0) & (low < (np.uint64(1) << np.clip(bits - 1, 0, 63).astype(np.uint64)))
    bits = np.clip(bits - over, 1, 64).astype(np.uint64)
    zeros = np.minimum(np.uint64(64) - bits, np.uint64(63))
    high = low << zeros << np.uint64(1)
    return (zeros << np.uint64(MANTISSA) | high >> np.uint64(64 - MANTISSA)).astype(np.uint16)


def chance(n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Probability that unrelated sets of sizes n and m agree in a register."""
    total = np.zeros(len(n))
    for z in range(63):
        hi, lo = 2.0 ** -z, 2.0 ** -(z + 1)
        a = np.exp(n * np.log1p(-lo)) - (np.exp(n * np.log1p(-hi)) if z else 0)
        b = np.exp(m * np.log1p(-lo)) - (np.exp(m * np.log1p(-hi)) if z else 0)
        total += a * b
    return total / (1 << MANTISSA)


def corrected(agree: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Jaccard estimates from the share of equal registers, without chance agreement."""
    c = chance(n.astype(float), m.astype(float))
    return (agree - c) / (1 - c)


def estimate(a: np.ndarray, b: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Jaccard estimates of register rows, corrected for chance agreement."""
    return corrected((a == b).mean(axis=1), n, m)


def row_key() -> Column:
    """A 128-bit key of id and text, which tells rows of one id apart."""
    doc_id, text = body_columns()
    return F.unhex(F.md5(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(" "), text)
                         .cast("binary"))).alias("row_key")


def signatures(docs: DataFrame) -> DataFrame:
    """``doc_id, row_key, n_shingles, words`` (128-bit key of the word sequence) and the registers."""

    def sign(batch: pa.RecordBatch):
        data, offsets = utf8(batch.column("text"))
        for lo, hi in blocks(offsets, rows=2000):
            part, o = data[offsets[lo]:offsets[hi]], offsets[lo:hi + 1] - offsets[lo]
            sets, bounds, text = shingle_sets(part, o)
            second = np.zeros(hi - lo, np.uint64)
            some = np.flatnonzero(np.diff(bounds))
            if len(some):
                second[some] = np.add.reduceat(mix(sets), bounds[some])
            keys = np.stack([text, second], 1).astype("<u8")
            regs = registers(sets, bounds)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id")[lo:hi], batch.column("row_key")[lo:hi],
                 pa.array(np.diff(bounds).astype(np.int64)),
                 pa.array([k.tobytes() for k in keys], pa.binary()),
                 pa.array([r.tobytes() for r in regs], pa.binary())],
                ["doc_id", "row_key", "n_shingles", "words", "registers"])

    return map_arrow(docs.select(*body_columns(), row_key()), sign,
                     "doc_id long, row_key binary, n_shingles long, words binary, registers binary")


def band_keys(registers: np.ndarray) -> np.ndarray:
    """Row by band: a key of the band's number and value."""
    value = registers.view("<u8").reshape(len(registers), -1)
    return mix(value + np.arange(1, value.shape[1] + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)).view(np.int64)


def register_rows(column: pa.Array) -> np.ndarray:
    return np.frombuffer(utf8(column)[0].tobytes(), np.uint16).reshape(-1, BUCKETS)


def bands(classes: DataFrame) -> DataFrame:
    """One row for each class and band: ``band`` (its number and value) and ``node``."""

    def cut(batch: pa.RecordBatch):
        key = band_keys(register_rows(batch.column("registers")))
        yield pa.RecordBatch.from_arrays(
            [pa.array(key.reshape(-1)),
             pa.array(np.repeat(batch.column("node").to_numpy(), key.shape[1]))], ["band", "node"])

    return map_arrow(classes.select("node", "registers"), cut, "band long, node long")


def full_sets(texts: DataFrame) -> DataFrame:
    """``node, shingles``: the sorted 64-bit hashes of each whole text's shingles."""

    def make(batch: pa.RecordBatch):
        data, offsets = utf8(batch.column("text"))
        for lo, hi in blocks(offsets, rows=2000):
            sets, bounds, _ = shingle_sets(data[offsets[lo]:offsets[hi]], offsets[lo:hi + 1] - offsets[lo])
            raw = sets.astype("<u8")
            yield pa.RecordBatch.from_arrays(
                [batch.column("node")[lo:hi],
                 pa.array([raw[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:], strict=True)], pa.binary())],
                ["node", "shingles"])

    return map_arrow(texts.select("node", "text"), make, "node long, shingles binary")


def dealt(rows: DataFrame, bins: int) -> DataFrame:
    """The rows once for each task they take part in: a member of a slice meets every block of
    centers, a center every slice."""
    k = F.when(F.col("center"), F.col("slices")).otherwise(F.col("blocks")) - 1
    own = F.pmod(F.xxhash64("node"), F.when(F.col("center"), F.col("blocks")).otherwise(F.col("slices")))
    return (rows.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), k)))
            .withColumn("slice", F.when(F.col("center"), F.col("other")).otherwise(F.col("own")))
            .withColumn("block", F.when(F.col("center"), F.col("own")).otherwise(F.col("other")))
            .drop("own", "other", "slices", "blocks")
            .withColumn("bin", F.pmod(F.xxhash64("band", "slice", "block"), F.lit(bins))))


def met_groups(table: pa.Table) -> tuple[pa.Table, list[tuple[int, int, int]]]:
    """The table sorted, and the ranges of rows that meet: members from, centers from, end."""
    t = table.sort_by([(c, "ascending") for c in ("band", "slice", "block", "center", "node")]).combine_chunks()
    if not t.num_rows:
        return t, []
    key = np.stack([t.column(c).to_numpy() for c in ("band", "slice", "block")])
    edge = np.append(np.flatnonzero(np.append(True, (key[:, 1:] != key[:, :-1]).any(0))), t.num_rows)
    center = t.column("center").to_numpy()
    return t, [(s, s + int((~center[s:e]).sum()), e) for s, e in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True)]


def screened(rows: DataFrame, threshold: int) -> DataFrame:
    """``band, node, group, n_shingles, center`` of the rows that may have a link to another group.

    A pair counts in the first band it shares only, and a pair of centers once.
    """
    share = threshold / 100
    near = share - 5 * np.sqrt(share * (1 - share) / BUCKETS)
    names = ["band", "node", "group", "n_shingles", "center"]

    def compare(table: pa.Table) -> pa.Table:
        t, groups = met_groups(table)
        node, group, size, meets, band = (t.column(c).to_numpy() for c in ("node", "group", "n_shingles", "meets", "band"))
        regs = register_rows(t.column("registers"))
        lanes = regs.view("<u8").reshape(len(regs), BUCKETS // BAND)
        found = np.zeros(t.num_rows, bool)
        pairs, waiting = [], 0

        def settle():
            if pairs:
                at, k, agree = (np.concatenate(x) for x in zip(*pairs, strict=True))
                ok = corrected(agree, size[at], size[k]) >= near
                found[at[ok]] = found[k[ok]] = True
                pairs.clear()

        for s, c, e in groups:
            place = int((band_keys(regs[s:s + 1])[0] == band[s]).argmax())
            for k in range(c, e):
                at = np.flatnonzero((group[s:c] != group[k]) & (~meets[s:c] | (node[s:c] < node[k]))) + s
                at = at[100 * np.minimum(size[at], size[k]) >= threshold * np.maximum(size[at], size[k])]
                at = at[~(lanes[at, :place] == lanes[k, :place]).any(1)]
                if not len(at):
                    continue
                agree = np.count_nonzero(regs[at] == regs[k], axis=1) / BUCKETS
                at, agree = at[agree >= near], agree[agree >= near]  # chance only adds agreement
                pairs.append((at, np.full(len(at), k), agree))
                waiting += len(at)
                if waiting > PAIRS:
                    settle()
                    waiting = 0
        settle()
        return t.select(names).filter(pa.array(found))

    return (rows.groupBy("bin").applyInArrow(
        compare, "band long, node long, group long, n_shingles long, center boolean").distinct())


def spanning_links(rows: DataFrame, threshold: int) -> DataFrame:
    """Links ``a, b`` between members and centers by their full sets; of those that join the same
    groups within a task, one."""

    def compare(table: pa.Table) -> pa.Table:
        t, groups = met_groups(table)
        node, group, size = (t.column(c).to_numpy() for c in ("node", "group", "n_shingles"))
        data, offsets = utf8(t.column("shingles"))
        sets, bounds = np.frombuffer(data.tobytes(), "<u8"), offsets // 8
        links = []
        for s, c, e in groups:
            _, word = np.unique(sets[bounds[s]:bounds[e]], return_inverse=True)
            own = bounds[s:e + 1] - bounds[s]
            mine = word[:own[c - s]]
            here = np.zeros(int(word.max()) + 1, bool)
            _, root = np.unique(group[s:e], return_inverse=True)
            for k in range(c - s, e - s):
                n, m = size[s:c], size[s + k]
                able = (root[:c - s] != root[k]) & (100 * np.minimum(n, m) >= threshold * np.maximum(n, m))
                if not able.any():
                    continue
                here[word[own[k]:own[k + 1]]] = True
                both = np.add.reduceat(here[mine], own[:c - s], dtype=np.int64)
                here[word[own[k]:own[k + 1]]] = False
                at = np.flatnonzero(able & (both > 0) & (100 * both >= threshold * (n + m - both)))
                joined, one = np.unique(root[at], return_index=True)
                links += [(int(node[s + i]), int(node[s + k])) for i in at[one]]
                root[np.isin(root, joined)] = root[k]
        found = np.array(links, np.int64).reshape(-1, 2)
        return pa.table({"a": found[:, 0], "b": found[:, 1]})

    return rows.groupBy("bin").applyInArrow(compare, "a long, b long")


def meeting(open_: DataFrame, classes: DataFrame, texts: DataFrame, threshold: int) -> DataFrame:
    """Links of the centers of every bucket of ``open_`` with the bucket's members."""
    spread = (open_.groupBy("band").agg(F.count(F.lit(1)).alias("m"), F.count_if("center").alias("c"))
              .select("band", F.ceil(F.col("m") / SLICE).alias("slices"), F.ceil(F.col("c") / SLICE).alias("blocks"),
                      (F.col("m") * F.col("c")).cast("double").alias("work")))
    work = spread.select(F.sum("work")).first()[0] or 0
    spread = spread.drop("work")
    rows = (open_.join(spread, "band").withColumnRenamed("center", "meets")
            .withColumn("center", F.explode(F.when(F.col("meets"), F.array(F.lit(False), F.lit(True)))
                                            .otherwise(F.array(F.lit(False))))))
    times = F.when(F.col("center"), F.col("slices")).otherwise(F.col("blocks"))
    bins = max(1, (rows.select(F.sum(times)).first()[0] or 0) // BIN_ROWS, int(work // BIN_PAIRS))
    sketches = classes.select("node", "n_shingles", "registers")
    likely = saved(screened(dealt(rows.join(sketches, "node"), bins), threshold), "near-likely")

    by_role = [F.ceil(F.sum(F.when(role, F.col("n_shingles")).otherwise(0)) / SLICE_SHINGLES).alias(name)
               for role, name in ((~F.col("center"), "slices"), (F.col("center"), "blocks"))]
    rows = likely.join(likely.groupBy("band").agg(*by_role), "band")
    bins = max(1, (rows.select(F.sum(times * F.col("n_shingles"))).first()[0] or 0) // BIN_SHINGLES)
    sets = full_sets(texts.join(likely.select("node").distinct(), "node", "left_semi"))
    return saved(spanning_links(dealt(rows.join(sets, "node"), bins), threshold), "near-links")


def near_links(docs: DataFrame, classes: DataFrame, threshold: int = 75) -> DataFrame:
    """``node, component`` of the classes that have links.

    First one member of every bucket meets the others, by which most copies become one group and
    most buckets close: groups that are linked already need no more links. Of buckets that
    still hold several groups, all members outside the largest group then meet all others.
    """
    by_band = bands(classes)
    sizes = by_band.groupBy("band").agg(F.count(F.lit(1)).alias("size"))
    shared = saved(by_band.join(sizes.filter("size > 1"), "band"), "near-shared")
    weights = shared.groupBy("node").agg(F.sum("size").alias("weight"))
    rows = docs.select(*body_columns(), row_key())
    wanted = classes.join(weights, "node", "left_semi").select("row_key", "node")
    texts = saved(rows.join(wanted, "row_key").groupBy("row_key", "node").agg(F.first("text").alias("text"))
                  .select("node", "text"), "near-texts")
    release()

    heaviest = Window.partitionBy("band").orderBy(F.desc("weight"), "node")
    first = saved(shared.join(weights, "node").select("band", "node", "weight")
                  .withColumn("place", F.row_number().over(heaviest)).filter("place = 1")
                  .select("band", F.col("node").alias("chosen")), "near-centers")
    members = saved(shared.join(first, "band")
                    .select("band", "node", F.col("node").alias("group"), (F.col("node") == F.col("chosen")).alias("center")),
                    "near-open")
    links = meeting(members, classes, texts, threshold)
    labels = components(links)
    release()

    # a center has met all whose first shared band is the bucket; other pairs still meet in theirs
    grouped = (members.select("band", "node").join(labels, "node", "left")
               .select("band", "node", F.coalesce("component", "node").alias("group")))
    counts = saved(grouped.groupBy("band", "group").agg(F.count(F.lit(1)).alias("size")), "near-groups")
    largest = (counts.groupBy("band").agg(F.max(F.struct("size", "group")).alias("top"), F.count(F.lit(1)).alias("groups"))
               .filter("groups > 1").select("band", F.col("top.group").alias("main")))
    left = saved(grouped.join(largest, "band")
                 .select("band", "node", "group", (F.col("group") != F.col("main")).alias("center")), "near-open")
    more = meeting(left, classes, texts, threshold)
    if more.limit(1).count():
        labels = components(links.union(more))
    release()
    return labels


def with_heads(docs: DataFrame, threshold: int) -> DataFrame:
    """``doc_id, row_key, n_shingles`` and ``head``, the first row of the component (its id and key)."""
    marks = saved(signatures(docs), "near-signatures")
    # rows without an id come last
    row = F.struct(F.col("doc_id").isNull().alias("unnamed"), F.col("doc_id"), F.col("row_key"))
    classes = saved(marks.filter("n_shingles > 0").groupBy("words")
                    .agg(F.min(row).alias("row"), F.first("n_shingles").alias("n_shingles"),
                         F.first("registers").alias("registers"))
                    .select(F.monotonically_increasing_id().alias("node"), "words", "row",
                            F.col("row.row_key").alias("row_key"), "n_shingles", "registers"), "near-classes")
    labels = near_links(docs, classes, threshold)
    linked = labels.join(classes.select("node", "row"), "node")
    heads = linked.groupBy("component").agg(F.min("row").alias("head"))
    linked = labels.join(heads, "component").select("node", "head")
    named = classes.select("node", "words", "row").join(linked, "node", "left").select(
        "words", F.coalesce("head", "row").alias("head"))
    return marks.select("doc_id", "row_key", "n_shingles", "words").join(named, "words", "left")


def near_dedup(docs: DataFrame, threshold: int = 75) -> DataFrame:
    """One row per document: ``doc_id, n_shingles, component_id, kept``.

    Documents with one word sequence are one class, and only classes are compared. Null and empty
    texts, and texts without words, have no set and are linked with nothing. Every row is compared
    by its own text, also rows without an id and rows that repeat one. Ids decide the name of a component: its
    smallest id, or null if none of its rows has one; of such rows the one with the smallest key of its text is kept.
    """
    own = F.col("n_shingles") == 0
    return (with_heads(docs, threshold)
            .withColumn("component_id", F.when(own, F.col("doc_id")).otherwise(F.col("head.doc_id")))
            .withColumn("kept", F.when(own | F.col("doc_id").isNotNull(), F.col("doc_id").eqNullSafe(F.col("component_id")))
                        .otherwise(F.col("row_key") == F.col("head.row_key")))
            .select("doc_id", "n_shingles", "component_id", "kept"))


def representatives(docs: DataFrame, threshold: int = 75) -> DataFrame:
    """The rows of ``docs`` that stay, all columns as they are: of each component the first row, by id
    and then by a key of the text (rows without an id last), and all rows without words. Rows that
    repeat both id and text stay or go together.
    """
    gone = (with_heads(docs, threshold).filter("n_shingles > 0 and row_key <> head.row_key")
            .select(F.col("row_key").alias("gone_key")).distinct())
    return docs.join(gone, row_key() == gone.gone_key, "left_anti")

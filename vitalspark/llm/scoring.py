"""Log probabilities of texts: a word unigram base and a causal attention model on subword ids."""

from __future__ import annotations

import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitalspark.llm.attention import (
    CLASSES, CONTEXT, INNER, SLOTS, STEP, Adam, Attention, neighbours, slots, token_classes, windows_of,
)
from vitalspark.llm.chunks import text_bytes
from vitalspark.llm.common import (
    LOWER, SPACES, blocks, body, map_arrow, prefix_hash, remainder, saved,
    span_hash, spans, utf8,
)
from vitalspark.llm.words import byte_letters, encoder
from vitalspark.session import work_dir

CHUNK_BYTES = 8 << 20
#: Ids, in bytes, that one copy of the attention model trains on, and how often the copies meet.
GROUP_BYTES = 8 << 20
ROUNDS = 4
#: Pseudo counts: of an id in its class, and of the class share behind a preceding class.
ALPHA, KAPPA = 0.1, 5.0
LOWER_BYTES = LOWER.tobytes()


def lowered(text: str) -> list[str]:
    """Words of the lower-cased text; only space and 0x09-0x0D part them."""
    found = text.encode().translate(LOWER_BYTES).split()
    return b" ".join(found).decode().split(" ") if found else []


def encoded(docs: DataFrame, tokenizer: str) -> DataFrame:
    """Bucketed table ``chunk, row, doc_id, held_out, text, ids`` of whole texts; no shuffle.

    Ids are those of the lower-cased words, each after a space, in 16 bits.
    """
    spark = docs.sparkSession
    texts = body(docs).withColumn("held_out", remainder(F.col("doc_id"), 7) == 2)
    count = max(1, -(-text_bytes(texts) // CHUNK_BYTES))

    def encode(batches):
        words, part, row, used = encoder(tokenizer, True), TaskContext.get().partitionId(), 0, 0
        if words.tokenizer.get_vocab_size() >= 1 << 16:
            raise ValueError("ids of this tokenizer do not fit 16 bits")
        for batch in batches:
            _, offsets = utf8(batch.column("text"))
            for lo, hi in blocks(offsets, 2 << 20):
                ids = [np.frombuffer(words.join(lowered(t)), "<u4").astype("<u2").tobytes()
                       for t in batch.column("text")[lo:hi].to_pylist()]
                n = hi - lo
                chunk = (part << 24) + used // CHUNK_BYTES
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(n, chunk)), pa.array(np.arange(row, row + n)),
                     *(batch.column(c)[lo:hi] for c in ("doc_id", "held_out", "text")),
                     pa.array(ids, pa.binary())],
                    ["chunk", "row", "doc_id", "held_out", "text", "ids"])
                row, used = row + n, used + int(offsets[hi] - offsets[lo])

    table = f"lm_{uuid.uuid4().hex}"
    (texts.mapInArrow(encode, "chunk long, row long, doc_id long, held_out boolean, text string, ids binary")
     .write.format("parquet").option("compression", "zstd").option("path", work_dir(spark, "lm"))
     .bucketBy(count, "chunk").saveAsTable(table))
    return spark.table(table)


def words_in(table: pa.Table):
    """Blocks of a chunk: its rows, the hash of each lower-cased word, and word bounds."""
    data, offsets = utf8(table.column("text").combine_chunks())
    for lo, hi in blocks(offsets):
        part, o = LOWER[data[offsets[lo]:offsets[hi]]], offsets[lo:hi + 1] - offsets[lo]
        starts, ends = spans(~SPACES[part], o)
        yield lo, hi, span_hash(prefix_hash(part), starts, ends), np.searchsorted(starts, o)


def chunk_words(table: pa.Table) -> pa.Table:
    """The distinct words of a chunk and their counts in training documents."""
    held = table.column("held_out").to_numpy()
    train, other = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)]
    for lo, hi, h, bounds in words_in(table):
        out = np.repeat(held[lo:hi], np.diff(bounds))
        train.append(h[~out])
        other.append(h[out])
    words, n = np.unique(np.concatenate(train), return_counts=True)
    other = np.unique(np.concatenate(other))
    other = other[~np.isin(other, words, assume_unique=True)]
    words, n = np.concatenate([words, other]), np.concatenate([n, np.zeros(len(other), np.int64)])
    return pa.table({"chunk": np.full(len(words), table.column("chunk")[0].as_py()),
                     "word": words.view(np.int64), "n": n.astype(np.int64)})


def pair_counts(rows: DataFrame, classes: np.ndarray) -> np.ndarray:
    """How often each id follows each class, over all training documents: ids by classes."""
    end = len(classes) - 1

    def count(batches):
        total = np.zeros(len(classes) * CLASSES, np.int64)
        for ids, o in id_blocks(batches, end):
            before = np.append(0, classes[ids[:-1]])
            before[o[:-1]] = 0
            np.add.at(total, ids * CLASSES + before, 1)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], ["key", "n"])

    found = (rows.filter(~F.col("held_out")).select("ids").mapInArrow(count, "key long, n long")
             .groupBy("key").agg(F.sum("n").alias("n")).toArrow())
    out = np.zeros(len(classes) * CLASSES, np.float32)
    out[found.column("key").to_numpy()] = found.column("n").to_numpy()
    return out.reshape(len(classes), CLASSES)


def id_blocks(batches, end: int):
    """Ids of rows laid end to end, block by block, with the end ids, and the rows' offsets."""
    for batch in batches:
        data, offsets = utf8(batch.column("ids"))
        for lo, hi in blocks(offsets, 1 << 20):
            yield with_end(data[offsets[lo]:offsets[hi]], offsets[lo:hi + 1] - offsets[lo], end)


def id_counts(rows: DataFrame, end: int) -> np.ndarray:
    """How often each id is in the rows; the end id is not counted."""

    def count(batches):
        total = np.zeros(end + 1, np.int64)
        for ids, _ in id_blocks(batches, end):
            total += np.bincount(ids, minlength=end + 1)
        total[end] = 0
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], ["key", "n"])

    found = (rows.select("ids").mapInArrow(count, "key long, n long")
             .groupBy("key").agg(F.sum("n").alias("n")).toArrow())
    out = np.zeros(end + 1, np.int64)
    out[found.column("key").to_numpy()] = found.column("n").to_numpy()
    return out


def pack(total: np.ndarray) -> bytes:
    """Counts that are not zero: steps between their places, then the counts."""
    used = np.flatnonzero(total)
    return zlib.compress(np.diff(used, prepend=0).astype("<u4").tobytes() + total[used].astype("<i8").tobytes(), 1)


def unpack(packed: bytes) -> tuple[np.ndarray, np.ndarray]:
    raw = zlib.decompress(packed)
    n = len(raw) // 12
    return np.cumsum(np.frombuffer(raw, "<u4", n), dtype=np.int64), np.frombuffer(raw, "<i8", n, 4 * n)


def neighbour_counts(rows: DataFrame, slot: np.ndarray) -> np.ndarray:
    """The ``neighbours`` of each id over all rows; they travel as packed blocks of ids."""
    end, per = len(slot) - 1, 1024

    def count(batches):
        total = np.zeros((end + 1, 2 * SLOTS), np.int64)
        for ids, _ in id_blocks(batches, end):
            neighbours(total, np.append(end, ids), slot)
        for k in range(0, end + 1, per):
            if total[k:k + per].any():
                yield pa.RecordBatch.from_arrays(
                    [pa.array([k]), pa.array([pack(total[k:k + per].reshape(-1))])], ["first", "packed"])

    def add(block: pa.Table) -> pa.Table:
        total = np.zeros(per * 2 * SLOTS, np.int64)
        for x in block.column("packed"):
            at, n = unpack(x.as_py())
            total[at] += n
        return pa.table({"first": block.column("first")[:1], "packed": [pack(total)]})

    found = (rows.select("ids").mapInArrow(count, "first long, packed binary").groupBy("first")
             .applyInArrow(add, "first long, packed binary").toLocalIterator())
    out = np.zeros((end + 1, 2 * SLOTS), np.int64)
    for r in found:
        at, n = unpack(r.packed)
        out.reshape(-1)[r.first * 2 * SLOTS + at] = n
    return out


def fit_all(model: Attention, rows: DataFrame, classes: np.ndarray, rounds: int = 1) -> int:
    """Train on every id of the rows, once; returns how many ids that were.

    Rows are dealt over groups of about ``GROUP_BYTES``, and each group over ``rounds``, by a hash of id and
    ids, wherever they lie. In a round each group trains a copy of the model in the order of the hashes.
    Then the copies meet: weights, Adam's running means and its steps become the means of the copies',
    weighted by their ids, and the next round's copies go on from there. Only sums of these leave a task.
    """
    spark, end = rows.sparkSession, len(classes) - 1
    size, trained = rows.select(F.sum(F.length("ids"))).first()[0] or 0, 0
    adam, groups = Adam(model), size // GROUP_BYTES + 1

    def learner(state):
        def learn(group: pa.Table) -> pa.Table:
            kinds, parts, *means = state.value
            own, seen = Attention(dict(parts)), 0
            adam = Adam(own, *means)
            ordered = group.sort_by([("h", "ascending"), ("ids", "ascending")]).combine_chunks()
            for ids, o in id_blocks(ordered.to_batches(), end):
                own.train(adam, *windows_of(kinds[ids], o, CONTEXT))
                seen += len(ids)
            total = np.concatenate([own.flat(), adam.m, adam.s, [adam.t, 1.0]]) * seen
            return pa.table({"key": np.arange(len(total)), "w": total})

        return learn

    h = F.xxhash64("doc_id", "ids")
    # groups go by the whole hash, rounds by its upper bits alone
    dealt = rows.select("ids", h.alias("h"), F.pmod(h, F.lit(groups)).alias("group"),
                        F.pmod(F.shiftright(h, 33), F.lit(rounds)).alias("round"))
    for k in range(rounds):
        part = dealt.filter(F.col("round") == k).drop("round")
        state = spark.sparkContext.broadcast((classes, model.parts, adam.m, adam.s, adam.t))
        found = (part.groupBy("group").applyInArrow(learner(state), "key long, w double")
                 .groupBy("key").agg(F.sum("w").alias("w")).orderBy("key").toArrow())
        state.destroy()
        total = found.column("w").to_numpy()
        if not len(total):
            continue
        trained += int(total[-1])
        weights, m, s, t = np.split(total[:-1] / total[-1], np.cumsum([len(adam.m)] * 3))
        model.parts = {n: v.astype(np.float32) for n, v in model.shaped(weights).items()}
        adam.m, adam.s, adam.t = m.astype(np.float32), s.astype(np.float32), float(t[0])
    return trained


def finder(word: np.ndarray):
    """``np.searchsorted`` in sorted evenly spread hashes, of which the last is the highest there is."""
    shift = np.uint64(63 - min(len(word).bit_length(), 24))
    edge = np.searchsorted(word, np.arange(1 << 64 - int(shift), dtype=np.uint64) << shift)

    def find(h: np.ndarray) -> np.ndarray:
        at = edge[h >> shift]
        low = np.flatnonzero(word[at] < h)
        while len(low):
            at[low] += 1
            low = low[word[at[low]] < h[low]]
        return at

    return find


def with_end(data: np.ndarray, offsets: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """16-bit ids of texts laid end to end, each with the end id behind it, and their offsets."""
    ids = np.frombuffer(data.tobytes(), "<u2").astype(np.int64)
    o = offsets // 2
    return np.insert(ids, o[1:], end), o + np.arange(len(o))


def id_share(counts: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """log10 probability of each id, given its own class and the class before it."""
    single = counts.sum(1, dtype=np.float64)
    in_class = np.bincount(classes, weights=single, minlength=CLASSES)
    members = np.bincount(classes, minlength=CLASSES)
    plain = (single + ALPHA) / (in_class + ALPHA * members)[classes]
    pairs = np.zeros((CLASSES, CLASSES))
    np.add.at(pairs, classes, counts)
    return np.log10((counts + KAPPA * plain[:, None]) / (pairs[classes] + KAPPA)).astype(np.float32)


def score_texts(docs: DataFrame, tokenizer: str) -> DataFrame:
    """One row per document: ``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score``.

    Words are counted over all training documents; a chunk of texts meets the counts of its own
    distinct words only. The model gives log10 P of the lower-cased words, one space between,
    and the end. The attention model gives the class of a word's first id in the context of the
    ids before. Within that class a word has its share of the training words, mixed with its
    spelling: the classes of its ids by the attention model, the ids' shares in their classes,
    and stopping there. Counts, shares, classes and attention weights are over all training
    documents.

    A null or empty text is its end alone. Without training documents all counts are zero.
    """
    table = encoded(docs, tokenizer)
    spark = docs.sparkSession
    names = encoder(tokenizer, True).tokenizer
    vocabulary = names.get_vocab_size()
    space = byte_letters()[0x20]
    begins = np.array([(names.id_to_token(k) or "").startswith(space) for k in range(vocabulary)])
    training = table.filter(~F.col("held_out"))
    id_n = id_counts(training, vocabulary)
    classes = token_classes(id_n, neighbour_counts(training, slots(id_n)), begins)
    model = Attention.fresh()
    fit_all(model, training, classes, ROUNDS)
    pairs = pair_counts(table, classes)
    # a word has one id that starts it, so these are the words of each class of starts
    in_class = np.bincount(classes, weights=pairs.sum(1, dtype=np.float64), minlength=CLASSES)
    fitted = spark.sparkContext.broadcast((classes, model.parts, id_share(pairs, classes)))

    local = saved(table.select("chunk", "held_out", "text").groupBy("chunk")
                  .applyInArrow(chunk_words, "chunk long, word long, n long"), "lm-words")
    counts = local.groupBy("word").agg(F.sum("n").alias("c")).filter("c > 0")
    totals = counts.agg(*(F.coalesce(x, F.lit(0)).alias(k) for k, x in {
        "n": F.sum("c"), "v": F.count(F.lit(1)), "once": F.count_if(F.col("c") == 1)}.items())).first()
    end_count = training.count()
    n_all, v_all = totals.n + end_count, totals.v + (end_count > 0)
    unseen = float(np.clip(totals.once / max(n_all, 1), 0.001, 0.5))
    known = local.join(counts, "word").select("chunk", "word", "c")

    def score(chunk: pa.Table, right: pa.Table) -> pa.Table:
        classes, parts, shares = fitted.value
        attention = Attention(parts)
        word = right.column("word").to_numpy().view(np.uint64)
        order = np.argsort(word)
        word = np.append(word[order], np.uint64(0xFFFFFFFFFFFFFFFF))
        c = np.append(right.column("c").to_numpy()[order], 0)
        find = finder(word)
        n = chunk.num_rows
        out = {k: np.zeros(n, t) for k, t in (("n_tokens", np.int64), ("n_known", np.int64),
                                              ("base_score", float), ("score", float))}
        end_log = np.log10((end_count + 1) / (n_all + v_all + 1))
        counted, words_before = [], np.zeros(n + 1, np.int64)
        for lo, hi, h, bounds in words_in(chunk):
            at = find(h)
            seen = np.where(word[at] == h, c[at], 0)
            doc = np.repeat(np.arange(hi - lo), np.diff(bounds))
            logs = np.log10((seen + 1) / (n_all + v_all + 1))
            out["n_tokens"][lo:hi] = np.diff(bounds) + 1
            out["n_known"][lo:hi] = np.bincount(doc, seen > 0, hi - lo) + (end_count > 0)
            out["base_score"][lo:hi] = np.bincount(doc, logs, hi - lo) + end_log
            counted.append(seen)
        counted = np.concatenate(counted)
        words_before[1:] = np.cumsum(out["n_tokens"] - 1)
        data, offsets = utf8(chunk.column("ids").combine_chunks())
        for lo, hi in blocks(offsets, 1 << 18):
            ids, o = with_end(data[offsets[lo]:offsets[hi]], offsets[lo:hi + 1] - offsets[lo], len(classes) - 1)
            kinds = classes[ids]
            before = np.append(0, kinds[:-1])
            before[o[:-1]] = 0
            inputs, targets, scored = windows_of(kinds, o)
            new = scored[:, -STEP:]
            parts_of = [[x[new[k:k + 256]] for x in attention.log_probabilities(
                inputs[k:k + 256], targets[k:k + 256], STEP)] for k in range(0, len(inputs), 256)]
            logs, outer = (np.concatenate(x).astype(float) for x in zip(*parts_of, strict=True))
            first = np.flatnonzero(kinds < INNER)
            kind = logs[first] - outer[first]
            logs[first] = 0
            spelled = np.add.reduceat(logs + shares[ids, before] * np.log(10), first)
            goes_on = ids[first] != len(classes) - 1
            spelled[goes_on] += outer[first[1:]][goes_on[:-1]]
            seen = np.insert(counted[words_before[lo]:words_before[hi]],
                             words_before[lo + 1:hi + 1] - words_before[lo], end_count)
            size = in_class[kinds[first]]
            with np.errstate(divide="ignore"):
                whole = np.log((1 - unseen) * seen / np.maximum(size, 1))
            spelled += np.where(size > 0, np.log(unseen), 0)
            logs = (kind + np.logaddexp(whole, spelled)) / np.log(10)
            doc = np.repeat(np.arange(hi - lo), np.diff(words_before[lo:hi + 1]) + 1)
            out["score"][lo:hi] = np.bincount(doc, logs, hi - lo)
        return pa.table({"doc_id": chunk.column("doc_id"), "held_out": chunk.column("held_out"),
                         **out, "train_tokens": np.full(n, n_all)})

    return (table.groupBy("chunk").cogroup(known.groupBy("chunk")).applyInArrow(
        score, "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, "
               "score double, train_tokens long")
        .select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"))

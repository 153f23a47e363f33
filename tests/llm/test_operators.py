"""The corpus operators against brute-force versions on small documents."""

from __future__ import annotations

import hashlib
import json
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tests.llm.corpus import SCHEMA, awkward, frame, lower, prose, remainder, texts, words
from vitalspark.llm import (
    attention, bpe, classifier, exact, licenses, near, packing, phrases, rules, scoring, search,
    suffixes, tokens, trie,
)
from vitalspark.llm import words as words_of
from vitalspark.llm.words import WordEncoder

WORD = public_tokenizers.path("word_bpe_49k.json")
BYTE = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def docs(spark):
    return frame(spark, texts())


def rows(df):
    return sorted(df.collect(), key=lambda r: tuple((x is not None, str(type(x)), x) for x in r[:2]))


def by_id(df):
    return {r.doc_id: r for r in df.collect()}


def ids_of(path):
    tokenizer = Tokenizer.from_file(path)
    return lambda t: [*tokenizer.encode(t or "", add_special_tokens=False).ids, 2]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


ODD = ["", "a", " a", "a ", "A  b", "don't", "...", "x,y, z.", "\n", "\n\n", "a\n", "\na", "a \nb", "a\n b",
       "12,5. 3.", "É.", "été.", "ΣΑΣ. ΟΔΟΣ", "İstanbul", " x", "x y", "a\tb", "a\x1cb",
       "\x85", "they're.", "ß ª", "😀.", "<|endoftext|>", "!? !?", "a" * 300, "a\r\nb", "́x y"]


@pytest.mark.parametrize(("path", "byte_level"), [(WORD, False), (BYTE, True)])
def test_words_give_the_ids_of_whole_texts(path, byte_level):
    encoder = WordEncoder(path, byte_level)
    whole = ids_of(path)
    marked = ["İ.", "BİLGİ.", "Aİ!", "x<|startoftext|>y", "ς. Σ.", "ŉ.", "ǰ!", "ΐ,", "İ\u0307.", "a\u200d.", "İ<|endoftext|>"]
    for t in [*ODD, *marked, *(t or "" for t in texts()), *odd_texts(6000, 5), *odd_texts(6000, 6)]:
        assert np.frombuffer(encoder.encode(t), "<u4").tolist() == whole(t)[:-1], t


# packing

def test_fill_comes_closest():
    rng = random.Random(4)
    for _ in range(60):
        counts = {rng.randint(1, 30): rng.randint(1, 3) for _ in range(5)}
        room = rng.randint(1, 80)
        sums = {0}
        for length, n in counts.items():
            sums = {s + length * k for s in sums for k in range(n + 1)}
        need = packing.fill(counts, room)
        assert all(v <= counts[k] for k, v in need.items())
        assert sum(k * v for k, v in need.items()) == max(s for s in sums if s <= room)


def test_plan_places_every_id_once():
    rng = random.Random(5)
    for counts in ({}, {7: 1}, {60: 9}, {33: 100}, {rng.randint(1, 64): rng.randint(1, 9) for _ in range(30)}):
        made = packing.plan(counts, 64)
        length = np.repeat(list(counts), list(counts.values())).astype(np.int64)
        rank = np.concatenate([np.arange(n) for n in counts.values()] or [np.zeros(0)]).astype(np.int64)
        at, start, n, sequence, offset = packing.place(made.arrays(), length, rank)
        cells = [(s, o + k) for s, o, m in zip(sequence, offset, n, strict=True) for k in range(m)]
        assert len(set(cells)) == len(cells) == sum(k * v for k, v in counts.items())
        parts = [(a, b + k) for a, b, m in zip(at, start, n, strict=True) for k in range(m)]
        assert len(set(parts)) == len(parts)
        sizes = Counter(s for s, _ in cells)
        assert all(v == 64 or v & (v - 1) == 0 for v in sizes.values())
        assert sum(v < 64 for v in sizes.values()) <= 6
        assert {s: set(range(v)) for s, v in sizes.items()} == {
            s: {o for t, o in cells if t == s} for s in sizes}


@pytest.mark.parametrize("capacity", [64, 4096])
def test_pack(spark, docs, capacity):
    got = packing.pack(docs, WORD, capacity).collect()
    whole = ids_of(WORD)
    expected = {r.doc_id: whole(r.text) for r in docs.collect()}
    found = {}
    for r in sorted(got, key=lambda r: (r.doc_id, r.start)):
        assert r.doc_tokens == len(expected[r.doc_id]) and r.start == len(found.setdefault(r.doc_id, []))
        assert len(r.ids) == 4 * r.length
        found[r.doc_id] += np.frombuffer(r.ids, "<u4").tolist()
    assert found == expected
    ends = {}
    for r in sorted(got, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == ends.get(r.sequence_id, 0)
        ends[r.sequence_id] = r.offset + r.length
    assert all(n == capacity or n & (n - 1) == 0 for n in ends.values())


def test_pack_odd_rows(spark):
    got = packing.pack(awkward(spark), WORD).collect()
    assert len(got) == 8 and Counter(r.doc_id for r in got)[3] == 2
    assert packing.pack(frame(spark, []), WORD).collect() == []


# token files

def test_token_files(spark, docs, tmp_path):
    path = str(tmp_path / "tokens")
    tokens.write_tokens(docs, path, BYTE)
    whole, before = ids_of(BYTE), 0
    got = by_id(tokens.token_digests(spark, path))
    index = by_id(tokens.token_index(spark, path))
    for r in sorted(docs.collect(), key=lambda r: r.doc_id):
        ids = whole(r.text)
        assert tuple(got[r.doc_id]) == (r.doc_id, before, len(ids), crc(ids))
        assert (index[r.doc_id].start, index[r.doc_id].n_tokens) == (before, len(ids))
        before += len(ids)
    one = tokens.read_tokens(spark, path).filter("doc_id = 9").select("ids").collect()
    assert list(one[0].ids) == whole(texts()[9])


def test_token_files_layout_and_odd_rows(spark, tmp_path):
    import pyarrow.parquet as pq

    path = str(tmp_path / "tokens")
    tokens.write_tokens(awkward(spark), path, BYTE)
    assert len(tokens.token_digests(spark, path).collect()) == 8
    column = pq.ParquetFile(next((tmp_path / "tokens").glob("*.parquet"))).metadata.row_group(0)
    kinds = {column.column(k).path_in_schema: column.column(k) for k in range(column.num_columns)}
    assert any("DICTIONARY" in e for e in kinds["ids.list.element"].encodings)
    assert "DELTA_BINARY_PACKED" in kinds["n_tokens"].encodings
    assert kinds["doc_id"].has_column_index and kinds["doc_id"].has_offset_index
    empty = str(tmp_path / "none")
    tokens.write_tokens(frame(spark, []), empty, BYTE)
    assert tokens.token_digests(spark, empty).collect() == []


# repeated strings

def brute_repeats(values, width):
    seen, out = set(), {}
    for k, t in enumerate(values):
        raw = (t or "").encode()
        gone = bytearray(len(raw))
        for p in range(len(raw) - width + 1):
            w = raw[p:p + width]
            if w in seen:
                gone[p:p + width] = b"\1" * width
            seen.add(w)
        kept = bytes(b for b, g in zip(raw, gone, strict=True) if not g)
        out[k] = (len(raw), sum(gone), len(re.findall(b"\1+", bytes(gone))), kept)
    return out


@pytest.mark.parametrize(("width", "chunk"), [(100, 3000), (100, 1 << 20), (20, 2000)])
def test_repeated_spans(spark, docs, monkeypatch, width, chunk):
    monkeypatch.setattr(suffixes, "CHUNK_BYTES", chunk)
    got = by_id(suffixes.repeated_spans(docs, width, rounds=3))
    assert {k: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for k, r in got.items()} == brute_repeats(texts(), width)


def test_repeats_odd_rows(spark):
    for modulus, member in suffixes.COVERS.items():
        assert {(a - b) % modulus for a in member for b in member} == set(range(modulus))
    assert suffixes.repeated_spans(frame(spark, [])).collect() == []
    assert suffixes.repeated_spans(awkward(spark)).count() == 8
    text = prose(random.Random(3), 40)
    cut = suffixes.without_repeats(frame(spark, [text, "new " + text]))
    assert cut.columns == [f.split()[0] for f in SCHEMA.split(", ")]
    assert sorted((r.doc_id, r.text, r.n_chars, r.kept) for r in cut.collect()) == [
        (0, text, len(text), "x"), (1, "new ", 4, "x")]


# rules

def brute_counts(t):
    w = words(t)
    grams = Counter(tuple(w[i:i + 3]) for i in range(len(w) - 2))
    marked = {i + j for i in range(len(w) - 2) if grams[tuple(w[i:i + 3])] > 1 for j in range(3)}
    lines = [x for x in (t or "").split("\n") if words(x)]
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t or ""), len(lines) - len(set(lines)), len(marked))


def test_text_counts(docs):
    got = by_id(rules.text_counts(docs))
    for k, t in enumerate(texts()):
        r = got[k]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute_counts(t)


def labelled(spark, seed=3, n=240):
    rng = random.Random(seed)
    values, marks = [], []
    for k in range(n):
        bad = k % 4 == 0
        t = prose(rng, rng.randint(60, 120))
        values.append(" ".join(w + "###" for w in t.split(" ")) if bad else t)
        marks.append((k, 0 if bad else 1, 0))
    marks += [(None, 1, 0), (5, None, 0)]
    return frame(spark, values), spark.createDataFrame(marks, "doc_id long, quality int, toxic int")


def test_quality_rules(spark):
    docs, labels = labelled(spark)
    got = by_id(rules.quality_rules(docs, labels))
    assert all(got[k].kept == (k % 4 != 0) for k in range(240) if not got[k].base_failed)
    assert sum(not r.base_failed for r in got.values()) > 200
    none = rules.quality_rules(awkward(spark), labels.limit(0)).collect()
    assert len(none) == 8 and not any(r.kept for r in none) and all(r.base_failed for r in none)
    assert rules.quality_rules(frame(spark, []), labels).collect() == []


def test_rule_columns_say_what_the_list_says(spark):
    list_ = [(rules.Condition("symbols_per_word", True, 0.5),),
             (rules.Condition("upper_per_char", True, 0.2), rules.Condition("chars_per_word", False, 9.0))]
    counts = rules.text_counts(frame(spark, ["a# b#", "ABC def", "plain words"]))
    got = {r.doc_id: r.rule for r in counts.select("doc_id", rules.as_column(list_).alias("rule")).collect()}
    assert got == {0: 1, 1: 2, 2: 0}


# exact copies

def test_exact(docs, spark):
    got = by_id(exact.exact_dedup(docs))
    norm = [re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for t in texts()]
    size = Counter(norm)
    for k, t in enumerate(norm):
        assert tuple(got[k]) == (k, norm.index(t), size[t], norm.index(t) == k, hashlib.sha256(t.encode()).hexdigest())
    odd = exact.exact_dedup(awkward(spark)).collect()
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.kept) for r in odd) == Counter([
        (None, 5, 3, False), (None, None, 1, True), (3, 3, 2, True), (3, 3, 2, True), (4, 4, 1, True),
        (4, 4, 1, True), (5, 5, 3, True), (6, 5, 3, False)])
    assert exact.exact_dedup(frame(spark, [])).collect() == []


def test_exact_splits_colliding_groups(spark, monkeypatch):
    from pyspark.sql import functions as F

    monkeypatch.setattr(exact.F, "md5", lambda c: F.lit("00" * 16))
    got = by_id(exact.exact_dedup(frame(spark, ["a", "b", "a", "c"])))
    assert {k: (r.keep_id, r.group_size) for k, r in got.items()} == {0: (0, 2), 1: (1, 1), 2: (0, 2), 3: (3, 1)}


def test_first_copies_keeps_columns(spark):
    kept = exact.first_copies(awkward(spark))
    assert kept.columns == awkward(spark).columns
    assert Counter((r.doc_id, r.text) for r in kept.collect()) == Counter([
        (None, "same null id"), (3, "twice the same row"), (4, "one id"), (4, "other text of that id"), (5, "")])


# near copies

def brute_near(values):
    sets, parent = {}, {}
    for k, t in enumerate(values):
        w = words(lower(t))
        sets[k] = {tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
        parent[k] = k

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sets:
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((top(a), top(b)))
                parent[y] = x
    return {k: (len(sets[k]), top(k)) for k in sets}


def chain(seed=8):
    """Texts of which each is near the next, but not near the one after."""
    rng = random.Random(seed)
    now, out = prose(rng, 120).split(" "), []
    for _ in range(14):
        out.append(" ".join(now))
        now = now[10:] + [f"new{rng.random()}" for _ in range(10)]
    return out


def test_near(docs, spark):
    for values in (texts(), chain()):
        got = by_id(near.near_dedup(frame(spark, values)))
        assert {k: (r.n_shingles, r.component_id) for k, r in got.items()} == brute_near(values)
        assert all(r.kept == (r.doc_id == r.component_id) for r in got.values())


def test_near_odd_rows(spark):
    assert near.near_dedup(frame(spark, [])).collect() == []
    assert near.near_dedup(awkward(spark)).count() == 8
    kept = near.representatives(awkward(spark))
    assert kept.columns == awkward(spark).columns and kept.count() == 8


def test_near_repeated_and_null_ids(spark):
    """Every row is compared by its own text: [a], [b] share id 1, [near b] is 3, two near copies have no id."""
    rng = random.Random(31)
    a, b, c = (prose(rng, 90).split(" ") for _ in range(3))
    rows = [(1, a), (1, b), (3, ["new"] + b), (None, c), (None, c + ["end"]), (7, ["other"] + a), (None, a[:60]), (9, [])]
    docs = spark.createDataFrame([(k, " ".join(w), "x") for k, w in rows], "doc_id long, text string, source string")
    got = sorted((r.doc_id or 0, r.component_id or 0, r.kept) for r in near.near_dedup(docs).collect())
    assert [g for g in got if g[0]] == [(1, 1, True), (1, 1, True), (3, 1, False), (7, 1, False), (9, 9, True)]
    assert sorted(g[2] for g in got if not g[0]) == [False, True, True]
    kept = near.representatives(docs)
    assert kept.columns == docs.columns and kept.count() == 5


def test_near_family_of_uneven_copies(spark):
    """A family whose similarities lie on both sides of the threshold, cut into several slices and blocks."""
    rng = random.Random(32)
    base = prose(rng, 60).split(" ")
    values = []
    for _ in range(160):
        w = list(base)
        for _ in range(rng.randint(0, 5)):
            w[rng.randrange(len(w))] = f"new{rng.randrange(1000)}"
        values.append(" ".join(w))
    whole = brute_near(values)
    assert 3 < len({c for _, c in whole.values()}) < 150
    sizes = near.SLICE, near.SLICE_SHINGLES, near.BIN_ROWS, near.BIN_SHINGLES
    try:
        for near.SLICE, near.SLICE_SHINGLES, near.BIN_ROWS, near.BIN_SHINGLES in (sizes, (40, 3000, 4000, 60_000)):
            got = by_id(near.near_dedup(frame(spark, values)))
            assert {k: (r.n_shingles, r.component_id) for k, r in got.items()} == whole
    finally:
        near.SLICE, near.SLICE_SHINGLES, near.BIN_ROWS, near.BIN_SHINGLES = sizes


def test_registers_estimate_similarity():
    rng = np.random.default_rng(2)
    pool = rng.integers(0, 1 << 63, 4000, dtype=np.uint64)
    for overlap in (0.2, 0.5, 0.75, 0.9):
        shared = int(2000 * overlap * 2 / (1 + overlap))
        a, b = pool[:2000], pool[2000 - shared:4000 - shared]
        sets = np.concatenate([np.sort(a), np.sort(b)])
        r = near.registers(sets, np.array([0, 2000, 4000]))
        got = near.estimate(r[:1], r[1:], np.array([2000]), np.array([2000]))[0]
        assert abs(got - overlap) < 5 * math.sqrt(overlap * (1 - overlap) / near.BUCKETS)


def test_compressed_registers_keep_zeros_and_mantissa():
    low = np.array([1, 2, 3, (1 << 64) - 1, 1 << 63, (1 << 53) - 1, (1 << 54) - 1, 0x00F0_0000_0000_0000], np.uint64)
    for v, c in zip(low.tolist(), near.compressed(low).tolist(), strict=True):
        zeros = 64 - v.bit_length()
        assert c >> 10 == zeros
        assert c & 1023 == (v << (zeros + 1) & (1 << 64) - 1) >> 54


# language model

def test_scores(spark, docs):
    got = by_id(scoring.score_texts(docs, BYTE))
    split = {k: [*words(lower(t)), "\nend"] for k, t in enumerate(texts())}
    counts = Counter(w for k, ws in split.items() if remainder(k, 7) != 2 for w in ws)
    n, v = sum(counts.values()), len(counts)
    for k, ws in split.items():
        r = got[k]
        assert (r.held_out, r.n_tokens, r.train_tokens) == (remainder(k, 7) == 2, len(ws), n)
        assert r.n_known == sum(counts[w] > 0 for w in ws)
        assert r.base_score == pytest.approx(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in ws))
        assert r.score < 0 and math.isfinite(r.score)
    empty = got[0].score
    assert got[1].score == pytest.approx(empty) == pytest.approx(got[2].score)


def test_score_of_a_text_ignores_its_neighbours(spark):
    values = texts()
    one = by_id(scoring.score_texts(frame(spark, values), BYTE))
    two = by_id(scoring.score_texts(frame(spark, values).orderBy("text"), BYTE))
    assert all(one[k].score == pytest.approx(two[k].score, rel=1e-5) for k in one)


def test_scores_odd_rows(spark):
    assert scoring.score_texts(frame(spark, []), BYTE).collect() == []
    assert len(scoring.score_texts(awkward(spark), BYTE).collect()) == 8


def test_the_model_learns_from_all_training_ids(spark):
    rng = random.Random(12)
    values = [" ".join(rng.choice(["red", "blue", "tree", "stone"]) for _ in range(30)) for _ in range(400)]
    values.append("zebra quokka")
    table = scoring.encoded(frame(spark, values), BYTE)
    end = Tokenizer.from_file(BYTE).get_vocab_size()
    ids = [np.frombuffer(r.ids, "<u2").tolist() for r in table.collect()]
    counts = scoring.id_counts(table, end)
    flat = Counter(k for x in ids for k in x)
    assert {k: counts[k] for k in np.flatnonzero(counts)} == flat
    slot = attention.slots(counts)
    near = scoring.neighbour_counts(table, slot)
    want = Counter()
    for x in ids:
        line = [end, *x, end]
        for one, other in zip(line, line[1:], strict=False):
            want[one, slot[other]] += 1
            want[other, attention.SLOTS + slot[one]] += 1
    assert {k: near[k] for k in want if k[0] != end} == {k: n for k, n in want.items() if k[0] != end}
    # ids seen once have classes by their neighbours too
    classes = attention.token_classes(counts, near, np.ones(end, bool))
    assert all(classes[k] > 1 for k in flat)
    model = attention.Attention.fresh()
    assert scoring.fit_all(model, table, classes) == sum(len(x) + 1 for x in ids)


def test_the_model_is_the_mean_of_the_groups_models(spark, monkeypatch):
    monkeypatch.setattr(scoring, "GROUP_BYTES", 100_000)
    rng = np.random.default_rng(2)
    end = 40
    classes = np.append(np.arange(end) % (attention.CLASSES - 1) + 1, 0)
    # every id is followed by the next one, so context tells all but the first
    lines = [(np.arange(n) + s) % end for n, s in zip(rng.integers(1, 90, 3000), rng.integers(0, end, 3000), strict=True)]
    rows = spark.createDataFrame([(k, bytearray(x.astype("<u2").tobytes())) for k, x in enumerate(lines)],
                                 "doc_id long, ids binary").repartition(3)
    groups = sum(2 * len(x) for x in lines) // 100_000 + 1
    hashes = {r.doc_id: r.h for r in rows.select("doc_id", F.xxhash64("doc_id", "ids").alias("h")).collect()}
    model, fresh = attention.Attention.fresh(), attention.Attention.fresh()
    assert scoring.fit_all(model, rows, classes) == sum(len(x) + 1 for x in lines)
    total, seen = 0, 0
    assert groups > 2
    for group in range(groups):
        own = attention.Attention.fresh()
        data = [lines[k] for k in sorted(hashes, key=hashes.get) if hashes[k] % groups == group]
        ids, o = scoring.with_end(np.concatenate(data).astype("<u2").view(np.uint8),
                                  2 * np.cumsum([0, *map(len, data)]), end)
        own.train(attention.Adam(own), *attention.windows_of(classes[ids], o, attention.CONTEXT))
        total, seen = total + own.flat() * len(ids), seen + len(ids)
    assert np.allclose(model.flat(), total / seen, atol=1e-4)
    inputs, targets, scored = attention.windows_of(np.append(classes[(np.arange(64) + 7) % end], 0), np.array([0, 65]))
    gain = lambda m: m.log_probabilities(inputs, targets)[0][scored].mean()
    assert gain(model) > gain(fresh) + 0.5
    untouched = attention.Attention.fresh()
    assert scoring.fit_all(untouched, rows.limit(0), classes) == 0
    assert np.array_equal(untouched.flat(), fresh.flat())


def test_the_groups_models_meet_in_rounds(spark, monkeypatch):
    monkeypatch.setattr(scoring, "GROUP_BYTES", 50_000)
    rng = np.random.default_rng(8)
    end, rounds = 40, 3
    classes = np.append(np.arange(end) % (attention.CLASSES - 1) + 1, 0)
    lines = [(np.arange(n) + s) % end for n, s in zip(rng.integers(1, 90, 2000), rng.integers(0, end, 2000), strict=True)]
    rows = spark.createDataFrame([(k, bytearray(x.astype("<u2").tobytes())) for k, x in enumerate(lines)],
                                 "doc_id long, ids binary").repartition(3)
    groups = sum(2 * len(x) for x in lines) // 50_000 + 1
    hashes = {r.doc_id: r.h for r in rows.select("doc_id", F.xxhash64("doc_id", "ids").alias("h")).collect()}
    model = attention.Attention.fresh()
    assert scoring.fit_all(model, rows, classes, rounds) == sum(len(x) + 1 for x in lines)
    want = attention.Attention.fresh()
    adam, dealt = attention.Adam(want), 0
    for turn in range(rounds):
        total, seen = 0, 0
        for group in range(groups):
            data = [lines[k] for k in sorted(hashes, key=hashes.get)
                    if hashes[k] % groups == group and (hashes[k] >> 33) % rounds == turn]
            own = attention.Attention(dict(want.parts))
            mine = attention.Adam(own, adam.m, adam.s, adam.t)
            ids, o = scoring.with_end(np.concatenate(data).astype("<u2").view(np.uint8),
                                      2 * np.cumsum([0, *map(len, data)]), end)
            own.train(mine, *attention.windows_of(classes[ids], o, attention.CONTEXT))
            total = total + np.concatenate([own.flat(), mine.m, mine.s, [mine.t]]) * len(ids)
            seen, dealt = seen + len(ids), dealt + len(data)
        weights, m, s, t = np.split(total / seen, np.cumsum([len(adam.m)] * 3))
        want.parts = {k: v.astype(np.float32) for k, v in want.shaped(weights).items()}
        adam.m, adam.s, adam.t = m.astype(np.float32), s.astype(np.float32), t[0]
    assert dealt == len(lines) and groups > 2
    assert np.allclose(model.flat(), want.flat(), atol=1e-3)
    apart = attention.Attention.fresh()
    scoring.fit_all(apart, rows, classes)
    assert not np.allclose(model.flat(), apart.flat(), atol=0.02)


def test_hashes_are_found_as_by_binary_search():
    rng = np.random.default_rng(4)
    top = np.uint64(0xFFFFFFFFFFFFFFFF)
    for n in (0, 1, 5, 3000):
        word = np.append(np.unique(rng.integers(0, 1 << 64, n, np.uint64)), top)
        near_by = word[:-1] + np.uint64(1)
        h = np.concatenate([word, near_by, rng.integers(0, 1 << 64, 500, np.uint64), np.zeros(1, np.uint64)])
        assert (scoring.finder(word)(h) == np.searchsorted(word, h)).all()


def test_attention_gradients_and_causality():
    rng = np.random.default_rng(1)
    model = attention.Attention.fresh()
    inputs, targets = rng.integers(0, attention.CLASSES, (2, 3, attention.CONTEXT))
    scored = np.ones(inputs.shape, bool)
    model.parts = {k: v.astype(np.float64) for k, v in model.parts.items()}
    loss = lambda: -model.log_probabilities(inputs, targets)[0].mean()
    for name, g in model.gradients(inputs, targets, scored).items():
        part = model.parts[name]
        at = np.unravel_index(np.abs(g).argmax(), g.shape)
        part[at] += 1e-5
        up = loss()
        part[at] -= 2e-5
        down = loss()
        part[at] += 1e-5
        assert g[at] == pytest.approx((up - down) / 2e-5, rel=1e-3)
    before = model.forward(inputs)[-1]
    inputs[:, 9:] = 0
    assert np.allclose(before[:, :9], model.forward(inputs)[-1][:, :9])


def test_windows_score_each_token_once():
    offsets = np.array([0, 1, 14, 14, 60])
    classes = np.arange(60) % 40
    inputs, targets, scored = attention.windows_of(classes, offsets)
    assert scored.sum() == 60 and sorted(targets[scored]) == sorted(classes)
    first = targets[scored].tolist()
    assert first == classes.tolist()
    before = [0 if k in offsets[:-1] else classes[k - 1] for k in range(60)]
    assert inputs[scored].tolist() == before
    # windows side by side, as in training
    inputs, targets, scored = attention.windows_of(classes, offsets, attention.CONTEXT)
    assert targets[scored].tolist() == classes.tolist() and inputs[scored].tolist() == before


# classifier

def test_the_quality_stage_drops_what_workers_remember_of_words(spark, monkeypatch):
    own = words_of.encoder(BYTE, True)
    before = own.encode("red blue tree red")
    assert len(own)
    words_of.forget()
    assert not own and not own.older and own.encode("red blue tree red") == before

    def told():
        raise RuntimeError("words are dropped")

    docs, labels = labelled(spark)
    monkeypatch.setattr(classifier, "forget", told)
    with pytest.raises(Exception, match="words are dropped"):
        classifier.good_documents(docs, labels).collect()


def test_classifier(spark):
    docs, labels = labelled(spark)
    got = by_id(classifier.quality_scores(docs, labels))
    assert all(0 <= r.score <= 1 and r.held_out == (remainder(k, 5) == 0) for k, r in got.items())
    assert all(r.predicted == (k % 4 != 0) for k, r in got.items())
    kept = classifier.good_documents(docs, labels)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {k for k in got if k % 4}


def test_classifier_odd_rows(spark):
    docs, labels = labelled(spark, n=40)
    assert len(classifier.quality_scores(awkward(spark), labels).collect()) == 8
    assert {r.score for r in classifier.quality_scores(docs, labels.filter("quality = 1")).collect()} == {0.5}
    assert classifier.quality_scores(frame(spark, []), labels).collect() == []
    assert classifier.good_documents(awkward(spark), labels.limit(0)).count() == 8


# byte-level BPE

@pytest.fixture(scope="module")
def ranks():
    return bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))


def reference(ranks):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe_round_trip(spark, docs, ranks):
    whole = reference(ranks)
    got = by_id(bpe.decode_ids(bpe.encode_texts(docs, ranks, public_tokenizers.PATTERN), ranks))
    for k, t in enumerate(texts()):
        ids = whole.encode_ordinary(t or "")
        assert np.frombuffer(got[k].ids, "<u4").tolist() == ids and got[k].n_tokens == len(ids)
        assert bytes(got[k].decoded) == (t or "").encode()


def test_bpe_odd_texts(spark, ranks):
    encoder, whole = bpe.Encoder(ranks, public_tokenizers.PATTERN), reference(ranks)
    values = [*ODD, "ab" * 3000, " " * 300, "é" * 200 + "\n\n  x", "!?" * 400]
    for t, ids in zip(values, encoder.encode(values), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == whole.encode_ordinary(t), t
    assert len(bpe.encode_texts(awkward(spark), ranks, public_tokenizers.PATTERN).collect()) == 8
    assert bpe.encode_texts(frame(spark, []), ranks, public_tokenizers.PATTERN).collect() == []


def test_higher_order_fold_makes_the_same_merges(spark, ranks):
    whole = reference(ranks)
    some = sorted({w for t in texts()[8:12] for w in re.findall(r" ?\w+", t)})[:60] + ["", "é", " 中文", "😀"]
    got = bpe.fold_words(spark, spark.createDataFrame([(w,) for w in some], "word string"), ranks)
    for r in got.collect():
        assert list(r.ids) == whole.encode_ordinary(r.word)


# licences

def test_licenses(spark):
    t = licenses.TEMPLATES
    rng = random.Random(6)
    files = {
        "a/LICENSE": t["MIT"], "a/b/one": prose(rng, 200), "a/b/two": prose(rng, 900) + "\n" + t["GPL-3.0"],
        "a/b/c/NOTICE": "Notice: " + t["Apache-2.0"].lower(), "a/b/c/three": prose(rng, 90), "d/four": prose(rng, 90),
        "d/none": None, "ab/five": prose(rng, 90), "six": "",
    }
    got = {r.path: (r.license, r.found_in, r.how) for r in licenses.scan(spark.createDataFrame(
        [(k, v, 1) for k, v in files.items()], "path string, text string, score int")).collect()}
    assert got["a/LICENSE"] == ("MIT", "a", "file")
    assert got["a/b/one"] == ("MIT", "a", "inherited")
    assert got["a/b/two"] == ("GPL-3.0", "a/b", "header")
    assert got["a/b/c/NOTICE"][0] == "Apache-2.0"
    assert got["a/b/c/three"] == ("Apache-2.0", "a/b/c", "inherited")
    assert all(got[p] == (None, None, None) for p in ("d/four", "d/none", "ab/five", "six"))
    none = spark.createDataFrame([], "path string, text string")
    assert licenses.scan(none).collect() == []
    odd = spark.createDataFrame([(None, None), (None, t["MIT"]), ("x", "y"), ("x", "y")], "path string, text string")
    assert Counter((r.path, r.license) for r in licenses.scan(odd).collect()) == Counter(
        {("", "MIT"): 2, ("x", "MIT"): 2})


def test_licenses_never_send_pairs_of_directories_to_the_driver(spark):
    files = spark.createDataFrame([(f"{i}/a/b/c", licenses.TEMPLATES["MIT"]) for i in range(20)], "path string, text string")
    found = licenses.scan(files)
    plan = found._jdf.queryExecution().executedPlan().toString()
    above = plan[:plan.index("Generate explode")]
    assert "Broadcast" not in above[above.rindex("Join "):] and above.rindex("SortMergeJoin ") > above.rfind("HashJoin ")
    assert {r.found_in for r in found.collect()} == {f"{i}/a/b" for i in range(20)}


def test_licenses_of_real_files(spark):
    rng = random.Random(7)
    wrapped = ["#!/bin/sh", "# This program is free software; you can redistribute it and/or modify",
               "# it under the terms of the GNU General Public License as published by",
               "# the Free Software Foundation; either version 2 of the License, or",
               "# (at your option) any later version.", ""]
    bsd = ["/* Redistribution and use in source and binary forms, with or without",
           " * modification, are permitted provided that the following conditions are met: */"]
    files = {
        "m/LICENSE": "MIT License\n\nCopyright (c) 2020 A. Person\n\n" + licenses.full_text("MIT"),
        "m/src/x": prose(rng, 60), "g/COPYING": licenses.full_text("GPL-3.0"), "g/x": prose(rng, 60),
        "a/LICENSE": licenses.full_text("Apache-2.0"), "w": "\n".join([*wrapped, prose(rng, 900)]),
        "b": "\n".join([*bsd, prose(rng, 900)]), "s": "// SPDX-License-Identifier: LGPL-2.1-or-later\n" + prose(rng, 90),
        "u": "// SPDX-License-Identifier: Unknown-1\n" + prose(rng, 90), "t": "The MIT License (MIT)\n" + prose(rng, 400),
        "n": prose(rng, 200) + "\nMIT\n" + prose(rng, 200),
        "p/x": prose(rng, 500) + "\n" + licenses.full_text("MPL-2.0") + "\n" + prose(rng, 9000),
    }
    got = {r.path: (r.license, r.how) for r in licenses.scan(
        spark.createDataFrame(list(files.items()), "path string, text string")).collect()}
    assert {k: v[0] for k, v in got.items()} == {
        "m/LICENSE": "MIT", "m/src/x": "MIT", "g/COPYING": "GPL-3.0", "g/x": "GPL-3.0", "a/LICENSE": "Apache-2.0",
        "w": "GPL-2.0", "b": "BSD-3-Clause", "s": "LGPL-2.1", "u": None, "t": "MIT", "n": None, "p/x": "MPL-2.0"}
    assert got["m/src/x"][1] == got["g/x"][1] == "inherited" and got["w"][1] == got["p/x"][1] == "header"


# the trie of distinct words

@pytest.fixture(scope="module")
def spec():
    return trie.read_spec(BYTE)


def odd_texts(n, seed=3):
    """Texts of special tokens, marks, white space of all kinds and characters of all planes."""
    rng = random.Random(seed)
    parts = [*"abcdeThe of\n\n  .,;'sé中😀İñΣǰ\x1c\x85\xa0 0123#*$<|>", "<|endoftext|>", " the", "'s", "aaaa", "\r\n", "\t", "ing", "́"]
    wide = [lambda: rng.randint(32, 126), lambda: rng.randint(0x80, 0x24F), lambda: rng.randint(0x250, 0xD7FF),
            lambda: rng.randint(0x10000, 0x1FFFF)]
    made = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 40))) for _ in range(n)]
    made += ["".join(chr(rng.choice(wide)()) for _ in range(rng.randint(0, 20))) for _ in range(n // 2)]
    return made + ["a" * 700, "ab" * 2000, "".join(rng.choice("etaoin") for _ in range(3000)), " " * 50 + "x"]


def test_trie_gives_the_ids_of_the_library(spec):
    encoder, whole = trie.Encoder(spec), Tokenizer.from_file(BYTE)
    for some in (ODD, [t or "" for t in texts()], odd_texts(3000), odd_texts(3000, 4)):
        for t, ids in zip(some, encoder.encode(some), strict=True):
            assert np.frombuffer(ids, "<u4").tolist() == whole.encode(t, add_special_tokens=False).ids, t


def test_trie_of_few_tokens_against_plain_merges():
    rng = random.Random(6)
    letters = dict(enumerate("abc"))
    for _ in range(30):
        vocab = {c: i for i, c in letters.items()}
        pairs = []
        while len(pairs) < 12:
            a, b = rng.choice(list(vocab)), rng.choice(list(vocab))
            if a + b not in vocab:
                vocab[a + b] = len(vocab)
                pairs.append((a, b))
        spec = {"added_tokens": [], "model": {"vocab": vocab, "merges": pairs}}
        made = trie.Trie(trie.Vocabulary(json.dumps(spec)))
        some = sorted({"".join(rng.choice("abc") for _ in range(rng.randint(1, 14))) for _ in range(300)})
        for word, ids in zip(some, made.encode([w.encode() for w in some]), strict=True):
            plain = list(word)
            while True:  # the lowest rank first, the leftmost of equals
                best = min(((pairs.index(p), k) for k, p in enumerate(zip(plain, plain[1:])) if p in pairs), default=None)
                if best is None:
                    break
                k = best[1]
                plain[k:k + 2] = [plain[k] + plain[k + 1]]
            assert np.frombuffer(ids, "<u4").tolist() == [vocab[t] for t in plain], word


def test_trie_round_trip(spark, docs, spec):
    found = trie.decode_ids(trie.encode_texts(docs, spec), spec).collect()
    whole, expected = Tokenizer.from_file(BYTE), {r.doc_id: r.text or "" for r in docs.collect()}
    assert {r.doc_id: r.decoded for r in found} == expected
    for r in found:
        ids = whole.encode(expected[r.doc_id], add_special_tokens=False).ids
        assert r.n_tokens == len(ids) and np.frombuffer(r.ids, "<u4").tolist() == ids
    cut = spark.createDataFrame([(1, 2, np.array([447, 50256], "<u4").tobytes())], "doc_id long, n_tokens long, ids binary")
    assert trie.decode_ids(cut, spec).first().decoded == whole.decode([447, 50256], skip_special_tokens=False)


def test_trie_odd_rows(spark, spec):
    found = trie.encode_texts(awkward(spark), spec).collect()
    assert Counter(r.doc_id for r in found) == {None: 2, 3: 2, 4: 2, 5: 1, 6: 1}
    assert {r.n_tokens for r in found if r.doc_id in (5, 6)} == {0}
    assert trie.encode_texts(frame(spark, []), spec).collect() == []


# ranked search

def search_by_hand(docs, items, top):
    """Every document scored for every item, without an index."""
    terms = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", lower(t))
    held = [(d, Counter(terms(t))) for d, t in docs]
    n, total = sum(bool(c) for _, c in held), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    out = []
    for item, text in items:
        found = []
        for d, c in held:
            m = 75 + 25 * sum(c.values()) * n // max(total, 1)
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1)))
                        * (1_000_000_000 * c[t] // (1000 * c[t] + 12 * m)) for t in terms(text))
            if score > 0:
                found.append((-score, d is None, d or 0, d))
        out += [(item, k + 1, d, -s) for k, (s, _, _, d) in enumerate(sorted(found)[:top])]
    return sorted(out, key=str)


@pytest.mark.parametrize(("shard_bytes", "top"), [(200, 3), (4000, 1), (1 << 22, 20)])
def test_search(spark, docs, monkeypatch, shard_bytes, top):
    monkeypatch.setattr(search, "SHARD_BYTES", shard_bytes)
    monkeypatch.setattr(search, "BLOCK_ITEMS", 40)
    given = [(r.doc_id, r.text) for r in docs.collect()]
    rng = random.Random(8)
    asked = [(k, " ".join(rng.sample((t or "").split(), min(len((t or "").split()), rng.randint(1, 25)))))
             for k, (_, t) in enumerate(given)]
    asked += [(None, "Word"), (7, "same id"), (8, ""), (9, None), (10, "zzzz"), (11, "word word WORD two")]
    items = spark.createDataFrame(asked, "item_id int, text string").withColumn("score", F.lit("clash"))
    found = [tuple(r) for r in search.ranked_search(docs, items, top).collect()]
    assert sorted(found, key=str) == search_by_hand(given, asked, top)


def test_search_odd_rows(spark):
    items = spark.createDataFrame([(1, "twice id null other")], "item_id long, text string")
    given = [(r.doc_id, r.text) for r in awkward(spark).collect()]
    found = [tuple(r) for r in search.ranked_search(awkward(spark), items).collect()]
    assert sorted(found, key=str) == search_by_hand(given, [(1, "twice id null other")], 20)
    assert search.ranked_search(frame(spark, []), items).collect() == []
    assert search.ranked_search(awkward(spark), items.limit(0)).collect() == []


def test_pair_bounds_hold_and_are_tighter():
    rng = np.random.default_rng(3)
    tighter = 0
    for _ in range(200):
        n, docs_n = int(rng.integers(1, 7)), 12
        impact = rng.integers(1, 100, (n, docs_n)) * (rng.random((n, docs_n)) < 0.4)
        c = rng.integers(1, 4, n)
        pairs = rng.permutation(n)[:n // 2 * 2].reshape(-1, 2)
        both = (impact[pairs[:, 0]] > 0) & (impact[pairs[:, 1]] > 0)
        joint = np.where(both, impact[pairs[:, 0]] + impact[pairs[:, 1]], 0).max(1, initial=0)
        groups, bound = search.bounds(c * impact.max(1), c, pairs, joint, impact.max(1))
        for (a, b), most in zip(groups.tolist(), bound.tolist(), strict=True):
            real = c[a] * impact[a] + (c[b] * impact[b] if b >= 0 else 0)
            assert real.max() <= most
        assert sorted(g for g in groups.ravel().tolist() if g >= 0) == list(range(n))
        tighter += bound.sum() < (c * impact.max(1)).sum()
    assert tighter > 100


# collocations

def phrases_by_hand(rows, longest, least, cover, top):
    counts, total = {}, Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower(text)):
            ws = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(ws)
            for k in range(1, longest + 1):
                for i in range(len(ws) - k + 1):
                    counts.setdefault(lang, Counter())[tuple(ws[i:i + k])] += 1
    out = []
    for lang, f in counts.items():
        made = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        found = []
        for p, a in made.items():
            inside = [a2 for q, a2 in made.items() if len(q) > len(p) and any(
                q[i:i + len(p)] == p for i in range(len(q)))]
            if not any(100 * a2 >= cover * a for a2 in inside):
                score, k = min((1_000_000 * a * a // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
                found.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        out += [(lang, n + 1, p.decode(), -a, l, r, total[lang], -s)
                for n, (s, a, p, l, r) in enumerate(sorted(found)[:top])]
    return sorted(out)


@pytest.mark.parametrize(("longest", "least", "share", "block"), [(3, 2, 1, 300), (3, 3, 4, 2000), (3, 2, 10 ** 9, 700),
                                                                  (2, 2, 2, 1 << 20)])
def test_phrases(spark, monkeypatch, longest, least, share, block):
    """Whole, partial and empty samples give the same phrases."""
    monkeypatch.setattr(phrases, "COUNT_BYTES", block)
    rng = random.Random(9)
    some = "New york  city\tnew york.São paulo,the of The of;中文 词!\n a a a a\x0b:b? b".split(" ")
    given = [(k, " ".join(rng.choice(some) for _ in range(rng.randint(0, 40))), rng.choice(["en", "de", None, "und", ""]))
             for k in range(60)]
    given += [(None, None, "en"), (3, "", None), (3, "york city York city york city", "xx"), (3, "york city York city york city", "xx")]
    docs = spark.createDataFrame(given, "doc_id long, text string, lang string").withColumn("phrase", F.lit("clash"))
    found = phrases.collocations(docs, longest=longest, least=least, top=7, share=share)
    assert sorted(map(tuple, found.collect())) == phrases_by_hand([(g, t) for _, t, g in given], longest, least, 50, 7)


def test_phrases_a_filter_holds_by_chance():
    """A phrase that an earlier filter held by chance, its words unknown then, opens its border later."""
    data = np.frombuffer(b"one two three", np.uint8)
    w = phrases.words_of(data, np.array([0, len(data)]), np.zeros(1, np.int64))
    lang = np.array([5], np.uint64)
    every = [level.hashes for level in phrases.walk(w, lang, 3, None, None, True)]
    place = {k: list(map(w.data[a:b].tobytes().decode().__eq__, ("one", "two", "three"))).index(True)
             for k, (a, b) in enumerate(w.spans)}
    one = next(k for k, v in place.items() if v == 0)

    def holding(hashes):
        found = phrases.BitFilter()
        for shift in (64 - phrases.FIELD, phrases.LOW):
            for at in (hashes >> np.uint64(shift) & np.uint64((1 << phrases.FIELD) - 1)).tolist():
                found.bits[at >> 6] |= np.uint64(1 << (at & 63))
        return found

    # "one" was not known, both phrases of two words seemed to be
    before = holding(np.concatenate([np.delete(every[0], one), every[1]]))
    known = holding(np.concatenate(every[:2]))
    counted = [list(level.hashes) for level in phrases.walk(w, lang, 3, before, None, True)]
    later = [list(level.hashes) for level in phrases.walk(w, lang, 3, known, before, False)]
    assert sorted(sum(counted + later, [])) == sorted(np.concatenate(every).tolist())


def test_phrases_odd_rows(spark):
    assert phrases.collocations(frame(spark, []), least=1).collect() == []
    given = [(r.lang, r.text) for r in awkward(spark).collect()]
    assert sorted(map(tuple, phrases.collocations(awkward(spark), least=1).collect())) == phrases_by_hand(given, 3, 1, 50, 2000)


def test_words_that_share_a_hash_are_told_apart():
    data = np.frombuffer(b"ab cd ab", np.uint8)
    starts, ends = np.array([0, 3, 6]), np.array([2, 5, 8])
    number, first = phrases._numbers(np.full(3, 7, np.uint64), starts, ends, np.zeros(3, np.int64), data)
    assert number[0] == number[2] != number[1] and sorted(first.tolist()) == [0, 1]

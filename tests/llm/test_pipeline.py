"""The pipeline's stages and the registered queries."""

from __future__ import annotations

import corpus_pipeline
from check_queries import compare, open_db
from tests.llm.corpus import frame, texts
from tests.llm.test_operators import brute_near, brute_repeats, ids_of, labelled
from vitalspark.llm.queries import ORACLE_SQL, QUERIES
from vitalspark.llm.common import saved


def test_names():
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality", "exact", "near", "suffix", "pack"]
    assert sorted(QUERIES, key=lambda n: int(n[2:].split("_")[0])) == list(QUERIES)
    assert len(QUERIES) == 13 and set(ORACLE_SQL) <= set(QUERIES)


def test_queries_with_sql(spark):
    folder = "/root/testdata/sf0.001"
    db = open_db(folder)
    for name, sql in ORACLE_SQL.items():
        rows, ok, note = compare(spark, db, folder, name, QUERIES[name], sql)
        assert ok and rows, note


def test_pipeline_against_brute_force(spark, tmp_path):
    from tests.llm.test_operators import WORD

    _, labels = labelled(spark, n=80)
    good, _ = labelled(spark, n=80)
    values = [r.text for r in sorted(good.collect(), key=lambda r: r.doc_id)] + [t for t in texts() if t and len(t.split()) > 30]
    docs = frame(spark, values)
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()

    kept = sorted(r.doc_id for r in corpus_pipeline.quality(spark, docs, str(tmp_path)).collect())
    assert not any(k % 4 == 0 for k in kept if k < 80)
    seen, first = set(), []
    for k in kept:
        t = " ".join(values[k].split())
        if t not in seen:
            first.append(k)
        seen.add(t)
    near = brute_near([values[k] for k in first])
    stay = [k for i, k in enumerate(first) if near[i][1] == i]
    cut = brute_repeats([values[k] for k in stay], 100)
    whole = ids_of(WORD)
    expected = {k: len(whole(cut[i][3].decode(errors="ignore"))) for i, k in enumerate(stay)}
    assert {r.doc_id: r.doc_tokens for r in got} == expected
    total = {}
    for r in got:
        total[r.doc_id] = total.get(r.doc_id, 0) + r.length
    assert total == expected


def test_stages_take_empty_tables(spark, tmp_path):
    _, labels = labelled(spark, n=8)
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    docs = frame(spark, [])
    for name, stage in corpus_pipeline.STAGES:
        found = saved(stage(spark, docs, str(tmp_path)), f"test-{name}")
        assert found.count() == 0
        assert name == "pack" or found.columns == docs.columns

"""Searches for tables of terms against plain LIKE, one term at a time."""

import random

from pyspark.sql import functions as F

from tests.conftest import TEST_DATA
from vitalspark.operators import equipment, term_search
from vitalspark.plans.catalog import load_all
from vitalspark.sources.domain import DomainTables

TERMS = "term string"


def like_pairs(spark, texts, terms, anywhere=True):
    """Every term against every text, which only a test may do."""
    out = set()
    held = spark.createDataFrame(texts, "id int, text string").cache()
    for term in {t for t in terms if t is not None}:
        pattern = f"%{term}%" if anywhere else f"{term}%"
        out |= {(term, r.id) for r in held.filter(F.like("text", F.lit(pattern))).collect()}
    return out


def test_terms_match_as_like_does(spark):
    rng = random.Random(2)
    alphabet = "ab%_c é\n"
    texts = [(k, "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 8)))) for k in range(60)]
    texts += [(1, "second text of an id"), (61, None), (62, ""), (63, "a\\b 100% _x")]
    terms = ["", "a", "%", "_", "ab", "a_c", "ab%c", "%%", "__", r"\%", r"a\_b", "abcab", "é", "\n", "zzz", None, "a", r"\\b", " x"]
    terms += ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 5))) for _ in range(25)]
    index = term_search.gram_index(spark.createDataFrame(texts, "id int, text string"))
    asked = spark.createDataFrame([(t,) for t in terms], TERMS)
    found = [tuple(r) for r in term_search.match_terms(index, asked).collect()]
    assert len(found) == len(set(found))
    assert set(found) == like_pairs(spark, texts, terms)
    starts = [tuple(r) for r in term_search.match_terms(
        term_search.gram_index(spark.createDataFrame([(i, None if t is None else "\x02" + t) for i, t in texts], "id int, text string")),
        asked.select(F.concat(F.lit("\x02"), "term").alias("term")), anywhere=False).collect()]
    assert {(t[1:], i) for t, i in starts} == like_pairs(spark, texts, terms, anywhere=False)


def test_no_terms_and_no_texts(spark):
    texts = spark.createDataFrame([(1, "abc")], "id int, text string")
    none = spark.createDataFrame([], TERMS)
    one = spark.createDataFrame([("b",)], TERMS)
    assert term_search.match_terms(term_search.gram_index(texts), none).collect() == []
    assert term_search.match_terms(term_search.gram_index(texts.limit(0)), one).collect() == []


def test_a_table_of_terms_gives_what_single_searches_give(spark):
    t = DomainTables(spark, str(TEST_DATA / "sf0.001"))
    terms = ["Brand#1", "ring", "%", "s", "00", " 0", "a", "UNITED", "003", "x_"]
    asked = spark.createDataFrame([(x,) for x in terms], TERMS)
    for many, single in ((term_search.search_library_terms, equipment.search_library),
                         (term_search.search_gyms_terms, equipment.search_gyms)):
        found = {}
        for r in many(t, asked).collect():
            found.setdefault(r.term, set()).add(r.id)
        assert found == {x: ids for x in terms if (ids := {r.id for r in single(t, x).collect()})}


def test_equal_names_and_brands_are_matched_once(spark):
    t = DomainTables(spark, str(TEST_DATA / "sf0.001"))
    library = t["equipment_library"]
    copies = library.unionByName(library.withColumn("id", F.col("id") + 1_000_000))
    asked = spark.createDataFrame([("Brand#1",), ("BRAND#1",), ("ring",), ("%",)], TERMS)
    found = term_search.search_library_terms({**{k: t[k] for k in ("gym_equipment", "gyms")}, "equipment_library": copies}, asked)
    one = term_search.search_library_terms(t, asked).collect()
    got = sorted((r.term, r.id) for r in found.collect())
    assert one and got == sorted((r.term, r.id + k) for r in one for k in (0, 1_000_000))
    # no entry is in the index, and no pair of term and entry is sorted or hashed to find equal ones
    text = term_search.gram_index(library.select(F.lower("name").alias("text")).unionAll(library.select(F.lower("name"))))
    assert text.columns == ["gram", "text"] and text.count() == text.distinct().count()


def test_no_comparison_of_every_term_with_every_text(spark):
    t = DomainTables(spark, str(TEST_DATA / "sf0.001"))
    asked = t["equipment_library"].select(F.substring("name", 2, 9).alias("term"))
    plan = term_search.search_library_terms(t, asked)._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_capped_searches_on_more_rows_than_the_cap(spark):
    folder = str(TEST_DATA / "sf0.01")
    catalog = load_all()
    for name, cap in (("search_library", 50), ("search_gyms", 20)):
        rows = catalog[name].frame(spark, folder).collect()
        assert len(rows) == cap < catalog[f"{name}_all"].frame(spark, folder).count()

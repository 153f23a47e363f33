"""Scalar rules on literal rows."""

import random
from datetime import datetime
from decimal import Decimal as D

import pytest
from pyspark.sql import functions as F

from vitalspark import functions as V
from vitalspark.functions.text import SPACES


def evaluate(spark, column):
    return spark.range(1).select(column).first()[0]


def lit(value, kind):
    return F.lit(value).cast(kind)


@pytest.mark.parametrize("s,d,label", [
    (119, 79, "Normal"), (125, 79, "Elevated"), (135, 95, "High Stage 1"), (165, 85, "High Stage 1"),
    (165, 95, "High Stage 2"), (None, 95, "High Stage 2"), (None, None, "Unknown"), (119, 80, "High Stage 1"),
])
def test_bp_class(spark, s, d, label):
    assert evaluate(spark, V.bp_class(lit(s, "smallint"), lit(d, "smallint"))) == label


@pytest.mark.parametrize("seconds,text", [(0, "00:00"), (299, "04:59"), (3700, "01:40"), (None, None)])
def test_pace(spark, seconds, text):
    assert evaluate(spark, V.pace_text(lit(seconds, "int"))) == text


def test_week_starts_monday(spark):
    got = [str(evaluate(spark, V.week_start(lit(d, "date")))) for d in ("2025-04-13", "2025-04-14")]
    assert got == ["2025-04-07", "2025-04-14"]


def test_round_to_int_rounds_half_away(spark):
    assert evaluate(spark, V.round_to_int(lit("2.5", "decimal(6,2)"))) == 3
    assert evaluate(spark, V.round_to_int(lit("-2.5", "decimal(6,2)"))) == -3


def test_units(spark):
    assert evaluate(spark, V.km_to_miles(lit("5.2", "decimal(7,2)"))) == D("3.23")
    assert evaluate(spark, V.metres_to_km(lit("1234.5", "decimal(8,1)"))) == D("1.23")
    assert evaluate(spark, V.kg_to_lbs(lit("85", "decimal(6,2)"))) == D("187.39")


def test_one_rep_max_needs_reps(spark):
    w = lit("185", "decimal(6,2)")
    assert evaluate(spark, F.round(V.one_rep_max(w, lit(8, "smallint")), 2)) == D("234.28")
    assert evaluate(spark, V.one_rep_max(w, lit(None, "smallint"))) is None


AS_OF = "2025-01-01"


@pytest.mark.parametrize("fields,local,want", [
    (("1700000000", None, None), None, datetime(2023, 11, 14, 22, 13, 20)),
    (("", "0", "1700000000"), None, datetime(2023, 11, 14, 22, 13, 20)),
    # present but unreadable: the other epoch fields are not tried
    (("soon", "1700000000", None), "2024-02-03 04:05:06", datetime(2024, 2, 3, 4, 5, 6)),
    (("soon", "1700000000", None), "yesterday", datetime(2025, 1, 1)),
    ((None, None, None), None, datetime(2025, 1, 1)),
    (("1700000000.5", None, None), None, datetime(2023, 11, 14, 22, 13, 20, 500000)),
])
def test_scale_time(spark, fields, local, want):
    column = V.parse_scale_time([lit(f, "string") for f in fields], lit(local, "string"), AS_OF)
    assert evaluate(spark, column) == want


@pytest.mark.parametrize("text,inside,word", [
    ("Nice machine", False, False), ("Glass press", True, False), ("D.A.M.N good", True, True),
    (None, False, False), ("", False, False), ("CRAP!", True, True),
])
def test_listed_words(spark, text, inside, word):
    c = lit(text, "string")
    assert evaluate(spark, V.contains_listed_word(c)) is inside
    assert evaluate(spark, V.contains_listed_word(c, whole_word=True)) is word


def test_listed_words_are_found_as_in_the_text_without_other_characters(spark):
    rng = random.Random(4)
    pieces = ["a", "s", "S", "d", "am", "n", "9", " ", ".", "-", "\u00a0", "\u00e9", "\u0130", "\u212a", "\U0001f600", "\n", "\x85"]
    texts = spark.createDataFrame([("".join(rng.choice(pieces) for _ in range(rng.randint(0, 14))),) for _ in range(3000)], "t string")
    plain = F.regexp_replace(F.lower("t"), f"[^a-z0-9{SPACES}]+", "")
    for words in (("ass", "damn", "a9"), ("s s", "A", "n.9", "asn"), ("n.9", "D"), ("",)):
        want = F.lit(False)
        for w in words:
            want = want | plain.contains(w)
        found = V.contains_listed_word(F.col("t"), words=words)
        got = texts.select("t", want.alias("want"), found.alias("found"))
        assert got.filter("want <> found").collect() == []
    plan = texts.select(V.contains_listed_word(F.col("t")))._jdf.queryExecution().toString()
    assert "regexp_replace" not in plan


def test_emails(spark):
    assert evaluate(spark, V.normalise_email(F.lit(" A@B.c "))) == "a@b.c"
    assert evaluate(spark, V.is_email(lit(None, "string"))) is False


def test_setting_values(spark):
    rows = spark.createDataFrame([('{"a": 1}',), ("plain",), ("null",), ("3",)], "v string")
    got = [r[0] for r in rows.select(F.to_json(V.setting_value(F.col("v")))).collect()]
    assert got == ['{"a":1}', '"plain"', "null", "3"]


def test_effective_oos(spark):
    def at(out, clear):
        return evaluate(spark, V.effective_oos(lit(out, "boolean"), lit(clear, "timestamp"), AS_OF))

    assert at(True, "2024-12-31") is False
    assert at(True, "2025-01-02") is True
    assert at(True, None) is True
    assert at(False, "2024-12-31") is False
    assert at(None, "2024-12-31") is None

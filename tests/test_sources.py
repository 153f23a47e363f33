"""Stored tables, scale readings and documents."""

import json
from datetime import datetime
from decimal import Decimal as D

from pyspark.sql import functions as F
import pytest

from tests.fixtures import make, sample_log
from vitalspark.operators import body_health
from vitalspark.plans import marts
from vitalspark.schemas import TABLE_DDL, table_schema
from vitalspark.sources import documents, scale, tables


def test_every_schema_parses(spark):
    assert all(table_schema(n).fields for n in TABLE_DDL)


def test_store_and_scan(spark, tmp_path):
    t = sample_log(spark)
    for name in ("workout_sessions", "workout_sets", "body_metrics", "users"):
        tables.store_table(t[name], str(tmp_path), name)
    got = tables.scan_all(spark, str(tmp_path), ["workout_sets", "body_metrics"])
    assert got["workout_sets"].count() == 7
    assert got["body_metrics"].schema["weight_lbs"].dataType.simpleString() == "decimal(6,2)"
    recent = got["body_metrics"].filter(F.col("month") == "2025-04").select("weight_lbs")
    plan = recent._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(month" in plan
    assert "ReadSchema: struct<weight_lbs:decimal(6,2)>" in plan


def stored_sessions(spark, root, days):
    rows = [(f"s{k}", "u", day, "Legs") for k, day in enumerate(days)]
    tables.store_table(
        make(spark, "workout_sessions", ["id", "user_id", "session_date", "name"], rows), root, "workout_sessions"
    )


def read_back(spark, root):
    got = tables.scan_table(spark, root, "workout_sessions").collect()
    return {r.id: (str(r.session_date), r.month) for r in got}


def test_a_stored_table_is_the_whole_truth(spark, tmp_path):
    stored_sessions(spark, str(tmp_path), ["2025-01-05", "2025-02-05"])
    stored_sessions(spark, str(tmp_path), ["2025-02-06"])
    assert read_back(spark, str(tmp_path)) == {"s0": ("2025-02-06", "2025-02")}


def test_changes_touch_the_named_months_alone(spark, tmp_path):
    root = str(tmp_path)
    stored_sessions(spark, root, ["2025-01-05", "2025-01-06", "2025-02-05", "2025-03-05", "2025-03-06"])
    march = sorted(p.name for p in (tmp_path / "workout_sessions/month=2025-03").glob("*.parquet"))

    def delete_and_move(old):
        moved = F.when(F.col("id") == "s2", F.lit("2025-01-31").cast("date")).otherwise(F.col("session_date"))
        return old.filter("id <> 's0'").withColumn("session_date", moved)

    tables.change_months(spark, root, "workout_sessions", ["2025-01", "2025-02"], delete_and_move)
    assert read_back(spark, root) == {
        "s1": ("2025-01-06", "2025-01"), "s2": ("2025-01-31", "2025-01"),
        "s3": ("2025-03-05", "2025-03"), "s4": ("2025-03-06", "2025-03"),
    }
    assert march == sorted(p.name for p in (tmp_path / "workout_sessions/month=2025-03").glob("*.parquet"))
    with pytest.raises(ValueError):
        tables.change_months(spark, root, "workout_sessions", ["2025-02"], lambda old: old.unionByName(
            tables.scan_table(spark, root, "workout_sessions").drop("month")))


def test_marts_shrink(spark, tmp_path):
    t = sample_log(spark)
    path = marts.publish_mart("weight_trend", t, str(tmp_path))
    less = {**t, "body_metrics": t["body_metrics"].filter("measurement_date < '2025-04-15'")}
    kept = spark.read.parquet(path).filter("measurement_date < '2025-04-15'").count()
    marts.publish_mart("weight_trend", less, str(tmp_path), months=["2025-04"])
    assert spark.read.parquet(path).count() == kept
    marts.publish_mart("weight_trend", t, str(tmp_path))
    marts.publish_mart("weight_trend", less, str(tmp_path))
    assert spark.read.parquet(path).count() == kept


def test_publish_marts(spark, tmp_path):
    t = sample_log(spark)
    paths = marts.publish_marts(t, str(tmp_path), ["daily_nutrition", "weight_trend", "exercise_prs"])
    assert spark.read.parquet(paths["weight_trend"]).count() == 5
    assert spark.read.parquet(paths["exercise_prs"]).count() == 3
    with pytest.raises(ValueError):
        marts.publish_mart("gym_equipment_detail", t, str(tmp_path))
    first = marts.ordered("weight_trend", t).first()
    assert str(first.measurement_date) == "2025-04-15"


READING = {
    "timeStamp": 1700000000, "weight": 85, "bodyfat": 19.25, "muscle": "40.5", "bone": 0, "water": "",
    "visfat": 7.9, "bmi": "24.1", "bmr": 1800, "bodyage": 30,
}


def read(spark, *readings):
    lines = spark.createDataFrame(
        [(i, "r1", json.dumps(r)) for i, r in enumerate(readings)], "arrival int, renpho_user_id string, value string"
    )
    return scale.read_scale_measurements(
        scale.reading_columns(lines), "2025-01-01", "arrival", "renpho_user_id"
    ).orderBy("arrival").collect()


def test_scale_reading(spark):
    row = read(spark, READING)[0]
    assert row.measured_at == datetime(2023, 11, 14, 22, 13, 20)
    assert str(row.measurement_date) == "2023-11-14"
    assert row.weight_lbs == D("187.39") and row.muscle_mass_lbs == D("89.29")
    assert row.body_fat_pct == D("19.25")
    assert row.bone_mass_lbs is None and row.body_water_pct is None
    assert row.visceral_fat == 7 and row.bmr_kcal == 1800
    assert row.rejected_field is None


def test_unreadable_readings_are_marked(spark):
    rows = read(
        spark, {**READING, "weight": "heavy"}, {**READING, "bmr": "99999999999"},
        {**READING, "bodyfat": 12345}, {"timestamp": "1700000060", "timeStamp": "", "weight": None},
    )
    assert [r.rejected_field for r in rows] == ["weight", "bmr", "bodyfat", None]
    assert rows[3].measured_at == datetime(2023, 11, 14, 22, 14, 20)
    assert rows[3].weight_lbs is None


def test_scan_scale_readings(spark, tmp_path):
    path = tmp_path / "in.json"
    path.write_text("\n".join(json.dumps({**READING, "renpho_user_id": "r", "arrival": i}) for i in range(3)))
    got = scale.scan_scale_readings(spark, str(path), "renpho_user_id", "arrival")
    assert {r.arrival for r in got.collect()} == {"0", "1", "2"}
    assert scale.read_scale_measurements(got, "2025-01-01").count() == 3


def test_workout_documents(spark):
    docs = [
        {"date": "2025-04-14", "name": "Push", "duration_min": 0, "notes": "", "exercises": [
            {"name": "Bench", "gym_equipment_id": "", "sets": [
                {"reps": 8, "weight_lbs": 185, "rpe": 7.5}, {"reps": 0, "weight_lbs": 0, "notes": "fail"}]},
            {"name": "Dip", "sets": []}, {"name": "Fly"},
        ]},
        {"date": "2025-04-15", "name": "Empty", "exercises": []},
        {"date": "2025-04-15", "name": "None"},
        {"name": "No date"}, {"date": "2025-04-15", "name": ""}, {"date": "soon", "name": "x"},
    ]
    posts = spark.createDataFrame(
        [(f"s{i}", "u", json.dumps(d)) for i, d in enumerate(docs)] + [("s9", "u", "not json")],
        "session_id string, user_id string, value string",
    )
    split, sets = documents.ingest_workout_documents(documents.parse_workout_json(posts))
    assert {r.id: r.duration_min for r in split.accepted.collect()} == {"s0": None, "s1": None, "s2": None}
    assert {r.session_id: r.reason for r in split.rejected.collect()} == {
        "s3": "date is required", "s4": "name is required", "s5": "date is not a date", "s9": "date is required",
    }
    got = [(r.exercise_name, r.set_number, r.reps, r.weight_lbs, r.notes) for r in sets.orderBy("set_number").collect()]
    assert got == [("Bench", 1, 8, D("185.00"), None), ("Bench", 2, None, None, "fail")]


def test_nutrition_entries(spark):
    one = {"log_date": "2025-04-15", "meal_type": "Lunch", "food_name": "Rice", "calories_kcal": 0, "protein_g": 4.5}
    posts = spark.createDataFrame(
        [("u", json.dumps(one)), ("v", json.dumps([one, {"meal_type": "Snack"}, {"log_date": ""}])), ("w", "[]")],
        "user_id string, value string",
    )
    out = documents.ingest_nutrition_entries(posts)
    assert sorted((r.user_id, r.food_name, r.calories_kcal, r.protein_g) for r in out.accepted.collect()) == [
        ("u", "Rice", None, D("4.50")), ("v", "Rice", None, D("4.50"))
    ]
    assert out.rejected.filter("user_id = 'v'").count() == 2


def test_aligned_summary_has_one_row_per_day(spark):
    days = ["2025-01-01", "2025-01-02", "2025-01-03"]
    t = {
        "daily_activity": make(spark, "daily_activity", ["user_id", "activity_date", "steps"], [("u", days[1], 100)]),
        "heart_rate_daily": make(spark, "heart_rate_daily", ["user_id", "summary_date", "resting_bpm"],
                                 [("u", days[0], 60), ("u", days[1], 61)]),
        "blood_pressure": make(spark, "blood_pressure",
                               ["id", "user_id", "measured_at", "measurement_date", "systolic_mmhg", "diastolic_mmhg"],
                               [("1", "u", "2025-01-01 08:00:00", days[0], 120, 80), ("2", "u", "2025-01-01 20:00:00", days[0], 130, 85)]),
        "blood_oxygen": make(spark, "blood_oxygen", ["user_id", "measurement_date", "spo2_pct"], [("u", days[0], 97), ("u", days[0], 98)]),
        "stress_readings": make(spark, "stress_readings", ["user_id", "measurement_date", "stress_score"], []),
        "sleep_sessions": make(spark, "sleep_sessions", ["id", "user_id", "session_date", "sleep_end", "duration_min"],
                               [("1", "u", days[0], "2025-01-02 06:00:00", 400), ("2", "u", days[1], "2025-01-03 06:00:00", 410)]),
    }
    aligned = {str(r.summary_date): r for r in body_health.daily_health_summary(t, mode="aligned").collect()}
    assert sorted(aligned) == days
    assert aligned[days[0]].systolic_mmhg == 130 and aligned[days[0]].avg_spo2 == D("97.5")
    assert aligned[days[1]].sleep_min == 400 and aligned[days[2]].sleep_min == 410
    strict = body_health.daily_health_summary(t).collect()
    # day 1 has no activity: heart, pressure and oxygen stand alone; night 2 has no day 3
    assert sorted(str(r.summary_date) for r in strict) == [days[0], days[0], days[1], "None", "None"]
    joined = [r for r in strict if r.steps == 100][0]
    assert joined.resting_bpm == D("61.0") and joined.sleep_min == 400

"""The sample training log, worked out by hand from the report definitions."""

from decimal import Decimal as D

import pytest
from pyspark.sql import functions as F

from tests.fixtures import sample_log
from vitalspark.operators import body_health, cardio_nutrition, dashboard, history, strength


@pytest.fixture(scope="module")
def t(spark):
    return sample_log(spark)


def rows(df, *columns):
    return [tuple(str(v) if hasattr(v, "isoformat") else v for v in r) for r in df.select(*columns).collect()]


def test_daily_nutrition(t):
    got = rows(cardio_nutrition.daily_nutrition(t), "log_date", "total_calories", "total_protein_g",
               "total_carbs_g", "total_fat_g", "total_fiber_g", "entry_count")
    assert got == [("2025-04-15", 1690, D("136.00"), D("164.00"), D("43.00"), None, 5)]


def test_weekly_workouts(t):
    got = rows(strength.weekly_workouts(t), "week_start", "session_count", "total_duration_min", "avg_duration_min")
    assert got == [("2025-04-14", 1, 55, D("55.0"))]


def test_weekly_cardio(t):
    got = set(rows(cardio_nutrition.weekly_cardio(t), "week_start", "activity_type", "session_count",
                   "total_km", "total_min", "total_steps"))
    assert got == {
        ("2025-04-07", "Run", 1, D("5.20"), 28, 6800),
        ("2025-04-07", "Cycle", 1, D("18.00"), 45, None),
        ("2025-04-07", "Walk", 1, D("3.10"), 40, 4200),
    }


def test_weight_trend(t):
    got = sorted(rows(body_health.weight_trend(t), "measurement_date", "weight_lbs"), reverse=True)
    assert len(got) == 5
    assert got[0] == ("2025-04-15", D("187.40")) and got[-1] == ("2025-04-11", D("189.10"))


def test_exercise_prs(t):
    got = set(rows(strength.exercise_prs(t), "exercise", "muscle_group", "pr_weight_lbs", "max_reps", "last_performed"))
    assert got == {
        ("Bench Press", None, D("195.00"), 8, "2025-04-14"),
        ("Incline DB Press", None, D("65.00"), 10, "2025-04-14"),
        ("Overhead Press", None, D("95.00"), 8, "2025-04-14"),
    }


def test_personal_records(t):
    got = set(rows(strength.personal_records(t), "exercise_name", "max_weight_lbs", "estimated_1rm",
                   "reps_at_max", "session_count", "total_sets", "last_performed", "gym_name"))
    assert got == {
        ("Bench Press", D("195.00"), D("234.28"), 6, 1, 3, "2025-04-14", None),
        ("Incline DB Press", D("65.00"), D("86.65"), 10, 1, 2, "2025-04-14", None),
        ("Overhead Press", D("95.00"), D("120.31"), 8, 1, 2, "2025-04-14", None),
    }
    assert strength.prs_by_machine(t).count() == 0


def test_volume_by_day(t):
    assert rows(strength.volume_by_day(t), "date", "total_lbs") == [("2025-04-14", 6950)]


def test_activity_feed(t):
    feed = {r.detail for r in dashboard.activity_feed(t, top=None).collect()}
    assert {"187.40 lbs · 19.20% BF", "Run · 3.23mi", "Cycle · 11.18mi", "Walk · 1.93mi", "Push Day · 55min"} <= feed
    assert dashboard.activity_feed(t, top=4).count() == 4


def test_dashboard_summary(t):
    got = {r.user_id: r for r in dashboard.dashboard_summary(t, "2025-04-15").collect()}
    assert got["u1"].workouts_count == 1 and got["u1"].workouts_total_min == 55
    # 04-09 is the sixth day back, all three sessions count
    assert got["u1"].cardio_count == 3 and got["u1"].cardio_total_km == D("26.30")
    assert got["u1"].weight_lbs == D("187.40") and got["u1"].nutrition_protein_g == D("136.0")
    assert got["u2"].workouts_count == 0 and got["u2"].weight_lbs is None


def test_session_detail(t):
    row = strength.session_detail(t).collect()[0]
    assert [e.name for e in row.exercises] == ["Bench Press", "Incline DB Press", "Overhead Press"]
    assert [s.reps for s in row.exercises[0].sets] == [8, 8, 6]
    assert row.part == 0


def test_last_performance(t):
    got = {r.exercise_key: r for r in strength.last_performance(t).collect()}
    assert [s.set_number for s in got["bench press"].sets] == [1, 2, 3]
    assert got["bench press"].workout_name == "Push Day"


def test_pages(t):
    ids = [r.id for r in history.metrics_page(t["body_metrics"], limit=2, offset=1).collect()]
    assert sorted(ids) == ["w1", "w2"]
    assert history.metrics_page(t["body_metrics"], limit=9999).count() == 5



def test_requests_take_the_machine_day_or_the_latest_of_all(spark):
    """Against both kinds of history worked out for everybody, as the answers are defined."""
    t = dict(sample_log(spark))
    number = F.col("set_number").cast("int")
    t["workout_sets"] = t["workout_sets"].withColumn(
        "gym_equipment_id", F.when(number % 3 == 1, "m1").when(number % 3 == 2, "m2"))
    performed = strength.performed_sets(t).select("user_id", "exercise_name", "gym_equipment_id").distinct().collect()
    machines = sorted({r.gym_equipment_id for r in performed if r.gym_equipment_id is not None}) + ["none such", None]
    asked = [(r.user_id, name, m) for r in performed for m in machines
             for name in (r.exercise_name, r.exercise_name.upper(), "never done", None)]
    requests = spark.createDataFrame(asked, "user_id string, exercise_name string, gym_equipment_id string")
    fields = ["session_id", "gym_equipment_id", "session_date", "gym_name", "set_number", "reps", "weight_lbs", "rpe"]
    special, general = {}, {}
    for held, unit, rows in ((special, ["gym_equipment_id"], strength.last_performance_rows(t, per_machine=True)),
                             (general, [], strength.last_performance_rows(t))):
        for r in rows.collect():
            held.setdefault((r.user_id, r.exercise_key, *(r[u] for u in unit)), []).append(tuple(r[f] for f in fields))
    want = set()
    for user, name, m in asked:
        key = (user, name and name.lower())
        own = (*key, m) in special
        want |= {(*key, m, own, *row) for row in (special[*key, m] if own else general.get(key, []))}
    found = strength.last_performance_fallback(t, requests).collect()
    got = [(r.user_id, r.exercise_key, r.requested_machine, r.used_machine, *(r[f] for f in fields)) for r in found]
    assert len(got) == len(set(got)) and set(got) == want and {g[3] for g in got} == {True, False}

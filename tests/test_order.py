"""Orders that a comparison of sorted rows cannot see."""

from tests.fixtures import make, sample_log
from vitalspark.operators import accounts, equipment
from vitalspark.plans import marts


def test_gyms_come_defaults_first(spark):
    gyms = make(spark, "gyms", ["id", "name", "is_default"],
                [(1, "Beta", "false"), (2, "Alpha", "false"), (3, "Zeta", "true")])
    t = {**sample_log(spark), "gyms": gyms}
    assert [r.name for r in equipment.gym_list(t).collect()] == ["Zeta", "Alpha", "Beta"]


def test_lookups_come_stock_first_by_name(spark):
    groups = make(spark, "muscle_groups", ["id", "name", "is_custom"],
                  [(1, "Own", "true"), (2, "Legs", "false"), (3, "Back", "false")])
    assert [r.name for r in accounts.lookup_list({"muscle_groups": groups}, "muscle_groups").collect()] == [
        "Back", "Legs", "Own"]


def test_marts_come_newest_first(spark):
    days = [str(r.measurement_date) for r in marts.ordered("weight_trend", sample_log(spark)).collect()]
    assert days == sorted(days, reverse=True) and len(set(days)) > 1

"""Table changes: conflict rules, order within a batch, cascades, repeat runs."""

from datetime import datetime

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tests.fixtures import make
from vitalspark.operators import changes, quality
from vitalspark.sources.seeds import load_seed_dims

LIBRARY = ["id", "name", "brand", "type"]


def library(spark, rows):
    return make(spark, "equipment_library", LIBRARY, rows)


def batch(spark, rows):
    return spark.createDataFrame(rows, "arrival int, id string, name string, brand string, type string")


def test_insert_if_absent(spark):
    current = library(spark, [("1", "Rack", "Acme", "x"), ("2", "Bench", None, "x")])
    news = batch(spark, [
        (1, "a", "Rack", "Acme", "y"), (2, "b", "Press", "Acme", "y"), (3, "c", "Press", "Acme", "z"),
        (4, "d", "Bench", None, "y"), (5, "e", "Bench", None, "y"),
    ])
    out = changes.insert_if_absent(current, news, ["name", "brand"])
    assert {r.id for r in out.applied.collect()} == {"b", "d", "e"}
    assert {(r.id, r.reason) for r in out.rejected.collect()} == {
        ("a", "already stored"), ("c", "repeated in batch")
    }
    assert out.snapshot.count() == 5


def test_insert_if_absent_partial_key(spark):
    current = spark.createDataFrame([("u", 1, "renpho"), ("u", 2, "manual")], "k string, at int, source string")
    news = spark.createDataFrame(
        [(1, "u", 1, "renpho"), (2, "u", 1, "manual"), (3, "u", 2, "renpho"), (4, "u", 2, None)],
        "arrival int, k string, at int, source string",
    )
    out = changes.insert_if_absent(current, news, ["k", "at"], where=F.col("source") == "renpho")
    assert {r.arrival for r in out.applied.collect()} == {2, 3, 4}


rows_of_keys = st.lists(st.tuples(st.sampled_from(["a", "b", None]), st.sampled_from(["x", "y", None])), max_size=12)


@settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))
@given(stored=rows_of_keys, incoming=rows_of_keys)
def test_insert_if_absent_matches_row_by_row(spark, stored, incoming):
    current = spark.createDataFrame([(str(i), *k) for i, k in enumerate(stored)], "id string, name string, brand string")
    news = spark.createDataFrame(
        [(i, f"n{i}", *k) for i, k in enumerate(incoming)], "arrival int, id string, name string, brand string"
    )
    seen, want = {k for k in stored if None not in k}, set()
    for i, k in enumerate(incoming):
        if None in k or k not in seen:
            want.add(i)
            seen.add(k)
    once = changes.insert_if_absent(current, news, ["name", "brand"])
    assert {r.arrival for r in once.applied.collect()} == want
    again = changes.insert_if_absent(once.snapshot, news.dropna(), ["name", "brand"])
    assert again.applied.count() == 0


def test_seeding_twice_changes_nothing(spark):
    seeds = load_seed_dims(spark)
    assert {n: df.count() for n, df in seeds.items()} == {
        "muscle_groups": 10, "exercises": 15, "equipment_types": 9, "equipment_categories": 11,
        "equipment_library": 50,
    }
    machines = seeds["equipment_library"]
    again = changes.insert_if_absent(
        machines, machines.withColumn("arrival", F.col("id").cast("int")), ["name", "brand"]
    )
    assert again.applied.count() == 0 and again.snapshot.count() == 50


def test_upsert_settings(spark):
    current = spark.createDataFrame(
        [("u", "theme", "dark", None), ("u", "unit", "kg", None), (None, "theme", "old", None)],
        "user_id string, key string, value string, updated_at timestamp",
    )
    news = spark.createDataFrame(
        [(1, "u", "theme", "light"), (2, "u", "theme", None), (3, "v", "unit", "lb"), (4, None, "theme", "new")],
        "arrival int, user_id string, key string, value string",
    )
    got = {(r.user_id, r.key, r.value, r.updated_at is not None)
           for r in changes.upsert_settings(current, news, "2025-01-01").collect()}
    assert got == {
        ("u", "theme", None, True), ("u", "unit", "kg", False), ("v", "unit", "lb", True),
        (None, "theme", "old", False), (None, "theme", "new", True),
    }


def test_patch_sessions(spark):
    sessions = make(spark, "workout_sessions", ["id", "user_id", "session_date", "name", "duration_min"],
                    [("s", "u", "2025-01-01", "Legs", 40), ("z", "u", "2025-01-01", "Arms", 30)])
    patches = spark.createDataFrame(
        [(1, "s", "u", "Push", None, None), (2, "s", "u", None, 50, "n"), (3, "s", "other", "Evil", 1, None)],
        "arrival int, id string, user_id string, name string, duration_min int, notes string",
    )
    out = changes.patch_sessions(sessions, patches)
    got = {r.id: (r.name, r.duration_min, r.notes) for r in out.snapshot.collect()}
    assert got == {"s": ("Push", 50, "n"), "z": ("Arms", 30, None)}
    assert [r.arrival for r in out.rejected.collect()] == [3]


def gym_row(spark, rows):
    return make(spark, "gym_equipment", [
        "id", "gym_id", "equipment_id", "condition", "weight_min_lbs", "is_out_of_service",
        "oos_reported_at", "oos_auto_clear_at", "flag_count", "is_flagged",
    ], rows)


def test_replace_rows(spark):
    current = gym_row(spark, [("m", "g", "e", "fair", 10, False, None, None, 0, False)])
    news = spark.createDataFrame(
        [(1, "m", "g", "fair", 5), (2, "m", "g", "", 0), (3, "m", "wrong", "fair", 1)],
        "arrival int, id string, gym_id string, condition string, weight_min_lbs int",
    )
    out = changes.replace_rows(
        current, news, ["id", "gym_id"], {"condition": "good", "weight_min_lbs": None}, "2025-01-01"
    )
    row = out.snapshot.first()
    assert (row.condition, row.weight_min_lbs) == ("good", None)
    assert row.updated_at == datetime(2025, 1, 1)
    assert [r.arrival for r in out.rejected.collect()] == [3]


def test_user_deletion_cascades(spark):
    t = {
        "users": make(spark, "users", ["id", "email", "role"], [("u", "a", "member"), ("v", "b", "member")]),
        "workout_sessions": make(spark, "workout_sessions", ["id", "user_id"], [("s", "u"), ("r", "v")]),
        "workout_sets": make(spark, "workout_sets", ["id", "session_id"], [("1", "s"), ("2", "r")]),
        "invite_codes": make(spark, "invite_codes", ["id", "code", "created_by", "used_by"],
                             [("i", "c", "u", "v"), ("j", "d", None, "u")]),
    }
    out, unmatched = changes.delete_owned_cascade(
        t, "users", spark.createDataFrame([("u",), ("nobody",)], "id string"), key=("id",)
    )
    assert [r.id for r in out["users"].collect()] == ["v"]
    assert [r.id for r in out["workout_sessions"].collect()] == ["r"]
    assert [r.id for r in out["workout_sets"].collect()] == ["2"]
    assert {(r.id, r.created_by, r.used_by) for r in out["invite_codes"].collect()} == {
        ("i", None, "v"), ("j", None, None)
    }
    assert [r.id for r in unmatched.collect()] == ["nobody"]


def test_gym_deletion_reaches_reports(spark):
    t = {
        "gyms": make(spark, "gyms", ["id", "name"], [("g", "A"), ("h", "B")]),
        "gym_equipment": gym_row(spark, [
            ("m", "g", "e", "good", 1, False, None, None, 0, False),
            ("n", "h", "e", "good", 1, False, None, None, 0, False),
        ]),
        "equipment_oos_reports": make(spark, "equipment_oos_reports", ["id", "gym_equipment_id"], [("1", "m"), ("2", "n")]),
    }
    out, _ = changes.delete_owned_cascade(t, "gyms", spark.createDataFrame([("g",)], "id string"), key=("id",))
    assert [r.id for r in out["equipment_oos_reports"].collect()] == ["2"]


def test_only_the_owner_deletes(spark):
    t = {"workout_sessions": make(spark, "workout_sessions", ["id", "user_id"], [("s", "u")])}
    out, unmatched = changes.delete_owned_cascade(
        t, "workout_sessions", spark.createDataFrame([("s", "v")], "id string, user_id string")
    )
    assert out["workout_sessions"].count() == 1 and unmatched.count() == 1


def test_delete_custom_only(spark):
    dims = make(spark, "muscle_groups", ["id", "name", "is_custom"], [(1, "Chest", "false"), (2, "Neck", "true"), (3, "Odd", None)])
    out = changes.delete_custom_only(dims, spark.createDataFrame([(1,), (2,), (3,), (9,)], "id int"))
    assert {r.id for r in out.snapshot.collect()} == {1, 3}
    assert {(r.id, r.reason) for r in out.rejected.collect()} == {
        (1, "default rows stay"), (3, "default rows stay"), (9, "not found")
    }


def test_out_of_service_cycle(spark):
    machines = gym_row(spark, [(m, "g", m, "good", 1, False, None, None, 0, False) for m in "abc"])
    history = make(spark, "equipment_oos_reports", ["id", "gym_equipment_id"], [])
    reports = spark.createDataFrame(
        [("a", datetime(2025, 3, 1, 12), " x "), ("a", datetime(2025, 3, 3, 12), ""), ("q", datetime(2025, 3, 1), None)],
        "gym_equipment_id string, reported_at timestamp, notes string",
    )
    out, log, rejected = changes.report_oos(machines, history, reports, zone="America/Chicago")
    a = {r.id: r for r in out.collect()}["a"]
    assert a.is_out_of_service and a.condition == "out_of_service"
    # clocks go forward in between: same local hour, one hour less in UTC
    assert a.oos_auto_clear_at == datetime(2025, 4, 2, 11)
    assert sorted(r.notes or "" for r in log.collect()) == ["", "x"]
    assert [r.gym_equipment_id for r in rejected.collect()] == ["q"]

    expired = {r.id: r for r in changes.expire_oos(out, "2025-05-01").collect()}["a"]
    assert expired.is_out_of_service is False and expired.oos_auto_clear_at is None
    assert expired.condition == "out_of_service"
    early = {r.id: r for r in changes.expire_oos(out, "2025-04-01").collect()}["a"]
    assert early.is_out_of_service is True

    fixed, closed = changes.resolve_oos(out, log, reports.filter("gym_equipment_id = 'a'"), "2025-03-05")
    a = {r.id: r for r in fixed.collect()}["a"]
    assert (a.is_out_of_service, a.condition, a.oos_reported_at) == (False, "good", None)
    assert all(r.resolved_at is not None for r in closed.collect())


def test_apply_flags(spark):
    target = gym_row(spark, [
        ("a", "g", "1", "good", 1, False, None, None, 1, False), ("b", "g", "2", "good", 1, False, None, None, 0, False),
        ("c", "g", "3", "good", 1, False, None, None, 5, False), ("d", "g", "4", "good", 1, False, None, None, 0, True),
    ])
    flags = spark.createDataFrame(
        [("gym_equipment", "a"), ("gym_equipment", "a"), ("gym_equipment", "b"), ("library", "b"), ("gym_equipment", "d")],
        "target_type string, target_id string",
    )
    got = {r.id: (r.flag_count, r.is_flagged) for r in changes.apply_flags(target, flags, "gym_equipment").collect()}
    assert got == {"a": (3, True), "b": (1, False), "c": (5, False), "d": (1, True)}


def test_status_updates(spark):
    users = make(spark, "users", ["id", "email", "role", "is_active"], [("1", "a", "admin", "true"), ("2", "b", "member", "true")])
    out = changes.deactivate_users(
        users, spark.createDataFrame([("1", "1"), ("2", "1")], "id string, requested_by string")
    )
    assert {r.id: r.is_active for r in out.snapshot.collect()} == {"1": True, "2": False}
    assert [r.id for r in out.rejected.collect()] == ["1"]


def test_invites(spark):
    invites = make(spark, "invite_codes", ["id", "code", "used_by", "used_at", "expires_at"], [
        ("1", "AAAA", None, None, None), ("2", "BBBB", None, None, "2025-01-01"), ("3", "CCCC", "x", "2024-01-01", None),
    ])
    uses = spark.createDataFrame(
        [(1, " aaaa ", "u", datetime(2025, 2, 1)), (2, "AAAA", "v", datetime(2025, 2, 2)),
         (3, "BBBB", "u", datetime(2025, 2, 1)), (4, "CCCC", "u", datetime(2025, 2, 1))],
        "arrival int, code string, user_id string, used_at timestamp",
    )
    out = changes.mark_invites_used(invites, uses)
    assert {r.id: r.used_by for r in out.snapshot.collect()} == {"1": "u", "2": None, "3": "x"}
    assert {r.arrival for r in out.rejected.collect()} == {2, 3, 4}


def test_backfill_and_lookup(spark):
    rows = make(spark, "workout_sessions", ["id", "user_id"], [("s", None), ("r", "v")])
    assert {r.user_id for r in changes.backfill_owner(rows, "boss").collect()} == {"boss", "v"}
    groups = make(spark, "muscle_groups", ["id", "name"], [(1, "Chest")])
    news = spark.createDataFrame([("a", "Chest"), ("b", "chest"), ("c", None)], "name string, muscle_group string")
    got = {r.name: r.muscle_group_id for r in changes.resolve_exercise_ids(news, groups).collect()}
    assert got == {"a": 1, "b": None, "c": None}


@pytest.mark.parametrize("table,columns,rows,rules", [
    ("users", ["id", "email", "role"], [("1", "a", "boss"), ("2", "a", "member"), ("3", None, "admin")],
     {"email is null", "role not in list", "(email) not unique"}),
    ("muscle_groups", ["id", "name"], [(1, "x" * 51), (2, None), (3, None)],
     {"name longer than 50", "name is null"}),
])
def test_validate_constraints(spark, table, columns, rows, rules):
    got = quality.validate_constraints({table: make(spark, table, columns, rows)}, table)
    assert {r.rule for r in got.collect()} == rules


def test_quarantine(spark):
    t = {
        "users": make(spark, "users", ["id", "email", "role"], [("u", "a", "member")]),
        "workout_sessions": make(spark, "workout_sessions", ["id", "user_id", "session_date", "name"], [
            ("1", "u", "2025-01-01", "Legs"), ("2", "ghost", "2025-01-01", "Legs"), ("3", None, None, "Legs"),
        ]),
    }
    out = quality.quarantine(t, "workout_sessions")
    assert [r.id for r in out.accepted.collect()] == ["1"]
    assert {r.id: r.reason for r in out.rejected.collect()} == {
        "2": "user_id has no users", "3": "user_id is null; session_date is null"
    }

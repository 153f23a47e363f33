"""Streams over several batches, against their batch twins; replays change nothing."""

import json
import pathlib
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tests.fixtures import make
from vitalspark.operators import cardio_nutrition, changes, strength
from vitalspark.sources import scale as scale_source
from vitalspark.streaming import flags, oos, periods, scale
from vitalspark.streaming.store import finish, write_batch

LINE = "arrival long, renpho_user_id string, value string"


def land(spark, folder, rows, schema, order):
    """One more input file, later than those before."""
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{folder}/in{order}")


def stream(spark, folder, schema):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in*")


def reading(at, weight):
    return json.dumps({"timeStamp": at, "weight": weight})


def test_scale_stream(spark, tmp_path):
    folder, store, rejects = str(tmp_path), f"{tmp_path}/store", f"{tmp_path}/rejects"
    base_time = 1700000000
    batches = [
        [(1, "a", reading(base_time, 80)), (2, "a", reading(base_time, 81)), (3, "b", reading(base_time, 70))],
        [(4, "a", reading(base_time, 82)), (5, "a", reading(base_time - 86400 * 400, 83)), (6, "b", reading(base_time, "x"))],
        [(7, None, reading(base_time, 60)), (8, None, reading(base_time, 60)), (9, "a", reading(base_time + 60, 84))],
    ]
    for i, rows in enumerate(batches):
        land(spark, folder, rows, LINE, i)
        lines = stream(spark, folder, LINE)
        finish(scale.stream_scale_measurements(lines, store, f"{folder}/cp", "2025-01-01", rejects=rejects))
    got = {r.arrival for r in scale.loaded_measurements(spark, store).collect()}
    # a late reading counts, rows without a scale user never repeat one another
    assert got == {1, 3, 5, 7, 8, 9}
    assert [r.arrival for r in spark.read.parquet(rejects).collect()] == [6]
    lines = spark.createDataFrame([r for b in batches for r in b], LINE)
    whole = scale_source.read_scale_measurements(
        scale_source.reading_columns(lines), "2025-01-01", "arrival", "renpho_user_id"
    )
    empty = make(spark, "body_metrics", ["id"], [])
    once = changes.insert_if_absent(
        empty, whole.filter("rejected_field is null").withColumn("source", F.lit("renpho")),
        ["renpho_user_id", "measured_at"], where=F.col("source") == "renpho",
    )
    assert {r.arrival for r in once.applied.collect()} == got


@pytest.mark.parametrize("cut", [1, 4, 100])
def test_bounded_scale_stream_loses_no_late_reading(spark, tmp_path, cut):
    """Readings out of order, months late, repeated across batches, in any cut."""
    day, base = 86400, 1700000000
    rows = [("a", 0), ("b", 300), ("a", 0), ("c", -200), ("a", 299), ("b", 300), ("a", -90), ("c", -200), (None, -90),
            (None, -90), ("a", 1), ("b", 301), ("a", -90), ("b", 298), ("a", 1)]
    rows = [(k, user, reading(base + at * day, 80 + k)) for k, (user, at) in enumerate(rows)]
    folder = str(tmp_path)
    for i in range(0, len(rows), cut):
        land(spark, folder, rows[i:i + cut], LINE, i)
        finish(scale.stream_scale_bounded(stream(spark, folder, LINE), f"{folder}/store", f"{folder}/cp", "2025-01-01"))
    got = {r.arrival for r in scale.loaded_measurements(spark, f"{folder}/store").collect()}
    assert got == {0, 1, 3, 4, 6, 8, 9, 10, 11, 13}
    assert scale.loaded_measurements(spark, f"{folder}/store").count() == len(got)


def test_bounded_scale_stream_reads_each_batch_by_one_window(spark, tmp_path, monkeypatch):
    """Of equal keys the first arrival counts and rows without a user stay, without joins inside the batch."""
    rows = [(9, "a", reading(1700000000, 80)), (2, "a", reading(1700000000, 81)), (5, None, reading(1700000000, 82)),
            (6, None, reading(1700000000, 82)), (7, "b", reading(1700000000, 83))]
    folder, joins = str(tmp_path), []
    frames = type(spark.range(1))
    own = frames.join
    monkeypatch.setattr(frames, "join", lambda *a, **k: joins.append(1) or own(*a, **k))
    land(spark, folder, rows, LINE, 0)
    finish(scale.stream_scale_bounded(stream(spark, folder, LINE), f"{folder}/store", f"{folder}/cp", "2025-01-01"))
    got = sorted(r.arrival for r in scale.loaded_measurements(spark, f"{folder}/store").collect())
    assert got == [2, 5, 6, 7] and not joins


def test_flag_stream(spark, tmp_path):
    folder, store = str(tmp_path), f"{tmp_path}/store"
    schema = "target_type string, target_id string"
    target = make(spark, "equipment_library", ["id", "name", "type", "flag_count", "is_flagged"],
                  [("x", "X", "t", 1, "false"), ("y", "Y", "t", 0, "false"), ("z", "Z", "t", 0, "true")])
    batches = [[("library", "x")], [("library", "x"), ("library", "y"), ("gym_equipment", "y")], [("library", "y")]]
    for i, rows in enumerate(batches):
        land(spark, folder, rows, schema, i)
        finish(flags.stream_flag_threshold(stream(spark, folder, schema), store, f"{folder}/cp"))
    got = flags.set_flag_counts(target, flags.flag_totals(spark, store), "library")
    everything = spark.createDataFrame([r for b in batches for r in b], schema)
    want = changes.apply_flags(target, everything, "library")
    rows = lambda df: {r.id: (r.flag_count, r.is_flagged) for r in df.collect()}
    assert rows(got) == rows(want) == {"x": (3, True), "y": (2, False), "z": (0, True)}
    # the last batch written again
    last = flags.flag_totals(spark, store)
    write_batch(spark.read.parquet(f"{store}/batch=2"), f"{folder}/again", 2)
    assert spark.read.parquet(f"{folder}/again").count() == 1 and last.count() == 3


def test_late_rows_count_in_their_period(spark, tmp_path):
    folder, store, spec = str(tmp_path), f"{tmp_path}/store", periods.weekly_workouts()
    days = ["2025-06-02", "2025-06-03", "2024-01-02", "2025-06-04", "2024-01-03"]
    whole = None
    for k, day in enumerate(days):
        df = make(spark, "workout_sessions", WORKOUTS, [(str(k), "u", day, "a", 30)])
        whole = df if whole is None else whole.unionByName(df)
        df.coalesce(1).write.parquet(f"{folder}/in{k}")
        finish(periods.stream_period_totals(stream(spark, folder, df.schema), spec, store, f"{folder}/cp"))
    got = {str(r.week_start): r.session_count for r in periods.period_totals(spark, store, spec).collect()}
    assert got == {"2025-06-02": 3, "2024-01-01": 2}
    want = strength.weekly_workouts({"workout_sessions": whole})
    assert got == {str(r.week_start): r.session_count for r in want.collect()}


@pytest.mark.parametrize("cut", [[[0, 1]], [[0], [1]], [[1], [0]]])
def test_report_and_fix_at_one_time_in_any_batches(spark, tmp_path, cut):
    folder, store = str(tmp_path), f"{tmp_path}/store"
    rows = [(1, T0, "report"), (1, T0, "resolve")]
    for i, part in enumerate(cut):
        land(spark, folder, [rows[k] for k in part], EVENT, i)
        finish(oos.stream_oos_state(stream(spark, folder, EVENT), store, f"{folder}/cp"))
    got = oos.machine_status(spark, store).collect()
    assert [(r.is_out_of_service, r.cause) for r in got] == [(True, "report")]


def stored_bytes(folder):
    return sum(p.stat().st_size for p in pathlib.Path(folder).rglob("*.parquet"))


def test_period_batches_cost_the_same_however_long_the_history(spark, tmp_path):
    """Ten batches of like size: each stores sums of its own rows, compaction keeps the totals."""
    folder, store, spec = str(tmp_path), f"{tmp_path}/store", periods.weekly_workouts()
    days = ["2025-06-02", "2024-01-02", "2025-06-09", "2025-06-03", "2024-01-03"] * 2
    whole = None
    for k, day in enumerate(days):
        df = make(spark, "workout_sessions", WORKOUTS, [(str(10 * k + i), "u", day, "a", 30 + k) for i in range(4)])
        whole = df if whole is None else whole.unionByName(df)
        df.coalesce(1).write.parquet(f"{folder}/in{k}")
        finish(periods.stream_period_totals(stream(spark, folder, df.schema), spec, store, f"{folder}/cp", compact_every=4))
    sizes = [stored_bytes(f"{store}/batch={k}") for k in range(10)]
    assert max(sizes) < 1.2 * min(sizes)
    assert {p.name for p in pathlib.Path(f"{store}-base").iterdir() if p.is_dir()} == {"upto=3", "upto=7"}
    want = sorted(map(tuple, strength.weekly_workouts({"workout_sessions": whole}).collect()))
    assert sorted(map(tuple, periods.period_totals(spark, store, spec).collect())) == want
    # a compaction by hand, twice, changes nothing; neither does a replay of the last batch
    assert periods.compact_totals(spark, store, spec) == periods.compact_totals(spark, store, spec) == 9
    assert sorted(map(tuple, periods.period_totals(spark, store, spec).collect())) == want


T0 = datetime(2025, 1, 1)
EVENT = "gym_equipment_id long, at timestamp, kind string"


def test_oos_stream(spark, tmp_path):
    folder, store = str(tmp_path), f"{tmp_path}/store"

    def day(n):
        return T0 + timedelta(days=n)

    batches = [
        [(1, day(0), "report"), (2, day(0), "report"), (3, day(0), "report"), (3, day(1), "resolve")],
        [(1, day(20), "report"), (4, day(25), "report")],
        # moves the watermark past day 30 but not past day 50
        [(9, day(40), "resolve")],
    ]
    for i, rows in enumerate(batches):
        land(spark, folder, rows, EVENT, i)
        finish(oos.stream_oos_state(stream(spark, folder, EVENT), store, f"{folder}/cp"))
    got = {r.gym_equipment_id: (r.is_out_of_service, r.cause) for r in oos.machine_status(spark, store).collect()}
    assert got == {
        1: (True, "report"),       # reported again on day 20, clears on day 50
        2: (False, "cleared"),     # thirty days passed
        3: (False, "resolve"),
        4: (True, "report"),
        9: (False, "resolve"),
    }
    # only machines with events or a passed time are written by a batch
    assert {r.gym_equipment_id for r in spark.read.parquet(f"{store}/batch=0").collect()} == {1, 2, 3}
    assert oos.compact_latest(spark, store, ["gym_equipment_id"]) > 0
    clear = {r.gym_equipment_id: r.auto_clear_at for r in oos.machine_status(spark, store).collect()}
    assert clear[1] == day(50) and clear[4] == day(55)


def test_oos_stream_keeps_late_events_in_any_cut(spark, tmp_path):
    def day(n):
        return T0 + timedelta(days=n)

    rows = [(9, day(100), "resolve"), (1, day(90), "report"), (2, day(60), "report"), (3, day(95), "report"),
            (3, day(96), "resolve"), (4, day(80), "resolve"), (4, day(80), "report"), (3, day(10), "report"),
            (5, day(99), "noted"), (1, None, "resolve"), (None, day(97), "report"), (2, day(20), "resolve")]
    want = {1: (True, "report", day(120)), 2: (False, "cleared", None), 3: (False, "resolve", None),
            4: (True, "report", day(110)), 9: (False, "resolve", None), None: (True, "report", day(127))}
    for cut in (2, 5, len(rows)):
        folder = f"{tmp_path}/{cut}"
        for i in range(0, len(rows), cut):
            land(spark, folder, rows[i:i + cut], EVENT, i)
            finish(oos.stream_oos_state(stream(spark, folder, EVENT), f"{folder}/store", f"{folder}/cp"))
        got = {r.gym_equipment_id: (r.is_out_of_service, r.cause, r.auto_clear_at)
               for r in oos.machine_status(spark, f"{folder}/store").collect()}
        assert got == want, cut


MEALS = ["id", "user_id", "log_date", "meal_type", "food_name", "calories_kcal", "protein_g"]
WORKOUTS = ["id", "user_id", "session_date", "name", "duration_min"]


@pytest.mark.parametrize("spec,table,columns,batches,twin", [
    (periods.daily_nutrition, "nutrition_log", MEALS,
     [[("1", "u", "2025-04-14", "Lunch", "f", 500, "20.5")],
      [("2", "u", "2025-04-14", "Snack", "f", None, "5"), ("3", "v", "2025-04-15", "Lunch", "f", None, None)]],
     cardio_nutrition.daily_nutrition),
    (periods.weekly_workouts, "workout_sessions", WORKOUTS,
     [[("1", "u", "2025-04-13", "a", 30), ("2", "u", "2025-04-14", "a", 41)],
      [("3", "u", "2025-04-20", "a", 40), ("4", "u", "2025-04-21", "a", None)]],
     strength.weekly_workouts),
])
def test_period_streams(spark, tmp_path, spec, table, columns, batches, twin):
    folder, store = str(tmp_path), f"{tmp_path}/store"
    spec, whole = spec(), None
    for i, rows in enumerate(batches):
        df = make(spark, table, columns, rows)
        whole = df if whole is None else whole.unionByName(df)
        df.coalesce(1).write.parquet(f"{folder}/in{i}")
        finish(periods.stream_period_totals(stream(spark, folder, df.schema), spec, store, f"{folder}/cp"))
    got = periods.period_totals(spark, store, spec)
    want = twin({table: whole}).select(*got.columns)
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(map(tuple, want.collect()), key=repr)

"""Group-wise helpers on data in which one key holds most rows, against brute force."""

import random

from pyspark.sql import Window
from pyspark.sql import functions as F
import pytest

from tests.fixtures import sample_log
from vitalspark.operators import quality, strength
from vitalspark.operators.history import page_rows
from vitalspark.plans import strength_queries
from vitalspark.schemas import TableRules
from vitalspark.sources.seeds import conform
from vitalspark.skew import first_rows, join_optional, position_parts, rolling_rows, row_positions


@pytest.fixture(scope="module")
def hot(spark):
    rng = random.Random(5)
    rows = [
        (None if rng.random() < 0.3 else "hot" if rng.random() < 0.6 else f"k{rng.randrange(9)}",
         rng.randrange(40), i, rng.randrange(100))
        for i in range(3000)
    ]
    return spark.createDataFrame(rows, "k string, day int, id int, v int").cache()


def by_key(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r.k, []).append(r)
    return groups


def test_row_positions(hot):
    got = row_positions(hot, ["k"], F.col("day"), [F.col("day"), F.col("id")]).collect()
    for rows in by_key(got).values():
        ordered = sorted(rows, key=lambda r: (r.day, r.id))
        assert [r.position for r in ordered] == list(range(1, len(rows) + 1))


def test_row_positions_descending_without_keys(hot):
    order = [F.col("day").desc(), F.col("id")]
    got = row_positions(hot, [], F.col("day"), order, descending=True).collect()
    ordered = sorted(got, key=lambda r: (-r.day, r.id))
    assert [r.position for r in ordered] == list(range(1, 3001))


@pytest.mark.parametrize("block", [8, 50, 4096])
@pytest.mark.parametrize("keys", [["k"], []])
def test_rolling_rows(hot, block, keys):
    got = rolling_rows(
        hot, keys, F.floor(F.col("day") / 7), [F.col("day"), F.col("id")], 7,
        lambda w: F.sum("v").over(w), "total", block_rows=block,
    ).collect()
    assert len(got) == 3000
    groups = by_key(got) if keys else {None: got}
    for rows in groups.values():
        ordered = sorted(rows, key=lambda r: (r.day, r.id))
        for i, r in enumerate(ordered):
            assert r.total == sum(x.v for x in ordered[max(0, i - 6): i + 1])


def test_first_rows_cut_before_shuffle(hot):
    df = first_rows(hot, ["k"], [F.col("v").desc(), F.col("id")], 3)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") >= 2
    for k, rows in by_key(df.collect()).items():
        want = sorted((r for r in hot.collect() if r.k == k), key=lambda r: (-r.v, r.id))[:3]
        assert {r.id for r in rows} == {r.id for r in want}


def test_join_optional_keeps_and_spreads_null_keys(spark, hot):
    names = spark.createDataFrame([("hot", "H"), ("k1", "K")], "name_key string, label string")
    got = join_optional(hot, names, "k", "name_key", ["id"])
    assert got.columns == ["k", "day", "id", "v", "label"]
    assert got.count() == 3000
    assert {(r.k, r.label) for r in got.collect() if r.k in (None, "hot", "k1", "k2")} == {
        (None, None), ("hot", "H"), ("k1", "K"), ("k2", None)
    }


def test_null_keys_meet_many_tasks(spark, hot):
    names = spark.createDataFrame([("hot", "H")], "name_key string, label string")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        got = join_optional(hot, names, "k", "name_key", ["id"]).filter(F.col("k").isNull())
        tasks = got.select(F.spark_partition_id().alias("p")).distinct().count()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert tasks == int(spark.conf.get("spark.sql.shuffle.partitions"))


@pytest.mark.parametrize("size", [50, 1000, 100_000])
def test_parts_follow_one_another(hot, size):
    order = [F.col("day").asc_nulls_first(), F.col("id").asc()]
    got = position_parts(hot, ["k"], F.col("day"), order, size)
    place = F.row_number().over(Window.partitionBy("k").orderBy(*order))
    want = {r.id: r.p for r in hot.withColumn("p", place).collect()}
    for r in got.collect():
        assert (r.place, r.part) == (want[r.id], (want[r.id] - 1) // size)


def test_deep_page_equals_plain_numbering(hot):
    order = [F.col("day").desc(), F.col("id").desc()]
    got = page_rows(hot, ["k"], "day", order, limit=300, offset=900)
    place = F.row_number().over(Window.partitionBy("k").orderBy(*order))
    want = hot.withColumn("p", place).filter(F.col("p").between(901, 1200))
    assert sorted(r.id for r in got.collect()) == sorted(r.id for r in want.collect())


def hot_log(spark):
    """Two thirds of all sets in one session, for one exercise."""
    t = sample_log(spark)
    more = t["workout_sets"].limit(1).select(
        *[F.col(c) for c in t["workout_sets"].columns if c not in ("id", "set_number", "reps")],
        F.explode(F.sequence(F.lit(10), F.lit(2009))).alias("n"),
    ).select(
        "*", F.concat(F.lit("h"), F.col("n").cast("string")).alias("id"),
        F.col("n").cast("smallint").alias("set_number"), (F.col("n") % 5 + 1).cast("smallint").alias("reps"),
    ).drop("n")
    return {**t, "workout_sets": t["workout_sets"].unionByName(more)}


def test_session_is_the_same_at_any_part_size(spark):
    t = hot_log(spark)

    def whole(part_rows):
        parts = sorted(strength.session_detail(t, part_rows).collect(), key=lambda p: (p.id, p.part))
        assert max(sum(len(e.sets) for e in p.exercises) for p in parts if p.exercises) <= part_rows
        rows = [(p.id, e.name, e.first_place + k, *s) for p in parts for e in p.exercises or () for k, s in enumerate(e.sets)]
        assert len(rows) == 2007
        return rows

    assert whole(100) == whole(7) == whole(10_000)


def test_last_day_is_the_same_at_any_part_size(spark):
    rows = strength.last_performance_rows(hot_log(spark))

    def whole(part_rows):
        docs = strength.nest_sets(rows, ["user_id", "exercise_key"], part_rows).collect()
        docs.sort(key=lambda d: (d.user_id, d.exercise_key, d.part))
        assert max(len(d.sets) for d in docs) <= part_rows
        return [(d.user_id, d.exercise_key, *(d[c] for c in strength.HEADER), *s) for d in docs for s in d.sets]

    assert whole(500) == whole(3) == whole(10_000)
    bench = [r for r in whole(500) if r[1] == "bench press"]
    assert len(bench) == 2003 and len({r[:7] for r in bench}) == 1


def test_last_performance_reads_the_sets_once(spark):
    """Sets are not read again for the sizes of documents, nor for the sessions of the latest days."""
    t = hot_log(spark)
    plan = strength.last_performance(t)._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftAnti" not in plan and "LeftSemi" not in plan
    parts = strength.last_performance(t).collect()
    want = strength.nest_sets(strength.last_performance_rows(t), ["user_id", "exercise_key"]).collect()
    assert sorted(parts, key=str) == sorted(want, key=str) and max(len(p.sets) for p in parts) == 2003


def test_last_performance_deals_sets_once(spark, monkeypatch):
    """By user and exercise there is one exchange for days, places, headers and lists, whatever the size of a part."""
    t = hot_log(spark)
    plan = strength.last_performance(t)._jdf.queryExecution().executedPlan().toString()
    assert sum("Exchange hash" in line and "exercise_key" in line.partition("ENSURE")[0] for line in plan.splitlines()) == 1
    monkeypatch.setattr(strength, "PART_ROWS", 7)
    parts = strength.last_performance(t).collect()
    want = strength.nest_sets(strength.last_performance_rows(t), ["user_id", "exercise_key"], 7).collect()
    assert len(parts) > 2003 // 7 and sorted(parts, key=str) == sorted(want, key=str)


def test_fallback_looks_at_the_sets_once(spark):
    """One join of sets and sessions answers all requests; no side is dealt again for a join of its own."""
    t = hot_log(spark)
    requests = spark.createDataFrame(
        [("u1", "Bench Press", None), ("u1", "BENCH PRESS", None), (None, "Bench Press", None)],
        "user_id string, exercise_name string, gym_equipment_id string",
    ).withColumn("user_id", F.when(F.col("user_id").isNotNull(), F.lit(
        strength.last_performance_rows(t).filter("exercise_key = 'bench press'").first().user_id)))
    found = strength.last_performance_fallback(t, requests)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftSemi" not in plan and plan.count("Join Inner") == 1
    rows = found.collect()
    assert len(rows) == 2003 and {(r.requested_machine, r.used_machine) for r in rows} == {(None, False)}


def test_every_set_may_ask_without_another_join(spark):
    """Requests of the sets themselves are those of a table made from the sets, undated sessions included."""
    t = dict(hot_log(spark))
    number = F.col("set_number").cast("int")
    t["workout_sets"] = t["workout_sets"].withColumn(
        "gym_equipment_id", F.when(number % 3 == 1, "m1").when(number % 3 == 2, "m2"))
    t["workout_sessions"] = t["workout_sessions"].unionByName(
        t["workout_sessions"].limit(1).withColumn("id", F.lit("undated")).withColumn("session_date", F.lit(None).cast("date")))
    t["workout_sets"] = t["workout_sets"].unionByName(t["workout_sets"].limit(3).withColumn(
        "session_id", F.lit("undated")).withColumn("gym_equipment_id", F.lit("elsewhere")))
    machine = F.when(number % 5 == 0, F.lit("none such")).otherwise(F.col("gym_equipment_id"))
    table = strength.performed_sets(t).select("user_id", "exercise_name", machine.alias("gym_equipment_id"))
    got = strength.last_performance_fallback(t, machine).collect()
    want = strength.last_performance_fallback(t, table).collect()
    assert sorted(got, key=str) == sorted(want, key=str)
    assert {r.requested_machine for r in got} == {"m1", "m2", "none such", "elsewhere", None}
    plan = strength_queries._fallback(t)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join Inner") == 1


def test_hot_records(spark):
    got = {r.exercise_name: r for r in strength.personal_records(hot_log(spark)).collect()}
    assert got["Bench Press"].total_sets == 2003 and got["Bench Press"].session_count == 1


def test_records_are_dealt_by_user_once(spark):
    plan = strength.personal_records(sample_log(spark))._jdf.queryExecution().executedPlan().toString()
    assert sum("Exchange" in line and "user_id" in line.partition("ENSURE")[0] for line in plan.splitlines()) == 1


def test_records_without_keys(spark):
    t = hot_log(spark)
    users = {r.user_id for r in t["workout_sessions"].select("user_id").distinct().collect()}
    assert len(users) == 1
    by_user = strength.personal_records(t).drop("user_id").collect()
    assert by_user and sorted(by_user, key=str) == sorted(strength.personal_records(t, keys=()).collect(), key=str)


SPLIT_EARLY = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "64KB",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "64KB",
    "spark.sql.adaptive.coalescePartitions.enabled": "false",
    "spark.sql.shuffle.partitions": "16",
}


@pytest.mark.parametrize("build", [
    strength.workout_detail, strength.personal_records, strength.session_detail,
    strength.sets_with_machine, strength.last_performance,
])
def test_hot_session_is_split_at_run_time(spark, build):
    t = sample_log(spark)
    sets = spark.range(0, 60_000, 1, 8).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("s"), (F.col("id") % 5000).cast("string")))
        .alias("session_id"),
        F.col("id").cast("string").alias("id"), (F.col("id") % 7).cast("smallint").alias("set_number"),
        F.when(F.col("id") % 3 == 0, "big").otherwise(F.concat(F.lit("ex"), (F.col("id") % 40).cast("string")))
        .alias("exercise_name"),
        (F.col("id") % 12).cast("smallint").alias("reps"), (F.col("id") % 300 + 1).cast("decimal(6,2)").alias("weight_lbs"),
        F.sha2(F.col("id").cast("string"), 256).alias("notes"),
    )
    sessions = spark.range(5000).select(
        F.concat(F.lit("s"), F.col("id").cast("string")).alias("id"), (F.col("id") % 100).cast("string").alias("user_id"),
        F.lit("2024-02-02").cast("date").alias("session_date"), F.lit("x").alias("name"),
    ).unionByName(spark.sql("select 'hot' as id, 'u' as user_id, date'2024-02-02' as session_date, 'hot' as name"))
    t = {**t, "workout_sets": conform(sets, "workout_sets"), "workout_sessions": conform(sessions, "workout_sessions")}
    before = {k: spark.conf.get(k, None) for k in SPLIT_EARLY}
    try:
        for k, v in SPLIT_EARLY.items():
            spark.conf.set(k, v)
        execution = build(t)._jdf.queryExecution()
        assert execution.toRdd().count() > 0
        assert "skew=true" in execution.executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_uniqueness_is_counted_in_many_small_tasks(spark):
    """Also where the table's own making already lies by the unique columns."""
    made = spark.range(3000).select(
        (F.col("id") % 1000).alias("gym_id"), (F.col("id") % 7).alias("equipment_id"), F.col("id")
    ).groupBy("gym_id", "equipment_id").agg(F.max("id").alias("id"))
    twice = made.unionByName(made.filter("gym_id < 2"))
    for table, want in ((made, 0), (twice, made.filter("gym_id < 2").count())):
        rules = TableRules(key="id", unique=(("gym_id", "equipment_id"),))
        found = quality.validate_constraints({"machines": table}, "machines", rules)
        assert "REPARTITION_BY_NUM" in found._jdf.queryExecution().executedPlan().toString()
        rows = found.collect()
        assert len(rows) == want and {r.row_count for r in rows} <= {2}

"""Lifting: set history, records, last performance, session documents."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vitalspark.functions.dates import days_before, week_start
from vitalspark.functions.numbers import mean_rounded, one_rep_max, round_to_int
from vitalspark.operators.history import page_rows
from vitalspark.skew import (
    PART_ROWS, join_optional, join_shared, position_parts, split_large,
)

Tables = Mapping[str, DataFrame]
USER = ("user_id",)


def performed_sets(t: Tables, since=None) -> DataFrame:
    """Every set with its session's owner, date and name."""
    sessions = t["workout_sessions"].select(
        F.col("id").alias("session_id"), "user_id", "session_date", F.col("name").alias("workout_name")
    )
    if since is not None:
        sessions = sessions.filter(F.col("session_date") >= since)
    return t["workout_sets"].join(sessions, "session_id")


def machines(t: Tables) -> DataFrame:
    """One row per gym machine with the names the reports show."""
    library = t["equipment_library"].select(
        F.col("id").alias("_library_id"),
        F.col("name").alias("equipment_name"),
        F.col("brand").alias("equipment_brand"),
        F.col("type").alias("equipment_type"),
    )
    gyms = t["gyms"].select(F.col("id").alias("_gym_id"), F.col("name").alias("gym_name"))
    bridge = t["gym_equipment"].select(F.col("id").alias("machine_id"), "gym_id", "equipment_id")
    return (
        bridge.join(gyms, F.col("gym_id") == F.col("_gym_id"), "left")
        .join(library, F.col("equipment_id") == F.col("_library_id"), "left")
        .select("machine_id", "equipment_name", "equipment_brand", "equipment_type", "gym_name")
    )


def sets_with_machine(t: Tables, *, keys: Sequence[str] = USER) -> DataFrame:
    """Sets with session and, where known, machine and gym names."""
    sets = performed_sets(t)
    named = join_optional(
        sets, machines(t), "gym_equipment_id", "machine_id", ["session_id", "set_number"]
    )
    return named.select(
        *keys, "session_id", "session_date", "workout_name", "set_number", "exercise_name",
        "reps", "weight_lbs", "rpe", "gym_equipment_id", "equipment_name", "equipment_brand",
        "equipment_type", "gym_name",
    )


def exercise_catalog(t: Tables) -> DataFrame:
    """Exercises with their muscle group name."""
    groups = t["muscle_groups"].select(
        F.col("id").alias("_group_id"), F.col("name").alias("muscle_group")
    )
    return (
        t["exercises"]
        .join(groups, F.col("muscle_group_id") == F.col("_group_id"), "left")
        .select("id", "name", "equipment", "is_custom", "muscle_group")
    )


def _with_library_name(sets: DataFrame, t: Tables) -> DataFrame:
    known = exercise_catalog(t).select(
        F.col("id").alias("_exercise_id"), F.col("name").alias("_library_name"), "muscle_group"
    )
    named = join_optional(
        sets, known, "exercise_id", "_exercise_id", ["session_id", "set_number"]
    )
    return named.withColumn("exercise", F.coalesce("_library_name", "exercise_name"))


def workout_detail(t: Tables, *, keys: Sequence[str] = USER) -> DataFrame:
    """One row per set for drill-through."""
    sessions = t["workout_sessions"].select(
        F.col("id").alias("session_id"), "user_id", "session_date",
        F.col("name").alias("session_name"), "duration_min",
    )
    sets = t["workout_sets"].join(sessions, "session_id")
    return _with_library_name(sets, t).select(
        *keys, "session_date", "session_name", "duration_min", "set_number", "exercise",
        "muscle_group", "weight_lbs", "reps", "rpe",
    )


def exercise_prs(t: Tables, *, keys: Sequence[str] = USER) -> DataFrame:
    """Heaviest set, most reps and last date per exercise; the two maxima are independent."""
    return (
        workout_detail(t, keys=keys)
        .groupBy(*keys, "exercise", "muscle_group")
        .agg(
            F.max("weight_lbs").alias("pr_weight_lbs"),
            F.max("reps").alias("max_reps"),
            F.max("session_date").alias("last_performed"),
        )
    )


def valid_weight(df: DataFrame, *, positive: bool = False) -> DataFrame:
    """Rows with a weight; ``positive`` also asks that it exceed zero."""
    rule = F.col("weight_lbs").isNotNull()
    return df.filter(rule & (F.col("weight_lbs") > 0) if positive else rule)


def _name_key(name: Column) -> Column:
    """Exercise in lower case; never null, so that no join filters the sets beneath it."""
    return F.coalesce(F.lower(name), F.lit("\u0000"))


def personal_records(
    t: Tables, *, keys: Sequence[str] = USER, machine_only: bool = False
) -> DataFrame:
    """Records per exercise name (as written), machine and gym.

    ``reps_at_max`` are the reps of the latest set at that weight per (keys, exercise in any case),
    over all machines. Sets meet the machine table and are then dealt once, by keys and exercise in
    any case, for everything that follows. Without keys an exercise has the sets of everyone; these are
    first reduced to one row per (exercise, machine, day, weight).
    """
    lifted = valid_weight(performed_sets(t), positive=True).select(
        *keys, "exercise_name", "gym_equipment_id", "session_date", "session_id", "set_number",
        "reps", "weight_lbs",
    )
    for k in keys:
        lifted = lifted.filter(F.col(k).isNotNull())
    most, sets = F.col("reps"), F.count(F.lit(1))
    if not keys:
        lifted = lifted.groupBy("exercise_name", "gym_equipment_id", "session_date", "weight_lbs").agg(
            F.max("reps").alias("_most"), F.count(F.lit(1)).alias("_sets"),
            F.max(F.struct("session_id", "set_number", "reps")).alias("_last"),
        ).select("*", "_last.*").drop("_last")
        most, sets = F.col("_most"), F.sum("_sets")
    named = join_optional(
        lifted, machines(t), "gym_equipment_id", "machine_id",
        [*keys, "exercise_name", "session_date"],
    )
    newest = F.max(F.struct(
        "session_date", "session_id", "set_number", "reps", "gym_equipment_id"
    )).over(Window.partitionBy(*keys, "_name_key", "weight_lbs"))
    name = _name_key(F.col("exercise_name"))
    named = named.repartition(*keys, name).withColumn("_name_key", name).withColumn("_top", newest["reps"])
    if machine_only:
        named = named.filter(F.col("gym_equipment_id").isNotNull())
        named = named.filter(F.col("gym_name").isNotNull() | F.col("equipment_name").isNotNull())
    return named.groupBy(
        *keys, "_name_key", "exercise_name", "equipment_name", "equipment_brand", "equipment_type", "gym_name"
    ).agg(
        F.max("weight_lbs").alias("max_weight_lbs"),
        F.round(F.max(one_rep_max(F.col("weight_lbs"), most)), 2).cast("decimal(8,2)").alias("estimated_1rm"),
        F.max_by("_top", "weight_lbs").alias("_top"),
        F.countDistinct("session_date").alias("session_count"),
        sets.alias("total_sets"),
        F.max("session_date").cast("string").alias("last_performed"),
        F.min("session_date").cast("string").alias("first_performed"),
    ).select(
        *keys, "exercise_name", "equipment_name", "equipment_brand", "equipment_type",
        "gym_name", "max_weight_lbs", "estimated_1rm",
        F.when(F.col("exercise_name").isNotNull(), F.col("_top")).alias("reps_at_max"),
        "session_count", "total_sets", "last_performed", "first_performed",
    )


def prs_by_machine(t: Tables, *, keys: Sequence[str] = USER) -> DataFrame:
    """Records tied to a gym or a machine."""
    return personal_records(t, keys=keys, machine_only=True)


def optional_equipment_filter(sets: DataFrame, machine_id=None) -> DataFrame:
    """All sets, or those on one machine when it is given."""
    return sets if machine_id is None else sets.filter(F.col("gym_equipment_id") == machine_id)


def last_performance_rows(
    t: Tables,
    *,
    keys: Sequence[str] = USER,
    per_machine: bool = False,
    machine_id=None,
) -> DataFrame:
    """Sets of the latest day per exercise (any case) [and machine], one row per set.

    Sets meet their sessions once and are then dealt by keys and exercise; the sets of each latest
    day are cut out with ``rank() = 1``, on the map side first.
    """
    unit = ["exercise_key", "gym_equipment_id"] if per_machine else ["exercise_key"]
    return _with_header(_latest(_dated_sets(t, unit, machine_id), [*keys, *unit]), t, keys)


def _dated_sets(t: Tables, unit: Sequence[str], machine_id=None) -> DataFrame:
    sets = optional_equipment_filter(t["workout_sets"], machine_id).select(
        "session_id", "set_number", "gym_equipment_id", *SET_VALUES, F.lower("exercise_name").alias("exercise_key"),
    )
    for c in unit:
        sets = sets.filter(F.col(c).isNotNull())
    sessions = t["workout_sessions"].select(
        F.col("id").alias("session_id"), "user_id", "session_date", F.col("name").alias("workout_name")
    )
    return sets.join(sessions, "session_id")


def _latest(rows: DataFrame, by: Sequence[str]) -> DataFrame:
    newest = F.rank().over(Window.partitionBy(*by).orderBy(F.col("session_date").desc()))
    return rows.withColumn("_rank", newest).filter(F.col("_rank") == 1).drop("_rank")


def _with_header(rows: DataFrame, t: Tables, keys: Sequence[str]) -> DataFrame:
    return join_optional(
        rows, machines(t), "gym_equipment_id", "machine_id", ["session_id", "set_number"]
    ).select(
        *keys, "exercise_key", "gym_equipment_id", "session_id", "session_date", "workout_name",
        "equipment_name", "equipment_brand", "gym_name", "set_number", *SET_VALUES,
    )


SET_VALUES = ("reps", "weight_lbs", "rpe")
HEADER = ("session_date", "workout_name", "equipment_name", "equipment_brand", "gym_name")
#: Order of the sets of a document, and what it shows of each.
SET_ORDER = ("set_number", "session_id", *SET_VALUES, "gym_equipment_id")
SHOWN = ("set_number", *SET_VALUES)


def nest_sets(rows: DataFrame, by: Sequence[str], part_rows: int = PART_ROWS) -> DataFrame:
    """Rows of ``last_performance_rows`` as header plus an ordered list of sets.

    The header is that of the first set: lowest set number, then session. A document comes in
    parts of ``part_rows`` sets, numbered by ``part`` from 0; every part has the same header and
    they follow one another in order.
    """
    small, large = split_large(rows, by, part_rows)
    whole = small.groupBy(*by).agg(
        F.sort_array(F.collect_list(F.struct(*SET_ORDER, *HEADER))).alias("_sets")
    ).select(
        *by, F.lit(0).alias("part"), *[F.col("_sets")[0][c].alias(c) for c in HEADER],
        F.transform("_sets", lambda s: F.struct(*[s[c].alias(c) for c in SHOWN])).alias("sets"),
    )
    placed = position_parts(
        large, by, F.col("set_number"), [F.col(c).asc_nulls_first() for c in SET_ORDER], part_rows
    )
    first = placed.filter(F.col("place") == 1).select(*by, *HEADER)
    lists = _part_lists(placed, by)
    return whole.unionByName(join_shared(lists, first, by).select(*by, "part", *HEADER, "sets"))


def _part_lists(placed: DataFrame, by: Sequence[str], *more: Column) -> DataFrame:
    return placed.groupBy(*by, "part").agg(*more, F.transform(
        F.sort_array(F.collect_list(F.struct("place", *SHOWN))),
        lambda s: F.struct(*[s[c].alias(c) for c in SHOWN]),
    ).alias("sets"))


def last_performance(
    t: Tables, *, keys: Sequence[str] = USER, per_machine: bool = False, machine_id=None
) -> DataFrame:
    """Latest day per exercise as one document with its sets, in parts as ``nest_sets`` gives them.

    Sets meet the machine table and are then dealt once, by keys and exercise: the latest days, the places
    of the sets, the header and the lists follow in place. The sets of one latest day are thus sorted in one
    task, on disk where memory is short, and listed part by part.
    """
    unit = ["exercise_key", "gym_equipment_id"] if per_machine else ["exercise_key"]
    by = [*keys, *unit]
    rows = _latest(_with_header(_dated_sets(t, unit, machine_id), t, keys), by)
    order = Window.partitionBy(*by).orderBy(*[F.col(c).asc_nulls_first() for c in (*SET_ORDER, *HEADER)])
    so_far = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = rows.select(
        *by, *SHOWN, F.row_number().over(order).alias("place"), F.first(F.struct(*HEADER)).over(so_far).alias("_header")
    ).withColumn("part", F.floor((F.col("place") - 1) / PART_ROWS).cast("int"))
    return _part_lists(placed, by, F.first("_header").alias("_header")).select(*by, "part", "_header.*", "sets")


def last_performance_fallback(
    t: Tables, requests: DataFrame | Column, *, keys: Sequence[str] = USER
) -> DataFrame:
    """Per requested (keys, exercise, machine): machine history, else that of any machine.

    ``requests`` has the key columns, ``exercise_name`` and ``gym_equipment_id``
    (which may be null). Where every set asks for its own keys and exercise it is the machine asked for,
    as a column over the columns of a set; requests then come from the rows of the sets, which
    are not read and joined a second time. Returns one row per set with ``used_machine``; for documents
    pass it to ``nest_sets`` by keys, exercise_key, requested_machine and used_machine.

    Sets meet their sessions once and are dealt by keys and exercise together with the requests. There
    windows find the latest day of each machine and of any, and which requests no machine answers; a set
    then names the requests it answers, so neither side is read or dealt a second time.
    """
    unit = [*keys, "exercise_key"]
    seen = ("session_id", "session_date", "workout_name", "set_number", *SET_VALUES)
    performed = performed_sets(t).withColumn("exercise_key", F.lower("exercise_name"))
    if isinstance(requests, Column):
        both = performed.withColumn("_machine", requests).withColumn(
            "_asked", F.explode(F.array(F.lit(False), F.lit(True)))
        ).select(
            *unit, F.when(F.col("_asked"), F.col("_machine")).otherwise(F.col("gym_equipment_id")).alias("gym_equipment_id"),
            *[F.when(~F.col("_asked"), F.col(c)).alias(c) for c in seen], "_asked",
        ).filter(F.col("_asked") | F.col("session_date").isNotNull())
    else:
        asked = requests.select(
            *keys, F.lower("exercise_name").alias("exercise_key"), "gym_equipment_id", F.lit(True).alias("_asked")
        )
        both = performed.filter(F.col("session_date").isNotNull()).select(
            *unit, "gym_equipment_id", *seen, F.lit(False).alias("_asked")
        ).unionByName(asked, allowMissingColumns=True)
    for k in unit:
        both = both.filter(F.col(k).isNotNull())
    on_machine, anywhere = Window.partitionBy(*unit, "gym_equipment_id"), Window.partitionBy(*unit)
    machine = F.struct(F.col("gym_equipment_id").alias("requested_machine"))
    known = both.repartition(*unit).withColumn(
        "_day", F.when(F.col("gym_equipment_id").isNotNull(), F.max("session_date").over(on_machine))
    ).withColumn("_wanted", F.max("_asked").over(on_machine)).withColumn(
        "_last", F.max("session_date").over(anywhere)
    ).withColumn(
        "_others", F.collect_set(F.when(F.col("_asked") & F.col("_day").isNull(), machine)).over(anywhere)
    )
    def answers(requested: Column, used: bool) -> Column:
        return F.struct(requested.alias("requested_machine"), F.lit(used).alias("used_machine"))

    special = F.filter(
        F.array(answers(F.col("gym_equipment_id"), True)),
        lambda _: F.col("_wanted") & (F.col("session_date") == F.col("_day")),
    )
    general = F.transform(
        F.when(F.col("session_date") == F.col("_last"), F.col("_others")).otherwise(F.slice("_others", 1, 0)),
        lambda m: answers(m["requested_machine"], False),
    )
    rows = known.filter(~F.col("_asked")).withColumn(
        "_for", F.explode(F.concat(special, general))
    ).select("*", "_for.*")
    return join_optional(
        rows, machines(t), "gym_equipment_id", "machine_id", ["session_id", "set_number"]
    ).select(
        *unit, "requested_machine", "used_machine", "gym_equipment_id", "session_id", *HEADER,
        "set_number", *SET_VALUES,
    )


def session_list(
    t: Tables, *, keys: Sequence[str] = USER, limit: int | None = None, offset: int = 0
) -> DataFrame:
    """All sessions, or a page per user, with gym name and number of different exercises.

    Names are reduced per (session, name) before they are counted per session, so a
    session of any size is one row when it meets the page.
    """
    order = [
        F.col("session_date").desc(), F.col("created_at").desc_nulls_first(), F.col("id").desc()
    ]
    page = t["workout_sessions"]
    if limit is not None:
        page = page_rows(page, keys, "session_date", order, limit=limit, offset=offset)
    counts = t["workout_sets"].groupBy("session_id").agg(
        F.countDistinct("exercise_name").alias("_exercises")
    )
    gyms = t["gyms"].select(F.col("id").alias("_gym_id"), F.col("name").alias("gym_name"))
    listed_sessions = page.join(counts, F.col("id") == F.col("session_id"), "left").drop("session_id")
    return join_optional(listed_sessions, gyms, "gym_id", "_gym_id", ["id"]).select(
        *keys, "id", "session_date", "name", "duration_min", "notes", "created_at", "gym_id",
        "gym_name", F.coalesce("_exercises", F.lit(0)).alias("exercise_count"),
    )


def session_detail(t: Tables, part_rows: int = PART_ROWS) -> DataFrame:
    """Each session with its exercises by name and their sets in order, nested.

    A session comes in parts of ``part_rows`` sets, numbered by ``part`` from 0, that follow one
    another in order; an exercise that is cut goes on at the start of the next part. ``first_place``
    is the position of an entry's first set in its exercise.
    """
    values = ["set_number", "reps", "weight_lbs", "rpe", "notes"]
    sets = t["workout_sets"].select("session_id", "exercise_name", *values)
    small, large = split_large(sets.filter(F.col("session_id").isNotNull()), ["session_id"], part_rows)

    def shown(c: str) -> Column:
        return F.transform(c, lambda s: F.struct(*[s[v].alias(v) for v in values[1:]])).alias("sets")

    whole = small.groupBy("session_id", "exercise_name").agg(
        F.sort_array(F.collect_list(F.struct(*values))).alias("_sets")
    ).select("session_id", F.lit(0).alias("part"), "exercise_name", F.lit(1).cast("long").alias("first_place"),
             F.lit(1).cast("long").alias("_from"), shown("_sets"))
    order = [F.col(c).asc_nulls_first() for c in ("exercise_name", *values)]
    parted = position_parts(large, ["session_id"], F.col("exercise_name"), order, part_rows)
    cut = parted.groupBy("session_id", "part", "exercise_name").agg(
        F.min("place").cast("long").alias("_from"),
        F.sort_array(F.collect_list(F.struct("place", *values[1:]))).alias("_sets"),
    )
    starts = cut.groupBy("session_id", "exercise_name").agg(F.min("_from").alias("_start"))
    split = join_shared(cut, starts, ["session_id", "exercise_name"]).select(
        "session_id", "part", "exercise_name", (F.col("_from") - F.col("_start") + 1).alias("first_place"),
        "_from", shown("_sets"),
    )

    def documents(entries: DataFrame) -> DataFrame:
        # small sessions are in order of the name, parts of large ones in order of their places
        return entries.groupBy("session_id", "part").agg(F.transform(
            F.sort_array(F.collect_list(F.struct(
                "_from", F.col("exercise_name").alias("name"), "first_place", "sets"))),
            lambda e: F.struct(*[e[c].alias(c) for c in ("name", "first_place", "sets")]),
        ).alias("exercises"))

    made = documents(whole).unionByName(documents(split))
    sessions = t["workout_sessions"]
    return sessions.join(made, F.col("id") == F.col("session_id"), "left").select(
        *sessions.columns, F.coalesce("part", F.lit(0)).alias("part"), "exercises"
    )


def session_detail_rows(details: DataFrame, *columns: str) -> DataFrame:
    """Nested session documents laid out again, one row per set."""
    return (
        details.select(*columns, F.explode("exercises").alias("_e"))
        .select(
            *columns, F.col("_e.name").alias("exercise_name"), F.col("_e.first_place").alias("_f"),
            F.posexplode("_e.sets").alias("_p", "_s"),
        )
        .select(
            *columns, "exercise_name", (F.col("_p") + F.col("_f")).alias("place"), "_s.reps",
            "_s.weight_lbs", "_s.rpe", "_s.notes",
        )
    )


def weekly_workouts(t: Tables, *, keys: Sequence[str] = USER) -> DataFrame:
    """Sessions and minutes per Monday week."""
    return (
        t["workout_sessions"]
        .groupBy(*keys, week_start(F.col("session_date")).alias("week_start"))
        .agg(
            F.count(F.lit(1)).alias("session_count"),
            F.sum("duration_min").alias("total_duration_min"),
            mean_rounded(F.col("duration_min"), 1).alias("avg_duration_min"),
        )
    )


def volume_by_day(t: Tables, *, keys: Sequence[str] = USER, as_of=None, days: int = 7) -> DataFrame:
    """Pounds moved per day; a day whose sessions have no sets shows 0.

    Sets are summed per session before they meet the sessions, on the same key, so a
    session of any size is one row in the join. With ``as_of`` the few recent sessions
    let Spark put a runtime filter on a large scan of sets.
    """
    sessions = t["workout_sessions"].select(*keys, "id", "session_date")
    if as_of is not None:
        sessions = sessions.filter(F.col("session_date") >= days_before(as_of, days))
    moved = t["workout_sets"].groupBy("session_id").agg(
        F.sum(F.col("weight_lbs") * F.col("reps").cast("decimal(5,0)")).alias("_lbs")
    )
    return (
        sessions.join(moved, F.col("id") == F.col("session_id"), "left")
        .groupBy(*keys, F.col("session_date").alias("date"))
        .agg(round_to_int(F.coalesce(F.sum("_lbs"), F.lit(0))).alias("total_lbs"))
    )

"""Table-change queries: the new table, or each batch row with its outcome."""

from collections import ChainMap

from pyspark.sql import functions as F

from vitalspark.operators import changes, quality
from vitalspark.plans.catalog import query
from vitalspark.plans.intake_queries import MEASURED, MEASURED_COLUMNS, measured
from vitalspark.schemas import RULES, TableRules
from vitalspark.sources.domain import AS_OF

NOW = f"timestamp '{AS_OF} 00:00:00'"


# ---- insert if absent ----
PLACED = """
select a.*, case when a.name is null or a.brand is null then null
    when exists (select 1 from equipment_library l where l.name = a.name and l.brand = a.brand)
      then 'already stored'
    when row_number() over (partition by a.name, a.brand order by a.arrival) > 1 then 'repeated in batch'
  end as reason
from library_additions a"""


def _library_change(t):
    return changes.insert_if_absent(t["equipment_library"], t["library_additions"], ["name", "brand"])


query(
    "insert_if_absent", "arrival:n name:s brand:s type:s reason:s", "equipment_library library_additions",
    PLACED,
)(lambda t: _library_change(t).batch)
query(
    "insert_if_absent_snapshot", "name:s brand:s type:s category:s", "equipment_library library_additions",
    f"""select name, brand, type, category from equipment_library
        union all select name, brand, type, category from ({PLACED}) where reason is null""",
)(lambda t: _library_change(t).snapshot)
query(
    "insert_waitlist", "email:s", "waitlist signups",
    """select email from waitlist union
       select lower(trim(email)) from signups where contains(email, '@')""",
)(
    lambda t: changes.insert_if_absent(
        t["waitlist"],
        t["signups"].filter(F.col("email").contains("@")).withColumn("email", F.lower(F.trim("email"))),
        ["email"],
    ).snapshot
)
query(
    "semi_anti_for_upsert", "arrival:n name:s brand:s stored:b", "equipment_library library_additions",
    """select a.*, exists (select 1 from equipment_library l where l.name = a.name and l.brand = a.brand) as stored
       from library_additions a""",
)(
    lambda t: (lambda pair: pair[0].withColumn("stored", F.lit(True)).unionByName(
        pair[1].withColumn("stored", F.lit(False))
    ))(changes.semi_anti_for_upsert(t["equipment_library"], t["library_additions"], ["name", "brand"]))
)

query(
    "upsert_settings", "user_id:n key:s value:s updated_at:t", "user_settings setting_changes",
    f"""
    with n as (select user_id, key, max_by(value, arrival) as value from setting_changes group by 1, 2)
    select coalesce(n.user_id, o.user_id) as user_id, coalesce(n.key, o.key) as key,
      case when n.user_id is not null then n.value else o.value end as value,
      case when n.user_id is not null then {NOW} else o.updated_at end as updated_at
    from user_settings o full join n on n.user_id = o.user_id and n.key = o.key""",
)(lambda t: changes.upsert_settings(t["user_settings"], t["setting_changes"], AS_OF))

PATCHES = """
select p.arrival, p.id, case when p.other_id = p.id then w.user_id end as user_id, p.name, p.duration_min, p.notes
from session_patches p join workout_sessions w on w.id = p.id"""


def _patches(t):
    owners = t["workout_sessions"].select("id", "user_id")
    return t["session_patches"].join(owners, "id").select(
        "arrival", "id", F.when(F.col("other_id") == F.col("id"), F.col("user_id")).alias("user_id"),
        "name", "duration_min", "notes",
    )


query(
    "patch_sessions", "id:n user_id:n name:s duration_min:n notes:s", "workout_sessions session_patches",
    f"""
    with p as (select id, user_id,
        max_by(name, arrival) filter (where name is not null) as name,
        max_by(duration_min, arrival) filter (where duration_min is not null) as duration_min,
        max_by(notes, arrival) filter (where notes is not null) as notes
      from ({PATCHES}) where user_id is not null group by 1, 2)
    select w.id, w.user_id, coalesce(p.name, w.name) as name,
      coalesce(p.duration_min, w.duration_min) as duration_min, coalesce(p.notes, w.notes) as notes
    from workout_sessions w left join p on p.id = w.id and p.user_id = w.user_id""",
)(lambda t: changes.patch_sessions(t["workout_sessions"], _patches(t)).snapshot)
query(
    "patch_sessions_rejected", "arrival:s id:n reason:s", "workout_sessions session_patches",
    f"select arrival, id, 'session not found' as reason from ({PATCHES}) where user_id is null",
)(lambda t: changes.patch_sessions(t["workout_sessions"], _patches(t)).rejected)

EDITS = """
select l_suppkey * 10000000 + l_partkey as id, l_suppkey as gym_id,
  max(case when l_linestatus = 'F' then '' else 'fair' end) as condition,
  cast(min(l_linenumber) % 3 as int) as weight_min_lbs, cast(null as int) as weight_max_lbs,
  max(case when l_tax > 0.04 then ' tight fit ' end) as notes, max(l_orderkey) as arrival
from lineitem group by l_suppkey, l_partkey"""


def _edits(t):
    return t.raw("lineitem").groupBy(
        (F.col("l_suppkey") * 10000000 + F.col("l_partkey")).alias("id"), F.col("l_suppkey").alias("gym_id")
    ).agg(
        F.max(F.when(F.col("l_linestatus") == "F", "").otherwise("fair")).alias("condition"),
        (F.min("l_linenumber") % 3).cast("int").alias("weight_min_lbs"),
        F.lit(None).cast("int").alias("weight_max_lbs"),
        F.max(F.when(F.col("l_tax") > 0.04, " tight fit ")).alias("notes"),
        F.max("l_orderkey").alias("arrival"),
    )


query(
    "replace_rows", "id:n gym_id:n condition:s weight_min_lbs:n weight_max_lbs:n notes:s added_by:s",
    "gym_equipment",
    f"""
    select g.id, g.gym_id, g.added_by,
      case when e.id is null then g.condition else coalesce(nullif(e.condition, ''), 'good') end as condition,
      case when e.id is null then g.weight_min_lbs else nullif(e.weight_min_lbs, 0) end as weight_min_lbs,
      case when e.id is null then g.weight_max_lbs end as weight_max_lbs,
      case when e.id is null then g.notes else trim(e.notes) end as notes
    from gym_equipment g left join ({EDITS}) e on e.id = g.id and e.gym_id = g.gym_id""",
)(
    lambda t: changes.replace_rows(
        t["gym_equipment"], _edits(t), ["id", "gym_id"],
        {"condition": "good", "weight_min_lbs": None, "weight_max_lbs": None, "notes": None},
    ).snapshot
)

# ---- deletes ----
GONE_SESSIONS = "select id, user_id from workout_sessions where notes = '1-URGENT'"
query(
    "delete_owned_cascade", "session_id:n set_number:n exercise_name:s weight_lbs:f",
    "workout_sessions workout_sets",
    f"""select s.* from workout_sets s where s.session_id not in (select id from ({GONE_SESSIONS}))""",
)(
    lambda t: changes.delete_owned_cascade(
        {"workout_sessions": t["workout_sessions"], "workout_sets": t["workout_sets"]},
        "workout_sessions",
        t["workout_sessions"].filter(F.col("notes") == "1-URGENT").select("id", "user_id"),
    )[0]["workout_sets"]
)
query(
    "delete_users_cascade", "kind:s id:n owner:n", "users workout_sessions body_metrics gyms workout_sets",
    """
    with gone as (select id from users where not is_active),
    sessions as (select * from workout_sessions where user_id not in (select id from gone))
    select 'session' as kind, id, user_id as owner from sessions
    union all select 'metric', id, user_id from body_metrics where user_id not in (select id from gone)
    union all select 'gym', id, case when created_by in (select id from gone) then null else created_by end from gyms
    union all select 'set', session_id, set_number from workout_sets where session_id in (select id from sessions)""",
)(
    lambda t: _user_deletion(
        changes.delete_owned_cascade(
            {n: t[n] for n in ("users", "workout_sessions", "body_metrics", "gyms", "workout_sets")},
            "users", t["users"].filter(~F.col("is_active")).select("id"), key=("id",),
        )[0]
    )
)


def _user_deletion(out):
    def rows(kind, table, id_column, owner):
        return out[table].select(F.lit(kind).alias("kind"), F.col(id_column).alias("id"), F.col(owner).alias("owner"))

    return (
        rows("session", "workout_sessions", "id", "user_id")
        .unionByName(rows("metric", "body_metrics", "id", "user_id"))
        .unionByName(rows("gym", "gyms", "id", "created_by"))
        .unionByName(rows("set", "workout_sets", "session_id", "set_number"))
    )


query(
    "delete_custom_only", "id:n name:s is_custom:b", "exercises",
    "select * from exercises where not (is_custom and equipment = 'SMALL')",
)(
    lambda t: changes.delete_custom_only(
        t["exercises"], t["exercises"].filter(F.col("equipment") == "SMALL").select("id")
    ).snapshot
)
query(
    "delete_custom_only_rejected", "id:n reason:s", "exercises",
    """select id, 'default rows stay' as reason from exercises where not is_custom and equipment = 'SMALL'
       union all select id + 100000000, 'not found' from exercises where equipment = 'LARGE'""",
)(
    lambda t: changes.delete_custom_only(
        t["exercises"],
        t["exercises"].filter(F.col("equipment") == "SMALL").select("id").unionAll(
            t["exercises"].filter(F.col("equipment") == "LARGE").select(F.col("id") + 100000000)
        ),
    ).rejected
)
query(
    "backfill_owner", "id:n created_by:n", "gyms",
    "select id, coalesce(created_by, 1) as created_by from gyms",
)(lambda t: changes.backfill_owner(t["gyms"], 1, "created_by"))
query(
    "resolve_exercise_ids", "id:n muscle_group:s muscle_group_id:n", "exercises muscle_groups",
    """select e.id, e.wanted as muscle_group, m.id as muscle_group_id from (
         select id, case when is_custom then upper(n_name) else lower(n_name) end as wanted
         from exercises left join nation on n_nationkey = muscle_group_id) e
       left join muscle_groups m on m.name = e.wanted""",
)(
    lambda t: changes.resolve_exercise_ids(
        t["exercises"].join(t.raw("nation"), F.col("muscle_group_id") == F.col("n_nationkey"), "left").select(
            "id", F.when(F.col("is_custom"), F.upper("n_name")).otherwise(F.lower("n_name")).alias("muscle_group")
        ),
        t["muscle_groups"],
    )
)

# ---- constraints ----
DOUBTFUL = TableRules(
    not_null=("weight_lbs", "created_at"),
    one_of={"source": ("manual", "import")},
    max_length={"source": 5},
    decimal_range={"weight_lbs": (4, 2)},
    unique=(("user_id", "measurement_date"),),
    unique_where=((("renpho_user_id", "measured_at"), "source = 'renpho'"),),
    foreign={"user_id": ("users", "id")},
)
query(
    "validate_constraints", "rule:s row_key:s row_count:n", "body_metrics users",
    """
    select 'weight_lbs is null' as rule, id::varchar as row_key, 1 as row_count from body_metrics where weight_lbs is null
    union all select 'created_at is null', id::varchar, 1 from body_metrics where created_at is null
    union all select 'source not in list', id::varchar, 1 from body_metrics where source not in ('manual', 'import')
    union all select 'source longer than 5', id::varchar, 1 from body_metrics where length(source) > 5
    union all select 'weight_lbs out of range', id::varchar, 1 from body_metrics where abs(weight_lbs) >= 100
    union all select '(user_id, measurement_date) not unique', user_id::varchar || '|' || measurement_date::varchar, count(*)
      from body_metrics group by user_id, measurement_date having count(*) > 1
    union all select '(renpho_user_id, measured_at) not unique', renpho_user_id::varchar || '|' || measured_at::varchar, count(*)
      from body_metrics where source = 'renpho' and renpho_user_id is not null group by renpho_user_id, measured_at having count(*) > 1
    union all select 'user_id has no users', user_id::varchar, count(*) from body_metrics
      where user_id not in (select id from users) group by user_id""",
)(lambda t: quality.validate_constraints(t, "body_metrics", DOUBTFUL))
query(
    "validate_gym_equipment", "rule:s row_key:s row_count:n", "gym_equipment gyms equipment_library",
    """
    select 'condition not in list' as rule, id::varchar as row_key, 1 as row_count from gym_equipment
      where condition not in ('excellent', 'good', 'fair', 'out_of_service')
    union all select '(gym_id, equipment_id) not unique', gym_id || '|' || equipment_id, count(*)
      from gym_equipment group by gym_id, equipment_id having count(*) > 1
    union all select 'gym_id has no gyms', gym_id::varchar, count(*) from gym_equipment
      where gym_id not in (select id from gyms where state <> 'ASIA') group by gym_id
    union all select 'equipment_id has no equipment_library', equipment_id::varchar, count(*) from gym_equipment
      where equipment_id not in (select id from equipment_library) group by equipment_id""",
)(
    lambda t: quality.validate_constraints(
        ChainMap({"gyms": t["gyms"].filter(F.col("state") != "ASIA")}, t), "gym_equipment",
        RULES["gym_equipment"],
    )
)
query(
    "quarantine", "id:n reason:s", "gym_equipment gyms equipment_library",
    """select id, case when gym_id not in (select id from gyms where state <> 'ASIA') then 'gym_id has no gyms' end as reason
       from gym_equipment""",
)(
    lambda t: (lambda s: s.accepted.withColumn("reason", F.lit(None).cast("string")).unionByName(s.rejected))(
        quality.quarantine(
            ChainMap({"gyms": t["gyms"].filter(F.col("state") != "ASIA")}, t), "gym_equipment",
            RULES["gym_equipment"],
        )
    )
)

# ---- equipment status ----
REPORTS = """
select case when l_linenumber = 7 then -1 else l_suppkey * 10000000 + l_partkey end as gym_equipment_id,
  cast(l_shipdate as timestamp) as reported_at, ' stuck ' as notes
from lineitem"""


def _reports(t):
    return t.raw("lineitem").select(
        F.when(F.col("l_linenumber") == 7, F.lit(-1).cast("bigint"))
        .otherwise(F.col("l_suppkey") * 10000000 + F.col("l_partkey")).alias("gym_equipment_id"),
        F.col("l_shipdate").cast("timestamp").alias("reported_at"), F.lit(" stuck ").alias("notes"),
    )


STATUS = "id:n is_out_of_service:b condition:s oos_reported_at:t oos_auto_clear_at:t"
query(
    "report_oos", STATUS, "gym_equipment",
    f"""
    with r as (select gym_equipment_id, max(reported_at) as at from ({REPORTS}) group by 1)
    select g.id, g.is_out_of_service or r.at is not null as is_out_of_service,
      case when r.at is not null then 'out_of_service' else g.condition end as condition,
      coalesce(r.at, g.oos_reported_at) as oos_reported_at,
      case when r.at is not null then r.at + interval 30 day else g.oos_auto_clear_at end as oos_auto_clear_at
    from gym_equipment g left join r on r.gym_equipment_id = g.id""",
)(lambda t: changes.report_oos(t["gym_equipment"], t["equipment_oos_reports"], _reports(t))[0])
query(
    "report_oos_history", "gym_equipment_id:n reported_at:t notes:s reason:s",
    "gym_equipment equipment_oos_reports",
    f"""select gym_equipment_id, reported_at, notes, null as reason from equipment_oos_reports
        union all select gym_equipment_id, reported_at, 'stuck', null from ({REPORTS})
          where gym_equipment_id in (select id from gym_equipment)
        union all select gym_equipment_id, reported_at, notes, 'machine not found' from ({REPORTS})
          where gym_equipment_id not in (select id from gym_equipment)""",
)(
    lambda t: (lambda out: out[1].select(
        "gym_equipment_id", "reported_at", "notes", F.lit(None).cast("string").alias("reason")
    ).unionByName(out[2].select("gym_equipment_id", "reported_at", "notes", "reason")))(
        changes.report_oos(t["gym_equipment"], t["equipment_oos_reports"], _reports(t))
    )
)
FIXED = f"select distinct gym_equipment_id from ({REPORTS})"
query(
    "resolve_oos", STATUS, "gym_equipment",
    f"""select id, is_out_of_service and id not in ({FIXED}) as is_out_of_service,
          case when id in ({FIXED}) then 'good' else condition end as condition,
          case when id not in ({FIXED}) then oos_reported_at end as oos_reported_at,
          case when id not in ({FIXED}) then oos_auto_clear_at end as oos_auto_clear_at
        from gym_equipment""",
)(lambda t: changes.resolve_oos(t["gym_equipment"], t["equipment_oos_reports"], _reports(t), AS_OF)[0])
query(
    "resolve_oos_reports", "id:n gym_equipment_id:n resolved_at:t", "equipment_oos_reports",
    f"""select id, gym_equipment_id, case when resolved_at is null and gym_equipment_id in ({FIXED})
          then {NOW} else resolved_at end as resolved_at from equipment_oos_reports""",
)(lambda t: changes.resolve_oos(t["gym_equipment"], t["equipment_oos_reports"], _reports(t), AS_OF)[1])
_PASSED = f"is_out_of_service and oos_auto_clear_at is not null and oos_auto_clear_at < {NOW}"
query(
    "expire_oos", STATUS, "gym_equipment",
    f"""select id, condition, case when {_PASSED} then false else is_out_of_service end as is_out_of_service,
          case when {_PASSED} then null else oos_reported_at end as oos_reported_at,
          case when {_PASSED} then null else oos_auto_clear_at end as oos_auto_clear_at from gym_equipment""",
)(lambda t: changes.expire_oos(t["gym_equipment"], AS_OF))
query(
    "apply_flags", "id:n flag_count:n is_flagged:b", "gym_equipment equipment_flags",
    """select g.id, g.flag_count + coalesce(f.n, 0) as flag_count,
         g.is_flagged or (f.n is not null and g.flag_count + f.n >= 3) as is_flagged
       from gym_equipment g left join (select target_id, count(*) as n from equipment_flags
         where target_type = 'gym_equipment' group by 1) f on f.target_id = g.id""",
)(lambda t: changes.apply_flags(t["gym_equipment"], t["equipment_flags"], "gym_equipment"))

LOADED = f"""
select m.*, case when rejected_field is not null then 'unreadable ' || rejected_field
    when measured_at <= mark then 'not newer than the last load'
    when row_number() over (partition by m.renpho_user_id, measured_at,
        rejected_field is null and (mark is null or measured_at > mark) order by arrival) > 1
      then 'repeated in batch' end as reason
from ({MEASURED}) m left join (select renpho_user_id, max(measured_at) as mark from body_metrics
  where source = 'renpho' group by 1) b on b.renpho_user_id = m.renpho_user_id"""
query(
    "load_scale_measurements", f"arrival:n renpho_user_id:n {MEASURED_COLUMNS} reason:s",
    "body_metrics scale_readings", LOADED,
)(lambda t: changes.load_scale_measurements(t["body_metrics"], measured(t)).batch)

query(
    "update_status", "id:n is_active:b last_login:t", "users workout_sessions",
    f"""
    with seen as (select user_id, max(created_at) as at from workout_sessions group by 1)
    select u.id, u.is_active and u.role <> 'member' as is_active, coalesce(s.at, u.last_login) as last_login
    from users u left join seen s on s.user_id = u.id""",
)(
    lambda t: changes.touch_last_login(
        changes.deactivate_users(
            t["users"],
            t["users"].select(
                "id", F.when(F.col("role") == "admin", F.col("id")).otherwise(F.lit(0)).alias("requested_by")
            ),
        ).snapshot,
        t["workout_sessions"].select(F.col("user_id").alias("id"), F.col("created_at").alias("at")),
    )
)
USES = """
select o_orderkey as arrival, concat(' code-', cast(o_custkey as varchar)) as code, o_custkey as user_id,
  cast(o_orderdate as timestamp) + interval 8218 day as used_at from orders"""
query(
    "mark_invites_used", "id:n code:s used_by:n used_at:t", "invite_codes",
    f"""
    with u as (select upper(trim(code)) as code, user_id, used_at, arrival from ({USES})),
    ok as (select u.*, row_number() over (partition by u.code order by arrival) as place
      from u join invite_codes i on i.code = u.code
      where i.used_at is null and (i.expires_at is null or i.expires_at > u.used_at))
    select i.id, i.code, coalesce(ok.user_id, i.used_by) as used_by, coalesce(ok.used_at, i.used_at) as used_at
    from invite_codes i left join ok on ok.code = i.code and ok.place = 1""",
)(
    lambda t: changes.mark_invites_used(
        t["invite_codes"],
        t.raw("orders").select(
            F.col("o_orderkey").alias("arrival"),
            F.concat(F.lit(" code-"), F.col("o_custkey").cast("string")).alias("code"),
            F.col("o_custkey").alias("user_id"),
            (F.col("o_orderdate").cast("timestamp") + F.expr("interval 8218 days")).alias("used_at"),
        ),
    ).snapshot
)

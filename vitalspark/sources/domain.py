"""The model's tables derived from the general test tables.

One SQL text per table, accepted by Spark and by DuckDB. ``{name}`` stands for a
general table. The last day of data is AS_OF.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession

AS_OF = "2024-01-31"
SHIFT = 8218  # days, a multiple of 7, so that orders end with the events

TABLE_SQL = {
    "users": """
        select c_custkey as id, lower(concat(c_name, '@example.com')) as email,
          c_name as display_name,
          case when c_custkey % 100 = 0 then 'admin' else 'member' end as role,
          c_acctbal >= 0 as is_active,
          cast(date '2020-01-01' + cast(c_custkey % 1000 as int) as timestamp) as created_at,
          case when c_nationkey < 5 then null
            else cast(date '2023-06-01' + cast(c_custkey % 200 as int) as timestamp) end as last_login
        from {customer}""",
    "invite_codes": """
        select c_custkey as id, concat('CODE-', cast(c_custkey as varchar(12))) as code,
          case when c_nationkey % 2 = 0 then c_custkey + 1 end as created_by,
          case when c_custkey % 3 = 0 then c_custkey + 1 end as used_by,
          case when c_custkey % 3 = 0
            then cast(date '2024-01-01' + cast(c_custkey % 30 as int) as timestamp) end as used_at,
          case when c_custkey % 4 = 0 then null
            else cast(date '2024-01-01' + cast(c_custkey % 60 as int) as timestamp) end as expires_at,
          cast(date '2023-12-01' + cast(c_custkey % 31 as int) as timestamp) as created_at,
          c_mktsegment as note
        from {customer}""",
    "waitlist": """
        select lower(concat(c_name, '@list.example')) as email,
          case when c_nationkey % 3 = 0
            then cast(date '2024-01-01' + cast(c_custkey % 30 as int) as timestamp) end as invited_at,
          cast(date '2023-11-01' + cast(c_custkey % 60 as int) as timestamp) as created_at
        from {customer} where c_acctbal < 0""",
    "user_settings": """
        select o_custkey as user_id, concat('pref', cast(o_orderkey % 4 as varchar(4))) as key,
          max(case when o_orderstatus = 'P' then o_orderpriority
            else concat('{{"p":"', o_orderpriority, '"}}') end) as value,
          cast(max(o_orderdate) as timestamp) as updated_at
        from {orders} group by o_custkey, concat('pref', cast(o_orderkey % 4 as varchar(4)))""",
    "muscle_groups": """
        select n_nationkey as id, n_name as name, n_regionkey = 0 as is_custom from {nation}""",
    "exercises": """
        select p_partkey as id, concat(p_name, ' ', cast(p_partkey as varchar(12))) as name,
          case when p_size % 8 = 0 then null else cast(p_partkey % 25 as int) end as muscle_group_id,
          p_type as equipment, p_size > 25 as is_custom
        from {part}""",
    "workout_sessions": f"""
        select o_orderkey as id, o_custkey as user_id,
          cast(o_orderdate as date) + {SHIFT} as session_date, o_orderpriority as name,
          case when o_orderstatus = 'P' then null
            else cast(cast(floor(o_totalprice) as bigint) % 90 + 15 as int) end as duration_min,
          case when o_orderstatus = 'F' then o_orderpriority end as notes,
          case when o_orderkey % 5 = 0 then null else o_orderkey % 10 end as gym_id,
          case when o_orderkey % 7 = 0 then null else cast(o_orderdate as timestamp) end as created_at
        from {{orders}}""",
    "workout_sets": """
        select l_orderkey as session_id, l_linenumber as set_number,
          case when l_linenumber % 3 = 0 then l_partkey end as exercise_id,
          case when l_linestatus = 'F' then upper(p_name) else p_name end as exercise_name,
          case when l_quantity = 50 then null else cast(floor(l_quantity) as int) end as reps,
          case when l_discount = 0 then null
            else cast(cast(floor(l_extendedprice) as bigint) % 400 + 45 as decimal(6,2)) end as weight_lbs,
          case when l_tax = 0 then null else cast(5 + l_linenumber % 5 as decimal(3,1)) end as rpe,
          case when l_linenumber = 1 then l_returnflag end as notes,
          case when l_returnflag = 'R' then null
            else l_suppkey * 10000000 + l_partkey end as gym_equipment_id
        from {lineitem} join {part} on p_partkey = l_partkey""",
    "equipment_library": """
        select p_partkey as id, p_name as name,
          case when p_size % 10 = 0 then null else p_brand end as brand, p_type as type,
          concat('Cat', cast(p_size % 11 as varchar(3))) as category,
          p_partkey % 5 >= 3 as is_flagged, cast(p_partkey % 5 as int) as flag_count,
          'community' as created_by,
          cast(date '2023-01-01' + cast(p_partkey % 365 as int) as timestamp) as created_at
        from {part}""",
    "equipment_types": """
        select cast(min(p_partkey) as int) as id, p_type as name from {part} group by p_type""",
    "equipment_categories": """
        select cast(min(p_partkey) as int) as id, concat('Cat', cast(p_size % 11 as varchar(3))) as name
        from {part} group by concat('Cat', cast(p_size % 11 as varchar(3)))""",
    "gym_types": "select distinct c_mktsegment as name from {customer}",
    "cardio_types": """
        select cast(min(p_partkey) as int) as id, p_brand as name, min(p_size) > 1 as is_custom
        from {part} group by p_brand""",
    "gyms": """
        select s_suppkey as id, s_name as name, concat(n_name, ' street') as address,
          n_name as city, r_name as state, lpad(cast(s_suppkey * 37 as varchar(10)), 5, '0') as zip,
          case when s_acctbal < 5000 then 'Independent' else 'Commercial chain' end as gym_type,
          s_acctbal > 0 as is_24hr, s_acctbal > 9000 as is_default,
          case when s_acctbal < 0 then null else s_suppkey + 1 end as created_by
        from {supplier} join {nation} on s_nationkey = n_nationkey
          join {region} on n_regionkey = r_regionkey""",
    "gym_equipment": f"""
        select l_suppkey * 10000000 + l_partkey as id, l_suppkey as gym_id, l_partkey as equipment_id,
          case when max(l_returnflag) = 'R' then 'out_of_service'
            when l_partkey % 3 = 0 then 'fair' else 'good' end as condition,
          cast(5 + l_partkey % 20 as int) as weight_min_lbs,
          case when l_partkey % 6 = 0 then null else cast(200 + l_partkey % 300 as int) end as weight_max_lbs,
          max(l_linestatus) as notes,
          max(l_returnflag) = 'R' as is_out_of_service,
          cast(cast(max(l_shipdate) as date) + {SHIFT} as timestamp) as oos_reported_at,
          case when l_partkey % 9 = 0 then null
            else cast(cast(max(l_shipdate) as date) + {SHIFT + 30} as timestamp) end as oos_auto_clear_at,
          l_partkey % 4 >= 3 as is_flagged, cast(l_partkey % 4 as int) as flag_count,
          'community' as added_by,
          cast(cast(min(l_shipdate) as date) + {SHIFT} as timestamp) as added_at
        from {{lineitem}} group by l_suppkey, l_partkey""",
    "equipment_oos_reports": f"""
        select l_orderkey as id, l_suppkey * 10000000 + l_partkey as gym_equipment_id,
          cast(cast(l_shipdate as date) + {SHIFT} as timestamp) as reported_at,
          case when l_linenumber % 2 = 0
            then cast(cast(l_shipdate as date) + {SHIFT + 7} as timestamp) end as resolved_at,
          l_linestatus as notes
        from {{lineitem}} where l_returnflag = 'R'""",
    "equipment_flags": """
        select event_id as id,
          case when event_id % 2 = 0 then 'library' else 'gym_equipment' end as target_type,
          event_id % 97 as target_id, cast(ts as timestamp) as reported_at
        from {events} where event_type = 'click'""",
    "body_metrics": """
        select event_id as id, user_id, cast(ts as timestamp) as measured_at,
          cast(ts as date) as measurement_date,
          case when event_id % 13 = 0 then null
            else cast(130 + event_id % 120 as decimal(6,2)) end as weight_lbs,
          case when event_id % 7 = 0 then null
            else cast(10 + event_id % 25 as decimal(5,2)) end as body_fat_pct,
          cast(90 + event_id % 70 as decimal(6,2)) as muscle_mass_lbs,
          cast(18 + event_id % 17 as decimal(5,2)) as bmi,
          case when event_id % 3 = 0 then 'renpho' else 'manual' end as source,
          case when event_id % 3 = 0 then user_id end as renpho_user_id,
          case when event_id % 10 = 0 then null else cast(ts as timestamp) end as created_at
        from {events} where event_type = 'view'""",
    "cardio_sessions": """
        select event_id as id, user_id, cast(ts as date) as session_date,
          case cast(floor(value) as int) % 3 when 0 then 'Run' when 1 then 'Cycle' else 'Walk' end
            as activity_type,
          case when event_id % 23 = 0 then null else cast(value as decimal(7,2)) end as distance_km,
          case when event_id % 9 = 0 then null else cast(10 + event_id % 80 as int) end as duration_min,
          case when event_id % 4 = 0 then null else cast(event_id % 9000 as int) end as steps,
          cast(ts as timestamp) as created_at
        from {events} where event_type = 'purchase'""",
    "nutrition_log": """
        select event_id as id, user_id, cast(ts as date) as log_date,
          case event_id % 4 when 0 then 'Breakfast' when 1 then 'Lunch' when 2 then 'Dinner'
            else 'Snack' end as meal_type,
          props as food_name,
          case when event_id % 11 = 0 then null else cast(100 + event_id % 700 as int) end as calories_kcal,
          cast(event_id % 60 as decimal(6,2)) as protein_g, cast(event_id % 90 as decimal(6,2)) as carbs_g,
          cast(event_id % 40 as decimal(6,2)) as fat_g,
          case when event_id % 2 = 0 then cast(event_id % 12 as decimal(6,2)) end as fiber_g,
          cast(ts as timestamp) as created_at
        from {events} where event_type = 'signup'""",
    "goals": """
        select cast(c_custkey as int) as id, c_custkey as user_id, c_mktsegment as goal_type,
          cast(c_custkey % 300 as decimal(8,2)) as target_value, c_acctbal > 0 as is_active
        from {customer}""",
    "heart_rate": """
        select event_id as id, user_id, cast(ts as timestamp) as measured_at,
          cast(ts as date) as measurement_date, cast(50 + event_id % 120 as smallint) as bpm
        from {events}""",
    "blood_pressure": """
        select event_id as id, user_id, cast(ts as timestamp) as measured_at,
          cast(ts as date) as measurement_date, cast(100 + event_id % 80 as smallint) as systolic_mmhg,
          cast(60 + event_id % 50 as smallint) as diastolic_mmhg,
          case when event_id % 6 = 0 then null else cast(50 + event_id % 60 as smallint) end as pulse_bpm,
          'manual' as source, props as notes
        from {events} where event_type = 'error'""",
    "blood_oxygen": """
        select event_id as id, user_id, cast(ts as timestamp) as measured_at,
          cast(ts as date) as measurement_date, cast(90 + event_id % 10 as decimal(5,2)) as spo2_pct
        from {events} where event_type = 'click'""",
    "stress_readings": """
        select event_id as id, user_id, cast(ts as timestamp) as measured_at,
          cast(ts as date) as measurement_date, cast(event_id % 100 as smallint) as stress_score
        from {events} where event_type = 'signup'""",
    "heart_rate_daily": """
        select user_id, cast(ts as date) as summary_date,
          case when count(*) % 6 = 0 then null
            else cast(50 + sum(event_id) % 40 as decimal(5,1)) end as resting_bpm,
          cast(40 + min(event_id) % 20 as smallint) as min_bpm,
          cast(120 + max(event_id) % 60 as smallint) as max_bpm,
          cast(20 + sum(event_id) % 70 as decimal(6,2)) as hrv_ms
        from {events} group by user_id, cast(ts as date)""",
    "daily_activity": """
        select user_id, cast(ts as date) as activity_date, cast(sum(event_id) % 15000 as int) as steps,
          cast(sum(event_id) % 12000 as decimal(8,1)) as distance_m,
          cast(sum(event_id) % 700 as int) as calories_active,
          cast(1200 + sum(event_id) % 1500 as int) as calories_total,
          cast(count(*) * 10 as int) as active_min, cast(sum(event_id) % 20 as smallint) as floors_climbed,
          case when count(*) % 3 = 0 then null
            else cast(30 + sum(event_id) % 20 as decimal(5,2)) end as vo2_max
        from {events} where event_type in ('view', 'purchase') group by user_id, cast(ts as date)""",
    "sleep_sessions": """
        select event_id as id, user_id, cast(ts as date) as session_date, cast(ts as timestamp) as sleep_end,
          cast(300 + event_id % 240 as int) as duration_min, cast(event_id % 90 as decimal(6,1)) as deep_min,
          cast(event_id % 110 as decimal(6,1)) as rem_min, cast(event_id % 130 as decimal(6,1)) as light_min,
          cast(70 + event_id % 30 as decimal(5,2)) as efficiency_pct,
          cast(event_id % 100 as smallint) as sleep_score
        from {events} where event_type = 'purchase'""",
    "samsung_workouts": """
        select event_id as id, user_id, cast(ts as date) as session_date, cast(ts as timestamp) as workout_start,
          case cast(floor(value) as int) % 3 when 0 then 'Run' when 1 then 'Cycle' else 'Walk' end
            as activity_type,
          cast(10 + event_id % 90 as int) as duration_min, cast(event_id % 900 as int) as calories,
          cast(event_id % 12000 as decimal(8,1)) as distance_m,
          cast(90 + event_id % 80 as decimal(5,1)) as avg_hr_bpm, cast(120 + event_id % 80 as smallint) as max_hr_bpm,
          case when event_id % 5 = 0 then null else cast(200 + event_id % 4000 as int) end as avg_pace_sec_km,
          cast(event_id % 30 as decimal(5,2)) as avg_speed_kmh,
          cast(event_id % 500 as decimal(7,1)) as elevation_gain_m,
          cast(30 + event_id % 30 as decimal(5,2)) as vo2_max, cast(event_id % 100 as smallint) as workout_score,
          'samsung' as source
        from {events} where event_type = 'view'""",
    # ---- incoming batches and raw inputs ----
    "scale_readings": """
        select event_id as arrival, user_id as renpho_user_id,
          case event_id % 6 when 0 then null when 1 then '' when 2 then 'soon'
            else cast(1706000000 + event_id * 60 as varchar(20)) end as epoch_camel,
          case event_id % 6 when 0 then cast(1706000030 + event_id * 60 as varchar(20))
            when 2 then '1706000000' else null end as time_stamp,
          case event_id % 6 when 1 then '0' else null end as timestamp,
          case event_id % 4 when 0 then concat(cast(cast(ts as date) as varchar(10)), ' 0',
              cast(event_id % 10 as varchar(1)), ':30:15')
            when 1 then 'yesterday' else null end as localCreatedAt,
          case event_id % 10 when 0 then '' when 1 then 'n/a' when 2 then '0'
            else concat(cast(50 + event_id % 60 as varchar(5)), '.', cast(event_id % 10 as varchar(1))) end as weight,
          case event_id % 5 when 0 then null else concat(cast(10 + event_id % 20 as varchar(5)), '.5') end as bodyfat,
          cast(30 + event_id % 40 as varchar(5)) as muscle, '3.1' as bone,
          cast(40 + event_id % 20 as varchar(5)) as water, cast(event_id % 15 as varchar(5)) as visfat,
          cast(18 + event_id % 15 as varchar(5)) as bmi,
          case when event_id % 50 = 7 then '99999999999' else cast(1200 + event_id % 900 as varchar(5)) end as bmr,
          cast(20 + event_id % 50 as varchar(5)) as bodyage
        from {events}""",
    "library_additions": """
        select p_partkey as arrival,
          case when p_size % 3 = 0 then concat(p_name, ' mk2') else p_name end as name,
          case when p_size % 10 = 0 then null when p_size % 4 = 0 then 'Brand#NEW' else p_brand end as brand,
          p_type as type, 'Other' as category
        from {part}""",
    "setting_changes": """
        select event_id as arrival, user_id, concat('pref', cast(event_id % 5 as varchar(4))) as key,
          props as value from {events}""",
    "session_patches": """
        select concat(cast(l_orderkey as varchar(20)), '-', cast(l_linenumber as varchar(5)), '-',
            cast(l_partkey as varchar(20)), '-', cast(l_suppkey as varchar(20)), '-',
            cast(cast(floor(l_extendedprice * 100) as bigint) as varchar(20)), '-',
            cast(cast(floor(l_quantity) as bigint) as varchar(5)), l_returnflag, l_linestatus,
            cast(cast(floor(l_discount * 100) as bigint) as varchar(5)), '-',
            cast(cast(floor(l_tax * 100) as bigint) as varchar(5))) as arrival,
          l_orderkey as id, case when l_linestatus = 'F' then l_orderkey else l_orderkey + 1 end as other_id,
          case when l_returnflag = 'A' then l_linestatus end as name,
          case when l_tax = 0 then null else cast(floor(l_quantity) as int) end as duration_min,
          case when l_discount > 0.05 then l_returnflag end as notes
        from {lineitem}""",
    "signups": """
        select o_orderkey as arrival,
          concat(case when o_orderstatus = 'F' then ' ' else '' end, 'Customer#',
            lpad(cast(o_custkey as varchar(12)), 9, '0'),
            case when o_orderpriority = '5-LOW' then '' else '@List.example ' end) as email
        from {orders}""",
    "workout_posts": f"""
        select o_orderkey as session_id, o_custkey as user_id,
          case when o_orderpriority = '5-LOW' and o_orderstatus = 'P' then null
            else cast(cast(o_orderdate as date) + {SHIFT} as varchar(10)) end as date,
          case when o_orderpriority = '1-URGENT' and o_orderstatus = 'F' then '' else o_orderpriority end as name,
          cast(cast(floor(o_totalprice) as bigint) % 4 as int) as duration_min,
          cast(o_orderkey % 4 as int) as entries, cast(o_orderkey % 3 as int) as sets_each
        from {{orders}}""",
}

_NAME = re.compile(r"\{(\w+)\}")


def needed_tables(name: str) -> set[str]:
    return set(_NAME.findall(TABLE_SQL[name].replace("{{", "").replace("}}", "")))


def spark_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    paths = {n: f"parquet.`{sf_dir.rstrip('/')}/{n}.parquet`" for n in needed_tables(name)}
    return spark.sql(TABLE_SQL[name].format(**paths))


class DomainTables(dict):
    """Tables made on first use, so a query analyses only the files it reads."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        super().__init__()
        self.spark, self.sf_dir = spark, sf_dir

    def __missing__(self, name: str) -> DataFrame:
        self[name] = spark_table(self.spark, self.sf_dir, name)
        return self[name]

    def raw(self, name: str) -> DataFrame:
        """One of the general tables as it is."""
        return self.spark.read.parquet(f"{self.sf_dir.rstrip('/')}/{name}.parquet")

    def __contains__(self, name: object) -> bool:
        return name in TABLE_SQL


def duckdb_with(names: Iterable[str]) -> str:
    """A WITH clause that defines the named tables in DuckDB."""
    parts = []
    for n in names:
        plain = {x: x for x in needed_tables(n)}
        parts.append(f"{n} as ({TABLE_SQL[n].format(**plain).strip()})")
    return "with " + ",\n".join(parts) if parts else ""

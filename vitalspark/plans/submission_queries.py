"""Submission queries: each batch row with its outcome, or the new table."""

from pyspark.sql import functions as F

from vitalspark.functions.text import LISTED_WORDS
from vitalspark.operators import submissions
from vitalspark.plans.catalog import query

WORDS = "|".join(LISTED_WORDS)


def _flagged(*columns: str) -> str:
    return "(" + " or ".join(
        f"coalesce(regexp_matches(regexp_replace(lower({c}), '[^a-z0-9\\s]', '', 'g'), '({WORDS})'), false)"
        for c in columns
    ) + ")"


# Document texts as names and notes: long, with copies and odd characters.
query(
    "submit_library_entries", "arrival:n name:s brand:s type:s category:s reason:s", "equipment_library",
    f"""
    with b as (select doc_id as arrival, text as name, case when lang = 'en' then ' ' || source || ' ' else '' end as brand,
        case when n_chars > 500 then 'Cable' end as type, lang as category from documents),
    j as (select arrival, trim(name) as name, nullif(trim(brand), '') as brand, coalesce(type, 'other') as type, category,
        case when name is null or name = '' then 'name is required'
          when {_flagged("name", "brand", "category")} then 'content flagged' end as reason from b)
    select arrival, name, brand, type, category, case when reason is not null then reason
        when brand is null then null
        when exists (select 1 from equipment_library l where l.name = j.name and l.brand = j.brand) then 'already stored'
        when row_number() over (partition by name, brand, reason is null order by arrival) > 1 then 'repeated in batch'
      end as reason from j""",
)(
    lambda t: submissions.submit_library_entries(
        t["equipment_library"],
        t.raw("documents").select(
            F.col("doc_id").alias("arrival"), F.col("text").alias("name"),
            F.when(F.col("lang") == "en", F.concat(F.lit(" "), "source", F.lit(" "))).otherwise("").alias("brand"),
            F.when(F.col("n_chars") > 500, "Cable").alias("type"), F.col("lang").alias("category"),
        ),
    ).batch
)

SEEN = """select doc_id as arrival, doc_id % 50 as gym_id, case when n_chars < 100 then null else doc_id % 211 end as equipment_id,
    '' as condition, cast(n_chars % 3 as int) as weight_min_lbs, cast(null as int) as weight_max_lbs, text as notes from documents"""
query(
    "submit_gym_equipment",
    "arrival:n gym_id:n equipment_id:n condition:s weight_min_lbs:n notes:s reason:s", "gym_equipment",
    f"""
    with j as (select arrival, gym_id, equipment_id, 'good' as condition, nullif(weight_min_lbs, 0) as weight_min_lbs,
        nullif(trim(notes), '') as notes, case when equipment_id is null then 'equipment_id is required'
          when {_flagged("notes")} then 'content flagged' end as reason from ({SEEN}))
    select arrival, gym_id, equipment_id, condition, weight_min_lbs, notes, case when reason is not null then reason
        when exists (select 1 from gym_equipment g where g.gym_id = j.gym_id and g.equipment_id = j.equipment_id) then 'already stored'
        when row_number() over (partition by gym_id, equipment_id, reason is null order by arrival) > 1 then 'repeated in batch'
      end as reason from j""",
)(
    lambda t: submissions.submit_gym_equipment(
        t["gym_equipment"],
        t.raw("documents").select(
            F.col("doc_id").alias("arrival"), (F.col("doc_id") % 50).alias("gym_id"),
            F.when(F.col("n_chars") >= 100, F.col("doc_id") % 211).alias("equipment_id"),
            F.lit("").alias("condition"), (F.col("n_chars") % 3).cast("int").alias("weight_min_lbs"),
            F.lit(None).cast("int").alias("weight_max_lbs"), F.col("text").alias("notes"),
        ),
    ).batch
)

EDITED = """select doc_id as arrival, (doc_id % 50) * 10000000 + doc_id % 211 as id, doc_id % 50 as gym_id, text as notes
  from documents"""
query(
    "edit_gym_equipment", "id:n gym_id:n condition:s weight_min_lbs:n notes:s", "gym_equipment",
    f"""
    with e as (select *, row_number() over (partition by id order by arrival desc) as place
      from ({EDITED}) where not {_flagged("notes")})
    select g.id, g.gym_id, case when e.id is null then g.condition else 'fair' end as condition,
      case when e.id is null then g.weight_min_lbs else 7 end as weight_min_lbs,
      case when e.id is null then g.notes else nullif(trim(e.notes), '') end as notes
    from gym_equipment g left join e on e.id = g.id and e.place = 1""",
)(
    lambda t: submissions.edit_gym_equipment(
        t["gym_equipment"],
        t.raw("documents").select(
            F.col("doc_id").alias("arrival"),
            ((F.col("doc_id") % 50) * 10000000 + F.col("doc_id") % 211).alias("id"),
            (F.col("doc_id") % 50).alias("gym_id"), F.lit("fair").alias("condition"),
            F.lit(7).alias("weight_min_lbs"), F.lit(0).alias("weight_max_lbs"), F.col("text").alias("notes"),
        ),
    ).snapshot
)
query(
    "edit_gyms", "id:n name:s address:s city:s gym_type:s is_24hr:b is_default:b", "gyms",
    """
    with e as (select s_suppkey as id, upper(s_name) as name, n_name as city from supplier join nation on n_nationkey = s_nationkey)
    select g.id, coalesce(e.name, g.name) as name, case when e.id is null then g.address end as address, coalesce(e.city, g.city) as city,
      case when e.id is null then g.gym_type else 'Commercial chain' end as gym_type,
      e.id is null and g.is_24hr as is_24hr, e.id is null and g.is_default as is_default
    from gyms g left join e on e.id = g.id""",
)(
    lambda t: submissions.edit_gyms(
        t["gyms"],
        t.raw("supplier").join(t.raw("nation"), F.expr("n_nationkey = s_nationkey")).select(
            F.col("s_suppkey").alias("arrival"), F.col("s_suppkey").alias("id"), F.upper("s_name").alias("name"),
            F.col("n_name").alias("city"),
        ),
    ).snapshot
)
query(
    "submit_exercises", "arrival:n name:s muscle_group_id:n equipment:s reason:s", "exercises muscle_groups",
    """
    with b as (select p_partkey as arrival, case when p_size = 1 then '' when p_size < 20 then concat(p_name, ' ', p_partkey) else p_name end as name,
        n_name as muscle_group, p_type as equipment from part left join nation on n_nationkey = p_size)
    select arrival, b.name, m.id as muscle_group_id, b.equipment, case when b.name = '' then 'name is required'
        when exists (select 1 from exercises e where e.name = b.name) then 'already stored'
        when row_number() over (partition by b.name order by arrival) > 1 then 'repeated in batch' end as reason
    from b left join muscle_groups m on m.name = b.muscle_group""",
)(
    lambda t: submissions.submit_exercises(
        t["exercises"], t["muscle_groups"],
        t.raw("part").join(t.raw("nation"), F.expr("n_nationkey = p_size"), "left").select(
            F.col("p_partkey").alias("arrival"),
            F.when(F.col("p_size") == 1, "").when(
                F.col("p_size") < 20, F.concat("p_name", F.lit(" "), F.col("p_partkey").cast("string"))
            ).otherwise(F.col("p_name")).alias("name"),
            F.col("n_name").alias("muscle_group"), F.col("p_type").alias("equipment"),
        ),
    ).batch
)
query(
    "submit_lookup", "name:s is_custom:b", "cardio_types",
    """select name, is_custom from cardio_types union all
       select distinct p_type, true from part where p_type not in (select name from cardio_types)""",
)(
    lambda t: submissions.submit_lookup(
        t["cardio_types"], t.raw("part").select(F.col("p_partkey").alias("arrival"), F.col("p_type").alias("name"))
    ).snapshot
)
query(
    "submit_waitlist", "arrival:n email:s reason:s", "waitlist signups",
    """
    with s as (select arrival, lower(trim(email)) as email, contains(email, '@') as ok from signups)
    select arrival, email, case when not ok then 'valid email required'
        when exists (select 1 from waitlist w where w.email = s.email) then 'already stored'
        when row_number() over (partition by email, ok order by arrival) > 1 then 'repeated in batch' end as reason
    from s""",
)(lambda t: submissions.submit_waitlist(t["waitlist"], t["signups"]).batch)

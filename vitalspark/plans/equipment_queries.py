"""Equipment and gym queries."""

from pyspark.sql import functions as F

from vitalspark.functions.health import effective_oos
from vitalspark.functions.text import LISTED_WORDS, contains_listed_word
from vitalspark.operators import equipment, term_search
from vitalspark.plans.catalog import query
from vitalspark.sources.domain import AS_OF

OPEN = """select gym_equipment_id, count(*) as n from equipment_oos_reports
  where resolved_at is null group by gym_equipment_id"""
EFFECTIVE = f"""case when is_out_of_service and oos_auto_clear_at is not null
  and oos_auto_clear_at < timestamp '{AS_OF} 00:00:00' then false else is_out_of_service end"""
query(
    "gym_equipment_detail",
    "id:n gym_id:n equipment_id:n equipment_name:s brand:s type:s category:s condition:s"
    " weight_min_lbs:n weight_max_lbs:n notes:s is_out_of_service:b oos_reported_at:t"
    " oos_auto_clear_at:t is_flagged:b flag_count:n added_by:s added_at:t effective_oos:b"
    " oos_report_count:n",
    "gym_equipment equipment_library equipment_oos_reports",
    f"""
    select ge.*, el.name as equipment_name, el.brand, el.type, el.category, {EFFECTIVE} as effective_oos,
      coalesce(r.n, 0) as oos_report_count
    from gym_equipment ge join (select id as lid, name, brand, type, category from equipment_library
      where is_flagged = false) el on el.lid = ge.equipment_id
    left join ({OPEN}) r on r.gym_equipment_id = ge.id""",
)(lambda t: equipment.gym_equipment_detail(t, AS_OF))
query(
    "effective_oos", "id:n effective_oos:b", "gym_equipment",
    f"select id, {EFFECTIVE} as effective_oos from gym_equipment",
)(
    lambda t: t["gym_equipment"].select(
        "id",
        effective_oos(F.col("is_out_of_service"), F.col("oos_auto_clear_at"), AS_OF).alias("effective_oos"),
    )
)
query(
    "open_report_count", "id:n oos_report_count:n", "gym_equipment equipment_oos_reports",
    f"""select id, coalesce(r.n, 0) as oos_report_count from gym_equipment
        left join ({OPEN}) r on r.gym_equipment_id = id""",
)(equipment.open_report_count)

LIBRARY = """
select el.id, el.name, el.brand, el.type, el.category, el.is_flagged, el.created_by, el.created_at,
  coalesce(c.n, 0) as gym_count
from equipment_library el left join (
  select equipment_id, count(*) as n from gym_equipment group by equipment_id) c on c.equipment_id = el.id
where el.is_flagged = false"""
LIBRARY_COLUMNS = (
    "id:n name:s brand:s type:s category:s is_flagged:b created_by:s created_at:t gym_count:n"
)
LIBRARY_TABLES = "equipment_library gym_equipment"
query("library_with_gym_count", LIBRARY_COLUMNS, LIBRARY_TABLES, LIBRARY)(
    equipment.library_with_gym_count
)
query(
    "search_library", LIBRARY_COLUMNS, LIBRARY_TABLES,
    f"""select * from ({LIBRARY}) where (lower(name) like lower('%RING%') or lower(brand) like lower('%RING%'))
        order by gym_count desc, name, id limit 50""",
)(lambda t: equipment.search_library(t, q="RING", limit=50))
query(
    "search_library_all", LIBRARY_COLUMNS, LIBRARY_TABLES,
    f"""select * from ({LIBRARY}) where (lower(name) like lower('%RING%') or lower(brand) like lower('%RING%'))""",
)(lambda t: equipment.search_library(t, q="RING"))
# terms of the library itself: parts of names and whole brands
TERMS = """select distinct term from (
  select substr(name, 2 + cast(id % 5 as int), 7) as term from equipment_library union all
  select brand as term from equipment_library where id % 50 = 0) where term is not null"""


def _library_terms(t):
    names = t["equipment_library"].select(F.col("name").substr(F.lit(2) + (F.col("id") % 5).cast("int"), F.lit(7)).alias("term"))
    brands = t["equipment_library"].filter(F.col("id") % 50 == 0).select(F.col("brand").alias("term"))
    return term_search.search_library_terms(t, names.unionByName(brands))


query(
    "search_library_terms", f"term:s {LIBRARY_COLUMNS}", LIBRARY_TABLES,
    f"""select term, l.* from ({TERMS}) join ({LIBRARY}) l
        on lower(name) like '%' || lower(term) || '%' or lower(brand) like '%' || lower(term) || '%'""",
)(_library_terms)
query(
    "search_library_filtered", LIBRARY_COLUMNS, LIBRARY_TABLES,
    f"""select * from ({LIBRARY}) where (lower(name) like lower('%brand#1%') or lower(brand) like lower('%brand#1%'))
        and type = 'SMALL'""",
)(lambda t: equipment.search_library(t, q="brand#1", type="SMALL", limit=None))
query(
    "top_library", LIBRARY_COLUMNS, LIBRARY_TABLES,
    f"select * from ({LIBRARY}) order by gym_count desc, name, id limit 50",
)(equipment.top_library)
query(
    "visible_equipment", "id:n name:s is_flagged:b", "equipment_library",
    "select * from equipment_library where is_flagged = false",
)(lambda t: equipment.visible_equipment(t["equipment_library"]))

GYMS = """
select g.*, coalesce(w.n, 0) as workout_count from gyms g left join (
  select gym_id, count(*) as n from workout_sessions group by gym_id) w on w.gym_id = g.id"""
GYM_COLUMNS = "id:n name:s address:s city:s state:s zip:s gym_type:s is_24hr:b workout_count:n"
query("gym_workout_summary", f"{GYM_COLUMNS} is_default:b", "gyms workout_sessions", GYMS)(
    equipment.gym_workout_summary
)
query("gym_list", f"{GYM_COLUMNS} is_default:b", "gyms workout_sessions", GYMS)(equipment.gym_list)
query(
    "search_gyms", GYM_COLUMNS, "gyms workout_sessions",
    f"""select * from ({GYMS}) where lower(name) like lower('%00%') or lower(city) like lower('%00%')
        or zip like '00%' order by workout_count desc, name, id limit 20""",
)(lambda t: equipment.search_gyms(t, "00", limit=20))
query(
    "search_gyms_all", GYM_COLUMNS, "gyms workout_sessions",
    f"""select * from ({GYMS}) where lower(name) like lower('%00%') or lower(city) like lower('%00%')
        or zip like '00%'""",
)(lambda t: equipment.search_gyms(t, "00"))
query(
    "search_gyms_terms", f"term:s {GYM_COLUMNS}", "gyms workout_sessions",
    f"""with terms as (select distinct term from (
          select city as term from gyms union all select substr(zip, 1, 3) as term from gyms union all
          select substr(name, 9) as term from gyms) where length(trim(term)) >= 2)
        select term, g.* from terms join ({GYMS}) g on lower(name) like '%' || lower(term) || '%'
          or lower(city) like '%' || lower(term) || '%' or zip like term || '%'""",
)(lambda t: term_search.search_gyms_terms(t, t["gyms"].select(F.explode(F.array(
    "city", F.substring("zip", 1, 3), F.substring("name", 9, 1000))).alias("term"))))
query(
    "top_gyms", GYM_COLUMNS, "gyms workout_sessions",
    f"select * from ({GYMS}) order by workout_count desc, name, id limit 20",
)(equipment.top_gyms)

WORDS = "|".join(LISTED_WORDS)
BLANKS = r"\s\x{0B}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}"
PLAIN = f"regexp_replace(lower(text), '[^a-z0-9{BLANKS}]', '', 'g')"
query(
    "content_screen", "doc_id:n flagged:b flagged_words:b", "",
    f"""
    select doc_id,
      regexp_matches({PLAIN}, '({WORDS})') as flagged,
      regexp_matches({PLAIN}, '(^|[{BLANKS}])({WORDS})([{BLANKS}]|$)')
        as flagged_words
    from documents""",
)(
    lambda t: t.raw("documents").select(
        "doc_id", contains_listed_word(F.col("text")).alias("flagged"),
        contains_listed_word(F.col("text"), whole_word=True).alias("flagged_words"),
    )
)

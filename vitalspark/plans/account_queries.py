"""User, invite, lookup and administration queries."""

from pyspark.sql import functions as F

from vitalspark.functions.text import is_email, normalise_email, setting_value
from vitalspark.operators import accounts
from vitalspark.plans.catalog import query
from vitalspark.sources.domain import AS_OF

query(
    "filter_owner", "id:n user_id:n weight_lbs:f", "body_metrics users",
    "select * from body_metrics where user_id in (select id from users where is_active)",
)(
    lambda t: accounts.filter_owner(
        t["body_metrics"],
        t["users"].filter(F.col("is_active")).select(F.col("id").alias("user_id")),
    )
)
DIRECTORY = "id:n email:s display_name:s role:s is_active:b created_at:t last_login:t"
query("user_directory", DIRECTORY, "users", "select * from users")(accounts.user_directory)
query(
    "redeemable_invites", "id:n code:s expires_at:t", "invite_codes",
    f"""select * from invite_codes where used_at is null
        and (expires_at is null or expires_at > timestamp '{AS_OF} 00:00:00')""",
)(lambda t: accounts.redeemable_invites(t, AS_OF))
query(
    "active_users_by_email", "id:n email:s", "users",
    """select * from users where is_active and lower(email) in (
         select lower(concat(upper(c_name), '@EXAMPLE.com')) from customer)""",
)(
    lambda t: accounts.active_users_by_email(
        t,
        t.raw("customer")
        .select(F.concat(F.upper("c_name"), F.lit("@EXAMPLE.com")).alias("email")),
    )
)
query(
    "invite_report",
    "id:n code:s used_by:n used_at:t expires_at:t created_at:t note:s used_by_name:s used_by_email:s",
    "invite_codes users",
    """select i.*, u.display_name as used_by_name, u.email as used_by_email
       from invite_codes i left join users u on u.id = i.used_by""",
)(accounts.invite_report)
query(
    "admin_user_activity",
    f"{DIRECTORY} workout_count:n cardio_count:n metric_count:n last_workout:s last_cardio:s",
    "users workout_sessions cardio_sessions body_metrics",
    """
    select u.*, coalesce(w.n, 0) as workout_count, coalesce(c.n, 0) as cardio_count,
      coalesce(m.n, 0) as metric_count, cast(w.d as varchar) as last_workout, cast(c.d as varchar) as last_cardio
    from users u
    left join (select user_id, count(distinct id) as n, max(session_date) as d from workout_sessions group by 1) w on w.user_id = u.id
    left join (select user_id, count(distinct id) as n, max(session_date) as d from cardio_sessions group by 1) c on c.user_id = u.id
    left join (select user_id, count(distinct id) as n from body_metrics group by 1) m on m.user_id = u.id""",
)(accounts.admin_user_activity)
query(
    "admin_totals", "waitlist_total:n waitlist_invited:n gyms:n equipment:n",
    "waitlist gyms gym_equipment",
    """select (select count(*) from waitlist) as waitlist_total,
         (select count(invited_at) from waitlist) as waitlist_invited,
         (select count(*) from gyms) as gyms, (select count(*) from gym_equipment) as equipment""",
)(accounts.admin_totals)
query(
    "lookup_lists", "list:s name:s is_custom:b place:n",
    "equipment_types equipment_categories gym_types exercises muscle_groups cardio_types",
    """select 'equipment_types' as list, name, false as is_custom,
         row_number() over (order by name) as place from equipment_types
       union all select 'equipment_categories', name, false, row_number() over (order by name) from equipment_categories
       union all select 'gym_types', name, false, row_number() over (order by name) from gym_types
       union all select 'exercises', name, is_custom, row_number() over (order by is_custom, name) from exercises
       union all select 'muscle_groups', name, is_custom, row_number() over (order by is_custom, name) from muscle_groups
       union all select 'cardio_types', name, is_custom, row_number() over (order by is_custom, name) from cardio_types""",
)(accounts.lookup_lists)
query("waitlist_newest_first", "email:s invited_at:t created_at:t", "waitlist", "select * from waitlist")(
    accounts.waitlist_newest_first
)
query(
    "strings", "id:n code:s local_part:s shown:s", "users",
    """select id, upper(trim(concat(' ', display_name, ' '))) as code, split_part(email, '@', 1) as local_part,
         role || '/' || cast(last_login as date)::varchar as shown from users""",
)(
    lambda t: t["users"].select(
        "id",
        F.upper(F.trim(F.concat(F.lit(" "), "display_name", F.lit(" ")))).alias("code"),
        F.split_part("email", F.lit("@"), F.lit(1)).alias("local_part"),
        F.concat("role", F.lit("/"), F.col("last_login").cast("date").cast("string")).alias("shown"),
    )
)
query(
    "email_normalising", "arrival:n email:s usable:b", "signups",
    "select arrival, lower(trim(email)) as email, contains(email, '@') as usable from signups",
)(
    lambda t: t["signups"].select(
        "arrival", normalise_email(F.col("email")).alias("email"), is_email(F.col("email")).alias("usable")
    )
)
query(
    "settings_values", "user_id:n key:s is_json:b p:s plain:s", "user_settings",
    """select user_id, key, json_valid(value) as is_json,
         case when json_valid(value) then json_extract_string(value, '$.p') end as p,
         case when not json_valid(value) then value end as plain from user_settings""",
)(
    lambda t: t["user_settings"].select(
        "user_id", "key", F.try_parse_json("value").isNotNull().alias("is_json"),
        setting_value(F.col("value")).alias("v"),
    ).select(
        "user_id", "key", "is_json",
        F.when(F.col("is_json"), F.try_variant_get("v", "$.p", "string")).alias("p"),
        F.when(~F.col("is_json"), F.try_variant_get("v", "$", "string")).alias("plain"),
    )
)

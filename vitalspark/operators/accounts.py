"""Users, invites, lookups and administration reports."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vitalspark.functions.dates import as_timestamp
from vitalspark.skew import join_optional

Tables = Mapping[str, DataFrame]
DIRECTORY = ("id", "email", "display_name", "role", "is_active", "created_at", "last_login")


def filter_owner(df: DataFrame, owners: DataFrame | Iterable) -> DataFrame:
    """Rows of the given users: a list of ids, or a table with ``user_id``."""
    if isinstance(owners, DataFrame):
        return df.join(owners.select("user_id"), "user_id", "left_semi")
    return df.filter(F.col("user_id").isin(*owners))


def user_directory(t: Tables) -> DataFrame:
    """Users without any credential column."""
    return t["users"].select(*DIRECTORY)


def redeemable_invites(t: Tables, as_of) -> DataFrame:
    """Unused invites that have no expiry or have not reached it."""
    alive = F.col("expires_at").isNull() | (F.col("expires_at") > as_timestamp(as_of))
    return t["invite_codes"].filter(F.col("used_at").isNull() & alive)


def active_users_by_email(t: Tables, emails: DataFrame) -> DataFrame:
    """Active users whose email is listed, in any case."""
    wanted = emails.select(F.lower("email").alias("_email")).distinct()
    users = t["users"].filter(F.col("is_active"))
    return users.join(wanted, F.lower(users["email"]) == F.col("_email"), "left_semi")


def invite_report(t: Tables) -> DataFrame:
    """Invites with the name and email of whoever used them."""
    users = t["users"].select(
        F.col("id").alias("_user"), F.col("display_name").alias("used_by_name"),
        F.col("email").alias("used_by_email"),
    )
    return join_optional(t["invite_codes"], users, "used_by", "_user", ["id"])


def admin_user_activity(t: Tables) -> DataFrame:
    """Users with their numbers of workouts, cardio sessions and measurements.

    Each child table is counted per user first, so nothing is multiplied and a very
    active user is one row in each join.
    """
    def per_user(name: str, *aggregates) -> DataFrame:
        return (
            t[name].filter(F.col("user_id").isNotNull())
            .groupBy(F.col("user_id").alias(f"_{name}")).agg(*aggregates)
        )

    n = F.count(F.lit(1))
    workouts = per_user(
        "workout_sessions", n.alias("_workouts"),
        F.max("session_date").cast("string").alias("last_workout"),
    )
    cardio = per_user(
        "cardio_sessions", n.alias("_cardio"),
        F.max("session_date").cast("string").alias("last_cardio"),
    )
    metrics = per_user("body_metrics", n.alias("_metrics"))
    return (
        t["users"]
        .join(workouts, F.col("id") == F.col("_workout_sessions"), "left")
        .join(cardio, F.col("id") == F.col("_cardio_sessions"), "left")
        .join(metrics, F.col("id") == F.col("_body_metrics"), "left")
        .select(
            *DIRECTORY,
            F.coalesce("_workouts", F.lit(0)).alias("workout_count"),
            F.coalesce("_cardio", F.lit(0)).alias("cardio_count"),
            F.coalesce("_metrics", F.lit(0)).alias("metric_count"),
            "last_workout", "last_cardio",
        )
    )


def admin_totals(t: Tables) -> DataFrame:
    """One row: waitlist, invited, gyms and gym machines; four partial counts, one result row."""
    waitlist = t["waitlist"].select(
        F.lit(1).alias("w"), F.col("invited_at").isNotNull().cast("int").alias("i"),
        F.lit(0).alias("g"), F.lit(0).alias("e"),
    )
    gyms = t["gyms"].select(F.lit(0).alias("w"), F.lit(0).alias("i"), F.lit(1).alias("g"), F.lit(0).alias("e"))
    machines = t["gym_equipment"].select(
        F.lit(0).alias("w"), F.lit(0).alias("i"), F.lit(0).alias("g"), F.lit(1).alias("e")
    )
    stacked = waitlist.unionAll(gyms).unionAll(machines)
    names = {"w": "waitlist_total", "i": "waitlist_invited", "g": "gyms", "e": "equipment"}
    return stacked.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(n) for c, n in names.items()])


# Lookup -> its order. Custom entries come after the default ones.
LOOKUPS: dict[str, Sequence[str]] = {
    "equipment_types": ("name",),
    "equipment_categories": ("name",),
    "gym_types": ("name",),
    "exercises": ("is_custom", "name"),
    "muscle_groups": ("is_custom", "name"),
    "cardio_types": ("is_custom", "name"),
}


def lookup_list(t: Tables, name: str) -> DataFrame:
    return t[name].orderBy(*[F.col(c).asc_nulls_last() for c in LOOKUPS[name]])


def waitlist_newest_first(t: Tables) -> DataFrame:
    return t["waitlist"].orderBy(F.col("created_at").desc_nulls_first(), F.col("email"))


def lookup_lists(t: Tables) -> DataFrame:
    """All lookups in one table: (list, name, is_custom, place), numbered as ``lookup_list`` orders them."""
    out = None
    for name in LOOKUPS:
        custom = F.col("is_custom") if "is_custom" in t[name].columns else F.lit(False)
        order = [F.col(c).asc_nulls_last() for c in LOOKUPS[name]]
        rows = t[name].select(
            F.lit(name).alias("list"), "name", F.coalesce(custom, F.lit(False)).alias("is_custom"),
            F.row_number().over(Window.partitionBy(F.lit(name)).orderBy(*order)).alias("place"),
        )
        out = rows if out is None else out.unionByName(rows)
    return out

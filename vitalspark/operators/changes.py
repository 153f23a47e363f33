"""Set-based table changes: current table and a batch in, new table out.

Every batch row carries ``arrival``, a unique sequence number, so that "first" and
"last" within a batch are defined. New tables are plain DataFrames; store them with
``store_table``.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitalspark.functions.dates import as_timestamp
from vitalspark.functions.health import clear_time_passed
from vitalspark.functions.numbers import blank_to_null, zero_to_null
from vitalspark.operators.quality import Split
from vitalspark.skew import first_rows, join_optional

Tables = Mapping[str, DataFrame]
ARRIVAL = "arrival"

# Status rules.
OOS_DAYS = 30
FLAGS_TO_HIDE = 3
CONDITION_OUT = "out_of_service"
CONDITION_GOOD = "good"


class Change(NamedTuple):
    """The new table, and every batch row with its ``reason``, null where it took effect."""

    snapshot: DataFrame
    batch: DataFrame

    @property
    def applied(self) -> DataFrame:
        return Split.by_reason(self.batch).accepted

    @property
    def rejected(self) -> DataFrame:
        return Split.by_reason(self.batch).rejected


def _all_present(columns: Sequence[str]) -> Column:
    return reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in columns])


def _last_per_key(changes: DataFrame, keys: Sequence[str]) -> DataFrame:
    return first_rows(changes, keys, [F.col(ARRIVAL).desc()])


def semi_anti_for_upsert(
    current: DataFrame, changes: DataFrame, key: Sequence[str]
) -> tuple[DataFrame, DataFrame]:
    """Batch rows whose key is already stored, and those whose key is not.

    A key with a null part is never stored already.
    """
    stored = current.select(*key)
    return changes.join(stored, list(key), "left_semi"), changes.join(stored, list(key), "left_anti")


def stored_keys(current: DataFrame, batch: DataFrame, key: Sequence[str]) -> DataFrame:
    """Keys that are stored already, once each, out of a batch that holds a key once.

    A semi-join of the stored keys with those of the batch: with a small batch Spark
    broadcasts it, by measured size, and the stored table is scanned without a shuffle.
    """
    return current.select(*key).join(batch.select(*key), list(key), "left_semi").distinct()


def mark_stored(
    current: DataFrame, changes: DataFrame, key: Sequence[str], otherwise: str
) -> DataFrame:
    """Batch rows with reason ``otherwise`` where no stored row has their key."""
    asked = changes.select(*key).distinct()
    stored = stored_keys(current, asked, key).select(
        *[F.col(k).alias(f"_s_{k}") for k in key], F.lit(True).alias("_stored")
    )
    joined = join_optional(changes, stored, list(key), [f"_s_{k}" for k in key], [ARRIVAL])
    return joined.withColumn("reason", F.when(F.col("_stored").isNull(), otherwise)).drop("_stored")


def insert_if_absent(
    current: DataFrame, changes: DataFrame, key: Sequence[str], *, where: Column | None = None
) -> Change:
    """Insert rows whose key is new; of equal keys in the batch the first to arrive.

    Rows with a null key part, or outside ``where``, never conflict. The first arrival
    per key is a partial aggregate and the stored keys are compared with one row per
    batch key, so many copies of one key cost no more than one. A ``reason`` the batch
    brings along stands, and its rows take no part.
    """
    if "reason" not in changes.columns:
        changes = changes.withColumn("reason", F.lit(None).cast("string"))
    counts = F.coalesce(where, F.lit(False)) if where is not None else F.lit(True)
    binding = counts & _all_present(key)
    taking_part = binding & F.col("reason").isNull()
    first = changes.filter(taking_part).groupBy(*key).agg(F.min(ARRIVAL).alias("_first"))
    stored = stored_keys(current.filter(binding), first, key).withColumn("_stored", F.lit(True))
    verdict = first.join(stored, list(key), "left").withColumnsRenamed(
        {k: f"_k_{k}" for k in key}
    )
    tagged = join_optional(
        changes, verdict, list(key), [f"_k_{k}" for k in key], [ARRIVAL]
    ).withColumn(
        "reason",
        F.when(~taking_part, F.col("reason"))
        .when(F.col("_stored"), "already stored")
        .when(F.col(ARRIVAL) != F.col("_first"), "repeated in batch"),
    ).drop("_first", "_stored")
    taken = tagged.filter(F.col("reason").isNull())
    new_rows = taken.select(*[c for c in taken.columns if c in current.columns])
    return Change(current.unionByName(new_rows, allowMissingColumns=True), tagged)


def upsert_settings(current: DataFrame, changes: DataFrame, as_of) -> DataFrame:
    """Last value per (user, key) wins; untouched settings stay. A null user never matches.

    Stored rows are changed in a left join and new keys added beside it, so that a small
    batch is broadcast and the stored table keeps its place.
    """
    key = ["user_id", "key"]
    complete = _all_present(key)
    latest = (
        changes.filter(complete).groupBy(*key)
        .agg(F.max_by(F.struct("value"), ARRIVAL).alias("_new"))
    )
    changed = current.join(latest, key, "left").select(
        *key,
        F.when(F.col("_new").isNotNull(), F.col("_new.value")).otherwise(F.col("value")).alias("value"),
        F.when(F.col("_new").isNotNull(), as_timestamp(as_of)).otherwise(F.col("updated_at")).alias("updated_at"),
    )
    added = latest.join(stored_keys(current, latest, key), key, "left_anti").select(
        *key, "_new.value", as_timestamp(as_of).alias("updated_at")
    )
    ownerless = changes.filter(~complete).select(*key, "value", as_timestamp(as_of).alias("updated_at"))
    return changed.unionByName(added).unionByName(ownerless)


def patch_sessions(
    sessions: DataFrame, patches: DataFrame, columns: Sequence[str] = ("name", "duration_min", "notes")
) -> Change:
    """Set the given columns where the patch has a value; id and owner must match.

    Patches to one session apply in order, so per column the last value given counts.
    """
    key = ["id", "user_id"]
    merged = patches.groupBy(*key).agg(*[
        F.max_by(c, F.when(F.col(c).isNotNull(), F.col(ARRIVAL))).alias(f"_new_{c}") for c in columns
    ])
    snapshot = sessions.join(merged, key, "left").select(*[
        F.coalesce(f"_new_{c}", c).alias(c) if c in columns else F.col(c) for c in sessions.columns
    ])
    return Change(snapshot, mark_stored(sessions, patches, key, "session not found"))


def replace_rows(
    current: DataFrame,
    changes: DataFrame,
    key: Sequence[str],
    columns: Mapping[str, object],
    as_of=None,
) -> Change:
    """Overwrite ``columns`` of matched rows; absent, empty or zero values take the default.

    ``columns`` maps a column to its default (None for null). The last change per key counts.
    """
    kinds = dict(current.dtypes)

    def cleaned(c: str) -> Column:
        value = F.col(c)
        if kinds[c] == "string":
            value = blank_to_null(F.trim(value))
        elif kinds[c] != "boolean":
            value = zero_to_null(value)
        default = columns[c]
        return value if default is None else F.coalesce(value, F.lit(default))

    last = _last_per_key(changes, key).select(
        *key, F.struct(*[cleaned(c).cast(kinds[c]).alias(c) for c in columns]).alias("_new")
    )
    hit = F.col("_new").isNotNull()
    out = []
    for c in current.columns:
        if c in columns:
            out.append(F.when(hit, F.col(f"_new.{c}")).otherwise(F.col(c)).alias(c))
        elif c == "updated_at" and as_of is not None:
            out.append(F.when(hit, as_timestamp(as_of)).otherwise(F.col(c)).alias(c))
        else:
            out.append(F.col(c))
    snapshot = current.join(last, list(key), "left").select(*out)
    return Change(snapshot, mark_stored(current, changes, key, "not found"))


# What each table's references do when their parent row goes.
# child table -> [(column, parent table, action)], parents before children.
REFERENCES = {
    "workout_sessions": [("user_id", "users", "delete")],
    "workout_sets": [("session_id", "workout_sessions", "delete")],
    "cardio_sessions": [("user_id", "users", "delete")],
    "body_metrics": [("user_id", "users", "delete")],
    "nutrition_log": [("user_id", "users", "delete")],
    "goals": [("user_id", "users", "delete")],
    "user_settings": [("user_id", "users", "delete")],
    "invite_codes": [("created_by", "users", "null"), ("used_by", "users", "null")],
    "gyms": [("created_by", "users", "null")],
    "equipment_library": [("created_by_user", "users", "null")],
    "gym_equipment": [
        ("gym_id", "gyms", "delete"),
        ("equipment_id", "equipment_library", "delete"),
        ("added_by_user", "users", "null"),
    ],
    "equipment_oos_reports": [
        ("gym_equipment_id", "gym_equipment", "delete"),
        ("reported_by_user", "users", "null"),
    ],
    "equipment_flags": [("reported_by_user", "users", "null")],
}


def delete_owned_cascade(
    t: Tables, table: str, requests: DataFrame, key: Sequence[str] = ("id", "user_id")
) -> tuple[dict[str, DataFrame], DataFrame]:
    """Delete the requested rows and what depends on them.

    ``requests`` holds the ``key`` columns; with an owner column in the key only the
    owner's rows go. Returns the changed tables and the requests that matched nothing.
    """
    matched, unmatched = semi_anti_for_upsert(t[table], requests, key)
    wanted = requests.select(*key).distinct()
    gone = {table: t[table].join(wanted, list(key), "left_semi").select("id")}
    out = {table: t[table].join(wanted, list(key), "left_anti")}
    for child, references in REFERENCES.items():
        if child not in t or child == table:
            continue
        rows = t[child]
        changed = False
        for column, parent, action in references:
            if parent not in gone or column not in rows.columns:
                continue
            changed = True
            marked = gone[parent].select(F.col("id").alias("_gone")).distinct()
            marked = marked.withColumn("_hit", F.lit(True))
            spread = [c for c in ("id", "session_id", "set_number", "key") if c in rows.columns]
            rows = join_optional(rows, marked, column, "_gone", spread)
            if action == "delete":
                if "id" in rows.columns:
                    doomed = t[child].join(
                        marked, F.col(column) == F.col("_gone"), "left_semi"
                    ).select("id")
                    gone[child] = gone[child].union(doomed) if child in gone else doomed
                rows = rows.filter(F.col("_hit").isNull()).drop("_hit")
            else:
                rows = rows.withColumn(
                    column, F.when(F.col("_hit").isNull(), F.col(column))
                ).drop("_hit")
        if changed:
            out[child] = rows
    return out, unmatched.withColumn("reason", F.lit("not found"))


def delete_custom_only(current: DataFrame, requests: DataFrame) -> Change:
    """Delete requested lookup rows that are custom; default rows stay."""
    known = current.select("id", F.coalesce("is_custom", F.lit(False)).alias("_custom"))
    tagged = requests.join(known, "id", "left").withColumn(
        "reason",
        F.when(F.col("_custom").isNull(), "not found").when(~F.col("_custom"), "default rows stay"),
    ).drop("_custom")
    eligible = tagged.filter(F.col("reason").isNull()).select("id")
    return Change(current.join(eligible, "id", "left_anti"), tagged)


def backfill_owner(df: DataFrame, owner, column: str = "user_id") -> DataFrame:
    """Give ownerless rows to ``owner``."""
    return df.withColumn(column, F.coalesce(F.col(column), F.lit(owner).cast(df.schema[column].dataType)))


def resolve_exercise_ids(new_exercises: DataFrame, muscle_groups: DataFrame) -> DataFrame:
    """Muscle group id by exact name, null when the name is unknown."""
    groups = muscle_groups.select(
        F.col("id").alias("muscle_group_id"), F.col("name").alias("_group_name")
    )
    return join_optional(new_exercises, groups, "muscle_group", "_group_name", new_exercises.columns)


def _plus_days(at: Column, days: int, zone: str) -> Column:
    """Calendar days later on the clock of ``zone``."""
    local = F.from_utc_timestamp(at, zone) + F.make_interval(days=F.lit(days))
    return F.to_utc_timestamp(local, zone)


def report_oos(
    machines: DataFrame, history: DataFrame, reports: DataFrame, *, zone: str = "UTC"
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Out-of-service reports (gym_equipment_id, reported_at, notes): (machines, history, rejected).

    A machine takes its latest report time and clears itself 30 days after it.
    """
    known = machines.select(F.col("id").alias("gym_equipment_id"))
    valid = reports.join(known, "gym_equipment_id", "left_semi")
    rejected = reports.join(known, "gym_equipment_id", "left_anti")
    latest = reports.groupBy(F.col("gym_equipment_id").alias("_machine")).agg(
        F.max("reported_at").alias("_at")
    )
    hit = F.col("_at").isNotNull()
    news = {
        "is_out_of_service": F.when(hit, F.lit(True)).otherwise(F.col("is_out_of_service")),
        "condition": F.when(hit, F.lit(CONDITION_OUT)).otherwise(F.col("condition")),
        "oos_reported_at": F.coalesce("_at", "oos_reported_at"),
        "oos_auto_clear_at": F.when(hit, _plus_days(F.col("_at"), OOS_DAYS, zone)).otherwise(
            F.col("oos_auto_clear_at")
        ),
    }
    if "updated_at" in machines.columns:
        news["updated_at"] = F.coalesce("_at", "updated_at")
    changed = (
        machines.join(latest, F.col("id") == F.col("_machine"), "left")
        .withColumns(news).drop("_machine", "_at")
    )
    cleaned = valid.withColumn("notes", blank_to_null(F.trim("notes"))) if "notes" in valid.columns else valid
    grown = history.unionByName(
        cleaned.select(*[c for c in cleaned.columns if c in history.columns]), allowMissingColumns=True
    )
    return changed, grown, rejected.withColumn("reason", F.lit("machine not found"))


def resolve_oos(
    machines: DataFrame, history: DataFrame, resolved: DataFrame, as_of
) -> tuple[DataFrame, DataFrame]:
    """Put machines (``gym_equipment_id``) back in service and close their open reports."""
    done = resolved.select(F.col("gym_equipment_id").alias("_done")).distinct().withColumn(
        "_hit", F.lit(True)
    )
    hit = F.col("_hit").isNotNull()
    news = {
        "is_out_of_service": F.when(hit, F.lit(False)).otherwise(F.col("is_out_of_service")),
        "condition": F.when(hit, F.lit(CONDITION_GOOD)).otherwise(F.col("condition")),
        "oos_reported_at": F.when(~hit, F.col("oos_reported_at")),
        "oos_auto_clear_at": F.when(~hit, F.col("oos_auto_clear_at")),
    }
    if "updated_at" in machines.columns:
        news["updated_at"] = F.when(hit, as_timestamp(as_of)).otherwise(F.col("updated_at"))
    fixed = machines.join(done, F.col("id") == F.col("_done"), "left").withColumns(news)
    closed = join_optional(history, done, "gym_equipment_id", "_done", ["id"]).withColumn(
        "resolved_at",
        F.when(hit & F.col("resolved_at").isNull(), as_timestamp(as_of)).otherwise(F.col("resolved_at")),
    )
    return fixed.drop("_done", "_hit"), closed.drop("_hit")


def expire_oos(machines: DataFrame, as_of) -> DataFrame:
    """Clear status and times once the clear time has passed; condition and reports stay."""
    passed = F.coalesce(
        clear_time_passed(F.col("is_out_of_service"), F.col("oos_auto_clear_at"), as_of), F.lit(False)
    )
    marked = machines.withColumn("_passed", passed)
    return marked.withColumns({
        "is_out_of_service": F.when(F.col("_passed"), F.lit(False)).otherwise(F.col("is_out_of_service")),
        "oos_reported_at": F.when(~F.col("_passed"), F.col("oos_reported_at")),
        "oos_auto_clear_at": F.when(~F.col("_passed"), F.col("oos_auto_clear_at")),
    }).drop("_passed")


def apply_flags(target: DataFrame, flags: DataFrame, target_type: str) -> DataFrame:
    """Add the batch's flags to the targets; three in all hide one, and nothing unhides."""
    news = (
        flags.filter(F.col("target_type") == target_type)
        .groupBy(F.col("target_id").alias("_target"))
        .agg(F.count(F.lit(1)).cast("int").alias("_flags"))
    )
    total = F.col("flag_count") + F.col("_flags")
    hit = F.col("_flags").isNotNull()
    return (
        target.join(news, F.col("id") == F.col("_target"), "left")
        .withColumns({
            "is_flagged": F.when(hit & (total >= FLAGS_TO_HIDE), F.lit(True)).otherwise(F.col("is_flagged")),
            "flag_count": F.when(hit, total).otherwise(F.col("flag_count")),
        })
        .drop("_target", "_flags")
    )


def load_scale_measurements(
    current: DataFrame, measurements: DataFrame, owner_of: DataFrame | None = None
) -> Change:
    """Load converted scale readings strictly newer than each scale user's last one.

    ``measurements`` is the output of ``read_scale_measurements`` with
    ``renpho_user_id`` and ``arrival`` carried. Unreadable, old and repeated rows are
    rejected. ``owner_of`` maps ``renpho_user_id`` to ``user_id``.
    """
    incoming = measurements.withColumn("source", F.lit("renpho"))
    if owner_of is not None:
        owners = owner_of.select(F.col("renpho_user_id").alias("_scale_user"), "user_id")
        incoming = join_optional(incoming, owners, "renpho_user_id", "_scale_user", [ARRIVAL])
    marks = (
        current.filter((F.col("source") == "renpho") & F.col("renpho_user_id").isNotNull())
        .groupBy(F.col("renpho_user_id").alias("_marked"))
        .agg(F.max("measured_at").alias("_mark"))
    )
    tagged = join_optional(incoming, marks, "renpho_user_id", "_marked", [ARRIVAL]).withColumn(
        "reason",
        F.when(F.col("rejected_field").isNotNull(), F.concat(F.lit("unreadable "), "rejected_field"))
        .when(F.col("measured_at") <= F.col("_mark"), "not newer than the last load"),
    ).drop("_mark", "rejected_field")
    return insert_if_absent(
        current, tagged, ["renpho_user_id", "measured_at"], where=F.col("source") == "renpho"
    )


def deactivate_users(users: DataFrame, requests: DataFrame) -> Change:
    """Deactivate the users in ``requests`` (id, requested_by); nobody deactivates themselves."""
    tagged = requests.withColumn(
        "reason", F.when(F.col("id") == F.col("requested_by"), "own account")
    )
    off = tagged.filter(F.col("reason").isNull()).select(F.col("id").alias("_off")).distinct().withColumn("_hit", F.lit(True))
    snapshot = (
        users.join(off, F.col("id") == F.col("_off"), "left")
        .withColumn("is_active", F.when(F.col("_hit"), F.lit(False)).otherwise(F.col("is_active")))
        .drop("_off", "_hit")
    )
    return Change(snapshot, tagged)


def mark_invites_used(invites: DataFrame, uses: DataFrame) -> Change:
    """Mark invites used by (code, user_id, used_at); of several uses the first to arrive.

    Codes are matched trimmed and in upper case. An invite that is used already, or
    expired at the time of use, is not redeemed.
    """
    wanted = uses.withColumn("code", F.upper(F.trim("code")))
    known = invites.select(
        F.col("code").alias("_code"), F.col("used_at").alias("_used"), "expires_at"
    )
    first = first_rows(
        wanted.join(known, F.col("code") == F.col("_code")).filter(
            F.col("_used").isNull()
            & (F.col("expires_at").isNull() | (F.col("expires_at") > F.col("used_at")))
        ),
        ["code"],
        [F.col(ARRIVAL)],
    ).select(
        F.col("code").alias("_code"), F.col("user_id").alias("_by"), F.col("used_at").alias("_at"),
        F.col(ARRIVAL),
    )
    snapshot = (
        invites.join(first.drop(ARRIVAL), F.col("code") == F.col("_code"), "left")
        .withColumns({
            "used_by": F.coalesce("_by", "used_by"), "used_at": F.coalesce("_at", "used_at"),
        })
        .drop("_code", "_by", "_at")
    )
    redeemed = first.select(ARRIVAL).withColumn("_redeemed", F.lit(True))
    tagged = uses.join(redeemed, ARRIVAL, "left").withColumn(
        "reason", F.when(F.col("_redeemed").isNull(), "invalid or expired code")
    ).drop("_redeemed")
    return Change(snapshot, tagged)


def touch_last_login(users: DataFrame, logins: DataFrame) -> DataFrame:
    """Latest login (id, at) of each user."""
    last = logins.groupBy(F.col("id").alias("_user")).agg(F.max("at").alias("_at"))
    return (
        users.join(last, F.col("id") == F.col("_user"), "left")
        .withColumn("last_login", F.coalesce("_at", "last_login"))
        .drop("_user", "_at")
    )

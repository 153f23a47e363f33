"""Table schemas, key rules and value rules of the training and health model."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import types as T

ID = "string"

# Column names and types of the stored tables.
TABLE_DDL = {
    "users": f"id {ID}, email string, display_name string, role string, is_active boolean,"
    " created_at timestamp, last_login timestamp, updated_at timestamp",
    "invite_codes": f"id {ID}, code string, created_by {ID}, used_by {ID}, used_at timestamp,"
    " expires_at timestamp, created_at timestamp, note string",
    "muscle_groups": "id int, name string, is_custom boolean",
    "exercises": "id int, name string, muscle_group_id int, equipment string, notes string,"
    " is_custom boolean",
    "workout_sessions": f"id {ID}, user_id {ID}, session_date date, name string,"
    f" duration_min int, notes string, source string, gym_id {ID}, created_at timestamp",
    "workout_sets": f"id {ID}, session_id {ID}, exercise_id int, exercise_name string,"
    " set_number smallint, reps smallint, weight_lbs decimal(6,2), rpe decimal(3,1),"
    f" notes string, gym_equipment_id {ID}, created_at timestamp",
    "cardio_sessions": f"id {ID}, user_id {ID}, session_date date, activity_type string,"
    " distance_km decimal(7,2), duration_min int, avg_hr_bpm smallint, max_hr_bpm smallint,"
    " steps int, calories_burned int, notes string, source string, created_at timestamp",
    "body_metrics": f"id {ID}, user_id {ID}, measured_at timestamp, measurement_date date,"
    " weight_lbs decimal(6,2), body_fat_pct decimal(5,2), muscle_mass_lbs decimal(6,2),"
    " bone_mass_lbs decimal(5,2), body_water_pct decimal(5,2), visceral_fat smallint,"
    " bmi decimal(5,2), bmr_kcal int, metabolic_age smallint, source string,"
    " renpho_user_id string, created_at timestamp",
    "nutrition_log": f"id {ID}, user_id {ID}, log_date date, meal_type string,"
    " food_name string, quantity decimal(7,2), unit string, calories_kcal int,"
    " protein_g decimal(6,2), carbs_g decimal(6,2), fat_g decimal(6,2),"
    " fiber_g decimal(6,2), sugar_g decimal(6,2), sodium_mg int, notes string,"
    " created_at timestamp",
    "goals": f"id int, user_id {ID}, goal_type string, target_value decimal(8,2),"
    " target_date date, start_value decimal(8,2), start_date date, notes string,"
    " is_active boolean, created_at timestamp",
    "sleep_sessions": f"id {ID}, user_id {ID}, session_date date, sleep_start timestamp,"
    " sleep_end timestamp, duration_min int, efficiency_pct decimal(5,2),"
    " awake_min decimal(6,1), rem_min decimal(6,1), light_min decimal(6,1),"
    " deep_min decimal(6,1), out_of_bed_min decimal(6,1), avg_hr_bpm decimal(5,1),"
    " avg_spo2_pct decimal(5,2), sleep_score smallint, source string, external_id string,"
    " created_at timestamp",
    "heart_rate": f"id {ID}, user_id {ID}, measured_at timestamp, measurement_date date,"
    " bpm smallint, context string, source string, external_id string, created_at timestamp",
    "heart_rate_daily": f"id {ID}, user_id {ID}, summary_date date, resting_bpm decimal(5,1),"
    " min_bpm smallint, max_bpm smallint, avg_bpm decimal(5,1), hrv_ms decimal(6,2),"
    " source string, created_at timestamp",
    "blood_oxygen": f"id {ID}, user_id {ID}, measured_at timestamp, measurement_date date,"
    " spo2_pct decimal(5,2), context string, source string, external_id string,"
    " created_at timestamp",
    "blood_pressure": f"id {ID}, user_id {ID}, measured_at timestamp, measurement_date date,"
    " systolic_mmhg smallint, diastolic_mmhg smallint, pulse_bpm smallint, context string,"
    " notes string, source string, external_id string, created_at timestamp",
    "stress_readings": f"id {ID}, user_id {ID}, measured_at timestamp, measurement_date date,"
    " stress_score smallint, source string, external_id string, created_at timestamp",
    "daily_activity": f"id {ID}, user_id {ID}, activity_date date, steps int,"
    " distance_m decimal(8,1), calories_active int, calories_total int, active_min int,"
    " floors_climbed smallint, move_min int, vo2_max decimal(5,2), source string,"
    " created_at timestamp",
    "samsung_workouts": f"id {ID}, user_id {ID}, session_date date, workout_start timestamp,"
    " workout_end timestamp, duration_min int, activity_type string, calories int,"
    " distance_m decimal(8,1), avg_hr_bpm decimal(5,1), max_hr_bpm smallint,"
    " avg_pace_sec_km int, avg_speed_kmh decimal(5,2), elevation_gain_m decimal(7,1),"
    " steps int, avg_power_w decimal(6,1), vo2_max decimal(5,2), workout_score smallint,"
    " notes string, source string, external_id string, created_at timestamp",
    "equipment_types": "id int, name string",
    "equipment_categories": "id int, name string",
    "equipment_library": f"id {ID}, name string, brand string, type string, category string,"
    f" is_flagged boolean, flag_count int, created_by string, created_by_user {ID},"
    " created_at timestamp, updated_at timestamp",
    "gyms": f"id {ID}, name string, address string, city string, state string, zip string,"
    " phone string, website string, gym_type string, is_24hr boolean, notes string,"
    " is_default boolean, hours_mon string, hours_tue string, hours_wed string,"
    " hours_thu string, hours_fri string, hours_sat string, hours_sun string,"
    f" created_by {ID}, updated_at timestamp",
    "gym_types": "name string",
    "cardio_types": "id int, name string, is_custom boolean",
    "gym_equipment": f"id {ID}, gym_id {ID}, equipment_id {ID}, condition string,"
    " weight_min_lbs int, weight_max_lbs int, notes string, is_out_of_service boolean,"
    " oos_reported_at timestamp, oos_auto_clear_at timestamp, is_flagged boolean,"
    f" flag_count int, added_by string, added_by_user {ID}, added_at timestamp,"
    " updated_at timestamp",
    "equipment_oos_reports": f"id {ID}, gym_equipment_id {ID}, reported_by string,"
    f" reported_by_user {ID}, reported_at timestamp, resolved_at timestamp, notes string",
    "equipment_flags": f"id {ID}, target_type string, target_id {ID}, reason string,"
    f" reported_by string, reported_by_user {ID}, reported_at timestamp,"
    " resolved_at timestamp, resolved_by string",
    "user_settings": f"id int, user_id {ID}, key string, value string, updated_at timestamp",
    "waitlist": "email string, invited_at timestamp, created_at timestamp",
}

# Incoming documents.
SET_DDL = "reps: int, weight_lbs: decimal(6,2), rpe: decimal(3,1), notes: string"
WORKOUT_DOCUMENT_DDL = (
    "date string, name string, duration_min int, notes string, gym_id string,"
    f" exercises array<struct<name: string, gym_equipment_id: string, sets: array<struct<{SET_DDL}>>>>"
)
NUTRITION_ENTRY_DDL = (
    "log_date string, meal_type string, food_name string, calories_kcal int,"
    " protein_g decimal(6,2), carbs_g decimal(6,2), fat_g decimal(6,2), notes string"
)
SCALE_FIELDS = (
    "timeStamp", "time_stamp", "timestamp", "localCreatedAt", "weight", "bodyfat", "muscle",
    "bone", "water", "visfat", "bmi", "bmr", "bodyage",
)


def table_schema(name: str) -> T.StructType:
    return T.StructType.fromDDL(TABLE_DDL[name])


@dataclass(frozen=True)
class TableRules:
    """Constraints of one table, in the order they are reported."""

    key: str = "id"
    not_null: tuple[str, ...] = ()
    one_of: dict[str, tuple[str, ...]] = field(default_factory=dict)
    max_length: dict[str, int] = field(default_factory=dict)
    decimal_range: dict[str, tuple[int, int]] = field(default_factory=dict)
    unique: tuple[tuple[str, ...], ...] = ()
    unique_where: tuple[tuple[tuple[str, ...], str], ...] = ()
    foreign: dict[str, tuple[str, str]] = field(default_factory=dict)


# Constraints of the stored tables.
RULES = {
    "users": TableRules(
        not_null=("email", "role"),
        one_of={"role": ("admin", "member")},
        max_length={"email": 255, "display_name": 100, "role": 20},
        unique=(("email",),),
    ),
    "invite_codes": TableRules(
        not_null=("code",),
        max_length={"code": 32, "note": 200},
        unique=(("code",),),
        foreign={"created_by": ("users", "id"), "used_by": ("users", "id")},
    ),
    "muscle_groups": TableRules(not_null=("name",), max_length={"name": 50}, unique=(("name",),)),
    "exercises": TableRules(
        not_null=("name",),
        max_length={"name": 100, "equipment": 50},
        unique=(("name",),),
        foreign={"muscle_group_id": ("muscle_groups", "id")},
    ),
    "workout_sessions": TableRules(
        not_null=("user_id", "session_date", "name"),
        max_length={"name": 100, "source": 20},
        unique=(("id",),),
        foreign={"user_id": ("users", "id"), "gym_id": ("gyms", "id")},
    ),
    "workout_sets": TableRules(
        not_null=("session_id", "set_number"),
        max_length={"exercise_name": 100},
        decimal_range={"weight_lbs": (6, 2), "rpe": (3, 1)},
        foreign={
            "session_id": ("workout_sessions", "id"),
            "exercise_id": ("exercises", "id"),
            "gym_equipment_id": ("gym_equipment", "id"),
        },
    ),
    "cardio_sessions": TableRules(
        not_null=("user_id", "session_date", "activity_type"),
        max_length={"activity_type": 50, "source": 20},
        decimal_range={"distance_km": (7, 2)},
        unique=(("id",),),
        foreign={"user_id": ("users", "id")},
    ),
    "body_metrics": TableRules(
        not_null=("user_id", "measured_at", "measurement_date"),
        max_length={"source": 20, "renpho_user_id": 50},
        decimal_range={"weight_lbs": (6, 2), "body_fat_pct": (5, 2)},
        unique=(("id",),),
        unique_where=((("renpho_user_id", "measured_at"), "source = 'renpho'"),),
        foreign={"user_id": ("users", "id")},
    ),
    "nutrition_log": TableRules(
        not_null=("log_date", "meal_type", "food_name"),
        max_length={"meal_type": 20, "food_name": 200, "unit": 30},
        unique=(("id",),),
        foreign={"user_id": ("users", "id")},
    ),
    "goals": TableRules(
        not_null=("goal_type",),
        max_length={"goal_type": 50},
        decimal_range={"target_value": (8, 2), "start_value": (8, 2)},
        foreign={"user_id": ("users", "id")},
    ),
    "sleep_sessions": TableRules(
        not_null=("session_date", "sleep_start", "sleep_end"), unique=(("external_id",),)
    ),
    "heart_rate": TableRules(
        not_null=("measured_at", "measurement_date", "bpm"), unique=(("external_id",),)
    ),
    "heart_rate_daily": TableRules(not_null=("summary_date",), unique=(("user_id", "summary_date"),)),
    "blood_oxygen": TableRules(
        not_null=("measured_at", "measurement_date", "spo2_pct"), unique=(("external_id",),)
    ),
    "blood_pressure": TableRules(
        not_null=("measured_at", "measurement_date", "systolic_mmhg", "diastolic_mmhg"),
        unique=(("external_id",),),
    ),
    "stress_readings": TableRules(not_null=("measured_at", "measurement_date", "stress_score")),
    "daily_activity": TableRules(not_null=("activity_date",), unique=(("user_id", "activity_date"),)),
    "samsung_workouts": TableRules(
        not_null=("session_date", "workout_start", "workout_end", "activity_type"),
        max_length={"activity_type": 50},
        unique=(("external_id",),),
    ),
    "equipment_library": TableRules(
        not_null=("name", "type"),
        max_length={"name": 150, "brand": 100, "type": 50, "category": 50},
        unique=(("name", "brand"),),
    ),
    "equipment_types": TableRules(not_null=("name",), max_length={"name": 50}, unique=(("name",),)),
    "equipment_categories": TableRules(
        not_null=("name",), max_length={"name": 50}, unique=(("name",),)
    ),
    "gym_equipment": TableRules(
        not_null=("gym_id", "equipment_id"),
        one_of={"condition": ("excellent", "good", "fair", "out_of_service")},
        unique=(("gym_id", "equipment_id"),),
        foreign={"gym_id": ("gyms", "id"), "equipment_id": ("equipment_library", "id")},
    ),
    "equipment_oos_reports": TableRules(
        not_null=("gym_equipment_id",), foreign={"gym_equipment_id": ("gym_equipment", "id")}
    ),
    "equipment_flags": TableRules(
        not_null=("target_type", "target_id"),
        one_of={"target_type": ("library", "gym_equipment")},
        max_length={"reason": 200},
    ),
    "user_settings": TableRules(not_null=("key",), unique=(("user_id", "key"),)),
    "waitlist": TableRules(key="email", not_null=("email",), unique=(("email",),)),
}

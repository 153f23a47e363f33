from vitalspark.functions.dates import days_before, parse_scale_time, week_start
from vitalspark.functions.health import bp_class, effective_oos
from vitalspark.functions.numbers import (
    blank_to_null,
    kg_to_lbs,
    km_to_miles,
    mean_rounded,
    metres_to_km,
    one_rep_max,
    round_to_int,
    zero_to_null,
)
from vitalspark.functions.text import (
    contains_listed_word,
    is_email,
    normalise_email,
    pace_text,
    setting_value,
)

__all__ = [
    "blank_to_null", "bp_class", "contains_listed_word", "days_before", "effective_oos",
    "is_email", "kg_to_lbs", "km_to_miles", "mean_rounded", "metres_to_km",
    "normalise_email", "one_rep_max", "pace_text", "parse_scale_time", "round_to_int",
    "setting_value", "week_start", "zero_to_null",
]

"""Headline queries timed on ``$BENCH_SF_DIR``; prints one JSON line.

Each query writes all its rows to the ``noop`` sink, so nothing is pruned away. The
session is warmed with the first query, each query runs once unmeasured, then the median of
$BENCH_RUNS runs (default 1) is taken.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

from vitalspark.plans.catalog import load_all
from vitalspark.session import local_session

HEADLINE = (
    "personal_records", "prs_by_machine", "last_performance", "last_performance_by_machine",
    "workout_detail", "exercise_prs", "sets_with_machine", "session_list", "session_detail",
    "volume_by_day", "volume_by_day_recent", "weekly_workouts", "weekly_cardio", "weekly_sleep",
    "daily_nutrition", "daily_health_summary", "daily_health_summary_aligned", "hr_trend",
    "weight_trend", "latest_metric", "activity_feed", "recent_activity_topk", "dashboard_summary",
    "admin_user_activity", "gym_equipment_detail", "library_with_gym_count", "search_library",
    "gym_workout_summary", "insert_if_absent", "upsert_settings", "patch_sessions",
    "delete_owned_cascade", "validate_gym_equipment", "load_scale_measurements", "content_screen",
    "ingest_workout_documents", "last_performance_fallback", "submit_library_entries", "publish_marts",
    "stream_daily_weekly",
)


def run_once(query, spark, sf_dir: str) -> float:
    start = time.perf_counter()
    query.frame(spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "1"))
    names = sys.argv[1:] or HEADLINE
    spark = local_session(cpus, "vitalspark-bench")
    spark.sparkContext.setLogLevel("ERROR")
    catalog = load_all()
    seconds = {}
    run_once(catalog[names[0]], spark, sf_dir)
    for name in names:
        run_once(catalog[name], spark, sf_dir)
        seconds[name] = round(
            statistics.median(run_once(catalog[name], spark, sf_dir) for _ in range(runs)), 3
        )
    print(json.dumps({
        "metric": "headline queries, total wall time",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }))
    spark.stop()


if __name__ == "__main__":
    main()

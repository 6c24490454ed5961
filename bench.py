"""Time the headline queries; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from retrace.operators import dictionary, reports, search  # noqa: E402
from retrace.plans.catalog import QUERIES  # noqa: E402
from retrace.plans.registry import Tables, plain  # noqa: E402
from retrace.session import prepare, scratch_path  # noqa: E402

FOLDER = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")

HEADLINE = [
    "line_dictionary", "line_runs", "search_windows", "search_split_phrase", "timeline_windows", "near_dup_collapse",
    "asof_app", "effective_app", "event_sessions", "app_runs", "state_intervals", "blackout_by_app", "retention_phone",
    "percentiles", "usage_by_app", "days", "adjacent_differences", "cooldown", "resumed_counts", "layout_text",
]


def finish(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def timed(fn) -> float:
    start = time.perf_counter()
    fn()
    return round(time.perf_counter() - start, 3)


def stored_searches(spark: SparkSession) -> dict[str, float]:
    """Searches against a stored dictionary, the form a history is queried in day after day."""
    out = {}
    folder = scratch_path(spark, "bench-dictionary")

    def build():
        built = dictionary.build(Tables(spark, FOLDER).frames())
        dictionary.save(built, folder)

    out["build_store"] = timed(build)
    store = dictionary.load(spark, folder)
    for name, term in (("long", "thanedble the"), ("short", "Es")):
        out[f"store_search_{name}_term"] = timed(lambda: finish(search.frames_with_term(store.frames, store.lines, store.runs, term)))
    out["store_search_windows"] = timed(lambda: finish(plain(search.search(store, "thanedble License Of"))))
    out["store_days"] = timed(lambda: finish(reports.days(store.frames)))
    return out


def main() -> None:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]")
        .appName("bench")
        .config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    prepare(spark)
    finish(QUERIES["days"](spark, FOLDER))  # start the JVM and workers before timing
    times = {name: timed(lambda name=name: finish(QUERIES[name](spark, FOLDER))) for name in HEADLINE}
    times.update(stored_searches(spark))
    total = round(sum(times.values()), 3)
    print(json.dumps({"metric": "headline_queries_total", "value": total, "unit": "sec", "queries": times, "sf": FOLDER.rsplit("sf", 1)[-1]}))
    spark.stop()


if __name__ == "__main__":
    main()

"""Time the headline queries and print one JSON line."""

from __future__ import annotations

import contextlib
import json
import os
import sys
import time

from tideline.plans.queries import queries
from tideline.session import session

HEADLINE = [
    "curated_sightings",
    "stratified_sightings",
    "discovery_by_area",
    "discovery_by_subarea",
    "report_encounters",
    "resight_share",
    "prop_summary",
    "anova_area_year_interaction",
    "random_sampling_test_area",
    "movement_test",
    "capture_history",
    "jolly_seber",
    "overdispersion",
    "abundance_bootstrap",
    "model_average",
    "report_abundance",
    "trend_interval_stock",
    "trend_interval_pooled",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = session(
        f"local[{cpus}]",
        int(cpus),
        **{
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.driver.memory": os.environ.get("BENCH_MEMORY", "12g"),
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    registered, seconds = queries(), {}
    # One small query first, so that starting the session is not counted.
    registered["annual_sightings"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    for name in names:
        start = time.perf_counter()
        registered[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    with contextlib.suppress(Exception):
        spark.stop()
    total = round(sum(seconds.values()), 3)
    print(
        json.dumps({"metric": "headline_queries", "value": total, "unit": "sec", "queries": seconds, "sf": sf_dir})
    )


if __name__ == "__main__":
    main()

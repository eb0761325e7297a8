"""Times the headline queries on ``$BENCH_SF_DIR`` with ``local[$BENCH_CPUS]``; prints one JSON line.

Every query runs once untimed, then three times; the best counts.
"""

from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from lakeglass.operators.filters import filter_rows, match_count  # noqa: E402
from lakeglass.operators.histogram import bins_of  # noqa: E402
from lakeglass.operators.profile import profile, profile_text  # noqa: E402
from lakeglass.operators.table import shown_text  # noqa: E402
from lakeglass.plans import profile_queries, sql_queries, table_queries  # noqa: E402,F401
from lakeglass.plans.registry import BUILDERS, Tables  # noqa: E402
from lakeglass.runtime import configure  # noqa: E402

REGISTERED = [
    "filter_contains", "filter_day_at_most", "filter_match_count", "range_whole_columns", "asof_join", "range_join", "bursts_of_events",
    "sql_join_group", "sql_window_top_per_group", "sql_pivot_dynamic", "catalog_listing", "snapshot_deltas", "manifest_preview_outcomes",
]


def headline(t: Tables):
    lineitem = t.lineitem
    return {
        "profile_lineitem": lambda: profile(lineitem),
        "profile_lineitem_estimated_distinct": lambda: profile(lineitem, distinct="approx"),
        "profile_documents": lambda: profile(t.documents),
        "profile_text_orders": lambda: profile_text(t.orders),
        "histogram_lineitem": lambda: bins_of(profile(lineitem)),
        "filter_lineitem_typed": lambda: match_count(lineitem, {"l_returnflag": "=R", "l_quantity": ">45", "l_shipdate": "<=1999-01-01"}),
        "filter_lineitem_text": lambda: match_count(lineitem, {"l_extendedprice": "99", "l_shipdate": "!1999"}),
        "filter_text_cells": lambda: match_count(shown_text(lineitem), {"l_extendedprice": ">50000", "l_discount": "=0.1"}),
        "filter_rows_lineitem": lambda: filter_rows(lineitem, {"l_quantity": ">=49"}),
        **{name: (lambda n=name: BUILDERS[n](t)) for name in REGISTERED},
    }


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("lakeglass-bench")
        .config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    spark.sparkContext.setLogLevel("OFF")
    tables = Tables(configure(spark), folder)
    seconds = {}
    for build in headline(tables).values():  # one untimed pass, so that no query pays for starting the JVM
        build().write.format("noop").mode("overwrite").save()
    for name, build in headline(tables).items():
        best = float("inf")
        for _ in range(3):
            started = time.perf_counter()
            build().write.format("noop").mode("overwrite").save()
            best = min(best, time.perf_counter() - started)
        seconds[name] = round(best, 3)
    print(json.dumps({"metric": "total_seconds_best_of_3", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds,
                      "sf": os.path.basename(folder.rstrip("/"))}))


if __name__ == "__main__":
    main()

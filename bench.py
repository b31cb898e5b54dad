"""Headline timings on ``$BENCH_SF_DIR`` with ``local[$BENCH_CPUS]``; prints one JSON line.

``recompute`` is the batch job from the raw tables: trailing years, monthly history and ranges, six models,
scores, signs, indicators, ranks and the wide screen view. Nothing is shared between the timed queries but
``screen``, which reads the view as it was materialised. ``calibration`` is a fixed sum over no table, in no total: rounds on
machines of different speed compare by it; ``rows`` are the rows of each query.
"""

import json
import os
import time

from pyspark.sql import Observation
from pyspark.sql import functions as F

from finstrata.plans import catalog
from finstrata.plans.standin import forget_shared
from finstrata.session import get_session

SF = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 4))
QUERIES = [  # name, catalog query, start from the raw tables
    ("ttm", "res26_ttm", True), ("ratios", "rat22_sector_overlay", True), ("history_label", "his_monthly_label", True),
    ("valuations", "val17_run_valuations", True), ("snapshots", "res23_build_snapshots", True), ("as_of", "pit1_as_of_annual", True),
    ("fund_changes", "gur9_quarter_changes", True), ("insider_totals", "ins8_window_totals", True), ("form4_parse", "src3_form4_trades", True),
    ("sector_medians", "qry12_sector_medians", True), ("price_stats", "tsa10_price_stats", True), ("resample", "tsa3_resample_weekly", True),
    ("unmapped_top", "dq14_unmapped_top", True),
    ("recompute", "scr1_wide_view", True), ("screen", "scr4_screen", False), ("screen_presets", "scr8_presets", False),
]


def main() -> None:
    spark = get_session("bench", spark__master=f"local[{CPUS}]", spark__sql__shuffle__partitions=CPUS, spark__driver__memory="12g",
                        spark__ui__enabled="false", spark__ui__showConsoleProgress="false")
    spark.sparkContext.setLogLevel("ERROR")
    spark.range(1000).selectExpr("sum(id)").collect()
    t = time.time()
    spark.range(400_000_000).selectExpr("sum(xxhash64(id) % 1000)").collect()
    calibration, took, rows = round(time.time() - t, 3), {}, {}
    for name, key, fresh in QUERIES:
        if fresh:
            forget_shared(spark)
        t, seen = time.time(), Observation(name)
        catalog.run(key)(spark, SF).observe(seen, F.count(F.lit(1)).alias("n")).write.format("noop").mode("overwrite").save()
        took[name], rows[name] = round(time.time() - t, 3), seen.get["n"]
    print(json.dumps({"metric": "total_seconds", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": SF, "calibration": calibration, "rows": rows}))


if __name__ == "__main__":
    main()

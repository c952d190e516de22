"""Benchmark the headline queries.

Runs each query ``BENCH_REPEATS`` times (default 3) on ``local[$BENCH_CPUS]`` against
``$BENCH_SF_DIR`` (default /root/testdata/sf0.1), executing the full plan through the
``noop`` sink (nothing is collected to the driver), and prints ONE JSON line with the median
seconds per query and their sum.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from solera.plans import etl  # noqa: E402
from solera.plans.registry import QUERIES  # noqa: E402
from solera.session import build_session, recommended_conf  # noqa: E402

HEADLINE = [
    "q1_monthly_sales", "q2_top_customers", "q3_margin", "g1_agg_monthly", "g10_kpis",
    "g13_daily_sales", "g11_fx_dashboard", "dq_run",
]
# the whole-run ETL is timed separately (it writes a lake to a fresh scratch folder)
OPTIONAL = ["w4_rolling_volatility", "w6_ema_distance", "s10_decide",
            "c8_attribute_conversions", "b8_scd1_latest", "g26_active_users"]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    repeats = int(os.environ.get("BENCH_REPEATS", "3"))
    input_bytes = sum(os.path.getsize(os.path.join(r, f)) for r, _, fs in os.walk(sf_dir) for f in fs)
    conf = recommended_conf(input_bytes, int(cpus))
    conf["spark.driver.memory"] = os.environ.get("BENCH_DRIVER_MEM", "16g")
    spark = build_session(master=f"local[{cpus}]", extra=conf)
    names = HEADLINE + [n for n in OPTIONAL if n in QUERIES]
    # warm-up: JVM class loading and the parquet footers
    QUERIES["q1_monthly_sales"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    results = {}
    for name in names:
        times = []
        for _ in range(repeats):
            t0 = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - t0)
        results[name] = round(statistics.median(times), 3)
    # the whole batch lake run (extract -> raw snapshots -> dims/fact -> partitioned lake ->
    # monthly aggregate -> warehouse copy -> reconciliation -> audit), a fresh folder per run
    times = []
    for _ in range(repeats):
        work = tempfile.mkdtemp(prefix="solera-bench-etl-")
        t0 = time.perf_counter()
        etl.run(spark, sf_dir, work, loaded_at="2024-05-01T10")
        times.append(time.perf_counter() - t0)
    results["etl_batch_run"] = round(statistics.median(times), 3)
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({"metric": "sum_of_median_query_seconds", "value": round(sum(results.values()), 3),
                      "unit": "sec", "queries": results, "sf": sf, "cpus": int(cpus),
                      "spark": spark.version, "repeats": repeats}))
    spark.stop()


if __name__ == "__main__":
    main()

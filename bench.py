"""Headline queries on a published star. Prints one JSON line.

The star is built and published first (``setup``). Each query is planned and run afresh into the noop
sink, which makes Spark produce every row without shipping it to Python: ``WARM_UPS`` times unmeasured,
while the JVM still compiles, then ``RUNS`` times, of which the median counts.
"""

import json
import os
import statistics
import time

from starloom.functions import fixed_values as fixed
from starloom.plans import analyses, quality
from starloom.plans.publish import publish, read_orders_of_status, read_star
from starloom.scratch import scratch_path
from starloom.session import local_session
from starloom.sources import store
from starloom.sources.conform import RawTables
from starloom.sources.schemas import RAW_DDL, raw_schema
from starloom.verification.queries import MONTHS

FOLDER = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CORES = os.environ.get("BENCH_CPUS", "8")
WARM_UPS = int(os.environ.get("BENCH_WARM_UPS", "3"))
RUNS = int(os.environ.get("BENCH_RUNS", "7"))


def timed(action):
    start = time.perf_counter()
    action()
    return time.perf_counter() - start


def written_raw(spark, folder):
    """The raw layer as Parquet, as a load from CSV would leave it."""
    root = scratch_path(spark, "bench-raw")
    for table, df in RawTables(spark, folder).items():
        store.write_table(df, f"{root}/{table}")
    return {t: store.read_table(spark, f"{root}/{t}", raw_schema(t)) for t in RAW_DDL}


def main():
    spark = local_session(CORES, "starloom-bench")
    spark.sparkContext.setLogLevel("ERROR")
    raw = {}
    raw_sec = timed(lambda: raw.update(written_raw(spark, FOLDER)))
    root = scratch_path(spark, "bench-star")
    publish_sec = timed(lambda: publish(spark, raw, root))
    star = read_star(spark, root)
    orders, items = star["fact_orders"], star["fact_order_items"]
    # As the star above, the table of one status is opened before it is asked.
    canceled = read_orders_of_status(spark, root, fixed.CANCELED)
    queries = {
        "monthly_revenue": lambda: analyses.monthly_revenue(items, orders, MONTHS),
        "cohort_retention": lambda: analyses.retention(orders),
        "top_sellers": lambda: analyses.top_sellers(items, star["dim_products"], orders),
        "late_rate": lambda: analyses.late_rate(orders, star["dim_customers"]),
        "rfm": lambda: analyses.rfm(orders),
        "review_delay": lambda: analyses.review_delay(star["fact_reviews"]),
        "selective_lookup": lambda: analyses.orders_with_status(canceled),
        "check_primary_keys": lambda: quality.primary_keys(star),
    }
    # What any job costs before it does anything: planning, scheduling and committing one row.
    queries = {"fixed_cost": lambda: spark.range(1)} | queries
    seconds = {}
    for name, query in queries.items():
        runs = [
            timed(lambda: query().write.format("noop").mode("overwrite").save()) for _ in range(WARM_UPS + RUNS)
        ]
        seconds[name] = round(statistics.median(runs[WARM_UPS:]), 4)
    fixed_cost = seconds.pop("fixed_cost")
    print(
        json.dumps(
            {
                "metric": "median seconds per query on the published star, summed",
                "value": round(sum(seconds.values()), 4),
                "unit": "sec",
                "queries": seconds,
                "fixed_cost_of_a_job": fixed_cost,
                "setup": {"raw_to_parquet": round(raw_sec, 2), "build_check_publish": round(publish_sec, 2)},
                "sf": FOLDER.rstrip("/").rsplit("sf", 1)[-1],
                "rows": {"fact_orders": orders.count(), "fact_order_items": items.count()},
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()

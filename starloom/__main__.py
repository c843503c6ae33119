"""Jobs for ``spark-submit``: load the CSV inputs, publish the star, write one report.

    python -m starloom load <csv folder> <root>       <csv folder>/<table>.csv, nine of them
    python -m starloom publish <root>
    python -m starloom expire <root> [<keep>]         drop all loads and stars but the newest ones (1)
    python -m starloom report <root> <name> <output> [<option>=<value> ...]  Parquet

Options: ``months=2017-01-01,2018-08-01`` (first and last) of monthly_revenue and orders_outside_window, ``k=3`` of
top_sellers, ``buckets=4`` of rfm, ``status=canceled`` of canceled_orders.
"""

import sys

from pyspark.sql import SparkSession

from starloom.functions import fixed_values as fixed
from starloom.plans import analyses, quality
from starloom.plans.publish import load_raw, publish, read_orders_of_status, read_raw, read_report, read_star
from starloom.scratch import drop_scratch
from starloom.session import require_settings
from starloom.sources import store
from starloom.sources.schemas import RAW_DDL

REPORTS = {
    "monthly_revenue": lambda raw, star, **options: analyses.monthly_revenue(
        star["fact_order_items"], star["fact_orders"], **options
    ),
    "cohort_retention": lambda raw, star: analyses.retention(star["fact_orders"]),
    "top_sellers": lambda raw, star, **options: analyses.top_sellers(
        star["fact_order_items"], star["dim_products"], star["fact_orders"], **options
    ),
    "late_rate": lambda raw, star: analyses.late_rate(star["fact_orders"], star["dim_customers"]),
    "rfm": lambda raw, star, **options: analyses.rfm(star["fact_orders"], **options),
    "review_delay": lambda raw, star: analyses.review_delay(star["fact_reviews"]),
    "untranslated_categories": lambda raw, star: quality.untranslated_categories(star["dim_products"]),
    "orders_outside_window": lambda raw, star, **options: quality.orders_outside_window(star["fact_orders"], **options),
    "cost_of_one_address": lambda raw, star: quality.cost_of_one_address(raw["customers"]),
}

OPTIONS = {"months": lambda text: tuple(text.split(",")), "k": int, "buckets": int, "status": str}


def main(spark: SparkSession, job: str, *args: str) -> None:
    if job == "load":
        folder, root = args
        load_raw(spark, {table: f"{folder}/{table}.csv" for table in RAW_DDL}, f"{root}/raw")
    elif job == "publish":
        (root,) = args
        publish(spark, read_raw(spark, f"{root}/raw"), f"{root}/star")
    elif job == "expire":
        root, keep = args[0], int(args[1]) if len(args) > 1 else 1
        for layer in ("raw", "star"):
            store.expire(spark, f"{root}/{layer}", keep)
    elif job == "report":
        require_settings(spark)
        root, name, output, *given = args
        options = {key: OPTIONS[key](value) for key, _, value in (g.partition("=") for g in given)}
        if name == "quality_report":
            report = read_report(spark, f"{root}/star")
        elif name == "canceled_orders":
            status = options.get("status", fixed.CANCELED)
            report = analyses.orders_with_status(read_orders_of_status(spark, f"{root}/star", status), status)
        else:
            report = REPORTS[name](read_raw(spark, f"{root}/raw"), read_star(spark, f"{root}/star"), **options)
        report.write.parquet(output)
        if spark.read.schema(report.schema).parquet(output).isEmpty():
            print(f"{name}: no rows; are the months or the status in the data?", file=sys.stderr)
    else:
        raise SystemExit(__doc__)


if __name__ == "__main__":
    session = SparkSession.builder.appName("starloom").getOrCreate()
    try:
        main(session, *sys.argv[1:])
    finally:
        drop_scratch(session)

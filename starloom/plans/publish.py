"""Full refresh of the raw layer and of the star, each all-or-nothing."""

from collections.abc import Callable, Mapping
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.util import inheritable_thread_target

from starloom.plans import star_build
from starloom.plans.quality import KEY_CHECK, quality_report
from starloom.scratch import tidied
from starloom.session import require_settings
from starloom.sources import store
from starloom.sources.csv_files import read_raw_csv
from starloom.sources.schemas import RAW_DDL, STAR_DDL, raw_schema, star_schema

REPORT = "quality_report"
# Two loads lie side by side until the newer one is announced, and earlier ones until they expire.
RAW_CODEC = "zstd"
# Folders by the column selective reads filter on; every value stays a large enough slice of the table.
PARTITIONS = {"fact_orders": ("order_status",), "fact_order_items": ("purchase_month",)}
# What the manifest of a table in folders tells the range of, file by file.
RANGED = {"fact_orders": "purchase_date", "fact_order_items": "purchase_date"}


class KeyViolation(Exception):
    """A table of the new star breaks its primary key; nothing was published."""


def load_raw(
    spark: SparkSession, paths: Mapping[str, str], root: str, done: Callable[[str], None] = lambda table: None
) -> int:
    """Replace the raw layer by the nine CSV inputs; a bad record leaves the previous load in place.

    ``done`` is told the name of each table once it is written: this load does not read its input again.
    """
    require_settings(spark)
    run = store.new_run(root)
    for table in RAW_DDL:
        with tidied(spark):
            store.write_table(read_raw_csv(spark, table, paths[table]), f"{run}/{table}", compression=RAW_CODEC)
        done(table)
    return store.announce(spark, root, run)


def read_raw(spark: SparkSession, root: str, version: int | None = None) -> dict[str, DataFrame]:
    _, run = store.current_run(spark, root, version)
    return {table: store.read_table(spark, f"{run}/{table}", raw_schema(table)) for table in RAW_DDL}


def publish(spark: SparkSession, raw: Mapping[str, DataFrame], root: str) -> int:
    """Build, write, check, then switch. Returns the new version.

    Only a broken key stops the switch. The report of all checks is kept beside the tables
    (``read_report``); the other checks inform.
    """
    require_settings(spark)
    run = store.new_run(root)
    _write_star(spark, raw, run)
    star = _star_at(spark, run)
    # All checks are one job, whose scans and counts run side by side.
    quality_report(raw, star).write.parquet(f"{run}/{REPORT}")
    broken = spark.read.parquet(f"{run}/{REPORT}").filter((F.col("check") == KEY_CHECK) & ~F.col("ok")).collect()
    if broken:
        raise KeyViolation(", ".join(f"{row['metric']}={row['value']:f}" for row in broken))
    return store.announce(spark, root, run)


def _at_once(spark: SparkSession, *jobs: Callable[[], None]) -> None:
    """Run jobs that need nothing of each other side by side, so that the last tasks of one leave no core idle."""
    with ThreadPoolExecutor(len(jobs)) as pool:
        started = [pool.submit(inheritable_thread_target(spark)(job)) for job in jobs]
    for job in started:
        job.result()


def _write_star(spark: SparkSession, raw: Mapping[str, DataFrame], run: str) -> None:
    def write(table: str, df: DataFrame) -> None:
        store.write_table(df, f"{run}/{table}", PARTITIONS.get(table, ()))

    def note_files(table: str) -> None:
        store.write_manifest(spark, run, table, star_schema(table), *PARTITIONS[table], RANGED[table])

    def write_facts() -> None:
        write("fact_orders", star_build.fact_orders(raw["orders"], raw["customers"], raw["order_payments"]))
        # The written orders carry all the other facts need: no second join of orders and customers.
        orders = store.read_table(spark, f"{run}/fact_orders", star_schema("fact_orders"))

        def write_items() -> None:
            write("fact_order_items", star_build.fact_order_items(raw["order_items"], orders))
            note_files("fact_order_items")

        _at_once(
            spark,
            write_items,
            lambda: write("fact_reviews", star_build.fact_reviews(raw["order_reviews"], orders)),
            lambda: note_files("fact_orders"),
        )

    _at_once(
        spark,
        write_facts,
        lambda: write("dim_customers", star_build.dim_customers(raw["customers"])),
        lambda: write("dim_products", star_build.dim_products(raw["products"], raw["product_category_translation"])),
        lambda: write("dim_sellers", star_build.dim_sellers(raw["sellers"])),
    )


def _star_at(spark: SparkSession, run: str) -> dict[str, DataFrame]:
    return {table: store.read_table(spark, f"{run}/{table}", star_schema(table)) for table in STAR_DDL}


def read_star(spark: SparkSession, root: str, version: int | None = None) -> dict[str, DataFrame]:
    """The six tables of the newest (or the given) version."""
    _, run = store.current_run(spark, root, version)
    return _star_at(spark, run)


def read_orders_of_status(
    spark: SparkSession, root: str, status: str | None, days: tuple[str, str] | None = None, version: int | None = None
) -> DataFrame:
    """``fact_orders`` of one status, of the purchase days from the first to the last of ``days`` if they are given.

    The manifest names the files, so no folder is listed and no other file is opened.
    """
    _, run = store.current_run(spark, root, version)
    orders = store.read_folder(spark, run, "fact_orders", star_schema("fact_orders"), status, days)
    return orders if days is None else orders.filter(F.col("purchase_date").between(*[F.lit(d).cast("date") for d in days]))


def read_report(spark: SparkSession, root: str, version: int | None = None) -> DataFrame:
    _, run = store.current_run(spark, root, version)
    return spark.read.parquet(f"{run}/{REPORT}")


def register_tables(spark: SparkSession, root: str, database: str, version: int | None = None) -> None:
    """Name the tables of the newest (or the given) version in the catalog, for every session and client that shares it.

    They are views on the run's files; call it again after a publish, and before the run expires.
    """
    _, run = store.current_run(spark, root, version)
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {database}")
    for table in STAR_DDL:
        columns = ", ".join(f"CAST({f.name} AS {f.dataType.simpleString()}) AS {f.name}" for f in star_schema(table))
        spark.sql(f"CREATE OR REPLACE VIEW {database}.{table} AS SELECT {columns} FROM parquet.`{run}/{table}`")


def register_views(tables: Mapping[str, DataFrame]) -> None:
    """Name the tables for ``spark.sql``."""
    for name, df in tables.items():
        df.createOrReplaceTempView(name)

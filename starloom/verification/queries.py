"""One named query per operator, run on raw tables derived from the test tables."""

from collections.abc import Callable
from functools import cache, reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DateType, DecimalType

from starloom.functions import fixed_values as fixed
from starloom.plans import analyses, layout, quality, star_build
from starloom.plans.publish import load_raw, publish, read_orders_of_status, read_raw, read_star
from starloom.scratch import drop, scratch_path, tidied
from starloom.sources.conform import RawTables, raw_table
from starloom.sources.csv_files import read_raw_csv
from starloom.sources.schemas import RAW_DDL

Query = Callable[[SparkSession, str], DataFrame]

# The test tables' own analysis window: cuts both tails, as the default window does for real data.
STAR_TABLES = ("dim_customers", "dim_products", "dim_sellers", "fact_orders", "fact_order_items", "fact_reviews")
MONTHS = ("1995-03-01", "2001-05-01")


# Without ANSI mode a cast to text writes decimals of more places as Java does, small ones with an exponent; writing digits costs more.
EXPONENT_FREE_PLACES = 6

# Inputs that wait for two loads. A compressed file is read by one task, so none is large.
PACKED_CSV = {"compression": "gzip", "maxRecordsPerFile": 250_000}

# Integer measures that can be NULL.
OPTIONAL_COUNTS = ("late_delivery_days", "delivery_delay_days", "payment_count", "max_payment_installments")


def plain(df: DataFrame) -> DataFrame:
    """Types two engines print alike, NULLs included: numbers as the nearest double, days and flags as text."""
    changed = {}
    for field in df.schema:
        if isinstance(field.dataType, DecimalType) or field.name in OPTIONAL_COUNTS:
            changed[field.name] = F.col(field.name).cast("double")
        elif isinstance(field.dataType, DateType | BooleanType):
            changed[field.name] = F.col(field.name).cast("string")
    return df.withColumns(changed) if changed else df


class Tables:
    """Raw and star tables over one folder, each put together when it is first asked for."""

    def __init__(self, spark: SparkSession, folder: str):
        self.raw = RawTables(spark, folder)

    @property
    def _orders(self) -> DataFrame:
        return star_build.resolve_orders(self.raw["orders"], self.raw["customers"])

    @property
    def dim_customers(self) -> DataFrame:
        return star_build.dim_customers(self.raw["customers"])

    @property
    def dim_products(self) -> DataFrame:
        return star_build.dim_products(self.raw["products"], self.raw["product_category_translation"])

    @property
    def dim_sellers(self) -> DataFrame:
        return star_build.dim_sellers(self.raw["sellers"])

    @property
    def fact_orders(self) -> DataFrame:
        return star_build.fact_orders(self.raw["orders"], self.raw["customers"], self.raw["order_payments"])

    @property
    def fact_order_items(self) -> DataFrame:
        return star_build.fact_order_items(self.raw["order_items"], self._orders)

    @property
    def fact_reviews(self) -> DataFrame:
        return star_build.fact_reviews(self.raw["order_reviews"], self._orders)

    @property
    def fact_reviews_split(self) -> DataFrame:
        """Every review three times over, so that each pair is numbered as a hot group is."""
        once = self.raw["order_reviews"]
        return star_build.fact_reviews(once.unionByName(once).unionByName(once), self._orders, hot_rows=2)


def _over(build: Callable[[Tables], DataFrame]) -> Query:
    return lambda spark, folder: plain(build(Tables(spark, folder)))


def _plain_digits(column: str, kind: DecimalType) -> Column:
    """A decimal as text with all its places and no exponent, whatever the session's settings."""
    if kind.scale <= EXPONENT_FREE_PLACES:
        return F.col(column).cast("string")
    return F.call_function("format_number", F.col(column), F.lit(f"0.{'0' * kind.scale}"))


def _as_csv(df: DataFrame, label: str, **options: str | int) -> str:
    path = scratch_path(df.sparkSession, label)
    # The writer would put a zero of 18 places down as 0E-18, which the strict reader refuses.
    decimals = {f.name: _plain_digits(f.name, f.dataType) for f in df.schema if isinstance(f.dataType, DecimalType)}
    df = df.withColumns(decimals) if decimals else df
    df.write.options(**options).csv(path, header=True, escape='"', nullValue="", emptyValue='""', lineSep="\n")
    return path


def _csv_round_trip(table: str) -> Query:
    def query(spark: SparkSession, folder: str) -> DataFrame:
        return plain(read_raw_csv(spark, table, _as_csv(raw_table(spark, folder, table), table)))

    return query


def _counts(tables: dict[str, DataFrame]) -> DataFrame:
    counts = [df.agg(F.count(F.lit(1)).alias("rows")).withColumn("table_name", F.lit(t)) for t, df in tables.items()]
    return reduce(DataFrame.unionByName, counts)


@cache
def _loaded_root(spark: SparkSession, folder: str) -> str:
    """A raw layer that was loaded twice; the second load replaces the first. Shared by the queries of a session.

    Its inputs are files of its own: each is deleted when the second load has written its table.
    """
    raw, paths = RawTables(spark, folder), {}
    for table in raw:
        with tidied(spark):
            paths[table] = _as_csv(raw[table], table, **PACKED_CSV)
    root = scratch_path(spark, "raw-layer")
    load_raw(spark, paths, root)
    load_raw(spark, paths, root, done=lambda table: drop(spark, paths[table]))
    return root


@cache
def _published_root(spark: SparkSession, folder: str) -> str:
    """A published star, shared by the queries of a session."""
    root = scratch_path(spark, "star")
    publish(spark, RawTables(spark, folder), root)
    return root


def raw_reload(spark: SparkSession, folder: str) -> DataFrame:
    """Rows of the nine raw tables as a reader of the raw layer finds them."""
    return _counts(read_raw(spark, _loaded_root(spark, folder)))


def published_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Rows of the six tables as a reader of the published star finds them."""
    return _counts(read_star(spark, _published_root(spark, folder)))


@cache
def _in_one_folder(spark: SparkSession, folder: str, table: str) -> DataFrame:
    """A fact table of the published star written again without folders, shared by the queries of a session."""
    return layout.laid_out(read_star(spark, _published_root(spark, folder))[table])


def _stored(spark: SparkSession, folder: str, table: str, in_folders: bool) -> DataFrame:
    return read_star(spark, _published_root(spark, folder))[table] if in_folders else _in_one_folder(spark, folder, table)


def _lookup(by_status: bool) -> Query:
    return lambda spark, folder: plain(analyses.orders_with_status(_stored(spark, folder, "fact_orders", by_status)))


def lookup_manifest(spark: SparkSession, folder: str) -> DataFrame:
    """The lookup over the files that the manifest names."""
    orders = read_orders_of_status(spark, _published_root(spark, folder), fixed.CANCELED)
    return plain(analyses.orders_with_status(orders))


def _month_totals(by_month: bool) -> Query:
    return lambda spark, folder: plain(layout.month_totals(_stored(spark, folder, "fact_order_items", by_month), MONTHS))


def _published(table: str) -> Query:
    """A table of the published star, as its readers find it."""

    return lambda spark, folder: plain(read_star(spark, _published_root(spark, folder))[table])


def _reloaded(table: str) -> Query:
    """A table of the raw layer, as its readers find it."""
    return lambda spark, folder: plain(read_raw(spark, _loaded_root(spark, folder))[table])


def _checked(check: Callable[[RawTables, dict[str, DataFrame]], DataFrame]) -> Query:
    """A check of the published star, against the raw tables it was built from."""

    def query(spark: SparkSession, folder: str) -> DataFrame:
        return plain(check(RawTables(spark, folder), read_star(spark, _published_root(spark, folder))))

    return query


QUERIES: dict[str, Query] = {
    **{f"csv_{table}": _csv_round_trip(table) for table in RAW_DDL},
    "raw_reload": raw_reload,
    "published_counts": published_counts,
    "dim_customers": _over(lambda t: t.dim_customers),
    "dim_products": _over(lambda t: t.dim_products),
    "dim_sellers": _over(lambda t: t.dim_sellers),
    "payment_rollup": _over(lambda t: star_build.payment_rollup(t.raw["order_payments"])),
    "fact_orders": _over(lambda t: t.fact_orders),
    "fact_order_items": _over(lambda t: t.fact_order_items),
    "fact_reviews": _over(lambda t: t.fact_reviews),
    "fact_reviews_split": _over(lambda t: t.fact_reviews_split),
    "monthly_revenue": _over(lambda t: analyses.monthly_revenue(t.fact_order_items, t.fact_orders, MONTHS)),
    "cohort_retention": _over(lambda t: analyses.retention(t.fact_orders)),
    "top_sellers": _over(lambda t: analyses.top_sellers(t.fact_order_items, t.dim_products, t.fact_orders)),
    "late_rate": _over(lambda t: analyses.late_rate(t.fact_orders, t.dim_customers)),
    "rfm": _over(lambda t: analyses.rfm(t.fact_orders)),
    "review_delay": _over(lambda t: analyses.review_delay(t.fact_reviews)),
    "selective_lookup": _over(lambda t: analyses.orders_with_status(t.fact_orders)),
    "check_orphans": _checked(lambda raw, star: quality.orphans(star)),
    "check_raw_orphans": _over(lambda t: quality.raw_orphans(t.raw)),
    "check_pair_unique": _over(lambda t: quality.review_pairs_unique(t.raw["order_reviews"])),
    "check_midnight": _over(lambda t: quality.estimates_at_midnight(t.raw["orders"])),
    "check_zip": _over(lambda t: quality.zip_prefixes(t.dim_customers)),
    "check_reconcile": _checked(quality.reconciliation),
    "check_row_counts": _checked(quality.row_counts),
    "check_untranslated": _over(lambda t: quality.untranslated_categories(t.dim_products)),
    "check_out_of_window": _over(lambda t: quality.orders_outside_window(t.fact_orders, MONTHS)),
    "check_type1_cost": _over(lambda t: quality.cost_of_one_address(t.raw["customers"], "customer_city")),
    "check_primary_keys": _checked(lambda raw, star: quality.primary_keys(star)),
    "lookup_unpartitioned": _lookup(by_status=False),
    "lookup_partitioned": _lookup(by_status=True),
    "lookup_manifest": lookup_manifest,
    "month_window_unpartitioned": _month_totals(by_month=False),
    "month_window_partitioned": _month_totals(by_month=True),
    # The search for boundary rows, which larger tables than these need.
    "rfm_search": _over(lambda t: analyses.rfm(t.fact_orders, sample_rows=60, finish_rows=100)),
    **{f"published_{table}": _published(table) for table in STAR_TABLES},
    **{f"reloaded_{table}": _reloaded(table) for table in RAW_DDL},
}

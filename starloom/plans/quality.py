"""Read-only checks over raw tables and star.

An assertion is a row ``(check, metric, value, expected, ok)``; all assertions of a report are one
Spark job. Two further reports list rows and expect nothing. Whatever is a count or a sum over one table is a tally,
and all tallies of a table are taken in one scan of it, however many checks compare them. No check joins a fact row by
row: foreign keys are counted per value first, so that a value holding most of a table is one row at the join.
"""

from collections import ChainMap
from collections.abc import Iterable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from starloom.functions import fixed_values as fixed
from starloom.functions.measures import has_time_of_day
from starloom.sources.schemas import STAR_KEYS

Tables = Mapping[str, DataFrame]
AMOUNT = "decimal(38,2)"
KEY_CHECK = "primary_key"


# Check, metric, the tally (``<table>.<name>``) and the tally it must equal; without one it must be zero.
TALLIED = [
    ("orphans", "orders_no_customer", "fact_orders.nobody", None),
    ("orphans", "items_no_customer", "fact_order_items.nobody", None),
    ("orphans", "reviews_no_customer", "fact_reviews.nobody", None),
    ("review_pairs", "distinct_pairs", "order_reviews.pairs", "order_reviews.rows"),
    ("midnight", "estimates_with_time_of_day", "orders.timed", None),
    ("zip_prefix", "bad_zip_prefixes", "dim_customers.bad_zips", None),
    ("row_counts", "orders", "fact_orders.rows", "orders.rows"),
    ("row_counts", "people", "dim_customers.rows", "customers.people"),
    ("row_counts", "items", "fact_order_items.rows", "order_items.rows"),
    ("row_counts", "reviews", "fact_reviews.rows", "order_reviews.rows"),
]
# Metric, the raw amount and the one built from it: their difference must be zero.
RECONCILED = [
    ("payment_diff", "order_payments.paid", "fact_orders.paid"),
    ("item_diff", "order_items.sold", "fact_order_items.sold"),
]


def _tallies(table: str) -> dict[str, Column]:
    """Everything that one scan of ``table`` can count."""
    rows = F.count(F.lit(1))
    nobody = F.count_if(F.col("customer_unique_id").isNull())
    return {
        "orders": {"rows": rows, "timed": F.count_if(has_time_of_day(F.col("order_estimated_delivery_date")))},
        "customers": {"people": F.countDistinct("customer_unique_id")},
        "order_items": {"rows": rows, "sold": F.sum(F.col("price") + F.col("freight_value"))},
        "order_payments": {"paid": F.sum("payment_value")},
        # Pairs are compared as a struct, so a pair with a NULL in it is a pair as well.
        "order_reviews": {"rows": rows, "pairs": F.countDistinct(F.struct("review_id", "order_id"))},
        "dim_customers": {
            "rows": rows,
            "bad_zips": F.count_if(F.length("customer_zip_code_prefix") != fixed.ZIP_PREFIX_LENGTH),
        },
        "fact_orders": {"rows": rows, "nobody": nobody, "paid": F.sum("payment_total")},
        "fact_order_items": {"rows": rows, "nobody": nobody, "sold": F.sum("item_total_value")},
        "fact_reviews": {"rows": rows, "nobody": nobody},
    }[table]


def _tallied(tables: Tables, names: Iterable[str]) -> DataFrame:
    """One row with the map ``tally`` from the ``names`` to their values: a scan per table they are taken from."""
    by_table: dict[str, list[str]] = {}
    for table, name in sorted({tuple(name.split(".")) for name in names}):
        by_table.setdefault(table, []).append(name)
    counted = []
    for table, own in by_table.items():
        columns = _tallies(table)
        entries = [F.struct(F.lit(f"{table}.{n}").alias("name"), F.col(n).alias("value")) for n in own]
        one_row = tables[table].agg(*[columns[n].cast(AMOUNT).alias(n) for n in own])
        counted.append(one_row.select(F.inline(F.array(*entries))))
    return _all(counted).agg(F.map_from_entries(F.collect_list(F.struct("name", "value"))).alias("tally"))


def _asserted(check: str, metric: str, value: Column, expected: Column) -> Column:
    """An assertion as a struct."""
    value, expected = value.cast(AMOUNT), expected.cast(AMOUNT)
    return F.struct(
        F.lit(check).alias("check"),
        F.lit(metric).alias("metric"),
        value.alias("value"),
        expected.alias("expected"),
        value.eqNullSafe(expected).alias("ok"),
    )


def _compared(tables: Tables, *checks: str) -> DataFrame:
    """The assertions of ``checks`` that compare tallies."""
    chosen = [row for row in TALLIED if row[0] in checks]
    summed = RECONCILED if "reconcile" in checks else []
    names = {name for row in chosen for name in row[2:] if name} | {name for row in summed for name in row[1:]}

    def tally(name: str | None) -> Column:
        return F.col("tally")[name] if name else F.lit(0)

    def amount(name: str) -> Column:
        return F.coalesce(tally(name), F.lit(0))

    rows = [_asserted(check, metric, tally(value), tally(expected)) for check, metric, value, expected in chosen]
    rows += [_asserted("reconcile", metric, amount(raw) - amount(built), F.lit(0)) for metric, raw, built in summed]
    return _tallied(tables, names).select(F.inline(F.array(*rows)))


def _all(reports: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, reports)


def unmatched(child: DataFrame, parent: DataFrame, key: str) -> DataFrame:
    """One row ``n``: child rows whose ``key`` is NULL or missing from the parent."""
    per_value = child.groupBy(key).agg(F.count(F.lit(1)).alias("_rows"))
    orphans = per_value.join(parent.select(key), key, "left_anti")
    return orphans.agg(F.coalesce(F.sum("_rows"), F.lit(0)).alias("n"))


def _no_orphans(metric: str, child: DataFrame, parent: DataFrame, key: str) -> DataFrame:
    counted = unmatched(child, parent, key)
    return counted.select(F.inline(F.array(_asserted("orphans", metric, F.col("n"), F.lit(0)))))


def _unmatched_keys(star: Tables) -> DataFrame:
    items, reviews = star["fact_order_items"], star["fact_reviews"]
    return _all(
        [
            _no_orphans("items_no_product", items, star["dim_products"], "product_id"),
            _no_orphans("items_no_seller", items, star["dim_sellers"], "seller_id"),
            _no_orphans("reviews_no_order", reviews, star["fact_orders"], "order_id"),
        ]
    )


def orphans(star: Tables) -> DataFrame:
    return _unmatched_keys(star).unionByName(_compared(star, "orphans"))


def raw_orphans(raw: Tables) -> DataFrame:
    """Children the build drops or cannot attribute; looking only at the facts would never show them."""
    orders = raw["orders"]
    return _all(
        [
            _no_orphans("raw_orders_no_customer", orders, raw["customers"], "customer_id"),
            _no_orphans("raw_items_no_order", raw["order_items"], orders, "order_id"),
            _no_orphans("raw_payments_no_order", raw["order_payments"], orders, "order_id"),
            _no_orphans("raw_reviews_no_order", raw["order_reviews"], orders, "order_id"),
        ]
    )


def review_pairs_unique(reviews: DataFrame) -> DataFrame:
    return _compared({"order_reviews": reviews}, "review_pairs")


def estimates_at_midnight(orders: DataFrame) -> DataFrame:
    return _compared({"orders": orders}, "midnight")


def zip_prefixes(dim_customers: DataFrame) -> DataFrame:
    return _compared({"dim_customers": dim_customers}, "zip_prefix")


def reconciliation(raw: Tables, star: Tables) -> DataFrame:
    """Both revenue bases of the facts add up to the raw amounts, to the cent."""
    return _compared(ChainMap(star, raw), "reconcile")


def row_counts(raw: Tables, star: Tables) -> DataFrame:
    return _compared(ChainMap(star, raw), "row_counts")


def primary_keys(star: Tables) -> DataFrame:
    """Rows beyond the first of their key, and rows with a NULL in the key, per table."""
    return _all([_key_check(star[table], table, keys) for table, keys in STAR_KEYS.items() if table in star])


def _key_check(df: DataFrame, table: str, keys: Sequence[str]) -> DataFrame:
    per_key = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows"))
    has_null = reduce(Column.__or__, [F.col(k).isNull() for k in keys])
    counted = per_key.agg(
        F.coalesce(F.sum(F.col("_rows") - 1), F.lit(0)).alias("repeated"),
        F.coalesce(F.sum(F.when(has_null, F.col("_rows"))), F.lit(0)).alias("null_keys"),
    )
    metrics = F.explode(
        F.array(
            F.struct(F.lit(f"{table}_repeated").alias("metric"), F.col("repeated").alias("n")),
            F.struct(F.lit(f"{table}_null").alias("metric"), F.col("null_keys").alias("n")),
        )
    )
    return counted.select(metrics.alias("m")).select(
        F.lit(KEY_CHECK).alias("check"),
        F.col("m.metric").alias("metric"),
        F.col("m.n").cast(AMOUNT).alias("value"),
        F.lit(0).cast(AMOUNT).alias("expected"),
        (F.col("m.n") == 0).alias("ok"),
    )


def untranslated_categories(dim_products: DataFrame) -> DataFrame:
    missing = F.col("product_category_name").isNotNull() & F.col("product_category_name_english").isNull()
    return (
        dim_products.filter(missing)
        .groupBy("product_category_name")
        .agg(F.count(F.lit(1)).alias("products"))
        .orderBy("product_category_name")
    )


def orders_outside_window(
    fact_orders: DataFrame, months: tuple[str, str] = fixed.REVENUE_MONTHS
) -> DataFrame:
    first, last = (F.lit(m).cast("date") for m in months)
    month = F.col("purchase_month")
    return (
        fact_orders.filter((month < first) | (month > last))
        .groupBy("purchase_month")
        .agg(F.count(F.lit(1)).alias("orders"))
        .orderBy("purchase_month")
    )


def cost_of_one_address(customers: DataFrame, label: str = "customer_state") -> DataFrame:
    """People with several checkout ids, and those among them seen with more than one ``label``."""
    people = (
        customers.groupBy("customer_unique_id")
        .agg(F.count(F.lit(1)).alias("ids"), F.countDistinct(label).alias("labels"))
        .filter(F.col("ids") > 1)
    )
    return people.agg(
        F.count(F.lit(1)).alias("people_with_many_ids"),
        F.count_if(F.col("labels") > 1).alias(f"people_who_changed_{label.removeprefix('customer_')}"),
    )


def informative_checks(raw: Tables, star: Tables) -> DataFrame:
    """Every assertion but the keys. All tallies of a table come from one scan, those of several checks too."""
    checks = dict.fromkeys(check for check, *_ in TALLIED)
    compared = _compared(ChainMap(star, raw), *checks, "reconcile")
    return _all([_unmatched_keys(star), raw_orphans(raw), compared])


def quality_report(raw: Tables, star: Tables) -> DataFrame:
    return primary_keys(star).unionByName(informative_checks(raw, star))

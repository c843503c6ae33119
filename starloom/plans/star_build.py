"""Three dimensions and three facts from the nine raw tables. All rows of all statuses are kept.

Every table is a pure function of the raw tables, so building twice gives the same star.
"""

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from starloom.functions import measures
from starloom.operators.keep_first import keep_first
from starloom.operators.numbering import HOT_GROUP_ROWS, cell, one_by_one, packed, runs_in_cells, same_key
from starloom.scratch import staged
from starloom.sources.schemas import shaped, star_schema

ORDER_CONTEXT = (
    "order_id",
    "customer_unique_id",
    "order_purchase_timestamp",
    "order_delivered_customer_date",
    "order_estimated_delivery_date",
)
REVIEW_KEYS = ("review_id", "order_id")


def dim_customers(customers: DataFrame) -> DataFrame:
    """One row per person: the row of their smallest checkout id."""
    kept = keep_first(customers, ["customer_unique_id"], ["customer_id"])
    return shaped(kept, star_schema("dim_customers"))


def dim_products(products: DataFrame, translation: DataFrame) -> DataFrame:
    """Products with their English category, if there is one, and corrected column names."""
    named = products.withColumnsRenamed(
        {
            "product_name_lenght": "product_name_length",
            "product_description_lenght": "product_description_length",
        }
    )
    return shaped(named.join(translation, "product_category_name", "left"), star_schema("dim_products"))


def dim_sellers(sellers: DataFrame) -> DataFrame:
    return shaped(sellers, star_schema("dim_sellers"))


def payment_rollup(payments: DataFrame) -> DataFrame:
    return payments.groupBy("order_id").agg(
        F.sum("payment_value").alias("payment_total"),
        F.count(F.lit(1)).alias("payment_count"),
        F.max("payment_installments").alias("max_payment_installments"),
    )


def resolve_orders(orders: DataFrame, customers: DataFrame) -> DataFrame:
    """Orders with the person behind the checkout id; NULL when the checkout id is unknown."""
    return orders.join(customers.select("customer_id", "customer_unique_id"), "customer_id", "left")


def fact_orders(orders: DataFrame, customers: DataFrame, payments: DataFrame) -> DataFrame:
    bought = F.col("order_purchase_timestamp")
    delivered = F.col("order_delivered_customer_date")
    promised = F.col("order_estimated_delivery_date")
    facts = (
        resolve_orders(orders, customers)
        .join(payment_rollup(payments), "order_id", "left")
        .withColumns(
            {
                "purchase_date": measures.calendar_day(bought),
                "purchase_month": measures.month_start(bought),
                "delivery_days": measures.elapsed_days(bought, delivered),
                "estimated_delivery_days": measures.elapsed_days(bought, promised),
                "late_delivery_days": measures.days_late(delivered, promised),
                "is_delivered_late": measures.is_late(delivered, promised),
            }
        )
    )
    return shaped(facts, star_schema("fact_orders"))


def fact_order_items(items: DataFrame, orders: DataFrame) -> DataFrame:
    """Items of known orders. ``orders`` is ``resolve_orders(...)`` or, just as good, ``fact_orders``."""
    context = orders.select("order_id", "customer_unique_id", "order_purchase_timestamp")
    bought = F.col("order_purchase_timestamp")
    facts = items.join(context, "order_id").withColumns(
        {
            "purchase_date": measures.calendar_day(bought),
            "purchase_month": measures.month_start(bought),
            "item_total_value": F.col("price") + F.col("freight_value"),
        }
    )
    return shaped(facts, star_schema("fact_order_items"))


def review_copies(reviews: DataFrame, hot_rows: int = HOT_GROUP_ROWS) -> DataFrame:
    """Reviews as runs: ``_run`` exact copies whose positions among the rows of their (review, order) pair begin at ``_first``.

    The pair is nearly always unique, so only repeated pairs are numbered. They are written out first:
    their true size then lets the planner broadcast them and leave the review texts where they are. Where they are most
    of the table, the texts move anyhow; exact copies are then packed before they are joined with the sizes of their pairs.
    """
    columns = reviews.columns
    pairs = reviews.groupBy(*REVIEW_KEYS).agg(F.count(F.lit(1)).alias("_rows")).filter(F.col("_rows") > 1)
    repeated = staged(pairs.select(*[F.col(k).alias("_dup_" + k) for k in REVIEW_KEYS], "_rows"), "repeated-pairs")
    one = F.lit(1).cast("long")
    if repeated.isEmpty():
        return reviews.withColumns({"_first": one, "_run": one})
    spread = F.xxhash64(*columns)
    in_cell = cell(spread, hot_rows)
    if 2 * repeated.agg(F.sum("_rows")).head()[0] > reviews.count():
        copies = packed(reviews)
        sized = copies.join(repeated, same_key(copies, repeated, REVIEW_KEYS, "_dup_"), "left")
        return runs_in_cells(sized.select(*columns, "_copies", in_cell), REVIEW_KEYS, spread)
    matches = same_key(reviews, repeated, REVIEW_KEYS, "_dup_")
    single = reviews.join(repeated, matches, "left_anti").withColumns({"_first": one, "_run": one})
    several = packed(reviews.join(repeated, matches).select(*columns, in_cell))
    return single.unionByName(runs_in_cells(several, REVIEW_KEYS, spread))


def fact_reviews(reviews: DataFrame, orders: DataFrame, hot_rows: int = HOT_GROUP_ROWS) -> DataFrame:
    """Reviews of known orders. The surrogate key is a hash of the row's identity, stable over rebuilds."""
    delivered = F.col("order_delivered_customer_date")
    promised = F.col("order_estimated_delivery_date")
    identity = F.to_json(F.struct(*REVIEW_KEYS, "copy"))
    known = review_copies(reviews, hot_rows).join(orders.select(*ORDER_CONTEXT), "order_id")
    facts = one_by_one(known, "copy").withColumns(
        {
            "review_sk": F.sha2(identity, 256),
            "delivery_delay_days": measures.days_late(delivered, promised),
            "is_delivered_late": measures.is_late(delivered, promised),
        }
    )
    return shaped(facts, star_schema("fact_reviews"))


def build_star(raw: Mapping[str, DataFrame]) -> dict[str, DataFrame]:
    """The whole star, lazily. ``publish`` writes it without repeating the orders-customers join."""
    resolved = resolve_orders(raw["orders"], raw["customers"])
    return {
        "dim_customers": dim_customers(raw["customers"]),
        "dim_products": dim_products(raw["products"], raw["product_category_translation"]),
        "dim_sellers": dim_sellers(raw["sellers"]),
        "fact_orders": fact_orders(raw["orders"], raw["customers"], raw["order_payments"]),
        "fact_order_items": fact_order_items(raw["order_items"], resolved),
        "fact_reviews": fact_reviews(raw["order_reviews"], resolved),
    }

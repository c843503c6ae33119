"""The business questions, asked of the star."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from starloom.functions import fixed_values as fixed
from starloom.functions.status import earns_no_revenue, earns_revenue, is_delivered
from starloom.operators.cohort import cohort_retention
from starloom.operators.growth import period_growth, within
from starloom.operators.quantiles import FINISH_ROWS, SAMPLE_ROWS, ntile_columns
from starloom.operators.rates import banded_average, rate_by_dimension
from starloom.operators.top_k import top_k_per_group


def monthly_revenue(
    fact_order_items: DataFrame,
    fact_orders: DataFrame,
    months: tuple[str, str] | None = fixed.REVENUE_MONTHS,
) -> DataFrame:
    """Revenue per purchase month with its change and three-month average.

    Items are summed per order first. The sum is already partitioned the way the join wants it, so the
    items cross the network once, reduced, and an order of any size is one row at the join. The star holds items of
    known orders only, so the few orders that earn nothing are taken out; the many others are not read.
    """
    month = F.col("purchase_month")
    in_window = fact_order_items.filter(within(month, months))
    per_order = in_window.groupBy("order_id").agg(
        F.sum("item_total_value").alias("value"), F.min(month).alias("_month"), F.max(month).alias("_last")
    )
    # The month is copied from the order when the star is built; two months in one order mean damage.
    one_month = F.when(
        F.col("_month").eqNullSafe(F.col("_last")), F.col("_month")
    ).otherwise(F.raise_error(F.lit("items of one order carry different purchase months")))
    dated = per_order.select("order_id", "value", one_month.alias("purchase_month"))
    revenue = dated.join(_earning_nothing(fact_orders), "order_id", "left_anti")
    growth = period_growth(revenue, "purchase_month", "value")
    return growth.withColumnsRenamed(
        {"total": "monthly_revenue", "change_pct": "mom_change_pct", "moving_avg": "moving_avg_3mo"}
    )


def _earning_nothing(fact_orders: DataFrame) -> DataFrame:
    """Ids of the orders that do not count as revenue: a few folders of the published layout."""
    return fact_orders.filter(earns_no_revenue(F.col("order_status"))).select("order_id")


def retention(fact_orders: DataFrame) -> DataFrame:
    """Share of each monthly cohort ordering again N months later, over orders of every status."""
    return cohort_retention(fact_orders, "customer_unique_id", "purchase_month").withColumnRenamed(
        "retained", "retained_customers"
    )


def category_label() -> Column:
    return F.coalesce(
        "product_category_name_english", "product_category_name", F.lit(fixed.NO_CATEGORY)
    )


def top_sellers(
    fact_order_items: DataFrame, dim_products: DataFrame, fact_orders: DataFrame, k: int = 3
) -> DataFrame:
    """The ``k`` best sellers of every category, ties included.

    Value is summed per (product, seller) before products are joined, so a bestseller is a handful of
    rows by the time its category is looked up. Items lose the few orders that earn nothing; the star holds
    items of known orders only, so the many others are not read, and items move by (product, seller) alone
    unless those few are too many to broadcast.
    """
    sold = (
        fact_order_items.join(_earning_nothing(fact_orders), "order_id", "left_anti")
        .groupBy("product_id", "seller_id")
        .agg(F.sum("item_total_value").alias("value"))
    )
    categories = dim_products.select("product_id", category_label().alias("category"))
    totals = (
        sold.join(categories, "product_id")
        .groupBy("category", "seller_id")
        .agg(F.sum("value").alias("total_sold"))
    )
    best = top_k_per_group(totals, "category", "seller_id", "total_sold", k)
    return best.select(
        "category", "seller_id", F.round("total_sold", 2).alias("total_sold"), F.col("rank").alias("the_rank")
    ).orderBy("category", "the_rank", "seller_id")


def late_rate(fact_orders: DataFrame, dim_customers: DataFrame, label: str = "customer_state") -> DataFrame:
    """Late share of delivered orders per customer state."""
    delivered = fact_orders.filter(is_delivered(F.col("order_status")))
    rates = rate_by_dimension(
        delivered, dim_customers, "customer_unique_id", label, F.col("is_delivered_late")
    )
    return rates.select(label, F.col("rate_pct").alias("late_pct"))


def rfm(
    fact_orders: DataFrame,
    buckets: int = 4,
    sample_rows: int = SAMPLE_ROWS,
    finish_rows: int = FINISH_ROWS,
) -> DataFrame:
    """Recency, frequency and monetary value of each person with a 1..``buckets`` score for each.

    The most recent, most frequent and best paying score highest; the person id breaks every tie.
    """
    user = F.col("customer_unique_id")
    people = (
        fact_orders.filter(earns_revenue(F.col("order_status")))
        .groupBy(user)
        .agg(
            F.max("purchase_date").alias("last_order"),
            F.count(F.lit(1)).alias("total_orders"),
            F.coalesce(F.sum("payment_total"), F.lit(0)).cast("decimal(38,2)").alias("total_payment"),
        )
        .withColumn("_unnamed", user.isNull())
    )
    tiebreak = ["_unnamed", "customer_unique_id"]
    # Latest order ascending is recency in days descending, so the oldest come first.
    scored = ntile_columns(
        people,
        {
            "r_score": ["last_order", *tiebreak],
            "f_score": ["total_orders", *tiebreak],
            "m_score": ["total_payment", *tiebreak],
        },
        buckets,
        sample_rows,
        finish_rows,
    )
    # The sort below ends with the tiebreak too: people who paid nothing may be many, and ranges of equal
    # amounts can only be cut by something that differs.
    snapshot = scored.agg(F.date_add(F.max("last_order"), 1)).scalar()
    return scored.select(
        user,
        F.datediff(snapshot, F.col("last_order")).alias("recency_days"),
        "total_orders",
        "total_payment",
        "r_score",
        "f_score",
        "m_score",
    ).orderBy(F.col("total_payment").desc_nulls_first(), *tiebreak)


def review_delay(fact_reviews: DataFrame) -> DataFrame:
    """Average review score by how late the order arrived; reviews of undelivered orders are left out."""
    delay = F.col("delivery_delay_days")
    bands = [
        (delay < 0, fixed.DELAY_EARLY),
        (delay == 0, fixed.DELAY_ON_DAY),
        (delay <= fixed.DELAY_SHORT_MAX_DAYS, fixed.DELAY_SHORT),
    ]
    averages = banded_average(
        fact_reviews.filter(delay.isNotNull()), bands, fixed.DELAY_LONG, "review_score"
    )
    return averages.withColumnsRenamed(
        {"band": "delay_bucket", "rows": "reviews", "avg_value": "avg_score"}
    )


def orders_with_status(fact_orders: DataFrame, status: str = fixed.CANCELED) -> DataFrame:
    """Selective lookup; on the published layout it reads the one partition of that status."""
    return fact_orders.filter(F.col("order_status") == status).select(
        "order_id", "customer_unique_id", "payment_total"
    )

"""Raw-shaped tables derived from the TPC-H-like test tables.

Stand-ins for the nine input files: same columns and types, same quirks (one checkout id per order,
untranslated and missing categories, unavailable orders and orders without a status, orders without payments, review ids shared by two orders).
"""

from collections.abc import Callable, Iterator, Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from starloom.operators.numbering import number_within
from starloom.sources.schemas import MONEY, RAW_DDL, raw_schema, shaped

LINE_SPREAD_BITS = 32
UNTRANSLATED = ("LARGE", "SMALL")


def _zip(key: str) -> Column:
    return F.lpad((F.col(key) % 100000).cast("string"), 5, "0")


def _plus(ts: Column, unit: str, amount: Column | int) -> Column:
    return F.timestamp_add(unit, F.lit(amount) if isinstance(amount, int) else amount, ts)


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _nation_names(spark: SparkSession, folder: str) -> DataFrame:
    return _table(spark, folder, "nation").select("n_nationkey", "n_name")


def customers(spark: SparkSession, folder: str) -> DataFrame:
    nations = _nation_names(spark, folder)
    people = _table(spark, folder, "customer").select("c_custkey", "c_nationkey")
    people = people.join(nations, F.col("c_nationkey") == F.col("n_nationkey"), "left")
    orders = _table(spark, folder, "orders")
    return orders.join(people, F.col("o_custkey") == F.col("c_custkey"), "left").select(
        F.col("o_orderkey").alias("customer_id"),
        F.col("o_custkey").alias("customer_unique_id"),
        _zip("o_custkey").alias("customer_zip_code_prefix"),
        F.col("o_orderpriority").alias("customer_city"),
        F.col("n_name").alias("customer_state"),
    )


def geolocation(spark: SparkSession, folder: str) -> DataFrame:
    people = _table(spark, folder, "customer")
    nations = _nation_names(spark, folder)
    balance = F.col("c_acctbal").cast(MONEY)
    return people.join(nations, F.col("c_nationkey") == F.col("n_nationkey"), "left").select(
        _zip("c_custkey").alias("geolocation_zip_code_prefix"),
        balance.alias("geolocation_lat"),
        (-balance).alias("geolocation_lng"),
        F.col("c_name").alias("geolocation_city"),
        F.col("n_name").alias("geolocation_state"),
    )


def sellers(spark: SparkSession, folder: str) -> DataFrame:
    suppliers = _table(spark, folder, "supplier")
    nations = _nation_names(spark, folder)
    return suppliers.join(nations, F.col("s_nationkey") == F.col("n_nationkey"), "left").select(
        F.col("s_suppkey").alias("seller_id"),
        _zip("s_suppkey").alias("seller_zip_code_prefix"),
        F.col("s_name").alias("seller_city"),
        F.col("n_name").alias("seller_state"),
    )


def products(spark: SparkSession, folder: str) -> DataFrame:
    size = F.col("p_size")
    return _table(spark, folder, "part").select(
        F.col("p_partkey").alias("product_id"),
        F.when(F.col("p_brand") != "Brand#1", F.col("p_type")).alias("product_category_name"),
        F.length("p_name").alias("product_name_lenght"),
        (size * 10).alias("product_description_lenght"),
        (size % 6).alias("product_photos_qty"),
        (size * 100).alias("product_weight_g"),
        (size + 10).alias("product_length_cm"),
        (size + 5).alias("product_height_cm"),
        (size + 8).alias("product_width_cm"),
    )


def product_category_translation(spark: SparkSession, folder: str) -> DataFrame:
    kinds = _table(spark, folder, "part").select("p_type").distinct()
    return kinds.filter(~F.col("p_type").isin(*UNTRANSLATED)).select(
        F.col("p_type").alias("product_category_name"),
        F.concat(F.lower("p_type"), F.lit("_goods")).alias("product_category_name_english"),
    )


def orders(spark: SparkSession, folder: str) -> DataFrame:
    day = F.col("o_orderdate").cast("timestamp_ntz")
    key = F.col("o_orderkey")
    bought = _plus(day, "SECOND", (key * 7919) % 86400)
    status = F.col("o_orderstatus")
    return _table(spark, folder, "orders").select(
        key.alias("order_id"),
        key.alias("customer_id"),
        F.when(key % 97 == 5, "unavailable")
        .when(key % 101 == 7, F.lit(None))
        .when(status == "F", "delivered")
        .when(status == "O", "shipped")
        .when(status == "P", "canceled")
        .alias("order_status"),
        bought.alias("order_purchase_timestamp"),
        _plus(bought, "HOUR", 1).alias("order_approved_at"),
        _plus(bought, "DAY", 2).alias("order_delivered_carrier_date"),
        F.when(status == "F", _plus(bought, "DAY", (key * 31) % 40)).alias(
            "order_delivered_customer_date"
        ),
        _plus(day, "DAY", 25).alias("order_estimated_delivery_date"),
    )


def order_items(spark: SparkSession, folder: str) -> DataFrame:
    # Keys are text from here on: a join by order then finds the lines where their numbering has put them.
    lines = _table(spark, folder, "lineitem").withColumn("l_orderkey", F.col("l_orderkey").cast("string"))
    mixed = (F.col("l_partkey") * 31 + F.col("l_suppkey") * 17 + F.col("l_linenumber")) % (1 << 31)
    spread = (mixed * 2654435761) % (1 << LINE_SPREAD_BITS)
    lines = number_within(lines, ["l_orderkey"], spread, "line_ordinal", spread_bits=LINE_SPREAD_BITS)
    price = F.col("l_extendedprice").cast(MONEY)
    return lines.select(
        F.col("l_orderkey").alias("order_id"),
        F.col("line_ordinal").alias("order_item_id"),
        F.col("l_partkey").alias("product_id"),
        F.col("l_suppkey").alias("seller_id"),
        F.col("l_shipdate").alias("shipping_limit_date"),
        price.alias("price"),
        F.round(price * F.col("l_tax").cast("decimal(4,2)"), 2).alias("freight_value"),
    )


def order_payments(spark: SparkSession, folder: str) -> DataFrame:
    return _table(spark, folder, "lineitem").select(
        F.col("l_orderkey").alias("order_id"),
        F.col("l_linenumber").alias("payment_sequential"),
        F.col("l_returnflag").alias("payment_type"),
        F.col("l_quantity").alias("payment_installments"),
        F.col("l_extendedprice").alias("payment_value"),
    )


def order_reviews(spark: SparkSession, folder: str) -> DataFrame:
    key = F.col("o_orderkey")
    asked = _plus(F.col("o_orderdate").cast("timestamp_ntz"), "DAY", 30)
    words = F.col("o_orderpriority")
    return _table(spark, folder, "orders").select(
        F.call_function("div", key, F.lit(2)).alias("review_id"),
        key.alias("order_id"),
        (F.lit(1) + (key * 13 + F.col("o_custkey")) % 5).alias("review_score"),
        F.when(F.col("o_orderstatus") == "P", "").alias("review_comment_title"),
        F.when(F.col("o_orderstatus") == "F", F.concat(F.lit('said "fine",\nthen: '), words))
        .when(F.col("o_orderstatus") == "O", words)
        .alias("review_comment_message"),
        asked.alias("review_creation_date"),
        _plus(asked, "SECOND", (key * 104729) % 172800).alias("review_answer_timestamp"),
    )


BUILDERS: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "customers": customers,
    "geolocation": geolocation,
    "sellers": sellers,
    "products": products,
    "orders": orders,
    "order_items": order_items,
    "order_payments": order_payments,
    "order_reviews": order_reviews,
    "product_category_translation": product_category_translation,
}


def raw_table(spark: SparkSession, folder: str, table: str) -> DataFrame:
    return shaped(BUILDERS[table](spark, folder), raw_schema(table))


class RawTables(Mapping[str, DataFrame]):
    """All nine tables; each is put together, and its inputs are looked at, when first asked for."""

    def __init__(self, spark: SparkSession, folder: str):
        self._spark, self._folder = spark, folder
        self._built: dict[str, DataFrame] = {}

    def __getitem__(self, table: str) -> DataFrame:
        if table not in self._built:
            self._built[table] = raw_table(self._spark, self._folder, table)
        return self._built[table]

    def __iter__(self) -> Iterator[str]:
        return iter(RAW_DDL)

    def __len__(self) -> int:
        return len(RAW_DDL)

"""Declared schemas. Nothing is ever inferred: zip prefixes would turn into integers."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

# Amounts of this precision are plain 64-bit integers to Parquet and Spark; a larger one fails its cast.
MONEY = "decimal(18,2)"
MONEY_SUM = "decimal(28,2)"
DEGREES = "decimal(38,18)"

# Column names, order and types of the input files, which bind by position.
RAW_DDL = {
    "customers": """
        customer_id string, customer_unique_id string, customer_zip_code_prefix string,
        customer_city string, customer_state string""",
    "geolocation": f"""
        geolocation_zip_code_prefix string, geolocation_lat {DEGREES}, geolocation_lng {DEGREES},
        geolocation_city string, geolocation_state string""",
    "sellers": """
        seller_id string, seller_zip_code_prefix string, seller_city string, seller_state string""",
    "products": """
        product_id string, product_category_name string, product_name_lenght int,
        product_description_lenght int, product_photos_qty int, product_weight_g int,
        product_length_cm int, product_height_cm int, product_width_cm int""",
    "orders": """
        order_id string, customer_id string, order_status string,
        order_purchase_timestamp timestamp_ntz, order_approved_at timestamp_ntz,
        order_delivered_carrier_date timestamp_ntz, order_delivered_customer_date timestamp_ntz,
        order_estimated_delivery_date timestamp_ntz""",
    "order_items": f"""
        order_id string, order_item_id int, product_id string, seller_id string,
        shipping_limit_date timestamp_ntz, price {MONEY}, freight_value {MONEY}""",
    "order_payments": f"""
        order_id string, payment_sequential int, payment_type string, payment_installments int,
        payment_value {MONEY}""",
    "order_reviews": """
        review_id string, order_id string, review_score int, review_comment_title string,
        review_comment_message string, review_creation_date timestamp_ntz,
        review_answer_timestamp timestamp_ntz""",
    "product_category_translation": """
        product_category_name string, product_category_name_english string""",
}

# Column names, order and types of the published star.
STAR_DDL = {
    "dim_customers": """
        customer_unique_id string, customer_zip_code_prefix string, customer_city string,
        customer_state string""",
    "dim_products": """
        product_id string, product_category_name string, product_category_name_english string,
        product_name_length int, product_description_length int, product_photos_qty int,
        product_weight_g int, product_length_cm int, product_height_cm int, product_width_cm int""",
    "dim_sellers": """
        seller_id string, seller_zip_code_prefix string, seller_city string, seller_state string""",
    "fact_orders": f"""
        order_id string, customer_id string, customer_unique_id string, order_status string,
        order_purchase_timestamp timestamp_ntz, purchase_date date, purchase_month date,
        order_approved_at timestamp_ntz, order_delivered_carrier_date timestamp_ntz,
        order_delivered_customer_date timestamp_ntz, order_estimated_delivery_date timestamp_ntz,
        delivery_days decimal(12,2), estimated_delivery_days decimal(12,2), late_delivery_days int,
        is_delivered_late boolean, payment_total {MONEY_SUM}, payment_count long,
        max_payment_installments int""",
    "fact_order_items": f"""
        order_id string, order_item_id int, product_id string, seller_id string,
        customer_unique_id string, order_purchase_timestamp timestamp_ntz, purchase_date date,
        purchase_month date, shipping_limit_date timestamp_ntz, price {MONEY},
        freight_value {MONEY}, item_total_value {MONEY}""",
    "fact_reviews": """
        review_sk string, review_id string, order_id string, customer_unique_id string,
        review_score int, review_comment_title string, review_comment_message string,
        review_creation_date timestamp_ntz, review_answer_timestamp timestamp_ntz,
        order_purchase_timestamp timestamp_ntz, order_delivered_customer_date timestamp_ntz,
        order_estimated_delivery_date timestamp_ntz, delivery_delay_days int,
        is_delivered_late boolean""",
}

STAR_KEYS = {
    "dim_customers": ("customer_unique_id",),
    "dim_products": ("product_id",),
    "dim_sellers": ("seller_id",),
    "fact_orders": ("order_id",),
    "fact_order_items": ("order_id", "order_item_id"),
    "fact_reviews": ("review_sk",),
}


def raw_schema(table: str) -> StructType:
    return StructType.fromDDL(RAW_DDL[table])


def star_schema(table: str) -> StructType:
    return StructType.fromDDL(STAR_DDL[table])


def shaped(df: DataFrame, schema: StructType) -> DataFrame:
    """Exactly the declared columns, in order and cast to the declared types."""
    return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema])

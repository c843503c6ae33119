"""The same questions in SQL for DuckDB, written independently of the Spark plans.

Ratios are taken over integers on both sides: DuckDB divides decimals as doubles, whose rounding differs.
"""

from starloom.functions import fixed_values as fixed
from starloom.sources.conform import UNTRANSLATED
from starloom.verification.queries import MONTHS

MONEY = "DECIMAL(18,2)"
DAY_MICROS = 86_400_000_000


def _quoted(values: tuple[str, ...]) -> str:
    return ", ".join(f"'{v}'" for v in values)


def _places(top: str, bottom: str) -> str:
    """Non-negative ``top / bottom`` rounded half up to hundredths; ``top`` already counts hundredths."""
    return f"((2 * CAST({top} AS HUGEINT) + {bottom}) // (2 * {bottom}))"


def _days(start: str, end: str) -> str:
    micros = f"(epoch_us({end}) - epoch_us({start}))"
    return f"CAST({_places(f'{micros} * 100', str(DAY_MICROS))} AS DOUBLE) / 100"


def _zip(key: str) -> str:
    return f"lpad(CAST({key} % 100000 AS VARCHAR), 5, '0')"


BOUGHT = "(o_orderdate + to_seconds((o_orderkey * 7919) % 86400))"
LINE_ORDER = """((l_partkey * 31 + l_suppkey * 17 + l_linenumber) % 2147483648) * 2654435761 % 4294967296, l_orderkey, l_partkey,
    l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus,
    l_shipdate"""

# Common table expressions, each listed after those it reads.
VIEWS = {
    "r_customers": f"""
        SELECT CAST(o_orderkey AS VARCHAR) AS customer_id, CAST(o_custkey AS VARCHAR) AS customer_unique_id,
            {_zip('o_custkey')} AS customer_zip_code_prefix, o_orderpriority AS customer_city,
            n_name AS customer_state
        FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey""",
    "r_geolocation": f"""
        SELECT {_zip('c_custkey')} AS geolocation_zip_code_prefix,
            CAST(CAST(c_acctbal AS {MONEY}) AS DOUBLE) AS geolocation_lat,
            CAST(-CAST(c_acctbal AS {MONEY}) AS DOUBLE) AS geolocation_lng,
            c_name AS geolocation_city, n_name AS geolocation_state
        FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey""",
    "r_sellers": f"""
        SELECT CAST(s_suppkey AS VARCHAR) AS seller_id, {_zip('s_suppkey')} AS seller_zip_code_prefix,
            s_name AS seller_city, n_name AS seller_state
        FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey""",
    "r_products": """
        SELECT CAST(p_partkey AS VARCHAR) AS product_id,
            CASE WHEN p_brand <> 'Brand#1' THEN p_type END AS product_category_name,
            length(p_name) AS product_name_lenght, p_size * 10 AS product_description_lenght,
            p_size % 6 AS product_photos_qty, p_size * 100 AS product_weight_g,
            p_size + 10 AS product_length_cm, p_size + 5 AS product_height_cm, p_size + 8 AS product_width_cm
        FROM part""",
    "r_product_category_translation": f"""
        SELECT DISTINCT p_type AS product_category_name,
            lower(p_type) || '_goods' AS product_category_name_english
        FROM part WHERE p_type NOT IN ({_quoted(UNTRANSLATED)})""",
    "r_orders": f"""
        SELECT CAST(o_orderkey AS VARCHAR) AS order_id, CAST(o_orderkey AS VARCHAR) AS customer_id,
            CASE WHEN o_orderkey % 97 = 5 THEN 'unavailable' WHEN o_orderkey % 101 = 7 THEN NULL
                WHEN o_orderstatus = 'F' THEN 'delivered' WHEN o_orderstatus = 'O' THEN 'shipped'
                WHEN o_orderstatus = 'P' THEN 'canceled' END AS order_status,
            {BOUGHT} AS order_purchase_timestamp,
            {BOUGHT} + to_hours(1) AS order_approved_at,
            {BOUGHT} + to_days(2) AS order_delivered_carrier_date,
            CASE WHEN o_orderstatus = 'F' THEN {BOUGHT} + to_days(CAST((o_orderkey * 31) % 40 AS INTEGER)) END
                AS order_delivered_customer_date,
            o_orderdate + to_days(25) AS order_estimated_delivery_date
        FROM orders""",
    "r_order_items": f"""
        SELECT CAST(l_orderkey AS VARCHAR) AS order_id,
            row_number() OVER (PARTITION BY l_orderkey ORDER BY {LINE_ORDER}) AS order_item_id,
            CAST(l_partkey AS VARCHAR) AS product_id, CAST(l_suppkey AS VARCHAR) AS seller_id,
            l_shipdate AS shipping_limit_date, CAST(l_extendedprice AS {MONEY}) AS price,
            CAST(round(CAST(l_extendedprice AS {MONEY}) * CAST(l_tax AS DECIMAL(4,2)), 2) AS {MONEY})
                AS freight_value
        FROM lineitem""",
    "r_order_payments": f"""
        SELECT CAST(l_orderkey AS VARCHAR) AS order_id, l_linenumber AS payment_sequential,
            l_returnflag AS payment_type, CAST(l_quantity AS INTEGER) AS payment_installments,
            CAST(l_extendedprice AS {MONEY}) AS payment_value
        FROM lineitem""",
    "r_order_reviews": """
        SELECT CAST(o_orderkey // 2 AS VARCHAR) AS review_id, CAST(o_orderkey AS VARCHAR) AS order_id,
            1 + (o_orderkey * 13 + o_custkey) % 5 AS review_score,
            CASE WHEN o_orderstatus = 'P' THEN '' END AS review_comment_title,
            CASE o_orderstatus WHEN 'F' THEN 'said "fine",' || chr(10) || 'then: ' || o_orderpriority
                WHEN 'O' THEN o_orderpriority END AS review_comment_message,
            o_orderdate + to_days(30) AS review_creation_date,
            o_orderdate + to_days(30) + to_seconds((o_orderkey * 104729) % 172800) AS review_answer_timestamp
        FROM orders""",
    "dim_customers": """
        SELECT DISTINCT ON (customer_unique_id) customer_unique_id, customer_zip_code_prefix, customer_city,
            customer_state
        FROM r_customers ORDER BY customer_unique_id, customer_id NULLS LAST""",
    "dim_products": """
        SELECT product_id, p.product_category_name, product_category_name_english,
            product_name_lenght AS product_name_length,
            product_description_lenght AS product_description_length,
            product_photos_qty, product_weight_g, product_length_cm, product_height_cm, product_width_cm
        FROM r_products p
        LEFT JOIN r_product_category_translation t ON p.product_category_name = t.product_category_name""",
    "dim_sellers": "SELECT * FROM r_sellers",
    "rollup": """
        SELECT order_id, sum(payment_value) AS payment_total, count(*) AS payment_count,
            max(payment_installments) AS max_payment_installments
        FROM r_order_payments GROUP BY order_id""",
    "fact_orders": f"""
        SELECT o.*, c.customer_unique_id, CAST(order_purchase_timestamp AS DATE) AS purchase_date,
            CAST(date_trunc('month', order_purchase_timestamp) AS DATE) AS purchase_month,
            {_days('order_purchase_timestamp', 'order_delivered_customer_date')} AS delivery_days,
            {_days('order_purchase_timestamp', 'order_estimated_delivery_date')} AS estimated_delivery_days,
            date_diff('day', CAST(order_estimated_delivery_date AS DATE),
                CAST(order_delivered_customer_date AS DATE)) AS late_delivery_days,
            CAST(order_delivered_customer_date AS DATE) > CAST(order_estimated_delivery_date AS DATE)
                AS is_delivered_late,
            payment_total, payment_count, max_payment_installments
        FROM r_orders o LEFT JOIN r_customers c ON o.customer_id = c.customer_id
        LEFT JOIN rollup r ON o.order_id = r.order_id""",
    "fact_order_items": """
        SELECT i.*, o.customer_unique_id, o.order_purchase_timestamp, o.purchase_date, o.purchase_month,
            price + freight_value AS item_total_value
        FROM r_order_items i JOIN fact_orders o ON i.order_id = o.order_id""",
    "fact_reviews": """
        SELECT sha256('{"review_id":"' || review_id || '","order_id":"' || r.order_id || '","copy":'
                || row_number() OVER (PARTITION BY review_id, r.order_id) || '}') AS review_sk,
            r.*, o.customer_unique_id, o.order_purchase_timestamp, o.order_delivered_customer_date,
            o.order_estimated_delivery_date, o.late_delivery_days AS delivery_delay_days, o.is_delivered_late
        FROM r_order_reviews r JOIN fact_orders o ON r.order_id = o.order_id""",
    "earning": f"""
        SELECT * FROM fact_orders WHERE order_status NOT IN ({_quoted(fixed.REVENUE_EXCLUDED)})""",
}

READS = {
    "dim_customers": ("r_customers",),
    "dim_products": ("r_products", "r_product_category_translation"),
    "dim_sellers": ("r_sellers",),
    "rollup": ("r_order_payments",),
    "fact_orders": ("r_orders", "r_customers", "rollup"),
    "fact_order_items": ("r_order_items", "fact_orders"),
    "fact_reviews": ("r_order_reviews", "fact_orders"),
    "earning": ("fact_orders",),
}


def _needed(views: tuple[str, ...]) -> set[str]:
    return set(views).union(*(_needed(READS.get(view, ())) for view in views))


def _sql(body: str, *views: str, extra: dict[str, str] | None = None) -> str:
    needed = _needed(views)
    named = [(name, text) for name, text in VIEWS.items() if name in needed] + list((extra or {}).items())
    return "WITH " + ",\n".join(f"{name} AS ({text.strip()})" for name, text in named) + "\n" + body.strip()


def _table(view: str, replaced: dict[str, str] | None = None) -> str:
    """All columns of a view, some of them printed another way."""
    changes = ", ".join(f"CAST({column} AS {kind}) AS {column}" for column, kind in (replaced or {}).items())
    return _sql(f"SELECT * REPLACE ({changes}) FROM {view}" if changes else f"SELECT * FROM {view}", view)


DATES = {"purchase_date": "VARCHAR", "purchase_month": "VARCHAR"}
LATE = {"is_delivered_late": "VARCHAR"}
ROLLUP = {"payment_total": "DOUBLE", "payment_count": "DOUBLE", "max_payment_installments": "DOUBLE"}
PRICES = {"price": "DOUBLE", "freight_value": "DOUBLE"}
RAW_MONEY = {"order_items": PRICES, "order_payments": {"payment_value": "DOUBLE"}}
CENTS = "CAST({} * 100 AS HUGEINT)"


def _assertions(*rows: tuple[str, str, str, str], views: tuple[str, ...]) -> str:
    parts = [
        f"""SELECT '{check}' AS "check", '{metric}' AS metric, CAST(v AS DOUBLE) AS "value",
            CAST(e AS DOUBLE) AS expected, CAST(v = e AS VARCHAR) AS ok FROM (SELECT ({value}) AS v, ({expected}) AS e)"""
        for check, metric, value, expected in rows
    ]
    return _sql("\nUNION ALL\n".join(parts), *views)


def _orphans(child: str, parent: str, key: str) -> str:
    return f"SELECT count(*) FROM {child} WHERE {key} IS NULL OR {key} NOT IN (SELECT {key} FROM {parent})"


def _key_rows(table: str, *key: str) -> list[tuple[str, str, str, str]]:
    columns = ", ".join(key)
    nulls = " OR ".join(f"{k} IS NULL" for k in key)
    return [
        (
            "primary_key",
            f"{table}_repeated",
            f"SELECT count(*) - (SELECT count(*) FROM (SELECT DISTINCT {columns} FROM {table})) FROM {table}",
            "0",
        ),
        ("primary_key", f"{table}_null", f"SELECT count(*) FROM {table} WHERE {nulls}", "0"),
    ]


def _row_counts(tables: dict[str, str]) -> str:
    body = " UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS \"rows\" FROM {v}" for t, v in tables.items())
    return _sql(body, *tables.values())


LOOKUP = _sql(
    f"""SELECT order_id, customer_unique_id, CAST(payment_total AS DOUBLE) AS payment_total
    FROM fact_orders WHERE order_status = '{fixed.CANCELED}'""",
    "fact_orders",
)
MONTH_TOTALS = _sql(
    f"""SELECT CAST(purchase_month AS VARCHAR) AS purchase_month, count(*) AS items,
        CAST(sum(item_total_value) AS DOUBLE) AS total
    FROM fact_order_items WHERE purchase_month BETWEEN DATE '{MONTHS[0]}' AND DATE '{MONTHS[1]}'
    GROUP BY purchase_month""",
    "fact_order_items",
)
RAW_NAMES = {v.removeprefix("r_"): v for v in VIEWS if v.startswith("r_")}
STAR_VIEWS = ("dim_customers", "dim_products", "dim_sellers", "fact_orders", "fact_order_items", "fact_reviews")

ORACLE: dict[str, str] = {
    **{
        f"csv_{table}": _table(view, RAW_MONEY.get(table))
        for table, view in RAW_NAMES.items()
    },
    "raw_reload": _row_counts(RAW_NAMES),
    "published_counts": _row_counts({view: view for view in STAR_VIEWS}),
    "dim_customers": _table("dim_customers"),
    "dim_products": _table("dim_products"),
    "dim_sellers": _table("dim_sellers"),
    "payment_rollup": _table("rollup", ROLLUP),
    "fact_orders": _table("fact_orders", {**DATES, **LATE, **ROLLUP, "late_delivery_days": "DOUBLE"}),
    "fact_order_items": _table("fact_order_items", {**DATES, **PRICES, "item_total_value": "DOUBLE"}),
    "fact_reviews": _table("fact_reviews", {**LATE, "delivery_delay_days": "DOUBLE"}),
    "fact_reviews_split": _sql(
        """
        SELECT * REPLACE (CAST(is_delivered_late AS VARCHAR) AS is_delivered_late,
            CAST(delivery_delay_days AS DOUBLE) AS delivery_delay_days) FROM three_each""",
        "fact_orders", "r_order_reviews",
        extra={
            "thrice": "SELECT r.* FROM r_order_reviews r, range(3)",
            "three_each": VIEWS["fact_reviews"].replace("r_order_reviews", "thrice"),
        },
    ),
    "monthly_revenue": _sql(
        f"""
        SELECT CAST(purchase_month AS VARCHAR) AS purchase_month, CAST(cents AS DOUBLE) / 100 AS monthly_revenue,
            CASE WHEN cents < before THEN -1 ELSE 1 END
                * CAST({_places('abs(cents - before) * 10000', 'before')} AS DOUBLE) / 100 AS mom_change_pct,
            CAST({_places('in_frame', 'frame_rows')} AS DOUBLE) / 100 AS moving_avg_3mo
        FROM framed""",
        "fact_order_items",
        "earning",
        extra={
            "months": f"""
                SELECT i.purchase_month, {CENTS.format('sum(item_total_value)')} AS cents
                FROM fact_order_items i JOIN earning e ON i.order_id = e.order_id
                WHERE i.purchase_month BETWEEN DATE '{MONTHS[0]}' AND DATE '{MONTHS[1]}'
                GROUP BY i.purchase_month""",
            "framed": """
                SELECT purchase_month, cents, lag(cents) OVER (ORDER BY purchase_month) AS before,
                    CAST(sum(cents) OVER recent AS HUGEINT) AS in_frame, count(*) OVER recent AS frame_rows
                FROM months
                WINDOW recent AS (ORDER BY purchase_month ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)""",
        },
    ),
    "cohort_retention": _sql(
        f"""
        SELECT CAST(cohort_month AS VARCHAR) AS cohort_month, cohort_size, month_number, retained_customers,
            CAST({_places('retained_customers * 10000', 'cohort_size')} AS DOUBLE) / 100 AS retention_pct
        FROM (
            SELECT cohort_month, date_diff('month', cohort_month, purchase_month) AS month_number,
                count(DISTINCT customer_unique_id) AS retained_customers
            FROM fact_orders JOIN first_months USING (customer_unique_id) GROUP BY ALL
        ) JOIN (SELECT cohort_month, count(*) AS cohort_size FROM first_months GROUP BY ALL) USING (cohort_month)""",
        "fact_orders",
        extra={
            "first_months": """
                SELECT customer_unique_id, min(purchase_month) AS cohort_month FROM fact_orders GROUP BY ALL"""
        },
    ),
    "top_sellers": _sql(
        f"""
        SELECT category, seller_id, CAST(total AS DOUBLE) AS total_sold, the_rank FROM (
            SELECT category, seller_id, total,
                rank() OVER (PARTITION BY category ORDER BY total DESC NULLS FIRST) AS the_rank
            FROM (
                SELECT coalesce(product_category_name_english, product_category_name, '{fixed.NO_CATEGORY}') AS category,
                    seller_id, sum(item_total_value) AS total
                FROM fact_order_items i JOIN earning e ON i.order_id = e.order_id
                JOIN dim_products p ON i.product_id = p.product_id GROUP BY ALL))
        WHERE the_rank <= 3""",
        "fact_order_items",
        "earning",
        "dim_products",
    ),
    "late_rate": _sql(
        f"""
        SELECT customer_state, CAST({_places('late * 10000', 'delivered')} AS DOUBLE) / 100 AS late_pct FROM (
            SELECT customer_state, count(*) AS delivered, count(*) FILTER (is_delivered_late) AS late
            FROM fact_orders JOIN dim_customers USING (customer_unique_id)
            WHERE order_status = '{fixed.DELIVERED}' GROUP BY customer_state)""",
        "fact_orders",
        "dim_customers",
    ),
    "rfm": _sql(
        """
        SELECT customer_unique_id, date_diff('day', last_day, (SELECT max(last_day) + 1 FROM people)) AS recency_days,
            total_orders, CAST(paid AS DOUBLE) AS total_payment,
            ntile(4) OVER (ORDER BY last_day NULLS FIRST, customer_unique_id NULLS LAST) AS r_score,
            ntile(4) OVER (ORDER BY total_orders, customer_unique_id NULLS LAST) AS f_score,
            ntile(4) OVER (ORDER BY paid, customer_unique_id NULLS LAST) AS m_score
        FROM people""",
        "earning",
        extra={
            "people": """
                SELECT customer_unique_id, max(purchase_date) AS last_day, count(*) AS total_orders,
                    coalesce(sum(payment_total), 0) AS paid
                FROM earning GROUP BY customer_unique_id"""
        },
    ),
    "review_delay": _sql(
        f"""
        SELECT delay_bucket, reviews, CAST({_places('score * 100', 'reviews')} AS DOUBLE) / 100 AS avg_score FROM (
            SELECT CASE WHEN delivery_delay_days > {fixed.DELAY_SHORT_MAX_DAYS} THEN '{fixed.DELAY_LONG}'
                    WHEN delivery_delay_days > 0 THEN '{fixed.DELAY_SHORT}'
                    WHEN delivery_delay_days = 0 THEN '{fixed.DELAY_ON_DAY}'
                    ELSE '{fixed.DELAY_EARLY}' END AS delay_bucket,
                count(*) AS reviews, sum(review_score) AS score
            FROM fact_reviews WHERE delivery_delay_days IS NOT NULL GROUP BY ALL)""",
        "fact_reviews",
    ),
    "selective_lookup": LOOKUP,
    "check_orphans": _assertions(
        ("orphans", "orders_no_customer", "SELECT count(*) FROM fact_orders WHERE customer_unique_id IS NULL", "0"),
        ("orphans", "items_no_product", _orphans("fact_order_items", "dim_products", "product_id"), "0"),
        ("orphans", "items_no_seller", _orphans("fact_order_items", "dim_sellers", "seller_id"), "0"),
        ("orphans", "reviews_no_order", _orphans("fact_reviews", "fact_orders", "order_id"), "0"),
        ("orphans", "items_no_customer", "SELECT count(*) FROM fact_order_items WHERE customer_unique_id IS NULL", "0"),
        ("orphans", "reviews_no_customer", "SELECT count(*) FROM fact_reviews WHERE customer_unique_id IS NULL", "0"),
        views=STAR_VIEWS,
    ),
    "check_raw_orphans": _assertions(
        ("orphans", "raw_orders_no_customer", _orphans("r_orders", "r_customers", "customer_id"), "0"),
        ("orphans", "raw_items_no_order", _orphans("r_order_items", "r_orders", "order_id"), "0"),
        ("orphans", "raw_payments_no_order", _orphans("r_order_payments", "r_orders", "order_id"), "0"),
        ("orphans", "raw_reviews_no_order", _orphans("r_order_reviews", "r_orders", "order_id"), "0"),
        views=("r_orders", "r_customers", "r_order_items", "r_order_payments", "r_order_reviews"),
    ),
    "check_pair_unique": _assertions(
        (
            "review_pairs",
            "distinct_pairs",
            "SELECT count(*) FROM (SELECT DISTINCT review_id, order_id FROM r_order_reviews)",
            "SELECT count(*) FROM r_order_reviews",
        ),
        views=("r_order_reviews",),
    ),
    "check_midnight": _assertions(
        (
            "midnight",
            "estimates_with_time_of_day",
            "SELECT count(*) FROM r_orders WHERE CAST(order_estimated_delivery_date AS TIME) <> TIME '00:00:00'",
            "0",
        ),
        views=("r_orders",),
    ),
    "check_zip": _assertions(
        (
            "zip_prefix",
            "bad_zip_prefixes",
            f"SELECT count(*) FROM dim_customers WHERE length(customer_zip_code_prefix) <> {fixed.ZIP_PREFIX_LENGTH}",
            "0",
        ),
        views=("dim_customers",),
    ),
    "check_reconcile": _assertions(
        (
            "reconcile",
            "payment_diff",
            "SELECT sum(payment_value) - (SELECT sum(payment_total) FROM fact_orders) FROM r_order_payments",
            "0",
        ),
        (
            "reconcile",
            "item_diff",
            "SELECT sum(price + freight_value) - (SELECT sum(item_total_value) FROM fact_order_items)"
            " FROM r_order_items",
            "0",
        ),
        views=("r_order_payments", "r_order_items", "fact_orders", "fact_order_items"),
    ),
    "check_row_counts": _assertions(
        ("row_counts", "orders", "SELECT count(*) FROM fact_orders", "SELECT count(*) FROM r_orders"),
        (
            "row_counts",
            "people",
            "SELECT count(*) FROM dim_customers",
            "SELECT count(DISTINCT customer_unique_id) FROM r_customers",
        ),
        ("row_counts", "items", "SELECT count(*) FROM fact_order_items", "SELECT count(*) FROM r_order_items"),
        ("row_counts", "reviews", "SELECT count(*) FROM fact_reviews", "SELECT count(*) FROM r_order_reviews"),
        views=STAR_VIEWS,
    ),
    "check_untranslated": _sql(
        """SELECT product_category_name, count(*) AS products FROM dim_products
        WHERE product_category_name_english IS NULL GROUP BY ALL HAVING product_category_name IS NOT NULL""",
        "dim_products",
    ),
    "check_out_of_window": _sql(
        f"""SELECT CAST(purchase_month AS VARCHAR) AS purchase_month, count(*) AS orders FROM fact_orders
        WHERE purchase_month NOT BETWEEN DATE '{MONTHS[0]}' AND DATE '{MONTHS[1]}' GROUP BY ALL""",
        "fact_orders",
    ),
    "check_type1_cost": _sql(
        """SELECT count(*) AS people_with_many_ids, count(*) FILTER (cities > 1) AS people_who_changed_city FROM (
            SELECT count(*) AS ids, count(DISTINCT customer_city) AS cities FROM r_customers
            GROUP BY customer_unique_id) WHERE ids > 1""",
        "r_customers",
    ),
    "check_primary_keys": _assertions(
        *_key_rows("dim_customers", "customer_unique_id"),
        *_key_rows("dim_products", "product_id"),
        *_key_rows("dim_sellers", "seller_id"),
        *_key_rows("fact_orders", "order_id"),
        *_key_rows("fact_order_items", "order_id", "order_item_id"),
        *_key_rows("fact_reviews", "review_sk"),
        views=STAR_VIEWS,
    ),
    "lookup_unpartitioned": LOOKUP,
    "lookup_partitioned": LOOKUP,
    "lookup_manifest": LOOKUP,
    "month_window_unpartitioned": MONTH_TOTALS,
    "month_window_partitioned": MONTH_TOTALS,
}

# The same questions, put to the published star and to the search for boundary rows.
ORACLE["rfm_search"] = ORACLE["rfm"]
ORACLE.update({f"published_{table}": ORACLE[table] for table in STAR_VIEWS})
ORACLE.update({f"reloaded_{table}": ORACLE[f"csv_{table}"] for table in RAW_NAMES})

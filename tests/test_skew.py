"""One key holds a third of all rows: plans must split it or shrink it before the shuffle."""

import contextlib

import pytest
from pyspark.sql import functions as F

from starloom.plans import analyses, star_build
from starloom.sources.schemas import raw_schema, shaped, star_schema
from starloom.verification.queries import Tables
from tests.conftest import SMALL

ROWS = 60_000


@contextlib.contextmanager
def settings(spark, **values):
    names = {name.replace("__", "."): value for name, value in values.items()}
    before = {name: spark.conf.get(name, None) for name in names}
    for name, value in names.items():
        spark.conf.set(name, value)
    yield
    for name, value in before.items():
        spark.conf.unset(name) if value is None else spark.conf.set(name, value)


@pytest.fixture
def shuffled_joins(spark):
    """Joins of any size shuffle, and a partition counts as skewed from a few kilobytes on."""
    with settings(
        spark,
        spark__sql__autoBroadcastJoinThreshold="-1",
        spark__sql__shuffle__partitions="16",
        spark__sql__adaptive__advisoryPartitionSizeInBytes="20k",
        spark__sql__adaptive__skewJoin__skewedPartitionThresholdInBytes="40k",
        spark__sql__adaptive__skewJoin__skewedPartitionFactor="2",
    ):
        yield


def filled(spark, schema, rows, **columns):
    """``rows`` rows of a declared schema; columns not given are NULL."""
    base = spark.range(0, rows, 1, 8)
    given = {name: columns.get(name, F.lit(None)) for name in schema.fieldNames()}
    return shaped(base.select(*[c.alias(n) for n, c in given.items()]), schema)


def hot(key, name="id"):
    """``key`` for a third of the rows, distinct values for the rest."""
    return F.when(F.col(name) % 3 == 0, F.lit(key)).otherwise(F.col(name).cast("string"))


def final_plan(df):
    df.write.format("noop").mode("overwrite").save()
    rows = df.collect()
    return rows, df._jdf.queryExecution().executedPlan().toString()


def test_items_of_a_hot_order_are_split_at_the_join(spark, shuffled_joins):
    amounts = {"price": F.lit(1), "freight_value": F.lit(0)}
    items = filled(spark, raw_schema("order_items"), ROWS, order_id=hot("0"), order_item_id=F.col("id"), **amounts)
    orders = filled(spark, raw_schema("orders"), ROWS, order_id=F.col("id"), customer_id=F.col("id"))
    customers = filled(spark, raw_schema("customers"), ROWS, customer_id=F.col("id"), customer_unique_id=F.col("id"))
    rows, plan = final_plan(star_build.fact_order_items(items, star_build.resolve_orders(orders, customers)))
    assert len(rows) == ROWS and "skew=true" in plan


def test_orders_without_customer_are_split_at_the_join(spark, shuffled_joins):
    nobody = F.when(F.col("id") % 3 > 0, F.col("id"))
    orders = filled(spark, raw_schema("orders"), ROWS, order_id=F.col("id"), customer_id=nobody)
    customers = filled(spark, raw_schema("customers"), ROWS, customer_id=F.col("id"), customer_unique_id=F.col("id"))
    rows, plan = final_plan(star_build.resolve_orders(orders, customers))
    assert len(rows) == ROWS and "skew=true" in plan


def shuffled_rows(plan_df):
    """Rows each exchange of the executed plan received, largest first."""

    def walk(node):
        kind = node.getClass().getSimpleName()
        if kind == "AdaptiveSparkPlanExec":
            yield from walk(node.executedPlan())
        elif kind.endswith("QueryStageExec"):
            yield from walk(node.plan())
        else:
            if kind == "ShuffleExchangeExec":
                yield node.metrics().apply("shuffleRecordsWritten").value()
            children = node.children()
            for i in range(children.size()):
                yield from walk(children.apply(i))

    plan_df.collect()
    return sorted(walk(plan_df._jdf.queryExecution().executedPlan()), reverse=True)


def test_hot_person_shrinks_before_the_shuffle(spark, shuffled_joins):
    one_person = filled(
        spark, star_schema("fact_orders"), ROWS,
        order_id=F.col("id"), customer_unique_id=F.lit("ann"), order_status=F.lit("delivered"),
        purchase_month=F.add_months(F.lit("2017-01-01").cast("date"), (F.col("id") % 20).cast("int")),
        is_delivered_late=F.lit(True),
    )
    people = filled(spark, star_schema("dim_customers"), 1, customer_unique_id=F.lit("ann"), customer_state=F.lit("SP"))
    raw_people = filled(spark, raw_schema("customers"), ROWS, customer_id=F.col("id"), customer_unique_id=F.lit("ann"))
    for result in (
        analyses.retention(one_person),
        analyses.late_rate(one_person, people),
        star_build.dim_customers(raw_people),
    ):
        assert shuffled_rows(result)[0] <= 200


def test_hot_order_shrinks_before_the_revenue_join(spark, shuffled_joins):
    month = F.lit("2017-05-01").cast("date")
    sold = {"purchase_month": month, "item_total_value": F.lit(1)}
    items = filled(spark, star_schema("fact_order_items"), ROWS, order_id=F.lit("1"), **sold)
    orders = filled(spark, star_schema("fact_orders"), 10, order_id=F.col("id"), order_status=F.lit("delivered"))
    assert shuffled_rows(analyses.monthly_revenue(items, orders))[0] <= 20


def test_copies_of_reviews_cross_the_network_as_runs(spark, shuffled_joins):
    reviews = filled(spark, raw_schema("order_reviews"), 3000, review_id=F.col("id"), order_id=F.col("id"), review_score=F.lit(5))
    orders = filled(spark, star_schema("fact_orders"), 3000, order_id=F.col("id"))
    thrice = reviews.unionByName(reviews).unionByName(reviews)
    facts = star_build.fact_reviews(thrice, orders, hot_rows=2)
    assert shuffled_rows(facts)[0] <= 3000 and facts.count() == 9000


def test_partitioned_write_splits_a_hot_value(spark, tmp_path):
    from starloom.sources.store import write_table

    status = F.when(F.col("id") % 50 == 0, "canceled").otherwise("delivered")
    facts = filled(spark, star_schema("fact_orders"), ROWS, order_id=F.col("id"), order_status=status)
    with settings(spark, spark__sql__adaptive__advisoryPartitionSizeInBytes="100k"):
        write_table(facts, f"file://{tmp_path}/t", ["order_status"])

    def files(status):
        return len(list((tmp_path / "t" / f"order_status={status}").glob("*.parquet")))

    assert files("delivered") > 1 and files("canceled") == 1


def test_numbered_lines_are_not_shuffled_again_for_the_join_with_orders(spark):
    key = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(key)
    spark.conf.set(key, "-1")
    try:
        plan = Tables(spark, SMALL).fact_order_items._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set(key, before)
    to_join = plan.split("Window [")[0].rsplit("SortMergeJoin", 1)[1]
    assert "Exchange" not in to_join

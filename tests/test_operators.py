import datetime as dt
import random
from decimal import Decimal

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from starloom.functions import fixed_values as fixed
from starloom.operators.cohort import cohort_retention
from starloom.operators.growth import period_growth
from starloom.operators.keep_first import keep_first
from starloom.operators.numbering import number_within
from starloom.operators.quantiles import bucket_ends, ntile_columns
from starloom.operators.rates import banded_average, rate_by_dimension
from starloom.operators.top_k import top_k_per_group
from tests.conftest import rows

D = Decimal


def month(year, number):
    return dt.date(year, number, 1)


# keep_first


@pytest.mark.parametrize("partitions", [1, 5])
def test_keep_first_takes_smallest_id_and_null_last(table, partitions):
    df = table(
        "person string, id string, city string",
        ("p", None, "zero"),
        ("p", "c", "three"),
        ("p", "b", "two"),
        ("q", None, "only"),
        (None, "x", "nobody"),
        (None, "w", "nobody first"),
        partitions=partitions,
    )
    assert rows(keep_first(df, ["person"], ["id"])) == [
        ("p", "b", "two"),
        ("q", None, "only"),
        (None, "w", "nobody first"),
    ]


def test_keep_first_does_not_depend_on_row_order(table):
    data = [(i % 7, i % 3, str(random.Random(i).random())) for i in range(200)]
    one = rows(keep_first(table("k int, t int, v string", *data), ["k"], ["t"]))
    other = rows(keep_first(table("k int, t int, v string", *reversed(data), partitions=7), ["k"], ["t"]))
    assert one == other and len(one) == 7


# period_growth


def test_growth_edges(table):
    df = table(
        "m date, v decimal(19,2)",
        (month(2017, 1), D("100.00")),
        (month(2017, 2), D("50.00")),
        (month(2017, 2), D("100.00")),
        (month(2017, 5), D("120.00")),
        (month(2017, 6), D("0.03")),
        (None, D("999.00")),
    )
    got = [tuple(r) for r in period_growth(df, "m", "v", window=("2017-01-01", "2017-06-01")).collect()]
    assert got == [
        (month(2017, 1), D("100.00"), None, D("100.00")),
        (month(2017, 2), D("150.00"), D("50.00"), D("125.00")),
        (month(2017, 5), D("120.00"), D("-20.00"), D("123.33")),
        (month(2017, 6), D("0.03"), D("-99.98"), D("90.01")),
    ]


def test_growth_window_is_inclusive_and_optional(table):
    df = table("m date, v decimal(19,2)", *[(month(2018, n), D(n)) for n in range(1, 6)])
    windowed = period_growth(df, "m", "v", window=("2018-02-01", "2018-04-01"))
    assert [r["m"].month for r in windowed.collect()] == [2, 3, 4]
    assert period_growth(df, "m", "v").count() == 5


# cohort_retention


def test_cohort_counts_people_once_and_null_person_only_in_size(table):
    jan, feb, apr = month(2017, 1), month(2017, 2), month(2017, 4)
    df = table(
        "u string, m date",
        ("a", jan), ("a", jan), ("a", apr),
        ("b", jan), ("b", feb),
        (None, jan), (None, feb),
        ("c", apr),
    )
    assert [tuple(r) for r in cohort_retention(df, "u", "m").collect()] == [
        (jan, 3, 0, 2, D("66.67")),
        (jan, 3, 1, 1, D("33.33")),
        (jan, 3, 3, 1, D("33.33")),
        (apr, 1, 0, 1, D("100.00")),
    ]


def test_cohort_with_undated_activity(table):
    jan = month(2017, 1)
    df = table("u string, m date", ("a", jan), ("a", None), ("b", None), (None, None))
    assert [tuple(r) for r in cohort_retention(df, "u", "m").collect()] == [
        (jan, 1, 0, 1, D("100.00")),
        (jan, 1, None, 1, D("100.00")),
    ]


def test_cohort_of_only_nameless_orders_is_not_listed(table):
    assert cohort_retention(table("u string, m date", (None, month(2017, 1))), "u", "m").count() == 0


def test_cohort_matches_brute_force(table):
    rnd = random.Random(5)
    data = [(f"u{int(rnd.random() ** 3 * 60)}", month(2016 + rnd.randint(0, 2), rnd.randint(1, 12))) for _ in range(600)]
    number = lambda d: d.year * 12 + d.month
    first = {u: min(m for v, m in data if v == u) for u, _ in data}
    pairs = {(first[u], number(m) - number(first[u]), u) for u, m in data}
    expected = {}
    for cohort, n, _ in pairs:
        expected[cohort, n] = expected.get((cohort, n), 0) + 1
    got = cohort_retention(table("u string, m date", *data), "u", "m").collect()
    assert {(r.cohort_month, r.month_number): r.retained for r in got} == expected
    assert all(r.cohort_size == sum(1 for m in first.values() if m == r.cohort_month) for r in got)


# top_k_per_group


def test_top_k_keeps_ties_and_ranks_null_first(table):
    df = table(
        "g string, i string, v decimal(19,2)",
        ("x", "a", D(9)), ("x", "b", D(7)), ("x", "c", D(7)), ("x", "d", D(7)), ("x", "e", D(1)),
        ("y", "a", None), ("y", "b", D(5)), ("y", "c", D(4)), ("y", "d", D(3)),
        (None, "n", D(2)),
    )
    assert rows(top_k_per_group(df, "g", "i", "v", 3)) == sorted(
        [
            ("x", "a", D("9.00"), 1), ("x", "b", D("7.00"), 2), ("x", "c", D("7.00"), 2), ("x", "d", D("7.00"), 2),
            ("y", "a", None, 1), ("y", "b", D("5.00"), 2), ("y", "c", D("4.00"), 3),
            (None, "n", D("2.00"), 1),
        ],
        key=repr,
    )


def test_top_k_equals_rank_window(table):
    rnd = random.Random(11)
    data = [(rnd.randint(0, 4), i, rnd.choice([None, 1, 2, 3, 5, 8, 13])) for i in range(300)]
    df = table("g int, i int, v int", *data)
    ranked = df.withColumn("rank", F.rank().over(Window.partitionBy("g").orderBy(F.col("v").desc_nulls_first())))
    for k in (1, 3, 70, 400):
        assert rows(top_k_per_group(df, "g", "i", "v", k)) == rows(ranked.filter(F.col("rank") <= k))


def test_top_k_limits_before_the_shuffle(table):
    df = table("g int, i int, v int", (1, 1, 1))
    plan = top_k_per_group(df, "g", "i", "v")._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("WindowGroupLimit") == 2


# rates and bands


def test_rate_keeps_unknown_flags_in_the_denominator(table):
    facts = table(
        "u string, late boolean",
        ("a", True), ("a", None), ("b", False), ("c", True), ("gone", True), (None, True),
    )
    people = table("u string, state string", ("a", "N"), ("b", "N"), ("c", "S"), ("d", "E"))
    got = rate_by_dimension(facts, people, "u", "state", F.col("late"))
    assert [tuple(r) for r in got.collect()] == [("S", 1, 1, D("100.00")), ("N", 1, 3, D("33.33"))]


def test_bands(table):
    df = table("d int, s int", (-1, 5), (0, 4), (1, 3), (5, 2), (6, 1), (6, None))
    d = F.col("d")
    bands = [(d < 0, fixed.DELAY_EARLY), (d == 0, fixed.DELAY_ON_DAY), (d <= 5, fixed.DELAY_SHORT)]
    assert [tuple(r) for r in banded_average(df, bands, fixed.DELAY_LONG, "s").collect()] == [
        (fixed.DELAY_EARLY, 1, D("5.00")),
        (fixed.DELAY_ON_DAY, 1, D("4.00")),
        (fixed.DELAY_SHORT, 2, D("2.50")),
        (fixed.DELAY_LONG, 2, D("1.00")),
    ]


# ntile


@pytest.mark.parametrize("n", [0, 1, 3, 4, 5, 6, 59])
@pytest.mark.parametrize("k", [1, 3, 4, 7])
def test_bucket_ends_follow_ntile_sizes(n, k):
    sizes = [n // k + (b < n % k) for b in range(k)]
    ends = [sum(sizes[: b + 1]) for b in range(k - 1)]
    assert bucket_ends(n, k) == [e for e in ends if e < n]


def ntile_window(df, orderings, k):
    return df.withColumns({name: F.ntile(k).over(Window.orderBy(*cols)) for name, cols in orderings.items()})


@pytest.mark.parametrize("n", [0, 1, 3, 4, 5, 6])
def test_ntile_of_few_rows(spark, n):
    df = spark.range(n, numPartitions=3).select(F.lit(1).alias("same"), F.format_string("%03d", "id").alias("id"))
    orderings = {"by_same": ["same", "id"], "by_id": ["id"]}
    assert rows(ntile_columns(df, orderings, 4)) == rows(ntile_window(df, orderings, 4))


@pytest.mark.parametrize("partitions", [1, 9])
@pytest.mark.parametrize("limits", [{}, {"sample_rows": 60, "finish_rows": 40}, {"sample_rows": 7, "finish_rows": 300}])
def test_ntile_narrowing_is_exact(table, partitions, limits):
    rnd = random.Random(3)
    data = [
        (
            f"u{i:05d}",
            1 if rnd.random() < 0.97 else rnd.randint(2, 9),
            D(rnd.randint(0, 10**6)) / 100,
            None if rnd.random() < 0.1 else dt.date(2018, 1, 1) + dt.timedelta(days=rnd.randint(0, 300)),
        )
        for i in range(2001)
    ]
    df = table("u string, n int, m decimal(28,2), d date", *data, partitions=partitions)
    orderings = {"f": ["n", "u"], "m4": ["m", "u"], "r": ["d", "u"]}
    assert rows(ntile_columns(df, orderings, 4, **limits)) == rows(ntile_window(df, orderings, 4))


def test_ntile_refuses_an_ordering_that_cannot_decide(spark):
    df = spark.range(500).select(F.lit(1).alias("same"))
    with pytest.raises(ValueError, match="tiebreak"):
        ntile_columns(df, {"x": ["same"]}, 4, sample_rows=50, finish_rows=10)


def test_ntile_plan_has_no_global_window(table):
    scored = ntile_columns(table("u int", *[(i,) for i in range(20)]), {"q": ["u"]}, 4)
    plan = scored._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Window" not in plan


# number_within


def numbered(df, **limits):
    return number_within(df, ["k", "l"], F.pmod(F.hash("v"), F.lit(5)), "pos", **limits)


@pytest.mark.parametrize("limits", [{"hot_rows": 40}, {"hot_rows": 0, "copies_per_task": 7}])
def test_hot_groups_are_numbered_as_any_other(table, limits):
    rnd = random.Random(2)
    data = [("hot", None, rnd.randint(0, 30)) for _ in range(300)] + [("hot", None, 7)] * 150
    data += [(rnd.choice("abc"), rnd.choice([None, 1, 2]), rnd.randint(0, 9)) for _ in range(120)]
    expected = rows(numbered(table("k string, l int, v int", *data)))
    assert rows(numbered(table("k string, l int, v int", *data, partitions=8), **limits)) == expected
    hot = sorted(pos for k, _, _, pos in expected if k == "hot")
    assert hot == list(range(1, 451))

import datetime as dt
import random
from decimal import ROUND_HALF_UP, Decimal
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from starloom.functions import measures
from starloom.functions.exact import rounded_mean, rounded_ratio
from starloom.functions.status import earns_revenue, is_delivered
from tests.conftest import rows

D = Decimal


def half_up(value: Fraction) -> Decimal:
    sign = -1 if value < 0 else 1
    return sign * D((abs(value) * 200 + 1) // 2) / 100


def test_ratio_is_rounded_once(table):
    rnd = random.Random(7)
    pairs = [(i, D(rnd.randint(-(10**9), 10**9)) / 100, D(rnd.randint(1, 10**6)) / 100) for i in range(500)]
    pairs += [(504, D(10) ** 19 + D("0.05"), D("100.00")), (505, D(10) ** 17, D("0.01"))]
    pairs += [(501, D("1.00"), D("200.00")), (502, D("-1.00"), D("200.00")), (503, D("1.00"), D("-200.00"))]
    df = table("i int, a decimal(28,2), b decimal(28,2)", *pairs)
    got = dict(rows(df.select("i", rounded_ratio(F.col("a"), F.col("b"), per=100))))
    assert got == {i: half_up(Fraction(a) * 100 / Fraction(b)) for i, a, b in pairs}
    assert (got[501], got[502], got[503]) == (D("0.50"), D("-0.50"), D("-0.50"))


def test_ratio_of_null_and_of_zero(table):
    df = table("a decimal(28,2), b decimal(28,2)", (None, D(1)), (D(1), None))
    assert rows(df.select(rounded_ratio(F.col("a"), F.col("b")))) == [(None,), (None,)]
    with pytest.raises(Exception, match="BY_ZERO"):
        table("a int, b int", (1, 0)).select(rounded_ratio(F.col("a"), F.col("b"))).collect()


def test_mean_of_nothing_is_null(table):
    df = table("total int, n int", (None, 0), (7, 2))
    assert rows(df.select(rounded_mean(F.col("total"), F.col("n")))) == [(D("3.50"),), (None,)]


@pytest.mark.parametrize(
    "delivered, late_days, late",
    [
        (dt.datetime(2018, 1, 10, 23, 59, 59), 0, False),
        (dt.datetime(2018, 1, 11), 1, True),
        (dt.datetime(2018, 1, 8, 12), -2, False),
        (None, None, None),
    ],
)
def test_lateness_counts_calendar_days(table, delivered, late_days, late):
    df = table("d timestamp_ntz, e timestamp_ntz", (delivered, dt.datetime(2018, 1, 10)))
    got = df.select(measures.days_late(F.col("d"), F.col("e")), measures.is_late(F.col("d"), F.col("e")))
    assert rows(got) == [(late_days, late)]


def test_elapsed_days_match_exact_rounding(table):
    rnd = random.Random(1)
    start = dt.datetime(2017, 3, 1, 2, 3, 4)
    gaps = [rnd.randint(-10, 10**12) for _ in range(200)] + [432_000_000, 431_999_999, -432_000_000]
    spans = [(g, start, start + dt.timedelta(microseconds=g)) for g in gaps]
    df = table("g long, a timestamp_ntz, b timestamp_ntz", *spans)
    got = dict(rows(df.select("g", measures.elapsed_days(F.col("a"), F.col("b")))))
    assert got == {g: half_up(Fraction(g, 86_400_000_000)) for g in gaps}


@pytest.mark.parametrize("zone", ["UTC", "America/Sao_Paulo", "America/New_York"])
def test_measures_ignore_the_session_zone(spark, table, zone):
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        # Midnight of 2017-10-15 does not exist in one of the zones; in the other, 2018-03-11 has 23 hours.
        df = table(
            "i int, a timestamp_ntz, b timestamp_ntz",
            (1, dt.datetime(2017, 10, 14, 12), dt.datetime(2017, 10, 15)),
            (2, dt.datetime(2018, 3, 10, 18), dt.datetime(2018, 3, 11, 18)),
            (3, dt.datetime(2018, 3, 11, 18, 0, 0, 5), dt.datetime(2018, 3, 10, 6)),
        )
        got = df.select("i", measures.elapsed_days(F.col("a"), F.col("b")), measures.has_time_of_day(F.col("b")))
        assert rows(got, "i") == [(1, D("0.50"), False), (2, D("1.00"), True), (3, D("-1.50"), True)]
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


def test_calendar_helpers(table):
    df = table("t timestamp_ntz", (dt.datetime(2018, 8, 31, 23, 59),), (dt.datetime(2018, 1, 1),), (None,))
    got = df.select(
        measures.month_start(F.col("t")),
        measures.calendar_day(F.col("t")),
        measures.has_time_of_day(F.col("t")),
        measures.month_ordinal(measures.month_start(F.col("t"))),
    )
    assert rows(got, *got.columns) == [
        (None, None, None, None),
        (dt.date(2018, 1, 1), dt.date(2018, 1, 1), False, 2018 * 12 + 1),
        (dt.date(2018, 8, 1), dt.date(2018, 8, 31), True, 2018 * 12 + 8),
    ]


def test_status_policies(table):
    df = table("s string", ("canceled",), ("unavailable",), (None,), ("delivered",), ("shipped",))
    assert rows(df.filter(earns_revenue(F.col("s")))) == [("delivered",), ("shipped",)]
    assert rows(df.filter(is_delivered(F.col("s")))) == [("delivered",)]


def test_decimal_rounding_is_half_away_from_zero(table):
    df = table("x decimal(10,3)", (D("2.125"),), (D("-2.125"),))
    expected = [(D(v).quantize(D("0.01"), ROUND_HALF_UP),) for v in ("-2.125", "2.125")]
    assert rows(df.select(F.round("x", 2).alias("r")), "r") == expected

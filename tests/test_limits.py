"""What must stop a job or keep its value, whatever the size."""

from fractions import Fraction

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from starloom.functions import fixed_values as fixed
from starloom.functions.exact import rounded_days
from starloom.operators.numbering import number_within
from starloom.operators.quantiles import ntile_columns
from starloom.plans.publish import load_raw, publish
from starloom.session import REQUIRED
from starloom.sources import store
from starloom.sources.csv_files import read_csv

DAY = 86_400_000_000


@pytest.mark.parametrize("micros", [0, 1, -1, DAY // 200, DAY // 200 - 1, -DAY // 200, 3_650_000 * DAY + 7, -719_162 * DAY])
def test_days_between_the_most_distant_dates(spark, micros):
    exact = Fraction(abs(micros) * 100, DAY)
    hundredths = int(exact + Fraction(1, 2)) * (1 if micros >= 0 else -1)
    got = spark.range(1).select(rounded_days(F.lit(micros).cast("long")).alias("d")).first().d
    assert got * 100 == hundredths


@pytest.mark.parametrize("rows, limits", [(20, {}), (2000, {}), (2000, {"finish_rows": 200, "sample_rows": 50})])
def test_an_ordering_that_ties_is_refused_at_any_size(spark, rows, limits):
    tied = spark.range(rows).select((F.col("id") % 3).alias("v"))
    with pytest.raises(ValueError, match="tiebreak"):
        ntile_columns(tied, {"score": ["v"]}, 4, **limits).collect()


@pytest.mark.parametrize("lines", ["h,i\nok,1\n   \nz,2\n", "h,i\nok,1\n\t\nz,2\n", "  \nok,1\nz,2\n"])
def test_blank_lines_stop_the_load(spark, tmp_path, lines):
    (tmp_path / "t.csv").write_text(lines)
    schema = spark.createDataFrame([], "a string, b string").schema
    with pytest.raises(Exception, match="blank line"):
        read_csv(spark, schema, str(tmp_path / "t.csv")).collect()


@pytest.mark.parametrize("more", ["", '"two\nlines",2018-01-02 03:04:05\n'])
@pytest.mark.parametrize("value, ok", [("2018-01", False), ("2018", False), ("2018-01-31", True), ("2018-01-31 10:11:12", True)])
def test_a_time_needs_a_full_date(spark, tmp_path, more, value, ok):
    (tmp_path / "t.csv").write_text(f"a,b\nx,{value}\n{more}")
    schema = spark.createDataFrame([], "a string, b timestamp_ntz").schema
    df = read_csv(spark, schema, str(tmp_path / "t.csv"))
    if ok:
        assert df.filter("a = 'x'").first().b.isoformat(" ") == (value + " 00:00:00")[:19]
    else:
        with pytest.raises(Exception, match="not a date or time"):
            df.collect()


@pytest.mark.parametrize("key", REQUIRED)
def test_sessions_that_hide_errors_are_refused(spark, tmp_path, key):
    spark.conf.set(key, "false")
    try:
        for job in (lambda: load_raw(spark, {}, str(tmp_path)), lambda: publish(spark, {}, str(tmp_path))):
            with pytest.raises(RuntimeError, match=key):
                job()
    finally:
        spark.conf.unset(key)


@pytest.mark.parametrize("more", ["", '"two\nlines",x\n'])
@pytest.mark.parametrize("record", ['a"b"c,1', '"ab"c,1', '1,a"b', 'a""b,1', '"a"b","c"', ' "a",1'])
def test_quotes_inside_fields_stop_the_load(spark, tmp_path, more, record):
    (tmp_path / "t.csv").write_text(f"h,i\n{record}\n{more}")
    schema = spark.createDataFrame([], "a string, b string").schema
    with pytest.raises(Exception, match="quote"):
        read_csv(spark, schema, str(tmp_path / "t.csv")).collect()


@pytest.mark.parametrize("more", ["", '"two\nlines",x\n'])
def test_quotes_around_and_doubled_in_fields_are_read(spark, tmp_path, more):
    (tmp_path / "t.csv").write_text('h,i\n"a"",""b","""c"""\n"",""""\n' + more)
    schema = spark.createDataFrame([], "a string, b string").schema
    got = read_csv(spark, schema, str(tmp_path / "t.csv")).collect()
    assert {('a","b', '"c"'), ("", '"')} <= {tuple(r) for r in got}


def test_business_values_are_the_agreed_ones():
    assert fixed.REVENUE_EXCLUDED == ("canceled", "unavailable") and fixed.DELIVERED == "delivered"
    assert fixed.REVENUE_MONTHS == ("2017-01-01", "2018-08-01") and fixed.DELAY_SHORT_MAX_DAYS == 5
    labels = (fixed.DELAY_EARLY, fixed.DELAY_ON_DAY, fixed.DELAY_SHORT, fixed.DELAY_LONG, fixed.NO_CATEGORY)
    assert labels == ("1_early", "2_on_estimated_day", "3_late_1to5d", "4_late_over_5d", "unknown")


@pytest.mark.parametrize("hot_rows", [5000, 500, 20])
def test_cells_grow_with_the_group_and_leave_positions_alone(spark, hot_rows):
    df = spark.range(3000).select((F.col("id") % 3 > 0).cast("int").alias("k"), F.col("id").alias("v"))
    spread = F.xxhash64("v")
    got = number_within(df, ["k"], spread, "at", hot_rows=hot_rows)
    want = df.withColumn("at", F.row_number().over(Window.partitionBy("k").orderBy(spread, "k", "v")).cast("long"))
    assert got.exceptAll(want).isEmpty() and got.count() == 3000


def test_expiry_keeps_the_newest_runs_only(spark, tmp_path):
    root = str(tmp_path)
    runs = [store.new_run(root) for _ in range(4)]
    for run in runs:
        spark.range(3).write.parquet(f"{run}/t")
    for run in runs[:3]:  # the last has failed
        store.announce(spark, root, run)
    assert len(store.expire(spark, root, keep=2)) == 2
    assert spark.read.parquet(f"{store.current_run(spark, root, 2)[1]}/t").count() == 3
    store.expire(spark, root)
    assert [p.name for p in (tmp_path / "runs").iterdir()] == [runs[2].rsplit("/", 1)[-1]]
    assert store.current_run(spark, root) == (3, runs[2])
    with pytest.raises(ValueError):
        store.expire(spark, root, keep=0)

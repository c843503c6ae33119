"""What a load leaves on disk: inputs, staged lines and shuffle files go as soon as nothing reads them again."""

import datetime as dt
import glob
import os
import random
import time

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from starloom.plans.publish import load_raw, read_raw
from starloom.scratch import SHUFFLE_CLEANUP, scratch_path, scratch_root, staged, tidied
from starloom.sources.conform import RawTables, raw_table
from starloom.sources.csv_files import read_csv, read_raw_csv
from starloom.sources.schemas import RAW_DDL, raw_schema
from starloom.verification.queries import QUERIES, _as_csv, plain
from tests.conftest import rows

DAY = dt.datetime(1996, 5, 4)
TABLES = {
    "nation": ("n_nationkey int, n_name string", [(0, "NORTH"), (1, "SOUTH")]),
    "customer": ("c_custkey long, c_name string, c_nationkey int, c_acctbal double", [(k, f"c{k}", k % 2, 1.5 * k) for k in range(4)]),
    "supplier": ("s_suppkey long, s_name string, s_nationkey int", [(0, "a, b", 0), (1, "", 1)]),
    "part": ("p_partkey long, p_name string, p_brand string, p_type string, p_size int", [(k, "nut", "Brand#2", "LARGE", k) for k in range(3)]),
    "orders": (
        "o_orderkey long, o_custkey long, o_orderstatus string, o_orderdate timestamp_ntz, o_orderpriority string",
        [(k, k % 5, "FOP"[k % 3], DAY, f"{k}-LOW") for k in range(9)],
    ),
    "lineitem": (
        """l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double,
        l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz""",
        [(k % 9, k % 3, k % 2, 1 + k // 9, 3.0, 10.5 * k, 0.0, 0.01 * k, "N", "O", DAY) for k in range(20)] * 2,
    ),
}


@pytest.fixture
def folder(spark, tmp_path):
    for name, (ddl, data) in TABLES.items():
        spark.createDataFrame(data, ddl).write.parquet(f"{tmp_path}/{name}.parquet")
    return str(tmp_path)


def scratch_of(spark):
    at = f"{scratch_root(spark)}/starloom/{spark.sparkContext.applicationId}"
    return {f"{at}/{name}" for name in os.listdir(at)} if os.path.isdir(at) else set()


def shuffle_files(spark):
    dirs = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()
    return {f for d in dirs for f in glob.glob(f"{d.getPath()}/**/shuffle_*", recursive=True)}


@pytest.mark.parametrize("query", ["reloaded_order_items", "raw_reload"])
def test_only_the_two_loads_are_left(spark, folder, query):
    before = scratch_of(spark)
    got = rows(QUERIES[query](spark, folder))
    (left,) = scratch_of(spark) - before
    assert os.path.basename(left).startswith("raw-layer-")
    runs = os.listdir(f"{left}/runs")
    assert len(runs) == 2 and all(set(os.listdir(f"{left}/runs/{run}")) == set(RAW_DDL) for run in runs)
    if query == "raw_reload":
        assert dict((table, n) for n, table in got) == {t: raw_table(spark, folder, t).count() for t in RAW_DDL}
    else:
        assert got == rows(plain(raw_table(spark, folder, "order_items"))) and len(got) == 40


def test_an_input_is_done_when_its_table_is_written(spark, folder):
    raw, root, seen = RawTables(spark, folder), scratch_path(spark, "raw"), []
    paths = {table: _as_csv(raw[table], table, compression="gzip", maxRecordsPerFile=2) for table in RAW_DDL}

    def done(table):
        (run,) = os.listdir(f"{root}/runs")
        assert set(os.listdir(f"{root}/runs/{run}")) == set(list(RAW_DDL)[: len(seen) + 1])
        seen.append(table)

    before = scratch_of(spark)
    assert load_raw(spark, paths, root, done) == 1
    assert seen == list(RAW_DDL)
    assert scratch_of(spark) - before == {root}
    assert all(os.path.isdir(path) for path in paths.values())
    for table, df in read_raw(spark, root).items():
        assert rows(df) == rows(raw[table])


def test_packed_files_with_line_breaks(spark):
    texts = ["one", 'two\n"lines"', None, "", "a,b", "x\n\ny", "three\nmore\nlines"] * 5
    data = [(str(i), str(i % 3), 1, None, text, DAY, None) for i, text in enumerate(texts)]
    reviews = spark.createDataFrame(data, raw_schema("order_reviews")).repartition(3)
    path = _as_csv(reviews, "packed", compression="gzip", maxRecordsPerFile=4)
    assert len(glob.glob(f"{path}/*.csv.gz")) >= 9
    assert rows(read_raw_csv(spark, "order_reviews", path)) == rows(reviews)


def test_tidied_drops_what_was_staged_inside(spark):
    before = scratch_of(spark)
    outside = staged(spark.range(3), "outside")
    setting = spark.conf.get(SHUFFLE_CLEANUP)
    with pytest.raises(ZeroDivisionError), tidied(spark):
        with tidied(spark):
            staged(spark.range(4), "inner")
        staged(spark.range(5), "outer")
        1 // 0
    staged(spark.range(6), "later")
    assert sorted(os.path.basename(p).split("-")[0] for p in scratch_of(spark) - before) == ["later", "outside"]
    assert outside.count() == 3 and spark.conf.get(SHUFFLE_CLEANUP) == setting


def test_tidied_drops_shuffle_files_after_each_job(spark, tmp_path):
    spark.sparkContext._jvm.System.gc()
    before = shuffle_files(spark)
    with tidied(spark):
        counts = spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count()
        counts.write.parquet(f"{tmp_path}/counts")
        assert counts.agg(F.sum("count")).head()[0] == 1000
        waited = time.monotonic() + 20
        while (left := shuffle_files(spark) - before) and time.monotonic() < waited:
            time.sleep(0.1)
        assert not left


def test_lines_of_a_record_move_once(spark, tmp_path):
    rnd = random.Random(5)
    data = [(str(i), "\n".join(rnd.randbytes(150).hex() for _ in range(rnd.choice([1, 2, 3, 5])))) for i in range(1500)]
    text = "k,v\n" + "".join(f'{key},"{value}"\n' for key, value in data)
    (tmp_path / "long.csv").write_text(text)
    settings = {"spark.sql.files.maxPartitionBytes": "100000", "spark.sql.files.openCostInBytes": "1"}
    kept = {name: spark.conf.get(name) for name in settings}
    before = shuffle_files(spark)
    try:
        for name, value in settings.items():
            spark.conf.set(name, value)
        read = read_csv(spark, StructType.fromDDL("k string, v string"), str(tmp_path / "long.csv"))
        read.write.parquet(f"{tmp_path}/read")
    finally:
        for name, value in kept.items():
            spark.conf.set(name, value)
    moved = sum(os.path.getsize(f) for f in shuffle_files(spark) - before)
    assert rows(spark.read.parquet(f"{tmp_path}/read")) == sorted(data, key=repr)
    # Random digits do not shrink in a shuffle: moved once they take what the text does, moved again twice that.
    assert moved < 1.5 * len(text), (moved, len(text))

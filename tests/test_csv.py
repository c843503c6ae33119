import csv
import datetime as dt
import io
import random
from decimal import Decimal

import pytest
from pyspark.sql.types import StructType

from starloom.plans.publish import load_raw, read_raw
from starloom.scratch import scratch_path
from starloom.sources.conform import RawTables
from starloom.sources.csv_files import read_csv, read_raw_csv
from starloom.sources.schemas import RAW_DDL, raw_schema
from starloom.verification.queries import _as_csv
from tests.conftest import SMALL, rows

HEAD = "any,header,will,do\n"
KINDS = "a string, b string, t timestamp_ntz, n decimal(18,2)"


@pytest.fixture
def read(spark, tmp_path):
    def run(*texts, ddl=KINDS):
        paths = []
        for i, text in enumerate(texts):
            path = tmp_path / f"{i}.csv"
            path.write_bytes(text.encode())
            paths.append(str(path))
        return rows(read_csv(spark, StructType.fromDDL(ddl), paths))

    return run


def test_null_and_empty_differ(read):
    assert read(HEAD + 'a,,,\nb,"",,\n') == [("a", None, None, None), ("b", "", None, None)]


def test_leading_zeros_and_types(read):
    expected = [("01151", " x ", dt.datetime(2018, 1, 10, 23, 59, 59), Decimal("3.10"))]
    assert read(HEAD + "01151, x ,2018-01-10 23:59:59,3.1\n") == expected


@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_quotes_and_line_breaks(read, end):
    lines = ["h,h,h,h", 'a,"he said ""x"", twice",,1', f'b,"one{end}{end}two",,2', 'c,,,', f'"d{end}","",,4']
    assert read(end.join(lines) + end) == [
        ("a", 'he said "x", twice', None, Decimal("1.00")),
        ("b", f"one{end}{end}two", None, Decimal("2.00")),
        ("c", None, None, None),
        (f"d{end}", "", None, Decimal("4.00")),
    ]


def test_line_break_in_the_header(read):
    assert read('"x\ny",b,c,d\na,b,,\n') == [("a", "b", None, None)]


@pytest.mark.parametrize(
    "bad",
    [
        "a,b\n",
        "a,b,,1,5\n",
        "a,b,yesterday,1\n",
        "a,b,,one\n",
        'a,b,,""\n',
        "a,b,,3.125\n",
        "a,b,,3e1\n",
        'a,"b\n",\n',
        'a,"b,,1\n',
        "\nc,d,,1\n",
        'a,"\n",,\n\n',
        "a,\x01,,1\n",
    ],
)
def test_bad_records_stop_the_load(read, bad):
    with pytest.raises(Exception):
        read(HEAD + "ok,ok,,1\n" + bad)


def test_other_encodings_stop_the_load(spark, tmp_path):
    (tmp_path / "latin.csv").write_bytes(HEAD.encode() + "a,são,,1\n".encode("latin-1"))
    with pytest.raises(ValueError, match="UTF-8"):
        read_csv(spark, StructType.fromDDL(KINDS), str(tmp_path / "latin.csv"))


def test_records_across_many_splits(spark, read):
    rnd = random.Random(3)
    parts = ["a", '"', "\n", ",", "xyz ", "\r\n"]
    data = [(str(i), "".join(rnd.choice(parts) for _ in range(rnd.randint(0, 12)))) for i in range(1500)]
    buffer = io.StringIO(newline="")
    writer = csv.writer(buffer, quoting=csv.QUOTE_ALL, lineterminator="\n")
    writer.writerows([("k", "v"), *data])
    settings = {"spark.sql.files.maxPartitionBytes": "900", "spark.sql.files.openCostInBytes": "1"}
    before = {name: spark.conf.get(name) for name in settings}
    try:
        for name, value in settings.items():
            spark.conf.set(name, value)
        got = read(buffer.getvalue(), buffer.getvalue(), ddl="k string, v string")
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)
    assert got == sorted(data * 2, key=repr)


def test_reload_replaces_and_failure_keeps_the_last_load(spark, tmp_path):
    raw = RawTables(spark, SMALL)
    paths = {table: _as_csv(raw[table], table) for table in RAW_DDL}
    root = scratch_path(spark, "raw")
    assert load_raw(spark, paths, root) == 1
    loaded = read_raw(spark, root)
    for table in RAW_DDL:
        assert rows(loaded[table]) == rows(raw[table])
    (tmp_path / "bad.csv").write_text("a,b\nonly one\n")
    with pytest.raises(Exception):
        load_raw(spark, {**paths, "product_category_translation": str(tmp_path / "bad.csv")}, root)
    assert rows(read_raw(spark, root)["sellers"]) == rows(raw["sellers"])


def test_zero_and_tiny_decimals_survive_the_csv_files(spark):
    data = [("1", Decimal(0), Decimal("0.0000001"), "a", "b"), ("2", Decimal("-1e-18"), None, "", None)]
    data.append(("3", Decimal("12345678901234567890.123456789012345678"), Decimal("-9.5"), None, "c"))
    places = spark.createDataFrame(data, raw_schema("geolocation"))
    assert rows(read_raw_csv(spark, "geolocation", _as_csv(places, "places"))) == rows(places)

import pytest

from starloom.__main__ import REPORTS, main
from starloom.scratch import scratch_path, scratch_root
from starloom.sources.conform import RawTables
from tests.conftest import SMALL


def test_jobs_from_csv_to_reports(spark):
    folder, root = scratch_path(spark, "csv"), scratch_path(spark, "root")
    for table, df in RawTables(spark, SMALL).items():
        df.write.csv(f"{folder}/{table}.csv", header=True, escape='"', nullValue="", emptyValue='""')
    main(spark, "load", folder, root)
    main(spark, "publish", root)
    found = {}
    for name in [*REPORTS, "canceled_orders", "quality_report"]:
        main(spark, "report", root, name, f"{root}/{name}")
        found[name] = spark.read.parquet(f"{root}/{name}").count()
    assert found["quality_report"] == 31 and found["untranslated_categories"] == 2
    assert found["late_rate"] > 20 and found["rfm"] > 100 and found["cohort_retention"] > 100
    for name, option in (("monthly_revenue", "months=1995-03-01,2001-05-01"), ("canceled_orders", "status=delivered")):
        main(spark, "report", root, name, f"{root}/{name}-chosen", option)
        assert spark.read.parquet(f"{root}/{name}-chosen").count() > 50
    with pytest.raises(SystemExit):
        main(spark, "unknown")


class Conf(dict):
    def get(self, name, default=None):
        return super().get(name, default)


def session_with(**conf):
    return type("Session", (), {"conf": Conf({k.replace("__", "."): v for k, v in conf.items()})})()


def test_scratch_folder_is_the_clusters():
    assert scratch_root(session_with(spark__checkpoint__dir="hdfs:///x/", spark__master="yarn")) == "hdfs:///x"
    assert scratch_root(session_with(spark__master="local[2]")) == scratch_root(session_with(spark__master="local"))
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        scratch_root(session_with(spark__master="spark://host:7077"))

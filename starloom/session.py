"""Session for tests, the bench and the smoke run. A cluster brings its own."""

import os
import tempfile

from pyspark.sql import SparkSession


REQUIRED = ("spark.sql.ansi.enabled", "spark.sql.adaptive.enabled")


def require_settings(spark: SparkSession) -> None:
    """Refuse a session in which an amount that does not fit becomes NULL, or hot keys are not split at joins."""
    for key in REQUIRED:
        if spark.conf.get(key) != "true":
            raise RuntimeError(f"{key} must be true")


def local_session(cores: str | int = "*", name: str = "starloom") -> SparkSession:
    shuffle_partitions = os.cpu_count() if cores == "*" else int(cores)
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        # Without it every column expression records the Python stack it was written on.
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="starloom-"))
        .getOrCreate()
    )

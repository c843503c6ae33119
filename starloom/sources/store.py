"""Versioned sets of Parquet tables: write a new run aside, check it, then announce it.

``<root>/runs/<run>/<table>`` holds the data, ``<root>/announced`` one small record per published run.
Readers take the newest announced run, so they see all tables of one run or all of another; a run that
fails before its announcement stays invisible. Two writers never announce the same version: each version is
claimed by creating its record, which fails where one is there, and the later writer takes the next.

A table in folders has a manifest, a row per file with the folder's value, its rows and the range of one more column, so
that a reader of a few values opens their files by name and lists no folder.
"""

import json
import os
import uuid
from collections.abc import Sequence
from urllib.parse import unquote

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from starloom.sources.schemas import shaped

ANNOUNCEMENT = "version long, run string"
MANIFEST = "file string, value string, rows long, low string, high string"


def new_run(root: str) -> str:
    return f"{root.rstrip('/')}/runs/{uuid.uuid4().hex}"


def announced(spark: SparkSession, root: str) -> DataFrame:
    """``(version, run)`` of every published run."""
    try:
        return spark.read.schema(ANNOUNCEMENT).json(f"{root.rstrip('/')}/announced")
    except AnalysisException as problem:
        if problem.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], ANNOUNCEMENT)


def current_run(spark: SparkSession, root: str, version: int | None = None) -> tuple[int, str]:
    runs = announced(spark, root)
    if version is not None:
        runs = runs.filter(F.col("version") == version)
    newest = runs.orderBy(F.col("version").desc()).head()
    if newest is None:
        raise LookupError(f"nothing published under {root}" + (f" as version {version}" if version else ""))
    return newest["version"], newest["run"]


def announce(spark: SparkSession, root: str, run: str) -> int:
    """Make ``run`` the current one. Creating one file is the only step readers can notice."""
    newest = announced(spark, root).agg(F.max("version").alias("v")).head()["v"]
    version = (newest or 0) + 1
    while not _claimed(spark, f"{root.rstrip('/')}/announced/version-{version:012d}.json", {"version": version, "run": run}):
        version += 1
    return version


def _claimed(spark: SparkSession, path: str, record: dict) -> bool:
    """Create ``path`` with ``record``; False if somebody has created it before.

    The store must refuse to create a file that is there in the same step that looks for it, as HDFS does. Hadoop's
    class for local files looks first and creates then, so there the record is written aside and linked to its name.
    """
    file, line = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path), f"{json.dumps(record)}\n"
    files = _files(spark, file)
    if files.getUri().getScheme() == "file":
        return _linked(files.makeQualified(file).toUri().getPath(), line)
    try:
        out = files.create(file, False)
    except Py4JJavaError as problem:
        if "FileAlreadyExists" not in problem.java_exception.getClass().getName():
            raise
        return False
    out.write(line.encode())
    out.close()
    return True


def _linked(path: str, line: str) -> bool:
    """Create the local file ``path`` whole, or not at all if it is there: the system refuses a second link of one name."""
    folder = os.path.dirname(path)
    os.makedirs(folder, exist_ok=True)
    aside = f"{folder}/.{uuid.uuid4().hex}"  # readers pass over names that begin with a dot
    with open(aside, "w", encoding="utf-8") as out:
        out.write(line)
    try:
        os.link(aside, path)
    except FileExistsError:
        return False
    finally:
        os.unlink(aside)
    return True


def _files(spark: SparkSession, path):
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def expire(spark: SparkSession, root: str, keep: int = 1) -> list[str]:
    """Delete the runs under ``root`` but the ``keep`` newest announced ones; returns the deleted folders.

    Runs that failed before they were announced go too, so call it while nobody writes. Readers of an older
    version must be done; the newest is never deleted.
    """
    if keep < 1:
        raise ValueError("the current run cannot expire")
    kept = {row["run"].rsplit("/", 1)[-1] for row in announced(spark, root).orderBy(F.col("version").desc()).head(keep)}
    if not kept:
        raise LookupError(f"nothing published under {root}")
    runs = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{root.rstrip('/')}/runs")
    files = _files(spark, runs)
    old = [status.getPath() for status in files.listStatus(runs) if status.getPath().getName() not in kept]
    for path in old:
        files.delete(path, True)
    return [path.toString() for path in old]


def write_table(df: DataFrame, path: str, partition_by: Sequence[str] = (), **options: str) -> None:
    """Write ``df``, in evenly sized files even where one partition value holds most rows."""
    if not partition_by:
        df.write.options(**options).parquet(path)
        return
    guarded = df.withColumns({c: _kept_by_folders(df, c) for c in partition_by})
    guarded.hint("rebalance", *partition_by).write.options(**options).partitionBy(*partition_by).parquet(path)


def _kept_by_folders(df: DataFrame, column: str) -> Column:
    """A folder name cannot tell an empty string from NULL: refuse it rather than lose it."""
    if df.schema[column].dataType.simpleString() != "string":
        return F.col(column)
    problem = F.raise_error(F.lit(f"empty {column} cannot be kept as a partition"))
    return F.when(F.col(column) == "", problem).otherwise(F.col(column))


def read_table(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    return shaped(spark.read.schema(schema).parquet(path), schema)


def write_manifest(spark: SparkSession, run: str, table: str, schema: StructType, folder: str, ranged: str) -> None:
    """Note the files of a table that lies in folders of ``folder``: rows, and least and greatest ``ranged``, of each."""
    stored = spark.read.schema(schema).parquet(f"{run}/{table}")
    files = stored.groupBy(F.col("_metadata.file_path").alias("file"), F.col(folder).cast("string").alias("value")).agg(
        F.count(F.lit(1)).alias("rows"),
        F.min(ranged).cast("string").alias("low"),
        F.max(ranged).cast("string").alias("high"),
    )
    # The folder and the name: the run may be moved as a whole.
    files.withColumn("file", F.substring_index("file", "/", -2)).write.parquet(f"{run}/manifest/{table}")


def read_manifest(spark: SparkSession, run: str, table: str) -> DataFrame:
    return spark.read.schema(MANIFEST).parquet(f"{run}/manifest/{table}")


def read_folder(
    spark: SparkSession, run: str, table: str, schema: StructType, value: str | None, between: tuple[str, str] | None = None
) -> DataFrame:
    """The files of a table whose folder has ``value`` and whose range meets ``between`` (both ends included), by the manifest.

    Rows outside ``between`` may be among them. All that reaches the driver is the names of these files.
    """
    wanted = read_manifest(spark, run, table).filter(F.col("value").eqNullSafe(F.lit(value)))
    if between is not None:
        wanted = wanted.filter((F.col("low") <= between[1]) & (F.col("high") >= between[0]))
    names = [f"{run}/{table}/{unquote(row['file'])}" for row in wanted.select("file").collect()]
    if not names:
        return spark.createDataFrame([], schema)
    return shaped(spark.read.schema(schema).option("basePath", f"{run}/{table}").parquet(*names), schema)

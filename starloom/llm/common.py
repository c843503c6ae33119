"""Small helpers shared by the operators."""

import contextlib
import ctypes
import functools
import tempfile
import zipfile
from collections.abc import Iterator, Sequence
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from starloom.scratch import staged


@functools.cache
def ship_package(spark: SparkSession) -> None:
    """Hand this package to the executors, whose workers import it wherever the driver was started."""
    package = Path(__file__).parents[1]
    archive = Path(tempfile.mkdtemp(prefix="starloom-")) / "starloom.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for source in package.rglob("*.py"):
            out.write(source, source.relative_to(package.parent))
    spark.sparkContext.addPyFile(str(archive))


@contextlib.contextmanager
def arrow_batches(spark: SparkSession, size: int) -> Iterator[None]:
    """Arrow batches of about ``size`` bytes for the jobs that run inside; a batch lies in the executor and in its worker."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(size))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def release_memory() -> None:
    """Hand what is free in this Python worker back to the system: workers outlive the stage that filled them."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # of the GNU library
        trim(0)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(df: DataFrame, name: str) -> str:
    """``name``, or a longer one if ``df`` has such a column already (Spark ignores the case of names)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def ddl(df: DataFrame, **names: str) -> str:
    """A schema string that gives columns of ``df`` new names: ``ddl(df, id="doc_id")`` is ``id <its type>``."""
    return ", ".join(f"{quoted(new)} {df.schema[old].dataType.simpleString()}" for new, old in names.items())


def table_parts(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def written_in_order(df: DataFrame, order: Sequence, label: str) -> DataFrame:
    """``df`` sorted into ranges and written, with ``part`` and ``place``: the row is the ``place``-th of its range.

    Ranges follow each other in ``order``, so the number of rows before a range plus ``place`` is the
    position among all rows. Nothing but a count per range is needed for that: see ``rows_before``.
    """
    row_id = F.monotonically_increasing_id()
    ranges = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("part", row_id)
    bits = 33  # of the id, for the place; the partition stands above
    return staged(
        ranges.withColumn("place", F.col("part").bitwiseAND((1 << bits) - 1)).withColumn(
            "part", F.shiftright("part", bits)
        ),
        label,
    )


def running_before(df: DataFrame, value: str, name: str, order: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """Add ``name``: the sum of ``value`` over the rows before, by ``order``. For tables with a row per task."""
    rows_before = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn(name, F.coalesce(F.sum(value).over(rows_before), F.lit(0)).cast("long"))


def batches_of(rows, schema: pa.Schema, size: int):
    """Arrow batches of ``size`` rows from an iterable of tuples."""
    held = []
    for row in rows:
        held.append(row)
        if len(held) >= size:
            yield to_batch(held, schema)
            held = []
    if held:
        yield to_batch(held, schema)


def to_batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [[] for _ in schema]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def arrow_schema(spark_schema: str | StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = StructType.fromDDL(spark_schema) if isinstance(spark_schema, str) else spark_schema
    return to_arrow_schema(schema)

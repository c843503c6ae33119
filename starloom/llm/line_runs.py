"""Line dedup over sorted runs of line hashes.

A run is a table of line hashes, cut into buckets by hash and sorted in each. A batch of documents is merged
with the runs there are: lines found in none of them (the anti-join) are first seen in this batch, all others only add to
their counts. The outcome is one more run. When a level has as many runs as the fan-out they are merged into one run of the next
level, so a hash is rewritten once a level, and a batch meets few runs. Only the batch crosses the network; runs lie
in the buckets that the merge needs.
"""

import uuid

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType
from xxhash import xxh3_128_intdigest

from starloom.llm.common import arrow_batches, arrow_schema, ddl, table_parts
from starloom.scratch import scratch_path, staged

LEAST_POINTS, LEAST_DOCS = 40, 5
FAN_OUT, BATCHES = 4, 8
BLANKS = b" \t\n\v\f\r"
KEY = ["h1", "h2"]
BATCH_BYTES = 6 << 20


class LineRuns:
    """Runs of line hashes at ``path``, and what they say of each hash: ``n`` documents, ``keeper`` in the batch seen first.

    ``runs`` are (level, name, path, buckets), the oldest first. Every change of them is a version of the manifest at
    ``path``, added after the run it names is complete, so that a job that fails leaves the version before. As a context
    it takes the names that its runs have in the catalog away at the end; their files stay.
    """

    def __init__(self, spark: SparkSession, path: str, fan_out: int = FAN_OUT):
        self.spark, self.path, self.fan_out = spark, path, fan_out
        self.version, self.runs = 0, []
        try:
            rows = spark.read.parquet(f"{path}/manifest")
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return
        self.version = rows.agg(F.max("version")).first()[0]
        for row in rows.filter(F.col("version") == self.version).orderBy("nth").collect():  # a few runs a level
            name = f"line_run_{uuid.uuid4().hex}"
            spark.sql(
                f"CREATE TABLE {name} ({row.ddl}) USING parquet CLUSTERED BY (h1, h2) SORTED BY (h1, h2) "
                f"INTO {row.buckets} BUCKETS LOCATION '{row.path}'"
            )
            self.runs.append((row.level, name, row.path, row.buckets))

    def _written(self, entries: DataFrame, level: int) -> tuple:
        name, buckets = f"line_run_{uuid.uuid4().hex}", table_parts(entries)
        path = f"{self.path}/{name}"
        sorted_run = entries.repartition(buckets, *KEY).write.bucketBy(buckets, *KEY).sortBy(*KEY)
        sorted_run.option("path", path).saveAsTable(name)
        return level, name, path, buckets

    def _announce(self, runs: list[tuple]) -> None:
        replaced = [name for _, name, _, _ in self.runs if name not in {r[1] for r in runs}]
        self.version, self.runs = self.version + 1, runs
        schema = self.spark.table(runs[0][1]).schema
        columns = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in schema)
        rows = [(self.version, nth, level, path, buckets, columns) for nth, (level, _, path, buckets) in enumerate(runs)]
        manifest = self.spark.createDataFrame(rows, "version int, nth int, level int, path string, buckets int, ddl string")
        manifest.coalesce(1).write.mode("append").parquet(f"{self.path}/manifest")
        self._forget(replaced)

    def _forget(self, names: list[str]) -> None:
        for name in names:  # the name in the catalog only; the files stay for readers of earlier versions
            self.spark.sql(f"DROP TABLE {name}")

    def __enter__(self) -> "LineRuns":
        return self

    def __exit__(self, *problem) -> None:
        self._forget([name for _, name, _, _ in self.runs])
        self.runs = []

    def add(self, entries: DataFrame) -> None:
        """Merge a batch, a row per hash: ``h1``, ``h2``, ``n`` (its documents) and ``keeper`` (the one to keep it)."""
        merged = entries.withColumn("first", F.lit(True))
        for _, name, _, _ in self.runs:
            seen = self.spark.table(name).filter("first").select(*KEY, F.lit(True).alias("seen"))
            merged = merged.join(seen, KEY, "left").withColumn("first", F.col("first") & F.col("seen").isNull()).drop("seen")
        merged = merged.select(*KEY, "n", "first", F.when(F.col("first"), F.col("keeper")).alias("keeper"))
        runs = [*self.runs, self._written(merged, 0)]
        self._announce(runs)
        while len(full := [r for r in self.runs if r[0] == self.runs[-1][0]]) >= self.fan_out:
            whole = self._written(self._summed(full), full[0][0] + 1)
            self._announce([r for r in self.runs if r not in full] + [whole])

    def _summed(self, runs: list[tuple]) -> DataFrame:
        """A row per hash; at most one of its rows is the first, and only that one names the keeper."""
        # Read as plain files: Spark 4.1 wrongly takes a union of bucketed tables for one that needs no exchange.
        every = self.spark.read.schema(self.spark.table(runs[0][1]).schema).parquet(*[path for _, _, path, _ in runs])
        sums = F.sum("n").alias("n"), F.bool_or("first").alias("first"), F.max("keeper").alias("keeper")
        return every.groupBy(*KEY).agg(*sums)

    def summary(self) -> DataFrame:
        """``h1``, ``h2``, ``n`` and ``keeper`` of every hash in any run."""
        return self._summed(self.runs).select(*KEY, "n", "keeper")


def line_keys(docs: DataFrame, least_points: int, id_col: str, text_col: str) -> DataFrame:
    """``id``, ``tie`` (a hash of the text), ``pos`` and the hash ``h1``, ``h2`` of each line whose key is long enough."""
    rows = docs.filter(F.length(text_col) >= least_points)
    rows = rows.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("tie"), F.col(text_col).alias("text"))
    schema = f"{ddl(rows, id='id', tie='tie')}, pos int, h1 bigint, h2 bigint"
    out_schema = arrow_schema(schema)

    def hashed(text: bytes):
        for pos, line in enumerate(text.split(b"\n")):
            key = line.strip(BLANKS)
            if len(key) >= least_points and (key.isascii() or len(key.decode()) >= least_points):
                yield pos, xxh3_128_intdigest(key.lower()).to_bytes(16, "little")

    def run(batches):
        for batch in batches:
            at, places, hashes = [], [], []
            for i, text in enumerate(batch.column("text")):
                for pos, key in hashed(text.as_py().encode()):
                    at.append(i)
                    places.append(pos)
                    hashes.append(key)
            both = pa.Array.from_buffers(pa.int64(), 2 * len(hashes), [None, pa.py_buffer(b"".join(hashes))])
            first = pa.array(range(0, len(both), 2), pa.int64())
            own = batch.select(["id", "tie"]).take(pa.array(at, pa.int64()))
            second = pa.array(range(1, len(both), 2), pa.int64())
            columns = [own.column("id"), own.column("tie"), pa.array(places, pa.int32()), both.take(first), both.take(second)]
            yield pa.RecordBatch.from_arrays(columns, schema=out_schema)

    return rows.mapInArrow(run, schema)


def dedup_lines(
    docs: DataFrame, path: str, least_points: int = LEAST_POINTS, least_docs: int = LEAST_DOCS, batches: int = BATCHES,
    fan_out: int = FAN_OUT, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """Every row's ``id_col``, ``n_lines``, ``n_dropped`` and its text without the lines that are kept elsewhere.

    A line's key is the line without ASCII white space at its ends and with A-Z as a-z. A key of ``least_points`` code points
    or more that is in ``least_docs`` documents or more stays in the one of largest id only, with all its lines there; the
    other documents lose theirs. Other lines stay as they are, joined by line feeds.

    Documents go into ``LineRuns`` at ``path`` in ``batches`` ranges of falling id, so the batch that a key is first seen in has its
    largest id. Keys are known by 128 bits of their hash. Texts are read twice and move once, to meet their dropped
    places. A key in a third of all documents is summed before it is shuffled, and meets its lines
    in a join that adaptive execution splits.

    The id must be a number. Rows with equal ids are one document for the counts and the choice, each with its own lines. Null
    ids are one document too, below all others. A null text is one empty line, like an empty one. Other columns are not
    read. An empty table gives an empty result.
    """
    if not isinstance(docs.schema[id_col].dataType, NumericType):
        raise TypeError(f"{id_col} must be a number")
    spark = docs.sparkSession
    cuts = F.percentile_approx(id_col, [n / batches for n in range(1, batches)], 1000)
    bounds = sorted(set(docs.agg(cuts).first()[0] or []))
    batch = sum((F.when(F.col("id") <= b, 1).otherwise(0) for b in bounds), F.lit(0))
    batch = F.when(F.col("id").isNull(), len(bounds)).otherwise(batch).cast("int")
    lines_path = scratch_path(spark, "line-keys")
    with arrow_batches(spark, BATCH_BYTES):
        keys = line_keys(docs, least_points, id_col, text_col).withColumn("batch", batch)
        keys.write.partitionBy("batch").parquet(lines_path)
    lines = spark.read.schema(keys.schema).parquet(lines_path)
    with LineRuns(spark, path, fan_out) as runs:
        for n in range(len(bounds) + 1):
            per_doc = lines.filter(F.col("batch") == n).select(*KEY, "id").distinct()
            runs.add(per_doc.groupBy(*KEY).agg(F.count(F.lit(1)).alias("n"), F.max("id").alias("keeper")))
        repeated = staged(runs.summary().filter(F.col("n") >= least_docs).drop("n"), "line-repeats")
    lost = lines.join(repeated, KEY).filter(~F.col("id").eqNullSafe(F.col("keeper")))
    # A set, bounded by the lines of one text however often the row is repeated.
    lost = lost.groupBy("id", "tie").agg(F.collect_set("pos").alias("lost"))
    lost = staged(lost.select(F.col("id").alias("lost_id"), F.col("tie").alias("lost_tie"), "lost"), "line-drops")

    @F.arrow_udf("string")
    def without(texts: pa.Array, lost: pa.Array) -> pa.Array:
        out = []
        for text, places in zip(texts, lost, strict=True):
            if places.is_valid:
                dropped = set(places.as_py())
                out.append("\n".join([x for i, x in enumerate(text.as_py().split("\n")) if i not in dropped]))
            else:
                out.append(None)
        return pa.array(out, pa.string())

    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("tie"), text.alias("text"))
    same = F.col("id").eqNullSafe(F.col("lost_id")) & (F.col("tie") == F.col("lost_tie"))
    met = rows.join(lost, same, "left")
    kept = F.coalesce(without(F.when(F.col("lost").isNotNull(), F.col("text")), F.col("lost")), F.col("text"))
    n_lines = F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))) + 1
    return met.select(
        F.col("id").alias(id_col), "tie", n_lines.cast("long").alias("n_lines"),
        F.coalesce(F.size("lost"), F.lit(0)).cast("long").alias("n_dropped"), kept.alias(text_col),
    )

"""Strict CSV load of the raw tables.

Dialect: header line (its content is ignored), comma, UTF-8, ``"`` both quotes and escapes. An unquoted
empty field is NULL, a quoted one the empty string. Quoted line breaks are data. A record with too few
or too many fields (a blank line is one), or with a field that is not of its column's type, stops the
load; so do a quote inside a field that does not begin and end with one, bytes that are not UTF-8 and a decimal with more places than its column keeps, which Spark
would replace and round in silence.

Files stay splittable. One pass over the lines looks for what is wrong and for line breaks inside quotes:
without any, Spark's own reader takes the files in splits; otherwise the records are put together from
lines, again in splits.
"""

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType, StringType, StructField, StructType, TimestampNTZType

from starloom.scratch import staged
from starloom.sources.schemas import raw_schema

EMPTY = "\x01"
DIALECT = {
    "quote": '"',
    "escape": '"',
    "mode": "FAILFAST",
    "nullValue": "",
    "emptyValue": EMPTY,
    "encoding": "UTF-8",
    # A job that needs few columns must still notice a record with a wrong number of fields.
    "columnPruning": "false",
}
BLOCK = ("file", "block")
MAX_RECORD = 16 << 20  # characters of a record with line breaks, which is put together in one task
AS_TEXT = (DecimalType, TimestampNTZType)


def read_raw_csv(spark: SparkSession, table: str, path: str | list[str]) -> DataFrame:
    return read_csv(spark, raw_schema(table), path)


def read_csv(spark: SparkSession, schema: StructType, path: str | list[str]) -> DataFrame:
    # Decimals and times arrive as text, so that excess places and missing days can be told.
    textual = StructType(
        [StructField(f.name, StringType() if isinstance(f.dataType, AS_TEXT) else f.dataType) for f in schema]
    )
    lines = _lines(spark, path)
    if _records_span_lines(lines):
        parsed = _parsed(_records(staged(lines, "csv-lines", compression="zstd")), textual)
    else:
        parsed = spark.read.schema(textual).options(header=True, **DIALECT).csv(path)
    return parsed.select(*[_typed(field).alias(field.name) for field in schema])


def _lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Physical lines; ``at`` grows along the lines of a block, ``odd`` marks a change of quotedness."""
    value = F.col("value")
    quotes = F.length(value) - F.length(F.replace(value, F.lit('"'), F.lit("")))
    return spark.read.text(path, lineSep="\n").select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("at"),
        (quotes % 2).alias("odd"),
        (F.length(value) + 1).alias("size"),
        "value",
    )


def _stray_quote(record: Column) -> Column:
    """Whether quotes stand elsewhere than around whole fields, or doubled inside such a field.

    With every quoted stretch written as one mark, a run of marks must begin and end at a comma or at an end.
    """
    marks = F.regexp_replace(record, '"[^"]*"', '"')
    return record.contains('"') & marks.rlike('[^,"]"|"[^,"]')


def _records_span_lines(lines: DataFrame) -> bool:
    line = F.rtrim(F.col("value"), F.lit("\r"))
    found = lines.agg(
        F.max((F.col("odd") == 1) | line.contains("\r")).alias("spanning"),
        # Spark's reader skips every line that trims to nothing, be it the header.
        F.max(line.rlike(r"^[\x00-\x20]*$")).alias("blank"),
        F.max(_stray_quote(line)).alias("stray"),
        F.max(line.contains(EMPTY)).alias("reserved"),
        F.max(~F.is_valid_utf8("value")).alias("invalid"),
    ).head()
    if found["invalid"]:
        raise ValueError("input is not UTF-8")
    if found["reserved"]:
        raise ValueError(f"input contains {EMPTY!r}, which stands for empty strings while loading")
    if found["blank"] and not found["spanning"]:
        raise ValueError("input contains a blank line")
    if found["stray"] and not found["spanning"]:
        raise ValueError("input contains a quote inside a field")
    return bool(found["spanning"])


def _records(lines: DataFrame) -> DataFrame:
    """One ``record`` per row, header dropped, from a written table of lines.

    A line starts a record when the quotes before it in its file are even. That count is the quotes
    before the block plus those before the line in its block: blocks are bounded by the split size, and
    one row per block is all that a whole file is ever reduced to, written once. Only lines of records with
    line breaks are grouped, where their block is; the others are records as they stand. What moves again is
    records that go on in another block.
    """
    in_block = Window.partitionBy(*BLOCK).orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    counted = lines.withColumn("_odds", F.coalesce(F.sum("odd").over(in_block), F.lit(0)))
    even_before = F.col("_odds") % 2 == 0
    blocks = counted.groupBy(*BLOCK).agg(
        F.sum("odd").alias("_flips"),
        F.min("at").alias("_first"),
        F.max(F.when(even_before, F.col("at"))).alias("_start_if_even"),
        F.max(F.when(~even_before, F.col("at"))).alias("_start_if_odd"),
    )
    in_file = Window.partitionBy("file").orderBy("block")
    earlier = in_file.rowsBetween(Window.unboundedPreceding, -1)
    opened = F.coalesce(F.sum("_flips").over(earlier), F.lit(0))
    blocks = blocks.withColumn("_opened", opened % 2).withColumn(
        "_last_start",
        F.when(F.col("_opened") == 0, F.struct("block", F.col("_start_if_even").alias("at")))
        .when(F.col("_start_if_odd").isNotNull(), F.struct("block", F.col("_start_if_odd").alias("at"))),
    )
    blocks = blocks.withColumn(
        "_last_start", F.when(F.col("_last_start.at").isNotNull(), F.col("_last_start"))
    ).select(
        *BLOCK,
        "_opened",
        F.last("_last_start", ignorenulls=True).over(earlier).alias("_carried"),
        F.first("_first").over(in_file).alias("_header"),
    )
    blocks = staged(blocks, "csv-blocks")
    unclosed = lines.groupBy("file").agg((F.sum("odd") % 2).alias("odd")).filter("odd = 1").head(1)
    if unclosed:
        raise ValueError(f"unterminated quoted field in {unclosed[0]['file']}")

    here = F.struct("block", "at")
    starts = (F.col("_odds") + F.col("_opened")) % 2 == 0
    up_to_here = Window.partitionBy(*BLOCK).orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    placed = (
        counted.join(blocks, list(BLOCK))
        .withColumn("_starts", starts)
        .withColumn(
            "_start",
            F.coalesce(F.max(F.when(F.col("_starts"), here)).over(up_to_here), F.col("_carried")),
        )
        .filter(F.col("_start.at") != F.col("_header"))
    )
    whole = F.col("_starts") & (F.col("odd") == 0)
    _refuse_endless(lines, placed.filter(~whole))
    in_order = F.sort_array(F.collect_list(F.struct("at", "value")))
    pieces = placed.filter(~whole).groupBy("_start", *BLOCK).agg(in_order.alias("_lines"), F.sum("odd").alias("_odd"))
    pieces = pieces.select("_start", *BLOCK, F.array_join(F.col("_lines.value"), "\n").alias("value"), "_odd")
    within = (F.col("_start.block") == F.col("block")) & (F.col("_odd") % 2 == 0)
    across = pieces.filter(~within).groupBy("file", "_start").agg(
        F.sort_array(F.collect_list(F.struct("block", "value"))).alias("_parts")
    )
    records = placed.filter(whole).select(F.col("value").alias("record"))
    records = records.unionByName(pieces.filter(within).select(F.col("value").alias("record")))
    records = records.unionByName(across.select(F.array_join(F.col("_parts.value"), "\n").alias("record")))
    record = F.regexp_replace("record", "\r$", "")
    blank = F.raise_error(F.lit("input contains a blank line"))
    stray = F.raise_error(F.lit("input contains a quote inside a field"))
    return records.select(F.when(record == "", blank).when(_stray_quote(record), stray).otherwise(record).alias("record"))


def _refuse_endless(lines: DataFrame, pieces: DataFrame) -> None:
    """Stop at a record of more than ``MAX_RECORD`` characters, as a forgotten quote makes it, before it is gathered."""
    sizes = pieces.groupBy("file", "_start").agg(F.sum("size").alias("size"))
    found = sizes.filter(F.col("size") > MAX_RECORD).orderBy("file", "_start").head()
    if found is None:
        return
    start = F.struct(F.lit(found["_start"]["block"]).alias("block"), F.lit(found["_start"]["at"]).alias("at"))
    line = lines.filter((F.col("file") == found["file"]) & (F.struct("block", "at") <= start)).count()
    raise ValueError(f"the record at line {line} of {found['file']} has {found['size']} characters: is a quote missing?")


def _parsed(records: DataFrame, schema: StructType) -> DataFrame:
    fields = F.from_csv("record", schema.toDDL(), {**DIALECT, "lineSep": "\n"})
    return records.select(fields.alias("r")).select("r.*")


def _typed(field: StructField) -> Column:
    value = F.col(field.name)
    if isinstance(field.dataType, StringType):
        return F.when(value == EMPTY, "").otherwise(value)
    if isinstance(field.dataType, DecimalType):
        return _exact_decimal(value, field.dataType)
    if isinstance(field.dataType, TimestampNTZType):
        return _full_time(value)
    return value


def _full_time(text: Column) -> Column:
    """``text`` as a time; anything without a full date stops the job."""
    full = text.rlike(r"^\s*\d{4,6}-\d{1,2}-\d{1,2}([ T]\d{1,2}:\d{1,2}(:\d{1,2}(\.\d*)?)?)?\s*$")
    problem = F.concat(F.lit("not a date or time: "), text)
    return F.when(text.isNull() | full, F.trim(text).cast("timestamp_ntz")).otherwise(F.raise_error(problem))


def _exact_decimal(text: Column, kind: DecimalType) -> Column:
    """``text`` as ``kind``; anything but plain digits within the scale stops the job."""
    places = F.length(F.rtrim(F.regexp_extract(text, r"\.(\d*)$", 1), F.lit("0")))
    plain = text.rlike(r"^\s*[+-]?(\d+\.?\d*|\.\d+)$") & (places <= kind.scale)
    problem = F.concat(F.lit(f"not a {kind.simpleString()}: "), text)
    return F.when(text.isNull() | plain, text.cast(kind)).otherwise(F.raise_error(problem))

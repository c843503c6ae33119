"""Token counts: batches are encoded in Arrow functions that return lengths only."""

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from starloom.llm.common import arrow_schema, ddl
from starloom.llm.tokens import encoder


def token_counts(
    docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 2048
) -> DataFrame:
    """One row per row of ``docs``: the id, ``n_bytes`` (UTF-8), ``n_tokens`` and ``over_limit`` (more than ``limit``).

    Counts are the library's for the whole text: no added special tokens, no truncation; strings of special
    tokens inside a text count as the library takes them by default. No shuffle: texts are read where they lie and
    only lengths come back. Within a task texts go to the library in batches of about the same number of
    characters, and longer texts are split where no token can span.

    A null text counts as empty (0 bytes, 0 tokens). Ids may be null or repeat; each row gives one row. Other
    columns, whatever their names, are not read. An empty table gives an empty result.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), F.octet_length(text).cast("long").alias("n_bytes"), text.alias("text"))
    schema = f"{ddl(rows, id='id')}, n_bytes bigint, n_tokens bigint"
    out_schema = arrow_schema(schema)

    def count(batches):
        encode = encoder(vocabulary)
        for batch in batches:
            counts = pa.array(encode.counts(batch.column("text")), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("n_bytes"), counts], schema=out_schema)

    return rows.mapInArrow(count, schema).select(
        F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit")
    )

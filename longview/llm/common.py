"""What the operators of this package share: table reading, byte words, per-row Arrow work."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from longview.session import small_batches

#: Six separators: blank, tab, line feed, vertical tab, form feed, carriage return.
SPACE = r"[\x20\x09-\x0D]"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def byte_words(text: bytes) -> list[bytes]:
    """Words between the six ASCII separators, A-Z lower-cased; other bytes stay as they are."""
    return text.lower().split()


def map_text(df: DataFrame, keep: Sequence[str], text: str, make: Callable[[list[bytes]], list[pa.Array]],
             fields: Sequence[tuple[str, T.DataType]]) -> DataFrame:
    """The columns ``keep`` of every row, and what ``make`` computes from the row's text.

    ``make`` gets the texts of one Arrow batch as UTF-8 bytes (null: empty) and returns one array for each field.
    """
    small_batches(df.sparkSession)
    src = df.select(*keep, F.coalesce(F.col(text), F.lit("")).cast("binary").alias("__text"))
    schema = T.StructType([*src.schema.fields[:-1], *(T.StructField(n, t) for n, t in fields)])
    names = schema.names

    def run(batches):
        for batch in batches:
            cols = [batch.column(i) for i in range(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*cols, *make(batch.column(batch.num_columns - 1).to_pylist())], names=names)

    return src.mapInArrow(run, schema)

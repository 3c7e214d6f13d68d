"""Writers (S7-S9, S11). All go through Spark's commit protocol."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from longview.functions.text import finite
from longview.operators.cohort import viewer_order


def write_table(df: DataFrame, path: str, partition_by: list[str] | None = None, mode: str = "overwrite") -> None:
    """Parquet (S7); splits are best partitioned by split, so readers prune."""
    df.write.mode(mode).partitionBy(*(partition_by or [])).parquet(path)


def write_labels(df: DataFrame, path: str) -> None:
    """Labels as CSV that the label reader accepts."""
    df.write.mode("overwrite").csv(path, header=True)


def _guard(c: Column, dtype: T.DataType) -> Column:
    if isinstance(dtype, (T.DoubleType, T.FloatType)):
        return finite(c)
    if isinstance(dtype, T.ArrayType) and _needs(dtype.elementType):
        return F.transform(c, lambda v: _guard(v, dtype.elementType))
    if isinstance(dtype, T.MapType) and _needs(dtype.valueType):
        return F.transform_values(c, lambda _, v: _guard(v, dtype.valueType))
    if isinstance(dtype, T.StructType) and _needs(dtype):
        made = F.struct(*[_guard(c[f.name], f.dataType).alias(f.name) for f in dtype.fields])
        return F.when(c.isNotNull(), made)
    return c


def _needs(dtype: T.DataType) -> bool:
    if isinstance(dtype, T.StructType):
        return any(_needs(f.dataType) for f in dtype.fields)
    if isinstance(dtype, T.ArrayType):
        return _needs(dtype.elementType)
    if isinstance(dtype, T.MapType):
        return _needs(dtype.valueType)
    return isinstance(dtype, (T.DoubleType, T.FloatType))


def json_safe(df: DataFrame) -> DataFrame:
    """NaN and infinities to null at any depth, so JSON stays valid."""
    return df.select(*[_guard(F.col(f.name), f.dataType).alias(f.name) for f in df.schema.fields])


def json_document(df: DataFrame, key: str) -> DataFrame:
    """Each row as one JSON text beside its key; nulls are written out."""
    safe = json_safe(df)
    return safe.select(key, F.to_json(F.struct(*safe.columns), {"ignoreNullFields": "false"}).alias("document"))


def write_json(df: DataFrame, path: str) -> None:
    json_safe(df).write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def write_index(entries: DataFrame, path: str) -> None:
    """The viewer index, ordered by patient, date and kernel (S11); a range sort, not one task."""
    write_json(viewer_order(entries), path)

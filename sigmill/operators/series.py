"""Numbering, carrying forward and differences along recordings of any length: range buckets and a small second pass.

A recording is cut into buckets of its order column. What depends on the order is worked out inside each bucket, and one
row a bucket (its size, its last value) is carried along the recording and joined back. So no task sorts more than a
bucket, and what is sorted over a whole recording has one row a bucket.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Seconds of a bucket: at 250 samples a second, 900,000 rows.
SECONDS = 3600.0
#: Buckets of rows whose order column is null (first, as in Spark's ascending order) or NaN (last).
FIRST, LAST = -(1 << 62), 1 << 62


def bucket(at: Column, width: float) -> Column:
    """The number of the bucket; nulls and NaN have buckets of their own at the two ends."""
    return F.when(at.isNull(), F.lit(FIRST)).when(F.isnan(at.cast("double")), F.lit(LAST)).otherwise(F.floor(at / F.lit(width)).cast("long"))


def _placed(df: DataFrame, order: Sequence[str | Column], width: float) -> tuple[DataFrame, list[Column]]:
    order = [F.col(c) if isinstance(c, str) else c for c in order]
    return df.withColumn("_b", bucket(order[0], width)), order


def _since(keys: Sequence[str]):
    """The buckets before each bucket of a series; a row a bucket."""
    return Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)


def number(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], width: float = SECONDS, name: str = "sample_idx") -> DataFrame:
    """``name``: the row's place from 0 in its series, ordered by ``order``, of which the first column makes the buckets."""
    placed, order = _placed(df, order, width)
    sizes = placed.groupBy(*keys, "_b").agg(F.count("*").alias("_n"))
    before = sizes.select(*keys, "_b", F.coalesce(F.sum("_n").over(_since(keys)), F.lit(0)).alias("_before"))
    at = F.row_number().over(Window.partitionBy(*keys, "_b").orderBy(*order)).cast("long") - 1
    numbered = placed.withColumn("_at", at).join(before, [*keys, "_b"])
    return numbered.withColumn(name, F.col("_before") + F.col("_at")).drop("_b", "_at", "_before").select(*_columns(df, name))


def carry(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], value: Column, name: str, width: float = SECONDS) -> DataFrame:
    """``name``: the last ``value`` that is not null, at the row or before it in its series."""
    placed, order = _placed(df.withColumn("_v", value), order, width)
    ends = placed.filter("_v is not null").groupBy(*keys, "_b").agg(F.max_by("_v", F.struct(*order)).alias("_last"))
    # buckets without a value have no row: each of the others is what the next ones start from
    every = placed.groupBy(*keys, "_b").agg(F.lit(1).alias("_one")).join(ends, [*keys, "_b"], "left")
    opening = every.select(*keys, "_b", F.last("_last", ignorenulls=True).over(_since(keys)).alias("_opening"))
    inside = Window.partitionBy(*keys, "_b").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    found = placed.withColumn("_own", F.last("_v", ignorenulls=True).over(inside)).join(opening, [*keys, "_b"])
    return found.withColumn(name, F.coalesce("_own", "_opening")).select(*_columns(df, name))


def previous(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], column: str, name: str, width: float = SECONDS) -> DataFrame:
    """``name``: the value of ``column`` in the row before, in the order of the series; null in its first row."""
    placed, order = _placed(df, order, width)
    ends = placed.groupBy(*keys, "_b").agg(F.max_by(F.struct(column), F.struct(*order)).alias("_last"))
    opening = ends.select(*keys, "_b", F.lag("_last").over(Window.partitionBy(*keys).orderBy("_b"))[column].alias("_opening"))
    inside = Window.partitionBy(*keys, "_b").orderBy(*order)
    found = placed.withColumn("_r", F.row_number().over(inside)).withColumn("_own", F.lag(column).over(inside)).join(opening, [*keys, "_b"])
    return found.withColumn(name, F.when(F.col("_r") == 1, F.col("_opening")).otherwise(F.col("_own"))).select(*_columns(df, name))


def _columns(df: DataFrame, name: str) -> list[str]:
    return [*df.columns, *([] if name in df.columns else [name])]

"""Signals made of the driver's tables, in Spark and as DuckDB text for the oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sigmill.operators import series

FS = 250.0
#: What the line items of a long series are ordered by, and how many order keys a bucket of them spans.
LINE_ORDER, ORDERS = ["l_orderkey", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity"], float(1 << 20)

# The band schemes of the two spectral chains and the alpha band.
BANDS = [
    ("fft5", "alpha", 8.0, 12.0), ("fft5", "beta", 12.0, 30.0), ("fft5", "gamma", 30.0, 60.0), ("fft5", "delta", 0.0, 4.0), ("fft5", "theta", 4.0, 8.0),
    ("welch5", "delta", 1.0, 4.0), ("welch5", "theta", 4.0, 8.0), ("welch5", "alpha", 8.0, 13.0), ("welch5", "beta", 13.0, 30.0), ("welch5", "gamma", 30.0, 100.0),
    ("alpha", "alpha", 8.0, 13.0),
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``recording_id, sample_idx, t_s, ch``: 8 recordings of 8 channels from the embeddings."""
    e = table(spark, sf_dir, "embeddings")
    return e.select(
        F.explode(F.sequence(F.lit(0), F.lit(7))).alias("recording_id"), F.col("vec_id").alias("sample_idx"), F.col("embedding").alias("_e")
    ).select("recording_id", "sample_idx", (F.col("sample_idx") / F.lit(FS)).alias("t_s"), F.slice("_e", F.col("recording_id") * 8 + 1, 8).cast("array<double>").alias("ch"))


def _line_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(*LINE_ORDER, (F.col("l_suppkey") % 4).cast("int").alias("recording_id"), F.col("l_linenumber").cast("int").alias("channel"))


def long_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``recording_id, channel, sample_idx, t_s, value``: 28 long series from the line items."""
    w = Window.partitionBy("recording_id", "channel").orderBy(*LINE_ORDER)
    return _samples(_line_items(spark, sf_dir).withColumn("sample_idx", F.row_number().over(w).cast("long") - 1))


def long_samples_in_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same rows, numbered in ranges of ORDERS order keys: no task sorts a whole series. Recording and channel are one number
    meanwhile, nulls -9 (recordings are -3 to 3) and one above all channels: null series stay, and one number sorts faster."""
    recording, channel = F.coalesce("recording_id", F.lit(-9)).cast("long"), F.coalesce(F.col("channel").cast("long"), F.lit(1 << 31))
    l = _line_items(spark, sf_dir).withColumn("_series", F.shiftleft(recording, 33) + channel)
    return _samples(series.number(l, ["_series"], LINE_ORDER, ORDERS))


def _samples(numbered: DataFrame) -> DataFrame:
    return numbered.select("recording_id", "channel", "sample_idx", (F.col("sample_idx") / F.lit(FS)).alias("t_s"), F.col("l_extendedprice").cast("double").alias("value"))


def irregular(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``recording_id, sample_idx, t_s, value``: series with jitter from the events."""
    e = table(spark, sf_dir, "events").select(F.col("event_type").alias("recording_id"), (F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(1e6)).alias("t_s"), F.col("value").cast("double").alias("value"))
    w = Window.partitionBy("recording_id").orderBy("t_s")
    return e.select("recording_id", (F.row_number().over(w).cast("long") - 1).alias("sample_idx"), "t_s", "value")


def bands(scheme: str) -> list[tuple[str, float, float]]:
    """``(band, fmin, fmax)`` of a scheme."""
    return [b[1:] for b in BANDS if b[0] == scheme]


FRAMES_SQL = """frames as (
  select r.range::int as recording_id, vec_id as sample_idx, vec_id / 250.0::double as t_s,
         [x::double for x in embedding[8 * r.range + 1 : 8 * r.range + 8]] as ch
  from embeddings, range(8) r)"""

LONG_SQL = """long_samples as (
  select recording_id, channel, sample_idx, sample_idx / 250.0::double as t_s, value from (
    select (l_suppkey % 4)::int as recording_id, l_linenumber::int as channel, l_extendedprice::double as value,
           row_number() over (partition by l_suppkey % 4, l_linenumber
                              order by l_orderkey, l_partkey, l_suppkey, l_extendedprice, l_quantity) - 1 as sample_idx
    from lineitem))"""

IRREGULAR_SQL = """irregular as (
  select event_type as recording_id, row_number() over (partition by event_type order by ts) - 1 as sample_idx,
         epoch_us(ts) / 1e6::double as t_s, value::double as value from events)"""

BANDS_SQL = "bands(scheme, band, fmin, fmax) as (values " + ", ".join(f"('{s}', '{b}', {lo}::double, {hi}::double)" for s, b, lo, hi in BANDS) + ")"

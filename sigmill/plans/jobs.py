"""Whole chains over many recordings."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from sigmill.functions import kernels as K
from sigmill.operators import frames as O
from sigmill.operators import signals as S
from sigmill.sources import recordings as R


def _packed(*columns: str):
    """Arrays of the named columns in sample order, from one collected list."""
    rows = F.array_sort(F.collect_list(F.struct("sample_idx", *columns)))
    return rows.alias("_s"), [F.col("_s")[c].alias(c) for c in columns]


def denoise_recordings(frames: DataFrame, seconds: float = 4.0, alpha: tuple[float, float] = (8.0, 13.0)) -> DataFrame:
    """Clean the middle of every recording and compare the alpha power before and after, for every channel.

    ``recording_id, channel, fs, n, z (array), power_raw, power_proc, difference, percent, envelope_raw,
    envelope_proc``. One aggregation gives both the rate and the bounds of the slice; the slice is cut before anything
    is packed. The common average is taken row by row, before the filters, which it commutes with, so that channels
    are apart from the one real shuffle on. The steps are the library's operators, on arrays at their own rates.
    Channels whose slice is too short for the filters have null results.
    """
    info = frames.groupBy("recording_id").agg(F.count("t_s").alias("_n"), F.min("t_s").alias("_a"), F.max("t_s").alias("_b"))
    info = info.select("recording_id", ((F.col("_n") - 1) / F.nullif(F.col("_b") - F.col("_a"), F.lit(0.0))).alias("fs"), (F.col("_a") + (F.col("_b") - F.col("_a")) / 2).alias("_mid"))
    cut = frames.join(info, "recording_id").filter(F.col("t_s").between(F.col("_mid"), F.col("_mid") + seconds))
    return _cleaned(cut, alpha)


def _cleaned(cut: DataFrame, alpha: tuple[float, float]) -> DataFrame:
    """``denoise_recordings`` from the slices on: ``recording_id, fs, sample_idx, ch``."""
    pairs = F.posexplode(F.arrays_zip(F.col("ch").alias("raw"), O.common_average(F.col("ch")).alias("car")))
    rows = cut.select("recording_id", "fs", "sample_idx", pairs.alias("channel", "v")).select("recording_id", "channel", "fs", "sample_idx", "v.raw", "v.car")
    collected, arrays = _packed("raw", "car")
    windows = rows.groupBy("recording_id", "channel").agg(F.first("fs").alias("fs"), collected).select("recording_id", "channel", "fs", *arrays)

    def clean(raw: np.ndarray, car: np.ndarray, fs: float) -> list | None:
        y = K.filter_rows(car, "bandpass", fs, 0.2, 50.0)
        stopped = None if y is None else K.filter_rows(y, "bandstop", fs, 59.0, 61.0)
        if stopped is None:
            return None
        proc = K.waaf(stopped)[0]
        both = np.concatenate([raw, proc])  # every later step once for both sides
        p = K.welch(both, fs, max(1, min(256, both.shape[1] // 4)))[1]
        narrow = K.filter_rows(both, "bandpass", fs, *alpha)
        size = [None] * len(both) if narrow is None else K.envelope(narrow).mean(1).tolist()
        n = len(raw)
        return [proc, p[:n], p[n:], size[:n], size[n:]]

    outputs = {"proc": "array<double>", "p_raw": "array<double>", "p_proc": "array<double>", "envelope_raw": "double", "envelope_proc": "double"}

    @pandas_udf("struct<" + ", ".join(f"{c}: {t}" for c, t in outputs.items()) + ">")
    def chain(raw: pd.Series, car: pd.Series, fs: pd.Series) -> pd.DataFrame:
        return pd.DataFrame(dict(zip(outputs, S.by_length(clean, len(outputs), raw, car, rate=fs), strict=True)))

    done = windows.withColumn("_c", chain("raw", "car", "fs")).select("recording_id", "channel", "fs", F.size("car").alias("n"), (F.col("fs") / S.segment(F.size("raw"))).alias("_step"), "_c.*")
    power = [S.band_area(F.col(f"p_{side}"), F.col("_step"), *alpha).alias(f"power_{side}") for side in ("raw", "proc")]
    done = done.select("recording_id", "channel", "fs", "n", O.zscore_array(F.col("proc")).alias("z"), *power, "envelope_raw", "envelope_proc")
    gap = F.col("power_proc") - F.col("power_raw")
    return done.withColumn("difference", gap).withColumn("percent", F.when(F.col("power_raw") > 0, gap / F.col("power_raw") * 100).otherwise(0.0))


def denoise_files(spark: SparkSession, path: str, seconds: float = 4.0, alpha: tuple[float, float] = (8.0, 13.0), canal: bool = False) -> DataFrame:
    """``denoise_recordings`` of a folder of raw exports, from the files on: ``n_rows`` and ``n_dropped`` beside its columns.

    Headers are found and cleaned, time and channel columns detected, times parsed, rows without one dropped and counted,
    times taken from the recording's first one, cells cleaned. ``channel`` is the place among the file's channels and
    ``name`` its name. A recording that has no row with a time has no result.
    """
    frames = R.read_folder(spark, path, canal=canal, numbered=False)
    # one aggregate has the counts, the rate and the middle; the files are parsed once for it and once for the slices
    micros, good = F.unix_micros("ts"), ~F.col("bad_time")
    info = frames.groupBy("recording_id").agg(
        F.count("*").alias("n_rows"), F.count_if("bad_time").alias("n_dropped"), F.first("channel_names").alias("_names"),
        F.min("t_s").alias("_t0"), F.max("t_s").alias("_t1"), F.min(micros).alias("_u0"), F.max(micros).alias("_u1"),
    )
    # whole microseconds where the times are clock times: seconds of the epoch as a double are too coarse for a rate
    length = F.coalesce((F.col("_u1") - F.col("_u0")) / F.lit(1e6), F.col("_t1") - F.col("_t0"))
    info = info.withColumn("fs", (F.col("n_rows") - F.col("n_dropped") - 1) / F.nullif(length, F.lit(0.0))).withColumn("_mid", length / 2).withColumn("name", F.col("_names")).drop("_t1", "_u1", "_names")
    since = F.coalesce((micros - F.col("_u0")) / F.lit(1e6), F.col("t_s") - F.col("_t0"))
    cut = frames.filter(good).join(info.select("recording_id", "fs", "_mid", "_t0", "_u0"), "recording_id").withColumn("t_s", since).filter(F.col("t_s").between(F.col("_mid"), F.col("_mid") + seconds))
    # only the slices are put in order
    cut = cut.withColumn("sample_idx", F.row_number().over(Window.partitionBy("recording_id").orderBy("t_s", "ch")))
    done = _cleaned(cut.select("recording_id", "fs", "sample_idx", "ch"), alpha)
    return done.join(info.select("recording_id", "n_rows", "n_dropped", "name"), "recording_id").withColumn("name", F.try_element_at("name", F.col("channel") + 1))


def profile_files(spark: SparkSession, path: str, channel: str | None = None, canal: bool = False) -> DataFrame:
    """``recording_profile`` of every file of a folder, from the files on, for its channel of that name, or else its first
    channel by the usual aliases: ``channel`` says which. A file that lacks the named channel has no row."""
    frames = R.read_folder(spark, path, canal=canal, numbered=False)
    which = F.lit(channel) if channel else R.first_channel_column(F.col("channel_names"))
    value = F.try_element_at("ch", F.nullif(F.array_position("channel_names", which), F.lit(0)).cast("int"))
    samples = frames.withColumn("channel", which).filter(F.array_contains("channel_names", F.col("channel")))
    samples = samples.select("recording_id", "t_s", F.nanvl(value, F.lit(None).cast("double")).alias("value"), "channel", "bad_time")
    return O.recording_profile(samples, more={"channel": (F.first("channel"), F.first), "n_dropped": (F.count_if("bad_time"), F.sum)})


def denoise_windows(samples: DataFrame, n: int = 1000, fs: float = 250.0) -> DataFrame:
    """The three stages of windowed cleaning: ``recording_id, channel, window_idx, filtered, car, stopped``.

    ``samples`` are long rows with ``channel_idx``. All channels of a window meet in one shuffle, and a worker holds one window
    at a time, however many there are. A channel that lacks a sample of the window, or has a null there, is left out of it
    and of its average.
    """
    good = samples.filter(F.col("value").isNotNull()).select("recording_id", F.floor(F.col("sample_idx") / n).alias("window_idx"), F.col("channel_idx").cast("int").alias("channel_idx"), "sample_idx", F.col("value").cast("double").alias("value"))

    def stages(key: tuple, rows: pa.Table) -> pa.Table:
        channel, at, value = (rows.column(c).to_numpy() for c in ("channel_idx", "sample_idx", "value"))
        order = np.lexsort((at, channel))
        number, first, size = np.unique(channel[order], return_index=True, return_counts=True)
        whole = size == n
        number, x = number[whole], value[order][first[whole][:, None] + np.arange(n)]
        y = K.filter_rows(x, "bandpass", fs) if len(x) else None
        car = None if y is None else y - y.mean(0)
        stop = None if y is None else K.filter_rows(car, "bandstop", fs, 59.0, 61.0)
        done = [] if stop is None else [y, car, stop]
        k = len(number) if done else 0
        arrays = [pa.array(list(m), pa.list_(pa.float64())) for m in done] or [pa.array([], pa.list_(pa.float64()))] * 3
        keys = [pa.array([v.as_py()] * k, v.type) for v in key]
        return pa.Table.from_arrays([*keys, pa.array(number[:k], pa.int32()), *arrays], ["recording_id", "window_idx", "channel", "filtered", "car", "stopped"])

    kind = good.schema["recording_id"].dataType.simpleString()
    return good.groupBy("recording_id", "window_idx").applyInArrow(stages, f"recording_id {kind}, window_idx long, channel int, filtered array<double>, car array<double>, stopped array<double>")


def filter_rolling(frames: DataFrame, channels: int = 3, factor: float = O.MICROVOLTS, n: int = 125, fs: float = 250.0) -> DataFrame:
    """Rolling filter and its Kalman smoothing of the first channels: ``recording_id, channel_idx, sample_idx, t_s, filtered, kalman``."""
    good = O.counts_to_microvolts(O.fill_malformed(frames, channels), factor)
    samples = O.frames_to_samples(good).select("recording_id", "channel_idx", "sample_idx", "t_s", "value")
    return S.trailing_and_kalman(samples, "channel_idx", n=n, fs=fs)


def band_power_epochs(frames: DataFrame, bands: list[tuple[str, float, float]], fs: float = 250.0) -> DataFrame:
    """Band powers of the hopping epochs, scaled over the channels: ``recording_id, epoch, t0, band, channel, power, scaled``."""
    samples = O.frames_to_samples(frames).withColumnRenamed("channel_idx", "channel")
    return O.minmax_channels(O.band_mean(S.fft_spectra(O.hop_epochs(samples, "channel"), fs), bands))


def psd_windows(frames: DataFrame, bands: list[tuple[str, float, float]], channels: int = 3, n: int = 40, fs: float = 100.0) -> DataFrame:
    """Mean Welch density of five bands in windows of 40 samples, as long rows."""
    samples = O.frames_to_samples(O.first_n_channels(frames, channels)).withColumn("channel", F.col("channel_idx") + 1)
    windows = O.tumbling_windows(samples, n, "channel")
    return O.band_mean(S.welch_spectra(windows, fs, 100).drop("t0"), bands)

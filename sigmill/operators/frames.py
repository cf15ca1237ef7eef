"""Operators on frames (one row per instant, all channels in ``ch``) and on long samples. Built-in functions only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from sigmill.operators import series

#: Microvolts of one count of the 24-bit converter at gain 24.
MICROVOLTS = 4500000 / 24 / (2**23 - 1)

# Channels of each headset's raw vector and the slot of its time (None: arrival time).
MONTAGES = {"nautilus": ((2, 3, 4, 6, 8, 10, 11, 12), 16), "polymate": ((0, 1, 2, 3, 4, 5, 6, 7), 8), "all": (None, None)}


# ---- columns -----------------------------------------------------------------------------------------------------


def parse_clock_time(c: Column) -> Column:
    """``[hh:mm:ss.mmm dd/mm/yyyy]``, with or without quotes and brackets, as a timestamp; else null."""
    return F.try_to_timestamp(F.regexp_replace(F.trim(c), r"['\[\]]", ""), F.lit("H:m:s.SSSSSS d/M/yyyy"))


def clean_numeric(c: Column) -> Column:
    """A number that may be quoted; text that is none gives null, ``nan`` stays NaN."""
    return F.regexp_replace(F.trim(c), "'", "").try_cast("double")


def to_microvolts(ch: Column, factor: float = MICROVOLTS) -> Column:
    return F.transform(ch, lambda x: x * F.lit(factor))


def common_average(ch: Column, n_slots: int | None = None) -> Column:
    """Subtract the mean over the channels of the instant; ``n_slots`` counts missing channels as zeros."""
    total = F.aggregate(ch, F.lit(0.0), lambda a, x: a + x)
    return F.transform(ch, lambda x: x - total / (F.lit(n_slots) if n_slots else F.size(ch)))


# ---- frames ------------------------------------------------------------------------------------------------------


def counts_to_microvolts(frames: DataFrame, factor: float = MICROVOLTS) -> DataFrame:
    return frames.withColumn("ch", to_microvolts(F.col("ch"), factor))


def car(frames: DataFrame, n_slots: int | None = None) -> DataFrame:
    """Common average reference, local to the row: nothing is shuffled."""
    return frames.withColumn("ch", common_average(F.col("ch"), n_slots))


def pick_channel(frames: DataFrame, channel: int) -> DataFrame:
    """One channel (0-based) as ``value``; null where the frame has fewer."""
    return frames.select("recording_id", "sample_idx", "t_s", F.try_element_at("ch", F.lit(channel + 1)).alias("value"))


def first_n_channels(frames: DataFrame, n: int) -> DataFrame:
    return frames.withColumn("ch", F.slice("ch", 1, n))


def select_montage(frames: DataFrame, headset: str) -> DataFrame:
    """Keep a headset's channels; its time slot, if it has one, replaces ``t_s``."""
    picks, slot = MONTAGES[headset]
    if picks is None:
        return frames
    out = frames.withColumn("_v", F.col("ch")).withColumn("ch", F.transform(F.array(*[F.lit(i + 1) for i in picks]), lambda i: F.try_element_at("_v", i)))
    if slot is not None:
        out = out.withColumn("t_s", F.coalesce(F.try_element_at("_v", F.lit(slot + 1)), "t_s"))
    return out.drop("_v")


def label_channels(samples: DataFrame, info: DataFrame) -> DataFrame:
    """Channel names from the stream's description (``recording_id, channel_names``, one row a recording).

    An empty or missing name becomes ``Channel_<i>`` (1-based).
    """
    named = samples.join(info, "recording_id", "left")
    label = F.nullif(F.try_element_at("channel_names", F.col("channel_idx") + 1), F.lit(""))
    return named.withColumn("channel", F.coalesce(label, F.concat(F.lit("Channel_"), F.col("channel_idx") + 1))).drop("channel_names")


def frames_to_samples(frames: DataFrame) -> DataFrame:
    return frames.select("recording_id", "sample_idx", "t_s", F.posexplode("ch").alias("channel_idx", "value"))


def samples_to_frames(samples: DataFrame) -> DataFrame:
    """The way back; the only one of the two that shuffles."""
    packed = F.array_sort(F.collect_list(F.struct("channel_idx", "value")))
    return samples.groupBy("recording_id", "sample_idx").agg(F.min("t_s").alias("t_s"), F.transform(packed, lambda s: s["value"]).alias("ch"))


def fill_malformed(frames: DataFrame, n: int, seconds: float = series.SECONDS) -> DataFrame:
    """A frame with fewer than ``n`` channels repeats the last good one; frames before the first good one go. Recordings of
    any length: no task sorts more than ``seconds`` of one."""
    good = F.when(F.size("ch") >= n, F.slice("ch", 1, n))
    return series.carry(frames, ["recording_id"], ["t_s", "sample_idx"], good, "ch", seconds).filter(F.col("ch").isNotNull())


def missing_samples(frames: DataFrame) -> DataFrame:
    return frames.groupBy("recording_id").agg(F.count_if(F.col("ch").isNull() | (F.size("ch") == 0)).alias("n_missing"), F.count("*").alias("n_frames"))


def relative_time(frames: DataFrame) -> DataFrame:
    """Seconds since the recording's first sample: one partial aggregation, joined back. Where frames have a clock time
    ``ts``, whole microseconds are subtracted: seconds of the epoch as a double are too coarse for a rate."""
    if "ts" not in frames.columns:
        first = frames.groupBy("recording_id").agg(F.min("t_s").alias("_t0"))
        return frames.join(first, "recording_id").withColumn("t_s", F.col("t_s") - F.col("_t0")).drop("_t0")
    first = frames.groupBy("recording_id").agg(F.min("t_s").alias("_t0"), F.min(F.unix_micros("ts")).alias("_u0"))
    since = F.coalesce((F.unix_micros("ts") - F.col("_u0")) / F.lit(1e6), F.col("t_s") - F.col("_t0"))
    return frames.join(first, "recording_id").withColumn("t_s", since).drop("_t0", "_u0")


def drop_invalid_time(frames: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Frames with a time, and how many each recording has lost; the second is an aggregate of its own, over the input again."""
    lost = frames.groupBy("recording_id").agg(F.count_if(F.col("t_s").isNull()).alias("n_dropped"))
    return frames.filter(F.col("t_s").isNotNull()), lost


def drop_invalid_time_observed(frames: DataFrame, name: str = "invalid_time") -> tuple[DataFrame, Observation]:
    """Frames with a time, and the counts ``n_rows`` and ``n_dropped`` of all recordings, which the scan that computes the
    frames yields on its way: ``observation.get`` waits for the first action on them. No second pass."""
    seen = Observation(name)
    counted = frames.observe(seen, F.count(F.lit(1)).alias("n_rows"), F.count_if(F.col("t_s").isNull()).alias("n_dropped"))
    return counted.filter(F.col("t_s").isNotNull()), seen


def order_by_time(frames: DataFrame, seconds: float = series.SECONDS) -> DataFrame:
    """``sample_idx`` by time within the recording; never a global sort, and no task sorts more than ``seconds`` of a recording."""
    return series.number(frames, ["recording_id"], ["t_s", "sample_idx"], seconds)


def order_by_time_in_buckets(frames: DataFrame, seconds: float = 3600.0) -> DataFrame:
    """``order_by_time`` with the buckets' length named."""
    return order_by_time(frames, seconds)


def capture_first(frames: DataFrame, seconds: float = 5.0) -> DataFrame:
    """Samples of the first seconds of each recording, with the one that crosses the limit.

    The crossing sample is the least of those behind the limit, found by a partial aggregation: no recording is sorted.
    """
    first = frames.groupBy("recording_id").agg(F.min("t_s").alias("_t0"))
    timed = frames.join(first, "recording_id").withColumn("_late", F.col("t_s") - F.col("_t0") >= seconds)
    crossing = timed.filter("_late").groupBy("recording_id").agg(F.min(F.struct("t_s", "sample_idx")).alias("_x"))
    inside = timed.join(crossing, "recording_id", "left").filter(~F.col("_late") | (F.struct("t_s", "sample_idx") == F.col("_x")))
    return inside.drop("_t0", "_late", "_x")


def mid_slice(frames: DataFrame, seconds: float = 4.0) -> DataFrame:
    """From the middle of the recording on, both ends inclusive."""
    ends = frames.groupBy("recording_id").agg(F.min("t_s").alias("_a"), F.max("t_s").alias("_b"))
    mid = F.col("_a") + (F.col("_b") - F.col("_a")) / 2
    return frames.join(ends, "recording_id").filter(F.col("t_s").between(mid, mid + seconds)).drop("_a", "_b")


def latest_n(frames: DataFrame, n: int, *keys: str) -> DataFrame:
    w = Window.partitionBy("recording_id", *keys).orderBy(F.col("t_s").desc(), F.col("sample_idx").desc())
    return frames.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= n).drop("_r")


# ---- joins -------------------------------------------------------------------------------------------------------


def align_streams(a: DataFrame, b: DataFrame) -> DataFrame:
    """Pair two streams sample by sample; values of the second get the name ``other``."""
    return a.join(b.select("recording_id", "sample_idx", F.col("value").alias("other")), ["recording_id", "sample_idx"])


def compare_stages(raw: DataFrame, processed: DataFrame) -> DataFrame:
    """Difference and change in percent of the power of a channel (0 where the raw power is not positive)."""
    p = processed.select("recording_id", "channel", F.col("power").alias("power_proc"))
    both = raw.select("recording_id", "channel", F.col("power").alias("power_raw")).join(p, ["recording_id", "channel"])
    gap = F.col("power_proc") - F.col("power_raw")
    return both.withColumn("difference", gap).withColumn("percent", F.when(F.col("power_raw") > 0, gap / F.col("power_raw") * 100).otherwise(0.0))


# ---- aggregates and windows --------------------------------------------------------------------------------------


def sampling_rate(frames: DataFrame) -> DataFrame:
    """Mean differences telescope: ``(rows - 1) / (last - first)`` needs neither order nor window."""
    s = frames.groupBy("recording_id").agg(F.count("t_s").alias("n"), (F.max("t_s") - F.min("t_s")).alias("_d"))
    return s.select("recording_id", "n", F.when((F.col("n") > 1) & (F.col("_d") > 0), (F.col("n") - 1) / F.col("_d")).otherwise(0.0).alias("rate"))


def sample_intervals(frames: DataFrame, seconds: float = series.SECONDS) -> DataFrame:
    """``dt``: the time since the sample before, null at the first one."""
    found = series.previous(frames, ["recording_id"], ["t_s", "sample_idx"], "t_s", "_before", seconds)
    return found.withColumn("dt", F.col("t_s") - F.col("_before")).drop("_before")


def recording_profile(samples: DataFrame, seconds: float = series.SECONDS, more: dict[str, tuple[Column, Callable[[str], Column]]] | None = None) -> DataFrame:
    """Rows, values, times, intervals and rate of each recording; a recording of one row has null intervals, rate 0. Rows
    without a time are no rows of it. ``more`` names aggregates of all its rows: what is taken of the rows of a bucket,
    and what puts the buckets together.

    ``samples`` are read and shuffled once, by buckets of ``seconds``; one row a bucket is carried along the recording.
    """
    more, timed, along = more or {}, F.col("t_s").isNotNull(), Window.partitionBy("recording_id")
    # rows without a time need no order: those of each task are a bucket of their own
    at = F.when(timed, series.bucket(F.col("t_s"), seconds)).otherwise(F.lit(series.FIRST) + F.spark_partition_id())
    rows = samples.withColumn("_b", at)
    rows = rows.withColumn("dt", F.col("t_s") - F.lag("t_s").over(Window.partitionBy("recording_id", "_b").orderBy("t_s")))
    parts = rows.groupBy("recording_id", "_b").agg(
        F.count("t_s").alias("n_rows"), F.count(F.when(timed, F.col("value"))).alias("n_values"), F.min("t_s").alias("t_first"), F.max("t_s").alias("t_last"),
        F.count("dt").alias("_n"), F.avg("dt").alias("_mean"), F.var_pop("dt").alias("_var"), F.min("dt").alias("_min"), F.max("dt").alias("_max"), *[part.alias(name) for name, (part, _) in more.items()],
    )
    # the interval from a bucket to the next one is in neither
    parts = parts.withColumn("_gap", F.col("t_first") - F.lag("t_last").over(along.orderBy("_b")))
    parts = parts.withColumn("_k", F.col("_n") + F.col("_gap").isNotNull().cast("int")).withColumn("_sum", F.coalesce(F.col("_n") * F.col("_mean"), F.lit(0.0)) + F.coalesce("_gap", F.lit(0.0)))
    parts = parts.withColumn("dt_mean", F.sum("_sum").over(along) / F.nullif(F.sum("_k").over(along), F.lit(0)))
    square = lambda c: (F.col(c) - F.col("dt_mean")) * (F.col(c) - F.col("dt_mean"))
    parts = parts.withColumn("_dev", F.coalesce(F.col("_n") * (F.col("_var") + square("_mean")), F.lit(0.0)) + F.coalesce(square("_gap"), F.lit(0.0)))
    g = parts.groupBy("recording_id").agg(
        F.sum("n_rows").alias("n_rows"), F.sum("n_values").alias("n_values"), F.min("t_first").alias("t_first"), F.max("t_last").alias("t_last"),
        F.max("dt_mean").alias("dt_mean"), F.min(F.least("_min", "_gap")).alias("dt_min"), F.max(F.greatest("_max", "_gap")).alias("dt_max"),
        F.sqrt(F.sum("_dev") / F.nullif(F.sum("_k"), F.lit(0))).alias("dt_std"), *[whole(name).alias(name) for name, (_, whole) in more.items()],
    )
    g = g.withColumn("duration", F.col("t_last") - F.col("t_first")).withColumn("rate", F.when(F.col("dt_mean") > 0, 1 / F.col("dt_mean")).otherwise(0.0))
    return g.withColumn("expected", F.col("duration") * F.col("rate")).withColumn("gap", F.abs(F.col("n_rows") - F.col("expected")))


def zscore(samples: DataFrame) -> DataFrame:
    """Per recording and channel, population deviation; null where it is 0. One small aggregate is joined back."""
    keys = ["recording_id", "channel"]
    s = samples.groupBy(*keys).agg(F.avg("value").alias("_m"), F.stddev_pop("value").alias("_s"))
    return samples.join(s, keys).withColumn("z", F.when(F.col("_s") > 0, (F.col("value") - F.col("_m")) / F.col("_s"))).drop("_m", "_s")


def zscore_array(x: Column) -> Column:
    """The array less its mean over its population deviation; null where the deviation is 0."""
    # a value that an inner lambda uses is bound as a lambda's own variable, else it would be worked out for every element
    bound = lambda value, use: F.element_at(F.transform(F.array(value), use), 1)
    mean = F.aggregate(x, F.lit(0.0), lambda a, v: a + v) / F.size(x)
    spread = lambda m: F.sqrt(F.aggregate(x, F.lit(0.0), lambda a, v: a + (v - m) * (v - m)) / F.size(x))
    scaled = lambda m, s: F.when(s > 0, F.transform(x, lambda v: (v - m) / s))
    return F.when(F.size(x) > 0, bound(mean, lambda m: bound(spread(m), lambda s: scaled(m, s))))


def minmax_channels(powers: DataFrame) -> DataFrame:
    """Values of a band scaled over the channels by the least and largest size; 0 where all are equal."""
    w = Window.partitionBy("recording_id", "epoch", "band")
    lo, hi = F.min(F.abs("power")).over(w), F.max(F.abs("power")).over(w)
    return powers.withColumn("_lo", lo).withColumn("_hi", hi).withColumn("scaled", F.when(F.col("_hi") > F.col("_lo"), (F.col("power") - F.col("_lo")) / (F.col("_hi") - F.col("_lo"))).otherwise(0.0)).drop("_lo", "_hi")


def tumbling_windows(samples: DataFrame, n: int, *keys: str) -> DataFrame:
    """Whole windows of ``n`` samples as arrays: ``recording_id, <keys>, window_idx, t0, x``; an unfilled last one goes."""
    packed = F.array_sort(F.collect_list(F.struct("sample_idx", "value")))
    g = samples.groupBy("recording_id", *keys, F.floor(F.col("sample_idx") / n).alias("window_idx"))
    return g.agg(F.min("t_s").alias("t0"), packed.alias("_x")).filter(F.size("_x") == n).select("recording_id", *keys, "window_idx", "t0", F.transform("_x", lambda s: s["value"]).alias("x"))


def hop_epochs(samples: DataFrame, *keys: str, size: int = 250, hop: int = 50, lossless: bool = False, group: int = 16) -> DataFrame:
    """Epochs of ``size`` samples every ``hop``: ``recording_id, <keys>, epoch, t0, x``.

    As the recorder does it, the first full epoch is not given out and every hop eats one sample more, the one that
    triggers it: of samples from ``size`` on, each ``hop + 1``-th is dropped and the others are numbered on.
    ``lossless`` is the plain rule. ``group`` epochs that follow each other are cut out of one array; what a group needs
    of the next one's first samples is sent to both, in the one shuffle, and no window runs along a series. Epochs that
    lack a sample or, by the recorder's rule, their trigger, are left out. ``size`` is a multiple of ``hop``.
    """
    i, parts = F.col("sample_idx"), size // hop
    if lossless:
        kept = samples.withColumn("_k", i).withColumn("_eaten", F.lit(False))
    else:
        j = i - size
        # the eaten sample goes with the block before it, the last of the epoch that it triggers
        place = size + hop * F.floor(j / (hop + 1)) + F.least(j % (hop + 1), F.lit(hop - 1))
        kept = samples.withColumn("_k", F.when(i < size, i).otherwise(place)).withColumn("_eaten", (i >= size) & (j % (hop + 1) == hop))
    block = F.floor(F.col("_k") / hop)
    to = F.sequence(F.floor((block - (parts - 1)) / group), F.floor(block / group))  # groups with an epoch that holds the block
    rows = kept.withColumn("_block", block).select("recording_id", *keys, "_k", "_eaten", "_block", "t_s", "value", F.explode(to).alias("_g"))
    packed = rows.groupBy("recording_id", *keys, "_g").agg(
        F.array_sort(F.collect_list(F.when(~F.col("_eaten"), F.struct("_k", "value", "t_s")))).alias("_s"),
        F.collect_list(F.when(F.col("_eaten"), F.col("_block"))).alias("_fired"),
    ).filter("_g >= 0").withColumn("_at", F.transform("_s", lambda s: s["_k"]))
    first = F.col("_g") * group
    epochs = F.explode(F.transform(F.sequence(first, first + (group - 1)), lambda e: F.struct(e.alias("epoch"), F.array_position("_at", e * hop).cast("int").alias("at"))))
    found = packed.select("recording_id", *keys, "_s", "_fired", epochs.alias("_e")).filter("_e.at > 0")
    found = found.select("recording_id", *keys, "_fired", F.col("_e.epoch").alias("epoch"), F.slice("_s", F.col("_e.at"), F.lit(size)).alias("_x"))
    found = found.filter((F.size("_x") == size) & (F.element_at("_x", -1)["_k"] == F.col("epoch") * hop + (size - 1)))
    if not lossless:
        found = found.filter((F.col("epoch") >= 1) & F.array_contains("_fired", F.col("epoch") + (parts - 1)))
    return found.select("recording_id", *keys, "epoch", F.element_at("_x", 1)["t_s"].alias("t0"), F.transform("_x", lambda s: s["value"]).alias("x"))


def trailing_windows(samples: DataFrame, n: int, *keys: str) -> DataFrame:
    """The last ``n`` values at every sample from the ``n + 1``-th on, counted from the recording's first sample at which
    some channel is not zero; what comes before is a recorder filling up."""
    seen = F.when(F.col("value").isNotNull() & (F.col("value") != 0), F.col("sample_idx"))
    start = samples.groupBy("recording_id").agg(F.min(seen).alias("_start")).filter("_start is not null")
    live = samples.join(start, "recording_id").filter("sample_idx >= _start")
    w = Window.partitionBy("recording_id", *keys).orderBy("sample_idx").rowsBetween(-(n - 1), 0)
    return live.withColumn("x", F.collect_list("value").over(w)).filter(F.col("sample_idx") - F.col("_start") >= n).drop("_start")


# ---- spectra as rows: recording_id, channel, epoch, f, p ----------------------------------------------------------


def band_bins(spectrum: DataFrame, fmin: float, fmax: float) -> DataFrame:
    return spectrum.filter(F.col("f").between(fmin, fmax))


def band_mean(spectra: DataFrame, bands: list[tuple[str, float, float]]) -> DataFrame:
    """Mean of the bins of each band, both ends inclusive, as rows ``band, power`` beside the keys.

    ``spectra`` has a spectrum a row: the array ``p`` whose bin ``i`` lies at ``i * step``. The means are taken inside the
    array, so that a row becomes as many rows as bands, not bins. A band without a bin has no row.
    """
    def one(low: float, high: float) -> Column:
        inside = F.filter("p", lambda v, i: (i * F.col("step")).between(low, high))
        return F.aggregate(inside, F.lit(0.0), lambda a, v: a + v) / F.nullif(F.size(inside), F.lit(0))

    means = F.array(*[F.struct(F.lit(b).alias("band"), one(float(lo), float(hi)).alias("power")) for b, lo, hi in bands])
    keys = [c for c in spectra.columns if c not in ("p", "step")]
    return spectra.select(*keys, F.inline(means)).filter(F.col("power").isNotNull())


def band_power_trapz(spectrum: DataFrame, fmin: float, fmax: float, *keys: str) -> DataFrame:
    """Area under the bins of a band by the trapezoid rule."""
    w = Window.partitionBy("recording_id", *keys).orderBy("f")
    part = (F.col("f") - F.lag("f").over(w)) * (F.col("p") + F.lag("p").over(w)) / 2
    return band_bins(spectrum, fmin, fmax).withColumn("_a", part).groupBy("recording_id", *keys).agg(F.coalesce(F.sum("_a"), F.lit(0.0)).alias("power"))

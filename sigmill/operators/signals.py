"""Filters, spectra and adaptive cancelling over packed windows (``x`` is the array of a window's values).

The kernels are NumPy over an Arrow batch: rows of equal length form one matrix.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from sigmill.functions import kernels as K

#: Samples of a chunk when a long series is filtered with a short memory.
CHUNK = 1000
#: Samples of arrays that are worked on as one matrix.
AT_ONCE = 1 << 18


def by_length(run: Callable, outputs: int, *columns: pd.Series, rate: pd.Series | None = None, same: bool = True) -> list[list]:
    """Apply ``run`` (a matrix for each column, then the rate if there is one -> ``outputs`` matrices) to rows of equal
    lengths and rate.

    A row has None if an array is null or empty, if its arrays differ in length (allowed without ``same``), if its rate is
    null or not positive, or if ``run`` gives None for its length and rate. NaN values stay in their rows, and leave as
    nulls in the array.
    """
    out: list[list] = [[None] * len(columns[0]) for _ in range(outputs)]
    groups: dict[tuple, list[int]] = {}
    for i, row in enumerate(zip(*columns, strict=True)):
        sizes = tuple(0 if v is None else len(v) for v in row)
        f = 1.0 if rate is None else rate.iloc[i]
        if min(sizes) and (not same or len(set(sizes)) == 1) and f is not None and f > 0:
            groups.setdefault((sizes, round(float(f), 6)), []).append(i)
    for (sizes, f), found in groups.items():
        most = max(1, AT_ONCE // max(sizes))
        for at in (found[k : k + most] for k in range(0, len(found), most)):
            rows = [np.stack([np.asarray(c.iloc[i], float) for i in at]) for c in columns]
            for k, result in enumerate(run(*rows, *([] if rate is None else [f])) or []):
                for i, row in zip(at, result, strict=True):
                    out[k][i] = row
    return out


def _rated(run: Callable[[np.ndarray, float], np.ndarray | None]) -> Callable[[Column, Column | float], Column]:
    """A column function of arrays and their sampling rates from a function of a matrix and a rate."""

    def some(m: np.ndarray, f: float) -> list | None:
        result = run(m, f)
        return None if result is None else [result]

    @pandas_udf("array<double>")
    def call(x: pd.Series, fs: pd.Series) -> pd.Series:
        return pd.Series(by_length(some, 1, x, rate=fs)[0], dtype=object)

    return lambda x, fs: call(x, fs if isinstance(fs, Column) else F.lit(float(fs)))


def zero_phase(x: Column, kind: str, fs: Column | float, low: float, high: float = 0.0, order: int = 4, q: float = 30.0) -> Column:
    """Zero-phase filter of every array at its own rate; null where it is too short or the band doesn't fit the rate."""
    return _rated(lambda m, f: K.filter_rows(m, kind, f, low, high, order, q))(x, fs)


def bandpass(windows: DataFrame, fs: float, low: float = 0.2, high: float = 50.0, order: int = 4) -> DataFrame:
    """Zero-phase band-pass of every window; windows that are too short become null."""
    return windows.withColumn("x", zero_phase(F.col("x"), "bandpass", fs, low, high, order))


def bandstop(windows: DataFrame, fs: float, f0: float = 60.0, bw: float = 2.0, order: int = 4) -> DataFrame:
    return windows.withColumn("x", zero_phase(F.col("x"), "bandstop", fs, f0 - bw / 2, f0 + bw / 2, order))


def notch(windows: DataFrame, fs: float, f0: float = 50.0, q: float = 30.0) -> DataFrame:
    return windows.withColumn("x", zero_phase(F.col("x"), "notch", fs, f0, q=q))


def lowpass(windows: DataFrame, fs: float, fp: float = 0.45, fst: float = 30.0, gpass: float = 1.0, gstop: float = 60.0) -> DataFrame:
    order, cut = K.lowpass_order(fp, fst, gpass, gstop, fs)
    return windows.withColumn("x", zero_phase(F.col("x"), "lowpass", fs, 0.0, float(cut), order))


def envelope(x: Column, fs: Column | float, low: float = 8.0, high: float = 13.0) -> Column:
    """Size of the analytic signal of the band-passed array."""

    def run(m: np.ndarray, f: float) -> np.ndarray | None:
        y = K.filter_rows(m, "bandpass", f, low, high, 4)
        return None if y is None else K.envelope(y)

    return _rated(run)(x, fs)


def alpha_envelope(windows: DataFrame, fs: float, low: float = 8.0, high: float = 13.0) -> DataFrame:
    return windows.withColumn("x", envelope(F.col("x"), fs, low, high))


def wavelet_reference(windows: DataFrame, level: int = 7, soften: tuple[int, ...] = (1, 2, 3, 4)) -> DataFrame:
    return windows.withColumn("ref", _rated(lambda m, _: K.wavelet_reference(m, level, soften))(F.col("x"), 1.0))


def waaf(windows: DataFrame, level: int = 7, soften: tuple[int, ...] = (1, 2, 3, 4), forget: float = 0.98, p0: float = 1e4) -> DataFrame:
    """Wavelet-assisted adaptive filter: ``clean``, ``ref`` and ``weight`` beside ``x``, in one pass."""

    @pandas_udf("struct<clean array<double>, ref array<double>, weight array<double>>")
    def call(x: pd.Series) -> pd.DataFrame:
        clean, ref, weight = by_length(lambda m: K.waaf(m, level, soften, forget, p0), 3, x)
        return pd.DataFrame({"clean": clean, "ref": ref, "weight": weight})

    return windows.withColumn("_w", call("x")).select(*windows.columns, "_w.clean", "_w.ref", "_w.weight")


def rls_cancel(windows: DataFrame, forget: float = 0.98, p0: float = 1e4) -> DataFrame:
    """Cancel ``ref`` in ``x``: ``error`` and ``weight`` arrays, null where one of the two is null or they differ in
    length. All windows of a length go through the recursion together."""

    @pandas_udf("struct<error array<double>, weight array<double>>")
    def call(x: pd.Series, ref: pd.Series) -> pd.DataFrame:
        error, weight = by_length(lambda a, b: K.rls_cancel(a, b, forget, p0), 2, x, ref)
        return pd.DataFrame({"error": error, "weight": weight})

    return windows.withColumn("_r", call("x", "ref")).select(*windows.columns, "_r.error", "_r.weight")


# ---- series with a short memory: chunks that see the end of the one before --------------------------------------


def first_signal(samples: DataFrame) -> DataFrame:
    """``recording_id, _start``: the first sample of each recording at which some channel is not zero. Recorders fill
    up before they start, and what comes before is no signal."""
    seen = F.when(F.col("value").isNotNull() & (F.col("value") != 0), F.col("sample_idx"))
    return samples.groupBy("recording_id").agg(F.min(seen).alias("_start")).filter("_start is not null")


def from_first_signal(samples: DataFrame) -> DataFrame:
    """The samples from the recording's first signal on, with its place as ``_start``."""
    return samples.join(first_signal(samples), "recording_id").filter("sample_idx >= _start")


def _in_chunks(samples: DataFrame, keys: tuple[str, ...], make: Callable[[np.ndarray], list[np.ndarray]], outputs: list[str], tail: int, size: int) -> DataFrame:
    """Series in chunks of ``size`` samples, each with the last ``tail`` samples before it, in one shuffle.

    The samples at the end of a chunk are sent to the next one too, so no task sees a whole series. A gap in
    ``sample_idx`` ends a segment, and what follows begins anew, wherever chunks end: ``make(values of a segment) ->
    outputs`` sees a segment from its beginning, or from ``tail`` samples before the chunk, and must give the same values
    for the chunk's samples either way. ``samples`` have ``_start``, where their series begins.
    """
    if size < tail:
        raise ValueError("a chunk must hold what the next one needs of it")
    k = F.col("sample_idx") - F.col("_start")
    c = F.floor(k / size)
    to = F.explode(F.when(k % size >= size - tail, F.array(c, c + 1)).otherwise(F.array(c)))
    rows = samples.select("recording_id", *keys, "_start", "sample_idx", "t_s", "value", to.alias("_c"))
    packed = rows.groupBy("recording_id", *keys, "_start", "_c").agg(F.array_sort(F.collect_list(F.struct("sample_idx", "value", "t_s"))).alias("_s"))
    own = F.filter("_s", lambda s: s["sample_idx"] >= F.col("_start") + F.col("_c") * size)
    packed = packed.withColumn("_own", own).filter(F.size("_own") > 0)

    @pandas_udf(f"struct<{', '.join(f'{o} array<double>' for o in outputs)}>")
    def call(x: pd.Series, at: pd.Series, n_own: pd.Series) -> pd.DataFrame:
        rows = []
        for v, i, n in zip(x, at, n_own, strict=True):
            parts = [make(part) for part in np.split(np.asarray(v, float), np.flatnonzero(np.diff(i) != 1) + 1)]
            rows.append([np.concatenate(p)[-n:] for p in zip(*parts, strict=True)])
        return pd.DataFrame({o: [r[i] for r in rows] for i, o in enumerate(outputs)})

    found = call(F.transform("_s", lambda s: s["value"]), F.transform("_s", lambda s: s["sample_idx"]), F.size("_own"))
    done = packed.withColumn("_r", found).select("recording_id", *keys, F.inline(F.arrays_zip(F.col("_own").alias("s"), *[F.col(f"_r.{o}").alias(o) for o in outputs])))
    return done.select("recording_id", *keys, "s.sample_idx", "s.t_s", *outputs)


def _trailing(h: np.ndarray, v: np.ndarray, first: int) -> np.ndarray:
    """Products of ``h`` with the last values at every sample from the place ``first`` on; NaN before."""
    out = np.full(len(v), np.nan)
    if len(v) > first:
        out[first:] = np.convolve(v[first - len(h) + 1 :], h[::-1], "valid")
    return out


def trailing_filter(samples: DataFrame, *keys: str, n: int = 125, fs: float = 250.0) -> DataFrame:
    """Notch and band-pass of the last ``n`` values at every sample, of which the last value is kept.

    Both passes are linear in a window of fixed length, so the value is a product with fixed weights. Leading samples
    at which all channels of the recording are zero are left out; the first output is at the ``n + 1``-th sample after,
    and at the ``n + 1``-th after a gap in ``sample_idx``: no window reaches across one.
    """
    h = K.trailing_weights(n, fs)
    done = _in_chunks(from_first_signal(samples), keys, lambda v: [_trailing(h, v, n), np.arange(len(v)) >= n], ["value", "_full"], n, max(CHUNK, n))
    return done.filter("_full > 0").drop("_full")


def _smoothed(z: np.ndarray, q: float, r: float, p0: float) -> np.ndarray:
    """Kalman means of a segment: by the recursion until its gains have settled, then as a weighted sum of the last values."""
    gain, memory = K.kalman_memory(q, r, p0)
    out = _trailing((gain * (1 - gain) ** np.arange(memory))[::-1], z, memory)
    out[:memory] = K.kalman(z[None, :memory], q, r, p0)[0]
    return out


def kalman_smooth(samples: DataFrame, *keys: str, q: float = 0.5, r: float = 0.5, p0: float = 1000.0) -> DataFrame:
    """Random-walk Kalman filter of each series, begun anew after a gap in ``sample_idx``.

    The gains don't depend on the data and settle; from then on a value is a weighted sum of the last ones. How many
    follows from the settled gain, so chunks are as long as small noise ratios need. A null or NaN value makes the
    values null whose sums it is in, the same number of them wherever it stands.
    """
    memory = K.kalman_memory(q, r, p0)[1]
    whole = samples.withColumn("_start", F.lit(0).cast("long"))
    return _in_chunks(whole, keys, lambda v: [_smoothed(v, q, r, p0)], ["value"], memory, max(CHUNK, 2 * memory))


def trailing_and_kalman(samples: DataFrame, *keys: str, n: int = 125, fs: float = 250.0, q: float = 0.5, r: float = 0.5, p0: float = 1000.0) -> DataFrame:
    """``filtered`` and its ``kalman`` smoothing in one pass: a chunk brings what both need of the one before. The
    smoother begins with the filter's first output, and both begin anew after a gap in ``sample_idx``."""
    h, memory = K.trailing_weights(n, fs), K.kalman_memory(q, r, p0)[1]

    def make(v: np.ndarray) -> list[np.ndarray]:
        f = _trailing(h, v, n)
        return [f, np.concatenate([np.full(min(n, len(f)), np.nan), _smoothed(f[n:], q, r, p0)]), np.arange(len(v)) >= n]

    done = _in_chunks(from_first_signal(samples), keys, make, ["filtered", "kalman", "_full"], n + memory, max(CHUNK, n + 2 * memory))
    return done.filter("_full > 0").drop("_full")


# ---- rolling extremes --------------------------------------------------------------------------------------------


def rolling_range(samples: DataFrame, n: int, pad: float = 0.1, prefill_zero: bool = False) -> DataFrame:
    """Least, largest and padded display range over the last ``n`` places of a channel, beside the samples' columns.

    The places are those of ``sample_idx`` (unique in a series): at sample i, the values from i - n + 1 to i that are
    there. Blocks of ``n`` places are sent to themselves and to the next block, in one shuffle; the last ``n`` places at
    a sample are an end of the block before and a beginning of its own, so that running extremes backward in the one and
    forward in the other give the answer: the work is linear whatever ``n`` is, and no task sorts more than two
    blocks. Nulls and NaN are no values; where there is none at all, the range is null. ``prefill_zero`` counts the
    places before 0 as zeros.
    """
    keys = ["recording_id", "channel"]
    rest = [c for c in samples.columns if c not in keys]
    c = F.floor(F.col("sample_idx") / n)
    rows = samples.withColumn("_c", F.explode(F.array(c, c + 1)))
    packed = rows.groupBy(*keys, "_c").agg(F.array_sort(F.collect_list(F.struct("sample_idx", *[x for x in rest if x != "sample_idx"]))).alias("_s"))
    packed = packed.withColumn("_own", F.filter("_s", lambda s: s["sample_idx"] >= F.col("_c") * n)).filter(F.size("_own") > 0)

    @pandas_udf("struct<lo array<double>, hi array<double>>")
    def call(at: pd.Series, x: pd.Series, block: pd.Series) -> pd.DataFrame:
        lows, highs = [], []
        step = max(1, (1 << 21) // n)
        for k in range(0, len(at), step):
            some, base = at.iloc[k : k + step], block.iloc[k : k + step].to_numpy()
            size = some.map(len).to_numpy()
            row = np.repeat(np.arange(len(some)), size)
            place = np.concatenate(some.tolist()).astype(np.int64) - np.repeat((base - 1) * n, size)
            dense = np.full((len(some), 2 * n), np.nan)
            dense[row, place] = np.concatenate([np.asarray(v, float) for v in x.iloc[k : k + step]])
            for best, out in ((np.fmin, lows), (np.fmax, highs)):
                ahead = best.accumulate(dense[:, n:], axis=1)
                behind = best.accumulate(dense[:, n - 1 :: -1], axis=1)[:, ::-1]  # from place j to the block's end
                ahead[:, :-1] = best(ahead[:, :-1], behind[:, 1:])
                own = place >= n
                out += np.split(ahead[row[own], place[own] - n], np.cumsum(np.bincount(row[own], minlength=len(some)))[:-1])
        return pd.DataFrame({"lo": lows, "hi": highs})

    found = call(F.transform("_s", lambda s: s["sample_idx"]), F.transform("_s", lambda s: s["value"].cast("double")), F.col("_c"))
    done = packed.withColumn("_r", found).select(*keys, F.inline(F.arrays_zip(F.col("_own").alias("s"), F.col("_r.lo").alias("lo"), F.col("_r.hi").alias("hi"))))
    lo, hi = F.nanvl("lo", F.lit(None).cast("double")), F.nanvl("hi", F.lit(None).cast("double"))
    if prefill_zero:
        short = F.col("s.sample_idx") < n - 1
        lo, hi = F.when(short, F.least(lo, F.lit(0.0))).otherwise(lo), F.when(short, F.greatest(hi, F.lit(0.0))).otherwise(hi)
    out = done.select(*keys, *[f"s.{x}" for x in rest], lo.alias("lo"), hi.alias("hi")).select(*samples.columns, "lo", "hi")
    room = F.when(F.col("hi") > F.col("lo"), (F.col("hi") - F.col("lo")) * pad).otherwise(0.0)
    return out.withColumn("shown_lo", F.col("lo") - room).withColumn("shown_hi", F.col("hi") + room)


# ---- recursive filters of long series: blocks in parallel, small states in order ---------------------------------


#: Slots of the causal chain's average; a channel that a recording lacks counts as zero.
SLOTS = 8


def causal_chain(frames: DataFrame, channel: int = 0, fs: float = 250.0) -> DataFrame:
    """Sample-by-sample band-pass, average over eight slots, and mains stop of one channel.

    Recordings of any length are filtered in blocks: every block gives its output and end state from a zero state on
    its own task, a scan of the small states per recording finds what each block starts from, and that is added.
    A channel that a frame lacks counts as zero in the average, of eight channels always; a null or NaN value makes all
    later values null, as in any recursive filter, so repair malformed frames before.
    """
    band, gain, _ = K.named_filter("bandpass", fs)
    stop, stop_gain, _ = K.named_filter("bandstop", fs, 59.0, 61.0)
    # the average of filtered channels is the filter of the average: one series remains, after a row-local step; every
    # channel starts from the steady state of an input of 1, of which the average takes the share of the slots in use
    used = F.slice("ch", 1, SLOTS)
    value = F.try_element_at("ch", F.lit(channel + 1)) - F.aggregate(used, F.lit(0.0), lambda a, x: a + x) / SLOTS
    centred = frames.select("recording_id", "sample_idx", "t_s", value.alias("value"), (1 - F.size(used) / F.lit(float(SLOTS))).alias("_share"))
    first = blockwise(centred, band, gain, K.steady_state(band, gain).ravel(), share="_share")
    return blockwise(first, stop, stop_gain, K.steady_state(stop, stop_gain).ravel())


def _blocks(samples: DataFrame, keys: tuple[str, ...], size: int, *more: Column) -> DataFrame:
    packed = F.array_sort(F.collect_list(F.struct("sample_idx", "value", "t_s"))).alias("_s")
    return samples.groupBy("recording_id", *keys, F.floor(F.col("sample_idx") / size).alias("block")).agg(packed, *more)


def _alone(sections: np.ndarray, gain: float):
    """Column function: output and end state of an array filtered from a zero state."""

    @pandas_udf("struct<y array<double>, state array<double>>")
    def call(x: pd.Series) -> pd.DataFrame:
        y, state = by_length(lambda m: [(r := K.block_responses(sections, gain, m))[0], r[1].reshape(-1, len(m)).T], 2, x)
        return pd.DataFrame({"y": y, "state": state})

    return call


def _from_state(sections: np.ndarray):
    """Column function: a block's zero-state output with what its start state puts on it."""

    @pandas_udf("array<double>")
    def call(y: pd.Series, state: pd.Series) -> pd.Series:
        return pd.Series(by_length(lambda m, s: [K.add_state(sections, m, s)], 1, y, state, same=False)[0], dtype=object)

    return call


def blockwise(samples: DataFrame, sections: np.ndarray, gain: float, start: np.ndarray, size: int = CHUNK, share: str | None = None) -> DataFrame:
    """Causal filter of a series per recording by an exact block scan; ``start`` is the state before the first sample,
    times the first sample's column ``share`` if it is named. Samples that are not there are passed over."""
    packed = _blocks(samples, (), size, (F.min_by(share, "sample_idx") if share else F.lit(1.0)).alias("_part"))
    done = packed.withColumn("_r", _alone(sections, gain)(F.transform("_s", lambda s: s["value"]))).select("recording_id", "block", "_part", "_s", "_r.y", "_r.state")

    def scan(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("block")
        ends = np.stack(pdf["state"].map(np.asarray).tolist())
        return pdf[["recording_id", "block"]].assign(start=list(K.chain_blocks(sections, ends, start * pdf["_part"].iloc[0], pdf["n"].to_numpy())))

    kind = dict(samples.dtypes)["recording_id"]
    starts = done.select("recording_id", "block", "_part", "state", F.size("y").alias("n")).groupBy("recording_id").applyInPandas(scan, f"recording_id {kind}, block long, start array<double>")
    out = done.drop("state", "_part").join(starts, ["recording_id", "block"])
    return out.select("recording_id", F.inline(F.arrays_zip(F.col("_s").alias("s"), _from_state(sections)("y", "start").alias("y")))).select("recording_id", "s.sample_idx", "s.t_s", F.col("y").alias("value"))


def zero_phase_series(samples: DataFrame, kind: str, fs: float, low: float, high: float = 0.0, *keys: str, order: int = 4, q: float = 30.0, size: int = CHUNK) -> DataFrame:
    """Zero-phase filter of whole series of any length: ``recording_id, <keys>, sample_idx, t_s, value``.

    The same numbers as ``zero_phase`` of the series as one array. Blocks of ``size`` samples are filtered forward from a
    zero state, each in its own task; a scan of what is small of every block (end state, first and last samples) finds
    the states that they start from, the odd extensions at both ends of the series included; and that is added. The
    same is done backward, in the same blocks, which are not shuffled again. Samples that are not there are
    passed over; series of no more samples than the padding, and bands that don't fit the rate, give null values.
    """
    try:
        sections, gain, pad = K.named_filter(kind, fs, low, high, order, q)
    except ValueError:
        return samples.select("recording_id", *keys, "sample_idx", "t_s", F.lit(None).cast("double").alias("value"))
    steady = K.steady_state(sections, gain)
    by = ["recording_id", *keys]
    kinds = ", ".join(f"{c} {dict(samples.dtypes)[c]}" for c in by)
    packed = _blocks(samples, keys, size)
    values = F.transform("_s", lambda s: s["value"].cast("double"))
    ahead = packed.withColumn("_x", values).withColumn("_r", _alone(sections, gain)("_x")).select(*by, "block", "_s", "_x", "_r.y", "_r.state")

    def run(x: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        y, after = K.run_sections(sections, gain, x[None], state.reshape(-1, 2, 1))
        return y[0], after.ravel()

    def gathered(parts: list) -> np.ndarray:
        """The first ``pad + 1`` samples of the series, from the blocks in order."""
        out: list = []
        for p in parts:
            out += list(p)
            if len(out) > pad:
                break
        return np.asarray(out[: pad + 1], float)

    def forward(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("block", ignore_index=True)
        n = pdf["n"].to_numpy()
        if n.sum() <= pad:
            return pdf[[*by, "block"]].assign(start=None, back=None)
        head, tail = gathered(pdf["first"].tolist()), gathered([p[::-1] for p in pdf["last"][::-1]])
        before, after = 2 * head[0] - head[:0:-1], 2 * tail[0] - tail[1:]
        _, state = run(before, steady.ravel() * before[0])
        ends = np.stack(pdf["state"].map(np.asarray).tolist())
        starts = K.chain_blocks(sections, ends, state, n)
        y, _ = run(after, K.chain_blocks(sections, np.concatenate([ends, ends[:1]]), state, np.append(n, 1))[-1])
        _, back = run(y[::-1], steady.ravel() * y[-1])
        return pdf[[*by, "block"]].assign(start=list(starts), back=[back] * len(pdf))

    edge = lambda c: (F.slice(c, 1, pad + 1).alias("first"), F.when(F.size(c) > pad + 1, F.slice(c, -(pad + 1), pad + 1)).otherwise(F.col(c)).alias("last"))
    small = ahead.select(*by, "block", "state", F.size("y").alias("n"), *edge("_x"))
    starts = small.groupBy(*by).applyInPandas(forward, f"{kinds}, block long, start array<double>, back array<double>")
    turned = ahead.drop("state", "_x").join(starts, [*by, "block"]).withColumn("y", F.reverse(_from_state(sections)("y", "start")))
    behind = turned.withColumn("_r", _alone(sections, gain)("y")).select(*by, "block", "_s", "back", "_r.y", "_r.state")

    def backward(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("block", ascending=False, ignore_index=True)
        if pdf["back"].iloc[0] is None or pdf["state"].isna().any():
            return pdf[[*by, "block"]].assign(start=None)
        ends = np.stack(pdf["state"].map(np.asarray).tolist())
        return pdf[[*by, "block"]].assign(start=list(K.chain_blocks(sections, ends, np.asarray(pdf["back"].iloc[0], float), pdf["n"].to_numpy())))

    returns = behind.select(*by, "block", "back", "state", F.size("_s").alias("n")).groupBy(*by).applyInPandas(backward, f"{kinds}, block long, start array<double>")
    done = behind.drop("state", "back").join(returns, [*by, "block"]).withColumn("y", F.reverse(_from_state(sections)("y", "start")))
    done = done.withColumn("y", F.coalesce("y", F.transform("_s", lambda s: F.lit(None).cast("double"))))
    return done.select(*by, F.inline(F.arrays_zip(F.col("_s").alias("s"), F.col("y").alias("y")))).select(*by, "s.sample_idx", "s.t_s", F.col("y").alias("value"))


# ---- spectra -----------------------------------------------------------------------------------------------------


def segment(n: Column, nperseg: int | None = None) -> Column:
    """Length of Welch's segments for arrays of length ``n``: a quarter, 256 at most, or ``nperseg``."""
    return F.least(F.lit(nperseg) if nperseg else F.greatest(F.lit(1), F.least(F.lit(256), F.floor(n / 4))), n)


def density(x: Column, fs: Column | float, nperseg: int | None = None) -> Column:
    """Welch's power density of every array; bin ``i`` lies at ``i * fs / segment(size)``."""
    return _rated(lambda m, f: K.welch(m, f, nperseg or max(1, min(256, m.shape[1] // 4)))[1])(x, fs)


def welch_psd(windows: DataFrame, fs: float, nperseg: int | None = None) -> DataFrame:
    """Power density of each window as rows ``f, p`` beside its keys; ``nperseg`` is a quarter of the window, 256 at most."""
    return _as_rows(welch_spectra(windows, fs, nperseg))


def band_area(p: Column, step: Column, low: float, high: float) -> Column:
    """Area by the trapezoid rule under the bins ``i * step`` of an array that lie in the band, both ends inclusive."""
    inside = F.filter(p, lambda v, i: (i * step).between(low, high))
    total = F.aggregate(inside, F.lit(0.0), lambda a, v: a + v)
    return F.when(F.size(inside) > 1, step * (total - (F.element_at(inside, 1) + F.element_at(inside, -1)) / 2)).when(p.isNotNull(), F.lit(0.0))


def alpha_power(windows: DataFrame, fs: float, low: float = 8.0, high: float = 13.0) -> DataFrame:
    """``power``: the area under each window's Welch density between ``low`` and ``high``, beside its keys."""
    found = welch_spectra(windows, fs)
    return found.withColumn("power", band_area(F.col("p"), F.col("step"), low, high)).drop("p", "step")


def welch_series(samples: DataFrame, fs: float, *keys: str, nperseg: int = 256, group: int = 64) -> DataFrame:
    """Welch's density of whole series of any length: ``recording_id, <keys>, n_segments, p, step``.

    The same numbers as ``welch_spectra`` of the series as one array. ``group`` segments that follow each other are cut out
    of one array; the samples that a group shares with the one before are sent to both, in the one shuffle; the powers of
    a group are summed up in its task, and the groups of a series by Spark. Segments are counted from ``sample_idx`` 0;
    one that lacks a sample or has a null is left out, and a series without any has no row.
    """
    hop = nperseg - nperseg // 2
    span = group * hop
    g = F.floor(F.col("sample_idx") / span)
    to = F.when(F.col("sample_idx") % span < nperseg - hop, F.array(g, g - 1)).otherwise(F.array(g))
    rows = samples.filter("value is not null").select("recording_id", *keys, "sample_idx", "value", F.explode(to).alias("_g"))
    packed = rows.groupBy("recording_id", *keys, "_g").agg(F.array_sort(F.collect_list(F.struct("sample_idx", "value"))).alias("_s")).filter("_g >= 0")

    @pandas_udf("struct<n long, p array<double>>")
    def powers(at: pd.Series, x: pd.Series, first: pd.Series) -> pd.DataFrame:
        out = []
        for i, v, a in zip(at, x, first, strict=True):
            dense = np.full(span + nperseg - hop, np.nan)
            dense[np.asarray(i, np.int64) - a * span] = v
            cut = np.lib.stride_tricks.sliding_window_view(dense, nperseg)[::hop]
            cut = cut[~np.isnan(cut).any(1)]
            out.append((len(cut), K.welch(cut, fs, nperseg)[1].sum(0) if len(cut) else None))
        return pd.DataFrame(out, columns=["n", "p"])

    part = packed.select("recording_id", *keys, powers(F.transform("_s", lambda s: s["sample_idx"]), F.transform("_s", lambda s: s["value"].cast("double")), F.col("_g")).alias("_r"))
    bins = part.filter("_r.n > 0").select("recording_id", *keys, "_r.n", F.posexplode("_r.p").alias("_i", "_p"))
    sums = bins.groupBy("recording_id", *keys, "_i").agg(F.sum("n").alias("_n"), F.sum("_p").alias("_p"))
    line = F.array_sort(F.collect_list(F.struct("_i", (F.col("_p") / F.col("_n")).alias("p"))))
    found = sums.groupBy("recording_id", *keys).agg(F.first("_n").alias("n_segments"), F.transform(line, lambda s: s["p"]).alias("p"))
    return found.withColumn("step", F.lit(float(fs) / nperseg))


def welch_spectra(windows: DataFrame, fs: float, nperseg: int | None = None) -> DataFrame:
    """Welch's density of each window as an array ``p`` with its bin width ``step``, beside the window's keys."""
    keys = [c for c in windows.columns if c != "x"]
    return windows.select(*keys, density(F.col("x"), fs, nperseg).alias("p"), (F.lit(float(fs)) / segment(F.size("x"), nperseg)).alias("step"))


def fft_spectra(windows: DataFrame, fs: float, size: int = 256) -> DataFrame:
    """``|FFT|^2 / size`` of each window, filled up with zeros, as an array ``p`` with its bin width ``step``."""
    keys = [c for c in windows.columns if c != "x"]
    power = _rated(lambda m, _: K.fft_power(m, fs, size)[1])(F.col("x"), fs)
    return windows.select(*keys, power.alias("p"), F.lit(float(fs) / size).alias("step"))


def _as_rows(spectra: DataFrame) -> DataFrame:
    keys = [c for c in spectra.columns if c not in ("p", "step")]
    return spectra.select(*keys, "step", F.posexplode("p").alias("_i", "p")).withColumn("f", F.col("_i") * F.col("step")).drop("_i", "step")


def fft_power(windows: DataFrame, fs: float, size: int = 256) -> DataFrame:
    """``fft_spectra`` as rows ``f, p``."""
    return _as_rows(fft_spectra(windows, fs, size))

"""Structured Streaming forms of the count-window and filter jobs: one bounded state per recording."""

from __future__ import annotations

import warnings
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from sigmill.functions import kernels as K
from sigmill.operators.frames import MICROVOLTS
from sigmill.operators.signals import SLOTS
from sigmill.sources import recordings as R

# Spark itself joins empty frames to the state's rows in the workers that import this
warnings.filterwarnings("ignore", "The behavior of DataFrame concatenation", FutureWarning)

#: A recording loses its state when the watermark has passed its last sample by this much.
IDLE_MS = 600_000
#: Frames of a recording that are worked on at a time; what they become is given out before the next ones.
AT_ONCE = 4096


def last_ms(pdf: pd.DataFrame) -> int:
    """The latest event time of the rows, in milliseconds."""
    return int(pdf["ts"].max().timestamp() * 1000)


def _expire(held: GroupState, last: int) -> None:
    held.setTimeoutTimestamp(max(last, held.getCurrentWatermarkMs()) + IDLE_MS)


def _frames(pdfs: Iterator[pd.DataFrame]) -> tuple[pd.DataFrame, np.ndarray]:
    """The frames of a recording in a micro-batch, in time order, and their channels as a matrix (channels x time).
    Frames without channels are left out; channels that a frame lacks are NaN."""
    pdf = pd.concat(list(pdfs)).sort_values(["t_s", "sample_idx"])
    pdf = pdf[pdf["ch"].map(lambda c: c is not None and len(c) > 0)]
    width = max(map(len, pdf["ch"]), default=0)
    x = np.full((width, len(pdf)), np.nan)
    for i, c in enumerate(pdf["ch"]):
        x[: len(c), i] = np.asarray(c, float)
    return pdf, x


def _beside(x: np.ndarray, flat: list[float], before: int) -> np.ndarray:
    """Kept frames (``before`` of them, flat) and new ones as one matrix; channels that one of the two lacks are NaN."""
    old = np.asarray(flat, float).reshape(-1, before) if before else np.empty((0, 0))
    both = np.full((max(len(old), len(x)), before + x.shape[1]), np.nan)
    both[: len(old), :before] = old
    both[: len(x), before:] = x
    return both


def _stateful(stream: DataFrame, step, output: str, state: str) -> DataFrame:
    """Group by recording and run ``step(state tuple or None, frames, matrix) -> (rows, state tuple)``."""

    def run(key, pdfs: Iterator[pd.DataFrame], held: GroupState):
        if held.hasTimedOut:
            held.remove()
            return
        pdf, x = _frames(pdfs)
        if len(pdf):
            new = held.get if held.exists else None
            for k in range(0, len(pdf), AT_ONCE):
                rows, new = step(new, pdf.iloc[k : k + AT_ONCE], x[:, k : k + AT_ONCE])
                if len(rows):
                    rows.insert(0, "recording_id", key[0])
                    yield rows
            held.update(new)
            _expire(held, last_ms(pdf))

    return stream.groupBy("recording_id").applyInPandasWithState(run, "recording_id string, " + output, state, "append", GroupStateTimeout.EventTimeTimeout)


def _each_channel(index: int, t0: float, x: np.ndarray) -> list[tuple]:
    return [(index, c, t0, row) for c, row in enumerate(x)]


def tumbling(stream: DataFrame, n: int, make=_each_channel, columns: str = "window_idx long, channel int, t0 double, x array<double>") -> DataFrame:
    """Whole windows of ``n`` frames; ``make(index, t0, channels x n) -> rows`` says what a window becomes.

    State: fewer than ``n`` frames.
    """
    names = [c.split()[0] for c in columns.split(", ")]

    def step(held, pdf: pd.DataFrame, x: np.ndarray):
        index, times, flat = held if held else (0, [], [])
        times = np.concatenate([np.asarray(times, float), pdf["t_s"].to_numpy()])
        x = _beside(x, flat, len(times) - len(pdf))
        whole = x.shape[1] // n
        rows = [r for k in range(whole) for r in make(index + k, float(times[k * n]), x[:, k * n : (k + 1) * n])]
        x, times = x[:, whole * n :], times[whole * n :]
        return pd.DataFrame(rows, columns=names), (index + whole, times.tolist(), x.ravel().tolist())

    return _stateful(stream, step, columns, "i long, t array<double>, x array<double>")


def hopping(stream: DataFrame, size: int = 250, hop: int = 50, make=_each_channel, columns: str = "epoch long, channel int, t0 double, x array<double>") -> DataFrame:
    """Epochs of ``size`` frames with the recorder's rule: after the first fill, every ``hop + 1``-th frame is the one
    that gives an epoch out and is itself dropped, and the first full epoch stays in. ``make`` as for ``tumbling``.
    State: ``size`` frames."""
    names = [c.split()[0] for c in columns.split(", ")]

    def step(held, pdf: pd.DataFrame, x: np.ndarray):
        seen, epoch, times, flat = held if held else (0, 1, [], [])
        place = seen + np.arange(x.shape[1]) - size
        trigger = (place >= 0) & (place % (hop + 1) == hop)
        x = _beside(x[:, ~trigger], flat, len(times))
        kept = len(times) + np.cumsum(~trigger)  # frames kept so far at each new one
        times = np.concatenate([np.asarray(times, float), pdf["t_s"].to_numpy()[~trigger]])
        rows = []
        for end in kept[trigger]:
            rows += make(epoch, float(times[end - size]), x[:, end - size : end])
            epoch += 1
        return pd.DataFrame(rows, columns=names), (seen + len(pdf), epoch, times[-size:].tolist(), x[:, -size:].ravel().tolist())

    return _stateful(stream, step, columns, "s long, e long, t array<double>, x array<double>")


def denoise_windows(stream: DataFrame, n: int = 1000, fs: float = 250.0) -> DataFrame:
    """The three stages of windowed cleaning as windows fill."""

    def make(index: int, t0: float, x: np.ndarray) -> list[tuple]:
        whole = np.flatnonzero(~np.isnan(x).any(1))  # a channel that lacks a sample is left out
        y = K.filter_rows(x[whole], "bandpass", fs) if len(whole) else None
        stop = None if y is None else K.filter_rows(y - y.mean(0), "bandstop", fs, 59.0, 61.0)
        if stop is None:
            return []
        return [(index, int(c), a, b, d) for c, a, b, d in zip(whole, y, y - y.mean(0), stop, strict=True)]

    return tumbling(stream, n, make, "window_idx long, channel int, filtered array<double>, car array<double>, stopped array<double>")


def _means(f: np.ndarray, p: np.ndarray, bands: list[tuple[str, float, float]]) -> dict[str, np.ndarray]:
    """Mean of the bins of each band (both ends inclusive) per channel; bands without a bin are left out."""
    inside = {b: (f >= lo) & (f <= hi) for b, lo, hi in bands}
    return {b: p[:, m].mean(1) for b, m in inside.items() if m.any()}


def psd_windows(stream: DataFrame, bands: list[tuple[str, float, float]], channels: int = 3, n: int = 40, fs: float = 100.0) -> DataFrame:
    """Mean Welch density of the bands in windows of 40 frames."""

    def make(index: int, t0: float, x: np.ndarray) -> list[tuple]:
        means = _means(*K.welch(x[:channels], fs, 100), bands)
        return [(index, c + 1, b, v[c]) for b, v in means.items() for c in range(len(v))]

    return tumbling(stream, n, make, "window_idx long, channel int, band string, power double")


def band_power(stream: DataFrame, bands: list[tuple[str, float, float]], fs: float = 250.0) -> DataFrame:
    """Band powers of the hopping epochs, scaled over the channels."""

    def make(epoch: int, t0: float, x: np.ndarray) -> list[tuple]:
        rows = []
        for b, v in _means(*K.fft_power(x, fs, 256), bands).items():
            lo, hi = np.abs(v).min(), np.abs(v).max()
            scaled = (v - lo) / (hi - lo) if hi > lo else np.zeros_like(v)
            rows += [(epoch, t0, b, c, v[c], scaled[c]) for c in range(len(v))]
        return rows

    return hopping(stream, make=make, columns="epoch long, t0 double, band string, channel int, power double, scaled double")


def trailing_and_kalman(stream: DataFrame, channels: int = 3, n: int = 125, fs: float = 250.0, factor: float = MICROVOLTS) -> DataFrame:
    """The rolling filter and its Kalman smoothing, sample by sample: ``sample_idx, t_s, filtered, kalman`` (arrays).

    A malformed frame repeats the last good one; leading frames before the first good one, or without any signal, are
    left out. After a gap in ``sample_idx`` both begin anew, as in the batch form. State: the last ``n`` good frames, the
    filter's mean and variance and the last frame's number, so both streams come out of one step and need no join.
    """
    h = K.trailing_weights(n, fs)

    def run(key, pdfs: Iterator[pd.DataFrame], held: GroupState):
        if held.hasTimedOut:
            held.remove()
            return
        tail, mean, p, seen, before = held.get if held.exists else ([], [0.0] * channels, 1000.0, 0, -1)
        tail = np.asarray(tail, float).reshape(-1, channels)
        pdf = pd.concat(list(pdfs)).sort_values(["t_s", "sample_idx"])
        until = last_ms(pdf)
        good = pdf["ch"].map(lambda c: c is not None and len(c) >= channels).to_numpy(bool)
        new = np.full((len(pdf), channels), np.nan)
        for i in np.flatnonzero(good):
            new[i] = np.asarray(pdf["ch"].iloc[i][:channels], float) * factor
        # the row of the last good frame, or of the one that was kept
        last = np.maximum.accumulate(np.where(good, np.arange(len(pdf)), -1))
        new = np.where((last >= 0)[:, None], new[last], tail[-1] if len(tail) else np.nan)
        live = np.ones(len(pdf), bool) if len(tail) else np.maximum.accumulate((last >= 0) & (new != 0).any(1))
        pdf, new = pdf[live], new[live]
        index, times, rows = pdf["sample_idx"].to_numpy(), pdf["t_s"].to_numpy(), []
        names = ["recording_id", "sample_idx", "t_s", "filtered", "kalman"]
        breaks = np.flatnonzero(np.diff(np.append(before, index)) != 1) if len(index) else np.empty(0, np.int64)
        anew = set(breaks.tolist())
        for part in np.split(np.arange(len(index)), np.union1d(breaks, np.arange(AT_ONCE, len(index), AT_ONCE))):
            if not len(part):
                continue
            if part[0] in anew:  # nothing of what was before counts
                tail, mean, p, seen = tail[:0], [0.0] * channels, 1000.0, 0
            x = np.concatenate([tail, new[part]])
            number = seen + np.arange(1, len(part) + 1)  # place of each new frame, from 1
            mean = np.asarray(mean, float)
            if len(x) >= n:
                value = np.lib.stride_tricks.sliding_window_view(x, n, axis=0) @ h  # ends at frames n - 1, n, ... of x
                value = np.concatenate([np.full((len(x) - len(value), channels), np.nan), value])[len(tail) :]
                for k in np.flatnonzero(number > n):
                    p += 0.5
                    gain = p / (p + 0.5)
                    mean, p = mean + gain * (value[k] - mean), (1 - gain) * p
                    rows.append((key[0], index[part[k]], times[part[k]], value[k], mean))
            tail, seen, before = x[-n:], seen + len(part), int(index[part[-1]])
            if len(rows) >= AT_ONCE:
                yield pd.DataFrame(rows, columns=names)
                rows = []
        held.update((tail.ravel().tolist(), np.asarray(mean, float).tolist(), float(p), seen, before))
        _expire(held, until)
        if rows:
            yield pd.DataFrame(rows, columns=names)

    out = "recording_id string, sample_idx long, t_s double, filtered array<double>, kalman array<double>"
    return stream.groupBy("recording_id").applyInPandasWithState(run, out, "t array<double>, m array<double>, p double, n long, i long", "append", GroupStateTimeout.EventTimeTimeout)


def causal_stream(stream: DataFrame, channel: int = 0, fs: float = 250.0) -> DataFrame:
    """Causal band-pass, average over eight slots and mains stop of one channel. State: the filters' memory alone."""
    band, gain, _ = K.named_filter("bandpass", fs)
    stop, stop_gain, _ = K.named_filter("bandstop", fs, 59.0, 61.0)

    def step(held, pdf: pd.DataFrame, x: np.ndarray):
        x = x[:SLOTS]
        # a channel that is missing counts as zero, also in the state from which the average starts
        opening = K.steady_state(band, gain).ravel() * (1 - len(x) / SLOTS)
        first, second = held if held else (opening, K.steady_state(stop, stop_gain).ravel())
        own = x[channel] if channel < len(x) else np.full(x.shape[1], np.nan)
        y, a = K.run_sections(band, gain, (own - np.nansum(x, 0) / SLOTS)[None], np.asarray(first, float).reshape(-1, 2, 1))
        y, b = K.run_sections(stop, stop_gain, y, np.asarray(second, float).reshape(-1, 2, 1))
        rows = pd.DataFrame({"sample_idx": pdf["sample_idx"].to_numpy(), "t_s": pdf["t_s"].to_numpy(), "value": y[0]})
        return rows, (a.ravel().tolist(), b.ravel().tolist())

    return _stateful(stream, step, "sample_idx long, t_s double, value double", "a array<double>, b array<double>")


def align(a: DataFrame, b: DataFrame, slack: str = "5 seconds") -> DataFrame:
    """Pair two streams by recording and sample within an event-time bound, so that the join's state stays bounded."""
    x = a.select("recording_id", "sample_idx", "ts", "value")
    y = b.select(F.col("recording_id").alias("_r"), F.col("sample_idx").alias("_i"), F.col("ts").alias("_ts"), F.col("value").alias("other"))
    near = F.expr(f"recording_id = _r and sample_idx = _i and _ts between ts - interval {slack} and ts + interval {slack}")
    return x.join(y, near).select("recording_id", "sample_idx", "ts", "value", "other")


def write_pair(stream: DataFrame, path_filtered: str, path_kalman: str, checkpoint: str, available_now: bool = False):
    """Both CSV tables of the rolling filter from one query, every row once in each; see ``write_by_batch``."""
    sinks = {path_filtered: "filtered", path_kalman: "kalman"}
    return R.write_by_batch(stream, {p: lambda b, c=c: b.select(*R.pair_columns(c)) for p, c in sinks.items()}, checkpoint, available_now=available_now)


def write_band_table(stream: DataFrame, path: str, checkpoint: str, *keys: str, available_now: bool = False):
    """The band table of a stream of powers (``channel`` from 1, ``band``) as CSV, every row once; all powers of a window come in one batch."""
    return R.write_by_batch(stream, {path: lambda b: R.band_table(b, *keys)}, checkpoint, available_now=available_now)

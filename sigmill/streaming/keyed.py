"""Streaming jobs on keyed state of RocksDB: pending frames as a list, counters as values, timers for idle recordings.

A micro-batch appends its frames to what a recording holds and rewrites that only when a window is given out, where the
forms of ``stateful`` write their whole state as one row each time. The numbers are the same.
"""

from __future__ import annotations

import sys
from collections import deque
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from sigmill.functions import kernels as K
from sigmill.operators.signals import SLOTS
from sigmill.streaming.stateful import AT_ONCE, IDLE_MS, _each_channel, _frames, last_ms

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: A pending frame.
FRAME = "t_s double, ch array<double>"


def use_rocksdb(spark: SparkSession) -> None:
    """Keyed state needs RocksDB: sets it for the streams that this session starts from now on, unless another class is set."""
    key = "spark.sql.streaming.stateStore.providerClass"
    if "RocksDB" not in spark.conf.get(key, ""):
        spark.conf.set(key, PROVIDER)


class Keyed(StatefulProcessor):
    """What all have in common: rows in time order as a matrix, and a timer that drops a recording's state when the watermark has
    passed its last row by IDLE_MS. Subclasses name their states in ``states`` and give rows in ``step``, which gets ``at_once``
    frames at most: what a long micro-batch becomes is given out part by part."""

    at_once = AT_ONCE

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.timer = handle.getValueState("timer", "at long")
        self.states()

    def states(self) -> None:
        raise NotImplementedError

    def step(self, pdf: pd.DataFrame, x: np.ndarray) -> list[tuple]:
        raise NotImplementedError

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        pdf, x = _frames(rows)
        if not len(pdf):
            return
        if self.timer.exists():
            self.handle.deleteTimer(self.timer.get()[0])
        at = max(last_ms(pdf), timerValues.getCurrentWatermarkInMs()) + IDLE_MS
        self.handle.registerTimer(at)
        self.timer.update((at,))
        for k in range(0, len(pdf), self.at_once):
            found = self.step(pdf.iloc[k : k + self.at_once], x[:, k : k + self.at_once])
            if found:
                yield pd.DataFrame([(key[0], *r) for r in found], columns=self.names)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        for state in (self.timer, *self.held):
            state.clear()
        return iter(())

    def close(self) -> None:
        pass


def _run(stream: DataFrame, processor: Keyed, columns: str) -> DataFrame:
    use_rocksdb(stream.sparkSession)
    columns = "recording_id string, " + columns
    processor.names = [c.split()[0] for c in columns.split(", ")]
    return stream.groupBy("recording_id").transformWithStateInPandas(processor, columns, "Append", "EventTime")


def _matrix(frames: list[tuple]) -> np.ndarray:
    """Frames (time, channels) as channels x time; channels that one lacks are NaN."""
    x = np.full((max((len(c) for _, c in frames), default=0), len(frames)), np.nan)
    for i, (_, c) in enumerate(frames):
        x[: len(c), i] = [np.nan if v is None else v for v in c]
    return x


def _pending(pdf: pd.DataFrame, keep: np.ndarray | slice = slice(None)) -> list[tuple]:
    return [(float(t), [float(v) if v is not None else float("nan") for v in c]) for t, c in zip(pdf["t_s"].to_numpy()[keep], pdf["ch"].to_numpy()[keep], strict=True)]


class Tumbling(Keyed):
    def __init__(self, n: int, make: Callable):
        self.n, self.make = n, make

    def states(self) -> None:
        self.pending = self.handle.getListState("pending", FRAME)
        self.count = self.handle.getValueState("count", "index long, waiting long")
        self.held = (self.pending, self.count)

    def step(self, pdf: pd.DataFrame, x: np.ndarray) -> list[tuple]:
        index, waiting = self.count.get() if self.count.exists() else (0, 0)
        fresh = _pending(pdf)
        if waiting + len(fresh) < self.n:  # no window: what is there stays as it is
            self.pending.appendList(fresh)
            self.count.update((index, waiting + len(fresh)))
            return []
        frames = [tuple(f) for f in self.pending.get()] + fresh if waiting else fresh
        x, whole = _matrix(frames), len(frames) // self.n
        rows = [r for k in range(whole) for r in self.make(index + k, frames[k * self.n][0], x[:, k * self.n : (k + 1) * self.n])]
        rest = frames[whole * self.n :]
        if rest:
            self.pending.put(rest)
        else:
            self.pending.clear()
        self.count.update((index + whole, len(rest)))
        return rows


def tumbling(stream: DataFrame, n: int, make: Callable = _each_channel, columns: str = "window_idx long, channel int, t0 double, x array<double>") -> DataFrame:
    """Whole windows of ``n`` frames, as ``stateful.tumbling``. State: the frames that wait, fewer than ``n``."""
    return _run(stream, Tumbling(n, make), columns)


class Hopping(Keyed):
    def __init__(self, size: int, hop: int, make: Callable):
        self.size, self.hop, self.make = size, hop, make

    def states(self) -> None:
        self.pending = self.handle.getListState("pending", FRAME)
        self.count = self.handle.getValueState("count", "seen long, epoch long, waiting long")
        self.held = (self.pending, self.count)

    def step(self, pdf: pd.DataFrame, x: np.ndarray) -> list[tuple]:
        seen, epoch, waiting = self.count.get() if self.count.exists() else (0, 1, 0)
        place = seen + np.arange(len(pdf)) - self.size
        trigger = (place >= 0) & (place % (self.hop + 1) == self.hop)
        fresh = _pending(pdf, ~trigger)
        seen += len(pdf)
        if not trigger.any() and waiting + len(fresh) <= 2 * self.size:
            if fresh:
                self.pending.appendList(fresh)
            self.count.update((seen, epoch, waiting + len(fresh)))
            return []
        frames = [tuple(f) for f in self.pending.get()] + fresh if waiting else fresh
        x, rows = _matrix(frames), []
        for end in (waiting + np.cumsum(~trigger))[trigger]:
            rows += self.make(epoch, frames[end - self.size][0], x[:, end - self.size : end])
            epoch += 1
        self.pending.put(frames[-self.size :])
        self.count.update((seen, epoch, min(len(frames), self.size)))
        return rows


def hopping(stream: DataFrame, size: int = 250, hop: int = 50, make: Callable = _each_channel, columns: str = "epoch long, channel int, t0 double, x array<double>") -> DataFrame:
    """Epochs by the recorder's rule, as ``stateful.hopping``. State: the last ``size`` frames, twice as many at most between epochs."""
    return _run(stream, Hopping(size, hop, make), columns)


class Causal(Keyed):
    def __init__(self, channel: int, fs: float):
        self.channel, self.fs = channel, fs

    def states(self) -> None:
        self.memory = self.handle.getValueState("memory", "a array<double>, b array<double>")
        self.held = (self.memory,)

    def step(self, pdf: pd.DataFrame, x: np.ndarray) -> list[tuple]:
        band, gain, _ = K.named_filter("bandpass", self.fs)
        stop, stop_gain, _ = K.named_filter("bandstop", self.fs, 59.0, 61.0)
        x = x[:SLOTS]
        first, second = self.memory.get() if self.memory.exists() else (K.steady_state(band, gain).ravel() * (1 - len(x) / SLOTS), K.steady_state(stop, stop_gain).ravel())
        own = x[self.channel] if self.channel < len(x) else np.full(x.shape[1], np.nan)
        y, a = K.run_sections(band, gain, (own - np.nansum(x, 0) / SLOTS)[None], np.asarray(first, float).reshape(-1, 2, 1))
        y, b = K.run_sections(stop, stop_gain, y, np.asarray(second, float).reshape(-1, 2, 1))
        self.memory.update((a.ravel().tolist(), b.ravel().tolist()))
        return list(zip(pdf["sample_idx"].tolist(), pdf["t_s"].tolist(), y[0].tolist(), strict=True))


def causal(stream: DataFrame, channel: int = 0, fs: float = 250.0) -> DataFrame:
    """The causal chain, as ``stateful.causal_stream``. State: the filters' memory alone."""
    return _run(stream, Causal(channel, fs), "sample_idx long, t_s double, value double")


# ---- live views --------------------------------------------------------------------------------------------------


class Extremes(Keyed):
    """Monotonic queues: of the last ``n`` places, only values that can still become the least or the largest are kept."""

    def __init__(self, n: int, pad: float):
        self.n, self.pad = n, pad

    def states(self) -> None:
        self.queues = self.handle.getMapState("queues", "channel int, sign int", "at array<long>, value array<double>")
        self.held = (self.queues,)

    def step(self, pdf: pd.DataFrame, x: np.ndarray) -> list[tuple]:
        at, rows = pdf["sample_idx"].tolist(), []
        times = pdf["t_s"].tolist()
        for c, values in enumerate(x):
            found = []
            for sign in (1, -1):
                held = self.queues.getValue((c, sign)) if self.queues.containsKey((c, sign)) else ([], [])
                queue, out = deque(zip(*held, strict=True)), []
                for i, v in zip(at, (sign * values).tolist(), strict=True):
                    if v == v:
                        while queue and queue[-1][1] >= v:
                            queue.pop()
                        queue.append((i, v))
                    while queue and queue[0][0] <= i - self.n:
                        queue.popleft()
                    out.append(sign * queue[0][1] if queue else None)
                self.queues.updateValue((c, sign), tuple(map(list, zip(*queue, strict=True))) if queue else ([], []))
                found.append(out)
            for i, t, v, lo, hi in zip(at, times, values.tolist(), *found, strict=True):
                room = (hi - lo) * self.pad if lo is not None and hi > lo else 0.0
                rows.append((c, i, t, v, lo, hi, *((None, None) if lo is None else (lo - room, hi + room))))
        return rows


def rolling_range(stream: DataFrame, n: int, pad: float = 0.1) -> DataFrame:
    """Least, largest and padded display range over the last ``n`` places of each channel, as ``signals.rolling_range``:
    ``channel, sample_idx, t_s, value, lo, hi, shown_lo, shown_hi``. State: two monotonic queues a channel, ``n`` values at most."""
    return _run(stream, Extremes(n, pad), "channel int, sample_idx long, t_s double, value double, lo double, hi double, shown_lo double, shown_hi double")


class Latest(Keyed):
    """A ring of the last ``n`` frames, given out whole whenever frames have come."""

    at_once = sys.maxsize  # a view a micro-batch, of its last frames alone

    def __init__(self, n: int):
        self.n = n

    def states(self) -> None:
        self.ring = self.handle.getListState("ring", "i long, t_s double, ch array<double>")
        self.count = self.handle.getValueState("count", "view long")
        self.held = (self.ring, self.count)

    def step(self, pdf: pd.DataFrame, x: np.ndarray) -> list[tuple]:
        view = self.count.get()[0] + 1 if self.count.exists() else 0
        fresh = [(int(i), *f) for i, f in zip(pdf["sample_idx"].tolist()[-self.n :], _pending(pdf, slice(-self.n, None)), strict=True)]
        old = [tuple(f) for f in self.ring.get()] if self.ring.exists() and len(fresh) < self.n else []
        ring = sorted([*old, *fresh], key=lambda f: (f[1], f[0]))[-self.n :]
        self.ring.put(ring)
        self.count.update((view,))
        return [(view, *f) for f in ring]


def latest_n(stream: DataFrame, n: int) -> DataFrame:
    """The last ``n`` frames of each recording as they stand after every micro-batch that has brought it some: ``view`` (from
    0), ``sample_idx, t_s, ch``; the last view is ``frames.latest_n``. State: ``n`` frames."""
    return _run(stream, Latest(n), "view long, sample_idx long, t_s double, ch array<double>")

"""Event-time windows for recordings that are sampled regularly: the alternative to counting frames."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: Stands for a ``sample_idx`` that is null, before all others.
NONE = -(1 << 63)
#: Windows of a series that share one row of a stream's state: a call of Python costs some ten milliseconds.
BLOCK = 64


def event_windows(samples: DataFrame, *keys: str, seconds: int = 4, fs: float = 250.0, whole: bool = True) -> DataFrame:
    """Windows of ``seconds`` of event time as arrays: ``recording_id, <keys>, start, n, x``, from a stream or a table.

    ``samples`` are long rows with ``ts`` (on a stream, with a watermark), unique by recording, keys and ``sample_idx``; what
    comes again, with the time that it had, counts once. On a stream a row is late if the watermark, as of the
    batch before the one that brings it, has passed its time; it is dropped, and ``late_rows`` counts it. A window is given out when the watermark has passed its end.
    ``whole`` leaves out windows that lack a sample of the ``seconds * fs`` that are due.
    """
    if samples.isStreaming:
        found = _of_stream(samples, ["recording_id", *keys], seconds)
    else:
        rows = F.array_sort(F.collect_list(F.struct("sample_idx", "value"))).alias("_s")
        found = samples.dropDuplicates(["recording_id", *keys, "sample_idx"]).groupBy("recording_id", *keys, F.window("ts", f"{seconds} seconds").alias("_w")).agg(rows)
        found = found.select("recording_id", *keys, F.col("_w.start").alias("start"), F.size("_s").alias("n"), F.transform("_s", lambda s: s["value"]).alias("x"))
    return found.filter(F.col("n") == round(seconds * fs)) if whole else found


def _of_stream(samples: DataFrame, ids: list[str], seconds: int) -> DataFrame:
    """The state has one row for every BLOCK windows of a series, not one a sample: the samples of windows that are open, each
    once. A repeated sample that is not late meets its window still open, so no other record of what has come is needed."""
    kind, long = samples.schema["value"].dataType, 1000 * seconds
    value = F.col("value").cast("double")
    start = F.unix_millis(F.window("ts", f"{seconds} seconds")["start"])
    rows = samples.select(*ids, "ts", start.alias("_start"), F.coalesce("sample_idx", F.lit(NONE)).alias("_at"), F.coalesce(value, F.lit(0.0)).alias("_x"), value.isNull().alias("_null"))
    rows = rows.withColumn("_block", F.floor(F.col("_start") / (long * BLOCK)))
    out = ", ".join(f"`{c}` {samples.schema[c].dataType.simpleString()}" for c in ids) + ", _start long, n int, x array<double>, _nulls array<int>, _nans array<int>"
    held = {"_start": np.int64, "_at": np.int64, "_x": np.float64, "_null": bool}

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        kept = [{c: np.frombuffer(b, t) for b, (c, t) in zip(state.get, held.items(), strict=True)}] if state.exists else []
        came = [] if state.hasTimedOut else [{c: pdf[c].to_numpy(t) for c, t in held.items()} for pdf in parts]
        s = {c: np.concatenate([part[c] for part in kept + came]) for c in held}
        first = np.unique(s["_at"], return_index=True)[1]  # in their order; of equal numbers the first to come
        first = first[np.argsort(s["_start"][first], kind="stable")]
        s = {c: v[first] for c, v in s.items()}
        closed = int(np.searchsorted(s["_start"], state.getCurrentWatermarkMs() - long, "right"))
        if closed < len(first):
            state.update(tuple(v[closed:].tobytes() for v in s.values()))
            state.setTimeoutTimestamp(int(s["_start"][closed]) + long - 1)  # times out when the watermark is above this
        else:
            state.remove()
        if closed:
            starts, cuts = np.unique(s["_start"][:closed], return_index=True)
            x, null = (np.split(s[c][:closed], cuts[1:]) for c in ("_x", "_null"))
            nan = [np.isnan(v) for v in x]
            yield pd.DataFrame({c: [k] * len(starts) for c, k in zip(ids, key, strict=False)} | {
                "_start": starts, "n": [len(v) for v in x], "x": [np.where(i, 0.0, v) for v, i in zip(x, nan, strict=True)],
                "_nulls": [np.flatnonzero(i) for i in null], "_nans": [np.flatnonzero(i) for i in nan],
            })

    found = rows.groupBy(*ids, "_block").applyInPandasWithState(step, out, "starts binary, at binary, x binary, nulls binary", "append", GroupStateTimeout.EventTimeTimeout)
    marked = F.transform("x", lambda v, i: F.when(F.array_contains("_nulls", i), F.lit(None)).when(F.array_contains("_nans", i), F.lit(float("nan"))).otherwise(v))
    x = F.when((F.size("_nulls") == 0) & (F.size("_nans") == 0), F.col("x")).otherwise(marked)
    return found.select(*ids, F.timestamp_millis("_start").alias("start"), "n", x.cast(f"array<{kind.simpleString()}>").alias("x"))


def late_rows(query) -> int:
    """How many rows the stream's stateful operators have dropped as late, of those batches whose progress Spark still has."""
    return sum(int(op["numRowsDroppedByWatermark"]) for p in query.recentProgress for op in p["stateOperators"])

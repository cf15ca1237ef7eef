"""Every stream, fed in several micro-batches, against its batch twin."""

import json
import os
import shutil

import numpy as np
import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from sigmill.functions import kernels as K
from sigmill.operators import frames as O
from sigmill.operators import signals as S
from sigmill.plans import jobs
from sigmill.sources import recordings as R
from sigmill.sources import views as V
from sigmill.streaming import keyed, stateful, windows

N = 620


@pytest.fixture(scope="module")
def fed(spark, tmp_path_factory):
    """Two recordings in five files, read one file a batch, and the same frames as a table."""
    rng = np.random.default_rng(0)
    folder = tmp_path_factory.mktemp("stream")
    rows = [(r, i, 1000 + i / 250.0, rng.normal(size=4).tolist()) for i in range(N) for r in ("a", "b")]
    for k in range(5):
        part = rows[k * len(rows) // 5 : (k + 1) * len(rows) // 5]
        (folder / f"{k}.json").write_text("".join(json.dumps(dict(zip(("recording_id", "sample_idx", "t_s", "ch"), r, strict=True))) + "\n" for r in part))
        os.utime(folder / f"{k}.json", (1_700_000_000 + 10 * k,) * 2)  # the source goes by file time
    batch = spark.createDataFrame(rows, "recording_id string, sample_idx long, t_s double, ch array<double>")
    return str(folder), batch


def source(spark, folder):
    schema = "recording_id string, sample_idx long, t_s double, ch array<double>"
    raw = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("latestFirst", False).json(folder)
    return raw.withColumn("ts", F.timestamp_micros((F.col("t_s") * 1_000_000).cast("long"))).withWatermark("ts", "1 hour")


def drained(spark, stream, tmp_path):
    q = R.publish(stream, str(tmp_path / "done"), str(tmp_path / "checkpoint"), available_now=True)
    assert q.awaitTermination(90), "the stream did not end"
    return spark.read.parquet(str(tmp_path / "done"))


def test_tumbling(spark, fed, tmp_path):
    folder, batch = fed
    got = {(r["recording_id"], r["window_idx"], r["channel"]): r["x"] for r in drained(spark, stateful.tumbling(source(spark, folder), 100), tmp_path).collect()}
    twin = O.tumbling_windows(O.frames_to_samples(batch).withColumnRenamed("channel_idx", "channel"), 100, "channel")
    want = {(r["recording_id"], r["window_idx"], r["channel"]): r["x"] for r in twin.collect()}
    assert got == want and len(got) == 2 * 6 * 4


def test_hopping(spark, fed, tmp_path):
    folder, batch = fed
    got = {(r["recording_id"], r["epoch"], r["channel"]): (r["t0"], r["x"]) for r in drained(spark, stateful.hopping(source(spark, folder)), tmp_path).collect()}
    twin = O.hop_epochs(O.frames_to_samples(batch).withColumnRenamed("channel_idx", "channel"), "channel")
    assert got == {(r["recording_id"], r["epoch"], r["channel"]): (r["t0"], r["x"]) for r in twin.collect()} and len(got) == 2 * 7 * 4


def test_windowed_jobs(spark, fed, tmp_path):
    folder, batch = fed
    for k, (stream, twin, keys, values) in enumerate([
        (stateful.psd_windows(source(spark, folder), V.bands("welch5")), jobs.psd_windows(batch, V.bands("welch5")), ("window_idx", "channel", "band"), ("power",)),
        (stateful.band_power(source(spark, folder), V.bands("fft5")), jobs.band_power_epochs(batch, V.bands("fft5")), ("epoch", "channel", "band"), ("t0", "power", "scaled")),
        (stateful.denoise_windows(source(spark, folder), 200), jobs.denoise_windows(O.frames_to_samples(batch), 200), ("window_idx", "channel"), ("filtered", "car", "stopped")),
    ]):
        as_dict = lambda df: {tuple(r[c] for c in ("recording_id", *keys)): np.concatenate([np.ravel(r[c]) for c in values]) for r in df.collect()}  # noqa: B023, E731
        got, want = as_dict(drained(spark, stream, tmp_path / str(k))), as_dict(twin)
        assert got.keys() == want.keys() and all(np.allclose(got[i], want[i], rtol=1e-9, atol=1e-12) for i in got)


def test_rolling_filter_and_kalman(spark, fed, tmp_path):
    folder, batch = fed
    out = drained(spark, stateful.trailing_and_kalman(source(spark, folder), factor=1.0), tmp_path)
    got = {(r["recording_id"], r["sample_idx"]): (r["filtered"], r["kalman"]) for r in out.collect()}
    twin = jobs.filter_rolling(batch, factor=1.0).collect()
    assert len(twin) == 3 * len(got) == 3 * 2 * (N - 125)
    for r in twin:
        f, k = got[(r["recording_id"], r["sample_idx"])]
        assert abs(f[r["channel_idx"]] - r["filtered"]) < 1e-9 and abs(k[r["channel_idx"]] - r["kalman"]) < 1e-9


def test_causal(spark, fed, tmp_path):
    folder, batch = fed
    got = {(r["recording_id"], r["sample_idx"]): r["value"] for r in drained(spark, stateful.causal_stream(source(spark, folder)), tmp_path).collect()}
    want = {(r["recording_id"], r["sample_idx"]): r["value"] for r in S.causal_chain(batch).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-7 for k in got)


def test_aligned_streams(spark, fed, tmp_path):
    folder, batch = fed
    one = source(spark, folder).withColumn("value", F.col("ch")[0])
    two = source(spark, folder).withColumn("value", F.col("ch")[1])
    assert drained(spark, stateful.align(one, two), tmp_path).count() == batch.count()


@pytest.mark.parametrize("form", ["tumbling", "hopping", "causal"])
def test_keyed_state_across_a_restart(spark, fed, tmp_path, form):
    """A stream that is stopped after two of five files and goes on from its checkpoint gives what its batch twin gives."""
    folder, batch = fed
    first = tmp_path / "in"
    first.mkdir()
    samples = O.frames_to_samples(batch).withColumnRenamed("channel_idx", "channel")
    make = {"tumbling": lambda s: keyed.tumbling(s, 100), "hopping": keyed.hopping, "causal": keyed.causal}[form]
    twin = {"tumbling": lambda: O.tumbling_windows(samples, 100, "channel"), "hopping": lambda: O.hop_epochs(samples, "channel"), "causal": lambda: S.causal_chain(batch)}[form]
    keys, value = {"tumbling": (("window_idx", "channel"), "x"), "hopping": (("epoch", "channel"), "x"), "causal": (("sample_idx",), "value")}[form]
    for files in (range(2), range(2, 5)):
        for k in files:
            shutil.copy2(f"{folder}/{k}.json", first / f"{k}.json")
        q = R.publish(make(source(spark, str(first))), str(tmp_path / "out"), str(tmp_path / "checkpoint"), available_now=True)
        assert q.awaitTermination(120)
    as_dict = lambda df: {(r["recording_id"], *(r[k] for k in keys)): np.ravel(r[value]) for r in df.collect()}
    rows = spark.read.parquet(str(tmp_path / "out"))
    got, want = as_dict(rows), as_dict(twin())
    assert rows.count() == len(got) and got.keys() == want.keys() and len(got) > 40
    assert all(np.allclose(got[k], want[k], atol=1e-7) for k in got)


def test_live_views(spark, fed, tmp_path):
    folder, batch = fed
    got = {(r["recording_id"], r["channel"], r["sample_idx"]): (r["lo"], r["hi"], r["shown_lo"], r["shown_hi"]) for r in drained(spark, keyed.rolling_range(source(spark, folder), 90), tmp_path / "r").collect()}
    twin = S.rolling_range(O.frames_to_samples(batch).withColumnRenamed("channel_idx", "channel"), 90)
    want = {(r["recording_id"], r["channel"], r["sample_idx"]): (r["lo"], r["hi"], r["shown_lo"], r["shown_hi"]) for r in twin.collect()}
    assert got.keys() == want.keys() and all(np.allclose(got[k], want[k]) for k in got)
    views = drained(spark, keyed.latest_n(source(spark, folder), 70), tmp_path / "l").collect()
    last = {r: max(v["view"] for v in views if v["recording_id"] == r) for r in ("a", "b")}
    assert last == {"a": 4, "b": 4}
    got = {(v["recording_id"], v["sample_idx"]): v["ch"] for v in views if v["view"] == last[v["recording_id"]]}
    assert got == {(r["recording_id"], r["sample_idx"]): r["ch"] for r in O.latest_n(batch, 70).collect()}


def test_first_frame_at_time_zero(spark, tmp_path):
    """Recordings count their time from 0; none of their frames is late by the clock of arrival, in any batch."""
    rows = [("a", i, i / 250.0, [float(i), 1.0]) for i in range(500)]
    (tmp_path / "in").mkdir()
    for k in range(2):
        text = "".join(json.dumps(dict(zip(("recording_id", "sample_idx", "t_s", "ch"), (f"r{k}", *r[1:]), strict=True))) + "\n" for r in rows)
        (tmp_path / "in" / f"{k}.json").write_text(text)
        os.utime(tmp_path / "in" / f"{k}.json", (1_700_000_000 + 3600 * k,) * 2)
    for k, make in enumerate((stateful.causal_stream, keyed.causal)):
        stream = R.read_sample_stream(spark, str(tmp_path / "in"), files_per_batch=1)
        got = drained(spark, make(stream), tmp_path / str(k)).groupBy("recording_id").count().collect()
        assert {r["recording_id"]: r["count"] for r in got} == {"r0": 500, "r1": 500}


def test_gap_in_a_stream(spark, tmp_path):
    rng = np.random.default_rng(9)
    rows = [("a", i, 1000 + i / 250.0, rng.normal(size=3).tolist()) for i in range(700) if i not in (20, *range(300, 320))]
    (tmp_path / "in").mkdir()
    for k, part in enumerate((rows[:150], rows[150:290], rows[290:])):
        (tmp_path / "in" / f"{k}.json").write_text("".join(json.dumps(dict(zip(("recording_id", "sample_idx", "t_s", "ch"), r, strict=True))) + "\n" for r in part))
        os.utime(tmp_path / "in" / f"{k}.json", (1_700_000_000 + 10 * k,) * 2)
    batch = spark.createDataFrame(rows, "recording_id string, sample_idx long, t_s double, ch array<double>")
    got = {r["sample_idx"]: r for r in drained(spark, stateful.trailing_and_kalman(source(spark, str(tmp_path / "in")), factor=1.0), tmp_path).collect()}
    want = jobs.filter_rolling(batch, factor=1.0).collect()
    assert {r["sample_idx"] for r in want} == set(got) == {*range(146, 300), *range(445, 700)}
    assert all(abs(got[r["sample_idx"]][c][r["channel_idx"]] - r[c]) < 1e-9 for r in want for c in ("filtered", "kalman"))


def test_late_and_repeated_rows(spark, tmp_path):
    (tmp_path / "in").mkdir()
    line = lambda i: json.dumps({"recording_id": "a", "sample_idx": i, "ts": f"2025-01-01T00:00:{i / 10:06.3f}Z", "value": float(i)}) + "\n"
    batches = [[*range(0, 100), 50, 51, 52], [*range(100, 120)], [*range(120, 200), 99, 98, 3, 20, 21], [*range(200, 300)]]
    batches[0] = [i for i in batches[0] if i not in (20, 95)]
    batches[2].append(95)
    for k, part in enumerate(batches):
        (tmp_path / "in" / f"{k}.json").write_text("".join(map(line, part)))
        os.utime(tmp_path / "in" / f"{k}.json", (1_700_000_000 + 10 * k,) * 2)
    raw = spark.readStream.schema("recording_id string, sample_idx long, ts timestamp, value double").option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    stream = windows.event_windows(raw.withWatermark("ts", "2 seconds"), seconds=4, fs=10.0, whole=False)
    q = R.publish(stream, str(tmp_path / "out"), str(tmp_path / "checkpoint"), available_now=True)
    assert q.awaitTermination(90)
    got = {r["start"].second: r["x"] for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    due = {s: [float(i) for i in range(10 * s, 10 * s + 40) if i != 20] for s in range(0, 24, 4)}  # 20 comes too late, 95 in time
    assert got == due
    assert windows.late_rows(q) == 3  # 3, 20 and 21


def test_event_windows_keep_a_state_row_for_many_windows(spark, tmp_path):
    """Windows over three batches and two blocks, given out once each when the watermark has passed their end; nulls, NaN and
    unordered and repeated samples are as in the table."""
    value = lambda i: None if i % 90 == 7 else float("nan") if i % 90 == 8 else float(i)
    line = lambda i, v: json.dumps({"recording_id": None if i % 2 else "a", "channel": i % 2, "sample_idx": None if i == 33 else i, "ts": f"2025-01-01T00:{i // 600:02d}:{i % 600 / 10:06.3f}Z", "value": v}) + "\n"
    due = [(i, value(i)) for i in range(9000)]
    parts = [[*due[4000::-1], (3990, 3990.0)], [(3995, -1.0), *due[4001:4100], (4100, 4100.0)], [(4099, -1.0), *due[4101:]]]
    (tmp_path / "in").mkdir()
    for k, part in enumerate(parts):
        (tmp_path / "in" / f"{k}.json").write_text("".join(line(*r) for r in part).replace("NaN", '"NaN"'))
        os.utime(tmp_path / "in" / f"{k}.json", (1_700_000_000 + 10 * k,) * 2)
    schema = "recording_id string, channel int, sample_idx long, ts timestamp, value double"
    raw = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    stream = windows.event_windows(raw.withWatermark("ts", "2 seconds"), "channel", seconds=4, whole=False)
    q = R.publish(stream, str(tmp_path / "out"), str(tmp_path / "checkpoint"), available_now=True)
    assert q.awaitTermination(90)
    table = spark.read.schema(schema).json(str(tmp_path / "in")).filter("value >= 0 or value is null or isnan(value)")
    want = windows.event_windows(table, "channel", seconds=4, whole=False).filter("start < timestamp'2025-01-01 00:14:56'")
    got = spark.read.parquet(str(tmp_path / "out"))
    assert stream.dtypes == want.dtypes and got.count() == want.count() == 2 * 224
    plain = lambda df: sorted(repr(tuple(r)) for r in df.collect())
    assert plain(got) == plain(want)
    assert windows.late_rows(q) == 0 and max(op["numRowsTotal"] for p in q.recentProgress for op in p["stateOperators"]) <= 8


def test_write_pair_stopped_between_its_writes(spark, fed, tmp_path):
    """The second table can't be written in the first run; after the restart every row is in both tables once."""
    folder, _ = fed
    f, k, checkpoint = (str(tmp_path / x) for x in "fkc")
    (tmp_path / "k").write_text("a file where the folder is to be")
    stream = lambda: stateful.trailing_and_kalman(source(spark, folder))
    q = stateful.write_pair(stream(), f, k, checkpoint, available_now=True)
    with pytest.raises(StreamingQueryException):
        q.awaitTermination(90)
    assert os.listdir(f)  # the first table has the batch already
    (tmp_path / "k").unlink()
    assert stateful.write_pair(stream(), f, k, checkpoint, available_now=True).awaitTermination(90)
    tables = [spark.read.option("header", True).csv(p) for p in (f, k)]
    for t in tables:
        assert t.count() == t.select("recording_id", "Timestamp").distinct().count() == 2 * (N - 125)
    assert tables[0].select("batch", "recording_id", "Timestamp").exceptAll(tables[1].select("batch", "recording_id", "Timestamp")).count() == 0


def test_band_table_of_a_stream(spark, fed, tmp_path):
    folder, batch = fed
    q = stateful.write_band_table(stateful.psd_windows(source(spark, folder), V.bands("welch5")), str(tmp_path / "t"), str(tmp_path / "c"), "window_idx", available_now=True)
    assert q.awaitTermination(90)
    got = spark.read.option("header", True).csv(str(tmp_path / "t"))
    assert got.count() == 2 * (N // 40) and set(R.BAND_COLUMNS) <= set(got.columns)


def test_pair_of_sinks(spark, fed, tmp_path):
    folder, batch = fed
    q = stateful.write_pair(stateful.trailing_and_kalman(source(spark, folder)), str(tmp_path / "f"), str(tmp_path / "k"), str(tmp_path / "c"))
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    for p in ("f", "k"):
        t = spark.read.option("header", True).csv(str(tmp_path / p))
        assert t.columns == ["recording_id", "Timestamp", "Canal1", "Canal2", "Canal3", "batch"] and t.count() == 2 * (N - 125)


def test_malformed_and_silent_frames(spark, tmp_path):
    """Silent and empty frames at the beginning, short ones within: batch and stream agree and none fails."""
    rng = np.random.default_rng(1)
    rows = []
    for i in range(400):
        ch = [0.0] * 4 if i < 20 else rng.normal(size=4).tolist()
        rows.append(("a", i, 1000 + i / 250.0, [] if i == 5 else ch[:2] if i in (60, 61) else ch))
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "0.json").write_text("".join(json.dumps(dict(zip(("recording_id", "sample_idx", "t_s", "ch"), r, strict=True))) + "\n" for r in rows))
    batch = spark.createDataFrame(rows, "recording_id string, sample_idx long, t_s double, ch array<double>")
    got = {r["sample_idx"]: r for r in drained(spark, stateful.trailing_and_kalman(source(spark, str(folder)), factor=1.0), tmp_path / "k").collect()}
    want = {(r["sample_idx"], r["channel_idx"]): r for r in jobs.filter_rolling(batch, factor=1.0).collect()}
    assert {i for i, _ in want} == set(got) == set(range(145, 400))
    assert all(abs(got[i]["kalman"][c] - r["kalman"]) < 1e-9 for (i, c), r in want.items())
    windows = drained(spark, stateful.denoise_windows(source(spark, str(folder)), 100), tmp_path / "w").groupBy("window_idx").count().collect()
    assert {r["window_idx"]: r["count"] for r in windows} == {0: 2, 1: 4, 2: 4}

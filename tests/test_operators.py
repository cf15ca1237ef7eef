"""Operators, sources and jobs on small fixtures; the SQL oracles cover the rest over the given tables."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from sigmill.functions import kernels as K
from sigmill.operators import frames as O
from sigmill.operators import signals as S
from sigmill.plans import jobs, registry
from sigmill.sources import recordings as R
from sigmill.sources import views as V

SF = "/root/testdata/sf0.001"
FS = 250.0


def frame_rows(n, channels=8, recording="r1", fs=FS, seed=0):
    x = np.random.default_rng(seed).normal(size=(n, channels))
    return [(recording, i, i / fs, x[i].tolist()) for i in range(n)], x


@pytest.fixture(scope="module")
def frames(spark):
    rows, x = frame_rows(2100)
    return spark.createDataFrame(rows, "recording_id string, sample_idx long, t_s double, ch array<double>").repartition(5), x


def collected(df, *keys, value="value"):
    return {tuple(r[k] for k in keys): r[value] for r in df.collect()}


# ---- sources -----------------------------------------------------------------------------------------------------


def test_header_sniffing():
    assert R.detect_time_column(["a", "Time and date", "x"]) == "Time and date"
    assert R.detect_channels(["t", "Fp1", "CH2", "channel_x", "Canal1", "chx"]) == ["Fp1", "CH2", "channel_x"]
    assert R.detect_channels(["Canal1", "canal2"], canal=True) == ["Canal1", "canal2"]
    assert R.first_channel(["ch1", "Channel_1"]) == "Channel_1" and R.first_channel(["O1"]) == "O1"
    for f in (R.detect_time_column, R.detect_channels):
        with pytest.raises(ValueError):
            f(["x", "y"])


def test_clinical_and_dirty_recordings(spark, tmp_path):
    (tmp_path / "eeg.csv").write_text("'Time and date','Fp1','C3'\n,uV,uV\n'[10:00:00.004 01/02/2024]','1.5','2'\n'[10:00:00.000 01/02/2024]',nan,x\nbad,3,4\n")
    got = R.read_recordings(spark, str(tmp_path / "eeg.csv")).orderBy("t_s").collect()
    assert len(got) == 3 and [r["bad_time"] for r in got] == [True, False, False]
    assert got[1]["ts"].strftime("%H:%M:%S.%f") == "10:00:00.000000" and math.isnan(got[1]["ch"][0]) and got[1]["ch"][1] is None
    assert got[2]["ch"] == [1.5, 2.0] and got[2]["t_s"] - got[1]["t_s"] == pytest.approx(0.004, abs=1e-6)
    assert got[0]["recording_id"] == "eeg" and got[0]["channel_names"] == ["Fp1", "C3"]
    assert R.read_recordings(spark, str(tmp_path / "eeg.csv"), units_row=False).count() == 4


def test_latest_recording(spark, tmp_path):
    import os

    for i, n in enumerate(["device_1.csv", "device_2.csv", "other.csv"]):
        (tmp_path / n).write_text("timestamp,ch1\n0,1\n")
        os.utime(tmp_path / n, (1000 + i, 1000 + (5 - i)))
    assert R.latest_recording(R.files(spark, str(tmp_path)), "device_").first()["recording"] == "device_1"
    (tmp_path / "eeg.csv").write_text("timestamp,ch1\n0,1\n")
    assert R.latest_recording(R.files(spark, str(tmp_path)), "device_").first()["recording"] == "eeg"


def test_written_recording_reads_back(spark, tmp_path, frames):
    df, x = frames
    R.write_recording(df, str(tmp_path / "out"), [f"ch{i}" for i in range(1, 9)])
    back = spark.read.option("header", True).csv(str(tmp_path / "out"))
    assert back.columns == ["timestamp", *[f"ch{i}" for i in range(1, 9)], "recording_id"] and back.count() == len(x)


def test_band_table_columns(spark):
    rows = [("r", 0, c, b, float(c)) for c in (1, 2, 3) for b in ("delta", "theta", "alpha", "beta", "gamma")]
    t = R.band_table(spark.createDataFrame(rows, "recording_id string, window_idx long, channel int, band string, power double"), "window_idx")
    assert t.columns == ["recording_id", "window_idx", *R.BAND_COLUMNS] and t.first()["Gamma3"] == 3.0


# ---- operators ---------------------------------------------------------------------------------------------------


def test_clock_times(spark):
    rows = [("[1:02:03.5 4/5/2024]",), ("'[01:02:03.500 04/05/2024]'",), ("junk",), (None,)]
    got = [r[0] for r in spark.createDataFrame(rows, "c string").select(O.parse_clock_time(F.col("c"))).collect()]
    assert got[0] == got[1] and got[0].microsecond == 500000 and got[2:] == [None, None]


def test_hop_rule_against_a_literal_loop(spark):
    n = 2000
    buffer, out, extra = [], [], []
    for i in range(n):  # fill up to 250; then every 51st sample gives out the last 250 and is dropped
        if len(buffer) < 250:
            buffer.append(i)
        elif len(extra) < 50:
            extra.append(i)
        else:
            buffer = buffer[50:] + extra
            out.append(list(buffer))
            extra = []
    s = spark.createDataFrame([("r", i, i / FS, float(i)) for i in range(n)], "recording_id string, sample_idx long, t_s double, value double").repartition(4)
    got = O.hop_epochs(s).orderBy("epoch").collect()
    assert [r["x"] for r in got] == out and len(out) == 34 and out[0][0] == 50
    plain = O.hop_epochs(s, lossless=True).orderBy("epoch").collect()
    assert plain[0]["x"][0] == 0 and plain[1]["x"][0] == 50 and all(len(r["x"]) == 250 for r in plain)


def test_tumbling_drops_the_last_part(spark, frames):
    df, x = frames
    w = O.tumbling_windows(O.pick_channel(df, 2), 1000).orderBy("window_idx").collect()
    assert len(w) == 2 and np.allclose(w[1]["x"], x[1000:2000, 2]) and w[1]["t0"] == 4.0


def test_edges_of_time(spark):
    schema = "recording_id string, sample_idx long, t_s double, value double"
    one = spark.createDataFrame([("a", 0, 1.0, 5.0), ("b", 0, 0.0, 1.0), ("b", 1, 0.5, None)], schema)
    p = {r["recording_id"]: r for r in O.recording_profile(one).collect()}
    assert p["a"]["rate"] == 0 and p["a"]["dt_mean"] is None and p["b"]["rate"] == 2 and p["b"]["n_values"] == 1 and p["b"]["gap"] == 1
    assert {r["recording_id"]: r["rate"] for r in O.sampling_rate(one).collect()} == {"a": 0.0, "b": 2.0}
    assert O.recording_profile(one.filter("false")).count() == 0
    crossing = spark.createDataFrame([("a", i, i * 2.0, 0.0) for i in range(6)], schema)
    assert [r["sample_idx"] for r in O.capture_first(crossing, 5.0).orderBy("sample_idx").collect()] == [0, 1, 2, 3]


def test_flat_channel_has_no_zscore(spark):
    s = spark.createDataFrame([("a", "c", i, 0.0, 1.0) for i in range(4)], "recording_id string, channel string, sample_idx long, t_s double, value double")
    assert {r["z"] for r in O.zscore(s).collect()} == {None}


def test_trailing_filter_and_kalman_cross_chunks(spark, frames):
    df, x = frames
    s = O.pick_channel(df, 0)
    h = K.trailing_weights(125, FS)
    got = collected(S.trailing_filter(s), "sample_idx")
    assert sorted(got) == [(i,) for i in range(125, 2100)]
    assert all(abs(got[(i,)] - x[i - 124 : i + 1, 0] @ h) < 1e-9 for i in (125, 999, 1000, 1001, 2099))
    got = collected(S.kalman_smooth(s), "sample_idx")
    assert np.allclose([got[(i,)] for i in range(2100)], K.kalman(x[None, :, 0])[0], atol=1e-9)


def test_causal_chain_in_blocks_is_the_whole_filter(spark, frames):
    df, x = frames
    band, gain, _ = K.named_filter("bandpass", FS)
    stop, stop_gain, _ = K.named_filter("bandstop", FS, 59.0, 61.0)
    y, _ = K.run_sections(band, gain, (x[:, 1] - x.mean(1))[None], np.zeros((len(band), 2, 1)))
    y, _ = K.run_sections(stop, stop_gain, y, K.steady_state(stop, stop_gain)[:, :, None])
    got = collected(S.causal_chain(df, 1), "sample_idx")
    assert np.allclose([got[(i,)] for i in range(2100)], y[0], atol=1e-7)


def test_results_do_not_depend_on_partitions(spark, frames):
    df, _ = frames
    one = jobs.denoise_recordings(df.coalesce(1)).drop("z").orderBy("channel").collect()
    many = jobs.denoise_recordings(df.repartition(7)).drop("z").orderBy("channel").collect()
    for a, b in zip(one, many, strict=True):
        assert np.allclose(a[3:], b[3:], rtol=1e-9) and a["n"] == 1000


def test_short_recording_gives_nulls(spark):
    rows, _ = frame_rows(20, recording="short")
    got = jobs.denoise_recordings(spark.createDataFrame(rows, "recording_id string, sample_idx long, t_s double, ch array<double>")).collect()
    assert len(got) == 8 and all(r["z"] is None and r["power_raw"] is None for r in got)


def test_bandpass_commutes_with_the_average(spark, frames):
    df, _ = frames
    stages = jobs.denoise_windows(O.frames_to_samples(df)).filter("channel = 3 and window_idx = 0").first()
    w = O.tumbling_windows(O.pick_channel(O.car(df), 3), 1000).filter("window_idx = 0")
    assert np.allclose(S.bandpass(w, FS).first()["x"], stages["car"], atol=1e-8)


# ---- queries -----------------------------------------------------------------------------------------------------

CHECKED = sorted(registry.ORACLE)


@pytest.mark.parametrize("name", CHECKED)
def test_query_equals_its_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in ("embeddings", "lineitem", "events", "customer"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    want = con.execute(registry.ORACLE[name]).df()
    got = registry.QUERIES[name](spark, SF).toPandas()[list(want.columns)]
    key = list(want.columns)
    a, b = (d.astype(object).where(d.notna(), None).sort_values(key, key=lambda c: c.astype(str)).values.tolist() for d in (got, want))
    assert sorted(map(repr, [[float(v) if isinstance(v, (int, float)) else v for v in r] for r in a])) == sorted(map(repr, [[float(v) if isinstance(v, (int, float)) else v for v in r] for r in b]))


def test_entry_runs(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 64
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_bands_views_agree(spark):
    assert len(V.bands("fft5")) == 5 and len(V.bands("welch5")) == 5


# ---- rows that are not as they should be -------------------------------------------------------------------------


def test_missing_values_stay_in_their_series(spark):
    rows, _ = frame_rows(2100)
    gaps = [(r, i, t, [float("nan")] * 8 if 1000 <= i < 2000 else c) for r, i, t, c in rows]
    df = spark.createDataFrame(gaps, "recording_id string, sample_idx long, t_s double, ch array<double>")
    got = collected(S.causal_chain(df), "sample_idx")
    assert got[(999,)] is not None and got[(1000,)] is None and got[(2099,)] is None
    w = O.tumbling_windows(O.pick_channel(df, 0), 1000).select("recording_id", "window_idx", "x")
    assert [set(r["x"]) == {None} for r in S.bandpass(w, FS).orderBy("window_idx").collect()] == [False, True]


def test_canceller_without_a_reference(spark):
    rows = [(0, [1.0, 2.0], None), (1, None, [1.0, 2.0]), (2, [1.0, 2.0], [1.0]), (3, [], []), (4, [1.0, 2.0], [1.0, 1.0])]
    got = S.rls_cancel(spark.createDataFrame(rows, "k int, x array<double>, ref array<double>")).orderBy("k").collect()
    assert [r["error"] is None for r in got] == [True, True, True, True, False] and got[4]["weight"][0] == 1.0


def test_channels_with_gaps_are_left_out_of_a_window(spark):
    rows, x = frame_rows(200, 4)
    ragged = [(r, i, t, c[:3] if i == 77 else c) for r, i, t, c in rows]
    samples = lambda some: O.frames_to_samples(spark.createDataFrame(some, "recording_id string, sample_idx long, t_s double, ch array<double>"))
    got = {r["channel"]: r["car"] for r in jobs.denoise_windows(samples(ragged), 100).filter("window_idx = 0").collect()}
    want = {r["channel"]: r["car"] for r in jobs.denoise_windows(samples([(r, i, t, c[:3]) for r, i, t, c in rows]), 100).filter("window_idx = 0").collect()}
    assert sorted(got) == [0, 1, 2] and all(np.allclose(got[c], want[c]) for c in got)
    assert jobs.denoise_windows(samples(rows), 20).count() == 0  # too short for the filter


def test_three_channels_are_averaged_over_eight_slots(spark):
    rows, x = frame_rows(1300, 3)
    df = spark.createDataFrame(rows, "recording_id string, sample_idx long, t_s double, ch array<double>")
    band, gain, _ = K.named_filter("bandpass", FS)
    stop, stop_gain, _ = K.named_filter("bandstop", FS, 59.0, 61.0)
    start = K.steady_state(band, gain)[:, :, None]
    each = np.stack([K.run_sections(band, gain, x[None, :, c], start)[0][0] for c in range(3)])
    y, _ = K.run_sections(stop, stop_gain, (each[0] - each.sum(0) / 8)[None], K.steady_state(stop, stop_gain)[:, :, None])
    got = collected(S.causal_chain(df), "sample_idx")
    assert np.allclose([got[(i,)] for i in range(1300)], y[0], atol=1e-7)


def test_small_noise_ratios_remember_longer(spark):
    rng = np.random.default_rng(5)
    z = rng.normal(size=9000)
    df = spark.createDataFrame([("r", i, i / FS, float(v)) for i, v in enumerate(z)], "recording_id string, sample_idx long, t_s double, value double").repartition(4)
    got = collected(S.kalman_smooth(df, q=1e-4, r=1.0), "sample_idx")
    assert K.kalman_memory(1e-4, 1.0)[1] > 1000
    assert np.allclose([got[(i,)] for i in range(9000)], K.kalman(z[None], 1e-4, 1.0)[0], atol=1e-9)
    with pytest.raises(ValueError):
        K.kalman_memory(0.0, 1.0)


def test_header_of_another_family_fails(spark, tmp_path):
    (tmp_path / "a.csv").write_text("timestamp,ch1\n0,1\n")
    (tmp_path / "b.csv").write_text("timestamp,ch2\n0,1\n")
    with pytest.raises(Exception, match="header"):
        R.read_recordings(spark, str(tmp_path)).collect()
    assert R.read_families(spark, [str(tmp_path / "a.csv"), str(tmp_path / "b.csv")]).count() == 2


def test_windowed_cleaning_holds_one_window_at_a_time(spark):
    rows = spark.range(40 * 50).selectExpr("'a' as recording_id", "id % 2 as channel_idx", "id div 2 as sample_idx", "cast(sin(id) as double) as value")
    found = jobs.denoise_windows(rows.filter("not (channel_idx = 1 and sample_idx = 3)"), 50)
    got = sorted((r["window_idx"], r["channel"], len(r["stopped"])) for r in found.collect())
    assert got == [(w, c, 50) for w in range(20) for c in range(2) if (w, c) != (0, 1)]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapGroupsInArrow" in plan and "ArrowEvalPython" not in plan  # no batch of many windows
    assert jobs.denoise_windows(rows, 3000).count() == 0


def test_rows_of_a_batch_are_worked_on_in_bounded_matrices():
    import pandas as pd

    sizes = []
    got = S.by_length(lambda m: [sizes.append(m.size) or m * 2], 1, pd.Series([np.full(500, float(i)) for i in range(3000)]))[0]
    assert max(sizes) <= 1 << 18 and sum(sizes) == 1_500_000
    assert [float(x[0]) for x in got] == [2.0 * i for i in range(3000)]

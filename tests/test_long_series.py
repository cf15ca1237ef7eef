"""Recordings of any length: buckets, block scans, gaps; every form against the plain one."""

import math

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from sigmill.functions import kernels as K
from sigmill.operators import frames as O
from sigmill.operators import series
from sigmill.operators import signals as S

FS = 250.0


def frame(spark, values, name="a", first=0):
    return spark.createDataFrame([(name, i + first, (i + first) / FS, float(v)) for i, v in enumerate(values)], "recording_id string, sample_idx long, t_s double, value double")


@pytest.fixture(scope="module")
def jittered(spark):
    """Two recordings with ties, empty stretches, null and NaN times and missing values."""
    rng = np.random.default_rng(4)
    rows = []
    for r in ("a", "b"):
        t = np.round(np.cumsum(rng.exponential(0.7, 300)) + 40 * (np.arange(300) > 150), 1)
        for i in range(300):
            time = None if i % 41 == 5 else math.nan if i % 67 == 9 else float(t[i])
            rows.append((r, i, time, [1.0 * i, 2.0 * i, 3.0][: 3 if i % 3 else rng.integers(0, 3)], float(i) if i % 4 else None))
    return spark.createDataFrame(rows, "recording_id string, sample_idx long, t_s double, ch array<double>, value double").repartition(5).cache()


def by_row(df, *columns):
    """Values by recording and original row, NaN made comparable."""
    return {(r["recording_id"], r["sample_idx"]): tuple(str(r[c]) for c in columns) for r in df.collect()}


@pytest.mark.parametrize("width", [0.5, 10.0, 1e9])
def test_buckets_do_not_change_results(jittered, width):
    w = Window.partitionBy("recording_id").orderBy("t_s", "sample_idx")
    plain = jittered.withColumn("n", F.row_number().over(w).cast("long") - 1).withColumn("p", F.lag("value").over(w))
    good = F.when(F.size("ch") >= 3, F.col("ch"))
    plain = plain.withColumn("c", F.last(good, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    order = ["t_s", "sample_idx"]
    got = series.number(jittered, ["recording_id"], order, width, "n")
    got = series.previous(got, ["recording_id"], order, "value", "p", width)
    got = series.carry(got, ["recording_id"], order, good, "c", width)
    assert by_row(got, "n", "p", "c") == by_row(plain, "n", "p", "c")


@pytest.mark.parametrize("width", [0.5, 10.0, 1e9])
def test_profiles_are_put_together_from_buckets(spark, jittered, width):
    regular = spark.createDataFrame([("c", i, 1e9 + i / FS, [], 1.0) for i in range(2000)], jittered.schema)
    rows = jittered.filter("not isnan(t_s) or t_s is null").unionByName(regular)
    extra = {"untimed": (F.count_if(F.col("t_s").isNull()), F.sum), "top": (F.max("sample_idx"), F.max)}
    got = {r["recording_id"]: r for r in O.recording_profile(rows, width, extra).collect()}
    for name, r in got.items():
        own = [x for x in rows.collect() if x["recording_id"] == name]
        t = np.sort([x["t_s"] for x in own if x["t_s"] is not None])
        d = np.diff(t)
        assert (r["n_rows"], r["n_values"]) == (len(t), sum(x["t_s"] is not None and x["value"] is not None for x in own))
        assert (r["untimed"], r["top"]) == (len(own) - len(t), max(x["sample_idx"] for x in own))
        assert [r["t_first"], r["t_last"], r["dt_min"], r["dt_max"]] == [t[0], t[-1], d.min(), d.max()]
        assert r["dt_mean"] == pytest.approx(d.mean(), rel=1e-12) and r["dt_std"] == pytest.approx(d.std(), rel=1e-6)
    assert len(got) == 3


def test_operators_on_tiny_buckets(jittered):
    whole, tiny = 1e9, 3.0
    for op, columns in ((lambda s: O.fill_malformed(jittered, 3, s), ["ch"]), (lambda s: O.sample_intervals(jittered, s), ["dt"])):
        assert by_row(op(tiny), *columns) == by_row(op(whole), *columns)
    renumbered = [sorted(map(str, O.order_by_time(jittered, s).collect())) for s in (tiny, whole)]
    assert renumbered[0] == renumbered[1]
    times = jittered.filter("t_s is not null and not isnan(t_s)")
    small, large = ({r["recording_id"]: tuple(r)[1:] for r in O.recording_profile(times, s).collect()} for s in (tiny, whole))
    assert small.keys() == large.keys() and all(np.allclose(small[k], large[k]) for k in large)


def test_empty_series(spark, jittered):
    none = jittered.filter("false")
    assert O.fill_malformed(none, 3).count() == O.order_by_time(none).count() == O.sample_intervals(none).count() == 0


# ---- zero phase --------------------------------------------------------------------------------------------------


def one_shot(x, kind, low, high):
    sections, gain, pad = K.named_filter(kind, FS, low, high)
    return K.zero_phase(sections, gain, np.asarray(x, float)[None], pad)[0]


def values(df):
    return np.array([np.nan if r["value"] is None else r["value"] for r in sorted(df.collect(), key=lambda r: r["sample_idx"])])


def test_zero_phase_of_a_long_series(spark):
    x = np.cumsum(np.random.default_rng(0).normal(size=100_000))
    df = spark.range(100_000).select(F.lit("a").alias("recording_id"), F.col("id").alias("sample_idx"), (F.col("id") / FS).alias("t_s"))
    table = spark.createDataFrame(list(enumerate(x.tolist())), "sample_idx long, value double")
    got = values(S.zero_phase_series(df.join(table, "sample_idx"), "bandpass", FS, 0.2, 50.0, size=1000))
    assert np.abs(got - one_shot(x, "bandpass", 0.2, 50.0)).max() < 1e-9 * np.abs(x).max()


@pytest.mark.parametrize(("kind", "low", "high"), [("bandpass", 0.2, 50.0), ("bandstop", 59.0, 61.0), ("notch", 50.0, 0.0), ("lowpass", 0.0, 10.0)])
def test_zero_phase_kinds_and_lengths(spark, kind, low, high):
    rng = np.random.default_rng(1)
    for n in (1, 27, 28, 40, 100, 129):
        x = rng.normal(size=n)
        pad = K.named_filter(kind, FS, low, high)[2]
        got = values(S.zero_phase_series(frame(spark, x), kind, FS, low, high, size=32))
        assert len(got) == n
        assert np.isnan(got).all() if n <= pad else np.allclose(got, one_shot(x, kind, low, high), atol=1e-9)


def test_zero_phase_keys_gaps_and_rates(spark):
    x = np.random.default_rng(2).normal(size=300)
    keep = np.r_[0:3, 40:41, 90:260, 299:300]  # the first and last blocks hold fewer samples than the padding
    a = frame(spark, x, "a").filter(F.col("sample_idx").isin(keep.tolist())).withColumn("channel", F.lit(0))
    b = frame(spark, 2 * x[:200], "a", first=-50).withColumn("channel", F.lit(1))
    got = S.zero_phase_series(a.union(b), "bandpass", FS, 1.0, 40.0, "channel", size=30)
    assert np.allclose(values(got.filter("channel = 0")), one_shot(x[keep], "bandpass", 1.0, 40.0), atol=1e-9)
    assert np.allclose(values(got.filter("channel = 1")), one_shot(2 * x[:200], "bandpass", 1.0, 40.0), atol=1e-9)
    assert np.isnan(values(S.zero_phase_series(a, "bandpass", 60.0, 1.0, 40.0))).all()


# ---- Welch -------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize(("n", "nperseg", "group"), [(5000, 256, 64), (1000, 256, 2), (777, 100, 3), (301, 101, 1), (256, 256, 5)])
def test_welch_of_whole_series(spark, n, nperseg, group):
    x = np.random.default_rng(n).normal(size=n)
    r = S.welch_series(frame(spark, x), FS, nperseg=nperseg, group=group).collect()
    f, p = K.welch(x[None], FS, nperseg)
    assert len(r) == 1 and np.allclose(r[0]["p"], p[0], rtol=1e-10) and r[0]["step"] * (len(f) - 1) == pytest.approx(f[-1])
    assert r[0]["n_segments"] == 1 + (n - nperseg) // (nperseg - nperseg // 2)


def test_welch_leaves_out_incomplete_segments(spark):
    x = np.random.default_rng(3).normal(size=600)
    df = frame(spark, x).filter("sample_idx <> 130").withColumn("value", F.when(F.col("sample_idx") != 400, F.col("value")))
    r = S.welch_series(df, FS, nperseg=100).first()
    whole = [x[a : a + 100] for a in range(0, 501, 50) if not a <= 130 < a + 100 and not a <= 400 < a + 100]
    assert r["n_segments"] == len(whole) and np.allclose(r["p"], K.welch(np.array(whole), FS, 100)[1].mean(0))
    assert S.welch_series(df.filter("sample_idx < 99"), FS, nperseg=100).count() == 0


# ---- gaps --------------------------------------------------------------------------------------------------------


def gapped(spark, n=2600):
    x = np.random.default_rng(6).normal(size=n)
    keep = np.ones(n, bool)
    keep[[100, 999]] = keep[480:700] = keep[1990:2010] = keep[2400:2420] = False
    return x, keep, frame(spark, x).filter(F.col("sample_idx").isin(np.flatnonzero(keep).tolist())).withColumn("channel", F.lit(0))


def segments(keep):
    at = np.flatnonzero(keep)
    return np.split(at, np.flatnonzero(np.diff(at) != 1) + 1)


@pytest.mark.parametrize("chunk", [200, 1000, 100_000])
def test_gaps_begin_anew_wherever_chunks_end(spark, monkeypatch, chunk):
    x, keep, df = gapped(spark)
    monkeypatch.setattr(S, "CHUNK", chunk)
    h = K.trailing_weights(125, FS)
    want, smooth, both = {}, {}, {}
    for part in segments(keep):
        rolled = [h @ x[i - 124 : i + 1] for i in part[125:]]
        want |= dict(zip(part[125:].tolist(), rolled, strict=True))
        smooth |= dict(zip(part.tolist(), K.kalman(x[part][None])[0], strict=True))
        if rolled:
            both |= dict(zip(part[125:].tolist(), K.kalman(np.array(rolled)[None])[0], strict=True))
    for got, expected, column in (
        (S.trailing_filter(df, "channel"), want, "value"), (S.kalman_smooth(df, "channel"), smooth, "value"),
        (S.trailing_and_kalman(df, "channel"), want, "filtered"), (S.trailing_and_kalman(df, "channel"), both, "kalman"),
    ):
        found = {r["sample_idx"]: r[column] for r in got.collect()}
        assert found.keys() == expected.keys()
        assert max(abs(found[i] - v) for i, v in expected.items()) < 1e-9


def test_a_missing_value_spoils_as_much_wherever_it_is(spark, monkeypatch):
    x = np.random.default_rng(7).normal(size=1200)
    df = frame(spark, x).withColumn("value", F.when(~F.col("sample_idx").isin(10, 700), F.col("value")))
    memory = K.kalman_memory()[1]
    for chunk in (150, 5000):
        monkeypatch.setattr(S, "CHUNK", chunk)
        bad = {r["sample_idx"] for r in S.kalman_smooth(df).collect() if r["value"] is None or math.isnan(r["value"])}
        assert bad == {*range(10, 10 + memory), *range(700, 700 + memory)}


@pytest.mark.parametrize("n", [1, 7, 100])
def test_rolling_range_over_places(spark, n):
    x, keep, df = gapped(spark, 2600)
    df = df.withColumn("value", F.when(F.col("sample_idx") != 55, F.col("value")))
    for prefill in (False, True):
        got = {r["sample_idx"]: r for r in S.rolling_range(df, n, prefill_zero=prefill).collect()}
        assert len(got) == keep.sum()
        for i in np.flatnonzero(keep):
            there = [x[j] for j in range(max(0, i - n + 1), i + 1) if keep[j] and j != 55] + ([0.0] if prefill and i < n - 1 else [])
            lo, hi = (min(there), max(there)) if there else (None, None)
            assert (got[i]["lo"], got[i]["hi"]) == (lo, hi)
            if there:
                assert got[i]["shown_hi"] == pytest.approx(hi + 0.1 * (hi - lo)) and got[i]["shown_lo"] == pytest.approx(lo - 0.1 * (hi - lo))


def test_epochs_do_not_depend_on_groups(spark):
    df = frame(spark, np.arange(2000)).withColumn("channel", F.lit(1))
    lossy = df.filter("sample_idx not in (700, 1504)")
    for source, lossless in ((df, False), (df, True), (lossy, False), (lossy, True)):
        found = [sorted(map(tuple, O.hop_epochs(source, "channel", lossless=lossless, group=g).collect())) for g in (1, 3, 16, 500)]
        assert found[0] == found[1] == found[2] == found[3] and found[0]
    plain = [x for *_, x in sorted(map(tuple, O.hop_epochs(lossy, "channel", lossless=True).collect()), key=lambda r: r[2])]
    present = set(range(2000)) - {700, 1504}
    assert plain == [[float(v) for v in range(a, a + 250)] for a in range(0, 1751, 50) if set(range(a, a + 250)) <= present]


# ---- kernels' matrices -------------------------------------------------------------------------------------------


def test_matrices_are_bounded_and_change_nothing():
    kept = K.Operators(limit=4 * 8 * 100 * 100)
    x = np.random.default_rng(0).normal(size=(60, 100))
    keys = [("bandpass", 100, FS, 1.0 + k, 40.0, 4, 30.0) for k in range(6)]
    assert kept.get(keys[0], 60) is None and kept.get(keys[0], 60) is not None  # worth it after 100 rows
    for key in keys:
        matrix = kept.get(key, 100)
        sections, gain, pad = K.named_filter("bandpass", FS, key[3], 40.0)
        assert np.allclose(x @ matrix, K.zero_phase(sections, gain, x, pad))
        assert kept.bytes == sum(m.nbytes for m in kept.kept.values()) <= kept.limit
    assert kept.get(("bandpass", 101, FS, 1.0, 40.0, 4, 30.0), 10**6) is None  # larger than a quarter of the room

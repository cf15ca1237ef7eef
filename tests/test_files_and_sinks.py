"""Folders of dirty exports, and sinks that survive a restart."""

import time
from unittest.mock import MagicMock

import numpy as np
import pandas as pd
import pytest

from sigmill.plans import jobs, registry
from sigmill.sources import recordings as R
from sigmill.streaming import keyed

DEVICE = "timestamp,Channel_1,note,Channel_2\n" + "".join(f"{i / 250},{i}.5,x,{-i}\n" for i in range(400))
OLD = "\n  \nTimeStamp,ch1,ch2\nbad,1,2\n" + "".join(f"{5 + i / 100:.2f},{i},nan\n" for i in range(300))
CLINICAL = "'Time and date' ,'Fp1','O2'\n,uV,uV\n" + "".join(f"'[10:00:{i // 250:02d}.{4 * (i % 250):03d} 14/11/2025]','{i}',' {2 * i}'\n" for i in range(500)) + "'never','7','7'\n"


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "one").mkdir()
    (tmp_path / "two" / "deep").mkdir(parents=True)
    (tmp_path / "one" / "aura_1.csv").write_text(DEVICE)
    (tmp_path / "two" / "aura_2.csv").write_text(DEVICE.replace("0.5,", ",", 1))
    (tmp_path / "two" / "old.csv").write_text(OLD)
    (tmp_path / "two" / "deep" / "eeg.csv").write_text(CLINICAL)
    (tmp_path / "two" / "empty.csv").write_text("")
    (tmp_path / "two" / "notes.txt").write_text("no,recording\n")
    return tmp_path


def test_families_are_found(spark, folder):
    got = {r["file_path"].rsplit("/", 1)[1]: r["header"] for r in R.header_families(spark, str(folder)).collect()}
    assert got == {"aura_1.csv": DEVICE.split("\n")[0], "aura_2.csv": DEVICE.split("\n")[0], "old.csv": "TimeStamp,ch1,ch2", "eeg.csv": CLINICAL.split("\n")[0]}


def test_a_folder_of_mixed_exports(spark, folder):
    rows = R.read_folder(spark, str(folder)).collect()
    count, bad, names = {}, {}, {}
    for r in rows:
        count[r["recording_id"]] = count.get(r["recording_id"], 0) + 1
        bad[r["recording_id"]] = bad.get(r["recording_id"], 0) + r["bad_time"]
        names[r["recording_id"]] = r["channel_names"]
    assert count == {"aura_1": 400, "aura_2": 400, "old": 301, "eeg": 501}
    assert bad == {"aura_1": 0, "aura_2": 0, "old": 1, "eeg": 1}
    assert names == {"aura_1": ["Channel_1", "Channel_2"], "aura_2": ["Channel_1", "Channel_2"], "old": ["ch1", "ch2"], "eeg": ["Fp1", "O2"]}
    eeg = sorted((r for r in rows if r["recording_id"] == "eeg"), key=lambda r: r["sample_idx"])
    assert [r["ch"] for r in eeg[:3]] == [[0.0, 0.0], [1.0, 2.0], [2.0, 4.0]] and eeg[-1]["bad_time"] and [r["sample_idx"] for r in eeg] == list(range(501))
    tiny = R.read_folder(spark, str(folder), seconds=0.05).collect()
    assert sorted(map(str, tiny)) == sorted(map(str, rows))


def test_files_that_are_no_recordings(spark, folder):
    (folder / "other.csv").write_text("a,b\n1,2\n")
    with pytest.raises(ValueError, match="other.csv"):
        R.read_folder(spark, str(folder))
    assert R.read_folder(spark, str(folder), strict=False).select("recording_id").distinct().count() == 4
    (folder / "one" / "aura_1.csv").unlink()
    assert R.read_folder(spark, str(folder / "one"), strict=False).count() == 0 if list((folder / "one").iterdir()) else True


def test_profiles_of_files(spark, folder):
    got = {r["recording_id"]: r for r in jobs.profile_files(spark, str(folder)).collect()}
    assert {k: (r["channel"], r["n_rows"], r["n_values"], r["n_dropped"]) for k, r in got.items()} == {
        "aura_1": ("Channel_1", 400, 400, 0), "aura_2": ("Channel_1", 400, 399, 0), "old": ("ch1", 300, 300, 1), "eeg": ("Fp1", 500, 500, 1)}
    assert got["eeg"]["rate"] == pytest.approx(250, rel=1e-4) and got["old"]["rate"] == pytest.approx(100)
    only = {r["recording_id"]: r["n_values"] for r in jobs.profile_files(spark, str(folder), "ch2").collect()}
    assert only == {"old": 0}  # all cells are nan


def test_profiles_parse_every_file_once(spark, folder):
    plan = jobs.profile_files(spark, str(folder))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan csv") == 3  # header families


def test_a_name_takes_no_search_along_the_path(spark):
    from pyspark.sql import functions as F

    paths = {
        "file:///a/b/eeg.csv": "eeg", "a/eeg.csv.gz": "eeg", "eeg": "eeg", "a/.csv": ".csv", "a/x.csv.csv": "x.csv", "part-0.csv": "part-0", "a/x=1.csv": "x=1", "a/": "", "": "",
        "a/aura_1/part-0-c000.csv": "aura_1", "a/aura_1.csv/part-0": "aura_1", "a/recording_id=click/part-0.csv": "click", "a/x=y=z/part-0": "z", "a/x=/part-0.csv": "part-0",
        "file:/" + "d" * 300_000 + "/" + "e=" * 50 + "/recording_id=f/part-0.csv": "f",
    }
    df = spark.createDataFrame([(k,) for k in paths], "p string")
    began = time.time()
    assert {r["p"]: r["n"] for r in df.select("p", R.recording_name(F.col("p")).alias("n")).collect()} == paths
    assert time.time() - began < 20  # some tens of billions of steps where the search begins anew at each character


def test_cleaning_from_files(spark, folder):
    got = {(r["recording_id"], r["name"]): r for r in jobs.denoise_files(spark, str(folder)).collect()}
    assert {k for k in got} == {(r, n) for r, ns in (("aura_1", ("Channel_1", "Channel_2")), ("aura_2", ("Channel_1", "Channel_2")), ("old", ("ch1", "ch2")), ("eeg", ("Fp1", "O2"))) for n in ns}
    eeg = got["eeg", "Fp1"]
    assert eeg["fs"] == pytest.approx(250, abs=1e-9) and (eeg["n_rows"], eeg["n_dropped"], eeg["n"]) == (501, 1, 250) and eeg["power_proc"] is not None


def test_names_and_first_channels(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(["Fp1", "ch1"],), (["O1", "C3"],), (["ch1", "Channel_1"],), ([],)], "n array<string>")
    assert [r[0] for r in df.select(R.first_channel_column(F.col("n"))).collect()] == ["ch1", "O1", "Channel_1", None]


def test_observed_counts_are_those_of_a_second_pass(spark):
    from sigmill.operators import frames as O

    f = spark.createDataFrame([("a", i, None if i % 7 == 0 else float(i)) for i in range(100)], "recording_id string, sample_idx long, t_s double")
    kept, seen = O.drop_invalid_time_observed(f, "here")
    assert kept.count() == 85 and seen.get == {"n_rows": 100, "n_dropped": 15}
    _, lost = O.drop_invalid_time(f)
    assert lost.first()["n_dropped"] == 15


SF = "/root/testdata/sf0.01"


def by_sql(name):
    con = pytest.importorskip("duckdb").connect()
    for t in ("lineitem", "embeddings"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return sorted(con.execute(registry.ORACLE[name]).fetchall())


def test_event_windows_take_their_samples_in_bounded_files(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(registry, "_folder", lambda _: str(tmp_path))
    monkeypatch.setattr(registry, "SAMPLES", 200)
    got = sorted(map(tuple, registry.event_windows(spark, SF).collect()))
    assert got == by_sql("event_windows")
    sizes = [spark.read.parquet(str(p)).count() for p in sorted((tmp_path / "in").iterdir(), key=lambda p: int(p.name))]
    assert len(sizes) > 4 and max(sizes[2:]) <= 28 * 200 * 1.2


def test_event_windows_write_and_read_a_batch_side_by_side(spark, tmp_path, monkeypatch):
    """Every number's files are one micro-batch, also where few rows leave files empty; its state has no row a sample, and no more
    stores than the session has cores."""
    queries, publish = [], R.publish
    monkeypatch.setattr(registry, "_folder", lambda _: str(tmp_path))
    monkeypatch.setattr(registry, "SAMPLES", 700)
    monkeypatch.setattr(R, "publish", lambda *a, **k: queries.append(publish(*a, **k)) or queries[-1])
    was = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "11")
    try:
        got = sorted(map(tuple, registry.event_windows(spark, SF).collect()))
        assert spark.conf.get("spark.sql.shuffle.partitions") == "11"
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", was)
    assert got == by_sql("event_windows")
    read = [spark.read.parquet(str(p)) for p in sorted((tmp_path / "in").iterdir(), key=lambda p: int(p.name))]
    assert [len(p.inputFiles()) for p in read] == [registry.FILES] * len(read)
    progress = queries[0].recentProgress
    assert [p["numInputRows"] for p in progress if p["numInputRows"]] == [p.count() for p in read]
    states = [op for p in progress for op in p["stateOperators"]]
    assert max(op["numRowsTotal"] for op in states) <= 2 * 28
    assert {op["numShufflePartitions"] for op in states} == {min(11, spark.sparkContext.defaultParallelism)}


def test_samples_are_numbered_in_buckets_as_in_whole_series(spark, tmp_path, monkeypatch):
    from pyspark.sql import functions as F

    from sigmill.sources import views

    l = spark.read.parquet(SF + "/lineitem.parquet").withColumn("l_suppkey", F.when(F.col("l_partkey") % 9 > 0, F.col("l_suppkey")))
    l = l.withColumn("l_linenumber", F.when(F.col("l_partkey") % 7 > 0, F.col("l_linenumber") - 3))
    l.write.parquet(str(tmp_path / "lineitem.parquet"))
    monkeypatch.setattr(views, "ORDERS", 1000.0)
    want, got = (f(spark, str(tmp_path)) for f in (views.long_samples, views.long_samples_in_buckets))
    assert got.dtypes == want.dtypes and got.count() == l.count()
    assert got.exceptAll(want).count() == want.exceptAll(got).count() == 0


def test_streams_of_frames_take_them_in_bounded_files(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(registry, "_folder", lambda _: str(tmp_path))
    monkeypatch.setattr(registry, "FRAMES", 40)
    got = sorted(map(tuple, registry.rolling_range_stream(spark, SF).collect()))
    assert got == by_sql("rolling_range_stream")
    sizes = [spark.read.json(str(p)).count() for p in sorted((tmp_path / "in").iterdir(), key=lambda p: int(p.name))]
    assert len(sizes) == 5 and max(sizes[2:]) == 8 * 40


def test_a_long_batch_is_given_out_in_parts():
    class Sizes(keyed.Keyed):
        names = ["recording_id", "n"]

        def step(self, pdf, x):
            assert x.shape == (2, len(pdf))
            return [(len(pdf),)]

    sizes, clock = Sizes(), MagicMock()
    sizes.timer, sizes.handle, clock.getCurrentWatermarkInMs.return_value = MagicMock(), MagicMock(), 0
    frames = pd.DataFrame({"sample_idx": range(10000), "t_s": np.arange(10000) / 250, "ch": [[1.0, 2.0]] * 10000, "ts": pd.Timestamp("2025-01-01")})
    assert [d["n"].tolist() for d in sizes.handleInputRows(("a",), iter([frames]), clock)] == [[4096], [4096], [1808]]

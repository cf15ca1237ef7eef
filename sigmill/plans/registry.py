"""Every signal operator as a query over the given tables, with the SQL that it is held against."""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sigmill.operators import frames as O
from sigmill.operators import series
from sigmill.operators import signals as S
from sigmill.plans import filter_sql as Q
from sigmill.plans import jobs
from sigmill.sources import recordings as R
from sigmill.sources import views as V
from sigmill.streaming import keyed, stateful
from sigmill.streaming import windows as event_time

FR, LO, IR, BA = V.FRAMES_SQL, V.LONG_SQL, V.IRREGULAR_SQL, V.BANDS_SQL
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None, *views: str):
    """Register a query under its function's name, and its SQL with the views that it uses."""

    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = (f"with {', '.join(views)} " if views else "") + sql
        return f

    return put


def r6(c: Column | str, name: str | None = None, digits: int = 6) -> Column:
    """Rounded for comparison, without minus zero."""
    c = F.col(c) if isinstance(c, str) else c
    out = F.round(c, digits) + F.lit(0.0)
    return out.alias(name) if name else out


def flat(frames: DataFrame, *more: str) -> DataFrame:
    """Frames as rows of one channel value each, rounded."""
    return frames.select("recording_id", "sample_idx", *more, F.posexplode("ch").alias("channel_idx", "_v")).withColumn("value", r6("_v")).drop("_v")


FLAT = "select recording_id, sample_idx, unnest(range(0, len(ch)))::int as channel_idx, round(unnest(ch), 6) + 0.0 as value from "


# ---- sources and sinks -------------------------------------------------------------------------------------------


def _folder(spark: SparkSession) -> str:
    """A new folder in the shared place that the session names; local sessions that name none get one below the warehouse."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = spark.conf.get("spark.sql.warehouse.dir")
    return f"{root.rstrip('/')}/recordings-{uuid.uuid4().hex}"


DEVICE = [f"Channel_{i}" for i in range(1, 9)]
CLINICAL = ["Fp1", "Fp2", "C3", "C4", "P3", "P4", "O1", "O2"]


def _quoted(c: Column) -> Column:
    return F.concat(F.lit("'"), c, F.lit("'"))


def _clock(micros: Column) -> Column:
    """``'[hh:mm:ss.ffffff dd/mm/yyyy]'`` of microseconds of the epoch."""
    return _quoted(F.concat(F.lit("["), F.date_format(F.timestamp_micros(micros), "HH:mm:ss.SSSSSS dd/MM/yyyy"), F.lit("]")))


def _write_dirty(f: DataFrame, path: str, bad: Column) -> None:
    """Frames as device exports (recordings 0 to 3) and clinical ones (from 4): quotes, brackets, a row of units, times
    that are none where ``bad``, columns that are no channels."""
    number = lambda i: F.element_at("ch", i + 1).cast("string")
    device = f.filter("recording_id < 4").select("recording_id", F.when(bad, "late").otherwise(F.col("t_s").cast("string")).alias("timestamp"), F.lit("x").alias("note"), *[number(i).alias(c) for i, c in enumerate(DEVICE)])
    device.write.partitionBy("recording_id").option("header", True).csv(path + "/device")
    time = F.when(bad, F.lit("'no time'")).otherwise(_clock(F.lit(1700000000000000) + F.col("sample_idx") * 4000))
    rows = f.filter("recording_id >= 4").select("recording_id", time.alias("'Time and date'"), *[_quoted(number(i)).alias(f"'{c}'") for i, c in enumerate(CLINICAL)])
    units = f.filter("recording_id >= 4").select("recording_id").distinct().select("recording_id", F.lit("").alias("'Time and date'"), *[F.lit("uV").alias(f"'{c}'") for c in CLINICAL])
    rows.unionByName(units).write.partitionBy("recording_id").option("header", True).csv(path + "/clinical")


@query("""select recording_id, row_number() over (partition by recording_id order by t_s nulls last, ch) - 1 as sample_idx, t_s is null as bad_time, len(ch) as n_channels,
round(t_s, 3) as t_s, round(list_sum(ch), 6) + 0.0 as total from (
select recording_id::varchar as recording_id, case when sample_idx % 97 = 5 then null when recording_id < 4 then t_s else 1700000000 + t_s end as t_s, ch from frames)""", FR)
def read_recordings(spark, sf_dir):
    """Frames written as device and as clinical CSV (quotes, brackets, a row of units, bad times, columns that are no
    channels) and read back as two header families."""
    path = _folder(spark)
    _write_dirty(V.frames(spark, sf_dir), path, F.col("sample_idx") % 97 == 5)
    got = R.read_families(spark, [path + "/device", path + "/clinical"])
    total = F.aggregate("ch", F.lit(0.0), lambda a, x: a + x)
    return got.select("recording_id", "sample_idx", "bad_time", F.size("ch").cast("long").alias("n_channels"), r6("t_s", "t_s", 3), r6(total, "total"))


@query("""select recording_id, round(t_s, 6) + 0.0 as timestamp, channel_idx, value from (select recording_id, t_s, unnest(range(0, 8))::int as channel_idx, round(unnest(ch), 6) + 0.0 as value from frames)""", FR)
def write_recording(spark, sf_dir):
    """Frames written as device CSV, and the files as they are."""
    path = _folder(spark)
    R.write_recording(V.frames(spark, sf_dir), path, DEVICE)
    raw = spark.read.option("header", True).option("inferSchema", False).csv(path)
    values = F.posexplode(F.array(*[F.col(c).cast("double") for c in DEVICE]))
    return raw.select(F.col("recording_id").cast("int").alias("recording_id"), r6(F.col("timestamp").cast("double"), "timestamp"), values.alias("channel_idx", "v")).withColumn("value", r6("v")).drop("v")


@query("""select 'aura_data_1' as recording, count(*) as n_frames, round(sum(ch[1]), 6) + 0.0 as total from frames where recording_id = 1""", FR)
def latest_recording(spark, sf_dir):
    """Recordings written one after the other, the last of which is chosen by its files' times and read."""
    path = _folder(spark)
    f = V.frames(spark, sf_dir)
    for name, which in (("aura_data_2", 2), ("other_3", 3), ("aura_data_0", 0), ("aura_data_1", 1), ("other_4", 4)):
        R.wide(f.filter(F.col("recording_id") == which), DEVICE).drop("recording_id").write.option("header", True).csv(f"{path}/{name}")
    found = R.latest_recording(R.files(spark, path), "aura_data_").first()  # one row
    got = R.read_recordings(spark, f"{path}/{found['recording']}")
    return got.groupBy(F.col("recording_id").alias("recording")).agg(F.count("*").alias("n_frames"), r6(F.sum(F.col("ch")[0]), "total"))


def _fed(frames: DataFrame, path: str) -> None:
    """Frames as JSON lines, with text ids."""
    frames.select(F.col("recording_id").cast("string").alias("recording_id"), "sample_idx", "t_s", "ch").write.json(path)


#: Numbers of samples along every recording that one file of a stream's source holds at most.
FRAMES, SAMPLES = 25_000, 100_000
#: Files of a batch that are written and read side by side.
FILES = 8


def _in_turn(rows: DataFrame, path: str, write: Callable[[DataFrame, str], None], least: int = 1) -> None:
    """The rows of each number of ``_batch`` as one file below ``path/in``, in the order of the numbers: a stream takes files by
    their age. They are parted by one job before, so that every file is written from its own rows only. Numbers without a
    row, up to the last and at least ``least`` of them, have a file without rows."""
    _staged(rows.repartition("_batch"), path, lambda part, to: write(part.coalesce(1), to), least)


def _staged(rows: DataFrame, path: str, write: Callable[[DataFrame, str], None], least: int) -> None:
    """Writes the rows parted by ``_batch`` and calls ``write`` for each number with its rows and the folder that they go to."""
    rows.write.partitionBy("_batch").parquet(path + "/staged")
    staged = rows.sparkSession.read.schema(rows.schema).parquet(path + "/staged")
    last = staged.agg(F.max("_batch")).first()[0]  # one number
    for k in range(max(least, 0 if last is None else last + 1)):
        write(staged.filter(F.col("_batch") == k).drop("_batch"), f"{path}/in/{k}")


def _in_files(part: DataFrame, to: str) -> None:
    """The rows as FILES files, written and later read side by side; where fewer tasks have rows, files without rows make up for
    them, so that a stream of FILES files a batch takes these together and no others."""
    part.coalesce(FILES).write.parquet(to)
    for _ in range(FILES - len(part.sparkSession.read.schema(part.schema).parquet(to).inputFiles())):
        part.limit(0).coalesce(1).write.mode("append").parquet(to)


def _drained(stream: DataFrame, path: str, stores: int | None = None) -> DataFrame:
    """A stream published to files until its source is empty, and what it has written. Its state is in at most ``stores`` stores:
    each costs every batch a task and a commit, however few rows it has."""
    conf, key = stream.sparkSession.conf, "spark.sql.shuffle.partitions"
    was = conf.get(key)
    conf.set(key, min(int(was), stores or int(was)))
    try:
        query = R.publish(stream, path + "/out", path + "/checkpoint", available_now=True)  # keeps the settings of now
    finally:
        conf.set(key, was)
    query.awaitTermination()
    return stream.sparkSession.read.parquet(path + "/out")


def _fed_in_turn(frames: DataFrame, path: str, *cuts: int) -> DataFrame:
    """Frames as JSON lines below ``path/in``, read as a stream of a file a batch: one file up to each of ``cuts``, and from
    the last one on, or from the beginning, one for every FRAMES frames along the recordings."""
    i = F.col("sample_idx")
    last = cuts[-1] if cuts else 0
    number = F.floor(F.greatest(i - last, F.lit(0)) / FRAMES)
    for cut in cuts:
        number = number + (i >= cut).cast("int")
    _in_turn(frames.withColumn("_batch", number.cast("int")), path, _fed, least=len(cuts) + 1)
    return R.read_sample_stream(frames.sparkSession, path + "/in/*", files_per_batch=1)


def _published(frames: DataFrame, work: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Frames as JSON lines, read as a stream, put through ``work``, published to files until the source is empty, and read."""
    path = _folder(frames.sparkSession)
    return _drained(work(_fed_in_turn(frames, path)), path)


@query("select recording_id::varchar as recording_id, sample_idx, round(t_s, 6) as t_s, channel_idx, value from (select recording_id, sample_idx, t_s, unnest(range(0, len(ch)))::int as channel_idx, round(unnest(ch), 6) + 0.0 as value from frames)", FR)
def read_sample_stream(spark, sf_dir):
    """The frames as a stream, as they arrive, from the sample at time 0 on."""
    got = _published(V.frames(spark, sf_dir), lambda stream: stream)
    return flat(got.withColumn("t_s", r6("t_s")), "t_s")


@query("""select recording_id, sample_idx, round(x[1], 6) + 0.0 as "Canal1", round(x[2], 6) + 0.0 as "Canal2", round(x[3], 6) + 0.0 as "Canal3", round(k[1], 6) + 0.0 as "Kalman1", round(k[2], 6) + 0.0 as "Kalman2", round(k[3], 6) + 0.0 as "Kalman3"
from (select recording_id, sample_idx, ch[1:3] as x, ch[1:3] as k from frames)""", FR)
def write_filtered_pair(spark, sf_dir):
    """Both tables written and read back, the smoothed one with other values."""
    path = _folder(spark)
    R.write_filtered_pair(V.frames(spark, sf_dir).withColumn("kalman", F.transform("ch", lambda x: x * 2 + 1)), path + "/a", path + "/b")
    read = lambda p, name: spark.read.option("header", True).csv(path + p).select(F.col("recording_id").cast("int").alias("recording_id"), F.col("Timestamp").cast("double").alias("t"), *[F.col(f"Canal{i}").cast("double").alias(f"{name}{i}") for i in (1, 2, 3)])
    both = read("/a", "Canal").join(read("/b", "Kalman"), ["recording_id", "t"])
    return both.select("recording_id", F.round(F.col("t") * V.FS).cast("long").alias("sample_idx"), *[r6(f"Canal{i}", f"Canal{i}") for i in (1, 2, 3)], *[r6((F.col(f"Kalman{i}") - 1) / 2, f"Kalman{i}") for i in (1, 2, 3)])


#: Names of a dirty header: what the rules must find among them, and what not.
DIRTY = [" 'Fp1'", "Channel_2 ", "'CH3'", "note", "o2", "chx", "Canal7", "C4"]


def _dirty(spark, sf_dir) -> DataFrame:
    return V.frames(spark, sf_dir).select("recording_id", F.col("t_s").alias("'Time and date' "), *[F.col("ch")[i].alias(c) for i, c in enumerate(DIRTY)])


def _sums(t: DataFrame, columns: list[str]) -> DataFrame:
    """Sums of the columns by recording, as rows."""
    rows = t.select("recording_id", F.inline(F.array(*[F.struct(F.lit(c).alias("name"), F.col(f"`{c}`").alias("v")) for c in columns])))
    return rows.groupBy("recording_id", "name").agg(r6(F.sum("v"), "total"))


def _sums_sql(names: dict[str, str]) -> str:
    return " union all ".join(f"select recording_id, '{n}' as name, round(sum({x}), 6) + 0.0 as total from frames group by 1" for n, x in names.items())


@query(_sums_sql({"Time and date": "t_s", "Fp1": "ch[1]", "Channel_2": "ch[2]", "CH3": "ch[3]", "note": "ch[4]", "o2": "ch[5]", "chx": "ch[6]", "Canal7": "ch[7]", "C4": "ch[8]"}), FR)
def clean_headers(spark, sf_dir):
    t = R.clean_headers(_dirty(spark, sf_dir))
    return _sums(t, [c for c in t.columns if c != "recording_id"])


@query(_sums_sql({"Time and date": "t_s"}), FR)
def detect_time_column(spark, sf_dir):
    t = R.clean_headers(_dirty(spark, sf_dir))
    return _sums(t, [R.detect_time_column(t.columns)])


@query(_sums_sql({"Fp1": "ch[1]", "Channel_2": "ch[2]", "CH3": "ch[3]", "o2": "ch[5]", "Canal7": "ch[7]", "C4": "ch[8]"}), FR)
def detect_channels(spark, sf_dir):
    t = R.clean_headers(_dirty(spark, sf_dir))
    return _sums(t, R.detect_channels(t.columns, canal=True))


@query("""select recording_id, strftime(make_timestamp(t_us), '%Y-%m-%d %H:%M:%S.%f') as clock, round(value, 6) + 0.0 as value
from (select recording_id, value, (1700000000000000 + sample_idx * 4000)::bigint as t_us from long_samples)""", LO)
def parse_clock_time(spark, sf_dir):
    """Times written in the clinical form and parsed again."""
    t = F.timestamp_micros(F.lit(1700000000000000) + F.col("sample_idx") * 4000)
    text = F.concat(F.lit("'["), F.date_format(t, "HH:mm:ss.SSSSSS dd/MM/yyyy"), F.lit("]'"))
    back = O.parse_clock_time(text)
    return V.long_samples(spark, sf_dir).select("recording_id", F.date_format(back, "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("clock"), r6("value", "value"))


@query("""select c_custkey as id, case when c_custkey % 5 = 0 then null else round(c_acctbal::double, 6) + 0.0 end as value from customer""")
def clean_numeric(spark, sf_dir):
    c = V.table(spark, sf_dir, "customer")
    text = F.when(F.col("c_custkey") % 5 == 0, F.lit("n/a")).otherwise(F.concat(F.lit(" '"), F.col("c_acctbal").cast("double").cast("string"), F.lit("'")))
    return c.select(F.col("c_custkey").alias("id"), r6(O.clean_numeric(text), "value"))


@query("""select event_type as recording, count(*) as n_rows, count(*) filter (event_id % 9 = 0) as n_dropped from events group by 1""")
def drop_invalid_time(spark, sf_dir):
    e = V.table(spark, sf_dir, "events")
    f = e.select(F.col("event_type").alias("recording_id"), F.when(F.col("event_id") % 9 != 0, F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("t_s"))
    kept, lost = O.drop_invalid_time(f)
    n = kept.groupBy("recording_id").agg(F.count("*").alias("_k"))
    return lost.join(n, "recording_id", "left").select(F.col("recording_id").alias("recording"), (F.coalesce("_k", F.lit(0)) + F.col("n_dropped")).alias("n_rows"), "n_dropped")


@query("""select count(*) as n_rows, count(*) filter (event_id % 9 = 0) as n_dropped, count(*) filter (event_id % 9 <> 0) as n_written from events""")
def drop_invalid_time_observed(spark, sf_dir):
    """The counts that the one scan yields which also writes the frames."""
    path = _folder(spark)
    e = V.table(spark, sf_dir, "events")
    kept, seen = O.drop_invalid_time_observed(e.select(F.col("event_type").alias("recording_id"), F.when(F.col("event_id") % 9 != 0, F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("t_s")))
    kept.write.parquet(path)
    got = seen.get
    return spark.read.parquet(path).agg(F.lit(got["n_rows"]).cast("long").alias("n_rows"), F.lit(got["n_dropped"]).cast("long").alias("n_dropped"), F.count("*").alias("n_written"))


# ---- projections -------------------------------------------------------------------------------------------------


@query("select recording_id, sample_idx, unnest(range(0, len(ch)))::int as channel_idx, round(unnest([x * 4500000 / 24 / 8388607 for x in ch]), 6) + 0.0 as value from frames", FR)
def counts_to_microvolts(spark, sf_dir):
    return flat(O.counts_to_microvolts(V.frames(spark, sf_dir)))


@query("select recording_id, sample_idx, unnest(range(0, len(ch)))::int as channel_idx, round(unnest([x - list_sum(ch) / len(ch) for x in ch]), 6) + 0.0 as value from frames", FR)
def car(spark, sf_dir):
    return flat(O.car(V.frames(spark, sf_dir)))


@query("select recording_id, sample_idx, round(ch[2], 6) + 0.0 as value from frames", FR)
def pick_channel(spark, sf_dir):
    return O.pick_channel(V.frames(spark, sf_dir), 1).select("recording_id", "sample_idx", r6("value", "value"))


@query("select recording_id, sample_idx, unnest(range(0, 3))::int as channel_idx, round(unnest(ch[1:3]), 6) + 0.0 as value from frames", FR)
def first_n_channels(spark, sf_dir):
    return flat(O.first_n_channels(V.frames(spark, sf_dir), 3))


@query("""select vec_id as sample_idx, unnest(range(0, 8))::int as channel_idx,
round(unnest([embedding[i + 1]::double for i in [2, 3, 4, 6, 8, 10, 11, 12]]), 6) + 0.0 as value, round(embedding[17]::double, 6) + 0.0 as t_s from embeddings""")
def select_montage(spark, sf_dir):
    e = V.table(spark, sf_dir, "embeddings").select(F.lit(0).alias("recording_id"), F.col("vec_id").alias("sample_idx"), F.lit(0.0).alias("t_s"), F.col("embedding").cast("array<double>").alias("ch"))
    return flat(O.select_montage(e, "nautilus").withColumn("t_s", r6("t_s")), "t_s").drop("recording_id")


@query("""select recording_id, sample_idx, channel_idx, case when channel_idx % 3 = 0 then 'Channel_' || (channel_idx + 1) else 'rec' || recording_id || '_' || channel_idx end as channel
from (select recording_id, sample_idx, unnest(range(0, 8))::int as channel_idx from frames)""", FR)
def label_channels(spark, sf_dir):
    f = V.frames(spark, sf_dir)
    name = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.when(i % 3 == 0, F.lit("")).otherwise(F.concat(F.lit("rec"), F.col("recording_id"), F.lit("_"), i)))
    info = f.select("recording_id").distinct().withColumn("channel_names", name)
    return O.label_channels(O.frames_to_samples(f), info).select("recording_id", "sample_idx", "channel_idx", "channel")


@query(FLAT + "frames", FR)
def frames_to_samples(spark, sf_dir):
    return O.frames_to_samples(V.frames(spark, sf_dir)).select("recording_id", "sample_idx", "channel_idx", r6("value", "value"))


@query(FLAT + "frames", FR)
def samples_to_frames(spark, sf_dir):
    return flat(O.samples_to_frames(O.frames_to_samples(V.frames(spark, sf_dir))))


MALFORMED = """bad as (select recording_id, sample_idx, t_s, case when sample_idx % 11 = 0 then []::double[] when sample_idx % 7 = 3 then ch[1:2] else ch end as ch from frames)"""


def _malformed(spark, sf_dir) -> DataFrame:
    i = F.col("sample_idx")
    return V.frames(spark, sf_dir).withColumn("ch", F.when(i % 11 == 0, F.array().cast("array<double>")).when(i % 7 == 3, F.slice("ch", 1, 2)).otherwise(F.col("ch")))


@query("""select recording_id, sample_idx, unnest(range(0, 3))::int as channel_idx, round(unnest(good), 6) + 0.0 as value from (
select recording_id, sample_idx, last_value(case when len(ch) >= 3 then ch[1:3] end ignore nulls) over (partition by recording_id order by t_s, sample_idx) as good from bad) where good is not null""", FR, MALFORMED)
def fill_malformed(spark, sf_dir):
    return flat(O.fill_malformed(_malformed(spark, sf_dir), 3))


@query("select recording_id, count(*) filter (len(ch) = 0) as n_missing, count(*) as n_frames from bad group by 1", FR, MALFORMED)
def missing_samples(spark, sf_dir):
    return O.missing_samples(_malformed(spark, sf_dir))


# ---- time --------------------------------------------------------------------------------------------------------


@query("select recording_id, sample_idx, round(t_s - min(t_s) over (partition by recording_id), 3) + 0.0 as t_s from irregular", IR)
def relative_time(spark, sf_dir):
    return O.relative_time(V.irregular(spark, sf_dir)).select("recording_id", "sample_idx", r6("t_s", "t_s", 3))


@query("select recording_id, row_number() over (partition by recording_id order by t_s) - 1 as sample_idx, round(value, 6) + 0.0 as value from irregular", IR)
def order_by_time(spark, sf_dir):
    return O.order_by_time(V.irregular(spark, sf_dir)).select("recording_id", "sample_idx", r6("value", "value"))


@query("select recording_id, row_number() over (partition by recording_id order by t_s) - 1 as sample_idx, round(value, 6) + 0.0 as value from irregular", IR)
def order_by_time_in_buckets(spark, sf_dir):
    return O.order_by_time_in_buckets(V.irregular(spark, sf_dir), 86400.0).select("recording_id", "sample_idx", r6("value", "value"))


@query("""select recording_id, sample_idx, round(value, 6) + 0.0 as value from (select *, lag(t_s - t0) over (partition by recording_id order by t_s) as g
from (select *, min(t_s) over (partition by recording_id) as t0 from irregular)) where g is null or g < 86400""", IR)
def capture_first(spark, sf_dir):
    return O.capture_first(V.irregular(spark, sf_dir), 86400.0).select("recording_id", "sample_idx", r6("value", "value"))


@query("""select recording_id, sample_idx, round(value, 6) + 0.0 as value from (select *, min(t_s) over w as a, max(t_s) over w as b from irregular window w as (partition by recording_id))
where t_s between a + (b - a) / 2 and a + (b - a) / 2 + 86400""", IR)
def mid_slice(spark, sf_dir):
    return O.mid_slice(V.irregular(spark, sf_dir), 86400.0).select("recording_id", "sample_idx", r6("value", "value"))


@query("select recording_id, channel, sample_idx, round(value, 6) + 0.0 as value from long_samples qualify row_number() over (partition by recording_id, channel order by sample_idx desc) <= 100", LO)
def latest_n(spark, sf_dir):
    return O.latest_n(V.long_samples(spark, sf_dir), 100, "channel").select("recording_id", "channel", "sample_idx", r6("value", "value"))


@query("select recording_id, count(*) as n, round((count(*) - 1) / (max(t_s) - min(t_s)), 9) + 0.0 as rate from irregular group by 1", IR)
def sampling_rate(spark, sf_dir):
    return O.sampling_rate(V.irregular(spark, sf_dir)).select("recording_id", "n", r6("rate", "rate", 9))


@query("select recording_id, sample_idx, round(t_s - lag(t_s) over (partition by recording_id order by t_s), 3) + 0.0 as dt from irregular", IR)
def sample_intervals(spark, sf_dir):
    return O.sample_intervals(V.irregular(spark, sf_dir)).select("recording_id", "sample_idx", r6("dt", "dt", 3))


@query("""select recording_id, count(*) as n_rows, count(value) as n_values, round(max(t_s) - min(t_s), 3) + 0.0 as duration, round(avg(dt), 3) + 0.0 as dt_mean,
round(min(dt), 3) + 0.0 as dt_min, round(max(dt), 3) + 0.0 as dt_max, round(stddev_pop(dt), 3) + 0.0 as dt_std, round(1 / avg(dt), 9) + 0.0 as rate
from (select *, t_s - lag(t_s) over (partition by recording_id order by t_s) as dt from irregular) group by 1""", IR)
def recording_profile(spark, sf_dir):
    """Profiles of series that are in a table already."""
    p = O.recording_profile(V.irregular(spark, sf_dir))
    return p.select("recording_id", "n_rows", "n_values", *[r6(c, c, 3) for c in ("duration", "dt_mean", "dt_min", "dt_max", "dt_std")], r6("rate", "rate", 9))


@query("""select recording_id, case when recording_id in ('click', 'view') then 'channel_1' else 'Fp1' end as channel, count(*) as n_rows, count(*) filter (sample_idx % 10 <> 3) as n_values,
count(*) filter (sample_idx % 50 = 7) as n_dropped, round(max(t_s) - min(t_s), 3) + 0.0 as duration, round(avg(dt), 3) + 0.0 as dt_mean,
round(min(dt), 3) + 0.0 as dt_min, round(max(dt), 3) + 0.0 as dt_max, round(stddev_pop(dt), 3) + 0.0 as dt_std, round(1 / avg(dt), 9) + 0.0 as rate
from (select *, t_s - lag(t_s) over (partition by recording_id order by t_s) as dt from irregular) group by 1, 2""", IR)
def profile_recordings(spark, sf_dir):
    """A folder of raw exports of two header families, with cells that are no numbers and rows without a time between the
    others, profiled file by file."""
    path = _folder(spark)
    s = series.number(V.irregular(spark, sf_dir).drop("sample_idx"), ["recording_id"], ["t_s"])
    s = s.withColumn("_cell", F.when(F.col("sample_idx") % 10 == 3, "n/a").otherwise(F.col("value").cast("string"))).withColumn("_us", F.round(F.col("t_s") * 1e6).cast("long"))
    # every 50th row comes once more, with a time that is none
    s = s.withColumn("_bad", F.explode(F.when(F.col("sample_idx") % 50 == 7, F.array(F.lit(False), F.lit(True))).otherwise(F.array(F.lit(False)))))
    device = F.col("recording_id").isin("click", "view")
    s.filter(device).select("recording_id", F.when(F.col("_bad"), "?").otherwise(F.format_string("%.6f", "t_s")).alias("timestamp"), F.col("_cell").alias("channel_1"), F.lit("1.5").alias("o1")).write.partitionBy("recording_id").option("header", True).csv(path + "/device")
    s.filter(~device).select("recording_id", F.lit("x").alias("note"), F.when(F.col("_bad"), "''").otherwise(_clock(F.col("_us"))).alias("'Time and date'"), _quoted(F.col("_cell")).alias("'Fp1'")).write.partitionBy("recording_id").option("header", True).csv(path + "/clinical")
    p = jobs.profile_files(spark, path)
    return p.select("recording_id", "channel", "n_rows", "n_values", "n_dropped", *[r6(c, c, 3) for c in ("duration", "dt_mean", "dt_min", "dt_max", "dt_std")], r6("rate", "rate", 9))


# ---- joins, aggregates, windows ----------------------------------------------------------------------------------


@query("""select a.recording_id, a.sample_idx, round(a.value, 6) + 0.0 as value, round(b.value, 6) + 0.0 as other
from (select * from long_samples where channel = 1) a join (select * from long_samples where channel = 2) b using (recording_id, sample_idx)""", LO)
def align_streams(spark, sf_dir):
    l = V.long_samples(spark, sf_dir)
    return O.align_streams(l.filter("channel = 1"), l.filter("channel = 2")).select("recording_id", "sample_idx", r6("value", "value"), r6("other", "other"))


@query("""select recording_id, channel, round(raw, 3) + 0.0 as power_raw, round(proc, 3) + 0.0 as power_proc, round(proc - raw, 3) + 0.0 as difference, round((proc - raw) / raw * 100, 6) + 0.0 as percent
from (select recording_id, channel, sum(value) filter (sample_idx % 2 = 0) as raw, sum(value) filter (sample_idx % 2 = 1) as proc from long_samples group by 1, 2)""", LO)
def compare_stages(spark, sf_dir):
    power = lambda rest: V.long_samples(spark, sf_dir).filter(F.col("sample_idx") % 2 == rest).groupBy("recording_id", "channel").agg(F.sum("value").alias("power"))
    return O.compare_stages(power(0), power(1)).select("recording_id", "channel", *[r6(c, c, 3) for c in ("power_raw", "power_proc", "difference")], r6("percent", "percent"))


@query("""select recording_id, channel, sample_idx, round((value - avg(value) over w) / stddev_pop(value) over w, 6) + 0.0 as z from long_samples window w as (partition by recording_id, channel)""", LO)
def zscore(spark, sf_dir):
    return O.zscore(V.long_samples(spark, sf_dir)).select("recording_id", "channel", "sample_idx", r6("z", "z"))


@query("""select recording_id, channel, sample_idx, round(lo, 6) + 0.0 as lo, round(hi, 6) + 0.0 as hi, round(lo - 0.1::double * (hi - lo), 4) + 0.0 as shown_lo, round(hi + 0.1::double * (hi - lo), 4) + 0.0 as shown_hi
from (select *, min(value) over w as lo, max(value) over w as hi from long_samples window w as (partition by recording_id, channel order by sample_idx rows 99 preceding))""", LO)
def rolling_range(spark, sf_dir):
    r = S.rolling_range(V.long_samples(spark, sf_dir), 100)
    return r.select("recording_id", "channel", "sample_idx", r6("lo", "lo"), r6("hi", "hi"), r6("shown_lo", "shown_lo", 4), r6("shown_hi", "shown_hi", 4))


@query("""select recording_id, channel, sample_idx, round(case when sample_idx < 99 then least(lo, 0) else lo end, 6) + 0.0 as lo, round(case when sample_idx < 99 then greatest(hi, 0) else hi end, 6) + 0.0 as hi
from (select *, min(value) over w as lo, max(value) over w as hi from long_samples window w as (partition by recording_id, channel order by sample_idx rows 99 preceding))""", LO)
def rolling_range_prefilled(spark, sf_dir):
    """The same over places that hold zeros before the first sample comes."""
    r = S.rolling_range(V.long_samples(spark, sf_dir), 100, prefill_zero=True)
    return r.select("recording_id", "channel", "sample_idx", r6("lo", "lo"), r6("hi", "hi"))


@query("""select recording_id, channel, sample_idx // 1000 as window_idx, round(min(t_s), 6) as t0, round(avg(value), 6) + 0.0 as mean, round(arg_max(value, sample_idx), 6) as last
from long_samples group by 1, 2, 3 having count(*) = 1000""", LO)
def tumbling_windows(spark, sf_dir):
    w = O.tumbling_windows(V.long_samples(spark, sf_dir), 1000, "channel")
    total = F.aggregate("x", F.lit(0.0), lambda a, x: a + x)
    return w.select("recording_id", "channel", "window_idx", r6("t0", "t0"), r6(total / 1000, "mean"), r6(F.element_at("x", -1), "last"))


HOPS = """kept as (select *, case when sample_idx < 250 then sample_idx when (sample_idx - 250) % 51 < 50 then 250 + 50 * ((sample_idx - 250) // 51) + (sample_idx - 250) % 51 end as k from long_samples),
ends as (select recording_id, channel, max(sample_idx) as n from long_samples group by 1, 2),
epochs as (select recording_id, channel, e.epoch, k, value, t_s from kept, lateral (select unnest(generate_series(greatest(1, k // 50 - 4), k // 50)) as epoch) e
  where k is not null and k >= 50),
fired as (select epochs.* from epochs join ends using (recording_id, channel) where n >= 249 + 51 * epoch)"""


@query("""select recording_id, channel, epoch, round(min(t_s), 6) as t0, count(*) as n, round(avg(value), 6) + 0.0 as mean, round(arg_max(value, k), 6) as last from fired group by 1, 2, 3""", LO, HOPS)
def hop_epochs(spark, sf_dir):
    e = O.hop_epochs(V.long_samples(spark, sf_dir), "channel")
    total = F.aggregate("x", F.lit(0.0), lambda a, x: a + x)
    return e.select("recording_id", "channel", "epoch", r6("t0", "t0"), F.size("x").cast("long").alias("n"), r6(total / F.size("x"), "mean"), r6(F.element_at("x", -1), "last"))


CHANNELS = "samples as (select recording_id, sample_idx, t_s, unnest(range(0, 8))::int as channel, unnest(ch) as value from frames)"


def _samples(spark, sf_dir) -> DataFrame:
    return O.frames_to_samples(V.frames(spark, sf_dir)).withColumnRenamed("channel_idx", "channel")


# the first 30 frames are silent, as of a recorder that fills up
SILENT = "silent as (select recording_id, sample_idx, channel, case when sample_idx < 30 then 0 else value end as value from samples)"


@query("""select recording_id, channel, sample_idx, round(avg(value) over w, 6) + 0.0 as mean, round(first_value(value) over w, 6) + 0.0 as first from silent where sample_idx >= 30
window w as (partition by recording_id, channel order by sample_idx rows 124 preceding) qualify sample_idx >= 155""", FR, CHANNELS, SILENT)
def trailing_windows(spark, sf_dir):
    quiet = _samples(spark, sf_dir).withColumn("value", F.when(F.col("sample_idx") < 30, 0.0).otherwise(F.col("value")))
    w = O.trailing_windows(quiet, 125, "channel")
    total = F.aggregate("x", F.lit(0.0), lambda a, x: a + x)
    return w.select("recording_id", "channel", "sample_idx", r6(total / 125, "mean"), r6(F.element_at("x", 1), "first"))


# ---- filters -----------------------------------------------------------------------------------------------------

#: The rolling filter's weights: what notch and band-pass make of the last value of each unit window.
WEIGHTS = [
    *Q.response("notch125", "notch", 0, 50.0, 0.0, V.FS, 143), *Q.response("band125", "bandpass", 5, 1.0, 50.0, V.FS, 191),
    "units as (select k, [case when i = k then 1 else 0 end::double for i in range(125)] as x from (select range as k from range(125)))",
    *Q.zero_phase("notched", "units", "k", "notch125", 9, 143), *Q.zero_phase("banded", "notched", "k", "band125", 33, 191),
    "weights as materialized (select list(x[125] order by k) as w from banded)",
]
TRAILING = """rolled as (select recording_id, channel, sample_idx, list_dot_product(x, w) as value from (
  select recording_id, channel, sample_idx, list(value) over (partition by recording_id, channel order by sample_idx rows 124 preceding) as x from samples), weights where sample_idx >= 125)"""


@query("select recording_id, channel, sample_idx, round(value, 6) + 0.0 as value from rolled", FR, CHANNELS, *WEIGHTS, TRAILING)
def trailing_filter(spark, sf_dir):
    return S.trailing_filter(_samples(spark, sf_dir), "channel").select("recording_id", "channel", "sample_idx", r6("value", "value"))


def kalman_sql(source: str, first: int) -> str:
    """The random-walk filter of ``source`` from sample ``first`` on, as a walk over the samples."""
    return f"""walk as (with recursive w as (
  select recording_id, channel, sample_idx, value as z, value * (1000.5 / 1001.0)::double as x, (1000.5 * (1 - 1000.5 / 1001.0))::double as p from {source} where sample_idx = {first}
  union all
  select s.recording_id, s.channel, s.sample_idx, s.value, w.x + (w.p + 0.5) / (w.p + 1.0) * (s.value - w.x), (w.p + 0.5) * (1 - (w.p + 0.5) / (w.p + 1.0))
  from w join {source} s on s.recording_id = w.recording_id and s.channel = w.channel and s.sample_idx = w.sample_idx + 1
) select * from w)"""


@query("select recording_id, channel, sample_idx, round(x, 6) + 0.0 as value from walk", FR, CHANNELS, kalman_sql("samples", 0))
def kalman_smooth(spark, sf_dir):
    return S.kalman_smooth(_samples(spark, sf_dir), "channel").select("recording_id", "channel", "sample_idx", r6("value", "value"))


# what a lossy link leaves of the frames, in segments without a gap that begin at sample ``first``
LOSSY = ["lossy as (select * from samples where not ((sample_idx between 100 and 104) or (sample_idx between 260 and 449 and channel % 2 = 0) or sample_idx = 999))",
    "parts as (select *, min(sample_idx) over (partition by recording_id, channel, part) as first from (select *, sample_idx - row_number() over (partition by recording_id, channel order by sample_idx) as part from lossy))"]


def _lossy(spark, sf_dir) -> DataFrame:
    i = F.col("sample_idx")
    return _samples(spark, sf_dir).filter(~(i.between(100, 104) | (i.between(260, 449) & (F.col("channel") % 2 == 0)) | (i == 999)))


@query("""select recording_id, channel, sample_idx, round(list_dot_product(x, w), 6) + 0.0 as value from (
  select recording_id, channel, sample_idx, first, list(value) over (partition by recording_id, channel, first order by sample_idx rows 124 preceding) as x from parts), weights where sample_idx >= first + 125""", FR, CHANNELS, *WEIGHTS, *LOSSY)
def trailing_filter_gaps(spark, sf_dir):
    """The rolling filter begins anew after every gap."""
    return S.trailing_filter(_lossy(spark, sf_dir), "channel").select("recording_id", "channel", "sample_idx", r6("value", "value"))


@query("select recording_id, channel, sample_idx, round(x, 6) + 0.0 as value from walk", FR, CHANNELS, *LOSSY, kalman_sql("parts", 0).replace("where sample_idx = 0", "where sample_idx = first"))
def kalman_smooth_gaps(spark, sf_dir):
    return S.kalman_smooth(_lossy(spark, sf_dir), "channel").select("recording_id", "channel", "sample_idx", r6("value", "value"))


@query("""select recording_id, channel, sample_idx, round(min(value) over w, 6) + 0.0 as lo, round(max(value) over w, 6) + 0.0 as hi from lossy
window w as (partition by recording_id, channel order by sample_idx range 99 preceding)""", FR, CHANNELS, LOSSY[0])
def rolling_range_gaps(spark, sf_dir):
    """Extremes over the last 100 places, of which some are empty."""
    return S.rolling_range(_lossy(spark, sf_dir), 100).select("recording_id", "channel", "sample_idx", r6("lo", "lo"), r6("hi", "hi"))


RLS = """pairs as (select recording_id, channel, sample_idx // 250 as w, sample_idx % 250 as k, ch[channel + 1] as x, ch[(channel + 1) % 8 + 1] as ref from (select *, unnest(range(0, 8))::int as channel from frames)),
whole as (select * from pairs where w < (select max(sample_idx) + 1 from frames) // 250),
sums as (select a.recording_id, a.channel, a.w, a.k, a.x, a.ref,
    0.98::double ** a.k / 1e4::double + coalesce(sum(0.98::double ** (a.k - 1 - b.k) * b.ref * b.ref), 0) as square,
    0.98::double ** a.k / 1e4::double + coalesce(sum(0.98::double ** (a.k - 1 - b.k) * b.ref * b.x), 0) as cross_sum
  from whole a left join whole b on a.recording_id = b.recording_id and a.channel = b.channel and a.w = b.w and b.k < a.k group by a.recording_id, a.channel, a.w, a.k, a.x, a.ref)"""


@query("select recording_id, channel, w as window_idx, k, round(x - cross_sum / square * ref, 6) + 0.0 as error, round(cross_sum / square, 6) + 0.0 as weight from sums", FR, RLS)
def rls_cancel(spark, sf_dir):
    """Every channel with the next one as its reference."""
    w = _windows(spark, sf_dir).drop("t0")
    ref = w.select("recording_id", "window_idx", ((F.col("channel") + 7) % 8).alias("channel"), F.col("x").alias("ref"))
    done = S.rls_cancel(w.join(ref, ["recording_id", "window_idx", "channel"])).select("recording_id", "channel", "window_idx", F.posexplode(F.arrays_zip("error", "weight")).alias("k", "v"))
    return done.select("recording_id", "channel", "window_idx", F.col("k").cast("long").alias("k"), r6("v.error", "error"), r6("v.weight", "weight"))


def _windows(spark, sf_dir, n: int = 250) -> DataFrame:
    samples = O.frames_to_samples(V.frames(spark, sf_dir)).withColumnRenamed("channel_idx", "channel")
    return O.tumbling_windows(samples, n, "channel")


def _summary(windows: DataFrame, column: str = "x") -> DataFrame:
    """A window's array as a few rounded numbers."""
    x = F.col(column)
    power = F.aggregate(x, F.lit(0.0), lambda a, v: a + v * v)
    return windows.select("recording_id", "channel", "window_idx", F.size(x).alias("n"), r6(power / F.size(x), "power"), r6(F.element_at(x, 1), "first"), r6(F.element_at(x, -1), "last"))


WINDOWS = """windows as (select recording_id, channel, sample_idx // 250 as window_idx, list(value order by sample_idx) as x from (
  select recording_id, sample_idx, unnest(range(0, 8))::int as channel, unnest(ch) as value from frames) group by 1, 2, 3 having count(*) = 250)"""


KEYS = "recording_id, channel, window_idx"


def summary_sql(source: str, column: str = "x") -> str:
    return f"select {KEYS}, len({column})::int as n, round(list_dot_product({column}, {column}) / len({column}), 6) + 0.0 as power, round({column}[1], 6) + 0.0 as first, round({column}[len({column})], 6) + 0.0 as last from {source}"


def filtered_sql(name: str, source: str, kind: str, order: int, low: float, high: float, n: int = 250, keys: str = KEYS, column: str = "x") -> list[str]:
    """CTEs that end in ``name``: lists of ``n`` values or fewer filtered at 250 Hz, with the padding of the filter's order."""
    pad = {"notch": 9, "lowpass": 3 * (order + 1)}.get(kind, 3 * (2 * order + 1))
    room = n + 2 * pad
    return Q.response(f"{name}_h", kind, order, low, high, V.FS, room) + Q.zero_phase(name, source, keys, f"{name}_h", pad, room, column)


@query(summary_sql("done"), FR, WINDOWS, *filtered_sql("done", "windows", "bandpass", 4, 0.2, 50.0))
def bandpass(spark, sf_dir):
    return _summary(S.bandpass(_windows(spark, sf_dir), V.FS))


@query(summary_sql("done"), FR, WINDOWS, *filtered_sql("done", "windows", "bandstop", 4, 59.0, 61.0))
def bandstop(spark, sf_dir):
    return _summary(S.bandstop(_windows(spark, sf_dir), V.FS))


@query(summary_sql("done"), FR, WINDOWS, *filtered_sql("done", "windows", "notch", 0, 50.0, 0.0))
def notch(spark, sf_dir):
    return _summary(S.notch(_windows(spark, sf_dir), V.FS))


# least order for 60 dB at 30 Hz, and the cut-off at which 0.45 Hz loses exactly 1 dB
LOSS = 10**0.1 - 1
ORDER = math.ceil(math.log10((10**6 - 1) / LOSS) / (2 * math.log10(math.tan(math.pi * 30 / V.FS) / math.tan(math.pi * 0.45 / V.FS))))
CUT = V.FS / math.pi * math.atan(math.tan(math.pi * 0.45 / V.FS) * LOSS ** (-1 / (2 * ORDER)))


@query(summary_sql("done"), FR, WINDOWS, *filtered_sql("done", "windows", "lowpass", ORDER, 0.0, CUT))
def lowpass(spark, sf_dir):
    return _summary(S.lowpass(_windows(spark, sf_dir), V.FS))


@query(summary_sql("done"), FR, WINDOWS, *filtered_sql("alpha", "windows", "bandpass", 4, 8.0, 13.0), *Q.envelope("done", "alpha", KEYS))
def alpha_envelope(spark, sf_dir):
    return _summary(S.alpha_envelope(_windows(spark, sf_dir), V.FS))


@query(summary_sql("done", "ref"), FR, WINDOWS, *Q.wavelet("done", "windows", KEYS))
def wavelet_reference(spark, sf_dir):
    return _summary(S.wavelet_reference(_windows(spark, sf_dir)), "ref")


@query(summary_sql("done", "clean"), FR, WINDOWS, *Q.wavelet("softened", "windows", KEYS), *Q.cancel("done", "softened", KEYS, 250))
def waaf(spark, sf_dir):
    return _summary(S.waaf(_windows(spark, sf_dir)), "clean")


SERIES = "series as (select recording_id, channel, list(value order by sample_idx) as x from samples group by 1, 2)"
PLACES = "select recording_id, channel, unnest(range(len(x))) as sample_idx, round(unnest(x), 6) + 0.0 as value from done"


@query(PLACES, FR, CHANNELS, SERIES, *filtered_sql("done", "series", "bandpass", 4, 0.2, 50.0, 2000, "recording_id, channel"))
def bandpass_series(spark, sf_dir):
    """Whole recordings forward and backward, in blocks of 64 samples."""
    done = S.zero_phase_series(_samples(spark, sf_dir), "bandpass", V.FS, 0.2, 50.0, "channel", size=64)
    return done.select("recording_id", "channel", "sample_idx", r6("value", "value"))


@query(PLACES, FR, CHANNELS, SERIES, *filtered_sql("done", "series", "bandstop", 4, 59.0, 61.0, 2000, "recording_id, channel"))
def bandstop_series(spark, sf_dir):
    done = S.zero_phase_series(_samples(spark, sf_dir), "bandstop", V.FS, 59.0, 61.0, "channel", size=64)
    return done.select("recording_id", "channel", "sample_idx", r6("value", "value"))


# all eight channels are filtered from a steady state of 1 and averaged, as the recorder does it
CAUSAL = [
    *Q.response("causal_h", "bandpass", 4, 0.2, 50.0, V.FS, 20000), *Q.response("causal_s", "bandstop", 4, 59.0, 61.0, V.FS, 20000),
    "series as (select recording_id, channel, list(value order by sample_idx) as x from samples group by 1, 2)",
    f"passed as (select recording_id, channel, {Q.one_pass('causal_h', 'x', 20000, '1')} as x from series, causal_h)",
    "mean8 as (select recording_id, list(m order by i) as m from (select recording_id, i, sum(v) / 8 as m from (select recording_id, unnest(range(len(x))) as i, unnest(x) as v from passed) group by 1, 2) group by 1)",
    "centred as (select recording_id, [x[i + 1] - m[i + 1] for i in range(len(x))] as x from passed join mean8 using (recording_id) where channel = 0)",
    f"chain as (select recording_id, {Q.one_pass('causal_s', 'x', 20000, '1')} as x from centred, causal_s)",
]


@query("select recording_id, unnest(range(len(x))) as sample_idx, round(unnest(x), 6) + 0.0 as value from chain", FR, CHANNELS, *CAUSAL)
def causal_chain(spark, sf_dir):
    return S.causal_chain(V.frames(spark, sf_dir)).select("recording_id", "sample_idx", r6("value", "value"))


# ---- spectra -----------------------------------------------------------------------------------------------------

@query("""select recording_id, channel, window_idx, round(i * 250.0::double / 256, 6) as f, round((sum(v * cos(2 * pi() * ((i * j) % 256) / 256)) ** 2 + sum(v * sin(2 * pi() * ((i * j) % 256) / 256)) ** 2) / 256, 6) + 0.0 as p
from (select recording_id, channel, window_idx, unnest(x) as v, unnest(range(0, len(x))) as j from windows), (select range as i from range(256)) group by recording_id, channel, window_idx, i""", FR, WINDOWS)
def fft_power(spark, sf_dir):
    return S.fft_power(_windows(spark, sf_dir), V.FS).select("recording_id", "channel", "window_idx", r6("f", "f"), r6("p", "p"))


WELCH = """samples40 as (select recording_id, sample_idx // 40 as window_idx, sample_idx % 40 as j, unnest(range(1, 9))::int as channel, unnest(ch) as v from frames),
full40 as (select recording_id, channel, window_idx, j, v, v - avg(v) over w as c from samples40 window w as (partition by recording_id, channel, window_idx) qualify count(*) over w = 40),
hann as (select range as j, 0.5 - 0.5 * cos(2 * pi() * range / 40) as h from range(40)),
psd as (select recording_id, channel, window_idx, i * 2.5::double as f,
  (sum(c * h * cos(2 * pi() * ((i * j) % 40) / 40)) ** 2 + sum(c * h * sin(2 * pi() * ((i * j) % 40) / 40)) ** 2) / (100 * (select sum(h * h) from hann)) * case when i in (0, 20) then 1 else 2 end as p
  from full40 join hann using (j), (select range as i from range(21)) group by recording_id, channel, window_idx, i)"""


@query("select recording_id, channel, window_idx, round(f, 6) as f, round(p, 9) + 0.0 as p from psd", FR, WELCH)
def welch_psd(spark, sf_dir):
    s = O.frames_to_samples(V.frames(spark, sf_dir)).withColumn("channel", F.col("channel_idx") + 1)
    return S.welch_psd(O.tumbling_windows(s, 40, "channel"), 100.0, 100).select("recording_id", "channel", "window_idx", r6("f", "f"), r6("p", "p", 9))


@query("""select recording_id, channel, window_idx, band, round(avg(p), 9) + 0.0 as power from psd join (select * from bands where scheme = 'welch5') on f between fmin and fmax where channel <= 3 group by 1, 2, 3, 4""", FR, WELCH, BA)
def welch_bands(spark, sf_dir):
    return jobs.psd_windows(V.frames(spark, sf_dir), V.bands("welch5")).select("recording_id", "channel", "window_idx", "band", r6("power", "power", 9))


@query("""select recording_id, window_idx, """ + ", ".join(f"round(max(power) filter (band = '{b.lower()}' and channel = {i}), 9) + 0.0 as \"{b}{i}\"" for i in (1, 2, 3) for b in ("Delta", "Theta", "Alpha", "Beta", "Gamma")) + """
from (select recording_id, channel, window_idx, band, avg(p) as power from psd join (select * from bands where scheme = 'welch5') on f between fmin and fmax group by 1, 2, 3, 4) group by 1, 2""", FR, WELCH, BA)
def psd_stream(spark, sf_dir):
    """Batch twin of the density stream: the table of 15 columns."""
    t = R.band_table(jobs.psd_windows(V.frames(spark, sf_dir), V.bands("welch5")), "window_idx")
    return t.select("recording_id", "window_idx", *[r6(c, c, 9) for c in R.BAND_COLUMNS])


@query("""select recording_id, channel, window_idx, round(sum((f - f0) * (p + p0) / 2), 9) + 0.0 as power from (
select *, lag(f) over w as f0, lag(p) over w as p0 from psd where f between 8 and 30 window w as (partition by recording_id, channel, window_idx order by f)) group by 1, 2, 3""", FR, WELCH)
def band_power_trapz(spark, sf_dir):
    s = O.frames_to_samples(V.frames(spark, sf_dir)).withColumn("channel", F.col("channel_idx") + 1)
    psd = S.welch_psd(O.tumbling_windows(s, 40, "channel"), 100.0, 100)
    return O.band_power_trapz(psd, 8, 30, "channel", "window_idx").select("recording_id", "channel", "window_idx", r6("power", "power", 9))


@query("select recording_id, channel, window_idx, round(f, 6) as f, round(p, 9) + 0.0 as p from psd where f between 8 and 13", FR, WELCH)
def band_bins(spark, sf_dir):
    s = O.frames_to_samples(V.frames(spark, sf_dir)).withColumn("channel", F.col("channel_idx") + 1)
    return O.band_bins(S.welch_psd(O.tumbling_windows(s, 40, "channel"), 100.0, 100), 8, 13).select("recording_id", "channel", "window_idx", r6("f", "f"), r6("p", "p", 9))


EPOCHS = """samples as (select recording_id, sample_idx, t_s, unnest(range(0, 8))::int as channel, unnest(ch) as value from frames),
kept as (select *, case when sample_idx < 250 then sample_idx when (sample_idx - 250) % 51 < 50 then 250 + 50 * ((sample_idx - 250) // 51) + (sample_idx - 250) % 51 end as k from samples),
ends as (select recording_id, max(sample_idx) as n from samples group by 1),
epochs as (select recording_id, channel, e.epoch, k - 50 * e.epoch as j, value from kept join ends using (recording_id), lateral (select unnest(generate_series(greatest(1, k // 50 - 4), k // 50)) as epoch) e
  where k >= 50 and n >= 249 + 51 * e.epoch),
fft as (select recording_id, channel, epoch, i * 250.0::double / 256 as f, (sum(value * cos(2 * pi() * ((i * j) % 256) / 256)) ** 2 + sum(value * sin(2 * pi() * ((i * j) % 256) / 256)) ** 2) / 256 as p
  from epochs, (select range as i from range(64)) group by recording_id, channel, epoch, i),
powers as (select recording_id, channel, epoch, band, avg(p) as power from fft join (select * from bands where scheme = 'fft5') on f between fmin and fmax group by 1, 2, 3, 4)"""


@query("select recording_id, channel, epoch, band, round(power, 6) + 0.0 as power from powers", FR, BA, EPOCHS)
def band_mean(spark, sf_dir):
    samples = O.frames_to_samples(V.frames(spark, sf_dir)).withColumnRenamed("channel_idx", "channel")
    p = O.band_mean(S.fft_spectra(O.hop_epochs(samples, "channel"), V.FS), V.bands("fft5"))
    return p.select("recording_id", "channel", "epoch", "band", r6("power", "power"))


SCALED = """select recording_id, channel, epoch, band, round(case when max(abs(power)) over w > min(abs(power)) over w
then (power - min(abs(power)) over w) / (max(abs(power)) over w - min(abs(power)) over w) else 0 end, 6) + 0.0 as scaled from powers window w as (partition by recording_id, epoch, band)"""


@query(SCALED, FR, BA, EPOCHS)
def minmax_channels(spark, sf_dir):
    samples = O.frames_to_samples(V.frames(spark, sf_dir)).withColumnRenamed("channel_idx", "channel")
    p = O.band_mean(S.fft_spectra(O.hop_epochs(samples, "channel"), V.FS), V.bands("fft5"))
    return O.minmax_channels(p).select("recording_id", "channel", "epoch", "band", r6("scaled", "scaled"))


POWERS = "select recording_id::varchar as recording_id, epoch, band, channel, round(power, 6) + 0.0 as power, round(scaled, 6) + 0.0 as scaled from (" + SCALED.replace("select recording_id", "select power, recording_id", 1) + ")"


@query(POWERS.replace("recording_id::varchar as ", "", 1), FR, BA, EPOCHS)
def band_power_epochs(spark, sf_dir):
    """Batch twin of the band-power stream."""
    got = jobs.band_power_epochs(V.frames(spark, sf_dir), V.bands("fft5"))
    return got.select("recording_id", "epoch", "band", "channel", r6("power", "power"), r6("scaled", "scaled"))


@query(POWERS, FR, BA, EPOCHS)
def band_power_stream(spark, sf_dir):
    """The band-power stream itself, run over the frames until they end."""
    got = _published(V.frames(spark, sf_dir), lambda stream: stateful.band_power(stream, V.bands("fft5")))
    return got.select("recording_id", "epoch", "band", "channel", r6("power", "power"), r6("scaled", "scaled"))


@query("select recording_id, window_idx, " + ", ".join(f"round(max(power) filter (band = '{b.lower()}' and channel = {i}), 9) + 0.0 as \"{b}{i}\"" for i in (1, 2, 3) for b in ("Delta", "Theta", "Alpha", "Beta", "Gamma")) + """
from (select recording_id, channel, window_idx, band, avg(p) as power from psd join (select * from bands where scheme = 'welch5') on f between fmin and fmax group by 1, 2, 3, 4) group by 1, 2""", FR, WELCH, BA)
def write_band_table(spark, sf_dir):
    """The band table written as CSV and read back."""
    path = _folder(spark)
    R.write_band_table(jobs.psd_windows(V.frames(spark, sf_dir), V.bands("welch5")), path, "window_idx")
    got = spark.read.option("header", True).csv(path)
    return got.select(F.col("recording_id").cast("int").alias("recording_id"), F.col("window_idx").cast("long").alias("window_idx"), *[r6(F.col(c).cast("double"), c, 9) for c in R.BAND_COLUMNS])


@query(f"select recording_id, channel, round(raw, 6) + 0.0 as power_raw, round(proc, 6) + 0.0 as power_proc, round(proc - raw, 6) + 0.0 as difference, round(case when raw > 0 then (proc - raw) / raw * 100 else 0 end, 6) + 0.0 as percent "
f"from (select recording_id, channel, sum({Q.alpha_area('a.x', '250.0::double')}) as raw, sum({Q.alpha_area('b.x', '250.0::double')}) as proc from windows a join done b using (recording_id, channel, window_idx) group by 1, 2)", FR, WINDOWS, *filtered_sql("done", "windows", "bandpass", 4, 0.2, 50.0))
def alpha_power(spark, sf_dir):
    """Alpha power of all windows of a channel before and after the band-pass."""
    w = _windows(spark, sf_dir).drop("t0")
    total = lambda windows: S.alpha_power(windows, V.FS).groupBy("recording_id", "channel").agg(F.sum("power").alias("power"))
    both = O.compare_stages(total(w), total(S.bandpass(w, V.FS)))
    return both.select("recording_id", "channel", *[r6(c, c) for c in ("power_raw", "power_proc", "difference", "percent")])


@query("""select recording_id, channel, n_segments, round(i * 250.0::double / 128, 6) as f, round(p, 9) + 0.0 as p from (
  select recording_id, channel, i, count(*) as n_segments, avg(p) as p from (
    select recording_id, channel, s, i, (sum(c * h * cos(2 * pi() * ((i * j) % 128) / 128)) ** 2 + sum(c * h * sin(2 * pi() * ((i * j) % 128) / 128)) ** 2) / (250 * (select sum((0.5 - 0.5 * cos(2 * pi() * range / 128)) ** 2) from range(128))) * case when i in (0, 64) then 1 else 2 end as p
    from (select recording_id, channel, s, j, value - avg(value) over v as c, 0.5 - 0.5 * cos(2 * pi() * j / 128) as h
      from (select recording_id, channel, value, s, sample_idx - 64 * s as j from samples, lateral (select unnest([sample_idx // 64 - 1, sample_idx // 64]) as s) where s >= 0)
      window v as (partition by recording_id, channel, s) qualify count(*) over v = 128), (select range as i from range(65)) group by recording_id, channel, s, i) group by 1, 2, 3)""", FR, CHANNELS)
def welch_series(spark, sf_dir):
    """Density of whole recordings from groups of three segments."""
    found = S.welch_series(_samples(spark, sf_dir), V.FS, "channel", nperseg=128, group=3)
    rows = found.select("recording_id", "channel", "n_segments", "step", F.posexplode("p").alias("_i", "_p"))
    return rows.select("recording_id", "channel", "n_segments", r6(F.col("_i") * F.col("step"), "f"), r6("_p", "p", 9))


# ---- whole chains ------------------------------------------------------------------------------------------------

TWO = "recording_id, channel"
OFFLINE = [
    "info as (select recording_id, (count(*) - 1) / (max(t_s) - min(t_s)) as fs, min(t_s) + (max(t_s) - min(t_s)) / 2 as mid from frames group by 1)",
    "slice as (select recording_id, channel, fs, list(value order by sample_idx) as x from samples join info using (recording_id) where t_s between mid and mid + 4 group by 1, 2, 3)",
    *filtered_sql("passed", "slice", "bandpass", 4, 0.2, 50.0, 1001, TWO),
    "mean8 as (select recording_id, list(m order by i) as m from (select recording_id, i, avg(v) as m from (select recording_id, unnest(range(len(x))) as i, unnest(x) as v from passed) group by 1, 2) group by 1)",
    "centred as (select recording_id, channel, [x[i + 1] - m[i + 1] for i in range(len(x))] as x from passed join mean8 using (recording_id))",
    *filtered_sql("stopped", "centred", "bandstop", 4, 59.0, 61.0, 1001, TWO),
    *Q.wavelet("softened", "stopped", TWO), *Q.cancel("cleaned", "softened", TWO, 1001),
    "stages as (select recording_id, channel, fs, s.x as raw, c.clean as proc from slice s join cleaned c using (recording_id, channel))",
    *filtered_sql("raw_alpha", "stages", "bandpass", 4, 8.0, 13.0, 1001, TWO, "raw"), *Q.envelope("raw_size", "raw_alpha", TWO, "raw"),
    *filtered_sql("proc_alpha", "stages", "bandpass", 4, 8.0, 13.0, 1001, TWO, "proc"), *Q.envelope("proc_size", "proc_alpha", TWO, "proc"),
    f"powers as (select {TWO}, fs, len(raw)::int as n, proc, {Q.alpha_area('raw', 'fs')} as a, {Q.alpha_area('proc', 'fs')} as b from stages)",
]


@query("""select recording_id, channel, n, round(fs, 6) + 0.0 as fs, round(a, 6) + 0.0 as power_raw, round(b, 6) + 0.0 as power_proc, round(b - a, 6) + 0.0 as difference, round(case when a > 0 then (b - a) / a * 100 else 0 end, 6) + 0.0 as percent,
round(list_avg(r.raw), 6) + 0.0 as envelope_raw, round(list_avg(q.proc), 6) + 0.0 as envelope_proc, round(list_max([abs(v - list_avg(p.proc)) for v in p.proc]) / list_aggregate(p.proc, 'stddev_pop'), 6) + 0.0 as peak_z
from powers p join raw_size r using (recording_id, channel) join proc_size q using (recording_id, channel)""", FR, CHANNELS, *OFFLINE)
def denoise_frames(spark, sf_dir):
    """Cleaning of frames that are in a table already."""
    d = jobs.denoise_recordings(V.frames(spark, sf_dir))
    peak = F.aggregate("z", F.lit(0.0), lambda a, x: F.greatest(a, F.abs(x)))
    return d.select("recording_id", "channel", "n", *[r6(c, c) for c in ("fs", "power_raw", "power_proc", "difference", "percent", "envelope_raw", "envelope_proc")], r6(peak, "peak_z"))


@query("""select recording_id::varchar as recording_id, channel, case when recording_id < 4 then 'Channel_' || (channel + 1) else ['Fp1', 'Fp2', 'C3', 'C4', 'P3', 'P4', 'O1', 'O2'][channel + 1] end as name, lost.n_rows, lost.n_dropped,
n, round(fs, 6) + 0.0 as fs, round(a, 6) + 0.0 as power_raw, round(b, 6) + 0.0 as power_proc, round(b - a, 6) + 0.0 as difference, round(case when a > 0 then (b - a) / a * 100 else 0 end, 6) + 0.0 as percent,
round(list_avg(r.raw), 6) + 0.0 as envelope_raw, round(list_avg(q.proc), 6) + 0.0 as envelope_proc, round(list_max([abs(v - list_avg(p.proc)) for v in p.proc]) / list_aggregate(p.proc, 'stddev_pop'), 6) + 0.0 as peak_z
from powers p join raw_size r using (recording_id, channel) join proc_size q using (recording_id, channel)
join (select recording_id, count(*) filter (sample_idx % 97 = 5) as n_dropped, count(*) + count(*) filter (sample_idx % 97 = 5) as n_rows from frames group by 1) lost using (recording_id)""", FR, CHANNELS, *OFFLINE)
def denoise_recordings(spark, sf_dir):
    """A folder of dirty exports of two header families cleaned from the files on; some frames come twice, once with a time
    that is none."""
    path, f = _folder(spark), V.frames(spark, sf_dir)
    f = f.withColumn("_bad", F.explode(F.when(F.col("sample_idx") % 97 == 5, F.array(F.lit(False), F.lit(True))).otherwise(F.array(F.lit(False)))))
    _write_dirty(f, path, F.col("_bad"))
    d = jobs.denoise_files(spark, path)
    peak = F.aggregate("z", F.lit(0.0), lambda a, x: F.greatest(a, F.abs(x)))
    return d.select("recording_id", "channel", "name", "n_rows", "n_dropped", "n", *[r6(c, c) for c in ("fs", "power_raw", "power_proc", "difference", "percent", "envelope_raw", "envelope_proc")], r6(peak, "peak_z"))


def windowed_sql(n: int, source: str) -> list[str]:
    """The three stages of windowed cleaning of ``source`` (recording_id, channel, sample_idx, value) in windows of ``n``."""
    return [
        f"wide as (select recording_id, channel, sample_idx // {n} as window_idx, list(value order by sample_idx) as x from {source} group by 1, 2, 3 having count(*) = {n})",
        *filtered_sql("filtered", "wide", "bandpass", 4, 0.2, 50.0, n),
        f"means as (select recording_id, window_idx, list(m order by i) as m from (select recording_id, window_idx, i, avg(v) as m from (select recording_id, window_idx, unnest(range({n})) as i, unnest(x) as v from filtered) group by 1, 2, 3) group by 1, 2)",
        f"car as (select recording_id, channel, window_idx, [x[i + 1] - m[i + 1] for i in range({n})] as x from filtered join means using (recording_id, window_idx))",
        *filtered_sql("stopped", "car", "bandstop", 4, 59.0, 61.0, n),
    ]


WINDOWED = windowed_sql(1000, "(select recording_id, (channel - 1)::int as channel, sample_idx, value from long_samples)")


@query("""select recording_id, channel, window_idx, round(list_dot_product(f.x, f.x) / 1e9::double, 3) + 0.0 as filtered, round(list_dot_product(c.x, c.x) / 1e9::double, 3) + 0.0 as car, round(list_dot_product(s.x, s.x) / 1e9::double, 3) + 0.0 as stopped
from filtered f join car c using (recording_id, channel, window_idx) join stopped s using (recording_id, channel, window_idx)""", LO, *WINDOWED)
def denoise_stream_windows(spark, sf_dir):
    """Batch twin of the windowed cleaning stream, over the long series of every line-item recording."""
    l = V.long_samples(spark, sf_dir).withColumn("channel_idx", F.col("channel") - 1)
    power = lambda c: F.aggregate(c, F.lit(0.0), lambda a, x: a + x * x) / F.size(c)
    return jobs.denoise_windows(l).select("recording_id", "channel", "window_idx", *[r6(power(c) / 1e6, c, 3) for c in ("filtered", "car", "stopped")])


FIRST3 = TRAILING.replace("from samples)", "from samples where channel < 3)")
ROLLING = "select recording_id{0}, channel as channel_idx, sample_idx, round(z, 6) + 0.0 as filtered, round(x, 6) + 0.0 as kalman from walk"


@query(ROLLING.format(""), FR, CHANNELS, *WEIGHTS, FIRST3, kalman_sql("rolled", 125))
def filter_stream_rolling(spark, sf_dir):
    """Batch twin of the rolling filter stream."""
    d = jobs.filter_rolling(V.frames(spark, sf_dir), factor=1.0)
    return d.select("recording_id", "channel_idx", "sample_idx", r6("filtered", "filtered"), r6("kalman", "kalman"))


@query(ROLLING.format("::varchar as recording_id"), FR, CHANNELS, *WEIGHTS, FIRST3, kalman_sql("rolled", 125))
def publish_filtered(spark, sf_dir):
    """The rolling filter stream itself, published until the frames end."""
    got = _published(V.frames(spark, sf_dir), lambda stream: stateful.trailing_and_kalman(stream, factor=1.0))
    pairs = F.posexplode(F.arrays_zip("filtered", "kalman"))
    return got.select("recording_id", "sample_idx", pairs.alias("channel_idx", "v")).select("recording_id", "channel_idx", "sample_idx", r6("v.filtered", "filtered"), r6("v.kalman", "kalman"))


# ---- streams, run until their source is empty --------------------------------------------------------------------


def _streamed(spark, sf_dir, *cuts: int) -> tuple[DataFrame, str]:
    """The frames as a stream and a folder for what is made of it, in batches that end at ``cuts`` and hold FRAMES frames of a
    recording at most after them."""
    path = _folder(spark)
    return _fed_in_turn(V.frames(spark, sf_dir), path, *cuts), path


def _total(x: str) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda a, v: a + v)


@query("""select recording_id::varchar as recording_id, channel, sample_idx // 100 as window_idx, round(min(t_s), 6) as t0, round(avg(value), 6) + 0.0 as mean, round(arg_max(value, sample_idx), 6) + 0.0 as last
from samples group by 1, 2, 3 having count(*) = 100""", FR, CHANNELS)
def tumbling_stream(spark, sf_dir):
    """Windows of 100 frames on keyed state, in three batches that end within windows."""
    stream, path = _streamed(spark, sf_dir, 130, 390)
    got = _drained(keyed.tumbling(stream, 100), path)
    return got.select("recording_id", "channel", "window_idx", r6("t0", "t0"), r6(_total("x") / 100, "mean"), r6(F.element_at("x", -1), "last"))


@query("""select recording_id::varchar as recording_id, channel, epoch, round(min(t_s), 6) as t0, count(*) as n, round(avg(value), 6) + 0.0 as mean, round(arg_max(value, k), 6) + 0.0 as last from fired group by 1, 2, 3""", FR, CHANNELS, HOPS.replace("long_samples", "samples"))
def hopping_stream(spark, sf_dir):
    """Epochs by the recorder's rule on keyed state, in three batches."""
    stream, path = _streamed(spark, sf_dir, 130, 390)
    got = _drained(keyed.hopping(stream), path)
    return got.select("recording_id", "channel", "epoch", r6("t0", "t0"), F.size("x").cast("long").alias("n"), r6(_total("x") / F.size("x"), "mean"), r6(F.element_at("x", -1), "last"))


@query("select recording_id::varchar as recording_id, unnest(range(len(x))) as sample_idx, round(unnest(x), 6) + 0.0 as value from chain", FR, CHANNELS, *CAUSAL)
def causal_stream(spark, sf_dir):
    """The causal chain on keyed state, in three batches."""
    stream, path = _streamed(spark, sf_dir, 130, 390)
    return _drained(keyed.causal(stream), path).select("recording_id", "sample_idx", r6("value", "value"))


@query("""select recording_id::varchar as recording_id, channel, window_idx, round(list_dot_product(f.x, f.x) / 200, 6) + 0.0 as filtered, round(list_dot_product(c.x, c.x) / 200, 6) + 0.0 as car, round(list_dot_product(s.x, s.x) / 200, 6) + 0.0 as stopped
from filtered f join car c using (recording_id, channel, window_idx) join stopped s using (recording_id, channel, window_idx)""", FR, CHANNELS, *windowed_sql(200, "samples"))
def denoise_windows_stream(spark, sf_dir):
    """The windowed cleaning stream itself, in windows of 200 frames."""
    got = _published(V.frames(spark, sf_dir), lambda stream: stateful.denoise_windows(stream, 200))
    power = lambda c: F.aggregate(c, F.lit(0.0), lambda a, x: a + x * x) / F.size(c)
    return got.select("recording_id", "channel", "window_idx", *[r6(power(c), c) for c in ("filtered", "car", "stopped")])


@query("select recording_id::varchar as recording_id, window_idx, " + ", ".join(f"round(max(power) filter (band = '{b.lower()}' and channel = {i}), 9) + 0.0 as \"{b}{i}\"" for i in (1, 2, 3) for b in ("Delta", "Theta", "Alpha", "Beta", "Gamma")) + """
from (select recording_id, channel, window_idx, band, avg(p) as power from psd join (select * from bands where scheme = 'welch5') on f between fmin and fmax group by 1, 2, 3, 4) group by 1, 2""", FR, WELCH, BA)
def psd_windows_stream(spark, sf_dir):
    """The density stream itself, in three batches, written as the band table once and read back."""
    stream, path = _streamed(spark, sf_dir, 130, 390)
    stateful.write_band_table(stateful.psd_windows(stream, V.bands("welch5")), path + "/table", path + "/checkpoint", "window_idx", available_now=True).awaitTermination()
    got = spark.read.option("header", True).csv(path + "/table")
    return got.select(F.col("recording_id").cast("string").alias("recording_id"), F.col("window_idx").cast("long").alias("window_idx"), *[r6(F.col(c).cast("double"), c, 9) for c in R.BAND_COLUMNS])


@query("""select recording_id::varchar as recording_id, sample_idx, round(t_s, 6) as t, round(f[1], 6) + 0.0 as "Canal1", round(f[2], 6) + 0.0 as "Canal2", round(f[3], 6) + 0.0 as "Canal3", round(k[1], 6) + 0.0 as "Kalman1", round(k[2], 6) + 0.0 as "Kalman2", round(k[3], 6) + 0.0 as "Kalman3"
from (select recording_id, sample_idx, list(z order by channel) as f, list(x order by channel) as k from walk group by 1, 2) join frames using (recording_id, sample_idx)""", FR, CHANNELS, *WEIGHTS, FIRST3, kalman_sql("rolled", 125))
def write_pair_stream(spark, sf_dir):
    """Both tables of the rolling filter stream, in three batches, read back and joined."""
    stream, path = _streamed(spark, sf_dir, 130, 390)
    stateful.write_pair(stateful.trailing_and_kalman(stream, factor=1.0), path + "/f", path + "/k", path + "/checkpoint", available_now=True).awaitTermination()
    read = lambda p, name: spark.read.option("header", True).csv(path + p).select(F.col("recording_id").cast("string").alias("recording_id"), F.col("Timestamp").cast("double").alias("t"), *[F.col(f"Canal{i}").cast("double").alias(f"{name}{i}") for i in (1, 2, 3)])
    both = read("/f", "Canal").join(read("/k", "Kalman"), ["recording_id", "t"])
    return both.select("recording_id", F.round(F.col("t") * V.FS).cast("long").alias("sample_idx"), r6("t", "t"), *[r6(f"{name}{i}", f"{name}{i}") for name in ("Canal", "Kalman") for i in (1, 2, 3)])


@query("select recording_id::varchar as recording_id, sample_idx, round(ch[1], 6) + 0.0 as value, round(ch[5], 6) + 0.0 as other from frames", FR)
def align_stream(spark, sf_dir):
    """Two streams of the same recordings paired sample by sample."""
    path, f = _folder(spark), V.frames(spark, sf_dir)
    _fed(f.withColumn("ch", F.slice("ch", 1, 4)), path + "/a")
    _fed(f.withColumn("ch", F.slice("ch", 5, 4)), path + "/b")
    a, b = (R.read_sample_stream(spark, f"{path}/{x}", watermark="10 minutes").withColumn("value", F.col("ch")[0]) for x in "ab")
    return _drained(stateful.align(a, b, "5 minutes"), path).select("recording_id", "sample_idx", r6("value", "value"), r6("other", "other"))


@query("select recording_id::varchar as recording_id, sample_idx, unnest(range(0, len(ch)))::int as channel_idx, round(unnest(ch), 6) + 0.0 as value from (select * from frames qualify row_number() over (partition by recording_id order by sample_idx desc) <= 120)", FR)
def latest_n_stream(spark, sf_dir):
    """The ring of the last 120 frames after three batches: the last view of each recording."""
    stream, path = _streamed(spark, sf_dir, 130, 390)
    got = _drained(keyed.latest_n(stream, 120), path)
    last = got.groupBy("recording_id").agg(F.max("view").alias("view"))
    return flat(got.join(last, ["recording_id", "view"]).drop("view"))


@query("""select recording_id::varchar as recording_id, channel, sample_idx, round(lo, 6) + 0.0 as lo, round(hi, 6) + 0.0 as hi, round(lo - 0.1::double * (hi - lo), 6) + 0.0 as shown_lo, round(hi + 0.1::double * (hi - lo), 6) + 0.0 as shown_hi
from (select *, min(value) over w as lo, max(value) over w as hi from samples window w as (partition by recording_id, channel order by sample_idx rows 99 preceding))""", FR, CHANNELS)
def rolling_range_stream(spark, sf_dir):
    """Rolling extremes by monotonic queues, in three batches."""
    stream, path = _streamed(spark, sf_dir, 130, 390)
    got = _drained(keyed.rolling_range(stream, 100), path)
    return got.select("recording_id", "channel", "sample_idx", *[r6(c, c) for c in ("lo", "hi", "shown_lo", "shown_hi")])


@query("""select recording_id, channel, floor(sample_idx / 500.0)::bigint as second, count(*) as n, round(avg(value), 6) + 0.0 as mean, round(arg_max(value, sample_idx), 6) + 0.0 as last from (
  select * from long_samples where not (sample_idx % 100 = 7 and sample_idx <= 1249))
where (floor(sample_idx / 500.0) + 1) * 500 <= (select max(sample_idx) from long_samples) - 250 group by 1, 2, 3""", LO)
def event_windows(spark, sf_dir):
    """Windows of two seconds of event time. One row in a hundred of the first six seconds comes only with the third batch, and
    some come twice: those that the watermark of the second batch has passed are late and are dropped. Series of more than
    SAMPLES samples go on in further batches, so neither a task nor the stream's state has more of them at a time."""
    path = _folder(spark)
    keyed.use_rocksdb(spark)  # the samples of a batch are state until the watermark has passed them
    s = V.long_samples_in_buckets(spark, sf_dir).drop("t_s")
    i = F.col("sample_idx")
    held, again = (i % 100 == 7), (i % 50 == 20)
    rest = F.floor(F.greatest(i - 1600, F.lit(0)) / SAMPLES).cast("int") + 2
    own = F.when((i < 1500) & ~held, 0).when(i.between(1500, 1599), 1).otherwise(rest)
    rows = s.withColumn("_batch", F.explode(F.when(again & (i > 1400), F.array(own, rest)).otherwise(F.array(own))))
    _staged(rows, path, _in_files, least=3)
    stream = spark.readStream.schema(s.schema).option("maxFilesPerTrigger", FILES).parquet(path + "/in/*")
    stream = stream.withColumn("ts", F.timestamp_micros(i * 4000 + 1700000000000000)).withWatermark("ts", "1 second")
    got = _drained(event_time.event_windows(stream, "channel", seconds=2, whole=False), path, stores=spark.sparkContext.defaultParallelism)
    second = ((F.unix_micros("start") - 1700000000000000) / 2000000).cast("long")
    return got.select("recording_id", "channel", second.alias("second"), F.col("n").cast("long").alias("n"), r6(_total("x") / F.col("n"), "mean"), r6(F.element_at("x", -1), "last"))

"""Recordings as CSV files: reading, header sniffing, choosing, writing."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sigmill.operators import series
from sigmill.operators.frames import clean_numeric, parse_clock_time

# Names of the 10-20 positions that count as channels, and the aliases of the first channel.
POSITIONS = {"fp1", "fp2", "c3", "c4", "p3", "p4", "o1", "o2"}
FIRST_CHANNEL = ("Channel_1", "channel_1", "CHANNEL_1", "ch1")
#: Columns of the band table: electrode by electrode.
BAND_COLUMNS = [f"{band}{i}" for i in (1, 2, 3) for band in ("Delta", "Theta", "Alpha", "Beta", "Gamma")]


def clean_header(name: str) -> str:
    return name.strip().replace("'", "")


def clean_headers(df: DataFrame) -> DataFrame:
    return df.toDF(*map(clean_header, df.columns))


def detect_time_column(columns: Sequence[str]) -> str:
    """The first column whose name holds ``time``, in either case."""
    for c in columns:
        if "time" in c.lower():
            return c
    raise ValueError(f"no time column among {list(columns)}")


def detect_channels(columns: Sequence[str], canal: bool = False) -> list[str]:
    """``ch<n>``, ``channel_*`` and 10-20 names in file order; ``canal`` adds ``canal<n>``."""
    rule = re.compile(r"ch\d+|channel_.*" + (r"|canal\d+" if canal else ""), re.I)
    found = [c for c in columns if rule.fullmatch(c) or c.lower() in POSITIONS]
    if not found:
        raise ValueError(f"no channels among {list(columns)}")
    return found


def first_channel(columns: Sequence[str]) -> str:
    return next((c for c in FIRST_CHANNEL if c in columns), None) or detect_channels(columns)[0]


def first_channel_column(names: Column) -> Column:
    """``first_channel`` of an array of channel names."""
    known = F.filter(F.array(*[F.lit(c) for c in FIRST_CHANNEL]), lambda c: F.array_contains(names, c))
    return F.coalesce(F.try_element_at(known, F.lit(1)), F.try_element_at(names, F.lit(1)))


def recording_name(path: Column) -> Column:
    """File name without folder and ending; a part file of a table is named by the table's folder (or its value)."""
    # one pattern, anchored in the path's last two parts: searched for along the whole path, it costs more than a row's parsing
    last = r"^(?:(?:[^/]*=)?([^/=]+?)(?:\.csv)?/part-[^/]*|(?:[^/]*/)?([^/]+?)(?:\.csv(?:\.gz)?)?|.*)$"
    return F.regexp_replace(F.substring_index(path, "/", -2), last, "$1$2")


def read_recordings(spark: SparkSession, path: str | list[str], units_row: bool = True, canal: bool = False, seconds: float = series.SECONDS, numbered: bool = True) -> DataFrame:
    """CSV recordings of one header family as frames: ``recording_id, sample_idx, t_s, ts, ch, bad_time, channel_names``.

    All columns are read as text and cast after the header is sniffed; a file with another header fails the job. A
    clinical export has a row of units below the header: with ``units_row``, rows whose time does not parse while no
    channel is a number are dropped. ``sample_idx`` is the order by time within the recording, rows of bad time last,
    by their values; no task sorts more than ``seconds`` of a recording. Without
    ``numbered`` it is left out, and rows come as they are read: nothing is sorted or shuffled. A time like ``[hh:mm:ss.mmm dd/mm/yyyy]`` gives ``ts`` and seconds of the epoch in ``t_s``, a
    numeric one goes to ``t_s`` directly. Rows whose time is bad stay, with ``bad_time``.
    """
    raw = spark.read.option("header", True).option("inferSchema", False).option("enforceSchema", False).csv(path)
    names = [clean_header(c) for c in raw.columns]
    time, channels = detect_time_column(names), detect_channels(names, canal)
    tagged = raw.select(*[F.col(f"`{c}`").alias(f"_{i}") for i, c in enumerate(raw.columns)], recording_name(F.col("_metadata.file_path")).alias("recording_id"))
    column = lambda c: F.col(f"_{names.index(c)}")
    ts = parse_clock_time(column(time))
    # a clock time is no number: Spark need not try, which costs as much as parsing it
    seconds_of = clean_numeric(F.when(~column(time).contains(":"), column(time)))
    t_s = F.coalesce(seconds_of, F.unix_micros(ts) / F.lit(1e6))
    ch = F.array(*[clean_numeric(column(c)) for c in channels])
    out = tagged.select("recording_id", t_s.alias("t_s"), ts.alias("ts"), ch.alias("ch"))
    if units_row:
        out = out.filter(F.col("t_s").isNotNull() | F.exists("ch", lambda x: x.isNotNull()))
    out = out.withColumn("bad_time", F.col("t_s").isNull()).withColumn("channel_names", F.array(*[F.lit(c) for c in channels]))
    if not numbered:
        return out.select("recording_id", "t_s", "ts", "ch", "bad_time", "channel_names")
    # rows of bad time count as of an endless time: they are last, in buckets of their own
    order = [F.coalesce("t_s", F.lit(float("nan"))), "ch"]
    return series.number(out, ["recording_id"], order, seconds).select("recording_id", "sample_idx", "t_s", "ts", "ch", "bad_time", "channel_names")


def header_families(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """``file_path, header``: the first line that isn't empty of every CSV file below a path, as it stands there.

    One job over the files as text: lines outside a file's first block go in the scan, the first one of each
    file is a partial aggregate, so one row a file is shuffled. A file without any line has no row.
    """
    lines = spark.read.option("pathGlobFilter", "*.csv").option("recursiveFileLookup", True).text(path)
    lines = lines.select("value", F.col("_metadata.file_path").alias("file_path"), F.col("_metadata.file_block_start").alias("_at"))
    firsts = lines.filter((F.col("_at") == 0) & (F.trim("value") != "")).withColumn("_n", F.monotonically_increasing_id())
    return firsts.groupBy("file_path").agg(F.min_by("value", "_n").alias("header"))


def usable(header: str, canal: bool = False) -> bool:
    """Whether a header line names a time column and a channel."""
    try:
        names = [clean_header(c.strip().strip('"')) for c in header.lstrip("\ufeff").split(",")]
        return bool(detect_time_column(names) and detect_channels(names, canal))
    except ValueError:
        return False


def read_folder(spark: SparkSession, path: str | list[str], canal: bool = False, strict: bool = True, **options) -> DataFrame:
    """All recordings below a path as frames, whatever headers they have; see ``read_recordings``.

    Files are grouped by their header line and each family is read once, with its own header. The driver gets one row
    a family with its files' paths, no more than Spark's own listing of the folder. Files whose header names no time or
    no channel are an error that lists some of them, or are left out without ``strict``. A folder without a
    usable file gives no rows. Names of recordings are to be unique below the path.
    """
    families = header_families(spark, path).groupBy("header").agg(F.sort_array(F.collect_list("file_path")).alias("paths")).orderBy("header").collect()
    wrong = [r for r in families if not usable(r["header"], canal)]
    if wrong and strict:
        raise ValueError("no time or channel in the header of " + ", ".join(r["paths"][0] for r in wrong[:5]))
    paths = [r["paths"] for r in families if usable(r["header"], canal)]
    if not paths:
        none = spark.createDataFrame([], "recording_id string, sample_idx long, t_s double, ts timestamp, ch array<double>, bad_time boolean, channel_names array<string>")
        return none if options.get("numbered", True) else none.drop("sample_idx")
    return read_families(spark, paths, canal=canal, **options)


def read_families(spark: SparkSession, paths: Sequence[str | list[str]], **options) -> DataFrame:
    """Recordings of several header families, each read with its own header, as one table of frames."""
    tables = [read_recordings(spark, p, **options) for p in paths]
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out


def files(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """``file_path, recording, modified``: one row per CSV file below a path, from Spark's own listing."""
    listed = spark.read.format("binaryFile").option("pathGlobFilter", "*.csv").option("recursiveFileLookup", True).load(path)
    return listed.select(F.col("path").alias("file_path"), recording_name(F.col("path")).alias("recording"), F.col("modificationTime").alias("modified"))


def latest_recording(listed: DataFrame, prefix: str, preferred: str = "eeg") -> DataFrame:
    """The file to work on: the preferred name if there is one, else the newest whose name starts with ``prefix``; one row at most."""
    known = listed.filter((F.col("recording") == preferred) | F.col("recording").startswith(prefix))
    best = known.agg(F.max_by(F.struct("file_path", "recording", "modified"), F.struct((F.col("recording") == preferred).cast("int"), "modified", "file_path")).alias("x"))
    return best.filter("x is not null").select("x.*")


def wide(frames: DataFrame, names: Sequence[str]) -> DataFrame:
    """``timestamp`` and one column a channel, for writing."""
    return frames.select("recording_id", F.col("t_s").alias("timestamp"), *[F.try_element_at("ch", F.lit(i + 1)).alias(n) for i, n in enumerate(names)])


def write_recording(frames: DataFrame, path: str, names: Sequence[str], fmt: str = "csv") -> None:
    """One folder a recording with header; rows in time order within a file."""
    out = wide(frames, names).repartition("recording_id").sortWithinPartitions("recording_id", "timestamp")
    out.write.partitionBy("recording_id").option("header", True).format(fmt).save(path)


def pair_columns(column: str) -> list[Column]:
    """``recording_id, Timestamp, Canal1..3`` of one array column."""
    return [F.col("recording_id"), F.col("t_s").alias("Timestamp"), *[F.try_element_at(column, F.lit(i)).alias(f"Canal{i}") for i in (1, 2, 3)]]


def write_filtered_pair(frames: DataFrame, path_filtered: str, path_kalman: str) -> None:
    """Two aligned CSV tables ``Timestamp, Canal1..3`` from frames that carry ``ch`` and ``kalman``, which are computed once
    and kept on the executors' disks for the second table."""
    kept = frames.select("recording_id", "t_s", "ch", "kalman").persist(StorageLevel.DISK_ONLY)
    try:
        for column, path in (("ch", path_filtered), ("kalman", path_kalman)):
            kept.select(*pair_columns(column)).write.partitionBy("recording_id").option("header", True).csv(path)
    finally:
        kept.unpersist()


def band_table(powers: DataFrame, *keys: str) -> DataFrame:
    """Powers (``channel`` from 1, ``band``) as the 15 named columns, with a fixed pivot list: one pass."""
    label = F.concat(F.initcap("band"), F.col("channel"))
    return powers.withColumn("_l", label).groupBy("recording_id", *keys).pivot("_l", BAND_COLUMNS).agg(F.first("power"))


def write_band_table(powers: DataFrame, path: str, *keys: str) -> None:
    """The band table as CSV with header."""
    band_table(powers, *keys).write.option("header", True).csv(path)


def compact(spark: SparkSession, source: str, target: str, rows_per_file: int = 5_000_000) -> None:
    """Many small recordings into few parquet files, in ranges of recordings."""
    frames = read_recordings(spark, source)
    frames.repartitionByRange("recording_id").write.option("maxRecordsPerFile", rows_per_file).parquet(target)


def read_sample_stream(spark: SparkSession, path: str | None = None, kafka: dict[str, str] | None = None, watermark: str = "10 seconds", clock: str = "arrival", files_per_batch: int | None = None) -> DataFrame:
    """A stream of frames from JSON lines ``{recording_id, sample_idx, t_s, ch}`` in files or a Kafka topic, with event time ``ts``.

    Recordings count their time from where they like, most from 0, so one clock for all of them is that of ``arrival``: the
    file's or message's own time. It never lies before the watermark unless files come back with times older than
    that by more than ``watermark``. With ``clock="sample"`` it is ``t_s`` as seconds of the epoch, for recordings that
    have absolute times: what arrives too late by that clock is dropped by stateful operators, and counted by Spark.
    """
    schema = "recording_id string, sample_idx long, t_s double, ch array<double>"
    if kafka:
        raw = spark.readStream.format("kafka").options(**kafka).load().select(F.from_json(F.col("value").cast("string"), schema).alias("v"), F.col("timestamp").alias("_arrived")).select("v.*", "_arrived")
    else:
        reader = spark.readStream.schema(schema)
        reader = reader.option("maxFilesPerTrigger", files_per_batch) if files_per_batch else reader
        raw = reader.json(path).select("*", F.col("_metadata.file_modification_time").alias("_arrived"))
    clocks = {"arrival": F.col("_arrived"), "sample": F.timestamp_micros((F.col("t_s") * 1_000_000).cast("long"))}
    return raw.withColumn("ts", clocks[clock]).drop("_arrived").withWatermark("ts", watermark)


def write_by_batch(stream: DataFrame, sinks: dict[str, Callable[[DataFrame], DataFrame]], checkpoint: str, fmt: str = "csv", available_now: bool = False):
    """Several tables from one stream, each row in each of them exactly once, also after a failure between two of them.

    ``sinks`` says what of a micro-batch goes to each path. A batch is computed once and kept on disk while it is written.
    Its files lie in a folder named by its number, which is overwritten: a batch that is replayed after a restart replaces
    what its first try has left. Read a table with the path itself; ``batch`` is a column of it.
    """

    def write(batch: DataFrame, number: int) -> None:
        kept = batch.persist(StorageLevel.DISK_ONLY)
        try:
            for path, part in sinks.items():
                part(kept).write.mode("overwrite").option("header", True).format(fmt).save(f"{path.rstrip('/')}/batch={number}")
        finally:
            kept.unpersist()

    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def publish(stream: DataFrame, target: str, checkpoint: str, fmt: str = "parquet", available_now: bool = False, **options: str):
    """Append a processed stream to files or, with ``fmt='kafka'`` and its options, to a topic as JSON.

    ``available_now`` takes what the source holds and ends; else the query runs on.
    """
    if fmt == "kafka":
        stream = stream.select(F.to_json(F.struct("*")).alias("value"))
    writer = stream.writeStream.format(fmt).option("checkpointLocation", checkpoint).outputMode("append").options(**options)
    writer = writer.trigger(availableNow=True) if available_now else writer
    return writer.start() if fmt == "kafka" else writer.start(target)

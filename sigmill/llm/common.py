"""What the text operators share: word splitting, written intermediate tables, dense positions."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The white space that parts words in every contract of this package.
WORD_GAP = r"[\x20\x09-\x0D]+"
GAP_CHARS = " \t\n\x0b\x0c\r"


def scratch(spark: SparkSession) -> str:
    """A new folder name below the shared checkpoint folder that the cluster names.

    Where ``spark.checkpoint.dir`` is unset, a local session (tests, notebooks) gets a folder of its own; on a cluster
    that is an error, since executors don't share local folders.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="sigmill-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/sigmill-{uuid.uuid4().hex}"


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder once and read it back: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = scratch(spark)
    df.write.parquet(path)
    return spark.read.schema(T.StructType([T.StructField(f.name, f.dataType, True) for f in df.schema])).parquet(path)


def documents(spark: SparkSession, sf_dir: str, table: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def n_words(text: Column) -> Column:
    """Number of ``[^\\x20\\x09-\\x0D]+`` words; null and empty text have 0."""
    core = F.btrim(text, F.lit(GAP_CHARS))
    return F.when(F.coalesce(core, F.lit("")) == "", F.lit(0)).otherwise(F.size(F.split(core, WORD_GAP))).cast("long")


def with_position(df: DataFrame, *keys: Column | str, name: str = "pos") -> DataFrame:
    """Dense 0-based rank of each row in the order of ``keys``, without a single-task window.

    Rows are range-partitioned and sorted, then written; a row's place is its place in its partition
    plus the rows of the partitions before. Only one count per partition is put in order in one place.
    """
    spark = df.sparkSession
    cols = [F.col(k) if isinstance(k, str) else k for k in keys]
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = materialize(df.repartitionByRange(n, *cols).sortWithinPartitions(*cols).withColumn("_mono", F.monotonically_increasing_id()))
    placed = placed.withColumn("_part", F.shiftright("_mono", 33)).withColumn("_at", F.col("_mono").bitwiseAND(F.lit((1 << 33) - 1)))
    counts = placed.groupBy("_part").count().collect()  # one number per partition
    before, rows = 0, []
    for r in sorted(counts, key=lambda r: r["_part"]):
        rows.append((r["_part"], before))
        before += r["count"]
    offsets = spark.createDataFrame(rows, "_part long, _before long")
    return placed.join(F.broadcast(offsets), "_part").withColumn(name, F.col("_before") + F.col("_at")).drop("_mono", "_part", "_at", "_before")

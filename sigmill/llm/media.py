"""Media columns stored as content-defined chunks."""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sigmill.llm.common import documents, materialize

#: Payloads are filled up with spaces to a multiple of this.
UNIT = 192
#: Least, usual and largest bytes of a chunk.
SMALLEST, USUAL, LARGEST = 2048, 8192, 65536
#: Header of a mono 8-bit PCM sound file at this many samples a second.
RATE = 8000
HEADER = struct.Struct("<4sI4s4sIHHIIHH4sI")


def payload(text: str | None) -> bytes:
    """The text in UTF-8 and spaces up to a positive multiple of UNIT."""
    raw = (text or "").encode()
    return raw + b" " * (max(1, -(-len(raw) // UNIT)) * UNIT - len(raw))


def to_media(samples: bytes) -> bytes:
    """A sound file whose 8-bit samples are the payload, byte for byte."""
    return HEADER.pack(b"RIFF", HEADER.size - 8 + len(samples), b"WAVE", b"fmt ", 16, 1, 1, RATE, RATE, 1, 8, b"data", len(samples)) + samples


def from_media(stored: bytes) -> bytes:
    """The samples of a stored file; a damaged file raises."""
    riff, size, wave, fmt, _, kind, channels, _, _, _, bits, data, n = HEADER.unpack_from(stored)
    if (riff, wave, fmt, data, kind, channels, bits) != (b"RIFF", b"WAVE", b"fmt ", b"data", 1, 1, 8) or n != len(stored) - HEADER.size or size != len(stored) - 8:
        raise ValueError("not a stored payload")
    return stored[HEADER.size :]


def _gear() -> np.ndarray:
    return np.random.default_rng(2016).integers(0, 1 << 32, 256, dtype=np.uint32)


GEAR = _gear()


def cuts(data: bytes) -> list[int]:
    """Ends of the chunks of ``data``.

    The gear hash at a byte is the sum of the table values of the last 32 bytes, each shifted by its distance; it
    is built by doubling. A chunk ends where the hash's upper bits are 0, at LARGEST bytes, or at the end, and has
    at least SMALLEST bytes unless it is the last.
    """
    if len(data) <= SMALLEST:
        return [len(data)] if data else []
    h = GEAR[np.frombuffer(data, np.uint8)]
    for k in (1, 2, 4, 8, 16):
        h[k:] += h[:-k] << np.uint32(k)
    marks = np.flatnonzero(h >> np.uint32(32 - (USUAL - SMALLEST).bit_length()) == 0) + 1
    ends, at = [], 0
    while at < len(data):
        i = np.searchsorted(marks, at + SMALLEST)
        end = min(int(marks[i]) if i < len(marks) else len(data), at + LARGEST, len(data))
        ends.append(end)
        at = end
    return ends


def chunk(docs: DataFrame, with_data: bool = True) -> DataFrame:
    """``doc_id, row, ord, n_chunks, n_bytes, size, digest, data``: the chunks of the stored form of every row.

    ``row`` tells rows apart that share an id. ``data`` (compressed) is null where the same task has met the digest
    before, so that copies that lie together are moved once.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=1)
        met: set[bytes] = set()
        for batch in batches:
            for k in range(0, batch.num_rows, 512):
                part = batch.slice(k, 512)
                rows = []
                for doc, row, text in zip(*(part.column(i).to_pylist() for i in range(3)), strict=True):
                    stored = to_media(payload(text))
                    ends = cuts(stored)
                    for i, (a, b) in enumerate(zip([0, *ends], ends, strict=False)):
                        piece = stored[a:b]
                        digest = hashlib.sha256(piece).digest()
                        fresh = digest not in met
                        if fresh:
                            met.add(digest)
                        rows.append((doc, row, i, len(ends), len((text or "").encode()), b - a, digest, press.compress(piece) if fresh and with_data else None))
                yield pa.RecordBatch.from_pylist([dict(zip(CHUNK.names, r, strict=True)) for r in rows], schema=CHUNK)
                if len(met) > 1_000_000:
                    met.clear()

    rows = docs.select("doc_id", F.monotonically_increasing_id().alias("row"), "text")
    return rows.mapInArrow(run, "doc_id long, row long, ord int, n_chunks int, n_bytes long, size int, digest binary, data binary")


CHUNK = pa.schema([("doc_id", pa.int64()), ("row", pa.int64()), ("ord", pa.int32()), ("n_chunks", pa.int32()), ("n_bytes", pa.int64()), ("size", pa.int32()), ("digest", pa.binary()), ("data", pa.binary())])


def recipes(docs: DataFrame) -> DataFrame:
    """The ordered chunk lists, without bytes."""
    return chunk(docs, with_data=False).drop("data")


#: List entries of one digest that one task takes, and groups of tasks that sum up what they have of a hot one.
ENTRIES, GROUPS = 1000, 256


def hot_digests(lists: DataFrame, entries: int = ENTRIES) -> DataFrame:
    """``digest, salts`` of every digest with more than ``entries`` list entries: so many copies of it are stored that
    each serves ``entries`` of them at most."""
    return materialize(lists.groupBy("digest").count().filter(F.col("count") > entries).select("digest", F.ceil(F.col("count") / entries).cast("int").alias("salts")))


def features(samples: np.ndarray) -> str:
    """Mean, deviation, peak, zero crossings, and energies of 8 bands of the samples around the middle 128."""
    x = samples.astype(np.float64) - 128
    crossings = int(np.count_nonzero(np.diff(np.signbit(x))))
    frames = x.reshape(-1, UNIT)
    power = np.zeros(UNIT // 2)
    for i in range(0, len(frames), 4096):
        power += (np.abs(np.fft.rfft(frames[i : i + 4096], axis=1))[:, 1:] ** 2).sum(0)
    bands = np.log1p(power.reshape(8, -1).mean(1) / len(frames))
    return f"mean={x.mean():.4f};std={x.std():.4f};peak={int(np.abs(x).max())};zc={crossings};bands=" + ",".join(f"{b:.3f}" for b in bands)


def rebuild(lists: DataFrame, chunks: DataFrame, hot: DataFrame) -> DataFrame:
    """Join the chunk lists with the distinct chunks, put every document together, check it and describe it.

    ``doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature``. Every chunk
    is held against its digest when read; a missing or damaged one raises. The join is dealt by digest, and all its branches
    read one exchange of the bytes. Hot digests, where there are any, are taken out before that exchange and go by one of
    their own: every task that met one sends one row to one of GROUPS sums, these sums become one row, and only this row is
    repeated as often as its entries need, which are dealt over the copies: as many rows as tasks and copies. A document of
    one chunk is whole after the join; the chunks of others are brought together in order by sorting their partition, so a
    task holds one document at a time.
    """
    met = chunks.filter(F.col("data").isNotNull()).select("digest", "data")
    # without hot digests there is no branch of theirs: Spark may send the bytes for it before it sees that it is empty
    some_hot = not hot.isEmpty()
    # Spark broadcasts the hot digests while they are few
    stored = (met.join(hot, "digest", "left_anti") if some_hot else met).groupBy("digest").agg(F.first("data").alias("data"))
    grouped = met.join(hot, "digest").groupBy("digest", (F.spark_partition_id() % GROUPS).alias("_group")).agg(F.first("data").alias("data"), F.max("salts").alias("salts"))
    once = grouped.groupBy("digest").agg(F.first("data").alias("data"), F.max("salts").alias("salts"))
    repeated = once.select("digest", "data", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))

    def fetch(wanted: DataFrame) -> DataFrame:
        if not some_hot:
            return wanted.join(stored, "digest")
        cold = wanted.join(hot, "digest", "left_anti").join(stored, "digest")
        dealt = wanted.join(hot, "digest").withColumn("salt", F.pmod(F.xxhash64("row"), F.col("salts")).cast("int")).drop("salts")
        return cold.unionByName(dealt.join(repeated, ["digest", "salt"]).drop("salt"))

    single, several = fetch(lists.filter("n_chunks = 1")), fetch(lists.filter("n_chunks > 1"))
    dealt = several.repartition("row").sortWithinPartitions("row", "ord")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdDecompressor()
        parts: list[bytes] = []
        for batch in batches:
            rows = []
            get = {n: batch.column(i).to_pylist() for i, n in enumerate(batch.schema.names)}
            for doc, i, n, n_bytes, size, digest, data in zip(*(get[k] for k in ("doc_id", "ord", "n_chunks", "n_bytes", "size", "digest", "data")), strict=True):
                piece = press.decompress(data, max_output_size=size)
                if i != len(parts) or hashlib.sha256(piece).digest() != digest:
                    raise ValueError(f"document {doc}: chunk {i} is missing or damaged")
                parts.append(piece)
                if len(parts) == n:
                    media = b"".join(parts)
                    parts = []
                    samples = from_media(media)
                    rows.append((doc, n_bytes, len(samples), hashlib.sha256(samples).hexdigest(), zlib.crc32(samples[-16:]), len(media), hashlib.sha256(media).hexdigest(), features(np.frombuffer(samples, np.uint8))))
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 8
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])
        if parts:
            raise ValueError("the last document is cut short")

    columns = ["doc_id", "ord", "n_chunks", "n_bytes", "size", "digest", "data"]
    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return single.select(columns).mapInArrow(run, schema).union(dealt.select(columns).mapInArrow(run, schema))


def op8_media(spark, sf_dir: str) -> DataFrame:
    """Store every text of ``documents`` as media chunks, read it back and describe it.

    Null and empty texts are 192 spaces. Repeated rows are stored once and returned each; rows with a null id as well.
    A very long text is many chunks, of which a task holds one document's. Equal chunks tie: any of them is stored. An
    empty table gives an empty table. Columns besides ``doc_id`` and ``text`` are not read, whatever their names.
    """
    docs = documents(spark, sf_dir)
    lists = materialize(recipes(docs))
    return rebuild(lists, chunk(docs), hot_digests(lists))

"""Quality classifier: a byte-level convolutional network in numpy."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sigmill.llm.common import documents

#: Bytes of a chunk and the step between chunks: every byte lies in two chunks.
WIDTH, STEP = 12, 6
EMBED, FILTERS = 6, 32
#: Bytes that are put through the filters at once.
BLOCK = 1 << 18


@dataclass
class Model:
    """``embed`` 256 x EMBED, ``kernel`` WIDTH*EMBED x FILTERS with ``bias``, then ``out`` FILTERS with ``shift``."""

    embed: np.ndarray
    kernel: np.ndarray
    bias: np.ndarray
    out: np.ndarray
    shift: float


def layout(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts in one buffer, each from a multiple of STEP on, and the first and last+1 chunk of each.

    A text has as many chunks as cover it, at least one; what lies behind its end is byte 0.
    """
    sizes = np.array([len(t) for t in texts], np.int64)
    chunks = np.maximum(1, -(-(sizes - WIDTH) // STEP) + 1)
    starts = np.concatenate([[0], np.cumsum(chunks + WIDTH // STEP - 1)])
    buffer = np.zeros(starts[-1] * STEP + WIDTH, np.uint8)
    for t, s in zip(texts, starts, strict=False):
        buffer[s * STEP : s * STEP + len(t)] = np.frombuffer(t, np.uint8)
    return buffer, np.stack([starts[:-1], starts[:-1] + chunks], 1)


def responses(model: Model, buffer: np.ndarray) -> np.ndarray:
    """Filter responses of all chunks, chunks x FILTERS."""
    e = model.embed[buffer]
    n = (len(buffer) - WIDTH) // STEP + 1
    rows = np.lib.stride_tricks.as_strided(e, (n, WIDTH * EMBED), (e.strides[0] * STEP, e.strides[1]))
    return np.ascontiguousarray(rows) @ model.kernel + model.bias


def pooled(model: Model, texts: list[bytes]) -> np.ndarray:
    """The largest response of each filter over each whole text; long texts go through in blocks."""
    result = np.full((len(texts), FILTERS), -np.inf, np.float32)
    todo: list[tuple[int, bytes]] = []
    filled = 0

    def flush() -> None:
        if todo:
            buffer, spans = layout([t for _, t in todo])
            best = np.maximum.reduceat(responses(model, buffer), np.minimum(spans.ravel(), (len(buffer) - WIDTH) // STEP), axis=0)[::2]
            np.maximum.at(result, [i for i, _ in todo], best)
            todo.clear()

    for i, t in enumerate(texts):
        at = 0
        while True:
            part = t[at : at + BLOCK - BLOCK % STEP + WIDTH - STEP]
            todo.append((i, part))
            filled += len(part) + WIDTH
            if filled >= BLOCK:
                flush()
                filled = 0
            at += BLOCK - BLOCK % STEP
            if at + WIDTH - STEP >= len(t):
                break
    flush()
    return result


def score(model: Model, texts: list[bytes]) -> np.ndarray:
    z = np.maximum(pooled(model, texts), 0) @ model.out + model.shift
    return 1 / (1 + np.exp(-np.clip(z.astype(np.float64), -30, 30)))


def train(texts: list[bytes], labels: np.ndarray, prior: float, epochs: int = 20, seed: int = 7) -> Model:
    """Fit the network by Adam on the logistic loss; only the chunk that won a filter's pooling gets its gradient.

    The classes are weighted alike in the loss, then ``shift`` moves to the share ``prior`` of label 1.
    """
    rng = np.random.default_rng(seed)
    p = {
        "embed": rng.normal(0, 0.5, (256, EMBED)), "kernel": rng.normal(0, 1 / np.sqrt(WIDTH * EMBED), (WIDTH * EMBED, FILTERS)),
        "bias": np.zeros(FILTERS), "out": rng.normal(0, 0.3, FILTERS), "shift": np.zeros(1),
    }
    p = {k: v.astype(np.float32) for k, v in p.items()}
    first, second = ({k: np.zeros_like(v) for k, v in p.items()} for _ in range(2))
    y = np.asarray(labels, np.float32)
    weight = np.where(y == 1, 0.5 / max(y.mean(), 1e-6), 0.5 / max(1 - y.mean(), 1e-6))
    batch, t = 32, 0
    for epoch in range(epochs):
        rate = 0.006 * 0.5 * (1 + np.cos(np.pi * epoch / epochs))
        for ids in np.array_split(order := rng.permutation(len(texts)), max(1, len(order) // batch)):
            buffer, spans = layout([texts[i] for i in ids])
            model = Model(p["embed"], p["kernel"], p["bias"], p["out"], float(p["shift"][0]))
            z = responses(model, buffer)
            top = np.stack([z[a:b].argmax(0) + a for a, b in spans])
            best = np.take_along_axis(z, top, 0)
            hidden = np.maximum(best, 0)
            prob = 1 / (1 + np.exp(-np.clip(hidden @ p["out"] + p["shift"][0], -30, 30)))
            err = ((prob - y[ids]) * weight[ids] / len(ids)).astype(np.float32)
            back = err[:, None] * p["out"] * (best > 0)
            codes = buffer[(top * STEP)[..., None] + np.arange(WIDTH)]  # texts x FILTERS x WIDTH
            rows = p["embed"][codes].reshape(len(ids), FILTERS, WIDTH * EMBED)
            grad = {"out": hidden.T @ err, "shift": err.sum(keepdims=True), "bias": back.sum(0), "kernel": np.einsum("nfk,nf->kf", rows, back)}
            into = (back[..., None] * p["kernel"].T).reshape(len(ids), FILTERS, WIDTH, EMBED)
            grad["embed"] = np.zeros_like(p["embed"])
            np.add.at(grad["embed"], codes.ravel(), into.reshape(-1, EMBED))
            t += 1
            for k, g in grad.items():
                g = g + 1e-4 * p[k] * (k != "shift")
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.99 * second[k] + 0.01 * g * g
                p[k] = (p[k] - rate * first[k] / (1 - 0.9**t) / (np.sqrt(second[k] / (1 - 0.99**t)) + 1e-7)).astype(np.float32)
    prior = min(max(prior, 0.01), 0.99)
    return Model(p["embed"], p["kernel"], p["bias"], p["out"], float(p["shift"][0]) + float(np.log(prior / (1 - prior))) * 0.5)


def fold(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 3


def training_sample(docs: DataFrame, labels: DataFrame, per_class: int = 1500, seed: int = 7) -> tuple[list[bytes], np.ndarray, float]:
    """Whole texts of at most ``per_class`` labelled rows of each class, taken by a hash of the id, and the share of
    label 1 among all labelled rows. Rows whose fold is 1 are left out. Ids, not texts, are drawn first."""
    known = labels.filter(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1) & (fold(F.col("doc_id")) != 1)).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    counts = {r["quality"]: r["count"] for r in known.groupBy("quality").count().collect()}
    place = F.xxhash64("doc_id", F.lit(seed))
    ids = [known.filter(F.col("quality") == q).orderBy(place, "doc_id").limit(per_class) for q in (0, 1)]
    drawn = ids[0].union(ids[1]).collect()  # 2 * per_class ids and labels
    spark = docs.sparkSession
    chosen = F.broadcast(spark.createDataFrame([(r["doc_id"], r["quality"]) for r in drawn], "doc_id long, quality int"))
    rows = docs.select("doc_id", "text").join(chosen, "doc_id").select("doc_id", "text", "quality").collect()
    rows.sort(key=lambda r: (r["doc_id"], r["text"] or ""))
    n = sum(counts.values())
    return [(r["text"] or "").encode() for r in rows], np.array([r["quality"] for r in rows]), counts.get(1, 0) / n if n else 0.5


def fit(docs: DataFrame, labels: DataFrame, per_class: int = 1500, epochs: int = 20) -> Model:
    """Train on a bounded sample of ``per_class`` labelled ids of each class.

    Without labelled rows every text gets the score 0.5. Labels that are null or neither 0 nor 1, and null ids, are no
    labels; of repeated labels the larger one counts; ids tie in no order but that of their hash. Null texts are
    empty ones; of very long texts every byte is covered; rows of ``docs`` that share a drawn id are all taken.
    """
    texts, y, prior = training_sample(docs, labels, per_class)
    if not texts:
        return Model(*(np.zeros(s, np.float32) for s in ((256, EMBED), (WIDTH * EMBED, FILTERS), FILTERS, FILTERS)), 0.0)
    return train(texts, y, prior, epochs)


def score_documents(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, score, predicted`` of every row, each from its whole text; null text counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 512):
                part = batch.slice(k, 512)
                s = score(model, [(t or "").encode() for t in part.column(1).to_pylist()])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(s, pa.float64()), pa.array((s >= 0.5).astype(np.int32))], ["doc_id", "score", "predicted"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double, predicted int")


def op1_quality(spark, sf_dir: str) -> DataFrame:
    """Every row of ``documents`` with its score: repeated rows each, alike; null and empty texts with that of no text at
    all; a null id is never held out. Other columns are ignored; an empty table gives an empty table."""
    docs = documents(spark, sf_dir)
    model = fit(docs, documents(spark, sf_dir, "labels"))
    scored = score_documents(docs, model)
    return scored.select("doc_id", (fold(F.coalesce(F.col("doc_id"), F.lit(-1))) == 1).alias("held_out"), "score", "predicted")


def keep_good(docs: DataFrame, model: Model) -> DataFrame:
    """The rows that the model accepts, with their own columns. Each row is scored where it is.

    Null and empty texts are scored as empty and go or stay like others; repeated rows and rows with a null id are
    judged each by its own text; a score of exactly 0.5 stays; an empty table gives an empty table.
    """
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 512):
                part = batch.slice(k, 512)
                s = score(model, [(t or "").encode() for t in part.column(names.index("text")).to_pylist()])
                yield part.filter(pa.array(s >= 0.5))

    return docs.mapInArrow(run, docs.schema)

"""Removal of byte strings that repeat across documents, by suffix arrays over sharded contexts.

A 50-byte string and its copy have the same smallest 24-gram hash at the same place (the string's anchor). Every
document gives the anchors of all its 50-byte windows, about one in 14 bytes, with a hash of the context that such
windows can cover. Contexts that are equal as a whole are settled by that hash where the smallest id of each is
kept, first within a task and then in the anchor's bucket. Where an anchor has different contexts (the borders of
repeated passages, and chance), their bytes are brought together in shards by anchor: each shard sorts them into a
suffix array, common prefixes of 50 bytes and more give the repeated windows, and shards are merged by binary search.
Anchors with very many different contexts are dealt by context, and their windows one by one by a 128-bit digest, so
that no task holds all contexts of one anchor.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sigmill.llm.common import documents, materialize

MATCH, GRAM = 50, 24
SIDE = MATCH - GRAM  # how far a window can reach before its anchor
#: Window starts of a piece of a document, and bytes that are hashed and whose anchors are packed together.
PIECE, BUFFER = 1 << 18, 1 << 19
#: Bytes of text per bucket of anchors; contexts per shard bucket; symbols of one suffix array.
BUCKET_BYTES, BUCKET_CONTEXTS, SHARD = 4 << 20, 15_000, 1 << 18
#: Different contexts above which an anchor is hot; bytes of text that are sampled to find hot anchors beforehand.
HOT, SAMPLE_BYTES = 3_750, 16 << 20
#: Windows of hot anchors per bucket of digests; hot contexts whose windows are hashed at once.
BUCKET_WINDOWS, HASHED = 400_000, 4096

_rng = np.random.default_rng(50)
TABLE = _rng.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BASE = int(_rng.integers(1 << 60, 1 << 62)) * 8 + 5
INVERSE = pow(BASE, -1, 1 << 64)
SPREAD = np.uint64(0x9E3779B97F4A7C15)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


@lru_cache(4)
def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, np.uint64(base % (1 << 64)), np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def _scale(k: int) -> np.uint64:
    return np.uint64(pow(BASE, k, 1 << 64))


def anchors(buffer: np.ndarray, spans: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Anchor positions, their gram hashes, context hashes and span numbers.

    ``spans`` has rows (first, end, from, to): a document's bytes lie in [first, end) of ``buffer`` and the windows
    that count start in [from, to). Of equal hashes in a window the leftmost is the anchor.
    """
    n = len(buffer)
    one = TABLE[buffer]
    eight = one
    for k in (1, 2, 4):
        eight = eight[:-k] * _scale(k) + eight[k:]
    grams = eight[:-16] * _scale(16) + eight[8:-8] * _scale(8) + eight[16:]
    del eight
    grams = _mixed(grams)
    bits = np.uint64((1 << 24) - 1)
    low = (grams & ~bits) | np.arange(len(grams), dtype=np.uint64)
    width = SIDE + 1
    for k in (1, 2, 4, 8):
        low = np.minimum(low[:-k], low[k:])
    low = np.minimum(low[: n - MATCH + 1], low[width - 16 : width - 16 + n - MATCH + 1])
    use = np.zeros(n - MATCH + 2, np.int8)
    np.add.at(use, spans[:, 2], 1)
    np.add.at(use, spans[:, 3], -1)
    pos = (low[np.cumsum(use[:-1]) > 0] & bits).astype(np.int64)
    if not len(pos):
        return pos, pos.view(np.uint64), pos.view(np.uint64), pos
    pos = pos[np.concatenate([[True], np.diff(pos) != 0])]
    owner = np.searchsorted(spans[:, 0], pos, "right") - 1
    first, end = np.maximum(spans[owner, 0], pos - SIDE), np.minimum(spans[owner, 1], pos + MATCH)
    del low, use
    room = PIECE + BUFFER + 4 * MATCH  # no buffer is longer
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(one * _powers(BASE, room)[:n])])
    context = (total[end] - total[first]) * _powers(INVERSE, room)[first]
    context = _mixed(context + ((pos - first) * 128 + (end - first)).astype(np.uint64))
    # anchors are minima, so their hashes crowd at the low end; times an odd number they are spread over all buckets
    return pos, grams[pos] * SPREAD, context, owner


def _planes(a: np.ndarray, width: int) -> bytes:
    """Byte planes of an array of 64-bit numbers, so that empty upper bytes compress to nothing."""
    return np.ascontiguousarray(a.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()


def _unplanes(data: bytes, width: int) -> np.ndarray:
    p = np.frombuffer(data, np.uint8).reshape(width, -1)
    out = np.zeros((p.shape[1], 8), np.uint8)
    out[:, :width] = p.T
    return out.reshape(-1).view("<u8")


def _merged(doc: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Unions of the spans of each document; all spans have about the same length, so sorting by start suffices."""
    if not len(doc):
        return doc, start, end
    order = np.lexsort((end, start, doc))
    doc, start, end = doc[order], start[order], end[order]
    fresh = np.concatenate([[True], (doc[1:] != doc[:-1]) | (start[1:] > end[:-1])])
    at = np.flatnonzero(fresh)
    return doc[at], start[at], np.maximum.reduceat(end, at)


PACKED = "bucket int, n int, hs binary, contexts binary, docs binary, places binary"


def pack_anchors(docs: DataFrame, buckets: int, hot: np.ndarray) -> DataFrame:
    """Anchors of all documents, packed by bucket of their gram hash, ``hot`` ones by their context in buckets from
    ``buckets`` on.

    Of equal contexts that are packed together only those of the smallest id go on; the others are repeats and leave as
    finished spans in rows of negative buckets (docs, starts in ``hs``, ends in ``places``).
    """

    def hashed(pieces: list) -> tuple[np.ndarray, ...]:
        starts = np.cumsum([0, *(len(p[1]) for p in pieces)])
        buffer = np.frombuffer(b"".join(p[1] for p in pieces), np.uint8)
        spans = np.array([(s, s + len(p[1]), s + p[3], s + p[4]) for s, p in zip(starts, pieces, strict=False)])
        ids, offsets = np.array([p[0] for p in pieces], np.int64), np.array([p[2] for p in pieces], np.int64)
        pos, h, c, owner = anchors(buffer, spans)
        return h, c, ids[owner], pos - spans[owner, 0] + offsets[owner]

    def packed(pieces: list) -> Iterator[pa.RecordBatch]:
        h, c, doc, place = hashed(pieces)
        if not len(h):
            return
        order = np.lexsort((doc, c, h))
        h, c, doc, place = h[order], c[order], doc[order], place[order]
        head = np.concatenate([[True], (h[1:] != h[:-1]) | (c[1:] != c[:-1])])
        least = doc[np.flatnonzero(head)][np.cumsum(head) - 1]
        gone = doc > least
        rows = []
        if gone.any():
            d, s, e = _merged(doc[gone], np.maximum(0, place[gone] - SIDE), place[gone] + MATCH)
            rows.append((-1 - int(d[0] % buckets), len(d), _planes(s, 8), b"", _planes(d, 8), _planes(e, 8)))
        h, c, doc, place = h[~gone], c[~gone], doc[~gone], place[~gone]
        to = ((h >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)  # order by h is order by bucket
        known = np.isin(h >> np.uint64(16), hot)
        if known.any():
            to = np.where(known, np.uint64(buckets) + (c >> np.uint64(8)) % np.uint64(buckets), to)
            order = np.argsort(to, kind="stable")
            h, c, doc, place, to = h[order], c[order], doc[order], place[order], to[order]
        edges = np.concatenate([[0], np.flatnonzero(to[1:] != to[:-1]) + 1, [len(to)]]).tolist() if len(to) else [0]
        for i, j in zip(edges, edges[1:], strict=False):  # only the buckets that have anchors here
            rows.append((int(to[i]), j - i, _planes(h[i:j] >> np.uint64(16), 6), _planes(c[i:j] >> np.uint64(8), 7), _planes(doc[i:j], 8), _planes(place[i:j], 8)))
        kinds = [pa.int32(), pa.int32()] + [pa.binary()] * 4
        yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["bucket", "n", "hs", "contexts", "docs", "places"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, filled = [], 0
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                raw = text.as_py().encode()
                for a in range(0, len(raw) - MATCH + 1, PIECE):
                    b = min(a + PIECE, len(raw) - MATCH + 1)
                    low = max(0, a - SIDE)
                    part = raw[low : b + MATCH + SIDE]
                    pieces.append((doc, part, low, a - low, b - low))
                    filled += len(part)
                    if filled >= BUFFER:
                        yield from packed(pieces)
                        pieces, filled = [], 0
        if pieces:
            yield from packed(pieces)
        pa.default_memory_pool().release_unused()

    rows = docs.filter(F.col("doc_id").isNotNull() & (F.octet_length("text") >= MATCH)).select("doc_id", "text")
    return rows.mapInArrow(run, PACKED)


def settle(packed: DataFrame, buckets: int) -> DataFrame:
    """``kind, doc_id, start, end, h``: kind 0 are repeated spans; kind 1 are contexts (their anchor at ``start``)
    that share an anchor with different ones, kind 2 the different contexts of hot anchors. One bucket is one task's
    work; its size is set by BUCKET_BYTES."""

    def table(kind: int, doc: np.ndarray, start: np.ndarray, end: np.ndarray, h: np.ndarray) -> pa.Table:
        return pa.table({"kind": pa.array(np.full(len(doc), kind, np.int32)), "doc_id": doc.astype(np.int64), "start": start.astype(np.int64), "end": end.astype(np.int64), "h": h.astype(np.int64)})

    def run(t: pa.Table) -> pa.Table:
        get = {n: t.column(n).to_pylist() for n in ("hs", "contexts", "docs", "places")}
        read = lambda n, w: np.concatenate([_unplanes(x, w) for x in get[n]])
        doc, place = read("docs", 8).astype(np.int64), read("places", 8).astype(np.int64)
        if t.column("bucket")[0].as_py() < 0:
            start = read("hs", 8).astype(np.int64)
            return table(0, doc, start, place, np.zeros(len(doc)))
        h, c = read("hs", 6), read("contexts", 7)
        order = np.lexsort((place, doc, c, h))
        h, c, doc, place = h[order], c[order], doc[order], place[order]
        new_h = np.concatenate([[True], h[1:] != h[:-1]])
        head = new_h | np.concatenate([[True], c[1:] != c[:-1]])
        least = doc[np.flatnonzero(head)][np.cumsum(head) - 1]
        gone = doc > least
        group = np.cumsum(new_h, dtype=np.int32) - 1
        classes = np.bincount(group, head)
        hot = t.column("bucket")[0].as_py() >= buckets
        ask = ~gone & (hot | (classes[group] > 1))
        del get, order, c, new_h, head, least, group, classes
        pa.default_memory_pool().release_unused()
        return pa.concat_tables([
            table(0, doc[gone], np.maximum(0, place[gone] - SIDE), place[gone] + MATCH, np.zeros(int(gone.sum()))),
            table(1 + hot, doc[ask], place[ask], place[ask], h[ask]),
        ])

    return packed.groupBy("bucket").applyInArrow(run, "kind int, doc_id long, start long, end long, h long")


def suffix_array(codes: np.ndarray, depth: int) -> np.ndarray:
    """Order of all suffixes by their first ``depth`` symbols or more (Larsson-Sadakane: groups of equal prefixes are
    refined by the group numbers that lie one prefix length on, and only groups with more than one suffix)."""
    n = len(codes)
    padded = np.concatenate([codes.astype(np.int64) + 1, np.zeros(4, np.int64)])
    key = np.zeros(n, np.int64)
    done = 3  # symbols below 2**21 packed into the first key
    for j in range(done):
        key = (key << 21) + padded[j : j + n]
    order = np.argsort(key, kind="stable")
    sorted_key = key[order]
    fresh = np.concatenate([[True], sorted_key[1:] != sorted_key[:-1]])
    slots = np.arange(n)
    rank = np.empty(n + 1, np.int64)
    rank[n] = -1
    rank[order] = np.maximum.accumulate(np.where(fresh, slots, 0))
    at = slots
    while done < depth:
        # slots of groups that are still open
        alone = fresh & np.concatenate([fresh[1:], [True]])
        at, group = at[~alone], order[at[~alone]]
        if not len(at):
            break
        key = rank[group] * (n + 1) + rank[np.minimum(group + done, n)] + 1
        sub = np.argsort(key, kind="stable")
        group, key = group[sub], key[sub]
        order[at] = group
        fresh = np.concatenate([[True], key[1:] != key[:-1]])
        rank[group] = np.maximum.accumulate(np.where(fresh, at, 0))
        done *= 2
    return order


def common_prefixes(codes: np.ndarray, order: np.ndarray, cap: int, step: int = 8) -> np.ndarray:
    """Common prefix, at most ``cap``, of each suffix in ``order`` with the one before it.

    Kasai's rule, that the next position's prefix is at most one shorter, run over all positions that are equal
    modulo ``step`` at once: each class starts from what the class before has found. ``order`` must be the order of
    whole suffixes.
    """
    n = len(codes)
    before = np.full(n, -1, np.int64)
    before[order[1:]] = order[:-1]
    padded = np.concatenate([codes.astype(np.int64), np.full(cap + 1, -1)])
    other = np.concatenate([codes.astype(np.int64), np.full(cap + 1, -2)])
    found = np.zeros(n + 1, np.int64)
    for r in range(min(step, n)):
        i = np.arange(r, n, step)
        length = np.maximum(found[i - 1] - 1, 0) if r else np.zeros(len(i), np.int64)
        j = before[i]
        length[j < 0] = 0
        live = np.flatnonzero(j >= 0)
        while len(live):
            same = (padded[i[live] + length[live]] == other[j[live] + length[live]]) & (length[live] < cap)
            live = live[same]
            length[live] += 1
        found[i] = length
    return found[order]


def shard_windows(contexts: list[bytes], docs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All 50-byte windows of a shard: sorted distinct windows with their smallest id, and for every window start its
    place (in the joined contexts with one gap each) and the number of its distinct window. Each context ends in a
    symbol of its own, so no two suffixes are equal."""
    sizes = np.array([len(c) for c in contexts])
    firsts = np.concatenate([[0], np.cumsum(sizes + 1)])
    owner = np.repeat(np.arange(len(contexts)), sizes + 1)
    body = np.arange(firsts[-1]) - firsts[owner] < sizes[owner]
    codes = 256 + owner
    codes[body] = np.frombuffer(b"".join(contexts), np.uint8)
    order = suffix_array(codes, int(sizes.max()) + 1)
    prefix = common_prefixes(codes, order, MATCH)
    offset = order - firsts[owner[order]]
    valid = offset + MATCH <= sizes[owner[order]]
    starts, same = order[valid], (prefix >= MATCH)[valid]
    head = ~same
    if not len(starts):
        return np.empty(0, f"S{MATCH}"), np.empty(0, np.int64), starts, starts
    head[0] = True
    at = np.flatnonzero(head)
    least = np.minimum.reduceat(docs[owner[starts]], at)
    windows = codes[starts[at][:, None] + np.arange(MATCH)].astype(np.uint8).view(f"S{MATCH}").ravel()
    return windows, least, starts, np.cumsum(head) - 1


def merge(one: tuple[np.ndarray, np.ndarray], two: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Merge two sorted lists of distinct windows by binary search; equal windows take the smaller id."""
    (a, least_a), (b, least_b) = one, two
    if not len(a) or not len(b):
        return two if not len(a) else one
    at = np.searchsorted(a, b)
    hit = (at < len(a)) & (a[np.minimum(at, len(a) - 1)] == b)
    least_a = least_a.copy()
    np.minimum.at(least_a, at[hit], least_b[hit])
    return np.insert(a, at[~hit], b[~hit]), np.insert(least_a, at[~hit], least_b[~hit])


def repeated(contexts: list[bytes], docs: np.ndarray, lows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Spans (id, start, end) of ``contexts`` (at ``lows`` in their documents) that repeat a smaller id's window."""
    sizes = np.cumsum([len(c) + 1 for c in contexts])
    shard = sizes // SHARD
    parts, everything = [], (np.empty(0, f"S{MATCH}"), np.empty(0, np.int64))
    for k in np.unique(shard):
        ids = np.flatnonzero(shard == k)
        part = [contexts[i] for i in ids]
        found = shard_windows(part, docs[ids])
        parts.append((ids, part, found))
        everything = merge(everything, found[:2])
    out = []
    for ids, part, (windows, _, starts, number) in parts:
        if not len(starts):
            continue
        least = everything[1][np.searchsorted(everything[0], windows)][number]
        firsts = np.concatenate([[0], np.cumsum([len(c) + 1 for c in part])])
        owner = np.searchsorted(firsts, starts, "right") - 1
        doc = docs[ids][owner]
        gone = doc > least
        start = (lows[ids][owner] + starts - firsts[owner])[gone]
        out.append(_merged(doc[gone], start, start + MATCH))
    return tuple(np.concatenate([o[i] for o in out]) if out else np.empty(0, np.int64) for i in range(3))


def hot_anchors(docs: DataFrame, total: int, buckets: int) -> np.ndarray:
    """Anchors that a sample shows to be hot, sorted. Results don't depend on which are found, only the load of tasks."""
    share = min(1.0, SAMPLE_BYTES / max(1, total))
    some = docs.sample(share, 7) if share < 1 else docs
    none = np.empty(0, np.uint64)
    asked = settle(pack_anchors(some, max(1, int(buckets * share)), none), 1 << 30).filter("kind = 1")
    found = asked.groupBy("h").agg(F.count("*").alias("n")).filter(F.col("n") > max(min(HOT, 100), int(HOT * share))).select("h").collect()
    return np.sort(np.array([r[0] for r in found], np.uint64))


def pack_windows(contexts: list[tuple[int, int, bytes]], buckets: int) -> Iterator[tuple]:
    """Windows of contexts ``(doc, low, bytes)``, packed by bucket of their digest as ``(shard, n, bytes)``.

    As in ``pack_anchors``, of equal windows only those of the smallest id go on, in shards -1 to -buckets; the others
    leave as finished spans in shards below.
    """
    size = np.array([max(0, len(x) - MATCH + 1) for _, _, x in contexts])
    if not size.sum():
        return
    digests = b"".join(xxhash.xxh3_128_digest(x[i : i + MATCH]) for _, _, x in contexts for i in range(len(x) - MATCH + 1))
    one, two = np.frombuffer(digests, "<u8").reshape(-1, 2).T
    doc = np.repeat(np.array([d for d, _, _ in contexts], np.int64), size)
    start = np.repeat(np.array([at for _, at, _ in contexts], np.int64), size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    doc, start, one, two, gone = _later(doc, start, one, two)
    if gone.any():
        d, s, e = _merged(doc[gone], start[gone], start[gone] + MATCH)
        yield -1 - buckets - int(d[0] % buckets), len(d), np.concatenate([d, s, e]).astype("<i8").tobytes()
    doc, start, one, two = doc[~gone], start[~gone], one[~gone], two[~gone]
    to = (one % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(to, kind="stable")
    doc, start, one, two, to = doc[order], start[order], one[order], two[order], to[order]
    for at in np.split(np.arange(len(to)), np.flatnonzero(np.diff(to)) + 1):
        yield -1 - int(to[at[0]]), len(at), np.concatenate([doc[at], start[at], one[at].view(np.int64), two[at].view(np.int64)]).astype("<i8").tobytes()


def _later(doc: np.ndarray, start: np.ndarray, one: np.ndarray, two: np.ndarray) -> tuple[np.ndarray, ...]:
    """The windows in the order of their digests, with whether a smaller id has the same."""
    order = np.lexsort((start, doc, two, one))
    doc, start, one, two = doc[order], start[order], one[order], two[order]
    head = np.concatenate([[True], (one[1:] != one[:-1]) | (two[1:] != two[:-1])])
    return doc, start, one, two, doc > doc[np.flatnonzero(head)][np.cumsum(head) - 1]


def deal(docs: DataFrame, asked: DataFrame) -> DataFrame:
    """``shard, doc_id, low, context, n``: contexts dealt to shards by anchor; those of hot anchors as windows that are
    packed in ``context`` and dealt to negative shards by their digest. ``n`` is the number of contexts or windows."""
    busy = materialize(asked.filter("kind = 1").groupBy("h").agg(F.count("*").alias("n")).filter(F.col("n") > HOT).select("h", F.lit(True).alias("busy")))
    asked = asked.join(F.broadcast(busy), "h", "left").select("doc_id", "start", "h", ((F.col("kind") == 2) | F.col("busy").isNotNull()).alias("hot"))
    every, hot = asked.agg(F.count("*"), F.count_if("hot")).first()
    shards = max(1, -(-(every - hot) // BUCKET_CONTEXTS))
    buckets = max(1, -(-hot * (SIDE + 1) // BUCKET_WINDOWS))
    wanted = asked.groupBy("doc_id").agg(F.collect_list(F.struct("start", "h", "hot")).alias("asked"))  # a document's own anchors
    names, kinds = ["shard", "doc_id", "low", "context", "n"], [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64()]

    def batch_of(rows: list) -> pa.RecordBatch:
        columns = zip(*rows, strict=True) if rows else [[]] * 5
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[tuple[int, int, bytes]] = []
        packed = lambda: batch_of([(shard, None, None, data, n) for shard, n, data in pack_windows(waiting, buckets)])
        for batch in batches:
            for k in range(0, batch.num_rows, 512):
                part = batch.slice(k, 512)
                rows = []
                for doc, text, asked in zip(*(part.column(i).to_pylist() for i in range(3)), strict=True):
                    raw = (text or "").encode()
                    for x in asked:
                        low = max(0, x["start"] - SIDE)
                        context = raw[low : x["start"] + MATCH]
                        if not x["hot"]:
                            rows.append((x["h"] % shards, doc, low, context, 1))
                            continue
                        waiting.append((doc, low, context))
                        if len(waiting) >= HASHED:
                            yield packed()
                            waiting.clear()
                yield batch_of(rows)
        if waiting:
            yield packed()

    return docs.select("doc_id", "text").join(wanted, "doc_id").mapInArrow(cut, "shard long, doc_id long, low long, context binary, n long")


def border_spans(docs: DataFrame, asked: DataFrame) -> DataFrame:
    """``doc_id, start, end`` of the repeats among contexts that share an anchor but are not equal."""

    def sort(t: pa.Table) -> pa.Table:
        contexts = t.column("context").to_pylist()
        if t.column("shard")[0].as_py() >= 0:
            doc, start, end = repeated(contexts, t.column("doc_id").to_numpy(), t.column("low").to_numpy())
        else:
            parts = [np.frombuffer(x, "<i8").reshape(-1, n) for x, n in zip(contexts, t.column("n").to_pylist(), strict=True)]
            if len(parts[0]) == 3:
                doc, start, end = np.concatenate(parts, axis=1)
            else:
                doc, start, _, _, gone = _later(*np.concatenate(parts, axis=1))
                doc, start, end = _merged(doc[gone], start[gone], start[gone] + MATCH)
        return pa.table({"doc_id": doc.astype(np.int64), "start": start.astype(np.int64), "end": end.astype(np.int64)})

    return deal(docs, asked).groupBy("shard").applyInArrow(sort, "doc_id long, start long, end long")


def remove(docs: DataFrame, keep_text: bool = False) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` (and with ``keep_text`` the kept ``bytes``) of every row.

    Null text is empty; texts under 50 bytes lose nothing and take nothing from others. Equal ids are one document:
    they take nothing from each other, and repeated rows lose the same. Rows with a null id are left whole. Very long
    texts are hashed in pieces. An empty table gives an empty table.
    """
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = int(total // BUCKET_BYTES + 1)
    found = materialize(settle(pack_anchors(docs, buckets, hot_anchors(docs, total, buckets)), buckets))
    inside = found.filter("kind = 0").select("doc_id", "start", "end")
    borders = materialize(border_spans(docs, found.filter("kind > 0").select("kind", "doc_id", "start", "h")))
    spans = inside.union(borders).groupBy("doc_id").agg(F.collect_list("start").alias("starts"), F.collect_list("end").alias("ends"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 512):
                part = batch.slice(k, 512)
                rows = []
                for doc, text, starts, ends in zip(*(part.column(i).to_pylist() for i in range(4)), strict=True):
                    raw = (text or "").encode()
                    left, at, removed, n = [], 0, 0, 0
                    if starts:
                        start, end = np.array(starts), np.minimum(ends, len(raw))
                        order = np.lexsort((end, start))
                        start, end = start[order], np.maximum.accumulate(end[order])
                        fresh = np.flatnonzero(np.concatenate([[True], start[1:] > end[:-1]]))
                        for s, e in zip(start[fresh].tolist(), end[np.concatenate([fresh[1:] - 1, [len(end) - 1]])].tolist(), strict=True):
                            left.append(raw[at:s])
                            at, removed, n = e, removed + e - s, n + 1
                    left.append(raw[at:])
                    kept = b"".join(left)
                    rows.append((doc, len(raw), removed, n, hashlib.sha256(kept).hexdigest(), *([kept] if keep_text else [])))
                kinds = [pa.int64()] * 4 + [pa.string()] + [pa.binary()] * keep_text
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"] + ["bytes"] * keep_text
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", bytes binary" * keep_text
    return docs.select("doc_id", "text").join(spans, "doc_id", "left").mapInArrow(run, schema)


def op10_suffixdedup(spark, sf_dir: str) -> DataFrame:
    return remove(documents(spark, sf_dir))

"""Best-fit packing: repeat counts of few-document length patterns, fitted to the histogram of lengths."""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sigmill.llm.common import documents, materialize

WINDOW = 2048
END_ID = 0
#: Bytes of text that are encoded together, and chunks of text that a worker remembers the ids of.
BYTES, KNOWN = 8 << 20, 400_000
#: Rounds of new patterns, and gradient steps in each.
ROUNDS, STEPS = 24, 120
#: Documents of a pattern at most.
MEMBERS = 3
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, nth long"
PLACED = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"

# ---- ids ---------------------------------------------------------------------------------------------------------

# Kinds of bytes: letters, digits, punctuation, apostrophe, blank, other white space; 0 for all beyond ASCII.
KIND = np.zeros(256, np.uint8)
for _b in range(33, 127):
    KIND[_b] = 1 if chr(_b).isalpha() else 2 if chr(_b).isdigit() else 4 if chr(_b) == "'" else 3
KIND[[9, 10, 11, 12, 13]], KIND[32] = 6, 5
#: Whether a text may be taken apart between bytes of two kinds: the tokenizer's own words never reach across.
APART = np.zeros((7, 7), bool)
APART[1, 2:5] = APART[2, [1, 3, 4]] = APART[3, 1:3] = APART[6, :5] = True
# White space beyond ASCII and control characters, and the added token, all of which look further than a byte.
FAR = "[\x1c-\x1f\u0085\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]|<\\|endoftext\\|>"


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@lru_cache(1)
def tokenizer(path: str):
    """One tokenizer a worker: the file's tables, nothing that grows with the texts."""
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def chunk_bounds(data: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Where the bytes of texts, which end at ``ends``, may be taken apart without changing their ids.

    Between letters, digits and punctuation; before the last white space of a run, which belongs to the word behind it
    if it is a blank; and where a run of white space begins.
    """
    kind = KIND[data]
    cut = np.zeros(len(data) + 1, bool)
    if len(data):
        cut[1:-1] = APART[kind[:-1], kind[1:]]
        space = kind >= 5
        inside = np.ones(len(data) + 1, bool)  # whether the byte before belongs to the same text
        inside[ends], inside[0] = False, False
        before, behind = np.concatenate([[False], space[:-1]]) & inside[:-1], np.append(space[1:], True) | ~inside[1:]
        cut[:-1] |= space & ~(before & behind)
    cut[ends] = True
    cut[0] = True
    return np.flatnonzero(cut)


def chunk_ids(path: str, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all chunks in one array, and how many each has. A run of Latin letters, with or without a blank before it, is
    one word to the tokenizer and goes to its merges directly; the others take the whole way."""
    encoder = tokenizer(path)
    merge, found, rest = encoder.model.tokenize, [[]] * len(chunks), []
    mapped = byte_letters()
    for i, c in enumerate(chunks):
        word = c[1:] if c[0] == " " else c
        if word.isascii():
            if word.isalpha():
                found[i] = [t.id for t in merge("Ġ" + word if c[0] == " " else word)]
            else:
                rest.append(i)
        elif word.isalpha() and max(word) < "ɐ":
            word = word.encode().decode("latin-1").translate(mapped)
            found[i] = [t.id for t in merge("Ġ" + word if c[0] == " " else word)]
        else:
            rest.append(i)
    for at in (rest[k : k + 4096] for k in range(0, len(rest), 4096)):
        for i, e in zip(at, encoder.encode_batch_fast([chunks[i] for i in at], add_special_tokens=False), strict=True):
            found[i] = e.ids
    sizes = np.fromiter(map(len, found), np.int64, len(found))
    return np.fromiter(chain.from_iterable(found), np.uint32, int(sizes.sum())), sizes


class Known:
    """Chunks whose ids a worker has worked out, KNOWN at most; more are worked out each time."""

    def __init__(self):
        self.chunks, self.ids, self.first, self.sizes = pa.array([], pa.large_binary()), np.empty(0, np.uint32), np.empty(0, np.int64), np.empty(0, np.int64)

    def look_up(self, path: str, chunks: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All ids that are needed in one array, and where each chunk's begin and how many they are."""
        at = pc.index_in(chunks, value_set=self.chunks)
        new = np.flatnonzero(at.is_null().to_numpy(zero_copy_only=False))
        at = at.fill_null(0).to_numpy()
        first, sizes = (self.first[at], self.sizes[at]) if len(self.sizes) else (np.zeros(len(at), np.int64), np.zeros(len(at), np.int64))
        fresh = chunks.take(pa.array(new))
        more, many = chunk_ids(path, fresh.cast(pa.large_string()).to_pylist())
        ids = np.concatenate([self.ids, more])
        first[new], sizes[new] = len(self.ids) + np.cumsum(many) - many, many
        room = KNOWN - len(self.chunks)
        if room > 0 and len(new):
            keep = min(room, len(new))
            self.chunks = pa.concat_arrays([self.chunks, fresh.slice(0, keep)])
            self.first, self.sizes = np.append(self.first, first[new[:keep]]), np.append(self.sizes, many[:keep])
            self.ids = ids[: len(self.ids) + int(many[:keep].sum())]
        return ids, first, sizes


@lru_cache(1)
def known(path: str) -> Known:
    return Known()


@lru_cache(1)
def byte_letters() -> dict[int, str]:
    """The letter that byte-level vocabularies write for each byte: itself where it can be seen, else the next one from 256 on."""
    seen = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(seen)]
    return {b: chr(b) for b in seen} | {b: chr(256 + k) for k, b in enumerate(hidden)}


def encode(path: str, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts in one array, each text's followed by the end id, and where each one's begin and end.

    Texts are taken apart where the tokenizer's words never reach across, and only the distinct chunks of a call are
    encoded. A text with white space beyond ASCII, or with the name of the added token, is encoded whole.
    """
    texts = texts.cast(pa.large_string())
    whole = np.flatnonzero(pc.match_substring_regex(texts, FAR).to_numpy(zero_copy_only=False))
    easy = pc.if_else(pa.array(np.isin(np.arange(len(texts)), whole)), "", texts) if len(whole) else texts
    offsets = np.frombuffer(easy.buffers()[1], np.int64)[easy.offset : easy.offset + len(easy) + 1]
    data = np.frombuffer(easy.buffers()[2], np.uint8)[offsets[0] : offsets[-1]] if offsets[-1] > offsets[0] else np.empty(0, np.uint8)
    ends = offsets[1:] - offsets[0]
    at = chunk_bounds(data, ends)
    cut = pa.Array.from_buffers(pa.large_binary(), len(at) - 1, [None, pa.py_buffer(at.astype(np.int64)), pa.py_buffer(data)]).dictionary_encode()
    word = cut.indices.to_numpy()
    ids, first, sizes = known(path).look_up(path, cut.dictionary)
    # behind the chunks' numbers come the end id and the texts that are encoded whole
    far = [e.ids for e in tokenizer(path).encode_batch_fast(texts.take(pa.array(whole)).to_pylist(), add_special_tokens=False)] if len(whole) else []
    more = np.array([1, *map(len, far)], np.int64)
    first, sizes = np.concatenate([first, len(ids) + np.cumsum(more) - more]), np.concatenate([sizes, more])
    ids = np.concatenate([ids, np.array([END_ID], np.uint32), np.fromiter(chain.from_iterable(far), np.uint32)])
    last = np.searchsorted(at, ends, "left")
    end = len(cut.dictionary)
    places, which = last, np.full(len(ends), end)
    if len(whole):
        places, which = np.insert(last, whole, last[whole]), np.insert(which, whole, end + 1 + np.arange(len(whole)))
    word = np.insert(word.astype(np.int32), places, which)
    lengths = sizes[word]
    total = np.cumsum(lengths)
    out = ids[np.repeat(first[word] - total + lengths, lengths) + np.arange(total[-1] if len(total) else 0)]
    return out, np.concatenate([[0], total[word == end]]).astype(np.int64)


def cut_documents(docs: DataFrame, path: str, window: int = WINDOW) -> DataFrame:
    """Pieces of every document, see ``PIECES``: whole, or full windows behind a first piece that takes the rest.

    A piece has its task's number and its place among the task's pieces of the same length, so that places among all
    pieces of a length follow from counts alone. One pass where the texts are read; nothing is shuffled.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seen = TaskContext.get().partitionId(), np.zeros(window + 1, np.int64)
        for batch in batches:
            text = pc.fill_null(batch.column(1), "")
            size = np.cumsum(pc.binary_length(text).to_numpy().astype(np.int64))
            at = 0
            while at < len(text):  # rows of about BYTES
                to = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + BYTES, "right")))
                ids, bounds = encode(path, text.slice(at, to - at))
                whole = np.diff(bounds)
                count = -(-whole // window)  # no text is empty: the end id is there
                owner = np.repeat(np.arange(to - at), count)
                piece = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
                opening = (whole - 1) % window + 1
                start = np.where(piece == 0, 0, opening[owner] + (piece - 1) * window)
                length = np.where(piece == 0, opening[owner], window)
                # the pieces of a length are numbered on from those that the task had before
                order = np.argsort(length, kind="stable")
                of = length[order]
                fresh = np.flatnonzero(np.append(True, of[1:] != of[:-1]))
                nth = np.empty(len(length), np.int64)
                nth[order] = np.arange(len(of)) - np.repeat(fresh, np.diff(np.append(fresh, len(of)))) + seen[of]
                seen += np.bincount(length, minlength=window + 1)
                raw = memoryview(np.ascontiguousarray(ids, "<u4")).cast("B")
                low = 4 * (bounds[owner] + start)
                crc = [zlib.crc32(raw[a:b]) for a, b in zip(low.tolist(), (low + 4 * length).tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(at, to - at).take(pa.array(owner)).cast(pa.int64()), pa.array(piece, pa.int32()), pa.array(start, pa.int64()),
                     pa.array(length, pa.int64()), pa.array(crc, pa.int64()), pa.array(np.full(len(owner), part), pa.int32()), pa.array(nth, pa.int64())],
                    ["doc_id", "piece", "start", "length", "ids_crc32", "part", "nth"],
                )
                at = to
        pa.default_memory_pool().release_unused()

    return docs.select("doc_id", "text").mapInArrow(run, PIECES)


# ---- the plan: bounded by the window, whatever the number of documents -------------------------------------------


def _best_sums(gain: np.ndarray, members: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """For 1, 2, ... ``members`` lengths, the largest sum of gains of so many lengths with each total, and one of those lengths."""
    n = len(gain)
    sums, picks = [gain], [np.arange(n)]
    shifted = np.arange(n)[:, None] - np.arange(n)[None, :]  # total - length
    usable = (shifted > 0) & np.isfinite(gain)[None, :]
    for _ in range(members - 1):
        table = np.where(usable, sums[-1][np.maximum(shifted, 0)] + gain[None, :], -np.inf)
        picks.append(table.argmax(1))
        sums.append(table[np.arange(n), picks[-1]])
    return sums, picks


def new_patterns(gain: np.ndarray, known: set[tuple]) -> list[tuple]:
    """For every length that occurs, the pattern of at most MEMBERS documents that holds it, fills the window exactly and
    gains most. All patterns are looked at, by sums of one length more at a time, none is written down but the best."""
    window = len(gain) - 1
    sums, picks = _best_sums(gain, MEMBERS - 1)
    found = set()
    for n in np.flatnonzero(np.isfinite(gain)):
        n = int(n)
        options = [(gain[n], 0)] if n == window else [(gain[n] + s[window - n], k + 1) for k, s in enumerate(sums)]
        best, k = max(options)
        if best <= 1e-9:
            continue
        pattern, left = [n], window - n
        for j in range(k - 1, -1, -1):
            pattern.append(int(picks[j][left]))
            left -= pattern[-1]
        found.add(tuple(sorted(pattern, reverse=True)))
    return sorted(found - known)


def fit(histogram: np.ndarray) -> list[tuple[tuple, float]]:
    """Repeat counts >= 0 of exactly filling patterns by least squares against the histogram, longer lengths weighing more.

    Non-negative least squares with patterns brought in as the residual asks for them: rounds of pricing, each followed by
    projected gradient steps with momentum on the patterns known so far.
    """
    window = len(histogram) - 1
    square = np.arange(window + 1) / window + 0.05  # weight of a squared residual
    used = histogram > 0
    known: dict[tuple, float] = {}
    members = np.zeros((0, MEMBERS), np.int64)
    x = np.zeros(0)
    forward = lambda v, m: np.bincount(m.ravel(), np.repeat(v, MEMBERS), window + 1)
    for _ in range(ROUNDS):
        residual = histogram - forward(x, members) if len(x) else histogram.astype(float)
        residual[0] = 0.0
        gain = np.where(used, square * residual, -np.inf)
        fresh = new_patterns(gain, set(known))
        if not fresh:
            break
        rows = np.zeros((len(fresh), MEMBERS), np.int64)
        for i, p in enumerate(fresh):
            rows[i, : len(p)] = p
        members, x = np.concatenate([members, rows]), np.concatenate([x, np.zeros(len(fresh))])
        scaled = np.append(0.0, square[1:])
        v = np.ones(len(x))
        for _ in range(12):  # largest curvature, by powers
            v = scaled[members] * forward(v, members)[members]
            v = v.sum(1)
            top = np.linalg.norm(v)
            v /= top
        step, y, t = 1 / (1.05 * top), x, 1.0
        for _ in range(STEPS):
            off = histogram - forward(y, members)
            new = np.maximum(0.0, y + step * (scaled * off)[members].sum(1))
            if ((new - x) * (y - new)).sum() > 0:  # momentum points uphill: begin again
                t = 1.0
            after = (1 + (1 + 4 * t * t) ** 0.5) / 2
            y, x, t = new + (t - 1) / after * (new - x), new, after
        keep = x > 1e-6
        members, x = members[keep], x[keep]
        known = {tuple(int(m) for m in row if m): float(v) for row, v in zip(members, x, strict=True)}
    return sorted(known.items(), key=lambda p: (-p[1], p[0]))


def best_fit(counts: np.ndarray) -> list[tuple[tuple, int]]:
    """Best-fit decreasing on counts: all pieces of a length go at once, each to the fullest sequence that takes it.

    Sequences with the same pieces are one entry with a count, so the work depends on the window, not on the pieces.
    """
    window = len(counts) - 1
    rooms: dict[int, list[list]] = {}  # room left -> [pattern, count]
    for n in range(window, 0, -1):
        left, room = int(counts[n]), n
        while left:
            while room <= window and not rooms.get(room):
                room += 1
            if room > window:
                each = window // n
                whole, rest = divmod(left, each)
                for k, c in ((each, whole), (rest, 1)):
                    if k and c:
                        rooms.setdefault(window - k * n, []).append([(n,) * k, c])
                break
            pattern, c = rooms[room].pop()
            each = min(room // n, left)
            take = min(c, left // each)
            left -= take * each
            if c > take:
                rooms[room].append([pattern, c - take])
            rooms.setdefault(room - each * n, []).append([pattern + (n,) * each, take])
    return [(tuple(p), c) for entries in rooms.values() for p, c in entries]


def plan(histogram: np.ndarray) -> list[tuple[tuple, int]]:
    """Patterns with whole repeat counts that use every piece of the histogram exactly once.

    Fitted counts are rounded down, then up by the largest fraction, as long as pieces are there; what remains is packed
    best-fit. A pattern of the fit has no room left.
    """
    left = histogram.astype(np.int64).copy()
    done: Counter = Counter()
    fitted = fit(left)
    for share in (np.floor, lambda v: 1.0):
        for pattern, v in fitted if share is np.floor else sorted(fitted, key=lambda p: (-(p[1] % 1), p[0])):
            need = Counter(pattern)
            n = min(int(share(v)), *(left[m] // c for m, c in need.items()))
            if n > 0:
                done[pattern] += int(n)
                for m, c in need.items():
                    left[m] -= n * c
    for pattern, n in best_fit(left):
        done[tuple(sorted(pattern, reverse=True))] += n
    return sorted(done.items(), key=lambda p: (-p[1], p[0]))


def slots(planned: list[tuple[tuple, int]], window: int) -> dict[str, np.ndarray]:
    """Where the pieces of each length go, by their place among all pieces of that length: one entry for each pattern and
    length in it, in the order of ``key`` = length * 2**40 + first place."""
    rows, taken, sequence = [], [0] * (window + 1), 0
    for pattern, n in planned:
        offset = 0
        for length, copies in sorted(Counter(pattern).items(), reverse=True):
            rows.append(((length << 40) + taken[length], copies, sequence, offset))
            taken[length] += copies * n
            offset += copies * length
        sequence += n
    found = np.array(sorted(rows), np.int64).reshape(-1, 4)
    return dict(zip(("key", "copies", "sequence", "offset"), found.T.copy(), strict=True))


def pack_patterns(docs: DataFrame, path: str | None = None, window: int = WINDOW) -> DataFrame:
    """Pieces of all documents in sequences of at most ``window`` tokens; see ``PLACED``.

    Only documents longer than the window are cut. Spark encodes and counts: the histogram of piece lengths, at most
    ``window`` numbers, is all that the driver gets, and the plan that it makes of it is bounded by the window too.
    A piece's place among all of its length is its place in its task plus the counts of the tasks before; the plan
    says where that place lies. No text is shuffled, pieces are once, by task and length, so that a length that most
    documents have is dealt over all tasks. Null text counts as empty and is its end token; repeated rows are packed as
    often as they occur, a null id stays null; other columns are ignored; an empty table gives no rows.
    """
    cut = materialize(cut_documents(docs, path or tokenizer_path(), window))
    counts = cut.groupBy("part", "length").agg(F.count("*").alias("n"))
    histogram = np.zeros(window + 1, np.int64)
    for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect():  # a row for each length at most
        histogram[r["length"]] = r["n"]
    goal = slots(plan(histogram), window)
    earlier = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select("part", "length", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            at = np.searchsorted(goal["key"], (length << 40) + rank, "right") - 1
            nth = rank - (goal["key"][at] & ((1 << 40) - 1))
            sequence, offset = goal["sequence"][at] + nth // goal["copies"][at], goal["offset"][at] + nth % goal["copies"][at] * length
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(sequence), pa.array(offset)], ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    ranked = cut.join(before, ["part", "length"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("nth")).alias("rank"))
    return ranked.mapInArrow(place, PLACED)


def op13_bestfit(spark, sf_dir: str) -> DataFrame:
    return pack_patterns(documents(spark, sf_dir))

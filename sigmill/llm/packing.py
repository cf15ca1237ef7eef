"""Packing token sequences of several context sizes."""

from __future__ import annotations

import zlib
from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame

from sigmill.llm.common import documents

#: Context sizes, longest first. A document goes to the smallest of which it fills a quarter at most, the longer ones
#: to the longest.
TIERS = (4096, 2048, 1024, 512)
SHARE = 4
END_ID = 2
#: Punctuation that may be cut off behind an ASCII letter.
TRAILING = ".,!?;:*%$#&"
#: Bytes of text that are encoded together, and pieces that wait for a window to fit.
BYTES, WAITING = 6 << 20, 512
# Letters that stay one letter each when they are composed and put in lower case.
LETTERS = "a-zÀ-ÖØ-öø-įı-ɏα-ωА-яぁ-ゖァ-ヺ一-鿿가-힣"
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, tier int, step_group long"


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@lru_cache(1)
def tokenizer(path: str):
    """One tokenizer a worker: the file's tables, nothing that grows with the texts."""
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def stem_ids(path: str, stems: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids of all stems in one array, and where each one's begin and end.

    A stem of letters is one word to the tokenizer, so many of them go through it as one text, whose word numbers
    tell them apart; the others are encoded one by one.
    """
    encoder = tokenizer(path)
    plain = pc.match_substring_regex(stems, f"^[{LETTERS}]+$").to_numpy(zero_copy_only=False)
    sizes = np.zeros(len(stems), np.int64)
    found, order = [], []
    for at in np.array_split(np.flatnonzero(plain), -(-int(plain.sum()) // 20_000) or 1):
        got = encoder.encode("\n".join(stems.take(pa.array(at)).to_pylist()), add_special_tokens=False)
        sizes[at] = np.bincount(np.array(got.word_ids, np.int64), minlength=len(at))
        found.append(np.array(got.ids, np.uint32))
        order.append(at)
    other = np.flatnonzero(~plain)
    for at in (other[k : k + 4096] for k in range(0, len(other), 4096)):
        got = [e.ids for e in encoder.encode_batch_fast(stems.take(pa.array(at)).to_pylist(), add_special_tokens=False)]
        sizes[at] = [len(x) for x in got]
        found.append(np.fromiter(chain.from_iterable(got), np.uint32))
        order.append(at)
    at = np.concatenate(order)
    last = np.empty(len(stems), np.int64)
    last[at] = np.cumsum(sizes[at])
    return np.concatenate(found), last - sizes, last


def encode(path: str, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts in one array, each text's followed by the end id, and where each one's begin and end.

    The tokenizer drops white space, folds case and never merges letters with punctuation, so a text is taken apart at
    ASCII white space, and a word into a stem and the plain punctuation behind its last ASCII letter. Only the distinct
    stems of a call reach the tokenizer; texts are put together from them by array operations. Nothing is remembered
    from call to call, so memory follows the bytes of a call.
    """
    lists = pc.ascii_split_whitespace(pc.ascii_trim_whitespace(texts.cast(pa.large_string())))
    words = lists.flatten()
    counts = np.diff(lists.offsets.to_numpy())
    real = pc.not_equal(words, "")  # an empty text is one empty word
    owner = np.repeat(np.arange(len(counts)), counts)[real.to_numpy(zero_copy_only=False)]
    coded = words.filter(real).dictionary_encode()
    chunks, word = coded.dictionary, coded.indices.to_numpy()
    low = pc.ascii_lower(chunks)
    cut = pc.ascii_rtrim(low, TRAILING)
    head = pc.if_else(pc.match_substring_regex(cut, "[a-z]$"), cut, low)
    left = (pc.binary_length(low).to_numpy() - pc.binary_length(head).to_numpy()).astype(np.int64)
    some = np.flatnonzero(left)
    tails = pa.array([c[-n:] for c, n in zip(low.take(pa.array(some)).to_pylist(), left[some].tolist(), strict=True)], pa.large_string())
    stems = pa.chunked_array([head, tails]).combine_chunks().dictionary_encode()
    ids, first, last = stem_ids(path, stems.dictionary)
    # every word is its head's number and its tail's; behind the stems' numbers come the end id and nothing at all
    end, none = len(first), len(first) + 1
    first, last = np.append(first, [len(ids), 0]), np.append(last, [len(ids) + 1, 0])
    ids = np.append(ids, np.uint32(END_ID))
    number = stems.indices.to_numpy()
    parts = np.full((len(chunks), 2), none, np.int64)
    parts[:, 0] = number[: len(chunks)]
    parts[some, 1] = number[len(chunks) :]
    sequence = np.insert(parts[word].ravel(), 2 * np.searchsorted(owner, np.arange(len(counts)), "right"), end)
    sizes = (last - first)[sequence]
    total = np.cumsum(sizes)
    out = ids[np.repeat(first[sequence] - total + sizes, sizes) + np.arange(total[-1] if len(total) else 0)]
    bounds = np.concatenate([[0], total[np.flatnonzero(sequence == end)]])
    return out, bounds


class Packer:
    """Sequences of one partition.

    A document longer than the longest window is cut into full windows; its rest and every other document wait in the
    pool of their tier. When more than WAITING pieces wait, the tier with the most tokens gets a window: its longest
    piece first, then, as soon as one or two waiting pieces fill the gap to the last token, those, and until then the
    longest piece of the tier that fits. A gap that no piece of the tier fits is filled from the shorter tiers. Only
    if nothing fits is a piece cut, the shortest that covers the gap, and its rest waits again. ``finish`` packs what
    waits in the same way; what is too little for a window goes to sequences of powers of two, where no padding is due.
    """

    def __init__(self, first_id: int, group: int):
        self.pool: dict[int, dict[int, list]] = {t: {} for t in TIERS}
        self.lengths: dict[int, list[int]] = {t: [] for t in TIERS}  # of waiting pieces, each once, ascending
        self.tokens = dict.fromkeys(TIERS, 0)
        self.waiting = 0
        self.next_id, self.group, self.rows = first_id, group, []
        self.load, self.members = [0.0] * group, [0] * group

    def add(self, doc: int, ids: np.ndarray) -> None:
        at, n = 0, len(ids)
        while n - at >= TIERS[0]:
            self.emit(TIERS[0], [(doc, at, ids[at : at + TIERS[0]], n)])
            at += TIERS[0]
        if at < n:
            self.wait((doc, at, ids[at:].copy(), n))  # the encoded batch isn't kept for it
        while self.waiting > WAITING and (full := [t for t in TIERS if self.tokens[t] >= t]):
            tier = max(full, key=self.tokens.__getitem__)
            self.window(tier, [t for t in TIERS if t <= tier])

    def wait(self, piece: tuple) -> None:
        n = len(piece[2])
        tier = min((t for t in TIERS if SHARE * n <= t), default=TIERS[0])
        if n not in self.pool[tier]:
            self.pool[tier][n] = []
            insort(self.lengths[tier], n)
        self.pool[tier][n].append(piece)
        self.tokens[tier] += n
        self.waiting += 1

    def take(self, tier: int, n: int) -> tuple:
        same = self.pool[tier][n]
        piece = same.pop()
        if not same:
            del self.pool[tier][n]
            self.lengths[tier].pop(bisect_left(self.lengths[tier], n))
        self.tokens[tier] -= n
        self.waiting -= 1
        return piece

    def exact(self, tiers: list[int], room: int) -> list[tuple[int, int]]:
        """One or two waiting pieces, as (tier, length), that fill ``room`` to the last token."""
        where = lambda n: next((t for t in tiers if n in self.pool[t]), None)
        tier = where(room)
        if tier:
            return [(tier, room)]
        for t in tiers:
            own = self.lengths[t]
            for n in reversed(own[: bisect_right(own, room - 1)]):
                other = where(room - n)
                if other and (2 * n != room or other != t or len(self.pool[t][n]) > 1):
                    return [(t, n), (other, room - n)]
        return []

    def window(self, tier: int, tiers: list[int]) -> None:
        """One sequence of ``tier`` tokens from pieces of ``tiers``, of which at least so many wait."""
        room, pieces = tier, []
        while room:
            if pieces and (found := self.exact(tiers, room)):
                pieces += [self.take(t, n) for t, n in found]
                break
            fits = [(t, own[k - 1]) for t in tiers if (k := bisect_right(own := self.lengths[t], room))]
            if fits:
                pieces.append(self.take(*fits[0]))  # the longest of the tier itself, else of the next shorter one
                room -= len(pieces[-1][2])
                continue
            longer = [(own[bisect_right(own, room)], t) for t in tiers if (own := self.lengths[t]) and own[-1] > room]
            n, t = min(longer)
            doc, at, ids, whole = self.take(t, n)
            pieces.append((doc, at, ids[:room], whole))
            self.wait((doc, at + room, ids[room:], whole))
            break
        self.emit(tier, pieces)

    def emit(self, tier: int, pieces: list) -> None:
        """Write one sequence; it joins the group of its step that has the least attention work so far."""
        offset = 0
        fewest = min(self.members)
        g = min((x, i) for i, x in enumerate(self.load) if self.members[i] == fewest)[1]
        self.load[g] += sum(float(len(p[2])) ** 2 for p in pieces)
        self.members[g] += 1
        for doc, at, ids, n in pieces:
            self.rows.append((doc, at, len(ids), zlib.crc32(np.ascontiguousarray(ids, "<u4")), n, self.next_id, offset, tier, g))
            offset += len(ids)
        self.next_id += 1

    def finish(self) -> None:
        while (total := sum(self.tokens.values())) > 0:
            full = [t for t in TIERS if self.tokens[t] >= t]
            if full:
                tier = max(full, key=self.tokens.__getitem__)
                self.window(tier, [t for t in TIERS if t <= tier])
            else:
                self.window(min(TIERS[0], 1 << (total.bit_length() - 1)), list(TIERS))


def _table(rows: list) -> pa.RecordBatch:
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "tier", "step_group"]
    kinds = [pa.int64()] * 7 + [pa.int32(), pa.int64()]
    columns = list(zip(*rows, strict=True)) if rows else [[]] * 9
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)


def pack(docs: DataFrame, path: str | None = None, step_sequences: int = 8) -> DataFrame:
    """Pieces of all documents in sequences of at most 4096 tokens; see ``SCHEMA``.

    Every partition of the input is packed where it is read: nothing is shuffled, and since pieces may be cut, the
    packing of a partition loses nothing against a global one. A task holds the ids of about BYTES of text, or of one
    longer text, and the pieces that wait. Sequence numbers are the partition's number times
    2**33 plus a count. ``step_group`` is the place of a sequence among ``step_sequences`` groups of equal counts,
    dealt so that the sums of squared piece lengths stay even. Null text counts as empty: its only token is the end
    token. Repeated rows are packed as often as they occur and rows with a null id with that id; a text of any length is
    cut into full windows and one rest; an empty table gives no rows.
    """
    path = path or tokenizer_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = Packer(TaskContext.get().partitionId() << 33, step_sequences)
        for batch in batches:
            text = pc.fill_null(batch.column(1), "")
            ends = np.cumsum(pc.binary_length(text).to_numpy().astype(np.int64))
            at = 0
            while at < len(text):  # rows of about BYTES
                to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + BYTES, "right")))
                ids, bounds = encode(path, text.slice(at, to - at))
                for i, doc in enumerate(batch.column(0).slice(at, to - at).to_pylist()):
                    packer.add(doc, ids[bounds[i] : bounds[i + 1]])
                yield _table(packer.rows)
                packer.rows, at = [], to
        packer.finish()
        yield _table(packer.rows)
        pa.default_memory_pool().release_unused()

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA)


def op7_packing(spark, sf_dir: str) -> DataFrame:
    return pack(documents(spark, sf_dir))

"""Periodic runs of words, found on a grammar: Re-Pair rules of a batch of texts, runs across each rule's boundary, merging."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from sigmill.llm.common import documents

#: A run has this many periods at least, and this many words.
PERIODS, WORDS = 4, 6
#: Bytes of text whose grammar is built together, candidates that are looked at together, and words compared at a time.
BYTES, CANDIDATES, CELLS = 6 << 20, 1 << 20, 1 << 21
GRAM = 4
SCHEMA = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"


def edited_words(doc: int | None, words: list[bytes]) -> list[bytes]:
    """The words of a document, of which every tenth, by the checksum of its id, is made periodic from some word on; a null id is never one."""
    n = len(words)
    h = zlib.crc32(str(doc).encode()) if doc is not None else 1
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a : a + p] * -(-(n - a) // p))[: n - a]


class Grammar:
    """Rules of a batch: ``lo, cut, hi`` of one derivation of each (words lo to hi, parted at cut), and all derivations as ``rule, at``."""

    def __init__(self, x: np.ndarray, doc: np.ndarray):
        """Re-Pair of all texts ``x`` (word numbers, of texts ``doc``) together; no pair reaches from one text into the next.

        The most frequent pair of all is replaced wherever it occurs, and in the same round every pair that is more
        frequent than the pairs that it overlaps. Pairs of one occurrence stay so and are never looked at again.
        What is left of a text in the end is put together by halves.
        """
        n = len(x)
        symbol, stop, removed = np.append(x.astype(np.int64), -1), np.arange(1, n + 2), np.zeros(n + 1, bool)
        # symbols stand at their first word; each knows the one before and behind, n where the text begins and ends
        behind, before = np.arange(1, n + 2), np.arange(-1, n)
        edge = np.flatnonzero(doc[1:] != doc[:-1]) if n else np.empty(0, np.int64)
        behind[edge], before[edge + 1] = n, n
        behind[n - 1 :], before[0] = n, n
        nodes, uses, rules = [], [], 0
        next_symbol = int(x.max(initial=-1)) + 1
        rank = np.zeros(n + 1, np.int64)
        live = np.flatnonzero(behind[:n] < n)
        while len(live):
            key = (symbol[live] << 32) | symbol[behind[live]]
            order = np.argsort(key)
            ordered = key[order]
            pair = np.empty(len(live), np.int64)
            pair[order] = np.cumsum(np.append(False, ordered[1:] != ordered[:-1]))
            count = np.bincount(pair)
            many = np.flatnonzero(count[pair] > 1)
            i, pair = live[many], pair[many]
            if not len(i):
                break
            # rank by count, then by a mixed number, so that neighbours of equal counts are not all alike
            mixed = ((pair.astype(np.uint64) * np.uint64(2654435761)) & np.uint64(0xFFFFFFFF)).astype(np.int64)
            r = (count[pair] << 32) | mixed
            rank[i] = r
            able = (r >= rank[before[i]]) & (r >= rank[behind[i]])
            rank[i] = 0
            # of neighbours of one rank, which are one pair, every second is taken
            linked = np.append(False, able[1:] & able[:-1] & (behind[i[:-1]] == i[1:]) & (r[1:] == r[:-1]))
            begin = np.maximum.accumulate(np.where(able & ~linked, np.arange(len(i)), 0))
            taken = able & ((np.arange(len(i)) - begin) % 2 == 0)
            t, other = i[taken], i[~taken]
            used, first, rule = np.unique(pair[taken], return_index=True, return_inverse=True)
            gone = behind[t]
            nodes.append(np.stack([t, gone, stop[gone]], 1)[first])
            uses.append(np.stack([rules + rule, t], 1))
            symbol[t], stop[t], removed[gone] = next_symbol + rules + rule, stop[gone], True
            behind[t] = behind[gone]
            before[behind[t]] = t
            rules += len(used)
            asked = np.zeros(n + 1, bool)
            for some in (other, t, before[t]):
                asked[some] = True
            live = np.flatnonzero(asked[:n])
            live = live[~removed[live] & (behind[live] < n)]
        at = np.flatnonzero(~removed[:n])
        stop = stop[at]
        # what is left: place j of a text is where blocks of j's lowest bit meet
        owner = doc[at] if len(at) else doc[:0]
        opens = np.flatnonzero(np.append(True, owner[1:] != owner[:-1])) if len(owner) else np.empty(0, np.int64)
        sizes = np.diff(np.append(opens, len(owner)))
        j = np.arange(len(owner)) - np.repeat(opens, sizes)
        top = np.flatnonzero(j)
        low = j[top] & -j[top]
        last = np.minimum(np.repeat(opens + sizes, sizes)[top], top + low) - 1
        nodes.append(np.stack([at[top - low], at[top], stop[last]], 1))
        uses.append(np.stack([rules + np.arange(len(top)), at[top - low]], 1))
        self.lo, self.cut, self.hi = np.concatenate(nodes).T
        self.rule, self.at = np.concatenate(uses).T


def agreeing(x: np.ndarray, a: np.ndarray, b: np.ndarray, most: np.ndarray, step: int) -> np.ndarray:
    """How many words agree from ``a`` and ``b`` on, forward or backward, ``most`` at most."""
    found = np.zeros(len(a), np.int64)
    width, live = 8, np.flatnonzero(most > 0)
    while len(live):
        still = []
        rows = max(1, CELLS // width)
        for part in (live[k : k + rows] for k in range(0, len(live), rows)):
            reach = found[part, None] + np.arange(width)
            inside = reach < most[part, None]
            reach = np.minimum(reach, most[part, None] - 1) * step
            same = (x[a[part, None] + reach] == x[b[part, None] + reach]) & inside
            n = np.where(same.all(1), width, same.argmin(1))
            found[part] += n
            still.append(part[(n == width) & (found[part] < most[part])])
        live = np.concatenate(still)
        width = min(4 * width, 4096)
    return found


def _expand(first: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each i, the numbers first[i], first[i] + 1, ...: which i, and the number."""
    which = np.repeat(np.arange(len(count)), count)
    return which, np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count) + first[which]


def crossing(x: np.ndarray, doc: np.ndarray, lo: np.ndarray, cut: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, ...]:
    """``node, start, end, period`` of the stretches inside each node, across its cut, that are long enough for a run.

    A run has two periods on one side of the cut at least, so the words next to the cut repeat one period away. Candidates
    come from equal words (periods up to 3) or from occurrences of the GRAM words there; they are taken by ascending period,
    and one whose two periods lie in a stretch already found has a shorter period of its own.
    """
    n = len(x)
    node = np.flatnonzero((hi - lo) >= WORDS)
    lo, cut, hi = lo[node], cut[node], hi[node]
    most = np.maximum(1, (hi - lo) // PERIODS)
    # the place and group of every GRAM words that occur again, sorted by group, then place
    mixed = x.astype(np.uint64) + np.uint64(1)
    gram = np.zeros(n, np.uint64)
    if n >= GRAM:
        for k, c in enumerate((0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)):
            gram[: n - GRAM + 1] += mixed[k : n - GRAM + 1 + k] * np.uint64(c)
    order = np.argsort(gram)
    ordered = gram[order]
    same = ordered[1:] == ordered[:-1]
    again = np.append(False, same) | np.append(same, False)
    line = np.sort((np.cumsum(np.append(False, ~same))[again] << 40) | order[again])
    place, group = line & ((1 << 40) - 1), line >> 40
    number = np.full(n + 1, -1, np.int64)
    number[place] = np.arange(len(place))
    out = []

    def equal(i: np.ndarray, a: np.ndarray, b: np.ndarray, size: int, least: np.ndarray, limit: np.ndarray) -> np.ndarray:
        """Which of the nodes have the ``size`` words from a and from b equal, all between least and limit."""
        ok = (a >= least[i]) & (b + size <= limit[i])
        i, a, b = i[ok], a[ok], b[ok]
        for k in range(size):
            hit = x[a + k] == x[b + k]
            i, a, b = i[hit], a[hit], b[hit]
        return i

    def work(i: np.ndarray, q: np.ndarray, right: np.ndarray) -> None:
        """Candidates: node, period, and whether its two periods lie behind the cut. Sorted by node and period."""
        order = np.lexsort((~right, q, i))
        i, q, right = i[order], q[order], right[order]
        while len(i):
            head = np.flatnonzero(np.append(True, i[1:] != i[:-1]))
            size = np.diff(np.append(head, len(i)))
            c, p = i[head], q[head]
            a = np.where(right[head], cut[c], cut[c] - p)
            forth = agreeing(x, a, a + p, hi[c] - p - a, 1)
            back = agreeing(x, a - 1, a - 1 + p, a - lo[c], -1)
            s, e = a - back, a + forth + p
            # a candidate that is no two periods tells nothing of its period: the other side's may lie in a stretch of a shorter
            # one; equal words on both sides of the cut are two periods of 1
            square = (p == 1) | np.where(right[head], (s <= cut[c]) & (cut[c] + 2 * p <= e), (e >= cut[c]) & (cut[c] - 2 * p >= s))
            good = square & (e - s >= np.maximum(WORDS, PERIODS * p)) & (s < cut[c]) & (e > cut[c])
            out.append(np.stack([c[good], s[good], e[good], p[good]], 1))
            tells = np.repeat(forth + back >= p, size) & (np.repeat(square, size) | (q > np.repeat(p, size)))
            s, e = np.repeat(s, size), np.repeat(e, size)
            inside = tells & np.where(right, cut[i] + 2 * q <= e, cut[i] - 2 * q >= s) & (s <= cut[i]) & (e >= cut[i])
            inside[head] = True
            i, q, right = i[~inside], q[~inside], right[~inside]

    short = [(np.empty(0, np.int64), 1, True)]
    every = np.arange(len(node))
    short.append((equal(every, cut - 1, cut, 1, lo, hi), 1, False))
    for p in (2, 3):
        wide = every[most >= p]
        short.append((equal(wide, cut[wide], cut[wide] + p, p, lo, hi), p, True))
        short.append((equal(wide, cut[wide] - 2 * p, cut[wide] - p, p, lo, hi), p, False))
    si = np.concatenate([i for i, _, _ in short])
    sq = np.concatenate([np.full(len(i), p) for i, p, _ in short])
    sr = np.concatenate([np.full(len(i), r) for i, _, r in short])

    wide = np.flatnonzero((most >= GRAM) & (hi - lo >= PERIODS * GRAM))
    ahead = number[cut[wide]]
    behind = number[np.maximum(cut[wide] - GRAM, 0)]
    ahead = np.where(cut[wide] + GRAM <= hi[wide], ahead, -1)
    behind = np.where(cut[wide] - GRAM >= lo[wide], behind, -1)
    base = group << 40
    reach = np.where(ahead >= 0, np.searchsorted(line, base[ahead] + np.minimum(cut[wide] + most[wide], hi[wide]), "right") - ahead - 1, 0) if len(line) else np.zeros(len(wide), np.int64)
    since = np.where(behind >= 0, behind - np.searchsorted(line, base[behind] + np.maximum(cut[wide] - GRAM - most[wide], 0), "left"), 0) if len(line) else np.zeros(len(wide), np.int64)
    total = np.cumsum(reach + since)
    k, at_short = 0, np.argsort(si, kind="stable")
    si, sq, sr = si[at_short], sq[at_short], sr[at_short]
    while k < len(wide):  # nodes whose candidates are few enough together
        to = max(k + 1, int(np.searchsorted(total, (total[k - 1] if k else 0) + CANDIDATES, "right")))
        w, r = _expand(ahead[k:to] + 1, reach[k:to])
        i1, q1 = wide[k:to][w], place[r] - cut[wide[k:to][w]]
        ok = (q1 >= GRAM) & (q1 <= most[i1]) & (cut[i1] + 2 * q1 <= hi[i1])
        i1, q1 = i1[ok], q1[ok]
        ok = gram[cut[i1] + q1 - GRAM] == gram[cut[i1] + 2 * q1 - GRAM]
        i1, q1 = i1[ok], q1[ok]
        w, r = _expand(behind[k:to] - since[k:to], since[k:to])
        i2 = wide[k:to][w]
        q2 = cut[i2] - GRAM - place[r]
        ok = (q2 >= GRAM) & (q2 <= most[i2]) & (cut[i2] - 2 * q2 >= lo[i2])
        i2, q2 = i2[ok], q2[ok]
        ok = gram[cut[i2] - q2] == gram[cut[i2] - 2 * q2]
        i2, q2 = i2[ok], q2[ok]
        mine = slice(*np.searchsorted(si, [0 if k == 0 else wide[k], len(node) if to == len(wide) else wide[to]]))
        work(np.concatenate([si[mine], i1, i2]), np.concatenate([sq[mine], q1, q2]), np.concatenate([sr[mine], np.ones(len(i1), bool), np.zeros(len(i2), bool)]))
        k = to
    if not len(wide):
        work(si, sq, sr)
    c, s, e, p = np.concatenate(out).T if out else np.empty((4, 0), np.int64)
    return node[c], s, e, p


def runs(x: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Rows ``text, start, end, period`` of all runs, by text, start and period; ``x`` are word numbers of texts ``doc`` (ascending).

    Stretches across the cut of a rule are found once, at one of its derivations, and told of all others. Stretches of one
    period that share a period are one run; of equal stretches the smallest period counts.
    """
    if len(x) < WORDS:
        return np.empty((0, 4), np.int64)
    g = Grammar(x, doc)
    node, s, e, p = crossing(x, doc, g.lo, g.cut, g.hi)
    if not len(node):
        return np.empty((0, 4), np.int64)
    # derivations of the rules that have a stretch
    order = np.argsort(g.rule, kind="stable")
    first = np.searchsorted(g.rule[order], node, "left")
    which, at = _expand(first, np.searchsorted(g.rule[order], node, "right") - first)
    shift = g.at[order][at] - g.lo[node[which]]
    s, e, p = s[which] + shift, e[which] + shift, p[which]
    d = doc[s]
    order = np.lexsort((-e, s, p, d))
    d, s, e, p = d[order], s[order], e[order], p[order]
    # the furthest end so far within a text and period, by ends that grow from group to group
    lift = np.cumsum(np.append(0, (d[1:] != d[:-1]) | (p[1:] != p[:-1]))) * (len(x) + 1)
    far = np.maximum.accumulate(e + lift)
    opens = np.flatnonzero(np.append(True, s[1:] + lift[1:] > far[:-1] - p[1:]))
    end = (np.maximum.reduceat(e + lift, opens) - lift[opens]).astype(np.int64)
    d, s, p = d[opens], s[opens], p[opens]
    order = np.lexsort((p, end, s, d))
    d, s, end, p = d[order], s[order], end[order], p[order]
    new = np.append(True, (d[1:] != d[:-1]) | (s[1:] != s[:-1]) | (end[1:] != end[:-1]))
    found = np.stack([d, s, end, p], 1)[new]
    return found[np.lexsort((found[:, 3], found[:, 1], found[:, 0]))]


def describe(ids: list, texts: list[bytes]) -> Iterator[tuple]:
    """Rows of SCHEMA for texts whose grammar is built together."""
    words = [edited_words(i, t.split()) for i, t in zip(ids, texts, strict=True)]
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    flat = pa.array([w for ws in words for w in ws], pa.large_binary()).dictionary_encode()
    found = runs(flat.indices.to_numpy().astype(np.int64), np.repeat(np.arange(len(words)), sizes))
    before = np.cumsum(sizes) - sizes
    bounds = np.searchsorted(found[:, 0], np.arange(len(words) + 1))
    for k, ws in enumerate(words):
        own = found[bounds[k] : bounds[k + 1], 1:] - [before[k], before[k], 0]
        line, best = "", (None,) * 4
        if len(own):
            keep = np.zeros(len(ws) + 1, np.int64)
            np.add.at(keep, own[:, 0] + own[:, 2], 1)
            np.add.at(keep, own[:, 1], -1)
            ws = [ws[i] for i in np.flatnonzero(np.cumsum(keep[:-1]) == 0)]
            line = "".join(f"{s},{e - s},{p}\n" for s, e, p in own.tolist())
            size, s, p = min((s - e, s, p) for s, e, p in own.tolist())
            best = (s, -size, p, 1000 * -size // p)
        yield (ids[k], len(own), *best, sha256(line.encode()).hexdigest(), sha256(b" ".join(ws)).hexdigest())


def find_runs(docs: DataFrame) -> DataFrame:
    """One row per document, see ``SCHEMA``: its runs of repeated words, the greatest, and digests of all runs and of the text without repeats.

    Texts are worked on where they are read, some megabytes at a time, and nothing is shuffled. The runs of a text
    don't depend on the texts beside it. Null and empty texts, and those without words, have no run, four nulls and
    the digests of nothing; a text of any length is one piece; of equally long runs the first, then that of the smallest
    period is the greatest; repeated rows are answered each; a null id is never an edited document; other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64()] * 6 + [pa.string()] * 2
        names = [c.split()[0] for c in SCHEMA.split(", ")]
        for batch in batches:
            text = pc.fill_null(batch.column(1), "").cast(pa.large_binary())
            size = np.cumsum(pc.binary_length(text).to_numpy())
            at = 0
            while at < len(text):
                to = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + BYTES, "right")))
                rows = list(describe(batch.column(0).slice(at, to - at).to_pylist(), text.slice(at, to - at).to_pylist()))
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)
                at = to
        pa.default_memory_pool().release_unused()

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA)


def op12_runs(spark, sf_dir: str) -> DataFrame:
    return find_runs(documents(spark, sf_dir))

"""Near-duplicate detection by min-max hashing."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sigmill.llm.common import documents, materialize
from sigmill.llm.components import components

#: Bands and values in a band. At a similarity of 0.8 a pair shares no band with probability (1 - 0.8**7)**50 = 8e-6.
BANDS, ROWS = 50, 7
#: Word hashes that one task remembers (about 45 MB).
REMEMBER = 250_000
#: Members of a component that are compared in one block, and rows with sets that are brought to one task at a time.
BLOCK, TASK_ROWS = 512, 3000
#: Shingles that a task is sized for: as many as TASK_ROWS sets of 500.
TASK_SHINGLES = 500 * TASK_ROWS
#: Components up to which a bucket's members ask each larger one by itself; with more, they ask the bucket as a whole.
FEW = 4
#: Longer words are not remembered.
LONGEST = 64
_known: dict[bytes, int] = {}

MIX1, MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * MIX1
    x = (x ^ (x >> np.uint64(27))) * MIX2
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None, words: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the runs of ``words`` words; a shorter text is one run; none without words.

    A-Z count as a-z; words are parted by ASCII white space, as ``bytes.split`` does.
    """
    parts = (text or "").encode().lower().split()
    if not parts:
        return np.empty(0, np.uint64)
    new = set(parts).difference(_known)
    if len(_known) + len(new) > REMEMBER:
        _known.clear()
        new = set(parts)
    coded = dict(zip(new, map(xxhash.xxh3_64_intdigest, new), strict=True))
    if len(new) < REMEMBER:  # what a very long text brings isn't remembered
        _known.update((w, x) for w, x in coded.items() if len(w) <= LONGEST)
    h = np.fromiter((coded[w] if w in coded else _known[w] for w in parts), np.uint64, len(parts)) if coded else np.fromiter(map(_known.__getitem__, parts), np.uint64, len(parts))
    k = min(words, len(h))
    n = len(h) - k + 1
    mix = np.full(n, k, np.uint64)
    for i in range(k):
        mix = _mixed(mix * np.uint64(0x9E3779B97F4A7C15) + h[i : i + n])
    return np.unique(mix)


class MinMax:
    """Both ends of every permutation: ``BANDS * ROWS / 2`` multiplications give ``BANDS * ROWS`` values."""

    def __init__(self, bands: int = BANDS, rows: int = ROWS, seed: int = 11):
        if bands * rows % 2:
            raise ValueError("bands * rows must be even")
        rng = np.random.default_rng(seed)
        n = bands * rows // 2
        self.factor = rng.integers(0, 1 << 31, n, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
        self.shift = rng.integers(0, 1 << 32, n, dtype=np.uint32)
        self.bands, self.rows = bands, rows

    def values(self, hashes: np.ndarray) -> np.ndarray:
        low = np.full(len(self.factor), 0xFFFFFFFF, np.uint32)
        high = np.zeros(len(self.factor), np.uint32)
        x = (hashes >> np.uint64(32)).astype(np.uint32) ^ hashes.astype(np.uint32)
        for i in range(0, len(x), 1024):  # blocks that stay in cache
            p = self.factor[:, None] * x[None, i : i + 1024] + self.shift[:, None]
            np.minimum(low, p.min(1), out=low)
            np.maximum(high, p.max(1), out=high)
        return np.concatenate([low, high])

    def keys(self, hashes: np.ndarray) -> np.ndarray:
        """One key per band; the band's number is part of it."""
        v = self.values(hashes).reshape(self.bands, self.rows).astype(np.uint64)
        key = np.arange(self.bands, dtype=np.uint64)
        for j in range(self.rows):
            key = _mixed(key * np.uint64(0x9E3779B97F4A7C15) + v[:, j] + np.uint64(1))
        return key.view(np.int64)


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(a) for a in arrays])]).astype(np.int32)
    flat = np.concatenate(arrays).view(np.int64) if arrays else np.empty(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat, pa.int64()))


def signatures(docs: DataFrame, words: int, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """``doc_id, n_shingles, d1, d2, keys``: size and 128-bit digest of the shingle set and its band keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        family = MinMax(bands, rows)
        for batch in batches:
            for k in range(0, batch.num_rows, 1024):
                part = batch.slice(k, 1024)
                size, one, two, keys = [], [], [], []
                for text in part.column(1).to_pylist():
                    h = shingles(text, words)
                    size.append(len(h))
                    one.append(int(_mixed(h).sum(dtype=np.uint64).view(np.int64)) if len(h) else 0)
                    two.append(int(np.bitwise_xor.reduce(_mixed(h + MIX2)).view(np.int64)) if len(h) else 0)
                    keys.append(family.keys(h) if len(h) else np.empty(0, np.int64))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(size, pa.int64()), pa.array(one, pa.int64()), pa.array(two, pa.int64()), _lists(keys)], ["doc_id", "n_shingles", "d1", "d2", "keys"])
        _known.clear()

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_shingles long, d1 long, d2 long, keys array<long>")


def shingle_sets(docs: DataFrame, words: int) -> DataFrame:
    """``doc_id, shingles`` with the whole set of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 512):
                part = batch.slice(k, 512)
                yield pa.RecordBatch.from_arrays([part.column(0), _lists([shingles(t, words) for t in part.column(1).to_pylist()])], ["doc_id", "shingles"])
        _known.clear()

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, shingles array<long>")


def confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs ``a, b`` whose whole sets meet ``100 * intersection >= percent * union``."""
    one = sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("sa"))
    two = sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("sb"))
    both = F.size(F.array_intersect("sa", "sb"))
    fits = 100 * both >= percent * (F.size("sa") + F.size("sb") - both)
    return pairs.join(one, "a").join(two, "b").filter(fits).select("a", "b")


def block_links(t: pa.Table, percent: int) -> pa.Table:
    """Links between the documents that ask (``asks``) and the members of the same blocks, from their whole sets.

    Only links that join components (``comp``) which nothing in this task has joined before are given out, so they are
    fewer than the components, however many pairs are near.
    """
    flat = t.column("shingles").combine_chunks()
    flat = flat.chunk(0) if isinstance(flat, pa.ChunkedArray) else flat
    at, values = flat.offsets.to_numpy(), flat.values.to_numpy()
    nodes, comp = t.column("node").to_pylist(), t.column("comp").to_pylist()
    parent: dict[int, int] = {}

    def top(c: int) -> int:
        while (up := parent.get(c, c)) != c:
            parent[c] = parent.get(up, up)
            c = up
        return c

    blocks: dict[tuple, tuple[list, list]] = {}
    for i, (asks, units) in enumerate(zip(t.column("asks").to_pylist(), t.column("units").to_pylist(), strict=True)):
        for u in units:
            blocks.setdefault((u["group"], u["block"], u["salt"]), ([], []))[asks].append(i)
    one, two = [], []
    for members, asking in blocks.values():
        if not members or not asking:
            continue
        sizes = at[1:][members] - at[:-1][members]
        joined = np.concatenate([values[at[i] : at[i + 1]] for i in members])
        owner = np.repeat(np.arange(len(members)), sizes)
        order = np.argsort(joined, kind="stable")
        joined, owner = joined[order], owner[order]
        for i in asking:
            own = values[at[i] : at[i + 1]]
            lo, hi = np.searchsorted(joined, own), np.searchsorted(joined, own, "right")
            n = hi - lo
            hits = owner[np.repeat(lo - np.cumsum(n) + n, n) + np.arange(n.sum())]
            both = np.bincount(hits, minlength=len(members))
            for k in np.flatnonzero(100 * both >= percent * (sizes + len(own) - both)):
                x, y = top(comp[i]), top(comp[members[k]])
                if x != y:
                    parent[max(x, y)] = min(x, y)
                    one.append(nodes[i])
                    two.append(nodes[members[k]])
    return pa.table({"a": pa.array(one, pa.int64()), "b": pa.array(two, pa.int64())})


def deal(asks: DataFrame, nodes: DataFrame) -> DataFrame:
    """``task, node, comp, asks, units``: the documents that ask a group (``asks``: node, size, comp, group, n members)
    and the group's members (of ``nodes``), each with its units (group, block, salt).

    A unit has at most about BLOCK members and the askers of one salt, so it is bounded however many ask a group.
    Tasks are as many as the rows and the shingles of all units need.
    """
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    room = F.greatest(F.count("*") / TASK_ROWS, F.sum("size") / TASK_SHINGLES)
    wanted = materialize(asks.groupBy("group", "n").agg(F.ceil(room).cast("int").alias("salts")))
    each = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    # written at once: nothing above the join needs a group's rows together, so that Spark can split a large group
    found = materialize(nodes.join(wanted, "group"))
    members = found.select("node", "size", "comp", F.lit(0).alias("asks"), "group", F.pmod(F.xxhash64("node"), blocks).cast("int").alias("block"), each(F.col("salts")).alias("salt"))
    salted = asks.join(wanted.filter("salts > 1").select("group", "salts"), "group", "left").withColumn("salt", F.pmod(F.xxhash64("node", F.lit("salt")), F.coalesce("salts", F.lit(1))).cast("int"))
    asking = salted.select("node", "size", "comp", F.lit(1).alias("asks"), "group", each(blocks).alias("block"), "salt")
    both = members.union(asking)
    rows, shingles = both.agg(F.count("*"), F.sum("size")).first()
    tasks = max(1, rows // TASK_ROWS, (shingles or 0) // TASK_SHINGLES)
    task = F.pmod(F.xxhash64("group", "block", "salt"), F.lit(tasks))
    return both.withColumn("task", task).groupBy("task", "node", "comp", "asks").agg(F.collect_list(F.struct("group", "block", "salt")).alias("units"))


def cross_asks(buckets: DataFrame, groups: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """Who asks whom between different components that share a bucket: ``asks`` and ``nodes`` as ``deal`` takes them.

    A document is paired with a component, not with its members: (document of the smaller component, larger component)
    is one row however many buckets and members they share. In a bucket of more than FEW components, whose members
    would ask that many, they ask the bucket itself: one row a member. So the rows are in proportion to the buckets'
    entries however many components meet in one.
    """
    state = buckets.join(groups, "node", "left").withColumn("comp", F.coalesce("component", "node")).select("bucket", "hub", "node", "size", "comp")
    mixed = state.groupBy("bucket").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo <> hi").select("bucket")
    nodes = materialize(state.select("node", "size", "comp").distinct())
    # written: only a join of plain exchanges can be split where one component has very many rows
    order = materialize(nodes.groupBy("comp").agg(F.count("*").alias("n"), F.min("size").alias("least"), F.max("size").alias("most")))
    live = materialize(state.join(mixed, "bucket").join(order, "comp"))
    parts = materialize(live.select("bucket", F.struct("n", "comp").alias("larger"), F.col("least").alias("low"), F.col("most").alias("high")).distinct())
    many = materialize(parts.groupBy("bucket").agg(F.count("*").alias("parts"), F.max("larger").alias("largest")).filter(F.col("parts") > FEW).select("bucket", "largest"))

    # sizes rule a link out, or the pair is the hub and a single document, which have been compared
    open_ = (100 * F.col("size") >= percent * F.col("low")) & (100 * F.col("high") >= percent * F.col("size")) & ~((F.col("node") == F.col("hub")) & (F.col("larger.n") == 1))
    few = parts.join(many, "bucket", "left_anti").withColumnRenamed("bucket", "in_bucket")
    met = live.join(few, (F.col("bucket") == F.col("in_bucket")) & (F.struct("n", "comp") < F.col("larger")) & open_)
    name = lambda c, kind: F.xxhash64(F.col(c), F.lit(kind))
    asks = met.select("node", "size", "comp", name("larger.comp", "component").alias("group"), F.col("larger.n").alias("n")).distinct()

    crowd = materialize(live.join(many, "bucket").select("node", "size", "comp", name("bucket", "bucket").alias("group"), (F.struct("n", "comp") < F.col("largest")).alias("asks")))
    counts = crowd.groupBy("group").agg(F.count("*").alias("n"))
    crowded = crowd.filter("asks").join(counts, "group").select("node", "size", "comp", "group", "n")
    whole = nodes.select("node", "size", "comp", name("comp", "component").alias("group"))
    return materialize(asks.union(crowded)), whole.union(crowd.select("node", "size", "comp", "group"))


def cross_links(buckets: DataFrame, groups: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links between different components that share a bucket.

    The members that are asked lie in blocks of bounded size, each document's set is sent once to every task that has
    blocks for it, and tasks give out the links alone. The documents that ask a block are dealt to salts of bounded
    rows and shingles by a hash of their id, and the block's members are repeated for each salt.
    """
    rows = deal(*cross_asks(buckets, groups, percent)).join(sets.withColumnRenamed("doc_id", "node"), "node")
    return rows.groupBy("task").applyInArrow(lambda t: block_links(t, percent), "a long, b long")


def link(docs: DataFrame, words: int = 5, percent: int = 80, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` of every row.

    1. Rows with equal shingle sets are one class, stood for by its smallest id; only these go on.
    2. Band keys put classes into buckets. Every member is confirmed, on whole sets, against the smallest member of
       its buckets, and the links are joined to components. This closes all pairs inside a component.
       What may still be missed are links between components that share a bucket: ``cross_links`` compares each
       document of the smaller one with the whole larger one, or with the whole bucket.
    3. Components of classes are given to their rows.

    Null text is empty; rows without words have no set and stay alone; repeated rows are one class; rows that share
    an id are one document in the smallest class of their texts; rows with a null id stay alone with null ids and are
    kept. An empty table gives an empty table.
    """
    found = materialize(signatures(docs, words, bands, rows))
    whole = found.filter(F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0))
    # written, so that the join can be split where one text has very many copies
    classes = materialize(whole.groupBy("n_shingles", "d1", "d2").agg(F.min("doc_id").alias("class_id")))
    member = materialize(whole.select("doc_id", "n_shingles", "d1", "d2").join(classes, ["n_shingles", "d1", "d2"]).groupBy("doc_id").agg(F.min("class_id").alias("class_id")))
    heads = found.select("doc_id", "n_shingles", "keys").join(member.filter("doc_id = class_id").select("doc_id"), "doc_id").dropDuplicates(["doc_id"])
    placed = heads.select(F.explode("keys").alias("bucket"), F.col("doc_id").alias("node"), F.col("n_shingles").alias("size"))
    hubs = placed.groupBy("bucket").agg(F.min(F.struct("node", "size")).alias("hub"), F.count("*").alias("n")).filter("n > 1").select("bucket", "hub")
    buckets = materialize(placed.join(hubs, "bucket"))

    nodes = buckets.select(F.col("node").alias("doc_id")).distinct()
    texts = docs.select("doc_id", "text").join(nodes, "doc_id", "left_semi")
    sets = materialize(shingle_sets(texts, words).dropDuplicates(["doc_id"]))

    stars = buckets.filter(F.col("node") != F.col("hub.node")).filter(100 * F.least("size", "hub.size") >= percent * F.greatest("size", "hub.size"))
    groups = materialize(components(materialize(confirm(stars.select(F.col("hub.node").alias("a"), F.col("node").alias("b")).distinct(), sets, percent))))
    more = materialize(cross_links(buckets.select("bucket", F.col("hub.node").alias("hub"), "node", "size"), groups, sets, percent))
    groups = materialize(components(groups.select(F.col("node").alias("a"), F.col("component").alias("b")).union(more)))
    member = member.join(groups, member["class_id"] == groups["node"], "left").select("doc_id", F.coalesce("component", "class_id").alias("component"))
    all_rows = found.select("doc_id", "n_shingles").join(member, "doc_id", "left").withColumn("component_id", F.coalesce("component", "doc_id"))
    return all_rows.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def op2_neardup(spark, sf_dir: str) -> DataFrame:
    return link(documents(spark, sf_dir), words=2)


def keep_one(docs: DataFrame, words: int = 5) -> DataFrame:
    """One row of each group of near copies, with its own columns: the row whose id names the group.

    Edge cases are those of ``link``: texts without words and rows with a null id stay; rows that share an id are one
    document and go or stay together.
    """
    gone = materialize(link(docs, words=words).filter("not kept").select(F.col("doc_id").alias("_neardup_id")).distinct())
    return docs.join(gone, F.col("doc_id") == F.col("_neardup_id"), "left_anti").select(*docs.columns)

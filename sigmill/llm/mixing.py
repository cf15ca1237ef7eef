"""Mixing sources to target weights by entropy balancing."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sigmill.llm.common import documents, materialize, n_words, with_position

#: Places of the rounding threshold.
SLOTS = 65536
#: Most rounds of changes to a source after its threshold, and the share of its target at which it needs none.
SWAPS, NEAR = 3, 1e-4
#: Decimal places of sums over documents: such sums don't depend on the order in which Spark adds.
EXACT = "decimal(38,9)"


def source_targets(sizes: DataFrame, weights: Sequence[float] = (5, 2, 1), cap: float = 3.0) -> DataFrame:
    """One row per source: ``source, source_size, weight, target``.

    Sources in code-point order (null last) take the weights in turn and share all words by weight; a target stops
    at ``cap`` times its source's size and the excess is shared again by weight. The shared level is the fixed
    point of ``level = (all - capped) / open weights``; only sums reach the driver.
    A source without words gets the target 0; an empty table gives an empty table.
    """
    table = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    table = with_position(table, F.col("source").asc_nulls_last(), name="rank")
    pick = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    table = materialize(table.select("source", "source_size", pick.alias("weight")))
    room = F.col("source_size") * F.lit(float(cap))
    total = table.agg(F.sum("source_size")).first()[0] or 0
    level, before = None, -1.0
    while level != before:
        over = F.lit(False) if level is None else F.col("weight") * F.lit(level) > room
        full, free = table.agg(
            F.sum(F.when(over, room).otherwise(0.0)), F.sum(F.when(over, 0.0).otherwise(F.col("weight")))
        ).first()
        before, level = level, ((total - full) / free if free else (level or 0.0))
    return table.withColumn("target", F.least(F.col("weight") * F.lit(float(level or 0.0)), room))


def sized(docs: DataFrame, *more: str) -> DataFrame:
    """``doc_id, source, size`` and a place in [0, 1) from the MD5 of the id, which decides how the rate is rounded."""
    place = F.conv(F.substring(F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), 1, 8), 16, 10).cast("long") / F.lit(2.0**32)
    return docs.select("doc_id", "source", n_words(F.col("text")).alias("size"), place.alias("place"), *more)


def rate(lam: Column, size: Column, mean: Column, cap: float) -> Column:
    """A document's rate: the exponential of its multiplier times its size, measured in its source's mean, up to ``cap``.
    Rounded, so that the last bits of a sum can't move a document."""
    return F.round(F.least(F.lit(float(cap)), F.exp(F.least(lam * size / mean, F.lit(50.0)))), 9)


def tilt(sizes: DataFrame, targets: DataFrame, cap: float = 3.0, steps: int = 80, tolerance: float = 1e-8) -> DataFrame:
    """Solve the dual of entropy balancing by Newton steps and add each source's ``mean`` and multiplier ``lam``.

    Of all rates ``0 <= r_d <= cap`` with ``sum size_d * r_d = target`` in every source, those nearest to one copy of
    every document are sought: minimise ``sum r_d ln r_d - r_d`` over documents. The solution is
    ``r_d = min(cap, exp(lam * x_d))`` with ``x_d`` the document's size in means of its source, and the dual, whose
    gradient is ``target - sum size_d r_d`` and whose curvature is ``sum size_d x_d r_d`` over the rates below the cap,
    is concave. Every step sums both over all documents; documents of equal source and size have equal terms and are
    counted once, so a step reads one row for each size that occurs. A step that leaves the bracket of signs seen so
    far is replaced by its middle. The driver sees the largest remaining violation alone. A source whose target is
    ``cap`` times its size has every document at the cap; one with target 0 has no rates.
    """
    levels = materialize(sizes.filter("size > 0").groupBy("source", "size").agg(F.count("*").alias("n")))
    counts = levels.groupBy("source").agg(F.sum("n").alias("n"))
    state = targets.alias("t").join(counts.alias("c"), F.col("t.source").eqNullSafe(F.col("c.source")), "left").select("t.*", (F.col("t.source_size") / F.col("n")).alias("mean"))
    full = F.col("target") >= F.col("source_size") * F.lit(cap * (1 - 1e-12))
    state = materialize(state.withColumn("lam", F.when(full, F.lit(1e9)).otherwise(F.lit(0.0))).withColumn("lo", F.lit(-1e6)).withColumn("hi", F.lit(1e6)).withColumn("open", (F.col("target") > 0) & ~full))
    for _ in range(steps):
        both = levels.alias("l").join(state.filter("open").select("source", "mean", "lam").alias("s"), F.col("l.source").eqNullSafe(F.col("s.source"))).select("s.source", "size", "n", "mean", rate(F.col("lam"), F.col("size"), F.col("mean"), cap).alias("r"))
        mass = F.col("n") * F.col("size") * F.col("r")
        sums = both.groupBy("source").agg(F.sum(mass.cast(EXACT)).cast("double").alias("mass"), F.sum(F.when(F.col("r") < cap, mass * F.col("size") / F.col("mean")).otherwise(0.0).cast(EXACT)).cast("double").alias("slope"))
        gap = F.col("target") - F.col("mass")
        state = state.alias("t").join(sums.alias("m"), F.col("t.source").eqNullSafe(F.col("m.source")), "left").select("t.*", "mass", "slope")
        state = state.withColumn("lo", F.when(gap > 0, F.col("lam")).otherwise(F.col("lo"))).withColumn("hi", F.when(gap < 0, F.col("lam")).otherwise(F.col("hi")))
        step = F.col("lam") + gap / F.nullif(F.col("slope"), F.lit(0.0))
        near = (step > F.col("lo")) & (step < F.col("hi"))
        done = F.abs(gap) <= F.col("target") * tolerance
        state = state.withColumn("lam", F.when(~F.col("open") | done, F.col("lam")).when(near, step).otherwise((F.col("lo") + F.col("hi")) / 2)).withColumn("open", F.col("open") & ~F.coalesce(done, F.lit(False))).drop("mass", "slope")
        state = materialize(state)
        if not state.filter("open").limit(1).count():
            break
    return state.drop("lo", "hi", "open")


def _slot(r: Column, place: Column) -> Column:
    """The place of a document among those that can get one copy more: early if its rate has a large fraction and its
    own place is low."""
    return F.floor((place - (r - F.floor(r)) + 1) * (SLOTS // 2)).cast("int")


def _spare(r: Column, cap: float) -> Column:
    """Whether one copy more than the whole ones stays within ``cap``."""
    return (F.col("size") > 0) & (r < cap) & (F.floor(r) + 1 <= cap)


def solve(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), cap: float = 3.0) -> DataFrame:
    """A row a source: ``source, source_size, target, mean, lam, threshold, swaps``; all that copies are read off.

    A document has ``floor(rate)`` copies and one more if its slot lies below its source's threshold. At a threshold in
    the middle that is rounding by chance; the threshold is moved to where the words taken come nearest to the target.
    It is found on a histogram of words by slot, at most SLOTS rows a source, so a source misses its target by less
    than the words that share one slot. Documents at the cap get no copy more. What a source then lacks or has over is
    made up by ``swaps``, see ``_swaps``.
    """
    sizes = materialize(sized(docs))
    sources = materialize(tilt(sizes, source_targets(sizes, weights, cap), cap))
    same = F.col("d.source").eqNullSafe(F.col("s.source"))
    rated = sizes.alias("d").join(sources.filter("target > 0").alias("s"), same).select("s.source", "size", "place", rate(F.col("lam"), F.col("size"), F.col("mean"), cap).alias("r"))
    # documents of one source, size and slot fare alike: from here on they are one row
    classes = rated.filter("size > 0").groupBy("source", "size", F.when(_spare(F.col("r"), cap), _slot(F.col("r"), F.col("place"))).alias("slot"))
    classes = materialize(classes.agg(F.sum("size").alias("words"), F.sum((F.floor("r") * F.col("size")).cast("long")).alias("whole")))
    whole = classes.groupBy("source").agg(F.sum("whole").alias("whole"))
    need = sources.alias("s").join(whole.alias("w"), F.col("s.source").eqNullSafe(F.col("w.source")), "left").select("s.source", (F.col("target") - F.coalesce("whole", F.lit(0))).alias("need"))
    histogram = classes.filter("slot is not null").groupBy("source", "slot").agg(F.sum("words").alias("words"))
    running = F.sum("words").over(Window.partitionBy("source").orderBy("slot"))
    filled = histogram.alias("h").join(need.alias("n"), F.col("h.source").eqNullSafe(F.col("n.source"))).select("n.source", "slot", "words", "need").withColumn("upto", running)
    gap = F.struct(F.abs(F.col("upto") - F.col("need")).alias("miss"), (F.col("slot") + 1).alias("threshold"), "upto")
    edge = filled.groupBy("source").agg(F.min(gap).alias("best"), F.first("need").alias("need"))
    none = F.abs(F.col("need")) <= F.col("best.miss")
    edge = edge.select("source", F.when(none, 0).otherwise(F.col("best.threshold")).alias("threshold"), F.when(none, F.col("need")).otherwise(F.col("need") - F.col("best.upto")).alias("short"))
    found = sources.alias("s").join(edge.alias("e"), F.col("s.source").eqNullSafe(F.col("e.source")), "left")
    return _swaps(classes, materialize(found.select("s.*", F.coalesce("threshold", F.lit(0)).alias("threshold"), F.coalesce("short", F.lit(0.0)).alias("short"))))


def _swaps(classes: DataFrame, sources: DataFrame) -> DataFrame:
    """Add ``swaps``, the ``size, slot`` of documents that are rounded against the threshold, and drop ``short``.

    The threshold stops at whichever document crosses the target, and a long one leaves much over. So, at most SWAPS
    times and while a source is further than NEAR from its target, the one or two classes whose change brings it nearest
    are turned: one below the threshold loses its copy, or one above gets it. Of every size and side only the class next
    to the threshold is a candidate, so changes are looked for among as many rows as sizes occur: each is put beside
    those nearest to what would then be wanted, in order of words. No change (size 0, slot -1) is a candidate too.
    """
    up = F.col("slot") >= F.col("threshold")
    sides = classes.filter("slot is not null").alias("c").join(sources.select("source", "threshold").alias("s"), F.col("c.source").eqNullSafe(F.col("s.source"))).select("s.source", "size", "slot", "words", up.alias("up"), F.when(up, F.col("slot") - F.col("threshold")).otherwise(F.col("threshold") - F.col("slot")).alias("far"))
    near = sides.groupBy("source", "size", "up").agg(F.min(F.struct("far", "slot", "words")).alias("c"))
    near = near.select("source", "size", F.col("c.slot").alias("slot"), F.when(F.col("up"), F.col("c.words")).otherwise(-F.col("c.words")).alias("words"))
    near = materialize(near.unionByName(sources.select("source", F.lit(0).cast("long").alias("size"), F.lit(-1).alias("slot"), F.lit(0).cast("long").alias("words"))))
    state = sources.withColumn("swaps", F.expr("cast(array() as array<struct<size: bigint, slot: int>>)"))
    own = F.struct("size", "slot")
    rising, falling = (Window.partitionBy("source").orderBy(*keys, "size", "slot") for keys in (("at", "asked"), (F.col("at").desc(), "asked")))
    for _ in range(SWAPS):
        wanting = state.filter(F.abs(F.col("short")) > F.col("target") * NEAR).select("source", "short", "swaps")
        free = near.alias("n").join(wanting.alias("s"), F.col("n.source").eqNullSafe(F.col("s.source"))).select("s.source", "size", "slot", "words", "short", "swaps").filter(~F.array_contains("swaps", own)).drop("swaps")
        points = free.withColumn("at", F.explode(F.array(F.struct(F.lit(0).alias("asked"), F.col("words").cast("double").alias("key")), F.struct(F.lit(1).alias("asked"), (F.col("short") - F.col("words")).alias("key")))))
        points = points.select("source", "size", "slot", "words", "short", F.col("at.asked").alias("asked"), F.col("at.key").alias("at"))
        other = F.last(F.when(F.col("asked") == 0, F.struct("size", "slot", "words")), ignorenulls=True)
        both = points.withColumn("low", other.over(rising)).withColumn("high", other.over(falling)).filter("asked = 1")
        pairs = both.select("source", "size", "slot", "words", "short", F.explode(F.array("low", "high")).alias("other"))
        sum_ = F.col("words") + F.col("other.words")
        pairs = pairs.filter((own != F.struct("other.size", "other.slot")) & (F.abs(F.col("short") - sum_) < F.abs(F.col("short"))))
        best = pairs.groupBy("source").agg(F.min(F.struct(F.abs(F.col("short") - sum_).alias("miss"), own.alias("one"), F.struct("other.size", "other.slot").alias("two"), sum_.alias("words"))).alias("b"))
        joined = state.alias("s").join(best.alias("b"), F.col("s.source").eqNullSafe(F.col("b.source")), "left")
        turn, keep = F.col("b.b").isNotNull(), [f"s.{c}" for c in state.columns if c not in ("short", "swaps")]
        more = F.filter(F.array("b.b.one", "b.b.two"), lambda c: c["slot"] >= 0)
        turned = joined.select(*keep, (F.col("s.short") - F.coalesce("b.b.words", F.lit(0))).alias("short"), F.when(turn, F.concat("s.swaps", more)).otherwise(F.col("s.swaps")).alias("swaps"), turn.alias("turned"))
        turned = materialize(turned)
        state = turned.drop("turned")
        if not turned.filter("turned").limit(1).count():
            break
    return state.drop("short")


def _planned(sizes: DataFrame, sources: DataFrame, cap: float) -> DataFrame:
    """Every row of ``sizes`` with what its source's row says of it; nothing is joined by id."""
    r = F.when(F.col("s.target") > 0, F.when(F.col("d.size") > 0, rate(F.col("s.lam"), F.col("d.size"), F.col("s.mean"), cap)).otherwise(F.lit(1.0))).otherwise(F.lit(0.0))
    joined = sizes.alias("d").join(sources.alias("s"), F.col("d.source").eqNullSafe(F.col("s.source")))
    rated = joined.select("d.*", F.col("s.source_size").alias("source_size"), F.col("s.target").alias("target"), F.col("s.threshold").alias("threshold"), F.col("s.swaps").alias("swaps"), r.alias("rate"))
    slot = _slot(F.col("rate"), F.col("place"))
    below, turned = slot < F.col("threshold"), F.array_contains("swaps", F.struct("size", slot.alias("slot")))
    more = (F.col("target") > 0) & _spare(F.col("rate"), cap) & (below != turned)
    return rated.withColumn("copies", F.floor("rate") + more.cast("long")).withColumn("taken", F.col("copies") * F.col("size")).drop("threshold", "swaps", "place")


def mix(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), cap: float = 3.0) -> DataFrame:
    """Copies of every row: ``doc_id, source, size, source_size, target, rate, copies, taken``.

    Null text has size 0: the row is kept once (its source has a target) and takes no words. Rows are rated by their own
    source and size, and rounded by their id, so repeated rows fare alike and rows that share an id may differ; a null
    id has a place like any other. Equal sizes tie to the same rate. A row's copies never exceed ``cap``. Very long
    texts are only counted. An empty table gives an empty table.
    """
    return _planned(sized(docs), solve(docs, weights, cap), cap).select("doc_id", "source", "size", "source_size", "target", "rate", "copies", "taken")


def op4_mixing(spark, sf_dir: str) -> DataFrame:
    """Every document of the table with the words that the mix takes of it."""
    return mix(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken", "copies", "rate")


def repeat_copies(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), cap: float = 3.0) -> DataFrame:
    """The mix itself: each row as many times as it has copies, with its own columns. Edge cases are those of ``mix``.

    A row's copies follow from the row and its source's few numbers, so texts are not shuffled."""
    whole = docs.select("doc_id", "source", "text", F.struct(*docs.columns).alias("_mix_row"))
    planned = _planned(sized(whole, "_mix_row"), solve(docs, weights, cap), cap).filter("copies > 0")
    copies = planned.select("_mix_row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("_mix_copy"))
    return copies.select(*[F.col("_mix_row")[c].alias(c) for c in docs.columns])

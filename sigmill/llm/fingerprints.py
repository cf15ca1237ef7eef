"""Homomorphic multiset fingerprints of documents. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sigmill.llm.common import documents, with_position

#: 64-bit hashes of a unit, each of which gives 63 lanes, packed three to a long: one of the unit alone, whose sums are the
#: multiset hash proper, and two of the unit with the number of its copy, from which likeness is told.
SUMS, COPIES = 1, 2
#: A lane counts modulo 2**20 and has one guard bit, so that packed sums never carry from lane to lane.
LANE, WIDTH = 20, 21
ONES = sum(1 << (WIDTH * j) for j in range(3))
FULL = ((1 << LANE) - 1) * ONES
LENGTH = 1 + (SUMS + COPIES) * WIDTH
#: Paragraphs end at line breaks; a paragraph is the multiset of its sentences, in any script's marks.
UNIT_GAP = r"[\r\n]+|(?<=[.!?؟।])\x20+|(?<=[。！？])"
#: A sentence of more code points is cut again before words of nine characters and more: by what it holds, not by place.
LONG, WORD_GAP = 200, r"\x20+(?=[^\x20]{9})"


def units(text: Column) -> Column:
    """The multiset that a text stands for: its sentences, or the parts of long ones, without empty ones."""
    parts = F.transform(F.split(text, UNIT_GAP), lambda u: F.when(F.length(u) > LONG, F.split(u, WORD_GAP)).otherwise(F.array(u)))
    return F.filter(F.flatten(parts), lambda u: u != "")


def _wide(unit: Column, copy: Column) -> Column:
    """The wide 0/1 vector of a unit and the number of its copy, packed: every bit of its hashes is one lane."""
    hashes = [F.xxhash64(unit, F.lit(i)) for i in range(SUMS)] + [F.xxhash64(unit, copy, F.lit(i)) for i in range(COPIES)]
    lanes = F.transform(F.array(*hashes), lambda h: F.array(*[F.shiftrightunsigned(h, k).bitwiseAND(F.lit(ONES)) for k in range(WIDTH)]))
    return F.concat(F.array(F.lit(1).cast("long")), F.flatten(lanes))  # the first counts units


def _plus(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: (x + y).bitwiseAND(F.lit(FULL)))


def _minus(a: Column, b: Column) -> Column:
    guard = F.lit((1 << LANE) * ONES)
    return F.zip_with(a, b, lambda x, y: (x.bitwiseOR(guard) - y).bitwiseAND(F.lit(FULL)))


def empty() -> Column:
    return F.array_repeat(F.lit(0).cast("long"), LENGTH)


def _sum(parts: Column) -> Column:
    """Sum of the wide vectors of an array of units. Sorted, equal units stand together and are numbered on the way."""
    copy = lambda acc, u: F.when(acc["unit"] == u, acc["copy"] + 1).otherwise(F.lit(1))
    start = F.struct(F.lit("").alias("unit"), F.lit(0).alias("copy"), empty().alias("v"))
    step = lambda acc, u: F.struct(u.alias("unit"), copy(acc, u).alias("copy"), _plus(acc["v"], _wide(u, copy(acc, u))).alias("v"))
    return F.aggregate(F.array_sort(parts), start, step, lambda acc: acc["v"])


def fingerprint(text: Column) -> Column:
    """Sum of the wide vectors of all units, lanes modulo 2**20: the order of units doesn't matter."""
    return _sum(units(text))


def _share(text: Column, beside: Column | None) -> Column:
    """What ``text`` adds to the fingerprint of a document with the units ``beside``: only those that it has too count."""
    own = units(text)
    if beside is None:
        return _sum(own)
    same = F.filter(beside, lambda u: F.array_contains(own, u))
    return _minus(_sum(F.concat(same, own)), _sum(same))


def insert(vector: Column, text: Column, beside: Column | None = None) -> Column:
    """The fingerprint after the units of ``text`` are added to a document that has the units ``beside``, of which
    only those that ``text`` has too matter: their copies are numbered on. Without it the two share no unit."""
    return _plus(vector, _share(F.col(text) if isinstance(text, str) else text, beside))


def delete(vector: Column, text: Column, beside: Column | None = None) -> Column:
    """The fingerprint after the units of ``text`` are taken away from a document that keeps the units ``beside``."""
    return _minus(vector, _share(F.col(text) if isinstance(text, str) else text, beside))


def written(vector: Column) -> Column:
    return F.lower(F.array_join(F.transform(vector, lambda x: F.lpad(F.hex(x), 16, "0")), ""))


def _copies(vector: Column) -> Column:
    """The lanes of units with their copies' numbers, as sums of +1 and -1: twice the count less the number of units."""
    low = F.lit((1 << LANE) - 1)
    counts = F.flatten(F.transform(F.slice(vector, 2 + SUMS * WIDTH, COPIES * WIDTH), lambda p: F.array(*[F.shiftrightunsigned(p, WIDTH * j).bitwiseAND(low) for j in range(3)])))
    return F.transform(counts, lambda c: 2 * c - F.element_at(vector, 1))


def likeness(a: Column, b: Column) -> Column:
    """Likeness of two fingerprints, 0 to 1, exactly 1 for equal ones. It is meant for texts of fewer than 2**20 units:
    counts are kept modulo that, so beyond it only equality tells.

    It estimates the share of units, copies counted, that the two have in common: ``1 - d / (n + m)`` for ``n`` and ``m``
    units of which ``d`` are in one text alone. The k-th copy of a unit is an element of its own, so each of the
    ``d`` moves every signed lane by 1 or -1, and the mean over the lanes of the squared difference has the expectation
    ``d``, with a deviation of ``d * sqrt(2 / 126)``. The number of units is in the fingerprint and is exact.
    """
    squares = F.aggregate(F.zip_with(_copies(a), _copies(b), lambda x, y: x - y), F.lit(0.0), lambda acc, v: acc + v.cast("double") * v)
    d = squares / (COPIES * 3 * WIDTH)
    return F.when(a == b, 1.0).otherwise(F.greatest(F.lit(0.0), 1 - d / F.greatest(F.element_at(a, 1) + F.element_at(b, 1), F.lit(1))))


def next_ids(docs: DataFrame) -> DataFrame:
    """``doc_id, next_id``: the following id in ascending order, the first after the last; null ids have none."""
    ids = docs.filter(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(F.coalesce(F.length("text"), F.lit(0))).alias("longest"))
    placed = with_position(ids, "doc_id")
    n = placed.count()
    after = placed.select((F.pmod(F.col("pos") - 1 + n, F.lit(max(n, 1)))).alias("pos"), F.col("doc_id").alias("next_id"))
    return placed.join(after, "pos").select("doc_id", "next_id", F.col("longest"))


def edits(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text, its edited text and the next document.

    The edited text has its last ``floor(n_chars / 4)`` code points replaced by the first as many (or all) of the
    next document. Texts are shuffled once by id; what goes on to the document before are the next one's first
    code points, no more than are needed there, and its fingerprint. Null text is empty; of rows that share an id
    the one with the least text is the next document; rows with a null id have no next one: their edited text is
    their own and ``near_next`` is 0. Very long texts are folded unit by unit. An empty table gives an empty table.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    every = docs.select("doc_id", text.alias("text")).withColumn("vector", fingerprint(F.col("text")))
    own = every.filter(F.col("doc_id").isNotNull())  # both joins below read the same exchange of it
    info = next_ids(docs)
    need = info.select(F.col("next_id").alias("doc_id"), F.col("doc_id").alias("prev_id"), F.floor(F.col("longest") / 4).cast("int").alias("need"))
    heads = own.join(need, "doc_id").select(F.col("prev_id").alias("doc_id"), F.struct(F.substring(F.col("text"), F.lit(1), F.col("need")).alias("head"), F.col("vector").alias("next_vector")).alias("x"))
    heads = heads.groupBy("doc_id").agg(F.min("x").alias("x")).select("doc_id", "x.*")
    n = F.length("text")
    cut = F.floor(n / 4).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - cut), F.coalesce(F.substring(F.col("head"), F.lit(1), cut), F.substring(F.col("text"), n - cut + 1, cut)))
    alone = every.filter(F.col("doc_id").isNull()).withColumn("head", F.lit(None).cast("string")).withColumn("next_vector", F.lit(None).cast("array<bigint>"))
    both = own.join(heads, "doc_id", "left").unionByName(alone).withColumn("edited", edited).withColumn("edited_vector", fingerprint(F.col("edited")))
    return both.select(
        "doc_id", F.length("text").cast("long").alias("n_chars"), F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        written(F.col("vector")).alias("fingerprint"), written(F.col("edited_vector")).alias("edited_fingerprint"),
        likeness(F.col("vector"), F.col("edited_vector")).alias("near_edited"),
        F.when(F.col("next_vector").isNull(), 0.0).otherwise(likeness(F.col("vector"), F.col("next_vector"))).alias("near_next"),
    )


def op6_fingerprints(spark, sf_dir: str) -> DataFrame:
    return edits(documents(spark, sf_dir))

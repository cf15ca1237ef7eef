"""Filter interaction audit: what each of five filters removes, in every order of applying them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sigmill.llm.common import GAP_CHARS, WORD_GAP, documents

FILTERS = "ABCDE"
#: The filter that looks at all documents; the others look at a text alone.
COPIES = "E"


def words(text: Column) -> Column:
    """The ``[^\\x20\\x09-\\x0D]+`` words of a text that is not null."""
    core = F.btrim(text, F.lit(GAP_CHARS))
    return F.when(core == "", F.array().cast("array<string>")).otherwise(F.split(core, WORD_GAP))


def failures(text: Column) -> dict[str, Column]:
    """Whether a text fails each filter that needs no other document; nulls count as empty."""
    text = F.coalesce(text, F.lit(""))
    n = F.size(words(text))
    capitals = F.length(text) - F.length(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))
    return {
        "A": n < 50,
        "B": 100 * F.size(F.array_distinct(words(text))) < 65 * n,
        "C": 100 * capitals > 5 * F.length(text),
        "D": text.rlike("[#$%&*|]"),
    }


def mask_cells(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Documents by part and set of failing filters: ``part, mask, n, good, toxic``; bit i of the mask is the i-th filter.

    A text leaves its task as a digest and four bits. Copies have the same bits, so rows of a digest and part are summed
    up before they are shuffled, and of each digest only its smallest id's rows pass the copies' filter. No text is
    compared with another one and no task gets a group of copies row by row.
    """
    fails = failures(F.col("text"))
    bits = sum((F.when(c, F.lit(1 << FILTERS.index(f))).otherwise(F.lit(0)) for f, c in fails.items()), F.lit(0))
    told = docs.select("doc_id", F.coalesce("source", F.lit("")).alias("part"), F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256)).alias("digest"), bits.alias("bits"))
    marks = labels.groupBy("doc_id").agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    marked = told.join(marks, "doc_id", "left")
    # rows that repeat an id are one entry with a count, so that the entry of the smallest id is unique
    once = marked.groupBy("doc_id", "part", "digest", "bits").agg(F.count("*").alias("n"), F.coalesce(F.max("good"), F.lit(0)).alias("good"), F.coalesce(F.max("toxic"), F.lit(0)).alias("toxic"))
    sums = [F.sum("n").alias("n"), F.sum(F.col("n") * F.col("good")).alias("good"), F.sum(F.col("n") * F.col("toxic")).alias("toxic")]
    no_id = F.col("doc_id").isNull()
    groups = once.groupBy("digest", "part", "bits").agg(
        *sums, F.coalesce(F.sum(F.when(no_id, F.col("n"))), F.lit(0)).alias("unnumbered"), F.min(F.when(~no_id, F.struct("doc_id", "n", "good", "toxic"))).alias("first")
    )
    # a digest has a row for each part here; an id that is null is neither smaller nor larger than another one
    least = F.min("first.doc_id").over(Window.partitionBy("digest"))
    groups = groups.withColumn("is_first", F.coalesce(F.col("first.doc_id") == least, F.lit(False)))
    own = lambda c: F.when(F.col("is_first"), c).otherwise(F.lit(0))
    n0 = own(F.col("first.n")) + F.col("unnumbered")
    good0, toxic0 = own(F.col("first.n") * F.col("first.good")), own(F.col("first.n") * F.col("first.toxic"))
    bit = 1 << FILTERS.index(COPIES)
    cells = F.array(
        F.struct(F.col("bits").alias("mask"), n0.alias("n"), good0.alias("good"), toxic0.alias("toxic")),
        F.struct((F.col("bits") + bit).alias("mask"), (F.col("n") - n0).alias("n"), (F.col("good") - good0).alias("good"), (F.col("toxic") - toxic0).alias("toxic")),
    )
    return groups.select("part", F.inline(cells)).groupBy("part", "mask").agg(F.sum("n").alias("n"), F.sum("good").alias("good"), F.sum("toxic").alias("toxic"))


def prefixes(spark: SparkSession) -> DataFrame:
    """Every beginning of an order of filters, against every mask cell, by a recursive query.

    Each recursion puts one unused letter behind a prefix, carries the bits of the filters applied so far, and says what
    that step does to the documents of a cell: ``filter_order, step, mask, kept, removed, redundant, unique_fails, orders``;
    ``orders`` is how many whole orders begin so. The cells are the sets of filters, so the recursion has the
    same rows whatever the documents are.
    """
    letters = ", ".join(f"('{f}', {1 << i})" for i, f in enumerate(FILTERS))
    n = len(FILTERS)
    return spark.sql(f"""
with recursive letters(letter, bit) as (values {letters}),
steps(filter_order, applied, step, mask, kept, removed, redundant, unique_fails, orders) as (
  select '', 0, 0, cast(id as int), true, false, false, false, bigint({"*".join(map(str, range(1, n + 1)))}) from range({1 << n})
  union all
  select concat(filter_order, letter), applied | bit, step + 1, mask, mask & (applied | bit) = 0,
    mask & bit <> 0 and mask & applied = 0, mask & bit <> 0 and mask & applied <> 0, mask = bit, orders div ({n} - step)
  from steps join letters on applied & bit = 0)
select * from steps where step > 0""")


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per part, order of the filters and step: ``part, filter_order, step, kept, removed, redundant,
    unique_fails, good_lost, toxic_lost, shapley``, zeros included.

    The cells of all parts are joined with the steps of all prefixes on the mask; both the sums by prefix and the
    spread to whole orders are partial aggregates and lookups by part. Null text is empty, null source the part of the
    empty name, repeated rows count each, a row without an id is nobody's copy, repeated labels count as one that has
    either mark; other columns are ignored; an empty table gives no rows.
    """
    spark = docs.sparkSession
    cells = mask_cells(docs, labels)
    steps = F.broadcast(prefixes(spark))  # fixed size: 325 prefixes by 32 masks
    met = cells.join(steps, "mask").groupBy("part", "filter_order", "step", "orders").agg(
        *[F.sum(F.when(F.col(c), F.col("n")).otherwise(F.lit(0))).alias(c) for c in ("kept", "removed", "redundant", "unique_fails")],
        *[F.sum(F.when(F.col("removed"), F.col(c)).otherwise(F.lit(0))).alias(f"{c}_lost") for c in ("good", "toxic")],
    )
    # a part's 325 rows in one: the sums over all orders and the whole orders' steps are taken from them in place
    row = F.struct("filter_order", "step", "orders", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")
    parts = met.groupBy("part").agg(F.collect_list(row).alias("steps"))
    parts = parts.withColumn("by_order", F.map_from_entries(F.transform("steps", lambda s: F.struct(s["filter_order"], s))))
    letter = lambda s: F.substring(s["filter_order"], -1, 1)
    share = lambda f: F.aggregate(F.filter("steps", lambda s: letter(s) == f), F.lit(0).cast("long"), lambda a, s: a + s["removed"] * s["orders"])
    parts = parts.withColumn("shapleys", F.create_map(*[x for f in FILTERS for x in (F.lit(f), share(f))]))
    whole = F.explode(F.filter("steps", lambda s: s["step"] == len(FILTERS))["filter_order"])
    orders = parts.select("part", "by_order", "shapleys", whole.alias("filter_order"))
    out = orders.select("part", "shapleys", "by_order", "filter_order", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))).alias("step"))
    out = out.withColumn("s", F.col("by_order")[F.substring("filter_order", F.lit(1), F.col("step"))])
    shapley = F.col("shapleys")[F.substring("filter_order", F.col("step"), F.lit(1))].alias("shapley")
    return out.select("part", "filter_order", "step", *[F.col("s")[c].alias(c) for c in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")], shapley)


def op11_filteraudit(spark, sf_dir: str) -> DataFrame:
    return audit(documents(spark, sf_dir), documents(spark, sf_dir, "labels"))

"""Secret scans: base patterns, and linking of the parts of a credential within a scope. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sigmill.llm.common import documents, materialize

# The base patterns, and the shortest match (or value) that counts.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
ASSIGN_VALUE = 12

# Weak candidates: each alone says little.
LOGIN = r"""(?i:user(?:name)?|login|account|client_?id|access_?key(?:_?id)?)["']?\x20*[:=]\x20*["']?[A-Za-z0-9@+/_.=-]{3,}"""
BLOB = r"""(?<![A-Za-z0-9+/_=-])(?=[A-Za-z+/_-]*[0-9])(?=[a-z0-9+/_-]*[A-Z])(?=[A-Z0-9+/_-]*[a-z])[A-Za-z0-9+/_-]{24,}={0,2}"""
ENDPOINT = r"""(?:https?|ftp|ssh|postgres(?:ql)?|mysql|mongodb|redis|amqp)://[^\s"'<>]{4,}"""

#: Order of kinds at equal starts; the first three are the base.
KINDS = ("assign", "access", "hex", "login", "blob", "endpoint")
#: Kinds that can be each part of a credential.
IDENTIFIER, SECRET, END = (1, 3), (0, 2, 4), (5,)
#: Parts belong together if they start at most so many code points apart.
SCOPE = 512
#: Items that are gathered before they are put with the others: appending to one long array copies it every time.
RUN = 256
#: Code points of the blocks in which a text is cut apart.
BLOCK = 4096
SPAN = "struct<start:int,kind:int,end:int>"


def _gather(items: Column, start: Column, step, kind: str) -> Column:
    """Fold ``items`` and gather an array: ``step(at, item) -> (new at, array of what is added)``; linear in their number."""
    empty, more = F.array().cast(f"array<{kind}>"), F.array().cast(f"array<array<{kind}>>")

    def walk(acc: Column, x: Column) -> Column:
        at, add = step(acc["at"], x)
        run = F.concat(acc["run"], add)
        full = F.size(run) >= RUN
        return F.struct(at.alias("at"), F.when(full, empty).otherwise(run).alias("run"), F.when(full, F.concat(acc["out"], F.array(run))).otherwise(acc["out"]).alias("out"))

    zero = F.struct(start.alias("at"), empty.alias("run"), more.alias("out"))
    return F.aggregate(items, zero, walk, lambda acc: F.struct(acc["at"].alias("at"), F.flatten(F.concat(acc["out"], F.array(acc["run"]))).alias("items")))


def _located(text: Column, pattern: str, kind: int, minimum: int = 0) -> Column:
    """Spans ``(start, kind, end)`` of the leftmost non-overlapping matches, in code points.

    The pieces between matches and the matches themselves give every start as a sum of lengths.
    ``minimum`` is the least length of group 2; a match that falls short still uses up its text.
    """
    p = F.lit(pattern)
    got = F.regexp_extract_all(text, p, F.lit(0))
    rest = F.split(text, pattern, -1)
    value = F.regexp_extract_all(text, p, F.lit(2)) if minimum else got
    steps = F.arrays_zip(F.slice(rest, F.lit(1), F.size(got)).alias("gap"), got.alias("hit"), value.alias("value"))

    def step(at: Column, x: Column) -> tuple[Column, Column]:
        start = at + F.length(x["gap"])
        end = start + F.length(x["hit"])
        span = F.array(F.struct(start.alias("start"), F.lit(kind).alias("kind"), end.alias("end")))
        return end, F.when(F.length(x["value"]) >= minimum, span).otherwise(F.array().cast(f"array<{SPAN}>"))

    return F.when(text.rlike(pattern), _gather(steps, F.lit(0), step, SPAN)["items"]).otherwise(F.array().cast(f"array<{SPAN}>"))


def _base(text: Column) -> Column:
    return F.concat(_located(text, ASSIGN, 0, ASSIGN_VALUE), _located(text, ACCESS, 1), _located(text, HEX, 2))


def _text() -> Column:
    return F.coalesce(F.col("text"), F.lit(""))


def candidates(docs: DataFrame) -> DataFrame:
    """``doc_id, digest, base, weak``: the spans of the base kinds and of the weak kinds of every whole text; ``digest``
    tells texts apart that share an id."""
    weak = F.concat(_located(_text(), LOGIN, 3), _located(_text(), BLOB, 4), _located(_text(), ENDPOINT, 5))
    return docs.select("doc_id", F.md5(_text().cast("binary")).alias("digest"), _base(_text()).alias("base"), weak.alias("weak"))


def linked(found: DataFrame) -> DataFrame:
    """``link_id, link_digest, extra``: the weak spans that have their complement within a scope.

    An interval join: spans belong together if their starts are at most SCOPE apart. Blocks of SCOPE code points are
    the join's key, and a span looks into its own block and the two beside it; of each part (identifier, secret,
    endpoint) a block gives its first and last start, summed up before the shuffle, which is enough to tell whether one
    lies within reach. So the answer depends on distances alone, not on where in a text the parts stand, and no pair of
    spans is made. A weak login counts where a secret is, a blob where an identifier is, an endpoint where both are.
    Blobs and logins inside a base span are that span and are left out.
    """
    keys = ["doc_id", "digest"]
    spans = found.filter(F.size("weak") > 0).dropDuplicates(keys)
    clear = F.filter("weak", lambda w: ~F.exists("base", lambda b: (b["start"] < w["end"]) & (w["start"] < b["end"])))
    each = spans.select(F.coalesce("doc_id", F.lit(0)).alias("link_id"), F.col("doc_id").isNull().alias("no_id"), "digest", F.explode(F.concat("base", clear)).alias("s")).select("link_id", "no_id", "digest", "s.*")
    row = ["link_id", "no_id", "digest"]
    each = each.withColumn("block", F.floor(F.col("start") / SCOPE))
    ends = lambda kinds, name: (F.min(F.when(F.col("kind").isin(*kinds), F.col("start"))).alias(f"{name}_first"), F.max(F.when(F.col("kind").isin(*kinds), F.col("start"))).alias(f"{name}_last"))
    parts = {"identifier": IDENTIFIER, "secret": SECRET}
    blocks = each.filter(F.col("kind").isin(*IDENTIFIER, *SECRET)).groupBy(*row, "block").agg(*[x for n, k in parts.items() for x in ends(k, n)])
    asks = each.filter("kind >= 3").withColumn("block", F.explode(F.array(*[F.col("block") + k for k in (-1, 0, 1)])))
    near = lambda n: F.coalesce(F.col(f"{n}_first").between(F.col("start") - SCOPE, F.col("start") + SCOPE) | F.col(f"{n}_last").between(F.col("start") - SCOPE, F.col("start") + SCOPE), F.lit(False))
    met = asks.join(blocks, [*row, "block"]).groupBy(*row, "start", "kind", "end").agg(*[F.max(near(n)).alias(n) for n in parts])
    complete = ((F.col("kind") == 3) & F.col("secret")) | ((F.col("kind") == 4) & F.col("identifier")) | ((F.col("kind") == 5) & F.col("identifier") & F.col("secret"))
    kept = met.filter(complete).groupBy(*row).agg(F.collect_list(F.struct("start", "kind", "end")).alias("extra"))
    return kept.select(F.when(~F.col("no_id"), F.col("link_id")).alias("link_id"), F.col("digest").alias("link_digest"), "extra")


def _beside(rows: DataFrame, digest: Column, extra: DataFrame) -> DataFrame:
    """``rows`` with the linked spans of their own text, which are none for most."""
    none = F.array().cast(f"array<{SPAN}>")
    both = rows.join(extra, F.col("doc_id").eqNullSafe(F.col("link_id")) & (digest == F.col("link_digest")), "left")
    return both.withColumn("extra", F.coalesce("extra", none)).drop("link_id", "link_digest")


def scan(docs: DataFrame) -> DataFrame:
    """``doc_id, base, extra`` of every row; spans are sorted by start and kind.

    Null text is empty and has no spans. Every row has the spans of its own text: rows that share an id, or have none,
    are told apart by the text. Very long texts and texts with very many matches take time in proportion. An empty
    table gives an empty table.
    """
    found = materialize(candidates(docs))
    both = _beside(found, F.col("digest"), linked(found))
    return both.select("doc_id", F.array_sort("base").alias("base"), F.array_sort("extra").alias("extra"))


def _written(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["end"])), ",")


def report(found: DataFrame) -> DataFrame:
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias("n_" + KINDS[k])
    return found.select(
        "doc_id", count(0), count(1), count(2),
        F.sha2(_written(F.col("base")).cast("binary"), 256).alias("base_sha256"),
        _written(F.array_sort(F.concat("base", "extra"))).alias("spans"),
    )


def op5_secrets(spark, sf_dir: str) -> DataFrame:
    return report(scan(documents(spark, sf_dir)))


def _pieces(blocks: Column, gaps: Column) -> Column:
    """The code points ``[start, end)`` of a text that lies in blocks of BLOCK, for every gap: each touches its own
    blocks alone."""
    def piece(g: Column) -> Column:
        first, last = F.floor(g["start"] / BLOCK).cast("int"), F.floor((g["end"] - 1) / BLOCK).cast("int")
        at = lambda i: F.coalesce(F.try_element_at(blocks, i + 1), F.lit(""))
        one = F.substring(at(first), g["start"] % BLOCK + 1, g["end"] - g["start"])
        middle = F.array_join(F.slice(blocks, first + 2, F.greatest(last - first - 1, F.lit(0))), "")
        many = F.concat(F.substring(at(first), g["start"] % BLOCK + 1, F.lit(BLOCK)), middle, F.substring(at(last), F.lit(1), (g["end"] - 1) % BLOCK + 1))
        return F.when(g["end"] <= g["start"], F.lit("")).when(first == last, one).otherwise(many)

    return F.transform(gaps, piece)


def redact(docs: DataFrame, mark: str = "[secret]") -> DataFrame:
    """The documents with every found span replaced by ``mark``; ``n_chars`` follows where the table has it.

    Overlapping spans are replaced once. Every row loses the spans of its own text, whatever ids it shares. Null text
    stays null; texts without spans stay as they are; an empty table gives an empty table. Only documents with weak
    spans take part in a shuffle of spans; texts are joined to their linked spans by id and digest.
    """
    found = materialize(candidates(docs).filter(F.size("weak") > 0))
    extra = linked(found).select(F.col("link_id").alias("_secret_id"), F.col("link_digest").alias("_secret_digest"), F.col("extra").alias("_secret_extra"))
    same = F.col("doc_id").eqNullSafe(F.col("_secret_id")) & (F.md5(_text().cast("binary")) == F.col("_secret_digest"))
    none = F.array().cast(f"array<{SPAN}>")
    joined = docs.join(extra, same, "left").withColumn("_secret_spans", F.array_sort(F.concat(_base(_text()), F.coalesce("_secret_extra", none))))
    gap = "struct<start:int,end:int>"

    def step(at: Column, s: Column) -> tuple[Column, Column]:
        before = F.array(F.struct(at.alias("start"), s["start"].alias("end")))
        return F.greatest(at, s["end"]), F.when(s["start"] >= at, before).otherwise(F.array().cast(f"array<{gap}>"))

    joined = joined.withColumn("_secret_gaps", _gather(F.col("_secret_spans"), F.lit(0), step, gap))
    kept = F.concat(F.col("_secret_gaps.items"), F.array(F.struct(F.col("_secret_gaps.at").alias("start"), F.length("text").alias("end"))))
    blocks = F.regexp_extract_all("text", F.lit(rf"(?s).{{1,{BLOCK}}}"), F.lit(0))
    # bound as a lambda's own variable, else the blocks would be cut anew for every piece
    clean = F.element_at(F.transform(F.array(F.struct(blocks.alias("blocks"), kept.alias("gaps"))), lambda x: F.array_join(_pieces(x["blocks"], x["gaps"]), mark)), 1)
    hit = F.size("_secret_spans") > 0
    changed = joined.withColumn("text", F.when(hit, clean).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        changed = changed.withColumn("n_chars", F.when(hit, F.length("text").cast(dict(docs.dtypes)["n_chars"])).otherwise(F.col("n_chars")))
    return changed.select(*docs.columns)

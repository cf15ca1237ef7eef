"""Main text of web pages: page structure, then differencing against the page with the nearest URL."""

from __future__ import annotations

import html
import os
import re
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from sigmill.llm.common import documents, materialize, with_position

# Element names and words of class, id and role attributes.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title xmp noembed noframes".split())
INLINE = set(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd mark q rp rt ruby s samp small span "
    "strike strong sub sup time tt u var wbr".split()
)
NOT_TEXT = set(
    "head script style noscript template nav footer aside form button select textarea title iframe object svg canvas "
    "audio video dialog menu datalist fieldset xmp noembed noframes".split()
)
MAIN = {"article", "main"}
WHOLE = {"html", "body", "article", "main"}
HINTS = set(
    "ad ads adv advert adverts advertisement advertisements advertising adsense adbox sponsor sponsored sponsors promo promos "
    "promotion cookie cookies consent gdpr notice notices newsletter subscribe subscription signup sidebar sidebars aside menu menus "
    "nav navbar navigation breadcrumb breadcrumbs share sharing social comment comments disqus replies related recommended "
    "recommendations footer foot masthead topbar popup modal overlay login search pagination pager toolbar copyright "
    "banner".split()
)
# Of these, words that mean the same as parts of a longer name within an article, and those that even a paragraph may bear.
PLAIN_HINTS = set("adsense adbox disqus comment comments newsletter sidebar sidebars breadcrumb breadcrumbs cookie cookies".split())
ADVERTS = set("ad ads adv advert adverts advertisement advertisements adsense adbox sponsored promo newsletter cookie cookies consent".split())
TEXTUAL = set("p h1 h2 h3 h4 h5 h6 li dt dd td th pre blockquote figcaption".split())
ROLES = set("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())
IMPLIED = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
BOUNDS = {"ul", "ol", "dl", "table", "tbody", "thead", "div", "section", "article", "main", "body", "html", "nav", "aside", "header", "footer", "form", "blockquote"}

TAG = re.compile(r"""<(?:!--.*?(?:--!?>|\Z)|[!?][^>]*(?:>|\Z)|(/?)([A-Za-z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*)>|/?[A-Za-z][^>]*(?:>|\Z))""", re.S)
ATTRIBUTE = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
WORDS = re.compile(r"[A-Za-z]+")


#: How an element is treated: as text, left out unless it holds the only article, left out.
TEXT, HINTED, OUT = range(3)


def _treatment(tag: str, attributes: str, in_main: bool) -> int:
    """What element name and attributes say. Outside an article any part of a class or id may be a hint, within one a whole
    class or a part that can't be mistaken, and paragraphs and the like go only as adverts."""
    if tag in NOT_TEXT or (tag == "header" and not in_main):
        return OUT
    if not attributes or tag in ("html", "body"):
        return TEXT
    for name, value in ATTRIBUTE.findall(attributes):
        name, value = name.lower(), value.strip("\"'")
        if name == "hidden" or (name == "aria-hidden" and value.lower() == "true") or (name == "style" and HIDDEN.search(value)):
            return OUT
        if name == "role" and value.lower() in ROLES:
            return OUT
        if name in ("class", "id"):
            words = {w.lower() for part in WORDS.findall(value) for w in (part, *re.findall(r"[A-Z]?[a-z]+", part))}
            if tag == "article" and words & {"comment", "comments", "reply", "teaser", "ad", "promo", "related"}:
                return OUT
            if tag in WHOLE:
                continue
            if in_main:
                whole = set(value.lower().split())
                if whole & ADVERTS if tag in TEXTUAL else whole & HINTS or words & PLAIN_HINTS:
                    return OUT
            elif words & HINTS:
                return HINTED
    return TEXT


def blocks(page: str) -> list[tuple[str, bool]]:
    """Text blocks of a page in order, with whether each lies in an article or main element.

    Blocks below boilerplate elements are left out. An article or main element below one that a mere hint marks (a wrapper
    with the class ``no-sidebar``) counts if the page has none elsewhere and it holds more text than the rest. Inline
    elements and line breaks don't end a block. Character references are decoded, white space is made one space. A tag
    that the end of the page cuts off is dropped.
    """
    out: list[tuple[str, bool, int]] = []
    words: list[str] = []
    stack: list[tuple[str, int, bool]] = []  # name, treatment, below article or main
    at, drop, main = 0, TEXT, False

    def close() -> None:
        if words:
            text = " ".join("".join(words).split())
            if text:
                out.append((text, main, drop))
            words.clear()

    def cut(depth: int) -> None:
        nonlocal drop, main
        if any(name not in INLINE for name, _, _ in stack[depth:]):
            close()
        del stack[depth:]
        _, drop, main = stack[-1] if stack else ("", TEXT, False)

    while True:
        m = TAG.search(page, at)
        chunk = page[at : m.start() if m else len(page)]
        if chunk and (drop == TEXT or (drop == HINTED and main)):
            words.append(html.unescape(chunk))
        if not m:
            break
        at = m.end()
        tag = (m.group(2) or "").lower()
        if not tag:
            continue
        if m.group(1):
            for depth in range(len(stack) - 1, -1, -1):
                if stack[depth][0] == tag:
                    cut(depth)
                    break
            else:
                if tag not in INLINE:
                    close()
            continue
        if tag in VOID:
            if drop != OUT:
                if tag == "br":
                    words.append(" ")
                elif tag not in INLINE:
                    close()
            continue
        if tag not in INLINE:
            close()
            ends = IMPLIED.get(tag, set()) | {"p"}
            for depth in range(len(stack) - 1, -1, -1):
                if stack[depth][0] in ends:
                    cut(depth)
                    break
                if stack[depth][0] in BOUNDS:
                    break
        if tag in RAW:
            end = re.compile(rf"</{tag}[^>]*(?:>|\Z)", re.I).search(page, at)
            at = end.end() if end else len(page)
            continue
        if m.group(3).endswith("/") and tag in ("svg", "iframe"):
            continue
        below = max(drop, _treatment(tag, m.group(3), main))
        inside = main or tag in MAIN
        stack.append((tag, below, inside))
        drop, main = below, inside
    close()
    size = lambda kind: sum(len(t) for t, _, d in out if d == kind)
    hinted = not any(m and d == TEXT for _, m, d in out) and size(HINTED) > size(TEXT)
    return [(t, m) for t, m, d in out if d == TEXT or hinted]


def line_hashes(found: list[tuple[str, bool]]) -> list[int]:
    return [xxhash.xxh3_64_intdigest(t) - (1 << 63) for t, _ in found]


#: Cells of a table of line pairs that are kept as bits for finding the way back (32 MB).
CELLS = 1 << 28


def _rows(a: Sequence[int], b: Sequence[int], keep: bool) -> list[int]:
    """Bit rows of the longest common subsequence: bit ``j`` of row ``i`` is 0 where one line more of ``b`` makes it
    longer. Without ``keep``, the last row alone."""
    where: dict[int, int] = {}
    for j, x in enumerate(b):
        where[x] = where.get(x, 0) | 1 << j
    full = (1 << len(b)) - 1
    row, rows = full, [full]
    for x in a:
        hit = row & where.get(x, 0)
        row = ((row + hit) | (row - hit)) & full
        if keep:
            rows.append(row)
    return rows if keep else [row]


def common_lines(a: Sequence[int], b: Sequence[int]) -> set[int]:
    """Places in ``a`` of a longest common subsequence with ``b``.

    Equal ends are taken off first. The table of the rest is worked out a row of bits at a time, so many equal lines
    cost no more than different ones; a table of more than CELLS is halved, each half with the part of ``b`` that
    serves it best, so memory stays bounded.
    """
    found: set[int] = set()
    todo = [(0, len(a), 0, len(b))]
    while todo:
        i, n, j, m = todo.pop()
        while i < n and j < m and a[i] == b[j]:
            found.add(i)
            i, j = i + 1, j + 1
        while i < n and j < m and a[n - 1] == b[m - 1]:
            n, m = n - 1, m - 1
            found.add(n)
        if i == n or j == m:
            continue
        if (n - i) * (m - j) > CELLS and n - i > 1:
            mid = (i + n) // 2
            gains = lambda row, size: np.concatenate([[0], np.cumsum(1 - np.unpackbits(np.frombuffer(row.to_bytes(-(-size // 8), "little"), np.uint8), bitorder="little")[:size].astype(np.int64))])
            ahead = gains(_rows(a[i:mid], b[j:m], False)[0], m - j)
            behind = gains(_rows(a[mid:n][::-1], b[j:m][::-1], False)[0], m - j)[::-1]
            cut = j + int((ahead + behind).argmax())
            todo += [(i, mid, j, cut), (mid, n, cut, m)]
            continue
        rows = _rows(a[i:n], b[j:m], True)
        x, y = n - i, m - j
        while x and y:
            if a[i + x - 1] == b[j + y - 1]:
                x, y = x - 1, y - 1
                found.add(i + x)
            elif rows[x] >> (y - 1) & 1:
                y -= 1
            else:
                x -= 1
    return found


def dropped(own: Sequence[int], inside: Sequence[bool], mate: Sequence[int] | None) -> list[int] | None:
    """Numbers of a page's lines that go, or None if the page stays as it is.

    Lines that the page has in common, in order, with its nearest page are their site's template and go, except those
    of an article or main element: two articles may share a paragraph. Where there is an article but no mate to
    tell, all lines outside it go.
    """
    if mate is None:
        gone = [i for i, x in enumerate(inside) if not x] if any(inside) else []
    else:
        shared = common_lines(own, mate)
        gone = [i for i in sorted(shared) if not inside[i]]
    return gone or None


def main_text(page: str | None, gone: Sequence[int] | None) -> str:
    """The blocks of a page without those whose numbers are in ``gone``."""
    gone = set(gone or ())
    return "\n".join(t for i, (t, _) in enumerate(blocks(page or "")) if i not in gone)


@pandas_udf(T.IntegerType())
def _shared_start(a: pd.Series, b: pd.Series) -> pd.Series:
    """Length of the common beginning; -1 where there is nothing to compare."""
    return pd.Series([-1 if x is None or y is None else len(os.path.commonprefix([x, y])) for x, y in zip(a, b, strict=True)], dtype="int32")


def nearest(pages: DataFrame) -> DataFrame:
    """``page, mate`` of ``page, host, path``: of the two neighbours in the order of URL paths within the host, the one
    with the longer common beginning of the path (the former on a tie). Pages alone on their host have none."""
    placed = materialize(with_position(pages, "host", "path", "page"))
    other = placed.select("pos", F.struct("page", "host", "path").alias("x"))
    near = placed.join(other.select((F.col("pos") + 1).alias("pos"), F.col("x").alias("a")), "pos", "left").join(other.select((F.col("pos") - 1).alias("pos"), F.col("x").alias("b")), "pos", "left")
    path = lambda x: F.when(F.col(f"{x}.host") == F.col("host"), F.col(f"{x}.path"))
    near = near.select("page", "a", "b", _shared_start("path", path("a")).alias("na"), _shared_start("path", path("b")).alias("nb"))
    mate = F.when(F.greatest("na", "nb") < 0, F.lit(None)).when(F.col("na") >= F.col("nb"), F.col("a.page")).otherwise(F.col("b.page"))
    return near.select("page", mate.alias("mate")).filter("mate is not null")


def template_lines(pages: DataFrame) -> DataFrame:
    """``page_id, digest, gone``: of every page that loses lines, their numbers.

    Every page is parsed to the hashes of its lines. Pages of a host with equal lines tell nothing about each other:
    they count as one page, at the first of their URLs, and the nearest page with other lines is their mate. So copies
    lose the same lines, and a group of copies is compared once.
    """

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                found = [blocks(h or "") for h in part.column(4).to_pylist()]
                lines = [line_hashes(f) for f in found]
                one = [xxhash.xxh3_64_intdigest(np.array([*own, *(m for _, m in f)], np.int64).tobytes()) - (1 << 63) for own, f in zip(lines, found, strict=True)]
                columns = [*(part.column(i) for i in range(4)), pa.array(one, pa.int64()), pa.array(lines, pa.list_(pa.int64())), pa.array([[m for _, m in f] for f in found], pa.list_(pa.bool_()))]
                yield pa.RecordBatch.from_arrays(columns, ["page_id", "digest", "host", "path", "content", "lines", "inside"])

    host = F.lower(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))
    path = F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(.*)$", 1)
    # pages without a URL have no neighbours; each is its own host
    home = F.coalesce(host, F.concat(F.lit("\x00"), F.coalesce(F.col("page_id").cast("string"), F.lit("")), _digest()))
    rows = pages.select("page_id", _digest().alias("digest"), home.alias("host"), F.coalesce(path, F.lit("")).alias("path"), "html")
    lines = materialize(rows.mapInArrow(parse, "page_id long, digest string, host string, path string, content long, lines array<long>, inside array<boolean>"))
    first = lines.groupBy("host", "content").agg(F.min("path").alias("path"))
    name = lambda: F.struct("host", "content")
    mates = nearest(first.select(name().alias("page"), "host", "path"))
    what = lines.select("host", "content", "lines", "inside").dropDuplicates(["host", "content"]).select(name().alias("page"), "lines", "inside")
    what = materialize(what)
    pairs = what.join(mates, "page", "left").join(what.select(F.col("page").alias("mate"), F.col("lines").alias("other")), "mate", "left").select("page", "lines", "inside", "other")

    def differ(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            gone = [dropped(a, i, b) for a, i, b in zip(*(batch.column(k).to_pylist() for k in (1, 2, 3)), strict=True)]
            out = pa.RecordBatch.from_arrays([batch.column(0), pa.array(gone, pa.list_(pa.int32()))], ["page", "gone"])
            yield out.filter(out.column(1).is_valid())

    gone = materialize(pairs.mapInArrow(differ, "page struct<host:string,content:long>, gone array<int>")).select("page.host", "page.content", "gone")
    return lines.select("page_id", "digest", "host", "content").join(gone, ["host", "content"]).select("page_id", "digest", "gone").dropDuplicates(["page_id", "digest", "gone"])


def _digest():
    return F.md5(F.concat_ws("\x00", F.coalesce("html", F.lit("")), F.coalesce("url", F.lit(""))).cast("binary"))


def extract(pages: DataFrame) -> DataFrame:
    """``page_id, url, text, n_chars`` of every row.

    Boilerplate elements are left out while parsing; what remains is held against the nearest page of the site, whose
    lines in common go unless an article holds them. Null html gives empty text; a null or unreadable URL gives a page
    without neighbours. Rows that share an id are told apart by what they hold, and repeated rows have the same text.
    URLs that tie are ordered by what their pages hold. Very long pages are parsed in one pass each, and differenced in
    bounded memory. An empty table gives an empty table.
    """

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                out = [main_text(h, gone) for h, gone in zip(part.column(2).to_pylist(), part.column(3).to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(out, pa.string()), pa.array([len(t) for t in out], pa.int64())], ["page_id", "url", "text", "n_chars"])

    gone = materialize(template_lines(pages)).select(F.col("page_id").alias("gone_id"), F.col("digest").alias("gone_digest"), "gone")
    same = F.col("page_id").eqNullSafe(F.col("gone_id")) & (_digest() == F.col("gone_digest"))
    both = pages.select("page_id", "url", "html").join(gone, same, "left")
    return both.select("page_id", "url", "html", "gone").mapInArrow(texts, "page_id long, url string, text string, n_chars long")


def op3_htmltext(spark, sf_dir: str) -> DataFrame:
    return extract(documents(spark, sf_dir, "pages"))

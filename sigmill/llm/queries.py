"""The registered queries of this subpackage and the SQL that some of them are held against."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

#: Query name -> module of this package that has it.
NAMES = {
    "op1_quality": "quality",
    "op2_neardup": "neardup",
    "op3_htmltext": "htmltext",
    "op4_mixing": "mixing",
    "op5_secrets": "secrets",
    "op6_fingerprints": "fingerprints",
    "op7_packing": "packing",
    "op8_media": "media",
    "op9_tokencount": "tokencount",
    "op10_suffixdedup": "suffixdedup",
    "op11_filteraudit": "filteraudit",
    "op12_runs": "runs",
    "op13_bestfit": "patterns",
}

#: Kinds of secrets in order, their patterns, the group that must be so long, and that length.
SECRETS = [
    ("assign", r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 12),
    ("access", "AKIA[A-Z0-9]+", 0, 18), ("hex", "[0-9a-f]+", 0, 16),
    ("login", r"""(?i:user(?:name)?|login|account|client_?id|access_?key(?:_?id)?)["']?\x20*[:=]\x20*["']?[A-Za-z0-9@+/_.=-]{3,}""", 0, 0),
    ("blob", "[A-Za-z0-9+/_=-]+", 0, 0),
    ("endpoint", r"""(?:https?|ftp|ssh|postgres(?:ql)?|mysql|mongodb|redis|amqp)://[^\s"'<>]{4,}""", 0, 0),
]


def _located_sql() -> str:
    """CTEs ``patterns`` and ``cut``: matches, their values and the text between them, for every kind."""
    text = lambda x: "'" + x.replace("'", "''") + "'"
    values = ", ".join(f"({k}, '{name}', {least})" for k, (name, _, _, least) in enumerate(SECRETS))
    cut = " union all ".join(
        f"select doc_id, {k} as kind, regexp_extract_all(t, {text(p)}) as hits, regexp_extract_all(t, {text(p)}, {g}) as vals, regexp_split_to_array(t, {text(p)}) as gaps from texts"
        for k, (_, p, g, _) in enumerate(SECRETS)
    )
    return f"patterns(kind, name, least) as (values {values}),\ncut as ({cut})"


ORACLE_SQL: dict[str, str] = {
    "op2_neardup": r"""
with recursive words as (
  select doc_id, [x for x in regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x20\x09-\x0D]+') if x <> ''] as w
  from documents),
shingles as (
  select distinct doc_id, unnest(case when len(w) < 2 then w else [w[i] || ' ' || w[i + 1] for i in range(1, len(w))] end) as s from words),
sizes as (select doc_id, count(*) as n from shingles group by 1),
met as (
  select x.doc_id as a, y.doc_id as b, count(*) as both_have from shingles x join shingles y on x.s = y.s and x.doc_id < y.doc_id group by 1, 2),
links as (
  select a, b from met join sizes p on p.doc_id = a join sizes q on q.doc_id = b where 100 * both_have >= 80 * (p.n + q.n - both_have)),
ways as (select a, b from links union all select b, a from links),
reach as (select doc_id, doc_id as other from documents union select reach.doc_id, ways.b from reach join ways on ways.a = reach.other)
select doc_id, coalesce(max(n), 0) as n_shingles, min(other) as component_id, doc_id = min(other) as kept
from reach left join sizes using (doc_id) group by doc_id""",
    "op5_secrets": r"""
with texts as (select doc_id, coalesce(text, '') as t from documents),
PATTERNS,
each as (select doc_id, kind, unnest(range(len(hits))) as i, unnest(hits) as hit, unnest(vals) as val, unnest(gaps[1:len(hits)]) as gap from cut where len(hits) > 0),
placed as (
  select doc_id, kind, hit, val, (sum(length(gap) + length(hit)) over (partition by doc_id, kind order by i) - length(hit))::bigint as a from each),
-- a blob is what a run of such characters begins with, and must be long and mixed
shaped as (
  select doc_id, kind, a, val, case when kind = 4 then regexp_extract(hit, '^[A-Za-z0-9+/_-]+={0,2}') else hit end as hit, regexp_extract(hit, '^[A-Za-z0-9+/_-]+') as body from placed),
spans as (
  select doc_id, kind, a, a + length(hit) as b from shaped join patterns using (kind)
  where length(val) >= least and (kind <> 4 or (length(body) >= 24 and regexp_matches(body, '[0-9]') and regexp_matches(body, '[A-Z]') and regexp_matches(body, '[a-z]')))),
live as (
  select * from spans s where kind < 3 or not exists (select 1 from spans x where x.doc_id = s.doc_id and x.kind < 3 and x.a < s.b and s.a < x.b)),
met as (
  select s.doc_id, s.kind, s.a, s.b, bool_or(coalesce(x.kind in (1, 3), false)) as identifier, bool_or(coalesce(x.kind in (0, 2, 4), false)) as secret
  from live s left join live x on x.doc_id = s.doc_id and abs(x.a - s.a) <= 512 where s.kind >= 3 group by 1, 2, 3, 4),
told as (
  select doc_id, kind, a, b from spans where kind < 3 union all
  select doc_id, kind, a, b from met where (kind = 3 and secret) or (kind = 4 and identifier) or (kind = 5 and identifier and secret)),
written as (
  select doc_id, count(*) filter (kind = 0) as n_assign, count(*) filter (kind = 1) as n_access, count(*) filter (kind = 2) as n_hex,
    coalesce(string_agg(name || ':' || a || ':' || b, ',' order by a, kind) filter (kind < 3), '') as base, string_agg(name || ':' || a || ':' || b, ',' order by a, kind) as spans
  from told join patterns using (kind) group by doc_id)
select doc_id, coalesce(n_assign, 0) as n_assign, coalesce(n_access, 0) as n_access, coalesce(n_hex, 0) as n_hex, sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans
from documents left join written using (doc_id)""".replace("PATTERNS", _located_sql()),
    "op10_suffixdedup": """
with sized as (select doc_id, encode(coalesce(text, '')) as x, octet_length(encode(coalesce(text, ''))) as n from documents),
windows as (
  select doc_id, i, x[i + 1 : i + 50] as w from (select doc_id, x, unnest(range(0, n - 49)) as i from sized where n >= 50)),
firsts as (select w, min(doc_id) as least from windows group by w),
gone as (select doc_id, i from windows join firsts using (w) where least < doc_id),
marked as (
  select doc_id, i, case when i <= lag(i) over (partition by doc_id order by i) + 50 then 0 else 1 end as fresh from gone),
runs as (select doc_id, i, sum(fresh) over (partition by doc_id order by i) as run from marked),
spans as (select doc_id, min(i) as a, max(i) + 50 as b from runs group by doc_id, run),
pieces as (select doc_id, a, b, coalesce(lag(b) over (partition by doc_id order by a), 0) as before from spans),
joined as (
  select s.doc_id, s.x, s.n, sum(b - a) as n_removed, count(a) as n_spans, max(b) as last,
    string_agg(hex(x[before + 1 : a]), '' order by a) as head
  from sized s left join pieces p using (doc_id) group by s.doc_id, s.x, s.n)
select doc_id, n as n_bytes, coalesce(n_removed, 0)::bigint as n_removed, n_spans,
  sha256(unhex(coalesce(head, '') || hex(x[coalesce(last, 0) + 1 : n]))) as kept_sha256 from joined""",
    # every document goes through every step of every order
    "op11_filteraudit": r"""
with texts as (
  select doc_id, coalesce(source, '') as part, coalesce(text, '') as t, [x for x in regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+') if x <> ''] as w,
    doc_id in (select doc_id from labels where quality = 1) as good, doc_id in (select doc_id from labels where toxic = 1) as toxic from documents),
firsts as (select t, min(doc_id) as least from texts group by t),
judged as (
  select part, good, toxic, map {'A': len(w) < 50, 'B': 100 * len(list_distinct(w)) < 65 * len(w), 'C': 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * length(t),
    'D': regexp_matches(t, '[#$%&*|]'), 'E': coalesce(doc_id > least, false)} as fails
  from texts join firsts using (t)),
letters as (select unnest(['A', 'B', 'C', 'D', 'E']) as f),
orders as (
  select a.f || b.f || c.f || d.f || e.f as filter_order from letters a, letters b, letters c, letters d, letters e
  where len(list_distinct([a.f, b.f, c.f, d.f, e.f])) = 5),
steps as (select filter_order, unnest(range(1, 6)) as step from orders),
gone as (
  select part, good, toxic, filter_order, [x for x in string_split(filter_order, '') if fails[x]] as failed, len([x for x in string_split(filter_order, '') if fails[x]]) as n
  from judged, orders),
met as (
  select part, filter_order, step, filter_order[step] as f, count(*) filter (len(failed) = 0 or instr(filter_order, failed[1]) > step) as kept,
    count(*) filter (failed[1] = filter_order[step]) as removed, count(*) filter (list_contains(failed, filter_order[step]) and failed[1] <> filter_order[step]) as redundant,
    count(*) filter (n = 1 and failed[1] = filter_order[step]) as unique_fails, count(*) filter (good and failed[1] = filter_order[step]) as good_lost,
    count(*) filter (toxic and failed[1] = filter_order[step]) as toxic_lost
  from gone join steps using (filter_order) group by part, filter_order, step)
select part, filter_order, step::int as step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, sum(removed) over (partition by part, f)::bigint as shapley from met""",
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    import corpus_pipeline

    found = {name: getattr(importlib.import_module(f"sigmill.llm.{module}"), name) for name, module in NAMES.items()}
    return found | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    import corpus_pipeline

    return ORACLE_SQL | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})

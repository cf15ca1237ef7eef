"""The audit of filters, runs of words and pattern packing, against brute force."""

import itertools
import zlib
from collections import Counter, defaultdict
from hashlib import sha256

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sigmill.llm import filteraudit, patterns, queries
from sigmill.llm import runs as R
from tests.llm.conftest import SF, rows

# ---- audit -------------------------------------------------------------------------------------------------------


def test_audit_is_its_sql(spark):
    got = filteraudit.op11_filteraudit(spark, SF)
    con = duckdb.connect()
    for name in ("documents", "labels"):
        con.execute(f"create view {name} as select * from '{SF}/{name}.parquet'")
    want = con.execute(queries.ORACLE_SQL["op11_filteraudit"]).df()
    key = ["part", "filter_order", "step"]
    got = got.toPandas()[list(want.columns)].sort_values(key, ignore_index=True)
    assert (got == want.sort_values(key, ignore_index=True)).all(axis=None)


def brute_audit(docs: list[tuple], labels: dict) -> dict:
    """(part, order, step) -> counts, one document after the other; ``docs`` are id, text, source."""
    least: dict = {}
    for i, text, _ in docs:
        if i is not None:
            least[text or ""] = min(i, least.get(text or "", i))
    out = defaultdict(lambda: [0] * 6)
    parts = {s or "" for _, _, s in docs}
    for part, order in itertools.product(parts, itertools.permutations("ABCDE")):
        for k in range(5):
            out[part, "".join(order), k + 1]
    for i, text, source in docs:
        t = text or ""
        w = [x for x in t.encode().split() if x]
        fails = {"A": len(w) < 50, "B": 100 * len(set(w)) < 65 * len(w), "C": 100 * sum("A" <= c <= "Z" for c in t) > 5 * len(t), "D": any(c in "#$%&*|" for c in t), "E": i is not None and i > least[t]}
        good, toxic = labels.get(i, (0, 0))
        for order in itertools.permutations("ABCDE"):
            alive = True
            for k, f in enumerate(order):
                row = out[source or "", "".join(order), k + 1]
                gone = alive and fails[f]
                row[1] += gone
                row[2] += fails[f] and not alive
                row[3] += fails[f] and sum(fails.values()) == 1
                row[4] += gone and good == 1
                row[5] += gone and toxic == 1
                alive = alive and not fails[f]
                row[0] += alive
    return out


def check_audit(spark, docs, labels):
    table = [(r["doc_id"], r["text"], r["source"]) for r in docs.select("doc_id", "text", "source").collect()]
    marks = {}
    for i, q, t in rows(labels.select("doc_id", "quality", "toxic")):
        a, b = marks.get(i, (0, 0))
        marks[i] = (max(a, int(q == 1)), max(b, int(t == 1)))
    marks.pop(None, None)
    want = brute_audit(table, marks)
    shapley = Counter()
    for (part, order, step), row in want.items():
        shapley[part, order[step - 1]] += row[1]
    got = {(r["part"], r["filter_order"], r["step"]): [r[c] for c in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")] + [r["shapley"]] for r in filteraudit.audit(docs, labels).collect()}
    assert got == {k: [*v, shapley[k[0], k[1][k[2] - 1]]] for k, v in want.items()}


def test_audit_of_odd_rows(spark, odd, none):
    labels = spark.createDataFrame([(1, 1, 0), (6, 1, 1), (6, 0, 1), (9, None, 1), (None, 1, 1), (10, 0, None), (99, 1, 1)], "doc_id long, quality int, toxic int")
    check_audit(spark, odd, labels)
    assert filteraudit.audit(none, labels).count() == 0
    check_audit(spark, odd, labels.filter("false"))


def test_audit_of_copies_over_sources(spark):
    texts = ["A B c", "word " * 60, "one two three " * 30, " ".join(f"w{i}" for i in range(80)), "#" + " ".join(f"v{i}" for i in range(60))]
    docs = [(i, texts[i * i % 5], ["x", "y", None, ""][i % 4]) for i in range(60)] + [(3, texts[3], "y"), (3, texts[0], "z"), (None, texts[1], "x")]
    labels = spark.createDataFrame([(i, i % 2, int(i % 3 == 0)) for i in range(0, 60, 2)], "doc_id long, quality int, toxic int")
    check_audit(spark, spark.createDataFrame(docs, "doc_id long, text string, source string").repartition(4), labels)


# ---- runs --------------------------------------------------------------------------------------------------------


def brute_runs(w: list) -> list[tuple]:
    n, found = len(w), {}
    for q in range(1, n // 4 + 1):
        i = 0
        while i < n - q:
            j = i
            while j < n - q and w[j] == w[j + q]:
                j += 1
            if j > i and j + q - i >= max(6, 4 * q):
                found.setdefault((i, j + q), q)
            i = max(j, i + 1)
    return sorted((s, e, q) for (s, e), q in found.items())


def as_rows(texts: list[list]) -> list[list[tuple]]:
    x = np.array([v for t in texts for v in t], np.int64)
    got = R.runs(x, np.repeat(np.arange(len(texts)), [len(t) for t in texts]))
    base = np.cumsum([0] + [len(t) for t in texts])
    return [sorted((s - base[k], e - base[k], q) for d, s, e, q in got.tolist() if d == k) for k in range(len(texts))]


def repeated(block: tuple) -> list:
    words, n = block
    return (words * 12)[:n]


BLOCKS = st.tuples(st.lists(st.integers(0, 3), min_size=1, max_size=9), st.integers(0, 70)).map(repeated)
TEXTS = st.lists(st.lists(BLOCKS, max_size=6).map(lambda b: sum(b, [])), min_size=1, max_size=6)


@settings(max_examples=150, deadline=None)
@given(TEXTS)
def test_runs_are_all_found(texts):
    assert as_rows(texts) == [brute_runs(t) for t in texts]


def test_candidates_that_are_no_two_periods_give_no_run():
    four = [0, 2, 1, 2]
    text = [0] * 9 + [1] * 12 + [2, 1, 2, 0] * 5 + [2, 0, 0] + four * 12 + [0, 0]
    assert brute_runs(text) == [(0, 9, 1), (9, 21, 1), (21, 42, 4), (44, 93, 4)]
    texts = [[0] * 11, text]
    assert as_rows(texts) == [brute_runs(t) for t in texts]


def test_runs_in_words_of_few_letters():
    rng = np.random.default_rng(5)
    for letters in (2, 3):
        texts = [rng.integers(0, letters, n).tolist() for n in (0, 1, 5, 6, 300, 900)]
        assert as_rows(texts) == [brute_runs(t) for t in texts]


def test_grammar_derives_its_texts():
    rng = np.random.default_rng(2)
    x, doc = rng.integers(0, 4, 500), np.repeat([0, 1, 2], [200, 0, 300][:1] + [100, 200])
    g = R.Grammar(x, doc)
    assert len(g.rule) == len(x) - 3  # every derivation has one cut between two words
    places = set()
    for rule, at in zip(g.rule, g.at, strict=True):
        size = g.hi[rule] - g.lo[rule]
        assert (x[at : at + size] == x[g.lo[rule] : g.hi[rule]]).all() and doc[at] == doc[at + size - 1]
        places.add(at + g.cut[rule] - g.lo[rule])
    assert len(places) == len(x) - 3


def test_long_periodic_text_is_quick():
    n = 300_000
    for period in (1, 7, 4999):
        assert as_rows([(np.arange(n) % period).tolist()]) == [[(0, n, period)]]


def test_runs_do_not_depend_on_batches(monkeypatch):
    texts = [[1, 2, 3] * 20, [1, 2] * 9 + [5], [7] * 30 + [1, 2, 3] * 5]
    want = as_rows(texts)
    monkeypatch.setattr(R, "CANDIDATES", 3)
    monkeypatch.setattr(R, "CELLS", 8)
    assert as_rows(texts) == want == [as_rows([t])[0] for t in texts]


def brute_row(doc, text):
    w = (text or "").encode().split()
    n = len(w)
    h = zlib.crc32(str(doc).encode()) if doc is not None else 1
    if h % 10 == 0 and n:
        g = h // 10
        a, p = g % n, 1 + (n - g % n) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    found = brute_runs(w)
    gone = {i for s, e, q in found for i in range(s + q, e)}
    best = min(((s - e, s, q) for s, e, q in found), default=None)
    line = "".join(f"{s},{e - s},{q}\n" for s, e, q in found)
    main = (best[1], -best[0], best[2], -1000 * best[0] // best[2]) if best else (None,) * 4
    return (doc, len(found), *main, sha256(line.encode()).hexdigest(), sha256(b" ".join(x for i, x in enumerate(w) if i not in gone)).hexdigest())


def test_op12_against_brute_force(docs, table):
    short = table[table["text"].str.len() < 12000]
    got = {r[0]: r for r in rows(R.find_runs(docs))}
    assert len(got) == len(table)
    for doc, text in zip(short["doc_id"], short["text"], strict=True):
        assert got[doc] == brute_row(int(doc), text)


def test_runs_of_odd_rows(odd, none):
    long = 7  # brute force is slow on it
    want = Counter(brute_row(r["doc_id"], r["text"]) for r in odd.collect() if r["doc_id"] != long)
    got = rows(R.find_runs(odd))
    assert Counter(r for r in got if r[0] != long) == want and len(got) == odd.count()
    assert [r for r in got if r[0] == long][0][1] == 1
    assert R.find_runs(none).count() == 0


# ---- pattern packing ---------------------------------------------------------------------------------------------


def encoded(texts: list[str]) -> list[list[int]]:
    ids, bounds = patterns.encode(patterns.tokenizer_path(), pa.array(texts, pa.string()))
    return [ids[a:b].tolist() for a, b in itertools.pairwise(bounds.tolist())]


def plainly(texts: list[str]) -> list[list[int]]:
    return [e.ids + [0] for e in patterns.tokenizer(patterns.tokenizer_path()).encode_batch(texts, add_special_tokens=False)]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.sampled_from([*"ab Z19.,'-\n\t\r é日\u0301\u00a0\u3000\x1c\x00", "'s", "<|endoftext|>", "  ", "don't"]), max_size=30).map("".join), min_size=1, max_size=8))
def test_ids_are_the_tokenizers(texts):
    assert encoded(texts) == plainly(texts)


def test_ids_of_whole_texts(table):
    texts = table["text"].tolist()
    assert encoded(texts) == plainly(texts)


def test_known_chunks_are_bounded(table, monkeypatch):
    monkeypatch.setattr(patterns, "KNOWN", 50)
    patterns.known.cache_clear()
    texts = table["text"].tolist()[:60]
    want = plainly(texts)
    for _ in range(2):
        assert encoded(texts) == want and len(patterns.known(patterns.tokenizer_path()).chunks) == 50
    patterns.known.cache_clear()


def used(planned, window):
    out = np.zeros(window + 1, np.int64)
    for pattern, n in planned:
        assert n > 0 and sum(pattern) <= window
        for m in pattern:
            out[m] += n
    return out


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 30), min_size=24, max_size=24))
def test_plans_use_every_piece_once(counts):
    histogram = np.array([0, *counts])
    assert (used(patterns.plan(histogram), 24) == histogram).all()
    assert (used(patterns.best_fit(histogram), 24) == histogram).all()


def test_fit_is_a_least_squares_optimum():
    """No pattern of up to three lengths, of all there are, can gain: the conditions of the optimum hold up to the stopping rule."""
    window = 24
    histogram = np.append(0, np.random.default_rng(3).integers(1, 40, window))
    fitted = patterns.fit(histogram)
    square = np.arange(window + 1) / window + 0.05
    off = histogram.astype(float).copy()
    for pattern, x in fitted:
        assert x > 0 and sum(pattern) == window and len(pattern) <= patterns.MEMBERS
        for m in pattern:
            off[m] -= x
    every = [p for k in (1, 2, 3) for p in itertools.combinations_with_replacement(range(1, window + 1), k) if sum(p) == window]
    gains = [sum(square[m] * off[m] for m in p) for p in every]
    assert max(gains) < 0.05 and max(abs(sum(square[m] * off[m] for m in p)) for p, _ in fitted) < 0.05


def test_few_sequences():
    rng = np.random.default_rng(1)
    lengths = np.minimum(2048, np.maximum(1, rng.lognormal(5.5, 1.2, 40000)).astype(int))
    histogram = np.bincount(lengths, minlength=2049)
    n = sum(c for _, c in patterns.plan(histogram))
    least = max(-(-int(lengths.sum()) // 2048), int((lengths > 1024).sum()))
    assert n <= 1.002 * least


def check_packing(docs, window=2048):
    want = Counter()
    size = 0
    for r in docs.select("doc_id", "text").collect():
        ids = plainly([r["text"] or ""])[0]
        size += len(ids)
        start = 0
        for k in range(-(-len(ids) // window)):
            n = (len(ids) - 1) % window + 1 if k == 0 else window
            want[r["doc_id"], k, start, n, zlib.crc32(np.array(ids[start : start + n], "<u4").tobytes())] += 1
            start += n
    got = rows(patterns.pack_patterns(docs, window=window))
    assert Counter(r[:5] for r in got) == want
    sequences = defaultdict(list)
    for _, _, _, n, _, s, offset in got:
        sequences[s].append((offset, n))
    for pieces in sequences.values():
        at = 0
        for offset, n in sorted(pieces):
            assert offset == at
            at += n
        assert at <= window
    return len(sequences), size


@pytest.mark.parametrize("window", [2048, 100])
def test_pieces_and_sequences(docs, window):
    n, size = check_packing(docs, window)
    assert n <= 1.02 * size / window + 1


def test_packing_of_odd_rows(odd, none):
    check_packing(odd)
    assert patterns.pack_patterns(none).count() == 0

"""Near-duplicates and repeated passages against brute force."""

import hashlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from sigmill.llm import neardup, suffixdedup
from sigmill.llm.components import components
from tests.llm.conftest import SF


def words(text):
    return (text or "").encode().lower().split()


def shingle_set(text, k):
    w = words(text)
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def brute_components(sets):
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    where = defaultdict(list)
    for i in sorted(sets):
        met = Counter(j for s in sets[i] for j in where[s])
        for j, n in met.items():
            if 100 * n >= 80 * (len(sets[i]) + len(sets[j]) - n):
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
        for s in sets[i]:
            where[s].append(i)
    return {i: root(i) for i in sets}


def test_components_of_paths_rings_and_stars(spark):
    edges = [(i, i + 1) for i in range(10, 40)] + [(50, 60), (60, 70), (70, 50), (5, 5)] + [(100, 100 + i) for i in range(1, 30)]
    got = dict(components(spark.createDataFrame(edges + edges[:5], "a long, b long")).collect())
    assert got == {i: 10 for i in range(10, 41)} | {i: 50 for i in (50, 60, 70)} | {100 + i: 100 for i in range(30)}


def test_whole_table(spark):
    got = neardup.op2_neardup(spark, SF).toPandas().set_index("doc_id")
    table = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    sets = {r[0]: shingle_set(r[1], 2) for r in table}
    want = brute_components(sets)
    assert got["component_id"].to_dict() == want
    assert got["n_shingles"].to_dict() == {i: len(s) for i, s in sets.items()}
    assert (got["kept"] == (got.index == got["component_id"])).all()


@pytest.mark.parametrize("block", [3, 512])
def test_chains_of_edits(spark, monkeypatch, block):
    """Each text shares most of its words with the one before, so links chain; stars alone lose some."""
    monkeypatch.setattr(neardup, "BLOCK", block)
    monkeypatch.setattr(neardup, "TASK_ROWS", 10 * block)
    rng = np.random.default_rng(3)
    w = [f"w{i}" for i in rng.integers(0, 500, 120)]
    rows = []
    for i in range(40):
        rows.append((i, " ".join(w)))
        w[int(rng.integers(0, 120))] = f"new{i}"
        w[int(rng.integers(0, 120))] = f"more{i}"
    got = dict(neardup.link(spark.createDataFrame(rows, "doc_id long, text string"), words=2).select("doc_id", "component_id").collect())
    assert got == brute_components({i: shingle_set(t, 2) for i, t in rows})


def test_many_near_misses_of_a_large_group(spark, monkeypatch):
    """Those that ask one block go to several tasks, by their number and by the size of their sets, and find all links."""
    monkeypatch.setattr(neardup, "BLOCK", 8)
    monkeypatch.setattr(neardup, "TASK_ROWS", 40)
    monkeypatch.setattr(neardup, "TASK_SHINGLES", 40 * 200)
    dealt = []
    monkeypatch.setattr(neardup, "deal", lambda *a, f=neardup.deal: dealt.append(f(*a)) or dealt[-1])
    base = [f"w{i}" for i in range(200)]
    change = lambda n, mark: [f"{mark}{i}" if i < n else w for i, w in enumerate(base)]
    rows = [(i, " ".join(change(i % 12, f"a{i}x"))) for i in range(40)] + [(1000 + i, " ".join(change(28 + i % 8, f"b{i}x"))) for i in range(300)]
    got = dict(neardup.link(spark.createDataFrame(rows, "doc_id long, text string"), words=2).select("doc_id", "component_id").collect())
    assert got == brute_components({i: shingle_set(t, 2) for i, t in rows})
    units = dealt[0].selectExpr("asks", "inline(units)").groupBy("group", "block", "salt").agg({"asks": "sum"}).collect()
    assert sum(r[3] for r in units) > 300 and max(r[3] for r in units) < 80


def test_odd_rows(odd, none):
    got = {(r["doc_id"], r["n_shingles"]): (r["component_id"], r["kept"]) for r in neardup.link(odd, words=2).collect()}
    assert got[(1, 0)] == (1, True) and got[(2, 0)] == (2, True) and got[(3, 0)] == (3, True)
    assert got[(4, 1)] == (4, True) and got[(10, 1)] == (4, False)
    assert [v for (d, _), v in got.items() if d in (5, 6)] == [(5, True), (5, False)]
    assert [v for (d, _), v in got.items() if d is None] == [(None, True)]
    assert neardup.link(none).count() == 0
    assert neardup.keep_one(odd).columns == odd.columns


def test_signature_is_unbiased():
    rng = np.random.default_rng(0)
    a = rng.integers(0, 1 << 63, 400, dtype=np.uint64)
    b = np.concatenate([a[:300], rng.integers(0, 1 << 63, 100, dtype=np.uint64)])
    family = neardup.MinMax(200, 7)
    assert abs((family.values(a) == family.values(b)).mean() - 300 / 500) < 0.05


def brute_removed(rows, n=50):
    seen, out = set(), {}
    for doc, text in sorted(rows):
        raw = (text or "").encode()
        mark = np.zeros(len(raw), bool)
        windows = [raw[k : k + n] for k in range(len(raw) - n + 1)]
        for k, w in enumerate(windows):
            if w in seen:
                mark[k : k + n] = True
        seen.update(windows)
        kept = bytes(np.frombuffer(raw, np.uint8)[~mark])
        runs = int((mark & ~np.concatenate([[False], mark[:-1]])).sum())
        out[doc] = (len(raw), int(mark.sum()), runs, hashlib.sha256(kept).hexdigest())
    return out


def test_repeats_of_the_small_table(spark, docs, table):
    got = {r[0]: tuple(r)[1:] for r in suffixdedup.remove(docs).collect()}
    assert got == brute_removed(zip(table["doc_id"], table["text"], strict=True))


def test_repeats_at_borders_periods_and_seams(spark, monkeypatch):
    """Small pieces, buffers, buckets and shards, so that every seam is crossed."""
    monkeypatch.setattr(suffixdedup, "PIECE", 64)
    monkeypatch.setattr(suffixdedup, "BUFFER", 512)
    monkeypatch.setattr(suffixdedup, "BUCKET_BYTES", 4096)
    monkeypatch.setattr(suffixdedup, "BUCKET_CONTEXTS", 50)
    monkeypatch.setattr(suffixdedup, "SHARD", 700)
    rng = np.random.default_rng(5)
    text = lambda n: "".join(rng.choice(list("abcd"), n))
    passage = text(140)
    rows = [(i, text(int(rng.integers(0, 200))) + passage[int(rng.integers(0, 80)) : int(rng.integers(90, 141))] + text(int(rng.integers(0, 120)))) for i in range(60)]
    rows += [(100, "a" * 300), (101, "ab" * 150), (102, "b" + "a" * 70), (103, passage), (104, passage), (105, "abc" * 100), (106, "x" + "ab" * 30)]
    got = {r[0]: tuple(r)[1:] for r in suffixdedup.remove(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    assert got == brute_removed(rows)


@pytest.mark.parametrize("sampled", [True, False])
def test_one_passage_in_many_surroundings(spark, monkeypatch, sampled):
    """Contexts of an anchor that most rows have are dealt over many tasks, whether or not the sample shows it."""
    monkeypatch.setattr(suffixdedup, "BUCKET_CONTEXTS", 100)
    monkeypatch.setattr(suffixdedup, "HOT", 50)
    monkeypatch.setattr(suffixdedup, "BUCKET_WINDOWS", 500)
    if not sampled:
        monkeypatch.setattr(suffixdedup, "hot_anchors", lambda *a: np.empty(0, np.uint64))
    dealt = []
    monkeypatch.setattr(suffixdedup, "deal", lambda *a, f=suffixdedup.deal: dealt.append(f(*a)) or dealt[-1])
    rng = np.random.default_rng(6)
    text = lambda n: "".join(rng.choice(list("abcdefgh"), n))
    passage, line = text(90), "\n" + "-" * 40 + "\n"
    rows = [(i, text(int(rng.integers(0, 60))) + (passage if i % 3 else line) + text(int(rng.integers(20, 60)))) for i in range(600)]
    got = {r[0]: tuple(r)[1:] for r in suffixdedup.remove(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    assert got == brute_removed(rows)
    loads = dealt[0].groupBy((dealt[0]["shard"] < 0).alias("hot"), "shard").agg({"n": "sum"}).collect()
    assert sum(r[2] for r in loads if r["hot"]) > 3000  # the windows of the hot anchors
    assert max(r[2] for r in loads if not r["hot"]) < 400 and max(r[2] for r in loads if r["hot"]) < 1500


def test_suffix_array_and_prefixes():
    rng = np.random.default_rng(1)
    s = np.concatenate([rng.integers(0, 3, 400), [9]])
    order = suffixdedup.suffix_array(s, len(s))
    want = sorted(range(len(s)), key=lambda i: s[i:].tolist())
    assert order.tolist() == want
    lcp = suffixdedup.common_prefixes(s, order, 50)
    for k in range(1, len(s)):
        a, b = s[order[k - 1] :], s[order[k] :]
        n = min(len(a), len(b))
        differ = np.flatnonzero(a[:n] != b[:n])
        assert lcp[k] == min(50, differ[0] if len(differ) else n)


def test_repeats_of_odd_rows(odd, none):
    got = {r[0]: tuple(r)[1:] for r in suffixdedup.remove(odd).collect() if r[0] is not None}
    rows = {(r["doc_id"], r["text"]) for r in odd.collect() if r["doc_id"] is not None}
    assert got == brute_removed(rows)
    assert suffixdedup.remove(none).count() == 0


def test_a_bucket_of_unlike_members_asks_in_proportion(spark):
    """Two thousand components in one bucket: one row a member, and tasks join them without giving out all pairs."""
    n = 2000
    buckets = spark.createDataFrame([(5, 0, i, 100) for i in range(n)], "bucket long, hub long, node long, size long")
    groups = spark.createDataFrame([], "node long, component long")
    asks, nodes = neardup.cross_asks(buckets, groups, 80)
    assert asks.count() == n - 1 and nodes.count() == 2 * n
    same = spark.createDataFrame([(i, list(range(100)) + [10**6 + i]) for i in range(n)], "doc_id long, shingles array<long>")
    got = neardup.cross_links(buckets, groups, same, 80)
    assert got.count() < 6 * n and dict(components(got).collect()) == dict.fromkeys(range(n), 0)


def test_recall_near_the_threshold():
    """Pairs of a similarity of 0.80 to 0.85 share a band (the candidates of all later steps)."""
    rng = np.random.default_rng(8)
    family = neardup.MinMax()
    met = 0
    for k in range(2000):
        union = int(rng.integers(60, 600))
        both = int(np.ceil(union * rng.uniform(0.8, 0.85)))
        x = rng.integers(0, 1 << 63, union, dtype=np.uint64)
        a, b = x[: both + (union - both) // 2], np.concatenate([x[:both], x[both + (union - both) // 2 :]])
        met += bool((family.keys(np.unique(a)) == family.keys(np.unique(b))).any())
    print(met)
    assert met >= 1996

"""The pipeline: what its stages return, and that their decisions take effect."""

from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from sigmill.llm import quality
from tests.llm.conftest import SF
from tests.llm.test_documents import all_spans, check_packing, targets
from tests.llm.test_near_and_repeats import brute_components, shingle_set


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs.cache()]
    for _, f in corpus_pipeline.STAGES:
        out.append(f(spark, out[-1], SF).cache())
    return out


@pytest.fixture(scope="module")
def packed(spark):
    return corpus_pipeline.run(spark, SF).toPandas()


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


def test_order_and_columns(stages):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "neardup", "secrets", "mixing", "packing"]
    assert all(s.columns == stages[0].columns for s in stages[:-1])


def test_each_stage_works_on_what_the_one_before_kept(spark, stages):
    docs, good, single, clean, mixed, packed = stages
    ids = lambda df: {r[0] for r in df.select("doc_id").collect()}
    assert ids(docs) > ids(good) > ids(single) == ids(clean) >= ids(mixed) == ids(packed)
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    known = docs.join(labels, "doc_id")
    share = lambda q: known.filter(f"quality = {q}").join(good, "doc_id", "left_semi").count() / known.filter(f"quality = {q}").count()
    assert share(1) > 0.95 and share(0) < 0.5
    assert clean.join(single.select("doc_id", "text"), ["doc_id", "text"], "left_anti").count() > 0  # some texts were redacted
    assert mixed.groupBy("doc_id").count().agg({"count": "max"}).first()[0] <= 3


def test_near_copies_share_runs_of_five_words(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    groups = brute_components({r[0]: shingle_set(r[1], 5) for r in docs.select("doc_id", "text").collect()})
    got = {r[0] for r in corpus_pipeline.neardup(spark, docs, SF).select("doc_id").collect()}
    assert got == {i for i, g in groups.items() if i == g}


def test_run_packs_all_tokens(stages, packed):
    assert packed["length"].sum() == stages[-1].agg({"length": "sum"}).first()[0]


def test_kept_rows_score_well(spark, stages):
    model = quality.fit(stages[0], spark.read.parquet(f"{SF}/labels.parquet"))
    assert quality.score_documents(stages[1], model).filter("score < 0.5").count() == 0


# ---- every stage against brute force on what the one before it kept ------------------------------------------------


def naive_score(model, text):
    """The network chunk by chunk."""
    raw, starts = text.encode(), [0]
    while starts[-1] + quality.WIDTH < len(raw):
        starts.append(starts[-1] + quality.STEP)
    best = np.full(quality.FILTERS, -np.inf)
    for s in starts:
        chunk = raw[s : s + quality.WIDTH].ljust(quality.WIDTH, b"\0")
        best = np.maximum(best, np.concatenate([model.embed[b] for b in chunk]) @ model.kernel + model.bias)
    return 1 / (1 + np.exp(-(np.maximum(best, 0) @ model.out + model.shift)))


def naive_redaction(text):
    out, at = "", 0
    for a, _, b in all_spans(text):
        if a >= at:
            out += text[at:a] + "[secret]"
        at = max(at, b)
    return out + text[at:]


def test_quality_stage_against_a_naive_network(spark, stages):
    model = quality.fit(stages[0], spark.read.parquet(f"{SF}/labels.parquet"))
    score = {i: naive_score(model, r["text"] or "") for i, r in by_id(stages[0]).items()}
    clear = {i for i, s in score.items() if abs(s - 0.5) > 1e-3}
    assert len(clear) > 0.99 * len(score)
    assert set(by_id(stages[1])) & clear == {i for i in clear if score[i] >= 0.5}


def test_neardup_stage_against_all_pairs(stages):
    good, single = by_id(stages[1]), by_id(stages[2])
    groups = brute_components({i: shingle_set(r["text"], 5) for i, r in good.items()})
    assert single == {i: good[i] for i, g in groups.items() if i == g}


def test_secrets_stage_against_brute_force(stages):
    single, clean = by_id(stages[2]), by_id(stages[3])
    for i, r in single.items():
        assert clean[i]["text"] == (None if r["text"] is None else naive_redaction(r["text"])), i
        assert clean[i]["n_chars"] == len(clean[i]["text"] or "") and clean[i]["source"] == r["source"]


def test_mixing_stage_against_rates_in_numpy(stages):
    clean, mixed = by_id(stages[3]), stages[4].collect()
    assert all(r == clean[r["doc_id"]] for r in mixed)
    copies = Counter(r["doc_id"] for r in mixed)
    size = {i: len((r["text"] or "").encode().split()) for i, r in clean.items()}
    members = {}
    for i, r in clean.items():
        members.setdefault(r["source"], []).append(i)
    want = targets({s: sum(size[i] for i in ids) for s, ids in members.items()})
    for s, ids in members.items():
        n, got = np.array([size[i] for i in ids], float), np.array([copies[i] for i in ids])
        x, lo, hi = n / n[n > 0].mean(), -1e4, 1e4
        for _ in range(200):
            mid = (lo + hi) / 2
            lo, hi = (mid, hi) if (n * np.minimum(3, np.exp(np.minimum(mid * x, 50)))).sum() < want[s] else (lo, mid)
        rate = np.minimum(3, np.exp(np.minimum(lo * x, 50)))
        assert (got >= np.floor(rate - 1e-6)).all() and (got <= np.floor(rate + 1e-6) + 1).all() and got.max() <= 3
        assert abs((got * n).sum() - want[s]) <= max(n.max(), 0.01 * want[s])


def test_run_packs_the_mix_to_the_token(stages, packed):
    check_packing(packed, [(r["doc_id"], r["text"]) for r in stages[4].collect()])


@pytest.mark.parametrize("which", ["odd", "none"])
def test_run_on_odd_and_empty_tables(spark, tmp_path, request, which):
    """Nulls, empty and very long texts, repeated rows and clashing columns; without labels every row is accepted."""
    at = str(tmp_path)
    request.getfixturevalue(which).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    docs = spark.read.parquet(f"{at}/documents.parquet")
    done = [docs]
    for _, f in corpus_pipeline.STAGES[:-1]:
        done.append(f(spark, done[-1], at).cache())
        assert done[-1].columns == docs.columns
    groups = brute_components({r["doc_id"]: shingle_set(r["text"], 5) for r in docs.collect() if r["doc_id"] is not None})
    ids = lambda df: Counter(r["doc_id"] for r in df.collect())
    single = {i for i, g in groups.items() if i == g} | ({None} if which == "odd" else set())
    assert ids(done[1]) == ids(docs) and set(ids(done[2])) == single and ids(done[3]) == ids(done[2])
    assert not any("abcdef123456" in (r["text"] or "") for r in done[3].collect())
    copies = ids(done[4])
    assert set(copies) <= single and all(n <= 3 for n in copies.values())
    tokens = {r["doc_id"]: (r["n"], r["whole"]) for r in corpus_pipeline.run(spark, at).groupBy("doc_id").agg({"length": "sum", "doc_tokens": "max"}).toDF("doc_id", "a", "b").selectExpr("doc_id", "greatest(a, b) n", "least(a, b) whole").collect()}
    assert {i: n / whole for i, (n, whole) in tokens.items()} == dict(copies)

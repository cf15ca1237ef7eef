"""Operators on single documents against brute force, round trips and held-out accuracy."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from sigmill.llm import fingerprints, htmltext, media, mixing, packing, quality, secrets, tokencount
from sigmill.llm.common import with_position
from tests.llm.conftest import SF, SMALL, pandas, rows


# ---- quality -----------------------------------------------------------------------------------------------------


def test_quality_on_held_out_rows(spark):
    got = pandas(quality.op1_quality(spark, SF))
    assert got["score"].between(0, 1).all() and ((got["score"] >= 0.5) == (got["predicted"] == 1)).all()
    assert (got["held_out"] == [zlib.crc32(str(d).encode()) % 3 == 1 for d in got["doc_id"]]).all()
    known = got.merge(pd.read_parquet(f"{SF}/labels.parquet"), on="doc_id")
    held = known[known["held_out"]]
    s, y = held["score"].to_numpy(), held["quality"].to_numpy()
    auc = np.mean([(s[y == 1][:, None] > s[y == 0]) + 0.5 * (s[y == 1][:, None] == s[y == 0])])
    assert auc > 0.85


def test_quality_covers_whole_texts_in_blocks(monkeypatch):
    rng = np.random.default_rng(0)
    model = quality.Model(*(rng.normal(size=s).astype(np.float32) for s in ((256, quality.EMBED), (quality.WIDTH * quality.EMBED, quality.FILTERS), quality.FILTERS, quality.FILTERS)), 0.1)
    texts = [rng.integers(1, 255, n, dtype=np.uint8).tobytes() for n in (0, 1, 11, 12, 13, 500, 5000, 40000)]
    whole = quality.pooled(model, texts)
    monkeypatch.setattr(quality, "BLOCK", 600)
    assert np.allclose(quality.pooled(model, texts), whole, atol=1e-4)
    model.embed[255] = 9.0
    late = quality.pooled(model, [b"a" * 5000, b"a" * 4990 + b"\xff" * 10])  # a change at the very end is seen
    assert not np.allclose(late[0], late[1])


def test_quality_of_odd_rows(spark, odd, none):
    labels = spark.createDataFrame([(4, 1, 0), (5, 0, 0), (None, 1, 0), (6, None, 0)], "doc_id long, quality int, toxic int")
    model = quality.fit(odd, labels, epochs=2)
    got = quality.score_documents(odd, model).toPandas()
    assert len(got) == odd.count() and got["score"].between(0, 1).all()
    assert quality.score_documents(none, model).count() == 0
    assert quality.keep_good(odd, model).columns == odd.columns
    empty = quality.fit(odd, labels.filter("false"))
    assert set(quality.score_documents(odd, empty).toPandas()["score"]) == {0.5}


# ---- mixing ------------------------------------------------------------------------------------------------------


def targets(sizes, cap=3.0):
    """Water filling by repeated sharing."""
    order = sorted(s for s in sizes if s is not None) + [s for s in sizes if s is None]
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    left, out, open_ = sum(sizes.values()), {}, set(sizes)
    while open_:
        total = sum(weight[s] for s in open_)
        over = {s for s in open_ if weight[s] / total * left > cap * sizes[s] + 1e-9}
        if not over:
            out |= {s: weight[s] / total * left for s in open_}
            break
        out |= {s: cap * sizes[s] for s in over}
        left -= sum(cap * sizes[s] for s in over)
        open_ -= over
    return out


def test_mixing_meets_its_targets(spark):
    got = pandas(mixing.op4_mixing(spark, SF))
    docs = pd.read_parquet(f"{SF}/documents.parquet")
    size = docs.set_index("doc_id")["text"].map(lambda t: len((t or "").encode().split()))
    assert got.set_index("doc_id")["size"].to_dict() == size.to_dict()
    by_source = docs.assign(size=docs["doc_id"].map(size)).groupby("source")["size"].sum().to_dict()
    want = targets(by_source)
    joined = got.merge(docs[["doc_id", "source"]], on="doc_id")
    for source, rows in joined.groupby("source"):
        assert rows["source_size"].eq(by_source[source]).all()
        assert np.allclose(rows["target"], want[source], rtol=1e-9)
        assert abs(rows["taken"].sum() - want[source]) <= 0.01 * want[source]
    assert (got["taken"] <= 3 * got["size"]).all()
    assert pandas(mixing.op4_mixing(spark, SF)).equals(got)


def test_rates_are_the_entropy_solution(spark):
    """Against a search for each source's multiplier in NumPy, and the copies of every document against its rate."""
    docs = pd.read_parquet(f"{SF}/documents.parquet")
    got = pandas(mixing.op4_mixing(spark, SF)).merge(docs[["doc_id", "source"]], on="doc_id")
    varied = 0
    for _, rows in got.groupby("source"):
        size, target = rows["size"].to_numpy(float), rows["target"].iloc[0]
        x = size / size[size > 0].mean()
        lo, hi = -1e4, 1e4
        for _ in range(200):
            mid = (lo + hi) / 2
            lo, hi = (mid, hi) if (size * np.minimum(3, np.exp(np.minimum(mid * x, 50)))).sum() < target else (lo, mid)
        want = np.minimum(3, np.exp(np.minimum(lo * x, 50)))
        assert np.allclose(rows["rate"], want, atol=1e-6)
        assert ((rows["copies"] - rows["rate"]).abs() <= 1 + 1e-9).all() and (rows["copies"] >= np.floor(rows["rate"])).all()
        varied += rows["rate"].nunique() > 10
    assert varied > 10


def test_one_change_more_brings_no_source_nearer(spark):
    """What ``solve`` leaves of every source's gap, against all single changes of documents."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    sources = {r["source"]: r for r in mixing.solve(docs).collect()}
    got = pandas(mixing.mix(docs))
    for source, rows in got.groupby("source"):
        gap, free = sources[source]["target"] - rows["taken"].sum(), rows[(rows["size"] > 0) & (rows["rate"] < 3)]
        if abs(gap) > mixing.NEAR * sources[source]["target"] and len(sources[source]["swaps"]) < mixing.SWAPS:
            change = free["size"].where(free["copies"] == np.floor(free["rate"]), -free["size"])
            assert (abs(gap - change) >= abs(gap) - 1e-6).all(), source


def test_rows_that_share_an_id_are_mixed_apart(spark):
    rows = [(7, "w " * 10, "a")] * 20 + [(7, "w " * 4, "b")] * 20 + [(None, "w " * 5, "b")] * 3
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    twice = [sorted(map(str, mixing.repeat_copies(docs.repartition(n)).collect())) for n in (2, 5)]
    assert twice[0] == twice[1] and len(twice[0]) == mixing.mix(docs).agg({"copies": "sum"}).first()[0]


def test_mixing_caps_and_odd_rows(spark, odd, none):
    rows = [(i, "w " * 10, "a") for i in range(200)] + [(1000 + i, "w " * 3, "b") for i in range(5)] + [(2000, "w w", None), (2001, None, "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = pandas(mixing.mix(docs))
    want = targets({"a": 2000, "b": 15, None: 2, "z": 0})
    for _, r in got.iterrows():
        assert abs(r["target"] - want[None if pd.isna(r["source"]) else r["source"]]) < 1e-6
    assert set(got[got["doc_id"].between(1000, 1004)]["taken"]) == {9}
    assert pandas(mixing.mix(odd))["doc_id"].notna().sum() == 12 and mixing.mix(none).count() == 0
    mixed = mixing.repeat_copies(odd)
    assert mixed.columns == odd.columns
    assert mixed.count() == mixing.mix(odd).agg({"copies": "sum"}).first()[0]


# ---- packing -----------------------------------------------------------------------------------------------------


def check_packing(pieces, docs):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(packing.tokenizer_path())
    ids = defaultdict(list)
    for d, t in docs:
        ids[d].append(np.array(tok.encode(t or "", add_special_tokens=False).ids + [2], np.uint32))
    rows = pieces.to_dict("records")
    for d, copies in ids.items():
        got = sorted((r for r in rows if r["doc_id"] == d), key=lambda r: r["start"])
        for copy in copies:
            at = 0
            while at < len(copy):
                r = next(r for r in got if r["start"] == at and r["doc_tokens"] == len(copy) and r["ids_crc32"] == zlib.crc32(copy[at : at + r["length"]].tobytes()))
                got.remove(r)
                at += r["length"]
            assert at == len(copy)
        assert not got
    total = 0
    for _, seq in pieces.groupby("sequence_id"):
        seq = seq.sort_values("offset")
        assert (seq["offset"].to_numpy() == np.concatenate([[0], seq["length"].cumsum().to_numpy()[:-1]])).all()
        n = int(seq["length"].sum())
        assert n <= 4096
        total += n if n & (n - 1) == 0 else 4096
    assert total == sum(len(c) for v in ids.values() for c in v)  # no padding at all
    groups = pieces.drop_duplicates("sequence_id")["step_group"].value_counts()
    return groups


def test_packing_of_the_small_table(spark, docs, table):
    pieces = packing.pack(docs).toPandas()
    groups = check_packing(pieces, list(zip(table["doc_id"], table["text"], strict=True)))
    assert groups.max() - groups.min() <= 1


def test_packing_of_odd_rows(odd, none):
    keep = odd.filter("doc_id is not null")
    check_packing(packing.pack(keep.coalesce(1)).toPandas(), [(r["doc_id"], r["text"]) for r in keep.collect()])
    assert packing.pack(odd).filter("doc_id is null").count() > 0
    assert packing.pack(none).count() == 0


# ---- secrets -----------------------------------------------------------------------------------------------------

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def base_spans(text):
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    return sorted(out + [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 16])


def check_secrets(got, docs):
    got = got.set_index("doc_id")
    for d, t in docs:
        want = base_spans(t or "")
        s = ",".join(f"{secrets.KINDS[k]}:{a}:{b}" for a, k, b in want)
        r = got.loc[d]
        kinds = Counter(k for _, k, _ in want)
        assert (r["n_assign"], r["n_access"], r["n_hex"]) == tuple(kinds[k] for k in range(3))
        assert r["base_sha256"] == hashlib.sha256(s.encode()).hexdigest()
        assert set(s.split(",")) - {""} <= set(r["spans"].split(","))


def test_secrets_of_the_table(spark):
    docs = pd.read_parquet(f"{SF}/documents.parquet")
    check_secrets(secrets.op5_secrets(spark, SF).toPandas(), zip(docs["doc_id"], docs["text"], strict=True))


CASES = [
    (1, "token=api_key:longvalue12345 Password\": 'abcdefghijkl' AKIA" + "B" * 14 + " " + "0123456789abcdef" * 2),
    (2, "😀 secret = " + "a" * 12 + " passwd:short AKIAAKIA" + "C" * 16),
    (3, "user: alice\nhttps://db.example.org/x\nkey Zx9" + "Ab1/" * 8),
    (4, "nothing here but Zx9" + "Ab1/" * 8 + " and https://www.example.org/"),
    (5, "user: bob" + " far " * 200 + "Zx9" + "Ab1/" * 8),
    (6, None), (7, ""), (8, "SECRET=ſecretvalue12345 apikey=" + "k" * 40),
]


def test_secrets_of_cases(spark):
    docs = spark.createDataFrame(CASES, "doc_id long, text string")
    got = secrets.report(secrets.scan(docs)).toPandas()
    check_secrets(got, CASES)
    extra = {d: {s.split(":")[0] for s in v.split(",")} - {"assign", "access", "hex", ""} for d, v in zip(got["doc_id"], got["spans"], strict=True)}
    assert extra[3] == {"login", "blob", "endpoint"}  # the three parts lie together
    assert extra[4] == set() and extra[5] == set()  # alone, or too far apart


def all_spans(text):
    """Base spans and the weak ones that have their complement near, by brute force."""
    base = base_spans(text)
    weak = [(m.start(), 3, m.end()) for m in re.finditer(secrets.LOGIN, text, re.A)] + [(m.start(), 5, m.end()) for m in re.finditer(secrets.ENDPOINT, text, re.A)]
    weak += [(m.start(), 4, m.end()) for m in re.finditer(secrets.BLOB, text, re.A)]
    live = [w for w in weak if not any(b[0] < w[2] and w[0] < b[2] for b in base)]
    near = lambda s, kinds: any(x[1] in kinds and abs(x[0] - s[0]) <= 512 for x in base + live)
    rule = {3: lambda s: near(s, (0, 2, 4)), 4: lambda s: near(s, (1, 3)), 5: lambda s: near(s, (1, 3)) and near(s, (0, 2, 4))}
    return sorted(base + [w for w in live if rule[w[1]](w)])


def test_linked_spans_of_the_table_and_of_shifted_texts(spark):
    parts = "user: alice" + " " * 380 + "Zx9" + "Ab1/" * 8 + " " * 300 + "https://db.example.org/x"
    rows = [(k, "." * (50 * k) + " " + parts) for k in range(24)] + [(100, "user: bob " + "aB" * 60 + "9")] + [(101, "user: eve\n" * 700 + "password=abcdef123456")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").unionByName(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").withColumn("doc_id", F.col("doc_id") + 1000))
    got = {r["doc_id"]: r["spans"] for r in secrets.report(secrets.scan(docs)).collect()}
    for d, t in [tuple(r) for r in docs.collect()]:
        assert got[d] == ",".join(f"{secrets.KINDS[k]}:{a}:{b}" for a, k, b in all_spans(t or "")), d
    assert all(len(got[k].split(",")) == 2 for k in range(24))  # the endpoint is out of the login's reach
    assert "blob" in got[100] and got[101].count("login") == 51


def test_rows_that_share_an_id_lose_their_own_spans(spark):
    plain = "a text that has nothing to hide and is long enough to be cut wrongly " * 3
    rows = [(1, "user: alice key Zx9" + "Ab1/" * 8), (1, plain), (None, "user: bob key Yx9" + "Ab1/" * 8), (None, plain)]
    got = sorted((r["doc_id"] or 0, r["text"]) for r in secrets.redact(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert [t for _, t in got] == sorted([plain, "[secret] key [secret]"]) * 2


def test_redaction_across_blocks(spark):
    rng = np.random.default_rng(3)
    text = "".join("é😀xy "[i] for i in rng.integers(0, 5, 9000))
    for at in (8100, 4090, 100, 0):
        text = text[:at] + " token=abcdefghijklmnop " + text[at:]
    text = text[:300] + "f" * 9000 + text[300:]
    spans, want, at = base_spans(text), "", 0
    for a, _, b in spans:
        if a >= at:
            want += text[at:a] + "[secret]"
        at = max(at, b)
    docs = spark.createDataFrame([(1, text, len(text))], "doc_id long, text string, n_chars long")
    assert secrets.redact(docs).first()["text"] == want + text[at:]


def test_redaction(spark, odd, none):
    docs = spark.createDataFrame([(d, t, len(t or "")) for d, t in CASES], "doc_id long, text string, n_chars long")
    got = {r["doc_id"]: r for r in secrets.redact(docs).collect()}
    for d, t in CASES:
        clean = got[d]["text"]
        assert not base_spans(clean or "")
        if d in (4, 6, 7):
            assert clean == t
        elif d in (1, 2):
            assert got[d]["n_chars"] == len(clean) and "[secret]" in clean
    out = secrets.redact(odd)
    assert out.columns == odd.columns and out.count() == odd.count()
    assert secrets.redact(none).count() == 0 and secrets.scan(none).count() == 0


# ---- fingerprints ------------------------------------------------------------------------------------------------


def test_edited_texts_and_likeness(spark):
    docs = pd.read_parquet(f"{SF}/documents.parquet").sort_values("doc_id", ignore_index=True)
    got = pandas(fingerprints.op6_fingerprints(spark, SF))
    texts = [t or "" for t in docs["text"]]
    for i, t in enumerate(texts):
        cut = len(t) // 4
        edited = t[: len(t) - cut] + texts[(i + 1) % len(texts)][:cut]
        assert got["n_chars"][i] == len(t)
        assert got["edited_sha256"][i] == hashlib.sha256(edited.encode()).hexdigest()
        assert edited != t or (got["near_edited"][i] == 1 and got["fingerprint"][i] == got["edited_fingerprint"][i])
    same = defaultdict(set)
    for t, f in zip(texts, got["fingerprint"], strict=True):
        same[t].add(f)
    assert all(len(v) == 1 for v in same.values()) and len(set(got["fingerprint"])) > 0.99 * len(same)
    assert got[["near_edited", "near_next"]].stack().between(0, 1).all()
    long = docs["text"].str.len() > 1500
    assert got[long]["near_edited"].mean() > 0.6 and got[long]["near_next"].mean() < 0.3


def test_fingerprints_add_and_take_away(spark):
    a, b = "One two. Three.\nFour five. One two.", "Six. One two.\nOne two."
    f = fingerprints
    of_a, of_b = f.units(F.col("a")), f.units(F.col("b"))
    row = spark.createDataFrame([(a, b, a + "\n" + b)], "a string, b string, ab string").select(
        f.fingerprint("a").alias("fa"), f.fingerprint("b").alias("fb"), f.fingerprint("ab").alias("fab"), f.insert(f.fingerprint("a"), "b", of_a).alias("a_b"),
        f.delete(f.fingerprint("ab"), "b", of_a).alias("a2"), f.insert(f.fingerprint("b"), "a", of_b).alias("b_a"), f.delete(f.empty(), "a").alias("minus"),
        f.insert(f.empty(), "a").alias("a3"),
    )
    r = row.first()
    assert r["fab"] == r["a_b"] == r["b_a"] and r["a2"] == r["fa"] == r["a3"] and r["fa"] != r["fb"] and len(r["fa"]) == f.LENGTH
    assert all(0 <= x <= f.FULL for x in r["minus"])


def counted(text):
    """The units of a text by count, cut as the pattern says."""
    parts = [u for u in re.split(fingerprints.UNIT_GAP, text) if u]
    return Counter(v for u in parts for v in (re.split(fingerprints.WORD_GAP, u) if len(u) > fingerprints.LONG else [u]) if v)


def test_fingerprints_against_a_twin(spark, docs, table):
    """Every lane is the sum of bits of the hashes of numbered units, and likeness is the shared part of the units."""
    got = {r["doc_id"]: r for r in docs.select("doc_id", fingerprints.fingerprint("text").alias("v")).collect()}
    numbered = [(i, u, k + 1) for i, t in zip(table["doc_id"].tolist()[:40], table["text"], strict=False) for u, n in counted(t).items() for k in range(n)]
    hashes = spark.createDataFrame(numbered, "doc_id long, u string, k int").select("doc_id", F.xxhash64("u", F.lit(0)).alias("a"), F.xxhash64("u", "k", F.lit(0)).alias("b"), F.xxhash64("u", "k", F.lit(1)).alias("c"))
    want = {}
    for i, *three in rows(hashes):
        lanes = want.setdefault(i, [0] * fingerprints.LENGTH)
        lanes[0] += 1
        for j, h in enumerate(three):
            for k in range(fingerprints.WIDTH):
                lanes[1 + j * fingerprints.WIDTH + k] += ((h & ((1 << 64) - 1)) >> k) & fingerprints.ONES
    assert len(want) == 40 and all(got[i]["v"] == v for i, v in want.items())


def test_likeness_is_the_shared_part_of_units(spark, table):
    """Also where one line is repeated many times."""
    got = pandas(fingerprints.op6_fingerprints(spark, SMALL))
    texts = table["text"].tolist()
    edited = [t[: len(t) - len(t) // 4] + (texts[(k + 1) % len(texts)][: len(t) // 4]) for k, t in enumerate(texts)]
    off = []
    for k, t in enumerate(texts):
        for other, near in ((edited[k], got["near_edited"][k]), (texts[(k + 1) % len(texts)], got["near_next"][k])):
            a, b = counted(t), counted(other)
            share = 2 * (a & b).total() / max(1, a.total() + b.total())
            off.append(abs(near - share) / max(0.05, 1 - share))
            assert near == 1 if a == b else off[-1] < 0.6
    assert np.mean(off) < 0.12
    line = "This line comes again.\n" * 200
    pair = spark.createDataFrame([(line + "Other one.\n" * 50 + "A.\nB.\nC.", line[: 23 * 150] + "Other one.\n" * 50 + "A.\nB.\nD.")], "a string, b string")
    near = pair.select(fingerprints.likeness(fingerprints.fingerprint("a"), fingerprints.fingerprint("b")).alias("x")).first()["x"]
    assert abs(near - 2 * 202 / 456) < 0.05


def test_fingerprints_of_odd_rows(odd, none):
    got = fingerprints.edits(odd).toPandas()
    assert len(got) == odd.count() and got.notna().drop(columns="doc_id").all().all()
    assert fingerprints.edits(none).count() == 0
    assert fingerprints.edits(odd.filter("doc_id = 5")).first()["near_next"] == 1.0  # its own next document


def test_positions(spark):
    values = list(np.random.default_rng(0).permutation(1000))
    df = spark.createDataFrame([(int(v) * 7,) for v in values], "k long")
    got = sorted((r["k"], r["pos"]) for r in with_position(df, "k").collect())
    assert got == [(7 * i, i) for i in range(1000)]
    assert with_position(df.filter("false"), "k").count() == 0


# ---- token counts ------------------------------------------------------------------------------------------------


def reference_tokenizer():
    from tokenizers import Tokenizer, models, pre_tokenizers

    vocabulary = [(p, float(s)) for p, s in tokencount.read_vocabulary(tokencount.vocabulary_path())]
    t = Tokenizer(models.Unigram(vocabulary, unk_id=0, byte_fallback=True))
    t.pre_tokenizer = pre_tokenizers.Metaspace(replacement="▁", prepend_scheme="always", split=True)
    return t


def test_counts_equal_the_tokenizer(spark, table, docs):
    tok = reference_tokenizer()
    got = pandas(tokencount.count_tokens(docs))
    assert got["n_tokens"].tolist() == [len(tok.encode(t or "", add_special_tokens=False).ids) for t in table["text"]]


def test_counts_of_odd_texts():
    tok, count = reference_tokenizer(), tokencount.counter(tokencount.vocabulary_path())
    for t in ["", " ", "  a", "a  b ", "日本語 😀 x\n\ty", "▁a ▁", "<s> </s> <unk> <0x41>", "\x00", "a" * 3000, "́", " x"]:
        assert count.text(t) == len(tok.encode(t, add_special_tokens=False).ids), repr(t)


def test_ties_go_to_the_piece_that_starts_first():
    from tokenizers import models

    vocabulary = [("<unk>", 0.0), ("a", -1.0), ("b", -1.0), ("ab", -2.0), ("ba", -2.0), ("aba", -3.0)]
    model, count = models.Unigram(vocabulary, unk_id=0, byte_fallback=False), tokencount.Counter(vocabulary)
    rng = np.random.default_rng(0)
    for _ in range(200):
        w = "".join(rng.choice(list("abx"), int(rng.integers(1, 9))))
        assert count.word(w) == len(model.tokenize(w)), w


def test_counts_of_odd_rows(odd, none):
    assert tokencount.count_tokens(odd).count() == odd.count() and tokencount.count_tokens(none).count() == 0


# ---- media -------------------------------------------------------------------------------------------------------


def check_media(got, docs):
    got = {(r["doc_id"], r["n_bytes"]): r for r in got.collect()}
    for d, t in docs:
        raw = (t or "").encode()
        n = max(1, -(-len(raw) // 192)) * 192
        full = raw + b" " * (n - len(raw))
        r = got[(d, len(raw))]
        stored = media.to_media(full)
        assert (r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (n, hashlib.sha256(full).hexdigest(), zlib.crc32(full[-16:]))
        assert (r["media_bytes"], r["media_sha256"]) == (len(stored), hashlib.sha256(stored).hexdigest())
        assert media.from_media(stored) == full


def test_media_round_trip(spark, table):
    check_media(media.op8_media(spark, SMALL), zip(table["doc_id"], table["text"], strict=True))


def test_media_of_odd_rows(odd, none):
    def run(df):
        lists = media.recipes(df)
        return media.rebuild(lists, media.chunk(df), media.hot_digests(lists))

    got = run(odd)
    check_media(got, [(r["doc_id"], r["text"]) for r in odd.collect()])
    assert got.count() == odd.count() and run(none).count() == 0


def test_cuts_are_found_again_after_an_insertion():
    data = np.random.default_rng(0).integers(0, 255, 400_000, dtype=np.uint8).tobytes()
    a, b = media.cuts(data), media.cuts(b"new head" + data)
    assert a[-1] == len(data) and len(set(a) & {x - 8 for x in b}) > 0.8 * len(a)
    assert all(s <= media.LARGEST for s in np.diff([0, *a])) and media.cuts(b"") == []


def test_hot_chunks_are_spread(spark):
    docs = spark.createDataFrame([(i, "the same text again") for i in range(300)], "doc_id long, text string")
    lists = media.recipes(docs)
    hot = media.hot_digests(lists, 100)
    assert hot.first()["salts"] == 3 and hot.count() == 1
    assert media.rebuild(lists, media.chunk(docs), hot).select("feature").distinct().count() == 1


@pytest.mark.parametrize("entries", [2, 1000])
def test_bytes_of_cold_chunks_are_sent_once(spark, entries):
    rng = np.random.default_rng(8)
    texts = [" ".join(map(str, rng.integers(0, 1 << 30, n).tolist())) for n in (5, 50, 9000, 12000)]
    rows = [(i, texts[i % 4] + ("" if i % 3 else str(i))) for i in range(24)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    lists = media.recipes(docs)
    hot = media.hot_digests(lists, entries)
    assert hot.isEmpty() == (entries == 1000)
    got = media.rebuild(lists, media.chunk(docs), hot)
    # the plan as Spark reads it: equal exchanges of the bytes are one, whatever comes later
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("_group#") == 0 or entries == 2
    assert plan.count("Aggregate [digest") == (2 if entries == 1000 else 6)
    check_media(got, rows)


def test_hot_chunks_of_long_and_short_texts_from_many_tasks(spark):
    shared = "".join(chr(33 + c) for c in np.random.default_rng(3).integers(0, 90, 40_000))
    rows = [(i, shared + f" tail {i}") for i in range(40)] + [(100 + i, "short") for i in range(30)] + [(200, None), (200, "lone"), (None, "short")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    lists = media.recipes(docs)
    hot = media.hot_digests(lists, 7)
    assert hot.count() > 2 and hot.agg({"salts": "max"}).first()[0] == 6
    check_media(media.rebuild(lists, media.chunk(docs), hot), rows)


# ---- pages -------------------------------------------------------------------------------------------------------

PAGE = """<!doctype html><html><head><title>x</title><style>p{}</style><script>var a="</p>";</script></head><body class="has-sidebar">
<header><h1>Site</h1></header><nav><ul><li><a href="#">Home</a><li>About</ul></nav><div id="cookie-notice">We use cookies</div>
<main><article><header><h1>Title &amp; more</h1></header><p>One <b>bold<br>two</b>&nbsp; three<p>Four <span class="ad">buy</span> five &lt;x&gt; &#233;
<script>x<y</script><ul><li>a<li>b</ul><div class="comments"><p>bad</div><form><input>q</form></article></main><aside>s</aside><footer>f</footer></body"""


def test_article_of_a_page(spark):
    outside = lambda page: [i for i, (_, inside) in enumerate(htmltext.blocks(page)) if not inside]
    assert htmltext.main_text(PAGE, outside(PAGE)) == "Title & more\nOne bold two three\nFour five <x> é\na\nb"
    assert htmltext.main_text(None, None) == "" and htmltext.main_text("", [1]) == "" and htmltext.main_text("<p", None) == ""
    assert htmltext.main_text("<p>a &amp b &am", None) == "a & b &am"
    assert htmltext.main_text("<div>" * 2000 + "deep" + "</div>" * 2000, None) == "deep"


def test_hints_do_not_cost_an_article():
    text = lambda page: htmltext.main_text(page, None)
    body = "<h1>T</h1><p>One two three four.</p>"
    assert text(f'<div class="content no-sidebar">menu<article>{body}</article>x</div>') == "T\nOne two three four."
    assert text(f'<div class="related-wrap"><main>{body}</main></div>') == "T\nOne two three four."
    assert text(f'<article>{body}<p class="social">Five</p><div class="notice-board"><p>Six</p></div></article>') == "T\nOne two three four.\nFive\nSix"
    # but what a hint marks goes where there is an article elsewhere, or more text than in it
    assert text(f'<article>{body}</article><div class="related"><article>Other</article></div>') == "T\nOne two three four."
    assert text('<div><p>Long enough a text</p></div><div class="related"><article>Other</article></div>') == "Long enough a text"
    assert text(f'<article>{body}<p class="ad">Buy</p><div class="notice">N</div><div class="post-comments"><p>C</p></div><div class="social share">S</div></article>') == "T\nOne two three four."
    assert text(f'<div class="sidebar"><form>q</form><nav>n</nav><main>{body}<div class="comments">c</div></main></div>') == "T\nOne two three four."



def test_shared_lines_go(spark):
    page = lambda k: f"<body><div>Our site</div><div>All news</div><p>Story {k} is long enough to count.</p><p>More of {k}.</p><div>Contact us</div></body>"
    rows = [(i, f"https://h.example.org/news/{i}", page(i)) for i in range(20)] + [(50, "https://other.example.org/", page(0)), (51, None, page(7)), (52, "https://h.example.org/zzz", None)]
    rows += [(60, "https://c.example.org/a", page(1)), (61, "https://c.example.org/a?p=2", page(1)), (62, "https://c.example.org/b", page(2))]
    got = {r["page_id"]: r["text"] for r in htmltext.extract(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)).collect()}
    for i in range(20):
        assert got[i] == f"Story {i} is long enough to count.\nMore of {i}."
    assert got[50].startswith("Our site") and got[51].startswith("Our site") and got[52] == ""
    assert got[60] == got[61] == "Story 1 is long enough to count.\nMore of 1."  # copies tell nothing; the next page does


def test_the_mate_decides_on_pages_with_an_article(spark):
    """Pages of the given shape with lines outside the article: what the mate has too is template, the rest is text."""
    page = lambda k: f"<html><body><nav>menu {k}</nav><div>Edited by staff of the site</div><div>Lead of {k}</div><article><h1>Title {k}</h1><p>Body {k}</p><p>Shared paragraph</p></article><footer>end {k}</footer></body></html>"
    rows = [(1, "https://h.example.org/en/1", page(1)), (2, "https://h.example.org/en/2", page(2))]
    text = lambda some: {r["page_id"]: r["text"] for r in htmltext.extract(spark.createDataFrame(some, "page_id long, url string, html string")).collect()}
    assert text(rows)[1] == "Lead of 1\nTitle 1\nBody 1\nShared paragraph"
    assert text(rows[:1])[1] == "Title 1\nBody 1\nShared paragraph"


def test_mates_are_the_nearest(spark):
    rng = np.random.default_rng(4)
    paths = sorted({"/" + "".join("ab/"[i] for i in rng.integers(0, 3, rng.integers(0, 7))) for _ in range(60)})
    rows = [(i, f"h{i % 3}", p) for i, p in enumerate(paths)]
    got = dict(htmltext.nearest(spark.createDataFrame(rows, "page long, host string, path string")).collect())
    common = lambda a, b: next((k for k, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
    for i, h, p in rows:
        assert common(p, paths[got[i]]) == max(common(p, q) for j, g, q in rows if g == h and j != i) and rows[got[i]][1] == h


def test_long_pages_are_differenced_in_parts(monkeypatch):
    rng = np.random.default_rng(6)
    a, b = rng.integers(0, 4, 300).tolist(), rng.integers(0, 4, 280).tolist()
    whole = len(htmltext.common_lines(a, b))
    monkeypatch.setattr(htmltext, "CELLS", 50)
    assert len(htmltext.common_lines(a, b)) == whole
    assert len(htmltext.common_lines([7] * 5000, [7] * 4000 + [8])) == 4000


def test_common_lines_are_longest():
    rng = np.random.default_rng(0)
    for _ in range(50):
        a, b = rng.integers(0, 5, 12).tolist(), rng.integers(0, 5, 10).tolist()
        t = np.zeros((13, 11), int)
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                t[i + 1, j + 1] = t[i, j] + 1 if x == y else max(t[i, j + 1], t[i + 1, j])
        found = sorted(htmltext.common_lines(a, b))
        assert len(found) == t[-1, -1]
        rest = iter(b)
        assert all(a[i] in rest for i in found)


def test_pages_of_the_table(spark):
    got = htmltext.op3_htmltext(spark, SMALL).toPandas().set_index("page_id")
    pages = pd.read_parquet(f"{SMALL}/pages.parquet").set_index("page_id")
    assert set(got.index) == set(pages.index) and (got["n_chars"] == got["text"].str.len()).all()
    import html

    for i, page in pages["html"].items():
        body = re.search(r"<article>(.*?)(?:</article>|\Z)", page, re.S)[1]
        want = [" ".join(html.unescape(re.sub(r"<[^>]*>?", "", b.replace("<br>", " "))).split()) for b in re.split(r"</?(?:p|h1)>", body)]
        assert got["text"][i] == "\n".join(b for b in want if b)


def test_no_pages(spark):
    assert htmltext.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_few_fitting_documents_are_cut(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").coalesce(1)
    pieces = packing.pack(docs).toPandas()
    fit = pieces[pieces["doc_tokens"] <= 4096].groupby("doc_id").size()
    assert (fit > 1).mean() < 0.1 and pieces["tier"].nunique() > 3


def test_a_gap_is_filled_from_shorter_tiers():
    packer = packing.Packer(0, 2)
    for doc, n in enumerate([3000, 96, 500, 500, 40]):
        packer.add(doc, np.full(n, doc, np.uint32))
    packer.window(4096, list(packing.TIERS))
    assert {r[0]: r[2] for r in packer.rows} == {0: 3000, 1: 96, 2: 500, 3: 500} and packer.waiting == 1

"""The other operators against brute force, exact round trips or held-out accuracy, and on awkward rows."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from orrery.llm import bpe, crf, hamming, lattice, licenses, line_dedup, mixing, omh, token_count, vocab

SF = "/root/testdata/sf0.001"
TEXTS = [
    None, "", " ", "plain words", "plain words", "It's  a\n\ttest—don't　stop!! 123 \U0001f600", "Licensed under the\n// Apache License, Version 2.0. All rights reserved.",
    "word " * 30_000, "x" * 20_000, "a | b | c\nLine two.\n\nLine two.\n", "SPDX-License-Identifier: GPL-2.0-or-later\nThe MIT License",
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, None if i == 3 else "en", None if i == 4 else f"s{i % 2}", len(t or ""), 1, 2.0) for i, t in enumerate(TEXTS)]
    rows += [rows[3], (None, "no id at all", "en", "s1", 12, 1, 2.0)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, n long, __x double")


def byid(df):
    return {r["doc_id"]: r for r in df.collect()}


def test_bpe_round_trip_and_counts(docs):
    enc = vocab.byte_encoder(vocab.locate(None, vocab.BYTE_RANKS))
    got = bpe.decode(bpe.encode(docs)).collect()
    assert len(got) == len(TEXTS) + 2 and bpe.round_trip(docs.limit(0)).count() == 0
    assert sorted(map(repr, bpe.round_trip(docs).collect())) == sorted(map(repr, got))
    with pytest.raises(ValueError):
        bpe.round_trip(docs.withColumnRenamed("n", "decoded"), keep=("decoded",))
    for r in got:
        t = TEXTS[r["doc_id"]] if r["doc_id"] is not None else "no id at all"
        assert r["decoded"] == t
        assert r["token_ids"] == (None if t is None else enc.encode_ordinary(t))
    counts = byid(token_count.token_counts(docs, batch_bytes=500))
    for i, t in enumerate(TEXTS):
        assert counts[i]["n_tokens"] == (None if t is None else len(enc.encode_ordinary(t)))
    assert bpe.encode(docs.limit(0)).count() == 0 == token_count.token_counts(docs.limit(0)).count()


def test_decoding_joins_any_ids(spark):
    """Against the token-byte table in plain Python: null and unknown ids, null and empty lists, torn characters, clashing names."""
    table = {i: b for b, i in vocab.ranks(vocab.locate(None, vocab.BYTE_RANKS)).items()}
    r = random.Random(3)
    rows = [(i, [r.choice([None, -5, 50_256, 10**6, *range(0, 50_256, 97)]) for _ in range(n)], "p", i) for i, n in enumerate([0, 1, 2, 7, 30_000, 0, 3, 12_001])]
    rows += [(100, None, "p", 1), (100, None, "p", 1), (None, [15496, 11, 995], "p", 1)]
    df = spark.createDataFrame(rows, "doc_id long, token_ids array<int>, pos string, head long").repartition(3)
    got = sorted((repr(r["doc_id"]), r["token_ids"], r["decoded"]) for r in bpe.decode(df).collect() if r["token_ids"])
    want = sorted((repr(i), t, b"".join(table.get(x, b"") for x in t).decode("utf-8", "replace")) for i, t, _, _ in rows if t)
    assert got == want
    rest = [(r["doc_id"], r["decoded"]) for r in bpe.decode(df, keep=("doc_id",)).collect() if r["doc_id"] in (0, 5, 100)]
    assert sorted(rest, key=str) == [(0, ""), (100, None), (100, None), (5, "")] and bpe.decode(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        bpe.decode(df.withColumnRenamed("pos", "decoded"))


def test_encoding_after_a_shuffle_and_in_small_blocks(docs):
    enc = vocab.byte_encoder(vocab.locate(None, vocab.BYTE_RANKS))
    got = bpe.encode(docs.repartition(5).select("*", F.lit(1).alias("text_"), F.lit(2).alias("route"), F.lit(3).alias("block")), keep=("doc_id", "route"), block_chars=2_000, owners=7).collect()
    assert len(got) == len(TEXTS) + 2 and {r["route"] for r in got} == {2}
    for r in got:
        t = TEXTS[r["doc_id"]] if r["doc_id"] is not None else "no id at all"
        assert r["token_ids"] == (None if t is None else enc.encode_ordinary(t))
    for keep in (("token_ids",), ("n_tokens",)):
        with pytest.raises(ValueError):
            bpe.encode(docs, keep=keep)


def test_halves_of_a_block_must_agree():
    import pyarrow as pa

    words, places = bpe._Words(True), bpe._Words(False)
    words.add(["a b c"])
    places.add(["a b d"])
    part = [words.mark(), np.array([1, 1, 1]), np.array([5, 6, 7])]
    schema = pa.schema([("token_ids", pa.list_(pa.int32())), ("n_tokens", pa.int64())])
    dictionary = pa.RecordBatch.from_arrays([pa.array([0, 0]), pa.array([0, 0]), pa.array([0, 1], pa.int32()), pa.array([0, 0]), pa.array([bpe.pack(*part), bpe.pack(places.mark(), places.owners(1))])], schema=bpe._WIRE_PA)
    with pytest.raises(ValueError, match="different rows"):
        list(bpe._assemble(schema)([dictionary]))


def test_token_count_batches(spark):
    enc = vocab.byte_encoder(vocab.locate(None, vocab.BYTE_RANKS))
    texts = ["é" * 300, "naïve café " * 50, "", None, "x", "日本語 text " * 40, "w " * 5, None]
    for limit in (1, 40, 10**6):
        got = token_count.token_counts(spark.createDataFrame(list(enumerate(texts)), "n long, text string").coalesce(1), keep=("n",), name="k", batch_bytes=limit).collect()
        assert {r["n"]: r["k"] for r in got} == {i: None if t is None else len(enc.encode_ordinary(t)) for i, t in enumerate(texts)}
    assert max(len(p.encode()) for p in token_count.pieces("é é " * 500, 60)) <= 70 and "".join(token_count.pieces("é é " * 500, 60)) == "é é " * 500


def test_lattice_against_all_segmentations():
    path = vocab.locate(None, vocab.PIECES)
    texts, by = lattice.pieces(path)
    scores = np.log(np.random.default_rng(0).dirichlet(np.ones(len(texts)) * 0.5) + 1e-12)
    at = {p: i for i, p in enumerate(texts) if p}

    def total(w):
        if not w:
            return 1.0
        out = sum(math.exp(scores[at[w[:n]]]) * total(w[n:]) for n in range(1, len(w) + 1) if w[:n] in at)
        if w[0] not in at:
            out += math.exp(scores[by[list(w[0].encode())]].sum()) * total(w[1:])
        return out

    for t in ["the cat", "straße", "naïve \U0001f600 ok", "a"]:
        cp, b, e, doc = lattice.segments([t])
        got = lattice.forward(cp, b, e, lattice.trie(path), scores, by).sum()
        words = "".join(map(chr, cp))
        assert got == pytest.approx(sum(math.log(total(words[i:j])) for i, j in zip(b.tolist(), e.tolist())), rel=1e-9)


def brute_lattice(texts):
    """Counts, scores and log-probabilities in plain Python, from the model's pieces and its own segmentation."""
    path = vocab.locate(None, vocab.PIECES)
    names, by = lattice.pieces(path)
    at = {p: i for i, p in enumerate(names) if p}
    sp = vocab.piece_model(path)

    def words(t):
        body = "".join("\u2581" if c.isspace() else c for c in "\u2581" + t) if t else ""
        out = []
        for i, c in enumerate(body):
            if i == 0 or (c == "\u2581" and body[i - 1] != "\u2581"):
                out.append("")
            out[-1] += c
        return out

    n = [0] * len(names)
    for t in texts:
        for w in words(t or ""):
            for i in sp.encode(w[1:]):
                n[i] += 1
    score = [math.log((x + 1) / (sum(n) + len(n))) for x in n]

    def logp(w):
        a = [0.0] + [-math.inf] * len(w)
        for i in range(len(w)):
            ends = [(j, score[at[w[i:j]]]) for j in range(i + 1, min(len(w), i + 40) + 1) if w[i:j] in at]
            if w[i] not in at:
                ends.append((i + 1, sum(score[by[x]] for x in w[i].encode())))
            for j, s in ends:
                m = max(a[j], a[i] + s)
                a[j] = m + math.log(math.exp(a[j] - m) + math.exp(a[i] + s - m))
        return a[-1]

    return [None if t is None else sum(logp(w) for w in words(t)) for t in texts]


def test_lattice_end_to_end(spark, monkeypatch):
    texts = [None, "", "the cat sat on the mat", "the cat sat on the mat", "naïve \U0001f600 straße\nnew  line", "x" * 3000 + " tail", "日本語の文章です。", " "]
    df = spark.createDataFrame([(i, t, 1, 2) for i, t in enumerate(texts)], "doc_id long, text string, n long, word string").repartition(2)
    want = brute_lattice(texts)
    for long in (1000, 3):  # also with nearly all words worked alone
        got = {r["doc_id"]: r["log_prob"] for r in lattice.lattice_scores(df).collect()}
        assert got[0] is None and all(got[i] == pytest.approx(w, rel=1e-9, abs=1e-9) for i, w in enumerate(want) if w is not None)
        path = vocab.locate(None, vocab.PIECES)
        scores = lattice.unigram_scores(df)
        cp, b, e, _ = lattice.segments([t for t in texts if t])
        args = (cp, b, e, lattice.trie(path), scores, lattice.pieces(path)[1])
        together = lattice.forward(*args)
        monkeypatch.setattr(lattice, "LONG_WORD", long)
        monkeypatch.setattr(lattice, "WINDOW", 7)
        assert np.allclose(together, lattice.forward(*args), rtol=1e-10)
    assert lattice.lattice_scores(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        lattice.lattice_scores(df, keep=("n_words",))


def test_lattice_long_words_in_bounded_memory():
    import tracemalloc

    path = vocab.locate(None, vocab.PIECES)
    r = random.Random(1)
    words = ["".join(r.choice("abcdefghij0123456789") for _ in range(200_000))] + ["w%d" % i for i in range(5000)]
    cp, b, e, _ = lattice.segments([" ".join(words)])
    t, by = lattice.trie(path), lattice.pieces(path)[1]
    scores = np.full(len(lattice.pieces(path)[0]), -10.0)
    tracemalloc.start()
    got = lattice.forward(cp, b, e, t, scores, by)
    assert tracemalloc.get_traced_memory()[1] < 300e6 and np.isfinite(got).all() and got[0] < -1000
    tracemalloc.stop()


def brute_omh(text, k, l, m, seed):
    """Signature entry by entry, with Python numbers."""
    M = (1 << 64) - 1

    def mix(x):
        x = (x ^ (x >> 30)) * 0xBF58476D1CE4E5B9 & M
        x = (x ^ (x >> 27)) * 0x94D049BB133111EB & M
        return x ^ (x >> 31)

    k = min(k, max(1, len(text)))
    grams = []
    for i in range(max(0, len(text) - k + 1)) if text else []:
        h = 0
        for c in text[i : i + k]:
            h = (h * 0x9E3779B97F4A7C15 + mix((ord(c) + 0x632BE59BD9B4E019) & M)) & M
        grams.append(h ^ (h >> 29))
    seen, x = {}, []
    for h in grams:
        x.append(mix((h + seen.get(h, 0) * 0xC2B2AE3D27D4EB4F) & M) >> 32)
        seen[h] = seen.get(h, 0) + 1
    out = []
    for j in range(1, m + 1):
        mul = mix((j * 0x9E3779B97F4A7C15 + seed) & M) >> 32

        def value(i):
            y = ((x[i] ^ mul) * 0x9E3779B1) & 0xFFFFFFFF
            y ^= y >> 15
            return y * 0x85EBCA77 & 0xFFFFFFFF

        a = 0x2545F4914F6CDD1D
        for i in sorted(sorted(range(len(x)), key=lambda i: (value(i), i))[:l]):
            a = ((a ^ grams[i]) * 0x9E3779B97F4A7C15 + (a >> 29)) & M
        out.append(a - (1 << 64) if a >> 63 else a)
    return out


def test_order_minhash_against_brute_force(spark):
    r = random.Random(2)
    texts = [None, "", "a", "ab", "abcdefg", "abcdefgh", "aaaaaaaaaaaaaaaa", "abab" * 40, "the same text", "the same text", "naïve \U0001f600 straße 日本語", "".join(r.choice("abc ") for _ in range(900))]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, __text string")
    for k, l, m in ((8, 3, 16), (2, 1, 5), (3, 9, 4)):
        got = byid(omh.order_minhash(df, k=k, l=l, m=m))
        assert {i: x["signature"] for i, x in got.items()} == {i: None if t is None else brute_omh(t, k, l, m, 7) for i, t in enumerate(texts)}
    assert omh.order_minhash(df.limit(0)).count() == 0
    # a text of a million signs costs memory in proportion
    assert len(byid(omh.order_minhash(spark.createDataFrame([(1, "ab cd" * 200_000)], "doc_id long, text string")))[1]["signature"]) == 16
    with pytest.raises(ValueError):
        omh.order_minhash(df.withColumnRenamed("__text", "signature"), keep=("signature",))


def test_order_minhash(docs):
    got = byid(omh.order_minhash(docs))
    assert got[0]["signature"] is None and len(got[1]["signature"]) == 16 and got[3]["signature"] == got[4]["signature"]
    r = random.Random(1)
    a = "".join(r.choice("abcdefgh ") for _ in range(2000))
    near, swapped = a[:1000] + "z" + a[1000:], a[1000:] + a[:1000]
    agree = lambda x, y: (omh.signature(omh.kmers(np.frombuffer(x.encode("utf-32-le"), np.uint32), 8), omh.seeds(64, 7), 3) == omh.signature(omh.kmers(np.frombuffer(y.encode("utf-32-le"), np.uint32), 8), omh.seeds(64, 7), 3)).mean()
    assert agree(a, a) == 1 and agree(a, near) > 0.8 and agree(a, swapped) < 0.6  # same k-mers in another order differ


def test_hamming_against_brute_force(spark):
    g = np.random.default_rng(5)
    base = g.integers(0, 2**32, 6)
    codes = [(int(base[g.integers(6)]) ^ sum(1 << int(b) for b in g.integers(0, 32, g.integers(0, 9)))) & 0xFFFFFFFF for _ in range(300)] + [0] * 40
    rows = [(i, c, 1) for i, c in enumerate(codes)]
    df = spark.createDataFrame([*rows, rows[0], (None, 3, 1), (9999, None, 1)], "vec_id long, code long, id int")
    for k in (3, 500):
        got = {(r[0], r[1]): (r[3], r[2]) for r in hamming.topk(df, F.col("vec_id"), F.col("code"), k, 32).collect()}
        want = {}
        for i, c, _ in rows:
            for rank, x in enumerate(sorted(((c ^ o).bit_count(), j) for j, o, _ in rows if j != i)[:k], 1):
                want[i, rank] = x
        assert {x: (got.get(x), want.get(x)) for x in got.keys() | want.keys() if got.get(x) != want.get(x)} == {}
    some = {(r[0], r[1]): (r[3], r[2]) for r in hamming.topk(df, F.col("vec_id"), F.col("code"), 4, 32, queries=F.col("vec_id") % 20 == 0).collect()}
    assert some == {x: y for x, y in want.items() if x[0] % 20 == 0 and x[1] <= 4} and len(some) == 17 * 4
    assert hamming.topk(df.limit(0), F.col("vec_id"), F.col("code")).count() == 0 == hamming.topk(df, F.col("vec_id"), F.col("code"), queries=F.lit(False)).count()


def test_hamming_in_small_buckets(spark, monkeypatch):
    monkeypatch.setattr(hamming, "BUCKET", 40)
    monkeypatch.setattr(hamming, "STEP_QUERIES", 5)
    g = np.random.default_rng(6)
    codes = g.integers(0, 2**20, 400).tolist() + [7] * 150
    df = spark.createDataFrame(list(enumerate(codes)), "vec_id long, code long")
    got = {(r[0], r[1]): (r[3], r[2]) for r in hamming.topk(df, F.col("vec_id"), F.col("code"), 3, 20, queries=F.col("vec_id") % 10 == 0).collect()}
    want = {}
    for i in range(0, len(codes), 10):
        for rank, x in enumerate(sorted(((codes[i] ^ c).bit_count(), j) for j, c in enumerate(codes) if j != i)[:3], 1):
            want[i, rank] = x
    assert got == want


def test_licenses_against_all_rules(docs):
    table, sc = licenses.rules(), licenses.scanner()
    assert len(table) >= 200
    for t in [x for x in TEXTS if x and len(x) < 1000] + [" ".join(r.regex.pattern[:40] for r in table[:80])]:
        found = [(r.number, m.start(), m.end()) for r in table for m in r.regex.finditer(t)]
        order = sorted(found, key=lambda f: (-table[f[0]].priority, f[1] - f[2], f[1], f[0]))
        kept = []
        for n, s, e in order:
            inside = any(a <= s and e <= b for _, a, b in kept)
            beaten = any(a < e and s < b and table[m].priority > table[n].priority for m, a, b in kept)
            if e > s and not inside and not beaten:
                kept.append((n, s, e))
        assert sc.scan(t) == sorted(kept, key=lambda k: k[1])
    got = licenses.license_scan(docs).where("doc_id in (6, 10)").collect()
    assert {(r["doc_id"], r["license"]) for r in got} == {(6, "Apache-2.0"), (6, "all-rights-reserved"), (10, "GPL-2.0-or-later"), (10, "MIT")}
    assert licenses.license_scan(docs.limit(0)).count() == 0


def test_crf_marginals_against_enumeration():
    g = np.random.default_rng(2)
    score, pairs, doc = g.normal(size=9), g.normal(size=(2, 2)), np.array([0, 0, 0, 0, 1, 2, 2, 2, 2])
    p, both, logz = crf.marginals(score, doc, pairs)
    want, pair = np.zeros(9), np.zeros((2, 2))
    for d in range(3):
        at = np.flatnonzero(doc == d)
        z, good, pp = 0.0, np.zeros(len(at)), np.zeros((2, 2))
        for y in range(1 << len(at)):
            ys = [(y >> i) & 1 for i in range(len(at))]
            w = math.exp(sum(score[a] * v for a, v in zip(at, ys)) + sum(pairs[u, v] for u, v in zip(ys, ys[1:])))
            z += w
            good += w * np.array(ys)
            for u, v in zip(ys, ys[1:]):
                pp[u, v] += w
        want[at] = good / z
        pair += pp / z
        assert logz[d] == pytest.approx(math.log(z))
    assert np.allclose(p, want) and np.allclose(both, pair)


def test_crf_held_out(spark, docs):
    labels, body = spark.read.parquet("/root/testdata/sf0.1/labels.parquet"), spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    model = crf.train(body, labels.where("doc_id % 2 = 0"), sample_docs=1000)
    out = crf.quality(body, model).join(labels.where("doc_id % 2 = 1").selectExpr("doc_id", "quality as label"), "doc_id").toPandas()
    assert (out.kept == (out.label == 1)).mean() > 0.95
    rows = byid(crf.quality(docs, model))
    assert rows[0]["quality"] is None and not rows[0]["kept"] and rows[1]["quality"] == 0 and not rows[2]["kept"]
    assert crf.filter_quality(docs, model).columns == docs.columns
    none = crf.train(docs, spark.createDataFrame([], "doc_id long, quality int"))
    assert byid(crf.quality(docs, none))[3]["quality"] == 0.5


def test_crf_long_texts_by_parts(monkeypatch):
    """Measures and marginals of a text worked part by part are those of the whole."""
    r = random.Random(5)
    text = "\n".join(" ".join(r.choice(["Word", "it's", "42", "|", "###", "and"]) for _ in range(r.randint(0, 12))) for _ in range(700)) + "\nlast line\nlast line"
    whole = crf.lines([text])
    model = crf.fit(whole, np.arange(len(whole.doc)) % 2, sweeps=20)
    want = crf.marginals(model.scores(whole), whole.doc, model.pairs)
    one = crf.label_texts(["short", text, "", text], model)
    for name, value in (("STEP_CHARS", 500), ("STEP_LINES", 13), ("LONG_CHAIN", 50)):
        monkeypatch.setattr(crf, name, value)
    parts = crf.lines([text])
    assert np.array_equal(parts.x, whole.x) and np.array_equal(parts.number, whole.number) and np.array_equal(parts.length, whole.length)
    got = crf.marginals(model.scores(parts), parts.doc, model.pairs)
    assert np.allclose(got[0], want[0]) and np.allclose(got[1], want[1]) and np.allclose(got[2], want[2])
    again = crf.label_texts(["short", text, "", text], model)
    assert np.allclose(one[0], again[0]) and np.array_equal(one[1], again[1]) and one[2] == again[2]


def test_crf_sample(spark):
    """Bounds of the draw; labels without a document, twice, and clashing names."""
    docs = spark.createDataFrame([(i, "Good words here and there.\nAnother line." if i % 2 else "### | ### |\n$$ 11", 0) for i in range(40)] + [(1000, "word\n" * 3000, 0)], "doc_id long, text string, good int")
    none = [(100 + i, 1) for i in range(300)]
    labels = spark.createDataFrame(none + [(i, i % 2) for i in range(40)] * 2 + [(None, 1), (3, None), (1000, 1)], "doc_id long, quality int")
    for kw in ({"sample_docs": 20}, {"sample_docs": 3000, "sample_lines": 60}):
        rows = byid(crf.quality(docs, crf.train(docs, labels, **kw)))
        assert all(rows[i]["kept"] == bool(i % 2) for i in range(40))
    model = crf.train(docs, labels)
    assert crf.quality(docs.limit(0), model).count() == 0
    twice = docs.where("doc_id < 4").unionByName(docs.where("doc_id < 4")).withColumnRenamed("good", "__text")
    assert crf.filter_quality(twice, model).columns == ["doc_id", "text", "__text"] and crf.quality(twice, model, keep=("doc_id", "__text")).count() == 8
    with pytest.raises(ValueError):
        crf.quality(docs.withColumn("kept", F.lit(1)), model, keep=("kept",))


def brute_lines(rows, ratio, least):
    """(text, dropped) by row number of (host, text) rows."""
    pages, seen = {}, {}
    for h, t in rows:
        if h:
            pages[h] = pages.get(h, 0) + 1
            for x in {x.strip(" ") for x in (t or "").split("\n")} - {""}:
                seen[h, x] = seen.get((h, x), 0) + 1
    out = []
    for h, t in rows:
        kept = [x for x in (t or "").split("\n") if not x.strip(" ") or not (seen.get((h, x.strip(" ")), 0) >= least and seen[h, x.strip(" ")] / pages[h] > ratio)] if h else (t or "").split("\n")
        out.append((None if t is None else "\n".join(kept), len((t or "").split("\n")) - len(kept)))
    return out


def test_line_dedup_against_brute_force(spark, monkeypatch):
    r = random.Random(7)
    rows = [(r.choice(["a", "a", "a", "b", "c", "", None]), "\n".join(r.choice(["menu", " menu ", "foot", "", "  ", f"line {r.randint(0, 30)}"]) for _ in range(r.randint(0, 9)))) for _ in range(150)]
    rows += [("d", None), ("d", "x\n" * 50_000), ("d", "x"), ("a", rows[0][1]), ("a", rows[0][1])]
    clash = ("__host", "__bad", "site", "bad", "salt", "c0", "hit", "pages")
    df = spark.createDataFrame([(i, h, t) for i, (h, t) in enumerate(rows)], "n long, host string, text string").selectExpr("*", *[f"{i} as {x}" for i, x in enumerate(clash)])
    monkeypatch.setattr(line_dedup, "SPREAD", 3)
    for ratio, least, limit in ((0.05, 2, 1 << 20), (0.3, 4, -1), (0.05, 2, -1)):
        out = line_dedup.drop_boilerplate(df, F.col("host"), ratio=ratio, min_pages=least, dropped="gone", broadcast_bytes=limit)
        assert out.columns == [*df.columns, "gone"]
        got = {x["n"]: x for x in out.collect()}
        assert [(got[i]["text"], got[i]["gone"]) for i in range(len(rows))] == brute_lines(rows, ratio, least)
        assert all(got[i][x] == k for i in got for k, x in enumerate(clash))
    assert line_dedup.drop_boilerplate(df.limit(0), F.col("host"), broadcast_bytes=-1).count() == 0
    with pytest.raises(ValueError):
        line_dedup.drop_boilerplate(df, F.col("host"), dropped="pages")


def test_mixing_keeps_values_that_no_target_names(spark):
    schema = "doc_id long, text string, lang string, source string, __source int, __w int, c0 int, topic string"
    rows = [(i, "w " * 20, "en" if i % 7 else None, "abc"[i % 3] if i % 10 else None, 1, 2, 3, "xy"[i % 2]) for i in range(3000)]
    df = spark.createDataFrame([*rows, rows[0], (5000, None, "en", "a", 1, 2, 3, "x"), (5001, "", "en", "a", 1, 2, 3, "x")], schema)
    got = mixing.mix_sources(df, targets={"source": {"a": 1.0, "b": 3.0}}, powers={"lang": 1.0, "topic": 1.0}, extra=False, topic="topic")
    assert got.columns == df.columns
    n = {r["source"]: r["n"] for r in got.groupBy("source").agg(F.count(F.lit(1)).alias("n")).collect()}
    whole = sum(n.values())
    # c and the null source keep their shares; a and b divide the rest 1 to 3
    assert n["c"] / whole == pytest.approx(0.3, abs=0.04) and n[None] / whole == pytest.approx(0.1, abs=0.03)
    assert n["b"] / n["a"] == pytest.approx(3, rel=0.25)
    none = mixing.mix_sources(df, targets={"source": {"a": 1.0, "b": 0.0}}, extra=False, topic="topic")
    assert {r[0] for r in none.select("source").distinct().collect()} == {"a", "c", None}
    same = [r["doc_id"] for r in mixing.mix_sources(df.where("doc_id = 0"), extra=False, topic="topic").collect()]
    assert same in ([0, 0], [])
    with pytest.raises(ValueError):
        mixing.mix_sources(df)


def test_raking_meets_the_marginals(spark):
    g = np.random.default_rng(3)
    rows = [(f"s{s}", f"l{l}", f"t{t}", int(g.integers(1, 10_000))) for s in range(5) for l in range(4) for t in range(3)]
    out = mixing.rake(spark.createDataFrame(rows, "source string, lang string, topic string, __tokens long"), ["source", "lang", "topic"], mixing.POWERS, mixing.SWEEPS).toPandas()
    total = sum(r[3] for r in rows)
    for d, p in mixing.POWERS.items():
        k = ["source", "lang", "topic"].index(d)
        want = {v: (sum(r[3] for r in rows if r[k] == v) / total) ** p for v in {r[k] for r in rows}}
        got = out.groupby(d)["__w"].sum() / out["__w"].sum()
        assert all(abs(got[v] - w / sum(want.values())) < 1e-6 for v, w in want.items())


def test_lines_and_mixing(spark, docs):
    rows = [(i, "menu\nbody %d\nmenu" % i, "h") for i in range(6)] + [(7, "menu", "small"), (8, None, "h"), (9, "menu", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, host string")
    got = byid(line_dedup.drop_boilerplate(df, F.col("host"), ratio=0.5, dropped="gone"))
    assert got[0]["text"] == "body 0" and got[0]["gone"] == 2 and got[7]["text"] == "menu" and got[8]["text"] is None and got[9]["text"] == "menu"
    even = spark.createDataFrame([(i, "w " * 10, "en", "a" if i < 900 else "b") for i in range(1000)], "doc_id long, text string, lang string, source string")
    out = {r["source"]: r["n"] for r in mixing.mix_sources(even, targets={"source": {"a": 0.5, "b": 0.5}}).groupBy("source").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert out["b"] == 100 and 60 < out["a"] < 140
    assert mixing.mix_sources(docs, extra=False).columns == docs.columns and mixing.mix_sources(docs.limit(0)).count() == 0


def test_mixing_with_a_scarce_source(spark):
    rows = [(i, "w " * 50, "en", "a" if i % 2 else "b") for i in range(1000)]
    schema = "doc_id long, text string, lang string, source string"
    base = {r["doc_id"]: r["probability"] for r in mixing.mix_sources(spark.createDataFrame(rows, schema)).collect()}
    assert len(base) == 1000
    for lang in ("en", None):
        got = {r["doc_id"]: r["probability"] for r in mixing.mix_sources(spark.createDataFrame([*rows, (5000, "one small document", lang, None)], schema)).collect()}
        assert got[5000] == 1 and len(got) == 1001 and min(got.values()) > 0.99
    # explicit targets stay exact, however scarce a source is
    few = spark.createDataFrame([(i, "w " * 10, "en", "a" if i < 9900 else "b") for i in range(10_000)], schema)
    out = {r["source"]: r["n"] for r in mixing.mix_sources(few, targets={"source": {"a": 0.96, "b": 0.04}}).groupBy("source").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert out["b"] == 100 and 2100 < out["a"] < 2700


def test_lines_of_small_hosts(spark):
    import corpus_pipeline

    rows = [(10 * n + i, f"page {n} {i}\nfooter {n}\n \nend", "en", f"h{n}", 0) for n in (1, 2, 3, 4) for i in range(n)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for out in (line_dedup.drop_boilerplate(df, F.col("source")), corpus_pipeline.line_frequency(spark, df, SF)):
        assert {i: r["text"] for i, r in byid(out).items()} == {r[0]: r[1] if r[3] == "h1" else r[1].split("\n")[0] + "\n " for r in rows}


def example(tree, r):
    """A text of a parsed regex: each repeat by its least number or one more, any branch, any sign of a set."""
    from re import _constants as C

    out = ""
    for op, v in tree:
        if op is C.LITERAL:
            out += chr(v)
        elif op in (C.ANY, C.NOT_LITERAL):
            out += "x"
        elif op is C.IN:
            kind, x = r.choice(v)
            signs = {C.CATEGORY_SPACE: " \n", C.CATEGORY_DIGIT: "27", C.CATEGORY_WORD: "w"}
            out += "x" if v[0][0] is C.NEGATE else chr(x) if kind is C.LITERAL else chr(r.randint(*x)) if kind is C.RANGE else r.choice(signs[x])
        elif op is C.BRANCH:
            out += example(r.choice(v[1]), r)
        elif op is C.SUBPATTERN:
            out += example(v[3], r)
        elif op in (C.MAX_REPEAT, C.MIN_REPEAT):
            out += "".join(example(v[2], r) for _ in range(r.randint(v[0], min(v[1], v[0] + 1))))
        elif op is C.ASSERT:
            out += example(v[1], r)
    return out


def test_license_gates_lose_nothing():
    from re import _parser

    sc, r = licenses.scanner(), random.Random(4)
    for rule in sc.rules:
        tree = _parser.parse(rule.regex.pattern, rule.regex.flags)
        texts = [t for t in (example(tree, r) for _ in range(200)) if rule.regex.search(t)]
        assert texts and {t for t in texts if rule.number not in sc.candidates(t)} == set(), rule
    for t in ("CreativeML Open RAIL-M", "creative ml open\nrail", "BigScience OpenRAIL-M"):
        assert [(sc.rules[n].license, s, e) for n, s, e in sc.scan(t)] == [("OpenRAIL", 0, len(t))]


def test_long_license_notices():
    sc = licenses.scanner()

    def found(t):
        return [(sc.rules[n].license, t[s:e]) for n, s, e in sc.scan(t)]

    names = ", ".join(f"Holder Number {i}, Inc" for i in range(40))
    for head in ("Copyright (c) 1998, 2004 by ", "© 2020 "):
        line = head + names
        assert found(f"// x\n{line}\nnext line") == [("copyright-notice", line)]
        # what follows in a long line stays a detection of its own
        assert found(f"{line}. All rights reserved.") == [("copyright-notice", line + ". "), ("all-rights-reserved", "All rights reserved.")]
        assert [x[0] for x in found(f"{line}. It has the MIT License")] == ["copyright-notice", "MIT"]
        assert found(f"{line}; {head}Other") == [("copyright-notice", line + "; "), ("copyright-notice", head + "Other")]
    for name, t in (
        ("BSD-3-Clause", f"Neither the name of {names}., nor the names of its contributors may be used to endorse or promote"),
        ("proprietary", f"Unauthorized copying by {names} is strictly prohibited"),
        ("proprietary", f"may not be reproduced by {names} without prior written permission"),
        ("no-derivatives", f"may not be copied by {names} without permission"),
    ):
        assert found(t + ". More") == [(name, t)]
    t = "Neither the name of the wind.\n" * 2000
    assert found(t) == []


def test_license_rows(spark):
    """Long, repeated and empty texts, clashing names."""
    long = "word word " * 200_000 + "\nThe MIT License\n" + "more words " * 200_000
    rows = [(1, long, 1), (2, "The MIT License", 2), (2, "The MIT License", 2), (3, "", 3), (None, "The MIT License", 4)]
    df = spark.createDataFrame(rows, "doc_id long, text string, __text int")
    got = sorted(((r["doc_id"] or 0), r["license"], r["start"], r["__text"]) for r in licenses.license_scan(df, keep=("doc_id", "__text")).collect())
    at = long.index("The MIT") if ("The MIT License"[:3] and licenses.scanner().scan("The MIT License")[0][1] == 0) else long.index("MIT")
    off = licenses.scanner().scan("The MIT License")[0][1]
    assert got == [(0, "MIT", off, 4), (1, "MIT", at, 1), (2, "MIT", off, 2), (2, "MIT", off, 2)]
    with pytest.raises(ValueError):
        licenses.license_scan(df.withColumnRenamed("__text", "rule"), keep=("rule",))

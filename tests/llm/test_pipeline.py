"""The pipeline against a brute-force version of its stages in plain Python; only the trained classifier is taken as given."""

import hashlib
import re
from collections import Counter

import pytest

import corpus_pipeline
from orrery.llm import crf, vocab

SF = "/root/testdata/sf0.001"


def brute_lines(docs):
    pages, seen = Counter(d["source"] for d in docs if d["source"]), Counter()
    for d in docs:
        if d["source"]:
            seen.update((d["source"], x) for x in {x.strip(" ") for x in (d["text"] or "").split("\n")} - {""})
    out = []
    for d in docs:
        if d["text"] is None or not d["source"]:
            out.append(d)
            continue
        n = pages[d["source"]]
        text = "\n".join(x for x in d["text"].split("\n") if not x.strip(" ") or not (seen[d["source"], x.strip(" ")] >= 2 and seen[d["source"], x.strip(" ")] / n > 0.05))
        out.append(d | {"text": text, "n_chars": len(text)})
    return out


def brute_duplicates(docs):
    def grams(text):
        w = re.findall(r"[^\W_]+", (text or "").lower())
        return frozenset(zip(w, w[1:], w[2:])) if len(w) >= 3 else frozenset([tuple(w)]) if w else frozenset()

    items = [(d["doc_id"], grams(d["text"])) for d in docs if d["doc_id"] is not None]
    items = [(i, s) for i, s in items if s]
    root = {i: i for i, _ in items}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for k, (i, a) in enumerate(items):
        for j, b in items[k + 1 :]:
            if min(len(a), len(b)) >= 0.5 * max(len(a), len(b)) and len(a & b) >= 0.5 * len(a | b) - 1e-9:
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return [d for d in docs if d["doc_id"] is None or root.get(d["doc_id"], d["doc_id"]) == d["doc_id"] or find(d["doc_id"]) == d["doc_id"]]


def brute_mix(docs):
    powers = {"source": 0.8, "lang": 0.9, "topic": 1.0}

    def facts(d):
        t, low = d["text"] or "", (d["text"] or "").lower()
        topic = "table" if " | " in t else "legal" if "licens" in low or "rights reserved" in low else "contact" if "@" in t else "prose"
        return (d["source"] or "", d["lang"] or "", topic), len([x for x in re.split("[ \t\n\r\f]+", t) if x])

    cells = Counter()
    for d in docs:
        cell, n = facts(d)
        cells[cell] += n
    cells = {c: float(n) for c, n in cells.items() if n}
    w, total = dict(cells), sum(cells.values())

    def marginal(w, k):
        out = Counter()
        for c, x in w.items():
            out[c[k]] += x
        return out

    goal = []
    for k, p in enumerate(powers.values()):
        s = {v: (x / total) ** p for v, x in marginal(cells, k).items()}
        goal.append({v: x / sum(s.values()) * total for v, x in s.items()})
    for _ in range(8):
        for k in range(3):
            m = marginal(w, k)
            w = {c: x * goal[k][c[k]] / m[c[k]] for c, x in w.items()}
    rate = {c: w[c] / cells[c] for c in cells}
    above = lambda r: sum(w[c] for c in w if rate[c] >= r)
    scarce = {c for c in w if rate[c] > 1.5 and above(rate[c]) <= 0.05 * sum(w.values())}
    top = max((rate[c] for c in w if c not in scarce), default=1.0)
    kept = []
    for d in docs:
        cell, n = facts(d)
        name = str(d["doc_id"]) if d["doc_id"] is not None else d["text"] or ""
        if n and int(hashlib.md5(("mix" + name).encode()).hexdigest()[:8], 16) / 4294967296 < min(1.0, rate[cell] / top):
            kept.append(d)
    return kept


def brute_tokens(docs):
    enc = vocab.byte_encoder(vocab.locate(None, vocab.BYTE_RANKS))
    return [{k: d[k] for k in ("doc_id", "lang", "source")} | {"token_ids": enc.encode_ordinary(d["text"]), "n_tokens": len(enc.encode_ordinary(d["text"])), "decoded": d["text"]} for d in docs]


def rows(df):
    return sorted((r.asDict() for r in df.collect()), key=repr)


AWKWARD = [(10**6, None, "en", "web", 0), (None, "no id\nbut a text of its own for once", "en", "web", 36), (10**6 + 1, "", None, None, 0), (10**6 + 2, "Plain words. " * 20_000, "en", "web", 260_000), (10**6 + 3, "Plain words. " * 20_000, "en", "web", 260_000), (10**6 + 4, "twice", "de", None, 5), (10**6 + 4, "twice", "de", None, 5)]


@pytest.mark.parametrize("kind", ["as given", "awkward", "empty"])
def test_every_stage(spark, kind):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select(*corpus_pipeline.COLUMNS)
    if kind == "awkward":
        docs = docs.where("doc_id % 3 = 0").unionByName(spark.createDataFrame(AWKWARD, docs.schema))
    elif kind == "empty":
        docs = docs.limit(0)
    docs = docs.cache()
    # the trained model is the stage's own, with labels and documents of the folder
    model = crf.train(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet"))
    body = [r.asDict() for r in docs.collect()]
    quality, lines, _ = crf.label_texts([d["text"] or "" for d in body], model)
    want = [d for d, q, n in zip(body, quality, lines) if d["text"] is not None and n and q >= 0.5]
    for (name, stage), brute in zip(corpus_pipeline.STAGES, (None, brute_lines, brute_duplicates, brute_mix, brute_tokens)):
        docs = stage(spark, docs, SF).cache()
        want = want if brute is None else brute(want)
        assert rows(docs) == sorted(want, key=repr), name
        if name != "byte_bpe":
            assert docs.columns == corpus_pipeline.COLUMNS
    assert kind == "empty" or 0 < len(want) < len(body)


def test_run(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF).cache()
    assert rows(corpus_pipeline.run(spark, SF)) == rows(docs)

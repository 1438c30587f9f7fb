"""The prefix-tree join against brute force, in all ways a block can be worked."""

import random
import re
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest

from orrery.llm import ngram_join as N

WORDS = [f"w{i}" for i in range(60)]


def corpus(seed=3, most=9):
    r = random.Random(seed)
    base = [[r.choice(WORDS) for _ in range(r.randint(1, 60))] for _ in range(12)]
    docs = []
    for b in base:
        for _ in range(r.randint(1, most)):
            t = [w if r.random() > 0.06 else r.choice(WORDS) for w in b]
            docs.append(" ".join(t))
    docs += ["", "   ", "one", "One!", "two words", "x " * 3000, "x " * 3000]
    docs += [docs[0], docs[0], docs[0] + " and a tail of its own", docs[0] + " and another tail"]
    return [(i, d) for i, d in enumerate(docs)] + [(1000, None), (None, docs[0]), (0, docs[0]), (1, docs[-8])]


def grams(text, n=3):
    w = re.findall(r"[^\W_]+", text.lower())
    return frozenset(zip(*[w[i:] for i in range(n)])) if len(w) >= n else frozenset([tuple(w)]) if w else frozenset()


def brute(rows, t):
    """(class, links) of each linked id: all pairs of distinct (id, set)."""
    items = sorted({(i, grams(d)) for i, d in rows if i is not None and d and grams(d)}, key=lambda x: (x[0], sorted(x[1])))
    links, root = {}, {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for k, (i, a) in enumerate(items):
        for j, b in items[k + 1 :]:
            if len(a & b) >= t * len(a | b) - 1e-9:
                links[i], links[j] = links.get(i, 0) + 1, links.get(j, 0) + 1
                root[max(find(i), find(j))] = min(find(i), find(j))
    return {i: (find(i), n) for i, n in links.items()}


def rows_of(df):
    return {r["doc_id"]: (r["class_id"], r["n_links"]) for r in df.collect()}


@pytest.mark.parametrize("t,block,chunks,edges", [(0.5, 400_000, 32, 4_000_000), (0.5, 300, 32, 4_000_000), (0.5, 200, 1, 3), (0.8, 400_000, 32, 3), (1.0, 400_000, 32, 4_000_000)])
def test_against_brute_force(spark, monkeypatch, t, block, chunks, edges):
    monkeypatch.setattr(N, "MAX_CHUNKS", chunks)
    monkeypatch.setattr(N.set_pairs, "__defaults__", (block,))
    monkeypatch.setattr(N.components, "__defaults__", (edges,))
    rows = corpus()
    names = ("id", "token", "sid", "root", "links", "class_id", "n_links", "k0", "rep")
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", *[f"{i} as {x}" for i, x in enumerate(names)]).repartition(3)
    got = rows_of(N.ngram_join(docs, t, block_grams=700))
    assert got == brute(rows, t)


def test_empty_and_string_ids(spark):
    docs = spark.createDataFrame(corpus(), "doc_id long, text string")
    assert N.ngram_join(docs.limit(0)).count() == 0
    assert N.ngram_join(docs.where("doc_id = 1000 or text = ''")).count() == 0
    got = {r["name"]: r["n_links"] for r in N.ngram_join(docs.where("doc_id in (2, 3)").selectExpr("concat('d', doc_id) as name", "'a b c d' as text"), key="name").collect()}
    assert got == {"d2": 1, "d3": 1}


def test_one_long_text_among_copies(spark):
    r = random.Random(8)
    long = " ".join(f"v{r.randint(0, 10**9)}" for _ in range(60_000))
    rows = [(1, long), (2, long + " tail"), (3, " ".join(long.split()[:40_000])), (4, " ".join(long.split()[:20_000]))]
    got = rows_of(N.ngram_join(spark.createDataFrame(rows, "doc_id long, text string"), block_grams=5_000))
    # 40,000 of 60,000 n-grams; 20,000 of 40,000 just reach a half or just miss it
    want = brute(rows, 0.5)
    assert got == want and set(got) >= {1, 2, 3}


@pytest.mark.parametrize("t", [0.3, 0.5, 0.9])
def test_tree_of_random_sets(t):
    """Traversal with pruning against all pairs, in a trie of many forks, ends inside paths and equal lists."""
    g = np.random.default_rng(int(t * 10))
    lists, sizes = [], []
    for b in range(3):
        for _ in range(60):
            base = np.flatnonzero(g.random(70) < 0.3) if not lists or g.random() < 0.3 else lists[g.integers(len(lists))][1]
            x = np.unique(np.concatenate([base[g.random(len(base)) < 0.9], g.integers(0, 70, g.integers(0, 4))]))
            if len(x):
                lists.append((b, x.astype(np.int64)))
    weight_of = g.integers(1, 5, (3, 70))
    w = [weight_of[b][x] for b, x in lists]
    sizes = np.array([int(x.sum()) + int(g.integers(0, 3)) for x in w])
    prefix = []
    for x, size in zip(w, sizes):
        rest = x.sum() - (np.cumsum(x) - x)
        prefix.append(int((rest >= max(1, np.ceil(t * size - 1e-9))).sum()))
    s = N.Sets(np.array([b for b, _ in lists]), np.concatenate([x for _, x in lists]), np.concatenate(w).astype(np.int64), np.array([len(x) for _, x in lists]), np.array(prefix), sizes)
    got = {}
    for a, b, o in N.tree_join(s, t):
        for i, j, k in zip(s.order[a].tolist(), s.order[b].tolist(), o.tolist()):
            assert (min(i, j), max(i, j)) not in got
            got[min(i, j), max(i, j)] = k
    want = {}
    for i in range(len(lists)):
        for j in range(i):
            if lists[i][0] == lists[j][0]:
                o = int(weight_of[lists[i][0]][np.intersect1d(lists[i][1], lists[j][1])].sum())
                if o and o >= t * (sizes[i] + sizes[j] - o) - 1e-9:
                    want[j, i] = o
    assert got == want and len(want) > 15


def test_forest():
    g = np.random.default_rng(1)
    u, v = g.integers(0, 400, 300), g.integers(0, 400, 300)
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in zip(u.tolist(), v.tolist()):
        root[max(find(a), find(b))] = min(find(a), find(b))
    node, label = N.forest(u, v)
    assert dict(zip(node.tolist(), label.tolist())) == {x: find(x) for x in set(u.tolist()) | set(v.tolist())}
    batch = pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])
    assert sum(b.num_rows for b in N._contract([batch])) == len(node)


def test_grams_shared_by_chance_make_no_suspects(spark, monkeypatch):
    """Nearly every n-gram stands in several documents; only the planted copies go on to the lists."""
    r = random.Random(11)
    docs = [" ".join(r.choice(WORDS[:20]) for _ in range(60)) for _ in range(400)]
    docs += [d + " " + r.choice(WORDS) for d in docs[:6]]
    rows, written = list(enumerate(docs)), {}
    spill = N.spill_table

    def counted(df, tag):
        out = spill(df, tag)
        written[tag] = out.count()
        return out

    monkeypatch.setattr(N, "spill_table", counted)
    got = rows_of(N.ngram_join(spark.createDataFrame(rows, "doc_id long, text string").repartition(2), block_grams=3_000))
    assert got == brute(rows, 0.5) and len(got) == 12
    assert 12 <= written["lists"] <= 40


def test_shuffle_files_go_when_their_table_is_written(spark):
    """Both exchanges of a table that is still in use are gone at once, without waiting for another query."""
    import time

    from orrery.runtime import spill_table

    made = lambda: sum(1 for _ in Path(folder).rglob("shuffle_*.data"))
    folder = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()[0]
    was = spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled", None)
    at = made()
    df = spark.range(20_000).repartition(3, "id").sortWithinPartitions("id").selectExpr("id div 7 as k").repartition(3, "k")
    out = spill_table(df, "probe")
    for _ in range(50):
        if made() <= at:
            break
        time.sleep(0.1)
    assert made() <= at
    assert out.count() == 20_000 and spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled", None) == was
    df.write.format("noop").mode("overwrite").save()  # another query's files stay, as before
    assert made() > at


def test_tokens_connect_possible_partners_only():
    """Sets 1 and 34 (groups 1 and 2) may be partners, 3 and 4 not; a token's rows go over two batches."""
    token, sid = np.array([5, 5, 5, 5, 7, 7]), np.array([1, 3, 34, 4, 3, 4])
    hot = np.array([1 << 2, 1 << 1, 1 << 1, 1 << 9, 1 << 8, 1 << 3])
    batch = pa.RecordBatch.from_arrays([pa.array(token), pa.array(sid), pa.array(hot)], names=["token", "sid", "hot"])
    edges = [x for b in N._met([batch.slice(0, 2), batch.slice(2)]) for x in zip(b.column(0).to_pylist(), b.column(1).to_pylist())]
    assert {e for e in edges if e[0] != e[1]} == {(34, 1)}


def test_chance_tokens_connect_no_sets():
    """Sets that share a token, but can't share enough by what is left from it on or by their sketches, stay apart, over batches too."""
    one = lambda *at: sum(1 << 4 * k for k in at).to_bytes(N.SKETCH // 2, "little")
    a, b, wide = one(*range(9)), one(*range(20, 29)), one(*range(14))
    rows = [  # token, sid, rest, sketch; sizes are 10, so partners share 6.7
        (1, 50, 9, a), (1, 60, 9, a), (2, 51, 9, a), (2, 61, 5, a), (3, 52, 9, a), (3, 62, 9, b),
        (5, 63, 9, a), (5, 64, 9, wide), (5, 65, 9, b), (6, 60, 9, a), (6, 70, 9, a),
    ]
    cols = [pa.array(x) for x in ([r[0] for r in rows], [r[1] for r in rows], [N.FULL] * len(rows), [10] * len(rows), [r[2] for r in rows])]
    batch = pa.RecordBatch.from_arrays([*cols, pa.array([r[3] for r in rows], pa.binary())], names=["token", "sid", "hot", "size", "rest", "sketch"])
    edges = [x for b in N._met([batch.slice(0, 5), batch.slice(5, 3), batch.slice(8)], 0.5) for x in zip(b.column(0).to_pylist(), b.column(1).to_pylist())]
    assert {e for e in edges if e[0] != e[1]} == {(60, 50), (64, 63), (70, 50)}
    filled = bytes([0xFF]) * (N.SKETCH // 2)
    assert N._shareable(*(np.frombuffer(x, np.uint8)[None] for x in (filled, filled)))[0] == np.inf


def test_second_reading_must_give_the_same_rows(monkeypatch):
    import pyspark

    class Context:
        get = staticmethod(lambda: type("C", (), {"partitionId": lambda _: 0})())

    monkeypatch.setattr(pyspark, "TaskContext", Context)
    batch = pa.RecordBatch.from_arrays([pa.array([1, 2]), pa.array(["a b c", "d e f g"])], names=["id", "text"])
    kept = {0: (2, N._mark(["a b c", "d e f g"], 0), np.ones(2, bool))}
    run = N._blocks(3, 3, pa.int64(), 100, type("B", (), {"value": kept})())
    assert list(run([batch]))
    with pytest.raises(ValueError):
        list(run([batch.take(pa.array([1, 0]))]))

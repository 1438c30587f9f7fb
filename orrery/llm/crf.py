"""Quality classifier: a linear-chain conditional random field over the lines of a text.

Every non-blank line is good or bad. A line's features are measures of its own
signs and those of the lines before and behind it, cut into steps at quantiles
of the training sample; the chain adds weights for neighbouring labels. The
model is fitted on the driver, by gradient, on a bounded sample of labelled
documents (each line bears its document's label); the feature rows of the
sample are made on the executors. Scoring is one pass over the texts with no
shuffle: forward-backward marginals of all documents of a batch advance
together, and a document's quality is the mean of its lines' probabilities of
being good, weighted by their lengths.

Rows, defined results: null text -> null quality, not kept; a text without a
non-blank line -> quality 0, not kept; repeated rows -> a row each; an empty
table -> an empty result; no labelled document -> quality 0.5 for every text
(all kept); a document with several labels counts with each of them; null
labels are left out; a text of any length is worked whole: its lines are
measured a part at a time and their messages run through all parts; all columns
of ``docs``, whatever their names, are returned by ``filter_quality``, only
``keep`` columns by ``quality``, and none of these may be named like a result.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orrery.llm import textkit as K
from orrery.llm.bpe import _arrow_schema
from orrery.runtime import attach

#: The bounds of the training sample: labelled documents, and lines of all of them together (whole documents, in the order of the draw).
SAMPLE_DOCS = 3_000
SAMPLE_LINES = 200_000
#: Lines whose indicators are made together, and lines from which a chain is worked alone.
STEP_LINES = 50_000
LONG_CHAIN = 5_000
STEPS = 6
STEP_CHARS = 500_000
NAMES = ("length", "words", "letters", "upper", "digits", "spaces", "signs", "odd_signs", "bangs", "bars", "word_length", "distinct_words", "stops", "same_sign_runs", "repeats", "echoes")
_ODD = np.zeros(0x110000, bool)
_ODD[[ord(c) for c in "#$%&*+<=>@\\^_`{}~"]] = True


@dataclass
class Lines:
    """Non-blank lines of a batch: their documents, lengths, numbers and features."""

    doc: np.ndarray
    length: np.ndarray
    number: np.ndarray
    x: np.ndarray
    whole: np.ndarray | None = None  # sums of word hashes, equal for equal lines


TWIN = NAMES.index("repeats")


def parts_of(text: str, limit: int) -> list[str]:
    """``text`` cut behind line ends into parts of about ``limit`` signs."""
    out, at = [], 0
    while len(text) - at > limit:
        cut = text.find("\n", at + limit) + 1
        if not cut:
            break
        out.append(text[at:cut])
        at = cut
    out.append(text[at:])
    return out


def lines(texts: list[str]) -> Lines:
    """Lines of all texts and their measures; a text beyond ``STEP_CHARS`` part by part."""
    if len(texts) != 1 or len(texts[0]) <= STEP_CHARS:
        return _lines(texts)
    found, number = [], 0
    for part in parts_of(texts[0], STEP_CHARS):
        ls = _lines([part])
        ls.number = ls.number + number
        number += part.count("\n")
        found.append(ls)
    doc, length, numbers, x, whole = (np.concatenate([getattr(ls, c) for ls in found]) for c in ("doc", "length", "number", "x", "whole"))
    _, inv, n = np.unique(whole, return_inverse=True, return_counts=True)
    x[:, TWIN] = n[inv] > 1
    return Lines(doc, length, numbers, x, whole)


def _lines(texts: list[str]) -> Lines:
    """Lines of all texts and their measures (each a share or a bounded logarithm)."""
    cp, starts = K.codepoints(texts)
    n = len(cp)
    first = K.doc_flags(n, starts)[:n]
    if not n:
        return Lines(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros((0, len(NAMES)), np.float32), np.zeros(0))
    end = cp == 10
    cls = K.class_table()[cp]
    begin = first.copy()
    begin[1:] |= end[:-1]
    b = np.flatnonzero(begin)
    e = np.append(b[1:], n)
    doc = np.searchsorted(starts, b, "right") - 1
    size = e - b
    ink = np.add.reduceat((cls != K.SPACE).astype(np.int64), b)
    # number of each line in its document
    number = np.arange(len(b)) - np.searchsorted(b, starts[doc], "left")
    ok = ink > 0

    def total(mask: np.ndarray) -> np.ndarray:
        return np.add.reduceat(mask.astype(np.int64), b).astype(np.float64)

    low = K.lower_table()[cp]
    letter, number_, space = cls == K.LETTER, cls == K.NUMBER, cls == K.SPACE
    sign = cls == K.OTHER
    wordy = ~space
    wb = wordy.copy()
    wb[1:] &= ~wordy[:-1] | begin[1:]
    words = total(wb)
    same = np.zeros(n, bool)
    same[1:] = (cp[1:] == cp[:-1]) & sign[1:] & ~begin[1:]
    wordend = sign.copy()
    wordend[:-1] &= space[1:] | begin[1:]
    # distinct words of a line, by hash; a line that stands twice in a text
    beg_w, end_w = K.runs(wordy, begin)
    h = K.span_hashes(low, beg_w, end_w)
    of = np.searchsorted(b, beg_w, "right") - 1
    echo = np.zeros(len(h), bool)
    echo[1:] = (h[1:] == h[:-1]) & (of[1:] == of[:-1])
    o = np.lexsort((h, of))
    new = np.ones(len(o), bool)
    new[1:] = (h[o][1:] != h[o][:-1]) | (of[o][1:] != of[o][:-1])
    distinct = np.bincount(of[o][new], minlength=len(b)).astype(np.float64)
    whole = np.bincount(of, weights=(h >> np.uint64(32)).astype(np.float64), minlength=len(b))
    o = np.lexsort((whole, doc))
    twin = np.zeros(len(b), bool)
    eq = (whole[o][1:] == whole[o][:-1]) & (doc[o][1:] == doc[o][:-1])
    twin[o[1:]] |= eq
    twin[o[:-1]] |= eq
    wl = end_w - beg_w
    stops = np.bincount(of, weights=(wl <= 3).astype(np.float64), minlength=len(b))
    size_f, ink_f, w = np.maximum(size, 1.0), np.maximum(ink, 1.0), np.maximum(words, 1.0)
    letters = total(letter)
    x = np.stack(
        [
            np.log1p(size), np.log1p(words), letters / ink_f, total(letter & (low != cp)) / np.maximum(letters, 1.0), total(number_) / ink_f,
            total(space) / size_f, total(sign) / ink_f, total(_ODD[cp]) / ink_f, total(cp == 33) / w, total(cp == 124) / w,
            ink_f / w, distinct / w, stops / w, total(same) / w, twin.astype(np.float64), np.bincount(of[echo], minlength=len(b)) / w,
        ],
        axis=1,
    )
    return Lines(doc[ok], size[ok], number[ok], x[ok].astype(np.float32), whole[ok])


@dataclass
class Model:
    cuts: np.ndarray  # measures x steps
    weights: np.ndarray  # weights of the indicators for "good"
    pairs: np.ndarray  # 2 x 2, label before and label

    def scores(self, ls: Lines) -> np.ndarray:
        """Score of "good" against "bad" of each line, its neighbours' measures included."""
        w, n = self.weights.astype(np.float32), len(ls.doc)
        out = np.empty(n)
        for lo in range(0, n, STEP_LINES):  # with a neighbour on either side
            hi = min(n, lo + STEP_LINES)
            a, b = max(0, lo - 1), min(n, hi + 1)
            part = Lines(ls.doc[a:b], ls.length[a:b], ls.number[a:b], ls.x[a:b])
            out[lo:hi] = (indicators(part, self.cuts) @ w)[lo - a : hi - a]
        return out


def indicators(ls: Lines, cuts: np.ndarray) -> np.ndarray:
    """Steps reached by the measures of a line and of its neighbours, their presence, and a constant."""
    n, m = ls.x.shape
    own = (ls.x[:, :, None] > cuts[None]).reshape(n, m * cuts.shape[1]).astype(np.float32)
    out = np.zeros((n, 3 * own.shape[1] + 3), np.float32)
    k = own.shape[1]
    out[:, :k] = own
    if n > 1:
        joined = (ls.doc[1:] == ls.doc[:-1])[:, None]
        out[1:, k : 2 * k] = own[:-1] * joined
        out[:-1, 2 * k : 3 * k] = own[1:] * joined
        out[1:, 3 * k] = joined[:, 0]
        out[:-1, 3 * k + 1] = joined[:, 0]
    out[:, -1] = 1
    return out


def marginals(score: np.ndarray, doc: np.ndarray, pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Forward-backward over all chains at once.

    Returns P(good) of each line, the expected label pairs (2 x 2, summed) and
    log Z of each chain. Messages are probabilities, renormalised at each line.
    """
    n = len(score)
    beg = K.groups(doc)
    size = np.diff(np.append(beg, n))
    if n and int(size.max()) > LONG_CHAIN:
        return _marginals_apart(score, doc, pairs, beg, size)
    order = np.argsort(-size, kind="stable")
    beg, size = beg[order], size[order]
    longest = int(size[0]) if len(size) else 0
    live = np.searchsorted(-size, -np.arange(longest + 1), "right")  # chains of at least t lines
    top = np.maximum(score, 0.0)
    node = np.stack([np.exp(-top), np.exp(score - top)], axis=1)
    shift = pairs.max() if pairs.size else 0.0
    step = np.exp(pairs - shift)
    alpha, beta, norm = np.empty((n, 2)), np.ones((n, 2)), np.empty(n)
    for t in range(longest):
        at = beg[: live[t + 1]] + t
        a = node[at] if t == 0 else (alpha[at - 1] @ step) * node[at]
        z = a.sum(axis=1)
        alpha[at], norm[at] = a / z[:, None], z
    both = np.zeros((2, 2))
    for t in range(longest - 2, -1, -1):
        at = beg[: live[t + 2]] + t
        nb = node[at + 1] * beta[at + 1] / norm[at + 1][:, None]
        both += step * (alpha[at].T @ nb)
        beta[at] = nb @ step.T
    p = alpha * beta
    logz = np.zeros(len(beg))
    logz[order] = np.add.reduceat((np.log(norm) + top), beg[np.argsort(beg)])[np.argsort(np.argsort(beg))] + shift * (size - 1) if n else 0.0
    return p[:, 1] / p.sum(axis=1), both, logz


def _marginals_apart(score: np.ndarray, doc: np.ndarray, pairs: np.ndarray, beg: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``marginals`` where some chains are long: these by themselves, line by line, the others together."""
    p, both, logz = np.empty(len(score)), np.zeros((2, 2)), np.empty(len(beg))
    long = size > LONG_CHAIN
    rest = np.repeat(~long, size)
    if rest.any():
        p[rest], both, logz[~long] = marginals(score[rest], doc[rest], pairs)
    (s00, s01), (s10, s11) = np.exp(pairs - pairs.max()).tolist()
    for k in np.flatnonzero(long).tolist():
        b, n = int(beg[k]), int(size[k])
        sc = score[b : b + n]
        top = np.maximum(sc, 0.0)
        n0, n1 = np.exp(-top).tolist(), np.exp(sc - top).tolist()
        a0, a1, norm = [0.0] * n, [0.0] * n, [0.0] * n
        x, y = n0[0], n1[0]
        for t in range(n):
            if t:
                x, y = (x * s00 + y * s10) * n0[t], (x * s01 + y * s11) * n1[t]
            z = x + y
            x, y = x / z, y / z
            a0[t], a1[t], norm[t] = x, y, z
        q0 = q1 = 1.0
        pair = [0.0] * 4
        p[b + n - 1] = a1[-1]
        for t in range(n - 2, -1, -1):
            z = norm[t + 1]
            m0, m1 = n0[t + 1] * q0 / z, n1[t + 1] * q1 / z
            x, y = a0[t], a1[t]
            pair[0] += x * m0 * s00
            pair[1] += x * m1 * s01
            pair[2] += y * m0 * s10
            pair[3] += y * m1 * s11
            q0, q1 = s00 * m0 + s01 * m1, s10 * m0 + s11 * m1
            x, y = x * q0, y * q1
            p[b + t] = y / (x + y)
        both = both + np.array(pair).reshape(2, 2)
        logz[k] = float(np.log(norm).sum() + top.sum()) + pairs.max() * (n - 1)
    return p, both, logz


def fit(ls: Lines, good: np.ndarray, steps: int = STEPS, sweeps: int = 150, ridge: float = 1e-3) -> Model:
    """Maximum conditional likelihood (chains weigh alike per line), by Adam with all lines in each sweep."""
    grid = np.linspace(0, 1, steps + 2)[1:-1]
    cuts = np.quantile(ls.x, grid, axis=0).T.astype(np.float32) if len(ls.x) else np.zeros((len(NAMES), steps), np.float32)
    # natural steps of shares that are mostly none
    cuts = np.concatenate([cuts, np.tile(np.float32([0, 0.1, 0.5]), (len(cuts), 1))], axis=1)
    f = indicators(ls, cuts)
    w, pairs = np.zeros(f.shape[1]), np.zeros((2, 2))
    if not len(f):
        return Model(cuts, w, pairs)
    y = good.astype(np.int64)
    inside = ls.doc[1:] == ls.doc[:-1]
    seen = np.zeros((2, 2))
    np.add.at(seen, (y[:-1][inside], y[1:][inside]), 1.0)
    n = len(y)
    m1, m2 = np.zeros(len(w) + 4), np.zeros(len(w) + 4)
    for i in range(1, sweeps + 1):
        p, both, _ = marginals((f @ w.astype(np.float32)).astype(np.float64), ls.doc, pairs)
        # lines of a document share one label in training; the pair weights are shrunk so that they stay a smoother
        g = np.concatenate([(y - p).astype(np.float32) @ f / n - ridge * w, ((seen - both) / n - 0.05 * pairs).ravel()])
        m1 = 0.9 * m1 + 0.1 * g
        m2 = 0.99 * m2 + 0.01 * g * g
        d = 0.1 * (m1 / (1 - 0.9**i)) / (np.sqrt(m2 / (1 - 0.99**i)) + 1e-8)
        w, pairs = w + d[:-4], pairs + d[-4:].reshape(2, 2)
    return Model(cuts, w, pairs)


def _sample_lines(most: int):
    """Measures of the drawn documents' lines, as packed rows, of as many documents (in order, one at least) as have ``most`` lines; -1 where the rest was left."""

    def run(batches):
        held = 0
        for b in batches:
            for text, good in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                ls = lines([text])
                if held and held + len(ls.doc) > most:
                    yield pa.RecordBatch.from_arrays([pa.array([-1], pa.int32()), pa.array([b""], pa.binary())], names=["good", "x"])
                    return
                held += len(ls.doc)
                yield pa.RecordBatch.from_arrays([pa.array([good], pa.int32()), pa.array([ls.x.tobytes()], pa.binary())], names=["good", "x"])

    return run


def train(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", label: str = "quality", sample_docs: int = SAMPLE_DOCS, sample_lines: int = SAMPLE_LINES) -> Model:
    """Fit on the first ``sample_docs`` labelled documents, ``sample_lines`` lines at most, in the order of a hash of the key.

    Labels without a document don't count: if too many of the drawn ones have
    none, more are drawn.
    """
    attach(docs.sparkSession)
    rank = F.xxhash64(F.lit("crf"), F.col("k"))
    named = labels.select(labels[key].alias("k"), labels[label].cast("int").alias("good")).where("k is not null and good is not null").withColumn("rank", rank)
    body = docs.select(docs[key].alias("k"), docs[text].alias("t")).where(F.col("t").isNotNull())
    take = 4 * sample_docs
    while True:
        drawn = named.orderBy("rank", "k", "good").limit(take)
        # twelve thousand numbers are broadcast; larger draws are joined as they come
        hit = body.join(F.broadcast(drawn) if take == 4 * sample_docs else drawn, "k").select("k", "t", "good", "rank")
        got = hit.orderBy("rank", "k", "good", "t").limit(sample_docs)
        rows = got.select("t", "good").mapInArrow(K.tidy(_sample_lines(sample_lines)), "good int, x binary").collect()
        full = len(rows) >= sample_docs or any(r["good"] == -1 for r in rows)
        if full or drawn.count() < take:
            break
        take *= 8
    rows = [r for r in rows if r["good"] != -1]
    parts = [np.frombuffer(r["x"], np.float32).reshape(-1, len(NAMES)) for r in rows]
    size = [len(p) for p in parts]
    doc = np.repeat(np.arange(len(parts)), size)
    x = np.concatenate([np.zeros((0, len(NAMES)), np.float32), *parts])
    return fit(Lines(doc, np.ones(len(x), np.int64), np.zeros(len(x), np.int64), x), np.repeat([r["good"] for r in rows], size))


def label_texts(texts: list[str], model: Model) -> tuple[np.ndarray, np.ndarray, list[list[int]]]:
    """Quality of each text, its number of non-blank lines, and the numbers of its bad lines."""
    quality, count = np.zeros(len(texts)), np.zeros(len(texts), np.int64)
    bad: list[list[int]] = [[] for _ in texts]
    for lo, hi in K.rechunk(texts, STEP_CHARS):
        ls = lines(texts[lo:hi])
        if not len(ls.doc):
            continue
        p, _, _ = marginals(model.scores(ls), ls.doc, model.pairs)
        k = hi - lo
        weight = np.bincount(ls.doc, weights=ls.length, minlength=k)
        quality[lo:hi] = np.bincount(ls.doc, weights=p * ls.length, minlength=k) / np.maximum(weight, 1)
        count[lo:hi] = np.bincount(ls.doc, minlength=k)
        for d, i in zip(ls.doc[p < 0.5].tolist(), ls.number[p < 0.5].tolist()):
            bad[lo + d].append(i)
    return quality, count, bad


def _score(text_at: int, keep_at: list[int], model: Model, schema: pa.Schema, least: float, rows: bool):
    def run(batches):
        for b in batches:
            texts = b.column(text_at).to_pylist()
            null = np.array([t is None for t in texts], bool)
            q, n, bad = label_texts([t or "" for t in texts], model)
            kept = ~null & (n > 0) & (q >= least)
            if not rows:
                yield b.filter(pa.array(kept))
                continue
            cols = [pa.array(n, pa.int64(), mask=null), pa.array(bad, pa.list_(pa.int32()), mask=null), pa.array(q, pa.float64(), mask=null), pa.array(kept)]
            yield pa.RecordBatch.from_arrays([*[b.column(i) for i in keep_at], *cols], schema=schema)

    return run


def quality(docs: DataFrame, model: Model, text: str = "text", keep: tuple[str, ...] = ("doc_id",), least: float = 0.5) -> DataFrame:
    """``keep`` columns plus ``n_lines, bad_lines ARRAY<INT>, quality, kept``."""
    attach(docs.sparkSession)
    names = ("n_lines", "bad_lines", "quality", "kept")
    if set(names) & set(keep):
        raise ValueError(f"keep columns may not be named {', '.join(names)}")
    src = docs.select(*[docs[c].alias(f"c{i}") for i, c in enumerate(keep)], docs[text].alias("text"))
    kinds = (T.LongType(), T.ArrayType(T.IntegerType()), T.DoubleType(), T.BooleanType())
    out = T.StructType([*[T.StructField(c, docs.schema[c].dataType) for c in keep], *[T.StructField(n, k) for n, k in zip(names, kinds)]])
    return src.mapInArrow(K.tidy(_score(len(keep), list(range(len(keep))), model, _arrow_schema(out), least, True)), out)


def filter_quality(docs: DataFrame, model: Model, text: str = "text", least: float = 0.5) -> DataFrame:
    """The documents of at least this quality, with all their columns."""
    attach(docs.sparkSession)
    return docs.mapInArrow(K.tidy(_score(docs.columns.index(text), [], model, _arrow_schema(docs.schema), least, False)), docs.schema)

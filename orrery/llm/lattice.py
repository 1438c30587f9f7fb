"""Subword lattice likelihood: the probability of a text over all its segmentations.

The vocabulary is that of a public piece model; its unigram scores are relative
piece frequencies over the whole corpus, gathered by a word count (every
distinct word once, weighted) and the model's own segmentation. A text then
factorises at its word starts, since no piece crosses one, and a log-space
forward recursion over each distinct word of a block sums the probability of
every segmentation; a document's log-probability is the sum over its words.

Definition: white space becomes the word mark; one mark precedes the text. A
word is a run of marks and the signs up to the next mark. Edges of the lattice
are the vocabulary's pieces, and for a sign that is no piece itself its UTF-8
bytes as byte pieces. Scores are log((count + 1) / (total + pieces)).

Rows, defined results: null text -> null; empty text -> log-probability 0 and
no words; repeated rows count and give a row each; an empty corpus gives
uniform scores; words of any length are worked whole, long ones alone and sign
by sign; only ``keep`` columns are carried, and none may be named like a result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orrery.llm import textkit as K
from orrery.llm import vocab
from orrery.llm.bpe import _arrow_schema
from orrery.runtime import attach

MARK = 0x2581
STEP_CHARS = 500_000
#: Numbers of the forward table of words worked together (words x signs of the longest), and signs of a word that is worked alone.
BLOCK_CELLS = 2_000_000
LONG_WORD = 1_000
WINDOW = 50_000
_NEG = -1e30


@lru_cache(maxsize=4)
def pieces(path: str) -> tuple[list[str], np.ndarray]:
    """Texts of the normal pieces by id ('' for others), and ids of the 256 byte pieces."""
    sp = vocab.piece_model(path)
    out, by = [], np.full(256, -1, np.int64)
    for i in range(sp.get_piece_size()):
        p = sp.id_to_piece(i)
        if sp.is_byte(i):
            by[int(p[3:5], 16)] = i
            out.append("")
        else:
            out.append("" if sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i) else p)
    return out, by


class Trie:
    """Pieces as a trie in arrays: sorted (node, sign) keys -> child; piece id at each node or -1."""

    def __init__(self, texts: list[str]):
        nodes: dict[tuple[int, int], int] = {}
        at = [-1]
        for i, p in enumerate(texts):
            if not p:
                continue
            n = 0
            for c in p:
                key = (n, ord(c))
                n2 = nodes.get(key)
                if n2 is None:
                    n2 = nodes[key] = len(at)
                    at.append(-1)
                n = n2
            at[n] = i
        signs = sorted({c for _, c in nodes})
        self.code = np.zeros(0x110000, np.int32)  # 0: in no piece
        self.code[signs] = np.arange(1, len(signs) + 1)
        self.width = len(signs) + 1
        keys = np.array([n * self.width + int(self.code[c]) for n, c in nodes], np.int64)
        child = np.fromiter(nodes.values(), np.int64, len(nodes))
        self.piece = np.array(at, np.int64)
        self.depth = max((len(p) for p in texts), default=0)
        # open addressing: a power-of-two table, linear probing resolved at build time
        bits = max(4, int(len(keys) * 4).bit_length())
        self.mask = (1 << bits) - 1
        self.keys = np.full(self.mask + 1, -1, np.int64)
        self.child = np.zeros(self.mask + 1, np.int64)
        self.reach = 1
        slot = self._slot(keys)
        for k, c, s in zip(keys.tolist(), child.tolist(), slot.tolist()):
            d = 1
            while self.keys[s] != -1:
                s = (s + 1) & self.mask
                d += 1
            self.keys[s], self.child[s] = k, c
            self.reach = max(self.reach, d)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(20)).astype(np.int64) & self.mask

    def step(self, node: np.ndarray, code: np.ndarray) -> np.ndarray:
        """Children (0: none)."""
        key = node * self.width + code
        s = self._slot(key)
        k = self.keys[s]
        out = np.where(k == key, self.child[s], 0)
        todo = np.flatnonzero((k != key) & (k != -1))
        for _ in range(self.reach):
            if not len(todo):
                break
            s2 = s[todo] = (s[todo] + 1) & self.mask
            k2 = self.keys[s2]
            hit = k2 == key[todo]
            out[todo[hit]] = self.child[s2[hit]]
            todo = todo[~hit & (k2 != -1)]
        return out


@lru_cache(maxsize=4)
def trie(path: str) -> Trie:
    return Trie(pieces(path)[0])


def segments(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Signs with marks, word begins and ends, and the document of each word."""
    cp, starts = K.codepoints(["▁" + t if t else "" for t in texts])
    cp = np.where(K.class_table()[cp] == K.SPACE, np.uint32(MARK), cp)
    first = K.doc_flags(len(cp), starts)[: len(cp)]
    mark = cp == MARK
    beg = first.copy()
    beg[1:] |= mark[1:] & ~mark[:-1]
    b = np.flatnonzero(beg)
    return cp, b, np.append(b[1:], len(cp)), np.searchsorted(starts, b, "right") - 1


def distinct(cp: np.ndarray, b: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A representative of each distinct word, and the number of each word."""
    _, at, inv = np.unique(K.span_hashes(cp, b, e), return_index=True, return_inverse=True)
    return at, inv


def forward(cp: np.ndarray, b: np.ndarray, e: np.ndarray, t: Trie, scores: np.ndarray, byte_ids: np.ndarray) -> np.ndarray:
    """log of the summed probability of all segmentations of each word cp[b:e].

    Words advance together: ``alpha`` has a row per sign position, words are
    sorted by length, and edges that end at the same offset are added per word.
    """
    size = e - b
    out = np.zeros(len(b))
    order = np.argsort(-size, kind="stable")
    lo = int((size > LONG_WORD).sum())
    for w in order[:lo].tolist():
        out[w] = forward_alone(cp[b[w] : e[w]], t, scores, byte_ids)
    while lo < len(order):
        ws = order[lo : lo + max(1, BLOCK_CELLS // (int(size[order[lo]]) + 1))]
        lo += len(ws)
        n, bb = size[ws], b[ws]
        longest = int(n[0])
        live = np.searchsorted(-n, -np.arange(longest + 1), "right")  # words of at least j signs
        alpha = np.full((longest + 1, len(ws)), _NEG)
        alpha[0] = 0.0
        # alpha[j] is final when the loop reaches j: edges only go forward
        for j in range(longest):
            k = int(live[j + 1])
            idx = np.arange(k)
            node = np.zeros(k, np.int64)
            start = alpha[j, :k]
            one = np.zeros(k, bool)
            for l in range(1, t.depth + 1):
                if l > 1:
                    cut = int(live[j + l]) if j + l <= longest else 0
                    keep = idx < cut
                    idx, node = idx[keep], node[keep]
                    if not len(idx):
                        break
                node = t.step(node, t.code[cp[bb[idx] + j + l - 1]])
                go = node > 0
                idx, node = idx[go], node[go]
                if not len(idx):
                    break
                p = t.piece[node]
                has = p >= 0
                w = idx[has]
                if l == 1:
                    one[w] = True
                alpha[j + l, w] = np.logaddexp(alpha[j + l, w], start[w] + scores[p[has]])
            rest = np.flatnonzero(~one)
            if len(rest):
                c = cp[bb[rest] + j]
                u, inv = np.unique(c, return_inverse=True)
                cost = np.array([scores[byte_ids[list(chr(x).encode("utf-8", "surrogatepass"))]].sum() for x in u.tolist()])
                alpha[j + 1, rest] = np.logaddexp(alpha[j + 1, rest], start[rest] + cost[inv])
        out[ws] = alpha[n, np.arange(len(ws))]
    return out


def edges(cp: np.ndarray, lo: int, hi: int, t: Trie) -> Iterator[tuple[np.ndarray, int, np.ndarray]]:
    """(begin, signs, piece) of the pieces that begin at lo..hi-1, shortest first."""
    at, node = np.arange(lo, hi), np.zeros(hi - lo, np.int64)
    for l in range(1, t.depth + 1):
        inside = at + l <= len(cp)
        at, node = at[inside], t.step(node[inside], t.code[cp[at[inside] + l - 1]])
        at, node = at[node > 0], node[node > 0]
        has = t.piece[node] >= 0
        yield at[has], l, t.piece[node[has]]


def forward_alone(cp: np.ndarray, t: Trie, scores: np.ndarray, byte_ids: np.ndarray) -> float:
    """``forward`` of one word of any length: its edges a window at a time, and a ring of the last log sums."""
    ring = [_NEG] * (t.depth + 1)
    width, ring[0] = len(ring), 0.0
    for lo in range(0, len(cp), WINDOW):
        hi = min(len(cp), lo + WINDOW)
        found = list(edges(cp, lo, hi, t))
        spelt = np.ones(hi - lo, bool)
        if found:
            spelt[found[0][0] - lo] = False
        rest = np.flatnonzero(spelt) + lo
        u, inv = np.unique(cp[rest], return_inverse=True)
        cost = np.array([scores[byte_ids[list(chr(x).encode("utf-8", "surrogatepass"))]].sum() for x in u.tolist()])[inv] if len(u) else np.zeros(0)
        begin = np.concatenate([a for a, _, _ in found] + [rest])
        length = np.concatenate([np.full(len(a), l) for a, l, _ in found] + [np.ones(len(rest), np.int64)])
        score = np.concatenate([scores[p] for _, _, p in found] + [cost])
        o = np.argsort(begin, kind="stable")
        now, base = lo, ring[lo % width]
        for i, l, s in zip(begin[o].tolist(), length[o].tolist(), score[o].tolist()):
            if i != now:  # sums of a sign are complete when its edges come up
                ring[now % width] = _NEG
                now, base = i, ring[i % width]
            x, y = ring[(i + l) % width], base + s
            ring[(i + l) % width] = max(x, y) + math.log1p(math.exp(-abs(x - y)))
        ring[now % width] = _NEG
    return ring[len(cp) % width]


def _word_counts(batches):
    """Distinct words with counts, per million words or 20 million signs (the shuffle adds them up)."""
    counts: dict[str, int] = {}
    held = 0

    def flush():
        names = list(counts)
        for lo, hi in K.rechunk(names, STEP_CHARS):
            part = names[lo:hi]
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.string()), pa.array([counts[w] for w in part], pa.int64())], names=["word", "n"])

    for b in batches:
        texts = K.texts_of(b.column(0))
        for lo, hi in K.rechunk(texts, STEP_CHARS):
            cp, beg, end, _ = segments(texts[lo:hi])
            if not len(beg):
                continue
            at, inv = distinct(cp, beg, end)
            n = np.bincount(inv, minlength=len(at))
            full = cp.tobytes().decode("utf-32-le", "surrogatepass")
            for s, e, k in zip(beg[at].tolist(), end[at].tolist(), n.tolist()):
                w = full[s:e]
                had = counts.get(w)
                if had is None:
                    held += e - s
                counts[w] = (had or 0) + k
            if len(counts) > 1_000_000 or held > 20_000_000:
                yield from flush()
                counts.clear()
                held = 0
    yield from flush()


def _piece_counts(path: str):
    def run(batches):
        sp = vocab.piece_model(path)
        total = np.zeros(sp.get_piece_size(), np.int64)
        for b in batches:
            words, n = b.column(0).to_pylist(), b.column(1).to_numpy()
            # the model adds the first mark itself
            ids = sp.encode([w[1:] if w and ord(w[0]) == MARK else w for w in words], num_threads=1)
            flat = np.fromiter((i for x in ids for i in x), np.int64)
            np.add.at(total, flat, np.repeat(n, [len(x) for x in ids]))
        hit = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(hit, pa.int64()), pa.array(total[hit], pa.int64())], names=["piece", "n"])

    return run


def word_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """``word STRING, n BIGINT`` over all documents."""
    attach(docs.sparkSession)
    part = docs.select(docs[text].alias("__text")).mapInArrow(K.tidy(_word_counts), "word string, n long")
    return part.groupBy("word").agg(F.sum("n").alias("n"))


def piece_counts(docs: DataFrame, text: str = "text", vocabulary: str | None = None) -> DataFrame:
    """``piece BIGINT, n BIGINT``: how often the model's own segmentation uses each piece."""
    path = vocab.locate(vocabulary, vocab.PIECES)
    return word_counts(docs, text).mapInArrow(K.tidy(_piece_counts(path)), "piece long, n long").groupBy("piece").agg(F.sum("n").alias("n"))


def unigram_scores(docs: DataFrame, text: str = "text", vocabulary: str | None = None) -> np.ndarray:
    """Log scores by piece id; at most one number per vocabulary piece reaches the driver."""
    path = vocab.locate(vocabulary, vocab.PIECES)
    n = np.zeros(len(pieces(path)[0]), np.float64)
    for r in piece_counts(docs, text, vocabulary).collect():
        n[r["piece"]] = r["n"]
    return np.log((n + 1) / (n.sum() + len(n)))


def _score(text_at: int, keep_at: list[int], path: str, scores: np.ndarray, schema: pa.Schema):
    def run(batches):
        t, by = trie(path), pieces(path)[1]
        for b in batches:
            texts = b.column(text_at).to_pylist()
            logp, n_words = np.zeros(len(texts)), np.zeros(len(texts), np.int64)
            for lo, hi in K.rechunk([x or "" for x in texts], STEP_CHARS):
                cp, beg, end, doc = segments([x or "" for x in texts[lo:hi]])
                if not len(beg):
                    continue
                at, inv = distinct(cp, beg, end)
                word = forward(cp, beg[at], end[at], t, scores, by)
                logp[lo:hi] += np.bincount(doc, weights=word[inv], minlength=hi - lo)
                n_words[lo:hi] += np.bincount(doc, minlength=hi - lo)
            null = np.array([x is None for x in texts], bool)
            yield pa.RecordBatch.from_arrays([*[b.column(i) for i in keep_at], pa.array(n_words, pa.int64(), mask=null), pa.array(logp, pa.float64(), mask=null)], schema=schema)

    return run


def lattice_scores(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), vocabulary: str | None = None, scores: np.ndarray | None = None) -> DataFrame:
    """``keep`` columns plus ``n_words`` and ``log_prob``; ``scores`` default to those of the corpus itself."""
    attach(docs.sparkSession)
    if {"n_words", "log_prob"} & set(keep):
        raise ValueError("keep columns may not be named n_words or log_prob")
    path = vocab.locate(vocabulary, vocab.PIECES)
    if scores is None:
        scores = unigram_scores(docs, text, vocabulary)
    src = docs.select(*[docs[c].alias(f"c{i}") for i, c in enumerate(keep)], docs[text].alias("text"))
    out = T.StructType([*[T.StructField(c, docs.schema[c].dataType) for c in keep], T.StructField("n_words", T.LongType()), T.StructField("log_prob", T.DoubleType())])
    return src.mapInArrow(K.tidy(_score(len(keep), list(range(len(keep))), path, scores, _arrow_schema(out))), out)

"""Order MinHash fingerprints: signatures sensitive to edit distance.

A text is its sequence of k-mers of characters, each numbered by how often it
occurred before, so repeats stay distinct. Each of ``m`` hash functions picks
the ``l`` smallest numbered k-mers; they are put back into text order and the
hash of that tuple is one entry of the signature. Two texts agree in an entry
when the picked k-mers are the same *in the same order*, which follows edit
distance rather than set overlap. No shuffle; the work is linear in the text.

Rows, defined results: null text -> null signature; a text shorter than ``k``
is one k-mer; with fewer than ``l`` k-mers all are used (the empty text has the
empty tuple); ties of hash values go to the earlier position; repeated rows ->
one row each; empty table -> empty result; only ``keep`` columns are carried.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from orrery.llm import textkit as K
from orrery.llm.bpe import _arrow_schema
from orrery.runtime import attach

_U = np.uint64
STEP_CHARS = 400_000


def seeds(m: int, seed: int) -> np.ndarray:
    return K.mix(np.arange(1, m + 1, dtype=np.uint64) * _U(0x9E3779B97F4A7C15) + _U(seed))


def kmers(cp: np.ndarray, k: int) -> np.ndarray:
    """A hash of each k-mer of signs (those across documents are not used)."""
    n = max(0, len(cp) - k + 1)
    v = K.mix(cp.astype(np.uint64) + _U(0x632BE59BD9B4E019))
    h = np.zeros(n, np.uint64)
    for j in range(k):
        h *= _U(0x9E3779B97F4A7C15)
        h += v[j : j + n]
    h ^= h >> _U(29)
    return h


def numbered(h: np.ndarray) -> np.ndarray:
    """Hashes of (k-mer, occurrence number) in text order."""
    n = len(h)
    low = _U((1 << max(1, n.bit_length())) - 1)
    at = np.arange(n, dtype=np.uint64)
    # one plain sort of (leading bits, position) instead of a stable argsort
    key = np.sort((h & ~low) | at)
    order = (key & low).astype(np.int64)
    x = h[order]
    same = x[1:] == x[:-1]
    if not np.array_equal(same, (key[1:] & ~low) == (key[:-1] & ~low)):  # leading bits collide
        order = np.argsort(h, kind="stable")
        x = h[order]
        same = x[1:] == x[:-1]
    again = np.flatnonzero(same) + 1
    if len(again):
        beg = np.flatnonzero(np.concatenate([[True], ~same]))
        occ = again - beg[np.searchsorted(beg, again, "right") - 1]
        h = h.copy()
        h[order[again]] += occ.astype(np.uint64) * _U(0xC2B2AE3D27D4EB4F)
    return K.mix(h)


def smallest(y: np.ndarray, l: int) -> np.ndarray:
    """Per row of ``y`` the positions, ascending, of its l smallest values (ties: the earlier)."""
    rows, n = y.shape
    if n <= l:
        return np.tile(np.arange(n), (rows, 1))
    if n > 16 * l:  # look only at values under a bound that about 8l of a row fall under
        r, c = np.divmod(np.flatnonzero(y.ravel() <= np.uint32(min((1 << 32) - 1, (8 * l << 32) // n))), n)
        have = np.bincount(r, minlength=rows)
        if (have < l).any():
            r, c = np.divmod(np.arange(rows * n), n)
            have = np.full(rows, n)
    else:
        r, c = np.divmod(np.arange(rows * n), n)
        have = np.full(rows, n)
    o = np.lexsort((c, y[r, c], r))
    first = np.cumsum(have) - have
    return np.sort(c[o[first[:, None] + np.arange(l)]], axis=1)


def fold(h: np.ndarray) -> np.ndarray:
    """Hash of each row, a sequence of hashes."""
    a = np.full(len(h), 0x2545F4914F6CDD1D, np.uint64)
    for j in range(h.shape[1]):
        a = (a ^ h[:, j]) * _U(0x9E3779B97F4A7C15) + (a >> _U(29))
    return a


def signature(h: np.ndarray, muls: np.ndarray, l: int) -> np.ndarray:
    """Entries of one text from its k-mer hashes ``h``."""
    x = (numbered(h) >> _U(32)).astype(np.uint32)  # 32 bits order the k-mers of a text; native multiplication
    out = np.empty(len(muls), np.uint64)
    step = max(1, 200_000 // max(1, len(x)))
    for lo in range(0, len(muls), step):
        y = x[None, :] ^ (muls[lo : lo + step, None] >> _U(32)).astype(np.uint32)
        y *= np.uint32(0x9E3779B1)
        y ^= y >> np.uint32(15)
        y *= np.uint32(0x85EBCA77)
        out[lo : lo + step] = fold(h[smallest(y, l)])
    return out.view(np.int64)


def _sign(text_at: int, keep_at: list[int], k: int, l: int, m: int, seed: int, schema: pa.Schema):
    def run(batches):
        muls = seeds(m, seed)
        for b in batches:
            texts = b.column(text_at).to_pylist()
            sigs: list = []
            for lo, hi in K.rechunk([t or "" for t in texts], STEP_CHARS):
                body = [t or "" for t in texts[lo:hi]]
                cp, starts = K.codepoints(body)
                h = kmers(cp, k)
                for i, (s, e) in enumerate(zip(starts[:-1].tolist(), starts[1:].tolist())):
                    if texts[lo + i] is None:
                        sigs.append(None)
                    elif e - s >= k:
                        sigs.append(signature(h[s : e - k + 1], muls, l))
                    else:
                        sigs.append(signature(kmers(cp[s:e], max(1, e - s))[: e - s], muls, l))
            yield pa.RecordBatch.from_arrays([*[b.column(i) for i in keep_at], pa.array(sigs, pa.list_(pa.int64()))], schema=schema)

    return run


def order_minhash(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), k: int = 8, l: int = 3, m: int = 16, seed: int = 7, name: str = "signature") -> DataFrame:
    """``keep`` columns plus ``signature ARRAY<BIGINT>`` of ``m`` entries."""
    attach(docs.sparkSession)
    if min(k, l, m) < 1:
        raise ValueError("k, l and m must be positive")
    if name in keep:
        raise ValueError(f"{name} is already a column")
    src = docs.select(*[docs[c].alias(f"c{i}") for i, c in enumerate(keep)], docs[text].alias("text"))
    out = T.StructType([*[T.StructField(c, docs.schema[c].dataType) for c in keep], T.StructField(name, T.ArrayType(T.LongType(), True))])
    return src.mapInArrow(K.tidy(_sign(len(keep), list(range(len(keep))), k, l, m, seed, _arrow_schema(out))), out)

"""Vectorised text kernels over batches of documents.

A batch is one array of code points plus document offsets. Character classes
come from lookup tables, token boundaries from comparisons of neighbours, and
token hashes from prefix sums of a polynomial modulo 2**64, so the cost is a
few nanoseconds a character with no Python work per token.
"""

from __future__ import annotations

import ctypes
import unicodedata
from collections.abc import Callable
from functools import lru_cache

import numpy as np
import pyarrow as pa

OTHER, LETTER, NUMBER, SPACE = 0, 1, 2, 3
_U = np.uint64
_BASE = _U(0x9E3779B97F4A7C15)
_BASE_INV = _U(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
# White_Space property of Unicode
_WS = [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]


@lru_cache(maxsize=1)
def _trim() -> Callable:
    try:
        return ctypes.CDLL(None).malloc_trim
    except (OSError, AttributeError):  # another C library
        return lambda _: 0


def tidy(run: Callable) -> Callable:
    """An Arrow function that hands freed memory back at the end of its task: workers live on and stand beside each other."""

    def tidied(batches):
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            _trim()(0)

    return tidied


@lru_cache(maxsize=1)
def class_table() -> np.ndarray:
    """Code point -> OTHER, LETTER (L*), NUMBER (N*) or SPACE."""
    t = np.zeros(0x110000, np.uint8)
    for cp in range(0x110000):
        c = unicodedata.category(chr(cp))[0]
        if c == "L":
            t[cp] = LETTER
        elif c == "N":
            t[cp] = NUMBER
    t[_WS] = SPACE
    return t


@lru_cache(maxsize=1)
def lower_table() -> np.ndarray:
    """Code point -> simple lower case (unchanged where that is not one character)."""
    t = np.arange(0x110000, dtype=np.uint32)
    for cp in range(0x110000):
        low = chr(cp).lower()
        if len(low) == 1:
            t[cp] = ord(low)
    return t


def mix(x: np.ndarray) -> np.ndarray:
    """64-bit avalanche (splitmix finaliser), element-wise."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def mix_int(x: int) -> int:
    return int(mix(np.array([x & 0xFFFFFFFFFFFFFFFF], np.uint64))[0])


def codepoints(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All texts as one array of code points, and n+1 offsets."""
    lens = np.fromiter(map(len, texts), np.int64, len(texts))
    starts = np.zeros(len(texts) + 1, np.int64)
    np.cumsum(lens, out=starts[1:])
    cp = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    return cp, starts


_POW: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if "p" not in _POW or len(_POW["p"]) < n:
        m = max(n, 1 << 20)
        for k, b in (("p", _BASE), ("i", _BASE_INV)):
            a = np.full(m, b, np.uint64)
            a[0] = 1
            _POW[k] = np.cumprod(a, dtype=np.uint64)
    return _POW["p"][:n], _POW["i"]


def span_hashes(cp: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of cp[b:e] for each span; equal texts hash alike wherever they stand."""
    n = len(cp)
    if not len(begin):
        return np.zeros(0, np.uint64)
    pw, inv = _powers(n + 1)
    v = mix(cp.astype(np.uint64) + _U(0x632BE59BD9B4E019))
    s = np.zeros(n + 1, np.uint64)
    np.cumsum(v * pw[:n], dtype=np.uint64, out=s[1:])
    h = (s[end] - s[begin]) * inv[begin]
    return mix(h + (end - begin).astype(np.uint64) * _U(0xD6E8FEB86659FD93))


def doc_flags(n: int, starts: np.ndarray) -> np.ndarray:
    """True where a (non-empty) document begins; one entry past the end."""
    f = np.zeros(n + 2, bool)
    f[starts] = True
    f[n:] = True
    return f


def pretokens(cp: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Begin offsets of byte-level pre-tokens (they tile the text).

    Same splits as the pattern of the public byte-level vocabularies:
    contractions, then an optional space before letters, numbers or other
    signs, and runs of white space that leave one space to the next token.
    """
    n = len(cp)
    if n == 0:
        return np.zeros(0, np.int64)
    first = doc_flags(n, starts)
    cls = class_table()[cp]
    tok = first[:n].copy()
    tok[1:] |= cls[1:] != cls[:-1]
    sp = cls == SPACE
    last = np.flatnonzero(sp[:-1] & ~sp[1:] & ~first[1:n])  # last white space before a sign
    tok[last] = True
    tok[last[cp[last] == 32] + 1] = False
    q = np.flatnonzero((cp == 39) & tok)
    if len(q):
        pad = np.concatenate([cp, np.zeros(3, np.uint32)])
        a, b = pad[q + 1], pad[q + 2]
        same1 = ~first[np.minimum(q + 1, n + 1)]
        same2 = same1 & ~first[np.minimum(q + 2, n + 1)]
        one = same1 & np.isin(a, [ord(c) for c in "stmd"])
        two = same2 & (((a == ord("r")) & (b == ord("e"))) | ((a == ord("v")) & (b == ord("e"))) | ((a == ord("l")) & (b == ord("l"))))
        for hit, k in ((one & ~two, 2), (two, 3)):
            at = q[hit]
            tok[at + 1] = False
            nxt = at + k
            nxt = nxt[nxt < n]
            # a letter run goes on behind the contraction: it starts a token of its own
            nxt = nxt[cls[nxt] == LETTER]
            tok[nxt] = True
    return np.flatnonzero(tok)


def runs(mask: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begin and end of maximal True runs that don't cross document starts."""
    n = len(mask)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    beg = mask.copy()
    beg[1:] &= ~mask[:-1] | first[1:n]
    fin = mask.copy()
    fin[:-1] &= ~mask[1:] | first[1:n]
    return np.flatnonzero(beg), np.flatnonzero(fin) + 1


def words(cp: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased runs of letters and numbers: document of each, and its hash, in text order."""
    first = doc_flags(len(cp), starts)
    cls = class_table()[cp]
    b, e = runs((cls == LETTER) | (cls == NUMBER), first)
    h = span_hashes(lower_table()[cp], b, e)
    return np.searchsorted(starts, b, "right") - 1, h, b


def groups(sorted_keys: np.ndarray) -> np.ndarray:
    """Begin of each run of equal values in a sorted array."""
    if not len(sorted_keys):
        return np.zeros(0, np.int64)
    return np.concatenate([[0], np.flatnonzero(sorted_keys[1:] != sorted_keys[:-1]) + 1])


def rechunk(texts: list[str], limit: int):
    """Index ranges of consecutive texts of about ``limit`` characters (one at least)."""
    lo, size = 0, 0
    for i, t in enumerate(texts):
        if size and size + len(t) > limit:
            yield lo, i
            lo, size = i, 0
        size += len(t)
    if lo < len(texts):
        yield lo, len(texts)


def texts_of(column) -> list[str]:
    """A batch column as strings, nulls as empty ones."""
    return ["" if x is None else x for x in column.to_pylist()]

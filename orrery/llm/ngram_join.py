"""Exact Jaccard join of documents on word n-gram sets, by prefix tree.

0. *Suspects.* A partner of a document has at least the share ``t`` of its
   n-grams. Documents are dealt to ``GROUPS`` groups; for each n-gram (by a short
   hash, whose collisions only add) the owner of the hash range answers in which
   groups other documents have it. A document of which no group has that many
   n-grams has no partner and ends here; of the others the groups that have are
   kept (``hot``): partners are in each other's. N-grams shared by chance, which
   grow with the corpus, are spread over the groups. Only suspects go on.
1. *Order.* Documents are worked in blocks. A block sends each of its distinct
   n-grams once, with the number of its documents that have it, to the owner of
   the hash range (so an n-gram that half the corpus has costs an entry a block),
   and who has what to its home. Owners add up frequencies over the whole corpus
   and answer the homes. The global order is (frequency, posting): rare n-grams
   first. N-grams that occur in one document of the corpus need no names: they
   lead every set and only their number matters. N-grams that stand in exactly
   the same documents are one weighted token, so a passage or a copied text is a
   few tokens instead of hundreds.
2. *Prefixes.* Sets whose unshared n-grams already fill the prefix can't have a
   partner and end here (nearly all clean documents do). Equal sets are merged to
   one set with the number of its copies. The rest have prefix tokens, of which
   any matching pair shares one.
3. *Tree.* Sets that prefix tokens connect, and that may be partners by their
   groups, sizes and sketches, form a block; blocks beyond a bound
   are cut into chunks of which each two meet (``set_pairs``). A block's sets are
   stored in a trie in global order. A query set enters it at the topmost nodes
   that bear one of its prefix tokens and walks down, carrying the overlap that
   all sets below a node share; a subtree is left where the overlap plus what can
   still be shared (the smaller of both remaining lengths) misses what the
   smallest set below requires.
4. *Links.* Tasks return, for each set, the number of documents it is linked to
   and a spanning forest of the links, never the pairs; both are added up.

The result is exact for 64-bit n-gram hashes; nothing is capped or sampled.

Words are lower-cased runs of letters and numbers. A text of fewer than ``n``
words is one n-gram of all its words.

Result rows ``doc_id, class_id, n_links``: one for every document that has a
link. ``n_links`` is the number of other documents with Jaccard >= t, copies
included; ``class_id`` the smallest id of the documents that links connect.

Rows, defined results: null or wordless texts have no set and match nothing;
rows with a null id are left out; rows with equal ids and equal sets are one
document; different texts under one id are documents of their own for the
links, whose numbers are added to one row; an empty table gives an empty
result; other columns, whatever their names, are neither read nor returned.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orrery.llm import textkit as K
from orrery.llm.bpe import _arrow_schema
from orrery.llm.wire import pack, unpack
from orrery.runtime import attach, cut, forget, release, size_of, spill_table, stable

_U = np.uint64
#: N-grams of a block of documents. A block has a message for each hash range, so ranges are at most a 64th of it.
BLOCK_GRAMS = 700_000
STEP_CHARS = 300_000
#: Bits of the hashes by which documents without a partner are told first, and groups of documents (bits of a mask).
SHORT_BITS = 40
GROUPS = 32
FULL = (1 << GROUPS) - 1
#: Sets of a token up to which each two are compared before they are connected.
PAIRED_SETS = 1_000
#: Buckets of a set's sketch, the weight from which a bucket counts as filled (4 bits each), and pairs of sketches compared at a time.
SKETCH, FILLED = 256, 15
STEP_SKETCHES = 20_000
#: Bytes of input for each hash range (an owner holds one range at a time).
RANGE_BYTES = 3 << 20
#: List entries of a block that one task holds at most, and of those joined at a time.
BLOCK_TOKENS = 400_000
#: Chunks of a block, each of which is copied to all others, before it goes by tokens.
MAX_CHUNKS = 32
#: Cells of the matrix of query tokens, and pairs of query and node, worked at a time.
STEP_CELLS = 1_000_000
#: Edges that one task contracts to the end (16 bytes each).
EDGES_AT_ONCE = 4_000_000


def gram_hashes(texts: list[str], n: int) -> tuple[np.ndarray, np.ndarray]:
    """Document number and hash of every n-gram (repeats included)."""
    cp, starts = K.codepoints(texts)
    doc, h, _ = K.words(cp, starts)
    return grams_of(doc, h, n)


def grams_of(doc: np.ndarray, h: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    if not len(doc):
        return doc, h
    beg = K.groups(doc)
    size = np.diff(np.append(beg, len(doc)))
    short = size < n
    # full n-grams start where n words of the document are left
    left = np.repeat(beg + size, size) - np.arange(len(doc))
    at = np.flatnonzero(left >= n)
    g = np.zeros(len(at), np.uint64)
    for j in range(n):
        g = (g ^ h[at + j]) * _U(0x9E3779B97F4A7C15)
        g ^= g >> _U(32)
    d = doc[at]
    if short.any():
        extra = []
        for b, s in zip(beg[short].tolist(), size[short].tolist()):
            x = np.array([0x51ED270B27B4F3CF + s], np.uint64)
            for v in h[b : b + s]:
                x = (x ^ v) * _U(0x9E3779B97F4A7C15)
                x ^= x >> _U(32)
            extra.append(x[0])
        d = np.concatenate([d, doc[beg[short]]])
        g = np.concatenate([g, np.array(extra, np.uint64)])
    return d, K.mix(g)


def _ipc(batch: pa.RecordBatch) -> bytes:
    out = io.BytesIO()
    with pa.ipc.new_stream(out, batch.schema) as w:
        w.write_batch(batch)
    return out.getvalue()


#: route: hash range (of the block itself in kind 1). kind 0: n-grams to their owner, 1: members, 2: an owner's answer.
_WIRE = "route long, base long, kind int, payload binary"


def _wire(route: list[int], base: list[int], kind: int, payload: list[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(route, pa.int64()), pa.array(base, pa.int64()), pa.array([kind] * len(route), pa.int32()), pa.array(payload, pa.binary())], names=["route", "base", "kind", "payload"])


def _ask(n: int, bits: int, block_grams: int):
    """Documents -> messages of each block to the owners of hash ranges (short hashes, groups of documents) and to its home."""

    def flush(base: int, rows: int, mark: int, doc: list[np.ndarray], gram: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        d, g = np.concatenate(doc), np.concatenate(gram)
        doc.clear()
        gram.clear()
        order = np.argsort(g, kind="stable")
        d, g = d[order], g[order]
        del order
        new = np.ones(len(g), bool)
        new[1:] = (g[1:] != g[:-1]) | (d[1:] != d[:-1])
        d, h = d[new], (g[new] >> _U(64 - SHORT_BITS)).astype(np.int64)
        del g, new
        beg = K.groups(h)
        count = np.diff(np.append(beg, len(h)))
        group = (base + d) % GROUPS
        several = count > 1
        code = np.where(several, GROUPS, group[beg])
        # groups with a document of the block, and those with two or more, of the n-grams that several have
        inside = np.repeat(several, count)
        once = np.bitwise_or.reduceat(np.left_shift(1, group), beg)[several] if len(beg) else beg
        key = np.sort(np.repeat(np.cumsum(several) - 1, count)[inside] * GROUPS + group[inside])
        two = np.unique(key[1:][key[1:] == key[:-1]])
        twice = np.zeros(int(several.sum()), np.int64)
        np.bitwise_or.at(twice, two // GROUPS, np.left_shift(1, two % GROUPS))
        h = h[beg]
        del group, inside, key, beg
        rng = h >> (SHORT_BITS - bits)
        cuts = K.groups(rng)
        at = np.concatenate([[0], np.cumsum(several)])
        route, payload = [], []
        for lo, hi in zip(cuts.tolist(), np.append(cuts[1:], len(h)).tolist()):
            route.append(int(rng[lo]))
            payload.append(pack(np.diff(h[lo:hi], prepend=rng[lo] << (SHORT_BITS - bits)), code[lo:hi], once[at[lo] : at[hi]], twice[at[lo] : at[hi]]))
        yield _wire([int(K.mix_int(base) >> (64 - bits))], [base], 1, [pack(np.array([len(route), rows, mark]), count, d)])
        yield _wire(route, [base] * len(route), 0, payload)

    def run(batches):
        from pyspark import TaskContext

        base = TaskContext.get().partitionId() << 36
        doc: list[np.ndarray] = []
        gram: list[np.ndarray] = []
        rows = held = mark = seen = 0
        for b in batches:
            texts = K.texts_of(b.column(1))
            mark, seen = mark + _mark(texts, seen), seen + len(texts)
            for lo, hi in K.rechunk(texts, STEP_CHARS):
                d, g = gram_hashes(texts[lo:hi], n)
                doc.append(d + rows)
                gram.append(g)
                rows += hi - lo
                held += len(g)
                if held >= block_grams:
                    yield from flush(base, rows, mark, doc, gram)
                    base += rows
                    doc, gram, rows, held, mark = [], [], 0, 0, 0
        if rows:
            doc.append(np.zeros(0, np.int64))
            gram.append(np.zeros(0, np.uint64))
            yield from flush(base, rows, mark, doc, gram)

    return run


def _mark(texts: list[str], at: int) -> int:
    """A sum over rows, of their places in the partition and their lengths."""
    return sum((at + i + 1) * (len(x) + 1) for i, x in enumerate(texts)) & 0xFFFFFFFF


def _tell(batches):
    """Owner of hash ranges (rows sorted by range): the groups in which others have an n-gram."""

    def settle(rng: int, parts: list[tuple]) -> pa.RecordBatch:
        h, once, twice = (np.concatenate([p[i] for p in parts]) for i in (1, 2, 3))
        order = np.argsort(h, kind="stable")
        h, o = h[order], once[order]
        beg = K.groups(h)
        size = np.diff(np.append(beg, len(h)))
        any_, more = o[beg], np.bitwise_or.reduceat(twice[order], beg)
        live, k = np.flatnonzero(size > 1), 1
        while len(live):  # the k-th block of each n-gram
            x = o[beg[live] + k]
            more[live] |= any_[live] & x
            any_[live] |= x
            k += 1
            live = live[(size[live] > k) & (more[live] != FULL)]
        a, b = np.empty(len(h), np.int64), np.empty(len(h), np.int64)
        a[order], b[order] = np.repeat(any_ | more, size), np.repeat(more, size)
        out, lo = [], 0
        for _, hs, own, _, lone in parts:
            k = slice(lo, lo + len(hs))
            # who alone has it in the block is told of the others; else documents differ, and the home takes each from both
            out.append(pack(np.where(lone, (a[k] & ~own) | b[k], a[k]), b[k][~lone]))
            lo += len(hs)
        return _wire([rng] * len(parts), [p[0] for p in parts], 2, out)

    now, parts = None, []
    for batch in batches:
        for i, (rng, base, kind) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist())):
            if kind == 1:
                yield batch.slice(i, 1)
                continue
            if rng != now:
                if parts:
                    yield settle(now, parts)
                now, parts = rng, []
            delta, code, several, twice = unpack(batch.column(3)[i].as_py())
            lone = code < GROUPS
            own, two = np.left_shift(1, np.minimum(code, GROUPS - 1)), np.zeros(len(code), np.int64)
            own[~lone], two[~lone] = several, twice
            parts.append((base, np.cumsum(delta), own, two, lone))
    if parts:
        yield settle(now, parts)


def _hear(t: float):
    """Home of blocks (rows sorted by block, members first): which rows may have a partner, and in which groups."""

    def settle(base: int, members: list, answers: list[list]) -> pa.RecordBatch:
        (asked, rows, mark), count, d = members
        if len(answers) != asked or sum(len(a[0]) for a in answers) != len(count):
            raise ValueError("an n-gram block hasn't got all its answers")
        hot = np.zeros(rows, np.int64)
        if len(d):
            others = np.concatenate([a[0] for a in answers])
            more = others.copy()
            more[count > 1] = np.concatenate([a[1] for a in answers])
            order = np.argsort(d, kind="stable")
            own = np.left_shift(1, (base + d) % GROUPS)
            lone = np.repeat(count == 1, count)
            others, more = np.repeat(others, count), np.repeat(more, count)
            mask = np.where(lone, others, (others & ~own) | more)[order].astype(np.uint32)
            d = d[order]
            beg = K.groups(d)
            least = np.maximum(1, np.ceil(t * np.diff(np.append(beg, len(d))) - 1e-9))
            for j in range(GROUPS):
                enough = np.add.reduceat((mask >> np.uint32(j)) & np.uint32(1), beg, dtype=np.int64) >= least
                hot[d[beg[enough]]] |= 1 << j
        keep = hot > 0
        return pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in ((base, pa.int64()), (int(rows), pa.int64()), (int(mark), pa.int64()), (np.packbits(keep).tobytes(), pa.binary()), (pack(hot[keep]), pa.binary()))], names=["base", "rows", "mark", "keep", "hot"])

    def run(batches):
        now, members, answers = None, None, []
        for b in batches:
            for base, kind, blob in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(3)):
                if base != now:
                    if members:
                        yield settle(now, members, answers)
                    now, members, answers = base, None, []
                got = unpack(blob.as_py())
                if kind == 1:
                    members = got
                else:
                    answers.append(got)
        if members:
            yield settle(now, members, answers)

    return run


def _hot(batches):
    """Blocks' rows as ``sid, hot``."""
    for b in batches:
        for base, rows, keep, hot in zip(*(b.column(i).to_pylist() for i in (0, 1, 3, 4))):
            at = np.flatnonzero(np.unpackbits(np.frombuffer(keep, np.uint8), count=rows))
            for lo in range(0, len(at), 50_000):
                k = slice(lo, lo + 50_000)
                yield pa.RecordBatch.from_arrays([pa.array(base + at[k]), pa.array(unpack(hot)[0][k])], names=["sid", "hot"])


def _blocks(n: int, bits: int, id_type: pa.DataType, block_grams: int, kept):
    """Documents -> messages of each block to the owners of hash ranges and to its home.

    ``kept`` (broadcast): of each partition the number of rows, their mark, and which of them are to be looked at.
    """

    def flush(base: int, ids: list, doc: list[np.ndarray], gram: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        d, g = np.concatenate(doc), np.concatenate(gram)
        doc.clear()
        gram.clear()
        order = np.argsort(g, kind="stable")  # documents stay ascending among equal n-grams
        d, g = d[order], g[order]
        new = np.ones(len(g), bool)
        new[1:] = (g[1:] != g[:-1]) | (d[1:] != d[:-1])
        d, g = d[new], g[new]
        beg = K.groups(g)
        count = np.diff(np.append(beg, len(g)))
        one = count == 1
        several = np.repeat(~one, count)
        mark = np.add.reduceat(K.mix((base + d).astype(np.uint64)), beg)  # a posting is known by the sum of its documents' marks
        g, first = g[beg], d[beg]
        rng = (g >> _U(64 - bits)).astype(np.int64)
        cuts = K.groups(rng)
        route, payload = [], []
        for lo, hi in zip(cuts.tolist(), np.append(cuts[1:], len(g)).tolist()):
            s = one[lo:hi]
            route.append(int(rng[lo]))
            payload.append(pack(np.diff(g[lo:hi], prepend=_U(0)), count[lo:hi], first[lo:hi][s], mark[lo:hi][~s]))
        # who has the n-grams that several of the block's documents have; the others' come back with the answers
        named = _ipc(pa.RecordBatch.from_arrays([pa.array(ids, id_type)], names=["id"]))
        yield _wire([int(K.mix_int(base) >> (64 - bits))], [base], 1, [pack(named, np.array([len(route)]), np.bincount(d, minlength=len(ids)), count[~one], d[several])])
        yield _wire(route, [base] * len(route), 0, payload)

    def run(batches):
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        base = part << 36
        rows, mark, keep = kept.value.get(part, (0, 0, np.zeros(0, bool)))
        ids: list = []
        doc: list[np.ndarray] = []
        gram: list[np.ndarray] = []
        held = seen = found = 0
        for b in batches:
            col, texts = b.column(0).to_pylist(), K.texts_of(b.column(1))
            found, at, seen = found + _mark(texts, seen), seen, seen + len(texts)
            texts = [x if k else "" for x, k in zip(texts, keep[at:seen])]
            for lo, hi in K.rechunk(texts, STEP_CHARS):
                d, g = gram_hashes(texts[lo:hi], n)
                doc.append(d + len(ids))
                gram.append(g)
                ids.extend(col[lo:hi])
                held += len(g)
                if held >= block_grams:
                    yield from flush(base, ids, doc, gram)
                    base += len(ids)
                    ids, doc, gram, held = [], [], [], 0
        if held:
            yield from flush(base, ids, doc, gram)
        if seen != rows or found & 0xFFFFFFFF != mark:
            raise ValueError("the texts' second reading gave other rows than the first")

    return run


def _owners(batches):
    """Owner of hash ranges (rows sorted by range): frequency and posting of the n-grams that two documents or more have."""

    def settle(rng: int, parts: list[tuple]) -> pa.RecordBatch:
        g, count, mark = (np.concatenate([p[i] for p in parts]) for i in (1, 2, 3))
        order = np.argsort(g, kind="stable")
        g = g[order]
        beg = K.groups(g)
        size = np.diff(np.append(beg, len(g)))
        df, post = np.empty(len(g), np.int64), np.empty(len(g), np.uint64)
        df[order] = np.repeat(np.add.reduceat(count[order], beg), size)
        post[order] = np.repeat(np.add.reduceat(mark[order], beg), size)
        out, lo = [], 0
        for _, _, c, _, first in parts:
            hi = lo + len(c)
            one = c == 1
            lone = one & (df[lo:hi] > 1)  # of one document here, and of others elsewhere
            shared = lone | ~one
            names, at, number = np.unique(post[lo:hi][shared], return_index=True, return_inverse=True)
            out.append(pack(names, df[lo:hi][shared][at], number[~one[shared]], number[one[shared]], first[lone[one]]))
            lo = hi
        return _wire([rng] * len(parts), [p[0] for p in parts], 2, out)

    now, parts = None, []
    for b in batches:
        for i, (rng, base, kind) in enumerate(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist())):
            if kind == 1:
                yield b.slice(i, 1)
                continue
            if rng != now:
                if parts:
                    yield settle(now, parts)
                now, parts = rng, []
            delta, count, first, several = unpack(b.column(3)[i].as_py())
            mark = np.empty(len(delta), np.uint64)
            mark[count == 1] = K.mix((base + first).astype(np.uint64))
            mark[count != 1] = several
            parts.append((base, np.cumsum(delta, dtype=np.uint64), count, mark, first))
    if parts:
        yield settle(now, parts)


def _homes(t: float):
    """Home of blocks (rows sorted by block, members first): the token lists of sets that may have a partner."""

    def settle(base: int, members: list, answers: list[list], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
        ids = pa.ipc.open_stream(members[0]).read_next_batch().column(0)
        asked, size, count, d = members[1:]
        if len(answers) != int(asked[0]) or sum(len(a[2]) for a in answers) != len(count):
            raise ValueError("an n-gram block hasn't got all its answers")
        df = [a[1][np.concatenate([a[2], a[3]])] for a in answers]
        post = [a[0][np.concatenate([a[2], a[3]])].view(np.int64) for a in answers]  # signed, as all that follows orders them
        several = [len(a[2]) for a in answers]
        u = np.concatenate([d, *[a[4] for a in answers]])
        df, tok = (np.concatenate([np.repeat(np.concatenate([x[:k] for x, k in zip(v, several)]), count), *[x[k:] for x, k in zip(v, several)]]) for v in (df, post))
        if not len(u):
            return
        o = np.lexsort((tok, df, u))
        u, tok, df = u[o], tok[o], df[o]
        new = np.ones(len(u), bool)
        new[1:] = (u[1:] != u[:-1]) | (tok[1:] != tok[:-1]) | (df[1:] != df[:-1])
        at = np.flatnonzero(new)
        u, tok, df, w = u[at], tok[at], df[at], np.diff(np.append(at, len(u)))
        beg = K.groups(u)
        shared = np.add.reduceat(w, beg)
        row = u[beg]
        n = np.diff(np.append(beg, len(u)))
        least = np.maximum(1, np.ceil(t * size[row] - 1e-9)).astype(np.int64)
        able = shared >= least
        if not able.any():
            return
        inside = np.repeat(able, n)
        tok, df, w, row, shared, n, least = tok[inside], df[inside], w[inside], row[able], shared[able], n[able], least[able]
        rest = np.repeat(shared, n) - (np.cumsum(w) - w - np.repeat(np.cumsum(shared) - shared, n))
        prefix = np.add.reduceat((rest >= np.repeat(least, n)).astype(np.int32), np.cumsum(n) - n)
        ends = np.cumsum(n)
        lo = 0
        while lo < len(row):  # some 200,000 entries a batch
            hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + 200_000, "right")))
            e0, e1 = (int(ends[lo - 1]) if lo else 0), int(ends[hi - 1])
            offs = pa.array(np.concatenate([[0], ends[lo:hi] - e0]), pa.int32())
            lists = [pa.ListArray.from_arrays(offs, pa.array(x)) for x in (df[e0:e1].astype(np.int32), tok[e0:e1], w[e0:e1].astype(np.int32))]
            r = row[lo:hi]
            yield pa.RecordBatch.from_arrays([pa.array(base + r, pa.int64()), ids.take(pa.array(r)), pa.array(size[r], pa.int64()), pa.array(shared[lo:hi], pa.int64()), pa.array(prefix[lo:hi], pa.int32()), *lists], schema=schema)
            lo = hi

    def bind(schema: pa.Schema):
        def run(batches):
            now, members, answers = None, None, []
            for b in batches:
                for base, kind, blob in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(3)):
                    if base != now:
                        if members:
                            yield from settle(now, members, answers, schema)
                        now, members, answers = base, None, []
                    got = unpack(blob.as_py())
                    if kind == 1:
                        members = got
                    else:
                        answers.append(got)
            if members:
                yield from settle(now, members, answers, schema)

        return run

    return bind


def _ragged(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """b, b+1 .. b+s-1 of each pair, one after the other."""
    return np.arange(int(size.sum())) + np.repeat(begin - (np.cumsum(size) - size), size)


def _over(op: np.ufunc, a: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """op over a[b:e] of each (not empty) interval."""
    at = np.stack([begin, end], axis=1).ravel()
    return op.reduceat(np.append(a, a[-1:]), at)[::2]


class Sets:
    """Token lists of one or several blocks, sorted so that a trie can be read off them.

    ``token`` holds ranks in global order inside a block, from 0 on in each
    block; lists of a block stand together, in lexicographic order.
    """

    def __init__(self, block: np.ndarray, token: np.ndarray, weight: np.ndarray, n: np.ndarray, prefix: np.ndarray, size: np.ndarray):
        offs = np.concatenate([[0], np.cumsum(n)])
        lists = [token[s:e].astype(">i8").tobytes() for s, e in zip(offs[:-1].tolist(), offs[1:].tolist())]
        marks = block.astype(">i8")
        self.order = np.array(sorted(range(len(n)), key=lambda i: (marks[i].tobytes(), lists[i])), np.int64)
        self.n, self.prefix, self.size, self.block = n[self.order], prefix[self.order], size[self.order], block[self.order]
        at = _ragged(offs[:-1][self.order], self.n)
        self.token, self.weight = token[at], weight[at]
        self.offs = np.concatenate([[0], np.cumsum(self.n)])
        self.done = np.concatenate([[0], np.cumsum(self.weight)])  # weight before each entry
        self.total = self.done[self.offs[1:]] - self.done[self.offs[:-1]]
        self.width = int(token.max(initial=0)) + 2


class Tree:
    """Prefix tree of sets in global token order, runs of nodes without a fork (16 at most) being one node.

    Sets are numbered in the tree's order, so the sets below a node are an
    interval ``begin:end``; nodes are numbered in preorder, so those below node
    v are v+1 .. ``last[v]``-1.
    """

    RUN = 16

    def __init__(self, s: Sets):
        m = len(s.n)
        # tokens that a set shares with the one before it
        k = np.minimum(s.n[1:], s.n[:-1])
        k[s.block[1:] != s.block[:-1]] = 0
        of = np.repeat(np.arange(m - 1), k)
        inner = _ragged(np.zeros(len(k), np.int64), k)
        differ = s.token[s.offs[of] + inner] != s.token[s.offs[of + 1] + inner]
        same = k.copy()
        hit = np.flatnonzero(differ)
        first = hit[np.unique(of[hit], return_index=True)[1]] if len(hit) else hit
        same[of[first]] = inner[first]
        same = np.concatenate([[0], same])
        fresh = s.n - same
        # single nodes: the fresh tokens of each set, in preorder
        owner = np.repeat(np.arange(m), fresh)
        depth = _ragged(same, fresh)
        made = np.cumsum(fresh) - fresh
        end = np.full(len(owner), m)
        path = np.zeros(int(s.n.max(initial=0)), np.int64)
        above = np.full(len(owner), -1)
        deep = 0
        for i, (keep, full, node) in enumerate(zip(same.tolist(), s.n.tolist(), made.tolist())):
            if deep > keep:
                end[path[keep:deep]] = i
            if full > keep:
                if keep:
                    above[node] = path[keep - 1]
                path[keep:full] = np.arange(node, node + full - keep)
            deep = full
        inside = np.zeros(len(owner), bool)
        inside[1:] = (owner[1:] == owner[:-1]) & (end[1:] == end[:-1])
        head = np.flatnonzero(~inside)
        place = np.arange(len(owner)) - np.repeat(head, np.diff(np.append(head, len(owner))))
        head = np.flatnonzero(place % self.RUN == 0)
        tail = np.append(head[1:], len(owner)) - 1
        number = np.repeat(np.arange(len(head)), tail - head + 1)
        at = s.offs[owner] + depth  # entry of each single node in its set's list
        self.first, self.count = at[head], tail - head + 1
        self.begin, self.end = owner[head], end[head]
        self.until = s.token[at[tail]]
        up = above[head]
        follows = (up < 0) & (head > 0) & (owner[head] == owner[np.maximum(head - 1, 0)])
        parent = np.where(up >= 0, number[np.maximum(up, 0)], np.where(follows, number[np.maximum(head - 1, 0)], -1))
        # what the sets below can still share, and the smallest of them
        passed = s.done[at[tail] + 1] - s.done[s.offs[owner[tail]]]
        self.rest = _over(np.maximum, s.total, self.begin, self.end) - passed
        self.least = _over(np.minimum, s.size, self.begin, self.end)
        # sets that end at a node: the first ones below it
        ends = s.offs[self.begin + 1] == at[tail] + 1
        own = np.concatenate([[0], np.cumsum(fresh > 0)])
        nxt = np.searchsorted(own, own[self.begin + 1] + 1, "left") - 1  # the next set with a node of its own
        self.here = np.where(ends, np.minimum(nxt, self.end) - self.begin, 0)
        order = np.argsort(parent, kind="stable")
        self.children = order
        self.kid = np.searchsorted(parent[order], np.arange(len(head)))
        self.kids = np.searchsorted(parent[order], np.arange(len(head)), "right") - self.kid
        self.last = np.searchsorted(self.begin, self.end, "left")
        # nodes by (block, token)
        key = s.block[owner] * s.width + s.token[at]
        order = np.argsort(key, kind="stable")
        self.keys, self.nodes = key[order], number[order]


def tree_join(s: Sets, t: float, own: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(query, set, overlap) of all pairs with Jaccard >= t, numbers in the order of ``s``, the set before the query.

    ``own``: a token of each set's block; only pairs whose first shared token it is are reported (-1: all).
    """
    tree = Tree(s)
    ratio = t / (1 + t)
    m = len(s.n)
    entry_key = np.repeat(np.arange(m), s.n) * s.width + s.token
    # nodes where each prefix token of a query is borne
    pre = _ragged(s.offs[:-1], s.prefix)
    asker = np.repeat(np.arange(m), s.prefix)
    key = s.block[asker] * s.width + s.token[pre]
    lo = np.searchsorted(tree.keys, key)
    many = np.searchsorted(tree.keys, key, "right") - lo
    starts = np.concatenate([[0], np.cumsum(np.bincount(asker, weights=many, minlength=m))]).astype(np.int64)
    seen = np.concatenate([[0], np.cumsum(s.prefix)])
    peers = np.arange(m) - np.searchsorted(s.block, s.block) + 1  # a query meets the sets before it
    cells = np.concatenate([[0], np.cumsum(np.maximum(peers, s.width))])
    q0 = 0
    while q0 < m:
        q1 = min(m, max(q0 + 1, min(int(np.searchsorted(starts, starts[q0] + STEP_CELLS, "right")), int(np.searchsorted(cells, cells[q0] + STEP_CELLS, "right"))) - 1))
        have = np.zeros((q1 - q0) * s.width, np.int32)  # weight of each token of each query
        e0, e1 = int(s.offs[q0]), int(s.offs[q1])
        have[entry_key[e0:e1] - q0 * s.width] = s.weight[e0:e1]
        p = slice(int(seen[q0]), int(seen[q1]))
        q = np.repeat(asker[p], many[p])
        tok = np.repeat(s.token[pre[p]], many[p])
        v = tree.nodes[_ragged(lo[p], many[p])]
        o = np.flatnonzero(tree.begin[v] < q)
        q, tok, v = q[o], tok[o], v[o]
        # the topmost nodes: none that lies below another one of the query's
        o = np.lexsort((tok, v, q))
        q, tok, v = q[o], tok[o], v[o]
        if len(q):
            reach = np.maximum.accumulate(q * (len(tree.first) + 1) + tree.last[v])
            top = np.ones(len(q), bool)
            top[1:] = (q[1:] * (len(tree.first) + 1) + v[1:] >= reach[:-1])
            if own is not None:
                top &= (own[q] < 0) | (tok == own[q])
            q, v = q[top], v[top]
        over = np.zeros(len(q), np.int64)
        while len(q):
            # overlap with the node's run
            c = tree.count[v]
            at = _ragged(tree.first[v], c)
            w = have[(np.repeat(q, c) - q0) * s.width + s.token[at]]
            over = over + np.add.reduceat(w, np.cumsum(c) - c)
            left = s.done[s.offs[q + 1]] - s.done[np.searchsorted(entry_key, q * s.width + tree.until[v], "right")]
            live = (tree.begin[v] < q) & (over + np.minimum(left, tree.rest[v]) >= ratio * (s.size[q] + tree.least[v]) - 1e-9)
            q, v, over = q[live], v[live], over[live]
            if not len(q):
                break
            here = tree.here[v]
            who = _ragged(tree.begin[v], here)
            by, both = np.repeat(q, here), np.repeat(over, here)
            ok = (who < by) & (both >= ratio * (s.size[by] + s.size[who]) - 1e-9) & (both > 0)
            if ok.any():
                yield by[ok], who[ok], both[ok]
            kids = tree.kids[v]
            q, over, v = np.repeat(q, kids), np.repeat(over, kids), tree.children[_ragged(tree.kid[v], kids)]
        q0 = q1


def forest(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of the edges, and the smallest node that each is connected to."""
    nodes, number = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = number[: len(u)], number[len(u) :]
    label = np.arange(len(nodes))
    while True:
        x, y = label[a], label[b]
        apart = x != y
        if not apart.any():
            return nodes, nodes[label]
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while True:
            up = label[label]
            if np.array_equal(up, label):
                break
            label = up


def _trees(t: float):
    """Blocks as runs of rows ``root, lo, hi, token, chunk, sid, size, copies, prefix, dfs, tokens, weights`` -> ``sid, links, root``."""

    def join(parts: list[pa.RecordBatch], own_tokens: list) -> Iterator[pa.RecordBatch]:
        block = np.repeat(np.arange(len(parts)), [p.num_rows for p in parts])
        rows = pa.Table.from_batches(parts).combine_chunks()
        n = pa.compute.list_value_length(rows["tokens"]).to_numpy().astype(np.int64)
        df, tok, w = (pa.compute.list_flatten(rows[c]).to_numpy() for c in ("dfs", "tokens", "weights"))
        of = np.repeat(block, n)
        order = np.lexsort((tok, df, of))
        x, y, z = of[order], df[order], tok[order]
        new = np.ones(len(order), bool)
        new[1:] = (z[1:] != z[:-1]) | (y[1:] != y[:-1]) | (x[1:] != x[:-1])
        rank = np.empty(len(order), np.int64)
        rank[order] = np.cumsum(new) - 1
        low = np.zeros(len(parts), np.int64)
        low[x[::-1]] = rank[order][::-1]  # the first rank of each block
        rank -= low[of]
        own = None
        if any(k is not None for k in own_tokens):
            own = np.full(len(parts), -1)
            for i, k in enumerate(own_tokens):
                if k is not None:
                    own[i] = rank[np.flatnonzero((tok == k) & (of == i))[0]]
        sid, size, copies, chunk, prefix = (rows[c].to_numpy().astype(np.int64) for c in ("sid", "size", "copies", "chunk", "prefix"))
        cross = (rows["lo"].to_numpy() != rows["hi"].to_numpy())
        s = Sets(block, rank, w.astype(np.int64), n, prefix, size)
        o = s.order
        sid, copies, chunk, cross = sid[o], copies[o], chunk[o], cross[o]
        links = np.zeros(len(sid), np.int64)
        edges: list[tuple[np.ndarray, np.ndarray]] = []
        held = 0
        for a, b, _ in tree_join(s, t, None if own is None else own[s.block]):
            other = ~cross[a] | (chunk[a] != chunk[b])  # pairs inside a chunk are reported by the chunk's own block
            a, b = a[other], b[other]
            np.add.at(links, a, copies[b])
            np.add.at(links, b, copies[a])
            edges.append((a, b))
            held += len(a)
            if held > STEP_CELLS:
                edges = [forest(*(np.concatenate(e) for e in zip(*edges)))]
                held = len(edges[0][0])
        if held:
            node, root = forest(*(np.concatenate(e) for e in zip(*edges)))
            for lo in range(0, len(node), 50_000):
                k = slice(lo, lo + 50_000)
                yield pa.RecordBatch.from_arrays([pa.array(sid[node[k]]), pa.array(links[node[k]]), pa.array(sid[root[k]])], names=["sid", "links", "root"])

    def run(batches):
        now, parts, own, held = None, [], [], 0
        for b in batches:
            keys = list(zip(*(b.column(i).to_pylist() for i in range(4))))
            size = pa.compute.list_value_length(b.column(b.schema.get_field_index("tokens"))).to_numpy(zero_copy_only=False)
            lo = 0
            for i in range(1, len(keys) + 1):
                if i < len(keys) and keys[i] == keys[lo]:
                    continue
                piece = b.slice(lo, i - lo)
                if keys[lo] != now:
                    if held > BLOCK_TOKENS:
                        yield from join(parts, own)
                        parts, own, held = [], [], 0
                    now = keys[lo]
                    parts.append(piece)
                    own.append(now[3])
                else:
                    both = pa.Table.from_batches([parts[-1], piece]).combine_chunks()
                    parts[-1] = both.to_batches()[0]
                held += int(size[lo:i].sum())
                lo = i
        if parts:
            yield from join(parts, own)

    return run


def gram_lists(docs: DataFrame, t: float, text: str = "text", key: str = "doc_id", n: int = 3, block_grams: int = BLOCK_GRAMS) -> tuple[DataFrame, DataFrame]:
    """Texts that may have a partner: ``sid, id, size, shared, prefix, dfs, tokens, weights`` (tokens in global order), and their ``sid, hot``.

    Rows are numbered by scan partition, so a task that runs again and the
    second reading must see the same rows: input that isn't a plain scan is
    written down first, and rows of the second reading are held against the first.
    """
    spark = attach(docs.sparkSession)
    src = stable(docs.where(docs[key].isNotNull()).select(docs[key].alias("id"), docs[text].alias("text")), "texts")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    most = max(8, block_grams // 64)
    bits = max(3, min(most, max(4 * parts, size_of(src) // RANGE_BYTES)).bit_length())
    kind = src.schema["id"].dataType
    id_type = _arrow_schema(T.StructType([src.schema["id"]])).field(0).type
    kinds = {"dfs": T.IntegerType(), "tokens": T.LongType(), "weights": T.IntegerType()}
    out = T.StructType([T.StructField("sid", T.LongType()), T.StructField("id", kind), T.StructField("size", T.LongType()), T.StructField("shared", T.LongType()), T.StructField("prefix", T.IntegerType()), *[T.StructField(c, T.ArrayType(k)) for c, k in kinds.items()]])

    def passed(ask, owners, homes, schema) -> DataFrame:
        """Blocks ask the owners of hash ranges, which answer the blocks' homes."""
        asked = src.mapInArrow(K.tidy(ask), _WIRE).repartitionById(parts, F.pmod("route", F.lit(parts)).cast("int")).sortWithinPartitions("route")
        told = asked.mapInArrow(K.tidy(owners), _WIRE).repartition(parts, "base").sortWithinPartitions("base", "kind", "route")
        return told.mapInArrow(K.tidy(homes), schema)

    able = spill_table(passed(_ask(n, bits, block_grams), _tell, _hear(t), "base long, rows long, mark long, keep binary, hot binary"), "able")
    release(spark)
    kept: dict[int, tuple[int, int, np.ndarray]] = {}
    for r in sorted(able.select("base", "rows", "mark", "keep").collect(), key=lambda r: r["base"]):  # a bit a row
        rows, mark, keep = kept.get(r["base"] >> 36, (0, 0, np.zeros(0, bool)))
        more = np.unpackbits(np.frombuffer(r["keep"], np.uint8), count=r["rows"]).astype(bool)
        kept[r["base"] >> 36] = rows + r["rows"], (mark + r["mark"]) & 0xFFFFFFFF, np.concatenate([keep, more])
    lists = spill_table(passed(_blocks(n, bits, id_type, block_grams, spark.sparkContext.broadcast(kept)), _owners, _homes(t)(_arrow_schema(out)), out), "lists")
    release(spark)
    return lists, able.mapInArrow(K.tidy(_hot), "sid long, hot long")


def _postings(batches):
    """Sets -> a row for each prefix token: ``token, sid, hot, size, rest, sketch, n``.

    ``rest``: what the set has from the token on. ``sketch``: the weight of all its tokens by bucket.
    """
    for b in batches:
        sid, hot, size, prefix = (b.column(i).to_numpy() for i in range(4))
        n = pa.compute.list_value_length(b.column(4)).to_numpy().astype(np.int64)
        token, weight = (pa.compute.list_flatten(b.column(i)).to_numpy() for i in (4, 5))
        weight = weight.astype(np.int64)
        own = np.repeat(np.arange(len(n)), n)
        have = np.bincount(own * SKETCH + (token & (SKETCH - 1)), weights=weight, minlength=len(n) * SKETCH).reshape(len(n), SKETCH)
        have = np.minimum(have, FILLED).astype(np.uint8)
        sketch = pa.array([x.tobytes() for x in have[:, ::2] | have[:, 1::2] << 4], pa.binary())
        upto = np.cumsum(weight)
        done = np.concatenate([[0], upto])[np.cumsum(n)]  # up to the end of each set
        at = _ragged(np.cumsum(n) - n, prefix.astype(np.int64))
        for lo in range(0, len(at), 20_000):
            k = at[lo : lo + 20_000]
            o = own[k]
            cols = [pa.array(x) for x in (token[k], sid[o], hot[o], size[o], done[o] - upto[k] + weight[k])]
            yield pa.RecordBatch.from_arrays([*cols, sketch.take(pa.array(o)), pa.array(n[o])], names=["token", "sid", "hot", "size", "rest", "sketch", "n"])


def _shareable(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The most that sets of these sketches can share."""
    low, high = np.minimum(a & 15, b & 15), np.minimum(a >> 4, b >> 4)
    full = (low == FILLED).any(axis=1) | (high == FILLED).any(axis=1)
    return np.where(full, np.inf, low.sum(axis=1, dtype=np.int64) + high.sum(axis=1, dtype=np.int64))


def _met(batches, t: float = 0.0):
    """Runs of rows ``token, sid, hot[, size, rest, sketch]`` -> edges ``u, v`` that connect all sets of a token that may be partners.

    At the first token that two partners share, both have enough left from it
    on, and their sketches leave room for what they must share. Sets that the
    task has connected already aren't compared again.
    """
    ratio = t / (1 + t)
    known, top = np.zeros(0, np.int64), np.zeros(0, np.int64)  # connected sets, and their smallest ones

    def flush(token, sid, hot, *more) -> None:
        nonlocal known, top
        nodes = np.unique(np.concatenate([known, top, sid]))
        at, root = np.searchsorted(nodes, sid), np.arange(len(nodes))
        root[np.searchsorted(nodes, known)] = np.searchsorted(nodes, top)

        def find(x: np.ndarray) -> np.ndarray:
            x = root[x]
            while not np.array_equal(up := root[x], x):
                x = up
            return x

        def connect(a: np.ndarray, b: np.ndarray) -> None:
            """Rows a and b, which the groups allow, where size and sketch allow it."""
            for lo in range(0, len(a), STEP_SKETCHES):
                i, j = a[lo : lo + STEP_SKETCHES], b[lo : lo + STEP_SKETCHES]
                apart = find(at[i]) != find(at[j])
                i, j = i[apart], j[apart]
                if more:
                    size, rest, sketch = more
                    need = ratio * (size[i] + size[j]) - 1e-9
                    able = np.minimum(rest[i], rest[j]) >= need
                    i, j, need = i[able], j[able], need[able]
                    able = _shareable(sketch[i], sketch[j]) >= need
                    i, j = i[able], j[able]
                if len(i):
                    node, low = forest(find(at[i]), find(at[j]))
                    root[node] = low

        mine = np.left_shift(1, sid % GROUPS)
        beg = K.groups(token)
        count = np.diff(np.append(beg, len(token)))
        two = beg[count == 2]  # the many tokens of two sets at once
        two = two[((hot[two] & mine[two + 1]) != 0) & ((hot[two + 1] & mine[two]) != 0)]
        connect(two, two + 1)
        for lo, k in zip(beg[count > 2].tolist(), count[count > 2].tolist()):
            r = find(at[lo : lo + k])
            if (r == r[0]).all():
                continue
            if k > PAIRED_SETS:
                node, low = forest(r[1:], np.full(k - 1, r[0]))
                root[node] = low
                continue
            h, m = hot[lo : lo + k], mine[lo : lo + k]
            a, b = np.nonzero(np.triu(((h[:, None] & m) != 0) & ((m[:, None] & h) != 0) & (r[:, None] != r), 1))
            connect(lo + a, lo + b)
        root = find(np.arange(len(nodes)))
        moved = np.flatnonzero(root != np.arange(len(nodes)))
        known, top = nodes[moved], nodes[root[moved]]

    def give() -> Iterator[pa.RecordBatch]:
        for lo in range(0, len(known), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(known[lo : lo + 100_000]), pa.array(top[lo : lo + 100_000])], names=["u", "v"])

    rest = None
    for b in batches:
        now = [b.column(i).to_numpy() for i in range(min(5, b.num_columns))]
        if b.num_columns > 5:
            now.append(np.frombuffer(b"".join(b.column(5).to_pylist()), np.uint8).reshape(-1, SKETCH // 2))
        if rest is not None:
            now = [np.concatenate(x) for x in zip(rest, now)]
        if not len(now[0]):
            continue
        last = int(np.flatnonzero(now[0] != now[0][-1])[-1]) + 1 if now[0][0] != now[0][-1] else 0
        if last:
            flush(*(x[:last] for x in now))
        rest = [x[last:] for x in now]
        if len(known) > EDGES_AT_ONCE // 2:
            yield from give()
            known, top = known[:0], top[:0]
    if rest is not None and len(rest[0]):
        flush(*rest)
    yield from give()


def set_pairs(sets: DataFrame, t: float, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """``sid, links, root``: parts of each set's number of linked documents, and edges that span the links.

    ``sets``: ``sid, hot, size, copies, prefix, dfs, tokens, weights``. Sets that
    share a prefix token, each of which is in a group where the other may have a
    partner (``hot``), and that can share enough from that token on by their
    sizes and sketches, form a block, directly or over others, and every set is
    sent to its block once. A block of more than ``block_tokens`` list entries is
    cut into chunks of half that, and each two chunks meet in a block of their
    own. Beyond ``MAX_CHUNKS``, and where that copies less, it is worked token by
    token (each pair at the first token it shares), with the same bound and
    chunks for a token's sets.
    """
    spark = attach(sets.sparkSession)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    edges = spill_table(sets.select("sid", "hot", "size", "prefix", "tokens", "weights").mapInArrow(K.tidy(_postings), "token long, sid long, hot long, size long, rest long, sketch binary, n long"), "prefix")
    # chunks of half a block, so that two of them make one
    chunks = F.when(F.col("held") <= block_tokens, 1).otherwise(F.ceil(2 * F.col("held") / block_tokens)).cast("int")
    hub = edges.groupBy("token").agg(F.count(F.lit(1)).alias("c"), F.sum("n").alias("held")).where("c > 1")
    met = edges.drop("n").repartition(parts, "token").sortWithinPartitions("token")
    blocks = components(met.mapInArrow(K.tidy(lambda batches: _met(batches, t)), "u long, v long"))
    each = edges.groupBy("sid").agg(F.first("n").alias("n"), F.count(F.lit(1)).alias("p"))
    weigh = each.join(blocks, each["sid"] == blocks["id"]).groupBy("root").agg(F.sum("n").alias("held"), F.sum(F.col("n") * F.col("p")).alias("single"))
    placed = blocks.join(weigh, "root").select(F.col("id").alias("sid"), "root", chunks.alias("m"), "held", "single")
    at = sets.join(placed, "sid").withColumn("whole", (F.col("m") <= MAX_CHUNKS) | (F.col("m") * F.col("held") <= F.col("single")))
    body = ["sid", "size", "copies", "prefix", "dfs", "tokens", "weights"]

    def meet(rows: DataFrame, token) -> DataFrame:
        """Each chunk with itself and every other."""
        others = F.transform(F.sequence(F.lit(0), F.col("m") - 1), lambda j: F.struct(F.least("chunk", j).alias("lo"), F.greatest("chunk", j).alias("hi")))
        return rows.withColumn("chunk", F.pmod(F.xxhash64("sid"), F.col("m")).cast("int")).select("root", F.inline(others), token.alias("token"), "chunk", *body)

    whole = meet(at.where("whole"), F.lit(None).cast("long"))
    by_token = at.where("not whole").drop("m").withColumn("token", F.explode(F.slice("tokens", F.lit(1), F.col("prefix"))))
    single = meet(by_token.join(hub.select("token", chunks.alias("m")), "token"), F.col("token"))
    rows = whole.unionByName(single).repartition(parts, "root", "lo", "hi", "token").sortWithinPartitions("root", "lo", "hi", "token")
    out = spill_table(rows.mapInArrow(K.tidy(_trees(t)), "sid long, links long, root long"), "links")
    forget(edges, blocks)
    return out


def ngram_join(docs: DataFrame, t: float = 0.5, text: str = "text", key: str = "doc_id", n: int = 3, block_grams: int = BLOCK_GRAMS) -> DataFrame:
    """``doc_id, class_id, n_links`` of every document with a partner of Jaccard similarity >= ``t`` (see above)."""
    if not 0 < t <= 1:
        raise ValueError("t must be in (0, 1]")
    lists, hot = gram_lists(docs, t, text, key, n, block_grams)
    # equal sets have equal lists; a set with n-grams of its own equals no other
    twin = F.col("shared") == F.col("size")
    mark = [F.when(twin, F.xxhash64(F.lit(i), "size", "dfs", "tokens", "weights")).otherwise(F.col("sid") if i else F.lit(None)).alias(f"k{i}") for i in (0, 1)]
    marked = lists.select("sid", "id", *mark)
    same = F.col("k0").eqNullSafe(F.col("r0")) & (F.col("k1") == F.col("r1"))
    items = spill_table(marked.groupBy("k0", "k1", "id").agg(F.min("sid").alias("sid")), "items")
    reps = spill_table(items.groupBy("k0", "k1").agg(F.min("sid").alias("rep"), F.count(F.lit(1)).alias("copies")), "sets")
    found = reps.select("rep", "copies").join(hot.withColumnRenamed("sid", "of"), F.col("rep") == F.col("of")).select("rep", "copies", "hot")
    sets = lists.join(found, F.col("sid") == F.col("rep")).select("sid", "hot", "size", "copies", "prefix", "dfs", "tokens", "weights")
    links = set_pairs(sets, t)
    reps = reps.select(F.col("k0").alias("r0"), F.col("k1").alias("r1"), "rep", "copies")
    own = items.join(reps, same).select("id", "rep", "copies")
    count = links.groupBy("sid").agg(F.sum("links").alias("links"))
    own = own.join(count, F.col("rep") == F.col("sid"), "left").select("id", "rep", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links")).where("links > 0")
    own = spill_table(own, "own")
    # an id with several texts connects their sets
    several = own.groupBy("id").agg(F.min("rep").alias("u"), F.max("rep").alias("w")).where("u <> w").select("id", "u")
    tied = own.join(several, "id").select("u", F.col("rep").alias("v"))
    linked = links.select(F.col("root").alias("u"), F.col("sid").alias("v")).unionByName(tied).where("u <> v")
    roots = components(linked)
    top = own.join(roots.select(F.col("id").alias("node"), "root"), F.col("rep") == F.col("node"), "left").select("id", "links", F.coalesce("root", "rep").alias("root"))
    least = top.groupBy("root").agg(F.min("id").alias("class_id"))
    return top.join(least, "root").groupBy(F.col("id").alias(key)).agg(F.min("class_id").alias("class_id"), F.sum("links").alias("n_links"))


def _contract(batches):
    """Edges ``u, v`` of a task -> its nodes and the smallest node that each is connected to in it."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    n, bound = 0, EDGES_AT_ONCE
    for b in batches:
        held.append((b.column(0).to_numpy(), b.column(1).to_numpy()))
        n += b.num_rows
        if n > bound:
            held = [forest(*(np.concatenate(x) for x in zip(*held)))]
            n = len(held[0][0])
            bound = max(EDGES_AT_ONCE, 2 * n)
    if n:
        node, root = forest(*(np.concatenate(x) for x in zip(*held)))
        for lo in range(0, len(node), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(node[lo : lo + 100_000]), pa.array(root[lo : lo + 100_000])], names=["id", "root"])


def components(star: DataFrame, at_once: int = EDGES_AT_ONCE) -> DataFrame:
    """``id, root`` of the connected nodes of the edges ``u, v`` (BIGINT); the root is the smallest id.

    Every task first contracts its own edges to a forest. At most ``at_once``
    edges of 16 bytes are then contracted by one task; more take minimum-label
    rounds with pointer jumping, whose number grows with the logarithm of the
    diameter and each of which is written down.
    """
    spanning = spill_table(star.select("u", "v").mapInArrow(K.tidy(_contract), "id long, root long"), "forest")
    edges = spanning.where("id <> root")
    if spanning.count() <= at_once:
        out = spill_table(spanning.coalesce(1).mapInArrow(K.tidy(_contract), "id long, root long"), "roots")
        forget(spanning)
        return out
    both = spill_table(edges.selectExpr("id as u", "root as v").unionByName(edges.selectExpr("root as u", "id as v")).distinct(), "edges")
    forget(spanning)
    label = cut(both.groupBy(F.col("u").alias("id")).agg(F.min("v").alias("m")).select("id", F.least("id", "m").alias("root")))
    while True:
        near = both.join(label, both["v"] == label["id"]).groupBy("u").agg(F.min("root").alias("m"))
        hooked = label.join(near, label["id"] == near["u"]).select("id", F.least("root", "m").alias("root"), F.col("root").alias("old"))
        up = hooked.select(F.col("id").alias("p"), F.col("root").alias("top"))
        step = cut(hooked.join(up, hooked["root"] == up["p"], "left").select("id", F.least("root", F.coalesce("top", "root")).alias("root"), "old"))
        label, moved = step.select("id", "root"), step.where("root <> old").limit(1).count()
        if not moved:
            forget(both)
            return label

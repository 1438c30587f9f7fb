"""Exact top-k search in Hamming space by incremental multi-index hashing.

Codes of ``bits`` bits are cut into ``m`` segments of about log2(n) bits. Two
codes at distance d < m(r+1) agree in some segment up to r bits, so once all
segments were searched to radius r, every code within m(r+1)-1 was seen. Round
r looks up, in each segment, the keys at distance exactly r; a query is done
when its k-th verified distance is at most m(r+1)-1. Only unfinished queries go
on, and the radius of the last round is found, not given.

Equal codes are one entry (its k+1 smallest ids speak for all copies), so the
work follows distinct codes. Segments are laid out by their leading bits, as many
as keep about ``BUCKET`` entries together: an entry goes to one bucket a segment,
a query to those buckets whose leading bits lie within r of its own. A task reads
its buckets one after the other, the entries first, and the queries in steps. A
pair is reported at the first (radius, segment) that finds it, so nothing needs
to be made distinct; each step returns at most k+1 neighbours a query. Every
round's state is written to the shared folder.

Neighbours are ordered by (distance, id): the result is exact with ties. Rows,
defined results: a row with a null id or a null code is left out; repeated
codes find each other at distance 0; rows with one id and code are one; one id
with several codes is a ValueError; k beyond the table gives what there is; an
empty table or no query gives an empty result; other columns are neither read
nor returned.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orrery.llm import textkit as K
from orrery.runtime import attach, forget, spill_table

_U = np.uint64
#: Candidate pairs verified at a time.
STEP_PAIRS = 2_000_000
#: Entries of a bucket, on average, and queries worked at a time.
BUCKET = 500_000
STEP_QUERIES = 20_000


def sign_code(v: Column, bits: int = 64) -> Column:
    """Bit i is set where element i is positive; null where the vector is null or has another length."""
    code = F.aggregate(F.sequence(F.lit(1), F.lit(bits)), F.lit(0).cast("long"), lambda a, i: F.shiftleft(a, 1).bitwiseOR(F.when(F.element_at(v, i) > 0, 1).otherwise(0).cast("long")))
    return F.when(F.size(v) == bits, code)


def segments(bits: int, n: int) -> list[tuple[int, int]]:
    """(shift, width) of each segment, about log2(n) bits wide."""
    wide = min(bits, max(4, min(24, math.ceil(math.log2(max(2, n))))))
    m = max(1, round(bits / wide))
    cuts = [round(i * bits / m) for i in range(m + 1)]
    return [(a, b - a) for a, b in zip(cuts[:-1], cuts[1:])]


@lru_cache(maxsize=64)
def masks(width: int, radius: int) -> np.ndarray:
    """All values of ``width`` bits with exactly ``radius`` bits set."""
    if radius < 0 or radius > width:
        return np.zeros(0, np.uint64)
    return np.array([sum(1 << i for i in c) for c in combinations(range(width), radius)], np.uint64)


def _best(q: np.ndarray, d: np.ndarray, i: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k smallest (d, i) of each q."""
    o = np.lexsort((i, d, q))
    s = q[o]
    beg = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]])) if len(s) else np.zeros(0, np.int64)
    rank = np.arange(len(s)) - np.repeat(beg, np.diff(np.append(beg, len(s))))
    return o[rank < k]


def probe(codes: np.ndarray, queries: np.ndarray, bound: np.ndarray, seg: int, segs: list[tuple[int, int]], lead: int, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(query, entry, distance) of pairs that this segment finds first at this radius.

    ``codes`` all have equal leading bits in the segment, and so do ``queries``;
    ``bound``: the largest distance of use to each query.
    """
    shift, width = segs[seg]
    low = width - lead
    part = ((_U(1) << _U(low)) - _U(1)) if low else _U(0)
    top_mask = (_U(1) << _U(lead)) - _U(1)
    key = (codes >> _U(shift)) & part
    order = np.argsort(key, kind="stable")
    codes, key = codes[order], key[order]
    if not len(codes) or not len(queries):
        return
    start = np.searchsorted(key, np.arange((1 << low) + 1, dtype=np.uint64))
    top = (codes[0] >> _U(shift + low)) & top_mask
    apart = np.bitwise_count(((queries >> _U(shift + low)) & top_mask) ^ top).astype(np.int64)
    mine = (queries >> _U(shift)) & part
    for a in np.unique(apart).tolist():
        ms = masks(low, radius - a)
        if not len(ms):
            continue
        qs = np.flatnonzero(apart == a)
        step = max(1, STEP_PAIRS // len(ms))
        for lo in range(0, len(qs), step):
            sub = qs[lo : lo + step]
            at = (mine[sub][:, None] ^ ms[None, :]).ravel().astype(np.int64)
            who = np.repeat(sub, len(ms))
            size = start[at + 1] - start[at]
            hit = size > 0
            at, who, size = at[hit], who[hit], size[hit]
            # buckets of any size, a bounded number of pairs at a time
            ends = np.cumsum(size)
            i = 0
            while i < len(at):
                j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + STEP_PAIRS, "right")))
                n = size[i:j]
                entry = np.arange(int(n.sum())) + np.repeat(start[at[i:j]] - (np.cumsum(n) - n), n)
                q = np.repeat(who[i:j], n)
                diff = codes[entry] ^ queries[q]
                d = np.bitwise_count(diff).astype(np.int64)
                ok = d <= bound[q]
                q, entry, d, diff = q[ok], entry[ok], d[ok], diff[ok]
                first = np.ones(len(q), bool)
                for s, (sh, w) in enumerate(segs):
                    if s != seg:
                        other = np.bitwise_count((diff >> _U(sh)) & ((_U(1) << _U(w)) - _U(1) if w < 64 else _U(0xFFFFFFFFFFFFFFFF)))
                        # an earlier segment would have found it at this radius already
                        first &= (other >= radius) if s > seg else (other > radius)
                yield q[first], order[entry[first]], d[first]
                i = j


def _search(segs: list[tuple[int, int]], lead: int, radius: int, k: int):
    """Rows ``seg, top, code, bound, ids`` sorted by bucket, entries (no bound) before queries -> ``code, d, id``."""

    def work(seg: int, entries: pa.Table, parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = pa.Table.from_batches(parts)
        codes = entries["code"].to_numpy().view(np.uint64)
        lists = entries["ids"].combine_chunks()
        width, flat = pa.compute.list_value_length(lists).to_numpy().astype(np.int64), lists.flatten().to_numpy()
        begin = np.cumsum(width) - width
        queries = asked["code"].to_numpy().view(np.uint64)
        bound = asked["bound"].to_numpy().astype(np.int64)
        got: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        held = 0

        def merge():
            q, e, d = (np.concatenate(x) for x in zip(*got))
            # an entry stands for up to k of its ids
            n = np.minimum(width[e], k)
            at = np.arange(int(n.sum())) + np.repeat(begin[e] - (np.cumsum(n) - n), n)
            return q, e, d, np.repeat(q, n), np.repeat(d, n), flat[at], np.repeat(np.arange(len(q)), n)

        for q, e, d in probe(codes, queries, bound, seg, segs, lead, radius):
            got.append((q, e, d))
            held += len(q)
            if held > STEP_PAIRS:  # keep each query's nearest entries only
                q, e, d, q2, d2, i2, of = merge()
                stay = np.unique(of[_best(q2, d2, i2, k)])
                got, held = [(q[stay], e[stay], d[stay])], len(stay)
        if got:
            _, _, _, q2, d2, i2, _ = merge()
            o = _best(q2, d2, i2, k)
            yield from pa.table({"code": queries[q2[o]].view(np.int64), "d": pa.array(d2[o], pa.int32()), "id": i2[o]}).to_batches(max_chunksize=100_000)

    def run(batches):
        now, entries, asked, n = None, [], [], 0
        for b in batches:
            place = b.column(0).to_numpy().astype(np.int64) << 32 | b.column(1).to_numpy()
            cuts = [0, *(np.flatnonzero(place[1:] != place[:-1]) + 1).tolist(), b.num_rows]
            for lo, hi in zip(cuts[:-1], cuts[1:]):
                if lo == hi:
                    continue
                if place[lo] != now:
                    if entries and asked:
                        yield from work(now >> 32, pa.Table.from_batches(entries), asked)
                    now, entries, asked, n = int(place[lo]), [], [], 0
                part = b.slice(lo, hi - lo)
                query = pa.compute.is_valid(part.column(3))
                mine, theirs = part.filter(pa.compute.invert(query)), part.filter(query)
                if mine.num_rows:
                    entries.append(mine)
                if theirs.num_rows and entries:
                    asked.append(theirs)
                    n += theirs.num_rows
                    if n > STEP_QUERIES:
                        yield from work(now >> 32, pa.Table.from_batches(entries), asked)
                        asked, n = [], 0
        if entries and asked:
            yield from work(now >> 32, pa.Table.from_batches(entries), asked)

    return run


def topk(rows: DataFrame, key: Column, code: Column, k: int = 10, bits: int = 64, queries: Column | None = None) -> DataFrame:
    """``query_id, rank, neighbor_id, distance``: the k nearest other rows of every row, or of those where ``queries`` holds.

    ``key`` BIGINT; ``code`` BIGINT whose lower ``bits`` bits are the code.
    """
    spark = attach(rows.sparkSession)
    if k < 1 or not 1 <= bits <= 64:
        raise ValueError("k must be positive and bits in 1..64")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    mask = (1 << bits) - 1 if bits < 64 else -1
    asks = F.lit(True) if queries is None else F.coalesce(queries, F.lit(False))
    src = spill_table(rows.select(key.cast("long").alias("id"), code.cast("long").bitwiseAND(F.lit(mask)).alias("code"), asks.alias("asks")).where("id is not null and code is not null").groupBy("id", "code").agg(F.max("asks").alias("asks")), "codes")
    if src.groupBy("id").count().where("count > 1").limit(1).count():
        raise ValueError("an id has several codes")
    # the k+1 smallest ids of each distinct code, from per-partition smallest ones: no list grows with its copies
    ranked = src.selectExpr("id", "code", "row_number() over (partition by code order by id) as r").where(F.col("r") <= k + 1)
    entries = spill_table(ranked.groupBy("code").agg(F.sort_array(F.collect_list("id")).alias("ids")), "entries")
    n = entries.count()
    segs = segments(bits, n)
    m = len(segs)
    lead = min(min(w for _, w in segs), max(1, math.ceil(math.log2(max(2, parts / m, n / BUCKET)))))
    tops = F.array(*[F.struct(F.lit(i).alias("seg"), F.shiftrightunsigned("code", s + w - lead).bitwiseAND(F.lit((1 << lead) - 1)).alias("top")) for i, (s, w) in enumerate(segs)])
    placed = entries.select(F.inline(tops), "code", F.lit(None).cast("int").alias("bound"), "ids")
    none = F.expr("array_repeat(named_struct('d', cast(0 as int), 'id', cast(0 as bigint)), 0)")
    state = spill_table(src.where("asks").select("code").distinct().select("code", F.lit(bits).alias("bound"), none.alias("best")), "state")
    old, done = [state], []
    for radius in range(max(w for _, w in segs) + 1):
        near = [int(x) for i in range(min(radius, lead) + 1) for x in masks(lead, i)]
        asked = state.select("code", "bound", F.inline(tops)).select("seg", F.explode(F.transform(F.array(*map(F.lit, near)), lambda x: F.col("top").bitwiseXOR(x.cast("long")))).alias("top"), "code", "bound", F.lit(None).cast("array<bigint>").alias("ids"))
        both = placed.unionByName(asked).repartition(parts, "seg", "top").sortWithinPartitions("seg", "top", F.col("bound").asc_nulls_first())
        found = both.mapInArrow(K.tidy(_search(segs, lead, radius, k + 1)), "code long, d int, id long")
        new = found.groupBy("code").agg(F.slice(F.sort_array(F.collect_list(F.struct("d", "id"))), 1, k + 1).alias("new"))
        best = F.slice(F.sort_array(F.concat("best", F.coalesce("new", none))), 1, k + 1)
        state = state.join(new, "code", "left").select("code", best.alias("best"))
        # the k-th other row: entry k+1, the row itself being among them
        state = spill_table(state.withColumn("bound", F.when(F.size("best") > k, F.element_at("best", -1)["d"]).otherwise(bits)), "round")
        old.append(state)
        sure = F.col("bound") <= m * (radius + 1) - 1
        done.append(state.where(sure).select("code", "best"))
        state = state.where(~sure).select("code", "bound", "best")
        if not state.limit(1).count():
            break
    else:
        done.append(state.select("code", "best"))
    best = done[0]
    for x in done[1:]:
        best = best.unionByName(x)
    best = spill_table(best, "best")
    forget(entries, *old)
    others = F.slice(F.filter("best", lambda x: x["id"] != F.col("id")), 1, k)
    flat = src.where("asks").join(best, "code").select(F.col("id").alias("query_id"), F.posexplode(others).alias("at", "x"))
    return flat.select("query_id", (F.col("at") + 1).alias("rank"), F.col("x.id").alias("neighbor_id"), F.col("x.d").alias("distance"))

"""Top-k search: exact over vectors, or over codes.

Queries travel to the vectors as one matrix while it is small (its size is
checked); each task keeps its k best rows a query, and one exchange of at most
tasks x k rows a query ranks the rest. A larger query set never reaches the
driver: it is packed into blocks in the shared scratch folder, and packed blocks
of rows meet packed blocks of queries, so memory is bounded by a block of each at
any number of queries. Blocks are dealt evenly to tasks, however the tables'
files are cut; a task has one block of queries and a share of the rows.

Ranks are by score (descending), then id; scores are compared to 12 digits.
k beyond the candidates gives what there is; k <= 0, no candidate or no query
give no row.
"""

from __future__ import annotations

import io
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orrery.errors import OrreryError, UnknownIdError
from orrery.operators.encode import code_rows, rows_of, validate
from orrery.plans import quantizer as Q
from orrery.runtime import arrow_schema, attach, spill_table

#: Bytes of queries (as doubles) that are sent with the tasks, and of a block of more.
QUERY_BYTES = 16 << 20
BLOCK_BYTES = 4 << 20
#: Rows of a packed block, and scores and queries worked at a time.
BLOCK_ROWS = 8192
STEP_SCORES = 500_000
STEP_QUERIES = 2048
#: Scores that a task computes, as far as packs allow.
TASK_SCORES = 8_000_000_000
#: What rows are for scoring: a matrix whose product with that of the queries has the scores.
Matrix = Callable[[pa.RecordBatch], np.ndarray]
#: What is done to the queries once, before they are sent.
Ready = Callable[[np.ndarray], np.ndarray]


def unit(v: np.ndarray) -> np.ndarray:
    n = np.sqrt((v * v).sum(axis=1, keepdims=True))
    return np.where(n > 0, v / np.where(n > 0, n, 1.0), v)


class _Best:
    """The k best rows so far for each query of a block.

    A product in single precision tells which rows may be among the k best, with
    room for its largest error; these are scored in double precision, and what
    the k-th best has is what later rows must reach.
    """

    def __init__(self, qids: np.ndarray, queries: np.ndarray, k: int, id_type: pa.DataType, per: int):
        self.qids, self.queries, self.k, self.id_type, self.per = qids, queries, k, id_type, per
        self.single = queries.astype(np.float32)
        self.norm = np.sqrt((queries * queries).sum(axis=1))
        self.floor = np.full(len(qids), -np.inf)
        self.held: list[tuple[np.ndarray, pa.Array, np.ndarray]] = []  # numbers of queries, ids, scores
        self.n = 0
        self.scratch = np.empty(0, np.float32), np.empty(0, bool)  # fresh pages for each step cost more than the product

    def _room(self, i: int, rows: int, cols: int) -> np.ndarray:
        if len(self.scratch[0]) < rows * cols:
            self.scratch = np.empty(rows * cols, np.float32), np.empty(rows * cols, bool)
        return self.scratch[i][: rows * cols].reshape(rows, cols)

    def add(self, ids: pa.Array, rows: np.ndarray) -> Iterator[pa.RecordBatch]:
        dim = rows.shape[1]
        single = rows.astype(np.float32)
        norm = np.sqrt((rows * rows).sum(axis=1))
        for c in range(0, len(self.qids), self.per):
            col = slice(c, c + self.per)
            step = max(1, STEP_SCORES // max(1, len(self.qids[col])))
            for lo in range(0, len(rows), step):
                row = slice(lo, lo + step)
                high = norm[row].max()
                wide = not high * self.norm[col].max() < 1e37  # or not finite
                room = (dim + 8) * 2.0 ** (-52 if wide else -23) * high * self.norm[col] + dim * 1e-37 * (1 + high + self.norm[col]) + 1e-11
                if wide:
                    s = rows[row] @ self.queries[col].T
                else:
                    s = np.matmul(single[row], self.single[col].T, out=self._room(0, len(norm[row]), len(self.norm[col])))
                r, q = self._reach(s, self.floor[col] - room, 2 * room)
                for at in range(0, len(r), 32_768):
                    x, y = r[at : at + 32_768] + lo, q[at : at + 32_768] + c
                    score = np.round(np.einsum("ij,ij->i", rows[x], self.queries[y]), 12) + 0.0
                    self.held.append((y, ids.take(pa.array(x)), score))
                self.n += len(r)
                if self.n > max(2 * self.k * len(self.qids), 20_000):
                    self._merge()
                    if self.n > STEP_SCORES // 2:  # more than a task can hold: the exchange ranks them
                        yield from self.give()

    def _reach(self, s: np.ndarray, least: np.ndarray, room: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows and queries whose score isn't below what the query's k-th best has."""
        least = _not_above(least, s.dtype)
        hit = ~np.less(s, least, out=self._room(1, *s.shape)) if s.dtype == np.float64 else np.greater_equal(s, least, out=self._room(1, *s.shape))
        if np.count_nonzero(hit) > 4 * self.k * s.shape[1] and len(s) > self.k:  # no floor yet, or scores that rise from row to row
            best = np.partition(s, len(s) - self.k, axis=0)[len(s) - self.k]
            hit = ~(s < np.maximum(least, _not_above(best - room, s.dtype)))
        flat = hit.ravel()
        if flat.size % 8:
            at = np.flatnonzero(flat)
        else:  # eight at a time: hits are few
            some = np.flatnonzero(flat.view(np.uint64))
            i, j = np.nonzero(flat.reshape(-1, 8)[some])
            at = some[i] * 8 + j
        return at // s.shape[1], at % s.shape[1]

    def _merge(self) -> None:
        q, s = np.concatenate([h[0] for h in self.held]), np.concatenate([h[2] for h in self.held])
        i = pa.concat_arrays([h[1] for h in self.held])
        if pa.types.is_integer(self.id_type):
            key = i.to_numpy(zero_copy_only=False)
        else:
            key = np.argsort(np.argsort(np.array(i.to_pylist(), object), kind="stable"), kind="stable")
        o = np.lexsort((key, np.where(np.isnan(s), -np.inf, -s), q))
        beg = np.flatnonzero(np.concatenate([[True], q[o][1:] != q[o][:-1]]))
        rank = np.arange(len(o)) - np.repeat(beg, np.diff(np.append(beg, len(o))))
        last = o[rank == self.k - 1]
        self.floor[q[last]] = np.fmax(self.floor[q[last]], s[last])
        o = o[rank < self.k]
        self.held, self.n = [(q[o], i.take(pa.array(o)), s[o])], len(o)

    def give(self) -> Iterator[pa.RecordBatch]:
        """``query_id, id, score`` of what is held."""
        if self.n:
            self._merge()
            q, i, s = self.held[0]
            for lo in range(0, len(q), 50_000):
                yield pa.RecordBatch.from_arrays([pa.array(self.qids[q[lo : lo + 50_000]]), i.slice(lo, 50_000), pa.array(s[lo : lo + 50_000])], names=["query_id", "id", "score"])
        self.held, self.n = [], 0


def _not_above(x: np.ndarray, kind: np.dtype) -> np.ndarray:
    """x in another precision, rounded down."""
    y = x.astype(kind)
    return np.where(y > x, np.nextafter(y, kind.type(-np.inf)), y)


def _sent(matrix: Matrix, qids: np.ndarray, queries: np.ndarray, k: int, id_type: pa.DataType):
    def run(batches):
        best = _Best(qids, queries, k, id_type, STEP_QUERIES)
        for b in batches:
            for lo in range(0, b.num_rows, BLOCK_ROWS):
                part = b.slice(lo, BLOCK_ROWS)
                yield from best.add(part.column(0), matrix(part))
        yield from best.give()

    return run


def _pieces(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[int, pa.RecordBatch]]:
    """Number (unique in the table) and rows of pieces of ``size`` rows; a task's last one may have less."""
    from pyspark import TaskContext

    at, held, n = TaskContext.get().partitionId() << 32, [], 0
    for b in batches:
        held.append(b)
        n += b.num_rows
        while n >= size:
            t = pa.Table.from_batches(held)
            yield at, t.slice(0, size).combine_chunks().to_batches()[0]
            at, held, n = at + 1, t.slice(size).to_batches(), n - size
    if n:
        yield at, pa.Table.from_batches(held).combine_chunks().to_batches()[0]


_PACK = "at long, n long, keys binary, body binary"


def _packed(at: int, n: int, keys: bytes, body: bytes) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([at]), pa.array([n]), pa.array([keys], pa.binary()), pa.array([body], pa.binary())], names=["at", "n", "keys", "body"])


def _pack_rows(size: int):
    def run(batches):
        for at, b in _pieces(batches, size):
            out = io.BytesIO()
            with pa.ipc.new_stream(out, b.schema) as w:
                w.write_batch(b)
            yield _packed(at, b.num_rows, b"", out.getvalue())

    return run


def _pack_queries(dim: int, size: int, ready: Ready):
    def run(batches):
        for at, b in _pieces(batches, size):
            yield _packed(at, b.num_rows, b.column(0).to_numpy().tobytes(), ready(rows_of(b.column(1), dim)).tobytes())

    return run


def _met(matrix: Matrix, k: int, id_type: pa.DataType, per: int):
    def run(batches):
        blocks: dict[bytes, _Best] = {}
        for b in batches:
            for rows, keys, queries in zip(*b.columns):
                name = keys.as_py()
                if name not in blocks:
                    qids = np.frombuffer(name, np.int64)
                    blocks[name] = _Best(qids, np.frombuffer(queries.as_py(), np.float64).reshape(len(qids), -1), k, id_type, per)
                part = pa.ipc.open_stream(rows.as_buffer()).read_next_batch()
                yield from blocks[name].add(part.column(0), matrix(part))
        for best in blocks.values():
            yield from best.give()

    return run


def _topk(rows: DataFrame, matrix: Matrix, queries: DataFrame, k: int, ready: Ready, query_key: str, query_embedding: str, dim: int) -> DataFrame:
    spark = attach(rows.sparkSession)
    kind = rows.schema[0].dataType
    out = T.StructType([T.StructField("query_id", T.LongType()), T.StructField("id", kind), T.StructField("score", T.DoubleType())])
    if k <= 0:
        return spark.createDataFrame([], T.StructType([*out.fields, T.StructField("rank", T.IntegerType())])).select("query_id", "rank", "id", "score")
    id_type = arrow_schema(out).field(1).type
    most = max(1, QUERY_BYTES // (8 * dim))
    src = queries.select(queries[query_key].cast("long").alias("q"), queries[query_embedding].cast("array<double>").alias("v"))
    first = src.limit(most + 1).toArrow().combine_chunks()
    if len(first) <= most:
        q = rows_of(first["v"].combine_chunks(), dim) if len(first) else np.zeros((0, dim))
        found = rows.mapInArrow(_sent(matrix, first["q"].to_numpy(), ready(q), k, id_type), out) if len(first) else spark.createDataFrame([], out)
    else:
        found = _in_blocks(rows, matrix, src, k, ready, dim, STEP_QUERIES, out)
    return _final(found, k)


def _dealt(packs: DataFrame, at: list[int], parts: int) -> DataFrame:
    """Packs by turns in ``parts`` partitions."""
    turns = packs.sparkSession.createDataFrame([(x, i % parts) for i, x in enumerate(at)], "at long, turn int")
    return packs.join(F.broadcast(turns), "at").repartitionById(parts, "turn")


def _in_blocks(rows: DataFrame, matrix: Matrix, src: DataFrame, k: int, ready: Ready, dim: int, per: int, out: T.StructType) -> DataFrame:
    """A task takes a pack of queries (``per`` are scored at a time), and a share of the packs of rows one after the other."""
    size = max(1, BLOCK_BYTES // (8 * dim))
    blocks = spill_table(src.mapInArrow(_pack_queries(dim, size, ready), _PACK), "queries")
    packs = spill_table(rows.mapInArrow(_pack_rows(min(BLOCK_ROWS, size)), _PACK), "rows")
    many = [[tuple(r) for r in t.select("at", "n").orderBy("at").collect()] for t in (packs, blocks)]
    count, asked = len(many[0]), max(1, len(many[1]))
    shares = max(-(-2 * rows.sparkSession.sparkContext.defaultParallelism // asked), -(-sum(n for _, n in many[0]) * size // TASK_SCORES))
    left = _dealt(packs, [at for at, _ in many[0]], max(1, min(count, shares))).select("body")
    right = _dealt(blocks, [at for at, _ in many[1]], asked).select("keys", F.col("body").alias("queries"))
    return left.hint("shuffle_replicate_nl").crossJoin(right).mapInArrow(_met(matrix, k, arrow_schema(out).field(1).type, per), out)


def _final(found: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("id"))
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "id", "score")


def blocked_topk(rows: DataFrame, queries: DataFrame, k: int, dim: int, per: int) -> DataFrame:
    """``exact_topk`` of rows ``id, v`` by packed blocks, ``per`` queries at a time, however few there are."""
    attach(rows.sparkSession)
    out = T.StructType([T.StructField("query_id", T.LongType()), T.StructField("id", rows.schema[0].dataType), T.StructField("score", T.DoubleType())])
    src = queries.select(F.col("query_id").cast("long").alias("q"), F.col("embedding").cast("array<double>").alias("v"))
    return _final(_in_blocks(rows, lambda b: rows_of(b.column(1), dim), src, k, lambda q: q, dim, per, out), k)


def allowed(rows: DataFrame, key: str, mask: Column | None = None, allowlist: DataFrame | None = None) -> DataFrame:
    """Rows that pass a mask (a condition) and an allowlist (``id`` column; duplicates count once).

    An empty allowlist and ids that the table doesn't have are errors, as they
    are most likely mistakes; ids that the mask leaves out just don't take part.
    """
    if allowlist is not None:
        ids = allowlist.select(allowlist["id"].alias("__allowed")).distinct()
        if not ids.limit(1).count():
            raise OrreryError("the allowlist is empty")
        strange = ids.join(rows.select(rows[key].alias("__key")), F.col("__allowed") == F.col("__key"), "left_anti").limit(5).collect()
        if strange:
            raise UnknownIdError(f"unknown ids in the allowlist: {[r[0] for r in strange]}")
        rows = rows.join(ids, rows[key] == ids["__allowed"], "left_semi")
    return rows if mask is None else rows.where(mask)


def exact_topk(vectors: DataFrame, queries: DataFrame, k: int = 10, dim: int | None = None, cosine: bool = False, key: str = "id", embedding: str = "embedding", query_key: str = "query_id", query_embedding: str = "embedding", mask: Column | None = None, allowlist: DataFrame | None = None, check: bool = False) -> DataFrame:
    """``query_id, rank, id, score`` by inner product (or cosine) of the vectors themselves."""
    if dim is None:
        first = queries.select(F.size(query_embedding)).limit(1).collect()
        dim = first[0][0] if first else 8
    if check:
        validate(vectors, dim, embedding, key)
        validate(queries, dim, query_embedding, query_key)
    rows = allowed(vectors, key, mask, allowlist).select(F.col(key).alias("id"), F.col(embedding).cast("array<double>").alias("v"))

    def matrix(b: pa.RecordBatch) -> np.ndarray:
        v = rows_of(b.column(1), dim)
        return unit(v) if cosine else v

    return _topk(rows, matrix, queries, k, unit if cosine else lambda q: q, query_key, query_embedding, dim)


def quantized_topk(codes: DataFrame, model: Q.Model, queries: DataFrame, k: int = 10, cosine: bool = False, key: str = "id", query_key: str = "query_id", query_embedding: str = "embedding", mask: Column | None = None, allowlist: DataFrame | None = None, packed: bool = False) -> DataFrame:
    """``query_id, rank, id, score`` from the codes alone."""
    rows = allowed(codes, key, mask, allowlist).select(F.col(key).alias("id"), "code", "scale")

    def matrix(b: pa.RecordBatch) -> np.ndarray:
        return Q.row_matrix(code_rows(b.column(1), model, packed), b.column(2).to_numpy(), model)

    def ready(q: np.ndarray) -> np.ndarray:
        return Q.query_matrix(unit(q) if cosine else q, model)

    return _topk(rows, matrix, queries, k, ready, query_key, query_embedding, model.dim)


def recall_at(exact: DataFrame, found: DataFrame, k: int) -> DataFrame:
    """``recall``: how often the exact first is among the k found."""
    top = exact.where("rank = 1").select("query_id", F.col("id").alias("best"))
    hit = top.join(found.where(F.col("rank") <= k).select("query_id", F.col("id").alias("best"), F.lit(1).alias("hit")), ["query_id", "best"], "left")
    return hit.agg(F.avg(F.coalesce("hit", F.lit(0))).alias("recall"))


def overlap_at(exact: DataFrame, found: DataFrame, k: int) -> DataFrame:
    """``overlap``: the share of the exact k that was found."""
    a = exact.where(F.col("rank") <= k).select("query_id", "id")
    b = found.where(F.col("rank") <= k).select("query_id", "id", F.lit(1).alias("hit"))
    return a.join(b, ["query_id", "id"], "left").agg((F.sum(F.coalesce("hit", F.lit(0))) / F.count(F.lit(1))).alias("overlap"))

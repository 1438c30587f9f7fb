"""Encoding of embedding columns: one Arrow pass over the rows, no shuffle."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orrery.errors import BadValueError, CalibrationError, DimensionError
from orrery.functions.vectors import bad_coordinate
from orrery.plans import quantizer as Q
from orrery.runtime import arrow_schema, attach, cut

#: Sample size at which a calibration stops improving.
RECOMMENDED_SAMPLE = 1000


def rows_of(col: pa.Array, dim: int) -> np.ndarray:
    """A list column as rows x dim."""
    return np.asarray(col.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(len(col), dim)


def validate(vectors: DataFrame, dim: int, embedding: str = "embedding", key: str | None = None) -> None:
    """Eager gate: no null or odd-sized vector, no coordinate that isn't finite and below 1e16."""
    if dim <= 0 or dim % 8 or dim > Q.MAX_DIM:
        raise DimensionError(f"dim must be a positive multiple of 8, {Q.MAX_DIM} at most")
    v = vectors[embedding]
    bad = vectors.select((F.coalesce(F.size(v), F.lit(-1)) != dim).alias("size"), bad_coordinate(v).alias("at"), (vectors[key] if key else F.lit(None)).alias("key"))
    row = bad.where("size or at is not null").orderBy(F.col("key")).limit(1).collect()
    if row and row[0]["size"]:
        raise DimensionError(f"a vector is null or hasn't {dim} coordinates (key {row[0]['key']})")
    if row:
        raise BadValueError(f"coordinate {row[0]['at']} isn't a finite number below 1e16 (key {row[0]['key']})")


def first_invalid(vectors: DataFrame, order: Column, embedding: str = "embedding") -> DataFrame:
    """``row_key, coord``: the first bad coordinate of the first bad row in ``order`` (no row if all are good)."""
    return vectors.select(order.alias("row_key"), bad_coordinate(vectors[embedding]).alias("coord")).where("coord is not null").orderBy("row_key").limit(1)


def _encode(model: Q.Model, at: int, schema: pa.Schema, packed: bool):
    def run(batches):
        for b in batches:
            codes, scale = Q.encode(rows_of(b.column(at), model.dim), model)
            raw = Q.pack(codes, model.bits) if packed else codes
            blob = pa.array([x.tobytes() for x in raw], pa.binary())
            yield pa.RecordBatch.from_arrays([*[b.column(i) for i in range(b.num_columns) if i != at], blob, pa.array(scale)], schema=schema)

    return run


def encode(vectors: DataFrame, model: Q.Model, embedding: str = "embedding", keep: tuple[str, ...] = ("id",), packed: bool = False) -> DataFrame:
    """``keep`` columns plus ``code BINARY`` (a byte a coordinate, or bit planes) and ``scale DOUBLE``."""
    attach(vectors.sparkSession)
    src = vectors.select(*[vectors[c] for c in keep], vectors[embedding].cast("array<double>").alias("__v"))
    out = T.StructType([*[src.schema[i] for i in range(len(keep))], T.StructField("code", T.BinaryType()), T.StructField("scale", T.DoubleType())])
    return src.mapInArrow(_encode(model, len(keep), arrow_schema(out), packed), out)


def code_rows(col: pa.Array, model: Q.Model, packed: bool) -> np.ndarray:
    raw = np.frombuffer(b"".join(col.to_pylist()), np.uint8).reshape(len(col), -1)
    return Q.unpack(raw, model.bits, model.dim) if packed else raw


def _map_codes(fn, codes: DataFrame, packed: bool, model: Q.Model) -> DataFrame:
    schema = arrow_schema(codes.schema)
    ic, is_ = codes.columns.index("code"), codes.columns.index("scale")

    def run(batches):
        for b in batches:
            new, scale = fn(code_rows(b.column(ic), model, packed), b.column(is_).to_numpy())
            cols = list(b.columns)
            cols[ic] = pa.array([x.tobytes() for x in new], pa.binary())
            cols[is_] = pa.array(np.asarray(scale, np.float64))
            yield pa.RecordBatch.from_arrays(cols, schema=schema)

    return codes.mapInArrow(run, codes.schema)


def pack(codes: DataFrame, model: Q.Model) -> DataFrame:
    attach(codes.sparkSession)
    return _map_codes(lambda c, s: (Q.pack(c, model.bits), s), codes, False, model)


def unpack(codes: DataFrame, model: Q.Model) -> DataFrame:
    attach(codes.sparkSession)
    return _map_codes(lambda c, s: (c, s), codes, True, model)


def reencode(codes: DataFrame, old: Q.Model, new: Q.Model) -> DataFrame:
    """Stored rows under another calibration, without their vectors."""
    attach(codes.sparkSession)
    if (old.dim, old.bits, old.seed) != (new.dim, new.bits, new.seed):
        raise DimensionError("only the calibration may differ")
    return _map_codes(lambda c, s: Q.reencode(c, s, old, new), codes, False, old)


def _rotate(seed: int, at: int, schema: pa.Schema, dim: int):
    def run(batches):
        for b in batches:
            v = rows_of(b.column(at), dim)
            norm = np.sqrt((v * v).sum(axis=1))
            u = np.where((norm > Q.TINY)[:, None], Q.rotate(v, seed) / np.where(norm > Q.TINY, norm, 1)[:, None], 0.0)
            offs = pa.array(np.arange(0, u.size + 1, dim), pa.int32())
            yield pa.RecordBatch.from_arrays([*[b.column(i) for i in range(b.num_columns) if i != at], pa.ListArray.from_arrays(offs, pa.array(u.ravel()))], schema=schema)

    return run


def rotated(vectors: DataFrame, dim: int, embedding: str = "embedding", keep: tuple[str, ...] = ("id",), seed: int = 42) -> DataFrame:
    """``keep`` columns plus ``rotated ARRAY<DOUBLE>``, the rotated unit vector."""
    attach(vectors.sparkSession)
    src = vectors.select(*[vectors[c] for c in keep], vectors[embedding].cast("array<double>").alias("__v"))
    out = T.StructType([*[src.schema[i] for i in range(len(keep))], T.StructField("rotated", T.ArrayType(T.DoubleType()))])
    return src.mapInArrow(_rotate(seed, len(keep), arrow_schema(out), dim), out)


#: Steps of a coordinate's histogram over [-1, 1].
BINS = 4096


def _bins(u: np.ndarray) -> np.ndarray:
    return np.clip(np.floor((u + 1) * (BINS / 2)), 0, BINS - 1).astype(np.int64)


def _histogram(dim: int):
    def run(batches):
        n = np.zeros(dim * BINS, np.int64)
        for b in batches:
            n += np.bincount((_bins(rows_of(b.column(0), dim)) + np.arange(dim) * BINS).ravel(), minlength=len(n))
        at = np.flatnonzero(n)
        for lo in range(0, len(at), 100_000):
            k = at[lo : lo + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(k // BINS, pa.int32()), pa.array(k % BINS, pa.int32()), pa.array(n[k])], names=["coord", "bin", "n"])

    return run


def _inside(dim: int, wanted: np.ndarray):
    """Values in the wanted bins (2 x dim)."""

    def run(batches):
        for b in batches:
            u = rows_of(b.column(0), dim)
            bins = _bins(u)
            for end in (0, 1):
                r, c = np.nonzero(bins == wanted[end])
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int32()), pa.array(np.full(len(c), end), pa.int32()), pa.array(u[r, c])], names=["coord", "end", "x"])

    return run


def calibration_table(sample: DataFrame, dim: int, bits: int, embedding: str = "embedding", seed: int = 42) -> DataFrame:
    """``coord, shift, scale``: two order statistics of each rotated coordinate put on the ends of the codebook.

    A histogram of every coordinate, made where the rows are, tells in which of
    its steps the two lie; only values of these steps are then sorted. A
    coordinate of (nearly) one value keeps shift 0 and scale 1.
    """
    p_lo, p_hi, outer = Q.anchor(bits, dim)
    u = rotated(sample, dim, embedding, (), seed)
    steps = u.mapInArrow(_histogram(dim), "coord int, bin int, n long").groupBy("coord", "bin").agg(F.sum("n").alias("n"))
    w = Window.partitionBy("coord")
    upto = steps.select("coord", "bin", "n", F.sum("n").over(w.orderBy("bin")).alias("upto"), F.sum("n").over(w).alias("all"))
    lo = F.floor(F.col("all") * p_lo)
    hi = F.greatest(F.least(F.floor(F.col("all") * p_hi), F.col("all") - 1), lo + 1)
    ranks = F.explode(F.array(F.struct(F.lit(0).alias("end"), lo.alias("r")), F.struct(F.lit(1).alias("end"), hi.alias("r"))))
    # two rows a coordinate
    found = cut(upto.select("coord", "bin", "n", "upto", ranks.alias("w")).where("w.r < upto and w.r >= upto - n").select("coord", F.col("w.end").alias("end"), "bin", (F.col("w.r") - F.col("upto") + F.col("n")).alias("r")))
    wanted = np.full((2, dim), -1)
    for x in found.collect():
        wanted[x["end"], x["coord"]] = x["bin"]
    values = u.mapInArrow(_inside(dim, wanted), "coord int, end int, x double").groupBy("coord", "end", "x").agg(F.count(F.lit(1)).alias("n"))
    ranked = values.select("coord", "end", "x", "n", F.sum("n").over(Window.partitionBy("coord", "end").orderBy("x")).alias("upto"))
    hit = ranked.join(found.select("coord", "end", "r"), ["coord", "end"]).where("r < upto and r >= upto - n")
    two = hit.groupBy("coord").agg(F.max(F.when(F.col("end") == 0, F.col("x"))).alias("a"), F.max(F.when(F.col("end") == 1, F.col("x"))).alias("b"))
    span = F.col("b") - F.col("a")
    ok = span > 1e-6
    s = F.lit(2 * outer) / span
    return two.select("coord", F.when(ok, -outer / s - F.col("a")).otherwise(0.0).alias("shift"), F.when(ok, s).otherwise(1.0).alias("scale"))


def calibrate(sample: DataFrame, model: Q.Model, embedding: str = "embedding") -> Q.Model:
    """The model fitted to a sample (a random one; about ``RECOMMENDED_SAMPLE`` rows are enough)."""
    validate(sample, model.dim, embedding)
    rows = calibration_table(sample, model.dim, model.bits, embedding, model.seed).collect()
    if len(rows) != model.dim or sample.limit(2).count() < 2:
        raise CalibrationError("calibration needs two rows at least")
    got = {r["coord"]: (r["shift"], r["scale"]) for r in rows}
    shift, scale = zip(*(got[i] for i in range(model.dim)))
    if all(x == 0 for x in shift) and all(x == 1 for x in scale):
        raise CalibrationError("every coordinate of the sample has one value only")
    return Q.Model(model.dim, model.bits, shift, scale, model.seed)

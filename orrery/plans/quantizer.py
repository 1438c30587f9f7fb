"""The quantizer's constants and kernels: codebook, rotation, encoding, scoring.

Everything is a function of (dim, bits) and, if calibrated, of a (shift, scale)
pair a coordinate. Kernels take and give numpy arrays of rows and compute in
double precision.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np

from orrery.errors import DimensionError

MAX_DIM = 16384
TINY = 1e-10
LEAST_INNER = 0.1
ROUNDS = 2




@lru_cache(maxsize=32)
def _marginal(dim: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Grid over [-1, 1], and the integrals up to each grid point of the density of a unit vector's coordinate and of x times it."""
    # points crowd around nought, where the mass is
    u = np.linspace(-1, 1, 400_001)
    x = np.sinh(u * np.arcsinh(np.sqrt(dim))) / np.sqrt(dim)
    x[0], x[-1] = -1.0, 1.0
    with np.errstate(divide="ignore"):
        log = np.log1p(-(x[1:-1] ** 2)) * ((dim - 3) / 2)
    p = np.zeros_like(x)
    p[1:-1] = np.exp(log - log.max())
    h = np.diff(x)
    mass = np.concatenate([[0.0], np.cumsum((p[1:] + p[:-1]) / 2 * h)])
    moment = np.concatenate([[0.0], np.cumsum((p[1:] * x[1:] + p[:-1] * x[:-1]) / 2 * h)])
    return x, mass / mass[-1], moment / mass[-1]


@lru_cache(maxsize=64)
def codebook(bits: int, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Lloyd-Max (boundaries, centroids), ascending and symmetric."""
    check_geometry(dim, bits)
    x, mass, moment = _marginal(dim)
    k = 1 << bits
    c = np.interp((np.arange(k) + 0.5) / k, mass, x)
    for _ in range(2_000):
        edge = np.concatenate([[-1.0], (c[1:] + c[:-1]) / 2, [1.0]])
        m, f = np.interp(edge, x, mass), np.interp(edge, x, moment)
        new = np.diff(f) / np.maximum(np.diff(m), 1e-300)
        new = (new - new[::-1]) / 2
        moved = np.abs(new - c).max()
        c = new
        if moved < 1e-12:
            break
    c = c.astype(np.float32).astype(np.float64)
    return ((c[1:] + c[:-1]) / 2).astype(np.float32).astype(np.float64), c


def check_geometry(dim: int, bits: int) -> None:
    if bits not in (2, 3, 4):
        raise DimensionError("bits must be 2, 3 or 4")
    if dim <= 0 or dim % 8 or dim > MAX_DIM:
        raise DimensionError(f"dim must be a positive multiple of 8, {MAX_DIM} at most")


def _stream(dim: int, seed: int) -> np.random.Generator:
    return np.random.Generator(np.random.PCG64(np.random.SeedSequence([dim, seed])))


@lru_cache(maxsize=16)
def rotation_parts(dim: int, seed: int = 42) -> tuple[tuple[np.ndarray, np.ndarray], ...]:
    """(permutation, signs) of each round."""
    g = _stream(dim, seed)
    return tuple((g.permutation(dim), np.where(g.random(dim) < 0.5, -1.0, 1.0)) for _ in range(ROUNDS))


@lru_cache(maxsize=16)
def _hadamard(n: int) -> np.ndarray:
    h = np.ones((1, 1))
    while len(h) < n:
        h = np.block([[h, h], [h, -h]])
    return h


def rotate(v: np.ndarray, seed: int = 42) -> np.ndarray:
    """Rows times the fixed orthogonal matrix: rounds of permutation, signs and block Hadamard transforms.

    A block's matrix is the Kronecker product of two of about the root of its
    size, so a transform is two small matrix products.
    """
    dim = v.shape[1]
    block = dim & -dim
    low = 1 << (block.bit_length() // 2)
    high = block // low
    out = np.empty(v.shape)
    for lo in range(0, len(v), 256):
        x = np.asarray(v[lo : lo + 256], np.float64)
        for perm, sign in rotation_parts(dim, seed):
            x = x[:, perm] * (sign / np.sqrt(block))
            y = x.reshape(-1, low) @ _hadamard(low)
            y = y.reshape(-1, high, low).transpose(0, 2, 1).reshape(-1, high) @ _hadamard(high)
            x = y.reshape(-1, low, high).transpose(0, 2, 1).reshape(-1, dim)
        out[lo : lo + 256] = x
    return out


def rotation_matrix(dim: int, seed: int = 42) -> np.ndarray:
    """R with ``rotate(v) = v @ R.T``."""
    return rotate(np.eye(dim), seed).T


@dataclass(frozen=True)
class Model:
    """All that encoding and scoring need; ``shift`` and ``scale`` are empty without calibration."""

    dim: int
    bits: int
    shift: tuple[float, ...] = ()
    scale: tuple[float, ...] = ()
    seed: int = 42

    def __post_init__(self):
        check_geometry(self.dim, self.bits)
        if len(self.shift) != len(self.scale) or len(self.shift) not in (0, self.dim):
            raise DimensionError("shift and scale must both be empty or have a value a coordinate")

    @property
    def calibrated(self) -> bool:
        return bool(self.shift)

    @property
    def state(self) -> str:
        return "calibrated" if self.calibrated else "uncalibrated"

    def pair(self) -> tuple[np.ndarray, np.ndarray]:
        if not self.calibrated:
            return np.zeros(self.dim), np.ones(self.dim)
        return np.array(self.shift), np.array(self.scale)

    def codebook(self) -> tuple[np.ndarray, np.ndarray]:
        return codebook(self.bits, self.dim)


def quantize(u: np.ndarray, model: Model) -> np.ndarray:
    """Codes of rotated unit rows: the number of boundaries strictly below each calibrated coordinate."""
    shift, s = model.pair()
    return np.searchsorted(model.codebook()[0], (u + shift) * s, side="left").astype(np.uint8)


def reconstruct(codes: np.ndarray, model: Model) -> np.ndarray:
    shift, s = model.pair()
    return model.codebook()[1][codes] / s - shift


def encode(v: np.ndarray, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """(codes, scale) of rows; a row of no length, or one whose code points elsewhere, has scale 0."""
    v = np.asarray(v, np.float64)
    norm = np.sqrt((v * v).sum(axis=1))
    live = norm > TINY
    u = np.where(live[:, None], rotate(v, model.seed) / np.where(live, norm, 1.0)[:, None], 0.0)
    return _finish(u, norm, model)


def _finish(u: np.ndarray, norm: np.ndarray, model: Model) -> tuple[np.ndarray, np.ndarray]:
    codes = quantize(u, model)
    inner = (u * reconstruct(codes, model)).sum(axis=1)
    ok = inner > LEAST_INNER
    return codes, np.where(ok, norm / np.where(ok, inner, 1.0), 0.0)


def reencode(codes: np.ndarray, scale: np.ndarray, old: Model, new: Model) -> tuple[np.ndarray, np.ndarray]:
    """Codes under another calibration, from the reconstruction alone."""
    x = reconstruct(codes, old)
    length = np.sqrt((x * x).sum(axis=1))
    u = x / np.where(length > TINY, length, 1.0)[:, None]
    return _finish(u, scale * length, new)


def scores(codes: np.ndarray, scale: np.ndarray, queries: np.ndarray, model: Model, rotated: bool = False) -> np.ndarray:
    """rows x queries: scale * (sum of (Rq / s) c[code] - sum of (Rq) shift). ``rotated``: the queries are Rq already."""
    shift, s = model.pair()
    q = queries if rotated else rotate(queries, model.seed)
    return scale[:, None] * (model.codebook()[1][codes] @ (q / s).T - q @ shift)


def row_matrix(codes: np.ndarray, scale: np.ndarray, model: Model) -> np.ndarray:
    """Rows whose products with those of ``query_matrix`` are the scores."""
    x = model.codebook()[1][codes]
    return scale[:, None] * (np.hstack([x, np.full((len(x), 1), -1.0)]) if model.calibrated else x)


def query_matrix(queries: np.ndarray, model: Model) -> np.ndarray:
    shift, s = model.pair()
    q = rotate(queries, model.seed)
    return np.hstack([q / s, (q @ shift)[:, None]]) if model.calibrated else q


def pack(codes: np.ndarray, bits: int) -> np.ndarray:
    """Bit planes: plane p holds bit p of every code, eight codes a byte, the first in the top bit."""
    n, dim = codes.shape
    return np.concatenate([np.packbits((codes >> p) & 1, axis=1) for p in range(bits)], axis=1).reshape(n, bits * dim // 8)


def unpack(packed: np.ndarray, bits: int, dim: int) -> np.ndarray:
    planes = packed.reshape(len(packed), bits, dim // 8)
    return sum(np.unpackbits(planes[:, p], axis=1) << p for p in range(bits)).astype(np.uint8)


def anchor(bits: int, dim: int) -> tuple[float, float, float]:
    """(p_lo, p_hi, outermost centroid): where the codebook ends, as probabilities of the marginal."""
    x, mass, _ = _marginal(dim)
    outer = float(np.abs(codebook(bits, dim)[1]).max())
    p = float(np.interp(outer, x, mass))
    return 1 - p, p, outer

"""Packed payloads: arrays of unsigned numbers as compressed byte planes, and plain bytes, in one blob."""

from __future__ import annotations

import io
import struct
from functools import lru_cache

import numpy as np


@lru_cache(maxsize=1)
def _zstd():
    import zstandard

    return zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()


def pack(*items: np.ndarray | bytes) -> bytes:
    """Arrays are kept as hashes (uint64) or as numbers from 0 on, in as few planes as the largest needs."""
    out = io.BytesIO()
    out.write(struct.pack("<H", len(items)))
    for x in items:
        if isinstance(x, np.ndarray):
            kind, n = (9 if x.dtype == np.uint64 else 0), len(x)
            width = 8 if kind else max(1, (int(x.max(initial=0)).bit_length() + 7) // 8)
            raw = np.ascontiguousarray(x, "<u8").view(np.uint8).reshape(-1, 8).T[:width].tobytes()
            kind = kind or width
        else:
            kind, n, raw = 255, len(x), x
        z = _zstd()[0].compress(raw) if raw else b""
        out.write(struct.pack("<BQQ", kind, n, len(z)))
        out.write(z)
    return out.getvalue()


def unpack(blob: bytes) -> list[np.ndarray | bytes]:
    """What ``pack`` was given; numbers come as int64, hashes as uint64."""
    at, out = 2, []
    for _ in range(struct.unpack_from("<H", blob)[0]):
        kind, n, z = struct.unpack_from("<BQQ", blob, at)
        at += 17
        width = {255: 1, 9: 8}.get(kind, kind)
        raw = _zstd()[1].decompress(blob[at : at + z], max_output_size=n * width) if n else b""
        at += z
        if kind == 255:
            out.append(raw)
            continue
        b = np.zeros((n, 8), np.uint8)
        b[:, :width] = np.frombuffer(raw, np.uint8).reshape(width, n).T
        out.append(b.view("<u8" if kind == 9 else "<i8").ravel())
    return out

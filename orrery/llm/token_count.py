"""Token counts: batch encoding in Arrow functions that return lengths only.

Texts are regrouped, across the batches that Spark sends, into batches of about
equal bytes; a long text is split at safe boundaries (a plain space between a
letter or number and a non-space), where the vocabulary's pattern splits in any
case, so the counts of its pieces add up exactly. There is no shuffle: the
scan's own byte-sized partitions are the work units.

Rows, defined results: null text -> null count; empty text -> 0; repeated rows
-> one output row each; empty table -> empty result; a very long text without a
safe boundary is one piece; only ``keep`` columns of the input are read, and one
named like the result is refused.
"""

from __future__ import annotations

import re

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from orrery.llm import textkit as K
from orrery.llm import vocab
from orrery.llm.bpe import _arrow_schema
from orrery.runtime import attach

BATCH_BYTES = 1_000_000
_SAFE = re.compile(r"(?<=[^\W_]) (?=\S)")


def pieces(text: str, limit: int) -> list[str]:
    """``text`` in pieces of about ``limit`` bytes, cut only at safe boundaries."""
    step = max(1, limit * len(text) // max(1, len(text.encode("utf-8", "surrogatepass"))))
    out, at = [], 0
    while len(text) - at > step:
        m = _SAFE.search(text, at + step)
        if m is None:
            break
        out.append(text[at : m.start()])
        at = m.start()
    out.append(text[at:])
    return out


def _count(text_at: int, keep_at: list[int], path: str, limit: int, schema: pa.Schema):
    def run(arrow_batches):
        enc = vocab.byte_encoder(path)
        rows: list[pa.RecordBatch] = []  # whose texts are all in ``total`` or ``batch``
        total: list[int | None] = []
        batch: list[tuple[int, str]] = []
        size = 0

        def encode() -> None:
            nonlocal size
            for (i, _), ids in zip(batch, enc.encode_ordinary_batch([p for _, p in batch], num_threads=1)):
                total[i] += len(ids)
            batch.clear()
            size = 0

        def give():
            at = 0
            for b in rows:
                yield pa.RecordBatch.from_arrays([*b.columns[: len(keep_at)], pa.array(total[at : at + b.num_rows], pa.int64())], schema=schema)
                at += b.num_rows
            rows.clear()
            total.clear()

        for b in arrow_batches:
            column = b.column(text_at)
            wide = pa.compute.fill_null(pa.compute.binary_length(column), 0).to_pylist()
            for t, n in zip(column.to_pylist(), wide):
                total.append(None if t is None else 0)
                for p in pieces(t, limit) if n > limit else [t] if n else []:
                    batch.append((len(total) - 1, p))
                    size += n if n <= limit else len(p.encode("utf-8", "surrogatepass"))
                    if size >= limit:
                        encode()
            rows.append(pa.RecordBatch.from_arrays([b.column(i) for i in keep_at] or [pa.nulls(b.num_rows)], names=[f"c{i}" for i in range(len(keep_at))] or ["none"]))
            if not batch or len(rows) == 8:
                encode()
                yield from give()
        encode()
        yield from give()

    return run


def token_counts(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), vocabulary: str | None = None, name: str = "n_tokens", batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """``keep`` columns plus the number of byte-level BPE tokens of each text."""
    attach(docs.sparkSession)
    if name in keep:
        raise ValueError(f"{name} is already a column")
    src = docs.select(*[docs[c].alias(f"c{i}") for i, c in enumerate(keep)], docs[text].alias("text"))
    out = T.StructType([*[T.StructField(c, docs.schema[c].dataType) for c in keep], T.StructField(name, T.LongType())])
    path = vocab.locate(vocabulary, vocab.BYTE_RANKS)
    return src.mapInArrow(K.tidy(_count(len(keep), list(range(len(keep))), path, batch_bytes, _arrow_schema(out))), out)

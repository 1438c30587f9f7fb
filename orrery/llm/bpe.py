"""Byte-level BPE encoding and decoding with a global distinct-word shuffle.

Encoding explodes texts into pre-tokens with their positions, sends each
distinct word to the one owner of its hash, encodes it there once, joins the ids
back, and reassembles documents by position. What crosses the network is packed:
per block of text the distinct words (front to one owner each), the ids on their
way back, and the positions as word numbers in byte planes; an exploded table of
(document, position, word) rows would be several times the input. The
pre-tokenizer runs twice, once for the words and once for the positions, so that
positions cross the network once only. Both runs must see the same rows: input
that isn't a plain scan is written down first, and each block's two halves bear
a mark of its words, whose difference is an error.

Decoding works the same way round: documents are packed, each pack's distinct
ids are exploded to rows and joined with the token-byte table (one row per
vocabulary entry, so it is broadcast), and the bytes are put back by position.
A pack stays in one task and its rows in order, which is verified row by row,
so nothing is shuffled.

Rows, defined results:
  null text      -> null ids, 0 tokens        empty text -> empty ids
  repeated rows  -> one output row each       null ids in other columns pass
  empty table    -> empty result              very long texts go in steps
  columns whose names clash with a result's are refused; others don't matter:
  only ``keep`` columns are carried
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orrery.llm import textkit as K
from orrery.llm import vocab
from orrery.llm.wire import pack, unpack
from orrery.runtime import attach, size_of, stable

#: Characters whose distinct words form one dictionary, and characters handled at a time.
BLOCK_CHARS = 3_000_000
STEP_CHARS = 400_000
#: Bytes of input for each owner of words (an owner's words are in memory one owner at a time), and the most owners: a block has a message for each.
OWNER_BYTES = 16 << 20
MAX_OWNERS = 1024
#: Tokens of a pack of documents to decode (one document at least).
PACK_TOKENS = 200_000
_WIRE = "route long, block long, kind int, seq long, payload binary"
_WIRE_PA = pa.schema([("route", pa.int64()), ("block", pa.int64()), ("kind", pa.int32()), ("seq", pa.int64()), ("payload", pa.binary())])


def _rows(route: list[int], block: int, kind: int, seq: list[int], payload: list[bytes]) -> pa.RecordBatch:
    n = len(route)
    return pa.RecordBatch.from_arrays([pa.array(route, pa.int64()), pa.array([block] * n, pa.int64()), pa.array([kind] * n, pa.int32()), pa.array(seq, pa.int64()), pa.array(payload, pa.binary())], schema=_WIRE_PA)


def _ipc(batch: pa.RecordBatch) -> bytes:
    out = io.BytesIO()
    with pa.ipc.new_stream(out, batch.schema) as w:
        w.write_batch(batch)
    return out.getvalue()


def _ragged(values: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """values[b:b+s] of each pair, one after the other."""
    total = int(size.sum())
    shift = np.repeat(begin - (np.cumsum(size) - size), size)
    return values[np.arange(total) + shift]


class _Words:
    """Distinct words of a block, numbered as they first occur, known by their hashes; ``keep``: with their bytes."""

    def __init__(self, keep: bool):
        self.hashes, self.numbers = np.zeros(0, np.uint64), np.zeros(0, np.int64)  # sorted by hash
        self.ordered: list[np.ndarray] = []  # hashes by number
        self.keep = keep
        self.bytes: list[np.ndarray] = []
        self.size: list[np.ndarray] = []
        self.chars = 0

    def add(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Word numbers of all pre-tokens of the texts, and the number of pre-tokens of each text."""
        cp, starts = K.codepoints(texts)
        self.chars += len(cp)
        beg = K.pretokens(cp, starts)
        end = np.append(beg[1:], len(cp))
        h = K.span_hashes(cp, beg, end)
        uniq, at, inv = np.unique(h, return_index=True, return_inverse=True)
        pos = np.searchsorted(self.hashes, uniq)
        old = np.zeros(len(uniq), bool)
        ok = pos < len(self.hashes)
        old[ok] = self.hashes[pos[ok]] == uniq[ok]
        num = np.empty(len(uniq), np.int64)
        num[old] = self.numbers[pos[old]]
        fresh = np.flatnonzero(~old)
        fresh = fresh[np.argsort(at[fresh], kind="stable")]
        num[fresh] = len(self.hashes) + np.arange(len(fresh))
        if self.keep and len(cp):
            self._verify(texts, cp, beg, end, at, inv, num, fresh, old)
        if len(fresh):
            self.ordered.append(uniq[fresh])
            hashes, numbers = np.concatenate([self.hashes, uniq[fresh]]), np.concatenate([self.numbers, num[fresh]])
            o = np.argsort(hashes, kind="stable")
            self.hashes, self.numbers = hashes[o], numbers[o]
        return num[inv], np.diff(np.searchsorted(beg, starts))

    def _verify(self, texts, cp, beg, end, at, inv, num, fresh, old) -> None:
        """Equal hashes must be equal words, here and among the words known; takes the fresh words' bytes."""
        size, rep = end - beg, at[inv]
        if not (np.array_equal(size, size[rep]) and np.array_equal(cp, cp[np.repeat(beg[rep] - beg, size) + np.arange(len(cp))])):
            raise ValueError("two words share a 64-bit hash")
        body = np.frombuffer("".join(texts).encode("utf-8", "surrogatepass"), np.uint8)
        wide = np.concatenate([[0], np.cumsum(1 + (cp >= 0x80).astype(np.int64) + (cp >= 0x800) + (cp >= 0x10000))])
        b, n = wide[beg[at]], wide[end[at]] - wide[beg[at]]
        if old.any():
            known, width = np.concatenate(self.bytes), np.concatenate(self.size)
            k = num[old]
            if not (np.array_equal(width[k], n[old]) and np.array_equal(_ragged(known, (np.cumsum(width) - width)[k], n[old]), _ragged(body, b[old], n[old]))):
                raise ValueError("two words share a 64-bit hash")
            self.bytes, self.size = [known], [width]
        self.bytes.append(_ragged(body, b[fresh], n[fresh]))
        self.size.append(n[fresh])

    def mark(self) -> np.ndarray:
        """Of all words in their order; the same for both halves of a block."""
        h = np.concatenate(self.ordered) if self.ordered else np.zeros(0, np.uint64)
        return np.array([K.mix(h + np.arange(len(h), dtype=np.uint64)).sum(dtype=np.uint64)], np.uint64)

    def owners(self, owners: int) -> np.ndarray:
        h = np.concatenate(self.ordered) if self.ordered else np.zeros(0, np.uint64)
        return (h % np.uint64(owners)).astype(np.int64)


def _split(text_at: int, keep_at: list[int], owners: int, block_chars: int, words: bool):
    """Rows of the words for their owners, or of the documents for their block."""

    def close(block: _Words, number: int) -> pa.RecordBatch:
        owner = block.owners(owners)
        if not words:
            return _rows([0], number, 1, [0], [pack(block.mark(), owner)])
        body, size = np.concatenate(block.bytes or [np.zeros(0, np.uint8)]), np.concatenate(block.size or [np.zeros(0, np.int64)])
        begin = np.cumsum(size) - size
        order = np.argsort(owner, kind="stable")
        cuts = K.groups(owner[order])
        to, payload = [], []
        for lo, hi in zip(cuts.tolist(), np.append(cuts[1:], len(order)).tolist()):
            k = order[lo:hi]
            to.append(int(owner[k[0]]))
            payload.append(pack(block.mark(), size[k], _ragged(body, begin[k], size[k]).tobytes()))
        return _rows(to, number, 0, to, payload)

    def run(batches):
        from pyspark import TaskContext

        # blocks are numbered by scan partition, the same in both runs
        number = TaskContext.get().partitionId() << 24
        block, step = _Words(words), 0
        for b in batches:
            texts = b.column(text_at).to_pylist()
            body = [t or "" for t in texts]
            carried = pa.RecordBatch.from_arrays([b.column(i) for i in keep_at], names=[f"c{i}" for i in range(len(keep_at))])
            for lo, hi in K.rechunk(body, STEP_CHARS):
                seq, counts = block.add(body[lo:hi])
                if not words:
                    counts[[i for i, t in enumerate(texts[lo:hi]) if t is None]] = -1
                    yield _rows([0], number, 2, [step], [pack(_ipc(carried.slice(lo, hi - lo)), counts + 1, seq)])
                step += 1
                if block.chars >= block_chars:
                    yield close(block, number)
                    number += 1
                    block, step = _Words(words), 0
        if step:
            yield close(block, number)

    return run


def _encode_words(path: str):
    """Owner side (rows sorted by owner): ids of every word, each distinct word encoded once."""

    def run(batches):
        enc = vocab.byte_encoder(path)._core_bpe
        now, known = None, {}
        for b in batches:
            payload = []
            for route, blob in zip(b.column(0).to_pylist(), b.column(4)):
                if route != now:
                    now, known = route, {}
                mark, lens, body = unpack(blob.as_py())
                ids, sizes, at = [], [], 0
                for size in lens.tolist():
                    w = body[at : at + size]
                    at += size
                    t = known.get(w)
                    if t is None:
                        t = known[w] = tuple(enc.encode_single_piece(w))
                    ids.extend(t)
                    sizes.append(len(t))
                payload.append(pack(mark, np.array(sizes, np.int64), np.array(ids, np.int64)))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), b.column(3), pa.array(payload, pa.binary())], schema=_WIRE_PA)

    return run


def _assemble(schema: pa.Schema):
    """Block side: dictionaries first (sorted by kind), then documents by position."""

    def dictionary(parts: dict[int, list], mark: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        size, begin = np.zeros(len(owner), np.int64), np.zeros(len(owner), np.int64)
        flat, order = [], np.argsort(owner, kind="stable")
        cuts = K.groups(owner[order])
        for lo, hi in zip(cuts, np.append(cuts[1:], len(owner))):
            theirs, s, ids = parts.pop(int(owner[order[lo]]), (None, (), ()))
            if theirs is None or theirs[0] != mark[0] or len(s) != hi - lo:
                raise ValueError("the words and the positions of a block come from different rows")
            size[order[lo:hi]] = s
            flat.append(ids)
        begin[order] = np.cumsum(size[order]) - size[order]
        return (np.concatenate(flat) if flat else np.zeros(0, np.int64)).astype(np.int32), begin, size

    def run(batches):
        now, parts, table = None, {}, None
        for b in batches:
            for block, kind, seq, blob in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist(), b.column(4)):
                if block != now:
                    now, parts, table = block, {}, None
                got = unpack(blob.as_py())
                if kind == 0:
                    parts[seq] = got
                elif kind == 1:
                    table = dictionary(parts, *got)
                else:
                    carried, counts, seqs = pa.ipc.open_stream(got[0]).read_next_batch(), got[1] - 1, got[2]
                    ids, begin, size = table
                    tokens = _ragged(ids, begin[seqs], size[seqs])
                    per_word = np.concatenate([[0], np.cumsum(size[seqs])])
                    ends = np.concatenate([[0], np.cumsum(np.maximum(counts, 0))])
                    offs = per_word[ends]
                    # lists are limited to 2**31 values a batch
                    if len(tokens) >= 1 << 31:
                        raise ValueError("a single step holds 2**31 tokens")
                    # a null list is marked by a null offset
                    lists = pa.ListArray.from_arrays(pa.array(offs.astype(np.int32), mask=np.append(counts < 0, False)), pa.array(tokens))
                    yield pa.RecordBatch.from_arrays([*carried.columns, lists, pa.array(np.diff(offs).astype(np.int64))], schema=schema)

    return run


def _arrow_schema(spark_schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(spark_schema)


def _encoded(docs: DataFrame, text: str, keep: tuple[str, ...], vocabulary: str | None, owners: int | None, block_chars: int) -> tuple[DataFrame, T.StructType]:
    """What blocks are assembled from, and the schema of encoded documents."""
    spark = attach(docs.sparkSession)
    path = vocab.locate(vocabulary, vocab.BYTE_RANKS)
    if {"token_ids", "n_tokens"} & set(keep):
        raise ValueError("keep columns may not be named token_ids or n_tokens")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    src = stable(docs.select(*[docs[c].alias(f"c{i}") for i, c in enumerate(keep)], docs[text].alias("text")), "texts")
    owners = owners or max(parts, min(MAX_OWNERS, size_of(src) // OWNER_BYTES))
    words, places = (src.mapInArrow(K.tidy(_split(len(keep), list(range(len(keep))), owners, block_chars, w)), _WIRE) for w in (True, False))
    ids = words.repartition(parts, "route").sortWithinPartitions("route").mapInArrow(K.tidy(_encode_words(path)), _WIRE)
    wire = places.unionByName(ids).repartition(parts, "block").sortWithinPartitions("block", "kind", "seq")
    out = T.StructType([*[T.StructField(c, docs.schema[c].dataType) for c in keep], T.StructField("token_ids", T.ArrayType(T.IntegerType(), False)), T.StructField("n_tokens", T.LongType())])
    return wire, out


def encode(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), vocabulary: str | None = None, owners: int | None = None, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """``keep`` columns plus ``token_ids ARRAY<INT>`` and ``n_tokens BIGINT``.

    ``vocabulary``: a rank file or the folder that has it. ``owners`` of words:
    by default as many as the size of the input asks for.
    """
    wire, out = _encoded(docs, text, keep, vocabulary, owners, block_chars)
    return wire.mapInArrow(K.tidy(_assemble(_arrow_schema(out))), out)


def token_table(spark: SparkSession, vocabulary: str | None = None) -> DataFrame:
    """The token-byte table: ``token_id INT, bytes BINARY`` (as many rows as the vocabulary file)."""
    rows = sorted((i, b) for b, i in vocab.ranks(vocab.locate(vocabulary, vocab.BYTE_RANKS)).items())
    return spark.createDataFrame(pa.table({"token_id": pa.array([i for i, _ in rows], pa.int32()), "bytes": pa.array([b for _, b in rows], pa.binary())}))


def _explode(pack_tokens: int, ids_at: int):
    """Packs of documents -> a row ``head`` with the pack, then a row for each distinct id."""

    def rows(parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = pa.Table.from_batches(parts).combine_chunks().to_batches()[0]
        flat = whole.column(ids_at).flatten()
        ids = np.unique(flat.drop_null().to_numpy(zero_copy_only=False)).astype(np.int32)
        yield pa.RecordBatch.from_arrays([pa.array([_ipc(whole)], pa.binary()), pa.array([len(ids)], pa.int32())], names=["head", "id"])
        for lo in range(0, len(ids), 100_000):
            part = ids[lo : lo + 100_000]
            yield pa.RecordBatch.from_arrays([pa.nulls(len(part), pa.binary()), pa.array(part)], names=["head", "id"])

    def run(batches):
        held: list[pa.RecordBatch] = []
        n = 0
        for b in batches:
            size = np.cumsum(pa.compute.fill_null(pa.compute.list_value_length(b.column(ids_at)), 0).to_numpy(zero_copy_only=False))
            lo = 0
            while lo < b.num_rows:
                before = int(size[lo - 1]) if lo else 0
                hi = min(b.num_rows, max(lo + 1, int(np.searchsorted(size, before + pack_tokens - n, "right"))))
                held.append(b.slice(lo, hi - lo))
                n += int(size[hi - 1]) - before
                lo = hi
                if n >= pack_tokens or lo < b.num_rows:
                    yield from rows(held)
                    held, n = [], 0
        if held:
            yield from rows(held)

    return run


def _spell(schema: pa.Schema, ids_at: int):
    """Rows ``head, id, bytes``, each pack's ids behind it in their order -> carried columns and text."""

    def texts(head: bytes, count: int, ids: np.ndarray, size: np.ndarray, body: np.ndarray) -> Iterator[pa.RecordBatch]:
        if len(ids) != count or not (ids[1:] > ids[:-1]).all():
            raise ValueError("the tokens of a pack don't come in one piece")
        whole = pa.ipc.open_stream(head).read_next_batch()
        begin = np.concatenate([[0], np.cumsum(size)])
        size = np.append(size, 0)  # what a null adds
        for lo in range(0, whole.num_rows, 1024):
            b = whole.slice(lo, 1024)
            col = b.column(ids_at)
            offs = np.zeros(b.num_rows + 1, np.int64)
            np.cumsum(pa.compute.fill_null(pa.compute.list_value_length(col), 0).to_numpy(zero_copy_only=False), out=offs[1:])
            flat = col.flatten()
            at = np.searchsorted(ids, pa.compute.fill_null(flat, 0).to_numpy(zero_copy_only=False)) if len(ids) else np.zeros(len(flat), np.int64)
            at[flat.is_null().to_numpy(zero_copy_only=False)] = len(ids)
            raw = _ragged(body, begin[at], size[at]).tobytes()
            cut = np.concatenate([[0], np.cumsum(size[at])])[offs].tolist()
            spelt = [None if z else raw[s:e].decode("utf-8", "replace") for s, e, z in zip(cut[:-1], cut[1:], col.is_null().to_numpy(zero_copy_only=False).tolist())]
            yield pa.RecordBatch.from_arrays([*b.columns[: len(schema) - 1], pa.array(spelt, pa.string())], schema=schema)

    def run(batches):
        head, count = None, 0
        ids: list[np.ndarray] = []
        size: list[np.ndarray] = []
        body: list[np.ndarray] = []

        def take(b: pa.RecordBatch) -> None:
            col = b.column(2)
            offs = np.frombuffer(col.buffers()[1], np.int32, len(col) + 1, 4 * col.offset)
            ids.append(b.column(1).to_numpy())
            size.append(np.diff(offs).astype(np.int64))
            body.append(np.frombuffer(col.buffers()[2] or b"", np.uint8)[offs[0] : offs[-1]].copy())

        def give():
            yield from texts(head, count, *(np.concatenate(x) if x else np.zeros(0, k) for x, k in ((ids, np.int32), (size, np.int64), (body, np.uint8))))

        for b in batches:
            at = np.flatnonzero(pa.compute.is_valid(b.column(0)).to_numpy(zero_copy_only=False)).tolist()
            lo = 0
            for i in [*at, b.num_rows]:
                if i > lo:
                    take(b.slice(lo, i - lo))
                if i < b.num_rows:
                    if head is not None:
                        yield from give()
                    head, count = b.column(0)[i].as_py(), b.column(1)[i].as_py()
                    for x in (ids, size, body):
                        x.clear()
                lo = i + 1
        if head is not None:
            yield from give()

    return run


def decode(encoded: DataFrame, ids: str = "token_ids", keep: tuple[str, ...] | None = None, vocabulary: str | None = None, name: str = "decoded") -> DataFrame:
    """``keep`` columns (all by default) plus the text that the ids spell, by a join with the token-byte table.

    Null lists give null, empty lists the empty text; null or unknown ids add
    nothing; bytes that aren't UTF-8 become U+FFFD.
    """
    attach(encoded.sparkSession)
    keep = tuple(encoded.columns) if keep is None else tuple(keep)
    if name in keep:
        raise ValueError(f"{name} is already a column")
    # ids that aren't kept come last
    body = [encoded[c].alias(f"c{i}") for i, c in enumerate(keep)] + ([] if ids in keep else [encoded[ids].alias("ids")])
    at = keep.index(ids) if ids in keep else len(keep)
    tokens = encoded.select(*body).mapInArrow(K.tidy(_explode(PACK_TOKENS, at)), "head binary, id int")
    out = T.StructType([*[T.StructField(c, encoded.schema[c].dataType) for c in keep], T.StructField(name, T.StringType())])
    return _joined(tokens, vocabulary).mapInArrow(K.tidy(_spell(_arrow_schema(out), at)), out)


def _joined(tokens: DataFrame, vocabulary: str | None) -> DataFrame:
    """Rows ``head, id`` with the bytes of the ids."""
    table = F.broadcast(token_table(tokens.sparkSession, vocabulary))
    return tokens.join(table, F.col("head").isNull() & (F.col("id") == F.col("token_id")), "left").select("head", "id", "bytes")


def round_trip(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), vocabulary: str | None = None, name: str = "decoded") -> DataFrame:
    """``decode(encode(docs))`` with one passage to Python less: blocks are packed for decoding where they are assembled."""
    wire, middle = _encoded(docs, text, keep, vocabulary, None, BLOCK_CHARS)
    if name in middle.names:
        raise ValueError(f"{name} is already a column")
    out, at = T.StructType([*middle.fields, T.StructField(name, T.StringType())]), len(keep)
    assemble, explode = _assemble(_arrow_schema(middle)), _explode(PACK_TOKENS, at)
    tokens = wire.mapInArrow(K.tidy(lambda batches: explode(assemble(batches))), "head binary, id int")
    return _joined(tokens, vocabulary).mapInArrow(K.tidy(_spell(_arrow_schema(out), at)), out)

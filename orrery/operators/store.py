"""Document stores: vectors, texts and metadata in one table, queried as DataFrames.

``DocumentStore`` is an immutable handle on a table (id, text, embedding and
metadata columns or a map). Every method returns a DataFrame, a scalar or a new
store; the snapshot a query sees is that of its DataFrame, so no retry or
over-fetch is ever needed.
"""

from __future__ import annotations

import asyncio
import warnings
from collections.abc import Callable
from dataclasses import dataclass, replace
from functools import reduce
from typing import Any

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orrery.errors import IntegrityError, OrreryError, UnsupportedModeError
from orrery.functions import filters as W
from orrery.functions import vectors as V
from orrery.operators import mutate as M
from orrery.operators import search as S
from orrery.operators.encode import encode, validate
from orrery.plans import quantizer as Q
from orrery.sources import snapshot as P


@dataclass(frozen=True)
class DocumentStore:
    """``model`` None searches the vectors exactly; otherwise the codes of the model."""

    table: DataFrame
    key: str = "id"
    text: str = "text"
    embedding: str = "embedding"
    metadata: str | None = None
    cosine: bool = True
    model: Q.Model | None = None

    # reading

    @property
    def fields(self) -> W.Fields:
        return W.Fields.of(self.table, self.metadata)

    def predicate(self, where: Any) -> Column:
        """A Column, an equality dict, a ``Filters`` group, a filter tree, or None; a list of conditions is ignored, with a warning."""
        if isinstance(where, list):
            warnings.warn("filters given as a list are ignored", stacklevel=2)
        if where is None or isinstance(where, list):
            return F.lit(True)
        if isinstance(where, Column):
            return F.coalesce(where, F.lit(False))
        if isinstance(where, W.Filters):
            return where.compile(self.fields)
        if isinstance(where, dict):
            return W.tree(self.fields, where) if "operator" in where or not where else W.matches(self.fields, where)
        if callable(where):  # slow: a Python call a row
            return F.udf(lambda *a: bool(where(*a)), T.BooleanType())(F.struct(*[F.col(c) for c in self.table.columns if c != self.embedding]))
        raise OrreryError("a filter is a Column, a dict, Filters or a function")

    def count(self, where: Any = None) -> DataFrame:
        return self.table.where(self.predicate(where)).agg(F.count(F.lit(1)).alias("n"))

    def filter(self, where: Any = None) -> DataFrame:
        return self.table.where(self.predicate(where))

    def get(self, ids: list, in_order: bool = True) -> DataFrame:
        """Rows of the ids, unknown ones left out; in the order asked for, with ``pos``."""
        spark = self.table.sparkSession
        kind = self.table.schema[self.key].dataType
        want = spark.createDataFrame(list(enumerate(ids)), T.StructType([T.StructField("pos", T.IntegerType()), T.StructField("__want", kind)]))
        got = self.table.join(F.broadcast(want), self.table[self.key] == want["__want"]).drop("__want")
        return got.orderBy("pos") if in_order else got

    def exists(self, where: Any) -> bool:
        return bool(self.table.where(self.predicate(where)).limit(1).count())

    def unique_counts(self, names: list[str], where: Any = None) -> DataFrame:
        """Distinct non-null values of each field, in one pass."""
        cols = [F.count_distinct(self._field(n)).alias(n) for n in names]
        return self.table.where(self.predicate(where)).agg(*cols)

    def min_max(self, name: str) -> DataFrame:
        return self.table.agg(F.min(self._field(name)).alias("min_value"), F.max(self._field(name)).alias("max_value"))

    def unique_values(self, name: str, content: str | None = None) -> DataFrame:
        """``values`` (sorted strings) and ``n``; optionally of documents whose text holds ``content`` in any case."""
        rows = self.table
        if content:
            rows = rows.where(F.coalesce(F.lower(self.text).contains(content.lower()), F.lit(False)))
        values = F.sort_array(F.collect_set(self._field(name).cast("string")))
        return rows.agg(values.alias("values")).select("values", F.size("values").alias("n"))

    def fields_info(self, names: list[str] | None = None) -> dict[str, str]:
        """boolean, int, float or keyword of each field."""

        def name_of(t: T.DataType) -> str:
            if isinstance(t, T.BooleanType):
                return "boolean"
            if isinstance(t, (T.IntegralType)):
                return "int"
            return "float" if isinstance(t, T.NumericType) else "keyword"

        return {n: name_of(self.fields.get(n)[1]) for n in names or [c for c in self.table.columns if c not in (self.key, self.text, self.embedding)]}

    def _field(self, name: str) -> Column:
        got = self.fields.get(name)
        return got[0] if got else F.lit(None).cast("string")

    # searching

    def hits(self, queries: DataFrame, k: int, where: Any = None, ids: DataFrame | None = None, query_key: str = "query_id") -> DataFrame:
        """``query_id, rank, id, score``; filter and ids (all of which must be there) apply together, before the ranking."""
        mask = None if where is None else self.predicate(where)
        if self.model is None:
            return S.exact_topk(self.table, queries, k, None, self.cosine, self.key, self.embedding, query_key, mask=mask, allowlist=ids)
        rows = S.allowed(self.table, self.key, mask, ids)
        if self.cosine:
            rows = rows.withColumn(self.embedding, V.normalize(F.col(self.embedding)))
        codes = encode(rows, self.model, self.embedding, (self.key,))
        return S.quantized_topk(codes, self.model, queries, k, self.cosine, self.key, query_key)

    def narrowed(self, where: Any = None, node_ids: list | None = None, doc_ids: list | None = None, reference: str = "ref_doc_id") -> Any:
        """A filter with sets of ids and of source documents; None and empty sets restrict nothing, unknown ids match nothing."""
        parts = [] if where is None else [self.predicate(where)]
        parts += [F.col(self.key).isin(list(node_ids))] if node_ids else []
        parts += [F.coalesce(F.col(reference).isin(list(doc_ids)), F.lit(False))] if doc_ids else []
        return reduce(lambda a, b: a & b, parts) if parts else None

    def search(self, queries: DataFrame, k: int = 4, where: Any = None, ids: DataFrame | None = None, threshold: float | None = None, node_ids: list | None = None, doc_ids: list | None = None, reference: str = "ref_doc_id") -> DataFrame:
        """Hits with their documents; ``threshold`` on the similarity in [0, 1]; ``node_ids`` and ``doc_ids`` as in ``narrowed``."""
        hits = self.hits(queries, k, self.narrowed(where, node_ids, doc_ids, reference), ids)
        if threshold is not None:
            hits = hits.where((V.similarity_cosine if self.cosine else V.similarity_inner)(F.col("score")) >= threshold)
        docs = self.table.drop(self.embedding).withColumnRenamed(self.key, "__id")
        return hits.join(docs, hits["id"] == docs["__id"]).drop("__id")

    def search_with_relevance(self, queries: DataFrame, k: int = 4, where: Any = None) -> DataFrame:
        out = self.search(queries, k, where)
        return out.withColumn("relevance", (V.relevance_cosine if self.cosine else V.relevance_dot)(F.col("score")))

    def retrieve(self, queries: DataFrame, top_k: int = 10, where: Any = None, scale_score: bool = True) -> DataFrame:
        out = self.search(queries, top_k, where)
        return out.withColumn("score", V.scale_score(F.col("score"), self.cosine)) if scale_score else out

    def search_distinct(self, queries: DataFrame, limit: int = 5, where: Any = None, reranker: Callable | None = None) -> DataFrame:
        """The first of each content among the hits (fewer than ``limit`` may be left); a reranker maps each query's rows."""
        out = self.search(queries, limit, where)
        if reranker is not None:
            out = out.groupBy("query_id").applyInPandas(reranker, out.schema)
        w = Window.partitionBy("query_id", F.md5(F.coalesce(self.text, F.lit("")))).orderBy("rank")
        return out.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r")

    def max_marginal_relevance(self, *_: Any, **__: Any) -> DataFrame:
        raise UnsupportedModeError("maximal marginal relevance isn't offered; vector search only")

    def search_mode(self, mode: str, queries: DataFrame, k: int = 4) -> DataFrame:
        if mode not in ("default", "vector"):
            raise UnsupportedModeError(f"search mode {mode} isn't offered; vector search only")
        return self.search(queries, k)

    # changing: each returns a new store

    def _with(self, table: DataFrame) -> "DocumentStore":
        return replace(self, table=table)

    def add(self, batch: DataFrame, policy: str = M.KEEP_LAST) -> "DocumentStore":
        """Upsert; duplicates in the batch by ``policy`` (KEEP_ALL appends)."""
        if policy == M.KEEP_ALL:
            return self._with(M.append(self.table, batch))
        return self._with(M.upsert(self.table, batch, self.key, "pos", policy))

    def write(self, batch: DataFrame, policy: str = M.NONE) -> tuple["DocumentStore", int]:
        table, n = M.write_documents(self.table, batch, policy, self.key)
        return self._with(table), n

    def delete(self, ids: DataFrame | None) -> "DocumentStore":
        return self if ids is None else self._with(M.remove(self.table, ids, self.key))

    def delete_where(self, where: Any) -> "DocumentStore":
        """Rows that match go; None changes nothing, an empty dict drops all."""
        return self if where is None else self._with(self.table.where(~self.predicate(where)))

    def delete_named(self, value: str | None, column: str = "name") -> "DocumentStore":
        """All rows of a name (or content id); None changes nothing, so rows without one stay."""
        return self if value is None else self._with(self.table.where(~F.coalesce(F.col(column) == value, F.lit(False))))

    def upsert_content(self, batch: DataFrame, content_hash: str, column: str = "content_hash") -> "DocumentStore":
        """The rows stored under a content hash are replaced by the batch, whatever its ids."""
        kept = self.table.where(~F.coalesce(F.col(column) == content_hash, F.lit(False)))
        return self._with(M.append(kept, batch.withColumn(column, F.lit(content_hash))))

    def add_texts(self, texts: DataFrame, embedder: Callable, dim: int) -> "DocumentStore":
        """Texts with their metadata, embedded and upserted; rows without an id get one made of their content and place."""
        made = F.md5(F.concat_ws("_", F.col(self.text), F.col("pos").cast("string")))
        ids = F.coalesce(F.col(self.key), made) if self.key in texts.columns else made
        batch = self.embed(texts.withColumn(self.key, ids), embedder, dim)
        return self.add(batch.select(*[F.col(f.name).cast(f.dataType) if f.name in batch.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in self.table.schema], "pos"))

    def save(self, root: str, expected: int | None = None) -> int:
        """Table, model and settings as one version."""
        extra = {k: getattr(self, k) for k in ("key", "text", "embedding", "metadata", "cosine")}
        return P.save(self.table, root, self.key, self.model, expected, {"store": extra})

    @classmethod
    def load(cls, spark: SparkSession, root: str, version: int | None = None, check: bool = True) -> "DocumentStore":
        """A saved store; ``check`` as in ``snapshot.load``. A table that wasn't saved as a store is an error."""
        m = P.manifest(spark, root, version)
        if "store" not in m.extra:
            raise IntegrityError(f"{root} isn't a document store")
        return cls(P.load(spark, root, m.version, check), model=P.load_model(spark, root, m.version), **m.extra["store"])

    def prepare(self) -> "DocumentStore":
        """The same store with its table in memory (spilling to disk), so that the first search costs what later ones do."""
        table = self.table.persist(StorageLevel.MEMORY_AND_DISK)
        table.count()
        return self._with(table)

    def info(self) -> dict[str, Any]:
        """Rows, dimensions, and how vectors are held."""
        first = self.table.select(F.size(self.embedding).alias("d")).where("d > 0").limit(1).collect() if self.embedding in self.table.columns else []
        return {"rows": self.table.count(), "dim": first[0]["d"] if first else None, "bits": self.model.bits if self.model else None, "state": self.model.state if self.model else "exact"}

    def ids(self) -> DataFrame:
        return self.table.select(self.key)

    def delete_reference(self, ref: str | None, column: str = "ref_doc_id") -> "DocumentStore":
        """All nodes of a source document; nodes without one go by the name "None"."""
        return self._with(self.table.where(F.coalesce(F.col(column).cast("string"), F.lit("None")) != str(ref)))

    def clear(self) -> "DocumentStore":
        return self._with(self.table.where(F.lit(False)))

    def update_where(self, where: Any, new: dict[str, str]) -> "DocumentStore":
        """Metadata entries merged into the matching rows (map column)."""
        if not self.metadata:
            raise OrreryError("the store has no metadata map")
        entries = F.create_map(*[F.lit(x) for kv in new.items() for x in kv])
        return self._with(M.update_metadata(self.table, self.predicate(where), entries, self.metadata))

    def embed(self, texts: DataFrame, embedder: Callable, dim: int) -> DataFrame:
        """``embedding`` from a function over pandas Series of texts, its vectors' sizes checked."""
        fn = F.pandas_udf(embedder, T.ArrayType(T.FloatType()))
        out = texts.withColumn(self.embedding, fn(F.col(self.text)))
        validate(out, dim, self.embedding)
        return out

    async def asearch(self, *args: Any, **kw: Any) -> list:
        """``search`` collected off the event loop."""
        return await self.off_loop(lambda: self.search(*args, **kw).collect())

    async def aget(self, ids: list) -> list:
        return await self.off_loop(lambda: self.get(ids).collect())

    async def asave(self, root: str, expected: int | None = None) -> int:
        return await self.off_loop(self.save, root, expected)

    async def aadd(self, batch: DataFrame, policy: str = M.KEEP_LAST) -> "DocumentStore":
        return await self.off_loop(self.add, batch, policy)

    @staticmethod
    async def off_loop(f: Callable, *args: Any) -> Any:
        """Any method of a store, on a thread of its own."""
        return await asyncio.to_thread(f, *args)

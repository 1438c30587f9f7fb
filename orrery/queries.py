"""Registered queries of the vector engine over the driver's tables, each beside its DuckDB statement."""

from __future__ import annotations

import hashlib
import uuid
import warnings
from collections.abc import Callable
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.functions import filters as W
from orrery.functions import vectors as V
from orrery.operators import encode as E
from orrery.operators import mutate as M
from orrery.operators import search as S
from orrery.operators.store import DocumentStore
from orrery.plans import quantizer as Q
from orrery.runtime import read_table, scratch_dir
from orrery.sources import snapshot as P
from orrery.streaming import ingest as I

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}
DIM = 64


def register(sql: str | None = None, name: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name or f.__name__] = f
        if sql:
            ORACLE_SQL[name or f.__name__] = sql
        return f

    return add


# inputs


def vectors(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding", "label")


def scaled(spark: SparkSession, d: str) -> DataFrame:
    """Lengths that differ, so that cosine and inner product rank apart."""
    return vectors(spark, d).withColumn("embedding", V.scaled(F.col("embedding"), (F.col("label") + 1).cast("double")))


def asked(spark: SparkSession, d: str) -> DataFrame:
    """Every row is a query."""
    return vectors(spark, d).select(F.col("id").alias("query_id"), "embedding")


def shown(hits: DataFrame, *more: str) -> DataFrame:
    return hits.select("query_id", "rank", "id", F.round("score", 6).alias("score"), *more)


def topk_sql(candidates: str = "SELECT vec_id AS id, embedding::DOUBLE[] AS v, label FROM embeddings", score: str = "list_inner_product(q.v, x.v)", k: int = 10, where: str = "", out: str = "round(score, 6) AS score", extra: str = "") -> str:
    return f"""
WITH x AS ({candidates}),
q AS (SELECT vec_id AS query_id, embedding::DOUBLE[] AS v FROM embeddings),
s AS (SELECT query_id, id, round({score}, 12) AS score FROM q CROSS JOIN x {where}),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id)::INT AS rank FROM s)
SELECT query_id, rank, id, {out} FROM r WHERE rank <= {k} {extra}"""


_SCALED = "SELECT vec_id AS id, list_transform(embedding::DOUBLE[], lambda e: e * (label + 1)::DOUBLE) AS v, label FROM embeddings"
_COS = "list_inner_product(q.v, x.v) / sqrt(list_inner_product(q.v, q.v)) / sqrt(list_inner_product(x.v, x.v))"


# exact search


@register(topk_sql())
def exact_topk(spark, d):
    return shown(S.exact_topk(vectors(spark, d), asked(spark, d), 10))


@register(topk_sql(_SCALED, _COS))
def exact_topk_cosine_scaled(spark, d):
    return shown(S.exact_topk(scaled(spark, d), asked(spark, d), 10, cosine=True))


@register(topk_sql(_SCALED))
def exact_topk_dot_scaled(spark, d):
    return shown(S.exact_topk(scaled(spark, d), asked(spark, d), 10))


@register(topk_sql(where="WHERE x.label IN (1, 4, 7)"))
def topk_mask_label(spark, d):
    return shown(S.exact_topk(vectors(spark, d), asked(spark, d), 10, mask=F.col("label").isin(1, 4, 7)))


@register(topk_sql(where="WHERE x.id IN (3, 5, 8, 13, 21, 34, 55, 89, 144)", k=5))
def topk_allowlist_dedup(spark, d):
    allow = spark.createDataFrame([(i,) for i in (3, 5, 8, 13, 21, 34, 55, 89, 144, 3, 5, 5)], "id long")
    return shown(S.exact_topk(vectors(spark, d), asked(spark, d), 5, allowlist=allow))


@register(topk_sql(where="WHERE x.id IN (1, 2, 4, 8, 16, 32, 64)", k=50))
def topk_k_exceeds_n(spark, d):
    allow = spark.createDataFrame([(1 << i,) for i in range(7)], "id long")
    return shown(S.exact_topk(vectors(spark, d), asked(spark, d), 50, allowlist=allow))


@register(topk_sql(where="WHERE false"))
def topk_no_candidates(spark, d):
    return shown(S.exact_topk(vectors(spark, d), asked(spark, d), 10, mask=F.lit(False)))


@register(topk_sql(_SCALED, _COS, extra="AND least(1, greatest(0, score)) >= 0.3"))
def topk_threshold_cosine(spark, d):
    hits = DocumentStore(scaled(spark, d), text="label").hits(asked(spark, d), 10)
    return shown(hits.where(V.similarity_cosine(F.col("score")) >= 0.3))


@register(topk_sql(_SCALED, extra="AND least(1, greatest(0, (score + 1) / 2)) >= 0.9"))
def topk_threshold_inner(spark, d):
    hits = DocumentStore(scaled(spark, d), text="label", cosine=False).hits(asked(spark, d), 10)
    return shown(hits.where(V.similarity_inner(F.col("score")) >= 0.9))


@register(topk_sql(_SCALED, _COS, k=4, out="round(least(1, greatest(0, (score + 1) / 2)), 6) AS relevance"))
def relevance_cosine(spark, d):
    hits = DocumentStore(scaled(spark, d), text="label").hits(asked(spark, d), 4)
    return hits.select("query_id", "rank", "id", F.round(V.relevance_cosine(F.col("score")), 6).alias("relevance"))


@register(topk_sql(_SCALED, k=4, out="round((score + 1) / 2, 6) AS relevance"))
def relevance_dot(spark, d):
    hits = DocumentStore(scaled(spark, d), text="label", cosine=False).hits(asked(spark, d), 4)
    return hits.select("query_id", "rank", "id", F.round(V.relevance_dot(F.col("score")), 6).alias("relevance"))


@register(topk_sql(_SCALED, out="round(1 / (1 + exp(-score / 100)), 6) AS score"))
def scale_score_sigmoid(spark, d):
    hits = DocumentStore(scaled(spark, d), text="label", cosine=False).hits(asked(spark, d), 10)
    return shown(hits.withColumn("score", V.scale_score(F.col("score"), False)))


@register(topk_sql(_SCALED, _COS, out="round((least(1, greatest(-1, score)) + 1) / 2, 6) AS score"))
def scale_score_cosine(spark, d):
    hits = DocumentStore(scaled(spark, d), text="label").hits(asked(spark, d), 10)
    return shown(hits.withColumn("score", V.scale_score(F.col("score"), True)))


@register("SELECT vec_id AS id, round(sqrt(list_inner_product(v, v)), 6) AS norm, round(list_sum(list_transform(v, lambda e: abs(e) / sqrt(list_inner_product(v, v)))), 6) AS l1 FROM (SELECT vec_id, list_transform(embedding::DOUBLE[], lambda e: e * (label + 1)::DOUBLE) AS v FROM embeddings)")
def norms(spark, d):
    v, n = F.col("embedding"), V.normalize(F.col("embedding"))
    return scaled(spark, d).select("id", F.round(V.norm(v), 6).alias("norm"), F.round(F.aggregate(n, F.lit(0.0), lambda a, x: a + F.abs(x)), 6).alias("l1"))


_BAD = "SELECT vec_id AS id, list_transform(range(1, 65), lambda i: CASE WHEN vec_id = 7 AND i = 4 THEN 'nan'::DOUBLE WHEN vec_id = 5 AND i = 10 THEN 1e16 WHEN vec_id = 5 AND i = 12 THEN 'inf'::DOUBLE ELSE embedding[i]::DOUBLE END) AS v FROM embeddings"


@register(f"SELECT id AS row_key, (i - 1)::INT AS coord FROM (SELECT id, unnest(range(1, 65)) AS i, unnest(v) AS e FROM ({_BAD})) WHERE isnan(e) OR NOT abs(e) < 1e16 ORDER BY 1, 2 LIMIT 1")
def validate_first_bad(spark, d):
    worse = F.transform(
        F.col("embedding").cast("array<double>"),
        lambda x, i: F.when((F.col("id") == 7) & (i == 3), float("nan")).when((F.col("id") == 5) & (i == 9), 1e16).when((F.col("id") == 5) & (i == 11), float("inf")).otherwise(x),
    )
    return E.first_invalid(vectors(spark, d).withColumn("embedding", worse), F.col("id"))


# codes


def _list(a: np.ndarray) -> str:
    return "[" + ", ".join(_list(x) if getattr(x, "ndim", 0) else repr(float(x)) + "::DOUBLE" for x in a) + "]"


def _rotated_sql() -> str:
    return f"""
m AS (SELECT {_list(Q.rotation_matrix(DIM))} AS r),
e AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v, sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS nrm FROM embeddings),
u AS (SELECT id, v, nrm, list_transform(m.r, lambda x: list_inner_product(x, v) / nrm) AS u FROM e, m)"""


def _coded_sql(bits: int, calibrated: bool = False) -> str:
    """CTEs up to ``c(id, code, scale)`` and ``k(b, c, sh, s)``."""
    b, c = Q.codebook(bits, DIM)
    if calibrated:
        pair = f"{_calibration_sql(bits)}, k AS (SELECT {_list(b)} AS b, {_list(c)} AS c, list(shift ORDER BY coord) AS sh, list(scale ORDER BY coord) AS s FROM cal)"
    else:
        pair = f", k AS (SELECT {_list(b)} AS b, {_list(c)} AS c, list_transform(range({DIM}), lambda i: 0.0::DOUBLE) AS sh, list_transform(range({DIM}), lambda i: 1.0::DOUBLE) AS s)"
    return f"""{_rotated_sql()}{pair},
c0 AS (SELECT id, nrm, u, list_transform(range(1, {DIM + 1}), lambda i: list_sum(list_transform(k.b, lambda x: CASE WHEN (u[i] + k.sh[i]) * k.s[i] > x THEN 1 ELSE 0 END))::INT) AS code FROM u, k),
c1 AS (SELECT id, nrm, code, list_inner_product(u, list_transform(range(1, {DIM + 1}), lambda i: k.c[code[i] + 1] / k.s[i] - k.sh[i])) AS ip FROM c0, k),
c AS (SELECT id, code, CASE WHEN ip > 0.1 THEN nrm / ip ELSE 0 END AS scale FROM c1)"""


def _calibration_sql(bits: int) -> str:
    p_lo, p_hi, outer = Q.anchor(bits, DIM)
    return f""",
f AS (SELECT unnest(range({DIM}))::INT AS coord, unnest(u) AS x FROM u),
g AS (SELECT *, row_number() OVER (PARTITION BY coord ORDER BY x) - 1 AS r, count(*) OVER (PARTITION BY coord) AS n FROM f),
h AS (
  SELECT coord, max(CASE WHEN r = floor(n * {p_lo!r}) THEN x END) AS a,
    max(CASE WHEN r = greatest(least(floor(n * {p_hi!r}), n - 1), floor(n * {p_lo!r}) + 1) THEN x END) AS b
  FROM g GROUP BY coord),
cal AS (SELECT coord, CASE WHEN b - a > 1e-6 THEN {-outer!r} / ({2 * outer!r} / (b - a)) - a ELSE 0 END AS shift, CASE WHEN b - a > 1e-6 THEN {2 * outer!r} / (b - a) ELSE 1 END AS scale FROM h)"""


_HEX = "array_to_string(list_transform(code, lambda x: '0' || substr('0123456789ABCDEF', x + 1, 1)), '')"


def _codes_shown(codes: DataFrame) -> DataFrame:
    return codes.select("id", F.hex("code").alias("code"), F.round("scale", 6).alias("scale"))


def model(bits: int) -> Q.Model:
    return Q.Model(DIM, bits)


def calibrated(spark: SparkSession, d: str, bits: int) -> Q.Model:
    return E.calibrate(vectors(spark, d), model(bits))


def _quant_sql(bits: int, cal: bool = False) -> str:
    return f"""
WITH {_coded_sql(bits, cal)},
q AS (SELECT id AS query_id, list_transform(u, lambda x: x * nrm) AS rq FROM u),
s AS (
  SELECT query_id, c.id, round(c.scale * (list_inner_product(list_transform(range(1, {DIM + 1}), lambda i: rq[i] / k.s[i]), list_transform(c.code, lambda x: k.c[x + 1])) - list_inner_product(rq, k.sh)), 12) AS score
  FROM q, c, k),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id)::INT AS rank FROM s)"""


_QUANT_OUT = "SELECT query_id, rank, id, round(score, 6) AS score FROM r WHERE rank <= 10"


def _recall_sql(bits: int, cal: bool, out: str) -> str:
    body = topk_sql().split("SELECT query_id, rank, id,")[0].replace("WITH x AS", "x_ AS").replace(" CROSS JOIN x ", " CROSS JOIN x_ x ").replace("\nq AS", "\nq_ AS").replace("FROM q CROSS", "FROM q_ q CROSS").replace("\ns AS", "\ns_ AS").replace("FROM s)", "FROM s_)").replace("\nr AS", "\nr_ AS")
    return f"{_quant_sql(bits, cal)},\n{body}\n{out}"


@register(f"WITH {_rotated_sql()} SELECT id, list_transform(u, lambda x: round(x, 6) + 0.0) AS rotated FROM u")
def rotated_vectors(spark, d):
    return E.rotated(vectors(spark, d), DIM).select("id", F.transform("rotated", lambda x: F.round(x, 6) + 0.0).alias("rotated"))


def _per_bits(bits: int) -> None:
    coded = f"WITH {_coded_sql(bits)} SELECT id, {_HEX} AS code, round(scale, 6) AS scale FROM c"

    @register(coded, f"encode_{bits}bit")
    def encode(spark, d):
        return _codes_shown(E.encode(vectors(spark, d), model(bits)))

    @register(coded, f"pack_unpack_{bits}bit")
    def pack_unpack(spark, d):
        m = model(bits)
        return _codes_shown(E.unpack(E.encode(vectors(spark, d), m, packed=True), m))

    @register(_quant_sql(bits) + _QUANT_OUT, f"quant_topk_{bits}bit")
    def quant_topk(spark, d):
        m = model(bits)
        return shown(S.quantized_topk(E.encode(vectors(spark, d), m, packed=True), m, asked(spark, d), 10, packed=True))

    @register(_recall_sql(bits, False, "SELECT avg(CASE WHEN EXISTS (SELECT 1 FROM r WHERE r.query_id = r_.query_id AND r.id = r_.id AND r.rank <= 4) THEN 1.0 ELSE 0.0 END)::DOUBLE AS recall FROM r_ WHERE rank = 1"), f"recall_1_at_4_{bits}bit")
    def recall(spark, d):
        m = model(bits)
        found = S.quantized_topk(E.encode(vectors(spark, d), m), m, asked(spark, d), 10)
        return S.recall_at(S.exact_topk(vectors(spark, d), asked(spark, d), 10), found, 4)

    @register(_recall_sql(bits, False, "SELECT count(r.id)::DOUBLE / count(*) AS overlap FROM r_ LEFT JOIN (SELECT * FROM r WHERE rank <= 10) r ON r.query_id = r_.query_id AND r.id = r_.id WHERE r_.rank <= 10"), f"recall_overlap_{bits}bit")
    def overlap(spark, d):
        m = model(bits)
        found = S.quantized_topk(E.encode(vectors(spark, d), m), m, asked(spark, d), 10)
        return S.overlap_at(S.exact_topk(vectors(spark, d), asked(spark, d), 10), found, 10)

    @register(f"WITH {_rotated_sql()}{_calibration_sql(bits)} SELECT coord, round(shift, 6) AS shift, round(scale, 6) AS scale FROM cal", f"calibration_fit_{bits}bit")
    def calibration_fit(spark, d):
        return E.calibration_table(vectors(spark, d), DIM, bits).select("coord", F.round("shift", 6).alias("shift"), F.round("scale", 6).alias("scale"))

    @register(f"WITH {_coded_sql(bits, True)} SELECT id, {_HEX} AS code, round(scale, 6) AS scale FROM c", f"encode_calibrated_{bits}bit")
    def encode_calibrated(spark, d):
        return _codes_shown(E.encode(vectors(spark, d), calibrated(spark, d, bits)))

    @register(_quant_sql(bits, True) + _QUANT_OUT, f"quant_topk_calibrated_{bits}bit")
    def quant_topk_calibrated(spark, d):
        m = calibrated(spark, d, bits)
        return shown(S.quantized_topk(E.encode(vectors(spark, d), m), m, asked(spark, d), 10))

    _, cents = Q.codebook(bits, DIM)
    edges = Q.codebook(bits, DIM)[0]

    @register(
        f"""WITH {_coded_sql(bits, True)},
x AS (SELECT id, scale, list_transform(code, lambda i: {_list(cents)}[i + 1]) AS x FROM (
  SELECT o.id, o.code, o.scale FROM (
    SELECT u.id, nrm, u, list_transform(u, lambda y: list_sum(list_transform({_list(edges)}, lambda b: CASE WHEN y > b THEN 1 ELSE 0 END))::INT) AS code FROM u) z
  JOIN (SELECT id, code, CASE WHEN list_inner_product(u, list_transform(code, lambda i: {_list(cents)}[i + 1])) > 0.1 THEN nrm / list_inner_product(u, list_transform(code, lambda i: {_list(cents)}[i + 1])) ELSE 0 END AS scale FROM (
    SELECT u.id, nrm, u, list_transform(u, lambda y: list_sum(list_transform({_list(edges)}, lambda b: CASE WHEN y > b THEN 1 ELSE 0 END))::INT) AS code FROM u)) o ON o.id = z.id)),
y AS (SELECT id, scale * sqrt(list_inner_product(x, x)) AS nrm2, list_transform(x, lambda a: a / sqrt(list_inner_product(x, x))) AS u2 FROM x),
d0 AS (SELECT id, nrm2, u2, list_transform(range(1, {DIM + 1}), lambda i: list_sum(list_transform(k.b, lambda b: CASE WHEN (u2[i] + k.sh[i]) * k.s[i] > b THEN 1 ELSE 0 END))::INT) AS code FROM y, k),
d1 AS (SELECT id, nrm2, code, list_inner_product(u2, list_transform(range(1, {DIM + 1}), lambda i: k.c[code[i] + 1] / k.s[i] - k.sh[i])) AS ip FROM d0, k)
SELECT id, {_HEX} AS code, round(CASE WHEN ip > 0.1 THEN nrm2 / ip ELSE 0 END, 6) AS scale FROM d1""",
        f"reencode_{bits}bit",
    )
    def reencode(spark, d):
        m = model(bits)
        return _codes_shown(E.reencode(E.encode(vectors(spark, d), m), m, calibrated(spark, d, bits)))

    @register("SELECT vec_id AS id, round(list_sum(list_transform(embedding::DOUBLE[], lambda e: e * e)) * (label + 1) * (label + 1), 4) AS score FROM embeddings", f"self_score_{bits}bit")
    def self_score(spark, d):
        """A row's score against itself is its squared length, whatever its code."""
        m = model(bits)
        v = scaled(spark, d)
        codes = E.encode(v, m, keep=("id", "embedding"))
        x = E.rotated(v, DIM).join(codes, "id")
        cents = F.array(*[F.lit(float(c)) for c in m.codebook()[1]])
        byte = F.transform(F.sequence(F.lit(1), F.lit(DIM)), lambda i: F.element_at(cents, F.conv(F.substring(F.hex(F.col("code")), i * 2 - 1, F.lit(2)), 16, 10).cast("int") + 1))
        return x.select("id", F.round(F.col("scale") * V.norm(F.col("embedding")) * V.dot(F.col("rotated"), byte), 4).alias("score"))


for _bits in (2, 3, 4):
    _per_bits(_bits)


# metadata


def library(spark: SparkSession, d: str) -> DataFrame:
    """Documents with nullable metadata and tags."""
    docs, labels = read_table(spark, d, "documents"), read_table(spark, d, "labels").withColumnRenamed("doc_id", "id")
    tags = F.when(F.col("quality").isNotNull(), F.array("lang", F.concat(F.lit("q"), F.col("quality").cast("string"))))
    return docs.join(labels, docs["doc_id"] == labels["id"], "left").select(docs["doc_id"].alias("id"), "text", "lang", "source", "n_chars", "quality", "toxic", tags.alias("tags"))


_LIB = "(SELECT doc_id AS id, text, lang, source, n_chars, quality, toxic, CASE WHEN quality IS NOT NULL THEN [lang, 'q' || quality::VARCHAR] END AS tags FROM documents LEFT JOIN labels USING (doc_id)) l"


def store(spark: SparkSession, d: str) -> DocumentStore:
    return DocumentStore(library(spark, d))


_CASES: dict[str, tuple[object, str]] = {
    "meta_eq": (W.Filters([W.Filter("quality", 1)]), "quality = 1"),
    "meta_ne_missing": (W.Filters([W.Filter("quality", 1, "!=")]), "quality IS DISTINCT FROM 1"),
    "meta_gt": (W.Filters([W.Filter("n_chars", 3000, ">")]), "n_chars > 3000"),
    "meta_lte": (W.Filters([W.Filter("quality", 0, "<=")]), "quality <= 0"),
    "meta_in": (W.Filters([W.Filter("lang", ["de", "fr"], "in")]), "lang IN ('de', 'fr')"),
    "meta_nin": (W.Filters([W.Filter("quality", [1], "nin")]), "quality IS NULL OR quality <> 1"),
    "meta_contains": (W.Filters([W.Filter("tags", "q1", "contains")]), "list_contains(tags, 'q1')"),
    "meta_text_match": (W.Filters([W.Filter("text", "The", "text_match")]), "contains(text, 'The')"),
    "meta_text_match_ci": (W.Filters([W.Filter("text", "LICENSE", "text_match_insensitive")]), "contains(lower(text), 'license')"),
    "meta_all": (W.Filters([W.Filter("tags", ["en", "q0"], "all")]), "list_has_all(tags, ['en', 'q0'])"),
    "meta_any": (W.Filters([W.Filter("tags", ["de", "q0"], "any")]), "list_has_any(tags, ['de', 'q0'])"),
    "meta_is_empty": (W.Filters([W.Filter("toxic", None, "is_empty")]), "toxic IS NULL"),
    "meta_nested_not": (W.Filters([W.Filters([W.Filter("quality", 1), W.Filter("lang", "en")], "not"), W.Filters([W.Filter("toxic", 0), W.Filter("n_chars", 100, "<")], "or")]), "NOT (coalesce(quality = 1, false) OR lang = 'en') AND (coalesce(toxic = 0, false) OR n_chars < 100)"),
    "meta_dict": ({"lang": "en", "quality": 1}, "lang = 'en' AND quality = 1"),
    "meta_tree": ({"operator": "AND", "conditions": [{"field": "meta.quality", "operator": "==", "value": None}, {"operator": "NOT", "conditions": [{"field": "lang", "operator": "==", "value": "en"}]}, {"field": "n_chars", "operator": ">=", "value": 500}]}, "quality IS NULL AND lang <> 'en' AND n_chars >= 500"),
    "meta_tree_or_in": ({"operator": "OR", "conditions": [{"field": "source", "operator": "in", "value": ["src1", "src2"]}, {"field": "toxic", "operator": "==", "value": 1}]}, "source IN ('src1', 'src2') OR toxic = 1"),
}
for _name, (_where, _sql) in _CASES.items():
    register(f"SELECT id, lang, quality FROM {_LIB} WHERE coalesce({_sql}, false)", _name)(lambda spark, d, w=_where: store(spark, d).filter(w).select("id", "lang", "quality"))


@register(f"SELECT count(*) AS n FROM {_LIB} WHERE quality = 0")
def count_by_filter(spark, d):
    return store(spark, d).count({"quality": 0})


@register(f"SELECT count(DISTINCT quality) AS quality, count(DISTINCT lang) AS lang, count(DISTINCT source) AS source FROM {_LIB} WHERE n_chars > 100")
def unique_meta_counts(spark, d):
    return store(spark, d).unique_counts(["quality", "lang", "source"], F.col("n_chars") > 100)


@register(f"SELECT min(n_chars) AS min_value, max(n_chars) AS max_value FROM {_LIB}")
def meta_min_max(spark, d):
    return store(spark, d).min_max("n_chars")


@register(f"SELECT list_sort(list_distinct(list(source::VARCHAR))) AS values, count(DISTINCT source)::INT AS n FROM {_LIB} WHERE contains(lower(text), 'license')")
def meta_unique_search(spark, d):
    return store(spark, d).unique_values("source", "License")


@register("SELECT i::INT AS pos, doc_id AS id, lang FROM (SELECT unnest([42, 7, 100000000, 13]) AS w, unnest(range(4)) AS i) JOIN documents ON doc_id = w")
def get_by_ids(spark, d):
    return store(spark, d).get([42, 7, 100000000, 13]).select("pos", "id", "lang")


@register("SELECT vec_id * 3 - 100 AS id, vec_id * 3 - 100 IN (SELECT vec_id FROM embeddings) AS found FROM embeddings")
def membership(spark, d):
    have = vectors(spark, d)
    return M.removed_flags(have, have.select((F.col("id") * 3 - 100).alias("id"))).select("id", F.col("removed").alias("found"))


# changes


def _batch(spark: SparkSession, d: str) -> DataFrame:
    """A batch in which keys repeat: keyed by the label."""
    return vectors(spark, d).select(F.col("label").cast("long").alias("id"), (F.col("id") + 100).cast("int").alias("label"), F.col("id").alias("pos"))


_BATCH = "(SELECT label::BIGINT AS id, (vec_id + 100)::INT AS label, vec_id AS pos FROM embeddings)"


@register(f"SELECT id, label, pos FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY pos DESC) AS r FROM {_BATCH}) WHERE r = 1")
def dedup_keep_last(spark, d):
    return M.resolve_duplicates(_batch(spark, d), M.KEEP_LAST)


@register(f"SELECT id, label, pos FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY pos) AS r FROM {_BATCH}) WHERE r = 1")
def dedup_keep_first(spark, d):
    return M.resolve_duplicates(_batch(spark, d), M.KEEP_FIRST)


@register(f"WITH b AS {_BATCH} SELECT vec_id AS id, label FROM embeddings WHERE vec_id NOT IN (SELECT id FROM b) UNION ALL SELECT id, label FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY pos DESC) AS r FROM b) WHERE r = 1")
def upsert(spark, d):
    return M.upsert(vectors(spark, d).select("id", "label"), _batch(spark, d))


@register("SELECT vec_id AS id, label FROM embeddings WHERE vec_id NOT IN (1, 2, 3)")
def remove_ids(spark, d):
    return M.remove(vectors(spark, d).select("id", "label"), spark.createDataFrame([(1,), (2,), (3,), (3,), (100000000,)], "id long"))


@register("SELECT vec_id AS id, label FROM embeddings UNION ALL SELECT vec_id + 1000000000, label FROM embeddings")
def add_with_ids(spark, d):
    batch = vectors(spark, d).select((F.col("id") + 1000000000).alias("id"), "label", F.col("id").alias("pos"))
    return M.add_with_ids(vectors(spark, d).select("id", "label"), batch)


@register("SELECT vec_id AS id, label FROM embeddings WHERE label >= 3 UNION ALL SELECT id, label FROM (SELECT vec_id - label AS id, label, row_number() OVER (PARTITION BY vec_id - label ORDER BY vec_id) AS r FROM embeddings) WHERE r = 1 AND id NOT IN (SELECT vec_id FROM embeddings WHERE label >= 3)")
def write_skip(spark, d):
    """A batch with repeated keys, some of which are there."""
    batch = vectors(spark, d).select((F.col("id") - F.col("label")).alias("id"), "label", F.col("id").alias("pos"))
    return M.write_documents(vectors(spark, d).where("label >= 3").select("id", "label"), batch, M.SKIP)[0]


@register("WITH s AS (SELECT vec_id AS id, row_number() OVER (ORDER BY vec_id) - 1 AS slot, count(*) OVER () - 1 AS last FROM embeddings) SELECT id, CASE WHEN slot = last THEN 3 ELSE slot END AS slot FROM s WHERE slot <> 3")
def swap_remove(spark, d):
    return M.swap_remove(M.with_slots(vectors(spark, d).select("id")), 3).select("id", F.col("slot").cast("long").alias("slot"))


def _mapped(spark: SparkSession, d: str) -> DocumentStore:
    lib = library(spark, d)
    meta = F.map_filter(F.create_map(F.lit("lang"), F.col("lang"), F.lit("quality"), F.col("quality").cast("string")), lambda k, v: v.isNotNull())
    return DocumentStore(lib.select("id", "text", meta.alias("metadata")), metadata="metadata")


@register(f"SELECT id, CASE WHEN coalesce(quality = 0, false) THEN 'xx' ELSE lang END AS lang, CASE WHEN coalesce(quality = 0, false) THEN 'yes' END AS reviewed FROM {_LIB}")
def update_meta_by_filter(spark, d):
    new = _mapped(spark, d).update_where({"quality": "0"}, {"lang": "xx", "reviewed": "yes"})
    m = F.col("metadata")
    return new.table.select("id", F.element_at(m, "lang").alias("lang"), F.element_at(m, "reviewed").alias("reviewed"))


@register(f"SELECT id, lang FROM {_LIB} WHERE NOT coalesce(quality = 0, false)")
def delete_by_filter(spark, d):
    return store(spark, d).delete_where({"quality": 0}).table.select("id", "lang")


@register(f"SELECT id FROM {_LIB} WHERE coalesce(quality::VARCHAR, 'None') <> 'None'")
def delete_reference(spark, d):
    return store(spark, d).delete_reference(None, "quality").table.select("id")


@register("SELECT doc_id AS id, md5(coalesce(lang, md5(text)) || '_' || md5(text)) AS content_id FROM documents")
def content_ids(spark, d):
    return library(spark, d).select("id", M.content_key(F.col("lang"), F.col("text"), F.md5("text")).alias("content_id"))


# document search


def _shelf(spark: SparkSession, d: str) -> DocumentStore:
    docs = library(spark, d)
    return DocumentStore(docs.join(vectors(spark, d), "id"))


_SHELF = "SELECT vec_id AS id, embedding::DOUBLE[] AS v, text, lang, quality FROM embeddings JOIN documents ON doc_id = vec_id LEFT JOIN labels USING (doc_id)"


@register(topk_sql(_SHELF, _COS, 4, "WHERE coalesce(x.quality = 1, false)"))
def search_filtered(spark, d):
    return shown(_shelf(spark, d).search(asked(spark, d), 4, {"quality": 1}))


@register(
    topk_sql(_SHELF, _COS, 10).replace("SELECT query_id, rank, id, round(score, 6) AS score FROM r WHERE rank <= 10", "SELECT query_id, rank, id, round(score, 6) AS score FROM (SELECT r.*, row_number() OVER (PARTITION BY query_id, md5(text) ORDER BY rank) AS d FROM r JOIN x USING (id) WHERE rank <= 10) WHERE d = 1")
)
def search_distinct(spark, d):
    return shown(_shelf(spark, d).search_distinct(asked(spark, d), 10))


@register(topk_sql(where="WHERE x.label IN (1, 4, 7) AND x.id % 3 = 0", k=5))
def topk_mask_and_allowlist(spark, d):
    """Ids that are there but masked don't take part."""
    v = vectors(spark, d)
    return shown(S.exact_topk(v, asked(spark, d), 5, mask=F.col("label").isin(1, 4, 7), allowlist=v.where("id % 3 = 0").select("id")))


@register(topk_sql(_SHELF.replace("quality FROM", "quality, source FROM"), _COS, 4, "WHERE x.source IN ('src1', 'src4') AND coalesce(x.quality = 1, false)"))
def search_doc_ids(spark, d):
    return shown(_shelf(spark, d).search(asked(spark, d), 4, {"quality": 1}, doc_ids=["src1", "src4", "none"], reference="source"))


@register(topk_sql(_SHELF, _COS, 6, "WHERE x.id IN (2, 3, 5, 8, 13, 21) AND x.lang = 'en'"))
def search_node_ids(spark, d):
    return shown(_shelf(spark, d).search(asked(spark, d), 6, {"lang": "en"}, node_ids=[2, 3, 5, 8, 13, 21, 100000000], doc_ids=[]))


@register(topk_sql())
def exact_topk_in_blocks(spark, d):
    """More queries than are sent with the tasks: packed blocks of rows meet packed blocks of queries."""
    v = vectors(spark, d).select("id", F.col("embedding").cast("array<double>").alias("v"))
    return shown(S.blocked_topk(v, asked(spark, d), 10, DIM, 100))


@register("SELECT vec_id AS id FROM embeddings WHERE vec_id % 7 < 4")
def codes_not_of_the_model(spark, d):
    """Codes and scales spoilt in four ways are found, the others pass."""
    codes = E.encode(vectors(spark, d), model(3))
    at = F.col("id") % 7
    worse = codes.select(
        "id",
        F.when(at == 0, F.concat(F.expr("substring(code, 1, 63)"), F.lit(b"\x08"))).when(at == 1, F.expr("substring(code, 1, 60)")).otherwise(F.col("code")).alias("code"),
        F.when(at == 2, float("nan")).when(at == 3, -1.0).otherwise(F.col("scale")).alias("scale"),
    )
    return P.bad_codes(worse, model(3)).select("id")


def _scratch(spark: SparkSession, tag: str) -> str:
    return f"{scratch_dir(spark).rstrip('/')}/orrery-{tag}-{uuid.uuid4().hex[:12]}"


@register("SELECT vec_id AS id, label FROM embeddings UNION ALL SELECT vec_id + 1000000000, label FROM embeddings WHERE label = 5")
def snapshot_after_a_crash(spark, d):
    """The newest manifest was cut off: the version before holds, and the next delta goes on from it."""
    root, table = _scratch(spark, "torn"), vectors(spark, d).select("id", "label")
    P.save(table, root)
    P.Storage(spark, root).create("manifest-00000002.json", '{"format": 1, "vers')
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        P.sync(root, added=table.where("label = 5").select((F.col("id") + 1000000000).alias("id"), "label"), check=True)
    return P.load(spark, root, check=True)


@register(ORACLE_SQL["search_filtered"])
def store_save_load(spark, d):
    root = _scratch(spark, "store")
    _shelf(spark, d).save(root, 0)
    return shown(DocumentStore.load(spark, root).search(asked(spark, d), 4, {"quality": 1}))


@register("SELECT label::VARCHAR AS name, count(*) AS n FROM embeddings WHERE label <> 2 GROUP BY label UNION ALL SELECT 'empty', 0")
def table_lifecycle(spark, d):
    """Tables created, filled, dropped and listed."""
    root, table = _scratch(spark, "tables"), vectors(spark, d).select("id", "label")
    labels = [r[0] for r in table.select("label").distinct().collect()]
    for x in labels:
        P.sync(P.create(spark, root, str(x), "id long, label int"), added=table.where(F.col("label") == x))
    P.create(spark, root, "empty", "id long, label int")
    P.create(spark, root, str(labels[0]), "id long, label int")  # there already: it stays
    P.drop(spark, root, "2")
    counts = [P.load(spark, P.table_path(root, x), check=True).agg(F.count(F.lit(1)).alias("n")).select(F.lit(x).alias("name"), "n") for x in P.names(spark, root)]
    return reduce(DataFrame.unionByName, counts)


@register(ORACLE_SQL["reencode_4bit"])
def recalibrated_table(spark, d):
    """A stored table of packed codes changes its calibration in one version."""
    root, old = _scratch(spark, "codes"), model(4)
    P.save(E.encode(vectors(spark, d), old, packed=True), root, model=old, extra={"packed": True})
    P.recalibrate(spark, root, calibrated(spark, d, 4))
    new = P.load_model(spark, root)
    return _codes_shown(E.unpack(P.load(spark, root, check=True), new))


@register(ORACLE_SQL["encode_2bit"])
def bytes_round_trip(spark, d):
    return _codes_shown(P.from_bytes(spark, P.to_bytes(spark.createDataFrame(E.encode(vectors(spark, d), model(2)).toArrow()), model(2)))[0])


_HASHED = "SELECT doc_id AS id, md5(coalesce(source, '')) AS content_hash, lang AS name FROM documents"


@register(f"SELECT id, content_hash, name FROM ({_HASHED}) WHERE content_hash <> md5('src1') UNION ALL SELECT doc_id + 1000000000, md5('src1'), lang FROM documents WHERE source = 'src2'")
def upsert_content_hash(spark, d):
    docs = read_table(spark, d, "documents")
    table = docs.select(F.col("doc_id").alias("id"), F.md5(F.coalesce("source", F.lit(""))).alias("content_hash"), F.col("lang").alias("name"))
    batch = docs.where("source = 'src2'").select((F.col("doc_id") + 1000000000).alias("id"), F.col("lang").alias("name"))
    return DocumentStore(table).upsert_content(batch, hashlib.md5(b"src1").hexdigest()).table


@register(f"SELECT id, name FROM ({_HASHED}) WHERE name IS DISTINCT FROM 'de'")
def delete_by_name(spark, d):
    table = read_table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("lang").alias("name"))
    return DocumentStore(table).delete_named("de").delete_named(None).table


# persistence and streams


@register("SELECT vec_id AS id, CASE WHEN label = 3 THEN label + 100 ELSE label END AS label FROM embeddings WHERE label <> 2")
def snapshot_sync(spark, d):
    """Saved, changed by two deltas, and loaded with its checks."""
    root = f"{scratch_dir(spark).rstrip('/')}/orrery-snapshot-{uuid.uuid4().hex[:12]}"
    table = vectors(spark, d).select("id", "label")
    P.save(table, root, model=model(4))
    P.sync(root, removed=table.where("label = 2").select("id"))
    new = table.where("label = 3").withColumn("label", F.col("label") + 100)
    P.sync(root, added=new, removed=new.select("id"))
    return P.load(spark, root, check=True)


@register(ORACLE_SQL["encode_4bit"])
def stream_ingest(spark, d):
    """The table as a stream of files, encoded under a frozen model."""
    base = f"{scratch_dir(spark).rstrip('/')}/orrery-stream-{uuid.uuid4().hex[:12]}"
    vectors(spark, d).select("id", "embedding").repartition(3, "id").write.parquet(f"{base}/in")
    src = I.vectors(spark, f"{base}/in", spark.read.parquet(f"{base}/in").schema, 1)
    I.ingest(src, model(4), f"{base}/codes", f"{base}/check").awaitTermination()
    return _codes_shown(I.codes(spark, f"{base}/codes"))


@register("SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M') AS hour, count(*) AS n FROM events GROUP BY 1")
def stream_arrivals(spark, d):
    """Events an hour, counted from a stream of files."""
    base, name = _scratch(spark, "events"), f"arrivals_{uuid.uuid4().hex[:12]}"
    read_table(spark, d, "events").select(F.col("ts").cast("timestamp").alias("ts")).repartition(4).write.parquet(f"{base}/in")
    src = I.vectors(spark, f"{base}/in", spark.read.parquet(f"{base}/in").schema, 1)
    out = I.arrivals(src, window="1 hour").writeStream.outputMode("complete").format("memory").queryName(name)
    out.option("checkpointLocation", f"{base}/check").trigger(availableNow=True).start().awaitTermination()
    return spark.table(name).select(F.date_format("window.start", "yyyy-MM-dd HH:mm").alias("hour"), "n")


@register("SELECT coalesce(vec_id, doc_id) AS id, CASE WHEN vec_id IS NULL THEN 'codes' ELSE 'documents' END AS missing FROM embeddings FULL JOIN documents ON vec_id = doc_id WHERE vec_id IS NULL OR doc_id IS NULL")
def pairs_without_a_partner(spark, d):
    """Documents without a vector, and vectors without a document."""
    return P.check_pairs(vectors(spark, d), read_table(spark, d, "documents").select(F.col("doc_id").alias("id")))

"""Mixing sources to target weights by iterative proportional fitting.

Documents are summed to cells (source, language, topic) in one aggregation;
the cell table is raked to the three marginals in turn (window sums over
cells), and each document is then kept with its cell's calibrated probability,
decided by a hash of its id. The plan scans the documents twice and shuffles
only cells; cells are broadcast to the documents behind a check of their
size. Sources are those of a corpus, not hosts: the sums over all cells are one
task's work.

Targets are token shares: ``share ** power`` normalised, with a power for each
marginal (1 keeps the natural share, 0 makes values equal), or explicit weights
of values: values that aren't listed keep their natural share, and the listed
ones divide the rest in proportion to their weights (0 leaves a value out).
Each sweep fits the three marginals in turn; after the last one the topic's is
exact and the others' are as near as ``sweeps`` brings them.
Probabilities are the raked weights over the natural ones (rates), scaled so
that the largest of the bulk is 1 and clipped there: the largest sample with
this mix on the bulk. Outside the bulk are the cells of the highest rates, as
long as they need more than ``SPARE`` times what there is and make up at most
``1 - BULK`` of the raked weight together; they are kept whole. So scarce cells
never set the size of the sample. Explicit targets are met exactly (all cells
are bulk) unless ``bulk`` is given.

Topic: a given column, or else the kind of content, the first that holds:
``table`` (cells split by " | "), ``legal`` (license or rights notices),
``contact`` (an at sign), ``prose``.

Rows, defined results: null source, language or text count as empty strings; a
document of no tokens is never sampled; rows with equal ids share their
decision; a null id decides by the text; texts of any length count whole; an
empty table gives an empty result; all input columns are returned under their
names, whatever these are; with ``extra`` none may be named like an added one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orrery.runtime import cut

#: Bytes of the cell table (64 a cell and its names) up to which it is broadcast.
BROADCAST_BYTES = 16 << 20
POWERS = {"source": 0.8, "lang": 0.9, "topic": 1.0}
SWEEPS = 8
#: Share of the raked weight that has exactly the mix, and the rate up to which a cell is in it in any case.
BULK = 0.95
SPARE = 1.5


def token_weight(text: Column) -> Column:
    """Words between white space."""
    return F.size(F.filter(F.split(F.coalesce(text, F.lit("")), "[ \\t\\n\\r\\f]+"), lambda x: x != "")).cast("bigint")


def topic_of(text: Column) -> Column:
    t = F.coalesce(text, F.lit(""))
    low = F.lower(t)
    return (
        F.when(t.contains(" | "), "table")
        .when(low.contains("licens") | low.contains("rights reserved"), "legal")
        .when(t.contains("@"), "contact")
        .otherwise("prose")
    )


def rake(cells: DataFrame, dims: list[str], powers: dict[str, float], sweeps: int, targets: dict[str, dict[str, float]] | None = None) -> DataFrame:
    """``cells`` (dims, __tokens) with the raked weight ``__w``; marginals fit in turn, ``sweeps`` times."""
    everything = Window.partitionBy()
    c = cells.withColumn("__w", F.col("__tokens").cast("double")).withColumn("__all", F.sum("__w").over(everything))
    for d in dims:
        given = (targets or {}).get(d)
        c = c.withColumn("__m", F.sum("__w").over(Window.partitionBy(d)))
        natural = F.col("__m") / F.col("__all")
        if given:
            if any(v < 0 for v in given.values()):
                raise ValueError("target weights may not be negative")
            # each value of d counts once: its cells' shares of the marginal add up to 1
            listed = F.col(d).isin(*given)
            mine = F.sum(F.when(listed, F.col("__w") / F.col("__all")).otherwise(0.0)).over(everything)
            weight = F.create_map(*[F.lit(x) for k, v in given.items() for x in (k, float(v))])[F.col(d)]
            whole = F.sum(F.when(listed, weight * F.col("__w") / F.col("__m")).otherwise(0.0)).over(everything)
            share = F.when(listed, F.when(whole > 0, weight / whole * mine).otherwise(0.0)).otherwise(natural)
        else:
            share = F.pow(natural, float(powers[d]))
        c = c.withColumn("__s", share)
        c = c.withColumn(f"__t_{d}", F.col("__s") / F.sum(F.col("__s") * F.col("__w") / F.col("__m")).over(everything) * F.col("__all"))
    for _ in range(sweeps):
        for d in dims:
            m = F.sum("__w").over(Window.partitionBy(d))
            c = c.withColumn("__w", F.when(m > 0, F.col("__w") * F.col(f"__t_{d}") / m).otherwise(0.0))
    return c.select(*dims, "__tokens", "__w")


def mix_sources(docs: DataFrame, text: str = "text", key: str = "doc_id", source: str = "source", lang: str = "lang", powers: dict[str, float] | None = None, targets: dict[str, dict[str, float]] | None = None, sweeps: int = SWEEPS, seed: str = "mix", extra: bool = True, bulk: float | None = None, topic: str | None = None) -> DataFrame:
    """The sampled documents; ``extra`` adds ``topic, n_tokens, probability``; ``topic`` names a column that has the topics."""
    if extra and {"topic", "n_tokens", "probability"} & set(docs.columns):
        raise ValueError("topic, n_tokens and probability are already columns")
    powers = POWERS | (powers or {})
    dims = ["source", "lang", "topic"]
    at = {"source": F.coalesce(docs[source], F.lit("")), "lang": F.coalesce(docs[lang], F.lit("")), "topic": F.coalesce(docs[topic], F.lit("")) if topic else topic_of(docs[text])}
    facts = docs.select(*[at[d].alias(d) for d in dims], token_weight(docs[text]).alias("__tokens"))
    cells = facts.where("__tokens > 0").groupBy(*dims).agg(F.sum("__tokens").alias("__tokens"))
    raked = rake(cells, dims, powers, sweeps, targets)
    bulk = bulk if bulk is not None else 1.0 if targets else BULK
    everything = Window.partitionBy()
    rates = raked.select(*dims, "__w", (F.col("__w") / F.col("__tokens")).alias("__r"))
    # scarce: with all cells of its rate and above at most 1 - bulk of the weight
    scarce = (F.col("__r") > SPARE) & (F.sum("__w").over(everything.orderBy(F.desc("__r"))) <= (1 - bulk) * F.sum("__w").over(everything))
    rates = rates.withColumn("__scarce", scarce)
    top = F.max(F.when(~F.col("__scarce"), F.col("__r"))).over(everything)
    rates = cut(rates.select(*dims, F.least(F.lit(1.0), F.col("__r") / top).alias("__p")))
    size = rates.agg(F.sum(sum((F.length(d) for d in dims), F.lit(64))).alias("bytes")).first()["bytes"] or 0
    if size <= BROADCAST_BYTES:
        rates = F.broadcast(rates)
    # names of our own, whatever the input's are
    src = docs.select(*[docs[c].alias(f"c{i}") for i, c in enumerate(docs.columns)], F.coalesce(docs[key].cast("string"), docs[text], F.lit("")).alias("__name"), *[at[d].alias(d) for d in dims], token_weight(docs[text]).alias("__tokens")).where("__tokens > 0")
    draw = F.conv(F.substring(F.md5(F.concat(F.lit(seed), F.col("__name"))), 1, 8), 16, 10).cast("double") / 4294967296.0
    hit = src.withColumn("__u", draw).join(rates, dims).where(F.col("__u") < F.col("__p"))
    cols = [F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns)]
    if extra:
        cols += [F.col("topic"), F.col("__tokens").alias("n_tokens"), F.round("__p", 6).alias("probability")]
    return hit.select(*cols)

"""Changes to tables as new DataFrames: appends, removals, upserts and duplicate policies.

A change is a join on the key (Spark broadcasts the smaller side by its own
threshold), never a driver loop. Order within a batch is the column ``pos``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orrery.errors import DuplicateIdError, OrreryError

KEEP_FIRST, KEEP_LAST, REJECT, KEEP_ALL = "keep_first", "keep_last", "reject", "keep_all"
FAIL, SKIP, OVERWRITE, NONE = "fail", "skip", "overwrite", "none"


def resolve_duplicates(batch: DataFrame, policy: str, key: str = "id", pos: str = "pos") -> DataFrame:
    """One row a key (first or last), all rows, or an error where a key repeats."""
    if policy == KEEP_ALL:
        return batch
    if policy == REJECT:
        twice = [r[0] for r in batch.groupBy(key).count().where("count > 1").limit(5).collect()]
        if twice:
            raise DuplicateIdError(f"keys repeat in the batch: {twice}")
        return batch
    if policy not in (KEEP_FIRST, KEEP_LAST):
        raise OrreryError(f"unknown policy {policy}")
    w = Window.partitionBy(key).orderBy(F.asc(pos) if policy == KEEP_FIRST else F.desc(pos))
    return batch.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r")


def addable(table: DataFrame, batch: DataFrame, key: str = "id") -> bool:
    """No key of the batch repeats or is in the table."""
    clash = batch.join(table.select(key), key, "left_semi").limit(1)
    return not batch.groupBy(key).count().where("count > 1").limit(1).count() and not clash.count()


def add_with_ids(table: DataFrame, batch: DataFrame, key: str = "id", pos: str | None = "pos") -> DataFrame:
    """Append; the first id (by ``pos``) that is there already or repeats is an error, and nothing is added."""
    order = F.col(pos) if pos else F.lit(0)
    seen = batch.select(key, order.alias("__pos")).withColumn("__again", F.row_number().over(Window.partitionBy(key).orderBy("__pos")) > 1)
    have = table.select(F.col(key).alias("__have")).distinct()
    bad = seen.join(have, F.col(key) == F.col("__have"), "left").where(F.col("__have").isNotNull() | F.col("__again")).orderBy("__pos").limit(1).collect()
    if bad:
        raise DuplicateIdError(f"id {bad[0][key]} {'is already there' if bad[0]['__have'] is not None else 'repeats in the batch'}")
    return table.unionByName(batch.select(*table.columns))


def append(table: DataFrame, batch: DataFrame) -> DataFrame:
    return table.unionByName(batch.select(*table.columns))


def remove(table: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    """Without the listed keys; unknown ones are ignored."""
    return table.join(ids.select(F.col(ids.columns[0]).alias("__gone")).distinct(), table[key] == F.col("__gone"), "left_anti")


def removed_flags(table: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    """``id, removed BOOLEAN`` of every listed key: whether it was there."""
    have = table.select(F.col(key).alias("__have")).distinct()
    want = ids.select(F.col(ids.columns[0]).alias("id")).distinct()
    return want.join(have, want["id"] == have["__have"], "left").select("id", F.col("__have").isNotNull().alias("removed"))


def upsert(table: DataFrame, batch: DataFrame, key: str = "id", pos: str = "pos", policy: str = KEEP_LAST) -> DataFrame:
    """Rows of the batch replace those of equal keys; duplicates in the batch by ``policy``."""
    new = resolve_duplicates(batch, policy, key, pos).select(*table.columns)
    return table.join(new.select(F.col(key).alias("__new")).distinct(), table[key] == F.col("__new"), "left_anti").unionByName(new)


def swap_remove(table: DataFrame, slot: int, column: str = "slot") -> DataFrame:
    """Without a slot; the last row moves into the hole."""
    last = table.agg(F.max(column)).collect()[0][0]
    if last is None or not 0 <= slot <= last:
        raise IndexError(f"slot {slot} is out of range")
    moved = F.when(F.col(column) == last, F.lit(slot).cast("long")).otherwise(F.col(column))
    return table.where(F.col(column) != slot).withColumn(column, moved)


def with_slots(table: DataFrame, order: str = "id", column: str = "slot") -> DataFrame:
    """Dense slots 0..n-1 by ``order``: per-partition counts first, so no partition holds the whole table."""
    spark = table.sparkSession
    ranged = table.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), order).sortWithinPartitions(order).withColumn("__p", F.spark_partition_id())
    local = ranged.withColumn("__r", F.row_number().over(Window.partitionBy("__p").orderBy(order)))
    per = local.groupBy("__p").agg(F.max("__r").alias("__n"))
    base = per.withColumn("__base", F.coalesce(F.sum("__n").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return local.join(F.broadcast(base.select("__p", "__base")), "__p").withColumn(column, F.col("__base") + F.col("__r") - 1).drop("__p", "__r", "__base")


def write_documents(table: DataFrame, batch: DataFrame, policy: str = NONE, key: str = "id", pos: str = "pos") -> tuple[DataFrame, int]:
    """The table after writing a batch, and how many were written. FAIL keeps the rows before the first clash and raises.

    The error carries the partial table as ``partial``.
    """
    policy = FAIL if policy == NONE else policy
    if policy == OVERWRITE:
        return upsert(table, batch, key, pos, KEEP_LAST), batch.count()
    have = table.select(F.col(key).alias("__have")).distinct()
    first = batch.withColumn("__again", F.row_number().over(Window.partitionBy(key).orderBy(pos)) > 1)
    marked = first.join(have, first[key] == have["__have"], "left").withColumn("__clash", F.col("__have").isNotNull() | F.col("__again"))
    if policy == SKIP:
        new = marked.where("not __clash").select(*table.columns)
        return table.unionByName(new), new.count()
    if policy != FAIL:
        raise OrreryError(f"unknown policy {policy}")
    bad = marked.where("__clash").orderBy(pos).limit(1).collect()
    if not bad:
        return append(table, batch), batch.count()
    error = DuplicateIdError(f"document {bad[0][key]} is already there")
    error.partial = append(table, batch.where(F.col(pos) < bad[0][pos]))
    raise error


def update_metadata(table: DataFrame, where: Column, new: Column, column: str = "metadata") -> DataFrame:
    """Map entries merged into the matching rows' metadata (new values win)."""
    old = F.coalesce(F.col(column), F.create_map().cast(table.schema[column].dataType))
    rest = F.map_filter(old, lambda k, _: ~F.map_contains_key(new, k))
    return table.withColumn(column, F.when(F.coalesce(where, F.lit(False)), F.map_concat(rest, new)).otherwise(F.col(column)))


def content_key(base: Column, content: Column, content_hash: Column) -> Column:
    """md5(base or md5(content), "_", content hash)."""
    return F.md5(F.concat_ws("_", F.coalesce(base, F.md5(content)), content_hash))

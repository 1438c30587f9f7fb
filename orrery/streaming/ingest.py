"""Continuous ingest: a stream of vectors is encoded under a frozen model and appended to a code table.

Encoding is row by row, so batches in any order give the same table. Each
micro-batch goes to a folder of its own number, overwritten if the batch is
run again: every row lands once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from orrery.operators.encode import encode
from orrery.plans.quantizer import Model


def ingest(stream: DataFrame, model: Model, root: str, checkpoint: str, embedding: str = "embedding", keep: tuple[str, ...] = ("id",), once: bool = True) -> StreamingQuery:
    def write(batch: DataFrame, number: int) -> None:
        encode(batch, model, embedding, keep).write.mode("overwrite").parquet(f"{root}/batch={number}")

    out = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (out.trigger(availableNow=True) if once else out).start()


def codes(spark: SparkSession, root: str) -> DataFrame:
    """All ingested rows."""
    return spark.read.parquet(root).drop("batch")


def vectors(spark: SparkSession, folder: str, schema, files_per_batch: int = 64) -> DataFrame:
    """A stream of Parquet files as they arrive."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def arrivals(stream: DataFrame, time: str = "ts", window: str = "1 minute", late: str = "10 minutes") -> DataFrame:
    """Rows a window of event time, late ones within the watermark included."""
    return stream.withWatermark(time, late).groupBy(F.window(time, window)).agg(F.count(F.lit(1)).alias("n"))

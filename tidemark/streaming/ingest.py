"""Feeding a store from a stream of mutation files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..sources.store import Engine

OPS = "op_no long, vtype int, user_key binary, value binary"


def ingest(spark: SparkSession, engine: Engine, source: str, checkpoint: str, files_per_batch: int = 100) -> StreamingQuery:
    """Apply every new Parquet file of operations to the store, one run for each batch; stops when all are in.

    The store keeps the number of the last batch of each checkpoint, so that a
    batch that comes again after a failure isn't applied twice.
    """

    def write(batch: DataFrame, number: int) -> None:
        engine.apply(batch, (checkpoint, number))

    stream = spark.readStream.schema(OPS).option("maxFilesPerTrigger", files_per_batch).parquet(source)
    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

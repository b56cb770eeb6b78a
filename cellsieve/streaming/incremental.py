"""Incremental add: a stream of new items is placed into the cells of a trained index and appended."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from cellsieve.operators.ivf import IvfIndex


def append_new(index: IvfIndex, items: DataFrame, path: str) -> None:
    """Assign, encode and append the items whose ids are not stored yet, so a repeated batch adds nothing.

    The stored side is only scanned for its id column and reduced to the ids of this batch before the
    anti join, so the batch, not the table, sets the size of what is shuffled or broadcast.
    """
    spark = items.sparkSession
    stored = spark.read.schema(index.vectors.schema).parquet(path).select("item_id")
    items = items.dropDuplicates(["item_id"])
    known = stored.join(items.select("item_id"), "item_id", "left_semi").distinct()
    placed = index.assign(items.join(known, "item_id", "left_anti"))
    # About one file per touched cell, however many tasks the batch has.
    placed = placed.select(*index.vectors.columns).hint("rebalance", "cell_id").sortWithinPartitions("cell_id")
    placed.write.mode("append").option("parquet.bloom.filter.enabled#item_id", "true").partitionBy("cell_id").parquet(path)


def start_incremental_add(
    spark: SparkSession,
    index: IvfIndex,
    source: str,
    schema: T.StructType,
    path: str,
    checkpoint: str,
    prepare: Callable[[DataFrame], DataFrame] = lambda df: df,
    available_now: bool = True,
) -> StreamingQuery:
    """Read new parquet files under `source`, turn each batch into items (item_id, embedding, carried
    columns) with `prepare`, and append them to the vectors table at `path`, partitioned by cell."""

    def add(batch: DataFrame, _: int) -> None:
        batch.persist()
        try:
            append_new(index, prepare(batch), path)
        finally:
            batch.unpersist()

    stream = spark.readStream.schema(schema).parquet(source)
    writer = stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint)
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start()

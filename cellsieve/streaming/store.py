"""A growing collection: the vectors of an index and the items they stand for, added to batch by batch.

Both tables are partitioned by batch as well: vectors by cell, items by a hash bucket of the id. A batch replaces its own
partitions and looks only at earlier batches for ids that are stored already, so running it again after a failure at
any point writes the same rows into the same places. Its row in the ledger, written last, lets it be skipped. Only the
buckets that a batch's ids fall into are read.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from cellsieve.operators.ivf import IvfIndex
from cellsieve.schemas import ITEM_COLUMNS
from cellsieve.session import cut
from cellsieve.sources.tables import load_quantizers, save_quantizers

BUCKETS = 256
FIRST = -1
LEDGER = "batch_id bigint, added bigint"
_PARTITIONS = ("cell_id", "bucket", "batch_id")


def _bucket():
    return F.pmod(F.xxhash64("item_id"), F.lit(BUCKETS)).cast("int")


@dataclass(frozen=True)
class Store:
    """The tables under `path`. index: quantizers, and in its `vectors` the columns and types that are stored."""

    spark: SparkSession
    path: str
    index: IvfIndex

    @classmethod
    def create(cls, index: IvfIndex, items: DataFrame, path: str) -> Store:
        """From a placed index and the items (ITEM_COLUMNS) of its vectors."""
        store = cls(index.vectors.sparkSession, path, index)
        save_quantizers(index, f"{path}/quantizers", index.total)
        store._write(index.vectors, "vectors", "cell_id", FIRST)
        store._write(items.select(*ITEM_COLUMNS).withColumn("bucket", _bucket()), "items", "bucket", FIRST)
        store._note(FIRST, index.total)
        return store

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> Store:
        vectors = _typed(spark, f"{path}/vectors").drop("batch_id")
        return cls(spark, path, load_quantizers(spark, f"{path}/quantizers", vectors))

    @property
    def vectors(self) -> DataFrame:
        return _typed(self.spark, f"{self.path}/vectors").drop("batch_id")

    @property
    def items(self) -> DataFrame:
        return _typed(self.spark, f"{self.path}/items").select(*ITEM_COLUMNS)

    @property
    def ledger(self) -> DataFrame:
        return self.spark.read.schema(LEDGER).parquet(f"{self.path}/ledger")

    def current(self) -> IvfIndex:
        """The index over everything stored."""
        return replace(self.index, vectors=self.vectors, counted=None)

    def _write(self, rows: DataFrame, name: str, part: str, batch_id: int) -> None:
        # About one file per touched partition, however many tasks the batch has.
        placed = rows.hint("rebalance", part).sortWithinPartitions(part).withColumn("batch_id", F.lit(batch_id).cast("bigint"))
        options = {"partitionOverwriteMode": "dynamic", "parquet.bloom.filter.enabled#item_id": "true"}
        placed.write.mode("overwrite").options(**options).partitionBy(part, "batch_id").parquet(f"{self.path}/{name}")

    def _note(self, batch_id: int, added: int) -> None:
        row = self.spark.createDataFrame([(batch_id, added)], LEDGER).coalesce(1)
        row.write.mode("overwrite").parquet(f"{self.path}/ledger/of={batch_id}")

    def add(self, items: DataFrame, batch_id: int) -> int:
        """Place, encode and store the items (ITEM_COLUMNS, embedding) whose ids no earlier batch stored; how many those
        are. A batch noted in the ledger is left alone."""
        done = self.ledger.filter(F.col("batch_id") == batch_id).select("added").head()
        if done is not None:
            return done["added"]
        # Of rows that share an id the same one stays in every run.
        columns = [*ITEM_COLUMNS, "embedding"]
        chosen = items.groupBy("item_id").agg(F.min(F.struct(F.xxhash64(*columns).alias("h"), *columns)).alias("row")).select("row.*").drop("h")
        batch = cut(chosen.withColumn("bucket", _bucket()))
        touched = sorted(r["bucket"] for r in batch.select("bucket").distinct().collect())  # BUCKETS at most
        if touched:
            stored = _typed(self.spark, f"{self.path}/items").filter(F.col("bucket").isin(touched) & (F.col("batch_id") < batch_id))
            known = stored.select("item_id").join(batch.select("item_id"), "item_id", "left_semi").distinct()
            batch = cut(batch.join(known, "item_id", "left_anti"))
            placed = self.index.assign(batch.drop("bucket")).select(*self.index.vectors.columns)
            self._write(placed, "vectors", "cell_id", batch_id)
            self._write(batch.select(*ITEM_COLUMNS, "bucket"), "items", "bucket", batch_id)
        added = batch.count()
        self._note(batch_id, added)
        return added

    def start(
        self, source: str, schema: T.StructType, checkpoint: str, prepare: Callable[[DataFrame], DataFrame] = lambda df: df, available_now: bool = True
    ) -> StreamingQuery:
        """Add new Parquet files under `source` as they come; `prepare` turns a batch of them into items."""
        stream = self.spark.readStream.schema(schema).parquet(source)
        writer = stream.writeStream.foreachBatch(lambda batch, number: self.add(prepare(batch), number) and None)
        if available_now:
            writer = writer.trigger(availableNow=True)
        return writer.option("checkpointLocation", checkpoint).start()


def _typed(spark: SparkSession, path: str) -> DataFrame:
    """A partitioned table whose partition columns have their own types, so that filters on them prune."""
    kinds = {"cell_id": T.LongType(), "bucket": T.IntegerType(), "batch_id": T.LongType()}
    fields = [T.StructField(f.name, kinds[f.name]) if f.name in _PARTITIONS else f for f in spark.read.parquet(path).schema]
    return spark.read.schema(T.StructType(fields)).parquet(path)

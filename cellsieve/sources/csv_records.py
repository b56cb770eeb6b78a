"""Records of CSV files whose quoted values may hold line breaks, read by many tasks per file.

A line ends a record if the number of quotes before its end is even. Phase 1 counts the quotes of every split of a file and
so learns for each split whether it begins inside quotes. Phase 2 cuts every split into records. A record that crosses
splits leaves them as fragments, at most two per split, which are put together afterwards.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cellsieve import limits
from cellsieve.session import cut

WHOLE, LEADING, TRAILING = 0, 1, 2
RECORD_SCHEMA = "file string, start bigint, kind int, first boolean, text string"


def records(spark: SparkSession, path: str) -> DataFrame | None:
    """(record, first): the records of the files under `path` without their line end, `first` for the first of a file; blank
    lines are left out. None if there are too many splits to tell every task where they begin."""
    lines = spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.col("value").alias("text")
    )
    quotes = F.length("text") - F.length(F.replace("text", F.lit('"'), F.lit("")))
    splits = cut(lines.groupBy("file", "start").agg((F.sum(quotes) % 2).alias("odd")))
    if splits.limit(limits.CSV_SPLITS + 1).count() > limits.CSV_SPLITS:
        return None
    before = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    inside = splits.withColumn("inside", F.coalesce(F.sum("odd").over(before), F.lit(0)) % 2 == 1)
    known = inside.filter("inside").select("file", "start").toArrow()
    began_inside = set(zip(known.column("file").to_pylist(), known.column("start").to_pylist()))
    shared = spark.sparkContext.broadcast(began_inside)

    def run(batches):
        cutter = SplitCutter(shared.value)
        for batch in batches:
            yield _batch(list(cutter.take(batch)))
        yield _batch(list(cutter.end()))

    found = cut(lines.mapInArrow(run, RECORD_SCHEMA))
    return found.filter(F.col("kind") == WHOLE).select(F.col("text").alias("record"), "first").unionByName(_joined(found))


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [()] * 5
    kinds = (pa.string(), pa.int64(), pa.int32(), pa.bool_(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], ["file", "start", "kind", "first", "text"])


class SplitCutter:
    """Cuts the lines of one split after the other into records and fragments."""

    def __init__(self, began_inside: set[tuple[str, int]]):
        self.began_inside = began_inside
        self.split: tuple[str, int] | None = None
        self.held: list[str] = []
        self.kind, self.open, self.first = WHOLE, False, False

    def _begin(self, split: tuple[str, int]) -> None:
        self.split, self.held = split, []
        self.open = split in self.began_inside
        self.kind = LEADING if self.open else WHOLE
        self.first = split[1] == 0

    def _leave(self, kind: int) -> Iterator[tuple]:
        text = "\n".join(self.held)
        if kind != WHOLE or text.rstrip("\r"):
            yield (*self.split, kind, self.first, text)
            self.first = False
        self.held, self.kind = [], WHOLE

    def end(self) -> Iterator[tuple]:
        """What is left when a split ends: a record that goes on in the next split."""
        if self.split is not None and self.held:
            yield from self._leave(LEADING if self.kind == LEADING else TRAILING)
        self.split = None

    def take(self, batch: pa.RecordBatch) -> Iterator[tuple]:
        if not batch.num_rows:
            return
        files, starts = batch.column("file"), batch.column("start").to_numpy()
        for file, start, text in zip(files.to_pylist(), starts.tolist(), batch.column("text").to_pylist()):
            if self.split != (file, start):
                yield from self.end()
                self._begin((file, start))
            self.held.append(text)
            self.open ^= bool(text.count('"') & 1)
            if not self.open:
                yield from self._leave(self.kind)


def _joined(found: DataFrame) -> DataFrame:
    """Records of fragments: a trailing one begins a record, the leading ones after it go on with it."""
    parts = found.filter(F.col("kind") != WHOLE)
    # Numbers first, without texts: all fragments of one file pass one task here.
    along = Window.partitionBy("file").orderBy("start", "kind")
    number = F.sum((F.col("kind") == TRAILING).cast("bigint")).over(along)
    numbered = parts.select("file", "start", "kind").withColumn("number", number)
    pieces = F.array_sort(F.collect_list(F.struct("start", "kind", "text")))
    joined = parts.join(numbered, ["file", "start", "kind"]).groupBy("file", "number").agg(pieces.alias("pieces"), F.max("first").alias("first"))
    return joined.select(F.array_join("pieces.text", "\n").alias("record"), "first")

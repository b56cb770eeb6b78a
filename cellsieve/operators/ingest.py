"""Ingest transforms: typed items, file-order ids, block shuffle, load checks."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cellsieve import limits
from cellsieve.functions.dates import load_date
from cellsieve.operators.ivf import SEED
from cellsieve.schemas import ITEM_COLUMNS
from cellsieve.session import cut


def first_rows(source: DataFrame, key: str, n: int) -> DataFrame:
    """Bounded read: the first `n` rows by key, or all when there are fewer."""
    return source.orderBy(key).limit(n)


def first_in_file_order(source: DataFrame, n: int) -> DataFrame:
    """Bounded read: the first `n` rows in the order of file paths and of rows within a file, without a sort or shuffle.

    `source` must be a file scan. Row counts of Parquet files say in which file the nth row lies; that file is read up to
    it, files before it whole, later ones not at all. Rows of other formats are numbered by file split.
    """
    path, row = F.col("_metadata.file_path"), F.col("_metadata.row_index")
    try:
        marked = source.select("*", path.alias("__path"), row.alias("__row"))
        marked.schema  # resolved here: only Parquet knows the row index
    except AnalysisException:
        return assign_item_ids(source, "__number").filter(F.col("__number") < n).drop("__number")
    counts = marked.groupBy("__path").agg(F.count(F.lit(1)).alias("rows"))
    reached = F.sum("rows").over(Window.orderBy("__path").rowsBetween(Window.unboundedPreceding, 0))
    # One row per file; the last file that is needed is the first that reaches n.
    last = counts.withColumn("reached", reached).filter(F.col("reached") >= n).orderBy("__path").limit(1).collect()
    if not last:
        return source
    rest = n - (last[0]["reached"] - last[0]["rows"])
    name = F.lit(last[0]["__path"])
    return source.filter((path < name) | ((path == name) & (row < rest)))


def required_int(column: Column, kind: str) -> Column:
    """ANSI cast that fails on NULL or text that is no number."""
    number = column.cast(kind)
    return F.when(number.isNull(), F.raise_error(F.lit("missing integer in a required column"))).otherwise(number)


def typed_items(raw: DataFrame) -> DataFrame:
    """Raw text rows as items: integers required, bad dates NULL, `id` renamed to `ext_id`."""
    return raw.select(
        required_int(F.col("item_id"), "bigint").alias("item_id"),
        required_int(F.col("id"), "bigint").alias("ext_id"),
        "title",
        "url",
        load_date(F.col("revdate")).alias("revdate"),
        required_int(F.col("token_count"), "int").alias("token_count"),
        "entity",
    ).select(*ITEM_COLUMNS)


def assign_item_ids(source: DataFrame, column: str = "item_id") -> DataFrame:
    """Sequential ids 0..n-1 in file order, as first column.

    `source` must be a file scan without a shuffle above it. Parquet rows carry their number within the file;
    rows of other formats are numbered within their file split. A table with one row per file (or split)
    supplies the offsets, so data rows are neither moved nor sorted.
    """
    names = source.columns
    place = [F.col("_metadata.file_path").alias("__path")]
    try:
        marked = source.select("*", *place, F.col("_metadata.row_index").alias("__row"))
        marked.schema  # resolved here: only Parquet knows the row index
        first = F.lit(0)
    except AnalysisException:
        place.append(F.col("_metadata.file_block_start").alias("__start"))
        marked = source.select("*", *place, F.monotonically_increasing_id().alias("__row"))
        first = F.min("__row")
    keys = ["__path", "__start"][: len(place)]
    parts = marked.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"), first.alias("__first"))
    earlier = Window.orderBy(*keys).rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.select(
        *keys, (F.coalesce(F.sum("__n").over(earlier), F.lit(0)) - F.col("__first")).alias("__shift")
    )
    # One row per file or split: written once, counted, and broadcast while that stays small.
    offsets = cut(offsets)
    if offsets.count() <= limits.BROADCAST_FILES:
        offsets = F.broadcast(offsets)
    return marked.join(offsets, keys).select((F.col("__row") + F.col("__shift")).alias(column), *names)


def block_shuffle(source: DataFrame, id_column: str, block_size: int, seed: int = SEED) -> DataFrame:
    """Add `block` and `position`: blocks keep their order, rows inside a block are in seeded random order.

    The rank is taken per block, so no task ever orders more than `block_size` rows.
    """
    block = F.floor(F.col(id_column) / F.lit(block_size)).cast("bigint")
    ticket = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(id_column).cast("string")))
    inside = Window.partitionBy("block").orderBy(ticket, id_column)
    return source.withColumn("block", block).withColumn(
        "position", F.col("block") * block_size + F.row_number().over(inside) - 1
    )


def key_violations(items: DataFrame, key: str = "item_id") -> DataFrame:
    """Keys that occur more than once, with their count."""
    return items.groupBy(key).agg(F.count(F.lit(1)).alias("copies")).filter(F.col("copies") > 1)


def intersect(candidates: DataFrame, items: DataFrame) -> DataFrame:
    """Candidates (qid, item_id, similarity) joined with the filtered items they belong to."""
    return candidates.join(items, "item_id")


def display(results: DataFrame) -> DataFrame:
    """The display columns, similarity always included, best first."""
    from cellsieve.schemas import DISPLAY_COLUMNS

    return results.select(*DISPLAY_COLUMNS, "similarity").orderBy(F.col("similarity").desc(), "item_id")

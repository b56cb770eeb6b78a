"""Sources and sinks: CSV, the items table, the index and the histogram."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cellsieve.operators.histogram import Histogram2D
from cellsieve.operators.ingest import typed_items
from cellsieve.operators.ivf import Cells, IvfIndex
from cellsieve.sources.csv_records import records
from cellsieve.schemas import CENTROIDS, CODEBOOKS, INDEX_META, ITEMS, RAW

_CSV_OPTIONS = {
    "header": "true",
    "quote": '"',
    "escape": '"',
    "encoding": "UTF-8",
    "ignoreLeadingWhiteSpace": "false",
    "ignoreTrailingWhiteSpace": "false",
}


_ID_FILTER = {"parquet.bloom.filter.enabled#item_id": "true"}


# Line breaks, NUL (which Spark's CSV writer would drop) and the backslash itself as two visible characters, so that a row is
# one line of the file.
_ESCAPES = (("\\", "\\\\"), ("\n", "\\n"), ("\r", "\\r"), ("\x00", "\\z"))


def _texts(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]


def read_csv(
    spark: SparkSession,
    path: str,
    schema: T.StructType = RAW,
    columns: list[str] | None = None,
    escaped: bool = False,
) -> DataFrame:
    """CSV with header, columns found by name; only the named columns are parsed into rows.

    Quotes inside a value are doubled, and line breaks and backslashes inside quotes belong to it, as other programs
    write them. Large files are split over tasks even so. `escaped` is for files written with that option, whose rows
    are one line each.
    """
    if not escaped:
        return _plain_csv(spark, path, schema, columns or schema.names)
    df = spark.read.schema(schema).options(multiLine="false", **_CSV_OPTIONS).csv(path)
    df = df.select(*columns) if columns else df
    # A backslash pair first becomes one that no escape begins with, so that an escaped backslash before an n stays one.
    pair = "\\0"

    def plain(c):
        value = F.replace(F.col(c), F.lit("\\\\"), F.lit(pair))
        for old, new in _ESCAPES[1:]:
            value = F.replace(value, F.lit(new), F.lit(old))
        return F.replace(value, F.lit(pair), F.lit("\\"))

    return df.withColumns({c: plain(c) for c in _texts(df)})


def _plain_csv(spark: SparkSession, path: str, schema: T.StructType, columns: list[str]) -> DataFrame:
    options = {"multiLine": "true", **_CSV_OPTIONS}
    found = records(spark, path)
    if found is None:
        return spark.read.schema(schema).options(**options).csv(path).select(*columns)
    # Columns by the header of the first file; Spark reads that record alone.
    header = spark.read.options(**options).csv(path).columns
    missing = [c for c in columns if c not in header]
    if missing:
        raise ValueError(f"no column {', '.join(missing)} in {path}")
    kinds = {f.name: f.dataType for f in schema}
    fields = T.StructType([T.StructField(c, kinds.get(c, T.StringType())) for c in header])
    options.pop("header")
    line = F.rtrim("record", F.lit("\r"))
    row = F.from_csv(line, _ddl(fields), options)
    return found.filter("NOT first").select(row.alias("row")).select(*[F.col("row")[c].alias(c) for c in columns])


def _ddl(fields: T.StructType) -> str:
    return ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in fields)


def write_csv(df: DataFrame, path: str, mode: str = "error", escaped: bool = False) -> None:
    """Quoted CSV with header; with `escaped`, line breaks and backslashes as two characters, one row per line."""

    def one_line(c):
        value = F.col(c)
        for old, new in _ESCAPES:
            value = F.replace(value, F.lit(old), F.lit(new))
        return value

    if escaped:
        df = df.withColumns({c: one_line(c) for c in _texts(df)})
    df.write.mode(mode).options(quoteAll="true", **_CSV_OPTIONS).csv(path)


def create_items(items: DataFrame, path: str) -> DataFrame:
    """Write the items table, replacing an earlier one. Files are ordered by date so that date predicates
    skip row groups, and carry a Bloom filter so that lookups by id do."""
    # The id splits a crowded date, and the rows without one, over several tasks.
    ordered = items.repartitionByRange("revdate", "item_id").sortWithinPartitions("revdate", "item_id")
    ordered.write.mode("overwrite").options(**_ID_FILTER).parquet(path)
    return read_items(items.sparkSession, path)


def append_items(raw: DataFrame, path: str) -> int:
    """Type and append raw rows; returns the row count of the table."""
    typed_items(raw).write.mode("append").options(**_ID_FILTER).parquet(path)
    return read_items(raw.sparkSession, path).count()


def read_items(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(ITEMS).parquet(path)


def item_by_id(items: DataFrame, item_id: int) -> DataFrame:
    """The row with this id; a missing one is an error when the result is read."""
    found = items.filter(F.col("item_id") == item_id).limit(1)
    columns = items.columns
    counted = found.agg(F.first(F.struct(*columns)).alias("row"), F.count(F.lit(1)).alias("n"))
    missing = F.raise_error(F.lit(f"no item with id {item_id}"))
    checked = counted.select(F.when(F.col("n") == 0, missing).otherwise(F.col("row")).alias("row"))
    return checked.select("row.*")


# ----------------------------------------------------------------------------------------------------- index


def save_index(index: IvfIndex, path: str, extras: dict[str, str] | None = None) -> None:
    """Vectors by cell, centroids, codebooks and a one-row description."""
    # Rebalancing gathers each cell into few files and splits a crowded one into files of even size.
    # Rows of a cell are in date order, so that a date predicate skips row groups.
    order = ["cell_id", *(c for c in ("revdate", "token_count") if c in index.vectors.columns)]
    placed = index.vectors.hint("rebalance", "cell_id").sortWithinPartitions(*order)
    placed.write.options(**_ID_FILTER).mode("overwrite").partitionBy("cell_id").parquet(f"{path}/vectors")
    stored = index.vectors.sparkSession.read.parquet(f"{path}/vectors").count()  # from the file footers
    save_quantizers(index, path, stored, extras)


def save_quantizers(index: IvfIndex, path: str, stored: int, extras: dict[str, str] | None = None) -> None:
    """Centroids, codebooks and a one-row description."""
    index.cells.frame.coalesce(1).write.mode("overwrite").parquet(f"{path}/centroids")
    if index.codebooks is not None:
        index.codebooks.coalesce(1).write.mode("overwrite").parquet(f"{path}/codebooks")
    spark = index.vectors.sparkSession
    meta = (index.dim, index.nlist, stored, index.pq_m, index.pq_bits, extras or {})
    spark.createDataFrame([meta], INDEX_META).coalesce(1).write.mode("overwrite").parquet(f"{path}/meta")


def load_index(spark: SparkSession, path: str) -> IvfIndex:
    """The saved index; `total` is taken from the stored rows."""
    # The partition column is a bigint from the start: a cast above it would hide it from partition pruning.
    stored = spark.read.parquet(f"{path}/vectors").schema
    fields = [T.StructField(f.name, T.LongType()) if f.name == "cell_id" else f for f in stored]
    return load_quantizers(spark, path, spark.read.schema(T.StructType(fields)).parquet(f"{path}/vectors"))


def load_quantizers(spark: SparkSession, path: str, vectors: DataFrame) -> IvfIndex:
    """The index of these vectors by saved quantizers."""
    meta = spark.read.schema(INDEX_META).parquet(f"{path}/meta").head()
    codebooks = None
    if meta["pq_m"] is not None:
        codebooks = spark.read.schema(CODEBOOKS).parquet(f"{path}/codebooks")
    return IvfIndex(
        cells=Cells(spark.read.schema(CENTROIDS).parquet(f"{path}/centroids")),
        vectors=vectors,
        codebooks=codebooks,
        pq_m=meta["pq_m"],
        pq_bits=meta["pq_bits"] or 8,
    )


# ------------------------------------------------------------------------------------------------- histogram


def save_histogram(histogram: Histogram2D, path: str) -> None:
    histogram.edges().coalesce(1).write.mode("overwrite").parquet(f"{path}/edges")
    histogram.cells.coalesce(1).write.mode("overwrite").parquet(f"{path}/cells")


def load_histogram(spark: SparkSession, path: str) -> Histogram2D:
    rows = spark.read.parquet(f"{path}/edges").orderBy("axis", "edge_index").collect()
    pick = lambda axis: [r["value"] for r in rows if r["axis"] == axis]
    return Histogram2D(pick("number"), pick("date"), spark.read.parquet(f"{path}/cells"))

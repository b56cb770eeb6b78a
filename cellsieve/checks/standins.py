"""Item tables, queries and workloads derived from the given test tables."""

from __future__ import annotations

import math
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellsieve.functions.dates import moment_text
from cellsieve.functions.text import token_count, with_text_vectors
from cellsieve.functions.vectors import l2_normalize
from cellsieve.operators import ivf
from cellsieve.operators.histogram import Histogram2D
from cellsieve.operators.ivf import IvfIndex, index_items
from cellsieve.operators.predicates import Predicate
from cellsieve.session import cut

CARRIED = ("item_id", "revdate", "token_count")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents_as_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents dated by the event of the same number, with the page address where there is one."""
    docs = _documents(spark, sf_dir).withColumn("token_count", token_count(F.col("text")))
    return _dated(spark, sf_dir, docs).select(
        "item_id", "ext_id", "title", "url", "revdate", "token_count", "entity", "text"
    )


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("item_id"),
        F.col("doc_id").alias("ext_id"),
        F.concat_ws(" ", "source", "lang", F.col("doc_id").cast("string")).alias("title"),
        F.col("source").alias("entity"),
        "text",
    )


def _dated(spark: SparkSession, sf_dir: str, docs: DataFrame) -> DataFrame:
    events = table(spark, sf_dir, "events").select(
        F.col("event_id").alias("item_id"), F.date_trunc("second", "ts").cast("timestamp_ntz").alias("revdate")
    )
    pages = table(spark, sf_dir, "pages").select(F.col("page_id").alias("item_id"), "url")
    return docs.join(events, "item_id").join(pages, "item_id", "left")


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vector collection: embeddings with the metadata of the document of the same number."""
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("item_id"), "embedding")
    return documents_as_items(spark, sf_dir).drop("text").join(vectors, "item_id")


def unit_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vector collection with unit vectors, as an index stores them."""
    return items(spark, sf_dir).withColumn("embedding", l2_normalize("embedding"))


def document_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The text collection: documents with hashed embeddings."""
    # Texts become vectors where they are read, so that joins move vectors of 64 numbers, not texts.
    docs = with_text_vectors(_documents(spark, sf_dir))
    return _dated(spark, sf_dir, docs).select(
        "item_id", "ext_id", "title", "url", "revdate", "token_count", "entity", "embedding"
    )


def big_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as items: whole price as the number axis, order date as the date axis."""
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("item_id"),
        F.floor("o_totalprice").cast("int").alias("token_count"),
        F.col("o_orderdate").alias("revdate"),
    )


def prototypes(spark: SparkSession, sf_dir: str, label: str | None = "label") -> DataFrame:
    """Query vectors taken from all embeddings: the mean of every label, or of the whole table."""
    key = F.col(label).cast("bigint") if label else F.lit(0).cast("bigint")
    return (
        table(spark, sf_dir, "embeddings")
        .select(key.alias("qid"), F.posexplode("embedding").alias("pos", "x"))
        .groupBy("qid", "pos")
        .agg(F.avg(F.col("x").cast("double")).alias("x"))
        .groupBy("qid")
        .agg(F.array_sort(F.collect_list(F.struct("pos", "x"))).alias("parts"))
        .select("qid", F.col("parts.x").alias("qvec"))
    )


def seed_centroids(collection: DataFrame, nlist: int) -> DataFrame:
    """Untrained quantizer: a hash sample of the collection; a cell is named after its seed."""
    seeds = ivf.train_sample(collection.select("item_id", "embedding"), "item_id", nlist)
    return seeds.select(
        F.col("item_id").alias("cell_id"), l2_normalize("embedding").cast("array<double>").alias("centroid")
    )


def _seeded_index(collection: DataFrame, nlist_of_n, stored: bool = False) -> IvfIndex:
    """Seed, place and store the collection, as a built index would be. `stored`: it is a written table already."""
    collection = collection.select(*CARRIED, "embedding")
    collection = collection if stored else cut(collection)
    n = collection.count()
    index = index_items(collection, cut(seed_centroids(collection, nlist_of_n(n))))
    return replace(index, vectors=cut(index.vectors), counted=n)


def coarse_index(collection: DataFrame) -> IvfIndex:
    """About the square root of n cells."""
    return _seeded_index(collection, math.isqrt)


def fine_index(collection: DataFrame) -> IvfIndex:
    """n/4 cells, so that probe widths matter on small tables too."""
    return _seeded_index(collection, lambda n: n // 4)


def middle_index(collection: DataFrame, stored: bool = False) -> IvfIndex:
    """Four times the square root of n cells: probe widths matter, and cells stay few at any size."""
    return _seeded_index(collection, lambda n: 4 * math.isqrt(n), stored)


def _date(seconds: float) -> str:
    from datetime import datetime, timezone

    return datetime.fromtimestamp(math.floor(seconds), timezone.utc).strftime("%Y-%m-%d %H:%M:%S")


def workload_parts(histogram: Histogram2D) -> dict[str, dict[int, list[Predicate]]]:
    """Evenly spread predicate lists from the histogram's own edges: single, dual and selective ones."""
    numbers = [math.floor(v) for v in histogram.number_edges]
    dates = [_date(v) for v in histogram.date_edges]
    last = len(numbers) - 1
    at_least = lambda key, v: Predicate(key, v, ">=")
    single = {i: [at_least("token_count", numbers[i])] for i in range(1, last)}
    single |= {10 + i: [at_least("revdate", dates[i])] for i in range(1, last)}
    dual = {20 + i: [at_least("token_count", numbers[i]), at_least("revdate", dates[i])] for i in range(1, last)}
    selective = {
        31: [
            at_least("token_count", numbers[last - 1]),
            at_least("revdate", dates[last - 1]),
            Predicate("token_count", numbers[last], "<"),
        ],
        32: [Predicate("token_count", numbers[1], "<="), Predicate("revdate", dates[1], "<")],
        33: [Predicate("token_count", numbers[last // 2], "="), Predicate("revdate", dates[1], ">")],
        34: [Predicate("token_count", numbers[1:last:3], "IN"), Predicate("revdate", dates[last // 2], "=")],
        35: [Predicate("token_count", numbers[2], ">"), Predicate("token_count", numbers[3], "<=")],
    }
    return {"single": single, "dual": dual, "selective": selective}


def telemetry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events read as timed sections (method, run_id, section, ms), plus one total row per run."""
    # Which event stands for which section, which user group for which method.
    sections = {
        "view": "FAISS_SEARCH",
        "click": "DB_SEARCH",
        "error": "UD_PARAMS",
        "signup": "INTERSECT",
        "purchase": "FINALIZE",
    }
    methods = ("BASE_PRE_SEARCH", "ADAP_PRE_SEARCH", "BASE_POS_SEARCH", "ADAP_POS_SEARCH")
    mapping = F.create_map(*[F.lit(x) for pair in sections.items() for x in pair])
    rows = table(spark, sf_dir, "events").select(
        F.get(F.array(*[F.lit(m) for m in methods]), F.col("user_id") % 4).alias("method"),
        F.col("user_id").alias("run_id"),
        mapping[F.col("event_type")].alias("section"),
        F.col("value").alias("ms"),
    )
    totals = rows.groupBy("method", "run_id").agg((F.sum("ms") + 1).alias("ms"))
    return rows.unionByName(totals.withColumn("section", F.lit("TOTAL")))


# Predicate lists and result sizes that stand-in runs and batch entries take turns with.
RUN_LISTS = {
    1: [Predicate("token_count", 500, "<"), Predicate("revdate", "2024-01-01 06:00", ">=")],
    2: [Predicate("token_count", 300, ">=")],
    3: [],
    4: [Predicate("item_id", [], "IN")],
}
RUN_SIZES = (3, 10, 25)


def timed_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The telemetry with a predicate list and a k for each run."""
    k = F.get(F.array(*[F.lit(n) for n in RUN_SIZES]), (F.col("run_id") % len(RUN_SIZES)).cast("int"))
    wid = (F.col("run_id") % len(RUN_LISTS) + 1).cast("int")
    return telemetry(spark, sf_dir).withColumn("wid", wid).withColumn("k", k)


def predicate_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events read as a predicate table with every kind of flaw: unknown keys and operators, IN without a
    list, dates in several layouts and dates that are none."""
    # What an event type or a user group stands for.
    keys = {"view": "token_count", "click": "revdate", "error": "item_id", "signup": "title", "purchase": "revdate"}
    operators = ("=", ">", "<", ">=", "<=", "IN", "!=")
    key_map = F.create_map(*[F.lit(x) for pair in keys.items() for x in pair])
    return (
        table(spark, sf_dir, "events")
        .select(
            "event_id",
            "ts",
            key_map[F.col("event_type")].alias("key"),
            F.get(F.array(*[F.lit(o) for o in operators]), F.col("user_id") % 7).alias("operator"),
            (F.col("event_id") % 2 == 0).alias("is_list"),
        )
        .select("event_id", "key", "operator", date_layouts(F.col("event_id"), F.col("ts")).alias("value"), "is_list")
    )


def date_layouts(number, moment):
    """A date as text in one of five layouts, the last of which is none."""
    full = moment_text(moment)
    return (
        F.when(number % 5 == 0, full)
        .when(number % 5 == 1, F.substring(full, 1, 16))
        .when(number % 5 == 2, F.substring(full, 1, 10))
        .when(number % 5 == 3, F.concat(F.translate(full, " ", "T"), F.lit("Z")))
        .otherwise(F.concat(F.lit("junk "), full))
    )



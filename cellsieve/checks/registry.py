"""Every operator as a query over the given tables: name -> callable(spark, sf_dir) -> DataFrame."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cellsieve.checks import standins as st
from cellsieve.functions.dates import load_date
from cellsieve.functions.text import embed_text
from cellsieve.functions.values import flatten_to_text
from cellsieve.functions.vectors import inner_product, l2_normalize, settle
from cellsieve.operators import ingest, ivf, pq
from cellsieve.operators import predicates as preds
from cellsieve.operators.histogram import Histogram2D
from cellsieve.operators.predicates import Predicate
from cellsieve.operators.scoring import exact_knn, unit_queries
from cellsieve.plans import evaluate, hybrid, probing, sweep, workload
from cellsieve.plans.build import build_index
from cellsieve.plans.service import embed_queries, perform_search
from cellsieve.schemas import DISPLAY_COLUMNS, ITEM_COLUMNS
from cellsieve.session import configure, cut, scratch_path
from cellsieve.sources import tables
from cellsieve.streaming.incremental import start_incremental_add
from cellsieve.streaming.store import Store

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

K = 10
NPROBE = 4
FILTER = [Predicate("token_count", 500, "<"), Predicate("revdate", "2024-01-01 06:00", ">=")]
RECTANGLE = ((100_000.0, 300_000.0), ("1996-06-01", "1999-06-01"))


def named(name: str) -> Callable[[Query], Query]:
    def register(function: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return function(configure(spark), sf_dir)

        QUERIES[name] = run
        return function

    return register


def query(function: Query) -> Query:
    return named(function.__name__)(function)


def _rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in columns})


def _ranked(df: DataFrame) -> DataFrame:
    return df.select("qid", "rank", "item_id", "similarity")


# -------------------------------------------------------------------------------------- sources, sinks, ingest


@query
def source_first_n(spark, sf_dir):
    return ingest.first_rows(st.table(spark, sf_dir, "orders"), "o_orderkey", 1000)


@query
def source_file_order(spark, sf_dir):
    return ingest.first_in_file_order(st.table(spark, sf_dir, "orders"), 1000)


def _raw_documents(spark, sf_dir):
    """Documents as raw article text rows."""
    return flatten_to_text(
        st.documents_as_items(spark, sf_dir).withColumnRenamed("ext_id", "id"),
        ["item_id", "id", "title", "text", "url", "revdate", "token_count", "entity"],
    )


@query
def csv_roundtrip(spark, sf_dir):
    path = scratch_path(spark, "articles")
    tables.write_csv(_raw_documents(spark, sf_dir), path)
    return tables.read_csv(spark, path).select(
        "item_id", "title", "text", F.coalesce("url", F.lit("")).alias("url"), "revdate", "token_count", "entity"
    )


@query
def csv_foreign(spark, sf_dir):
    """CSV as other programs write it, line breaks, quotes and backslashes inside quoted values, columns by name."""
    path = scratch_path(spark, "foreign")
    texts = st.table(spark, sf_dir, "documents").select(
        "source", F.concat(F.lit('say "'), F.col("lang"), F.lit('" \\nabla\n, ')).alias("title"), "doc_id", "text"
    )
    plain = {"ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}
    texts.write.options(header="true", quoteAll="true", quote='"', escape='"', **plain).csv(path)
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("title", T.StringType()), T.StructField("text", T.StringType())])
    return tables.read_csv(spark, path, schema)


@query
def csv_escaped(spark, sf_dir):
    """The same through files of one line per row."""
    path = scratch_path(spark, "escaped")
    texts = st.table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit('"\\\\nabla\n'), F.col("text")).alias("text"))
    tables.write_csv(texts, path, escaped=True)
    return tables.read_csv(spark, path, texts.schema, escaped=True)


@query
def items_build(spark, sf_dir):
    typed = ingest.typed_items(_raw_documents(spark, sf_dir))
    return tables.create_items(typed, scratch_path(spark, "items")).withColumn("url", F.coalesce("url", F.lit("")))


@query
def items_load(spark, sf_dir):
    raw = _raw_documents(spark, sf_dir)
    labelled = st.table(spark, sf_dir, "labels").select(F.col("doc_id").cast("string").alias("item_id"))
    path = scratch_path(spark, "items")
    tables.create_items(ingest.typed_items(raw.join(labelled, "item_id", "left_semi")), path)
    tables.append_items(raw.join(labelled, "item_id", "left_anti"), path)
    return (
        tables.read_items(spark, path)
        .groupBy("entity")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.sum("token_count").alias("tokens"),
            F.min("revdate").alias("first_date"),
            F.max("item_id").alias("last_id"),
        )
    )


@query
def value_to_text(spark, sf_dir):
    roles = (
        st.table(spark, sf_dir, "conversations")
        .groupBy(F.col("conv_id").alias("doc_id"))
        .agg(F.array_sort(F.collect_set("role")).alias("categories"), F.max("turn").alias("turns"))
    )
    marks = st.table(spark, sf_dir, "labels").select("doc_id", F.struct("quality", "toxic").alias("marks"))
    joined = (
        st.table(spark, sf_dir, "documents")
        .join(roles, "doc_id", "left")
        .join(marks, "doc_id", "left")
    )
    return flatten_to_text(joined, ["doc_id", "text", "lang", "categories", "marks", "turns", "absent"])


@query
def date_normalize(spark, sf_dir):
    events = st.table(spark, sf_dir, "events")
    return events.select("event_id", load_date(st.date_layouts(F.col("event_id"), F.col("ts"))).alias("revdate"))


@query
def assign_item_ids(spark, sf_dir):
    return ingest.assign_item_ids(st.table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"))


@query
def pk_violations(spark, sf_dir):
    lines = st.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("item_id"))
    return ingest.key_violations(lines)


@query
def count_items(spark, sf_dir):
    return st.items(spark, sf_dir).agg(F.count(F.lit(1)).alias("n"))


@query
def block_shuffle(spark, sf_dir):
    events = st.table(spark, sf_dir, "events").select("event_id")
    return ingest.block_shuffle(events, "event_id", 1000)


@query
def train_sample(spark, sf_dir):
    return ivf.train_sample(st.table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), "o_orderkey", 600)


@query
def point_lookup(spark, sf_dir):
    collection = st.items(spark, sf_dir).select(*ITEM_COLUMNS)
    return tables.item_by_id(collection, 7)


@query
def display_projection(spark, sf_dir):
    found = exact_knn(st.unit_items(spark, sf_dir), st.prototypes(spark, sf_dir, None), 20)
    return ingest.display(found.join(st.items(spark, sf_dir).select(*DISPLAY_COLUMNS), "item_id"))


# ------------------------------------------------------------------------------------------------- predicates


def _filtered(name: str, *predicates: Predicate) -> None:
    def run(spark, sf_dir):
        return preds.predicate_filter(st.items(spark, sf_dir).select(*ITEM_COLUMNS), predicates)

    named(name)(run)


_filtered("pred_empty")
_filtered("pred_id_eq", Predicate("item_id", 1, "="))
_filtered("pred_id_gt", Predicate("item_id", 5, ">"))
_filtered("pred_id_le", Predicate("item_id", 10, "<="))
_filtered("pred_token_lt", Predicate("token_count", 150, "<"))
_filtered("pred_date_ge", Predicate("revdate", "2024-01-01 06:00", ">="))
_filtered("pred_id_in", Predicate("item_id", [1, 2, 3, 4, 5, 10_000_000], "IN"))
_filtered("pred_id_in_empty", Predicate("item_id", [], "IN"))
_filtered(
    "pred_and_range",
    Predicate("token_count", 100, ">"),
    Predicate("token_count", 1000, "<"),
    Predicate("revdate", "2024-01-01", ">="),
)


@query
def pred_id_in_long(spark, sf_dir):
    """The list of pred_id_in, past the bound for literals and with values no id can have."""
    values = [1, 2, 3, 4, 5, 10_000_000, 5_000_000_000, 1, 2]
    return preds.predicate_filter(st.items(spark, sf_dir).select(*ITEM_COLUMNS), [Predicate("item_id", values, "IN")], literals=2)


@query
def predicate_validate(spark, sf_dir):
    return preds.validated(st.predicate_table(spark, sf_dir)).select("event_id", "key", "operator", "is_list", "problem")


@query
def predicate_dates(spark, sf_dir):
    return preds.normalized_dates(st.predicate_table(spark, sf_dir), "value").select("event_id", "normalized")


@query
def workload_survivors(spark, sf_dir):
    orders = st.big_items(spark, sf_dir)
    parts = st.workload_parts(Histogram2D.build(orders))
    return preds.workload_survivors(orders, parts["single"] | parts["dual"] | parts["selective"])


@query
def workload_union(spark, sf_dir):
    parts = st.workload_parts(Histogram2D.build(st.big_items(spark, sf_dir)))
    frames = [evaluate.workload_frame(spark, lists, kind) for kind, lists in parts.items()]
    whole = frames[0].unionByName(frames[1]).unionByName(frames[2])
    return whole.select("wid", "kind", "predicates")


@query
def workload_grid(spark, sf_dir):
    parts = st.workload_parts(Histogram2D.build(st.big_items(spark, sf_dir)))
    frame = evaluate.workload_frame(spark, parts["single"] | parts["dual"], "all")
    grid = evaluate.workload_grid(frame, evaluate.K_VALUES, hybrid.METHODS)
    return grid.select("wid", "predicates", "k", "method")


# ------------------------------------------------------------------------------------------------- histogram


@query
def hist2d_edges(spark, sf_dir):
    return _rounded(Histogram2D.build(st.big_items(spark, sf_dir)).edges(), "value")


@query
def hist2d_counts(spark, sf_dir):
    return Histogram2D.build(st.big_items(spark, sf_dir)).grid()


@query
def hist2d_rectangle(spark, sf_dir):
    numbers, dates = RECTANGLE
    seconds = [Predicate("revdate", d, "=").numbers()[0] for d in dates]
    return Histogram2D.build(st.big_items(spark, sf_dir)).rectangle_sum(numbers, tuple(seconds))


@query
def hist2d_estimate(spark, sf_dir):
    histogram = Histogram2D.build(st.big_items(spark, sf_dir))
    some = [Predicate("token_count", 123_456, ">="), Predicate("revdate", "1997-03-05 12:00", "<")]
    return spark.createDataFrame([(histogram.estimate(some),)], "est bigint")


@query
def hist2d_estimate_workload(spark, sf_dir):
    histogram = Histogram2D.build(st.big_items(spark, sf_dir))
    parts = st.workload_parts(histogram)
    whole = evaluate.workload_frame(spark, parts["single"] | parts["dual"] | parts["selective"], "all")
    return evaluate.estimate_workload(whole, histogram).select("wid", "est")


@query
def hist2d_summary(spark, sf_dir):
    summary = Histogram2D.build(st.big_items(spark, sf_dir)).summary()
    return _rounded(summary, "non_empty_pct", "avg_per_bin", "avg_per_non_empty_bin")


@query
def hist2d_table(spark, sf_dir):
    return Histogram2D.build(st.big_items(spark, sf_dir)).labelled_grid()


@query
def hist2d_date_labels(spark, sf_dir):
    return Histogram2D.build(st.big_items(spark, sf_dir)).date_labels()


@query
def hist2d_edges_df(spark, sf_dir):
    return _rounded(Histogram2D.build(st.big_items(spark, sf_dir)).date_edge_table(), "revdate_ts")


@query
def hist2d_save_load(spark, sf_dir):
    path = scratch_path(spark, "histogram")
    tables.save_histogram(Histogram2D.build(st.big_items(spark, sf_dir)), path)
    return tables.load_histogram(spark, path).grid()


@query
def est_vs_actual(spark, sf_dir):
    orders = st.big_items(spark, sf_dir)
    histogram = Histogram2D.build(orders).collected()
    parts = st.workload_parts(histogram)
    lists = parts["single"] | parts["dual"]
    frame = evaluate.workload_frame(spark, lists, "all")
    return _rounded(evaluate.estimates_and_actuals(orders, frame, lists, histogram), "relative_error")


# --------------------------------------------------------------------------------------------- exact vector search


@named("l2_normalize")
def l2_normalize_vectors(spark, sf_dir):
    scaled = st.table(spark, sf_dir, "embeddings").select(
        "vec_id", F.transform("embedding", lambda x: (x * (F.col("label") + 1)).cast("float")).alias("v")
    )
    unit = scaled.select("vec_id", F.posexplode(l2_normalize("v")).alias("pos", "x"))
    return unit.select("vec_id", "pos", F.round(F.col("x").cast("double"), 6).alias("x"))


@named("embed_text")
def embed_text_documents(spark, sf_dir):
    docs = st.table(spark, sf_dir, "documents")
    exploded = docs.select("doc_id", F.posexplode(embed_text(F.col("text"))).alias("pos", "x"))
    return exploded.filter("x <> 0").select("doc_id", "pos", F.round(F.col("x").cast("double"), 6).alias("x"))


@query
def knn_exact(spark, sf_dir):
    return _ranked(exact_knn(st.unit_items(spark, sf_dir), st.prototypes(spark, sf_dir, None), 25))


@query
def knn_exact_joined(spark, sf_dir):
    """knn_exact where not even one query may be broadcast."""
    return _ranked(exact_knn(st.unit_items(spark, sf_dir), st.prototypes(spark, sf_dir, None), 25, block_bytes=0))


@query
def knn_exact_batch(spark, sf_dir):
    embeddings = st.table(spark, sf_dir, "embeddings")
    vectors = embeddings.select(F.col("vec_id").alias("item_id"), l2_normalize("embedding").alias("embedding"))
    asked = embeddings.where("vec_id % 20 = 0").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("qvec"))
    return _ranked(exact_knn(vectors, asked, K))


@query
def knn_id_filtered(spark, sf_dir):
    allowed = st.table(spark, sf_dir, "labels").filter("quality = 1").select(F.col("doc_id").alias("item_id"))
    index = st.coarse_index(st.items(spark, sf_dir))
    return _ranked(index.search(st.prototypes(spark, sf_dir), K, index.nlist, allowed=allowed))


@query
def intersect(spark, sf_dir):
    collection = st.unit_items(spark, sf_dir)
    candidates = exact_knn(collection, st.prototypes(spark, sf_dir), 50)
    kept = ingest.intersect(candidates, preds.predicate_filter(collection.drop("embedding"), FILTER))
    return kept.select("qid", "item_id", "title", "token_count", "similarity")


# ------------------------------------------------------------------------------------------------------ cells


@query
def ivf_assign(spark, sf_dir):
    return st.coarse_index(st.items(spark, sf_dir)).vectors.select("item_id", "cell_id")


@query
def ivf_cell_sizes(spark, sf_dir):
    return st.coarse_index(st.items(spark, sf_dir)).cell_sizes()


@query
def ivf_probe(spark, sf_dir):
    probes = st.coarse_index(st.items(spark, sf_dir)).probe(unit_queries(st.prototypes(spark, sf_dir)), NPROBE)
    flat = probes.select("qid", F.posexplode(F.arrays_zip("cells", "cell_sims")).alias("pos", "p"))
    return flat.select(
        "qid", (F.col("pos") + 1).alias("rank"), F.col("p.cells").alias("cell_id"), F.col("p.cell_sims").alias("similarity")
    )


@query
def ivf_probe_tree(spark, sf_dir):
    """The nearest cells of every document among n/4 cells, found by groups of centroids."""
    documents = cut(st.document_vectors(spark, sf_dir).select("item_id", "embedding"))
    seeds = st.seed_centroids(documents, documents.count() // 4)
    cells = ivf.Cells(cut(seeds), tree_cells=1)
    near = ivf.nearest_cells(documents, cells, "embedding", NPROBE, "item_id")
    return near.select("item_id", F.posexplode("cells").alias("pos", "cell_id")).select(
        "item_id", (F.col("pos") + 1).alias("rank"), "cell_id"
    )


@query
def ivf_search(spark, sf_dir):
    index = st.coarse_index(st.items(spark, sf_dir))
    return _ranked(index.search(st.prototypes(spark, sf_dir), K, NPROBE))


@query
def ivf_search_joined(spark, sf_dir):
    """ivf_search where not even one query may be broadcast."""
    index = st.coarse_index(st.items(spark, sf_dir))
    return _ranked(index.search(st.prototypes(spark, sf_dir), K, NPROBE, block_bytes=0))


@query
def ivf_search_blocks(spark, sf_dir):
    """ivf_search where a few queries at a time may be broadcast: each block reads the cells it probes."""
    index = st.coarse_index(st.items(spark, sf_dir))
    path = scratch_path(spark, "index")
    tables.save_index(index, path)
    return _ranked(tables.load_index(spark, path).search(st.prototypes(spark, sf_dir), K, NPROBE, block_bytes=5000))


@query
def ivf_assign_joined(spark, sf_dir):
    """ivf_assign where the centroids may not be broadcast."""
    placed = st.coarse_index(st.items(spark, sf_dir))
    joined = ivf.Cells(placed.cells.frame, matrix_bytes=0)
    return ivf.assign_cells(placed.vectors.drop("cell_id"), joined).select("item_id", "cell_id")


@query
def ivf_save_load(spark, sf_dir):
    path = scratch_path(spark, "index")
    tables.save_index(st.coarse_index(st.items(spark, sf_dir)), path)
    loaded = tables.load_index(spark, path)
    sizes = loaded.cell_sizes()
    return sizes.withColumn("total", F.lit(loaded.total)).withColumn("nlist", F.lit(loaded.nlist))


def _unit_cells(cells: ivf.Cells) -> dict:
    """cells, unit: centroids, and how many of them have length one."""
    norm = F.sqrt(F.aggregate("centroid", F.lit(0.0), lambda t, x: t + x * x))
    found = cells.frame.agg(F.count(F.lit(1)).alias("cells"), F.count_if(F.abs(norm - 1) < 1e-6).alias("unit")).head()
    return {name: F.lit(found[name]).cast("bigint") for name in ("cells", "unit")}


def _misplaced(vectors: DataFrame, cells: ivf.Cells) -> DataFrame:
    """(stored, ids, misplaced): rows, distinct ids, and rows for which another cell is nearer than their own. The few
    cells are met by an explode and a join, apart from the code that placed the rows."""
    names = [r["cell_id"] for r in cells.frame.select("cell_id").collect()]
    others = cells.frame.select(F.col("cell_id").alias("other"), "centroid")
    pairs = vectors.select("item_id", "cell_id", "embedding", F.explode(F.array(*map(F.lit, names))).alias("other"))
    scored = pairs.join(others, "other").withColumn("sim", settle(inner_product(F.col("centroid"), F.col("embedding"))))
    best = scored.groupBy("item_id").agg(
        F.max_by("other", F.struct("sim", F.negative("other"))).alias("best"), F.first("cell_id").alias("own"), F.count(F.lit(1)).alias("n")
    )
    return best.agg(
        (F.sum("n") / len(names)).cast("bigint").alias("stored"),
        F.count(F.lit(1)).alias("ids"),
        F.count_if(F.col("best") != F.col("own")).alias("misplaced"),
    )


@query
def ivf_train(spark, sf_dir):
    """What training must give whatever the sample: unit centroids, rows at their nearest one, similarity to it no
    worse than that to the seeds."""
    collection = cut(st.unit_items(spark, sf_dir).select("item_id", "embedding"))
    trained = ivf.Cells(cut(ivf.train_centroids(ivf.train_sample(collection, "item_id", 100_000), 16)))

    def fit_of(cells):
        near = ivf.nearest_cells(collection, cells, "embedding", 1, "item_id")
        return near.agg(F.sum(F.col("cell_sims")[0])).head()[0]

    better = fit_of(trained) >= fit_of(ivf.Cells(cut(st.seed_centroids(collection, 16))))
    placed = cut(ivf.assign_cells(collection, trained))
    return _misplaced(placed, trained).withColumns(_unit_cells(trained) | {"better_than_seeds": F.lit(better)})


@query
def kmeans_step(spark, sf_dir):
    collection = cut(st.unit_items(spark, sf_dir).select("item_id", "embedding"))
    seeds = cut(st.seed_centroids(collection, 16))
    stepped = ivf.kmeans_step(collection, seeds)
    return stepped.select("cell_id", "members", F.posexplode("centroid").alias("pos", "x")).select(
        "cell_id", "members", "pos", F.round("x", 6).alias("x")
    )


@query
def recall_at_k(spark, sf_dir):
    index, queries = st.coarse_index(st.items(spark, sf_dir)), st.prototypes(spark, sf_dir)
    found = index.search(queries, K, NPROBE)
    return _rounded(evaluate.recall_at_k(found, exact_knn(index.vectors, queries, K)), "recall")


# ------------------------------------------------------------------------------------------------------ codes

PQ_M, PQ_BITS = 8, 4


def _seed_codes(spark, sf_dir):
    """A coarse index, its residuals, and codebooks seeded from them."""
    index = st.coarse_index(st.items(spark, sf_dir))
    with_residual = pq.residuals(index.vectors, index.cells)
    books = pq.seed_codebooks(with_residual, PQ_M, PQ_BITS, ivf.SEED, "item_id")
    return index, with_residual, books


def _code_index(spark, sf_dir):
    index, _, books = _seed_codes(spark, sf_dir)
    frame = cut(pq.codebook_frame(spark, books))
    coded = cut(pq.encode(index.vectors, index.cells, frame))
    return replace(index, vectors=coded, codebooks=frame, pq_m=PQ_M, pq_bits=PQ_BITS)


@query
def pq_encode(spark, sf_dir):
    index = _code_index(spark, sf_dir)
    return index.vectors.select("item_id", "cell_id", F.posexplode("code").alias("m", "j")).select(
        "item_id", "cell_id", "m", F.col("j").cast("int").alias("j")
    )


@query
def pq_codebook_step(spark, sf_dir):
    _, with_residual, books = _seed_codes(spark, sf_dir)
    stepped = pq.codebook_step(with_residual, books)
    return stepped.select("m", "j", "members", F.posexplode("codeword").alias("pos", "x")).select(
        "m", "j", "members", "pos", F.round("x", 6).alias("x")
    )


@query
def pq_adc_search(spark, sf_dir):
    index = _code_index(spark, sf_dir)
    return _ranked(index.search(st.prototypes(spark, sf_dir), K, NPROBE, scoring="codes"))


@query
def pq_rerank(spark, sf_dir):
    index = _code_index(spark, sf_dir)
    queries = st.prototypes(spark, sf_dir)
    return _ranked(index.rerank(index.search(queries, 5 * K, NPROBE, scoring="codes"), queries, K))


@query
def pq_train(spark, sf_dir):
    """Codebooks of full shape whose error is no larger than that of the seeds they started from."""
    index, with_residual, seeds = _seed_codes(spark, sf_dir)
    with_residual = cut(with_residual)
    books = cut(pq.train_codebooks(index.vectors, index.cells, PQ_M, PQ_BITS, iterations=5))
    better = pq.codebook_error(with_residual, pq.codebook_array(books)) <= pq.codebook_error(with_residual, seeds)
    shape = books.groupBy("m").agg(F.count(F.lit(1)).alias("codes"), F.max(F.size("codeword")).alias("width"))
    return shape.withColumn("no_worse_than_seeds", F.lit(better))


# ----------------------------------------------------------------------------------------------- hybrid methods


@query
def probe_params_pre(spark, sf_dir):
    sizes = st.table(spark, sf_dir, "orders").select(
        "o_orderkey",
        (F.col("o_custkey") * 7 + 1).alias("survivors"),
        (F.col("o_orderkey") % 1000 + 1).alias("k_remaining"),
        (F.col("o_orderkey") % 13).alias("old_nprobe"),
    )
    width = probing.pre_nprobe(F.col("survivors"), F.col("k_remaining"), F.col("old_nprobe"), 512)
    return sizes.withColumn("nprobe", width)


@query
def probe_params_pos(spark, sf_dir):
    sizes = st.table(spark, sf_dir, "orders").select(
        "o_orderkey",
        (F.col("o_custkey") * 7).alias("est"),
        (F.col("o_orderkey") % 1000 + 1).alias("k_remaining"),
        (F.col("o_orderkey") % 17 * 50).alias("old_search_k"),
    )
    search_k = probing.post_search_k(F.col("est"), F.col("k_remaining"), F.col("old_search_k"), 150_000)
    sized = sizes.withColumn("search_k", search_k)
    return sized.withColumn("nprobe", probing.post_nprobe(F.col("est"), F.col("search_k"), F.lit(0), 512))


def _hybrid(spark, sf_dir, *methods):
    index = st.fine_index(st.items(spark, sf_dir))
    queries = st.prototypes(spark, sf_dir)
    histogram = Histogram2D.build(index.vectors) if hybrid.ADAP_POS in methods else None
    return {m: hybrid.filtered_search(index, queries, FILTER, K, m, histogram) for m in methods}


def _hybrid_query(name: str, method: str) -> None:
    def run(spark, sf_dir):
        return hybrid.with_items(_hybrid(spark, sf_dir, method)[method], st.items(spark, sf_dir))

    named(name)(run)


_hybrid_query("hybrid_base_pre", hybrid.BASE_PRE)
_hybrid_query("hybrid_adap_pre", hybrid.ADAP_PRE)
_hybrid_query("hybrid_base_pos", hybrid.BASE_POS)
_hybrid_query("hybrid_adap_pos", hybrid.ADAP_POS)


@query
def hybrid_base_pos_counted(spark, sf_dir):
    """hybrid_base_pos where no candidate list is short enough to be ranked."""
    index = st.fine_index(st.items(spark, sf_dir))
    found = hybrid.post_filter_search(index, st.prototypes(spark, sf_dir), FILTER, K, ranked=0)
    return hybrid.with_items(found, st.items(spark, sf_dir))


@query
def hybrid_compare(spark, sf_dir):
    return evaluate.compare_methods(_hybrid(spark, sf_dir, *hybrid.METHODS))


@query
def hybrid_compare_order(spark, sf_dir):
    return evaluate.compare_orders(_hybrid(spark, sf_dir, *hybrid.METHODS), st.prototypes(spark, sf_dir))


@query
def workload_sweep(spark, sf_dir):
    index = st.fine_index(st.items(spark, sf_dir))
    lists = {1: FILTER, 2: [Predicate("token_count", 1000, ">=")]}
    swept = evaluate.sweep(
        index, cut(st.prototypes(spark, sf_dir)), lists, (5, 50), hybrid.METHODS, Histogram2D.build(index.vectors).collected()
    )
    path = scratch_path(spark, "evaluation")
    tables.write_csv(swept, path)
    return tables.read_csv(spark, path, swept.schema)


@query
def workload_sweep_ids(spark, sf_dir):
    """All of the workload's predicate lists, all k and all methods over all documents: what each search found, as a
    digest of its ids in order."""
    documents = cut(st.document_vectors(spark, sf_dir).select(*st.CARRIED, "embedding"))
    index = st.middle_index(documents, stored=True)
    histogram = Histogram2D.build(documents).collected()
    parts = st.workload_parts(histogram)
    lists = parts["single"] | parts["dual"] | parts["selective"]
    found = sweep.sweep_search(index, st.prototypes(spark, sf_dir), lists, evaluate.K_VALUES, hybrid.METHODS, histogram)
    ids = F.array_sort(F.collect_list(F.struct("rank", "item_id")))
    return found.groupBy("qid", "wid", "k", "method").agg(
        F.count(F.lit(1)).alias("found"),
        F.any_value("is_k").alias("is_k"),
        F.md5(F.array_join(F.transform(ids, lambda x: x["item_id"].cast("string")), ",")).alias("ids"),
    )


@query
def hybrid_service(spark, sf_dir):
    documents = cut(st.document_vectors(spark, sf_dir))
    texts = st.table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), "text")
    wanted = [
        {"key": "token_count", "value": 400, "operator": "<"},
        {"key": "revdate", "value": "2024-01-01 03:00", "operator": ">="},
        {"key": "entity", "value": "src1", "operator": "="},
    ]
    return perform_search(st.coarse_index(documents), documents, texts, K, wanted, hybrid.ADAP_PRE)


@named("embed_queries")
def embed_queries_benchmark(spark, sf_dir):
    texts = st.table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), "text")
    exploded = embed_queries(texts).select("qid", F.posexplode("qvec").alias("pos", "x"))
    return exploded.filter("x <> 0").select("qid", "pos", F.round(F.col("x").cast("double"), 6).alias("x"))


@query
def telemetry_rollup(spark, sf_dir):
    rolled = evaluate.telemetry_rollup(st.telemetry(spark, sf_dir))
    times = ("total", "db_search", "histo_filter", "faiss_search", "ud_params", "intersect", "finalize", "residual")
    return _rounded(rolled, *times)


@query
def telemetry_frame(spark, sf_dir):
    items = st.documents_as_items(spark, sf_dir).select("item_id", "revdate", "token_count")
    lists = evaluate.workload_frame(spark, st.RUN_LISTS, "all")
    rolled = evaluate.telemetry_frame(st.timed_runs(spark, sf_dir), lists, preds.workload_survivors(items, st.RUN_LISTS))
    return _rounded(rolled, "total", "db_search", "faiss_search", "residual").select(
        "method", "wid", "k", "predicates", "survivors", "num_runs", "iterations", "iterations_consistent",
        "total", "db_search", "faiss_search", "residual",
    )


@query
def workload_search(spark, sf_dir):
    """Each benchmark text with each predicate list, k by turns, over the text collection."""
    documents = cut(st.document_vectors(spark, sf_dir).select(*st.CARRIED, "embedding"))
    texts = st.table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), "text")
    k = F.get(F.array(*[F.lit(n) for n in st.RUN_SIZES]), (F.col("qid") % len(st.RUN_SIZES)).cast("int"))
    entries = embed_queries(texts).withColumn("wid", F.explode(F.array(*[F.lit(w) for w in st.RUN_LISTS])))
    entries = entries.select((F.col("qid") * 10 + F.col("wid")).alias("eid"), "qvec", "wid", k.alias("k"))
    return workload.workload_search(st.coarse_index(documents), entries, st.RUN_LISTS)


# ---------------------------------------------------------------------------------------------- build and stream


@query
def ivf_build(spark, sf_dir):
    documents = st.documents_as_items(spark, sf_dir).select("item_id", "text", "revdate", "token_count")
    index = build_index(
        documents, scratch_path(spark, "index"), nlist=16, pq_m=PQ_M, pq_bits=PQ_BITS, train_size=5000, max_iter=5
    )
    fresh = pq.encode(index.vectors.drop("code"), index.cells, index.codebooks)
    both = index.vectors.select("item_id", "code").join(fresh.select("item_id", F.col("code").alias("again")), "item_id")
    wrong = both.where(F.coalesce(F.col("code") != F.col("again"), F.lit(True))).count()
    more = {"wrong_codes": F.lit(wrong).cast("bigint"), "total": F.lit(index.total).cast("bigint")}
    return _misplaced(index.vectors, index.cells).withColumns(_unit_cells(index.cells) | more)


@query
def incremental_add(spark, sf_dir):
    documents = cut(st.document_vectors(spark, sf_dir))
    labelled = st.table(spark, sf_dir, "labels").select(F.col("doc_id").alias("item_id")).distinct()
    centroids = cut(st.seed_centroids(documents, 16))
    first = ivf.index_items(
        documents.join(labelled, "item_id", "left_semi").select("item_id", "token_count", "embedding"), centroids
    )
    path = scratch_path(spark, "growing")
    tables.save_index(first, path)
    source = st.table(spark, sf_dir, "documents").schema

    def prepare(batch):
        return batch.select(
            F.col("doc_id").alias("item_id"),
            st.token_count(F.col("text")).alias("token_count"),
            embed_text(F.col("text")).alias("embedding"),
        )

    adding = start_incremental_add(
        spark, tables.load_index(spark, path), f"{sf_dir}/documents*.parquet", source, f"{path}/vectors",
        f"{path}/progress", prepare,
    )
    adding.awaitTermination()
    grown = spark.read.parquet(f"{path}/vectors")
    return grown.select("item_id", F.col("cell_id").cast("bigint").alias("cell_id"), "token_count")


@query
def incremental_store(spark, sf_dir):
    """All documents streamed onto those that have labels: codes, dates and items of everything stored."""
    documents = cut(st.document_vectors(spark, sf_dir))
    placed = ivf.index_items(documents.select(*st.CARRIED, "embedding"), cut(st.seed_centroids(documents, 16)))
    with_residual = pq.residuals(placed.vectors, placed.cells)
    books = cut(pq.codebook_frame(spark, pq.seed_codebooks(with_residual, PQ_M, PQ_BITS, ivf.SEED, "item_id")))
    labelled = st.table(spark, sf_dir, "labels").select(F.col("doc_id").alias("item_id")).distinct()
    first = documents.join(labelled, "item_id", "left_semi")
    path = scratch_path(spark, "store")
    Store.create(ivf.index_items(first.select(*st.CARRIED, "embedding"), placed.cells, books), first, path)
    store = Store.open(spark, path)
    dated = st.table(spark, sf_dir, "events").select(
        F.col("event_id").alias("item_id"), F.date_trunc("second", "ts").cast("timestamp_ntz").alias("revdate")
    )
    pages = st.table(spark, sf_dir, "pages").select(F.col("page_id").alias("item_id"), "url")

    def prepare(batch):
        rows = batch.select(
            F.col("doc_id").alias("item_id"),
            F.col("doc_id").alias("ext_id"),
            F.concat_ws(" ", "source", "lang", F.col("doc_id").cast("string")).alias("title"),
            st.token_count(F.col("text")).alias("token_count"),
            F.col("source").alias("entity"),
            embed_text(F.col("text")).alias("embedding"),
        )
        return rows.join(dated, "item_id").join(pages, "item_id", "left")

    source = st.table(spark, sf_dir, "documents").schema
    store.start(f"{sf_dir}/documents*.parquet", source, f"{path}/progress", prepare).awaitTermination()
    codes = F.array_join(F.transform("code", lambda c: c.cast("string")), ",")
    return store.items.join(store.vectors.select("item_id", "cell_id", codes.alias("codes")), "item_id").select(
        "item_id", "title", "url", "revdate", "token_count", "entity", "cell_id", "codes"
    )

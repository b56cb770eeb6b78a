import pytest
from pyspark.sql import functions as F

from cellsieve.checks import standins
from cellsieve.functions.text import embed_text, token_count
from cellsieve.operators import ivf
from cellsieve.operators.predicates import Predicate
from cellsieve.plans import hybrid
from cellsieve.plans.build import build_index
from cellsieve.session import cut, scratch_path
from cellsieve.sources import tables
from cellsieve.streaming.incremental import append_new, start_incremental_add


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def stored(spark, fine):
    path = scratch_path(spark, "index")
    tables.save_index(fine, path, {"model": "hash"})
    return tables.load_index(spark, path)


def test_saved_index_is_the_same(spark, fine, stored, queries):
    assert (stored.dim, stored.nlist, stored.total) == (fine.dim, fine.nlist, fine.total)
    key = ("qid", "rank", "item_id", "similarity")
    assert sorted(map(tuple, stored.search(queries, 9, 7).select(*key).collect())) == sorted(
        map(tuple, fine.search(queries, 9, 7).select(*key).collect())
    )


def test_probed_cells_and_predicates_reach_the_scan(stored, queries):
    one = queries.limit(1)
    text = plan(stored.search(one, 5, 3, where=F.col("token_count") < 300))
    assert "PartitionFilters: [cast(cell_id" in text or "cell_id#" in text.split("PartitionFilters:")[1][:200]
    assert "LessThan(token_count,300)" in text
    scan = text.split("ReadSchema:")[1]
    assert "embedding" in scan and "revdate" not in scan


def test_filtered_search_has_no_join_with_items(stored, queries):
    found = hybrid.filtered_search(stored, queries, [Predicate("token_count", 300, "<")], 5, hybrid.BASE_PRE)
    text = plan(found)
    assert "Join" not in text and "CartesianProduct" not in text
    assert "LessThan(token_count,300)" in text


def test_build_from_text(spark, sf_dir):
    documents = standins.documents_as_items(spark, sf_dir).select("item_id", "text", "token_count")
    with pytest.warns(UserWarning):
        index = build_index(
            documents, scratch_path(spark, "built"), nlist=8, pq_m=8, pq_bits=4, train_size=150, max_iter=3
        )
    assert index.total == documents.count() and index.nlist <= 8 and index.pq_m == 8
    queries = documents.limit(5).select(F.col("item_id").alias("qid"), embed_text(F.col("text")).alias("qvec"))
    own = index.search(queries, 1, index.nlist).filter(F.round("similarity", 5) >= 1)
    assert own.count() == 5
    assert index.search(queries, 3, index.nlist, scoring="codes").count() == 15


def test_stream_equals_batch_and_repeats_add_nothing(spark, sf_dir):
    documents = cut(standins.document_vectors(spark, sf_dir).select("item_id", "token_count", "embedding"))
    centroids = cut(standins.seed_centroids(documents, 8))
    batch = ivf.index_items(documents, centroids)
    path = scratch_path(spark, "growing")
    tables.save_index(ivf.index_items(documents.filter("item_id < 40"), centroids), path)
    index = tables.load_index(spark, path)

    def prepare(rows):
        return rows.select(
            F.col("doc_id").alias("item_id"),
            token_count(F.col("text")).alias("token_count"),
            embed_text(F.col("text")).alias("embedding"),
        )

    def grow(checkpoint):
        start_incremental_add(
            spark,
            index,
            f"{sf_dir}/documents*.parquet",
            spark.read.parquet(f"{sf_dir}/documents.parquet").schema,
            f"{path}/vectors",
            checkpoint,
            prepare,
        ).awaitTermination()

    grow(f"{path}/progress")
    grow(f"{path}/again")
    key = ("item_id", "cell_id", "token_count")
    read = lambda df: sorted((int(a), int(b), c) for a, b, c in df.select(*key).collect())
    assert read(spark.read.parquet(f"{path}/vectors")) == read(batch.vectors)
    append_new(index, documents.limit(5), f"{path}/vectors")
    assert spark.read.parquet(f"{path}/vectors").count() == documents.count()

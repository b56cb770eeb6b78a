"""Batches added to a stored collection, replays and failures among them; bounded reads; orders of results."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from cellsieve.checks import standins as st
from cellsieve.functions.text import embed_text
from cellsieve.operators import ingest, ivf, pq
from cellsieve.plans import evaluate
from cellsieve.schemas import ITEM_COLUMNS
from cellsieve.session import cut
from cellsieve.streaming.store import Store


@pytest.fixture(scope="module")
def documents(spark, sf_dir):
    return cut(st.document_vectors(spark, sf_dir).select(*ITEM_COLUMNS, "embedding"))


@pytest.fixture(scope="module")
def quantizers(spark, documents):
    cells = ivf.Cells(cut(st.seed_centroids(documents, 8)))
    placed = ivf.index_items(documents.select(*st.CARRIED, "embedding"), cells)
    books = pq.seed_codebooks(pq.residuals(placed.vectors, cells), 8, 4, 1, "item_id")
    return cells, cut(pq.codebook_frame(spark, books))


def store_of(spark, documents, quantizers, path):
    first = documents.filter("item_id % 3 = 0")
    return Store.create(ivf.index_items(first.select(*st.CARRIED, "embedding"), *quantizers), first, str(path))


def content(store):
    vectors = sorted((r["item_id"], r["cell_id"], tuple(r["code"]), str(r["revdate"]), r["token_count"]) for r in store.vectors.collect())
    return vectors, sorted((tuple(map(str, r)) for r in store.items.collect()))


def test_batches_replays_and_failures(spark, documents, quantizers, tmp_path, monkeypatch):
    store = store_of(spark, documents, quantizers, tmp_path)
    whole = ivf.index_items(documents.select(*st.CARRIED, "embedding"), *quantizers)
    batch = documents.filter("item_id % 3 <> 2")
    assert store.add(batch, 0) == documents.filter("item_id % 3 = 1").count()
    once = content(store)
    assert store.add(batch, 0) == documents.filter("item_id % 3 = 1").count()  # noted: left alone
    assert content(store) == once
    assert store.add(batch, 1) == 0  # the same items under another number
    assert content(store) == once

    # A failure between the two tables, and another before the ledger; then the batch runs again.
    rest = documents.filter("item_id % 3 = 2")
    for name in ("_write", "_note"):
        kept = getattr(Store, name)

        def failing(self, *args, kept=kept, name=name):
            if name == "_note" or "items" in args:
                raise RuntimeError("lost")
            return kept(self, *args)

        monkeypatch.setattr(Store, name, failing)
        with pytest.raises(RuntimeError):
            store.add(rest, 2)
        monkeypatch.setattr(Store, name, kept)
    assert store.add(rest, 2) == rest.count()
    opened = Store.open(spark, str(tmp_path))
    vectors, items = content(opened)
    assert [v[0] for v in vectors] == sorted(r["item_id"] for r in documents.select("item_id").collect())
    want = sorted((r["item_id"], r["cell_id"], tuple(r["code"]), str(r["revdate"]), r["token_count"]) for r in whole.vectors.collect())
    assert vectors == want
    assert items == sorted((tuple(map(str, r)) for r in documents.select(*ITEM_COLUMNS).collect()))
    assert {r["batch_id"]: r["added"] for r in opened.ledger.collect()}[2] == rest.count()
    assert opened.current().total == documents.count()


def test_repeated_ids_in_a_batch_and_empty_batches(spark, documents, quantizers, tmp_path):
    store = store_of(spark, documents, quantizers, tmp_path)
    row = documents.filter("item_id = 1")
    twice = row.union(row.withColumn("title", F.lit("another"))).union(row)
    assert store.add(twice, 0) == 1
    assert store.add(documents.limit(0), 1) == 0
    assert store.items.filter("item_id = 1").count() == store.vectors.filter("item_id = 1").count() == 1


def test_only_touched_buckets_are_read(spark, documents, quantizers, tmp_path):
    store = store_of(spark, documents, quantizers, tmp_path)
    plans = []
    join = type(documents).join

    def kept(self, other, on=None, how=None):
        if how == "left_semi" and "batch_id" in self._jdf.queryExecution().analyzed().toString():
            plans.append(self._jdf.queryExecution().executedPlan().toString())
        return join(self, other, on, how)

    type(documents).join = kept
    try:
        store.add(documents.filter("item_id IN (1, 4)"), 0)
    finally:
        type(documents).join = join
    assert any("PartitionFilters: [" in p and "bucket" in p.split("PartitionFilters: [")[1].split("]")[0] for p in plans)


@pytest.mark.parametrize("n", [1, 40, 41, 95, 1000])
def test_first_rows_in_file_order(spark, tmp_path, n):
    for k in range(4):
        spark.range(k * 40, k * 40 + 40).withColumn("x", F.lit("y")).coalesce(1).write.parquet(str(tmp_path / f"d={k}"))
    source = spark.read.parquet(*[str(tmp_path / f"d={k}") for k in range(4)])
    found = ingest.first_in_file_order(source, n)
    assert sorted(r["id"] for r in found.collect()) == list(range(min(n, 160)))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrdered" not in plan and "Sort" not in plan and "Exchange" not in plan
    source.write.csv(str(tmp_path / "csv"), header=True)
    lines = spark.read.option("header", True).csv(str(tmp_path / "csv"))
    assert ingest.first_in_file_order(lines, n).count() == min(n, 160)


def test_orders_of_results(spark):
    lists = {"a": {1: [5, 6, 7, 8], 2: [1], 4: [9, 8]}, "b": {1: [5, 7, 6], 2: [1], 4: [9, 8, 7]}, "c": {1: [8, 7, 6, 5]}}
    frames = {
        name: spark.createDataFrame([(q, n + 1, i) for q, own in of.items() for n, i in enumerate(own)], "qid bigint, rank int, item_id bigint")
        for name, of in lists.items()
    }
    queries = spark.createDataFrame([(q,) for q in (1, 2, 3, 4)], "qid bigint")
    got = {(r["qid"], r["method_a"], r["method_b"]): tuple(r)[3:] for r in evaluate.compare_orders(frames, queries).collect()}
    assert got[1, "a", "b"] == (4, 3, 3, 2, 1) and got[1, "a", "c"] == (4, 4, 4, 1, 6) and got[1, "b", "c"] == (3, 4, 3, 1, 2)
    assert got[2, "a", "b"] == (1, 1, 1, None, 0) and got[2, "a", "c"] == (1, 0, 0, 1, 0)
    assert got[3, "a", "b"] == (0, 0, 0, None, 0) and got[4, "a", "b"] == (2, 3, 2, 3, 0)
    assert len(got) == 12


def test_inversions():
    rng = np.random.default_rng(0)
    for n in (0, 1, 2, 7, 64, 101):
        order = rng.permutation(n).tolist()
        assert evaluate.inversions(order) == sum(a > b for a, b in itertools.combinations(order, 2))

import datetime
import hashlib
import re

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from cellsieve import limits
from cellsieve.checks import standins
from cellsieve.functions.dates import epoch_seconds, from_epoch
from cellsieve.functions.text import HashingEmbedder, embed_text, token_count, with_text_vectors
from cellsieve.functions.values import flatten_to_text
from cellsieve.functions.vectors import l2_normalize
from cellsieve.operators import ingest
from cellsieve.operators.histogram import Histogram2D, quantile_edges
from cellsieve.operators.predicates import (
    Predicate,
    conjunction,
    parse_predicates,
    predicate_filter,
    text_of,
    with_passes,
    workload_survivors,
)
from cellsieve.schemas import RAW
from cellsieve.session import cut, scratch_path
from cellsieve.sources import tables


@pytest.fixture(scope="module")
def small(spark):
    return spark.createDataFrame(
        [(1, 100, "2025-01-01 00:00:00"), (2, 50, "2025-01-02 10:11:12"), (3, None, None), (4, 700, "2025-02-01 00:00:00")],
        "item_id bigint, token_count int, revdate string",
    ).withColumn("revdate", F.col("revdate").cast("timestamp_ntz"))


def ids(df):
    return sorted(r["item_id"] for r in df.collect())


@pytest.mark.parametrize(
    "predicate, expected",
    [
        (("token_count", 100, "="), [1]),
        (("token_count", 100, "<"), [2]),
        (("token_count", 100, ">="), [1, 4]),
        (("revdate", "2025-01-01", "="), [1]),
        (("revdate", "2025-01-02 10:11", ">"), [2, 4]),
        (("revdate", ["2025-01-01", "2025-02-01 00:00"], "IN"), [1, 4]),
        (("item_id", [], "IN"), []),
        (("item_id", 999_999, "="), []),
        (("item_id", [1, 3, 77], "IN"), [1, 3]),
    ],
)
def test_predicates(small, predicate, expected):
    assert ids(predicate_filter(small, [Predicate(*predicate)])) == expected


def test_conjunction(small):
    assert ids(small.filter(conjunction([]))) == [1, 2, 3, 4]
    both = [Predicate("token_count", 60, ">"), Predicate("token_count", 600, "<")]
    assert ids(predicate_filter(small, both)) == [1]
    assert text_of(both) == "token_count > 60, token_count < 600"


def test_long_id_lists_are_joined(small, monkeypatch):
    monkeypatch.setattr(limits, "IN_LIST_LITERALS", 2)
    wanted = [Predicate("item_id", [1, 2, 3, 50], "IN"), Predicate("token_count", 60, ">")]
    assert ids(predicate_filter(small, wanted)) == [1]
    dates = [Predicate("revdate", ["2025-01-01", "2025-02-01", "2026-01-01"], "IN")]
    assert ids(predicate_filter(small, dates)) == [1, 4]


@pytest.mark.parametrize(
    "bad", [("title", 1, "="), ("token_count", 1, "!="), ("token_count", 1, "IN"), ("revdate", "junk", "=")]
)
def test_invalid_predicates(bad):
    with pytest.raises(ValueError):
        Predicate(*bad)


def test_lenient_list():
    raw = [{"key": "token_count", "value": 3, "operator": ">"}, {"key": "nope", "value": 1, "operator": "="}, {"key": "x"}]
    with pytest.warns(UserWarning):
        assert parse_predicates(raw) == [Predicate("token_count", 3, ">")]


def test_workload_in_batches(small):
    lists = {i: [Predicate("token_count", 10 * i, ">=")] for i in range(12)} | {99: []}
    got = {r["wid"]: r["survivors"] for r in workload_survivors(small, lists, batch=5).collect()}
    assert got[99] == 4 and got[0] == 3 and got[6] == 2 and got[11] == 1 and len(got) == 13


# --------------------------------------------------------------------------------------------------- histogram


@pytest.mark.parametrize("bins", [3, 10])
def test_edges_are_exact_percentiles(spark, sf_dir, bins):
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(
        F.col("l_extendedprice").alias("number"), F.col("l_quantity").cast("double").alias("date")
    )
    edges = quantile_edges(lines, {"number": bins, "date": bins})
    data = lines.toPandas()
    for axis in ("number", "date"):
        assert np.allclose(edges[axis], np.percentile(data[axis], np.linspace(0, 100, bins + 1)), atol=1e-9)
    rough = quantile_edges(lines, {"number": bins, "date": bins}, exact=False)
    assert np.allclose(rough["number"], edges["number"], rtol=0.02)


def test_ties_and_missing_values(spark):
    rows = [(7, "2024-01-01 00:00:00")] * 90 + [(8, "2024-01-02 00:00:00")] * 10 + [(9, None), (None, "2024-01-03 00:00:00")]
    items = spark.createDataFrame(rows, "token_count int, revdate string").withColumn(
        "revdate", F.col("revdate").cast("timestamp_ntz")
    )
    histogram = Histogram2D.build(items)
    assert histogram.number_edges[:9] == [7.0] * 9 and histogram.number_edges[-1] == 8.0
    assert histogram.estimate([]) == 100
    assert tuple(Histogram2D.left_out(items).head()) == (1, 1)
    assert histogram.estimate([Predicate("token_count", 7, ">=")]) == 100


def test_estimates_behave(spark, sf_dir):
    orders = standins.big_items(spark, sf_dir)
    histogram = Histogram2D.build(orders).collected()
    total = orders.count()
    lowest = int(histogram.number_edges[0])
    assert histogram.estimate([Predicate("token_count", lowest, ">=")]) == total
    steps = [histogram.estimate([Predicate("token_count", v, ">=")]) for v in (50_000, 150_000, 300_000, 600_000)]
    assert steps == sorted(steps, reverse=True) and steps[-1] == 0
    one = Predicate("token_count", 200_000, "<")
    actual = predicate_filter(orders, [one]).count()
    assert abs(histogram.estimate([one]) - actual) < 0.1 * total


# ------------------------------------------------------------------------------------------------------ ingest


def test_csv_keeps_quotes_and_line_breaks(spark):
    rows = [("0", "9", 'a "b"', "x,\n y \\n \\\\ \r", None, "2025-01-01", "3", " lead"), ("1", "8", "", "z", "u", "bad", "4", "é")]
    path = scratch_path(spark, "csv")
    tables.write_csv(spark.createDataFrame(rows, RAW), path)
    back = tables.read_csv(spark, path).orderBy("item_id").collect()
    assert [tuple(r)[:4] for r in back] == [rows[0][:4], ("1", "8", None, "z")]  # an empty field is missing
    assert back[0]["entity"] == " lead"
    typed = {r["item_id"]: r for r in ingest.typed_items(tables.read_csv(spark, path)).collect()}
    assert typed[0]["revdate"] == datetime.datetime(2025, 1, 1) and typed[1]["revdate"] is None
    assert typed[0]["ext_id"] == 9


def test_csv_of_other_programs(spark, tmp_path):
    (tmp_path / "one.csv").write_text('item_id,id,title,text,url,revdate,token_count,entity\n0,9,t,"a\nb \\n",u,2025-01-01,3,e\n')
    assert tables.read_csv(spark, str(tmp_path), escaped=False).head()["text"] == "a\nb \\n"


LONG_LISTS = {
    "out of range": [5_000_000_000 + k for k in range(1200)] + [50, 60],
    "fractions": [0.5 + k for k in range(1200)] + [50, 60.0],
    "repeated": [50] * 1500,
    "dates": [f"2024-01-{1 + k % 28:02d} 00:{k % 60:02d}" for k in range(1700)],
}


@pytest.mark.parametrize("kind", LONG_LISTS)
def test_long_lists_equal_short_ones(spark, sf_dir, kind, monkeypatch):
    values = LONG_LISTS[kind]
    items = cut(standins.documents_as_items(spark, sf_dir).drop("text"))
    lists = [Predicate("revdate" if kind == "dates" else "token_count", values, "IN"), Predicate("item_id", 3, ">")]
    found = {}
    for bound in (1000, 10_000):
        monkeypatch.setattr(limits, "IN_LIST_LITERALS", bound)
        kept = sorted(r["item_id"] for r in predicate_filter(items, lists).select("item_id").collect())
        flagged = with_passes(items, lists)
        assert flagged.count() == items.count() and flagged.columns == [*items.columns, "passes"]
        assert sorted(r["item_id"] for r in flagged.filter("passes").collect()) == kept
        assert workload_survivors(items, {1: lists, 2: []}).filter("wid = 1").head()["survivors"] == len(kept)
        found[bound] = kept
    assert found[1000] == found[10_000]


@pytest.mark.parametrize("broken", [None, "x1"])
def test_required_integers(spark, broken):
    raw = spark.createDataFrame([("0", broken, "t", "x", "u", "2025-01-01", "3", "e")], RAW)
    with pytest.raises(PySparkException):
        ingest.typed_items(raw).collect()


def test_ids_follow_file_order(spark, sf_dir):
    path = scratch_path(spark, "many")
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id")
    events.repartitionByRange(7, "event_id").sortWithinPartitions("event_id").write.parquet(path)
    numbered = ingest.assign_item_ids(spark.read.parquet(path))
    assert numbered.columns[0] == "item_id"
    assert numbered.filter("item_id <> event_id").isEmpty() and numbered.count() == events.count()
    assert "Exchange hashpartitioning(event_id" not in numbered._jdf.queryExecution().toString()


def test_ids_follow_file_order_in_csv(spark):
    path = scratch_path(spark, "many-csv")
    spark.range(0, 100, 1, 5).withColumn("text", F.lit("x")).write.options(header="true").csv(path)
    source = spark.read.schema("id bigint, text string").option("header", "true").csv(path)
    numbered = ingest.assign_item_ids(source)
    assert numbered.filter("item_id <> id").isEmpty() and numbered.count() == 100


def test_block_shuffle(spark):
    shuffled = ingest.block_shuffle(spark.range(250).withColumnRenamed("id", "item_id"), "item_id", 100).collect()
    assert sorted(r["position"] for r in shuffled) == list(range(250))
    assert all(r["position"] // 100 == r["item_id"] // 100 for r in shuffled)
    assert any(r["position"] != r["item_id"] for r in shuffled)


def test_lookup_and_keys(small):
    assert tables.item_by_id(small, 2).head()["token_count"] == 50
    assert tables.item_by_id(small, 2).columns == small.columns
    with pytest.raises(Exception, match="no item with id 12345"):
        tables.item_by_id(small, 12345).collect()
    assert ingest.key_violations(small).isEmpty()
    assert ingest.key_violations(small.unionByName(small.filter("item_id = 4"))).collect()[0]["copies"] == 2


def test_values_to_text(spark):
    df = spark.sql("SELECT 1 AS n, array('a', 'b') AS categories, array(1, 2) AS xs, named_struct('é', 'ü') AS s, CAST(NULL AS STRING) AS t")
    row = flatten_to_text(df, ["n", "categories", "xs", "s", "t", "missing"]).head()
    assert tuple(row) == ("1", "a; b", "[1,2]", '{"é":"ü"}', "", "")


def test_vectors_and_text(spark):
    df = spark.createDataFrame([([3.0, 4.0],), ([0.0, 0.0],)], "v array<float>")
    assert [list(np.round(r[0], 6)) for r in df.select(l2_normalize("v")).collect()] == [[0.6, 0.8], [0.0, 0.0]]
    texts = spark.createDataFrame([("b a  A",), ("",), (None,)], "text string")
    got = [np.array(r[0]) for r in texts.select(embed_text(F.col("text"), dim=16)).collect()]
    counts = HashingEmbedder(16)(["b a a"])[0]
    assert np.allclose(got[0], counts / np.linalg.norm(counts)) and not got[1].any() and not got[2].any()

    def make():
        return lambda batch: np.array([[len(t), 1.0] for t in batch])

    own = [list(r[0]) for r in texts.select(embed_text(F.col("text"), make)).collect()]
    assert own[1] == [0.0, 1.0] and len(own) == 3


def test_texts_in_one_pass(spark):
    """Counts and vectors of one pass over the texts are those of the two expressions, and of hashing token by token."""
    odd = ["", " ", "\t", "  \t ", " a", "a ", "\ta", "a\t", None, "a  b\n", "\x0ba b", "é Ü ß ΑΣ K İ", " \n x \n ", "x" * 55 + " " + "y" * 56 + " " + "Z" * 200, "\x0c\x0b", "A a A"]
    rng = np.random.default_rng(4)
    odd += ["".join(rng.choice(list(" \t\n\r\x0c\x0babÉ"), size)) for size in rng.integers(0, 12, 300)]
    texts = spark.createDataFrame(list(enumerate(odd)), "n int, text string").repartition(3)
    want = {r["n"]: (r["c"], r["v"]) for r in texts.select("n", token_count(F.col("text")).alias("c"), embed_text(F.col("text")).alias("v")).collect()}
    found = with_text_vectors(texts)
    assert found.columns == ["n", "token_count", "embedding"]
    assert {r["n"]: (r["token_count"], r["embedding"]) for r in found.collect()} == want
    for n, text in enumerate(odd):
        counts = np.zeros(64)
        for token in re.split("[ \t\n\r\x0b\x0c]+", (text or "").lower() if n != 11 else ""):
            if token:
                counts[int(hashlib.md5(token.encode()).hexdigest()[:7], 16) % 64] += 1
        if n != 11:
            assert np.allclose(want[n][1], counts / (np.linalg.norm(counts) + 1e-12))


def test_vectors_are_joined_not_texts(spark, sf_dir):
    """The text collection makes vectors where texts are read: no exchange moves a text."""
    plan = standins.document_vectors(spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert "ArrowEvalPython" not in plan and 0 < plan.index("Join") < plan.index("MapInArrow")


def test_epochs_ignore_the_session_zone(spark):
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        df = spark.sql("SELECT TIMESTAMP_NTZ'2024-03-10 02:30:01' AS t")
        row = df.select(epoch_seconds(F.col("t")).alias("e"), from_epoch(epoch_seconds(F.col("t"))).alias("b")).head()
        assert row["e"] == 1710037801.0 and row["b"] == datetime.datetime(2024, 3, 10, 2, 30, 1)
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")

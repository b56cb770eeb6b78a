"""CSV of other programs: values with line breaks, quotes and backslashes, read by several tasks."""

import csv
import random

import pytest
from pyspark.sql import types as T

from cellsieve import limits
from cellsieve.sources import tables
from cellsieve.sources.csv_records import records

TEXTS = ['two\nlines', 'quote " here', '""', 'back\\slash \\n \\nabla', "a,b,;", "", "\r\n within\r\n", "\n\n", "plain", '"\n"', "tail\\", "Ünï 🙂\n x", " spaced "]
SCHEMA = T.StructType([T.StructField("n", T.LongType()), T.StructField("text", T.StringType()), T.StructField("other", T.StringType())])


def write(path, rows, terminator="\r\n", header=("other", "n", "text", "extra")):
    with open(path, "w", newline="", encoding="utf-8") as f:
        writer = csv.DictWriter(f, header, lineterminator=terminator)
        writer.writeheader()
        for row in rows:
            writer.writerow(row)


def rows_of(seed, n):
    rng = random.Random(seed)
    return [
        {"n": k, "text": rng.choice(TEXTS) * rng.randint(1, 4), "other": rng.choice(TEXTS), "extra": "x\ny"} for k in range(n)
    ]


def found(df):
    return sorted((r["n"], r["text"] or "", r["other"] or "") for r in df.collect())


def expected(rows):
    return sorted((r["n"], r["text"], r["other"]) for r in rows)


@pytest.fixture
def small_splits(spark):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


@pytest.mark.parametrize("terminator", ["\r\n", "\n"])
def test_foreign_file_by_several_tasks(spark, tmp_path, small_splits, terminator):
    rows = rows_of(1, 300)
    rows.append({"n": 999, "text": "a long one\n" * 400, "other": "over many splits", "extra": ""})
    rows.append({"n": 1000, "text": "end", "other": "end", "extra": ""})
    write(tmp_path / "one.csv", rows, terminator)
    assert spark.read.option("lineSep", "\n").text(str(tmp_path)).rdd.getNumPartitions() > 20
    assert found(tables.read_csv(spark, str(tmp_path), SCHEMA)) == expected(rows)


def test_several_files_and_columns(spark, tmp_path, small_splits):
    parts = [rows_of(seed, 40) for seed in range(5)]
    for k, rows in enumerate(parts):
        write(tmp_path / f"part{k}.csv", rows)
    df = tables.read_csv(spark, str(tmp_path), SCHEMA, columns=["text", "n"])
    assert df.columns == ["text", "n"]
    assert sorted((r["n"], r["text"] or "") for r in df.collect()) == sorted((r["n"], r["text"]) for rows in parts for r in rows)
    with pytest.raises(ValueError):
        tables.read_csv(spark, str(tmp_path), SCHEMA, columns=["absent"])


def test_too_many_splits_read_by_one_task_per_file(spark, tmp_path, small_splits, monkeypatch):
    rows = [r for r in rows_of(3, 60) if "\r" not in r["text"] + r["other"]]
    header = ("n", "text", "other")
    write(tmp_path / "one.csv", [{k: r[k] for k in header} for r in rows], header=header)
    monkeypatch.setattr(limits, "CSV_SPLITS", 2)
    assert records(spark, str(tmp_path)) is None
    assert found(tables.read_csv(spark, str(tmp_path), SCHEMA)) == expected(rows)


def test_blank_lines_and_no_rows(spark, tmp_path):
    (tmp_path / "one.csv").write_text('n,text,other\n\n1,"a\n\nb",c\n\r\n2,,"open until the end\n', newline="")
    assert found(tables.read_csv(spark, str(tmp_path), SCHEMA))[0] == (1, "a\n\nb", "c")
    assert len(found(tables.read_csv(spark, str(tmp_path), SCHEMA))) == 2
    empty = tmp_path / "empty"
    empty.mkdir()
    (empty / "one.csv").write_text("n,text,other\n")
    assert found(tables.read_csv(spark, str(empty), SCHEMA)) == []


def test_escaped_files_keep_every_character(spark, tmp_path):
    rows = [(k, t + "\x00\\0" * (k % 2), t) for k, t in enumerate(TEXTS) if t]
    tables.write_csv(spark.createDataFrame(rows, SCHEMA), str(tmp_path / "own"), escaped=True)
    assert found(tables.read_csv(spark, str(tmp_path / "own"), SCHEMA, escaped=True)) == sorted(rows)
    rows = [(n, t.replace("\x00", ""), o) for n, t, o in rows]
    tables.write_csv(spark.createDataFrame(rows, SCHEMA), str(tmp_path / "plain"))
    assert found(tables.read_csv(spark, str(tmp_path / "plain"), SCHEMA)) == sorted(rows)

"""Language identification: features against a plain version, held-out accuracy, odd rows."""

import math
import zlib
from collections import Counter

import numpy as np
import pytest

from cellsieve.llm import lang_id
from cellsieve.llm.common import table
from cellsieve.llm.queries import QUERIES

SCHEMA = "doc_id long, text string, lang string, source string, score int, h string, bucket long"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, g, "s", 1, "x", 2) for i, t, g in rows], SCHEMA)


def plain_counts(text):
    """Number of n-grams of each n of the normalised text."""
    out, last = " ", " "
    for c in text:
        c = (c.lower() if len(c.lower()) == 1 else c) if c.isalpha() else " "
        if c != " " or last != " ":
            out, last = out + c, c
    out = out if out.endswith(" ") else out + " "
    grams = Counter(out[i : i + n] for n in range(1, lang_id.MOST_N + 1) for i in range(len(out) - n + 1))
    grams.pop(" ", None)
    return Counter({g: c for g, c in grams.items() if g.strip()})


def test_ngrams_are_those_of_each_text_alone():
    texts = ["Ab c", "", "...", None, "İstanbul ß É", "a", "日本 語", "x1y2  z", "𝔘𝔫 𐐀𐐁"]
    rows, buckets = np.zeros(0, int), np.zeros(0, int)
    for of, parts in lang_id.tiles(texts, limit=6):
        assert sum(map(len, parts)) <= 12
    for of, parts in lang_id.tiles(texts):
        r, b = lang_id.ngram_buckets(of, parts)
        rows, buckets = np.concatenate([rows, r]), np.concatenate([buckets, b])
    for k, text in enumerate(texts):
        own = Counter(plain_counts(text or ""))
        assert (rows == k).sum() == sum(own.values())
        alone = lang_id.ngram_buckets(np.array([0]), [text or ""])[1]
        assert sorted(buckets[rows == k].tolist()) == sorted(alone.tolist())
        assert len(set(alone.tolist())) == len(own)
    assert np.array_equal(lang_id.letters("ÀÉ-x"), np.array([ord("à"), ord("é"), 32, ord("x")]))


def test_document_frequencies(spark):
    rows = [(k, t, "en") for k, t in enumerate(["ab ab", "ab cd", "zz", "", "q" * 5])]
    rows.append((9, "long text here " * 20000, "en"))
    df, n = lang_id.document_frequencies(frame(spark, rows).repartition(3))
    assert n == 6
    of = lambda g: df[lang_id.ngram_buckets(np.array([0]), [g])[1][-1]]
    assert of("ab") == 2 and of("zz") == 1 and of("text") == 1
    assert df.max() <= 6


def test_held_out_accuracy(spark):
    sf_dir = "/root/testdata/sf0.01"
    docs = {r["doc_id"]: r for r in table(spark, sf_dir, "documents").collect()}
    found = QUERIES["op12_language_id"](spark, sf_dir).collect()
    assert len(found) == len(docs)
    held = [r for r in found if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in found)
    assert all(0 <= r["score"] <= 1 for r in found)
    lettered = [r for r in held if any(c.isalpha() for c in docs[r["doc_id"]]["text"] or "")]
    assert all(r["lang_pred"] == "und" and r["score"] == 0 for r in held if r not in lettered)
    right = sum(r["lang_pred"] == docs[r["doc_id"]]["lang"] for r in lettered)
    assert len(lettered) > 200 and right >= 0.98 * len(lettered)


def test_held_out_languages_are_not_read(spark):
    sf_dir = "/root/testdata/sf0.001"
    docs = table(spark, sf_dir, "documents")
    other = docs.selectExpr("doc_id", "text", "CASE WHEN crc32(cast(cast(doc_id AS string) AS binary)) % 4 = 2 THEN 'xx' ELSE lang END AS lang")
    rows = lambda d: sorted(map(tuple, lang_id.identify(d).collect()))
    assert rows(docs) == rows(other)


def test_weights_are_sparse_and_rare_languages_learned(spark):
    rng = np.random.default_rng(3)
    word = lambda letters: "".join(rng.choice(list(letters), 5))
    rows = [(k, " ".join(word("abcdefg") for _ in range(30)), "big") for k in range(400)]
    rows += [(1000 + k, " ".join(word("uvwxyz") for _ in range(30)), "tiny") for k in range(12)]
    rows += [(2000, " ".join(word("uvwxyz") for _ in range(9)), None)]
    docs = frame(spark, rows).repartition(4)
    found = {r["doc_id"]: r for r in lang_id.identify(docs).collect()}
    assert all(found[i]["lang_pred"] == (g or "tiny") for i, _, g in rows)
    model = lang_id.learned(docs)
    assert (model.weights != 0).mean() < 0.2


def test_odd_rows(spark):
    good = [(k, "the quick brown fox " * 3, "en") for k in range(40)] + [(100 + k, "der schnelle braune fuchs " * 3, "de") for k in range(40)]
    odd = [
        (200, None, "en"), (201, "", "de"), (202, "12 34 !?", "en"), (203, "quick", None), (None, "the brown fox", "en"), (204, "schnelle fuchs " * 60000, None),
        (205, "x" * 300000, None), (0, "the quick brown fox " * 3, "en"), (206, "퟿ 日本", None),
    ]
    found = lang_id.identify(frame(spark, good + odd).repartition(3)).collect()
    assert len(found) == len(good) + len(odd)
    by = {r["doc_id"]: r["lang_pred"] for r in found}
    assert [by[k] for k in (200, 201, 202, 203, None, 204)] == ["und", "und", "und", "en", "en", "de"]
    assert by[205] in ("en", "de") and by[206] in ("en", "de")
    assert sum(r["doc_id"] == 0 for r in found) == 2


def test_nothing_to_learn(spark):
    assert lang_id.identify(frame(spark, [])).collect() == []
    rows = [(k, "some text", None) for k in range(5)]
    assert {(r["lang_pred"], r["score"]) for r in lang_id.identify(frame(spark, rows)).collect()} == {("und", 0.0)}
    one = lang_id.identify(frame(spark, [(k, "some text", "en") for k in range(8)])).collect()
    assert {(r["lang_pred"], r["score"]) for r in one} == {("en", 1.0)}


def test_temperature():
    rng = np.random.default_rng(0)
    p = rng.uniform(0.05, 0.95, 4000)
    label = (rng.uniform(size=4000) < p).astype(int)
    logits = np.stack([np.zeros(4000), 7 * np.log(p / (1 - p))], axis=1)
    assert lang_id.temperature(logits, label) == pytest.approx(7, rel=0.1)
    assert lang_id.temperature(logits[:0], label[:0]) == 1.0
    assert math.isfinite(lang_id.temperature(logits, np.zeros(4000, int)))

"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

A text is its code points, lower-cased one by one, everything but letters a space, runs of spaces one. Its n-grams of 1 to
MOST_N characters, never more than one text, are hashed into BUCKETS; a bucket's value is its share of the text's n-grams
(TF) times its IDF over all training documents. Because a score is linear in the shares, it is a plain sum over places of
the text, which is read whole, in tiles.

Document frequencies, and the number of documents and bytes of each language, are counted over all training documents.
Weights are learned on a bounded sample of them: of each language TRAIN_DOCS / languages texts and TRAIN_BYTES / languages
bytes, chosen by a hash of the text; a text that alone exceeds its language's bytes is passed over. Training is
follow-the-regularised-leader with elastic net, so most weights are exactly zero. A fifth of the sample is held back and
gives the softmax's temperature, which makes its probabilities honest.

Only the MOST_LANGS commonest language values are learned.

Defined cases: a text that is null or has no letter is `und` with score 0, and so is every text if nothing can be learned;
training documents need a text and a language that are not null; equal texts of one language count once in the
sample; texts in the fifth are not in the rest; repeated rows and null ids give a row each; an empty table gives no rows;
extra columns are ignored, and no id, source or language is read by a prediction.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cellsieve.llm.common import crc_remainder, small_batches
from cellsieve.session import cut

BITS = 16
BUCKETS = 1 << BITS
MOST_N = 3
TRAIN_DOCS = 4000
TRAIN_BYTES = 16 * 1024 * 1024
MOST_LANGS = 256
EPOCHS = 4
ALPHA, BETA, L1, L2 = 5.0, 0.1, 5e-3, 1e-4
CONSTANT = 0.01  # the value of the constant feature, about that of an n-gram
TILE = 1 << 17
UNKNOWN = "und"
SPACE = 32


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """The lower-case letter of each code point of the first plane, a space for all that is no letter."""
    return np.array([_letter(c) for c in range(1 << 16)], np.uint32)


def _letter(point: int) -> int:
    own = chr(point)
    if not own.isalpha():
        return SPACE
    lower = own.lower()
    return ord(lower) if len(lower) == 1 else point


def letters(text: str) -> np.ndarray:
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    out = _letters()[np.minimum(points, (1 << 16) - 1)]
    for point in np.unique(points[points >= 1 << 16]).tolist():
        out[points == point] = _letter(point)
    return out


def tiles(texts: list[str | None], limit: int = TILE) -> Iterator[tuple[np.ndarray, list[str]]]:
    """(rows, strings) of about `limit` characters; a longer text is cut at spaces, or where it has none."""
    rows, parts, held = [], [], 0
    for row, text in enumerate(texts):
        at = 0
        while text and at < len(text):
            end = min(len(text), at + limit)
            if end < len(text):
                gap = text.rfind(" ", at + 1, end)
                end = gap if gap > 0 else end
            if held and held + end - at > limit:
                yield np.array(rows), parts
                rows, parts, held = [], [], 0
            rows.append(row)
            parts.append(text[at:end])
            held += end - at
            at = end
    if rows:
        yield np.array(rows), parts


def ngram_buckets(rows: np.ndarray, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(row, bucket) of every n-gram of a tile, in the order of n, then of place."""
    points = letters(" " + " ".join(parts) + " ")
    owner = np.repeat(rows, [len(p) + 1 for p in parts])
    owner = np.concatenate([rows[:1], owner])
    gap = points == SPACE
    keep = ~gap
    keep[1:] |= ~gap[:-1]
    keep[0] = True
    points, owner, gap = points[keep].astype(np.uint64), owner[keep], gap[keep]
    owner = np.where(gap, -1, owner)
    out_rows, out_buckets = [], []
    total = np.zeros(len(points), np.uint64)
    for n in range(1, MOST_N + 1):
        size = len(points) - n + 1
        if size <= 0:
            break
        total = (total[:size] * np.uint64(0x9E3779B97F4A7C15)) + points[n - 1 :] * np.uint64(0xC2B2AE3D27D4EB4F)
        first, last = owner[:size], owner[n - 1 :]
        if n > 1:  # no two spaces are neighbours
            first = np.where(first < 0, owner[1 : size + 1], first)
            last = np.where(last < 0, owner[n - 2 : n - 2 + size], last)
        good = (first == last) & (first >= 0)
        h = total[good] + np.uint64(n)
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        out_rows.append(first[good])
        out_buckets.append((h >> np.uint64(64 - BITS)).astype(np.int64))
    return np.concatenate(out_rows), np.concatenate(out_buckets)


def document_frequencies(training: DataFrame) -> tuple[np.ndarray, int]:
    """In how many documents each bucket occurs, and how many there are."""

    def job(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(BUCKETS, np.int64), 0
        for batch in batches:
            n += len(batch)
            seen, at = np.zeros(BUCKETS, bool), -1
            for rows, parts in tiles(batch.column(0).to_pylist()):
                row, bucket = ngram_buckets(rows, parts)
                order = np.argsort(row, kind="stable")
                row, bucket = row[order], bucket[order]
                starts = np.flatnonzero(np.diff(row, prepend=-1))
                for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(row)]):
                    if row[a] != at:  # a text may go on from the tile before
                        total += seen
                        seen[:] = False
                        at = row[a]
                    seen[bucket[a:b]] = True
            total += seen
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(held, -1)), pa.array(np.append(total[held], n))], names=["bucket", "n"])

    found = training.select("text").mapInArrow(job, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(BUCKETS + 1, np.int64)
    counts[found.column(0).to_numpy()] = found.column(1).to_numpy()
    return counts[:-1], int(counts[-1])


class Examples(NamedTuple):
    """Texts as rows of (bucket, share) between `at` borders; label: the number of the language; hash: of the text."""

    at: np.ndarray
    buckets: np.ndarray
    shares: np.ndarray
    label: np.ndarray
    hash: np.ndarray


class Model(NamedTuple):
    langs: list[str]
    weights: np.ndarray  # BUCKETS x languages, IDF and temperature included
    bias: np.ndarray

    def probabilities(self, sums: np.ndarray, counts: np.ndarray) -> np.ndarray:
        return softmax(sums / np.maximum(counts, 1)[:, None] + self.bias)


def softmax(logits: np.ndarray) -> np.ndarray:
    e = np.exp(logits - logits.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def sample(training: DataFrame) -> tuple[list[str], DataFrame]:
    """The languages, and (lang, h, text) of the bounded sample."""
    sized = training.groupBy("lang").agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("bytes"))
    sized = sized.orderBy(F.desc("n"), "lang").limit(MOST_LANGS).collect()
    langs = sorted(r["lang"] for r in sized)
    docs, size = max(5, TRAIN_DOCS // max(1, len(langs))), TRAIN_BYTES // max(1, len(langs))
    # Twice the share that is wanted passes; the window settles the rest on few rows.
    shares = [(r["lang"], min(1.0, 2 * max(docs / r["n"], size / (r["bytes"] + 1)))) for r in sized]
    passing = training.sparkSession.createDataFrame(shares, "lang string, share double")
    h = F.xxhash64("text")
    rows = training.where(F.octet_length("text").between(1, size)).join(F.broadcast(passing), "lang").withColumn("h", h)
    rows = rows.where((F.pmod("h", F.lit(1 << 30)) + 0.5) / float(1 << 30) < F.col("share")).drop("share")
    rows = rows.dropDuplicates(["lang", "h"])
    order = Window.partitionBy("lang").orderBy(F.pmod("h", F.lit(1 << 30)), "h")
    rows = rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= docs)
    running = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return langs, rows.withColumn("held", F.sum(F.octet_length("text")).over(running)).where(F.col("held") <= size).select("lang", "h", "text")


def examples(rows: DataFrame, langs: list[str]) -> Examples:
    def job(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, counts = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for of, parts in tiles(batch.column(2).to_pylist()):
                row, bucket = ngram_buckets(of, parts)
                key, count = np.unique(row * BUCKETS + bucket, return_counts=True)
                keys.append(key)
                counts.append(count)
            key, where = np.unique(np.concatenate(keys), return_inverse=True)
            count = np.bincount(where, np.concatenate(counts), len(key))
            bounds = np.searchsorted(key, np.arange(len(batch) + 1) * BUCKETS).astype(np.int32)
            total = np.add.reduceat(np.append(count, 0.0), np.minimum(bounds[:-1], len(count))) if len(batch) else np.zeros(0)
            share = count / np.repeat(np.where(np.diff(bounds) > 0, total, 1.0), np.diff(bounds))
            lists = [pa.ListArray.from_arrays(pa.array(bounds), pa.array(v)) for v in ((key % BUCKETS).astype(np.int32), share.astype(np.float32))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *lists], names=["lang", "h", "buckets", "shares"])

    made = rows.mapInArrow(job, "lang string, h long, buckets array<int>, shares array<float>").toArrow().sort_by([("h", "ascending"), ("lang", "ascending")])
    buckets, shares = made.column("buckets").combine_chunks(), made.column("shares").combine_chunks()
    number = {lang: k for k, lang in enumerate(langs)}
    label = np.array([number[v] for v in made.column("lang").to_pylist()], np.int64)
    lengths = np.diff(buckets.offsets.to_numpy()) if len(buckets) else np.zeros(0, np.int64)
    return Examples(
        np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64), buckets.flatten().to_numpy().astype(np.int64), shares.flatten().to_numpy(), label,
        made.column("h").to_numpy(),
    )


class Leader:
    """Follow-the-regularised-leader, one coordinate per bucket and language, with elastic net."""

    def __init__(self, buckets: int, langs: int):
        self.z, self.n = np.zeros((buckets, langs)), np.zeros((buckets, langs))
        self.z_bias, self.n_bias = np.zeros(langs), np.zeros(langs)

    @staticmethod
    def solved(z: np.ndarray, n: np.ndarray, l1: float, l2: float) -> np.ndarray:
        return np.where(np.abs(z) > l1, (np.sign(z) * l1 - z) / ((BETA + np.sqrt(n)) / ALPHA + l2), 0.0)

    def weights(self) -> tuple[np.ndarray, np.ndarray]:
        return self.solved(self.z, self.n, L1, L2), CONSTANT * self.solved(self.z_bias, self.n_bias, 0.0, L2)

    def learn(self, buckets: np.ndarray, values: np.ndarray, label: int) -> None:
        z, n = self.z[buckets], self.n[buckets]
        w, b = self.solved(z, n, L1, L2), self.solved(self.z_bias, self.n_bias, 0.0, L2)
        off = softmax(values @ w + CONSTANT * b)
        off[label] -= 1.0
        g = values[:, None] * off
        self.z[buckets] = z + g - (np.sqrt(n + g * g) - np.sqrt(n)) / ALPHA * w
        self.n[buckets] = n + g * g
        g = CONSTANT * off
        self.z_bias += g - (np.sqrt(self.n_bias + g * g) - np.sqrt(self.n_bias)) / ALPHA * b
        self.n_bias += g * g


def temperature(logits: np.ndarray, label: np.ndarray) -> float:
    """The temperature with the least mean log loss, by golden section over its logarithm; 1 without examples."""
    if not len(label):
        return 1.0

    def loss(t: float) -> float:
        p = softmax(logits / math.exp(t))[np.arange(len(label)), label]
        return float(-np.log(np.maximum(p, 1e-300)).mean())

    low, high, part = -4.0, 4.0, (math.sqrt(5) - 1) / 2
    for _ in range(40):
        a, b = high - part * (high - low), low + part * (high - low)
        low, high = (low, b) if loss(a) <= loss(b) else (a, high)
    return math.exp((low + high) / 2)


def train(found: Examples, langs: list[str], idf: np.ndarray) -> Model:
    values = found.shares * idf[found.buckets]
    leader = Leader(BUCKETS, len(langs))
    every = np.arange(len(found.label))
    held = (found.hash >> 32) % 5 == 0
    random = np.random.default_rng(12)
    for _ in range(EPOCHS):
        for k in random.permutation(every[~held]).tolist():
            a, b = found.at[k], found.at[k + 1]
            leader.learn(found.buckets[a:b], values[a:b], int(found.label[k]))
    weights, bias = leader.weights()
    logits = [values[found.at[k] : found.at[k + 1]] @ weights[found.buckets[found.at[k] : found.at[k + 1]]] + bias for k in every[held]]
    t = temperature(np.array(logits).reshape(-1, len(langs)), found.label[held])
    return Model(langs, weights * idf[:, None] / t, bias / t)


def learned(docs: DataFrame) -> Model | None:
    training = docs.where(f"{crc_remainder('doc_id', 4)} <> 2 AND text IS NOT NULL AND lang IS NOT NULL").select("text", "lang")
    langs, rows = sample(training)
    if not langs:
        return None
    df, n = document_frequencies(training)
    idf = np.where(df > 0, np.log((1 + n) / (1 + df)) + 1, 0.0)
    return train(examples(rows, langs), langs, idf)


def predict(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score) of every row."""
    kind = docs.schema[id_col].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def job(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Model | None = shared.value
        for batch in batches:
            n = len(batch)
            best, score = np.full(n, -1), np.zeros(n)
            if m is not None:
                sums, counts = np.zeros((n, len(m.langs))), np.zeros(n, np.int64)
                for rows, parts in tiles(batch.column(1).to_pylist(), max(4096, TILE * 4 // max(4, len(m.langs)))):
                    row, bucket = ngram_buckets(rows, parts)
                    starts = np.flatnonzero(np.diff(row, prepend=-1))
                    if len(starts):
                        np.add.at(sums, row[starts], np.add.reduceat(m.weights[bucket], starts, axis=0))
                        np.add.at(counts, row[starts], np.diff(starts, append=len(row)))
                p = m.probabilities(sums, counts)
                best = np.where(counts > 0, p.argmax(axis=1), -1)
                score = np.where(counts > 0, p.max(axis=1, initial=0.0), 0.0)
            names = [UNKNOWN if b < 0 else m.langs[b] for b in best.tolist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.string()), pa.array(score)], names=["doc_id", "lang_pred", "score"])

    return docs.select(id_col, text_col).mapInArrow(job, f"doc_id {kind}, lang_pred string, score double")


def identify(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, lang_pred, score): learned from the documents themselves but for those held out."""
    small_batches(docs.sparkSession)
    found = predict(docs, learned(docs))
    return found.select("doc_id", F.expr(f"{crc_remainder('doc_id', 4)} = 2").alias("held_out"), "lang_pred", "score")

"""Document quality: supervised subword embeddings.

Words, word pairs of the form "the same word again" and character n-grams (runs of 3 and 4 bytes) are hashed into
buckets, each with a learned vector. A document is
the average of its vectors; a softmax over two classes follows. Training is plain stochastic gradient descent in numpy
on the driver, on a sample of labelled documents bounded by TRAIN_ROWS and TRAIN_BYTES: the first rows in the order of a
hash of their id, but for texts that no longer fit. Whole texts are used for training and for scoring.

Because average and output layer are linear, the difference of the two logits is an average over buckets of one number
each; that table of BUCKETS floats is all that scoring tasks need.

Defined cases: null and empty texts have no features and are scored by the output bias; labels that are null or whose
document is missing are not used; repeated labels count repeatedly; without any label every score is 0.5; repeated ids
and texts give a row each; an empty table gives no rows; extra columns are ignored, labels, lang and source never read
by a score.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellsieve.llm.common import SPACES, U64, chunks, crc_remainder, give_back, small_batches, span_hashes, sparing, word_spans
from cellsieve.session import cut

BUCKETS = 1 << 18
DIM = 8
TRAIN_ROWS = 5000
TRAIN_BYTES = 24 * 1024 * 1024
EPOCHS = 6
LEAST_STEPS = 400
BATCH = 32
RATE = 4.0
THRESHOLD = 0.3
SHIFT = 32 - 18
REPEAT = 12345  # the bucket of a word that stands for the second time in a row
# Bytes of text scored at once. A task takes about 30 times that, which a Python worker may keep while later tasks run.
CHUNK = 1 << 19


class Model(NamedTuple):
    """logit: by bucket, the difference of the logits of class 1 and class 0; bias: the same without features."""

    logit: np.ndarray
    bias: float

    def score(self, means: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-np.clip(means + self.bias, -60, 60)))


def ngram_buckets(data: np.ndarray, n: int) -> np.ndarray:
    """The bucket of the n bytes from each position on."""
    size = len(data) - n + 1
    if size <= 0:
        return np.zeros(0, np.uint32)
    value = data[:size].astype(np.uint32)
    for k in range(1, n):
        value |= data[k : k + size].astype(np.uint32) << np.uint32(8 * k)
    if n == 3:
        value |= np.uint32(1 << 24)
    return value * np.uint32(2654435761) >> np.uint32(SHIFT)


def word_buckets(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the words and of the repeated pairs by row, and where each row's begin. A repeat follows its word."""
    starts, ends, first = word_spans(SPACES[data], offsets)
    hashes = span_hashes(data, starts, ends)
    again = np.zeros(len(hashes), np.int64)
    again[1:] = hashes[1:] == hashes[:-1]
    own = first[first < len(hashes)]
    again[own] = 0
    buckets = np.repeat((hashes >> U64(64 - 18)).astype(np.uint32), 1 + again)
    places = np.cumsum(1 + again)
    buckets[places[again == 1] - 1] = REPEAT
    return buckets, np.concatenate([np.zeros(1, np.int64), places])[first]


def mean_logits(model: Model, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Average of the features' logits by row."""
    sizes = np.diff(offsets)
    words, first = word_buckets(data, offsets)
    total = np.zeros(len(sizes) + 1 + len(words))[: len(words) + 1]
    np.cumsum(model.logit[words], out=total[1:])
    sums, counts = total[first[1:]] - total[first[:-1]], np.diff(first)
    for n in (3, 4):
        grams = ngram_buckets(data, n)
        total = np.zeros(len(grams) + 1)
        np.cumsum(model.logit[grams], out=total[1:], dtype=np.float64)
        own = np.maximum(sizes - n + 1, 0)
        begin = np.minimum(offsets[:-1], len(grams))
        sums = sums + np.where(own > 0, total[np.minimum(begin + own, len(grams))] - total[begin], 0.0)
        counts = counts + own
    return np.where(counts > 0, sums / np.maximum(counts, 1), 0.0)


def scores_of(model: Model, texts: pa.Array) -> np.ndarray:
    """The score of each text, CHUNK bytes at a time."""
    parts = [model.score(mean_logits(model, data, offsets)) for _, _, data, offsets in chunks(texts, CHUNK)]
    return np.concatenate(parts) if parts else np.zeros(0)


def features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct buckets of a text, and the share of its features in each."""
    data = np.frombuffer(text.encode(), np.uint8)
    words, _ = word_buckets(data, np.array([0, len(data)]))
    found, counts = np.unique(np.concatenate([words, ngram_buckets(data, 3), ngram_buckets(data, 4)]), return_counts=True)
    return found, (counts / max(1, counts.sum())).astype(np.float32)


def train(texts: list[str], labels: list[int], seed: int = 11) -> Model:
    """Stochastic gradient descent on bucket vectors, output weights and bias."""
    if not texts:
        return Model(np.zeros(BUCKETS, np.float32), 0.0)
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1 / DIM, 1 / DIM, (BUCKETS, DIM)).astype(np.float32)
    out, bias = rng.uniform(-0.5, 0.5, (DIM, 2)).astype(np.float32), np.zeros(2, np.float32)
    # Features of all texts lie in two long buffers, which go back to the system as a whole.
    held, parts, lengths = bytearray(), bytearray(), [0]
    for t in texts:
        found, shares = features(t)
        held += found.tobytes()
        parts += shares.tobytes()
        lengths.append(len(found))
    own, share_of, first = np.frombuffer(held, np.uint32), np.frombuffer(parts, np.float32), np.cumsum(lengths).tolist()
    target = np.asarray(labels, np.int64)
    per_epoch = -(-len(texts) // BATCH)
    epochs = max(EPOCHS, -(-LEAST_STEPS // per_epoch))
    steps, step = epochs * per_epoch, 0
    for _ in range(epochs):
        order = rng.permutation(len(texts))
        for at in range(0, len(texts), BATCH):
            pick = [r for r in order[at : at + BATCH].tolist() if lengths[r + 1]]
            rate, step = RATE * (1 - step / steps), step + 1
            if not pick:
                continue
            ids = np.concatenate([own[first[r] : first[r + 1]] for r in pick])
            share = np.concatenate([share_of[first[r] : first[r + 1]] for r in pick])[:, None]
            begins = np.cumsum([0, *(lengths[r + 1] for r in pick[:-1])])
            hidden = np.add.reduceat(vectors[ids] * share, begins, axis=0)
            z = hidden @ out + bias
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(pick)), target[pick]] -= 1  # the gradient of each document's own loss
            back = np.repeat(p @ out.T, np.diff([*begins, len(ids)]), axis=0) * share
            out -= rate / 8 * (hidden.T @ p) / len(pick)
            bias -= rate / 8 * p.mean(axis=0)
            np.subtract.at(vectors, ids, rate * back)
    return Model((vectors @ (out[:, 1] - out[:, 0])).astype(np.float32), float(bias[1] - bias[0]))


def train_sample(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, size: int = TRAIN_BYTES) -> tuple[list[str], list[int]]:
    """Texts and labels of the first labelled documents, by a hash of the id, within both bounds; never held-out ones."""
    usable = labels.where("doc_id IS NOT NULL AND quality IN (0, 1)").where(f"{crc_remainder('doc_id', 5)} <> 0")
    count = usable.count()
    # Half as many again as needed are looked up, since some labels may lack a document.
    limit = min(1.0, 1.5 * rows / max(1, count))
    hashed = usable.select("doc_id", "quality", F.xxhash64("doc_id").alias("h"))
    few = hashed.where(F.pmod("h", F.lit(1 << 30)) < int(limit * (1 << 30)))
    texts = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"))
    joined = cut(texts.join(F.broadcast(few), "doc_id").withColumn("n_bytes", F.octet_length("text")))
    total, kept = 0, []
    for row in joined.select("doc_id", "quality", "h", "n_bytes").orderBy("h", "doc_id", "quality").limit(rows).collect():
        if total + row["n_bytes"] > size:
            continue  # passed over: what follows may still fit
        total += row["n_bytes"]
        kept.append(row["doc_id"])
    chosen = joined.where(F.col("doc_id").isin(kept)) if kept else joined.limit(0)
    found = chosen.orderBy("h", "doc_id", "quality").select("text", "quality").collect()
    return [r["text"] for r in found], [int(r["quality"]) for r in found]


def trained(docs: DataFrame, labels: DataFrame) -> Model:
    """The model of a sample; the driver keeps nothing else of it."""
    sample = train_sample(docs, labels)
    give_back()
    model = train(*sample)
    del sample
    give_back()
    return model


def with_scores(docs: DataFrame, model: Model) -> DataFrame:
    """docs plus quality_score, one float per row."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def job(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = batch.column(batch.schema.get_field_index("text"))
            scores = pa.array(scores_of(shared.value, text), pa.float64())
            keep = [c for c in names if c != "text" or carry]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), scores], names=[*keep, "quality_score"])

    names = docs.columns
    carry = len(names) > 2
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name != "text" or carry)
    return docs.mapInArrow(sparing(job), f"{schema}, quality_score double")


def score_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document."""
    model = trained(docs, labels)
    scored = with_scores(docs.select("doc_id", "text"), model)
    return scored.select(
        "doc_id",
        F.expr(f"{crc_remainder('doc_id', 5)} = 0").alias("held_out"),
        F.col("quality_score").alias("score"),
        (F.col("quality_score") >= THRESHOLD).cast("int").alias("predicted"),
    )


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that are not rejected, all columns as they are."""
    model = trained(docs, labels)
    own = docs.select("doc_id", "text", "lang", "source", "n_chars")
    return with_scores(own, model).where(F.col("quality_score") >= THRESHOLD).drop("quality_score")

"""Language-model scores of documents.

A word's probability is that of its subword id, its last three bytes hashed to CLASSES - 1 ids (the end has its own),
times that of the word among the words with that id:

    P(word | before) = P(id | ids before) * (c + 1) / (N_id + V_id + 1)

with c the word's count, N_id the tokens and V_id the distinct words with that id in the training documents. Word
counts and the counts of neighbouring ids are gathered from every training document. The ids are predicted by a causal
self-attention layer over the ids before, whose output corrects the logarithm of the neighbour counts. Its tables are
trained in the tasks, on every window of every training document: the ids are written once, and each of ROUNDS rounds takes
its share of the documents, by a hash of id and ids, in shards of about SHARD_TARGETS targets. All shards start from the
same tables, run Adam over their own windows, and the tables are averaged, weighted by targets. Shares, shards and the
order within them hang on the documents alone, so the model is the same however rows are dealt to tasks, but for the last
digits of 32-bit sums. Each share is gone over as often as it takes to see LEAST_TARGETS targets of the whole corpus. No
task holds more than a chunk of windows; tables are added in a tree, MERGED shards at a time.

Scoring reads windows of WINDOW ids that overlap by half: the first half is context only, each id of the second half
is scored, so every token is scored once with at least half a window before it, or all there is.

Words as frequent as the DICTIONARY_WORDS most frequent ones are looked up in a broadcast table of that size. The
others leave the scoring tasks as (row, word hash, times) and meet their counts in a join, whose sums go back to their
rows; so every count is exact whatever the vocabulary.

Defined cases: a null text counts as empty and has the end as its only token; a null id belongs to training; repeated
ids are rows of their own; without training documents all counts are 0 and ids are equally likely; texts of any length
are scored whole; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellsieve.llm.common import LOWER, SPACES, U64, chunks, crc_remainder, discard, mix, span_hashes, spool, word_spans
from cellsieve.session import cut

CLASSES = 128
DIM = 16
WINDOW = 32
HALF = WINDOW // 2
ROUNDS = 4
LEAST_TARGETS = 512_000
MOST_PASSES = 500
MERGED = 32
SHARD_TARGETS = 1_500_000
CHUNK_TARGETS = 200_000
BATCH = 256
RATE = 0.02
TILE = 1024
DICTIONARY_WORDS = 1 << 20
TASK_WORDS = 400_000
END = 0
END_HASH = int(mix(np.array([77], U64)).view(np.int64)[0])
PAD = CLASSES


class Words(NamedTuple):
    """Tokens of a run of rows, ends included: hashes, subword ids, and each row's first token, plus the total."""

    hashes: np.ndarray
    ids: np.ndarray
    first: np.ndarray


def tokens_of(data: np.ndarray, offsets: np.ndarray) -> Words:
    starts, ends, first = word_spans(SPACES[data], offsets)
    lower = LOWER[data]
    hashes = span_hashes(lower, starts, ends).view(np.int64)
    tails = span_hashes(lower, np.maximum(starts, ends - 3), ends)
    ids = (tails % U64(CLASSES - 1)).astype(np.int64) + 1
    at = first[1:]
    return Words(np.insert(hashes, at, END_HASH), np.insert(ids, at, END), first + np.arange(len(first)))


def windows_of(ids: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Inputs (n, WINDOW) and targets (n, HALF) of all rows; PAD where there is nothing. A row's first input is END."""
    sizes = np.diff(first)
    count = -(-sizes // HALF)
    begin = np.concatenate([np.zeros(1, np.int64), np.cumsum(count)])
    row = np.repeat(np.arange(len(sizes)), count)
    start = (np.arange(begin[-1]) - begin[row]) * HALF  # of the targets, within the row
    at = start[:, None] + np.arange(HALF)
    inside = at < sizes[row][:, None]
    padded = np.concatenate([ids, [PAD]])
    targets = padded[np.where(inside, first[row][:, None] + at, len(ids))]
    before = start[:, None] + np.arange(-HALF, HALF) - 1
    inputs = padded[np.where((before >= 0) & (before < sizes[row][:, None]), first[row][:, None] + before, len(ids))]
    inputs[before == -1] = END
    return inputs, targets


def add_by_id(out: np.ndarray, ids: np.ndarray, rows: np.ndarray) -> None:
    """Add the rows of each id to its row of `out`."""
    flat = ids.ravel().astype(np.uint8)
    order = np.argsort(flat, kind="stable")
    flat = flat[order]
    starts = np.flatnonzero(np.diff(flat, prepend=np.int16(-1)))
    out[flat[starts]] += np.add.reduceat(rows.reshape(-1, rows.shape[-1])[order], starts, axis=0)


class Attention:
    """One causal self-attention layer over subword ids; queries, keys and values are tables by id."""

    def __init__(self, pairs: np.ndarray, seed: int = 5) -> None:
        rng = np.random.default_rng(seed)
        smooth = pairs + 0.5
        self.neighbour = np.log(smooth / smooth.sum(axis=1, keepdims=True)).astype(np.float32)
        self.neighbour = np.concatenate([self.neighbour, np.zeros((1, CLASSES), np.float32)])
        draw = lambda *shape: rng.normal(0, 0.3, shape).astype(np.float32)
        self.tables = {
            "query": draw(CLASSES + 1, DIM),
            "key": draw(CLASSES + 1, DIM),
            "value": draw(CLASSES + 1, DIM),
            "near": np.zeros(WINDOW, np.float32),
            "out": np.zeros((DIM, CLASSES), np.float32),
        }
        ahead = np.arange(HALF, WINDOW)[:, None] - np.arange(WINDOW)[None, :]
        self.distance = np.maximum(ahead, 0)
        self.hidden = np.where(ahead < 0, np.float32(-1e9), np.float32(0))

    def forward(self, inputs: np.ndarray):
        """Attention weights, their values and the log-probabilities (n, HALF, CLASSES) of the next id."""
        t, last = self.tables, inputs[:, HALF:]
        query, key, value = t["query"][last] / np.float32(np.sqrt(DIM)), t["key"][inputs], t["value"][inputs]
        weight = query @ key.transpose(0, 2, 1)
        weight += t["near"][self.distance] + self.hidden
        weight += np.where(inputs == PAD, np.float32(-1e9), np.float32(0))[:, None, :]
        weight -= weight.max(axis=2, keepdims=True)
        np.exp(weight, out=weight)
        weight /= weight.sum(axis=2, keepdims=True)
        mixed = weight @ value
        logits = self.neighbour[last]
        logits += (mixed.reshape(-1, DIM) @ t["out"]).reshape(logits.shape)
        return query, key, value, weight, mixed, logits

    def log10(self, inputs: np.ndarray, targets: np.ndarray) -> np.ndarray:
        """log10 of the probability of each target; 0 where there is none."""
        out = np.zeros(targets.shape)
        for at in range(0, len(inputs), TILE):
            logits = self.forward(inputs[at : at + TILE])[-1]
            goal = targets[at : at + TILE]
            own = np.take_along_axis(logits, np.minimum(goal, CLASSES - 1)[:, :, None], axis=2)[:, :, 0]
            most = logits.max(axis=2)
            logits -= most[:, :, None]
            np.exp(logits, out=logits)
            found = own - most - np.log(logits.sum(axis=2))
            out[at : at + TILE] = np.where(goal == PAD, 0.0, found / np.log(10.0))
        return out

    def gradients(self, inputs: np.ndarray, targets: np.ndarray) -> dict[str, np.ndarray]:
        t, last = self.tables, inputs[:, HALF:]
        query, key, value, weight, mixed, logits = self.forward(inputs)
        logits -= logits.max(axis=2, keepdims=True)
        p = np.exp(logits)
        p /= p.sum(axis=2, keepdims=True)
        w, q = np.nonzero(targets < CLASSES)
        p[w, q, targets[w, q]] -= 1
        p[targets == PAD] = 0
        p /= max(1, len(w))
        flat = p.reshape(-1, CLASSES)
        back = (flat @ t["out"].T).reshape(mixed.shape)
        to_weight = back @ value.transpose(0, 2, 1)
        score = weight * (to_weight - (weight * to_weight).sum(axis=2, keepdims=True))
        out = {k: np.zeros_like(v) for k, v in t.items()}
        out["out"] = mixed.reshape(-1, DIM).T @ flat
        add_by_id(out["value"], inputs, weight.transpose(0, 2, 1) @ back)
        add_by_id(out["key"], inputs, score.transpose(0, 2, 1) @ query)
        add_by_id(out["query"], last, score @ key / np.float32(np.sqrt(DIM)))
        np.add.at(out["near"], self.distance, np.where(self.hidden < 0, 0, score.sum(axis=0)))
        return out

    def train(self, ids: np.ndarray, first: np.ndarray, steps: int | None = None, passes: int = 1, adam: Adam | None = None, rate: float = RATE) -> int:
        """Adam over all windows of the given rows in a random order, `passes` times or for `steps` steps; the number of
        targets in these rows."""
        inputs, targets = windows_of(ids, first)
        if not len(inputs):
            return 0
        adam = adam or Adam(self.tables)
        each = -(-len(inputs) // BATCH)
        for step in range(passes * each if steps is None else steps):
            if step % each == 0:
                order = adam.rng.permutation(len(inputs))
            pick = order[step % each * BATCH :][:BATCH]
            adam.step(self.tables, self.gradients(inputs[pick], targets[pick]), rate)
        return int((targets != PAD).sum())

    def packed(self) -> np.ndarray:
        return np.concatenate([self.tables[k].ravel() for k in sorted(self.tables)]).astype(np.float64)

    def unpack(self, values: np.ndarray) -> None:
        at = 0
        for k in sorted(self.tables):
            table = self.tables[k]
            self.tables[k] = values[at : at + table.size].reshape(table.shape).astype(np.float32)
            at += table.size


class Adam:
    def __init__(self, tables: dict[str, np.ndarray], seed: int = 6) -> None:
        self.rng, self.steps = np.random.default_rng(seed), 0
        self.mean = {k: np.zeros_like(v) for k, v in tables.items()}
        self.square = {k: np.zeros_like(v) for k, v in tables.items()}

    def step(self, tables: dict[str, np.ndarray], gradients: dict[str, np.ndarray], rate: float) -> None:
        self.steps += 1
        for k, g in gradients.items():
            self.mean[k] = 0.9 * self.mean[k] + 0.1 * g
            self.square[k] = 0.999 * self.square[k] + 0.001 * g * g
            mean, square = self.mean[k] / (1 - 0.9**self.steps), self.square[k] / (1 - 0.999**self.steps)
            tables[k] -= (rate * (mean / (np.sqrt(square) + 1e-8))).astype(np.float32)


class Counts(NamedTuple):
    """Frequent words with their counts, by hash; tokens and distinct words by id; neighbouring ids; N and V."""

    hashes: np.ndarray
    counts: np.ndarray
    tokens: np.ndarray
    distinct: np.ndarray
    pairs: np.ndarray
    total: int
    vocabulary: int


def gather_counts(texts: DataFrame) -> DataFrame:
    """(h, id, other, n): word counts (other is null), and counts of neighbouring ids (h is null)."""

    def job(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, ids, counts = [], [], []
        pairs = np.zeros((CLASSES, CLASSES), np.int64)

        def merged() -> list[np.ndarray]:
            h, i, n = (np.concatenate(x) for x in (hashes, ids, counts))
            h, first, where = np.unique(h, return_index=True, return_inverse=True)
            return [h, i[first], np.bincount(where, n, len(h)).astype(np.int64)]

        def rows(h, i, n, other=None) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [
                    pa.nulls(len(i), pa.int64()) if h is None else pa.array(h),
                    pa.array(i.astype(np.int32)),
                    pa.nulls(len(i), pa.int32()) if other is None else pa.array(other.astype(np.int32)),
                    pa.array(n),
                ],
                names=["h", "id", "other", "n"],
            )

        held = 0
        for batch in batches:
            for _, _, data, offsets in chunks(batch.column(0)):
                words = tokens_of(data, offsets)
                h, first, n = np.unique(words.hashes, return_index=True, return_counts=True)
                hashes.append(h), ids.append(words.ids[first]), counts.append(n.astype(np.int64))
                before = np.concatenate([[END], words.ids[:-1]])
                before[words.first[:-1]] = END
                pairs += np.bincount(before * CLASSES + words.ids, minlength=CLASSES * CLASSES).reshape(CLASSES, CLASSES)
                held += len(h)
                if held > 4 * TASK_WORDS:
                    h, i, n = merged()
                    if len(h) > TASK_WORDS:
                        yield rows(h, i, n)
                        hashes, ids, counts, held = [], [], [], 0
                    else:
                        hashes, ids, counts, held = [h], [i], [n], len(h)
        if held:
            yield rows(*merged())
        a, b = np.nonzero(pairs)
        yield rows(None, a, pairs[a, b], b)

    found = texts.mapInArrow(job, "h long, id int, other int, n long")
    return found.groupBy("h", "id", "other").agg(F.sum("n").alias("n"))


def collect_counts(counts: DataFrame, most: int) -> tuple[Counts, int]:
    """What scoring tasks need, and the least count of a word in the broadcast table."""
    words = counts.where("h IS NOT NULL")
    tokens, distinct = np.zeros(CLASSES, np.int64), np.zeros(CLASSES, np.int64)
    for r in words.groupBy("id").agg(F.sum("n").alias("n"), F.count("*").alias("v")).collect():
        tokens[r["id"]], distinct[r["id"]] = r["n"], r["v"]
    pairs = np.zeros((CLASSES, CLASSES), np.float64)
    for r in counts.where("h IS NULL").collect():
        pairs[r["id"], r["other"]] = r["n"]
    least, reached = 1, 0
    by_count = words.groupBy(F.least("n", F.lit(10_000)).alias("n")).count().collect()
    for n, count in sorted(((r["n"], r["count"]) for r in by_count), reverse=True):
        reached += count
        if reached > most:
            least = n + 1
            break
    frequent = words.where(F.col("n") >= least).where(F.lit(least <= 10_000)).select("h", "n").toArrow()
    h, n = frequent.column("h").to_numpy(), frequent.column("n").to_numpy()
    order = np.argsort(h)
    return Counts(h[order], n[order], tokens, distinct, pairs, int(tokens.sum()), int(distinct.sum())), least


SUMS = "shard long, n long, tables binary"


def _ids(training: DataFrame, shards: int) -> DataFrame:
    """(share, shard, key, ids) of every training document: its round, its shard there, and its subword ids as bytes."""

    def job(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, end, data, offsets in chunks(batch.column(1)):
                words = tokens_of(data, offsets)
                flat = pa.array([words.ids.astype(np.uint8).tobytes()]).buffers()[2]
                ids = pa.BinaryArray.from_buffers(pa.binary(), end - row, [None, pa.py_buffer(words.first.astype(np.int32)), flat])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(row, end - row), ids], names=["doc", "ids"])

    found = training.select(F.col("doc_id").cast("string").alias("doc"), "text").mapInArrow(job, "doc string, ids binary")
    key = F.xxhash64("doc", "ids")
    return found.select(
        F.pmod(key, F.lit(ROUNDS)).alias("share"),
        F.pmod(F.shiftrightunsigned(key, 8), F.lit(shards)).alias("shard"),
        key.alias("key"),
        "ids",
    )


def _trained(rows: DataFrame, model: Attention, passes: int, rate: float, seed: int) -> DataFrame:
    """(shard, n, tables): of each shard the targets it trained on, and its tables times that number."""
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def job(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current: int | None = None
        net, adam, n = None, None, 0
        held: list[np.ndarray] = []
        targets = 0

        def learn() -> int:
            first = np.concatenate([[0], np.cumsum([len(h) for h in held])])
            return net.train(np.concatenate(held).astype(np.int64), first, passes=passes, adam=adam, rate=rate)

        def done() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([current]), pa.array([n]), pa.array([(n * net.packed()).tobytes()])], names=["shard", "n", "tables"])

        for batch in batches:
            for shard, ids in zip(batch.column(0).to_pylist(), batch.column(1)):
                if shard != current:
                    if held:
                        n += learn()
                        yield done()
                    current, held, targets, n = shard, [], 0, 0
                    net = pickle.loads(pickle.dumps(shared.value))
                    adam = Adam(net.tables, seed)
                elif targets >= CHUNK_TARGETS:
                    n += learn()
                    held, targets = [], 0
                held.append(np.frombuffer(ids.as_buffer(), np.uint8))
                targets += len(held[-1])
        if held:
            n += learn()
            yield done()

    ordered = rows.repartition("shard").sortWithinPartitions("shard", "key", "ids")
    return ordered.select("shard", "ids").mapInArrow(job, SUMS)


def _summed(rows: DataFrame) -> list:
    """Sums of n and tables, MERGED shards at a time in the order of their numbers, until so many are left."""

    def job(table: pa.Table) -> pa.Table:
        table = table.sort_by("shard")
        total = sum(np.frombuffer(v, np.float64) for v in table.column("tables").to_pylist())
        shard = table.column("shard")[0].as_py() // MERGED
        return pa.table({"shard": [shard], "n": [sum(table.column("n").to_pylist())], "tables": pa.array([total.tobytes()], pa.binary())})

    rows = cut(rows)
    while (rows.agg(F.max("shard")).head()[0] or 0) >= MERGED:
        rows = cut(rows.groupBy(F.floor(F.col("shard") / MERGED)).applyInArrow(job, SUMS))
    return sorted(rows.collect(), key=lambda r: r["shard"])


def train_model(training: DataFrame, pairs: np.ndarray, total: int) -> tuple[Attention, int]:
    """The model trained on all documents, which have `total` tokens, and the number of different targets it learned from."""
    model, seen = Attention(pairs), 0
    passes = min(MOST_PASSES, -(-LEAST_TARGETS // max(1, total)))
    ids, path = spool(_ids(training, -(-max(1, total) // (ROUNDS * SHARD_TARGETS))))
    for number in range(ROUNDS):
        rate = RATE * (1 - number / ROUNDS)
        sums = _summed(_trained(ids.where(F.col("share") == number), model, passes, rate, number))
        n = sum(r["n"] for r in sums)
        if n:
            model.unpack(sum(np.frombuffer(r["tables"], np.float64) for r in sums) / n)
        seen += n
    discard(training.sparkSession, path)
    return model, seen


def _scored(docs: DataFrame, counts: Counts, model: Attention) -> DataFrame:
    """One row per document: sums over the frequent words, and hashes and numbers of the other words."""
    shared = docs.sparkSession.sparkContext.broadcast((counts, model))

    def job(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, net = shared.value
        below = np.log10(table.tokens + table.distinct + 1.0)
        number = TaskContext.get().partitionId() << 40
        for batch in batches:
            for row, end, data, offsets in chunks(batch.column(2)):
                words = tokens_of(data, offsets)
                inputs, targets = windows_of(words.ids, words.first)
                lm = net.log10(inputs, targets)[targets != PAD]
                h, where = np.unique(words.hashes, return_inverse=True)
                if len(table.hashes):
                    at = np.minimum(np.searchsorted(table.hashes, h), len(table.hashes) - 1)
                    n = np.where(table.hashes[at] == h, table.counts[at], 0)
                else:
                    n = np.zeros(len(h), np.int64)
                count = n[where]
                sums = [np.add.reduceat(x, words.first[:-1]) for x in (np.log10(count + 1.0), (count > 0).astype(np.int64), lm - below[words.ids])]
                rest = np.flatnonzero(count == 0)
                of_row = np.searchsorted(rest, words.first)
                spans = pa.array(of_row.astype(np.int32))
                size = end - row
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(row, size),
                        batch.column(1).slice(row, size),
                        pa.array(np.arange(number, number + size)),
                        pa.array(np.diff(words.first)),
                        *(pa.array(s) for s in sums),
                        pa.ListArray.from_arrays(spans, pa.array(words.hashes[rest])),
                    ],
                    names=["doc_id", "held_out", "row", "n_tokens", "log_counts", "known", "log_model", "rest"],
                )
                number += size

    kind = docs.schema["doc_id"].dataType.simpleString()
    fields = f"doc_id {kind}, held_out boolean, row long, n_tokens long, log_counts double, known long, log_model double, rest array<long>"
    return docs.mapInArrow(job, fields)


def score_documents(docs: DataFrame, most: int = DICTIONARY_WORDS) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every document."""
    rows = docs.select("doc_id", F.expr(f"{crc_remainder('doc_id', 7)} = 2").alias("held_out"), "text")
    training = rows.where("NOT held_out").select("doc_id", "text")
    counts = cut(gather_counts(training.select("text")))
    table, least = collect_counts(counts, most)
    model, _ = train_model(training, table.pairs, table.total)
    scored = cut(_scored(rows, table, model))
    rest = scored.select("row", F.explode("rest").alias("h")).groupBy("row", "h").agg(F.count("*").alias("times"))
    # Beyond 10,000 counts are not told apart; the broadcast table is empty then, and every word is looked up here.
    below = F.col("n") < least if least <= 10_000 else F.lit(True)
    rare = counts.where(F.col("h").isNotNull() & below).select("h", "n")
    sums = rest.join(rare, "h").groupBy("row").agg(
        F.sum(F.col("times") * F.log10(F.col("n") + 1.0)).alias("more"), F.sum("times").alias("more_known")
    )
    joined = scored.drop("rest").join(sums, "row", "left").na.fill(0, ["more_known"]).na.fill(0.0, ["more"])
    log_counts = F.col("log_counts") + F.col("more")
    return joined.select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("known") + F.col("more_known")).alias("n_known"),
        F.lit(table.total).cast("long").alias("train_tokens"),
        (log_counts - F.col("n_tokens") * F.log10(F.lit(float(table.total + table.vocabulary + 1)))).alias("base_score"),
        (log_counts + F.col("log_model")).alias("score"),
    )

"""N-gram Jaccard join by PartEnum signatures.

A document's set is its distinct word n-grams, as 64-bit hashes. Two sets link when intersection / union reaches the
threshold. Sets are put into size bands [l, l / threshold]. Sets that link lie in one band or in neighbouring ones, so each
set signs for its own band and, unless it is too small, for the next. Under a band that ends at r, linked sets differ
in at most k = 2 r (1 - t) / (1 + t) features.

PartEnum: the feature domain is cut by hash into parts, and each part into pieces; a part's signatures are all choices
of pieces that leave out as many as it tolerates differences. With n1 = k // (tolerated + 1) + spare parts, linked
sets hold no more than the tolerated differences in at least `spare` parts, and so agree on all features of one choice
in each of these: no link is lost, at any size. From 0.85 on, a part tolerates one difference and has three pieces,
which makes long, selective signatures; below, sets may differ so much that three choices of small pieces cost more
than they tell apart, and a part is one piece that tolerates none.

Signatures of pieces without any feature would bring together whatever leaves the same place empty. A set sends them only
if at least `spare` of its parts have an empty choice: of two linked sets that agree on empty choices alone both do,
because they agree in that many parts. `spare` is chosen per band so that hardly any set gets there.

From signatures to links:

1. Equal sets are one class, named by the smallest document id; only classes go on.
2. Signatures are written once and brought together in ROUNDS rounds, a share of them by hash each, whose shuffle is removed
   before the next one's. Every class of a signature but the smallest, its hub, is compared with the hub by exact
   intersection of the sets.
3. A class that doesn't link to a hub it shares a signature with is compared with all other classes of that hub, in
   blocks: counts of features by SKETCH hash buckets bound every intersection from above and leave few classes that may
   link at all; for these a task takes two blocks of a hub's classes, makes the 0/1 matrix of the features that occur at
   least twice, and gets all intersections as one matrix product. Classes that do link to the hub are not compared with each other. A
   task sends at most one link per class and block, a spanning forest of the linked pairs, so no group is written out as
   pairs, and none is held by one task. Comparisons go in rounds whose sketches or features take about ROUND_BYTES,
   because there may be many more pairs and members than sets.
4. Components of all links by label propagation with pointer jumping over written tables.

Defined cases: null and empty texts, and texts without words, have an empty set and link with nothing; a text with
fewer words than n has its whole word sequence as the one feature; repeated rows are exact copies, so they link unless
empty; a null id is a document of its own, alone; ties go to the smallest id; an empty table gives no rows; extra
columns are ignored by the join.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from fractions import Fraction
from functools import lru_cache, partial, reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellsieve.llm.common import LOWER, SPACES, U64, chunks, discard, mix, release, small_batches, span_hashes, sparing, spool, word_spans
from cellsieve.session import cut

BLOCK_FEATURES = 400_000
BLOCK_SETS = 4096
SKETCH = 128
SLAB = 4096
ROUNDS = 4
BROADCAST_CLASSES = 500_000
SEEN = 1 << 18
# Bytes of text hashed at once. A task takes about 35 times that, which a Python worker may keep while later tasks run.
CHUNK = 1 << 19
# What one round of comparisons shuffles: bytes of sketches or features that go along with pairs and members.
ROUND_BYTES = 1 << 28
SKETCH_TOP = 127
SKETCH_BYTES = SKETCH + 64


def band_of(size: int, threshold: Fraction) -> int:
    """The number of the size band: the first ends at 1, each next one begins after and ends at begin / threshold."""
    return int(np.searchsorted(band_ends(threshold), size))


_ends: dict[Fraction, np.ndarray] = {}


def band_ends(threshold: Fraction) -> np.ndarray:
    if threshold not in _ends:
        # Where only equal sets link, all sizes are one band.
        ends = [0, 1 << 40] if threshold == 1 else [0]
        while ends[-1] < 1 << 40:
            ends.append(math.floor((ends[-1] + 1) / threshold))
        _ends[threshold] = np.array(ends, np.int64)
    return _ends[threshold]


def differences(end: int, threshold: Fraction) -> int:
    """The most features in which two linked sets of at most `end` features can differ."""
    return math.floor(2 * end * (1 - threshold) / (1 + threshold))


def set_of(hashes: np.ndarray, n: int) -> np.ndarray:
    """Distinct n-grams of a word sequence, sorted."""
    if len(hashes) == 0:
        return hashes
    n = min(n, len(hashes))
    size = len(hashes) - n + 1
    total = np.full(size, U64(n))
    for k in range(n):
        total = mix(total ^ hashes[k : k + size]) if k else mix(total + hashes[:size])
    return np.unique(total)


def document_sets(column: pa.Array, n: int) -> Iterator[np.ndarray]:
    for _, _, data, offsets in chunks(column, CHUNK):
        starts, ends, first = word_spans(SPACES[data], offsets)
        hashes = span_hashes(LOWER[data], starts, ends)
        for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
            yield set_of(hashes[a:b], n)


def set_name(features: np.ndarray) -> int:
    """A 64-bit name of a set, equal for equal sets."""
    total = mix(features).sum(dtype=U64, keepdims=True) + U64(len(features))
    return int(mix(total).view(np.int64)[0])


class Scheme(NamedTuple):
    """How a band's sets sign: parts, pieces of a part, and in how many parts linked sets are sure to agree."""

    parts: int
    pieces: int
    spare: int


@lru_cache(maxsize=4096)
def scheme(band: int, threshold: Fraction) -> Scheme | None:
    """The scheme of a band; None where linked sets are equal sets."""
    ends = band_ends(threshold)
    k = differences(int(ends[band]), threshold)
    if k == 0:
        return None
    pieces = 3 if threshold >= Fraction(85, 100) else 1
    needed = k // 2 if pieces == 3 else k
    least = (int(ends[band - 1]) + 1) * float(threshold)  # the smallest set that signs here
    spare = 1
    for _ in range(20):
        filled = least / (needed + spare) * (2 / 3 if pieces == 3 else 1)
        empty = (needed + spare) * min(1.0, pieces * math.exp(-filled))
        spare = min(max(1, math.ceil(empty + 3 * math.sqrt(empty) - 0.1)), needed + 8)
    return Scheme(needed + spare, pieces, spare)


def signatures(features: np.ndarray, threshold: Fraction) -> np.ndarray:
    """PartEnum signatures of a set for its own band and the next."""
    size, ends = len(features), band_ends(threshold)
    band = band_of(size, threshold)
    out = []
    spread = mix(features + U64(0x51ED270B))
    values = mix(features ^ U64(0xA0761D6478BD642F))
    # A set links with one of the next band only if that one's least size allows it.
    tags = [band] + [band + 1] * (size >= math.ceil((int(ends[band]) + 1) * threshold))
    for tag in tags:
        plan = scheme(tag, threshold)
        label = mix(np.array([tag + 1], U64))
        if plan is None:
            out.append(mix(label + values.sum(dtype=U64, keepdims=True)))
            continue
        parts, pieces, spare = plan
        cell = ((spread >> U64(32)) * U64(parts) >> U64(32)).astype(np.int64) * pieces + (spread % U64(pieces)).astype(np.int64)
        order = np.argsort(cell, kind="stable")
        sums = np.zeros(len(features) + 1, U64)
        np.cumsum(values[order], out=sums[1:])
        at = np.searchsorted(cell[order], np.arange(parts * pieces + 1))
        counts = (at[1:] - at[:-1]).reshape(parts, pieces)
        held = mix(sums[at[1:]] - sums[at[:-1]] + (at[1:] - at[:-1]).astype(U64)).reshape(parts, pieces)
        number = np.arange(parts, dtype=U64) * U64(pieces)
        choices = [[c for c in range(pieces) if c != left_out] or [0] for left_out in range(pieces)]
        filled = np.stack([counts[:, chosen].sum(axis=1) for chosen in choices], axis=1) > 0
        send_empty = int((~filled).any(axis=1).sum()) >= spare
        for left_out, chosen in enumerate(choices):
            total = mix(held[:, chosen[0]] + label)
            for c in chosen[1:]:
                total = mix(total + held[:, c] * U64(3))
            sig = mix(total + mix(number + U64(left_out) + label))
            out.append(sig if send_empty else sig[filled[:, left_out]])
    return np.concatenate(out)


def _classes(docs: DataFrame, n: int) -> DataFrame:
    """(doc_id, n_shingles, name) of every row."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def job(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, names = [], []
            for s in document_sets(batch.column(1), n):
                sizes.append(len(s))
                names.append(set_name(s) if len(s) else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(names, pa.int64())], names=["doc_id", "n_shingles", "name"]
            )

    return docs.select("doc_id", "text").mapInArrow(sparing(job), f"doc_id {kind}, n_shingles long, name long")


def _signed(docs: DataFrame, n: int, threshold: Fraction) -> DataFrame:
    """(sig, name), mostly once per set and task."""

    def job(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        sigs, names, held = [], [], 0
        for batch in batches:
            for s in document_sets(batch.column(0), n):
                if not len(s):
                    continue
                name = set_name(s)
                if name in seen:
                    continue
                if len(seen) >= SEEN:
                    seen.clear()
                seen.add(name)
                own = signatures(s, threshold)
                sigs.append(own)
                names.append(np.full(len(own), name))
                held += len(own)
                if held > 100_000:
                    yield _two(sigs, names)
                    sigs, names, held = [], [], 0
        if held:
            yield _two(sigs, names)

    def _two(sigs: list, names: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate(sigs).view(np.int64)), pa.array(np.concatenate(names))], names=["sig", "name"]
        )

    return docs.where("doc_id IS NOT NULL").select("text").mapInArrow(sparing(job), "sig long, name long")


def sketch_of(features: np.ndarray) -> np.ndarray:
    """How many features fall into each of SKETCH buckets by hash, at most SKETCH_TOP, which fits a byte. Two sets share
    no more than the sum of the smaller counts, and beyond the tops no more than the smaller of what is left of each."""
    counts = np.bincount((features % U64(SKETCH)).astype(np.int64), minlength=SKETCH)
    return np.minimum(counts, SKETCH_TOP).astype(np.int8)


def may_link(
    left: np.ndarray, right: np.ndarray, percent: int, left_sizes: np.ndarray | None = None, right_sizes: np.ndarray | None = None
) -> np.ndarray:
    """rows x columns of sketches, with the sizes of the sets where counts may be at their top: False where the sets can't
    link."""
    left_sizes, right_sizes = (
        counts.sum(axis=1, dtype=np.int64) if sizes is None else sizes for counts, sizes in ((left, left_sizes), (right, right_sizes))
    )
    shared = np.zeros((len(left), len(right)), np.int32)
    for b in range(SKETCH):
        shared += np.minimum(left[:, b][:, None], right[:, b][None, :])
    over = [sizes - counts.sum(axis=1, dtype=np.int64) for sizes, counts in ((left_sizes, left), (right_sizes, right))]
    shared = shared.astype(np.int64) + np.minimum(over[0][:, None], over[1][None, :])
    union = left_sizes[:, None] + right_sizes[None, :] - shared
    return 100 * shared >= percent * union


def _sets(docs: DataFrame, n: int) -> DataFrame:
    """(name, features, sketch) of the given documents that have the named set: an id may stand for several texts."""

    def job(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            wanted = batch.column(0).to_pylist()
            every = zip(wanted, document_sets(batch.column(1), n))
            named = [(w, s) for w, s in every if len(s) and set_name(s) == w]
            names, found = [w for w, _ in named], [s for _, s in named]
            lengths = np.cumsum([0, *map(len, found)]).astype(np.int32)
            flat = np.concatenate(found).view(np.int64) if found else np.zeros(0, np.int64)
            sketches = np.concatenate([np.zeros(0, np.int8), *map(sketch_of, found)])
            at = pa.array(np.arange(len(found) + 1, dtype=np.int32) * SKETCH)
            lists = [pa.ListArray.from_arrays(pa.array(lengths), pa.array(flat)), pa.ListArray.from_arrays(at, pa.array(sketches))]
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), *lists], names=["name", "features", "sketch"])

    return docs.select("name", "text").mapInArrow(sparing(job), "name long, features array<long>, sketch array<tinyint>")


def _rounds(rows: DataFrame, keys: tuple[str, ...], size: int) -> Iterator[tuple[DataFrame, Callable[[DataFrame, str], DataFrame]]]:
    """A written table in shares by hash of its keys, as many as rounds of ROUND_BYTES take for `size` bytes. After each
    its shuffles are removed, so what stands on disk at once doesn't grow with the table. With a share comes a function
    (values, key) that keeps of other rows what the share will meet: else every round would shuffle all of them, and that
    would grow with the rows and with the rounds."""
    rounds = max(1, -(-size // ROUND_BYTES))
    if rounds == 1:
        yield rows, lambda values, key: values
        release(rows.sparkSession)
        return
    for n in range(rounds):
        some = rows.where(F.pmod(F.xxhash64(*keys, F.lit("round")), F.lit(rounds)) == n)
        yield some, partial(_met_by, some)
        release(rows.sparkSession)


def _met_by(some: DataFrame, values: DataFrame, key: str) -> DataFrame:
    """The values whose key stands in `some`; all of them where it has too many keys to be sent to every task."""
    met = cut(some.select(key).distinct())
    return values.join(F.broadcast(met), key, "left_semi") if met.count() <= BROADCAST_CLASSES else values


def _hub_links(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(name, hub, linked) of the pairs, by sketches and, where these leave it open, by exact intersection."""
    sketches = cut(sets.select("name", "sketch", F.size("features").alias("size")))
    hubs = sketches.select(F.col("name").alias("hub"), F.col("sketch").alias("of_hub"), F.col("size").alias("hub_size"))
    add = lambda v: F.aggregate(v, F.lit(0), lambda t, x: t + x)
    least = add(F.zip_with("sketch", "of_hub", lambda x, y: F.least(x, y).cast("int")))
    over = F.least(F.col("size") - add(F.col("sketch")), F.col("hub_size") - add(F.col("of_hub")))
    judged = []
    for some, only in _rounds(pairs, ("hub",), pairs.count() * SKETCH_BYTES):
        both = some.join(only(sketches, "name"), "name").join(only(hubs, "hub"), "hub")
        judged.append(cut(both.select("name", "hub", (F.col("size") + F.col("hub_size")).cast("long").alias("total"), (least + over).cast("long").alias("shared"))))
        del both
    maybe = reduce(DataFrame.union, judged)
    maybe = maybe.select("name", "hub", "total", (F.col("shared") * 100 >= (F.col("total") - F.col("shared")) * percent).alias("maybe"))
    features = sets.select("name", "features")
    of_hub = features.select(F.col("name").alias("hub"), F.col("features").alias("of_hub"))
    open_ = maybe.where("maybe").select("name", "hub", "total")
    shared = F.size(F.array_intersect("features", "of_hub"))
    union = F.size("features") + F.size("of_hub") - shared
    found = []
    for some, only in _rounds(open_, ("hub",), 8 * (open_.agg(F.sum("total")).head()[0] or 0)):
        exact = some.select("name", "hub").join(only(features, "name"), "name").join(only(of_hub, "hub"), "hub")
        found.append(cut(exact.select("name", "hub", (shared * 100 >= union * percent).alias("linked"))))
        del exact
    return reduce(DataFrame.union, found).union(maybe.where("NOT maybe").select("name", "hub", F.lit(False).alias("linked")))


def links_within(rows: list[np.ndarray], columns: list[np.ndarray], percent: int) -> np.ndarray:
    """rows x columns: which sets link, through the matrix of features that occur at least twice."""
    every = rows + columns
    flat = np.concatenate(every)
    features, where, counts = np.unique(flat, return_inverse=True, return_counts=True)
    number = np.cumsum(counts > 1) - 1
    owner = np.repeat(np.arange(len(every)), [len(s) for s in every])
    keep = counts[where] > 1
    owner, where = owner[keep], number[where[keep]]
    order = np.argsort(where, kind="stable")
    owner, where = owner[order], where[order]
    shared = np.zeros((len(rows), len(columns)), np.float32)
    width = int(number[-1]) + 1 if len(number) else 0
    for low in range(0, width, SLAB):
        a, b = np.searchsorted(where, [low, low + SLAB])
        slab = np.zeros((len(every), min(SLAB, width - low)), np.float32)
        slab[owner[a:b], where[a:b] - low] = 1
        shared += slab[: len(rows)] @ slab[len(rows) :].T
    sizes = np.array([len(s) for s in every], np.float64)
    union = sizes[: len(rows), None] + sizes[None, len(rows) :] - shared
    return 100 * shared.astype(np.float64) >= percent * union


def forest(linked: np.ndarray, rows: np.ndarray, columns: np.ndarray) -> Iterator[tuple[int, int]]:
    """Links that join what the matrix joins: at most one for each row and column."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while parent.get(x, x) != x:
            parent[x] = parent.get(parent[x], parent[x])
            x = parent[x]
        return x

    for r, c in zip(*np.nonzero(linked)):
        a, b = root(int(rows[r])), root(int(columns[c]))
        if a != b:
            parent[max(a, b)] = min(a, b)
            yield min(a, b), max(a, b)


def _in_blocks(members: DataFrame, weights: DataFrame, values: DataFrame, most: int, width: int) -> Iterator[DataFrame]:
    """members (hub, name, linked) with the values of each name, dealt to pairs of blocks (low, high) of their hub, of which
    `own` is theirs. A block holds about BLOCK_SETS sets, and sets of about `most` by weight (name, size). In rounds of
    whole pairs of blocks, by `width` bytes a row and unit of size."""
    sizes = members.join(weights, "name")
    blocks = F.greatest(F.ceil(F.col("total") / most), F.ceil(F.col("sets") / BLOCK_SETS)).cast("int")
    # Written first, so that Spark knows its size before it plans the join: only hubs of several blocks are in it.
    large = sizes.groupBy("hub").agg(F.sum("size").alias("total"), F.count("*").alias("sets")).select("hub", blocks.alias("blocks"))
    large = cut(large.where("blocks > 1"))
    rows = sizes.join(large, "hub", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    own = F.pmod(F.xxhash64("name"), F.col("blocks")).cast("int")
    rows = rows.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = cut(rows.select("hub", "name", "linked", "size", "own", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high")))
    size = width * (rows.agg(F.sum("size")).head()[0] or 0)
    for some, only in _rounds(rows.drop("size"), ("hub", "low", "high"), size):
        yield some.join(only(values, "name"), "name")


def _sides(table: pa.Table) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row and column numbers to compare: those that don't link to the hub with all others, in both directions."""
    own, low, high = (table.column(c).to_numpy() for c in ("own", "low", "high"))
    joined = table.column("linked").to_numpy()
    left, right = own == low[0], own == high[0]
    yield np.flatnonzero(left & ~joined), np.flatnonzero(right)
    if low[0] != high[0]:
        yield np.flatnonzero(left & joined), np.flatnonzero(right & ~joined)


def _lists(table: pa.Table, name: str) -> list[np.ndarray]:
    column = table.column(name).combine_chunks()
    values, at = column.flatten().to_numpy(), column.offsets.to_numpy() - column.offsets[0].as_py()
    return [values[a:b] for a, b in zip(at[:-1], at[1:])]


def _with_partners(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The members (hub, name, linked) that by their sketches may link to another one with which they are compared."""
    weights = sets.select("name", F.lit(1).alias("size"))

    def job(table: pa.Table) -> pa.Table:
        names, sketches = table.column("name").to_numpy(), np.array(_lists(table, "sketch")).reshape(-1, SKETCH)
        sizes = table.column("n").to_numpy().astype(np.int64)
        wanted = np.zeros(len(names), bool)
        for r, c in _sides(table):
            for at in range(0, len(r), 512):
                some = r[at : at + 512]
                if len(c):
                    maybe = may_link(sketches[some], sketches[c], percent, sizes[some], sizes[c]) & (names[some][:, None] != names[c][None, :])
                    wanted[some[maybe.any(axis=1)]] = True
                    wanted[c[maybe.any(axis=0)]] = True
        return table.filter(pa.array(wanted)).select(["hub", "name", "linked"])

    found = []
    for rows in _in_blocks(members, weights, sets.select("name", "sketch", F.size("features").alias("n")), BLOCK_SETS, SKETCH_BYTES):
        found.append(cut(rows.groupBy("hub", "low", "high").applyInArrow(job, "hub long, name long, linked boolean")))
        del rows
    return reduce(DataFrame.union, found).distinct()


def _block_links(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(low, high) links among the classes that share a hub. members: distinct (hub, name, linked); classes that link to
    the hub are joined by it already and are only compared with those that don't."""
    weights = sets.select("name", F.size("features").alias("size"))

    def job(table: pa.Table) -> pa.Table:
        names, features = table.column("name").to_numpy(), _lists(table, "features")
        found: list[tuple[int, int]] = []
        for r, c in _sides(table):
            if len(r) and len(c):
                linked = links_within([features[i] for i in r], [features[i] for i in c], percent)
                linked &= names[r][:, None] != names[c][None, :]
                found += forest(linked, names[r], names[c])
        return pa.table({"low": pa.array([a for a, _ in found], pa.int64()), "high": pa.array([b for _, b in found], pa.int64())})

    found = []
    for rows in _in_blocks(members, weights, sets.select("name", "features"), BLOCK_FEATURES, 8):
        found.append(cut(rows.groupBy("hub", "low", "high").applyInArrow(job, "low long, high long")))
        del rows
    return reduce(DataFrame.union, found)


def components(links: DataFrame) -> DataFrame:
    """(node, label) of all nodes of (low, high) links: the smallest node reachable. Each round every node takes the
    smallest label around it, then its label's own label."""
    both = cut(links.select("low", "high").union(links.select(F.col("high").alias("low"), F.col("low").alias("high"))).distinct())
    labels = cut(both.groupBy("low").agg(F.least(F.col("low"), F.min("high")).alias("label")).withColumnRenamed("low", "node"))
    while True:
        around = both.join(labels, F.col("high") == F.col("node")).groupBy("low").agg(F.min("label").alias("near"))
        better = labels.join(around, F.col("node") == F.col("low")).select("node", F.least("label", "near").alias("new"), "label")
        jump = better.select(F.col("node").alias("at"), F.col("new").alias("there"))
        following = cut(
            better.join(jump, F.col("new") == F.col("at")).select("node", F.least("new", "there").alias("label"), (F.least("new", "there") < F.col("label")).alias("moved"))
        )
        moved = following.where("moved").isEmpty()
        labels = following.select("node", "label")
        if moved:
            return labels


def _sharing_pairs(docs: DataFrame, words: int, threshold: Fraction) -> DataFrame:
    """Distinct (name, hub): the hub is the smallest of the classes that have a signature, name another one of them."""
    signed, path = spool(_signed(docs, words, threshold))
    rounds = [_one_round(signed, n) for n in range(ROUNDS)]
    discard(docs.sparkSession, path)
    return cut(reduce(DataFrame.union, rounds).distinct())


def _one_round(signed: DataFrame, n: int) -> DataFrame:
    some = signed.where(F.pmod("sig", F.lit(ROUNDS)) == n)
    every = some.withColumn("hub", F.expr("min(name) OVER (PARTITION BY sig)"))
    found = cut(every.where("name <> hub").select("name", "hub").distinct())
    del some, every
    release(signed.sparkSession)  # the signatures' shuffle is the largest
    return found


def _labelled(docs: DataFrame, words: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """(doc_id, n_shingles, name) of every row, and (name, component_id) of every named set."""
    threshold, spark = Fraction(percent, 100), docs.sparkSession
    small_batches(spark)
    every = cut(_classes(docs, words))
    classes = cut(every.where("name IS NOT NULL AND doc_id IS NOT NULL").groupBy("name").agg(F.min("doc_id").alias("first_id")))
    pairs = _sharing_pairs(docs, words, threshold)
    needed = cut(pairs.select("name").union(pairs.select("hub")).distinct().join(classes, "name").select("name", F.col("first_id").alias("doc_id")))
    # Texts stay where they are while the classes to be compared are few enough to go to them.
    few = needed.count() <= BROADCAST_CLASSES
    texts = docs.select("doc_id", "text").join(F.broadcast(needed) if few else needed, "doc_id")
    sets = cut(_sets(texts, words))
    if not sets.groupBy("name").count().where("count > 1").isEmpty():  # a repeated row
        sets = cut(sets.dropDuplicates(["name"]))
    compared = _hub_links(pairs, sets, percent)
    linked = compared.where("linked").select(F.col("hub").alias("low"), F.col("name").alias("high"))
    # Hubs with a class that doesn't link to them: that class is compared with all others of the hub.
    open_ = cut(compared.where("NOT linked").select("hub").distinct())
    members = compared.join(open_, "hub").select("hub", "name", "linked")
    members = members.union(open_.select("hub", F.col("hub").alias("name"), F.lit(True).alias("linked")))
    members = cut(_with_partners(cut(members), sets, percent))
    release(spark)
    labels = components(linked.union(_block_links(members, sets, percent)))
    joined = classes.join(labels, F.col("name") == F.col("node"))
    least = joined.groupBy("label").agg(F.min("first_id").alias("component_id"))
    of_name = labels.join(least, "label").select(F.col("node").alias("named"), "component_id")
    found = classes.join(of_name, F.col("name") == F.col("named"), "left")
    return every, found.select("name", F.coalesce("component_id", "first_id").alias("component_id"))


def _documents(every: DataFrame, found: DataFrame) -> DataFrame:
    named = "name IS NOT NULL AND doc_id IS NOT NULL"
    alone = every.where(f"NOT ({named})").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    # One class may hold a third of all rows: spread it over salts.
    salted = every.where(named).withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(16)))
    found = found.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(15).cast("long"))))
    return salted.join(found, ["name", "salt"]).select("doc_id", "n_shingles", "component_id").unionByName(alone)


def jaccard_components(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id): documents that links of at least percent / 100 join share a component."""
    return _documents(*_labelled(docs, words, percent))


def keep_first(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """One document of each component, the one with the smallest id; all columns as they are. Documents without words
    or ids stay, and of rows that repeat both id and text one stays. Where an id stands for several texts, each is
    judged by itself."""
    own = docs.select("doc_id", "text", "lang", "source", "n_chars")
    every, found = _labelled(own, words, percent)
    extra = _documents(every, found).where("doc_id <> component_id").select("doc_id").distinct()
    repeated = cut(every.where("doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1").select("doc_id"))
    if repeated.isEmpty():
        return own.join(extra, "doc_id", "left_anti")
    once = cut(own.join(repeated, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"]))
    named = every.join(repeated, "doc_id", "left_semi").join(found, "name").where("doc_id <> component_id")
    taken = named.select("doc_id", F.col("name").alias("set_name")).distinct()
    kept = _with_names(once, words).join(taken, ["doc_id", "set_name"], "left_anti").select(*own.columns)
    others = own.join(repeated, "doc_id", "left_anti").join(extra, "doc_id", "left_anti")
    return others.unionByName(kept)


def _with_names(docs: DataFrame, n: int) -> DataFrame:
    """The documents with `set_name`, null for an empty set."""

    def job(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = [set_name(s) if len(s) else None for s in document_sets(batch.column("text"), n)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(names, pa.int64())], names=[*batch.schema.names, "set_name"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return docs.mapInArrow(sparing(job), f"{schema}, set_name long")

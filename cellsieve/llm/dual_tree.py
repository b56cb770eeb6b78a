"""Ranked lexical search: a dual-tree search over items and documents.

1. Every whole text is cut into terms; those that stand in an item are kept as (terms, counts), the rest only counted. A
   term is found by a hash and then compared byte by byte. This small table is written; its counts give the weights.
2. A first search over the documents whose id hashes to one of SAMPLE classes gives each item k scores that are known
   to be reached: a safe lower bound of its kth score.
3. Tasks search their documents in batches. A batch becomes a hierarchy: documents ordered so that similar ones are
   neighbours, FAN to a node, nodes holding the maxima of their documents' coordinates. Items have such a hierarchy too,
   built once, whose nodes also hold the weakest kth score below them. The product of the maxima of two nodes bounds every
   score between their members, so a pair of nodes whose bound is below that weakest kth score leaves as a whole,
   and no document that ranks is lost. What is left at the bottom are exact scores.
4. The best k of each item and task are ranked by a window whose limit is applied before the shuffle as well.

Items are distinct texts, taken in blocks of at most ITEM_BYTES, one scan of the documents each; a hierarchy of items
holds at most ROOT_ITEMS of them and, but for a single longer one, ROOT_TERMS terms, so memory per task is bounded. A
text is read in pieces of PIECE_BYTES cut between terms, whatever its length.

Defined cases: a null text, or one without terms, is no document: it counts nowhere and is never found; an item without
terms gives no rows; a null doc_id is a document of its own, comes after all others among equal scores and is given
back as null; rows that repeat an id are documents of their own and may each rank; repeated item rows get the
same rows each; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cellsieve.llm.common import LOWER, byte_view, small_batches, span_hashes, word_spans
from cellsieve.session import cut

ITEM_BYTES = 16 * 1024 * 1024
ROOT_ITEMS = 512
ROOT_TERMS = 4096
BATCH_ENTRIES = 500_000
BATCH_DOCS = 256
FAN = 8
SAMPLE = 64
PIECE_BYTES = 1 << 18
NO_ID = np.iinfo(np.int64).max

# Every byte that belongs to no term: ASCII without digits and letters.
BETWEEN = np.zeros(256, bool)
BETWEEN[:128] = True
BETWEEN[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B)]] = False


def pieces(data: np.ndarray, offsets: np.ndarray, limit: int = PIECE_BYTES) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(rows, bytes, offsets) of runs of about `limit` bytes; a longer row is cut where no term is cut."""
    row, at, n = 0, 0, len(offsets) - 1
    while row < n:
        at = max(at, int(offsets[row]))
        end_row = int(np.searchsorted(offsets, at + limit, "right")) - 1
        if end_row > row:
            bounds = offsets[row : end_row + 1].copy()
            bounds[0] = at
            yield np.arange(row, end_row), data[at : bounds[-1]], bounds - at
            row, at = end_row, int(bounds[-1])
            continue
        end, last = min(at + limit, int(offsets[row + 1])), int(offsets[row + 1])
        while end < last:
            gaps = np.flatnonzero(BETWEEN[data[end : end + limit]])
            end = min(end + (int(gaps[0]) if len(gaps) else limit), last)
            if len(gaps):
                break
        yield np.array([row]), data[at:end], np.array([0, end - at])
        at = end
        if end >= last:
            row += 1


def terms_of(text: str) -> list[bytes]:
    data, offsets = byte_view(pa.array([text]))
    data = LOWER[data]
    starts, ends, _ = word_spans(BETWEEN[data], offsets)
    whole = data.tobytes()
    return [whole[a:b] for a, b in zip(starts.tolist(), ends.tolist())]


class Vocabulary:
    """Term numbers by exact bytes: candidates by hash, each compared in full."""

    def __init__(self, terms: list[bytes]):
        ends = np.cumsum([len(t) for t in terms], dtype=np.int64)
        data = np.frombuffer(b"".join(terms), np.uint8)
        starts = ends - np.array([len(t) for t in terms], np.int64)
        hashes = span_hashes(data, starts, ends) if terms else np.zeros(0, np.uint64)
        self.order = np.argsort(hashes, kind="stable")
        self.hashes, self.data, self.starts, self.sizes = hashes[self.order], data, starts[self.order], (ends - starts)[self.order]
        self.most_alike = int(np.unique(hashes, return_counts=True)[1].max()) if terms else 0

    def numbers(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The number of each span's term, -1 where it is none."""
        out = np.full(len(starts), -1, np.int64)
        if not len(starts) or not len(self.hashes):
            return out
        hashes = span_hashes(data, starts, ends)
        first = np.searchsorted(self.hashes, hashes)
        for k in range(self.most_alike):
            place = np.minimum(first + k, len(self.hashes) - 1)
            maybe = np.flatnonzero((self.hashes[place] == hashes) & (self.sizes[place] == ends - starts) & (out < 0))
            if len(maybe):
                place = place[maybe]
                sizes = self.sizes[place]
                begin = np.cumsum(sizes) - sizes
                within = np.arange(int(sizes.sum())) - np.repeat(begin, sizes)
                same = data[np.repeat(starts[maybe], sizes) + within] == self.data[np.repeat(self.starts[place], sizes) + within]
                equal = np.logical_and.reduceat(same, begin)
                out[maybe[equal]] = self.order[place[equal]]
        return out


def term_counts(docs: DataFrame, terms: list[bytes], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n, terms, counts): documents with a term at all; n counts all of them, terms are those of the list."""
    shared = docs.sparkSession.sparkContext.broadcast(terms)

    def job(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Vocabulary(shared.value)
        width = max(1, len(known.hashes))
        for batch in batches:
            data, offsets = byte_view(batch.column(1))
            n, keys, counts = np.zeros(len(batch), np.int64), [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for rows, part, bounds in pieces(data, offsets):
                part = LOWER[part]
                starts, ends, first = word_spans(BETWEEN[part], bounds)
                n[rows] += np.diff(first)
                number = known.numbers(part, starts, ends)
                row = np.repeat(rows, np.diff(first))
                hit = number >= 0
                key, count = np.unique(row[hit] * width + number[hit], return_counts=True)
                keys.append(key)
                counts.append(count)
            key, where = np.unique(np.concatenate(keys), return_inverse=True)
            total = np.bincount(where, np.concatenate(counts), len(key)).astype(np.int64)
            bounds = np.searchsorted(key, np.arange(len(batch) + 1) * width).astype(np.int32)
            lists = [pa.ListArray.from_arrays(pa.array(bounds), pa.array(v)) for v in ((key % width).astype(np.int32), total)]
            made = pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(n), *lists], names=["doc_id", "n", "terms", "counts"])
            yield made.filter(pa.array(n > 0))

    return docs.select(id_col, text_col).mapInArrow(job, "doc_id long, n long, terms array<int>, counts array<long>")


def similar_order(rows: np.ndarray, leaf: int) -> np.ndarray:
    """An order in which similar rows are neighbours: balanced halves along the line between two distant rows."""
    random = np.random.default_rng(11)
    sketch = rows @ random.normal(size=(rows.shape[1], 16)) if rows.shape[1] > 16 else rows
    out: list[np.ndarray] = []
    todo = [np.arange(len(rows))]
    while todo:
        part = todo.pop()
        if len(part) <= leaf:
            out.append(part)
            continue
        own = sketch[part]
        a = own[((own - own.mean(axis=0)) ** 2).sum(axis=1).argmax()]
        b = own[((own - a) ** 2).sum(axis=1).argmax()]
        part = part[np.argsort(own @ (a - b), kind="stable")]
        half = -(-len(part) // (2 * leaf)) * leaf
        todo += [part[half:], part[:half]]
    return np.concatenate(out) if out else np.zeros(0, np.int64)


def maxima(rows: np.ndarray) -> list[np.ndarray]:
    """The rows, and above them level by level the maxima of FAN neighbours, up to at most FAN nodes."""
    levels = [rows]
    while len(levels[-1]) > FAN:
        levels.append(np.maximum.reduceat(levels[-1], np.arange(0, len(levels[-1]), FAN), axis=0))
    return levels


def children(nodes: np.ndarray, n: int) -> np.ndarray:
    below = (nodes[:, None] * FAN + np.arange(FAN)).ravel()
    return below[below < n]


class Root(NamedTuple):
    """A hierarchy of items. items: their numbers in order; terms: its columns; levels: maxima of weight * count; used: the
    columns of each node that are above zero."""

    items: np.ndarray
    terms: np.ndarray
    levels: list[np.ndarray]
    used: list[list[np.ndarray]]


def build_roots(items: list[tuple[np.ndarray, np.ndarray]], weights: np.ndarray) -> list[Root]:
    """Hierarchies over items given as (terms, counts)."""
    groups: list[tuple[list[int], set[int]]] = []
    members: list[int] = []
    held: set[int] = set()
    for i, (terms, _) in enumerate(items):
        if not len(terms):
            continue
        own = set(terms.tolist())
        if members and (len(members) >= ROOT_ITEMS or len(held | own) > ROOT_TERMS):
            groups.append((members, held))
            members, held = [], set()
        members, held = [*members, i], held | own
    if members:
        groups.append((members, held))
    roots = []
    for members, held in groups:
        terms = np.array(sorted(held), np.int64)
        rows = np.zeros((len(members), len(terms)), np.int64)
        for r, i in enumerate(members):
            rows[r, np.searchsorted(terms, items[i][0])] = items[i][1] * weights[items[i][0]]
        order = similar_order(rows.astype(np.float64), FAN)
        exact = int(rows.sum(axis=1).max()) * 1_000_000 < 2**53
        levels = maxima(rows[order].astype(np.float64) if exact else rows[order])
        roots.append(Root(np.array(members)[order], terms, levels, [[np.flatnonzero(node) for node in level] for level in levels]))
    return roots


class Best:
    """The best k (score, id) of each item, and the scores that a document must reach to matter."""

    def __init__(self, floors: np.ndarray, k: int):
        self.k, self.floors = k, np.maximum(floors, 1)
        self.scores = [np.zeros(0, np.int64)] * len(floors)
        self.ids = [np.zeros(0, np.int64)] * len(floors)
        self.kth, self.kth_id = np.zeros(len(floors), np.int64), np.full(len(floors), NO_ID)

    def needed(self, items: np.ndarray, least_id: int) -> np.ndarray:
        """With equal scores only a smaller id gets in; no id of the documents at hand is below least_id."""
        return np.maximum(self.floors[items], self.kth[items] + (least_id > self.kth_id[items]))

    def offer(self, item: int, scores: np.ndarray, ids: np.ndarray) -> None:
        scores, ids = np.concatenate([self.scores[item], scores]), np.concatenate([self.ids[item], ids])
        top = np.lexsort((ids, -scores))[: self.k]
        self.scores[item], self.ids[item] = scores[top], ids[top]
        if len(top) == self.k:
            self.kth[item], self.kth_id[item] = self.scores[item][-1], self.ids[item][-1]


def search_batch(root: Root, rows: np.ndarray, ids: np.ndarray, best: Best) -> None:
    """All documents (rows of coordinates in the root's columns) against all items of a root."""
    order = similar_order(rows.astype(np.float64), FAN)
    ids, docs = ids[order], maxima(rows[order])
    needed = [best.needed(root.items, int(ids.min()))]
    for level in root.levels[1:]:
        needed.append(np.minimum.reduceat(needed[-1], np.arange(0, len(needed[-1]), FAN)))

    # Item nodes with the document nodes that their parents left, depth first. A function that calls itself would keep
    # the batch's maxima alive until a collection of cycles, which arrays don't set off.
    top, doc_top = len(root.levels) - 1, len(docs) - 1
    todo = [(top, node, doc_top, np.arange(len(docs[doc_top]))) for node in reversed(range(len(root.levels[top])))]
    while todo:
        level, node, doc_level, nodes = todo.pop()
        used = root.used[level][node]
        bounds = docs[doc_level][nodes[:, None], used] @ root.levels[level][node, used]
        left = bounds >= needed[level][node]
        nodes, bounds = nodes[left], bounds[left]
        if not len(nodes):
            continue
        if level == 0 and doc_level == 0:
            best.offer(int(root.items[node]), bounds.astype(np.int64), ids[nodes])
            continue
        if doc_level > 0:
            nodes, doc_level = children(nodes, len(docs[doc_level - 1])), doc_level - 1
        below = children(np.array([node]), len(root.levels[level - 1])).tolist() if level else [node]
        todo += [(max(0, level - 1), child, doc_level, nodes) for child in reversed(below)]


class Statistics(NamedTuple):
    docs: int
    terms: int

    def norms(self, n: np.ndarray) -> np.ndarray:
        if 75 * int(n.max(initial=0)) * self.docs < 2**63:
            return 25 + (75 * n * self.docs) // self.terms
        return np.array([25 + (75 * v * self.docs) // self.terms for v in n.tolist()], np.int64)


def local_best(vectors: DataFrame, roots: list[Root], n_items: int, n_terms: int, of: Statistics, k: int, floors: np.ndarray) -> DataFrame:
    """(query, doc_id, score): the best k documents of each task for each item, those at least that can rank."""
    shared = vectors.sparkSession.sparkContext.broadcast((roots, floors))

    def job(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        roots, floors = shared.value
        best = Best(floors, k)
        column_of = []
        for root in roots:
            place = np.full(n_terms, -1, np.int64)
            place[root.terms] = np.arange(len(root.terms))
            column_of.append(place)
        step = max([1, *(len(root.terms) for root in roots)])
        step = max(1, min(BATCH_DOCS, BATCH_ENTRIES // step))
        for batch in batches:
            for at in range(0, len(batch), step):
                part = batch.slice(at, step)
                ids = part.column(0).fill_null(NO_ID).to_numpy()
                sizes = np.diff(part.column(2).offsets.to_numpy())
                row = np.repeat(np.arange(len(part)), sizes)
                terms, tf = part.column(2).flatten().to_numpy(), part.column(3).flatten().to_numpy()
                norms = of.norms(part.column(1).to_numpy())[row]
                values = (1_000_000_000 * tf) // (1000 * tf + 8 * norms)
                for root, place in zip(roots, column_of):
                    column = place[terms]
                    keep = column >= 0
                    own = np.unique(row[keep])  # documents without any of its terms can't score
                    if not len(own):
                        continue
                    rows = np.zeros((len(own), len(root.terms)), root.levels[0].dtype)
                    rows[np.searchsorted(own, row[keep]), column[keep]] = values[keep]
                    search_batch(root, rows, ids[own], best)
        sizes = [len(s) for s in best.scores]
        ids = np.concatenate([np.zeros(0, np.int64), *best.ids])
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.repeat(np.arange(n_items), sizes)),
                pa.array(ids, pa.int64(), mask=ids == NO_ID),
                pa.array(np.concatenate([np.zeros(0, np.int64), *best.scores])),
            ],
            names=["query", "doc_id", "score"],
        )

    return vectors.mapInArrow(job, "query long, doc_id long, score long")


def ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def search_texts(docs: DataFrame, texts: list[str], k: int) -> DataFrame:
    """(query, rank, doc_id, score) for the texts by their position."""
    counted = [Counter(terms_of(t)) for t in texts]
    terms = sorted(set().union(*counted))
    number = {t: i for i, t in enumerate(terms)}
    items = [
        (np.array([number[t] for t in sorted(c)], np.int64), np.array([c[t] for t in sorted(c)], np.int64)) for c in counted
    ]
    vectors = cut(term_counts(docs, terms))
    n, length = vectors.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).head()
    df = np.zeros(len(terms), np.int64)
    per_term = vectors.select(F.explode("terms").alias("term")).groupBy("term").count().toArrow()
    df[per_term.column(0).to_numpy()] = per_term.column(1).to_numpy()
    weights = np.array([math.floor(1000 * math.log((2 * n + 2) / (2 * int(v) + 1))) for v in df], np.int64)
    roots = build_roots(items, weights)
    of = Statistics(int(n), int(length))
    sample = vectors.where(f"pmod(xxhash64(doc_id), {SAMPLE}) = 0")
    floors = np.zeros(len(texts), np.int64)
    known = ranked(local_best(sample, roots, len(texts), len(terms), of, k, floors), k).where(F.col("rank") == k).toArrow()
    floors[known.column("query").to_numpy()] = known.column("score").to_numpy()
    return ranked(local_best(vectors, roots, len(texts), len(terms), of, k, floors), k)


def lexical_topk(docs: DataFrame, items: DataFrame, k: int = 10, item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item_id, rank, doc_id, score): each item's k best documents with a score above 0, ties to the smaller doc_id."""
    spark = docs.sparkSession
    small_batches(spark)
    rows = items.select(F.col(item_col).alias("item_id"), F.col(text_col).alias("item_text")).where("item_text IS NOT NULL")
    texts = cut(rows.select("item_text").distinct())
    size = texts.agg(F.sum(F.octet_length("item_text") + 64)).head()[0] or 0
    blocks = max(1, -(-int(size) // ITEM_BYTES))
    out = None
    for b in range(blocks):
        block = texts if blocks == 1 else texts.where(f"pmod(xxhash64(item_text), {blocks}) = {b}")
        own = sorted(block.toArrow().column(0).to_pylist())
        found = search_texts(docs, own, k)
        named = spark.createDataFrame(list(enumerate(own)), "query long, item_text string")
        part = rows.join(named, "item_text").join(found, "query").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")
        out = part if out is None else out.unionByName(part)
    return out

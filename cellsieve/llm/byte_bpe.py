"""Byte-level BPE encoding and decoding with a given rank table.

Encoding has two steps. First the distinct pre-tokens of the corpus are counted, and Spark higher-order functions fold
ranked merges over the byte array of each of the DICTIONARY_WORDS most frequent ones: neighbours carry their rank by a
constant rank map, every step joins the leftmost pair of least rank and looks up the two ranks that this changes. The result, bounded by that number, is
broadcast as sorted hashes and id runs. Then each document's pre-tokens are looked up, a chunk of documents at a time;
the chunk's distinct words outside the dictionary are folded by the same higher-order functions and put in their
places, so every word gets its ids by one method and the dictionary's size changes only the work. Decoding concatenates
the binary pieces of the ids.

The rank map is an array of many small maps, chosen by a checksum of the key, because Spark searches one map entry by
entry. It is a one-row table, broadcast (about 2 MB, fixed by the rank file) and met by batches of words: as a literal
it was written out in every plan text, which took the driver past its memory. A byte is written as the Latin-1 character
of the same number.

Pre-tokens are the matches of PATTERN. They are found by character class on whole batches: where a run of one class
begins, a token begins, except that a single leading space joins the run after it and that the listed endings after
an apostrophe are tokens of their own. The classes are the ones that the tokenizer library's own expressions match.

A word of more than LONG bytes would make a fold over all neighbours quadratic; it is merged in its task by a heap,
with the same result.

Defined cases: a null text counts as empty; an empty text has no ids; texts of any length are encoded whole; null and
repeated ids keep their rows; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import zlib
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cellsieve.llm.common import U64, chunks, give_back, small_batches, span_hashes, sparing
from cellsieve.session import cut

DICTIONARY_WORDS = 1 << 20
TASK_WORDS = 200_000
CHUNK = 1 << 19
LONG = 400
BUCKETS = 1 << 16
OTHER, LETTER, NUMBER, SPACE = range(4)
# Endings that follow an apostrophe.
ENDINGS = ("s", "t", "re", "ve", "m", "ll", "d")
NO_RANK = 1 << 30
WORDS_AT_ONCE = 4096


def read_ranks(path: str | None = None) -> dict[bytes, int]:
    with open(path or public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as lines:
        return {base64.b64decode(word): int(rank) for word, rank in map(bytes.split, lines)}


def character_classes() -> np.ndarray:
    """The class of each code point, as the tokenizer library's regular expressions see it."""
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    out = np.zeros(0x110000, np.uint8)
    for number, pattern in ((LETTER, r"\p{L}"), (NUMBER, r"\p{N}"), (SPACE, r"\s")):
        matcher = tiktoken.Encoding(pattern, pat_str=pattern, mergeable_ranks={bytes([b]): b for b in range(256)}, special_tokens={})
        found = matcher.decode_bytes(matcher.encode_ordinary(every)).decode()
        out[np.frombuffer(found.encode("utf-32-le"), np.uint32)] = number
    return out


def pretokens(data: np.ndarray, offsets: np.ndarray, classes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each pre-token in bytes, and each row's first pre-token, plus the total."""
    lead = np.flatnonzero((data & 0xC0) != 0x80)
    points = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    if len(points) != len(lead):  # not UTF-8: Spark strings always are
        raise ValueError("text is not UTF-8")
    n = len(points)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    kind = classes[points]
    rows = np.searchsorted(lead, offsets)
    opens = np.zeros(n + 1, bool)
    opens[rows] = True
    opens = opens[:n]
    start = opens.copy()
    start[1:] |= kind[1:] != kind[:-1]
    run = start.copy()
    space = kind == SPACE
    # A space run that other characters follow gives its last character to them, or leaves it alone.
    before = np.flatnonzero(run[1:] & space[:-1] & ~space[1:] & ~opens[1:])
    start[before] = True
    start[before[points[before] == 32] + 1] = False
    # An apostrophe that begins a token, followed by letters.
    quote = np.flatnonzero((points[:-1] == 39) & start[:-1] & run[1:] & (kind[1:] == LETTER) & ~opens[1:])
    if len(quote):
        padded = np.concatenate([points, np.zeros(3, np.uint32)])
        for ending in ENDINGS:
            hit = quote
            for k, letter in enumerate(ending, 1):
                inside = hit + k < n
                hit = hit[inside]
                hit = hit[(padded[hit + k] == ord(letter)) & ((k == 1) | ~run[np.minimum(hit + k, n - 1)])]
            start[hit + 1] = False
            rest = hit + 1 + len(ending)
            start[rest[rest < n]] = True
    at = np.flatnonzero(start)
    starts = lead[at]
    ends = np.append(starts[1:], len(data))
    return starts, ends, np.searchsorted(at, rows)


class Dictionary(NamedTuple):
    """Sorted word hashes and, by word, a run of ids."""

    hashes: np.ndarray
    begins: np.ndarray
    ids: np.ndarray

    @classmethod
    def of(cls, words: pa.Array, ids: pa.Array) -> Dictionary:
        """From a binary column and a list<int> column."""
        parts = [span_hashes(data, at[:-1], at[1:]) for _, _, data, at in chunks(words, CHUNK)]
        hashes = np.concatenate(parts) if parts else np.zeros(0, U64)
        order = np.argsort(hashes)
        begins = ids.offsets.to_numpy().astype(np.int64)
        lengths = np.diff(begins)[order]
        to = np.concatenate([np.zeros(1, np.int64), np.cumsum(lengths)])
        source = np.repeat(begins[:-1][order] - begins[0] - to[:-1], lengths) + np.arange(to[-1])
        flat = ids.flatten().to_numpy(zero_copy_only=False).astype(np.int32)
        return cls(hashes[order], to, flat[source])

    @classmethod
    def of_tokens(cls, ranks: dict[bytes, int]) -> Dictionary:
        ids = pa.ListArray.from_arrays(pa.array(np.arange(len(ranks) + 1, dtype=np.int32)), pa.array(list(ranks.values()), pa.int32()))
        return cls.of(pa.array(list(ranks), pa.binary()), ids)

    def joined(self, other: Dictionary) -> Dictionary:
        """Both together; no word is in both."""
        hashes = np.concatenate([self.hashes, other.hashes])
        order = np.argsort(hashes)
        starts = np.concatenate([self.begins[:-1], other.begins[:-1] + len(self.ids)])[order]
        lengths = np.concatenate([np.diff(self.begins), np.diff(other.begins)])[order]
        to = np.concatenate([np.zeros(1, np.int64), np.cumsum(lengths)])
        source = np.repeat(starts - to[:-1], lengths) + np.arange(to[-1])
        return Dictionary(hashes[order], to, np.concatenate([self.ids, other.ids])[source])

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """The place of each hash, or -1."""
        if not len(self.hashes):
            return np.full(len(hashes), -1)
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return np.where(self.hashes[at] == hashes, at, -1)


def heap_merge(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ranked merges of a long word: pairs wait in a heap by rank and place."""
    n = len(word)
    size, after, behind = [1] * n, list(range(1, n + 1)), list(range(-1, n - 1))
    waiting: list[tuple[int, int, int]] = []

    def offer(i: int) -> None:
        j = after[i]
        if j < n and (rank := ranks.get(word[i : j + size[j]])) is not None:
            heapq.heappush(waiting, (rank, i, size[i] + size[j]))

    for i in range(n - 1):
        offer(i)
    while waiting:
        _, i, length = heapq.heappop(waiting)
        j = after[i]
        if size[i] == 0 or j >= n or size[i] + size[j] != length:
            continue  # one of the two has changed since
        size[i], size[j] = length, 0
        after[i] = after[j]
        if after[j] < n:
            behind[after[j]] = i
        offer(i)
        if behind[i] >= 0:
            offer(behind[i])
    out, i = [], 0
    while i < n:
        out.append(ranks[word[i : i + size[i]]])
        i = after[i]
    return out


def rank_table(spark: SparkSession, ranks: dict[bytes, int]) -> DataFrame:
    """One row (one, ranks): array<map<string,int>> by checksum of the Latin-1 word."""
    buckets: list[dict[str, int]] = [{} for _ in range(BUCKETS)]
    for word, rank in ranks.items():
        key = word.decode("latin-1")
        buckets[zlib.crc32(key.encode()) % BUCKETS][key] = rank
    kind = pa.list_(pa.map_(pa.string(), pa.int32()))
    table = pa.table({"one": pa.array([1], pa.int32()), "ranks": pa.array([[list(b.items()) for b in buckets]], kind)})
    return spark.createDataFrame(table)


def rank_of(ranks: Column, piece: Column) -> Column:
    bucket = F.get(ranks, (F.crc32(piece.cast("binary")) % BUCKETS).cast("int"))
    return F.try_element_at(bucket, piece)


def fold(word: Column, ranks: Column) -> Column:
    """array<int> of a word given as Latin-1 characters, by ranked merges over its bytes. The dictionary has the words
    that are tokens themselves, so they are not looked up again here."""
    state = "struct<pieces:array<string>,pairs:array<int>>"

    def rank(text: Column) -> Column:
        return F.coalesce(rank_of(ranks, text), F.lit(NO_RANK))

    # pairs: the rank that each piece has together with the next one. A merge changes two of them.
    def merge(acc: Column, _: Column) -> Column:
        pieces, pairs = acc["pieces"], acc["pairs"]
        best = F.array_min(pairs)

        def joined(m: Column) -> Column:
            at, both = m["at"], m["both"]
            rest = F.greatest(F.size(pieces) - at - 1, F.lit(0))
            before = F.concat(F.slice(pairs, F.lit(1), F.greatest(at - 2, F.lit(0))), F.array(rank(F.concat(F.get(pieces, at - 2), both))))
            after = F.concat(F.array(rank(F.concat(both, F.get(pieces, at + 1)))), F.slice(pairs, at + 2, rest))
            return F.struct(
                F.concat(F.slice(pieces, F.lit(1), at - 1), F.array(both), F.slice(pieces, at + 2, rest)).alias("pieces"),
                F.when(at == 1, after).otherwise(F.concat(before, after)).alias("pairs"),
            ).cast(state)

        # Place and text of the best pair are bound once, each as the only element of an array.
        place = F.array(F.array_position(pairs, best).cast("int"))
        both = F.transform(place, lambda at: F.struct(at.alias("at"), F.concat(F.get(pieces, at - 1), F.get(pieces, at)).alias("both")))
        return F.when(best == NO_RANK, acc).otherwise(F.get(F.transform(both, joined), F.lit(0)))

    every = F.sequence(F.lit(1), F.length(word))
    letters = F.transform(every, lambda i: F.substring(word, i, F.lit(1)))
    two = F.transform(every, lambda i: F.when(i < F.length(word), rank(F.substring(word, i, F.lit(2)))).otherwise(F.lit(NO_RANK)))
    steps = F.sequence(F.lit(1), F.greatest(F.length(word) - 1, F.lit(1)))
    start = F.struct(letters.alias("pieces"), two.alias("pairs")).cast(state)
    merged = F.aggregate(steps, start, merge, lambda acc: F.transform(acc["pieces"], lambda p: rank_of(ranks, p)))
    return F.when(F.length(word) == 0, F.array().cast("array<int>")).otherwise(merged)


def folded(batches: DataFrame, ranks: dict[bytes, int]) -> DataFrame:
    """Batches (one, words: array<string>, ...) with ids: array<array<int>> instead of one, which is always 1."""
    table = F.broadcast(rank_table(batches.sparkSession, ranks))
    ids = F.transform("words", lambda w: fold(w, F.col("ranks")))
    return batches.join(table, "one").select(*batches.columns, ids.alias("ids")).drop("one")


class Pieces:
    """The binary piece of each id, concatenated."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        by_id = {rank: word for word, rank in ranks.items()}
        words = [by_id.get(i, b"") for i in range(max(by_id, default=-1) + 1)]
        self.data = np.frombuffer(b"".join(words), np.uint8)
        self.begins = np.cumsum([0, *map(len, words)])

    def decode(self, ids: np.ndarray) -> bytes:
        lengths = self.begins[ids + 1] - self.begins[ids]
        to = np.cumsum(lengths) - lengths
        return self.data[np.repeat(self.begins[ids] - to, lengths) + np.arange(lengths.sum())].tobytes()


def count_words(texts: DataFrame, classes: np.ndarray, known: np.ndarray) -> DataFrame:
    """(word, n): pre-tokens of the corpus that are not tokens themselves, as Latin-1 strings."""
    shared = texts.sparkSession.sparkContext.broadcast((classes, known))

    def job(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds, tokens = shared.value
        found: dict[int, list] = {}

        def flush() -> pa.RecordBatch:
            rows = list(found.values())
            found.clear()
            words = [w.decode("latin-1") for w, _ in rows]
            return pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array([c for _, c in rows], pa.int64())], names=["word", "n"])

        for batch in batches:
            for _, _, data, offsets in chunks(batch.column(0), CHUNK):
                starts, ends, _ = pretokens(data, offsets, kinds)
                hashes, first, counts = np.unique(span_hashes(data, starts, ends), return_index=True, return_counts=True)
                at = np.minimum(np.searchsorted(tokens, hashes), len(tokens) - 1)
                new = (tokens[at] != hashes) & (ends[first] - starts[first] <= LONG)
                raw = data.tobytes()
                spans = zip(hashes[new].tolist(), starts[first[new]].tolist(), ends[first[new]].tolist(), counts[new].tolist())
                for h, a, b, c in spans:
                    if h in found:
                        found[h][1] += c
                    else:
                        found[h] = [raw[a:b], c]
                if len(found) > TASK_WORDS:
                    yield flush()
        yield flush()

    return texts.mapInArrow(sparing(job), "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _packed(words: DataFrame) -> DataFrame:
    """Rows (word) as batches (one, words: array<string>)."""

    def job(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, WORDS_AT_ONCE):
                part = batch.column(0).slice(at, WORDS_AT_ONCE).cast(pa.string())
                part = pa.array(part.to_pylist(), pa.string())
                lists = pa.ListArray.from_arrays(pa.array([0, len(part)], pa.int32()), part)
                yield pa.RecordBatch.from_arrays([pa.array([1], pa.int32()), lists], names=["one", "words"])

    return words.mapInArrow(sparing(job), "one int, words array<string>")


def build_dictionary(texts: DataFrame, ranks: dict[bytes, int], classes: np.ndarray, most: int = DICTIONARY_WORDS) -> Dictionary:
    """The tokens themselves and the most frequent other words, at most `most` of these, with their ids."""
    tokens = Dictionary.of_tokens(ranks)
    words = cut(count_words(texts, classes, tokens.hashes))
    # The least count that at most that many words reach. A word seen once gains nothing from a dictionary.
    by_count = words.groupBy(F.least("n", F.lit(10_000)).alias("n")).count().collect()
    least, total = 2, 0
    for n, count in sorted(((r["n"], r["count"]) for r in by_count), reverse=True):
        total += count
        if total > most:
            least = max(least, n + 1)
            break
    frequent = words.where(F.col("n") >= least).where(F.lit(least <= 10_000)).select("word")
    done = folded(_packed(frequent), ranks).select(F.explode(F.arrays_zip("words", "ids")).alias("w"))
    found = done.select(F.encode("w.words", "ISO-8859-1").alias("word"), F.col("w.ids").alias("ids")).toArrow()
    return tokens.joined(Dictionary.of(found.column("word").combine_chunks(), found.column("ids").combine_chunks()))


def _ipc(batch: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as writer:
        writer.write_batch(batch)
    return sink.getvalue().to_pybytes()


def _lookups(docs: DataFrame, ranks: dict[bytes, int], dictionary: Dictionary, classes: np.ndarray) -> DataFrame:
    """One row (one, held, words) for each chunk of documents: held is an Arrow stream of the columns but the last, the
    text, with marks: list<int32> of ids, where -n stands for the n-th of `words`, which are distinct."""
    shared = docs.sparkSession.sparkContext.broadcast((dictionary, classes, ranks))
    kept = docs.columns[:-1]

    def job(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, kinds, known = shared.value
        for batch in batches:
            for row, end, data, offsets in chunks(batch.column(len(kept)), CHUNK):
                starts, ends, first = pretokens(data, offsets, kinds)
                hashes = span_hashes(data, starts, ends)
                place = table.find(hashes)
                hole = place < 0
                long = np.flatnonzero(hole & (ends - starts > LONG))
                heaped = {k: np.asarray(heap_merge(bytes(data[starts[k] : ends[k]]), known), np.int32) for k in long.tolist()}
                length = np.where(hole, 1, table.begins[place + 1] - table.begins[place])
                for k, ids in heaped.items():
                    length[k] = len(ids)
                    hole[k] = False
                to = np.concatenate([np.zeros(1, np.int64), np.cumsum(length)])
                source = np.repeat(np.where(hole, 0, table.begins[place]) - to[:-1], length) + np.arange(to[-1])
                for k in heaped:
                    source[to[k] : to[k + 1]] = 0
                flat = table.ids[source] if len(source) else np.zeros(0, np.int32)
                for k, ids in heaped.items():
                    flat[to[k] : to[k + 1]] = ids
                holes = np.flatnonzero(hole)
                _, sample, number = np.unique(hashes[holes], return_index=True, return_inverse=True)
                flat[to[holes]] = -1 - number
                raw = data.tobytes()
                words = [raw[a:b].decode("latin-1") for a, b in zip(starts[holes[sample]].tolist(), ends[holes[sample]].tolist())]
                marks = pa.LargeListArray.from_arrays(pa.array(to[first]), pa.array(flat, pa.int32()))
                columns = [batch.column(k).slice(row, end - row) for k in range(len(kept))]
                held = _ipc(pa.RecordBatch.from_arrays([*columns, marks], names=[*kept, "marks"]))
                lists = pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), pa.array(words, pa.string()))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([1], pa.int32()), pa.array([held], pa.binary()), lists], names=["one", "held", "words"]
                )

    return docs.mapInArrow(sparing(job), "one int, held binary, words array<string>")


def _filled(marks: pa.LargeListArray, ids: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all rows and each row's first, from marks and the ids of the words that they stand for."""
    flat, at = marks.flatten().to_numpy(), marks.offsets.to_numpy()
    flat, at = flat, at - at[0]
    begins, values = ids.offsets.to_numpy().astype(np.int64), ids.values.to_numpy(zero_copy_only=False)
    hole = flat < 0
    word = np.where(hole, -1 - flat, 0)
    length = np.ones(len(flat), np.int64)
    length[hole] = (begins[1:] - begins[:-1])[word[hole]]
    to = np.concatenate([np.zeros(1, np.int64), np.cumsum(length)])
    out = np.repeat(flat, length)
    inside = np.repeat(hole, length)
    place = np.arange(to[-1]) - np.repeat(to[:-1], length)
    out[inside] = values[(np.repeat(np.where(hole, begins[word] if len(begins) > 1 else 0, 0), length) + place)[inside]]
    return out, to[at]


def _encoded(docs: DataFrame, ranks: dict[bytes, int], most: int, finish: Callable, fields: str) -> DataFrame:
    """Documents, the text as last column, through both steps; finish(columns, ids, first) makes the rows."""
    small_batches(docs.sparkSession)
    classes = character_classes()
    dictionary = build_dictionary(docs.select(F.col(docs.columns[-1]).alias("text")), ranks, classes, most)

    def job(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for n in range(batch.num_rows):
                held = pa.ipc.open_stream(batch.column(0)[n].as_py()).read_next_batch()
                ids, first = _filled(held.column(held.num_columns - 1), batch.column(1)[n].values)
                yield finish(held.columns[:-1], ids, first)

    chunked = folded(_lookups(docs, ranks, dictionary, classes), ranks)
    give_back()  # what the driver took for the dictionary and for the tables sent to the tasks
    return chunked.select("held", "ids").mapInArrow(sparing(job), fields)


def encode(docs: DataFrame, carry: tuple[str, ...] = (), path: str | None = None, most: int = DICTIONARY_WORDS) -> DataFrame:
    """(doc_id, carried columns, ids array<int>) of every document."""
    own = docs.select("doc_id", *carry, F.col("text").alias("to_encode"))
    kept = own.columns[:-1]

    def finish(columns: list[pa.Array], ids: np.ndarray, first: np.ndarray) -> pa.RecordBatch:
        lists = pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(ids, pa.int32()))
        return pa.RecordBatch.from_arrays([*columns, lists], names=[*kept, "ids"])

    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in own.schema.fields[:-1])
    return _encoded(own, read_ranks(path), most, finish, f"{fields}ids array<int>")


def decode(coded: DataFrame, path: str | None = None) -> DataFrame:
    """The rows of `coded` with decoded: the binary that their ids stand for."""
    shared = coded.sparkSession.sparkContext.broadcast(Pieces(read_ranks(path)))
    names = coded.columns

    def job(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(names.index("ids"))
            done = [shared.value.decode(ids[n].values.to_numpy(zero_copy_only=False)) for n in range(len(ids))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(done, pa.binary())], names=[*names, "decoded"])

    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in coded.schema)
    return coded.mapInArrow(sparing(job), f"{fields}decoded binary")


def encode_checked(docs: DataFrame, carry: tuple[str, ...] = (), path: str | None = None, most: int = DICTIONARY_WORDS) -> DataFrame:
    """(doc_id, carried columns, n_tokens, ids, decoded): encode, decode in the same task, and say whether that gives
    back the text. The text goes along once; what is decoded is compared with its SHA-256."""
    ranks = read_ranks(path)
    shared = docs.sparkSession.sparkContext.broadcast(Pieces(ranks))
    whole = F.sha2(F.coalesce("text", F.lit("")), 256).alias("to_compare")
    own = docs.select("doc_id", *carry, whole, F.col("text").alias("to_encode"))
    kept = own.columns[:-2]

    def finish(columns: list[pa.Array], ids: np.ndarray, first: np.ndarray) -> pa.RecordBatch:
        spans = zip(first[:-1].tolist(), first[1:].tolist(), columns[-1])
        same = [hashlib.sha256(shared.value.decode(ids[a:b])).hexdigest() == t.as_py() for a, b, t in spans]
        lists = pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(ids, pa.int32()))
        return pa.RecordBatch.from_arrays(
            [*columns[:-1], pa.array(np.diff(first)), lists, pa.array(same, pa.bool_())], names=[*kept, "n_tokens", "ids", "decoded"]
        )

    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in own.schema.fields[:-2])
    return _encoded(own, ranks, most, finish, f"{fields}n_tokens long, ids array<int>, decoded boolean")


def digest(docs: DataFrame, path: str | None = None, most: int = DICTIONARY_WORDS) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every document."""
    ranks = read_ranks(path)
    shared = docs.sparkSession.sparkContext.broadcast(Pieces(ranks))
    own = docs.select("doc_id", "text")

    def finish(columns: list[pa.Array], ids: np.ndarray, first: np.ndarray) -> pa.RecordBatch:
        hexes = [], []
        for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
            hexes[0].append(hashlib.sha256(ids[a:b].astype("<u4").tobytes()).hexdigest())
            hexes[1].append(hashlib.sha256(shared.value.decode(ids[a:b])).hexdigest())
        columns = [*columns, pa.array(np.diff(first)), pa.array(hexes[0], pa.string()), pa.array(hexes[1], pa.string())]
        return pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = own.schema["doc_id"].dataType.simpleString()
    return _encoded(own, ranks, most, finish, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")

"""Benchmark decontamination by templates and verbatim windows.

Texts become tokens: lower-cased words, with numbers, names and units replaced by typed placeholders. A name is a
capitalised word inside a sentence, a unit a listed word after a number. Windows of WINDOW tokens are hashed; documents
and benchmark items meet in a hash join on window hashes. Beside these template windows there are literal ones over the
lower-cased tokens as they are, so that a verbatim copy is found however many slots it has and however its
letters and stops are written. A bitmap of fixed size with the benchmark's hashes, sent to
all tasks, keeps most other windows out of that join; what it lets through by chance the join removes.

Matches of one document and one item on one diagonal (document position minus item position) form runs of windows that
overlap or touch. A run counts when it covers LEAST_TOKENS tokens, or the whole of a shorter item, and when its slots
agree: the same value of the item always stands for the same value of the document, while two values of the item may
become one. So re-parameterised questions are caught, and texts that merely share a shape are not. Runs too short by
themselves count together when their windows would cover as much in one run and all their slots agree. Within one run
a value that stands for two values rejects the whole run; with `verbatim`, as much verbatim text in a row counts
whatever the slots around it say.

Items with equal texts are one item, named by the smallest id. A template window needs LEAST_LITERAL tokens that are no
placeholders, a literal one needs none; an item shorter than a window is one window of its own length. An item of fewer
than LEAST_LITERAL tokens, a "yes", is found only in a document of no more tokens than its own.

Defined cases: null and empty texts have no windows and are never reported; an item without LEAST_LITERAL plain tokens
is found verbatim only; a null item or document id keeps its place as a value; repeated document ids are reported once per
item; an empty table on either side reports nothing; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cellsieve.llm.common import LOWER, U64, chunks, mix, powers, span_hashes, sparing, word_spans
from cellsieve.session import cut

WINDOW = 8
LEAST_LITERAL = 4
LEAST_TOKENS = 13
BITMAP_BITS = 24
LITERAL = 1 << 32
# Bytes of text whose windows are made at once; what that takes may stay with a Python worker while later tasks run.
CHUNK = 1 << 19

UNITS = (
    "mm cm m km inch inches foot feet yard yards mile miles mg g kg gram grams kilogram kilograms ton tons tonnes lb lbs "
    "pound pounds ounce ounces ml l litre litres liter liters gallon gallons s sec second seconds min minute minutes h hr "
    "hour hours day days week weeks month months year years c f k degree degrees celsius fahrenheit hz khz mhz ghz w kw mw "
    "watt watts v volt volts a amp amps j joule joules n newton newtons pa bar mph kmh percent dollar dollars euro euros "
    "cent cents usd eur"
).split()
NUMBER_WORDS = (
    "zero two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen "
    "nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion"
).split()

WORD_BYTES = np.zeros(256, bool)
WORD_BYTES[48:58] = WORD_BYTES[65:91] = WORD_BYTES[97:123] = WORD_BYTES[128:] = True
DIGITS = np.zeros(256, bool)
DIGITS[48:58] = True
POINTS = np.zeros(256, bool)
POINTS[[44, 46]] = True
STOPS = np.zeros(256, bool)
STOPS[[10, 33, 46, 58, 59, 63]] = True
NUMBER, NAME, UNIT = (mix(np.array([n], U64))[0] for n in (101, 102, 103))


def _hashes(words: list[str]) -> np.ndarray:
    data = np.frombuffer("".join(words).encode(), np.uint8)
    ends = np.cumsum([len(w) for w in words])
    return np.sort(span_hashes(data, ends - [len(w) for w in words], ends))


UNIT_HASHES, NUMBER_HASHES = _hashes(UNITS), _hashes(NUMBER_WORDS)


class Tokens:
    """The tokens of a run of rows: hashes with placeholders put in, spans, and each row's first token."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray) -> None:
        word, digit = WORD_BYTES[data], DIGITS[data]
        if len(data) > 2:  # points and commas inside numbers
            word[1:-1] |= POINTS[data[1:-1]] & digit[:-2] & digit[2:]
        self.starts, self.ends, self.first = word_spans(~word, offsets)
        self.lower = LOWER[data]
        self.hash = span_hashes(self.lower, self.starts, self.ends)
        self.literal = self.hash.copy()
        n = len(self.starts)
        self.slot = np.zeros(n, bool)
        if not n:
            return
        opens = np.zeros(n, bool)
        opens[self.first[self.first < n]] = True
        stops = np.zeros(len(data) + 1, np.int64)
        np.cumsum(STOPS[data], out=stops[1:])
        opens[1:] |= stops[self.starts[1:]] > stops[self.ends[:-1]]
        head = data[self.starts]
        second = data[np.minimum(self.starts + 1, len(data) - 1)]
        long = self.ends - self.starts > 1
        name = (head >= 65) & (head <= 90) & long & ((second >= 97) & (second <= 122) | (second >= 128)) & ~opens
        number = digit[self.starts] | _among(self.hash, NUMBER_HASHES)
        after = np.zeros(n, bool)
        after[1:] = number[:-1]
        after[self.first[self.first < n]] = False
        unit = after & _among(self.hash, UNIT_HASHES)
        self.hash[name] = NAME
        self.hash[number] = NUMBER
        self.hash[unit] = UNIT
        self.slot = name | number | unit

    def windows(self, size: int, literal: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """First token and hash of each window of `size` tokens within a row: of the template windows those that have
        enough plain tokens, of the literal ones all."""
        tokens = self.literal if literal else self.hash
        n = len(self.hash) - size + 1
        if n <= 0:
            return np.zeros(0, np.int64), np.zeros(0, U64)
        forward, back = powers(len(self.hash) + 1)
        sums = np.zeros(len(self.hash) + 1, U64)
        np.cumsum(tokens * forward[: len(tokens)], out=sums[1:])
        plain = np.zeros(len(self.hash) + 1, np.int64)
        np.cumsum(~self.slot, out=plain[1:])
        row = np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))
        ok = row[:n] == row[size - 1 :]
        if not literal:
            ok &= plain[size:] - plain[:n] >= min(LEAST_LITERAL, size)
        at = np.flatnonzero(ok)
        return at, mix((sums[at + size] - sums[at]) * back[at] + U64(size + LITERAL * literal))

    def slots(self, at: int, size: int) -> list[str]:
        return [
            bytes(self.lower[self.starts[k] : self.ends[k]]).decode("utf-8", "replace") for k in range(at, at + size) if self.slot[k]
        ]


def _among(hashes: np.ndarray, known: np.ndarray) -> np.ndarray:
    at = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
    return known[at] == hashes


WINDOW_FIELDS = "pos int, size int, n_tokens int, hash long, literal boolean, slots array<string>"


def template_windows(texts: DataFrame, id_col: str, sizes: list[int], bitmap=None, whole: bool = False) -> DataFrame:
    """(id, pos, size, n_tokens, hash, literal, slots) of template and literal windows; with a bitmap, of those whose
    bit is set. With `whole`, a text shorter than a window is one window of its own length."""
    spark = texts.sparkSession
    shared = spark.sparkContext.broadcast(bitmap)
    kind = texts.schema[id_col].dataType.simpleString()

    def job(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = shared.value
        for batch in batches:
            for row, end, data, offsets in chunks(batch.column(1), CHUNK):
                tokens = Tokens(data, offsets)
                count = np.diff(tokens.first)
                for size, literal in product(sizes, (False, True)):
                    at, hashes = tokens.windows(size, literal)
                    if bits is not None:
                        place = hashes >> U64(64 - BITMAP_BITS)
                        hit = (bits[(place >> U64(3)).astype(np.int64)] >> (place & U64(7)).astype(np.uint8)) & 1
                        at, hashes = at[hit == 1], hashes[hit == 1]
                    own = np.searchsorted(tokens.first, at, "right") - 1
                    if whole:
                        keep = (size == WINDOW) | (count[own] == size)
                        at, hashes, own = at[keep], hashes[keep], own[keep]
                    if not len(at):
                        continue
                    ids = batch.column(0).slice(row, end - row).take(pa.array(own))
                    yield pa.RecordBatch.from_arrays(
                        [
                            ids,
                            pa.array((at - tokens.first[own]).astype(np.int32)),
                            pa.array(np.full(len(at), size, np.int32)),
                            pa.array(count[own].astype(np.int32)),
                            pa.array(hashes.view(np.int64)),
                            pa.array(np.full(len(at), literal)),
                            pa.array([tokens.slots(k, size) for k in at.tolist()], pa.list_(pa.string())),
                        ],
                        names=[id_col, "pos", "size", "n_tokens", "hash", "literal", "slots"],
                    )

    return texts.mapInArrow(sparing(job), f"`{id_col}` {kind}, {WINDOW_FIELDS}")


def bitmap_of(windows: DataFrame) -> np.ndarray:
    """2**BITMAP_BITS bits; the driver gets at most one 64-bit word for each 64 of them."""
    place = F.shiftrightunsigned("hash", 64 - BITMAP_BITS)
    words = windows.select(F.shiftright(place, 6).alias("word"), F.call_function("shiftleft", F.lit(1).cast("long"), (place % 64).cast("int")).alias("bit"))
    bits = np.zeros(1 << (BITMAP_BITS - 6), np.int64)
    for word, value in words.groupBy("word").agg(F.bit_or("bit").alias("bits")).collect():
        bits[word] = value
    return bits.view(np.uint8)


def _agree(pairs: Column) -> Column:
    """Whether distinct (item value, document value) pairs give each item value one document value."""
    return F.size(F.array_distinct(F.transform(pairs, lambda p: p["of_item"]))) == F.size(pairs)


def _union(pairs: Column) -> Column:
    return F.array_distinct(F.flatten(F.collect_set(pairs)))


def _longest(positions: Column, size: Column) -> Column:
    """How many tokens the longest chain of overlapping or touching windows covers; at most an item's length of them."""
    start = F.struct(F.lit(0).alias("most"), F.lit(None).cast("int").alias("first"), F.lit(None).cast("int").alias("last"))

    def step(state: Column, pos: Column) -> Column:
        first = F.when(pos - state["last"] <= size, state["first"]).otherwise(pos)
        return F.struct(F.greatest(state["most"], pos - first + size).alias("most"), first.alias("first"), pos.alias("last"))

    return F.aggregate(F.array_sort(positions), start, step, lambda state: state["most"])


def find_leaks(docs: DataFrame, benchmark: DataFrame, verbatim: bool = False) -> DataFrame:
    """(doc_id, item_id, doc_start, item_start, n_windows, n_covered, n_item_tokens, same_values) of each document and
    benchmark item that it holds; of several places the one with the most windows. With `verbatim`, runs of literal
    windows that cover enough by themselves count whatever the run's slots say."""
    items = benchmark.where("text IS NOT NULL").groupBy("text").agg(F.min("item_id").alias("item_id")).select("item_id", "text")
    of_items = cut(template_windows(items, "item_id", list(range(1, WINDOW + 1)), whole=True))
    sizes = sorted(r["size"] for r in of_items.select("size").distinct().collect())
    of_docs = template_windows(docs.select("doc_id", "text"), "doc_id", sizes, bitmap_of(of_items))
    of_items = of_items.select(
        "item_id", "hash", "size", "literal",
        F.col("pos").alias("item_pos"), F.col("slots").alias("item_slots"), F.col("n_tokens").alias("n_item_tokens"),
    )
    of_docs = of_docs.select("doc_id", "hash", "size", "literal", "pos", "slots", "n_tokens")
    met = of_docs.join(of_items, ["hash", "size", "literal"])
    met = met.where((F.col("n_item_tokens") >= LEAST_LITERAL) | (F.col("n_tokens") == F.col("n_item_tokens")))
    # A literal window has the item's own values, also where the document's way of writing hides that they are slots.
    slots = F.when(F.col("literal"), F.col("item_slots")).otherwise(F.col("slots"))
    pairs = F.zip_with("item_slots", slots, lambda a, b: F.struct(a.alias("of_item"), b.alias("of_doc")))
    met = met.withColumn("pairs", pairs).withColumn("diagonal", F.col("pos") - F.col("item_pos"))
    met = met.withColumn("of_template", F.when(~F.col("literal"), F.col("pairs")))
    keys = ["doc_id", "item_id", "diagonal", "n_item_tokens", "size"]
    both = [_union(F.col(c)).alias(c) for c in ("pairs", "of_template")]
    met = met.groupBy(*keys, "pos").agg(
        F.max((~F.col("literal")).cast("int")).alias("template"), F.bool_or("literal").alias("literal"), *both
    )
    along = Window.partitionBy(*keys).orderBy("pos")
    apart = F.coalesce(F.col("pos") - F.lag("pos").over(along) > F.col("size"), F.lit(False))
    runs = met.withColumn("apart", apart.cast("int")).withColumn("run", F.sum("apart").over(along)).groupBy(*keys, "run").agg(
        F.count("*").alias("n_windows"),
        F.sum("template").alias("n_template"),
        F.min("pos").alias("doc_start"),
        (F.max("pos") - F.min("pos") + F.first("size")).alias("n_covered"),
        _longest(F.collect_set(F.when(F.col("literal"), F.col("pos"))), F.col("size")).alias("n_verbatim"),
        *both,
    )
    evidence = F.col("n_covered").cast("long").alias("evidence")
    run = F.struct("n_windows", "n_template", "n_covered", "n_verbatim", evidence, "doc_start", "pairs", "of_template")
    pooled = F.struct(
        F.sum("n_windows").alias("n_windows"),
        F.sum("n_template").alias("n_template"),
        F.sum("n_covered").cast("int").alias("n_covered"),
        F.lit(0).alias("n_verbatim"),
        (F.sum("n_windows") - 1 + F.first("size")).alias("evidence"),
        F.min("doc_start").alias("doc_start"),
        *both,
    )
    parts = runs.groupBy(*keys).agg(F.collect_list(run).alias("runs"), pooled.alias("pooled"))
    parts = parts.select(*keys, F.explode(F.concat("runs", F.array("pooled"))).alias("part")).select(*keys, "part.*")
    parts = parts.withColumn("item_start", F.col("doc_start") - F.col("diagonal"))
    least = F.least(F.col("n_item_tokens"), F.lit(LEAST_TOKENS))
    by_all = (F.col("evidence") >= least) & _agree(F.col("pairs"))
    by_template = (F.col("n_template") - 1 + F.col("size") >= least) & _agree(F.col("of_template"))
    enough = by_all | by_template
    parts = parts.where(enough | (F.col("n_verbatim") >= least) if verbatim else enough)
    parts = parts.withColumn("same_values", ~F.exists("pairs", lambda p: p["of_item"] != p["of_doc"]))
    shown = ("n_windows", "n_covered", "doc_start", "item_start", "n_item_tokens", "same_values")
    order = F.struct("n_windows", F.negative("doc_start"), F.negative("item_start"), "same_values")
    best = parts.groupBy("doc_id", "item_id").agg(*(F.max_by(c, order).alias(c) for c in shown))
    return best.select("doc_id", "item_id", "doc_start", "item_start", "n_windows", "n_covered", "n_item_tokens", "same_values")


def without_leaks(docs: DataFrame, benchmark: DataFrame, verbatim: bool = False) -> DataFrame:
    """The documents that hold no benchmark item, all columns as they are."""
    leaked = find_leaks(docs, benchmark, verbatim).select(F.col("doc_id").alias("leaked_id")).distinct()
    own = docs.select("doc_id", "text", "lang", "source", "n_chars")
    return own.join(leaked, F.col("doc_id").eqNullSafe(F.col("leaked_id")), "left_anti")

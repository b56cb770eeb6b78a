"""Text to unit vectors: one Arrow-batched slot for any embedding model, with feature hashing as default."""

from __future__ import annotations

import hashlib
import math
import uuid
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cellsieve.functions.vectors import NORM_EPSILON

DEFAULT_DIM = 64
SPACES = "[ \\t\\n\\r\\f]+"
_SEPARATES = np.isin(np.arange(256), list(b" \t\n\r\f"))
# Bytes of text whose distinct tokens are gathered at once; the longest string that is one block of MD5, and strings hashed
# at once.
TEXT_BYTES = 4 * 1024 * 1024
MD5_BLOCK = 55
MD5_AT_ONCE = 1 << 14


class HashingEmbedder:
    """Token counts hashed into `dim` buckets: bucket = first 7 hex digits of md5(token) modulo dim."""

    def __init__(self, dim: int = DEFAULT_DIM):
        self.dim = dim

    def _bucket(self, token: str) -> int:
        digest = hashlib.md5(token.encode("utf-8"), usedforsecurity=False).digest()
        return (int.from_bytes(digest[:4], "big") >> 4) % self.dim

    def _buckets(self, tokens: pa.Array) -> np.ndarray:
        """The bucket of each token, -1 for the empty one."""
        heads, long = md5_heads(tokens)
        buckets = (heads >> 4).astype("int64") % self.dim
        buckets[long] = [self._bucket(t) for t in tokens.take(pa.array(long)).to_pylist()]
        empty = np.asarray(pc.equal(pc.binary_length(tokens), 0))
        return np.where(empty, -1, buckets)

    def __call__(self, texts: pa.Array | Sequence[str]) -> np.ndarray:
        texts = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())
        # So many texts at once that the table of their distinct tokens stays in the processor's caches.
        step = max(1, int(len(texts) * TEXT_BYTES // max(1, texts.nbytes)))
        parts = [self._counts(texts.slice(at, step)) for at in range(0, len(texts), step)]
        return np.concatenate(parts) if parts else np.zeros((0, self.dim))

    def _counts(self, texts: pa.Array) -> np.ndarray:
        lists = pc.ascii_split_whitespace(texts)
        owner = np.repeat(np.arange(len(texts)), np.asarray(pc.list_value_length(lists)))
        tokens = lists.flatten().dictionary_encode()
        # Each distinct token is lower-cased and hashed once; the empty one counts for nothing.
        buckets = self._buckets(pc.utf8_lower(tokens.dictionary))
        bucket = buckets[np.asarray(tokens.indices)] if len(tokens) else np.zeros(0, dtype="int64")
        cell = (owner * self.dim + bucket)[bucket >= 0]
        counts = np.bincount(cell, minlength=len(texts) * self.dim)
        return counts.reshape(len(texts), self.dim).astype("float64")


# Shifts of MD5's rounds, the words they take and their constants.
_SHIFTS = (7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21)
_STEPS = (1, 0), (5, 1), (3, 5), (7, 0)
_SINES = [int(abs(math.sin(i + 1)) * 2**32) for i in range(64)]
_START = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)


def md5_heads(tokens: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The first four bytes, as a number, of the MD5 digest of each string of at most 55 bytes, which is one block; and
    the places of longer ones, whose numbers are 0."""
    offsets, data = _bytes_of(tokens)
    sizes = np.diff(offsets)
    heads = np.zeros(len(tokens), np.uint32)
    short = np.flatnonzero(sizes <= MD5_BLOCK)
    for at in range(0, len(short), MD5_AT_ONCE):
        some = short[at : at + MD5_AT_ONCE]
        heads[some] = _md5_block(data, offsets[some], sizes[some])
    return heads, np.flatnonzero(sizes > MD5_BLOCK)


def _md5_block(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    n = len(starts)
    block = np.zeros((n, 64), np.uint8)
    ends = np.cumsum(sizes)
    place = np.arange(ends[-1]) - np.repeat(ends - sizes, sizes)
    block.reshape(-1)[np.repeat(np.arange(n) * 64, sizes) + place] = data[np.repeat(starts, sizes) + place]
    block[np.arange(n), sizes] = 0x80
    words = np.ascontiguousarray(block.view("<u4").T).astype(np.uint32)
    words[14] = sizes * 8
    used = int(sizes.max()) // 4
    a, b, c, d = (np.full(n, v, np.uint32) for v in _START)
    for i in range(64):
        kind = i // 16
        if kind == 0:
            mixed = d ^ (b & (c ^ d))
        elif kind == 1:
            mixed = c ^ (d & (b ^ c))
        elif kind == 2:
            mixed = b ^ c ^ d
        else:
            mixed = c ^ (b | ~d)
        mixed += a
        mixed += np.uint32(_SINES[i])
        word = (_STEPS[kind][0] * i + _STEPS[kind][1]) % 16
        if word <= used or word == 14:
            mixed += words[word]
        turn = _SHIFTS[kind][i % 4]
        turned = mixed << np.uint32(turn)
        mixed >>= np.uint32(32 - turn)
        turned |= mixed
        turned += b
        a, d, c, b = d, c, b, turned
    return (a + np.uint32(_START[0])).byteswap()


def _bytes_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, bytes) of a string array without NULLs."""
    texts = texts.cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1] or bytes(8), np.int64)[texts.offset : texts.offset + len(texts) + 1]
    return offsets, np.frombuffer(texts.buffers()[2] or b"", np.uint8)


def token_counts(texts: pa.Array) -> pa.Array:
    """`token_count` of a column of texts: one more than the runs of separators between what spaces enclose."""
    trimmed = pc.ascii_trim(pc.fill_null(texts, ""), characters=" ")
    offsets, data = _bytes_of(trimmed)
    if not len(trimmed):
        return pa.array([], pa.int32())
    low, high = int(offsets[0]), int(offsets[-1])
    apart = _SEPARATES[data[low:high]]
    begins = apart.copy()
    begins[1:] &= ~apart[:-1]
    first = offsets[:-1][np.diff(offsets) > 0] - low
    begins[first] = apart[first]
    runs = np.searchsorted(np.flatnonzero(begins), offsets - low)
    return pa.array(np.diff(runs) + 1, pa.int32(), mask=np.asarray(pc.is_null(texts)))


_loaded: dict[str, Callable] = {}


def loaded(token: str, make: Callable[[], Callable]) -> Callable:
    """The embedder of this token in this process, made at its first use; only the last few are kept."""
    if token not in _loaded:
        while len(_loaded) >= 4:
            _loaded.pop(next(iter(_loaded)))
        _loaded[token] = make()
    return _loaded[token]


def embed_text(
    text: Column,
    make_embedder: Callable[[], Callable[[Sequence[str]], np.ndarray]] | None = None,
    dim: int = DEFAULT_DIM,
    batch_size: int | None = None,
) -> Column:
    """Unit-length array<float> per text. `make_embedder` is called once per Python worker, however many tasks it
    runs, and must return a callable from a list of texts to a matrix; `batch_size` bounds the texts of one call."""
    token = uuid.uuid4().hex

    def encode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        embedder = loaded(token, make_embedder or (lambda: HashingEmbedder(dim)))
        for texts in batches:
            step = batch_size or max(1, len(texts))
            parts = [texts.slice(at, step) for at in range(0, len(texts), step)]
            parts = [np.asarray(embedder(t.to_pylist() if make_embedder else t), dtype="float64") for t in parts]
            yield _unit_lists(np.concatenate(parts) if parts else np.zeros((0, dim)))

    return F.arrow_udf(encode, T.ArrayType(T.FloatType()))(F.coalesce(text, F.lit("")))


def _unit_lists(matrix: np.ndarray) -> pa.Array:
    norms = np.sqrt((matrix * matrix).sum(axis=1, keepdims=True)) + NORM_EPSILON
    unit = (matrix / norms).astype("float32")
    offsets = pa.array(np.arange(len(unit) + 1) * unit.shape[1], pa.int32())
    return pa.ListArray.from_arrays(offsets, pa.array(unit.reshape(-1)))


def with_text_vectors(df: DataFrame, text: str = "text") -> DataFrame:
    """The column `text` replaced by `token_count` and `embedding`, what token_count and embed_text make of it, from one
    Arrow pass over the texts."""
    others = [c for c in df.columns if c != text]
    added = [T.StructField("token_count", T.IntegerType()), T.StructField("embedding", T.ArrayType(T.FloatType()))]
    schema = T.StructType([*(df.schema[c] for c in others), *added])

    def run(batches):
        embedder = HashingEmbedder()
        for batch in batches:
            texts = batch.column(text)
            vectors = _unit_lists(embedder(pc.fill_null(texts, "")))
            kept = [batch.column(c) for c in others]
            yield pa.RecordBatch.from_arrays([*kept, token_counts(texts), vectors], schema.fieldNames())

    found = df.select(*others, text).mapInArrow(run, schema)
    # What a missing text counts for depends on the session.
    missing = token_count(F.lit(None).cast("string"))
    return found.withColumn("token_count", F.coalesce("token_count", missing))


def token_count(text: Column) -> Column:
    return F.size(F.split(F.trim(text), SPACES)).cast("int")

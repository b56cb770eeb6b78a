"""Product quantization of residuals: codebooks, encoding, approximate scoring."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cellsieve import limits
from cellsieve.functions.vectors import SETTLED_DECIMALS
from cellsieve.operators.scoring import CodeScores, matrix_of, sum_arrays
from cellsieve.schemas import CODEBOOKS
from cellsieve.session import cut

ALLOWED_BITS = (4, 5, 6, 7, 8)


def check_shape(dim: int, pq_m: int | None, pq_bits: int) -> None:
    if pq_m is None:
        raise ValueError("pq_m must be set")
    if dim % pq_m:
        raise ValueError(f"dim {dim} is not divisible by pq_m {pq_m}")
    if pq_bits not in ALLOWED_BITS:
        raise ValueError(f"pq_bits must be one of {ALLOWED_BITS}")


def codebook_array(codebooks: DataFrame) -> np.ndarray:
    """(m, codes, width); its size is fixed by the configuration: 2^bits x dim values."""
    table = codebooks.select("m", "j", "codeword").toArrow()
    m = table.column("m").to_numpy()
    order = np.lexsort((table.column("j").to_numpy(), m))
    words = matrix_of(table.column("codeword"))[order]
    return words.reshape(int(m.max()) + 1, -1, words.shape[1])


def code_scores(codebooks: DataFrame) -> CodeScores:
    return CodeScores(codebook_array(codebooks))


def codebook_frame(spark, books: np.ndarray) -> DataFrame:
    rows = [
        (m, j, [float(x) for x in books[m, j]])
        for m in range(books.shape[0])
        for j in range(books.shape[1])
    ]
    return spark.createDataFrame(rows, CODEBOOKS)


def residuals(placed: DataFrame, centroids, vector: str = "embedding") -> DataFrame:
    """Add `residual` = vector - centroid of its cell (rows carry cell_id)."""
    from cellsieve.operators.ivf import Cells

    joined = placed.join(Cells.of(centroids).frame, "cell_id")
    difference = F.zip_with(vector, "centroid", lambda x, c: x.cast("double") - c)
    return joined.withColumn("residual", difference).drop("centroid")


def _nearest_codes(residual: np.ndarray, books: np.ndarray) -> np.ndarray:
    """Index of the closest codeword per row and sub-vector, lowest on ties."""
    rows = len(residual)
    m, codes, width = books.shape
    parts = residual.reshape(rows, m, width)
    out = np.zeros((rows, m), dtype="int64")
    step = max(64, limits.TILE_ENTRIES // codes)
    for i in range(m):
        lengths = (books[i] * books[i]).sum(axis=1)
        for at in range(0, rows, step):
            block = parts[at : at + step, i, :]
            own = (block * block).sum(axis=1)[:, None]
            distance = np.round(own + lengths - 2.0 * block @ books[i].T, SETTLED_DECIMALS)
            out[at : at + step, i] = distance.argmin(axis=1)
    return out


def encode(placed: DataFrame, centroids, codebooks: DataFrame, vector: str = "embedding") -> DataFrame:
    """Add `code array<smallint>`: per sub-vector of the residual the nearest codeword.

    Broadcasts the codebooks and, behind the size check, the centroids; more centroids than that are joined.
    """
    from cellsieve.operators.ivf import Cells

    books = codebook_array(codebooks)
    cells = Cells.of(centroids)
    shared = cells.shared
    out_schema = T.StructType(
        placed.schema.fields + [T.StructField("code", T.ArrayType(T.ShortType()))]
    )
    if shared is None:
        placed = residuals(placed, cells, vector)
    width = len(out_schema.fields) - 1

    def run(batches):
        for batch in batches:
            if "residual" in batch.schema.names:
                residual = matrix_of(batch.column("residual"))
            else:
                cell_ids, matrix = shared.value
                where = np.searchsorted(cell_ids, np.asarray(batch.column("cell_id")).astype("int64"))
                data = matrix_of(batch.column(vector))
                residual = data - matrix[where] if batch.num_rows else np.zeros((0, matrix.shape[1]))
            codes = _nearest_codes(residual, books)
            offsets = pa.array(np.arange(len(codes) + 1) * books.shape[0], pa.int32())
            packed = pa.ListArray.from_arrays(offsets, pa.array(codes.reshape(-1), pa.int16()))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:width], packed], out_schema.fieldNames()
            )

    columns = out_schema.fieldNames()[:-1]
    extra = ["residual"] if shared is None else []
    return placed.select(*columns, *extra).mapInArrow(run, out_schema)


def codebook_error(with_residual: DataFrame, books: np.ndarray) -> float:
    """Sum of squared distances of all residuals from their nearest codewords."""
    m, _, width = books.shape

    def partial(batches):
        total = 0.0
        for batch in batches:
            if batch.num_rows:
                residual = matrix_of(batch.column("residual"))
                nearest = _nearest_codes(residual, books)
                parts = residual.reshape(len(residual), m, width)
                total += sum(float(((parts[:, i, :] - books[i][nearest[:, i]]) ** 2).sum()) for i in range(m))
        yield pa.RecordBatch.from_arrays([pa.array([total])], ["error"])

    return with_residual.select("residual").mapInArrow(partial, "error double").agg(F.sum("error")).head()[0] or 0.0


def codebook_step(with_residual: DataFrame, books: np.ndarray) -> DataFrame:
    """One Lloyd step for all sub-spaces at once: (m, j, codeword, members).

    A task emits one partial sum per (sub-space, code); codes without members keep their codeword.
    """
    m_count, codes, width = books.shape

    def partial_sums(batches):
        sums = np.zeros((m_count, codes, width))
        counts = np.zeros((m_count, codes), dtype="int64")
        for batch in batches:
            if not batch.num_rows:
                continue
            residual = matrix_of(batch.column("residual"))
            nearest = _nearest_codes(residual, books)
            parts = residual.reshape(len(residual), m_count, width)
            for m in range(m_count):
                np.add.at(sums[m], nearest[:, m], parts[:, m, :])
                counts[m] += np.bincount(nearest[:, m], minlength=codes)
        used_m, used_j = np.nonzero(counts)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(used_m, pa.int32()),
                pa.array(used_j, pa.int32()),
                pa.array(counts[used_m, used_j], pa.int64()),
                pa.array(sums[used_m, used_j].tolist(), pa.list_(pa.float64())),
            ],
            ["m", "j", "n", "sums"],
        )

    partial = with_residual.select("residual").mapInArrow(
        partial_sums, "m int, j int, n bigint, sums array<double>"
    )
    means = sum_arrays(partial, ["m", "j"]).select(
        "m", "j", F.transform("sums", lambda x: x / F.col("n")).alias("mean"), F.col("n").alias("members")
    )
    old = codebook_frame(with_residual.sparkSession, books)
    return old.join(means, ["m", "j"], "left").select(
        "m",
        "j",
        F.coalesce("mean", "codeword").alias("codeword"),
        F.coalesce("members", F.lit(0)).cast("bigint").alias("members"),
    )


def seed_codebooks(with_residual: DataFrame, pq_m: int, pq_bits: int, seed: int, key: str) -> np.ndarray:
    """Sub-vectors of the 2^bits rows with the smallest seeded hashes as first codewords."""
    from cellsieve.operators.ivf import ticket, train_sample

    nonzero = with_residual.filter(F.exists("residual", lambda x: F.abs(x) > 1e-9))
    rows = train_sample(nonzero, key, 2**pq_bits, seed).orderBy(ticket(key, seed), key).select("residual").toArrow()
    matrix = matrix_of(rows.column("residual"))
    if len(matrix) < 2**pq_bits:
        raise ValueError(f"{len(matrix)} training rows are too few for {2**pq_bits} codes")
    return matrix.reshape(len(matrix), pq_m, -1).transpose(1, 0, 2).copy()


def train_codebooks(
    placed_sample: DataFrame,
    centroids,
    pq_m: int,
    pq_bits: int = 8,
    iterations: int = 10,
    seed: int = 6400,
    key: str = "item_id",
) -> DataFrame:
    """k-means of the residual sub-vectors, all sub-spaces per pass: (m, j, codeword)."""
    with_residual = cut(residuals(placed_sample, centroids).select(key, "residual"))
    dim = with_residual.select(F.size("residual").alias("dim")).head()["dim"]
    check_shape(dim, pq_m, pq_bits)
    books = seed_codebooks(with_residual, pq_m, pq_bits, seed, key)
    for _ in range(iterations):
        updated = codebook_array(codebook_step(with_residual, books))
        if np.allclose(updated, books, atol=1e-9):
            break
        books = updated
    return codebook_frame(placed_sample.sparkSession, books)

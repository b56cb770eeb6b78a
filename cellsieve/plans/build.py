"""Index build: sample, embed, train, add everything, save."""

from __future__ import annotations

import warnings

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellsieve.functions.text import embed_text
from cellsieve.operators import ivf, pq
from cellsieve.operators.ivf import Cells, IvfIndex
from cellsieve.session import cut
from cellsieve.sources.tables import load_index, save_index

# Training sample and quantizer sizes used when none are given.
TRAIN_MAX = 60_000
NLIST = 512
PQ_M = 32
PQ_BITS = 8


def embed_items(items: DataFrame, text_column: str = "text", embedder=None, dim: int = 64) -> DataFrame:
    """Items with a unit `embedding` instead of their text."""
    return items.withColumn("embedding", embed_text(F.col(text_column), embedder, dim)).drop(text_column)


def build_index(
    items: DataFrame,
    path: str,
    *,
    text_column: str = "text",
    nlist: int = NLIST,
    pq_m: int | None = PQ_M,
    pq_bits: int = PQ_BITS,
    train_size: int = TRAIN_MAX,
    embedder=None,
    dim: int = 64,
    max_iter: int = 20,
) -> IvfIndex:
    """Build and save an index over items (item_id, text, carried columns); returns the loaded index.

    Only the bounded training sample is embedded twice; the full table is read and embedded once.
    """
    if pq_m is not None:
        pq.check_shape(dim, pq_m, pq_bits)
    picked = ivf.train_sample(items.select("item_id", text_column), "item_id", train_size)
    sample = cut(embed_items(picked, text_column, embedder, dim))
    size = sample.count()
    if size < ivf.TRAIN_PER_CELL * nlist:
        warnings.warn(f"{size} training rows for {nlist} cells; about {ivf.TRAIN_PER_CELL * nlist} serve better")
    cells = Cells(cut(ivf.train_centroids(sample, nlist, max_iter=max_iter)))
    codebooks = None
    if pq_m is not None:
        placed = ivf.assign_cells(sample, cells)
        codebooks = cut(pq.train_codebooks(placed, cells, pq_m, pq_bits, iterations=max_iter))
    save_index(ivf.index_items(embed_items(items, text_column, embedder, dim), cells, codebooks), path)
    return load_index(items.sparkSession, path)

"""Text in, result table out."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellsieve.functions.text import embed_text
from cellsieve.operators.histogram import Histogram2D
from cellsieve.operators.ivf import IvfIndex
from cellsieve.operators.predicates import parse_predicates
from cellsieve.plans.hybrid import filtered_search, with_items


def embed_queries(queries: DataFrame, embedder=None, dim: int = 64) -> DataFrame:
    """(qid, text) to (qid, qvec)."""
    return queries.select("qid", embed_text(F.col("text"), embedder, dim).alias("qvec"))


def perform_search(
    index: IvfIndex,
    items: DataFrame,
    queries: DataFrame,
    k: int,
    predicates: Iterable[Mapping[str, Any]],
    method: str,
    histogram: Histogram2D | None = None,
    embedder=None,
) -> DataFrame:
    """Search for a table of query texts (qid, text) under predicate dictionaries, of which invalid ones are
    skipped; returns the display columns with rank and similarity."""
    vectors = embed_queries(queries, embedder, index.dim)
    found = filtered_search(index, vectors, parse_predicates(predicates), k, method, histogram, items)
    return with_items(found, items)

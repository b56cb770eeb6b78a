"""Flatten typed source columns to text."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed value: the one list column that is joined instead of written as JSON.
JOINED_LIST = "categories"


def value_text(name: str, kind: T.DataType) -> Column:
    """NULL is empty text, `categories` a list joined by "; ", other nested values JSON, the rest their text."""
    column = F.col(name)
    if isinstance(kind, T.StringType):
        text = column
    elif name == JOINED_LIST and isinstance(kind, T.ArrayType):
        text = F.array_join(F.transform(column, lambda x: x.cast("string")), "; ")
    elif isinstance(kind, (T.ArrayType, T.MapType, T.StructType)):
        text = F.to_json(column, {"ignoreNullFields": "false"})
    else:
        text = column.cast("string")
    return F.coalesce(text, F.lit(""))


def flatten_to_text(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    """The named columns as text, in that order; a column the source lacks is empty."""
    kinds = {f.name: f.dataType for f in df.schema.fields}
    return df.select(
        *[
            (value_text(c, kinds[c]) if c in kinds else F.lit("")).alias(c)
            for c in columns
        ]
    )

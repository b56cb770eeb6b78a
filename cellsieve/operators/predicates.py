"""Metadata predicates: validation, columns, filter scans and workload tables."""

from __future__ import annotations

import functools
import operator
import warnings
from collections.abc import Iterable, Mapping
from dataclasses import dataclass
from datetime import datetime, timezone
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellsieve import limits
from cellsieve.functions.dates import predicate_date

# What a predicate may test and how.
PREDICATE_COLUMNS = ("item_id", "revdate", "token_count")
DATE_COLUMNS = ("revdate",)
OPERATORS = ("=", ">", "<", ">=", "<=", "IN")
DATE_FORMATS = ("%Y-%m-%d %H:%M:%S", "%Y-%m-%d %H:%M", "%Y-%m-%d")

_COMPARE = {"=": operator.eq, ">": operator.gt, "<": operator.lt, ">=": operator.ge, "<=": operator.le}


def normalize_date(value: Any) -> str:
    """A predicate date as YYYY-MM-DD HH:MM:SS."""
    for layout in DATE_FORMATS:
        try:
            return datetime.strptime(str(value), layout).strftime(DATE_FORMATS[0])
        except ValueError:
            continue
    raise ValueError(f"unsupported date '{value}', use one of {', '.join(DATE_FORMATS)}")


@dataclass(frozen=True)
class Predicate:
    """One condition on a metadata column; a list of them is a conjunction."""

    key: str
    value: Any
    operator: str

    def __post_init__(self):
        if self.key not in PREDICATE_COLUMNS:
            raise ValueError(f"invalid predicate key: {self.key}")
        if self.operator not in OPERATORS:
            raise ValueError(f"invalid predicate operator: {self.operator}")
        if self.operator == "IN" and not isinstance(self.value, (list, tuple)):
            raise ValueError(f"IN needs a list: {self.value}")
        if self.key in DATE_COLUMNS:
            if isinstance(self.value, (list, tuple)):
                fixed = [normalize_date(v) for v in self.value]
            else:
                fixed = normalize_date(self.value)
            object.__setattr__(self, "value", fixed)

    def __str__(self) -> str:
        return f"{self.key} {self.operator} {self.value}"

    def _literal(self, value: Any) -> Column:
        return F.lit(value).cast("timestamp_ntz") if self.key in DATE_COLUMNS else F.lit(value)

    def column(self) -> Column:
        """The condition; NULL metadata never passes and an empty IN passes nothing."""
        if self.operator == "IN":
            if not self.value:
                return F.lit(False)
            return F.col(self.key).isin([self._literal(v) for v in self.value])
        return _COMPARE[self.operator](F.col(self.key), self._literal(self.value))

    def numbers(self) -> list[float]:
        """The value(s) on the numeric axis of a histogram; dates as epoch seconds."""
        values = self.value if isinstance(self.value, (list, tuple)) else [self.value]
        if self.key in DATE_COLUMNS:
            return [
                datetime.strptime(v, DATE_FORMATS[0]).replace(tzinfo=timezone.utc).timestamp() for v in values
            ]
        return [float(v) for v in values]


def conjunction(predicates: Iterable[Predicate]) -> Column:
    """All predicates at once; none means every row."""
    return functools.reduce(operator.and_, [p.column() for p in predicates], F.lit(True))


def text_of(predicates: Iterable[Predicate]) -> str:
    return ", ".join(str(p) for p in predicates)


def _is_long(predicate: Predicate, literals: int | None = None) -> bool:
    most = limits.IN_LIST_LITERALS if literals is None else literals
    return predicate.operator == "IN" and len(predicate.value) > most


def _value_table(df: DataFrame, predicate: Predicate, name: str) -> DataFrame:
    """The distinct values of a long IN list, typed by the values as literals would be."""
    values = predicate.value
    if predicate.key in DATE_COLUMNS:
        kind = "string"
    elif all(isinstance(v, int) for v in values):
        kind = "bigint"
    else:
        kind, values = "double", [float(v) for v in values]
    table = df.sparkSession.createDataFrame([(v,) for v in values], f"{name} {kind}").distinct()
    return table.withColumn(name, F.col(name).cast("timestamp_ntz")) if predicate.key in DATE_COLUMNS else table


def _key_as(df: DataFrame, predicate: Predicate, table: DataFrame, name: str) -> Column:
    return F.col(predicate.key).cast(table.schema[name].dataType)


def predicate_filter(df: DataFrame, predicates: Iterable[Predicate], literals: int | None = None) -> DataFrame:
    """Rows passing every predicate; IN lists of more than `literals` values become a semi join."""
    literal = []
    for n, predicate in enumerate(predicates):
        if _is_long(predicate, literals):
            name = f"__value{n}"
            table = _value_table(df, predicate, name)
            df = df.join(table, _key_as(df, predicate, table, name) == F.col(name), "left_semi")
        else:
            literal.append(predicate)
    return df.filter(conjunction(literal)) if literal else df


def conditions(df: DataFrame, lists: Mapping[int, list[Predicate]]) -> tuple[DataFrame, dict[int, Column]]:
    """df and, by list, the condition of all its predicates. A long IN list is a left join with its distinct values
    that adds one flag column, so rows are neither lost nor repeated."""
    found, n = {}, 0
    for key, predicates in lists.items():
        literal = []
        flags = F.lit(True)
        for predicate in predicates:
            if not _is_long(predicate):
                literal.append(predicate)
                continue
            name, flag = f"__value{n}", f"__passes{n}"
            n += 1
            table = _value_table(df, predicate, name).withColumn(flag, F.lit(True))
            df = df.join(table, _key_as(df, predicate, table, name) == F.col(name), "left").drop(name)
            flags = flags & F.coalesce(F.col(flag), F.lit(False))
        found[key] = flags & conjunction(literal)
    return df, found


def with_passes(df: DataFrame, predicates: Iterable[Predicate]) -> DataFrame:
    """df with `passes`: whether a row meets every predicate."""
    columns = df.columns
    df, found = conditions(df, {0: list(predicates)})
    return df.select(*columns, found[0].alias("passes"))


def parse_predicates(raw: Iterable[Mapping[str, Any]]) -> list[Predicate]:
    """Predicates from dictionaries; invalid ones are skipped with a warning."""
    valid = []
    for entry in raw:
        try:
            valid.append(Predicate(entry["key"], entry["value"], entry["operator"]))
        except (ValueError, KeyError) as problem:
            warnings.warn(f"skipping invalid predicate {dict(entry)}: {problem}", stacklevel=2)
    return valid


# ------------------------------------------------------------------------------------------- workload tables


def validated(table: DataFrame) -> DataFrame:
    """Add `problem` (NULL when valid) to a predicate table (key, operator, value string, is_list)."""
    bad_date = F.col("key").isin(*DATE_COLUMNS) & ~F.col("is_list") & predicate_date(F.col("value")).isNull()
    return table.withColumn(
        "problem",
        F.when(~F.coalesce(F.col("key").isin(*PREDICATE_COLUMNS), F.lit(False)), F.lit("key"))
        .when(~F.coalesce(F.col("operator").isin(*OPERATORS), F.lit(False)), F.lit("operator"))
        .when((F.col("operator") == "IN") & ~F.col("is_list"), F.lit("list"))
        .when(bad_date, F.lit("date")),
    )


def normalized_dates(table: DataFrame, column: str) -> DataFrame:
    """Add `normalized` (timestamp_ntz) for a column of predicate dates; NULL marks an unsupported layout."""
    return table.withColumn("normalized", predicate_date(F.col(column)))


def workload_survivors(items: DataFrame, workload: Mapping[int, list[Predicate]], batch: int = 200) -> DataFrame:
    """(wid, survivors) for many predicate lists: conditional counts in one scan per `batch` lists, no join."""
    ids = sorted(workload)
    parts = []
    for at in range(0, len(ids), batch):
        some = ids[at : at + batch]
        marked, passes = conditions(items, {w: workload[w] for w in some})
        counted = marked.agg(*[F.count_if(passes[w]).alias(f"w{w}") for w in some])
        parts.append(
            counted.select(
                F.explode(
                    F.array(*[F.struct(F.lit(w).alias("wid"), F.col(f"w{w}").alias("survivors")) for w in some])
                ).alias("row")
            ).select("row.wid", "row.survivors")
        )
    return functools.reduce(DataFrame.unionByName, parts)

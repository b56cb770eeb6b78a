"""Two-dimensional equi-depth histogram: exact edges, counts, survivor estimates and reports."""

from __future__ import annotations

import functools
import math
import operator
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cellsieve.functions.dates import day_text, epoch_seconds, from_epoch, moment_text
from cellsieve.operators.predicates import Predicate

DEFAULT_BINS = 10
SKETCH_ACCURACY = 20_000

PREDICATE_STRUCT = "struct<key:string,operator:string,numbers:array<double>>"


# ----------------------------------------------------------------------------------------------------- edges


def quantile_edges(values: DataFrame, bins: dict[str, int], exact: bool = True) -> dict[str, list[float]]:
    """Evenly spaced percentiles (0..100, linear interpolation) of the named columns, all without NULLs.

    Exact without ordering everything in one place: a sketch brackets every wanted rank, exact counts per
    bracket tell which bracket holds it, and only rows of those brackets are grouped by value and ordered.
    """
    if not exact:
        sketches = values.agg(
            *[
                F.percentile_approx(axis, [i / n for i in range(n + 1)], SKETCH_ACCURACY).alias(axis)
                for axis, n in bins.items()
            ]
        ).head()
        return {axis: [float(v) for v in sketches[axis]] for axis in bins}
    sketches = values.agg(
        *[F.percentile_approx(axis, _brackets(n), SKETCH_ACCURACY).alias(axis) for axis, n in bins.items()]
    ).head()
    if any(sketches[axis] is None for axis in bins):
        raise ValueError("no rows to take percentiles of")
    brackets = {axis: _count_below(sorted(set(sketches[axis])), F.col(axis)) for axis in bins}
    marked = values.withColumns({f"{axis}_bracket": bracket for axis, bracket in brackets.items()})
    # A few dozen brackets per axis: their joint counts give the sizes of all of them in one pass.
    joint = marked.groupBy(*[f"{axis}_bracket" for axis in bins]).agg(F.count(F.lit(1)).alias("n")).collect()

    wanted, needed = {}, []
    for axis, n_bins in bins.items():
        sizes: dict[int, int] = {}
        for row in joint:
            sizes[row[f"{axis}_bracket"]] = sizes.get(row[f"{axis}_bracket"], 0) + row["n"]
        total = sum(sizes.values())
        wanted[axis] = [
            ((total - 1) * i // n_bins, (total - 1) * i % n_bins / n_bins) for i in range(n_bins + 1)
        ]
        asked = {r for r, _ in wanted[axis]} | {min(r + 1, total - 1) for r, _ in wanted[axis]}
        before = 0
        for bracket, n in sorted(sizes.items()):
            ranks = sorted(r for r in asked if before <= r < before + n)
            if ranks:
                needed.append((axis, bracket, before, ranks))
            before += n
    targets = F.broadcast(
        values.sparkSession.createDataFrame(needed, "axis string, bracket int, before bigint, ranks array<bigint>")
    )
    inside = F.array(
        *[
            F.when(
                F.col(f"{axis}_bracket").isin([b for a, b, _, _ in needed if a == axis]),
                F.struct(F.lit(axis).alias("axis"), F.col(f"{axis}_bracket").alias("bracket"), F.col(axis).alias("value")),
            )
            for axis in bins
        ]
    )
    in_bracket = Window.partitionBy("axis", "bracket").orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    located = (
        marked.select(F.explode(F.array_compact(inside)).alias("r"))
        .groupBy("r.axis", "r.bracket", "r.value")
        .agg(F.count(F.lit(1)).alias("n"))
        .join(targets, ["axis", "bracket"])
        .withColumn("upto", F.col("before") + F.sum("n").over(in_bracket))
        .withColumn("hit", F.filter("ranks", lambda r: (r < F.col("upto")) & (r >= F.col("upto") - F.col("n"))))
        .filter(F.size("hit") > 0)
        .select("axis", F.explode("hit").alias("rank"), "value")
        .collect()
    )
    at = {(r["axis"], r["rank"]): r["value"] for r in located}
    edges = {}
    for axis, ranks in wanted.items():
        edges[axis] = []
        for rank, fraction in ranks:
            low = at[(axis, rank)]
            high = at.get((axis, rank + 1), low)
            edges[axis].append(low + (high - low) * fraction)
    return edges


def _brackets(n_bins: int) -> list[float]:
    """Fractions just below and above each wanted percentile, twice the sketch error away."""
    margin = 2.0 / SKETCH_ACCURACY
    around = [p for i in range(n_bins + 1) for p in (i / n_bins - margin, i / n_bins + margin)]
    return sorted(p for p in around if 0.0 < p < 1.0)


def _numbers(values: Iterable[float]) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])


def _count_below(edges: list[float], value: Column) -> Column:
    """How many edges lie below the value: a sum of comparisons, which stays inside generated code."""
    return functools.reduce(operator.add, [(value > F.lit(float(e))).cast("int") for e in edges], F.lit(0))


def bin_index(value: Column, edges: list[float]) -> Column:
    """Bins are (lo, hi]; the first one also holds the minimum, and values outside go to the end bins."""
    return F.greatest(F.lit(0), F.least(F.lit(len(edges) - 2), _count_below(edges, value) - 1))


# ------------------------------------------------------------------------------------------------- histogram


@dataclass(frozen=True)
class Histogram2D:
    """Edges per axis and the filled cells (i, j, n): at most bins x bins rows."""

    number_edges: list[float]
    date_edges: list[float]
    cells: DataFrame

    @property
    def shape(self) -> tuple[int, int]:
        return len(self.number_edges) - 1, len(self.date_edges) - 1

    # ---- build -------------------------------------------------------------------------------------------

    @classmethod
    def build(
        cls,
        items: DataFrame,
        number_column: str = "token_count",
        date_column: str = "revdate",
        number_bins: int = DEFAULT_BINS,
        date_bins: int = DEFAULT_BINS,
        exact: bool = True,
    ) -> Histogram2D:
        """Rows without a date or number are left out of the histogram; `left_out` counts them."""
        axes = items.select(
            F.col(number_column).cast("double").alias("number"), epoch_seconds(F.col(date_column)).alias("date")
        )
        complete = axes.filter(F.col("number").isNotNull() & F.col("date").isNotNull())
        edges = quantile_edges(complete, {"number": number_bins, "date": date_bins}, exact)
        cells = (
            complete.groupBy(
                bin_index(F.col("number"), edges["number"]).alias("i"),
                bin_index(F.col("date"), edges["date"]).alias("j"),
            )
            .agg(F.count(F.lit(1)).alias("n"))
        )
        return cls(edges["number"], edges["date"], cells)

    @staticmethod
    def left_out(items: DataFrame, number_column: str = "token_count", date_column: str = "revdate") -> DataFrame:
        """How many rows a histogram of these columns leaves out, by reason."""
        return items.agg(
            F.count_if(F.col(number_column).isNull()).alias("without_number"),
            F.count_if(F.col(date_column).isNull()).alias("without_date"),
        )

    def collected(self) -> Histogram2D:
        """The same with its cells (at most bins x bins rows) computed once."""
        rows = self.cells.collect()
        spark = self.cells.sparkSession
        cells = spark.createDataFrame([tuple(r) for r in rows], self.cells.schema).coalesce(1)
        return Histogram2D(self.number_edges, self.date_edges, cells)

    # ---- tables ------------------------------------------------------------------------------------------

    def edges(self) -> DataFrame:
        """(axis, edge_index, value)"""
        rows = [("number", i, float(v)) for i, v in enumerate(self.number_edges)]
        rows += [("date", i, float(v)) for i, v in enumerate(self.date_edges)]
        return self.cells.sparkSession.createDataFrame(rows, "axis string, edge_index int, value double")

    def grid(self) -> DataFrame:
        """Every cell of the grid, empty ones with n = 0."""
        rows, columns = self.shape
        spark = self.cells.sparkSession
        every = spark.range(rows * columns).select(
            F.expr(f"int(id div {columns})").alias("i"), F.expr(f"int(id % {columns})").alias("j")
        )
        return every.join(self.cells, ["i", "j"], "left").select(
            "i", "j", F.coalesce("n", F.lit(0)).alias("n")
        )

    def date_edge_table(self) -> DataFrame:
        return (
            self.edges()
            .filter(F.col("axis") == "date")
            .select("edge_index", F.col("value").alias("revdate_ts"), moment_text(from_epoch(F.col("value"))).alias("revdate_str"))
        )

    def labelled_grid(self) -> DataFrame:
        """Grid as rows = number ranges, columns d0..dn = date ranges, with the labels of both."""
        rows, columns = self.shape
        wide = self.grid().groupBy("i").pivot("j", list(range(columns))).agg(F.sum("n"))
        low, high = self._bounds(self.number_edges, F.col("i"))
        as_text = lambda c: F.format_string("%.0f", F.bround(c, 0))
        label = F.when(F.col("i") == 0, F.concat(F.lit("≤"), as_text(high))).otherwise(
            F.concat(F.lit("("), as_text(low), F.lit(", ≤"), as_text(high), F.lit(")"))
        )
        return wide.select(
            "i", label.alias("token_range"), *[F.col(str(j)).alias(f"d{j}") for j in range(columns)]
        )

    def date_labels(self) -> DataFrame:
        """(j, label) for the columns of `labelled_grid`."""
        low, high = self._bounds(self.date_edges, F.col("j"))
        low, high = day_text(from_epoch(low)), day_text(from_epoch(high))
        label = F.when(F.col("j") == 0, F.concat(F.lit("≤"), high)).otherwise(
            F.concat(F.lit("("), low, F.lit(", ≤"), high, F.lit(")"))
        )
        spark = self.cells.sparkSession
        return spark.range(self.shape[1]).select(F.col("id").cast("int").alias("j")).withColumn("label", label)

    @staticmethod
    def _bounds(edges: list[float], index: Column) -> tuple[Column, Column]:
        values = _numbers(edges)
        return F.get(values, index), F.get(values, index + 1)

    def summary(self) -> DataFrame:
        """One row: totals, extremes, filled cells, averages (NULL average when nothing is filled)."""
        rows, columns = self.shape
        filled = F.count_if(F.col("n") > 0)
        return self.grid().agg(
            F.sum("n").alias("total"),
            F.max("n").alias("max_count"),
            F.min("n").alias("min_count"),
            filled.alias("non_empty_bins"),
            (100 * filled / F.lit(rows * columns)).alias("non_empty_pct"),
            (F.sum("n") / F.lit(rows * columns)).alias("avg_per_bin"),
            F.when(filled > 0, F.sum("n") / filled).alias("avg_per_non_empty_bin"),
        )

    # ---- rectangle and estimates -------------------------------------------------------------------------

    def rectangle_sum(self, number_range: tuple[float, float], date_range: tuple[float, float]) -> DataFrame:
        """Total of whole bins from the first edge not below each minimum to the last not above each maximum.

        The bin that contains a lower bound is left out, as in the published behaviour.
        """

        def span(edges, low, high):
            start = sum(1 for e in edges if e < low)
            end = sum(1 for e in edges if e <= high)
            return start, end

        number_start, number_end = span(self.number_edges, *number_range)
        date_start, date_end = span(self.date_edges, *date_range)
        inside = (
            (F.col("i") >= number_start)
            & (F.col("i") < number_end)
            & (F.col("j") >= date_start)
            & (F.col("j") < date_end)
        )
        return self.cells.filter(inside).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("rectangle"))

    @functools.cached_property
    def counts(self) -> list[list[float]]:
        """The cells as a matrix (at most bins x bins numbers)."""
        rows, columns = self.shape
        matrix = [[0.0] * columns for _ in range(rows)]
        for cell in self.cells.collect():
            matrix[cell["i"]][cell["j"]] = float(cell["n"])
        return matrix

    def estimate_column(self, predicates: str) -> Column:
        """Estimated survivors of an array of PREDICATE_STRUCT, as one row-local expression.

        Every bin of an axis gets the product of its predicates' fractions; the estimate is the weighted
        sum of the cells. Predicates on other columns do not narrow it.
        """
        matrix = ", ".join(f"array({', '.join(f'{n!r}D' for n in row)})" for row in self.counts)
        number_weights = self._weights(predicates, "token_count", self.number_edges)
        date_weights = self._weights(predicates, "revdate", self.date_edges)
        add = "0D, (total, x) -> total + x"
        per_row = f"transform(array({matrix}), row -> aggregate(zip_with(row, {date_weights}, (n, w) -> n * w), {add}))"
        # Six decimals first: summation order must not push a whole number below itself.
        return F.expr(
            f"bigint(floor(round(aggregate(zip_with({per_row}, {number_weights}, (n, w) -> n * w), {add}), 6)))"
        )

    @staticmethod
    def _weights(predicates: str, key: str, edges: list[float]) -> str:
        bins = ", ".join(
            f"named_struct('lo', {float(lo)!r}D, 'hi', {float(hi)!r}D)" for lo, hi in zip(edges[:-1], edges[1:])
        )
        own = f"filter({predicates}, p -> p.key = '{key}')"
        return f"transform(array({bins}), b -> aggregate({own}, 1D, (w, p) -> w * {BIN_FRACTION}))"

    def estimate(self, predicates: list[Predicate]) -> int:
        """Estimated survivors of one predicate list, from the cells at hand; the same as `estimate_column`."""
        weights = {}
        for key, edges in (("token_count", self.number_edges), ("revdate", self.date_edges)):
            own = [(p.operator, p.numbers()) for p in predicates if p.key == key]
            weights[key] = [math.prod(bin_fraction(o, v, lo, hi) for o, v in own) for lo, hi in zip(edges, edges[1:])]
        rows = [sum(n * w for n, w in zip(row, weights["revdate"])) for row in self.counts]
        return math.floor(round(sum(n * w for n, w in zip(rows, weights["token_count"])), 6))


def bin_fraction(op: str, numbers: list[float], lo: float, hi: float) -> float:
    """BIN_FRACTION for one bin on the driver."""
    if op in ("=", "IN"):
        return float(any(lo <= x <= hi for x in numbers))
    value, above = numbers[0], op in (">", ">=")
    part = 0.0 if hi == lo else max(0.0, (hi - value if above else value - lo) / (hi - lo))
    whole = {">": lo > value, ">=": lo >= value, "<": hi < value, "<=": hi <= value}[op]
    some = {">": hi > value, ">=": hi >= value, "<": lo < value, "<=": lo <= value}[op]
    return 1.0 if whole else part if some else 0.0


# Share of the bin (lo, hi] that one predicate keeps, by linear interpolation; = and IN keep every bin they touch.
_ABOVE = "greatest(0D, try_divide(b.hi - get(p.numbers, 0), b.hi - b.lo))"
_UNDER = "greatest(0D, try_divide(get(p.numbers, 0) - b.lo, b.hi - b.lo))"
BIN_FRACTION = f"""CASE p.operator
  WHEN '>' THEN CASE WHEN b.lo > get(p.numbers, 0) THEN 1D WHEN b.hi > get(p.numbers, 0) THEN {_ABOVE} ELSE 0D END
  WHEN '>=' THEN CASE WHEN b.lo >= get(p.numbers, 0) THEN 1D WHEN b.hi >= get(p.numbers, 0) THEN {_ABOVE} ELSE 0D END
  WHEN '<' THEN CASE WHEN b.hi < get(p.numbers, 0) THEN 1D WHEN b.lo < get(p.numbers, 0) THEN {_UNDER} ELSE 0D END
  WHEN '<=' THEN CASE WHEN b.hi <= get(p.numbers, 0) THEN 1D WHEN b.lo <= get(p.numbers, 0) THEN {_UNDER} ELSE 0D END
  ELSE IF(exists(p.numbers, x -> b.lo <= x AND x <= b.hi), 1D, 0D) END"""

"""Vector column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NORM_EPSILON = 1e-12

# Similarities are settled to this many decimals before they are ranked. The inputs are 32-bit floats, so
# later digits only reflect summation order, which would make ties depend on how rows were batched.
SETTLED_DECIMALS = 9


def l2_normalize(vector: str) -> Column:
    """Unit-length copy of an array column as array<float>; a zero vector stays zero."""
    squares = f"aggregate({vector}, 0D, (total, x) -> total + double(x) * double(x))"
    # The length is bound once, as the only element of an array: inside the inner lambda it would be summed up anew for
    # every component.
    unit = f"transform({vector}, x -> float(double(x) / __length))"
    return F.expr(f"get(transform(array(sqrt({squares}) + {NORM_EPSILON}D), __length -> {unit}), 0)")


def inner_product(left: Column, right: Column) -> Column:
    """Double-precision inner product of two arrays (cosine when both are unit length)."""
    products = F.zip_with(left, right, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda total, x: total + x)


def settle(similarity: Column) -> Column:
    return F.round(similarity, SETTLED_DECIMALS)

"""Column expressions over arrays of numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quarry.functions.text import _column


def inner_product(a: Column | str, b: Column | str) -> Column:
    """Sum of products in double precision; the cosine if both vectors have length one."""
    products = F.zip_with(
        _column(a), _column(b), lambda x, y: x.cast("double") * y.cast("double")
    )
    return F.aggregate(products, F.lit(0.0), lambda total, x: total + x)


def norm(v: Column | str) -> Column:
    return F.sqrt(
        F.aggregate(
            _column(v), F.lit(0.0), lambda total, x: total + x.cast("double") * x.cast("double")
        )
    )


def l2_normalise(v: Column | str) -> Column:
    """``v`` scaled to length one, as float; a zero vector stays as it is."""
    v = _column(v)
    # The length sits in a one-element array so that it is computed once per row and not once
    # per component.
    scaled = F.transform(
        F.array(norm(v)),
        lambda n: F.transform(
            v, lambda x: F.when(n > 0, x.cast("double") / n).otherwise(x.cast("double"))
        ),
    )
    return scaled[0].cast("array<float>")

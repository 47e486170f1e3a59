"""Column helpers on numbers and vectors."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def rounded(x: Column | str, digits: int = 6) -> Column:
    """Half-up rounding by floor, which engines agree on; NaN stays."""
    scale = float(10**digits)
    x = F.col(x) if isinstance(x, str) else x
    return F.when(F.isnan(x), x).otherwise(F.floor(x * scale + 0.5) / scale)


def divided(a: Column, b: Column) -> Column:
    """a / b with NaN where b is 0, as in floating point, rather than an error."""
    return F.when(b == 0, F.lit(float("nan"))).otherwise(a / b)


def dot(a: Column, b: Column) -> Column:
    """Inner product of two arrays; terms are added from the left."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(*xs: Column) -> Column:
    total = xs[0] * xs[0]
    for x in xs[1:]:
        total = total + x * x
    return F.sqrt(total)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays; NaN if one is zero."""
    return divided(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def angle_between(u: Sequence[Column], v: Sequence[Column]) -> Column:
    """Unsigned angle of two vectors given by coordinates; NaN if one is zero."""
    inner = sum((a * b for a, b in zip(u[1:], v[1:], strict=True)), u[0] * v[0])
    size = norm(*u) * norm(*v)
    # NaN counts as larger than any number, so it would not survive the clipping.
    return F.when(size == 0, F.lit(float("nan"))).otherwise(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), inner / size))))


def bin_of(x: Column, low: Column | float, high: Column | float, n: int) -> Column:
    """Histogram bin of a value within [low, high], the last one closed; null outside."""
    low, high = (v if isinstance(v, Column) else F.lit(float(v)) for v in (low, high))
    return F.when((x >= low) & (x <= high), F.least(F.lit(n - 1), F.floor((x - low) / (high - low) * n).cast("int")))


def held(df: DataFrame, **columns: Column) -> DataFrame:
    """Adds columns that are computed once for each row.

    A plain projection may be merged into the next one, and what a lambda
    refers to is then computed again for each element; a generator of one row
    is never merged.
    """
    return df.select("*", F.inline(F.array(F.struct(*(c.alias(n) for n, c in columns.items())))))

"""Vector functions over array columns, folded in array order so that sums do not depend on the shuffle."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once, where the body uses it for each element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def sum_squares(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double"))


def squared_distance(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))))


def scale(v: Column, s: Column) -> Column:
    return F.transform(v, lambda x: x.cast("double") * s)


def l2_normalize(v: Column, floor: float = 1e-12) -> Column:
    """Unit length; the norm is floored so that a zero vector stays zero."""
    return let(F.greatest(F.sqrt(sum_squares(v)), F.lit(floor)), lambda n: F.transform(v, lambda x: x.cast("double") / n))


def rms_norm(v: Column, epsilon: float = 1e-6) -> Column:
    return let(F.sqrt(sum_squares(v) / F.size(v) + epsilon), lambda n: F.transform(v, lambda x: x.cast("double") / n))


def mat_vec(rows: Column, v: Column) -> Column:
    """Product of a matrix (array of rows) and a vector."""
    return F.transform(rows, lambda r: dot(r, v))


def add(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y)


def softplus(x: Column) -> Column:
    return F.log1p(F.exp(x))


def tidy(c: Column, places: int = 6) -> Column:
    """Rounded, with negative zero made zero."""
    return F.round(c, places) + F.lit(0.0)


def signed_top_k(scores: Column, k: int, valid: Column | None = None, epsilon: float = 1e-6) -> Column:
    """array<struct(index, weight)>: the k scores largest in magnitude, divided by the sum of their magnitudes.

    Ties go to the lower index; scores that are not valid never come first and weigh nothing.
    """
    parts = F.transform(scores, lambda s, i: F.struct((-F.abs(s)).alias("m"), i.alias("index"), s.cast("double").alias("s")))
    if valid is not None:
        parts = F.filter(F.zip_with(parts, valid, lambda p, ok: F.when(ok, p)), lambda p: p.isNotNull())
    top = F.slice(F.array_sort(parts), 1, k)
    mass = F.aggregate(top, F.lit(0.0), lambda acc, p: acc + F.abs(p["s"]))
    return F.transform(top, lambda p: F.struct(p["index"].alias("index"), (p["s"] / (mass + epsilon)).alias("weight")))

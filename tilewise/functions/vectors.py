"""Column expressions on vectors and numbers; all run inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EPS = 1e-8


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine_distance(a: Column, b: Column) -> Column:
    """1 - cosine, kept in [0, 2]; norms below EPS count as EPS."""
    cosine = dot(a, b) / (F.greatest(norm(a), F.lit(EPS)) * F.greatest(norm(b), F.lit(EPS)))
    return F.least(F.greatest(1.0 - cosine, F.lit(0.0)), F.lit(2.0))


def is_finite(x: Column) -> Column:
    return ~F.isnan(x) & (F.abs(x.cast("double")) != float("inf"))


def hann_weight(place: Column, size: Column | int) -> Column:
    """Raised Hann window with a floor: 1 on axes of size 1."""
    n = F.lit(size) if isinstance(size, int) else size
    wave = 0.5 - 0.5 * F.cos(2 * F.pi() * place / F.greatest(n - 1, F.lit(1)))
    return F.when(n == 1, F.lit(1.0)).otherwise(wave)


def linspace(start: Column, stop: Column, n: int) -> Column:
    """n points from start to stop; the last is stop itself."""
    step = (stop - start) / (n - 1)
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.when(i == n - 1, stop).otherwise(start + i * step))

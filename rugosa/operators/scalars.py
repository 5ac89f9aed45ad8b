"""Scalar roughness parameters: one pass of partial and final aggregates each."""

from __future__ import annotations

import math
from itertools import combinations_with_replacement

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import fourier
from .detrend import segments
from .guards import defined, single_valued

KEYS = ("scan_id",)


def basic(points: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """mean, min, max over defined points."""
    return points.groupBy(*keys).agg(F.avg("h").alias("mean"), F.min("h").alias("min"), F.max("h").alias("max"))


def rq(points: DataFrame, keys: tuple[str, ...] = KEYS, lines: tuple[str, ...] = ()) -> DataFrame:
    """Rms height of profiles: about the mean of each line (lines: the columns that tell a scan's lines apart)."""
    each = points.groupBy(*keys, *lines).agg(F.var_pop("h").alias("v"), F.count("h").alias("n"))
    if not lines:
        return each.select(*keys, F.sqrt("v").alias("rq"))
    return each.groupBy(*keys).agg(F.sqrt(F.sum(F.col("v") * F.col("n")) / F.sum("n")).alias("rq"))


def sq(points: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    return points.groupBy(*keys).agg(F.stddev_pop("h").alias("sq"))


def moments_line(points: DataFrame, keys: tuple[str, ...] = KEYS, undefined: str = "raise") -> DataFrame:
    """Exact moments 1 to 4 about the mean height of the piecewise-linear uniform scan (order 1: that mean)."""
    w = Window.partitionBy(*keys).orderBy("ix")
    s = defined(points, undefined, keys).select(*keys, F.col("h").alias("h0"), F.lead("h").over(w).alias("h1")).where("h0 IS NOT NULL AND h1 IS NOT NULL")
    mean = s.groupBy(*keys).agg(F.avg((F.col("h0") + F.col("h1")) / 2).alias("m"))
    s = s.join(mean, list(keys)).select(*keys, "m", (F.col("h0") - F.col("m")).alias("a"), (F.col("h1") - F.col("m")).alias("b"))
    return s.groupBy(*keys).agg(F.first("m").alias("m1"), *[F.avg(F.expr(e)).alias(f"m{k}") for k, e in _LINE.items()])


# The mean of h^k over a straight piece from a to b: sum of a^i b^(k-i) over i, divided by k + 1.
_LINE = {k: "(" + " + ".join("*".join(["a"] * i + ["b"] * (k - i)) for i in range(k + 1)) + f") / {k + 1}D" for k in (2, 3, 4)}


# The mean of h^k over a triangle: all products of k corner heights (with repetition), of which there are (k + 1)(k + 2) / 2.
_TRIANGLE = {k: "(" + " + ".join("*".join(p) for p in combinations_with_replacement(("h1", "h2", "h3"), k)) + f") / {(k + 1) * (k + 2) // 2}D" for k in (1, 2, 3, 4)}


def moments_map(triangles: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Exact moments 1 to 4 of the surface of triangles (h1, h2, h3 of equal areas)."""
    return triangles.groupBy(*keys).agg(*(F.avg(F.expr(e)).alias(f"m{k}") for k, e in _TRIANGLE.items()))


def rms(column: Column | str) -> Column:
    c = F.col(column) if isinstance(column, str) else column
    return F.sqrt(F.avg(c * c))


def _smooth(points: DataFrame, pixel: float, cutoff: float | None, keys: tuple[str, ...]) -> DataFrame:
    """Line scans without wavelengths below the cutoff, taken as periodic for that."""
    return points if cutoff is None else fourier.filter_line(points, None, lambda q: q <= 2 * math.pi * pixel / cutoff + 1e-12, keys)


def rdq(points: DataFrame, pixel: float, keys: tuple[str, ...] = KEYS, cutoff: float | None = None) -> DataFrame:
    """Rms slope of line scans, first differences; cutoff: shorter wavelengths are filtered out before."""
    points = _smooth(points, pixel, cutoff, keys)
    w = Window.partitionBy(*keys).orderBy("ix")
    d = points.select(*keys, ((F.lead("h").over(w) - F.col("h")) / F.lit(float(pixel))).alias("d"))
    return d.groupBy(*keys).agg(rms("d").alias("rdq"))


def rddq(points: DataFrame, pixel: float, keys: tuple[str, ...] = KEYS, cutoff: float | None = None) -> DataFrame:
    """Rms curvature of line scans, second differences; cutoff as in rdq()."""
    points = _smooth(points, pixel, cutoff, keys)
    w = Window.partitionBy(*keys).orderBy("ix")
    d = points.select(*keys, ((F.lead("h").over(w) - 2 * F.col("h") + F.lag("h").over(w)) / F.lit(float(pixel) ** 2)).alias("d"))
    return d.groupBy(*keys).agg(rms("d").alias("rddq"))


def nonuniform(points: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """mean, rq and rdq of nonuniform scans, as integrals of the piecewise-linear profile."""
    s = segments(points, keys)
    agg = s.groupBy(*keys).agg(
        F.sum("dx").alias("l"),
        F.sum(F.expr("dx * (h0 + h1) / 2")).alias("i1"),
        F.sum(F.expr("dx * (h0*h0 + h0*h1 + h1*h1) / 3")).alias("i2"),
        F.sum(F.expr("(h1 - h0) * (h1 - h0) / dx")).alias("g"),
    )
    mean = F.col("i1") / F.col("l")
    return agg.select(*keys, mean.alias("mean"), F.sqrt(F.col("i2") / F.col("l") - mean * mean).alias("rq"), F.sqrt(F.col("g") / F.col("l")).alias("rdq"))


def nonuniform_rddq(points: DataFrame, keys: tuple[str, ...] = KEYS, reentrant: str = "raise") -> DataFrame:
    """Rms curvature of nonuniform scans: trapezoids over the squared second differences of inner points."""
    w = Window.partitionBy(*keys).orderBy("ix")
    p = single_valued(points, reentrant, keys).select(*keys, "ix", "x", "h", *[f(c).over(w).alias(f"{c}{i}") for i, f in ((0, F.lag), (2, F.lead)) for c in ("x", "h")])
    d = p.where("x0 IS NOT NULL AND x2 IS NOT NULL").select(*keys, "ix", "x", F.expr("2 * ((h2 - h) / (x2 - x) - (h - h0) / (x - x0)) / (x2 - x0)").alias("d"))
    t = d.select(*keys, "x", "d", F.lead("x").over(w).alias("xn"), F.lead("d").over(w).alias("dn"))
    return t.groupBy(*keys).agg(F.sqrt(F.sum(F.expr("(d*d + dn*dn) / 2 * (xn - x)")) / F.nullif(F.max("x") - F.min("x"), F.lit(0.0))).alias("rddq"))


def nonuniform_moment(points: DataFrame, order: int, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """Integral of h^order over the profile by its length; a whole order, as a sum that flat pieces don't disturb."""
    piece = " + ".join("*".join(["h0"] * i + ["h1"] * (order - i)) or "1" for i in range(order + 1))
    return segments(points, keys).groupBy(*keys).agg((F.sum(F.expr(f"dx * ({piece}) / {order + 1}D")) / F.sum("dx")).alias("moment"))


def bandwidth(points: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """Mean spacing and length of nonuniform scans."""
    return segments(points, keys).groupBy(*keys).agg(F.avg("dx").alias("lower"), F.sum("dx").alias("upper"))


def bandwidth_uniform(nx: int, sx: float, ny: int | None = None, sy: float | None = None) -> tuple[float, float]:
    """Mean pixel and mean size of uniform scans."""
    return (sx / nx, sx) if ny is None else ((sx / nx + sy / ny) / 2, (sx + sy) / 2)


def is_reentrant(points: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    return segments(points, keys).groupBy(*keys).agg((F.min("dx") <= 0).alias("is_reentrant"))

"""Polynomial trends: fits as sums and closed-form solutions, joined back to the points."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.algebra import cramer, normal_equations

KEYS = ("scan_id",)
MODES = ("center", "height", "slope", "curvature", "median")


def fit(points: DataFrame, basis: list[str], keys: tuple[str, ...], value: str = "h") -> DataFrame:
    """(keys, c0, c1, ...): least squares of the value on SQL expressions of the points' columns; undefined heights are left out."""
    sums, m, b = normal_equations(basis, value)
    agg = points.where(f"{value} IS NOT NULL").groupBy(*keys).agg(*[F.expr(v).alias(k) for k, v in sums.items()])
    return agg.select(*keys, *[F.expr(x).alias(f"c{i}") for i, x in enumerate(cramer(m, b))])


def line_basis(degree: int, n: int) -> list[str]:
    return [*["1D", f"(ix / {n}D)", f"((ix / {n}D) * (ix / {n}D))"][: degree + 1]]


def map_basis(degree: int, nx: int, ny: int, y0: int = 0) -> list[str]:
    x, y = f"(ix / {nx}D)", f"((iy - {y0}) / {ny}D)"
    return ["1D", x, y, f"({x} * {x})", f"({y} * {y})", f"({x} * {y})"][: (1, 3, 6)[degree]]


def coefficients(points: DataFrame, mode: str, n: int, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """(keys, c0, ...) of uniform line scans, x taken as ix / n."""
    if mode == "center":
        return points.groupBy(*keys).agg(F.avg("h").alias("c0"))
    if mode == "median":
        return points.groupBy(*keys).agg(F.expr("percentile(h, 0.5)").alias("c0"))
    if mode == "slope":
        ends = points.groupBy(*keys).agg(F.avg("h").alias("m"), ((F.max_by("h", "ix") - F.min_by("h", "ix")) / F.lit(float(n - 1)) * n).alias("c1"))
        return ends.select(*keys, (F.col("m") - F.col("c1") * F.lit((n - 1) / (2 * n))).alias("c0"), "c1")
    if mode not in MODES:
        raise ValueError(f"mode {mode!r}: none of {MODES}")
    return fit(points, line_basis(1 if mode == "height" else 2, n), keys)


def detrend(points: DataFrame, mode: str, n: int, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """Uniform line scans less their trend. Coefficients are a row a scan."""
    c = coefficients(points, mode, n, keys)
    return subtracted(points, c, line_basis(len(c.columns) - len(keys) - 1, n), keys)


def subtracted(points: DataFrame, c: DataFrame, basis: list[str], keys: tuple[str, ...]) -> DataFrame:
    trend = " + ".join(f"c{i} * {b}" for i, b in enumerate(basis))
    out = points.join(c, list(keys)) if keys else points.crossJoin(F.broadcast(c))  # without keys c is one row
    return out.withColumn("h", F.expr(f"h - ({trend})")).drop(*[f"c{i}" for i in range(len(basis))])


def detrend_map(points: DataFrame, degree: int, nx: int, ny: int, y0: int = 0, keys: tuple[str, ...] = ()) -> DataFrame:
    """Maps less their plane (degree 1) or quadratic surface (2)."""
    basis = map_basis(degree, nx, ny, y0)
    return subtracted(points, fit(points, basis, keys), basis, keys)


def segments(points: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """(keys, ix, x0, h0, x1, h1, dx): the straight pieces of nonuniform scans."""
    w = Window.partitionBy(*keys).orderBy("ix")
    out = points.select(*keys, "ix", F.col("x").alias("x0"), F.col("h").alias("h0"), F.lead("x").over(w).alias("x1"), F.lead("h").over(w).alias("h1"))
    return out.where("x1 IS NOT NULL").withColumn("dx", F.col("x1") - F.col("x0"))


def nonuniform_fit(points: DataFrame, degree: int, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """(keys, c0, ...): the polynomial in x that minimises the integral of the squared residual of the piecewise-linear profile.

    The moments of each piece are exact, by Gauss-Legendre points.
    """
    s = segments(points, keys)
    # Three-point Gauss-Legendre on each piece: exact up to degree five, all that degree two needs.
    nodes = F.array(*[F.struct(F.lit(t).alias("t"), F.lit(w).alias("w")) for t, w in ((0.5 - 0.6**0.5 / 2, 5 / 18), (0.5, 8 / 18), (0.5 + 0.6**0.5 / 2, 5 / 18))])
    at = s.select(*keys, "x0", "h0", "x1", "h1", "dx", F.inline(nodes))
    at = at.select(*keys, (F.col("x0") + F.col("t") * F.col("dx")).alias("x"), (F.col("h0") + F.col("t") * (F.col("h1") - F.col("h0"))).alias("h"), (F.col("w") * F.col("dx")).alias("w"))
    basis = ["1D", "x", "(x * x)"][: degree + 1]
    sums, m, b = normal_equations(basis, "h")
    agg = at.groupBy(*keys).agg(*[F.expr(v.replace("sum(", "sum(w * ", 1)).alias(k) for k, v in sums.items()])
    return agg.select(*keys, *[F.expr(x).alias(f"c{i}") for i, x in enumerate(cramer(m, b))])


NONUNIFORM_MODES = {"mean": 0, "center": 0, "median": 0, "slope": 1, "rms-tilt": 1, "height": 1, "rms-curvature": 2, "curvature": 2}


def nonuniform_coefficients(points: DataFrame, mode: str | int, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """(keys, c0, ...) of the trend in x of nonuniform scans, by mode or by the degree of a fit.

    slope: the mean over the pieces of their slopes, and the mean height as c0, so what is left isn't centred unless x is.
    median: that of the profile between its points, not of the points. Two names of a mode mean the same.
    """
    if isinstance(mode, int):
        return nonuniform_fit(points, mode, keys)
    if mode not in NONUNIFORM_MODES:
        raise ValueError(f"mode {mode!r}: none of {', '.join(NONUNIFORM_MODES)}")
    if mode == "median":
        from .robust import median_mad_nonuniform

        return median_mad_nonuniform(points, keys).select(*keys, F.col("median").alias("c0"))
    if mode not in ("mean", "center", "slope"):
        return nonuniform_fit(points, NONUNIFORM_MODES[mode], keys)
    mean = (F.sum(F.expr("dx * (h0 + h1) / 2")) / F.sum("dx")).alias("c0")
    return segments(points, keys).groupBy(*keys).agg(mean, *([F.avg(F.expr("(h1 - h0) / dx")).alias("c1")] if mode == "slope" else []))


def detrend_nonuniform(points: DataFrame, degree: int | str, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """Nonuniform scans less their trend: a degree, or one of NONUNIFORM_MODES."""
    top = NONUNIFORM_MODES.get(degree, 0) if isinstance(degree, str) else degree
    return subtracted(points, nonuniform_coefficients(points, degree, keys), ["1D", "x", "(x * x)"][: top + 1], keys)


def plane_text(c: DataFrame, digits: int = 4) -> DataFrame:
    """The coefficients as text, for instance `1.0000 + 2.0000 x`."""
    names = [x for x in c.columns if x[0] == "c" and x[1:].isdigit()]
    terms = ["", " x", " y"] if len(names) == 3 else ["", " x"]
    return c.withColumn("plane", F.concat_ws(" + ", *[F.concat(F.format_string(f"%.{digits}f", F.col(n)), F.lit(t)) for n, t in zip(names, terms, strict=False)]))

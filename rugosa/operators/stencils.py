"""Finite differences: shifted copies of a map met on its grid, or row offsets in a line scan."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .guards import defined, reliable_scales, single_valued

# Offset (dx, dy) to weight, by order and direction.
LINE = {1: {0: -1.0, 1: 1.0}, 2: {-1: 1.0, 0: -2.0, 1: 1.0}, 3: {-1: -1.0, 0: 3.0, 1: -3.0, 2: 1.0}}
LINE_CENTRAL = {1: {-1: -0.5, 1: 0.5}, 3: {-2: -0.5, -1: 1.0, 1: -1.0, 2: 0.5}}


def spread(stencil: dict[int, float], scale: float) -> dict[int, float]:
    """The stencil's weights at `scale` pixels instead of one; heights between pixels are taken from the straight line."""
    out: dict[int, float] = {}
    for at, c in stencil.items():
        low = math.floor(at * scale)
        part = at * scale - low
        for i, w in ((low, 1 - part), (low + 1, part)):
            if abs(w) > 1e-12:
                out[i] = out.get(i, 0.0) + c * w
    return out


def line_derivative(points: DataFrame, order: int, pixel: float, scale: float = 1, keys: tuple[str, ...] = ("scan_id",), central: bool = False, periodic_n: int | None = None) -> DataFrame:
    """(keys, ix, d): derivatives of line scans at any multiple of the pixel from one on; points whose stencil leaves a nonperiodic scan are dropped."""
    if scale < 1:
        raise ValueError("scale: a pixel at least is needed")
    stencil = spread((LINE_CENTRAL if central else LINE)[order], scale)
    src = points
    if periodic_n:
        src = points.withColumn("_k", F.explode(F.array(F.lit(-1), F.lit(0), F.lit(1)))).withColumn("ix", F.col("ix") + F.col("_k") * periodic_n).drop("_k")
    w = Window.partitionBy(*keys).orderBy("ix")
    d = None
    for at, c in stencil.items():
        h = F.col("h") if at == 0 else F.lead("h", at).over(w) if at > 0 else F.lag("h", -at).over(w)
        d = F.lit(c) * h if d is None else d + F.lit(c) * h
    out = src.select(*keys, "ix", (d / F.lit((scale * float(pixel)) ** order)).alias("d"))
    return (out.where(F.col("ix").between(0, periodic_n - 1)) if periodic_n else out).where("d IS NOT NULL")


def map_derivative(points: DataFrame, order: int, pixel: tuple[float, float], nx: int, ny: int, y0: int = 0, scale: float = 1, keys: tuple[str, ...] = (), periodic: bool = False) -> DataFrame:
    """(keys, ix, iy, dx, dy): both derivatives of maps, at any multiple of the pixels from one on, where both stencils fit.

    Rows of the map are windows along each axis in turn; a nonperiodic map loses the edge that the square stencils
    need on both axes. Undefined pixels make the derivatives that use them undefined.
    """
    if scale < 1:
        raise ValueError("scale: a pixel at least is needed")
    stencil = spread(LINE[order], scale)
    src = points
    if periodic:
        shift = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in ((0, 0), (-1, 0), (1, 0), (0, -1), (0, 1))]))
        src = points.withColumn("_s", shift).withColumns({"ix": F.col("ix") + F.col("_s.a") * nx, "iy": F.col("iy") + F.col("_s.b") * ny}).drop("_s")
    out = src
    for axis, other, name, p in (("ix", "iy", "dx", pixel[0]), ("iy", "ix", "dy", pixel[1])):
        # A range frame of one pixel, so that missing pixels aren't skipped over.
        w = Window.partitionBy(*keys, other).orderBy(axis)
        d = None
        for at, c in stencil.items():
            h = F.col("h") if at == 0 else F.max("h").over(w.rangeBetween(at, at))
            d = F.lit(c) * h if d is None else d + F.lit(c) * h
        out = out.withColumn(name, d / F.lit((scale * float(p)) ** order))
    low, high = -min(0, *stencil), max(0, *stencil)
    if periodic:
        inside = F.col("ix").between(0, nx - 1) & F.col("iy").between(y0, y0 + ny - 1)
    else:
        inside = F.col("ix").between(low, nx - 1 - high) & F.col("iy").between(y0 + low, y0 + ny - 1 - high)
    return out.where(inside).select(*keys, "ix", "iy", "dx", "dy")


def rms_gradient(points: DataFrame, pixel: tuple[float, float], nx: int, ny: int, y0: int = 0, keys: tuple[str, ...] = ()) -> DataFrame:
    d = map_derivative(points, 1, pixel, nx, ny, y0, keys=keys)
    return d.groupBy(*keys).agg(F.sqrt(F.avg(F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy"))).alias("rms_gradient"))


def rms_laplacian(points: DataFrame, pixel: tuple[float, float], nx: int, ny: int, y0: int = 0, keys: tuple[str, ...] = ()) -> DataFrame:
    """The rms Laplacian and half of it, the rms curvature."""
    d = map_derivative(points, 2, pixel, nx, ny, y0, keys=keys)
    lap = F.sqrt(F.avg(F.pow(F.col("dx") + F.col("dy"), 2)))
    return d.groupBy(*keys).agg(lap.alias("rms_laplacian"), (lap / 2).alias("rms_curvature"))


def nonuniform_derivative(points: DataFrame, keys: tuple[str, ...] = ("scan_id",), reentrant: str = "raise") -> DataFrame:
    """(keys, ix, d1, d2): differences of nonuniform scans to the next point and about the point."""
    w = Window.partitionBy(*keys).orderBy("ix")
    p = single_valued(points, reentrant, keys).select(*keys, "ix", "x", "h", *[f(c).over(w).alias(f"{c}{i}") for i, f in ((0, F.lag), (2, F.lead)) for c in ("x", "h")])
    return p.select(*keys, "ix", F.expr("(h2 - h) / (x2 - x)").alias("d1"), F.expr("2 * ((h2 - h) / (x2 - x) - (h - h0) / (x - x0)) / (x2 - x0)").alias("d2"))


def nonuniform_derivative_over(points: DataFrame, distance: float, order: int = 1, keys: tuple[str, ...] = ("scan_id",), reentrant: str = "raise") -> DataFrame:
    """(keys, ix, x, d): differences of nonuniform scans over a given distance, from each of their points, divided by its power.

    Heights between points are taken from the straight pieces; points whose stencil leaves the scan are dropped.
    """
    from .transforms import interpolated

    points = single_valued(points, reentrant, keys)
    whole = Window.partitionBy(*keys)
    rows = points.select(*keys, "ix", F.col("x").alias("_x"), F.min("x").over(whole).alias("_a"), F.max("x").over(whole).alias("_b"))
    stencil = LINE[order]
    weights = F.explode(F.array(*[F.struct(F.lit(float(at)).alias("at"), F.lit(c).alias("c")) for at, c in stencil.items()])).alias("o")
    rows = rows.where(F.col("_x") + min(0, *stencil) * F.lit(float(distance)) >= F.col("_a")).where(F.col("_x") + max(0, *stencil) * F.lit(float(distance)) <= F.col("_b"))
    at = rows.select(*keys, "ix", "_x", weights).select(*keys, "ix", "_x", F.col("o.c").alias("_c"), (F.col("_x") + F.col("o.at") * F.lit(float(distance))).alias("x"))
    found = interpolated(points.select(*keys, "x", "h"), at, keys)
    return found.groupBy(*keys, "ix").agg(F.first("_x").alias("x"), (F.sum(F.col("_c") * F.col("h")) / F.lit(float(distance) ** order)).alias("d"))


def scale_dependent(points: DataFrame, scales: list[int], pixel: float, order: int = 1, keys: tuple[str, ...] = ("scan_id",), func=None, threshold: int = 4, undefined: str = "skip", reliable: DataFrame | None = None) -> DataFrame:
    """(keys, distance, value): func (a Column builder; the variance if none) of derivatives at distances order * scale * pixel.

    The scan is an array once; each scale reads it by position, so all scales share one shuffle. Fewer than `threshold`
    derivatives at a scale give null. reliable: rows (keys, cutoff); only distances over order / 2 of it stay then.
    """
    func = func or (lambda d: F.var_pop(d))
    arrays = defined(points, undefined, keys).groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("ix", "h"))), lambda p: p["h"]).alias("a"))
    s = arrays.withColumn("s", F.explode(F.array(*map(F.lit, scales)))).withColumn("n", F.size("a"))
    stencil = LINE[order]
    low, high = -min(stencil), max(stencil)
    i = F.sequence(F.col("s") * low + 1, F.col("n") - F.col("s") * high)
    s = s.where(F.col("n") > F.col("s") * (low + high)).select(*keys, "s", F.transform(i, lambda k: sum((F.lit(c) * F.element_at("a", (k + F.col("s") * at).cast("int")) for at, c in stencil.items()), F.lit(0.0))).alias("d"))
    d = s.select(*keys, "s", F.explode("d").alias("d")).withColumn("d", F.col("d") / F.pow(F.col("s") * F.lit(float(pixel)), order))
    value = d.groupBy(*keys, "s").agg(F.when(F.count("d") >= threshold, func(F.col("d"))).alias("value")).select(*keys, (F.col("s") * F.lit(float(pixel) * order)).alias("distance"), "value")
    return reliable_scales(value, reliable, order, keys)

"""Transformations of points: DataFrame in, DataFrame out. Undefined heights are null."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.algebra import cramer, normal_equations
from .guards import single_valued

KEYS = ("scan_id",)


def mask_nonfinite(points: DataFrame) -> DataFrame:
    """NaN and infinite heights become undefined."""
    return points.withColumn("h", F.when(F.isnan("h") | (F.abs("h") == float("inf")), None).otherwise(F.col("h")))


def with_positions(points: DataFrame, nx: int, sx: float, ny: int | None = None, sy: float | None = None) -> DataFrame:
    """x = ix sx / nx, and y alike for maps."""
    out = points.withColumn("x", F.col("ix") * F.lit(float(sx)) / F.lit(nx))
    return out if ny is None else out.withColumn("y", F.col("iy") * F.lit(float(sy)) / F.lit(ny))


def scale(points: DataFrame, heights: float, positions: float = 1.0) -> DataFrame:
    cols = {"h": F.col("h") * F.lit(float(heights))}
    return points.withColumns(cols | {c: F.col(c) * F.lit(float(positions)) for c in ("x", "y") if c in points.columns})


def transpose(points: DataFrame) -> DataFrame:
    swap = {"ix": "iy", "iy": "ix", "x": "y", "y": "x"}
    return points.select(*[F.col(swap.get(c, c)).alias(c) if swap.get(c, c) in points.columns else F.col(c) for c in points.columns])


def translate(points: DataFrame, nx: int, ny: int | None = None, offset: tuple[int, int] = (0, 0), periodic: bool = True) -> DataFrame:
    """Rolls a periodic surface by whole pixels."""
    if not periodic:
        raise ValueError("Only periodic surfaces can be translated.")
    out = points.withColumn("ix", F.pmod(F.col("ix") + offset[0], F.lit(nx)).cast("int"))
    return out if ny is None else out.withColumn("iy", F.pmod(F.col("iy") + offset[1], F.lit(ny)).cast("int"))


def superpose(a: DataFrame, b: DataFrame, keys: tuple[str, ...] = ("ix", "iy")) -> DataFrame:
    """Sum of two surfaces on one grid; undefined where either is."""
    return a.join(b.select(*keys, F.col("h").alias("_other")), list(keys)).withColumn("h", F.col("h") + F.col("_other")).drop("_other")


def plastic_area(displacements: DataFrame, area: float, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """Area of the pixels whose plastic displacement isn't zero."""
    return displacements.groupBy(*keys).agg((F.count_if(F.col("h") != 0) * F.lit(area)).alias("plastic_area"))


def mirror_stitch(points: DataFrame, nx: int, ny: int) -> DataFrame:
    """2nx x 2ny: the map and its mirror images, which together are periodic."""
    image = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (0, 1) for b in (0, 1)]))
    out = points.withColumn("_m", image)
    out = out.withColumns({"ix": F.when(F.col("_m.a") == 0, F.col("ix")).otherwise(2 * nx - 1 - F.col("ix")), "iy": F.when(F.col("_m.b") == 0, F.col("iy")).otherwise(2 * ny - 1 - F.col("iy"))})
    return out.drop("_m")


def fill_undefined(points: DataFrame, value: float) -> DataFrame:
    return points.withColumn("h", F.coalesce("h", F.lit(float(value))))


def complete_grid(points: DataFrame, nx: int, y_low: int, y_high: int) -> DataFrame:
    """A map's every pixel, undefined where points have none."""
    grid = points.sparkSession.range(nx * (y_high - y_low + 1)).select(F.expr(f"cast(id div {y_high - y_low + 1} as int)").alias("ix"), (F.col("id") % (y_high - y_low + 1) + y_low).cast("int").alias("iy"))
    return grid.join(points, ["ix", "iy"], "left")


def downsample(points: DataFrame, factor: tuple[int, int], nx: int, ny: int, mode: str = "nth", keys: tuple[str, ...] = ()) -> DataFrame:
    """Every factor-th pixel, or the mean of each whole block; an incomplete edge is dropped."""
    fx, fy = factor
    inside = points.where((F.col("ix") < nx // fx * fx) & (F.col("iy") < ny // fy * fy))
    cell = [*keys, F.expr(f"cast(ix div {fx} as int)").alias("ix"), F.expr(f"cast(iy div {fy} as int)").alias("iy")]
    if mode == "nth":
        return inside.where((F.col("ix") % fx == 0) & (F.col("iy") % fy == 0)).select(*cell, "h")
    if mode != "average":
        raise ValueError(f"mode {mode!r}: neither nth nor average")
    return inside.groupBy(*cell).agg(F.avg("h").alias("h"))


def hann(ix: Column, n: int) -> Column:
    """Periodic Hann taper whose mean square is one."""
    return (F.lit(0.5) - F.lit(0.5) * F.cos(ix * F.lit(6.283185307179586 / n))) * F.lit((8 / 3) ** 0.5)


def window(points: DataFrame, n: int, periodic: bool = False) -> DataFrame:
    """Line scans times the Hann taper; periodic ones stay as they are."""
    return points if periodic else points.withColumn("h", F.col("h") * hann(F.col("ix"), n))


def radial_hann(points: DataFrame, nx: int, ny: int, sx: float, sy: float) -> DataFrame:
    """Maps times the radial Hann taper about the middle, normalised over the grid."""
    import math

    def w(i: int, j: int) -> float:
        r = math.hypot((i - nx // 2) * sx / nx, (j - ny // 2) * sy / ny)
        top = min(sx, sy) / 2
        return 0.5 + 0.5 * math.cos(math.pi * r / top) if r < top else 0.0

    norm = math.sqrt(nx * ny / sum(w(i, j) ** 2 for i in range(nx) for j in range(ny)))
    r = F.sqrt(F.pow((F.col("ix") - nx // 2) * F.lit(sx / nx), 2) + F.pow((F.col("iy") - ny // 2) * F.lit(sy / ny), 2))
    top = min(sx, sy) / 2
    return points.withColumn("h", F.col("h") * F.when(r < top, (F.lit(0.5) + F.lit(0.5) * F.cos(r * F.lit(math.pi / top))) * F.lit(norm)).otherwise(F.lit(0.0)))


def to_uniform(points: DataFrame, n: int | DataFrame, keys: tuple[str, ...] = KEYS, reentrant: str = "raise") -> DataFrame:
    """Nonuniform scans on n equal steps from first to last x, by straight lines between neighbours; n may be rows (keys, n).

    Grid positions and points are sorted together once for each scan: the last point at or before a position and the
    first at or after it are window functions, so no range join is needed. reentrant: what overhangs do, as guards.single_valued says.
    """
    k = list(keys)
    points = single_valued(points, reentrant, keys)
    ends = points.groupBy(*k).agg(F.min("x").alias("x0"), F.max("x").alias("x1"))
    ends = ends.withColumn("n", F.lit(n)) if isinstance(n, int) else ends.join(n.select(*k, "n"), k)
    grid = ends.select(*k, F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("ix"), "x0", "x1", "n").select(*k, "ix", (F.col("x0") + F.col("ix") * (F.col("x1") - F.col("x0")) / F.greatest(F.col("n") - 1, F.lit(1)).cast("double")).alias("g"))
    return interpolated(points, grid.select(*k, "ix", F.col("g").alias("x")), keys)


def interpolated(points: DataFrame, at: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """(at's columns, h): heights of nonuniform scans at the positions x of at's rows (keys, x, ...), by straight lines; before the first point and after the last theirs.

    Positions and points are sorted together once for each scan, so no range join is needed. Scans must not be reentrant.
    """
    more = [c for c in at.columns if c not in (*keys, "x")]
    asked = at.select(*keys, F.struct(*more, F.lit(1).alias("_asked")).alias("_row"), F.col("x").alias("g"), F.lit(None).cast("double").alias("h"))
    both = points.select(*keys, F.lit(None).cast(asked.schema["_row"].dataType).alias("_row"), F.col("x").alias("g"), "h").unionByName(asked)
    order = Window.partitionBy(*keys).orderBy("g", F.col("_row").isNotNull())
    back = Window.partitionBy(*keys).orderBy(F.desc("g"), F.col("_row").isNotNull())
    knot = F.when(F.col("_row").isNull(), F.struct("g", "h"))
    both = both.withColumn("a", F.last(knot, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))).withColumn("b", F.last(knot, ignorenulls=True).over(back.rowsBetween(Window.unboundedPreceding, 0)))
    a, b = F.coalesce("a", "b"), F.coalesce("b", "a")
    line = F.when(b["g"] > a["g"], a["h"] + (b["h"] - a["h"]) * (F.col("g") - a["g"]) / F.nullif(b["g"] - a["g"], F.lit(0.0))).otherwise(a["h"])
    return both.where("_row IS NOT NULL").select(*keys, *(F.col(f"_row.{c}").alias(c) for c in more), F.col("g").alias("x"), line.alias("h"))


def interpolated_cubic(points: DataFrame, at: DataFrame, keys: tuple[str, ...] = KEYS, reentrant: str = "raise") -> DataFrame:
    """(at's columns, h): heights of nonuniform scans at the positions x of at's rows, by cubic splines whose third derivative has no jump at the second and last but one point.

    The curvatures at the points are found a scan at a time; positions then meet the points by sorting both together.
    Positions outside the scan are null, and so are all of scans with fewer than four points or with undefined heights.
    """
    from . import batches, kernels

    def bends(table, starts):
        x, h = table.column("x").to_numpy(), table.column("h").to_numpy()
        parts = list(zip(np.split(x, starts[1:]), np.split(h, starts[1:]), strict=True))
        yield np.repeat(np.arange(len(parts)), [len(a) for a, _ in parts]), {"x": x, "h": h, "bend": np.concatenate([kernels.spline_curvatures(a, b) for a, b in parts])}

    known = single_valued(points, reentrant, keys).select(*keys, "ix", F.col("x").cast("double").alias("x"), F.col("h").cast("double").alias("h"))
    known = batches.by_line(known, keys, "x double, h double, bend double", bends, "ix")
    more = [c for c in at.columns if c not in (*keys, "x")]
    asked = at.select(*keys, F.struct(*more, F.lit(1).alias("_asked")).alias("_row"), F.col("x").cast("double").alias("x"), F.lit(None).cast("double").alias("h"), F.lit(None).cast("double").alias("bend"))
    both = known.select(*keys, F.lit(None).cast(asked.schema["_row"].dataType).alias("_row"), "x", "h", "bend").unionByName(asked)
    order = Window.partitionBy(*keys).orderBy("x", F.col("_row").isNotNull())
    back = Window.partitionBy(*keys).orderBy(F.desc("x"), F.col("_row").isNotNull())
    knot = F.when(F.col("_row").isNull(), F.struct("x", "h", "bend"))
    both = both.withColumn("a", F.last(knot, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))).withColumn("b", F.last(knot, ignorenulls=True).over(back.rowsBetween(Window.unboundedPreceding, 0)))
    curve = "((b.x - x) * a.h + (x - a.x) * b.h) / (b.x - a.x) - (x - a.x) * (b.x - x) / 6 * ((1 + (b.x - x) / (b.x - a.x)) * a.bend + (1 + (x - a.x) / (b.x - a.x)) * b.bend)"
    value = F.expr(f"CASE WHEN a.x IS NULL OR b.x IS NULL OR a.bend IS NULL OR isnan(a.bend) THEN NULL WHEN b.x > a.x THEN {curve} ELSE a.h END")
    return both.where("_row IS NOT NULL").select(*keys, *(F.col(f"_row.{c}").alias(c) for c in more), "x", value.alias("h"))


def interpolate_undefined_line(points: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """Holes of line scans filled by straight lines between their ends (harmonic in one dimension); holes at an end get that end's height."""
    up = Window.partitionBy(*keys).orderBy("ix")
    at = F.when(F.col("h").isNotNull(), F.struct("ix", "h"))
    a = F.last(at, ignorenulls=True).over(up.rowsBetween(Window.unboundedPreceding, 0))
    b = F.first(at, ignorenulls=True).over(up.rowsBetween(0, Window.unboundedFollowing))
    out = points.withColumn("_a", F.coalesce(a, b)).withColumn("_b", F.coalesce(b, a))
    line = F.col("_a.h") + (F.col("_b.h") - F.col("_a.h")) * (F.col("ix") - F.col("_a.ix")) / F.nullif(F.col("_b.ix") - F.col("_a.ix"), F.lit(0))
    return out.withColumn("h", F.coalesce("h", line, F.col("_a.h"))).drop("_a", "_b")


def scan_with_sphere(points: DataFrame, radius: float, pixel: float, keys: tuple[str, ...] = KEYS, periodic_n: int | None = None) -> DataFrame:
    """Line scans as a sphere of this radius traces them: max over |dx| < R of h + sqrt(R^2 - dx^2) - R.

    The points within reach of one are an array of a row frame, so each scan is sorted once; a periodic
    scan of periodic_n points is wrapped by copies of its ends.
    """
    import math

    reach = math.ceil(radius / pixel) - 1
    src = points
    if periodic_n:
        reach_n = -(-reach // periodic_n)
        src = points.withColumn("_k", F.explode(F.sequence(F.lit(-reach_n), F.lit(reach_n)))).withColumn("ix", F.col("ix") + F.col("_k") * periodic_n).drop("_k")
    near = F.collect_list(F.struct("ix", "h")).over(Window.partitionBy(*keys).orderBy("ix").rangeBetween(-reach, reach))

    def top(ix: Column) -> Column:
        return lambda p: p["h"] + F.sqrt(F.lit(radius * radius) - F.pow((p["ix"] - ix) * F.lit(float(pixel)), 2)) - F.lit(float(radius))

    out = src.withColumn("_n", near)
    out = out.withColumn("h", F.array_max(F.transform("_n", top(F.col("ix"))))).drop("_n")
    return out.where(F.col("ix").between(0, periodic_n - 1)) if periodic_n else out


def scan_with_sphere_nonuniform(points: DataFrame, radius: float, keys: tuple[str, ...] = KEYS, reentrant: str = "raise") -> DataFrame:
    """Nonuniform scans as a sphere of this radius traces them at their own points: max over -R <= dx < R of h + sqrt(R^2 - dx^2) - R.

    The points within reach of one are an array of a range frame over x, so each scan is sorted once.
    """
    of = f"PARTITION BY {', '.join(f'`{k}`' for k in keys)}" if keys else ""
    out = single_valued(points, reentrant, keys).withColumn("_n", F.expr(f"collect_list(struct(x, h)) OVER ({of} ORDER BY x RANGE BETWEEN {float(radius)!r}D PRECEDING AND {float(radius)!r}D FOLLOWING)"))
    near = F.filter("_n", lambda p: (p["x"] - F.col("x") < radius) & p["h"].isNotNull())
    dx2 = lambda p: F.pow(p["x"] - F.col("x"), 2)
    top = F.transform(near, lambda p: p["h"] + F.sqrt(F.greatest(F.lit(float(radius) ** 2) - dx2(p), F.lit(0.0))) - F.lit(float(radius)))
    return out.withColumn("h", F.array_max(top)).drop("_n")


def align_lines(points: DataFrame, ny: int, degree: int = 1, mode: str = "median", keys: tuple[str, ...] = (), direction: str = "x") -> DataFrame:
    """Scan lines without their own polynomial, then brought to one centre.

    direction: "x" for lines along iy at one ix, "y" for lines along ix at one iy; ny is the number of a line's points.
    The offsets between neighbouring lines' centres, summed from line to line and less their mean, are the
    lines' mean centre less their own. t = iy / ny along a line; the centre is the median or the mean. A line with too
    few defined points for the degree takes the highest one that they determine; one without any stays as it is.
    """
    if mode not in ("median", "mean"):
        raise ValueError(f"mode {mode!r}: neither median nor mean")
    if direction not in ("x", "y"):
        raise ValueError(f"direction {direction!r}: neither x nor y")
    if degree < 0:
        raise ValueError("degree: negative")
    line, along = ("ix", "iy") if direction == "x" else ("iy", "ix")
    k, t = [*keys, line], f"({along} / {float(ny)!r}D)"
    powers = [" * ".join([t] * i) or "1D" for i in range(degree + 1)]
    sums, m, b = normal_equations(powers, "h")
    fits = [cramer([r[: d + 1] for r in m[: d + 1]], b[: d + 1]) for d in range(degree + 1)]
    c = [f"CASE {' '.join(f'WHEN _n > {d} THEN ' + (fits[d][i] if i <= d else '0D') for d in range(degree, -1, -1))} ELSE 0D END AS _c{i}" for i in range(degree + 1)]
    fit = points.where("h IS NOT NULL").groupBy(*k).agg(F.count("h").alias("_n"), *[F.expr(v).alias(n) for n, v in sums.items()]).selectExpr(*k, *c)
    trend = " + ".join(f"coalesce(_c{i}, 0D) * {x}" for i, x in enumerate(powers))
    out = points.join(fit, k, "left").withColumn("h", F.expr(f"h - ({trend})")).drop(*[f"_c{i}" for i in range(degree + 1)])
    centre = out.groupBy(*k).agg((F.expr("percentile(h, 0.5)") if mode == "median" else F.avg("h")).alias("_c"))
    mean = centre.groupBy(*keys).agg(F.avg("_c").alias("_m"))
    offset = centre.join(mean, list(keys)) if keys else centre.crossJoin(F.broadcast(mean))  # one row
    return out.join(offset.select(*k, (F.col("_m") - F.col("_c")).alias("_o")), k).withColumn("h", F.col("h") + F.col("_o")).drop("_o")


def union(*surfaces: DataFrame) -> DataFrame:
    """Measurements put together into a container."""
    out = surfaces[0]
    for s in surfaces[1:]:
        out = out.unionByName(s)
    return out


def equal(a: DataFrame, b: DataFrame, keys: tuple[str, ...] = ("scan_id", "ix"), rtol: float = 1e-5, atol: float = 1e-8) -> DataFrame:
    """One row, `equal`: whether both have the same points and heights within the tolerances."""
    both = a.select(*keys, F.col("h").alias("p"), F.lit(1).alias("ia")).join(b.select(*keys, F.col("h").alias("q"), F.lit(1).alias("ib")), list(keys), "full")
    near = F.col("ia").isNotNull() & F.col("ib").isNotNull() & F.coalesce(F.abs(F.col("p") - F.col("q")) <= atol + rtol * F.abs("q"), F.col("p").isNull() & F.col("q").isNull())
    return both.agg(F.coalesce(F.bool_and(near), F.lit(True)).alias("equal"))


def to_nonuniform(points: DataFrame, pixel: float, periodic: bool = False) -> DataFrame:
    """Line scans as nonuniform ones: each point with its position x. A periodic scan has no end and can't be one."""
    if periodic:
        raise ValueError("a periodic scan can't be made nonuniform")
    return points.withColumn("x", F.col("ix") * F.lit(float(pixel)))

"""Power spectra, autocorrelation and what derives from them."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import fourier
from .guards import cutoffs_of, defined, kept, reliable_autocorrelation, reliable_spectrum, single_valued

KEYS = ("scan_id",)


def power_spectrum(points: DataFrame, n: int, size: float, tapered: bool = True, keys: tuple[str, ...] = KEYS, undefined: str = "raise", reliable: DataFrame | None = None) -> DataFrame:
    """(keys, k, q, psd): one-dimensional power spectra of line scans of n points, positive wavevectors up to before Nyquist's, that at zero halved.

    undefined: what scans with undefined heights do, as guards.defined says. reliable: rows (keys, cutoff), as
    reliability.short_cutoffs makes them; only wavevectors below 2 pi / cutoff stay then.
    """
    power = fourier.power_line(defined(points, undefined, keys), keys, tapered)
    c = F.col("power") * F.lit(size / n / n)
    psd = power.select(*keys, "k", (F.col("k") * F.lit(2 * math.pi / size)).alias("q"), F.when(F.col("k") == 0, c / 2).otherwise(c).alias("psd"))
    return reliable_spectrum(psd, reliable, keys)


def spectrum_area(points: DataFrame, nx: int, ny: int, sx: float, sy: float, keys: tuple[str, ...] = KEYS, undefined: str = "raise") -> DataFrame:
    """(keys, kx, ky, qx, qy, psd): two-dimensional spectra of maps, all wavevectors, each as the shorter of it and its mirror."""
    b = fourier.power_area(defined(points, undefined, keys), nx, ny, keys)
    q = lambda k, n, size: F.least(F.col(k), n - F.col(k)) * F.lit(2 * math.pi / size)
    return b.select(*keys, "kx", "ky", q("kx", nx, sx).alias("qx"), q("ky", ny, sy).alias("qy"), (F.col("power") * F.lit(sx * sy / (nx * ny) ** 2)).alias("psd"))


def power_spectrum_area(points: DataFrame, nx: int, ny: int, sx: float, sy: float, edges: list[float] | None = None, tapered: bool = True, keys: tuple[str, ...] = KEYS, undefined: str = "raise", per_decade: int = 10, reliable: DataFrame | None = None) -> DataFrame:
    """(keys, bin, x, y, var, n): spectra of maps averaged over bins of the wavevector's length.

    tapered: times the radial Hann window. edges: of the bins; by default spaced evenly in the logarithm from the
    smallest wavevector to Nyquist's along x. reliable: rows (keys, cutoff); wavevectors from 2 pi / cutoff on are left out.
    """
    from .transforms import radial_hann

    edges = edges or grid_edges("log", 2 * math.pi / min(sx, sy), math.pi * nx / sx, per_decade=per_decade)
    c = spectrum_area(radial_hann(points, nx, ny, sx, sy) if tapered else points, nx, ny, sx, sy, keys, undefined)
    c = c.withColumn("_q", F.sqrt(F.col("qx") * F.col("qx") + F.col("qy") * F.col("qy")))
    return bin_average(kept(c, reliable, F.col("_q") < F.lit(2 * math.pi) / F.col("cutoff"), 2, keys), "_q", "psd", edges, keys)


def psd_area(points: DataFrame, nx: int, ny: int, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """(keys, r2, n, psd): spectra of nx x ny maps of unit pixels, averaged over wavevectors of one integer length squared (nx = ny)."""
    m = lambda c, n: F.least(F.col(c), n - F.col(c))
    r2 = (m("kx", nx) * m("kx", nx) + m("ky", ny) * m("ky", ny)).alias("r2")
    return spectrum_area(points, nx, ny, float(nx), float(ny), keys).groupBy(*keys, r2).agg(F.count("*").alias("n"), F.avg("psd").alias("psd"))


def integrate_psd_area(spectrum: DataFrame, sx: float, sy: float, factor: str = "1D", keys: tuple[str, ...] = KEYS) -> DataFrame:
    """Sum of a two-dimensional spectrum times factor(qx, qy) (SQL text) by the area."""
    return spectrum.groupBy(*keys).agg((F.sum(F.col("psd") * F.expr(factor)) / F.lit(float(sx * sy))).alias("integral"))


def radial(values: DataFrame, nx: int, ny: int, sx: float, sy: float, edges: list[float], keys: tuple[str, ...] = KEYS, value: str = "h", wrapped: bool = True) -> DataFrame:
    """(keys, bin, x, y, var, n): values of a grid (ix, iy) averaged over bins of their distance from the corner, the shorter way round if wrapped."""
    at = lambda c, n, s: (F.least(F.col(c), n - F.col(c)) if wrapped else F.col(c)) * F.lit(s / n)
    x, y = at("ix", nx, sx), at("iy", ny, sy)
    return bin_average(values.withColumn("_r", F.sqrt(x * x + y * y)), "_r", value, edges, keys)


def psd_nonuniform(points: DataFrame, wavevectors_: list[float], keys: tuple[str, ...] = KEYS, reentrant: str = "raise", reliable: DataFrame | bool | None = None) -> DataFrame:
    """(keys, q, psd): the exact Fourier integral of the piecewise-linear profile, squared, by its length. reliable: as guards.cutoffs_of says."""
    from .detrend import segments

    s = segments(single_valued(points, reentrant, keys), keys).withColumn("q", F.explode(F.array(*map(F.lit, map(float, wavevectors_)))))
    z = F.expr("q * dx / 2")
    sinc = F.when(F.abs(z) < 1e-6, 1 - z * z / 6).otherwise(F.sin(z) / z)
    dsinc = F.when(F.abs(z) < 1e-3, -z / 3 + z * z * z / 30).otherwise((F.cos(z) - F.sin(z) / z) / z)
    s = s.select(*keys, "q", "dx", F.expr("(x0 + x1) / 2").alias("xm"), (F.col("dx") * F.expr("(h0 + h1) / 2") * sinc).alias("a"), (F.col("dx") * F.expr("(h1 - h0) / 2") * dsinc).alias("b"))
    cos, sin = F.cos(F.expr("q * xm")), F.sin(F.expr("q * xm"))
    agg = s.groupBy(*keys, "q").agg(F.sum("dx").alias("l"), F.sum(F.col("a") * cos + F.col("b") * sin).alias("re"), F.sum(F.col("b") * cos - F.col("a") * sin).alias("im"))
    return reliable_spectrum(agg.select(*keys, "q", F.expr("(re * re + im * im) / l").alias("psd")), cutoffs_of(points, reliable, keys), keys)


def autocorrelation(points: DataFrame, pixel: float, keys: tuple[str, ...] = KEYS, undefined: str = "raise", reliable: DataFrame | None = None) -> DataFrame:
    """(keys, k, r, acf): half the mean squared height difference at each distance of nonperiodic line scans, by transforms.

    undefined: 'raise' or 'drop' as guards.defined says; 'skip': means over the pairs whose heights are both
    defined, null where there is none. reliable: rows (keys, cutoff); only distances over half of it stay then.
    """
    c = fourier.correlation_line(defined(points, undefined, keys), keys, strict=undefined != "skip")
    return reliable_autocorrelation(c.select(*keys, "k", (F.col("k") * F.lit(float(pixel))).alias("r"), _half_mean().alias("acf")), reliable, keys)


def autocorrelation_periodic(points: DataFrame, pixel: float, n: int, keys: tuple[str, ...] = KEYS, undefined: str = "raise") -> DataFrame:
    """The same for periodic scans of n points, at lags below n / 2."""
    c = fourier.correlation_line(defined(points, undefined, keys), keys, True, undefined != "skip").where(F.col("k") < n // 2)
    return c.select(*keys, "k", (F.col("k") * F.lit(float(pixel))).alias("r"), _half_mean().alias("acf"))


def autocorrelation_map(points: DataFrame, nx: int, ny: int, keys: tuple[str, ...] = KEYS, periodic: bool = False, undefined: str = "raise") -> DataFrame:
    """(keys, a, b, acf): of maps at each lag (a, b)."""
    c = fourier.correlation_area(defined(points, undefined, keys), nx, ny, keys, periodic, undefined != "skip")
    return c.select(*keys, "a", "b", _half_mean().alias("acf"))


def autocorrelation_area(points: DataFrame, nx: int, ny: int, keys: tuple[str, ...] = KEYS, undefined: str = "raise") -> DataFrame:
    """(keys, r2, n, acf): nonperiodic maps of unit pixels, averaged over lags of one integer length squared."""
    lag = autocorrelation_map(points, nx, ny, keys, undefined=undefined)
    return lag.groupBy(*keys, F.expr("a * a + b * b").alias("r2")).agg(F.count("*").alias("n"), F.avg("acf").alias("acf"))


def autocorrelation_rings(points: DataFrame, nx: int, ny: int, sx: float, sy: float, width: float | None = None, keys: tuple[str, ...] = KEYS, periodic: bool = False, undefined: str = "raise", reliable: DataFrame | None = None) -> DataFrame:
    """(keys, k, r, n, acf): of maps of sizes sx and sy, averaged over the lags whose length is nearest to r = k * width.

    width: the smaller side of a pixel, unless given. Lags of periodic maps are taken the shorter way round; those
    without a pair of defined heights don't count, and rings without lags have no row. reliable: as in autocorrelation.
    """
    width = width or min(sx / nx, sy / ny)
    lag = autocorrelation_map(points, nx, ny, keys, periodic, undefined).where("acf IS NOT NULL")
    side = lambda c, n, s: (F.least(F.col(c), n - F.col(c)) if periodic else F.col(c)) * F.lit(s / n)
    x, y = side("a", nx, sx), side("b", ny, sy)
    k = F.floor(F.sqrt(x * x + y * y) / F.lit(float(width)) + 0.5).cast("int")
    each = lag.groupBy(*keys, k.alias("k")).agg(F.count("*").alias("n"), F.avg("acf").alias("acf"))
    return reliable_autocorrelation(each.select(*keys, "k", (F.col("k") * F.lit(float(width))).alias("r"), "n", "acf"), reliable, keys)


def _half_mean() -> Column:
    return F.col("s") / F.nullif(F.col("n"), F.lit(0)) / 2


def resampled(points: DataFrame, factor: int = 5, n: int | None = None, keys: tuple[str, ...] = KEYS, reentrant: str = "raise") -> DataFrame:
    """(keys, ix, x, h): nonuniform scans on an even grid of n points, or of `factor` for each of the scan's smallest distances between neighbours."""
    from .detrend import segments
    from .transforms import to_uniform

    points = single_valued(points, reentrant, keys)
    if n is not None:
        return to_uniform(points, n, keys, "skip")
    s = segments(points, keys).groupBy(*keys).agg((F.greatest(F.floor(F.sum("dx") / F.min("dx")), F.lit(1)) * factor).cast("int").alias("n"))
    return to_uniform(points, s, keys, "skip")


def _spans(grid: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """(keys, size): the distance from the first point to the last."""
    return grid.groupBy(*keys).agg((F.max("x") - F.min("x")).alias("size"))


def power_spectrum_nonuniform(points: DataFrame, factor: int = 5, n: int | None = None, tapered: bool = True, keys: tuple[str, ...] = KEYS, reentrant: str = "raise", reliable: DataFrame | bool | None = None) -> DataFrame:
    """(keys, k, q, psd): spectra of nonuniform scans over all wavevectors of an even grid, by transforms; wavevector zero halved. See resampled() and guards.cutoffs_of()."""
    grid = resampled(points, factor, n, keys, reentrant)
    c = fourier.power_line(grid, keys, tapered).join(_spans(grid, keys), list(keys))
    psd = F.col("power") * F.col("size") / F.col("n") / F.col("n")
    c = c.select(*keys, "k", (F.col("k") * F.lit(2 * math.pi) / F.col("size")).alias("q"), F.when(F.col("k") == 0, psd / 2).otherwise(psd).alias("psd"))
    return reliable_spectrum(c, cutoffs_of(points, reliable, keys), keys)


def autocorrelation_grid(points: DataFrame, factor: int = 5, n: int | None = None, keys: tuple[str, ...] = KEYS, reentrant: str = "raise", reliable: DataFrame | bool | None = None) -> DataFrame:
    """(keys, k, r, acf): of nonuniform scans at all distances of an even grid, by transforms. See resampled() and guards.cutoffs_of()."""
    grid = resampled(points, factor, n, keys, reentrant)
    c = fourier.correlation_line(grid, keys).join(_spans(grid, keys), list(keys))
    m = F.max("k").over(Window.partitionBy(*keys)) + 1
    return reliable_autocorrelation(c.select(*keys, "k", (F.col("k") * F.col("size") / m).alias("r"), _half_mean().alias("acf")), cutoffs_of(points, reliable, keys), keys)


def autocorrelation_nonuniform(points: DataFrame, distances: list[float], keys: tuple[str, ...] = KEYS, reentrant: str = "raise", reliable: DataFrame | bool | None = None) -> DataFrame:
    """(keys, r, acf): the exact height-difference integral of piecewise-linear profiles over (length - distance). reliable: as guards.cutoffs_of says.

    A segment is matched with those that overlap it when shifted. Both sides are put into cells along x, as wide as the
    scan's longest segment, so that the overlap is an equi-join on cells.
    """
    j = overlaps(points, distances, keys, reentrant)
    at = lambda x: f"(e0 + f * ({x} - y0) - h0 - g * ({x} - r - x0))"
    j = j.select(*keys, "r", "l", F.expr("hi - lo").alias("d"), F.expr(at("lo")).alias("u"), F.expr(at("hi")).alias("v"))
    acf = j.groupBy(*keys, "r").agg((F.sum(F.expr("d * (u*u + u*v + v*v) / 6")) / (F.max("l") - F.col("r"))).alias("acf"))
    return reliable_autocorrelation(acf, cutoffs_of(points, reliable, keys), keys)


def height_height_autocorrelation(points: DataFrame, distances: list[float], keys: tuple[str, ...] = KEYS, reentrant: str = "raise") -> DataFrame:
    """(keys, r, acf): the exact integral of the product of piecewise-linear profiles with themselves, shifted; not divided by a length."""
    j = overlaps(points, distances, keys, reentrant)
    own, far = (lambda x: f"(h0 + g * ({x} - r - x0))"), (lambda x: f"(e0 + f * ({x} - y0))")
    j = j.select(*keys, "r", F.expr("hi - lo").alias("d"), *[F.expr(w(x)).alias(n) for n, w, x in (("a", own, "lo"), ("b", own, "hi"), ("u", far, "lo"), ("v", far, "hi"))])
    return j.groupBy(*keys, "r").agg(F.sum(F.expr("d * (2*a*u + a*v + b*u + 2*b*v) / 6")).alias("acf"))


def overlaps(points: DataFrame, distances: list[float], keys: tuple[str, ...] = KEYS, reentrant: str = "raise") -> DataFrame:
    """Pairs of a segment shifted by r and a segment of the same scan that overlap, from lo to hi."""
    from .detrend import segments

    s = segments(single_valued(points, reentrant, keys), keys)
    span = s.groupBy(*keys).agg(F.max("dx").alias("w"), F.sum("dx").alias("l"))
    s = s.join(span, list(keys)).select(*keys, "x0", "h0", "dx", ((F.col("h1") - F.col("h0")) / F.col("dx")).alias("g"), "w", "l")
    left = s.withColumn("r", F.explode(F.array(*map(F.lit, map(float, distances))))).where("r < l").withColumn("c", F.floor((F.col("x0") + F.col("r")) / F.col("w")))
    left = left.withColumn("c", F.explode(F.array(F.col("c") - 1, F.col("c"), F.col("c") + 1)))
    right = s.select(*keys, F.col("x0").alias("y0"), F.col("h0").alias("e0"), F.col("dx").alias("dy"), F.col("g").alias("f"), F.floor(F.col("x0") / F.col("w")).alias("c"))
    return left.join(right, [*keys, "c"]).withColumn("lo", F.greatest(F.col("x0") + F.col("r"), "y0")).withColumn("hi", F.least(F.expr("x0 + r + dx"), F.expr("y0 + dy"))).where("hi > lo")


def slope_from_acf(acf: DataFrame) -> DataFrame:
    """Scale-dependent slope sqrt(2 A) / r, without distance zero."""
    return acf.where("k > 0").withColumn("slope", F.sqrt(2 * F.greatest("acf", F.lit(0.0))) / F.col("r")).drop("acf")


def slope_from_area_acf(acf: DataFrame) -> DataFrame:
    """Scale-dependent slope of maps from their radial correlation (r2, acf), without distance zero."""
    r = F.sqrt(F.col("r2").cast("double"))
    return acf.where("r2 > 0").withColumn("r", r).withColumn("slope", F.sqrt(2 * F.greatest("acf", F.lit(0.0))) / r).drop("acf")


def curvature_from_area_acf(acf: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """(keys, k, r, curvature): scale-dependent curvature 4 sqrt(8 A(r / 2) - 2 A(r)) / r^2 of maps from autocorrelation_rings(), up to before the first negative value."""
    return curvature_from_acf(acf.select(*keys, "k", "r", "acf"), None, keys).withColumn("r", 2 * F.col("r"))


def curvature_from_acf(acf: DataFrame, n: int | None = None, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """Scale-dependent curvature sqrt(8 A_k - 2 A_2k) / r_k^2, up to before the first negative value; of n lags, or as far as they go."""
    twice = acf.select(*keys, (F.col("k") / 2).cast("int").alias("k"), F.col("acf").alias("far")).where(acf.k % 2 == 0)
    v = acf.where((F.col("k") > 0) & (F.lit(n is None) | (F.col("k") < ((n or 0) + 1) // 2))).join(twice, [*keys, "k"]).withColumn("v", 8 * F.col("acf") - 2 * F.col("far"))
    w = Window.partitionBy(*keys).orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    v = v.withColumn("bad", F.sum((F.col("v") < 0).cast("int")).over(w)).where("bad = 0")
    return v.select(*keys, "k", "r", (F.sqrt("v") / (F.col("r") * F.col("r"))).alias("curvature"))


# --- binning ---------------------------------------------------------------------------------------


def grid_edges(collocation: str, low: float, high: float, points: int | None = None, per_decade: int = 10) -> list[float]:
    """Edges of bins between low and high: 'log' (widened by a hundredth of a decade), 'quadratic' or 'linear'."""
    if collocation == "log":
        n = points or math.ceil((math.log10(high) - math.log10(low) + 1) * per_decade)
        return [float(x) for x in 10 ** np.linspace(math.log10(low) - 0.01, math.log10(high) + 0.01, n)]
    n = points or math.ceil((math.log10(high) - math.log10(low) + 1) * per_decade)
    if collocation == "linear":
        return [float(x) for x in np.linspace(low, high, n + 1)]
    if collocation == "quadratic":
        return [float(x) for x in np.sqrt(np.linspace(low**2, high**2, n + 1))]
    raise ValueError(f"collocation {collocation!r}: none of log, linear, quadratic")


def bin_average(curve: DataFrame, x: str, y: str, edges: list[float], keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, bin, x, y, var, n): means over the samples of each bin, edge i < x <= edge i + 1; empty bins are null rows."""
    e = F.array(*map(F.lit, edges))
    at = (F.size(F.filter(e, lambda v: v < F.col(x))) - 1).cast("int")
    got = curve.where(F.col(x).isNotNull() & F.col(y).isNotNull()).withColumn("bin", at).where((F.col("bin") >= 0) & (F.col(x) <= edges[-1]))
    got = got.groupBy(*keys, "bin").agg(F.avg(x).alias("x"), F.avg(y).alias("y"), F.var_pop(y).alias("var"), F.count("*").alias("n"))
    bins = curve.sparkSession.range(len(edges) - 1).select(F.col("id").cast("int").alias("bin"))
    if keys:
        bins = curve.select(*keys).distinct().withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(len(edges) - 2))))
    return bins.join(got, [*keys, "bin"], "left")


def integrate_psd(psd: DataFrame, size: float, factor: str = "1D", keys: tuple[str, ...] = KEYS) -> DataFrame:
    """Sum of the spectrum times factor(q) (SQL text) over positive and negative wavevectors, by the size."""
    return psd.groupBy(*keys).agg((2 * F.sum(F.col("psd") * F.expr(factor)) / F.lit(float(size))).alias("integral"))


def trapezoid(curve: DataFrame, x: str, y: str, keys: tuple[str, ...] = KEYS, cumulative: bool = False) -> DataFrame:
    """Integral by trapezoids over x in ascending order; cumulative: its running values."""
    w = Window.partitionBy(*keys).orderBy(x)
    part = (F.col(x) - F.lag(x).over(w)) * (F.col(y) + F.lag(y).over(w)) / 2
    c = curve.withColumn("_part", F.coalesce(part, F.lit(0.0)))
    if cumulative:
        return c.select(*keys, x, F.sum("_part").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("integral"))
    return c.groupBy(*keys).agg(F.sum("_part").alias("integral"))


def half_derivative_variance(acf: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """Variance of the half derivative: A(r0) / r0 + the integral of A / r^2 from the smallest distance on."""
    c = acf.where("r > 0").withColumn("y", F.col("acf") / (F.col("r") * F.col("r")))
    first = c.groupBy(*keys).agg(F.min_by(F.col("acf") / F.col("r"), "r").alias("first"))
    return trapezoid(c, "r", "y", keys).join(first, list(keys)).select(*keys, (F.col("first") + F.col("integral")).alias("variance"))

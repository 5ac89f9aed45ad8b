"""Averages over collections of measurements: a mean in each scan's bins, then a mean over scans."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def decade_bin(x, per_decade: int = 10):
    """Number of the bin of a logarithmic grid that all measurements share: 10^(b / n) < x <= 10^((b + 1) / n)."""
    return (F.ceil(F.round(F.log10(x) * per_decade, 9)) - 1).cast("int")


def log_average(curves: DataFrame, x: str, y: str, scan: tuple[str, ...] = ("scan_id",), container: tuple[str, ...] = ("surface_id",), per_decade: int = 10) -> DataFrame:
    """(container, bin, x, y, n): mean over scans of their means in each bin; bins without data between the first and last are null.

    Both steps aggregate partially before they shuffle; the grid is known without a look at the data, so no extent
    has to be found first.
    """
    c = curves.where((F.col(x) > 0) & F.col(y).isNotNull()).withColumn("bin", decade_bin(F.col(x), per_decade))
    each = c.groupBy(*container, *scan, "bin").agg(F.avg(x).alias("x"), F.avg(y).alias("y"))
    return bin_means(each, container)


def bin_means(each: DataFrame, container: tuple[str, ...] = ("surface_id",)) -> DataFrame:
    """(container, bin, x, y, n): means over scans of (container, scan, bin, x, y), one row a scan and bin."""
    mean = each.groupBy(*container, "bin").agg(F.avg("x").alias("x"), F.avg("y").alias("y"), F.count("*").alias("n"))
    bins = mean.groupBy(*container).agg(F.min("bin").alias("a"), F.max("bin").alias("b")).select(*container, F.explode(F.sequence("a", "b")).alias("bin"))
    return bins.join(mean, [*container, "bin"], "left")


def scale_dependent_average(values: DataFrame, container: tuple[str, ...] = ("surface_id",)) -> DataFrame:
    """(container, distance, value, n): means over scans at each distance, undefined values left out."""
    return values.groupBy(*container, "distance").agg(F.avg("value").alias("value"), F.count("value").alias("n"))


def bandwidth(each: DataFrame, container: tuple[str, ...] = ()) -> DataFrame:
    """Smallest lower and largest upper bandwidth of the members."""
    return each.groupBy(*container).agg(F.min("lower").alias("lower"), F.max("upper").alias("upper"))


def suggest_length_unit(bandwidths: DataFrame, metres: float = 1.0) -> DataFrame:
    """The unit for a logarithmic axis over lower..upper, which are in units of `metres`."""
    names = ["fm", "pm", "nm", "µm", "mm", "m", "km", "Mm", "Gm"]
    middle = F.sqrt(F.col("lower") * F.col("upper")) * F.lit(float(metres))
    at = F.least(F.greatest(F.floor(F.log10(middle) / 3 + 1e-12), F.lit(-5)), F.lit(3)) + 5
    return bandwidths.withColumn("unit", F.element_at(F.array(*map(F.lit, names)), (at + 1).cast("int")))


def integrate_psd(psd: DataFrame, extents: DataFrame, factor: str = "1D", scan: str = "scan_id", container: tuple[str, ...] = ("surface_id",)) -> DataFrame:
    """Sum over members' spectra of psd * factor(q) / size / (members whose range covers q), by container.

    extents: (container, scan, size, q_low, q_high). Members with equal ranges are one class, so wavevectors meet
    the container's few classes and not each member.
    """
    classes = extents.groupBy(*container, "q_low", "q_high").agg(F.count("*").alias("members"))
    q = psd.select(*container, "q").distinct()
    j = q.join(classes, list(container)).where((F.col("q") == 0) | ((F.col("q") >= F.col("q_low") * (1 - 1e-9)) & (F.col("q") <= F.col("q_high") * (1 + 1e-9))))
    cover = j.groupBy(*container, "q").agg(F.sum("members").alias("members"))
    each = psd.join(extents.select(*container, scan, "size"), [*container, scan]).join(cover, [*container, "q"])
    return each.groupBy(*container).agg(F.sum(2 * F.col("psd") * F.expr(factor) / F.col("size") / F.col("members")).alias("integral"))


def profile_moment(average: DataFrame, order: int, isotropic: bool = False, container: tuple[str, ...] = ("surface_id",), cumulative: bool = False) -> DataFrame:
    """Moment of an averaged spectrum by trapezoids: of C1D q^order / pi, or of Ciso = C1D pi / q times q^(order + 1) / 2 pi.

    cumulative: (container, x, integral), its running values from the smallest wavevector on.
    """
    from ..operators.spectral import trapezoid

    y = f"(y * {math.pi!r}D / x) * pow(x, {order + 1}) / {2 * math.pi!r}D" if isotropic else f"y * pow(x, {order}) / {math.pi!r}D"
    c = average.where("y IS NOT NULL").select(*container, "x", F.expr(y).alias("v"))
    return trapezoid(c, "x", "v", container, cumulative)


def half_derivative_variance(average: DataFrame, container: tuple[str, ...] = ("surface_id",), scale_dependent: bool = False) -> DataFrame:
    """(container, variance), or (container, r, variance) up to each distance: variance of the half derivative from an averaged
    autocorrelation, A(r0) / r0 + the integral of A / r^2 by trapezoids from the smallest distance r0 on.
    """
    by = Window.partitionBy(*container).orderBy("x")
    c = average.where("y IS NOT NULL").select(*container, "x", F.col("y").cast("double").alias("y"))
    area = (F.col("y") / F.pow("x", F.lit(2)) + F.lag(F.col("y") / F.pow("x", F.lit(2))).over(by)) / 2 * (F.col("x") - F.lag("x").over(by))
    c = c.withColumn("_add", F.coalesce(area, F.col("y") / F.col("x")))
    if scale_dependent:
        return c.select(*container, F.col("x").alias("r"), F.sum("_add").over(by).alias("variance"))
    return c.groupBy(*container).agg(F.sum("_add").alias("variance"))

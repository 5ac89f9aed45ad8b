"""Analytic surfaces and the self-affine model as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


class SelfAffine:
    """Isotropic spectrum: cr up to the rolloff wavevector, then a power law; zero outside the cutoffs (in wavelengths)."""

    def __init__(self, cr: float, rolloff: float, hurst: float, short: float = 0.0, long: float = math.inf):
        self.cr, self.hurst = cr, hurst
        self.qr = 2 * math.pi / rolloff
        self.qs = math.inf if short == 0 else 2 * math.pi / short
        self.ql = 2 * math.pi / long

    def _between(self, q: Column, value: Column) -> Column:
        inside = (q > self.ql) if math.isinf(self.qs) else (q > self.ql) & (q < self.qs)
        return F.when(inside, value).otherwise(F.lit(0.0))

    def psd_isotropic(self, q: Column) -> Column:
        return self._between(q, F.when(q < self.qr, F.lit(self.cr)).otherwise(self.cr * F.pow(q / self.qr, F.lit(-2.0 - 2 * self.hurst))))

    def psd_profile(self, q: Column) -> Column:
        root = F.lit(1.0) if math.isinf(self.qs) else F.sqrt(F.greatest(1 - F.pow(q / self.qs, F.lit(2.0)), F.lit(0.0)))
        tail = self.cr * F.pow(q / self.qr, F.lit(-2.0 - 2 * self.hurst)) * q / math.pi * root
        return self._between(q, F.when(q < self.qr, F.lit(self.cr * self.qr / math.pi)).otherwise(tail))

    def variance(self, order: float) -> float:
        """Variance of the derivative of this (fractional) order: the flat part's and the power law's integrals."""
        a, h = order, self.hurst
        flat = self.cr / (2 * math.pi) * (self.qr ** (2 + 2 * a) - self.ql ** (2 + 2 * a)) / (2 + 2 * a)
        c0 = self.cr * self.qr ** (2 + 2 * h)
        if a == h:
            return flat + c0 / (2 * math.pi) * math.log(self.qs / self.qr)
        top = 0.0 if math.isinf(self.qs) and a < h else self.qs ** (2 * a - 2 * h)
        return flat + c0 / (2 * math.pi) * (top - self.qr ** (2 * a - 2 * h)) / (2 * a - 2 * h)

    def rms_height(self) -> float:
        return math.sqrt(self.variance(0.0))


def variance_columns(cr: Column, qr: Column, hurst: Column, ql: Column, qs: Column, order: float) -> Column:
    """variance() over a table of parameters; the order must differ from the Hurst exponents."""
    a = float(order)
    flat = cr / (2 * math.pi) * (F.pow(qr, F.lit(2 + 2 * a)) - F.pow(ql, F.lit(2 + 2 * a))) / (2 + 2 * a)
    e = 2 * a - 2 * hurst
    return flat + cr * F.pow(qr, 2 + 2 * hurst) / (2 * math.pi) * (F.pow(qs, e) - F.pow(qr, e)) / e


def from_function(spark: SparkSession, nx: int, ny: int, sx: float, sy: float, height) -> DataFrame:
    """(ix, iy, x, y, h): a map of height(x, y), a Column of positions."""
    p = spark.range(nx * ny).select(F.expr(f"cast(id div {ny} as int)").alias("ix"), (F.col("id") % ny).cast("int").alias("iy"))
    p = p.withColumns({"x": F.col("ix") * F.lit(sx / nx), "y": F.col("iy") * F.lit(sy / ny)})
    return p.withColumn("h", height(F.col("x"), F.col("y")))


def cap(x: Column, y: Column, radius: float, sx: float, sy: float, kind: str = "sphere") -> Column:
    """The top of a sphere, or paraboloid, about the middle of a map of sizes sx and sy: zero at its top, undefined beyond the sphere."""
    r2 = F.pow(x - sx / 2, F.lit(2.0)) + F.pow(y - sy / 2, F.lit(2.0))
    return -r2 / (2 * radius) if kind == "paraboloid" else F.when(r2 < radius * radius, F.sqrt(F.lit(radius * radius) - r2) - radius)


def sphere(spark: SparkSession, radius: float, nx: int, ny: int, sx: float, sy: float, kind: str = "sphere") -> DataFrame:
    """cap() on a grid of its own."""
    return from_function(spark, nx, ny, sx, sy, lambda x, y: cap(x, y, radius, sx, sy, kind))


def self_affine_prefactor(nb_grid_pts: tuple[int, ...], sizes: tuple[float, ...], hurst: Column, rms_height: float | None = None, rms_slope: float | None = None, short: float | None = None, long: float | None = None) -> Column:
    """The factor of a random surface's Fourier amplitudes, without a rolloff, for a wanted rms height or rms slope; scans have one size, maps two."""
    if (rms_height is None) == (rms_slope is None):
        raise ValueError("either rms_height or rms_slope")
    top = 2 * math.pi / short if short else math.pi * min(n / s for n, s in zip(nb_grid_pts, sizes, strict=True))
    low = 2 * math.pi / long if long else 2 * math.pi / min(sizes)
    power = (lambda q, e: F.pow(F.lit(q), e))
    if rms_height is not None:
        c = 2 * rms_height * F.sqrt(hurst * math.pi / (power(low, -2 * hurst) - power(top, -2 * hurst)))
    else:
        c = 2 * rms_slope * F.sqrt((1 - hurst) * math.pi / (power(top, 2 - 2 * hurst) - power(low, 2 - 2 * hurst)))
    return c * F.lit(math.prod(nb_grid_pts) / math.sqrt(math.prod(sizes)) / math.sqrt(2 if len(sizes) == 1 else 1))

"""Guards against data that an analysis can't take (undefined heights, overhangs) and against scales that can't be trusted."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEYS = ("scan_id",)


def defined(points: DataFrame, undefined: str = "raise", keys: tuple[str, ...] = KEYS) -> DataFrame:
    """Points of surfaces without undefined heights: 'raise' fails the job at the first one, 'drop' leaves out the whole surface, 'skip' changes nothing."""
    if undefined == "skip":
        return points
    bad = F.col("h").isNull() | F.isnan("h")
    if undefined == "raise":
        return points.withColumn("h", F.when(bad, F.raise_error(F.lit("UndefinedData: this analysis needs every height"))).otherwise(F.col("h")))
    if undefined != "drop":
        raise ValueError(f"undefined {undefined!r}: none of raise, drop and skip")
    return points.withColumn("_bad", F.max(bad).over(Window.partitionBy(*keys))).where(~F.col("_bad")).drop("_bad")


def single_valued(points: DataFrame, reentrant: str = "raise", keys: tuple[str, ...] = KEYS) -> DataFrame:
    """Points of nonuniform scans whose x grows from point to point: 'raise' fails the job where it doesn't, 'drop' leaves out the scan, 'skip' changes nothing."""
    if reentrant == "skip":
        return points
    back = F.coalesce(F.col("x") <= F.lag("x").over(Window.partitionBy(*keys).orderBy("ix")), F.lit(False))
    if reentrant == "raise":
        return points.withColumn("_back", back).withColumn("x", F.when(F.col("_back"), F.raise_error(F.lit("ReentrantData: this analysis needs a profile without overhangs"))).otherwise(F.col("x"))).drop("_back")
    if reentrant != "drop":
        raise ValueError(f"reentrant {reentrant!r}: none of raise, drop and skip")
    return points.withColumn("_back", back).withColumn("_any", F.max("_back").over(Window.partitionBy(*keys))).where(~F.col("_any")).drop("_back", "_any")


def spacing_cutoffs(points: DataFrame, keys: tuple[str, ...] = KEYS, of=F.avg) -> DataFrame:
    """(keys, cutoff) of nonuniform scans: the mean distance of neighbouring points, or another aggregate of it."""
    x = points.select(*keys, (F.lead("x").over(Window.partitionBy(*keys).orderBy("ix")) - F.col("x")).alias("dx"))
    return x.groupBy(*keys).agg(of("dx").alias("cutoff"))


def kept(curve: DataFrame, cutoffs: DataFrame | None, trusted: Column, least: int = 1, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """The rows of curve that are trusted (an expression of its columns and cutoff; all where the cutoff is null).

    A scan with fewer than `least` of them has no reliable data and is left out. Without cutoffs all rows stay.
    """
    if cutoffs is None:
        return curve
    both = curve.join(cutoffs, list(keys), "left") if keys else curve.crossJoin(F.broadcast(cutoffs))  # without keys cutoffs are one row
    rest = both.where(F.col("cutoff").isNull() | trusted).drop("cutoff")
    if least <= 1:
        return rest
    return rest.withColumn("_left", F.count("*").over(Window.partitionBy(*keys))).where(F.col("_left") >= least).drop("_left")


def reliable_spectrum(psd: DataFrame, cutoffs: DataFrame | None, keys: tuple[str, ...] = KEYS) -> DataFrame:
    return kept(psd, cutoffs, F.col("q") < F.lit(2 * math.pi) / F.col("cutoff"), 2, keys)


def reliable_autocorrelation(acf: DataFrame, cutoffs: DataFrame | None, keys: tuple[str, ...] = KEYS) -> DataFrame:
    return kept(acf, cutoffs, F.col("r") > F.col("cutoff") / 2, 1, keys)


def reliable_bandwidth(vb: DataFrame, cutoffs: DataFrame | None, keys: tuple[str, ...] = KEYS) -> DataFrame:
    return kept(vb, cutoffs, F.col("bandwidth") > F.col("cutoff"), 1, keys)


def reliable_scales(sdrp: DataFrame, cutoffs: DataFrame | None, order: int = 1, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """Of scale-dependent statistics of derivatives of this order."""
    return kept(sdrp, cutoffs, F.col("distance") > F.col("cutoff") * (order / 2), 1, keys)


def cutoffs_of(points: DataFrame, reliable: DataFrame | bool | None, keys: tuple[str, ...] = KEYS) -> DataFrame | None:
    """The cutoffs that an analysis of nonuniform scans takes: given ones, the mean distance of neighbouring points (True), or none."""
    return spacing_cutoffs(points, keys) if reliable is True else None if reliable is False else reliable

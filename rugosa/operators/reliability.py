"""Cutoffs below which a measurement is not trusted; the filters that keep trusted scales are in guards, and options of the analyses."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .guards import defined, kept, reliable_autocorrelation, reliable_bandwidth, reliable_scales, reliable_spectrum, single_valued, spacing_cutoffs  # noqa: F401 (their old place)
from .stencils import scale_dependent

KEYS = ("scan_id",)


def tip_cutoffs(points: DataFrame, radii: DataFrame, n: int, pixel: float, safety: float = 0.5, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """(keys, cutoff) of line scans of n points whose tip_radius is in radii: the largest distance at which the sharpest
    peak's curvature reaches safety / radius, between distances by straight lines. Scans blunter than that everywhere have no row.
    """
    worst = scale_dependent(points, list(range(1, (n - 1) // 2 + 1)), pixel, 2, keys, F.min, 1)
    v = worst.join(radii, list(keys)).withColumn("over", -F.col("value") - safety / F.col("tip_radius"))
    v = v.withColumn("after", F.lead("over").over(Window.partitionBy(*keys).orderBy("distance"))).where("over > 0")
    at = F.col("distance") + F.coalesce(F.col("over") / (F.col("over") - F.col("after")), F.lit(0.0)) * (2 * float(pixel))
    return v.groupBy(*keys).agg(F.max_by(at, "distance").alias("cutoff"))


def short_cutoffs(points: DataFrame, info: DataFrame, n: int, pixel: float, other: float | None = None, safety: float = 0.5, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """(keys, cutoff) for each row of info (keys, tip_radius, resolution, in the unit of the positions).

    The tip's cutoff where a tip radius is known, else the resolution; at least `other`, if given. Null: all scales are trusted.
    """
    tips = tip_cutoffs(points, info.where("tip_radius IS NOT NULL").select(*keys, "tip_radius"), n, pixel, safety, keys)
    own = F.when(F.col("tip_radius").isNotNull(), F.col("cutoff")).otherwise(F.col("resolution").cast("double"))
    limit = own if other is None else F.greatest(own, F.lit(float(other)))
    return info.join(tips, list(keys), "left").select(*keys, limit.alias("cutoff"))

"""Bearing area: the share of a surface above a height, with straight pieces and triangles as elements."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .detrend import segments
from .ordered import running_sums

KEYS = ("scan_id",)


def _heights(heights: list[float]) -> Column:
    return F.explode(F.array(*map(F.lit, map(float, heights))))


_SEGMENT = "CASE WHEN z < least(a, b) THEN 1D WHEN z > greatest(a, b) THEN 0D ELSE coalesce((greatest(a, b) - z) / nullif(abs(b - a), 0D), 1D) END"
_TRIANGLE = """CASE WHEN z <= t1 THEN 1D
 WHEN z <= t2 THEN 1D - (z - t1) * (z - t1) / nullif((t2 - t1) * (t3 - t1), 0D)
 WHEN z <= t3 THEN (t3 - z) * (t3 - z) / nullif((t3 - t2) * (t3 - t1), 0D) ELSE 0D END"""


def line_elements(points: DataFrame, keys: tuple[str, ...] = KEYS, periodic: bool = False) -> DataFrame:
    """(keys, a, b): the straight pieces of uniform line scans, without those that have an undefined end; periodic: one more from the last point to the first."""
    w = Window.partitionBy(*keys).orderBy("ix")
    after = F.lead("h").over(w)
    if periodic:
        whole = Window.partitionBy(*keys)
        after = F.when(F.col("ix") == F.max("ix").over(whole), F.min_by("h", "ix").over(whole)).otherwise(after)
    return points.select(*keys, F.col("h").alias("a"), after.alias("b")).where("a IS NOT NULL AND b IS NOT NULL")


def bounds(elements: DataFrame, heights: list[float] | DataFrame, keys: tuple[str, ...] = KEYS, low: Column | None = None, high: Column | None = None) -> DataFrame:
    """(keys, z, lower, upper): between what shares of a surface's elements its part above z lies.

    Elements that lie above z altogether are the lower bound, those that reach z the upper one. The elements' lowest
    (low) and highest points are put in order together with the heights asked for, and a running count
    tells each height how many come before it: a merge, whatever the number of elements or heights, of one surface or of many. heights:
    a list for all surfaces, or rows (keys, z).
    """
    ends = elements.select(*keys, (F.least("a", "b") if low is None else low).alias("lo"), (F.greatest("a", "b") if high is None else high).alias("hi"))
    each = F.inline(F.array(F.struct(F.lit("lower").alias("side"), F.col("lo").alias("v")), F.struct(F.lit("upper").alias("side"), F.col("hi").alias("v"))))
    if isinstance(heights, list):
        of = ends.select(*keys).distinct() if keys else elements.sparkSession.range(1).select()
        heights = of.select(*keys, _heights(heights).alias("z"))
    asked = heights.select(*keys, F.explode(F.array(F.lit("lower"), F.lit("upper"))).alias("side"), F.col("z").cast("double").alias("v"), F.lit(0).alias("n"))
    rows = asked.unionByName(ends.select(*keys, each, F.lit(1).alias("n")))
    found = running_sums(rows, (*keys, "side"), ["v", "n"], {"before": "n"}).where("n = 0")  # n = 0 first: elements at z itself reach it
    found = found.groupBy(*keys, F.col("v").alias("z")).agg(*(F.max(F.when(F.col("side") == s, F.col("before"))).alias(f"_{s}") for s in ("lower", "upper")))
    total = ends.groupBy(*keys).agg(F.count("*").cast("double").alias("_n"))
    both = found.join(total, list(keys)) if keys else found.crossJoin(F.broadcast(total))  # without keys one row
    return both.select(*keys, "z", *((1 - F.col(f"_{s}") / F.col("_n")).alias(s) for s in ("lower", "upper")))


def bounds_map(points: DataFrame, heights: list[float] | DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """bounds() of nonperiodic maps, whose elements are triangles."""
    return bounds(triangles(points, keys), heights, keys, F.least("h1", "h2", "h3"), F.greatest("h1", "h2", "h3"))


def bearing_line(points: DataFrame, heights: list[float], keys: tuple[str, ...] = KEYS) -> DataFrame:
    """(keys, z, p) of uniform line scans; the query heights are a stated list, exploded beside each piece."""
    w = Window.partitionBy(*keys).orderBy("ix")
    s = points.select(*keys, F.col("h").alias("a"), F.lead("h").over(w).alias("b")).where("a IS NOT NULL AND b IS NOT NULL")
    return s.withColumn("z", _heights(heights)).groupBy(*keys, "z").agg(F.avg(F.expr(_SEGMENT)).alias("p"))


def bearing_nonuniform(points: DataFrame, heights: list[float], keys: tuple[str, ...] = KEYS) -> DataFrame:
    """The same for nonuniform scans, pieces weighted by their lengths."""
    s = segments(points, keys).select(*keys, F.col("h0").alias("a"), F.col("h1").alias("b"), "dx").withColumn("z", _heights(heights))
    return s.groupBy(*keys, "z").agg((F.sum(F.expr(f"dx * {_SEGMENT}")) / F.sum("dx")).alias("p"))


def triangles(points: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, h1, h2, h3): two triangles a pixel of a nonperiodic map, without those that have undefined corners."""
    px = points.where("h IS NOT NULL")
    at = {}
    for name, (dx, dy) in {"a": (0, 0), "b": (1, 0), "c": (0, 1), "d": (1, 1)}.items():
        at[name] = px.select(*keys, (F.col("ix") - dx).alias("ix"), (F.col("iy") - dy).alias("iy"), F.lit(name).alias("corner"), "h")
    corners = at["a"].unionByName(at["b"]).unionByName(at["c"]).unionByName(at["d"])
    # One aggregate brings a pixel's four corners together: no self-joins.
    pick = lambda n: F.max(F.when(F.col("corner") == n, F.col("h"))).alias(n)
    sq = corners.groupBy(*keys, "ix", "iy").agg(*map(pick, "abcd"))
    both = F.inline(F.array(F.struct(F.col("a").alias("h1"), F.col("b").alias("h2"), F.col("c").alias("h3")), F.struct(F.col("b").alias("h1"), F.col("d").alias("h2"), F.col("c").alias("h3"))))
    return sq.select(*keys, both).where("h1 IS NOT NULL AND h2 IS NOT NULL AND h3 IS NOT NULL")


def bearing_map(points: DataFrame, heights: list[float], keys: tuple[str, ...] = ()) -> DataFrame:
    t = triangles(points, keys).withColumn("_t", F.array_sort(F.array("h1", "h2", "h3"))).select(*keys, *[F.col("_t")[i].alias(f"t{i + 1}") for i in range(3)])
    return t.withColumn("z", _heights(heights)).groupBy(*keys, "z").agg(F.avg(F.expr(_TRIANGLE)).alias("p"))

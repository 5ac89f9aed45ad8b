"""Variable-bandwidth analysis: trends removed in ever smaller pieces."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .detrend import fit, segments, subtracted
from .guards import cutoffs_of, defined, reliable_bandwidth, single_valued

KEYS = ("scan_id",)


def subdivisions(n: int, least: int = 4) -> list[int]:
    out = [1]
    while n // (2 * out[-1]) >= least:
        out.append(2 * out[-1])
    return out


def checkerboard_line(points: DataFrame, n: int, pieces: int, order: int = 1, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """Line scans with the polynomial of each of `pieces` equal pieces removed."""
    p = points.withColumn("_piece", F.expr(f"cast(ix * {pieces} div {n} as int)"))
    basis = ["1D", f"(ix / {n}D)", f"((ix / {n}D) * (ix / {n}D))"][: order + 1]
    return subtracted(p, fit(p, basis, (*keys, "_piece")), basis, (*keys, "_piece")).drop("_piece")


def checkerboard_map(points: DataFrame, nx: int, ny: int, pieces: tuple[int, int], order: int = 1, y0: int = 0, keys: tuple[str, ...] = ()) -> DataFrame:
    p = points.withColumns({"_px": F.expr(f"cast(ix * {pieces[0]} div {nx} as int)"), "_py": F.expr(f"cast((iy - {y0}) * {pieces[1]} div {ny} as int)")})
    x, y = f"(ix / {nx}D)", f"((iy - {y0}) / {ny}D)"
    basis = ["1D", x, y, f"({x} * {x})", f"({y} * {y})", f"({x} * {y})"][: (1, 3, 6)[order]]
    k = (*keys, "_px", "_py")
    return subtracted(p, fit(p, basis, k), basis, k).drop("_px", "_py")


def variable_bandwidth(points: DataFrame, n: int, size: float, keys: tuple[str, ...] = KEYS, least: int = 4, undefined: str = "skip", func=None, slopes: bool = False, reliable: DataFrame | None = None) -> DataFrame:
    """(keys, magnification, bandwidth, rms): rms height after straight lines are removed in 1, 2, 4, ... pieces.

    func: a Column builder of another statistic of what is left, then column `value`. slopes: also column `slope`, the rms
    of the lines' slopes over pieces. reliable: rows (keys, cutoff); only bandwidths over it stay then.
    All subdivisions are one plan: each point goes to its piece of each, whose residual is a closed form of its moments.
    """
    p = defined(points, undefined, keys).withColumn("m", F.explode(F.array(*map(F.lit, subdivisions(n, least))))).withColumn("_piece", F.expr(f"ix * m div {n}"))
    x = F.col("ix").cast("double")
    moments = [F.count("h").alias("c"), F.regr_syy("h", x).alias("yy"), F.regr_sxy("h", x).alias("xy"), F.regr_sxx("h", x).alias("xx")]
    each = p.groupBy(*keys, "m", "_piece").agg(*(moments[2:] if func else moments)) if func is None or slopes else None
    tilt = F.col("xy") / F.nullif("xx", F.lit(0.0))
    left = lambda: F.greatest(F.col("yy") - F.coalesce(F.col("xy") * tilt, F.lit(0.0)), F.lit(0.0))
    slope = F.sqrt(F.avg(F.pow(tilt * F.lit(n / float(size)), 2))).alias("slope")
    if func is None:
        out = each.groupBy(*keys, "m").agg(F.sqrt(F.sum(left()) / F.sum("c")).alias("rms"), *([slope] if slopes else []))
    else:
        basis, k = ["1D", f"(ix / {n}D)"], (*keys, "m", "_piece")
        out = subtracted(p, fit(p, basis, k), basis, k).groupBy(*keys, "m").agg(func(F.col("h")).alias("value"))
        out = out.join(each.groupBy(*keys, "m").agg(slope), [*keys, "m"]) if slopes else out
    return _by_bandwidth(out, F.lit(float(size)), reliable, keys)


def _by_bandwidth(out: DataFrame, size, reliable: DataFrame | None, keys: tuple[str, ...]) -> DataFrame:
    """(keys, magnification, bandwidth, the rest) of statistics by m."""
    rest = [c for c in out.columns if c not in (*keys, "m")]
    return reliable_bandwidth(out.select(*keys, F.col("m").alias("magnification"), (size / F.col("m")).alias("bandwidth"), *rest), reliable, keys)


def variable_bandwidth_map(points: DataFrame, nx: int, ny: int, sx: float, sy: float, keys: tuple[str, ...] = (), least: int = 4, y0: int = 0, undefined: str = "skip", func=None, slopes: bool = False, reliable: DataFrame | None = None) -> DataFrame:
    """(keys, magnification, bandwidth, rms): the same for maps, with planes removed in rectangles; slopes: column `gradient`, the rms of the planes' gradients."""
    start = tuple(max(1, round(s / min(sx, sy))) for s in (sx, sy))
    steps, m = [], 1
    while min(nx // (start[0] * m), ny // (start[1] * m)) >= least or m == 1:
        steps.append(m)
        m *= 2
    p = defined(points, undefined, keys).withColumn("m", F.explode(F.array(*map(F.lit, steps))))
    p = p.withColumns({"_px": F.expr(f"ix * m * {start[0]} div {nx}"), "_py": F.expr(f"(iy - {y0}) * m * {start[1]} div {ny}")})
    basis = ["1D", f"(ix / {nx}D)", f"((iy - {y0}) / {ny}D)"]
    k = (*keys, "m", "_px", "_py")
    planes = fit(p, basis, k)
    what = func(F.col("h")).alias("value") if func else F.sqrt(F.avg(F.col("h") * F.col("h"))).alias("rms")
    out = subtracted(p, planes, basis, k).groupBy(*keys, "m").agg(what)
    if slopes:
        steep = F.pow(F.col("c1") / F.lit(float(sx)), 2) + F.pow(F.col("c2") / F.lit(float(sy)), 2)
        out = out.join(planes.groupBy(*keys, "m").agg(F.sqrt(F.avg(steep)).alias("gradient")), [*keys, "m"])
    return _by_bandwidth(out, F.lit((sx / start[0] + sy / start[1]) / 2), reliable, keys)


#: A piece's end is no point of its own where a measured one is as near as this.
TOLERANCE = 1e-6


def clipped_segments(points: DataFrame, pieces, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """(keys, m, piece, centre, size, n, u0, h0, u1, h1): nonuniform scans cut into m pieces of equal length for each m of the array `pieces` (an
    expression of n, the scan's points); u is the distance from the piece's centre, ends are interpolated, heights are less their scan's mean.

    A segment meets only the pieces it overlaps, so m pieces of n points are at most n + m rows.
    """
    w = Window.partitionBy(*keys)
    s = segments(points, keys).withColumns({"_a": F.min("x0").over(w), "_l": F.max("x1").over(w) - F.min("x0").over(w), "n": F.count("*").over(w) + 1, "_h": F.avg("h0").over(w)})
    s = s.where("_l > 0").withColumn("m", F.explode(pieces))
    at = lambda x: F.floor((F.col(x) - F.col("_a")) * F.col("m") / F.col("_l"))
    s = s.withColumn("piece", F.explode(F.sequence(F.least(at("x0"), F.col("m") - 1), F.least(at("x1"), F.col("m") - 1))))
    s = s.withColumns({"size": F.col("_l") / F.col("m"), "centre": F.col("_a") + (F.col("piece") + 0.5) * F.col("_l") / F.col("m")})
    s = s.withColumns({"u0": F.greatest(F.col("x0") - F.col("centre"), -F.col("size") / 2), "u1": F.least(F.col("x1") - F.col("centre"), F.col("size") / 2)})
    s = s.where(f"u1 - u0 > {TOLERANCE!r}D OR (u0 > -size / 2 AND u1 < size / 2)")
    height = lambda u: F.col("h0") - F.col("_h") + F.when(F.col("dx") > 0, (F.col(u) + F.col("centre") - F.col("x0")) / F.col("dx") * (F.col("h1") - F.col("h0"))).otherwise(0.0)
    return s.select(*keys, "m", "piece", "centre", "size", "n", "u0", height("u0").alias("h0"), "u1", height("u1").alias("h1"))


def _trend(cut: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """(keys, m, piece, size, n, points, level, tilt, rms): the straight line of each piece in u and what it leaves, by exact integrals."""
    d = "(u1 - u0)"
    integrals = {"w": d, "u": f"{d} * (u0 + u1) / 2", "uu": f"{d} * (u0 * u0 + u0 * u1 + u1 * u1) / 3", "h": f"{d} * (h0 + h1) / 2", "hh": f"{d} * (h0 * h0 + h0 * h1 + h1 * h1) / 3", "uh": f"{d} * (u0 * (2 * h0 + h1) + u1 * (h0 + 2 * h1)) / 6"}
    each = cut.groupBy(*keys, "m", "piece", "size", "n").agg((F.count("*") + 1).alias("points"), *[F.sum(F.expr(v)).alias(f"_{k}") for k, v in integrals.items()])
    each = each.withColumn("tilt", F.expr("coalesce((_uh - _u * _h / _w) / nullif(_uu - _u * _u / _w, 0D), 0D)"))
    left = F.expr("(_hh - _h * _h / _w - tilt * (_uh - _u * _h / _w)) / _w")
    return each.select(*keys, "m", "piece", "size", "n", "points", F.expr("(_h - tilt * _u) / _w").alias("level"), "tilt", F.sqrt(F.greatest(left, F.lit(0.0))).alias("rms"))


def checkerboard_nonuniform(points: DataFrame, pieces: int, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """(keys, piece, ix, x, h): nonuniform scans cut into pieces of equal length, interpolated at their ends, each less its own straight line.

    Points at a cut are in both pieces; ix counts within the piece.
    """
    cut = clipped_segments(points, F.array(F.lit(pieces)), keys)
    k = [*keys, "m", "piece"]
    j = cut.join(_trend(cut, keys).select(*k, "level", "tilt"), k)
    last = F.lead("u0").over(Window.partitionBy(*k).orderBy("u0", "u1")).isNull()
    ends = F.when(last, F.array(F.struct(F.col("u0").alias("u"), F.col("h0").alias("h")), F.struct(F.col("u1").alias("u"), F.col("h1").alias("h")))).otherwise(F.array(F.struct(F.col("u0").alias("u"), F.col("h0").alias("h"))))
    at = j.withColumn("_e", ends).select(*k, "centre", "level", "tilt", F.posexplode("_e").alias("_i", "_p"))
    ix = F.row_number().over(Window.partitionBy(*k).orderBy("_p.u", "_i")) - 1
    return at.select(*keys, "piece", ix.alias("ix"), (F.col("centre") + F.col("_p.u")).alias("x"), (F.col("_p.h") - F.col("level") - F.col("tilt") * F.col("_p.u")).alias("h"))


def variable_bandwidth_nonuniform(points: DataFrame, keys: tuple[str, ...] = KEYS, least: int = 4, reentrant: str = "skip", reliable: DataFrame | bool | None = None) -> DataFrame:
    """(keys, magnification, bandwidth, rms): mean over pieces of the rms height left by their straight lines, for 1, 2, 4, ... pieces
    and up to the first number at which some piece has fewer than `least` points. Scans with fewer points have no rows.

    All numbers of pieces are one plan; there are at most log2(points) of them. reliable: as guards.cutoffs_of says.
    """
    powers = F.transform(F.sequence(F.lit(0), F.floor(F.log2(F.col("n"))).cast("int")), lambda i: F.pow(F.lit(2.0), i).cast("long"))
    each = _trend(clipped_segments(single_valued(points, reentrant, keys), powers, keys), keys)
    m = each.groupBy(*keys, "m", "size", "n").agg(F.avg("rms").alias("rms"), F.min("points").alias("_least"))
    before = F.min("_least").over(Window.partitionBy(*keys).orderBy("m").rowsBetween(Window.unboundedPreceding, -1))
    m = m.withColumn("_before", F.coalesce(before, F.col("n"))).where(F.col("_before") >= least)
    return reliable_bandwidth(m.select(*keys, F.col("m").cast("int").alias("magnification"), F.col("size").alias("bandwidth"), "rms"), cutoffs_of(points, reliable, keys), keys)

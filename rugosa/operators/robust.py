"""Median heights, median absolute deviations and the trends that minimise them, of scans and maps of any size.

The median is the height that half of a surface lies above; its absolute deviation the half width about it
outside which lies twice a given share. Both are roots of falling functions of the bearing area. They are
searched for all surfaces at once: a round cuts each surface's interval into SECTIONS by one aggregate over
all elements, so no surface has to fit in a task.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import dropped, written
from . import detrend
from .batches import by_line
from .bearing import triangles

KEYS = ("scan_id",)
# The lower quantile of the normal distribution at one standard deviation, and 1 / quantile(3/4).
SHARE = 0.15865525393145707
MAD_SCALE = 1.482602218505602
SECTIONS, ROUNDS = 16, 6

_AREA = {
    "piece": "CASE WHEN {z} < least(a, b) THEN 1D WHEN {z} > greatest(a, b) THEN 0D WHEN a = b THEN 1D ELSE (greatest(a, b) - {z}) / abs(b - a) END",
    "triangle": "CASE WHEN {z} <= a THEN 1D WHEN {z} <= b THEN 1D - ({z} - a) * ({z} - a) / ((b - a) * (c - a)) WHEN {z} <= c THEN ({c} - {z}) * ({c} - {z}) / ((c - b) * (c - a)) ELSE 0D END".replace("{c}", "c"),
}


def pieces(points: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """(keys, a, b, w): the straight pieces of uniform line scans, of one weight."""
    from .bearing import line_elements

    return line_elements(points, keys).withColumn("w", F.lit(1.0))


def pieces_nonuniform(points: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """(keys, a, b, w): those of nonuniform scans, weighted by their lengths."""
    return detrend.segments(points, keys).select(*keys, F.col("h0").alias("a"), F.col("h1").alias("b"), F.col("dx").alias("w")).where("a IS NOT NULL AND b IS NOT NULL")


def pieces_map(points: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, a, b, c, w): the triangles of nonperiodic maps, by their corners' heights in order."""
    t = triangles(points, keys).select(*keys, F.array_sort(F.array("h1", "h2", "h3")).alias("t"))
    return t.select(*keys, *(F.col("t")[i].alias(n) for i, n in enumerate("abc")), F.lit(1.0).alias("w"))


def _joined(rows: DataFrame, one: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """one has a row a surface; without keys a single one. Its size is known, so the optimizer broadcasts it if it is small."""
    return rows.join(one, list(keys)) if keys else rows.crossJoin(F.broadcast(one))


def roots(elements: DataFrame, state: DataFrame, value: Callable[[str], str], target: float, keys: tuple[str, ...], rounds: int = ROUNDS) -> DataFrame:
    """(state's columns, root): where the mean of value(d) over a surface's elements, a falling function of d, passes target.

    state: a row a surface with lo and hi, between which the root lies. It is cut down to SECTIONS ** -rounds of
    their distance, and in what is left the function counts as straight. Every second round is written.
    """
    rest = [c for c in state.columns if c not in (*keys, "lo", "hi")]
    at = [f"(lo + (hi - lo) * {i / SECTIONS}D)" for i in range(1, SECTIONS)]
    past = " + ".join(f"CAST(_{i} > {target!r}D * _w AS int)" for i in range(SECTIONS - 1))
    found = f"array({', '.join(['f_lo', *(f'_{i} / _w' for i in range(SECTIONS - 1)), 'f_hi'])})"
    state, on_disk = state.withColumns({"f_lo": F.lit(None).cast("double"), "f_hi": F.lit(None).cast("double")}), None
    for k in range(rounds):
        sums = _joined(elements, state, keys).groupBy(*keys, "lo", "hi", "f_lo", "f_hi", *rest).agg(F.sum("w").alias("_w"), *(F.sum(F.expr(f"w * ({value(d)})")).alias(f"_{i}") for i, d in enumerate(at)))
        cut = sums.withColumn("_cut", F.expr(past)).withColumn("_f", F.expr(found))
        state = cut.selectExpr(*keys, f"lo + (hi - lo) * _cut / {SECTIONS}D AS lo", f"lo + (hi - lo) * (_cut + 1) / {SECTIONS}D AS hi", "_f[_cut] AS f_lo", "_f[_cut + 1] AS f_hi", *rest)
        if k % 2 or k == rounds - 1:
            state, before = written(state, "interval"), on_disk
            on_disk = state
            if before is not None:
                dropped(before)
    straight = F.expr(f"lo + (hi - lo) * coalesce((f_lo - {target!r}D) / nullif(f_lo - f_hi, 0D), 0.5D)")
    return state.select(*keys, *rest, straight.alias("root"))


def median_mad(elements: DataFrame, keys: tuple[str, ...] = KEYS, share: float = SHARE, rounds: int = ROUNDS) -> DataFrame:
    """(keys, median, mad_height) of surfaces whose elements pieces(), pieces_nonuniform() or pieces_map() give. A surface without elements has no row."""
    triangle = "c" in elements.columns
    area = lambda z: _AREA["triangle" if triangle else "piece"].format(z=z)
    elements = written(elements, "elements")
    ends = ("a", "c") if triangle else ("least(a, b)", "greatest(a, b)")
    span = written(elements.groupBy(*keys).agg(F.min(F.expr(ends[0])).alias("lo"), F.max(F.expr(ends[1])).alias("hi")), "span")
    middle = roots(elements, span, area, 0.5, keys, rounds).withColumnRenamed("root", "m")
    wide = _joined(span, middle, keys).select(*keys, "m", F.lit(0.0).alias("lo"), F.greatest(F.col("hi") - F.col("m"), F.col("m") - F.col("lo")).alias("hi"))
    out = roots(elements, wide, lambda d: f"{area(f'(m + {d})')} + 1D - {area(f'(m - {d})')}", 2 * share, keys, rounds)
    return out.select(*keys, F.col("m").alias("median"), F.col("root").alias("mad_height"))


def median_mad_line(points: DataFrame, keys: tuple[str, ...] = KEYS, **kw) -> DataFrame:
    return median_mad(pieces(points, keys), keys, **kw)


def median_mad_nonuniform(points: DataFrame, keys: tuple[str, ...] = KEYS, **kw) -> DataFrame:
    return median_mad(pieces_nonuniform(points, keys), keys, **kw)


def median_mad_map(points: DataFrame, keys: tuple[str, ...] = (), **kw) -> DataFrame:
    return median_mad(pieces_map(points, keys), keys, **kw)


#: Points up to which a scan's trends are searched whole, in a batch with others.
WHOLE = 1 << 14
#: Pieces of trial surfaces that are held at once.
PIECES = 1 << 17


def mad_trend(points: DataFrame, degree: int, n: int, keys: tuple[str, ...] = KEYS, levels: int = 4, half: int = 8, reach: float = 4.0, share: float = SHARE, rounds: int = ROUNDS, whole: int = WHOLE) -> DataFrame:
    """(keys, c0, c1[, c2], mad_height): the polynomial in ix / n whose residual has the smallest median absolute deviation.

    Searched from least squares: the coefficients are tried, one after another, on 2 * half + 1 values
    about the best so far, first as far as `reach` rms heights of the residual away, then on each level a quarter of it. All
    trials of all scans are surfaces of one search; scans of up to `whole` points are searched in batches, where a pass over
    them costs no shuffle. c0 is the residual's median.
    """
    basis = detrend.line_basis(degree, n)
    best = detrend.fit(points, basis, keys)
    rest = detrend.subtracted(points, best, basis, keys).groupBy(*keys).agg(F.stddev_pop("h").alias("_step"))
    best = written(_joined(best, rest, keys), "trend")
    names = [f"c{i}" for i in range(1, degree + 1)]
    if n <= whole:
        return _trends_in_batches(points, best, n, keys, names, levels, half, reach, share, rounds)
    trial = F.explode(F.sequence(F.lit(-half), F.lit(half))).alias("_k")
    for level in range(levels):
        for name in names:
            tried = best.select(*keys, trial, *(F.col(c) + F.col("_k") * F.col("_step") * (reach * 0.25**level / half) if c == name else F.col(c) for c in names), F.col("_step"))
            tried = written(tried.toDF(*keys, "_k", *names, "_step"), "trials")
            terms = " + ".join(f"{c} * {b}" for c, b in zip(names, basis[1:], strict=True))
            rows = _joined(points.select(*keys, "ix", "h"), tried, keys).select(*keys, "_k", "ix", F.expr(f"h - ({terms})").alias("h"))
            found = median_mad(pieces(rows, (*keys, "_k")), (*keys, "_k"), share, rounds)
            near = F.struct(F.col("mad_height"), F.abs("_k").alias("d"), F.col("_k").alias("k"))
            picked = F.min_by(F.struct("median", "mad_height", "_step", *names), near).alias("b")
            found = found.join(tried, [*keys, "_k"]).groupBy(*keys).agg(picked)
            best = written(found.select(*keys, F.col("b.median").alias("c0"), *(F.col(f"b.{c}").alias(c) for c in names), F.col("b.mad_height").alias("mad_height"), F.col("b._step").alias("_step")), "trend")
    return best.drop("_step")


def _trends_in_batches(points: DataFrame, best: DataFrame, n: int, keys: tuple[str, ...], names: list[str], levels: int, half: int, reach: float, share: float, rounds: int) -> DataFrame:
    """The search of mad_trend from best (keys, c0, ..., _step), whole scans at a time."""
    degree = len(names)

    def run(table: pa.Table, starts: np.ndarray):
        x, h = (table.column(c).to_numpy() for c in ("ix", "h"))
        x, first = x / n, np.array([table.column(c).to_numpy()[starts] for c in (*names, "_step")])
        ends = np.append(starts[1:], table.num_rows)
        g, most = 0, max(1, PIECES // (2 * half + 1))
        while g < len(starts):
            last = max(g + 1, int(np.searchsorted(ends, starts[g] + most, side="right")))
            at = slice(starts[g], ends[last - 1])
            kept, out = _searched(x[at], h[at], starts[g:last] - starts[g], first[:degree, g:last], first[degree, g:last], levels, half, reach, share, rounds)
            yield g + kept, dict(zip(("c0", *names, "mad_height"), out, strict=True))
            g = last

    rows = _joined(points.select(*keys, "ix", F.col("h").cast("double").alias("h")), best.select(*keys, *names, "_step"), keys)
    return by_line(rows, keys, ", ".join(f"{c} double" for c in ("c0", *names, "mad_height")), run, "ix")


def _searched(x: np.ndarray, h: np.ndarray, starts: np.ndarray, c: np.ndarray, step: np.ndarray, levels: int, half: int, reach: float, share: float, rounds: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """Which of the scans that begin at starts have pieces, and their c0, c1, ..., mad_height."""
    scan = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(x))))
    left = np.flatnonzero((scan[1:] == scan[:-1]) & ~np.isnan(h[1:]) & ~np.isnan(h[:-1]) & ~np.isnan(step[scan[1:]]))
    kept, begins, sizes = np.unique(scan[left], return_index=True, return_counts=True)
    if not len(kept):
        return kept, [np.empty(0)] * (len(c) + 2)
    c, step, of = c[:, kept].copy(), step[kept], np.repeat(np.arange(len(kept)), sizes)
    k = np.arange(-half, half + 1)
    k = k[np.lexsort((k, np.abs(k)))]  # of equal deviations the trial nearest to the best so far wins
    all_, median, mad = np.arange(len(kept)), np.zeros(len(kept)), np.zeros(len(kept))
    powers = [x ** (i + 1) for i in range(len(c))]
    for level in range(levels):
        for i in range(len(c)):
            tried = c[i] + k[:, None] * (step * (reach * 0.25**level / half))
            rest = sum((powers[j] * c[j][np.searchsorted(kept, scan).clip(0, len(kept) - 1)] for j in range(len(c)) if j != i), np.zeros(len(x)))
            a, b = (h[e] - (tried[:, of] * powers[i][e] + rest[e]) for e in (left, left + 1))
            m, d = _medians(a, b, begins, sizes, share, rounds)
            pick = np.argmin(d, axis=0)
            c[i], median, mad = tried[pick, all_], m[pick, all_], d[pick, all_]
    return kept, [median, *c, mad]


def _medians(a: np.ndarray, b: np.ndarray, begins: np.ndarray, sizes: np.ndarray, share: float, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """Medians and deviations of surfaces whose pieces (trials x pieces) begin at begins: roots() by halves of the interval instead of by SECTIONS."""
    low, high = np.minimum(a, b), np.maximum(a, b)
    flat = low == high
    some, per = flat.any(), 1 / np.where(flat, 1.0, high - low)

    def area(z: np.ndarray) -> np.ndarray:
        z = np.repeat(z, sizes, axis=1)
        above = np.clip((high - z) * per, 0.0, 1.0)
        if some:
            above = np.where(flat, high >= z, above)
        return np.add.reduceat(above, begins, axis=1) / sizes

    def root(value: Callable, lo: np.ndarray, hi: np.ndarray, target: float) -> np.ndarray:
        f_lo, f_hi = np.full(lo.shape, np.nan), np.full(lo.shape, np.nan)
        for _ in range(rounds * (SECTIONS.bit_length() - 1)):
            mid = (lo + hi) / 2
            f = value(mid)
            up = f > target
            lo, hi, f_lo, f_hi = np.where(up, mid, lo), np.where(up, hi, mid), np.where(up, f, f_lo), np.where(up, f_hi, f)
        fall = f_lo - f_hi
        return lo + (hi - lo) * np.where(fall > 0, (f_lo - target) / np.where(fall > 0, fall, 1.0), 0.5)

    lo, hi = np.minimum.reduceat(low, begins, axis=1), np.maximum.reduceat(high, begins, axis=1)
    m = root(area, lo, hi, 0.5)
    return m, root(lambda d: area(m + d) + 1 - area(m - d), np.zeros_like(m), np.maximum(hi - m, m - lo), 2 * share)


def detrend_mad(points: DataFrame, mode: str, n: int, keys: tuple[str, ...] = KEYS, **kw) -> DataFrame:
    """Uniform line scans less the line (mad-tilt) or parabola (mad-curvature) of mad_trend."""
    degree = {"mad-tilt": 1, "mad-curvature": 2}[mode]
    return detrend.subtracted(points, mad_trend(points, degree, n, keys, **kw).drop("mad_height"), detrend.line_basis(degree, n), keys)

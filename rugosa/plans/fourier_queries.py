"""Queries of spectra and correlations of maps, and of nonuniform scans on an even grid."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..functions.algebra import cramer
from ..operators import bandwidth, regression, scalars, spectral, stencils
from ..sources.tables import line_scans, profiles, small_maps
from .catalog import _fit_sql, _psd, _psd_sql, L, M, N, P, PIXEL, query, rounded
from .chains import Chain

_AREA_EDGES = spectral.grid_edges("log", 2 * math.pi / 4, math.pi)
_GRID = 96


def _edges(edges: list[float]) -> str:
    return "[" + ", ".join(f"{e!r}::DOUBLE" for e in edges) + "]"


_OBLONG = "m AS (SELECT scan_id, ix // 16 AS ix, ix % 16 AS iy, h FROM l)"


def _oblong(spark, d):
    """Maps of 4 x 16 pixels, 4 by 8 in size."""
    return line_scans(spark, d).select("scan_id", F.expr("ix div 16").cast("int").alias("ix"), (F.col("ix") % 16).alias("iy"), "h")


@query("psd_area_log", f"""WITH {L}, {_OBLONG}, r AS (SELECT a.range AS ix, b.range AS iy, sqrt((a.range - 2) ** 2 + ((b.range - 8) * 0.5::DOUBLE) ** 2) AS r FROM range(4) a, range(16) b),
 w AS (SELECT ix, iy, CASE WHEN r < 2 THEN 0.5::DOUBLE + 0.5::DOUBLE * cos(pi() * r / 2) ELSE 0 END AS w FROM r), t AS (SELECT scan_id, m.ix, m.iy, h * w * (SELECT sqrt(64 / sum(w * w)) FROM w) AS h FROM m JOIN w ON w.ix = m.ix AND w.iy = m.iy),
 a AS (SELECT scan_id, iy, kx.range AS kx, sum(h * cos(2 * pi() * kx.range * ix / 4)) AS re, -sum(h * sin(2 * pi() * kx.range * ix / 4)) AS im FROM t, range(4) kx GROUP BY ALL),
 b AS (SELECT scan_id, kx, ky.range AS ky, sum(re * cos(2 * pi() * ky.range * iy / 16) + im * sin(2 * pi() * ky.range * iy / 16)) AS re, sum(im * cos(2 * pi() * ky.range * iy / 16) - re * sin(2 * pi() * ky.range * iy / 16)) AS im FROM a, range(16) ky GROUP BY ALL),
 c AS (SELECT scan_id, sqrt((least(kx, 4 - kx) * (2 * pi() / 4)) ** 2 + (least(ky, 16 - ky) * (2 * pi() / 8)) ** 2) AS q, (re * re + im * im) * 32 / 4096 AS psd FROM b),
 k AS (SELECT scan_id, len(list_filter({_edges(_AREA_EDGES)}, lambda e: e < q)) - 1 AS bin, q, psd FROM c WHERE q <= {_AREA_EDGES[-1]!r}::DOUBLE), g AS (SELECT scan_id, bin, avg(q) AS x, avg(psd) AS y, var_pop(psd) AS var, count(*) AS n FROM k WHERE bin >= 0 GROUP BY ALL)
 SELECT z.scan_id, CAST(z.bin AS INTEGER) AS bin, round(x, 6) AS x, round(y, 6) AS y, round(var, 6) AS var, n FROM (SELECT DISTINCT scan_id, r.range AS bin FROM m, range({len(_AREA_EDGES) - 1}) r) z LEFT JOIN g USING (scan_id, bin)""")
def psd_area_log(spark, d):
    return rounded(spectral.power_spectrum_area(_oblong(spark, d), 4, 16, 4.0, 8.0, _AREA_EDGES))


@query("acf_map_lags", f"WITH {M} SELECT a.scan_id, CAST(b.ix - a.ix AS INTEGER) AS a, CAST(b.iy - a.iy AS INTEGER) AS b, round(avg((b.h - a.h) ** 2) / 2, 6) AS acf FROM m a JOIN m b ON b.scan_id = a.scan_id AND b.ix >= a.ix AND b.iy >= a.iy GROUP BY ALL")
def acf_map_lags(spark, d):
    return rounded(spectral.autocorrelation_map(small_maps(spark, d), 8, 8))


_HOLES = "(ix * 3 + iy * 5 + scan_id) % 7 < 2"


@query("acf_map_skip_undefined", f"WITH {M}, o AS (SELECT * FROM m WHERE NOT {_HOLES}), k AS (SELECT a.scan_id, CAST(b.ix - a.ix AS INTEGER) AS a, CAST(b.iy - a.iy AS INTEGER) AS b, avg((b.h - a.h) ** 2) / 2 AS acf FROM o a JOIN o b ON b.scan_id = a.scan_id AND b.ix >= a.ix AND b.iy >= a.iy GROUP BY ALL) SELECT z.*, round(acf, 6) AS acf FROM (SELECT scan_id, ix AS a, iy AS b FROM m) z LEFT JOIN k USING (scan_id, a, b)")
def acf_map_skip_undefined(spark, d):
    """Correlations of maps with holes, over the pairs of defined heights."""
    p = small_maps(spark, d).withColumn("h", F.expr(f"CASE WHEN {_HOLES} THEN NULL ELSE h END"))
    return rounded(spectral.autocorrelation_map(p, 8, 8, undefined="skip"))


@query("acf_map_periodic", f"WITH {M} SELECT a.scan_id, CAST((b.ix - a.ix + 8) % 8 AS INTEGER) AS a, CAST((b.iy - a.iy + 8) % 8 AS INTEGER) AS b, round(avg((b.h - a.h) ** 2) / 2, 6) AS acf FROM m a JOIN m b ON b.scan_id = a.scan_id GROUP BY ALL")
def acf_map_periodic(spark, d):
    return rounded(spectral.autocorrelation_map(small_maps(spark, d), 8, 8, periodic=True))


_EVEN = f"""{P}, e AS (SELECT scan_id, min(x) AS x0, max(x) AS x1 FROM p GROUP BY scan_id), g0 AS (SELECT scan_id, CAST(k.range AS INTEGER) AS ix, x0 + k.range * (x1 - x0) / {_GRID - 1}::DOUBLE AS x FROM e, range({_GRID}) k),
 ga AS (SELECT g0.scan_id, g0.ix, g0.x, p.x AS xa, p.h AS ha FROM g0 ASOF JOIN p ON p.scan_id = g0.scan_id AND p.x <= g0.x), gb AS (SELECT g0.scan_id, g0.ix, p.x AS xb, p.h AS hb FROM g0 ASOF LEFT JOIN p ON p.scan_id = g0.scan_id AND p.x >= g0.x),
 u AS (SELECT scan_id, ix, CASE WHEN coalesce(xb, xa) > xa THEN ha + (hb - ha) * (x - xa) / (xb - xa) ELSE ha END AS h FROM ga JOIN gb USING (scan_id, ix))"""


@query("psd_nonuniform_grid", f"""WITH {_EVEN}, f AS (SELECT scan_id, CAST(k.range AS INTEGER) AS k, sum(h * w * cos(2 * pi() * k.range * ix / {_GRID})) AS re, sum(h * w * sin(2 * pi() * k.range * ix / {_GRID})) AS im FROM (SELECT *, (0.5::DOUBLE - 0.5::DOUBLE * cos(ix * (2 * pi() / {_GRID}))) * sqrt(8 / 3::DOUBLE) AS w FROM u), range({_GRID // 2}) k GROUP BY ALL)
 SELECT scan_id, k, round(k * 2 * pi() / (x1 - x0), 8) AS q, round((re * re + im * im) * (x1 - x0) / {_GRID}::DOUBLE / {_GRID} / CASE k WHEN 0 THEN 2 ELSE 1 END, 1) AS psd FROM f JOIN e USING (scan_id)""")
def psd_nonuniform_grid(spark, d):
    """Spectra of all nonuniform scans over the whole grid of wavevectors."""
    return rounded(spectral.power_spectrum_nonuniform(profiles(spark, d), n=_GRID), 1, q=8)


@query("acf_nonuniform_grid", f"WITH {_EVEN}, c AS (SELECT a.scan_id, CAST(b.ix - a.ix AS INTEGER) AS k, avg((b.h - a.h) ** 2) / 2 AS acf FROM u a JOIN u b ON b.scan_id = a.scan_id AND b.ix >= a.ix GROUP BY ALL) SELECT scan_id, k, round(k * (x1 - x0) / {_GRID}, 6) AS r, round(acf, 3) AS acf FROM c JOIN e USING (scan_id)")
def acf_nonuniform_grid(spark, d):
    """Correlations of all nonuniform scans at all distances of the grid."""
    return rounded(spectral.autocorrelation_grid(profiles(spark, d), n=_GRID), 6, acf=3)


@query("derivative_any_distance", f"WITH {L}, e AS (SELECT scan_id, ix, (0.5::DOUBLE * (lead(h, 2) OVER w + lead(h, 3) OVER w) - h) / 2.5::DOUBLE AS d FROM l WINDOW w AS (PARTITION BY scan_id ORDER BY ix)) SELECT scan_id, ix, round(d, 6) AS d FROM e WHERE d IS NOT NULL")
def derivative_any_distance(spark, d):
    """Slopes over two and a half points."""
    return rounded(stencils.line_derivative(line_scans(spark, d), 1, PIXEL, 2.5))


@query("derivative_map_any_distance", f"WITH {M} SELECT a.scan_id, a.ix, a.iy, round((0.75::DOUBLE * b.h + 0.25::DOUBLE * b2.h - a.h) / 1.25::DOUBLE, 6) AS dx, round((0.75::DOUBLE * c.h + 0.25::DOUBLE * c2.h - a.h) / 1.25::DOUBLE, 6) AS dy FROM m a JOIN m b ON b.scan_id = a.scan_id AND b.ix = a.ix + 1 AND b.iy = a.iy JOIN m b2 ON b2.scan_id = a.scan_id AND b2.ix = a.ix + 2 AND b2.iy = a.iy JOIN m c ON c.scan_id = a.scan_id AND c.ix = a.ix AND c.iy = a.iy + 1 JOIN m c2 ON c2.scan_id = a.scan_id AND c2.ix = a.ix AND c2.iy = a.iy + 2")
def derivative_map_any_distance(spark, d):
    """Slopes of maps over one and a quarter pixels."""
    return rounded(stencils.map_derivative(small_maps(spark, d), 1, (1, 1), 8, 8, scale=1.25, keys=("scan_id",)))


_SMOOTH = "f AS (SELECT scan_id, k.range AS k, sum(h * cos(2 * pi() * k.range * ix / 64)) AS re, sum(h * sin(2 * pi() * k.range * ix / 64)) AS im FROM l, range(64) k WHERE least(k.range, 64 - k.range) <= 10 GROUP BY ALL), s AS (SELECT scan_id, i.range AS ix, sum(re * cos(2 * pi() * k * i.range / 64) + im * sin(2 * pi() * k * i.range / 64)) / 64 AS h FROM f, range(64) i GROUP BY ALL)"


@query("rdq_cutoff", f"WITH {L}, {_SMOOTH}, e AS (SELECT scan_id, lead(h) OVER w - h AS a, lead(h) OVER w - 2 * h + lag(h) OVER w AS b FROM s WINDOW w AS (PARTITION BY scan_id ORDER BY ix)) SELECT scan_id, round(sqrt(avg(a * a)), 6) AS rdq, round(sqrt(avg(b * b)), 6) AS rddq FROM e GROUP BY scan_id")
def rdq_cutoff(spark, d):
    """Rms slope and curvature without wavelengths below 6.4 points."""
    p = line_scans(spark, d)
    return rounded(scalars.rdq(p, PIXEL, cutoff=6.4).join(scalars.rddq(p, PIXEL, cutoff=6.4), "scan_id"))


@query("replayed_chain", f"WITH {L}, c AS (SELECT scan_id, regr_slope(h, ix) AS b, regr_intercept(h, ix) AS a FROM l GROUP BY scan_id), t AS (SELECT scan_id, ix, 3 * (h - a - b * ix) AS h FROM l JOIN c USING (scan_id)), e AS (SELECT scan_id, lead(h) OVER (PARTITION BY scan_id ORDER BY ix) - h AS d FROM t) SELECT scan_id, round(sqrt(avg(d * d)), 6) AS rdq FROM e GROUP BY scan_id")
def replayed_chain(spark, d):
    """A chain of operators written down as rows, read back and run on all line scans."""
    chain = Chain().then("uniform", "detrend", mode="height", n=N).then("uniform", "scale", heights=3.0).then("uniform", "Rdq", pixel=PIXEL)
    return rounded(Chain.read(chain.rows(spark)).on(line_scans(spark, d)))


_GP_EDGES, _GP_AT, _GP_NOISE = [0.05, 0.4, 1.2, 2.2, 3.2], [0.1, 0.3, 0.8, 1.5, 2.5, 3.0], 0.01
_COV = [[f"exp(-((x{i} - x{j}) ** 2) / 2)" + (f" + {_GP_NOISE}::DOUBLE / n{i}" if i == j else "") for j in range(4)] for i in range(4)]
_NAMED = [[f"k{i}{j}" for j in range(4)] for i in range(4)]
_SUM = lambda parts: " + ".join(f"s{i} * {p}" for i, p in enumerate(parts))


@query("psd_gp", f"""WITH {_psd_sql(True)}, b AS (SELECT surface_id, len(list_filter({_edges(_GP_EDGES)}, lambda e: e < q)) - 1 AS bin, q, psd FROM c WHERE q <= 3.2), g AS (SELECT surface_id, bin, ln(avg(q)) AS x, ln(avg(psd)) AS y, count(*) AS n FROM b WHERE bin >= 0 GROUP BY ALL),
 w AS (SELECT surface_id, {', '.join(f'max({c}) FILTER (bin = {i}) AS {c}{i}' for i in range(4) for c in 'xyn')} FROM g GROUP BY surface_id), a AS (SELECT unnest({_edges(_GP_AT)}) AS pos),
 k AS (SELECT surface_id, pos, {', '.join(f'y{i}' for i in range(4))}, {', '.join(f'{_COV[i][j]} AS k{i}{j}' for i in range(4) for j in range(4))}, {', '.join(f'exp(-((x{i} - ln(pos)) ** 2) / 2) AS s{i}' for i in range(4))} FROM w, a)
 SELECT surface_id, pos AS x, round(exp({_SUM(cramer(_NAMED, [f'y{i}' for i in range(4)]))}), 5) AS y, round(1 - ({_SUM(cramer(_NAMED, [f's{i}' for i in range(4)]))}), 5) AS variance FROM k""")
def psd_gp(spark, d):
    """The spectra of all line scans of each container as a smooth power law, from the sums of four bins."""
    return rounded(regression.gaussian_process(_psd(spark, d), "q", "psd", _GP_AT, _GP_EDGES, ("surface_id",), noise=_GP_NOISE, log=True), 5, x=12)


_FIT = _fit_sql("t", ["1", "(ix / 64::DOUBLE)"], "scan_id, m, piece")


@query("vbm_any_statistic", f"WITH {L}, t AS (SELECT scan_id, ix, h, m, ix * m // 64 AS piece FROM l, (SELECT unnest([1, 2, 4, 8, 16]) AS m)), {_FIT} SELECT scan_id, CAST(m AS INTEGER) AS magnification, 64 / m::DOUBLE AS bandwidth, round(avg(abs(h - c0 - c1 * (ix / 64::DOUBLE))), 6) AS value FROM t JOIN f USING (scan_id, m, piece) GROUP BY ALL")
def vbm_any_statistic(spark, d):
    """Variable bandwidth by the mean absolute deviation instead of the rms height."""
    return rounded(bandwidth.variable_bandwidth(line_scans(spark, d), N, 64.0, func=lambda h: F.avg(F.abs(h))))


@query("derivative_nonuniform_distance", f"""WITH {P}, e AS (SELECT scan_id, max(x) AS b FROM p GROUP BY scan_id), s AS (SELECT scan_id, ix, x, h, x + 5 AS g FROM p JOIN e USING (scan_id) WHERE x + 5 <= b),
 a AS (SELECT s.*, p.x AS xa, p.h AS ha FROM s ASOF JOIN p ON p.scan_id = s.scan_id AND p.x <= s.g), b AS (SELECT s.scan_id, s.ix, p.x AS xb, p.h AS hb FROM s ASOF JOIN p ON p.scan_id = s.scan_id AND p.x >= s.g)
 SELECT scan_id, ix, round(x, 6) AS x, round((CASE WHEN xb > xa THEN ha + (hb - ha) * (g - xa) / (xb - xa) ELSE ha END - h) / 5, 4) AS d FROM a JOIN b USING (scan_id, ix)""")
def derivative_nonuniform_distance(spark, d):
    """Slopes of nonuniform scans over five hours, from each of their points."""
    return rounded(stencils.nonuniform_derivative_over(profiles(spark, d), 5.0), 6, d=4)

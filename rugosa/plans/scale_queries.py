"""Queries of reliability as an option, statistics of maps over scales, surfaces of given spectra and nonuniform scans' transformations."""

from __future__ import annotations

import math

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import units
from ..operators import bandwidth, detrend, kernels, spectral, transforms
from ..sources.tables import line_scans, profiles, small_maps, table
from . import container
from .catalog import _fit_sql, _log_sql, _psd, _psd_sql, L, M, N, ORACLE_SQL, P, S, query, rounded
from .fourier_queries import _AREA_EDGES, _oblong

# --- reliability as an option of the analyses ------------------------------------------------------


@query("psd_area_reliable", ORACLE_SQL["psd_area_log"].replace("psd FROM c WHERE q <=", "psd FROM c WHERE (scan_id % 3 = 2 OR q < 2 * pi() / CASE scan_id % 3 WHEN 0 THEN 3 ELSE 1.5 END) AND q <="))
def psd_area_reliable(spark, d):
    """Spectra of maps, a third of them without wavelengths below 3, another third without those below 1.5."""
    p = _oblong(spark, d)
    cutoffs = p.select("scan_id").distinct().where("scan_id % 3 < 2").select("scan_id", F.expr("CASE scan_id % 3 WHEN 0 THEN 3D ELSE 1.5D END").alias("cutoff"))
    return rounded(spectral.power_spectrum_area(p, 4, 16, 4.0, 8.0, _AREA_EDGES, reliable=cutoffs))


@query("vbm_nonuniform_reliable", f"SELECT z.* FROM ({ORACLE_SQL['vbm_nonuniform']}) z JOIN (WITH {S} SELECT scan_id, avg(dx) AS cutoff FROM s GROUP BY scan_id) c USING (scan_id) WHERE bandwidth > cutoff")
def vbm_nonuniform_reliable(spark, d):
    """Variable bandwidth of nonuniform scans at bandwidths over the mean distance of their points."""
    return rounded(bandwidth.variable_bandwidth_nonuniform(profiles(spark, d), reliable=True), 4, bandwidth=6)


# --- statistics of maps over scales ----------------------------------------------------------------

_CELLS = f"{M}, q AS (SELECT scan_id, ix, iy, h, k, ix * k // 8 AS px, iy * k // 8 AS py FROM m, (SELECT unnest([1, 2]) AS k)), {_fit_sql('q', ['1', '(ix / 8::DOUBLE)', '(iy / 8::DOUBLE)'], 'scan_id, k, px, py')}"


@query("vbm_area_any_statistic", f"""WITH {_CELLS}, g AS (SELECT scan_id, k, sqrt(avg((c1 / 8) ** 2 + (c2 / 8) ** 2)) AS gradient FROM f GROUP BY ALL), r AS (SELECT scan_id, k, avg(abs(h - (c0 + c1 * ix / 8 + c2 * iy / 8))) AS v FROM q JOIN f USING (scan_id, k, px, py) GROUP BY ALL)
 SELECT scan_id, CAST(k AS INTEGER) AS magnification, 8::DOUBLE / k AS bandwidth, round(v, 6) AS value, round(gradient, 6) AS gradient FROM r JOIN g USING (scan_id, k)""")
def vbm_area_any_statistic(spark, d):
    """Variable bandwidth of maps by the mean absolute deviation, and the gradients of the planes taken away."""
    return rounded(bandwidth.variable_bandwidth_map(small_maps(spark, d), 8, 8, 8.0, 8.0, ("scan_id",), func=lambda h: F.avg(F.abs(h)), slopes=True))


@query("vbm_profile_slopes", f"WITH {L}, e AS (SELECT scan_id, m, ix * m // 64 AS piece, regr_slope(h, ix) AS b FROM l, (SELECT unnest([1, 2, 4, 8, 16]) AS m) GROUP BY ALL), v AS ({ORACLE_SQL['vbm_profile']}) SELECT v.*, round(slope, 6) AS slope FROM v JOIN (SELECT scan_id, CAST(m AS INTEGER) AS magnification, sqrt(avg(b * b)) AS slope FROM e GROUP BY ALL) USING (scan_id, magnification)")
def vbm_profile_slopes(spark, d):
    return rounded(bandwidth.variable_bandwidth(line_scans(spark, d), N, 64.0, slopes=True))


# Maps of 8 by 4 in size, so pixels are 1 by 0.5 and rings half a unit wide.
_RINGS = f"""WITH {M}, c AS (SELECT a.scan_id, b.ix - a.ix AS u, b.iy - a.iy AS v, avg((b.h - a.h) ** 2) / 2 AS acf FROM m a JOIN m b ON b.scan_id = a.scan_id AND b.ix >= a.ix AND b.iy >= a.iy GROUP BY ALL),
 g AS (SELECT scan_id, CAST(floor(sqrt(u * u + v * v / 4) * 2 + 0.5) AS INTEGER) AS k, count(*) AS n, avg(acf) AS acf FROM c GROUP BY ALL)"""


def _rings(spark, d):
    return spectral.autocorrelation_rings(small_maps(spark, d), 8, 8, 8.0, 4.0)


@query("acf_rings_map", f"{_RINGS} SELECT scan_id, k, k / 2::DOUBLE AS r, n, round(acf, 6) AS acf FROM g")
def acf_rings_map(spark, d):
    return rounded(_rings(spark, d))


@query("scale_dep_curvature_area", f"""{_RINGS}, v AS (SELECT a.scan_id, a.k, 8 * a.acf - 2 * b.acf AS v FROM g a JOIN g b ON b.scan_id = a.scan_id AND b.k = 2 * a.k WHERE a.k > 0), w AS (SELECT *, sum(CASE WHEN v < 0 THEN 1 ELSE 0 END) OVER (PARTITION BY scan_id ORDER BY k) AS bad FROM v)
 SELECT scan_id, k, CAST(k AS DOUBLE) AS r, round(4 * sqrt(v) / (k * k), 6) AS curvature FROM w WHERE bad = 0""")
def scale_dep_curvature_area(spark, d):
    return rounded(spectral.curvature_from_area_acf(_rings(spark, d)))


@query("half_derivative_variance_area", f"{_RINGS}, t AS (SELECT scan_id, k, acf, acf * 4 / (k * k) AS y, lag(acf * 4 / (k * k)) OVER w AS z, (k - lag(k) OVER w) / 2 AS dr FROM g WHERE k > 0 WINDOW w AS (PARTITION BY scan_id ORDER BY k)) SELECT scan_id, round(min_by(acf / k * 2, k) + coalesce(sum(dr * (y + z) / 2), 0), 6) AS variance FROM t GROUP BY scan_id")
def half_derivative_variance_area(spark, d):
    return rounded(spectral.half_derivative_variance(_rings(spark, d)))


# --- surfaces of given spectra, interpolation ------------------------------------------------------


@query("synthesis_spectrum", "SELECT CAST(n_nationkey AS BIGINT) AS scan_id, CAST(x.range AS INTEGER) AS kx, CAST(y.range AS INTEGER) AS ky, round((1 + n_nationkey) / (1 + (least(x.range, 8 - x.range) * 2 * pi() / 4) ** 2 + (least(y.range, 12 - y.range) * 2 * pi() / 9) ** 2), 6) AS psd FROM nation, range(8) x, range(12) y")
def synthesis_spectrum(spark, d):
    """The spectra of random surfaces that were made to have the spectrum a table's row says."""
    n = table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("seed"), (F.col("n_nationkey") + 1).cast("double").alias("strength"))
    s = kernels.fourier_synthesis(n, 8, 12, 4.0, 9.0, psd=lambda q, row: row["strength"] / (1 + q * q), amplitude=kernels.exact)
    return rounded(spectral.spectrum_area(s, 8, 12, 4.0, 9.0).select("scan_id", F.col("kx").cast("int").alias("kx"), F.col("ky").cast("int").alias("ky"), "psd"))


def _spectral_weights() -> str:
    """Weights (value, first, second derivative) of the eight points of a line for positions at and halfway between them."""

    def slope(m: int) -> float:
        return -sum(2 * math.pi * k / 8 / 4 * math.sin(2 * math.pi * k * m / 8) for k in (1, 2, 3))

    rows = []
    for f, t in ((0, 0.0), (1, 0.5)):
        value = (1 - 3 * t**2 + 2 * t**3, 3 * t**2 - 2 * t**3, t - 2 * t**2 + t**3, t**3 - t**2)
        first = (6 * t**2 - 6 * t, 6 * t - 6 * t**2, 1 - 4 * t + 3 * t**2, 3 * t**2 - 2 * t)
        second = (12 * t - 6, 6 - 12 * t, 6 * t - 4, 6 * t - 2)
        for o in range(8):
            w = [a * (o == 0) + b * (o == 1) + c * slope(-o) + e * slope(1 - o) for a, b, c, e in (value, first, second)]
            rows.append(f"({f}, {o}, {', '.join(f'{x!r}::DOUBLE' for x in w)})")
    return f"c(f, o, v, d, e) AS (VALUES {', '.join(rows)})"


@query("interpolate_bicubic_fourier", f"""WITH {M}, {_spectral_weights()}, a AS (SELECT scan_id, k.range AS x, iy, sum(v * h) AS p, sum(d * h) AS px, sum(e * h) AS pxx FROM range(16) k JOIN c ON c.f = k.range % 2 JOIN m ON m.ix = (k.range // 2 + o) % 8 GROUP BY ALL)
 SELECT scan_id, CAST(x AS INTEGER) AS ix, CAST(k.range AS INTEGER) AS iy, round(sum(v * p), 6) AS h, round(sum(v * px), 6) AS dx, round(sum(d * p), 6) AS dy, round(sum(v * pxx), 6) AS dxx, round(sum(d * px), 6) AS dxy, round(sum(e * p), 6) AS dyy
 FROM range(16) k JOIN c ON c.f = k.range % 2 JOIN a ON a.iy = (k.range // 2 + o) % 8 GROUP BY scan_id, x, k.range""")
def interpolate_bicubic_fourier(spark, d):
    """Bicubic maps whose slopes on the grid are those of the Fourier series."""
    return rounded(kernels.interpolate_map(small_maps(spark, d), 8, 8, 2, "bicubic", slopes="fourier"))


# --- nonuniform scans ------------------------------------------------------------------------------


@query("rigid_sphere_nonuniform", f"WITH {P} SELECT a.scan_id, a.ix, round(max(b.h + sqrt(greatest(400 - (b.x - a.x) ** 2, 0)) - 20), 6) AS h FROM p a JOIN p b ON b.scan_id = a.scan_id AND b.x - a.x >= -20 AND b.x - a.x < 20 GROUP BY ALL")
def rigid_sphere_nonuniform(spark, d):
    """Nonuniform scans as a sphere of radius 20 traces them."""
    return rounded(transforms.scan_with_sphere_nonuniform(profiles(spark, d), 20.0).select("scan_id", "ix", "h"))


@query("detrend_mean_nonuniform", f"WITH {S}, m AS (SELECT scan_id, sum(dx * (h0 + h1) / 2) / sum(dx) AS c FROM s GROUP BY scan_id) SELECT scan_id, ix, round(h - c, 4) AS h FROM p JOIN m USING (scan_id)")
def detrend_mean_nonuniform(spark, d):
    return rounded(detrend.detrend_nonuniform(profiles(spark, d), "mean").select("scan_id", "ix", "h"), 4)


@query("interpolate_cubic_nonuniform")
def interpolate_cubic_nonuniform(spark, d):
    """Nonuniform scans by cubic splines, halfway between their points; no SQL, tests hold it against dense solutions."""
    p = profiles(spark, d)
    half = p.select("scan_id", "ix", ((F.col("x") + F.lead("x").over(Window.partitionBy("scan_id").orderBy("ix"))) / 2).alias("x")).where("x IS NOT NULL")
    return transforms.interpolated_cubic(p, half)


# --- lines of maps, containers ---------------------------------------------------------------------

_COLUMN = f"{M}, {_fit_sql('m', ['1', '(ix / 8::DOUBLE)', '(ix / 8::DOUBLE) * (ix / 8::DOUBLE)'], 'scan_id, iy')}"


@query("align_columns_map", f"""WITH {_COLUMN}, q AS (SELECT scan_id, ix, iy, h - c0 - c1 * ix / 8 - c2 * ix * ix / 64 AS h FROM m JOIN f USING (scan_id, iy)), c AS (SELECT scan_id, iy, avg(h) AS c FROM q GROUP BY ALL), o AS (SELECT *, avg(c) OVER (PARTITION BY scan_id) AS k FROM c)
 SELECT scan_id, ix, iy, round(h + k - c, 6) AS h FROM q JOIN o USING (scan_id, iy)""")
def align_columns_map(spark, d):
    """Lines along the other axis, without their parabolas."""
    return rounded(transforms.align_lines(small_maps(spark, d), 8, 2, "mean", ("scan_id",), "y").select("scan_id", "ix", "iy", "h"))


_IN_NM = "CASE scan_id % 3 WHEN 0 THEN 1 WHEN 1 THEN 1000 ELSE 0.1 END::DOUBLE"


@query("container_psd_units", f"WITH {_psd_sql(True)}, n AS (SELECT surface_id, scan_id, q / {_IN_NM} AS q, psd * {_IN_NM} ** 3 AS psd FROM c), o AS (WITH {_log_sql('n', 'q', 'psd', False)}) SELECT surface_id, bin, round(x, 6) AS x, round(log10(y), 6) AS y, n FROM o")
def container_psd_units(spark, d):
    """Spectra of scans in three units, averaged in nanometres; means as logarithms, for they span many decades."""
    p = _psd(spark, d).withColumn("unit", F.expr("CASE scan_id % 3 WHEN 0 THEN 'nm' WHEN 1 THEN 'µm' ELSE 'Å' END"))
    c = container.log_average(units.curves_to_unit(p, "nm", {"q": -1, "psd": 3}), "q", "psd")
    return rounded(c.withColumn("y", F.log10("y")))


@query("c1d_moment_cumulative", f"WITH o AS (WITH {_psd_sql(True)}, {_log_sql('c', 'q', 'psd', False)}), t AS (SELECT surface_id, x, y * x / pi() AS v, lag(x) OVER w AS x0, lag(y * x / pi()) OVER w AS v0 FROM o WHERE y IS NOT NULL WINDOW w AS (PARTITION BY surface_id ORDER BY x)) SELECT surface_id, round(x, 6) AS x, round(sum(coalesce((x - x0) * (v + v0) / 2, 0)) OVER (PARTITION BY surface_id ORDER BY x), 6) AS integral FROM t")
def c1d_moment_cumulative(spark, d):
    return rounded(container.profile_moment(container.log_average(_psd(spark, d), "q", "psd"), 1, cumulative=True))

"""Queries over the driver's tables, one or more for each operator, with their DuckDB equivalents."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import results, units
from ..functions.algebra import cramer, normal_equations
from ..operators import bandwidth as vb
from ..operators import bearing, detrend, geometry, kernels, reliability, scalars, spectral, stencils, tiles, transforms
from ..sources.tables import height_map, line_scans, profiles, small_maps, table
from . import container, models

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
N, SIZE, PIXEL = 64, 64.0, 1.0
LEVELS = [-0.3, -0.2, -0.1, 0.0, 0.1, 0.2, 0.3]

# --- the same surfaces in SQL ----------------------------------------------------------------------

L = "l AS (SELECT vec_id AS scan_id, label AS surface_id, CAST(unnest(range(0, len(embedding))) AS INTEGER) AS ix, CAST(unnest(embedding) AS DOUBLE) AS h FROM embeddings)"
M = L + ", m AS (SELECT scan_id, CAST(ix // 8 AS INTEGER) AS ix, CAST(ix % 8 AS INTEGER) AS iy, h FROM l)"
P = "p AS (SELECT user_id AS scan_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts) AS INTEGER) - 1 AS ix, (epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01')) / 3.6e9 AS x, value AS h FROM events)"
S = P + ", s AS (SELECT *, x1 - x0 AS dx FROM (SELECT scan_id, ix, x AS x0, h AS h0, lead(x) OVER w AS x1, lead(h) OVER w AS h1 FROM p WINDOW w AS (PARTITION BY scan_id ORDER BY ix)) WHERE x1 IS NOT NULL)"


def map_sql(name: str = "g", value: str = "l_extendedprice", unit: int = 100, where: str = "TRUE") -> str:
    return f"{name} AS (SELECT CAST(l_quantity AS INTEGER) - 1 AS ix, CAST(l_suppkey AS INTEGER) AS iy, CAST(sum(CAST(round({value} * {unit}) AS BIGINT)) AS BIGINT) / count(*) / {float(unit)}::DOUBLE AS h FROM lineitem WHERE {where} GROUP BY 1, 2)"


def query(name: str, sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = f
        if sql is not None:
            ORACLE_SQL[name] = sql
        return f

    return add


def rounded(df: DataFrame, digits: int = 6, **other: int) -> DataFrame:
    return df.select(*[F.round(c, other.get(c, digits)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def ny_of(spark: SparkSession, sf_dir: str) -> int:
    """Rows of the height map: suppliers, one aggregate of the small table."""
    return table(spark, sf_dir, "supplier").count()


NY = "(SELECT count(*) FROM supplier)"

# --- scalars ---------------------------------------------------------------------------------------


@query("rq_profile", f"WITH {L} SELECT scan_id, round(sqrt(var_pop(h)), 6) AS rq FROM l GROUP BY scan_id")
def rq_profile(spark, d):
    return rounded(scalars.rq(line_scans(spark, d)))


@query("scan_mean_min_max", f"WITH {L} SELECT scan_id, round(avg(h), 6) AS mean, round(min(h), 6) AS min, round(max(h), 6) AS max FROM l GROUP BY scan_id")
def scan_mean_min_max(spark, d):
    return rounded(scalars.basic(line_scans(spark, d)))


_MOM = ", ".join(f"round(avg(({' + '.join('*'.join(['a'] * i + ['b'] * (k - i)) for i in range(k + 1))}) / {k + 1}), {8 if k > 2 else 6}) AS m{k}" for k in (2, 3, 4))


@query("moments_linescan", f"""WITH {L}, s AS (SELECT scan_id, h AS h0, lead(h) OVER (PARTITION BY scan_id ORDER BY ix) AS h1 FROM l),
 c AS (SELECT *, avg((h0 + h1) / 2) OVER (PARTITION BY scan_id) AS m FROM s WHERE h1 IS NOT NULL), t AS (SELECT scan_id, m, h0 - m AS a, h1 - m AS b FROM c)
 SELECT scan_id, round(any_value(m), 6) AS m1, {_MOM} FROM t GROUP BY scan_id""")
def moments_linescan(spark, d):
    return rounded(scalars.moments_line(line_scans(spark, d)), m3=8, m4=8)


_D1 = f"WITH {L}, e AS (SELECT scan_id, surface_id, ix, lead(h) OVER w - h AS d1, lead(h) OVER w - 2 * h + lag(h) OVER w AS d2 FROM l WINDOW w AS (PARTITION BY scan_id ORDER BY ix))"


@query("rdq_profile", f"{_D1} SELECT scan_id, round(sqrt(avg(d1 * d1)), 6) AS rdq FROM e GROUP BY scan_id")
def rdq_profile(spark, d):
    return rounded(scalars.rdq(line_scans(spark, d), PIXEL))


@query("rddq_profile", f"{_D1} SELECT scan_id, round(sqrt(avg(d2 * d2)), 6) AS rddq FROM e GROUP BY scan_id")
def rddq_profile(spark, d):
    return rounded(scalars.rddq(line_scans(spark, d), PIXEL))


@query("nonuniform_statistics", f"WITH {S}, a AS (SELECT scan_id, sum(dx) AS l, sum(dx * (h0 + h1) / 2) AS i1, sum(dx * (h0*h0 + h0*h1 + h1*h1) / 3) AS i2, sum((h1 - h0) * (h1 - h0) / dx) AS g FROM s GROUP BY scan_id) SELECT scan_id, round(i1 / l, 6) AS mean, round(sqrt(i2 / l - (i1 / l) * (i1 / l)), 6) AS rq, round(sqrt(g / l), 4) AS rdq FROM a")
def nonuniform_statistics(spark, d):
    return rounded(scalars.nonuniform(profiles(spark, d)), rdq=4)


@query("nonuniform_rddq", f"""WITH {P}, q AS (SELECT scan_id, ix, x, 2 * ((h2 - h) / (x2 - x) - (h - h0) / (x - x0)) / (x2 - x0) AS d FROM (SELECT *, lag(x) OVER w AS x0, lag(h) OVER w AS h0, lead(x) OVER w AS x2, lead(h) OVER w AS h2 FROM p WINDOW w AS (PARTITION BY scan_id ORDER BY ix)) WHERE x0 IS NOT NULL AND x2 IS NOT NULL),
 t AS (SELECT scan_id, x, d, lead(x) OVER w AS xn, lead(d) OVER w AS dn FROM q WINDOW w AS (PARTITION BY scan_id ORDER BY ix))
 SELECT scan_id, round(log10(sqrt(sum((d*d + dn*dn) / 2 * (xn - x)) / (max(x) - min(x)))), 6) AS log_rddq FROM t GROUP BY scan_id""")
def nonuniform_rddq(spark, d):
    return rounded(scalars.nonuniform_rddq(profiles(spark, d)).select("scan_id", F.log10("rddq").alias("log_rddq")))


@query("nonuniform_moment", f"WITH {S} SELECT scan_id, round(sum(dx * (h0*h0*h0 + h0*h0*h1 + h0*h1*h1 + h1*h1*h1) / 4) / sum(dx), 4) AS moment FROM s GROUP BY scan_id")
def nonuniform_moment(spark, d):
    return rounded(scalars.nonuniform_moment(profiles(spark, d), 3), 4)


@query("nonuniform_bandwidth", f"WITH {S} SELECT scan_id, round(avg(dx), 6) AS lower, round(sum(dx), 6) AS upper FROM s GROUP BY scan_id")
def nonuniform_bandwidth(spark, d):
    return rounded(scalars.bandwidth(profiles(spark, d)))


@query("is_reentrant", f"WITH {S} SELECT scan_id, min(dx) <= 0 AS is_reentrant FROM s GROUP BY scan_id")
def is_reentrant(spark, d):
    return scalars.is_reentrant(profiles(spark, d))


@query("sq_map", f"WITH {map_sql()} SELECT round(stddev_pop(h), 4) AS sq FROM g")
def sq_map(spark, d):
    return rounded(scalars.sq(height_map(spark, d)), 4)


_G1 = map_sql() + f""", n AS (SELECT a.ix, a.iy, b.h - a.h AS dx, c.h - a.h AS dy FROM g a JOIN g b ON b.ix = a.ix + 1 AND b.iy = a.iy JOIN g c ON c.ix = a.ix AND c.iy = a.iy + 1 WHERE a.ix <= 48 AND a.iy <= {NY} - 2),
 k AS (SELECT a.ix, a.iy, b.h - 2 * a.h + b2.h AS dx, c.h - 2 * a.h + c2.h AS dy FROM g a JOIN g b ON b.ix = a.ix + 1 AND b.iy = a.iy JOIN g b2 ON b2.ix = a.ix - 1 AND b2.iy = a.iy JOIN g c ON c.ix = a.ix AND c.iy = a.iy + 1 JOIN g c2 ON c2.ix = a.ix AND c2.iy = a.iy - 1)"""


@query("rms_gradient_map", f"WITH {_G1} SELECT round(sqrt(avg(dx * dx + dy * dy)), 4) AS rms_gradient FROM n")
def rms_gradient_map(spark, d):
    return rounded(stencils.rms_gradient(height_map(spark, d), (1, 1), 50, ny_of(spark, d)), 4)


@query("rms_laplacian_map", f"WITH {_G1} SELECT round(sqrt(avg((dx + dy) * (dx + dy))), 4) AS rms_laplacian, round(sqrt(avg((dx + dy) * (dx + dy))) / 2, 4) AS rms_curvature FROM k")
def rms_laplacian_map(spark, d):
    return rounded(stencils.rms_laplacian(height_map(spark, d), (1, 1), 50, ny_of(spark, d)), 4)


@query("derivative_map", f"WITH {M} SELECT a.scan_id, a.ix, a.iy, round(b.h - a.h, 6) AS dx, round(c.h - a.h, 6) AS dy FROM m a JOIN m b ON b.scan_id = a.scan_id AND b.ix = a.ix + 1 AND b.iy = a.iy JOIN m c ON c.scan_id = a.scan_id AND c.ix = a.ix AND c.iy = a.iy + 1")
def derivative_map(spark, d):
    return rounded(stencils.map_derivative(small_maps(spark, d), 1, (1, 1), 8, 8, keys=("scan_id",)))


@query("derivative_third_linescan", f"WITH {L}, e AS (SELECT scan_id, ix, lead(h, 4) OVER w - 3 * lead(h, 2) OVER w + 3 * h - lag(h, 2) OVER w AS d FROM l WINDOW w AS (PARTITION BY scan_id ORDER BY ix)) SELECT scan_id, ix, round(d / 8, 6) AS d FROM e WHERE d IS NOT NULL")
def derivative_third_linescan(spark, d):
    return rounded(stencils.line_derivative(line_scans(spark, d), 3, PIXEL, 2))


@query("derivative_nonuniform", f"WITH {P} SELECT scan_id, ix, round((lead(h) OVER w - h) / (lead(x) OVER w - x), 2) AS d1 FROM p WINDOW w AS (PARTITION BY scan_id ORDER BY ix)")
def derivative_nonuniform(spark, d):
    return rounded(stencils.nonuniform_derivative(profiles(spark, d)).select("scan_id", "ix", "d1"), 2)


@query("triangle_moments_map", f"""WITH {M}, q AS (SELECT a.h AS a, b.h AS b, c.h AS c, d.h AS d, a.scan_id FROM m a JOIN m b ON b.scan_id = a.scan_id AND b.ix = a.ix + 1 AND b.iy = a.iy JOIN m c ON c.scan_id = a.scan_id AND c.ix = a.ix AND c.iy = a.iy + 1 JOIN m d ON d.scan_id = a.scan_id AND d.ix = a.ix + 1 AND d.iy = a.iy + 1),
 t AS (SELECT scan_id, a AS x, b AS y, c AS z FROM q UNION ALL SELECT scan_id, b, d, c FROM q)
 SELECT scan_id, round(avg((x + y + z) / 3), 6) AS m1, round(avg((x*x + y*y + z*z + x*y + y*z + x*z) / 6), 6) AS m2, round(avg((x**3 + y**3 + z**3 + x*x*y + x*x*z + y*y*x + y*y*z + z*z*x + z*z*y + x*y*z) / 10), 8) AS m3, round(avg((x**4 + y**4 + z**4 + x**3*y + x**3*z + y**3*x + y**3*z + z**3*x + z**3*y + x*x*y*y + y*y*z*z + x*x*z*z + x*x*y*z + x*y*y*z + x*y*z*z) / 15), 8) AS m4 FROM t GROUP BY scan_id""")
def triangle_moments_map(spark, d):
    return rounded(scalars.moments_map(bearing.triangles(small_maps(spark, d), ("scan_id",)), ("scan_id",)), m3=8, m4=8)


# --- trends ----------------------------------------------------------------------------------------


def _fit_sql(source: str, basis: list[str], keys: str = "scan_id") -> str:
    sums, m, b = normal_equations(basis, "h")
    return f"f AS (SELECT {keys}, {', '.join(f'{x} AS c{i}' for i, x in enumerate(cramer(m, b)))} FROM (SELECT {keys}, {', '.join(f'{v} AS {k}' for k, v in sums.items())} FROM {source} GROUP BY ALL))"


_X, _XX = "(ix / 64::DOUBLE)", "((ix / 64::DOUBLE) * (ix / 64::DOUBLE))"
for _mode, _sql in {
    "center": f"WITH {L} SELECT scan_id, ix, round(h - avg(h) OVER (PARTITION BY scan_id), 6) AS h FROM l",
    "median": f"WITH {L} SELECT scan_id, ix, round(h - quantile_cont(h, 0.5) OVER (PARTITION BY scan_id), 6) AS h FROM l",
    "height": f"WITH {L}, {_fit_sql('l', ['1', _X])} SELECT scan_id, ix, round(h - (c0 + c1 * {_X}), 6) AS h FROM l JOIN f USING (scan_id)",
    "slope": f"WITH {L}, f AS (SELECT scan_id, avg(h) AS m, (max_by(h, ix) - min_by(h, ix)) / 63 * 64 AS c1 FROM l GROUP BY scan_id) SELECT scan_id, ix, round(h - (m - c1 * 63 / 128 + c1 * {_X}), 6) AS h FROM l JOIN f USING (scan_id)",
    "curvature": f"WITH {L}, {_fit_sql('l', ['1', _X, _XX])} SELECT scan_id, ix, round(h - (c0 + c1 * {_X} + c2 * {_XX}), 6) AS h FROM l JOIN f USING (scan_id)",
}.items():
    query(f"detrend_{_mode}_linescan", _sql)(lambda spark, d, mode=_mode: rounded(detrend.detrend(line_scans(spark, d), mode, N).select("scan_id", "ix", "h")))

@query("plane_fit_map", f"WITH {map_sql()}, r AS (SELECT ix / 50::DOUBLE AS x, iy / CAST({NY} AS DOUBLE) AS y, h FROM g), {_fit_sql('r', ['1', 'x', 'y'], '1 AS one')} SELECT round(c0, 3) AS c0, round(c1, 3) AS c1, round(c2, 3) AS c2 FROM f")
def plane_fit_map(spark, d):
    return rounded(detrend.fit(height_map(spark, d), detrend.map_basis(1, 50, ny_of(spark, d)), ()), 3)


@query("detrend_quadratic_map", f"WITH {M}, {_fit_sql('m', ['1', '(ix / 8::DOUBLE)', '(iy / 8::DOUBLE)', '((ix / 8::DOUBLE) * (ix / 8::DOUBLE))', '((iy / 8::DOUBLE) * (iy / 8::DOUBLE))', '((ix / 8::DOUBLE) * (iy / 8::DOUBLE))'])} SELECT scan_id, ix, iy, round(h - (c0 + c1 * ix / 8 + c2 * iy / 8 + c3 * ix * ix / 64 + c4 * iy * iy / 64 + c5 * ix * iy / 64), 5) AS h FROM m JOIN f USING (scan_id)")
def detrend_quadratic_map(spark, d):
    return rounded(detrend.detrend_map(small_maps(spark, d), 2, 8, 8, keys=("scan_id",)).select("scan_id", "ix", "iy", "h"), 5)


@query("nonuniform_polyfit", f"""WITH {S}, q AS (SELECT scan_id, sum(dx) AS a, sum((x1*x1 - x0*x0) / 2) AS b, sum((x1*x1*x1 - x0*x0*x0) / 3) AS c, sum(dx * (h0 + h1) / 2) AS t0, sum(dx * (x0 * (2 * h0 + h1) + x1 * (h0 + 2 * h1)) / 6) AS t1 FROM s GROUP BY scan_id)
 SELECT scan_id, round((t0 * c - t1 * b) / (a * c - b * b), 4) AS c0, round((a * t1 - b * t0) / (a * c - b * b), 6) AS c1 FROM q""")
def nonuniform_polyfit(spark, d):
    return rounded(detrend.nonuniform_fit(profiles(spark, d), 1), 6, c0=4)


@query("checkerboard_linescan", f"WITH {L}, q AS (SELECT *, ix * 4 // 64 AS piece FROM l), {_fit_sql('q', ['1', _X], 'scan_id, piece')} SELECT scan_id, ix, round(h - (c0 + c1 * {_X}), 6) AS h FROM q JOIN f USING (scan_id, piece)")
def checkerboard_linescan(spark, d):
    return rounded(vb.checkerboard_line(line_scans(spark, d), N, 4).select("scan_id", "ix", "h"))


@query("checkerboard_map", f"WITH {M}, q AS (SELECT *, ix * 2 // 8 AS px, iy * 2 // 8 AS py FROM m), {_fit_sql('q', ['1', '(ix / 8::DOUBLE)', '(iy / 8::DOUBLE)'], 'scan_id, px, py')} SELECT scan_id, ix, iy, round(h - (c0 + c1 * ix / 8 + c2 * iy / 8), 6) AS h FROM q JOIN f USING (scan_id, px, py)")
def checkerboard_map(spark, d):
    return rounded(vb.checkerboard_map(small_maps(spark, d), 8, 8, (2, 2), keys=("scan_id",)).select("scan_id", "ix", "iy", "h"))


# --- transformations -------------------------------------------------------------------------------


@query("to_unit", f"WITH {P} SELECT scan_id, ix, round(x * 1e6, 1) AS x, round(h * 1e6, 0) AS h FROM p")
def to_unit(spark, d):
    p = units.to_unit(profiles(spark, d), "m", "µm")
    return rounded(p, 1, h=0)


@query("scale_positions", f"WITH {P} SELECT scan_id, ix, round(x * 0.5, 6) AS x, round(h * 3, 5) AS h FROM p")
def scale_positions(spark, d):
    return rounded(transforms.scale(profiles(spark, d), 3, 0.5), 6, h=5)


@query("transpose_map", f"WITH {M} SELECT scan_id, iy AS ix, ix AS iy, round(h, 6) AS h FROM m")
def transpose_map(spark, d):
    return rounded(transforms.transpose(small_maps(spark, d)))


@query("translate_map", f"WITH {M} SELECT scan_id, CAST((ix + 3) % 8 AS INTEGER) AS ix, CAST((iy + 6) % 8 AS INTEGER) AS iy, round(h, 6) AS h FROM m")
def translate_map(spark, d):
    return rounded(transforms.translate(small_maps(spark, d), 8, 8, (3, -2)))


@query("superpose_maps", f"WITH {map_sql('a')}, {map_sql('b', 'l_discount', 10000)} SELECT ix, iy, a.h + b.h AS h FROM a JOIN b USING (ix, iy)")
def superpose_maps(spark, d):
    return transforms.superpose(height_map(spark, d), height_map(spark, d, value="l_discount", unit=10000))


@query("plastic_area", f"WITH {map_sql('a', 'l_discount', 100)} SELECT count(*) FILTER (h <> 0) * 0.25::DOUBLE AS plastic_area FROM a")
def plastic_area(spark, d):
    return transforms.plastic_area(height_map(spark, d, value="l_discount", unit=100), 0.25, ())


@query("mirror_stitch_map", f"WITH {M}, k AS (SELECT unnest([0, 0, 1, 1]) AS a, unnest([0, 1, 0, 1]) AS b) SELECT scan_id, CAST(CASE a WHEN 0 THEN ix ELSE 15 - ix END AS INTEGER) AS ix, CAST(CASE b WHEN 0 THEN iy ELSE 15 - iy END AS INTEGER) AS iy, round(h, 6) AS h FROM m, k")
def mirror_stitch_map(spark, d):
    return rounded(transforms.mirror_stitch(small_maps(spark, d), 8, 8))


_HOLES = "l_returnflag = 'R' AND l_shipdate < TIMESTAMP '1996-01-01'"


@query("fill_undefined_map", f"WITH {map_sql(where=_HOLES)}, k AS (SELECT CAST(x.range AS INTEGER) AS ix, CAST(y.range AS INTEGER) AS iy FROM range(0, 50) x, range(0, {NY}) y) SELECT ix, iy, coalesce(h, -1.0::DOUBLE) AS h FROM k LEFT JOIN g USING (ix, iy)")
def fill_undefined_map(spark, d):
    holes = height_map(spark, d, "l_returnflag = 'R' AND l_shipdate < timestamp_ntz'1996-01-01 00:00:00'")
    return transforms.fill_undefined(transforms.complete_grid(holes, 50, 0, ny_of(spark, d) - 1), -1.0)


@query("downsample_nth_map", f"WITH {M} SELECT scan_id, CAST(ix // 2 AS INTEGER) AS ix, CAST(iy // 3 AS INTEGER) AS iy, round(h, 6) AS h FROM m WHERE ix % 2 = 0 AND iy % 3 = 0 AND iy < 6")
def downsample_nth_map(spark, d):
    return rounded(transforms.downsample(small_maps(spark, d), (2, 3), 8, 8, "nth", ("scan_id",)))


@query("downsample_average_map", f"WITH {M} SELECT scan_id, CAST(ix // 2 AS INTEGER) AS ix, CAST(iy // 3 AS INTEGER) AS iy, round(avg(h), 6) AS h FROM m WHERE iy < 6 GROUP BY ALL")
def downsample_average_map(spark, d):
    return rounded(transforms.downsample(small_maps(spark, d), (2, 3), 8, 8, "average", ("scan_id",)))


_HANN = "((0.5::DOUBLE - 0.5::DOUBLE * cos(ix * (2 * pi() / 64))) * sqrt(8 / 3::DOUBLE))"


@query("hann_window", f"WITH {L} SELECT scan_id, ix, round(h * {_HANN}, 6) AS h FROM l")
def hann_window(spark, d):
    return rounded(transforms.window(line_scans(spark, d), N).select("scan_id", "ix", "h"))


@query("radial_window", f"WITH {M}, w AS (SELECT a.range AS ix, b.range AS iy, CASE WHEN sqrt((a.range - 4) ** 2 + (b.range - 4) ** 2) < 4 THEN 0.5 + 0.5 * cos(sqrt((a.range - 4) ** 2 + (b.range - 4) ** 2) * pi() / 4) ELSE 0 END AS w FROM range(8) a, range(8) b), n AS (SELECT sqrt(64 / sum(w * w)) AS n FROM w) SELECT scan_id, m.ix, m.iy, round(h * w * n, 6) AS h FROM m JOIN w ON w.ix = m.ix AND w.iy = m.iy, n")
def radial_window(spark, d):
    return rounded(transforms.radial_hann(small_maps(spark, d), 8, 8, 8.0, 8.0))


@query("to_uniform", f"""WITH {P}, e AS (SELECT scan_id, min(x) AS x0, max(x) AS x1 FROM p GROUP BY scan_id),
 g AS (SELECT scan_id, CAST(k.range AS INTEGER) AS ix, x0 + k.range * (x1 - x0) / 49::DOUBLE AS x FROM e, range(50) k),
 a AS (SELECT g.scan_id, g.ix, g.x, p.x AS xa, p.h AS ha FROM g ASOF JOIN p ON p.scan_id = g.scan_id AND p.x <= g.x),
 b AS (SELECT g.scan_id, g.ix, p.x AS xb, p.h AS hb FROM g ASOF LEFT JOIN p ON p.scan_id = g.scan_id AND p.x >= g.x)
 SELECT scan_id, ix, round(x, 6) AS x, round(CASE WHEN coalesce(xb, xa) > xa THEN ha + (hb - ha) * (x - xa) / (xb - xa) ELSE ha END, 4) AS h FROM a JOIN b USING (scan_id, ix)""")
def to_uniform(spark, d):
    return rounded(transforms.to_uniform(profiles(spark, d), 50), 6, h=4)


@query("align_lines_map", f"""WITH {M}, f AS (SELECT scan_id, ix, regr_slope(h, iy / 8::DOUBLE) AS b, regr_intercept(h, iy / 8::DOUBLE) AS a FROM m GROUP BY ALL),
 q AS (SELECT scan_id, ix, iy, h - a - b * (iy / 8::DOUBLE) AS h FROM m JOIN f USING (scan_id, ix)), c AS (SELECT scan_id, ix, quantile_cont(h, 0.5) AS c FROM q GROUP BY ALL), o AS (SELECT *, avg(c) OVER (PARTITION BY scan_id) AS k FROM c)
 SELECT scan_id, ix, iy, round(h + k - c, 6) AS h FROM q JOIN o USING (scan_id, ix)""")
def align_lines_map(spark, d):
    return rounded(transforms.align_lines(small_maps(spark, d), 8, keys=("scan_id",)).select("scan_id", "ix", "iy", "h"))


_HOLE = "ix BETWEEN 1 AND 62 AND (ix * 7 + scan_id) % 5 < 2"


@query("fill_1d_harmonic", f"""WITH {L}, q AS (SELECT scan_id, ix, CASE WHEN {_HOLE} THEN NULL ELSE h END AS h FROM l),
 w AS (SELECT *, last_value(CASE WHEN h IS NOT NULL THEN ix END IGNORE NULLS) OVER a AS ia, last_value(h IGNORE NULLS) OVER a AS ha, first_value(CASE WHEN h IS NOT NULL THEN ix END IGNORE NULLS) OVER b AS ib, first_value(h IGNORE NULLS) OVER b AS hb FROM q
  WINDOW a AS (PARTITION BY scan_id ORDER BY ix ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), b AS (PARTITION BY scan_id ORDER BY ix ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
 SELECT scan_id, ix, round(coalesce(h, ha + (hb - ha) * (ix - ia) / (ib - ia)), 6) AS h FROM w""")
def fill_1d_harmonic(spark, d):
    p = line_scans(spark, d).withColumn("h", F.expr(f"CASE WHEN {_HOLE} THEN NULL ELSE h END"))
    return rounded(transforms.interpolate_undefined_line(p).select("scan_id", "ix", "h"))


@query("rigid_sphere_scan", f"WITH {L} SELECT a.scan_id, a.ix, round(max(b.h + sqrt(25 - (b.ix - a.ix) ** 2) - 5), 6) AS h FROM l a JOIN l b ON b.scan_id = a.scan_id AND abs(b.ix - a.ix) < 5 GROUP BY a.scan_id, a.ix")
def rigid_sphere_scan(spark, d):
    return rounded(transforms.scan_with_sphere(line_scans(spark, d), 5.0, PIXEL).select("scan_id", "ix", "h"))


_OTHER = {"l_extendedprice": 100, "l_tax": 10_000}


@query("equal_surfaces", f"""WITH {map_sql('a')}, {map_sql('b', 'l_tax', 10_000)}, o AS (SELECT ix, iy, a.h, b.h AS g FROM a FULL JOIN b USING (ix, iy)), k AS (SELECT unnest([0, 1]) AS same)
 SELECT CAST(same AS INTEGER) AS same, bool_and(CASE same WHEN 1 THEN abs(h - h * (1 + 1e-7)) <= 1e-8 + 1e-5 * abs(h) ELSE abs(h - g) <= 1e-8 + 1e-5 * abs(g) END) AS equal FROM o, k GROUP BY same""")
def equal_surfaces(spark, d):
    """Two columns as maps, which differ, and one against itself within the tolerance."""
    a, b = (height_map(spark, d, value=v, unit=u) for v, u in _OTHER.items())
    answers = [transforms.equal(a, o, ("ix", "iy")).withColumn("same", F.lit(i)) for i, o in ((0, b), (1, a.withColumn("h", F.col("h") * (1 + 1e-7))))]
    return answers[0].unionByName(answers[1]).select("same", "equal")


@query("mask_nonfinite", f"WITH {L} SELECT surface_id, count(*) FILTER (ix % 7 = 0) AS undefined, round(avg(CASE WHEN ix % 7 = 0 THEN NULL ELSE h END), 6) AS mean FROM l GROUP BY surface_id")
def mask_nonfinite(spark, d):
    p = line_scans(spark, d).withColumn("h", F.when(F.col("ix") % 7 == 0, F.lit(float("nan"))).otherwise(F.col("h")))
    m = transforms.mask_nonfinite(p)
    return rounded(m.groupBy("surface_id").agg(F.count_if(F.col("h").isNull()).alias("undefined"), F.avg("h").alias("mean")))


# --- spectra ---------------------------------------------------------------------------------------


def _psd_sql(tapered: bool) -> str:
    w = _HANN if tapered else "1"
    return f"{L}, f AS (SELECT scan_id, surface_id, CAST(k.range AS INTEGER) AS k, sum(h * {w} * cos(2 * pi() * k.range * ix / 64)) AS re, sum(h * {w} * sin(2 * pi() * k.range * ix / 64)) AS im FROM l, range(32) k GROUP BY ALL), c AS (SELECT scan_id, surface_id, k, k * (2 * pi() / 64) AS q, (re * re + im * im) / 64 / CASE k WHEN 0 THEN 2 ELSE 1 END AS psd FROM f)"


def _psd(spark, d, tapered=True):
    return spectral.power_spectrum(line_scans(spark, d), N, SIZE, tapered, ("surface_id", "scan_id"))


@query("psd_profile_raw", f"WITH {_psd_sql(False)} SELECT scan_id, k, round(psd, 6) AS psd FROM c")
def psd_profile_raw(spark, d):
    return rounded(_psd(spark, d, False).select("scan_id", F.col("k").cast("int").alias("k"), "psd"))


EDGES = spectral.grid_edges("log", 2 * math.pi * 2 / SIZE, math.pi)
_EDGES = "[" + ", ".join(f"{e!r}::DOUBLE" for e in EDGES) + "]"


def _bins_sql(source: str, x: str, y: str, keys: str) -> str:
    return f"b AS (SELECT {keys}, len(list_filter({_EDGES}, lambda e: e < {x})) - 1 AS bin, {x} AS x, {y} AS y FROM {source}), a AS (SELECT {keys}, bin, avg(x) AS x, avg(y) AS y, var_pop(y) AS var, count(*) AS n FROM b WHERE bin >= 0 AND x <= {EDGES[-1]!r}::DOUBLE GROUP BY ALL), z AS (SELECT DISTINCT {keys}, CAST(r.range AS BIGINT) AS bin FROM {source}, range({len(EDGES) - 1}) r)"


@query("psd_profile_log", f"WITH {_psd_sql(True)}, {_bins_sql('c', 'q', 'psd', 'surface_id')} SELECT z.surface_id, CAST(z.bin AS INTEGER) AS bin, round(x, 6) AS x, round(y, 6) AS y, round(var, 6) AS var, n FROM z LEFT JOIN a ON a.surface_id = z.surface_id AND a.bin = z.bin")
def psd_profile_log(spark, d):
    return rounded(spectral.bin_average(_psd(spark, d), "q", "psd", EDGES, ("surface_id",)))


@query("psd_area_radial", f"""WITH {M}, a AS (SELECT scan_id, iy, kx.range AS kx, sum(h * cos(2 * pi() * kx.range * ix / 8)) AS re, -sum(h * sin(2 * pi() * kx.range * ix / 8)) AS im FROM m, range(8) kx GROUP BY ALL),
 b AS (SELECT scan_id, kx, ky.range AS ky, sum(re * cos(2 * pi() * ky.range * iy / 8) + im * sin(2 * pi() * ky.range * iy / 8)) AS re, sum(im * cos(2 * pi() * ky.range * iy / 8) - re * sin(2 * pi() * ky.range * iy / 8)) AS im FROM a, range(8) ky GROUP BY ALL)
 SELECT scan_id, CAST(least(kx, 8 - kx) ** 2 + least(ky, 8 - ky) ** 2 AS INTEGER) AS r2, count(*) AS n, round(avg((re * re + im * im) / 64), 6) AS psd FROM b GROUP BY ALL""")
def psd_area_radial(spark, d):
    return rounded(spectral.psd_area(small_maps(spark, d), 8, 8).withColumn("r2", F.col("r2").cast("int")))


_Q = [0.05, 0.2, 1.0]


@query("psd_nonuniform_brute", f"""WITH {S}, t AS (SELECT scan_id, dx, (x0 + x1) / 2 AS xm, (h0 + h1) / 2 AS y0, (h1 - h0) / 2 AS y1, q, q * dx / 2 AS z FROM s, (SELECT unnest([{', '.join(f'{q}::DOUBLE' for q in _Q)}]) AS q)),
 k AS (SELECT scan_id, q, dx, xm, dx * y0 * CASE WHEN abs(z) < 1e-6 THEN 1 - z * z / 6 ELSE sin(z) / z END AS a, dx * y1 * CASE WHEN abs(z) < 1e-3 THEN -z / 3 + z * z * z / 30 ELSE (cos(z) - sin(z) / z) / z END AS b FROM t)
 SELECT scan_id, q, round(((sum(a * cos(q * xm) + b * sin(q * xm))) ** 2 + (sum(b * cos(q * xm) - a * sin(q * xm))) ** 2) / sum(dx), 3) AS psd FROM k GROUP BY ALL""")
def psd_nonuniform_brute(spark, d):
    return rounded(spectral.psd_nonuniform(profiles(spark, d), _Q), 3, q=6)


_ACF = f"{L}, c AS (SELECT a.scan_id, a.surface_id, CAST(b.ix - a.ix AS INTEGER) AS k, avg((b.h - a.h) ** 2) / 2 AS acf FROM l a JOIN l b ON b.scan_id = a.scan_id AND b.ix >= a.ix GROUP BY ALL)"


def _acf(spark, d):
    return spectral.autocorrelation(line_scans(spark, d), PIXEL, ("surface_id", "scan_id"))


@query("acf_profile_raw", f"WITH {_ACF} SELECT scan_id, k, round(acf, 6) AS acf FROM c")
def acf_profile_raw(spark, d):
    return rounded(_acf(spark, d).select("scan_id", "k", "acf"))


@query("acf_profile_periodic", f"WITH {L}, c AS (SELECT a.scan_id, CAST((b.ix - a.ix + 64) % 64 AS INTEGER) AS k, avg((b.h - a.h) ** 2) / 2 AS acf FROM l a JOIN l b ON b.scan_id = a.scan_id GROUP BY ALL) SELECT scan_id, k, round(acf, 6) AS acf FROM c WHERE k < 32")
def acf_profile_periodic(spark, d):
    return rounded(spectral.autocorrelation_periodic(line_scans(spark, d), PIXEL, N).select("scan_id", "k", "acf"))


@query("acf_area_radial", f"""WITH {M}, c AS (SELECT a.scan_id, b.ix - a.ix AS u, b.iy - a.iy AS v, avg((b.h - a.h) ** 2) / 2 AS acf FROM m a JOIN m b ON b.scan_id = a.scan_id AND b.ix >= a.ix AND b.iy >= a.iy GROUP BY ALL)
 SELECT scan_id, CAST(u * u + v * v AS INTEGER) AS r2, count(*) AS n, round(avg(acf), 6) AS acf FROM c GROUP BY ALL""")
def acf_area_radial(spark, d):
    return rounded(spectral.autocorrelation_area(small_maps(spark, d), 8, 8))


@query("acf_nonuniform_brute", f"""WITH {S}, g AS (SELECT *, (h1 - h0) / dx AS g, sum(dx) OVER (PARTITION BY scan_id) AS l FROM s),
 j AS (SELECT a.scan_id, r, a.l, greatest(a.x0 + r, b.x0) AS lo, least(a.x1 + r, b.x1) AS hi, a.x0, a.h0, a.g, b.x0 AS y0, b.h0 AS e0, b.g AS f FROM g a, (SELECT unnest([1.0::DOUBLE, 10.0, 50.0]) AS r) JOIN g b ON b.scan_id = a.scan_id AND greatest(a.x0 + r, b.x0) < least(a.x1 + r, b.x1)),
 k AS (SELECT scan_id, r, l, hi - lo AS d, e0 + f * (lo - y0) - h0 - g * (lo - r - x0) AS u, e0 + f * (hi - y0) - h0 - g * (hi - r - x0) AS v FROM j)
 SELECT scan_id, r, round(sum(d * (u*u + u*v + v*v) / 6) / (max(l) - any_value(r)), 4) AS acf FROM k GROUP BY scan_id, r""")
def acf_nonuniform_brute(spark, d):
    return rounded(spectral.autocorrelation_nonuniform(profiles(spark, d), [1.0, 10.0, 50.0]), 4)


@query("scale_dep_slope", f"WITH {_ACF} SELECT scan_id, k, CAST(k AS DOUBLE) AS r, round(sqrt(2 * acf) / k, 6) AS slope FROM c WHERE k > 0")
def scale_dep_slope(spark, d):
    return rounded(spectral.slope_from_acf(_acf(spark, d)).select("scan_id", "k", "r", "slope"))


@query("scale_dep_curvature", f"WITH {_ACF}, v AS (SELECT a.scan_id, a.k, 8 * a.acf - 2 * b.acf AS v FROM c a JOIN c b ON b.scan_id = a.scan_id AND b.k = 2 * a.k WHERE a.k BETWEEN 1 AND 31), w AS (SELECT *, sum(CASE WHEN v < 0 THEN 1 ELSE 0 END) OVER (PARTITION BY scan_id ORDER BY k) AS bad FROM v) SELECT scan_id, k, round(sqrt(v) / (k * k), 6) AS curvature FROM w WHERE bad = 0")
def scale_dep_curvature(spark, d):
    return rounded(spectral.curvature_from_acf(_acf(spark, d).drop("surface_id"), N).select("scan_id", "k", "curvature"))


@query("psd_integral", f"WITH {_psd_sql(True)} SELECT scan_id, round(2 * sum(psd) / 64, 6) AS variance, round(2 * sum(psd * q * q) / 64, 6) AS slope_variance FROM c GROUP BY scan_id")
def psd_integral(spark, d):
    p = _psd(spark, d)
    height, slope = (spectral.integrate_psd(p, SIZE, f).withColumnRenamed("integral", c) for f, c in (("1D", "variance"), ("q * q", "slope_variance")))
    return rounded(height.join(slope, "scan_id"))


@query("half_derivative_variance", f"WITH {_ACF}, t AS (SELECT scan_id, k, acf, acf / (k * k) AS y, lag(acf / (k * k)) OVER (PARTITION BY scan_id ORDER BY k) AS z FROM c WHERE k > 0) SELECT scan_id, round(min_by(acf / k, k) + coalesce(sum((y + z) / 2), 0), 6) AS variance FROM t GROUP BY scan_id")
def half_derivative_variance(spark, d):
    return rounded(spectral.half_derivative_variance(_acf(spark, d)))


# --- scales ----------------------------------------------------------------------------------------

_VB = f"{L}, q AS (SELECT scan_id, surface_id, ix, h, m, ix * m // 64 AS piece FROM l, (SELECT unnest([1, 2, 4, 8, 16]) AS m)), e AS (SELECT scan_id, surface_id, m, piece, count(h) AS c, greatest(regr_syy(h, ix) - coalesce(regr_sxy(h, ix) ** 2 / regr_sxx(h, ix), 0), 0) AS r FROM q GROUP BY ALL), v AS (SELECT scan_id, surface_id, m, 64::DOUBLE / m AS bandwidth, sqrt(sum(r) / sum(c)) AS rms FROM e GROUP BY ALL)"


@query("vbm_profile", f"WITH {_VB} SELECT scan_id, CAST(m AS INTEGER) AS magnification, bandwidth, round(rms, 6) AS rms FROM v")
def vbm_profile(spark, d):
    return rounded(vb.variable_bandwidth(line_scans(spark, d), N, SIZE))


@query("vbm_area", f"""WITH {M}, q AS (SELECT scan_id, ix, iy, h, k, ix * k // 8 AS px, iy * k // 8 AS py FROM m, (SELECT unnest([1, 2]) AS k)), {_fit_sql('q', ['1', '(ix / 8::DOUBLE)', '(iy / 8::DOUBLE)'], 'scan_id, k, px, py')}
 SELECT scan_id, CAST(k AS INTEGER) AS magnification, 8::DOUBLE / k AS bandwidth, round(sqrt(avg((h - (c0 + c1 * ix / 8 + c2 * iy / 8)) ** 2)), 6) AS rms FROM q JOIN f USING (scan_id, k, px, py) GROUP BY ALL""")
def vbm_area(spark, d):
    return rounded(vb.variable_bandwidth_map(small_maps(spark, d), 8, 8, 8.0, 8.0, ("scan_id",)))


def _pieces_sql(powers: str) -> str:
    """Integrals of straight segments over the pieces of nonuniform scans that they overlap."""
    return f"""{S}, e AS (SELECT *, min(x0) OVER w AS a, max(x1) OVER w - min(x0) OVER w AS l, count(*) OVER w + 1 AS n, avg(h0) OVER w AS hm FROM s WINDOW w AS (PARTITION BY scan_id)),
 k AS (SELECT *, unnest({powers}) AS m FROM e WHERE l > 0),
 c0 AS (SELECT *, unnest(range(CAST(least(floor((x0 - a) * m / l), m - 1) AS BIGINT), CAST(least(floor((x1 - a) * m / l), m - 1) AS BIGINT) + 1)) AS piece FROM k),
 c1 AS (SELECT *, l / m AS size, a + (piece + 0.5::DOUBLE) * l / m AS centre FROM c0),
 c2 AS (SELECT *, greatest(x0 - centre, -size / 2) AS u0, least(x1 - centre, size / 2) AS u1 FROM c1),
 c3 AS (SELECT scan_id, m, piece, size, n, u0, u1, u1 - u0 AS d, h0 - hm + CASE WHEN dx > 0 THEN (u0 + centre - x0) / dx * (h1 - h0) ELSE 0 END AS h0, h0 - hm + CASE WHEN dx > 0 THEN (u1 + centre - x0) / dx * (h1 - h0) ELSE 0 END AS h1 FROM c2 WHERE u1 - u0 > 1e-6 OR (u0 > -size / 2 AND u1 < size / 2)),
 i AS (SELECT scan_id, m, piece, size, n, count(*) + 1 AS points, sum(d) AS w, sum(d * (u0 + u1) / 2) AS u, sum(d * (u0 * u0 + u0 * u1 + u1 * u1) / 3) AS uu, sum(d * (h0 + h1) / 2) AS h, sum(d * (h0 * h0 + h0 * h1 + h1 * h1) / 3) AS hh, sum(d * (u0 * (2 * h0 + h1) + u1 * (h0 + 2 * h1)) / 6) AS uh FROM c3 GROUP BY ALL),
 t AS (SELECT *, coalesce((uh - u * h / w) / nullif(uu - u * u / w, 0), 0) AS tilt FROM i),
 r AS (SELECT scan_id, m, piece, size, n, points, tilt, sqrt(greatest((hh - h * h / w - tilt * (uh - u * h / w)) / w, 0)) AS rms FROM t)"""


@query("vbm_nonuniform", f"""WITH {_pieces_sql("list_transform(range(0, CAST(floor(log2(n)) AS BIGINT) + 1), lambda j: CAST(pow(2, j) AS BIGINT))")},
 v AS (SELECT scan_id, m, size, n, avg(rms) AS rms, min(points) AS fewest FROM r GROUP BY ALL),
 b AS (SELECT *, coalesce(min(fewest) OVER (PARTITION BY scan_id ORDER BY m ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), n) AS before FROM v)
 SELECT scan_id, CAST(m AS INTEGER) AS magnification, round(size, 6) AS bandwidth, round(rms, 4) AS rms FROM b WHERE before >= 4""")
def vbm_nonuniform(spark, d):
    return rounded(vb.variable_bandwidth_nonuniform(profiles(spark, d)), 4, bandwidth=6)


@query("checkerboard_nonuniform", f"""WITH {_pieces_sql("[4]")} SELECT scan_id, piece, max(points) AS points, round(max(rms), 4) AS rms FROM r GROUP BY ALL""")
def checkerboard_nonuniform(spark, d):
    # Each piece's points, and the rms height of what its line leaves.
    p = vb.checkerboard_nonuniform(profiles(spark, d), 4)
    n = p.groupBy("scan_id", "piece").agg(F.count("*").alias("points"))
    return rounded(scalars.nonuniform(p, keys=("scan_id", "piece")).join(n, ["scan_id", "piece"]).select("scan_id", "piece", "points", F.col("rq").alias("rms")), 4)


_SD1 = f"{L}, q AS (SELECT a.scan_id, a.surface_id, s, (b.h - a.h) / s AS d FROM l a, (SELECT unnest([1, 2, 4, 8]) AS s) JOIN l b ON b.scan_id = a.scan_id AND b.ix = a.ix + s)"
_SD2 = f"{L}, q AS (SELECT a.scan_id, s, (c.h - 2 * a.h + b.h) / (s * s) AS d FROM l a, (SELECT unnest([1, 2, 4, 8]) AS s) JOIN l b ON b.scan_id = a.scan_id AND b.ix = a.ix - s JOIN l c ON c.scan_id = a.scan_id AND c.ix = a.ix + s)"


@query("sdrp_slope_variance", f"WITH {_SD1} SELECT scan_id, CAST(s AS DOUBLE) AS distance, round(var_pop(d), 6) AS value FROM q GROUP BY ALL")
def sdrp_slope_variance(spark, d):
    return rounded(stencils.scale_dependent(line_scans(spark, d), [1, 2, 4, 8], PIXEL))


@query("sdrp_curvature_minimum", f"WITH {_SD2} SELECT scan_id, 2::DOUBLE * s AS distance, round(min(d), 6) AS value FROM q GROUP BY ALL")
def sdrp_curvature_minimum(spark, d):
    return rounded(stencils.scale_dependent(line_scans(spark, d), [1, 2, 4, 8], PIXEL, 2, func=F.min))


# --- bearing area ----------------------------------------------------------------------------------

_Z = "(SELECT unnest([" + ", ".join(f"{z}::DOUBLE" for z in LEVELS) + "]) AS z)"
_SEG = "CASE WHEN z < least(a, b) THEN 1 WHEN z > greatest(a, b) THEN 0 ELSE coalesce((greatest(a, b) - z) / nullif(abs(b - a), 0), 1) END"


@query("bearing_area_linescan", f"WITH {L}, t AS (SELECT scan_id, h AS a, lead(h) OVER (PARTITION BY scan_id ORDER BY ix) AS b FROM l) SELECT scan_id, z, round(avg({_SEG}), 6) AS p FROM t, {_Z} WHERE b IS NOT NULL GROUP BY ALL")
def bearing_area_linescan(spark, d):
    return rounded(bearing.bearing_line(line_scans(spark, d), LEVELS))


@query("bearing_area_nonuniform", f"WITH {S}, t AS (SELECT scan_id, h0 AS a, h1 AS b, dx FROM s) SELECT scan_id, z, round(sum(dx * {_SEG}) / sum(dx), 6) AS p FROM t, (SELECT unnest([5.0::DOUBLE, 20.0, 60.0]) AS z) GROUP BY ALL")
def bearing_area_nonuniform(spark, d):
    return rounded(bearing.bearing_nonuniform(profiles(spark, d), [5.0, 20.0, 60.0]))


_TRI = "CASE WHEN z <= t1 THEN 1 WHEN z <= t2 THEN 1 - (z - t1) ** 2 / nullif((t2 - t1) * (t3 - t1), 0) WHEN z <= t3 THEN (t3 - z) ** 2 / nullif((t3 - t2) * (t3 - t1), 0) ELSE 0 END"


@query("bearing_area_map", f"""WITH {map_sql()}, q AS (SELECT a.h AS a, b.h AS b, c.h AS c, d.h AS d FROM g a LEFT JOIN g b ON b.ix = a.ix + 1 AND b.iy = a.iy LEFT JOIN g c ON c.ix = a.ix AND c.iy = a.iy + 1 LEFT JOIN g d ON d.ix = a.ix + 1 AND d.iy = a.iy + 1
  UNION ALL SELECT NULL, b.h, c.h, d.h FROM g d JOIN g b ON b.ix = d.ix AND b.iy = d.iy - 1 JOIN g c ON c.ix = d.ix - 1 AND c.iy = d.iy LEFT JOIN g a ON a.ix = d.ix - 1 AND a.iy = d.iy - 1 WHERE a.h IS NULL),
 t AS (SELECT list_sort([a, b, c]) AS t FROM q WHERE a IS NOT NULL AND b IS NOT NULL AND c IS NOT NULL UNION ALL SELECT list_sort([b, d, c]) FROM q WHERE b IS NOT NULL AND d IS NOT NULL AND c IS NOT NULL), u AS (SELECT t[1] AS t1, t[2] AS t2, t[3] AS t3 FROM t)
 SELECT z, round(avg({_TRI}), 6) AS p FROM u, (SELECT unnest([20000.0::DOUBLE, 30000.0, 40000.0, 60000.0]) AS z) GROUP BY ALL""")
def bearing_area_map(spark, d):
    return rounded(bearing.bearing_map(height_map(spark, d), [20000.0, 30000.0, 40000.0, 60000.0]))


# --- containers ------------------------------------------------------------------------------------


def _log_sql(source: str, x: str, y: str, tidy: bool = True) -> str:
    out = "round(x, 6) AS x, round(y, 6) AS y" if tidy else "x, y"
    return f"u AS (SELECT surface_id, scan_id, CAST(ceil(round(log10({x}) * 10, 9)) AS INTEGER) - 1 AS bin, {x} AS x, {y} AS y FROM {source} WHERE {x} > 0 AND {y} IS NOT NULL), w AS (SELECT surface_id, scan_id, bin, avg(x) AS x, avg(y) AS y FROM u GROUP BY ALL), a AS (SELECT surface_id, bin, avg(x) AS x, avg(y) AS y, count(*) AS n FROM w GROUP BY ALL), z AS (SELECT surface_id, CAST(unnest(range(min(bin), max(bin) + 1)) AS INTEGER) AS bin FROM a GROUP BY surface_id) SELECT z.surface_id, z.bin, {out}, n FROM z LEFT JOIN a ON a.surface_id = z.surface_id AND a.bin = z.bin"


@query("container_psd", f"WITH {_psd_sql(True)}, {_log_sql('c', 'q', 'psd')}")
def container_psd(spark, d):
    return rounded(container.log_average(_psd(spark, d), "q", "psd"))


@query("container_acf", f"WITH {_ACF}, {_log_sql('c', 'k', 'acf')}")
def container_acf(spark, d):
    return rounded(container.log_average(_acf(spark, d), "r", "acf"))


@query("container_half_derivative_variance", f"WITH o AS (WITH {_ACF}, {_log_sql('c', 'k', 'acf', False)}), t AS (SELECT *, lag(x) OVER w AS x0, lag(y) OVER w AS y0 FROM o WHERE y IS NOT NULL WINDOW w AS (PARTITION BY surface_id ORDER BY x)) SELECT surface_id, round(sum(coalesce((y / x**2 + y0 / x0**2) / 2 * (x - x0), y / x)), 4) AS variance FROM t GROUP BY surface_id")
def container_half_derivative_variance(spark, d):
    return rounded(container.half_derivative_variance(container.log_average(_acf(spark, d), "r", "acf")), 4)


@query("container_vbm", f"WITH {_VB}, {_log_sql('v', 'bandwidth', 'rms')}")
def container_vbm(spark, d):
    return rounded(container.log_average(vb.variable_bandwidth(line_scans(spark, d), N, SIZE, ("surface_id", "scan_id")), "bandwidth", "rms"))


@query("container_sdrp", f"WITH {_SD1}, v AS (SELECT surface_id, scan_id, s, var_pop(d) AS value FROM q GROUP BY ALL) SELECT surface_id, CAST(s AS DOUBLE) AS distance, round(avg(value), 6) AS value, count(value) AS n FROM v GROUP BY ALL")
def container_sdrp(spark, d):
    return rounded(container.scale_dependent_average(stencils.scale_dependent(line_scans(spark, d), [1, 2, 4, 8], PIXEL, keys=("surface_id", "scan_id"))))


@query("container_bandwidth", f"WITH {S}, b AS (SELECT scan_id, avg(dx) AS lower, sum(dx) AS upper FROM s GROUP BY scan_id) SELECT round(min(lower), 6) AS lower, round(max(upper), 6) AS upper, 'mm' AS unit FROM b")
def container_bandwidth(spark, d):
    return rounded(container.suggest_length_unit(container.bandwidth(scalars.bandwidth(profiles(spark, d))), 1e-3))


@query("container_integrate_psd", f"WITH {_psd_sql(True)}, n AS (SELECT surface_id, count(DISTINCT scan_id) AS members FROM l GROUP BY surface_id) SELECT surface_id, round(sum(2 * psd * q * q / 64 / members), 6) AS integral FROM c JOIN n USING (surface_id) GROUP BY surface_id")
def container_integrate_psd(spark, d):
    p = _psd(spark, d)
    extents = line_scans(spark, d).groupBy("surface_id", "scan_id").agg(F.lit(SIZE).alias("size")).withColumns({"q_low": F.lit(2 * math.pi / SIZE), "q_high": F.lit(math.pi)})
    return rounded(container.integrate_psd(p, extents, "q * q"))


_AVG = f"WITH {_psd_sql(True)}, " + _log_sql("c", "q", "psd").rpartition(" SELECT z.")[0]


@query("c1d_moment", f"{_AVG}, t AS (SELECT surface_id, x, y * x / pi() AS v, lag(x) OVER o AS x0, lag(y * x / pi()) OVER o AS v0 FROM a WINDOW o AS (PARTITION BY surface_id ORDER BY x)) SELECT surface_id, round(sum(coalesce((x - x0) * (v + v0) / 2, 0)), 6) AS integral FROM t GROUP BY surface_id")
def c1d_moment(spark, d):
    return rounded(container.profile_moment(container.log_average(_psd(spark, d), "q", "psd"), 1))


@query("ciso_moment", f"{_AVG}, t AS (SELECT surface_id, x, y * x / 2 AS v, lag(x) OVER o AS x0, lag(y * x / 2) OVER o AS v0 FROM a WINDOW o AS (PARTITION BY surface_id ORDER BY x)) SELECT surface_id, round(sum(coalesce((x - x0) * (v + v0) / 2, 0)), 6) AS integral FROM t GROUP BY surface_id")
def ciso_moment(spark, d):
    return rounded(container.profile_moment(container.log_average(_psd(spark, d), "q", "psd"), 1, True))


# --- geometry --------------------------------------------------------------------------------------

_MASKL = f"WITH {L}, t AS (SELECT scan_id, ix, h > avg(h) OVER (PARTITION BY scan_id) AS mask FROM l)"
_MASKM = f"WITH RECURSIVE {M}, t AS (SELECT scan_id, ix, iy, h > avg(h) OVER (PARTITION BY scan_id) AS mask FROM m)"


@query("patch_runs_1d", f"{_MASKL}, e AS (SELECT *, CASE WHEN mask AND NOT coalesce(lag(mask) OVER w, FALSE) THEN 1 ELSE 0 END AS s FROM t WINDOW w AS (PARTITION BY scan_id ORDER BY ix)) SELECT scan_id, ix, CASE WHEN mask THEN CAST(sum(s) OVER (PARTITION BY scan_id ORDER BY ix) AS BIGINT) ELSE 0 END AS patch_id FROM e")
def patch_runs_1d(spark, d):
    return geometry.runs(geometry.threshold(line_scans(spark, d))).select("scan_id", "ix", "patch_id")


@query("outer_perimeter_1d", f"{_MASKL} SELECT scan_id, ix, NOT mask AND (coalesce(lag(mask) OVER w, FALSE) OR coalesce(lead(mask) OVER w, FALSE)) AS outer FROM t WINDOW w AS (PARTITION BY scan_id ORDER BY ix)".replace("AS outer", 'AS "outer"'))
def outer_perimeter_1d(spark, d):
    return geometry.outer_perimeter_line(geometry.threshold(line_scans(spark, d))).select("scan_id", "ix", "outer")


@query("segment_numbers", f"""{_MASKM}, e AS (SELECT *, CASE WHEN mask AND NOT coalesce(lag(mask) OVER w, FALSE) THEN 1 ELSE 0 END AS s FROM t WINDOW w AS (PARTITION BY scan_id, iy ORDER BY ix)),
 n AS (SELECT scan_id, ix, iy, mask, CASE WHEN mask THEN sum(s) OVER (PARTITION BY scan_id, iy ORDER BY ix) ELSE 0 END AS p FROM e),
 k AS (SELECT *, max(p) OVER w AS top, bool_or(mask AND ix = 0) OVER w AND bool_or(mask AND ix = 7) OVER w AS wraps FROM n WINDOW w AS (PARTITION BY scan_id, iy)) SELECT scan_id, ix, iy, CAST(CASE WHEN wraps AND p = top THEN 1 ELSE p END AS BIGINT) AS patch_id FROM k""")
def segment_numbers(spark, d):
    return geometry.segment_numbers(geometry.threshold(small_maps(spark, d)), 8).select("scan_id", "ix", "iy", "patch_id")


_NB = ", ".join(f"({a}, {b})" for a, b in geometry.FOUR)


@query("coordination_map", f"{_MASKM}, o(a, b) AS (VALUES {_NB}), c AS (SELECT t.scan_id, t.ix, t.iy, any_value(t.mask) AS mask, CAST(count(*) FILTER (u.mask) AS BIGINT) AS n FROM t CROSS JOIN o LEFT JOIN t u ON u.scan_id = t.scan_id AND u.ix = t.ix - a AND u.iy = t.iy - b GROUP BY t.scan_id, t.ix, t.iy) SELECT scan_id, ix, iy, mask, n, NOT mask AND n > 0 AS \"outer\", mask AND n < 4 AS \"inner\" FROM c")
def coordination_map(spark, d):
    return geometry.coordination(geometry.threshold(small_maps(spark, d)), 8, 8)


_P = lambda a, b: f"(SELECT scan_id, ((ix - {a}) + 8) % 8 AS ix, ((iy - {b}) + 8) % 8 AS iy, CAST(mask AS INTEGER) AS c FROM t)"
_SUM = lambda st: " UNION ALL ".join(f"SELECT * FROM {_P(a, b)}" for a, b in st)


@query("perimeter_length", f"{_MASKM}, s4 AS (SELECT scan_id, ix, iy, sum(c) AS a FROM ({_SUM(geometry.FOUR)}) GROUP BY ALL), s8 AS (SELECT scan_id, ix, iy, sum(c) AS b FROM ({_SUM([s for s in geometry.EIGHT if s not in geometry.FOUR])}) GROUP BY ALL) SELECT scan_id, round(sum(CASE WHEN NOT mask THEN 0 WHEN a >= 2 THEN 1 WHEN a = 1 AND b >= 1 THEN 0.5::DOUBLE * (1 + sqrt(2)) WHEN a = 1 THEN 0 ELSE 0.5::DOUBLE * sqrt(2) END), 6) AS length FROM t JOIN s4 USING (scan_id, ix, iy) JOIN s8 USING (scan_id, ix, iy) GROUP BY scan_id")
def perimeter_length(spark, d):
    return rounded(geometry.perimeter_length(geometry.threshold(small_maps(spark, d)), 8, 8))


_REACH = """r AS (SELECT scan_id, ix, iy, ix * 8 + iy AS id FROM t WHERE mask UNION SELECT t.scan_id, t.ix, t.iy, r.id FROM r JOIN t ON t.mask AND t.scan_id = r.scan_id AND abs(t.ix - r.ix) <= 1 AND abs(t.iy - r.iy) <= 1),
 k AS (SELECT scan_id, ix, iy, min(id) AS id FROM r GROUP BY ALL), n AS (SELECT scan_id, ix, iy, dense_rank() OVER (PARTITION BY scan_id ORDER BY id) AS p FROM k)"""


@query("patches_2d", f"{_MASKM}, {_REACH} SELECT t.scan_id, t.ix, t.iy, CAST(coalesce(p, 0) AS BIGINT) AS patch_id FROM t LEFT JOIN n ON n.scan_id = t.scan_id AND n.ix = t.ix AND n.iy = t.iy")
def patches_2d(spark, d):
    return geometry.patches(geometry.threshold(small_maps(spark, d)), 8, 8)


@query("patch_areas", f"{_MASKM}, {_REACH} SELECT scan_id, CAST(p AS BIGINT) AS patch_id, count(*) AS area FROM n GROUP BY ALL")
def patch_areas(spark, d):
    return geometry.patch_areas(geometry.patches(geometry.threshold(small_maps(spark, d)), 8, 8))


@query("distance_map", f"{_MASKM} SELECT a.scan_id, a.ix, a.iy, round(sqrt(min(least(abs(a.ix - b.ix), 8 - abs(a.ix - b.ix)) ** 2 + least(abs(a.iy - b.iy), 8 - abs(a.iy - b.iy)) ** 2)), 6) AS distance FROM t a JOIN t b ON b.scan_id = a.scan_id AND b.mask GROUP BY ALL")
def distance_map(spark, d):
    return rounded(geometry.distances(geometry.threshold(small_maps(spark, d)), 8, 8).drop("closest"))


_START, _TARGET = "(h > avg(h) OVER (PARTITION BY scan_id))", "(ix * 5 + iy * 3 + scan_id) % 13 = 0"


@query("shortest_distance", f"WITH {M}, t AS (SELECT scan_id, ix, iy, {_START} AS s, {_TARGET} AS z FROM m), d AS (SELECT a.scan_id, a.ix, a.iy, sqrt(min(least(abs(a.ix - b.ix), 8 - abs(a.ix - b.ix)) ** 2 + least(abs(a.iy - b.iy), 8 - abs(a.iy - b.iy)) ** 2)) AS d FROM t a JOIN t b ON b.scan_id = a.scan_id AND b.z GROUP BY ALL) SELECT t.scan_id, t.ix, t.iy, round(CASE WHEN s AND d < 3 THEN d ELSE 0 END, 6) AS distance FROM t LEFT JOIN d USING (scan_id, ix, iy)")
def shortest_distance(spark, d):
    """From pixels above the mean to a scatter of targets less than three pixels away."""
    p = geometry.threshold(small_maps(spark, d)).withColumnRenamed("mask", "start").withColumns({"patch": F.lit(True), "target": F.expr(_TARGET)})
    return rounded(geometry.shortest_distance(p, 8, 8, most=3.0))


_OFF = ", ".join(f"({a}, {b})" for a, b in geometry.offsets_within(3))


@query("pair_correlation", f"WITH {M}, o(a, b) AS (VALUES {_OFF}), c AS (SELECT p.scan_id, CAST(a * a + b * b AS INTEGER) AS r2, sum(p.h * q.h) AS s, count(*) AS n FROM m p CROSS JOIN o JOIN m q ON q.scan_id = p.scan_id AND q.ix = (p.ix + a + 8) % 8 AND q.iy = (p.iy + b + 8) % 8 GROUP BY ALL) SELECT scan_id, r2, round(s / n, 6) AS c, round(sum(s / sqrt(r2)) OVER (PARTITION BY scan_id ORDER BY r2), 6) AS integrated FROM c")
def pair_correlation(spark, d):
    m = small_maps(spark, d)
    return rounded(geometry.pair_correlation(m, m, 8, 8, 3))


# --- models, units ---------------------------------------------------------------------------------


_CISO = "CASE WHEN q > 2 * pi() / 100 AND q < 2 * pi() / 0.5 THEN CASE WHEN q < 2 * pi() / 10 THEN 2.0 ELSE 2.0 * pow(q / (2 * pi() / 10), -3.6) END ELSE 0 END"
_C1D = "CASE WHEN q > 2 * pi() / 100 AND q < 2 * pi() / 0.5 THEN CASE WHEN q < 2 * pi() / 10 THEN 2.0 * (2 * pi() / 10) / pi() ELSE 2.0 * pow(q / (2 * pi() / 10), -3.6) * q / pi() * sqrt(greatest(1 - pow(q / (2 * pi() / 0.5), 2), 0)) END ELSE 0 END"


@query("self_affine_psd", f"SELECT p_partkey, round(q, 6) AS q, round({_CISO}, 6) AS ciso, round({_C1D}, 6) AS c1d FROM (SELECT p_partkey, p_size * 0.3::DOUBLE AS q FROM part)")
def self_affine_psd(spark, d):
    """The model at the wavevectors that a table holds: 0.3 times the size of each part."""
    m = models.SelfAffine(2.0, 10.0, 0.8, 0.5, 100.0)
    q = table(spark, d, "part").select("p_partkey", (F.col("p_size") * F.lit(0.3)).alias("q"))
    return rounded(q.select("p_partkey", "q", m.psd_isotropic(F.col("q")).alias("ciso"), m.psd_profile(F.col("q")).alias("c1d")))


@query("self_affine_variance", "SELECT n_nationkey, round(2.0 / (2 * pi()) * (pow(qr, 2) - pow(ql, 2)) / 2 + 2.0 * pow(qr, 2 + 2 * h) / (2 * pi()) * (pow(qs, -2 * h) - pow(qr, -2 * h)) / (-2 * h), 6) AS variance FROM (SELECT n_nationkey, 0.1::DOUBLE + 0.03::DOUBLE * n_nationkey AS h, 2 * pi() / 10 AS qr, 2 * pi() / 100 AS ql, 2 * pi() / 0.5 AS qs FROM nation)")
def self_affine_variance(spark, d):
    p = table(spark, d, "nation").select("n_nationkey", (F.lit(0.1) + F.lit(0.03) * F.col("n_nationkey")).alias("h"))
    lit = lambda v: F.lit(2 * math.pi / v)
    return rounded(p.select("n_nationkey", models.variance_columns(F.lit(2.0), lit(10.0), F.col("h"), lit(100.0), lit(0.5), 0.0).alias("variance")))


@query("sphere_surface", f"WITH {map_sql()}, p AS (SELECT ix, iy, h, ix * 0.5 - 12.5 AS x, iy * 25.0::DOUBLE / {NY} - 12.5 AS y FROM g) SELECT ix, iy, round(CASE WHEN x * x + y * y < 81 THEN sqrt(81 - x * x - y * y) - 9 END, 6) AS sphere, round(h + CASE WHEN x * x + y * y < 81 THEN sqrt(81 - x * x - y * y) - 9 END, 4) AS h FROM p")
def sphere_surface(spark, d):
    """A sphere of radius 9 over the grid of the height map (25 x 25), alone and on top of its heights."""
    g = transforms.with_positions(height_map(spark, d), 50, 25.0, (n := ny_of(spark, d)), 25.0)
    s = g.withColumn("sphere", models.cap(F.col("x"), F.col("y"), 9.0, 25.0, 25.0))
    return rounded(s.select("ix", "iy", "sphere", (F.col("h") + F.col("sphere")).alias("h")), 6, h=4) if n else rounded(s)


_U = [("m", "mm"), ("µm", "nm"), ("um", "Å"), ("Å", "m"), ("V", "mV"), ("V", "m"), ("furlong", "m")]
_UNIT_LIST = lambda i: "[" + ", ".join(f"'{u[i]}'" for u in _U) + "]"


@query("units_table", f"WITH u AS (SELECT c_custkey, c_acctbal, list_extract({_UNIT_LIST(0)}, c_custkey % 7 + 1) AS source, list_extract({_UNIT_LIST(1)}, c_custkey % 7 + 1) AS target, list_extract(CAST([1e3, 1e3, 1e4, 1e-10, 1e3, NULL, NULL] AS DOUBLE[]), c_custkey % 7 + 1) AS f FROM customer) SELECT c_custkey, source, target, CASE WHEN f >= 1 THEN round(c_acctbal * f, 2) ELSE round(c_acctbal * f, 12) END AS value FROM u")
def units_table(spark, d):
    """Account balances as lengths and voltages, each customer's in a unit of its own, converted; null where units are of two kinds or unknown."""
    pick = lambda i: F.element_at(F.array(*[F.lit(u[i]) for u in _U]), (F.col("c_custkey") % 7 + 1).cast("int"))
    u = table(spark, d, "customer").select("c_custkey", "c_acctbal", pick(0).alias("source"), pick(1).alias("target"))
    f = units.factor_column(F.col("source"), F.col("target"))
    value = F.col("c_acctbal") * f
    return u.select("c_custkey", "source", "target", F.when(f >= 1, F.round(value, 2)).otherwise(F.round(value, 12)).alias("value"))


# --- NumPy kernels ---------------------------------------------------------------------------------


@query("fourier_shortcut", f"WITH {L}, f AS (SELECT scan_id, k.range AS k, sum(h * cos(2 * pi() * k.range * ix / 64)) AS re, sum(h * sin(2 * pi() * k.range * ix / 64)) AS im FROM l, range(64) k WHERE least(k.range, 64 - k.range) <= 8 GROUP BY ALL) SELECT scan_id, CAST(i.range AS INTEGER) AS ix, round(sum(re * cos(2 * pi() * k * i.range / 64) + im * sin(2 * pi() * k * i.range / 64)) / 64, 6) AS h FROM f, range(64) i GROUP BY ALL")
def fourier_shortcut(spark, d):
    return rounded(kernels.shortcut(line_scans(spark, d), N, SIZE, 2 * math.pi * 8.5 / SIZE))


@query("fourier_derivative", f"""WITH {M}, f AS (SELECT scan_id, iy, k.range AS k, sum(h * cos(2 * pi() * k.range * ix / 8)) AS re, -sum(h * sin(2 * pi() * k.range * ix / 8)) AS im FROM m, range(8) k GROUP BY ALL),
 g AS (SELECT scan_id, iy, k, re, im, CASE WHEN k = 4 THEN 0 WHEN k < 4 THEN k ELSE k - 8 END * 2 * pi() / 8 AS q FROM f)
 SELECT scan_id, CAST(i.range AS INTEGER) AS ix, iy, round(sum(-q * (re * sin(2 * pi() * k * i.range / 8) + im * cos(2 * pi() * k * i.range / 8))) / 8, 6) AS dx FROM g, range(8) i GROUP BY ALL""")
def fourier_derivative(spark, d):
    return rounded(kernels.fourier_derivative(small_maps(spark, d), 8, 8, 8.0, 8.0).drop("dy"))


@query("interpolate_linear_map", f"""WITH {M}, o AS (SELECT scan_id, CAST(a.range AS INTEGER) AS ix, CAST(b.range AS INTEGER) AS iy, a.range // 2 AS i, b.range // 2 AS j, (a.range % 2) / 2::DOUBLE AS u, (b.range % 2) / 2::DOUBLE AS v FROM (SELECT DISTINCT scan_id FROM m), range(16) a, range(16) b)
 SELECT o.scan_id, o.ix, o.iy, round(CASE WHEN u + v <= 1 THEN a.h + u * (b.h - a.h) + v * (c.h - a.h) ELSE e.h + (1 - u) * (c.h - e.h) + (1 - v) * (b.h - e.h) END, 6) AS h FROM o JOIN m a ON a.scan_id = o.scan_id AND a.ix = i AND a.iy = j JOIN m b ON b.scan_id = o.scan_id AND b.ix = (i + 1) % 8 AND b.iy = j JOIN m c ON c.scan_id = o.scan_id AND c.ix = i AND c.iy = (j + 1) % 8 JOIN m e ON e.scan_id = o.scan_id AND e.ix = (i + 1) % 8 AND e.iy = (j + 1) % 8""")
def interpolate_linear_map(spark, d):
    return rounded(kernels.interpolate_map(small_maps(spark, d), 8, 8, 2))


# The patch is a product of cubics through four points along each axis: weights of value, slope and second derivative, on a point (f = 0) and half way.
_CUBIC = "c(f, o, v, d, e) AS (VALUES (0, -1, 0.0::DOUBLE, -0.5::DOUBLE, 2.0::DOUBLE), (0, 0, 1, 0, -5), (0, 1, 0, 0.5, 4), (0, 2, 0, 0, -1), (1, -1, -0.0625, 0.125, 0.5), (1, 0, 0.5625, -1.375, -0.5), (1, 1, 0.5625, 1.375, -0.5), (1, 2, -0.0625, -0.125, 0.5))"


@query("interpolate_bicubic_map", f"""WITH {M}, {_CUBIC}, a AS (SELECT scan_id, k.range AS x, iy, sum(v * h) AS p, sum(d * h) AS px, sum(e * h) AS pxx FROM range(16) k JOIN c ON c.f = k.range % 2 JOIN m ON m.ix = (k.range // 2 + o + 8) % 8 GROUP BY ALL)
 SELECT scan_id, CAST(x AS INTEGER) AS ix, CAST(k.range AS INTEGER) AS iy, round(sum(v * p), 6) AS h, round(sum(v * px), 6) AS dx, round(sum(d * p), 6) AS dy, round(sum(v * pxx), 6) AS dxx, round(sum(d * px), 6) AS dxy, round(sum(e * p), 6) AS dyy
 FROM range(16) k JOIN c ON c.f = k.range % 2 JOIN a ON a.iy = (k.range // 2 + o + 8) % 8 GROUP BY scan_id, x, k.range""")
def interpolate_bicubic_map(spark, d):
    return rounded(kernels.interpolate_map(small_maps(spark, d), 8, 8, 2, "bicubic"))


_KERNEL = lambda t: f"(1 + 2 * (cos(2 * pi() * ({t}) / 8) + cos(4 * pi() * ({t}) / 8) + cos(6 * pi() * ({t}) / 8)) + cos(pi() * ({t}))) / 8"


@query("interpolate_fourier_map", f"""WITH {M}, a AS (SELECT scan_id, CAST(k.range AS INTEGER) AS mx, iy, sum(h * {_KERNEL('k.range / 2::DOUBLE - ix')}) AS h FROM m, range(16) k GROUP BY ALL)
 SELECT scan_id, mx AS ix, CAST(k.range AS INTEGER) AS iy, round(sum(h * {_KERNEL('k.range / 1.5::DOUBLE - iy')}), 6) AS h FROM a, range(12) k GROUP BY scan_id, mx, k.range""")
def interpolate_fourier_map(spark, d):
    return rounded(kernels.interpolate_fourier(small_maps(spark, d), 8, 8, 16, 12))


_GAP = "(ix * 3 + iy * 5 + scan_id) % 7 < 2"


# In SQL each undefined pixel becomes the mean of its neighbours, again and again: the same limit by another road.
@query("fill_map_harmonic", f"""WITH RECURSIVE {M}, u AS (SELECT 0 AS k, scan_id, ix, iy, {_GAP} AS gap, CASE WHEN {_GAP} THEN 0 ELSE h END AS h FROM m
 UNION ALL SELECT k + 1, scan_id, ix, iy, gap, CASE WHEN gap THEN (coalesce(lag(h) OVER x, 0) + coalesce(lead(h) OVER x, 0) + coalesce(lag(h) OVER y, 0) + coalesce(lead(h) OVER y, 0)) / (4 - CAST(ix IN (0, 7) AS INTEGER) - CAST(iy IN (0, 7) AS INTEGER)) ELSE h END FROM u WHERE k < 90
  WINDOW x AS (PARTITION BY scan_id, iy ORDER BY ix), y AS (PARTITION BY scan_id, ix ORDER BY iy))
 SELECT scan_id, ix, iy, round(h, 6) AS h FROM u WHERE k = 90""")
def fill_map_harmonic(spark, d):
    p = small_maps(spark, d).withColumn("h", F.expr(f"CASE WHEN {_GAP} THEN NULL ELSE h END"))
    return rounded(tiles.fill_harmonic(p, 8, 8))


_WORST = "d2 AS (SELECT a.scan_id, CAST(s AS INTEGER) AS s, min((b.h - 2 * a.h + c.h) / (s * s)) AS v FROM l a, (SELECT unnest(range(1, 32)) AS s) JOIN l b ON b.scan_id = a.scan_id AND b.ix = a.ix - s JOIN l c ON c.scan_id = a.scan_id AND c.ix = a.ix + s GROUP BY ALL), w2 AS (SELECT scan_id, s, -v - 0.5::DOUBLE / 20 AS over, lead(-v - 0.5::DOUBLE / 20) OVER (PARTITION BY scan_id ORDER BY s) AS after FROM d2), tip AS (SELECT scan_id, arg_max(2 * (s + coalesce(over / (over - after), 0)), s) AS c FROM w2 WHERE over > 0 GROUP BY scan_id), ids AS (SELECT DISTINCT scan_id FROM l)"


@query("probe_cutoff", f"WITH {L}, {_WORST} SELECT ids.scan_id, round(tip.c, 6) AS cutoff FROM ids LEFT JOIN tip USING (scan_id)")
def probe_cutoff(spark, d):
    return rounded(kernels.scanning_probe_cutoff(line_scans(spark, d), PIXEL, 20.0))


@query("fourier_synthesis", "SELECT CAST(n_nationkey AS BIGINT) AS scan_id, 0.1::DOUBLE + 0.01::DOUBLE * n_nationkey AS sq, 1024 AS n FROM nation")
def fourier_synthesis(spark, d):
    """A random surface for each nation, of the rms height that its row says: the surfaces' own rms heights and pixels."""
    n = table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("seed"), (F.lit(0.1) + 0.01 * F.col("n_nationkey")).alias("rms_height"))
    s = kernels.fourier_synthesis(n, 32, 32, 1.0, 1.0, 0.8, long=0.5)
    return rounded(s.groupBy("scan_id").agg(F.stddev_pop("h").alias("sq"), F.count("h").cast("int").alias("n")))


# --- reliability -----------------------------------------------------------------------------------

_CUT = _WORST + ", cut AS (SELECT ids.scan_id, greatest(CASE ids.scan_id % 3 WHEN 0 THEN tip.c WHEN 1 THEN 3 END, 2.5::DOUBLE) AS cutoff FROM ids LEFT JOIN tip USING (scan_id))"


def _cutoffs(spark, d):
    """A third of the scans has a tip radius, a third a resolution, the rest neither."""
    info = line_scans(spark, d).select("scan_id").distinct()
    info = info.withColumns({"tip_radius": F.expr("CASE WHEN scan_id % 3 = 0 THEN 20D END"), "resolution": F.expr("CASE WHEN scan_id % 3 = 1 THEN 3D END")})
    return reliability.short_cutoffs(line_scans(spark, d), info, N, PIXEL, 2.5)


@query("reliability_cutoff", f"WITH {L}, {_CUT} SELECT scan_id, round(cutoff, 6) AS cutoff FROM cut")
def reliability_cutoff(spark, d):
    return rounded(_cutoffs(spark, d))


@query("psd_reliable", f"WITH {_psd_sql(False)}, {_CUT}, x AS (SELECT scan_id, k, psd, count(*) OVER (PARTITION BY scan_id) AS n FROM c JOIN cut USING (scan_id) WHERE q < 2 * pi() / cutoff) SELECT scan_id, k, round(psd, 6) AS psd FROM x WHERE n >= 2")
def psd_reliable(spark, d):
    p = reliability.reliable_spectrum(_psd(spark, d, False), _cutoffs(spark, d))
    return rounded(p.select("scan_id", F.col("k").cast("int").alias("k"), "psd"))


@query("acf_reliable", f"WITH {_ACF}, {_CUT} SELECT scan_id, k, round(acf, 6) AS acf FROM c JOIN cut USING (scan_id) WHERE k > cutoff / 2")
def acf_reliable(spark, d):
    return rounded(reliability.reliable_autocorrelation(_acf(spark, d), _cutoffs(spark, d)).select("scan_id", "k", "acf"))


@query("vbm_reliable", f"WITH {_VB}, {_CUT} SELECT scan_id, CAST(m AS INTEGER) AS magnification, bandwidth, round(rms, 6) AS rms FROM v JOIN cut USING (scan_id) WHERE bandwidth > cutoff")
def vbm_reliable(spark, d):
    return rounded(reliability.reliable_bandwidth(vb.variable_bandwidth(line_scans(spark, d), N, SIZE), _cutoffs(spark, d)))


@query("sdrp_reliable", f"WITH {_SD1}, {_CUT}, x AS (SELECT scan_id, CAST(s AS DOUBLE) AS distance, round(var_pop(d), 6) AS value FROM q GROUP BY ALL) SELECT x.* FROM x JOIN cut USING (scan_id) WHERE distance > cutoff / 2")
def sdrp_reliable(spark, d):
    return rounded(reliability.reliable_scales(stencils.scale_dependent(line_scans(spark, d), [1, 2, 4, 8], PIXEL), _cutoffs(spark, d)))


@query("psd_nonuniform_reliable", f"WITH {P}, y AS (SELECT scan_id, lead(x) OVER (PARTITION BY scan_id ORDER BY ix) - x AS dx FROM p), cut AS (SELECT scan_id, avg(dx) AS cutoff FROM y GROUP BY scan_id), z AS ({ORACLE_SQL['psd_nonuniform_brute']}), w AS (SELECT z.*, count(*) OVER (PARTITION BY scan_id) AS n FROM z JOIN cut USING (scan_id) WHERE q < 2 * pi() / cutoff) SELECT scan_id, q, psd FROM w WHERE n >= 2")
def psd_nonuniform_reliable(spark, d):
    p = profiles(spark, d)
    return rounded(reliability.reliable_spectrum(spectral.psd_nonuniform(p, _Q), reliability.spacing_cutoffs(p)), 3, q=6)


# --- areas, conversions, results -------------------------------------------------------------------

_SPECTRUM = ORACLE_SQL["psd_area_radial"].rpartition("SELECT scan_id, CAST(least")[0]


@query("psd_area_integral", _SPECTRUM + "SELECT scan_id, round(sum(re * re + im * im) / 4096, 6) AS variance, round(sum((re * re + im * im) / 4096 * (least(kx, 8 - kx) ** 2 + least(ky, 8 - ky) ** 2) * (2 * pi() / 8) ** 2), 6) AS slope_variance FROM b GROUP BY scan_id")
def psd_area_integral(spark, d):
    s = spectral.spectrum_area(small_maps(spark, d), 8, 8, 8.0, 8.0)
    height, slope = (spectral.integrate_psd_area(s, 8.0, 8.0, f).withColumnRenamed("integral", c) for f, c in (("1D", "variance"), ("qx * qx + qy * qy", "slope_variance")))
    return rounded(height.join(slope, "scan_id"))


@query("scale_dep_slope_area", f"WITH a AS ({ORACLE_SQL['acf_area_radial'].replace('round(avg(acf), 6)', 'avg(acf)')}) SELECT scan_id, r2, round(sqrt(2 * acf / r2), 6) AS slope FROM a WHERE r2 > 0")
def scale_dep_slope_area(spark, d):
    acf = spectral.autocorrelation_area(small_maps(spark, d), 8, 8).withColumn("r2", F.col("r2").cast("int"))
    return rounded(spectral.slope_from_area_acf(acf).select("scan_id", "r2", "slope"))


@query("resample_radial", f"WITH {M}, r AS (SELECT scan_id, h, sqrt(least(ix, 8 - ix) ** 2 + least(iy, 8 - iy) ** 2) AS r FROM m) SELECT scan_id, CAST(round(r) AS INTEGER) - CASE WHEN round(r) > 5 THEN 1 ELSE 0 END AS bin, round(avg(r), 6) AS x, round(avg(h), 6) AS y, round(var_pop(h), 6) AS var, count(*) AS n FROM r GROUP BY ALL")
def resample_radial(spark, d):
    return rounded(spectral.radial(small_maps(spark, d), 8, 8, 8.0, 8.0, [-0.5, 0.5, 1.5, 2.5, 3.5, 4.5, 6.0]))


@query("height_height_acf", ORACLE_SQL["acf_nonuniform_brute"].partition(" k AS (SELECT scan_id, r, l")[0] + """ k AS (SELECT scan_id, r, hi - lo AS d, h0 + g * (lo - r - x0) AS a, h0 + g * (hi - r - x0) AS b, e0 + f * (lo - y0) AS u, e0 + f * (hi - y0) AS v FROM j)
 SELECT scan_id, r, round(sum(d * (2*a*u + a*v + b*u + 2*b*v) / 6), 2) AS acf FROM k GROUP BY scan_id, r""")
def height_height_acf(spark, d):
    return rounded(spectral.height_height_autocorrelation(profiles(spark, d), [1.0, 10.0, 50.0]), 2, r=6)


@query("to_nonuniform", f"WITH {L} SELECT scan_id, ix, ix * 0.25::DOUBLE AS x, round(h, 6) AS h FROM l")
def to_nonuniform(spark, d):
    return rounded(transforms.to_nonuniform(line_scans(spark, d), 0.25).select("scan_id", "ix", "x", "h"))


@query("self_affine_prefactor", "SELECT n_nationkey, round(2 * 0.5 * sqrt(hurst * pi() / (pow(2 * pi(), -2 * hurst) - pow(64 * pi(), -2 * hurst))) * 4096, 4) AS by_height, round(2 * 0.1 * sqrt((1 - hurst) * pi() / (pow(64 * pi(), 2 - 2 * hurst) - pow(2 * pi(), 2 - 2 * hurst))) * 64 / sqrt(2), 6) AS by_slope FROM (SELECT CAST(n_nationkey AS INTEGER) AS n_nationkey, 0.05::DOUBLE + n_nationkey * 0.035::DOUBLE AS hurst FROM nation)")
def self_affine_prefactor(spark, d):
    h = table(spark, d, "nation").select(F.col("n_nationkey").cast("int").alias("n_nationkey"), (F.lit(0.05) + F.col("n_nationkey") * 0.035).alias("hurst"))
    by_height = models.self_affine_prefactor((64, 64), (1.0, 1.0), F.col("hurst"), rms_height=0.5)
    by_slope = models.self_affine_prefactor((64,), (1.0,), F.col("hurst"), rms_slope=0.1)
    return rounded(h.select("n_nationkey", by_height.alias("by_height"), by_slope.alias("by_slope")), 6, by_height=4)


@query("iso_durations", """WITH c AS (SELECT c_custkey, CAST(round(c_acctbal * 1000000) AS BIGINT) * 37 AS us FROM customer), m AS (SELECT *, abs(us) AS m FROM c)
 SELECT c_custkey, CASE WHEN us < 0 THEN '-' ELSE '' END || printf('P%dDT%02dH%02dM%02d', m // 86400000000, m // 3600000000 % 24, m // 60000000 % 60, m // 1000000 % 60) || CASE WHEN m % 1000000 > 0 THEN printf('.%06d', m % 1000000) ELSE '' END || 'S' AS duration FROM m""")
def iso_durations(spark, d):
    us = F.round(F.col("c_acctbal") * 1_000_000).cast("long") * 37
    return table(spark, d, "customer").select("c_custkey", results.iso_duration(us).alias("duration"))


@query("json_results", "SELECT c_custkey, CAST(to_json({'c_custkey': c_custkey, 'name': c_name, 'nation': CASE WHEN c_acctbal >= 0 THEN c_nationkey END}) AS VARCHAR) AS json FROM customer")
def json_results(spark, d):
    c = table(spark, d, "customer").select("c_custkey", F.col("c_name").alias("name"), F.when(F.col("c_acctbal") >= 0, F.col("c_nationkey")).alias("nation"))
    return results.json_rows(c, ("c_custkey",))


from . import fourier_queries, robust_queries, scale_queries  # noqa: E402, F401 (register their queries)

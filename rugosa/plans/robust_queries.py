"""Queries of bearing-area bounds, median heights and robust trends."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import bearing, robust
from ..sources.tables import height_map, line_scans, profiles, small_maps
from .catalog import LEVELS, L, M, N, P, S, map_sql, query, rounded

_LEVELS = f"(SELECT unnest({[float(x) for x in LEVELS]}::DOUBLE[]) AS z)"
_PIECES = "e AS (SELECT scan_id, a, b, least(a, b) AS lo, greatest(a, b) AS hi, 1 AS w FROM (SELECT scan_id, h AS a, lead(h) OVER (PARTITION BY scan_id ORDER BY ix) AS b FROM l) WHERE b IS NOT NULL)"
_BOUNDS = "round(1 - count(*) FILTER (lo < z) / count(*), 6) AS lower, round(1 - count(*) FILTER (hi < z) / count(*), 6) AS upper"
_TRIANGLES = """q AS (SELECT a.scan_id, a.h AS a, b.h AS b, c.h AS c, d.h AS d FROM m a LEFT JOIN m b ON b.scan_id = a.scan_id AND b.ix = a.ix + 1 AND b.iy = a.iy LEFT JOIN m c ON c.scan_id = a.scan_id AND c.ix = a.ix AND c.iy = a.iy + 1 LEFT JOIN m d ON d.scan_id = a.scan_id AND d.ix = a.ix + 1 AND d.iy = a.iy + 1
  UNION ALL SELECT d.scan_id, NULL, b.h, c.h, d.h FROM m d JOIN m b ON b.scan_id = d.scan_id AND b.ix = d.ix AND b.iy = d.iy - 1 JOIN m c ON c.scan_id = d.scan_id AND c.ix = d.ix - 1 AND c.iy = d.iy LEFT JOIN m a ON a.scan_id = d.scan_id AND a.ix = d.ix - 1 AND a.iy = d.iy - 1 WHERE a.h IS NULL),
 t AS (SELECT scan_id, list_sort([a, b, c]) AS t FROM q WHERE a IS NOT NULL AND b IS NOT NULL AND c IS NOT NULL UNION ALL SELECT scan_id, list_sort([b, d, c]) FROM q WHERE b IS NOT NULL AND d IS NOT NULL AND c IS NOT NULL),
 e AS (SELECT scan_id, t[1] AS a, t[2] AS b, t[3] AS c, t[1] AS lo, t[3] AS hi, 1 AS w FROM t)"""


@query("bearing_bounds", f"WITH {L}, {_PIECES} SELECT scan_id, z, {_BOUNDS} FROM e, {_LEVELS} GROUP BY ALL")
def bearing_bounds(spark, d):
    return rounded(bearing.bounds(bearing.line_elements(line_scans(spark, d)), LEVELS))


_HEIGHTS = [15_000.0, 25_000.0, 35_000.0, 45_000.0, 60_000.0]


@query("bearing_bounds_map", f"WITH {map_sql()}, m AS (SELECT 0 AS scan_id, * FROM g), {_TRIANGLES} SELECT z, {_BOUNDS} FROM e, (SELECT unnest({_HEIGHTS}::DOUBLE[]) AS z) GROUP BY z")
def bearing_bounds_map(spark, d):
    return rounded(bearing.bounds_map(height_map(spark, d), _HEIGHTS))


# The root of a falling function that is linear or quadratic between neighbouring heights of the surface: found in SQL from
# its values at both ends and the middle of the interval in which it passes the target.
_PIECE_AREA = "CASE WHEN {z} < lo THEN 1 WHEN {z} > hi THEN 0 WHEN lo = hi THEN 1 ELSE (hi - {z}) / (hi - lo) END"
_TRIANGLE_AREA = "CASE WHEN {z} <= a THEN 1 WHEN {z} <= b THEN 1 - ({z} - a) ** 2 / ((b - a) * (c - a)) WHEN {z} <= c THEN (c - {z}) ** 2 / ((c - b) * (c - a)) ELSE 0 END"


def _root_sql(name: str, keys: str, ends: str, value: str, target: float) -> str:
    """ends: CTE of (keys, z), where the function bends; value: its share from one element, of z; m is known if the ends have it."""
    f = lambda z: f"sum(w * ({value.replace('$z', z)})) / sum(w)"
    return f"""{name}1 AS (SELECT {keys}, z, any_value(m) AS m, {f('z')} AS f FROM (SELECT DISTINCT * FROM {ends}) JOIN e USING ({keys}) GROUP BY {keys}, z),
 {name}2 AS (SELECT *, lead(z) OVER w AS z2, lead(f) OVER w AS f2 FROM {name}1 WINDOW w AS (PARTITION BY {keys} ORDER BY z)),
 {name}3 AS (SELECT {keys}, any_value(m) AS m, z, z2, any_value(f) - {target} AS f0, any_value(f2) - {target} AS f2, {f('((z + z2) / 2)')} - {target} AS fm FROM (SELECT * FROM {name}2 WHERE f > {target} AND f2 <= {target}) JOIN e USING ({keys}) GROUP BY {keys}, z, z2),
 {name} AS (SELECT {keys}, m, z + (z2 - z) * 2 * f0 / (3 * f0 - 4 * fm + f2 + sqrt((3 * f0 - 4 * fm + f2) ** 2 - 8 * f0 * (f0 - 2 * fm + f2))) AS root FROM {name}3)"""


def _robust_sql(elements: str, area: str, heights: str, keys: str = "scan_id") -> str:
    """WITH parts up to `mad` (keys, m, root): median heights, and deviations about them."""
    share = 2 * robust.SHARE
    a = lambda z: area.replace("{z}", z)
    return f"""{elements}, n1 AS (SELECT {keys}, z, 0 AS m FROM ({heights})), {_root_sql('med', keys, 'n1', a('$z'), 0.5)},
 n2 AS (SELECT {keys}, abs(z - root) AS z, root AS m FROM n1 JOIN med USING ({keys}) UNION ALL SELECT {keys}, 0, root FROM med), {_root_sql('mad', keys, 'n2', f"{a('(m + $z)')} + 1 - {a('(m - $z)')}", share)}"""


@query("median_mad", f"WITH {L}, {_robust_sql(_PIECES, _PIECE_AREA, 'SELECT scan_id, h AS z FROM l')} SELECT scan_id, round(m, 6) AS median, round(root, 6) AS mad_height FROM mad")
def median_mad(spark, d):
    return rounded(robust.median_mad(robust.pieces(line_scans(spark, d))))


_LONG = "e AS (SELECT scan_id, least(h0, h1) AS lo, greatest(h0, h1) AS hi, dx AS w FROM s)"


@query("median_mad_nonuniform", f"WITH {S}, {_robust_sql(_LONG, _PIECE_AREA, 'SELECT scan_id, h AS z FROM p')} SELECT scan_id, round(m, 5) AS median, round(root, 5) AS mad_height FROM mad")
def median_mad_nonuniform(spark, d):
    return rounded(robust.median_mad(robust.pieces_nonuniform(profiles(spark, d))), 5)


@query("median_mad_map", f"WITH {M}, {_robust_sql(_TRIANGLES, _TRIANGLE_AREA, 'SELECT scan_id, h AS z FROM m')} SELECT scan_id, round(m, 6) AS median, round(root, 6) AS mad_height FROM mad")
def median_mad_map(spark, d):
    return rounded(robust.median_mad(robust.pieces_map(small_maps(spark, d), ("scan_id",)), ("scan_id",)))


_HALF = 4
_TILTED = f"""f AS (SELECT scan_id, regr_slope(h, ix / {N}::DOUBLE) AS c1, regr_intercept(h, ix / {N}::DOUBLE) AS c0 FROM l GROUP BY scan_id),
 st AS (SELECT scan_id, any_value(c1) AS c1, stddev_pop(h - c0 - c1 * (ix / {N}::DOUBLE)) AS step FROM l JOIN f USING (scan_id) GROUP BY scan_id),
 tr AS (SELECT scan_id, k, c1 + k * step * 4 / {_HALF} AS c1 FROM st, (SELECT unnest(range({-_HALF}, {_HALF + 1})) AS k)),
 lt AS (SELECT scan_id, k, ix, h - c1 * (ix / {N}::DOUBLE) AS h FROM l JOIN tr USING (scan_id))"""
_TILTED_PIECES = _PIECES.replace("scan_id", "scan_id, k").replace("FROM l)", "FROM lt)")


@query("mad_polyfit", f"WITH {L}, {_TILTED}, {_robust_sql(_TILTED_PIECES, _PIECE_AREA, 'SELECT scan_id, k, h AS z FROM lt', 'scan_id, k')} SELECT scan_id, round(arg_min(m, root), 6) AS c0, round(arg_min(c1, root), 6) AS c1, round(min(root), 6) AS mad_height FROM mad JOIN tr USING (scan_id, k) GROUP BY scan_id")
def mad_polyfit(spark, d):
    return rounded(robust.mad_trend(line_scans(spark, d), 1, N, levels=1, half=_HALF))

"""Patches and distances put together from tiles and lines, against those of whole maps."""

import numpy as np
import pytest

from rugosa.operators import geometry, tiles


def masks(spark, ms):
    return spark.createDataFrame([(k, int(i), int(j), bool(v)) for k, m in ms.items() for (i, j), v in np.ndenumerate(m)], "scan_id int, ix int, iy int, mask boolean")


def spiral(n):
    m = np.zeros((n, n), bool)
    x, y, dx, dy, lo_x, hi_x, lo_y, hi_y = 0, 0, 0, 1, 0, n - 1, 0, n - 1
    m[0, 0] = True
    for _ in range(n * n):
        nx_, ny_ = x + dx, y + dy
        if not (0 <= nx_ < n and 0 <= ny_ < n) or (0 <= nx_ + dx < n and 0 <= ny_ + dy < n and m[nx_ + dx, ny_ + dy]):
            dx, dy = dy, -dx
            nx_, ny_ = x + dx, y + dy
            if not (0 <= nx_ < n and 0 <= ny_ < n) or m[nx_, ny_] or (0 <= nx_ + dx < n and 0 <= ny_ + dy < n and m[nx_ + dx, ny_ + dy]):
                break
        x, y = nx_, ny_
        m[x, y] = True
    return m


def table(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize(("tile", "periodic", "stencil"), [(1, False, geometry.EIGHT), (3, True, geometry.EIGHT), (4, False, geometry.FOUR), (7, True, geometry.FOUR), (64, False, geometry.EIGHT)])
def test_any_tiling_gives_the_same_patches(spark, tile, periodic, stencil):
    rng = np.random.default_rng(tile)
    df = masks(spark, {1: rng.uniform(size=(13, 11)) < 0.45, 2: np.zeros((13, 11), bool), 3: np.ones((13, 11), bool)})
    got = tiles.patches(df, 13, 11, periodic=periodic, stencil=stencil, tile=tile)
    assert table(got.select("scan_id", "ix", "iy", "patch_id")) == table(geometry.patches(df, 13, 11, periodic=periodic, stencil=stencil).select("scan_id", "ix", "iy", "patch_id"))


def test_a_patch_that_winds_through_all_tiles(spark):
    m = spiral(40)
    df = masks(spark, {1: m}).drop("scan_id")
    got = tiles.patches(df, 40, 40, (), stencil=geometry.FOUR, tile=8)
    assert {r.patch_id for r in got.collect()} == {0, 1}
    assert got.where("patch_id = 1").count() == m.sum() > 500


def test_distances_by_lines(spark):
    rng = np.random.default_rng(9)
    df = masks(spark, {1: rng.uniform(size=(12, 9)) < 0.05, 2: np.zeros((12, 9), bool), 3: rng.uniform(size=(12, 9)) < 0.4})
    cols = ["scan_id", "ix", "iy", "distance", "closest"]
    got, want = table(tiles.distances(df, 12, 9, tile=5).select(cols)), table(geometry.distances(df, 12, 9).select(cols))
    assert [r[:3] + r[4:] for r in got] == [r[:3] + r[4:] for r in want]
    assert [r[3] for r in got if r[3] is not None] == pytest.approx([r[3] for r in want if r[3] is not None])
    assert tiles.patches(df.limit(0), 12, 9).count() == 0


def filled(h, periodic):
    """Undefined pixels by a dense solve of the whole map's equations."""
    n, (nx, ny) = h.size, h.shape
    a, b = np.zeros((n, n)), np.zeros(n)
    for i in range(nx):
        for j in range(ny):
            k = i * ny + j
            if not np.isnan(h[i, j]):
                a[k, k], b[k] = 1, h[i, j]
                continue
            for di, dj in geometry.FOUR:
                x, y = i + di, j + dj
                if periodic or (0 <= x < nx and 0 <= y < ny):
                    a[k, k] += 1
                    a[k, (x % nx) * ny + y % ny] -= 1
    return np.linalg.solve(a, b).reshape(h.shape)


@pytest.mark.parametrize(("periodic", "whole"), [(False, 1 << 20), (True, 1 << 20), (False, 0), (True, 0)])
def test_holes_are_filled_by_harmonic_functions(spark, periodic, whole):
    rng = np.random.default_rng(4)
    hs = {1: 1e5 + rng.normal(size=(11, 9)), 2: np.add.outer(np.arange(11.0), 2 * np.arange(9.0)), 3: rng.normal(size=(11, 9)), 4: np.full((11, 9), np.nan)}
    hs[1][rng.uniform(size=(11, 9)) < 0.5] = np.nan
    hs[2][3:6, 2:5] = np.nan
    hs[1][0, :4] = np.nan
    rows = [(k, int(i), int(j), None if np.isnan(v) and i % 2 else float(v)) for k, h in hs.items() for (i, j), v in np.ndenumerate(h)]
    df = spark.createDataFrame(rows, "scan_id int, ix int, iy int, h double")
    got = tiles.fill_harmonic(df, 11, 9, periodic=periodic, whole=whole, tile=4).collect()
    assert len(got) == 4 * 99
    out = {k: np.full((11, 9), np.nan) for k in hs}
    for r in got:
        out[r.scan_id][r.ix, r.iy] = np.nan if r.h is None else r.h
    for k in (1, 2, 3):
        assert np.allclose(out[k], filled(hs[k], periodic), atol=1e-7)
    assert np.isnan(out[4]).all()


def searched(starts, on, to, most):
    """Ring by ring from each start, pixel by pixel."""
    nx, ny = starts.shape
    out = np.zeros((nx, ny))
    for i, j in np.argwhere(starts):
        best = 0.0 if to[i, j] else np.inf
        n = 0
        while best > n and n <= most + 1:
            n += 1
            ring = [(a, b) for a in range(-n, n + 1) for b in range(-n, n + 1) if max(abs(a), abs(b)) == n]
            best = min([best, *(np.hypot(a, b) for a, b in ring if to[(i + a) % nx, (j + b) % ny])])
            if not any(on[(i + a) % nx, (j + b) % ny] for a, b in ring):
                break
        out[i, j] = best if best < most else 0.0
    return out


@pytest.mark.parametrize(("share", "most"), [(0.05, 22), (0.3, 22), (0.9, 3)])
def test_shortest_distances(spark, share, most):
    rng = np.random.default_rng(int(share * 100))
    ms = {k: tuple(rng.uniform(size=(11, 8)) < p for p in (0.4, share, 0.04)) for k in (1, 2)} | {3: (np.ones((11, 8), bool), np.ones((11, 8), bool), np.zeros((11, 8), bool))}
    rows = [(k, i, j, bool(s[i, j]), bool(o[i, j]) or None, bool(t[i, j])) for k, (s, o, t) in ms.items() for i in range(11) for j in range(8)]
    df = spark.createDataFrame(rows, "scan_id int, ix int, iy int, start boolean, patch boolean, target boolean")
    got = {(r.scan_id, r.ix, r.iy): r.distance for r in geometry.shortest_distance(df, 11, 8, most=most).collect()}
    for k, m in ms.items():
        want = searched(*m, most)
        assert [got[k, i, j] for i in range(11) for j in range(8)] == pytest.approx(list(want.ravel()))


@pytest.mark.parametrize(("whole", "joins"), [(1 << 20, 0), (0, 2)])
def test_holes_meet_no_broadcast(spark, tmp_path, whole, joins):
    """The table of holes, small in its file, was broadcast, and one task held the rings of all maps that it read."""
    rows = [(k, i, j, None if (3 * i + 5 * j + k) % 7 < 2 else float(i * j)) for k in range(20) for i in range(8) for j in range(8) if k or (i, j) != (4, 4)]
    spark.createDataFrame(rows, "scan_id long, ix int, iy int, h double").write.parquet(f"{tmp_path}/maps")
    out = tiles.fill_harmonic(spark.read.parquet(f"{tmp_path}/maps"), 8, 8, whole=whole, tile=4)
    plan = out._jdf.queryExecution().sparkPlan().toString()
    assert "Broadcast" not in plan
    assert plan.count("SortMergeJoin") == joins
    got = {(r.scan_id, r.ix, r.iy): r.h for r in out.collect()}
    assert set(got) == {r[:3] for r in rows}
    for k in range(1, 20):
        h = np.array([np.nan if v is None else v for s, _, _, v in rows if s == k]).reshape(8, 8)
        assert np.allclose([got[k, i, j] for i in range(8) for j in range(8)], filled(h, False).ravel(), atol=1e-7)

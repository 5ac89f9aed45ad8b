"""Surfaces with known answers, and NumPy against relational forms."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from rugosa.functions import units
from rugosa.operators import bandwidth, bearing, detrend, geometry, kernels, scalars, spectral, stencils, transforms
from rugosa.plans import container, models
from rugosa.plans.registry import registry


def scan(spark, h, scan_id=1):
    return spark.createDataFrame([(scan_id, i, None if v is None else float(v)) for i, v in enumerate(h)], "scan_id long, ix int, h double")


def profile(spark, x, h):
    return spark.createDataFrame([(1, i, float(a), float(b)) for i, (a, b) in enumerate(zip(x, h))], "scan_id long, ix int, x double, h double")


def grid(spark, h, scan_id=1):
    return spark.createDataFrame([(scan_id, i, j, None if not np.isfinite(v) else float(v)) for (i, j), v in np.ndenumerate(np.asarray(h, float))], "scan_id long, ix int, iy int, h double")


def array(df, nx, ny, column="h"):
    out = np.full((nx, ny), np.nan)
    for r in df.collect():
        out[r.ix, r.iy] = np.nan if r[column] is None else r[column]
    return out


@pytest.mark.parametrize("n,k,size", [(16, 2, 1.3), (128, 4, 10.6)])
def test_sine_spectrum_sums_to_a_quarter(spark, n, k, size):
    p = spectral.power_spectrum(scan(spark, np.sin(2 * np.pi * k * np.arange(n) / n)), n, size, tapered=False)
    got = {r.k: r.psd for r in p.collect()}
    assert sum(got.values()) / size == pytest.approx(0.25)
    assert all(v == pytest.approx(0, abs=1e-12) for i, v in got.items() if i != k)


def test_spectrum_is_the_discrete_transform(spark):
    h = np.random.default_rng(0).normal(size=48)
    got = {r.k: (r.q, r.psd) for r in spectral.power_spectrum(scan(spark, h), 48, 3.0, tapered=False).collect()}
    for k in range(24):
        want = abs(sum(v * np.exp(-2j * np.pi * k * i / 48) for i, v in enumerate(h))) ** 2 * 3 / 48**2
        assert got[k] == pytest.approx((2 * np.pi * k / 3, want / 2 if k == 0 else want))


def test_collinear_points_leave_the_spectrum(spark):
    q = [0.3, 1.0, 7.0]
    a = spectral.psd_nonuniform(profile(spark, [0, 2], [1, 3]), q)
    b = spectral.psd_nonuniform(profile(spark, [0, 0.5, 1.5, 2], [1, 1.5, 2.5, 3]), q)
    assert np.allclose(sorted(r.psd for r in a.collect()), sorted(r.psd for r in b.collect()), rtol=1e-10)


def test_triangle_bearing_area(spark):
    h = 0.1 * np.interp(np.arange(2049) % 2048, [0, 1024, 2048], [0, 1, 0])
    got = {round(r.z, 6): r.p for r in bearing.bearing_line(scan(spark, h), [0.025, 0.05]).collect()}
    assert got[0.025] == pytest.approx(0.75, abs=1e-3) and got[0.05] == pytest.approx(0.5, abs=1e-3)


def test_constant_and_ramp_moments(spark):
    r = scalars.moments_line(scan(spark, [2.0] * 5)).first()
    assert (r.m1, r.m2, r.m3, r.m4) == (2, 0, 0, 0)
    r = scalars.moments_line(scan(spark, np.arange(11))).first()
    assert r.m1 == 5 and r.m2 == pytest.approx(100 / 12) and r.m3 == pytest.approx(0, abs=1e-9) and r.m4 == pytest.approx(10**4 / 80)
    t = bearing.triangles(grid(spark, [[1, 1], [1, 1]]))
    assert scalars.moments_map(t).first().m1 == 1


def test_flat_segments_in_nonuniform_moment(spark):
    assert scalars.nonuniform_moment(profile(spark, [0, 1, 3], [2, 2, 2]), 3).first().moment == pytest.approx(8)


def test_detrend_removes_its_polynomials(spark):
    x = np.arange(32) / 32
    for mode, h in (("center", x * 0 + 3), ("height", 1 + 2 * x), ("slope", 1 + 2 * x), ("curvature", 1 + 2 * x - 5 * x**2)):
        assert max(abs(r.h) for r in detrend.detrend(scan(spark, h), mode, 32).collect()) < 1e-9
    xs = np.array([0, 0.5, 2, 3, 7.0])
    assert max(abs(r.h) for r in detrend.detrend_nonuniform(profile(spark, xs, 1 - 3 * xs), 1).collect()) < 1e-9
    g = np.add.outer(np.arange(6) * 2.0, np.arange(5) * -3.0)
    assert np.nanmax(np.abs(array(detrend.detrend_map(grid(spark, g), 1, 6, 5, keys=("scan_id",)), 6, 5))) < 1e-9


def test_derivatives(spark):
    h = np.arange(20.0) ** 2
    assert {r.d for r in stencils.line_derivative(scan(spark, h), 2, 1.0, 2).collect()} == {2.0}
    n = 40
    s = np.sin(2 * np.pi * np.arange(n) / n)
    got = [r.d for r in stencils.line_derivative(scan(spark, s), 1, 1.0, central=True, periodic_n=n).orderBy("ix").collect()]
    assert len(got) == n and np.allclose(got, (np.roll(s, -1) - np.roll(s, 1)) / 2)
    g = np.add.outer(np.arange(5.0) ** 2, np.arange(4.0))
    d = stencils.map_derivative(grid(spark, g), 1, (1, 1), 5, 4, keys=("scan_id",))
    assert d.count() == 12 and {r.dy for r in d.collect()} == {1.0}
    g[2, 2] = np.nan
    d = array(stencils.map_derivative(grid(spark, g), 1, (1, 1), 5, 4, keys=("scan_id",)), 5, 4, "dx")
    assert np.isnan(d[1, 2]) and np.isnan(d[2, 2]) and d[0, 2] == 1


def test_transforms(spark):
    g = np.arange(12.0).reshape(3, 4)
    df = grid(spark, g)
    assert np.array_equal(array(transforms.transpose(df), 4, 3), g.T)
    assert np.array_equal(array(transforms.translate(df, 3, 4, (1, -1)), 3, 4), np.roll(g, (1, -1), (0, 1)))
    m = array(transforms.mirror_stitch(df, 3, 4), 6, 8)
    assert np.array_equal(m, np.block([[g, g[:, ::-1]], [g[::-1], g[::-1, ::-1]]]))
    assert np.array_equal(array(transforms.downsample(df, (1, 2), 3, 4, "average"), 3, 2), g.reshape(3, 2, 2).mean(2))
    with pytest.raises(ValueError):
        transforms.translate(df, 3, 4, (1, 1), periodic=False)
    u = [r.h for r in transforms.to_uniform(profile(spark, [0, 1, 4], [0, 2, 5]), 5).orderBy("ix").collect()]
    assert np.allclose(u, np.interp(np.arange(5), [0, 1, 4], [0, 2, 5]))
    f = [r.h for r in transforms.interpolate_undefined_line(scan(spark, [None, 1, None, None, 4, None])).orderBy("ix").collect()]
    assert np.allclose(f, [1, 1, 2, 3, 4, 4])
    a = array(transforms.align_lines(grid(spark, g + np.array([[5], [0], [-7]])), 4, keys=("scan_id",)), 3, 4)
    assert np.allclose(a, 0)
    assert transforms.equal(df, df, ("ix", "iy")).first().equal and not transforms.equal(df, df.where("ix > 0"), ("ix", "iy")).first().equal


def test_sphere_scan(spark):
    h = np.random.default_rng(1).normal(size=30)
    for periodic in (None, 30):
        got = [r.h for r in transforms.scan_with_sphere(scan(spark, h), 4.0, 1.0, periodic_n=periodic).orderBy("ix").collect()]
        at = [[(h[j % 30] if periodic else h[j]) + math.sqrt(16 - (j - i) ** 2) - 4 for j in range(i - 3, i + 4) if periodic or 0 <= j < 30] for i in range(30)]
        assert np.allclose(got, [max(v) for v in at])


def test_autocorrelations(spark):
    h = np.random.default_rng(2).normal(size=25)
    got = {r.k: r.acf for r in spectral.autocorrelation(scan(spark, h), 0.5).collect()}
    assert all(got[k] == pytest.approx(((h[k:] - h[: 25 - k]) ** 2).mean() / 2) for k in range(25))
    x = np.sort(np.random.default_rng(3).uniform(0, 10, 12))
    y = np.random.default_rng(4).normal(size=12)
    got = {r.r: r.acf for r in spectral.autocorrelation_nonuniform(profile(spark, x, y), [0.5, 3.0]).collect()}
    for r, v in got.items():
        t = np.linspace(x[0], x[-1] - r, 400_001)
        assert v == pytest.approx(((np.interp(t + r, x, y) - np.interp(t, x, y)) ** 2).mean() / 2, rel=1e-4)


def test_variable_bandwidth(spark):
    h = np.random.default_rng(5).normal(size=64)
    for r in bandwidth.variable_bandwidth(scan(spark, h), 64, 2.0).collect():
        parts = h.reshape(r.magnification, -1)
        x = np.arange(parts.shape[1])
        res = [p - np.polyval(np.polyfit(x, p, 1), x) for p in parts]
        assert r.rms == pytest.approx(np.sqrt(np.mean(np.square(res)))) and r.bandwidth == 2 / r.magnification


def test_nonuniform_pieces(spark):
    rng = np.random.default_rng(3)
    x, h = np.sort(rng.uniform(0, 10, 60)), rng.normal(size=60) + 7
    x[30] = x[29] + 1e-9
    rows = [(1, i, float(a), float(b)) for i, (a, b) in enumerate(zip(x, h))] + [(2, 0, 0.0, 1.0), (2, 1, 1.0, 2.0), (3, 0, 0.0, 1.0), (4, 0, 1.0, 1.0), (4, 1, 1.0, 2.0)]
    p = spark.createDataFrame(rows, "scan_id int, ix int, x double, h double")
    want, m, fewest = {}, 1, 60
    while fewest >= 4:
        cuts = np.linspace(x[0], x[-1], m + 1)
        rms, sizes = [], []
        for a, b in zip(cuts, cuts[1:]):
            own = np.concatenate([[a], x[(x > a) & (x < b)], [b]])
            fine = np.concatenate([np.linspace(s, e, 9) for s, e in zip(own, own[1:])])
            w = np.concatenate([np.full(9, (e - s) / 8) * [0.5, *[1] * 7, 0.5] for s, e in zip(own, own[1:])])
            y = np.interp(fine, x, h)
            line = np.polynomial.Polynomial.fit(fine, y, 1, w=np.sqrt(w))
            rms.append(np.sqrt((w * (y - line(fine)) ** 2).sum() / w.sum()))
            sizes.append(len(own))
        want[m], fewest = np.mean(rms), min(sizes)
        m *= 2
    got = {r.magnification: (r.bandwidth, r.rms) for r in bandwidth.variable_bandwidth_nonuniform(p).collect()}
    assert got.keys() == want.keys() and len(got) > 2
    for m, (b, r) in got.items():
        assert b == pytest.approx((x[-1] - x[0]) / m) and r == pytest.approx(want[m], rel=0.03)
    parts = bandwidth.checkerboard_nonuniform(p.where("scan_id = 1"), 4).orderBy("piece", "ix").collect()
    assert len(parts) == 60 + 2 * 3 and all(a.x <= b.x + 1e-12 for a, b in zip(parts, parts[1:]))


def test_patches(spark):
    m = np.array([[1, 1, 0, 0, 0], [0, 0, 0, 1, 0], [0, 0, 1, 0, 0], [1, 0, 0, 0, 1]], bool)
    assert geometry.labelled(m, False).max() == 4 and geometry.labelled(m, True).max() == 2
    assert geometry.labelled(m, False, geometry.FOUR).max() == 5
    big = np.zeros((256, 256), bool)
    big[100:150, 30:80] = True
    assert geometry.labelled(big, True).sum() == 2500
    snake = np.zeros((30, 30), bool)
    snake[::2] = True
    snake[1::4, -1] = snake[3::4, 0] = True
    assert geometry.labelled(snake, False).max() == 1
    p = scan(spark, [1, 0, 1, 1, 0, 1]).withColumn("mask", F.col("h") > 0)
    assert [r.patch_id for r in geometry.runs(p).orderBy("ix").collect()] == [1, 0, 2, 2, 0, 3]
    assert [r.patch_id for r in geometry.runs(p, periodic=True).orderBy("ix").collect()] == [1, 0, 2, 2, 0, 1]
    g = grid(spark, m).withColumn("mask", F.col("h") > 0)
    d = geometry.distances(g, 4, 5)
    assert array(d, 4, 5, "distance")[1, 1] == 1 and array(d, 4, 5, "distance")[0, 0] == 0
    none = geometry.distances(g.withColumn("mask", F.lit(False)), 4, 5)
    assert none.where("distance IS NOT NULL").count() == 0


def test_many_patches_and_distances(spark):
    rng = np.random.default_rng(5)
    masks = rng.random((7, 6, 9)) < np.linspace(0, 0.6, 7)[:, None, None]
    one = [geometry.labelled(m, True) for m in masks]
    assert np.array_equal(geometry.labelled(masks, True), one)
    rows = [(str(k), i, j, bool(masks[k, i, j]) or None) for k in range(7) for i in range(6) for j in range(9)]
    got = {(r.scan_id, r.ix, r.iy): (r.distance, r.closest) for r in geometry.distances(spark.createDataFrame(rows, "scan_id string, ix long, iy int, mask boolean"), 6, 9).collect()}
    assert len(got) == len(rows)
    for k, i, j, _ in rows:
        apart = lambda a, n: min(a % n, -a % n) ** 2
        near = [(apart(a - i, 6) + apart(b - j, 9), one[int(k)][a, b]) for a, b in np.argwhere(masks[int(k)])]
        d, c = got[k, i, j]
        assert (d, c) == ((pytest.approx(min(near)[0] ** 0.5), min(near)[1]) if near else (None, 0))
    noise = rng.random((1024, 1024)) < 0.5
    assert geometry.labelled(noise, False).max() > 1000
    assert geometry.patches(spark.createDataFrame([], "scan_id string, ix int, iy int, mask boolean"), 6, 9).count() == 0


def test_groups_cut_by_batches():
    import pyarrow as pa

    from rugosa.operators import batches

    row = [i for n in (3, 1, 7, 2) for i in range(1, n + 1)]
    for size in range(1, 14):
        cut = [pa.record_batch({"_row": row[i : i + size]}) for i in range(0, len(row), size)]
        got = [x for t, starts in batches._whole(iter(cut)) for x in np.split(np.array(t.column("_row")), starts[1:])]
        assert [len(x) for x in got] == [3, 1, 7, 2]


def test_fourier(spark):
    x = np.arange(8)
    g = np.sin(2 * np.pi * x / 8)[:, None] + np.cos(2 * np.pi * x / 8)[None]
    d = kernels.fourier_derivative(grid(spark, g), 8, 8, 8.0, 8.0)
    assert np.allclose(array(d, 8, 8, "dx"), np.repeat(np.cos(2 * np.pi * x / 8)[:, None] * 2 * np.pi / 8, 8, 1))
    f = array(kernels.interpolate_fourier(grid(spark, g), 8, 8, 16, 24), 16, 24)
    assert np.allclose(f, np.sin(2 * np.pi * np.arange(16) / 16)[:, None] + np.cos(2 * np.pi * np.arange(24) / 24)[None])
    h = np.random.default_rng(6).normal(size=32)
    low = [r.h for r in kernels.shortcut(scan(spark, h), 32, 32.0, 1.0).orderBy("ix").collect()]
    high = [r.h for r in kernels.longcut(scan(spark, h), 32, 32.0, 1.0).orderBy("ix").collect()]
    assert np.allclose(np.add(low, high), h)


def test_interpolation():
    x, y = np.meshgrid(np.arange(16) / 2, np.arange(16) / 2, indexing="ij")
    g = np.random.default_rng(7).normal(size=(8, 8))
    for f in (kernels.bilinear_triangles(g, x, y), kernels.bicubic(g, x, y)["h"]):
        assert np.allclose(f[::2, ::2], g)
    t = np.linspace(0, 2 * np.pi, 40)
    at = np.linspace(0.3, 5.9, 50)
    assert np.allclose(kernels.cubic_spline(t, np.sin(t), at), np.sin(at), atol=1e-3)


def test_binning(spark):
    e = spectral.grid_edges("linear", 0, 4, 4)
    c = spark.createDataFrame([(x, x * x) for x in (0.5, 1.0, 1.5, 3.5, 9.0)], "x double, y double")
    got = {r.bin: r for r in spectral.bin_average(c, "x", "y", e).collect()}
    assert got[0].n == 2 and got[0].x == 0.75 and got[2].n is None and got[3].y == 12.25
    assert len(spectral.grid_edges("log", 1, 100)) == 30


def test_models(spark):
    m = models.SelfAffine(1.0, 2.0, 0.7, 0.1, 20.0)
    q = np.linspace(m.ql, m.qs, 400_000)
    c = np.where(q < m.qr, 1.0, (q / m.qr) ** (-2 - 1.4))
    y = c * q / (2 * np.pi)
    assert m.variance(0.0) == pytest.approx(((y[1:] + y[:-1]) / 2 * np.diff(q)).sum(), rel=1e-4)
    p = models.sphere(spark, 10.0, 8, 8, 4.0, 4.0, "paraboloid")
    assert stencils.rms_laplacian(p, (0.5, 0.5), 8, 8).first().rms_curvature == pytest.approx(0.1)
    s = kernels.fourier_synthesis(spark.createDataFrame([(1, 0.3), (2, 0.3)], "seed long, rms_height double"), 16, 16, 1.0, 1.0, 0.8)
    assert all(r.sq == pytest.approx(0.3) for r in scalars.sq(s, ("scan_id",)).collect())


def test_units():
    assert units.conversion_factor("um", "nm") == pytest.approx(1000)
    with pytest.raises(units.UnitError):
        units.conversion_factor("m", "V")
    assert units.suggest_length_unit("linear", 0, 3e-6) == "µm" and units.suggest_length_unit("log", 1e-9, 1e-3) == "µm"
    assert units.find_length_unit("X (nm)") == "nm" and units.to_ascii("µm") == "um"


def test_container(spark):
    a = spark.createDataFrame([(1, 1, 1.0, 2.0), (1, 1, 1.01, 4.0), (1, 2, 1.0, 7.0), (1, 2, 2.0, 1.0)], "surface_id int, scan_id int, q double, c double")
    got = {r.bin: (r.y, r.n) for r in container.log_average(a, "q", "c").collect()}
    assert got == {-1: (4.5, 2), 0: (4.0, 1), 1: (None, None), 2: (None, None), 3: (1.0, 1)}


def test_registry(spark):
    r = registry.apply("uniform", "Rq", scan(spark, [1.0, 3.0])).first()
    assert r.rq == 1
    with pytest.raises(AttributeError):
        registry.apply("map", "nothing")


@pytest.mark.parametrize("whole", [1 << 20, 0])
def test_pair_correlation_broadcasts_no_pixels(spark, sf, whole):
    from rugosa.sources.tables import small_maps

    m = small_maps(spark, sf)
    assert "Broadcast" not in geometry.pair_correlation(m, m, 8, 8, 3, whole=whole)._jdf.queryExecution().executedPlan().toString()
    rng = np.random.default_rng(8)
    a, b = ([(k, i, j, None if rng.uniform() < 0.2 else float(rng.normal())) for k in (1, 2, None) for i in range(5) for j in range(7) if rng.uniform() < 0.8] for _ in "ab")
    a, b = ([*x, *extra] for x, extra in ((a, [(3, 0, 0, 1.0), (4, 0, 0, 1.0), (5, 0, 0, 1.0)]), (b, [(3, 0, 1, None), (4, 3, 3, 1.0)])))
    want: dict = {}
    for k, i, j, h in a:
        for k2, x, y, g in b:
            for o in geometry.offsets_within(2):
                if k is not None and k == k2 and ((i + o[0]) % 5, (j + o[1]) % 7) == (x, y):
                    s, n = want.get((k, o[0] ** 2 + o[1] ** 2), (None, 0))
                    want[k, o[0] ** 2 + o[1] ** 2] = (s if h is None or g is None else (s or 0.0) + h * g), n + 1
    got = geometry.pair_correlation(*(spark.createDataFrame(x, "scan_id int, ix int, iy int, h double") for x in (a, b)), 5, 7, 2, whole=whole).collect()
    assert {(r.scan_id, r.r2) for r in got} == set(want)
    for r in got:
        s, n = want[r.scan_id, r.r2]
        assert r.c == (None if s is None else pytest.approx(s / n))
        upto = [v[0] / np.sqrt(k[1]) for k, v in want.items() if k[0] == r.scan_id and k[1] <= r.r2 and v[0] is not None]
        assert r.integrated == (pytest.approx(sum(upto)) if upto else None)

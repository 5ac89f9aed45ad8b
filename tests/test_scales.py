"""Reliability options, statistics of maps over scales, surfaces of given spectra and transformations of nonuniform scans."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from rugosa.functions import units
from rugosa.operators import bandwidth, detrend, guards, kernels, reliability, spectral, stencils, transforms


def lines(spark, heights):
    return spark.createDataFrame([(i, j, None if v is None else float(v)) for i, h in enumerate(heights) for j, v in enumerate(h)], "scan_id long, ix int, h double")


def maps(spark, heights):
    return spark.createDataFrame([(i, int(x), int(y), float(v)) for i, h in enumerate(heights) for (x, y), v in np.ndenumerate(h)], "scan_id long, ix int, iy int, h double")


def profiles(spark, scans):
    return spark.createDataFrame([(i, j, float(x), float(h)) for i, (xs, hs) in enumerate(scans) for j, (x, h) in enumerate(zip(xs, hs, strict=True))], "scan_id long, ix int, x double, h double")


def rows(df):
    return sorted((tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in df.collect()), key=str)


@pytest.fixture(scope="module")
def rough():
    rng = np.random.default_rng(4)
    return [rng.normal(size=40).cumsum() for _ in range(3)]


@pytest.fixture(scope="module")
def uneven():
    rng = np.random.default_rng(5)
    return [(np.sort(rng.uniform(0, 30, 25)), rng.normal(size=25).cumsum()) for _ in range(3)]


def test_options_are_the_filters_applied_after(spark, rough):
    p = lines(spark, rough)
    cut = spark.createDataFrame([(0, 5.0), (1, None)], "scan_id long, cutoff double")
    assert rows(spectral.power_spectrum(p, 40, 40.0, reliable=cut)) == rows(guards.reliable_spectrum(spectral.power_spectrum(p, 40, 40.0), cut))
    assert rows(spectral.autocorrelation(p, 1.0, reliable=cut)) == rows(guards.reliable_autocorrelation(spectral.autocorrelation(p, 1.0), cut))
    assert rows(bandwidth.variable_bandwidth(p, 40, 40.0, reliable=cut)) == rows(guards.reliable_bandwidth(bandwidth.variable_bandwidth(p, 40, 40.0), cut))
    assert rows(stencils.scale_dependent(p, [1, 2, 4], 1.0, 2, reliable=cut)) == rows(guards.reliable_scales(stencils.scale_dependent(p, [1, 2, 4], 1.0, 2), cut, 2))
    assert {r.scan_id for r in spectral.power_spectrum(p, 40, 40.0, reliable=cut).collect()} == {0, 1, 2}
    nothing = spark.createDataFrame([(0, 1e9)], "scan_id long, cutoff double")
    assert {r.scan_id for r in bandwidth.variable_bandwidth(p, 40, 40.0, reliable=nothing).collect()} == {1, 2}


def test_mean_distance_of_points_as_the_cutoff(spark, uneven):
    p = profiles(spark, uneven)
    cut = reliability.spacing_cutoffs(p)
    q, r = [0.2, 1.0, 5.0, 20.0], [0.1, 0.5, 2.0, 9.0]
    assert rows(spectral.psd_nonuniform(p, q, reliable=True)) == rows(guards.reliable_spectrum(spectral.psd_nonuniform(p, q), cut))
    assert rows(spectral.autocorrelation_nonuniform(p, r, reliable=True)) == rows(guards.reliable_autocorrelation(spectral.autocorrelation_nonuniform(p, r), cut))
    grid = spectral.power_spectrum_nonuniform(p, n=200, reliable=True).groupBy("scan_id").agg(F.max("q").alias("q")).join(cut, "scan_id").collect()
    assert len(grid) == 3 and all(x.q < 2 * np.pi / x.cutoff for x in grid)
    assert rows(spectral.autocorrelation_grid(p, n=200, reliable=False)) == rows(spectral.autocorrelation_grid(p, n=200))


def test_maps_without_keys_take_one_cutoff(spark):
    h = np.random.default_rng(6).normal(size=(16, 16))
    p, cut = maps(spark, [h]).drop("scan_id"), spark.createDataFrame([(5.0,)], "cutoff double")
    got = bandwidth.variable_bandwidth_map(p, 16, 16, 16.0, 16.0, reliable=cut).collect()
    assert sorted(r.bandwidth for r in got) == [8.0, 16.0]


@pytest.mark.parametrize("undefined", [False, True])
def test_slopes_and_statistics_of_bandwidths(spark, rough, undefined):
    hs = [[None if undefined and j == 7 else v for j, v in enumerate(h)] for h in rough]
    got = bandwidth.variable_bandwidth(lines(spark, hs), 40, 20.0, func=lambda h: F.max(h), slopes=True).collect()
    assert {r.magnification for r in got} == {1, 2, 4, 8}
    for r in got:
        tilt, top = [], -np.inf
        for piece in range(r.magnification):
            at = [j for j in range(40) if j * r.magnification // 40 == piece and hs[r.scan_id][j] is not None]
            b, a = np.polyfit(np.array(at) * 0.5, [hs[r.scan_id][j] for j in at], 1)
            tilt.append(b)
            top = max(top, *(hs[r.scan_id][j] - a - b * j * 0.5 for j in at))
        assert r.value == pytest.approx(top) and r.slope == pytest.approx(np.sqrt(np.mean(np.square(tilt))))


def test_gradients_of_planes(spark):
    x, y = np.meshgrid(np.arange(16) * 0.5, np.arange(8) * 0.25, indexing="ij")
    got = bandwidth.variable_bandwidth_map(maps(spark, [3 * x - 4 * y + 1]), 16, 8, 8.0, 2.0, ("scan_id",), slopes=True, func=lambda h: F.max(F.abs(h))).collect()
    assert got and all(r.gradient == pytest.approx(5) and r.value == pytest.approx(0, abs=1e-9) for r in got)


@pytest.mark.parametrize("periodic", [False, True])
def test_rings(spark, periodic):
    h = np.random.default_rng(7).normal(size=(6, 9))
    p = maps(spark, [h])
    want: dict[int, list[float]] = {}
    for a in range(6):
        for b in range(9):
            other = np.roll(h, (-a, -b), (0, 1)) if periodic else h[a:, b:]
            own = h if periodic else h[: 6 - a, : 9 - b]
            u, v = (min(a, 6 - a), min(b, 9 - b)) if periodic else (a, b)
            want.setdefault(int(np.hypot(u * 0.5, v * 1.0) / 0.5 + 0.5), []).append(((other - own) ** 2).mean() / 2)
    got = {r.k: r for r in spectral.autocorrelation_rings(p, 6, 9, 3.0, 9.0, periodic=periodic).collect()}
    assert set(got) == set(want)
    assert all(got[k].n == len(v) and got[k].r == k * 0.5 and got[k].acf == pytest.approx(np.mean(v), abs=1e-9) for k, v in want.items())
    curvature = {r.k: r for r in spectral.curvature_from_area_acf(spectral.autocorrelation_rings(p, 6, 9, 3.0, 9.0, periodic=periodic)).collect()}
    for k, r in curvature.items():
        assert r.r == 2 * got[k].r and r.curvature == pytest.approx(4 * np.sqrt(8 * got[k].acf - 2 * got[2 * k].acf) / r.r**2)


def test_rings_count_pairs_of_defined_heights_alone(spark):
    p = maps(spark, [np.arange(9.0).reshape(3, 3)]).withColumn("h", F.expr("CASE WHEN ix = 0 AND iy = 0 THEN NULL ELSE h END"))
    with pytest.raises(Exception, match="UndefinedData"):
        spectral.autocorrelation_rings(p, 3, 3, 3.0, 3.0).collect()
    assert sum(r.n for r in spectral.autocorrelation_rings(p, 3, 3, 3.0, 3.0, undefined="skip").collect()) == 8
    assert spectral.autocorrelation_rings(p, 3, 3, 3.0, 3.0, undefined="drop").count() == 0


@pytest.mark.parametrize(("nx", "ny"), [(7, 5), (6, 8), (1, 4), (2, 2)])
def test_surfaces_have_the_spectrum_they_were_given(nx, ny):
    h = kernels.spectrum_map(nx, ny, 2.0, 3.0, lambda q: 1 / (1 + q**3), None, 11)
    q = np.hypot(*np.meshgrid(2 * np.pi * np.fft.fftfreq(nx, 2 / nx), 2 * np.pi * np.fft.fftfreq(ny, 3 / ny), indexing="ij"))
    assert np.abs(np.fft.fft2(h)) ** 2 * 6 / (nx * ny) ** 2 == pytest.approx(1 / (1 + q**3))


def test_random_amplitudes_have_the_spectrum_as_their_mean(spark):
    s = spark.range(400).select(F.col("id").alias("seed"))
    h = kernels.fourier_synthesis(s, 4, 4, 4.0, 4.0, psd=lambda q, row: np.where(q > 0, 1.0, np.inf))
    means = [r.m for r in spectral.spectrum_area(h, 4, 4, 4.0, 4.0).where("kx > 0 OR ky > 0").groupBy("kx", "ky").agg(F.avg("psd").alias("m")).collect()]
    assert len(means) == 15 and np.mean(means) == pytest.approx(1, abs=0.1)
    assert h.groupBy("scan_id").agg(F.abs(F.avg("h")).alias("m")).agg(F.max("m")).first()[0] < 1e-9
    assert rows(h.where("scan_id = 3")) == rows(kernels.fourier_synthesis(s.where("seed = 3"), 4, 4, 4.0, 4.0, psd=lambda q, row: np.where(q > 0, 1.0, np.inf)))


def test_what_synthesis_refuses(spark):
    s = spark.range(1).select(F.col("id").alias("seed"))
    with pytest.raises(ValueError, match="either"):
        kernels.fourier_synthesis(s, 4, 4, 1.0, 1.0)
    with pytest.raises(ValueError, match="negative or not finite"):
        kernels.spectrum_map(4, 4, 1.0, 1.0, lambda q: -q, None, 0)
    with pytest.raises(ValueError, match="slopes"):
        kernels.interpolate_map(maps(spark, [np.zeros((2, 2))]), 2, 2, 2, "bicubic", slopes="none")


def test_bicubic_of_a_wave_by_its_own_slopes(spark):
    x = np.arange(16)
    h = np.sin(2 * np.pi * x / 16)[:, None] + np.cos(4 * np.pi * x / 16)[None]
    got = kernels.bicubic(h, *np.meshgrid(x * 1.0, x * 1.0, indexing="ij"), "fourier")
    assert got["dx"] == pytest.approx(np.repeat(2 * np.pi / 16 * np.cos(2 * np.pi * x / 16)[:, None], 16, 1))
    assert got["dy"] == pytest.approx(np.repeat(-4 * np.pi / 16 * np.sin(4 * np.pi * x / 16)[None], 16, 0))


def test_sphere_over_uneven_points(spark, uneven):
    got = {(r.scan_id, r.ix): r.h for r in transforms.scan_with_sphere_nonuniform(profiles(spark, uneven), 3.0).collect()}
    for i, (x, h) in enumerate(uneven):
        for j in range(len(x)):
            near = (x >= x[j] - 3) & (x < x[j] + 3)
            assert got[i, j] == pytest.approx(max(h[near] + np.sqrt(9 - (x[near] - x[j]) ** 2) - 3))
    with pytest.raises(Exception, match="ReentrantData"):
        transforms.scan_with_sphere_nonuniform(profiles(spark, [([0, 2, 1], [0, 0, 0])]), 1.0).collect()


def test_trends_of_nonuniform_scans(spark, uneven):
    p = profiles(spark, uneven)
    c = {m: {r.scan_id: r for r in detrend.nonuniform_coefficients(p, m).collect()} for m in detrend.NONUNIFORM_MODES}
    for i, (x, h) in enumerate(uneven):
        mean = ((h[1:] + h[:-1]) / 2 * np.diff(x)).sum() / (x[-1] - x[0])
        assert c["mean"][i].c0 == pytest.approx(mean) and c["center"][i].c0 == pytest.approx(mean)
        assert (c["slope"][i].c0, c["slope"][i].c1) == pytest.approx((mean, np.mean(np.diff(h) / np.diff(x))))
        fine = np.linspace(x[0], x[-1], 200_001)
        assert c["median"][i].c0 == pytest.approx(np.median(np.interp(fine, x, h)), abs=1e-3)
        assert (c["height"][i].c1, c["height"][i].c0) == pytest.approx(tuple(np.polyfit(fine, np.interp(fine, x, h), 1)), abs=1e-3)
        assert c["curvature"][i] == c["rms-curvature"][i] and c["height"][i] == c["rms-tilt"][i]
    left = {(r.scan_id, r.ix): r.h for r in detrend.detrend_nonuniform(p, "slope").collect()}
    assert all(left[i, j] == pytest.approx(h[j] - c["slope"][i].c0 - c["slope"][i].c1 * x[j]) for i, (x, h) in enumerate(uneven) for j in range(len(x)))
    with pytest.raises(ValueError, match="mode"):
        detrend.detrend_nonuniform(p, "none")


def dense_spline(x, h, at):
    """The same spline from one dense system for the coefficients of all pieces."""
    n = len(x) - 1
    a, b = np.zeros((4 * n, 4 * n)), np.zeros(4 * n)
    row = 0
    power = lambda t, k: [np.prod(np.arange(j, j - k, -1)) * t ** (j - k) if j >= k else 0.0 for j in range(4)]
    for i in range(n):
        for t, y in ((0.0, h[i]), (x[i + 1] - x[i], h[i + 1])):
            a[row, 4 * i : 4 * i + 4], b[row] = power(t, 0), y
            row += 1
    for i in range(n - 1):
        for k in (1, 2, 3) if i in (0, n - 2) else (1, 2):
            a[row, 4 * i : 4 * i + 4], a[row, 4 * i + 4 : 4 * i + 8] = power(x[i + 1] - x[i], k), [-v for v in power(0.0, k)]
            row += 1
    c = np.linalg.solve(a[:row], b[:row]).reshape(n, 4)
    i = np.clip(np.searchsorted(x, at, side="right") - 1, 0, n - 1)
    return (c[i] * (at - x[i])[:, None] ** np.arange(4)).sum(1)


def test_cubic_splines_between_uneven_points(spark, uneven):
    scans = [*uneven, ([0, 1, 2.5, 4], [1, 0, 2, 1]), ([0, 1, 2], [0, 1, 0]), ([0, 1, 2, 3, 4], [0, 1, None, 0, 1])]
    p = spark.createDataFrame([(i, j, float(x), None if h is None else float(h)) for i, (xs, hs) in enumerate(scans) for j, (x, h) in enumerate(zip(xs, hs, strict=True))], "scan_id long, ix int, x double, h double")
    want, asked = {}, []
    for i, (x, h) in enumerate(scans):
        at = np.linspace(x[0], x[-1], 57)
        asked += [(i, j, float(v)) for j, v in enumerate(at)] + [(i, 100, float(x[0]) - 1), (i, 101, float(x[-1]) + 1)]
        if len(x) >= 4 and None not in h:
            want |= {(i, j): v for j, v in enumerate(dense_spline(np.array(x, float), np.array(h, float), at))}
    got = {(r.scan_id, r.j): r.h for r in transforms.interpolated_cubic(p, spark.createDataFrame(asked, "scan_id long, j int, x double")).collect()}
    assert len(got) == len(asked) and {k for k, v in got.items() if v is not None} == set(want)
    assert all(got[k] == pytest.approx(v, rel=1e-6, abs=1e-6) for k, v in want.items())


@pytest.mark.parametrize("direction", ["x", "y"])
@pytest.mark.parametrize("degree", [0, 1, 2, 3])
def test_lines_are_aligned_in_both_directions(spark, direction, degree):
    h = np.random.default_rng(8).normal(size=(5, 9)) + np.arange(5)[:, None] ** 2
    hole = {(1, y) for y in range(9) if y not in (3, 6)} | {(4, y) for y in range(9)}
    p = spark.createDataFrame([((int(x), int(y)) if direction == "x" else (int(y), int(x))) + (None if (x, y) in hole else float(v),) for (x, y), v in np.ndenumerate(h)], "ix int, iy int, h double")
    rest, centre = {}, {}
    for x in range(5):
        at = np.array([y for y in range(9) if (x, y) not in hole], float)
        if len(at):
            rest[x] = dict(zip(at.astype(int), h[x, at.astype(int)] - np.polyval(np.polyfit(at, h[x, at.astype(int)], min(degree, len(at) - 1)), at), strict=True))
            centre[x] = np.median(list(rest[x].values()))
    mean = np.mean(list(centre.values()))
    got = {(r.ix, r.iy) if direction == "x" else (r.iy, r.ix): r.h for r in transforms.align_lines(p, 9, degree, direction=direction).collect()}
    assert len(got) == 45 and {k for k, v in got.items() if v is None} == hole
    assert all(got[x, y] == pytest.approx(v - centre[x] + mean, abs=1e-6) for x, of in rest.items() for y, v in of.items())


def test_units_of_curves(spark):
    c = spark.createDataFrame([("um", 2.0, 3.0), ("nm", 2.0, 3.0), (" Å ", 2.0, 3.0)], "unit string, q double, psd double")
    got = sorted((r.unit, r.q, r.psd) for r in units.curves_to_unit(c, "nm", {"q": -1, "psd": 3}).collect())
    assert [g[0] for g in got] == ["nm"] * 3
    assert [g[1:] for g in got] == [pytest.approx(w) for w in ((0.002, 3e9), (2.0, 3.0), (20.0, 0.003))]
    for unit in (None, "V", "parsec"):
        with pytest.raises(Exception, match="UnitError"):
            units.curves_to_unit(c.withColumn("unit", F.lit(unit).cast("string")), "nm", {"q": -1}).collect()
    with pytest.raises(units.UnitError):
        units.curves_to_unit(c, "V", {"q": -1})

"""Transforms and correlations against their definitions, whole and in blocks of any width."""

import numpy as np
import pytest

from rugosa.operators import fourier, spectral

RNG = np.random.default_rng(11)


def lines(spark, scans):
    return spark.createDataFrame([(s, i, None if x is None else float(x)) for s, h in scans.items() for i, x in enumerate(h)], "scan_id int, ix int, h double")


def maps(spark, hs, keyed=True):
    rows = [(k, int(i), int(j), None if np.isnan(v) else float(v)) for k, h in hs.items() for (i, j), v in np.ndenumerate(h)]
    df = spark.createDataFrame(rows, "scan_id int, ix int, iy int, h double")
    return df if keyed else df.drop("scan_id")


def pairs_line(h, k, periodic):
    h = np.array([np.nan if x is None else x for x in h], float)
    d = (np.roll(h, -k) - h if periodic else h[k:] - h[: len(h) - k]) ** 2
    return np.nansum(d), int(np.isfinite(d).sum())


def pairs_map(h, a, b, periodic):
    d = (np.roll(h, (-a, -b), (0, 1)) - h if periodic else h[a:, b:] - h[: h.shape[0] - a, : h.shape[1] - b]) ** 2
    return np.nansum(d), int(np.isfinite(d).sum())


@pytest.mark.parametrize("periodic", [False, True])
def test_line_correlations(spark, periodic):
    scans = {1: 1e6 + RNG.normal(size=33), 2: RNG.normal(size=33), 3: RNG.normal(size=7), 4: [5.0], 5: [1.0, None, 4.0, 2.0, None]}
    got = {(r.scan_id, r.k): (r.s, r.n) for r in fourier.correlation_line(lines(spark, scans), periodic=periodic, strict=False).collect()}
    assert len(got) == sum(map(len, scans.values()))
    for (i, k), (s, n) in got.items():
        want = pairs_line(scans[i], k, periodic)
        assert n == want[1] and s == pytest.approx(want[0], abs=1e-6)
    with pytest.raises(Exception, match="UndefinedData"):
        fourier.correlation_line(lines(spark, scans)).collect()
    assert fourier.correlation_line(lines(spark, scans).limit(0)).count() == 0


def test_a_long_scan(spark):
    h = np.cumsum(RNG.normal(size=100_000))
    df = spark.range(100_000).selectExpr("1 AS scan_id", "cast(id as int) AS ix")
    at = spark.createDataFrame([(i, float(v)) for i, v in enumerate(h)], "ix int, h double")
    acf = spectral.autocorrelation(df.join(at, "ix"), 0.5)
    got = {r.k: (r.r, r.acf) for r in acf.where("k IN (0, 1, 777, 50000, 99999)").collect()}
    for k in (0, 1, 777, 50_000, 99_999):
        s, n = pairs_line(h, k, False)
        assert got[k] == (k / 2, pytest.approx(s / n / 2, rel=1e-6, abs=1e-9))
    assert acf.count() == 100_000


@pytest.mark.parametrize(("whole", "width"), [(1 << 18, None), (0, None), (0, 1), (0, 5)])
@pytest.mark.parametrize("periodic", [False, True])
def test_map_correlations(spark, whole, width, periodic):
    hs = {1: 1e4 + RNG.normal(size=(9, 14)), 2: RNG.normal(size=(9, 14))}
    hs[2][3:5, 2:9] = np.nan
    got = {(r.scan_id, r.a, r.b): (r.s, r.n) for r in fourier.correlation_area(maps(spark, hs), 9, 14, periodic=periodic, strict=False, whole=whole, width=width).collect()}
    assert len(got) == 2 * 9 * 14
    for (i, a, b), (s, n) in got.items():
        want = pairs_map(hs[i], a, b, periodic)
        assert n == want[1] and s == pytest.approx(want[0], abs=1e-6)


@pytest.mark.parametrize(("whole", "width"), [(1 << 18, None), (0, 1), (0, 3), (0, 128)])
@pytest.mark.parametrize("shape", [(8, 6), (5, 7)])
def test_map_spectra(spark, whole, width, shape):
    h = RNG.normal(size=shape)
    df = maps(spark, {1: h}, keyed=False)
    got = np.full(shape, np.nan)
    for r in fourier.power_area(df, *shape, (), whole=whole, width=width).collect():
        assert np.isnan(got[r.kx, r.ky])
        got[r.kx, r.ky] = r.power
    assert np.allclose(got, np.abs(np.fft.fft2(h)) ** 2)
    with pytest.raises(Exception, match="UndefinedData"):
        fourier.power_area(df.where("ix + iy <> 2"), *shape, (), whole=whole, width=width).collect()
    with pytest.raises(Exception, match="UndefinedData"):
        fourier.power_area(df.where("ix <> 2"), *shape, (), whole=whole, width=width).collect()


def test_a_large_map(spark):
    n = 1024
    df = spark.range(n * n).selectExpr(f"cast(id div {n} as int) AS ix", f"cast(id % {n} as int) AS iy", "sin(id * 0.37) + 0.001 * (id % 1024) AS h")
    i = np.arange(n * n)
    h = (np.sin(i * 0.37) + 0.001 * (i % n)).reshape(n, n)
    s = {(r.a, r.b): (r.s, r.n) for r in fourier.correlation_area(df, n, n, ()).where("(a, b) IN ((0, 0), (3, 5), (1000, 2), (0, 1023))").collect()}
    for (a, b), (got, count) in s.items():
        want = pairs_map(h, a, b, False)
        assert count == want[1] and got == pytest.approx(want[0], rel=1e-7, abs=1e-6)
    assert len(s) == 4


def test_undefined_heights_are_refused_dropped_or_skipped(spark):
    for hole in (None, float("nan")):
        scans = lines(spark, {1: [1.0, 2.0, 4.0, 3.0], 2: [1.0, hole, 4.0, 3.0]})
        h = np.arange(12.0).reshape(3, 4)
        m = maps(spark, {1: h, 2: np.where(h == 5, np.nan, h)}) if hole is None else maps(spark, {1: h, 2: h}).selectExpr("scan_id", "ix", "iy", "CASE WHEN scan_id = 2 AND h = 5 THEN double('NaN') ELSE h END AS h")
        for f in (lambda u: spectral.power_spectrum(scans, 4, 4.0, undefined=u), lambda u: spectral.autocorrelation(scans, 1.0, undefined=u), lambda u: spectral.autocorrelation_periodic(scans, 1.0, 4, undefined=u), lambda u: spectral.spectrum_area(m, 3, 4, 3.0, 4.0, undefined=u), lambda u: spectral.autocorrelation_area(m, 3, 4, undefined=u), lambda u: spectral.power_spectrum_area(m, 3, 4, 3.0, 4.0, undefined=u)):
            with pytest.raises(Exception, match="UndefinedData"):
                f("raise").collect()
            assert {r.scan_id for r in f("drop").collect()} == {1}
        got = {(r.scan_id, r.k): r.acf for r in spectral.autocorrelation(scans, 1.0, undefined="skip").collect()}
        assert got[2, 1] == pytest.approx(0.5) and got[2, 2] == pytest.approx(4.5) and got[2, 3] == pytest.approx(2.0)


def test_nonuniform_scans_on_their_default_grid(spark):
    x = np.array([0, 1, 3, 3.5, 6, 8.0])
    h = np.array([0, 2, 1, 3, -1, 0.0])
    p = spark.createDataFrame([(1, i, float(a), float(b)) for i, (a, b) in enumerate(zip(x, h))], "scan_id int, ix int, x double, h double")
    n = 5 * 16  # five points for each smallest distance
    even = np.interp(np.linspace(0, 8, n), x, h)
    got = {r.k: (r.q, r.psd) for r in spectral.power_spectrum_nonuniform(p, tapered=False).collect()}
    assert len(got) == n // 2
    want = np.abs(np.fft.rfft(even)) ** 2 * 8 / n**2
    assert all(got[k] == pytest.approx((2 * np.pi * k / 8, want[k] / (2 if k == 0 else 1)), abs=1e-9) for k in range(n // 2))
    acf = {r.k: (r.r, r.acf) for r in spectral.autocorrelation_grid(p).collect()}
    assert all(acf[k] == pytest.approx((8 * k / n, np.mean((even[k:] - even[: n - k]) ** 2) / 2), abs=1e-9) for k in range(n))
    exact = spectral.autocorrelation_nonuniform(p, [1.0, 2.5]).collect()  # the integral over straight pieces, which the grid approaches
    for r in exact:
        k = round(r.r * (n - 1) / 8)
        assert acf[k][1] == pytest.approx(r.acf, rel=0.05)
    back = spark.createDataFrame([(1, 0, 0.0, 1.0), (1, 1, 2.0, 1.0), (1, 2, 1.0, 1.0)], "scan_id int, ix int, x double, h double")
    with pytest.raises(Exception, match="ReentrantData"):
        spectral.power_spectrum_nonuniform(back, n=8).collect()
    assert spectral.autocorrelation_grid(back, n=8, reentrant="drop").count() == 0

"""Every analysis that can't take undefined heights or overhangs says so, or leaves the scan out, as it is told."""

import pytest

from rugosa.operators import bandwidth, guards, scalars, spectral, stencils, transforms

UNDEFINED = {
    "moments": lambda p, u: scalars.moments_line(p, undefined=u),
    "spectrum": lambda p, u: spectral.power_spectrum(p, 8, 8.0, undefined=u),
    "correlation": lambda p, u: spectral.autocorrelation(p, 1.0, undefined=u),
    "periodic": lambda p, u: spectral.autocorrelation_periodic(p, 1.0, 8, undefined=u),
    "bandwidth": lambda p, u: bandwidth.variable_bandwidth(p, 8, 8.0, undefined=u),
    "scales": lambda p, u: stencils.scale_dependent(p, [1, 2], 1.0, undefined=u),
}
REENTRANT = {
    "spectrum": lambda p, r: spectral.psd_nonuniform(p, [1.0], reentrant=r),
    "grid": lambda p, r: spectral.power_spectrum_nonuniform(p, n=8, reentrant=r),
    "correlation": lambda p, r: spectral.autocorrelation_nonuniform(p, [1.0], reentrant=r),
    "heights": lambda p, r: spectral.height_height_autocorrelation(p, [1.0], reentrant=r),
    "correlations": lambda p, r: spectral.autocorrelation_grid(p, n=8, reentrant=r),
    "resampling": lambda p, r: transforms.to_uniform(p, 8, reentrant=r),
    "derivative": lambda p, r: stencils.nonuniform_derivative(p, reentrant=r),
    "curvature": lambda p, r: scalars.nonuniform_rddq(p, reentrant=r),
    "bandwidth": lambda p, r: bandwidth.variable_bandwidth_nonuniform(p, reentrant=r),
}


@pytest.mark.parametrize("name", UNDEFINED)
@pytest.mark.parametrize("hole", [None, float("nan")])
def test_undefined_heights(spark, name, hole):
    h = {1: [1.0, 2.0, 4.0, 3.0, 1.0, 0.0, 2.0, 2.5], 2: [1.0, hole, 4.0, 3.0, 1.0, 0.0, 2.0, 2.5]}
    p = spark.createDataFrame([(s, i, x) for s, v in h.items() for i, x in enumerate(v)], "scan_id int, ix int, h double")
    with pytest.raises(Exception, match="UndefinedData"):
        UNDEFINED[name](p, "raise").collect()
    assert {r.scan_id for r in UNDEFINED[name](p, "drop").collect()} == {1}
    tidy = lambda rows: sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in rows)
    assert tidy(UNDEFINED[name](p, "drop").collect()) == tidy(UNDEFINED[name](p.where("scan_id = 1"), "raise").collect())


@pytest.mark.parametrize("name", REENTRANT)
def test_overhangs(spark, name):
    x = {1: [0.0, 1.0, 2.5, 3.0, 4.0, 6.0], 2: [0.0, 1.0, 0.5, 3.0, 4.0, 6.0], 3: [0.0, 1.0, 1.0, 3.0, 4.0, 6.0]}
    p = spark.createDataFrame([(s, i, v, float(i * i % 5)) for s, xs in x.items() for i, v in enumerate(xs)], "scan_id int, ix int, x double, h double")
    for bad in (2, 3):
        with pytest.raises(Exception, match="ReentrantData"):
            REENTRANT[name](p.where(f"scan_id IN (1, {bad})"), "raise").collect()
    assert {r.scan_id for r in REENTRANT[name](p, "drop").collect()} == {1}


def test_other_words_are_refused(spark):
    p = spark.createDataFrame([(1, 0, 0.0, 1.0)], "scan_id int, ix int, x double, h double")
    for f in (guards.defined, guards.single_valued):
        with pytest.raises(ValueError, match="none of"):
            f(p, "perhaps")
        assert f(p, "skip").count() == 1

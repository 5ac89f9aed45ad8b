import numpy as np
import pytest

from rugosa.functions import results, units
from rugosa.operators import kernels, reliability, spectral
from rugosa.sources import files


def scans(spark, heights):
    return spark.createDataFrame([(i, j, None if v is None else float(v)) for i, h in enumerate(heights) for j, v in enumerate(h)], "scan_id long, ix int, h double")


def test_tip_cutoff_is_that_of_the_kernel(spark):
    rng = np.random.default_rng(1)
    hs = [np.cumsum(rng.normal(size=40)) * a for a in (0.01, 0.1, 1.0, 5.0)]
    radii = spark.createDataFrame([(i, 8.0) for i in range(4)], "scan_id long, tip_radius double")
    got = {r.scan_id: r.cutoff for r in reliability.tip_cutoffs(scans(spark, hs), radii, 40, 0.5).collect()}
    want = {i: kernels.reliability_cutoff_sphere(h, 0.5, 8.0) for i, h in enumerate(hs)}
    assert {i for i, c in want.items() if c is not None} == set(got)
    assert all(abs(got[i] - want[i]) < 1e-9 for i in got)


def test_short_cutoffs(spark):
    info = spark.createDataFrame([(0, None, None), (1, None, 3.0), (2, 1e9, 3.0)], "scan_id long, tip_radius double, resolution double")
    p = scans(spark, [np.sin(np.arange(20) / 9)] * 3)
    assert {r.scan_id: r.cutoff for r in reliability.short_cutoffs(p, info, 20, 1.0).collect()}[0] is None
    got = {r.scan_id: r.cutoff for r in reliability.short_cutoffs(p, info, 20, 1.0, other=4.0).collect()}
    assert got[0] == got[1] == 4.0 and got[2] >= 4.0


@pytest.mark.parametrize("n", [16, 300])
def test_undefined_heights_are_refused_at_any_length(spark, n):
    p = scans(spark, [[None, *range(1, n)], range(n)])
    with pytest.raises(Exception, match="UndefinedData"):
        spectral.power_spectrum(p, n, float(n)).collect()
    assert {r.scan_id for r in spectral.power_spectrum(p, n, float(n), undefined="drop").collect()} == {1}


def test_overhangs_are_refused(spark):
    rows = [(0, 0, 0.0, 1.0), (0, 1, 1.0, 2.0), (0, 2, 0.5, 0.0), (1, 0, 0.0, 1.0), (1, 1, 1.0, 2.0)]
    p = spark.createDataFrame(rows, "scan_id long, ix int, x double, h double")
    with pytest.raises(Exception, match="ReentrantData"):
        spectral.autocorrelation_nonuniform(p, [0.5]).collect()
    assert {r.scan_id for r in reliability.single_valued(p, "drop").collect()} == {1}


def test_no_reliable_data_leaves_the_scan_out(spark):
    psd = spark.createDataFrame([(s, 1.0 * k, 1.0) for s in (0, 1) for k in range(4)], "scan_id long, q double, psd double")
    cut = spark.createDataFrame([(0, 2 * np.pi / 0.5), (1, 2 * np.pi / 2.5)], "scan_id long, cutoff double")
    assert sorted((r.scan_id, r.q) for r in reliability.reliable_spectrum(psd, cut).collect()) == [(1, 0.0), (1, 1.0), (1, 2.0)]


def test_text_of_results(spark):
    df = spark.createDataFrame([(1, float("nan"), None, 93784000005), (2, 0.5, "a", -1000000)], "i long, x double, s string, us long")
    got = [r[0] for r in df.select(results.iso_duration(df.us)).collect()]
    assert got == ["P1DT02H03M04.000005S", "-P0DT00H00M01S"]
    assert [r.json for r in results.json_rows(df.drop("us")).orderBy("json").collect()] == ['{"i":1,"x":null,"s":null}', '{"i":2,"x":0.5,"s":"a"}']
    assert units.suggest_length_unit_for_data("linear", df, "x", "µm") == "nm"


def test_height_channels(spark):
    rows = [("f", 0, "Height", "nm"), ("f", 1, "Amplitude", "V"), ("f", 2, "Height#2", "µm"), ("g", 0, "Height", None)]
    c = spark.createDataFrame(rows, "path string, channel_index int, channel_id string, unit string")
    assert [(r.path, r.channel_id) for r in files.height_index_to_channel_id(c, 1).collect()] == [("f", "Height#2")]
    assert sorted((r.path, r.height_index) for r in files.channel_id_to_height_index(c, "Height").collect()) == [("f", 0), ("g", 0)]

"""Chains of operators as rows, and derivatives at any distance."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from rugosa.operators import kernels, scalars, stencils, transforms
from rugosa.plans.chains import Chain, pipeline_function
from rugosa.plans.registry import Registry, registry


def lines(spark, scans):
    return spark.createDataFrame([(s, i, float(x)) for s, h in scans.items() for i, x in enumerate(h)], "scan_id int, ix int, h double")


def table(df):
    return sorted(map(tuple, df.select("scan_id", "ix", F.round("h", 9)).collect()))


def test_a_chain_that_was_read_back_does_what_the_direct_calls_do(spark, tmp_path):
    rng = np.random.default_rng(1)
    a, b = (lines(spark, {1: rng.normal(size=20), 2: rng.normal(size=20)}) for _ in range(2))
    chain = Chain().then("uniform", "detrend", mode="curvature", n=20, keys=("scan_id",)).then("uniform", "scale", heights=-2.0)
    chain.rows(spark).write.parquet(f"{tmp_path}/chain")
    again = Chain.read(spark.read.parquet(f"{tmp_path}/chain"))
    assert again == chain and str(again).startswith("detrend(keys=('scan_id',), mode='curvature'")
    for df in (a, b):
        from rugosa.operators import detrend

        assert table(again.on(df)) == table(transforms.scale(detrend.detrend(df, "curvature", 20), -2.0))
    assert table(Chain().on(a)) == table(a)


def test_what_cannot_be_replayed_is_refused(spark):
    with pytest.raises(AttributeError, match="no 'nothing'"):
        Chain().then("uniform", "nothing")
    with pytest.raises(TypeError):
        Chain().then("uniform", "scale", heights=lambda: 1)
    with pytest.raises(ValueError, match="JSON"):
        Chain().then("uniform", "scale", heights={1: 2})
    rows = Chain().then("uniform", "scale", heights=1.0).then("uniform", "scale", heights=2.0).rows(spark)
    for bad in (rows.where("step = 1"), rows.unionAll(rows)):
        with pytest.raises(ValueError, match="one chain"):
            Chain.read(bad)


def test_own_steps(spark):
    own = Registry()

    @pipeline_function("lift", "uniform", citations=("doi:10.0/own",), of=own)
    def lift(points, by):
        return points.withColumn("h", F.col("h") + by)

    chain = Chain((), own).then("uniform", "lift", by=1.5).then("uniform", "lift", by=1.0)
    assert [r.h for r in Chain.read(chain.rows(spark), own).on(lines(spark, {1: [0.0, 1.0]})).orderBy("ix").collect()] == [2.5, 3.5]
    assert chain.rows(spark).first().citations == ["doi:10.0/own"]
    assert ("uniform", "lift") not in registry.entries


@pytest.mark.parametrize("scale", [1, 1.5, 2, 2.25, 3.999])
@pytest.mark.parametrize("order", [1, 2, 3])
def test_stencils_at_any_distance(order, scale):
    h = np.random.default_rng(2).normal(size=40)
    at = lambda x: np.interp(x, np.arange(40), h)
    for table in (stencils.LINE, stencils.LINE_CENTRAL):
        if order in table:
            wide = stencils.spread(table[order], scale)
            assert sum(c * h[20 + i] for i, c in wide.items()) == pytest.approx(sum(c * at(20 + i * scale) for i, c in table[order].items()))


def test_derivative_of_a_parabola_over_two_and_a_half_points(spark):
    df = lines(spark, {1: 0.5 * np.arange(12.0) ** 2})
    got = {r.ix: r.d for r in stencils.line_derivative(df, 1, 2.0, 2.5).collect()}
    assert got == {i: pytest.approx(((i + 2) ** 2 / 4 + (i + 3) ** 2 / 4 - i * i / 2) / 5) for i in range(9)}
    assert stencils.line_derivative(df, 1, 1.0, 2.5, periodic_n=12).count() == 12
    with pytest.raises(ValueError):
        stencils.line_derivative(df, 1, 1.0, 0.5)


def test_cutoffs_and_filters(spark):
    x = np.arange(64) * 2 * np.pi / 64
    slow, fast = np.sin(2 * x), np.sin(20 * x)
    df = lines(spark, {1: slow + fast, 2: slow})
    got = {r.scan_id: r.rdq for r in scalars.rdq(df, 1.0, cutoff=10.0).collect()}
    assert got[1] == pytest.approx(got[2]) and got[2] == pytest.approx(np.sqrt(np.mean(np.diff(slow) ** 2)))
    assert {r.scan_id: r.rdq for r in scalars.rdq(df, 1.0).collect()}[1] > 2 * got[1]
    low = {r.ix: r.h for r in kernels.shortcut(df, 64, 64.0, 2 * np.pi * 5 / 64).where("scan_id = 1").collect()}
    assert [low[i] for i in range(64)] == pytest.approx(list(slow), abs=1e-9)


def test_nonuniform_derivatives_over_a_distance(spark):
    x = np.array([0, 0.5, 2, 2.5, 4, 7.0])
    h = np.array([1, 3, -1, 0, 5, 2.0])
    p = spark.createDataFrame([(1, i, float(a), float(b)) for i, (a, b) in enumerate(zip(x, h))], "scan_id int, ix int, x double, h double")
    at = lambda v: np.interp(v, x, h)
    got = {r.ix: (r.x, r.d) for r in stencils.nonuniform_derivative_over(p, 1.7).collect()}
    assert got == {i: (pytest.approx(v), pytest.approx((at(v + 1.7) - at(v)) / 1.7)) for i, v in enumerate(x) if v + 1.7 <= 7}
    got = {r.ix: r.d for r in stencils.nonuniform_derivative_over(p, 1.5, order=2).collect()}
    assert got == {i: pytest.approx((at(v + 1.5) - 2 * at(v) + at(v - 1.5)) / 1.5**2) for i, v in enumerate(x) if 1.5 <= v <= 5.5}

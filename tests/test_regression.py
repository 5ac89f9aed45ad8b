"""Gaussian-process regression against the textbook formula with every sample in it."""

import numpy as np
import pytest

from rugosa.operators import regression


def textbook(x, y, at, length, noise):
    k = lambda a, b: np.exp(-((a[:, None] - b[None]) ** 2) / (2 * length**2))
    c, s = k(x, x) + noise * np.eye(len(x)), k(x, at)
    return s.T @ np.linalg.solve(c, y), 1 - np.einsum("ij,ij->j", s, np.linalg.solve(c, s))


def curves(spark, cs):
    return spark.createDataFrame([(k, float(a), None if b is None else float(b)) for k, (x, y) in cs.items() for a, b in zip(x, y)], "scan_id int, x double, y double")


def test_samples_at_one_place_count_as_their_sum(spark):
    rng = np.random.default_rng(5)
    cs = {1: (x := rng.integers(0, 8, 60) / 2, np.sin(x) + rng.normal(0, 0.1, 60)), 2: (x := rng.integers(0, 8, 60) / 2, np.cos(x)), 3: (np.array([1.0]), np.array([2.0]))}
    at = [0.3, 1.0, 2.2, 9.0]
    got = regression.gaussian_process(curves(spark, cs), "x", "y", at, length=0.7, noise=0.01).collect()
    assert len(got) == 3 * len(at)
    for k, (x, y) in cs.items():
        mean, var = textbook(x, y, np.array(at), 0.7, 0.01)
        mine = sorted((r.x, r.y, r.variance) for r in got if r.scan_id == k)
        assert [r[1] for r in mine] == pytest.approx(list(mean), abs=1e-6) and [r[2] for r in mine] == pytest.approx(list(var), abs=1e-6)


def test_bins_bound_the_system_and_power_laws_are_fitted_in_logarithms(spark):
    x = np.linspace(1, 100, 4000)
    df = curves(spark, {1: (np.append(x, [5.0, 6.0]), [*(3 * x**-2), -1.0, None])}).where("y IS NULL OR y > 0 OR x = 5")
    edges = [float(e) for e in np.geomspace(0.9, 101, 25)]
    got = {r.x: r.y for r in regression.gaussian_process(df.where("y > 0"), "x", "y", [2.0, 20.0, 80.0], edges, noise=1e-4, log=True).collect()}
    assert all(v == pytest.approx(3 * k**-2, rel=0.05) for k, v in got.items()) and len(got) == 3
    assert regression.gaussian_process(df.limit(0), "x", "y", [1.0], edges).count() == 0
    assert regression.gaussian_process(curves(spark, {1: ([1.0, float("nan")], [None, 1.0])}), "x", "y", [1.0]).count() == 0

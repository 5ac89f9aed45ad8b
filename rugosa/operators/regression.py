"""Gaussian-process regression of curves from sums: a small system a curve, however many samples it has."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import batches
from .spectral import bin_average

KEYS = ("scan_id",)


def gaussian(a: np.ndarray, b: np.ndarray, length: float, amplitude: float) -> np.ndarray:
    return amplitude * np.exp(-((a - b) ** 2) / (2 * length**2))


def posterior(x: np.ndarray, y: np.ndarray, n: np.ndarray, at: np.ndarray, length: float, amplitude: float, noise: float) -> tuple[np.ndarray, np.ndarray]:
    """Mean and variance at `at` of stacks of curves of zero prior mean: each y, the mean of n samples at x, has the variance noise / n."""
    k = gaussian(x[:, :, None], x[:, None, :], length, amplitude)
    k[:, np.arange(x.shape[1]), np.arange(x.shape[1])] += noise / n
    s = gaussian(x[:, :, None], at[None, None, :], length, amplitude)
    both = np.linalg.solve(k, np.concatenate([y[:, :, None], s], 2))
    return np.einsum("ci,cij->cj", both[:, :, 0], s), amplitude - np.einsum("cij,cij->cj", s, both[:, :, 1:])


def gaussian_process(curve: DataFrame, x: str, y: str, at: list[float], edges: list[float] | None = None, keys: tuple[str, ...] = KEYS, length: float = 1.0, amplitude: float = 1.0, noise: float = 1e-6, log: bool = False) -> DataFrame:
    """(keys, x, y, variance): each curve at the points `at`, by regression with a Gaussian kernel.

    Samples at one x count as their mean with their number: the same answer as from each alone. edges: samples of a bin
    count as one at their mean x, so the system is no larger than the bins are many; without edges it is as large
    as the distinct x, all of which meet in a task. log: of log y over log x (for power laws); variance is that of log y, and samples
    that are not positive are left out. Null and NaN samples are left out; a curve without any has no rows.
    """
    rows = curve.where(f"{x} IS NOT NULL AND {y} IS NOT NULL AND NOT isnan({x}) AND NOT isnan({y})").select(*keys, F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
    if edges is not None:
        rows = bin_average(rows, "x", "y", edges, keys).where("n > 0").select(*keys, "x", "y", "n")
    else:
        rows = rows.groupBy(*keys, "x").agg(F.avg("y").alias("y"), F.count("*").alias("n"))
    if log:
        rows = rows.where("x > 0 AND y > 0").withColumns({"x": F.log("x"), "y": F.log("y")})
    points = np.array(at, float)
    inner = np.log(points) if log else points

    def run(table: pa.Table, starts: np.ndarray):
        xs, ys, n = (table.column(c).to_numpy() for c in ("x", "y", "n"))
        sizes = np.diff(np.append(starts, len(xs)))
        for m in np.unique(sizes).tolist():
            of = np.flatnonzero(sizes == m)
            for i in range(0, len(of), most := max(1, batches.STACK // (m * (m + len(at))))):
                part = of[i : i + most]
                rows = starts[part][:, None] + np.arange(m)
                mean, var = posterior(xs[rows], ys[rows], n[rows], inner, length, amplitude, noise)
                yield np.repeat(part, len(at)), {"x": np.tile(points, len(part)), "y": (np.exp(mean) if log else mean).ravel(), "variance": var.ravel()}

    return batches.by_line(rows.withColumn("at", F.col("x")), keys, "x double, y double, variance double", run)

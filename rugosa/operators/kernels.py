"""Whole-scan kernels in NumPy, where no closed relational form is cheap: Fourier filters and interpolation."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from . import batches, fourier

KEYS = ("scan_id",)


def per_scan(points: DataFrame, func, columns: str, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """func(sorted heights) -> dict of arrays or scalars, a scan at a time."""
    return batches.by_scan(points, func, columns, keys)


def per_map(points: DataFrame, nx: int, ny: int, func, columns: str, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """func(heights nx x ny) -> dict of arrays of one shape; (keys, ix, iy, columns)."""
    return batches.by_map(points, nx, ny, func, columns, keys)


# --- Fourier ---------------------------------------------------------------------------------------


def fourier_filter(points: DataFrame, n: int, size: float, keep, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """Periodic line scans of this size times keep(q) in Fourier space; keep takes an array of wavevectors."""
    return fourier.filter_line(points, size, keep, keys)


def shortcut(points: DataFrame, n: int, size: float, wavevector: float, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """Wavevectors up to the given one stay."""
    return fourier_filter(points, n, size, lambda q: q <= wavevector, keys)


def longcut(points: DataFrame, n: int, size: float, wavevector: float, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """Wavevectors from the given one on stay."""
    return fourier_filter(points, n, size, lambda q: q >= wavevector, keys)


def filter_map(points: DataFrame, nx: int, ny: int, sx: float, sy: float, keep, isotropic: bool = True, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """Periodic maps times keep(|q|), or keep(qx, qy), in Fourier space, stacks of maps at a time."""
    qx = 2 * math.pi * np.fft.fftfreq(nx, sx / nx)[:, None]
    qy = 2 * math.pi * np.fft.rfftfreq(ny, sy / ny)[None]
    f = keep(np.hypot(qx, qy)) if isotropic else keep(qx, qy)
    return batches.by_stack(points, nx, ny, lambda h: {"h": np.fft.irfft2(np.fft.rfft2(h) * f, (nx, ny))}, "h double", keys)


def fourier_derivative(points: DataFrame, nx: int, ny: int, sx: float, sy: float, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """(keys, ix, iy, dx, dy): spectral first derivatives of periodic maps; the odd Nyquist term is left out."""
    q = [2 * np.pi * np.fft.fftfreq(n, s / n) for n, s in ((nx, sx), (ny, sy))]
    for n, v in zip((nx, ny), q, strict=True):
        if n % 2 == 0:
            v[n // 2] = 0

    def run(h: np.ndarray) -> dict[str, np.ndarray]:
        f = np.fft.fft2(h)
        return {"dx": np.fft.ifft2(1j * q[0][:, None] * f).real, "dy": np.fft.ifft2(1j * q[1][None] * f).real}

    return batches.by_stack(points, nx, ny, run, "dx double, dy double", keys, 12)


def interpolate_fourier(points: DataFrame, nx: int, ny: int, mx: int, my: int, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """Periodic maps on mx x my pixels, their spectra padded with zeros; Nyquist terms are shared by both signs."""

    def padded(f: np.ndarray, n: int, m: int, axis: int) -> np.ndarray:
        f = np.moveaxis(f, axis, 0)
        g = np.zeros((m, *f.shape[1:]), complex)
        half = n // 2
        g[: half + n % 2] = f[: half + n % 2]
        g[m - half + (1 - n % 2) :] = f[half + 1 :] if n % 2 == 0 else f[half + 1 :]
        if n % 2 == 0 and m > n:
            g[half] += f[half] / 2
            g[m - half] += f[half] / 2
        elif n % 2 == 0:
            g[half] = f[half]
        return np.moveaxis(g, 0, axis)

    return batches.by_stack(points, nx, ny, lambda h: {"h": np.fft.ifft2(padded(padded(np.fft.fft2(h), nx, mx, 1), ny, my, 2)).real * (mx * my / nx / ny)}, "h double", keys, 4 + 4 * -(-mx * my // (nx * ny)))


# --- interpolation ---------------------------------------------------------------------------------


def bilinear_triangles(h: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Heights at pixel positions x, y of a periodic map, on two triangles a pixel."""
    nx, ny = h.shape
    i, j = np.floor(x).astype(int), np.floor(y).astype(int)
    fx, fy = x - i, y - j
    g = lambda a, b: h[(i + a) % nx, (j + b) % ny]
    lower = g(0, 0) + fx * (g(1, 0) - g(0, 0)) + fy * (g(0, 1) - g(0, 0))
    upper = g(1, 1) + (1 - fx) * (g(0, 1) - g(1, 1)) + (1 - fy) * (g(1, 0) - g(1, 1))
    return np.where(fx + fy <= 1, lower, upper)


def _hermite(f0, f1, d0, d1, t):
    """Cubic with values and slopes at 0 and 1: value, first and second derivative at t."""
    a, b = 2 * f0 - 2 * f1 + d0 + d1, -3 * f0 + 3 * f1 - 2 * d0 - d1
    return a * t**3 + b * t**2 + d0 * t + f0, 3 * a * t**2 + 2 * b * t + d0, 6 * a * t + 2 * b


def spectral_slope(h: np.ndarray, axis: int) -> np.ndarray:
    """Slopes by pixel of a periodic map along an axis; the odd Nyquist term is left out."""
    n = h.shape[axis]
    q = 2 * np.pi * np.fft.rfftfreq(n)
    if n % 2 == 0:
        q[-1] = 0
    return np.fft.irfft(np.fft.rfft(h, axis=axis) * (1j * q).reshape([-1 if a == axis else 1 for a in range(h.ndim)]), n, axis)


def central_slope(h: np.ndarray, axis: int) -> np.ndarray:
    return (np.roll(h, -1, axis) - np.roll(h, 1, axis)) / 2


SLOPES = {"fd": central_slope, "fourier": spectral_slope}


def bicubic(h: np.ndarray, x: np.ndarray, y: np.ndarray, slopes: str = "fd") -> dict[str, np.ndarray]:
    """Value, slopes and second derivatives at pixel positions of a periodic map, from its slopes on the grid (SLOPES).

    A bicubic patch is a cubic along y of cubics along x of the heights and of their slopes along y.
    """
    nx, ny = h.shape
    slope = SLOPES[slopes]
    hx, hy = slope(h, 0), slope(h, 1)
    hxy = slope(hy, 0)
    i, j = np.floor(x).astype(int), np.floor(y).astype(int)
    fx, fy = x - i, y - j
    along = lambda f, d, b: _hermite(f[i % nx, (j + b) % ny], f[(i + 1) % nx, (j + b) % ny], d[i % nx, (j + b) % ny], d[(i + 1) % nx, (j + b) % ny], fx)
    f0, f1, d0, d1 = along(h, hx, 0), along(h, hx, 1), along(hy, hxy, 0), along(hy, hxy, 1)
    v = [_hermite(f0[k], f1[k], d0[k], d1[k], fy) for k in range(3)]
    return {"h": v[0][0], "dx": v[1][0], "dy": v[0][1], "dxx": v[2][0], "dxy": v[1][1], "dyy": v[0][2]}


def interpolate_map(points: DataFrame, nx: int, ny: int, factor: int, kind: str = "linear", keys: tuple[str, ...] = KEYS, slopes: str = "fd") -> DataFrame:
    """Periodic maps on a grid `factor` times finer; kind linear or bicubic (then with derivatives by pixel).

    slopes: what a bicubic patch takes as the grid's slopes, central differences ("fd") or those of the Fourier series ("fourier").
    """
    if slopes not in SLOPES:
        raise ValueError(f"slopes {slopes!r}: neither fd nor fourier")
    x, y = np.meshgrid(np.arange(nx * factor) / factor, np.arange(ny * factor) / factor, indexing="ij")
    if kind == "linear":
        return per_map(points, nx, ny, lambda h: {"h": bilinear_triangles(h, x, y)}, "h double", keys)
    return per_map(points, nx, ny, lambda h: bicubic(h, x, y, slopes), "h double, dx double, dy double, dxx double, dxy double, dyy double", keys)


def cubic_spline(x: np.ndarray, h: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Natural cubic spline, its tridiagonal system solved by elimination."""
    n, dx = len(x), np.diff(x)
    s = np.diff(h) / dx
    m = np.zeros(n)
    c, d = np.zeros(n), np.zeros(n)
    for i in range(1, n - 1):
        b = 2 * (dx[i - 1] + dx[i]) - dx[i - 1] * c[i - 1]
        c[i] = dx[i] / b
        d[i] = (6 * (s[i] - s[i - 1]) - dx[i - 1] * d[i - 1]) / b
    for i in range(n - 2, 0, -1):
        m[i] = d[i] - c[i] * m[i + 1]
    k = np.clip(np.searchsorted(x, at, side="right") - 1, 0, n - 2)
    t = at - x[k]
    return h[k] + t * (s[k] - dx[k] * (2 * m[k] + m[k + 1]) / 6) + t**2 * m[k] / 2 + t**3 * (m[k + 1] - m[k]) / (6 * dx[k])


def spline_curvatures(x: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Second derivatives at the points of the cubic spline through them that is one cubic over the first two pieces and one over the last two; NaN for fewer than four points."""
    n = len(x)
    if n < 4:
        return np.full(n, np.nan)
    d = np.diff(x)
    right = 6 * np.diff(np.diff(h) / d)
    low, mid, up = d[:-1].copy(), 2 * (d[:-1] + d[1:]), d[1:].copy()
    # The outer curvatures continue the straight lines through the two next to them.
    mid[0] += d[0] * (d[0] + d[1]) / d[1]
    up[0] -= d[0] * d[0] / d[1]
    mid[-1] += d[-1] * (d[-1] + d[-2]) / d[-2]
    low[-1] -= d[-1] * d[-1] / d[-2]
    for i in range(1, n - 2):
        w = low[i] / mid[i - 1]
        mid[i] -= w * up[i - 1]
        right[i] -= w * right[i - 1]
    m = np.zeros(n)
    for i in range(n - 3, -1, -1):
        m[i + 1] = (right[i] - up[i] * m[i + 2] * (i < n - 3)) / mid[i]
    m[0] = m[1] + (m[1] - m[2]) * d[0] / d[1]
    m[-1] = m[-2] + (m[-2] - m[-3]) * d[-1] / d[-2]
    return m


# --- generation ------------------------------------------------------------------------------------


def self_affine_map(nx: int, ny: int, sx: float, sy: float, hurst: float, rms_height: float, short: float | None, long: float | None, seed: int) -> np.ndarray:
    """A random surface with a self-affine spectrum between the cutoff wavelengths, scaled to the rms height."""
    rng = np.random.default_rng(seed)
    q = np.hypot(2 * np.pi * np.fft.fftfreq(nx, sx / nx)[:, None], 2 * np.pi * np.fft.rfftfreq(ny, sy / ny)[None])
    with np.errstate(divide="ignore"):
        a = q ** (-1.0 - hurst)
    a[0, 0] = 0
    if long:
        ql = 2 * np.pi / long
        a = np.where((q < ql) & (q > 0), ql ** (-1.0 - hurst), a)
    if short:
        a[q > 2 * np.pi / short] = 0
    h = np.fft.irfft2(a * (rng.normal(size=a.shape) + 1j * rng.normal(size=a.shape)), (nx, ny))
    h -= h.mean()
    s = h.std()
    return h * (rms_height / s) if s > 0 else h


def spectrum_map(nx: int, ny: int, sx: float, sy: float, psd, amplitude, seed: int) -> np.ndarray:
    """A random surface whose spectrum is psd(|q|) times the squares of random amplitudes; phases are even.

    psd: of an array of wavevectors (its value at zero is that of the mean height, which may be infinite or undefined
    and is zero then); amplitude(rng, shape), or None for exactly this spectrum. Wavevectors that are their own mirror
    have a sign instead of a phase, and each other one has the conjugate of its mirror's, so the heights are real.
    """
    rng = np.random.default_rng(seed)
    q = np.hypot(2 * np.pi * np.fft.fftfreq(nx, sx / nx)[:, None], 2 * np.pi * np.fft.rfftfreq(ny, sy / ny)[None])
    with np.errstate(divide="ignore", invalid="ignore"):
        c = np.asarray(psd(q), float)
    c[0, 0] = c[0, 0] if np.isfinite(c[0, 0]) else 0.0
    if not (np.isfinite(c).all() and (c >= 0).all()):
        raise ValueError("psd: negative or not finite at a wavevector other than zero")
    f = np.exp(2j * np.pi * rng.random(q.shape)) * (1.0 if amplitude is None else amplitude(rng, q.shape))
    mirror = -np.arange(nx) % nx
    for col in {0, ny // 2} if ny % 2 == 0 else {0}:
        v = f[:, col]
        own = mirror == np.arange(nx)
        v = np.where(np.arange(nx) > mirror, np.conj(v[mirror]), v)
        f[:, col] = np.where(own, np.abs(v) * np.where(v.real < 0, -1, 1), v)
    return np.fft.irfft2(f * np.sqrt(c) * (nx * ny / math.sqrt(sx * sy)), (nx, ny))


def fourier_synthesis(surfaces: DataFrame, nx: int, ny: int, sx: float, sy: float, hurst: float | None = None, short: float | None = None, long: float | None = None, psd=None, amplitude=None) -> DataFrame:
    """(scan_id, ix, iy, h): one random surface for each row of surfaces, made on the executors.

    Self-affine ones take a seed and an rms_height from the row. Instead of hurst and the cutoffs, psd(q, row) may give the
    isotropic spectrum at an array of wavevectors, from the row's columns (a dict, with the seed); amplitude(rng, shape) then
    gives the random amplitudes that are laid over it: standard normal by default, those of `exact` are one. A surface is
    made by one task.
    """
    if (psd is None) == (hurst is None):
        raise ValueError("either hurst or psd")
    amplitude = amplitude or (lambda rng, shape: rng.normal(size=shape))

    def run(batches):
        i, j = np.meshgrid(np.arange(nx, dtype=np.int32), np.arange(ny, dtype=np.int32), indexing="ij")
        for b in batches:
            for row in b.to_dict("records"):
                seed = int(row["seed"])
                if psd is None:
                    h = self_affine_map(nx, ny, sx, sy, hurst, float(row["rms_height"]), short, long, seed)
                else:
                    h = spectrum_map(nx, ny, sx, sy, lambda q, row=row: psd(q, row), amplitude, seed)
                yield pd.DataFrame({"scan_id": seed, "ix": i.ravel(), "iy": j.ravel(), "h": h.ravel()})

    # Pixels are many for a row, so rows are dealt out even if they are few.
    return surfaces.repartition(surfaces.sparkSession.sparkContext.defaultParallelism, "seed").mapInPandas(run, "scan_id long, ix int, iy int, h double")


def exact(rng, shape):
    """Amplitudes of one: each surface has the given spectrum itself."""
    return 1.0


def reliability_cutoff_sphere(h: np.ndarray, pixel: float, radius: float, safety: float = 0.5) -> float | None:
    """Smallest distance at which the most negative curvature stays above -safety / radius; null if it does at all distances."""
    worst = []
    for s in range(1, (len(h) - 1) // 2 + 1):
        d = (h[2 * s :] - 2 * h[s:-s] + h[: -2 * s]) / (s * pixel) ** 2
        worst.append(-d.min() - safety / radius)
    over = [i for i, v in enumerate(worst) if v > 0]
    if not over:
        return None
    i = over[-1]
    if i + 1 >= len(worst):
        return 2 * (i + 1) * pixel
    t = worst[i] / (worst[i] - worst[i + 1])
    return 2 * (i + 1 + t) * pixel


def scanning_probe_cutoff(points: DataFrame, pixel: float, radius: float, safety: float = 0.5, keys: tuple[str, ...] = KEYS) -> DataFrame:
    return per_scan(points, lambda h: {"cutoff": np.array([reliability_cutoff_sphere(h, pixel, radius, safety)], float)}, "cutoff double", keys).selectExpr(*keys, "nanvl(cutoff, cast(null as double)) as cutoff")

"""Transforms of whole scans and maps: many small surfaces in one stack, and maps larger than a task in blocks.

A large map is transformed row by row, cut into blocks of columns, dealt out by block (a transposition in blocks, one
shuffle) and transformed column by column. A block holds at most STACK numbers, so a task's memory doesn't grow
with the map; a row and a column must fit. Correlations are differences of products of padded transforms, with
the number of overlapping defined points at each lag, so undefined heights may be left out.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import batches

KEYS = ("scan_id",)
#: Pixels up to which a map is transformed whole, in a stack with others.
WHOLE = 1 << 18
#: Columns of a block at most.
WIDTH = 128


def fast_length(n: int) -> int:
    """The next length from n on with no prime factor over 5."""
    while True:
        m = n
        for p in (2, 3, 5):
            while m % p == 0:
                m //= p
        if m == 1:
            return n
        n += 1


def _fields(h: np.ndarray, strict: bool) -> np.ndarray:
    """Marks of defined heights, heights and their squares, zero where undefined."""
    mask = np.isfinite(h)
    if strict and not mask.all():
        raise ValueError("UndefinedData: this analysis needs every height")
    z = np.where(mask, h, 0.0)
    return np.stack([mask.astype(float), z, z * z])


def _differences(m: np.ndarray, z: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Spectra of the sums of squared differences, and of the numbers of pairs, at each lag."""
    return 2 * (m.conj() * q).real - 2 * (z.real**2 + z.imag**2), m.real**2 + m.imag**2


def _centred(h: np.ndarray, axes: tuple[int, ...]) -> np.ndarray:
    """Less the mean of the defined heights: differences don't change, rounding errors do."""
    mask = np.isfinite(h)
    n = np.maximum(mask.sum(axes, keepdims=True), 1)
    return h - np.where(mask, h, 0.0).sum(axes, keepdims=True) / n


# --- line scans ------------------------------------------------------------------------------------


def correlation_line(points: DataFrame, keys: tuple[str, ...] = KEYS, periodic: bool = False, strict: bool = True) -> DataFrame:
    """(keys, k, s, n): at each lag of k points the sum s of squared height differences and the number n of pairs with both heights defined.

    Scans of one length are transformed as one stack. strict: an undefined height is an error.
    """

    def run(table: pa.Table, starts: np.ndarray):
        h = table.column("h").to_numpy()
        sizes = np.diff(np.append(starts, len(h)))
        for n in np.unique(sizes).tolist():
            long = n if periodic else fast_length(2 * n - 1)
            of = np.flatnonzero(sizes == n)
            for i in range(0, len(of), most := max(1, batches.STACK // (4 * long))):
                part = of[i : i + most]
                stack = _centred(h[starts[part][:, None] + np.arange(n)], (1,))
                s, c = _differences(*np.fft.rfft(_fields(stack, strict), long, axis=2))
                s, c = (np.fft.irfft(x, long, axis=1)[:, :n] for x in (s, c))
                s[:, 0] = 0
                yield np.repeat(part, n), {"k": np.tile(np.arange(n, dtype=np.int32), len(part)), "s": np.maximum(s, 0).ravel(), "n": np.rint(c).astype(np.int64).ravel()}

    return batches.by_group(points, keys, [F.col("ix"), F.col("h").cast("double").alias("h")], "k int, s double, n long", run)


def power_line(points: DataFrame, keys: tuple[str, ...] = KEYS, tapered: bool = True, strict: bool = True) -> DataFrame:
    """(keys, k, n, power): squared moduli of the transforms of line scans of any lengths n, wavevectors k below n / 2; tapered by Hann's window, normalised."""

    def run(table: pa.Table, starts: np.ndarray):
        h = table.column("h").to_numpy()
        sizes = np.diff(np.append(starts, len(h)))
        for n in np.unique(sizes).tolist():
            w = (0.5 - 0.5 * np.cos(2 * np.pi * np.arange(n) / n)) * np.sqrt(8 / 3) if tapered else 1.0
            of, m = np.flatnonzero(sizes == n), max(1, n // 2)
            for i in range(0, len(of), most := max(1, batches.STACK // (2 * n))):
                part = of[i : i + most]
                f = np.fft.rfft(_fields(h[starts[part][:, None] + np.arange(n)], strict)[1] * w, axis=1)[:, :m]
                yield np.repeat(part, m), {"k": np.tile(np.arange(m, dtype=np.int32), len(part)), "n": np.full(f.size, n, np.int32), "power": (f.real**2 + f.imag**2).ravel()}

    return batches.by_group(points, keys, [F.col("ix"), F.col("h").cast("double").alias("h")], "k int, n int, power double", run)


def filter_line(points: DataFrame, size: float | None, keep: Callable[[np.ndarray], np.ndarray], keys: tuple[str, ...] = KEYS, order: int = 0) -> DataFrame:
    """(keys, ix, h): periodic line scans times keep(q) at each wavevector q, and differentiated `order` times; undefined heights are an error.

    An odd derivative has no amplitude at Nyquist's wavevector. size None: the points are one apart, whatever a scan's length.
    """

    def run(table: pa.Table, starts: np.ndarray):
        h, ix = table.column("h").to_numpy(), table.column("ix").to_numpy()
        sizes = np.diff(np.append(starts, len(h)))
        for n in np.unique(sizes).tolist():
            q = 2 * np.pi * np.fft.rfftfreq(n, size / n if size else 1.0)
            factor = keep(q) * (1j * q) ** order
            if order % 2 and n % 2 == 0:
                factor[-1] = 0
            of = np.flatnonzero(sizes == n)
            for i in range(0, len(of), most := max(1, batches.STACK // (2 * n))):
                rows = (starts[of[i : i + most]][:, None] + np.arange(n)).ravel()
                out = np.fft.irfft(np.fft.rfft(_fields(h[rows].reshape(-1, n), True)[1], axis=1) * factor, n, axis=1)
                yield np.repeat(of[i : i + most], n), {"ix": ix[rows].astype(np.int32), "h": out.ravel()}

    return batches.by_group(points, keys, [F.col("ix"), F.col("h").cast("double").alias("h")], "ix int, h double", run)


# --- maps ------------------------------------------------------------------------------------------


def _row_blocks(points: DataFrame, ny: int, py: int, width: int, fields: Callable[[np.ndarray], np.ndarray], keys: tuple[str, ...]) -> DataFrame:
    """(keys, block, ix, data): rows' transforms of py points, cut into blocks of `width` wavevectors; data: complex numbers, a field after the other."""
    kinds = "".join(f"{c} {t}, " for c, t in points.select(*keys).dtypes)
    rows = points.groupBy(*keys, F.col("ix").cast("int").alias("ix")).agg(F.collect_list(F.struct(F.col("iy").cast("int").alias("iy"), F.coalesce(F.col("h").cast("double"), F.lit(float("nan"))).alias("h"))).alias("p"))

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in parts:
            for i in range(0, whole.num_rows, most := max(1, batches.STACK // (8 * py))):
                b = whole.slice(i, most)
                p = b.column("p")
                grid = np.full((b.num_rows, ny), np.nan)
                values, size = p.flatten(), np.diff(p.offsets.to_numpy())
                grid[np.repeat(np.arange(b.num_rows), size), values.field("iy").to_numpy()] = values.field("h").to_numpy()
                spec = np.fft.rfft(fields(grid), py, axis=2)
                for j in range(0, spec.shape[2], width):
                    data = np.ascontiguousarray(spec[:, :, j : j + width].transpose(1, 0, 2))
                    yield pa.RecordBatch.from_arrays([*(b.column(k) for k in keys), pa.array(np.full(b.num_rows, j // width, np.int32)), b.column("ix"), pa.array([x.tobytes() for x in data], pa.binary())], names=[*keys, "block", "ix", "data"])

    return rows.mapInArrow(run, f"{kinds}block int, ix int, data binary")


def _columns(blocks: DataFrame, nx: int, px: int, n_fields: int, keys: tuple[str, ...], columns: str, strict: bool, run: Callable[[int, np.ndarray], dict[str, np.ndarray]]) -> DataFrame:
    """run(block, transforms n_fields x px x columns) -> dict of arrays, for each block of columns."""
    kinds = "".join(f"{c} {t}, " for c, t in blocks.select(*keys).dtypes)
    names = [c.split(" ")[0] for c in columns.split(", ")]

    def apply(table: pa.Table) -> pa.Table:
        ix = table.column("ix").to_numpy()
        if strict and len(ix) < nx:
            raise ValueError("UndefinedData: this analysis needs every height")
        data = [np.frombuffer(x.as_buffer(), np.complex128).reshape(n_fields, -1) for x in table.column("data").combine_chunks()]
        grid = np.zeros((n_fields, px, data[0].shape[1]), np.complex128)
        grid[:, ix] = np.stack(data, 1)
        out = run(table.column("block")[0].as_py(), np.fft.fft(grid, axis=1))
        n = len(out[names[0]])
        return pa.table([*(pa.repeat(table.column(k)[0], n) for k in keys), *(pa.array(out[c]) for c in names)], names=[*keys, *names])

    return blocks.groupBy(*keys, "block").applyInArrow(apply, f"{kinds}{columns}")


def _width(px: int, n_fields: int, columns: int, width: int | None) -> int:
    return width or max(1, min(WIDTH, columns, batches.STACK // (2 * px * n_fields)))


def power_area(points: DataFrame, nx: int, ny: int, keys: tuple[str, ...] = KEYS, whole: int = WHOLE, width: int | None = None) -> DataFrame:
    """(keys, kx, ky, power): squared moduli of a map's transform at all its wavevectors. An undefined height is an error."""

    def fields(h: np.ndarray) -> np.ndarray:
        return _fields(h, True)[1:2]

    if nx * ny <= whole:
        out = batches.by_stack(points, nx, ny, lambda h: {"power": np.abs(np.fft.fft2(fields(h)[0])) ** 2}, "power double", keys)
        return out.withColumnsRenamed({"ix": "kx", "iy": "ky"})
    width = _width(nx, 1, ny // 2 + 1, width)

    def run(block: int, spec: np.ndarray) -> dict[str, np.ndarray]:
        p = np.abs(spec[0]) ** 2
        kx, ky = (a.ravel() for a in np.indices(p.shape, np.int32))
        ky = ky + np.int32(block * width)
        far = (ky > 0) & (2 * ky < ny)  # their mirror images are not in the half that was transformed
        return {"kx": np.concatenate([kx, (-kx[far]) % nx]), "ky": np.concatenate([ky, ny - ky[far]]), "power": np.concatenate([p.ravel(), p.ravel()[far]])}

    return _columns(_row_blocks(points, ny, ny, width, fields, keys), nx, nx, 1, keys, "kx int, ky int, power double", True, run)


def correlation_area(points: DataFrame, nx: int, ny: int, keys: tuple[str, ...] = KEYS, periodic: bool = False, strict: bool = True, whole: int = WHOLE, width: int | None = None) -> DataFrame:
    """(keys, a, b, s, n): at each lag (a, b), 0 <= a < nx and 0 <= b < ny, the sum of squared height differences and the number of pairs with both heights defined."""
    px, py = (nx, ny) if periodic else (fast_length(2 * nx - 1), fast_length(2 * ny - 1))

    def ready(s: np.ndarray, n: np.ndarray) -> dict[str, np.ndarray]:
        return {"s": np.maximum(s, 0), "n": np.rint(n).astype(np.int64)}

    if nx * ny <= whole:

        def stacked(h: np.ndarray) -> dict[str, np.ndarray]:
            spectra = _differences(*np.fft.rfft2(_fields(_centred(h, (1, 2)), strict), (px, py)))
            s, n = (np.fft.irfft2(x, (px, py))[:, :nx, :ny] for x in spectra)
            s[:, 0, 0] = 0
            return ready(s, n)

        return batches.by_stack(points, nx, ny, stacked, "s double, n long", keys, 12).withColumnsRenamed({"ix": "a", "iy": "b"})
    mean = points.where(~F.isnan("h")).groupBy(*keys).agg(F.avg("h").alias("_mean"))  # a row a map
    points = (points.join(mean, list(keys), "left") if keys else points.crossJoin(F.broadcast(mean))).withColumn("h", F.col("h") - F.col("_mean"))
    half = py // 2 + 1
    width = _width(px, 3, half, width)

    def run(block: int, spec: np.ndarray) -> dict[str, np.ndarray]:
        both = np.stack([np.fft.ifft(x, axis=0)[:nx] for x in _differences(*spec)], 1)  # nx x 2 x columns
        return {"ix": np.arange(nx, dtype=np.int32), "block": np.full(nx, block, np.int32), "data": np.array([x.tobytes() for x in both], object)}

    lags = _columns(_row_blocks(points, ny, py, width, lambda h: _fields(h, strict), keys), nx, px, 3, keys, "ix int, block int, data binary", strict, run)
    kinds = "".join(f"{c} {t}, " for c, t in lags.select(*keys).dtypes)
    n_blocks = -(-half // width)

    def rows(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for b in parts:
            t = pa.Table.from_batches([*held, b]).combine_chunks()
            cut = t.num_rows // n_blocks * n_blocks
            held = t.slice(cut).to_batches()
            data = t.column("data")
            for i in range(0, cut, n_blocks):
                spec = np.concatenate([np.frombuffer(data[j].as_buffer(), np.complex128).reshape(2, -1) for j in range(i, i + n_blocks)], 1)
                s, n = np.fft.irfft(spec, py, axis=1)[:, :ny]
                a = t.column("ix")[i].as_py()
                if a == 0:
                    s[0] = 0
                out = ready(s, n)
                yield pa.RecordBatch.from_arrays([*(pa.repeat(t.column(k)[i], ny) for k in keys), pa.array(np.full(ny, a, np.int32)), pa.array(np.arange(ny, dtype=np.int32)), pa.array(out["s"]), pa.array(out["n"])], names=[*keys, "a", "b", "s", "n"])

    return lags.repartition(*keys, "ix").sortWithinPartitions(*keys, "ix", "block").mapInArrow(rows, f"{kinds}a int, b int, s double, n long")

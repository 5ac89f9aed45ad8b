"""Whole scans and maps in Arrow batches: many small ones at a time, a large one alone."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Pixels of maps that are held as one stack; a larger map is a stack of its own.
STACK = 1 << 22


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Rows of whole groups, and where each begins; a group that a batch cuts waits for the next one."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        first = np.flatnonzero(batch.column("_row").to_numpy() == 1)
        cut = int(first[-1]) if len(first) else batch.num_rows
        held.append(batch.slice(0, cut))
        if len(first):
            yield from _table(held)
            held = [batch.slice(cut)]
    yield from _table(held)


def _table(held: list[pa.RecordBatch]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    if sum(b.num_rows for b in held):
        table = pa.Table.from_batches(held).combine_chunks()
        yield table, np.flatnonzero(table.column("_row").to_numpy() == 1)


def by_group(points: DataFrame, keys: tuple[str, ...], values: list, columns: str, run: Callable) -> DataFrame:
    """(keys, columns): run(table, starts) gives the group of each result row and its columns; groups come whole, rows by ix."""
    return by_line(points.select(*keys, *values), keys, columns, run, "ix")


def by_line(rows: DataFrame, keys: tuple[str, ...], columns: str, run: Callable, order: str = "at") -> DataFrame:
    """The same for rows that are ready, in the order of one of their columns.

    A window brings a group's rows together, so a partitioning by keys that is there already is used, and sorting spills.
    """
    kinds = "".join(f"{c} {t}, " for c, t in rows.select(*keys).dtypes)
    rows = rows.withColumn("_row", F.row_number().over(Window.partitionBy(*keys).orderBy(order)))
    names = [c.split(" ")[0] for c in columns.split(", ")]

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, starts in _whole(batches):
            for group, out in run(table, starts):
                own = [table.column(k).take(pa.array(starts[group])).combine_chunks() for k in keys]
                yield from pa.table([*own, *[pa.array(out[c]) for c in names]], names=[*keys, *names]).to_batches(max_chunksize=1 << 16)

    return rows.mapInArrow(apply, f"{kinds}{columns}")


def by_scan(points: DataFrame, func: Callable, columns: str, keys: tuple[str, ...]) -> DataFrame:
    """func(heights by ix) -> dict of arrays of one length, or of scalars; (keys, columns)."""

    def run(table: pa.Table, starts: np.ndarray):
        h = table.column("h").to_numpy()
        outs = [{k: np.atleast_1d(v) for k, v in func(x).items()} for x in np.split(h, starts[1:])]
        sizes = [len(next(iter(o.values()))) for o in outs]
        yield np.repeat(np.arange(len(outs)), sizes), {k: np.concatenate([o[k] for o in outs]) for k in outs[0]}

    return by_group(points, keys, [F.col("ix"), F.col("h").cast("double").alias("h")], columns, run)


def stacks(table: pa.Table, starts: np.ndarray, nx: int, ny: int, fill, each: int = 1):
    """(groups before, rows, map of each row, ix, iy, stack of maps) for as many maps as STACK allows."""
    value, ix, iy = (table.column(c).to_numpy() for c in ("v", "ix", "iy"))
    ends = np.append(starts[1:], table.num_rows)
    most = max(1, STACK // (nx * ny * each))
    for g in range(0, len(starts), most):
        last = min(g + most, len(starts))
        rows = slice(starts[g], ends[last - 1])
        at = np.repeat(np.arange(last - g), (ends - starts)[g:last])
        stack = np.full((last - g, nx, ny), fill)
        stack[at, ix[rows], iy[rows]] = value[rows]
        yield g, at, ix[rows], iy[rows], stack


def by_map(points: DataFrame, nx: int, ny: int, func: Callable, columns: str, keys: tuple[str, ...]) -> DataFrame:
    """func(heights nx x ny) -> dict of maps of one shape, any; (keys, ix, iy, columns)."""

    def run(table: pa.Table, starts: np.ndarray):
        for g, _, _, _, stack in stacks(table, starts, nx, ny, np.nan):
            for i, h in enumerate(stack):
                out = func(h)
                x, y = (a.ravel() for a in np.indices(next(iter(out.values())).shape, np.int32))
                yield np.full(len(x), g + i), {"ix": x, "iy": y} | {k: v.ravel() for k, v in out.items()}

    return by_group(points, keys, pixels("cast(h as double)"), f"ix int, iy int, {columns}", run)


def by_stack(points: DataFrame, nx: int, ny: int, func: Callable, columns: str, keys: tuple[str, ...], each: int = 4) -> DataFrame:
    """func(stack of heights n x nx x ny, NaN where undefined) -> dict of stacks of one shape; (keys, ix, iy, columns). each: numbers held for a pixel."""

    def run(table: pa.Table, starts: np.ndarray):
        for g, _, _, _, stack in stacks(table, starts, nx, ny, np.nan, each):
            out = func(stack)
            n, ix, iy = (a.ravel() for a in np.indices(next(iter(out.values())).shape, np.int32))
            yield g + n, {"ix": ix, "iy": iy} | {k: v.ravel() for k, v in out.items()}

    return by_group(points, keys, pixels("cast(h as double)"), f"ix int, iy int, {columns}", run)


def by_mask(points: DataFrame, nx: int, ny: int, func: Callable, columns: str, keys: tuple[str, ...]) -> DataFrame:
    """func(stack of masks n x nx x ny) -> dict of stacks; (keys, ix, iy, columns) of the pixels given. A null mask is unmarked."""

    def run(table: pa.Table, starts: np.ndarray):
        for g, at, x, y, stack in stacks(table, starts, nx, ny, False):
            yield g + at, {"ix": x, "iy": y} | {k: v[at, x, y] for k, v in func(stack).items()}

    return by_group(points, keys, pixels("coalesce(mask, false)"), f"ix int, iy int, {columns}", run)


def pixels(value: str) -> list:
    return [F.expr("cast(ix as int)").alias("ix"), F.expr("cast(iy as int)").alias("iy"), F.expr(value).alias("v")]

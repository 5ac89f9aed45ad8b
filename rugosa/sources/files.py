"""Measurement files as DataFrames: a catalogue of channels, and points; and the way back."""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import units
from . import formats, instruments
from .errors import MetadataAlreadyFixedByFile, UnknownChannel

CHANNELS = "path string, format string, channel_index int, channel_id string, name string, kind string, nb_grid_pts array<int>, physical_sizes array<double>, unit string, periodic boolean, undefined boolean, error string"
POINTS = "path string, channel_index int, ix int, iy int, x double, h double"


def binary_files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("path", "content")


def channel_ids(names: list[str]) -> list[str]:
    """Names, told apart by #2, #3, ... where they repeat."""
    seen: dict[str, int] = {}
    out = []
    for n in names:
        seen[n] = seen.get(n, 0) + 1
        out.append(n if seen[n] == 1 else f"{n}#{seen[n]}")
    return out


def channels(spark: SparkSession, path: str, format: str | None = None) -> DataFrame:
    """A row a channel; a file that no reader takes is a row with its error."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for p, c in zip(b["path"], b["content"], strict=True):
                try:
                    name, got = formats.decode(c, format)
                except Exception as e:  # noqa: BLE001
                    rows.append((p, None, None, None, None, None, None, None, None, None, None, f"{type(e).__name__}: {e}"))
                    continue
                ids = channel_ids([x.name for x in got])
                for i, x in enumerate(got):
                    rows.append((p, name, i, ids[i], x.name, x.kind, list(x.heights.shape), None if x.size is None else list(map(float, x.size)), x.unit, x.periodic, bool(np.isnan(x.heights).any()), None))
            yield pd.DataFrame(rows, columns=[k.split(" ")[0] for k in CHANNELS.split(", ")])

    return binary_files(spark, path).mapInPandas(run, CHANNELS)


def points(spark: SparkSession, path: str, format: str | None = None, channel_index: int | None = None, channel_id: str | None = None, physical_sizes: tuple[float, ...] | None = None, unit: str | None = None) -> DataFrame:
    """The points of one channel (the first, if none is named) of each file; x where positions or sizes are known.

    Sizes and units may be given where the file has none.
    """
    if channel_index is not None and channel_id is not None:
        raise ValueError("either channel_index or channel_id")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for p, c in zip(b["path"], b["content"], strict=True):
                _, got = formats.decode(c, format)
                ids = channel_ids([x.name for x in got])
                k = ids.index(channel_id) if channel_id in ids else -1 if channel_id is not None else channel_index or 0
                if not 0 <= k < len(got):
                    raise UnknownChannel(f"{p}: there are {ids}")
                x = got[k]
                if physical_sizes is not None and x.size is not None:
                    raise MetadataAlreadyFixedByFile(f"{p}: the file has sizes")
                if unit is not None and x.unit is not None:
                    raise MetadataAlreadyFixedByFile(f"{p}: the file has a unit")
                size = x.size or physical_sizes
                h = x.heights if x.heights.ndim == 2 else x.heights[:, None]
                i, j = np.meshgrid(np.arange(h.shape[0], dtype=np.int32), np.arange(h.shape[1], dtype=np.int32), indexing="ij")
                at = x.x if x.x is not None else i.ravel() * size[0] / h.shape[0] if size else np.full(h.size, np.nan)
                yield pd.DataFrame({"path": p, "channel_index": np.int32(k), "ix": i.ravel(), "iy": j.ravel(), "x": at, "h": h.ravel()})

    out = binary_files(spark, path).mapInPandas(run, POINTS)
    return out.withColumns({c: F.nanvl(c, F.lit(None).cast("double")) for c in ("x", "h")})


# --- sinks -----------------------------------------------------------------------------------------


def to_matrix(points: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, iy, value): maps as text, a row in y a line; write with .write.text() after dropping iy."""
    cells = F.transform(F.array_sort(F.collect_list(F.struct("ix", F.coalesce(F.col("h").cast("string"), F.lit("nan")).alias("t")))), lambda c: c["t"])
    return points.groupBy(*keys, "iy").agg(F.concat_ws(" ", cells).alias("value"))


def to_files(points: DataFrame, kind: str, nx: int, ny: int | None, size: tuple[float, ...] | None = None, unit: str | None = None, keys: tuple[str, ...] = ("scan_id",)) -> DataFrame:
    """(keys, content): each measurement as the bytes of a file: nc, npy, x3p or gwy. Nonuniform scans (ny None, with x): nc."""
    kinds = ", ".join(f"{c} {t}" for c, t in points.select(*keys).dtypes)
    uneven = ny is None and "x" in points.columns and size is None

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("ix")
        if ny is None:
            h = pdf["h"].to_numpy(float)
        else:
            h = np.full((nx, ny), np.nan)
            h[pdf["ix"], pdf["iy"]] = pdf["h"]
        c = formats.Channel("Default", h, size, unit, pdf["x"].to_numpy(float) if uneven else None)
        if kind == "npy":
            out = io.BytesIO()
            np.save(out, h)
            content = out.getvalue()
        else:
            content = {"nc": formats.write_netcdf3, "x3p": formats.write_x3p, "gwy": instruments.write_gwy}[kind](c)
        return pd.DataFrame({k: [pdf[k].iloc[0]] for k in keys} | {"content": [content]})

    return points.groupBy(*keys).applyInPandas(run, f"{kinds}, content binary")


def pyramid(points: DataFrame, nx: int, ny: int, tile: int = 256, keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, level, col, row, ix, iy, h): an image pyramid; level top is the whole map, each lower one every second pixel of the next.

    Write with .write.partitionBy('level', 'col', 'row').
    """
    top = max(nx - 1, ny - 1, 1).bit_length()
    p = points.withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(top))))
    step = F.pow(F.lit(2), F.lit(top) - F.col("level")).cast("int")
    p = p.withColumn("_step", step).where("ix % _step = 0 AND iy % _step = 0")
    p = p.withColumns({"ix": F.expr("cast(ix div _step as int)"), "iy": F.expr("cast(iy div _step as int)")})
    return p.select(*keys, "level", F.expr(f"cast(ix div {tile} as int)").alias("col"), F.expr(f"cast(iy div {tile} as int)").alias("row"), "ix", "iy", "h")


def height_channels(catalogue: DataFrame) -> DataFrame:
    """The channels that hold heights (a length unit, or none), with height_index: their number among those of their file."""
    w = Window.partitionBy("path").orderBy("channel_index")
    lengths = F.col("unit").isNull() | units.factor_column(F.col("unit"), "m").isNotNull()
    return catalogue.where(F.col("channel_index").isNotNull() & lengths).withColumn("height_index", F.row_number().over(w) - 1)


def height_index_to_channel_id(catalogue: DataFrame, height_index: int) -> DataFrame:
    """(path, channel_id) of that height channel of each file that has it."""
    return height_channels(catalogue).where(F.col("height_index") == height_index).select("path", "channel_id")


def channel_id_to_height_index(catalogue: DataFrame, channel_id: str) -> DataFrame:
    """(path, height_index) of that channel of each file where it holds heights."""
    return height_channels(catalogue).where(F.col("channel_id") == channel_id).select("path", "height_index")

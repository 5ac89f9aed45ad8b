"""Decoders of measurement files: bytes to channels, pure functions that run on the executors."""

from __future__ import annotations

import io
import re
import struct
import zipfile
import xml.etree.ElementTree as ET
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np

from ..functions.units import LENGTHS, canonical, conversion_factor, find_length_unit
from .errors import CannotDetectFileFormat, CorruptFile

#: Bytes that a format is told by.
MAGIC_BYTES = 512


@dataclass
class Channel:
    """One measured channel. heights: (nx, ny) for maps, (nx,) for line scans, NaN where undefined; x: positions of nonuniform scans."""

    name: str
    heights: np.ndarray
    size: tuple[float, ...] | None = None
    unit: str | None = None
    x: np.ndarray | None = None
    periodic: bool = False
    info: dict = field(default_factory=dict)

    @property
    def kind(self) -> str:
        return "map" if self.heights.ndim == 2 else "nonuniform" if self.x is not None else "uniform"


@dataclass
class Format:
    name: str
    extensions: tuple[str, ...]
    starts: tuple[bytes, ...]
    decode: Callable[[bytes], list[Channel]]


FORMATS: dict[str, Format] = {}


def reader(name: str, *extensions: str, starts: tuple[bytes, ...] = ()):
    """Registers a decoder; the order of registration is that of trial."""

    def add(f: Callable[[bytes], list[Channel]]):
        FORMATS[name] = Format(name, extensions, starts, f)
        return f

    return add


def candidates(head: bytes) -> list[Format]:
    """Formats whose first bytes are these, or that have no telling first bytes."""
    sure = [f for f in FORMATS.values() if f.starts and head.startswith(f.starts)]
    return sure or [f for f in FORMATS.values() if not f.starts]


def decode(content: bytes, format: str | None = None) -> tuple[str, list[Channel]]:
    if format is not None:
        return format, FORMATS[format].decode(content)
    for f in candidates(content[:MAGIC_BYTES]):
        try:
            got = f.decode(content)
        except Exception:  # noqa: BLE001  a file of another format can fail in any way
            continue
        if got:
            return f.name, got
    raise CannotDetectFileFormat("no reader takes this content")


def detect_format(content: bytes) -> str:
    return decode(content)[0]


# --- binary ----------------------------------------------------------------------------------------


@reader("npy", "npy", starts=(b"\x93NUMPY",))
def npy(content: bytes) -> list[Channel]:
    a = np.load(io.BytesIO(content), allow_pickle=False)
    if a.ndim not in (1, 2):
        raise CorruptFile("an array of one or two dimensions is needed")
    return [Channel("Default", np.where(np.isfinite(a), a, np.nan).astype(float))]


@reader("nc", "nc", starts=(b"CDF\x01", b"CDF\x02"))
def netcdf3(content: bytes) -> list[Channel]:
    """Classic NetCDF with heights and perhaps x, y, mask."""
    dims, attrs, variables = read_netcdf3(content)
    h = np.array(variables["heights"][0], float)
    if "mask" in variables:
        h[np.asarray(variables["mask"][0]).astype(bool)] = np.nan
    unit = variables["heights"][1].get("unit") or attrs.get("unit")
    x = variables.get("x")
    periodic = bool(x[1].get("periodic", 0)) if x else False
    if h.ndim == 2:
        size = tuple(float(np.ravel(variables[k][1]["length"])[0]) for k in ("x", "y")) if "length" in (x[1] if x else {}) else None
        return [Channel("Default", h, size, unit, None, periodic)]
    if x is not None and "n" in dims:
        return [Channel("Default", h, None, unit, np.array(x[0], float))]
    return [Channel("Default", h, (float(np.ravel(x[1]["length"])[0]),) if x and "length" in x[1] else None, unit, None, periodic)]


_NC_TYPES = {1: "b", 2: "S1", 3: ">i2", 4: ">i4", 5: ">f4", 6: ">f8"}


def read_netcdf3(content: bytes) -> tuple[dict, dict, dict]:
    """Dimensions, attributes and variables (values, attributes) of a classic NetCDF file without records."""
    wide = content[3] == 2
    at = 8

    def u4() -> int:
        nonlocal at
        at += 4
        return struct.unpack(">I", content[at - 4 : at])[0]

    def name() -> str:
        nonlocal at
        n = u4()
        s = content[at : at + n].decode()
        at += -(-n // 4) * 4
        return s

    def attributes() -> dict:
        nonlocal at
        tag, n, out = u4(), u4(), {}
        for _ in range(n if tag else 0):
            key, kind, count = name(), u4(), u4()
            size = np.dtype(_NC_TYPES[kind]).itemsize * count
            raw = content[at : at + size]
            at += -(-size // 4) * 4
            out[key] = raw.decode() if kind == 2 else np.frombuffer(raw, _NC_TYPES[kind]).astype(float) if kind > 4 else np.frombuffer(raw, _NC_TYPES[kind]).astype(int)
        return {k: v if isinstance(v, str) or len(v) != 1 else v[0].item() for k, v in out.items()}

    tag, n = u4(), u4()
    dims = [(name(), u4()) for _ in range(n if tag else 0)]
    attrs = attributes()
    tag, n = u4(), u4()
    variables = {}
    for _ in range(n if tag else 0):
        key = name()
        shape = [dims[u4()][1] for _ in range(u4())]
        own, kind, _size = attributes(), u4(), u4()
        begin = u4() << 32 | u4() if wide else u4()
        count = int(np.prod(shape, dtype=int))
        variables[key] = np.frombuffer(content, _NC_TYPES[kind], count, begin).reshape(shape), own
    return dict(dims), attrs, variables


def write_netcdf3(channel: Channel) -> bytes:
    """A channel as classic NetCDF that read_netcdf3() takes."""
    h = channel.heights
    arrays: list[tuple[str, list[int], np.ndarray, dict]] = []
    unit = {"unit": channel.unit} if channel.unit else {}
    if channel.kind == "nonuniform":
        dims = [("n", len(h))]
        arrays = [("x", [0], channel.x.astype(">f8"), unit), ("heights", [0], h.astype(">f8"), unit)]
    else:
        dims = [(k, n) for k, n in zip("xy", h.shape, strict=False)]
        for i, (k, n) in enumerate(dims):
            size = channel.size[i] if channel.size else float(n)
            arrays.append((k, [i], (np.arange(n) * size / n).astype(">f8"), {"length": float(size), "periodic": int(channel.periodic)} | unit))
        arrays.append(("heights", list(range(h.ndim)), h.astype(">f8"), unit))
        if np.isnan(h).any():
            arrays.append(("mask", list(range(h.ndim)), np.isnan(h).astype("b"), {}))
    pad = lambda b: b + b"\0" * (-len(b) % 4)
    text = lambda s: struct.pack(">I", len(s.encode())) + pad(s.encode())

    def attributes(a: dict) -> bytes:
        if not a:
            return struct.pack(">II", 0, 0)
        out = struct.pack(">II", 12, len(a))
        for k, v in a.items():
            kind, raw, n = (2, v.encode(), len(v.encode())) if isinstance(v, str) else (4, struct.pack(">i", v), 1) if isinstance(v, int) else (6, struct.pack(">d", v), 1)
            out += text(k) + struct.pack(">II", kind, n) + pad(raw)
        return out

    def header(begins: list[int]) -> bytes:
        out = b"CDF\x02" + struct.pack(">I", 0) + struct.pack(">II", 10, len(dims)) + b"".join(text(k) + struct.pack(">I", n) for k, n in dims) + attributes({}) + struct.pack(">II", 11, len(arrays))
        for (k, d, a, at), begin in zip(arrays, begins, strict=True):
            size = -(-a.nbytes // 4) * 4
            out += text(k) + struct.pack(f">I{len(d)}I", len(d), *d) + attributes(at) + struct.pack(">IIQ", 1 if a.dtype.kind in "bi" and a.itemsize == 1 else 6, size, begin)
        return out

    begin, begins = len(header([0] * len(arrays))), []
    for _, _, a, _ in arrays:
        begins.append(begin)
        begin += -(-a.nbytes // 4) * 4
    return header(begins) + b"".join(pad(a.tobytes()) for _, _, a, _ in arrays)


@reader("x3p", "x3p", starts=(b"PK\x03\x04",))
def x3p(content: bytes) -> list[Channel]:
    """ISO 25178-72: a zip file with main.xml and binary data; lengths in metres."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        root = ET.fromstring(z.read("main.xml"))
        text = lambda path: next((e.text for e in root.iterfind(path)), None)
        nx, ny = int(text("Record3/MatrixDimension/SizeX")), int(text("Record3/MatrixDimension/SizeY"))
        kind = {"I": "<i2", "L": "<i4", "F": "<f4", "D": "<f8"}[text("Record1/Axes/CZ/DataType") or "D"]
        link = text("Record3/DataLink/PointDataLink")
        raw = np.frombuffer(z.read(link), kind, nx * ny).reshape(ny, nx).T.astype(float)
        scale = float(text("Record1/Axes/CZ/Increment") or 1)
        mask = text("Record3/DataLink/ValidPointsLink")
        if mask:
            valid = np.unpackbits(np.frombuffer(z.read(mask), np.uint8), bitorder="little")[: nx * ny].reshape(ny, nx).T
            raw = np.where(valid, raw, np.nan)
    size = (float(text("Record1/Axes/CX/Increment")) * nx, float(text("Record1/Axes/CY/Increment")) * ny)
    return [Channel("Default", raw * scale, size, "m")]


def write_x3p(channel: Channel) -> bytes:
    nx, ny = channel.heights.shape
    f = conversion_factor(channel.unit, "m") if channel.unit else 1.0
    sx, sy = channel.size or (nx, ny)
    axis = lambda k, i, t: f"<{k}><AxisType>I</AxisType><DataType>{t}</DataType><Increment>{i!r}</Increment><Offset>0</Offset></{k}>"
    h = channel.heights.T * f
    hole = np.isnan(h)
    link = "<PointDataLink>bindata/data.bin</PointDataLink>" + ("<ValidPointsLink>bindata/valid.bin</ValidPointsLink>" if hole.any() else "")
    xml = f'<?xml version="1.0" encoding="UTF-8"?><p:ISO5436_2 xmlns:p="http://www.opengps.eu/2008/ISO5436_2"><Record1><Revision>ISO5436 - 2000</Revision><FeatureType>SUR</FeatureType><Axes>{axis("CX", sx * f / nx, "D")}{axis("CY", sy * f / ny, "D")}{axis("CZ", 1.0, "D")}</Axes></Record1><Record3><MatrixDimension><SizeX>{nx}</SizeX><SizeY>{ny}</SizeY><SizeZ>1</SizeZ></MatrixDimension><DataLink>{link}</DataLink></Record3></p:ISO5436_2>'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("main.xml", xml)
        z.writestr("bindata/data.bin", np.where(hole, 0, h).astype("<f8").tobytes())
        if hole.any():
            z.writestr("bindata/valid.bin", np.packbits(~hole.ravel(), bitorder="little").tobytes())
    return out.getvalue()


# --- text ------------------------------------------------------------------------------------------


def _text(content: bytes) -> str:
    if b"\0" in content[:MAGIC_BYTES]:
        raise CorruptFile("not a text file")
    try:
        return content.decode("utf-8-sig")
    except UnicodeDecodeError:
        return content.decode("latin1")


_UNDEFINED = {"bad", "nan", "inf", "infinite", "-nan", "-inf", "---"}


def _number(word: str) -> float:
    if word.lower() in _UNDEFINED:
        return float("nan")
    v = float(word)
    return v if np.isfinite(v) else float("nan")


def _rows(lines: list[str]) -> tuple[list[str], np.ndarray]:
    """Header lines, then rows of as many numbers each."""
    head, rows = [], []
    for line in lines:
        words = [w for w in re.split(r"[\s,;]+", line.strip()) if w]
        if not words:
            continue
        try:
            rows.append([_number(w) for w in words])
        except ValueError:
            if rows:
                raise CorruptFile(f"text among numbers: {line[:40]!r}") from None
            head.append(line)
    # Leading rows of another length (a count, for instance) belong to the header.
    while len(rows) > 1 and len(rows[0]) != len(rows[-1]):
        head.append(" ".join(map(str, rows.pop(0))))
    if not rows or len({len(r) for r in rows}) != 1:
        raise CorruptFile("rows of different lengths")
    return head, np.array(rows)


@reader("sdf", "sdf", starts=(b"aBCR", b"bBCR", b"aISO", b"bISO"))
def sdf(content: bytes) -> list[Channel]:
    """ISO 25178-71, text or binary; lengths in metres."""
    if content[:1] == b"b":
        f = struct.unpack_from("<8s10s12s12sHHddddBBB", content)
        nx, ny, dx, dy, dz, kind = f[4], f[5], f[6], f[7], f[8], f[11]
        dtype = {1: "<i1", 2: "<i2", 3: "<i4", 5: "<i2", 6: "<i4", 7: "<f8", 0: "<u1"}[kind]
        h = np.frombuffer(content, dtype, nx * ny, struct.calcsize("<8s10s12s12sHHddddBBB")).astype(float)
        low = np.iinfo(dtype).min if np.dtype(dtype).kind == "i" else None
        h = np.where(h == low, np.nan, h) if low is not None else h
    else:
        parts = _text(content).split("*")
        meta = dict(m.groups() for line in parts[0].splitlines() if (m := re.match(r"\s*(\w+)\s*=\s*(\S.*?)\s*$", line)))
        nx, ny = int(meta["NumPoints"]), int(meta["NumProfiles"])
        dx, dy, dz = (float(meta[k]) for k in ("Xscale", "Yscale", "Zscale"))
        h = np.array([_number(w) for w in parts[1].split()])
    if len(h) != nx * ny:
        raise CorruptFile(f"{len(h)} heights; {nx * ny} are announced")
    return [Channel("Default", h.reshape(ny, nx).T * dz, (nx * dx, ny * dy), "m")]


@reader("xyz", "xyz", "hfm", "csv")
def xyz(content: bytes) -> list[Channel]:
    """Two columns: a line scan, uniform if its steps are equal to 1e-6; three: a map on a full regular grid in any order."""
    head, rows = _rows(_text(content).splitlines())
    unit = next((u for line in head if (u := find_length_unit(line.replace(";", " ").replace(",", " ").replace("_", " ")))), None)
    if any("valid" in line for line in head) and rows.shape[1] == 3:  # x; y; valid
        rows = np.where((rows[:, 2:] > 0) | (np.arange(3) == 0), rows, np.nan)[:, :2]
    if rows.shape[1] == 2:
        x, h = rows.T
        dx = np.diff(x)
        if len(x) < 2 or np.isnan(x).any():
            raise CorruptFile("too few positions")
        if np.abs(dx - dx.mean()).max() < 1e-6 * max(1.0, abs(dx.mean())):
            return [Channel("Default", h, (float(dx.mean() * len(x)),), unit)]
        if np.isnan(h).any():
            raise CorruptFile("undefined heights in a nonuniform scan")
        return [Channel("Default", h, None, unit, x - x[0])]
    if rows.shape[1] != 3:
        raise CorruptFile("two or three columns are needed")
    x, y, h = rows.T
    ux, uy = np.unique(x), np.unique(y)
    if len(ux) * len(uy) != len(h) or len(ux) < 2 or len(uy) < 2:
        raise CorruptFile("not a full grid")
    steps = np.diff(ux), np.diff(uy)
    if any(np.ptp(s) > 1e-3 * s.mean() for s in steps):
        raise CorruptFile("not a regular grid")
    out = np.full((len(ux), len(uy)), np.nan)
    out[np.searchsorted(ux, x), np.searchsorted(uy, y)] = h
    return [Channel("Default", out, (float(steps[0].mean() * len(ux)), float(steps[1].mean() * len(uy))), unit)]


_SIZE = re.compile(r"^[#\s]*(width|breite|height|höhe|hoehe|x-?size|y-?size)\s*[:=]\s*([-+0-9.eE,]+)\s*(\S+)?", re.I)
_VALUE = re.compile(r"^[#\s]*(?:value units?|werte?einheiten?|z-?unit)\s*[:=]\s*(\S+)", re.I)
_CHANNEL = re.compile(r"^[#\s]*(?:channel|kanal)\s*[:=]\s*(.+?)\s*$", re.I)


@reader("asc", "txt", "asc", "dat")
def asc(content: bytes) -> list[Channel]:
    """A matrix of numbers, a line of the file a row in y; sizes, units and name from header lines. One column: a line scan."""
    head, rows = _rows(_text(content).splitlines())
    size: dict[str, tuple[float, str | None]] = {}
    unit, name = None, "Default"
    for line in head:
        if m := _SIZE.match(line):
            size["x" if m[1].lower()[0] in "wbx" else "y"] = float(m[2].replace(",", ".")), m[3]
        elif m := _VALUE.match(line):
            unit = canonical(m[1])
        elif m := _CHANNEL.match(line):
            name = m[1]
    h = rows.T if rows.shape[1] > 1 else rows[:, 0]
    units = {u for _, u in size.values() if u and canonical(u) in LENGTHS}
    lateral = canonical(units.pop()) if units else unit
    if unit and lateral and unit in LENGTHS and unit != lateral:
        h = h * conversion_factor(unit, lateral)
    physical = tuple(size[k][0] for k in "xy"[: h.ndim]) if all(k in size for k in "xy"[: h.ndim]) else None
    return [Channel(name, h, physical, lateral)]


@reader("hgt", "hgt")
def hgt(content: bytes) -> list[Channel]:
    """Square of big-endian 16-bit heights; -32768 is undefined."""
    n = int(round((len(content) / 2) ** 0.5))
    if n < 2 or 2 * n * n != len(content):
        raise CorruptFile("not a square")
    a = np.frombuffer(content, ">i2").reshape(n, n).T.astype(float)
    return [Channel("Default", np.where(a == -32768, np.nan, a))]

"""Decoders of binary instrument files, registered with the others when this module is imported."""

from __future__ import annotations

import struct

import numpy as np

from ..functions.units import canonical, conversion_factor, is_length_unit
from .errors import CorruptFile
from .formats import Channel, reader


class Cursor:
    """Packed little-endian fields of a buffer, one after another."""

    def __init__(self, content: bytes, at: int = 0):
        self.content, self.at = content, at

    def take(self, layout: str) -> tuple:
        out = struct.unpack_from("<" + layout, self.content, self.at)
        self.at += struct.calcsize("<" + layout)
        return out

    def array(self, dtype: str, count: int) -> np.ndarray:
        if self.at + count * np.dtype(dtype).itemsize > len(self.content):
            raise CorruptFile("the data end early")
        out = np.frombuffer(self.content, dtype, count, self.at)
        self.at += out.nbytes
        return out

    def text(self, size: int) -> str:
        return self.take(f"{size}s")[0].split(b"\0", 1)[0].decode("latin1").strip()


def _grid(nx: int, ny: int) -> None:
    if not (0 < nx < 1 << 20 and 0 < ny < 1 << 20):
        raise CorruptFile(f"a grid of {nx} x {ny}")


@reader("tmd", "tmd", starts=(b"Binary TrueMap Data File v2.0",))
def tmd(content: bytes) -> list[Channel]:
    c = Cursor(content, 32)
    c.text(24)
    nx, ny, sx, sy, _, _ = c.take("IIffff")
    _grid(nx, ny)
    return [Channel("Default", c.array("<f4", nx * ny).reshape(ny, nx).T.astype(float), (sx, sy), "µm")]


@reader("zmg", "zmg", starts=(b"Zeta-Instruments",))
def zmg(content: bytes) -> list[Channel]:
    nx, ny, _, dx, dy, dz, _, comment, _ = Cursor(content, 16 + 69).take("II4sfff8sI84s")
    _grid(nx, ny)
    c = Cursor(content, 16 + 69 + struct.calcsize("<II4sfff8sI84s") + comment)
    return [Channel("Default", c.array("<i2", nx * ny).reshape(ny, nx).T * float(dz), (nx * dx, ny * dy), "µm")]


@reader("al3d", "al3d", starts=(b"AliconaImaging\0\r\n",))
def al3d(content: bytes) -> list[Channel]:
    """Tags of 52 bytes, then an image whose rows are padded to eight bytes; a value marks invalid pixels."""
    c = Cursor(content, 17)
    tags = {}
    left = 2
    while left:
        key, value, end = c.text(20), c.text(30), c.take("2s")[0]
        if end != b"\r\n":
            raise CorruptFile("a tag without its line end")
        tags[key] = value
        left += int(value) - 1 if key == "TagCount" else -1
    nx, ny, bad = int(tags["Cols"]), int(tags["Rows"]), float(tags["InvalidPixelValue"])
    _grid(nx, ny)
    row = -(-nx * 4 // 8) * 2
    h = Cursor(content, int(tags["DepthImageOffset"])).array("<f4", row * ny).reshape(ny, row)[:, :nx].T.astype(float)
    if np.isfinite(bad):
        h = np.where(np.abs(h - bad) <= 1.5e-7 * abs(bad), np.nan, h)
    return [Channel("Default", h, (nx * float(tags["PixelSizeXMeter"]), ny * float(tags["PixelSizeYMeter"])), "m")]


@reader("bcr", "bcr", "bcrf", starts=(b"fileformat = bcr", "fileformat = bcr".encode("utf-16-le"), b"\xff\xfef\0i\0l\0e\0f\0o\0r\0m\0a\0t\0"))
def bcr(content: bytes) -> list[Channel]:
    """Lines of key = value up to headersize characters, then 16-bit integers (bcrstm) or floats (bcrf)."""
    wide = content[:2] == b"\xff\xfe" or content[1:2] == b"\0"
    code, step = ("utf-16-le", 2) if wide else ("latin1", 1)

    def pairs(raw: bytes) -> dict[str, str]:
        lines = raw.decode(code, "replace").lstrip("﻿").splitlines()
        return {k.strip(): v.strip() for line in lines if line[:1] not in "%#" for k, eq, v in [line.partition("=")] if eq}

    size = int(pairs(content[:2048])["headersize"]) * step
    tags = pairs(content[:size])
    nx, ny = int(tags["xpixels"]), int(tags["ypixels"])
    _grid(nx, ny)
    if tags["xunit"] != tags["yunit"] or not is_length_unit(tags["zunit"]):
        raise CorruptFile("units of other kinds than lengths")
    dtype = ("<" if int(tags["intelmode"]) else ">") + ("f4" if tags["fileformat"].startswith("bcrf") else "i2")
    h = Cursor(content, size).array(dtype, nx * ny).reshape(ny, nx).T.astype(float)
    h = np.where(h == float(tags.get("voidpixels", "nan")), np.nan, h)
    return [Channel("Default", h * float(tags["bit2nm"]) * conversion_factor(tags["zunit"], tags["xunit"]), (float(tags["xlength"]), float(tags["ylength"])), tags["xunit"])]


@reader("opd", "opd", starts=(b"\x01\0Directory",))
def opd(content: bytes) -> list[Channel]:
    """A directory of named blocks; heights in units of wavelength / mult, lengths in millimetres."""
    def block(c: Cursor) -> tuple[str, int]:
        return c.text(16), c.take("hiH")[1]

    c = Cursor(content, 2)
    name, size = block(c)
    if name != "Directory" or size % 24:
        raise CorruptFile("no directory")
    blocks = [block(c) for _ in range(size // 24 - 1)]
    value, raw = {"Mult": 1.0, "Aspect": 1.0, "Pixel_size": 1.0}, []
    for name, size in blocks:
        if size <= 0:
            continue
        end = c.at + size
        if name in ("RAW DATA", "RAW_DATA", "OPD", "Raw"):
            nx, ny, item = c.take("HHH")
            _grid(nx, ny)
            dtype, bad = {1: ("<u1", None), 2: ("<i2", 32766), 4: ("<f4", 1e38)}[item]
            h = c.array(dtype, nx * ny).reshape(nx, ny).astype(float)
            raw.append((name, np.where(h >= bad, np.nan, h)[:, ::-1] if bad else h[:, ::-1]))
        elif name in ("Wavelength", "Aspect", "Pixel_size"):
            value[name] = c.take("f")[0]
        elif name == "Mult":
            value[name] = c.take("H")[0]
        c.at = end
    scale = value["Wavelength"] / value["Mult"] * 1e-6
    return [Channel(n, h * scale, (h.shape[0] * value["Pixel_size"], h.shape[1] * value["Pixel_size"] * value["Aspect"]), "mm") for n, h in raw]


@reader("sur", "sur", starts=(b"DIGITAL SURF",))
def sur(content: bytes) -> list[Channel]:
    """A fixed head of 512 bytes, two texts, then 16- or 32-bit integers times a height step."""
    c = Cursor(content, 98)
    bits, _, _, nx, ny, n, dx, dy, dz = c.take("HiiiiIfff")
    _grid(nx, ny)
    if n != nx * ny or bits not in (16, 32):
        raise CorruptFile("numbers of points that disagree")
    c.at += 3 * 16  # names of the axes
    ux, uy, uz = (c.text(16) for _ in range(3))
    (comment, private) = Cursor(content, 334).take("HH")
    h = Cursor(content, 512 + comment + private).array(f"<i{bits // 8}", n).reshape(ny, nx).T.astype(float)
    return [Channel("Default", h * dz, (nx * dx * conversion_factor(ux, uz), ny * dy * conversion_factor(uy, uz)), uz)]


@reader("wsxm", "cur", "stp", "tom", "top", starts=(b"WSxM file copyright",))
def wsxm(content: bytes) -> list[Channel]:
    """Sections of key: value lines up to [Header end], then the image; the range of values spans the z amplitude."""
    head, found, _ = content.partition(b"[Header end]")
    if not found:
        raise CorruptFile("no end of the header")
    tags = {k.strip(): v.strip() for line in head.decode("latin1").splitlines() for k, colon, v in [line.partition(":")] if colon}
    nx, ny = int(tags["Number of columns"]), int(tags["Number of rows"])
    _grid(nx, ny)
    dtype = {"short": "<i2", "integer": "<i2", "float": "<f4", "double": "<f8"}[tags["Image Data Type"]]
    h = Cursor(content, content.index(b"\n", len(head)) + 1).array(dtype, nx * ny).reshape(ny, nx).T.astype(float)
    (sx, ux), (sy, uy), (sz, uz) = (tags[k].split()[:2] for k in ("X Amplitude", "Y Amplitude", "Z Amplitude"))
    unit = canonical(uz)
    scale = float(sz) / (float(tags["Maximum"]) - float(tags["Minimum"]))
    return [Channel("Default", h * scale, (float(sx) * conversion_factor(ux, unit), float(sy) * conversion_factor(uy, unit)), unit)]


# --- Gwyddion objects ------------------------------------------------------------------------------

_ATOMS = {b"b": "?", b"c": "B", b"i": "i", b"q": "q", b"d": "d"}


def _objects(content: bytes) -> dict:
    """A serialised object as nested dictionaries: components by name, '' the type."""
    c = Cursor(content)

    def word() -> str:
        end = content.index(b"\0", c.at)
        out = content[c.at : end].decode()
        c.at = end + 1
        return out

    def item(kind: bytes):
        if kind == b"s":
            return word()
        if kind == b"o":
            out = {"": word()}
            (size,) = c.take("I")
            end = c.at + size
            while c.at < end:
                name = word()
                out[name] = item(c.take("c")[0])
            return out
        if kind in _ATOMS:
            return c.take(_ATOMS[kind])[0]
        (n,) = c.take("I")
        if kind in (b"S", b"O"):
            return [item(kind.lower()) for _ in range(n)]
        return c.array({b"C": "u1", b"I": "<i4", b"Q": "<i8", b"D": "<f8"}[kind], n)

    return item(b"o")


@reader("gwy", "gwy", starts=(b"GWYP",))
def gwy(content: bytes) -> list[Channel]:
    """Data fields /N/data with their titles and masks (over one half: undefined)."""
    root, out = _objects(content[4:]), []
    for n in sorted(int(k.split("/")[1]) for k in root if k.startswith("/") and k.endswith("/data") and k.count("/") == 2):
        f = root[f"/{n}/data"]
        nx, ny = f["xres"], f["yres"]
        h = f["data"].reshape(ny, nx).T.astype(float)
        mask = root.get(f"/{n}/mask")
        if mask is not None:
            h = np.where(mask["data"].reshape(ny, nx).T > 0.5, np.nan, h)
        unit = f.get("si_unit_xy", {}).get("unitstr") or None
        if f.get("si_unit_z", {}).get("unitstr", unit) not in (unit, None, ""):
            continue  # not heights
        out.append(Channel(root.get(f"/{n}/data/title", "Default"), h, (f["xreal"], f["yreal"]), unit))
    if not out:
        raise CorruptFile("no height channel")
    return out


def write_gwy(channel: Channel) -> bytes:
    """A map as a Gwyddion file, undefined pixels as a mask; lengths in metres."""
    f = conversion_factor(channel.unit, "m") if channel.unit else 1.0
    nx, ny = channel.heights.shape
    sx, sy = channel.size or (nx, ny)
    word = lambda s: s.encode() + b"\0"

    def packed(kind: str, parts: bytes) -> bytes:
        return word(kind) + struct.pack("<I", len(parts)) + parts

    def data_field(values: np.ndarray, z: str) -> bytes:
        unit = lambda n, u: word(n) + b"o" + packed("GwySIUnit", word("unitstr") + b"s" + word(u))
        parts = b"".join(word(k) + struct.pack("<ci", b"i", v) for k, v in (("xres", nx), ("yres", ny)))
        parts += b"".join(word(k) + struct.pack("<cd", b"d", v) for k, v in (("xreal", sx * f), ("yreal", sy * f)))
        parts += unit("si_unit_xy", "m") + unit("si_unit_z", z) + word("data") + struct.pack("<cI", b"D", nx * ny) + values.T.astype("<f8").tobytes()
        return b"o" + packed("GwyDataField", parts)

    hole = np.isnan(channel.heights)
    parts = word("/0/data") + data_field(np.where(hole, 0, channel.heights) * f, "m") + word("/0/data/title") + b"s" + word(channel.name)
    if hole.any():
        parts += word("/0/mask") + data_field(hole.astype(float), "")
    return b"GWYP" + packed("GwyContainer", parts)

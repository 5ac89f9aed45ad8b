import struct

import numpy as np
import pytest

from rugosa.sources import errors, formats, instruments

GRID = np.arange(12.0).reshape(4, 3)
ROWS = GRID.T


def only(content, name):
    got, channels = formats.decode(content)
    assert got == name
    return channels[0]


def test_tmd():
    c = only(b"Binary TrueMap Data File v2.0\r\n\0" + b"a comment".ljust(24, b"\0") + struct.pack("<IIffff", 4, 3, 8.0, 6.0, 0, 0) + ROWS.astype("<f4").tobytes(), "tmd")
    assert np.array_equal(c.heights, GRID) and c.size == (8, 6) and c.unit == "µm"
    with pytest.raises(errors.CorruptFile):
        instruments.tmd(b"x" * 56 + struct.pack("<IIffff", 4, 3, 8.0, 6.0, 0, 0) + b"short")


def test_zmg():
    c = only(b"Zeta-Instruments" + b"\0" * 69 + struct.pack("<II4sfff8sI84s", 4, 3, b"", 0.5, 2.0, 0.25, b"", 5, b"") + b"hello" + ROWS.astype("<i2").tobytes(), "zmg")
    assert np.array_equal(c.heights, GRID / 4) and c.size == (2, 6)


def test_al3d():
    tag = lambda k, v: k.encode().ljust(20, b"\0") + v.encode().ljust(30, b"\0") + b"\r\n"
    tags = [("Cols", "3"), ("Rows", "4"), ("DepthImageOffset", "600"), ("InvalidPixelValue", "5"), ("PixelSizeXMeter", "1e-6"), ("PixelSizeYMeter", "2e-6")]
    head = b"AliconaImaging\0\r\n" + tag("Version", "1") + tag("TagCount", str(len(tags))) + b"".join(tag(*t) for t in tags)
    image = np.zeros((4, 4), "<f4")
    image[:, :3] = GRID
    c = only(head.ljust(600, b"\0") + image.tobytes(), "al3d")
    assert np.isnan(c.heights[2, 1]) and c.heights[1, 3] == 10 and np.allclose(c.size, (3e-6, 8e-6))


@pytest.mark.parametrize("wide", [False, True])
@pytest.mark.parametrize("kind,dtype", [("bcrstm", ">i2"), ("bcrf", "<f4")])
def test_bcr(wide, kind, dtype):
    head = f"fileformat = {kind}\nheadersize = 2048\nxpixels = 4\nypixels = 3\nxlength = 40\nylength = 30\nxunit = nm\nyunit = nm\nzunit = nm\nbit2nm = 0.5\nintelmode = {int(dtype[0] == '<')}\nvoidpixels = 7\n%"
    raw = head.ljust(2048).encode("utf-16-le" if wide else "latin1") + ROWS.astype(dtype).tobytes()
    c = only(raw, "bcr")
    assert np.isnan(c.heights[2, 1]) and c.heights[3, 2] == 5.5 and c.size == (40, 30) and c.unit == "nm"


def test_opd():
    block = lambda n, size: n.encode().ljust(16, b"\0") + struct.pack("<hiH", 0, size, 0)
    data = GRID.astype("<f4").copy()
    data[0, 0] = 2e38
    parts = [("RAW DATA", struct.pack("<HHH", 4, 3, 4) + data.tobytes()), ("Wavelength", struct.pack("<f", 500.0)), ("Mult", struct.pack("<H", 2)), ("Pixel_size", struct.pack("<f", 0.5)), ("Other", b"abc")]
    raw = b"\x01\0" + block("Directory", 24 * (len(parts) + 1)) + b"".join(block(n, len(b)) for n, b in parts) + b"".join(b for _, b in parts)
    c = only(raw, "opd")
    assert np.isnan(c.heights[0, 2]) and np.isclose(c.heights[3, 0], 11 * 250e-6) and c.size == (2, 1.5) and c.unit == "mm"


@pytest.mark.parametrize("hole", [False, True])
def test_gwy(hole):
    h = GRID.copy()
    if hole:
        h[1, 1] = np.nan
    c = only(instruments.write_gwy(formats.Channel("Height", h, (4.0, 3.0), "µm")), "gwy")
    assert c.name == "Height" and np.allclose(c.heights, h * 1e-6, equal_nan=True) and np.allclose(c.size, (4e-6, 3e-6)) and c.unit == "m"


def test_sur():
    text = lambda s: s.encode("latin1").ljust(16, b"\0")
    raw = struct.pack("<12sHHHH30s30sHHHHHII", b"DIGITAL SURF", 0, 1, 1, 2, b"", b"", 0, 0, 0, 0, 0, 0, 0)
    raw += struct.pack("<HiiiiIfff", 16, 0, 11, 4, 3, 12, 2.0, 3.0, 0.5) + b"".join(map(text, ["X", "Y", "Z", "mm", "mm", "µm", "mm", "mm", "µm"]))
    raw += struct.pack("<fff", 1, 1, 1) + struct.pack("<HHHIII7HfIIH", *[0] * 13, 0.0, 0, 0, 0) + struct.pack("<HH", 3, 2) + b"\0" * 128 + struct.pack("<fff", 0, 0, 0) + b"\0" * 34
    assert len(raw) == 512
    c = only(raw + b"abcde" + ROWS.astype("<i2").tobytes(), "sur")
    assert np.array_equal(c.heights, GRID / 2) and np.allclose(c.size, (8000, 9000)) and c.unit == "µm"


def test_wsxm():
    head = "WSxM file copyright\r\nSxM Image file\r\nImage header size: 1\r\n[Control]\r\nX Amplitude: 4 nm\r\nY Amplitude: 3 nm\r\n[General Info]\r\nNumber of columns: 4\r\nNumber of rows: 3\r\nImage Data Type: double\r\nZ Amplitude: 22 nm\r\n[Miscellaneous]\r\nMaximum: 11\r\nMinimum: 0\r\n[Header end]\r\n"
    c = only(head.encode() + ROWS.astype("<f8").tobytes(), "wsxm")
    assert np.array_equal(c.heights, 2 * GRID) and c.size == (4, 3) and c.unit == "nm"

"""The algebra of CRC-32: checksums of byte slices and of their concatenations, by tables over GF(2)."""

from __future__ import annotations

import zlib

import numpy as np

#: Bytes of a chunk whose checksum is read from tables by place; longer slices are composed from such chunks.
CHUNK = 64
POLYNOMIAL = 0xEDB88320  # fixed value, reflected


def _byte_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = (t >> np.uint32(1)) ^ np.where(t & 1, np.uint32(POLYNOMIAL), np.uint32(0))
    return t


BYTE = _byte_table()


def _by_place() -> np.ndarray:
    """[k, b]: what byte b adds to a checksum if k more bytes follow."""
    out = np.empty((CHUNK, 256), np.uint32)
    out[0] = BYTE
    for k in range(1, CHUNK):
        out[k] = (out[k - 1] >> np.uint32(8)) ^ BYTE[out[k - 1] & 255]
    return out


PLACE = _by_place().ravel()
#: Checksums of zero bytes: what a slice's length alone adds.
ZEROS = np.array([zlib.crc32(bytes(n)) for n in range(CHUNK + 1)], np.uint32)


def times(tables: np.ndarray, x: np.ndarray) -> np.ndarray:
    """A 32 x 32 matrix over GF(2), given as four tables by byte, times vectors of 32 bits."""
    return tables[0][x & 255] ^ tables[1][(x >> np.uint32(8)) & 255] ^ tables[2][(x >> np.uint32(16)) & 255] ^ tables[3][x >> np.uint32(24)]


def _shifts(most: int = 40) -> list[np.ndarray]:
    """Matrices that carry a checksum over 1, 2, 4, ... zero bytes: each is the square of the one before."""
    v = np.arange(256, dtype=np.uint32)
    one = np.stack([x for k in range(4) for x in [(v << np.uint32(8 * k)) >> np.uint32(8)]])
    one[0] ^= BYTE
    out = [one]
    for _ in range(most - 1):
        out.append(times(out[-1], out[-1]))
    return out


SHIFTS = _shifts()


def shifted(crc: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Each checksum's share in that of the text prolonged by n bytes: the matrix of n, by its binary digits."""
    crc = np.array(crc, np.uint32)
    for k in range(int(n.max()).bit_length() if len(n) else 0):
        on = np.flatnonzero((n >> k) & 1)
        crc[on] = times(SHIFTS[k], crc[on])
    return crc


def joined(a: np.ndarray, b: np.ndarray, length_b: np.ndarray) -> np.ndarray:
    """The checksum of a's text followed by b's, from the checksums alone."""
    return shifted(a, length_b) ^ b


def _of_chunks(buf: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Checksums of slices of at most CHUNK bytes, none empty: a sum over GF(2) of their bytes' shares."""
    ends = np.cumsum(lengths)
    first = ends - lengths
    at = np.arange(int(ends[-1])) - np.repeat(first, lengths)
    share = PLACE[(np.repeat(lengths, lengths) - 1 - at) * 256 + buf[at + np.repeat(starts, lengths)]]
    return np.bitwise_xor.reduceat(share, first) ^ ZEROS[lengths]


def of_slices(buf: np.ndarray, starts: np.ndarray, lengths: np.ndarray, block: int = 1 << 17) -> np.ndarray:
    """CRC-32 of each slice (none of them empty), `block` slices at a time."""
    out = np.empty(len(starts), np.uint32)
    for i in range(0, len(starts), block):
        s, n = starts[i : i + block], lengths[i : i + block]
        crc, done = _of_chunks(buf, s, np.minimum(n, CHUNK)), CHUNK
        while len(on := np.flatnonzero(n > done)):
            more = np.minimum(n[on] - done, CHUNK)
            crc[on] = joined(crc[on], _of_chunks(buf, s[on] + done, more), more)
            done += CHUNK
        out[i : i + block] = crc
    return out


def of_runs(crc: np.ndarray, lengths: np.ndarray, texts: np.ndarray, least: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(checksums, texts) of all runs of `least` to `most` consecutive words of one text, joined by single spaces.

    Composed from the words' checksums: no run is ever written out.
    """
    spaced = joined(np.full(len(crc), zlib.crc32(b" "), np.uint32), crc, lengths)
    found, of, run = [], [], crc
    for k in range(1, most + 1):
        if k > 1:
            run = joined(run[:-1], spaced[k - 1 :], lengths[k - 1 :] + 1) if len(run) else run
        if k >= least and len(run):
            whole = texts[: len(run)] == texts[k - 1 :]
            found.append(run[whole])
            of.append(texts[: len(run)][whole])
    return (np.concatenate(found), np.concatenate(of)) if found else (np.empty(0, np.uint32), np.empty(0, np.int64))

"""Words as byte slices: a lookup table over the UTF-8 buffer of a batch finds their boundaries, no strings are made."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

# The primes of XXH64.
P1, P2, P3, P4, P5 = (np.uint64(p) for p in (11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261))
LONG = 32  # XXH64 has another form from this length on


def table(*spans: tuple[int, int]) -> np.ndarray:
    """256 booleans: which bytes belong to a word. Bytes from 0x80 on, parts of longer characters, are given like any other."""
    out = np.zeros(256, bool)
    for a, b in spans:
        out[a : b + 1] = True
    return out


#: Anything but the six ASCII white-space characters; letters; letters and digits. Characters beyond ASCII belong to words.
NO_SPACE = ~table((9, 13), (32, 32))
LETTERS = table((65, 90), (97, 122), (128, 255))
ALNUM = table((48, 57), (65, 90), (97, 122), (128, 255))
_FOLD = np.arange(256, dtype=np.uint8) + np.uint8(32) * table((65, 90))


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a text column one after another, and the offsets of its rows in them; null counts as the empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column, "").cast(pa.large_string())
    n = len(column)
    at = np.frombuffer(column.buffers()[1], np.int64, n + 1, column.offset * 8) if n else np.zeros(1, np.int64)
    data = column.buffers()[2]
    buf = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.empty(0, np.uint8)
    return buf, at - at[0]


class ByteWords:
    """The words of a batch's texts: `starts` and `lengths` of the slices of `buf`, and `first`, the place of each text's first word.

    buf ends with LONG zero bytes, so that lanes may be read past the last word. No word crosses from a text to the next.
    """

    def __init__(self, column: pa.Array | pa.ChunkedArray, is_word: np.ndarray, fold: bool = True):
        raw, self.offsets = utf8(column)
        self.buf = np.zeros(len(raw) + LONG, np.uint8)
        self.buf[: len(raw)] = _FOLD[raw] if fold else raw
        inside = is_word[raw]
        opens = inside.copy()
        opens[1:] &= ~inside[:-1]
        heads = self.offsets[:-1][np.diff(self.offsets) > 0]
        opens[heads] = inside[heads]
        closes = inside.copy()
        closes[:-1] &= ~inside[1:]
        tails = self.offsets[1:][np.diff(self.offsets) > 0] - 1
        closes[tails] = inside[tails]
        self.starts = np.flatnonzero(opens)
        self.lengths = np.flatnonzero(closes) + 1 - self.starts
        self.first = np.searchsorted(self.starts, self.offsets)

    def __len__(self) -> int:
        return len(self.starts)

    def counts(self) -> np.ndarray:
        """Words of each text."""
        return np.diff(self.first)

    def texts_of(self) -> np.ndarray:
        """The place of the text that each word belongs to."""
        return np.repeat(np.arange(len(self.first) - 1), self.counts())

    def slices(self, at: np.ndarray) -> list[bytes]:
        data = self.buf.tobytes()
        return [data[a : a + n] for a, n in zip(self.starts[at].tolist(), self.lengths[at].tolist(), strict=True)]


def lanes(buf: np.ndarray, starts: np.ndarray, lengths: np.ndarray, k: int) -> np.ndarray:
    """The k-th eight bytes of each slice as little-endian integers, zero beyond its end."""
    wide = np.ndarray((len(buf) - 7,), "<u8", buf, strides=(1,))
    left = np.clip(lengths - 8 * k, 0, 8)
    out = wide[np.where(left > 0, starts + 8 * k, 0)]
    keep = np.where(left == 8, np.uint64(2**64 - 1), (np.uint64(1) << (8 * (left % 8)).astype(np.uint64)) - np.uint64(1))
    return out & keep


def _turned(x: np.ndarray, bits: int) -> np.ndarray:
    return (x << np.uint64(bits)) | (x >> np.uint64(64 - bits))


def xxh64(buf: np.ndarray, starts: np.ndarray, lengths: np.ndarray, seed: int = 0) -> np.ndarray:
    """XXH64 of each slice, all short ones at once; those of LONG bytes or more go to the library one by one."""
    with np.errstate(over="ignore"):
        h = np.uint64(seed) + P5 + lengths.astype(np.uint64)
        for k in range(3):
            on = lengths >= 8 * (k + 1)
            x = _turned(lanes(buf, starts, lengths, k) * P2, 31) * P1
            h = np.where(on, _turned(h ^ x, 27) * P1 + P4, h)
        tail, left = starts + lengths // 8 * 8, lengths % 8
        x = lanes(buf, tail, left, 0)
        four = left >= 4
        h = np.where(four, _turned(h ^ ((x & np.uint64(0xFFFFFFFF)) * P1), 23) * P2 + P3, h)
        x = np.where(four, x >> np.uint64(32), x)
        for k in range(3):
            h = np.where(left % 4 > k, _turned(h ^ (((x >> np.uint64(8 * k)) & np.uint64(255)) * P5), 11) * P1, h)
        h ^= h >> np.uint64(33)
        h *= P2
        h ^= h >> np.uint64(29)
        h *= P3
        h ^= h >> np.uint64(32)
    far = np.flatnonzero(lengths >= LONG)
    if len(far):
        data = memoryview(buf)
        h[far] = [xxhash.xxh64_intdigest(data[a : a + n], seed) for a, n in zip(starts[far].tolist(), lengths[far].tolist(), strict=True)]
    return h


def grouped(buf: np.ndarray, starts: np.ndarray, lengths: np.ndarray, hashes: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(ids, examples): equal slices get equal ids from 0 on; examples has the place of one slice of each id.

    Slices are grouped by their hashes, XXH64 unless given, and each is then compared with its group's
    example byte by byte. Those that differ, texts of one hash, are told apart by their bytes.
    """
    if not len(starts):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    hashes = xxh64(buf, starts, lengths) if hashes is None else hashes
    _, examples, ids = np.unique(hashes, return_index=True, return_inverse=True)
    rep = examples[ids]
    same = lengths == lengths[rep]
    for k in range(LONG // 8):
        some = np.flatnonzero(same & (lengths > 8 * k) & (lengths < LONG) & (rep != np.arange(len(rep))))
        if not len(some):
            break
        same[some] = lanes(buf, starts[some], lengths[some], k) == lanes(buf, starts[rep[some]], lengths[some], k)
    data = memoryview(buf)
    for i in np.flatnonzero(same & (lengths >= LONG)).tolist():
        j = rep[i]
        if i != j:
            n = int(lengths[i])
            same[i] = data[starts[i] : starts[i] + n] == data[starts[j] : starts[j] + n]
    odd = np.flatnonzero(~same)
    if len(odd):
        others: dict[tuple[int, bytes], int] = {}
        more = []
        for i in odd.tolist():
            key = int(ids[i]), bytes(data[starts[i] : starts[i] + int(lengths[i])])
            if key not in others:
                others[key] = len(examples) + len(more)
                more.append(i)
            ids[i] = others[key]
        examples = np.concatenate([examples, more])
    return ids, examples


def shares(mask: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """How many of each text's bytes are marked."""
    total = np.concatenate([[0], np.cumsum(mask, dtype=np.int64)])
    return total[offsets[1:]] - total[offsets[:-1]]

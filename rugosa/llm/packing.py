"""Packing token sequences: non-negative least squares over length combinations, then a greedy rest."""

from __future__ import annotations

import zlib
from bisect import bisect_right, insort
from collections import defaultdict
from collections.abc import Iterator
from itertools import combinations_with_replacement

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common, tokens

PIECES = "row_key long, doc_id long, start long, length long, ids binary, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


#: Rows (tasks times lengths of rests) up to which prefix sums are broadcast; beyond them they are joined by a shuffle.
BROADCAST_ROWS = 500_000


def combinations_filling(hist: np.ndarray, window: int, most: int = 6000, stems: int = 20) -> list[tuple[int, ...]]:
    """Shallow combinations of two to five lengths that fill the window exactly, of lengths that occur.

    All pairs; and up to four of `stems` lengths, spread over the quantiles of the histogram, completed by the one
    length that fills the window. The `most` with the most documents behind their rarest length are returned.
    """
    have = np.flatnonzero(hist[:window])
    out = {(int(a), window - int(a)) for a in have if 2 * a <= window and hist[window - a]}
    if len(have):
        at = np.searchsorted(np.cumsum(hist[have]), np.linspace(0, hist[have].sum(), stems + 2)[1:-1])
        base = sorted({int(have[min(i, len(have) - 1)]) for i in at})
        for depth in (2, 3, 4):
            for c in combinations_with_replacement(base, depth):
                rest = window - sum(c)
                if rest > 0 and hist[rest]:
                    out.add(tuple(sorted((*c, rest))))
    return sorted(out, key=lambda c: (-min(int(hist[x]) // c.count(x) for x in c), c))[:most]


def repeat_counts(hist: np.ndarray, combos: list[tuple[int, ...]], sweeps: int = 40) -> np.ndarray:
    """x >= 0 that minimises |A x - hist|^2, A holding each combination's lengths, by cyclic coordinate descent."""
    if not combos:
        return np.zeros(0)
    cols = [np.unique(c, return_counts=True) for c in combos]
    norm = [float((n * n).sum()) for _, n in cols]
    left, x = hist.astype(np.float64), np.zeros(len(combos))
    for _ in range(sweeps):
        most = 0.0
        for j, (at, n) in enumerate(cols):
            new = max(0.0, x[j] + float(n @ left[at]) / norm[j])
            step = new - x[j]
            if step:
                left[at] -= n * step
                x[j] = new
                most = max(most, abs(step))
        if most < 0.01:
            break
    return x


class Plan:
    """Where the rests (lengths below the window) go: for each length, runs of documents with sequence and offset.

    assigned[length]: (first, end, start, size, sequence, offset, 1): the documents first..end-1 of that length put
    the ids start..start+size-1 of their rest into sequences sequence, sequence+1, ... at the offset.
    """

    def __init__(self, hist: np.ndarray, window: int):
        self.window, self.sequences, self.assigned = window, 0, defaultdict(list)
        # Runs of pieces of one size: (length of the rest, first, end, start of the piece in it).
        self.runs: dict[int, list[tuple[int, int, int, int]]] = {int(s): [(int(s), 0, int(hist[s]), 0)] for s in np.flatnonzero(hist)}
        self.left = {s: r[0][2] for s, r in self.runs.items()}
        self.sizes = sorted(self.runs)
        combos = combinations_filling(hist, window)
        x = repeat_counts(hist, combos)
        for j in np.argsort(-x, kind="stable"):
            self.place(list(combos[j]), int(x[j] + 0.5))
        self.greedy()

    def take(self, size: int, n: int) -> list[tuple[int, int, int, int]]:
        out, runs = [], self.runs[size]
        self.left[size] -= n
        while n:
            rest, lo, hi, start = runs.pop()
            k = min(n, hi - lo)
            if hi - lo > k:
                runs.append((rest, lo + k, hi, start))
            out.append((rest, lo, lo + k, start))
            n -= k
        if not self.left[size]:
            del self.left[size], self.runs[size]
            self.sizes.remove(size)
        return out

    def put(self, size: int, runs: list[tuple[int, int, int, int]]) -> None:
        if size not in self.runs:
            self.runs[size], self.left[size] = [], 0
            insort(self.sizes, size)
        self.runs[size] += runs
        self.left[size] += sum(hi - lo for _, lo, hi, _ in runs)

    def place(self, sizes: list[int], n: int, cut: tuple[int, int] | None = None) -> int:
        """n sequences of these sizes, as far as there are enough; cut: (size, head): a last piece cut after head ids."""
        want = sizes + ([cut[0]] if cut else [])
        n = min([n, *(self.left.get(s, 0) // want.count(s) for s in set(want))])
        if n <= 0:
            return 0
        offset = 0
        for i, s in enumerate(want):
            seq, tails = self.sequences, []
            size = cut[1] if cut and i == len(sizes) else s
            for rest, lo, hi, start in self.take(s, n):
                self.assigned[rest].append((lo, hi, start, size, seq, offset))
                seq += hi - lo
                tails.append((rest, lo, hi, start + size))
            if size < s:
                self.put(s - size, tails)
            offset += size
        self.sequences += n
        return n

    def greedy(self) -> None:
        """Largest first, each gap filled by the largest piece that fits, the last by cutting the smallest that is larger."""
        while self.sizes:
            if sum(s * n for s, n in self.left.items()) < self.window:
                self.tail()
                return
            sizes, used, gap, cut = [], defaultdict(int), self.window, None
            while gap:
                i = bisect_right(self.sizes, gap) - 1
                while i >= 0 and self.left[self.sizes[i]] <= used.get(self.sizes[i], 0):
                    i -= 1
                if i >= 0:
                    s = self.sizes[i]
                    sizes.append(s)
                    used[s] += 1
                    gap -= s
                    continue
                larger = next(s for s in self.sizes if s > gap and self.left[s] > used.get(s, 0))
                cut = (larger, gap)
                break
            n = min(self.left[s] // k for s, k in used.items())
            self.place(sizes, max(1, n if cut is None else min(n, self.left[cut[0]] // (used.get(cut[0], 0) + 1))), cut)

    def tail(self) -> None:
        """What is left, under a window: sequences of powers of two, which need no padding."""
        total = sum(s * n for s, n in self.left.items())
        for bit in reversed(range(total.bit_length())):
            gap, offset = total & (1 << bit), 0
            while gap:
                s = self.sizes[-1]
                (rest, lo, hi, start), = self.take(s, 1)
                size = min(s, gap)
                self.assigned[rest].append((lo, hi, start, size, self.sequences, offset))
                if size < s:
                    self.put(s - size, [(rest, lo, hi, start + size)])
                offset, gap = offset + size, gap - size
            self.sequences += bool(total & (1 << bit))

    def tables(self) -> dict[int, np.ndarray]:
        return {rest: np.array(sorted(v), np.int64) for rest, v in self.assigned.items()}


def encoded(docs: DataFrame, vocab: str, end_id: int, window: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: its ids with end_id, the length of its rest, and its place among its task's documents of that rest and among its task's full windows."""
    path = vocab

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = tokens.encoder(path, False)
        end, item = end_id.to_bytes(enc.size, "little"), enc.size
        seen: dict[int, int] = defaultdict(int)
        windows = 0
        from pyspark import TaskContext

        task = TaskContext.get().partitionId()
        for b in common.portions(batches, "text"):
            ids, n = enc.encode_all(b.column("text").to_pylist())
            ends = np.cumsum(n)
            raw, at = ids.tobytes(), (ends * item).tolist()
            full, rest = np.divmod(n + 1, window)
            nth = []
            for r in rest.tolist():
                nth.append(seen[r])
                seen[r] += 1
            before = windows + np.cumsum(full) - full
            windows += int(full.sum())
            data = pa.array([raw[lo:hi] + end for lo, hi in zip([0, *at], at)], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column("row_key"), b.column("doc_id"), data, pa.array(np.full(len(n), item, np.int32)), pa.array(rest.astype(np.int32)), pa.array(nth, pa.int64()), pa.array(before), pa.array(np.full(len(n), task, np.int32))], names=["row_key", "doc_id", "ids", "item", "rest", "nth", "windows", "task"])

    rows = docs.select(F.monotonically_increasing_id().alias("row_key"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "row_key long, doc_id long, ids binary, item int, rest int, nth long, windows long, task int")


def pack(docs: DataFrame, vocab: str, window: int = 2048, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True) -> DataFrame:
    """Pieces of all documents (null text: empty) in sequences of at most `window` ids; each id is in one piece.

    A document's full windows are sequences of their own; its rest, shorter than a window, is what is packed. The
    histogram of rests (window - 1 counts) goes to the driver, where repeat counts of length combinations that
    fill a window are solved for, rounded, and what they leave is packed greedily, cutting where no length fits.
    The last few ids form sequences whose lengths are powers of two. A document's sequence follows
    from the number of documents of its rest before it, which are prefix sums over tasks. Columns: row_key (one a
    row of docs, so rows that repeat an id stay apart), doc_id, start, length, ids, ids_crc32, doc_tokens, sequence_id, offset.
    """
    t = common.written(encoded(docs, vocab, end_id, window, id_col, text_col), "encoded")
    meta = t.select("task", "rest", "windows", (F.floor((F.length("ids") / F.col("item")) / window)).cast("long").alias("full"))
    by = common.written(meta.groupBy("task", "rest").agg(F.count("*").alias("n"), F.sum("full").alias("full")), "rests")
    hist = np.zeros(window, np.int64)
    for r in by.groupBy("rest").agg(F.sum("n").alias("n")).collect():
        hist[r.rest] = r.n
    full = int(by.agg(F.sum("full")).first()[0] or 0)
    hist[0] = 0
    plan = Plan(hist, window)
    held = docs.sparkSession.sparkContext.broadcast(plan.tables())
    before = Window.partitionBy("rest").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    # A row a task: the windows before it. The rows are as many as tasks, not documents.
    tasks = by.groupBy("task").agg(F.sum("full").alias("full")).withColumn("windows_before", F.coalesce(F.sum("full").over(Window.orderBy("task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("task", "windows_before")
    bases = by.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))).select("task", "rest", "before").join(tasks, "task")
    bases = common.written(bases, "bases")
    bases = F.broadcast(bases) if bases.count() <= BROADCAST_ROWS else bases.hint("merge")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan = held.value
        for b in common.pieces(batches, 512):
            cols: list[list] = [[] for _ in range(9)]
            names = ("row_key", "doc_id", "item", "rest", "nth", "windows", "before", "windows_before")
            for raw, key, doc, item, rest, nth, windows, before, windows_before in zip(b.column("ids"), *(b.column(c).to_pylist() for c in names)):
                ids = np.frombuffer(raw.as_buffer(), f"<u{item}").astype("<u4")
                n = len(ids)
                parts = [(i * window, window, windows_before + windows + i, 0) for i in range(n // window)]
                if rest:
                    at, nth = plan[rest], before + nth
                    parts += [(n - rest + start, size, full + seq + nth - lo, offset) for lo, _, start, size, seq, offset in at[(at[:, 0] <= nth) & (nth < at[:, 1])].tolist()]
                for start, size, seq, offset in sorted(parts):
                    piece = ids[start : start + size]
                    for c, v in zip(cols, (key, doc, start, size, piece.tobytes() if with_ids else None, zlib.crc32(piece), n, seq, offset), strict=True):
                        c.append(v)
            types = [pa.int64()] * 4 + [pa.binary()] + [pa.int64()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, types, strict=True)], names=[x.split(" ")[0] for x in PIECES.split(", ")])

    return t.join(bases, ["task", "rest"]).mapInArrow(run, PIECES)


def op2_packing(spark, sf_dir: str) -> DataFrame:
    docs = common.read_table(spark, sf_dir, "documents")
    return pack(docs, tokens.vocabulary("word_bpe_49k.json"), with_ids=False).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


QUERIES = {"op2_packing": op2_packing}

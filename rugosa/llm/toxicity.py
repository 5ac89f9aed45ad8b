"""Toxicity by a factorization machine over hashed terms."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

_WORD = re.compile(r"[^\W\d_]+")
#: Labelled rows a model is fitted on at most, the ones whose ids hash lowest: a bound of the training, not of what is scored.
MAX_TRAIN_ROWS = 16_000


class TermHasher(dict):
    """Word to its hashed terms, as 32-bit integers in bytes: the word and its beginnings of 4, 5 and 6 letters."""

    def __init__(self, bits: int, most: int = 100_000):
        super().__init__()
        self.mask, self.most = (1 << bits) - 1, most

    def __missing__(self, word: str) -> bytes:
        terms = ["=" + word] + [f"{k}{word[:k]}" for k in (4, 5, 6) if len(word) >= k]
        out = b"".join((zlib.crc32(t.encode()) & self.mask).to_bytes(4, "little") for t in terms)
        if len(self) < self.most:
            self[word] = out
        return out

    def terms(self, text: str | None) -> np.ndarray:
        """The distinct hashed terms of a whole text, which is lower-cased."""
        words = set(_WORD.findall((text or "").lower()))
        return np.unique(np.frombuffer(b"".join(map(self.__getitem__, words)), "<u4"))


def hasher(bits: int) -> TermHasher:
    return common.kept(("terms", bits), lambda: TermHasher(bits))


class FactorizationMachine:
    """p = 1 / (1 + exp(-(b + sum_i w_i + sum_{i<j} <v_i, v_j> / sqrt(n)))) over a text's n distinct terms.

    Fitted by AdaGrad on the log loss, the pair term at a rate of its own, with soft thresholds on w and shrinkage of v; terms in fewer
    than min_df training texts are left out. However many rows there are, they are gone through until a pass's
    mean loss has twice failed to fall by the share `tol`, or `passes` times. The pair sum is taken as (|sum v|^2 - sum |v|^2) / 2.
    """

    def __init__(self, bits: int = 17, k: int = 8):
        self.bits, self.k = bits, k
        self.b, self.w, self.v = 0.0, np.zeros(1 << bits, np.float32), np.zeros((1 << bits, k), np.float32)

    def raw(self, rows: list[np.ndarray]) -> np.ndarray:
        n = np.array([len(r) for r in rows])
        out = np.full(len(rows), self.b, np.float64)
        full = np.flatnonzero(n)
        if len(full):
            at = np.concatenate([rows[i] for i in full])
            starts = np.concatenate([[0], np.cumsum(n[full])[:-1]])
            v = self.v[at]
            s = np.add.reduceat(v, starts, axis=0)
            q = np.add.reduceat((v * v).sum(1), starts)
            out[full] += np.add.reduceat(self.w[at].astype(np.float64), starts) + ((s * s).sum(1) - q) / (2 * np.sqrt(n[full]))
        return out

    def score(self, rows: list[np.ndarray]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(rows), -30, 30)))

    def fit(self, rows: list[np.ndarray], y: np.ndarray, passes: int = 60, tol: float = 0.003, batch: int = 64, lr: float = 0.3, pair_lr: float = 0.02, l1: float = 3e-4, l2: float = 1e-2, min_df: int = 3, seed: int = 7) -> FactorizationMachine:
        rng, k = np.random.default_rng(seed), self.k
        df = np.zeros(1 << self.bits, np.int64)
        for r in rows:
            df[r] += 1
        use = np.flatnonzero(df >= min_df)
        to = np.full(1 << self.bits, -1, np.int32)
        to[use] = np.arange(len(use), dtype=np.int32)
        rows = [(x := to[r])[x >= 0] for r in rows]
        d = len(use)
        p = np.clip(y.mean() if len(y) else 0.5, 1e-3, 1 - 1e-3)
        self.b = float(np.log(p / (1 - p)))
        w, v = np.zeros(d), rng.normal(0, 0.05, (d, k))
        gw, gv = np.full(d, 1e-6), np.full((d, k), 1e-6)
        last, still = np.inf, 0
        for _ in range(passes if d and len(rows) else 0):
            loss = 0.0
            for part in np.array_split(rng.permutation(len(rows)), max(1, len(rows) // batch)):
                part = part[[len(rows[i]) > 0 for i in part]]
                if not len(part):
                    continue
                at = np.concatenate([rows[i] for i in part])
                n = np.array([len(rows[i]) for i in part])
                starts, of = np.concatenate([[0], np.cumsum(n)[:-1]]), np.repeat(np.arange(len(part)), n)
                va = v[at]
                s = np.add.reduceat(va, starts, axis=0)
                z = self.b + np.add.reduceat(w[at], starts) + ((s * s).sum(1) - np.add.reduceat((va * va).sum(1), starts)) / (2 * np.sqrt(n))
                g = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[part]) / len(part)
                loss += float(np.logaddexp(0, np.where(y[part] > 0, -z, z)).sum())
                dw = np.bincount(at, g[of], d)
                gn = (g / np.sqrt(n))[of]
                self.b -= lr * float(g.sum())
                gw += dw * dw
                step = lr / np.sqrt(gw)
                w -= step * dw
                seen = dw != 0
                w[seen] = np.sign(w[seen]) * np.maximum(np.abs(w[seen]) - step[seen] * l1, 0)
                for f in range(k):
                    dvf = np.bincount(at, gn * (s[of, f] - va[:, f]), d) + l2 * v[:, f] * seen / len(part)
                    gv[:, f] += dvf * dvf
                    v[:, f] -= pair_lr * dvf / np.sqrt(gv[:, f])
            still = still + 1 if loss > last * (1 - tol) else 0
            last = min(last, loss)
            if still == 2:
                break
        self.w[use], self.v[use] = w, v
        return self


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", bits: int = 17, max_rows: int = MAX_TRAIN_ROWS) -> FactorizationMachine:
    """A model from labelled documents outside the held-out fifth (crc32 of the id as text, modulo 5, is 0).

    At most max_rows documents are used: the ids whose hashes are lowest. Rows without a label or id are
    left out; of several labels of a document the largest counts. No label at all: a model that gives 0.5 to all.
    """
    lab = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y")).where("id IS NOT NULL AND y IS NOT NULL").where(common.crc_mod("id", 5) != 0)
    lab = lab.groupBy("id").agg(F.max("y").alias("y")).orderBy(F.xxhash64("id"), "id").limit(max_rows)
    train = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(lab), "id")  # lab has max_rows rows at most

    def terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        h = hasher(bits)
        for b in common.pieces(batches):
            yield pa.RecordBatch.from_arrays([b.column("id").cast(pa.int64()), b.column("y"), pa.array([h.terms(t).tobytes() for t in b.column("text").to_pylist()], pa.binary())], names=["id", "y", "terms"])

    got = train.mapInArrow(terms, "id long, y int, terms binary").dropDuplicates(["id", "terms"]).orderBy(F.xxhash64("id"), F.col("id"), F.crc32("terms")).limit(max_rows)

    def make(table: pa.Table) -> FactorizationMachine:
        return FactorizationMachine(bits).fit(term_rows(table.column("terms")), table.column("y").to_numpy().astype(np.float64))

    return common.made_by_task(got, make) or FactorizationMachine(bits)


def term_rows(column: pa.ChunkedArray) -> list[np.ndarray]:
    """Each row's terms, as views of the column's own memory."""
    out = []
    for c in column.chunks:
        if len(c):
            kind = np.dtype("<i8" if pa.types.is_large_binary(c.type) else "<i4")
            ends = np.frombuffer(c.buffers()[1], kind, len(c) + 1, c.offset * kind.itemsize)
            out += [np.frombuffer(c.buffers()[2], "<u4", (b - a) // 4, a) if b > a else np.empty(0, "<u4") for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
    return out


def scored(docs: DataFrame, model: FactorizationMachine, text_col: str = "text", batch_rows: int = 256):
    """A function from an Arrow batch to the scores of its texts; the model, of fixed size, is broadcast."""
    held = docs.sparkSession.sparkContext.broadcast((model.bits, model.k, model.b, model.w, model.v))

    def score(b: pa.RecordBatch) -> np.ndarray:
        m = FactorizationMachine.__new__(FactorizationMachine)
        m.bits, m.k, m.b, m.w, m.v = held.value
        h = hasher(m.bits)
        out = [m.score([h.terms(t) for t in x.column(text_col).to_pylist()]) for x in common.pieces([b], batch_rows)]
        return np.concatenate(out) if out else np.empty(0)

    return score


def score_documents(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row of docs. Null and empty texts get the score of no terms; a null id counts as held out."""
    score = scored(docs, fit(docs, labels, id_col, text_col))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = score(b)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), (common.crc_mod(id_col, 5) == 0).alias("held_out"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The rows of docs, with all their columns, whose score is below threshold."""
    score = scored(docs, fit(docs, labels))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array(score(b) < threshold))

    return docs.mapInArrow(run, docs.schema)


def op10_toxicity(spark, sf_dir: str) -> DataFrame:
    return score_documents(common.read_table(spark, sf_dir, "documents"), common.read_table(spark, sf_dir, "labels"))


QUERIES = {"op10_toxicity": op10_toxicity}

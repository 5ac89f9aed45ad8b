"""Language-model scores by context-tree weighting over bytes, beside a word-count base."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

DEPTH = 5
END = 255  # a byte that UTF-8 never has closes each text
#: Entries of a table of code lengths that go to the workers at once; more are split into several tables, one pass each.
MAX_ENTRIES = 12_000_000
#: Words whose counts go to the workers; the counts of all others are joined.
HOT_WORDS = 1 << 17
_TABLES: dict[int, GramTable] = {}


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().lower().split()


def grams_of(texts: list[list[bytes]], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """The byte n-grams (depth bytes of context, the byte itself last) of texts, and where each text's begin; depth zero bytes precede a text."""
    parts = [b" ".join(w) + bytes([END]) for w in texts]
    pad = bytes(depth)
    a = np.frombuffer(pad + pad.join(parts), np.uint8).astype(np.uint64)
    k = np.zeros(len(a) - depth, np.uint64)
    for j in range(depth + 1):
        k = (k << np.uint64(8)) | a[j : len(a) - depth + j]
    n = np.fromiter(map(len, parts), np.int64, len(parts))
    starts = np.cumsum(n + depth) - n - depth
    keep = np.ones(len(k), bool)
    for j in range(depth):  # the pads are contexts, never predicted
        keep[(starts + n + j)[:-1]] = False
    return k[keep], np.cumsum(n) - n


def log_gamma(x: np.ndarray) -> np.ndarray:
    """Stirling's series after eight steps of the recurrence; x >= 0.5."""
    shift = np.ones_like(x)
    for i in range(8):
        shift = shift * (x + i)
    y = x + 8
    r = 1 / (y * y)
    return (y - 0.5) * np.log(y) - y + 0.5 * np.log(2 * np.pi) + (1 / 12 - r * (1 / 360 - r * (1 / 1260 - r / 1680))) / y - np.log(shift)


def log_kt(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    """Natural logarithm of the Krichevsky-Trofimov probability of a sequence with these counts."""
    return log_gamma(n0 + 0.5) + log_gamma(n1 + 0.5) - log_gamma(n0 + n1 + 1.0) - np.log(np.pi)


class Nodes:
    """Counts of the nodes that grams pass at one depth and bit: a node is a context and the bits of the byte so far."""

    def __init__(self, codes: np.ndarray, counts: np.ndarray, depth: int, bit: int):
        context = (codes >> np.uint64(8)) & np.uint64((1 << (8 * depth)) - 1)
        x = (codes & np.uint64(255)) | np.uint64(256)
        self.ids, self.at = np.unique((context << np.uint64(8)) | (x >> np.uint64(8 - bit)), return_inverse=True)
        ones = ((codes >> np.uint64(7 - bit)) & np.uint64(1)).astype(bool)
        self.n1 = np.bincount(self.at, counts * ones, len(self.ids))
        self.n0 = np.bincount(self.at, counts * ~ones, len(self.ids))


def weighed(codes: np.ndarray, counts: np.ndarray, depth: int, top: int) -> list[tuple[list[Nodes], list[np.ndarray], np.ndarray]]:
    """For each bit the nodes of depths top..depth, the logarithms of their odds (own estimate against children), and log P_w of depth top."""
    out = []
    for bit in range(8):
        nodes = [Nodes(codes, counts, d, bit) for d in range(top, depth + 1)]
        kt = [log_kt(z.n0, z.n1) for z in nodes]
        odds, lw = [np.full(len(kt[-1]), np.inf)], kt[-1]
        for d in range(depth - 1, top - 1, -1):
            low, up = nodes[d - top + 1], nodes[d - top]
            parent = np.zeros(len(low.ids), np.int64)
            parent[low.at] = up.at
            below = np.bincount(parent, lw, len(up.ids))
            odds.insert(0, kt[d - top] - below)
            lw = np.logaddexp(kt[d - top], below) - np.log(2)
        out.append((nodes, odds, lw))
    return out


def mixed(own: np.ndarray, seen: np.ndarray, odds: np.ndarray, below: np.ndarray, below_seen: np.ndarray) -> np.ndarray:
    """The estimate at a node: its own, mixed with that of the context one byte longer where training has that."""
    w = 1 / (1 + np.exp(-np.clip(odds, -700, 700)))
    return np.where(below_seen, w * own + (1 - w) * below, own)


def own_estimate(n0: np.ndarray, n1: np.ndarray, ones: np.ndarray) -> np.ndarray:
    return (np.where(ones, n1, n0) + 0.5) / (n0 + n1 + 1)


class Upper:
    """Depths 0 and 1: at most 65,280 nodes, from the sums over all longer contexts."""

    def __init__(self, rows: list[tuple[int, float, float, float]]):
        self.n0, self.n1, lw2 = (np.zeros((2, 1 << 16)) for _ in range(3))
        for node, n0, n1, lw in rows:
            self.n0[1, node], self.n1[1, node], lw2[1, node] = n0, n1, lw
        self.n0[0, :256], self.n1[0, :256] = (z[1].reshape(256, 256).sum(0) for z in (self.n0, self.n1))
        self.odds = np.zeros((2, 1 << 16))
        kt1 = log_kt(self.n0[1], self.n1[1])
        self.odds[1] = kt1 - lw2[1]
        lw1 = np.logaddexp(kt1, lw2[1]) - np.log(2)
        self.odds[0, :256] = log_kt(self.n0[0, :256], self.n1[0, :256]) - lw1.reshape(256, 256).sum(0)


def code_lengths(codes: np.ndarray, counts: np.ndarray, upper: Upper, depth: int) -> np.ndarray:
    """log10 of each gram's probability: its byte after its context, by the tree of the training counts."""
    total = np.zeros(len(codes))
    c1 = (codes >> np.uint64(8)).astype(np.int64) & 255
    x = (codes & np.uint64(255)).astype(np.int64) | 256
    for bit, (nodes, odds, _) in enumerate(weighed(codes, counts, depth, 2)):
        ones = ((x >> (7 - bit)) & 1).astype(bool)
        p, seen = np.full(len(codes), 0.5), np.zeros(len(codes), bool)
        for z, o in zip(reversed(nodes), reversed(odds), strict=True):
            n0, n1 = z.n0[z.at], z.n1[z.at]
            here = n0 + n1 > 0
            p, seen = np.where(here, mixed(own_estimate(n0, n1, ones), here, o[z.at], p, seen), 0.5), here
        part = x >> (8 - bit)
        for d, at in ((1, c1 * 256 + part), (0, part)):
            n0, n1 = upper.n0[d, at], upper.n1[d, at]
            here = n0 + n1 > 0
            p, seen = np.where(here, mixed(own_estimate(n0, n1, ones), here, upper.odds[d, at], p, seen), 0.5), here
        total += np.log10(p)
    return total


class GramTable:
    """Values by gram, for vectors of grams: places by a multiplicative hash, then the next ones."""

    MIX = np.uint64(0x9E3779B97F4A7C15)

    def __init__(self, codes: np.ndarray, values: np.ndarray):
        self.bits = max(8, int(np.ceil(np.log2(max(len(codes), 1) * 2))))
        h = self.place(codes)
        order = np.argsort(h, kind="stable")
        self.codes, self.values = np.append(codes[order], np.uint64(2**64 - 1)), np.append(values[order], np.float32(0))
        self.starts = np.searchsorted(h[order], np.arange((1 << self.bits) + 1)).astype(np.int32)

    def place(self, codes: np.ndarray) -> np.ndarray:
        return (codes * self.MIX) >> np.uint64(64 - self.bits)

    def get(self, codes: np.ndarray) -> np.ndarray:
        """The values, 0 where a gram isn't there."""
        h = self.place(codes).astype(np.int64)
        at = self.starts[h].astype(np.int64)
        off = np.flatnonzero(self.codes[at] != codes)
        last = self.starts[h[off] + 1]
        while len(off):
            at[off] += 1
            out = at[off] >= last
            at[off[out]] = len(self.codes) - 1
            more = ~out & (self.codes[at[off]] != codes[off])
            off, last = off[more], last[more]
        return self.values[at]


def counted(docs: DataFrame, depth: int) -> DataFrame:
    """Per task, in one reading: word counts of the training rows; and by the last two context bytes all grams, with counts in the training rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: dict[bytes, int] = {}
        ends, codes, counts, size = 0, [], [], 0

        def merge(codes: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
            c, n = np.concatenate(codes), np.concatenate(counts)
            order = np.argsort(c, kind="stable")
            c, n = c[order], n[order]
            first = np.flatnonzero(np.r_[True, c[1:] != c[:-1]]) if len(c) else np.empty(0, np.int64)
            return c[first], np.add.reduceat(n, first) if len(first) else n

        def word_rows() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.nulls(len(words), pa.int32()), pa.array(list(words), pa.binary()), pa.array(list(words.values()), pa.int64()), pa.nulls(len(words), pa.binary())], names=["suffix", "a", "n", "b"])

        for b in common.pieces(batches, 400):
            trains = np.array(b.column("trains").to_pylist(), bool)
            texts = [words_of(t.as_py()) for t in b.column("text")]
            for w in (texts[i] for i in np.flatnonzero(trains)):
                ends += 1
                for x in w:
                    words[x] = words.get(x, 0) + 1
            for part in (trains, ~trains):
                some = [texts[i] for i in np.flatnonzero(part)]
                if some:
                    k, _ = grams_of(some, depth)
                    k.sort()
                    first = np.flatnonzero(np.r_[True, k[1:] != k[:-1]])
                    codes.append(k[first])
                    counts.append(np.diff(np.r_[first, len(k)]) * int(part is trains))
                    size += len(first)
            if size > 2_000_000:
                c, n = merge(codes, counts)
                codes, counts, size = [c], [n], 0
            if len(words) > 400_000:
                yield word_rows()
                words = {}
        yield word_rows()
        if ends:
            yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int32()), pa.nulls(1, pa.binary()), pa.array([ends], pa.int64()), pa.nulls(1, pa.binary())], names=["suffix", "a", "n", "b"])
        if codes:
            c, n = merge(codes, counts)
            suffix = ((c >> np.uint64(8)) & np.uint64(0xFFFF)).astype(np.int32)
            order = np.argsort(suffix, kind="stable")
            c, n, suffix = c[order], n[order], suffix[order]
            cuts = np.flatnonzero(np.r_[True, suffix[1:] != suffix[:-1]])
            ends_ = np.r_[cuts[1:], len(c)]
            for i in range(0, len(cuts), 2000):
                at = list(zip(cuts[i : i + 2000], ends_[i : i + 2000], strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(suffix[cuts[i : i + 2000]]), pa.array([c[x:y].tobytes() for x, y in at], pa.binary()), pa.nulls(len(at), pa.int64()), pa.array([n[x:y].astype("<i8").tobytes() for x, y in at], pa.binary())], names=["suffix", "a", "n", "b"])

    return docs.select("trains", "text").mapInArrow(run, "suffix int, a binary, n long, b binary")


def trained(gathered: DataFrame, depth: int) -> tuple[DataFrame, Upper]:
    """The grams of the corpus by the last two context bytes (suffix, codes, counts), and the upper tree."""

    def merge(table: pa.Table) -> pa.Table:
        c = np.frombuffer(b"".join(table.column("a").to_pylist()), "<u8")
        n = np.frombuffer(b"".join(table.column("b").to_pylist()), "<i8")
        codes, at = np.unique(c, return_inverse=True)
        counts = np.bincount(at, n, len(codes)).astype("<i8")
        return pa.table({"suffix": table.column("suffix")[:1], "codes": pa.array([codes.tobytes()], pa.binary()), "counts": pa.array([counts.tobytes()], pa.binary())})

    grams = common.written(gathered.where("suffix IS NOT NULL").select("suffix", "a", "b").groupBy("suffix").applyInArrow(merge, "suffix int, codes binary, counts binary"), "grams")

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                codes, counts = np.frombuffer(r["codes"], "<u8"), np.frombuffer(r["counts"], "<i8").astype(np.float64)
                for nodes, _, lw in weighed(codes, counts, depth, 2):
                    z = nodes[0]
                    node = (z.ids & np.uint64(0xFFFF)).astype(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(z.n0), pa.array(z.n1), pa.array(lw)], names=["node", "n0", "n1", "lw"])

    rows = grams.mapInArrow(sums, "node long, n0 double, n1 double, lw double").groupBy("node").agg(F.sum("n0"), F.sum("n1"), F.sum("lw")).collect()  # 65,280 at most
    return grams, Upper(sorted((r[0], r[1], r[2], r[3]) for r in rows))


def score_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", depth: int = DEPTH, mod: int = 5, held: int = 1, hot_words: int = HOT_WORDS, max_entries: int = MAX_ENTRIES) -> DataFrame:
    """One row for each of docs: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, n_bytes, bits_per_byte.

    Rows train unless crc32(id as text) mod `mod` is `held` (a null id counts as the empty text). A text (null: empty) is its words in
    lower case (A-Z), parted by single spaces, and an end; score is log10 of its probability, base_score that of its
    words by their counts. The model is a tree over the last `depth` bytes for each of a byte's eight binary decisions: a node mixes
    its own Krichevsky-Trofimov estimate with that of the longer context, by the odds that training gives them;
    contexts that training lacks end the mixing. It is worked out in groups of the last two context bytes for all grams of the
    corpus. Their code lengths go to the workers in tables of at most max_entries. No training rows: 1/2 for each bit, and null base_score.
    """
    rows = docs.select(F.monotonically_increasing_id().alias("row_key"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), (common.crc_mod(id_col, mod) == held).alias("held_out"))
    gathered = common.written(counted(rows.withColumn("trains", ~F.col("held_out")), depth), "gathered")
    grams, upper = trained(gathered, depth)
    shared = docs.sparkSession.sparkContext.broadcast(upper)

    def lengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [code_lengths(np.frombuffer(r["codes"], "<u8"), np.frombuffer(r["counts"], "<i8").astype(np.float64), shared.value, depth).astype("<f4") for r in b.to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("suffix"), b.column("codes"), pa.array([len(x) for x in out], pa.int64()), pa.array([x.tobytes() for x in out], pa.binary())], names=["suffix", "codes", "n", "lengths"])

    table = common.written(grams.mapInArrow(lengths, "suffix int, codes binary, n long, lengths binary"), "code-lengths")
    sizes = {r.suffix: r.n for r in table.select("suffix", "n").collect()}  # a row for two context bytes: 65,536 at most
    shards, room = [[]], max_entries
    for s in sorted(sizes):
        if shards[-1] and sizes[s] > room:
            shards.append([])
            room = max_entries
        shards[-1].append(s)
        room -= sizes[s]

    vocab = common.written(gathered.where("suffix IS NULL").groupBy("a").agg(F.sum("n").alias("c")), "words")
    total = vocab.agg(F.sum("c").alias("n"), F.count("*").alias("v"), F.sum(F.when(F.col("a").isNull(), F.col("c"))).alias("ends")).first()
    n_train, n_vocab, ends = total.n or 0, total.v, total.ends or 0
    # A word count above which there are at most hot_words words.
    cut = vocab.where("a IS NOT NULL").orderBy(F.desc("c"), "a").select("c").limit(hot_words + 1).agg(F.min("c"), F.count("*")).first()
    least = cut[0] + 1 if cut[1] > hot_words else 1
    hot = vocab.where((F.col("c") >= least) & F.col("a").isNotNull()).select("a", "c").toArrow()
    hot_counts = docs.sparkSession.sparkContext.broadcast(dict(zip(hot.column("a").to_pylist(), hot.column("c").to_pylist(), strict=True)))
    below = n_train + 0.5 * (n_vocab + 1)

    def table_of(shard: list[int]):
        got = (table if len(shards) == 1 else table.where(F.col("suffix").between(shard[0], shard[-1]))).select("codes", "lengths").toArrow()
        return docs.sparkSession.sparkContext.broadcast((b"".join(got.column("codes").to_pylist()), b"".join(got.column("lengths").to_pylist())))

    def scorer(held_table, first: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            if id(held_table) not in _TABLES:
                _TABLES.clear()
                codes, values = held_table.value
                _TABLES[id(held_table)] = GramTable(np.frombuffer(codes, "<u8"), np.frombuffer(values, "<f4"))
            t, counts = _TABLES[id(held_table)], hot_counts.value
            logs: dict[bytes, float] = {}
            for b in common.pieces(batches, 400):
                texts = [words_of(x.as_py()) for x in b.column("text")]
                k, starts = grams_of(texts, depth)
                score = np.add.reduceat(t.get(k).astype(np.float64), starts)
                n_bytes = np.diff(np.r_[starts, len(k)])
                n, known, base, rare_row, rare_word = [], [], [], [], []
                for i, w in enumerate(texts if first else []):
                    got, of = 0.0, 0
                    for x in w:
                        v = logs.get(x)
                        if v is None:
                            c = counts.get(x)
                            if c is None:
                                rare_row.append(i)
                                rare_word.append(x)
                                continue
                            v = logs[x] = float(np.log10((c + 0.5) / below))
                        got += v
                        of += 1
                    n.append(len(w) + 1)
                    known.append(of + (ends > 0))
                    base.append(got + float(np.log10((ends + 0.5) / below)))
                size = b.num_rows
                key = b.column("row_key")
                fill = (lambda x, kind: pa.array(x, kind)) if first else (lambda x, kind: pa.array([0] * size, kind))
                yield pa.RecordBatch.from_arrays([key, b.column("doc_id"), b.column("held_out"), pa.nulls(size, pa.binary()), fill(n, pa.int64()), fill(known, pa.int64()), fill(base, pa.float64()), pa.array(score), pa.array(n_bytes if first else np.zeros(size, np.int64))], names=names)
                if rare_row:
                    r = len(rare_row)
                    at = pa.array(rare_row)
                    yield pa.RecordBatch.from_arrays([key.take(at), pa.nulls(r, pa.int64()), pa.nulls(r, pa.bool_()), pa.array(rare_word, pa.binary()), *[pa.nulls(r, x) for x in (pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.int64())]], names=names)

        return run

    kind = "row_key long, doc_id long, held_out boolean, word binary, n_tokens long, n_known long, base_score double, score double, n_bytes long"
    names = [x.split(" ")[0] for x in kind.split(", ")]
    passed = [rows.mapInArrow(scorer(table_of(s), i == 0), kind) for i, s in enumerate(shards)]
    scored = passed[0]
    for more in passed[1:]:
        scored = scored.unionAll(more)
    scored = common.written(scored, "scored")
    # Words beyond the hot ones: each document's are counted, and their counts in training joined.
    rare = scored.where("word IS NOT NULL").groupBy("row_key", "word").count()
    cold = vocab.where((F.col("c") < least) & F.col("a").isNotNull()).select(F.col("a").alias("word"), "c")
    known = rare.join(cold, "word", "left").select("row_key", F.when(F.col("c").isNotNull(), F.col("count")).otherwise(0).alias("n_known"), (F.col("count") * F.log10((F.coalesce("c", F.lit(0)) + 0.5) / F.lit(float(max(below, 0.5))))).alias("base_score"))
    whole = scored.where("word IS NULL").select("row_key", "doc_id", "held_out", "n_tokens", "n_known", "base_score", "score", "n_bytes")
    both = whole.unionByName(known, allowMissingColumns=True).groupBy("row_key").agg(F.max("doc_id").alias("doc_id"), F.max("held_out").alias("held_out"), *[F.sum(c).cast(k).alias(c) for c, k in (("n_tokens", "long"), ("n_known", "long"), ("base_score", "double"), ("score", "double"), ("n_bytes", "long"))])
    base = F.col("base_score") if n_train else F.lit(None).cast("double")
    return both.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(n_train).cast("long").alias("train_tokens"), base.alias("base_score"), "score", "n_bytes", (-F.col("score") * F.lit(float(np.log2(10))) / F.col("n_bytes")).alias("bits_per_byte"))


def op6_ctw_score(spark, sf_dir: str) -> DataFrame:
    return score_documents(common.read_table(spark, sf_dir, "documents"))


QUERIES = {"op6_ctw_score": op6_ctw_score}

"""Near-duplicates at a Jaccard similarity of word shingles: links of SimHash's trie self-join, and a prefix join of shingle sets for the pairs whose fingerprints lie further apart, all confirmed on the whole sets."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, simhash

#: Differing bits up to which the trie links fingerprints. Pairs at 0.8 need 14 of 64, where a trie drops next to nothing; the prefix join finds those.
TRIE_BITS = 3

#: Sets whose shingles are counted to find common ones, and common ones that are told apart: they set the order of shingles, so bounds of work and not of what is found.
SAMPLE_SETS, MAX_COMMON = 20_000, 100_000
#: Sets that share a prefix shingle are all compared at once up to so many; from more, sets linked already are left out first.
SMALL = 32
#: Pairs are confirmed in passes of at most so many, or twice as many as there are texts in them: a bound of the disk that a pass takes.
PASS_PAIRS = 1 << 15
#: Bits of a set's sketch, and of the filter by which sets of no pair stay out of a shuffle.
SKETCH, FILTER = 512, 24


def shingle_set(text: str | None, shingle_words: int = 5) -> np.ndarray:
    """The distinct values of simhash.shingle_hashes, sorted."""
    return np.unique(np.array(simhash.shingle_hashes(text, shingle_words), np.uint64))


def sketch(s: np.ndarray) -> bytes:
    """Parities of the set's shingles by their value modulo SKETCH: two sets differ in as many shingles as their sketches do in bits, or more."""
    return np.packbits((np.bincount((s % np.uint64(SKETCH)).astype(np.int64), minlength=SKETCH) & 1).astype(np.uint8)).tobytes()


def prefix(s: np.ndarray, common_ones: np.ndarray, counts: np.ndarray, least: float) -> np.ndarray:
    """The first n - ceil(least * n) + 1 shingles of a set, rare ones first: sets at `least` or more share one of them."""
    if len(common_ones):
        at = np.minimum(np.searchsorted(common_ones, s), len(common_ones) - 1)
        s = s[np.lexsort((s, np.where(common_ones[at] == s, counts[at], 0)))]
    return s[: len(s) - int(np.ceil(least * len(s) - 1e-9)) + 1]


def shingle_sets(docs: DataFrame, shingle_words: int, least: float, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, sid, th, n, fp, sketch, prefix) of every row with an id: sid is the XXH64 of the set of n shingles, th that of the text, fp the fingerprint."""
    held = docs.sparkSession.sparkContext.broadcast(common_shingles(docs, shingle_words, text_col))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in common.pieces(batches):
            hashes = [np.array(simhash.shingle_hashes(t.as_py(), shingle_words), np.uint64) for t in b.column("text")]
            sets = [np.unique(h) for h in hashes]
            cols = [pa.array(np.array([xxhash.xxh64_intdigest(s.tobytes()) for s in sets], np.uint64).view(np.int64)), b.column("th"), pa.array([len(s) for s in sets], pa.int32()), pa.array([simhash.majority(h) for h in hashes], pa.int64())]
            cols += [pa.array([sketch(s) for s in sets], pa.binary()), pa.array([prefix(s, *held.value, least).tobytes() for s in sets], pa.binary())]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *cols], names=["doc_id", "sid", "th", "n", "fp", "sketch", "prefix"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("th"), F.col(text_col).alias("text")).where("doc_id IS NOT NULL")
    return rows.mapInArrow(run, "doc_id long, sid long, th long, n int, fp long, sketch binary, prefix binary")


def common_shingles(docs: DataFrame, shingle_words: int, text_col: str) -> tuple[np.ndarray, np.ndarray]:
    """Shingles of at least five sampled texts, sorted, and their counts."""
    every = max(1, docs.count() // SAMPLE_SETS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in common.pieces(batches):
            for t in b.column("text"):
                yield pa.RecordBatch.from_arrays([pa.array(shingle_set(t.as_py(), shingle_words).view(np.int64))], names=["h"])

    sample = docs.select(F.col(text_col).alias("text")).where(F.pmod(F.xxhash64("text"), F.lit(every)) == 0).where("text IS NOT NULL")
    # Of a text that many rows have, one: its shingles count once.
    sample = sample.groupBy(F.xxhash64("text").alias("th")).agg(F.first("text").alias("text")).select("text") if every > 1 else sample.distinct()
    got = sample.mapInArrow(run, "h long").groupBy("h").count().where("count >= 5").orderBy(F.desc("count"), "h").limit(MAX_COMMON).toArrow()
    h, c = got.column("h").to_numpy().view(np.uint64), got.column("count").to_numpy()
    order = np.argsort(h)
    return h[order], c[order]


def prefixes(sets: DataFrame) -> DataFrame:
    """(token, sid, n, pos) of each shingle of the prefixes of the distinct sets; a set comes once from each task that has it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for b in common.pieces(batches, 1024):
            new = [(i, t.as_buffer(), n) for i, t, n in zip(b.column("sid").to_pylist(), b.column("prefix"), b.column("n").to_pylist()) if n and i not in seen and not seen.add(i)]
            if new:
                size = np.array([len(t) // 8 for _, t, _ in new])
                token = np.frombuffer(b"".join(t for _, t, _ in new), np.int64)
                pos = np.arange(len(token), dtype=np.int32) - np.repeat(np.cumsum(size) - size, size).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(token), pa.array(np.repeat([i for i, *_ in new], size)), pa.array(np.repeat([n for *_, n in new], size).astype(np.int32)), pa.array(pos)], names=["token", "sid", "n", "pos"])

    return sets.select("sid", "n", "prefix").mapInArrow(run, "token long, sid long, n int, pos int")


def distinct_sets(sets: DataFrame) -> DataFrame:
    """A row a set: (sid, n, fp, sketch, th, m, low), m the number of its rows and low their smallest id."""
    return sets.groupBy("sid").agg(*[F.first(c).alias(c) for c in ("n", "fp", "sketch")], F.min("th").alias("th"), F.count("*").alias("m"), F.min("doc_id").alias("low"))


def trie_pairs(sets: DataFrame, budget: int = TRIE_BITS) -> DataFrame:
    """(a, b) pairs of sets that the trie self-join of fingerprints links: one set of each two fingerprints, and each set with the first of its fingerprint."""
    one = sets.where("n > 0").select("sid", "fp")
    f = common.written(one.groupBy("fp").agg(F.min("sid").alias("rep")), "fingerprints")
    links = simhash.near_links(f.select("fp"), budget)
    far = links.join(f.toDF("a", "x"), "a").join(f.toDF("b", "y"), "b").select("x", "y")
    same = one.join(f, "fp").where("sid <> rep").select(F.col("rep").alias("x"), F.col("sid").alias("y"))
    return far.unionAll(same).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))


def bucket_pairs(token: np.ndarray, sid: np.ndarray, n: np.ndarray, pos: np.ndarray, group: np.ndarray, least: float, large: bool, small: int = SMALL, chunk: int = 1 << 17, sketches: np.ndarray | None = None, nearest: bool = False) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of sets with a common token that are of different groups and, by their sizes and the token's positions, can be at `least` or more.

    All pairs within tokens of at most `small` sets; of larger ones, all pairs if large, else each set with the next and
    with the first. Pairs that given sketches rule out are left out; nearest: of what is left each set's pair of the
    least differing sketches alone, so no more pairs than sets.
    """
    order = np.lexsort((sid, n, group, token))
    order = order[np.concatenate([[True], (token[order][1:] != token[order][:-1]) | (sid[order][1:] != sid[order][:-1])])] if len(order) else order
    token, sid, n, pos, group = (x[order] for x in (token, sid, n, pos, group))
    sketches = None if sketches is None else sketches[order]
    closest = np.full(len(token), np.iinfo(np.int64).max)
    if not len(token):
        return
    starts = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]]))
    size = np.diff(np.append(starts, len(token)))
    first, end, many = np.repeat(starts, size), np.repeat(starts + size, size), np.repeat(size > small, size)
    runs = np.flatnonzero(np.concatenate([[True], (token[1:] != token[:-1]) | (group[1:] != group[:-1])]))
    after = np.repeat(np.append(runs[1:], len(token)), np.diff(np.append(runs, len(token))))  # where the next group of the token begins
    at = np.arange(len(token))
    if large:
        spans = [(at, after, end)]
    else:
        few, rest = at[~many], at[many]
        spans = [(few, after[few], end[few]), (rest, rest + 1, np.minimum(rest + 2, end[rest])), (first[rest], rest, rest + (rest > first[rest]))]
    for a, low, high in spans:
        each = np.maximum(high - low, 0)
        total = np.cumsum(each)
        i = 0
        while i < len(a):
            j = max(i + 1, int(np.searchsorted(total, (total[i - 1] if i else 0) + chunk, side="right")))
            e = each[i:j]
            x = np.repeat(a[i:j], e)
            y = np.repeat(low[i:j], e) + np.arange(len(x)) - np.repeat(np.cumsum(e) - e, e)
            short, long = np.minimum(n[x], n[y]), np.maximum(n[x], n[y])
            shared = np.minimum(n[x] - pos[x], n[y] - pos[y])  # at most, if the token is the first shared one
            ok = (short >= least * long - 1e-9) & (shared >= least / (1 + least) * (short + long) - 1e-9) & (group[x] != group[y])
            x, y = x[ok], y[ok]
            if sketches is not None:
                apart = np.bitwise_count(sketches[x] ^ sketches[y]).sum(1, dtype=np.int64)
                ok = apart <= (1 - least) / (1 + least) * (n[x] + n[y]) + 1e-6
                x, y, apart = x[ok], y[ok], apart[ok]
                if nearest:
                    np.minimum.at(closest, x, apart * len(token) + y)
                    np.minimum.at(closest, y, apart * len(token) + x)
            if not nearest:
                yield np.minimum(sid[x], sid[y]), np.maximum(sid[x], sid[y])
            i = j
    if nearest:
        x = np.flatnonzero(closest != np.iinfo(np.int64).max)
        y = closest[x] % len(token)
        yield np.minimum(sid[x], sid[y]), np.maximum(sid[x], sid[y])


def candidates(rows: DataFrame, least: float, large: bool = False, nearest: bool = False) -> DataFrame:
    """(a, b) distinct pairs of bucket_pairs over rows (token, sid, n, pos, grp and, if large, sketch) of which a task has all those of a token."""
    small = SMALL

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got, marks = [], []
        for b in batches:
            if b.num_rows:
                got.append([b.column(c).to_numpy() for c in ("token", "sid", "n", "pos", "grp")])
                if large:
                    marks.append(np.frombuffer(b"".join(b.column("sketch").to_pylist()), np.uint64).reshape(b.num_rows, -1))
        if not got:
            return
        kept: list[np.ndarray] = []
        for a, b in bucket_pairs(*(np.concatenate(x) for x in zip(*got, strict=True)), least, large, small, sketches=np.concatenate(marks) if large else None, nearest=nearest):
            kept.append(np.unique(np.stack([a, b], 1), axis=0))
            if sum(map(len, kept)) > 1 << 19:
                kept = [np.unique(np.concatenate(kept), axis=0)]
                if len(kept[0]) > 1 << 18:
                    yield pa.RecordBatch.from_arrays([pa.array(kept[0][:, 0]), pa.array(kept[0][:, 1])], names=["a", "b"])
                    kept = []
        if kept:
            kept = [np.unique(np.concatenate(kept), axis=0)]
            yield pa.RecordBatch.from_arrays([pa.array(kept[0][:, 0]), pa.array(kept[0][:, 1])], names=["a", "b"])

    return rows.repartition("token").mapInArrow(run, "a long, b long").distinct()


def similar(pairs: DataFrame, sets: DataFrame, docs: DataFrame, shingle_words: int, least: float, text_col: str) -> DataFrame:
    """Those of the pairs (a, b) of sets whose Jaccard similarity is `least` or more, from the whole sets; pairs that their sketches rule out are left out before.

    sets: as distinct_sets has them. The whole sets are made again where a pair's texts meet, as a text takes a fraction of
    its set's room; texts of documents without a pair stay where they are.
    """
    slim = sets.select("sid", "n", "sketch")
    sides = pairs.join(slim.toDF("a", "na", "ka"), "a").join(slim.toDF("b", "nb", "kb"), "b")

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in common.pieces(batches, 4096):
            if b.num_rows:
                x, y = (np.frombuffer(b"".join(b.column(c).to_pylist()), np.uint64).reshape(b.num_rows, -1) for c in ("ka", "kb"))
                apart = np.bitwise_count(x ^ y).sum(1, dtype=np.int64)  # sets at `least` differ in (1 - least) / (1 + least) of their sizes' sum at most
                ok = apart <= (1 - least) / (1 + least) * (b.column("na").to_numpy() + b.column("nb").to_numpy()) + 1e-6
                yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b")], names=["a", "b"]).filter(pa.array(ok))

    pairs = common.written(sides.mapInArrow(near, "a long, b long").distinct(), "pairs")
    common.collected(sets.sparkSession)
    nodes = pairs.select(F.col("a").alias("sid")).unionAll(pairs.select(F.col("b").alias("sid"))).distinct()
    named = sets.join(nodes, "sid", "left_semi").select("sid", "th")
    top = F.shiftrightunsigned("th", 64 - FILTER).cast("int")
    bits = np.zeros(1 << (FILTER - 3), np.uint8)
    for c in named.select(top.alias("p")).distinct().toArrow().column("p").chunks:
        np.bitwise_or.at(bits, c.to_numpy() >> 3, (128 >> (c.to_numpy() & 7)).astype(np.uint8))
    held = sets.sparkSession.sparkContext.broadcast(bits)

    def paired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for b in common.pieces(batches):
            at = (b.column("th").to_numpy().view(np.uint64) >> np.uint64(64 - FILTER)).astype(np.int64)
            b = b.filter(pa.array((held.value[at >> 3] >> (7 - (at & 7))) & 1 == 1))
            yield b.filter(pa.array([h not in seen and not seen.add(h) for h in b.column("th").to_pylist()], pa.bool_()))

    some = docs.select(F.xxhash64(text_col).alias("th"), F.col(text_col).alias("text")).where("text IS NOT NULL").mapInArrow(paired, "th long, text string")
    known = common.written(some.join(named, "th").groupBy("th", "sid").agg(F.first("text").alias("text")).drop("th"), "pair-texts")
    common.collected(sets.sparkSession)
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = RecentSets(shingle_words)
        for b in common.pieces(batches):
            ok = []
            for i, j, x, y in zip(b.column("a").to_pylist(), b.column("b").to_pylist(), b.column("x"), b.column("y"), strict=True):
                x, y = made.of(i, x), made.of(j, y)
                both = np.sort(np.concatenate([x, y]))
                shared = int((both[1:] == both[:-1]).sum())
                ok.append(shared >= least * (len(x) + len(y) - shared) - 1e-9)
            yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b")], names=["a", "b"]).filter(pa.array(ok, pa.bool_()))

    total, out = pairs.count(), None
    passes = -(-total // max(PASS_PAIRS, 2 * known.count())) or 1  # a text goes along with each of its pairs
    for i in range(passes):
        some = pairs.where(F.pmod(F.xxhash64("a", "b"), F.lit(passes)) == i) if passes > 1 else pairs
        both = some.join(known.toDF("a", "x"), "a").join(known.toDF("b", "y"), "b").select("a", "b", "x", "y")
        near_ones = common.written(both.mapInArrow(run, "a long, b long"), "similar")
        out = near_ones if out is None else out.unionAll(near_ones)
        common.collected(sets.sparkSession)
    common.dropped(known)
    common.dropped(pairs)
    return out


class RecentSets:
    """Shingle sets by their sid, made once as long as no more than `most` shingles are held."""

    def __init__(self, shingle_words: int, most: int = 1 << 21):
        self.shingle_words, self.most, self.held, self.known = shingle_words, most, 0, {}

    def of(self, sid: int, text: pa.Scalar) -> np.ndarray:
        if sid not in self.known:
            s = shingle_set(text.as_py(), self.shingle_words)
            if self.held + len(s) > self.most:
                self.held, self.known = 0, {}
            self.held += len(s)
            self.known[sid] = s
        return self.known[sid]


def near_duplicates(docs: DataFrame, shingle_words: int = 5, least: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, component_id) of every row with an id: the smallest doc_id reachable by links of Jaccard similarity `least` or more.

    Every such pair is found. Equal sets are one, texts without words among them. The trie self-join of 64-bit
    fingerprints links near copies at up to TRIE_BITS differing bits; a prefix join proposes the other pairs: a set's prefix goes to
    one task a shingle. All pairs are confirmed on the whole sets. Where many sets share a shingle, a first
    round takes each with the next and the first, a second each with the nearest of another component by its sketch, and a
    third all that are of different components still and that sketches don't rule out, so that a group of near
    copies doesn't return the square of its size in pairs.
    """
    sets = common.written(shingle_sets(docs, shingle_words, least, id_col, text_col), "shingle-sets")
    rows = common.written(prefixes(sets).repartition("token").mapInArrow(shared_tokens, "token long, sid long, n int, pos int, size int"), "prefixes")
    common.collected(docs.sparkSession)
    each = common.written(distinct_sets(sets), "distinct-sets")
    of_rows = common.written(sets.select("doc_id", "sid"), "set-names")
    common.dropped(sets)  # with the prefixes, the largest table here
    common.collected(docs.sparkSession)
    proposed = candidates(rows.select("token", "sid", "n", "pos", F.col("sid").alias("grp")), least).unionByName(trie_pairs(each))
    links = similar(proposed, each, docs, shingle_words, least, text_col)
    comp = common.written(common.components(links), "components")
    many = rows.where(F.col("size") > SMALL)
    if many.limit(1).count():
        many = common.written(many.join(each.select("sid", "sketch"), "sid").select("token", "sid", "n", "pos", "sketch"), "large-prefixes")
        for nearest in (True, False):
            named = many.join(comp, many.sid == comp.node, "left").select("token", "sid", "n", "pos", "sketch", F.coalesce("component", "sid").alias("grp"))
            more = similar(candidates(named, least, large=True, nearest=nearest), each, docs, shingle_words, least, text_col)
            if more.limit(1).count():
                links = links.unionAll(more)
                comp = common.written(common.components(links), "components")
        common.dropped(many)
    total = of_rows.count()
    known = each.join(comp, F.col("sid") == F.col("node"), "left").select("sid", "m", "low", F.coalesce("component", "sid").alias("component"))
    lowest = known.groupBy("component").agg(F.min("low").alias("component_id"))
    known = common.written(known.join(lowest, "component").select("sid", "component_id", (F.col("m") > total * common.HOT_SHARE).alias("hot")), "named-sets")
    out = common.written(common.left_joined(of_rows, known, ["sid"], "hot").select("doc_id", "component_id"), "near-duplicates")
    for t in (of_rows, each, rows):
        common.dropped(t)
    common.collected(docs.sparkSession)
    return out


def shared_tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows whose token two sets or more have, with the number of those sets; the task has all rows of its tokens."""
    got = [[b.column(c).to_numpy() for c in ("token", "sid", "n", "pos")] for b in batches if b.num_rows]
    if not got:
        return
    token, sid, n, pos = (np.concatenate(x) for x in zip(*got, strict=True))
    order = np.lexsort((sid, token))
    order = order[np.concatenate([[True], (token[order][1:] != token[order][:-1]) | (sid[order][1:] != sid[order][:-1])])]
    token = token[order]
    starts = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]]))
    each = np.diff(np.append(starts, len(token)))
    size = np.repeat(each, each).astype(np.int32)
    at = size > 1
    yield pa.RecordBatch.from_arrays([pa.array(token[at]), pa.array(sid[order][at]), pa.array(n[order][at]), pa.array(pos[order][at]), pa.array(size[at])], names=["token", "sid", "n", "pos", "size"])


def drop_near_duplicates(docs: DataFrame, shingle_words: int = 5, least: float = 0.8) -> DataFrame:
    """The first of each component of near_duplicates, as simhash.first_of_components has it."""
    return simhash.first_of_components(docs, near_duplicates(docs, shingle_words, least))

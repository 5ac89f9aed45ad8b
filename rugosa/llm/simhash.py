"""SimHash near-duplicates: a binary trie of fingerprints joined with itself under a Hamming error budget."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

TOP_BITS = 16


def shingle_hashes(text: str | None, shingle_words: int = 3, seed: int = 42) -> list[int]:
    """XXH64 of each shingle, repeats included.

    A-Z is lower-cased; words are runs of anything but the six ASCII white-space characters. Fewer words than a
    shingle has: the whole sequence is the one shingle. No words, or a null text: none.
    """
    words = (text or "").encode().lower().split()
    n, k, hashed = len(words), shingle_words, xxhash.xxh64_intdigest
    joined = b" ".join(words)
    if n <= k:
        return [hashed(joined, seed)] if n else []
    length = np.fromiter(map(len, words), np.int64, n) + 1
    ends = np.cumsum(length) - 1
    starts = (ends - length + 1)[: n - k + 1].tolist()
    return [hashed(joined[a:b], seed) for a, b in zip(starts, ends[k - 1 :].tolist(), strict=True)]


def fingerprint(text: str | None, shingle_words: int = 3, seed: int = 42) -> int:
    """64 bits as a signed integer: each is 1 if set in over half the values of shingle_hashes. No words, or a null text: zero."""
    return majority(np.array(shingle_hashes(text, shingle_words, seed), np.uint64))


def majority(h: np.ndarray) -> int:
    """The fingerprint of these hashes; of none: zero."""
    if not len(h):
        return 0
    # Counts by bit: sums of 255 rows of ones fit in a byte.
    rows = np.zeros((-(-len(h) // 255) * 255, 8), np.uint8)
    rows[: len(h)] = h.astype("<u8").view(np.uint8).reshape(-1, 8)
    bits = np.unpackbits(rows, axis=1, bitorder="little").reshape(-1, 255, 64)
    count = np.add.reduce(bits, axis=1, dtype=np.uint8).sum(0, dtype=np.int64)
    return int(np.packbits(count * 2 > len(h), bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, shingle_words: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp long) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([fingerprint(t.as_py(), shingle_words) for t in b.column("text")], pa.int64())], names=["doc_id", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, fp long")


def trie_cut(prefixes: np.ndarray, counts: np.ndarray, most: int, bits: int = TOP_BITS) -> list[tuple[int, int]]:
    """Nodes (depth, value of the first depth bits) that cut the trie: each holds at most `most` fingerprints or is at depth `bits`."""
    full = np.zeros((1 << bits) + 1, np.int64)
    full[prefixes + 1] = counts
    before, out, stack = np.cumsum(full), [], [(0, 0)]
    while stack:
        d, v = stack.pop()
        n = before[(v + 1) << (bits - d)] - before[v << (bits - d)]
        if n and (n <= most or d == bits):
            out.append((d, v))
        elif n:
            stack += [(d + 1, 2 * v + 1), (d + 1, 2 * v)]
    return out


def node_pairs(cut: list[tuple[int, int]], budget: int) -> list[tuple[int, int]]:
    """Pairs of the cut's nodes (by place) that can hold fingerprints within the budget: the joint traversal of the trie's upper part."""
    place = {node: i for i, node in enumerate(cut)}
    inner = {(d - k, v >> k) for d, v in cut for k in range(1, d + 1)}
    out, stack = [], [((0, 0), (0, 0), 0)]

    def below(node):
        return [node] if node in place else [c for b in (0, 1) if (c := (node[0] + 1, 2 * node[1] + b)) in place or c in inner]

    while stack:
        a, b, used = stack.pop()
        if a in place and b in place:
            out.append((place[a], place[b]))
            continue
        for x in below(a):
            for y in below(b):
                if a == b and x > y:
                    continue
                deep = min(x[0], y[0])
                was = min(a[0], b[0])
                now = used
                if deep > was:
                    d = (x[1] >> (x[0] - deep)) ^ (y[1] >> (y[0] - deep))
                    now = used + (d & ((1 << (deep - was)) - 1)).bit_count()
                if now <= budget:
                    stack.append((x, y, now))
    return sorted(set(out))


def joined_tries(x: np.ndarray, y: np.ndarray | None, budget: int, block: int = 8, chunk: int = 1 << 20) -> tuple[np.ndarray, np.ndarray]:
    """Links between two sorted arrays of distinct fingerprints (unsigned), or within one: a spanning forest of them.

    Places are those in x and then y. Node pairs are traversed together from the first bit; each step
    splits both nodes by one bit, adds a differing bit to the pair's error and drops pairs over the budget.
    Pairs of small nodes are compared outright. Pairs whose leaves are one component already are dropped too,
    so dense groups of near copies don't cost the square of their size.
    """
    both = x if y is None else np.concatenate([x, y])
    n, nx = len(both), len(x)
    lab = np.arange(n)
    zeros = {}

    def ones_before(bit):
        if bit not in zeros:
            if len(zeros) > 4:
                zeros.clear()
            zeros[bit] = np.concatenate([[0], np.cumsum((both >> np.uint64(bit)) & np.uint64(1), dtype=np.int64)])
        return zeros[bit]

    near = np.arange(nx - 1) if y is None else np.empty(0, np.int64)
    near = near[np.bitwise_count(both[near] ^ both[near + 1]) <= budget] if len(near) else near
    lab = common.groups_of(lab, near, near + 1)
    first = (np.array([0]), np.array([nx]), np.array([0 if y is None else nx]), np.array([nx if y is None else n]), np.array([0]))
    stack = [(63, *first)]
    while stack:
        bit, al, ah, bl, bh, used = stack.pop()
        changes = np.concatenate([[0], np.cumsum(lab[1:] != lab[:-1], dtype=np.int64)])
        one = (changes[ah - 1] == changes[al]) & (changes[bh - 1] == changes[bl]) & (lab[al] == lab[bl])
        small = ((ah - al) * (bh - bl) <= block * block) | (bit < 0)
        go, end = ~one & ~small, np.flatnonzero(~one & small)
        for i in range(0, len(end), chunk // 32):
            at = end[i : i + chunk // 32]
            w = bh[at] - bl[at]
            each = (ah[at] - al[at]) * w
            of = np.repeat(np.arange(len(at)), each)
            k = np.arange(len(of)) - np.repeat(np.cumsum(each) - each, each)
            p, q = al[at][of] + k // w[of], bl[at][of] + k % w[of]
            hit = (np.bitwise_count(both[p] ^ both[q]) <= budget) & (p != q)
            if hit.any():
                lab = common.groups_of(lab, p[hit], q[hit])
        if not go.any():
            continue
        al, ah, bl, bh, used = al[go], ah[go], bl[go], bh[go], used[go]
        c = ones_before(bit)
        am, bm = ah - (c[ah] - c[al]), bh - (c[bh] - c[bl])
        same = (al == bl) & (ah == bh)
        parts = [(al, am, bl, bm, used), (am, ah, bm, bh, used), (al, am, bm, bh, used + 1)]
        cross = ~same
        parts.append((am[cross], ah[cross], bl[cross], bm[cross], used[cross] + 1))
        al, ah, bl, bh, used = (np.concatenate(z) for z in zip(*parts, strict=True))
        ok = (ah > al) & (bh > bl) & (used <= budget)
        nxt = [z[ok] for z in (al, ah, bl, bh, used)]
        for i in range(0, len(nxt[0]), chunk):
            stack.append((bit - 1, *(z[i : i + chunk] for z in nxt)))
    at = np.flatnonzero(lab != np.arange(n))
    return at, lab[at]


def near_links(fps: DataFrame, budget: int = 3, most: int | None = None) -> DataFrame:
    """(a long, b long) links between fingerprints, given as rows (fp long) that are distinct.

    The counts of the first 16 bits (65,536 at most) go to the driver, which cuts the trie there into
    nodes and lists the node pairs within the budget; each fingerprint then goes to the pairs of its node, and a task
    joins one pair. What returns is a spanning forest of each pair's links, which has the components of them all.
    """
    spark = fps.sparkSession
    got = fps.groupBy(F.shiftrightunsigned("fp", 64 - TOP_BITS).cast("int").alias("p")).count().toArrow()
    prefixes, counts = got.column("p").to_numpy().astype(np.int64), got.column("count").to_numpy()
    total = int(counts.sum()) if len(counts) else 0
    most = most or min(4_000_000, max(64, total // 24))  # about 32 nodes at any size, until they get too large for a task
    cut = sorted(trie_cut(prefixes, counts, most), key=lambda n: n[1] << (TOP_BITS - n[0]))
    pairs = node_pairs(cut, budget)
    by: list[list[tuple[int, int]]] = [[] for _ in cut]
    for k, (a, b) in enumerate(pairs):
        by[a].append((k, 0))
        if a != b:
            by[b].append((k, 1))
    starts = np.array([v << (TOP_BITS - d) for d, v in cut], np.int64)
    lists = [(np.array([k for k, _ in z], np.int32), np.array([s for _, s in z], np.int8)) for z in by]
    self_pair = np.array([a == b for a, b in pairs], bool)
    held = spark.sparkContext.broadcast((starts, lists, self_pair))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        starts, lists, _ = held.value
        for b in common.pieces(batches, 4096):
            fp = b.column("fp").to_numpy()
            node = np.searchsorted(starts, (fp.view(np.uint64) >> np.uint64(64 - TOP_BITS)).astype(np.int64), side="right") - 1
            at = np.repeat(np.arange(len(fp)), [len(lists[i][0]) for i in node])
            keys = np.concatenate([lists[i][0] for i in node]) if len(node) else np.empty(0, np.int32)
            side = np.concatenate([lists[i][1] for i in node]) if len(node) else np.empty(0, np.int8)
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(side), pa.array(fp[at])], names=["pair", "side", "fp"])

    def join(table: pa.Table) -> pa.Table:
        fp, side = table.column("fp").to_numpy().view(np.uint64), table.column("side").to_numpy()
        nx = int((side == 0).sum())
        fp = fp[np.lexsort((fp, side))]
        alone = bool(held.value[2][table.column("pair")[0].as_py()])
        if not alone and (nx == 0 or nx == len(fp)):
            a = b = np.empty(0, np.int64)
        else:
            a, b = joined_tries(fp[:nx], None if alone else fp[nx:], budget)
        return pa.table({"a": pa.array(fp[a].view(np.int64)), "b": pa.array(fp[b].view(np.int64))})

    dealt = fps.select("fp").mapInArrow(deal, "pair int, side byte, fp long")
    return dealt.groupBy("pair").applyInArrow(join, "a long, b long")


def near_duplicates(docs: DataFrame, shingle_words: int = 3, budget: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp long, component_id) of every row: the smallest doc_id reachable by links of at most `budget` differing bits.

    Rows of one id are kept, each with its own fingerprint; a row whose id is null links with nothing and has a
    null component. Null and empty texts have fingerprint zero and link as any other. An empty table gives no rows.
    """
    t = common.written(fingerprints(docs, shingle_words, id_col, text_col), "fingerprints")
    f = common.written(t.where("doc_id IS NOT NULL").groupBy("fp").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n")), "distinct-fingerprints")
    total = f.agg(F.sum("n")).first()[0] or 0
    comp = common.components(near_links(f.select("fp"), budget))
    linked = comp.join(f, comp.node == f.fp).select("fp", "component", "rep")
    lowest = linked.groupBy("component").agg(F.min("rep").alias("lowest"))
    named = f.join(linked.join(lowest, "component").select("fp", "lowest"), "fp", "left")
    named = common.written(named.select("fp", F.coalesce("lowest", "rep").alias("component_id"), (F.col("n") > total * common.HOT_SHARE).alias("hot")), "named-fingerprints")
    known = common.left_joined(t.where("doc_id IS NOT NULL"), named, ["fp"], "hot").select("doc_id", "fp", "component_id")
    return known.unionByName(t.where("doc_id IS NULL").select("doc_id", "fp", F.lit(None).cast("long").alias("component_id")))


def first_of_components(docs: DataFrame, near: DataFrame) -> DataFrame:
    """The rows of docs, with all their columns, that stay: of each component one row of its smallest doc_id.

    Rows without an id are kept. Of several rows of the staying id the first in the input stays.
    """
    row, stays = common.fresh(docs, "row"), common.fresh(docs, "stays")
    rows = docs.withColumn(row, F.monotonically_increasing_id())
    stay = near.where("doc_id = component_id").select(F.col("doc_id").alias(stays)).distinct()
    slim = rows.select("doc_id", row).join(stay, F.col("doc_id") == F.col(stays), "left_semi")
    one = slim.groupBy("doc_id").agg(F.min(row).alias(row)).select(row)
    return rows.join(one, row, "left_semi").select(*docs.columns).unionByName(docs.where("doc_id IS NULL"))


def drop_near_duplicates(docs: DataFrame, shingle_words: int = 5, budget: int = 5) -> DataFrame:
    """The first of each component of near_duplicates, as first_of_components has it."""
    return first_of_components(docs, near_duplicates(docs, shingle_words, budget))


def op4_simhash(spark, sf_dir: str) -> DataFrame:
    near = near_duplicates(common.read_table(spark, sf_dir, "documents"))
    return near.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


QUERIES = {"op4_simhash": op4_simhash}

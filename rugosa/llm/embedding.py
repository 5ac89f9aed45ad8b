"""Embedding near-duplicates by int8 tile products with error bounds, and exact top-k by a Voronoi join."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

#: Vectors of a tile and of a cell's block: what a task holds of either side.
TILE, QUERY_BLOCK = 8192, 4096
#: Pairs of a block of a cell and a group of queries up to which their list is broadcast; more are joined by a shuffle.
MAX_NEEDS = 500_000


def usable(vec: str):
    """A vector that is not null or empty, without null or non-finite components."""
    v = F.col(vec)
    return v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))


def stacked(column: pa.ChunkedArray) -> np.ndarray:
    """Vectors of one length as the rows of a matrix."""
    if not len(column):
        return np.empty((0, 0))
    flat = pa.chunked_array([c.flatten() for c in column.chunks]).to_numpy() if column.num_chunks else np.empty(0)
    return np.asarray(flat, np.float64).reshape(len(column), -1)


def unit(x: np.ndarray) -> np.ndarray:
    """Rows over their norms, the largest component taken out first so that no square overflows or vanishes."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


class Quantised:
    """u ~ scale * q with integers |q| <= 127; error: the norm of what is left; norm: that of scale * q."""

    def __init__(self, u: np.ndarray):
        self.u = u
        self.scale = np.abs(u).max(axis=1) / 127
        q = np.rint(u / self.scale[:, None])
        back = q * self.scale[:, None]
        d = u - back
        self.error = np.sqrt((d * d).sum(1)) * (1 + 1e-9) + 1e-12
        self.norm = np.sqrt((back * back).sum(1)) * (1 + 1e-9)
        # float32 adds integers exactly below 2^24: 127 * 127 * 1040.
        self.q = q.astype(np.float32 if u.shape[1] <= 1040 else np.float64)


def linked(x: Quantised, y: Quantised, least: float, same: bool, rows: int = 1024) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (i, j) with cosine >= least, i < j if both are the same vectors.

    |u.v - s t q.r| <= error_u * norm_v + error_v: pairs below least by more than that are dropped, the rest
    are computed again in double precision.
    """
    for i in range(0, len(x.u), rows):
        k = slice(i, min(i + rows, len(x.u)))
        j0 = i if same else 0
        dots = (x.q[k] @ y.q[j0:].T).astype(np.float64)
        bound = dots * x.scale[k, None] * y.scale[None, j0:] + x.error[k, None] * y.norm[None, j0:] + y.error[None, j0:] + 1e-12
        a, b = np.nonzero(bound >= least)
        if same:
            up = a < b
            a, b = a[up], b[up]
        a, b = a + i, b + j0
        for c in range(0, len(a), 200_000):
            p, q = a[c : c + 200_000], b[c : c + 200_000]
            hit = np.einsum("ij,ij->i", x.u[p], y.u[q]) >= least
            if hit.any():
                yield p[hit], q[hit]


def near_duplicates(vectors: DataFrame, least: float = 0.98, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", tile: int = TILE) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row; only vectors of one label and length are compared.

    Rows with equal labels and components are one vector with a count, so copies are never paired with each
    other. The vectors of a label are dealt into tiles; each pair of tiles is a task, which returns the number
    of links of each vector and a spanning forest of the links. A null label, a null, empty or zero vector,
    or one with null or non-finite components has no links. Each row counts, also if it repeats a vec_id.
    """
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).alias("v"), F.col(label_col).alias("label"))
    good = rows.where(F.col("label").isNotNull() & F.col("vec_id").isNotNull() & usable("v") & F.exists("v", lambda x: x != 0))
    g = good.groupBy("label", "v").agg(F.count("*").alias("m"), F.min("vec_id").alias("low"))
    g = common.written(g.withColumn("key", F.monotonically_increasing_id()).withColumn("dim", F.size("v")), "distinct-vectors")
    tiles = g.groupBy("label", "dim").agg(F.ceil(F.count("*") / tile).cast("int").alias("tiles"))
    at = g.join(tiles, ["label", "dim"]).withColumn("t", F.pmod(F.xxhash64("key"), F.col("tiles")).cast("int"))
    at = at.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    at = at.select("label", "dim", F.least("t", "o").alias("i"), F.greatest("t", "o").alias("j"), (F.col("t") > F.col("o")).alias("second"), "key", "m", "v")

    def run(table: pa.Table) -> pa.Table:
        second = table.column("second").to_numpy()
        key, m = table.column("key").to_numpy(), table.column("m").to_numpy()
        u = unit(stacked(table.column("v")))
        same = table.column("i")[0].as_py() == table.column("j")[0].as_py()
        pick = np.concatenate([np.flatnonzero(~second), np.flatnonzero(second)])
        key, m, u, n = key[pick], m[pick], u[pick], int((~second).sum())
        count, lab = np.zeros(len(key), np.int64), np.arange(len(key))
        x = Quantised(u[:n]) if n else None
        y = x if same else Quantised(u[n:]) if n < len(u) else None
        if x is not None and y is not None:
            for a, b in linked(x, y, least, same):
                b = b if same else b + n
                np.add.at(count, a, m[b])
                np.add.at(count, b, m[a])
                lab = common.groups_of(lab, a, b)
        a, b = common.star_edges(key, lab)
        c = np.flatnonzero(count)
        return pa.table({"a": pa.array(np.concatenate([a, key[c]])), "b": pa.array([*b.tolist(), *[None] * len(c)], pa.int64()), "n": pa.array(np.concatenate([np.zeros(len(a), np.int64), count[c]]))})

    found = common.written(at.groupBy("label", "dim", "i", "j").applyInArrow(run, "a long, b long, n long"), "vector-links")
    links = found.where("b IS NULL").groupBy(F.col("a").alias("key")).agg(F.sum("n").alias("n"))
    comp = common.components(found.where("b IS NOT NULL").select("a", "b"))
    part = g.join(comp, g.key == comp.node, "left").select("label", "v", "m", "low", "key", F.coalesce("component", "key").alias("component"))
    low = part.groupBy("component").agg(F.min("low").alias("component_id"))
    known = part.join(low, "component").join(links, "key", "left").select("label", "v", "component_id", (F.coalesce("n", F.lit(0)) + F.col("m") - 1).alias("n_links"))
    out = rows.join(known, ["label", "v"], "left").select("vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.when(F.col("vec_id").isNotNull(), F.coalesce("component_id", "vec_id")).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


# --- top-k -----------------------------------------------------------------------------------------


def pivots_of(sample: np.ndarray, most: int, rounds: int = 5, seed: int = 3) -> np.ndarray:
    """Centres of a few rounds of k-means over a bounded sample; one centre at 0 if there is no sample."""
    if not len(sample):
        return sample.reshape(0, sample.shape[1] if sample.ndim == 2 else 0)
    c = np.unique(sample, axis=0)
    c = c[np.random.default_rng(seed).permutation(len(c))[:most]]
    for _ in range(rounds):
        near = ((c * c).sum(1)[None] - 2 * sample @ c.T).argmin(1)
        n = np.bincount(near, minlength=len(c))
        total = np.stack([np.bincount(near, sample[:, d], len(c)) for d in range(sample.shape[1])], 1)
        c = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], c)
    return c


def exact_products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Integer inner products: doubles are exact below 2^53, else 64-bit integers."""
    top = (np.abs(q).max(initial=0).astype(np.float64) + 1) * (np.abs(x).max(initial=0).astype(np.float64) + 1) * q.shape[1]
    if top < 2.0**53:
        return np.rint(q.astype(np.float64) @ x.astype(np.float64).T).astype(np.int64)
    return q.astype(np.int64) @ x.astype(np.int64).T


def best(scores: np.ndarray, ids: np.ndarray, rows: np.ndarray, own: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each row of scores the ids and scores of its k highest, ties to the smaller id; own: the query's row among `rows`, no answer."""
    there = np.isin(own, rows)
    for i in range(len(scores)):
        s, x = scores[i], ids
        if there[i]:
            s, x = s[rows != own[i]], ids[rows != own[i]]
        at = np.flatnonzero(s >= np.partition(s, len(s) - k)[len(s) - k]) if len(s) > k else np.arange(len(s))
        at = at[np.lexsort((x[at], -s[at]))][:k]
        yield i, x[at], s[at]


def top_k(vectors: DataFrame, asks: str, k: int = 20, id_col: str = "vec_id", vec_col: str = "v", **options) -> DataFrame:
    """(query_id, rank, vec_id, score) of the k highest integer inner products of each query with all rows but its own.

    vectors: a long id and an array of longs; `asks` is a condition on (vec_id, v) that tells the queries among them.
    Rows that repeat an id are rows of their own: a query's answers may hold its id, and several queries of
    one id have several rows a rank. Only vectors of the query's length are compared.
    """
    data = vectors.select(F.col(id_col).alias("vec_id"), F.col(vec_col).alias("v")).withColumn("asks", F.expr(asks))
    lengths = sorted(r[0] for r in data.groupBy(F.size("v")).count().collect())  # a row a length
    out = None
    for n in lengths:
        of = data.where(F.size("v") == n) if len(lengths) > 1 else data
        got = top_k_of_one_length(of, k, **options)
        out = got if out is None else out.unionByName(got)
    return data.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long") if out is None else out


def top_k_of_one_length(data: DataFrame, k: int, pivots: int = 64, block: int = TILE, query_block: int = QUERY_BLOCK, sample_rows: int = 4096) -> DataFrame:
    """top_k of rows (vec_id, v, asks) whose vectors have one length.

    Pivots come from a sample of at most sample_rows vectors. Each vector belongs to its nearest pivot's cell; q.x <=
    q.p + |q| far for x at the distance far from its pivot p. Queries are grouped by their cells, in groups of query_block
    about. First each group is solved in its own cell, which gives each query a k-th score; then it goes to those cells alone
    whose radius lets a product reach that, and of their vectors only those so far from the pivot that some query of
    the group can need them are copied to it. Cells over `block` vectors are dealt into blocks.
    """
    spark = data.sparkSession
    sample = stacked(data.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample_rows).select("v").toArrow().column("v"))
    centre = pivots_of(sample, max(1, min(pivots, len(sample) // 16)))
    held = spark.sparkContext.broadcast(centre)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = held.value
        for b in common.pieces(batches, 4096):
            x = stacked(pa.chunked_array([b.column("v")]))
            near = ((c * c).sum(1)[None] - 2 * x @ c.T).argmin(1) if len(x) else np.empty(0, np.int64)
            far = np.sqrt(((x - c[near]) ** 2).sum(1)) * (1 + 1e-9)
            yield pa.RecordBatch.from_arrays([*(b.column(n) for n in ("row", "vec_id", "v", "asks")), pa.array(near.astype(np.int32)), pa.array(far)], names=["row", "vec_id", "v", "asks", "cell", "far"])

    kind = "row long, vec_id long, v array<long>, asks boolean, cell int, far double"
    cells = common.written(data.withColumn("row", F.monotonically_increasing_id()).select("row", "vec_id", "v", "asks").mapInArrow(assign, kind), "cells")
    size, radius, asked_of = np.zeros(len(centre), np.int64), np.full(len(centre), -1.0), np.zeros(len(centre), np.int64)
    for r in cells.groupBy("cell").agg(F.count("*").alias("n"), F.max("far").alias("r"), F.count(F.when(F.col("asks"), 1)).alias("q")).collect():  # a row a pivot
        size[r.cell], radius[r.cell], asked_of[r.cell] = r.n, r.r, r.q
    blocks, groups = np.maximum(1, -(-size // block)), -(-asked_of // query_block)
    first = np.cumsum(groups) - groups
    summary = spark.sparkContext.broadcast((centre, size, radius, blocks))

    def of_cell(values: np.ndarray):
        return F.element_at(F.array(*[F.lit(int(x)) for x in values]), F.col("cell") + 1)

    data_block = F.pmod(F.xxhash64("row"), of_cell(blocks)).cast("int").alias("b")
    group = (of_cell(first) + F.pmod(F.xxhash64("row"), of_cell(np.maximum(groups, 1))).cast("int")).alias("qb")
    asked = cells.where("asks").select(F.col("cell").alias("home"), group, F.col("row").alias("key"), "vec_id", "v", "cell")

    def solve(table: pa.Table) -> pa.Table:
        is_q = table.column("key").is_valid().to_numpy()
        x, ids = stacked(table.column("v")), table.column("vec_id").to_numpy()
        key, row = (table.column(c).fill_null(-1).to_numpy() for c in ("key", "row"))
        q, q_id, key, x, ids, row = x[is_q], ids[is_q], key[is_q], x[~is_q], ids[~is_q], row[~is_q]
        out: list[list[np.ndarray]] = [[np.empty(0, np.int64)] for _ in range(4)]
        for i in range(0, len(q) if len(ids) else 0, 256):
            for j, x_id, score in best(exact_products(q[i : i + 256], x), ids, row, key[i : i + 256], k):
                n = len(x_id)
                for c, v in zip(out, (np.full(n, key[i + j]), np.full(n, q_id[i + j]), x_id, score), strict=True):
                    c.append(v)
        return pa.table({n: pa.array(np.concatenate(c), pa.int64()) for n, c in zip(("key", "query_id", "vec_id", "score"), out, strict=True)})

    def solved(placed: DataFrame, routed: DataFrame) -> DataFrame:
        null = F.lit(None).cast("long")
        both = placed.select("cell", "b", "qb", null.alias("key"), "row", "vec_id", "v").unionByName(routed.select("cell", "b", "qb", "key", null.alias("row"), "vec_id", "v"))
        return both.groupBy("cell", "b", "qb").applyInArrow(solve, "key long, query_id long, vec_id long, score long")

    at_home = cells.where(of_cell(groups) > 0).select("cell", data_block, "row", "vec_id", "v", F.explode(F.sequence(of_cell(first), of_cell(first + groups) - 1)).alias("qb"))
    home = common.written(solved(at_home, asked.select("cell", F.explode(F.sequence(F.lit(0), of_cell(blocks) - 1)).alias("b"), "qb", "key", "vec_id", "v")), "home-answers")
    ranked = Window.partitionBy("key").orderBy(F.desc("score"), "vec_id")
    kth = home.withColumn("r", F.row_number().over(ranked)).where(F.col("r") == k).select("key", F.col("score").alias("kth"))

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centre, size, radius, blocks = summary.value
        for b in common.pieces(batches, 1024):
            q = stacked(pa.chunked_array([b.column("v")]))
            norm = np.maximum(np.sqrt((q * q).sum(1)), 1e-9)
            kth = b.column("kth").fill_null(-(1 << 62)).to_numpy(zero_copy_only=False).astype(np.float64)
            lack = kth[:, None] - q @ centre.T
            least = (lack - np.abs(lack) * 1e-9 - 1e-6) / norm[:, None] - 1e-9 * radius[None]
            least[lack <= 1e-6] = -1.0
            need = (radius[None] >= least) & (size > 0)[None]
            need[np.arange(len(q)), b.column("home").to_numpy()] = False
            row, cell = np.nonzero(need)
            each = blocks[cell]
            of = np.repeat(np.arange(len(row)), each)
            sub = np.arange(len(of)) - np.repeat(np.cumsum(each) - each, each)
            take = pa.array(row[of])
            yield pa.RecordBatch.from_arrays([pa.array(cell[of].astype(np.int32)), pa.array(sub.astype(np.int32)), *(b.column(c).take(take) for c in ("qb", "key", "vec_id", "v")), pa.array(least[row, cell][of])], names=["cell", "b", "qb", "key", "vec_id", "v", "least"])

    routed = asked.join(kth, "key", "left").select("home", "qb", "key", "vec_id", "v", "kth").mapInArrow(route, "cell int, b int, qb int, key long, vec_id long, v array<long>, least double")
    routed = common.written(routed, "routed")
    need = common.written(routed.groupBy("cell", "b", "qb").agg(F.min("least").alias("least")), "needs")
    need_ = F.broadcast(need) if need.count() <= MAX_NEEDS else need
    placed = cells.select("cell", data_block, "row", "vec_id", "v", "far").join(need_, ["cell", "b"]).where("far >= least")
    every = home.unionByName(solved(placed, routed)).withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= k)
    return every.select("query_id", "rank", "vec_id", "score")


def op5_embedding_dedup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(common.read_table(spark, sf_dir, "embeddings"))


def op8_voronoi_topk(spark, sf_dir: str) -> DataFrame:
    e = common.read_table(spark, sf_dir, "embeddings").where(usable("embedding") & F.col("vec_id").isNotNull())
    v = e.select("vec_id", F.transform("embedding", lambda x: F.floor(x.cast("double") * 64).cast("long")).alias("v"))
    return top_k(v, "vec_id % 20 = 0")


# DuckDB; the cosine needs the norms of doubles. One row a vector.
ORACLE_SQL = {
    "op8_voronoi_topk": """
WITH v AS (
  SELECT row_number() OVER () AS n, vec_id, list_transform(embedding, lambda x: CAST(floor(x::DOUBLE * 64) AS BIGINT)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.n, q.vec_id AS query_id, x.vec_id,
         CAST(list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * x.v[i])) AS BIGINT) AS score
  FROM v q JOIN v x ON q.vec_id % 20 = 0 AND x.n <> q.n AND len(x.v) = len(q.v)
), r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY n ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
""",
    "op5_embedding_dedup": """
WITH RECURSIVE v AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), l AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE list_inner_product(a.e, b.e) / (sqrt(list_inner_product(a.e, a.e)) * sqrt(list_inner_product(b.e, b.e))) >= 0.98
), reach AS (
  SELECT vec_id AS a, vec_id AS b FROM v
  UNION
  SELECT r.a, l.b FROM reach r JOIN l ON l.a = r.b
), c AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a), n AS (SELECT a, count(*) AS n_links FROM l GROUP BY a)
SELECT e.vec_id, CAST(coalesce(n.n_links, 0) AS BIGINT) AS n_links, coalesce(c.component_id, e.vec_id) AS component_id,
       e.vec_id = coalesce(c.component_id, e.vec_id) AS kept
FROM embeddings e LEFT JOIN c ON c.a = e.vec_id LEFT JOIN n ON n.a = e.vec_id
""",
}
QUERIES = {"op5_embedding_dedup": op5_embedding_dedup, "op8_voronoi_topk": op8_voronoi_topk}

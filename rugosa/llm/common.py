"""What the operators share: tables in the shared folder, text batches, union-find, connected components."""

from __future__ import annotations

import os
import pickle
import tempfile
import uuid
from collections.abc import Callable, Hashable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_KEPT: dict[Hashable, object] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which driver and executors share; unset, a local one in local mode, and an error on a cluster."""
    set_to = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not set_to and not spark.sparkContext.master.split("[")[0] == "local":
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return (set_to or os.path.join(tempfile.gettempdir(), "rugosa-checkpoints")).rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/rugosa/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Cuts lineage: df as a Parquet table in the shared folder, so that a lost executor costs no recomputation."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._rugosa_path = path
    return out


def dropped(df: DataFrame) -> None:
    """Deletes a table of written() that nothing reads any more."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(df._rugosa_path)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def collected(spark: SparkSession) -> None:
    """Lets go of the shuffle files that nothing reads any more: Spark deletes them when the driver has collected what names them."""
    spark.sparkContext._jvm.System.gc()


def made_by_task(rows: DataFrame, make: Callable[[pa.Table], object]) -> object | None:
    """make(table) of all rows, which lie in one partition and whose number the caller bounds, in their order; None if there are none.

    One task makes it, so that the driver holds what is made and not the rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if held := [b for b in batches if b.num_rows]:
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(make(pa.Table.from_batches(held)), 5)], pa.binary())], names=["made"])

    got = rows.coalesce(1).mapInArrow(run, "made binary").collect()
    return pickle.loads(got[0].made) if got else None


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have."""
    while name.lower() in {c.lower() for c in df.columns}:
        name = f"_{name}"
    return name


def crc_mod(doc_id: str | Column, mod: int) -> Column:
    """crc32 of the id as text, modulo mod; a null id counts as the empty text."""
    return F.crc32(F.coalesce((F.col(doc_id) if isinstance(doc_id, str) else doc_id).cast("string"), F.lit(""))) % mod


def texts(column: pa.Array | pa.ChunkedArray) -> list[str]:
    """Null counts as the empty text."""
    return [x or "" for x in column.to_pylist()]


def kept(key: Hashable, make: Callable[[], object]) -> object:
    """make(), which a Python worker keeps from task to task until it asks for another key: workers outlive the stages that share them, and their tables would add up."""
    if key not in _KEPT:
        _KEPT.clear()
        _KEPT[key] = make()
    return _KEPT[key]


def released() -> None:
    """Gives back the memory that Arrow keeps of batches gone by, which a Python worker would hold on to between tasks."""
    pa.default_memory_pool().release_unused()


def pieces(batches: Iterable[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """The same rows in smaller batches, so that what Python holds of one stays small."""
    for b in batches:
        for i in range(0, b.num_rows, rows):
            yield b.slice(i, rows)
        released()


def portions(batches: Iterable[pa.RecordBatch], column: str, rows: int = 4096, size: int = 5 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most `rows` rows, cut further after `size` bytes of the column's text."""
    for b in batches:
        texts = b.column(column)
        ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        i = 0
        while i < b.num_rows:
            j = min(i + rows, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + size, side="right")))
            yield b.slice(i, max(1, j - i))
            i += max(1, j - i)
        released()


def groups_of(labels: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Component labels (smallest index) after uniting a[i] with b[i]; labels are those before."""
    lab = labels.copy()
    while len(a):
        x, y = lab[a], lab[b]
        apart = x != y
        if not apart.any():
            break
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(lab, np.maximum(x, y), np.minimum(x, y))
        while True:
            up = lab[lab]
            if np.array_equal(up, lab):
                break
            lab = up
    return lab


def star_edges(ids: np.ndarray, lab: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One link for each member of a component but its root: at most as many links as ids."""
    at = np.flatnonzero(lab != np.arange(len(lab)))
    return ids[at], ids[lab[at]]


def _local_forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    a, b = np.empty(0, np.int64), np.empty(0, np.int64)
    for batch in batches:
        a = np.concatenate([a, batch.column(0).to_numpy(zero_copy_only=False)])
        b = np.concatenate([b, batch.column(1).to_numpy(zero_copy_only=False)])
        ids, at = np.unique(np.concatenate([a, b]), return_inverse=True)
        n = len(a)
        a, b = star_edges(ids, groups_of(np.arange(len(ids)), at[:n], at[n:]))
    yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(a long, b long) links to (node, component): the smallest node that each node reaches; nodes without links are absent.

    Links are first contracted where they arrive, so a hub's links are few before any key deals them; then alternating large-star and small-star rounds run
    until nothing changes. A hub is only ever one side of a join whose other side has one row a key, so
    Spark can split it; no adjacency list is built.
    """
    e = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b")
    e = written(e.mapInArrow(_local_forest, "a long, b long").distinct(), "links")
    before = None
    for _ in range(most_rounds):
        now = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before or now[0] == 0:
            break
        before = now
        both = e.select("a", "b").unionAll(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("low")).select("a", F.least("a", "low").alias("low"))
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("low").alias("b"))
        large = written(large.where("a <> b").distinct(), "links")
        low = large.groupBy("a").agg(F.min("b").alias("low"))
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("low").alias("b")).unionAll(low.select("a", F.col("low").alias("b")))
        new = written(small.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
        dropped(e)
        dropped(large)
        e = new
    else:
        raise RuntimeError("components: no end of rounds")
    return e.select(F.col("a").alias("node"), F.col("b").alias("component")).unionAll(e.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())


def left_joined(rows: DataFrame, known: DataFrame, keys: list[str], hot: str) -> DataFrame:
    """rows left joined with known, which has one row a key. Those of known's rows whose column `hot` is true are broadcast, so that
    rows of a frequent key are joined where they are; the caller bounds their number. The column itself is left out.
    """
    often = F.broadcast(known.where(hot).drop(hot))
    rest = rows.join(F.broadcast(known.where(hot).select(*keys)), keys, "left_anti").join(known.where(~F.col(hot)).drop(hot), keys, "left")
    return rows.join(often, keys).unionByName(rest)


#: A key with more than this share of the rows is frequent: at most as many keys as its inverse are.
HOT_SHARE = 1 / 2000

"""Importance resampling towards a target corpus, by hashed runs of words whose checksums are composed, not recomputed."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import bytewords, common, crc

BUCKETS, SEED, MIN_WORDS = 10_000, 2024, 20
#: The share of the documents with enough words that is drawn, in hundredths.
PERCENT = 10


def featured(docs: DataFrame, buckets: int = BUCKETS, least: int = 1, most: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, buckets binary): the bucket of each run of `least` to `most` words, as little-endian 32-bit integers.

    A-Z is lower-cased; words are runs of ASCII letters, digits and anything beyond ASCII. A null text has
    no words; a null id stays null. Other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in common.portions(batches, "text"):
            w = bytewords.ByteWords(b.column("text"), bytewords.ALNUM)
            sums, of = crc.of_runs(crc.of_slices(w.buf, w.starts, w.lengths), w.lengths, w.texts_of(), least, most)
            if most > least:
                order = np.argsort(of, kind="stable")
                sums, of = sums[order], of[order]
            kept = (sums % np.uint32(buckets)).astype("<u4")
            ends = np.searchsorted(of, np.arange(b.num_rows + 1)).astype(np.int64) * 4
            data = pa.Array.from_buffers(pa.large_binary(), b.num_rows, [None, pa.py_buffer(ends), pa.py_buffer(kept)])
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(w.counts()), data.cast(pa.binary())], names=["doc_id", "n_words", "buckets"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, n_words long, buckets binary")


def _read(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All rows' buckets, and the offsets of the rows in them."""
    column = column.cast(pa.large_binary())
    at = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8) if len(column) else np.zeros(1, np.int64)
    data = column.buffers()[2]
    return (np.frombuffer(data, np.uint8)[at[0] : at[-1]].view("<u4") if data is not None else np.empty(0, np.uint32)), (at - at[0]) // 4


def histogram(features: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """How many features each bucket holds. A task counts in one array; the driver gets `buckets` sums, however large the corpus is."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(buckets, np.int64)
        for b in batches:
            n += np.bincount(_read(b.column(0))[0], minlength=buckets)
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(n[at])], names=["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    got = features.select("buckets").mapInArrow(count, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    out[got.column("bucket").to_numpy()] = got.column("n").to_numpy()
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 * log ratio) of each bucket's smoothed shares in target and source."""
    n = len(source)
    s, t = source.astype(np.float64) + 1, target.astype(np.float64) + 1
    return np.floor(1000 * np.log(t * (float(source.sum()) + n) / (s * (float(target.sum()) + n)))).astype(np.int64)


def weighed(features: DataFrame, gain: np.ndarray) -> DataFrame:
    """(doc_id, n_words, n_features, weight): the sum of the gains of a document's features. The gains, one number a bucket, are broadcast."""
    held = features.sparkSession.sparkContext.broadcast(gain)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in common.pieces(batches, 2048):
            found, at = _read(b.column("buckets"))
            total = np.concatenate([[0], np.cumsum(held.value[found])])
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("n_words"), pa.array(np.diff(at)), pa.array(total[at[1:]] - total[at[:-1]])], names=["doc_id", "n_words", "n_features", "weight"])

    return features.mapInArrow(run, "doc_id long, n_words long, n_features long, weight long")


def noisy(rows: DataFrame, seed: int = SEED) -> DataFrame:
    """With score: the weight and a Gumbel number of a thousandth's precision, from a hash of the id (null: the empty text)."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return rows.withColumn("score", F.col("weight") + F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long"))


def drawn(scored: DataFrame, percent: int = PERCENT, min_words: int = MIN_WORDS) -> DataFrame:
    """With rank: 1, 2, 3, ... for the highest scores of the rows with min_words words or more, ties to the smaller id, null ids last; null for the rest.

    Rows are sorted by ranges of all sort keys and their place in the input, so that no key gathers in
    one task; a rank is a row's place in its part and the rows of all parts before, one number a part.
    """
    open_to = F.col("n_words") >= min_words
    keys = [open_to.desc(), F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("place")]
    rows = scored.withColumn("place", F.monotonically_increasing_id())
    rows = rows.repartitionByRange(*keys).sortWithinPartitions(*keys).drop("place")
    rows = common.written(rows.withColumn("part", F.spark_partition_id()).withColumn("at", F.monotonically_increasing_id() % F.lit(1 << 33)), "ordered")
    parts = rows.groupBy("part").agg(F.count("*").alias("n"), F.count_if(open_to).alias("n_open"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row a part
    parts = parts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"), F.expr(f"(sum(n_open) OVER ()) * {percent} DIV 100").alias("most"))
    rank = F.col("base") + F.col("at") + 1
    ranked = rows.join(F.broadcast(parts), "part")  # as many rows as the sort has partitions
    return ranked.withColumn("rank", F.when(open_to & (rank <= F.col("most")), rank)).drop("part", "at", "base", "most")


def resampled(docs: DataFrame, target: DataFrame, buckets: int = BUCKETS, least: int = 1, most: int = 1, percent: int = PERCENT, min_words: int = MIN_WORDS, seed: int = SEED) -> DataFrame:
    """(doc_id, n_words, n_features, weight, score, rank) of every row of docs: rank says which to take, best first.

    Texts are read once; their buckets, about half as many bytes, are a table that counting and
    weighing read. Empty tables on either side: no rows, or gains of the source's shares alone. Repeated
    rows count and are ranked each.
    """
    rows = common.written(featured(docs, buckets, least, most), "features")
    aim = featured(target.select(F.lit(0).alias("doc_id"), "text"), buckets, least, most)
    return drawn(noisy(weighed(rows, gains(histogram(rows, buckets), histogram(aim, buckets))), seed), percent, min_words)


def op13_importance(spark, sf_dir: str) -> DataFrame:
    """A tenth of all documents, those most like the benchmark's texts, by single words."""
    docs, target = common.read_table(spark, sf_dir, "documents"), common.read_table(spark, sf_dir, "benchmark")
    return resampled(docs, target).select("doc_id", "n_features", "weight", "score", "rank")


# crc32 of the distinct words, a byte at a time, by the table of the polynomial's remainders.
ORACLE_SQL = {
    "op13_importance": f"""
WITH tab AS (
  SELECT list(list_reduce([b, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, i: xor(c >> 1, (c & 1) * {crc.POLYNOMIAL}::BIGINT)) ORDER BY b) AS t
  FROM (SELECT unnest(range(0, 256))::BIGINT AS b)
), d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents
), b AS (
  SELECT unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')) AS w FROM benchmark
), dw AS (
  SELECT doc_id, unnest(w) AS w FROM d
), x AS (
  SELECT w, hex(encode(w)) AS h FROM (SELECT w FROM dw UNION SELECT w FROM b)
), k AS (
  SELECT w, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(0, length(h) // 2), lambda i: ('0x' || substr(h, 2 * i::INTEGER + 1, 2))::BIGINT)),
                            lambda c, y: xor(c >> 8, t[(xor(c, y) & 255) + 1])), 4294967295::BIGINT) % {BUCKETS} AS k FROM x, tab
), s AS (
  SELECT k, count(*) AS s FROM dw JOIN k USING (w) GROUP BY k
), t AS (
  SELECT k, count(*) AS t FROM b JOIN k USING (w) GROUP BY k
), n AS (
  SELECT (SELECT count(*) FROM dw)::DOUBLE AS sn, (SELECT count(*) FROM b)::DOUBLE AS tn
), g AS (
  SELECT s.k, floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * (sn + {BUCKETS}) / ((s + 1)::DOUBLE * (tn + {BUCKETS}))))::BIGINT AS g FROM s LEFT JOIN t USING (k), n
), e AS (
  SELECT doc_id, count(*) AS n_features, sum(g)::BIGINT AS weight FROM dw JOIN k USING (w) JOIN g USING (k) GROUP BY doc_id
), f AS (
  SELECT d.doc_id, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
         coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('{SEED}:' || d.doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score
  FROM d LEFT JOIN e USING (doc_id)
), r AS (
  SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM f WHERE n_features >= {MIN_WORDS}
)
SELECT f.*, CASE WHEN rank <= (SELECT count(*) FROM r) * {PERCENT} // 100 THEN rank END AS rank FROM f LEFT JOIN r USING (doc_id)
"""
}
QUERIES = {"op13_importance": op13_importance}

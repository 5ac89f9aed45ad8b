"""Audit of how far the sources of a language diverge in their words, in exact integer arithmetic."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import bytewords, common

MIN_DOCS, SCALE, SMOOTHING, TOP = 10, 1_000_000_000, 2, 10
#: Rows of term counts that a task holds before it hands them on.
HELD_ROWS = 400_000
_KEYS = ["lang", "source", "term"]


def _portion_counts(b: pa.RecordBatch) -> pa.Table:
    """(lang, source, term, n, docs) of one batch; a row with a null term for each of its groups."""
    w = bytewords.ByteWords(b.column("text"), bytewords.LETTERS)
    langs, sources = (pc.fill_null(b.column(c), "").dictionary_encode() for c in ("lang", "source"))
    pair = langs.indices.to_numpy().astype(np.int64) * len(sources.dictionary) + sources.indices.to_numpy()
    groups, group = np.unique(pair, return_inverse=True)
    ids, examples = bytewords.grouped(w.buf, w.starts, w.lengths)
    texts, v = w.texts_of(), max(1, len(examples))
    by_text, n = np.unique(texts * v + ids, return_counts=True)  # CSR of texts and terms
    key, at = np.unique(group[by_text // v] * v + by_text % v, return_inverse=True)
    counts, docs = np.bincount(at, n, len(key)).astype(np.int64), np.bincount(at, minlength=len(key))
    of = np.concatenate([key // v, np.arange(len(groups))])
    terms = pa.array(w.slices(examples), pa.binary()).take(pa.array(key % v)).cast(pa.string())
    blank = np.zeros(len(groups), np.int64)
    return pa.table(
        {
            "lang": langs.dictionary.take(pa.array(groups[of] // len(sources.dictionary))),
            "source": sources.dictionary.take(pa.array(groups[of] % len(sources.dictionary))),
            "term": pa.concat_arrays([terms, pa.nulls(len(groups), pa.string())]),
            "n": np.concatenate([counts, blank]),
            "docs": np.concatenate([docs, blank]),
        }
    )


def _merged(tables: list[pa.Table]) -> pa.Table:
    return pa.concat_tables(tables).group_by(_KEYS).aggregate([("n", "sum"), ("docs", "sum")]).rename_columns([*_KEYS, "n", "docs"])


def term_counts(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """(lang, source, term, n, docs): occurrences of each term, and documents that hold it; null texts, languages and sources count as ''.

    Terms are runs of ASCII letters and anything beyond ASCII, A-Z lower-cased. Each (lang, source) also
    has a row with a null term, so groups without any term are seen too.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        for b in common.portions(batches, "text"):
            if b.num_rows:
                held.append(_portion_counts(b))
            if sum(t.num_rows for t in held) > HELD_ROWS:
                held = [_merged(held)]
                if held[0].num_rows > HELD_ROWS // 2:
                    yield from held.pop().to_batches(max_chunksize=20_000)
        if held:
            yield from _merged(held).to_batches(max_chunksize=20_000)

    rows = docs.select(F.col(lang_col).cast("string").alias("lang"), F.col(source_col).cast("string").alias("source"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "lang string, source string, term string, n long, docs long").groupBy(*_KEYS).agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def kept_terms(counts: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """Rows of the terms in at least min_docs documents of their language, with the language's count `n_lang` and `lead`, true in one row a term; and the rows without a term."""
    of = Window.partitionBy("lang", "term")
    rows = counts.select(*_KEYS, "n", F.sum("docs").over(of).alias("df"), F.sum("n").over(of).alias("n_lang"), (F.min("source").over(of) == F.col("source")).alias("lead"))
    return rows.where(f"term IS NULL OR df >= {min_docs}").drop("df")


def group_totals(kept: DataFrame) -> DataFrame:
    """(lang, source, n_all, terms, v, n_lang_all): each group's occurrences and distinct terms, its language's terms and occurrences."""
    there = F.col("term").isNotNull()
    own = kept.groupBy("lang", "source").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_all"), F.count_if(there).alias("terms"), F.count_if(there & F.col("lead")).alias("leads"))
    of = Window.partitionBy("lang")  # one row a source
    return own.select("lang", "source", "n_all", "terms", F.sum("leads").over(of).alias("v"), F.sum("n_all").over(of).alias("n_lang_all"))


def share(n: Column, total: Column, v: Column) -> Column:
    """1 + floor(SCALE * (n + 2) / (total + 2 v)) in whole numbers, three decimal places at a time: exact up to 9e15 occurrences. No terms at all: 1."""
    d = F.when(total + 2 * v > 0, total + 2 * v)
    rest, out = n + SMOOTHING, F.lit(0).cast("long")
    for _ in range(3):
        out = out * 1000 + F.call_function("div", rest * 1000, d)
        rest = (rest * 1000) % d
    return F.coalesce(out, F.lit(0)) + 1


def divergence(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), p + q)


def shares(n: np.ndarray, total: np.ndarray, v: np.ndarray) -> np.ndarray:
    """share() on arrays."""
    d, rest, out = total + 2 * v, n + SMOOTHING, np.zeros(len(n), np.int64)
    for _ in range(3):
        out = out * 1000 + rest * 1000 // d
        rest = rest * 1000 % d
    return out + 1


def divergences(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // (p + q)


def _block_pairs(rows: pa.Table, chunk: int = 1 << 19) -> Iterator[pa.Table]:
    """(lang, a, b, extra) summed over a block of whole terms, for the sources a < b that share a term.

    The block is a CSR matrix: a row a term, its entries the counts of the sources that have it. The
    entries of each row are paired, at most `chunk` pairs at once; extra is what a shared term adds to
    the pair beyond its sides' shares of terms that the other lacks (see pair_values).
    """
    n, total, v = (rows.column(c).to_numpy() for c in ("n", "n_all", "v"))
    langs, sources, terms = (rows.column(c).combine_chunks().dictionary_encode() for c in ("lang", "source", "term"))
    lang, source, term = (x.indices.to_numpy().astype(np.int64) for x in (langs, sources, terms))
    p, p0 = shares(n, total, v), shares(np.zeros_like(n), total, v)
    row = np.flatnonzero(np.concatenate([[True], (term[1:] != term[:-1]) | (lang[1:] != lang[:-1])]))
    size = np.diff(np.append(row, len(n)))
    later = np.repeat(row + size, size) - np.arange(len(n)) - 1  # entries of the same row to the right
    ends = np.cumsum(later)
    s = len(sources.dictionary)
    i = 0
    while i < len(n):
        j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + chunk, side="right")))
        left = np.repeat(np.arange(i, j), later[i:j])
        right = left + 1 + np.arange(len(left)) - np.repeat(ends[i:j] - later[i:j] - (ends[i - 1] if i else 0), later[i:j])
        if len(left):
            a, b = left, right
            extra = divergences(p[a], p[b]) - divergences(p[a], p0[b]) - divergences(p0[a], p[b]) + divergences(p0[a], p0[b])
            key = (lang[a] * s + source[a]) * s + source[b]
            order = np.argsort(key, kind="stable")
            heads = np.flatnonzero(np.concatenate([[True], np.diff(key[order]) != 0]))
            key = key[order][heads]
            yield pa.table({"lang": langs.dictionary.take(pa.array(key // s // s)), "a": sources.dictionary.take(pa.array(key // s % s)), "b": sources.dictionary.take(pa.array(key % s)), "extra": np.add.reduceat(extra[order], heads)})
        i = j


def shared_terms(rows: DataFrame) -> DataFrame:
    """(lang, a, b, extra): what the terms that two sources share add to their divergence, summed in each task before it is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        rest: pa.Table | None = None

        def add(block: pa.Table) -> None:
            for t in _block_pairs(block):
                held.append(t)
                if len(held) > 1 and sum(x.num_rows for x in held) > HELD_ROWS:
                    held[:] = [pa.concat_tables(held).group_by(["lang", "a", "b"]).aggregate([("extra", "sum")]).rename_columns(["lang", "a", "b", "extra"])]

        for b in batches:
            t = pa.Table.from_batches([b])
            t = t if rest is None else pa.concat_tables([rest, t])
            if not t.num_rows:
                continue
            last = {c: t.column(c)[-1] for c in ("lang", "term")}
            same = pc.and_(pc.equal(t.column("lang"), last["lang"]), pc.equal(t.column("term"), last["term"]))
            cut = t.num_rows - pc.sum(same).as_py()  # sorted: the last term's rows stand at the end
            if cut:
                add(t.slice(0, cut))
            rest = t.slice(cut)
        if rest is not None:
            add(rest)
        for t in held:
            yield from t.to_batches(max_chunksize=20_000)

    dealt = rows.select("lang", "source", "term", "n", "n_all", "v").repartition("lang", "term").sortWithinPartitions("lang", "term", "source")
    return dealt.mapInArrow(run, "lang string, a string, b string, extra long").groupBy("lang", "a", "b").agg(F.sum("extra").alias("extra"))


def pair_values(kept: DataFrame, totals: DataFrame) -> DataFrame:
    """(lang, source, item, value): the divergence of each two sources of a language, summed over all kept terms.

    With p0 the share of a term that a source lacks, the sum is that of f(p, p0 of b) over a's terms, that of
    f(p0 of a, p) over b's, f(p0, p0) for terms that neither has, and for shared ones the difference, so work
    follows the terms that occur. The first two come from each source's histogram of counts.
    """
    rows = kept.where("term IS NOT NULL").join(totals, ["lang", "source"])
    extra = shared_terms(rows)
    other = totals.select("lang", F.col("source").alias("item"), F.col("n_all").alias("n_item"), F.col("terms").alias("terms_item"))
    histogram = kept.where("term IS NOT NULL").groupBy("lang", "source", "n").agg(F.count("*").alias("times")).join(totals, ["lang", "source"]).join(other, "lang").where("source <> item")
    zero = F.lit(0).cast("long")
    one_sided = histogram.groupBy("lang", "source", "item").agg(F.sum(F.col("times") * divergence(share(F.col("n"), F.col("n_all"), F.col("v")), share(zero, F.col("n_item"), F.col("v")))).alias("own"))
    mine = one_sided.withColumnRenamed("own", "mine")
    theirs = one_sided.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), F.col("own").alias("theirs"))
    both = extra.unionAll(extra.select("lang", F.col("b").alias("a"), F.col("a").alias("b"), "extra")).select("lang", F.col("a").alias("source"), F.col("b").alias("item"), "extra")
    pairs = totals.join(other, "lang").where("source <> item")
    for t in (mine, theirs, both):
        pairs = pairs.join(t, ["lang", "source", "item"], "left")
    blank = divergence(share(zero, F.col("n_all"), F.col("v")), share(zero, F.col("n_item"), F.col("v")))
    value = sum((F.coalesce(c, zero) for c in (F.col("mine"), F.col("theirs"), F.col("extra"))), (F.col("v") - F.col("terms") - F.col("terms_item")) * blank)
    return pairs.select("lang", "source", "item", F.when(F.col("v") > 0, value).otherwise(zero).alias("value"))


def term_values(kept: DataFrame, totals: DataFrame) -> DataFrame:
    """(lang, source, item, value): the terms of each source that it holds a larger share of than its language."""
    rows = kept.where("term IS NOT NULL AND n > 0").join(totals, ["lang", "source"])
    p, q = share(F.col("n"), F.col("n_all"), F.col("v")), share(F.col("n_lang"), F.col("n_lang_all"), F.col("v"))
    return rows.select("lang", "source", F.col("term").alias("item"), p.alias("p"), q.alias("q")).where("p > q").select("lang", "source", "item", divergence(F.col("p"), F.col("q")).alias("value"))


def audit(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP) -> DataFrame:
    """(lang, source, part, item, value, rank): each source against each other one (part pair), and its own `top` terms against its language (part term).

    Ranks go from 1 within a source and part, by falling value, then by the item's bytes. An empty
    table gives no row; a source alone in its language no pair; repeated rows count each time.
    """
    kept = common.written(kept_terms(term_counts(docs), min_docs), "terms")
    totals = common.written(group_totals(kept), "sources")
    place = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")).cast("int")
    pairs = pair_values(kept, totals).withColumn("rank", place).withColumn("part", F.lit("pair"))
    terms = term_values(kept, totals).withColumn("rank", place).where(f"rank <= {top}").withColumn("part", F.lit("term"))
    return pairs.unionByName(terms).select("lang", "source", "part", "item", "value", "rank")


def op12_source_divergence(spark, sf_dir: str) -> DataFrame:
    """All sources of all documents, each against the others of its language, with the ten terms that mark it most."""
    return audit(common.read_table(spark, sf_dir, "documents"))


_SHARE = "1 + ({n} + 2)::HUGEINT * 1000000000 // ({t} + 2 * v)"
_F = "((p - q) * (p - q)) // (p + q)"
ORACLE_SQL = {
    "op12_source_divergence": f"""
WITH d AS (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS w FROM documents
), t AS (
  SELECT r, lang, source, unnest(w) AS term FROM d
), k AS (
  SELECT lang, term, count(*) AS n_lang FROM t GROUP BY lang, term HAVING count(DISTINCT r) >= {MIN_DOCS}
), c AS (
  SELECT lang, source, term, count(*) AS n FROM t JOIN k USING (lang, term) GROUP BY lang, source, term
), l AS (
  SELECT lang, count(*) AS v, sum(n_lang) AS nl FROM k GROUP BY lang
), g AS (
  SELECT lang, source, coalesce((SELECT sum(n) FROM c WHERE c.lang = x.lang AND c.source = x.source), 0) AS ng, coalesce(v, 0) AS v, nl
  FROM (SELECT DISTINCT lang, source FROM d) x LEFT JOIN l USING (lang)
), m AS (
  SELECT g.lang, g.source, k.term, coalesce(n, 0) AS n, {_SHARE.format(n="coalesce(n, 0)", t="ng")} AS p, {_SHARE.format(n="n_lang", t="nl")} AS q
  FROM g JOIN k USING (lang) LEFT JOIN c USING (lang, source, term)
), pr AS (
  SELECT a.lang, a.source, b.source AS item, sum({_F}) AS value
  FROM (SELECT lang, source, term, p FROM m) a JOIN (SELECT lang, source, term, p AS q FROM m) b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
), u AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN pr ON pr.lang = a.lang AND pr.source = a.source AND pr.item = b.source
  UNION ALL
  SELECT lang, source, 'term', term, {_F} FROM m WHERE n > 0 AND p > q
)
SELECT lang, source, part, item, value::BIGINT AS value, (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item))::INTEGER AS rank
FROM u QUALIFY part = 'pair' OR rank <= {TOP}
"""
}
QUERIES = {"op12_source_divergence": op12_source_divergence}

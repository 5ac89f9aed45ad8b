"""A corpus through toxicity, SimHash near-dedup, mixing and packing, each stage written before the next reads it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from rugosa.llm import common, mixing, packing, shingles, tokens, toxicity

#: Shares of tokens after mixing; every document stays, scarce domains are repeated (up to four times).
MIX = {"good": 0.8, "poor": 0.2}
MIX_LOW, MIX_HIGH, MIX_BUDGET = 1.0, 4.0, 1.1


def toxic_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the factorization machine scores under 0.5."""
    return toxicity.drop_toxic(docs, common.read_table(spark, sf_dir, "labels"))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by a Jaccard similarity of 0.8 or more of five-word shingles: fingerprints' trie first, then what it can't reach."""
    return shingles.drop_near_duplicates(docs, shingle_words=5, least=0.8)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated so that the expected tokens of good and poor ones come nearest to 80 : 20; none is dropped."""
    labels = common.read_table(spark, sf_dir, "labels").where("toxic = 0")
    mixer = mixing.Mixer(docs, labels, MIX, low=MIX_LOW, high=MIX_HIGH, budget_factor=MIX_BUDGET)
    return mixer.mixed(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 2048 ids; a document that mixing repeats is packed as often."""
    return packing.pack(docs, tokens.vocabulary("word_bpe_49k.json"))


STAGES = [("toxicity", toxic_stage), ("simhash_near_dedup", near_dedup_stage), ("mixing", mixing_stage), ("packing", packing_stage)]
#: No stage can be put into SQL: tests hold each against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; the stages' results are Parquet tables in the shared folder."""
    docs = common.read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = common.written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs

"""The corpus pipeline: toxicity filter, SimHash near-dedup, mixing sources to target weights, best-fit packing.

Each stage takes (spark, docs, sf_dir); what it returns is written as Parquet and read again as the next
one's docs. The stages but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from acrelens.llm import op1_simhash, op7_mix, op9_packing, op10_toxicity
from acrelens.llm.shared import settle, table

REJECT = 0.3  # toxicity from which a document goes

#: SQL can't express the toxicity model; tests hold run() against a brute-force version.
ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents whose toxicity is below REJECT; the model learns from labels that aren't held out."""
    model = op10_toxicity.train(docs, table(spark, sf_dir, "labels"))
    return op10_toxicity.score(docs, model).where(F.col("score") < REJECT).select("row.*")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash component: that of the smallest doc_id."""
    return op1_simhash.keep_one(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, as many times as it takes each of them."""
    rows = docs.select(F.struct("*").alias("row"), "source", op7_mix.word_count(F.col("text")).alias("size"), op7_mix.key_of("doc_id").alias("key"))
    out = op7_mix.mix(rows, F.col("key")).where("copies > 0")
    return out.select("row", F.explode(F.sequence(F.lit(1), "copies"))).select("row.*")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each document's words go: pieces, bins and their capacities."""
    return op9_packing.pack_documents(docs)


STAGES = [("toxicity", drop_toxic), ("simhash_near_dedup", drop_near_copies), ("mix_sources", mix_sources), ("best_fit_packing", pack)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = settle(stage(spark, docs, sf_dir), name)
    return docs

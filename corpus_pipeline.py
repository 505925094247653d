"""The corpus pipeline: toxic documents go, one document of each group of near copies stays, personal data become pseudonyms, and what is left is packed.

Each stage is written as Parquet in the shared folder and read again as the next one's documents.

Defined results, in every stage: null and empty texts are kept; rows that repeat a doc_id are judged each for itself, and where they are near copies of each
other or of other documents one row of the group stays; a row without a doc_id stays until packing, which leaves it out; columns besides those of documents are kept up to
packing, whatever their names; an empty table gives an empty table; texts of any length are worked on whole; a document that scores exactly the threshold is toxic.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skeingraph.llm import jaccard, packing, pii, toxicity
from skeingraph.llm.common import table, written


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below the threshold; learns from all labelled documents."""
    return toxicity.filter_toxic(docs, table(spark, sf_dir, "labels"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest id of each component of links."""
    return jaccard.drop_near_copies(docs)


def pseudonymize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with pseudonyms; n_chars counted again."""
    return pii.pseudonymize(docs, spark.conf.get(pii.KEY_CONF, pii.NO_SECRET)).withColumn("n_chars", F.length("text").cast("long"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, piece, start, length, bin_id, offset of every piece of every document. Each document left stands alone in its group of near copies, so clusters are those of exact texts, which repeated wordless texts still form."""
    return packing.pack_documents(docs)


STAGES = [("toxicity", drop_toxic), ("ngram_jaccard_join", drop_near_copies), ("pii", pseudonymize), ("best_fit_packing", pack)]
#: Learnt scores and the order-bound packing are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)

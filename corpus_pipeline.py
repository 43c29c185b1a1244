"""A corpus pipeline of five operators: each stage's rows are written as Parquet and read by the next.

The first four stages return the columns of ``documents``; the last gives every document that is
left its shard.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from needledrop.llm import op1_mixture, op4_decontaminate, op5_orderminhash, op6_compression, op8_kdtree
from needledrop.llm.queries import MIX_SEED, MIX_WEIGHTS, domain_of_source, table
from needledrop.scratch import materialise


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the compression classifier rejects go.

    Null and empty texts have one score, that of the curve at 0; equal texts stay or go together; an empty
    table stays empty; columns beside ``documents``' own stay.
    """
    return op6_compression.keep_good(docs, table(spark, sf_dir, "labels"))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, that of the smallest doc_id.

    Null and empty texts are copies of each other. Of rows equal in id and text one stays; a text of a
    repeated id goes only for a near copy of its own; rows of a null id stay. An empty table stays empty.
    """
    return op5_orderminhash.keep_one(docs, similarity=0.8)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold four fifths of a benchmark item's shingles go.

    Null texts and texts or items of under five words hold nothing and stay; an empty table stays empty.
    """
    return op4_decontaminate.drop_leaks(docs, table(spark, sf_dir, "benchmark"), containment=0.8)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Nine tenths of the tokens stay, shared out by the source tree's weights in one epoch.

    Null domains, languages and sources are nodes of the tree. Texts without a word, null ones too, go, as
    they are no tokens; rows of one id in one leaf go or stay together; an empty table stays empty.
    """
    return op1_mixture.keep_mixture(docs, domain_of_source(), MIX_WEIGHTS, fraction=0.9, seed=MIX_SEED)


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sixteen shards of near equal bytes. Nulls take part like other values; rows are single units; an empty table gives none."""
    return op8_kdtree.shard_documents(docs, n_shards=16)


STAGES = [("quality classifier", quality), ("MinHash near-dedup", near_copies), ("benchmark decontamination", decontamination), ("mixing to target weights", mixture), ("sharding", shards)]

#: The first stage is a trained model, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)

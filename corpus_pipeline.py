"""The corpus pipeline: stages over `documents`, each written as Parquet and read again by the next.

Each filtering stage keeps rows whole, with the columns of documents, whatever
else they are called.  Models are fitted on the stage's own input.  Texts move
between executors in the near-duplicate stage alone; the decontamination stage
moves rows of windows, and texts only if the contaminated ones are too many to be
sent out.

Null and empty texts are scored like others; of all texts without words one stays
after the near-duplicate stage.  Texts of any length are read whole.  Of equal rows
of one id one stays; rows without an id are never taken for copies.  Ties: of a
group of copies the smallest id stays.  Without labels nothing is rejected for
toxicity or quality, without a benchmark nothing for contamination; empty documents
give an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from loomstore.llm import decontaminate, quality, simhash, toxicity
from loomstore.llm.common import materialize, table
from loomstore.llm.queries import bpe_digests


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored 0.3 or more for toxicity go."""
    return toxicity.keep_clean(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored below 0.5 for quality go."""
    return quality.keep_good(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked fingerprints stays, that of the smallest id."""
    return simhash.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a twentieth or more of their words in benchmark windows go."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The result: for each document that is left, digests of its ids and of the text they decode to."""
    return bpe_digests(docs)


STAGES = [("toxicity", drop_toxic), ("quality", keep_quality), ("simhash_near_dedup", near_dedup), ("decontamination", decontamination), ("byte_bpe", tokenize)]

#: SQL cannot express the trained filters and the fingerprints; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, applied to `documents`."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)

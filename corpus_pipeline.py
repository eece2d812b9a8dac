"""From raw documents to token files: five stages, each written and read by the next.

Every stage works on all that the one before kept.  Rejected, repeated and contaminated
documents go; the mixture repeats or cuts documents to reach the weights of the sources;
the last stage encodes what is left.  The tables between stages are Parquet in the shared
folder, so a lost executor costs the tasks of one stage at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from dayplan.llm import mixing, order_minhash, positional_index, quality_rules, token_orc
from dayplan.llm.common import table, vocabulary
from dayplan.sources.staging import stage


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8: documents that the quality rules keep, without the frequent lines of their host."""
    return quality_rules.good_documents(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 9: one document of each class of near-duplicates."""
    return order_minhash.one_of_each_class(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10: documents without benchmark passages."""
    return positional_index.clean_documents(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 2: the documents that the mixture takes, as often as it takes them."""
    return mixing.mixture(docs).select(*docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 3: token files, and what they hold by document."""
    return token_orc.encode_documents(docs, vocabulary())


STAGES = [
    ("quality rules", rules),
    ("MinHash near-dedup", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("mixing sources to target weights", mix),
    ("token-ID / binary output", tokens),
]

#: Order MinHash and the tokenizer are beyond SQL; tests compare with brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, work in STAGES:
        docs = stage(work(spark, docs, sf_dir), name.split()[0].replace("/", "-").lower())
    return docs

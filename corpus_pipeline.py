"""A corpus pipeline: quality rules, near duplicates, secrets, source mix, packed sequences.

Each stage takes (spark, docs, sf_dir), works on all its predecessor kept and returns a DataFrame that
is written as Parquet and read again for the next. All but the last return the columns of docs. A stage
begins by having the executors give back the memory that the one before took.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lodestone.llm import jaccard_join, mixing, packing, quality_rules, secrets
from lodestone.llm.shared import give_back, release, settle


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the weak supervision's posterior keeps."""
    return quality_rules.keep(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that five-word shingles with a similarity of 0.8 or more link."""
    give_back(spark)
    return jaccard_join.keep_one(docs)


def hide_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their secrets replaced."""
    give_back(spark)
    return secrets.redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    give_back(spark)
    return mixing.mix(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each piece of a document in a sequence."""
    import public_tokenizers

    give_back(spark)
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality rules", keep_good),
    ("n-gram jaccard join", drop_near_copies),
    ("secret scans", hide_secrets),
    ("source mixing", mix_sources),
    ("packing", pack_sequences),
]

#: Expectation maximisation, the randomness battery and packing aren't SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for _, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir))
        if before is not None:
            release(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)

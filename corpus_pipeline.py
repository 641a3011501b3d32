"""From raw documents to packed training sequences.

Every stage takes (spark, docs, sf_dir) and works on all that the stage before it kept; all but
the last return the columns of documents. A null or empty text fails the quality rules. After
substring dedup a text may be empty; it is packed as one end token.
"""

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from pagetrove.llm import packing, quality, secrets, simhash, substrings
from pagetrove.session import settle

SHINGLE, RADIUS = 3, 2
TOKENIZER = "byte_bpe_50k.json"


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go."""
    return quality.keep_good(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest id of each group stays."""
    return simhash.keep_one(docs, SHINGLE, RADIUS)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that a document with a smaller id has are cut from the text."""
    return substrings.remove(docs)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced in the text; owners are sources, repositories their languages."""
    return secrets.redact(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per piece with its token ids, its sequence and place."""
    return packing.pack(docs, public_tokenizers.path(TOKENIZER), public_tokenizers.PATTERN)


STAGES = [
    ("quality rules", quality_rules),
    ("SimHash near-dedup", near_dedup),
    ("substring dedup", substring_dedup),
    ("secret scans", secret_scan),
    ("best-fit packing", best_fit_packing),
]

# Fingerprints, ids of a tokenizer and packing are not for SQL; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir), "pipeline-" + name.lower().replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)

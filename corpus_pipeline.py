"""The corpus pipeline: quality rules, exact dedup, near dedup, mixing, encoding.

Every stage takes (spark, docs, sf_dir) and gives a DataFrame, which is written
as Parquet and read again as the next one's ``docs``. All but the last return
the columns of ``documents``, and further columns as they are. Ids may be null
or repeated, texts null, empty or very long, and tables empty; the functions
that the stages call say what becomes of each.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tally.llm import bpe, exact_dedup, jaccard_join, mixing, quality
from tally.llm.common import materialise


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the base rules or the robust outlier test reject; null and empty texts are among them."""
    return quality.quality_filter(docs)


def exact_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that are equal but for the case of A-Z the row with the largest id stays; null texts are equal to empty ones."""
    return exact_dedup.exact_dedup_filter(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document stays of each group linked by a Jaccard similarity of 0.8 or more of five-word shingles; texts without words all stay."""
    return jaccard_join.near_dup_filter(docs, k=5, num=80, den=100)


def mix_to_targets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their mixing rates say; those most likely clean are not cut, nothing is repeated, and what the rates cannot reach is warned of."""
    return mixing.mix(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), whole="clean")


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of each document's byte-level BPE round trip."""
    import public_tokenizers

    return bpe.round_trip(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("quality rules", quality_rules),
    ("exact dedup", exact_duplicates),
    ("n-gram Jaccard join", near_duplicates),
    ("mixing to target weights", mix_to_targets),
    ("byte-level BPE", encode),
]

#: The robust estimate, the components and the solver are iterative: no SQL for them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
    return docs

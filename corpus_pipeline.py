"""A training corpus from raw documents, in five stages.

Language identification drops null texts and texts without a letter (all texts
where no language was learned); others stay, as the nearest learned language,
also where their own was not learned. Near-duplicate
grouping leaves one document of each group; decontamination drops documents
with benchmark passages; the secret scan masks secrets; mixing gives what each
document contributes to the mix of sources.

Every stage gets all rows that its predecessor kept, as a written table, so a
lost executor costs no more than the running stage's tasks. Intermediate files
of a stage are deleted when the next one begins.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tessera.llm import decontaminate, language, mixing, neardup, scratch, secrets
from tessera.shipping import ship


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents whose text has a letter, where the corpus's labels teach some language."""
    ship(spark)
    with scratch.step(spark, "pipeline"):
        return language.known_language(docs, language.train(docs, F.lit(True)))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each group of near duplicates."""
    ship(spark)
    with scratch.step(spark, "pipeline"):
        return neardup.deduplicate(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a window of a benchmark item."""
    ship(spark)
    with scratch.step(spark, "pipeline"):
        return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Masks secrets in the texts; every document stays."""
    with scratch.step(spark, "pipeline"):
        return secrets.redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the mix takes of each document: doc_id, size, source_size, target, taken."""
    with scratch.step(spark, "pipeline"):
        return mixing.taken(docs)


STAGES = [
    ("language", identify_language),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("secrets", mask_secrets),
    ("mixing", mix_sources),
]

#: near-duplicate groups, the language model and the forest have no SQL form; tests compare with brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each but the last is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = scratch.table(docs, name)
    return docs

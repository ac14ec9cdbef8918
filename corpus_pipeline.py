"""From raw documents to token files in five stages, each over all that the one before has kept.

toxicity -> near duplicates -> benchmark passages -> mix of sources -> token files.
Every stage but the last returns rows of ``documents``; the mix repeats a row as
often as it is taken.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tracewell.llm import mixing, nearcopies, tokens, toxicity, winnowing
from tracewell.llm.common import cut_lineage, read


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents the classifier rejects go; null and empty texts, repeated rows and null ids are judged like any other."""
    return toxicity.without_toxic(docs, toxicity.fit(docs, read(spark, sf_dir, "labels")))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that share 0.8 of their 5-word shingles with an earlier row that stays go; null and empty texts are copies of each other."""
    return nearcopies.one_of_each(docs)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows without a benchmark window stay; null and empty texts have no words and stay."""
    return winnowing.without_benchmark(docs, read(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows as often as the mix takes them; null sources are a source of their own, empty texts weigh nothing."""
    return mixing.mixed(docs)


def write_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per row of the mix from the written files, in ascending id order; null texts count as empty."""
    import public_tokenizers

    return tokens.token_files(docs, public_tokenizers.path("byte_bpe_50k.json")).select("doc_id", "start", "n_tokens", "ids_crc32")


STAGES = [
    ("toxicity", reject_toxic),
    ("near_copies", drop_near_copies),
    ("benchmark", drop_benchmark),
    ("mix", mix_sources),
    ("tokens", write_ids),
]
ORACLE_SQL = None  # no SQL for classifier, fingerprints and draws; the tests check columns, rows kept and counts


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut_lineage(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)

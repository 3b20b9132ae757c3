"""The corpus pipeline: toxic documents go, one of each group of near duplicates stays, documents with benchmark items go, sources are
mixed to their weights, and what is left is written as token ids.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes each stage's result as Parquet in the shared folder and
reads it again for the next.  All stages but the last return the columns of documents.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from wakeline.llm import decontaminate, jaccard_join, mixing, token_store, toxicity
from wakeline.llm.scratch import shared_folder


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def toxic_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose probability of any severity reaches a half go."""
    return toxicity.not_toxic(docs, _table(spark, sf_dir, "labels"))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked at a Jaccard similarity of 0.8 on five-word shingles, the document of smallest doc_id stays."""
    return jaccard_join.one_of_each(docs, n=5, percent=80)


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item at a containment of 0.8 on five-word shingles go."""
    return decontaminate.clean_documents(docs, _table(spark, sf_dir, "benchmark"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows as often as the mix takes them: weights 3, 1, 2 by source, 150 % of all words, at most two epochs."""
    return mixing.repeat_documents(docs, mixing.mix(docs))


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids in Arrow files in the shared folder; a row per document with its place, length and checksum, read from them."""
    import public_tokenizers

    return token_store.encode(docs, tokenizer=public_tokenizers.path("byte_bpe_50k.json"), added_tokens=True)


STAGES = [
    ("toxicity", toxic_stage),
    ("near_duplicates", near_duplicate_stage),
    ("benchmark", benchmark_stage),
    ("mixing", mixing_stage),
    ("tokens", token_stage),
]

#: A trained model, a similarity join and a tokenizer are beyond SQL; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex[:12]}"
    for k, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        out.write.parquet(f"{folder}/{k}-{name}")
        docs = spark.read.schema(out.schema).parquet(f"{folder}/{k}-{name}")
    return docs

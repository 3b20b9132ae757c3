"""The registered queries opN_<name>: each applies its operator, with production parameters, to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op2_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many words the mix takes of each document."""
    from wakeline.llm.mixing import mix

    out = mix(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "source_size", "target", "taken", "source", "epochs")


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The benchmark items that each document holds at a containment of 0.8 or more of their five-word shingles."""
    from wakeline.llm.decontaminate import contaminated

    return contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), without_id=True)


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of each document without the 100-byte strings that start earlier too."""
    from wakeline.llm.suffix_dedup import remove_repeats

    return remove_repeats(_table(spark, sf_dir, "documents")).drop("kept")


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected severity, grade and verdict for each document."""
    from wakeline.llm.toxicity import fit, score

    docs = _table(spark, sf_dir, "documents")
    return score(docs, fit(docs, _table(spark, sf_dir, "labels")))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule counts, base rules and verdict for each document."""
    from wakeline.llm.quality_rules import judge

    out = judge(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "p_good")


def op8_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The near-duplicate group of each document: four-word shingles, Jaccard 0.85."""
    from wakeline.llm.jaccard_join import near_duplicates

    out = near_duplicates(_table(spark, sf_dir, "documents"), n=4, percent=85)
    return out.select("doc_id", "n_shingles", "component_id", "class_id")


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The licence notices in each document."""
    from wakeline.llm.license_scan import background_sample, scan, train

    docs = _table(spark, sf_dir, "documents")
    return scan(docs, train(background_sample(docs)))


def op6_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Place, length and checksum of each document's ids, read from the files written."""
    import public_tokenizers

    from wakeline.llm.token_store import encode

    return encode(_table(spark, sf_dir, "documents"), tokenizer=public_tokenizers.path("byte_bpe_50k.json"), added_tokens=True)


def op9_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The article of each page."""
    from wakeline.llm.html_wrapper import main_text

    return main_text(_table(spark, sf_dir, "pages"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of each document."""
    from wakeline.llm.language_id import fit, predict

    docs = _table(spark, sf_dir, "documents")
    return predict(docs, fit(docs))


def op11_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest found of every twentieth embedding."""
    from wakeline.llm.projection_forest import nearest

    return nearest(_table(spark, sf_dir, "embeddings"))


def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each embedding on the 16 leading components of the covariance, with unit variance."""
    from wakeline.llm.whitening import whiten

    return whiten(_table(spark, sf_dir, "embeddings"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every fiftieth embedding; every seventh row has the next label."""
    from wakeline.llm.hard_negatives import mine

    rows = _table(spark, sf_dir, "embeddings")
    return mine(rows.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages of corpus_pipeline.py, one after another."""
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    f.__name__: f
    for f in (op1_license_scan, op2_source_mix, op3_decontamination, op4_suffix_dedup, op5_toxicity, op6_token_store, op7_quality_rules, op8_ngram_jaccard_join, op9_main_text, op10_language_id, op11_nearest_neighbours, op12_embedding_whitening, op13_hard_negatives, pipeline)
}

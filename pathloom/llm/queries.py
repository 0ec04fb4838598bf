"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pathloom.llm import (
    decontaminate, fill_in_middle, language_model, mixing, ngram_join, quality_classifier, quality_rules, sanitise, substring_dedup,
    suffix_array, tool_calls, toxicity, whitening,
)
from pathloom.llm.oracles import ORACLES  # noqa: F401  read by the driver contract


def bounded_batches(spark: SparkSession) -> None:
    """Texts differ in length by orders of magnitude: short Arrow batches keep a worker's memory bounded."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{str(sf_dir).rstrip('/')}/{name}.parquet")


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    bounded_batches(spark)
    return _table(spark, sf_dir, "documents")


def op1_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir).select("doc_id", "text", "source")
    keep = docs.select("doc_id", "source", F.col("text"))
    mixed = mixing.mix(keep)
    return mixed.select(
        "doc_id", F.col("_words").alias("size"), F.col("_source_words").alias("source_size"), F.col("_target").alias("target"),
        (F.col("_words") * F.col("_copies")).alias("taken"),
    )


def op2_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_groups(_documents(spark, sf_dir)).select("doc_id", "n_shingles", "component_id")


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = substring_dedup.repeated_words_removed(_documents(spark, sf_dir))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.repetition_rules(_documents(spark, sf_dir))


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = quality_classifier.quality_scores(_documents(spark, sf_dir), _table(spark, sf_dir, "labels"))
    return scored.select("doc_id", "held_out", "score", "predicted")


def op6_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = suffix_array.repeated_bytes_removed(_documents(spark, sf_dir))
    spans = F.size("spans").cast("long").alias("n_spans")
    return kept.select("doc_id", "n_bytes", "n_removed", spans, F.sha2("kept", 256).alias("kept_sha256"))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.find_contamination(_documents(spark, sf_dir), _table(spark, sf_dir, "benchmark"))
    items = F.sha2(F.array_join("items", ","), 256).alias("items_sha256")
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), items, "contaminated")


def op8_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls, results = tool_calls.turns_as_calls(_table(spark, sf_dir, "conversations"))
    return tool_calls.format_calls(calls, results, tool_calls.REPLY).unionByName(tool_calls.unlinked_results(calls, results))


def op9_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_model.score_documents(_documents(spark, sf_dir))


def op10_pii_sanitisation(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sanitise.find_private(_documents(spark, sf_dir))
    kinds = F.transform("base", lambda s: s["kind"])
    counts = [(F.size("base") - F.size(F.array_remove(kinds, i))).cast("long").alias(f"n_{k}") for i, k in enumerate(sanitise.KINDS[:4])]
    return found.select("doc_id", *counts, F.sha2(sanitise.shown(F.col("base")), 256).alias("base_sha256"), sanitise.shown(F.col("spans")).alias("spans"))


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fill_in_middle.fill_in_middle(_documents(spark, sf_dir))
    digests = F.sha2("output", 256).alias("output_sha256"), F.sha2(fill_in_middle.restored(), 256).alias("restored_sha256")
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", *digests)


def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(_table(spark, sf_dir, "embeddings"))


def op13_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = toxicity.toxicity_scores(_documents(spark, sf_dir), _table(spark, sf_dir, "labels"))
    spans = F.array_join(F.transform("spans", lambda s: F.concat_ws(":", s["start"], s["end"])), ",")
    return scored.select("doc_id", "held_out", "score", "predicted", spans.alias("spans"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_source_mixing, op2_ngram_jaccard_join, op3_substring_dedup, op4_quality_rules, op5_quality_classifier,
        op6_suffix_array_dedup, op7_decontamination, op8_chat_formatting, op9_language_model, op10_pii_sanitisation, op11_fill_in_middle,
        op12_embedding_whitening, op13_toxicity,
    )
}

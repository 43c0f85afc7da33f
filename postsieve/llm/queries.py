"""The operators of this folder as queries over the standard tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postsieve.llm import arrays, compression, conversations, decontamination, grid_join, language, licences, lines, manifest, near_duplicates, packing, passages, private, quality, sharding


def _table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return arrays.prepare(spark).read.parquet(f"{sf}/{name}.parquet")


def _docs(spark: SparkSession, sf: str) -> DataFrame:
    return _table(spark, sf, "documents")


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_licences(spark: SparkSession, sf: str) -> DataFrame:
    found = licences.licence_matches(_docs(spark, sf))
    return found.select(
        "doc_id",
        "licence",
        F.round("dice", 6).alias("dice"),
        F.size("matches").cast("bigint").alias("n_matches"),
        F.transform("matches", lambda m: m["line"]).cast("string").alias("lines"),
        F.size("passages").cast("bigint").alias("n_passages"),
        F.transform("passages", lambda p: F.concat_ws(":", p["licence"], p["start"], p["words"])).cast("string").alias("passages"),
    )


def op2_packing(spark: SparkSession, sf: str) -> DataFrame:
    return packing.pack(_docs(spark, sf), vocabulary())


def op3_near_duplicates(spark: SparkSession, sf: str) -> DataFrame:
    found = near_duplicates.near_duplicates(_docs(spark, sf))
    return found.select("doc_id", "n_shingles", "component_id", "kept")


def op4_personal_data(spark: SparkSession, sf: str) -> DataFrame:
    return private.digest(private.personal_data(_docs(spark, sf)))


def op5_hilbert_shards(spark: SparkSession, sf: str) -> DataFrame:
    return sharding.shard_documents(_docs(spark, sf))


def _without_spans(found: DataFrame) -> DataFrame:
    spans = F.transform("removed", lambda s: F.concat_ws(":", s["start"], s["end"]))
    return found.select(
        "doc_id", "text", F.size("removed").cast("bigint").alias("n_removed"), F.array_join(spans, ",").alias("removed")
    )


def op6_line_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return _without_spans(lines.dedup_lines(_docs(spark, sf)))


def op6_passage_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return _without_spans(passages.dedup_passages(_docs(spark, sf)))


def op7_decontamination(spark: SparkSession, sf: str) -> DataFrame:
    return decontamination.decontaminate(_docs(spark, sf), _table(spark, sf, "benchmark")).drop("text_key")


def op8_decision_list(spark: SparkSession, sf: str) -> DataFrame:
    judged = quality.judge(_docs(spark, sf), _table(spark, sf, "labels"))
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule"
    )


def op9_language(spark: SparkSession, sf: str) -> DataFrame:
    return language.identify(_docs(spark, sf))


def op10_code_length(spark: SparkSession, sf: str) -> DataFrame:
    return compression.score_documents(_docs(spark, sf))


def op11_conversations(spark: SparkSession, sf: str) -> DataFrame:
    return conversations.repair_damaged(_table(spark, sf, "conversations"))


def op12_manifest(spark: SparkSession, sf: str) -> DataFrame:
    return manifest.tampered_manifest(_docs(spark, sf))


def op13_grid_join(spark: SparkSession, sf: str) -> DataFrame:
    return grid_join.near_vectors(_table(spark, sf, "embeddings"))


QUERIES = [
    op1_licences,
    op2_packing,
    op3_near_duplicates,
    op4_personal_data,
    op5_hilbert_shards,
    op6_passage_dedup,
    op6_line_dedup,
    op7_decontamination,
    op8_decision_list,
    op9_language,
    op10_code_length,
    op11_conversations,
    op12_manifest,
    op13_grid_join,
]


def queries() -> dict:
    return {q.__name__: q for q in QUERIES}

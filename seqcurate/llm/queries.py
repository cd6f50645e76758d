"""Queries of the text operators over the given tables, and their SQL where it can say the same."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqcurate.llm import bpe, decontam, lid, lines, merkle, minhash, mixing, pii, quality, repair, rules, toxicity, whitening
from seqcurate.llm.common import fold, table


def _held_out(parts: int, remainder: int):
    """True for the rows whose labels no model sees; a null id is never held out."""
    return F.coalesce(fold(F.col("doc_id"), parts) == remainder, F.lit(False))


def op1_circulant_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality.train(docs, table(spark, sf_dir, "labels"), ~_held_out(4, 2))
    scored = quality.score(docs, model, ["doc_id"])
    return scored.select("doc_id", _held_out(4, 2).alias("held_out"), "score", (F.col("score") >= quality.CUT).cast("int").alias("predicted"))


def op3_disclosure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(table(spark, sf_dir, "documents").select("doc_id", "text"), ["doc_id"])


def op4_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.fingerprints(table(spark, sf_dir, "documents"))


def op5_pfair_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.schedule(table(spark, sf_dir, "documents"))


def op6_language_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = lid.predict(docs, lid.train(docs, ~_held_out(3, 1)), ["doc_id"])
    return found.select("doc_id", _held_out(3, 1).alias("held_out"), "lang_pred", "score", "languages", "shares")


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.json")
    rows = bpe.encode(table(spark, sf_dir, "documents").select("doc_id", "text"), path, decoded="decoded")
    return rows.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op8_fuzzy_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op9_line_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.clean(table(spark, sf_dir, "documents"), ["doc_id"]).drop("clean_text")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = toxicity.score(docs, toxicity.train(docs, table(spark, sf_dir, "labels"), ~_held_out(5, 0)), ["doc_id"])
    return scored.select(
        "doc_id", _held_out(5, 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "evidence"
    )


def op11_feast_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def op12_prefix_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), ["doc_id"])
    return found.select(
        "kept.doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def op13_cyk_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    return repair.report(repair.damage(rows), rows)


QUERIES = {f.__name__: f for f in (op1_circulant_minhash, op2_quality_classifier, op3_disclosure, op4_merkle, op5_pfair_mixing, op6_language_mixture, op7_bpe, op8_fuzzy_lines, op9_line_rules, op10_toxicity, op11_feast_whitening, op12_prefix_join, op13_cyk_repair)}
ORACLES: dict[str, str] = {"op9_line_rules": rules.SQL, "op12_prefix_join": decontam.SQL, "op13_cyk_repair": repair.SQL}

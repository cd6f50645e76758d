"""Columns of the documents that are called as something inside an operator."""

import corpus_pipeline
from pyspark.sql import functions as F
from seqcurate.llm import lines


def test_line_dedup_keeps_clashing_columns(odd_docs):
    given = odd_docs.withColumns({c: F.concat(F.lit(f"{c}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("-"))) for c in ("_gone", "_doc_id", "_text_hash", "_made", "__made")})
    got = lines.dedup(given)
    assert got.columns == [*given.columns, "n_lines", "n_removed", "emptied"]
    for r in got.collect():
        assert all(r[c] == f"{c}:{'-' if r['doc_id'] is None else r['doc_id']}" for c in ("_gone", "_doc_id", "_text_hash", "_made", "__made"))


def test_quality_stage_with_a_score(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    plain = corpus_pipeline.quality_stage(spark, docs, sf_dir)
    got = corpus_pipeline.quality_stage(spark, docs.withColumn("_score", F.lit("x")), sf_dir)
    assert got.columns == [*docs.columns, "_score"] and got.count() == plain.count()

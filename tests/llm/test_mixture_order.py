"""The order of the mixture reaches the encoded documents."""

import corpus_pipeline
from pyspark.sql import functions as F

from seqcurate.llm import mixing
from seqcurate.session import stage


def test_position_follows_the_slots(spark):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), F.col("id").cast("string")).alias("text"), F.concat(F.lit("s"), F.pmod(F.col("id") * 7, F.lit(10)).cast("string").substr(1, 1)).alias("source"))
    docs = docs.withColumn("source", F.when(F.col("source") < "s7", "big").otherwise(F.col("source")))
    slots = {r["doc_id"]: r["slot"] for r in mixing.schedule(docs).collect()}
    mixed = stage(corpus_pipeline.mixing_stage(spark, docs, ""), "test-mixing")
    got = {r["doc_id"]: r["position"] for r in corpus_pipeline.encoding_stage(spark, mixed, "").collect()}
    assert sorted(got.values()) == list(range(3000))
    assert sorted(got, key=got.get) == sorted(slots, key=lambda i: (slots[i], i))
    plain = {r["doc_id"]: r["position"] for r in corpus_pipeline.encoding_stage(spark, stage(docs, "test-plain"), "").collect()}
    assert sorted(plain.values()) == list(range(3000)) and plain != got


def test_documents_in_no_file_or_none_at_all(spark):
    docs = spark.createDataFrame([(1, "a b", 5), (2, None, 6), (None, "", 7)], "doc_id long, text string, position int")
    got = corpus_pipeline.encoding_stage(spark, docs, "").collect()
    assert sorted(r["position"] for r in got) == [0, 1, 2]
    assert corpus_pipeline.encoding_stage(spark, docs.where("false"), "").count() == 0

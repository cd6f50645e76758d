"""A corpus from raw documents to token ids.

Each stage reads the documents its predecessor kept and decides on all of them:

quality   drops what the classifier, learned from ``labels``, scores below its cut
lines     removes all but one of similar lines; a document left without a line goes
near      keeps one document of each group of near-duplicates
mixing    puts all documents in the order of the mixture
encoding  adds the token ids, their number, the text that they decode to and the document's place in the mixture
"""

from __future__ import annotations

import public_tokenizers
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from seqcurate.llm import bpe, lines, minhash, mixing, quality
from seqcurate.llm.common import join_lookup, stage, table, unused

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A null or empty text scores the share of good rows and stays if that share reaches the cut."""
    model = quality.train(docs, table(spark, sf_dir, "labels"), F.lit(True))
    score = unused("_score", *docs.columns)
    return quality.score(docs, model, docs.columns, score).where(F.col(score) >= quality.CUT).drop(score)


def lines_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """n_chars follows the new text."""
    cleaned = lines.dedup(docs).where(~F.col("emptied"))
    if "n_chars" in docs.columns:
        cleaned = cleaned.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return cleaned.select(*[F.col(f"`{c}`") for c in docs.columns])


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not the first of their group go; rows without an id stay."""
    gone = minhash.near_duplicates(docs).where(~F.col("kept")).select("doc_id").distinct()
    return join_lookup(docs, gone, "doc_id", "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, ordered by slot over the written files."""
    placed = mixing.place(docs).select("_doc", F.col("slot").alias("_slot"))
    return placed.repartitionByRange("_slot").sortWithinPartitions("_slot", "_doc.doc_id").select("_doc.*")


def in_written_order(docs: DataFrame) -> DataFrame:
    """Adds ``position``, which rises along the rows of the files that hold the documents, file by file.

    Only one row a file meets the others: the rows of the files before it. Documents that are in no file are written first.
    """
    file, row = unused("_file", *docs.columns), unused("_row", *docs.columns)
    place = [F.col("_metadata.file_path").alias(file), F.col("_metadata.row_index").alias(row)]
    docs = docs.drop("position")
    try:
        rows = docs.select("*", *place)
    except AnalysisException:
        rows = stage(docs, "ordered").select("*", *place)
    ends = rows.groupBy(file).agg((F.max(row) + 1).alias("_n"))
    before = F.sum("_n").over(Window.orderBy(file).rowsBetween(Window.unboundedPreceding, -1))
    first = ends.select(file, F.coalesce(before, F.lit(0)).alias("_first"))
    placed = rows.join(F.broadcast(first), file).withColumn("position", F.col("_first") + F.col(row))
    return placed.drop(file, row, "_first")


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with ids, n_tokens, decoded and position, which replace given columns of these names.

    Tasks read files in any order, so position is what keeps the order of the mixture.
    """
    docs = in_written_order(docs).drop("n_tokens")
    encoded = bpe.encode(docs, public_tokenizers.path("byte_bpe_50k.json"), decoded="decoded")
    return encoded.withColumn("n_tokens", F.size("ids").cast("long"))


STAGES = [
    ("quality", quality_stage),
    ("lines", lines_stage),
    ("near", near_stage),
    ("mixing", mixing_stage),
    ("encoding", encoding_stage),
]
#: Learned vectors, signatures and encoding are beyond SQL; the tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result is written and read again as the next one's input."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, apply) in enumerate(STAGES):
        docs = apply(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = stage(docs, f"corpus-{name}")
    return docs

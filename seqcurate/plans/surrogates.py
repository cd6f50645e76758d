"""Views with the engine's table shapes over the given star-schema and text tables.

Samples, sequences and subjects come from documents, events, conversations and embeddings;
every row of the source table is used. Deep inputs (positions, peaks) are staged once per
session and folder and shared by the queries, until ``forget`` or ``session.release_staged``; call one of them when
the tables of a folder have changed.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas as S
from ..functions import ids
from ..operators import blocks, dedupe, labels, signal, splits
from ..session import generation, stage

KEYS = ["sequence_id"]
ORDER = "frame_index"
VERSION = "v1"
_SHARED: dict[tuple, DataFrame] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared(spark: SparkSession, sf_dir: str, name: str, build) -> DataFrame:
    key = (generation(spark), sf_dir, name)
    if key not in _SHARED:
        _SHARED[key] = build()
    return _SHARED[key]


def forget() -> None:
    """Drop the shared tables, so the next query builds its inputs again."""
    _SHARED.clear()


# --- manifest: documents with labels ------------------------------------------------------


def raw_manifest(spark, sf_dir) -> DataFrame:
    """One row per document; frame numbers have gaps."""
    docs = table(spark, sf_dir, "documents")
    marks = table(spark, sf_dir, "labels")
    turn = F.pmod("doc_id", F.lit(4)).cast("int")
    subject = ids.namespaced("lang", "source")
    path = F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt"))
    letters = F.regexp_replace(F.lower("text"), "[^a-z]", "")
    label = S.phase_name(F.col("quality") + 2 * F.col("toxic"))
    rows = docs.join(marks, "doc_id", "left").withColumn("relative_path", path)
    return rows.select(
        "doc_id",
        ids.sample_id(F.col("lang"), F.col("relative_path")).alias("sample_id"),
        F.col("lang").alias("dataset"),
        subject.alias("subject_id"),
        ids.namespaced(subject, F.concat(F.lit("v"), turn.cast("string"))).alias("sequence_id"),
        F.element_at(F.array(*[F.lit(p + "00") for p in S.CONDITION_FAMILIES]), turn + 1).alias("condition"),
        F.concat(F.lit("v"), turn.cast("string")).alias("view"),
        F.col("doc_id").alias("frame_index"),
        F.lit(None).cast("string").alias("cycle_id"),
        F.when(F.pmod("doc_id", F.lit(13)) != 0, F.pmod("doc_id", F.lit(100)) / F.lit(100.0)).alias("cycle_position"),
        "relative_path",
        F.sha2("text", 256).alias("sha256"),
        F.substring(F.sha2(letters, 256), 1, 16).alias("perceptual_hash"),
        label.alias("legacy_label"),
        F.lit(None).cast("string").alias("annotator_1_label"),
        F.lit(None).cast("string").alias("annotator_2_label"),
        label.alias("adjudicated_label"),
        F.when(F.pmod("doc_id", F.lit(10)) == 0, "low").otherwise("medium").alias("annotation_confidence"),
        F.when(F.pmod("doc_id", F.lit(37)) == 0, "unreadable").alias("exclusion_reason"),
        F.col("n_chars").alias("size_bytes"),
    )


def catalogue(spark, sf_dir) -> DataFrame:
    """The manifest with its content hashes, staged: texts are read and hashed once."""
    return shared(spark, sf_dir, "catalogue", lambda: stage(raw_manifest(spark, sf_dir), "catalogue"))


def grouped(spark, sf_dir) -> DataFrame:
    return dedupe.assign_groups(catalogue(spark, sf_dir))


def manifest(spark, sf_dir) -> DataFrame:
    """Catalogue with duplicate groups, cross-subject exclusions, splits and folds, staged."""
    build = lambda: stage(splits.make_subject_splits(grouped(spark, sf_dir)), "manifest")
    return shared(spark, sf_dir, "manifest", build)


#: Letter distances whose counts are compared: 25 + 24 + 15 = 64 bits.
SKETCH = ((1, 25), (2, 24), (3, 15))


def sketches(spark, sf_dir) -> DataFrame:
    """A 64-bit sketch of each document: which of two letters is the more frequent. Close texts differ in few bits.

    Staged: the letters of a text are counted once, for the groups and for what is joined to them.
    """
    return shared(spark, sf_dir, "sketches", lambda: stage(_sketches(spark, sf_dir), "sketches"))


def _letters(texts: pd.Series) -> pd.Series:
    """How often a to z occur in each text of bytes."""
    piece = lambda text, at: np.bincount(np.frombuffer(text, np.uint8, min(len(text) - at, 1 << 20), at), minlength=256)[97:123]
    return pd.Series([sum((piece(t, at) for at in range(0, len(t), 1 << 20)), np.zeros(26, np.int64)) for t in texts])


def _sketches(spark, sf_dir) -> DataFrame:
    text = F.lower(F.coalesce("text", F.lit(""))).cast("binary")
    often = F.pandas_udf(_letters, "array<bigint>")(text)
    rows = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", often.alias("_n"))
    bits = [F.when(F.get("_n", F.lit(i)) > F.get("_n", F.lit(i + step)), "1").otherwise("0") for step, n in SKETCH for i in range(n)]
    return rows.select(
        F.col("doc_id").cast("string").alias("sample_id"),
        F.col("lang").alias("dataset"),
        ids.namespaced("lang", "source").alias("subject_id"),
        ids.namespaced("lang", "source").alias("sequence_id"),
        F.lower(F.lpad(F.conv(F.concat(*bits), 2, 16), 16, "0")).alias("sketch"),
    )


# --- signal: events in time order per user ------------------------------------------------


def signal_frames(spark, sf_dir) -> DataFrame:
    return shared(spark, sf_dir, "signal", lambda: stage(_signal_frames(spark, sf_dir), "signal"))


def _signal_frames(spark, sf_dir) -> DataFrame:
    events = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "value")
    user = F.col("user_id").cast("string")
    subject = F.concat(F.lit("ev:"), user)
    # A user's events are numbered hour by hour, so one with very many is many groups.
    slot = F.datediff("ts", F.lit("1970-01-01").cast("date")) * 24 + F.hour("ts")
    rows = blocks.rank(events, ["user_id"], ["ts", "event_id"], slot, ORDER)
    turn = F.pmod("user_id", F.lit(4)).cast("int")
    feature = (
        F.when(F.pmod("user_id", F.lit(10)) == 0, F.lit(0.5))
        .when(F.pmod("event_id", F.lit(11)) == 0, F.lit(None))
        .otherwise(F.col("value") / F.lit(100.0))
    )
    rows = rows.select(
        "event_id",
        F.concat(F.lit("s"), F.col("event_id").cast("string")).alias("sample_id"),
        F.concat(F.lit("ds"), F.pmod("user_id", F.lit(2)).cast("string")).alias("dataset"),
        subject.alias("subject_id"),
        F.concat(subject, F.lit(":walk")).alias("sequence_id"),
        F.element_at(F.array(*[F.lit(p + "00") for p in S.CONDITION_FAMILIES]), turn + 1).alias("condition"),
        ORDER,
        F.concat(F.lit("frames/"), F.col("event_id").cast("string"), F.lit(".PNG")).alias("relative_path"),
        F.when(F.pmod("event_id", F.lit(97)) == 0, "sensor_dropout").alias("exclusion_reason"),
        feature.alias("feature"),
    )
    return rows.join(splits.subject_table(rows), ["dataset", "subject_id"])


def peaks(spark, sf_dir) -> DataFrame:
    build = lambda: signal.contact_peaks(signal_frames(spark, sf_dir), KEYS, ORDER, "feature")
    return shared(spark, sf_dir, "peaks", build)


def default_step():
    return S.by_prefix(F.col("condition"), S.EXPECTED_STEP_FRAMES, S.DEFAULT_STEP_FRAMES)


def stats(spark, sf_dir) -> DataFrame:
    frames = signal_frames(spark, sf_dir)
    return labels.sequence_stats(frames, peaks(spark, sf_dir), KEYS, ORDER, "feature", default_step())


def located(spark, sf_dir) -> DataFrame:
    frames = signal_frames(spark, sf_dir)
    return labels.locate(frames, peaks(spark, sf_dir), stats(spark, sf_dir), KEYS, ORDER)


def all_labels(spark, sf_dir) -> DataFrame:
    """Labels of every frame, staged: the input of preparation and evaluation."""
    build = lambda: stage(_all_labels(spark, sf_dir), "labels")
    return shared(spark, sf_dir, "labels", build)


def _all_labels(spark, sf_dir) -> DataFrame:
    out = labels.assign(located(spark, sf_dir), ORDER, VERSION)
    kept = ["event_id", "exclusion_reason", "cell_start", "cell_end", "first_frame", "last_frame"]
    return out.select(*S.LABEL_COLUMNS, *kept)


def frame_labels(spark, sf_dir) -> DataFrame:
    return all_labels(spark, sf_dir).filter("exclusion_reason is null")


def boundaries(spark, sf_dir) -> DataFrame:
    return labels.boundaries(all_labels(spark, sf_dir), KEYS, version=VERSION)


# --- predictions: labels with deterministic mistakes --------------------------------------

VARIANTS = {"base": (7, 13), "wide": (5, 11)}


def predictions(spark, sf_dir, variant: str = "base") -> DataFrame:
    return _predict(frame_labels(spark, sf_dir), variant)


def _predict(rows: DataFrame, variant: str) -> DataFrame:
    one, two = VARIANTS[variant]
    shift = (
        F.when(F.pmod("event_id", F.lit(one)) == 0, 1).when(F.pmod("event_id", F.lit(two)) == 0, 2).otherwise(0)
    )
    return rows.select(
        "event_id",
        *S.PREDICTION_COLUMNS[:6],
        F.col("phase_label").alias("y_true"),
        S.phase_name(F.pmod(F.col("phase_index") + shift, F.lit(4))).alias("y_pred"),
        F.col("annotation_source").alias("label_source"),
        "annotation_version",
        F.col("confidence").alias("annotation_confidence"),
        "split",
        "fold",
        "cycle_position",
        (F.pmod(F.col("event_id") * 37, F.lit(100)) / F.lit(100.0)).alias("boundary_probability"),
    )


def runs(spark, sf_dir) -> DataFrame:
    """Development predictions of all variants, one row per (variant, sample)."""
    rows = frame_labels(spark, sf_dir).filter("split = 'development'")
    parts = [_predict(rows, v).withColumn("variant", F.lit(v)) for v in VARIANTS]
    return parts[0].unionByName(parts[1])


def human_boundaries(spark, sf_dir) -> DataFrame:
    """Two annotators: the machine's cycles, and the same with inner marks moved where order allows."""
    cycles = boundaries(spark, sf_dir)
    start, a, b, c, stop = (F.col(m) for m in S.MACHINE_MARKS)
    move = F.pmod(F.split("subject_id", ":")[1].cast("bigint"), F.lit(3)) - 1
    step = F.when((a + move > start) & (c + move < stop), move).otherwise(0)
    side = lambda who, by: F.struct(
        *[v.alias(h) for h, v in zip(S.HUMAN_MARKS, (start, a + by, b + by, c + by, stop))], F.lit(who).alias("annotator_id")
    )
    both = F.explode(F.array(side("annotator_1", F.lit(0)), side("annotator_2", step))).alias("side")
    rows = cycles.select(*S.MACHINE_BOUNDARY_COLUMNS[:4], "confidence", both)
    return rows.select(*S.MACHINE_BOUNDARY_COLUMNS[:4], "side.*", "confidence", F.lit("").alias("notes"))


# --- turns, vectors, curves, snapshots, inventory -----------------------------------------


def turns(spark, sf_dir) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    return rows.select(
        F.concat_ws("-", "conv_id", "turn").alias("sample_id"),
        F.col("conv_id").cast("string").alias("sequence_id"),
        F.col("turn").alias("frame_index"),
        F.col("role").alias("target_label"),
    )


def snapshot(spark, sf_dir, side: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    path = F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt"))
    # Sides a and b lack different documents, so that there are differences; "all" has every one.
    kept = docs if side == "all" else docs.filter(F.pmod("doc_id", F.lit(10)) != (0 if side == "a" else 1))
    text = F.col("text")
    if side == "b":
        text = F.when(F.pmod("doc_id", F.lit(7)) == 0, F.concat(text, F.lit("!"))).otherwise(text)
    return kept.select(
        "doc_id",
        path.alias("path"),
        "lang",
        "source",
        F.col("n_chars").alias("size_bytes"),
        F.sha2(text, 256).alias("sha256"),
    )


def inventory(spark, sf_dir) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(
        F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("path"),
        F.lit("document").alias("category"),
        F.lit(".txt").alias("extension"),
        F.col("n_chars").alias("size_bytes"),
    )
    pages = table(spark, sf_dir, "pages").select(
        F.col("url").alias("path"),
        F.lit("page").alias("category"),
        F.lit(".html").alias("extension"),
        F.length("html").cast("bigint").alias("size_bytes"),
    )
    return docs.unionByName(pages)

"""Deterministic, balanced selection of sequences for annotation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import schemas as S
from ..functions import ids
from . import splits

FAMILIES = tuple(S.CONDITION_FAMILIES.values())


def sequence_table(df: DataFrame, family: Column) -> DataFrame:
    """One row per sequence with its span; contiguous means every frame once, no gap."""
    keys = ["dataset", "condition_family", "condition", "subject_id", "sequence_id"]
    rows = df.withColumn("condition_family", family)
    # Counting each frame first combines repeats before the shuffle; no distinct sets are held.
    frames = rows.groupBy(*keys, "frame_index").agg(F.count(F.lit(1)).alias("_n"))
    out = frames.groupBy(*keys).agg(
        F.sum("_n").alias("frame_count"),
        F.min("frame_index").alias("first_frame"),
        F.max("frame_index").alias("last_frame"),
        F.count(F.lit(1)).alias("_distinct"),
    )
    whole = (F.col("last_frame") - F.col("first_frame") + 1 == F.col("frame_count")) & (F.col("_distinct") == F.col("frame_count"))
    return out.withColumn("is_contiguous", whole).drop("_distinct")


def pick(table: DataFrame, quota: int, seed: int, families=FAMILIES, prefix: str = "pilot_") -> DataFrame:
    """Per family the ``quota`` sequences nearest the median length, all subjects distinct.

    A family can lose at most quota * (families - 1) of its best subjects to earlier families,
    so its first quota * families subjects decide the result exactly; only these few rows (a
    size set by the parameters) meet in the final step. Too few subjects stop the job.
    """
    if quota < 1:
        raise ValueError("The quota must be positive.")
    order = F.array_position(F.array(*[F.lit(f) for f in families]), F.col("condition_family"))
    rows = table.filter(F.col("condition_family").isin(*families)).withColumn("_family", order)
    median = rows.groupBy("_family").agg(F.percentile("frame_count", F.lit(0.5)).alias("_median"))
    rows = rows.join(F.broadcast(median), "_family")
    rows = rows.withColumn("length_distance", F.abs(F.col("frame_count") - F.col("_median")))
    rows = rows.withColumn("stable_key", splits.hash_order(F.col("sequence_id"), seed))
    place = ["length_distance", "stable_key", "sequence_id"]
    best = rows.groupBy("_family", "subject_id").agg(
        F.min_by(F.struct(*table.columns, "length_distance", "stable_key"), F.struct(*place)).alias("_row")
    )
    ranked = best.select("_family", "_row.*")
    # The limit sits in front of the shuffle: each task keeps its own first rows per family.
    top = ranked.withColumn("_rank", F.row_number().over(Window.partitionBy("_family").orderBy(*place)))
    top = top.filter(F.col("_rank") <= quota * len(families))
    item = F.struct("_family", "_rank", *[c for c in ranked.columns if c != "_family"])
    listed = top.agg(F.sort_array(F.collect_list(item)).alias("_items"))

    def step(acc, row):
        taken = F.size(F.filter(acc, lambda r: r["_family"] == row["_family"]))
        free = ~F.exists(acc, lambda r: r["subject_id"] == row["subject_id"])
        return F.when(free & (taken < quota), F.array_append(acc, row)).otherwise(acc)

    empty = F.slice(F.col("_items"), 1, 0)
    chosen = listed.withColumn("_chosen", F.aggregate("_items", empty, step))
    short = F.raise_error(F.lit(f"Could not select {quota} distinct subjects for every condition family.")).cast("boolean")
    chosen = chosen.filter(F.when(F.size("_chosen") == quota * len(families), True).otherwise(short))
    out = chosen.select(F.posexplode("_chosen").alias("_pos", "_row")).select("_pos", "_row.*")
    blind = ids.blind_id(F.col("_pos") + 1, prefix)
    return out.withColumn("blind_sequence_id", blind).drop("_pos", "_family", "_rank")


def pilot(
    df: DataFrame,
    quota: int = 3,
    seed: int = S.SEED,
    dataset: list[str] | None = None,
    excluded: list[str] = (),
    family: Column | None = None,
    prefix: str = "pilot_",
) -> DataFrame:
    """Balanced selection from eligible development sequences without gaps."""
    eligible = df.filter((F.col("split") == "development") & F.col("exclusion_reason").isNull())
    family = family if family is not None else ids.condition_family(F.col("dataset"), F.col("condition"))
    table = sequence_table(eligible, family).filter("is_contiguous")
    if dataset is not None:
        table = table.filter(F.col("dataset").isin(list(dataset)))
    if excluded:
        table = table.filter(~F.col("sequence_id").isin(list(excluded)))
    return pick(table, quota, seed, prefix=prefix)


def next_batch(
    df: DataFrame, prior: DataFrame, quota: int = 6, seed: int = 20260907, dataset=None, excluded=(), family=None
) -> DataFrame:
    """The next selection: no subject of ``prior`` (subject_id) and no repeated frame keys."""
    rest = df.join(prior.select("subject_id").distinct(), "subject_id", "left_anti")
    return pilot(rest, quota, seed, dataset, excluded, family, prefix="batch001_")


def template(selected: DataFrame, annotators=("annotator_1", "annotator_2"), note: str = S.TEMPLATE_NOTE) -> DataFrame:
    """Blank boundary rows for each blind id and annotator."""
    rows = selected.select(
        "blind_sequence_id", F.explode(F.array(*[F.lit(a) for a in annotators])).alias("annotator_id")
    )
    empty = {c: F.lit(None).cast("bigint").alias(c) for c in S.HUMAN_MARKS}
    return rows.select(
        F.lit("blinded").alias("dataset"),
        F.concat(F.lit("blinded:"), "blind_sequence_id").alias("subject_id"),
        F.col("blind_sequence_id").alias("sequence_id"),
        F.lit("cycle_001").alias("cycle_id"),
        *empty.values(),
        "annotator_id",
        F.lit(None).cast("string").alias("confidence"),
        F.lit(note).alias("notes"),
    )


REVIEW_STATUS = {
    "proposed": "accepted_ai_assisted_low_confidence",
    "recommend_exclude": "excluded_user_confirmed",
    "unresolved": "on_hold_unresolved",
}


def review_decisions(records: DataFrame, key: DataFrame) -> DataFrame:
    """Reviewed cycles (sequence, cycle, status, ...) with the identity behind their blind id, and their final status.

    ``key`` maps blind ids to sequences, one row each (a hand-made list). An unknown state keeps a null status.
    """
    status = None
    for name, text in REVIEW_STATUS.items():
        status = F.when(F.col("status") == name, text) if status is None else status.when(F.col("status") == name, text)
    named = records.withColumns({"accepted": F.coalesce(F.col("status") == "proposed", F.lit(False)), "status": status})
    return named.withColumnRenamed("sequence", "blind_sequence_id").join(key, "blind_sequence_id", "left")

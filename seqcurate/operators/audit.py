"""Non-destructive audit of a label release."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schemas as S
from ..functions import ids
from ..session import stage
from . import rules


def metadata_mismatches(labels: DataFrame, manifest: DataFrame) -> DataFrame:
    """Rows per field whose label copy differs from the manifest, and label/ordinal faults."""
    joined = rules.against_source(labels, manifest).filter("_src")
    checks = {f: ~F.col(f).eqNullSafe(F.col(f"_s_{f}")) for f in rules.COMPARED_FIELDS}
    checks["phase_label unknown"] = ~F.coalesce(F.col("phase_label").isin(list(S.PHASES)), F.lit(False))
    checks["phase_index differs"] = ~F.col("phase_index").eqNullSafe(S.phase_index(F.col("phase_label")))
    return rules.scalar(joined, checks)


def prepared_check(prepared: DataFrame, labels: DataFrame) -> DataFrame:
    """Each fold view against the canonical labels."""
    canon = labels.select(
        "sample_id",
        F.col("phase_label").alias("_label"),
        F.col("confidence").alias("_confidence"),
        F.col("annotation_source").alias("_source"),
        F.col("annotation_version").alias("_version"),
    )
    differs = lambda a, b: F.count_if(~F.col(a).eqNullSafe(F.col(b)))
    return prepared.join(canon, "sample_id", "left").groupBy("fold_view").agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(F.col("_label").isNull()).alias("missing_canonical_label"),
        differs("provisional_label", "_label").alias("label_mismatches"),
        differs("provisional_confidence", "_confidence").alias("confidence_mismatches"),
        differs("provisional_source", "_source").alias("source_mismatches"),
        differs("provisional_version", "_version").alias("version_mismatches"),
    )


def review_status(issues: Column, reviewed: Column, in_scope: Column) -> Column:
    """First match wins: excluded, out of scope, integrity failure, reviewed, unverified."""
    return (
        F.when(F.col("exclusion_reason").isNotNull(), "source_excluded")
        .when(~in_scope, "incomplete_temporal_source_not_annotatable")
        .when(F.size(issues) > 0, "source_integrity_failure")
        .when(reviewed, "chat_confirmed_ai_proposal_low_confidence")
        .otherwise("unverified_reference_foot_requires_sequence_review")
    )


def records(
    manifest: DataFrame, labels: DataFrame, compared: DataFrame, reviewed: DataFrame, issues: DataFrame, in_scope: Column
) -> DataFrame:
    """One audit row per manifest row.

    ``compared`` has (sample_id, disagrees), ``reviewed`` (sample_id, label) and ``issues``
    (sample_id, image_issues array); all are left joins with a presence flag.
    """
    none = F.expr("cast(array() as array<string>)")
    out = (
        manifest.join(labels.select("sample_id", F.col("phase_label").alias("original_provisional_label")), "sample_id", "left")
        .join(compared.select("sample_id", "disagrees"), "sample_id", "left")
        .join(reviewed.select("sample_id", F.col("label").alias("previous_proposal")), "sample_id", "left")
        .join(issues.select("sample_id", "image_issues"), "sample_id", "left")
    )
    out = out.withColumn("image_issues", F.coalesce("image_issues", none))
    return out.select(
        "sample_id",
        "dataset",
        "sequence_id",
        "subject_id",
        "frame_index",
        "split",
        "fold",
        "relative_path",
        "image_issues",
        "original_provisional_label",
        review_status(F.col("image_issues"), F.col("previous_proposal").isNotNull(), in_scope).alias("review_status"),
        "previous_proposal",
        F.col("disagrees").isNotNull().alias("boundary_comparison_available"),
        F.coalesce("disagrees", F.lit(False)).alias("boundary_disagreement"),
        "exclusion_reason",
    )


def review_queue(audit: DataFrame) -> DataFrame:
    """Frames, issue frames and disagreement frames per sequence."""
    return audit.groupBy("sequence_id", "dataset", "split").agg(
        F.count(F.lit(1)).alias("frames"),
        F.count_if(F.size("image_issues") > 0).alias("image_issue_frames"),
        F.count_if("boundary_disagreement").alias("boundary_disagreement_frames"),
    )


def issue_counts(audit: DataFrame) -> DataFrame:
    """Frames per review status and per image issue."""
    status = audit.groupBy(F.lit("review_status").alias("kind"), F.col("review_status").alias("value")).agg(
        F.count(F.lit(1)).alias("frames")
    )
    issue = audit.select(F.explode("image_issues").alias("value")).groupBy(F.lit("image_issue").alias("kind"), "value").agg(
        F.count(F.lit(1)).alias("frames")
    )
    return status.unionByName(issue)


def id_difference(left: DataFrame, right: DataFrame, key: str = "sample_id") -> DataFrame:
    """Size of both id sets and of their differences, in one grouping."""
    tagged = left.select(key, F.lit(1).alias("_l"), F.lit(0).alias("_r")).unionByName(
        right.select(key, F.lit(0).alias("_l"), F.lit(1).alias("_r"))
    )
    flags = tagged.groupBy(key).agg(F.max("_l").alias("_l"), F.max("_r").alias("_r"))
    l, r = F.col("_l") == 1, F.col("_r") == 1
    return flags.agg(
        F.count_if(l).alias("left_ids"),
        F.count_if(r).alias("right_ids"),
        F.count_if(l & ~r).alias("only_left"),
        F.count_if(r & ~l).alias("only_right"),
        F.count_if(l & r).alias("in_both"),
    )


def role_overlap(df: DataFrame, key: str = "subject_id", role: str = "split", keys=()) -> DataFrame:
    """Key values that occur in more than one role (must be zero)."""
    return rules.crossing(df, f"{key} in one {role}", [key], role, keys)


def image_issues(expected: DataFrame, files: DataFrame, features: DataFrame) -> DataFrame:
    """(sample_id, image_issues) of expected files (sample_id, relative_path, sha256).

    ``files`` has relative_path and sha256 of what is there, ``features`` relative_path, readable and
    foreground_pixels of what was looked into. Paths that leave the workspace are not looked up; a file without a readable row
    is a finding like any other.
    """
    outside = F.col("relative_path").rlike(r"^/|(^|/)\.\.(/|$)")
    seen = files.select("relative_path", F.col("sha256").alias("_have"))
    read = features.select("relative_path", "readable", "foreground_pixels")
    both = expected.join(seen, "relative_path", "left").join(read, "relative_path", "left")
    found = F.col("_have").isNotNull() & F.coalesce("readable", F.lit(False))
    issues = F.when(outside, F.array(F.lit("path_outside_workspace"))).otherwise(
        F.array_compact(
            F.array(
                F.when(F.col("_have") != F.col("sha256"), "source_checksum_mismatch"),
                F.when(found & (F.col("foreground_pixels") == 0), "empty_foreground"),
                F.when(~found, "missing_or_unreadable_image"),
            )
        )
    )
    return both.select("sample_id", issues.alias("image_issues"))


def folder_of(path: Column) -> Column:
    return F.regexp_extract(path, "^(.*)/[^/]*$", 1)


def folder_digests(files: DataFrame, path: str = "path", checksum: str = "sha256") -> DataFrame:
    """One digest per folder over the files directly inside it."""
    return ids.content_digest(files.withColumn("folder", folder_of(F.col(path))), path, checksum, keys=["folder"])


def tree_difference(expected: DataFrame, found: DataFrame, folders: DataFrame | None = None) -> DataFrame:
    """(path, state) of files (path, sha256) that are missing, extra or changed.

    Folders are compared by digest first; only files of folders that differ are shuffled and compared one by
    one. ``folders`` are digests of ``expected`` kept from an earlier run.
    """
    known = (folder_digests(expected) if folders is None else folders).select("folder", F.col("digest").alias("_known"))
    seen = folder_digests(found).select("folder", F.col("digest").alias("_seen"))
    off = stage(known.join(seen, "folder", "full_outer").filter(~F.col("_known").eqNullSafe(F.col("_seen"))).select("folder"), "folders")
    inside = lambda files, name: (
        files.select(folder_of(F.col("path")).alias("folder"), "path", F.col("sha256").alias(name)).join(off, "folder", "left_semi").drop("folder")
    )
    a, b = inside(expected, "_a").withColumn("_in_a", F.lit(True)), inside(found, "_b").withColumn("_in_b", F.lit(True))
    state = F.when(F.col("_in_b").isNull(), "missing").when(F.col("_in_a").isNull(), "extra").when(~F.col("_a").eqNullSafe(F.col("_b")), "changed")
    return a.join(b, "path", "full_outer").select("path", state.alias("state")).filter("state is not null")

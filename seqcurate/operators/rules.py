"""Rule checks. Every check returns a table (rule, violations); zero means the rule holds.

Scalar rules of a table share one aggregate; group rules compare min and max per key, which
combines before the shuffle and needs no distinct sets.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schemas as S
from . import labels as L

VOCABULARY = list(S.PHASES)


def scalar(df: DataFrame, checks: dict[str, Column], keys=()) -> DataFrame:
    """Count the rows that break each condition, all in one aggregate."""
    wide = df.groupBy(*keys).agg(*[F.count_if(c).alias(f"_r{i}") for i, c in enumerate(checks.values())])
    rows = [F.struct(F.lit(name).alias("rule"), F.col(f"_r{i}").alias("violations")) for i, name in enumerate(checks)]
    return wide.select(*keys, F.explode(F.array(*rows)).alias("_c")).select(*keys, "_c.*")


def duplicated(df: DataFrame, rule: str, columns, keys=()) -> DataFrame:
    """Number of key values that occur more than once."""
    out = df.groupBy(*keys, *columns).agg(F.count(F.lit(1)).alias("_n"))
    return out.groupBy(*keys).agg(F.count_if(F.col("_n") > 1).alias("violations")).select(*keys, F.lit(rule).alias("rule"), "violations")


def crossing(df: DataFrame, rule: str, group, value: str, keys=()) -> DataFrame:
    """Number of groups that hold more than one value."""
    return crossings(df, group, {rule: F.col(value)}, keys)


def crossings(df: DataFrame, group, values: dict[str, Column], keys=()) -> DataFrame:
    """Several values checked against the same grouping in one pass (null values are ignored).

    Values are compared by two 64-bit hashes of different seeds: numbers stay in the hash aggregate's row buffer,
    while text would force a sort of all rows.
    """
    ends = [end for i, value in enumerate(values.values()) for end in hash_ends(value, str(i))]
    out = df.groupBy(*keys, *group).agg(*ends)
    return scalar(out, {rule: several(str(i)) for i, rule in enumerate(values)}, keys)


def hash_ends(value: Column, name: str) -> list[Column]:
    """Aggregates that tell whether a group has several values: least and greatest of 128 bits of hash, in two halves."""
    halves = [F.when(value.isNotNull(), F.xxhash64(value, F.lit(seed))) for seed in (0, 1)]
    return [end(half).alias(f"_{side}{name}_{k}") for k, half in enumerate(halves) for side, end in (("low", F.min), ("high", F.max))]


def several(name: str) -> Column:
    return (F.col(f"_low{name}_0") != F.col(f"_high{name}_0")) | (F.col(f"_low{name}_1") != F.col(f"_high{name}_1"))


def merge(*tables: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), tables)


def raise_if_any(report: DataFrame) -> None:
    """Stop with the broken rules; reports are small (one row per rule and key)."""
    broken = report.filter("violations > 0").orderBy("rule").collect()
    if broken:
        raise S.RuleViolation("; ".join(f"{row['rule']}: {row['violations']}" for row in broken))


def preview(df: DataFrame, condition: Column | None = None, key: str = "sample_id", limit: int = 5) -> list:
    """First few offending ids for a message."""
    rows = df if condition is None else df.filter(condition)
    return [row[0] for row in rows.select(key).orderBy(key).limit(limit).collect()]


def blank(name: str) -> Column:
    return F.col(name).isNull() | (F.trim(F.col(name).cast("string")) == "")


def manifest(df: DataFrame, frozen: bool = False) -> DataFrame:
    """Catalogue rules; ``frozen`` also wants labels and splits on all eligible rows."""
    S.require_columns(df, S.MANIFEST_COLUMNS, "manifest")
    eligible = blank("exclusion_reason")
    label = F.col("adjudicated_label")
    checks = {"sample_id present": blank("sample_id")}
    for name in ("dataset", "subject_id", "sequence_id", "relative_path", "sha256"):
        checks[f"{name} present"] = blank(name)
    checks["subject_id namespaced"] = ~F.coalesce(F.col("subject_id").contains(":"), F.lit(False))
    checks["adjudicated_label in vocabulary"] = ~blank("adjudicated_label") & ~label.isin(VOCABULARY)
    if frozen:
        checks["frozen rows labelled"] = eligible & blank("adjudicated_label")
        checks["frozen rows split"] = eligible & blank("split")
    empty = df.groupBy().agg((F.count(F.lit(1)) == 0).cast("bigint").alias("violations"))
    assigned = df.filter(~blank("split"))
    grouped = assigned.filter(eligible & ~blank("duplicate_group"))
    return merge(
        empty.select(F.lit("manifest not empty").alias("rule"), "violations"),
        scalar(df, checks),
        duplicated(df, "sample_id unique", ["sample_id"]),
        crossing(assigned, "subject in one split", ["subject_id"], "split"),
        crossing(grouped, "duplicate group in one split", ["duplicate_group"], "split"),
        crossing(df.filter(~blank("adjudicated_label")), "one label per content", ["sha256"], "adjudicated_label"),
    )


def splits(df: DataFrame) -> DataFrame:
    """Every row split, subjects and eligible duplicates on one side."""
    eligible = df.filter(blank("exclusion_reason")) if "exclusion_reason" in df.columns else df
    grouped = eligible.filter(~blank("duplicate_group"))
    return merge(
        scalar(df, {"row has a split": blank("split")}),
        crossing(df, "subject in one split", ["subject_id"], "split"),
        crossing(grouped, "duplicate group in one split", ["duplicate_group"], "split"),
    )


def boundaries(df: DataFrame) -> DataFrame:
    """Human boundary rules; marks may still be text."""
    S.require_columns(df, S.HUMAN_BOUNDARY_COLUMNS, "annotation")
    marks = [F.col(c).cast("string").try_cast("bigint") for c in S.HUMAN_MARKS]
    whole = reduce(lambda a, b: a & b, [m.isNotNull() for m in marks])
    rising = reduce(lambda a, b: a & b, [low < high for low, high in zip(marks, marks[1:])])
    known = F.coalesce(F.lower("confidence").isin("high", "medium", "low"), F.lit(False))
    checks = {
        "boundaries are integers": ~whole,
        "boundaries strictly increasing": whole & ~rising,
        "confidence in vocabulary": whole & ~known,
    }
    return merge(
        scalar(df, checks),
        duplicated(df, "one record per annotator and cycle", ["sequence_id", "cycle_id", "annotator_id"]),
    )


COMPARED_FIELDS = ("dataset", "subject_id", "sequence_id", "condition", "frame_index", "relative_path", "split", "fold")


def against_source(labels: DataFrame, manifest_table: DataFrame, extra=()) -> DataFrame:
    """Labels with their manifest row (``_src`` flag, ``_s_*`` columns); both sides keyed by sample."""
    source = manifest_table.select(
        "sample_id", F.lit(True).alias("_src"), *[F.col(c).alias(f"_s_{c}") for c in [*COMPARED_FIELDS, *extra]]
    )
    return labels.join(source, "sample_id", "left")


def label_release(labels: DataFrame, manifest_table: DataFrame, datasets) -> DataFrame:
    """Rules for a label release against the manifest it was made from."""
    joined = against_source(labels, manifest_table, ["exclusion_reason", "duplicate_group"])
    known = F.col("_src").isNotNull()
    checks = {
        "sample_id present": blank("sample_id"),
        "label in vocabulary": ~F.coalesce(F.col("phase_label").isin(VOCABULARY), F.lit(False)),
        "confidence in vocabulary": ~F.coalesce(F.col("confidence").isin("medium", "low"), F.lit(False)),
        "sample known": ~known,
        "dataset in scope": known & ~F.col("_s_dataset").isin(list(datasets)),
        "sample not excluded": known & ~blank("_s_exclusion_reason"),
        "row has a split": known & blank("_s_split"),
    }
    for name in COMPARED_FIELDS:
        checks[f"{name} unchanged"] = known & ~F.col(name).eqNullSafe(F.col(f"_s_{name}"))
    return merge(
        scalar(joined, checks),
        duplicated(labels, "sample_id unique", ["sample_id"]),
        duplicated(manifest_table, "manifest sample_id unique", ["sample_id"]),
        crossings(
            joined,
            ["subject_id"],
            {
                "subject in one split": F.col("_s_split"),
                "subject in one fold": F.when(F.col("_s_split") == "development", F.col("_s_fold")),
            },
        ),
        crossing(joined.filter(~blank("_s_duplicate_group")), "duplicate group in one split", ["_s_duplicate_group"], "_s_split"),
    )


def fold_views(views: DataFrame, expected: DataFrame | None = None) -> DataFrame:
    """Rules of prepared fold views, per view; ``expected`` holds (fold_view, prepared_role, frames)."""
    keys = ["fold_view"]
    role, own = F.col("prepared_role"), F.col("fold") == F.col("fold_view")
    checks = {
        "label in vocabulary": ~F.coalesce(F.col("provisional_label").isin(VOCABULARY), F.lit(False)),
        "confidence is medium": ~F.coalesce(F.col("provisional_confidence") == "medium", F.lit(False)),
        "train and validation rows are development": (role != "test") & (F.col("split") != "development"),
        "test rows are test": (role == "test") & (F.col("split") != "test"),
        "train rows come from other folds": (role == "train") & own,
        "validation rows come from the fold": (role == "validation") & ~own,
        "path names its label": ~F.array_contains(F.split("relative_path", "/"), F.col("provisional_label")),
    }
    tables = [
        scalar(views, checks, keys),
        duplicated(views, "sample_id unique", ["sample_id"], keys),
        crossing(views, "subject in one role", ["subject_id"], "prepared_role", keys),
        crossing(views, "one checksum per path", ["relative_path"], "sha256", keys),
    ]
    if expected is not None:
        actual = views.groupBy(*keys, "prepared_role").agg(F.count(F.lit(1)).alias("_actual"))
        both = actual.join(expected, [*keys, "prepared_role"], "full_outer")
        off = F.count_if(~F.col("_actual").eqNullSafe(F.col("frames")))
        tables.append(both.groupBy(*keys).agg(off.alias("violations")).select(*keys, F.lit("counts as registered").alias("rule"), "violations"))
    return merge(*tables)


def files_match(manifest_table: DataFrame, files: DataFrame) -> DataFrame:
    """Manifest references against the files found (path, sha256)."""
    left = manifest_table.select(F.col("relative_path").alias("path"), F.col("sha256").alias("_want")).distinct()
    both = left.join(files.select("path", F.col("sha256").alias("_have")), "path", "full_outer")
    return scalar(
        both,
        {
            "referenced file exists": F.col("_have").isNull(),
            "file is referenced": F.col("_want").isNull(),
            "file checksum": F.col("_want") != F.col("_have"),
        },
    )


def withheld(df: DataFrame, expected_rows: int, level: str = "low") -> DataFrame:
    off = df.agg((F.count(F.lit(1)) != expected_rows).cast("bigint").alias("violations"))
    return merge(
        off.select(F.lit("withheld count as registered").alias("rule"), "violations"),
        scalar(df, {"withheld confidence level": ~F.col("confidence").eqNullSafe(F.lit(level))}),
    )


def batch(df: DataFrame, datasets, folds: int = 5) -> DataFrame:
    """Rules for frames handed out in an annotation batch."""
    checks = {
        "row is development": ~F.col("split").eqNullSafe(F.lit("development")),
        "row is eligible": ~F.coalesce(F.col("dataset").isin(list(datasets)), F.lit(False)) | ~blank("exclusion_reason"),
        "fold in range": ~F.coalesce(F.col("fold").between(0, folds - 1), F.lit(False)),
        "checksum is sha-256": ~F.coalesce(F.col("sha256").rlike("^[0-9a-f]{64}$"), F.lit(False)),
    }
    return merge(
        scalar(df, checks),
        duplicated(df, "frame key unique", ["sequence_id", "frame_index"]),
        duplicated(df, "content unique", ["sha256"]),
    )


def leaves_folder(name: Column) -> Column:
    """True where unpacking a member of this name would write outside its folder."""
    parts = F.split(F.replace(name, F.lit("\\"), F.lit("/")), "/")
    step = lambda part: F.when(part == "..", 1).when(part.isin("", "."), 0).otherwise(-1)
    # How far above the folder the path ever climbs: depth never falls below the start.
    climb = F.aggregate(
        parts,
        F.struct(F.lit(0).alias("up"), F.lit(0).alias("most")),
        lambda acc, part: F.struct((acc["up"] + step(part)).alias("up"), F.greatest(acc["most"], acc["up"] + step(part)).alias("most")),
    )["most"]
    return (climb > 0) | name.startswith("/") | name.startswith("\\") | parts[0].contains(":")


def archive_members(members: DataFrame, existing: DataFrame | None = None, expected_archives: int | None = None) -> DataFrame:
    """Rules of a listing of archive members (archive, member, size_bytes).

    Members that leave their folder or have no name, members listed twice, the number of archives, and existing files
    (archive, member, size_bytes) of another size.
    """
    tables = [
        scalar(members, {"member stays in its folder": F.coalesce(leaves_folder(F.col("member")), F.lit(True))}),
        duplicated(members, "member listed once", ["archive", "member"]),
    ]
    if expected_archives is not None:
        found = members.agg(F.count_distinct("archive").alias("_n"))
        off = (F.col("_n") != expected_archives).cast("bigint").alias("violations")
        tables.append(found.select(F.lit("archive count as expected").alias("rule"), off))
    if existing is not None:
        both = members.join(existing.select("archive", "member", F.col("size_bytes").alias("_size")), ["archive", "member"])
        tables.append(scalar(both, {"existing file has the member's size": F.col("_size") != F.col("size_bytes")}))
    return merge(*tables)


def refuse_empty(df: DataFrame, what: str) -> DataFrame:
    """The table, unless it has no row."""
    if df.isEmpty():
        raise S.RuleViolation(f"The {what} table is empty.")
    return df


def decided(decisions: DataFrame, key: DataFrame) -> DataFrame:
    """Rules of review decisions: a blind id names one sequence, every decision has an identity and a known status."""
    return merge(
        duplicated(key, "blind id names one sequence", ["blind_sequence_id"]),
        scalar(decisions, {"decision status known": F.col("status").isNull(), "decision has an identity": F.col("sequence_id").isNull()}),
    )


def reviewed(accepted: DataFrame, expected_cycles: int, frames: DataFrame, expected_frames: int) -> DataFrame:
    """Rules of accepted cycles (with their marks) and their frames (with ``sha256`` of the source row): as many as approved."""
    size = lambda df, rule, want: df.agg((F.count(F.lit(1)) != want).cast("bigint").alias("violations")).select(F.lit(rule).alias("rule"), "violations")
    return merge(
        boundaries(accepted),
        size(accepted, "accepted cycles as approved", expected_cycles),
        size(frames, "accepted frames as approved", expected_frames),
        scalar(frames, {"frame has a source row": F.col("sha256").isNull()}),
    )

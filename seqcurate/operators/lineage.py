"""Inventory, drift and lineage reports over file tables (path, sha256, size_bytes, ...)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import stage
from . import dedupe


def drift(before: DataFrame, after: DataFrame) -> DataFrame:
    """Every path of two snapshots as added, removed, modified or unchanged."""
    a = before.select("path", F.col("sha256").alias("_a"))
    b = after.select("path", F.col("sha256").alias("_b"))
    state = (
        F.when(F.col("_a").isNull(), "added")
        .when(F.col("_b").isNull(), "removed")
        .when(F.col("_a") != F.col("_b"), "modified")
        .otherwise("unchanged")
    )
    return a.join(b, "path", "full_outer").select("path", state.alias("change"))


def match(derived: DataFrame, source: DataFrame) -> DataFrame:
    """Each derived file against the source files of the same content.

    Source labels are first reduced to one row per (content, label) and then to min/max per
    content, so a content with many copies meets each derived file once.
    """
    labels = source.groupBy("sha256").agg(F.min("label").alias("_low"), F.max("label").alias("_high"))
    same = source.select("sha256", "label").distinct().withColumn("_agrees", F.lit(True))
    out = derived.join(labels, "sha256", "left").join(same, ["sha256", "label"], "left")
    found = F.col("_low").isNotNull()
    return out.select(
        "collection",
        "path",
        "label",
        found.alias("matched"),
        F.coalesce("_agrees", F.lit(False)).alias("agrees"),
        (found & ((F.col("_low") != F.col("label")) | (F.col("_high") != F.col("label")))).alias("conflicts"),
    )


def summary(matches: DataFrame) -> DataFrame:
    """Counts per collection; a file can agree with one copy and conflict with another."""
    out = matches.groupBy("collection").agg(
        F.count(F.lit(1)).alias("files"),
        F.count_if("matched").alias("exact_content_matches"),
        F.count_if(~F.col("matched")).alias("unmatched_files"),
        F.count_if("agrees").alias("label_agreements"),
        F.count_if("conflicts").alias("label_conflicts"),
    )
    clean = (F.col("unmatched_files") == 0) & (F.col("label_conflicts") == 0)
    return out.withColumn("result", F.when(clean, "PASS").otherwise("REVIEW"))


def duplicate_content(df: DataFrame, prefix: str = "SRC-DUP-", width: int = 3) -> DataFrame:
    """Repeated contents: number, copies, label list and cross-label flag; one row per member path.

    Labels are a small vocabulary and are made distinct before they are listed. Paths stay one
    per row, because a content may have any number of copies.
    """
    groups = dedupe.duplicate_hashes(df, "sha256", prefix, width)
    distinct = df.select("sha256", "label").distinct()
    classes = distinct.groupBy("sha256").agg(
        F.array_join(F.array_sort(F.collect_list("label")), " | ").alias("classes"),
        F.when(F.count(F.lit(1)) > 1, "YES").otherwise("NO").alias("cross_class"),
    )
    table = groups.join(classes, "sha256")
    return df.select("sha256", "path").join(table, "sha256").withColumnRenamed("duplicate_group", "group")


def duplicate_storage(df: DataFrame) -> DataFrame:
    """Space that keeping one copy of each content would free."""
    groups = df.groupBy("sha256").agg(F.count(F.lit(1)).alias("_n"), F.sum("size_bytes").alias("_s"), F.max("size_bytes").alias("_m"))
    repeated = groups.filter("_n > 1")
    return repeated.agg(
        F.count(F.lit(1)).alias("groups"),
        F.coalesce(F.sum("_n"), F.lit(0)).alias("copies"),
        F.coalesce(F.sum(F.col("_s") - F.col("_m")), F.lit(0)).alias("recoverable_bytes"),
    )


def rollup(df: DataFrame, *kinds: str) -> DataFrame:
    """Files and bytes per value of several columns, in one pass."""
    sets = ", ".join(f"'{k}', cast({k} as string)" for k in kinds)
    long = df.selectExpr("size_bytes", f"stack({len(kinds)}, {sets}) as (kind, value)")
    return long.groupBy("kind", "value").agg(F.count(F.lit(1)).alias("files"), F.sum("size_bytes").alias("size_bytes"))


def extraction(archive: DataFrame, extracted: DataFrame, keys=("archive",)) -> DataFrame:
    """Archive members against extracted files, per archive."""
    on = [*keys, "member"]
    both = archive.select(*on, F.col("sha256").alias("_a")).join(extracted.select(*on, F.col("sha256").alias("_x")), on, "full_outer")
    have_a, have_x = F.col("_a").isNotNull(), F.col("_x").isNotNull()
    out = both.groupBy(*keys).agg(
        F.count_if(have_a).alias("archive_files"),
        F.count_if(have_x).alias("extracted_files"),
        F.count_if(F.col("_a") == F.col("_x")).alias("content_matches"),
        F.count_if(have_a & ~have_x).alias("missing_files"),
        F.count_if(have_x & ~have_a).alias("extra_files"),
        F.count_if(F.col("_a") != F.col("_x")).alias("content_mismatches"),
    )
    clean = (F.col("missing_files") + F.col("extra_files") + F.col("content_mismatches")) == 0
    return out.withColumn("result", F.when(clean, "PASS").otherwise("REVIEW"))


def collections(df: DataFrame, key: str = "collection", subject: str = "subject_id", label: str = "label") -> DataFrame:
    """Files, bytes, subjects and a readable class count per collection.

    Rows are first counted per (collection, label); only those few rows are listed.
    """
    parts = df.groupBy(key, label).agg(F.count(F.lit(1)).alias("_n"), F.sum("size_bytes").alias("_s"))
    text = F.transform(F.array_sort(F.collect_list(F.when(F.col(label).isNotNull(), F.struct(F.col(label).alias("l"), F.col("_n").alias("n"))))), lambda x: F.concat(x["l"], F.lit("="), x["n"].cast("string")))
    whole = parts.groupBy(key).agg(
        F.sum("_n").alias("files"), F.sum("_s").alias("size_bytes"), F.array_join(text, "; ").alias("class_counts")
    )
    subjects = df.groupBy(key).agg(F.count_distinct(subject).alias("subject_count"))
    return whole.join(subjects, key)


#: Paths under one folder of a move list that meet it in one join key.
UNDER = 65_536


def _prefixes(depths: list[int]) -> Column:
    """(depth, prefix) of a path at the given depths that it has; depth 0 stands for no move."""
    parts = F.split(F.coalesce("path", F.lit("")), "/")
    cut = F.transform(F.array(*[F.lit(d) for d in depths]), lambda d: F.struct(d.alias("depth"), F.array_join(F.slice(parts, 1, d), "/").alias("source")))
    return F.filter(cut, lambda c: c["depth"] <= F.size(parts))


def _spread(before: DataFrame, moves: DataFrame, depths: list[int]) -> dict[int, int]:
    """Per depth into how many keys its sources are cut, so that none holds many more than ``UNDER`` paths."""
    paths = before.select(F.explode(_prefixes(depths)).alias("p")).select("p.*").groupBy("depth", "source").agg(F.count(F.lit(1)).alias("n"))
    most = paths.join(moves.select("source"), "source").groupBy("depth").agg(F.max("n").alias("n"))
    return {r["depth"]: r["n"] // UNDER + 1 for r in most.collect()}  # one row a depth


def relocation(before: DataFrame, after: DataFrame, moves: DataFrame) -> DataFrame:
    """Map every old path by its longest matching prefix and compare contents at the new path.

    ``moves`` (source, destination) may have any size; of repeated sources the first destination holds. A path
    looks its prefixes up at the depths that occur in the list only. A folder that very many paths lie under is
    cut into several join keys, by a hash of the path, as many as its depth needs; so no folder's paths meet
    in one task, and sources of deep levels are not multiplied.
    """
    moves = moves.groupBy("source").agg(F.min("destination").alias("destination")).withColumn("depth", F.size(F.split("source", "/")))
    moves = stage(moves, "moves")
    depths = sorted(r["depth"] for r in moves.select("depth").distinct().collect())
    keys = _spread(before, moves, depths) if depths else {}
    cuts = F.create_map(*[F.lit(v) for d in depths for v in (d, keys.get(d, 1))]) if depths else None
    tried = before.select("path", "sha256", F.explode(F.array_append(_prefixes(depths), F.struct(F.lit(0).alias("depth"), F.lit("").alias("source")))).alias("p"))
    tried = tried.select("path", "sha256", "p.*")
    if depths:
        listed = moves.withColumn("cut", F.explode(F.sequence(F.lit(0), F.element_at(cuts, F.col("depth")) - 1)))
        cut = F.pmod(F.xxhash64("path"), F.coalesce(F.try_element_at(cuts, F.col("depth")), F.lit(1)))
        # Sources differ in depth where they differ in name; a path without a move keeps its depth 0 row, under its own name.
        key = F.when(F.col("depth") > 0, F.col("source")).otherwise(F.concat(F.lit("/"), "path"))
        tried = tried.withColumn("cut", cut.cast("int")).withColumn("source", key).join(listed.drop("depth"), ["source", "cut"], "left")
    else:
        tried = tried.withColumn("destination", F.lit(None).cast("string"))
    tried = tried.where((F.col("depth") == 0) | F.col("destination").isNotNull())
    best = tried.groupBy("path", "sha256").agg(F.max(F.struct("depth", "source", "destination")).alias("_m"))
    moved = F.concat("_m.destination", F.expr("substring(path, length(_m.source) + 1)"))
    best = best.select("path", "sha256", F.when(F.col("_m.depth") > 0, moved).otherwise(F.col("path")).alias("new_path"))
    found = after.select(F.col("path").alias("new_path"), F.col("sha256").alias("_now"))
    state = F.when(F.col("_now").isNull(), "missing").when(F.col("_now") == F.col("sha256"), "verified").otherwise("changed")
    return best.join(found, "new_path", "left").select("path", "new_path", state.alias("result"))

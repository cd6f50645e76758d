"""File scans: catalogue rows with ids and content hashes from names and paths."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas as S
from ..functions import ids

#: Fixed value: ``subject-view_sequence-frame`` at the start of a file stem.
FRAME_NAME = r"^([^-]+)-([^_]+)_([^-]+)-(\d+)"


def scan(spark: SparkSession, root: str, suffixes=S.IMAGE_SUFFIXES) -> DataFrame:
    """All files below ``root`` with the given suffixes (any case): path, length, content."""
    glob = "{" + ",".join("*" + "".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in s) for s in suffixes) + "}"
    df = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(root)
    wanted = F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1)).isin(*suffixes)
    return df.filter(wanted).select("path", "length", "modificationTime", "content")


def relative(path: Column, root: str) -> Column:
    """Path below ``root``; file-system prefixes in front of it are ignored."""
    clean = root.split(":", 1)[-1].strip("/") if ":" in root else root.strip("/")
    # Anchored at the start: scheme, authority if the root names none, root.
    prefix = rf"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://[^/]*)??/*{re.escape(clean)}/+" if clean else r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?/*"
    return F.regexp_replace(path, prefix, "")


def stem(path: Column) -> Column:
    return F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.[^.]*$", "")


def content_hash() -> Column:
    return F.sha2("content", 256)


def _rows(df: DataFrame, **values) -> DataFrame:
    """Manifest columns with the given values, plus length and content."""
    kinds = dict(part.strip().split(" ") for part in S.MANIFEST_DDL.split(","))
    columns = [values[c].alias(c) if c in values else F.lit(None).cast(kinds[c]).alias(c) for c in S.MANIFEST_COLUMNS]
    return df.select(*columns, "length", "content")


def scan_named_frames(spark, root: str, workspace: str, dataset: str, prefix: str, strict: bool = True) -> DataFrame:
    """Frames named ``subject-view_sequence-frame``; the folder name is the legacy label.

    With ``strict`` a file of another form stops the job, otherwise its ids are null.
    """
    df = scan(spark, root).withColumn("_rel", relative(F.col("path"), workspace)).withColumn("_stem", stem(F.col("path")))
    part = lambda k: F.regexp_extract("_stem", FRAME_NAME, k)
    named = F.col("_stem").rlike(FRAME_NAME)
    bad = F.raise_error(F.concat(F.lit("Unrecognized frame name: "), "_stem")).cast("string") if strict else F.lit(None)
    subject = F.when(named, ids.namespaced(F.lit(prefix), part(1))).otherwise(bad)
    return _rows(
        df,
        sample_id=ids.sample_id(F.lit(dataset), F.col("_rel")),
        dataset=F.lit(dataset),
        subject_id=subject,
        sequence_id=F.when(named, ids.namespaced(F.lit(prefix), part(1), part(2), part(3))),
        condition=F.lit("unspecified"),
        view=F.when(named, part(2)),
        frame_index=F.when(named, part(4).cast("bigint")),
        relative_path=F.col("_rel"),
        sha256=content_hash(),
        legacy_label=F.element_at(F.split("path", "/"), -2),
    )


def scan_path_frames(spark, root: str, workspace: str, dataset: str, view: str | None = None) -> DataFrame:
    """Frames whose subject and condition come from their folders.

    The subject is the first three-digit folder, else the third part from the end; the condition
    is the parent folder and the frame number the first digits of the stem. Paths below a folder
    named like an archive are left out.
    """
    df = scan(spark, root, (".png",)).withColumn("_rel", relative(F.col("path"), workspace))
    df = df.withColumn("_parts", F.split(relative(F.col("path"), root), "/")).withColumn("_stem", stem(F.col("path")))
    df = df.filter(~F.exists("_parts", lambda p: F.lower(p).endswith(".zip")))
    short = F.raise_error(F.concat(F.lit("Unrecognized frame path: "), "_rel")).cast("string")
    folders = F.slice("_parts", 1, F.greatest(F.size("_parts") - 2, F.lit(0)))
    numbered = F.filter(folders, lambda p: p.rlike("^[0-9]{3}$"))
    subject = F.when(F.size("_parts") < 3, short).otherwise(
        F.coalesce(F.try_element_at(numbered, F.lit(1)), F.try_element_at("_parts", F.lit(-3)))
    )
    condition = F.try_element_at("_parts", F.lit(-2))
    digits = F.regexp_extract("_stem", r"(\d+)", 1)
    frame = F.when(digits != "", digits).otherwise(short)
    return _rows(
        df.withColumn("_subject", subject),
        sample_id=ids.sample_id(F.lit(dataset), F.col("_rel")),
        dataset=F.lit(dataset),
        subject_id=ids.namespaced(F.lit(dataset), "_subject"),
        sequence_id=ids.namespaced(F.lit(dataset), "_subject", condition),
        condition=condition,
        view=F.lit(view).cast("string"),
        frame_index=frame.cast("bigint"),
        relative_path=F.col("_rel"),
        sha256=content_hash(),
    )


def inventory(spark, root: str, workspace: str) -> DataFrame:
    """Every file: path, size, change time, hash, extension."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    return df.select(
        relative(F.col("path"), workspace).alias("path"),
        F.col("length").alias("size_bytes"),
        "modificationTime",
        content_hash().alias("sha256"),
        F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1)).alias("extension"),
    )

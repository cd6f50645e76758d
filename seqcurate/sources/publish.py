"""Sinks, and publication of a whole release at once.

A release is a folder. Its tables are written under ``data/<attempt>/`` and stay where they are; what
exists is said by ``versions/<number>/commits/``, one small file written after everything else. Nothing is
renamed, nothing is overwritten and no lock service is asked: writers agree by claims. A writer leaves
its claim, then looks; it commits only if no other claim stands there, and withdraws its own otherwise. Of two
writers the later claim always sees the earlier one, so two never commit (both may withdraw, and are told so). This
holds on any store where a finished write is visible to the next listing, and uses DataFrame readers and
writers only. A writer that dies before its commit leaves files that no version names; one that dies
between claim and commit blocks that version, and the next attempt takes the next number.

Row counts, digests and other measures of a table are observed by the write itself.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import datetime, timezone

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..functions import ids
from ..operators import rules
from ..schemas import PHASES, RuleViolation


@dataclass(frozen=True)
class Sink:
    """How a table is written; ``measures`` are aggregates observed while it is."""

    format: str = "parquet"
    shape: Callable[[DataFrame], DataFrame] = lambda df: df
    partition_by: tuple[str, ...] = ()
    options: dict = field(default_factory=dict)
    measures: dict[str, Column] = field(default_factory=dict)


def by_folder(views: DataFrame) -> DataFrame:
    """Rows of one folder together, as many writers a folder as adaptive execution finds its size to need."""
    return views.withColumn("label", F.col("provisional_label")).hint("rebalance", "fold_view", "prepared_role", "label")


#: Fold views in folders by view, role and label, so that a run reads only its own part.
FOLD_VIEWS = Sink(shape=by_folder, partition_by=("fold_view", "prepared_role", "label"))
#: Small vocabularies whose rows a label release counts while it is written.
LABEL_KINDS = {"confidence": ("high", "medium", "low"), "phase_label": PHASES, "split": ("development", "test")}
JSON_LINES = Sink(format="json", options={"compression": "gzip"})
TEXT_TABLE = Sink(format="csv", options={"header": True, "compression": "gzip"})


def labels_sink() -> Sink:
    """Label rows, with the counts of ``LABEL_KINDS``."""
    return Sink(measures={f"{kind}:{value}": F.count_if(F.col(kind) == value) for kind, values in LABEL_KINDS.items() for value in values})


def write(df: DataFrame, path: str, sink: Sink = Sink()) -> dict:
    """Write a table, never over another one; rows, digest and measures of what was written, without reading it again."""
    shaped = sink.shape(df)
    seen = Observation()
    row = F.to_json(F.struct(*[F.col(f"`{c}`") for c in sorted(shaped.columns)]))
    measures = [m.alias(f"m_{name}") for name, m in sink.measures.items()]
    writer = shaped.observe(seen, F.count(F.lit(1)).alias("rows"), *ids.word_sums(ids.line_hash(row)), *measures).write.mode("errorifexists").options(**sink.options)
    (writer.partitionBy(*sink.partition_by) if sink.partition_by else writer).format(sink.format).save(path)
    got = seen.get
    out = {"path": path, "format": sink.format, "rows": got["rows"], "digest": _digest(got["rows"], [got[w] for w in ids.WORD_NAMES])}
    return out | {name: got[f"m_{name}"] for name in sink.measures}


def _digest(rows: int, words: list) -> str:
    return hashlib.sha256(":".join([str(rows), *[str(int(w or 0)) for w in words]]).encode()).hexdigest()


def table_digest(df: DataFrame) -> dict:
    """Row count and digest over all columns (nested values as JSON), as ``write`` observes them."""
    flat = df.select(F.to_json(F.struct(*[F.col(f"`{c}`") for c in sorted(df.columns)])).alias("row"))
    row = ids.content_digest(flat, "row").first()
    return {"rows": row["entries"], "digest": row["digest"]}


# Versions ------------------------------------------------------------------------------------------


def _notes(spark: SparkSession, root: str, kind: str, version: int | None = None) -> dict[tuple[int, str], str]:
    """{(version, attempt): text} of the claims, withdrawals or commits: a few small files."""
    folder = "*" if version is None else f"{version:06d}"
    try:
        rows = spark.read.text(f"{root}/versions/{folder}/{kind}/*").select(F.col("_metadata.file_path").alias("path"), "value").collect()
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return {}
        raise
    return {(int(r["path"].split("/")[-4]), r["path"].split("/")[-2]): r["value"] for r in rows}


def _note(spark: SparkSession, root: str, kind: str, version: int, attempt: str, text: str) -> None:
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.text(f"{root}/versions/{version:06d}/{kind}/{attempt}")


def published(spark: SparkSession, root: str) -> list[int]:
    """Numbers of the committed versions."""
    return sorted(version for version, _ in _notes(spark, root.rstrip("/"), "commits"))


def read_ready(spark: SparkSession, root: str, version: int | None = None) -> dict:
    """The manifest of a version, the latest if none is named; a release without a commit does not exist."""
    commits = _notes(spark, root.rstrip("/"), "commits", version)
    if not commits:
        raise FileNotFoundError(f"{root} is not a published release")
    return json.loads(commits[max(commits)])


def read_table(spark: SparkSession, root: str, table: str, version: int | None = None) -> DataFrame:
    found = read_ready(spark, root, version)["tables"][table]
    return spark.read.format(found["format"]).load(found["path"])


def refuse_taken(spark: SparkSession, root: str, version: int = 0) -> None:
    if _notes(spark, root.rstrip("/"), "commits", version):
        raise FileExistsError(f"Output already exists: {root}, version {version}")


def _commit(spark: SparkSession, root: str, version: int, attempt: str, text: str) -> None:
    _note(spark, root, "claims", version, attempt, "claimed")
    others = _notes(spark, root, "claims", version).keys() - _notes(spark, root, "withdrawn", version).keys() - {(version, attempt)}
    if others:
        _note(spark, root, "withdrawn", version, attempt, "withdrawn")
        raise FileExistsError(f"Version {version} of {root} was published or claimed by another writer; publish as the next version or try again")
    _note(spark, root, "commits", version, attempt, text)


def publish(
    spark: SparkSession,
    output: str,
    tables: dict[str, DataFrame],
    summary: dict | None = None,
    sinks: dict[str, Sink] | None = None,
    accept: Callable[[dict], dict | None] | None = None,
    version: int = 0,
) -> dict:
    """Write all tables, then commit them as one version of the release at ``output``.

    ``accept`` gets what the writes observed, may raise, and returns what else goes into the manifest.
    Whatever fails, no version appears.
    """
    root, attempt = output.rstrip("/"), uuid.uuid4().hex
    refuse_taken(spark, root, version)
    contents = {name: write(df, f"{root}/data/{attempt}/{name}", (sinks or {}).get(name, Sink())) for name, df in tables.items()}
    more = (accept(contents) if accept else None) or {}
    stamp = datetime.now(timezone.utc).isoformat(timespec="seconds")
    ready = {"status": "READY", "version": version, "published_utc": stamp, **(summary or {}), **more, "tables": contents}
    _commit(spark, root, version, attempt, json.dumps(ready, default=str))
    return json.loads(json.dumps(ready, default=str))


def unreferenced(spark: SparkSession, output: str) -> DataFrame:
    """Files under ``data/`` that no committed version names: what failed attempts left; their paths may be deleted."""
    root = output.rstrip("/")
    named = {table["path"].rstrip("/").split("/")[-2] for text in _notes(spark, root, "commits").values() for table in json.loads(text)["tables"].values()}
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(f"{root}/data").select("path", "length")
    attempt = F.regexp_extract("path", r"/data/([0-9a-f]{32})/", 1)
    return files.filter(~attempt.isin(*named)) if named else files


def verify(spark: SparkSession, output: str, version: int | None = None) -> DataFrame:
    """Rules of the stored tables against the manifest: row counts and digests, one row per table and rule."""
    ready = read_ready(spark, output, version)
    parts = []
    for name, known in ready["tables"].items():
        if known["format"] != "parquet":  # text keeps no types, so its rows have another form when they are read
            continue
        flat = spark.read.parquet(known["path"])
        now = ids.content_digest(flat.select(F.to_json(F.struct(*[F.col(f"`{c}`") for c in sorted(flat.columns)])).alias("row")), "row")
        parts.append(
            rules.scalar(now, {f"rows of {name} as published": F.col("entries") != known["rows"], f"digest of {name} as published": F.col("digest") != known["digest"]})
        )
    return rules.merge(*parts)


def accounted(contents: dict, total: int, *parts: str) -> dict:
    """Stop unless the rows of ``parts`` add up to ``total``; the sum for the manifest."""
    rows = {name: contents[name]["rows"] for name in parts}
    if sum(rows.values()) != total:
        raise RuleViolation(f"Rows are not accounted for: {rows} do not add up to {total}")
    return {"accounted_manifest_frames": total}

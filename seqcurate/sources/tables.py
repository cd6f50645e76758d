"""Text tables in, typed frames out. Every cell is read as text, blank means null, casts are strict."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas as S
from ..functions import ids


def typed(df: DataFrame, ddl: str, table: str, keep_extra: bool = False) -> DataFrame:
    """Cast to a declared schema; a malformed number stops the job."""
    fields = [part.strip().split(" ") for part in ddl.split(",")]
    S.require_columns(df, [name for name, _ in fields], table)
    known = [F.col(name).cast(kind).alias(name) for name, kind in fields]
    extra = [F.col(c) for c in df.columns if c not in {name for name, _ in fields}] if keep_extra else []
    return df.select(*known, *extra)


def read_text_table(spark: SparkSession, path, partitions: int | None = None, multiline: bool = False) -> DataFrame:
    """CSV with a header, all text.

    A gzip file is read by one task; its rows are dealt over ``partitions`` tasks after that, as many as the session runs
    at a time unless told otherwise. ``multiline`` allows line feeds inside quotes and reads each file in one task.
    """
    df = spark.read.option("header", True).option("escape", '"').option("multiLine", multiline).csv(path)
    df = ids.blank_to_null(df)
    paths = [path] if isinstance(path, str) else list(path)
    if partitions is None and any(p.endswith(".gz") for p in paths):
        partitions = spark.sparkContext.defaultParallelism
    return df.repartition(partitions) if partitions else df


def read_manifest(spark, path, partitions=None, keep_extra: bool = False) -> DataFrame:
    return typed(read_text_table(spark, path, partitions), S.MANIFEST_DDL, "manifest", keep_extra)


def read_labels(spark, path, partitions=None) -> DataFrame:
    return typed(read_text_table(spark, path, partitions), S.LABELS_DDL, "label")


def read_machine_boundaries(spark, path, partitions=None) -> DataFrame:
    return typed(read_text_table(spark, path, partitions), S.MACHINE_BOUNDARIES_DDL, "boundary")


def read_human_boundaries(spark, path, strict: bool = True) -> DataFrame:
    """Annotator files; ``strict=False`` keeps the marks as text so that the rules can report them."""
    df = read_text_table(spark, path, multiline=True)  # notes are free text
    if strict:
        return typed(df, S.HUMAN_BOUNDARIES_DDL, "annotation")
    return S.require_columns(df, S.HUMAN_BOUNDARY_COLUMNS, "annotation")


METADATA_COLUMNS = (
    "sample_id",
    "dataset",
    "subject_id",
    "sequence_id",
    "condition",
    "frame_index",
    "relative_path",
    "sha256",
    "exclusion_reason",
    "split",
    "fold",
)


def read_metadata_only(spark, path) -> DataFrame:
    """Manifest without any label column; a columnar source reads only these columns."""
    return read_manifest(spark, path).select(*METADATA_COLUMNS)


def read_records(spark, path, field: str = "records") -> DataFrame:
    """One JSON document with an array of records, as rows."""
    return spark.read.option("multiLine", True).json(path).select(F.explode(field).alias("r")).select("r.*")


def registry_table(spark, variants: dict) -> DataFrame:
    """{variant: {"role": ..., "runs": {fold: run_id}}} as a table (a hand-written list)."""
    rows = [
        (name, spec.get("role", "unspecified"), int(fold), str(run))
        for name, spec in variants.items()
        for fold, run in spec.get("runs", {}).items()
    ]
    if not rows:
        raise S.RuleViolation("The registry contains no runs.")
    return spark.createDataFrame(rows, S.REGISTRY_DDL)


def _run_of(column: str = "_metadata.file_path"):
    return F.element_at(F.split(F.col(column), "/"), -2)


def _files_of(root: str, registry: DataFrame, name: str) -> list[str]:
    """The file of every registered run (a hand-written list); other folders are not looked at, a missing file stops the job."""
    return [f"{root}/{row['run_id']}/{name}" for row in registry.select("run_id").distinct().orderBy("run_id").collect()]


def read_run_configs(spark, root: str, registry: DataFrame) -> DataFrame:
    """run_id with the run's fold, evaluation split and test flag, from each ``config.yaml``."""
    files = _files_of(root, registry, "config.yaml")
    text = spark.read.text(files, wholetext=True).select(_run_of().alias("run_id"), "value")
    value = lambda key: F.nullif(F.trim(F.regexp_extract("value", rf"(?m)^\s+{key}:\s*[\"']?([^\"'\n]*)", 1)), F.lit(""))
    return text.select(
        "run_id",
        value("fold").cast("int").alias("config_fold"),
        value("evaluation_split").alias("evaluation_split"),
        F.coalesce(F.lower(value("test_accessed")) == "true", F.lit(False)).alias("test_accessed"),
    )


def read_registered_runs(spark, root: str, registry: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(predictions with variant and fold, registry with run metadata) of the registered runs in one scan."""
    registered = registry.join(read_run_configs(spark, root, registry), "run_id", "left")
    # enforceSchema off: a file whose header differs is an error, not columns by position.
    rows = spark.read.option("header", True).option("enforceSchema", False).csv(_files_of(root, registry, "predictions.csv"))
    rows = rows.select("*", _run_of().alias("run_id"))
    preds = ids.blank_to_null(rows)
    preds = preds.withColumn("frame_index", F.col("frame_index").cast("bigint"))
    S.require_columns(preds, S.PREDICTION_COLUMNS, "prediction")
    preds = preds.select(*S.PREDICTION_COLUMNS, "run_id")
    return preds.join(F.broadcast(registry), "run_id"), registered  # the registry is a hand-written list


def read_curves(spark, root: str, registry: DataFrame) -> DataFrame:
    """Learning curves of the registered runs: run_id, epoch, losses."""
    df = spark.read.option("header", True).option("enforceSchema", False).csv(_files_of(root, registry, "learning_curves.csv")).select("*", _run_of().alias("run_id"))
    return df.select("run_id", F.col("epoch").cast("int").alias("epoch"), F.col("validation_loss").cast("double").alias("validation_loss"))

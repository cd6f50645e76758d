"""Session settings and staged tables.

A staged table is an intermediate result written once to the folder the cluster names in
``spark.checkpoint.dir`` and read back: it cuts lineage and survives losing executors.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL_ROOT: dict[str, str] = {}
_STAGED: dict[str, list[str]] = {}
_RELEASES: dict[str, int] = {}


def build_session(master: str = "local[*]", partitions: int = 8, **extra) -> SparkSession:
    """A session for tests and benchmarks; on a cluster use the session the cluster gives."""
    builder = (
        SparkSession.builder.master(master)
        .appName("seqcurate")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        # Small local inputs: keep all cores busy, and compile only what the JVM will compile too.
        .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "32k")
        .config("spark.sql.files.openCostInBytes", "32k")
        .config("spark.sql.codegen.hugeMethodLimit", "8000")
    )
    for key, value in extra.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def stage_root(spark: SparkSession) -> str:
    """Shared folder for staged tables; a private one is made only for local sessions."""
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("Set spark.checkpoint.dir to a folder all executors share.")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL_ROOT:
        _LOCAL_ROOT[app] = tempfile.mkdtemp(prefix="seqcurate-stage-")
    return _LOCAL_ROOT[app]


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once and continue from the written table."""
    spark = df.sparkSession
    path = f"{stage_root(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.mode("errorifexists").parquet(path)
    _STAGED.setdefault(spark.sparkContext.applicationId, []).append(path)
    return spark.read.schema(df.schema).parquet(path)


def release_staged(spark: SparkSession) -> int:
    """Delete the staged tables this application wrote; returns how many."""
    app = spark.sparkContext.applicationId
    paths = _STAGED.pop(app, [])
    _RELEASES[app] = _RELEASES.get(app, 0) + 1
    jvm = spark.sparkContext._jvm
    for text in paths:
        path = jvm.org.apache.hadoop.fs.Path(text)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    return len(paths)


def generation(spark: SparkSession) -> tuple[str, int]:
    """Changes when staged tables are deleted: what is kept under it never points at a deleted table."""
    app = spark.sparkContext.applicationId
    return app, _RELEASES.get(app, 0)

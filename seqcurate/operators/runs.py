"""Registered cross-validation runs: coverage, rules and summaries for all runs at once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schemas as S
from . import bootstrap, metrics, rules

IDENTITY = S.PREDICTION_COLUMNS[:6] + S.PREDICTION_COLUMNS[6:7] + S.PREDICTION_COLUMNS[8:]


def coverage(preds: DataFrame, canonical: DataFrame, variants: list[str]) -> DataFrame:
    """Full outer comparison with the canonical table, per registered variant.

    Every variant must hold exactly the canonical samples, so the canonical rows are repeated
    once per registered name before one shuffle on (variant, sample).
    """
    fields = [c for c in IDENTITY if c != "sample_id"] + ["fold"]
    want = canonical.select(
        F.explode(F.array(*[F.lit(v) for v in variants])).alias("variant"),
        "sample_id",
        F.lit(True).alias("_c"),
        *[F.col(c).alias(f"_c_{c}") for c in fields],
    )
    have = preds.select("variant", "sample_id", F.lit(True).alias("_p"), *fields)
    both = have.join(want, ["variant", "sample_id"], "full_outer")
    shared = F.col("_c").isNotNull() & F.col("_p").isNotNull()
    checks = {"sample is canonical": F.col("_c").isNull(), "canonical sample predicted": F.col("_p").isNull()}
    for name in fields:
        checks[f"{name} as canonical"] = shared & ~F.col(name).eqNullSafe(F.col(f"_c_{name}"))
    return rules.scalar(both, checks, ["variant"])


def registry(preds: DataFrame, registered: DataFrame, expected_folds: list[int], samples: int, subjects: int) -> DataFrame:
    """Registry rules per variant; run metadata columns are checked when present."""
    keys = ["variant"]
    folds = registered.groupBy(*keys).agg(
        (~(F.sort_array(F.collect_list("fold")) == F.array(*[F.lit(k) for k in expected_folds]))).cast("bigint").alias("violations")
    )
    seen = preds.groupBy(*keys, "subject_id").agg(F.count(F.lit(1)).alias("_n"))
    counts = seen.groupBy(*keys).agg(F.sum("_n").alias("_n"), F.count(F.lit(1)).alias("_s"))
    tables = [
        folds.select(*keys, F.lit("registered folds complete").alias("rule"), "violations"),
        counts.select(*keys, F.lit("sample count as registered").alias("rule"), (F.col("_n") != samples).cast("bigint").alias("violations")),
        counts.select(*keys, F.lit("subject count as registered").alias("rule"), (F.col("_s") != subjects).cast("bigint").alias("violations")),
        rules.duplicated(preds, "sample in one fold", ["sample_id"], keys),
        rules.duplicated(preds, "sample unique in its run", ["fold", "sample_id"], keys),
    ]
    if "evaluation_split" in registered.columns:
        wrong = (F.col("evaluation_split") != "validation") | F.col("test_accessed") | (F.col("config_fold") != F.col("fold"))
        tables.append(rules.scalar(registered, {"run is development validation": F.coalesce(wrong, F.lit(True))}, keys))
    return rules.merge(*tables)


def identical_variants(preds: DataFrame) -> DataFrame:
    """One row: number of distinct identity tables among the variants (must be 1).

    Each variant's identity table becomes a sum of hash words; nothing is sorted or collected.
    """
    line = F.sha2(F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in IDENTITY]), 256)
    words = [F.sum(F.conv(F.substring("_line", 8 * k + 1, 8), 16, 10).cast("decimal(12,0)")).alias(f"w{k}") for k in range(8)]
    tables = preds.withColumn("_line", line).groupBy("variant").agg(*words, F.count(F.lit(1)).alias("n"))
    return tables.agg(F.count_distinct("n", *[f"w{k}" for k in range(8)]).alias("identity_tables"))


def fold_summary(preds: DataFrame, registered: DataFrame | None = None) -> DataFrame:
    out = metrics.overall(preds, ["variant", "fold"]).select(
        "variant", "fold", "samples", "subjects", "subject_macro_f1", "balanced_accuracy"
    )
    return out if registered is None else registered.join(out, ["variant", "fold"])


def model_summary(preds: DataFrame, iterations: int = bootstrap.ITERATIONS, seed: int = S.SEED) -> DataFrame:
    """Out-of-fold metrics, interval and transition validity per variant, in one job."""
    keys = ["variant"]
    scores = metrics.subject_scores(preds, keys)
    bounds = bootstrap.interval(scores, keys, iterations=iterations, seed=seed)
    bounds = bounds.select("variant", F.col("lower").alias("ci_lower"), F.col("upper").alias("ci_upper"))
    valid = metrics.transition_validity(preds, keys).drop("pairs")
    return metrics.overall(preds, keys).join(bounds, keys).join(valid, keys)


def comparisons(preds: DataFrame, pairs: list[tuple[str, str]], iterations: int = bootstrap.ITERATIONS) -> DataFrame:
    """Paired differences of all registered comparisons as one keyed bootstrap."""
    known = F.array(*[F.struct(F.lit(a).alias("left"), F.lit(b).alias("right")) for a, b in pairs])
    sides = preds.withColumn("_pair", F.explode(known))
    left = sides.filter(F.col("variant") == F.col("_pair.left")).select("_pair.*", *preds.columns)
    right = sides.filter(F.col("variant") == F.col("_pair.right")).select("_pair.*", *preds.columns)
    return bootstrap.paired(left, right, ["left", "right"], iterations)


def best_epoch(curves: DataFrame, keys=("run_id",)) -> DataFrame:
    """Epoch of the lowest validation loss, the first on a tie; runs without losses drop out."""
    known = curves.filter(F.col("validation_loss").isNotNull() & ~F.isnan("validation_loss"))
    best = F.min_by("epoch", F.struct("validation_loss", "epoch"))
    return known.groupBy(*keys).agg(best.alias("best_epoch"))


def duration(best: DataFrame, keys=()) -> DataFrame:
    """Training length rule: the median best epoch over the folds."""
    return best.groupBy(*keys).agg(F.percentile("best_epoch", F.lit(0.5)).alias("epochs"), F.count(F.lit(1)).alias("runs"))

"""Subject-clustered resampling.

Draws are hash counters (iteration, position), so any engine and any partitioning gives the
same resamples. A subject is a row of sufficient statistics that add up (a score and a count, or label
counts); a resample is the sum of the drawn rows, and a metric is an expression over the sums. Iterations x
subjects small rows are generated in parallel and combined before the shuffle; the rows behind the
statistics are read once, whatever the number of iterations.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schemas as S
from ..session import stage
from . import blocks, metrics

ITERATIONS = 2000


#: Draws taken from one sha-256: 8 words of 32 bits.
WORDS = 8
#: Iterations generated per input row after they are spread over the tasks.
CHUNK = 100


def _checked(iterations: int) -> None:
    if iterations < 100:
        raise ValueError("Use at least 100 bootstrap iterations.")


def numbered(stats: DataFrame, keys, values: list[str]) -> DataFrame:
    """Positions of the subjects in hash order, and their number (two at least), written once."""
    rows = stats.select(*keys, "subject_id", *values).withColumn("_h", F.sha2("subject_id", 256))
    out = blocks.rank(rows, list(keys), ["_h", "subject_id"], F.substring("_h", 1, 3), "_pos", "_size")
    few = F.raise_error(F.lit("Clustered bootstrap needs at least two subjects.")).cast("bigint")
    return stage(out.withColumn("_size", F.when(F.col("_size") < 2, few).otherwise(F.col("_size"))).drop("_h"), "statistics")


def draws(scores: DataFrame, keys, iterations: int, seed: int) -> DataFrame:
    """One row per (key, iteration, occurrence) with the position drawn.

    Word ``k`` of sha-256(seed:iteration:group) gives occurrence ``8 * group + k``. The small
    score table is spread over all tasks before it is multiplied, by group and iteration chunk.
    """
    spread = int(scores.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = scores.filter(F.pmod("_pos", F.lit(WORDS)) == 0).select(*keys, "_pos", "_size")
    rows = rows.withColumn("_c", F.explode(F.sequence(F.lit(0), F.lit(iterations - 1), F.lit(CHUNK))))
    rows = rows.repartition(spread, *keys, "_pos", "_c")
    last = F.least(F.col("_c") + CHUNK, F.lit(iterations)) - 1
    rows = rows.withColumn("_b", F.explode(F.sequence("_c", last)))
    text = F.concat_ws(":", F.lit(str(seed)), F.col("_b").cast("string"), F.floor(F.col("_pos") / WORDS).cast("string"))
    rows = rows.withColumn("_h", F.sha2(text, 256))
    words = [F.substring("_h", 8 * k + 1, 8) for k in range(WORDS)]
    rows = rows.select(*keys, "_b", "_pos", "_size", F.posexplode(F.array(*words)).alias("_k", "_w"))
    rows = rows.filter(F.col("_pos") + F.col("_k") < F.col("_size"))
    draw = F.pmod(F.conv("_w", 16, 10).cast("bigint"), F.col("_size"))
    return rows.select(*keys, "_b", (F.col("_pos") + F.col("_k")).alias("_at"), draw.alias("_draw"))


def resampled(base: DataFrame, keys, values: list[str], iterations: int, seed: int) -> DataFrame:
    """Sums of the drawn statistics per (key, iteration); ``_size`` subjects each.

    ``base`` is a written table, so Spark knows its size and broadcasts it or shuffles the draws to it.
    """
    picked = draws(base, keys, iterations, seed).drop("_at", "_size").withColumnRenamed("_draw", "_pos")
    sums = [F.sum(v).alias(v) for v in values]
    return picked.join(base.select(*keys, "_pos", "_size", *values), [*keys, "_pos"]).groupBy(*keys, "_b", "_size").agg(*sums)


def _combine(left: DataFrame, right: DataFrame, keys) -> DataFrame:
    return left.join(right, list(keys)) if keys else blocks.one_row(left, right)


def _bounds(column: str, confidence: float) -> list[Column]:
    alpha = (1.0 - confidence) / 2.0
    return [F.percentile(column, F.lit(alpha)).alias("lower"), F.percentile(column, F.lit(1.0 - alpha)).alias("upper")]


def interval(
    scores: DataFrame, keys=(), value: str = "macro_f1", iterations: int = ITERATIONS, confidence: float = 0.95, seed: int = S.SEED
) -> DataFrame:
    """Percentile interval of the mean subject score."""
    _checked(iterations)
    base = numbered(scores, keys, [value])
    means = resampled(base, keys, [value], iterations, seed).withColumn("_mean", F.col(value) / F.col("_size"))
    bounds = means.groupBy(*keys).agg(*_bounds("_mean", confidence))
    point = base.groupBy(*keys).agg(F.avg(value).alias("estimate"), F.count(F.lit(1)).alias("subjects"))
    out = _combine(point, bounds, keys)
    return out.withColumn("confidence", F.lit(confidence)).withColumn("iterations", F.lit(iterations).cast("bigint"))


def metric_intervals(
    stats: DataFrame,
    metrics_of: dict[str, Column],
    keys=(),
    iterations: int = ITERATIONS,
    confidence: float = 0.95,
    seed: int = S.SEED,
) -> DataFrame:
    """Percentile intervals of any metrics of summed subject statistics, one row per key and metric.

    ``stats`` has one row per (key, subject) whose numeric columns add up (``metrics.subject_counts``);
    ``metrics_of`` maps names to expressions over the sums (``metrics.frame_metrics``). A subject drawn
    twice counts twice. All metrics share the draws.
    """
    _checked(iterations)
    values = [c for c in stats.columns if c not in (*keys, "subject_id")]
    base = numbered(stats, keys, values)
    drawn = resampled(base, keys, values, iterations, seed)
    whole = base.groupBy(*keys).agg(*[F.sum(v).alias(v) for v in values], F.count(F.lit(1)).alias("subjects"))
    each = lambda sums, *more: sums.select(
        *keys, *more, F.explode(F.array(*[F.struct(F.lit(n).alias("metric"), m.alias("value")) for n, m in metrics_of.items()])).alias("_m")
    ).select(*keys, *more, "_m.*")
    bounds = each(drawn).groupBy(*keys, "metric").agg(*_bounds("value", confidence))
    out = each(whole, "subjects").withColumnRenamed("value", "estimate").join(bounds, [*keys, "metric"])
    out = out.withColumn("confidence", F.lit(confidence)).withColumn("iterations", F.lit(iterations).cast("bigint"))
    return out.select(*keys, "metric", "estimate", "lower", "upper", "subjects", "confidence", "iterations")


def paired(left: DataFrame, right: DataFrame, keys=(), iterations: int = ITERATIONS, seed: int = S.SEED) -> DataFrame:
    """Resampled mean difference of subject scores of two prediction tables.

    ``unpaired_rows`` counts rows of either side without an exact partner (sample, subject,
    truth) and must be zero for a valid comparison. Both sides are read once: a subject's label counts
    of either side and its unpaired rows come from one grouping of the join.
    """
    _checked(iterations)
    on = [*keys, "sample_id", "subject_id", "y_true"]
    a = left.select(*on, F.col("y_pred").alias("_left"))
    b = right.select(*on, F.col("y_pred").alias("_right"))
    both = a.join(b, on, "full_outer")
    matched = F.col("_left").isNotNull() & F.col("_right").isNotNull()
    sides = {"_left": 1, "_right": -1}
    counts = [c for side in sides for c in metrics.label_counts("y_true", side, matched, side)]
    wide = both.groupBy(*keys, "subject_id").agg(F.count_if(~matched).alias("_unpaired"), F.count_if(matched).alias("_matched"), *counts)
    gap = sum((sign * metrics.macro_f1(side) for side, sign in sides.items()), F.lit(0.0))
    gaps = stage(wide.select(*keys, "subject_id", "_unpaired", "_matched", gap.alias("difference")), "differences")
    base = numbered(gaps.filter("_matched > 0"), keys, ["difference"])
    means = resampled(base, keys, ["difference"], iterations, seed).withColumn("_mean", F.col("difference") / F.col("_size"))
    bounds = means.groupBy(*keys).agg(*_bounds("_mean", 0.95), F.avg((F.col("_mean") > 0).cast("double")).alias("probability_left_better"))
    point = gaps.groupBy(*keys).agg(
        F.avg(F.when(F.col("_matched") > 0, F.col("difference"))).alias("estimate"), F.sum("_unpaired").alias("unpaired_rows")
    )
    return _combine(point, bounds, keys)


def paired_checked(left: DataFrame, right: DataFrame, keys=(), iterations: int = ITERATIONS, seed: int = S.SEED) -> DataFrame:
    """``paired`` that stops the job when the tables do not hold exactly the same rows."""
    text = F.lit("Paired predictions must contain exactly the same samples, subjects, and labels.")
    out = paired(left, right, keys, iterations, seed)
    ok = F.when(F.col("unpaired_rows") == 0, F.col("estimate")).otherwise(F.raise_error(text).cast("double"))
    return out.withColumn("estimate", ok).drop("unpaired_rows")

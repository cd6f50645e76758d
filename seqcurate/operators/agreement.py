"""Agreement of two annotators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schemas as S

K = len(S.PHASES)


def pairs(expanded: DataFrame, first: str, second: str, on=("sequence_id", "cycle_id", "frame_index")) -> DataFrame:
    """Both labels of each frame both annotators marked: one grouping instead of a self-join."""
    index = S.phase_index(F.col("label"), True)
    side = lambda who: F.max(F.when(F.col("annotator_id") == who, index))
    out = expanded.groupBy(*on).agg(side(first).alias("_a"), side(second).alias("_b"))
    both = out.filter("_a is not null and _b is not null")
    return both.select(*on, S.phase_name(F.col("_a")).alias("label_a"), S.phase_name(F.col("_b")).alias("label_b"))


def overlap_cells(bounds: DataFrame, first: str, second: str, keys=(), columns=S.HUMAN_MARKS) -> DataFrame:
    """Frames by label of either annotator (``_c<i><j>``), per key, without a row per frame.

    A cycle's marks cut half-open intervals; both annotators' records meet in one grouping on
    cycles and the shared frames of two intervals are min(ends) - max(starts). Of repeated records the greatest holds.
    """
    side = lambda who: F.max(F.when(F.col("annotator_id") == who, F.struct(*columns)))
    cycles = bounds.groupBy(*keys, "sequence_id", "cycle_id").agg(side(first).alias("_a"), side(second).alias("_b"))
    span = lambda who, i: (F.col(f"{who}.{columns[i]}"), F.col(f"{who}.{columns[i + 1]}"))

    def shared(i, j):
        (a0, a1), (b0, b1) = span("_a", i), span("_b", j)
        known = a0.isNotNull() & a1.isNotNull() & b0.isNotNull() & b1.isNotNull()
        return F.when(known, F.greatest(F.least(a1, b1) - F.greatest(a0, b0), F.lit(0))).otherwise(0).cast("bigint")

    every = [(i, j) for i in range(K) for j in range(K)]
    return cycles.groupBy(*keys).agg(*[F.coalesce(F.sum(shared(i, j)), F.lit(0)).alias(f"_c{i}{j}") for i, j in every])


def interval_report(bounds: DataFrame, first: str, second: str, keys=(), gate: float = S.KAPPA_GATE) -> DataFrame:
    """Raw agreement and weighted kappa of two annotators' cycles, from interval overlaps."""
    return _scores(overlap_cells(bounds, first, second, keys), keys, gate)


def report(paired: DataFrame, keys=(), gate: float = S.KAPPA_GATE) -> DataFrame:
    """The same scores for labels that are paired frame by frame."""
    a, b = S.phase_index(F.col("label_a"), True), S.phase_index(F.col("label_b"), True)
    rows = paired.withColumn("_a", a).withColumn("_b", b)
    cells = [F.count_if((F.col("_a") == i) & (F.col("_b") == j)).alias(f"_c{i}{j}") for i in range(K) for j in range(K)]
    return _scores(rows.groupBy(*keys).agg(*cells), keys, gate)


def _scores(wide: DataFrame, keys, gate: float) -> DataFrame:
    """Raw agreement and quadratic weighted kappa of a table of label pairs.

    Kappa weights are squared rank distances among the labels either side uses, so an unused
    middle label does not stretch the scale. One constant label on both sides gives null.
    """
    cell = lambda i, j: F.col(f"_c{i}{j}")
    total = lambda parts: sum(parts[1:], parts[0])
    every = [(i, j) for i in range(K) for j in range(K)]
    wide = wide.withColumn("frames", total([cell(i, j) for i, j in every]))
    wide = wide.withColumns({f"_r{i}": total([cell(i, j) for j in range(K)]) for i in range(K)})
    wide = wide.withColumns({f"_s{j}": total([cell(i, j) for i in range(K)]) for j in range(K)})
    used = [F.when(F.col(f"_r{i}") + F.col(f"_s{i}") > 0, 1).otherwise(0) for i in range(K)]
    wide = wide.withColumns({f"_k{i}": total([F.lit(0), *used[:i]]) for i in range(K)})
    weight = lambda i, j: (F.col(f"_k{i}") - F.col(f"_k{j}")) * (F.col(f"_k{i}") - F.col(f"_k{j}"))
    seen = total([weight(i, j) * cell(i, j) for i, j in every])
    chance = total([(weight(i, j) * F.col(f"_r{i}")).cast("double") * F.col(f"_s{j}") for i, j in every])
    same = total([cell(i, i) for i in range(K)])
    kappa = F.lit(1.0) - F.try_divide(seen.cast("double"), F.try_divide(chance, F.col("frames")))
    out = wide.select(*keys, "frames", F.try_divide(same, F.col("frames")).alias("raw_agreement"), kappa.alias("weighted_kappa"))
    status = F.when(F.col("weighted_kappa") >= gate, "PASS").otherwise("FAIL")
    return out.withColumn("status", status)


def boundary_disagreement(
    bounds: DataFrame, first: str, second: str, fps: float, keys=(), columns=S.HUMAN_MARKS
) -> DataFrame:
    """Mean absolute difference of the five boundaries over cycles both annotators marked."""
    if fps <= 0:
        raise ValueError("fps must be positive.")
    side = lambda who, c: F.max(F.when(F.col("annotator_id") == who, F.col(c)))
    aggs = [side(first, c).alias(f"_a_{c}") for c in columns] + [side(second, c).alias(f"_b_{c}") for c in columns]
    merged = bounds.groupBy(*keys, "sequence_id", "cycle_id").agg(*aggs)
    matched = merged.filter(F.col(f"_a_{columns[0]}").isNotNull() & F.col(f"_b_{columns[0]}").isNotNull())
    total = sum((F.abs(F.col(f"_a_{c}") - F.col(f"_b_{c}")) for c in columns[1:]), F.abs(F.col(f"_a_{columns[0]}") - F.col(f"_b_{columns[0]}")))
    out = matched.groupBy(*keys).agg(F.count(F.lit(1)).alias("cycles"), F.sum(total).alias("_sum"))
    none = F.raise_error(F.lit("No matching cycles were available for boundary comparison.")).cast("double")
    mean = F.when(F.col("cycles") > 0, F.col("_sum") / (F.col("cycles") * len(columns))).otherwise(none)
    return out.select(*keys, "cycles", mean.alias("mean_absolute_frames")).withColumn(
        "mean_absolute_milliseconds", F.col("mean_absolute_frames") * 1000.0 / F.lit(float(fps))
    )

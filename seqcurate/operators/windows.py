"""Gap-free segments, runs of hits, context windows, clips and overlap averaging."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import schemas as S
from . import blocks


def breaks(df: DataFrame, keys, order: str, tie=(), placed: bool = False) -> DataFrame:
    """Add ``_break``: the row does not directly follow the previous one (order - 1).

    ``placed`` rows keep their block, for a further step on the same shuffle.
    """
    rows = blocks.spread(blocks.halo(df, order, 1, 0), keys, shared=placed)
    previous = F.lag(order).over(blocks.per_block(keys).orderBy(order, *tie))
    follows = F.coalesce(previous == F.col(order) - 1, F.lit(False))
    out = blocks.core(rows.withColumn("_break", ~follows))
    return out if placed else out.drop(blocks.BLOCK)


def segments(df: DataFrame, keys, order: str, tie=(), name: str = "segment") -> DataFrame:
    """Number the gap-free segments of each sequence from 1."""
    marked = breaks(df, keys, order, tie, placed=True)
    return blocks.running_sum(marked, keys, order, F.col("_break").cast("bigint"), name, tie, placed=True).drop("_break")


def runs(df: DataFrame, keys, order: str, start: str = "run_start") -> DataFrame:
    """Add the first order value of the run of consecutive values each row belongs to."""
    marked = breaks(df, keys, order, placed=True)
    here = F.when(F.col("_break"), F.col(order))
    return blocks.carry(marked, keys, order, last={start: here}, rising=True, placed=True).drop("_break")


def run_peaks(df: DataFrame, keys, order: str, score: str) -> DataFrame:
    """One row per run of consecutive hits: the highest score, the first row on a tie."""
    best = F.max_by(order, F.struct(F.col(score), -F.col(order)))
    return runs(df, keys, order).groupBy(*keys, "run_start").agg(best.alias(order), F.max(score).alias(score))


def context(
    df: DataFrame,
    keys,
    order: str,
    item: str,
    width: int,
    control: str = "ordered",
    seed: int = S.SEED,
    tie=(),
    name: str = "context",
) -> DataFrame:
    """Centred window of ``width`` items per row, clamped to the row's gap-free segment.

    ``repeated`` puts the centre in every slot; ``shuffled`` keeps the centre and reorders the
    rest by a seeded hash, rotated by one when the order would not change.
    """
    if width < 3 or width % 2 == 0:
        raise ValueError("The window must be an odd integer of at least three.")
    radius = width // 2
    if control == "repeated":
        return df.withColumn(name, F.array_repeat(F.col(item), width))
    if control not in {"ordered", "shuffled"}:
        raise ValueError(f"Unknown temporal control: {control}")
    rows = blocks.spread(blocks.halo(df, order, radius + 1, radius), keys)
    ordered = blocks.per_block(keys).orderBy(order, *tie)
    follows = F.coalesce(F.lag(order).over(ordered) == F.col(order) - 1, F.lit(False))
    rows = rows.withColumn("_cut", (~follows).cast("int"))
    rows = rows.withColumn("_seg", F.sum("_cut").over(ordered.rowsBetween(Window.unboundedPreceding, 0)))
    part = blocks.per_block(keys, "_seg").orderBy(order, *tie)
    before = F.collect_list(item).over(part.rowsBetween(-radius, -1))
    after = F.collect_list(item).over(part.rowsBetween(1, radius))
    rows = rows.withColumn("_l", before).withColumn("_r", after)
    edge = lambda side, at: F.coalesce(F.try_element_at(side, F.lit(at)), F.col(item))
    left = F.concat(F.array_repeat(edge(F.col("_l"), 1), radius - F.size("_l")), F.col("_l"))
    right = F.concat(F.col("_r"), F.array_repeat(edge(F.col("_r"), -1), radius - F.size("_r")))
    rows = blocks.core(rows.withColumn("_left", left).withColumn("_right", right))
    if control == "shuffled":
        others = F.concat("_left", "_right")
        key = lambda x, i: F.sha2(F.concat_ws(":", F.lit(str(seed)), F.col(item), x, i.cast("string")), 256)
        keyed = F.array_sort(F.transform(others, lambda x, i: F.struct(key(x, i).alias("k"), x.alias("v"))))
        mixed = F.transform(keyed, lambda pair: pair["v"])
        turned = F.concat(F.slice(mixed, 2, 2 * radius - 1), F.slice(mixed, 1, 1))
        rows = rows.withColumn("_mixed", mixed).withColumn("_mixed", F.when(mixed == others, turned).otherwise(mixed))
        rows = rows.withColumn("_left", F.slice("_mixed", 1, radius))
        rows = rows.withColumn("_right", F.slice("_mixed", radius + 1, radius))
    return rows.withColumn(name, F.concat("_left", F.array(item), "_right")).select(*df.columns, name)


def located_in_segment(df: DataFrame, keys, order: str, label: str | None = None) -> DataFrame:
    """Add segment start, length and position (and the label-change flag inside the segment)."""
    rows = blocks.spread(blocks.halo(df, order, 1, 1), keys, shared=True)
    w = blocks.per_block(keys).orderBy(order)
    follows = F.coalesce(F.lag(order).over(w) == F.col(order) - 1, F.lit(False))
    ends = ~F.coalesce(F.lead(order).over(w) == F.col(order) + 1, F.lit(False))
    rows = rows.withColumn("_starts", ~follows).withColumn("_ends", ends)
    if label is not None:
        changed = follows & (F.lag(label).over(w) != F.col(label))
        rows = rows.withColumn("is_boundary", F.coalesce(changed, F.lit(False)).cast("int"))
    out = blocks.carry(
        blocks.core(rows),
        keys,
        order,
        last={"segment_start": F.when(F.col("_starts"), F.col(order))},
        first={"_last": F.when(F.col("_ends"), F.col(order))},
        rising=True,
        placed=True,
    )
    return out.withColumns(
        {
            "segment_length": F.col("_last") - F.col("segment_start") + 1,
            "segment_position": F.col(order) - F.col("segment_start"),
        }
    ).drop("_starts", "_ends", "_last")


def clips(df: DataFrame, keys, order: str, label: str, width: int, stride: int) -> DataFrame:
    """Overlapping clips of fixed length: one row per (clip, slot).

    Each frame works out which clips hold it, so a segment of any length is never expanded in
    one task. Short segments are padded with their last frame (``valid`` false).
    """
    if width < 3 or width % 2 == 0:
        raise ValueError("The clip length must be an odd integer of at least three.")
    if stride < 1 or stride > width:
        raise ValueError("The stride must be between one and the clip length.")
    rows = located_in_segment(df.select(*keys, order, label), keys, order, label)
    at, length = F.col("segment_position"), F.col("segment_length")
    final = F.greatest(F.lit(0), length - width)
    low = F.greatest(F.lit(0), F.ceil((at - width + 1) / stride) * stride)
    high = F.least(at, final)
    regular = F.when(low <= high, F.sequence(low.cast("bigint"), high.cast("bigint"), F.lit(stride).cast("bigint")))
    regular = F.coalesce(regular, F.expr("cast(array() as array<bigint>)"))
    closing = F.when(at >= final, F.array(final.cast("bigint"))).otherwise(F.expr("cast(array() as array<bigint>)"))
    rows = rows.withColumn("clip_start", F.explode(F.array_union(regular, closing)))
    slot = at - F.col("clip_start")
    pad = F.when((at == length - 1) & (length < width), F.lit(width) - 1).otherwise(slot)
    rows = rows.withColumn("_slot", slot).withColumn("slot", F.explode(F.sequence(slot, pad.cast("bigint"))))
    return rows.withColumn("valid", F.col("slot") == F.col("_slot")).select(
        *keys, "segment_start", "clip_start", "slot", order, label, "is_boundary", "valid"
    )


def overlap_average(scored: DataFrame, keys, probabilities: list[str], extra: list[str] = (), expected: DataFrame | None = None) -> DataFrame:
    """Mean of each probability over the clips covering a frame, and the winning label.

    ``expected`` holds the keys of all frames that have to be covered; one that no clip covers stops the job. Its rows join
    the same grouping.
    """
    values = [*probabilities, *extra]
    rows = scored.select(*keys, *values, F.lit(1).alias("_clip"))
    if expected is not None:
        rows = rows.unionByName(expected.select(*keys), allowMissingColumns=True)
    out = rows.groupBy(*keys).agg(*[F.avg(c).alias(c) for c in values], F.count("_clip").alias("covered"))
    name = F.concat_ws(", ", *[F.col(k).cast("string") for k in keys])
    missing = F.raise_error(F.concat(F.lit("No clip covers the frame "), name)).cast("bigint")
    out = out.withColumn("covered", F.when(F.col("covered") > 0, F.col("covered")).otherwise(missing))
    chosen = F.array(*probabilities)
    winner = F.array_position(chosen, F.array_max(chosen)) - 1
    return out.withColumn("y_pred", S.phase_name(winner))


#: Smallest probability that a logarithm is taken of.
LEAST_PROBABILITY = 1e-7


def sequence_scores(
    df: DataFrame,
    keys,
    order: str,
    target: Column,
    probabilities: list[str],
    boundary: str,
    boundary_probability: str,
    class_weights: dict[int, float] | None = None,
    boundary_weight: float = 1.0,
    group=(),
) -> DataFrame:
    """Evaluate a saved probability table: label and boundary cross-entropy, smoothness, order.

    Pairs are consecutive frames (order + 1); smoothness skips pairs that end on a boundary and
    clamps squared log changes at 4; probabilities below LEAST_PROBABILITY count as that; order is the expected mass of transitions not allowed.
    """
    count = len(probabilities)
    log = lambda p: F.ln(F.greatest(p, F.lit(LEAST_PROBABILITY)))
    rows = blocks.spread(blocks.halo(df.withColumn("_t", target), order, 1, 0), keys)
    w = blocks.per_block(keys).orderBy(order)
    pair = F.coalesce(F.lag(order).over(w) == F.col(order) - 1, F.lit(False))
    before = [F.when(pair, F.lag(p).over(w)) for p in probabilities]
    rows = rows.select("*", pair.alias("_pair"), *[b.alias(f"_b{i}") for i, b in enumerate(before)])
    rows = blocks.core(rows)
    chosen = F.element_at(F.array(*probabilities), F.col("_t") + 1)
    weight = F.lit(1.0)
    if class_weights:
        weight = F.element_at(F.array(*[F.lit(float(class_weights[i])) for i in range(count)]), F.col("_t") + 1)
    p = F.col(boundary_probability)
    bce = -(F.lit(float(boundary_weight)) * F.col(boundary) * log(p) + (1 - F.col(boundary)) * log(1 - p))
    steps = [F.least(F.pow(log(F.col(c)) - log(F.col(f"_b{i}")), F.lit(2.0)), F.lit(4.0)) for i, c in enumerate(probabilities)]
    change = sum(steps[1:], steps[0]) / count
    illegal = F.lit(0.0)
    for i in range(count):
        for j in range(count):
            if j not in S.ALLOWED_TRANSITIONS[i]:
                illegal = illegal + F.col(f"_b{i}") * F.col(probabilities[j])
    smooth = F.when(F.col("_pair") & (F.col(boundary) == 0), change)
    return rows.groupBy(*group).agg(
        F.count(F.lit(1)).alias("frames"),
        (F.sum(-weight * log(chosen)) / F.sum(weight)).alias("phase_loss"),
        F.avg(bce).alias("boundary_loss"),
        F.coalesce(F.avg(smooth), F.lit(0.0)).alias("smoothness_loss"),
        F.coalesce(F.avg(F.when(F.col("_pair"), illegal)), F.lit(0.0)).alias("order_loss"),
    )

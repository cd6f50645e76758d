"""Joins of tables that must hold each key once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _paired(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """Both sides of every key in one grouping: how often the key occurs on either side, and a row of each."""
    a, b = ([c for c in side.columns if c not in on] for side in (left, right))
    pack = lambda side, names: side.select(*on, F.struct(F.lit(True).alias("_in"), *[F.col(f"`{c}`") for c in names]).alias("_row"))
    both = pack(left, a).withColumnRenamed("_row", "_l").unionByName(pack(right, b).withColumnRenamed("_row", "_r"), allowMissingColumns=True)
    return both.groupBy(*on).agg(
        F.count("_l").alias("_nl"), F.count("_r").alias("_nr"), F.first("_l", ignorenulls=True).alias("_l"), F.first("_r", ignorenulls=True).alias("_r")
    )


def one_to_one(left: DataFrame, right: DataFrame, on, how: str = "inner") -> DataFrame:
    """Inner or left join that stops at a key that either side repeats.

    Uniqueness is counted by the grouping that brings the sides together, so the check costs no pass of its own, and a
    key with very many rows is one row per task before it is shuffled. Null is a key like any other.
    Columns besides the key must differ.
    """
    if how not in ("inner", "left"):
        raise ValueError(f"Unknown join: {how}")
    on = [on] if isinstance(on, str) else list(on)
    rest = [c for c in (*left.columns, *right.columns) if c not in on]
    if len(set(rest)) < len(rest):
        raise ValueError(f"Both sides have the columns {sorted({c for c in rest if rest.count(c) > 1})}")
    key = F.concat_ws(", ", *[F.coalesce(F.col(c).cast("string"), F.lit("null")) for c in on])
    side = F.when(F.col("_nl") > 1, "left").otherwise("right")
    stop = F.raise_error(F.concat(F.lit("Repeated key on the "), side, F.lit(" side: "), key)).cast("boolean")
    wanted = F.col("_nl") > 0 if how == "left" else (F.col("_nl") > 0) & (F.col("_nr") > 0)
    # In the filter, where no pruning of columns can lose it.
    kept = _paired(left, right, on).where(F.when((F.col("_nl") > 1) | (F.col("_nr") > 1), stop).otherwise(wanted))
    values = [F.col(f"_l.`{c}`").alias(c) for c in left.columns if c not in on] + [F.col(f"_r.`{c}`").alias(c) for c in right.columns if c not in on]
    return kept.select(*on, *values)


def one_to_one_report(left: DataFrame, right: DataFrame, on) -> DataFrame:
    """(rule, violations): repeated keys and keys without a partner, of either side, from one grouping."""
    on = [on] if isinstance(on, str) else list(on)
    both = _paired(left.select(*on), right.select(*on), on)
    checks = {
        "left key unique": F.col("_nl") > 1,
        "right key unique": F.col("_nr") > 1,
        "left key has a partner": F.col("_nr") == 0,
        "right key has a partner": F.col("_nl") == 0,
    }
    from .rules import scalar

    return scalar(both, checks)

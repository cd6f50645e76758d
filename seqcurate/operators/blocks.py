"""Ordered work over sequences of any length.

A sequence may hold a large share of all rows, so nothing here puts one whole sequence into
one task. Rows are cut into blocks of a fixed span of the order column, windows run per
(sequence, block), and only one small row per block crosses block borders:

* ``halo``   copies the rows near a border into the neighbouring block (local neighbourhoods);
* ``carry``  fills the last/next known value across blocks (as-of, interpolation, run starts);
* ``rank``   numbers rows with per-bucket counts and offsets (global or per key).

Rows without a key or an order value have no place in a sequence. ``route`` splits them off into a ledger; what
still has one when it reaches a block stops the job, so no row disappears. The table of block borders is read
from the rows after their shuffle, so the input is evaluated once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows (or frame numbers) per block. A block is one sort group of one task.
SPAN = 65_536
BLOCK = "_block"


def block_of(order: Column, span: int | None = None) -> Column:
    return F.floor(order / F.lit(span or SPAN)).cast("bigint")


def _absent(keys, order: str) -> Column:
    """Why a row has no place, null if it has one."""
    return F.coalesce(*[F.when(F.col(c).isNull(), F.lit(f"no {c}")) for c in (*keys, order)])


def route(df: DataFrame, keys, order: str) -> tuple[DataFrame, DataFrame]:
    """(rows with a place, ledger of the others with ``reject_reason``)."""
    marked = df.withColumn("reject_reason", _absent(keys, order))
    return df.filter(_absent(keys, order).isNull()), marked.filter("reject_reason is not null")


def reject_counts(df: DataFrame, keys, order: str) -> DataFrame:
    """Rows without a place by reason."""
    return route(df, keys, order)[1].groupBy("reject_reason").agg(F.count(F.lit(1)).alias("rows"))


def halo(df: DataFrame, order: str, before: int, after: int, span: int | None = None) -> DataFrame:
    """Place each row in its own block and in every block that needs it as context.

    A block then sees all rows from ``before`` units below its first order value to ``after``
    units above its last one. ``_core`` is true for the row's own block only. A row without an order value is in no
    block, which ``spread`` refuses.
    """
    value, span = F.col(order), span or SPAN
    low = F.floor((value - F.lit(after)) / F.lit(span)).cast("bigint")
    high = F.floor((value + F.lit(before)) / F.lit(span)).cast("bigint")
    return df.withColumn(BLOCK, F.explode_outer(F.sequence(low, high))).withColumn(
        "_core", F.col(BLOCK) == block_of(value, span)
    )


def spread(df: DataFrame, keys, shared: bool = False) -> DataFrame:
    """Shuffle on (keys, block) even when the input is already partitioned on the keys alone.

    Without this Spark would accept the coarser partitioning and leave a hot key in one task. With
    ``shared`` the result may be read twice for one evaluation: both readers ask for all columns, so their
    shuffles are the same and Spark reuses one. A row without key or order stops the job.
    """
    lost = F.concat(F.lit("A row without a place in a sequence ("), F.coalesce(_absent(keys, BLOCK), F.lit("")), F.lit("): split such rows off with blocks.route"))
    stop = F.raise_error(lost).cast("boolean")
    # Always true, but not for the optimizer: what a later join would infer ("key is not null") stays behind the check.
    whole = F.monotonically_increasing_id() >= 0
    if shared:
        plain = [F.to_json(F.struct(f.name)) if "map<" in f.dataType.simpleString() else F.col(f"`{f.name}`") for f in df.schema.fields]
        whole = whole | (F.xxhash64(*plain) == 0)
    return df.repartition(*keys, BLOCK).filter(F.when(_absent(keys, BLOCK).isNotNull(), stop).otherwise(whole))


def core(df: DataFrame) -> DataFrame:
    return df.filter("_core").drop("_core")


def per_block(keys, *extra) -> "Window":
    return Window.partitionBy(*keys, BLOCK, *extra)


def carry(
    df: DataFrame,
    keys: list[str],
    order: str,
    last: dict[str, Column] | None = None,
    first: dict[str, Column] | None = None,
    tie: tuple[str, ...] = (),
    inclusive: bool = True,
    span: int | None = None,
    rising: bool | set[str] = False,
    attach: DataFrame | None = None,
    placed: bool = False,
) -> DataFrame:
    """Add, per row, the latest known value before it and the earliest known value after it.

    ``last``/``first`` map new column names to expressions; null means "unknown here". Names in
    ``rising`` hold values that never fall along the order (often the order itself), so a block
    needs only their max or min. ``attach`` is a table with one row per key whose columns are
    added; it travels with the block table (one row per block), so a hot key never has to meet
    its rows in one task. Rows are shuffled once, on (keys, block), and the block table is read from them after
    that; ``placed`` rows were already spread, and bring their block.
    """
    last, first = last or {}, first or {}
    ordering = [order, *tie]
    columns_out = [c for c in df.columns if c != BLOCK]
    rows = df if placed else spread(df.withColumn(BLOCK, block_of(F.col(order), span)), keys, shared=True)
    for name, expr in [*last.items(), *first.items()]:
        rows = rows.withColumn(f"_v_{name}", expr)
    place = F.struct(*ordering) if tie else F.col(order)

    def edge(name: str, extreme, by):
        value = F.col(f"_v_{name}")
        if rising is True or (rising and name in rising):
            return extreme(value).alias(f"_s_{name}")
        return by(value, F.when(value.isNotNull(), place)).alias(f"_s_{name}")

    aggs = [edge(name, F.max, F.max_by) for name in last] + [edge(name, F.min, F.min_by) for name in first]
    table = rows.groupBy(*keys, BLOCK).agg(*aggs)

    whole = Window.partitionBy(*keys)
    below = whole.orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    above = whole.orderBy(F.col(BLOCK).desc()).rowsBetween(Window.unboundedPreceding, -1)
    columns = [F.col(k) for k in keys] + [F.col(BLOCK)]
    for name in last:
        columns.append(F.last(f"_s_{name}", ignorenulls=True).over(below).alias(f"_in_{name}"))
    for name in first:
        columns.append(F.last(f"_s_{name}", ignorenulls=True).over(above).alias(f"_in_{name}"))
    table = table.select(*columns)
    extra = []
    if attach is not None:
        extra = [name for name in attach.columns if name not in keys]
        table = table.join(attach, keys, "left")

    stop = Window.currentRow if inclusive else -1
    up = per_block(keys).orderBy(*ordering).rowsBetween(Window.unboundedPreceding, stop)
    down = (
        per_block(keys)
        .orderBy(*[F.col(c).desc() for c in ordering])
        .rowsBetween(Window.unboundedPreceding, stop)
    )
    for name in last:
        rows = rows.withColumn(f"_w_{name}", F.last(f"_v_{name}", ignorenulls=True).over(up))
    for name in first:
        rows = rows.withColumn(f"_w_{name}", F.last(f"_v_{name}", ignorenulls=True).over(down))
    joined = rows.join(table, [*keys, BLOCK])
    for name in [*last, *first]:
        joined = joined.withColumn(name, F.coalesce(f"_w_{name}", f"_in_{name}"))
    return joined.select(*columns_out, *last, *first, *extra)


def rank(
    df: DataFrame,
    keys: list[str],
    order: list,
    bucket: Column,
    name: str = "position",
    total: str | None = None,
) -> DataFrame:
    """0-based ``row_number`` per key without one task per key.

    ``bucket`` must not decrease along ``order`` (a hash prefix, an hour); each bucket is numbered alone
    and shifted by the number of rows in earlier buckets, so a key with very many rows is as many groups as it has
    buckets. With no keys the offset window runs over one row per bucket only. Null is a key and a bucket like any other.
    """
    rows = df.withColumn("_bucket", bucket)
    offsets = _offsets(rows, keys, total)
    local = F.row_number().over(Window.partitionBy(*keys, "_bucket").orderBy(*order))
    same = [F.col(f"_r.{k}").eqNullSafe(F.col(f"_o.{k}")) for k in (*keys, "_bucket")]
    numbered = rows.withColumn("_local", local).alias("_r").join(offsets.alias("_o"), same)
    position = F.col("_o._offset") + F.col("_r._local") - F.lit(1)
    return numbered.select(*[F.col(f"_r.`{c}`") for c in df.columns], position.alias(name), *([F.col(f"_o.{total}")] if total else []))


def _offsets(rows: DataFrame, keys, total: str | None = None) -> DataFrame:
    """Rows in earlier buckets of the same key, one row per bucket."""
    counts = rows.groupBy(*keys, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    window = Window.partitionBy(*keys)
    below = window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    return counts.select(
        *keys,
        "_bucket",
        F.coalesce(F.sum("_n").over(below), F.lit(0)).alias("_offset"),
        F.sum("_n").over(window).alias(total or "_total"),
    )


def running_sum(df, keys, order, value: Column, name: str, tie=(), span: int | None = None, placed: bool = False) -> DataFrame:
    """Inclusive running sum per key: block-local sum plus the sum of earlier blocks; ``placed`` as in ``carry``."""
    columns_out = [c for c in df.columns if c != BLOCK]
    rows = df if placed else spread(df.withColumn(BLOCK, block_of(F.col(order), span)), keys, shared=True)
    rows = rows.withColumn("_v", value)
    table = rows.groupBy(*keys, BLOCK).agg(F.sum("_v").alias("_s"))
    below = Window.partitionBy(*keys).orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    table = table.select(*keys, BLOCK, F.coalesce(F.sum("_s").over(below), F.lit(0)).alias("_base"))
    up = per_block(keys).orderBy(order, *tie).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("_part", F.sum("_v").over(up)).join(table, [*keys, BLOCK])
    return rows.withColumn(name, F.col("_part") + F.col("_base")).select(*columns_out, name)


def explode_span(df: DataFrame, start: Column, stop: Column, name: str, chunk: int = 4096) -> DataFrame:
    """One row per integer of [start, stop); long spans are cut into chunks before the second explode."""
    low = F.explode(F.sequence(start, stop - 1, F.lit(chunk).cast("bigint")))
    pieces = df.withColumn("_stop", stop).filter(F.col("_stop") > start).withColumn("_low", low)
    high = F.least(F.col("_low") + F.lit(chunk), F.col("_stop")) - 1
    return pieces.withColumn(name, F.explode(F.sequence("_low", high))).drop("_low", "_stop")


def one_row(*tables: DataFrame) -> DataFrame:
    """Columns of several one-row tables as one row (a union and an aggregate, no join)."""
    out = tables[0]
    for table in tables[1:]:
        out = out.unionByName(table, allowMissingColumns=True)
    return out.agg(*[F.max(c).alias(c) for c in out.columns])

"""From a per-sequence 1-D signal to separated contact peaks.

Frames of a sequence are consecutive integers; all windows run on (sequence, block).
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import stage
from . import blocks

MIN_DISTANCE = 7
PROMINENCE = 0.015
#: Candidate blocks and their context, in frames (see ``suppress``).
CANDIDATE_SPAN = 16_384
CANDIDATE_HALO = 128


def interpolate(df: DataFrame, keys, order: str, value: str, name: str = "filled") -> DataFrame:
    """Linear interpolation between known neighbours, edges held, all-missing gives zero."""
    at = F.when(F.col(value).isNotNull(), F.col(order))
    out = blocks.carry(
        df,
        keys,
        order,
        last={"_x0": at, "_y0": F.col(value)},
        first={"_x1": at, "_y1": F.col(value)},
        rising={"_x0", "_x1"},
    )
    x0, y0, x1, y1 = (F.col(c) for c in ("_x0", "_y0", "_x1", "_y1"))
    between = F.when(x1 > x0, (y1 - y0) / (x1 - x0) * (F.col(order) - x0) + y0)
    filled = F.coalesce(F.col(value), between, y0, y1, F.lit(0.0))
    return out.withColumn(name, filled).drop("_x0", "_y0", "_x1", "_y1")


def _smoothed(window, order, value: str, width: int):
    """Centred mean with replicated edges; unchanged when the sequence is shorter than ``width``."""
    if width <= 1:
        return F.col(value)
    radius = width // 2
    ordered = window.orderBy(order)
    head = F.first(value).over(ordered.rowsBetween(-radius, 0))
    tail = F.last(value).over(ordered.rowsBetween(0, radius))
    parts = [F.coalesce(F.lag(value, k).over(ordered), head) for k in range(radius, 0, -1)]
    parts.append(F.col(value))
    parts += [F.coalesce(F.lead(value, k).over(ordered), tail) for k in range(1, radius + 1)]
    total = reduce(lambda left, right: left + right, parts)
    seen = F.count(F.lit(1)).over(ordered.rowsBetween(1 - width, width - 1))
    return F.when(seen < width, F.col(value)).otherwise(total / F.lit(float(width)))


def smooth(df: DataFrame, keys, order: str, value: str, width: int = 3, name: str = "smoothed") -> DataFrame:
    rows = blocks.spread(blocks.halo(df, order, width - 1, width - 1), keys)
    out = rows.withColumn(name, _smoothed(blocks.per_block(keys), order, value, width))
    return blocks.core(out).drop(blocks.BLOCK)


def peak_candidates(
    df: DataFrame,
    keys,
    order: str,
    value: str,
    min_distance: int = MIN_DISTANCE,
    prominence: float = PROMINENCE,
    width: int = 3,
) -> DataFrame:
    """Interior local maxima of the smoothed signal with their local prominence.

    One halo shuffle serves smoothing, the neighbour test and both side minima.
    """
    radius = max(3, min_distance // 2)
    reach = radius + width - 1
    rows = blocks.spread(blocks.halo(df.select(*keys, order, value), order, reach, reach), keys)
    window = blocks.per_block(keys)
    ordered = window.orderBy(order)
    rows = rows.withColumn("signal", _smoothed(window, order, value, width))
    rows = rows.select(
        "*",
        F.lag("signal").over(ordered).alias("_l"),
        F.lead("signal").over(ordered).alias("_r"),
        F.min("signal").over(ordered.rowsBetween(-radius, -1)).alias("_lmin"),
        F.min("signal").over(ordered.rowsBetween(1, radius)).alias("_rmin"),
    )
    top = (F.col("signal") >= F.col("_l")) & (F.col("signal") >= F.col("_r"))
    rise = F.col("signal") - F.greatest("_lmin", "_rmin")
    out = blocks.core(rows).filter(top).withColumn("prominence", rise)
    return out.filter(F.col("prominence") >= prominence).select(*keys, order, "prominence", "signal")


def _decide(distance: int, span: int, context: int, keys: list[str], order: str):
    """The greedy choice of the blocks of a sorted stream, a batch of blocks at once; see ``suppress``."""

    def blocks_of(rows):
        """0 removed, 1 kept, 2 open, of whole blocks; nothing is known of rows outside a block and its context."""
        cells = rows[[*keys, blocks.BLOCK]]
        first = (cells != cells.shift()).any(axis=1).to_numpy()
        at, strength, level, fixed = (rows[c].to_numpy() for c in (order, "prominence", "signal", "fixed"))
        low = rows[blocks.BLOCK].to_numpy() * span - context
        high = low + span + 2 * context - 1
        # Places on one line: gaps shrink to the distance, and blocks lie that far apart, so only close rows of a block meet.
        steps = np.where(first[1:], distance, np.minimum(np.diff(at), distance))
        place = np.concatenate(([distance], distance + np.cumsum(steps))).astype(np.int64)
        kept, waits = bytearray(int(place[-1]) + distance + 1), bytearray(int(place[-1]) + distance + 1)
        state = np.zeros(len(at), np.int8)
        for i in np.flatnonzero(fixed).tolist():
            kept[place[i]] = state[i] = 1
        unseen = ((at - low < distance - 1) | (high - at < distance - 1)).tolist()
        places, known = place.tolist(), state.tolist()
        for i in np.lexsort((at, level, strength))[::-1].tolist():
            p = places[i]
            near = (p - distance + 1, p + distance)
            if known[i] or kept.find(1, *near) >= 0:
                continue
            if unseen[i] or waits.find(1, *near) >= 0:
                waits[p], known[i] = 1, 2
            else:
                kept[p] = known[i] = 1
        return np.array(known, np.int8)

    def groups(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Whole blocks of the stream, as many at once as a batch holds; a block has at most span + 2 context positions."""
        rest = None
        for rows in frames:
            rows = rows if rest is None else pd.concat([rest, rows], ignore_index=True)
            cells = rows[[*keys, blocks.BLOCK]]
            borders = np.flatnonzero((cells != cells.shift()).any(axis=1).to_numpy())
            last = int(borders[-1]) if len(borders) else 0
            if last:
                yield rows.iloc[:last]
            rest = rows.iloc[last:]
        if rest is not None and len(rest):
            yield rest

    def decide(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in groups(frames):
            state = blocks_of(rows)
            stays = rows["_core"].to_numpy() & (state > 0)
            yield rows[stays].assign(fixed=state[stays] == 1)[[*keys, order, "prominence", "signal", "fixed"]]

    return decide


def suppress(
    candidates: DataFrame,
    keys,
    order: str,
    min_distance: int = MIN_DISTANCE,
    span: int = CANDIDATE_SPAN,
    context: int = CANDIDATE_HALO,
) -> DataFrame:
    """Greedy separation: by prominence, value and position, keep what is far from all kept.

    A candidate is decided by its stronger neighbours closer than ``min_distance`` alone: it goes when one of
    them is kept and stays when all of them are gone. Blocks of a fixed span decide in parallel, each with some
    context; a candidate that hangs on an undecided one outside waits for the next round, when its
    neighbour's choice is known. Every round carries a chain of such candidates through a whole block, so there are
    (chain length / span) rounds at most, blocks never grow, and the result is that of the sequential rule.
    """
    context = max(context, min_distance - 1)
    decide = _decide(min_distance, span, context, list(keys), order)
    state = candidates.select(*keys, order, "prominence", "signal", F.lit(False).alias("fixed"))
    while True:
        placed = blocks.spread(blocks.halo(state, order, context, context, span), keys)
        placed = placed.sortWithinPartitions(*keys, blocks.BLOCK, order)
        state = stage(placed.mapInPandas(decide, state.schema), "peaks")
        if state.filter("not fixed").isEmpty():
            return state.drop("fixed")


def contact_peaks(df: DataFrame, keys, order: str, value: str, min_distance=MIN_DISTANCE, prominence=PROMINENCE):
    """Gap filling, smoothing, candidate search and separation in one call."""
    filled = interpolate(df.select(*keys, order, value), keys, order, value)
    found = peak_candidates(filled, keys, order, "filled", min_distance, prominence)
    return suppress(found, keys, order, min_distance)

"""Mixing sources to target weights by a Pfair schedule.

Each source's documents, in hashed order, form blocks of ``BLOCK`` documents; each slot takes one block.
The ideal mixture gives every source that still has blocks its share of the weights at every moment; when
a source runs out, the others go on with their weights renormalised, until every block is placed. A
block may be placed from the slot on in which the ideal mixture begins it and must be placed before the
slot in which it has ended it; while no source has run out, and with weights that add up to 1, that is from
floor((j-1)/w) and before ceil(j/w) for block j (from 1). Placing, slot by slot, the released block of the
earliest deadline keeps every source within one block of the ideal mixture at every slot.

The slots are found in one pass on the driver, over blocks, not documents: it holds one entry a source
and hands the places to Spark in tables of ``SPOOL`` slots.

``selected`` marks the slots before the first source has run out: there the target weights hold. Later
documents have slots too. A source's last block may be short.

Defined cases: a null source is a source of its own; repeated rows count each; an empty table gives
no row; sources without a weight or with weight 0 have no slot; if no weight is positive
nothing has. Ties of deadlines go to the source that sorts first.
"""

from __future__ import annotations

import bisect
import heapq
import itertools
import math
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqcurate.llm.common import LOOKUP_ROWS, number_rows, stage

BLOCK = 16
#: Slots of a frame of whole quotas (``quotas``, ``frame_slots``); the schedule takes the weights as they are.
FRAME = 4096
#: Without target weights a source weighs as the number of its documents to this power.
SMOOTHING = 0.7
#: Slots that the driver holds at a time.
SPOOL = 1 << 20


def quotas(weights: dict[str | None, float], frame: int = FRAME) -> dict[str | None, int]:
    """Blocks per frame, largest remainders; each source of positive weight has one at least."""
    positive = {s: w for s, w in weights.items() if w and w > 0}
    if len(positive) > frame:
        raise ValueError(f"{len(positive)} sources, at most {frame}")
    total = sum(positive.values())
    share = {s: w / total * frame for s, w in positive.items()}
    out = {s: max(1, math.floor(x)) for s, x in share.items()}
    ordered = sorted(share, key=lambda s: (out[s] - share[s], s is not None, s or ""))
    for s in ordered[: max(0, frame - sum(out.values()))]:
        out[s] += 1
    while sum(out.values()) > frame:
        most = max((s for s in out if out[s] > 1), key=lambda s: out[s] - share[s])
        out[most] -= 1
    return out


def ideal(weights: list[float], blocks: list[int]) -> Callable[[float], float]:
    """Blocks placed by the ideal mixture once each source has had ``v`` blocks per unit of weight, or all it has."""
    order = sorted(range(len(weights)), key=lambda s: blocks[s] / weights[s])
    ends = [blocks[s] / weights[s] for s in order]
    spent = list(itertools.accumulate((blocks[s] for s in order), initial=0))
    rest = list(itertools.accumulate((weights[s] for s in reversed(order)), initial=0.0))[::-1]

    def placed(v: float) -> float:
        k = bisect.bisect_left(ends, v)
        return spent[k] + rest[k] * v

    return placed


def snapped(x: float, up: bool) -> int:
    """Floor or ceiling; what rounding has moved off a whole number counts as that number."""
    slack = 1e-9 + 1e-12 * x
    return math.ceil(x - slack) if up else math.floor(x + slack)


def earliest_deadline(weights: list[float], blocks: list[int]) -> Iterator[tuple[int, int, int, int, int]]:
    """(source, block from 0, slot, release, deadline) of all blocks in order of slots; weights and blocks are positive."""
    placed = ideal(weights, blocks)

    def window(s: int, j: int, begin: float) -> tuple[int, int, int, int, float]:
        end = placed((j + 1) / weights[s])
        return snapped(begin, False), snapped(end, True), s, j, end

    waiting = [window(s, 0, 0.0) for s in range(len(weights))]
    heapq.heapify(waiting)
    ready: list = []
    slot = 0
    while waiting or ready:
        # Rounding may release a block too late; a slot is never left empty for it.
        while waiting and (waiting[0][0] <= slot or not ready):
            release, deadline, s, j, end = heapq.heappop(waiting)
            heapq.heappush(ready, (deadline, s, j, release, end))
        deadline, s, j, release, end = heapq.heappop(ready)
        yield s, j, slot, release, deadline
        if j + 1 < blocks[s]:
            heapq.heappush(waiting, window(s, j + 1, end))
        slot += 1


def frame_slots(quota: dict[str | None, int]) -> list[tuple[str | None, int, int, int, int]]:
    """(source, block within the frame from 0, slot, release, deadline) of one frame of whole quotas."""
    names = sorted(quota, key=lambda s: (s is not None, s or ""))
    q = [quota[s] for s in names]
    return [(names[s], *rest) for s, *rest in earliest_deadline(q, q)]


def slot_table(spark: SparkSession, names: list[str | None], weights: list[float], blocks: list[int]) -> DataFrame:
    """(_source, _block, slot, release, deadline) of all blocks."""
    schema = "_source string, _block long, slot long, release long, deadline long"
    parts, places, total = [], earliest_deadline(weights, blocks), sum(blocks)
    label = pa.array(names, pa.string())
    while rows := list(itertools.islice(places, SPOOL)):
        s, *numbers = zip(*rows, strict=True)
        columns = [label.take(pa.array(s, pa.int64())), *[pa.array(n, pa.int64()) for n in numbers]]
        part = spark.createDataFrame(pa.table(columns, names=["_source", "_block", "slot", "release", "deadline"]))
        parts.append(part if total <= SPOOL else stage(part, "slots"))
    out = parts[0] if parts else spark.createDataFrame([], schema)
    for part in parts[1:]:
        out = out.unionByName(part)
    return F.broadcast(out) if total <= LOOKUP_ROWS else out


def place(docs: DataFrame, weights: dict[str | None, float] | None = None, doc_id: str = "doc_id", source: str = "source") -> DataFrame:
    """Each row as the struct ``_doc``, with its doc_id, source, block, slot (null without a weight), release, deadline and ``selected``."""
    # Rows of one id, or of none, are told apart by their other columns.
    plain = [F.col(f"`{name}`") for name, kind in docs.dtypes if "map<" not in kind and kind != "variant"]
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc"),
        F.col(doc_id).alias("doc_id"),
        F.col(source).cast("string").alias("source"),
        F.xxhash64(*plain).alias("_tie"),
    )
    counts = {r["source"]: r["n"] for r in rows.groupBy("source").agg(F.count(F.lit(1)).alias("n")).collect()}
    target = {s: (n**SMOOTHING if weights is None else weights.get(s, 0.0)) for s, n in counts.items()}
    names = sorted((s for s, w in target.items() if w and w > 0), key=lambda s: (s is not None, s or ""))
    shares, blocks = [target[s] for s in names], [-(-counts[s] // BLOCK) for s in names]
    # The first source to run out ends the part in which the target weights hold.
    end = snapped(ideal(shares, blocks)(min(n / w for n, w in zip(blocks, shares, strict=True))), False) if names else 0
    numbered = number_rows(rows, "source", [F.col("doc_id"), F.col("_tie")]).withColumn("block", F.floor(F.col("_row") / BLOCK))
    slots = slot_table(docs.sparkSession, names, shares, blocks)
    placed = numbered.join(slots, F.col("source").eqNullSafe(F.col("_source")) & (F.col("block") == F.col("_block")), "left")
    return placed.select("_doc", "doc_id", "source", "block", "slot", "release", "deadline", F.coalesce(F.col("slot") < end, F.lit(False)).alias("selected"))


def schedule(docs: DataFrame, weights: dict[str | None, float] | None = None, doc_id: str = "doc_id", source: str = "source") -> DataFrame:
    """Each document's source, block, slot, release and deadline slot, and ``selected``."""
    return place(docs, weights, doc_id, source).drop("_doc")

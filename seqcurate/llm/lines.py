"""Fuzzy line dedup: of all similar lines of the corpus one stays.

Lines (trimmed of blanks) are shingled by character, signed by circulant MinHash and banded; candidate
pairs are verified by the Jaccard similarity of their full shingle sets; links become components
and each component keeps its first line, by document id and line number. A line repeated word for word
is one item from the start: it has one 64-bit hash.

With 10 bands of 3, two lines at exactly 0.75 meet in a bucket with probability 0.996, at 0.85 with
0.9999; shingles of 8 characters keep unrelated lines of one language far below.

Defined cases: lines without a visible character are never removed; a null text stays null; rows
of one id and text are one document and are cleaned alike; other columns are carried along. A
document all of whose lines with a word were removed is marked ``emptied``.
"""

from __future__ import annotations

import functools
import operator
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seqcurate.llm import minhash
from seqcurate.llm.common import join_lookup, stage, take_over, unused
from seqcurate.llm.hashing import code_points, mix

#: A power of two.
CHARACTERS = 8
BANDS, ROWS = 10, 3
LIKELY = 0.45
#: Characters signed at a time in a task, and shingles of a line that are ranked in one row.
PIECE, STEP = 1 << 15, 16
BLANKS = " \t\x0b\f\r"
PLACE = ("doc_id", "text_hash", "line_no", "id")


def _lower(cp: np.ndarray) -> np.ndarray:
    return cp + np.where((cp >= 65) & (cp <= 90), 32, 0).astype(cp.dtype)


def _grams(cp: np.ndarray) -> np.ndarray:
    """64-bit polynomial hashes of all runs of ``CHARACTERS`` code points, from runs of half the length."""
    out, step, power = cp.astype(np.uint64), 1, 0x9E3779B97F4A7C15
    while step < CHARACTERS:
        out = out[:-step] * np.uint64(power) + out[step:]
        step, power = 2 * step, power * power % (1 << 64)
    return out


def _points(text: str) -> np.ndarray:
    """Code points with A-Z in lower case."""
    return np.frombuffer(text.lower().encode(), np.uint8) if text.isascii() else _lower(code_points(text))


def line_sets(lines: list[str]) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of each line's character shingles; of the line itself if it is shorter."""
    padded = [line.ljust(CHARACTERS, "\0") for line in lines]
    hashes = mix(_grams(_points("".join(padded)))) if lines else np.zeros(0, np.uint64)
    out, at = [], 0
    for line in padded:
        out.append(minhash.distinct(hashes[at : at + len(line) - CHARACTERS + 1]))
        at += len(line)
    return out


def line_set(line: str) -> np.ndarray:
    return line_sets([line])[0]


def sign(lines: list[str]) -> np.ndarray:
    """Signatures of lines, one row a line; all lines of a piece at once."""
    padded = [line.ljust(CHARACTERS, "\0") for line in lines]
    lengths = np.array([len(p) for p in padded], np.int64)
    out = np.empty((len(lines), BANDS * ROWS), np.uint32)
    ends = np.cumsum(lengths)
    first = 0
    while first < len(lines):
        base = ends[first] - lengths[first]
        last = max(first + 1, int(np.searchsorted(ends, base + PIECE, "right")))
        if last == first + 1 and lengths[first] > PIECE:  # one very long line, piece by piece
            out[first] = minhash.signature(_grams(_points(padded[first])), BANDS * ROWS)
        else:
            places = minhash.places(_grams(_points("".join(padded[first:last]))))
            # Rows of STEP shingles of one line; the last shingle fills up its last row. Runs between two lines are in none.
            sizes = lengths[first:last] - CHARACTERS + 1
            rows = -(-sizes // STEP)
            begins = np.cumsum(rows) - rows
            starts = ends[first:last] - lengths[first:last] - base
            at = np.repeat(starts - STEP * begins, rows) + STEP * np.arange(rows.sum())
            stop = np.repeat(starts + sizes - 1, rows)
            least = minhash.ranks_at(places[at], BANDS * ROWS)
            for k in range(1, STEP):
                np.minimum(least, minhash.ranks_at(places[np.minimum(at + k, stop)], BANDS * ROWS), out=least)
            out[first:last] = np.minimum.reduceat(least, begins, axis=0)
        first = last
    return out


def _trimmed(line: Column) -> Column:
    """Without blanks at the ends; most lines have none, and looking at the ends is cheaper than trimming."""
    edges = [test(F.lit(b)) for b in BLANKS for test in (line.startswith, line.endswith)]
    return F.when(functools.reduce(operator.or_, edges), F.trim(line, F.lit(BLANKS))).otherwise(line)


def split_lines(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, line_no, line, id) of each line with a visible character."""
    # The hash is taken before the lines are, once a text.
    rows = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), F.split("text", "\n").alias("lines"))
    rows = rows.select("doc_id", "text_hash", F.posexplode("lines").alias("line_no", "line"))
    rows = rows.withColumn("line", _trimmed(F.col("line"))).where(F.col("line") != "")
    return rows.withColumn("id", F.xxhash64("line"))


def signatures(lines: DataFrame) -> DataFrame:
    """(doc_id, text_hash, line_no, id) of each line; n, bands and sig are null for all but one of a batch's equal lines."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        take_over("minhash", minhash.forget)
        for batch in batches:
            ids = batch.column("id").to_numpy()
            first = np.zeros(len(ids), bool)
            first[np.unique(ids, return_index=True)[1]] = True
            texts = batch.column("line").filter(pa.array(first)).to_pylist()
            signed = sign(texts)
            bands = minhash.bands(signed, ROWS).ravel()
            ends = np.concatenate(([0], np.cumsum(first)))
            lists = pa.ListArray.from_arrays(pa.array((ends * BANDS).astype(np.int32), mask=np.append(~first, False)), pa.array(bands))
            sigs = np.full(len(ids), None, object)
            sigs[first] = [s.tobytes() for s in signed.astype(np.uint8)]
            sizes = np.zeros(len(ids), np.int64)
            sizes[first] = [len(t) for t in texts]
            made = [pa.array(sizes, mask=~first), lists, pa.array(sigs, pa.binary())]
            yield pa.record_batch([batch.column(c) for c in PLACE] + made, [*PLACE, "n", "bands", "sig"])

    kinds = T.StructType([T.StructField(c, lines.schema[c].dataType) for c in PLACE])
    kinds = kinds.add("n", "long").add("bands", T.ArrayType(T.LongType())).add("sig", "binary")
    return lines.select(*PLACE, "line").mapInArrow(work, kinds)


def removals(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, gone): the numbers of the lines to remove, for each document that has any."""
    lines = split_lines(docs)

    def texts_of(ids: DataFrame) -> DataFrame:
        return join_lookup(lines.select("id", F.col("line").alias("text")), ids, "id").distinct()

    signed = stage(signatures(lines), "line-signatures")
    items = signed.where(F.col("n").isNotNull()).select("id", "n", "bands", "sig")
    roots = minhash.link(items, texts_of, line_sets, least=LIKELY, sized=False)
    classed = join_lookup(signed.select(*PLACE), roots.select(F.col("node").alias("id"), "root"), "id", "left")
    classed = classed.select("doc_id", "text_hash", "line_no", F.coalesce("root", "id").alias("class"))
    # Most classes have one line: only the others are ordered.
    many = classed.groupBy("class").agg(F.count(F.lit(1)).alias("size")).where(F.col("size") > 1).select("class")
    classed = stage(join_lookup(classed, many, "class"), "line-classes")
    here: Column = F.struct("doc_id", "text_hash", "line_no")
    several = classed.groupBy("class").agg(F.min(here).alias("first"), F.max(here).alias("last")).where(F.col("first") != F.col("last"))
    gone = join_lookup(classed, several.select("class", "first"), "class").where(here != F.col("first"))
    return gone.groupBy("doc_id", "text_hash").agg(F.collect_set("line_no").alias("gone"))


def dedup(docs: DataFrame) -> DataFrame:
    """All columns of the documents with the text cleaned, and n_lines, n_removed, emptied (existing columns of these names are replaced)."""
    columns = [c for c in docs.columns if c not in ("n_lines", "n_removed", "emptied")]
    cut, id_of, hash_of, all_of, left_of = (unused(name, *columns) for name in ("_gone", "_doc_id", "_text_hash", "_lines", "_left"))
    gone = removals(docs.select("doc_id", "text")).select(F.col("doc_id").alias(id_of), F.col("text_hash").alias(hash_of), F.col("gone").alias(cut))
    condition = F.col("doc_id").eqNullSafe(F.col(id_of)) & (F.xxhash64("text") == F.col(hash_of))
    joined = join_lookup(docs.select(*[F.col(f"`{c}`") for c in columns]), gone, condition, "left")
    joined = joined.withColumn(all_of, F.split("text", "\n"))
    left = F.filter(all_of, lambda _, k: ~F.array_contains(cut, k))
    joined = joined.withColumn(left_of, F.when(F.col(cut).isNotNull(), left))
    changed = F.col(left_of).isNotNull()
    new = [
        F.when(F.col("text").isNull(), 0).otherwise(F.size(all_of)).alias("n_lines"),
        F.when(changed, F.size(cut)).otherwise(0).alias("n_removed"),
        F.when(changed, ~F.exists(left_of, lambda line: _trimmed(line) != "")).otherwise(False).alias("emptied"),
    ]
    text = F.when(changed, F.array_join(left_of, "\n")).otherwise(F.col("text")).alias("text")
    return joined.select(*[text if c == "text" else F.col(f"`{c}`") for c in columns], *new)

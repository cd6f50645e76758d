"""Benchmark decontamination by a prefix-filtered set join with exact verification.

Texts are words (A-Z lower-cased); an item's windows are its runs of ``WINDOW`` words, the whole item where
it is shorter. A window is the set of its word shingles. Shingles are ordered by rarity, counted over all
documents. A window is contained in a document only if every one of its shingles is, so of that order a
prefix of one token has to be shared: its rarest shingle. Documents and windows are joined on
that token alone. The token's offset in the window and its place in the document give the only start to look
at; the words on both sides give the positional and length bounds; what is left is verified word by word over a
stretch as long as the window.

What travels: a bit table of ``BITS`` bits (1 MB, whatever the benchmark's size) marks the hashes of shingles
worth a look, once for counting and once for the prefix tokens. Documents emit only shingles whose bit is
set, with the few words around them, and these rows meet the windows in a join that Spark plans by size. A
crowded bit table lets more rows through and changes no result. No text is shuffled. Equal windows
of several items are one window.

Defined cases: a null or empty text, or one without a word, has no words and no window; a shingle longer
than a short item is the whole item; repeated rows are documents of their own and get equal results; items
of one id are one item; items without an id are one item with the empty id; no documents give no rows; without
items nothing is hit.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from seqcurate.llm.common import stage
from seqcurate.llm.hashing import mix

WINDOW = 10
SHINGLE = 3
#: Bits of the table of shingle hashes, a power of two.
BITS = 1 << 23
#: Bytes of text hashed at a time in a task; a longer text is a piece of its own.
PIECE = 1 << 20
BASE = np.uint64(0x9E3779B97F4A7C15)
#: Word bytes of UTF-8: digits, letters and everything that is not ASCII; A-Z are lower-cased first.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
IN_WORD = np.zeros(256, bool)
IN_WORD[48:58] = IN_WORD[97:123] = IN_WORD[128:] = True

SPANS = "array<struct<start:int,end:int>>"


class Words:
    """The words of some texts: bytes, where each starts and ends, and the row it belongs to."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.low = LOWER[data]
        inside = IN_WORD[self.low]
        rows = offsets[:-1][offsets[:-1] < offsets[1:]]
        before = np.zeros(len(inside), bool)
        before[1:] = inside[:-1]
        before[rows] = False
        self.starts = np.flatnonzero(inside & ~before)
        after = np.zeros(len(inside), bool)
        after[:-1] = inside[1:] & before[1:]
        self.ends = np.flatnonzero(inside & ~after) + 1
        self.row = np.searchsorted(offsets, self.starts, "right") - 1
        self.first = np.searchsorted(self.row, np.arange(len(offsets)))  # of each row's words; one more at the end
        self.hashes = self._hash(inside)

    def _hash(self, inside: np.ndarray) -> np.ndarray:
        if not len(self.starts):
            return np.zeros(0, np.uint64)
        lengths = self.ends - self.starts
        at = np.concatenate(([0], np.cumsum(lengths)[:-1]))
        powers = np.full(lengths.max(), BASE, np.uint64)
        powers[0] = 1
        powers = np.cumprod(powers, dtype=np.uint64)
        letters = self.low[inside].astype(np.uint64) + np.uint64(1)
        letters *= powers[np.arange(len(letters)) - np.repeat(at, lengths)]
        return mix(np.add.reduceat(letters, at) + lengths.astype(np.uint64))

    def shingles(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """The first word of every run of ``size`` words of one row, and the run's hash."""
        n = len(self.hashes) - size + 1
        if n <= 0:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        out = self.hashes[:n] + np.uint64(size)
        for k in range(1, size):
            out = mix(out * BASE + self.hashes[k : n + k])
        at = np.flatnonzero(self.row[:n] == self.row[size - 1 :])
        return at, out[at]

    def text(self, start: int, end: int) -> str:
        """Words start to end, one blank between them."""
        low = self.low
        return b" ".join(low[a:b].tobytes() for a, b in zip(self.starts[start:end], self.ends[start:end])).decode("utf-8", "replace")


def pieces(texts: pa.Array) -> Iterator[tuple[int, int, Words]]:
    """(first row, end row, words) of stretches of rows of about ``PIECE`` bytes."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    if not len(texts):
        return
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    row = 0
    while row < len(texts):
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + PIECE, "right")) - 1)
        yield row, end, Words(data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row])
        row = end


def _marked(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    place = hashes & np.uint64(len(bits) * 64 - 1)
    return (bits[place >> np.uint64(6)] >> (place & np.uint64(63))) & np.uint64(1) == 1


def bit_table(hashes: DataFrame, column: str, size: int = BITS) -> np.ndarray:
    """The bits of all hashes, ``size`` / 64 words at most, put together by Spark."""
    place = F.col(column).bitwiseAND(F.lit(size - 1))
    marks = hashes.select(F.shiftright(place, 6).cast("int").alias("word"), F.expr(f"shiftleft(1L, cast({column} & 63 as int))").alias("mark"))
    rows = marks.groupBy("word").agg(F.expr("bit_or(mark)").alias("mark")).toPandas()
    out = np.zeros(size // 64, np.int64)
    out[rows["word"].to_numpy(np.int64)] = rows["mark"].to_numpy(np.int64)
    return out.view(np.uint64)


def windows(items: DataFrame, item_id: Column, window: int = WINDOW, shingle: int = SHINGLE) -> DataFrame:
    """(item, window, n, shingles): every window of every item, its words joined by blanks, its shingles in order."""
    kind = pa.schema([("item", pa.string()), ("window", pa.string()), ("n", pa.int32()), ("shingles", pa.list_(pa.int64()))])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.column("item").to_pylist()
            for row, end, words in pieces(batch.column("text")):
                for k in range(row, end):
                    first, last = int(words.first[k - row]), int(words.first[k - row + 1])
                    n = min(window, last - first)
                    if not n:
                        continue
                    at, hashes = words.shingles(min(shingle, n))
                    own = hashes[np.searchsorted(at, first) :][: last - first - min(shingle, n) + 1].view(np.int64)
                    for lo in range(0, last - first - n + 1, 4096):
                        some = range(lo, min(lo + 4096, last - first - n + 1))
                        cells = [[names[k]] * len(some), [words.text(first + i, first + i + n) for i in some], [n] * len(some), [own[i : i + n - min(shingle, n) + 1] for i in some]]
                        yield pa.record_batch([pa.array(c, f.type) for c, f in zip(cells, kind)], schema=kind)

    rows = items.select(F.coalesce(item_id.cast("string"), F.lit("")).alias("item"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(cut, "item string, window string, n int, shingles array<long>")


def _counts(docs: DataFrame, bits: np.ndarray, sizes: list[int]) -> DataFrame:
    """(hash, n): in how many documents each marked shingle stands."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, words in pieces(batch.column(0)):
                for size in sizes:
                    at, hashes = words.shingles(size)
                    keep = _marked(bits, hashes)
                    pairs = np.unique(np.stack([hashes[keep], words.row[at[keep]].astype(np.uint64)], 1), axis=0)
                    found, n = np.unique(pairs[:, 0], return_counts=True)
                    yield pa.record_batch([pa.array(found.view(np.int64)), pa.array(n.astype(np.int64))], ["hash", "n"])

    return docs.select("text").mapInArrow(count, "hash long, n long").groupBy("hash").agg(F.sum("n").alias("n"))


def _look(docs: DataFrame, bits: np.ndarray, sizes: list[int], window: int) -> DataFrame:
    """(row, kept, n_words, found): for each marked shingle of a document the words that a window around it can hold."""
    found = pa.list_(pa.struct([("hash", pa.int64()), ("at", pa.int32()), ("lead", pa.int32()), ("words", pa.string())]))

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, end, words in pieces(batch.column("text")):
                out: list[list] = [[] for _ in range(end - row)]
                for size in sizes:
                    at, hashes = words.shingles(size)
                    keep = _marked(bits, hashes)
                    for i, h in zip(at[keep].tolist(), hashes[keep].view(np.int64).tolist()):
                        k = words.row[i]
                        first, last = int(words.first[k]), int(words.first[k + 1])
                        lo = max(first, i - window + size)
                        out[k].append({"hash": h, "at": i - first, "lead": i - lo, "words": words.text(lo, min(last, i + window))})
                part = batch.slice(row, end - row)
                n = np.diff(words.first).astype(np.int64)
                yield pa.record_batch([part.column("row"), part.column("kept"), pa.array(n), pa.array(out, found)], ["row", "kept", "n_words", "found"])

    kinds = T.StructType([docs.schema["row"], docs.schema["kept"], T.StructField("n_words", T.LongType())])
    kinds.add("found", T._parse_datatype_string("array<struct<hash:long,at:int,lead:int,words:string>>"))
    return docs.mapInArrow(look, kinds)


def prefixes(cut: DataFrame, docs: DataFrame, sizes: list[int]) -> DataFrame:
    """(window, size, hash, offset): the rarest shingle of each window, by documents, then hash; windows with a shingle that no document has are gone."""
    once = cut.groupBy("window").agg(F.min("n").alias("size"), F.first("shingles").alias("shingles"))
    placed = once.select("window", "size", F.posexplode("shingles").alias("offset", "hash"))
    seen = _counts(docs, bit_table(placed, "hash"), sizes).withColumnRenamed("n", "seen")
    rank = F.struct(F.coalesce("seen", F.lit(0)).alias("seen"), "hash", "offset")
    rarest = placed.join(seen, "hash", "left").groupBy("window", "size").agg(F.min(rank).alias("token"))
    return rarest.where("token.seen > 0").select("window", "size", "token.hash", "token.offset")


def find(docs: DataFrame, items: DataFrame, carry: list[str], item_id: str = "item_id", window: int = WINDOW, shingle: int = SHINGLE) -> DataFrame:
    """Per document: ``kept`` (struct of the ``carry`` columns), n_words, n_hit, spans (stretches of hit words, ends exclusive, apart), items (sorted ids)."""
    held = docs.select(F.struct(*[F.col(f"`{c}`") for c in carry]).alias("kept"), F.col("text").cast("string").alias("text"))
    cut = stage(windows(items, F.col(f"`{item_id}`"), window, shingle), "windows")
    sizes = sorted(r[0] for r in cut.select(F.least("n", F.lit(shingle))).distinct().collect())
    prefix = stage(prefixes(cut, held.select("text"), sizes), "prefix")
    # Row numbers are drawn once: what is used below is read from the written table.
    seen = stage(_look(held.select(F.monotonically_increasing_id().alias("row"), "kept", "text"), bit_table(prefix, "hash"), sizes, window), "found")

    near = seen.select("row", F.explode("found").alias("f")).select("row", "f.*")
    start, skip = F.col("at") - F.col("offset"), F.col("lead") - F.col("offset")
    around = F.split("words", " ")
    bounded = (skip >= 0) & (skip + F.col("size") <= F.size(around))
    # The filters are evaluated together, so the slice has to stand at any bounds.
    exact = F.array_join(F.slice(around, F.greatest(skip + 1, F.lit(1)), F.col("size")), " ") == F.col("window")
    hits = near.join(prefix, "hash").where(bounded & exact)
    hits = stage(hits.select("row", start.alias("start"), (start + F.col("size")).alias("end"), "window").distinct(), "hits")

    named = hits.select("row", "window").distinct().join(cut.select("window", "item").distinct(), "window")
    named = named.select("row", "item").distinct().groupBy("row").agg(F.sort_array(F.collect_list("item")).alias("items"))
    order = Window.partitionBy("row").orderBy("start", "end")
    reach = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    islands = hits.select("row", "start", "end").distinct().withColumn("fresh", F.coalesce(F.col("start") > reach, F.lit(True)).cast("int"))
    islands = islands.withColumn("island", F.sum("fresh").over(order)).groupBy("row", "island").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    covered = islands.groupBy("row").agg(F.sum(F.col("end") - F.col("start")).cast("long").alias("n_hit"), F.sort_array(F.collect_list(F.struct("start", "end"))).alias("spans"))

    whole = seen.select("row", "kept", "n_words").join(covered, "row", "left").join(named, "row", "left")
    return whole.select(
        "kept",
        "n_words",
        F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce("spans", F.array().cast(SPANS)).alias("spans"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
    )


#: What the query returns, from plain joins of all windows; for DuckDB.
SQL = f"""
WITH d AS (
    SELECT row_number() OVER () AS r, doc_id,
           regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
    FROM documents
), b AS (
    SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item,
           regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
    FROM benchmark
), cut AS (
    SELECT item, w, least(len(w), {WINDOW}) AS n, unnest(range(1, len(w) - least(len(w), {WINDOW}) + 2)) AS i FROM b WHERE len(w) > 0
), items AS (
    SELECT DISTINCT item, n, array_to_string(w[i:i + n - 1], ' ') AS win FROM cut
), places AS (
    SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM items) WHERE len(w) >= n
), stretches AS (
    SELECT r, n, i, array_to_string(w[i:i + n - 1], ' ') AS win FROM places
), hits AS (
    SELECT r, s.n, i, item FROM stretches s JOIN items USING (win)
), marked AS (
    SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT r, n, i FROM hits)) GROUP BY r
), named AS (
    SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT r, item FROM hits) GROUP BY r
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN marked USING (r) LEFT JOIN named USING (r)
"""

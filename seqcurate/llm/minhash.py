"""Near-duplicates by circulant MinHash.

Two permutations serve all signature coordinates: the first places a shingle on a circle of
``PLACES`` places, the second, shifted circularly by k places, ranks it for coordinate k. Shingles that
share a place raise the agreement of two signatures, they never lower it; links are exact. ``ROWS`` coordinates make a
band; items that agree in a band are candidates, and a candidate pair is linked if the Jaccard
similarity of the two full shingle sets reaches ``PERCENT``.

No bucket is expanded into pairs. Each bucket first holds its members against its smallest one, and
components of the links follow. In buckets that still hold several components, the items outside the
largest are held against all others on their full sets, chunk by chunk (``across``); what is skipped
lies inside one component already. Pairs of the first step whose sizes rule the similarity out, or
whose signatures agree in less than ``LIKELY`` of the coordinates (4.5 standard deviations below the
limit), are not verified.

With 24 bands of 4, two sets at exactly 0.75 meet in a bucket with probability 0.9999.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqcurate.llm import graph
from seqcurate.llm.common import join_lookup, stage, take_over
from seqcurate.llm.hashing import mix

WORDS = 5
PERCENT = 75
BANDS, ROWS = 24, 4
LIKELY = 0.55
#: Places of the circle; a power of two, the table takes four bytes a place.
PLACES = 1 << 20
#: Shingles in a chunk of a bucket that is compared item by item.
CHUNK = 200_000
#: Members verified against a leader in one group.
GROUP = 32
#: Characters of texts whose sets a task holds at a time, unless one group has more.
PIECE = 1 << 18
#: Pairs of a cell that are compared one by one.
FEW = 48
SHINGLE_WEIGHTS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD], np.uint64)


def distinct(hashes: np.ndarray) -> np.ndarray:
    """Sorted distinct values; by sorting, which beats a hash table on short arrays."""
    hashes = np.sort(hashes)
    return hashes[np.append(True, hashes[1:] != hashes[:-1])] if len(hashes) else hashes


def shingles(text: str | None) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's word shingles; of the whole sequence if it has fewer words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    if len(words) < WORDS:
        return mix(np.array([len(words)], np.uint64) + (hashes * SHINGLE_WEIGHTS[: len(words)]).sum(dtype=np.uint64))
    size = len(words) - WORDS + 1
    out = np.zeros(size, np.uint64)
    for k in range(WORDS):
        out += hashes[k : k + size] * SHINGLE_WEIGHTS[k]
    return distinct(mix(out))


def _permute(x: np.ndarray) -> np.ndarray:
    """A permutation of the 32-bit numbers, in place."""
    x ^= x >> np.uint32(16)
    x *= np.uint32(0x7FEB352D)
    x ^= x >> np.uint32(15)
    x *= np.uint32(0x846CA68B)
    x ^= x >> np.uint32(16)
    return x


@functools.cache
def _circle(coordinates: int) -> np.ndarray:
    """The second permutation: entry p holds the ranks of place p under each shift, a view of one table."""
    table = _permute(np.arange(1, PLACES + 1, dtype=np.uint32))
    return np.ndarray((PLACES,), f"V{4 * coordinates}", np.concatenate([table, table[: coordinates - 1]]), strides=(4,))


def forget() -> None:
    _circle.cache_clear()


def places(hashes: np.ndarray) -> np.ndarray:
    """The place of each shingle: the first permutation."""
    return _permute((hashes ^ (hashes >> np.uint64(32))).astype(np.uint32) * np.uint32(0x9E3779B1)) & np.uint32(PLACES - 1)


def ranks_at(places: np.ndarray, coordinates: int) -> np.ndarray:
    return _circle(coordinates)[places].view(np.uint32).reshape(-1, coordinates)


def ranks(hashes: np.ndarray, coordinates: int) -> np.ndarray:
    """Rank of each shingle for each coordinate: both permutations applied."""
    return ranks_at(places(hashes), coordinates)


def signature(hashes: np.ndarray, coordinates: int = BANDS * ROWS) -> np.ndarray:
    out = np.full(coordinates, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(hashes), 2048):
        np.minimum(out, ranks(hashes[at : at + 2048], coordinates).min(axis=0), out=out)
    return out


def bands(signatures: np.ndarray, rows: int) -> np.ndarray:
    """64-bit band values, one row an item."""
    parts = signatures.astype(np.uint64).reshape(len(signatures), -1, rows)
    out = np.arange(1, parts.shape[1] + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.zeros((len(signatures), 1), np.uint64)
    for k in range(rows):
        out = mix(out ^ parts[:, :, k]) * np.uint64(0x165667B19E3779F9)
    return out.view(np.int64)


def similar(a: np.ndarray, b: np.ndarray, percent: int = PERCENT) -> bool:
    shared = len(np.intersect1d(a, b, assume_unique=True))
    return bool(len(a) and len(b)) and 100 * shared >= percent * (len(a) + len(b) - shared)


def _estimated(pairs: DataFrame, items: DataFrame, least: float, sized: bool) -> DataFrame:
    """The (a, b) pairs that signatures and, if n is the set size, sizes leave possible."""

    @F.pandas_udf("boolean")
    def likely(left: pd.Series, right: pd.Series) -> pd.Series:
        if not len(left):
            return pd.Series([], dtype=bool)
        a, b = (np.frombuffer(b"".join(side), np.uint8).reshape(len(side), -1) for side in (left, right))
        return pd.Series((a == b).mean(axis=1) >= least)

    side = lambda name: items.select(F.col("id").alias(name), F.col("n").alias(f"n_{name}"), F.col("sig").alias(f"sig_{name}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    if sized:
        both = both.where(100 * F.least("n_a", "n_b") >= PERCENT * F.greatest("n_a", "n_b"))
    return both.where(likely("sig_a", "sig_b")).select("a", "b").distinct()


Sets = Callable[[list], list[np.ndarray]]
Group = dict[str, np.ndarray]


def each_group(rows: DataFrame, keys: list[str], sets: Sets, work: Callable[[Group, list[np.ndarray]], list[tuple[int, int]]]) -> DataFrame:
    """(u, v) that ``work`` returns for the rows of each value of the integer keys and the sets of their texts.

    As a grouped pandas function, but for many small groups: a task passes over its sorted rows
    once and holds one batch and one unfinished group. Equal texts of neighbouring groups share one set.
    """

    def links(batch: pd.DataFrame, cuts: list[int]) -> list[tuple[int, int]]:
        columns = {c: batch[c].to_numpy() for c in batch.columns}
        sizes = np.concatenate(([0], np.cumsum([len(t or "") for t in columns["text"][: cuts[-1]]])))[cuts]
        found: list[tuple[int, int]] = []
        first = 0
        while first < len(cuts) - 1:
            last = max(first + 1, int(np.searchsorted(sizes, sizes[first] + PIECE, "right")) - 1)
            texts = list(dict.fromkeys(columns["text"][cuts[first] : cuts[last]]))
            known = dict(zip(texts, sets(texts), strict=True))
            for k in range(first, last):
                group = {c: v[cuts[k] : cuts[k + 1]] for c, v in columns.items()}
                found += work(group, [known[t] for t in group["text"]])
            first = last
        return found

    def stream(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        take_over("minhash", forget)
        left = None
        for batch in batches:
            if left is not None:
                batch = pd.concat([left, batch], ignore_index=True)
            if not len(batch):
                continue
            key = batch[keys].to_numpy()
            cuts = [0, *(np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1)]
            found = links(batch, cuts)
            left = batch.iloc[cuts[-1] :]
            if found:
                yield pd.DataFrame(found, columns=["u", "v"], dtype="int64")
        if left is not None and len(left):
            yield pd.DataFrame(links(left, [0, len(left)]), columns=["u", "v"], dtype="int64")

    return rows.repartition(*keys).sortWithinPartitions(*keys).mapInPandas(stream, "u long, v long").distinct()


def verify(pairs: DataFrame, texts: DataFrame, sets: Sets) -> DataFrame:
    """The (a, b) pairs whose full sets are similar. Rows of one id are alternatives.

    Each text goes once to each group of at most about ``GROUP`` partners of a leading item.
    """
    sizes = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / GROUP).alias("groups"))
    placed = pairs.join(sizes, "a").withColumn("group", F.pmod(F.xxhash64("b"), F.col("groups")))
    members = placed.select("a", "group", F.col("b").alias("id"))
    leaders = placed.select("a", "group", F.col("a").alias("id")).distinct()
    rows = members.unionByName(leaders).join(texts, "id")

    def work(group: Group, own: list[np.ndarray]) -> list[tuple[int, int]]:
        lead, ids = group["a"][0], group["id"]
        leading = [s for i, s in zip(ids, own, strict=True) if i == lead]
        return [(lead, i) for i, s in zip(ids, own, strict=True) if i != lead and any(similar(o, s) for o in leading)]

    return each_group(rows, ["a", "group"], sets, work)


def across(buckets: DataFrame, items: DataFrame, roots: DataFrame, texts: DataFrame, sets: Sets) -> DataFrame:
    """Links (u, v) between the roots of different components that share a bucket.

    In a bucket with several components the items outside its largest one are compared with all its
    items on their full sets. Both sides are cut into chunks of about ``CHUNK`` shingles, so a cell
    of two chunks is bounded; a cell returns a spanning forest of the components that it links, fewer links than rows.
    """
    placed = join_lookup(buckets, roots.select(F.col("node").alias("id"), "root"), "id", "left")
    placed = stage(placed.select("band", "id", F.coalesce("root", "id").alias("root")), "minhash-placed")
    # Two items that are not linked were looked at as member and leader: ruled out by their signatures or on their sets.
    several = placed.groupBy("band").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count(F.lit(1)).alias("size"))
    several = several.where((F.col("low") < F.col("high")) & (F.col("size") > 2)).select("band")
    placed = join_lookup(placed, several, "band").join(items.groupBy("id").agg(F.sum("n").alias("n")), "id")
    placed = stage(placed, "minhash-placed")
    marks = [F.bit_xor(F.xxhash64("id", F.lit(k))).alias(f"mark_{k}") for k in (0, 1)]
    parts = placed.groupBy("band", "root").agg(F.count(F.lit(1)).alias("size"), F.sum("n").alias("n"), *marks)
    state = parts.groupBy("band").agg(
        F.max_by("root", F.struct("size", "root")).alias("main"),
        F.sum("size").alias("size"),
        F.ceil(F.sum("n") / CHUNK).cast("int").alias("chunks"),
        *[F.bit_xor(f"mark_{k}").alias(f"mark_{k}") for k in (0, 1)],
    )
    # Bands with the same members, told by 128 bits and their number, are one bucket.
    state = state.groupBy("mark_0", "mark_1", "size", "main", "chunks").agg(F.min("band").alias("band")).select("band", "main", "chunks")
    members = stage(placed.join(state, "band"), "minhash-open")
    own = F.pmod(F.xxhash64("id"), F.col("chunks")).cast("int")
    every = F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))
    probes = members.where(F.col("root") != F.col("main"))
    asked = probes.select("band", own.alias("i"), every.alias("j"), "id", "root", F.lit(True).alias("probe"))
    # Chunks of probes that hold none need no cell.
    used = probes.select("band", own.alias("i")).distinct()
    held = members.select("band", own.alias("j"), "id", "root").join(used, "band").select("band", "i", "j", "id", "root", F.lit(False).alias("probe"))
    cells = asked.unionByName(held).join(texts, "id")

    def work(cell: Group, own: list[np.ndarray]) -> list[tuple[int, int]]:
        probe, root = cell["probe"].astype(bool), cell["root"]
        rows, where = np.flatnonzero(probe), np.flatnonzero(~probe)
        found: list[tuple[int, int]] = []
        if len(rows) and len(where):
            size = np.array([len(x) for x in own])
            low, high = np.minimum.outer(size[rows], size[where]), np.maximum.outer(size[rows], size[where])
            hit = (100 * low >= PERCENT * high) & (low > 0) & (root[rows][:, None] != root[where])
            asked = np.argwhere(hit)
            if len(asked) <= FEW:
                for r, w in asked:
                    hit[r, w] = similar(own[rows[r]], own[where[w]])
            else:
                hit &= 100 * (shared := _shared(own, rows, where)) >= PERCENT * (size[rows][:, None] + size[where] - shared)
            names, of = np.unique(root, return_inverse=True)
            joined = np.arange(len(names))
            for k in np.flatnonzero(hit.any(axis=1)):
                r, near = rows[k], where[hit[k]]
                labels, first = np.unique(joined[of[near]], return_index=True)
                new = labels != joined[of[r]]
                if new.any():
                    found += [(root[r], root[near[f]]) for f in first[new]]
                    joined[np.isin(joined, labels[new])] = joined[of[r]]
        return found

    return each_group(cells, ["band", "i", "j"], sets, work)


def _shared(own: list[np.ndarray], rows: np.ndarray, where: np.ndarray) -> np.ndarray:
    """Sizes of the intersections; a set that is there several times, as probe and as member, is laid out once."""
    once = {id(x): x for x in own}
    place = {key: k for k, key in enumerate(once)}
    at_row = np.array([place[id(x)] for x in own])
    values, at = np.unique(np.concatenate(list(once.values())), return_inverse=True)
    of = np.repeat(np.arange(len(once)), [len(x) for x in once.values()])
    shared = np.zeros((len(rows), len(where)))
    for low in range(0, len(values), 4096):
        part = (at >= low) & (at < low + 4096)
        block = np.zeros((len(once), min(4096, len(values) - low)), np.float32)
        block[of[part], at[part] - low] = 1
        shared += block[at_row[rows]] @ block[at_row[where]].T
    return shared


def link(
    items: DataFrame,
    texts_of: Callable[[DataFrame], DataFrame],
    sets: Sets,
    given: DataFrame | None = None,
    least: float = LIKELY,
    sized: bool = True,
) -> DataFrame:
    """(node, root) of all linked items.

    items: id long, n, bands, sig, repeated rows allowed; texts_of gives (id, text) of an (id) table, asked once for all items that share a bucket;
    sets: of a list of texts; given: links (u, v) known before; least: agreement of signatures below which a pair is not verified; sized: n is the size of the set, not only near it.
    """
    banded = items.select("id", F.explode("bands").alias("band"))
    shared = banded.groupBy("band").agg(F.min("id").alias("lead"), F.max("id").alias("last")).where(F.col("lead") < F.col("last"))
    buckets = stage(join_lookup(banded, shared.select("band", "lead"), "band").distinct(), "minhash-buckets")
    ids = buckets.select("id").distinct()
    items = join_lookup(items, ids, "id").select("id", "n", "sig").distinct()
    items = stage(items, "minhash-items")
    texts = stage(texts_of(ids), "minhash-texts")
    pairs = buckets.where(F.col("id") != F.col("lead")).select(F.col("lead").alias("a"), F.col("id").alias("b")).distinct()
    tried = stage(_estimated(pairs, items, least, sized), "minhash-pairs")
    links = stage(verify(tried, texts, sets), "minhash-links")
    if given is not None:
        links = links.unionByName(given)
    roots = stage(graph.components(links), "minhash-roots")
    more = stage(across(buckets.select("band", "id"), items, roots, texts, sets), "minhash-links")
    # These links run between roots: the components of the few roots are the components of all.
    top = stage(graph.components(more), "minhash-roots")
    above = top.select(F.col("node").alias("root"), F.col("root").alias("top"))
    merged = join_lookup(roots, above, "root", "left").select("node", F.coalesce("top", "root").alias("root"))
    return stage(merged.unionByName(top.select("node", "root")).distinct(), "minhash-roots")


def shingle_sets(texts: list) -> list[np.ndarray]:
    return [shingles(t) for t in texts]


def signatures(docs: DataFrame) -> DataFrame:
    """(doc_id, n, digest, bands, sig) of each document; no bands for an empty set."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        take_over("minhash", forget)
        for batch in batches:
            sets = [shingles(t) for t in batch["text"]]
            sigs = np.stack([signature(s) for s in sets]) if sets else np.zeros((0, BANDS * ROWS), np.uint32)
            values = bands(sigs, ROWS)
            yield pd.DataFrame(
                {
                    "doc_id": batch["doc_id"],
                    "n": [len(s) for s in sets],
                    "digest": [hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets],
                    "bands": [v if len(s) else v[:0] for v, s in zip(values, sets, strict=True)],
                    "sig": [x.astype(np.uint8).tobytes() for x in sigs],
                }
            )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInPandas(work, "doc_id long, n long, digest binary, bands array<long>, sig binary")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of each document.

    Defined cases: a null or empty text has an empty set and is linked with nothing; a row without an
    id is linked with nothing, has no component and is kept; rows of one id are one node, linked if any of its
    texts is, and each gets its row; other columns are not looked at. Integer ids only.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    signed = stage(signatures(texts), "minhash-signatures")
    usable = signed.where((F.col("n") > 0) & F.col("doc_id").isNotNull())
    # One item a set: its smallest document stands for all exact copies.
    best = stage(usable.groupBy("digest").agg(F.min(F.struct("doc_id", "n", "bands", "sig")).alias("s")), "minhash-items")
    items = best.select(F.col("s.doc_id").alias("id"), "s.n", "s.bands", "s.sig")
    copies = usable.select("doc_id", "digest").join(best.select("digest", F.col("s.doc_id").alias("first")), "digest")
    copies = stage(copies.where(F.col("doc_id") != F.col("first")).select(F.col("doc_id").alias("u"), F.col("first").alias("v")), "minhash-copies")

    def texts_of(ids: DataFrame) -> DataFrame:
        return join_lookup(texts.withColumnRenamed("doc_id", "id"), ids, "id")

    roots = link(items, texts_of, shingle_sets, copies)
    found = signed.select("doc_id", F.col("n").alias("n_shingles")).join(roots.select(F.col("node").alias("doc_id"), "root"), "doc_id", "left")
    component = F.coalesce("root", "doc_id")
    return found.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))

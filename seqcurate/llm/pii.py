"""Personal data: patterns, and terms that give protected entities away.

Addresses, IP numbers, cards and telephone numbers are found by pattern. Around each, within
``REACH`` words on either side, the corpus is asked which terms reveal it: with p(e) the share of
windows of that width that hold entity e, and p(e|t) the share of the occurrences of term t that
stand near e, term t discloses log(p(e|t)/p(e)) of the -log p(e) bits (information content) of e.
A term that discloses ``DISCLOSED`` of them or more, in at least ``SUPPORT`` different contexts, is
a span of its own wherever it stands; in the rewritten text it is generalised to its kind (name,
number) or removed. Contexts that are equal word for word count once, so copies are no evidence.
Counts are taken over all documents.

Terms are words of ``TERM_LETTERS`` characters or more, lower-cased; they are told apart by a 64-bit
hash. The tasks get them in slices of at most ``SLICE`` hashes, one pass a slice, so what is broadcast is
bounded and no term is left out.

Defined cases: a null text counts as empty; an empty text has no span; spans of different base kinds
may overlap, term spans never overlap a base span; repeated rows are treated alike.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqcurate.llm.common import stage
from seqcurate.llm.hashing import code_points, mix, span_hashes

BASE = ("email", "ip", "card", "phone")
TERM = "term"
#: Fixed patterns of the base kinds.
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DIGIT = re.compile(r"[0-9]")
WORD = re.compile(r"[^\W_]+")
REACH = 8
SUPPORT = 3
DISCLOSED = 0.9
TERM_LETTERS = 4
SLICE = 2_000_000


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if k % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost addresses: from each @ the local part reaches back to the last match at most."""
    out, end, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in LOCAL:
            start -= 1
        domain = DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            end = domain.end()
            out.append((start, end))
        at = text.find("@", max(end, at + 1))
    return out


def base_spans(text: str) -> dict[str, list[tuple[int, int]]]:
    found: dict[str, list[tuple[int, int]]] = {kind: [] for kind in BASE}
    if "@" in text:
        found["email"] = emails(text)
    if DIGIT.search(text):
        for m in IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m[0].split(".")):
                found["ip"].append(m.span())
        for m in CARD.finditer(text):
            digits = "".join(DIGIT.findall(m[0]))
            if 16 <= len(digits) <= 19 and luhn(digits):
                found["card"].append(m.span())
        for m in PHONE.finditer(text):
            if 8 <= len(DIGIT.findall(m[0])) <= 15:
                found["phone"].append(m.span())
    return found


def _hash(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def terms(text: str, taken: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and hashes of the terms outside the given spans."""
    spans = np.array([m.span() for m in WORD.finditer(text) if m.end() - m.start() >= TERM_LETTERS], np.int64).reshape(-1, 2)
    if not len(spans):
        return spans[:, 0], spans[:, 1], np.zeros(0, np.int64)
    if taken:
        marks = np.zeros(len(text) + 1, np.int32)
        for start, end in taken:
            marks[start] += 1
            marks[end] -= 1
        inside = np.concatenate(([0], np.cumsum(np.cumsum(marks)[:-1] > 0)))
        spans = spans[inside[spans[:, 1]] == inside[spans[:, 0]]]
    lower = text.lower()
    if len(lower) == len(text):
        hashes = span_hashes(code_points(lower), spans[:, 0], spans[:, 1])
    else:  # a few letters grow when lower-cased
        hashes = np.concatenate([span_hashes(code_points(w), np.array([0]), np.array([len(w)])) for w in (text[a:b].lower() for a, b in spans)] or [np.zeros(0, np.uint64)])
    return spans[:, 0], spans[:, 1], hashes.view(np.int64)


def contexts(docs: DataFrame) -> DataFrame:
    """(entity, context, term): each different term within reach of each entity."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out: list[tuple[np.ndarray, ...]] = []
            for text in batch["text"]:
                if not text or not ("@" in text or DIGIT.search(text)):
                    continue
                found = base_spans(text)
                taken = [s for kind in BASE for s in found[kind]]
                if not taken:
                    continue
                starts, _, hashes = terms(text, taken)
                for kind in BASE:
                    for start, end in found[kind]:
                        entity = _hash(kind + ":" + text[start:end].lower())
                        at = int(np.searchsorted(starts, start))
                        near = hashes[max(0, at - REACH) : at + REACH]
                        context = int(mix(np.bitwise_xor.reduce(mix(near.view(np.uint64) + np.arange(len(near), dtype=np.uint64)), keepdims=True))[0].astype(np.int64)) if len(near) else 0
                        own = np.unique(near)
                        out.append((np.full(len(own), entity), np.full(len(own), context), own))
            if out:
                columns = [np.concatenate(c) for c in zip(*out, strict=True)]
                yield pd.DataFrame(dict(zip(("entity", "context", "term"), columns, strict=True)))

    return docs.select("text").mapInPandas(work, "entity long, context long, term long")


def _slices(spark, table: DataFrame) -> list:
    """The terms of a table as broadcasts of at most about SLICE sorted hashes each."""
    n = table.count()
    parts = -(-n // SLICE)
    out = []
    for k in range(parts):
        part = table.where(F.pmod(F.xxhash64("term"), F.lit(parts)) == k) if parts > 1 else table
        out.append(spark.sparkContext.broadcast(np.sort(part.toPandas()["term"].to_numpy(np.int64))))
    return out


def occurrences(docs: DataFrame, slices: list) -> DataFrame:
    """(term, n): occurrences of the given terms in all documents; the row of term null counts all words."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = np.sort(np.concatenate([s.value for s in slices] or [np.zeros(0, np.int64)]))
        total, counts = 0, np.zeros(len(known), np.int64)
        for batch in batches:
            for text in batch["text"]:
                _, _, hashes = terms(text or "", [])
                total += len(hashes)
                if len(known):
                    at = np.searchsorted(known, hashes).clip(max=len(known) - 1)
                    np.add.at(counts, at[known[at] == hashes], 1)
        seen = np.flatnonzero(counts)
        yield pd.DataFrame({"term": pd.array([None, *known[seen]], dtype="Int64"), "n": [total, *counts[seen]]})

    return docs.select("text").mapInPandas(work, "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))


def disclosing(docs: DataFrame) -> DataFrame:
    """(term): the terms that give some entity away."""
    found = stage(contexts(docs).groupBy("entity", "context", "term").agg(F.count(F.lit(1)).alias("n")), "pii-contexts")
    pairs = found.groupBy("entity", "term").agg(F.count(F.lit(1)).alias("contexts"), F.sum("n").alias("together"))
    pairs = stage(pairs.where(F.col("contexts") >= SUPPORT), "pii-pairs")
    if pairs.isEmpty():
        return pairs.select("term")
    # Occurrences near an entity: a window counts once for all its terms.
    by_entity = found.groupBy("entity", "context").agg(F.max("n").alias("n")).groupBy("entity").agg(F.sum("n").alias("of_entity"))
    counted = None
    for piece in _slices(docs.sparkSession, pairs.select("term").distinct()):
        part = occurrences(docs, [piece])
        counted = part if counted is None else counted.unionByName(part)
    counted = stage(counted.distinct(), "pii-terms")
    total = counted.where(F.col("term").isNull()).agg(F.max("n")).first()[0] or 1
    rated = pairs.join(counted.where(F.col("term").isNotNull()), "term").join(by_entity, "entity")
    p_entity = F.least(F.lit(1.0), F.col("of_entity") * (2 * REACH) / F.lit(float(total)))
    p_given = F.least(F.lit(1.0), F.col("together") / F.col("n"))
    return rated.where(F.log(p_given / p_entity) >= DISCLOSED * -F.log(p_entity)).select("term").distinct()


def find(docs: DataFrame, keep: list[str], rewrite: bool = False) -> DataFrame:
    """Counts, digest of the base spans, all spans and, if asked for, the sanitised text of each document."""
    slices = _slices(docs.sparkSession, stage(disclosing(docs.select("text")), "pii-disclosing"))
    schema = "n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string" + ", sanitised string" * rewrite

    @F.pandas_udf(schema)
    def found(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        known = [s.value for s in slices]
        for batch in texts:
            rows = []
            for text in batch:
                text = text or ""
                base = base_spans(text)
                own: list[tuple[int, int]] = []
                if known:
                    starts, ends, hashes = terms(text, [s for kind in BASE for s in base[kind]])
                    hit = np.zeros(len(hashes), np.bool_)
                    for part in known:
                        hit |= part[np.searchsorted(part, hashes).clip(max=len(part) - 1)] == hashes
                    own = list(zip(starts[hit].tolist(), ends[hit].tolist(), strict=True))
                listed = [f"{kind}:{a}:{b}" for kind in BASE for a, b in base[kind]]
                row = [*(len(base[kind]) for kind in BASE), hashlib.sha256(",".join(listed).encode()).hexdigest()]
                row.append(",".join(listed + [f"{TERM}:{a}:{b}" for a, b in own]))
                if rewrite:
                    row.append(sanitise(text, base, own))
                rows.append(row)
            yield pd.DataFrame(rows, columns=[c.strip().split()[0] for c in schema.split(",")])

    named = docs.select(*[F.col(f"`{c}`") for c in keep], found(F.col("text")).alias("_found"))
    return named.select(*[f"`{c}`" for c in keep], "_found.*")


def sanitise(text: str, base: dict[str, list[tuple[int, int]]], own: list[tuple[int, int]]) -> str:
    """Base spans as their kind; terms as the kind of thing they are, or gone."""
    spans = sorted([(a, b, kind) for kind in BASE for a, b in base[kind]] + [(a, b, TERM) for a, b in own])
    out, at = [], 0
    for start, end, kind in spans:
        if end <= at:
            continue
        out.append(text[at : max(at, start)])
        word = text[start:end]
        out.append(f"[{kind}]" if kind != TERM else "[number]" if word.isdigit() else "[name]" if word[:1].isupper() else "")
        at = end
    return "".join(out) + text[at:]

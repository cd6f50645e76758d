"""Conversation structure repair by weighted CYK parsing.

A conversation's rows are a string of tokens: role initial and first fault. The wanted order of roles is
``(s?(ua)+)?``. The repair grammar is in Chomsky normal form: a nonterminal X[p,q] derives the spans
that lead from place p of that pattern to place q, its binary rules are X[p,q] -> X[p,r] X[r,q], its lexical
rules are the edits of one row (Keep, Rerole, Delete) and, on empty spans, Insert. A cell holds the
minimum (cost, audit) of one span and nonterminal; cells of single rows are closed under insertion on both sides, and
longer spans are combined bottom-up by span length, over all splits.

The minimum of concatenations is the concatenation of minima: two audits of one cell and cost have as many rows, so
one is never the beginning of the other. As X[p,q] has all that a neighbour can see of a span, complete
charts are needed only within ``BLOCK`` rows; spans of blocks are joined by the same rules, pairs of equal
length first. So a conversation of any length is parsed in pieces: rows are dealt by ranges of
(conversation, turn), each task parses the stretches that it holds, and one row a stretch goes on. Only the digest of
a repaired conversation, one SHA-256 over all its rows in order, passes one task, as a stream.

Costs: Keep 0, Rerole 2, Delete 3, Insert 2, and 1 for a truncated row that stays; blank rows and repeats of
an earlier row of the conversation have to go.

Defined cases: a null role or text counts as one blank; rows without a turn come first; rows of one turn
are ordered by role, then by SHA-256 of the text; rows without a conversation are one conversation; a role is told
by its first character, other initials than s, u, a fit nowhere and are reroled or deleted; conversations left
without rows have zeros, an empty audit and the digest of the empty string; other columns are ignored. The audit is
one character an edit and, like the result row that holds it, has to fit in a task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqcurate.llm.common import stage

KEEP, REROLE, DELETE, INSERT = "K", "R", "D", "I"
COST = {KEEP: 0, REROLE: 2, DELETE: 3, INSERT: 2}
TRUNCATED = 1
#: Places of the pattern: at the start, after s, after u, after a; where each role leads.
PLACES = range(4)
STEPS = {"s": {0: 1}, "u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}}
FINAL = (0, 3)
#: Pairs of places that some string connects (no string has more than three places to pass), and the binary rules X[p,q] -> X[p,r] X[r,q].
_ONCE = {(p, p) for p in PLACES} | {step for steps in STEPS.values() for step in steps.items()}
_TWICE = {(p, q) for p, r in _ONCE for r2, q in _ONCE if r == r2}
REACH = sorted({(p, q) for p, r in _TWICE for r2, q in _TWICE if r == r2})
INDEX = {pair: k for k, pair in enumerate(REACH)}
RULES = [(INDEX[p, q], INDEX[p, r], INDEX[r, q]) for p, q in REACH for r in PLACES if (p, r) in INDEX and (r, q) in INDEX]
#: Rows whose chart is complete.
BLOCK = 16
BLANKS = " \t\n\x0b\x0c\r"
LEGAL = ("su", "ua", "au")

Cell = tuple  # for each pair of REACH: (cost, audit), or None where nothing derives the span


def join(left: Cell, right: Cell, best: list | None = None) -> list:
    """The cell of two neighbouring spans, by the binary rules; ``best`` has what other splits gave."""
    out = best or [None] * len(REACH)
    for pq, pr, rq in RULES:
        a, b = left[pr], right[rq]
        if a is not None and b is not None:
            cost, old = a[0] + b[0], out[pq]
            if old is None or cost < old[0] or cost == old[0] and a[1] + b[1] < old[1]:
                out[pq] = (cost, a[1] + b[1])
    return out


def _edits(edit: str, roles: str, more: int = 0) -> list:
    out = [None] * len(REACH)
    for role in roles:
        for p, q in STEPS[role].items():
            out[INDEX[p, q]] = (COST[edit] + more, edit)
    return out


def _least(*cells: list) -> list:
    return [min((c for c in choice if c is not None), default=None) for choice in zip(*cells)]


def _nothing() -> list:
    """The empty span: inserted rows only; nothing inserted leads from a place to itself."""
    out = _least(_edits(INSERT, "ua"), [(0, "") if p == q else None for p, q in REACH])
    while (more := _least(out, join(out, out))) != out:
        out = more
    return out


NOTHING = _nothing()


def lexical(token: str) -> Cell:
    """One row: b and d have to go, an upper-case initial is truncated."""
    out = [(COST[DELETE], DELETE) if p == q else None for p, q in REACH]
    if token not in "bd":
        more = TRUNCATED if token.isupper() else 0
        out = _least(out, _edits(REROLE, "ua", more))
        if token.lower() in STEPS:
            out = _least(out, _edits(KEEP, token.lower(), more))
    return tuple(join(join(NOTHING, out), NOTHING))


LEXICAL = {t: lexical(t) for t in "bdsuaxSUAX"}


@lru_cache(1 << 14)
def chart(tokens: str) -> Cell:
    """The cell of a whole block: all spans by length, each over all its splits."""
    n = len(tokens)
    cells = {(i, i + 1): LEXICAL[t] for i, t in enumerate(tokens)}
    for length in range(2, n + 1):
        for i in range(n - length + 1):
            best = None
            for k in range(i + 1, i + length):
                best = join(cells[i, k], cells[k, i + length], best)
            cells[i, i + length] = best
    return tuple(cells[0, n])


class Spans:
    """Neighbouring spans joined bottom-up: two of one height become one of the next."""

    def __init__(self):
        self.open: list[tuple[int, Cell]] = []

    def add(self, cell: Cell) -> None:
        height = 0
        while self.open and self.open[-1][0] == height:
            cell, height = join(self.open.pop()[1], cell), height + 1
        self.open.append((height, cell))

    def whole(self) -> Cell:
        cell = self.open[-1][1] if self.open else NOTHING
        for _, left in reversed(self.open[:-1]):
            cell = join(left, cell)
        return cell


def parse(tokens: str) -> Cell:
    spans = Spans()
    for k in range(0, len(tokens), BLOCK):
        spans.add(chart(tokens[k : k + BLOCK]))
    return spans.whole()


def sentence(cell: Cell) -> tuple[int, str]:
    return min(c for c in (cell[INDEX[0, q]] for q in FINAL) if c is not None)


# Rows --------------------------------------------------------------------------------------------


def _key(conv: Column) -> Column:
    return F.when(conv.isNull(), "n").otherwise(F.concat(F.lit("v"), conv.cast("string")))


def damage(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text with the faults that crc32 of ``conv_id:turn`` calls for; nulls are written as one blank."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(text("conv_id"), F.lit(":"), text("turn")).cast("binary")) % 20
    hurt = rows.select("conv_id", "turn", text("role").alias("role"), text("text").alias("text"), kind.alias("kind")).where("kind != 0")
    content = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    twice = F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy")
    return hurt.select("conv_id", "turn", role.alias("role"), content.alias("text"), twice).drop("copy")


ORDER = ("known", "turn", "role", "digest", "row")


def faults(rows: DataFrame) -> DataFrame:
    """Written table of the rows with their order and what decides their token; ``seen`` tells equal rows of one conversation."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    keyed = rows.select(_key(F.col("conv_id")).alias("conv"), F.col("turn").cast("long").alias("turn"), text("role").alias("role"), text("text").alias("text"))
    shown = F.rtrim(F.col("text"), F.lit(BLANKS))
    initial = F.substring("role", 1, 1)
    return stage(
        keyed.select(
            "*",
            F.col("turn").isNotNull().alias("known"),
            F.sha2("text", 256).alias("digest"),
            F.monotonically_increasing_id().alias("row"),
            F.sha2(F.concat_ws(":", "conv", F.length("role").cast("string"), "role", "text"), 256).alias("seen"),
            F.when(initial.isin("s", "u", "a"), initial).otherwise("x").alias("initial"),
            (shown == "").alias("blank"),
            (~F.substring(shown, -1, 1).isin(".", "!", "?")).alias("open"),
        ),
        "rows",
    )


def tokens(held: DataFrame) -> DataFrame:
    """The rows without their texts, each with its token."""
    place = F.struct("known", "turn", "row")
    light = held.drop("text")
    firsts = light.groupBy("seen").agg(F.min(place).alias("first"))
    token = F.when(F.col("blank"), "b").when(place != F.col("first"), "d").when(F.col("open"), F.upper("initial")).otherwise(F.col("initial"))
    return light.join(firsts, "seen").select("conv", "known", F.coalesce("turn", F.lit(0)).alias("turn"), *ORDER[2:], "initial", token.alias("token"))


STRETCH = "conv string, known boolean, turn long, role string, digest string, row long, blank long, duplicate long, truncated long, illegal long, head string, tail string, low long, high long, turns long, costs array<long>, audits array<string>"


def _stretches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """One row for each run of rows of one conversation."""
    for rows in batches:
        conv = rows["conv"].to_numpy(object)
        borders = np.flatnonzero(np.concatenate(([True], conv[1:] != conv[:-1], [True])))
        token, initial = "".join(rows["token"]), "".join(rows["initial"])
        turn, known = rows["turn"].to_numpy(), rows["known"].to_numpy(bool)
        out = []
        for lo, hi in zip(borders[:-1].tolist(), borders[1:].tolist()):
            own, roles = token[lo:hi], initial[lo:hi]
            turns = turn[lo:hi][known[lo:hi]].tolist()
            cell = parse(own)
            head = rows.iloc[lo]
            out.append(
                (conv[lo], bool(head.known), int(head.turn), head.role, head.digest, int(head.row))
                + (own.count("b"), own.count("d"), sum(t.isupper() for t in own), sum(a + b not in LEGAL for a, b in zip(roles, roles[1:])), roles[0], roles[-1])
                + (turns[0] if turns else 0, turns[-1] if turns else 0, len(set(turns)))
                + ([-1 if c is None else c[0] for c in cell], ["" if c is None else c[1] for c in cell])
            )
        yield pd.DataFrame(out, columns=[c.split()[0] for c in STRETCH.split(", ")])


FOUND = "conv string, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"


def _conversations(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Stretches of a conversation, in order, to its result."""
    conv, spans, sums, tail, span = None, Spans(), [0] * 4, "", [None, None, 0]

    def done():
        cost, audit = sentence(spans.whole())
        gaps = span[1] - span[0] + 1 - span[2] if span[2] else 0
        return (conv, gaps, *sums, cost, audit)

    names = [c.split()[0] for c in FOUND.split(", ")]
    for rows in batches:
        out = []
        for r in rows.itertuples(index=False):
            if r.conv != conv:
                if conv is not None:
                    out.append(done())
                conv, spans, sums, tail, span = r.conv, Spans(), [0] * 4, "", [None, None, 0]
            sums = [a + int(b) for a, b in zip(sums, (r.blank, r.duplicate, r.truncated, r.illegal))]
            sums[3] += bool(tail) and tail + r.head not in LEGAL
            tail = r.tail
            if r.turns:
                low, high = int(r.low), int(r.high)
                span = [low if span[2] == 0 else span[0], high, span[2] + int(r.turns) - (span[1] == low)]
            spans.add(tuple((int(c), a) if c >= 0 else None for c, a in zip(r.costs, r.audits)))
        if out:
            yield pd.DataFrame(out, columns=names)
    if conv is not None:
        yield pd.DataFrame([done()], columns=names)


def audits(held: DataFrame) -> DataFrame:
    """Per conversation with rows: its faults, the cost and the audit."""
    dealt = tokens(held).repartitionByRange("conv", *ORDER).sortWithinPartitions("conv", *ORDER)
    stretches = stage(dealt.mapInPandas(_stretches, STRETCH), "stretches")
    return stage(stretches.repartition("conv").sortWithinPartitions("conv", *ORDER).mapInPandas(_conversations, FOUND), "audits")


def _repaired(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[str, str, str | None, str | None]]:
    """(conversation, edit, role, text) of every row that stays, in order; a conversation ends with an empty edit.

    A conversation comes as its audit, then its rows.
    """
    conv, audit, at, place = None, "", 0, 0
    for rows in batches:
        for r in rows.itertuples(index=False):
            if r.audit is not None:
                if conv is not None:
                    yield from _inserted(conv, audit, at, place)
                    yield conv, "", None, None
                conv, audit, at = r.conv, r.audit, 0
                size = len(audit) - audit.count(DELETE)
                place = -(size % 2)  # an odd length begins with s
                continue
            while audit[at] == INSERT:
                yield conv, INSERT, ("user", "assistant")[place % 2], ""
                at, place = at + 1, place + 1
            edit = audit[at]
            at += 1
            if edit != DELETE:
                yield conv, edit, r.role if edit == KEEP else ("user", "assistant")[place % 2], r.text
                place += 1
    if conv is not None:
        yield from _inserted(conv, audit, at, place)
        yield conv, "", None, None


def _inserted(conv: str, audit: str, at: int, place: int) -> Iterator[tuple]:
    for k in range(len(audit) - at):
        yield conv, INSERT, ("user", "assistant")[(place + k) % 2], ""


def _digests(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    digest, first, out = hashlib.sha256(), True, []
    for conv, edit, role, text in _repaired(batches):
        if edit:
            digest.update(f"{'' if first else chr(10)}{role}:{text}".encode("utf-8", "surrogatepass"))
            first = False
        else:
            out.append((conv, digest.hexdigest()))
            digest, first = hashlib.sha256(), True
            if len(out) == 4096:
                yield pd.DataFrame(out, columns=["conv", "sha"])
                out = []
    yield pd.DataFrame(out, columns=["conv", "sha"])


def _lines(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names, out, at = ["conv", "at", "role", "text", "edit"], [], 0
    for conv, edit, role, text in _repaired(batches):
        if edit:
            out.append((conv, at, role, text, edit))
        at = at + 1 if edit else 0
        if len(out) == 1024:
            yield pd.DataFrame(out, columns=names)
            out = []
    yield pd.DataFrame(out, columns=names)


def _streams(held: DataFrame, found: DataFrame) -> DataFrame:
    """Each conversation's audit, then its rows in order, within one partition."""
    texts = held.select("conv", F.lit(None).cast("string").alias("audit"), *ORDER, "text")
    heads = found.select("conv", "audit", *[F.lit(None).cast(texts.schema[c].dataType).alias(c) for c in (*ORDER, "text")])
    both = heads.unionByName(texts).repartition("conv").sortWithinPartitions("conv", F.col("audit").isNull(), *ORDER)
    return both.select("conv", "audit", "role", "text")


def repaired(rows: DataFrame) -> DataFrame:
    """The repaired conversations: conv_id as text, at (0, 1, ...), role, text and the edit of each row that stays."""
    held = faults(rows)
    lines = _streams(held, audits(held)).mapInPandas(_lines, "conv string, at long, role string, text string, edit string")
    return lines.select(F.when(F.col("conv") != "n", F.substring("conv", 2, 1 << 30)).alias("conv_id"), "at", "role", "text", "edit")


def report(rows: DataFrame, convs: DataFrame) -> DataFrame:
    """Per conv_id of ``convs``: gaps, counts of faults, cost, audit and the digest of its repaired rows."""
    held = faults(rows)
    found = audits(held)
    digests = _streams(held, found).mapInPandas(_digests, "conv string, sha string")
    keys = convs.select("conv_id").distinct().withColumn("conv", _key(F.col("conv_id")))
    whole = keys.join(found, "conv", "left").join(digests, "conv", "left")
    counts = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    return whole.select(
        "conv_id",
        *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in counts],
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("sha", F.sha2(F.lit(""), 256)).alias("repaired_sha256"),
    )


#: What the query returns for damaged conversations, row by row instead of span by span; for DuckDB.
SQL = f"""
WITH RECURSIVE steps AS (
    SELECT list(list_reduce([v, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: xor(c >> 1, 3988292384 * (c & 1))) ORDER BY v) AS t FROM (SELECT unnest(range(0, 256)) AS v)
), coded AS (
    SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
           xor(list_reduce(list_prepend(4294967295, list_transform(string_split(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '), ''), lambda x: CAST(ascii(x) AS BIGINT))),
                           lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 20 AS kind
    FROM conversations, steps
), hurt AS (
    SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
           CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
           unnest(range(CASE WHEN kind = 3 THEN 2 ELSE 1 END)) AS copy
    FROM coded WHERE kind <> 0
), ordered AS (
    SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text), copy) AS i,
           rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS shown
    FROM hurt
), judged AS (
    SELECT *, left(role, 1) AS initial, shown = '' AS blank,
           row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS repeated, right(shown, 1) NOT IN ('.', '!', '?') AS open
    FROM ordered
), tokens AS (
    SELECT *, blank OR repeated AS gone, CASE WHEN NOT blank AND NOT repeated AND open THEN {TRUNCATED} ELSE 0 END AS more,
           lag(initial) OVER (PARTITION BY conv_id ORDER BY i) || initial AS pair,
           coalesce(CAST(conv_id AS VARCHAR), 'none') AS conv
    FROM judged
), walk AS (
    SELECT conv, CAST(0 AS BIGINT) AS i, {{'c': CAST(0 AS BIGINT), 'a': ''}} AS p0, {{'c': CAST(1000000000 AS BIGINT), 'a': ''}} AS p1, {{'c': CAST(2 AS BIGINT), 'a': 'I'}} AS p2, {{'c': CAST(4 AS BIGINT), 'a': 'II'}} AS p3
    FROM (SELECT DISTINCT conv FROM tokens)
    UNION ALL
    SELECT conv, i, p0, p1, u2, list_min([u3, {{'c': u2.c + 2, 'a': u2.a || 'I'}}])
    FROM (
        SELECT conv, i, p0, p1, u3, list_min([q2, {{'c': p0.c + 2, 'a': p0.a || 'I'}}, {{'c': p1.c + 2, 'a': p1.a || 'I'}}, {{'c': u3.c + 2, 'a': u3.a || 'I'}}]) AS u2
        FROM (
            SELECT w.conv, t.i,
                   {{'c': p0.c + 3, 'a': p0.a || 'D'}} AS p0,
                   list_min([{{'c': p1.c + 3, 'a': p1.a || 'D'}}, {{'c': p0.c + CASE WHEN NOT gone AND initial = 's' THEN more ELSE 1000000000 END, 'a': p0.a || 'K'}}]) AS p1,
                   list_min([{{'c': p2.c + 3, 'a': p2.a || 'D'}}] || list_transform([p0, p1, p3], lambda x:
                       {{'c': x.c + CASE WHEN gone THEN 1000000000 WHEN initial = 'u' THEN more ELSE 2 + more END, 'a': x.a || CASE WHEN initial = 'u' THEN 'K' ELSE 'R' END}})) AS q2,
                   list_min([{{'c': p3.c + 3, 'a': p3.a || 'D'}}, {{'c': p2.c + CASE WHEN gone THEN 1000000000 WHEN initial = 'a' THEN more ELSE 2 + more END, 'a': p2.a || CASE WHEN initial = 'a' THEN 'K' ELSE 'R' END}}]) AS u3
            FROM walk w JOIN tokens t ON t.conv = w.conv AND t.i = w.i + 1
        )
    )
), ends AS (
    SELECT conv, list_min([p0, p3]) AS best FROM walk WHERE (conv, i) IN (SELECT (conv, max(i)) FROM tokens GROUP BY conv)
), edits AS (
    SELECT conv, best.c AS cost, best.a AS audit, e, substr(best.a, e, 1) AS edit,
           length(replace(substr(best.a, 1, e), 'I', '')) AS i, length(replace(best.a, 'D', '')) % 2 AS odd, length(replace(substr(best.a, 1, e), 'D', '')) AS place
    FROM (SELECT *, unnest(range(1, length(best.a) + 1)) AS e FROM ends)
), stays AS (
    SELECT e.conv, e.e, CASE WHEN edit = 'K' THEN role WHEN (place - odd) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || CASE WHEN edit = 'I' THEN '' ELSE text END AS line
    FROM edits e LEFT JOIN tokens t ON t.conv = e.conv AND t.i = e.i AND edit <> 'I' WHERE edit <> 'D'
), texts AS (
    SELECT conv, sha256(string_agg(line, chr(10) ORDER BY e)) AS sha FROM stays GROUP BY conv
), counts AS (
    SELECT conv, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (repeated AND NOT blank) AS duplicate,
           count(*) FILTER (more > 0) AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal
    FROM tokens GROUP BY conv
)
SELECT c.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, CAST(coalesce(blank, 0) AS BIGINT) AS blank, CAST(coalesce(duplicate, 0) AS BIGINT) AS duplicate,
       CAST(coalesce(truncated, 0) AS BIGINT) AS truncated, CAST(coalesce(illegal, 0) AS BIGINT) AS illegal,
       CAST(coalesce(best.c, 0) AS BIGINT) AS cost, coalesce(best.a, '') AS audit, coalesce(sha, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id, coalesce(CAST(conv_id AS VARCHAR), 'none') AS conv FROM conversations) c
LEFT JOIN counts USING (conv) LEFT JOIN ends USING (conv) LEFT JOIN texts USING (conv)
"""

"""Conversation repair: the parser against a plain search, reports against a plain version, odd rows."""

import hashlib
import random
import re
import sys
import zlib
from collections import defaultdict
from functools import lru_cache

import pytest
from seqcurate.llm import repair
from seqcurate.llm.queries import QUERIES

BLANK = re.compile(r"[^\x20\x09-\x0D]")
NEXT = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}


def cheapest(tokens):
    """(cost, audit) of the cheapest edits, trying all of them row by row."""
    sys.setrecursionlimit(20_000)

    @lru_cache(None)
    def go(i, place, inserted):
        found = [(0, "")] if i == len(tokens) and place in (0, 3) else []
        moves = []
        if inserted < 3:
            moves += [(i, (place, r), 2, "I", inserted + 1) for r in "ua"]
        if i < len(tokens):
            t, more = tokens[i], int(tokens[i].isupper())
            moves.append((i + 1, None, 3, "D", 0))
            if t not in "bd":
                moves.append((i + 1, (place, t.lower()), more, "K", 0))
                moves += [(i + 1, (place, r), 2 + more, "R", 0) for r in "ua"]
        for at, step, cost, edit, count in moves:
            to = place if step is None else NEXT.get(step)
            rest = None if to is None else go(at, to, count)
            if rest:
                found.append((cost + rest[0], edit + rest[1]))
        return min(found, default=None)

    return go(0, 0, 0)


@pytest.mark.parametrize("block", [1, 2, 5, 16])
def test_parser(block, monkeypatch):
    monkeypatch.setattr(repair, "BLOCK", block)
    rng = random.Random(block)
    for _ in range(400):
        tokens = "".join(rng.choices("bdsuaxSUAX", k=rng.randint(0, 24)))
        assert repair.sentence(repair.parse(tokens)) == cheapest(tokens)


def plain(rows):
    """Per conversation what report() says, from (conv_id, turn, role, text) after damage."""
    groups, out = defaultdict(list), {}
    for conv, turn, role, text in rows:
        groups[conv].append((turn, " " if role is None else role, " " if text is None else text))
    for conv, own in groups.items():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), hashlib.sha256(r[2].encode()).hexdigest()))
        seen, tokens = set(), ""
        for _, role, text in own:
            shown = BLANK.findall(text)
            first = role[:1] if role[:1] in tuple("sua") else "x"
            tokens += "b" if not shown else "d" if (role, text) in seen else first if shown[-1] in ".!?" else first.upper()
            seen.add((role, text))
        starts = [r[:1] for _, r, _ in own]
        turns = [t for t, _, _ in own if t is not None]
        cost, audit = cheapest(tokens)
        stays, at = [], 0
        for edit in audit:
            if edit == "I":
                stays.append([None, ""])
            else:
                if edit != "D":
                    stays.append([own[at][1] if edit == "K" else None, own[at][2]])
                at += 1
        odd = len(stays) % 2
        lines = [f"{role if role is not None else ('user', 'assistant')[(k - odd) % 2]}:{text}" for k, (role, text) in enumerate(stays)]
        out[conv] = (
            max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0,
            tokens.count("b"), tokens.count("d"), sum(t.isupper() for t in tokens), sum(a + b not in ("su", "ua", "au") for a, b in zip(starts, starts[1:])),
            cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest(),
        )
    return out


def reported(frame):
    rows = frame.collect()
    got = {r.conv_id: tuple(r[c] for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")) for r in rows}
    assert len(got) == len(rows)
    return got


def hurt(rows):
    for conv, turn, role, text in rows:
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(key.encode()) % 20
        if kind:
            text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
            yield from [(conv, turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)


NONE = (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())


def test_given_table(spark, sf_dir):
    given = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    want = dict.fromkeys((r[0] for r in given), NONE) | plain(hurt(given))
    assert reported(QUERIES["op13_cyk_repair"](spark, sf_dir)) == want


ODD = [
    (1, 0, "system", "Hi."), (1, None, "user", "What?"), (1, None, "user", "What?"), (1, 5, "assistant", "So \n"), (1, 9, "tool", "x!"), (1, 9, "assistant", "y!"),
    (2, 0, None, None), (2, 1, "user", None), (None, 0, "user", "q?"), (None, None, "assistant", "a."), (None, 0, "user", "q?"), (3, 0, "", "."),
    (4, 0, "User", "Ü漢😀."), (4, 1, "user", "Ü漢😀."), (5, 0, "user", "\x85"), (5, 1, "user", "end. "), (5, 1 << 60, "assistant", "far."), (5, (1 << 60) + 1, "assistant", "far."),
]


def _frame(spark, rows):
    return spark.createDataFrame([(*r, "clash", "K", 1) for r in rows], "conv_id long, turn long, role string, text string, audit string, token string, row int")


def test_odd_rows(spark):
    frame = _frame(spark, ODD)
    assert reported(repair.report(frame, frame)) == plain(ODD)
    want = dict.fromkeys((r[0] for r in ODD), NONE) | plain(hurt(ODD))
    assert reported(repair.report(repair.damage(frame), frame)) == want
    none = frame.limit(0)
    assert repair.report(none, none).count() == 0
    assert reported(repair.report(none, frame)) == dict.fromkeys((r[0] for r in ODD), NONE)


def test_long_and_repeated(spark):
    """One conversation over many batches and partitions, one of equal rows, a long text."""
    rng = random.Random(4)
    long = [(7, k // 2 if k % 5 else None, rng.choice(["user", "assistant", "system", "tool"]), rng.choice(["a.", "b!", "c", " ", f"{k}?"])) for k in range(700)]
    rows = long + [(8, 1, "user", "same.")] * 300 + [(9, 0, "user", "x" * 3_000_000 + "."), (9, 1, "assistant", "ok.")]
    frame = _frame(spark, rows).repartition(5, "text")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 37)
    try:
        assert reported(repair.report(frame, frame)) == plain(rows)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_repaired_rows(spark):
    rows = [(1, 0, "user", "Hello."), (1, 1, "user", "Still there?"), (1, 2, "assistant", "Yes."), (2, 0, "system", "Be kind."), (2, 1, "assistant", "Hm.")]
    got = sorted(map(tuple, repair.repaired(_frame(spark, rows)).collect()))
    assert got == [
        ("1", 0, "user", "Hello.", "K"), ("1", 1, "assistant", "", "I"), ("1", 2, "user", "Still there?", "K"), ("1", 3, "assistant", "Yes.", "K"),
        ("2", 0, "system", "Be kind.", "K"), ("2", 1, "user", "", "I"), ("2", 2, "assistant", "Hm.", "K"),
    ]

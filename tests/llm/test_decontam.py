"""Benchmark decontamination: odd tables and a plain search for every window."""

import random
import re

import pytest
from pyspark.sql import functions as F
from seqcurate.llm import decontam

WORDS = [f"w{k}" for k in range(40)]


def words_of(text):
    lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)


def plain(docs, items, window=10):
    """(n_words, hit positions, items) of each text, by looking at every place."""
    cut = []
    for item, text in items:
        w = words_of(text)
        n = min(window, len(w))
        cut += [("" if item is None else str(item), tuple(w[i : i + n])) for i in range(len(w) - n + 1) if n]
    out = []
    for text in docs:
        w, places, names = words_of(text), set(), set()
        for item, run in cut:
            for i in range(len(w) - len(run) + 1):
                if tuple(w[i : i + len(run)]) == run:
                    places |= set(range(i, i + len(run)))
                    names.add(item)
        out.append((len(w), sorted(places), sorted(names)))
    return out


def found(spark, docs, items, **how):
    frame = spark.createDataFrame([(k, t) for k, t in enumerate(docs)], "doc_id long, text string")
    rows = decontam.find(frame, spark.createDataFrame(items, "item_id long, text string"), ["doc_id"], **how).collect()
    assert len(rows) == len(docs)
    rows = sorted(rows, key=lambda r: r.kept.doc_id)
    assert all(r.n_hit == sum(s.end - s.start for s in r.spans) for r in rows)
    return [(r.n_words, [p for s in r.spans for p in range(s.start, s.end)], list(r["items"])) for r in rows]


@pytest.mark.parametrize("bits", [64, decontam.BITS])
def test_random_texts(spark, bits, monkeypatch):
    """Few words, so shingles and windows recur; a crowded bit table changes nothing."""
    monkeypatch.setattr(decontam, "bit_table", lambda rows, column, size=bits, put=decontam.bit_table: put(rows, column, size))
    rng = random.Random(3)
    some = lambda n, of: " ".join(rng.choices(WORDS[:of], k=n))
    items = [(k, some(rng.choice([1, 2, 3, 5, 9, 10, 11, 30]), rng.choice([3, 40]))) for k in range(30)] + [(7, some(12, 40)), (None, some(12, 40))]
    docs = [some(rng.randint(0, 60), rng.choice([3, 40])) for _ in range(40)]
    docs += [f"{some(5, 40)}, {items[rng.randrange(len(items))][1].upper()}! {some(5, 40)}" for _ in range(20)]
    assert found(spark, docs, items) == plain(docs, items)


def test_copies_overlaps_and_borders(spark):
    passage = " ".join(f"p{k}" for k in range(14))
    nines = " ".join(f"p{k}" for k in range(9))
    items = [(1, passage), (2, passage), (30, "solo"), (4, None), (5, "!?"), (6, nines)]
    docs = [passage, passage[3:], nines, f"x {passage} solo", f"{passage} {passage}", "p0 p1", "", None, " \t\n", "SOLO", "Ünïcode 漢字 solo-p1"]
    assert found(spark, docs, items) == plain(docs, items)


def test_odd_rows(spark, odd_docs, no_docs):
    items = spark.createDataFrame([(1, "alpha beta gamma delta epsilon zeta eta theta iota kappa"), (None, "short LINE"), (2, "漢字")], "item_id int, text string")
    got = decontam.find(odd_docs, items, odd_docs.columns)
    assert got.count() == odd_docs.count()
    assert got.select("kept.*").exceptAll(odd_docs).count() == 0
    hit = {r.doc_id: (r.n_hit, list(r.names)) for r in got.select("kept.doc_id", "n_hit", F.col("items").alias("names")).collect()}
    assert hit[1] == hit[2] == hit[3] == hit[None] == (10, ["1"]) and hit[8] == (2, [""]) and hit[10] == (1, ["2"]) and hit[4] == hit[5] == hit[7] == (0, [])
    assert decontam.find(no_docs, items, ["doc_id"]).count() == 0
    assert decontam.find(odd_docs, items.limit(0), ["doc_id"]).agg(F.sum("n_hit")).first()[0] == 0


def test_long_text(spark):
    rng = random.Random(9)
    docs = [" ".join(f"v{rng.randrange(10**6)}" for _ in range(300_000)), "v" * 2_000_000]
    words = docs[0].split()
    items = [(1, " ".join(words[150_000:150_025])), (2, docs[1])]
    assert found(spark, docs, items) == [(300_000, list(range(150_000, 150_025)), ["1"]), (1, [0], ["2"])]

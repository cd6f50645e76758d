"""Work that must grow with the rows: batches instead of groups, one reading of a text."""

import random

import numpy as np
import pandas as pd
from seqcurate.operators import signal, splits
from seqcurate.plans import queries, surrogates

KEYS, ORDER = ["sequence_id"], "frame_index"


def test_blocks_are_decided_a_batch_at_once():
    """Thousands of short sequences come as one frame, not as one frame each; the choice is the greedy one."""
    rng = random.Random(5)
    rows = [(f"s{k:05d}", i, rng.choice([0.1, rng.random()]), 0.5, False, 0, True) for k in range(2000) for i in sorted(rng.sample(range(90), rng.randint(1, 9)))]
    frame = pd.DataFrame(rows, columns=[*KEYS, ORDER, "prominence", "signal", "fixed", "_block", "_core"])
    parts = [frame.iloc[:4321], frame.iloc[4321:]]
    decide = signal._decide(7, 16_384, 128, KEYS, ORDER)
    got = list(decide(iter(parts)))
    assert len(got) <= len(parts) + 1
    state = pd.concat(got)
    assert state.fixed.all()
    want = []
    for _, own in frame.groupby("sequence_id"):
        kept = []
        for at in own.sort_values(["prominence", "signal", ORDER], ascending=False)[ORDER]:
            if all(abs(at - k) >= 7 for k in kept):
                kept.append(at)
        want.append(len(kept))
    assert len(state) == sum(want) and np.array_equal(state.groupby("sequence_id").size(), want)


def test_letters_are_counted_once(spark, tmp_path):
    """Sketches come from a written table, so neither reader goes back to the texts; counts follow the definition."""
    rng = random.Random(3)
    texts = [None, "", "Aa\u212a\u0130 zZ", "b" * 1_500_000 + "aac", *("".join(rng.choices("abcXYZ .\u00e9", k=200)) for _ in range(5))]
    docs = spark.createDataFrame([(i, t, "en", "web", len(t or "")) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    rows = surrogates.sketches(spark, str(tmp_path))
    assert not any("documents.parquet" in f for f in rows.inputFiles())
    got = {int(r["sample_id"]): r["sketch"] for r in rows.collect()}
    for i, text in enumerate(texts):
        # Spark writes the dotted capital I in lower case as two characters, as Python does.
        n = [(text or "").lower().count(c) for c in "abcdefghijklmnopqrstuvwxyz"]
        bits = "".join("1" if n[k] > n[k + step] else "0" for step, count in surrogates.SKETCH for k in range(count))
        assert got[i] == f"{int(bits, 2):016x}"


def test_every_prepared_row_is_digested(spark, sf_dir):
    """The whole tree counts all rows of all views, test rows in each; a path has its view's folder."""
    views = queries.prepared(spark, sf_dir)
    got = {r["view"]: r for r in queries.QUERIES["tree_digest"](spark, sf_dir).collect()}
    want = {f"fold_{r['fold_view']}/{r['prepared_role']}": r["count"] for r in views.groupBy("fold_view", "prepared_role").count().collect()}
    assert {v: r["entries"] for v, r in got.items()} == {**want, "all": sum(want.values())}
    assert len({r["digest"] for v, r in got.items() if not v.endswith("test")}) == 11


def test_a_prepared_row_changes_its_view_and_the_whole(spark):
    rows = [(k, role, f"{role}/a{n}.png", "x") for k in range(2) for role in ("train", "test") for n in range(3)]
    views = spark.createDataFrame(rows, "fold_view int, prepared_role string, relative_path string, sha256 string")
    before = {r["view"]: r["digest"] for r in splits.prepared_digests(views).collect()}
    moved = spark.createDataFrame([(*r[:3], "y") if r[:3] == (1, "test", "test/a2.png") else r for r in rows], views.schema)
    after = {r["view"]: r["digest"] for r in splits.prepared_digests(moved).collect()}
    assert {v for v in before if before[v] != after[v]} == {"all", "fold_1/test"}

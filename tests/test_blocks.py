"""Block arithmetic: results must not depend on where blocks are cut, also for one long sequence."""

import random

import pytest
from pyspark.sql import functions as F

from seqcurate.operators import asof, blocks, labels, metrics, selection, signal, splits, windows
from seqcurate.schemas import PHASES

KEYS, ORDER = ["sequence_id"], "frame_index"


def brute_signal(values):
    """The signal rules as plain loops."""
    known = [(i, v) for i, v in enumerate(values) if v is not None]
    filled = []
    for i in range(len(values)):
        left = [p for p in known if p[0] <= i]
        right = [p for p in known if p[0] >= i]
        if not known:
            filled.append(0.0)
        elif not left:
            filled.append(right[0][1])
        elif not right or left[-1][0] == i:
            filled.append(left[-1][1])
        else:
            (x0, y0), (x1, y1) = left[-1], right[0]
            filled.append((y1 - y0) / (x1 - x0) * (i - x0) + y0)
    n = len(filled)
    smooth = filled if n < 3 else [
        (filled[max(0, i - 1)] + filled[i] + filled[min(n - 1, i + 1)]) / 3.0 for i in range(n)
    ]
    found = []
    for i in range(1, n - 1):
        if smooth[i] >= smooth[i - 1] and smooth[i] >= smooth[i + 1]:
            rise = smooth[i] - max(min(smooth[max(0, i - 3) : i]), min(smooth[i + 1 : i + 4]))
            if rise >= 0.015:
                found.append((rise, smooth[i], i))
    kept = []
    for _, _, i in sorted(found, reverse=True):
        if all(abs(i - k) >= 7 for k in kept):
            kept.append(i)
    return filled, sorted(kept)


def brute_grid(frames, detected, expected):
    import statistics

    if len(detected) >= 3:
        median = statistics.median(b - a for a, b in zip(detected, detected[1:]))
    else:
        detected, median = [detected[0] if detected else min(frames)], expected
    step = max(7, round(median))
    grid = list(detected)
    while grid[0] > min(frames):
        grid.insert(0, grid[0] - step)
    while grid[-1] <= max(frames):
        grid.append(grid[-1] + step)
    points = set(grid)
    for a, b in zip(grid, grid[1:]):
        if b - a > 1.65 * step:
            pieces = max(2, round((b - a) / step))
            points |= {round(a + (b - a) * k / pieces) for k in range(1, pieces)}
    return sorted(points)


@pytest.fixture(scope="module")
def sequences(spark):
    rng = random.Random(3)
    table = {
        "long": [None if rng.random() < 0.1 else rng.random() for _ in range(400)],
        "wave": [0.45 + 0.2 * ((i % 11) / 11) + 0.01 * rng.random() for i in range(150)],
        "rising": [0.001 * i * (i % 3 == 0) for i in range(200)],
        "flat": [0.5] * 40,
        "empty": [None] * 20,
        "two": [0.1, 0.9],
        "one": [0.3],
        "sparse": [1.0 if i in (20, 60, 140) else 0.0 for i in range(180)],
    }
    rows = [(name, i, v) for name, values in table.items() for i, v in enumerate(values)]
    return table, spark.createDataFrame(rows, "sequence_id string, frame_index bigint, feature double")


@pytest.mark.parametrize("span", [7, 64, 65_536])
def test_signal_and_labels_match_the_loops(spark, sequences, monkeypatch, span):
    monkeypatch.setattr(blocks, "SPAN", span)
    table, df = sequences
    filled = signal.interpolate(df, KEYS, ORDER, "feature").collect()
    want = {name: brute_signal(values) for name, values in table.items()}
    for row in filled:
        assert row["filled"] == pytest.approx(want[row["sequence_id"]][0][row["frame_index"]], abs=1e-12)
    candidates = signal.peak_candidates(signal.interpolate(df, KEYS, ORDER, "feature"), KEYS, ORDER, "filled")
    peaks = signal.suppress(candidates, KEYS, ORDER, span=min(span, 256), context=min(4 * span, 128))
    got = {name: [] for name in table}
    for row in peaks.collect():
        got[row["sequence_id"]].append(row["frame_index"])
    assert {name: sorted(v) for name, v in got.items()} == {name: w[1] for name, w in want.items()}

    stats = labels.sequence_stats(df, peaks, KEYS, ORDER, "feature", F.lit(13))
    located = labels.locate(df, peaks, stats, KEYS, ORDER)
    grid = {name: [] for name in table}
    for row in labels.grid(located, KEYS).collect():
        grid[row["sequence_id"]].append(row["grid_frame"])
    for name, values in table.items():
        assert sorted(grid[name]) == brute_grid(range(len(values)), want[name][1], 13), name
    for row in located.collect():
        points = sorted(grid[row["sequence_id"]])
        start = max(p for p in points if p <= row["frame_index"])
        assert (row["cell_start"], row["cell_end"]) == (start, points[points.index(start) + 1])


@pytest.mark.parametrize(("span", "context"), [(64, 0), (256, 16), (16_384, 128)])
def test_greedy_choice_with_long_chains(spark, span, context):
    """Strength rises along the sequence, or is the same everywhere, so each choice hangs on the next over many blocks."""
    rng = random.Random(8)
    rows = [("s", 3 * i, float(i), 0.0) for i in range(300)] + [("t", 5 * i, float(-i), 0.0) for i in range(100)]
    rows += [("same", 4 * i, 0.5, 0.5) for i in range(250)] + [("any", i, rng.choice([0.1, 0.2, rng.random()]), rng.random()) for i in range(-300, 700)]
    df = spark.createDataFrame(rows, "sequence_id string, frame_index bigint, prominence double, signal double")
    got = signal.suppress(df.repartition(3), KEYS, ORDER, span=span, context=context).collect()
    for name in ("s", "t", "same", "any"):
        kept = []
        for _, _, at in sorted(((p, v, i) for n, i, p, v in rows if n == name), reverse=True):
            if all(abs(at - k) >= 7 for k in kept):
                kept.append(at)
        assert sorted(r["frame_index"] for r in got if r["sequence_id"] == name) == sorted(kept)


def test_greedy_choice_in_small_batches(spark):
    """A block reaches Python in pieces."""
    rng = random.Random(9)
    rows = [(f"s{k}", i, rng.random(), 0.0) for k in range(3) for i in range(200)]
    df = spark.createDataFrame(rows, "sequence_id string, frame_index bigint, prominence double, signal double")
    want = sorted(map(tuple, signal.suppress(df, KEYS, ORDER).collect()))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        assert sorted(map(tuple, signal.suppress(df, KEYS, ORDER, span=50).collect())) == want
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


@pytest.mark.parametrize("span", [5, 65_536])
def test_segments_runs_and_clips(spark, monkeypatch, span):
    monkeypatch.setattr(blocks, "SPAN", span)
    frames = [1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 20, 21, 30] + list(range(40, 75))
    rows = [("a", f, "xyz"[f % 3], f / 100) for f in frames]
    df = spark.createDataFrame(rows, "sequence_id string, frame_index bigint, label string, score double")
    number = {r["frame_index"]: r["segment"] for r in windows.segments(df, KEYS, ORDER).collect()}
    assert [number[f] for f in (1, 10, 20, 21, 30, 40, 74)] == [1, 1, 2, 2, 3, 4, 4]
    start = {r["frame_index"]: r["run_start"] for r in windows.runs(df, KEYS, ORDER).collect()}
    assert (start[10], start[21], start[30], start[74]) == (1, 20, 30, 40)
    best = windows.run_peaks(df.withColumn("score", F.lit(0.5)), KEYS, ORDER, "score").collect()
    assert sorted(r["frame_index"] for r in best) == [1, 20, 30, 40]

    segments = [[f for f in frames if number[f] == s] for s in (1, 2, 3, 4)]
    want = []
    for members in segments:
        final = max(0, len(members) - 9)
        starts = sorted(set(range(0, final + 1, 4)) | {final})
        for s in starts:
            for slot in range(9):
                at = s + slot
                want.append((members[0], s, slot, members[min(at, len(members) - 1)], at < len(members)))
    clips = windows.clips(df, KEYS, ORDER, "label", 9, 4).collect()
    assert sorted((r["segment_start"], r["clip_start"], r["slot"], r["frame_index"], r["valid"]) for r in clips) == sorted(want)

    context = windows.context(df.withColumn("id", F.col(ORDER).cast("string")), KEYS, ORDER, "id", 5)
    for row in context.collect():
        members = segments[number[row["frame_index"]] - 1]
        at = members.index(row["frame_index"])
        assert row["context"] == [str(members[min(max(at + o, 0), len(members) - 1)]) for o in range(-2, 3)]


@pytest.mark.parametrize("span", [4, 65_536])
def test_asof_nearest_and_transitions(spark, monkeypatch, span):
    monkeypatch.setattr(blocks, "SPAN", span)
    rng = random.Random(5)
    left = sorted(rng.sample(range(300), 60))
    right = sorted(rng.sample(range(300), 12))
    a = spark.createDataFrame([("k", x) for x in left] + [("none", 3)], "sequence_id string, frame_index bigint")
    b = spark.createDataFrame([("k", x) for x in right], "sequence_id string, frame_index bigint")
    for row in asof.backward(a, b, KEYS, ORDER).collect():
        if row["sequence_id"] == "none":
            assert row["start"] is None and row["end"] is None
            continue
        x = row["frame_index"]
        assert row["start"] == max((r for r in right if r <= x), default=None)
        assert row["end"] == min((r for r in right if r > x), default=None)
    for row in asof.nearest(a, b, KEYS, ORDER).collect():
        if row["sequence_id"] == "k":
            assert row["distance"] == min(abs(row["frame_index"] - r) for r in right)

    from seqcurate.schemas import ALLOWED_TRANSITIONS, PHASES

    order = [rng.randrange(4) for _ in left]
    rows = [("u", "k", f, PHASES[p]) for f, p in zip(left, order)]
    df = spark.createDataFrame(rows, "subject_id string, sequence_id string, frame_index bigint, y_pred string")
    got = metrics.transition_validity(df).first()
    pairs = list(zip(order, order[1:]))
    assert got["pairs"] == len(pairs)
    assert got["transition_validity"] == pytest.approx(sum(q in ALLOWED_TRANSITIONS[p] for p, q in pairs) / len(pairs))


def test_rank_is_a_global_row_number(spark):
    df = spark.range(1000).withColumn("h", F.sha2(F.col("id").cast("string"), 256))
    got = blocks.rank(df, [], ["h"], F.substring("h", 1, 2)).orderBy("position").collect()
    assert [r["position"] for r in got] == list(range(1000))
    assert [r["h"] for r in got] == sorted(r["h"] for r in got)
    many = df.withColumn("k", F.col("id") % 3)
    by_key = blocks.rank(many, ["k"], ["h"], F.substring("h", 1, 2), "p", "n").groupBy("k").agg(
        F.max("p").alias("p"), F.max("n").alias("n"), F.count_distinct("p").alias("c")
    )
    assert all(r["p"] + 1 == r["n"] == r["c"] for r in by_key.collect())


def test_rank_with_hot_and_null_keys(spark):
    rng = random.Random(2)
    rows = [("hot" if rng.random() < 0.5 else f"k{rng.randrange(40)}" if rng.random() < 0.9 else None, rng.choice([None, *range(300)]), i) for i in range(400)]
    df = spark.createDataFrame(rows, "k string, at int, id int")
    got = blocks.rank(df, ["k"], ["at", "id"], F.floor(F.col("at") / 10), "p", "n")
    want = {}
    for k in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == k), key=lambda r: (r[1] is not None, r[1] or 0, r[2]))
        for p, row in enumerate(own):
            want[row[2]] = (p, len(own))
    assert {r["id"]: (r["p"], r["n"]) for r in got.collect()} == want


PLACED = {
    "interpolate": lambda df: signal.interpolate(df, KEYS, ORDER, "feature"),
    "smooth": lambda df: signal.smooth(df, KEYS, ORDER, "feature"),
    "peak_candidates": lambda df: signal.peak_candidates(df, KEYS, ORDER, "feature"),
    "suppress": lambda df: signal.suppress(df.withColumns({"prominence": F.lit(1.0), "signal": F.lit(1.0)}), KEYS, ORDER),
    "segments": lambda df: windows.segments(df, KEYS, ORDER),
    "runs": lambda df: windows.runs(df, KEYS, ORDER),
    "run_peaks": lambda df: windows.run_peaks(df, KEYS, ORDER, "feature"),
    "context": lambda df: windows.context(df, KEYS, ORDER, "label", 3),
    "located_in_segment": lambda df: windows.located_in_segment(df, KEYS, ORDER, "label"),
    "clips": lambda df: windows.clips(df, KEYS, ORDER, "label", 3, 1),
    "sequence_scores": lambda df: windows.sequence_scores(df, KEYS, ORDER, F.lit(0), ["feature"] * 4, "feature", "feature"),
    "backward": lambda df: asof.backward(df, df.limit(1), KEYS, ORDER),
    "nearest": lambda df: asof.nearest(df.limit(1), df, KEYS, ORDER),
    "boundary_flags": lambda df: labels.boundary_flags(df, KEYS, ORDER, "label"),
    "running_sum": lambda df: blocks.running_sum(df, KEYS, ORDER, F.lit(1), "n"),
    "transition_validity": lambda df: metrics.transition_validity(df.withColumns({"subject_id": F.col("sequence_id"), "y_pred": F.lit(PHASES[0])})),
}


@pytest.mark.parametrize("name", sorted(PLACED))
def test_rows_without_a_place_stop_the_job(spark, name):
    """Neither a null key nor a null order value disappears; routed off, the rest goes on."""
    kind = "sequence_id string, frame_index bigint, feature double, label string"
    good = [("a", 1, 0.5, "x"), ("a", 2, 0.25, "y"), ("b", 1, 0.5, "x")]
    for bad, reason in ((("a", None, 0.5, "x"), "no frame_index"), ((None, 3, 0.5, "x"), "no sequence_id")):
        df = spark.createDataFrame([*good, bad], kind).repartition(1)
        with pytest.raises(Exception, match="without a place"):
            PLACED[name](df.orderBy(F.col("feature").desc(), F.col("frame_index").asc_nulls_first(), F.col("sequence_id").asc_nulls_first())).collect()
        kept, ledger = blocks.route(df, KEYS, ORDER)
        assert [(r["reject_reason"], r["feature"]) for r in ledger.collect()] == [(reason, 0.5)] and kept.count() == 3
        PLACED[name](kept).collect()
        assert blocks.reject_counts(df, KEYS, ORDER).first()["rows"] == 1


def _reads(df):
    """Scans of tables in the plan that ran, without those that a reused shuffle spares."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    return plan.count("FileScan ") + plan.count("Scan ExistingRDD"), plan


@pytest.mark.parametrize("name", ["carry", "running_sum", "segments", "runs", "located_in_segment", "nearest"])
def test_input_is_evaluated_once(spark, sf_dir, name):
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("user_id").cast("string").alias("sequence_id"), F.col("event_id").alias(ORDER), "value")
    made = {
        "carry": lambda: blocks.carry(rows, KEYS, ORDER, last={"v": F.col("value")}),
        "running_sum": lambda: blocks.running_sum(rows, KEYS, ORDER, F.col("value"), "v"),
        "segments": lambda: windows.segments(rows, KEYS, ORDER),
        "runs": lambda: windows.runs(rows, KEYS, ORDER),
        "located_in_segment": lambda: windows.located_in_segment(rows, KEYS, ORDER, "value"),
        "nearest": lambda: asof.nearest(rows, rows.filter("value > 50"), KEYS, ORDER),
    }[name]()
    scans, plan = _reads(made)
    assert scans == (2 if name == "nearest" else 1), plan  # nearest has two inputs
    assert "ReusedExchange" in plan


def test_explode_span_crosses_chunks(spark):
    df = spark.createDataFrame([(0, 10), (5, 5), (7, 20)], "a bigint, b bigint")
    got = blocks.explode_span(df, F.col("a"), F.col("b"), "f", chunk=4).collect()
    want = [(a, f) for a, b in ((0, 10), (5, 5), (7, 20)) for f in range(a, b)]
    assert sorted((r["a"], r["f"]) for r in got) == sorted(want)


def test_splits_do_not_depend_on_partitioning(spark):
    df = spark.createDataFrame([("d", f"d:{i}", f"s{i}-{j}") for i in range(40) for j in range(3)], "dataset string, subject_id string, sample_id string")
    one = splits.subject_table(df.repartition(1)).collect()
    many = splits.subject_table(df.repartition(13)).collect()
    assert sorted(map(tuple, one)) == sorted(map(tuple, many))


def test_pick_matches_sequential_choice(spark):
    rng = random.Random(11)
    rows = []
    for family in selection.FAMILIES:
        for i in range(40):
            rows.append(("d", family, "c", f"subj{rng.randrange(14)}", f"{family}-{i}", rng.randrange(40, 60), 0, 0, True))
    ddl = "dataset string, condition_family string, condition string, subject_id string, sequence_id string, frame_count bigint, first_frame bigint, last_frame bigint, is_contiguous boolean"
    got = selection.pick(spark.createDataFrame(rows, ddl), 3, 99).collect()
    import hashlib
    import statistics

    used, want = set(), []
    for family in selection.FAMILIES:
        mine = [r for r in rows if r[1] == family]
        middle = statistics.median(r[5] for r in mine)
        key = lambda r: (abs(r[5] - middle), hashlib.sha256(f"99:{r[4]}".encode()).hexdigest(), r[4])
        count = 0
        for row in sorted(mine, key=key):
            if row[3] not in used and count < 3:
                used.add(row[3])
                want.append(row[4])
                count += 1
    assert [r["sequence_id"] for r in got] == want
    assert [r["blind_sequence_id"] for r in got] == [f"pilot_{i:03d}" for i in range(1, 13)]

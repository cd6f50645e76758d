"""Operator results on small tables with known answers."""

import math

import pytest
from pyspark.sql import functions as F

from seqcurate import schemas as S
from seqcurate.functions import ids
from seqcurate.operators import (
    agreement,
    audit,
    baselines,
    bootstrap,
    dedupe,
    labels,
    lineage,
    metrics,
    rules,
    runs,
    selection,
    signal,
    splits,
    windows,
)

P = S.PHASES
KEYS = ["sequence_id"]


def report(df):
    return {r["rule"]: r["violations"] for r in df.collect()}


# --- manifest ---------------------------------------------------------------------------------


def manifest(spark, **changes):
    base = dict.fromkeys(S.MANIFEST_COLUMNS)
    base.update(
        sample_id="s1", dataset="d", subject_id="d:1", sequence_id="d:1:a", condition="fn00", frame_index=1,
        relative_path="a/1.png", sha256="0" * 64, perceptual_hash="1" * 16, adjudicated_label=P[0], split="development", fold=0,
    )
    rows = changes.pop("rows", [{}])
    table = [{**base, "sample_id": f"s{i}", **changes, **row} for i, row in enumerate(rows)]
    return spark.createDataFrame([tuple(r[c] for c in S.MANIFEST_COLUMNS) for r in table], S.MANIFEST_DDL)


def test_valid_frozen_manifest(spark):
    assert not any(report(rules.manifest(manifest(spark), frozen=True)).values())
    rules.raise_if_any(rules.manifest(manifest(spark), frozen=True))


@pytest.mark.parametrize(
    "rows, rule",
    [
        ([{}, {"adjudicated_label": P[1]}], "one label per content"),
        ([{}, {"sample_id": "s0"}], "sample_id unique"),
        ([{"subject_id": "1"}], "subject_id namespaced"),
        ([{"sha256": " "}], "sha256 present"),
        ([{"adjudicated_label": "run"}], "adjudicated_label in vocabulary"),
        ([{"adjudicated_label": None}], "frozen rows labelled"),
        ([{"split": None}], "frozen rows split"),
        ([{}, {"split": "test"}], "subject in one split"),
        ([{"duplicate_group": "g"}, {"duplicate_group": "g", "subject_id": "d:2", "split": "test"}], "duplicate group in one split"),
    ],
)
def test_manifest_rule_breaks(spark, rows, rule):
    found = report(rules.manifest(manifest(spark, rows=rows), frozen=True))
    assert found[rule] == 1
    with pytest.raises(S.RuleViolation, match=rule):
        rules.raise_if_any(rules.manifest(manifest(spark, rows=rows), frozen=True))


def test_missing_column_stops_early(spark):
    with pytest.raises(S.RuleViolation, match="sha256"):
        rules.manifest(manifest(spark).drop("sha256"))


def test_duplicates_across_two_subjects(spark):
    df = dedupe.assign_groups(manifest(spark, rows=[{}, {"subject_id": "d:2"}, {"sha256": "f" * 64, "perceptual_hash": "9"}]))
    exact, near = dedupe.audit_exact(df), dedupe.audit_near(df)
    assert exact.first().asDict() == {"duplicate_group": "exact-000001", "samples": 2, "subjects": 2, "datasets": 1}
    total = dedupe.audit_summary(exact, near).first()
    assert (total["exact_cross_subject_groups"], total["perceptual_cross_subject_groups"], total["exact_members"]) == (1, 1, 2)
    none = dedupe.audit_summary(exact.limit(0), near.limit(0)).first()
    assert set(none.asDict().values()) == {0}


# --- splits -----------------------------------------------------------------------------------


def split_input(spark, duplicates=()):
    rows = []
    for d in ("a", "b"):
        for s in range(10):
            for f in range(2):
                group = "dup" if (d, s, f) in duplicates else None
                rows.append((d, f"{d}:{s}", f"{d}{s}{f}", group))
    return spark.createDataFrame(rows, "dataset string, subject_id string, sample_id string, duplicate_group string")


def test_split_sizes_and_rules(spark):
    out = splits.make_subject_splits(split_input(spark))
    test = out.filter("split = 'test'").groupBy("dataset").agg(F.count_distinct("subject_id").alias("n"))
    assert {r["dataset"]: r["n"] for r in test.collect()} == {"a": 2, "b": 2}
    assert not any(report(rules.splits(out)).values())
    assert {r[0] for r in out.filter("split = 'test'").select("fold").collect()} == {-1}
    again = splits.make_subject_splits(split_input(spark).repartition(7))
    assert sorted(map(tuple, out.select("sample_id", "split", "fold").collect())) == sorted(
        map(tuple, again.select("sample_id", "split", "fold").collect())
    )


def test_duplicate_over_subjects_is_excluded(spark):
    out = splits.make_subject_splits(split_input(spark, {("a", 0, 0), ("a", 1, 0)}))
    hit = out.filter("exclusion_reason is not null").select("sample_id", "exclusion_reason").collect()
    assert sorted(map(tuple, hit)) == [("a00", S.CROSS_SUBJECT_REASON), ("a10", S.CROSS_SUBJECT_REASON)]


def test_duplicate_over_partitions_is_reported(spark):
    out = splits.make_subject_splits(split_input(spark)).withColumn(
        "duplicate_group", F.when(F.col("sample_id").isin("a00", "a01"), "g")
    )
    broken = out.withColumn("split", F.when(F.col("sample_id") == "a00", "test").otherwise("development"))
    assert report(rules.splits(broken))["duplicate group in one split"] == 1
    with pytest.raises(S.RuleViolation):
        rules.raise_if_any(rules.splits(broken))


def test_too_few_subjects(spark):
    few = split_input(spark).filter("subject_id in ('a:1', 'a:2')")
    with pytest.raises(Exception, match="Too few subjects"):
        splits.subject_table(few).collect()
    with pytest.raises(ValueError):
        splits.subject_table(few, folds=1)


# --- signal and labels ------------------------------------------------------------------------


def wave(spark, values):
    rows = [(f"x{i}", "d", "d:1", "q", "fn00", i, f"{i}.png", "development", 0, float(v), None) for i, v in enumerate(values)]
    return spark.createDataFrame(
        rows,
        "sample_id string, dataset string, subject_id string, sequence_id string, condition string, frame_index bigint, "
        "relative_path string, split string, fold int, feature double, exclusion_reason string",
    )


def labelled(df, step=13):
    peaks = signal.contact_peaks(df, KEYS, "frame_index", "feature")
    stats = labels.sequence_stats(df, peaks, KEYS, "frame_index", "feature", F.lit(step))
    located = labels.locate(df, peaks, stats, KEYS, "frame_index")
    return peaks, stats, located


def test_known_peaks_and_full_labelling(spark):
    df = wave(spark, [0.45 + 0.18 * (1 + math.cos(2 * math.pi * (i - 5) / 10)) / 2 for i in range(40)])
    found = signal.contact_peaks(df, KEYS, "frame_index", "feature", 7, 0.025)
    assert sorted(r["frame_index"] for r in found.collect()) == [5, 15, 25, 35]
    peaks, stats, located = labelled(df)
    out = labels.assign(located).collect()
    assert len(out) == 40 and {r["phase_label"] for r in out} == set(P)
    quality = labels.qc(df, stats, KEYS, F.col("exclusion_reason").isNull(), ["dataset"]).first()
    assert (quality["coverage_method"], quality["confidence"], quality["eligible_frame_count"]) == ("detected_contacts", "medium", 40)
    marks = labels.boundaries(located, KEYS).collect()
    assert marks and all(list(r[m] for m in S.MACHINE_MARKS) == sorted({r[m] for m in S.MACHINE_MARKS}) for r in marks)
    assert [r["cycle_id"] for r in sorted(marks, key=lambda r: r["contact_start_frame"])] == ["step_002", "step_003", "step_004"]


def test_flat_signal_uses_the_prior(spark):
    df = wave(spark, [0.5] * 40)
    _, stats, located = labelled(df)
    assert stats.first()["coverage_method"] == "condition_cycle_prior"
    assert {r["confidence"] for r in labels.assign(located).select("confidence").collect()} == {"low"}


@pytest.mark.parametrize("step", [7, 10, 12, 13, 14, 15, 16, 25, 50, 100])
def test_boundaries_equal_labels(spark, step):
    df = wave(spark, [0.5] * (3 * step + 1))
    _, _, located = labelled(df, step)
    named = labels.assign(located)
    both = labels.compare(named, labels.boundaries(located, KEYS))
    got = both.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("phase_label") != F.col("boundary_phase")).alias("off")).first()
    assert got["n"] == 3 * step and got["off"] == 0


# --- annotators -------------------------------------------------------------------------------


def annotation(spark, marks, annotator="a", confidence="high", cycle="c1"):
    row = ("d", "d:1", "q", cycle, *marks, annotator, confidence, "")
    return spark.createDataFrame([row], S.HUMAN_BOUNDARIES_DDL)


def test_expansion_and_disagreement(spark):
    a = annotation(spark, (0, 2, 4, 6, 8))
    b = annotation(spark, (1, 3, 5, 7, 9), "b")
    rows = labels.expand(a, ["sequence_id"], S.HUMAN_MARKS).groupBy("label").count().collect()
    assert {r["label"]: r["count"] for r in rows} == dict.fromkeys(P, 2)
    got = agreement.boundary_disagreement(a.unionByName(b), "a", "b", 25.0).first()
    assert (got["mean_absolute_frames"], got["mean_absolute_milliseconds"]) == (1.0, 40.0)
    with pytest.raises(ValueError):
        agreement.boundary_disagreement(a, "a", "b", 0)
    with pytest.raises(Exception, match="No matching cycles"):
        agreement.boundary_disagreement(a, "a", "b", 25.0).collect()


def test_interval_agreement_equals_frame_pairs(spark):
    """Overlaps of intervals against one row per frame, with missing partners, empty intervals and open marks."""
    import random

    rng = random.Random(6)
    rows = []
    for cycle in range(60):
        start = 100 * cycle
        for who in ("a", "b"):
            marks = sorted(start + rng.choice([0, 2, 2, 5, 9, 14, 30]) for _ in range(5))
            if cycle % 11:
                rows.append(("s", str(cycle), *marks, who))
        if cycle % 13 == 0:
            rows = rows[:-1]
    rows.append(("s", "open", 1, 2, None, 9, 12, "a"))
    rows.append(("s", "open", 1, 3, 5, 8, 12, "b"))
    bounds = spark.createDataFrame(rows, "sequence_id string, cycle_id string, " + ", ".join(f"{c} bigint" for c in S.HUMAN_MARKS) + ", annotator_id string")
    pairs = agreement.pairs(labels.expand(bounds, ["sequence_id", "cycle_id", "annotator_id"], S.HUMAN_MARKS), "a", "b")
    got, want = agreement.interval_report(bounds, "a", "b").first(), agreement.report(pairs).first()
    assert got["frames"] == want["frames"] > 500
    assert got["raw_agreement"] == pytest.approx(want["raw_agreement"]) and got["weighted_kappa"] == pytest.approx(want["weighted_kappa"])
    none = agreement.interval_report(bounds.limit(0), "a", "b").first()
    assert (none["frames"], none["raw_agreement"], none["weighted_kappa"], none["status"]) == (0, None, None, "FAIL")


def test_kappa_ranks_present_labels(spark):
    def pair(rows):
        return agreement.report(spark.createDataFrame(rows, "label_a string, label_b string")).first()

    got = pair([(P[0], P[0]), (P[1], P[1]), (P[3], P[3])])
    assert (got["raw_agreement"], got["weighted_kappa"], got["status"]) == (1.0, 1.0, "PASS")
    # Labels 0, 1, 3 are ranks 0, 1, 2: observed weight 1, expected 15 / 3.
    got = pair([(P[0], P[0]), (P[1], P[3]), (P[3], P[3])])
    assert got["weighted_kappa"] == pytest.approx(0.8)
    constant = pair([(P[0], P[0])])
    assert constant["weighted_kappa"] is None and constant["status"] == "FAIL"
    with pytest.raises(Exception, match="Unknown phase"):
        pair([("run", P[0])])


@pytest.mark.parametrize(
    "marks, confidence, rule",
    [((0, 2, 4, 3, 8), "high", "boundaries strictly increasing"), ((0, 2, 4, 6, 8), "sure", "confidence in vocabulary")],
)
def test_boundary_rules(spark, marks, confidence, rule):
    assert report(rules.boundaries(annotation(spark, marks, confidence=confidence)))[rule] == 1
    assert not any(report(rules.boundaries(annotation(spark, (52, 58, 66, 74, 88)))).values())
    twice = annotation(spark, (0, 2, 4, 6, 8)).unionByName(annotation(spark, (0, 2, 4, 6, 8)))
    assert report(rules.boundaries(twice))["one record per annotator and cycle"] == 1
    text = annotation(spark, (0, 2, 4, 6, 8)).withColumn("swing_frame", F.lit("six"))
    assert report(rules.boundaries(text))["boundaries are integers"] == 1


def machine(spark, marks):
    return spark.createDataFrame([("d", "d:1", "q", "c", *marks, "low", "x", "v", "")], S.MACHINE_BOUNDARIES_DDL)


def test_audit_comparison_and_repair(spark):
    five = spark.createDataFrame([("q", i, P[3], f"s{i}") for i in range(5)], "sequence_id string, frame_index bigint, phase_label string, sample_id string")
    both = labels.compare(five, machine(spark, (0, 1, 2, 3, 4)))
    assert both.count() == 4 and both.filter("phase_label <> boundary_phase").count() == 3
    assert labels.overlaps(machine(spark, (0, 1, 2, 3, 4)).unionByName(machine(spark, (0, 1, 2, 3, 4)))).count() == 4
    frames = [("q", i, P[0 if i / 12 < 0.12 else 1 if i / 12 < 0.31 else 2 if i / 12 < 0.62 else 3]) for i in range(12)]
    twelve = spark.createDataFrame(frames, "sequence_id string, frame_index bigint, phase_label string")
    off = lambda b: labels.compare(twelve, b).filter("phase_label <> boundary_phase").count()
    saved = machine(spark, (0, 1, 4, 7, 12))
    fixed = labels.repair(saved)
    assert (off(saved), off(fixed), fixed.first()["changed"]) == (2, 0, True)


# --- scores -----------------------------------------------------------------------------------


def predictions(spark, wrong=()):
    rows = []
    for s in ("u", "v"):
        for i, p in enumerate(P):
            guess = P[(i + 1) % 4] if (s, i) in wrong else p
            rows.append((f"{s}{i}", "d", s, f"{s}:q", "fn00", i, p, guess, "x", "v", "medium"))
    return spark.createDataFrame(rows, S.PREDICTIONS_DDL)


def test_perfect_predictions(spark):
    df = predictions(spark)
    got = metrics.overall(df).first()
    assert (got["subject_macro_f1"], got["frame_macro_f1"], got["balanced_accuracy"], got["samples"]) == (1.0, 1.0, 1.0, 8)
    cells = metrics.confusion(df).collect()
    assert len(cells) == 16 and sum(r["n"] for r in cells) == 8
    assert metrics.transition_validity(df).first()["transition_validity"] == 1.0
    band = bootstrap.interval(metrics.subject_scores(df), iterations=100).first()
    assert band["lower"] == band["upper"] == 1.0
    with pytest.raises(ValueError):
        bootstrap.interval(metrics.subject_scores(df), iterations=99)


def test_absent_label_rules_differ(spark):
    df = predictions(spark).filter(f"y_true <> '{P[3]}'")
    got = metrics.overall(df).first()
    assert got["frame_macro_f1"] == 0.75 and got["balanced_accuracy"] == 1.0


def test_unknown_label_stops(spark):
    df = predictions(spark).withColumn("y_pred", F.lit("run"))
    with pytest.raises(Exception, match="Unknown phase label"):
        metrics.overall(df).collect()


def test_metric_intervals_equal_scored_resamples(spark):
    """Summed statistics against scoring every resample's own rows."""
    import hashlib
    import statistics

    rows = [(f"{s}{i}", s, P[(i * k) % 4], P[(i * k + (i % (k + 2) == 0)) % 4]) for k, s in enumerate("uvwxyz") for i in range(5 + 3 * k)]
    df = spark.createDataFrame(rows, "sample_id string, subject_id string, y_true string, y_pred string")
    got = {r["metric"]: r for r in bootstrap.metric_intervals(metrics.subject_counts(df), metrics.frame_metrics(), iterations=100).collect()}

    def scores(sample):
        f1, recall = [], []
        for p in P:
            t, g, h = (sum(n) for n in zip(*[(r[2] == p, r[3] == p, r[2] == r[3] == p) for r in sample]))
            f1.append(2 * h / (t + g) if t + g else 0.0)
            recall += [h / t] if t else []
        return statistics.mean(f1), statistics.mean(recall)

    names = sorted("uvwxyz", key=lambda s: hashlib.sha256(s.encode()).hexdigest())
    draws = []
    for b in range(100):
        words = hashlib.sha256(f"{S.SEED}:{b}:0".encode()).hexdigest()
        picked = [names[int(words[8 * k : 8 * k + 8], 16) % 6] for k in range(6)]
        draws.append(scores([r for name in picked for r in rows if r[1] == name]))
    cut = lambda values, q: sorted(values)[int(q)] + (q % 1) * (sorted(values)[int(q) + 1] - sorted(values)[int(q)])
    for k, name in enumerate(("frame_macro_f1", "balanced_accuracy")):
        values = [d[k] for d in draws]
        assert got[name]["estimate"] == pytest.approx(scores(rows)[k]) and got[name]["subjects"] == 6
        assert got[name]["lower"] == pytest.approx(cut(values, 99 * 0.025)) and got[name]["upper"] == pytest.approx(cut(values, 99 * 0.975))


def test_metric_intervals_of_means_equal_the_fast_ones(spark):
    df = predictions(spark, {("u", 1), ("u", 2)})
    scores = metrics.subject_scores(df)
    fast = bootstrap.interval(scores, iterations=100).first()
    stats = scores.select("subject_id", "macro_f1", F.lit(1).alias("n"))
    slow = bootstrap.metric_intervals(stats, {"mean": F.col("macro_f1") / F.col("n")}, iterations=100).first()
    for name in ("estimate", "lower", "upper"):
        assert slow[name] == pytest.approx(fast[name], abs=1e-12)
    one = df.filter("subject_id = 'u'")
    with pytest.raises(Exception, match="at least two subjects"):
        bootstrap.interval(metrics.subject_scores(one), iterations=100).collect()


def test_paired_difference(spark):
    good, bad = predictions(spark), predictions(spark, {("u", 0), ("v", 0)})
    got = bootstrap.paired(good, bad, iterations=100).first()
    assert got["estimate"] > 0 and got["probability_left_better"] == 1.0 and got["unpaired_rows"] == 0
    assert bootstrap.paired(good, good, iterations=100).first()["estimate"] == 0.0
    short = bad.filter("sample_id <> 'u0'")
    assert bootstrap.paired(good, short, iterations=100).first()["unpaired_rows"] == 1
    with pytest.raises(Exception, match="exactly the same"):
        bootstrap.paired_checked(good, short, iterations=100).collect()


def test_boundary_scores(spark):
    rows = [("q", i, t, p) for i, (t, p) in enumerate(zip((0, 1, 0, 0), (0.1, 0.9, 0.2, 0.1)))]
    df = spark.createDataFrame(rows, "sequence_id string, frame_index bigint, y_boundary int, boundary_probability double")
    assert metrics.boundary_classification(df).first()["f1"] == 1.0
    got = metrics.boundary_timing(df).first()
    assert (got["median_absolute_error_frames"], got["within_one_frame"]) == (0.0, 1.0)
    silent = metrics.boundary_timing(df.withColumn("boundary_probability", F.lit(0.1))).first()
    assert silent["matched_true_boundaries"] == 0 and silent["mean_absolute_error_frames"] is None


def test_boundary_flags_need_adjacent_frames(spark):
    rows = [("q", f, l) for f, l in ((1, "a"), (2, "b"), (3, "b"), (5, "c"), (6, "a"))]
    df = spark.createDataFrame(rows, "sequence_id string, frame_index bigint, y_true string")
    got = {r["frame_index"]: r["y_boundary"] for r in labels.boundary_flags(df).collect()}
    assert got == {1: 0, 2: 1, 3: 0, 5: 0, 6: 1}


# --- runs and baselines -----------------------------------------------------------------------


def registered(spark, drop=None):
    rows = []
    for v in ("a", "b"):
        for fold in range(5):
            for s in range(2):
                for i in range(4):
                    if (v, fold, s, i) == drop:
                        continue
                    rows.append((f"{fold}{s}{i}", "d", f"d:{fold}{s}", f"d:{fold}{s}:q", "fn00", i, P[i], P[i], "x", "v", "medium", v, fold))
    return spark.createDataFrame(rows, S.PREDICTIONS_DDL + ", variant string, fold int")


def test_registered_runs(spark):
    preds = registered(spark)
    listed = preds.select("variant", "fold").distinct()
    folds = [0, 1, 2, 3, 4]
    canonical = preds.filter("variant = 'a'")
    assert not any(r["violations"] for r in runs.registry(preds, listed, folds, 40, 10).collect())
    assert not any(r["violations"] for r in runs.coverage(preds, canonical, ["a", "b"]).collect())
    assert runs.identical_variants(preds).first()[0] == 1
    assert runs.model_summary(preds, 100).count() == 2
    assert runs.comparisons(preds, [("a", "b")], 100).first()["estimate"] == 0.0
    broken = registered(spark, ("b", 2, 1, 3))
    assert runs.identical_variants(broken).first()[0] == 2
    with pytest.raises(S.RuleViolation, match="canonical sample predicted"):
        rules.raise_if_any(runs.coverage(broken, canonical, ["a", "b"]))
    with pytest.raises(S.RuleViolation, match="sample count"):
        rules.raise_if_any(runs.registry(broken, listed, folds, 40, 10))


def test_best_epoch_takes_the_first_minimum(spark):
    rows = [("r", 1, 0.5), ("r", 2, 0.3), ("r", 3, 0.3), ("n", 1, None), ("m", 4, 0.1)]
    df = spark.createDataFrame(rows, "run_id string, epoch int, validation_loss double")
    best = runs.best_epoch(df)
    assert {r["run_id"]: r["best_epoch"] for r in best.collect()} == {"r": 2, "m": 4}
    assert runs.duration(best).first()["epochs"] == 3.0


def test_baselines(spark):
    train = spark.createDataFrame(
        [(P[3], 0.01), (P[0], 0.02), (P[3], 0.99), (P[0], None), (P[0], 0.5), (P[3], 0.5)], "target_label string, cycle_position double"
    )
    held = spark.createDataFrame([("a", 0.03), ("b", 0.999), ("c", None), ("d", 0.3)], "sample_id string, cycle_position double")
    assert {r["y_pred"] for r in baselines.majority(train, held).collect()} == {P[0]}
    got = {r["sample_id"]: r["y_pred"] for r in baselines.binned_prior(train, held).collect()}
    assert got == {"a": P[0], "b": P[3], "c": P[3], "d": P[3]}
    weight = {r["label"]: r["weight"] for r in baselines.class_weights(train).collect()}
    assert weight == {P[0]: 0.5, P[1]: 1.5, P[2]: 1.5, P[3]: 0.5}


def test_linear_svm_separates(spark):
    rows = [(i, [float(i % 3 == k) + 0.01 * (i % 5) for k in range(3)], i % 3) for i in range(60)]
    df = spark.createDataFrame(rows, "id int, v array<double>, label int")
    out = baselines.linear_svm(df.filter("id < 45"), df.filter("id >= 45"), "v", "label", 10)
    assert out.filter("prediction = label").count() == 15


# --- windows ----------------------------------------------------------------------------------


def test_segments_and_windows(spark):
    rows = [("q", f, f"{f}", P[0]) for f in (10, 2, 11, 1)]
    df = spark.createDataFrame(rows, "sequence_id string, frame_index bigint, id string, target_label string")
    got = {r["frame_index"]: r["segment"] for r in windows.segments(df, KEYS, "frame_index").collect()}
    assert got == {1: 1, 2: 1, 10: 2, 11: 2}
    five = spark.createDataFrame([("q", i, str(i)) for i in range(5)], "sequence_id string, frame_index bigint, id string")
    same = windows.context(five, KEYS, "frame_index", "id", 5, "repeated").collect()
    assert all(set(r["context"]) == {r["id"]} for r in same)
    plain = {r["id"]: r["context"] for r in windows.context(five, KEYS, "frame_index", "id", 5).collect()}
    mixed = windows.context(five, KEYS, "frame_index", "id", 5, "shuffled", 7).collect()
    for row in mixed:
        assert row["context"][2] == row["id"] and sorted(row["context"]) == sorted(plain[row["id"]])
        others = [plain[row["id"]][i] for i in (0, 1, 3, 4)]
        assert len(set(others)) == 1 or [row["context"][i] for i in (0, 1, 3, 4)] != others
    with pytest.raises(ValueError):
        windows.context(five, KEYS, "frame_index", "id", 4)


def test_uncovered_frames_stop(spark):
    scored = spark.createDataFrame([("a", 0.5, 0.5, 0.0, 0.0), ("a", 0.1, 0.9, 0.0, 0.0), ("b", 1.0, 0.0, 0.0, 0.0)], "s string, p0 double, p1 double, p2 double, p3 double")
    frames = lambda *names: spark.createDataFrame([(n,) for n in names], "s string")
    average = lambda expected: {r["s"]: (r["covered"], r["y_pred"]) for r in windows.overlap_average(scored, ["s"], ["p0", "p1", "p2", "p3"], expected=expected).collect()}
    assert average(frames("a", "b")) == average(None) == {"a": (2, P[1]), "b": (1, P[0])}
    with pytest.raises(Exception, match="No clip covers the frame c"):
        average(frames("a", "b", "c"))


def test_clips_cover_every_frame(spark):
    rows = [("q", i, P[0] if i < 3 else P[1]) for i in range(7)]
    df = spark.createDataFrame(rows, "sequence_id string, frame_index bigint, target_label string")
    clips = windows.clips(df, KEYS, "frame_index", "target_label", 5, 3)
    valid = clips.filter("valid")
    assert valid.select("frame_index").distinct().count() == 7
    assert valid.filter("is_boundary = 1").select("frame_index").distinct().first()[0] == 3
    assert {r[0] for r in clips.select("clip_start").distinct().collect()} == {0, 2}
    short = windows.clips(df.filter("frame_index < 2"), KEYS, "frame_index", "target_label", 5, 3).orderBy("slot").collect()
    assert [(r["frame_index"], r["valid"]) for r in short] == [(0, True), (1, True), (1, False), (1, False), (1, False)]
    got = baselines.boundary_weight(df).first()
    assert (got["boundaries"], got["boundary_weight"]) == (1, 6.0)


# --- selection --------------------------------------------------------------------------------


def pilot_frames(spark, drop=None, twice=None):
    rows = []
    for family in S.CONDITION_FAMILIES:
        for s in range(5):
            for f in range(4 + s):
                key = (family, s, f)
                if key != drop:
                    rows.append(("d", f"d:{family}{s}", f"d:{family}{s}:q", family + "01", "development", None, f))
                if key == twice:
                    rows.append(rows[-1])
    return spark.createDataFrame(
        rows, "dataset string, subject_id string, sequence_id string, condition string, split string, exclusion_reason string, frame_index bigint"
    )


def test_pilot_selection(spark):
    got = selection.pilot(pilot_frames(spark)).collect()
    assert len(got) == 12 and len({r["subject_id"] for r in got}) == 12
    assert sorted({r["condition_family"] for r in got}) == ["bag", "fast", "normal", "slow"]
    assert [r["blind_sequence_id"] for r in got] == [f"pilot_{i:03d}" for i in range(1, 13)]
    assert [tuple(r) for r in got] == [tuple(r) for r in selection.pilot(pilot_frames(spark).repartition(5)).collect()]
    first = got[0]["sequence_id"]
    again = selection.pilot(pilot_frames(spark), excluded=[first]).collect()
    assert first not in {r["sequence_id"] for r in again}
    rows = selection.template(selection.pilot(pilot_frames(spark)))
    assert rows.count() == 24 and list(rows.columns) == list(S.HUMAN_BOUNDARY_COLUMNS)
    with pytest.raises(Exception, match="Could not select"):
        selection.pilot(pilot_frames(spark), quota=6).collect()


def test_gaps_and_duplicate_frames_are_not_contiguous(spark):
    gap = selection.pilot(pilot_frames(spark, drop=("fn", 2, 3))).collect()
    assert "d:fn2:q" not in {r["sequence_id"] for r in gap}
    fake = selection.pilot(pilot_frames(spark, drop=("fn", 2, 3), twice=("fn", 2, 4))).collect()
    assert "d:fn2:q" not in {r["sequence_id"] for r in fake}


def test_next_batch_and_rules(spark):
    prior = spark.createDataFrame([("d:fn1",), ("d:fs1",)], "subject_id string")
    got = selection.next_batch(pilot_frames(spark), prior, 2).collect()
    assert len(got) == 8 and not {r["subject_id"] for r in got} & {"d:fn1", "d:fs1"}
    good = manifest(spark)
    assert not any(report(rules.batch(good, ["d"])).values())
    for change, rule in (
        ({"split": "test"}, "row is development"),
        ({"exclusion_reason": "x"}, "row is eligible"),
        ({"fold": -1}, "fold in range"),
        ({"sha256": "zz"}, "checksum is sha-256"),
    ):
        assert report(rules.batch(manifest(spark, **change), ["d"]))[rule] == 1
    assert report(rules.batch(manifest(spark, rows=[{}, {"frame_index": 2}]), ["d"]))["content unique"] == 1


# --- preparation, audit, lineage --------------------------------------------------------------


def test_confidence_and_sources(spark):
    df = manifest(spark).withColumns(
        {"provisional_label": F.lit(P[0]), "provisional_source": F.lit("x"), "provisional_version": F.lit("v"), "provisional_confidence": F.lit("low")}
    )
    with pytest.raises(S.RuleViolation, match="allow_provisional"):
        splits.eligible_labeled(df, "provisional")
    with pytest.raises(Exception, match="medium confidence"):
        splits.eligible_labeled(df, "provisional", True).collect()
    with pytest.raises(S.RuleViolation, match="allow_test"):
        splits.select_partition(df, "test")
    assert splits.prediction_table(splits.eligible_labeled(df).withColumn("y_pred", F.lit(P[0]))).columns == list(S.PREDICTION_COLUMNS)


def test_review_ladder(spark):
    rows = [("a", "x", "d", []), ("b", None, "other", ["i"]), ("c", None, "d", ["i"]), ("e", None, "d", []), ("f", None, "d", [])]
    df = spark.createDataFrame(rows, "id string, exclusion_reason string, dataset string, issues array<string>")
    state = audit.review_status(F.col("issues"), F.col("id") == "e", F.col("dataset") == "d")
    got = {r["id"]: r["s"].split("_")[0] for r in df.select("id", state.alias("s")).collect()}
    assert got == {"a": "source", "b": "incomplete", "c": "source", "e": "chat", "f": "unverified"}


def test_lineage_agreement_and_conflict(spark):
    source = spark.createDataFrame([("h", "x"), ("h", "y"), ("k", "x")], "sha256 string, label string")
    derived = spark.createDataFrame(
        [("c", "1", "h", "x"), ("c", "2", "k", "x"), ("c", "3", "z", "x")], "collection string, path string, sha256 string, label string"
    )
    got = lineage.summary(lineage.match(derived, source)).first().asDict()
    assert got == {
        "collection": "c", "files": 3, "exact_content_matches": 2, "unmatched_files": 1,
        "label_agreements": 2, "label_conflicts": 1, "result": "REVIEW",
    }


@pytest.mark.parametrize("under", [3, 65_536])
def test_relocation_by_longest_prefix(spark, monkeypatch, under):
    """Crowded folders, nested moves, a file's own move, names that begin alike, paths without a move."""
    monkeypatch.setattr(lineage, "UNDER", under)
    moves = {"a": "data/a", "a/b": "x", "a/b/c.txt": "single.txt", "q/r/s": "deep", "never": "used"}
    paths = [f"a/{k}.txt" for k in range(40)] + [f"a/b/{k}.txt" for k in range(9)] + ["a/b/c.txt", "ab/1.txt", "q/r/s", "q/r/s/t/u.txt", "q/r/1.txt", "a", "alone.txt"]

    def target(path):
        parts = path.split("/")
        for n in range(len(parts), 0, -1):
            head = "/".join(parts[:n])
            if head in moves:
                return moves[head] + path[len(head) :]
        return path

    before = spark.createDataFrame([(p, f"h{p}") for p in paths], "path string, sha256 string")
    there = [(target(p), "other" if k % 7 == 0 else f"h{p}") for k, p in enumerate(paths) if k % 5]
    after = spark.createDataFrame(there, "path string, sha256 string")
    table = lambda rows: spark.createDataFrame(rows, "source string, destination string")
    got = {r["path"]: (r["new_path"], r["result"]) for r in lineage.relocation(before, after, table([*moves.items(), ("a", "z")])).collect()}
    have = dict(there)
    state = lambda p, new: "missing" if new not in have else "verified" if have[new] == f"h{p}" else "changed"
    assert got == {p: (target(p), state(p, target(p))) for p in paths}
    same = lineage.relocation(before, after, table([])).collect()
    assert {r["path"]: r["new_path"] for r in same} == {p: p for p in paths}


def test_safe_components(spark):
    df = spark.createDataFrame([("a:b c",), ("..x..",), ("file.PNG",)], "v string")
    got = [r[0] for r in df.select(ids.safe_component(F.col("v"))).collect()]
    assert got == ["a_b_c", "x", "file.PNG"]
    assert [r[0] for r in df.select(ids.suffix(F.col("v"))).collect()] == [".png", ".png", ".png"]
    with pytest.raises(Exception, match="No safe path component"):
        spark.createDataFrame([("..",)], "v string").select(ids.safe_component(F.col("v"))).collect()


def test_digest_ignores_order_and_partitions(spark):
    df = spark.createDataFrame([(f"p{i}", f"h{i % 7}") for i in range(200)], "path string, sha256 string")
    one = ids.content_digest(df.repartition(1), "path", "sha256").first()
    many = ids.content_digest(df.orderBy(F.desc("path")).repartition(8), "path", "sha256").first()
    other = ids.content_digest(df.filter("path <> 'p3'"), "path", "sha256").first()
    assert one == many and one["digest"] != other["digest"]


def test_rows_without_subject_keep_their_place(spark):
    rows = split_input(spark)
    lost = rows.limit(1).withColumn("subject_id", F.lit(None).cast("string"))
    out = splits.make_subject_splits(rows.unionByName(lost))
    assert out.count() == rows.count() + 1


def test_near_audit_ignores_missing_hashes(spark):
    rows = spark.createDataFrame(
        [("a", "d", "q", None), ("b", "d", "q", None), ("a", "d", "q", "h"), ("b", "d", "q", "h")],
        "subject_id string, dataset string, sequence_id string, perceptual_hash string",
    )
    assert [r["perceptual_hash"] for r in dedupe.audit_near(rows).collect()] == ["h"]


def test_relative_paths_are_anchored(spark):
    from seqcurate.sources import files

    rows = [("file:/data/s1/data/f.png", "/data"), ("hdfs://nn:8020/data/s2/data/f.png", "/data"), ("s3a://data/x/data/f.png", "s3a://data")]
    got = [spark.createDataFrame([(p,)], "p string").select(files.relative(F.col("p"), root)).first()[0] for p, root in rows]
    assert got == ["s1/data/f.png", "s2/data/f.png", "x/data/f.png"]


def test_several_values_are_told_by_both_hashes(spark, monkeypatch):
    """A collision of one half does not hide a group of two values."""
    whole = F.xxhash64
    monkeypatch.setattr(rules.F, "xxhash64", lambda value, seed: F.when(seed == 0, F.lit(7).cast("bigint")).otherwise(whole(value, seed)))
    df = spark.createDataFrame([("g", "a"), ("g", "b"), ("h", "a"), ("h", None), ("i", None)], "k string, v string")
    assert report(rules.crossing(df, "one value", ["k"], "v")) == {"one value": 1}

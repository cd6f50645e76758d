"""Whole jobs: one function per user task. Tables in, tables (or a published release) out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import schemas as S
from .operators import (
    agreement,
    audit,
    baselines,
    blocks,
    bootstrap,
    catalogue,
    dedupe,
    joins,
    labels as L,
    metrics,
    rules,
    runs,
    selection,
    signal,
    splits,
)
from .functions import ids
from .session import stage
from .sources import files, publish, tables

KEYS = ["sequence_id"]


def check_archives(members: DataFrame, existing: DataFrame | None = None, expected: int | None = 153) -> DataFrame:
    """A listing of archive members, after the safety and count rules."""
    rules.raise_if_any(rules.archive_members(members, existing, expected))
    return members


def build_manifest(spark, named_root: str | None, path_root: str | None, workspace: str, features: DataFrame, names: dict | None = None) -> DataFrame:
    """Scan both kinds of frame folders, hash every file once, add its given features, number duplicates.

    ``features`` has one row per file: relative_path, perceptual_hash, feature, and whatever else later steps use
    (readable, foreground_pixels, hog). A path on either side twice stops the job; a file without a row keeps
    null features, which ``audit.image_issues`` reports.
    """
    names = {"named": "named_frames", "prefix": "named", "path": "path_frames", "view": None, **(names or {})}
    parts = []
    if named_root:
        parts.append(files.scan_named_frames(spark, named_root, workspace, names["named"], names["prefix"]))
    if path_root:
        parts.append(files.scan_path_frames(spark, path_root, workspace, names["path"], names["view"]))
    scanned = (parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])).drop("content")
    given = [c for c in features.columns if c != "relative_path"]
    described = stage(joins.one_to_one(scanned.drop(*given), features, "relative_path", "left"), "scan")
    return dedupe.assign_groups(described)


def manifest_rows(manifest: DataFrame) -> DataFrame:
    """Exactly the manifest columns, in the published order."""
    out = manifest.select(*S.MANIFEST_COLUMNS)
    return out.orderBy("dataset", "subject_id", "sequence_id", "frame_index", "relative_path")


def validate_data(manifest: DataFrame, frozen: bool = False) -> tuple[DataFrame, DataFrame]:
    return rules.manifest(manifest, frozen), catalogue.manifest_summary(manifest)


def make_splits(manifest: DataFrame, test_fraction=0.20, folds=5, seed: int = S.SEED) -> DataFrame:
    rules.raise_if_any(rules.manifest(manifest))
    out = stage(splits.make_subject_splits(manifest, test_fraction, folds, seed), "splits")
    rules.raise_if_any(rules.splits(out))
    return out


def audit_duplicates(manifest: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(summary, exact groups, near groups)."""
    rules.raise_if_any(rules.manifest(manifest))
    exact, near = dedupe.audit_exact(manifest), dedupe.audit_near(manifest)
    return dedupe.audit_summary(exact, near), exact, near


def annotation_report(bounds: DataFrame, fps: float, gate: float = S.KAPPA_GATE) -> DataFrame:
    """Agreement of exactly two annotators, with the gate status."""
    rules.raise_if_any(rules.boundaries(bounds))
    who = [row[0] for row in bounds.select("annotator_id").distinct().orderBy("annotator_id").limit(3).collect()]
    if len(who) != 2:
        raise S.RuleViolation("The agreement report needs exactly two annotators.")
    return blocks.one_row(agreement.interval_report(bounds, *who, gate=gate), agreement.boundary_disagreement(bounds, *who, fps))


def annotation_pilot(manifest: DataFrame, quota: int = 3, seed: int = S.SEED, **options) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(coordinator key, blank boundary template, digest of the selected frames)."""
    selected = stage(selection.pilot(manifest, quota, seed, **options), "pilot")
    frames = manifest.join(selected.select("sequence_id"), "sequence_id", "left_semi")
    return selected, selection.template(selected), ids.content_digest(frames, "sample_id", "sha256")


def label_sequences(frames: DataFrame, version: str, steps: dict | None = None) -> dict[str, DataFrame]:
    """Signal to labels, boundaries and QC for contiguous sequences (column ``feature``).

    All frames shape the signal; only eligible ones are labelled. Frames without a sequence or a number have no place in
    the signal and are left to the ledger.
    """
    order = "frame_index"
    frames, _ = blocks.route(frames, KEYS, order)
    table = selection.sequence_table(frames, F.lit("all"))
    rules.raise_if_any(rules.scalar(table, {"sequence is frame-contiguous": ~F.col("is_contiguous")}))
    default = S.by_prefix(F.col("condition"), steps or S.EXPECTED_STEP_FRAMES, S.DEFAULT_STEP_FRAMES)
    peaks = signal.contact_peaks(frames, KEYS, order, "feature")
    stats = stage(L.sequence_stats(frames, peaks, KEYS, order, "feature", default), "stats")
    located = stage(L.locate(frames, peaks, stats, KEYS, order), "located")
    eligible = F.col("exclusion_reason").isNull()
    named = L.assign(located.filter(eligible), order, version)
    identity = ["dataset", "subject_id", "condition", "split", "fold"]
    return {
        "frame_labels": named.select(*S.LABEL_COLUMNS),
        "cycle_boundaries": L.boundaries(located, KEYS, version=version).select(*S.MACHINE_BOUNDARY_COLUMNS),
        "sequence_qc": L.qc(frames, stats, KEYS, eligible, identity),
    }


def auto_annotate(spark, manifest: DataFrame, output: str, version: str, dataset: str, dataset_reasons: dict | None = None) -> dict:
    """Publish a label release for one dataset of a manifest with a ``feature`` column.

    Counts come from the writes; labelled and excluded rows have to add up to the manifest.
    """
    publish.refuse_taken(spark, output)
    made = label_sequences(manifest.filter(F.col("dataset") == dataset), version)
    named = stage(made["frame_labels"], "labels")
    unplaced = F.when(F.col("sequence_id").isNull() | F.col("frame_index").isNull(), "missing_frame_order")
    rows = manifest.drop("feature", "hog").withColumn("exclusion_reason", F.coalesce("exclusion_reason", unplaced))
    ledger = L.exclusion_ledger(rows, named, dataset_reasons or {}, "not_in_annotation_scope")
    out = {**made, "frame_labels": named, "excluded_samples": ledger, "split_summary": L.split_summary(named)}
    total, source = manifest.count(), ids.content_digest(manifest, "sample_id", "sha256").first()["digest"]

    def accept(contents: dict) -> dict:
        done = publish.accounted(contents, total, "frame_labels", "excluded_samples")
        labels = contents["frame_labels"]
        counts = {f"{kind}_counts": {v: labels.pop(f"{kind}:{v}") for v in values} for kind, values in publish.LABEL_KINDS.items()}
        counts = {kind: {v: n for v, n in found.items() if n} for kind, found in counts.items()}
        walks = spark.read.parquet(contents["sequence_qc"]["path"]).filter("eligible_frame_count > 0")  # one row a sequence
        return {
            "labeled_frames": labels["rows"], "excluded_frames": contents["excluded_samples"]["rows"], **done,
            **walks.agg(F.count(F.lit(1)).alias("sequences"), F.count_distinct("subject_id").alias("subjects")).first().asDict(),
            "complete_boundary_cycles": contents["cycle_boundaries"]["rows"], "source_digest": source, **counts,
        }

    return publish.publish(spark, output, out, {"annotation_version": version}, {"frame_labels": publish.labels_sink()}, accept)


def prepare_training_data(
    spark,
    manifest: DataFrame,
    named: DataFrame,
    output: str,
    datasets,
    confidence: str = "medium",
    folds: int = 5,
    expected: dict | None = None,
    files_found: DataFrame | None = None,
) -> dict:
    """Fold views of the labelled frames, checked and published; file rows are referenced, not copied.

    ``files_found`` (path, sha256) switches on the check that every source file is there unchanged.
    """
    publish.refuse_taken(spark, output)
    rules.refuse_empty(named, "label")
    rules.raise_if_any(rules.label_release(named, manifest, datasets))
    extra = ["phase_label", "confidence", "annotation_source", "annotation_version"]
    source = manifest.drop(*extra, "cycle_position")
    joined = stage(joins.one_to_one(source, named.select("sample_id", "cycle_position", *extra), "sample_id"), "joined")
    primary, withheld = splits.split_by_confidence(joined, confidence)
    if files_found is not None:
        wanted = primary.select("relative_path", "sha256")
        rules.raise_if_any(rules.files_match(wanted, files_found).filter("rule <> 'file is referenced'"))
    seen = primary.filter("split = 'development'").groupBy("fold").agg(F.count(F.lit(1))).limit(folds + 1).collect()
    if sorted(row["fold"] for row in seen) != list(range(folds)):
        raise S.RuleViolation("Development rows do not contain exactly the configured folds.")
    columns = ["fold_view", *S.MANIFEST_COLUMNS, *S.PREPARED_EXTRA]
    views = stage(splits.prepared_views(primary, folds).select(*columns), "views")
    rules.raise_if_any(rules.fold_views(views))
    counts = prepared_counts(views, withheld)
    for name, value in (expected or {}).items():
        if counts.get(name) != value:
            raise S.RuleViolation(f"Prepared-data count mismatch for {name}: expected {value}, got {counts.get(name)}")
    primary = stage(primary, "primary")
    files = primary.select(F.col("source_relative_path").alias("path"), "sha256").distinct()
    summary = {
        **counts,
        "confidence_policy": confidence,
        "view_digests": {r["view"]: r["digest"] for r in splits.view_digests(primary, folds).collect()},  # two views a fold, and test
        "source_manifest_digest": ids.content_digest(manifest, "sample_id", "sha256").first()["digest"],
        "source_labels_digest": publish.table_digest(named)["digest"],
    }
    made = {"views": views, "withheld": withheld, "folders": audit.folder_digests(files)}
    return publish.publish(spark, output, made, summary, {"views": publish.FOLD_VIEWS})


def prepared_counts(views: DataFrame, withheld: DataFrame) -> dict:
    """Registered totals: frames per role and fold, withheld rows, referenced copies."""
    rows = splits.fold_view_summary(views).collect()  # folds x roles
    out = {f"fold_{r['fold_view']}_{r['prepared_role']}_frames": r["frames"] for r in rows}
    first = [r for r in rows if r["fold_view"] == 0]
    out["development_frames"] = sum(r["frames"] for r in first if r["prepared_role"] != "test")
    out["test_frames"] = sum(r["frames"] for r in first if r["prepared_role"] == "test")
    out["withheld_low_confidence_frames"] = withheld.agg(F.count(F.lit(1))).first()[0]
    out["copied_files"] = sum(r["frames"] for r in rows if r["prepared_role"] != "test") + out["test_frames"]
    return out


def validate_prepared_data(spark, root: str, files_found: DataFrame | None = None) -> DataFrame:
    """Rules of a published fold release: its tables against the manifest, its views, and its files.

    ``files_found`` (path, sha256) are the files that the views refer to; folders are compared by digest and only
    those that differ file by file.
    """
    ready = publish.read_ready(spark, root)
    views, withheld, folders = (publish.read_table(spark, root, t) for t in ("views", "withheld", "folders"))
    counts = prepared_counts(views, withheld)
    off = [name for name, value in counts.items() if ready.get(name) != value]
    first = views.filter("fold_view = 0")
    digests = {r["view"]: r["digest"] for r in splits.view_digests(first).collect()}
    wrong = sum(ready["view_digests"].get(view) != digest for view, digest in digests.items()) + len(ready["view_digests"].keys() - digests.keys())
    extra = spark.createDataFrame([("counts as in the manifest", len(off)), ("view digests as in the manifest", wrong)], "rule string, violations bigint")
    report = rules.fold_views(views).groupBy("rule").agg(F.sum("violations").alias("violations"))
    parts = [report, extra, publish.verify(spark, root), rules.withheld(withheld, ready["withheld_low_confidence_frames"])]
    if files_found is not None:
        states = prepared_files(first, folders, files_found)
        parts.append(rules.scalar(states, {f"no referenced file {state}": F.col("state") == state for state in ("missing", "extra", "changed")}))
    return rules.merge(*parts)


def prepared_files(views: DataFrame, folders: DataFrame, files_found: DataFrame) -> DataFrame:
    """(path, state) of referenced files that are missing or changed, and of files that nothing refers to."""
    wanted = views.select(F.col("source_relative_path").alias("path"), "sha256").distinct()
    return audit.tree_difference(wanted, files_found.select("path", "sha256"), folders)


def train_baseline(
    prepared: DataFrame, model: str, fold: int = 0, mode: str = "validation", source: str = "adjudicated",
    allow_provisional: bool = False, allow_test: bool = False, bins: int = 20, features: str = "hog",
) -> DataFrame:
    """Prediction table of one baseline for one partition."""
    rows = splits.eligible_labeled(prepared, source, allow_provisional)
    train, evaluation = splits.select_partition(rows, mode, fold, allow_test=allow_test)
    if train.isEmpty() or evaluation.isEmpty():
        raise S.RuleViolation("The selected training or evaluation partition is empty.")
    if model == "majority":
        scored = baselines.majority(train, evaluation)
    elif model == "cycle_prior":
        scored = baselines.binned_prior(train, evaluation, bins)
    elif model == "linear_svm":
        number = lambda df: df.withColumn("_label", S.phase_index(F.col("target_label"), True))
        out = baselines.linear_svm(number(train), number(evaluation), features, "_label")
        scored = out.withColumn("y_pred", S.phase_name(F.col("prediction").cast("int")))
    else:
        raise ValueError(f"Unknown baseline: {model}")
    return splits.prediction_table(scored)


def evaluate(preds: DataFrame, iterations: int = bootstrap.ITERATIONS) -> dict[str, DataFrame]:
    """All score tables of one prediction table."""
    S.require_columns(preds, ["sample_id", "dataset", "subject_id", "condition", "y_true", "y_pred"], "prediction")
    rules.refuse_empty(preds, "prediction")
    rules.raise_if_any(rules.duplicated(preds, "sample_id unique", ["sample_id"]))
    out = {
        "overall": metrics.overall(preds),
        "per_class": metrics.per_class(preds),
        "confusion_matrix": metrics.confusion(preds),
        "by_condition": metrics.overall(preds, ["condition"]),
        "dataset_condition": metrics.overall(preds, ["dataset", "condition"]),
        "interval": bootstrap.interval(metrics.subject_scores(preds), iterations=iterations),
    }
    if {"sequence_id", "frame_index"} <= set(preds.columns):
        out["transition_validity"] = metrics.transition_validity(preds)
    if {"sequence_id", "frame_index", "y_boundary", "boundary_probability"} <= set(preds.columns):
        out["boundary_classification"] = metrics.boundary_classification(preds)
        out["boundary_timing"] = metrics.boundary_timing(preds)
    return out


def result_tables(spark, preds: DataFrame, output: str, iterations: int = bootstrap.ITERATIONS) -> dict:
    """Publish the score tables of one prediction table; repeated samples are refused by name."""
    publish.refuse_taken(spark, output)
    S.require_columns(preds, ["sample_id", "dataset", "condition", "subject_id", "y_true", "y_pred"], "prediction")
    held = rules.refuse_empty(stage(preds, "predictions"), "prediction")
    twice = rules.preview(held.groupBy("sample_id").agg(F.count(F.lit(1)).alias("_n")), F.col("_n") > 1)
    if twice:
        raise S.RuleViolation(f"Repeated samples, e.g. {', '.join(map(str, twice))}")
    band = bootstrap.interval(metrics.subject_scores(held), iterations=iterations).select("lower", "upper", "confidence", "iterations")
    out = {
        "overall": blocks.one_row(metrics.overall(held), band),
        "per_class": metrics.per_class(held),
        "dataset_condition": metrics.overall(held, ["dataset", "condition"]).drop("frame_macro_f1"),
        "confusion_matrix": metrics.confusion(held),
    }
    return publish.publish(spark, output, out, {"bootstrap_iterations": iterations, "prediction_digest": publish.table_digest(held)["digest"]})


def aggregate_results(
    spark, run_root: str, variants: dict, canonical: DataFrame, output: str, expected: dict, comparisons=(), iterations: int = bootstrap.ITERATIONS
) -> dict:
    """Check registered runs against the canonical table and publish their summaries."""
    publish.refuse_taken(spark, output)
    if iterations < 100:
        raise ValueError("Use at least 100 bootstrap iterations.")
    registry = tables.registry_table(spark, variants)
    preds, registered = tables.read_registered_runs(spark, run_root, registry)
    preds = rules.refuse_empty(stage(preds, "predictions"), "prediction")
    folds, samples, subjects = sorted(expected["folds"]), expected["samples"], expected["subjects"]
    rules.raise_if_any(rules.duplicated(canonical, "canonical sample unique", ["sample_id"]))
    rules.raise_if_any(runs.registry(preds, registered, folds, samples, subjects))
    rules.raise_if_any(runs.coverage(preds, canonical, list(variants)))
    if runs.identical_variants(preds).first()[0] != 1:
        raise S.RuleViolation("Variants do not contain the same sample identities and labels.")
    best = runs.best_epoch(tables.read_curves(spark, run_root, registry)).join(F.broadcast(registry), "run_id")  # a hand-written list
    out = {
        "predictions": preds,
        "best_epochs": best.select("variant", "fold", "run_id", "best_epoch"),
        "training_length": runs.duration(best, ["variant"]),
        "fold_summary": runs.fold_summary(preds, registry),
        "model_summary": runs.model_summary(preds, iterations),
    }
    if comparisons:
        unknown = {name for pair in comparisons for name in pair} - set(variants)
        if unknown:
            raise S.RuleViolation(f"Unknown comparison variants: {sorted(unknown)}")
        out["paired_comparisons"] = runs.comparisons(preds, list(comparisons), iterations)
    summary = {"variants": len(variants), "samples_per_variant": samples, "subjects_per_variant": subjects, "bootstrap_iterations": iterations}
    return publish.publish(spark, output, out, summary)


def audit_release(
    spark, manifest: DataFrame, named: DataFrame, bounds: DataFrame, reviewed: DataFrame, issues: DataFrame,
    output: str, datasets, allow_test: bool = False,
) -> dict:
    """Audit rows, disagreements and queues of a label release; nothing is relabelled."""
    if not allow_test:
        raise S.RuleViolation("The full audit needs allow_test=True.")
    in_scope = F.col("dataset").isin(list(datasets))
    eligible = manifest.filter(in_scope & F.col("exclusion_reason").isNull())
    rules.refuse_empty(named, "label")
    gap = audit.id_difference(eligible, named).first()
    if gap["only_left"] or gap["only_right"]:
        lost = rules.preview(eligible.join(named, "sample_id", "left_anti")) + rules.preview(named.join(eligible, "sample_id", "left_anti"))
        raise S.RuleViolation(f"Labels and eligible source frames differ, e.g. in {', '.join(lost)}")
    if not L.overlaps(bounds).isEmpty():
        raise S.RuleViolation("Overlapping saved boundary cycles.")
    compared = stage(L.compare(named, bounds).withColumn("disagrees", F.col("phase_label") != F.col("boundary_phase")), "compared")
    rows = stage(audit.records(manifest, named, compared, reviewed, issues, in_scope), "audit")
    out = {
        "frame_audit": rows,
        "boundary_disagreements": compared.filter("disagrees"),
        "sequence_review_queue": audit.review_queue(rows),
        "counts": audit.issue_counts(rows),
        "metadata_mismatches": audit.metadata_mismatches(named, manifest),
    }
    return publish.publish(spark, output, out, {"label_changes": 0}, {"frame_audit": publish.JSON_LINES})


def repair_boundaries(spark, named: DataFrame, bounds: DataFrame, output: str) -> dict:
    """Publish boundaries that agree with the unchanged labels on the same coverage."""
    fixed = stage(L.repair(bounds), "repaired")
    count = lambda b: L.compare(named, b).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("phase_label") != F.col("boundary_phase")).alias("off")
    ).first()
    before, after = count(bounds), count(fixed)
    if after["off"] or before["n"] != after["n"]:
        raise S.RuleViolation("Repaired boundaries do not match the labels and their coverage.")
    changed = fixed.filter("changed").agg(F.count(F.lit(1))).first()[0]
    summary = {"changed_boundary_records": changed, "compared_frames": after["n"], "frame_disagreements_before": before["off"]}
    return publish.publish(spark, output, {"boundaries": fixed}, summary)


def next_annotation_batch(metadata: DataFrame, prior: DataFrame, datasets, quota: int = 6, excluded=()) -> tuple[DataFrame, DataFrame]:
    """(selection, its frames), after the batch rules."""
    rules.raise_if_any(audit.role_overlap(metadata.filter(F.col("split").isNotNull())))
    selected = stage(selection.next_batch(metadata, prior, quota, dataset=list(datasets), excluded=excluded), "batch")
    eligible = metadata.filter((F.col("split") == "development") & F.col("exclusion_reason").isNull())
    frames = eligible.join(selected.select("sequence_id"), "sequence_id", "left_semi")
    rules.raise_if_any(rules.batch(frames, datasets))
    return selected, frames


def finalise_review(
    spark, records: DataFrame, key: DataFrame, frames: DataFrame, output: str, version: str, approved: dict, datasets, files_found: DataFrame | None = None
) -> dict:
    """Publish a reviewed set of cycles: all decisions, the accepted boundaries and their frames.

    ``records`` are the reviewed cycles (sequence, cycle, status, reason, confidence and the five marks), ``key`` names the
    sequence behind each blind id, ``approved`` has the numbers of cycles and frames that were confirmed. Accepted frames meet
    their source rows one to one, have to be eligible development rows, and unchanged where ``files_found`` is given.
    Nothing here becomes training data.
    """
    publish.refuse_taken(spark, output)
    rules.refuse_empty(records, "review")
    decisions = stage(selection.review_decisions(records, key.select("blind_sequence_id", "sequence_id", "subject_id", "dataset")), "decisions")
    rules.raise_if_any(rules.decided(decisions, key))
    kept = ["dataset", "subject_id", "sequence_id", F.col("cycle").alias("cycle_id"), *S.HUMAN_MARKS]
    accepted = decisions.filter("accepted").select(*kept, F.lit(f"reviewed:{version}").alias("annotator_id"), "confidence", F.col("reason").alias("notes"))
    expanded = L.expand(accepted, ["sequence_id", "cycle_id"], S.HUMAN_MARKS)
    source = frames.select("sequence_id", "frame_index", "sample_id", "dataset", "subject_id", "relative_path", "sha256", "split", "fold", "exclusion_reason")
    mine = source.join(accepted.select("sequence_id").distinct(), "sequence_id", "left_semi")
    joined = stage(joins.one_to_one(expanded, mine, ["sequence_id", "frame_index"], "left"), "accepted")
    rules.raise_if_any(rules.reviewed(accepted, approved["cycles"], joined, approved["frames"]))
    rules.raise_if_any(rules.batch(joined, datasets))
    if files_found is not None:
        rules.raise_if_any(rules.files_match(joined.select("relative_path", "sha256"), files_found).filter("rule <> 'file is referenced'"))
    marked = joined.drop("exclusion_reason").withColumns({"annotation_version": F.lit(version), "training_eligible": F.lit(False)})
    counts = {r["status"]: r["count"] for r in decisions.groupBy("status").count().collect()}  # three states
    summary = {"annotation_version": version, "decision_counts": counts, "accepted_subjects": joined.agg(F.count_distinct("subject_id")).first()[0]}
    return publish.publish(spark, output, {"decisions": decisions, "boundaries": accepted, "frames": marked}, summary)

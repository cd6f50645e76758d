"""One entry per operator, over whole given tables. Doubles are rounded to six places."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schemas as S
from ..functions import arrays, ids
from ..operators import (
    agreement,
    asof,
    audit,
    baselines,
    blocks,
    bootstrap,
    catalogue,
    dedupe,
    hamming,
    joins,
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
from ..session import stage
from . import surrogates as G

QUERIES: dict = {}
KEYS, ORDER = G.KEYS, G.ORDER


def query(function):
    def run(spark, sf_dir):
        return tidy(function(spark, sf_dir))

    run.__name__, run.__doc__ = function.__name__, function.__doc__
    QUERIES[function.__name__] = run
    return function


def tidy(df: DataFrame) -> DataFrame:
    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    return df.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in kinds.items()])


# --- catalogue, duplicates, splits --------------------------------------------------------


@query
def sample_ids(spark, d):
    return G.raw_manifest(spark, d).select("doc_id", "sample_id", "subject_id", "sequence_id")


@query
def safe_paths(spark, d):
    pages = G.table(spark, d, "pages")
    return pages.select(
        "page_id", ids.safe_component(F.col("url")).alias("component"), ids.suffix(F.col("url")).alias("suffix")
    )


@query
def manifest_summary(spark, d):
    return catalogue.manifest_summary(dedupe.mark_cross_subject(G.grouped(spark, d)))


@query
def manifest_condition_counts(spark, d):
    return catalogue.condition_counts(G.raw_manifest(spark, d))


@query
def duplicate_groups(spark, d):
    out = G.grouped(spark, d).filter("duplicate_group is not null")
    return out.select("sample_id", "sha256", "duplicate_group")


@query
def duplicate_audit_exact(spark, d):
    return dedupe.audit_exact(G.grouped(spark, d))


@query
def duplicate_audit_perceptual(spark, d):
    out = dedupe.audit_near(G.raw_manifest(spark, d))
    return out.orderBy(F.desc("subjects"), F.desc("samples"), "perceptual_hash")


@query
def near_hash_groups(spark, d):
    return hamming.near_groups(G.sketches(spark, d), "sketch")


@query
def near_hash_audit(spark, d):
    rows = G.sketches(spark, d)
    groups = hamming.near_groups(rows, "sketch").select("sketch", "near_group")
    return dedupe.audit_near(rows.join(groups, "sketch"), "near_group")


@query
def duplicate_audit_summary(spark, d):
    df = G.grouped(spark, d)
    return dedupe.audit_summary(dedupe.audit_exact(df), dedupe.audit_near(df))


@query
def cross_subject_exclusions(spark, d):
    out = dedupe.mark_cross_subject(G.grouped(spark, d)).filter("exclusion_reason is not null")
    return out.select("sample_id", "duplicate_group", "exclusion_reason")


@query
def subject_splits(spark, d):
    return splits.subject_table(G.raw_manifest(spark, d))


@query
def split_subject_counts(spark, d):
    return splits.subjects_per_split(G.manifest(spark, d))


@query
def manifest_rules(spark, d):
    return rules.manifest(G.manifest(spark, d), frozen=True)


@query
def split_rules(spark, d):
    return rules.splits(G.manifest(spark, d))


@query
def eligible_labeled(spark, d):
    out = splits.eligible_labeled(G.manifest(spark, d))
    return out.select("sample_id", "target_label", "target_label_source", "target_annotation_confidence")


@query
def train_validation_partition(spark, d):
    train, evaluation = splits.select_partition(G.manifest(spark, d), fold=0, evaluation_dataset="en")
    tag = lambda df, role: df.select("sample_id", F.lit(role).alias("role"))
    return tag(train, "train").unionByName(tag(evaluation, "validation"))


@query
def partition_leakage(spark, d):
    df = G.manifest(spark, d)
    content = df.filter("exclusion_reason is null")
    return audit.role_overlap(df).unionByName(audit.role_overlap(content, "sha256"))


@query
def temporal_segments(spark, d):
    df = G.raw_manifest(spark, d)
    return windows.segments(df, ["subject_id"], ORDER).select("sample_id", "subject_id", ORDER, "segment")


def unplaced(spark, d):
    """The manifest with some rows that have lost their subject or frame number."""
    at = F.col("doc_id")
    rows = G.raw_manifest(spark, d).select("doc_id", "sample_id", "subject_id", ORDER)
    return rows.withColumns({"subject_id": F.when(at % 53 != 4, F.col("subject_id")), ORDER: F.when(at % 71 != 5, F.col(ORDER))})


@query
def order_rejects(spark, d):
    return blocks.route(unplaced(spark, d), ["subject_id"], ORDER)[1].select("sample_id", "reject_reason")


@query
def order_reject_counts(spark, d):
    return blocks.reject_counts(unplaced(spark, d), ["subject_id"], ORDER)


@query
def routed_segments(spark, d):
    kept, _ = blocks.route(unplaced(spark, d), ["subject_id"], ORDER)
    return windows.segments(kept, ["subject_id"], ORDER).drop("doc_id")


# --- signal to labels ---------------------------------------------------------------------


@query
def interpolate_signal(spark, d):
    return signal.interpolate(G.signal_frames(spark, d), KEYS, ORDER, "feature").select(*KEYS, ORDER, "filled")


@query
def smooth_signal(spark, d):
    known = G.signal_frames(spark, d).select(*KEYS, ORDER, F.coalesce("feature", F.lit(0.0)).alias("level"))
    return signal.smooth(known, KEYS, ORDER, "level").select(*KEYS, ORDER, "smoothed")


@query
def peak_candidates(spark, d):
    filled = signal.interpolate(G.signal_frames(spark, d), KEYS, ORDER, "feature")
    return signal.peak_candidates(filled, KEYS, ORDER, "filled")


@query
def contact_peaks(spark, d):
    return G.peaks(spark, d)


@query
def contact_grid(spark, d):
    return labels.grid(G.located(spark, d), KEYS)


@query
def asof_grid(spark, d):
    frames = G.signal_frames(spark, d).select("sample_id", *KEYS, ORDER)
    points = labels.grid(G.all_labels(spark, d), KEYS).withColumnRenamed("grid_frame", ORDER)
    return asof.backward(frames, points, KEYS, ORDER)


@query
def frame_labels(spark, d):
    out = labels.assign(G.located(spark, d), ORDER, G.VERSION).filter("exclusion_reason is null")
    return out.select(*[c for c in S.LABEL_COLUMNS if c not in ("annotation_source", "annotation_version")])


@query
def cycle_boundaries(spark, d):
    return G.boundaries(spark, d)


@query
def sequence_qc(spark, d):
    identity = ["dataset", "subject_id", "condition", "split", "fold"]
    eligible = F.col("exclusion_reason").isNull()
    return labels.qc(G.signal_frames(spark, d), G.stats(spark, d), KEYS, eligible, identity)


@query
def exclusion_ledger(spark, d):
    source = G.signal_frames(spark, d)
    # Sequences of the second dataset count as outside the labelling scope.
    done = G.frame_labels(spark, d).filter("dataset = 'ds0' and confidence = 'medium'")
    out = labels.exclusion_ledger(source, done, {"ds1": "incomplete_temporal_sequence"}, "not_in_annotation_scope")
    return out.select("sample_id", "dataset", "provisional_exclusion_reason")


@query
def split_summary(spark, d):
    return labels.split_summary(G.frame_labels(spark, d))


@query
def label_counts(spark, d):
    return labels.value_counts(G.frame_labels(spark, d), "confidence", "phase_label", "split")


# --- preparation --------------------------------------------------------------------------


def prepared(spark, d):
    primary, _ = splits.split_by_confidence(G.frame_labels(spark, d))
    return splits.prepared_views(primary.withColumn("sha256", F.sha2("sample_id", 256)))


@query
def confidence_withheld(spark, d):
    _, withheld = splits.split_by_confidence(G.frame_labels(spark, d))
    return withheld.select("sample_id", "confidence", "prepared_exclusion_reason")


@query
def fold_views(spark, d):
    return prepared(spark, d).select("fold_view", "sample_id", "prepared_role", "relative_path")


@query
def fold_view_summary(spark, d):
    return splits.fold_view_summary(prepared(spark, d))


@query
def fold_view_rules(spark, d):
    used = ["fold_view", "prepared_role", "split", "fold", "sample_id", "subject_id", "relative_path", "sha256"]
    views = stage(prepared(spark, d).select(*used, "provisional_label", "provisional_confidence"), "views")
    expected = splits.fold_view_summary(views).select(
        "fold_view",
        "prepared_role",
        (F.col("frames") + F.when(F.col("fold_view") == 2, 1).otherwise(0)).alias("frames"),
    )
    return rules.fold_views(views, expected)


@query
def label_release_rules(spark, d):
    source = G.signal_frames(spark, d).withColumn("duplicate_group", F.lit(None).cast("string"))
    return rules.label_release(changed_labels(spark, d), source, ["ds0"])


def changed_labels(spark, d):
    """A label release with known faults, for the checks that count them."""
    out = G.all_labels(spark, d).drop("exclusion_reason")
    at = F.col("event_id")
    return out.withColumns(
        {
            "condition": F.when(F.pmod(at, F.lit(101)) == 0, "zz00").otherwise(F.col("condition")),
            "frame_index": F.when(F.pmod(at, F.lit(103)) == 0, F.col("frame_index") + 1).otherwise(F.col("frame_index")),
            "phase_label": F.when(F.pmod(at, F.lit(107)) == 0, "other").otherwise(F.col("phase_label")),
            "phase_index": F.when(F.pmod(at, F.lit(109)) == 0, 0).otherwise(F.col("phase_index")),
            "confidence": F.when(F.pmod(at, F.lit(113)) == 0, "high").otherwise(F.col("confidence")),
        }
    )


@query
def metadata_mismatches(spark, d):
    return audit.metadata_mismatches(changed_labels(spark, d), G.signal_frames(spark, d))


@query
def prepared_canonical_check(spark, d):
    return audit.prepared_check(prepared(spark, d), changed_labels(spark, d))


@query
def tree_digest(spark, d):
    return splits.prepared_digests(prepared(spark, d))


def folder_trees(spark, d):
    """Files in folders of fifty documents, and the same with some changed, gone and new."""
    name = lambda suffix: F.concat(F.lit("d"), F.floor(F.col("doc_id") / 50).cast("string"), F.lit("/"), F.col("doc_id").cast("string"), F.lit(suffix))
    rows = G.snapshot(spark, d, "all").select("doc_id", name(".txt").alias("path"), "sha256")
    at = F.col("doc_id")
    changed = F.when(F.pmod(at, F.lit(211)) == 5, F.sha2("sha256", 256)).otherwise(F.col("sha256"))
    found = rows.filter(F.pmod(at, F.lit(307)) != 7).select("doc_id", "path", changed.alias("sha256"))
    new = rows.filter(F.pmod(at, F.lit(401)) == 9).select("doc_id", name(".new").alias("path"), "sha256")
    return rows.drop("doc_id"), found.unionByName(new).drop("doc_id")


@query
def tree_difference(spark, d):
    return audit.tree_difference(*folder_trees(spark, d))


def keyed_sides(spark, d):
    """Documents and labels; each side repeats some ids and lacks others."""
    twice = lambda df, every, at: df.unionByName(df.filter(F.pmod("doc_id", F.lit(every)) == at))
    docs = G.table(spark, d, "documents").select("doc_id", "lang", "source").filter(F.pmod("doc_id", F.lit(89)) != 3)
    marks = G.table(spark, d, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"), F.max("toxic").alias("toxic"))
    return twice(docs, 97, 5), twice(marks, 101, 7)


@query
def one_to_one_rules(spark, d):
    return joins.one_to_one_report(*keyed_sides(spark, d), "doc_id")


@query
def one_to_one_join(spark, d):
    docs, marks = keyed_sides(spark, d)
    single = lambda df, by: df.dropDuplicates(["doc_id"]).filter(F.pmod("doc_id", F.lit(by)) != 1)
    return joins.one_to_one(single(docs, 17), single(marks, 19), "doc_id", "left")


@query
def archive_member_rules(spark, d):
    """Pages as members of archives by host; some names climb out of their folder, some are listed twice."""
    at = F.col("page_id")
    host = F.regexp_extract("url", "^[a-z]+://([^/]*)", 1)
    tail = F.regexp_replace("url", "^[a-z]+://[^/]*/*", "")
    name = F.when(at % 13 == 1, F.concat(F.lit("../"), tail)).when(at % 13 == 2, F.concat(F.lit("a/b/../../../"), tail)).when(at % 13 == 3, F.concat(F.lit("/"), tail))
    name = name.when(at % 13 == 4, F.concat(F.lit("a/../b/./"), tail)).when(at % 13 == 5, "same.html").when(at % 13 == 6, F.concat(F.lit("c:\\"), tail)).otherwise(tail)
    rows = G.table(spark, d, "pages").select("page_id", host.alias("archive"), name.alias("member"), F.length("html").cast("bigint").alias("size_bytes"))
    there = rows.filter(at % 3 == 0).select("archive", "member", (F.col("size_bytes") + F.when(at % 9 == 0, 1).otherwise(0)).alias("size_bytes"))
    return rules.archive_members(rows, there.groupBy("archive", "member").agg(F.max("size_bytes").alias("size_bytes")), 12)


@query
def coverage_difference(spark, d):
    eligible = G.signal_frames(spark, d).filter("exclusion_reason is null")
    primary, _ = splits.split_by_confidence(G.all_labels(spark, d))
    return audit.id_difference(eligible, primary)


# --- boundaries and annotators ------------------------------------------------------------


def saved_boundaries(spark, d):
    """Saved cycles of which every second one has a late second boundary."""
    late = F.when(F.pmod("contact_start_frame", F.lit(2)) == 0, 1).otherwise(0)
    fits = F.col("mid_stance_frame") + 1 < F.col("terminal_stance_frame")
    moved = F.col("mid_stance_frame") + F.when(fits, late).otherwise(0)
    return G.boundaries(spark, d).withColumn("mid_stance_frame", moved)


@query
def boundary_label_mismatch(spark, d):
    out = labels.compare(G.frame_labels(spark, d), saved_boundaries(spark, d))
    return out.filter("phase_label <> boundary_phase").select(
        "sample_id", "sequence_id", "frame_index", "cycle_id", "phase_label", "boundary_phase"
    )


@query
def boundary_repair(spark, d):
    out = labels.repair(saved_boundaries(spark, d))
    return out.select("sequence_id", "cycle_id", *S.MACHINE_MARKS, "changed")


@query
def expand_boundaries(spark, d):
    carried = ["sequence_id", "cycle_id", "annotator_id"]
    return labels.expand(G.human_boundaries(spark, d), carried, S.HUMAN_MARKS)


def annotator_rows(spark, d):
    expanded = labels.expand(G.human_boundaries(spark, d), ["sequence_id", "cycle_id", "annotator_id"], S.HUMAN_MARKS)
    return agreement.pairs(expanded, "annotator_1", "annotator_2")


@query
def annotator_pairs(spark, d):
    return annotator_rows(spark, d)


@query
def annotator_agreement(spark, d):
    return agreement.interval_report(G.human_boundaries(spark, d), "annotator_1", "annotator_2")


@query
def boundary_disagreement(spark, d):
    return agreement.boundary_disagreement(G.human_boundaries(spark, d), "annotator_1", "annotator_2", 25.0)


@query
def boundary_rules(spark, d):
    df = G.human_boundaries(spark, d)
    at = F.col("initial_contact_frame")
    broken = df.withColumns(
        {
            "swing_frame": F.when(F.pmod(at, F.lit(17)) == 0, "x").otherwise(
                F.when(F.pmod(at, F.lit(19)) == 0, F.col("mid_stance_frame")).otherwise(F.col("swing_frame")).cast("string")
            ),
            "confidence": F.when(F.pmod(at, F.lit(23)) == 0, "unsure").otherwise(F.col("confidence")),
            "annotator_id": F.when(F.pmod(at, F.lit(29)) == 0, "annotator_1").otherwise(F.col("annotator_id")),
        }
    )
    return rules.boundaries(broken)


# --- scores -------------------------------------------------------------------------------


def scored(spark, d):
    return labels.boundary_flags(G.predictions(spark, d))


@query
def boundary_flags(spark, d):
    return scored(spark, d).select("sample_id", "y_boundary")


@query
def predicted_boundary_peaks(spark, d):
    return metrics.predicted_boundaries(G.predictions(spark, d))


@query
def nearest_boundary_error(spark, d):
    return metrics.boundary_errors(scored(spark, d)).select(*KEYS, ORDER, "error_frames")


@query
def boundary_classification(spark, d):
    return metrics.boundary_classification(scored(spark, d))


@query
def boundary_timing(spark, d):
    return metrics.boundary_timing(scored(spark, d))


@query
def confusion_matrix(spark, d):
    return metrics.confusion(G.predictions(spark, d))


@query
def per_class_metrics(spark, d):
    return metrics.per_class(G.predictions(spark, d))


@query
def subject_scores(spark, d):
    return metrics.subject_scores(G.predictions(spark, d))


@query
def subject_macro_f1(spark, d):
    return metrics.overall(G.predictions(spark, d)).select("subjects", "subject_macro_f1")


@query
def overall_metrics(spark, d):
    return metrics.overall(G.predictions(spark, d))


@query
def condition_metrics(spark, d):
    return metrics.overall(G.predictions(spark, d), ["condition"]).select(
        "condition", "samples", "subjects", "subject_macro_f1"
    )


@query
def dataset_condition_metrics(spark, d):
    return metrics.overall(G.predictions(spark, d), ["dataset", "condition"]).drop("frame_macro_f1")


@query
def transition_validity(spark, d):
    return metrics.transition_validity(G.runs(spark, d), ["variant"])


@query
def bootstrap_interval(spark, d):
    return bootstrap.interval(metrics.subject_scores(G.predictions(spark, d)))


@query
def metric_intervals(spark, d):
    counts = metrics.subject_counts(G.predictions(spark, d), ["condition"])
    return bootstrap.metric_intervals(counts, metrics.frame_metrics(), ["condition"])


@query
def paired_difference(spark, d):
    return bootstrap.paired(G.predictions(spark, d, "base"), G.predictions(spark, d, "wide"))


# --- runs ---------------------------------------------------------------------------------


@query
def fold_summary(spark, d):
    return runs.fold_summary(G.runs(spark, d))


@query
def model_summary(spark, d):
    return runs.model_summary(G.runs(spark, d))


def faulty_runs(spark, d):
    """Runs where one variant lost some rows and moved others to a wrong fold."""
    at, wide = F.col("event_id"), F.col("variant") == "wide"
    fold = F.when(wide & (F.pmod(at, F.lit(211)) == 0), 4).otherwise(F.col("fold"))
    return G.runs(spark, d).filter(~(wide & (F.pmod(at, F.lit(199)) == 0))).withColumn("fold", fold)


def canonical(spark, d):
    return G.predictions(spark, d).filter("split = 'development'")


@query
def canonical_coverage(spark, d):
    return runs.coverage(faulty_runs(spark, d), canonical(spark, d), list(G.VARIANTS))


@query
def registry_rules(spark, d):
    preds = faulty_runs(spark, d)
    registered = preds.select("variant", "fold").distinct()
    want = canonical(spark, d).agg(F.count(F.lit(1)).alias("samples"), F.count_distinct("subject_id").alias("subjects")).first()
    return runs.registry(preds, registered, [0, 1, 2, 3, 4], want["samples"], want["subjects"])


@query
def variant_identity(spark, d):
    return runs.identical_variants(faulty_runs(spark, d))


def curves(spark, d):
    """Orders as runs and lines as epochs; repeated (run, epoch) pairs keep the lowest loss."""
    lines = G.table(spark, d, "lineitem")
    return lines.groupBy(F.col("l_orderkey").alias("run_id"), F.col("l_linenumber").alias("epoch")).agg(
        F.min("l_extendedprice").alias("validation_loss")
    )


@query
def best_epoch(spark, d):
    return runs.best_epoch(curves(spark, d))


@query
def training_duration(spark, d):
    return runs.duration(runs.best_epoch(curves(spark, d)))


# --- baselines ----------------------------------------------------------------------------


def fold_roles(spark, d):
    """Training and evaluation rows of all folds at once, keyed by fold view."""
    rows = canonical(spark, d).drop("y_pred").withColumn("target_label", F.col("y_true"))
    position = F.when(F.pmod("event_id", F.lit(31)) != 0, F.col("cycle_position"))
    views = splits.fold_views(rows.withColumn("cycle_position", position))
    return views.filter("prepared_role = 'train'"), views.filter("prepared_role = 'validation'")


@query
def majority_baseline(spark, d):
    train, evaluation = fold_roles(spark, d)
    return baselines.majority(train, evaluation, ["fold_view"]).select("fold_view", "sample_id", "y_pred")


@query
def binned_prior_baseline(spark, d):
    train, evaluation = fold_roles(spark, d)
    return baselines.binned_prior(train, evaluation, keys=["fold_view"]).select("fold_view", "sample_id", "y_pred")


@query
def baseline_oof_metrics(spark, d):
    train, evaluation = fold_roles(spark, d)
    keep = ["sample_id", "subject_id", "y_true", "y_pred"]
    first = baselines.majority(train, evaluation, ["fold_view"]).select(*keep, F.lit("majority").alias("variant"))
    second = baselines.binned_prior(train, evaluation, keys=["fold_view"]).select(
        *keep, F.lit("cycle_prior").alias("variant")
    )
    return metrics.overall(first.unionByName(second), ["variant"])


@query
def class_weights(spark, d):
    return baselines.class_weights(G.frame_labels(spark, d), "phase_label", root=True)


@query
def boundary_weight(spark, d):
    return baselines.boundary_weight(G.frame_labels(spark, d), "phase_label")


@query
def linear_svm_baseline(spark, d):
    rows = G.table(spark, d, "embeddings")
    train, held = rows.filter(F.pmod("vec_id", F.lit(5)) != 0), rows.filter(F.pmod("vec_id", F.lit(5)) == 0)
    out = baselines.linear_svm(train, held, "embedding", "label")
    return out.select("vec_id", "label", F.col("prediction").cast("int").alias("predicted"))


# --- windows, clips, probability tables ---------------------------------------------------


@query
def context_windows(spark, d):
    out = windows.context(G.turns(spark, d), KEYS, ORDER, "sample_id", 5)
    return out.select("sample_id", F.array_join("context", ",").alias("context"))


@query
def shuffled_windows(spark, d):
    out = windows.context(G.turns(spark, d), KEYS, ORDER, "sample_id", 5, "shuffled", 7)
    return out.select("sample_id", F.array_join("context", ",").alias("context"))


@query
def dense_clips(spark, d):
    rows = G.frame_labels(spark, d)
    return windows.clips(rows, KEYS, ORDER, "phase_label", 27, 9)


def probability_rows(spark, d):
    """Four probabilities per (clip slot), from row numbers; they sum to one."""
    rows = G.frame_labels(spark, d).select("sample_id", *KEYS, ORDER, "phase_label", "phase_index", "event_id")
    slots = windows.clips(rows, KEYS, ORDER, "phase_label", 27, 9).filter("valid")
    rows = rows.drop("phase_label").join(slots, [*KEYS, ORDER])
    raw = [F.pmod(F.col("event_id") * (3 + 2 * k) + F.col("clip_start") * 5 + k, F.lit(97)) + 1 for k in range(4)]
    rows = rows.withColumns({f"_w{k}": r for k, r in enumerate(raw)})
    total = F.col("_w0") + F.col("_w1") + F.col("_w2") + F.col("_w3")
    rows = rows.withColumns({f"p{k}": F.col(f"_w{k}") / total for k in range(4)})
    return rows.withColumn("boundary_probability", F.pmod(F.col("event_id") * 7 + F.col("clip_start"), F.lit(98)) / 100.0 + 0.01)


@query
def overlap_average(spark, d):
    rows = probability_rows(spark, d)
    expected = G.frame_labels(spark, d).select("sample_id")
    return windows.overlap_average(rows, ["sample_id"], ["p0", "p1", "p2", "p3"], ["boundary_probability"], expected)


@query
def sequence_scores(spark, d):
    rows = labels.boundary_flags(G.frame_labels(spark, d), label="phase_label")
    at = F.col("event_id")
    rows = rows.withColumns({f"_w{k}": F.pmod(at * (3 + 2 * k) + k, F.lit(97)) + 1 for k in range(4)})
    total = F.col("_w0") + F.col("_w1") + F.col("_w2") + F.col("_w3")
    rows = rows.withColumns({f"p{k}": F.col(f"_w{k}") / total for k in range(4)})
    rows = rows.withColumn("boundary_probability", F.pmod(at * 7, F.lit(98)) / 100.0 + 0.01)
    return windows.sequence_scores(
        rows,
        KEYS,
        ORDER,
        F.col("phase_index"),
        ["p0", "p1", "p2", "p3"],
        "y_boundary",
        "boundary_probability",
        {0: 1.5, 1: 1.0, 2: 0.75, 3: 0.5},
        4.0,
        ["condition"],
    )


# --- selection and audit ------------------------------------------------------------------


def selection_frames(spark, d):
    """All frames of a third of the sequences keep their exclusions, so these have gaps."""
    user = F.split("subject_id", ":")[1].cast("bigint")
    reason = F.when(F.pmod(user, F.lit(3)) == 0, F.col("exclusion_reason"))
    return G.signal_frames(spark, d).withColumn("exclusion_reason", reason)


@query
def sequence_table(spark, d):
    eligible = G.signal_frames(spark, d).filter("exclusion_reason is null")
    return selection.sequence_table(eligible, ids.condition_family(F.col("dataset"), F.col("condition")))


SELECTED = ["blind_sequence_id", "condition_family", "subject_id", "sequence_id", "frame_count", "length_distance"]


@query
def pilot_selection(spark, d):
    return selection.pilot(selection_frames(spark, d), quota=2).select(*SELECTED)


@query
def next_batch(spark, d):
    frames = selection_frames(spark, d)
    prior = frames.filter(F.pmod(F.split("subject_id", ":")[1].cast("bigint"), F.lit(7)) == 0).select("subject_id")
    return selection.next_batch(frames, prior, quota=2).select(*SELECTED)


@query
def boundary_template(spark, d):
    return selection.template(selection.pilot(selection_frames(spark, d), quota=2)).select(
        "dataset", "subject_id", "sequence_id", "cycle_id", "annotator_id", "notes"
    )


@query
def batch_rules(spark, d):
    return rules.batch(G.manifest(spark, d), ["en", "fr"], 4)


def audit_rows(spark, d):
    frames = G.signal_frames(spark, d)
    found = labels.compare(G.frame_labels(spark, d), saved_boundaries(spark, d))
    compared = found.select("sample_id", (F.col("phase_label") != F.col("boundary_phase")).alias("disagrees"))
    at = F.col("event_id")
    reviewed = frames.filter(F.pmod(at, F.lit(41)) == 0).select("sample_id", F.lit(S.PHASES[0]).alias("label"))
    first = F.when(F.pmod(at, F.lit(43)) == 0, "source_checksum_mismatch")
    second = F.when(F.pmod(at, F.lit(47)) == 0, "empty_foreground")
    issues = frames.select("sample_id", F.array_compact(F.array(first, second)).alias("image_issues"))
    issues = issues.filter(F.size("image_issues") > 0)
    return audit.records(frames, G.frame_labels(spark, d), compared, reviewed, issues, F.col("dataset") == "ds0")


@query
def audit_records(spark, d):
    return audit_rows(spark, d).select(
        "sample_id",
        F.array_join("image_issues", ",").alias("image_issues"),
        "original_provisional_label",
        "review_status",
        "boundary_comparison_available",
        "boundary_disagreement",
    )


@query
def review_status(spark, d):
    return audit.issue_counts(audit_rows(spark, d))


@query
def sequence_review_queue(spark, d):
    return audit.review_queue(audit_rows(spark, d))


# --- lineage ------------------------------------------------------------------------------


@query
def snapshot_drift(spark, d):
    return lineage.drift(G.snapshot(spark, d, "a"), G.snapshot(spark, d, "b"))


@query
def lineage_summary(spark, d):
    derived = G.snapshot(spark, d, "b").select(F.col("source").alias("collection"), "path", "sha256", F.col("lang").alias("label"))
    source = G.snapshot(spark, d, "a").select("sha256", F.when(F.pmod("doc_id", F.lit(9)) == 0, "xx").otherwise(F.col("lang")).alias("label"))
    return lineage.summary(lineage.match(derived, source))


@query
def duplicate_content_report(spark, d):
    rows = G.snapshot(spark, d, "all").select("path", "sha256", F.col("source").alias("label"))
    return lineage.duplicate_content(rows)


@query
def duplicate_storage(spark, d):
    return lineage.duplicate_storage(G.snapshot(spark, d, "all"))


@query
def inventory_rollup(spark, d):
    return lineage.rollup(G.inventory(spark, d), "category", "extension")


@query
def extraction_verification(spark, d):
    side = lambda s: G.snapshot(spark, d, s).select(F.col("source").alias("archive"), F.col("path").alias("member"), "sha256")
    return lineage.extraction(side("a"), side("b"))


@query
def collection_summary(spark, d):
    rows = G.snapshot(spark, d, "all").select(
        F.col("source").alias("collection"),
        F.concat("lang", F.lit(":"), "source").alias("subject_id"),
        F.col("lang").alias("label"),
        "size_bytes",
    )
    return lineage.collections(rows)


@query
def relocation_check(spark, d):
    before = G.snapshot(spark, d, "a")
    # The map: every source folder moves, and one document folder per language is listed apart.
    folders = before.select(F.col("source").alias("source"), F.concat(F.lit("data/"), "source").alias("destination")).distinct()
    files = before.filter(F.pmod("doc_id", F.lit(50)) == 3).select(
        F.col("path").alias("source"), F.concat(F.lit("kept/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("destination")
    )
    after = G.snapshot(spark, d, "b").select(
        F.when(F.pmod("doc_id", F.lit(50)) == 3, F.concat(F.lit("kept/"), F.col("doc_id").cast("string"), F.lit(".txt")))
        .otherwise(F.concat(F.lit("data/"), "path"))
        .alias("path"),
        "sha256",
    )
    return lineage.relocation(before, after, folders.unionByName(files))


# --- vectors ------------------------------------------------------------------------------


@query
def difference_hash(spark, d):
    rows = G.table(spark, d, "embeddings")
    return rows.select("vec_id", arrays.difference_hash(F.col("embedding"), 8).alias("hash"))


@query
def perceptual_hash(spark, d):
    rows = G.table(spark, d, "embeddings")
    return rows.select("vec_id", arrays.perceptual_hash(F.col("embedding"), 8).alias("hash"))


@query
def vector_motion(spark, d):
    rows = G.table(spark, d, "embeddings").withColumn("clip", F.floor(F.col("vec_id") / 8))
    out = arrays.motion(rows, ["clip"], "vec_id", "embedding", "motion")
    size = F.aggregate("motion", F.lit(0.0), lambda acc, x: acc + x.cast("double"))
    return out.select("vec_id", size.alias("motion_sum"), F.array_max("motion").cast("double").alias("motion_max"))

"""Vocabulary, table schemas and default parameters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The label vocabulary in cyclic order, its allowed successors, and the
# published default parameters. Results depend on these exact values.
PHASES = (
    "initial_contact_loading",
    "mid_stance",
    "terminal_stance_preswing",
    "swing",
)
ALLOWED_TRANSITIONS = {0: (0, 1), 1: (1, 2), 2: (2, 3), 3: (3, 0)}
PHASE_THRESHOLDS = (0.12, 0.31, 0.62)
CONDITION_FAMILIES = {"fn": "normal", "fs": "slow", "fq": "fast", "fb": "bag"}
EXPECTED_STEP_FRAMES = {"fn": 13, "fs": 16, "fq": 12, "fb": 13}
DEFAULT_STEP_FRAMES = 13
SEED = 20260827
CROSS_SUBJECT_REASON = "exact_duplicate_shared_across_subjects"
ANNOTATION_SOURCE = "ai_provisional_silhouette_timing"
BOUNDARY_NOTE = "Observable step-cycle timing; reference limb is not anatomically identified."
TEMPLATE_NOTE = "Add rows if the sequence contains more than one complete gait cycle."
KAPPA_GATE = 0.80
IMAGE_SUFFIXES = (".png", ".jpg", ".jpeg", ".bmp")


MANIFEST_DDL = (
    "sample_id string, dataset string, subject_id string, sequence_id string, condition string, "
    "view string, frame_index bigint, cycle_id string, cycle_position double, relative_path string, "
    "sha256 string, perceptual_hash string, duplicate_group string, legacy_label string, "
    "annotator_1_label string, annotator_2_label string, adjudicated_label string, "
    "annotation_confidence string, exclusion_reason string, split string, fold int"
)
LABELS_DDL = (
    "sample_id string, dataset string, subject_id string, sequence_id string, condition string, "
    "frame_index bigint, relative_path string, split string, fold int, phase_label string, "
    "phase_index int, cycle_position double, confidence string, annotation_source string, "
    "annotation_version string"
)
HUMAN_BOUNDARIES_DDL = (
    "dataset string, subject_id string, sequence_id string, cycle_id string, "
    "initial_contact_frame bigint, mid_stance_frame bigint, terminal_stance_frame bigint, "
    "swing_frame bigint, next_initial_contact_frame bigint, annotator_id string, "
    "confidence string, notes string"
)
MACHINE_BOUNDARIES_DDL = (
    "dataset string, subject_id string, sequence_id string, cycle_id string, "
    "contact_start_frame bigint, mid_stance_frame bigint, terminal_stance_frame bigint, "
    "swing_frame bigint, next_contact_frame bigint, confidence string, annotation_source string, "
    "annotation_version string, notes string"
)
PREDICTIONS_DDL = (
    "sample_id string, dataset string, subject_id string, sequence_id string, condition string, "
    "frame_index bigint, y_true string, y_pred string, label_source string, "
    "annotation_version string, annotation_confidence string"
)
REGISTRY_DDL = "variant string, role string, fold int, run_id string"
PREPARED_EXTRA = (
    "provisional_label",
    "provisional_confidence",
    "provisional_source",
    "provisional_version",
    "source_relative_path",
    "prepared_role",
)


def names(ddl: str) -> list[str]:
    return [part.strip().split(" ")[0] for part in ddl.split(",")]


MANIFEST_COLUMNS = tuple(names(MANIFEST_DDL))
LABEL_COLUMNS = tuple(names(LABELS_DDL))
HUMAN_BOUNDARY_COLUMNS = tuple(names(HUMAN_BOUNDARIES_DDL))
MACHINE_BOUNDARY_COLUMNS = tuple(names(MACHINE_BOUNDARIES_DDL))
PREDICTION_COLUMNS = tuple(names(PREDICTIONS_DDL))
HUMAN_MARKS = HUMAN_BOUNDARY_COLUMNS[4:9]
MACHINE_MARKS = MACHINE_BOUNDARY_COLUMNS[4:9]


class RuleViolation(ValueError):
    """A table breaks one of its declared rules."""


def require_columns(df: DataFrame, columns, table: str = "table") -> DataFrame:
    """Fail while the plan is being built when a column is absent."""
    missing = [name for name in columns if name not in df.columns]
    if missing:
        raise RuleViolation(f"Missing {table} columns: {', '.join(missing)}")
    return df


def phase_name(index: Column) -> Column:
    """Ordinal (0-based) to label; null stays null."""
    out = F.when(index == 0, PHASES[0])
    for position, phase in enumerate(PHASES[1:], 1):
        out = out.when(index == position, phase)
    return out


def phase_index(label: Column, strict: bool = False) -> Column:
    """Label to ordinal; unknown labels give null, or stop the job when strict."""
    out = F.when(label == PHASES[0], 0)
    for position, phase in enumerate(PHASES[1:], 1):
        out = out.when(label == phase, position)
    if strict:
        message = F.concat(F.lit("Unknown phase label: "), F.coalesce(label, F.lit("null")))
        out = out.otherwise(F.raise_error(message).cast("int"))
    return out


def transition_allowed(current: Column, following: Column) -> Column:
    """1 when the step between two ordinals stays in place or goes to the next label."""
    out = F.lit(False)
    for here, targets in ALLOWED_TRANSITIONS.items():
        out = out | ((current == here) & following.isin(*targets))
    return out


def by_prefix(condition: Column, values: dict, default=None) -> Column:
    """Look up a value by the first two letters of a condition code."""
    prefix = F.lower(F.substring(condition, 1, 2))
    out = None
    for key, value in values.items():
        out = F.when(prefix == key, value) if out is None else out.when(prefix == key, value)
    return out if default is None else out.otherwise(default)

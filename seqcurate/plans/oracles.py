"""Equivalent SQL for the registered queries, run by another engine on the same tables.

The statements follow the definitions directly (loops as lists, joins on ranges), not the
plans of the operators, so they check the closed forms and block arithmetic independently.
"""

from __future__ import annotations

from ..schemas import (
    ALLOWED_TRANSITIONS,
    ANNOTATION_SOURCE,
    BOUNDARY_NOTE,
    CROSS_SUBJECT_REASON,
    PHASES,
    TEMPLATE_NOTE,
)

PHASE_LIST = "[" + ", ".join(f"'{p}'" for p in PHASES) + "]"
CONDITIONS = "['fn00', 'fs00', 'fq00', 'fb00']"
CTES: dict[str, tuple[list[str], str]] = {}
ORACLES: dict[str, str] = {}


def cte(name: str, needs: str, sql: str) -> None:
    CTES[name] = (needs.split(), sql)


def _ordered(names: list[str], done: list[str]) -> list[str]:
    for name in names:
        if name not in done:
            _ordered(CTES[name][0], done)
            done.append(name)
    return done


def oracle(name: str, needs: str, sql: str) -> None:
    parts = [f"{c} AS ({CTES[c][1]})" for c in _ordered(needs.split(), [])]
    ORACLES[name] = (f"WITH {', '.join(parts)} " if parts else "") + sql


def index_of(column: str) -> str:
    return f"(list_position({PHASE_LIST}, {column}) - 1)"


# --- manifest -----------------------------------------------------------------------------

cte(
    "raw",
    "",
    f"""
    SELECT d.doc_id,
      substr(sha256(d.lang || ':' || d.source || '/' || d.doc_id || '.txt'), 1, 20) AS sample_id,
      d.lang AS dataset, d.lang || ':' || d.source AS subject_id,
      d.lang || ':' || d.source || ':v' || (d.doc_id % 4) AS sequence_id,
      {CONDITIONS}[1 + d.doc_id % 4] AS condition, 'v' || (d.doc_id % 4) AS view,
      d.doc_id AS frame_index, d.source || '/' || d.doc_id || '.txt' AS relative_path,
      sha256(d.text) AS sha256,
      substr(sha256(regexp_replace(lower(d.text), '[^a-z]', '', 'g')), 1, 16) AS perceptual_hash,
      {PHASE_LIST}[1 + l.quality + 2 * l.toxic] AS adjudicated_label,
      CASE WHEN d.doc_id % 10 = 0 THEN 'low' ELSE 'medium' END AS annotation_confidence,
      CASE WHEN d.doc_id % 37 = 0 THEN 'unreadable' END AS own_reason, d.n_chars AS size_bytes
    FROM documents d LEFT JOIN labels l USING (doc_id)
    """,
)
cte(
    "dups",
    "raw",
    """SELECT sha256, 'exact-' || lpad(CAST(row_number() OVER (ORDER BY sha256) AS VARCHAR), 6, '0') AS duplicate_group
    FROM raw GROUP BY sha256 HAVING count(*) > 1""",
)
cte("grp", "raw dups", "SELECT raw.*, dups.duplicate_group FROM raw LEFT JOIN dups USING (sha256)")
cte(
    "marked",
    "grp",
    f"""SELECT grp.*, coalesce(own_reason, CASE WHEN s.duplicate_group IS NOT NULL THEN '{CROSS_SUBJECT_REASON}' END)
      AS exclusion_reason
    FROM grp LEFT JOIN (SELECT duplicate_group FROM grp WHERE duplicate_group IS NOT NULL
      GROUP BY 1 HAVING count(DISTINCT subject_id) > 1) s ON grp.duplicate_group = s.duplicate_group""",
)


def split_sql(source: str) -> str:
    return f"""
    SELECT dataset, subject_id, CASE WHEN pos < held THEN 'test' ELSE 'development' END AS split,
      CAST(CASE WHEN pos < held THEN -1 ELSE (pos - held) % 5 END AS INTEGER) AS fold
    FROM (SELECT dataset, subject_id,
        row_number() OVER (PARTITION BY dataset ORDER BY sha256('20260827:' || subject_id)) - 1 AS pos,
        greatest(1, CAST(ceil(count(*) OVER (PARTITION BY dataset) * CAST(0.2 AS DOUBLE)) AS BIGINT)) AS held
      FROM (SELECT DISTINCT dataset, subject_id FROM {source}) u) r
    """


cte("msplit", "raw", split_sql("raw"))
cte("man", "marked msplit", "SELECT marked.*, msplit.split, msplit.fold FROM marked JOIN msplit USING (dataset, subject_id)")

oracle("sample_ids", "raw", "SELECT doc_id, sample_id, subject_id, sequence_id FROM raw")
oracle(
    "safe_paths",
    "",
    r"""SELECT page_id,
      regexp_replace(regexp_replace(url, '[^A-Za-z0-9._-]+', '_', 'g'), '^[._]+|[._]+$', '', 'g') AS component,
      CASE WHEN sfx = '' THEN '.png' ELSE sfx END AS suffix
    FROM (SELECT page_id, url, lower(regexp_extract(url, '[^/.][^/]*(\.[^./]+)$', 1)) AS sfx FROM pages) p""",
)
oracle(
    "manifest_summary",
    "marked",
    """SELECT count(*) AS samples, count(DISTINCT subject_id) AS subjects, count(DISTINCT sequence_id) AS sequences,
      count(DISTINCT duplicate_group) AS exact_duplicate_groups, count(adjudicated_label) AS adjudicated_samples,
      count(exclusion_reason) AS excluded_samples FROM marked""",
)
oracle(
    "manifest_condition_counts",
    "raw",
    """SELECT 'all' AS level, NULL AS dataset, NULL AS condition, count(*) AS samples FROM raw
    UNION ALL SELECT 'dataset', dataset, NULL, count(*) FROM raw GROUP BY dataset
    UNION ALL SELECT 'condition', dataset, condition, count(*) FROM raw GROUP BY dataset, condition""",
)
oracle("duplicate_groups", "grp", "SELECT sample_id, sha256, duplicate_group FROM grp WHERE duplicate_group IS NOT NULL")
AUDIT = "count(*) AS samples, count(DISTINCT subject_id) AS subjects, count(DISTINCT dataset) AS datasets"
cte("exact_audit", "grp", f"SELECT duplicate_group, {AUDIT} FROM grp WHERE duplicate_group IS NOT NULL GROUP BY 1")
cte(
    "near_audit",
    "raw",
    f"""SELECT perceptual_hash, {AUDIT}, count(DISTINCT sequence_id) AS sequences FROM raw GROUP BY 1
    HAVING count(*) > 1""",
)
oracle("duplicate_audit_exact", "exact_audit", "SELECT * FROM exact_audit")
oracle(
    "duplicate_audit_perceptual",
    "near_audit",
    "SELECT * FROM near_audit ORDER BY subjects DESC, samples DESC, perceptual_hash",
)
oracle(
    "duplicate_audit_summary",
    "exact_audit near_audit",
    """SELECT * FROM (SELECT count(*) AS exact_groups, CAST(coalesce(sum(samples), 0) AS BIGINT) AS exact_members,
        count(*) FILTER (WHERE subjects > 1) AS exact_cross_subject_groups FROM exact_audit) a,
      (SELECT count(*) AS perceptual_collision_groups,
        CAST(coalesce(sum(samples), 0) AS BIGINT) AS perceptual_collision_members,
        count(*) FILTER (WHERE subjects > 1) AS perceptual_cross_subject_groups,
        count(*) FILTER (WHERE datasets > 1) AS perceptual_cross_dataset_groups FROM near_audit) b""",
)
oracle(
    "cross_subject_exclusions",
    "marked",
    "SELECT sample_id, duplicate_group, exclusion_reason FROM marked WHERE exclusion_reason IS NOT NULL",
)
oracle("subject_splits", "msplit", "SELECT * FROM msplit")
oracle(
    "split_subject_counts",
    "man",
    "SELECT dataset, split, count(DISTINCT subject_id) AS subjects FROM man GROUP BY 1, 2",
)


def union(rules: list[tuple[str, str]]) -> str:
    return " UNION ALL ".join(f"SELECT '{name}' AS rule, CAST(({sql}) AS BIGINT) AS violations" for name, sql in rules)


def crossing(source: str, group: str, value: str, where: str = "true") -> str:
    return f"SELECT count(*) FROM (SELECT {group} FROM {source} WHERE {where} GROUP BY {group} HAVING count(DISTINCT {value}) > 1)"


def repeated(source: str, columns: str) -> str:
    return f"SELECT count(*) FROM (SELECT {columns} FROM {source} GROUP BY {columns} HAVING count(*) > 1)"


def broken(source: str, condition: str) -> str:
    return f"SELECT count(*) FROM {source} WHERE {condition}"


DUP_SPLIT = crossing("man", "duplicate_group", "split", "exclusion_reason IS NULL AND duplicate_group IS NOT NULL")
oracle(
    "manifest_rules",
    "man",
    union(
        [("manifest not empty", "SELECT CASE WHEN count(*) = 0 THEN 1 ELSE 0 END FROM man")]
        + [
            (f"{c} present", broken("man", f"{c} IS NULL OR trim({c}) = ''"))
            for c in ("sample_id", "dataset", "subject_id", "sequence_id", "relative_path", "sha256")
        ]
        + [
            ("subject_id namespaced", broken("man", "NOT contains(subject_id, ':')")),
            ("adjudicated_label in vocabulary", broken("man", f"NOT list_contains({PHASE_LIST}, adjudicated_label)")),
            ("frozen rows labelled", broken("man", "exclusion_reason IS NULL AND adjudicated_label IS NULL")),
            ("frozen rows split", broken("man", "exclusion_reason IS NULL AND split IS NULL")),
            ("sample_id unique", repeated("man", "sample_id")),
            ("subject in one split", crossing("man", "subject_id", "split")),
            ("duplicate group in one split", DUP_SPLIT),
            ("one label per content", crossing("man", "sha256", "adjudicated_label")),
        ]
    ),
)
oracle(
    "split_rules",
    "man",
    union(
        [
            ("row has a split", broken("man", "split IS NULL")),
            ("subject in one split", crossing("man", "subject_id", "split")),
            ("duplicate group in one split", DUP_SPLIT),
        ]
    ),
)
oracle(
    "eligible_labeled",
    "man",
    """SELECT sample_id, adjudicated_label AS target_label, 'human_adjudicated' AS target_label_source,
      annotation_confidence AS target_annotation_confidence
    FROM man WHERE adjudicated_label IS NOT NULL AND exclusion_reason IS NULL""",
)
oracle(
    "train_validation_partition",
    "man",
    """SELECT sample_id, CASE WHEN fold = 0 THEN 'validation' ELSE 'train' END AS role FROM man
    WHERE split = 'development' AND (fold <> 0 OR dataset = 'en')""",
)
oracle(
    "partition_leakage",
    "man",
    union(
        [
            ("subject_id in one split", crossing("man", "subject_id", "split")),
            ("sha256 in one split", crossing("man", "sha256", "split", "exclusion_reason IS NULL")),
        ]
    ),
)
oracle(
    "temporal_segments",
    "raw",
    """SELECT sample_id, subject_id, frame_index,
      CAST(sum(brk) OVER (PARTITION BY subject_id ORDER BY frame_index) AS BIGINT) AS segment
    FROM (SELECT *, CASE WHEN lag(frame_index) OVER (PARTITION BY subject_id ORDER BY frame_index) = frame_index - 1
      THEN 0 ELSE 1 END AS brk FROM raw) r""",
)

cte(
    "lossy",
    "raw",
    """SELECT sample_id, CASE WHEN doc_id % 53 <> 4 THEN subject_id END AS subject_id, CASE WHEN doc_id % 71 <> 5 THEN frame_index END AS frame_index FROM raw""",
)
cte("lost", "lossy", "SELECT sample_id, CASE WHEN subject_id IS NULL THEN 'no subject_id' ELSE 'no frame_index' END AS reject_reason FROM lossy WHERE subject_id IS NULL OR frame_index IS NULL")
oracle("order_rejects", "lost", "SELECT * FROM lost")
oracle("order_reject_counts", "lost", "SELECT reject_reason, count(*) AS rows FROM lost GROUP BY 1")
oracle(
    "routed_segments",
    "lossy",
    """SELECT sample_id, subject_id, frame_index, CAST(sum(brk) OVER (PARTITION BY subject_id ORDER BY frame_index) AS BIGINT) AS segment
    FROM (SELECT *, CASE WHEN lag(frame_index) OVER (PARTITION BY subject_id ORDER BY frame_index) = frame_index - 1 THEN 0 ELSE 1 END AS brk
      FROM lossy WHERE subject_id IS NOT NULL AND frame_index IS NOT NULL) r""",
)

# --- signal -------------------------------------------------------------------------------

cte(
    "sig0",
    "",
    f"""SELECT event_id, user_id, 's' || event_id AS sample_id, 'ds' || (user_id % 2) AS dataset, 'ev:' || user_id AS subject_id,
      'ev:' || user_id || ':walk' AS sequence_id, {CONDITIONS}[1 + user_id % 4] AS condition,
      row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS frame_index,
      'frames/' || event_id || '.PNG' AS relative_path,
      CASE WHEN event_id % 97 = 0 THEN 'sensor_dropout' END AS exclusion_reason,
      CASE WHEN user_id % 10 = 0 THEN CAST(0.5 AS DOUBLE) WHEN event_id % 11 = 0 THEN NULL
        ELSE value / CAST(100.0 AS DOUBLE) END AS feature FROM events""",
)
cte("ssplit", "sig0", split_sql("sig0"))
cte("sig", "sig0 ssplit", "SELECT sig0.*, ssplit.split, ssplit.fold FROM sig0 JOIN ssplit USING (dataset, subject_id)")
cte(
    "filled",
    "sig",
    """SELECT sequence_id, frame_index, coalesce(feature,
        CASE WHEN nx > px THEN (nv - pv) / (nx - px) * (frame_index - px) + pv END, pv, nv, CAST(0 AS DOUBLE)) AS filled
    FROM (SELECT sequence_id, frame_index, feature,
        last_value(feature IGNORE NULLS) OVER a AS pv, last_value(x IGNORE NULLS) OVER a AS px,
        first_value(feature IGNORE NULLS) OVER b AS nv, first_value(x IGNORE NULLS) OVER b AS nx
      FROM (SELECT *, CASE WHEN feature IS NOT NULL THEN frame_index END AS x FROM sig) s
      WINDOW a AS (PARTITION BY sequence_id ORDER BY frame_index ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
        b AS (PARTITION BY sequence_id ORDER BY frame_index ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) f""",
)


def smooth_sql(source: str, value: str) -> str:
    return f"""SELECT sequence_id, frame_index, CASE WHEN count(*) OVER (PARTITION BY sequence_id) < 3 THEN {value}
      ELSE (coalesce(lag({value}) OVER w, {value}) + {value} + coalesce(lead({value}) OVER w, {value}))
        / CAST(3 AS DOUBLE) END AS smoothed
    FROM {source} WINDOW w AS (PARTITION BY sequence_id ORDER BY frame_index)"""


cte("level", "sig", "SELECT sequence_id, frame_index, coalesce(feature, CAST(0 AS DOUBLE)) AS level FROM sig")
cte("smooth", "filled", smooth_sql("filled", "filled"))
cte(
    "cand",
    "smooth",
    """SELECT sequence_id, frame_index, smoothed - greatest(lm, rm) AS prominence, smoothed AS signal
    FROM (SELECT *, lag(smoothed) OVER w AS l, lead(smoothed) OVER w AS r,
        min(smoothed) OVER (PARTITION BY sequence_id ORDER BY frame_index ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS lm,
        min(smoothed) OVER (PARTITION BY sequence_id ORDER BY frame_index ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING) AS rm
      FROM smooth WINDOW w AS (PARTITION BY sequence_id ORDER BY frame_index)) s
    WHERE l IS NOT NULL AND r IS NOT NULL AND smoothed >= l AND smoothed >= r
      AND smoothed - greatest(lm, rm) >= CAST(0.015 AS DOUBLE)""",
)
cte(
    "kept",
    "cand",
    """SELECT sequence_id, unnest(list_reduce(
        list([frame_index] ORDER BY prominence DESC, signal DESC, frame_index DESC),
        lambda acc, x: CASE WHEN len(list_filter(acc, lambda y: abs(y - x[1]) < 7)) = 0
          THEN list_concat(acc, x) ELSE acc END)) AS frame_index
    FROM cand GROUP BY sequence_id""",
)
cte("peaks", "kept cand", "SELECT cand.* FROM cand JOIN kept USING (sequence_id, frame_index)")
cte(
    "steps",
    "peaks",
    """SELECT sequence_id, count(*) AS n_peaks, min(frame_index) AS p0, max(frame_index) AS pn,
      quantile_cont(gap, 0.5) AS med, stddev_pop(gap) AS sd
    FROM (SELECT *, CAST(frame_index - lag(frame_index) OVER (PARTITION BY sequence_id ORDER BY frame_index) AS DOUBLE)
      AS gap FROM peaks) p GROUP BY sequence_id""",
)
cte(
    "seqs",
    "sig steps",
    """SELECT s.*, n_peaks, CASE WHEN found THEN med ELSE CAST(expected AS DOUBLE) END AS median_step,
      CASE WHEN found THEN sd / med ELSE CAST(1 AS DOUBLE) END AS cv,
      CASE WHEN found THEN 'detected_contacts' ELSE 'condition_cycle_prior' END AS method,
      CASE WHEN found AND sd / med <= CAST(0.30 AS DOUBLE) THEN 'medium' ELSE 'low' END AS confidence,
      greatest(7, CAST(round_even(CASE WHEN found THEN med ELSE CAST(expected AS DOUBLE) END, 0) AS BIGINT)) AS step,
      coalesce(p0, first_frame) AS g0, CASE WHEN found THEN pn ELSE coalesce(p0, first_frame) END AS gn
    FROM (SELECT sequence_id, any_value(dataset) AS dataset, any_value(subject_id) AS subject_id,
        any_value(condition) AS condition, any_value(split) AS split, any_value(fold) AS fold,
        count(*) AS frame_count, min(frame_index) AS first_frame, max(frame_index) AS last_frame,
        count(*) - count(feature) AS missing_feature_frames, count(*) - count(exclusion_reason) AS eligible_frame_count,
        CASE substr(any_value(condition), 1, 2) WHEN 'fn' THEN 13 WHEN 'fs' THEN 16 WHEN 'fq' THEN 12 ELSE 13 END AS expected
      FROM sig GROUP BY sequence_id) s
    LEFT JOIN (SELECT *, n_peaks >= 3 AS f3 FROM steps) t USING (sequence_id),
    LATERAL (SELECT coalesce(f3, false) AS found) x""",
)
# The grid as the rule states it: extend both ways from the peaks, then split wide gaps.
cte(
    "grid0",
    "seqs peaks",
    """SELECT sequence_id, g0 - step * unnest(generate_series(1, CAST(ceil((g0 - first_frame) / step) AS BIGINT))) AS g FROM seqs
      WHERE g0 > first_frame
    UNION SELECT sequence_id, gn + step * unnest(generate_series(1, (last_frame - gn) // step + 1)) FROM seqs
    UNION SELECT sequence_id, g0 FROM seqs
    UNION SELECT p.sequence_id, p.frame_index FROM peaks p JOIN seqs USING (sequence_id) WHERE method = 'detected_contacts'""",
)
cte(
    "grid",
    "grid0 seqs",
    """SELECT sequence_id, g FROM grid0
    UNION SELECT sequence_id, CAST(round_even(CAST(g + gap * part / pieces AS DOUBLE), 0) AS BIGINT)
    FROM (SELECT sequence_id, g, gap, pieces, unnest(generate_series(1, pieces - 1)) AS part
      FROM (SELECT sequence_id, g, gap, greatest(2, CAST(round_even(CAST(gap / step AS DOUBLE), 0) AS BIGINT)) AS pieces
        FROM (SELECT *, lead(g) OVER (PARTITION BY sequence_id ORDER BY g) - g AS gap FROM grid0) a
        JOIN seqs USING (sequence_id) WHERE gap > CAST(1.65 AS DOUBLE) * step) b) c""",
)
cte(
    "cells",
    "grid",
    """SELECT * FROM (SELECT sequence_id, g AS cell_start, lead(g) OVER w AS cell_end, row_number() OVER w AS number
    FROM grid WINDOW w AS (PARTITION BY sequence_id ORDER BY g)) c WHERE cell_end IS NOT NULL""",
)
cte(
    "lab",
    "sig cells seqs",
    f"""SELECT *, {PHASE_LIST}[1 + phase_index] AS phase_label, round_even(progress, 6) AS cycle_position
    FROM (SELECT *, CAST(CASE WHEN progress < CAST(0.12 AS DOUBLE) THEN 0 WHEN progress < CAST(0.31 AS DOUBLE) THEN 1
        WHEN progress < CAST(0.62 AS DOUBLE) THEN 2 ELSE 3 END AS INTEGER) AS phase_index
      FROM (SELECT s.*, c.cell_start, c.cell_end, q.confidence,
          least(greatest((frame_index - cell_start) / (cell_end - cell_start), CAST(0 AS DOUBLE)), CAST(0.999999 AS DOUBLE)) AS progress
        FROM sig s ASOF JOIN cells c ON s.sequence_id = c.sequence_id AND s.frame_index >= c.cell_start
        JOIN seqs q ON q.sequence_id = s.sequence_id) a) b""",
)
cte("elig", "lab", "SELECT * FROM lab WHERE exclusion_reason IS NULL")


def mark(k: int, limit: str) -> str:
    return f"cell_start + greatest({k}, CAST(ceil((cell_end - cell_start) * CAST({limit} AS DOUBLE)) AS BIGINT))"


cte(
    "bnd",
    "cells seqs",
    f"""SELECT q.dataset, q.subject_id, c.sequence_id,
      'step_' || CASE WHEN number < 1000 THEN lpad(CAST(number AS VARCHAR), 3, '0') ELSE CAST(number AS VARCHAR) END AS cycle_id,
      cell_start AS contact_start_frame, {mark(1, '0.12')} AS mid_stance_frame,
      {mark(2, '0.31')} AS terminal_stance_frame, {mark(3, '0.62')} AS swing_frame, cell_end AS next_contact_frame,
      q.confidence, '{ANNOTATION_SOURCE}' AS annotation_source, 'v1' AS annotation_version, '{BOUNDARY_NOTE}' AS notes
    FROM cells c JOIN seqs q ON q.sequence_id = c.sequence_id WHERE cell_start >= first_frame AND cell_end <= last_frame""",
)

oracle("interpolate_signal", "filled", "SELECT sequence_id, frame_index, round(filled, 6) AS filled FROM filled")
oracle(
    "smooth_signal",
    "level",
    f"SELECT sequence_id, frame_index, round(smoothed, 6) AS smoothed FROM ({smooth_sql('level', 'level')}) s",
)
PEAK_COLUMNS = "sequence_id, frame_index, round(prominence, 6) AS prominence, round(signal, 6) AS signal"
oracle("peak_candidates", "cand", f"SELECT {PEAK_COLUMNS} FROM cand")
oracle("contact_peaks", "peaks", f"SELECT {PEAK_COLUMNS} FROM peaks")
oracle("contact_grid", "grid", "SELECT sequence_id, g AS grid_frame FROM grid")
oracle(
    "asof_grid",
    "sig grid",
    """SELECT sample_id, sequence_id, frame_index,
      (SELECT max(g) FROM grid WHERE grid.sequence_id = s.sequence_id AND g <= s.frame_index) AS start,
      (SELECT min(g) FROM grid WHERE grid.sequence_id = s.sequence_id AND g > s.frame_index) AS "end"
    FROM sig s""",
)
oracle(
    "frame_labels",
    "elig",
    """SELECT sample_id, dataset, subject_id, sequence_id, condition, frame_index, relative_path, split, fold,
      phase_label, phase_index, cycle_position, confidence FROM elig""",
)
oracle("cycle_boundaries", "bnd", "SELECT * FROM bnd")
oracle(
    "sequence_qc",
    "seqs",
    """SELECT dataset, subject_id, condition, split, fold, sequence_id, frame_count,
      coalesce(n_peaks, 0) AS detected_contact_count, round_even(median_step, 4) AS median_step_frames,
      round_even(cv, 6) AS step_interval_cv, method AS coverage_method, confidence, missing_feature_frames,
      eligible_frame_count FROM seqs""",
)
oracle(
    "exclusion_ledger",
    "sig elig",
    """SELECT sample_id, dataset, CASE WHEN dataset = 'ds1' THEN 'incomplete_temporal_sequence'
      ELSE coalesce(exclusion_reason, 'not_in_annotation_scope') END AS provisional_exclusion_reason
    FROM sig WHERE sample_id NOT IN (SELECT sample_id FROM elig WHERE dataset = 'ds0' AND confidence = 'medium')""",
)
oracle(
    "split_summary",
    "elig",
    """SELECT split, fold, phase_label, count(*) AS frames, count(DISTINCT subject_id) AS subjects,
      count(DISTINCT sequence_id) AS sequences FROM elig GROUP BY 1, 2, 3""",
)
oracle(
    "label_counts",
    "elig",
    " UNION ALL ".join(
        f"SELECT '{c}' AS kind, {c} AS value, count(*) AS frames FROM elig GROUP BY 2" for c in ("confidence", "phase_label", "split")
    ),
)

# --- preparation --------------------------------------------------------------------------

oracle(
    "confidence_withheld",
    "elig",
    """SELECT sample_id, confidence, 'confidence_not_medium' AS prepared_exclusion_reason FROM elig
    WHERE confidence <> 'medium'""",
)
cte(
    "prep0",
    "elig",
    """SELECT elig.*, CAST(v.k AS INTEGER) AS fold_view, CASE WHEN split = 'test' THEN 'test' WHEN fold = v.k THEN 'validation'
      ELSE 'train' END AS prepared_role, sha256(sample_id) AS sha256
    FROM elig, (SELECT unnest([0, 1, 2, 3, 4]) AS k) v WHERE confidence = 'medium'""",
)
cte(
    "prep",
    "prep0",
    """SELECT * EXCLUDE (relative_path),
      CASE WHEN prepared_role = 'test' THEN 'test' ELSE 'folds/fold_' || fold_view || '/' || prepared_role END
      || '/' || phase_label || '/' || replace(subject_id, ':', '_') || '/' || condition || '/' || sample_id || '.png'
      AS relative_path FROM prep0""",
)
oracle("fold_views", "prep", "SELECT fold_view, sample_id, prepared_role, relative_path FROM prep")
oracle(
    "fold_view_summary",
    "prep",
    """SELECT fold_view, prepared_role, count(*) AS frames, count(DISTINCT subject_id) AS subjects
    FROM prep GROUP BY 1, 2""",
)
FOLD_RULES = {
    "label in vocabulary": "false",
    "confidence is medium": "confidence <> 'medium'",
    "train and validation rows are development": "prepared_role <> 'test' AND split <> 'development'",
    "test rows are test": "prepared_role = 'test' AND split <> 'test'",
    "train rows come from other folds": "prepared_role = 'train' AND fold = fold_view",
    "validation rows come from the fold": "prepared_role = 'validation' AND fold <> fold_view",
    "path names its label": "NOT contains(relative_path, '/' || phase_label || '/')",
}
oracle(
    "fold_view_rules",
    "prep",
    " UNION ALL ".join(
        [f"SELECT fold_view, '{n}' AS rule, count(*) FILTER (WHERE {c}) AS violations FROM prep GROUP BY 1" for n, c in FOLD_RULES.items()]
        + [
            f"""SELECT fold_view, '{n}' AS rule, count(*) FILTER (WHERE n > 1) AS violations FROM
            (SELECT fold_view, {g}, {e} AS n FROM prep GROUP BY ALL) GROUP BY 1"""
            for n, g, e in (
                ("sample_id unique", "sample_id", "count(*)"),
                ("subject in one role", "subject_id", "count(DISTINCT prepared_role)"),
                ("one checksum per path", "relative_path", "count(DISTINCT sha256)"),
            )
        ]
        + [
            """SELECT fold_view, 'counts as registered' AS rule,
            CASE WHEN fold_view = 2 THEN count(DISTINCT prepared_role) ELSE 0 END AS violations FROM prep GROUP BY 1"""
        ]
    ),
)
cte(
    "changed",
    "lab",
    """SELECT * EXCLUDE (condition, frame_index, phase_label, phase_index, confidence),
      CASE WHEN event_id % 101 = 0 THEN 'zz00' ELSE condition END AS condition,
      CASE WHEN event_id % 103 = 0 THEN frame_index + 1 ELSE frame_index END AS frame_index,
      CASE WHEN event_id % 107 = 0 THEN 'other' ELSE phase_label END AS phase_label,
      CASE WHEN event_id % 109 = 0 THEN 0 ELSE phase_index END AS phase_index,
      CASE WHEN event_id % 113 = 0 THEN 'high' ELSE confidence END AS confidence FROM lab""",
)
FIELDS = ("dataset", "subject_id", "sequence_id", "condition", "frame_index", "relative_path", "split", "fold")


def differing(field: str) -> str:
    return f"SELECT count(*) FROM changed c JOIN sig s USING (sample_id) WHERE c.{field} IS DISTINCT FROM s.{field}"


UNKNOWN_LABEL = broken("changed", f"NOT list_contains({PHASE_LIST}, phase_label)")
oracle(
    "label_release_rules",
    "changed sig",
    union(
        [
            ("sample_id present", broken("changed", "sample_id IS NULL")),
            ("label in vocabulary", UNKNOWN_LABEL),
            ("confidence in vocabulary", broken("changed", "confidence NOT IN ('medium', 'low')")),
            ("sample known", broken("changed", "sample_id NOT IN (SELECT sample_id FROM sig)")),
            ("dataset in scope", broken("sig", "dataset <> 'ds0'")),
            ("sample not excluded", broken("sig", "exclusion_reason IS NOT NULL")),
            ("row has a split", broken("sig", "split IS NULL")),
        ]
        + [(f"{f} unchanged", differing(f)) for f in FIELDS]
        + [
            ("sample_id unique", repeated("changed", "sample_id")),
            ("manifest sample_id unique", repeated("sig", "sample_id")),
            ("subject in one split", crossing("sig", "subject_id", "split")),
            ("duplicate group in one split", "SELECT 0"),
            ("subject in one fold", crossing("sig", "subject_id", "fold", "split = 'development'")),
        ]
    ),
)
oracle(
    "metadata_mismatches",
    "changed sig",
    union(
        [(f, differing(f)) for f in FIELDS]
        + [
            ("phase_label unknown", UNKNOWN_LABEL),
            ("phase_index differs", broken("changed", f"phase_index IS DISTINCT FROM {index_of('phase_label')}")),
        ]
    ),
)
oracle(
    "prepared_canonical_check",
    "prep changed",
    """SELECT fold_view, count(*) AS rows, count(*) FILTER (WHERE c.phase_label IS NULL) AS missing_canonical_label,
      count(*) FILTER (WHERE p.phase_label IS DISTINCT FROM c.phase_label) AS label_mismatches,
      count(*) FILTER (WHERE p.confidence IS DISTINCT FROM c.confidence) AS confidence_mismatches,
      0::BIGINT AS source_mismatches, 0::BIGINT AS version_mismatches
    FROM prep p LEFT JOIN changed c USING (sample_id) GROUP BY 1""",
)
WORDS = " || ':' || ".join(f"sum(CAST('0x' || substr(h, {7 * k + 1}, 7) AS BIGINT))" for k in range(9))
oracle(
    "tree_digest",
    "prep",
    f"""SELECT view, count(*) AS entries, sha256(count(*) || ':' || {WORDS}) AS digest
    FROM (SELECT unnest(['all', 'fold_' || fold_view || '/' || prepared_role]) AS view, sha256(relative_path || ':' || sha256) AS h
      FROM prep) l GROUP BY 1""",
)
oracle(
    "tree_difference",
    "",
    """SELECT path, state FROM (
      SELECT coalesce(a.path, b.path) AS path, CASE WHEN b.path IS NULL THEN 'missing' WHEN a.path IS NULL THEN 'extra' WHEN a.h <> b.h THEN 'changed' END AS state
      FROM (SELECT 'd' || (doc_id // 50) || '/' || doc_id || '.txt' AS path, sha256(text) AS h FROM documents) a
      FULL JOIN (SELECT 'd' || (doc_id // 50) || '/' || doc_id || '.txt' AS path, CASE WHEN doc_id % 211 = 5 THEN sha256(sha256(text)) ELSE sha256(text) END AS h
        FROM documents WHERE doc_id % 307 <> 7
        UNION ALL SELECT 'd' || (doc_id // 50) || '/' || doc_id || '.new', sha256(text) FROM documents WHERE doc_id % 401 = 9) b ON a.path = b.path) x
    WHERE state IS NOT NULL""",
)
oracle(
    "coverage_difference",
    "lab",
    """SELECT count(*) FILTER (WHERE a) AS left_ids, count(*) FILTER (WHERE b) AS right_ids,
      count(*) FILTER (WHERE a AND NOT b) AS only_left, count(*) FILTER (WHERE b AND NOT a) AS only_right,
      count(*) FILTER (WHERE a AND b) AS in_both
    FROM (SELECT exclusion_reason IS NULL AS a, confidence = 'medium' AS b FROM lab) l""",
)

# --- boundaries and annotators ------------------------------------------------------------

cte(
    "saved",
    "bnd",
    """SELECT * REPLACE (mid_stance_frame + CASE WHEN contact_start_frame % 2 = 0
      AND mid_stance_frame + 1 < terminal_stance_frame THEN 1 ELSE 0 END AS mid_stance_frame) FROM bnd""",
)


def phase_of(names: tuple[str, ...]) -> str:
    _, a, b, c = names
    return f"{PHASE_LIST}[CASE WHEN frame_index < {a} THEN 1 WHEN frame_index < {b} THEN 2 WHEN frame_index < {c} THEN 3 ELSE 4 END]"


MACHINE = ("contact_start_frame", "mid_stance_frame", "terminal_stance_frame", "swing_frame")
HUMAN = ("initial_contact_frame", "mid_stance_frame", "terminal_stance_frame", "swing_frame")
cte(
    "cmp",
    "elig saved",
    f"""SELECT e.sample_id, e.sequence_id, e.frame_index, s.cycle_id, e.phase_label, {phase_of(MACHINE)} AS boundary_phase
    FROM elig e JOIN saved s ON e.sequence_id = s.sequence_id AND e.frame_index >= s.contact_start_frame
      AND e.frame_index < s.next_contact_frame""",
)
oracle("boundary_label_mismatch", "cmp", "SELECT * FROM cmp WHERE phase_label <> boundary_phase")
oracle(
    "boundary_repair",
    "saved bnd",
    """SELECT s.sequence_id, s.cycle_id, s.contact_start_frame, b.mid_stance_frame, b.terminal_stance_frame, b.swing_frame,
      s.next_contact_frame, s.mid_stance_frame <> b.mid_stance_frame AS changed
    FROM saved s JOIN bnd b USING (sequence_id, cycle_id)""",
)
cte(
    "human",
    "bnd",
    """SELECT sequence_id, cycle_id, 'annotator_1' AS annotator_id, contact_start_frame AS initial_contact_frame,
      mid_stance_frame, terminal_stance_frame, swing_frame, next_contact_frame AS next_initial_contact_frame, confidence
    FROM bnd
    UNION ALL SELECT sequence_id, cycle_id, 'annotator_2', contact_start_frame, mid_stance_frame + mv,
      terminal_stance_frame + mv, swing_frame + mv, next_contact_frame, confidence
    FROM (SELECT *, CASE WHEN mid_stance_frame + m > contact_start_frame AND swing_frame + m < next_contact_frame
        THEN m ELSE 0 END AS mv
      FROM (SELECT *, CAST(split_part(subject_id, ':', 2) AS BIGINT) % 3 - 1 AS m FROM bnd) a) b""",
)
cte(
    "expanded",
    "human",
    f"""SELECT sequence_id, cycle_id, annotator_id, frame_index, {phase_of(HUMAN)} AS label
    FROM (SELECT *, unnest(generate_series(initial_contact_frame, next_initial_contact_frame - 1)) AS frame_index FROM human) h""",
)
cte(
    "pairs",
    "expanded",
    """SELECT sequence_id, cycle_id, frame_index, a.label AS label_a, b.label AS label_b
    FROM (SELECT * FROM expanded WHERE annotator_id = 'annotator_1') a
    JOIN (SELECT * FROM expanded WHERE annotator_id = 'annotator_2') b USING (sequence_id, cycle_id, frame_index)""",
)
oracle("expand_boundaries", "expanded", "SELECT * FROM expanded")
oracle("annotator_pairs", "pairs", "SELECT * FROM pairs")
cte(
    "ranked",
    "pairs",
    """SELECT label, dense_rank() OVER (ORDER BY i) AS k FROM (SELECT DISTINCT label, list_position(%s, label) AS i
    FROM (SELECT label_a AS label FROM pairs UNION SELECT label_b FROM pairs) u) v"""
    % PHASE_LIST,
)
cte("pk", "pairs ranked", "SELECT a.k AS ka, b.k AS kb FROM pairs JOIN ranked a ON label_a = a.label JOIN ranked b ON label_b = b.label")
oracle(
    "annotator_agreement",
    "pk",
    """SELECT frames, round(raw, 6) AS raw_agreement, round(1 - seen / chance, 6) AS weighted_kappa,
      CASE WHEN 1 - seen / chance >= CAST(0.8 AS DOUBLE) THEN 'PASS' ELSE 'FAIL' END AS status
    FROM (SELECT count(*) AS frames, avg(CAST(ka = kb AS DOUBLE)) AS raw, CAST(sum((ka - kb) * (ka - kb)) AS DOUBLE) AS seen FROM pk) a,
      (SELECT CAST(sum((x.k - y.k) * (x.k - y.k) * x.n * y.n) AS DOUBLE) / (SELECT count(*) FROM pk) AS chance
        FROM (SELECT ka AS k, count(*) AS n FROM pk GROUP BY 1) x, (SELECT kb AS k, count(*) AS n FROM pk GROUP BY 1) y) b""",
)
oracle(
    "boundary_disagreement",
    "human",
    """SELECT count(*) AS cycles, round(avg(d) / 5, 6) AS mean_absolute_frames,
      round(avg(d) / 5 * 1000 / 25, 6) AS mean_absolute_milliseconds
    FROM (SELECT CAST(abs(a.initial_contact_frame - b.initial_contact_frame) + abs(a.mid_stance_frame - b.mid_stance_frame)
        + abs(a.terminal_stance_frame - b.terminal_stance_frame) + abs(a.swing_frame - b.swing_frame)
        + abs(a.next_initial_contact_frame - b.next_initial_contact_frame) AS DOUBLE) AS d
      FROM human a JOIN human b USING (sequence_id, cycle_id)
      WHERE a.annotator_id = 'annotator_1' AND b.annotator_id = 'annotator_2') p""",
)
oracle(
    "boundary_rules",
    "human",
    """SELECT unnest(['boundaries are integers', 'boundaries strictly increasing', 'confidence in vocabulary',
      'one record per annotator and cycle']) AS rule, unnest([bad, flat, conf, twice]) AS violations
    FROM (SELECT count(*) FILTER (WHERE f0 % 17 = 0) AS bad,
        count(*) FILTER (WHERE f0 % 17 <> 0 AND f0 % 19 = 0) AS flat,
        count(*) FILTER (WHERE f0 % 17 <> 0 AND f0 % 23 = 0) AS conf,
        count(*) FILTER (WHERE f0 % 29 = 0) // 2 AS twice
      FROM (SELECT initial_contact_frame AS f0 FROM human) h) c""",
)

# --- predictions --------------------------------------------------------------------------

VARIANTS = {"base": (7, 13), "wide": (5, 11)}


def predict(one: int, two: int) -> str:
    return f"""SELECT event_id, sample_id, dataset, subject_id, sequence_id, condition, frame_index, split, fold, cycle_position,
      confidence, phase_index AS t, phase_label AS y_true,
      (phase_index + CASE WHEN event_id % {one} = 0 THEN 1 WHEN event_id % {two} = 0 THEN 2 ELSE 0 END) % 4 AS p,
      (event_id * 37 % 100) / CAST(100 AS DOUBLE) AS boundary_probability FROM elig"""


for _name, _moduli in VARIANTS.items():
    cte(_name, "elig", predict(*_moduli))
cte(
    "flags",
    "base",
    """SELECT *, CAST(coalesce(lag(frame_index) OVER w = frame_index - 1 AND lag(t) OVER w <> t, false) AS INTEGER) AS y_boundary
    FROM base WINDOW w AS (PARTITION BY sequence_id ORDER BY frame_index)""",
)
cte(
    "hits",
    "base",
    """SELECT sequence_id, min(frame_index) AS run_start,
      arg_max(frame_index, (boundary_probability, -frame_index)) AS frame_index, max(boundary_probability) AS boundary_probability
    FROM (SELECT *, frame_index - row_number() OVER (PARTITION BY sequence_id ORDER BY frame_index) AS island
      FROM base WHERE boundary_probability >= 0.5) h GROUP BY sequence_id, island""",
)
cte(
    "errors",
    "flags hits",
    """SELECT sequence_id, frame_index,
      (SELECT min(abs(h.frame_index - f.frame_index)) FROM hits h WHERE h.sequence_id = f.sequence_id) AS error_frames
    FROM flags f WHERE y_boundary = 1""",
)
oracle("boundary_flags", "flags", "SELECT sample_id, y_boundary FROM flags")
oracle("predicted_boundary_peaks", "hits", "SELECT * FROM hits")
oracle("nearest_boundary_error", "errors", "SELECT * FROM errors")
oracle(
    "boundary_classification",
    "flags",
    """SELECT CAST(0.5 AS DOUBLE) AS threshold, round(coalesce(h / nullif(p, 0), 0), 6) AS precision,
      round(coalesce(h / nullif(t, 0), 0), 6) AS recall, round(coalesce(2 * h / nullif(p + t, 0), 0), 6) AS f1,
      t AS true_boundaries, p AS predicted_boundary_frames
    FROM (SELECT count(*) FILTER (WHERE y_boundary = 1 AND boundary_probability >= 0.5) AS h,
      count(*) FILTER (WHERE boundary_probability >= 0.5) AS p, count(*) FILTER (WHERE y_boundary = 1) AS t FROM flags) c""",
)
oracle(
    "boundary_timing",
    "errors",
    """SELECT count(error_frames) AS matched_true_boundaries, round(avg(error_frames), 6) AS mean_absolute_error_frames,
      quantile_cont(CAST(error_frames AS DOUBLE), 0.5) AS median_absolute_error_frames,
      round(avg(CAST(error_frames <= 1 AS DOUBLE)), 6) AS within_one_frame,
      round(avg(CAST(error_frames <= 2 AS DOUBLE)), 6) AS within_two_frames FROM errors""",
)
cte("ids", "", "SELECT unnest([0, 1, 2, 3]) AS i")
oracle(
    "confusion_matrix",
    "base ids",
    f"""SELECT {PHASE_LIST}[1 + a.i] AS y_true, {PHASE_LIST}[1 + b.i] AS y_pred,
      (SELECT count(*) FROM base WHERE t = a.i AND p = b.i) AS n FROM ids a, ids b""",
)


def class_counts(source: str, keys: str) -> str:
    lead = f"{keys}, " if keys else ""
    join = " AND ".join(f"s.{k} IS NOT DISTINCT FROM g.{k}" for k in keys.split(", ")) if keys else "true"
    groups = f"(SELECT DISTINCT {keys} FROM {source})" if keys else "(SELECT 1 AS one)"
    named = "".join(f"g.{k}, " for k in keys.split(", ")) if keys else ""
    return f"""SELECT {named}i.i, count(*) FILTER (WHERE s.t = i.i) AS nt, count(*) FILTER (WHERE s.p = i.i) AS np,
      count(*) FILTER (WHERE s.t = i.i AND s.p = i.i) AS nh FROM {groups} g CROSS JOIN ids i JOIN {source} s ON {join}
      GROUP BY {lead}i.i""".replace(f"GROUP BY {lead}", f"GROUP BY {named}")


F1 = "coalesce(2 * nh / nullif(nt + np, 0), 0)"
oracle(
    "per_class_metrics",
    "base ids",
    f"""SELECT {PHASE_LIST}[1 + i] AS phase, round(coalesce(nh / nullif(np, 0), 0), 6) AS precision,
      round(coalesce(nh / nullif(nt, 0), 0), 6) AS recall, round({F1}, 6) AS f1, nt AS support
    FROM ({class_counts('base', '')}) c""",
)


def metric_ctes(source: str, keys: str) -> str:
    """Sample count, subject macro-F1, frame macro-F1 and balanced accuracy per key."""
    k = f"{keys}, " if keys else ""
    using = f"USING ({keys})" if keys else "ON true"
    by = f"GROUP BY {keys}" if keys else ""
    return f"""SELECT {k}samples, subjects, subject_macro_f1, frame_macro_f1, balanced_accuracy FROM
      (SELECT {k}count(*) AS samples, count(DISTINCT subject_id) AS subjects FROM {source} {by}) a
      JOIN (SELECT {k}avg(f) AS subject_macro_f1 FROM (SELECT {k}subject_id, avg({F1}) AS f
        FROM ({class_counts(source, k + 'subject_id')}) c GROUP BY {k}subject_id) s {by}) b {using}
      JOIN (SELECT {k}avg({F1}) AS frame_macro_f1, avg(CASE WHEN nt > 0 THEN nh / nt END) AS balanced_accuracy
        FROM ({class_counts(source, keys)}) c {by}) d {using}"""


ROUNDED = ", ".join(f"round({c}, 6) AS {c}" for c in ("subject_macro_f1", "frame_macro_f1", "balanced_accuracy"))
cte("scores", "base ids", f"SELECT subject_id, CAST(sum(nt) AS BIGINT) AS samples, avg({F1}) AS macro_f1 FROM ({class_counts('base', 'subject_id')}) c GROUP BY 1")
oracle("subject_scores", "scores", "SELECT subject_id, samples, round(macro_f1, 6) AS macro_f1 FROM scores")
oracle("subject_macro_f1", "scores", "SELECT count(*) AS subjects, round(avg(macro_f1), 6) AS subject_macro_f1 FROM scores")
oracle("overall_metrics", "base ids", f"SELECT samples, subjects, {ROUNDED} FROM ({metric_ctes('base', '')}) m")
oracle(
    "condition_metrics",
    "base ids",
    f"SELECT condition, samples, subjects, round(subject_macro_f1, 6) AS subject_macro_f1 FROM ({metric_ctes('base', 'condition')}) m",
)
oracle(
    "dataset_condition_metrics",
    "base ids",
    f"""SELECT dataset, condition, samples, subjects, round(subject_macro_f1, 6) AS subject_macro_f1,
      round(balanced_accuracy, 6) AS balanced_accuracy FROM ({metric_ctes('base', 'dataset, condition')}) m""",
)
cte(
    "runs",
    "base wide",
    """SELECT 'base' AS variant, * FROM base WHERE split = 'development'
    UNION ALL SELECT 'wide', * FROM wide WHERE split = 'development'""",
)
ALLOWED = " OR ".join(f"(prev = {i} AND p IN ({', '.join(map(str, t))}))" for i, t in ALLOWED_TRANSITIONS.items())
cte(
    "valid",
    "runs",
    f"""SELECT variant, count(*) AS pairs, avg(CAST({ALLOWED} AS DOUBLE)) AS transition_validity
    FROM (SELECT *, lag(p) OVER (PARTITION BY variant, subject_id, sequence_id ORDER BY frame_index) AS prev FROM runs) r
    WHERE prev IS NOT NULL GROUP BY 1""",
)
oracle("transition_validity", "valid", "SELECT variant, pairs, round(transition_validity, 6) AS transition_validity FROM valid")


def resample(source: str, value: str, keys: str = "") -> str:
    """Resampled means: (keys, b, mean) from a table of subject values."""
    k = f"{keys}, " if keys else ""
    part = f"PARTITION BY {keys}" if keys else ""
    return f"""SELECT {k}b, avg(v) AS mean FROM (
      SELECT {k}d.b, CAST('0x' || substr(sha256('20260827:' || d.b || ':' || (n.pos // 8)), 1 + 8 * (n.pos % 8), 8) AS BIGINT) % n.size AS pos
      FROM ({numbered(source, value, k, part)}) n, (SELECT unnest(generate_series(0, 1999)) AS b) d) x
      JOIN (SELECT {k}pos, v FROM ({numbered(source, value, k, part)}) m) y USING ({k}pos) GROUP BY {k}b"""


def numbered(source: str, value: str, k: str, part: str) -> str:
    return f"""SELECT {k}{value} AS v, row_number() OVER ({part} ORDER BY sha256(subject_id)) - 1 AS pos,
      count(*) OVER ({part}) AS size FROM {source}"""


oracle(
    "bootstrap_interval",
    "scores",
    f"""SELECT round(e, 6) AS estimate, subjects, round(lo, 6) AS lower, round(hi, 6) AS upper,
      CAST(0.95 AS DOUBLE) AS confidence, 2000::BIGINT AS iterations
    FROM (SELECT avg(macro_f1) AS e, count(*) AS subjects FROM scores) a,
      (SELECT quantile_cont(mean, 0.025) AS lo, quantile_cont(mean, 0.975) AS hi FROM ({resample('scores', 'macro_f1')}) r) b""",
)
cte("boot_cells", "base ids", f"{class_counts('base', 'condition, subject_id')}")
cte(
    "boot_members",
    "boot_cells",
    """SELECT condition, subject_id, row_number() OVER (PARTITION BY condition ORDER BY sha256(subject_id)) - 1 AS pos,
      count(*) OVER (PARTITION BY condition) AS size FROM (SELECT DISTINCT condition, subject_id FROM boot_cells) m""",
)
cte(
    "boot_drawn",
    "boot_members",
    """SELECT x.condition, x.b, y.subject_id FROM (
      SELECT m.condition, d.b, CAST('0x' || substr(sha256('20260827:' || d.b || ':' || (m.pos // 8)), 1 + 8 * (m.pos % 8), 8) AS BIGINT) % m.size AS pos
      FROM boot_members m, (SELECT unnest(generate_series(0, 1999)) AS b) d) x JOIN boot_members y USING (condition, pos)
    UNION ALL SELECT condition, -1, subject_id FROM boot_members""",
)
cte(
    "boot_resampled",
    "boot_drawn boot_cells",
    f"""SELECT condition, b, avg({F1}) AS frame_macro_f1, avg(CASE WHEN nt > 0 THEN nh / nt END) AS balanced_accuracy
    FROM (SELECT condition, b, i, sum(nt) AS nt, sum(np) AS np, sum(nh) AS nh FROM boot_drawn JOIN boot_cells USING (condition, subject_id) GROUP BY 1, 2, 3) c
    GROUP BY 1, 2""",
)
oracle(
    "metric_intervals",
    "boot_resampled boot_members",
    """SELECT condition, metric, round(max(v) FILTER (WHERE b = -1), 6) AS estimate, round(quantile_cont(v, 0.025) FILTER (WHERE b >= 0), 6) AS lower,
      round(quantile_cont(v, 0.975) FILTER (WHERE b >= 0), 6) AS upper, any_value(size) AS subjects,
      CAST(0.95 AS DOUBLE) AS confidence, 2000::BIGINT AS iterations
    FROM (SELECT condition, b, unnest(['frame_macro_f1', 'balanced_accuracy']) AS metric, unnest([frame_macro_f1, balanced_accuracy]) AS v FROM boot_resampled) r
    JOIN (SELECT DISTINCT condition, size FROM boot_members) s USING (condition) GROUP BY 1, 2""",
)
cte("wscores", "wide ids", f"SELECT subject_id, avg({F1}) AS macro_f1 FROM ({class_counts('wide', 'subject_id')}) c GROUP BY 1")
cte("gaps", "scores wscores", "SELECT subject_id, s.macro_f1 - w.macro_f1 AS d FROM scores s JOIN wscores w USING (subject_id)")
oracle(
    "paired_difference",
    "gaps",
    f"""SELECT round(e, 6) AS estimate, round(lo, 6) AS lower, round(hi, 6) AS upper,
      round(better, 6) AS probability_left_better, 0::BIGINT AS unpaired_rows
    FROM (SELECT avg(d) AS e FROM gaps) a,
      (SELECT quantile_cont(mean, 0.025) AS lo, quantile_cont(mean, 0.975) AS hi, avg(CAST(mean > 0 AS DOUBLE)) AS better
        FROM ({resample('gaps', 'd')}) r) b""",
)
oracle(
    "fold_summary",
    "runs ids",
    f"""SELECT variant, fold, samples, subjects, round(subject_macro_f1, 6) AS subject_macro_f1,
      round(balanced_accuracy, 6) AS balanced_accuracy FROM ({metric_ctes('runs', 'variant, fold')}) m""",
)
cte(
    "vscores",
    "runs ids",
    f"""SELECT variant, subject_id, avg({F1}) AS macro_f1 FROM ({class_counts('runs', 'variant, subject_id')}) c
    GROUP BY 1, 2""",
)
oracle(
    "model_summary",
    "runs ids valid vscores",
    f"""SELECT variant, samples, subjects, {ROUNDED}, round(lo, 6) AS ci_lower, round(hi, 6) AS ci_upper,
      round(transition_validity, 6) AS transition_validity
    FROM ({metric_ctes('runs', 'variant')}) m JOIN valid USING (variant) JOIN (
      SELECT variant, quantile_cont(mean, 0.025) AS lo, quantile_cont(mean, 0.975) AS hi
      FROM ({resample('vscores', 'macro_f1', 'variant')}) r GROUP BY 1) b USING (variant)""",
)
cte(
    "faulty",
    "runs",
    """SELECT * REPLACE (CASE WHEN variant = 'wide' AND event_id % 211 = 0 THEN 4 ELSE fold END AS fold) FROM runs
    WHERE NOT (variant = 'wide' AND event_id % 199 = 0)""",
)
COVERED = ("dataset", "subject_id", "sequence_id", "condition", "frame_index", "y_true", "label_source", "annotation_version", "annotation_confidence")
oracle(
    "canonical_coverage",
    "faulty runs",
    """SELECT v.variant, r.rule, CAST(CASE
        WHEN r.rule = 'canonical sample predicted' THEN (SELECT count(*) FROM runs u WHERE u.variant = v.variant AND NOT EXISTS
          (SELECT 1 FROM faulty f WHERE f.variant = u.variant AND f.sample_id = u.sample_id))
        WHEN r.rule = 'fold as canonical' THEN (SELECT count(*) FROM runs u JOIN faulty f USING (variant, sample_id)
          WHERE u.variant = v.variant AND u.fold <> f.fold)
        ELSE 0 END AS BIGINT) AS violations
    FROM (SELECT DISTINCT variant FROM runs) v, (SELECT unnest(['sample is canonical', 'canonical sample predicted', %s,
      'fold as canonical']) AS rule) r"""
    % ", ".join(f"'{c} as canonical'" for c in COVERED),
)
oracle(
    "registry_rules",
    "faulty base",
    """SELECT variant, unnest(['registered folds complete', 'sample count as registered', 'subject count as registered',
        'sample in one fold', 'sample unique in its run']) AS rule,
      unnest([CAST(list_sort(list(DISTINCT fold)) <> [0, 1, 2, 3, 4] AS BIGINT), CAST(count(*) <> (SELECT count(*) FROM base WHERE split = 'development') AS BIGINT),
        CAST(count(DISTINCT subject_id) <> (SELECT count(DISTINCT subject_id) FROM base WHERE split = 'development') AS BIGINT), count(*) - count(DISTINCT sample_id),
        count(*) - count(DISTINCT (fold, sample_id))]) AS violations
    FROM faulty GROUP BY variant""",
)
oracle(
    "variant_identity",
    "faulty",
    """SELECT CAST(CASE WHEN EXISTS (SELECT 1 FROM faulty a WHERE a.variant = 'base' AND NOT EXISTS
      (SELECT 1 FROM faulty b WHERE b.variant = 'wide' AND b.sample_id = a.sample_id)) THEN 2 ELSE 1 END AS BIGINT) AS identity_tables""",
)
cte(
    "best",
    "",
    """SELECT run_id, arg_min(epoch, (loss, epoch)) AS best_epoch FROM (SELECT l_orderkey AS run_id, l_linenumber AS epoch,
      min(l_extendedprice) AS loss FROM lineitem GROUP BY 1, 2) c GROUP BY 1""",
)
oracle("best_epoch", "best", "SELECT * FROM best")
oracle("training_duration", "best", "SELECT quantile_cont(CAST(best_epoch AS DOUBLE), 0.5) AS epochs, count(*) AS runs FROM best")

# --- baselines ----------------------------------------------------------------------------

cte(
    "views",
    "base",
    """SELECT base.* REPLACE (CASE WHEN event_id % 31 <> 0 THEN cycle_position END AS cycle_position), CAST(v.k AS INTEGER) AS fold_view,
      fold = v.k AS held FROM base, (SELECT unnest([0, 1, 2, 3, 4]) AS k) v WHERE split = 'development'""",
)
cte(
    "major",
    "views",
    """SELECT v.*, m.y_pred FROM views v JOIN (SELECT fold_view, arg_min(y_true, (-n, y_true)) AS y_pred
      FROM (SELECT fold_view, y_true, count(*) AS n FROM views WHERE NOT held GROUP BY 1, 2) c GROUP BY 1) m
    USING (fold_view) WHERE held""",
)
BIN = "least(CAST(floor(cycle_position * 20) AS BIGINT), 19)"
cte(
    "bins",
    "views",
    f"""SELECT fold_view, {BIN} AS bin, t, y_true, count(*) AS n FROM views WHERE NOT held AND cycle_position IS NOT NULL
    GROUP BY ALL""",
)
cte(
    "prior",
    "views bins",
    f"""SELECT v.*, coalesce(m.y, f.y) AS y_pred FROM (SELECT *, {BIN} AS bin FROM views WHERE held) v
    LEFT JOIN (SELECT fold_view, bin, arg_min(y_true, (-n, t)) AS y FROM bins GROUP BY 1, 2) m USING (fold_view, bin)
    JOIN (SELECT fold_view, arg_min(y_true, (-n, t)) AS y FROM (SELECT fold_view, t, y_true, sum(n) AS n FROM bins GROUP BY ALL) s
      GROUP BY 1) f USING (fold_view)""",
)
oracle("majority_baseline", "major", "SELECT fold_view, sample_id, y_pred FROM major")
oracle("binned_prior_baseline", "prior", "SELECT fold_view, sample_id, y_pred FROM prior")
cte(
    "oof",
    "major prior",
    f"""SELECT 'majority' AS variant, subject_id, t, {index_of('y_pred')} AS p FROM major
    UNION ALL SELECT 'cycle_prior', subject_id, t, {index_of('y_pred')} FROM prior""",
)
oracle("baseline_oof_metrics", "oof ids", f"SELECT variant, samples, subjects, {ROUNDED} FROM ({metric_ctes('oof', 'variant')}) m")
oracle(
    "class_weights",
    "elig ids",
    f"""SELECT {PHASE_LIST}[1 + i] AS label, n AS frames, round(sqrt(total / (4.0::DOUBLE * greatest(n, 1))), 6) AS weight
    FROM (SELECT i, (SELECT count(*) FROM elig WHERE phase_index = i) AS n, (SELECT count(*) FROM elig) AS total FROM ids) c""",
)
oracle(
    "boundary_weight",
    "flags",
    """SELECT n AS frames, b AS boundaries, round(least(20.0::DOUBLE, greatest(1.0::DOUBLE, (n - b) / b)), 6) AS boundary_weight
    FROM (SELECT count(*) AS n, greatest(1, CAST(sum(y_boundary) AS BIGINT)) AS b FROM flags) f""",
)

# --- windows ------------------------------------------------------------------------------

cte(
    "turns",
    "",
    """SELECT conv_id || '-' || turn AS sample_id, CAST(conv_id AS VARCHAR) AS sequence_id, turn AS frame_index,
      turn - row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS seg FROM conversations""",
)
cte(
    "slots",
    "turns",
    """SELECT t.sample_id, o.o, (SELECT u.sample_id FROM turns u WHERE u.sequence_id = t.sequence_id AND u.seg = t.seg
        AND u.frame_index = least(greatest(t.frame_index + o.o, lo), hi)) AS item
    FROM (SELECT *, min(frame_index) OVER w AS lo, max(frame_index) OVER w AS hi FROM turns
      WINDOW w AS (PARTITION BY sequence_id, seg)) t, (SELECT unnest([-2, -1, 0, 1, 2]) AS o) o""",
)
oracle(
    "context_windows",
    "slots",
    "SELECT sample_id, string_agg(item, ',' ORDER BY o) AS context FROM slots GROUP BY sample_id",
)
oracle(
    "shuffled_windows",
    "slots",
    """SELECT sample_id, array_to_string(list_concat(final[1:2], [sample_id], final[3:4]), ',') AS context
    FROM (SELECT sample_id, CASE WHEN mixed = others THEN list_concat(mixed[2:4], mixed[1:1]) ELSE mixed END AS final
      FROM (SELECT sample_id, list(item ORDER BY i) AS others,
          list(item ORDER BY sha256('7:' || sample_id || ':' || item || ':' || i), item) AS mixed
        FROM (SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY o) - 1 AS i FROM slots WHERE o <> 0) s
        GROUP BY sample_id) m) f""",
)
cte(
    "segs",
    "elig",
    """SELECT *, min(frame_index) OVER s AS segment_start, count(*) OVER s AS len,
      row_number() OVER (PARTITION BY sequence_id, seg ORDER BY frame_index) - 1 AS pos,
      CAST(coalesce(lag(phase_label) OVER (PARTITION BY sequence_id, seg ORDER BY frame_index) <> phase_label, false) AS INTEGER) AS is_boundary
    FROM (SELECT *, frame_index - row_number() OVER (PARTITION BY sequence_id ORDER BY frame_index) AS seg FROM elig) e
    WINDOW s AS (PARTITION BY sequence_id, seg)""",
)
cte(
    "seglens",
    "segs",
    "SELECT sequence_id, segment_start, max(len) AS len FROM segs GROUP BY sequence_id, segment_start",
)
cte(
    "starts",
    "seglens",
    """SELECT sequence_id, segment_start, clip_start FROM (SELECT sequence_id, segment_start, greatest(0, len - 27) AS final,
        unnest(generate_series(0, greatest(0, len - 27))) AS clip_start FROM seglens) g
    WHERE clip_start % 9 = 0 OR clip_start = final""",
)
cte(
    "clips",
    "starts segs",
    """SELECT s.sequence_id, s.segment_start, c.clip_start, s.pos - c.clip_start AS slot, s.frame_index, s.phase_label,
      s.is_boundary, true AS valid, s.event_id, s.sample_id
    FROM segs s JOIN starts c ON s.sequence_id = c.sequence_id AND s.segment_start = c.segment_start
      AND s.pos BETWEEN c.clip_start AND c.clip_start + 26
    UNION ALL SELECT sequence_id, segment_start, 0, unnest(generate_series(len, 26)), frame_index, phase_label, is_boundary,
      false, event_id, sample_id FROM segs WHERE len < 27 AND pos = len - 1""",
)
oracle(
    "dense_clips",
    "clips",
    "SELECT sequence_id, segment_start, clip_start, slot, frame_index, phase_label, is_boundary, valid FROM clips",
)


def weights(extra: str) -> str:
    return ", ".join(f"(event_id * {3 + 2 * k}{extra} + {k}) % 97 + 1 AS w{k}" for k in range(4))


SHARES = ", ".join(f"w{k} / (w0 + w1 + w2 + w3) AS p{k}" for k in range(4))
cte(
    "avgs",
    "clips",
    f"""SELECT sample_id, avg(p0) AS p0, avg(p1) AS p1, avg(p2) AS p2, avg(p3) AS p3, avg(bp) AS bp, count(*) AS covered
    FROM (SELECT sample_id, {SHARES}, (event_id * 7 + clip_start) % 98 / CAST(100 AS DOUBLE) + CAST(0.01 AS DOUBLE) AS bp
      FROM (SELECT *, {weights(' + clip_start * 5')} FROM clips WHERE valid) w) p GROUP BY sample_id""",
)
oracle(
    "overlap_average",
    "avgs",
    f"""SELECT sample_id, round(p0, 6) AS p0, round(p1, 6) AS p1, round(p2, 6) AS p2, round(p3, 6) AS p3,
      round(bp, 6) AS boundary_probability, covered,
      {PHASE_LIST}[list_position([p0, p1, p2, p3], greatest(p0, p1, p2, p3))] AS y_pred FROM avgs""",
)
ILLEGAL = " + ".join(f"b{i} * p{j}" for i in range(4) for j in range(4) if j not in ALLOWED_TRANSITIONS[i])
CHANGE = " + ".join(f"least(pow(ln(p{k}) - ln(b{k}), 2), CAST(4 AS DOUBLE))" for k in range(4))
oracle(
    "sequence_scores",
    "flags",
    f"""SELECT condition, count(*) AS frames, round(sum(-wt * ln([p0, p1, p2, p3][1 + t])) / sum(wt), 6) AS phase_loss,
      round(avg(-(4.0::DOUBLE * y_boundary * ln(bp) + (1 - y_boundary) * ln(1 - bp))), 6) AS boundary_loss,
      round(avg(({CHANGE}) / 4) FILTER (WHERE pair AND y_boundary = 0), 6) AS smoothness_loss,
      round(avg({ILLEGAL}) FILTER (WHERE pair), 6) AS order_loss
    FROM (SELECT *, coalesce(lag(frame_index) OVER w = frame_index - 1, false) AS pair,
        {', '.join(f'lag(p{k}) OVER w AS b{k}' for k in range(4))},
        ([1.5, 1.0, 0.75, 0.5]::DOUBLE[])[1 + t] AS wt
      FROM (SELECT condition, sequence_id, frame_index, t, y_boundary, {SHARES},
          event_id * 7 % 98 / CAST(100 AS DOUBLE) + CAST(0.01 AS DOUBLE) AS bp FROM (SELECT *, {weights('')} FROM flags) a) b
      WINDOW w AS (PARTITION BY sequence_id ORDER BY frame_index)) c GROUP BY condition""",
)

# --- selection and audit ------------------------------------------------------------------

FAMILY = "CASE substr(condition, 1, 2) WHEN 'fn' THEN 'normal' WHEN 'fs' THEN 'slow' WHEN 'fq' THEN 'fast' ELSE 'bag' END"


def sequence_rows(source: str, where: str) -> str:
    return f"""SELECT dataset, {FAMILY} AS condition_family, condition, subject_id, sequence_id, count(*) AS frame_count,
      min(frame_index) AS first_frame, max(frame_index) AS last_frame,
      max(frame_index) - min(frame_index) + 1 = count(*) AND count(DISTINCT frame_index) = count(*) AS is_contiguous
    FROM {source} WHERE {where} GROUP BY ALL"""


oracle("sequence_table", "sig", sequence_rows("sig", "exclusion_reason IS NULL"))
OPEN = "split = 'development' AND (exclusion_reason IS NULL OR user_id % 3 <> 0)"


def pick_ctes(tag: str, where: str, seed: int) -> list[str]:
    """Four families in order, each leaving out the subjects already taken."""
    cte(
        f"{tag}_c",
        "sig",
        f"""SELECT *, abs(frame_count - median(frame_count) OVER (PARTITION BY condition_family)) AS length_distance,
        sha256('{seed}:' || sequence_id) AS stable_key FROM ({sequence_rows('sig', where)}) t WHERE is_contiguous""",
    )
    names: list[str] = []
    for position, family in enumerate(("normal", "slow", "fast", "bag")):
        used = " UNION ALL ".join(f"SELECT subject_id FROM {n}" for n in names)
        guard = f"AND subject_id NOT IN ({used})" if names else ""
        name = f"{tag}_{family}"
        cte(
            name,
            " ".join([f"{tag}_c", *names]),
            f"""SELECT *, {2 * position} + row_number() OVER (ORDER BY length_distance, stable_key, sequence_id) AS place FROM
            (SELECT * FROM {tag}_c WHERE condition_family = '{family}' {guard} QUALIFY row_number() OVER
            (PARTITION BY subject_id ORDER BY length_distance, stable_key, sequence_id) = 1) f
            ORDER BY length_distance, stable_key, sequence_id LIMIT 2""",
        )
        names.append(name)
    return names


def picked(names: list[str], prefix: str) -> str:
    rows = " UNION ALL ".join(f"SELECT * FROM {n}" for n in names)
    return f"""SELECT '{prefix}' || lpad(CAST(place AS VARCHAR), 3, '0') AS blind_sequence_id, condition_family, subject_id,
      sequence_id, frame_count, CAST(length_distance AS DOUBLE) AS length_distance FROM ({rows}) p"""


PILOT = pick_ctes("pilot", OPEN, 20260827)
NEXT = pick_ctes("nxt", f"{OPEN} AND user_id % 7 <> 0", 20260907)
oracle("pilot_selection", " ".join(PILOT), picked(PILOT, "pilot_"))
oracle("next_batch", " ".join(NEXT), picked(NEXT, "batch001_"))
oracle(
    "boundary_template",
    " ".join(PILOT),
    f"""SELECT 'blinded' AS dataset, 'blinded:' || blind_sequence_id AS subject_id, blind_sequence_id AS sequence_id,
      'cycle_001' AS cycle_id, a.who AS annotator_id, '{TEMPLATE_NOTE}' AS notes
    FROM ({picked(PILOT, 'pilot_')}) p, (SELECT unnest(['annotator_1', 'annotator_2']) AS who) a""",
)
oracle(
    "batch_rules",
    "man",
    union(
        [
            ("row is development", broken("man", "split <> 'development'")),
            ("row is eligible", broken("man", "dataset NOT IN ('en', 'fr') OR exclusion_reason IS NOT NULL")),
            ("fold in range", broken("man", "NOT fold BETWEEN 0 AND 3")),
            ("checksum is sha-256", broken("man", "NOT regexp_matches(sha256, '^[0-9a-f]{64}$')")),
            ("frame key unique", repeated("man", "sequence_id, frame_index")),
            ("content unique", repeated("man", "sha256")),
        ]
    ),
)
cte(
    "aud",
    "sig elig cmp",
    """SELECT s.sample_id, s.sequence_id, s.dataset, s.split, e.phase_label AS original_provisional_label,
      CASE WHEN event_id % 43 = 0 THEN 'source_checksum_mismatch' END AS i1, CASE WHEN event_id % 47 = 0 THEN 'empty_foreground' END AS i2,
      c.sample_id IS NOT NULL AS boundary_comparison_available,
      coalesce(c.phase_label <> c.boundary_phase, false) AS boundary_disagreement,
      CASE WHEN s.exclusion_reason IS NOT NULL THEN 'source_excluded'
        WHEN s.dataset <> 'ds0' THEN 'incomplete_temporal_source_not_annotatable'
        WHEN event_id % 43 = 0 OR event_id % 47 = 0 THEN 'source_integrity_failure'
        WHEN event_id % 41 = 0 THEN 'chat_confirmed_ai_proposal_low_confidence'
        ELSE 'unverified_reference_foot_requires_sequence_review' END AS review_status
    FROM sig s LEFT JOIN (SELECT sample_id, phase_label FROM elig) e USING (sample_id) LEFT JOIN cmp c USING (sample_id)""",
)
oracle(
    "audit_records",
    "aud",
    """SELECT sample_id, concat_ws(',', i1, i2) AS image_issues, original_provisional_label, review_status,
      boundary_comparison_available, boundary_disagreement FROM aud""",
)
oracle(
    "review_status",
    "aud",
    """SELECT 'review_status' AS kind, review_status AS value, count(*) AS frames FROM aud GROUP BY 2
    UNION ALL SELECT 'image_issue', i1, count(*) FROM aud WHERE i1 IS NOT NULL GROUP BY 2
    UNION ALL SELECT 'image_issue', i2, count(*) FROM aud WHERE i2 IS NOT NULL GROUP BY 2""",
)
oracle(
    "sequence_review_queue",
    "aud",
    """SELECT sequence_id, dataset, split, count(*) AS frames,
      count(*) FILTER (WHERE i1 IS NOT NULL OR i2 IS NOT NULL) AS image_issue_frames,
      count(*) FILTER (WHERE boundary_disagreement) AS boundary_disagreement_frames FROM aud GROUP BY 1, 2, 3""",
)

# --- lineage ------------------------------------------------------------------------------

SNAP = "SELECT doc_id, source || '/' || doc_id || '.txt' AS path, lang, source, n_chars AS size_bytes"
cte("snap_a", "", f"{SNAP}, sha256(text) AS sha256 FROM documents WHERE doc_id % 10 <> 0")
cte("snap_all", "", f"{SNAP}, sha256(text) AS sha256 FROM documents")
cte("snap_b", "", f"{SNAP}, sha256(CASE WHEN doc_id % 7 = 0 THEN text || '!' ELSE text END) AS sha256 FROM documents WHERE doc_id % 10 <> 1")
oracle(
    "snapshot_drift",
    "snap_a snap_b",
    """SELECT coalesce(a.path, b.path) AS path, CASE WHEN a.path IS NULL THEN 'added' WHEN b.path IS NULL THEN 'removed'
      WHEN a.sha256 <> b.sha256 THEN 'modified' ELSE 'unchanged' END AS change
    FROM snap_a a FULL JOIN snap_b b ON a.path = b.path""",
)
cte("src", "snap_a", "SELECT sha256, CASE WHEN doc_id % 9 = 0 THEN 'xx' ELSE lang END AS label FROM snap_a")
oracle(
    "lineage_summary",
    "snap_b src",
    """SELECT *, CASE WHEN unmatched_files = 0 AND label_conflicts = 0 THEN 'PASS' ELSE 'REVIEW' END AS result FROM (
      SELECT source AS collection, count(*) AS files, count(*) FILTER (WHERE n > 0) AS exact_content_matches,
        count(*) FILTER (WHERE n = 0) AS unmatched_files, count(*) FILTER (WHERE same > 0) AS label_agreements,
        count(*) FILTER (WHERE n > same) AS label_conflicts
      FROM (SELECT b.source, b.path, count(s.sha256) AS n, count(*) FILTER (WHERE s.label = b.lang) AS same
        FROM snap_b b LEFT JOIN src s ON s.sha256 = b.sha256 GROUP BY 1, 2) m GROUP BY 1) t""",
)
oracle(
    "duplicate_content_report",
    "snap_all",
    """SELECT a.path, a.sha256, copies, "group", classes, cross_class FROM snap_all a JOIN (
      SELECT sha256, count(*) AS copies, string_agg(DISTINCT source, ' | ' ORDER BY source) AS classes,
        CASE WHEN count(DISTINCT source) > 1 THEN 'YES' ELSE 'NO' END AS cross_class,
        'SRC-DUP-' || CASE WHEN row_number() OVER (ORDER BY sha256) < 1000 THEN
          lpad(CAST(row_number() OVER (ORDER BY sha256) AS VARCHAR), 3, '0')
          ELSE CAST(row_number() OVER (ORDER BY sha256) AS VARCHAR) END AS "group"
      FROM snap_all GROUP BY sha256 HAVING count(*) > 1) g USING (sha256)""",
)
oracle(
    "duplicate_storage",
    "snap_all",
    """SELECT count(*) AS groups, CAST(coalesce(sum(n), 0) AS BIGINT) AS copies,
      CAST(coalesce(sum(s - m), 0) AS BIGINT) AS recoverable_bytes
    FROM (SELECT count(*) AS n, sum(size_bytes) AS s, max(size_bytes) AS m FROM snap_all GROUP BY sha256 HAVING count(*) > 1) g""",
)
oracle(
    "inventory_rollup",
    "",
    """SELECT kind, CASE WHEN kind = 'category' THEN c ELSE e END AS value, files, size_bytes FROM (
      SELECT 'document' AS c, '.txt' AS e, count(*) AS files, CAST(sum(n_chars) AS BIGINT) AS size_bytes FROM documents
      UNION ALL SELECT 'page', '.html', count(*), CAST(sum(length(html)) AS BIGINT) FROM pages) t,
      (SELECT unnest(['category', 'extension']) AS kind) k""",
)
oracle(
    "extraction_verification",
    "snap_a snap_b",
    """SELECT *, CASE WHEN missing_files + extra_files + content_mismatches = 0 THEN 'PASS' ELSE 'REVIEW' END AS result FROM (
      SELECT coalesce(a.source, b.source) AS archive, count(a.path) AS archive_files, count(b.path) AS extracted_files,
        count(*) FILTER (WHERE a.sha256 = b.sha256) AS content_matches,
        count(*) FILTER (WHERE b.path IS NULL) AS missing_files, count(*) FILTER (WHERE a.path IS NULL) AS extra_files,
        count(*) FILTER (WHERE a.sha256 <> b.sha256) AS content_mismatches
      FROM snap_a a FULL JOIN snap_b b ON a.path = b.path GROUP BY 1) t""",
)
oracle(
    "collection_summary",
    "snap_all",
    """SELECT collection, CAST(sum(n) AS BIGINT) AS files, CAST(sum(s) AS BIGINT) AS size_bytes,
      string_agg(lang || '=' || n, '; ' ORDER BY lang) AS class_counts, count(*) AS subject_count
    FROM (SELECT source AS collection, lang, count(*) AS n, sum(size_bytes) AS s FROM snap_all GROUP BY 1, 2) t GROUP BY 1""",
)
oracle(
    "relocation_check",
    "snap_a snap_b",
    """SELECT m.path, m.new_path, CASE WHEN b.sha256 IS NULL THEN 'missing' WHEN b.sha256 = m.sha256 THEN 'verified'
      ELSE 'changed' END AS result
    FROM (SELECT path, sha256, CASE WHEN doc_id % 50 = 3 THEN 'kept/' || doc_id || '.txt' ELSE 'data/' || path END AS new_path FROM snap_a) m
    LEFT JOIN (SELECT sha256, CASE WHEN doc_id % 50 = 3 THEN 'kept/' || doc_id || '.txt' ELSE 'data/' || path END AS new_path FROM snap_b) b
      USING (new_path)""",
)

# --- vectors ------------------------------------------------------------------------------

_BITS = " || ".join(f"CASE WHEN embedding[{r * 8 + c + 2}] > embedding[{r * 8 + c + 1}] THEN '1' ELSE '0' END" for r in range(8) for c in range(7))
_HEX = " || ".join(f"substr('0123456789abcdef', 1 + 8 * CAST(bits[{i}] AS INT) + 4 * CAST(bits[{i + 1}] AS INT) + 2 * CAST(bits[{i + 2}] AS INT) + CAST(bits[{i + 3}] AS INT), 1)" for i in range(1, 57, 4))
oracle("difference_hash", "", f"SELECT vec_id, '00' || {_HEX} AS hash FROM (SELECT vec_id, {_BITS} AS bits FROM embeddings) b")
oracle(
    "vector_motion",
    "",
    """SELECT vec_id, round(list_sum(list_transform(m, lambda x: CAST(x AS DOUBLE))), 6) AS motion_sum,
      round(CAST(list_max(m) AS DOUBLE), 6) AS motion_max
    FROM (SELECT vec_id, list_transform(generate_series(1, len(embedding)), lambda i: abs(embedding[i] - prev[i])) AS m
      FROM (SELECT *, coalesce(lag(embedding) OVER (PARTITION BY vec_id // 8 ORDER BY vec_id), embedding) AS prev FROM embeddings) a) b""",
)

# --- hashes within a Hamming distance -----------------------------------------------------------

_OFTEN = ", ".join(f"length(t) - length(replace(t, '{c}', ''))" for c in "abcdefghijklmnopqrstuvwxyz")
_SKETCH = " || ".join(f"CASE WHEN n[{i + 1}] > n[{i + step + 1}] THEN '1' ELSE '0' END" for step, size in ((1, 25), (2, 24), (3, 15)) for i in range(size))
cte(
    "sketches",
    "",
    f"""SELECT lang, lang || ':' || source AS subject_id, bits, array_to_string(list_transform(range(0, 16), lambda i:
        substr('0123456789abcdef', 1 + 8 * CAST(bits[4 * i + 1] AS INT) + 4 * CAST(bits[4 * i + 2] AS INT) + 2 * CAST(bits[4 * i + 3] AS INT) + CAST(bits[4 * i + 4] AS INT), 1)), '') AS sketch
    FROM (SELECT *, {_SKETCH} AS bits FROM (SELECT lang, source, [{_OFTEN}] AS n FROM (SELECT lang, source, lower(coalesce(text, '')) AS t FROM documents) d) c) b""",
)
cte(
    "sketch_links",
    "sketches",
    """SELECT a.sketch AS u, b.sketch AS v FROM (SELECT DISTINCT sketch, bits FROM sketches) a, (SELECT DISTINCT sketch, bits FROM sketches) b
    WHERE bit_count(xor(CAST(a.bits AS BIT), CAST(b.bits AS BIT))) <= 2""",
)
cte(
    "sketch_walk",
    "sketch_links",
    """SELECT u, v FROM sketch_links UNION SELECT w.u, l.v FROM sketch_walk w JOIN sketch_links l ON w.v = l.u""",
)
cte("sketch_groups", "sketch_walk", "SELECT u AS sketch, min(v) AS near_group FROM sketch_walk GROUP BY 1")
oracle("near_hash_groups", "sketch_groups sketches", "SELECT sketch, count(*) AS samples, any_value(near_group) AS near_group FROM sketches JOIN sketch_groups USING (sketch) GROUP BY 1")
oracle(
    "near_hash_audit",
    "sketch_groups sketches",
    """SELECT near_group, count(*) AS samples, count(DISTINCT subject_id) AS subjects, count(DISTINCT lang) AS datasets, count(DISTINCT subject_id) AS sequences
    FROM sketches JOIN sketch_groups USING (sketch) GROUP BY 1 HAVING count(*) > 1""",
)
for _name in ("near_hash_groups", "near_hash_audit"):
    ORACLES[_name] = ORACLES[_name].replace("WITH ", "WITH RECURSIVE ", 1)

# --- keys that must be unique, members of archives ------------------------------------------------

cte("kdocs0", "", "SELECT doc_id, lang, source FROM documents WHERE doc_id % 89 <> 3")
cte("kmarks0", "", "SELECT doc_id, max(quality) AS quality, max(toxic) AS toxic FROM labels GROUP BY 1")
cte("kdocs", "kdocs0", "SELECT * FROM kdocs0 UNION ALL SELECT * FROM kdocs0 WHERE doc_id % 97 = 5")
cte("kmarks", "kmarks0", "SELECT * FROM kmarks0 UNION ALL SELECT * FROM kmarks0 WHERE doc_id % 101 = 7")
oracle(
    "one_to_one_rules",
    "kdocs kmarks",
    """SELECT unnest(['left key unique', 'right key unique', 'left key has a partner', 'right key has a partner']) AS rule,
      unnest([(SELECT count(*) FROM (SELECT doc_id FROM kdocs GROUP BY 1 HAVING count(*) > 1)), (SELECT count(*) FROM (SELECT doc_id FROM kmarks GROUP BY 1 HAVING count(*) > 1)),
        (SELECT count(DISTINCT doc_id) FROM kdocs WHERE doc_id NOT IN (SELECT doc_id FROM kmarks)),
        (SELECT count(DISTINCT doc_id) FROM kmarks WHERE doc_id NOT IN (SELECT doc_id FROM kdocs))]) AS violations""",
)
oracle(
    "one_to_one_join",
    "kdocs kmarks",
    """SELECT d.doc_id, lang, source, quality, toxic FROM (SELECT DISTINCT * FROM kdocs WHERE doc_id % 17 <> 1) d
    LEFT JOIN (SELECT DISTINCT * FROM kmarks WHERE doc_id % 19 <> 1) m ON d.doc_id = m.doc_id""",
)
cte(
    "members",
    "",
    r"""SELECT page_id, regexp_extract(url, '^[a-z]+://([^/]*)', 1) AS archive, length(html) AS size_bytes, CASE page_id % 13 WHEN 1 THEN '../' || tail
      WHEN 2 THEN 'a/b/../../../' || tail WHEN 3 THEN '/' || tail WHEN 4 THEN 'a/../b/./' || tail WHEN 5 THEN 'same.html' WHEN 6 THEN 'c:\\' || tail ELSE tail END AS member
    FROM (SELECT *, regexp_replace(url, '^[a-z]+://[^/]*/*', '') AS tail FROM pages) p""",
)
oracle(
    "archive_member_rules",
    "members",
    """SELECT unnest(['member stays in its folder', 'member listed once', 'archive count as expected', 'existing file has the member''s size']) AS rule,
      unnest([(SELECT count(*) FROM members WHERE page_id % 13 IN (1, 2, 3, 6)),
        (SELECT count(*) FROM (SELECT 1 FROM members GROUP BY archive, member HAVING count(*) > 1)),
        (SELECT CAST(count(DISTINCT archive) <> 12 AS BIGINT) FROM members),
        (SELECT count(*) FROM members m JOIN (SELECT archive, member, max(size_bytes + CASE WHEN page_id % 9 = 0 THEN 1 ELSE 0 END) AS size FROM members
          WHERE page_id % 3 = 0 GROUP BY 1, 2) t USING (archive, member) WHERE size <> size_bytes)]) AS violations""",
)

# --- perceptual hash: the low 8 x 8 of a 32 x 32 cosine transform of an 8 x 8 grid whose cells are 4 x 4 points -----

cte(
    "cosines",
    "",
    """SELECT f, r, sum(cos(pi() * f * (2 * i + 1) / 64) * sqrt(2.0 / 32) * CASE WHEN f = 0 THEN 1 / sqrt(2.0) ELSE 1 END) AS c
    FROM (SELECT unnest(range(0, 8)) AS f), (SELECT unnest(range(0, 32)) AS i, i // 4 AS r) GROUP BY 1, 2""",
)
cte("points", "", "SELECT vec_id, (k - 1) // 8 AS r, (k - 1) % 8 AS s, CAST(embedding[k] AS DOUBLE) AS v FROM embeddings, (SELECT unnest(range(1, 65)) AS k)")
cte("halfway", "points cosines", "SELECT vec_id, f, s, sum(c * v) AS v FROM points JOIN cosines USING (r) GROUP BY 1, 2, 3")
cte("waves", "halfway cosines", "SELECT vec_id, h.f, g.f AS g, sum(g.c * h.v) AS v FROM halfway h JOIN cosines g ON g.r = h.s GROUP BY 1, 2, 3")
cte("middles", "waves", "SELECT vec_id, median(v) AS m FROM waves WHERE f > 0 OR g > 0 GROUP BY 1")
oracle(
    "perceptual_hash",
    "waves middles",
    """SELECT vec_id, string_agg(substr('0123456789abcdef', 1 + digit, 1), '' ORDER BY place) AS hash FROM (
      SELECT vec_id, (8 * f + g) // 4 AS place, CAST(sum(CASE WHEN v > m THEN 8 >> ((8 * f + g) % 4) ELSE 0 END) AS INTEGER) AS digit
      FROM waves JOIN middles USING (vec_id) GROUP BY 1, 2) d GROUP BY 1""",
)

"""Files, publication and the jobs from end to end, on files written here."""

import math
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from seqcurate import jobs, schemas as S
from seqcurate.functions import arrays
from seqcurate.operators import audit, joins, rules, runs
from seqcurate.session import release_staged, stage, stage_root
from seqcurate.sources import files, publish, tables

P = S.PHASES


def test_dct_basis_is_orthonormal():
    flat = arrays.dct_basis(32)
    assert np.allclose(flat @ flat.T, np.eye(32))


def test_difference_hash_column_equals_bits(spark):
    grid = [float((i * 7) % 11) for i in range(64)]
    got = spark.createDataFrame([(grid,)], "g array<double>").select(arrays.difference_hash(F.col("g"), 8)).first()[0]
    bits = "".join("1" if grid[r * 8 + c + 1] > grid[r * 8 + c] else "0" for r in range(8) for c in range(7))
    assert got == format(int(bits, 2), "016x")


def test_named_frames(spark, tmp_path):
    root = tmp_path / "named" / "heel"
    root.mkdir(parents=True)
    (root / "ann-00_2-048.png").write_bytes(b"three")
    (root / "ann-00_2-049.PNG").write_bytes(b"four")
    (root / "notes.txt").write_text("x")
    df = files.scan_named_frames(spark, str(tmp_path / "named"), str(tmp_path), "n", "n")
    rows = {r["frame_index"]: r for r in df.drop("content").collect()}
    assert sorted(rows) == [48, 49]
    row = rows[48]
    assert (row["subject_id"], row["sequence_id"], row["view"], row["legacy_label"]) == ("n:ann", "n:ann:00:2", "00", "heel")
    assert row["relative_path"] == "named/heel/ann-00_2-048.png"
    import hashlib

    assert row["sha256"] == hashlib.sha256(b"three").hexdigest()
    assert row["sample_id"] == hashlib.sha256(b"n:named/heel/ann-00_2-048.png").hexdigest()[:20]
    (root / "odd.png").write_bytes(b"three")
    with pytest.raises(Exception, match="Unrecognized frame name"):
        files.scan_named_frames(spark, str(tmp_path / "named"), str(tmp_path), "n", "n").select("subject_id").collect()


def test_archive_members(spark):
    rows = [
        ("001.zip", "001/fn00/001.png", 3, False), ("001.zip", "001/fn00/002.png", 4, False), ("002.zip", "../out.png", 1, True), ("002.zip", "a/../../b", 1, True),
        ("002.zip", "a/../b", 1, False), ("002.zip", "/etc/x", 1, True), ("002.zip", "C:x", 1, True), ("002.zip", "a\\..\\..\\b", 1, True), ("002.zip", "./..hidden/...", 1, False),
        ("002.zip", "..", 1, True), ("002.zip", None, 1, True), ("002.zip", "a/b/..", 1, False), ("002.zip", "a/b/..", 1, False),
    ]
    members = spark.createDataFrame([r[:3] for r in rows], "archive string, member string, size_bytes bigint")
    marked = members.select(F.coalesce(rules.leaves_folder(F.col("member")), F.lit(True))).collect()
    assert [r[0] for r in marked] == [r[3] for r in rows]
    existing = spark.createDataFrame([("001.zip", "001/fn00/001.png", 9)], "archive string, member string, size_bytes bigint")
    got = {r["rule"]: r["violations"] for r in rules.archive_members(members, existing, 2).collect()}
    assert got == {"member stays in its folder": 7, "member listed once": 1, "archive count as expected": 0, "existing file has the member's size": 1}
    with pytest.raises(S.RuleViolation, match="stays in its folder"):
        jobs.check_archives(members, expected=2)
    assert jobs.check_archives(members.limit(2), expected=1).count() == 2


def test_one_to_one_joins(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y"), (None, "z")], "k int, a string")
    b = spark.createDataFrame([(2, None, "v"), (3, 1.5, "w"), (None, 0.5, "n")], "k int, b double, `c.d` string")
    assert sorted(map(tuple, joins.one_to_one(a, b, "k").collect()), key=str) == [(2, "y", None, "v"), (None, "z", 0.5, "n")]
    assert joins.one_to_one(a, b, ["k"], "left").count() == 3 and joins.one_to_one(a, b, "k", "left").filter("k = 1").first()["b"] is None
    for left, right, side in ((a.unionByName(a.filter("k = 1")), b, "left"), (a, b.unionByName(b.filter("k = 3")), "right")):
        with pytest.raises(Exception, match=f"Repeated key on the {side} side"):
            joins.one_to_one(left, right, "k").select("k").count()
    with pytest.raises(ValueError, match="Both sides"):
        joins.one_to_one(a, a, "k")
    assert joins.one_to_one(a.limit(0), b, "k").count() == 0
    got = {r["rule"]: r["violations"] for r in joins.one_to_one_report(a.unionByName(a), b, "k").collect()}
    assert got == {"left key unique": 3, "right key unique": 0, "left key has a partner": 1, "right key has a partner": 1}


def test_names_with_blanks_and_percent_signs(spark, tmp_path):
    root = tmp_path / "raw" / "001" / "fn00"
    root.mkdir(parents=True)
    for name in ("a 1.png", "b%202.png"):
        (root / name).write_bytes(b"x")
    rows = files.scan_path_frames(spark, str(tmp_path / "raw"), str(tmp_path), "w").select("relative_path").collect()
    assert sorted(r[0] for r in rows) == ["raw/001/fn00/a 1.png", "raw/001/fn00/b%202.png"]


def test_text_tables(spark, tmp_path):
    head = ",".join(S.HUMAN_BOUNDARY_COLUMNS)
    path = tmp_path / "b.csv"
    path.write_text(head + "\nd,d:1,q,c,52,58,66,74,88,a,high,\nd,d:1,q,c2,1,2,x,4,5,a,high, \n")
    loose = tables.read_human_boundaries(spark, str(path), strict=False)
    assert {r["rule"]: r["violations"] for r in rules.boundaries(loose).collect()}["boundaries are integers"] == 1
    assert loose.filter("notes is null").count() == 2
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        tables.read_human_boundaries(spark, str(path)).collect()
    (tmp_path / "r.json").write_text('{"version": 1, "records": [{"a": 1, "b": "x"}, {"a": 2, "b": "y"}]}')
    assert tables.read_records(spark, str(tmp_path / "r.json")).count() == 2


def test_publication_is_all_or_nothing(spark, tmp_path):
    df, out = spark.range(10), str(tmp_path / "out")
    ready = publish.publish(spark, out, {"t": df}, {"note": "n"})
    assert ready["tables"]["t"]["rows"] == 10 and publish.read_ready(spark, out)["note"] == "n" and ready["published_utc"].endswith("+00:00")
    assert publish.read_table(spark, out, "t").count() == 10
    assert {k: ready["tables"]["t"][k] for k in ("rows", "digest")} == publish.table_digest(df)
    with pytest.raises(FileExistsError):
        publish.publish(spark, out, {"t": df})
    broken = df.select(F.raise_error(F.lit("boom")).cast("string").alias("x"))
    bad = str(tmp_path / "bad")
    with pytest.raises(Exception, match="boom"):
        publish.publish(spark, bad, {"t": df, "u": broken})
    with pytest.raises(FileNotFoundError):
        publish.read_ready(spark, bad)
    assert publish.published(spark, bad) == [] and publish.unreferenced(spark, bad).count() > 0
    publish.publish(spark, bad, {"t": df})
    assert publish.published(spark, bad) == [0] and publish.read_table(spark, bad, "t").count() == 10
    publish.write(df, str(tmp_path / "lines"), publish.JSON_LINES)
    publish.write(df, str(tmp_path / "text"), publish.TEXT_TABLE)
    assert spark.read.json(str(tmp_path / "lines")).count() == 10
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS"):
        publish.write(df, str(tmp_path / "lines"))


def test_versions_of_a_release(spark, tmp_path):
    out = str(tmp_path / "r")
    publish.publish(spark, out, {"t": spark.range(3)})
    publish.publish(spark, out, {"t": spark.range(5)}, version=1)
    assert publish.published(spark, out) == [0, 1]
    assert [publish.read_table(spark, out, "t", v).count() for v in (None, 0, 1)] == [5, 3, 5]
    assert publish.unreferenced(spark, out).count() == 0
    assert not any(r["violations"] for r in publish.verify(spark, out).collect())


def test_two_writers_never_commit_one_version(spark, tmp_path, monkeypatch):
    """Both orders of the steps of two writers: at most one commits, and a failed one can be repeated."""
    put = publish._note

    def rival_claims(*args):
        put(*args)
        if args[2] == "claims":  # the other writer's claim is written before this one looks
            put(spark, args[1], "claims", args[3], "f" * 32, "claimed")

    out = str(tmp_path / "a")
    monkeypatch.setattr(publish, "_note", rival_claims)
    with pytest.raises(FileExistsError, match="another writer"):
        publish.publish(spark, out, {"t": spark.range(1)})
    monkeypatch.setattr(publish, "_note", put)
    assert publish.published(spark, out) == []
    with pytest.raises(FileExistsError, match="next version"):  # the other one may still commit
        publish.publish(spark, out, {"t": spark.range(1)})
    put(spark, out, "withdrawn", 0, "f" * 32, "withdrawn")
    assert publish.publish(spark, out, {"t": spark.range(1)})["status"] == "READY"

    import threading

    done, out = [], str(tmp_path / "b")

    def writer(n):
        try:
            done.append(publish.publish(spark, out, {"t": spark.range(n)})["tables"]["t"]["rows"])
        except FileExistsError:
            done.append(None)

    threads = [threading.Thread(target=writer, args=(n,)) for n in (1, 2, 3)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    won = [n for n in done if n]
    assert len(done) == 3 and len(won) <= 1 and len(publish.published(spark, out)) == len(won)
    if won:
        assert publish.read_table(spark, out, "t").count() == won[0]


def test_rows_have_to_be_accounted_for(spark, tmp_path):
    out = str(tmp_path / "r")
    tables_of = {"a": spark.range(6), "b": spark.range(3)}
    with pytest.raises(S.RuleViolation, match="not accounted for"):
        publish.publish(spark, out, tables_of, accept=lambda seen: publish.accounted(seen, 10, "a", "b"))
    assert publish.published(spark, out) == []
    ready = publish.publish(spark, out, tables_of, accept=lambda seen: publish.accounted(seen, 9, "a", "b"))
    assert ready["accounted_manifest_frames"] == 9


def test_observed_digests_equal_read_ones(spark, tmp_path):
    df = spark.range(1000).select("id", F.when(F.col("id") % 7 != 0, F.col("id") / 3).alias("x"), F.array("id").alias("l"), (F.col("id") % 3).cast("int").alias("k"))
    sink = publish.Sink(shape=lambda t: t.repartition(5, "x"), partition_by=("k",), measures={"seventh": F.count_if(F.col("x").isNull())})
    seen = publish.write(df, str(tmp_path / "t"), sink)
    assert {k: seen[k] for k in ("rows", "digest")} == publish.table_digest(spark.read.parquet(str(tmp_path / "t"))) and seen["seventh"] == 143
    none = publish.write(df.limit(0), str(tmp_path / "none"))
    assert none["rows"] == 0 and none["digest"] == publish.table_digest(df.limit(0))["digest"]


def test_tree_difference_finds_the_file(spark):
    rows = [(f"{a}/{b}/{k}.png", f"h{a}{b}{k}") for a in "xy" for b in "pq" for k in range(20)] + [("top.png", "t")]
    frame = lambda r: spark.createDataFrame(r, "path string, sha256 string")
    got = lambda found: sorted(map(tuple, audit.tree_difference(frame(rows), frame(found)).collect()))
    assert got(rows) == []
    assert got([(p, "other" if p == "y/p/7.png" else h) for p, h in rows]) == [("y/p/7.png", "changed")]
    assert got([*rows[1:], ("z/new.png", "n"), ("top2.png", "t")]) == [("top2.png", "extra"), ("x/p/0.png", "missing"), ("z/new.png", "extra")]
    kept = audit.folder_digests(frame(rows))
    assert audit.tree_difference(frame(rows), frame(rows[:-1]), kept).collect()[0]["state"] == "missing"


def test_staged_tables_use_the_shared_folder():
    class Session:
        def __init__(self, master, folder=None):
            class Context:
                applicationId = f"app-{master}"

                def getCheckpointDir(self):
                    return None

            self.sparkContext = Context()
            self.sparkContext.master = master
            self.conf = {"spark.checkpoint.dir": folder} if folder else {}

    assert stage_root(Session("spark://host", "hdfs:///shared/")) == "hdfs:///shared"
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        stage_root(Session("spark://host"))
    assert os.path.isdir(stage_root(Session("local[2]")))


@pytest.fixture(scope="module")
def workspace(tmp_path_factory):
    """7 subjects x 2 walks x 30 frames in folders."""
    root = tmp_path_factory.mktemp("ws")
    for subject in range(1, 8):
        for code in ("fn00", "fq01"):
            folder = root / "raw" / f"{subject:03d}" / code
            folder.mkdir(parents=True)
            for i in range(30):
                (folder / f"{i:03d}.png").write_bytes(f"{subject} {code} {i}".encode())
    return root


@pytest.fixture(scope="module")
def features(spark):
    """Legs opening every 10 frames; one file was unreadable and one is not described."""
    rows = [
        (f"raw/{subject:03d}/{code}/{i:03d}.png", not (subject == 3 and i == 9), 30, 0.4 + 0.3 * math.cos(2 * math.pi * (i - 5) / 10), f"{i % 10:016x}")
        for subject in range(1, 8) for code in ("fn00", "fq01") for i in range(30) if (subject, code, i) != (4, "fn00", 8)
    ]
    return spark.createDataFrame(rows, "relative_path string, readable boolean, foreground_pixels bigint, feature double, perceptual_hash string")


def test_jobs_from_files_to_summaries(spark, workspace, features, tmp_path):
    manifest = stage(jobs.build_manifest(spark, None, str(workspace / "raw"), str(workspace), features, {"path": "walks"}), "m")
    with pytest.raises(Exception, match="Repeated key on the right side"):
        jobs.build_manifest(spark, None, str(workspace / "raw"), str(workspace), features.unionByName(features.limit(1)))
    assert manifest.count() == 420 and manifest.filter("duplicate_group is not null").count() == 0
    assert jobs.manifest_rows(manifest).columns == list(S.MANIFEST_COLUMNS)
    checks, totals = jobs.validate_data(manifest)
    rules.raise_if_any(checks)
    assert totals.first()["sequences"] == 14
    assert jobs.audit_duplicates(manifest)[0].first()["exact_groups"] == 0

    split = jobs.make_splits(manifest)
    assert split.filter("split = 'test'").select("subject_id").distinct().count() == 2
    done = jobs.auto_annotate(spark, split, str(tmp_path / "labels"), "v1", "walks")
    assert done["labeled_frames"] == 420 and done["accounted_manifest_frames"] == 420
    assert done["confidence_counts"] == {"medium": 420}
    with pytest.raises(FileExistsError):
        jobs.auto_annotate(spark, split, str(tmp_path / "labels"), "v1", "walks")
    assert done["sequences"] == 14 and done["subjects"] == 7 and sum(done["phase_label_counts"].values()) == 420
    lost = split.withColumn("frame_index", F.when((F.col("subject_id") != "walks:002") | (F.col("frame_index") < 29), F.col("frame_index")))
    short = jobs.auto_annotate(spark, lost, str(tmp_path / "short"), "v1", "walks")
    assert (short["labeled_frames"], short["excluded_frames"], short["accounted_manifest_frames"]) == (418, 2, 420)
    assert {r["provisional_exclusion_reason"] for r in publish.read_table(spark, str(tmp_path / "short"), "excluded_samples").collect()} == {"missing_frame_order"}
    named, bounds = (publish.read_table(spark, str(tmp_path / "labels"), t) for t in ("frame_labels", "cycle_boundaries"))
    assert jobs.repair_boundaries(spark, named, bounds, str(tmp_path / "fixed"))["changed_boundary_records"] == 0

    found = files.inventory(spark, str(workspace / "raw"), str(workspace))
    expected = {"copied_files": 5 * 300 + 120, "test_frames": 120, "withheld_low_confidence_frames": 0}
    jobs.prepare_training_data(spark, split, named, str(tmp_path / "prepared"), ["walks"], expected=expected, files_found=found)
    report = jobs.validate_prepared_data(spark, str(tmp_path / "prepared"), found)
    assert not any(r["violations"] for r in report.filter("rule <> 'withheld confidence level'").collect())
    other = found.withColumn("sha256", F.when(F.col("path").endswith("003/fn00/004.png"), "0" * 64).otherwise(F.col("sha256")))
    broken = {r["rule"]: r["violations"] for r in jobs.validate_prepared_data(spark, str(tmp_path / "prepared"), other).collect()}
    assert broken["no referenced file changed"] == 1 and broken["no referenced file missing"] == broken["no referenced file extra"] == 0
    for change, message in (
        ({"phase_label": F.lit("run")}, "label in vocabulary"),
        ({"split": F.lit("test")}, "split unchanged"),
        ({"sample_id": F.lit("same")}, "sample_id unique"),
    ):
        with pytest.raises(S.RuleViolation, match=message):
            jobs.prepare_training_data(spark, split, named.withColumns(change), str(tmp_path / "no"), ["walks"])
    with pytest.raises(S.RuleViolation, match="referenced file exists"):
        missing = found.filter(~F.col("path").endswith("005.png"))
        jobs.prepare_training_data(spark, split, named, str(tmp_path / "no"), ["walks"], files_found=missing)
    with pytest.raises(S.RuleViolation, match="count mismatch"):
        jobs.prepare_training_data(spark, split, named, str(tmp_path / "no"), ["walks"], expected={"test_frames": 1})
    assert not (tmp_path / "no").exists()

    prepared = publish.read_table(spark, str(tmp_path / "prepared"), "views").filter("fold_view = 0")
    variants = {}
    for model in ("majority", "cycle_prior"):
        variants[model] = {"role": "baseline", "runs": {}}
        for fold in range(5):
            preds = jobs.train_baseline(prepared, model, fold, source="provisional", allow_provisional=True)
            run = f"{model}-{fold}"
            variants[model]["runs"][str(fold)] = run
            folder = tmp_path / "runs" / run
            folder.mkdir(parents=True)
            preds.toPandas().to_csv(folder / "predictions.csv", index=False)
            (folder / "learning_curves.csv").write_text("epoch,validation_loss\n1,0.4\n2,0.2\n3,0.3\n")
            (folder / "config.yaml").write_text(
                f"study:\n  name: x\ntraining_run:\n  fold: {fold}\n  evaluation_split: validation\n  test_accessed: false\n"
            )
    canonical = (
        prepared.filter("split = 'development'")
        .withColumnRenamed("provisional_label", "y_true")
        .withColumnRenamed("provisional_source", "label_source")
        .withColumnRenamed("provisional_version", "annotation_version")
        .drop("annotation_confidence")
        .withColumnRenamed("provisional_confidence", "annotation_confidence")
    )
    want = {"folds": [0, 1, 2, 3, 4], "samples": 300, "subjects": 5}
    out = str(tmp_path / "summary")
    ready = jobs.aggregate_results(spark, str(tmp_path / "runs"), variants, canonical, out, want, [("cycle_prior", "majority")], 100)
    assert ready["status"] == "READY" and ready["variants"] == 2
    scores = {r["variant"]: r["frame_macro_f1"] for r in publish.read_table(spark, out, "model_summary").collect()}
    assert scores["cycle_prior"] > 0.8 > scores["majority"]
    assert publish.read_table(spark, out, "paired_comparisons").first()["estimate"] > 0
    best = publish.read_table(spark, out, "best_epochs").collect()
    assert len(best) == 10 and {r["best_epoch"] for r in best} == {2}
    assert {(r["variant"], r["epochs"], r["runs"]) for r in publish.read_table(spark, out, "training_length").collect()} == {(m, 2.0, 5) for m in variants}
    stray = tmp_path / "runs" / "not-registered"
    stray.mkdir()
    (stray / "predictions.csv").write_text("other,header\n1,2\n")
    registry = tables.registry_table(spark, variants)
    preds, _ = tables.read_registered_runs(spark, str(tmp_path / "runs"), registry)
    assert preds.count() == 600 and tables.read_curves(spark, str(tmp_path / "runs"), registry).count() == 30
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        tables.read_curves(spark, str(tmp_path / "runs"), tables.registry_table(spark, {"x": {"runs": {"0": "gone"}}}))
    (tmp_path / "runs" / "majority-3" / "config.yaml").write_text("training_run:\n  fold: 2\n  evaluation_split: validation\n")
    with pytest.raises(S.RuleViolation, match="development validation"):
        jobs.aggregate_results(spark, str(tmp_path / "runs"), variants, canonical, str(tmp_path / "again"), want, (), 100)

    test = jobs.train_baseline(prepared, "cycle_prior", mode="test", source="provisional", allow_provisional=True, allow_test=True)
    assert jobs.evaluate(test, 100)["overall"].first()["samples"] == 120
    with pytest.raises(S.RuleViolation, match="sample_id unique"):
        jobs.evaluate(test.unionByName(test), 100)
    jobs.result_tables(spark, test, str(tmp_path / "results"), 100)
    whole = publish.read_table(spark, str(tmp_path / "results"), "overall").first()
    assert whole["samples"] == 120 and whole["lower"] <= whole["subject_macro_f1"] <= whole["upper"]
    assert publish.read_table(spark, str(tmp_path / "results"), "dataset_condition").agg(F.sum("samples")).first()[0] == 120
    again = test.unionByName(test.orderBy("sample_id").limit(1))
    with pytest.raises(S.RuleViolation, match=f"Repeated samples, e.g. {test.agg(F.min('sample_id')).first()[0]}"):
        jobs.result_tables(spark, again, str(tmp_path / "no"), 100)
    with pytest.raises(S.RuleViolation, match="prediction table is empty"):
        jobs.evaluate(test.limit(0), 100)
    with pytest.raises(S.RuleViolation, match="label table is empty"):
        jobs.prepare_training_data(spark, split, named.limit(0), str(tmp_path / "no"), ["walks"])


def test_audit_job(spark, workspace, features, tmp_path):
    scanned = jobs.build_manifest(spark, None, str(workspace / "raw"), str(workspace), features, {"path": "walks"})
    split = jobs.make_splits(scanned)
    made = jobs.label_sequences(split, "v1")
    named, bounds = stage(made["frame_labels"], "n"), stage(made["cycle_boundaries"], "b")
    wanted = split.select("sample_id", "relative_path", F.when(F.col("frame_index") == 7, "0" * 64).otherwise(F.col("sha256")).alias("sha256"))
    extra = spark.createDataFrame([("z1", "../up.png", "0"), ("z2", "raw/none.png", "0")], "sample_id string, relative_path string, sha256 string")
    issues = audit.image_issues(wanted.unionByName(extra), scanned, features).filter(F.size("image_issues") > 0)
    kinds = {r["k"]: r["count"] for r in issues.select(F.explode("image_issues").alias("k")).groupBy("k").count().collect()}
    assert kinds == {"source_checksum_mismatch": 14, "path_outside_workspace": 1, "missing_or_unreadable_image": 1 + 2 + 1}
    reviewed = named.limit(3).select("sample_id", F.lit(P[0]).alias("label"))
    with pytest.raises(S.RuleViolation, match="differ, e.g. in"):
        jobs.audit_release(spark, split, named.filter("frame_index > 0"), bounds, reviewed, issues, str(tmp_path / "a"), ["walks"], True)
    with pytest.raises(S.RuleViolation, match="allow_test"):
        jobs.audit_release(spark, split, named, bounds, reviewed, issues, str(tmp_path / "a"), ["walks"])
    jobs.audit_release(spark, split, named, bounds, reviewed, issues, str(tmp_path / "a"), ["walks"], True)
    queue = publish.read_table(spark, str(tmp_path / "a"), "sequence_review_queue")
    got = queue.agg(F.sum("frames"), F.sum("image_issue_frames"), F.sum("boundary_disagreement_frames")).first()
    assert tuple(got) == (420, 14 + 2 + 1, 0)
    assert publish.read_table(spark, str(tmp_path / "a"), "frame_audit").count() == 420


def _walks(spark, subjects=16):
    """Manifest rows of ``subjects`` x 4 condition families x 40 frames."""
    rows = [
        (f"w:{s}", f"w:{s}:{c}", c, f, f"{s}-{c}-{f}", f"raw/{s}/{c}/{f}.png", f"{s}{c}{f}".encode().hex().ljust(64, "0"), "development" if s else "test", s % 5 if s else None)
        for s in range(subjects) for c in ("fn00", "fs00", "fq00", "fb00") for f in range(40)
    ]
    kind = "subject_id string, sequence_id string, condition string, frame_index bigint, sample_id string, relative_path string, sha256 string, split string, fold int"
    return spark.createDataFrame(rows, kind).select("*", F.lit("walks").alias("dataset"), F.lit(None).cast("string").alias("exclusion_reason"))


def test_annotation_jobs(spark):
    frames = _walks(spark)
    options = {"dataset": ["walks"]}
    selected, template, digest = jobs.annotation_pilot(frames, 2, **options)
    assert selected.count() == 8 and template.count() == 16 and digest.first()["entries"] == 8 * 40
    batch, mine = jobs.next_annotation_batch(frames, selected.select("subject_id"), ["walks"], 1)
    assert batch.count() == 4 and mine.count() == 160 and batch.join(selected, "subject_id", "left_semi").count() == 0

    marks = [(f"c{k}", 100 * k, 100 * k + 5, 100 * k + 12, 100 * k + 25, 100 * k + 40) for k in range(1, 9)]
    rows = [("w", "w:1", "q", *m, who, "high", None) for m in marks for who in ("a", "b")]
    bounds = spark.createDataFrame(rows, S.HUMAN_BOUNDARIES_DDL)
    got = jobs.annotation_report(bounds, 25.0).first()
    assert (got["frames"], got["raw_agreement"], got["weighted_kappa"], got["status"], got["cycles"], got["mean_absolute_frames"]) == (320, 1.0, 1.0, "PASS", 8, 0.0)
    with pytest.raises(S.RuleViolation, match="exactly two annotators"):
        jobs.annotation_report(bounds.filter("annotator_id = 'a'"), 25.0)
    with pytest.raises(S.RuleViolation, match="one record per annotator and cycle"):
        jobs.annotation_report(bounds.unionByName(bounds), 25.0)


def test_review_is_finalised(spark, tmp_path):
    frames = _walks(spark)
    kind = "sequence string, cycle string, status string, reason string, confidence string, " + ", ".join(f"{m} bigint" for m in S.HUMAN_MARKS)
    records = [
        ("blind_1", "c1", "proposed", "clear", "low", 2, 5, 9, 14, 20), ("blind_1", "c2", "recommend_exclude", "cut off", "low", 20, 25, 29, 34, 60),
        ("blind_2", "c1", "unresolved", "?", "low", 0, 5, 9, 14, 20), ("blind_2", "c2", "proposed", "clear", "low", 10, 12, 15, 21, 30),
    ]
    key = spark.createDataFrame([("blind_1", "w:3:fn00", "w:3", "walks"), ("blind_2", "w:4:fq00", "w:4", "walks")], "blind_sequence_id string, sequence_id string, subject_id string, dataset string")
    made = lambda rows: spark.createDataFrame(rows, kind)
    found = frames.select(F.col("relative_path").alias("path"), "sha256")
    run = lambda name, rows=records, who=key, approved=(2, 38), files=found: jobs.finalise_review(
        spark, made(rows), who, frames, str(tmp_path / name), "r1", dict(zip(("cycles", "frames"), approved)), ["walks"], files
    )
    done = run("ok")
    assert done["decision_counts"] == {"accepted_ai_assisted_low_confidence": 2, "excluded_user_confirmed": 1, "on_hold_unresolved": 1} and done["accepted_subjects"] == 2
    published = publish.read_table(spark, str(tmp_path / "ok"), "frames")
    assert published.count() == 38 and published.filter("training_eligible or sequence_id is null").count() == 0
    assert {r["sequence_id"] for r in publish.read_table(spark, str(tmp_path / "ok"), "boundaries").collect()} == {"w:3:fn00", "w:4:fq00"}
    with pytest.raises(FileExistsError):
        run("ok")
    changed = found.withColumn("sha256", F.when(F.col("path") == "raw/3/fn00/7.png", "0" * 64).otherwise(F.col("sha256")))
    faults = [
        (dict(approved=(3, 38)), "accepted cycles as approved"), (dict(approved=(2, 37)), "accepted frames as approved"), (dict(who=key.unionByName(key.limit(1))), "blind id names one sequence"),
        (dict(rows=[(*records[0][:2], "odd", *records[0][3:]), *records[1:]], approved=(1, 20)), "decision status known"), (dict(who=key.limit(1)), "decision has an identity"),
        (dict(rows=[(*records[0][:9], 60), *records[1:]], approved=(2, 78)), "frame has a source row"), (dict(files=changed), "file checksum"), (dict(rows=[]), "review table is empty"),
        (dict(who=key.withColumn("sequence_id", F.replace("sequence_id", F.lit("w:3"), F.lit("w:0")))), "row is development"),
    ]
    for change, message in faults:
        with pytest.raises(S.RuleViolation, match=message):
            run("no", **change)
    twice = [*records, (*records[0][:1], "c9", *records[0][2:])]
    with pytest.raises(Exception, match="Repeated key on the left side"):
        run("no", rows=twice, approved=(3, 56))
    assert publish.published(spark, str(tmp_path / "no")) == []


def test_compressed_and_quoted_text(spark, tmp_path):
    import gzip

    head = ",".join(S.HUMAN_BOUNDARY_COLUMNS)
    (tmp_path / "b.csv").write_text(head + '\nd,d:1,q,c,52,58,66,74,88,a,high,"two\nlines, ""quoted"""\n')
    assert tables.read_human_boundaries(spark, str(tmp_path / "b.csv")).first()["notes"] == 'two\nlines, "quoted"'
    columns = ",".join(S.MANIFEST_COLUMNS)
    with gzip.open(tmp_path / "m.csv.gz", "wt") as f:
        f.write(columns + "\n" + "".join(f"s{k},d,d:1,q,fn00,,{k}" + "," * (len(S.MANIFEST_COLUMNS) - 7) + "\n" for k in range(200)))
    rows = tables.read_manifest(spark, str(tmp_path / "m.csv.gz"))
    assert rows.count() == 200 and rows.rdd.getNumPartitions() > 1
    only = tables.read_metadata_only(spark, str(tmp_path / "m.csv.gz"))
    assert tuple(only.columns) == tables.METADATA_COLUMNS and only.agg(F.sum("frame_index")).first()[0] == 199 * 100


def test_shared_tables_after_a_release(spark, sf_dir):
    from seqcurate.plans import surrogates

    before = surrogates.catalogue(spark, sf_dir).count()
    release_staged(spark)
    assert surrogates.catalogue(spark, sf_dir).count() == before


def test_release_of_staged_tables(spark):
    stage(spark.range(2), "gone")
    assert release_staged(spark) > 0
    assert release_staged(spark) == 0

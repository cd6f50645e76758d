"""Merkle fingerprints against a plain tree, and texts in scripts without Western full stops."""

import hashlib
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F
from seqcurate.llm import merkle


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def cut(sentence):
    if len(sentence) <= 100:
        return [sentence]
    units = re.findall(r"[!-~]+[\x20\t]*|[^!-~]", sentence)
    out = [""]
    for i, unit in enumerate(units):
        out[-1] += unit
        if zlib.crc32((unit + (units[i + 1] if i + 1 < len(units) else "")).encode()) % 8 == 0 or i % 64 == 63:
            out.append("")
    return [piece for piece in out if piece]


def tree(text):
    """(fingerprint, root, distinct leaves)"""
    sections, leaves = [[]], []
    for line in (text or "").split("\n"):
        own = [digest(piece)[:12] for sentence in re.split(r"(?<=[.!?])[\x20\t]+", line) for piece in cut(sentence)]
        whole = digest(digest(line) + "." + ".".join(own))
        sections[-1].append((whole, f"{whole[:12]}({'.'.join(own)})"))
        leaves += own
        if not line.strip(" ") or whole.startswith("0"):
            sections.append([])
    sections = [s for s in sections if s]
    digests = [digest(",".join(whole for whole, _ in s)) for s in sections]
    root = digest("/".join(digests))
    return root + ":" + "/".join(f"{d[:12]}={','.join(node for _, node in s)}" for d, s in zip(digests, sections)), root, set(leaves)


def like(a, b):
    (_, root, x), (_, other, y) = tree(a), tree(b)
    return 1.0 if root == other else len(x & y) / len(x | y)


def check(spark, docs):
    got = {r["doc_id"]: r for r in merkle.fingerprints(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    order = sorted(docs)
    for (doc_id, text), (_, following) in zip(order, order[1:] + order[:1]):
        text, following, r = text or "", following or "", got[doc_id]
        half = len(text) // 2
        edited = text[: len(text) - half] + following[:half]
        assert (r["n_chars"], r["edited_sha256"]) == (len(text), digest(edited))
        assert (r["fingerprint"], r["edited_fingerprint"]) == (tree(text)[0], tree(edited)[0])
        assert r["near_edited"] == pytest.approx(like(text, edited)) and r["near_next"] == pytest.approx(like(text, following))
    return got


def test_given_documents_equal_the_plain_tree(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    got = check(spark, [(r.doc_id, r.text) for r in rows])
    assert sum(r["near_edited"] > 0.2 for r in got.values()) > 0.9 * len(got)


def test_scripts_without_full_stops(spark):
    rng = random.Random(2)
    chinese = "".join(chr(0x4E00 + min(rng.randrange(3000), rng.randrange(3000))) for _ in range(800))
    docs = [(1, chinese), (2, "x " * 600), (3, "".join(rng.choice("กขคงจ ") for _ in range(700))), (4, " ".join(f"w{rng.randrange(999)}" for _ in range(400))), (5, "short"), (6, "😀" * 500), (7, None)]
    got = check(spark, docs)
    assert all(got[k]["near_edited"] > 0.3 for k in (1, 3, 4)) and got[2]["near_edited"] > 0  # one leaf many times over
    moved = spark.createDataFrame([(chinese, "新" + chinese)], "a string, b string")
    near = moved.select(merkle.likeness(merkle.fingerprint(F.col("a")), merkle.fingerprint(F.col("b"))).alias("l")).first()["l"]
    assert near > 0.5  # borders follow from the content, so an insertion moves few of them

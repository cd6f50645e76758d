"""Steps of the line dedup and of the links by signatures, and what a Python worker keeps between operators."""

import numpy as np
from pyspark.sql import functions as F
from seqcurate.llm import bpe, common, lines, minhash

LINES = ["a", "short", "Exactly8", "Über die Brücke, über den Fluß", "plain words in A LINE of their own " * 3, "x" * 40000, "漢字 😀 漢字 😀 漢字", "seventeen shingle line: abc"]


def test_lines_signed_together_as_alone():
    alone = [minhash.signature(lines._grams(lines._lower(lines.code_points(t.ljust(lines.CHARACTERS, "\0")))), lines.BANDS * lines.ROWS) for t in LINES]
    assert (lines.sign(LINES) == np.stack(alone)).all() and (lines.sign([LINES[4]]) == alone[4]).all()
    for texts in (LINES, [t for t in LINES if t.isascii()]):
        for text, made in zip(texts, lines.line_sets(texts), strict=True):
            assert (made == lines.line_set(text)).all() and len(made) <= max(1, len(text) - lines.CHARACTERS + 1)
    assert lines.line_sets([]) == []


def test_texts_are_asked_for_once(spark):
    text = "the quick brown fox jumps over the lazy dog and runs far away from here {}"
    rows = [(k, text.format(f"today, number {k}" if k < 3 else "x" * 90 + str(k))) for k in range(5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    split = lines.split_lines(docs)
    asked = []

    def texts_of(ids):
        asked.append(ids)
        return split.select("id", F.col("line").alias("text")).join(ids, "id")

    items = lines.signatures(split).where("n is not null").select("id", "n", "bands", "sig")
    roots = minhash.link(common.stage(items, "test-items"), texts_of, lines.line_sets, least=lines.LIKELY, sized=False)
    assert len(asked) == 1
    id_of = {r["doc_id"]: r["id"] for r in split.select("doc_id", "id").collect()}
    root_of = {r["node"]: r["root"] for r in roots.collect()}
    for part in ([0, 1, 2], [3, 4]):
        assert {root_of[id_of[k]] for k in part} == {min(id_of[k] for k in part)}


def test_lines_with_blanks_at_the_ends(spark):
    texts = ["\t one line of words \r\nother\n \x0b\f\n", "one line of words\n\nthird  ", None, "", " \t"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = [r[1:] for r in lines.dedup(docs).orderBy("doc_id").collect()]
    assert got == [(texts[0], 4, 0, False), ("\nthird  ", 3, 1, False), (None, 0, 0, False), ("", 1, 0, False), (" \t", 1, 0, False)]


def test_another_operator_lets_go_what_a_worker_keeps():
    common.take_over("bpe", bpe._CODEC.clear)
    bpe._CODEC["test"] = object()
    common.take_over("bpe", bpe._CODEC.clear)
    assert "test" in bpe._CODEC
    minhash.ranks_at(np.zeros(1, np.uint32), 4)
    common.take_over("minhash", minhash.forget)
    assert not bpe._CODEC and minhash._circle.cache_info().currsize
    common.take_over("quality")
    assert not minhash._circle.cache_info().currsize


def test_texts_beside_and_within_rows(spark):
    path = __import__("public_tokenizers").path("byte_bpe_50k.json")
    docs = spark.createDataFrame([(1, "Two words", 12), (2, None, None)], "doc_id long, words string, text int")
    for text, want in (("words", ["Two words", ""]), ("text", ["12", ""])):
        rows = bpe.encode(docs, path, text=text, decoded="decoded").orderBy("doc_id").collect()
        assert [r["decoded"] for r in rows] == want and [r["words"] for r in rows] == ["Two words", None]

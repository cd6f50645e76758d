"""Boilerplate: whole words, and a share of the line."""

import compare
import duckdb
import pytest
from seqcurate.llm import rules

PROSE = "we saw the new design in the catalog in our hall and had a dialog in town about how to spread more of the words on paper"
MENTION = "the editors explained at some length why the privacy policy of the old archive had to be written again before the first visitors came"
LINES = {
    PROSE: False,
    MENTION: False,
    "All rights reserved.": True,
    "Sign in, sign up": True,
    "sign in sign in": True,
    "Click here to read more about the town": True,
    "CLICK here!": True,
    "click\there": False,
    "This work is licensed under the GNU General Public License, version 3.": True,
    "catalog in": False,
    "": False,
}


def rows_of(spark):
    rows = [(k, line) for k, line in enumerate(LINES)] + [(100, PROSE + "\n" + "All rights reserved."), (101, None), (102, "Sign in\n" * 30)]
    return spark.createDataFrame(rows, "doc_id long, text string")


def test_boilerplate_lines(spark):
    got = {r["doc_id"]: r for r in rules.clean(rows_of(spark), ["doc_id"]).collect()}
    for k, (line, bad) in enumerate(LINES.items()):
        assert (got[k]["clean_text"] == "") == (bad or not line), line
        assert (got[k]["lost_chars"] > 0) == bad, line
    assert got[0]["kept"] and got[1]["kept"] and got[100]["kept"]
    assert got[100]["clean_text"] == PROSE and not got[102]["kept"] and got[101]["lost_chars"] == 0


def test_boilerplate_sql(spark, tmp_path):
    docs = rows_of(spark)
    path = str(tmp_path / "documents.parquet")
    docs.write.parquet(path)
    connection = duckdb.connect()
    connection.sql(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{path}/*.parquet')")
    assert compare.difference(rules.clean(docs, ["doc_id"]).drop("clean_text"), connection, rules.SQL) is None


@pytest.mark.parametrize("size", [1, 40])
def test_long_line(spark, size):
    """A phrase in a very long line is a mention, however often the line is prose around it."""
    docs = spark.createDataFrame([(1, " ".join([MENTION] * size))], "doc_id long, text string")
    assert rules.clean(docs, ["doc_id"]).first()["lost_chars"] == 0

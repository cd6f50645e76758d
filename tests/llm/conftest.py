import pytest
from pyspark.sql import types as T

SCHEMA = T.StructType(
    [T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType())]
    + [T.StructField(c, T.StringType()) for c in ("score", "kept", "ids", "line", "label", "_text", "root", "slot")]
)
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


def row(doc_id, text, lang="en", source="a"):
    return (doc_id, text, lang, source, *(["clash"] * 8))


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls, empty, long, tied and repeated rows, with extra columns of clashing names."""
    long_text = " ".join(f"{w}{k}" for k in range(3000) for w in WORDS[:5])
    rows = [
        row(1, " ".join(WORDS)), row(2, " ".join(WORDS)), row(3, " ".join([*WORDS, "extra"])), row(4, None), row(5, ""), row(6, " \t\n "),
        row(7, long_text), row(8, "Short line."), row(8, "Short line."), row(None, " ".join(WORDS)), row(9, "Mail a@b.org now", None, None),
        row(10, "漢字 😀 <|endoftext|> don't\r\n\n x", "zh", None),
    ]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def odd_labels(spark):
    return spark.createDataFrame(
        [(1, 1, 0), (2, 1, 0), (3, None, None), (None, 1, 1), (7, 0, 1), (8, 0, 1), (8, 1, 0), (99, 1, 1)], "doc_id long, quality int, toxic int"
    )

"""Document fingerprints: Merkle trees over sentences, paragraphs and sections.

Leaves are the sentences of a paragraph (line); a sentence of more than ``LONG`` characters (a script without
Western full stops, a table, code) is cut further after pairs of neighbouring units whose hash has a mark, a unit being a run of
printable ASCII or any other character, and after ``MOST`` units at the latest, so texts with a common part have common
leaves in any script. A paragraph's digest is that of its leaves, a
section's that of its paragraphs, and the root that of the sections. A blank line ends a section,
and so does a paragraph whose digest begins with ``SECTION_MARK``: borders follow from the content,
so an edit changes only the branches it touches. The fingerprint is one string,

    root:section=paragraph(leaf.leaf),paragraph(leaf)/section=...

with the root whole and the other digests cut to ``NODE`` hexadecimal digits. Equal roots mean equal
texts; ``likeness`` is the share of leaves that two trees have in common; ``differences`` walks down
differing branches only. Everything is a column expression.

Defined cases: a null text counts as empty; an empty text has one section, paragraph and leaf;
the likeness of equal trees is 1. The next document is that of the next larger id, null ids first,
different texts of one id in the order of a hash; identical rows are one document here and get the
same result each; a single document is its own next.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seqcurate.llm.common import stage
from seqcurate.llm.rules import let

NODE = 12
#: One paragraph in 16 ends a section.
SECTION_MARK = "0"
SENTENCE_GAP = r"(?<=[.!?])[\x20\t]+"
#: Characters of a sentence that is one leaf; one in CUT of the pairs of units is a border, and MOST units are a leaf at most.
LONG, CUT, MOST = 100, 8, 64
UNIT = r"[!-~]+[\x20\t]*|[^!-~]"
#: Put at borders before splitting; a text that has it is only cut once more.
BORDER = "\x01"


def _digest(text: Column) -> Column:
    return F.sha2(text, 256)


def _cut(sentence: Column) -> Column:
    """A sentence as leaves."""

    def marked(units: Column) -> Column:
        pair = lambda u, i: F.crc32(F.concat(u, F.coalesce(F.get(units, i + 1), F.lit(""))).cast("binary"))
        ends = lambda u, i: (pair(u, i) % CUT == 0) | (i % MOST == MOST - 1)
        text = F.array_join(F.transform(units, lambda u, i: F.when(ends(u, i), F.concat(u, F.lit(BORDER))).otherwise(u)), "")
        return F.filter(F.split(text, BORDER), lambda x: x != "")

    cut = let(F.regexp_extract_all(sentence, F.lit(f"(?s){UNIT}"), 0), marked)
    return F.when(F.length(sentence) <= LONG, F.array(sentence)).otherwise(cut)


def paragraphs(text: Column) -> Column:
    """Per line: its leaves, its digest and whether a section ends with it."""

    def build(line: Column) -> Column:
        leaves = F.transform(F.flatten(F.transform(F.split(line, SENTENCE_GAP), _cut)), lambda s: F.substring(_digest(s), 1, NODE))
        # The line itself is hashed with its leaves: blanks between sentences count as well.
        return F.struct(leaves.alias("leaves"), _digest(line).alias("line"), (F.trim(line) == "").alias("blank"))

    def close(p: Column) -> Column:
        whole = _digest(F.concat_ws(".", p["line"], F.array_join(p["leaves"], ".")))
        return F.struct(
            F.concat(F.substring(whole, 1, NODE), F.lit("("), F.array_join(p["leaves"], "."), F.lit(")")).alias("node"),
            whole.alias("digest"),
            (p["blank"] | whole.startswith(SECTION_MARK)).alias("last"),
        )

    return F.transform(F.transform(F.split(text, "\n"), build), close)


def fingerprint(text: Column) -> Column:
    """The fingerprint string of a text."""

    def sections(nodes: Column) -> Column:
        # Borders as marks in one string: digests hold neither, so splitting gives the sections back.
        joined = F.array_join(F.transform(nodes, lambda p: F.concat(p["node"], F.when(p["last"], F.lit("/")).otherwise(F.lit(",")))), "")
        digests = F.array_join(F.transform(nodes, lambda p: F.concat(p["digest"], F.when(p["last"], F.lit("/")).otherwise(F.lit(",")))), "")
        trim = lambda s: F.regexp_replace(s, "[,/]$", "")
        return F.arrays_zip(F.split(trim(joined), "/").alias("nodes"), F.split(trim(digests), "/").alias("digests"))

    def close(parts: Column) -> Column:
        hashed = F.transform(parts, lambda s: F.struct(_digest(s["digests"]).alias("digest"), s["nodes"].alias("nodes")))
        return let(
            hashed,
            lambda h: F.concat(
                _digest(F.array_join(F.transform(h, lambda s: s["digest"]), "/")),
                F.lit(":"),
                F.array_join(F.transform(h, lambda s: F.concat(F.substring(s["digest"], 1, NODE), F.lit("="), s["nodes"])), "/"),
            ),
        )

    return let(let(paragraphs(text), sections), close)


def leaves(print_: Column) -> Column:
    """Distinct leaves of a fingerprint."""
    return F.array_distinct(F.flatten(F.transform(F.regexp_extract_all(print_, F.lit(r"\(([^)]*)\)"), 1), lambda p: F.split(p, r"\."))))


def packed(print_: Column) -> Column:
    """Root and distinct leaves of a fingerprint as bytes: half the size of their digits."""
    return F.unhex(F.concat(F.substring(print_, 1, 64), F.array_join(leaves(print_), "")))


def _shared(left: Column, right: Column) -> Column:
    return let(
        F.struct(left.alias("a"), right.alias("b")),
        lambda s: F.size(F.array_intersect(s["a"], s["b"])) / F.size(F.array_union(s["a"], s["b"])),
    )


def likeness(left: Column, right: Column) -> Column:
    """Leaves in both over leaves in either; 1 if the roots agree."""
    return F.when(F.substring(left, 1, 64) == F.substring(right, 1, 64), F.lit(1.0)).otherwise(_shared(leaves(left), leaves(right)))


def likeness_to_packed(left: Column, pack: Column) -> Column:
    """The likeness of a fingerprint and one that came ``packed``."""
    digits = F.lower(F.hex(pack))
    return let(
        digits,
        lambda d: F.when(F.substring(left, 1, 64) == F.substring(d, 1, 64), F.lit(1.0)).otherwise(
            _shared(leaves(left), F.regexp_extract_all(F.substr(d, F.lit(65)), F.lit(f"[0-9a-f]{{{NODE}}}"), 0))
        ),
    )


def differences(left: Column, right: Column) -> Column:
    """Paragraph nodes of ``left`` that ``right`` lacks, with their section; none if the roots agree.

    Sections of equal digest are passed over whole; in the others only unknown paragraphs are reported.
    """
    parts = lambda p: F.split(F.substring_index(p, ":", -1), "/")

    def walk(s: Column) -> Column:
        changed = F.filter(
            F.transform(s["a"], lambda x, i: F.struct(i.alias("section"), x.alias("body"))), lambda x: ~F.array_contains(s["b"], x["body"])
        )
        known = F.flatten(F.transform(s["b"], lambda x: F.split(F.substring_index(x, "=", -1), ",")))
        return let(
            known,
            lambda k: F.flatten(
                F.transform(
                    changed,
                    lambda x: F.transform(
                        F.filter(F.split(F.substring_index(x["body"], "=", -1), ","), lambda n: ~F.array_contains(k, n)),
                        lambda n: F.struct(x["section"].alias("section"), F.substring(n, 1, NODE).alias("paragraph")),
                    ),
                )
            ),
        )

    differing = let(F.struct(parts(left).alias("a"), parts(right).alias("b")), walk)
    return F.when(F.substring(left, 1, 64) != F.substring(right, 1, 64), differing).otherwise(F.array().cast("array<struct<section:int,paragraph:string>>"))


def wanted(docs: DataFrame) -> DataFrame:
    """(_key, _hash, _before_key, _before_hash, _half): who asks each document for how many of its first characters.

    Documents stand in ascending order of (doc_id, _hash); each asks its next for half its own length, the last
    one the first. Without texts: rows are dealt by range and written with their range, each range is ordered on its own, and the
    first row of each range, one row a range, links the ranges.
    """
    ids = docs.select("doc_id", "_key", "_hash", "_n").distinct().repartitionByRange("doc_id", "_hash")
    ids = stage(ids.withColumn("_range", F.spark_partition_id()), "merkle-order")
    here = F.struct("doc_id", "_hash", "_key")
    order = Window.partitionBy("_range").orderBy(F.col("doc_id").asc_nulls_first(), "_hash")
    ordered = ids.withColumn("_next", F.lead(here).over(order))
    firsts = ids.groupBy("_range").agg(F.min(here).alias("_first"))
    ranges = Window.orderBy("_range")
    overall = ranges.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    after = firsts.select("_range", F.coalesce(F.lead("_first").over(ranges), F.first("_first").over(overall)).alias("_after"))
    joined = ordered.join(after, "_range").withColumn("_next", F.coalesce("_next", "_after"))
    return joined.select(
        F.col("_next._key").alias("_key"), F.col("_next._hash").alias("_hash"), F.col("_key").alias("_before_key"), F.col("_hash").alias("_before_hash"), F.floor(F.col("_n") / 2).alias("_half")
    )


def fingerprints(docs: DataFrame, text: str = "text") -> DataFrame:
    """Fingerprints of each document and of its edited text, and their likenesses.

    Texts are shuffled once. To the document before it each sends the characters that one asks for and its packed leaves.
    """
    kind = docs.schema["doc_id"].dataType
    rows = docs.select("doc_id", F.coalesce(F.col(text), F.lit("")).alias("_text"))
    # The key is never null, and the id can be read back from it.
    rows = rows.withColumn("_key", F.coalesce(F.concat(F.lit("="), F.col("doc_id").cast("string")), F.lit("")))
    rows = rows.withColumn("_hash", F.xxhash64("_text", F.md5("_text"))).withColumn("_n", F.length("_text"))
    asked = wanted(rows)
    # Both joins read one exchange of the texts.
    texts = rows.select("_key", "_hash", "_text").repartition("_key", "_hash")
    given = texts.dropDuplicates(["_key", "_hash"]).join(asked, ["_key", "_hash"])
    given = given.select(
        F.col("_before_key").alias("_key"), F.col("_before_hash").alias("_hash"), F.left(F.col("_text"), F.col("_half").cast("int")).alias("_given"), packed(fingerprint(F.col("_text"))).alias("_pack")
    )
    both = texts.join(given, ["_key", "_hash"])
    doc_id = F.when(F.col("_key") != "", F.expr("substring(_key, 2)").cast(kind)).alias("doc_id")
    n = F.length("_text")
    edited = F.concat(F.left(F.col("_text"), (n - F.floor(n / 2)).cast("int")), F.col("_given"))
    made = both.select(doc_id, n.cast("long").alias("n_chars"), edited.alias("_edited"), fingerprint(F.col("_text")).alias("fingerprint"), "_pack")
    hashed = made.select(
        "doc_id", "n_chars", F.sha2("_edited", 256).alias("edited_sha256"), "fingerprint", fingerprint(F.col("_edited")).alias("edited_fingerprint"), "_pack"
    )
    return hashed.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        "fingerprint",
        "edited_fingerprint",
        likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
        likeness_to_packed(F.col("fingerprint"), F.col("_pack")).alias("near_next"),
    )

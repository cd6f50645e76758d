"""Quality rules, line first: bad lines go, then documents that lost too much.

Each line is held against three rules (``LINE_RULES``): punctuation (symbols and shouted marks),
navigation (menus, breadcrumbs) and boilerplate: phrases, as whole words, that make up
``BOILERPLATE_PERCENT`` of the line's words, so that prose that mentions one stays. Lines that break a rule are removed. A document
is rejected if it breaks a base rule (too short, or too many words in repeated 8-word windows) or if
the removed lines held more than ``LOST_PERCENT`` of its word characters. Everything is a column
expression; arrays stay within their row, so no document meets another and nothing is shuffled.

Defined cases: a null text counts as empty; an empty text has no word and is rejected as too short;
lines without a word break no rule and are kept; repeated rows are judged alike; other columns, also
ones named like a result, are carried by ``clean`` only if asked for.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLANKS = " \t\n\x0b\f\r"
WORD_GAP = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
MIN_WORDS = 20
WINDOW = 8
REPEAT_PERCENT = 30
LOST_PERCENT = 50
#: Symbols per 100 word characters that a line may have.
SYMBOL_PERCENT = 20
#: Shouted marks (!!, ??) per 100 words that a line may have.
SHOUT_PERCENT = 30
#: A menu line has this many separators, and at most so many words a separator.
MENU_MARKS, MENU_WORDS = 3, 3
#: Phrases of boilerplate lines, in lower case.
BOILERPLATE = (
    "accept cookies", "accept all cookies", "uses cookies", "use cookies", "enable javascript", "lorem ipsum", "all rights reserved",
    "terms of use", "terms of service", "privacy policy", "click here", "read more", "sign in", "sign up", "log in", "subscribe now",
    "subscribe to", "share this", "powered by", "licensed under",
)
#: A line is boilerplate if at least so many of 100 words belong to such phrases.
BOILERPLATE_PERCENT = 15
#: What lies between two words of a phrase, and at its ends.
BORDER = r"[^\p{L}\p{N}]+"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, WORD_GAP), lambda w: w != "")


def without(text: Column, characters: str) -> Column:
    return F.translate(text, characters, "")


def lost_length(text: Column, characters: str) -> Column:
    return F.length(text) - F.length(without(text, characters))


def repeated_words(words: Column) -> Column:
    """Words that lie in a window of ``WINDOW`` words found twice or more in the same text."""

    def union(positions: Column) -> Column:
        spans = F.transform(positions, lambda p, i: F.least(F.lit(WINDOW), F.get(positions, i + 1) - p))
        return F.aggregate(spans, F.lit(0), lambda a, b: a + b)

    def from_sorted(pairs: Column) -> Column:
        same = lambda x, i: (F.get(pairs, i)["h"] == x["h"])
        marked = F.transform(
            pairs,
            lambda x, i: F.when(F.coalesce(F.when(i > 0, same(x, i - 1)), F.lit(False)) | F.coalesce(same(x, i + 1), F.lit(False)), x["p"]),
        )
        return let(F.array_sort(F.array_compact(marked)), union)

    def from_windows(windows: Column) -> Column:
        pairs = F.array_sort(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("p"))))
        return F.when(F.size(F.array_distinct(windows)) == F.size(windows), F.lit(0)).otherwise(let(pairs, from_sorted))

    def from_hashes(hashes: Column) -> Column:
        windows = F.transform(F.sequence(F.lit(1), F.size(hashes) - WINDOW + 1), lambda i: F.xxhash64(F.slice(hashes, i, WINDOW)))
        return let(windows, from_windows)

    return F.when(F.size(words) <= WINDOW, F.lit(0)).otherwise(let(F.transform(words, lambda w: F.xxhash64(w)), from_hashes))


def breaks_punctuation(line: Column) -> Column:
    chars, words = F.length(without(line, BLANKS)), F.size(words_of(line))
    shouts = (2 * F.length(line) - F.length(F.replace(line, F.lit("!!"), F.lit(""))) - F.length(F.replace(line, F.lit("??"), F.lit("")))) / 2
    # Words are counted only in lines that shout at all.
    shouted = (F.contains(line, F.lit("!!")) | F.contains(line, F.lit("??"))) & (100 * shouts > SHOUT_PERCENT * words)
    return (100 * lost_length(line, SYMBOLS) > SYMBOL_PERCENT * chars) | shouted


def breaks_navigation(line: Column) -> Column:
    marks = lost_length(line, "|>»•·")
    return (marks >= MENU_MARKS) & (F.size(words_of(line)) <= (MENU_WORDS + 1) * marks)


def has_boilerplate(text: Column) -> Column:
    return let(F.lower(text), lambda low: functools.reduce(lambda a, b: a | b, [F.contains(low, F.lit(p)) for p in BOILERPLATE]))


def phrase_words(line: Column) -> Column:
    """Words of the line that belong to boilerplate phrases; every border is two blanks, so phrases in a row share none."""

    def count(spaced: Column) -> Column:
        found = F.lit(0)
        for phrase in BOILERPLATE:
            words = phrase.split(" ")
            bordered = f" {'  '.join(words)} "
            hits = (F.length(spaced) - F.length(F.replace(spaced, F.lit(bordered), F.lit("")))) / len(bordered)
            found = found + hits * len(words)
        return found

    return let(F.regexp_replace(F.concat(F.lit(" "), F.lower(line), F.lit(" ")), BORDER, "  "), count)


def breaks_boilerplate(line: Column) -> Column:
    # The plain search is cheap; only lines with a phrase written with single blanks are looked at further.
    enough = let(phrase_words(line), lambda n: (n > 0) & (100 * n >= BOILERPLATE_PERCENT * F.size(words_of(line))))
    return has_boilerplate(line) & enough


LINE_RULES = {"punctuation": breaks_punctuation, "navigation": breaks_navigation, "boilerplate": breaks_boilerplate}


def bad_line(line: Column, any_boilerplate: Column) -> Column:
    """Whether a line breaks a rule; ``any_boilerplate`` says whether its text holds a phrase at all."""
    verdict = F.lit(False)
    for name, rule in LINE_RULES.items():
        verdict = verdict | (any_boilerplate & rule(line) if name == "boilerplate" else rule(line))
    return (F.length(without(line, BLANKS)) > 0) & verdict


def clean(docs: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """The columns ``keep``, the counts, the cleaned text and the verdict of each document."""
    base = docs.select(*[F.col(f"`{c}`") for c in keep], F.coalesce(F.col(text), F.lit("")).alias("_text"))
    split = base.select(*[f"`{c}`" for c in keep], "_text", words_of(F.col("_text")).alias("_words"), F.split("_text", "\n").alias("_lines"), has_boilerplate(F.col("_text")).alias("_phrase"))
    full_lines = F.filter("_lines", lambda x: F.length(without(x, BLANKS)) > 0)
    judged = split.select(
        *[f"`{c}`" for c in keep],
        F.size("_words").cast("long").alias("n_words"),
        F.length(without(F.col("_text"), BLANKS)).cast("long").alias("word_chars"),
        lost_length(F.col("_text"), SYMBOLS).cast("long").alias("n_symbols"),
        let(full_lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        repeated_words(F.col("_words")).cast("long").alias("n_repeat_words"),
        F.transform("_lines", lambda x: F.struct(x.alias("line"), bad_line(x, F.col("_phrase")).alias("bad"))).alias("_judged"),
    )
    lost = F.aggregate(
        "_judged", F.lit(0).cast("long"), lambda a, x: a + F.when(x["bad"], F.length(without(x["line"], BLANKS))).otherwise(0)
    )
    counted = judged.select(
        *[f"`{c}`" for c in keep],
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        ((F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))).alias("base_failed"),
        lost.alias("lost_chars"),
        F.array_join(F.transform(F.filter("_judged", lambda x: ~x["bad"]), lambda x: x["line"]), "\n").alias("clean_text"),
    )
    return counted.withColumn("kept", ~F.col("base_failed") & (100 * F.col("lost_chars") <= LOST_PERCENT * F.col("word_chars")))


#: The same columns in SQL, but for the cleaned text.
SQL = rf"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, row_number() OVER () AS r FROM documents
), w AS (
  SELECT r, doc_id, t, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words,
         list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM d
), win AS (
  SELECT r, i, array_to_string(words[i:i + {WINDOW - 1}], ' ') AS h
  FROM (SELECT r, words, unnest(range(1, len(words) - {WINDOW - 2})) AS i FROM w WHERE len(words) > {WINDOW})
), rep AS (
  SELECT r, sum(least({WINDOW}, coalesce(nxt - i, {WINDOW}))) AS n FROM (
    SELECT r, i, lead(i) OVER (PARTITION BY r ORDER BY i) AS nxt
    FROM (SELECT r, i, count(*) OVER (PARTITION BY r, h) AS c FROM win) WHERE c > 1
  ) GROUP BY r
), ln AS (
  SELECT r, x, length(regexp_replace(x, '[\x20\x09-\x0D]', '', 'g')) AS chars,
         len(list_filter(regexp_split_to_array(x, '[\x20\x09-\x0D]+'), lambda y: y <> '')) AS n,
         length(x) - length(regexp_replace(x, '[#*$%&|<>]', '', 'g')) AS symbols,
         (2 * length(x) - length(replace(x, '!!', '')) - length(replace(x, '??', ''))) / 2.0 AS shouts,
         length(x) - length(regexp_replace(x, '[|>»•·]', '', 'g')) AS marks
         , {" + ".join(f"(length(spaced) - length(replace(spaced, ' {'  '.join(p.split())} ', ''))) // {len('  '.join(p.split())) + 2} * {len(p.split())}" for p in BOILERPLATE)} AS phrase_words
  FROM (SELECT r, x, regexp_replace(' ' || lower(x) || ' ', '{BORDER}', '  ', 'g') AS spaced FROM (SELECT r, unnest(lines) AS x FROM w))
), lost AS (
  SELECT r, sum(chars) AS n FROM ln
  WHERE 100 * symbols > {SYMBOL_PERCENT} * chars OR 100 * shouts > {SHOUT_PERCENT} * n
     OR (marks >= {MENU_MARKS} AND n <= {MENU_WORDS + 1} * marks)
     OR (({" OR ".join(f"contains(lower(x), '{p}')" for p in BOILERPLATE)}) AND phrase_words > 0 AND 100 * phrase_words >= {BOILERPLATE_PERCENT} * n)
  GROUP BY r
), c AS (
  SELECT w.doc_id, len(words)::BIGINT AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
         (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
         (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words,
         coalesce(lost.n, 0)::BIGINT AS lost_chars
  FROM w LEFT JOIN rep USING (r) LEFT JOIN lost USING (r)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < {MIN_WORDS} OR 100 * n_repeat_words > {REPEAT_PERCENT} * n_words AS base_failed,
       NOT (n_words < {MIN_WORDS} OR 100 * n_repeat_words > {REPEAT_PERCENT} * n_words)
         AND 100 * lost_chars <= {LOST_PERCENT} * word_chars AS kept,
       lost_chars
FROM c
"""

"""Identifier and path expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schemas as S


def sample_id(dataset: Column, path: Column) -> Column:
    """First 20 hex digits of sha-256 over ``dataset:path``."""
    return F.substring(F.sha2(F.concat_ws(":", dataset, path), 256), 1, 20)


def with_sample_id(df: DataFrame, dataset: str = "dataset", path: str = "relative_path") -> DataFrame:
    return df.withColumn("sample_id", sample_id(F.col(dataset), F.col(path)))


def namespaced(*parts) -> Column:
    return F.concat_ws(":", *parts)


def condition_family(dataset: Column, condition: Column, constant: dict[str, str] | None = None) -> Column:
    """Family of a condition code; whole datasets may map to one constant. Unknown codes stop the job."""
    message = F.concat(F.lit("Unsupported condition: "), condition)
    out = S.by_prefix(condition, S.CONDITION_FAMILIES, F.raise_error(message).cast("string"))
    for name, family in (constant or {}).items():
        out = F.when(dataset == name, family).otherwise(out)
    return out


def safe_component(value: Column) -> Column:
    """A value usable as one path component; nothing left over stops the job."""
    kept = F.regexp_replace(value.cast("string"), r"[^A-Za-z0-9._-]+", "_")
    kept = F.btrim(kept, F.lit("._"))
    bad = F.raise_error(F.concat(F.lit("No safe path component in: "), F.coalesce(value.cast("string"), F.lit("null"))))
    return F.when(F.length(kept) > 0, kept).otherwise(bad.cast("string"))


def suffix(path: Column, default: str = ".png") -> Column:
    """Lower-cased file suffix of the last path part."""
    found = F.lower(F.regexp_extract(path, r"[^/.][^/]*(\.[^./]+)$", 1))
    return F.when(found != "", found).otherwise(default)


def destination_tail(label: Column, subject: Column, condition: Column, sample: Column, path: Column) -> Column:
    """label/subject/condition/sample.suffix: the part that is the same in every fold view."""
    name = F.concat(safe_component(sample), suffix(path))
    return F.concat_ws("/", safe_component(label), safe_component(subject), safe_component(condition), name)


def destination(role: Column, fold: Column, tail: Column) -> Column:
    base = F.when(role == "test", "test").otherwise(F.concat_ws("/", F.lit("folds"), F.concat(F.lit("fold_"), fold), role))
    return F.concat_ws("/", base, tail)


def blind_id(position: Column, prefix: str = "pilot_") -> Column:
    number = position.cast("string")
    return F.concat(F.lit(prefix), F.when(F.length(number) < 3, F.lpad(number, 3, "0")).otherwise(number))


def blank_to_null(df: DataFrame) -> DataFrame:
    """Blank and missing text are the same thing: null."""
    text = [f.name for f in df.schema.fields if f.dataType.simpleString() == "string"]
    return df.withColumns({c: F.nullif(F.trim(c), F.lit("")) for c in text})


#: A line's sha-256 as numbers of 7 hex digits: a sum of them stays in a long for 3 * 10^10 lines, and beyond that the job stops.
WORDS = 9
WORD_NAMES = tuple(f"w{k}" for k in range(WORDS))


def line_hash(*columns) -> Column:
    return F.sha2(F.concat_ws(":", *columns), 256)


def word_sums(line: Column) -> list[Column]:
    """Aggregates: the sums of the numbers of all lines; sums of sums are the sums of the whole."""
    number = lambda k: F.conv(F.substring(line, 7 * k + 1, 7), 16, 10).cast("bigint")
    return [F.sum(number(k)).alias(name) for k, name in enumerate(WORD_NAMES)]


def digest_of(entries: str = "entries") -> Column:
    """Hex digest of a row with a number of lines and their word sums."""
    words = [F.coalesce(F.col(w).cast("decimal(38,0)"), F.lit(0)).cast("string") for w in WORD_NAMES]
    return F.sha2(F.concat_ws(":", F.col(entries).cast("string"), *words), 256)


def content_digest(df: DataFrame, *columns: str, keys=()) -> DataFrame:
    """Order-insensitive digest of a table of ``path:checksum`` lines, per key.

    Each line's sha-256 is cut into numbers that are summed, so the aggregate is
    a plain sum: it combines before the shuffle and holds no list of any size.
    """
    rows = df.select(*keys, line_hash(*columns).alias("_line"))
    out = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("entries"), *word_sums(F.col("_line")))
    return out.select(*keys, "entries", digest_of().alias("digest"))

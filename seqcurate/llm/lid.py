"""Language identification: each document as a mixture of languages.

Character n-gram models of all languages are counted over every learnable document. A document's
proportions come from expectation-maximisation over its n-gram likelihoods; starting from all
languages, the smallest is left out as long as the likelihood less half a log(n) per further
language (n: the document's n-grams) does not fall.

Defined cases: a null text or one without a letter is ``und`` with score 0; ties go to the
language that sorts first; without a learnable row all are ``und``. Rows with a null language or
text are not learned from; repeated rows count each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqcurate.llm.hashing import code_points, gram_hashes

BUCKETS = 1 << 15
GRAMS = (2, 3)
#: Added to each count.
SMOOTHING = 0.1
#: Rounds of expectation-maximisation; they end early once no share moves by SETTLED.
ROUNDS = 20
SETTLED = 1e-4
#: A language below this share of the n-grams is left out at once.
LEAST_SHARE = 0.01
#: The model is a table of languages x BUCKETS floats on every executor; more languages are refused.
MAX_LANGUAGES = 256
UNDETERMINED = "und"
_LETTER: list[np.ndarray] = []


def letters() -> np.ndarray:
    """True for each code point that is a letter."""
    if not _LETTER:
        _LETTER.append(np.fromiter((chr(i).isalpha() for i in range(0x110000)), np.bool_, 0x110000))
    return _LETTER[0]


def letter_stream(text: str | None) -> np.ndarray | None:
    """Lower-cased letters, each run of anything else one blank, blanks at both ends; None without a letter."""
    cp = code_points((text or "").lower())
    is_letter = letters()[cp]
    if not is_letter.any():
        return None
    stream = np.full(len(cp) + 2, 32, np.uint32)
    stream[1:-1][is_letter] = cp[is_letter]
    keep = np.ones(len(stream), np.bool_)
    keep[1:] = (stream[1:] != 32) | (stream[:-1] != 32)
    return stream[keep]


def counts(text: str | None) -> np.ndarray | None:
    """N-gram counts per bucket; None without a letter."""
    cp = letter_stream(text)
    if cp is None:
        return None
    out = np.zeros(BUCKETS, np.int64)
    for n in GRAMS:
        out += np.bincount((gram_hashes(cp, n) >> np.uint32(3)) & np.uint32(BUCKETS - 1), minlength=BUCKETS)
    return out


def train(docs: DataFrame, usable: Column) -> tuple[list[str], np.ndarray]:
    """Languages and their log-probabilities per bucket, counted over all usable documents."""
    rows = docs.select("doc_id", "text", "lang").where(usable & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("text", "lang")

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for text, lang in zip(batch["text"], batch["lang"], strict=True):
                if (found := counts(text)) is not None:
                    sums[lang] = sums[lang] + found if lang in sums else found
                    if len(sums) > MAX_LANGUAGES:
                        raise ValueError(f"more than {MAX_LANGUAGES} languages")
        for lang, total in sums.items():
            at = np.flatnonzero(total)
            yield pd.DataFrame({"lang": lang, "bucket": at.astype(np.int32), "n": total[at]})

    summed = rows.mapInPandas(work, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    found = summed.toPandas()
    names = sorted(found["lang"].unique())
    if len(names) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    table = np.full((len(names), BUCKETS), SMOOTHING)
    place = {name: i for i, name in enumerate(names)}
    table[found["lang"].map(place).to_numpy(np.int64), found["bucket"].to_numpy(np.int64)] += found["n"].to_numpy(np.float64)
    return names, np.log(table / table.sum(axis=1, keepdims=True)).astype(np.float32).T.copy()


def proportions(weights: np.ndarray, logp: np.ndarray) -> tuple[np.ndarray, float]:
    """Mixture shares by expectation-maximisation, and the log-likelihood. logp: n-grams x languages."""
    if logp.shape[1] == 1:
        return np.ones(1), float(weights @ logp[:, 0])
    top = logp.max(axis=1)
    p = np.exp(logp - top[:, None])
    part = weights / weights.sum()
    share = np.full(p.shape[1], 1.0 / p.shape[1])
    for _ in range(ROUNDS):
        new = share * ((part / (p @ share)) @ p)
        moved, share = np.abs(new - share).max(), new
        if moved < SETTLED:
            break
    return share, float(weights @ (np.log(p @ share) + top))


def infer(text: str | None, names: list[str], table: np.ndarray) -> tuple[list[str], np.ndarray]:
    """The languages of a text, largest share first, and their shares; empty if undetermined."""
    found = counts(text) if names else None
    if found is None:
        return [], np.zeros(0)
    at = np.flatnonzero(found)
    weights, logp = found[at].astype(np.float64), table[at].astype(np.float64)
    penalty = 0.5 * np.log(weights.sum())
    chosen = np.arange(len(names))
    share, fit = proportions(weights, logp)
    best = fit - penalty * (len(chosen) - 1)
    while len(chosen) > 1:
        large = share >= LEAST_SHARE
        if large.all():
            large[len(share) - 1 - int(np.argmin(share[::-1]))] = False
        fewer = chosen[large]
        fewer_share, fit = proportions(weights, logp[:, fewer])
        if fit - penalty * (len(fewer) - 1) < best:
            break
        chosen, share, best = fewer, fewer_share, fit - penalty * (len(fewer) - 1)
    order = np.argsort(-share, kind="stable")
    return [names[i] for i in chosen[order]], share[order]


def predict(docs: DataFrame, model: tuple[list[str], np.ndarray], keep: list[str]) -> DataFrame:
    """The columns ``keep`` and lang_pred, score, languages, shares of each document."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("languages array<string>, shares array<double>")
    def inferred(text: pd.Series) -> pd.DataFrame:
        names, table = held.value
        found = [infer(t, names, table) for t in text]
        return pd.DataFrame({"languages": [f[0] for f in found], "shares": [f[1].tolist() for f in found]})

    rows = docs.select(*[F.col(f"`{c}`") for c in keep], inferred(F.col("text")).alias("_found"))
    return rows.select(
        *keep,
        F.coalesce(F.get("_found.languages", F.lit(0)), F.lit(UNDETERMINED)).alias("lang_pred"),
        F.coalesce(F.get("_found.shares", F.lit(0)), F.lit(0.0)).alias("score"),
        F.col("_found.languages").alias("languages"),
        F.col("_found.shares").alias("shares"),
    )

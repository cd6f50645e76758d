"""Quality classifier: supervised embeddings of hashed words and character n-grams.

A document is the mean of the vectors of its words and of its character n-grams (within words,
borders included); a softmax layer turns it into the probability of label 1. Vectors and layer are
learned together by stochastic gradient descent in numpy, in one task over a bounded sample of the
labelled rows. Scoring runs over whole texts: as the mean and the layer are linear, each bucket
needs one number, so the model that travels to the tasks is one array of ``BUCKETS`` floats.

Defined cases: a null or empty text, or one without a word, scores the label-1 share of the sample;
without any labelled row every score is 0.5; a null label or id is no training row; repeated rows
are scored alike; other columns of the inputs are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqcurate.llm.common import labelled, take_over
from seqcurate.llm.hashing import code_points, gram_hashes, span_hashes, word_bounds

#: Rows of embeddings; words and n-grams share them.
BUCKETS = 1 << 18
GRAMS = (3, 4)
#: Bucket of the token for a repeated word.
REPEAT = 1
DIM = 8
EPOCHS = 6
RATE = 0.5
#: Bound of the training sample: labelled rows with the smallest hash of their id.
SAMPLE_ROWS = 6000
CUT = 0.7


def features(text: str | None) -> np.ndarray:
    """Buckets of all words and n-grams of a text."""
    cp = code_points(text or "")
    starts, ends = word_bounds(cp)
    if not len(starts):
        return np.zeros(0, np.int64)
    words = (span_hashes(cp, starts, ends) & np.uint64(BUCKETS - 1)).astype(np.int64)
    # A word that repeats the one before is a token of its own: no n-gram vector shows repetition.
    parts = [words, np.full(np.count_nonzero(words[1:] == words[:-1]), REPEAT, np.int64)]
    blank = (cp == 32) | ((cp >= 9) & (cp <= 13))
    padded = np.concatenate(([32], np.where(blank, 32, cp), [32])).astype(np.uint32)
    gap = (padded == 32).astype(np.int32)
    within = np.cumsum(gap)
    for n in GRAMS:
        if len(padded) >= n:
            # A border may start or end an n-gram, but not lie inside it.
            inner = within[n - 2 : len(padded) - 1] - within[: len(padded) - n + 1]
            parts.append((gram_hashes(padded, n)[inner == 0] & np.uint32(BUCKETS - 1)).astype(np.int64))
    return np.concatenate(parts)


def fit(texts: list, labels: list) -> tuple[np.ndarray, float]:
    """Learns vectors and layer; returns each bucket's share of the logit and the bias."""
    y = np.asarray(labels, np.float64)
    if not len(y):
        return np.zeros(BUCKETS, np.float32), 0.0
    share = np.clip(y.mean(), 0.5 / (len(y) + 1), 1 - 0.5 / (len(y) + 1))
    base = np.array([np.log(1 - share), np.log(share)])
    docs = []
    for text in texts:
        ids, counts = np.unique(features(text), return_counts=True)
        docs.append((ids, (counts / max(1, counts.sum())).astype(np.float32)))
    rng = np.random.default_rng(7)
    vectors = rng.uniform(-1.0 / DIM, 1.0 / DIM, (BUCKETS, DIM)).astype(np.float32)
    layer = rng.uniform(-1.0, 1.0, (DIM, 2)).astype(np.float32)
    steps, at = EPOCHS * len(docs), 0
    for _ in range(EPOCHS):
        for d in rng.permutation(len(docs)):
            ids, weight = docs[d]
            rate = RATE * (1 - at / steps)
            at += 1
            if not len(ids):
                continue
            rows = vectors[ids]
            hidden = weight @ rows
            logits = hidden @ layer + base
            p = np.exp(logits - logits.max())
            gap = p / p.sum()
            gap[int(y[d])] -= 1.0
            back = layer @ gap.astype(np.float32)
            layer -= rate * np.outer(hidden, gap).astype(np.float32)
            # Weights of a document sum to 1, so a row's step is scaled by their squared norm.
            vectors[ids] = rows - (rate / max(float(weight @ weight), 1e-9)) * np.outer(weight, back)
    return (vectors @ (layer[:, 1] - layer[:, 0])).astype(np.float32), float(base[1] - base[0])


def train(docs: DataFrame, labels: DataFrame, usable: Column, label: str = "quality") -> tuple[np.ndarray, float]:
    """Fits on at most ``SAMPLE_ROWS`` labelled documents for which ``usable`` (over the id) holds."""
    known = labelled(labels, label).where(usable)
    picked = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE_ROWS)
    rows = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id").select("doc_id", "text", "label")

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        take_over("quality")
        sample = [b for b in batches if len(b)]
        sample = pd.concat(sample).sort_values(["doc_id", "label", "text"]) if sample else pd.DataFrame({"text": [], "label": []})
        weights, bias = fit(sample["text"].tolist(), sample["label"].tolist())
        yield pd.DataFrame({"weights": [weights.tobytes()], "bias": [bias]})

    model = rows.repartition(1).mapInPandas(work, "weights binary, bias double").first()
    if model is None:
        return np.zeros(BUCKETS, np.float32), 0.0
    return np.frombuffer(model["weights"], np.float32), float(model["bias"])


def probability(text: str | None, weights: np.ndarray, bias: float) -> float:
    ids = features(text)
    logit = bias + (float(weights[ids].mean(dtype=np.float64)) if len(ids) else 0.0)
    return float(1.0 / (1.0 + np.exp(-np.clip(logit, -50, 50))))


def score(docs: DataFrame, model: tuple[np.ndarray, float], keep: list[str], name: str = "score") -> DataFrame:
    """The columns ``keep`` of each document and its score."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def scored(text: pd.Series) -> pd.Series:
        take_over("quality")
        weights, bias = held.value
        return pd.Series([probability(t, weights, bias) for t in text], dtype="float64")

    return docs.select(*[F.col(f"`{c}`") for c in keep], scored(F.col("text")).alias(name))

"""Quality classifier: hashed word n-gram logistic regression with follow-the-regularised-leader updates.

Words and runs of other signs are hashed one by one and in pairs; a word that repeats the one before it is
one feature of its own. A text is the L2-normalised counts of its features; its score is the logistic of a
sparse dot product. Training is online (FTRL-proximal): labelled rows, a bounded sample of them, pass in a
stable pseudo-random order; labels join ids first, so that unlabelled texts are not moved.

Defined results: a null or empty text has no feature and gets the bias' score; a null label is not learnt
from; without labelled rows every score is 0.5; several different labels of a document are all learnt
from, equal ones once; of rows of one id the one of least text is learnt from, so that the bound holds for rows and
their order is settled; repeated rows are scored alike; an empty table gives an empty result; further columns are kept by ``scored``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from festa.llm import words
from festa.llm.common import held_out, learn_row, text_of

#: Hash space of the features; the last place is the bias.
BITS = 18
#: The most labelled rows that one fit learns from.
SAMPLE_ROWS = 8_000
#: Rows that the learner holds, and goes through EPOCHS times, before it takes the next.
BLOCK_ROWS = 1_000
EPOCHS = 3
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.02, 0.5
_REPEAT, _PAIR = np.uint64(0x5851F42D4C957F2D), np.uint64(0xD6E8FEB86659FD93)


def features(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers of all texts, one text after the other, and where each text's features start (and the end)."""
    codes, kinds, bounds = words.points(texts)
    kinds = np.where(kinds == words.NUMBER, words.LETTER, kinds)
    start = np.flatnonzero((np.diff(kinds, prepend=words.BREAK) != 0) | (kinds == words.BREAK))
    end = np.append(start[1:], len(codes))
    token = (kinds[start] == words.LETTER) | (kinds[start] == words.OTHER)
    start, end = start[token], end[token]
    h = words.hashes(codes, start, end)
    word = np.flatnonzero(kinds[start] == words.LETTER)
    text = np.searchsorted(bounds, start, side="right")
    again = word[1:][(h[word[1:]] == h[word[:-1]]) & (text[word[1:]] == text[word[:-1]])]
    h[again] = _REPEAT
    own = np.ones(len(h), bool)  # a text's last word starts no pair
    own[:-1] = text[1:] == text[:-1]
    own[-1:] = False
    space = np.uint64((1 << BITS) - 1)
    out = np.empty((len(h), 2), np.int64)
    out[:, 0] = h % space
    out[:-1, 1] = words.mix(h[:-1] * _PAIR + h[1:]) % space
    taken = np.stack([np.ones(len(h), bool), own], axis=1)
    at = np.concatenate(([0], np.cumsum(1 + own)))
    return out[taken], at[np.searchsorted(start, bounds)]


def _blocks(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[list[str], np.ndarray]]:
    """Texts and labels in blocks of BLOCK_ROWS, however the batches were cut."""
    texts, labels = [], []
    for batch in batches:
        for text, label in zip(batch["text"], batch["quality"], strict=True):
            texts.append(text)
            labels.append(float(label))
            if len(texts) == BLOCK_ROWS:
                yield texts, np.array(labels)
                texts, labels = [], []
    if texts:
        yield texts, np.array(labels)


def train(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Online FTRL over blocks of rows, EPOCHS times each; the weights that are not zero at the end."""
    z, n, bias = np.zeros(1 << BITS), np.zeros(1 << BITS), (1 << BITS) - 1

    def weights(i: np.ndarray) -> np.ndarray:
        zi = z[i]
        return np.where(np.abs(zi) <= L1, 0.0, (np.sign(zi) * L1 - zi) / ((BETA + np.sqrt(n[i])) / ALPHA + L2))

    seen = False
    for texts, labels in _blocks(batches):
        for _ in range(EPOCHS):
            for a, b in words.batches(texts):
                found, at = features(texts[a:b])
                for k in range(b - a):
                    index, count = np.unique(found[at[k] : at[k + 1]], return_counts=True)
                    value = np.append(count / max(1e-9, np.sqrt((count.astype(float) ** 2).sum())), 0.2)
                    index = np.append(index, bias)
                    w = weights(index)
                    p = 1 / (1 + np.exp(-np.clip(w @ value, -35, 35)))
                    g = (p - labels[a + k]) * value
                    sigma = (np.sqrt(n[index] + g * g) - np.sqrt(n[index])) / ALPHA
                    z[index] += g - sigma * w
                    n[index] += g * g
                    seen = True
    w = weights(np.arange(1 << BITS))
    keep = np.flatnonzero(w) if seen else np.empty(0, np.int64)
    yield pd.DataFrame({"feature": keep, "weight": w[keep]})


def fit(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> np.ndarray:
    """Weights learnt from at most ``rows`` labelled documents that may be learnt from; 2**BITS numbers."""
    order = F.xxhash64("doc_id", F.lit("quality"))
    chosen = labels.filter(learn_row() & F.col("quality").isNotNull()).select("doc_id", F.col("quality").cast("double").alias("quality"))
    chosen = chosen.distinct().orderBy(order, "doc_id", "quality").limit(rows)
    sample = docs.select("doc_id", text_of().alias("text")).join(F.broadcast(chosen), "doc_id")  # at most `rows` rows of two numbers
    sample = sample.groupBy("doc_id", "quality").agg(F.min("text").alias("text"))
    one = sample.select("doc_id", "text", "quality").repartition(1).sortWithinPartitions(order, "doc_id", "quality")
    found = one.select("text", "quality").mapInPandas(train, "feature bigint, weight double").toPandas()  # at most 2**BITS rows
    weights = np.zeros(1 << BITS, np.float32)
    weights[found["feature"].to_numpy()] = found["weight"].to_numpy()
    return weights


def score_texts(texts: list[str], weights: np.ndarray) -> np.ndarray:
    out = np.empty(len(texts))
    for a, b in words.batches(texts):
        found, at = features(texts[a:b])
        for k in range(b - a):
            index, count = np.unique(found[at[k] : at[k + 1]], return_counts=True)
            dot = (weights[index] @ count) / np.sqrt((count.astype(float) ** 2).sum()) if len(index) else 0.0
            out[a + k] = dot + 0.2 * weights[-1]
    return 1 / (1 + np.exp(-np.clip(out, -35, 35)))


def scored(docs: DataFrame, weights: np.ndarray, column: str = "score") -> DataFrame:
    """``docs`` with the score of each whole text in ``column``."""

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series(score_texts(texts.tolist(), weights))

    return docs.withColumn(column, score(text_of()))


def classify(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> DataFrame:
    """doc_id, held_out, score, predicted for every document."""
    done = scored(docs.select("doc_id", "text"), fit(docs, labels, rows))
    return done.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS, learn_from: DataFrame | None = None) -> DataFrame:
    """The documents that are not rejected, with their own columns; labels belong to ``learn_from`` (``docs`` if none)."""
    done = scored(docs, fit(docs if learn_from is None else learn_from, labels, rows), "__quality")
    return done.filter(F.col("__quality") >= 0.5).drop("__quality")

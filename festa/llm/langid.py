"""Language identification in two steps: the family first, then pairwise linear SVMs within it.

A text is the mean of its words' hashed character n-grams (one to three letters, and the whole word, all in
lower case and between word ends). A multinomial logistic model tells families apart; within a family one
linear support vector machine (hinge loss, L2 penalty) for each pair of languages votes, its margins breaking ties.
Both are fitted by averaged stochastic gradient steps on a bounded number of rows of each language.

Defined results: ``und`` with score 0 if the text is null or has no letter, or if nothing could be learnt; a
language of no listed family is a family of its own; a null language is never learnt; of rows of one id and language
the one of least text is learnt from, so that the bound holds for rows and their order is settled; of more than
MOST_LANGUAGES languages those with the most rows to learn from are learnt (ties by name); repeated rows are predicted
alike; an empty table gives an empty result; lang, source and doc_id are never inputs.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from itertools import combinations, islice

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from festa.llm import words
from festa.llm.common import cut, held_out, learn_row, text_of

BITS = 17
#: The most rows of one language, and the most languages, that one fit learns from.
ROWS_PER_LANGUAGE = 1_500
MOST_LANGUAGES = 200
#: Parts of a language's ids that are ranked apart.
SALTS = 256
#: Passes over each block of rows, the later half of which are averaged; rows of a block; the L2 penalty of the support vector machines.
EPOCHS, BLOCK_ROWS, PENALTY = 4, 2_000, 1e-4
#: Families of closely related languages, by language code.
FAMILIES = {
    "germanic": ("en", "de", "nl", "af", "sv", "da", "no", "nb", "nn", "is", "lb", "fy", "yi"),
    "romance": ("fr", "es", "pt", "it", "ro", "ca", "gl", "oc", "la"),
    "slavic": ("ru", "uk", "be", "pl", "cs", "sk", "bg", "mk", "sr", "hr", "bs", "sl"),
    "baltic": ("lt", "lv"),
    "celtic": ("ga", "gd", "cy", "br"),
    "uralic": ("fi", "et", "hu"),
    "turkic": ("tr", "az", "kk", "uz", "ky"),
    "indo-aryan": ("hi", "ur", "bn", "mr", "ne", "pa", "gu"),
    "semitic": ("ar", "he", "am", "mt"),
    "sinitic": ("zh", "yue"),
    "austronesian": ("id", "ms", "tl", "jv"),
}


def family_of(lang: str) -> str:
    return next((f for f, langs in FAMILIES.items() if lang in langs), f"lang:{lang}")


@cache
def _lower() -> np.ndarray:
    table = np.arange(0x110000, dtype=np.uint32)
    for i in np.flatnonzero(words.classes() == words.LETTER).tolist():
        low = chr(i).lower()
        if len(low) == 1:
            table[i] = ord(low)
    return table


def word_grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Grams of all distinct words (one after the other), where each word's grams start (and the end), the word at each place, and where each text's places start (and the end)."""
    codes, kinds, bounds = words.points(texts)
    letter = kinds == words.LETTER
    codes = _lower()[codes]
    edge = np.diff(letter.astype(np.int8), prepend=0)
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    h = words.hashes(codes, start, end)
    _, first, which = np.unique(h, return_index=True, return_inverse=True)
    s, n = start[first], (end - start)[first]
    # Each distinct word between two ends (code 1), in one array.
    size = n + 2
    begin = np.cumsum(size) - size
    flat = np.ones(int(size.sum()), np.uint64)
    at = np.repeat(s - np.cumsum(n) + n, n) + np.arange(n.sum())
    flat[np.repeat(begin + 1 - (np.cumsum(n) - n), n) + np.arange(n.sum())] = codes[at]
    word = np.repeat(np.arange(len(n)), size)
    mask, grams, owner = np.uint64((1 << BITS) - 1), [], []
    for order in (1, 2, 3):
        if len(flat) >= order:
            g = flat[: len(flat) - order + 1] * np.uint64(0x9E3779B97F4A7C15) + np.uint64(order)
            for j in range(1, order):
                g = words.mix(g) + flat[j : len(flat) - order + 1 + j]
            same = word[: len(word) - order + 1] == word[order - 1 :]
            grams.append(words.mix(g)[same] & mask)
            owner.append(word[: len(word) - order + 1][same])
    grams.append(h[first] & mask)
    owner.append(np.arange(len(n)))
    owners = np.concatenate(owner)
    by_word = np.argsort(owners, kind="stable")
    at = np.searchsorted(owners[by_word], np.arange(len(n) + 1))
    return np.concatenate(grams)[by_word].astype(np.int64), at, which, np.searchsorted(start, bounds)


def margins(texts: list[str], weights: np.ndarray) -> np.ndarray:
    """texts x models: the mean of the weights (features x models) of each text's grams; nan for a text without letters."""
    out = np.full((len(texts), weights.shape[1]), np.nan)
    for a, b in words.batches(texts):
        grams, at, which, bounds = word_grams(texts[a:b])
        if not len(which):
            continue
        totals = np.add.reduceat(weights[grams], at[:-1], axis=0)  # every word has grams
        counts = np.diff(at)
        sums = np.vstack([np.zeros((1, weights.shape[1])), np.cumsum(totals[which].astype(float), axis=0)])
        number = np.concatenate(([0], np.cumsum(counts[which])))
        n = (number[bounds[1:]] - number[bounds[:-1]])[:, None]
        with np.errstate(invalid="ignore", divide="ignore"):
            out[a:b] = (sums[bounds[1:]] - sums[bounds[:-1]]) / n
    return out


class Model:
    """languages, their families, and the columns of one weight table: families, then pairs of languages."""

    def __init__(self, languages: list[str]):
        self.languages = sorted(languages)
        self.families = sorted({family_of(x) for x in self.languages})
        self.members = [[i for i, x in enumerate(self.languages) if family_of(x) == f] for f in self.families]
        self.pairs = [p for m in self.members for p in combinations(m, 2)]
        self.family = np.array([self.families.index(family_of(x)) for x in self.languages], int)
        self.weights = np.zeros((1 << BITS, len(self.families) + len(self.pairs)), np.float32)
        self.own = [np.array([lang in p for p in self.pairs], bool) for lang in range(len(self.languages))]
        self.shrunk = np.ones(len(self.pairs))  # the pairs' weights are those of the table times these, so that decay touches one number a pair
        self.total, self.times = np.zeros_like(self.weights), 0

    def effective(self) -> np.ndarray:
        return self.weights * np.r_[np.ones(len(self.families)), self.shrunk].astype(np.float32)

    def averaged(self) -> np.ndarray:
        """The mean of the weights after each part of the later passes, which steadies stochastic steps."""
        return self.total / max(1, self.times)

    def learn(self, texts: list[str], langs: np.ndarray, rate: float, scale: float = 40.0, average: bool = True) -> None:
        """One pass of gradient steps, logistic for the families; hinge loss with an L2 penalty, a support vector machine, for the pairs."""
        nf = len(self.families)
        for a, b in words.batches(texts):
            grams, at, which, bounds = word_grams(texts[a:b])
            for k in range(b - a):
                own = which[bounds[k] : bounds[k + 1]]
                if not len(own):
                    continue
                distinct, times = np.unique(own, return_counts=True)
                n = at[distinct + 1] - at[distinct]
                index = grams[np.repeat(at[distinct] - np.cumsum(n) + n, n) + np.arange(n.sum())]
                value = np.repeat(times, n) / (times @ n)
                value = np.bincount(index, weights=value)
                index = np.flatnonzero(value)
                value = value[index]
                lang = langs[a + k]
                got = value @ self.weights[index] * scale
                got[nf:] *= self.shrunk
                p = np.exp(got[:nf] - got[:nf].max(initial=0))
                step = np.zeros(len(got))
                step[:nf] = -p / p.sum()
                step[self.family[lang]] += 1
                for j, (x, y) in enumerate(self.pairs):
                    if lang in (x, y):
                        sign = 1 if lang == x else -1
                        step[nf + j] = sign * (sign * got[nf + j] < 1)
                norm = max(1e-9, float(value @ value))
                self.shrunk[self.own[lang]] *= 1 - rate * PENALTY
                step[nf:] /= self.shrunk
                self.weights[index] += (rate / (scale * norm)) * np.outer(value, step).astype(np.float32)
            if average:
                self.total += self.effective()
                self.times += 1

    def predict(self, texts: list[str], scale: float = 40.0) -> tuple[list[str], np.ndarray]:
        if not self.languages:
            return ["und"] * len(texts), np.zeros(len(texts))
        got = margins(texts, self.weights) * scale
        nf = len(self.families)
        found, score = [], np.zeros(len(texts))
        for k, m in enumerate(got):
            if np.isnan(m[0]):
                found.append("und")
                continue
            p = np.exp(m[:nf] - m[:nf].max())
            p /= p.sum()
            f = int(np.argmax(p))
            votes = {i: [0, 0.0] for i in self.members[f]}
            sure = 1.0
            for j, (x, y) in enumerate(self.pairs):
                if x in votes:
                    w = m[nf + j]
                    votes[x if w > 0 else y][0] += 1
                    votes[x][1] += np.tanh(w)
                    votes[y][1] -= np.tanh(w)
            best = max(votes, key=lambda i: (votes[i][0], votes[i][1]))
            if len(votes) > 1:
                sure = 1 / (1 + np.exp(-2 * votes[best][1] / (len(votes) - 1)))
            found.append(self.languages[best])
            score[k] = p[f] * sure
        return found, np.clip(score, 0, 1)


def fit(docs: DataFrame, rows: int = ROWS_PER_LANGUAGE) -> Model:
    """A model from at most ``rows`` documents of each language among those that may be learnt from."""
    able = docs.filter(learn_row() & F.col("lang").isNotNull() & F.col("text").isNotNull())
    order = F.xxhash64("doc_id", F.lit("lang"))
    # the first rows of each salted part, then of those: no language's ids meet in one task
    first = lambda *by: F.row_number().over(Window.partitionBy("lang", *by).orderBy("h", "doc_id"))
    parts = able.select("doc_id", "lang", order.alias("h")).distinct().withColumn("r", first(F.pmod("h", F.lit(SALTS)))).filter(F.col("r") <= rows)
    ranked = parts.withColumn("r", first())
    chosen = cut(ranked.filter(F.col("r") <= rows).select("doc_id", "lang", "h"))
    most = chosen.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").limit(MOST_LANGUAGES)
    languages = sorted(r["lang"] for r in most.collect())
    model = Model(languages)
    if not languages:
        return model
    chosen = chosen.filter(F.col("lang").isin(languages))  # at most rows x MOST_LANGUAGES ids
    sample = able.select("doc_id", "lang", "text").join(F.broadcast(chosen), ["doc_id", "lang"])
    one = sample.groupBy("h", "doc_id", "lang").agg(F.min("text").alias("text")).repartition(1).sortWithinPartitions("h", "doc_id", "lang")

    def train(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = Model(languages)
        rows = (row for batch in batches for row in zip(batch["text"], batch["lang"], strict=True))
        while block := list(islice(rows, BLOCK_ROWS)):
            texts, langs = [t for t, _ in block], np.array([languages.index(x) for _, x in block], int)
            for epoch in range(EPOCHS):
                own.learn(texts, langs, 0.5 / (1 + epoch), average=2 * epoch >= EPOCHS)
        weights = own.averaged()
        keep = np.flatnonzero(weights.any(axis=1))
        yield pd.DataFrame({"feature": keep, "weights": list(weights[keep])})

    found = one.select("text", "lang").mapInPandas(train, "feature bigint, weights array<float>").toPandas()  # at most 2**BITS rows
    if len(found):
        model.weights[found["feature"].to_numpy()] = np.vstack(found["weights"].to_numpy())
    return model


def identified(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with lang_pred and score, from the whole text alone."""

    @F.pandas_udf("lang_pred string, score double")
    def predict(texts: pd.Series) -> pd.DataFrame:
        langs, score = model.predict(texts.tolist())
        return pd.DataFrame({"lang_pred": langs, "score": score})

    return docs.withColumn("__p", predict(text_of())).withColumns({"lang_pred": F.col("__p.lang_pred"), "score": F.col("__p.score")}).drop("__p")


def identify(docs: DataFrame, rows: int = ROWS_PER_LANGUAGE) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every document."""
    return identified(docs.select("doc_id", "text"), fit(docs, rows)).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")

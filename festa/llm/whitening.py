"""Embedding whitening by a tall-skinny QR factorisation; no covariance is formed to find the components.

Entries become integers, so that counts, sums and deviations are exact. The fit list (each distinct vector once) is
stored; each partition sums its vectors, then centres them by the exact sums and reduces them, block by block, to one
triangular factor R; the factors are merged in a tree of ``FAN_IN`` until one is left. The right singular vectors of
the last R are the components. Whitening is one more pass over all rows; its identity error is measured on the fit
list by centred moments that merge in the same kind of tree. A task holds a block of rows and a few factors; the
driver only the sums and the last factor, whose size follows the dimensions, not the rows.

Defined results: vectors with a null or non-finite entry go, so do entries of 2**46 and beyond (no exact integer);
the vectors of the most frequent length of the fit list stay (of equally frequent, the longer), all others go;
repeated rows count once in the fit, null and repeated ids give their rows; components of no variance are not
returned, so that one distinct vector, or none, gives an empty result; the sign makes the largest entry positive;
``deviation`` is null where the exact sum, held in ``deviation_exact``, is beyond a long; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from decimal import Decimal
from functools import cached_property

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from festa.llm.common import stored

SCALE, SHIFT = 64, 1_000_000
COMPONENTS = 16
#: Entries stay below this, so that their integers are exact doubles.
MOST_ENTRY = 2.0**46
#: Factors that one task of the tree merges; rows of a block.
FAN_IN = 8
BLOCK_ROWS = 4_096

_OUT = "vec_id bigint, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double, deviation_exact decimal(38,0)"


def valid(embedding: Column) -> Column:
    fits = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) < MOST_ENTRY)
    return F.coalesce(F.forall(embedding, fits), F.lit(False))


def integers(rows: DataFrame, vector: str = "embedding") -> DataFrame:
    """vec_id, x: the rows whose vectors are whole, as integers."""
    kept = rows.filter(valid(F.col(vector)))
    return kept.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.transform(vector, lambda c: F.floor(c.cast("double") * SCALE).cast("bigint") + SHIFT).alias("x"))


def vectors(batches: Iterator[pa.RecordBatch], d: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Blocks of rows with their vectors as one matrix of integers."""
    for batch in batches:
        for start in range(0, batch.num_rows, BLOCK_ROWS):
            part = batch.slice(start, BLOCK_ROWS)
            yield part, part.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


@dataclass(frozen=True)
class Centre:
    """Exact centring: x - sums/n is (x - middle) - rest/n, with whole numbers up to the last step."""

    n: int
    sums: tuple[int, ...]

    @cached_property
    def middle(self) -> np.ndarray:
        return np.array([(2 * s + self.n) // (2 * self.n) for s in self.sums], np.int64)

    @cached_property
    def rest(self) -> list[int]:
        return [s - self.n * int(m) for s, m in zip(self.sums, self.middle, strict=True)]

    def of(self, x: np.ndarray) -> np.ndarray:
        return (x - self.middle).astype(np.float64) - np.array([r / self.n for r in self.rest])

    def deviations(self, x: np.ndarray) -> list[int]:
        """The sum of (n x - sums) squared of each row, as whole numbers of any size."""
        y, rest = x - self.middle, self.rest
        most = int(np.abs(y).max(initial=0))
        if most * most * len(rest) < 2**62 and most * max(1, max(map(abs, rest), default=1)) * len(rest) < 2**62:
            squares, products = (y * y).sum(1).tolist(), (y * np.array(rest, np.int64)).sum(1).tolist()
            fixed = sum(r * r for r in rest)
            return [self.n * self.n * a - 2 * self.n * b + fixed for a, b in zip(squares, products, strict=True)]
        return [sum((self.n * v - r) ** 2 for v, r in zip(row, rest, strict=True)) for row in y.tolist()]


def centre(fit: DataFrame, d: int) -> Centre:
    """The number of vectors and the exact sum of each dimension."""

    def partial(batches):
        high, low, n = np.zeros(d, np.int64), np.zeros(d, np.int64), 0
        for _, x in vectors(batches, d):  # two halves, so that no partition's sum overflows
            high, low, n = high + (x >> 26).sum(0), low + (x & (2**26 - 1)).sum(0), n + len(x)
        if n:
            totals = [Decimal((int(h) << 26) + int(v)) for h, v in zip(high, low, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(range(d), pa.int32()), pa.array(totals, pa.decimal128(38)), pa.array([n] * d, pa.int64())], ["at", "total", "n"])

    parts = fit.select("x").mapInArrow(partial, "at int, total decimal(38,0), n bigint")
    found = sorted(parts.groupBy("at").agg(F.sum("total"), F.sum("n")).collect())  # a row a dimension
    return Centre(found[0][2] if found else 0, tuple(int(t) for _, t, _ in found))


def tree(fit: DataFrame, d: int, reduce: Callable, merge: Callable) -> np.ndarray | None:
    """``reduce`` over the blocks of each partition, then ``merge`` over FAN_IN results at a time, until one is left."""

    def of_partition(batches):
        found = None
        for _, x in vectors(batches, d):
            found = reduce(found, x)
        if found is not None:
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([found.ravel().tolist()])], ["part", "m"])

    def merged(parts: pd.DataFrame) -> pd.DataFrame:
        found = None
        for m in parts.sort_values("part")["m"]:
            found = np.asarray(m) if found is None else merge(found, np.asarray(m))
        return pd.DataFrame([(int(parts["part"].min()) // FAN_IN, found.tolist())], columns=["part", "m"])

    schema = "part bigint, m array<double>"
    parts = stored(fit.select("x").mapInArrow(of_partition, schema))
    left = (parts.agg(F.max("part")).first()[0] or 0) + 1
    while left > 1:
        parts = parts.groupBy(F.floor(F.col("part") / FAN_IN)).applyInPandas(merged, schema)
        left = -(-left // FAN_IN)
    found = parts.collect()  # one row
    return np.asarray(found[0]["m"]) if found else None


def triangle(rows: np.ndarray) -> np.ndarray:
    """R of the rows, square also if there are fewer rows than dimensions."""
    d = rows.shape[1]
    return np.linalg.qr(np.vstack([rows, np.zeros((max(0, d - len(rows)), d))]), mode="r")


def factor(fit: DataFrame, d: int, at: Centre) -> np.ndarray | None:
    """R of the centred fit list."""

    def reduce(r, x):
        rows = at.of(x)
        return triangle(rows if r is None else np.vstack([r, rows]))

    merge = lambda a, b: triangle(np.vstack([a.reshape(d, d), b.reshape(d, d)])).ravel()
    found = tree(fit, d, reduce, merge)
    return None if found is None else found.reshape(d, d)


@dataclass(frozen=True)
class Whitening:
    centre: Centre
    #: Dimensions by components, each a unit vector over the root of its eigenvalue.
    weights: np.ndarray
    explained: np.ndarray

    def of(self, x: np.ndarray) -> np.ndarray:
        return self.centre.of(x) @ self.weights


def whitening(r: np.ndarray, at: Centre, components: int = COMPONENTS) -> Whitening:
    """Components from the last factor: its right singular vectors; values below rounding are no components."""
    _, s, vt = np.linalg.svd(r)
    rank = int((s > s[0] * len(s) * np.finfo(float).eps).sum()) if len(s) and s[0] > 0 else 0
    k = min(components, rank)
    v = vt[:k]
    v = v * np.sign(v[np.arange(k), np.abs(v).argmax(1)])[:, None] if k else v
    return Whitening(at, (v / (s[:k, None] / np.sqrt(at.n))).T, s[:k] ** 2 / max((s**2).sum(), np.finfo(float).tiny))


def identity_error(fit: DataFrame, d: int, how: Whitening) -> float:
    """The largest absolute entry of the whitened fit list's covariance minus the identity, by a pass over the list."""
    k = how.weights.shape[1]

    def merge(a, b):  # n, means, centred scatter
        n, m, gap = a[0], b[0], b[1 : k + 1] - a[1 : k + 1]
        scatter = a[k + 1 :] + b[k + 1 :] + (np.outer(gap, gap) * (n * m / (n + m))).ravel()
        return np.concatenate([[n + m], a[1 : k + 1] + gap * (m / (n + m)), scatter])

    def reduce(found, x):
        w = how.of(x)
        mean = w.mean(0)
        moments = np.concatenate([[len(w)], mean, ((w - mean).T @ (w - mean)).ravel()])
        return moments if found is None else merge(found, moments)

    found = tree(fit, d, reduce, merge)
    return float(np.abs(found[k + 1 :].reshape(k, k) / found[0] - np.eye(k)).max())


def whiten(rows: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """Per row and component: vec_id, component, n, deviation, whitened, explained, identity_error, deviation_exact."""
    spark, all_rows = rows.sparkSession, integers(rows)
    distinct = stored(all_rows.select("x").distinct())
    sizes = distinct.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    d = sizes["d"] if sizes else 0
    if not d:
        return spark.createDataFrame([], _OUT)
    fit = distinct.filter(F.size("x") == d)
    at = centre(fit, d)
    how = whitening(factor(fit, d, at), at, components)
    k = len(how.explained)
    if not k:
        return spark.createDataFrame([], _OUT)
    error = identity_error(fit, d, how)
    fields = [("vec_id", pa.int64()), ("component", pa.int32()), ("n", pa.int64()), ("deviation", pa.int64()), ("whitened", pa.float64()), ("explained", pa.float64()), ("identity_error", pa.float64()), ("deviation_exact", pa.decimal128(38))]

    def project(batches):
        for part, x in vectors(batches, d):
            count, exact = len(x), at.deviations(x)
            each = np.repeat(np.arange(count), k)
            found = [
                part.column("vec_id").take(pa.array(each)),
                np.tile(np.arange(1, k + 1, dtype=np.int32), count),
                np.full(count * k, at.n),
                pa.array([v if v < 2**63 else None for v in exact], pa.int64()).take(pa.array(each)),
                how.of(x).ravel(),
                np.tile(how.explained, count),
                np.full(count * k, error),
                pa.array([Decimal(v) for v in exact], pa.decimal128(38)).take(pa.array(each)),
            ]
            yield pa.RecordBatch.from_arrays([pa.array(c) if isinstance(c, np.ndarray) else c for c in found], schema=pa.schema(fields))

    return all_rows.filter(F.size("x") == d).mapInArrow(project, _OUT)

"""Exact dedup through a minimal perfect hash over the digests of earlier deliveries.

History is summarised as one index row per shard of digests: a levelled minimal perfect hash (every key
takes the first level where no other key shares its bit; the rank of that bit is its slot) and one slot
per key holding the full digest and the locator of the row that wins so far. Arrivals are grouped by
digest, sent to their digest's shard and looked up; a slot counts only if its stored digest has the same
bytes. Members join the stored group, nonmembers form groups of their own.

Defined results: a null text counts as empty; empty texts equal each other; of equal texts the row with
the most code points wins, then the smallest doc_id, a null doc_id last; repeated rows (same id and text)
count in group_size and carry the same decision, and ``deduplicate`` keeps one of them; an empty table
gives an empty result; further columns are ignored by ``groups`` and kept by ``deduplicate``.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from festa.llm.common import WHITE_SPACE, cut, row_key, rows_of_keys, text_of

#: Digests in one index shard: about 60 bytes each, so that a shard is a few MB in one task.
KEYS_PER_SHARD = 50_000
#: Bits of a level for each key that reaches it.
GAMMA = 2

_INDEX = "shard bigint, n_keys bigint, level_sizes array<bigint>, bits binary, digests binary, n_chars array<bigint>, has_ids array<boolean>, turned_ids array<bigint>, counts array<bigint>"
_GROUPS = "digest binary, keep_chars bigint, keep_has_id boolean, keep_turned_id bigint, group_size bigint"


def normalised(text: Column) -> Column:
    return F.regexp_replace(text, f"[{WHITE_SPACE}]+", "")


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, code points of the text, and the digest of the text without white space."""
    text = text_of()
    return docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        F.char_length(text).cast("bigint").alias("n_chars"),
        F.unhex(F.sha2(normalised(text).cast("binary"), 256)).alias("digest"),
    )


def grouped(rows: DataFrame) -> DataFrame:
    """One row per digest: the best row (most code points, then smallest id) and the number of rows."""
    # all bits turned, the least id is the greatest number, and no id overflows
    turned = F.coalesce(F.bitwise_not(F.col("doc_id")), F.lit(0)).alias("turned_id")
    best = F.max(F.struct("n_chars", F.col("doc_id").isNotNull().alias("has_id"), turned))
    return rows.groupBy("digest").agg(best.alias("best"), F.count(F.lit(1)).alias("n")).select("digest", "best.*", "n")


def _positions(words: np.ndarray, level: int, size: int) -> np.ndarray:
    mixed = (words[:, level % 4] ^ np.uint64((0x9E3779B97F4A7C15 * (level + 1)) & (2**64 - 1))) * np.uint64(0xBF58476D1CE4E5B9)
    return ((mixed ^ (mixed >> np.uint64(31))) % np.uint64(size)).astype(np.int64)


def build_levels(keys: np.ndarray) -> tuple[list[int], np.ndarray]:
    """Level sizes and bits of a minimal perfect hash over distinct keys, an n x 4 array of 64-bit words."""
    sizes, bits, left, level = [], [], keys, 0
    while len(left):
        size = max(8, GAMMA * len(left))
        at = _positions(left, level, size)
        alone = np.bincount(at, minlength=size) == 1
        sizes.append(size)
        bits.append(alone)
        left = left[~alone[at]]
        level += 1
    return sizes, np.concatenate(bits) if bits else np.zeros(0, bool)


def slots_of(keys: np.ndarray, sizes: list[int], bits: np.ndarray) -> np.ndarray:
    """The slot of each key, or -1 where no level has its bit (surely not a member)."""
    rank = np.cumsum(bits) - 1
    slot = np.full(len(keys), -1, np.int64)
    left, start = np.arange(len(keys)), 0
    for level, size in enumerate(sizes):
        if not len(left):
            break
        at = start + _positions(keys[left], level, size)
        hit = bits[at]
        slot[left[hit]] = rank[at[hit]]
        left, start = left[~hit], start + size
    return slot


def _words(column) -> np.ndarray:
    return np.frombuffer(b"".join(column), "<u8").reshape(-1, 4)


def _build_shard(rows: pd.DataFrame) -> pd.DataFrame:
    keys = _words(rows["digest"])
    sizes, bits = build_levels(keys)
    order = np.argsort(slots_of(keys, sizes, bits))
    take = lambda c: rows[c].to_numpy()[order].tolist()
    found = [int(rows["shard"].iloc[0]), len(rows), sizes, np.packbits(bits).tobytes(), b"".join(take("digest")), *map(take, ("n_chars", "has_id", "turned_id", "n"))]
    return pd.DataFrame([found], columns=["shard", "n_keys", "level_sizes", "bits", "digests", "n_chars", "has_ids", "turned_ids", "counts"])


def _with_shard(rows: DataFrame, shards: int) -> DataFrame:
    return rows.withColumn("shard", F.pmod(F.xxhash64("digest"), F.lit(shards)))


def build_index(history: DataFrame, shards: int) -> DataFrame:
    """One row per shard from grouped history (see ``grouped``); write it as a table to reuse it."""
    return _with_shard(history, shards).groupBy("shard").applyInPandas(_build_shard, _INDEX)


def _look_up(index: pd.DataFrame, arrivals: pd.DataFrame) -> pd.DataFrame:
    """Groups of one shard after the arrivals: each slot's group, and a group for each nonmember."""
    out: list[tuple] = []
    slot = np.full(len(arrivals), -1, np.int64)
    if len(index):
        row = index.iloc[0]
        sizes, n = [int(x) for x in row["level_sizes"]], int(row["n_keys"])
        bits = np.unpackbits(np.frombuffer(row["bits"], np.uint8), count=sum(sizes)).astype(bool)
        stored = np.frombuffer(row["digests"], "<u8").reshape(n, 4)
        if len(arrivals):
            keys = _words(arrivals["digest"])
            slot = slots_of(keys, sizes, bits)
            slot[(slot >= 0) & (stored[np.maximum(slot, 0)] != keys).any(axis=1)] = -1
        held = (row[c].tolist() for c in ("n_chars", "has_ids", "turned_ids", "counts"))
        out = [(stored[i].tobytes(), *group) for i, group in enumerate(zip(*held, strict=True))]
    for s, new in zip(slot.tolist(), zip(*(arrivals[c].tolist() for c in ("digest", "n_chars", "has_id", "turned_id", "n")), strict=True), strict=True):
        if s < 0:
            out.append(new)
        else:
            out[s] = (new[0], *max(out[s][1:4], new[1:4]), out[s][4] + new[4])
    return pd.DataFrame(out, columns=["digest", "keep_chars", "keep_has_id", "keep_turned_id", "group_size"])


def merge(index: DataFrame, arrivals: DataFrame, shards: int) -> DataFrame:
    """The groups of history and grouped arrivals together, one row per digest."""
    return index.groupBy("shard").cogroup(_with_shard(arrivals, shards).groupBy("shard")).applyInPandas(_look_up, _GROUPS)


def groups(docs: DataFrame, is_history: Column | None = None) -> DataFrame:
    """Per row: doc_id, keep_id, group_size, kept, text_sha256. Rows that are not ``is_history`` arrive after it."""
    if is_history is None:
        is_history = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    rows = cut(digests(docs))
    split = F.coalesce(is_history, F.lit(False))
    history, arrivals = cut(grouped(rows.filter(split))), cut(grouped(rows.filter(~split)))
    shards = max(1, -(-max(history.count(), arrivals.count()) // KEYS_PER_SHARD))
    found = merge(build_index(history, shards), arrivals, shards)
    keep_id = F.when(F.col("keep_has_id"), F.bitwise_not(F.col("keep_turned_id")))
    kept = (F.col("doc_id").eqNullSafe(keep_id) & (F.col("n_chars") == F.col("keep_chars"))).alias("kept")
    return rows.join(found, "digest").select("doc_id", keep_id.alias("keep_id"), "group_size", kept, F.lower(F.hex("digest")).alias("text_sha256"), "n_chars")


def deduplicate(docs: DataFrame) -> DataFrame:
    """The rows that stay, with all their columns, once each."""
    key = lambda sha, n: row_key(F.col("doc_id").cast("bigint"), F.concat_ws(":", sha, n.cast("string")))
    kept = groups(docs).filter("kept").select(key(F.col("text_sha256"), F.col("n_chars")))
    return rows_of_keys(docs, key(F.sha2(normalised(text_of()).cast("binary"), 256), F.char_length(text_of())), kept)

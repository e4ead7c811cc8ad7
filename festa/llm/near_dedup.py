"""Near-duplicate detection by Order MinHash and banded alignment.

A text is its sequence of words (runs of letters and digits, lower case; of other signs if it has none).
Texts with the same sequence are one node. A node's k-mers are runs of five words labelled by occurrence; each
of several sketches takes the least of them under its own hash and retains their order in the text, so that
texts agree on a sketch the more likely the nearer they are by edit distance. Edits at every fifth word leave no
run of five, so that a second family of sketches takes runs of three words (of two in texts under 30 words, where
few runs are left); texts under ten words, which the threshold allows one edit, have themselves and themselves
without each word as keys, which two texts one edit apart always share. Nodes that agree on a key meet in a bucket.
Each member is first compared with the bucket's leader, the first in one of a few pseudo-random orders. Buckets that
this leaves in several components are then gone through whole, those of one leader as one group: its members' words
move to where they meet, an index of words tells how many any two have in common, and every pair of two components is
compared there unless that proves it too far apart. Pairs are never rows: a part of a group gives its links alone.
A group in which more than CROWDED members lie outside its largest component is split before: its texts share a
passage and little else. Similar texts have most of their words, and of their pairs of neighbours, in common, so that
each must share one of its rarest in the group (``rarest``: prefix filter, exact): members meet under those, by words or
by pairs, whichever lets fewer texts of a group meet; a group that neither parts better stays whole. The passage, being
frequent, comes last and brings none together. So no pair of a bucket stays neither linked nor compared nor told apart.
A comparison aligns the two word sequences within a band:
their edit similarity (1 - edits / longer length) must be 0.8 or more. Classes are the connected components of the
links found.

Scripts written without spaces (Han, Kana, Thai, Lao, Khmer, Myanmar) have one word at each sign.

Defined results: a class is named by its least doc_id; a null text counts as empty, texts without any sign
are one class; texts under five words are one k-mer; rows with a null doc_id join the class of their text
and name it by null only if none of its rows has an id; different texts under one doc_id are different nodes;
of each class ``deduplicate`` keeps the row of least doc_id (null last), then of least SHA-256 of the text; an
empty table gives an empty result; further columns are ignored by ``classes`` and kept by ``deduplicate``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache
from itertools import chain, groupby, islice, pairwise
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from festa.llm import words
from festa.llm.common import cut, row_key, rows_of_keys, sized, stored, text_of
from festa.llm.langid import _lower as lower_table

KMER_WORDS = 5
SIMILARITY = 0.8
SKETCHES = 24
#: Sketches of the shorter k-mers: at edit similarity 0.8, scattered edits leave J = 0.34 of the runs of three words, evenly spread ones 0.25;
#: a sketch agrees with about J ** 2, so that 64 find over 99.9 and 98.4 % of such pairs.
SHORT_SKETCHES, SHORT_WORDS = 64, 3
#: Texts under this many words take runs of two words; longer ones that may be similar to such a text take both.
FEW_WORDS = 30
#: Texts of this many words have enough k-mers in every sketch's range of one permutation; shorter ones are hashed once a sketch.
MANY_WORDS = 16 * max(SKETCHES, SHORT_SKETCHES)
#: Texts of fewer words may differ by one edit at most.
ONE_EDIT_WORDS = 10
#: Least k-mers that a sketch retains.
RETAINED = 2
#: Up to so many nodes are broadcast to where their words lie (8 MB).
FEW_NODES = 1_000_000
#: Up to so many bytes of words are broadcast to the pairs to be compared; more are joined by a shuffle.
FEW_BYTES = 16 * 2**20
#: Pseudo-random orders in which a bucket's first member leads it.
LEADERS = 4
#: Rounds of leaders; each takes up what the one before left over. What then is unlinked is compared pair by pair, so that more rounds only move work.
ROUNDS = 1
#: Members of a group that one task sets against all others, and their words; texts that are looked up in an index at once.
PART, BLOCK = (1_024, 2**22), 64
#: Classes of words that are counted to tell texts apart (``maybe_similar``; the search counts the words themselves).
COUNTS = 128
#: A group with more members outside its largest component is split by the rarest runs of so many words. Both ways are exact; up to about that
#: size a member costs less looked up in an index of all others than with its words sorted by how many texts have them (26,408 members of 350
#: words: 164 task seconds and 349 MB shuffled against 278 and 862).
CROWDED, SPLIT_WORDS = 40_000, (1, 2)
#: Runs of more texts of a group are frequent; they are few, and looked up without moving their rows.
FREQUENT = 1_000
#: Signs of scripts without spaces between words.
_SIGNS = [(0x0E00, 0x0F00), (0x1000, 0x10A0), (0x1780, 0x1800), (0x3005, 0x3008), (0x3041, 0x3100), (0x31F0, 0x3200), (0x3400, 0x4DC0), (0x4E00, 0xA000), (0xF900, 0xFB00), (0xFF66, 0xFFA0), (0x20000, 0x323B0)]


@cache
def _signs() -> np.ndarray:
    """Which letters are words by themselves."""
    table = np.zeros(0x110000, bool)
    for a, b in _SIGNS:
        table[a:b] = True
    return table & (words.classes() == words.LETTER)


def token_arrays(texts: list[str]) -> list[np.ndarray]:
    """The 64-bit word hashes of each text, in order."""
    out: list[np.ndarray] = []
    for a, b in words.batches(texts):
        codes, kinds, bounds = words.points(texts[a:b])
        kinds = np.where(kinds == words.NUMBER, words.LETTER, kinds)
        sign = _signs()[codes]
        alone = sign | np.concatenate(([False], sign[:-1]))
        start = np.flatnonzero((np.diff(kinds, prepend=words.BREAK) != 0) | (kinds == words.BREAK) | alone)
        end = np.append(start[1:], len(codes))
        h = words.hashes(lower_table()[codes], start, end)
        kind, at = kinds[start], np.searchsorted(start, bounds)
        for i, j in zip(at[:-1], at[1:], strict=True):
            own = h[i:j][kind[i:j] == words.LETTER]
            out.append(own if len(own) else h[i:j][kind[i:j] == words.OTHER])
    return out


def kmers(tokens: np.ndarray, k: int = KMER_WORDS) -> np.ndarray:
    """Hashes of all runs of k words, each mixed with the number of equal runs before it."""
    n = max(1, len(tokens) - k + 1)
    h = np.zeros(n, np.uint64)
    for j in range(min(k, len(tokens))):
        h = words.mix(h) + tokens[j : j + n]
    order = np.argsort(h, kind="stable")
    sorted_ = h[order]
    new = np.diff(sorted_, prepend=sorted_[:1] ^ np.uint64(1)) != 0
    first = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    label = np.empty(n, np.uint64)
    label[order] = (np.arange(n) - first).astype(np.uint64)
    return words.mix(h + label * np.uint64(0xA0761D6478BD642F))


def _retained(h: np.ndarray, at: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    """One key for each row of places: the k-mers there, in the order of the text."""
    at, key = np.sort(at, axis=1), seeds.copy()
    for j in range(at.shape[1]):
        key = words.mix(key + h[at[:, j]])
    return key


def _seeds(sketches: int, kind: int) -> np.ndarray:
    return words.mix(np.arange(1, sketches + 1, dtype=np.uint64) * np.uint64(0xE7037ED1A0B428DB) + np.uint64(kind))


def order_min_hash(h: np.ndarray, sketches: int = SKETCHES, retained: int = RETAINED) -> np.ndarray:
    """One 64-bit key per sketch: the k-mers ``h`` that are least under its own hash, in the order of the text."""
    seeds = _seeds(sketches, 0)
    low, turn = seeds.astype(np.uint32), (seeds >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
    value = ((h >> np.uint64(32)).astype(np.uint32)[None, :] ^ low[:, None]) * turn[:, None]
    rows, taken = np.arange(sketches), []
    for _ in range(min(retained, len(h))):
        at = value.argmin(axis=1)
        value[rows, at] = np.uint32(2**32 - 1)
        taken.append(at)
    return _retained(h, np.stack(taken, axis=1), seeds)


def order_min_hash_of_many(h: np.ndarray, sketches: int = SKETCHES, retained: int = RETAINED) -> np.ndarray:
    """As ``order_min_hash``, by one permutation: each sketch has its own range of hashes and takes the least in it."""
    order = np.argsort(h)
    edges = np.array([i * 2**64 // sketches for i in range(sketches)], np.uint64)
    first = np.searchsorted(h[order], edges)
    full = np.diff(first, append=len(h)) >= retained
    return _retained(h, order[first[full, None] + np.arange(retained)], _seeds(sketches, 1)[full])


def sketched_keys(tokens: np.ndarray, sketches: int, k: int) -> list[np.ndarray]:
    """The keys of one family: by one permutation for texts of many k-mers, by one hash a sketch for others; both between."""
    h, found = kmers(tokens, k), []
    if len(tokens) >= MANY_WORDS:
        found.append(order_min_hash_of_many(h, sketches))
    if len(tokens) <= (MANY_WORDS - 1) / SIMILARITY:
        found.append(order_min_hash(h, sketches))
    return found


def keys_of(tokens: np.ndarray, sketches: int = SKETCHES) -> np.ndarray:
    """All keys of a text: sketches of both families and, for a short text, itself and itself without each word."""
    n = len(tokens)
    if not n:
        return np.empty(0, np.uint64)
    found = sketched_keys(tokens, sketches, KMER_WORDS)
    if n >= FEW_WORDS:
        found += sketched_keys(tokens, SHORT_SKETCHES, SHORT_WORDS)
    if n <= (FEW_WORDS - 1) / SIMILARITY:
        found += sketched_keys(tokens, SHORT_SKETCHES, SHORT_WORDS - 1)
    if n < ONE_EDIT_WORDS:
        variants = [tokens, *(np.delete(tokens, i) for i in range(n))]
        found.append(np.array([int.from_bytes(hashlib.blake2b(v.tobytes(), digest_size=8).digest(), "little") for v in variants], np.uint64))
    return np.unique(np.concatenate(found))


def _common(a: np.ndarray, b: np.ndarray) -> int:
    """How many of the values two arrays have in common, repeats counted."""
    va, ca = np.unique(a, return_counts=True)
    vb, cb = np.unique(b, return_counts=True)
    at = np.minimum(np.searchsorted(vb, va), len(vb) - 1)
    return int(np.minimum(ca, np.where(vb[at] == va, cb[at], 0)).sum())


def least_distance(a: np.ndarray, b: np.ndarray) -> int:
    """A lower bound of the edit distance: each word without a partner costs an edit, and an edit breaks two pairs of neighbours at most."""
    longer = max(len(a), len(b))
    found = longer - _common(a, b)
    if min(len(a), len(b)) > 1:
        pairs = [x[:-1].astype(np.uint64) << np.uint64(32) | x[1:].astype(np.uint64) for x in (a, b)]
        found = max(found, -(-(longer - 1 - _common(*pairs)) // 2))
    return found


def within(a: np.ndarray, b: np.ndarray, most: int) -> bool:
    """Whether the edit distance of two sequences of 32-bit words is at most ``most``: bit-parallel alignment in a band.

    The band is widened fourfold until it holds the distance, so that texts of few edits are aligned in a narrow one.
    """
    if abs(len(a) - len(b)) > most:
        return False
    n = min(len(a), len(b))
    same = a[:n] == b[:n]
    head = n if same.all() else int(np.argmin(same))
    a, b, n = a[head:], b[head:], n - head
    same = a[len(a) - n :][::-1] == b[len(b) - n :][::-1]
    tail = n if same.all() else int(np.argmin(same))
    a, b = a[: len(a) - tail], b[: len(b) - tail]
    if not len(a) or not len(b):
        return max(len(a), len(b)) <= most
    least = least_distance(a, b)
    if least > most:
        return False
    band = max(least, 30)
    while band < most:
        if _aligned(a, b, band):
            return True
        band *= 4
    return _aligned(a, b, most)


def _aligned(a: np.ndarray, b: np.ndarray, d: int) -> bool:
    """Whether the edit distance is at most d, in a band of 2 d + 1 rows."""
    if abs(len(a) - len(b)) > d:
        return False
    m, n = len(a), len(b)
    places: dict[int, int] = {}
    for r, x in enumerate(a.tolist()):
        places[x] = places.get(x, 0) | (1 << r)
    mask = (1 << (2 * d + 1)) - 1
    up, down, distance = mask ^ ((1 << d) - 1), 0, min(d, m)
    for col, x in enumerate(b.tolist(), 1):
        found = places.get(x, 0)
        shift = col - d - 1
        equal = (found >> shift if shift >= 0 else found << -shift) & mask
        diagonal = ((((equal & up) + up) ^ up) | equal | down) & mask
        right_up = down | (mask & ~(diagonal | up))
        right_down = diagonal & up
        if col <= m - d:
            distance += 1 - (diagonal >> (2 * d) & 1)
            if distance > d + (n - m + d):
                return False
        else:
            row = m - col + d
            if row < 0:
                return False
            distance += (right_up >> row & 1) - (right_down >> row & 1)
            if distance - (n - col) > d:
                return False
        up = (right_down | (mask & ~((diagonal >> 1) | right_up))) & mask
        down = (diagonal >> 1) & right_up
    return distance <= d


def similar(a: np.ndarray, b: np.ndarray, least: float = SIMILARITY) -> bool:
    return within(a, b, int((1 - least) * max(len(a), len(b)) + 1e-9))


def _sha() -> Column:
    return F.unhex(F.sha2(text_of().cast("binary"), 256))


def _sketched(docs: DataFrame, sketches: int) -> DataFrame:
    """doc_id, sha (of the text), sequence (digest of the words), n words, keys, tokens (32 bits a word)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tokens = token_arrays(batch.column("text").to_pylist())
            digest = [hashlib.blake2b(t.tobytes(), digest_size=16).digest() for t in tokens]
            keys = [keys_of(t, sketches).view(np.int64) for t in tokens]
            flat = pa.array(np.concatenate(keys) if keys else np.empty(0, np.int64))
            offsets = pa.array(np.cumsum([0, *map(len, keys)]).astype(np.int32))
            short = pa.array([(t >> np.uint64(32)).astype("<u4").tobytes() for t in tokens], pa.binary())
            made = [pa.array(digest, pa.binary()), pa.array([len(t) for t in tokens], pa.int32()), pa.ListArray.from_arrays(offsets, flat), short]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("sha"), *made], ["doc_id", "sha", "sequence", "n", "keys", "tokens"])

    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), _sha().alias("sha"), text_of().alias("text"))
    return texts.mapInArrow(run, "doc_id bigint, sha binary, sequence binary, n int, keys array<bigint>, tokens binary")


def _asked(tokens: DataFrame, nodes: DataFrame) -> DataFrame:
    """The words of some nodes: found where they lie if the nodes are few enough to be broadcast, else by a shuffle, kept for further use."""
    nodes = sized(nodes.select("node").distinct(), 200_000)
    if nodes.count() <= FEW_NODES:
        return tokens.join(F.broadcast(nodes), "node", "left_semi")
    return sized(tokens.join(nodes, "node", "left_semi"), 5_000)


def _verified(pairs: DataFrame, tokens: DataFrame, least: float) -> DataFrame:
    """The pairs (node, leader) whose texts are similar."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = batch.column("tokens").to_pylist(), batch.column("leader_tokens").to_pylist()
            keep = [similar(np.frombuffer(x, "<u4"), np.frombuffer(y, "<u4"), least) for x, y in zip(a, b, strict=True)]
            yield batch.select(["node", "leader"]).filter(pa.array(keep, pa.bool_()))

    pairs = sized(pairs.select("node", "leader"), 20_000)
    node, leader = (pairs.select(F.col(c).alias("node")) for c in ("node", "leader"))
    few = (_asked(tokens, node.unionByName(leader)).agg(F.sum(F.length("tokens"))).first()[0] or 0) <= FEW_BYTES
    # each side takes the words of its own nodes alone
    mine, its = (F.broadcast(_asked(tokens, side)) if few else _asked(tokens, side) for side in (node, leader))
    # comparing costs far more than moving the pairs: over as many tasks as there are, some thousand pairs each
    pairs = pairs.repartition(max(1, min(int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions")), pairs.count() // 2_000)))
    leaders = its.select(F.col("node").alias("leader"), F.col("tokens").alias("leader_tokens"))
    return pairs.join(mine, "node").join(leaders, "leader").select("node", "leader", "tokens", "leader_tokens").mapInArrow(run, "node bigint, leader bigint")


def maybe_similar(counts: np.ndarray, n: np.ndarray, other: np.ndarray, other_n: int, least: float = SIMILARITY) -> np.ndarray:
    """Whether texts may be similar to another, by word counts: an edit changes their sum of differences by two at most."""
    longer = np.maximum(n, other_n)
    near = np.flatnonzero(np.abs(n - other_n) <= np.floor((1 - least) * longer + 1e-9))
    apart = np.abs(counts[near].astype(np.int16) - other.astype(np.int16)).sum(axis=1, dtype=np.int64)
    out = np.zeros(len(n), bool)
    out[near[apart <= 2 * np.floor((1 - least) * longer[near] + 1e-9)]] = True
    return out


def _standing(members: DataFrame, labels: DataFrame, least_size: int) -> DataFrame:
    """The members (key, node, n, …) with label, bulk (of the bucket's largest component), others (members outside it) and their words, of buckets in several components."""
    told = members.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    of_label = told.groupBy("key", "label").agg(F.count(F.lit(1)).alias("size"), F.sum("n").alias("words"))
    total = (F.sum("size").alias("of"), F.sum("words").alias("of_words"), F.count(F.lit(1)).alias("labels"))
    most = of_label.groupBy("key").agg(F.max(F.struct("size", "label", "words")).alias("most"), *total)
    others = ((F.col("of") - F.col("most.size")).alias("others"), (F.col("of_words") - F.col("most.words")).alias("words"))
    most = most.filter((F.col("labels") > 1) & (F.col("of") >= least_size)).select("key", F.col("most.label").alias("bulk_label"), *others)
    return told.join(most, "key").withColumn("bulk", F.col("label") == F.col("bulk_label")).drop("bulk_label")


def rarest(words_of: int, k: int, least: float = SIMILARITY) -> int:
    """Of a text's runs of k words in any one order, so many first ones hold one that a similar text has among its own first ones.

    An edit breaks k runs at most and there are at most (1 - least) * n edits for the longer text of n words, so that
    the two have (1 - k * (1 - least)) * n - (k - 1) runs in common at least.
    """
    shared = int(np.ceil((1 - k * (1 - least)) * words_of - (k - 1) - 1e-9))
    return max(1, words_of - k + 1) - max(1, shared) + 1


def _split(groups: DataFrame, tokens: DataFrame, least: float) -> DataFrame:
    """key, node: the parts of crowded groups (key, node, bulk, others) under whose key similar members of two components meet."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, node, bulk, text in zip(*(batch.column(c).to_pylist() for c in ("key", "node", "bulk", "tokens")), strict=True):
                own = np.frombuffer(text, "<u4").astype(np.uint64)
                for k in SPLIT_WORDS:
                    found = kmers(own, k).view(np.int64)
                    n = len(found)
                    most = np.full(n, rarest(len(own), k, least), np.int32)
                    same = [np.full(n, key, np.int64), np.full(n, node, np.int64), np.full(n, bulk), np.full(n, k, np.int32)]
                    yield pa.RecordBatch.from_arrays([*map(pa.array, (*same, found, most))], ["key", "node", "bulk", "k", "run", "most"])

    by = ["key", "k", "run"]
    runs = groups.join(_asked(tokens, groups), "node").select("key", "node", "bulk", "tokens")
    runs = stored(runs.mapInArrow(run, "key bigint, node bigint, bulk boolean, k int, run bigint, most int"))
    count = F.count(F.lit(1))
    counted = sized(runs.groupBy(*by).agg(count.alias("texts")).filter("texts > 1"), 200_000)
    frequent = counted.filter(F.col("texts") > FREQUENT).withColumnRenamed("texts", "many")
    some = F.broadcast if frequent.count() <= FEW_NODES else (lambda df: df)
    told = runs.join(some(frequent), by, "left")
    few = told.filter("many is null").join(counted.filter(F.col("texts") <= FREQUENT), by, "left").withColumn("texts", F.coalesce("texts", F.lit(1)))
    told = few.unionByName(told.filter("many is not null").withColumn("texts", F.col("many"))).drop("many")
    order = Window.partitionBy("key", "node", "k").orderBy("texts", "run")
    first = told.withColumn("r", F.row_number().over(order)).filter("r <= most and texts > 1")
    first = sized(first.select("key", "k", "node", "bulk", F.xxhash64("key", "k", "run").alias("part")), 200_000)
    parts = first.groupBy("key", "k", "part").agg(count.alias("size"), F.sum((~F.col("bulk")).cast("bigint")).alias("others"))
    parts = sized(parts.filter("size > 1 and others > 0"), 200_000)
    work = F.sum(F.col("others").cast("double") * F.col("size"))
    whole = groups.groupBy("key").agg((F.max("others").cast("double") * count).alias("work")).select("key", F.lit(0).alias("k"), "work")
    # runs of a width that bring no two texts together leave nothing to compare
    widths = groups.select("key").distinct().select("key", F.explode(F.array(*map(F.lit, SPLIT_WORDS))).alias("k"))
    offered = whole.unionByName(widths.join(parts.groupBy("key", "k").agg(work.alias("work")), ["key", "k"], "left").fillna(0.0, ["work"]))
    chosen = cut(offered.groupBy("key").agg(F.min(F.struct("work", "k")).alias("c")).select("key", "c.k"))
    by_run = first.join(parts.join(chosen, ["key", "k"]).select("part"), "part").select(F.col("part").alias("key"), "node")
    return groups.join(chosen.filter("k = 0"), "key").select("key", "node").unionByName(by_run)


def word_index(runs: list[np.ndarray]) -> tuple[np.ndarray, ...]:
    """The values in some texts' runs, and which texts have each: frequent values as rows of a table, others as lists of texts."""
    values, owners = np.concatenate(runs), np.repeat(np.arange(len(runs)), [len(r) for r in runs])
    order = np.argsort(values, kind="stable")
    values, first, size = np.unique(values[order], return_index=True, return_counts=True)
    owners, frequent = owners[order], 4 * size > len(runs)
    row = np.where(frequent, np.cumsum(frequent) - 1, -1)
    table, row_of = np.zeros((int(frequent.sum()), len(runs)), np.float32), np.repeat(row, size)
    table[row_of[row_of >= 0], owners[row_of >= 0]] = 1
    return values, first, size, owners, row, table


def in_common(index: tuple[np.ndarray, ...], runs: list[np.ndarray]) -> np.ndarray:
    """How many runs each of some texts (down) has in common with each text of the index (across)."""
    values, first, size, owners, row, table = index
    found, of = np.concatenate(runs), np.repeat(np.arange(len(runs)), [len(r) for r in runs])
    at = np.minimum(np.searchsorted(values, found), len(values) - 1)
    hit = values[at] == found
    at, of = at[hit], of[hit]
    frequent = row[at] >= 0
    has = np.zeros((len(runs), len(table)), np.float32)
    has[of[frequent], row[at[frequent]]] = 1
    out = (has @ table).astype(np.int64)
    at, of = at[~frequent], of[~frequent]
    many = size[at]
    place = np.repeat(first[at] - np.cumsum(many) + many, many) + np.arange(many.sum())
    return out + np.bincount(np.repeat(of, many) * out.shape[1] + owners[place], minlength=out.size).reshape(out.shape)


def _links_of(key: int, members: Iterator[tuple], least: float) -> Iterator[tuple[int, int]]:
    """Links (node, leader) between the texts of one part of a group, as few as join what is similar there.

    A member is (side, node, label, keys of its groups, words). Those of side 0 come first; they meet each other, then each
    of side 1. Pairs that have more words without a partner than they may have edits are told apart by an index, so that only
    the others are aligned; a pair that meets in several groups is aligned in the first.
    """
    roots: dict[int, int] = {}

    def root(x: int) -> int:
        while (up := roots.get(x, x)) != x:
            roots[x] = x = roots.get(up, up)
        return x

    index = None
    for side, these in groupby(members, itemgetter(0)):
        while block := list(these if side == 0 else islice(these, BLOCK)):
            words_of = [np.frombuffer(m[4], "<u4") for m in block]
            runs = [kmers(w.astype(np.uint64), 1) for w in words_of]
            n, labels = np.array([len(w) for w in words_of]), np.array([m[2] for m in block])
            if side == 0:
                index, its, its_words, its_n, its_labels = word_index(runs), block, words_of, n, labels
            for i in range(0, len(block) if index else 0, BLOCK):
                longer = np.maximum(n[i : i + BLOCK, None], its_n)
                near = longer - in_common(index, runs[i : i + BLOCK]) <= np.floor((1 - least) * longer + 1e-9)
                for x, y in np.argwhere(near & (labels[i : i + BLOCK, None] != its_labels)).tolist():
                    a, b = block[i + x], its[y]
                    mine, other = root(a[2]), root(b[2])
                    if (side == 0 and a[1] <= b[1]) or mine == other or min(set(a[3]).intersection(b[3])) != key:
                        continue
                    if similar(words_of[i + x], its_words[y], least):
                        roots[mine] = other
                        yield max(a[1], b[1]), min(a[1], b[1])


def _grouped(met: DataFrame) -> DataFrame:
    """key, node, n: buckets of one leader are one group, for the same texts meet in many of them, unless that makes far more pairs than they have."""
    sizes = met.groupBy("leader").agg(F.count_distinct("node").cast("double").alias("nodes"), F.sum("others").alias("pairs"))
    whole = F.col("nodes") * F.col("nodes") <= 4 * F.col("pairs")
    return met.join(sizes, "leader").select(F.when(whole, F.col("leader")).otherwise(F.col("key")).alias("key"), "node", "n").distinct()


def _unlinked(members: DataFrame, labels: DataFrame, tokens: DataFrame, least: float) -> DataFrame:
    """Links (node, leader) between members of a bucket whose labels differ, after every such pair was compared or told apart; crowded groups are split first."""
    met = sized(_standing(members, labels, 3), 200_000)  # two members have met as leader and member
    met = sized(_standing(_grouped(met), labels, 2), 200_000)
    crowded = met.filter(F.col("others") > CROWDED)
    if crowded.limit(1).count():
        split = _split(crowded.select("key", "node", "bulk", "others"), tokens, least).join(crowded.select("node", "n").distinct(), "node")
        met = sized(met.filter(F.col("others") <= CROWDED).unionByName(_standing(split, labels, 2)), 200_000)
    # members outside the largest component are dealt to the parts of their group; they meet each other there, and those of half the other parts; its own members meet all
    parts = F.ceil(F.greatest(F.col("others") / PART[0], F.col("words") / PART[1])).cast("int")
    met = met.withColumn("parts", parts).withColumn("own", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))

    def meets(part: Column) -> Column:
        ahead = F.pmod(F.col("own") - part, F.col("parts"))
        return F.col("bulk") | (2 * ahead < F.col("parts")) | ((2 * ahead == F.col("parts")) & (part < F.col("own")))

    part = F.explode(F.filter(F.sequence(F.lit(0), F.col("parts") - 1), meets))
    side = F.when(F.col("bulk") | (F.col("own") != F.col("part")), 1).otherwise(0)
    dealt = met.select("key", "node", "label", "bulk", "own", part.alias("part")).select("key", "part", side.alias("side"), "node", "label")
    keys = met.groupBy("node").agg(F.collect_list("key").alias("keys"))
    texts = _asked(tokens, met).join(keys, "node")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for batch in batches:
                yield from zip(*(batch.column(c).to_pylist() for c in ("key", "part", "side", "node", "label", "keys", "tokens")), strict=True)

        links = chain.from_iterable(_links_of(key, (m[2:] for m in its), least) for (key, _), its in groupby(rows(), itemgetter(0, 1)))
        while some := list(islice(links, 10_000)):
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*some, strict=True)], ["node", "leader"])

    moved = dealt.join(texts, "node").repartition("key", "part").sortWithinPartitions("key", "part", "side")
    return moved.select("key", "part", "side", "node", "label", "keys", "tokens").mapInArrow(run, "node bigint, leader bigint").distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, component (its least node) for every node of the edges (a, b), by alternating large and small stars."""
    edges = sized(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b"), 200_000)
    state = None
    while True:
        both = edges.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("e")).select("e.a", "e.b")
        least = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b")
        center = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(center, "a").select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("e")).select("e.a", "e.b")
        edges = sized(small.filter("a <> b").distinct(), 200_000)
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == state:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
        state = now


def _labelled(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """Pairs (node, leader, …) with the labels of both."""
    mine, its = labels.withColumnRenamed("label", "mine"), labels.select(F.col("node").alias("leader"), F.col("label").alias("its"))
    told = pairs.join(mine, "node", "left").join(its, "leader", "left")
    return told.withColumns({"mine": F.coalesce("mine", "node"), "its": F.coalesce("its", "leader")})


def _relabelled(labels: DataFrame | None, links: DataFrame) -> DataFrame:
    """node, label after more links: nodes of one label are linked; what the labels have joined is one node for the components."""
    if labels is not None and not links.limit(1).count():
        return labels
    if labels is None:
        whole = components(links.select(F.col("node").alias("a"), F.col("leader").alias("b")))
        return sized(whole.withColumnRenamed("component", "label"), 200_000)
    between = _labelled(links, labels).filter("mine <> its").select(F.col("mine").alias("a"), F.col("its").alias("b")).distinct()
    whole = components(between).withColumnRenamed("node", "label")
    nodes = labels.select("node").unionByName(links.select("node")).unionByName(links.select(F.col("leader").alias("node"))).distinct()
    told = nodes.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node")).join(whole, "label", "left")
    return sized(told.select("node", F.coalesce("component", "label").alias("label")), 200_000)


def _foremost(pairs: DataFrame, *of: Column | str) -> DataFrame:
    """Of the pairs (node, leader, agree) of each group the one whose texts agree on most keys."""
    best = F.max(F.struct("agree", F.xxhash64("node", "leader").alias("h"), "node", "leader")).alias("best")
    return pairs.groupBy(*of).agg(best).select("best.node", "best.leader")


def _apart(pairs: DataFrame, labels: DataFrame | None) -> DataFrame:
    """Pairs that are not known to be linked."""
    return pairs if labels is None else _labelled(pairs, labels).filter("mine <> its").drop("mine", "its")


def _meeting(members: DataFrame, turn: int = 0) -> DataFrame:
    """The members (key, node, n, leader, leader_n) of buckets where texts meet; all move once, by key, are counted where they are and meet their leader."""
    # dealt before the window, so that what it takes the least of is made where it is used and not moved
    members, bucket = members.select("key", "node", "n").repartition("key"), Window.partitionBy("key")
    # few orders in all: the buckets of one class then mostly have the same leaders, and few pairs to compare
    order = F.xxhash64("node", F.pmod("key", F.lit(LEADERS)), F.lit(turn))
    first = F.min(F.struct(order.alias("h"), "node", "n")).over(bucket)
    met = members.select("key", "node", "n", F.count(F.lit(1)).over(bucket).alias("size"), first.alias("first")).filter("size > 1")
    return sized(met.select("key", "node", "n", F.col("first.node").alias("leader"), F.col("first.n").alias("leader_n")), 200_000)


def _classed(docs: DataFrame, least: float, sketches: int, rounds: int) -> DataFrame:
    """doc_id, sha, n, class_id, class_size, kept (the class's row that stays) for every row."""
    # a row's number, fixed by the checkpoint, names it; a node has the number of its first row
    rows = cut(_sketched(docs, sketches)).withColumn("at", F.monotonically_increasing_id())
    row = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "sha", "at")
    nodes = rows.groupBy("sequence").agg(F.min(row).alias("row"), F.first("n").alias("n"), F.count(F.lit(1)).alias("copies"))
    nodes = sized(nodes.withColumn("node", F.col("row.at")), 200_000)
    # nodes grow with the table: joined in the same way at every size
    members = rows.select(F.col("at").alias("node"), "keys").join(nodes.select("node", "n").hint("merge"), "node").select("node", "n", F.explode("keys").alias("key"))  # a key tells its sketch too
    members = _meeting(members)
    tokens = _asked(rows.select(F.col("at").alias("node"), "tokens"), members)
    everyone, labels = members, None
    link = lambda pairs: _relabelled(labels, sized(_verified(pairs, tokens, least), 200_000))
    for turn in range(rounds):
        # what is neither the leader nor linked to it; the next round's leaders are chosen among these
        pairs = _apart(members.filter("node <> leader"), labels)
        near = pairs.filter(F.least("n", "leader_n") >= F.lit(least) * F.greatest("n", "leader_n") - 1e-9)
        agreed = sized(near.groupBy("node", "leader").agg(F.count(F.lit(1)).alias("agree")), 20_000)
        # first each node's most agreeing leader, then one pair of any two classes that these links leave apart, then the rest
        labels = link(_foremost(agreed, "node"))
        labels = link(_foremost(sized(_labelled(agreed, labels).filter("mine <> its"), 20_000), F.least("mine", "its"), F.greatest("mine", "its")))
        labels = link(_apart(agreed, labels))
        if turn + 1 < rounds:
            members = _meeting(_apart(pairs, labels), turn + 1)
    labels = _relabelled(labels, sized(_unlinked(everyone.drop("leader_n"), labels, tokens, least), 200_000))
    named = nodes.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    named = named.select("sequence", F.col("label").alias("class"), "row", "copies")
    told = named.groupBy("class").agg(F.min("row").alias("kept"), F.sum("copies").alias("class_size"))
    named = named.join(told, "class").select("sequence", "kept", "class_size")
    kept = F.col("doc_id").eqNullSafe(F.col("kept.doc_id")) & (F.col("sha") == F.col("kept.sha"))
    return rows.select("doc_id", "sha", "n", "sequence").join(named, "sequence").select("doc_id", "sha", "n", F.col("kept.doc_id").alias("class_id"), "class_size", kept.alias("kept"))


def classes(docs: DataFrame, least: float = SIMILARITY, sketches: int = SKETCHES, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, class_id, class_size, n_words for every row."""
    return _classed(docs, least, sketches, rounds).select("doc_id", "class_id", "class_size", F.col("n").alias("n_words"))


def deduplicate(docs: DataFrame) -> DataFrame:
    """One document of each class, with all its columns."""
    kept = _classed(docs, SIMILARITY, SKETCHES, ROUNDS).filter("kept").select(row_key(F.col("doc_id"), F.hex("sha")))
    return rows_of_keys(docs, row_key(F.col("doc_id").cast("bigint"), F.hex(_sha())), kept)

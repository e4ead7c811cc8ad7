"""Packing documents into fixed-size sequences by vector best-fit.

Every piece is a vector of demands: tokens, one document, and attention cost (the square of its length).
Pieces are taken in descending length; each goes to the open sequence that fits it under every capacity and
scores best, by the weighted norm of what would be left (``norm``) or by the weighted dot product of demand
and residual (``dot``); if none fits, a sequence is opened. Pieces are dealt by hash into groups of bounded
size which are packed independently, so that the waste is at most about one sequence in each group.

Tokenising runs in tasks, by the tokenizer file, with a bounded cache from pre-token to ids.

Defined results: a null text counts as empty and yields the one end token; texts longer than a sequence
(and only those) are cut into full pieces, the first of which may be shorter; the tokenizer file's added tokens
inside a text are one id each, as that library has it; repeated rows are packed one by one; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import os
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from festa.llm import words
from festa.llm.common import cut, text_of

TOKENS = 2048
END_ID = 0
#: Pieces that one task packs.
GROUP_PIECES = 20_000
CACHE_WORDS = 500_000
_BREAK = 0x110000  # stands between texts; no sign has this number
#: Capacities of a sequence. The last two never bind by default: a sequence of T tokens has at most T documents and T*T cost.
CAPACITY = (float(TOKENS), float(TOKENS), float(TOKENS) ** 2)
WEIGHTS = (1.0, 1e-3, 1e-3)

#: Capacities that all bind: pieces of up to 1,024 tokens, 64 documents a sequence, and attention for one whole piece and a quarter.
SHORT_PIECE = 1024
CAPACITIES = (float(TOKENS), 64.0, 1.25 * SHORT_PIECE**2)

_PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def token_starts(codes: np.ndarray, kinds: np.ndarray) -> np.ndarray:
    """Where pre-tokens start, in texts that are each ended by a break (a start too).

    A pre-token is a run of letters, of digits or of other signs, each with one blank before it; a contraction; or
    white space but for the last of it, which is a pre-token by itself if no blank.
    """
    change = np.empty(len(kinds), bool)
    change[0], change[1:] = True, kinds[1:] != kinds[:-1]
    change |= kinds == words.BREAK
    space, blank = kinds == words.SPACE, codes == 32
    after = np.zeros(len(kinds), bool)
    after[1:] = blank[:-1] & space[:-1]
    start = change & ~(after & ~space & (kinds != words.BREAK))
    start[:-1] |= space[:-1] & ~space[1:] & (kinds[1:] != words.BREAK)
    at = np.flatnonzero(change & (codes == 39) & ~after)
    at = at[kinds[np.minimum(at + 1, len(kinds) - 1)] == words.LETTER]
    if len(at):
        one, two = codes[at + 1], codes[np.minimum(at + 2, len(codes) - 1)]
        long = ((one == ord("r")) & (two == ord("e"))) | ((one == ord("v")) & (two == ord("e"))) | ((one == ord("l")) & (two == ord("l")))
        short = np.isin(one, [ord(c) for c in "stmd"])
        start[at[short | long] + 1] = False
        start[at[short] + 2] = True
        start[at[long] + 3] = True
    return np.flatnonzero(start)


def told_apart(codes: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One run of each kind, and the kind of each run; runs go from start to start. Grouped by hash, then compared sign by sign."""
    ends = np.append(starts[1:], len(codes))
    _, first, which = np.unique(words.hashes(codes, starts, ends), return_index=True, return_inverse=True)
    n, model = ends - starts, first[which]
    there = np.arange(len(codes), dtype=np.int64) + np.repeat(starts[model] - starts, n)
    differ = codes[np.minimum(there, len(codes) - 1)] != codes
    odd = np.flatnonzero((n != n[model]) | (np.add.reduceat(differ, starts) > 0))  # runs that only share a hash are kinds of their own
    which[odd] = len(first) + np.arange(len(odd))
    return np.concatenate((first, odd)), which


class Encoder:
    """The ids that the tokenizer file gives, with each distinct pre-token of many texts encoded once.

    Byte-level BPE never merges across pre-tokens, so the ids of a text are those of its pre-tokens. The cache from
    pre-tokens (their code points, not hashes) to ids is bounded. Texts that hold an added token of the file go
    through the tokenizer whole. Where the same vocabulary lies beside the file as ranks (``.tiktoken``), single
    pre-tokens are merged by these, which takes a fifth of the time; else by the tokenizer.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        self.tokenizer = Tokenizer.from_file(path)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.cache: dict[bytes, bytes] = {_BREAK.to_bytes(4, "little"): b""}
        ranks = path.removesuffix(".json") + ".tiktoken"
        self.merge = self._by_ranks(ranks) if os.path.exists(ranks) else lambda piece: self.tokenizer.encode(piece, add_special_tokens=False).ids

    @staticmethod
    def _by_ranks(path: str) -> Callable[[str], list[int]]:
        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        return tiktoken.Encoding("pieces", pat_str=r"(?s).+", mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def ids(self, texts: list[str]) -> list[np.ndarray]:
        whole = {i for i, t in enumerate(texts) if any(a in t for a in self.added)}
        found = self._plain(["" if i in whole else t for i, t in enumerate(texts)] if whole else texts)
        for i in whole:
            found[i] = np.array(self.tokenizer.encode(texts[i], add_special_tokens=False).ids, "<u4")
        return found

    def _plain(self, texts: list[str]) -> list[np.ndarray]:
        codes, kinds, bounds = words.points(texts)
        starts = token_starts(codes, kinds)
        if not len(starts):
            return []
        codes = np.where(kinds == words.BREAK, np.uint32(_BREAK), codes)
        first, which = told_apart(codes, starts)
        if len(self.cache) > CACHE_WORDS:
            self.cache = {_BREAK.to_bytes(4, "little"): b""}
        raw, cache, merge, found = codes.tobytes(), self.cache, self.merge, []
        ends = np.append(starts[1:], len(codes))
        for s, e in zip((4 * starts[first]).tolist(), (4 * ends[first]).tolist(), strict=True):
            key = raw[s:e]
            ids = cache.get(key)
            if ids is None:
                ids = cache[key] = np.array(merge(key.decode("utf-32-le", "replace")), "<u4").tobytes()
            found.append(ids)
        flat = np.frombuffer(b"".join(found), "<u4")
        length = np.fromiter(map(len, found), np.int64, len(found)) // 4
        begin, n = (np.cumsum(length) - length)[which], length[which]
        place = np.cumsum(n) - n
        ids = flat[np.repeat(begin - place, n) + np.arange(n.sum())]
        at = np.append(place, len(ids))[np.searchsorted(starts, bounds)]
        return [ids[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]


def cut_points(n: int, size: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n ids: all full but the first."""
    first = n % size or min(n, size)
    return [(0, first), *((s, size) for s in range(first, n, size))]


def tokenised(docs: DataFrame, path: str | None = None, size: int = TOKENS) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32: a row for each piece of each document."""
    path = path or default_tokenizer()

    def pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder, end = Encoder(path), np.asarray([END_ID], "<u4").tobytes()
        for batch in batches:
            texts = batch["text"].tolist()
            for a, b in words.batches(texts):
                out = []
                for doc_id, found in zip(batch["doc_id"].iloc[a:b], encoder.ids(texts[a:b]), strict=True):
                    ids = found.tobytes() + end
                    doc_id = None if pd.isna(doc_id) else int(doc_id)
                    for piece, (start, length) in enumerate(cut_points(len(ids) // 4, size)):
                        out.append((doc_id, piece, start, length, zlib.crc32(ids[4 * start : 4 * (start + length)])))
                yield pd.DataFrame(out, columns=["doc_id", "piece", "start", "length", "ids_crc32"]).astype({"doc_id": "Int64"})

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_of().alias("text")).mapInPandas(pieces, _PIECES)


def best_fit(lengths: np.ndarray, capacity=CAPACITY, weights=WEIGHTS, score: str = "norm") -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each piece; lengths in any order, none above the token capacity."""
    cap, weight = np.asarray(capacity, float), np.asarray(weights, float)
    order = np.argsort(-lengths, kind="stable")
    smallest = lengths.min(initial=0)
    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    room = np.empty((len(lengths), 3))  # residuals of the open bins
    names = np.empty(len(lengths), np.int64)
    opened, live = 0, 0
    for i in order:
        n = float(lengths[i])
        demand = np.array([n, 1.0, n * n])
        if demand[0] > cap[0] or demand[1] > cap[1] or demand[2] > cap[2]:
            raise ValueError(f"a piece of {n:.0f} tokens exceeds a capacity")
        at = -1
        if live:
            now = room[:live]
            fits = np.flatnonzero((now[:, 0] >= n) & (now[:, 1] >= 1) & (now[:, 2] >= n * n))
            if len(fits):
                left = (now[fits] - (demand if score == "norm" else 0)) / cap
                value = -((left * left) @ weight) if score == "norm" else (left * (demand / cap)) @ weight
                at = fits[np.argmax(value)]
        if at < 0:
            at, live = live, live + 1
            room[at], names[at] = cap, opened
            opened += 1
        bins[i], offsets[i] = names[at], cap[0] - room[at, 0]
        room[at] -= demand
        if room[at, 0] < smallest or room[at, 1] < 1:  # closed: the last open bin takes its place
            live -= 1
            room[at], names[at] = room[live], names[live]
    return bins, offsets


def pack(pieces: DataFrame, capacity=CAPACITY, weights=WEIGHTS, score: str = "norm") -> DataFrame:
    """``pieces`` (as ``tokenised`` gives them) with sequence_id and offset."""
    rows = cut(pieces)
    groups = max(1, round(rows.count() / GROUP_PIECES))

    def packed(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["length", "doc_id", "piece"], ascending=[False, True, True], kind="stable", ignore_index=True)
        bins, offsets = best_fit(group["length"].to_numpy(), capacity, weights, score)
        return group.assign(sequence_id=group["__group"].astype("int64") * 2**40 + bins, offset=offsets).drop(columns="__group")

    # the row's number, fixed by the checkpoint, spreads repeated rows over all groups
    dealt = rows.withColumn("__group", F.pmod(F.xxhash64("doc_id", "piece", F.monotonically_increasing_id()), F.lit(groups)))
    return dealt.groupBy("__group").applyInPandas(packed, f"{_PIECES}, sequence_id bigint, offset bigint")


def pack_documents(docs: DataFrame, path: str | None = None, size: int = TOKENS) -> DataFrame:
    capacity = (float(size), float(size), float(size) ** 2)
    return pack(tokenised(docs, path, size), capacity)


def pack_under_capacities(docs: DataFrame, path: str | None = None) -> DataFrame:
    """The pieces of all documents in sequences of at most 2,048 tokens, 64 pieces and a bounded cost of attention (the sum of squared lengths)."""
    return pack(tokenised(docs, path, SHORT_PIECE), CAPACITIES, (1.0, 1.0, 1.0))

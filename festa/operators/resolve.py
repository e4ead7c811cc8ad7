"""Entity resolution: which reports are of one event, and what the event is after them.

Pairs: events of one province whose names agree enough and that lie within three days (or are undated). Two names can
agree only if they share one of their rarest words, so names meet in blocks (province, word) under the first few words
that the threshold leaves to each, by classes of the partner's number of words; a common word makes no block.
``duplicate_pairs`` compares each name once and then the days of its events.

Fold: reports in order, each merging into the first event it duplicates or becoming one; a merge changes what later
reports match. Names that chains of agreement link are a root, and roots fold on their own: one task goes through a
root's reports and keeps of its events only what decides a match, then the events take in their reports, each by itself.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from datetime import date
from functools import cache
from itertools import groupby, pairwise
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from festa.functions import lexicon
from festa.functions.geo import KEYS, OWN
from festa.functions.names import event_name_of
from festa.functions.text import canonical_name, is_preparing, normalize, padded, phrases
from festa.operators.components import connected
from festa import shared

BAND_DAYS = 3
MOST_SOURCES = 6
#: Shares of tokens that make two names alike: of both names' tokens, if undated, and of the shorter name's, if this many are shared.
SHARE, UNDATED_SHARE, HELD, HELD_TOKENS = 0.34, 0.4, 0.6, 3
#: Words of names so common that they come last in the order of words; numbers of words that count as one class of partners.
COMMON_WORDS = 256
CLASSES = ((1, 1), (2, 2), (3, 3), (4, 5), (6, 8), (9, 2**30))
#: Days of a stretch under which a fold looks for events, and the stretch of those without a date.
STRETCH, UNDATED = 16, -1
#: Events of one name in one list; days that tell a list from the next; events that a task compares and pairs that it makes at once.
LISTED, LIST_DAYS, HELD_EVENTS, FOUND = 1_000, 2**33, 1_000_000, 100_000
#: Rows that a task of the fold looks at together; rows of one partition, if roots allow it, and the most partitions of roots.
BLOCK, PART_ROWS, MOST_PARTS = 5_000, 25_000, 1_000

EVENT = (
    "id bigint, name string, province string, venue string, start_date date, end_date date, start_time string, crowd int, "
    "fireworks boolean, big_concert boolean, summary string, sources array<string>, alerted boolean"
)


def stored(df: DataFrame) -> DataFrame:
    """``shared.stored``, never sent whole to all tasks: files of few bytes may hold many rows, which the driver would have to unpack."""
    return shared.stored(df).hint("merge")


def _over_cores(rows: DataFrame) -> DataFrame:
    """``rows``, stored, over all cores in parts of at most PART_ROWS: few bytes of names, which Spark leaves in one part, are much work for the rules."""
    rows = stored(rows)
    return rows.repartition(max(rows.sparkSession.sparkContext.defaultParallelism, -(-rows.count() // PART_ROWS)))


def tokens(name: Column, province: Column) -> Column:
    """The telling words of a name: without the province's own names, common words and numbers."""
    own = phrases(OWN[KEYS[0]])
    for key in KEYS[1:]:
        own = F.when(province == key, phrases(OWN[key])).otherwise(own)
    own = F.when(province.isin(*KEYS), own).otherwise(F.array().cast("array<string>"))
    bare = F.aggregate(own, padded(normalize(name)), lambda text, alias: F.replace(text, padded(alias), F.lit(" ")))
    return F.array_distinct(F.filter(F.split(bare, " "), lambda t: (t != "") & ~t.isin(*lexicon.COMMON) & ~t.rlike(r"^\d+$")))


def last_date(start: Column, end: Column) -> Column:
    return F.coalesce(end, start)


def gap_days(a_start: Column, a_last: Column, b_start: Column, b_last: Column) -> Column:
    """Days between two spans; 0 or less if they touch or overlap."""
    return F.datediff(F.greatest(a_start, b_start), F.least(a_last, b_last))


def alike(shared: Column, a_size: Column, b_size: Column, dated: Column) -> Column:
    """Enough of the tokens agree; more are asked for if one event is undated."""
    one = F.lit(1)
    jaccard = shared / F.greatest(a_size + b_size - shared, one)
    return (shared > 0) & ((jaccard >= F.when(dated, SHARE).otherwise(UNDATED_SHARE)) | ((shared / F.greatest(F.least(a_size, b_size), one) >= HELD) & (shared >= HELD_TOKENS)))


def is_duplicate(a_tokens: Column, b_tokens: Column, dated: Column) -> Column:
    return alike(F.size(F.array_intersect(a_tokens, b_tokens)), F.size(a_tokens), F.size(b_tokens), dated)


def maybe_same(a_tokens: Column, b_tokens: Column) -> Column:
    return F.size(F.array_intersect(a_tokens, b_tokens)) >= 2


def by_rarity(rows: DataFrame) -> DataFrame:
    """``rows`` with ``tokens`` in one order for all: the most common words last, a bounded list of them."""
    counts = rows.select(F.explode("tokens").alias("t")).groupBy("t").count()
    common = [r.t for r in counts.orderBy(F.desc("count"), "t").limit(COMMON_WORDS).collect()][::-1]
    ranked = F.array(*map(F.lit, common)) if common else F.array().cast("array<string>")
    return rows.withColumn("tokens", F.concat(F.array_sort(F.array_except("tokens", ranked)), F.array_intersect(ranked, F.col("tokens"))))


def _least_shared(size: Column, other: int) -> Column:
    """How many tokens names of ``size`` and of ``other`` or more tokens share at least, if they are alike."""
    small = F.least(size, F.lit(other))
    return F.greatest(F.lit(1), F.least(F.ceil(SHARE * (size + other) / (1 + SHARE) - 1e-9), F.greatest(F.lit(HELD_TOKENS), F.ceil(HELD * small - 1e-9)))).cast("int")


def _offered(partner: int) -> Callable[[Column], Column]:
    return lambda t: F.struct(t.alias("token"), F.lit(partner).alias("partner"))


def _keys(rows: DataFrame) -> DataFrame:
    """A row for each token under which an event may meet a partner: token, own class, class of the partner."""
    size = F.size("tokens")
    own, offers = F.lit(0), []
    for i, (low, high) in enumerate(CLASSES):
        own = F.when(size >= low, i).otherwise(own)
        near = F.least(F.greatest(size, F.lit(low)), F.lit(high))
        possible = (F.least(size, near) / F.greatest(size, near) >= SHARE) | (F.least(size, F.lit(high)) >= HELD_TOKENS)
        prefix = F.slice("tokens", F.lit(1), F.greatest(F.lit(0), size - _least_shared(size, low) + 1))
        offers.append(F.transform(F.when(possible, prefix).otherwise(F.array().cast("array<string>")), _offered(i)))
    return rows.filter(size > 0).withColumns({"own": own, "k": F.explode(F.concat(*offers))}).select(*rows.columns, "own", "k.token", "k.partner")


def _met(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Pairs of rows of ``_keys`` that meet, once each, with ``shared``: columns of both as structs a and b."""
    left = a.select(F.struct(*[c for c in a.columns if c not in ("own", "token", "partner")]).alias("a"), "own", "partner", "token", *keys)
    right = b.select(F.struct(*[c for c in b.columns if c not in ("own", "token", "partner")]).alias("b"), F.col("partner").alias("own"), F.col("own").alias("partner"), "token", *keys)
    met = left.join(right, [*keys, "token", "own", "partner"]).filter(F.col("a.id") != F.col("b.id"))
    both = met.withColumn("both", F.array_intersect("a.tokens", "b.tokens"))
    # of all words that two names share, the rarest alone stands for the pair
    return both.filter(F.get("both", F.lit(0)) == F.col("token")).withColumn("shared", F.size("both"))


def _alike_names(names: DataFrame) -> DataFrame:
    """``_met`` for names (id, province, tokens) of one province that agree enough if their events have days, a.id < b.id."""
    names = by_rarity(names)
    met = _met(_keys(names), _keys(names), ["province"]).filter(F.col("a.id") < F.col("b.id"))
    return met.filter(alike(F.col("shared"), F.size("a.tokens"), F.size("b.tokens"), F.lit(True)))


def _names(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Names as they are written (province, name, tokens, n) and as they are compared (province, tokens, n, id); both stored, those without tokens left out."""
    called = _over_cores(rows.filter(F.col("province").isNotNull()).groupBy("province", "name").agg(F.count(F.lit(1)).alias("n")))
    called = called.withColumn("tokens", F.array_sort(tokens(F.col("name"), F.col("province"))))
    called = stored(called.filter(F.size("tokens") > 0))
    return called, stored(called.groupBy("province", "tokens").agg(F.sum("n").alias("n")).withColumn("id", F.monotonically_increasing_id()))


def _lists(rows: DataFrame, names: DataFrame) -> DataFrame:
    """name (its number, ``called``), events (id, start, last: days, null if undated), low, high, undated: a name's events, in lists of about LISTED by months if they are many."""
    days = lambda c: F.datediff(c, F.lit("1970-01-01").cast("date"))
    told = rows.join(names.select("province", "name", "called", "n"), ["province", "name"]).drop("name").withColumnRenamed("called", "name")
    month = F.coalesce(F.year("start_date") * 12 + F.month("start_date"), F.lit(UNDATED))
    told = told.select("name", "n", F.when(F.col("n") > LISTED, month).otherwise(UNDATED).alias("period"), "id", days("start_date").alias("start"), days("last").alias("last"))
    many = told.filter(F.col("n") > LISTED).groupBy("name", "period").agg(F.ceil(F.count(F.lit(1)) / LISTED).alias("lists"))
    part = F.pmod(F.xxhash64("id"), F.coalesce("lists", F.lit(1)))
    return told.join(many, ["name", "period"], "left").groupBy("name", "period", part.alias("part")).agg(
        F.collect_list(F.struct("id", "start", F.when(F.col("start").isNotNull(), F.col("last")).alias("last"))).alias("events"),
        F.min("start").alias("low"),
        F.max(F.when(F.col("start").isNotNull(), F.col("last"))).alias("high"),
        F.max(F.col("start").isNull()).alias("undated"),
    )


def _parts(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """A batch of pairs of lists in parts of about HELD_EVENTS events, so that memory follows neither the batch nor the lists."""
    sizes = sum(batch.column(c).value_lengths().to_numpy(zero_copy_only=False).astype(np.int64) for c in ("a", "b"))
    edges = np.unique((np.cumsum(sizes) - sizes) // HELD_EVENTS, return_index=True)[1]
    for i, j in pairwise([*edges, len(sizes)]):
        yield batch.slice(i, j - i)


def _near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """a_id, b_id, shared of the events of two lists (a, b) that lie within the band or, if their names agree so far (loose), of which one is undated."""

    def flat(column: pa.ListArray) -> tuple[np.ndarray, ...]:
        row = np.repeat(np.arange(len(column)), column.value_lengths().to_numpy(zero_copy_only=False))
        ids, start, last = column.flatten().flatten()
        dated = np.asarray(start.is_valid())
        # one number for list and day, those without a day first in their list
        day = lambda c: row * LIST_DAYS + np.where(dated, c.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64) + LIST_DAYS // 2, 0)
        return row, ids.to_numpy(zero_copy_only=False), dated, day(start), day(last)

    for batch in (part for b in batches for part in _parts(b)):
        shared, same, loose = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("shared", "same", "loose"))
        a_row, a_id, a_dated, a_start, a_last = flat(batch.column("a"))
        b_row, b_id, b_dated, b_start, b_last = flat(batch.column("b"))
        b_last = np.where(b_start - b_last > BAND_DAYS, b_row * LIST_DAYS, b_last)  # a span that ends so far before it starts is near to none
        order = np.argsort(b_start, kind="stable")
        b_row, b_id, b_dated, b_start, b_last = (x[order] for x in (b_row, b_id, b_dated, b_start, b_last))
        first, end = np.searchsorted(b_row, a_row), np.searchsorted(b_row, a_row, "right")
        undated = first + np.bincount(b_row[~b_dated], minlength=len(batch))[a_row]
        low = np.maximum(np.searchsorted(np.maximum.accumulate(b_last), a_start - BAND_DAYS), undated)
        high = np.where(a_dated & (a_start - a_last <= BAND_DAYS), np.searchsorted(b_start, a_last + BAND_DAYS, "right"), low)
        open_ = np.where(loose[a_row], np.where(a_dated, undated, end), first)  # an undated event meets all, a dated one those that are undated
        for low, high, by_days in ((low, high, True), (first, open_, False)):
            size = np.maximum(high - low, 0)
            before = np.cumsum(size) - size
            # each part begins with the event that makes the next FOUND-th pair; none begins past the last
            edges = np.unique(np.searchsorted(before, np.arange(0, size.sum(), FOUND), "right") - 1)
            for i, j in pairwise([*edges, len(size)]):
                n = size[i:j]
                b = np.repeat(low[i:j] - before[i:j] + before[i], n)
                b += np.arange(len(b))
                x, y, row = np.repeat(a_id[i:j], n), b_id[b], np.repeat(a_row[i:j], n)
                keep = np.where(same[row], x < y, x != y)
                if by_days:
                    keep &= b_last[b] >= np.repeat(a_start[i:j] - BAND_DAYS, n)
                x, y = x[keep], y[keep]
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y)), pa.array(shared[row[keep]])], ["a_id", "b_id", "shared"])


def duplicate_pairs(events: DataFrame) -> DataFrame:
    """a_id < b_id, shared: names are compared once each, then the events of names that agree by their days.

    The events of two names meet in bounded lists, so that the work beyond the names grows with the pairs that there are.
    """
    rows = events.select("id", "province", "name", "start_date", last_date(F.col("start_date"), F.col("end_date")).alias("last"))
    rows = stored(rows.filter(F.col("province").isNotNull() & F.col("id").isNotNull()))
    called, names = _names(rows)
    lists = stored(_lists(rows, called.drop("n").join(names.withColumnRenamed("id", "called"), ["province", "tokens"])))
    loose = alike(F.col("shared"), F.size("a.tokens"), F.size("b.tokens"), F.lit(False))
    pairs = _alike_names(names).select(F.col("a.id").alias("a_name"), F.col("b.id").alias("b_name"), F.col("shared").cast("bigint").alias("shared"), F.lit(False).alias("same"), loose.alias("loose"))
    own = names.select(F.col("id").alias("a_name"), F.col("id").alias("b_name"), F.size("tokens").cast("bigint").alias("shared"), F.lit(True).alias("same"), F.lit(True).alias("loose"))
    side = lambda s: lists.select(F.col("name").alias(f"{s}_name"), F.col("events").alias(s), *[F.col(c).alias(f"{s}_{c}") for c in ("low", "high", "undated")])
    near = (F.col("a_low") - F.col("b_high") <= BAND_DAYS) & (F.col("b_low") - F.col("a_high") <= BAND_DAYS)
    meet = F.coalesce(near, F.lit(False)) | (F.col("loose") & (F.col("a_undated") | F.col("b_undated")))
    both = stored(pairs.unionByName(own)).join(side("a"), "a_name").join(side("b"), "b_name").filter(meet)
    return both.select("shared", "same", "loose", "a", "b").mapInArrow(_near, "a_id bigint, b_id bigint, shared bigint")


def first_matches(new: DataFrame, known: DataFrame) -> DataFrame:
    """For each new event the known one of least id that it duplicates."""
    tagged = known.withColumn("id", F.col("id") * 2).unionByName(new.withColumn("id", F.col("id") * 2 + 1))
    pairs = duplicate_pairs(tagged).filter((F.col("a_id") + F.col("b_id")) % 2 == 1)
    is_new = F.col("a_id") % 2 == 1
    sides = pairs.select(F.when(is_new, F.col("a_id")).otherwise(F.col("b_id")).alias("n"), F.when(is_new, F.col("b_id")).otherwise(F.col("a_id")).alias("k"))
    return sides.groupBy(((F.col("n") - 1) / 2).cast("bigint").alias("new_id")).agg(F.min((F.col("k") / 2).cast("bigint")).alias("known_id"))


def merged(old: str, new: str) -> Column:
    """The event ``old`` after the report ``new`` (names of struct columns), with ``changed``; an event that was alerted as either is not alerted again."""
    o, n = (lambda f: F.col(f"{old}.{f}")), (lambda f: F.col(f"{new}.{f}"))
    links = F.slice(F.concat(o("sources"), F.array_except(n("sources"), o("sources"))), F.lit(1), F.greatest(F.lit(MOST_SOURCES), F.size(o("sources"))))
    crowd = F.when(F.coalesce(n("crowd"), F.lit(0)) > F.coalesce(o("crowd"), F.lit(0)), n("crowd")).otherwise(o("crowd"))
    filled = lambda f: F.when(F.coalesce(o(f), F.lit("")) == "", F.coalesce(F.nullif(n(f), F.lit("")), o(f))).otherwise(o(f))
    o_last, n_last = last_date(o("start_date"), o("end_date")), last_date(n("start_date"), n("end_date"))
    gap = gap_days(o("start_date"), o_last, n("start_date"), n_last)
    span = lambda s, e: F.datediff(e, s)
    fresh = o("start_date").isNull() & n("start_date").isNotNull()
    longer = (n("end_date") > o("end_date")) & (n("start_date") == o("start_date"))
    other = n("start_date").isNotNull() & o("start_date").isNotNull() & ((n("start_date") != o("start_date")) | (n_last != o_last))
    low, high = F.least(o("start_date"), n("start_date")), F.greatest(o_last, n_last)
    moved = (low != o("start_date")) | (high != o_last)
    is_ = lambda c: F.coalesce(c, F.lit(False))
    case = F.when(fresh, "take").when(is_(longer), "extend").when(is_(other & (gap <= 1) & moved), "join").when(is_(other & (gap > 1) & (span(n("start_date"), n_last) > span(o("start_date"), o_last))), "take").otherwise("keep")
    start = F.when(case == "take", n("start_date")).when(case == "join", low).otherwise(o("start_date"))
    end = F.when(case.isin("take", "extend"), n("end_date")).when(case == "join", high).otherwise(o("end_date"))
    fuller = (F.char_length(n("name")) > F.char_length(o("name")) + 15) & (F.char_length(n("name")) <= 120)
    name = F.when(fuller, n("name")).otherwise(o("name"))
    out = {
        "id": o("id"), "name": name, "province": o("province"), "venue": filled("venue"), "start_date": start, "end_date": end, "start_time": filled("start_time"), "crowd": crowd,
        "fireworks": o("fireworks") | n("fireworks"), "big_concert": o("big_concert") | n("big_concert"), "summary": filled("summary"), "sources": links, "alerted": o("alerted") | n("alerted"),
    }
    same = [out[f].eqNullSafe(o(f)) for f in ("name", "venue", "start_date", "end_date", "start_time", "crowd", "fireworks", "big_concert", "summary", "sources")]
    changed = same[0]
    for s in same[1:]:
        changed = changed & s
    return F.struct(*[c.alias(k) for k, c in out.items()], (~changed).alias("changed"))


FIELDS = [f.split(" ")[0] for f in EVENT.split(", ")]


def _whole(rows: DataFrame) -> DataFrame:
    """EVENT columns without nulls where a merge reads text, flags or links."""
    texts = {c: F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("name", "venue", "start_time", "summary")}
    flags = {c: F.coalesce(F.col(c), F.lit(False)).alias(c) for c in ("fireworks", "big_concert", "alerted")}
    links = {"sources": F.coalesce(F.array_distinct("sources"), F.array().cast("array<string>"))}
    types = dict(f.split(" ") for f in EVENT.split(", "))
    return rows.select(*[({**texts, **flags, **links}.get(c, F.col(c))).cast(types[c]).alias(c) for c in FIELDS])


def cleaned(events: DataFrame) -> DataFrame:
    """Stored events before they are compared: names as rules would give them now, no date from a title of preparations on one day.

    Events of one name and summary are read by the rules once.
    """
    told = _over_cores(events.select("name", "summary").distinct())
    named = F.coalesce(F.nullif(event_name_of(F.col("name"), F.col("summary")), F.lit("")), F.col("name"))
    told = stored(told.select(F.col("name").alias("__name"), F.col("summary").alias("__summary"), canonical_name(named).alias("__called"), is_preparing(F.col("name")).alias("__prepares")))
    rows = events.join(told, F.col("name").eqNullSafe(F.col("__name")) & F.col("summary").eqNullSafe(F.col("__summary")))
    one_day = F.coalesce(F.col("end_date"), F.col("start_date")) == F.col("start_date")
    drop = F.coalesce(F.col("__prepares") & one_day, F.lit(False))
    dates = {c: F.when(~drop, F.col(c)) for c in ("start_date", "end_date")}
    return rows.withColumns({**dates, "name": F.col("__called")}).select(*events.columns)


def _agree(shared: int, a: int, b: int, share: float) -> bool:
    return shared / (a + b - shared) >= share or (shared >= HELD_TOKENS and shared / min(a, b) >= HELD)


@cache
def _probes(size: int, other: int) -> int:
    """Of ``size`` tokens in any order, how many hold at least one of those shared with a name of ``other`` tokens that is alike."""
    least = next((k for k in range(1, min(size, other) + 1) if _agree(k, size, other, SHARE)), size + 1)
    return size - least + 1


def _span(start: int | None, end: int | None, new_start: int | None, new_end: int | None) -> tuple:
    """The days of an event after a report, as in ``merged``."""
    if new_start is None:
        return start, end
    if start is None:
        return new_start, new_end
    if start == new_start and end is not None and new_end is not None and new_end > end:
        return start, new_end
    last, new_last = start if end is None else end, new_start if new_end is None else new_end
    low, high = min(start, new_start), max(last, new_last)
    if max(start, new_start) - min(last, new_last) <= 1:
        return (start, end) if (low, high) == (start, last) else (low, high)
    return (new_start, new_end) if new_last - new_start > last - start else (start, end)


def _fuller(old: int, new: int) -> bool:
    """Whether a name of ``new`` signs replaces one of ``old``."""
    return old + 15 < new <= 120


class _Event:
    """What of an event decides which reports it takes: the number of its name, the name's length, its days as numbers."""

    __slots__ = ("end", "id", "last", "length", "name", "start")

    def __init__(self, report: dict, name: int):
        self.id, self.name, self.length = report["id"], name, len(report["name"])
        self.days(*_days(report))

    def days(self, start: int | None, end: int | None) -> None:
        self.start, self.end, self.last = start, end, start if end is None else end


def _days(r: dict) -> tuple[int | None, int | None]:
    return r["start_date"] and r["start_date"].toordinal(), r["end_date"] and r["end_date"].toordinal()


def _same(e: _Event, start: int, last: int) -> bool:
    """Whether an event whose name agrees lies within the band of a report's days."""
    return max(e.start, start) - min(e.last, last) <= BAND_DAYS


class _Known:
    """The events of one root by name and stretch of days; names are numbers, each with those that are alike."""

    def __init__(self):
        self.events: list[_Event] = []
        self.numbers: dict[tuple, int] = {}
        self.tokens: list[frozenset] = []
        self.holding: dict[tuple, list[int]] = defaultdict(list)  # names by token and number of tokens
        self.sizes: set[int] = set()
        #: By name: those alike, each with whether they are also if one event is undated; the same of names that events bear.
        self.alike: list[list[tuple[int, bool]]] = []
        self.borne: list[list[tuple[int, bool]]] = []
        #: By name: the places of its events by stretch, ascending; UNDATED those without days, None all.
        self.places: list[dict[int | None, list[int]]] = []
        self.under: list[tuple[int, tuple]] = []  # by event: the name and the stretches under which it is found

    def name(self, tokens: list[str]) -> int:
        """The number of a name."""
        number = self.numbers.get(key := tuple(tokens))
        if number is not None:
            return number
        number = self.numbers[key] = len(self.tokens)
        own, size = frozenset(tokens), len(tokens)
        self.tokens.append(own)
        self.alike.append([(number, True)])
        self.borne.append([])
        self.places.append(defaultdict(list))
        others = {o for n in self.sizes for t in tokens[: _probes(size, n)] for o in self.holding.get((t, n), ())}
        for o in others:
            shared, n = len(own & self.tokens[o]), len(self.tokens[o])
            if shared and _agree(shared, size, n, SHARE):
                loose = _agree(shared, size, n, UNDATED_SHARE)
                self.alike[number].append((o, loose))
                self.alike[o].append((number, loose))
                if self.places[o]:
                    self.borne[number].append((o, loose))
        self.sizes.add(size)
        for t in tokens:
            self.holding[t, size].append(number)
        return number

    def put(self, at: int) -> None:
        """Take in an event that is new or has changed."""
        e = self.events[at]
        if not self.places[e.name]:
            for o, loose in self.alike[e.name]:
                self.borne[o].append((e.name, loose))
        if at == len(self.under):
            self.under.append((None, ()))
        name, stretches = self.under[at]
        now = (UNDATED,) if e.start is None else _stretches(e.start, e.last, 0)
        if name != e.name:
            if name is not None:
                for k in (*stretches, None):
                    self._drop(name, k, at)
            insort(self.places[e.name][None], at)
            stretches = ()
        for k in set(stretches).difference(now):
            self._drop(e.name, k, at)
        for k in set(now).difference(stretches):
            insort(self.places[e.name][k], at)
        self.under[at] = e.name, now

    def _drop(self, name: int, stretch: int | None, at: int) -> None:
        found = self.places[name][stretch]
        del found[bisect_left(found, at)]

    def first(self, name: int, start: int | None, last: int | None) -> int | None:
        """The place of the first event that a report of this name and these days duplicates."""
        best, events = len(self.events), self.events
        if start is None:
            return min((found[0] for o, loose in self.borne[name] if loose and (found := self.places[o].get(None))), default=None)
        stretches = _stretches(start, last, BAND_DAYS)
        for o, loose in self.borne[name]:
            places = self.places[o]
            for k in stretches:
                for at in places.get(k, ()):
                    if at >= best:
                        break
                    if _same(events[at], start, last):
                        best = at
                        break
            if loose and (found := places.get(UNDATED)):
                best = min(best, found[0])
        return best if best < len(events) else None


def _stretches(start: int, last: int, more: int) -> range:
    """The numbers of the stretches of days from ``start`` to ``last``, whichever comes first, with ``more`` days at both ends."""
    return range((min(start, last) - more) // STRETCH, (max(start, last) + more) // STRETCH + 1)


def _fold_root(reports: list[dict], events: list[_Event], known: _Known | None = None) -> list[dict]:
    """Fold one root's reports (id, known, name, tokens, start_date, end_date), in order, into its events so far, a list that grows; report_id, event_id."""
    if known is None:
        known = _Known()
        known.events = events
    changes = []
    for r in reports:
        name, (start, end) = known.name(r["tokens"]), _days(r)
        at = None if r["known"] else known.first(name, start, start if end is None else end)
        if at is None:
            at = len(events)
            events.append(_Event(r, name))
            known.put(at)
        else:
            e = events[at]
            days = _span(e.start, e.end, start, end)
            fuller = _fuller(e.length, len(r["name"]))
            if fuller:
                e.name, e.length = name, len(r["name"])
            if fuller or days != (e.start, e.end):
                e.days(*days)
                known.put(at)
        changes.append({"report_id": r["id"], "event_id": events[at].id})
    return changes


def _placed(block: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Batches of rows in the order of roots, known events and ids, with ``event_id``; besides the events of one root, ``block`` rows at a time are looked at."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        root, known = None, _Known()
        for batch in batches:
            told, ids = batch.select(["root", "id", "known", "name", "tokens", "start_date", "end_date"]), []
            for i in range(0, len(batch), block):
                for of, rows in groupby(told.slice(i, block).to_pylist(), itemgetter("root")):
                    if of != root:
                        root, known = of, _Known()
                    ids += [c["event_id"] for c in _fold_root(list(rows), known.events, known)]
            columns = [*[batch.column(c) for c in (*FIELDS, "known")], pa.array(ids, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, [*FIELDS, "known", "event_id"])

    return run


_TEXTS = ("venue", "start_time", "summary")


def _merge(old: dict, new: dict) -> bool:
    """``merged`` for rows at hand: change ``old``, tell whether it changed."""
    more = [x for x in new["sources"] if x not in old["sources"]][: max(0, MOST_SOURCES - len(old["sources"]))]
    after = {"sources": old["sources"] + more, "crowd": new["crowd"] if (new["crowd"] or 0) > (old["crowd"] or 0) else old["crowd"]}
    after |= {c: old[c] or new[c] for c in (*_TEXTS, "fireworks", "big_concert")}
    before = _days(old)
    days = _span(*before, *_days(new))
    if days != before:
        after["start_date"], after["end_date"] = (d and date.fromordinal(d) for d in days)
    if _fuller(len(old["name"]), len(new["name"])):
        after["name"] = new["name"]
    changed = any(old[c] != v for c, v in after.items())
    old |= after | {"alerted": old["alerted"] or new["alerted"]}
    return changed


_DONE = f"report_id bigint, status string, event_id bigint, {EVENT}"


def _merged(block: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Batches of rows in the order of ``event_id``, known events and ids: a row of _DONE for each report's change, then one for each event."""

    schema = to_arrow_schema(StructType.fromDDL(_DONE))

    def rows(changes: list[tuple], events: list[dict]) -> Iterator[pa.RecordBatch]:
        if changes:
            told = [pa.array(c, schema.field(i).type) for i, c in enumerate(zip(*changes, strict=True))]
            yield pa.RecordBatch.from_arrays([*told, *[pa.nulls(len(changes), f.type) for f in list(schema)[3:]]], schema=schema)
        if events:
            yield pa.RecordBatch.from_pylist(events, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, e = None, None
        for batch in batches:
            for i in range(0, len(batch), block):
                changes, events = [], []
                for r in batch.slice(i, block).to_pylist():
                    if e is None or r["event_id"] != at:
                        events += [e] if e else []
                        at, e, status = r["event_id"], r, "known" if r["known"] else "new"
                    else:
                        status = "merged" if _merge(e, r) else "dup"
                    changes.append((r["id"], status, at))
                yield from rows(changes, events)
        yield from rows([], [e] if e else [])

    return run


@dataclass(frozen=True)
class Resolution:
    """events: EVENT columns, one row an event; changes: report_id, status (known, new, merged, dup), event_id."""

    events: DataFrame
    changes: DataFrame


def rooted(rows: DataFrame) -> DataFrame:
    """``rows`` with tokens, root, members: chains of names that are alike, whatever their days, and the rows of each; null if no other row may match.

    An event only ever bears names of its reports, so that no report matches an event of another root.
    """
    called, names = _names(rows)
    pairs = _alike_names(names).select(F.col("a.id").alias("a"), F.col("b.id").alias("b"))
    roots = names.join(connected(pairs), F.col("id") == F.col("node"), "left").withColumn("root", F.coalesce("root", "id"))
    roots = stored(roots.select("province", "tokens", "n", "root"))
    sizes = roots.groupBy("root").agg(F.sum("n").alias("members")).filter("members > 1")
    named = stored(called.drop("n").join(roots.join(sizes, "root").drop("n"), ["province", "tokens"]))
    return rows.join(named, ["province", "name"], "left")


def _dealt(rows: DataFrame) -> DataFrame:
    """Rows in partitions of whole roots, in the order of roots, known events and ids; the largest roots are dealt one by one."""
    sizes = rows.groupBy("root").agg(F.first("members").alias("members"))
    sizes = stored(sizes)
    count = sizes.agg(F.sum("members")).first()[0] or 0
    parts = max(1, min(-(-count // PART_ROWS), MOST_PARTS))
    large = sizes.filter(F.col("members") > PART_ROWS // 4)  # so few that one task ranks them
    rank = large.select("root", F.row_number().over(Window.orderBy(F.desc("members"), "root")).alias("rank"))
    part = F.pmod(F.coalesce(F.col("rank").cast("bigint"), F.xxhash64("root")), F.lit(parts)).cast("int")
    told = rows.join(sizes.join(rank, "root", "left").select("root", part.alias("part")), "root")
    return told.repartitionById(parts, "part").sortWithinPartitions("root", F.desc("known"), "id")


def fold(reports: DataFrame, known: DataFrame | None = None, block: int | None = None) -> Resolution:
    """Fold reports (EVENT columns; ids give the order and differ from those of known events) into the known events.

    A report merges into the event of least id that it duplicates as it then stands, or becomes an event under its own
    id. Known events are not compared with each other. The reports of a root are told their events one after the other by
    names and days alone; then each event takes in its reports. Both tables of the result are stored.
    """
    rows = _whole(reports).withColumn("known", F.lit(False))
    if known is not None:
        rows = _whole(known).withColumn("known", F.lit(True)).unionByName(rows)
    rows = stored(rooted(stored(rows)))
    several = rows.filter("root is not null")
    placed = _dealt(several).mapInArrow(_placed(block or BLOCK), f"{EVENT}, known boolean, event_id bigint")
    parts = max(1, rows.count() // PART_ROWS)
    done = stored(placed.repartition(parts, "event_id").sortWithinPartitions("event_id", F.desc("known"), "id").mapInArrow(_merged(block or BLOCK), _DONE))
    alone = rows.filter("root is null")
    events = done.filter("status is null").select(*FIELDS).unionByName(alone.select(*FIELDS))
    new = alone.select(F.col("id").alias("report_id"), F.when(F.col("known"), "known").otherwise("new").alias("status"), F.col("id").alias("event_id"))
    return Resolution(events, done.filter("status is not null").select("report_id", "status", "event_id").unionByName(new))


def resolve(reports: DataFrame) -> DataFrame:
    """The events that the reports make, each under its first report's id."""
    return fold(reports).events


def deduplicated(events: DataFrame) -> DataFrame:
    """Stored events after ``cleaned``, those of one event merged into the one of least id, by ascending ids."""
    return fold(cleaned(events)).events

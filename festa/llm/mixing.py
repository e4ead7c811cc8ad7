"""Mixing sources to target weights by entropy balancing.

Each source s has a token constraint: the words taken from it shall be its target. Among all document rates up to
``max_copies``, those nearest to 1 in relative entropy are exponentially tilted: rate = exp(lambda_s * size), with the
document's own words in the exponent. lambda solves the convex dual by Newton iterations, kept inside a bracket: each
step gathers the dual's gradient and curvature for all sources in one distributed aggregation. Documents of one source
and size have one rate, so the sums run over (source, size, count), which is exact and far smaller than the documents.

Rates are rounded into whole copies: floor(rate) for every document and one more for some, by sequential Poisson
sampling: in the order of a pseudo-random number over the fraction that is left, until the words add up; a closing
document takes up the last gap. This works in buckets of about BUCKET_ROWS documents, so that a source of any size is
split over many tasks, and yields one short plan row a bucket, from which every document knows its copies: whole rows
never move.

Targets: sources rank by code point (null last), weigh 1, 2, 3 repeating, and share all words by weight;
a target stops at ``max_copies`` times its source's words, the excess is shared out again by weight.

Rows that repeat source, id and text are numbered, in salted parts, and each number is rounded on its own, in a bucket of
its own; which of such rows gets which number makes no difference to the mix.

Defined results: a null or empty text has size 0, one copy and gives 0 words; a source without words has target 0;
null is a source of its own; rows alike in all are told apart by their numbers alone; an empty table gives an empty
result.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from festa.llm.common import WHITE_SPACE, cut, text_of
from festa.llm.common import sized as packed

#: The weights that the ranked sources repeat.
WEIGHTS = (1, 2, 3)
MAX_COPIES = 3
#: Documents that are rounded together, at least, and the most buckets that the plan has besides one a source.
BUCKET_ROWS, MOST_BUCKETS = 2_000, 65_536
#: The dual is solved when every source's words are this near their target, and given up after so many steps.
NEAR, NEWTON_STEPS = 1e-6, 80
#: Up to so many sources their figures are broadcast (under 10 MB); more are joined by a shuffle.
FEW_SOURCES = 100_000
#: Parts in which rows alike in source, id and text are numbered.
SALTS = 64


def _size() -> Column:
    return F.regexp_count(text_of(), F.lit(f"[^{WHITE_SPACE}]+")).cast("bigint")


def _mark() -> Column:
    return F.xxhash64(text_of())


def sizes(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "source", _size().alias("size"), _mark().alias("mark"))


def with_peers(rows: DataFrame) -> DataFrame:
    """``rows`` with ``peer``: 0, or the place from 0 among the rows alike in source, doc_id and mark. Only repeated rows move."""
    keyed = rows.withColumn("__k", F.xxhash64("source", "doc_id", "mark"))
    keys = cut(keyed.groupBy("__k").count().filter("count > 1").select("__k"))
    repeated = keys.count()
    if not repeated:
        return rows.withColumn("peer", F.lit(0).cast("bigint"))
    keys = F.broadcast(keys) if repeated <= FEW_SOURCES else keys
    once = keyed.join(keys, "__k", "left_anti").withColumn("peer", F.lit(0).cast("bigint"))
    again = cut(keyed.join(keys, "__k", "left_semi").withColumn("__salt", F.monotonically_increasing_id() % SALTS))
    before = Window.partitionBy("__k").orderBy("__salt").rowsBetween(Window.unboundedPreceding, -1)  # a row a part
    starts = again.groupBy("__k", "__salt").count().withColumn("__start", F.coalesce(F.sum("count").over(before), F.lit(0))).drop("count")
    place = F.row_number().over(Window.partitionBy("__k", "__salt").orderBy("__start"))
    again = again.join(starts, ["__k", "__salt"]).withColumn("peer", F.col("__start") + place - 1)
    return once.unionByName(again.drop("__salt", "__start")).drop("__k")


def _ranked(stats: DataFrame) -> DataFrame:
    """``stats`` with the rank of each source, from ranges of sources: no task sorts all of them."""
    ranges = cut(stats.repartitionByRange(F.col("source").asc_nulls_last())).withColumn("part", F.spark_partition_id())
    counts = {r["part"]: r["count"] for r in ranges.groupBy("part").count().collect()}  # one row a partition
    before = [sum(n for q, n in counts.items() if q < p) for p in range(max(counts, default=0) + 1)]
    inside = F.row_number().over(Window.partitionBy("part").orderBy(F.col("source").asc_nulls_last()))
    return ranges.withColumn("rank", F.element_at(F.array(*map(F.lit, before)), F.col("part") + 1) + inside).drop("part")


def targets(histogram: DataFrame, weights: tuple[float, ...] = WEIGHTS, max_copies: int = MAX_COPIES) -> DataFrame:
    """source, source_size, source_rows, target from (source, size, n)."""
    stats = histogram.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"), F.sum("n").alias("source_rows"))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.col("rank") - 1) % len(weights) + 1).cast("int"))
    weighed = cut(_ranked(stats).withColumn("weight", weight).withColumn("cap", F.col("source_size") * float(max_copies)))
    level, capped = 0.0, None
    while True:  # each round lifts the level and caps all sources that it reaches; ends when no more are
        full = F.col("weight") * level >= F.col("cap")
        total, held, free, now = weighed.agg(F.sum("source_size"), F.sum(F.when(full, F.col("cap"))), F.sum(F.when(~full, F.col("weight"))), F.count(F.when(full, 1))).first()
        if now == capped or not free:
            break
        level, capped = ((total or 0) - (held or 0.0)) / free, now
    return weighed.select("source", "source_size", "source_rows", F.least("cap", F.col("weight") * level).alias("target"))


def _tilt(max_copies: int) -> Column:
    """A document's rate; ``tilt`` is null where every document is taken as often as may be."""
    grown = F.exp(F.least(F.col("tilt") * F.col("size") / F.col("scale"), F.lit(50.0)))
    return F.when(F.col("size") == 0, 1.0).when(F.col("tilt").isNull(), float(max_copies)).otherwise(F.least(F.lit(float(max_copies)), grown))


def source_tilts(histogram: DataFrame, weights: tuple[float, ...] = WEIGHTS, max_copies: int = MAX_COPIES) -> DataFrame:
    """source, source_size, source_rows, target, scale, tilt: one row per source. Rates are exp(tilt * size / scale)."""
    aimed = targets(histogram, weights, max_copies)
    most = F.col("target") >= F.col("source_size") * (max_copies * (1 - NEAR))
    none = F.lit(None).cast("double")
    state = cut(aimed.withColumns({"scale": F.greatest(F.col("source_size") / F.col("source_rows"), F.lit(1.0)), "tilt": F.when(~most, 0.0), "low": none, "high": none, "open": ~most}))
    solved = []
    for _ in range(NEWTON_STEPS):
        solved.append(state.filter(~F.col("open")))
        state = state.filter("open")
        sources = state.count()
        if not sources:
            break
        its = state.withColumnRenamed("source", "its")
        told = histogram.join(F.broadcast(its) if sources <= FEW_SOURCES else its, F.col("source").eqNullSafe(F.col("its")))
        words = F.col("n") * F.col("size") * _tilt(max_copies)
        bends = F.when(_tilt(max_copies) < max_copies, words * F.col("size") / F.col("scale")).otherwise(0.0)
        sums = told.groupBy(*its.columns).agg(F.sum(words).alias("words"), F.sum(bends).alias("bend"))
        state = cut(_stepped(sums.withColumnRenamed("its", "source")))
    return reduce(DataFrame.unionByName, [*solved, state]).drop("low", "high", "open")


def _stepped(state: DataFrame) -> DataFrame:
    """One Newton step for every source; halves the bracket instead where Newton would leave it."""
    tilt, reach = F.col("tilt"), 2 * F.greatest(F.abs("tilt"), F.lit(1.0))
    low, high = F.when(F.col("gap") > 0, tilt).otherwise(F.col("low")), F.when(F.col("gap") < 0, tilt).otherwise(F.col("high"))
    newton = tilt + F.greatest(-reach, F.least(reach, F.when(F.col("bend") > 0, F.col("gap") / F.col("bend")).otherwise(F.signum("gap") * reach)))
    inside = (F.col("low").isNull() | (F.col("newton") > F.col("low"))) & (F.col("high").isNull() | (F.col("newton") < F.col("high")))
    moved = state.withColumn("gap", F.col("target") - F.col("words")).withColumn("open", F.abs("gap") > F.greatest(F.col("target") * NEAR, F.lit(1e-9)))
    moved = moved.withColumns({"low": low, "high": high}).withColumn("newton", newton)
    tilted = F.when(F.col("open"), F.when(inside, F.col("newton")).otherwise((F.col("low") + F.col("high")) / 2)).otherwise(tilt)
    return moved.withColumn("tilt", tilted).drop("gap", "newton", "words", "bend")


def _dealt(rows: DataFrame, tilts: DataFrame, max_copies: int) -> DataFrame:
    """``rows`` with size, mark and their source's figures: base copies, the fraction left, bucket and place in it."""
    told = rows.join(tilts.withColumnRenamed("source", "__source"), F.col("source").eqNullSafe(F.col("__source")))
    rate = _tilt(max_copies)
    told = told.withColumn("__base", F.floor(rate + 1e-9)).withColumn("__part", F.greatest(rate - F.col("__base"), F.lit(0.0)))
    mixed_up = lambda use: F.when(F.col("peer") == 0, F.xxhash64("doc_id", "mark", F.lit(use))).otherwise(F.xxhash64("doc_id", "mark", F.lit(use), "peer"))
    chance = mixed_up("order") / F.lit(2.0**64) + F.lit(0.5)
    place = F.struct((chance / F.col("__part")).alias("turn"), "doc_id", "size", "mark", "peer")
    return told.withColumn("__bucket", F.pmod(mixed_up("bucket"), F.col("buckets"))).withColumn("__place", F.when(F.col("__part") > 1e-9, place))


def plan(sized: DataFrame, weights: tuple[float, ...] = WEIGHTS, max_copies: int = MAX_COPIES) -> tuple[DataFrame, DataFrame]:
    """The sources' tilts and the buckets' plan (source, bucket, last place taken, closing place) for the rows of ``sizes`` with their peers."""
    histogram = packed(sized.groupBy("source", "size").agg(F.count(F.lit(1)).alias("n")), 200_000)
    rows = histogram.agg(F.sum("n")).first()[0] or 0
    tilts = source_tilts(histogram, weights, max_copies)
    tilts = cut(tilts.withColumn("buckets", F.ceil(F.col("source_rows") / max(BUCKET_ROWS, rows / MOST_BUCKETS))))
    rows = _dealt(sized, tilts, max_copies).filter("__place is not null").select("__source", "__bucket", "__place", "__part", "size")
    bucket = Window.partitionBy("__source", "__bucket")
    order = bucket.orderBy("__place")
    peers = F.sum("size").over(order.rangeBetween(Window.currentRow, Window.currentRow))
    upto = F.sum("size").over(order.rangeBetween(Window.unboundedPreceding, Window.currentRow))
    need = F.sum(F.col("size") * F.col("__part")).over(bucket)
    drawn = rows.withColumns({"__peers": peers, "__upto": upto, "__need": need}).withColumn("__in", F.col("__upto") - F.col("__peers") / 2 <= F.col("__need"))
    # the words still missing after all that are in, and after one more change
    gap = F.col("__need") - F.max(F.when(F.col("__in"), F.col("__upto")).otherwise(0)).over(bucket)
    left = F.abs(F.col("__gap") - F.when(F.col("__in"), -F.col("__peers")).otherwise(F.col("__peers")))
    closed = drawn.withColumn("__gap", gap).withColumn("__left", left)
    closing = F.min(F.when(F.col("__left") < F.abs("__gap"), F.struct("__left", "__place"))).alias("closing")
    return tilts, cut(closed.groupBy("__source", "__bucket").agg(F.max(F.when(F.col("__in"), F.col("__place"))).alias("last"), closing).select("__source", "__bucket", "last", F.col("closing.__place").alias("closing")))


def with_copies(rows: DataFrame, tilts: DataFrame, planned: DataFrame, max_copies: int = MAX_COPIES) -> DataFrame:
    """``rows`` (doc_id, source, size, mark, peer and any more) with source_size, target, copies, taken."""
    found = planned.select(F.col("__source").alias("__of"), F.col("__bucket").alias("__in"), "last", "closing")
    told = _dealt(rows, tilts, max_copies).join(found, F.col("__source").eqNullSafe(F.col("__of")) & (F.col("__bucket") == F.col("__in")), "left")
    drawn = F.coalesce(F.col("__place") <= F.col("last"), F.lit(False)) != F.coalesce(F.col("__place") == F.col("closing"), F.lit(False))
    copies = F.least(F.col("__base") + drawn.cast("int"), F.lit(max_copies)).cast("int")
    return told.withColumn("copies", copies).withColumn("taken", F.col("size") * F.col("copies"))


def mix_documents(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target, taken, copies for every document."""
    sized = cut(with_peers(cut(sizes(docs))))
    return with_copies(sized, *plan(sized)).select("doc_id", "size", "source_size", "target", "taken", "copies")


def mixed(docs: DataFrame) -> DataFrame:
    """The mix itself: each document as often as its copies say, with its own columns."""
    rows = docs.select("doc_id", "source", _size().alias("size"), _mark().alias("mark"), F.struct(*[docs[c] for c in docs.columns]).alias("__row"))
    taken = with_copies(with_peers(rows), *plan(cut(with_peers(cut(sizes(docs)))))).filter("copies > 0")
    return taken.select("__row", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("__copy")).select("__row.*")

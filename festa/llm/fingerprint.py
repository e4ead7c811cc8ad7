"""Document fingerprints: bottom-k sketches of word shingle hashes, in DataFrame functions alone.

A sketch is the sorted array of the k smallest distinct 64-bit hashes of a text's shingles (five words, lower
case; a shorter text is one shingle). Sketches of parts merge into the sketch of their union. Two sketches
estimate resemblance and containment, one the number of distinct shingles; below k shingles all are exact.

Defined results: a null text counts as empty; an empty text has an empty sketch and the empty fingerprint;
two empty sketches are alike (1.0), an empty and another are not (0.0); of documents with the same id the
order of their texts decides which comes next; a null id comes last; a single document follows itself.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from festa.llm.common import text_of

SHINGLE_WORDS = 5
SKETCH_SIZE = 128
#: Documents that stand together in one bucket of ids, and the most buckets: their list is broadcast (24 bytes each).
BUCKET_ROWS = 500
MOST_BUCKETS = 65_536
#: Ranges of ids, bounded by approximate quantiles, that are cut into the buckets.
RANGES = 256


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value computed once a row, not once for each element of an inner lambda."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def shingle_hashes(text: Column, size: int = SHINGLE_WORDS) -> Column:
    """Hashes of all runs of ``size`` words; of the whole text if it is shorter."""
    words = F.filter(F.split(F.lower(text), r"\s+"), lambda w: w != "")
    hashed = F.transform(words, lambda w: F.xxhash64(w))

    def shingles(h: Column) -> Column:
        rolled = F.transform(h, lambda x, i: F.xxhash64(x, *[F.get(h, i + j) for j in range(1, size)]))
        return F.slice(rolled, F.lit(1), F.greatest(F.size(h) - (size - 1), F.lit(1)))

    return F.when(F.trim(text) == "", F.array().cast("array<bigint>")).otherwise(let(hashed, shingles))


def sketch(text: Column, k: int = SKETCH_SIZE, size: int = SHINGLE_WORDS) -> Column:
    return F.slice(F.sort_array(F.array_distinct(shingle_hashes(text, size))), 1, k)


def fingerprint(sketched: Column) -> Column:
    """The sketch as hexadecimal digits, sixteen for each hash."""
    return F.array_join(F.transform(sketched, lambda h: F.lpad(F.lower(F.hex(h)), 16, "0")), "")


def _reach(a: Column, b: Column, k: int) -> Column:
    """Up to which hash both sketches are complete."""
    most = F.lit(2**63 - 1)
    full = lambda s: F.when(F.size(s) >= k, F.element_at(s, -1)).otherwise(most)
    return F.least(full(a), full(b))


def _within(s: Column, reach: Column) -> Column:
    return F.size(F.filter(s, lambda h: h <= reach))


def resemblance(a: Column, b: Column, k: int = SKETCH_SIZE) -> Column:
    """Estimated Jaccard likeness of the shingle sets."""

    def of(reach: Column) -> Column:
        both = _within(F.array_intersect(a, b), reach)
        return both / (_within(a, reach) + _within(b, reach) - both)

    return F.when((F.size(a) == 0) | (F.size(b) == 0), (F.size(a) == F.size(b)).cast("double")).otherwise(let(_reach(a, b, k), of))


def containment(a: Column, b: Column, k: int = SKETCH_SIZE) -> Column:
    """Estimated share of a's shingles that b has too."""
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(let(_reach(a, b, k), lambda r: _within(F.array_intersect(a, b), r) / F.greatest(_within(a, r), F.lit(1))))


def distinct_shingles(s: Column, k: int = SKETCH_SIZE) -> Column:
    """Estimated number of distinct shingles; exact below k."""
    return F.when(F.size(s) < k, F.size(s).cast("double")).otherwise((k - 1) * 2.0**64 / (F.element_at(s, -1).cast("double") + 2.0**63))


def merged(parts: DataFrame, key: str, column: str = "sketch", k: int = SKETCH_SIZE) -> DataFrame:
    """One sketch per key from those of its parts. Each task sends at most k hashes a key to the next."""
    hashes = parts.select(key, F.explode(column).alias("__hash")).distinct()
    order = Window.partitionBy(key).orderBy("__hash")
    least = hashes.withColumn("__rank", F.row_number().over(order)).filter(F.col("__rank") <= k)
    return least.groupBy(key).agg(F.sort_array(F.collect_list("__hash")).alias(column))


def _buckets(rows: DataFrame) -> Column:
    """A bucket number that falls as doc_id rises, last for a null id: ranges of about as many rows each, cut evenly.

    Quantiles bound the ranges, so that ids far apart or close together make no bucket large.
    """
    shares = [i / RANGES for i in range(1, RANGES)]
    low, high, count, found = rows.select(F.min("doc_id"), F.max("doc_id"), F.count(F.lit(1)), F.percentile_approx("doc_id", shares, 10_000)).first()
    low, high, found = low or 0, high or 0, found or []
    ranges = max(1, min(RANGES, count // BUCKET_ROWS))
    cuts = sorted({c for c in found[RANGES // ranges - 1 :: RANGES // ranges] if c < high})
    starts, ends = [low, *(c + 1 for c in cuts)], [*cuts, high]
    parts = max(1, min(MOST_BUCKETS, count // BUCKET_ROWS) // len(starts))
    widths = [-(-(e - s + 1) // parts) for s, e in zip(starts, ends, strict=True)]
    doubles = lambda values: F.array(*[F.lit(float(v)) for v in values])
    at = F.size(F.filter(F.array(*[F.lit(c).cast("bigint") for c in cuts]).cast("array<bigint>"), lambda c: c < F.col("doc_id")))

    def place(r: Column) -> Column:
        inside = F.floor((F.col("doc_id").cast("double") - F.get(doubles(starts), r)) / F.get(doubles(widths), r))
        return F.lit(len(starts) * parts) - r * parts - F.greatest(F.lit(0), F.least(inside, F.lit(parts - 1))) - 1

    return F.coalesce(F.when(F.col("doc_id").isNotNull(), let(at, place)), F.lit(len(starts) * parts)).cast("int")


def with_next(docs: DataFrame, derive: dict[str, Column]) -> DataFrame:
    """doc_id, text, next_text; and each derived column (of the text) with that of the next document as ``next_...``.

    Documents follow each other by descending id, the first after the last. Ids are dealt by range into buckets; the
    first document of each bucket is also sent to the bucket before it, so one shuffle of the texts is enough.
    """
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_of().alias("text"))
    bucket = _buckets(rows)
    dealt = rows.withColumn("__bucket", bucket)
    firsts = dealt.groupBy("__bucket").agg(F.max("doc_id").alias("__first"))
    by_bucket = Window.orderBy("__bucket")
    before = F.coalesce(F.lag("__bucket").over(by_bucket), F.last("__bucket").over(by_bucket.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    targets = firsts.withColumn("__before", before)
    edge = F.when(F.col("doc_id").eqNullSafe(F.col("__first")), F.col("__before"))
    sent = dealt.join(F.broadcast(targets), "__bucket")  # at most MOST_BUCKETS + 1 rows
    sent = sent.select("doc_id", "text", F.explode(F.filter(F.array(F.struct(F.col("__bucket").alias("b"), F.lit(False).alias("guest")), F.struct(edge.alias("b"), F.lit(True).alias("guest"))), lambda x: x["b"].isNotNull())).alias("__to"))
    placed = sent.select("doc_id", "text", F.col("__to.b").alias("__bucket"), F.col("__to.guest").alias("__guest")).repartition("__bucket")
    order = Window.partitionBy("__bucket").orderBy("__guest", F.col("doc_id").desc_nulls_last(), "text")
    known = placed.withColumns(derive)
    following = known.withColumns({f"next_{c}": F.lead(c).over(order) for c in ["text", *derive]})
    return following.filter(~F.col("__guest")).drop("__bucket", "__guest")


def fingerprints(docs: DataFrame, k: int = SKETCH_SIZE) -> DataFrame:
    """Fingerprints of every text and of its edited text, and their likenesses."""
    pairs = with_next(docs, {"sketch": sketch(F.col("text"), k)})
    n = F.char_length("text")
    cut_ = F.floor(n / 3).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - cut_), F.substring(F.col("next_text"), F.lit(1), cut_))
    done = pairs.select("doc_id", "sketch", "next_sketch", n.cast("bigint").alias("n_chars"), edited.alias("edited"))
    done = done.withColumn("edited_sketch", sketch(F.col("edited"), k))
    return done.select(
        "doc_id",
        "n_chars",
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        fingerprint(F.col("sketch")).alias("fingerprint"),
        fingerprint(F.col("edited_sketch")).alias("edited_fingerprint"),
        resemblance(F.col("sketch"), F.col("edited_sketch"), k).alias("near_edited"),
        resemblance(F.col("sketch"), F.col("next_sketch"), k).alias("near_next"),
        distinct_shingles(F.col("sketch"), k).alias("shingles"),
    )

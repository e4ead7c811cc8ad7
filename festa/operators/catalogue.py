"""The catalogue of events: its queries, mutations, aggregations and reports as DataFrame operators.

``today`` is always a parameter (a Column or a date literal), never the clock.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from festa.functions import facts, text
from festa.functions.geo import held_elsewhere, score_of, scores
from festa.functions.names import event_name_of
from festa.operators.resolve import last_date

RETENTION_DAYS, UNDATED_DAYS = 90, 30
RETRY_STATUSES = ("no_body", "title_only")


def ends() -> Column:
    return last_date(F.col("start_date"), F.col("end_date"))


def with_priority(events: DataFrame, limit: int = facts.LARGE_CROWD) -> DataFrame:
    args = [F.col(c) for c in ("name", "venue", "crowd", "fireworks", "big_concert")]
    return events.withColumns({"priority": facts.priority(*args, limit), "search_text": facts.search_text(F.col("name"), F.col("venue"), F.col("summary"), F.col("province"))})


def priority_rank() -> Column:
    return F.when(F.col("priority") == "CAO", 0).when(F.col("priority") == "TB", 1).otherwise(2)


# queries


def events_between(events: DataFrame, start: Column, end: Column, province: str | None = None) -> DataFrame:
    """Dated events that overlap [start, end], by start, priority and name."""
    found = events.filter((F.col("start_date") <= end) & (ends() >= start))
    found = found if province is None else found.filter(F.col("province") == province)
    return found.orderBy("start_date", priority_rank(), "name", "id")


def search(events: DataFrame, keyword: str, today: Column, limit: int = 15, ahead: int = 90) -> DataFrame:
    """The next events whose text holds the keyword; none for an empty keyword."""
    key = text.normalize(F.lit(keyword))
    open_ = (F.col("start_date") <= F.date_add(today, ahead)) & (ends() >= today)
    return events.filter((key != "") & F.contains("search_text", key) & open_).orderBy("start_date", "id").limit(limit)


def large() -> Column:
    return facts.is_large(F.col("crowd"), F.col("fireworks"), F.col("big_concert"))


def unalerted_large(events: DataFrame, today: Column, horizon: int = 60) -> DataFrame:
    return events.filter(~F.col("alerted") & (F.col("start_date") <= F.date_add(today, horizon)) & (ends() >= today) & large())


def pending(events: DataFrame, today: Column, horizon: int = 60) -> DataFrame:
    """Events that lack a date or a venue and have not ended; undated ones last."""
    open_ = F.coalesce(ends() >= today, F.lit(True)) & F.coalesce(F.col("start_date") <= F.date_add(today, horizon), F.lit(True))
    lacking = F.col("start_date").isNull() | (F.coalesce("venue", F.lit("")) == "")
    return events.filter(open_ & lacking).orderBy(F.col("start_date").isNull(), "start_date", "id")


def current(events: DataFrame, today: Column) -> DataFrame:
    return events.filter(F.coalesce(ends() >= today, F.lit(True))).orderBy(F.col("start_date").isNull(), "start_date", "id")


def undated_by_province(events: DataFrame, most: int = 15) -> DataFrame:
    """The first undated events of each province."""
    rank = F.row_number().over(Window.partitionBy("province").orderBy("id"))
    return events.filter("start_date is null").withColumn("rank", rank).filter(F.col("rank") <= most)


# aggregations


def status_counts(ledger: DataFrame) -> DataFrame:
    return ledger.groupBy("status").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "status")


def digest_counts(events: DataFrame) -> DataFrame:
    return events.agg(F.count(F.lit(1)).alias("events"), F.count_if(large()).alias("large"))


def fail_streaks(runs: DataFrame) -> DataFrame:
    """source_id, fails since the last success, last success, runs. Rows: source_id, seq, run_at, ok. One aggregation, no window."""
    last_ok = F.max(F.when(F.col("ok"), F.struct("seq", "run_at")))
    per = runs.groupBy("source_id").agg(last_ok.alias("last_ok"), F.count(F.lit(1)).alias("runs"))
    after = runs.join(per, "source_id").filter(~F.col("ok") & ((F.col("last_ok").isNull()) | (F.col("seq") > F.col("last_ok.seq"))))
    fails = after.groupBy("source_id").agg(F.count(F.lit(1)).alias("fails"))
    return per.join(fails, "source_id", "left").select("source_id", F.coalesce("fails", F.lit(0)).alias("fails"), F.col("last_ok.run_at").alias("last_ok"), "runs")


def to_notify(streaks: DataFrame, threshold: int = 3) -> DataFrame:
    return streaks.filter(F.col("fails") >= threshold)


def failure_summary(bad: DataFrame, shown: int = 15) -> DataFrame:
    """How many sources fail, the first of them, and how many more there are."""
    first = bad.orderBy(F.desc("fails"), "source_id").limit(shown)
    return first.agg(F.collect_list(F.struct("fails", "source_id")).alias("shown")).crossJoin(bad.agg(F.count(F.lit(1)).alias("bad"))).withColumn("more", F.greatest(F.col("bad") - shown, F.lit(0)))


# mutations: each returns the new table


def latest(rows: DataFrame, key: str, *order: Column) -> DataFrame:
    """One row a key, the last by ``order``: an upsert's result. Partial maxima are taken before the shuffle."""
    rest = [c for c in rows.columns if c != key]
    best = F.max_by(F.struct(*rest), F.struct(*order))
    return rows.groupBy(key).agg(best.alias("r")).select(key, "r.*")


def unseen(items: DataFrame, ledger: DataFrame, now: Column | None = None, retry_hours: int = 6) -> DataFrame:
    """Items whose link the ledger does not hold; retryable entries free their link after some hours."""
    held = ledger
    if now is not None:
        held = ledger.filter(~(F.col("status").isin(*RETRY_STATUSES) & (F.col("seen_at") < now - F.expr(f"interval {retry_hours} hours"))))
    return items.join(held.select("link"), "link", "left_anti")


def upserted(old: DataFrame, new: DataFrame, key: str = "id") -> DataFrame:
    """Rows of ``new`` replace those of ``old`` by key."""
    return old.join(new.select(key), key, "left_anti").unionByName(new)


def updated(old: DataFrame, new: DataFrame, kept: tuple[str, ...] = ("province", "first_seen", "alerted")) -> DataFrame:
    """``old`` with the fields of ``new`` (one row an id) but for those that an update never touches; unknown ids add nothing."""
    hit = F.col("n.id").isNotNull()
    fields = [F.col(f"o.{c}") if c == "id" or c in kept else F.when(hit, F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c) for c in old.columns]
    return old.alias("o").join(new.alias("n"), F.col("o.id") == F.col("n.id"), "left").select(*fields)


def subscribed(subscribers: DataFrame, joining: DataFrame, most: int = 60) -> DataFrame:
    """chat_id, name, joined_at: who joins is added with a name of 60 characters at most; who is there stays as is, the first to join wins."""
    rank = lambda df, n, name: df.select("chat_id", name.alias("name"), "joined_at", F.lit(n).alias("__new"))
    both = rank(subscribers, 0, F.col("name")).unionByName(rank(joining, 1, F.substring(F.coalesce("name", F.lit("")), 1, most)))
    first = F.min(F.struct("__new", "joined_at", "name")).alias("f")
    return both.groupBy("chat_id").agg(first).select("chat_id", "f.name", "f.joined_at")


def named(replies: DataFrame, events: DataFrame) -> DataFrame:
    """Replies (name, …) with the ``id`` of the event of the same normalised name; of several events the last one. Others are left out."""
    key = text.normalize(F.col("name")).alias("__key")
    last = events.groupBy(key).agg(F.max("id").alias("id"))
    return replies.select("*", key).join(last, "__key").drop("__key")


def readmitted(ledger: DataFrame, links: DataFrame) -> DataFrame:
    """The ledger without the links that are given again by hand, so that they pass as unseen whatever they came to before."""
    return ledger.join(links.select("link").distinct(), "link", "left_anti")


def described() -> Column:
    """An event in a line for a model: name, dates, venue and summary; at most 400 signs; an unknown date shows as None."""
    day = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("None"))
    whole = F.concat(F.col("name"), F.lit(" | "), day("start_date"), F.lit("→"), day("end_date"), F.lit(" | "), F.coalesce("venue", F.lit("")), F.lit(" | "), F.coalesce("summary", F.lit("")))
    return F.substring(whole, 1, 400)


def deleted(rows: DataFrame, gone: DataFrame, key: str = "id") -> DataFrame:
    return rows.join(gone.select(key), key, "left_anti")


def retained_articles(ledger: DataFrame, today: Column) -> DataFrame:
    return ledger.filter(F.col("seen_at") >= F.date_sub(today, RETENTION_DAYS))


def retained_events(events: DataFrame, today: Column) -> DataFrame:
    """Without events that ended (or were first seen) 90 days ago, and undated ones first seen 30 days ago."""
    first = F.col("first_seen").cast("date")
    old = F.coalesce(ends(), first) < F.date_sub(today, RETENTION_DAYS)
    return events.filter(~old & ~(F.col("start_date").isNull() & (first < F.date_sub(today, UNDATED_DAYS))))


def mark_alerted(events: DataFrame, delivered: DataFrame) -> DataFrame:
    hit = delivered.select(F.col("id"), F.lit(True).alias("__hit")).distinct()
    return events.join(hit, "id", "left").withColumn("alerted", F.col("alerted") | F.coalesce("__hit", F.lit(False))).drop("__hit")


def recipients(configured: DataFrame, subscribers: DataFrame) -> DataFrame:
    """Chats that get messages: configured ones first, then subscribers by the time they joined, each once."""
    both = configured.select("chat_id", F.lit(0).alias("kind"), F.lit(None).cast("timestamp").alias("joined_at")).unionByName(subscribers.select("chat_id", F.lit(1).alias("kind"), "joined_at"))
    return both.groupBy("chat_id").agg(F.min(F.struct("kind", "joined_at")).alias("first")).select("chat_id", F.col("first.kind").alias("kind"), F.col("first.joined_at").alias("joined_at"))


def pruned(events: DataFrame) -> DataFrame:
    """Events with ``why`` they should go (null: they stay): no cultural event, no name, held elsewhere, elsewhere named more."""
    head = F.concat_ws(" ", "name", "venue")
    score = scores(head, F.col("summary"))
    told = events.withColumn("__name", event_name_of(F.col("name"), F.col("summary")))
    why = (
        F.when(~text.is_cultural_event(F.col("name"), F.col("summary"), F.col("crowd"), F.col("fireworks"), F.col("big_concert")), "not_cultural")
        .when(F.col("__name") == "", "no_name")
        .when(held_elsewhere(F.col("name"), F.col("summary")), "held_elsewhere")
        .when(score["elsewhere"] > score_of(score, F.col("province")), "elsewhere")
    )
    return told.withColumn("why", why).drop("__name")

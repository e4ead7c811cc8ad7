"""Filling gaps: replies of a language model as rows, search queries, ranking of found articles, acceptance rules.

The services themselves are connectors: a caller passes their replies and search results in as columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from festa.functions import facts, geo, lexicon, text
from festa.functions.names import search_terms
from festa.operators.classify import FAR_DAYS, PAST_DAYS
from festa.operators.resolve import last_date, tokens

BAND_DAYS = 3
CANDIDATES, SITES, LINKS = 4, 5, 6

#: What a reply may hold; everything is text until it is cast.
REPLY = "name string, province string, venue string, start_date string, end_date string, start_time string, crowd string, fireworks string, big_concert string, summary string, is_event string, in_province string"


def replied(reply: Column) -> Column:
    """array<struct> of a model's answer: the outermost JSON list in it, or the one object; empty if there is neither."""
    listed = F.regexp_extract(reply, r"(?s)\[.*\]", 0)
    single = F.regexp_extract(reply, r"(?s)\{.*\}", 0)
    whole = F.when(listed != "", listed).otherwise(F.when(single != "", F.concat(F.lit("["), single, F.lit("]"))))
    return F.coalesce(F.from_json(whole, f"array<struct<{REPLY.replace(' string', ':string')}>>", {"mode": "PERMISSIVE"}), F.array().cast(f"array<struct<{REPLY.replace(' string', ':string')}>>"))


def _truth(c: Column, default: bool) -> Column:
    return F.coalesce(F.lower(c).isin("true", "1", "yes"), F.lit(default))


def cleaned(r: Column) -> Column:
    """One reply's fields in their types: names resolved, a crowd above zero, texts cut, a missing end the start."""
    cut = lambda c, n: F.substring(F.btrim(F.coalesce(c, F.lit(""))), 1, n)
    start = r["start_date"].try_cast("date")
    crowd = r["crowd"].try_cast("double").cast("int")
    return F.struct(
        cut(r["name"], 160).alias("name"),
        geo.resolve_province(r["province"]).alias("province"),
        cut(r["venue"], 100).alias("venue"),
        start.alias("start_date"),
        F.coalesce(r["end_date"].try_cast("date"), start).alias("end_date"),
        cut(r["start_time"], 5).alias("start_time"),
        F.when(crowd > 0, crowd).alias("crowd"),
        _truth(r["fireworks"], False).alias("fireworks"),
        _truth(r["big_concert"], False).alias("big_concert"),
        cut(r["summary"], 220).alias("summary"),
        _truth(r["is_event"], True).alias("is_event"),
        _truth(r["in_province"], True).alias("in_province"),
    )


def reply_rows(replies: DataFrame) -> DataFrame:
    """One row for each event of each reply; the other columns are kept."""
    rest = [c for c in replies.columns if c != "reply"]
    return replies.select(*rest, F.explode(replied(F.col("reply"))).alias("r")).select(*rest, cleaned(F.col("r")).alias("r")).select(*rest, "r.*")


def overlaid(rule: str, model: str) -> Column:
    """What the rules found with what the model says over it: its fields win if they say something, flags add up."""
    o, n = (lambda c: F.col(f"{rule}.{c}")), (lambda c: F.col(f"{model}.{c}"))
    said = lambda c: F.coalesce(F.nullif(n(c), F.lit("")), o(c))
    return F.struct(
        said("name").alias("name"),
        F.when(facts.valid_venue(n("venue")), n("venue")).otherwise(o("venue")).alias("venue"),
        F.coalesce(n("start_date"), o("start_date")).alias("start_date"),
        F.coalesce(n("end_date"), o("end_date")).alias("end_date"),
        said("start_time").alias("start_time"),
        F.coalesce(n("crowd"), o("crowd")).alias("crowd"),
        (o("fireworks") | n("fireworks")).alias("fireworks"),
        (o("big_concert") | n("big_concert")).alias("big_concert"),
        said("summary").alias("summary"),
    )


def judged(found: DataFrame, today: Column) -> DataFrame:
    """Events that a model's search found (cleaned fields, and the province asked for) with their status: not_event, out_of_scope, past, far or accept."""
    rows = found.withColumn("name", text.canonical_name(F.col("name")))
    rows = rows.withColumn("__s", geo.scores(F.concat_ws(" ", "name", "venue"), F.col("summary")))
    rows = rows.withColumn("province", geo.correct_province(F.col("__s"), F.col("province")))
    name, s = F.col("name"), F.col("__s")
    end = last_date(F.col("start_date"), F.col("end_date"))
    status = (
        F.when((F.char_length(name) < 6) | text.has_negative(name) | geo.title_elsewhere(name) | F.col("start_date").isNull() | text.not_vietnamese(F.concat_ws(" ", name, F.col("summary"))), "not_event")
        .when(s["elsewhere"] > geo.score_of(s, F.col("province")), "out_of_scope")
        .when(end < F.date_sub(today, PAST_DAYS), "past")
        .when(F.col("start_date") > F.date_add(today, FAR_DAYS), "far")
        .otherwise("accept")
    )
    venue = F.when(facts.valid_venue(F.col("venue")), F.col("venue")).otherwise("")
    return rows.withColumns({"status": status, "venue": venue}).drop("__s")


def search_queries(events: DataFrame) -> DataFrame:
    """id, rank, query: first on the province's own papers, then anywhere."""
    terms = search_terms(F.col("name"), F.col("province"))
    sites = F.lit(None).cast("string")
    for key, own in lexicon.LOCAL_SITES.items():
        sites = F.when(F.col("province") == key, " OR ".join(f"site:{s}" for s in own[:SITES])).otherwise(sites)
    local = F.concat(terms, F.lit(" ("), sites, F.lit(") when:90d"))
    return events.select("id", F.posexplode(F.filter(F.array(local, F.concat(terms, F.lit(" when:90d"))), lambda q: q.isNotNull())).alias("rank", "query"))


def is_local(province: Column, publisher: Column) -> Column:
    found = F.lit(False)
    for key, own in lexicon.LOCAL_SITES.items():
        found = found | ((province == key) & publisher.rlike("|".join(s.replace(".", r"\.") for s in own)))
    return F.coalesce(found, F.lit(False))


def ranked(events: DataFrame, found: DataFrame, most: int = CANDIDATES) -> DataFrame:
    """The best articles for each event (id, link, title, publisher): two telling words in common, own papers first, then the overlap."""
    known = events.select("id", "province", tokens(F.col("name"), F.col("province")).alias("own"))
    rows = found.join(known, "id").filter(~geo.title_elsewhere(F.col("title")))
    rows = rows.withColumn("overlap", F.size(F.array_intersect(tokens(F.col("title"), F.col("province")), F.col("own")))).filter("overlap >= 2")
    first = rows.groupBy("id", "link").agg(F.min_by(F.struct("title", "publisher", "province", "overlap"), F.col("pos")).alias("r"), F.min("pos").alias("pos")).select("id", "link", "pos", "r.*")
    order = Window.partitionBy("id").orderBy(~is_local(F.col("province"), F.col("publisher")), F.desc("overlap"), "pos")
    return first.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= most).drop("own")


def acceptable(event: str, found: str, today: Column) -> Column:
    """Whether what was found may be merged: same province, not past, starts within three days of each other."""
    e, f = (lambda c: F.col(f"{event}.{c}")), (lambda c: F.col(f"{found}.{c}"))
    far = F.abs(F.datediff(e("start_date"), f("start_date"))) > BAND_DAYS
    past = last_date(f("start_date"), f("end_date")) < F.date_sub(today, PAST_DAYS)
    return (F.coalesce(f("province"), e("province")) == e("province")) & ~F.coalesce(past, F.lit(False)) & ~F.coalesce(far, F.lit(False))


def promoted(sources: Column, link: Column, local: Column) -> Column:
    """A local paper's link goes first, another last; each link once, six at most."""
    rest = F.array_remove(sources, link)
    return F.slice(F.array_distinct(F.when(local, F.array_prepend(rest, link)).otherwise(F.array_append(rest, link))), 1, LINKS)

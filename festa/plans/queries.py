"""The registered queries of the engine, each with DuckDB SQL of the same result where SQL can express it."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from festa.functions import dates, facts, geo, lexicon, render, text
from festa.operators import backfills, catalogue, classify, enrich, resolve, stats, stored
from festa.plans import serve
from festa.plans.views import ARTICLES, EVENTS, LEDGER, RUNS, TODAY, spread, view
from festa.shared import shared_folder
from festa.sources import decode, feeds, html, selectors
from festa.streaming import alerts, ingest, replies, schedule

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def today():
    return F.lit(TODAY).cast("date")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(view(spark, sf_dir, ARTICLES), _table(spark, sf_dir, "orders"), "item_id")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event catalogue, with priority and search text."""
    return catalogue.with_priority(spread(view(spark, sf_dir, EVENTS), _table(spark, sf_dir, "orders"), "id").withColumn("sources", F.array("source")))


def _reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as reports to fold."""
    rows = view(spark, sf_dir, EVENTS).filter(F.col("province").isNotNull()).withColumn("sources", F.array("source"))
    return spread(rows, _table(spark, sf_dir, "orders"), "id")


# SQL fragments


def n(x: str) -> str:
    return f"trim(regexp_replace(lower(strip_accents(translate({x}, 'đĐ', 'dD'))), '[^a-z0-9]+', ' ', 'g'))"


def quoted(words) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


def sql_hits(x: str, words) -> str:
    return f"list_filter({quoted(words)}, lambda k: contains(' ' || {x} || ' ', ' ' || k || ' '))"


def sql_any(x: str, words) -> str:
    return f"len({sql_hits(x, dict.fromkeys(words))}) > 0"


def sql_count(x: str, words) -> str:
    """Mentions of all words in a normalised text; blanks are doubled so that neighbours are told apart."""
    spread = f"(' ' || replace({x}, ' ', '  ') || ' ')"
    return f"list_sum(list_transform({quoted(words)}, lambda k: (length({spread}) - length(replace({spread}, ' ' || replace(k, ' ', '  ') || ' ', ''))) // (length(replace(k, ' ', '  ')) + 2)))"


SQL_LARGE = f"(coalesce(crowd, 0) >= {facts.LARGE_CROWD} OR fireworks OR big_concert)"
SQL_SENSITIVE = "len(list_filter({}, lambda k: contains(' ' || n, ' ' || k))) > 0".format(quoted(lexicon.SENSITIVE))
SQL_EVENTS = f"""
    e AS (SELECT *, {n("name || ' ' || venue")} AS n FROM ({EVENTS})),
    p AS (SELECT *, CASE WHEN {SQL_LARGE} OR (coalesce(crowd, 0) >= 5000 AND {SQL_SENSITIVE}) THEN 'CAO'
                         WHEN {sql_any("n", lexicon.TRADITIONAL)} OR coalesce(crowd, 0) >= 1000 OR {SQL_SENSITIVE} OR {sql_any("n", lexicon.MIDDLE)} THEN 'TB'
                         ELSE 'THAP' END AS priority,
                 {n("name || ' ' || venue || ' ' || summary || ' ' || coalesce(province, '')")} AS search_text FROM e)"""
D = f"DATE '{TODAY}'"
LAST = "coalesce(end_date, start_date)"

# functions over texts


@query(f"SELECT doc_id, md5({n('text')}) AS normalized_md5, length({n('text')}) AS n FROM documents")
def normalize_documents(spark, sf_dir):
    norm, docs = text.normalize(F.col("text")), _table(spark, sf_dir, "documents")
    return docs.select("doc_id", F.md5(norm.cast("binary")).alias("normalized_md5"), F.char_length(norm).alias("n"))


@query(f"""
    WITH a AS (SELECT item_id, {n("title")} AS t, {n("body")} AS b FROM ({ARTICLES}))
    SELECT item_id, array_to_string({sql_hits("t", lexicon.STRONG + lexicon.WEAK)}, '|') AS hits, {sql_any("t", lexicon.NEGATIVE)} AS negative,
           {sql_any("t", lexicon.PREPARING)} AS preparing, {sql_any("b", lexicon.STRONG)} AS strong_body FROM a""")
def keyword_hits(spark, sf_dir):
    title = F.col("title")
    return articles(spark, sf_dir).select("item_id", F.array_join(text.keyword_hits(title), "|").alias("hits"), text.has_negative(title).alias("negative"), text.is_preparing(title).alias("preparing"), text.has_any(text.normalize(F.col("body")), lexicon.STRONG).alias("strong_body"))


@query(f"""
    WITH a AS (SELECT item_id, {n("title")} AS t, {n("body")} AS b FROM ({ARTICLES}))
    SELECT item_id, {", ".join(f"3 * {sql_count('t', names)} + {sql_count('b', names)} AS {key}" for key, names in [*geo.OWN.items(), ("elsewhere", lexicon.ELSEWHERE)])} FROM a""")
def province_scores(spark, sf_dir):
    return articles(spark, sf_dir).select("item_id", geo.scores(F.col("title"), F.col("body")).alias("s")).select("item_id", "s.*")


@query(f"""
    WITH a AS (SELECT item_id, {n("title")} AS t FROM ({ARTICLES}))
    SELECT item_id, {sql_any("t", lexicon.ELSEWHERE)} AND NOT {sql_any("t", geo.OWN_ALL)} AS elsewhere,
           CASE {" ".join(f"WHEN {sql_any('t', geo.OWN[k])} THEN '{k}'" for k in geo.KEYS)} END AS province FROM a""")
def place_of_title(spark, sf_dir):
    score = geo.scores(F.col("title"), F.lit(""))
    return articles(spark, sf_dir).select("item_id", geo.title_elsewhere(F.col("title")).alias("elsewhere"), geo.detect_province(score).alias("province"))


@query(f"""
    WITH s AS (SELECT doc_id, text, list_filter(list_transform(string_split(regexp_replace(regexp_replace(text, '([.!?])\\s+', '\\1' || chr(1), 'g'), '\\n+', chr(1), 'g'), chr(1)),
                      lambda x: trim(x, ' ' || chr(9) || chr(10) || chr(13))), lambda x: length(x) >= 40) AS long FROM documents)
    SELECT doc_id, substring(coalesce(long[1], trim(text, ' ' || chr(9) || chr(10) || chr(13))), 1, 220) AS summary,
           length(trim(text)) >= 30 AND NOT regexp_matches(text, '(?i)[{lexicon.VIETNAMESE_LETTERS}]') AS foreign_text FROM s""")
def summaries(spark, sf_dir):
    return _table(spark, sf_dir, "documents").select("doc_id", text.make_summary(F.col("text")).alias("summary"), text.not_vietnamese(F.col("text")).alias("foreign_text"))


@query("""
    WITH t AS (SELECT doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS t FROM documents),
    c AS (SELECT doc_id, CASE WHEN regexp_matches(t, '\\s[-|–—]\\s') AND length(t) > 40 THEN regexp_replace(t, '\\s+[-|–—]\\s+[^-|–—]{2,40}$', '') ELSE t END AS t FROM t)
    SELECT doc_id, substring(trim(regexp_replace(t, '(?i)^(ảnh|video|clip|infographic|trực tiếp|photo)\\s*[:\\-]\\s*', ''), ' "''“”'), 1, 160) AS title FROM c""")
def clean_titles(spark, sf_dir):
    return _table(spark, sf_dir, "documents").select("doc_id", text.clean_title(F.col("text")).alias("title"))


@query(f"""
    SELECT item_id, published AS start_date, published AS end_date, lpad(CAST(expected_hour AS VARCHAR), 2, '0') || ':30' AS start_time,
           CASE WHEN expected_crowd BETWEEN 100 AND 3000000 THEN expected_crowd END AS crowd, expected_fireworks AS fireworks, 'Quảng trường Sao Mai' AS venue
    FROM ({ARTICLES})""")
def event_facts(spark, sf_dir):
    rows = articles(spark, sf_dir)
    span = dates.choose_date(dates.find_dates(F.col("body"), F.col("published")), F.col("published"))
    told = rows.select("item_id", span.alias("s"), "body")
    body = F.col("body")
    return told.select("item_id", F.col("s.start").alias("start_date"), F.col("s.end").alias("end_date"), dates.find_time(body).alias("start_time"), facts.find_crowd(body).alias("crowd"), facts.has_fireworks(body).alias("fireworks"), facts.find_venue(body).alias("venue"))


@query(f"""
    WITH {SQL_EVENTS} SELECT id, priority, {SQL_LARGE} AS large, {sql_any("n", lexicon.TRADITIONAL)} AS traditional, search_text FROM p""")
def event_priority(spark, sf_dir):
    return events(spark, sf_dir).select("id", "priority", catalogue.large().alias("large"), facts.is_traditional(F.col("name"), F.col("venue")).alias("traditional"), "search_text")


@query(f"""
    SELECT id, CASE WHEN start_date IS NULL THEN 'chưa rõ ngày' WHEN start_date = end_date THEN day(start_date) || '/' || month(start_date)
        WHEN date_trunc('month', start_date) = date_trunc('month', end_date) THEN day(start_date) || '–' || day(end_date) || '/' || month(start_date)
        ELSE day(start_date) || '/' || month(start_date) || '–' || day(end_date) || '/' || month(end_date) END AS label FROM ({EVENTS})""")
def date_labels(spark, sf_dir):
    return view(spark, sf_dir, EVENTS).select("id", render.date_range(F.col("start_date"), F.col("end_date")).alias("label"))


@query("""
    SELECT o_orderkey, CAST(date_trunc('month', o_orderdate) AS DATE) AS month_start, last_day(CAST(o_orderdate AS DATE)) AS month_end,
           CAST(o_orderdate AS DATE) AS week_start, CAST(o_orderdate AS DATE) + 6 AS week_end FROM orders""")
def period_ranges(spark, sf_dir):
    rows = _table(spark, sf_dir, "orders").withColumn("d", F.col("o_orderdate").cast("date"))
    month, week = dates.period_range(F.lit("month"), F.col("d")), dates.period_range(F.lit("week"), F.col("d"))
    return rows.select("o_orderkey", month["start"].alias("month_start"), month["end"].alias("month_end"), week["start"].alias("week_start"), week["end"].alias("week_end"))


@query(f"""
    WITH a AS (SELECT *, {n("title")} AS t FROM ({ARTICLES}))
    SELECT item_id, coalesce(CASE {" ".join(f"WHEN {sql_any('t', geo.OWN[k])} THEN '{k}'" for k in geo.KEYS)} END, CASE WHEN trust_hint THEN province_hint END) AS found_province,
        CASE WHEN {sql_any("t", lexicon.NEGATIVE)} THEN 'skip' WHEN {sql_any("t", ("ha noi", "da nang"))} THEN 'out_of_scope'
             WHEN title LIKE 'Khai mạc%' THEN 'not_event' WHEN published < {D} - 3 THEN 'past' ELSE 'accept' END AS status FROM a""")
def classify_articles(spark, sf_dir):
    done = classify.classified(articles(spark, sf_dir), today())
    return done.select("item_id", F.col("province").alias("found_province"), "status")


@query()
def event_names(spark, sf_dir):
    from festa.functions.names import event_name_of

    return articles(spark, sf_dir).select("item_id", event_name_of(F.col("title"), F.col("body")).alias("name"))


@query()
def message_parts(spark, sf_dir):
    parts = _table(spark, sf_dir, "documents").select("doc_id", F.posexplode(text.split_message(F.col("text"))).alias("part", "message"))
    return parts.select("doc_id", "part", F.char_length("message").alias("n"), F.md5(F.col("message").cast("binary")).alias("message_md5"))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def json_salvage(spark, sf_dir):
    found = F.regexp_extract(F.concat(F.lit("Here: "), F.col("props"), F.lit(" done.")), r"(?s)\{.*\}", 0)
    return _table(spark, sf_dir, "events").select("event_id", F.from_json(found, "k bigint")["k"].alias("k"))


# the catalogue


@query(f"WITH {SQL_EVENTS} SELECT id, name, province, start_date, end_date, priority FROM p WHERE start_date <= {D} + 6 AND {LAST} >= {D}")
def events_between(spark, sf_dir):
    return catalogue.events_between(events(spark, sf_dir), today(), F.date_add(today(), 6)).select("id", "name", "province", "start_date", "end_date", "priority")


@query(f"""
    WITH {SQL_EVENTS} SELECT id, name, start_date FROM p
    WHERE contains(search_text, 'khu12') AND start_date <= {D} + 90 AND {LAST} >= {D} ORDER BY start_date, id LIMIT 15""")
def search_events(spark, sf_dir):
    return catalogue.search(events(spark, sf_dir), "Khu12", today()).select("id", "name", "start_date")


@query(f"WITH {SQL_EVENTS} SELECT id, name, start_date FROM p WHERE NOT alerted AND start_date <= {D} + 60 AND {LAST} >= {D} AND {SQL_LARGE}")
def unalerted_large(spark, sf_dir):
    return catalogue.unalerted_large(events(spark, sf_dir), today()).select("id", "name", "start_date")


@query(f"""
    SELECT id, start_date FROM ({EVENTS})
    WHERE (start_date IS NULL OR venue = '') AND coalesce({LAST} >= {D}, true) AND coalesce(start_date <= {D} + 60, true)""")
def pending_events(spark, sf_dir):
    return catalogue.pending(events(spark, sf_dir), today()).select("id", "start_date")


@query(f"SELECT id, start_date FROM ({EVENTS}) WHERE coalesce({LAST} >= {D}, true)")
def current_events(spark, sf_dir):
    return catalogue.current(events(spark, sf_dir), today()).select("id", "start_date")


@query(f"""
    SELECT province, id, rank FROM (SELECT province, id, row_number() OVER (PARTITION BY province ORDER BY id) AS rank FROM ({EVENTS}) WHERE start_date IS NULL) WHERE rank <= 15""")
def undated_by_province(spark, sf_dir):
    return catalogue.undated_by_province(view(spark, sf_dir, EVENTS)).select("province", "id", "rank")


@query(f"SELECT count(*) AS events, count(*) FILTER (WHERE {SQL_LARGE}) AS large FROM ({EVENTS}) WHERE start_date <= {D} + 6 AND {LAST} >= {D}")
def digest_counts(spark, sf_dir):
    return catalogue.digest_counts(catalogue.events_between(events(spark, sf_dir), today(), F.date_add(today(), 6)))


@query()
def daily_digest(spark, sf_dir):
    week = catalogue.events_between(events(spark, sf_dir), today(), F.date_add(today(), 6))
    return render.digest(week, today(), 7).select(F.posexplode(text.split_message(F.col("text"))).alias("part", "message"))


@query()
def large_alerts(spark, sf_dir):
    return render.alerts(catalogue.unalerted_large(events(spark, sf_dir), today()))


@query()
def week_report(spark, sf_dir):
    rows = render.report_rows(catalogue.events_between(events(spark, sf_dir), today(), F.date_add(today(), 6)))
    return rows.toDF("from_date", "to_date", "time", "province", "name", "venue", "crowd", "fireworks", "concert", "priority", "summary", "source")


@query(f"SELECT id, first_seen FROM ({EVENTS}) WHERE NOT (coalesce({LAST}, first_seen) < {D} - 90) AND NOT (start_date IS NULL AND first_seen < {D} - 30)")
def retained_events(spark, sf_dir):
    return catalogue.retained_events(view(spark, sf_dir, EVENTS), today()).select("id", "first_seen")


@query(f"SELECT status, count(*) AS n FROM ({LEDGER}) GROUP BY status")
def status_histogram(spark, sf_dir):
    return catalogue.status_counts(view(spark, sf_dir, LEDGER))


@query(f"SELECT link, status, seen_at, event_id FROM (SELECT *, row_number() OVER (PARTITION BY link ORDER BY seen_at DESC, event_id DESC) AS r FROM ({LEDGER})) WHERE r = 1")
def ledger_latest(spark, sf_dir):
    return catalogue.latest(view(spark, sf_dir, LEDGER), "link", F.col("seen_at"), F.col("event_id")).select("link", "status", "seen_at", "event_id")


@query(f"SELECT item_id, link FROM ({ARTICLES}) WHERE link NOT IN (SELECT link FROM ({LEDGER}))")
def unseen_items(spark, sf_dir):
    return catalogue.unseen(articles(spark, sf_dir), view(spark, sf_dir, LEDGER)).select("item_id", "link")


@query(f"""
    WITH r AS ({RUNS}), l AS (SELECT source_id, max(seq) FILTER (WHERE ok) AS last_seq, count(*) AS runs FROM r GROUP BY 1)
    SELECT l.source_id, count(*) FILTER (WHERE NOT ok AND (last_seq IS NULL OR seq > last_seq)) AS fails, max(run_at) FILTER (WHERE ok AND seq = last_seq) AS last_ok, any_value(runs) AS runs
    FROM r JOIN l USING (source_id) GROUP BY 1""")
def source_health(spark, sf_dir):
    return catalogue.fail_streaks(view(spark, sf_dir, RUNS))


@query("""
    SELECT chat_id, min(kind) AS kind FROM (
        SELECT 'c' || CAST(c_custkey AS VARCHAR) AS chat_id, 0 AS kind FROM customer WHERE c_acctbal > 9000
        UNION ALL SELECT 'c' || CAST(o_custkey AS VARCHAR), 1 FROM orders) GROUP BY chat_id""")
def message_recipients(spark, sf_dir):
    configured = _table(spark, sf_dir, "customer").filter("c_acctbal > 9000").select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("chat_id"))
    subscribers = _table(spark, sf_dir, "orders").select(F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("chat_id"), F.col("o_orderdate").alias("joined_at"))
    return catalogue.recipients(configured, subscribers).select("chat_id", "kind")


@query(f"SELECT id, name FROM ({EVENTS}) WHERE NOT alerted")
def deleted_events(spark, sf_dir):
    rows = view(spark, sf_dir, EVENTS)
    return catalogue.deleted(rows, rows.filter("alerted")).select("id", "name")


@query(f"SELECT id, alerted OR {SQL_LARGE} AS alerted FROM ({EVENTS})")
def alerted_events(spark, sf_dir):
    rows = view(spark, sf_dir, EVENTS)
    return catalogue.mark_alerted(rows, rows.filter(catalogue.large())).select("id", "alerted")


@query(f"SELECT id, CASE WHEN fireworks THEN upper(name) ELSE name END AS name, alerted FROM ({EVENTS})")
def upserted_events(spark, sf_dir):
    rows = view(spark, sf_dir, EVENTS)
    return catalogue.upserted(rows, rows.filter("fireworks").withColumn("name", F.upper("name"))).select("id", "name", "alerted")


@query(f"SELECT id, CASE WHEN big_concert THEN upper(name) ELSE name END AS name, CASE WHEN big_concert THEN NULL ELSE crowd END AS crowd, province, alerted, first_seen FROM ({EVENTS})")
def updated_events(spark, sf_dir):
    rows = view(spark, sf_dir, EVENTS)
    new = rows.filter("big_concert").withColumns({"name": F.upper("name"), "crowd": F.lit(None).cast("int"), "province": F.lit("hcm"), "alerted": F.lit(False), "first_seen": today()})
    return catalogue.updated(rows, new).select("id", "name", "crowd", "province", "alerted", "first_seen")


@query("""
    WITH o AS (SELECT 'c' || CAST(o_custkey AS VARCHAR) AS chat_id, CAST(o_orderdate AS DATE) AS d, o_orderstatus = 'F' AS old FROM orders)
    SELECT chat_id, coalesce(min(d) FILTER (WHERE old), min(d)) AS joined_at, CASE WHEN count(*) FILTER (WHERE old) > 0 THEN 'old' ELSE repeat('x', 60) END AS name FROM o GROUP BY 1""")
def subscribers_added(spark, sf_dir):
    rows = _table(spark, sf_dir, "orders").select(F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("chat_id"), F.col("o_orderdate").cast("date").alias("joined_at"), F.col("o_orderstatus") == "F")
    rows = rows.toDF("chat_id", "joined_at", "old")
    first = rows.filter("old").groupBy("chat_id").agg(F.min("joined_at").alias("joined_at")).withColumn("name", F.lit("old"))
    return catalogue.subscribed(first, rows.filter("not old").withColumn("name", F.lit("x" * 70))).select("chat_id", "joined_at", "name")


@query(f"SELECT link, status, event_id FROM ({LEDGER}) WHERE seen_at >= {D} - 90")
def retained_links(spark, sf_dir):
    return catalogue.retained_articles(view(spark, sf_dir, LEDGER), today()).select("link", "status", "event_id")


@query(f"""
    WITH r AS ({RUNS}), l AS (SELECT source_id, max(seq) FILTER (WHERE ok) AS last_seq FROM r GROUP BY 1)
    SELECT source_id, count(*) AS fails FROM r JOIN l USING (source_id) WHERE NOT ok AND (last_seq IS NULL OR seq > last_seq) GROUP BY 1 HAVING count(*) >= 1""")
def failing_sources(spark, sf_dir):
    return catalogue.to_notify(catalogue.fail_streaks(view(spark, sf_dir, RUNS)), threshold=1).select("source_id", "fails")


@query(f"SELECT item_id, link FROM ({ARTICLES}) ORDER BY published DESC, link LIMIT 50")
def admitted_items(spark, sf_dir):
    return schedule.admitted(articles(spark, sf_dir), 50).select("item_id", "link")


@query(f"""
    WITH e AS (SELECT {n("name")} AS k, id FROM ({EVENTS})), l AS (SELECT k, max(id) AS id FROM e GROUP BY 1)
    SELECT e.id AS asked_id, l.id FROM e JOIN l USING (k)""")
def named_replies(spark, sf_dir):
    rows = view(spark, sf_dir, EVENTS)
    return catalogue.named(rows.select(F.col("id").alias("asked_id"), F.upper("name").alias("name")), rows).select("asked_id", "id")


@query("SELECT event_id, 'Hội ' || CAST(json_extract(props, '$.k') AS VARCHAR) AS name, CAST(ts AS DATE) AS start_date, CASE WHEN CAST(json_extract(props, '$.k') AS INT) > 0 THEN CAST(json_extract(props, '$.k') AS INT) END AS crowd FROM events")
def model_replies(spark, sf_dir):
    k, day = F.regexp_extract("props", r"(\d+)", 1), F.col("ts").cast("date").cast("string")
    reply = F.concat(F.lit('Here is the list: [{"name": " Hội '), k, F.lit('", "crowd": "'), k, F.lit('", "start_date": "'), day, F.lit('"}] Done.'))
    return enrich.reply_rows(_table(spark, sf_dir, "events").select("event_id", reply.alias("reply"))).select("event_id", "name", "start_date", "crowd")


# chats

UPDATES = """
SELECT event_id AS update_id, 'c' || CAST(user_id AS STRING) AS chat_id, CASE WHEN event_id % 2 = 0 THEN '' ELSE 'Nhóm ' || CAST(event_id AS STRING) END AS title,
       CAST(NULL AS STRING) AS username, event_type AS first_name,
       CASE event_id % 7 WHEN 0 THEN '/start' WHEN 1 THEN '/start MA1' WHEN 2 THEN '/stop' WHEN 3 THEN '/id' WHEN 4 THEN '/excel thang' WHEN 5 THEN '/excel' ELSE '/homnay' END AS text
FROM events
"""


@query(f"""
    WITH k AS (SELECT 'c' || CAST(c_custkey AS VARCHAR) AS chat_id FROM customer WHERE c_acctbal > 0),
    u AS (SELECT *, chat_id IN (SELECT chat_id FROM k) AS known FROM ({UPDATES}))
    SELECT update_id, CASE update_id % 7 WHEN 0 THEN CASE WHEN known THEN 'join' ELSE 'refuse' END WHEN 1 THEN 'join' WHEN 2 THEN 'leave' WHEN 3 THEN 'id' WHEN 4 THEN 'month' WHEN 5 THEN 'week' END AS action,
           update_id % 7 = 1 OR (update_id % 7 = 0 AND known) AS joins FROM u""")
def chat_actions(spark, sf_dir):
    known = _table(spark, sf_dir, "customer").filter("c_acctbal > 0").select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("chat_id"))
    done = serve.acted(view(spark, sf_dir, UPDATES), known, "MA1")
    return done.select("update_id", "action", F.coalesce(F.startswith("reply", F.lit("Đã đăng ký.")), F.lit(False)).alias("joins"))


@query(f"SELECT chat_id, arg_max(CASE WHEN title <> '' THEN title ELSE first_name END, update_id) AS name FROM ({UPDATES}) GROUP BY 1")
def chat_names(spark, sf_dir):
    return serve.chats(view(spark, sf_dir, UPDATES))


# entity resolution

SQL_TOKENS = f"""
    t AS (SELECT *, list_distinct(list_filter(string_split({n("name")}, ' '), lambda t: t <> '' AND NOT list_contains({quoted(lexicon.COMMON)}, t) AND NOT regexp_full_match(t, '[0-9]+'))) AS tokens
          FROM ({EVENTS}))"""


@query(f"""
    WITH {SQL_TOKENS}, pairs AS (
        SELECT a.id AS a_id, b.id AS b_id, len(list_intersect(a.tokens, b.tokens)) AS shared, len(a.tokens) AS sa, len(b.tokens) AS sb,
               a.start_date IS NOT NULL AND b.start_date IS NOT NULL AS dated
        FROM t a JOIN t b ON a.province = b.province AND a.id < b.id AND (a.start_date IS NULL OR b.start_date IS NULL OR
             (greatest(a.start_date, b.start_date) - least(a.end_date, b.end_date)) <= 3))
    SELECT a_id, b_id, shared FROM pairs
    WHERE shared > 0 AND (shared / (sa + sb - shared) >= CASE WHEN dated THEN 0.34 ELSE 0.4 END OR (shared / least(sa, sb) >= 0.6 AND shared >= 3))""")
def duplicate_pairs(spark, sf_dir):
    return resolve.duplicate_pairs(spread(view(spark, sf_dir, EVENTS), _table(spark, sf_dir, "orders"), "id"))


@query(f"""
    WITH e AS ({EVENTS}), q AS (
        SELECT a.id, a.name AS an, b.name AS bn, a.start_date AS s1, a.end_date AS e1, b.start_date AS s2, b.end_date AS e2, a.crowd AS c1, b.crowd AS c2, a.venue AS v1, b.venue AS v2,
               a.fireworks OR b.fireworks AS fireworks, greatest(a.start_date, b.start_date) - least(a.end_date, b.end_date) AS gap
        FROM e a JOIN e b ON b.id = a.id + 1),
    r AS (SELECT *, CASE WHEN s1 IS NULL AND s2 IS NOT NULL THEN 'take' WHEN s1 IS NULL OR s2 IS NULL THEN 'keep' WHEN s1 = s2 AND e2 > e1 THEN 'extend' WHEN s1 = s2 AND e1 = e2 THEN 'keep'
                 WHEN gap <= 1 THEN 'join' WHEN e2 - s2 > e1 - s1 THEN 'take' ELSE 'keep' END AS rule FROM q)
    SELECT id, CASE WHEN length(bn) > length(an) + 15 AND length(bn) <= 120 THEN bn ELSE an END AS name, CASE WHEN v1 = '' THEN v2 ELSE v1 END AS venue,
           CASE rule WHEN 'take' THEN s2 WHEN 'join' THEN least(s1, s2) ELSE s1 END AS start_date,
           CASE rule WHEN 'take' THEN e2 WHEN 'extend' THEN e2 WHEN 'join' THEN greatest(e1, e2) ELSE e1 END AS end_date,
           CASE WHEN coalesce(c2, 0) > coalesce(c1, 0) THEN c2 ELSE c1 END AS crowd, fireworks FROM r""")
def merge_pairs(spark, sf_dir):
    e = view(spark, sf_dir, EVENTS).withColumn("sources", F.array("source"))
    old = e.select(F.struct(*e.columns).alias("old"), (F.col("id") + 1).alias("k"))
    new = e.select(F.struct(*e.columns).alias("new"), F.col("id").alias("k"))
    return old.join(new, "k").select(resolve.merged("old", "new").alias("m")).select(*[f"m.{c}" for c in ("id", "name", "venue", "start_date", "end_date", "crowd", "fireworks")])


@query()
def resolved_events(spark, sf_dir):
    reports = _reports(spark, sf_dir)
    return resolve.resolve(reports.select(*resolve.FIELDS))


# pages

_A = "(?is)(<a\\s[^>]*href=.*?</a>)"


#: The references that the pages hold; the engine knows all of HTML 4.
_REFERENCES = {"&nbsp;": " ", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&copy;": "©", "&middot;": "·", "&amp;": "&"}


def sql_plain(x: str) -> str:
    out = f"regexp_replace({x}, '<[^>]*>', ' ', 'g')"
    for reference, sign in _REFERENCES.items():
        out = f"replace({out}, '{reference}', '{sign.replace(chr(39), chr(39) * 2)}')"
    return f"trim(regexp_replace({out}, '\\s+', ' ', 'g'))"


@query(f"""
    WITH a AS (SELECT page_id, unnest(regexp_extract_all(html, '{_A}', 1)) AS a, generate_subscripts(regexp_extract_all(html, '{_A}', 1), 1) - 1 AS pos FROM pages)
    SELECT page_id, pos, regexp_extract(a, '(?is)^<a\\s[^>]*?href=["'']?([^"''>\\s]*)', 1) AS href, {sql_plain("regexp_extract(a, '(?is)^<a\\s[^>]*>(.*)</a>$', 1)")} AS title FROM a""")
def page_links(spark, sf_dir):
    return html.anchors(_table(spark, sf_dir, "pages")).select("page_id", "pos", "href", "title")


@query(f"""
    SELECT page_id, regexp_replace(lower(regexp_extract(url, '^[a-z]+://([^/?#:]+)', 1)), '^www\\.', '') AS host,
           {sql_plain("regexp_extract(html, '(?is)<h1[^>]*>(.*?)</h1>', 1)")} AS title FROM pages""")
def page_titles(spark, sf_dir):
    return _table(spark, sf_dir, "pages").select("page_id", html.host(F.col("url")).alias("host"), html.page_title(F.col("html")).alias("title"))


@query()
def page_texts(spark, sf_dir):
    return _table(spark, sf_dir, "pages").select("page_id", html.article_text(F.col("html")).alias("text"))


# feeds and links


@query(f"SELECT link, title, published FROM ({ARTICLES}) WHERE published >= {D} - 45")
def feed_items(spark, sf_dir):
    a = articles(spark, sf_dir)
    parts = ["<rss><channel><item><title>", "title", "</title><link>", "link", "</link><pubDate>", "published", "</pubDate></item></channel></rss>"]
    content = F.concat(*[F.lit(x) if x.startswith("<") else F.col(x).cast("string") for x in parts])
    documents = a.select(F.col("item_id").cast("string").alias("source_id"), content.alias("content"), F.lit(False).alias("is_search"))
    return feeds.feed_items(documents, today()).filter("error is null").select("link", "title", "published")


@query(f"SELECT item_id, link, false AS online FROM ({ARTICLES})")
def news_links(spark, sf_dir):
    wrapped = F.when(F.col("item_id") % 2 == 0, F.concat(F.lit("https://news.google.com/r?oc=5&url="), F.url_encode("link"))).otherwise(F.col("link"))
    return articles(spark, sf_dir).select("item_id", html.news_link(wrapped).alias("n")).select("item_id", "n.link", "n.online")


@query(f"""
    SELECT id, status FROM (SELECT id, CASE WHEN start_date IS NULL OR {sql_any(n("name"), lexicon.NEGATIVE)} THEN 'not_event'
        WHEN {sql_any(n("summary"), ("ha noi", "da nang"))} THEN 'out_of_scope' WHEN end_date < {D} - 3 THEN 'past' WHEN start_date > {D} + 75 THEN 'far' ELSE 'accept' END AS status FROM ({EVENTS}))""")
def judged_events(spark, sf_dir):
    return enrich.judged(view(spark, sf_dir, EVENTS), today()).select("id", "status")


# streams


def _folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"


def _streamed(spark: SparkSession, batch: DataFrame, folder: str, name: str, files: int = 2) -> DataFrame:
    """A batch as a file stream: a stand-in for a feed."""
    batch.repartition(files).write.parquet(f"{folder}/{name}/in")
    return spark.readStream.schema(batch.schema).parquet(f"{folder}/{name}/in")


@query(f"SELECT DISTINCT link FROM ({LEDGER})")
def stream_seen_once(spark, sf_dir):
    folder = _folder(spark)
    stream = _streamed(spark, view(spark, sf_dir, LEDGER).withColumn("ingest_ts", F.col("seen_at").cast("timestamp")), folder, "items")
    return ingest.drained(ingest.seen_once(stream), folder, "seen").select("link")


@query(f"""
    WITH r AS ({RUNS}), k AS (SELECT *, count(*) FILTER (WHERE ok) OVER (PARTITION BY source_id ORDER BY seq) AS streak FROM r),
    f AS (SELECT *, count(*) FILTER (WHERE NOT ok) OVER (PARTITION BY source_id, streak ORDER BY seq) AS nth, count(*) FILTER (WHERE NOT ok) OVER (PARTITION BY source_id, streak) AS size FROM k),
    g AS (SELECT *, lag(size) OVER (PARTITION BY source_id ORDER BY seq) AS before FROM f)
    SELECT source_id, seq, 'failing' AS notice, 3 AS fails FROM g WHERE NOT ok AND nth = 3
    UNION ALL SELECT source_id, seq, 'recovered', 0 FROM g WHERE ok AND before >= 3""")
def stream_source_notices(spark, sf_dir):
    folder = _folder(spark)
    stream = _streamed(spark, view(spark, sf_dir, RUNS).select("source_id", "seq", "ok", "error"), folder, "runs")
    return ingest.drained(ingest.source_notices(stream), folder, "notices").select("source_id", "seq", "notice", "fails")


@query()
def stream_resolved(spark, sf_dir):
    """The stored events after a stream of reports."""
    folder = _folder(spark)
    reports = _reports(spark, sf_dir)
    stream = _streamed(spark, reports.select(*resolve.FIELDS).withColumn("today", F.lit(None).cast("date")), folder, "reports")
    ingest.resolve_into(stream, f"{folder}/events", f"{folder}/resolve").awaitTermination()
    return stored.events_at(spark, f"{folder}/events").read().select(*resolve.FIELDS)


# what is kept on disk

_DUE = f"SELECT id FROM ({EVENTS}) WHERE NOT alerted AND start_date <= DATE '{TODAY}' + 60 AND coalesce(end_date, start_date) >= DATE '{TODAY}' AND (crowd >= 10000 OR fireworks OR big_concert)"


def _kept(spark: SparkSession, sf_dir: str, folder: str):
    """The events as a stored table, with its rows as a view."""
    table = stored.events_at(spark, f"{folder}/events")
    rows = events(spark, sf_dir).withColumns({"first_seen": F.col("first_seen").cast("timestamp"), "updated_at": F.col("first_seen").cast("timestamp")})
    table.change(rows)
    return table


@query(f"""
    SELECT id, name, province, CASE WHEN id % 3 = 0 THEN 'Nhà hát' ELSE venue END AS venue, CASE WHEN id % 3 = 0 THEN 7 ELSE crowd END AS crowd, alerted, CAST(first_seen AS DATE) AS first_day,
           CASE WHEN id % 3 = 0 THEN DATE '{TODAY}' ELSE CAST(first_seen AS DATE) END AS updated_day
    FROM ({EVENTS}) WHERE id % 7 <> 0""")
def stored_catalogue(spark, sf_dir):
    """Events inserted into a table on disk, a third of them updated, a seventh deleted, and read again."""
    table = _kept(spark, sf_dir, _folder(spark))
    rows = table.read(1)
    change = rows.filter("id % 3 = 0").withColumns({"venue": F.lit("Nhà hát"), "crowd": F.lit(7), "province": F.lit("nowhere"), "alerted": F.lit(True)})
    stored.update(table, change, today().cast("timestamp"))
    stored.delete(table, rows.filter("id % 7 = 0"))
    return table.read().select("id", "name", "province", "venue", "crowd", "alerted", F.to_date("first_seen").alias("first_day"), F.to_date("updated_at").alias("updated_day"))


@query(f"SELECT id AS event_id, CAST(1 AS BIGINT) AS sends, true AS alerted FROM ({_DUE})")
def alerts_once(spark, sf_dir):
    """How often each large event was alerted, after a sender that delivers in part, one that delivers all, and repeats of both batches."""
    folder = _folder(spark)
    table, outbox = _kept(spark, sf_dir, folder), alerts.outbox_at(spark, f"{folder}/outbox")

    def sender(part):
        def send(messages):
            messages.filter(part).select("event_id").write.mode("append").parquet(f"{folder}/sent")
            return messages.filter(part)

        return send

    odd, all_ = F.col("event_id") % 2 == 1, F.lit(True)
    for batch, part in ((1, odd), (1, odd), (2, all_), (2, all_), (3, all_)):
        alerts.deliver(table, outbox, sender(part), today(), batch)
    sends = spark.read.schema("event_id bigint").parquet(f"{folder}/sent").groupBy("event_id").agg(F.count(F.lit(1)).alias("sends"))
    return sends.join(table.read().select(F.col("id").alias("event_id"), "alerted"), "event_id")


_STATUS = "CASE WHEN status = 'error' THEN 'no_body' WHEN status = 'view' THEN 'title_only' ELSE status END"


@query(f"""
    WITH RECURSIVE l AS (
        SELECT *, row_number() OVER (PARTITION BY link ORDER BY "at", status) AS n, "at" + CASE WHEN status IN ('no_body', 'title_only') THEN INTERVAL 6 HOUR ELSE INTERVAL 90 DAY END AS until
        FROM (SELECT link, {_STATUS} AS status, seen_at AS "at" FROM ({LEDGER}))),
    r AS (SELECT link, n, until FROM l WHERE n = 1
          UNION ALL SELECT link, n, until FROM (
              SELECT l.link, l.n, l.until, row_number() OVER (PARTITION BY l.link ORDER BY l.n) AS k FROM r JOIN l ON l.link = r.link AND l.n > r.n AND l."at" >= r.until) WHERE k = 1)
    SELECT l.link, l.status, l."at" FROM r JOIN l USING (link, n)""")
def stream_ledger(spark, sf_dir):
    """Items whose link no live entry holds: entries of articles that could not be read free their link after six hours, others after 90 days."""
    folder = _folder(spark)
    items = view(spark, sf_dir, LEDGER).selectExpr("link", f"{_STATUS} AS status", "seen_at AS at")
    return ingest.drained(ingest.admitted_once(_streamed(spark, items, folder, "items")), folder, "ledger")


@query()
def deduplicated_events(spark, sf_dir):
    """Stored events after names and dates are cleaned and those of one event are merged."""
    rows = _reports(spark, sf_dir)
    return resolve.deduplicated(rows.select(*resolve.FIELDS))


@query(f"SELECT link, status FROM (SELECT link, {_STATUS} AS status, row_number() OVER (PARTITION BY link ORDER BY seen_at DESC, event_id DESC) AS n FROM ({LEDGER})) WHERE n = 1 AND status NOT IN ('not_event', 'title_only', 'no_body')")
def backfilled_ledger(spark, sf_dir):
    """The stored ledger after its one-shot jobs ran twice: the second time none is left to do."""
    table = stored.ledger_at(spark, f"{_folder(spark)}/ledger")
    rows = catalogue.latest(view(spark, sf_dir, LEDGER), "link", F.col("seen_at"), F.col("event_id"))
    table.change(rows.select("link", F.lit("").alias("source"), F.lit("").alias("title"), "seen_at", F.expr(_STATUS).alias("status")))
    for _ in range(2):
        backfills.apply(table, backfills.MODEL_JOBS)
    return table.read().select("link", "status")


@query(f"SELECT status, count(*) AS n FROM ({ORACLE_SQL['classify_articles']}) GROUP BY status")
def run_statistics(spark, sf_dir):
    """Articles by what the cascade makes of them, counted in the pass that writes them."""
    folder = _folder(spark)
    counts = stats.written(classify.classified(articles(spark, sf_dir), today()), lambda rows: rows.write.parquet(f"{folder}/classified"))
    return spark.createDataFrame([(k, n) for k, n in counts.items() if n and k != "all"], "status string, n bigint")


@query("SELECT doc_id, CAST(length(coalesce(text, '')) AS BIGINT) AS n_chars, sha256(coalesce(text, '')) AS text_sha256 FROM documents")
def decoded_documents(spark, sf_dir):
    """Every document as a server might send it (UTF-8, UTF-16 with a mark, Latin-1 under a vague name where it has all signs, UTF-8 by name), read back."""
    text = F.coalesce("text", F.lit(""))
    western = text.rlike(r"^[\x00-\x7F\xA0-\xFF]*\z")
    kind = F.coalesce(F.pmod("doc_id", F.lit(4)), F.lit(0))
    content = F.when(kind == 1, F.concat(F.unhex(F.lit("FFFE")), F.encode(text, "UTF-16LE"))).when((kind == 2) & western, F.encode(text, "ISO-8859-1")).otherwise(F.encode(text, "UTF-8"))
    told = F.when((kind == 2) & western, "text/html; charset=ISO-8859-1").when(kind == 3, "text/html; charset=\"UTF8\"")
    sent = spread(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "documents")).select("doc_id", content.alias("content"), told.alias("content_type"))
    read = sent.select("doc_id", decode.decoded(F.col("content"), F.col("content_type")).alias("d"))
    return read.select("doc_id", F.char_length("d.text").cast("bigint").alias("n_chars"), F.sha2(F.col("d.text").cast("binary"), 256).alias("text_sha256"))


@query("""
    WITH n AS (SELECT page_id, regexp_extract_all(regexp_extract(html, '(?s)<nav>(.*?)</nav>', 1), '(?s)<li><a href="/[^"]*">(.*?)</a></li>', 1) AS a FROM pages)
    SELECT page_id, unnest(a) AS title, CAST(generate_subscripts(a, 1) AS BIGINT) AS n FROM n""")
def selected_links(spark, sf_dir):
    """Links of the menus, found by a selector."""
    found = selectors.selected(_table(spark, sf_dir, "pages"), 'nav > ul > li > a[href^="/"]')
    number = F.row_number().over(Window.partitionBy("page_id").orderBy("pos")).cast("bigint")
    return found.select("page_id", F.regexp_extract("outer", "(?s)^<a[^>]*>(.*)</a>$", 1).alias("title"), number.alias("n"))


_ENTRY = ("<item><title>", "title", "</title><link>", "link", "</link><source url=\"https://www.bao.example/\">B</source><pubDate>", "published", "</pubDate></item>")


def _keyed(spark: SparkSession, sf_dir: str, key) -> DataFrame:
    """Articles with ``key``, dealt by it into parts of bounded rows, so that a task has few documents at once."""
    return spread(view(spark, sf_dir, ARTICLES).withColumn("key", key.cast("string")), _table(spark, sf_dir, "orders"), "key")


def _entries(rows: DataFrame, key: str) -> DataFrame:
    """Feed documents (source_id, content) of the rows of a key, in the order of their ids."""
    entry = F.concat(*[F.lit(x) if x.startswith("<") else F.col(x).cast("string") for x in _ENTRY])
    items = F.array_sort(F.collect_list(F.struct("item_id", entry.alias("entry"))))
    content = F.concat(F.lit("<rss><channel>"), F.array_join(F.transform(items, lambda x: x["entry"]), ""), F.lit("</channel></rss>"))
    return rows.groupBy(F.col(key).alias("source_id")).agg(content.alias("content"))


@query(f"""
    SELECT source_id, link, publisher FROM (SELECT CAST(item_id // 128 AS VARCHAR) AS source_id, link, 'bao.example' AS publisher, row_number() OVER (PARTITION BY item_id // 128 ORDER BY item_id) AS n FROM ({ARTICLES})) WHERE n <= 15""")
def searched_items(spark, sf_dir):
    """The first entries of searches that each answer with the articles of neighbouring ids."""
    documents = _entries(_keyed(spark, sf_dir, F.floor(F.col("item_id") / 128)), "key")
    return feeds.search_items(documents.withColumn("is_search", F.lit(True))).select("source_id", "link", "publisher")


@query(f"""
    WITH a AS (SELECT CAST(item_id // 64 AS VARCHAR) AS source_id, 'https://tin.example/le-hoi/' || CAST(item_id AS VARCHAR) || '.html' AS link, title, published, item_id FROM ({ARTICLES}))
    SELECT source_id, link, title, min(kind) AS kind FROM (SELECT *, 0 AS kind FROM a WHERE published >= {D} - 45 UNION ALL SELECT *, 1 AS kind FROM a WHERE item_id % 3 = 0) GROUP BY ALL""")
def auto_source_items(spark, sf_dir):
    """Items of sources with a feed and pages of links, each link once, of the feed if it has it."""
    rows = _keyed(spark, sf_dir, F.floor(F.col("item_id") / 64)).withColumn("link", F.concat(F.lit("https://tin.example/le-hoi/"), F.col("item_id").cast("string"), F.lit(".html")))
    documents = _entries(rows, "key").select("source_id", F.lit(0).alias("address"), "content", F.lit(False).alias("is_search"))
    anchor = F.concat(F.lit("<p><a href='"), F.expr("substring(link, 20)"), F.lit("'>"), F.col("title"), F.lit("</a></p>"))
    pages = rows.filter("item_id % 3 = 0").select(F.col("item_id").alias("page_id"), F.col("key").alias("source_id"), F.lit(1).alias("address"), F.lit("https://tin.example/").alias("url"), anchor.alias("html"))
    return feeds.auto_items(documents, pages, today()).filter("error is null").select("source_id", "link", "title", "kind")


@query(f"""
    SELECT id FROM (SELECT id, coalesce(sum(CAST(coalesce(crowd, 0) AS BIGINT)) OVER (ORDER BY start_date NULLS FIRST, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, (SELECT sum(CAST(crowd AS BIGINT)) FROM ({EVENTS})) AS everything FROM ({EVENTS}))
    WHERE before < everything // 3 AND everything // 3 - before >= 20000""")
def budgeted_events(spark, sf_dir):
    """Events, by date, that a budget of a third of all visitors covers."""
    rows = view(spark, sf_dir, EVENTS)
    total = rows.agg(F.sum(F.col("crowd").cast("bigint"))).first()[0] or 0
    return schedule.within_budget(rows, F.col("crowd"), total // 3, F.col("start_date"), F.col("id"), reserve=20000).select("id")


@query(f"SELECT id FROM ({EVENTS}) WHERE (start_date, id) <= (SELECT (start_date, id) FROM ({EVENTS}) WHERE start_date >= {D} AND fireworks ORDER BY start_date, id LIMIT 1) OR start_date IS NULL")
def events_until_fresh(spark, sf_dir):
    """Events, by date, up to the first one still to come that has fireworks."""
    return schedule.until(view(spark, sf_dir, EVENTS), (F.col("start_date") >= today()) & F.col("fireworks"), "start_date", "id", inclusive=True).select("id")


@query(f"SELECT id, substring(name || ' | ' || coalesce(CAST(start_date AS VARCHAR), 'None') || '→' || coalesce(CAST(end_date AS VARCHAR), 'None') || ' | ' || venue || ' | ' || summary, 1, 400) AS line FROM ({EVENTS})")
def described_events(spark, sf_dir):
    return view(spark, sf_dir, EVENTS).select("id", catalogue.described().alias("line"))


@query(f"""
    WITH h AS (SELECT source_id, count(*) FILTER (WHERE NOT ok AND seq > coalesce(last_ok, -1)) AS fails, arg_max(error, seq) FILTER (WHERE NOT ok) AS last_error
               FROM (SELECT *, max(seq) FILTER (WHERE ok) OVER (PARTITION BY source_id) AS last_ok FROM ({RUNS})) GROUP BY 1),
    s AS (SELECT status, count(*) AS n FROM ({LEDGER}) GROUP BY 1)
    SELECT 1 AS place, '' AS key, 'Số sự kiện đang lưu: ' || (SELECT count(*) FROM ({EVENTS})) AS line
    UNION ALL SELECT 2, '', 'Số người nhận tin: ' || (SELECT count(DISTINCT c_custkey) FROM customer WHERE c_acctbal > 0)
    UNION ALL SELECT * FROM (VALUES (4, '', 'Lần thu thập gần nhất: {TODAY}'), (5, '', 'Bản tin gần nhất: chưa có'), (7, '', 'AI: chưa có'), (8, '', 'AI tìm sự kiện: chưa có'), (9, '', 'AI tìm sáng (7 ngày tới): chưa có'), (10, '', 'Giải mã link Google News (lượt gần nhất): chưa có'))
    UNION ALL SELECT 6, '', 'Nguồn: ' || count(*) || ' (lỗi: ' || count(*) FILTER (WHERE fails > 0) || ')' FROM h
    UNION ALL SELECT 11, '', 'Bài đã xử lý: ' || string_agg(status || '=' || n, ', ' ORDER BY n DESC, status) FROM s
    UNION ALL SELECT 12, source_id, ' - ' || source_id || ': lỗi ' || fails || ' lần – ' || substring(last_error, 1, 80) FROM h WHERE fails > 0""")
def status_lines(spark, sf_dir):
    """The state of the system, as a command shows it."""
    runs = view(spark, sf_dir, RUNS)
    errors = runs.filter("not ok").groupBy("source_id").agg(F.max_by("error", "seq").alias("last_error"))
    health = catalogue.fail_streaks(runs).join(errors, "source_id", "left").withColumn("name", F.lit(None).cast("string"))
    recipients = _table(spark, sf_dir, "customer").filter("c_acctbal > 0").select(F.col("c_custkey").alias("chat_id"))
    return serve.status(view(spark, sf_dir, EVENTS), recipients, health, view(spark, sf_dir, LEDGER), {"last_collect": TODAY})


@query(f"SELECT update_id, CASE WHEN update_id % 7 = 6 THEN 0 ELSE 1 END AS sends FROM ({UPDATES})")
def replies_once(spark, sf_dir):
    """How often each update was answered, by a stream whose sender delivers in part at first, and that is started again."""
    folder = _folder(spark)
    stream = _streamed(spark, view(spark, sf_dir, UPDATES).select("update_id", "chat_id", "text"), folder, "updates")
    known = _table(spark, sf_dir, "customer").select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("chat_id"))

    def sender(part):
        def send(messages):
            messages.filter(part).select("event_id").write.mode("append").parquet(f"{folder}/sent")
            return messages.filter(part)

        return send

    table = replies.replies_at(spark, f"{folder}/replies")
    replies.replying(stream, f"{folder}/replies", folder, known, sender(F.col("event_id") % 2 == 1), "MA1").awaitTermination()
    for part in (F.lit(True), F.lit(True)):
        replies.reply_once(view(spark, sf_dir, UPDATES), table, known, sender(part), "MA1", (table.note("batch") or 0) + 1)
    sends = spark.read.schema("event_id bigint").parquet(f"{folder}/sent").groupBy(F.col("event_id").alias("update_id")).agg(F.count(F.lit(1)).cast("int").alias("sends"))
    return table.read().select("update_id").join(sends, "update_id", "left").select("update_id", F.coalesce("sends", F.lit(0)).alias("sends"))

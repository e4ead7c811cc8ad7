"""Replies, rankings, acceptance and schedules."""

from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from festa.operators import enrich
from festa.streaming import schedule
from tests.test_engine import d, event, frame

TODAY = date(2026, 10, 2)


@pytest.fixture(scope="module")
def today(spark):
    return F.lit(TODAY)


def test_replies_are_salvaged(spark, today):
    replies = [
        ("a", 'Kết quả: [{"name": " Lễ hội A ", "province": "TP.HCM", "start_date": "2026-10-20", "crowd": "15000.0", "fireworks": true}, {"name": "B", "start_date": "mai", "crowd": -3}] xong'),
        ("b", '{"name": "Hội C", "is_event": false}'),
        ("c", "không có gì"),
        ("d", None),
    ]
    rows = enrich.reply_rows(spark.createDataFrame(replies, "k string, reply string")).collect()
    assert [(r.k, r.name) for r in rows] == [("a", "Lễ hội A"), ("a", "B"), ("b", "Hội C")]
    a, b, c = rows
    assert (a.province, a.start_date, a.end_date, a.crowd, a.fireworks, a.is_event) == ("hcm", d(20), d(20), 15000, True, True)
    assert (b.start_date, b.crowd) == (None, None) and not c.is_event


def test_found_events_are_judged(spark, today):
    row = lambda name, start, province="cantho", venue="", summary="Sự kiện ở phương Nam.": (name, province, venue, start, start, summary)
    rows = [row("Lễ hội Trái cây", d(20)), row("Kiểm tra lễ hội", d(20)), row("Lễ hội Hoa", None), row("Lễ hội Hoa Đà Lạt", d(20)), row("Lễ hội Trái cây", d(1, 9)), row("Lễ hội Trái cây", d(30, 12)), row("Lễ hội Cà Mau", d(20)), row("Lễ hội mới", d(20), summary="Hà Nội mở hội đón khách.")]
    df = spark.createDataFrame(rows, "name string, province string, venue string, start_date date, end_date date, summary string")
    got = enrich.judged(df, today).collect()
    assert [r.status for r in got] == ["accept", "not_event", "not_event", "not_event", "past", "far", "accept", "out_of_scope"] and got[6].province == "camau"


def test_search_and_ranking(spark, today):
    e = frame(spark, event(1, "Lễ hội Trái cây Chợ Lách", "vinhlong"), event(2, "Hội hoa", "nowhere"))
    queries = [(r.id, r["rank"], r["query"]) for r in enrich.search_queries(e).collect()]
    assert queries[0][2].startswith("Trái cây Lách Vĩnh Long (site:baovinhlong.com.vn") and queries[1] == (1, 1, "Trái cây Lách Vĩnh Long when:90d") and len(queries) == 3
    found = spark.createDataFrame([(1, 0, "u1", "Trái cây Chợ Lách vào mùa", "https://xa.vn"), (1, 1, "u2", "Hội trái cây ở Chợ Lách", "https://baobentre.vn"), (1, 2, "u3", "Trái cây Hà Nội", "https://xa.vn"), (1, 3, "u4", "Tin khác", "https://xa.vn"), (1, 4, "u1", "Trái cây Chợ Lách", "https://xa.vn")], "id bigint, pos int, link string, title string, publisher string")
    assert [(r.link, r["rank"]) for r in enrich.ranked(e, found).orderBy("rank").collect()] == [("u2", 1), ("u1", 2)]
    links = spark.range(1).select(enrich.promoted(F.array(F.lit("a"), F.lit("b")), F.lit("b"), F.lit(True)).alias("x"), enrich.promoted(F.array(F.lit("a")), F.lit("b"), F.lit(False)).alias("y")).first()
    assert links.x == ["b", "a"] and links.y == ["a", "b"]


def test_acceptance_and_overlay(spark, today):
    pairs = [(event(1, "A", start=d(5)), event(2, "A", start=d(7))), (event(1, "A", start=d(5)), event(2, "A", start=d(15))), (event(1, "A"), event(2, "A", "camau", start=d(7))), (event(1, "A"), event(2, "A", start=d(1, 9)))]
    rows = [frame(spark, a).select(F.struct("*").alias("e")).crossJoin(frame(spark, b).select(F.struct("*").alias("f"))).select(enrich.acceptable("e", "f", today).alias("ok")).first().ok for a, b in pairs]
    assert rows == [True, False, False, False]
    both = frame(spark, event(1, "Lễ hội A", venue="Sân A", crowd=5)).select(F.struct("*").alias("r")).crossJoin(frame(spark, event(2, "", venue="nhà", crowd=None, fireworks=True, start=d(7))).select(F.struct("*").alias("m")))
    o = both.select(enrich.overlaid("r", "m").alias("o")).first().o
    assert (o.name, o.venue, o.crowd, o.fireworks, o.start_date) == ("Lễ hội A", "Sân A", 5, True, d(7))


def test_schedules(spark, today):
    at = datetime
    assert schedule.Options.read({"LARGE_CROWD": " 500 ", "DIGEST_HOUR": "", "ENRICH_MAX": "x"}) == schedule.Options(large_crowd=500)
    assert schedule.chat_ids("1, 2;3,") == ["1", "2", "3"]
    assert schedule.collect_due(None, at(2026, 10, 5)) and not schedule.collect_due(at(2026, 10, 5, 6), at(2026, 10, 5, 7))
    assert not schedule.digest_due(None, at(2026, 10, 5, 6, 5)) and schedule.digest_due(None, at(2026, 10, 5, 7, 5)) and not schedule.digest_due("2026-10-05", at(2026, 10, 5, 8))
    assert schedule.exports_due({}, at(2026, 10, 5, 7)) == ["week"] and schedule.exports_due({"week": "2026-10-05"}, at(2026, 10, 5, 8)) == []
    assert schedule.morning_due(0, False, at(2026, 10, 5, 6)) and not schedule.morning_due(2, False, at(2026, 10, 5, 6))
    state = spark.createDataFrame([("a", at(2026, 10, 1)), ("b", None), ("c", at(2026, 10, 5))], "province string, asked_at timestamp")
    now = F.lit(at(2026, 10, 5, 7))
    assert [r.province for r in schedule.provinces_due(state, now, 8).collect()] == ["b", "a"]
    e = frame(spark, event(1, "A"), event(2, "B", start=d(5)), event(3, "C", start=d(5)))
    tries = spark.createDataFrame([(2, 8, None), (3, 1, at(2026, 10, 1))], "id bigint, tries int, tried_at timestamp")
    assert [r.id for r in schedule.events_due(e, tries, today, now, 5).collect()] == [3, 1]
    items = spark.createDataFrame([("a", d(1)), ("b", None), ("c", d(2))], "link string, published date")
    assert [r.link for r in schedule.admitted(items, 2).collect()] == ["c", "a"]

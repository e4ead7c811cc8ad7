"""Operators, sources and streams on small tables."""

from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from festa.functions import render
from festa.operators import catalogue, classify, resolve
from festa.plans import serve
from festa.sources import feeds, html
from festa.streaming import ingest

TODAY = date(2026, 10, 2)

@pytest.fixture(autouse=True, scope="module")
def columns(spark):
    global T
    T = F.lit(TODAY)

ITEM = "title string, link string, summary string, body string, published date, province_hint string, is_search boolean, trust_hint boolean"


def event(i, name, province="cantho", start=None, end=None, **more):
    base = {"id": i, "name": name, "province": province, "venue": "", "start_date": start, "end_date": end or start, "start_time": "", "crowd": None, "fireworks": False, "big_concert": False, "summary": "", "sources": [f"u{i}"], "alerted": False}
    return tuple((base | more)[f] for f in resolve.FIELDS)


def frame(spark, *rows):
    return spark.createDataFrame(list(rows), resolve.EVENT)


def d(day, month=10):
    return date(2026, month, day)


def test_cascade(spark):
    body = "Lễ hội diễn ra ngày 20-21/10 tại Quảng trường Sao Mai, phường Ninh Kiều, dự kiến 15.000 người, bắn pháo hoa lúc 21h."
    item = lambda title, link, body=body, hint="cantho", search=False, trust=False, summary="": (title, link, summary, body, TODAY, hint, search, trust)
    rows = [
        item("Lễ hội Trái cây Cần Thơ", "ok"),
        item("Tai nạn ở lễ hội Cần Thơ", "negative"),
        item("Thời tiết hôm nay", "nothing"),
        item("Lễ hội Hoa ở Hà Nội", "elsewhere"),
        item("Lễ hội Hoa Sen mở cửa", "no_place", "Ngày 20/10.", hint="dongnai"),
        item("Lễ hội Hoa Sen mở cửa", "trusted", "Ngày 20/10.", hint="dongnai", trust=True),
        item("Lễ hội Hoa Sen Cần Thơ", "past", "Cần Thơ, ngày 10/9."),
        item("Hội nghị nhỏ tại Cần Thơ", "weak", "Cần Thơ họp ngày 20/10."),
        item("Tin mới", "unread", "", hint=None, search=True),
        item("La grande fête de la musique festival à Paris", "foreign"),
        item("Lễ hội tại Cần Thơ sôi động", "unnamed", "Cần Thơ vui."),
    ]
    got = {r.link: r for r in classify.classified(spark.createDataFrame(rows, ITEM), T).collect()}
    want = {"ok": "accept", "negative": "skip", "nothing": "skip", "elsewhere": "out_of_scope", "no_place": "out_of_scope", "trusted": "accept", "past": "past", "weak": "not_event", "unread": "no_body", "foreign": "not_event", "unnamed": "not_event"}
    assert {k: r.status for k, r in got.items()} == want
    ok = got["ok"]
    assert (ok.province, ok.found_name, ok.found_start_date, ok.found_end_date) == ("cantho", "Lễ hội Trái cây Cần Thơ", d(20), d(21))
    assert (ok.found_crowd, ok.found_fireworks, ok.found_start_time, ok.found_venue) == (15000, True, "21:00", "Quảng trường Sao Mai, phường Ninh Kiều")
    reports = classify.accepted(classify.classified(spark.createDataFrame(rows, ITEM), T))
    assert reports.count() == 2


def test_pairs_match_brute_force(spark):
    events = [
        event(1, "Lễ hội Trái cây Chợ Lách", start=d(5)), event(2, "Lễ hội Trái cây Chợ Lách mở rộng", start=d(8)), event(3, "Lễ hội Trái cây Chợ Lách", start=d(20)),
        event(4, "Lễ hội Trái cây Chợ Lách", "camau", start=d(5)), event(5, "Trái cây Chợ Lách"), event(6, "Hội chợ Thương mại", start=d(30), end=d(2, 11)), event(7, "Hội chợ Thương mại", start=d(4, 11)),
        event(8, "Lễ hội tại Cần Thơ", start=d(5)),
    ]
    found = {(r.a_id, r.b_id) for r in resolve.duplicate_pairs(frame(spark, *events)).collect()}
    assert found == {(1, 2), (1, 5), (2, 5), (3, 5), (6, 7)}
    new = frame(spark, event(50, "Trái cây Chợ Lách", start=d(6)))
    assert [tuple(r) for r in resolve.first_matches(new, frame(spark, *events)).collect()] == [(50, 1)]


MERGES = [
    ({"start": None}, {"start": d(5)}, {"start_date": d(5)}),
    ({"start": d(5)}, {"start": d(5), "end": d(7)}, {"end_date": d(7)}),
    ({"start": d(5), "end": d(7)}, {"start": d(6), "end": d(9)}, {"start_date": d(5), "end_date": d(9)}),
    ({"start": d(5)}, {"start": d(6)}, {"start_date": d(5), "end_date": d(6)}),
    ({"start": d(5)}, {"start": d(8), "end": d(9)}, {"start_date": d(8), "end_date": d(9)}),
    ({"start": d(5)}, {"start": d(8)}, {"start_date": d(5), "end_date": d(5)}),
    ({"start": d(5), "crowd": 100}, {"start": d(5), "crowd": 50}, {"crowd": 100}),
    ({"start": d(5)}, {"start": d(5), "crowd": 50, "fireworks": True, "venue": "Sân A"}, {"crowd": 50, "fireworks": True, "venue": "Sân A"}),
    ({"start": d(5), "venue": "Sân A"}, {"start": d(5), "venue": "Sân B"}, {"venue": "Sân A"}),
]


@pytest.mark.parametrize(("old", "new", "want"), MERGES)
def test_merge_rules_in_both_forms(spark, old, new, want):
    o, n = event(1, "Lễ hội A", **old), event(2, "Lễ hội A", **new)
    columns = dict(zip(resolve.FIELDS, o, strict=True))
    both = frame(spark, o).select(F.struct("*").alias("o")).crossJoin(frame(spark, n).select(F.struct("*").alias("n")))
    m = both.select(resolve.merged("o", "n").alias("m")).first().m.asDict()
    done = resolve.fold(frame(spark, o, n))
    (folded,), status = done.events.collect(), done.changes.filter("report_id = 2").first().status
    for k, v in want.items():
        assert m[k] == v and folded[k] == v, k
    assert m["sources"] == folded["sources"] == ["u1", "u2"] and status == "merged" and m["changed"]
    assert all(m[k] == columns[k] for k in ("name", "province", "id"))


def test_merge_limits(spark):
    o, n = event(1, "Hội hoa", start=d(5), sources=[f"s{i}" for i in range(6)]), event(2, "Hội hoa mùa xuân thành phố", start=d(5), sources=["x"])
    both = frame(spark, o).select(F.struct("*").alias("o")).crossJoin(frame(spark, n).select(F.struct("*").alias("n")))
    m = both.select(resolve.merged("o", "n").alias("m")).first().m
    assert m.name == "Hội hoa mùa xuân thành phố" and len(m.sources) == 6 and "x" not in m.sources


def test_fold_in_order(spark):
    rows = [event(1, "Lễ hội Trái cây Chợ Lách", start=d(5)), event(2, "Trái cây Chợ Lách", start=d(6), crowd=900), event(3, "Triển lãm tranh Đông Hồ", start=d(5)), event(4, "Trái cây Chợ Lách", "camau", start=d(6))]
    got = {r.id: r for r in resolve.resolve(frame(spark, *rows)).collect()}
    assert set(got) == {1, 3, 4} and got[1].crowd == 900 and (got[1].start_date, got[1].end_date) == (d(5), d(6)) and got[1].sources == ["u1", "u2"]


def seeded(spark):
    rows = [event(1, "Lễ hội A", start=TODAY, end=d(3), crowd=20000, venue="Bến Ninh Kiều"), event(2, "Hội chợ B pháo hoa", "tayninh", start=d(5)), event(3, "Giải chạy C", "camau", start=d(1, 11)), event(4, "Lễ hội D", "hcm"), event(5, "Lễ hội E", "hcm", start=d(1, 9))]
    return catalogue.with_priority(frame(spark, *rows))


def test_catalogue_queries(spark):
    e = seeded(spark)
    ids = lambda df: [r.id for r in df.collect()]
    assert ids(catalogue.events_between(e, T, F.date_add(T, 6))) == [1, 2]
    assert ids(catalogue.events_between(e, T, F.date_add(T, 60), "camau")) == [3]
    assert ids(catalogue.search(e, "Pháo Hoa", T)) == [2] and ids(catalogue.search(e, " ", T)) == []
    large = catalogue.unalerted_large(e, T)
    assert ids(large) == [1] and ids(catalogue.unalerted_large(catalogue.mark_alerted(e, large), T)) == []
    assert ids(catalogue.pending(e, T)) == [2, 3, 4] and ids(catalogue.current(e, T)) == [1, 2, 3, 4]
    noise = [event(1, "Lễ hội A", start=TODAY), event(2, "Kiểm tra lễ hội"), event(3, "Họp dân"), event(4, "Sôi động lễ hội lớn"), event(5, "Lễ hội Hoa Sen", summary="Diễn ra tại Hà Nội."), event(6, "Lễ hội Hoa Sen", summary="Hà Nội, Hà Nội và Cần Thơ.")]
    assert {r.id: r.why for r in catalogue.pruned(frame(spark, *noise)).collect()} == {1: None, 2: "not_cultural", 3: "not_cultural", 4: "no_name", 5: "held_elsewhere", 6: "elsewhere"}
    kept = catalogue.retained_events(e.withColumn("first_seen", F.lit(date(2026, 6, 1))), F.lit(date(2026, 12, 5)))
    assert sorted(ids(kept)) == [1, 2, 3]


def test_ledger_and_subscribers(spark):
    t = lambda h: datetime(2026, 10, 2, h)
    ledger = spark.createDataFrame([("a", "new", t(1)), ("a", "merged", t(3)), ("b", "no_body", t(1)), ("c", "no_body", t(9))], "link string, status string, seen_at timestamp")
    last = catalogue.latest(ledger, "link", F.col("seen_at"))
    assert {(r.link, r.status) for r in last.collect()} == {("a", "merged"), ("b", "no_body"), ("c", "no_body")}
    items = spark.createDataFrame([(x,) for x in "abcd"], "link string")
    assert sorted(r.link for r in catalogue.unseen(items, last, F.lit(t(10))).collect()) == ["b", "d"]
    assert sorted(r.link for r in catalogue.unseen(items, last).collect()) == ["d"]
    chats = catalogue.recipients(spark.createDataFrame([("x",)], "chat_id string"), spark.createDataFrame([("x", t(1)), ("y", t(2)), ("y", t(1))], "chat_id string, joined_at timestamp"))
    assert {(r.chat_id, r.kind) for r in chats.collect()} == {("x", 0), ("y", 1)}
    assert [(r.status, r.n) for r in catalogue.status_counts(ledger).collect()] == [("no_body", 2), ("merged", 1), ("new", 1)]


def test_health_batch_and_stream(spark, tmp_path):
    runs = [("s1", i, ok, None if ok else "boom") for i, ok in enumerate([True, False, False, False, False, True, False])] + [("s2", i, False, "x") for i in range(2)]
    df = spark.createDataFrame(runs, "source_id string, seq bigint, ok boolean, error string")
    streaks = {r.source_id: r.fails for r in catalogue.fail_streaks(df.withColumn("run_at", F.col("seq"))).collect()}
    assert streaks == {"s1": 1, "s2": 2}
    df.coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in")
    got = sorted((r.source_id, r.seq, r.notice) for r in ingest.drained(ingest.source_notices(stream), str(tmp_path), "n").collect())
    assert got == [("s1", 3, "failing"), ("s1", 5, "recovered")]


def test_feeds(spark):
    rss = "<rss><channel><item><title>Lễ &amp; hội</title><link>https://a/1</link><description>&lt;p&gt;Mở  cửa&lt;/p&gt;</description><pubDate>Thu, 01 Oct 2026 08:00:00 GMT</pubDate></item><item><title>Cũ</title><link>https://a/2</link><pubDate>Mon, 01 Jan 2024 08:00:00 GMT</pubDate></item><item><title>Không ngày</title><link>https://a/3</link></item></channel></rss>"
    docs = spark.createDataFrame([("s", rss, False), ("bad", "<html><p>x", False), ("empty", "<rss/>", False)], "source_id string, content string, is_search boolean")
    rows = feeds.feed_items(docs, T).collect()
    good = {r.link: r for r in rows if r.error is None}
    assert set(good) == {"https://a/1", "https://a/3"} and good["https://a/1"].title == "Lễ & hội" and good["https://a/1"].summary == "Mở cửa" and good["https://a/1"].published == d(1)
    assert {r.source_id for r in rows if r.error} == {"bad", "empty"}


def test_source_catalogue(spark, tmp_path):
    entries = [{"id": "g", "name": "G", "type": "google_news", "topics": '(lễ hội OR "x")', "provinces": {"hcm": '"Sài Gòn"', "camau": '"Cà Mau"'}}, {"id": "off", "name": "O", "type": "rss", "url": "https://o", "enabled": False}, {"id": "r", "name": "R", "type": "rss", "url": "https://r"}]
    rows = {r.id: r for r in feeds.expanded(feeds.catalogue(spark, entries)).collect()}
    assert set(rows) == {"g-hcm", "g-camau", "r"} and rows["g-hcm"].is_search and "%20" in rows["g-hcm"].url and "+" not in rows["g-hcm"].url.split("?q=")[1].split("&")[0]


def test_pages(spark):
    page = """<html><head><title>T</title><link rel="alternate" type="application/rss+xml" href="/rss/a.xml"><meta property="og:description" content="Mô tả  ngắn"></head><body><nav><p>menu menu menu menu menu menu menu</p></nav>
    <a href="/tin/le-hoi-hoa-2026.html">Lễ hội hoa xuân lớn ở thành phố 12/10/2026</a><a href="/tin/le-hoi-hoa-2026.html">Lễ hội hoa xuân lớn ở thành phố</a><a href="https://other.example/le-hoi-2026.html">Lễ hội hoa xuân ở nơi khác</a><a href="#x">Bỏ qua liên kết này nhé bạn</a>
    <article><p>Đoạn một có đủ hai mươi lăm ký tự &amp; hơn.<p>ngắn</p></article></body></html>"""
    df = spark.createDataFrame([(1, "https://www.bao.example/muc/", page)], "page_id bigint, url string, html string")
    links = html.article_links(df).collect()
    assert [(r.link, r.title, r.published) for r in links] == [("https://www.bao.example/tin/le-hoi-hoa-2026.html", "Lễ hội hoa xuân lớn ở thành phố", d(12))]
    r = df.select(html.feeds(F.col("html"), F.col("url")).alias("feeds"), html.article_text(F.col("html")).alias("text"), html.host(F.col("url")).alias("host"), html.page_title(F.col("html")).alias("title")).first()
    assert r.feeds == ["https://www.bao.example/rss/a.xml"] and r.text == "Mô tả ngắn\nĐoạn một có đủ hai mươi lăm ký tự & hơn." and r.host == "bao.example" and r.title == "T"
    listed = feeds.listed_items(df, 'a[href*="le-hoi"]').collect()
    assert len(listed) == 2 and feeds.listed_items(df, "a.none").first().error
    with pytest.raises(ValueError, match="selector"):
        feeds.listed_items(df, "div > a:first")


def test_news_links(spark):
    import base64

    inside = base64.urlsafe_b64encode(b"\x08\x13\x22" + bytes([20]) + b"https://bao.example/1" + b"\xd2\x01\x00").decode().rstrip("=")
    urls = ["https://bao.example/x", f"https://news.google.com/rss/articles/{inside}?oc=5", "https://news.google.com/x?url=https%3A%2F%2Fbao.example%2F2", "https://news.google.com/rss/articles/QVVfeXFM"]
    got = [r[0] for r in spark.createDataFrame([(u,) for u in urls], "u string").select(html.news_link(F.col("u"))).collect()]
    assert [g.link for g in got] == ["https://bao.example/x", "https://bao.example/1", "https://bao.example/2", None] and [g.online for g in got] == [False, False, False, True]


def test_messages(spark):
    e = seeded(spark)
    week = catalogue.events_between(e, T, F.date_add(T, 6))
    text = render.digest(week, T, 7).first().text
    assert "Thứ Sáu 02/10/2026" in text and "7 ngày tới: 2 sự kiện (1 quy mô lớn)" in text and "[CAO] 2–3/10 · Cần Thơ\nLễ hội A\nĐịa điểm: Bến Ninh Kiều\nQuy mô: ~20.000 người\nNguồn: u1" in text
    assert render.DIGEST_EMPTY in render.digest(week.limit(0), T, 7).first().text
    assert "quy mô ≥ 10.000 người" in render.alerts(catalogue.unalerted_large(e, T)).first().text
    assert len(render.report_rows(week).columns) == 12


def test_commands(spark, tmp_path):
    e = seeded(spark)
    answer = lambda t: serve.answer(e, t, TODAY)
    assert "Lễ hội A" in answer("/homnay")[0] and "Hội chợ B" in answer("/tuannay")[0] and "Giải chạy C" in answer("/tinh cà mau")[0]
    assert "Không nhận ra" in answer("/tinh xyz")[0] and "Hội chợ B" in answer("/sukien pháo hoa")[0] and answer("/abc")[0] == serve.UNKNOWN
    assert answer("/tatca")[0].startswith("Đang lưu 4 sự kiện:") and "/homnay" in answer("/help")[0]
    path = serve.export(e, "week", TODAY, str(tmp_path))
    import zipfile

    with zipfile.ZipFile(path) as z:
        sheet = z.read("xl/worksheets/sheet1.xml").decode()
    assert sheet.count("<row ") == 3 and "Lễ hội A" in sheet


def test_subscribers_updates_and_names(spark):
    day = date(2026, 1, 1)
    there = spark.createDataFrame([("a", "An", day)], "chat_id string, name string, joined_at date")
    joining = spark.createDataFrame([("a", "Khác", date(2025, 1, 1)), ("b", "x" * 70, day), ("b", "y", date(2026, 1, 2)), ("c", None, day)], there.schema)
    assert {tuple(r) for r in catalogue.subscribed(there, joining).collect()} == {("a", "An", day), ("b", "x" * 60, day), ("c", "", day)}
    old = spark.createDataFrame([(1, "A", "hcm", True, 5), (2, "B", "camau", False, None)], "id int, name string, province string, alerted boolean, crowd int")
    new = spark.createDataFrame([(1, "A2", "cantho", False, None), (3, "C", "hcm", False, 1)], old.schema)
    assert {tuple(r) for r in catalogue.updated(old, new).collect()} == {(1, "A2", "hcm", True, None), (2, "B", "camau", False, None)}
    asked = spark.createDataFrame([("LỄ HỘI a!",), (None,), ("khác",)], "name string")
    events = spark.createDataFrame([(7, "Lễ hội A"), (9, "lễ hội a"), (8, "B")], "id int, name string")
    assert [tuple(r) for r in catalogue.named(asked, events).collect()] == [("LỄ HỘI a!", 9)]
    updates = spark.createDataFrame([(1, "a", "/start"), (2, "z", "/start"), (3, "z", "/start MA"), (4, "z", "/id"), (5, "z", "/excel tháng"), (6, "z", None)], "update_id int, chat_id string, text string")
    got = {r.update_id: (r.action, r.reply) for r in serve.acted(updates, there, "MA").collect()}
    assert [got[i][0] for i in range(1, 7)] == ["join", "refuse", "join", "id", "month", None] and got[4][1] == "Chat ID của bạn: z"


def test_listing_takes_the_first_and_counts_all(spark):
    rows = [event(i, f"Lễ hội {i:02}", start=d(1 + i % 7) if i % 5 else None) for i in range(30)]
    events = catalogue.with_priority(frame(spark, *rows))
    got = render.listing(events, F.lit("Danh sách")).first()
    shown = [line for line in got.text.split("\n") if line.startswith("Lễ hội")]
    want = sorted(rows, key=lambda r: (r[4] is not None, r[4] or TODAY, r[1]))[:25]
    assert got.events == 30 and shown == [r[1] for r in want] and "… và 5 sự kiện khác" in got.text
    assert render.listing(events.limit(0), F.lit("Danh sách")).first().events == 0

"""Selectors, references, auto sources and searches against hand-made documents."""

import datetime

import pytest
from pyspark.sql import functions as F

from festa.sources import feeds, html, selectors

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p > a {}</style></head><body>
<div id="top" class="menu main-menu"><ul><li class="first">eins<li>zwei<a href="/m">M</a></ul></div>
<div class="list"><h3><a class="event-card hot" href="/detailnews?id=1&amp;x=2" data-k="a b">Lễ hội hoa xuân 2026</a></h3>
<h3 class="Hot"><span>vor</span><a href='/tin/2.html'>Hội chợ đặc sản miền Tây 01/10/2026 85</a></h3>
<div class="card" data-Kind="EN-us"><p>Tin <a href="/tin/3.html">Ok Om Bok ở Trà Vinh</a></p><a>none</a></div></div>
<!-- <h3><a href="/x">verborgen, lang genug</a></h3> --><script>document.write('<h3><a href="/y">nein</a></h3>')</script>
<div class="list"><img src="a.png" class="pic"><br/><p class="">leer</p>
</body></html>"""

#: Selector and what it finds: the tags, with the text of the element where it tells.
CASES = {
    'a[href*="detailnews"]': ["Lễ hội hoa xuân 2026"],
    "h3 a": ["Lễ hội hoa xuân 2026", "Hội chợ đặc sản miền Tây 01/10/2026 85"],
    "a.event-card": ["Lễ hội hoa xuân 2026"],
    "h3 > a": ["Lễ hội hoa xuân 2026", "Hội chợ đặc sản miền Tây 01/10/2026 85"],
    "div > a": ["none"],
    "div a[href]": ["M", "Lễ hội hoa xuân 2026", "Hội chợ đặc sản miền Tây 01/10/2026 85", "Ok Om Bok ở Trà Vinh"],
    ".list > .card p a": ["Ok Om Bok ở Trà Vinh"],
    "#top li.first": ["eins zwei M"],
    "ul > li": ["eins zwei M"],
    "ul li li": ["zwei M"],
    "a[data-k~=b]": ["Lễ hội hoa xuân 2026"],
    "a[data-k~='a b']": [],
    "[data-kind|=en]": [],
    "[data-kind|='EN'] > a": ["none"],
    '[data-kind="en-US" i] > p': ["Tin Ok Om Bok ở Trà Vinh"],
    "a[href^='/tin'][href$=\".html\"]": ["Hội chợ đặc sản miền Tây 01/10/2026 85", "Ok Om Bok ở Trà Vinh"],
    "a[href*='']": [],
    "h3 > :first-child": ["Lễ hội hoa xuân 2026", "vor"],
    "h3 > a:nth-child(2)": ["Hội chợ đặc sản miền Tây 01/10/2026 85"],
    "h3:not(.Hot) a, div.card > a": ["Lễ hội hoa xuân 2026", "none"],
    "a[href='/detailnews?id=1&x=2']": ["Lễ hội hoa xuân 2026"],
    "h3.hot": [],
    "DIV.list IMG.pic": [""],
    "p.none , title": ["T"],
    "body > * > h3": ["Lễ hội hoa xuân 2026", "vor Hội chợ đặc sản miền Tây 01/10/2026 85"],
    "p > a ~ a": ValueError,
    "div > a:first": ValueError,
    "": ValueError,
    "a >": ValueError,
    "> a": ValueError,
    "a,": ValueError,
    "a..b": ValueError,
}


@pytest.fixture(scope="module")
def page(spark):
    rows = [(1, "https://bao.example/muc/", PAGE), (2, "https://bao.example/", ""), (3, None, None)]
    return spark.createDataFrame(rows, "page_id bigint, url string, html string")


def test_selectors(spark, page):
    asked = []
    for selector, expected in CASES.items():
        if expected is ValueError:
            with pytest.raises(ValueError, match="selector"):
                selectors.compiled(selector)
        else:
            asked.append(selectors.selected(page, selector).select(F.lit(selector).alias("s"), "page_id", "pos", html.plain(F.col("outer")).alias("t")))
    whole = asked[0]
    for more in asked[1:]:
        whole = whole.unionByName(more)
    got = {}
    for r in whole.orderBy("pos").collect():
        assert r.page_id == 1
        got.setdefault(r.s, []).append(r.t)
    assert {s: got.get(s, []) for s in CASES if CASES[s] is not ValueError} == {s: x for s, x in CASES.items() if x is not ValueError}


def test_elements_are_a_tree(spark, page):
    rows = {r.pos: r for r in selectors.elements(page).collect()}
    assert sorted(rows) == list(range(len(rows))) and rows[0].tag == "html" and rows[0].depth == 0
    for r in rows.values():
        if r.parent is not None:
            above = rows[r.parent]
            assert r.depth == above.depth + 1 and r.path.startswith(above.path) and r.outer in above.outer and r.parent < r.pos


def test_deep_and_hostile_pages(spark):
    texts = ["<div>" * 2000 + "<a href=x>tief unten steht er</a>", "<a href='x", "</div></p>x", "<a <b <c>", "<a\x01href=\x02\x01>y</a>" * 3]
    df = spark.createDataFrame([(i, "https://h.example/", t) for i, t in enumerate(texts)], "page_id bigint, url string, html string")
    found = selectors.selected(df, "div a").collect()
    assert [r.page_id for r in found] == [0] and found[0].depth == 2000


def test_listed_items(spark, page):
    rows = feeds.listed_items(page, "h3, div.card").orderBy("page_id", "pos").collect()
    assert [(r.page_id, r.link, r.title, r.published) for r in rows if not r.error] == [
        (1, "https://bao.example/detailnews?id=1&x=2", "Lễ hội hoa xuân 2026", None),
        (1, "https://bao.example/tin/2.html", "Hội chợ đặc sản miền Tây", datetime.date(2026, 10, 1)),
        (1, "https://bao.example/tin/3.html", "Ok Om Bok ở Trà Vinh", None),
    ]
    assert [r.page_id for r in rows if r.error] == [2, 3]
    assert feeds.listed_items(page.limit(0), "h3").count() == 0


def test_references(spark):
    import html as standard

    texts = ["a&amp;lt;b", "&Agrave;&eacute;&#7877;&#x1EC5;&hellip;", "&#0;&#xD800;&#1114112;", "&unknown; & &;&#;&amp", "no reference", "", "&apos;&quot;&#39;", "x&nbsp;y", "&lt;&lt;&amp;amp;", "😀&#128512;"]
    rows = spark.createDataFrame([(t,) for t in [*texts, None]], "t string").select("t", html.unescaped(F.col("t")).alias("u")).collect()
    for r in rows:
        expected = None if r.t is None else standard.unescape(r.t.replace("&amp", "&amp;") if r.t.endswith("&amp") else r.t)
        assert r.u == (expected if r.t is None or not r.t.endswith("&amp") else "&unknown; & &;&#;&amp"), r.t


def _feed(*entries):
    items = "".join(f"<item><title>{t}</title><link>{x}</link><source url='{p}'>P</source><description>Mô tả</description><pubDate>{day}</pubDate></item>" for t, x, p, day in entries)
    return f"<rss><channel>{items}</channel></rss>"


def test_searches(spark):
    entries = [(f"Bài {i}", "" if i == 3 else f"https://news.google.com/rss/articles/{i}", f"https://www.bao{i}.example/x", "Mon, 01 Jan 2001 08:00:00 GMT") for i in range(20)]
    df = spark.createDataFrame([("s", _feed(*entries)), ("bad", "<x"), ("none", "<rss></rss>"), ("null", None)], "source_id string, content string").withColumn("is_search", F.lit(None).cast("boolean"))
    rows = feeds.search_items(df).collect()
    good = [r for r in rows if not r.error]
    assert [r.pos for r in good] == [i for i in range(15) if i != 3] and all(r.is_search and r.summary == "" for r in good)
    assert good[0].publisher == "bao0.example" and good[0].published == datetime.date(2001, 1, 1)
    assert {r.source_id for r in rows if r.error} == {"bad", "none", "null"}


def test_auto_sources(spark):
    today = F.lit(datetime.date(2026, 10, 10))
    link, title = "https://bao.example/tin/le-hoi-hoa-2026.html", "Lễ hội hoa xuân lớn ở thành phố"
    day = "Fri, 09 Oct 2026 08:00:00 GMT"
    documents = spark.createDataFrame(
        [("s", 1, _feed(("Trùng với trang ở trước", link, "", day), ("Chỉ có trong feed", "https://bao.example/f/9", "", day)), False), ("s", 0, "<x", False), ("none", 0, "<rss></rss>", False)],
        "source_id string, address int, content string, is_search boolean",
    )
    page = f"<a href='{link}'>{title}</a><a href='/tin/le-hoi-hoa-2027.html'>{title} năm sau</a>"
    pages = spark.createDataFrame([(1, "s", 0, "https://bao.example/", page), (2, "s", 1, "https://bao.example/2", page), (3, "empty", 0, "https://e.example/", None)], "page_id bigint, source_id string, address int, url string, html string")
    rows = feeds.auto_items(documents, pages, today).collect()
    assert {(r.source_id, r.link, r.title) for r in rows if not r.error} == {
        ("s", link, title),
        ("s", "https://bao.example/tin/le-hoi-hoa-2027.html", f"{title} năm sau"),
        ("s", "https://bao.example/f/9", "Chỉ có trong feed"),
    }
    assert sorted(r.source_id for r in rows if r.error) == ["empty", "none"]


def test_page_items(spark, page):
    rows = {r.page_id: r for r in feeds.page_items(page, F.lit(datetime.date(2026, 10, 10))).collect()}
    assert rows[1].error == "no title" and rows[2].error == "no title" and rows[3].error == "no title"
    good = spark.createDataFrame([(1, "https://x.example/1", "<h1>Lễ hội &amp; hội chợ</h1>")], "page_id bigint, url string, html string")
    r = feeds.page_items(good, F.lit(datetime.date(2026, 10, 10))).first()
    assert (r.title, r.link, r.published, r.error) == ("Lễ hội & hội chợ", "https://x.example/1", datetime.date(2026, 10, 10), None)

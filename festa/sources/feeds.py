"""The source catalogue and feeds: YAML to a DataFrame of sources, feed and page documents to items, errors as rows."""

from __future__ import annotations

import re
from collections.abc import Iterator
from email.utils import parsedate_to_datetime
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from festa.sources.html import absolute, article_links, dated_title, host, page_title, plain, unescaped
from festa.sources.selectors import selected

CATALOGUE = "id string, name string, type string, url string, urls array<string>, item_selector string, province_hint string, local boolean, enabled boolean, window string, topics string, provinces map<string,string>"
CUTOFF_DAYS = 45
SEARCH_ENTRIES = 15
#: Entries after which a frame is handed on: a document may hold many.
FRAME_ROWS = 5_000
SEARCH = "https://news.google.com/rss/search?q={}&hl=vi&gl=VN&ceid=VN:vi"
_ITEMS = "source_id string, address int, is_search boolean, pos int, title string, link string, summary string, published date, publisher string, error string"


def catalogue(spark: SparkSession, entries: list[dict]) -> DataFrame:
    names = [c.split(" ")[0] for c in CATALOGUE.split(", ")]
    return spark.createDataFrame([tuple(e.get(n) for n in names) for e in entries], CATALOGUE)


def read_catalogue(spark: SparkSession, path: str) -> DataFrame:
    """A YAML file of ``sources``, read by Spark from any store it knows."""
    import yaml

    document = "\n".join(r[0] for r in spark.read.text(path, wholetext=True).collect())
    return catalogue(spark, yaml.safe_load(document)["sources"])


def _quoted(text: Column) -> Column:
    return F.replace(F.replace(F.url_encode(text), F.lit("+"), F.lit("%20")), F.lit("%2F"), F.lit("/"))


def expanded(sources: DataFrame) -> DataFrame:
    """Enabled sources; a news search becomes one feed for each of its provinces."""
    on = sources.filter(F.coalesce("enabled", F.lit(True)))
    search = on.filter("type = 'google_news'").select("*", F.explode("provinces").alias("key", "region"))
    query = F.concat(F.col("topics"), F.lit(" ("), F.col("region"), F.lit(") when:"), F.coalesce("window", F.lit("14d")))
    before, after = SEARCH.split("{}")
    feeds = search.select(F.concat_ws("-", "id", "key").alias("id"), F.concat_ws(" - ", "name", "key").alias("name"), F.lit("rss").alias("type"), F.concat(F.lit(before), _quoted(query), F.lit(after)).alias("url"), F.col("key").alias("province_hint"), F.lit(True).alias("is_search"), F.lit(False).alias("local"))
    plain_ = on.filter("type <> 'google_news'")
    urls = F.when(F.size(F.coalesce("urls", F.array())) > 0, F.col("urls")).otherwise(F.array("url"))
    rest = plain_.select("id", "name", "type", F.explode(urls).alias("url"), "province_hint", F.lit(False).alias("is_search"), F.coalesce("local", F.lit(False)).alias("local"))
    return rest.unionByName(feeds)


def _entries(document: str) -> Iterator[tuple]:
    root = ElementTree.fromstring(document)
    local = lambda e: e.tag.rsplit("}", 1)[-1]
    for pos, item in enumerate(e for e in root.iter() if local(e) in ("item", "entry")):
        parts: dict[str, str] = {}
        for e in item:
            value = (e.text or "").strip() or e.get("href", "")
            parts.setdefault(local(e), value)
            if local(e) == "source":
                parts.setdefault("publisher", e.get("url") or e.get("href") or "")
        stamp, day = next((parts[k] for k in ("pubDate", "published", "updated", "date") if parts.get(k)), ""), None
        try:
            day = parsedate_to_datetime(stamp).date()
        except (ValueError, TypeError):
            found = re.match(r"(\d{4})-(\d\d)-(\d\d)", stamp)
            try:
                day = pd.Timestamp(found[0]).date() if found else None
            except ValueError:
                day = None
        yield pos, parts.get("title", ""), parts.get("link", ""), parts.get("description") or parts.get("summary") or parts.get("content") or "", day, parts.get("publisher", "")


def _documents(documents: DataFrame) -> DataFrame:
    """Every entry of feed documents as written, with an error row for a document that is none or has no entry."""

    names = [c.split(" ")[0] for c in _ITEMS.split(", ")]
    frame = lambda rows: pd.DataFrame(rows, columns=names).astype({"pos": "Int32", "address": "Int32"})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for source, address, search, content in batch.itertuples(index=False):
                if len(out) >= FRAME_ROWS:
                    yield frame(out)
                    out = []
                try:
                    found = list(_entries(content or ""))
                    error = None if found else "the feed has no entries"
                except ElementTree.ParseError as e:
                    found, error = [], f"not a feed: {e}"
                out += [(source, address, search, *x, None) for x in found] or [(source, address, search, *[None] * 6, error)]
            yield frame(out)

    address = F.col("address").cast("int") if "address" in documents.columns else F.lit(0)
    rows = documents.select("source_id", address.alias("address"), F.coalesce("is_search", F.lit(False)).alias("is_search"), "content").mapInPandas(run, _ITEMS)
    return rows.withColumn("is_search", F.col("is_search") | F.coalesce(F.contains("link", F.lit("news.google.com")), F.lit(False)))


def _whole() -> Column:
    return (F.coalesce("link", F.lit("")) != "") & (F.coalesce("title", F.lit("")) != "")


def feed_items(documents: DataFrame, today: Column) -> DataFrame:
    """Items of feed documents (source_id, content, is_search, maybe address); one error row for a document that is none or has no entry."""
    fresh = F.col("published").isNull() | (F.col("published") >= F.date_sub(today, CUTOFF_DAYS))
    cleaned = _documents(documents).withColumns({"title": plain(F.col("title")), "summary": F.when(F.col("is_search"), "").otherwise(plain(plain(F.col("summary"))))})
    return cleaned.filter(F.col("error").isNotNull() | (fresh & _whole()))


def search_items(documents: DataFrame, most: int = SEARCH_ENTRIES) -> DataFrame:
    """Items of a search's answer: of its first entries those with link and title, of any age, with the host of the publisher and no summary.

    An entry without link or title counts among the first, but gives no item. Error rows as in ``feed_items``.
    """
    rows = _documents(documents).filter(F.col("error").isNotNull() | ((F.col("pos") < most) & _whole()))
    return rows.withColumns({"title": plain(F.col("title")), "summary": F.lit(""), "is_search": F.lit(True), "publisher": host(F.col("publisher"))})


def auto_items(documents: DataFrame, pages: DataFrame, today: Column) -> DataFrame:
    """Items of sources that name addresses only: those of their feeds and the links of their pages, each link once.

    ``documents``: source_id, address (its place among the source's addresses), content, is_search: feeds at an address, or found
    on its page. ``pages``: page_id, source_id, address, url, html. Of equal links of a source the first stays: by address,
    feeds before pages, then by place. A feed that is none is passed over; a source without any item gives one error row.
    """
    columns = ("source_id", "address", "kind", "pos", "title", "link", "summary", "published")
    of_feeds = feed_items(documents, today).filter("error is null").withColumn("kind", F.lit(0))
    keys = pages.select("page_id", "source_id", F.col("address").cast("int").alias("address"))
    of_pages = article_links(pages).join(keys, "page_id").withColumns({"kind": F.lit(1), "summary": F.lit("")})
    both = of_feeds.select(*columns).unionByName(of_pages.select(*columns))
    order = F.struct("address", "kind", "pos")
    first = both.groupBy("source_id", "link").agg(F.min_by(F.struct(*[c for c in columns if c not in ("source_id", "link")]), order).alias("r")).select("source_id", "link", "r.*")
    asked = documents.select("source_id").unionByName(pages.select("source_id")).distinct()
    told = asked.join(first, "source_id", "left").withColumn("error", F.when(F.col("link").isNull(), "no item found"))
    return told.select(*columns, "error")


def page_items(pages: DataFrame, today: Column) -> DataFrame:
    """The item that a page is itself, as added by hand: page_id, link, title, published (today), error if it has no title of eight signs."""
    title = page_title(F.col("html"))
    error = F.when(F.char_length("title") < 8, "no title")
    return pages.select("page_id", F.col("url").alias("link"), title.alias("title"), today.alias("published")).withColumn("error", error)


def listed_items(pages: DataFrame, selector: str, most: int = 60) -> DataFrame:
    """Items of list pages (page_id, url, html) by a CSS selector: the link that a found element is, or the first one inside it.

    Only the first ``most`` elements count. Of equal links of a page the first stays; a page without any element gives an error row.
    """
    found = selected(pages, selector)
    first = found.withColumn("n", F.row_number().over(Window.partitionBy("page_id").orderBy("pos"))).filter(F.col("n") <= most)
    a = F.when(F.col("tag") == "a", F.col("outer")).otherwise(F.regexp_extract("outer", r"(?is)(<a(?:\s[^>]*)?>.*?(?:</a>|$))", 1))
    href = F.btrim(unescaped(F.regexp_extract("a", r"(?is)^<a\s[^>]*?href=[\"']?([^\"'>\s]*)", 1)))
    told = pages.select("page_id", "url").join(first.withColumn("a", a), "page_id", "left").withColumn("href", href)
    titled = told.withColumn("t", dated_title(F.coalesce(F.nullif(plain(F.col("a")), F.lit("")), plain(F.col("outer")))))
    rows = titled.select("page_id", "pos", absolute(F.col("href"), F.col("url")).alias("link"), "t.title", "t.published", F.when(F.col("outer").isNull(), "no element matches").alias("error"), "href")
    kept = rows.filter(F.col("error").isNotNull() | ((F.col("href") != "") & (F.char_length("title") >= 8))).drop("href")
    kept = kept.withColumn("n", F.row_number().over(Window.partitionBy("page_id", "link").orderBy("pos")))
    return kept.filter(F.col("error").isNotNull() | (F.col("n") == 1)).drop("n")

"""Pages and links as columns: anchors, titles, meta texts, feeds, main paragraphs, hosts, news links."""

from __future__ import annotations

from html.entities import name2codepoint

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from festa.functions import lexicon
from festa.functions.text import let, squeezed

# What is no article, what is a feed, and how a date ends a title.
SKIP_LINK = r"(?i)^(javascript|mailto|tel):|#|/(tag|tags|search|tim-kiem|rss|login|dang-nhap|lien-he|gioi-thieu|video|photo)(/|$|\?)"
FEED_LINK = r"(?i)(\.rss(\?.*)?$|rss\.xml$|/feed/?$|/rss/[^/]+\.(rss|xml)$|/rss/[^/]+/?$)"
TAIL_DATE = r"\s+(\d{1,2})/(\d{1,2})/(\d{4})(?:\s+\d+)?\s*$"
NO_TEXT_TAGS = ("script", "style", "nav", "footer", "header", "aside", "form", "noscript")


# The named references of HTML 4, as the standard library lists them: name, code point.
_NAMED = ",".join(f"{name}={code}" for name, code in name2codepoint.items()) + ",apos=39"
_REFERENCE = r"^(#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[a-zA-Z][a-zA-Z0-9]*);"


def unescaped(text: Column) -> Column:
    """Character references (decimal, hexadecimal, the named ones of HTML 4) as their signs, each once; unknown ones stay."""

    def sign(part: Column) -> Column:
        reference = F.regexp_extract(part, _REFERENCE, 1)
        hexadecimal = F.conv(F.substring(reference, 3, 6), 16, 10).cast("int")
        named = F.element_at(F.str_to_map(F.lit(_NAMED), F.lit(","), F.lit("=")), reference).cast("int")
        code = F.when(reference.rlike("^#[xX]"), hexadecimal).when(reference.startswith("#"), F.substring(reference, 2, 7).cast("int")).when(reference != "", named)
        valid = F.when((code == 0) | code.between(0xD800, 0xDFFF) | (code > 0x10FFFF), 0xFFFD).otherwise(code)
        shown = lambda c: F.coalesce(F.decode(F.unhex(F.lpad(F.hex(c), 8, "0")), "UTF-32"), F.lit(""))
        known = F.concat(let(valid, shown), F.regexp_replace(part, _REFERENCE, ""))
        return F.when(code.isNotNull(), known).otherwise(F.concat(F.lit("&"), part))

    def decoded(parts: Column) -> Column:
        return F.concat(F.get(parts, F.lit(0)), F.array_join(F.transform(F.slice(parts, F.lit(2), F.size(parts)), sign), ""))

    return let(text, lambda t: F.when(F.contains(t, F.lit("&")), let(F.split(t, "&", -1), decoded)).otherwise(t))


def plain(html: Column) -> Column:
    """Tags become blanks, character references signs, white space single."""
    return squeezed(unescaped(F.regexp_replace(F.coalesce(html, F.lit("")), "<[^>]*>", " ")))


def host(url: Column) -> Column:
    return F.regexp_replace(F.lower(F.coalesce(F.try_parse_url(url, F.lit("HOST")), F.lit(""))), r"^www\.", "")


def absolute(link: Column, base: Column) -> Column:
    """A link against its page's address, without fragment."""
    root = F.regexp_extract(base, r"^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)", 1)
    folder = F.regexp_extract(F.regexp_replace(base, r"[?#].*$", ""), r"^([a-zA-Z][a-zA-Z0-9+.-]*://[^/]*(?:/.*/|/|))", 1)
    full = (
        F.when(link.rlike(r"^[a-zA-Z][a-zA-Z0-9+.-]*:"), link)
        .when(link.startswith("//"), F.concat(F.regexp_extract(base, "^([^:]+:)", 1), link))
        .when(link.startswith("/"), F.concat(root, link))
        .otherwise(F.concat(F.when(folder.endswith("/"), folder).otherwise(F.concat(folder, F.lit("/"))), link))
    )
    return F.regexp_replace(full, "#.*$", "")


def anchors(pages: DataFrame) -> DataFrame:
    """page_id, url, pos, href, title: every link with text, in page order."""
    found = F.regexp_extract_all("html", F.lit(r"(?is)(<a\s[^>]*href=.*?</a>)"), F.lit(1))
    rows = pages.select("page_id", "url", F.posexplode(found).alias("pos", "a"))
    href = F.btrim(F.regexp_extract("a", r"(?is)^<a\s[^>]*?href=[\"']?([^\"'>\s]*)", 1))
    named = F.regexp_extract("a", r"(?is)^<a\s[^>]*?title=\"([^\"]*)\"", 1)
    text = plain(F.regexp_extract("a", r"(?is)^<a\s[^>]*>(.*)</a>$", 1))
    return rows.select("page_id", "url", "pos", href.alias("href"), F.when(text != "", text).otherwise(F.btrim(named)).alias("title"))


def dated_title(title: Column) -> Column:
    """struct(title, published): a date that ends the title is taken off, valid or not."""
    has = title.rlike(TAIL_DATE)
    part = lambda i: F.regexp_extract(title, TAIL_DATE, i)
    return F.struct(F.when(has, F.btrim(F.regexp_replace(title, TAIL_DATE, ""))).otherwise(title).alias("title"), F.when(has, F.try_to_date(F.concat_ws("-", part(3), part(2), part(1)), "y-M-d")).alias("published"))


def article_links(pages: DataFrame, most: int = 80) -> DataFrame:
    """Links that look like articles: same site, a long path with a number or page suffix, a title of four words; the first of each link, up to ``most`` a page."""
    rows = anchors(pages).filter(~F.col("href").rlike(SKIP_LINK)).withColumn("link", absolute(F.col("href"), F.col("url")))
    path, own, its = F.coalesce(F.try_parse_url("link", F.lit("PATH")), F.lit("")), host(F.col("url")), host(F.col("link"))
    near = (its == own) | its.endswith(F.concat(F.lit("."), own))
    article = (F.char_length(F.btrim(path, F.lit("/"))) >= 10) & (path.rlike(r"\d") | F.lower(path).rlike(r"\.(html|htm|aspx|chn)$"))
    told = rows.filter(near & article).withColumn("t", dated_title(F.col("title"))).select("page_id", "pos", "link", "t.*")
    told = told.filter((F.char_length("title") >= 20) & (F.size(F.split("title", r"\s+")) >= 4))
    first = told.withColumn("n", F.row_number().over(Window.partitionBy("page_id", "link").orderBy("pos"))).filter("n = 1")
    return first.withColumn("n", F.row_number().over(Window.partitionBy("page_id").orderBy("pos"))).filter(F.col("n") <= most).drop("n")


def feeds(html: Column, base: Column, most: int = 3) -> Column:
    """Addresses of feeds: announced ones, then links that look like one; the first ``most``."""
    links = F.regexp_extract_all(html, F.lit(r"(?is)(<link\s[^>]*>)"), F.lit(1))
    announced = F.filter(links, lambda x: x.rlike(r"(?i)rel=[\"']?[^\"'>]*alternate") & x.rlike(r"(?i)type=[\"']?[^\"'>]*(rss|atom)"))
    linked = F.filter(F.regexp_extract_all(html, F.lit(r"(?is)<a\s[^>]*?href=[\"']?([^\"'>\s]*)"), F.lit(1)), lambda x: x.rlike(FEED_LINK) & ~F.contains(F.lower(x), F.lit("rss.html")))
    all_ = F.concat(F.transform(announced, lambda x: F.regexp_extract(x, r"(?is)href=[\"']?([^\"'>\s]*)", 1)), linked)
    return F.slice(F.array_distinct(F.transform(F.filter(all_, lambda x: x != ""), lambda x: absolute(x, base))), 1, most)


def meta(html: Column, name: str) -> Column:
    """The content of a meta element, in either order of its attributes; null if none."""
    key = rf"(?:property|name)=[\"']{name}[\"']"
    forward = F.regexp_extract(html, rf"(?is)<meta\s[^>]*{key}[^>]*content=\"([^\"]*)\"", 1)
    backward = F.regexp_extract(html, rf"(?is)<meta\s[^>]*content=\"([^\"]*)\"[^>]*{key}", 1)
    return F.nullif(squeezed(F.when(forward != "", forward).otherwise(backward)), F.lit(""))


def page_title(html: Column) -> Column:
    part = lambda tag: F.nullif(plain(F.regexp_extract(html, rf"(?is)<{tag}[^>]*>(.*?)</{tag}>", 1)), F.lit(""))
    return F.coalesce(meta(html, "og:title"), part("h1"), part("title"), F.lit(""))


def main_text(html: Column) -> Column:
    """Paragraphs over 25 characters of the article; if these are short, its lines up to a closing mark, if longer."""
    bare = F.coalesce(html, F.lit(""))
    for tag in NO_TEXT_TAGS:
        bare = F.regexp_replace(bare, rf"(?is)<{tag}\b[^>]*>.*?</{tag}>", "")
    article = F.regexp_extract(bare, r"(?is)<article\b[^>]*>(.*?)(?:</article>|$)", 1)
    root = F.when(article != "", article).otherwise(bare)
    long = lambda xs: F.filter(F.transform(xs, plain), lambda x: F.char_length(x) > 25)
    paragraphs = F.array_join(long(F.regexp_extract_all(root, F.lit(r"(?is)<p\b[^>]*>(.*?)(?=</p>|<p\b|$)"), F.lit(1))), "\n")
    lines = F.transform(F.split(F.regexp_replace(root, r"(?s)<[^>]*>", "\n"), "\n"), plain)
    marks = "|".join(lexicon.END_MARKERS)
    stop = F.array_position(F.transform(lines, lambda x: F.lower(x).rlike(f"^(?:{marks})") & (F.char_length(x) < 40)), True)
    kept = F.when(stop > 0, F.slice(lines, F.lit(1), (stop - 1).cast("int"))).otherwise(lines)
    by_line = F.array_join(F.array_distinct(F.filter(kept, lambda x: F.char_length(x) > 25)), "\n")
    return F.when((F.char_length(paragraphs) < 600) & (F.char_length(by_line) > F.char_length(paragraphs)), by_line).otherwise(paragraphs)


def article_text(html: Column, most: int = 8000) -> Column:
    """Descriptions, then the main text; at most 8000 characters."""
    told = F.array_join(F.array_distinct(F.filter(F.array(meta(html, "og:description"), meta(html, "description")), lambda x: x.isNotNull())), "\n")
    return F.substring(F.when(told != "", F.concat(told, F.lit("\n"), main_text(html))).otherwise(main_text(html)), 1, most)


def news_link(url: Column, aggregator: str = "news.google.com") -> Column:
    """struct(link, online): the article behind an aggregator's link if the link itself tells; ``online`` if only the network can."""
    ours = F.contains(url, F.lit(aggregator))
    key = F.regexp_extract(F.coalesce(F.try_parse_url(url, F.lit("PATH")), F.lit("")), "/(?:articles|read)/([^/]+)/?$", 1)
    param = F.try_url_decode(F.regexp_extract(url, "[?&]url=([^&]+)", 1))
    padded = F.concat(F.translate(key, "-_", "+/"), F.repeat(F.lit("="), F.pmod(-F.char_length(key), F.lit(4))))
    raw = F.decode(F.try_to_binary(padded, F.lit("base64")), "ISO-8859-1")
    inner = F.regexp_extract(raw, r"(https?://[^\s\x00-\x1f\x7f-\xff\"<>]+)", 1)
    valid = lambda u: F.when(u.startswith("http") & ~F.contains(u, F.lit(aggregator)), F.btrim(u))
    found = F.when(~ours, url).when(key == "", valid(param)).otherwise(valid(inner))
    return F.struct(found.alias("link"), (ours & (key != "") & found.isNull()).alias("online"))

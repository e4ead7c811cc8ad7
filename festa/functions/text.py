"""Text columns: normalisation, phrase matching, titles, summaries, messages. All expressions stay in the JVM."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from festa.functions import lexicon

#: Flags for patterns over Vietnamese text: Unicode case folding and classes.
IU, U = "(?iuU)", "(?uU)"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value computed once, however often the body names it; the optimizer does not inline it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


@cache
def _folding() -> tuple[str, str]:
    """Accented letters and the ASCII letters they fold to."""
    source, target = ["đ", "Đ"], ["d", "d"]
    for code in range(0xC0, 0x1F00):
        base = unicodedata.normalize("NFD", chr(code))
        if len(base) > 1 and base[0].isascii() and base[0].isalpha():
            source.append(chr(code))
            target.append(base[0].lower())
    return "".join(source), "".join(target)


def normalize(text: Column) -> Column:
    """Lower case without accents; every run of other signs than a-z and 0-9 is one blank. Null reads as empty."""
    source, target = _folding()
    folded = F.lower(F.translate(F.regexp_replace(F.coalesce(text, F.lit("")), r"\p{Mn}", ""), source, target))
    return F.trim(F.regexp_replace(folded, "[^a-z0-9]+", " "))


def padded(normalized: Column) -> Column:
    return F.concat(F.lit(" "), normalized, F.lit(" "))


def phrases(words: tuple[str, ...]) -> Column:
    return F.split(F.lit("|".join(words)), r"\|")


def hits(normalized: Column, words: tuple[str, ...]) -> Column:
    """The phrases that stand in the text between word ends, in the order of the list, repeats kept."""
    return let(padded(normalized), lambda n: F.filter(phrases(words), lambda k: F.contains(n, padded(k))))


@cache
def one_of(words: tuple[str, ...], edge: str = "") -> str:
    """A pattern for any of the words (plain signs), the longest that ``edge`` follows; common beginnings are tried once."""

    def node(rest: frozenset[str]) -> str:
        branches = [re.escape(c) + node(frozenset(w[1:] for w in rest if w[:1] == c)) for c in sorted({w[0] for w in rest if w})]
        branches += [edge] if "" in rest else []
        return branches[0] if len(branches) == 1 else f"(?:{'|'.join(branches)})"

    return node(frozenset(words))


def has_any(normalized: Column, words: tuple[str, ...]) -> Column:
    """One pattern decides; nothing is listed."""
    return padded(normalized).rlike(f" {one_of(tuple(words), ' ')}")


def has_any_start(normalized: Column, words: tuple[str, ...]) -> Column:
    """As ``has_any``, but a phrase may go on."""
    return padded(normalized).rlike(f" {one_of(tuple(words))}")


def keyword_hits(text: Column) -> Column:
    return hits(normalize(text), lexicon.STRONG + lexicon.WEAK)


def strong_hits(text: Column) -> Column:
    return hits(normalize(text), lexicon.STRONG)


def has_negative(title: Column) -> Column:
    return has_any(normalize(title), lexicon.NEGATIVE)


def is_preparing(title: Column) -> Column:
    return has_any(normalize(title), lexicon.PREPARING)


def is_cultural_event(title: Column, body: Column, crowd: Column, fireworks: Column, concert: Column) -> Column:
    lead = F.substring(F.coalesce(body, F.lit("")), 1, 800)
    large = (F.coalesce(crowd, F.lit(0)) >= 2000) | fireworks | concert
    return let(normalize(title), lambda head: _cultural(head, normalize(lead), large))


def _cultural(head: Column, lead: Column, large: Column) -> Column:
    return ~has_any(head, lexicon.NEGATIVE) & (has_any(head, lexicon.STRONG) | has_any(lead, lexicon.STRONG) | (has_any(head, lexicon.WEAK) & large))


def is_bulletin(title: Column, url: Column) -> Column:
    last = F.lower(F.regexp_extract(F.rtrim(F.coalesce(F.try_parse_url(url, F.lit("PATH")), F.lit("")), F.lit("/")), "[^/]*$", 0))
    marks = "|".join(p.replace(" ", "-") for p in lexicon.BULLETIN)
    return has_any(normalize(title), lexicon.BULLETIN) | last.rlike(f"(?:^|-)(?:{marks})(?:-|$)")


def not_vietnamese(text: Column) -> Column:
    trimmed = F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)^\s+|\s+$", "")
    return (F.char_length(trimmed) >= 30) & ~trimmed.rlike(f"(?iu)[{lexicon.VIETNAMESE_LETTERS}]")


def squeezed(text: Column) -> Column:
    """White space as single blanks, none at the ends."""
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)\s+", " "))


def strip_signs(text: Column, signs: str) -> Column:
    return F.btrim(text, F.lit(signs))


def clean_title(title: Column) -> Column:
    """Without publisher tail, media prefix and quotes; at most 160 characters."""
    tail = lambda t: F.regexp_replace(t, r"\s+[-|–—]\s+[^-|–—]{2,40}$", "")
    t = let(squeezed(title), lambda t: F.when(t.rlike(r"\s[-|–—]\s") & (F.char_length(t) > 40), tail(t)).otherwise(t))
    t = F.regexp_replace(t, IU + r"^(ảnh|video|clip|infographic|trực tiếp|photo)\s*[:\-]\s*", "")
    return F.substring(strip_signs(t, " \"'“”"), 1, 160)


_NAME_PREFIX = IU + r"^(?:(?:hoàn tất|khẩn trương|tất bật|rộn ràng|nhộn nhịp|háo hức)\s+)?(?:(?:công tác|việc)\s+)?(?:chuẩn bị|sẵn sàng|chờ đón|đón chờ)(?:\s+cho)?\s+"
_NAME_SUFFIX = IU + r"\s*[,:\-–]?\s*(?:trước|vào|từ|diễn ra|sẽ diễn ra|sắp diễn ra)\s+(?:ngày\s+)?\d.*$"


def canonical_name(name: Column) -> Column:
    """Without words of preparation and a date at the end, first letter upper; unchanged if under 8 characters are left."""
    own = F.btrim(F.coalesce(name, F.lit("")))
    n = strip_signs(F.regexp_replace(F.regexp_replace(own, _NAME_PREFIX, ""), _NAME_SUFFIX, ""), " ,:-–")
    return F.when(F.char_length(n) >= 8, F.concat(F.upper(F.substring(n, 1, 1)), F.substring(n, F.lit(2), F.char_length(n)))).otherwise(own)


def make_summary(text: Column) -> Column:
    """The first sentence of 40 characters or more, up to 220 of them; else the start of the text."""
    own = F.coalesce(text, F.lit(""))
    sentences = F.transform(F.split(own, r"(?<=[.!?])\s+|\n+"), lambda s: F.btrim(s, F.lit(" \t\n\r")))
    first = F.get(F.filter(sentences, lambda s: F.char_length(s) >= 40), F.lit(0))
    return F.substring(F.coalesce(first, F.btrim(own, F.lit(" \t\n\r"))), 1, 220)


_STAMP = IU + r"(?=\d)(?:\b\d{1,2}[:h]\d{2}\s*(?:,|-|–)?\s*(?:ngày\s*)?\d{1,2}/\d{1,2}/\d{4}\b|\b\d{1,2}/\d{1,2}/\d{4}\s*(?:,|-|–)?\s*\d{1,2}[:h]\d{2}\b)"


def strip_stamps(text: Column) -> Column:
    """Publication stamps (time and full date together) become blanks."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), _STAMP, " ")


def split_message(text: Column, limit: int = 3900) -> Column:
    """Parts of at most ``limit`` characters, cut between blocks (blank lines); a longer block is cut hard."""
    pieces = F.flatten(F.transform(F.split(text, "\n\n"), lambda b: F.transform(F.sequence(F.lit(0), F.greatest(F.ceil(F.char_length(b) / limit) - 1, F.lit(0))), lambda i: F.struct(F.substring(b, (i * limit + 1).cast("int"), F.lit(limit)).alias("t"), ((i + 1) * limit < F.char_length(b)).alias("full")))))
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open"))

    def add(acc: Column, p: Column) -> Column:
        closed = F.when(acc["open"] != "", F.concat(acc["done"], F.array(acc["open"]))).otherwise(acc["done"])
        joined = F.when(acc["open"] == "", p["t"]).otherwise(F.concat(acc["open"], F.lit("\n\n"), p["t"]))
        over = (F.char_length(acc["open"]) + F.char_length(p["t"]) + 2 > limit) & (acc["open"] != "")
        return (
            F.when(p["full"], F.struct(F.concat(closed, F.array(p["t"])).alias("done"), F.lit("").alias("open")))
            .when(over, F.struct(closed.alias("done"), p["t"].alias("open")))
            .otherwise(F.struct(acc["done"].alias("done"), joined.alias("open")))
        )

    parts = F.aggregate(pieces, start, add, lambda acc: F.when(acc["open"] != "", F.concat(acc["done"], F.array(acc["open"]))).otherwise(acc["done"]))
    return F.when(F.char_length(text) <= limit, F.array(text)).otherwise(parts)


def masked_links(text: Column) -> Column:
    """At most 140 characters of an error text, links masked."""
    return F.substring(F.regexp_replace(text, r"https?://\S+", "<url>"), 1, 140)


def parsed_command(text: Column) -> Column:
    """struct(cmd, arg): "/cmd@bot arg" is split; other text has the empty command."""
    t = F.btrim(F.coalesce(text, F.lit("")), F.lit(" \t\n\r"))
    first = F.regexp_extract(t, r"^/([^ ]*)", 1)
    cmd = F.when(t.startswith("/"), F.lower(F.substring_index(first, "@", 1))).otherwise("")
    arg = F.when(t.startswith("/"), F.btrim(F.regexp_extract(t, r"(?s)^/[^ ]* (.*)$", 1), F.lit(" \t\n\r"))).otherwise(t)
    return F.struct(cmd.alias("cmd"), arg.alias("arg"))

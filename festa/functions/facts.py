"""Facts in running text: crowds, fireworks, concerts, venues, wards; and priorities from them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from festa.functions import lexicon
from festa.functions.geo import OWN_ALL
from festa.functions.text import IU, U, has_any, has_any_start, let, normalize, strip_signs

LARGE_CROWD = 10_000

# How crowds are written.
_NOUNS = "lượt hành khách|hành khách|người|lượt khách|lượt du khách|lượt người|khán giả|du khách|vận động viên|vđv|thí sinh|tín đồ|khách"
_ANNUAL = r"\W{0,3}(?:cả năm|mỗi năm|trong năm|năm\s*\d{4}|hằng năm|hàng năm)"
_NUMBER = r"(\d{1,3}(?:[.,]\d{3})+|\d+(?:[.,]\d+)?)"
_CROWD = IU + rf"(?=\d){_NUMBER}\s*(nghìn|ngàn|triệu|vạn)?\s*(?:{_NOUNS})(?=({_ANNUAL})?)"
_WORDED = IU + r"hàng\s+(chục\s+nghìn|chục\s+ngàn|vạn|trăm\s+nghìn|trăm\s+ngàn|triệu)\s*(?:người|lượt|khán giả|du khách|khách)"
_FIREWORKS = ("pháo hoa", "bắn pháo", "trình diễn pháo", "màn pháo")
_CONCERTS = ("đại nhạc hội", "concert", "countdown", "music festival", "lễ hội âm nhạc", "đại hội âm nhạc", "đêm nhạc hội")
_DENIALS = ("không", "cấm", "dừng", "hủy", "bỏ", "thay bằng", "thay thế")


def _value(words: dict[str, int], key: Column, default: int) -> Column:
    out = F.lit(default)
    for word, value in words.items():
        out = F.when(key == word, value).otherwise(out)
    return out


def find_crowd(text: Column) -> Column:
    """The largest crowd from 100 to 3,000,000 that is not a figure for a year, or a worded one; null if none."""
    own = F.coalesce(text, F.lit(""))
    marked = F.regexp_replace(own, _CROWD, "\u0002$1\u0001$2\u0001$3\u0003")

    def count(part: Column) -> Column:
        plain = F.when(part[0].rlike(r"^\d{1,3}(?:[.,]\d{3})+$"), F.regexp_replace(part[0], "[.,]", "")).otherwise(F.regexp_replace(part[0], ",", "."))
        value = F.floor(plain.try_cast("double") * _value(lexicon.UNITS, F.lower(part[1]), 1))
        return let(value, lambda v: F.when((part[2] == "") & v.between(100, 3_000_000), v))

    parts = F.transform(F.regexp_extract_all(marked, F.lit("\u0002([^\u0003]*)\u0003"), F.lit(1)), lambda s: F.split(s, "\u0001", -1))
    counted = F.transform(parts, count)
    worded = F.transform(F.regexp_extract_all(own, F.lit(_WORDED), F.lit(1)), lambda w: _value(lexicon.WORD_CROWDS, F.regexp_replace(F.lower(w), r"\s+", " "), 0).cast("bigint"))
    return F.nullif(F.array_max(F.concat(F.filter(counted, lambda x: x.isNotNull()), worded)), F.lit(0)).cast("int")


def _stated(text: Column, words: tuple[str, ...]) -> Column:
    """Some mention of a word has no denial in the 25 characters before it."""
    free = "".join(f"(?<!{d}.{{0,{25 - len(d)}}})" for d in _DENIALS)
    # the mention first: the text before it is looked at only where one stands
    return F.coalesce(text, F.lit("")).rlike(f"(?siuU)(?={'|'.join(words)}){free}")


def has_fireworks(text: Column) -> Column:
    return _stated(text, _FIREWORKS)


def has_big_concert(text: Column) -> Column:
    return _stated(text, _CONCERTS)


def valid_venue(venue: Column) -> Column:
    """A place of its own: a square, a pagoda, a ward; not a province, an authority or a name under 3 characters."""
    return let(strip_signs(F.coalesce(venue, F.lit("")), " ,:"), lambda v: let(normalize(v), lambda n: _valid(v, n)))


def _valid(v: Column, n: Column) -> Column:
    bad = (F.char_length(v) < 3) | n.isin(*OWN_ALL) | n.rlike(f"^(?:{'|'.join(lexicon.NOT_VENUES)})")
    head = F.get(F.split(v, r"\s+"), F.lit(0)).isin(*lexicon.VENUE_HEADS)
    return ~bad & (head | n.startswith("trung tam") | v.rlike(IU + r"\b(?:phường|xã|thị trấn|đặc khu|đường|số\s*\d)"))


def _words(text: Column) -> Column:
    return F.filter(F.split(text, r"(?U)\s+"), lambda w: w != "")


def _upper_first(word: Column, digits: bool = False) -> Column:
    return word.rlike(r"^[\p{Lu}\p{Lt}]" if not digits else r"^[\p{Lu}\p{Lt}\p{Nd}]")


def _leading(words: Column, stops) -> Column:
    """The words before the first for which ``stops`` holds."""
    first = F.array_position(F.transform(words, lambda w: stops(w)), True)
    return F.when(first > 0, F.slice(words, F.lit(1), (first - 1).cast("int"))).otherwise(words)


def find_venue(text: Column) -> Column:
    """After "địa điểm:"; else the first valid name after "tại", up to 8 words and no stop word. At most 100 characters."""
    own = F.coalesce(text, F.lit(""))
    labelled = F.regexp_extract(own, IU + r"địa điểm\s*[:：-]\s*([^\n.;]{3,100})", 1)
    named = F.transform(
        F.filter(F.transform(F.regexp_extract_all(own, F.lit(U + r"(?=t)\btại\s+([^,.;\n()]{3,100})"), F.lit(1)), _words), lambda w: _upper_first(F.get(w, F.lit(0)))),
        lambda w: F.array_join(F.slice(_leading(w, lambda t: t.isin(*lexicon.VENUE_STOPS)), 1, 8), " "),
    )
    first = F.get(F.filter(named, valid_venue), F.lit(0))
    return F.substring(F.when(valid_venue(labelled), strip_signs(labelled, " ,:")).otherwise(F.coalesce(first, F.lit(""))), 1, 100)


def find_ward(text: Column) -> Column:
    """The first ward with a name: its type in lower case and up to three capitalised words."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(U + r"(?=[pxtđPX])\b((?:phường|xã|thị trấn|đặc khu|Phường|Xã)\s+[^\s,.;()]+(?:\s+[^\s,.;()]+){0,2})"), F.lit(1))

    def ward(s: Column) -> Column:
        kind = F.regexp_extract(s, U + r"^(phường|xã|thị trấn|đặc khu|Phường|Xã)", 1)
        name = _leading(_words(F.substring(s, F.char_length(kind) + 1, F.char_length(s))), lambda w: ~_upper_first(w, digits=True))
        return F.when(F.size(name) > 0, F.concat(F.lower(kind), F.lit(" "), F.array_join(name, " ")))

    return F.coalesce(F.get(F.filter(F.transform(found, ward), lambda x: x.isNotNull()), F.lit(0)), F.lit(""))


def venue_and_ward(text: Column) -> Column:
    """The venue, with the ward if it does not name it; the ward alone if there is no venue."""

    def joined(x: Column) -> Column:
        venue, ward = x["venue"], x["ward"]
        both = (venue != "") & (ward != "") & ~F.contains(normalize(venue), normalize(ward))
        return F.when(both, F.concat(venue, F.lit(", "), ward)).when(venue == "", ward).otherwise(venue)

    return let(F.struct(find_venue(text).alias("venue"), find_ward(text).alias("ward")), joined)


def is_large(crowd: Column, fireworks: Column, concert: Column, limit: int = LARGE_CROWD) -> Column:
    return (F.coalesce(crowd, F.lit(0)) >= limit) | fireworks | concert


def is_traditional(name: Column, venue: Column) -> Column:
    return has_any(normalize(F.concat_ws(" ", name, venue)), lexicon.TRADITIONAL)


def priority(name: Column, venue: Column, crowd: Column, fireworks: Column, concert: Column, limit: int = LARGE_CROWD) -> Column:
    """CAO, TB or THAP from size, place and kind."""
    return let(normalize(F.concat_ws(" ", name, venue)), lambda n: _ranked(n, F.coalesce(crowd, F.lit(0)), is_large(crowd, fireworks, concert, limit)))


def _ranked(n: Column, size: Column, large: Column) -> Column:
    sensitive = has_any_start(n, lexicon.SENSITIVE)
    return (
        F.when(large | ((size >= 5000) & sensitive), "CAO")
        .when(has_any(n, lexicon.TRADITIONAL) | (size >= 1000) | sensitive | has_any(n, lexicon.MIDDLE), "TB")
        .otherwise("THAP")
    )


def search_text(name: Column, venue: Column, summary: Column, province: Column) -> Column:
    return normalize(F.concat_ws(" ", F.coalesce(name, F.lit("")), F.coalesce(venue, F.lit("")), F.coalesce(summary, F.lit("")), F.coalesce(province, F.lit(""))))

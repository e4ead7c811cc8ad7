"""Bytes of a page to text: by its byte order mark, the charset that its server declared, or the bytes themselves."""

from __future__ import annotations

import codecs
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

#: Byte order marks, longest first, and the codecs that read past them.
MARKS = ((codecs.BOM_UTF32_LE, "utf-32"), (codecs.BOM_UTF32_BE, "utf-32"), (codecs.BOM_UTF8, "utf-8-sig"), (codecs.BOM_UTF16_LE, "utf-16"), (codecs.BOM_UTF16_BE, "utf-16"))
#: Declared charsets that say nothing: what servers send when they do not know.
VAGUE = ("", "iso-8859-1", "latin-1", "latin1", "ascii", "us-ascii")
#: In windows-1258, tone marks (they follow a vowel) and letters of Vietnamese that are rare signs in western charsets.
TONES, LETTERS = frozenset((0xCC, 0xD2, 0xDE, 0xEC, 0xF2)), frozenset((0xD0, 0xF0, 0xD5, 0xF5, 0xDD, 0xFD))
VOWELS = frozenset(b"aeiouyAEIOUY" + bytes((0xC2, 0xE2, 0xCA, 0xEA, 0xD4, 0xF4, 0xC3, 0xE3, 0xD5, 0xF5, 0xDD, 0xFD)))
#: Share of high bytes that must be such for a text to be windows-1258, and share of zero bytes at one parity for UTF-16.
VIETNAMESE, ZEROS = 0.3, 0.4


def guessed(content: bytes) -> str:
    """The charset that the bytes look like: UTF-16 without a mark, UTF-8 if they are whole in it, windows-1258 or -1252."""
    half = len(content) // 2
    if half >= 2:
        even, odd = content[0::2].count(0) / half, content[1::2].count(0) / half
        if max(even, odd) >= ZEROS and min(even, odd) < ZEROS / 4:
            return "utf-16-le" if odd > even else "utf-16-be"
    try:
        content.decode("utf-8")
        return "utf-8"
    except UnicodeDecodeError as e:
        if e.start >= len(content) - 3 and e.reason == "unexpected end of data" and (e.start < len(content) - 1 or not content[: e.start].isascii()):
            return "utf-8"  # a page that was cut inside its last sign; one high byte at the end alone is a western letter
    high = [i for i, b in enumerate(content) if b >= 0x80]
    told = sum(content[i] in LETTERS or (content[i] in TONES and i > 0 and content[i - 1] in VOWELS) for i in high)
    if told >= VIETNAMESE * len(high):
        return "windows-1258"
    # most high bytes begin or continue sequences of UTF-8: it is UTF-8 with some damage
    whole = len([c for c in content.decode("utf-8", "ignore") if c > "\x7f"])
    return "utf-8" if 3 * whole >= len(high) else "windows-1252"


def charset_of(content: bytes, declared: str | None) -> str:
    mark = next((name for sign, name in MARKS if content.startswith(sign)), None)
    if mark:
        return mark
    name = (declared or "").strip().strip("\"'").lower()
    if name not in VAGUE:
        try:
            return codecs.lookup(name).name
        except LookupError:
            return "utf-8"
    return guessed(content)


def text_of(content: bytes, declared: str | None = None) -> str:
    """Text in composed form; what the charset cannot read is U+FFFD."""
    return unicodedata.normalize("NFC", bytes(content).decode(charset_of(bytes(content), declared), errors="replace"))


@F.pandas_udf(StructType([StructField("text", StringType()), StructField("charset", StringType())]))
def _decoded(contents: pd.Series, declared: pd.Series) -> pd.DataFrame:
    rows = [(None, None) if c is None else (text_of(c, d), charset_of(bytes(c), d)) for c, d in zip(contents, declared, strict=True)]
    return pd.DataFrame(rows, columns=["text", "charset"])


def declared_charset(content_type: Column) -> Column:
    """The charset that a content type names, or the empty text."""
    return F.regexp_extract(F.coalesce(content_type, F.lit("")), r"(?i)charset\s*=\s*[\"']?([\w.:-]+)", 1)


def decoded(content: Column, content_type: Column | None = None) -> Column:
    """text and charset of the bytes (null for null), with the server's content type if there is one."""
    return _decoded(content, F.lit("") if content_type is None else declared_charset(content_type))

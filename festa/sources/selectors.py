"""Elements of pages as rows, and CSS selectors as conditions on them.

One scan of a page yields its elements with their path: a segment for each element from the root down, each with its tag
and the attributes asked for. A selector then is one pattern over that path (a child is the next segment, a descendant
any later one), so that a page is read once, nothing is joined, and Spark filters the rows.

Defined results: a null or empty page has no elements; an element that is never closed ends with the one around it, at
last with the page; comments, scripts and styles hold no elements; a selector of a form not listed in ``compiled``
raises ValueError, as a broken one does.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>", re.S)
_ATTRIBUTE = re.compile(r"([^\s=\"'/>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_ELEMENTS = "page_id bigint, pos int, parent int, depth int, tag string, path string, outer string"

_NAME = r"-?[a-zA-Z_\u0080-\uffff][\w\u0080-\uffff-]*"
_SIMPLE = re.compile(
    rf"(?P<tag>\*|{_NAME})|\#(?P<id>{_NAME})|\.(?P<class>{_NAME})|:(?P<place>first-child|nth-child\(\s*(?P<n>\d+)\s*\))|:not\((?P<but>[^()]*)\)|"
    rf"\[\s*(?P<name>{_NAME})\s*(?:(?P<how>[~|^$*]?=)\s*(?:\"(?P<double>[^\"]*)\"|'(?P<single>[^']*)'|(?P<bare>[^\s\]\"']+))\s*(?P<fold>[iI]?)\s*)?\]"
)
_COMPOUND = re.compile(r"(?:[^\s>+~,\[\"'()]|\[(?:[^\]\"']|\"[^\"]*\"|'[^']*')*\]|\([^()]*\))+")


def _asked(name: str, how: str | None, value: str, fold: bool = False) -> str:
    """A look-ahead over one segment: the attribute is there, and its value is as asked."""
    v, rest = re.escape(value), r"[^\x02]*"
    if (how in ("~=", "^=", "$=", "*=") and not value) or (how == "~=" and re.search(r"\s", value)):
        return r"(?!)"  # an empty value is contained in nothing, one with a blank is no single word
    wanted = {
        None: "",
        "=": rf"{v}\x02",
        "~=": rf"(?:{rest}\s)?{v}(?:\s{rest})?\x02",
        "|=": rf"{v}(?:-{rest})?\x02",
        "^=": v,
        "$=": rf"{rest}{v}\x02",
        "*=": rf"{rest}{v}",
    }[how]
    return rf"(?=[^\x01]*\x02{re.escape(name.lower())}={f'(?iu:{wanted})' if fold else wanted})"


def _segment(compound: str, names: set[str], tags: set[str]) -> str:
    at, tag, conditions, without = 0, None, "", ""
    while at < len(compound):
        m = _SIMPLE.match(compound, at)
        if not m or (m["tag"] and at):
            raise ValueError(f"selector not supported: {compound}")
        at = m.end()
        if m["tag"]:
            tag = m["tag"].lower()
        elif m["id"] or m["class"]:
            name = "id" if m["id"] else "class"
            names.add(name)
            conditions += _asked(name, "=" if m["id"] else "~=", m[name])
        elif m["place"]:
            conditions += _asked(":n", "=", m["n"] or "1")
        elif m["but"] is not None:
            without += f"(?!{_segment(m['but'].strip(), names, set())})"
        else:
            names.add(m["name"].lower())
            conditions += _asked(m["name"], m["how"], m["double"] or m["single"] or m["bare"] or "", bool(m["fold"]))
    if not compound:
        raise ValueError("selector without a name")
    tags.add(tag if tag and tag != "*" else "*")
    return without + r"\x01" + conditions + (re.escape(tag) if tag and tag != "*" else r"[^\x01\x02]*") + r"\x02"


def compiled(selector: str) -> tuple[str, tuple[str, ...], tuple[str, ...]]:
    """A pattern over ``path``, the attributes that it reads, and the tags that can match (``*``: any).

    Groups (``,``) of compounds joined by descendant (blank) or child (``>``); a compound is a tag or ``*``, then any of
    ``#id``, ``.class``, ``[a]``, ``[a=v]`` with ``~= |= ^= $= *=`` and ``i``, ``:first-child``, ``:nth-child(k)``, ``:not(compound)``.
    """
    names: set[str] = set()
    last: set[str] = set()
    ways, way, at, text = [], "", 0, selector.strip()
    between: str | None = ""  # what stands between the compound before and the next one
    while at < len(text):
        m = _COMPOUND.match(text, at)
        if not m or between is None:
            raise ValueError(f"selector not supported: {selector}")
        tags: set[str] = set()
        way += between + _segment(m[0], names, tags) + r"[^\x01]*"
        joint = re.compile(r"\s*([>,])\s*|\s+|$").match(text, m.end())
        if joint is None:
            raise ValueError(f"selector not supported: {selector}")
        at = joint.end()
        between = "" if joint[1] == ">" else r"(?:\x01[^\x01]*)*"
        if joint[1] == "," or at == len(text):
            if joint[1] and at == len(text):
                raise ValueError(f"selector not supported: {selector}")
            ways, way, between = [*ways, way], "", ""
            last |= tags
    if not ways:
        raise ValueError("an empty selector")
    return rf"(?s)(?:{'|'.join(ways)})\z", tuple(sorted(names)), ("*",) if "*" in last else tuple(sorted(last))


def _scan(page: str, names: tuple[str, ...], tags: frozenset[str]) -> list[tuple]:
    """(pos, parent, depth, tag, path, start, end) of the elements with one of the tags, in page order."""
    out: list[list] = []
    stack: list[list] = []  # tag, segment, number, children, index in out
    roots, number, at = 0, -1, 0

    def close(down_to: int, end: int) -> None:
        for item in stack[down_to:]:
            if item[4] is not None:
                out[item[4]][6] = end
        del stack[down_to:]

    while m := _TOKEN.search(page, at):
        at = m.end()
        if not m[2]:
            continue
        tag = m[2].lower()
        if m[1]:
            depth = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == tag), None)
            if depth is not None:
                for item in stack[depth + 1 :]:
                    if item[4] is not None:
                        out[item[4]][6] = m.start()
                del stack[depth + 1 :]
                close(depth, at)
            continue
        number += 1
        if stack:
            stack[-1][3] += 1
        else:
            roots += 1
        nth = stack[-1][3] if stack else roots
        found = {a[1].lower(): next((v for v in a.groups()[1:] if v is not None), "") for a in reversed(list(_ATTRIBUTE.finditer(m[3])))} if names else {}
        told = "".join(f"{n}={re.sub(chr(1) + '|' + chr(2), '', html.unescape(found[n]))}\x02" for n in names if n in found)
        segment = f"\x01{tag}\x02:n={nth}\x02{told}"
        index = None
        if "*" in tags or tag in tags:
            index = len(out)
            out.append([number, stack[-1][2] if stack else None, len(stack), tag, "".join(s[1] for s in stack) + segment, m.start(), at if tag in _VOID else len(page)])
        if tag in ("script", "style"):
            ends = re.compile(rf"</{tag}\b[^>]*>", re.I).search(page, at)
            at = ends.end() if ends else len(page)
            if index is not None:
                out[index][6] = at
        elif tag not in _VOID and not m[3].rstrip().endswith("/"):
            stack.append([tag, segment, number, 0, index])
        elif index is not None:
            out[index][6] = at
    return out


def elements(pages: DataFrame, attributes: tuple[str, ...] = ("class", "id"), tags: tuple[str, ...] = ("*",)) -> DataFrame:
    """page_id, pos, parent, depth, tag, path, outer (the element as written) of the pages' elements with one of ``tags``."""
    wanted = frozenset(tags)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for page_id, page in zip(batch.column("page_id").to_pylist(), batch.column("html").to_pylist(), strict=True):
                rows = [(page_id, *row[:5], page[row[5] : row[6]]) for row in _scan(page, attributes, wanted)]
                columns = list(zip(*rows, strict=True)) or [()] * 7
                kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], [c.split(" ")[0] for c in _ELEMENTS.split(", ")])

    return pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.coalesce("html", F.lit("")).alias("html")).mapInArrow(run, _ELEMENTS)


def matches(path: Column, selector: str) -> Column:
    return path.rlike(compiled(selector)[0])


def selected(pages: DataFrame, selector: str) -> DataFrame:
    """The elements of pages (page_id, html) that a selector finds."""
    _, attributes, tags = compiled(selector)
    return elements(pages, attributes, tags).filter(matches(F.col("path"), selector))

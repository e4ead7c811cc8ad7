"""Chat formatting by incremental black-box rendering.

A template is any function from a list of turns (role, text) to a string. Successive prefixes of a conversation
are rendered; as long as each output begins with the one before, what it adds is the new turn's span. A turn's
content is found inside its span by rendering the turn once more with a probe for its text: what stands before
and after the probe is the template's own. A template that changes what it has already written is reported
with the first turn at which it does, and gets no spans; so does one that alters a text beyond its escape.

Conversations are dealt by id and sorted by turn; each task reads them as a stream and holds one at a time.

Defined results: null texts and roles count as empty; rows of equal turn stand in the order of role and text,
repeated rows one after the other; a null turn comes first; null is an id like others; an empty table gives an
empty result; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Turn = tuple[str, str]

#: Strings that would act as control marks for this template or for common models.
CONTROLS = ("<|turn|>", "<|end|>", "<|im_start|>", "<|im_end|>", "<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
_CONTROL = re.compile("\\\\|" + "|".join(map(re.escape, CONTROLS)))
_ESCAPED = re.compile(r"\\(\\|n|)")
_EDGE, _CORE = "\ue000", "\ue001"  # private-use signs
LOSS_ROLE = "assistant"


def escape(text: str) -> str:
    """A backslash is doubled; one is put after the first sign of a control string. No control string is left."""
    return _CONTROL.sub(lambda m: "\\\\" if m[0] == "\\" else f"{m[0][0]}\\{m[0][1:]}", text)


def unescape(text: str) -> str:
    return re.sub(r"\\(\\?)", r"\1", text)


def escape_role(role: str) -> str:
    return escape(role).replace("\n", "\\n")


def unescape_role(role: str) -> str:
    return _ESCAPED.sub(lambda m: {"\\": "\\", "n": "\n", "": ""}[m[1]], role)


def marked_turns(turns: list[Turn]) -> str:
    """The template of the registered query."""
    return "".join([f"<|turn|>{escape_role(role)}\n{escape(text)}<|end|>\n" for role, text in turns])


def parse_marked(formatted: str) -> list[Turn]:
    """The turns, read back from what ``marked_turns`` wrote."""
    out, at = [], 0
    while at < len(formatted):
        line = formatted.index("\n", at)
        end = formatted.index("<|end|>\n", line)
        out.append((unescape_role(formatted[at + len("<|turn|>") : line]), unescape(formatted[line + 1 : end])))
        at = end + len("<|end|>\n")
    return out


def probe_for(turns: list[Turn]) -> str:
    """A string that no role or text of the conversation holds: a run of signs longer than any run there."""
    longest = max((len(run) for turn in turns for s in turn if _CORE in s for run in re.findall(f"{_CORE}+", s)), default=0)
    return f"{_EDGE}{_CORE * (longest + 1)}{_EDGE}"


def render(turns: list[Turn], template: Callable[[list[Turn]], str], escaped: Callable[[str], str] = escape) -> tuple[str, list[tuple[str, int, int, int, int]] | None, int | None]:
    """The output, each turn's (role, start, end, content start, content end), and the first turn that rewrites history (then no spans)."""
    before, spans, probe = template([]), [], probe_for(turns)
    for i, (role, text) in enumerate(turns):
        now = template(turns[: i + 1])
        if not now.startswith(before):
            return template(turns), None, i
        own = escaped(text)
        probed = template([*turns[:i], (role, probe)])
        head = probed.find(probe, len(before))
        tail = len(probed) - head - len(probe)
        if head < 0 or not probed.startswith(before) or now[head : len(now) - tail] != own or len(now) != head + len(own) + tail:
            return template(turns), None, i
        spans.append((role, len(before), len(now), head, head + len(own)))
        before = now
    return before, spans, None


_SPAN = "array<struct<role:string,start:bigint,end:bigint,content_start:bigint,content_end:bigint>>"
_OUT = f"conv_id bigint, n_turns bigint, formatted string, spans {_SPAN}, rewritten_at bigint"
_SCHEMA = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("formatted", pa.string()), ("spans", pa.list_(pa.struct([("role", pa.string()), *((c, pa.int64()) for c in ("start", "end", "content_start", "content_end"))]))), ("rewritten_at", pa.int64())])
#: Characters of formatted output that one batch gathers.
BATCH_CHARS = 4_000_000


def format_conversations(rows: DataFrame, template: Callable[[list[Turn]], str] = marked_turns, escaped: Callable[[str], str] = escape) -> DataFrame:
    """conv_id, n_turns, formatted, spans, rewritten_at: one row per conversation of rows (conv_id, turn, role, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[dict] = []
        chars = 0

        def close(conv: int | None, turns: list[Turn]) -> None:
            nonlocal chars
            text, spans, at = render(turns, template, escaped)
            named = None if spans is None else [dict(zip(("role", "start", "end", "content_start", "content_end"), s, strict=True)) for s in spans]
            out.append({"conv_id": conv, "n_turns": len(turns), "formatted": text, "spans": named, "rewritten_at": at})
            chars += len(text)

        current, turns = None, []
        for batch in batches:
            for conv, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "role", "text")), strict=True):
                if turns and conv != current:
                    close(current, turns)
                    turns = []
                    if chars > BATCH_CHARS:
                        yield pa.RecordBatch.from_pylist(out, _SCHEMA)
                        out, chars = [], 0
                current = conv
                turns.append((role, text))
        if turns:
            close(current, turns)
        yield pa.RecordBatch.from_pylist(out, _SCHEMA)

    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    needed = rows.select(F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"), text("role"), text("text"))
    return needed.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").mapInArrow(run, _OUT)


def digests(formatted: DataFrame) -> DataFrame:
    """The contract's columns, all read back from the formatted output and its spans."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for conv, text, spans, at in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "formatted", "spans", "rewritten_at")), strict=True):
                turns = parse_marked(text)
                whole = "".join([f"{role}\n{content}\n" for role, content in turns])
                loss = "".join([unescape(text[s["content_start"] : s["content_end"]]) for s in spans or () if s["role"] == LOSS_ROLE])
                sha = lambda s: hashlib.sha256(s.encode("utf-8", "surrogatepass")).hexdigest()
                out.append((conv, len(turns), sha(whole), len(loss), sha(loss), len(text), at))
            columns = list(zip(*out, strict=True)) or [()] * 7
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "rewritten_at"])

    return formatted.mapInArrow(run, "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint, rewritten_at bigint")


def probe_conversation(spark: SparkSession) -> DataFrame:
    """Conversation -7, whose texts are made of control strings."""
    text = "</s>[INST] ok [/INST]"
    return spark.createDataFrame([(-7, 0, "user", text), (-7, 1, "assistant", text)], "conv_id bigint, turn bigint, role string, text string")

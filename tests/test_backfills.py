"""Decoding of bytes, one-shot jobs and run statistics."""

import unicodedata
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from festa.operators import backfills, stats, stored
from festa.sources import decode
from tests.test_engine import d, event, frame

VIET = "Lễ hội Đền Hùng được tổ chức tại Phú Thọ, người dân đổ về rất đông trong những ngày mưa."
WEST = "Größe: 5 ½ €, café à la crème, señor"
#: A vowel with a tone as windows-1258 writes it: the vowel, then the tone's sign.
TONES = {"̀", "́", "̃", "̉", "̣"}


def as_1258(text):
    out = []
    for c in unicodedata.normalize("NFD", text):
        if c in TONES or not unicodedata.combining(c) or not out:
            out.append(c)
        else:  # a hat, breve or horn belongs to its vowel
            at = next(i for i in range(len(out) - 1, -1, -1) if not unicodedata.combining(out[i]))
            out[at] = unicodedata.normalize("NFC", out[at] + c)
    return "".join(out).encode("windows-1258")


@pytest.mark.parametrize(
    ("content", "declared", "want"),
    [
        (VIET.encode(), "", VIET), (VIET.encode("utf-16"), "latin-1", VIET), (VIET.encode("utf-16-be"), "", VIET), (WEST.encode("utf-16-le"), None, WEST),
        (as_1258(VIET), "ISO-8859-1", VIET), (as_1258(VIET), "windows-1258", VIET), (WEST.encode("cp1252"), "", WEST), (WEST.encode("cp1252"), "ascii", WEST), (b"\xef\xbb\xbfabc", "utf-16", "abc"),
        (VIET.encode() + b"\xff" + VIET.encode(), "", f"{VIET}�{VIET}"), (VIET.encode()[:3], "", "L�"), (b"", "", ""), (b"a", "no-such-charset", "a"), (b"a\x81", "no-such-charset", "a�"),
        ("café".encode("latin-1"), "\"ISO-8859-2\"", "café"), (b"\x00", "", "\x00"), (unicodedata.normalize("NFD", VIET).encode(), "utf-8", VIET),
    ],
)
def test_bytes_to_text(content, declared, want):
    assert decode.text_of(content, declared) == want


def test_decoding_of_columns(spark):
    rows = [(1, bytearray(VIET.encode()), "text/html; charset=utf-8"), (2, bytearray(as_1258(VIET)), "text/html"), (3, None, None), (4, bytearray(WEST.encode("cp1252")), "text/html; Charset='windows-1252'")]
    table = spark.createDataFrame(rows, "i int, content binary, kind string").select("i", decode.decoded(F.col("content"), F.col("kind")).alias("d")).select("i", "d.*")
    assert {r.i: (r.text, r.charset) for r in table.collect()} == {1: (VIET, "utf-8"), 2: (VIET, "windows-1258"), 3: (None, None), 4: (WEST, "cp1252")}


def test_jobs_run_once_and_whole(spark, tmp_path):
    table = stored.events_at(spark, f"{tmp_path}/e", 2)
    rows = [
        event(1, "Lễ hội Trái cây Chợ Lách", start=d(5)), event(2, "Chuẩn bị Lễ hội Trái cây Chợ Lách", start=d(5), crowd=70), event(3, "Lễ hội Hoa Sen", start=d(5), summary="Diễn ra tại Hà Nội."),
        event(4, "The spring festival of flowers in the old town", start=d(5), summary="It will take place this weekend with music and food."), event(5, "Hội chợ Gạo", "camau", d(9)),
    ]
    stored.insert(table, frame(spark, *rows), F.lit(datetime(2026, 10, 1)))

    def broken(rows):
        raise OSError("lost")

    jobs = {"merge": backfills.merge_duplicates, "broken": broken, "elsewhere": backfills.prune_elsewhere}
    with pytest.raises(OSError):
        backfills.apply(table, jobs)
    assert table.note("jobs") == ["merge"] and {r.id: r.crowd for r in table.read().collect()} == {1: 70, 3: None, 4: None, 5: None}
    jobs["broken"] = lambda rows: (None, None)
    jobs["foreign"] = backfills.prune_foreign
    assert backfills.apply(table, jobs) == ["broken", "elsewhere", "foreign"]
    after = sorted(map(str, table.read().collect()))
    assert {r.id for r in table.read().collect()} == {1, 5} and backfills.apply(table, jobs) == [] and sorted(map(str, table.read().collect())) == after
    assert table.read().filter("id = 1").first().first_seen == datetime(2026, 10, 1)


def test_purge_and_forget(spark, tmp_path):
    ledger, t = stored.ledger_at(spark, f"{tmp_path}/l", 2), lambda day, h=0: datetime(2026, 10, day, h)
    rows = [("a", "new", t(1)), ("b", "no_body", t(2, 1)), ("c", "title_only", t(2, 9)), ("old", "new", datetime(2026, 6, 1)), ("n", "not_event", t(2))]
    ledger.change(spark.createDataFrame([(link, "s", "t", at, s) for link, s, at in rows], ledger.schema))
    backfills.purge(ledger, F.lit(t(2, 10)))
    assert sorted(r.link for r in ledger.read().collect()) == ["a", "c", "n"]
    assert backfills.apply(ledger, backfills.MODEL_JOBS) == ["forget_turned_down_1"] and [r.link for r in ledger.read().collect()] == ["a"]
    assert backfills.apply(ledger, backfills.LEDGER_JOBS) and ledger.read().count() == 0


def test_counts_come_with_the_write(spark, tmp_path):
    rows = spark.createDataFrame([("new",)] * 3 + [("skip",)] * 2 + [(None,), ("odd",)], "status string")
    got = stats.written(rows, lambda x: x.write.parquet(f"{tmp_path}/out"), distinct=F.max("status"))
    assert (got["new"], got["skip"], got["dup"], got["other"], got["all"], got["distinct"]) == (3, 2, 0, 2, 7, "skip")
    assert spark.read.parquet(f"{tmp_path}/out").count() == 7
    empty = stats.written(rows.limit(0), lambda x: x.write.parquet(f"{tmp_path}/none"))
    assert empty["all"] == 0
    runs = spark.createDataFrame([("a", None, 5), ("b", "x", None)], "source_id string, error string, items int")
    assert tuple(stats.source_counts(runs).first()) == (2, 1, 5)

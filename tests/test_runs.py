"""Budgets, status lines, replies once, and articles given by hand."""

import random
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from festa.operators import catalogue, stored
from festa.plans import serve
from festa.streaming import replies, schedule
from tests.test_stored import NOW, d, event, frame


def loop(rows, budget, reserve):
    """What a plain loop begins."""
    begun, spent = set(), 0
    for _, key, cost in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1])):
        if budget - spent <= 0 or budget - spent < reserve:
            break
        begun.add(key)
        spent += max(cost or 0, 0)
    return begun


@pytest.mark.parametrize("seed", range(4))
def test_budget_equals_a_loop(spark, seed):
    r = random.Random(seed)
    rows = [(r.choice([None, *range(5)]), i, r.choice([None, -3, 0, 1, 2, 7, 7, 40])) for i in range(60)]
    df = spark.createDataFrame(rows, "p int, id int, cost int").repartition(7)
    for budget, reserve in ((50, 0), (90, 25), (0, 0), (10_000, 0)):
        got = {x.id for x in schedule.within_budget(df, F.col("cost"), budget, F.col("p"), F.col("id"), reserve=reserve).collect()}
        assert got == loop(rows, budget, reserve), (budget, reserve)
    assert schedule.within_budget(df.limit(0), F.col("cost"), 5, F.col("p"), F.col("id")).count() == 0


def test_until_the_first_fresh(spark):
    rows = [(None, 1, False), (None, 2, None), (3, 3, True), (3, 2, False), (5, 1, True)]
    df = spark.createDataFrame(rows, "p int, id int, fresh boolean")
    ids = lambda x: sorted((r.p or 0, r.id) for r in x.collect())
    assert ids(schedule.until(df, F.col("fresh"), "p", "id")) == [(0, 1), (0, 2), (3, 2)]
    assert ids(schedule.until(df, F.col("fresh"), "p", "id", inclusive=True)) == [(0, 1), (0, 2), (3, 2), (3, 3)]
    assert schedule.until(df, F.lit(False), "p", "id").count() == 5 and schedule.until(df.limit(0), F.col("fresh"), "p", "id").count() == 0
    assert schedule.deadline_before(540) == 450 and schedule.deadline_before(90) == 60


def test_status(spark):
    e = frame(spark, event(1, "Lễ hội"), event(2, "Hội chợ"))
    people = spark.createDataFrame([("a",), ("b",), ("a",)], "chat_id string")
    health = spark.createDataFrame([("z", "Z", 4, "x" * 200), ("b", None, 1, None), ("a", "A", 0, "")], "source_id string, name string, fails int, last_error string")
    ledger = spark.createDataFrame([("new",), ("dup",), ("dup",), (None,)], "status string")
    state = serve.status(e, people, health, ledger, {"llm_state": "ok"})
    text = serve.answer(catalogue.with_priority(e), "/trangthai", d(1), state=state)[0].split("\n")
    assert text[:2] == ["Số sự kiện đang lưu: 2", "Số người nhận tin: 2"] and text[4] == "Nguồn: 3 (lỗi: 2)" and text[5] == "AI: ok" and text[2].endswith("chưa có")
    assert text[9] == "Bài đã xử lý: dup=2, None=1, new=1" and text[10:] == [" - b: lỗi 1 lần – ", " - Z: lỗi 4 lần – " + "x" * 80]
    none = serve.status(e.limit(0), people.limit(0), health.limit(0), ledger.limit(0)).collect()
    assert len(none) == 10 and none[-1].line == "Bài đã xử lý: chưa có"


def test_descriptions(spark):
    rows = frame(spark, event(1, "Lễ hội", start=d(5), venue="Bến"), event(2, "x" * 500))
    got = {r.id: r.t for r in rows.select("id", catalogue.described().alias("t")).collect()}
    assert got[1].startswith("Lễ hội | 2026-10-05→") and "| Bến |" in got[1] and got[2] == "x" * 400


def test_replies_are_sent_once(spark, tmp_path):
    schema = "update_id bigint, chat_id string, text string"
    known = spark.createDataFrame([("a",)], "chat_id string")
    put = lambda *rows: spark.createDataFrame(list(rows), schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    sent = []

    def send(rows, fit=lambda i: True):
        ids = [(r.event_id,) for r in rows.collect() if fit(r.event_id)]
        sent.extend(i for (i,) in ids)
        return spark.createDataFrame(ids, "event_id bigint")

    def broken(rows):
        raise OSError("no network")

    def run(sender):
        replies.replying(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"), f"{tmp_path}/r", str(tmp_path), known, sender, "MA1").awaitTermination()

    put((5, "a", "/id"), (6, "b", "/start"), (7, "a", "xin chào"), (8, None, "/help"), (None, "a", "/id"), (5, "a", "/id"))
    with pytest.raises(Exception, match="no network"):
        run(broken)  # in mid-batch: rows stand, nothing is delivered
    table = replies.replies_at(spark, f"{tmp_path}/r")
    assert replies.offset(table) == 9 and sent == []
    run(lambda rows: send(rows, lambda i: i == 6))  # the batch comes again, delivery is partial
    put((9, "a", "/help"), (5, "a", "/stop"))  # an update that comes again changes nothing
    run(send)
    run(send)
    assert sorted(sent) == [5, 6, 9] and replies.offset(table) == 10
    got = {r.update_id: (r.action, r.delivered) for r in table.read().collect()}
    assert got == {5: ("id", True), 6: ("refuse", True), 7: (None, True), 8: ("help", True), 9: ("help", True)}


def test_articles_by_hand(spark, tmp_path):
    table, ledger, now = stored.events_at(spark, f"{tmp_path}/e", 2), stored.ledger_at(spark, f"{tmp_path}/l", 2), F.lit(NOW)
    old = spark.createDataFrame([("u1", "s", "t", datetime(2026, 1, 1), "not_event"), ("u2", "s", "t", datetime(2026, 1, 1), "new")], ledger.schema)
    ledger.change(old)
    items = spark.createDataFrame([("u1",), ("u3",)], "link string")
    assert [r.link for r in catalogue.readmitted(ledger.read(), items).collect()] == ["u2"]
    reports = frame(spark, event(10, "Lễ hội Hoa Sen", start=d(5)), event(11, "")).withColumns({"link": F.concat(F.lit("u"), (F.col("id") * 2 - 19).cast("string")), "title": F.col("name")})
    reports = reports.withColumn("name", F.nullif("name", F.lit("")))
    got = {r.link: r.status for r in stored.readd(ledger, reports, table, now).collect()}
    assert got == {"u1": "new", "u3": "not_event"} and [r.id for r in table.read().collect()] == [10]
    assert {r.link: (r.source, r.status) for r in ledger.read().collect()} == {"u1": ("manual", "new"), "u2": ("s", "new"), "u3": ("manual", "not_event")}
    again = reports.filter("id = 10").withColumn("id", F.lit(12).cast("bigint"))
    assert stored.readd(ledger, again, table, now).first().status in ("dup", "merged") and table.read().count() == 1

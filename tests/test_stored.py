"""Tables on disk, the stored catalogue, the ledger's state and alerts: versions, conflicts, repeats and failures."""

from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from festa.operators import resolve, stored
from festa.sources.store import ConflictError, StoredTable
from festa.streaming import alerts, ingest
from tests.test_engine import d, event, frame

NOW = datetime(2026, 10, 2, 8)


def files(table, version=None):
    return {b: set(f) for b, f in table.manifest(version)["files"].items()}


def rows_of(table, version=None):
    return sorted(tuple(r) for r in table.read(version).collect())


def test_changes_versions_and_untouched_buckets(spark, tmp_path):
    t = StoredTable(spark, f"{tmp_path}/t", "k bigint, v string, tags array<string>", "k", 8)
    made = lambda *rows: spark.createDataFrame(list(rows), t.schema)
    assert t.version() == 0 and rows_of(t) == []
    t.change(made(*[(i, "a", ["x"]) for i in range(40)], (None, "lost", None)))
    before = files(t)
    t.change(made((3, "b", None), (3, "c", None), (99, "new", [])), gone=made((4, None, None), (3, None, None), (1000, None, None)))
    after = files(t)
    assert {k: v for k, v, _ in rows_of(t)} == {**{i: "a" for i in range(40) if i != 4}, 3: "c", 99: "new"}
    changed = {b for b in before | after if before.get(b) != after.get(b)}
    assert 0 < len(changed) <= 4 and all(before[b] == after[b] for b in before if b not in changed)
    assert len(rows_of(t, 1)) == 40 and t.version() == 2
    t.change(gone=t.read().select("k"))
    assert rows_of(t) == [] and t.change(notes={"n": 1}) == 4 and t.note("n") == 1 and t.note("n", 3) is None
    assert t.vacuum(1) > 0 and rows_of(t) == []
    with pytest.raises(LookupError):
        t.read(2)


def test_of_two_writers_one_changes_again(spark, tmp_path):
    a, b = (StoredTable(spark, f"{tmp_path}/t", "k bigint, v string", "k", 2) for _ in range(2))
    a.change(spark.createDataFrame([(1, "a")], a.schema))
    base = a.version()
    b.change(spark.createDataFrame([(2, "b")], a.schema))
    with pytest.raises(ConflictError):
        a.change(spark.createDataFrame([(3, "c")], a.schema), base=base)
    original = a.version
    a.version = lambda: base if a.version is not original and not seen.append(1) and len(seen) == 1 else original()
    seen = []
    a.change(spark.createDataFrame([(3, "c")], a.schema))
    assert rows_of(b) == [(1, "a"), (2, "b"), (3, "c")] and len(seen) == 2


def test_stored_catalogue(spark, tmp_path):
    t, now = stored.events_at(spark, f"{tmp_path}/e", 4), F.lit(NOW)
    stored.insert(t, frame(spark, event(1, "Lễ hội A", start=d(5), crowd=20000, alerted=True), event(2, "Lễ hội B", "camau"), event(3, "Lễ hội C", start=date(2026, 1, 1))), now)
    later = F.lit(datetime(2026, 10, 3))
    stored.update(t, frame(spark, event(1, "Lễ hội A lớn", "hcm", d(6)), event(9, "Không có")), later)
    got = {r.id: r for r in t.read().collect()}
    assert set(got) == {1, 2, 3} and (got[1].name, got[1].province, got[1].first_seen, got[1].updated_at, got[1].alerted) == ("Lễ hội A lớn", "cantho", NOW, datetime(2026, 10, 3), False)
    assert got[1].search_text.startswith("le hoi a lon") and got[1].priority and t.read(1).filter("id = 1").first().priority == "CAO"
    stored.mark_alerted(t, spark.createDataFrame([(1,), (7,)], "id bigint"))
    stored.retire(t, F.lit(date(2026, 10, 4)))
    assert {r.id: r.alerted for r in t.read().collect()} == {1: True, 2: False}
    stored.delete(t, spark.createDataFrame([(1,)], "id bigint"))
    assert [r.id for r in t.read().collect()] == [2]


def test_ingestion_equals_one_fold_and_repeats_change_nothing(spark, tmp_path):
    reports = [event(i, f"Lễ hội Mùa {i % 3} Vườn {'ABCD'[i % 4]} sông Hậu", start=d(1 + i % 9), crowd=i) for i in range(1, 25)]
    t, now = stored.events_at(spark, f"{tmp_path}/e", 4), F.lit(NOW)
    for n, part in enumerate((reports[:9], reports[9:10], reports[10:])):
        assert stored.ingest(t, frame(spark, *part), now, batch=("s", n)).count() == len(part)
        assert stored.ingest(t, frame(spark, *part), now, batch=("s", n)) is None
    whole = resolve.resolve(frame(spark, *reports)).select(*resolve.FIELDS)
    assert sorted(map(str, t.read().select(*resolve.FIELDS).collect())) == sorted(map(str, whole.collect())) and t.version() == 3


def test_stream_into_stored_events(spark, tmp_path):
    schema = frame(spark).withColumn("today", F.lit(None).cast("date")).schema
    stream = lambda: spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
    batch = lambda day, *rows: frame(spark, *rows).withColumn("today", F.lit(day)).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    run = lambda: ingest.resolve_into(stream(), f"{tmp_path}/events", f"{tmp_path}/s").awaitTermination()
    batch(date(2026, 10, 2), *[event(i, f"Lễ hội {w}", start=d(5)) for i, w in enumerate(("Hoa Sen", "Mai Vàng", "Đua Ghe"), 1)], event(4, "Triển lãm Tranh Đông Hồ"))
    run()
    table = stored.events_at(spark, f"{tmp_path}/events")
    assert {r.id for r in table.read().collect()} == {1, 2, 3, 4}
    batch(date(2026, 10, 20), event(10, "Lễ hội Hoa Sen", start=d(6), venue="Bến"), event(11, "Hội chợ Gạo", start=d(21)))
    run()
    got = {r.id: r for r in table.read().collect()}
    assert set(got) == {1, 2, 3, 4, 11} and (got[1].end_date, got[1].venue) == (d(6), "Bến")
    assert {(r.report_id, r.status, r.event_id) for r in spark.read.parquet(f"{tmp_path}/s/changes").collect()} == {(1, "new", 1), (2, "new", 2), (3, "new", 3), (4, "new", 4), (10, "merged", 1), (11, "new", 11)}
    run()  # nothing new
    batch(date(2027, 3, 1), event(20, "Lễ hội Xuân", start=date(2027, 3, 2)))
    run()
    assert {r.id for r in table.read().collect()} == {20}  # retention took the rest, the undated one too


def test_ledger_frees_links(spark, tmp_path):
    at = lambda hours: datetime(2026, 10, 1) + (datetime(2026, 1, 2) - datetime(2026, 1, 1)) * hours / 24
    put = lambda *rows: spark.createDataFrame([(link, s, at(h)) for link, s, h in rows], ingest.LEDGER_ITEM).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = lambda: ingest.admitted_once(spark.readStream.schema(ingest.LEDGER_ITEM).parquet(f"{tmp_path}/in"))
    run = lambda: sorted((r.link, r.status, r.at) for r in ingest.drained(stream(), str(tmp_path), "ledger").collect())
    put(("a", "new", 0), ("b", "no_body", 0), ("c", "title_only", 1), ("a", "dup", 2), ("b", "new", 5), ("d", None, 3), (None, "new", 1))
    want = [("a", "new", at(0)), ("b", "no_body", at(0)), ("c", "title_only", at(1)), ("d", "", at(3))]
    assert run() == want
    put(("a", "new", 8), ("b", "new", 8), ("b", "dup", 9), ("c", "no_body", 8), ("d", "new", 9))
    want += [("b", "new", at(8)), ("c", "no_body", at(8))]
    assert run() == sorted(want)
    put(("a", "new", 24 * 90 + 1), ("e", "new", 24 * 90 + 2))
    want += [("a", "new", at(24 * 90 + 1)), ("e", "new", at(24 * 90 + 2))]
    assert run() == sorted(want)
    put(("f", "new", 24 * 400))
    run()
    put(("g", "new", 24 * 401))
    run()
    held = spark.read.format("statestore").option("stateVarName", "entry").load(f"{tmp_path}/ledger/state").count()
    assert held <= 2  # only the last links are left


def test_alerts_are_delivered_once(spark, tmp_path):
    t, out, now = stored.events_at(spark, f"{tmp_path}/e", 2), alerts.outbox_at(spark, f"{tmp_path}/o"), F.lit(NOW)
    today, sent = F.lit(date(2026, 10, 2)), []
    stored.insert(t, frame(spark, *[event(i, f"Lễ hội {i}", start=d(5), end=d(6), crowd=50000, venue="Bến") for i in (1, 2, 3)], event(4, "Lễ hội nhỏ", start=d(5))), now)

    def broken(rows):
        raise OSError("no network")

    def some(rows, fit=lambda i: True):
        ids = [(r.event_id,) for r in rows.collect() if fit(r.event_id)]
        sent.extend(i for (i,) in ids)
        return spark.createDataFrame(ids, "event_id bigint")

    with pytest.raises(OSError):
        alerts.deliver(t, out, broken, today, 1)
    assert t.read().filter("alerted").count() == 0
    assert alerts.deliver(t, out, lambda r: some(r, lambda i: i == 2), today, 1) == 1
    assert alerts.deliver(t, out, some, today, 2) == 2
    assert alerts.deliver(t, out, some, today, 2) == 0 and alerts.deliver(t, out, some, today, 3) == 0
    assert sorted(sent) == [1, 2, 3] and {r.id for r in t.read().filter("alerted").collect()} == {1, 2, 3}
    text = out.read().filter("event_id = 1").first().message
    assert "Lễ hội 1\nĐịa điểm: Bến" in text and "5–6/10" in text


def test_a_change_moves_the_rows_of_its_buckets_once(spark, tmp_path):
    large = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}  # as for large tables
    before = {k: spark.conf.get(k) for k in large}
    for k, v in large.items():
        spark.conf.set(k, v)
    try:
        t, seen = StoredTable(spark, f"{tmp_path}/t", "id bigint, v string, alerted boolean", "id", 1), []
        t.change(spark.range(2000).selectExpr("id", "cast(id as string) as v", "false as alerted"))
        assert len(t.manifest()["files"]["0"]) > 1  # a bucket is not one task
        write = t._write
        t._write = lambda rows: seen.append(rows._jdf.queryExecution().executedPlan().toString().count("Exchange ")) or write(rows)
        stored.mark_alerted(t, spark.range(0, 4000, 2).toDF("id"))
        assert seen == [1]
        assert sorted(map(tuple, t.read().collect())) == [(i, str(i), i % 2 == 0) for i in range(2000)]
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_a_key_of_several_changes_is_changed_deleted_or_set_in_this_order(spark, tmp_path):
    t = StoredTable(spark, f"{tmp_path}/t", "id bigint, v string, n int", "id", 2)
    t.change(spark.createDataFrame([(i, "old", None) for i in range(5)], t.schema))
    ids = lambda *i: spark.createDataFrame([(x,) for x in i], "id bigint")
    t.change(spark.createDataFrame([(0, "a", 1), (0, "b", None), (9, None, None), (None, "x", 1)], t.schema), ids(0, 1, None), keys=ids(0, 1, 2, 2, 7), v=F.lit("set"))
    assert sorted(map(tuple, t.read().collect())) == [(0, "b", None), (2, "set", None), (3, "old", None), (4, "old", None), (9, None, None)]

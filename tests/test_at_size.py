"""Results and bounds that larger or odder tables showed."""

import hashlib
import random
import re
from collections import Counter
from datetime import date, timedelta

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from festa.functions.text import one_of
from festa.operators import components, resolve
from festa.plans import queries, views
from festa.sources import decode, feeds


def test_latin_texts_that_end_in_their_only_accent_are_read_back(spark, tmp_path):
    for word in ("caf\xe9", "Stra\xdf", "\xc9"):
        assert decode.text_of(word.encode("latin-1"), "ISO-8859-1") == word
    assert decode.text_of("một lễ hộ".encode()[:-1], "") == "một lễ h�"
    texts = ["Un caf\xe9", "plain", "ends in a line ", "ends in a next line\x85", "", None]
    rows = [(4 * i + k, t) for i, t in enumerate(texts) for k in range(4)]
    spark.createDataFrame(rows, "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: (r.n_chars, r.text_sha256) for r in queries.decoded_documents(spark, str(tmp_path)).collect()}
    assert got == {i: (len(t or ""), hashlib.sha256((t or "").encode()).hexdigest()) for i, t in rows}


@pytest.mark.parametrize("seed", range(20))
def test_one_pattern_of_common_beginnings_finds_the_longest_word(seed):
    r = random.Random(seed)
    words = tuple({"".join(r.choices("ab c", k=r.randint(1, 5))).strip() or "a" for _ in range(8)})
    text = "".join(r.choices("ab c", k=300))
    listed = "|".join(sorted(words, key=lambda w: (-len(w), w)))
    assert re.findall(f"(?<![a-c])(?=({one_of(words, '(?![a-c])')}))", text) == re.findall(f"(?<![a-c])(?=({listed})(?![a-c]))", text)
    assert bool(re.search(f" {one_of(words)}", text)) == bool(re.search(f" (?:{listed})", text))


@pytest.mark.parametrize("found", [1, 4, 7, 1_000])
def test_pairs_of_lists_are_made_in_parts_of_any_size(monkeypatch, found):
    """The last event may make more pairs than a part takes, the first ones or all may make none, and a batch may be empty."""
    monkeypatch.setattr(resolve, "FOUND", found)
    monkeypatch.setattr(resolve, "HELD_EVENTS", 10, raising=False)
    r = random.Random(found)
    schema = pa.schema([("shared", pa.int64()), ("same", pa.bool_()), ("loose", pa.bool_()), *[(c, pa.list_(pa.struct([("id", pa.int64()), ("start", pa.int32()), ("last", pa.int32())]))) for c in "ab"]])
    for far in (0, 500):
        event = lambda i, day: {"id": i, "start": day, "last": day + i % 3}
        rows = [{"shared": k, "same": False, "loose": True, "a": [event(100 * k + i, r.randrange(20)) for i in range(r.randrange(1, 9))], "b": [event(100 * k + 50 + i, far + r.randrange(20)) for i in range(9)]} for k in range(12)]
        want = sorted((a["id"], b["id"], x["shared"]) for x in rows for a in x["a"] for b in x["b"] if max(a["start"], b["start"]) - min(a["last"], b["last"]) <= 3)
        batches = [pa.RecordBatch.from_pylist(rows, schema=schema), pa.RecordBatch.from_pylist([], schema=schema)]
        assert sorted(tuple(p.values()) for b in resolve._near(iter(batches)) for p in b.to_pylist()) == want and bool(want) == (far == 0)


def test_rows_of_a_join_are_dealt_into_parts_of_bounded_rows(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(views, "PART_ROWS", 100)
    spark.range(2000).selectExpr("id as o_orderkey", "id % 50 as o_custkey", "'O' as o_orderstatus", "1e5D as o_totalprice", "timestamp '1996-06-01' as o_orderdate", "'1' as o_orderpriority").coalesce(1).write.parquet(f"{tmp_path}/orders.parquet")
    spark.range(50).selectExpr("id as c_custkey", "cast(id % 25 as int) as c_nationkey", "'BUILDING' as c_mktsegment", "1D as c_acctbal").coalesce(1).write.parquet(f"{tmp_path}/customer.parquet")
    for rows in (queries.articles(spark, str(tmp_path)), queries.events(spark, str(tmp_path))):
        sizes = [len(part) for part in rows.select(rows.columns[0]).rdd.glom().collect()]
        assert sum(sizes) == 2000 and max(sizes) < 200


def _report(i, day, *words):
    start = date(1995, 1, 1) + timedelta(day)
    return {"root": 1, "id": i, "known": False, "name": "x" * 20, "province": "a", "start_date": start, "end_date": start, "crowd": None, "sources": [str(i)], "tokens": list(words), **dict.fromkeys(("venue", "start_time", "summary"), ""), **dict.fromkeys(("fireworks", "big_concert", "alerted"), False)}


def test_a_fold_looks_at_few_events(monkeypatch):
    seen = Counter()
    same = resolve._same
    monkeypatch.setattr(resolve, "_same", lambda *a: seen.update(n=1) or same(*a))
    n = 2400
    rows = [_report(i, 7 * i % 2400, f"w{i}", f"k{i % 50}", "common") for i in range(n)]
    rows += [_report(n + i, 7 * i % 2400, f"w{i}", f"k{i % 50}", "common") for i in range(n)]
    events = []
    changes = resolve._fold_root(rows, events)
    assert len(events) == n and [c["event_id"] for c in changes[n:]] == list(range(n))
    assert seen["n"] < 10 * n


def test_what_a_fold_stores_is_not_sent_to_all_tasks(spark, monkeypatch):
    monkeypatch.setattr(components.shared, "stored", lambda df: df)
    small = spark.range(100).toDF("k")
    plan = spark.range(1000).toDF("k").join(resolve.stored(small), "k")._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" not in plan and "SortMergeJoin" in plan
    assert sorted(map(tuple, components.connected(spark.createDataFrame([(1, 2), (2, 3), (7, 9)], "a bigint, b bigint")).collect())) == [(2, 1), (3, 1), (9, 7)]


@pytest.mark.parametrize("name", ["search_items", "auto_items"])
def test_a_task_has_few_feed_documents(spark, tmp_path, monkeypatch, name):
    monkeypatch.setattr(views, "PART_ROWS", 1000)
    spark.range(40_000).selectExpr("id as o_orderkey", "id % 50 as o_custkey", "'O' as o_orderstatus", "1e5D as o_totalprice", "timestamp '1996-06-01' as o_orderdate", "'1' as o_orderpriority").coalesce(1).write.parquet(f"{tmp_path}/orders.parquet")
    spark.range(50).selectExpr("id as c_custkey", "cast(id % 25 as int) as c_nationkey", "'BUILDING' as c_mktsegment", "1D as c_acctbal").coalesce(1).write.parquet(f"{tmp_path}/customer.parquet")
    seen = []
    plain = getattr(feeds, name)
    monkeypatch.setattr(feeds, name, lambda documents, *a: seen.append(documents) or plain(documents, *a))
    queries.QUERIES["searched_items" if name == "search_items" else "auto_source_items"](spark, str(tmp_path))
    sizes = [len(part) for part in seen[0].select("source_id").rdd.glom().collect()]
    assert len(sizes) == 40 and sum(sizes) == (313 if name == "search_items" else 625) and max(sizes) < 40


def test_words_of_names_are_told_over_all_cores(spark, monkeypatch):
    """However few bytes the names take, which Spark would leave in one part."""
    seen = []
    monkeypatch.setattr(resolve, "tokens", lambda name, province: seen.append(1) or F.array(F.spark_partition_id().cast("string")))
    rows = spark.range(400).selectExpr("id", "'cantho' as province", "'Lễ hội Sen ' || id % 200 as name")
    called, _ = resolve._names(rows)
    assert seen and called.count() == 200 and called.select("tokens").distinct().count() == spark.sparkContext.defaultParallelism

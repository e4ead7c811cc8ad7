"""The fold of reports into events, its components and its stored pairs against a sequential brute force."""

import random
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from festa import shared
from festa.functions.text import canonical_name
from festa.operators import components, resolve
from tests.test_engine import d, event, frame

WORDS = "sen lua tranh nhac hoa trai bien gao den ruou".split()


class Brute:
    """One report after the other against all events so far."""

    def __init__(self, tokens):
        self.tokens, self.events, self.changes = tokens, [], []

    @staticmethod
    def last(e):
        return e["end_date"] or e["start_date"]

    def same(self, e, r):
        if e["province"] is None or e["province"] != r["province"]:
            return False
        dated = e["start_date"] is not None and r["start_date"] is not None
        if dated and (max(e["start_date"], r["start_date"]) - min(self.last(e), self.last(r))).days > 3:
            return False
        a, b = self.tokens[e["name"], e["province"]], self.tokens[r["name"], r["province"]]
        n = len(a & b)
        return n > 0 and (n / len(a | b) >= (0.34 if dated else 0.4) or (n / min(len(a), len(b)) >= 0.6 and n >= 3))

    def merge(self, e, r):
        before = {k: list(v) if isinstance(v, list) else v for k, v in e.items() if k != "alerted"}
        for s in r["sources"]:
            if s not in e["sources"] and len(e["sources"]) < 6:
                e["sources"].append(s)
        if (r["crowd"] or 0) > (e["crowd"] or 0):
            e["crowd"] = r["crowd"]
        for k in ("fireworks", "big_concert", "alerted"):
            e[k] = e[k] or r[k]
        for k in ("venue", "start_time", "summary"):
            e[k] = e[k] or r[k]
        s, t = e["start_date"], r["start_date"]
        if s is None and t is not None:
            e["start_date"], e["end_date"] = t, r["end_date"]
        elif r["end_date"] and e["end_date"] and r["end_date"] > e["end_date"] and s == t:
            e["end_date"] = r["end_date"]
        elif t and s and (t, self.last(r)) != (s, self.last(e)):
            if (max(s, t) - min(self.last(e), self.last(r))).days <= 1:
                low, high = min(s, t), max(self.last(e), self.last(r))
                if (low, high) != (s, self.last(e)):
                    e["start_date"], e["end_date"] = low, high
            elif self.last(r) - t > self.last(e) - s:
                e["start_date"], e["end_date"] = t, r["end_date"]
        if len(e["name"]) + 15 < len(r["name"]) <= 120:
            e["name"] = r["name"]
        return before != {k: v for k, v in e.items() if k != "alerted"}

    def fold(self, reports, known=()):
        for e in known:
            self.events.append(e)
            self.changes.append((e["id"], "known", e["id"]))
        for r in reports:
            old = next((e for e in self.events if self.same(e, r)), None)
            if old is None:
                self.events.append(r)
                self.changes.append((r["id"], "new", r["id"]))
            else:
                self.changes.append((r["id"], "merged" if self.merge(old, r) else "dup", old["id"]))


def dicts(rows):
    return [{**dict(zip(resolve.FIELDS, r, strict=True)), "sources": list(r[resolve.FIELDS.index("sources")])} for r in rows]


def chains(rng, count, first=1):
    """Reports whose names and days overlap in part, so that merges decide what later ones match."""
    out = []
    for i in range(first, first + count):
        name = " ".join(["Lễ hội", *rng.sample(WORDS, rng.randrange(1, 6)), *(["mở rộng toàn vùng sông nước"] if rng.random() < 0.1 else [])]) if rng.random() < 0.97 else rng.choice(["Lễ hội", "2026", ""])
        start = None if rng.random() < 0.05 else date(2026, 10, 1) + timedelta(days=rng.randrange(120))
        end = start and (None if rng.random() < 0.1 else start + timedelta(days=rng.choice([0, 0, 1, 2, 6])))
        out.append(event(i, name, rng.choice(["cantho", "cantho", "camau", None]), start, crowd=rng.choice([None, 0, 50, 900]), fireworks=rng.random() < 0.2, venue=rng.choice(["", "Sân A"]), sources=[f"u{rng.randrange(40)}" for _ in range(rng.randrange(4))], alerted=rng.random() < 0.1))
        out[-1] = tuple(end if f == "end_date" else v for f, v in zip(resolve.FIELDS, out[-1], strict=True))
    return out


def named_tokens(spark, *tables):
    names = sorted({(r[1], r[2]) for t in tables for r in t}, key=str)
    rows = spark.createDataFrame(names, "name string, province string").select("name", "province", resolve.tokens(F.col("name"), F.col("province")).alias("t")).collect()
    return {(r.name, r.province): set(r.t) for r in rows}


def as_rows(events):
    return sorted(tuple(tuple(v) if isinstance(v, list) else v for v in (e[f] for f in resolve.FIELDS)) for e in events)


def check(spark, done, brute):
    assert sorted(tuple(r) for r in done.changes.collect()) == sorted(brute.changes)
    got = [r.asDict() for r in done.events.collect()]
    assert sorted(map(str, as_rows_of(got))) == sorted(map(str, as_rows_of(brute.events)))


def as_rows_of(events):
    return [tuple(list(e[f]) if f == "sources" else e[f] for f in resolve.FIELDS) for e in events]


def unique_links(rows):
    at = resolve.FIELDS.index("sources")
    return [tuple(list(dict.fromkeys(v)) if i == at else v for i, v in enumerate(r)) for r in rows]


@pytest.mark.parametrize(("seed", "block"), [(1, 500), (2, 6)])
def test_fold_equals_the_sequential_one(spark, seed, block):
    rng = random.Random(seed)
    rows = unique_links(chains(rng, 160))
    brute = Brute(named_tokens(spark, rows))
    brute.fold(dicts(rows))
    assert {s for _, s, _ in brute.changes} >= {"new", "merged"}
    check(spark, resolve.fold(frame(spark, *rows).repartition(6), block=block), brute)


def test_fold_into_known_events(spark):
    rng = random.Random(9)
    known, rows = unique_links(chains(rng, 60)), unique_links(chains(rng, 90, first=1000))
    brute = Brute(named_tokens(spark, known, rows))
    brute.fold(dicts(rows), dicts(known))
    check(spark, resolve.fold(frame(spark, *rows), frame(spark, *known), block=10), brute)


def test_fold_of_many_copies_in_rounds(spark):
    rows = [event(i, "Lễ hội Sen Đồng Tháp", "camau", d(5), crowd=i % 50) for i in range(1, 400)] + [event(900, "Hội chợ Gạo", start=d(6))]
    done = resolve.fold(frame(spark, *rows), block=64)
    got = {r.id: r for r in done.events.collect()}
    assert set(got) == {1, 900} and got[1].crowd == 49 and got[1].sources == [f"u{i}" for i in range(1, 7)]
    assert {(r.status, r["count"]) for r in done.changes.groupBy("status").count().collect()} == {("new", 2), ("merged", 48), ("dup", 350)}


def test_fold_of_nothing_and_of_nulls(spark):
    assert resolve.resolve(frame(spark).limit(0)).count() == 0
    rows = frame(spark, *[tuple(i if f == "id" else None for f in resolve.FIELDS) for i in (1, 2)])
    assert sorted(r.id for r in resolve.resolve(rows.withColumns({"root": F.lit("x"), "tokens": F.lit(1)})).collect()) == [1, 2]


def test_roots_are_joined_where_events_come_within_reach(spark):
    """Report 3 agrees with the name that report 2 brings and with the days of report 1 alone, so that no pair links it."""
    rows = [
        event(1, "Lễ hội Sen Lúa Tranh", start=d(1), end=d(9)), event(2, "Lễ hội Sen Lúa Tranh Nhạc Hoa Trái mở rộng", start=d(9)), event(3, "Tranh Nhạc Hoa Trái", start=d(2)),
        event(4, "Hội thi Ghe Ngo", start=d(2)),
    ]
    pairs = {(r.a_id, r.b_id) for r in resolve.duplicate_pairs(frame(spark, *rows)).collect()}
    brute = Brute(named_tokens(spark, rows))
    brute.fold(dicts(rows))
    assert pairs == {(1, 2)} and (3, "merged", 1) in brute.changes
    check(spark, resolve.fold(frame(spark, *rows)), brute)


def test_a_fold_compares_names_and_goes_through_reports_once(spark, monkeypatch):
    """One chain of many reports over all days: names meet, reports do not, and the jobs do not grow with the chain."""
    met, made = resolve._met, []
    monkeypatch.setattr(resolve, "_met", lambda *a: made.append(met(*a)) or made[-1])
    writes, written = [], shared.stored
    monkeypatch.setattr(shared, "stored", lambda df: writes.append(1) or written(df))
    rng, names = random.Random(4), ["Lễ hội Sen Lúa Tranh", "Hội chợ Sen Lúa Tranh", "Sen Lúa Nhạc Hoa Trái mở rộng toàn vùng sông nước", "Nhạc Hoa Trái", "Lễ hội Sen"]
    rows = []
    for i in range(1, 400):
        start = d(rng.randrange(1, 29), rng.randrange(1, 13)) if rng.random() < 0.95 else None
        rows.append(event(i, rng.choice(names), "cantho", start=start, end=start and rng.choice([None, start + timedelta(rng.randrange(-6, 9))]), crowd=i % 7))
    brute = Brute(named_tokens(spark, rows))
    brute.fold(dicts(rows))
    check(spark, resolve.fold(frame(spark, *rows), block=20), brute)
    assert made and sum(m.count() for m in made) <= 5 * 5 and len(writes) < 30


@pytest.mark.parametrize("shape", ["path", "random", "none"])
def test_connected_components(spark, shape):
    rng = random.Random(2)
    edges = {"path": [(i, i + 1) for i in range(60)], "star": [(100, i) for i in range(40)], "random": [(rng.randrange(80), rng.randrange(80)) for _ in range(60)], "none": [(3, 3)]}[shape]
    roots = {x: x for e in edges for x in e}
    for _ in roots:
        for a, b in edges:
            roots[a] = roots[b] = min(roots[a], roots[b])
    want = {n: r for n, r in roots.items() if n != r}
    got = {r.node: r.root for r in components.connected(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {n: r for n, r in got.items() if n == r} | want and all(roots[n] == r for n, r in got.items())


@pytest.mark.parametrize("seed", [5])
def test_pairs_equal_all_pairs(spark, seed, monkeypatch):
    monkeypatch.setattr(resolve, "COMMON_WORDS", 4)
    rows = chains(random.Random(seed), 130)
    brute = Brute(named_tokens(spark, rows))
    events = dicts(rows)
    want = {(a["id"], b["id"], len(brute.tokens[a["name"], a["province"]] & brute.tokens[b["name"], b["province"]])) for i, a in enumerate(events) for b in events[i + 1 :] if brute.same(a, b)}
    found = [tuple(r) for r in resolve.duplicate_pairs(frame(spark, *rows)).collect()]
    assert sorted(found) == sorted(want) and len(want) > 50


def test_names_are_compared_once_and_their_events_by_days(spark, monkeypatch):
    """Lists and batches of a few, copies, repeated ids, spans that end before they start and none: all pairs, while names meet once."""
    met, made = resolve._met, []
    monkeypatch.setattr(resolve, "_met", lambda *a: made.append(met(*a)) or made[-1])
    monkeypatch.setattr(resolve, "LISTED", 7, raising=False)
    monkeypatch.setattr(resolve, "FOUND", 50, raising=False)
    rng, names = random.Random(8), ["Lễ hội Sen Lúa Tranh", "Hội chợ Sen Lúa Tranh", "Sen Lúa Nhạc Hoa Trái", "Nhạc Hoa", "Lễ hội"]
    rows = []
    for i in range(150):
        start = d(rng.randrange(1, 29), rng.randrange(1, 13)) if rng.random() < 0.9 else None
        rows.append(event(i % 148, rng.choice(names), rng.choice(["cantho", "camau"]), start=start, end=start and rng.choice([None, start + timedelta(rng.randrange(-6, 40))])))
    brute, events = Brute(named_tokens(spark, rows)), dicts(rows)
    want = [(*sorted((a["id"], b["id"])), len(brute.tokens[a["name"], a["province"]] & brute.tokens[b["name"], b["province"]])) for i, a in enumerate(events) for b in events[i + 1 :] if a["id"] != b["id"] and brute.same(a, b)]
    assert sorted(tuple(r) for r in resolve.duplicate_pairs(frame(spark, *rows)).collect()) == sorted(want) and len(want) > 400
    assert sum(m.count() for m in made) <= 2 * 5 * 5


def test_stored_events_are_cleaned_before_they_are_compared(spark):
    rows = [
        event(1, "Chuẩn bị Lễ hội Trái cây Chợ Lách", start=d(5)), event(2, "Lễ hội Trái cây Chợ Lách", start=d(20), end=d(22), alerted=True), event(3, "Chuẩn bị Lễ hội Hoa Sen Tháp Mười", start=d(5), end=d(6)),
        event(4, "Triển lãm tranh Đông Hồ", start=d(7)),
    ]
    got = {r.id: r for r in resolve.deduplicated(frame(spark, *rows)).collect()}
    assert set(got) == {1, 3, 4}
    assert (got[1].name, got[1].start_date, got[1].end_date, got[1].alerted) == ("Lễ hội Trái cây Chợ Lách", d(20), d(22), True)
    assert (got[3].start_date, got[3].end_date) == (d(5), d(6)) and not got[3].name.startswith("Chuẩn bị")
    assert spark.range(1).select(canonical_name(F.lit(got[3].name))).first()[0] == got[3].name


def test_stored_names_are_read_by_the_rules_once(spark, monkeypatch):
    """Copies of a name and summary, nulls among them, are one row for the rules; every event keeps its own days."""
    seen = []
    monkeypatch.setattr(resolve.shared, "stored", lambda df, stored=resolve.shared.stored: seen.append(stored(df)) or seen[-1])
    rows = [event(i, [None, "Chuẩn bị Lễ hội Hoa Sen Tháp Mười", "Hội chợ Gạo 2026"][i % 3], start=d(1 + i % 28), end=d(1 + i % 28 + i % 2)) for i in range(60)]
    got = {r.id: r for r in resolve.cleaned(frame(spark, *rows)).collect()}
    assert len(got) == 60
    for i, r in got.items():
        assert r.name == ["", "Lễ hội Hoa Sen Tháp Mười", "Hội chợ Gạo 2026"][i % 3]
        assert (r.start_date is None) == (i % 3 == 1 and i % 2 == 0) and (r.end_date is None) == (r.start_date is None)
    assert seen and max(s.count() for s in seen) == 3

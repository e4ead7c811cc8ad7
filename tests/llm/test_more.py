"""Whitening, license scans and Merkle manifests against brute force: nulls, empties, ties, repeats, clashing columns, empty tables."""

import hashlib
import math
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from festa.llm import chat, licenses, merkle, mixing, near_dedup, packing, whitening
from tests.llm.test_llm import SCHEMA, prose

# 11: whitening


def brute_whitening(vectors, k=16):
    x = np.array([[math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v] for v in vectors], dtype=object)
    fit = np.array(sorted({tuple(r) for r in x}), dtype=object)
    n, sums = len(fit), fit.sum(0)
    centred = ((n * fit - sums) / n).astype(float)
    e, v = np.linalg.eigh(centred.T @ centred / n)
    order = np.argsort(-e)[:k]
    deviation = [int(((n * r - sums) ** 2).sum()) for r in x]
    return n, deviation, ((n * x - sums) / n).astype(float) @ v[:, order] / np.sqrt(e[order]), e[order] / e.sum()


@pytest.mark.parametrize("partitions", [1, 3, 20])
def test_whitening_against_eigenvectors(spark, partitions):
    rng = np.random.default_rng(3)
    vectors = (rng.normal(size=(300, 20)) * np.linspace(3, 0.3, 20)).astype(np.float32).tolist()
    vectors += [vectors[0]] * 100
    rows = [(i if i % 50 else None, v, 1) for i, v in enumerate(vectors)]
    odd = [(900, None, 1), (901, [float("nan"), *vectors[0][1:]], 1), (902, [None, *vectors[0][1:]], 1), (903, [float("inf"), *vectors[0][1:]], 1), (904, [1e30, *vectors[0][1:]], 1), (905, [1.0], 1), (906, [], 1)]
    table = spark.createDataFrame(rows + odd, "vec_id bigint, embedding array<float>, component int").repartition(partitions)
    found = whitening.whiten(table).collect()
    n, deviation, white, explained = brute_whitening(vectors)
    assert len(found) == 16 * len(vectors) and {r.n for r in found} == {n}
    by_id = defaultdict(dict)
    for r in found:
        if r.vec_id is not None:
            by_id[r.vec_id][r.component] = r
    assert set(by_id) == {i for i, *_ in rows if i is not None}
    signs = [np.sign(by_id[1][j + 1].whitened * white[1, j]) for j in range(16)]
    for i, got in by_id.items():
        assert {r.deviation for r in got.values()} == {deviation[i]} == {int(r.deviation_exact) for r in got.values()}
        assert np.allclose([got[j + 1].whitened * signs[j] for j in range(16)], white[i], atol=1e-8)
    assert np.allclose([by_id[1][j + 1].explained for j in range(16)], explained, rtol=1e-9)
    assert len({r.identity_error for r in found}) == 1 and found[0].identity_error < 1e-10


def test_whitening_of_small_and_flat_tables(spark):
    schema = "vec_id bigint, embedding array<float>"
    flat = [(i, [float(i), 2.0 * i, 7.0]) for i in range(10)]
    found = whitening.whiten(spark.createDataFrame(flat, schema)).collect()
    assert {r.component for r in found} == {1} and len(found) == 10 and found[0].explained == pytest.approx(1) and found[0].identity_error < 1e-10
    for rows in ([], [(1, [1.0, 2.0])] * 5, [(1, None)], [(1, [])]):
        assert whitening.whiten(spark.createDataFrame(rows, schema)).count() == 0
    few = whitening.whiten(spark.createDataFrame([(i, [float(i == j) for j in range(40)]) for i in range(3)], schema)).collect()
    assert {r.component for r in few} == {1, 2}


def test_deviations_stay_exact_beyond_a_long():
    n, rest = 4_000_000_000, [5, -1_999_999_999]
    at = whitening.Centre(n, tuple(1_000_000 * n + r for r in rest))
    x = np.array([[1_000_064, 999_900], [1_000_000, 1_000_000], [2**50, 1]])
    assert at.deviations(x) == [sum((n * int(v) - s) ** 2 for v, s in zip(row, at.sums)) for row in x]
    assert at.deviations(x)[0] > 2**63


# 12: licenses


def brute_scan(text):
    words = re.findall(f"[^{licenses.BREAKS}]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    spots = [(i, label) for phrase, label in licenses.PHRASES for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()]
    share, added = 0.0, set()
    for b in range(max(1, -(-(len(words) - 32) // 32))):
        block = set(words[32 * b : 32 * b + 64])
        for t in licenses.templates_of(licenses.TEMPLATES):
            overlap = len(block & set(t.words))
            if overlap >= 0.8 * len(t.words) - 1e-9:
                share, added = max(share, overlap / len(t.words)), added | {t.label}
    base = {label for _, label in spots}
    places = [i for i, _ in spots]
    return (len(words), len(spots), min(places, default=None), max(places, default=None), ",".join(sorted(base)), ",".join(sorted(base | added)), 1.0 if spots else share)


def test_license_scan_against_brute_force(spark):
    rng = random.Random(12)
    statements = [text for _, text in licenses.TEMPLATES]
    pool = sorted({w for t in licenses.templates_of(licenses.TEMPLATES) for w in t.words} | {"é", "x"})
    texts = [None, "", " ", "MIT", "mit-license MIT\tLicense", "cc by cc by", "ccby cc by-nc", "É MIT LICENSE é", "Apache\x00License", "gnu general public  license gnu", "mit license", "licensed under cc by nc 4 0 " * 40]
    for _ in range(150):
        s = rng.choice(statements).split()
        for _ in range(rng.randrange(4)):
            s[rng.randrange(len(s))] = rng.choice(pool)
        texts.append(prose(rng, rng.randrange(150)) + "\n" + "\n".join(" ".join(s).split(" ", 3)) + " " + prose(rng, rng.randrange(90)))
    texts += [" ".join(rng.choice(pool) for _ in range(rng.randrange(1, 300))) for _ in range(100)] + [prose(rng, 20_000) + " all rights reserved copyright"] + ["Released under the MIT License."] * 60
    rows = [(i if i % 9 else 5, t, "en", "s", 1) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, SCHEMA).withColumns({"row": F.lit("clash"), "score": F.lit("clash"), "words": F.lit(1)}).repartition(5)
    found = sorted(tuple(r) for r in docs.transform(licenses.scan).select("doc_id", "n_words", "n_base", F.coalesce("first_word", F.lit(-1)), F.coalesce("last_word", F.lit(-1)), "base_labels", "labels", "score").collect())
    wanted = sorted((i, *(-1 if v is None else v for v in brute_scan(t))) for i, t, *_ in rows)
    assert found == wanted
    assert len({r[6] for r in found}) > 15
    assert licenses.scan(docs.limit(0)).count() == 0
    assert {r.labels for r in licenses.scan(docs, templates=()).collect()} <= {"", *(r[5] for r in found)}


def test_license_templates_are_bounded(monkeypatch):
    with pytest.raises(ValueError):
        licenses.templates_of([("long", "w " * 40)])
    monkeypatch.setattr(licenses, "MOST_TEMPLATE_WORDS", 2)
    with pytest.raises(ValueError):
        licenses.templates_of([("a", "one two three")])


# 13: Merkle manifests


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def brute_manifest(rows):
    """(doc_id, leaf, subroot, root, proof, folded root, verified) of each row, by trees of lists."""
    part = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf_of = lambda i, text, lang, source, n: sha("".join(map(part, (i, source, lang, n, text))))

    def tree(leaves):
        found, ways = [leaves], [[] for _ in leaves]
        while len(found[-1]) > 1:
            nodes, power = found[-1], 8 ** (len(found) - 1)
            for place, way in enumerate(ways):
                at = place // power
                run = nodes[at // 8 * 8 : at // 8 * 8 + 8]
                way.append(("".join(run[: at % 8]), "".join(run[at % 8 + 1 :])))
            found.append([sha("".join(nodes[i : i + 8])) for i in range(0, len(nodes), 8)])
        return found[-1][0], ways

    by_lang = defaultdict(list)
    for row in rows:
        by_lang[row[2]].append((row[0] is not None, row[0] or 0, leaf_of(*row), row))
    langs = sorted(by_lang, key=lambda x: (x is not None, (x or "").encode()))
    trees = [tree([x[2] for x in sorted(by_lang[lang], key=lambda x: x[:3])]) for lang in langs]
    root, tops = tree([t[0] for t in trees])
    out = []
    for lang, (subroot, ways), top in zip(langs, trees, tops, strict=True):
        for (_, _, leaf, row), way in zip(sorted(by_lang[lang], key=lambda x: x[:3]), ways, strict=True):
            node = leaf
            if row[0] is not None and zlib.crc32(str(row[0]).encode()) % 3 == 0 and row[1] is not None:
                node = leaf_of(row[0], "".join(c.lower() if "A" <= c <= "Z" else c for c in row[1]), *row[2:])
            for left, right in [*way, *top]:
                node = sha(left + node + right)
            out.append((row[0], leaf, subroot, root, sha("".join(x + y for x, y in [*way, *top])), node, node == root))
    return out


def same_rows(found, wanted):
    order = lambda r: (r[0] is not None, r[0] or 0, *map(str, r[1:]))
    assert sorted((tuple(r) for r in found), key=order) == sorted(wanted, key=order)


@pytest.mark.parametrize("few_runs, few_languages", [(8192, 10_000), (10, 2), (0, 0)])
def test_manifest_against_brute_force(spark, monkeypatch, few_runs, few_languages):
    monkeypatch.setattr(merkle, "FEW_RUNS", few_runs)
    monkeypatch.setattr(merkle, "FEW_LANGUAGES", few_languages)
    rng = random.Random(13)
    langs = [*(["en"] * 12), None, "", "é", "zz", "Z", *[f"l{i}" for i in range(12)]]
    rows = [(rng.randrange(10**6), prose(rng, rng.randrange(6)).title(), rng.choice(langs), f"s{i % 4}", i) for i in range(700)]
    rows += [(None, "No Id", "en", None, None)] * 3 + [(7, "Same Row", "en", "s", 1)] * 40 + [(7, None, "en", "s", 1), (7, "", "en", "", 1), (-5, "Ünï A", None, "s", 2), (9, "ONE", "one", "s", 3)]
    docs = spark.createDataFrame(rows, SCHEMA).withColumns({"at": F.lit("clash"), "tree": F.lit(1), "leaf": F.lit("x")}).repartition(7)
    same_rows(merkle.manifest(docs).collect(), brute_manifest(rows))


@pytest.mark.parametrize("count", [0, 1, 2, 8, 9, 64, 65])
def test_manifest_of_small_trees(spark, count):
    rows = [(i, f"Text {i}", "en", "s", 1) for i in range(count)]
    same_rows(merkle.manifest(spark.createDataFrame(rows, SCHEMA)).collect(), brute_manifest(rows) if rows else [])


# 7: mixing of repeated rows


def test_mixing_of_rows_that_repeat_id_and_text(spark):
    rng = random.Random(7)
    same = prose(rng, 100)
    rows = [(None, same, "en", "a", 1)] * 300 + [(i, prose(rng, 100), "en", "a", 1) for i in range(200)] + [(1000 + i, prose(rng, 100), "en", "b", 1) for i in range(250)] + [(5, None, "en", "b", 1)] * 3
    docs = spark.createDataFrame(rows, SCHEMA).withColumn("peer", F.lit("clash"))
    found = mixing.mix_documents(docs.repartition(6)).collect()
    assert len(found) == len(rows)
    for source_size in {r.source_size for r in found}:
        own = [r for r in found if r.source_size == source_size]
        assert abs(sum(r.taken for r in own) - own[0].target) <= 100
    count = lambda frame: sorted((r.doc_id or -1, r.source_size, r.size, r.taken) for r in mixing.mix_documents(frame).collect())
    assert count(docs.repartition(3)) == sorted((r.doc_id or -1, r.source_size, r.size, r.taken) for r in found)
    assert 0 < sum(r.copies for r in found if r.doc_id is None and r.size) < 300 * 3
    mix = mixing.mixed(docs)
    assert mix.columns == docs.columns and mix.count() == sum(r.copies for r in found)


# 6: packing under capacities that bind


def test_every_capacity_binds_and_holds(spark):
    rng = random.Random(6)
    texts = [prose(rng, n) for n in [*([2] * 900), *([700] * 6), *(rng.randrange(1, 400) for _ in range(120)), 5000]] + [None, ""]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in enumerate(texts)], SCHEMA)
    rows = packing.pack_under_capacities(docs).collect()
    bins = defaultdict(list)
    for r in rows:
        bins[r.sequence_id].append(r)
    tokens, pieces, cost = packing.CAPACITIES
    used = [(sum(r.length for r in b), len(b), sum(r.length**2 for r in b)) for b in bins.values()]
    assert all(a <= tokens and n <= pieces and c <= cost for a, n, c in used)
    for b in bins.values():
        b.sort(key=lambda r: r.offset)
        assert [r.offset for r in b] == [sum(r.length for r in b[:i]) for i in range(len(b))]
    assert {r.doc_id for r in rows} == set(range(len(texts))) and max(r.length for r in rows) <= packing.SHORT_PIECE
    # each capacity is, for some bin and some piece of another, the only one that keeps the piece out
    alone = set()
    for a, n, c in used:
        for x in {r.length for r in rows}:
            over = [a + x > tokens, n + 1 > pieces, c + x * x > cost]
            alone |= {over.index(True)} if sum(over) == 1 else set()
    assert alone == {0, 1, 2}
    # no two sequences could be one
    assert not any(a + x <= tokens and n + y <= pieces and c + z <= cost for i, (a, n, c) in enumerate(used) for x, y, z in used[i + 1 :])


# 4: probes


def test_roles_and_texts_that_hold_a_probe():
    held = chat.probe_for([])
    turns = [(held, "a"), ("assistant", f"b{held}{chat.probe_for([(held, held)])}"), (f"x{held}", held), ("assistant", "")]
    text, spans, rewritten = chat.render(turns, chat.marked_turns)
    assert rewritten is None and chat.parse_marked(text) == turns
    assert [chat.unescape(text[a:b]) for _, _, _, a, b in spans] == [t for _, t in turns]


def test_near_dedup_moves_keys_once_and_each_sides_own_words(spark, monkeypatch):
    members = spark.createDataFrame([(1, 5, 9), (2, 5, 9), (2, 6, 9), (3, 7, 9)], "node bigint, key bigint, n int")
    kept, moved = [], near_dedup.sized
    monkeypatch.setattr(near_dedup, "sized", lambda df, rows: kept.append(df) or moved(df, rows))
    assert sorted((r.key, r.node, r.n) for r in near_dedup._meeting(members).collect()) == [(5, 1, 9), (5, 2, 9)]
    assert kept[0]._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0].count("Exchange hashpartitioning") == 1
    words_of = {i: np.array([*range(40), 100 + i], "<u4").tobytes() for i in range(6)} | {6: np.arange(500, 541).astype("<u4").tobytes()}
    tokens = spark.createDataFrame(list(words_of.items()), "node bigint, tokens binary")
    asked, ask = [], near_dedup._asked
    monkeypatch.setattr(near_dedup, "_asked", lambda *a: asked.append(ask(*a)) or asked[-1])
    monkeypatch.setattr(near_dedup, "FEW_BYTES", -1)
    pairs = spark.createDataFrame([(i, 0) for i in range(1, 7)], "node bigint, leader bigint")
    assert sorted(tuple(r) for r in near_dedup._verified(pairs, tokens, 0.8).collect()) == [(i, 0) for i in range(1, 6)]
    assert [df.count() for df in asked] == [7, 6, 1]


def test_a_group_gives_links_and_no_pairs(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "PART", (16, 2**22), raising=False)
    rng = np.random.default_rng(51)
    vocab, shared = rng.integers(0, 2**32, 60), rng.integers(0, 2**32, 120)
    texts = [np.concatenate((shared, rng.choice(vocab, rng.integers(36, 45)))).astype("<u4") for _ in range(70)]
    texts += [np.concatenate((t[:150], rng.integers(0, 2**32, 6))).astype("<u4") for t in texts[:20]]
    same = {(i, j) for i in range(len(texts)) for j in range(i) if near_dedup.similar(texts[i], texts[j])}
    tokens = spark.createDataFrame([(i, t.tobytes()) for i, t in enumerate(texts)], "node bigint, tokens binary")
    # the same texts meet under two keys of different leaders
    members = spark.createDataFrame([(k, i, len(t), k - 6) for k in (7, 8) for i, t in enumerate(texts)], "key bigint, node bigint, n int, leader bigint")
    known = [(i, 0) for i in (0, 3, 5, 6, 9)]
    labels = spark.createDataFrame(known, "node bigint, label bigint")
    found = [tuple(r) for r in near_dedup._unlinked(members, labels, tokens, 0.8).collect()]
    assert set(found) <= same and len(found) < len(texts)

    def classes(links):
        of = list(range(len(texts)))
        for a, b in links:
            of = [of[b] if x == of[a] else x for x in of]
        return [of.index(x) for x in of]

    assert classes([*found, *known]) == classes([*same, *known])


def test_an_index_counts_the_words_in_common():
    rng = np.random.default_rng(52)
    texts = [rng.integers(0, 30, rng.integers(1, 60)).astype(np.uint64) for _ in range(50)]
    runs = [near_dedup.kmers(t, 1) for t in texts]
    for size in (1, 3, 40):
        got = near_dedup.in_common(near_dedup.word_index(runs[:size]), runs)
        assert got.tolist() == [[near_dedup._common(t, o) for o in texts[:size]] for t in texts]

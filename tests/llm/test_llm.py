"""Small fixtures against brute force: nulls, empties, ties, repeats, clashing columns, empty tables."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from festa.llm import chat, exact_dedup, fingerprint, html_extract, langid, mixing, near_dedup, packing, quality, sharding, words

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
VOCAB = [f"w{i}" for i in range(300)]


def docs_of(spark, texts, langs=None, sources=None):
    rows = [(i, t, langs[i] if langs else "en", sources[i] if sources else f"s{i % 3}", len(t or "")) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


def prose(rng, n, vocab=VOCAB):
    return " ".join(rng.choice(vocab) for _ in range(n))


@pytest.fixture(scope="module")
def odd_texts():
    rng = random.Random(5)
    return [None, "", " \t\n", "a", "a b", "A  B", "é😀 x", prose(rng, 30), prose(rng, 3000), "x" * 5000, "same text here", "same  text here", "same text here"]


# 1 and 2: models


def test_quality_learns_and_scores_everything(spark):
    rng = random.Random(1)
    good = [prose(rng, 40) for _ in range(120)]
    bad = [" ".join(w + "!!" for w in prose(rng, 40).split()) for _ in range(60)]
    texts = [*good, *bad, None, "", "?"]
    docs = docs_of(spark, texts).withColumn("score", F.lit("clash"))
    labels = spark.createDataFrame([(i, int(i < 120), 0) for i in range(180)] + [(5, None, 0)], "doc_id bigint, quality int, toxic int")
    rows = {r.doc_id: r for r in quality.classify(docs, labels).collect()}
    assert len(rows) == len(texts)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) and r.held_out == (zlib.crc32(str(i).encode()) % 3 == 1) for i, r in rows.items())
    held = [i for i in range(180) if rows[i].held_out]
    assert sum(rows[i].predicted == int(i < 120) for i in held) >= 0.95 * len(held)
    assert rows[180].score == rows[181].score
    kept = quality.keep_good(docs, labels)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {i for i, r in rows.items() if r.predicted}
    empty = labels.limit(0)
    assert {r.score for r in quality.classify(docs, empty).collect()} == {0.5}
    assert quality.classify(docs.limit(0), labels).count() == 0


def test_quality_scores_do_not_depend_on_the_batch(monkeypatch):
    rng = random.Random(15)
    texts = ["a b c", "a b c", "", "c", "x x x", "a b", *(prose(rng, rng.randrange(1, 30)) for _ in range(50)), "a b c"]
    alone = [quality.features([t])[0].tolist() for t in texts]
    found, at = quality.features(texts)
    assert at[-1] == len(found) and [found[i:j].tolist() for i, j in zip(at, at[1:], strict=False)] == alone
    weights = np.random.default_rng(1).normal(size=1 << quality.BITS).astype(np.float32)
    assert quality.score_texts(texts, weights).tolist() == [quality.score_texts([t], weights)[0] for t in texts]
    monkeypatch.setattr(words, "BATCH_POINTS", 10)
    assert quality.score_texts(texts, weights).tolist() == [quality.score_texts([t], weights)[0] for t in texts]


def test_quality_fit_does_not_depend_on_batches():
    rng = random.Random(16)
    rows = pd.DataFrame({"text": [prose(rng, 12) for _ in range(90)], "quality": [float(i % 3 > 0) for i in range(90)]})
    fits = [pd.concat(quality.train(iter(parts))) for parts in ([rows], [rows[:7], rows[7:8], rows[8:]])]
    assert fits[0].equals(fits[1])


def test_language_id(spark):
    rng = random.Random(2)
    vocab = {"en": "the and of with that this from have which there".split(), "de": "der die und das nicht mit für auch eine über".split(), "fr": "le les des est que pour dans avec été où".split(), "es": "el los que para con una por más está niño".split()}
    langs = [rng.choice(list(vocab)) for _ in range(240)]
    texts = [prose(rng, 12, vocab[x]) for x in langs] + [None, "", "12 34 !!"]
    docs = docs_of(spark, texts, [*langs, None, "en", "de"])
    rows = {r.doc_id: r for r in langid.identify(docs).collect()}
    assert len(rows) == 243 and all(0 <= r.score <= 1 for r in rows.values())
    held = [i for i in range(240) if rows[i].held_out]
    assert sum(rows[i].lang_pred == langs[i] for i in held) >= 0.97 * len(held)
    assert [rows[i].lang_pred for i in (240, 241, 242)] == ["und"] * 3
    assert {r.lang_pred for r in langid.identify(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
    assert langid.identify(docs.limit(0)).count() == 0


def rows_learnt(spark, monkeypatch, fit):
    """What the learner is given, as one frame."""
    seen = []
    frame = type(spark.range(1))
    original = frame.mapInPandas
    with monkeypatch.context() as m:
        m.setattr(frame, "mapInPandas", lambda df, *a, **k: (seen.append(df.toPandas()), original(df, *a, **k))[1])
        fit()
    return seen[0]


def test_learning_rows_are_bounded_where_ids_repeat(spark, monkeypatch):
    rng = random.Random(43)
    texts = [prose(rng, 9) for _ in range(60)]
    rows = [(i, t, "en" if i % 2 else "de", "s", 1) for i, t in enumerate(texts)] + [(3, prose(rng, 9), "en", "s", 1) for _ in range(500)]
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(60)] * 3, "doc_id bigint, quality int, toxic int")
    made = []
    for order in (rows, rows[::-1]):
        docs = spark.createDataFrame(order, SCHEMA)
        learnt = rows_learnt(spark, monkeypatch, lambda docs=docs: quality.fit(docs, labels, 20))
        assert len(learnt) == 20
        langs = rows_learnt(spark, monkeypatch, lambda docs=docs: langid.fit(docs, 15))
        assert Counter(langs["lang"]) == {"en": 15, "de": 15}
        made.append((learnt, langs, quality.fit(docs, labels, 40)))
    assert made[0][0].equals(made[1][0]) and made[0][1].equals(made[1][1]) and np.array_equal(made[0][2], made[1][2])


def test_languages_beyond_the_bound_are_the_rarest(spark, monkeypatch):
    monkeypatch.setattr(langid, "MOST_LANGUAGES", 2)
    langs = ["en"] * 30 + ["de"] * 20 + ["fr"] * 5
    docs = docs_of(spark, [f"{x}a {x}b {x}c" for x in langs], langs)
    assert langid.fit(docs).languages == ["de", "en"]


def brute_ftrl(texts, labels):
    """The learner row by row, with dictionaries."""
    z, n = defaultdict(float), defaultdict(float)

    def weight(i):
        if abs(z[i]) <= quality.L1:
            return 0.0
        return (np.sign(z[i]) * quality.L1 - z[i]) / ((quality.BETA + n[i] ** 0.5) / quality.ALPHA + quality.L2)

    for a in range(0, len(texts), quality.BLOCK_ROWS):
        for _ in range(quality.EPOCHS):
            for text, label in zip(texts[a : a + quality.BLOCK_ROWS], labels[a : a + quality.BLOCK_ROWS], strict=True):
                counts = Counter(quality.features([text])[0].tolist())
                norm = sum(c * c for c in counts.values()) ** 0.5
                values = [(i, c / norm) for i, c in counts.items()] + [((1 << quality.BITS) - 1, 0.2)]
                p = 1 / (1 + np.exp(-sum(weight(i) * v for i, v in values)))
                for i, v, w in [(i, v, weight(i)) for i, v in values]:
                    g = (p - label) * v
                    z[i] += g - ((n[i] + g * g) ** 0.5 - n[i] ** 0.5) / quality.ALPHA * w
                    n[i] += g * g
    return {i: weight(i) for i in z if weight(i)}


def test_quality_against_a_learner_of_dictionaries(monkeypatch):
    monkeypatch.setattr(quality, "BLOCK_ROWS", 25)
    rng = random.Random(44)
    texts = [prose(rng, rng.randrange(1, 15)) for _ in range(60)] + ["a a a", ""]
    labels = [float(rng.random() < 0.6) for _ in texts]
    got = pd.concat(quality.train(iter([pd.DataFrame({"text": texts, "quality": labels})])))
    want = brute_ftrl(texts, labels)
    assert set(got["feature"]) == set(want)
    assert all(abs(w - want[i]) < 1e-9 for i, w in zip(got["feature"], got["weight"], strict=True))


def test_pair_margins_against_dense_steps():
    """The sparse, lazily shrunk steps of the support vector machines equal dense ones that shrink every weight."""
    texts = ["der und die", "the and of", "die das und nicht", "of the that", "le les des"]
    langs = np.array([0, 1, 0, 1, 2])
    model = langid.Model(["de", "en", "fr"])
    model.learn(texts, langs, 0.5, average=False)
    nf, scale = len(model.families), 40.0
    dense = np.zeros(1 << langid.BITS)
    for text, lang in zip(texts, langs, strict=True):
        if lang == 2:  # in no pair with the others
            continue
        grams, at, which, _ = langid.word_grams([text])
        x = np.zeros(1 << langid.BITS)
        for w in which:
            own = grams[at[w] : at[w + 1]]
            np.add.at(x, own, 1.0)
        x /= sum(at[w + 1] - at[w] for w in which)
        sign = 1 if lang == 0 else -1
        hinge = sign * (sign * scale * (x @ dense) < 1)
        dense = dense * (1 - 0.5 * langid.PENALTY) + 0.5 / (scale * (x @ x)) * hinge * x
    assert model.pairs == [(0, 1)] and np.allclose(model.effective()[:, nf], dense, atol=1e-5)


# 3: fingerprints


def shingle_set(text):
    w = text.lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def likeness(a, b):
    a, b = shingle_set(a), shingle_set(b)
    return len(a & b) / len(a | b) if a or b else 1.0


def test_fingerprints_against_brute_force(spark, odd_texts):
    rng = random.Random(3)
    texts = [*odd_texts, *(prose(rng, rng.randrange(1, 60)) for _ in range(1500))]
    rows = {r.doc_id: r for r in fingerprint.fingerprints(docs_of(spark, texts).withColumn("sketch", F.lit(1))).collect()}
    assert len(rows) == len(texts)
    own = [t or "" for t in texts]
    for i, t in enumerate(own):
        following = own[i - 1]
        n = len(t) // 3
        edited = t[: len(t) - n] + following[:n]
        r = rows[i]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        exact = max(len(shingle_set(t)), len(shingle_set(edited)), len(shingle_set(following))) < fingerprint.SKETCH_SIZE
        assert abs(r.near_edited - likeness(t, edited)) < (1e-9 if exact else 0.15)
        assert abs(r.near_next - likeness(t, following)) < (1e-9 if exact else 0.15)
    assert rows[10].fingerprint == rows[12].fingerprint and rows[0].fingerprint == rows[1].fingerprint == ""
    one = fingerprint.fingerprints(docs_of(spark, ["a b c d e f"])).first()
    assert one.near_next == 1.0
    assert fingerprint.fingerprints(docs_of(spark, ["a"]).limit(0)).count() == 0


def test_next_document_among_uneven_ids(spark, monkeypatch):
    monkeypatch.setattr(fingerprint, "BUCKET_ROWS", 4)
    ids = sorted({*range(300), *range(5000, 9000, 40), -(2**62), 2**62, 2**62 + 1, 10**15})
    docs = spark.createDataFrame([*((i, f"t{i}") for i in ids), (None, "none")], "doc_id bigint, text string")
    got = {r.doc_id: r.next_text for r in fingerprint.with_next(docs, {}).collect()}
    order = [*reversed(ids), None]
    assert got == {i: f"t{j}" if j is not None else "none" for i, j in zip(order, [*order[1:], order[0]], strict=True)}
    sizes = docs.groupBy(fingerprint._buckets(docs)).count()
    assert sizes.agg(F.max("count")).first()[0] <= 20 and sizes.count() > 50


def test_sketches_merge_and_estimate(spark):
    rng = random.Random(4)
    texts = [prose(rng, 900) for _ in range(4)]
    docs = docs_of(spark, [*texts, " ".join(texts[:2])], sources=["a", "a", "b", "b", "whole"])
    parts = docs.withColumn("sketch", fingerprint.sketch(F.col("text")))
    whole = {r.source: r.sketch for r in fingerprint.merged(parts, "source").collect()}
    sets = defaultdict(set)
    for r in parts.collect():
        sets[r.source] |= set(r.sketch)
    assert all(whole[s] == sorted(sets[s])[: fingerprint.SKETCH_SIZE] for s in sets)
    got = parts.filter("doc_id = 4").select(fingerprint.distinct_shingles(F.col("sketch")).alias("n")).first().n
    assert abs(got / len(shingle_set(" ".join(texts[:2]))) - 1) < 0.3
    pair = parts.filter("doc_id = 0").select(F.col("sketch").alias("a")).crossJoin(parts.filter("doc_id = 4").select(F.col("sketch").alias("b")))
    c = pair.select(fingerprint.containment(F.col("a"), F.col("b")).alias("ab"), fingerprint.containment(F.col("b"), F.col("a")).alias("ba")).first()
    assert c.ab > 0.95 and abs(c.ba - 0.5) < 0.15


# 4: chat


def test_escape_is_reversible_and_leaves_no_control():
    rng = random.Random(6)
    parts = [*chat.CONTROLS, "\\", "<", "|", "[", "\n", "n", "ok", "/INST]", "\\n"]
    for _ in range(3000):
        text = "".join(rng.choice(parts) for _ in range(rng.randrange(8)))
        done = chat.escape(text)
        assert chat.unescape(done) == text and not any(c in done for c in chat.CONTROLS)
        turns = [(text, text[::-1]), ("user", text)]
        assert chat.parse_marked(chat.marked_turns(turns)) == turns


def test_render_detects_rewriting():
    turns = [("user", "a"), ("assistant", "b"), ("user", "a")]
    text, spans, at = chat.render(turns, chat.marked_turns)
    assert at is None and [text[s[3] : s[4]] for s in spans] == ["a", "b", "a"]
    hides = lambda ts: "".join(f"{r}:{t if i == len(ts) - 1 else '...'};" for i, (r, t) in enumerate(ts))
    assert chat.render(turns, hides, lambda t: t)[1:] == (None, 1)
    trims = lambda ts: "".join(f"{r}:{t.strip()};" for r, t in ts)
    assert chat.render([("user", "x"), ("user", " y ")], trims, lambda t: t)[1:] == (None, 1)


def test_chat_against_brute_force(spark):
    rng = random.Random(7)
    rows = [(c, t, rng.choice(["user", "assistant", None, "a\nb"]), rng.choice([None, "", "hi <|end|>\n", "\\", prose(rng, 5), "é😀"])) for c in [*range(40), None] for t in range(rng.randrange(1, 9))]
    rows += [rows[0], (99, None, "assistant", "x"), (99, 1, "assistant", "y")]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").withColumn("n_turns", F.lit("clash"))
    got = {r.conv_id: r for r in chat.digests(chat.format_conversations(df)).collect()}
    want = defaultdict(list)
    for c, t, r, x in rows:
        want[c].append((-1 if t is None else t, (r or "").encode(), (x or "").encode()))
    assert set(got) == set(want)
    for c, turns in want.items():
        turns = [(r.decode(), x.decode()) for _, r, x in sorted(turns)]
        loss = "".join(x for r, x in turns if r == "assistant")
        g = got[c]
        assert (g.n_turns, g.loss_chars, g.formatted_chars, g.rewritten_at) == (len(turns), len(loss), len(chat.marked_turns(turns)), None)
        assert g.loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
        assert g.turns_sha256 == hashlib.sha256("".join(f"{r}\n{x}\n" for r, x in turns).encode()).hexdigest()
    assert chat.digests(chat.format_conversations(df.limit(0))).count() == 0


# 5: sharding


def test_shards_keep_rows_and_commit_atomically(spark, odd_texts, tmp_path):
    docs = docs_of(spark, [*odd_texts, *odd_texts]).repartition(6)
    store = sharding.shard_documents(docs, path=f"file://{tmp_path}/store")
    assert store.read().columns == docs.columns
    assert sorted(map(str, store.read().collect())) == sorted(map(str, docs.collect()))
    assert store.version() > sharding.ARRIVALS - 1 and len(store.manifest()) < len(store.manifest(store.version() - 1))
    before, base = store.read().count(), store.version()
    store.commit(store.manifest(), base)
    with pytest.raises(sharding.ConflictError):
        store.commit([], base)
    store.append(docs.limit(0))
    assert store.read().count() == before
    store.append(docs)
    store.compact()
    assert store.read().count() == 2 * before
    store.vacuum()
    assert store.read().count() == 2 * before
    empty = sharding.ShardStore(spark, f"file://{tmp_path}/empty", docs.schema)
    assert empty.read().count() == 0 and empty.compact() == 0


def test_runs_are_size_tiered():
    shard = lambda n, b: [{"path": f"{b}-{i}", "bytes": b} for i in range(n)]
    got = sharding.runs([*shard(5, 1000), *shard(3, 3 * 2**20), *shard(9, sharding.TARGET_BYTES)])
    assert [len(r) for r in got] == [5] and {s["bytes"] for s in got[0]} == {1000}


# 6: packing


def test_ids_equal_the_tokenizer_file(odd_texts):
    import public_tokenizers
    from tokenizers import Tokenizer

    bpe = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rng = random.Random(8)
    parts = [" ", "  ", "\n", "\t", "'", "s", "t", "re", "'ve", "ll", "L", "é", "ß", "日", "1", "²", "½", "!", "-", "😀", "d ", "<|endoftext|>", "_", " "]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(40))) for _ in range(1500)] + [t or "" for t in odd_texts]
    first = "".join("ab"[i.bit_count() % 2] for i in range(1024))  # a polynomial hash takes these two for one word
    texts += [first, first.translate(str.maketrans("ab", "ba")), "<|endoftext|>", "x<|endoftext|>\n"]
    assert [x.tolist() for x in packing.Encoder(packing.default_tokenizer()).ids(texts)] == [x.ids for x in bpe.encode_batch(texts, add_special_tokens=False)]
    alone = packing.Encoder(packing.default_tokenizer())
    assert [alone.ids([t])[0].tolist() for t in texts[-300:]] == [x.ids for x in bpe.encode_batch(texts[-300:], add_special_tokens=False)]


def test_runs_of_one_hash_are_told_apart(monkeypatch):
    monkeypatch.setattr(words, "hashes", lambda codes, starts, ends: np.zeros(len(starts), np.uint64))
    codes = np.frombuffer("ab cd ab ab".encode("utf-32-le"), "<u4")
    first, which = packing.told_apart(codes, np.array([0, 2, 3, 5, 6, 8, 9]))
    runs = ["ab", " ", "cd", " ", "ab", " ", "ab"]
    assert [runs[first[k]] for k in which] == runs


def test_packing_round_trip(spark, odd_texts):
    rng = random.Random(9)
    texts = [*odd_texts, *(prose(rng, rng.randrange(1, 900)) for _ in range(300))]
    docs = docs_of(spark, texts)
    docs = docs.unionByName(docs.filter("doc_id = 7")).withColumn("piece", F.lit("clash"))
    rows = packing.pack_documents(docs).collect()
    encoder = packing.Encoder(packing.default_tokenizer())
    copies = Counter(r.doc_id for r in rows if r.piece == 0)
    assert copies[7] == 2 and len(copies) == len(texts)
    pieces = defaultdict(dict)
    for r in rows:
        pieces[r.doc_id][r.piece] = r
    for i, t in enumerate(texts):
        ids = np.append(encoder.ids([t or ""])[0], 0).astype("<u4")
        own = [pieces[i][k] for k in range(len(pieces[i]))]
        assert [r.start for r in own] == [sum(x.length for x in own[:k]) for k in range(len(own))] and sum(r.length for r in own) == len(ids)
        assert all(zlib.crc32(ids[r.start : r.start + r.length].tobytes()) == r.ids_crc32 for r in own)
        assert all(r.length == packing.TOKENS for r in own[1:]) and (len(ids) > packing.TOKENS or len(own) == 1)
    sequences = defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append((r.offset, r.length))
    for parts in sequences.values():
        parts.sort()
        assert all(o == sum(n for _, n in parts[:k]) for k, (o, _) in enumerate(parts)) and sum(n for _, n in parts) <= packing.TOKENS
    total = sum(r.length for r in rows)
    assert len(sequences) <= -(-total // packing.TOKENS) + 2
    assert packing.pack_documents(docs.limit(0)).count() == 0


@pytest.mark.parametrize("score", ["norm", "dot"])
def test_best_fit_keeps_every_capacity(score):
    lengths = np.random.default_rng(1).integers(1, 100, 800)
    cap = (100.0, 5.0, 5200.0 + 100**2 / 2)
    bins, offsets = packing.best_fit(lengths, cap, (1.0, 0.5, 0.5), score)
    for b in set(bins.tolist()):
        own = lengths[bins == b]
        assert own.sum() <= cap[0] and len(own) <= cap[1] and (own.astype(float) ** 2).sum() <= cap[2]
        assert sorted(offsets[bins == b].tolist())[0] == 0


# 7: mixing


def test_mixing_targets_and_copies(spark):
    rng = random.Random(10)
    sources = ["a"] * 300 + ["b"] * 100 + [None] * 60 + ["c"] * 20 + ["empty"] * 3
    texts = [prose(rng, int(rng.paretovariate(1.2) * 20) % 900 + 1) for _ in range(480)] + [None, "", " \n"]
    docs = docs_of(spark, texts, sources=sources).withColumn("rate", F.lit("clash"))
    rows = {r.doc_id: r for r in mixing.mix_documents(docs).collect()}
    size = [len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for t in texts]
    assert all(rows[i].size == size[i] for i in rows) and len(rows) == len(texts)
    names = sorted({s for s in sources if s}) + [None]
    weight = {s: (1, 2, 3)[i % 3] for i, s in enumerate(names)}
    total = {s: sum(z for z, x in zip(size, sources, strict=True) if x == s) for s in names}
    target, left = {}, sum(size)
    free = set(names)
    while True:
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if share[s] > 3 * total[s]}
        if not over:
            target |= share
            break
        for s in over:
            target[s] = 3 * total[s]
            left -= target[s]
        free -= over
    for s in names:
        own = [rows[i] for i in rows if sources[i] == s]
        taken = sum(r.taken for r in own)
        assert all(abs(r.target - target[s]) < 1e-6 * max(1, target[s]) and r.source_size == total[s] for r in own)
        assert abs(taken - target[s]) <= max(0.02 * target[s], 3), (s, taken, target[s])
    assert all(r.taken == r.copies * r.size <= 3 * r.size for r in rows.values())
    assert {(r.doc_id, r.taken) for r in mixing.mix_documents(docs.repartition(7)).collect()} == {(i, r.taken) for i, r in rows.items()}
    mix = mixing.mixed(docs)
    assert mix.columns == docs.columns and Counter(r.doc_id for r in mix.collect()) == Counter({i: r.copies for i, r in rows.items() if r.copies})
    assert mixing.mix_documents(docs.limit(0)).count() == 0


def test_mixing_tilts_solve_the_dual(spark):
    rng = random.Random(17)
    rows = [(i, rng.choice("abcdef"), int(rng.paretovariate(1.1) * 5)) for i in range(3000)]
    sized = spark.createDataFrame([(i, s, z, i) for i, s, z in rows], "doc_id bigint, source string, size bigint, mark bigint")
    histogram = sized.groupBy("source", "size").agg(F.count(F.lit(1)).alias("n"))
    for r in mixing.source_tilts(histogram).collect():
        own = [z for _, s, z in rows if s == r.source]
        assert (r.source_size, r.source_rows) == (sum(own), len(own))
        rates = [3.0 if r.tilt is None else min(3.0, np.exp(min(50, r.tilt * z / r.scale))) for z in own]
        assert abs(np.dot(rates, own) - r.target) <= 2e-6 * r.target


def test_mixing_agrees_without_own_ids(spark):
    rng = random.Random(18)
    rows = [(rng.choice([None, 1, 2, i]), prose(rng, rng.randrange(1, 60)), "en", rng.choice(["a", "b", None]), 0) for i in range(4000)]
    docs = spark.createDataFrame([*rows, *rows[:50]], SCHEMA)
    taken = [Counter((r.doc_id, r.size, r.taken) for r in mixing.mix_documents(d).collect()) for d in (docs, docs.repartition(7, "text"))]
    assert taken[0] == taken[1]
    mix = mixing.mixed(docs).count()
    assert mix == mixing.mix_documents(docs).agg(F.sum("copies")).first()[0]
    ranked = mixing._ranked(spark.createDataFrame([(f"s{i:03}",) for i in range(250)] + [(None,)], "source string").repartition(5))
    got = [r.source for r in ranked.orderBy("rank").collect()]
    assert got == [*sorted(f"s{i:03}" for i in range(250)), None] and ranked.select("rank").distinct().count() == 251


# 8: near-duplicates


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_banded_alignment_is_exact():
    rng = random.Random(11)
    for _ in range(4000):
        k = rng.choice([2, 3, 6])
        a = [rng.randrange(k) for _ in range(rng.randrange(14))]
        b = [x if rng.random() < 0.8 else rng.randrange(k) for x in a if rng.random() < 0.9]
        most = rng.randrange(7)
        assert near_dedup.within(np.array(a, "<u4"), np.array(b, "<u4"), most) == (edit_distance(a, b) <= most)


def test_near_duplicates_against_brute_force(spark, odd_texts):
    rng = random.Random(12)
    shared = prose(rng, 60)
    bases = [prose(rng, rng.randrange(60, 160)) for _ in range(30)]
    texts = [*odd_texts, *bases, *(f"{prose(rng, 70)} {shared} {prose(rng, 70)}" for _ in range(25))]
    for b in bases[:12]:
        for _ in range(rng.randrange(1, 5)):
            w = b.split()
            for _ in range(rng.randrange(1, 4)):
                w[rng.randrange(len(w))] = rng.choice(VOCAB)
            texts.append(" ".join(w).capitalize() + ".")
    order = list(range(len(texts)))
    rng.shuffle(order)
    texts = [texts[i] for i in order]
    tokens = near_dedup.token_arrays([t or "" for t in texts])
    parent = list(range(len(texts)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            n = max(len(tokens[i]), len(tokens[j]))
            if abs(len(tokens[i]) - len(tokens[j])) <= 0.2 * n and near_dedup.similar(tokens[i], tokens[j]):
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    want = [root(i) for i in range(len(texts))]
    docs = docs_of(spark, texts)
    docs = docs.unionByName(docs.filter("doc_id = 3")).withColumn("class_id", F.lit("clash"))
    rows = near_dedup.classes(docs).collect()
    assert len(rows) == len(texts) + 1
    assert {r.doc_id: r.class_id for r in rows} == dict(enumerate(want))
    size = Counter(want)
    size[want[3]] += 1
    assert all(r.class_size == size[r.class_id] for r in rows)
    kept = near_dedup.deduplicate(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == sorted(set(want))
    assert near_dedup.classes(docs.limit(0)).count() == 0


def test_words_of_one_pattern_are_no_duplicates(spark):
    first = "".join("ab"[i.bit_count() % 2] for i in range(1024))
    docs = docs_of(spark, [first, first.translate(str.maketrans("ab", "ba"))])
    assert [r.class_id for r in near_dedup.classes(docs).orderBy("doc_id").collect()] == [0, 1]


def test_lower_bound_of_the_distance():
    rng = random.Random(25)
    for _ in range(2000):
        a = [rng.randrange(6) for _ in range(rng.randrange(1, 16))]
        b = [x if rng.random() < 0.8 else rng.randrange(6) for x in a if rng.random() < 0.9] or [0]
        assert near_dedup.least_distance(np.array(a, "<u4"), np.array(b, "<u4")) <= edit_distance(a, b)


def test_long_texts_share_keys():
    rng = np.random.default_rng(26)
    agreed = []
    for n in (1000, 1100, 1300, 5000):
        for _ in range(40):
            a = rng.integers(0, 2**63, n).astype(np.uint64)
            b = a.copy()
            at = rng.choice(n, int(0.19 * n), replace=False)
            b[at] = rng.integers(0, 2**63, len(at)).astype(np.uint64)
            b = b[: len(b) - n // 100]
            agreed.append(len(np.intersect1d(near_dedup.keys_of(a), near_dedup.keys_of(b))))
    assert np.mean(np.array(agreed) > 0) >= 0.99 and np.mean(agreed) > 5


def test_near_duplicates_without_own_ids(spark):
    rng = random.Random(21)
    texts = [prose(rng, 80) for _ in range(8)]
    near = texts[0].replace(texts[0].split()[40], "changed", 1)
    rows = [(None, texts[0]), (None, near), (None, texts[1]), (None, texts[2]), (4, texts[3]), (4, texts[4]), (5, texts[5]), (None, texts[5]), (6, texts[6]), (None, texts[6] + " more"), (None, None)]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], SCHEMA)
    kept = [(r.doc_id, r.text) for r in near_dedup.deduplicate(docs).collect()]
    first = min((texts[0], near), key=lambda t: hashlib.sha256(t.encode()).digest())
    assert sorted(kept, key=str) == sorted([(None, first), *rows[2:7], rows[8], rows[10]], key=str)
    found = Counter((r.doc_id, r.class_id, r.class_size) for r in near_dedup.classes(docs).collect())
    assert found == Counter({(None, None, 2): 2, (None, None, 1): 3, (4, 4, 1): 2, (5, 5, 2): 1, (None, 5, 2): 1, (6, 6, 2): 1, (None, 6, 2): 1})


def brute_classes(texts):
    tokens = near_dedup.token_arrays(texts)
    root = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            n = max(len(tokens[i]), len(tokens[j]))
            if root[i] != root[j] and abs(len(tokens[i]) - len(tokens[j])) <= 0.2 * n and near_dedup.similar(tokens[i], tokens[j]):
                a, b = sorted((root[i], root[j]))
                root = [a if x == b else x for x in root]
    return root


@pytest.mark.parametrize("crowded", [100, near_dedup.CROWDED])
def test_no_pair_of_a_crowded_bucket_is_left_out(spark, monkeypatch, crowded):
    rng = random.Random(22)
    monkeypatch.setattr(near_dedup, "CROWDED", crowded)
    monkeypatch.setattr(near_dedup, "CHUNK", 32, raising=False)
    monkeypatch.setattr(near_dedup, "CHUNKS_PER_TASK", 4, raising=False)
    vocab = [f"v{i}" for i in range(20_000)]
    shared = prose(rng, 100, vocab)  # in every text, while the rest is its own
    texts = [f"{shared} {prose(rng, rng.randrange(45, 60), vocab)}" for _ in range(300)]
    for t in rng.sample(texts, 40):  # chains of near copies, whose ends are not near each other
        for _ in range(2):
            w = t.split()
            for i in rng.sample(range(100, len(w)), len(w) // 6):
                w[i] = rng.choice(vocab)
            t = " ".join(w)
            texts.append(t)
    order = rng.sample(range(len(texts)), len(texts))
    texts = [texts[i] for i in order]
    sketched = near_dedup._sketched  # every text has the one key 7
    monkeypatch.setattr(near_dedup, "_sketched", lambda *a: sketched(*a).withColumn("keys", F.array(F.lit(7).cast("bigint"))))
    got = {r.doc_id: r.class_id for r in near_dedup.classes(docs_of(spark, texts)).collect()}
    want = brute_classes(texts)
    assert len(set(want)) > 250 and got == dict(enumerate(want))


def test_word_counts_never_part_similar_texts():
    rng = random.Random(23)
    for _ in range(300):
        a = [rng.randrange(40) for _ in range(rng.randrange(1, 60))]
        b = [rng.randrange(40) if rng.random() < 0.1 else x for x in a if rng.random() < 0.95] or [1]
        x, y = np.array(a, "<u4"), np.array(b, "<u4")
        counts = [np.bincount(t % near_dedup.COUNTS, minlength=near_dedup.COUNTS).astype(np.uint8) for t in (x, y)]
        assert near_dedup.maybe_similar(counts[0][None], np.array([len(x)]), counts[1], len(y))[0] or not near_dedup.similar(x, y)


def test_near_duplicates_at_the_threshold_and_in_short_texts(spark):
    rng = random.Random(24)
    vocab = [f"v{i}" for i in range(50_000)]
    pairs = []
    for kind in range(3):
        for _ in range(200):
            n = rng.randrange(5, 10) if kind == 2 else rng.randrange(100, 300)
            w = prose(rng, n, vocab).split()
            at = [[*range(4, n, 5)], rng.sample(range(n), int(rng.uniform(0.15, 0.2) * n)), [n // 2]][kind]
            pairs.append((kind, " ".join(w), " ".join("new" + x if i in at else x for i, x in enumerate(w))))
    pairs += [(2, "a1 b2 c3 d4 e5", "a1 b2 d4 e5"), (2, "f1 g2 h3 i4 j5 k6", "f1 g2 h3 new i4 j5 k6")]
    texts = [t for _, *pair in pairs for t in pair]
    got = {r.doc_id: r.class_id for r in near_dedup.classes(docs_of(spark, texts)).collect()}
    tokens = near_dedup.token_arrays(texts)
    of, found = Counter(), Counter()
    for i, (kind, _, _) in enumerate(pairs):
        if near_dedup.similar(tokens[2 * i], tokens[2 * i + 1]):
            of[kind] += 1
            found[kind] += got[2 * i] == got[2 * i + 1]
    assert of[2] >= 200 and found[2] == of[2]
    assert min(of[0], of[1]) >= 150 and found[0] >= 0.95 * of[0] and found[1] >= 0.98 * of[1]


def test_rarest_runs_of_similar_texts_meet():
    rng = random.Random(41)
    for _ in range(400):
        n = rng.randrange(1, 60)
        a = [rng.randrange(30) for _ in range(n)]
        b = list(a)
        for _ in range(rng.randrange(1 + n // 4)):
            i = rng.randrange(len(b))
            b[i : i + 1] = rng.choice([[], [rng.randrange(30)], [b[i], rng.randrange(30)]])
            b = b or [1]
        x, y = np.array(a, "<u4"), np.array(b, "<u4")
        if not near_dedup.similar(x, y) or a == b:
            continue
        for k in near_dedup.SPLIT_WORDS:
            runs = [set(np.sort(near_dedup.kmers(t.astype(np.uint64), k))[: near_dedup.rarest(len(t), k)].tolist()) for t in (x, y)]
            assert runs[0] & runs[1]


def test_signs_of_scripts_without_spaces_are_words(spark):
    rng = random.Random(42)
    han = "".join(chr(0x4E00 + rng.randrange(3000)) for _ in range(400))
    one, many = list(han), list(han)
    one[200] = "々"
    for i in range(0, 400, 2):
        many[i] = chr(0x8000 + rng.randrange(3000))
    texts = [han, "".join(one), "".join(many), "ab" + han]
    assert [len(t) for t in near_dedup.token_arrays([han, "한국어 문장", "ไทย", "ab漢字cd"])] == [400, 2, 3, 4]
    got = [r.class_id for r in near_dedup.classes(docs_of(spark, texts)).orderBy("doc_id").collect()]
    assert got == [0, 0, 2, 0]


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 120)] + [(7, 7)]
    got = {r.node: r.component for r in near_dedup.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {**dict.fromkeys(range(41), 0), **dict.fromkeys(range(100, 120), 100)}


# 9: HTML

PAGE = """<!DOCTYPE html><html><head><title>No</title><style>p{{}}</style><script>var t="</p>";</script></head>
<body><header><a href="/">Home</a></header><nav><ul><li><a href=1>One</a><li><a href=2>Two</a></ul></nav>
<div class="cookie-notice"><p>We would like to keep many small things in your browser if you let us.</p></div>
<article><h1>Title</h1><p><b>First &amp; caf&eacute;
 line.<br><p>Short.</p><div class="ad">Buy this very fine thing now, it is only here for a very short time.</div>
<p>{}</p><form><p>Give us your address here please and we will write to you every day</p></form><!-- no --></article>
<aside><p>{}</p></aside><section class="comments"><p>{}</p></section><footer>&copy; Someone</footer></body></html>"""


def test_extraction(spark):
    long = "word " * 40
    page = PAGE.format(long, long, long)
    want = "\n\n".join(["Title", "First & café line.", "Short.", long.strip()])
    plain = f"<body><div class=menu><a href=1>A</a></div><h1>Title here</h1><p>{long}</p><p>{long}</p><div id=footer>copy</div>"
    cases = [(1, "u", page, want), (1, "u", page, want), (2, None, None, ""), (3, "u", "", ""), (None, "u", plain, f"Title here\n\n{long.strip()}\n\n{long.strip()}"), (4, "u", page[: page.index("<form>") + 3], want)]
    df = spark.createDataFrame([c[:3] for c in cases], "page_id bigint, url string, html string").withColumn("text", F.lit("clash"))
    got = sorted((str(r.page_id), str(r.url), r.text, r.n_chars) for r in html_extract.extract(df).collect())
    assert got == sorted((str(a), str(b), t, len(t)) for a, b, _, t in cases)
    assert html_extract.extract(df.limit(0)).count() == 0


@pytest.mark.parametrize("page", ["<", "<<<", "<a", "<!-- x", "<script>x", "<p title='a>b' >x", "</div></p>", "&#x110000; &bogus; &am", "<p " + "'" * 3000, "<" * 3000, "<a b=\"" * 500])
def test_extraction_survives(page):
    assert isinstance(html_extract.main_text(page), str)


def _sentence(n):
    return "word " * (n - 1) + "end."


#: Pages (body, main text by block); names, regions and plain pages without any.
EXTRACTION_CASES = [
    (f"<article><p>{_sentence(12)}</p><p class='legal'>The court held that the statute applies to all.</p></article>", [_sentence(12), "The court held that the statute applies to all."]),
    (f"<article><p>{_sentence(9)}</p><p class='alert'>Officials warned that the river may rise again.</p></article>", [_sentence(9), "Officials warned that the river may rise again."]),
    (f"<article><header><h1>The title</h1><nav><a href='/'>x</a></nav></header><p>{_sentence(12)}</p></article>", ["The title", _sentence(12)]),
    (f"<main><section class='social'><p>{_sentence(40)}</p><p>{_sentence(41)}</p></section></main>", [_sentence(40), _sentence(41)]),
    (f"<div class='comment-free'><p>{_sentence(30)}</p></div>", [_sentence(30)]),
    ("<article><p>The sum <math><mi>x</mi><mo>+</mo><mi>y</mi></math> is given in this article about it.</p></article>", ["The sum x+y is given in this article about it."]),
    ("<h1>Note</h1><p>It rained today.</p>", ["Note", "It rained today."]),
    (f"<article><p>{_sentence(30)}</p><p>All rights reserved.</p></article>", [_sentence(30), "All rights reserved."]),
    (f"<article><p>{_sentence(30)}</p></article><p>© 2024 Example Media. All rights reserved.</p>", [_sentence(30)]),
    (f"<article><h1>T t</h1><p>{_sentence(60)}</p></article><div><h3>Readers</h3><div><b>Ann</b><p>{_sentence(20)}</p></div></div>", ["T t", _sentence(60)]),
    (f"<article><h1>T t</h1><p>{_sentence(60)}</p></article><section class='comments'><article><p>{_sentence(20)}</p></article></section>", ["T t", _sentence(60)]),
    (f"<article><h1>T t</h1><p>{_sentence(60)}</p><div class='ad'><p>{_sentence(20)}</p></div><p>{_sentence(30)}</p></article>", ["T t", _sentence(60), _sentence(30)]),
    (f"<article><h1>T t</h1><p>{_sentence(60)}</p><aside><p>{_sentence(20)}</p></aside></article>", ["T t", _sentence(60)]),
    (f"<main><h1>T t</h1><p>{_sentence(60)}</p><form><p>{_sentence(10)}</p></form></main>", ["T t", _sentence(60)]),
    (f"<div id='cookie-consent'><p>{_sentence(25)}</p><a href=x>OK</a></div><h1>T t</h1><p>{_sentence(60)}</p>", ["T t", _sentence(60)]),
    (f"<div><a href=1>A</a><a href=2>B</a></div><h1>T t</h1><p>{_sentence(30)}</p><p>{_sentence(4)}</p><p>{_sentence(30)}</p><div>Contact <a href=1>us</a> <a href=3>Imprint</a></div>", ["T t", _sentence(30), _sentence(4), _sentence(30)]),
]


@pytest.mark.parametrize("body,want", EXTRACTION_CASES)
def test_extraction_of_blocks(body, want):
    assert html_extract.main_text(f"<html><body>{body}</body></html>").split("\n\n") == want


def test_extraction_on_held_out_pages():
    """Pages of three layouts with random sizes: by token, at least 0.97 of the main text and of what is kept."""
    rng = random.Random(9)
    kept = wanted = common = 0
    for i in range(300):
        title = prose(rng, rng.randint(2, 9)).capitalize()
        body = [prose(rng, rng.randint(3, 90)) + "." for _ in range(rng.randint(2, 9))]
        menu = "".join(f"<li><a href=/{w}>{w}</a>" for w in rng.sample(VOCAB, 6))
        text = "".join(f"<p>{p}</p>" for p in body)
        other = prose(rng, rng.randint(6, 25)) + "."
        page = (
            f"<nav><ul>{menu}</ul></nav><div class=ad>{other}</div><article><h1>{title}</h1>{text}</article><footer>© x {other}</footer>",
            f"<div class=menu><ul>{menu}</ul></div><h1>{title}</h1>{text}<div id=sidebar><p>{other}</p></div><div>© 2020 {other}</div>",
            f"<ul>{menu}</ul><main><h1>{title}</h1>{text}<section class=comments><p>{other}</p></section></main><p>{other}</p>",
        )[i % 3]
        got = html_extract.main_text(f"<body>{page}</body>").split("\n\n")
        want = [title, *body]
        size = lambda xs: sum(len(x.split()) for x in xs)
        kept, wanted, common = kept + size(got), wanted + size(want), common + size([x for x in got if x in want])
    assert common / wanted >= 0.97 and common / kept >= 0.97, (common / wanted, common / kept)


def test_extraction_tree_asks_more_than_names():
    """The tree equals its table but for rows with both labels, and its root is no name."""
    rows = [tuple(map(float, line.split())) for line in html_extract.LABELLED.strip().splitlines()]
    wrong = [r for r in rows if html_extract.is_main(r[:-1]) != bool(r[-1])]
    assert html_extract.FEATURES[html_extract.tree()[0]] not in ("barred", "named") and len(wrong) <= 0.02 * len(rows)
    assert {r[-1] for r in rows if r[1]} == {0.0, 1.0}


# 10: exact dedup


def brute_groups(texts):
    groups = defaultdict(list)
    for i, t in enumerate(texts):
        groups[re.sub(r"[\x20\x09-\x0D]", "", t or "")].append((-len(t or ""), i))
    return {k: (min(v)[1], len(v)) for k, v in groups.items()}


def test_exact_dedup_against_brute_force(spark, odd_texts):
    rng = random.Random(13)
    texts = [*odd_texts, *(prose(rng, 2, VOCAB[:12]) for _ in range(400))]
    docs = docs_of(spark, texts).withColumn("kept", F.lit("clash"))
    rows = {r.doc_id: r for r in exact_dedup.groups(docs).collect()}
    want = brute_groups(texts)
    for i, t in enumerate(texts):
        norm = re.sub(r"[\x20\x09-\x0D]", "", t or "")
        keep, size = want[norm]
        r = rows[i]
        assert (r.keep_id, r.group_size, r.kept, r.text_sha256) == (keep, size, keep == i, hashlib.sha256(norm.encode()).hexdigest())
    kept = exact_dedup.deduplicate(docs.unionByName(docs))
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == sorted(k for k, _ in want.values())
    assert exact_dedup.groups(docs.limit(0)).count() == 0
    assert exact_dedup.groups(docs, F.lit(True)).filter("kept").count() == len(want)


def test_exact_dedup_takes_any_id(spark):
    least, most = -(2**63), 2**63 - 1
    rows = [(most, "a b"), (least, "ab "), (None, "a b"), (2**53 + 1, "c"), (2**53 + 2, "c"), (None, "c"), (None, "d"), (None, "d e"), (0, "long one"), (1, "long  one")]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], SCHEMA)
    for split in (None, F.lit(True), F.lit(False), F.col("doc_id") > 0):
        got = Counter((r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact_dedup.groups(docs, split).collect())
        assert got == Counter({(most, least, 3, False): 1, (least, least, 3, True): 1, (None, least, 3, False): 1, (2**53 + 1, 2**53 + 1, 3, True): 1, (2**53 + 2, 2**53 + 1, 3, False): 1, (None, 2**53 + 1, 3, False): 1, (None, None, 1, True): 2, (0, 1, 2, False): 1, (1, 1, 2, True): 1})
    assert sorted(r.text for r in exact_dedup.deduplicate(docs).collect()) == ["ab ", "c", "d", "d e", "long  one"]


def test_exact_dedup_deals_arrivals_without_history(spark, monkeypatch):
    shards, merge = [], exact_dedup.merge
    monkeypatch.setattr(exact_dedup, "KEYS_PER_SHARD", 10)
    monkeypatch.setattr(exact_dedup, "merge", lambda i, a, n: shards.append(n) or merge(i, a, n))
    rows = exact_dedup.groups(docs_of(spark, [*(f"text {i}" for i in range(95)), "text 1"]), F.lit(False)).collect()
    assert shards == [10] and len(rows) == 96 and sum(r.kept for r in rows) == 95


def test_perfect_hash_is_minimal():
    keys = np.random.default_rng(1).integers(0, 2**63, (5000, 4)).astype(np.uint64)
    sizes, bits = exact_dedup.build_levels(keys)
    assert sorted(exact_dedup.slots_of(keys, sizes, bits).tolist()) == list(range(5000))


# pipeline


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(14)
    base = [prose(rng, 80) for _ in range(60)]
    near = [b.replace(b.split()[3], "changed", 1) for b in base[:10]]
    bad = [" ".join(w + "!!" for w in prose(rng, 40).split()) for _ in range(40)]
    texts = [*base, *near, *base[:5], *bad, None, ""]
    docs = docs_of(spark, texts)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int(not 75 <= i < 115)) for i in range(115)], "doc_id bigint, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    at = spark.read.parquet(f"{tmp_path}/documents.parquet")
    seen = []
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, at, str(tmp_path))
        assert i == 4 or out.columns == docs.columns
        out.write.parquet(f"{tmp_path}/{i}")
        at = spark.read.parquet(f"{tmp_path}/{i}")
        seen.append(sorted(r.doc_id for r in at.select("doc_id").collect()))
    assert [i for i in range(75) if i not in seen[0]] == [] and not set(range(75, 115)) & set(seen[0])
    assert set(seen[1]) & set(range(115)) == set(range(70)) and set(seen[2]) & set(range(115)) == set(range(60))
    assert set(seen[3]) <= set(seen[2]) and set(seen[4]) == set(seen[3])
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == len(seen[4])


def test_word_hashes_tell_runs_apart():
    codes, kinds, bounds = words.points(["ab ab", "abab", ""])
    start = np.array([0, 3, 6])
    h = words.hashes(codes, start, np.array([2, 5, 10]))
    assert h[0] == h[1] != h[2] and bounds.tolist() == [0, 6, 11, 12] and kinds[5] == words.BREAK

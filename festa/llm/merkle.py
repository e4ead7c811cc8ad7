"""Merkle manifest of a table, with a proof for every row by lookups of node coordinates.

A row's leaf is the SHA-256 of its fields. Each language's leaves, by ascending id, form a tree in which every 8
consecutive nodes become one; the trees' roots, by language, form a tree of the same kind. All nodes are stored as
runs: (tree, level, run) with the digests of its up to 8 nodes. A leaf's position and the sizes of its trees tell
which runs its proof needs; each leaf asks for those coordinates, joins the stored runs, orders what it finds and
folds it. Texts are read once and never move. Positions come from one sort by range: a row's place in its partition
plus the rows of the partitions before. Levels of few runs, which all leaves ask for, are broadcast (at most
``FEW_RUNS`` runs together, counted first); any other run is asked for by a small part of the leaves only.

Defined results: null ids stand before all others, rows that share language and id stand by leaf (equal leaves are
alike in any order); null and empty fields differ; a null language is a tree of its own; one row is its own root
and proves by the digest of nothing; a null id is never tampered with; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from festa.llm.common import stored
from festa.llm.licenses import lowered

FAN_OUT = 8
#: The most runs (of 8 digests, 256 bytes) that are broadcast together, and the most languages.
FEW_RUNS = 8_192
FEW_LANGUAGES = 10_000
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: The tree over the languages' roots, and the first of its levels: above any level of a language.
TOP, TOP_LEVEL = -1, 100


def hashed(hex_text: Column) -> Column:
    return F.sha2(hex_text.cast("binary"), 256)


def hex_of(digest: Column) -> Column:
    return F.lower(F.hex(digest))


def field(value: Column) -> Column:
    """``-`` for null, else the number of UTF-8 bytes, a colon and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(columns: dict[str, Column]) -> Column:
    return hashed(F.concat(*[field(columns[c]) for c in FIELDS]))


def depth(size: Column) -> Column:
    """How often ``size`` nodes are grouped until one is left."""
    powers = F.array(*[F.lit(FAN_OUT**i) for i in range(21)])
    return F.size(F.filter(powers, lambda p: p < size))


def ranked(rows: DataFrame, by: list[Column]) -> DataFrame:
    """``rows``, stored, with ``at``: their places from 0 in the order of ``by``. Rows alike in ``by`` may share no task."""
    tie, keys = "__tie", [f"__by{i}" for i in range(len(by))]
    keyed = rows.withColumns({tie: F.monotonically_increasing_id(), **dict(zip(keys, by, strict=True))})
    order = [*[F.col(k).asc_nulls_first() for k in keys], F.col(tie)]
    placed = keyed.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__place", F.monotonically_increasing_id())
    placed = stored(placed.drop(tie, *keys))
    part = F.shiftrightunsigned("__place", 33)
    sizes = placed.groupBy(part.alias("__part")).count()
    before = F.sum("count").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))  # one row a partition
    starts = sizes.select("__part", F.coalesce(before, F.lit(0)).alias("__start"))
    at = F.col("__start") + F.col("__place").bitwiseAND(2**33 - 1)
    return placed.withColumn("__part", part).join(F.broadcast(starts), "__part").withColumn("at", at).drop("__part", "__start", "__place")


def grouped(nodes: DataFrame, level: int) -> DataFrame:
    """Runs of the nodes (tree, size, at, digest) of one level: tree, level, run, size, digests (one after the other)."""
    run = F.floor(F.col("at") / FAN_OUT).alias("run")
    listed = F.sort_array(F.collect_list(F.struct("at", "digest")))
    digests = F.unhex(F.array_join(F.transform(listed, lambda x: F.hex(x["digest"])), ""))
    return nodes.groupBy("tree", "size", run).agg(digests.alias("digests")).select("tree", F.lit(level).alias("level"), "run", "size", "digests")


def levels(nodes: DataFrame, most: int, first_level: int = 0) -> Iterator[DataFrame]:
    """The stored runs of each level that groups nodes, up to one node in trees of ``most`` nodes at most."""
    level = first_level
    while most > 1:
        runs = stored(grouped(nodes.filter(F.col("size") > 1), level))
        yield runs
        nodes = parents(runs)
        most, level = -(-most // FAN_OUT), level + 1


def parents(runs: DataFrame) -> DataFrame:
    return runs.select("tree", F.ceil(F.col("size") / FAN_OUT).alias("size"), F.col("run").alias("at"), F.unhex(hashed(hex_of(F.col("digests")))).alias("digest"))


def roots(nodes: DataFrame, found: list[DataFrame]) -> DataFrame:
    """tree, root: the node that is left of each tree."""
    every = [nodes, *map(parents, found)]
    return reduce(DataFrame.unionByName, [n.filter(F.col("size") == 1).select("tree", F.col("digest").alias("root")) for n in every])


def coordinates(at: Column, size: Column, tree: Column, first_level: int) -> Column:
    """The runs on the way from node ``at`` to its tree's root, each with the node's place in it."""
    powers = F.array(*[F.lit(FAN_OUT**i) for i in range(21)])
    up = lambda p, i: F.struct(
        tree.cast("bigint").alias("tree"),
        (i + first_level).cast("int").alias("level"),
        F.floor(at / (p * FAN_OUT)).cast("bigint").alias("run"),
        (F.floor(at / p) % FAN_OUT).cast("int").alias("own"),
    )
    return F.transform(F.slice(powers, F.lit(1), depth(size)), up)


def looked_up(asked: DataFrame, runs: list[DataFrame]) -> DataFrame:
    """at, level, left, right of every coordinate asked for: the digests before and after the own one in its run."""
    sized = sorted(((r.count(), r) for r in runs), key=lambda x: x[0])
    few, rest, total = [], [], 0
    for count, r in sized:
        total += count
        (few if total <= FEW_RUNS else rest).append(r)
    levels_of = lambda rs: [x.select("level").first()[0] for x in rs]
    out, key = [], ["tree", "level", "run"]
    for part, how in ((few, F.broadcast), (rest, lambda x: x)):
        if part:
            table = reduce(DataFrame.unionByName, part).drop("size")
            out.append(asked.filter(F.col("level").isin(levels_of(part))).join(how(table), key))
    found = reduce(DataFrame.unionByName, out)
    before = F.col("own") * 32
    left = F.substring("digests", F.lit(1), before)
    right = F.substring("digests", before + 33, F.octet_length("digests"))
    return found.select("at", "level", left.alias("left"), right.alias("right"))


def manifest(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, leaf, subroot, root, proof_sha256, folded_root, verified."""
    columns = {c: F.col(c) for c in FIELDS}
    tampered = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0, F.lit(False))
    start = F.when(tampered, F.unhex(leaf(columns | {"text": lowered(F.col("text"))})))
    leaves = ranked(docs.select("doc_id", "lang", F.unhex(leaf(columns)).alias("leaf"), start.alias("start")), [F.col(c) for c in ("lang", "doc_id", "leaf")])
    trees = leaves.groupBy("lang").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("size"))
    trees = stored(ranked(trees, [F.col("first")]).withColumnRenamed("at", "tree"))
    n_trees, most = trees.agg(F.count(F.lit(1)), F.max("size")).first()
    few = F.broadcast if n_trees <= FEW_LANGUAGES else lambda x: x
    same = leaves["lang"].eqNullSafe(trees["lang"])
    leaves = stored(leaves.join(few(trees), same).select(leaves["at"], "doc_id", "leaf", "start", "tree", "size", (leaves["at"] - F.col("first")).alias("place")))

    nodes = leaves.select("tree", "size", F.col("place").alias("at"), F.col("leaf").alias("digest"))
    runs = list(levels(nodes, most or 0))
    subroots = stored(roots(nodes, runs))
    tops = subroots.select(F.lit(TOP).cast("bigint").alias("tree"), F.lit(n_trees).cast("bigint").alias("size"), F.col("tree").alias("at"), F.col("root").alias("digest"))
    top_runs = list(levels(tops, n_trees, TOP_LEVEL))
    found = roots(tops, top_runs).first()
    root = F.lit(bytes(found["root"]).hex() if found else None).cast("string")

    way = F.concat(coordinates(F.col("place"), F.col("size"), F.col("tree"), 0), coordinates(F.col("tree"), F.lit(n_trees), F.lit(TOP), TOP_LEVEL))
    own = leaves.select("at", F.lit(-1).alias("level"), F.lit(None).cast("binary").alias("left"), F.lit(None).cast("binary").alias("right"), F.struct("doc_id", "leaf", "start", "tree").alias("own"))
    parts = own
    if runs or top_runs:
        asked = leaves.select("at", F.explode(way).alias("c")).select("at", "c.*")
        parts = own.unionByName(looked_up(asked, [*runs, *top_runs]), allowMissingColumns=True)
    steps = F.filter(F.sort_array(F.collect_list(F.struct("level", "left", "right"))), lambda x: x["level"] >= 0)
    proofs = parts.groupBy("at").agg(F.max("own").alias("own"), steps.alias("steps")).select("own.*", "steps")
    siblings = F.array_join(F.transform("steps", lambda x: F.concat(hex_of(x["left"]), hex_of(x["right"]))), "")
    fold = F.aggregate("steps", hex_of(F.coalesce("start", "leaf")), lambda a, x: hashed(F.concat(hex_of(x["left"]), a, hex_of(x["right"]))))
    done = proofs.select("doc_id", "tree", hex_of(F.col("leaf")).alias("leaf"), root.alias("root"), hashed(siblings).alias("proof_sha256"), fold.alias("folded_root"))
    done = done.join(few(subroots.withColumn("root", hex_of(F.col("root"))).withColumnRenamed("root", "subroot")), "tree")
    return done.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


#: Levels that the oracle unrolls: languages and trees of up to 8 ** 7 nodes.
SQL_LEVELS = 7


def oracle_sql() -> str:
    """DuckDB SQL for ``manifest`` over ``documents`` of up to 8 ** 7 rows a language."""
    part = lambda c: f"coalesce(strlen({c})::VARCHAR || ':' || {c}, '-')"
    leaf_of = lambda text: "sha256(" + " || ".join(part(c) for c in ("doc_id::VARCHAR", "source", "lang", "n_chars::VARCHAR", text)) + ")"
    steps, ways = [], []
    for tree, size, base in (("n", "size", "leaves"), ("s", "n_trees", "tops")):
        steps.append(f"{tree}0 AS (SELECT tree, {size} AS size, place AS i, digest FROM {base})")
        for k in range(SQL_LEVELS):
            steps.append(f"{tree}{k + 1} AS (SELECT tree, (size + 7) // 8 AS size, i // 8 AS i, sha256(string_agg(digest, '' ORDER BY i)) AS digest FROM {tree}{k} WHERE size > 1 GROUP BY tree, size, i // 8)")
            ways.append((f"{tree}{k}", 8**k, "tree, place" if tree == "n" else "-1 AS tree, tree AS place", k if tree == "n" else TOP_LEVEL + k))
    every = lambda t: " UNION ALL ".join(f"SELECT tree, digest FROM {t}{k} WHERE size = 1" for k in range(SQL_LEVELS + 1))
    asked = " UNION ALL ".join(
        f"SELECT r, {level} AS level, string_agg(x.digest, '' ORDER BY i) FILTER (i < p.place // {power}) AS l, string_agg(x.digest, '' ORDER BY i) FILTER (i > p.place // {power}) AS g "
        f"FROM (SELECT r, {columns} FROM leaves) p JOIN {t} x ON x.tree = p.tree AND x.size > 1 AND x.i // 8 = p.place // {8 * power} GROUP BY r"
        for t, power, columns, level in ways
    )
    folds = [
        f"f{i + 1} AS (SELECT f.r, CASE WHEN a.r IS NULL THEN h ELSE sha256(coalesce(l, '') || h || coalesce(g, '')) END AS h FROM f{i} f LEFT JOIN asked a ON a.r = f.r AND level = {level})"
        for i, (_, _, _, level) in enumerate(ways)
    ]
    crc = "list_reduce([4294967295::UBIGINT] || list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::UBIGINT), lambda c, b: list_reduce([xor(c, b)] || list_transform(range(8), lambda x: x::UBIGINT), lambda d, x: xor(d >> 1, 3988292384::UBIGINT * (d & 1))))"
    return f"""
        WITH d AS (
            SELECT doc_id, lang, {leaf_of("text")} AS digest,
                   CASE WHEN xor({crc}, 4294967295::UBIGINT) % 3 = 0
                   THEN {leaf_of(f"translate(text, '{"ABCDEFGHIJKLMNOPQRSTUVWXYZ"}', '{"abcdefghijklmnopqrstuvwxyz"}')")} END AS start
            FROM documents),
        leaves AS (
            SELECT *, row_number() OVER () AS r, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, digest) - 1 AS place,
                   count(*) OVER (PARTITION BY lang) AS size, dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS tree FROM d),
        {", ".join(steps[: SQL_LEVELS + 1])},
        subroots AS ({every("n")}),
        tops AS (SELECT -1 AS tree, count(*) OVER () AS n_trees, tree AS place, digest FROM subroots),
        {", ".join(steps[SQL_LEVELS + 1 :])},
        roots AS ({every("s")}),
        asked AS ({asked}),
        proofs AS (SELECT r, string_agg(coalesce(l, '') || coalesce(g, ''), '' ORDER BY level) AS p FROM asked GROUP BY r),
        f0 AS (SELECT r, coalesce(start, digest) AS h FROM leaves),
        {", ".join(folds)}
        SELECT doc_id, leaves.digest AS leaf, s.digest AS subroot, roots.digest AS root, sha256(coalesce(p, '')) AS proof_sha256,
               h AS folded_root, h = roots.digest AS verified
        FROM leaves JOIN f{len(folds)} USING (r) JOIN subroots s USING (tree) CROSS JOIN roots LEFT JOIN proofs USING (r)
    """

"""License scans: fixed phrases, and an exact set-similarity join of text blocks with templates of license statements.

A text is cut into blocks of 64 words, one starting at every 32nd word, so that any run of up to 33 words lies whole
in some block. A block matches a template if it holds at least ``THRESHOLD`` of the template's distinct words. The
join finds every such pair: words are ordered by their number of blocks, rarest first; a template is indexed under
its first ``size - need + 1`` words alone, of which a matching block holds at least one, among its own first
``size - need + 1``; too short blocks and pairs whose remaining words cannot reach the need go before the words
are compared. Only words of templates matter, so blocks carry no others. DataFrame functions alone.

Texts are read once; what later steps need (counts, places, blocks with enough template words) is written to the
shared folder under a number for each row, so that repeated rows, equal texts and frequent lines make no key hot.

Defined results: a null or empty text has no words, no labels and score 0; every row gives one row, repeated or null
ids too; further columns are ignored; an empty table gives an empty result; no templates leave the phrases alone.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from math import ceil

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from festa.llm.common import stored, text_of

#: Words are runs of anything but ASCII other than a-z and 0-9, in texts with A-Z in lower case.
BREAKS = r"\x00-\x2F\x3A-\x60\x7B-\x7F"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: The phrases that the contract names, with their labels.
PHRASES = (("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit"))
#: Statements by which texts tell their license, with the labels that the join adds. At most STRIDE + 1 words each.
TEMPLATES = (
    ("gpl-3", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl-2", "This work is licensed under the GNU General Public License, version 2."),
    ("gpl-notice", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation."),
    ("lgpl", "Licensed under the GNU Lesser General Public License."),
    ("agpl", "Licensed under the GNU Affero General Public License."),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("mit-statement", "Released under the MIT License."),
    ("mit-notice", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files."),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met."),
    ("mpl-2.0", "This source code form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0."),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0."),
    ("cc-by-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("public-domain", "This is free and unencumbered software released into the public domain."),
    ("reserved", "Copyright. All rights reserved."),
)
BLOCK_WORDS, STRIDE = 64, 32
THRESHOLD = 0.8
#: The most distinct words of all templates together: they are constants of the plan.
MOST_TEMPLATE_WORDS = 20_000


@dataclass(frozen=True)
class Template:
    label: str
    words: tuple[str, ...]
    need: int


def lowered(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(lowered(text), F.lit(f"([^{BREAKS}]+)"), 1)


def templates_of(pairs, threshold: float = THRESHOLD) -> list[Template]:
    """Templates as sets of words with the overlap that each needs; those without words go."""
    out = []
    for label, text in pairs:
        found = re.findall(f"[^{BREAKS}]+", text.translate(str.maketrans(UPPER, LOWER)))
        if len(found) > STRIDE + 1:
            raise ValueError(f"{label}: a template has at most {STRIDE + 1} words")
        if found:
            distinct = tuple(dict.fromkeys(found))
            out.append(Template(label, distinct, ceil(threshold * len(distinct) - 1e-9)))
    if len({w for t in out for w in t.words}) > MOST_TEMPLATE_WORDS:
        raise ValueError(f"templates have at most {MOST_TEMPLATE_WORDS} distinct words")
    return out


def places(words: Column, phrase: str) -> Column:
    """The numbers of the words at which ``phrase`` begins."""
    first, *rest = phrase.split(" ")

    def begins(i: Column) -> Column:
        here = F.get(words, i) == first
        for k, w in enumerate(rest, 1):
            here = here & F.coalesce(F.get(words, i + k) == w, F.lit(False))
        return here

    return F.filter(F.sequence(F.lit(0), F.size(words) - 1), begins)


def has_phrase(text: Column, phrases=PHRASES) -> Column:
    """Whether any phrase occurs, by one scan of the text."""
    one = "|".join(f"[{BREAKS}]+".join(p.split(" ")) for p, _ in phrases)
    return lowered(text).rlike(f"(?:^|[{BREAKS}])(?:{one})(?:$|[{BREAKS}])")


def blocks_of(words: Column, vocabulary: list[str], least: int) -> Column:
    """Blocks as (block, words), words of ``vocabulary`` once each; blocks with fewer than ``least`` of them go."""
    count = F.greatest(F.lit(1), F.ceil((F.size(words) - (BLOCK_WORDS - STRIDE)) / F.lit(STRIDE)).cast("int"))
    known = lambda w: w.isin(vocabulary)
    block = lambda b: F.struct(b.alias("block"), F.array_distinct(F.filter(F.slice(words, b * STRIDE + 1, BLOCK_WORDS), known)).alias("words"))
    return F.filter(F.transform(F.sequence(F.lit(0), count - 1), block), lambda b: F.size(b["words"]) >= least)


def prepared(docs: DataFrame, templates: list[Template]) -> DataFrame:
    """One stored row for each row of ``docs``: row, doc_id, n_words, the phrases' places by label, blocks."""
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id"), text_of().alias("text"))
    rows = rows.select("row", "doc_id", has_phrase(F.col("text")).alias("has"), words_of(F.col("text")).alias("words"))
    words, none = F.col("words"), F.array().cast("array<int>")
    found = F.array(*[F.struct(F.lit(label).alias("label"), F.when(F.col("has"), places(words, p)).otherwise(none).alias("places")) for p, label in PHRASES])
    vocabulary = sorted({w for t in templates for w in t.words})
    least = min((t.need for t in templates), default=0)
    no_blocks = F.array().cast("array<struct<block:int,words:array<string>>>")
    blocks = F.when(F.size(words) > 0, blocks_of(words, vocabulary, least)).otherwise(no_blocks) if templates else no_blocks
    return stored(rows.select("row", "doc_id", F.size(words).cast("bigint").alias("n_words"), F.filter(found, lambda x: F.size(x["places"]) > 0).alias("found"), blocks.alias("blocks")))


def matches(blocks: DataFrame, templates: list[Template]) -> DataFrame:
    """Every pair of a block and a template it holds enough of: the block's columns, label, overlap, size.

    ``blocks`` has ``words``, distinct words of templates; its other columns are carried along.
    """
    spark, carried = blocks.sparkSession, [c for c in blocks.columns if c != "words"]
    counts = dict(blocks.select(F.explode("words").alias("word")).groupBy("word").count().collect())  # words of templates alone
    order = sorted({w for t in templates for w in t.words}, key=lambda w: (counts.get(w, 0), w))
    at = {w: i for i, w in enumerate(order)}
    index = []
    for t in templates:
        ordered = sorted(t.words, key=at.__getitem__)
        index += [(w, t.label, i, ordered, len(ordered), t.need) for i, w in enumerate(ordered[: len(ordered) - t.need + 1])]
    index_rows = spark.createDataFrame(index, "word string, label string, i int, template array<string>, size int, need int")
    literal = lambda ws: F.array(*[F.lit(w) for w in ws])
    sorted_blocks = blocks.select(*carried, F.array_intersect(literal(order), F.col("words")).alias("words"))
    first = {w for w, *_ in index}
    asked = sorted_blocks.select(*carried, "words", F.posexplode("words").alias("j", "word")).filter(F.col("word").isin(sorted(first)))
    pairs = asked.join(F.broadcast(index_rows), "word")  # at most the templates' words
    size = F.size("words")
    near = (size >= F.col("need")) & (F.col("j") <= size - F.col("need"))
    near = near & (1 + F.least(F.col("size") - F.col("i") - 1, size - F.col("j") - 1) >= F.col("need"))
    # the first common word alone stands for a pair
    shared = F.array_intersect(F.col("template"), F.col("words"))
    pairs = pairs.filter(near).select(*carried, "word", "label", "size", "need", shared.alias("shared"))
    held = pairs.filter((F.get("shared", F.lit(0)) == F.col("word")) & (F.size("shared") >= F.col("need")))
    return held.select(*carried, "label", F.size("shared").alias("overlap"), "size")


def scan(docs: DataFrame, templates=TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """Per row: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score (1 with a phrase, else the greatest share of a template)."""
    known = templates_of(templates, threshold)
    rows = prepared(docs, known)
    blocks = rows.select("row", F.explode("blocks").alias("b")).select("row", "b.block", "b.words")
    pairs = matches(blocks, known) if known else blocks.select("row", F.lit("").alias("label"), F.lit(0).alias("overlap"), F.lit(1).alias("size")).limit(0)
    found = pairs.groupBy("row").agg(F.collect_set("label").alias("added"), F.max(F.col("overlap") / F.col("size")).alias("share"))
    spots = F.flatten(F.transform("found", lambda x: x["places"]))
    base = F.transform("found", lambda x: x["label"])
    joined = lambda labels: F.array_join(F.array_sort(F.array_distinct(labels)), ",")
    return (
        rows.drop("blocks")
        .join(found, "row", "left")
        .select(
            "doc_id",
            "n_words",
            F.size(spots).cast("bigint").alias("n_base"),
            F.array_min(spots).cast("bigint").alias("first_word"),
            F.array_max(spots).cast("bigint").alias("last_word"),
            joined(base).alias("base_labels"),
            joined(F.concat(base, F.coalesce(F.col("added"), F.array().cast("array<string>")))).alias("labels"),
            F.when(F.size("found") > 0, 1.0).otherwise(F.coalesce(F.col("share"), F.lit(0.0))).alias("score"),
        )
    )


def oracle_sql() -> str:
    """DuckDB SQL for ``scan`` over ``documents``: every block against every template."""
    text = lambda s: "'" + s.replace("'", "''") + "'"
    phrases = ", ".join(f"({text(p)}, {text(label)})" for p, label in PHRASES)
    templates = ", ".join(f"({text(t.label)}, [{', '.join(map(text, t.words))}], {t.need})" for t in templates_of(TEMPLATES))
    return rf"""
        WITH d AS (
            SELECT row_number() OVER () AS r, doc_id,
                   regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^{BREAKS}]+') AS w FROM documents),
        phrases AS (SELECT * FROM (VALUES {phrases}) AS v(phrase, label)),
        templates AS (SELECT * FROM (VALUES {templates}) AS v(label, words, need)),
        spots AS (
            SELECT r, label, i - 1 AS spot FROM (SELECT r, w, unnest(range(1, len(w) + 1)) AS i FROM d), phrases
            WHERE array_to_string(w[i : i + len(string_split(phrase, ' ')) - 1], ' ') = phrase),
        base AS (SELECT r, count(*) AS n, min(spot) AS first_word, max(spot) AS last_word, list(DISTINCT label) AS labels FROM spots GROUP BY r),
        blocks AS (
            SELECT r, w[{STRIDE} * b + 1 : {STRIDE} * b + {BLOCK_WORDS}] AS words
            FROM (SELECT r, w, unnest(range(0, greatest(1, CAST(ceil((len(w) - {BLOCK_WORDS - STRIDE}) / {STRIDE}) AS BIGINT)))) AS b FROM d)),
        pairs AS (SELECT r, label, len(list_intersect(t.words, b.words)) AS overlap, len(t.words) AS size, need FROM blocks b, templates t),
        added AS (SELECT r, list(DISTINCT label) AS labels, max(overlap / size) AS share FROM pairs WHERE overlap >= need GROUP BY r)
        SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n, 0) AS n_base, first_word, last_word,
               array_to_string(list_sort(coalesce(b.labels, [])), ',') AS base_labels,
               array_to_string(list_sort(list_distinct(list_concat(coalesce(b.labels, []), coalesce(a.labels, [])))), ',') AS labels,
               CASE WHEN n > 0 THEN 1.0::DOUBLE ELSE coalesce(share, 0.0)::DOUBLE END AS score
        FROM d LEFT JOIN base b USING (r) LEFT JOIN added a USING (r)
    """

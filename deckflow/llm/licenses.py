"""License scans: fixed phrases, and an exact set-similarity join with license templates.

A text block is a number of words in a row, wherever lines end: as many as the template has,
and as many others as it may lack. A block meets a template if it holds at least
``threshold`` of the template's distinct words.

Words are ordered by how many texts have them, the rarest first. The words of a block are
words of its text, so what a text cannot meet none of its blocks can: a text with at least
``need`` of a template's ``n`` words must have one of the first ``n - need + 1`` (prefix),
must have at least ``need`` words (length), and the words behind the matched one, on both
sides, must suffice (position). Texts and templates that pass are joined; of such a text
the blocks that begin with a word of the template are verified one by one, which is enough:
any other block holds no more than one of these.

Only the words of the templates can count, so a text is held as the few template words in
it; templates are a parameter of the code, and their words are bounded by it. All steps
are DataFrame functions.

Defined cases: a null text is an empty one, without words and blocks; a text of any length
is scanned whole; texts without words of a template match nothing; a word counts once in a
block; of blocks that meet a template to the same degree any one stands for all; rows that
share id and text share their result, and each keeps its row; an empty table gives no rows;
other columns are not read.
"""

from __future__ import annotations

import math
import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from deckflow.llm.common import text_rows
from deckflow.session import materialize

SEPARATOR = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
PHRASES = {"cc-by": "cc by", "gpl": "general public license", "reserved": "all rights reserved"}
THRESHOLD = 0.85
#: Label and words of each template.
TEMPLATES = (
    ("apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("cc-by-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0"),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl-notice", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("mit", "Released under the MIT License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
)


def template_words(text: str) -> list[str]:
    """Sorted distinct words of a template (ASCII)."""
    return sorted(set("".join(c if c.isalnum() else " " for c in text.lower()).split()))


def needed(words: int, threshold: float) -> int:
    return max(1, math.ceil(words * threshold - 1e-9))


def words(text: str | Column) -> Column:
    """Words of a text in order, A-Z lower-cased."""
    lower = F.translate(text, string.ascii_uppercase, string.ascii_lowercase)
    return F.array_remove(F.split(lower, SEPARATOR), "")


def _starts(phrase: list[str]) -> Column:
    """Indexes in the column ``words`` at which a phrase stands."""

    def at(word: Column, i: Column) -> Column:
        there = word == phrase[0]
        for k, later in enumerate(phrase[1:], 1):
            there = there & (F.get("words", i + k) == later)
        return F.when(there, i)

    return F.filter(F.transform("words", at), lambda i: i.isNotNull())


def _span_words(text: str, threshold: float) -> int:
    """Words of a block: the template's own, and as many others as it may lack."""
    distinct = len(template_words(text))
    return len("".join(c if c.isalnum() else " " for c in text).split()) + distinct - needed(distinct, threshold)


def _rows_of(docs: DataFrame, vocabulary: list[str]) -> DataFrame:
    """Per row of ``doc_id, text``: ``key``, the number of words, the places of the phrases,
    and which words of ``vocabulary`` the text has. The text is split once."""
    quick = "|".join(SEPARATOR.join(p.split()) for p in PHRASES.values())
    wanted = F.array(*[F.lit(w) for w in vocabulary])
    found = docs.select(
        "doc_id",
        F.xxhash64("text").alias("key"),
        F.coalesce(F.col("text").rlike(f"(?i){quick}"), F.lit(False)).alias("maybe"),
        words("text").alias("words"),
    )
    none = F.array().cast("array<int>")
    found = found.select(
        "doc_id",
        "key",
        F.coalesce(F.size("words"), F.lit(0)).cast("long").alias("n_words"),
        F.coalesce(F.array_intersect("words", wanted), F.array().cast("array<string>")).alias("hits"),
        *[F.when(F.col("maybe"), _starts(p.split())).otherwise(none).alias(f"at_{n}") for n, p in enumerate(PHRASES.values())],
    )
    places = F.concat(*[F.col(f"at_{n}") for n in range(len(PHRASES))])
    labels = F.array_compact(
        F.array(*[F.when(F.size(f"at_{n}") > 0, F.lit(label)) for n, label in enumerate(PHRASES)])
    )
    return found.select(
        "doc_id",
        "key",
        "n_words",
        "hits",
        F.size(places).cast("long").alias("n_base"),
        F.array_min(places).cast("long").alias("first_word"),
        F.array_max(places).cast("long").alias("last_word"),
        F.array_sort(labels).alias("base"),
    )


def _candidates(texts: DataFrame, sets: list[list[str]], threshold: float) -> DataFrame:
    """``doc_id, key, template``: texts that hold enough of a template's words anywhere."""
    spark = texts.sparkSession
    vocabulary = sorted({w for ws in sets for w in ws})
    # As many rows as the templates have words.
    counts = texts.select(F.explode("hits").alias("word")).groupBy("word").agg(F.count("*").alias("n")).collect()
    frequency = {r.word: r.n for r in counts}
    rank = {w: i for i, w in enumerate(sorted(vocabulary, key=lambda w: (frequency.get(w, 0), w)))}
    prefix = []
    for template, ws in enumerate(sets):
        ranked, need = sorted(rank[w] for w in ws), needed(len(ws), threshold)
        prefix += [(r, template, place, len(ws), need, ranked) for place, r in enumerate(ranked[: len(ws) - need + 1])]
    index = spark.createDataFrame(prefix, "rank int, template int, place int, n int, need int, ranked array<int>")
    ranks = F.create_map(*[F.lit(x) for pair in rank.items() for x in pair])
    first = F.array(*[F.lit(r) for r in sorted({p[0] for p in prefix})])
    held = texts.select(
        "doc_id", "key", "n_words", F.array_sort(F.transform("hits", lambda w: F.element_at(ranks, w))).alias("hits")
    )
    # Behind the matched word neither side may have too few words left.
    behind = F.least(F.col("n") - F.col("place"), F.size("hits") - F.array_position("hits", F.col("rank")) + 1)
    # Of a template's prefix words in the text, the first one's bound counts.
    return (
        held.select("*", F.explode(F.array_intersect("hits", first)).alias("rank"))
        .join(F.broadcast(index), "rank")  # bounded by the words of the templates
        .filter((F.col("n_words") >= F.col("need")) & (F.size(F.array_intersect("hits", F.slice("ranked", 1, F.col("place")))) == 0))
        .filter(behind >= F.col("need"))
        .filter(F.size(F.array_intersect("hits", "ranked")) >= F.col("need"))
        .select("doc_id", "key", "template")
        .distinct()
    )


def matches(
    docs: DataFrame, templates: tuple = TEMPLATES, threshold: float = THRESHOLD, texts: DataFrame | None = None
) -> DataFrame:
    """``doc_id, key, label, containment``: the best block of each text and template that meet.

    ``docs`` has ``doc_id, text``; ``texts`` are their stored ``_rows_of``, if the caller has them.
    """
    spark = docs.sparkSession
    sets = [template_words(text) for _, text in templates]
    if texts is None:
        texts = materialize(_rows_of(docs, sorted({w for ws in sets for w in ws})), "license_texts")
    met = materialize(_candidates(texts.filter(F.size("hits") > 0), sets, threshold), "license_candidates")
    place = met.withColumnsRenamed({"doc_id": "met_id", "key": "met_key"})
    # Of equal rows one is looked at.
    rows = docs.select("doc_id", F.xxhash64("text").alias("key"), "text")
    same = rows.doc_id.eqNullSafe(place.met_id) & (rows.key == place.met_key)
    known = rows.join(place, same, "left_semi").groupBy("doc_id", "key").agg(F.first("text").alias("text"))
    owners = spark.createDataFrame(
        [(w, t, _span_words(templates[t][1], threshold)) for t, ws in enumerate(sets) for w in ws],
        "word string, template int, span int",
    )
    hits = known.select("doc_id", "key", F.posexplode(words("text")).alias("at", "word")).join(F.broadcast(owners), "word")
    same = hits.doc_id.eqNullSafe(place.met_id) & (hits.key == place.met_key) & (hits.template == place.template)
    hits = hits.join(place, same, "left_semi")
    # Places in units of the block, so that one frame holds the blocks of all templates.
    longest = max(_span_words(text, threshold) for _, text in templates)
    frame = f"RANGE BETWEEN CURRENT ROW AND {1 - 0.5 / longest!r}D FOLLOWING"
    block = F.expr(f"size(collect_set(word) OVER (PARTITION BY doc_id, key, template ORDER BY at / span {frame}))")
    best = hits.select("doc_id", "key", "template", block.alias("both")).groupBy("doc_id", "key", "template").agg(F.max("both").alias("both"))
    sizes = spark.createDataFrame(
        [(t, label, len(ws), needed(len(ws), threshold)) for t, ((label, _), ws) in enumerate(zip(templates, sets))],
        "template int, label string, n int, need int",
    )
    return best.join(F.broadcast(sizes), "template").filter("both >= need").select(
        "doc_id", "key", "label", (F.col("both") / F.col("n")).alias("containment")
    )


def scan(
    docs: DataFrame,
    templates: tuple = TEMPLATES,
    threshold: float = THRESHOLD,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Phrases and labels of every text; ``score`` is the highest containment that was met, or 0."""
    rows = text_rows(docs, id_col, text_col)
    vocabulary = sorted({w for _, text in templates for w in template_words(text)})
    base = materialize(_rows_of(rows, vocabulary), "license_texts")
    met = (
        matches(rows, templates, threshold, base)
        .groupBy("doc_id", "key")
        .agg(F.collect_set("label").alias("more"), F.max("containment").alias("score"))
        .withColumnsRenamed({"doc_id": "met_id", "key": "met_key"})
    )
    same = base.doc_id.eqNullSafe(met.met_id) & (base.key == met.met_key)
    none = F.array().cast("array<string>")
    return base.join(met, same, "left").select(
        "doc_id",
        "n_words",
        "n_base",
        "first_word",
        "last_word",
        F.array_join("base", ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union("base", F.coalesce("more", none))), ",").alias("labels"),
        F.coalesce("score", F.lit(0.0)).alias("score"),
    )


def oracle_sql(templates: tuple = TEMPLATES, threshold: float = THRESHOLD) -> str:
    """The same in DuckDB's SQL: every block against every template, a block from each of its words on."""
    text = f"translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}')"
    word = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    rows = ", ".join(
        f"({n}, '{label}', [{', '.join(repr(w) for w in template_words(t))}], {needed(len(template_words(t)), threshold)}, {_span_words(t, threshold)})"
        for n, (label, t) in enumerate(templates)
    )
    places = {
        label: "list_filter(range(1, len(w) + 1), lambda i: "
        + " AND ".join(f"w[i + {k}] = '{part}'" for k, part in enumerate(phrase.split()))
        + ")"
        for label, phrase in PHRASES.items()
    }
    every = "list_concat(" * (len(places) - 1) + list(places.values())[0]
    every += "".join(f", {p})" for p in list(places.values())[1:])
    base = ", ".join(f"CASE WHEN len({p}) > 0 THEN '{label}' END" for label, p in places.items())
    return rf"""
WITH rows AS (SELECT row_number() OVER () AS r, doc_id, {text} AS t FROM documents),
templates(t, label, ws, need, span) AS (VALUES {rows}),
owners AS (SELECT t, span, unnest(ws) AS word FROM templates),
worded AS (SELECT r, doc_id, regexp_extract_all(t, '{word}') AS w FROM rows),
hits AS (SELECT r, t, span, place, word FROM
  (SELECT r, unnest(w) AS word, generate_subscripts(w, 1) AS place FROM worded) JOIN owners USING (word)),
blocks AS (SELECT a.r, a.t, a.place, count(DISTINCT b.word) AS n FROM hits a
  JOIN hits b ON a.r = b.r AND a.t = b.t AND b.place BETWEEN a.place AND a.place + a.span - 1 GROUP BY ALL),
met AS (SELECT r, list(DISTINCT label) AS more, max(n / len(ws)) AS score
  FROM blocks JOIN templates USING (t) WHERE n >= need GROUP BY r),
placed AS (SELECT r, doc_id, len(w) AS n_words, {every} AS p,
  list_sort(list_filter([{base}], lambda x: x IS NOT NULL)) AS base FROM worded)
SELECT doc_id, n_words, len(p) AS n_base, CAST(list_min(p) - 1 AS BIGINT) AS first_word, CAST(list_max(p) - 1 AS BIGINT) AS last_word,
  array_to_string(base, ',') AS base_labels,
  array_to_string(list_sort(list_distinct(list_concat(base, coalesce(more, [])))), ',') AS labels,
  coalesce(score, 0.0) AS score
FROM placed LEFT JOIN met USING (r)"""

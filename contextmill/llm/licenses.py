"""Operator 4: licence notices by an exact set-similarity join, in DataFrame operations only.

A text block is a run of words anywhere in the text, across line and sentence breaks; it meets a template if it holds at
least 90 % of the template's distinct words and has at most 1 / 0.9 times as many words as the template. Template words are
ordered by their frequency over all documents, rarest first. A block that meets a template must hold one of the template's
first words (prefix filter), enough of its words near that one (length filter), and enough of those that come after it in
the order (positional filter); what passes is verified by the whole intersection.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contextmill.llm.scratch import Scratch

CONTAINMENT = 0.9
#: Template words up to this number are broadcast; a larger template library is joined by shuffling.
BROADCAST_WORDS = 20_000
#: Template words of a text that are looked at together.
PIECE = 4096
#: The base phrases and their labels.
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
#: Notices and their labels.
TEMPLATES = [
    ("all-rights-reserved", "all rights reserved"),
    ("apache", "licensed under the apache license version 2 0"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("cc-by", "licensed under cc by 4 0"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-sa", "licensed under cc by sa 4 0"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("gpl", "this work is licensed under the gnu general public license version 3"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("mit", "released under the mit license"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("public-domain", "this is free and unencumbered software released into the public domain"),
]
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_ANY_CASE_GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column) -> Column:
    return F.filter(F.split(F.translate(text, _UPPER, _LOWER), GAP), lambda w: w != "")


def _mentions(text: Column, tokens: list[str]) -> Column:
    """Whether one of the words may stand in the text, in any case of A-Z."""
    return text.rlike("(?i)(?:" + "|".join(map(re.escape, sorted(tokens))) + ")") if tokens else F.lit(False)


def ordered_templates(docs: DataFrame, templates: list[tuple[str, str]], containment: float) -> DataFrame:
    """(template, label, ordered, n, need, most) for each template: its distinct words by frequency over all documents,
    rarest first, ties by word; the words that a block needs; and the most words of a block."""
    spark = docs.sparkSession
    lib = spark.createDataFrame([(i, label, text) for i, (label, text) in enumerate(templates)], "template int, label string, text string").withColumn("w", words(F.col("text")))
    lib = lib.withColumn("most", F.ceil(F.size("w") / F.lit(containment) - F.lit(1e-9)).cast("int")).select("template", "label", "most", F.explode(F.array_distinct("w")).alias("word"))
    universe = lib.select("word").distinct()
    small = F.broadcast(universe) if universe.count() <= BROADCAST_WORDS else universe
    seen = docs.select(F.explode(F.split(F.lower("text"), GAP)).alias("word")).join(small, "word").groupBy("word").count()
    rank = universe.join(seen, "word", "left").select("word", F.struct(F.coalesce("count", F.lit(0)).alias("count"), F.col("word").alias("w")).alias("place"))
    ordered = lib.join(rank, "word").groupBy("template", "label", "most").agg(F.array_sort(F.collect_list("place")).alias("places"))
    return ordered.select("template", "label", F.col("places.w").alias("ordered"), F.size("places").alias("n"), F.ceil(F.size("places") * F.lit(containment) - F.lit(1e-9)).cast("int").alias("need"), "most")


def _marked(rows: DataFrame, lib: DataFrame, few: bool) -> DataFrame:
    """id, digest, marks: for rows with template words the (pos, w, lead) of these in ascending order; lead: in some prefix.

    Up to BROADCAST_WORDS template words are part of the plan; with more, words are joined with the library.
    """
    if few:
        universe = [r.w for r in lib.select(F.explode("ordered").alias("w")).distinct().collect()]
        prefix = {r.w for r in lib.select(F.explode(F.slice("ordered", F.lit(1), F.col("n") - F.col("need") + 1)).alias("w")).distinct().collect()}
        held = F.map_from_arrays(F.array(*map(F.lit, sorted(universe))), F.array(*[F.lit(w in prefix) for w in sorted(universe)])) if universe else None
        places = F.transform(words(F.col("text")), lambda w, i: F.struct(i.alias("pos"), w.alias("w"), F.try_element_at(held, w).alias("lead")))
        marks = F.filter(places, lambda x: x["lead"].isNotNull()) if universe else F.array().cast("array<struct<pos:int,w:string,lead:boolean>>")
        return rows.where(_mentions(F.col("text"), prefix)).select("id", "digest", marks.alias("marks"))
    each = rows.select("id", "digest", F.posexplode(words(F.col("text"))).alias("pos", "w"))
    of = lib.select("n", "need", F.posexplode("ordered").alias("p", "w")).groupBy("w").agg(F.max(F.expr("p <= n - need")).alias("lead"))
    each = each.join(of, "w").select("id", "digest", "pos", "w", "lead").distinct()
    return each.groupBy("id", "digest").agg(F.array_sort(F.collect_list(F.struct("pos", "w", "lead"))).alias("marks"))


def blocks_meeting(rows: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, containment: float = CONTAINMENT) -> DataFrame:
    """(id, digest, template, label, containment) for every row (id, digest, text) and template that a block of it meets.

    containment is that of the best block. Rows with equal id and digest are taken as one text.
    """
    lib = Scratch(rows.sparkSession, "licenses").save(ordered_templates(rows, templates, containment), "templates")
    sizes = lib.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.max("most"), F.lit(1))).first()
    few, span = sizes[0] <= BROADCAST_WORDS, sizes[1]
    prefixes = lib.select("template", "label", "ordered", "n", "need", "most", F.posexplode(F.slice("ordered", F.lit(1), F.col("n") - F.col("need") + 1)).alias("p", "word"))
    marked = _marked(rows, lib, few)
    # long rows of marks in pieces that overlap by a block; every prefix word with the template words near it: marks are
    # places of words, so a block has at most as many marks as words
    pieces = F.transform(F.sequence(F.lit(0), F.floor((F.size("marks") - 1) / PIECE).cast("int")), lambda k: F.slice("marks", F.greatest(F.lit(1), k * PIECE + 2 - span), F.lit(PIECE + 2 * span - 2)))
    marked = marked.where("size(marks) > 0").select("id", "digest", F.explode(pieces).alias("marks"))
    near = F.transform("marks", lambda x, i: F.when(x["lead"], F.struct(x["pos"].alias("pos"), x["w"].alias("w"), F.slice("marks", F.greatest(F.lit(1), i + 2 - span), F.lit(2 * span - 1)).alias("near"))))
    each = marked.select("id", "digest", F.explode(F.filter(near, lambda x: x.isNotNull())).alias("x")).select("id", "digest", F.col("x.pos").alias("pos"), F.col("x.w").alias("word"), F.col("x.near").alias("near"))
    met = each.join(F.broadcast(prefixes) if few else prefixes, "word")
    met = met.withColumn("near", F.expr("filter(near, m -> m.pos > pos - most and m.pos < pos + most and array_contains(ordered, m.w))"))
    met = met.where("size(near) >= need")  # length
    met = met.where("1 + size(array_intersect(slice(ordered, p + 2, n), near.w)) >= need - p")  # position: p words at most come before this one
    best = "array_max(transform(filter(near, s -> s.pos <= pos), s -> size(array_distinct(transform(filter(near, m -> m.pos >= s.pos and m.pos < s.pos + most), m -> m.w)))))"
    met = met.withColumn("common", F.expr(best)).where("common >= need")
    return met.groupBy("id", "digest", "template", "label").agg(F.max(F.col("common") / F.col("n")).alias("containment"))


def scan(docs: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, containment: float = CONTAINMENT, phrases: dict[str, str] = PHRASES) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score for every row of docs.

    Base: places where a phrase's words stand one after the other; n_base counts them, first_word and last_word are the
    smallest and largest start (null if none). labels has the base labels and those of templates that a block meets.
    score is 1 with a base place, else the largest containment of a template that is met, else 0. Null texts are empty.
    Rows that repeat a doc_id, null included, are labelled each by its own text. Other columns are ignored. Empty input:
    no rows.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    keyed = rows.select(F.col("doc_id").alias("id"), F.md5("text").alias("digest"), "text")
    found = blocks_meeting(keyed, templates, containment).groupBy(F.col("id").alias("of"), F.col("digest").alias("its")).agg(F.collect_set("label").alias("more"), F.max("containment").alias("best"))
    split = F.split("text", _ANY_CASE_GAP)
    heads = [min(p.split(), key=lambda w: (-len(w), w)) for p in phrases]
    out = rows.select(
        "doc_id", F.md5("text").alias("digest"), split.alias("w"),
        F.when(_mentions(F.col("text"), heads), words(F.col("text"))).otherwise(F.array().cast("array<string>")).alias("own"),
    )
    out = out.select("doc_id", "digest", "own", (F.size("w") - (F.element_at("w", 1) == "").cast("int") - ((F.size("w") > 1) & (F.element_at("w", -1) == "")).cast("int")).cast("long").alias("n_words"))
    places = []
    for phrase in phrases:
        parts = phrase.split()
        same = " AND ".join(f"own[i + {k}] = '{w}'" for k, w in enumerate(parts))
        places.append(F.expr(f"CASE WHEN size(own) >= {len(parts)} THEN filter(sequence(0, size(own) - {len(parts)}), i -> {same}) ELSE cast(array() AS array<int>) END").alias(phrase))
    out = out.select("doc_id", "digest", "n_words", F.array(*places).alias("places"))
    labels = F.array(*[F.lit(x) for x in phrases.values()])
    base = F.array_sort(F.array_distinct(F.filter(F.transform("places", lambda p, i: F.when(F.size(p) > 0, F.get(labels, i))), lambda x: x.isNotNull())))
    out = out.select("doc_id", "digest", "n_words", F.flatten("places").alias("starts"), base.alias("base"))
    out = out.join(found, F.col("doc_id").eqNullSafe(F.col("of")) & (F.col("digest") == F.col("its")), "left")
    return out.select(
        "doc_id", "n_words", F.size("starts").cast("long").alias("n_base"), F.array_min("starts").cast("long").alias("first_word"), F.array_max("starts").cast("long").alias("last_word"),
        F.array_join("base", ",").alias("base_labels"), F.array_join(F.array_sort(F.array_union("base", F.coalesce("more", F.array().cast("array<string>")))), ",").alias("labels"),
        F.when(F.size("starts") > 0, F.lit(1.0)).otherwise(F.coalesce("best", F.lit(0.0))).alias("score"),
    )


def sql() -> str:
    """DuckDB SQL for ``scan`` over documents, with the templates and phrases above."""
    values = ", ".join(f"({i}, '{label}', '{text}')" for i, (label, text) in enumerate(TEMPLATES))
    phrases = ", ".join(f"('{p}', '{label}')" for p, label in PHRASES.items())
    return rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}') AS t FROM documents),
w AS (SELECT rid, doc_id, regexp_extract_all(t, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM d),
p AS (SELECT string_split(p, ' ') AS p, label FROM (VALUES {phrases}) v(p, label)),
s AS (SELECT rid, label, unnest(list_filter(range(1, len(w) - len(p) + 2), lambda i: w[i:i + len(p) - 1] = p)) - 1 AS pos FROM w, p),
b AS (SELECT rid, count(*) AS n_base, min(pos) AS first_word, max(pos) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM s GROUP BY rid),
t AS (SELECT label, list_distinct(string_split(text, ' ')) AS t, ceil(len(string_split(text, ' ')) / {CONTAINMENT} - 1e-9)::INT AS most FROM (VALUES {values}) v(id, label, text)),
h AS (SELECT rid, label, t, most, w, unnest(list_filter(range(1, len(w) + 1), lambda i: list_contains(t, w[i]))) AS i FROM w, t WHERE len(list_intersect(w, t)) >= ceil({CONTAINMENT} * len(t) - 1e-9)),
m AS (SELECT rid, label, max(len(list_intersect(w[i:i + most - 1], t)) / len(t)::DOUBLE) AS c FROM h WHERE len(list_intersect(w[i:i + most - 1], t)) >= ceil({CONTAINMENT} * len(t) - 1e-9) GROUP BY rid, label),
g AS (SELECT rid, max(c) AS best FROM m GROUP BY rid),
l AS (SELECT rid, label FROM s UNION SELECT rid, label FROM m),
a AS (SELECT rid, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM l GROUP BY rid)
SELECT w.doc_id, len(w.w)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
       coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, CASE WHEN n_base > 0 THEN 1.0::DOUBLE ELSE coalesce(best, 0.0)::DOUBLE END AS score
FROM w LEFT JOIN b USING (rid) LEFT JOIN a USING (rid) LEFT JOIN g USING (rid)
"""

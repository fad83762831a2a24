"""Operator 10, licence scan: phrase places and an exact set-similarity join with templates.

Only DataFrame functions are used.  Text blocks (lines and blank-line
paragraphs) are sets of words; a template meets a block if the block contains
at least ``CONTAINMENT`` of the template's words.  Words are ordered by how
often all texts have them, rarest first, and four filters come before the exact
count of common words:

* prefix: a block must hold one of a template's n - need + 1 rarest words, and
  only texts that hold one are cut into blocks;
* its own prefix: that word must lie before the block's last need - 1 words;
* length: the block has at least ``need`` words of the vocabulary;
* position: the words after the shared one must still suffice.

A word outside all templates can never be shared; it is ordered first and so
drops out of both prefixes, which is why blocks are reduced to template words.
Blocks with the same ones are decided once, however many texts have them.

The templates are a table of reference texts, read by the driver: their words
travel with the query, ``TEMPLATE_WORDS`` at most; more raise an error.
"""

from __future__ import annotations

import json
import math
import re
from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtext.llm.common import Staging

#: Share of a template's words that a block must contain.
CONTAINMENT = 0.9
#: Distinct words of all templates together, at most, a word counted for each of its templates (about 20 MB).
TEMPLATE_WORDS = 500_000
#: Met blocks up to this many, as sets of template words, are broadcast.
BROADCAST_BLOCKS = 50_000

#: Phrase words and label of the base report.
PHRASES = (
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
)

#: Label and opening or notice of well-known licences.
TEMPLATES = (
    ("apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("bsd-3-clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("cc-by-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0"),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl-3.0", "under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("mit", "Released under the MIT License"),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
)

#: What separates words, A-Z counting as letters.
_BREAK = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def flatten(text: Column) -> Column:
    """The words of a text, A-Z as a-z, one blank between; empty for null."""
    return F.translate(F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), _BREAK, " ")), ascii_uppercase, ascii_lowercase)


def words(text: Column) -> Column:
    """The words of a text, A-Z as a-z; none for null."""
    return F.array_remove(F.split(flatten(text), " ", -1), "")


def default_templates(spark: SparkSession) -> DataFrame:
    """(label, text) of the licences named here."""
    return _rows(spark, "label string, text string", [{"label": label, "text": text} for label, text in TEMPLATES])


def _rows(spark: SparkSession, schema: str, rows: list[dict]) -> DataFrame:
    """A small table from one literal."""
    return spark.sql(f"select inline(from_json(:rows, 'array<struct<{schema.replace(' ', ':').replace(',:', ',')}>>'))", args={"rows": json.dumps(rows)})


def template_words(templates=TEMPLATES) -> list[tuple[str, list[str]]]:
    """(label, sorted words) of each template that has any; null labels and texts are none."""
    lower = str.maketrans(ascii_uppercase, ascii_lowercase)
    known = [(label, sorted(set(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.translate(lower))))) for label, text in templates if label is not None and text]
    out = [(label, ws) for label, ws in known if ws]
    if sum(len(ws) for _, ws in out) > TEMPLATE_WORDS:
        raise ValueError(f"templates of more than {TEMPLATE_WORDS} words")
    return out


def _need(n: int) -> int:
    return math.ceil(CONTAINMENT * n - 1e-9)


def _blocks(text: Column) -> Column:
    """Distinct lines and paragraphs of a text; a one-line paragraph is its line."""
    return F.array_union(F.split(text, "\n", -1), F.split(text, r"\n[ \t\r]*\n", -1))


def _any_of(ws: Column, known: list[str]) -> Column:
    return F.exists(ws, lambda w: w.isin(*known))


def template_hits(docs: DataFrame, templates: DataFrame) -> DataFrame:
    """(doc_id, text_hash, label, score): templates (label, text) met by some block of a row's text, score the best containment."""
    spark, kind = docs.sparkSession, docs.schema["doc_id"].dataType.simpleString()
    known = template_words(sorted((r.label, r.text) for r in templates.filter("label is not null and text is not null").select("label", "text").distinct().collect()))
    if not known:
        return spark.sql(f"select cast(null as {kind}) as doc_id, 0L as text_hash, '' as label, 0D as score where false")
    staging = Staging(spark)
    vocab = sorted({w for _, ws in known for w in ws})
    texts = docs.filter("text is not null").select("doc_id", "text")

    listed = F.broadcast(_rows(spark, "w string", [{"w": w} for w in vocab]))
    often = texts.select(F.explode(words(F.col("text"))).alias("w")).join(listed, "w").groupBy("w").count()
    seen = {r["w"]: r["count"] for r in often.collect()}  # one row for each template word at most
    rank = {w: k for k, w in enumerate(sorted(vocab, key=lambda w: (seen.get(w, 0), w)))}
    whole, prefix, rare = [], [], set()
    for t, (label, ws) in enumerate(known):
        ranked, need = sorted(ws, key=rank.get), _need(len(ws))
        whole.append({"template": t, "label": label, "t_ranks": [rank[w] for w in ranked], "need": need})
        prefix += [{"r": rank[w], "template": t, "i": i} for i, w in enumerate(ranked[: len(ws) - need + 1])]
        rare |= set(ranked[: len(ws) - need + 1])
    rare, least = sorted(rare), min(t["need"] for t in whole)

    held = texts.filter(_any_of(words(F.col("text")), rare)).select("doc_id", F.xxhash64("text").alias("text_hash"), F.explode(_blocks(F.col("text"))).alias("block"))
    each = held.select("doc_id", "text_hash", words(F.col("block")).alias("ws")).filter(_any_of(F.col("ws"), rare))
    own = F.array_sort(F.array_distinct(F.filter("ws", lambda w: w.isin(*vocab))))
    near = staging.put(each.select("doc_id", "text_hash", own.alias("own")).filter(F.size("own") >= least))

    ranks = F.broadcast(_rows(spark, "w string, r int", [{"w": w, "r": r} for w, r in rank.items()]))
    sets = near.select("own").distinct().select("own", F.explode("own").alias("w")).join(ranks, "w").groupBy("own").agg(F.sort_array(F.collect_list("r")).alias("b_ranks"))
    probes = sets.select("own", "b_ranks", F.posexplode("b_ranks").alias("j", "r"))
    met = probes.join(F.broadcast(_rows(spark, "r int, template int, i int", prefix)), "r").join(F.broadcast(_rows(spark, "template int, label string, t_ranks array<int>, need int", whole)), "template")
    fits = met.filter((F.size("b_ranks") >= F.col("need")) & (F.col("j") <= F.size("b_ranks") - F.col("need")))
    fits = fits.filter(F.least("i", "j") + 1 + F.least(F.size("t_ranks") - F.col("i") - 1, F.size("b_ranks") - F.col("j") - 1) >= F.col("need"))
    common = fits.withColumn("common", F.size(F.array_intersect("b_ranks", "t_ranks"))).filter("common >= need")
    found = staging.put(common.groupBy("own", "label").agg(F.max(F.col("common") / F.size("t_ranks")).alias("score")))
    few = F.broadcast(found) if found.count() <= BROADCAST_BLOCKS else found
    return near.join(few, "own").groupBy("doc_id", "text_hash", "label").agg(F.max("score").alias("score"))


def scan(docs: DataFrame, templates: DataFrame | None = None) -> DataFrame:
    """One row for each row of ``docs`` (doc_id, text): n_words, n_base, first_word, last_word, base_labels, labels and score.

    ``templates`` are (label, text), the licences named here by default.  Null
    text counts as empty.  score is 1 with a base phrase, else the best
    containment of a template, else 0.  Equal rows get equal results; other
    columns are ignored.
    """
    templates = default_templates(docs.sparkSession) if templates is None else templates
    base = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), flatten(F.col("text")).alias("flat"))
    has = F.lit(False)
    for phrase, _ in PHRASES:
        has = has | F.concat(F.lit(" "), "flat", F.lit(" ")).contains(f" {phrase} ")
    blanks = F.octet_length("flat") - F.octet_length(F.replace("flat", F.lit(" "), F.lit("")))
    n_words = F.when(F.col("flat") == "", 0).otherwise(blanks + 1).cast("long")
    base = base.select("doc_id", "text_hash", n_words.alias("n_words"), F.when(has, F.split("flat", " ", -1)).alias("ws"))
    for k, (phrase, _) in enumerate(PHRASES):
        test = " and ".join(f"get(ws, cast(i + {d} as int)) = '{w}'" for d, w in enumerate(phrase.split()))
        base = base.withColumn(f"p{k}", F.when(F.col("ws").isNotNull(), F.expr(f"filter(sequence(0L, n_words - 1), i -> {test})")))
    n = [F.greatest(F.coalesce(F.size(f"p{k}"), F.lit(0)), F.lit(0)) for k in range(len(PHRASES))]
    found = F.array_sort(F.array_compact(F.array(*(F.when(x > 0, F.lit(label)) for x, (_, label) in zip(n, PHRASES)))))
    base = base.select(
        "doc_id", "text_hash", "n_words", sum(n[1:], n[0]).cast("long").alias("n_base"),
        F.least(*(F.array_min(f"p{k}") for k in range(len(PHRASES)))).alias("first_word"),
        F.greatest(*(F.array_max(f"p{k}") for k in range(len(PHRASES)))).alias("last_word"),
        found.alias("base"),
    )
    more = template_hits(docs, templates).groupBy(F.col("doc_id").alias("d"), F.col("text_hash").alias("h")).agg(F.collect_set("label").alias("more"), F.max("score").alias("best"))
    out = base.join(more, base["doc_id"].eqNullSafe(more["d"]) & (base["text_hash"] == more["h"]), "left")
    labels = F.array_sort(F.array_distinct(F.concat("base", F.coalesce("more", F.array().cast("array<string>")))))
    score = F.when(F.col("n_base") > 0, F.lit(1.0)).otherwise(F.coalesce("best", F.lit(0.0)))
    return out.select("doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join("base", ",").alias("base_labels"), F.array_join(labels, ",").alias("labels"), score.alias("score"))

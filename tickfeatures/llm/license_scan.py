"""Licence notices by an exact set-similarity join of text blocks and templates.

Texts are lower-cased (A-Z) and cut into words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+``
(digits, letters and everything beyond ASCII). Blocks are all windows of ``2 * longest``
words, at every word of a text, where ``longest`` is the longest template's number of words.
A block matches a template when it has at least ``ceil(CONTAINMENT * m)`` of the template's
m distinct words. Only blocks that start at a word of a template are compared: a block that
starts elsewhere has no template word that the block at the next such word lacks.

The join. Words of the templates are ordered by their frequency in the whole table
(documents with the word, rarest first; ties by spelling). A block that shares ``need``
words with a template must have one of the template's first ``m - need + 1`` words among
its own first ``size - need + 1`` template words (prefix filter), at least ``need``
template words at all (length filter), and, from the first shared prefix word on, enough
words left on both sides (positional filter). Pairs that pass are verified by the exact
size of the intersection. Only the blocks' template words in order are compared; all
other words are in no template.

Base labels come from phrases whose words stand consecutively. ``score`` is 1.0 where a
phrase is found, else the greatest containment of a matching template, else 0.0.

Everything is DataFrame functions. Documents are not shuffled; block rows of documents
with a prefix word are. Texts go through the search in stretches of ``STRETCH`` words (each
with the words that its last block needs), so that a long text never holds more than one
stretch's blocks. Consecutive blocks with the same template words are one. The templates are a parameter of fixed size (``MAX_TEMPLATES``),
so their broadcast is bounded.

Results: null and empty texts have no words: counts 0, null positions, empty labels,
score 0.0. Repeated rows each get the same row; a null doc_id stays null. An empty table
gives no rows. Further columns are not read, whatever their names; of templates that tie
all labels are given.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed values
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
TEMPLATES = {
    "this work is licensed under the gnu general public license version 3": "gpl-3.0",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license": "gpl",
    "licensed under the apache license version 2.0": "apache-2.0",
    "released under the mit license": "mit",
    "permission is hereby granted free of charge to any person obtaining a copy of this software": "mit",
    "redistribution and use in source and binary forms with or without modification are permitted": "bsd",
    "licensed under cc by nc 4.0": "cc-by-nc",
    "this work is licensed under a creative commons attribution license": "cc-by",
    "all rights reserved": "reserved",
}
CONTAINMENT = 0.8
MAX_TEMPLATES = 1000
STRETCH = 2048
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
SEPARATORS = "".join(chr(c) for c in range(0x80) if not chr(c).isalnum())


def words(text: Column) -> Column:
    """Words by one character translation and a split at blanks."""
    plain = F.translate(F.coalesce(text.cast("string"), F.lit("")), UPPER + SEPARATORS, UPPER.lower() + " " * len(SEPARATORS))
    return F.array_remove(F.split(plain, " "), "")


def bound(value: Column, of) -> Column:
    """``of(value)`` with the value bound by a lambda variable: it is computed once
    wherever Catalyst moves the expression."""
    return F.get(F.transform(F.array(value), of), F.lit(0))


def _literal(items: list[str]) -> Column:
    return F.array(*[F.lit(x) for x in items]) if items else F.array().cast("array<string>")


def phrase_places(tokens: Column, phrases: dict[str, str]) -> Column:
    """Array of (start, label) of all places of the phrases, in order of start and phrase."""
    split = {p: p.split(" ") for p in phrases}
    firsts = _literal(sorted({w[0] for w in split.values()}))
    none = F.array().cast("array<struct<at:int,label:string>>")

    def here(i: Column) -> Column:
        found = [
            F.when(
                _all([F.get(tokens, i + j) == F.lit(w) for j, w in enumerate(ws)]),
                F.array(F.struct(i.alias("at"), F.lit(phrases[p]).alias("label"))),
            ).otherwise(none)
            for p, ws in sorted(split.items())
        ]
        return F.concat(*found)

    starts = F.filter(F.sequence(F.lit(0), F.size(tokens) - 1), lambda i: F.array_contains(firsts, F.get(tokens, i)))
    # most texts have no first word of a phrase: they stop here
    return F.when(F.arrays_overlap(tokens, firsts), F.flatten(F.transform(starts, here))).otherwise(none)


def _all(conditions: list[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out & c
    return out


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.coalesce(F.xxhash64("text"), F.lit(0)).alias("tie"), "text")


def vocabulary(docs: DataFrame, templates: dict[str, str]) -> list[str]:
    """The templates' words, rarest in the table first. Counts for these words only reach
    the driver: their number is bounded by the templates."""
    known = sorted({w for t in templates for w in _cut(t)})
    if not known:
        return []
    found = docs.select(F.explode_outer(F.array_intersect(_literal(known), words(F.col("text")))).alias("word")).where("word is not null")
    counts = {r["word"]: r["n"] for r in found.groupBy("word").agg(F.count("*").alias("n")).collect()}
    return sorted(known, key=lambda w: (counts.get(w, 0), w))


def _cut(template: str) -> list[str]:
    return re.findall(WORD, template)


def block_matches(docs: DataFrame, templates: dict[str, str], containment: float = CONTAINMENT) -> DataFrame:
    """``doc_id, tie, at, template, label, containment`` for each block and template that
    reach the threshold; ``at`` is the block's first word."""
    if len(templates) > MAX_TEMPLATES:
        raise ValueError(f"more than {MAX_TEMPLATES} templates")
    spark = docs.sparkSession
    order = vocabulary(docs, templates)
    rank = {w: i for i, w in enumerate(order)}
    rows, longest, least_need = [], 1, None
    for text, label in templates.items():
        cut = _cut(text)
        own = sorted(set(cut), key=rank.__getitem__)
        if not own:
            continue
        longest = max(longest, len(cut))
        need = max(1, math.ceil(containment * len(own) - 1e-9))
        least_need = min(need, least_need or need)
        rows += [(text, label, own, len(own), need, i + 1, w) for i, w in enumerate(own[: len(own) - need + 1])]
    prefix = spark.createDataFrame(rows, "template string, label string, own array<string>, m int, need int, i int, word string")
    firsts = _literal(sorted({r[6] for r in rows}))
    known = _literal(order)

    size, none = 2 * longest, F.array().cast("array<struct<at:int,words:array<string>>>")

    def stretches(tokens: Column) -> Column:
        starts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.size(tokens) - 1), F.lit(STRETCH))
        made = F.transform(starts, lambda s: F.struct(s.alias("at"), F.slice(tokens, s + 1, STRETCH + size - 1).alias("words")))
        return F.when(F.arrays_overlap(tokens, firsts), F.filter(made, lambda m: F.arrays_overlap(m["words"], firsts))).otherwise(none)

    def blocks(part: Column) -> Column:
        tokens = part["words"]
        starts = F.filter(F.sequence(F.lit(0), F.least(F.lit(STRETCH), F.size(tokens)) - 1), lambda i: F.array_contains(known, F.get(tokens, i)))
        # template words of a block in global order: array_intersect keeps the order of its first argument
        made = F.transform(starts, lambda s: F.struct((part["at"] + s).alias("at"), F.array_intersect(known, F.slice(tokens, s + 1, size)).alias("have")))
        kept = F.filter(made, lambda b: F.size(b["have"]) >= (least_need or 1))
        return bound(kept, lambda k: F.filter(k, lambda b, i: (i == 0) | (F.get(k, i - 1)["have"] != b["have"])))

    parts = _keyed(docs).select("doc_id", "tie", F.explode(bound(words(F.col("text")), stretches)).alias("part"))
    cut = parts.select("doc_id", "tie", F.explode(blocks(F.col("part"))).alias("b"))
    own = cut.select("doc_id", "tie", "b.at", "b.have", F.posexplode_outer(F.slice("b.have", F.lit(1), F.size("b.have") - F.lit((least_need or 1) - 1))).alias("j", "word"))
    pairs = own.join(F.broadcast(prefix), "word")
    size = F.size("have")
    pairs = pairs.where(
        (size >= F.col("need"))
        & (F.col("j") <= size - F.col("need"))
        & (F.least(F.col("m") - F.col("i"), size - F.col("j") - 1) + F.least(F.col("i"), F.col("j") + 1) >= F.col("need"))
    )
    pairs = pairs.dropDuplicates(["doc_id", "tie", "at", "template"])
    overlap = F.size(F.array_intersect("have", "own"))
    return pairs.where(overlap >= F.col("need")).select("doc_id", "tie", "at", "template", "label", (overlap / F.col("m")).alias("containment"))


def scan(docs: DataFrame, templates: dict[str, str] | None = None, phrases: dict[str, str] | None = None) -> DataFrame:
    """Per row: ``doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score``."""
    templates, phrases = TEMPLATES if templates is None else templates, PHRASES if phrases is None else phrases
    place_type = "array<struct<at:int,label:string>>"

    def base(tokens: Column) -> Column:
        return F.struct(F.size(tokens).cast("bigint").alias("n_words"), phrase_places(tokens, phrases).cast(place_type).alias("places"))

    rows = _keyed(docs).select("doc_id", "tie", bound(words(F.col("text")), base).alias("b"))
    best = block_matches(docs, templates).groupBy("doc_id", "tie").agg(F.collect_set("label").alias("found"), F.max("containment").alias("containment"))
    best = best.select(F.col("doc_id").alias("_id"), F.col("tie").alias("_tie"), "found", "containment")
    joined = rows.join(best, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("tie") == F.col("_tie")), "left")
    places = F.col("b.places")
    base_set = F.array_distinct(F.transform(places, lambda p: p["label"]))
    every = F.array_distinct(F.concat(base_set, F.coalesce("found", F.array().cast("array<string>"))))
    return joined.select(
        "doc_id",
        F.col("b.n_words").alias("n_words"),
        F.size(places).cast("bigint").alias("n_base"),
        F.array_min(F.transform(places, lambda p: p["at"])).cast("bigint").alias("first_word"),
        F.array_max(F.transform(places, lambda p: p["at"])).cast("bigint").alias("last_word"),
        F.concat_ws(",", F.array_sort(base_set)).alias("base_labels"),
        F.concat_ws(",", F.array_sort(every)).alias("labels"),
        F.when(F.size(places) > 0, 1.0).otherwise(F.coalesce("containment", F.lit(0.0))).alias("score"),
    )

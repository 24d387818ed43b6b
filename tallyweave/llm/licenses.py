"""License scans by an exact set-similarity join (operator 11), with DataFrame functions only.

A text's words are runs of letters and digits (any code point beyond ASCII counts as a letter),
with A-Z in lower case. Two things are looked for:

* Places of fixed phrases, word by word.
* Blocks that hold a license template. A block is a window of words: a class of templates has
  windows of 2 * reach words at every reach-th word, where reach is at least 1.25 times its longest
  template, so a notice with some words put in lies whole in a window. A block holds a template if
  at least THRESHOLD of the template's distinct words are in it (containment).

The join on containment is exact. Words are ordered by the number of documents they are in, over the
whole corpus, rarest first. Of a template with s words, need = ceil(THRESHOLD * s) of which have
to be found, one of the s - need + 1 rarest must be in any block that holds it (prefix filter);
these make the index that blocks are joined with, by word. A block of fewer template words
than `need` can't hold it (length filter), nor can one whose first shared word has too few words behind
it, in the block or in the template (positional filter). What is left is counted. Blocks are made only
in documents, and kept only where they have a word of the index. The index grows with the templates,
never with the data, and is broadcast; texts are not shuffled.

A match counts if the block has the template's key words, and if no rival (a template of the same
class and family that the block holds too, keys included) explains all that was found of it and more: the
words of a GPL notice are in an LGPL notice, too.

Defined results: a null text is an empty one and has no words. First and last words are null where no
phrase stands. Rows that repeat a doc_id, or have none, are scanned each. Texts are scanned
whole, whatever their length. Words equal only as code points. An empty table gives no rows; without
documents all words count as equally rare. Extra columns are not read.
"""

from __future__ import annotations

import re
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyweave.llm.common import importable

#: Share of a template's words, as a fraction, that a block must hold.
THRESHOLD = (4, 5)
#: Labels that one long has bits for.
BITS = 62
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


class Template(NamedTuple):
    label: str
    family: str  # rivals share it
    keys: str  # words without which a match doesn't count
    text: str


#: Phrases with their labels, and opening words of public licenses and of usual notices.
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
TEMPLATES = [
    Template("mit", "mit", "mit license", "Released under the MIT License"),
    Template("mit", "permission", "permission granted charge copy", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    Template("isc", "permission", "permission granted fee purpose", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    Template("bsd", "bsd", "redistribution source binary forms", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    Template("apache-2", "apache", "apache license 2", "Licensed under the Apache License, Version 2.0"),
    Template("apache-2", "apache-header", "apache license 2", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License"),
    Template("gpl-2", "gnu", "gnu general public 2", "This work is licensed under the GNU General Public License, version 2"),
    Template("gpl-3", "gnu", "gnu general public 3", "This work is licensed under the GNU General Public License, version 3"),
    Template("lgpl-2.1", "gnu", "gnu lesser public 2 1", "This work is licensed under the GNU Lesser General Public License, version 2.1"),
    Template("lgpl-3", "gnu", "gnu lesser public 3", "This work is licensed under the GNU Lesser General Public License, version 3"),
    Template("agpl-3", "gnu", "gnu affero public 3", "This work is licensed under the GNU Affero General Public License, version 3"),
    Template("gpl-2", "gnu-header", "gnu general public 2", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version"),
    Template("gpl-3", "gnu-header", "gnu general public 3", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"),
    Template("lgpl-3", "gnu-header", "gnu lesser public 3", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"),
    Template("agpl-3", "gnu-header", "gnu affero public 3", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"),
    Template("mpl-2", "mpl", "mozilla public 2", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    Template("epl-2", "epl", "eclipse public 2", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0"),
    Template("unlicense", "unlicense", "unencumbered public domain", "This is free and unencumbered software released into the public domain"),
    Template("cc0", "cc0", "cc0 1", "Released under CC0 1.0 Universal"),
    Template("cc-by", "cc", "cc by", "Licensed under CC BY 4.0"),
    Template("cc-by-sa", "cc", "cc by sa", "Licensed under CC BY-SA 4.0"),
    Template("cc-by-nd", "cc", "cc by nd", "Licensed under CC BY-ND 4.0"),
    Template("cc-by-nc", "cc", "cc by nc", "Licensed under CC BY-NC 4.0"),
    Template("cc-by-nc-sa", "cc", "cc by nc sa", "Licensed under CC BY-NC-SA 4.0"),
    Template("cc-by-nc-nd", "cc", "cc by nc nd", "Licensed under CC BY-NC-ND 4.0"),
    Template("cc-by", "creative", "creative commons attribution", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    Template("cc-by-sa", "creative", "creative commons attribution sharealike", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    Template("cc-by-nd", "creative", "creative commons attribution noderivatives", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License"),
    Template("cc-by-nc", "creative", "creative commons attribution noncommercial", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    Template("cc-by-nc-sa", "creative", "creative commons attribution noncommercial sharealike", "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License"),
    Template("cc-by-nc-nd", "creative", "creative commons attribution noncommercial noderivatives", "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License"),
]


def words_of(text: str) -> list[str]:
    """The words of a template; the same rule as `words`."""
    return re.findall(_WORD, text.translate(str.maketrans(_UPPER, _LOWER)))


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER), F.lit(_WORD), F.lit(0))


def phrase_places(own: Column, phrase: str) -> Column:
    """array<int>: where, in the array of words, a phrase's words stand one after the other; words count from 0."""
    parts = words_of(phrase)
    stands = lambda i: _all([F.get(own, i + k) == w for k, w in enumerate(parts)])
    found = F.filter(F.sequence(F.lit(0), F.size(own) - len(parts)), stands)
    return F.when((F.size(own) >= len(parts)) & _all([F.array_contains(own, w) for w in dict.fromkeys(parts)]), found).otherwise(F.array().cast("array<int>"))


def _all(conditions: list[Column]) -> Column:
    met = conditions[0]
    for c in conditions[1:]:
        met = met & c
    return met


class _Rule(NamedTuple):
    """A template in the corpus's order of words."""

    label: str
    family: str
    reach: int
    words: list[str]
    need: int
    keys: list[str]


def rules(templates: list[Template], counts: dict[str, int], threshold: tuple[int, int] = THRESHOLD) -> list[_Rule]:
    """The templates with their words rarest first; counts: in how many documents a word is."""
    longest: dict[str, int] = {}
    for t in templates:
        longest[t.family] = max(longest.get(t.family, 0), len(words_of(t.text)))
    out = []
    for t in templates:
        own = sorted(set(words_of(t.text)), key=lambda w: (counts.get(w, 0), w))
        reach = 1 << (-(-longest[t.family] * 5 // 4) - 1).bit_length()
        out.append(_Rule(t.label, t.family, reach, own, -(-threshold[0] * len(own) // threshold[1]), words_of(t.keys)))
    return out


def word_counts(docs: DataFrame, vocabulary: list[str], text_col: str = "text") -> dict[str, int]:
    """In how many documents each word of the vocabulary is, over all documents."""
    found = docs.select(F.explode(F.array_intersect(F.lit(vocabulary), words(F.col(text_col)))).alias("w")).groupBy("w").count()
    return {r["w"]: r["count"] for r in found.collect()}  # a row a word of the templates at most


def _class_blocks(own: Column, same: list[_Rule], order: list[str]) -> Column:
    """array<struct<reach, words>>: a class's windows that have a word of its index, with their template words, rarest first."""
    reach = same[0].reach
    rare = F.lit(sorted({w for r in same for w in r.words[: len(r.words) - r.need + 1]}))
    known = F.lit([w for w in order if any(w in r.words for r in same)])
    windows = F.greatest(F.ceil(F.size(own) / F.lit(reach)).cast("int") - 1, F.lit(1))
    hits = F.filter(F.sequence(F.lit(0), windows - 1), lambda k: F.arrays_overlap(F.slice(own, k * reach + 1, F.lit(2 * reach)), rare))
    shown = F.transform(hits, lambda k: F.struct(F.lit(reach).alias("reach"), F.array_intersect(known, F.slice(own, k * reach + 1, F.lit(2 * reach))).alias("words")))
    return F.when(F.arrays_overlap(own, rare), shown).otherwise(F.array().cast("array<struct<reach:int,words:array<string>>>"))


def _blocks(own: Column, made: list[_Rule], order: list[str]) -> Column:
    return F.concat(*[_class_blocks(own, [r for r in made if r.reach == reach], order) for reach in sorted({r.reach for r in made})])


def _index(docs: DataFrame, made: list[_Rule], labels: list[str]) -> DataFrame:
    """A row a template and word of its prefix."""
    rows = []
    for t, r in enumerate(made):
        rivals = [(x.words, x.need, x.keys) for k, x in enumerate(made) if k != t and x.family == r.family and x.label != r.label]
        rows += [(r.reach, w, place, labels.index(r.label) // BITS, 1 << (labels.index(r.label) % BITS), r.words, r.need, r.keys, rivals) for place, w in enumerate(r.words[: len(r.words) - r.need + 1])]
    shape = "reach int, word string, place int, mask int, bit long, template array<string>, need int, keys array<string>, rivals array<struct<words:array<string>,need:int,keys:array<string>>>"
    return F.broadcast(docs.sparkSession.createDataFrame(rows, shape))


def _holds(block: Column, template: Column, need: Column, keys: Column) -> Column:
    return (F.size(F.array_intersect(template, block)) >= need) & (F.size(F.array_except(keys, block)) == 0)


def scan(docs: DataFrame, *, templates: list[Template] | None = None, phrases: dict[str, str] | None = None, threshold: tuple[int, int] = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_words, n_base, first_word, last_word, base_labels, labels, score): a row a document.

    base_labels are those of phrases, labels those of templates as well, both sorted arrays. The score
    is the largest containment of a template that counts, 1 where a phrase stands, or else 0.
    """
    importable(docs.sparkSession)
    templates, phrases = TEMPLATES if templates is None else templates, PHRASES if phrases is None else phrases
    vocabulary = sorted({w for t in templates for w in words_of(t.text)})
    counts = word_counts(docs, vocabulary, text_col)
    made = rules(templates, counts, threshold)
    order = sorted(vocabulary, key=lambda w: (counts.get(w, 0), w))
    labels = sorted({*phrases.values(), *(t.label for t in templates)})
    masks = -(-len(labels) // BITS)

    own = docs.select(F.col(id_col).alias("id"), words(F.col(text_col)).alias("w"))
    places = {p: phrase_places(F.col("w"), p) for p in phrases}
    scanned = own.select("id", F.size("w").cast("long").alias("n_words"), *[c.alias(f"p{k}") for k, c in enumerate(places.values())], _blocks(F.col("w"), made, order).alias("blocks"))
    at = F.concat(*[F.col(f"p{k}") for k in range(len(places))])
    base = [F.lit(0).cast("long")] * masks
    for k, label in enumerate(phrases.values()):
        m = labels.index(label)
        base[m // BITS] = base[m // BITS].bitwiseOR(F.when(F.size(f"p{k}") > 0, 1 << (m % BITS)).otherwise(0).cast("long"))
    rows = scanned.select(
        F.monotonically_increasing_id().alias("row"), "id", "n_words", F.size(at).cast("long").alias("n_base"), F.array_min(at).cast("long").alias("first_word"), F.array_max(at).cast("long").alias("last_word"),
        *[c.alias(f"base{m}") for m, c in enumerate(base)], "blocks",
    )
    whole = [c for c in rows.columns if c != "blocks"]

    blocks = rows.select(*whole, F.explode_outer("blocks").alias("b")).select(*whole, F.col("b.reach").alias("b_reach"), F.col("b.words").alias("b_words"))
    tokens = blocks.select(*whole, "b_reach", "b_words", F.posexplode_outer("b_words").alias("b_place", "b_word"))
    shared = F.array_intersect("template", "b_words")
    candidate = (
        (F.col("b_reach") == F.col("reach")) & (F.col("b_word") == F.col("word")) & (F.size("b_words") >= F.col("need"))
        & (F.least(F.size("b_words") - F.col("b_place"), F.size("template") - F.col("place")) >= F.col("need"))
    )
    joined = tokens.join(_index(docs, made, labels), candidate, "left")
    beaten = F.exists("rivals", lambda x: _holds(F.col("b_words"), x["words"], x["need"], x["keys"]) & (F.size(F.array_except(shared, x["words"])) == 0) & (F.size(F.array_intersect(x["words"], F.col("b_words"))) > F.size(shared)))
    counts_for = F.coalesce((F.get(shared, F.lit(0)) == F.col("word")) & _holds(F.col("b_words"), F.col("template"), F.col("need"), F.col("keys")) & ~beaten, F.lit(False))
    seen = joined.select(*whole, F.when(counts_for, F.col("mask")).alias("mask"), "bit", F.when(counts_for, F.size(shared) / F.size("template")).otherwise(0.0).alias("share"))
    found = seen.groupBy(*whole).agg(F.max("share").alias("share"), *[F.bit_or(F.when(F.col("mask") == m, F.col("bit")).otherwise(0)).alias(f"more{m}") for m in range(masks)])

    def shown(*names: str) -> Column:
        has = [_any([F.col(f"{n}{k // BITS}").bitwiseAND(F.lit(1 << (k % BITS))) != 0 for n in names]) for k in range(len(labels))]
        return F.array_compact(F.array(*[F.when(c, F.lit(x)) for c, x in zip(has, labels, strict=True)]))

    return found.select(
        F.col("id").alias(id_col), "n_words", "n_base", "first_word", "last_word", shown("base").alias("base_labels"), shown("base", "more").alias("labels"), F.when(F.col("n_base") > 0, 1.0).otherwise(F.col("share")).alias("score"),
    )


def _any(conditions: list[Column]) -> Column:
    met = conditions[0]
    for c in conditions[1:]:
        met = met | c
    return met

"""License scans: fixed phrases, and text blocks that hold most words of a license notice.

The second is a set-similarity join. The words of all templates are put in one global order, rarest in
the corpus first. A block that holds enough words of a template shares a word with the template's
prefix, its first words in that order, so only blocks with such a word meet templates, and only where
the places of the word still leave enough words behind it on both sides. What passes is counted out.
Only DataFrame functions are used.
"""

from __future__ import annotations

import math
import re
from collections.abc import Mapping, Sequence
from functools import reduce
from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fileledger.llm.rows import table
from fileledger.session import cut_lineage

# Phrases to be found, and their labels.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
#: Openings of public license notices, and how a license is named in a line.
TEMPLATES = {
    "apache-2.0": (
        "Licensed under the Apache License, Version 2.0",
        "you may not use this file except in compliance with the License. You may obtain a copy of the License at",
    ),
    "bsd": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted"
        " provided that the following conditions are met",
    ),
    "cc-by-4.0": ("This work is licensed under a Creative Commons Attribution 4.0 International License",),
    "cc-by-nc-4.0": (
        "Licensed under CC BY-NC 4.0",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License",
    ),
    "gpl-3.0": (
        "This work is licensed under the GNU General Public License, version 3",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU"
        " General Public License as published by the Free Software Foundation, either version 3 of the License,"
        " or (at your option) any later version",
    ),
    "isc": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is"
        " hereby granted, provided that the above copyright notice and this permission notice appear in all copies",
    ),
    "mit-text": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and"
        " associated documentation files, to deal in the Software without restriction, including without"
        " limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies",
    ),
    "mpl-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",),
    "unlicense": ("This is free and unencumbered software released into the public domain",),
}
THRESHOLD = 0.8
#: Templates are a setting, not a table; their words go to every task.
MOST_TEMPLATE_WORDS = 20_000
_NO_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: str) -> Column:
    """The words of a text, A to Z as small letters; none if it is null."""
    lowered = F.translate(F.coalesce(F.col(text), F.lit("")), ascii_uppercase, ascii_lowercase)
    return F.array_remove(F.split(lowered, _NO_WORD), "")


class _Template:
    """The distinct words of one template, how many of them make a match, and its blocks' stride.

    Blocks are two strides long and begin at every stride, so any passage of a stride's words, and a
    stride is no less than the template, lies in one of them whole.
    """

    def __init__(self, label: str, text: str, threshold: float) -> None:
        words = re.findall(_WORD, text.translate(str.maketrans(ascii_uppercase, ascii_lowercase)))
        self.label, self.words = label, sorted(set(words))
        self.enough = max(1, math.ceil(threshold * len(self.words) - 1e-9))
        self.stride = 1 << max(3, (len(words) - 1).bit_length())


def _templates(templates: Mapping[str, Sequence[str]], threshold: float) -> list[_Template]:
    if not 0 < threshold <= 1:
        raise ValueError("threshold has to be above 0 and at most 1")
    found = [_Template(label, text, threshold) for label, texts in templates.items() for text in texts]
    found = [t for t in found if t.words]
    if sum(len(t.words) for t in found) > MOST_TEMPLATE_WORDS:
        raise ValueError(f"templates of more than {MOST_TEMPLATE_WORDS} words")
    return found


def _literal(words: Sequence[str]) -> Column:
    return F.array(*map(F.lit, words)).cast("array<string>")


def _in_order(documents: DataFrame, words: Sequence[str]) -> list[str]:
    """The words by the number of documents that hold them, rarest first; ties by the word."""
    held = documents.select(F.explode(F.array_intersect(_literal(words), "words")).alias("word"))
    counts = {r.word: r["count"] for r in held.groupBy("word").count().collect()}  # at most the templates' words
    return sorted(words, key=lambda w: (counts.get(w, 0), w))


def _blocks(stride: int, of_stride: Sequence[_Template], rank: Mapping[str, int]) -> Column:
    """The blocks that hold a word of a template's prefix, with their template words in global order."""
    ordered = sorted({w for t in of_stride for w in t.words}, key=rank.__getitem__)
    prefixes = {w for t in of_stride for w in sorted(t.words, key=rank.__getitem__)[: len(t.words) - t.enough + 1]}
    fewest = min(t.enough for t in of_stride)
    count = F.greatest(F.ceil(F.size("words") / stride).cast("int") - 1, F.lit(1))

    def block(k: Column) -> Column:
        own = F.slice("words", k * stride + 1, 2 * stride)
        return F.struct(F.lit(stride).alias("stride"), k.alias("block"), F.array_intersect(_literal(ordered), own).alias("held"))

    def may_match(b: Column) -> Column:
        return (F.size(b["held"]) >= fewest) & F.arrays_overlap(b["held"], _literal(sorted(prefixes)))

    return F.filter(F.transform(F.sequence(F.lit(0), count - 1), block), may_match)


def _prefix_index(spark: SparkSession, templates: Sequence[_Template], rank: Mapping[str, int]) -> DataFrame:
    """One row for each word of each template's prefix, with its place in the template's order."""
    rows = []
    for number, t in enumerate(templates):
        ordered = sorted(t.words, key=rank.__getitem__)
        for place, word in enumerate(ordered[: len(ordered) - t.enough + 1]):
            values = {
                "stride": F.lit(t.stride), "word": F.lit(word), "template": F.lit(number), "label": F.lit(t.label),
                "place": F.lit(place), "template_words": _literal(ordered), "enough": F.lit(t.enough),
            }
            rows.append(F.struct(*[v.alias(k) for k, v in values.items()]))
    return spark.range(1).select(F.inline(F.array(*rows)))


def matching_blocks(blocks: DataFrame, index: DataFrame) -> DataFrame:
    """(row, stride, block, label, containment): the templates that a block holds enough words of.

    `blocks` has `held`, a block's template words in global order, and the name of the block.
    """
    candidates = (
        blocks.select("*", F.posexplode("held").alias("at", "word"))
        .join(F.broadcast(index), ["stride", "word"])  # bounded by MOST_TEMPLATE_WORDS
        .filter(F.size("held") >= F.col("enough"))  # length
        # The first word that both have leaves no fewer words behind it than they share.
        .filter(F.least(F.size("template_words") - F.col("place"), F.size("held") - F.col("at")) >= F.col("enough"))
    )
    shared = F.size(F.array_intersect("held", "template_words"))
    return (
        candidates.filter(shared >= F.col("enough"))
        .select("row", "stride", "block", "template", "label", (shared / F.size("template_words")).alias("containment"))
        .distinct()
    )


def _phrase_columns(phrases: Mapping[str, str]) -> list[tuple[Column, Column, Column, Column]]:
    """For each phrase: at how many places it stands, the first and the last of them, and its label."""
    line, found = F.col("line"), []
    for phrase, label in phrases.items():
        between = f" {phrase} "
        there = F.contains(line, F.lit(between))

        def gaps(text: Column) -> Column:
            return F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit("")))

        places = F.when(there, F.regexp_count(line, F.lit(f" {re.escape(phrase)}(?= )"))).otherwise(0)
        first = F.when(there, gaps(F.substring_index(line, between, 1)))
        behind = gaps(F.substring_index(line, between, -1))
        last = F.when(there, F.col("n_words") - behind - len(phrase.split(" ")))
        found.append((places, first, last, F.when(there, F.lit(label))))
    return found


def license_scan(
    documents: DataFrame,
    phrases: Mapping[str, str] = PHRASES,
    templates: Mapping[str, Sequence[str]] = TEMPLATES,
    threshold: float = THRESHOLD,
    doc_id: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """One row per document: its words, the places of phrases, and the labels of what it holds.

    Words are runs of letters, digits and what is not ASCII; A to Z count as small letters. A template
    matches where a block of 2 strides holds at least `threshold` of its distinct words, its stride
    being the next power of two from its length on, 8 at least. `score` is the largest share of a
    matching template, 1 where a phrase stands, else 0. Labels are distinct, sorted and joined by
    commas. A null or empty text has no words and no labels; texts of any length are read whole, block
    by block; repeated rows are judged each; other columns are not read. `phrases` are words with one
    space between them.

    Texts are looked at twice, once to order the templates' words and once to find blocks, and never
    shuffled: what moves is a narrow row per document, and the few blocks with a rare template word.
    """
    spark = documents.sparkSession
    given = documents.select(F.col(doc_id).alias("doc_id"), words_of(text).alias("words"))
    known = _templates(templates, threshold)
    order = _in_order(given, sorted({w for t in known for w in t.words})) if known else []
    rank = {word: k for k, word in enumerate(order)}
    strides = sorted({t.stride for t in known})
    of_stride = [_blocks(s, [t for t in known if t.stride == s], rank) for s in strides]
    line = F.concat(F.lit(" "), F.array_join("words", " "), F.lit(" "))
    lined = given.select(
        "doc_id",
        F.monotonically_increasing_id().alias("row"),
        F.size("words").cast("bigint").alias("n_words"),
        line.alias("line"),
        (F.concat(*of_stride) if of_stride else F.array()).alias("blocks"),
    )
    columns = _phrase_columns(phrases)
    labels = F.array_sort(F.array_distinct(F.array_compact(F.array(*[c[3] for c in columns]))))

    def least_or_greatest(which, k: int) -> Column:
        every = [c[k].cast("bigint") for c in columns]
        return which(*every) if len(every) > 1 else every[0]

    found = cut_lineage(
        lined.select(
            "doc_id", "row", "n_words",
            reduce(Column.__add__, [c[0] for c in columns]).cast("bigint").alias("n_base"),
            least_or_greatest(F.least, 1).alias("first_word"),
            least_or_greatest(F.greatest, 2).alias("last_word"),
            labels.alias("base"), "blocks",
        )
    )
    if not known:
        matches = found.filter("false").select("row", F.array().cast("array<string>").alias("own"), F.lit(0.0).alias("share"))
    else:
        matched = matching_blocks(found.select("row", F.inline("blocks")), _prefix_index(spark, known, rank))
        matches = matched.groupBy("row").agg(F.collect_set("label").alias("own"), F.max("containment").alias("share"))
    none = F.array().cast("array<string>")
    return (
        found.drop("blocks")
        .join(matches, "row", "left")
        .select(
            "doc_id", "n_words", "n_base", "first_word", "last_word",
            F.array_join("base", ",").alias("base_labels"),
            F.array_join(F.array_sort(F.array_union("base", F.coalesce("own", none))), ",").alias("labels"),
            F.coalesce(F.when(F.col("n_base") > 0, 1.0), "share", F.lit(0.0)).alias("score"),
        )
    )


def op12_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licenses named or quoted in each document."""
    return license_scan(table(spark, sf_dir, "documents"))


def _sql() -> str:
    def quoted(words: Sequence[str]) -> str:
        return "[" + ", ".join(f"'{w}'" for w in words) + "]"

    known = _templates(TEMPLATES, THRESHOLD)
    templates = ", ".join(f"('{t.label}', {t.stride}, {t.enough}, {quoted(t.words)})" for t in known)
    phrases = ", ".join(f"({quoted(p.split(' '))}, '{label}')" for p, label in PHRASES.items())
    return f"""
WITH given AS (
    SELECT row_number() OVER () AS r, doc_id,
           regexp_extract_all(translate(coalesce(text, ''), '{ascii_uppercase}', '{ascii_lowercase}'), '{_WORD}') AS words
    FROM documents
), phrases(phrase, label) AS (VALUES {phrases}
), templates(label, stride, enough, held) AS (VALUES {templates}
), places AS (
    SELECT r, label, unnest(list_filter(range(len(words)), lambda i: words[i + 1] = phrase[1]
               AND words[i + 1 : i + len(phrase)] = phrase)) AS place
    FROM given, phrases
), base AS (
    SELECT r, count(*) AS n_base, min(place) AS first_word, max(place) AS last_word, list(DISTINCT label) AS base
    FROM places GROUP BY r
), blocks AS (
    SELECT r, stride, unnest(range(greatest(CAST(ceil(len(words) / stride) AS BIGINT) - 1, 1))) AS block, words
    FROM given, (SELECT DISTINCT stride FROM templates)
), cut AS (
    SELECT r, stride, words[block * stride + 1 : block * stride + 2 * stride] AS words FROM blocks
), matches AS (
    SELECT r, label, len(list_intersect(held, words)) / len(held) AS share
    FROM cut JOIN templates USING (stride) WHERE len(list_intersect(held, words)) >= enough
), own AS (
    SELECT r, list(DISTINCT label) AS own, max(share) AS share FROM matches GROUP BY r
)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word,
       coalesce(array_to_string(list_sort(base), ','), '') AS base_labels,
       coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(base, []), coalesce(own, [])))), ','), '') AS labels,
       CASE WHEN n_base > 0 THEN 1.0 ELSE coalesce(share, 0.0) END::DOUBLE AS score
FROM given LEFT JOIN base USING (r) LEFT JOIN own USING (r)
"""


SQL = _sql()

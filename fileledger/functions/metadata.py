"""Metadata documents: what gets one, and search inside them."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from fileledger.functions.names import extractor_for

# Defaults of the analysis gate and texts of its documents.
DEFAULT_TYPES = ("pdf", "docx", "xlsx", "pptx", "txt", "jpg", "png", "mp3", "mp4")
DEFAULT_SIZE_CAP = 52428800
TOO_LARGE = "file too large"
NOT_LISTED = ("extension ", " not in analysis list")
NO_ANALYZER = "no analyzer for "

# A JSON string with, for a key, the colon after it. Possessive, so it runs without recursion.
_STRING_TOKEN = r'"[^"\\]*+(?:\\.[^"\\]*+)*+"(?:\s*:)?'


def parse_types(text: str) -> list[str]:
    """`'pdf, docx'` as a list."""
    return [part.strip() for part in text.split(",")]


def skip_reason(
    size: Column,
    ext: Column,
    types: Sequence[str] = DEFAULT_TYPES,
    size_cap: int = DEFAULT_SIZE_CAP,
) -> Column:
    """Why a file is not analysed, null if it is. The first reason that applies wins."""
    ext = F.lower(F.coalesce(ext, F.lit("")))
    return (
        F.when(size > size_cap, F.lit(TOO_LARGE))
        .when(
            ~ext.isin(*["." + t for t in types]),
            F.concat(F.lit(NOT_LISTED[0]), ext, F.lit(NOT_LISTED[1])),
        )
        .when(extractor_for(ext).isNull(), F.concat(F.lit(NO_ANALYZER), ext))
    )


def skip_document(reason: Column) -> Column:
    return F.when(reason.isNotNull(), F.to_json(F.struct(reason.alias("skipped"))))


def error_document(message: Column) -> Column:
    return F.when(message.isNotNull(), F.to_json(F.struct(message.alias("erro"))))


def contains_patterns(keyword: str) -> tuple[str, str]:
    """Regular expressions for LIKE `%keyword%`: for one value, and for text the value is part of.

    `%` and `_` are wildcards, `\\` makes the next character literal. Between wildcards the first
    place a piece fits is as good as any later one, so nothing is tried twice and the time grows
    with the length of the text only.
    """
    pieces, rest = [""], iter("%" + keyword + "%")
    for char in rest:
        if char == "%":
            pieces.append("")
        elif char == "_":
            pieces[-1] += "."
        else:
            literal = next(rest) if char == "\\" else char
            pieces[-1] += re.escape(literal) if literal.isascii() else literal
    # A keyword ending in a backslash takes the wildcard after it as a literal percent sign, and
    # then has to end the value.
    *inner, last = pieces
    found = r"(?s)\A" + "".join(f"(?>.*?{piece})" for piece in inner if piece)
    if last:
        return rf"{found}.*{last}\z", f"{found}(?>.*?{last})"
    return found, found


def literal_pieces(keyword: str) -> list[str]:
    """The pieces of a LIKE keyword between its wildcards: a value like it holds each of them."""
    pieces, rest = [""], iter(keyword)
    for char in rest:
        if char in "%_":
            pieces.append("")
        elif char == "\\":
            # At the end it takes the wildcard that follows the keyword as a literal.
            pieces[-1] += next(rest, "%")
        else:
            pieces[-1] += char
    return [piece for piece in pieces if piece]


def _unquoted(token: Column) -> Column:
    """The text that a JSON string stands for."""
    plain = F.substring(token, F.lit(2), F.length(token) - 2)
    unescaped = F.get_json_object(F.concat(F.lit('{"a":'), token, F.lit("}")), "$.a")
    return F.when(token.contains("\\"), unescaped).otherwise(plain)


def string_values(document: Column) -> Column:
    """All string values of a JSON document, at any depth, without keys."""
    tokens = F.regexp_extract_all(document, F.lit(_STRING_TOKEN), F.lit(0))
    return F.transform(F.filter(tokens, lambda token: ~token.endswith(":")), _unquoted)


def has_value_like(document: Column, keyword: str) -> Column:
    """Some string value of the JSON document, at any depth, contains the keyword.

    Keys and numbers do not count. `%` and `_` in the keyword are wildcards.
    """
    value_pattern, part_pattern = contains_patterns(keyword)
    plain_keyword = not set(keyword) & set("%_\\")

    def like(value: Column, pattern: str) -> Column:
        return value.contains(keyword) if plain_keyword else value.rlike(pattern)

    def matches(token: Column) -> Column:
        return like(_unquoted(token), value_pattern)

    def found_in(whole: Column) -> Column:
        tokens = F.regexp_extract_all(whole, F.lit(_STRING_TOKEN), F.lit(0))
        exact = F.exists(tokens, lambda token: ~token.endswith(":") & matches(token))
        # Without an escape the values stand in the document as they are, so a document that does
        # not match as a whole cannot match in part; only the others are taken apart. Letters and
        # digits can only be hidden by an escape with their number.
        escape = "\\u" if keyword.isascii() and keyword.isalnum() else "\\"
        return (whole.contains(escape) | like(whole, part_pattern)) & exact

    # As the item of an array the document is worked out once, however often it is looked at.
    return F.exists(F.array(document), found_in)

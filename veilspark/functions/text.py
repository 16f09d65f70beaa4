"""Folding, keys, parts and positions of strings, as columns."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F


def fold_turkish(value: Column) -> Column:
    """Lower case with the dotless i and the letters with marks made plain, and ß as ss."""
    return F.regexp_replace(F.translate(F.replace(F.lower(value), F.lit("ß"), F.lit("ss")), "ışğçöü", "isgcou"), "̇", "")


def compact(value: Column) -> Column:
    """Folded, with only letters and digits left."""
    return F.regexp_replace(fold_turkish(value), "[^a-z0-9]", "")


def digit_key(value: Column) -> Column:
    """Runs of digits become one 0."""
    return F.regexp_replace(value, "[0-9]+", "0")


def slug(value: Column) -> Column:
    """Category name: other signs than letters and digits become one underscore, 40 at most."""
    return F.substring(F.regexp_replace(F.regexp_replace(value, "[^A-Za-z0-9]+", "_"), "^_+|_+$", ""), 1, 40)


def short_hash(value: Column) -> Column:
    """Twelve hex digits that name a value without showing it."""
    return F.substring(F.sha2(F.lower(value), 256), 1, 12)


def keyed_hash(context: Column, value: Column) -> Column:
    return F.sha2(F.concat_ws(":", context.cast("string"), value), 256)


def parts(value: Column) -> Column:
    """Parts of an identifier: split at signs, case changes, and between letters and digits."""
    cut = F.regexp_replace(value, r"(?<=[a-z])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])|(?<=[A-Za-z])(?=[0-9])|(?<=[0-9])(?=[A-Za-z])", " ")
    return F.filter(F.split(F.regexp_replace(cut, "[^A-Za-z0-9]+", " "), " "), lambda x: x != "")


def spaced(value: Column) -> Column:
    """The parts of an identifier with spaces between them: split at signs and case changes of any alphabet, and between letters and digits."""
    cut = F.regexp_replace(value, r"(?<=\p{Ll})(?=\p{Lu})|(?<=\p{Lu})(?=\p{Lu}\p{Ll})|(?<=\p{L})(?=\p{N})|(?<=\p{N})(?=\p{L})", " ")
    return F.trim(F.regexp_replace(cut, r"[^\p{L}\p{N}]+", " "))


def contains_parts(whole: Column, term: Column) -> Column:
    """Whether the parts of ``term`` stand in a row among the parts of ``whole``; case is ignored."""
    w, t = (F.transform(parts(x), F.lower) for x in (whole, term))
    starts = F.when(F.size(w) >= F.size(t), F.sequence(F.lit(1), F.size(w) - F.size(t) + 1)).otherwise(F.array().cast("array<int>"))
    return (F.size(t) > 0) & F.exists(starts, lambda i: F.slice(w, i, F.size(t)) == t)


def line_of(text: Column, offset: Column) -> Column:
    """1-based line of a code-point offset."""
    before = F.substring(text, F.lit(1), offset)
    return F.length(before) - F.length(F.replace(before, F.lit("\n"), F.lit(""))) + 1


def column_of(text: Column, offset: Column) -> Column:
    """1-based column of a code-point offset."""
    return F.length(F.substring_index(F.substring(text, F.lit(1), offset), "\n", -1)) + 1


def excerpt(text: Column, start: Column, end: Column, around: int = 80) -> Column:
    """The text around a span, on one line."""
    low = F.greatest(start - around, F.lit(0))
    return F.regexp_replace(F.substring(text, low + 1, F.least(end + around, F.length(text)) - low), r"\s+", " ")


#: Named character references that the search view decodes, besides numeric ones.
ENTITIES = {"&lt;": "<", "&gt;": ">", "&quot;": '"', "&apos;": "'", "&#39;": "'", "&nbsp;": " ", "&amp;": "&"}
INVISIBLE = "[­​-‏⁠﻿]"


def entity_view(value: Column) -> Column:
    """The text as a reader sees it: common references decoded once, invisible signs dropped."""
    for name, sign in ENTITIES.items():
        value = F.replace(value, F.lit(name), F.lit(sign))
    return F.regexp_replace(value, INVISIBLE, "")


def normalised(text: str) -> str:
    """NFKC and case folding, for use in Arrow functions (Spark has no NFKC of its own)."""
    return unicodedata.normalize("NFKC", text).casefold()

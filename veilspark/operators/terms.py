"""Corporate terms: tolerant patterns, and terms as rules."""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import DataFrame

from veilspark.operators.rules import Rule

# Letters that stand for each other.
ALIKE = {"i": "iıİI", "ı": "iıİI", "s": "sşSŞ", "ş": "sşSŞ", "g": "gğGĞ", "ğ": "gğGĞ", "c": "cçCÇ", "ç": "cçCÇ", "o": "oöOÖ", "ö": "oöOÖ", "u": "uüUÜ", "ü": "uüUÜ"}


def identifier_parts(term: str) -> list[str]:
    return re.findall(r"[^\W\d_]+|\d+", re.sub(r"(?<=[a-z])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])", " ", term))


def term_pattern(term: str) -> str:
    """The pattern of a term: letters with or without marks, parts with or without a separator; short terms must stand alone."""
    parts = ["".join(f"[{ALIKE[c]}]" if (c := x.lower()) in ALIKE else re.escape(x) for x in part) for part in identifier_parts(term)]
    body = r"[\s_\-.]?".join(parts)
    letters = sum(c.isalpha() for c in term)
    left = "" if letters >= 4 else r"(?<![A-Za-z0-9])"
    return left + body + ("" if letters >= 4 else r"(?![A-Za-z0-9])")


def rule_name(term: str) -> str:
    return f"term_{hashlib.sha256(term.casefold().encode()).hexdigest()[:12]}"


def term_rules(terms: list[str], priority: int = 4) -> tuple[Rule, ...]:
    """Rules of a short list of terms; a long list is searched by join instead (consistency.leaks)."""
    first = {t.casefold(): t for t in reversed([t.strip() for t in terms if t.strip()])}
    return tuple(Rule(rule_name(t), "regex", "corporate_term", term_pattern(t), "mask_kurumsal_ifade", priority, "i") for t in sorted(first.values()))


def generic_values(values: DataFrame, words: tuple[str, ...], min_chars: int = 3) -> DataFrame:
    """``values`` with generic: too short, a bare number, or made of common words only."""
    from pyspark.sql import functions as F

    from veilspark.functions.text import parts

    p = F.filter(F.transform(parts(F.col("value")), F.lower), lambda x: ~x.rlike("^[0-9]+$"))
    common = F.array(*map(F.lit, words)) if words else F.array().cast("array<string>")
    return values.withColumn("generic", (F.length("value") < min_chars) | F.col("value").rlike("^[0-9]+$") | ((F.size(p) > 0) & (F.size(F.array_except(p, common)) == 0)))

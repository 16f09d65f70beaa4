"""Where a name may be cut: parts of a leak at structural signs, and matches that are a slice of a longer name."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from veilspark.functions import text as T

#: Letters that a part of a leak has at least.
PART_LETTERS = 4
#: Signs that are neither letter nor digit, one of them more than a space.
_CUT = r"[ \t\x{A0}]*[^\p{L}\p{N} \t\x{A0}][^\p{L}\p{N}]*"
_BLANK = r"^[ \t\x{A0}]+|[ \t\x{A0}]+$"


def _letters(value: Column) -> Column:
    return F.regexp_replace(T.fold_turkish(value), r"[^\p{L}\p{N}]", "")


def structural_parts(value: Column, term: Column) -> Column:
    """The parts of a value that a term was found in, which are masked one by one; the value alone if it must stay whole.

    A value is cut at runs of signs that are more than spaces ("Maria,Lopez" is
    two cells), if every cut falls on a limit between the term's own words and
    every part has at least PART_LETTERS letters.  In letters and digits, folded:
    value and term are the same, and the lengths up to the cuts are among those
    up to the ends of the term's words.
    """
    cuts = F.transform(F.split(value, _CUT, -1), lambda p: F.regexp_replace(p, _BLANK, ""))
    ends = _ends(F.transform(cuts, _letters))
    words = _ends(F.transform(F.split(T.spaced(term), " "), _letters))
    fits = (F.size(cuts) > 1) & (_letters(value) == _letters(term)) & F.forall(ends, lambda e: F.array_contains(words, e)) & F.forall(cuts, lambda p: F.length(F.regexp_replace(p, r"[^\p{L}]", "")) >= PART_LETTERS)
    return F.when(F.coalesce(fits, F.lit(False)), cuts).otherwise(F.array(value))


def _ends(parts: Column) -> Column:
    """Lengths up to the end of each part."""
    return F.transform(parts, lambda _, i: F.aggregate(F.slice(parts, F.lit(1), i + 1), F.lit(0), lambda a, p: a + F.length(p)))


def part_spans(value: Column, term: Column, start: Column) -> Column:
    """array<struct<start, end, value>>: :func:`structural_parts` with their places, where the value begins at ``start``."""
    parts = structural_parts(value, term)
    empty = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int,value:string>>").alias("out"))

    def step(acc: Column, p: Column) -> Column:
        begin = acc["at"] + F.instr(F.substring(value, acc["at"] + 1, F.length(value)), p) - 1
        span = F.struct((start + begin).cast("int").alias("start"), (start + begin + F.length(p)).cast("int").alias("end"), p.alias("value"))
        return F.struct((begin + F.length(p)).cast("int").alias("at"), F.concat(acc["out"], F.array(span)).alias("out"))

    return F.aggregate(parts, empty, step, lambda acc: acc["out"])


def mixed_case_glued(text: Column, start: Column, end: Column) -> Column:
    """Whether a match is a chance slice of a longer name: letters touch it on its left, no case change parts them, and cases are mixed.

    "nByS" in "planByStage" is one; "Vault" in "novaVault" (a change of case) and
    "VAULT" in "NOVAVAULT" (one case) are none.
    """
    before, first, second = F.substring(text, start, F.lit(1)), F.substring(text, start + 1, F.lit(1)), F.substring(text, start + 2, F.lit(1))
    own = F.substring(text, start, end - start + 1)  # with the sign before it
    upper, lower = r"\p{Lu}", r"\p{Ll}"
    parted = before.rlike(lower) & first.rlike(upper) | before.rlike(upper) & first.rlike(upper) & (start + 1 < end) & second.rlike(lower)
    return (start > 0) & before.rlike(r"\p{L}") & ~parted & own.rlike(upper) & own.rlike(lower)

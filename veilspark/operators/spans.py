"""Spans as arrays of structs within a row: overlap resolution, union, blanking, and rebuilding of texts.

A span is a struct with at least ``start`` and ``end`` (code points, end
exclusive).  Everything here is an expression on one row, so nothing is shuffled
and a document's spans never meet another document's.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from veilspark.functions.arrays import let, running

CONFIDENCE = {"dusuk": 0, "orta": 1, "yuksek": 2}
SOURCES = {"llm_audit": 0, "llm": 1, "katman2_presidio": 2, "dictionary": 3}


def _rank(value: Column, ranks: dict[str, int]) -> Column:
    out = F.lit(-1)
    for name, rank in ranks.items():
        out = F.when(value == name, rank).otherwise(out)
    return out


def authority(source: Column, rule: Column, kind: Column) -> Column:
    """5 corporate term, 4 alias, 3 run-time value, 3 pattern, 2 generic pattern, 1 heuristic, 0 else."""
    return (
        F.when(source == "corporate", 5).when(source == "alias", 4).when(kind == "parametric", 3).when((kind == "regex") & rule.startswith("generic_"), 2).when(kind == "regex", 3).when(kind == "recogniser", 1).otherwise(0)
    )


def overlaps(a: Column, b: Column) -> Column:
    return (a["end"] > b["start"]) & (a["start"] < b["end"])


def _clusters(spans: Column) -> Column:
    """Spans in the order of their starts, cut into arrays that no overlap joins."""

    def cut(ordered: Column) -> Column:
        reach = running(F.transform(ordered, lambda s: s["end"].cast("int")), F.greatest)

        def split(reach: Column) -> Column:
            heads = F.filter(F.transform(ordered, lambda s, i: F.when((i == 0) | (s["start"] >= F.get(reach, i - 1)), i)), lambda i: i.isNotNull())
            return let(heads, lambda h: F.transform(h, lambda at, k: F.slice(ordered, at + 1, F.coalesce(F.get(h, k + 1), F.size(ordered)) - at)))

        return let(reach, split)

    ordered = F.transform(F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("a"), s["end"].alias("b"), s["ord"].alias("c"), s.alias("span")))), lambda x: x["span"])
    return let(ordered, cut)


def _keys(s: Column) -> list[Column]:
    """What a span is ranked by."""
    return [(-s["authority"]).alias("k1"), (-_rank(s["confidence"], CONFIDENCE)).alias("k2"), (s["start"] - s["end"]).alias("k3"), F.coalesce(s["priority"], F.lit(100)).alias("k4"), (-_rank(s["source"], SOURCES)).alias("k5"), s["ord"].alias("k6")]


def resolve(spans: Column) -> Column:
    """Greedy choice among overlapping spans, as an array of struct<span, accepted, winner>, by rank.

    ``spans``: structs with authority, confidence, source, priority, start, end
    and ord (a number that breaks all ties).  Ranked by authority, confidence,
    length, lower priority number and source; a span is accepted unless it
    overlaps one accepted before, which is then named by its ``ord``.  Spans that
    no chain of overlaps joins cannot meet, so each such cluster is judged by
    itself, and a text with many findings costs little more than their number.
    """
    judged = F.flatten(F.transform(_clusters(spans), _resolved))
    return F.transform(F.array_sort(F.transform(judged, lambda x: F.struct(*_keys(x["span"]), x.alias("x")))), lambda y: y["x"])


def _resolved(spans: Column) -> Column:
    ranked = F.transform(F.array_sort(F.transform(spans, lambda s: F.struct(*_keys(s), s.alias("span")))), lambda x: x["span"])
    judged = F.transform(ranked, lambda s: F.struct(s.alias("span"), F.lit(True).alias("accepted"), F.lit(None).cast("int").alias("winner")))
    none = F.filter(judged, lambda x: F.lit(False))

    def step(done: Column, x: Column) -> Column:
        hit = F.get(F.filter(done, lambda d: d["accepted"] & overlaps(d["span"], x["span"])), F.lit(0))
        one = F.struct(x["span"].alias("span"), hit.isNull().alias("accepted"), hit["span"]["ord"].cast("int").alias("winner"))
        return F.concat(done, F.array(one))

    return F.aggregate(judged, none, step)


def accepted(resolved: Column) -> Column:
    """The accepted spans by start."""
    kept = F.transform(F.filter(resolved, lambda x: x["accepted"]), lambda x: F.struct(x["span"]["start"].alias("k"), x["span"].alias("span")))
    return F.transform(F.array_sort(kept), lambda x: x["span"])


def union(spans: Column) -> Column:
    """Overlapping and touching spans become one: array<struct<start, end>> by start."""
    plain = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].cast("int").alias("start"), s["end"].cast("int").alias("end"))))

    def joined(plain: Column) -> Column:
        reach = running(F.transform(plain, lambda s: s["end"]), F.greatest)

        def cut(reach: Column) -> Column:
            heads = F.filter(F.transform(plain, lambda s, i: F.when((i == 0) | (s["start"] > F.get(reach, i - 1)), i)), lambda i: i.isNotNull())
            return let(heads, lambda h: F.transform(h, lambda at, k: F.struct(F.get(plain, at)["start"].alias("start"), F.get(reach, F.coalesce(F.get(h, k + 1), F.size(plain)) - 1).alias("end"))))

        return let(reach, cut)

    return let(plain, joined)


def rebuild(text: Column, spans: Column, replacement: str = "replacement") -> Column:
    """``text`` with each span (disjoint, by start) replaced by its field ``replacement``."""

    def built(spans: Column) -> Column:
        before = lambda i: F.when(i > 0, F.get(spans, i - 1)["end"].cast("int")).otherwise(0)
        pieces = F.transform(spans, lambda s, i: F.concat(F.substring(text, before(i) + 1, s["start"].cast("int") - before(i)), s[replacement]))
        return F.concat(F.array_join(pieces, ""), F.substring(text, before(F.size(spans)) + 1, F.length(text)))

    return let(spans, built)


def blank(text: Column, spans: Column) -> Column:
    """``text`` with the signs of each span as spaces; line ends stay, so lines keep their numbers."""
    cut = F.transform(union(spans), lambda s: F.struct(s["start"], s["end"], F.regexp_replace(F.substring(text, s["start"] + 1, s["end"] - s["start"]), r"[^\r\n]", " ").alias("replacement")))
    return rebuild(text, cut)


def inside(span: Column, others: Column) -> Column:
    """Whether one of ``others`` contains the span."""
    return F.exists(others, lambda o: (o["start"] <= span["start"]) & (o["end"] >= span["end"]))


def touched(span: Column, others: Column) -> Column:
    """Whether one of ``others`` overlaps the span."""
    return F.exists(others, lambda o: overlaps(o, span))

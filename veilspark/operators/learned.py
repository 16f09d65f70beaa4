"""Learned decisions: values that are sensitive wherever they stand, and claims that decisions already cover.

Learned values are found as plain strings in the normalised text, within words
too, at every place; spans lead back to the source.  They travel to the texts as
automata of at most BLOCK characters of values each, so what is broadcast has a
bound; more values take more passes of the same job.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilspark.functions.align import aligned, folded, folded_udf
from veilspark.operators import rows
from veilspark.operators.detect import prefix_of
from veilspark.operators.phrases import _TOKEN, touches
from veilspark.sources.shared import stored

#: Characters of values in one automaton.
BLOCK = 4 << 20
#: Characters of a scope's texts, and of its suppressed values, that meet in one step.
PART, COVERS = 16 << 20, 8 << 20


def automaton(needles: list[str]) -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for n in needles:
        found.add_word(n, n)
    found.make_automaton()
    return found


def places(text: str, machine: ahocorasick.Automaton, parts: bool = False) -> list[tuple[int, int, str]]:
    """(start, end, needle) of all places of needles, in the source; none is a part of a sign that normalisation made several, and none touches a placeholder.

    With ``parts`` also those that begin or end within such a sign, one for each
    place in the normalised text; their spans hold the sign whole.
    """
    view = folded(text)
    hits = [(e - len(n) + 1, e + 1, n) for e, n in machine.iter(view)]
    if not hits:
        return []
    masked = [m.span() for m in _TOKEN.finditer(text)]
    _, starts, ends = aligned(text)
    out = []
    for low, high, needle in hits:
        a, b = starts[low], ends[high - 1]
        if (parts or folded(text[a:b]) == needle) and not touches(masked, a, b):
            out.append((a, b, needle))
    return sorted(out)


def learned_findings(docs: DataFrame, decisions: DataFrame, doc_id: str = "doc_id", text: str = "text", block: int = BLOCK, parts: bool = False) -> DataFrame:
    """Findings (doc_id, row_key, decision_id, entity, prefix, priority, confidence, start, end, value, needle) of learned sensitive values.

    ``decisions``: decision_id, value, entity.  Of decisions on one value and type
    the first counts; a value without a sign is left out; null texts have none.
    ``needle`` is the decision's value, normalised.  ``parts``: see :func:`places`.
    """
    keyed = decisions.withColumn("needle", folded_udf("value")).where(F.length("needle") > 0)
    first = stored(keyed.groupBy("needle", "entity").agg(F.min("decision_id").alias("decision_id")), "decisions")
    needles = first.groupBy("needle").agg(F.length("needle").alias("n"))
    whole = needles.agg(F.sum("n")).first()[0] or 0
    blocks = max(1, -(-whole // block))
    own = rows.keyed(docs, text, doc_id).select(F.col(doc_id).alias("doc_id"), rows.ROW, F.col(text).alias("text"))
    kind = docs.schema[doc_id].dataType.simpleString()
    out = None
    for b in range(blocks):
        some = [r[0] for r in needles.where(F.pmod(F.xxhash64("needle"), F.lit(blocks)) == b).select("needle").collect()]  # about ``block`` characters
        if not some and out is not None:
            continue

        def scan(batches: Iterator[pa.RecordBatch], some: list[str] = some) -> Iterator[pa.RecordBatch]:
            machine = automaton(some) if some else None
            for batch in batches:
                at, found = [], []
                for i, body in enumerate(batch.column(2).to_pylist()):
                    new = [(a, e, body[a:e], n) for a, e, n in places(body, machine, parts)] if machine and body else []
                    at += [i] * len(new)
                    found += new
                take = pa.array(at, pa.int64())
                cols = [pa.array([r[k] for r in found], t) for k, t in enumerate((pa.int32(), pa.int32(), pa.string(), pa.string()))]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take), *cols], ["doc_id", rows.ROW, "start", "end", "value", "needle"])

        part = own.mapInArrow(scan, f"doc_id {kind}, {rows.ROW} string, start int, end int, value string, needle string")
        out = part if out is None else out.unionByName(part)
    named = out.join(first, "needle")
    return named.select(
        "doc_id", rows.ROW, "decision_id", "entity", prefix_of(F.col("entity")).alias("prefix"), F.lit(10).alias("priority"), F.lit("yuksek").alias("confidence"), "start", "end", "value", "needle",
    )


def occurrences(text: Column, needle: Column) -> Column:
    """Starts (from 0) of a string in a text, overlapping ones too; none of an empty string."""
    cuts = F.split(text, F.concat(F.lit(r"(?=\Q"), F.replace(needle, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E)")), -1)
    lengths = F.transform(cuts, F.length)
    # The pieces begin where the string does; the first piece does so only if the text starts with it.
    sums = F.aggregate(F.slice(lengths, 1, F.greatest(F.size(lengths) - 1, F.lit(0))), F.array().cast("array<int>"), lambda a, n: F.concat(a, F.array(F.coalesce(F.get(a, F.size(a) - 1), F.lit(0)) + n)))
    starts = F.when(text.startswith(needle), F.concat(F.array(F.lit(0)), sums)).otherwise(sums)
    return F.when((F.length(needle) > 0) & text.contains(needle), F.array_distinct(starts)).otherwise(F.array().cast("array<int>"))


def standing(view: str, needle: str) -> list[int]:
    """Starts of a string in a text, overlapping ones too."""
    out, at = [], view.find(needle)
    while at >= 0:
        out.append(at)
        at = view.find(needle, at + 1)
    return out


def outside(at: list[int], n: int, reach: list[tuple[int, int]]) -> list[int]:
    """Which of the places (starts in order, of ``n`` signs) lie within none of the spans (start, furthest end; by start)."""
    out, k, far = [], 0, 0
    for p in at:
        while k < len(reach) and reach[k][0] <= p:
            far = max(far, reach[k][1])
            k += 1
        if far < p + n:
            out.append(p)
    return out


def _judged(texts: pa.Table, others: pa.Table) -> pa.Table:
    """For a part of a scope's texts and of its covers: claims that equal a cover, or of which covers hold some places; ``open`` are the others."""
    asked: dict[tuple[str, int], list[tuple[str, str]]] = defaultdict(list)
    covers = []
    for doc, row, value, needle in zip(*(others.column(c).to_pylist() for c in ("__doc", "__row", "__value", "__needle")), strict=True):
        if doc is None:
            covers.append(needle)
        else:
            asked[doc, row].append((value, needle))
    out: list[tuple] = []
    if asked and covers:
        machine, bodies = automaton(covers), texts.column("__body")
        for i, key in enumerate(zip(texts.column("__doc").to_pylist(), texts.column("__row").to_pylist(), strict=True)):
            if key not in asked:
                continue
            view = folded(bodies[i].as_py() or "")
            ends: dict[int, int] = {}
            for e, cover in machine.iter(view):  # by their ends, so the furthest is the last
                ends[e + 1 - len(cover)] = e + 1
            reach = sorted(ends.items())
            for value, needle in asked[key]:
                same, at = needle in machine, standing(view, needle)
                left = outside(at, len(needle), reach)
                if same or len(left) < len(at):
                    out.append((*key, value, same, left))
    kinds = (pa.string(), pa.int64(), pa.string(), pa.bool_(), pa.list_(pa.int32()))
    return pa.Table.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(kinds)], names=["doc", "row", "value", "same", "open"])


def _pieces(df: DataFrame, chars: Column, most: int, name: str) -> DataFrame:
    """(scope, pieces) of the scopes with more than ``most`` characters; there are at most as many as pieces."""
    return F.broadcast(df.groupBy("__scope").agg(F.ceil(F.sum(chars) / most).cast("int").alias(name)).where(F.col(name) > 1))


def covered_claims(claims: DataFrame, docs: DataFrame, decisions: DataFrame, doc_id: str = "doc_id", text: str = "text", scope: str = "scope", part: int = PART, block: int = COVERS) -> DataFrame:
    """``claims`` (doc_id, value) with covered: whether a suppression of the document's scope holds for the claim.

    ``decisions``: scope, value.  A claim is covered if a suppressed value is the
    same, or if every place of the claim's value in the text lies within a place
    of a suppressed value of the scope.  A value that stands nowhere is covered
    only by its like.  Equal claims and decisions count once; nulls are covered by
    nothing.

    The texts of a scope are dealt into parts of about ``part`` characters and its
    suppressed values into blocks of about ``block``; an automaton of a block goes
    once over a text, and a place is open if it is so for all blocks.
    """
    known = decisions.where(F.col("value").isNotNull() & F.col(scope).isNotNull()).select(F.col(scope).alias("__scope"), folded_udf("value").alias("__needle")).where("__needle <> ''").distinct()
    known = stored(known, "covers")  # dealt out, and measured before
    asked = claims.where(F.col("value").isNotNull()).select(F.col(doc_id).cast("string").alias("__doc"), F.col("value").alias("__value")).distinct()
    asked = asked.withColumn("__needle", folded_udf("__value")).where("__needle <> ''")
    own = docs.where(F.col(doc_id).isNotNull() & F.col(scope).isNotNull()).select(F.col(doc_id).cast("string").alias("__doc"), F.col(scope).alias("__scope"), F.col(text).alias("__body"))
    own = own.withColumn("__row", F.xxhash64("__doc", "__body"))
    parts = _pieces(own, F.length("__body"), part, "__parts")
    blocks = _pieces(known, F.length("__needle"), block, "__blocks")

    def dealt(df: DataFrame, key: str, one: str, every: str) -> DataFrame:
        """Each row in the piece of its key on its own side, and in all pieces of the other side."""
        both = df.join(parts, "__scope", "left").join(blocks, "__scope", "left").na.fill(1, ["__parts", "__blocks"])
        placed = both.withColumn(f"__{one}", F.pmod(F.xxhash64(key), F.col(f"__{one}s")).cast("int"))
        return placed.withColumn(f"__{every}", F.explode(F.sequence(F.lit(0), F.col(f"__{every}s") - 1))).drop("__parts", "__blocks")

    rows_of = own.select(*(F.col(c).alias(c) for c in ("__doc", "__scope", "__row"))).distinct()  # aliases, as the texts meet these again
    placed = asked.join(rows_of, "__doc")
    others = dealt(placed, "__row", "part", "block").unionByName(dealt(known, "__needle", "block", "part"), allowMissingColumns=True)
    texts = dealt(own, "__row", "part", "block")
    key = ("__scope", "__part", "__block")
    found = texts.groupBy(*key).cogroup(others.groupBy(*key)).applyInArrow(_judged, "doc string, row bigint, value string, same boolean, open array<int>")
    whole = F.size(F.aggregate("lists", F.get("lists", F.lit(0)), F.array_intersect)) == 0
    by_row = found.groupBy("doc", "row", "value").agg(F.bool_or("same").alias("same"), F.collect_list("open").alias("lists"))
    judged = by_row.select(F.col("doc").alias("__d"), F.col("value").alias("__v"), (F.col("same") | whole).alias("__c")).groupBy("__d", "__v").agg(F.bool_or("__c").alias("__covered"))
    same_claim = (claims[doc_id].cast("string") == judged["__d"]) & (claims["value"] == judged["__v"])
    return claims.join(judged, same_claim, "left").withColumn("covered", F.coalesce("__covered", F.lit(False))).drop("__d", "__v", "__covered")

"""Redacted views: texts with spans replaced by short-lived tokens, and maps of positions that lead there and back.

A map is an array of regions (view_start, view_end, start, end): what stands in
the view, and what it replaces in the source.  Between regions both texts are
the same.  Maps compose, so a view of a view has one map to the first source.
Everything is an expression on one row.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

REGION = "struct<view_start:int,view_end:int,start:int,end:int>"
_REGIONS = pa.list_(pa.struct([(n, pa.int32()) for n in ("view_start", "view_end", "start", "end")]))


def view_prefix(category: str | None) -> str:
    """Prefix of a view's token: a slug of the category that begins with a letter."""
    slug = "_".join("".join(c if c in "abcdefghijklmnopqrstuvwxyz0123456789" else " " for c in (category or "").lower()).split())
    return f"mask_{slug}" if slug[:1].isalpha() else "mask_deger"


def redact(text: str, spans: list[tuple[int, int, str | None]]) -> tuple[str, list[dict[str, int]]]:
    """The view and its regions; spans that overlap become one under the first one's category, equal values share a token."""
    whole: list[list] = []
    for start, end, category in sorted((s for s in spans if 0 <= s[0] < s[1] <= len(text)), key=lambda s: (s[0], s[1], s[2] or "")):
        if whole and start < whole[-1][1]:
            whole[-1][1] = max(whole[-1][1], end)
        else:
            whole.append([start, end, category])
    tokens: dict[str, str] = {}
    counts: dict[str, int] = {}
    pieces, regions, at, length = [], [], 0, 0
    for start, end, category in whole:
        value = text[start:end]
        if value not in tokens:
            prefix = view_prefix(category)
            counts[prefix] = counts.get(prefix, 0) + 1
            tokens[value] = f"{prefix}_{counts[prefix]}"
        pieces += [text[at:start], tokens[value]]
        begin = length + start - at
        length = begin + len(tokens[value])
        regions.append({"view_start": begin, "view_end": length, "start": start, "end": end})
        at = end
    return "".join([*pieces, text[at:]]), regions


def redacted(docs: DataFrame, spans: str = "spans", text: str = "text", out: str = "view", regions: str = "regions") -> DataFrame:
    """``docs`` with the view and its regions; ``spans``: array<struct<start, end, category>>.  A null text is an empty one, null spans are none."""
    fields = [f for f in docs.schema if f.name not in (out, regions)]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in fields), f"`{out}` string", f"`{regions}` array<{REGION}>"])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bodies, found = batch.column(batch.schema.get_field_index(text)).to_pylist(), batch.column(batch.schema.get_field_index(spans)).to_pylist()
            made = [redact(b or "", [(s["start"], s["end"], s["category"]) for s in f or []]) for b, f in zip(bodies, found, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([m[0] for m in made], pa.string()), pa.array([m[1] for m in made], _REGIONS)], [*batch.schema.names, out, regions])

    return docs.select(*(f"`{f.name}`" for f in fields)).mapInArrow(scan, schema)


def hidden_chars(regions: Column) -> Column:
    """How many signs of the source the view does not show."""
    return F.aggregate(regions, F.lit(0).cast("long"), lambda a, r: a + r["end"] - r["start"])


def to_source(regions: Column, start: Column, end: Column) -> Column:
    """struct<start, end> in the source of a span of the view; null if the span touches a token."""
    touches = F.exists(regions, lambda r: (r["view_start"] < end) & (r["view_end"] > start))
    shift = F.aggregate(regions, F.lit(0), lambda a, r: F.when(r["view_end"] <= start, r["end"] - r["view_end"]).otherwise(a))
    return F.when(~touches, F.struct((start + shift).cast("int").alias("start"), (end + shift).cast("int").alias("end")))


def _view_position(regions: Column, at: Column) -> Column:
    def step(a: Column, r: Column) -> Column:
        inside = F.when(at == r["start"], r["view_start"]).otherwise(r["view_end"])
        return F.when(at < r["start"], a).when(at < r["end"], inside).otherwise(at - (r["end"] - r["view_end"]))

    return F.aggregate(regions, at.cast("int"), lambda a, r: step(a, r).cast("int"))


def to_view(regions: Column, start: Column, end: Column) -> Column:
    """struct<start, end> in the view of a span of the source; limits inside a replaced span move to the token's limits."""
    return F.struct(_view_position(regions, start).alias("start"), _view_position(regions, end).alias("end"))


def compose(first: list[dict[str, int]], second: list[dict[str, int]]) -> list[dict[str, int]]:
    """The map to the source of a view (``second``) of a view (``first``).

    Tokens of the first view and spans that the second replaces become one region
    if they share a sign, so what is left of a token that was cut belongs to the
    region too.
    """
    # In the first view: what stands there instead of the source, and what goes on to the second view.
    inner = [(r["view_start"], r["view_end"], r["end"] - r["view_end"], None) for r in first]
    outer = [(r["start"], r["end"], None, r["view_end"] - r["end"]) for r in second]
    out: list[dict[str, int]] = []
    to_source = to_view = 0
    high = -1
    for low, end, source, view in sorted(inner + outer, key=lambda x: x[:2]):
        if not out or low >= high:
            out.append({"view_start": low + to_view, "view_end": 0, "start": low + to_source, "end": 0})
            high = end
        high = max(high, end)
        to_source, to_view = to_source if source is None else source, to_view if view is None else view
        out[-1]["view_end"], out[-1]["end"] = high + to_view, high + to_source
    return out


def composed(docs: DataFrame, first: str, second: str, out: str = "regions") -> DataFrame:
    """``docs`` with one map in place of two: that of a view, and that of a view of it."""
    fields = [f for f in docs.schema if f.name != out or out in (first, second)]
    keep = [f for f in fields if f.name != out]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in keep), f"`{out}` array<{REGION}>"])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            one, two = (batch.column(batch.schema.get_field_index(n)).to_pylist() for n in (first, second))
            made = pa.array([compose(a or [], b or []) for a, b in zip(one, two, strict=True)], _REGIONS)
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(f.name)) for f in keep), made], [*(f.name for f in keep), out])

    return docs.select(*(f"`{f.name}`" for f in fields)).mapInArrow(scan, schema)

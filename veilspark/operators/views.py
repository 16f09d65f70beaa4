"""Views of a text as a reader sees it, with the way back to the source: escapes and references decoded, look-alike letters made plain."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame

_DECODE = re.compile(r"\\u([0-9a-fA-F]{4})|&(?:#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]{1,30});")
_HIDDEN = frozenset("\u00ad\u200b\u200c\u200d\u200e\u200f\u2060\ufeff")
# Letters of other alphabets that look like Latin ones.
ALIKE = str.maketrans("АВЕКМНОРСТХаеорсухіј", "ABEKMHOPCTXaeopcyxij")


def search_view(text: str) -> tuple[str, list[tuple[int, int]]]:
    """The decoded text, and the span in the source of each of its signs."""
    out, spans, at = [], [], 0
    for m in _DECODE.finditer(text):
        _plain(text, at, m.start(), out, spans)
        value = chr(int(m[1], 16)) if m[1] else unescape(m[0])
        if value == m[0]:
            _plain(text, m.start(), m.end(), out, spans)
        else:
            for c in value.translate(ALIKE):
                out.append(c)
                spans.append((m.start(), m.end()))
        at = m.end()
    _plain(text, at, len(text), out, spans)
    return "".join(out), spans


def _plain(text: str, start: int, end: int, out: list[str], spans: list[tuple[int, int]]) -> None:
    at = start
    while at < end:
        stop = at + 1
        while stop < end and unicodedata.combining(text[stop]):
            stop += 1
        cluster = "".join(c for c in text[at:stop] if c not in _HIDDEN)
        for c in unicodedata.normalize("NFKC", cluster).translate(ALIKE) if cluster else "":
            out.append(c)
            spans.append((at, stop))
        at = stop


def compact_view(text: str) -> tuple[str, list[tuple[int, int]]]:
    """Folded, with letters and digits only; placeholders are gaps that nothing spans."""
    view, spans = search_view(text)
    kept, places = [], []
    blocked = [(m.start(), m.end()) for m in re.finditer(r"mask_[a-z0-9_]+?_[0-9]+", view)]
    for i, c in enumerate(view):
        if any(a <= i < b for a, b in blocked):
            if kept and kept[-1] != "\0":
                kept.append("\0")
                places.append(spans[i])
            continue
        for f in c.casefold().replace("\u0307", "").translate(str.maketrans("ışğçöü", "isgcou")):
            if f.isalnum():
                kept.append(f)
                places.append(spans[i])
    return "".join(kept), places


def find_in_view(text: str, pattern: str, flags: int = 0) -> list[tuple[int, int, str]]:
    """Matches of a pattern in the search view, as spans and values of the source."""
    view, spans = search_view(text)
    return [(a, b, text[a:b]) for m in re.finditer(pattern, view, flags) if m.end() > m.start() for a, b in [(spans[m.start()][0], spans[m.end() - 1][1])]]


def find_compact(text: str, needles: list[str]) -> list[tuple[int, int, str]]:
    """Needles (folded) in the compact view, longest first and without overlaps, as spans of the source with the needle."""
    view, spans = compact_view(text)
    taken: list[tuple[int, int, str]] = []
    for needle in sorted(set(needles), key=lambda n: (-len(n), n)):
        at = view.find(needle)
        while needle and at >= 0:
            a, b = spans[at][0], spans[at + len(needle) - 1][1]
            if all(b <= x or a >= y for x, y, _ in taken):
                taken.append((a, b, needle))
            at = view.find(needle, at + 1)
    return sorted(taken)


def view_findings(docs: DataFrame, pattern: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, start, end, value) of a pattern in the search view of each text.

    Texts without an escape, reference or sign outside ASCII are their own view,
    so a caller may look for these with built-in expressions alone.
    """
    kind = docs.schema[doc_id].dataType.simpleString()

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(d, *f) for d, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for f in find_in_view(t or "", pattern)]
            types = (batch.schema.field(0).type, pa.int32(), pa.int32(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], [doc_id, "start", "end", "value"])

    return docs.select(doc_id, text).mapInArrow(find, f"`{doc_id}` {kind}, start int, end int, value string")

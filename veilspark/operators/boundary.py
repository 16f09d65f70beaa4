"""Where a span may begin and end in source text: strings, comments and tokens.

A lexical index of a text lists its strings and comments; it comes from one
Arrow pass over the rows that need it.  Spans in a string grow to its content,
spans in a comment or in code to their token, and what would tear a call,
attribute or pair of brackets apart is rejected.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame

# Comment signs by suffix.
HASH = frozenset((".py", ".sh", ".rb", ".pl", ".ps1", ".php", ".yaml", ".yml", ".toml", ".properties", ".ini"))
SLASH = frozenset((".java", ".cs", ".js", ".ts", ".jsx", ".tsx", ".c", ".h", ".cpp", ".hpp", ".go", ".rs", ".kt", ".swift", ".scala", ".php", ".css", ".groovy"))
DASH = frozenset((".sql", ".lua"))
MARKUP = frozenset((".xml", ".html", ".htm", ".xhtml", ".svg", ".resx"))
OVERSHOOT = 200
_TOKEN = re.compile(r"[\w.@:/%+\-]+", re.U)


class Part(NamedTuple):
    kind: str
    start: int
    end: int


def lexical_index(text: str, suffix: str = "") -> list[Part]:
    """Strings (their content) and comments of a text, by start; apostrophes inside words open no string."""
    line = [s for s, on in (("#", suffix in HASH), ("//", suffix in SLASH), ("--", suffix in DASH)) if on]
    block = ("/*", "*/") if suffix in SLASH or suffix == ".sql" else ("<!--", "-->") if suffix in MARKUP else None
    triple = suffix == ".py"
    multi = suffix in (".js", ".ts", ".jsx", ".tsx", ".go", ".kt", ".scala")
    out: list[Part] = []
    i, n = 0, len(text)
    while i < n:
        c = text[i]
        if block and text.startswith(block[0], i):
            end = text.find(block[1], i + len(block[0]))
            end = n if end < 0 else end + len(block[1])
            out.append(Part("comment", i, end))
            i = end
        elif any(text.startswith(s, i) for s in line):
            end = text.find("\n", i)
            end = n if end < 0 else end
            out.append(Part("comment", i, end))
            i = end
        elif c in "\"'" or c == "`" and multi:
            if c == "'" and i and text[i - 1].isalnum() and (i + 1 < n and text[i + 1].isalpha()):
                i += 1
                continue
            fence = c * 3 if triple and text.startswith(c * 3, i) else c
            j = i + len(fence)
            while j < n and not text.startswith(fence, j):
                if text[j] == "\\" and suffix:
                    j += 1
                elif text[j] == "\n" and len(fence) == 1 and c != "`":
                    break
                j += 1
            if j < n and text.startswith(fence, j):
                out.append(Part("string", i + len(fence), j))
                i = j + len(fence)
            else:
                i += len(fence)
        else:
            i += 1
    return out


def token_at(text: str, start: int, end: int) -> tuple[int, int]:
    """The span grown to whole tokens at both ends."""
    while start > 0 and _TOKEN.fullmatch(text[start - 1]) and _TOKEN.match(text[start]):
        start -= 1
    while end < len(text) and _TOKEN.fullmatch(text[end]) and _TOKEN.match(text[end - 1]):
        end += 1
    return start, end


def balanced(value: str) -> bool:
    pairs, open_ = {")": "(", "]": "[", "}": "{"}, []
    for c in value:
        if c in "([{":
            open_.append(c)
        elif c in pairs and (not open_ or open_.pop() != pairs[c]):
            return False
    return not open_


def bounded(text: str, index: list[Part], start: int, end: int, corporate: bool = False, dictionary: bool = False) -> tuple[int, int, str | None]:
    """(start, end, reason): the allowed span for a finding, or the reason for its rejection."""
    if not re.search(r"\w", text[start:end]):
        return start, end, "no_alnum"
    holder = next((p for p in index if p.start <= start and end <= p.end), None)
    if holder and holder.kind == "string":
        if corporate:
            return (*token_at(text, start, end), None)
        if (holder.end - holder.start) - (end - start) <= OVERSHOOT:
            return holder.start, holder.end, None
        return (*token_at(text, start, end), None)
    cut = next((p for p in index if p.kind == "string" and p.start > start and p.end < end), None)
    if cut and not holder:
        return cut.start, cut.end, None  # an assignment: its quoted value
    a, b = token_at(text, start, end)
    if "\n" in text[a:b] and "\n" not in text[start:end]:
        return start, end, "multi_line"
    if not holder and not dictionary:
        if text[b : b + 1] == "(" or a > 0 and text[a - 1] == "." or not balanced(text[a:b]):
            return start, end, "structure"
    return a, b, None


def bound(docs: DataFrame, findings: str = "findings", text: str = "text", suffix: str = "suffix", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, ord, start, end, value, reason) of findings after the limits of strings, comments and tokens."""
    kind = docs.schema[doc_id].dataType.simpleString()

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: tuple[list, ...] = ([], [], [], [], [], [])
            for d, body, s, found in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if not found:
                    continue
                body = body or ""
                index = lexical_index(body, s or "")
                for f in found:
                    a, b, reason = bounded(body, index, f["start"], f["end"], f["source"] == "corporate", f["source"] == "dictionary")
                    for x, v in zip(out, (d, f["ord"], a, b, body[a:b], reason), strict=True):
                        x.append(v)
            types = (batch.schema.field(0).type, pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, types, strict=True)], [doc_id, "ord", "start", "end", "value", "reason"])

    return docs.select(doc_id, text, suffix, findings).mapInArrow(check, f"`{doc_id}` {kind}, ord int, start int, end int, value string, reason string")

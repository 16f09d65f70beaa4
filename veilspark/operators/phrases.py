"""Values and terms of any number of words in texts: candidates by the rarest word, then a walk over the words with a trie.

A phrase is looked for only in texts that hold its rarest word.  The words of the
texts meet the words of the phrases in a join, which also counts in how many
texts each of them stands; each phrase then hangs on its rarest word alone, so a
large dictionary is dealt out by rare words and a frequent word brings no
candidates unless a phrase has no rarer one.  A text that has candidates is read
once more: a trie of them is walked over its words from every place.

Texts and phrases are normalised alike (NFKC and case folding, or folded as
Turkish), and spans are those of the source.  Nothing is collected; a dictionary
is broadcast only if Spark finds it small.
"""

from __future__ import annotations

import re
from bisect import bisect_left, insort
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilspark.functions.align import WORD, aligned, folded, inner_limits, stops_after, wordings, words_of
from veilspark.functions.arrays import sliced
from veilspark.operators import rows
from veilspark.operators.rules import OLD_PLACEHOLDER, PLACEHOLDER
from veilspark.sources.shared import stored

_TOKEN = re.compile(rf"(?<![A-Za-z0-9_])(?:{PLACEHOLDER}|{OLD_PLACEHOLDER})(?![A-Za-z0-9_])")
_END = "\0end"


def _words(df: DataFrame, key: str, text: str, longest: int, turkish: bool) -> DataFrame:
    """(key, word) of the different words of texts, of ``longest`` signs at most where one holds others."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 1):
            lists = pa.array([list(dict.fromkeys(wordings(t or "", longest, turkish))) for t in batch.column(1).to_pylist()], pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pc.list_parent_indices(lists)), lists.flatten()], ["key", "word"])

    return df.select(F.col(key).alias("key"), F.col(text)).mapInArrow(scan, "key string, word string")


def phrase_table(values: DataFrame, value: str = "value", turkish: bool = False) -> DataFrame:
    """(value, phrase, words) of different values: their normalised form, and its words; values without letters and digits are left out."""
    distinct = values.where(F.col(value).isNotNull()).select(F.col(value).alias("value")).distinct()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(0).to_pylist()
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()), pa.array([folded(t, turkish) for t in texts], pa.string()), pa.array([words_of(t, turkish) for t in texts], pa.list_(pa.string()))], ["value", "phrase", "words"])

    return distinct.mapInArrow(scan, "value string, phrase string, words array<string>").where(F.size("words") > 0)


def candidates(docs: DataFrame, phrases: DataFrame, key: str, text: str, turkish: bool = False) -> DataFrame:
    """(key, phrases): for each text the phrases (phrase, words) whose rarest word it holds."""
    asked = phrases.select("phrase", "words", F.explode(F.array_distinct("words")).alias("word"))
    longest = asked.agg(F.max(F.length("word"))).first()[0] or 0
    hits = stored(_words(docs, key, text, longest, turkish).join(asked.select("word").distinct(), "word"), "hits")  # used twice
    counts = hits.groupBy("word").agg(F.count("*").alias("n"))
    anchors = asked.join(counts, "word", "left").groupBy("phrase", "words").agg(F.min_by("word", F.struct(F.coalesce("n", F.lit(0)), "word")).alias("word"))
    return hits.join(anchors, "word").groupBy("key").agg(F.collect_set(F.struct("phrase", "words")).alias("phrases"))


def _trie(phrases: list[dict]) -> dict:
    root: dict = {}
    for p in phrases:
        node = root
        for w in p["words"]:
            node = node.setdefault(w, {})
        node.setdefault(_END, []).append(p["phrase"])
    return root


def walk(text: str, phrases: list[dict], exact: bool, turkish: bool = False) -> list[tuple[int, int, str]]:
    """(start, end, phrase) of all places of phrases in a text.

    ``exact``: the signs between and around the words must be the phrase's own,
    and no letter, digit or underscore may touch it.  Otherwise words in a row
    are enough, whatever stands between them.
    """
    view, starts, ends = aligned(text, turkish)
    spans = [m.span() for m in WORD.finditer(view)]
    words = [view[a:b] for a, b in spans]
    inner = inner_limits(text, view, starts, ends, spans)
    root, out = _trie(phrases), []
    longest = max((len(w) for p in phrases for w in p["words"]), default=0)
    around: dict[str, tuple[int, int]] = {}

    def keep(node: dict | None, first: int, last: int) -> None:
        for phrase in node.get(_END, ()) if node else ():
            if phrase not in around:
                limits = [m.span() for m in WORD.finditer(phrase)]
                around[phrase] = (limits[0][0], len(phrase) - limits[-1][1])
            lead, trail = around[phrase] if exact else (0, 0)
            a, b = first - lead, last + trail
            if not exact or a >= 0 and view[a:b] == phrase:
                start, end = starts[a], ends[b - 1]
                whole = folded(text[start:end], turkish)  # no part of a sign that became several
                open_ = (start == 0 or not (text[start - 1].isalnum() or text[start - 1] == "_")) and (end == len(text) or not (text[end].isalnum() or text[end] == "_"))
                if whole == view[a:b] and (open_ or not exact):
                    out.append((start, end, phrase))

    for i in range(len(words)):
        if i not in inner and words[i] not in root:
            continue
        for first in (spans[i][0], *inner[i][0]) if i in inner else spans[i][:1]:
            node, j = root, i
            while node is not None and j < len(words):
                low, high = spans[j]
                at = max(first, low)
                for last in stops_after(inner[j][1], at, longest) if j in inner else ():
                    keep(node.get(view[at:last]), first, last)
                node = (node.get(words[j]) if at == low else node.get(view[at:high])) if high - at <= longest else None
                keep(node, first, high)
                j += 1
    return out


def chosen(found: list[tuple[int, int, str]], taken: list[tuple[int, int]]) -> list[tuple[int, int, str]]:
    """Of places that overlap the longest phrase, then the first; none that overlaps ``taken``."""
    out: list[tuple[int, int, str]] = []
    held = sorted(taken)
    for start, end, phrase in sorted(found, key=lambda f: (-len(f[2]), f[0], f[2])):
        if touches(held, start, end):
            continue
        insort(held, (start, end))
        out.append((start, end, phrase))
    return sorted(out)


def touches(held: list[tuple[int, int]], start: int, end: int) -> bool:
    """Whether one of the spans ``held`` (disjoint, by start) overlaps this one."""
    at = bisect_left(held, (end,))
    return at > 0 and held[at - 1][1] > start


def places(docs: DataFrame, values: DataFrame, doc_id: str = "doc_id", text: str = "text", value: str = "value", exact: bool = True, turkish: bool = False, every: bool = False) -> DataFrame:
    """(doc_id, row_key, start, end, value as it stands there, phrase) of known values in texts.

    Placeholders are left alone.  Of places that overlap the longest value's
    counts, or with ``every`` each one.  Equal rows give equal places; nulls and
    repeated ids are rows like others.  ``phrase`` is the value's normalised form.
    """
    own = rows.keyed(docs, text, doc_id)
    phrases = stored(phrase_table(values, value, turkish).select("phrase", "words").distinct(), "phrases")  # used twice
    some = candidates(own, phrases, rows.ROW, text, turkish)
    joined = own.select(F.col(doc_id).alias("doc_id"), rows.ROW, F.col(text).alias("text")).join(some, F.col(rows.ROW) == F.col("key")).select("doc_id", rows.ROW, "text", "phrases")
    kind = docs.schema[doc_id].dataType.simpleString()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 2):
            at, out = [], []
            for i, (body, asked) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)):
                masked = [m.span() for m in _TOKEN.finditer(body)]
                found = walk(body, asked, exact, turkish)
                found = [f for f in found if not touches(masked, f[0], f[1])] if every else chosen(found, masked)
                at += [i] * len(found)
                out += [(a, b, body[a:b], p) for a, b, p in found]
            take = pa.array(at, pa.int64())
            cols = [pa.array([r[k] for r in out], t) for k, t in enumerate((pa.int32(), pa.int32(), pa.string(), pa.string()))]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take), *cols], ["doc_id", rows.ROW, "start", "end", "value", "phrase"])

    return joined.mapInArrow(scan, f"doc_id {kind}, {rows.ROW} string, start int, end int, value string, phrase string")

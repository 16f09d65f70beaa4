"""Secret scan: patterns for known shapes, and a token-efficiency test for random strings.

Ordinary words cost a byte-pair vocabulary about one token for four characters;
a random string has no frequent substrings, so that it costs a token for about
one or two.  A run of key characters whose characters per token stay under
``max_ratio`` is reported as ``random``, unless it is a known digest (hex of a
digest's length, a sub-resource integrity value) or a UUID.  What could be an
identifier made of words and short numbers must stay under ``WORD_RATIO``, which
words do not.  Runs without letters are left out: digits cost a token for two to
three whether they are random or not, so the test tells nothing about numbers.

Nulls: a null text is empty and has no spans.  Ties: spans that start together
are ordered as the kinds are listed.  Repeated rows are scanned alike.  Nothing
is shuffled: each text is judged alone, wholly, in the task that read it.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
import tiktoken
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilspark.llm.common import fresh, sliced, texts_of

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
KINDS = ("assign", "access", "hex", "random")
MIN_RANDOM, MAX_RATIO, WORD_RATIO = 16, 2.2, 1.8

_ASSIGN = re.compile(r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
#: The leftmost greedy runs of [0-9a-f] are maximal, so that the length can stand in the pattern.
_HEX = re.compile(r"[0-9a-f]{16,}")
_RUN = re.compile(rf"[A-Za-z0-9+/_=-]{{{MIN_RANDOM},}}")
_DIGEST = re.compile(r"(?i)(?:[0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{56}|[0-9a-f]{64}|[0-9a-f]{96}|[0-9a-f]{128}|sha(?:256|384|512)-[A-Za-z0-9+/]+=*)")
_UUID = re.compile(r"(?i)[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}")
_PART = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+|[^A-Za-z0-9]+")
_SPLIT = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_encodings: dict[str, tiktoken.Encoding] = {}


def encoding(vocabulary: str) -> tiktoken.Encoding:
    """The vocabulary file as an encoding, read once by each process."""
    if vocabulary not in _encodings:
        with open(vocabulary, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        _encodings[vocabulary] = tiktoken.Encoding("own", pat_str=_SPLIT, mergeable_ranks=ranks, special_tokens={})
    return _encodings[vocabulary]


def is_identifier(run: str) -> bool:
    """Words and short numbers joined by case, ``_``, ``-`` or ``/``: every part of letters has a vowel, numbers have four digits at most."""
    parts = _PART.findall(run)
    letters = [p for p in parts if p.isalpha()]
    return bool(letters) and sum(map(len, letters)) >= 3 * len(letters) and all(len(p) >= 2 and re.search("(?i)[aeiouy]", p) for p in letters) and all(len(p) <= 4 for p in parts if p.isdigit())


def is_random(run: str, encode: Callable[[str], list[int]], max_ratio: float = MAX_RATIO) -> bool:
    """Whether a run of key characters reads as a random string."""
    if not re.search("[A-Za-z]", run) or _DIGEST.fullmatch(run) or _UUID.fullmatch(run.strip("-_=/+")):
        return False
    return len(run) < (min(max_ratio, WORD_RATIO) if is_identifier(run) else max_ratio) * len(encode(run))


def secret_spans(text: str, encode: Callable[[str], list[int]], max_ratio: float = MAX_RATIO) -> list[tuple[int, int, int]]:
    """(start, kind's place in KINDS, end) of every secret in ``text``, sorted; code points, end exclusive."""
    found = []
    if ":" in text or "=" in text:
        found += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 12]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 18]
    found += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    found.sort()
    # Runs come from left to right, and so do the spans that may touch them.
    at, reached, more = 0, 0, []
    for m in _RUN.finditer(text):
        while at < len(found) and found[at][0] < m.end():
            reached = max(reached, found[at][2])
            at += 1
        if reached <= m.start() and is_random(m[0], encode, max_ratio):
            more.append((m.start(), 3, m.end()))
    return sorted(found + more)


def find_secrets(df: DataFrame, text: str = "text", out: str = "secrets", vocabulary: str = VOCABULARY, max_ratio: float = MAX_RATIO) -> DataFrame:
    """``df`` with a column ``out``: array<struct<kind, start, end>>, ordered by start, then kind.

    A column that already has the name of ``out`` is replaced.  ``vocabulary`` is
    read by each Python worker, so its path must exist on the workers.
    """
    df = df.drop(out)
    schema = f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in df.schema)}, `{out}` array<struct<kind:string,start:int,end:int>>"
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoding(vocabulary).encode_ordinary
        for batch in sliced(batches, text):
            spans = [[{"kind": KINDS[k], "start": s, "end": e} for s, k, e in secret_spans(t, encode, max_ratio)] for t in texts_of(batch, text)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(spans, kind)], [*batch.schema.names, out])

    return df.mapInArrow(scan, schema)


def spans_text(spans: Column) -> Column:
    """The spans as ``kind:start:end``, comma-joined."""
    return F.concat_ws(",", F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))))


def redacted(df: DataFrame, text: str = "text", vocabulary: str = VOCABULARY, mark: str = "[secret]") -> DataFrame:
    """``df`` with every secret in ``text`` replaced by ``mark``; overlapping spans become one mark, null stays null."""
    hidden = fresh("secrets", df.columns)
    found = find_secrets(df, text, hidden, vocabulary)
    whole, spans = F.col(f"`{text}`"), F.col(hidden)
    piece = F.struct(F.lit("").alias("done"), F.lit(0).alias("at"))
    rebuilt = F.aggregate(
        spans,
        piece,
        lambda acc, x: F.struct(
            F.when(x["start"] < acc["at"], acc["done"]).otherwise(F.concat(acc["done"], F.substring(whole, acc["at"] + 1, x["start"] - acc["at"]), F.lit(mark))).alias("done"),
            F.greatest(acc["at"], x["end"]).alias("at"),
        ),
        lambda acc: F.concat(acc["done"], F.substring(whole, acc["at"] + 1, F.length(whole))),
    )
    return found.withColumn(text, F.when(F.size(spans) > 0, rebuilt).otherwise(whole)).drop(hidden)

"""SentencePiece encoding and decoding as a weighted finite-state transducer.

The vocabulary file compiles into three machines: the normaliser (identity,
white space written as U+2581, a dummy prefix), the pieces as arcs over
characters, and byte fallback arcs for characters without a piece.  Composed
with a text they give a lattice, whose shortest path in the tropical semiring
(weights add along a path, the minimum wins) is the encoding.

For a unigram vocabulary the weight of an arc is the negative score of its
piece.  For a BPE vocabulary sums of scores give other ids than merging does, so
the lattice is composed with a second acceptor whose states are pieces: going
from piece a to piece b weighs 0 if merging the string ab gives just [a, b], and
infinity otherwise.  A sequence all of whose neighbours agree is what merging the
whole string gives, so exactly one path has a finite weight, and for each prefix
there is exactly one last piece; the search keeps that one only.

No piece of these vocabularies goes on into a U+2581 after another character
(this is checked when the file is compiled; otherwise a text is one segment), so
that a text's path is the concatenation of the paths of its segments.  The
distinct segments of a slice are looked up together in arrays of bounded size
that each worker keeps.

Nulls: a null text encodes to no ids and decodes to the empty text, with
round_trip true.  Nothing is shuffled.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame

from veilspark.llm.common import mixed, powers, sliced, texts_of

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
#: Segments whose paths a worker keeps (some 30 bytes each), and entries of its caches of parts and of neighbours.
CACHE, PARTS, JOINS = 1_000_000, 50_000, 300_000
#: Bytes of text in a step, which takes some hundred and fifty times as much for a moment.
SLICE = 1 << 19
_machines: dict[str, "Machine"] = {}


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """The (number, value) pairs of a serialised message: varints as int, the rest as bytes."""
    at = 0

    def varint() -> int:
        nonlocal at
        x = shift = 0
        while True:
            b = data[at]
            at += 1
            x |= (b & 127) << shift
            shift += 7
            if b < 128:
                return x

    while at < len(data):
        key = varint()
        if key & 7 == 0:
            yield key >> 3, varint()
        else:
            n = {1: 8, 5: 4}.get(key & 7) or varint()
            yield key >> 3, data[at : at + n]
            at += n


class Machine:
    """The composed transducer of one vocabulary file."""

    def __init__(self, model: str) -> None:
        with open(model, "rb") as f:
            parts = list(_fields(f.read()))
        trainer = dict(next((_fields(v) for k, v in parts if k == 2), ()))
        normal = dict(next((_fields(v) for k, v in parts if k == 3), ()))
        if normal.get(2) or not normal.get(5, 1):
            raise ValueError("only the identity normaliser with escaped white space is compiled")
        self.prefix, self.squeeze = bool(normal.get(3, 1)), bool(normal.get(4, 1))
        self.bpe = trainer.get(3, 1) == 2
        if not self.bpe and trainer.get(3, 1) != 1:
            raise ValueError("only BPE and unigram vocabularies have this form")
        p = sentencepiece.SentencePieceProcessor(model_file=model)
        n = p.get_piece_size()
        self.surface = [p.id_to_piece(i) for i in range(n)]
        special = [p.is_control(i) or p.is_unknown(i) or p.is_byte(i) or p.is_unused(i) for i in range(n)]
        self.ids = {s: i for i, s in enumerate(self.surface) if not special[i]}
        self.score = [p.get_score(i) for i in range(n)]
        self.unknown = p.unk_id()
        self.byte = {int(s[3:5], 16): i for i, s in enumerate(self.surface) if p.is_byte(i)}
        of_byte = {i: bytes([b]) for b, i in self.byte.items()}
        self.out = [of_byte.get(i, b"" if special[i] else s.replace(SPACE, " ").encode()) for i, s in enumerate(self.surface)]
        self.longest = max(map(len, self.ids), default=1)
        self.crossing = crossing = any(SPACE in s.lstrip(SPACE) for s in self.ids)
        self.segments = re.compile("(?s).+" if crossing else f"(?s){SPACE}*[^{SPACE}]+|{SPACE}+")
        self.lowest = min(self.score, default=0.0)
        #: Neighbours that stand together in some piece: no piece spans any other two characters, so paths are cut there.
        self.inner = {s[i : i + 2] for s in self.ids for i in range(len(s) - 1)}
        #: Lengths of the pieces that end with given three characters (or are shorter), the longest first.
        self.lengths: dict[str, tuple[int, ...]] = {}
        for s in self.ids:
            if len(s) > 2:
                self.lengths[s[-3:]] = (*self.lengths.get(s[-3:], ()), len(s))
        self.lengths = {s: (*sorted(set(x), reverse=True), 2, 1) for s, x in self.lengths.items()}
        self.ends: dict[str, bool] = {}
        self.joins: dict[int, bool] = {}
        self.forget()
        self.pool = pa.array(self.out, pa.binary())
        self.parts: dict[str, list[int]] = {}

    def forget(self) -> None:
        """Empty the cache of segments: hashes, ascending, and where in ``paths`` the ids of each begin and how many there are."""
        self.known, self.begin, self.many = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.paths, self.filled = np.zeros(1 << 16, np.int32), 0

    def normalised(self, text: str) -> str:
        if self.squeeze:
            text = re.sub(" +", " ", text).strip(" ")
        if self.prefix and text:
            text = " " + text
        return text.replace(" ", SPACE)

    def merged(self, text: str) -> list[str]:
        """Pieces of a short string by merging, the best score first, then the leftmost: the definition of the acceptor's weights."""
        parts = list(text)
        if len(text) <= 32:
            get, score = self.ids.get, self.score
            while True:
                best, at = None, -1
                for i in range(len(parts) - 1):
                    if (k := get(parts[i] + parts[i + 1])) is not None and (best is None or score[k] > best):
                        best, at = score[k], i
                if best is None:
                    return parts
                parts[at : at + 2] = [parts[at] + parts[at + 1]]
        after = list(range(1, len(text) + 1))
        before, heap = list(range(-1, len(text) - 1)), []

        def offer(i: int) -> None:
            if i >= 0 and after[i] < len(parts) and (k := self.ids.get(parts[i] + parts[after[i]])) is not None:
                heapq.heappush(heap, (-self.score[k], i, len(parts[i]), len(parts[after[i]])))

        for i in range(len(parts) - 1):
            offer(i)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i]
            if j >= len(parts) or len(parts[i]) != a or len(parts[j]) != b or not a or not b:
                continue
            parts[i] += parts[j]
            parts[j] = ""
            after[i] = after[j]
            if after[i] < len(parts):
                before[after[i]] = i
            offer(before[i])
            offer(i)
        return [x for x in parts if x]

    def agree(self, a: int, b: int) -> bool:
        """Whether pieces a and b stay apart when their strings are merged together: weight 0, else infinity."""
        key = a << 32 | b
        if (known := self.joins.get(key)) is None:
            if len(self.joins) > JOINS:
                self.joins.clear()
            known = self.joins[key] = self.merged(self.surface[a] + self.surface[b]) == [self.surface[a], self.surface[b]]
        return known

    def whole(self, piece: str) -> bool:
        """Whether merging a piece's own string gives that piece."""
        if (known := self.ends.get(piece)) is None:
            if len(self.ends) > JOINS:
                self.ends.clear()
            known = self.ends[piece] = self.merged(piece) == [piece]
        return known

    def fallback(self, char: str) -> list[int]:
        return [self.byte[b] for b in char.replace(SPACE, " ").encode()] if self.byte else [self.unknown]

    def path(self, segment: str) -> list[int]:
        """The shortest path through the lattice of one segment, as ids."""
        inner, out, start = self.inner, [], 0
        for at in range(1, len(segment)):
            if segment[at - 1 : at + 1] not in inner:
                out += self._part(segment[start:at])
                start = at
        return out + self._part(segment[start:])

    def _part(self, part: str) -> list[int]:
        if (known := self.parts.get(part)) is None:
            known = self._bpe_path(part) if self.bpe else self._unigram_path(part)
            if len(part) <= 64:
                if len(self.parts) >= PARTS:
                    self.parts.clear()
                self.parts[part] = known
        return known

    def _bpe_path(self, segment: str) -> list[int]:
        if (i := self.ids.get(segment)) is not None and self.whole(segment):
            return [i]
        get, joins, agree, whole, lengths = self.ids.get, self.joins.get, self.agree, self.whole, self.lengths.get
        n = len(segment)
        last = [-1] * (n + 1)  # the last piece of the finite path to each state; -1: byte fallback, or the start
        length = [0] * (n + 1)
        for end in range(1, n + 1):
            for size in lengths(segment[end - 3 : end], (2, 1)) if end > 2 else (2, 1)[2 - end :]:
                start = end - size
                if start < 0:
                    continue
                i = get(segment[start:end])
                if i is None:
                    continue
                before = last[start]
                if before < 0:
                    ok = whole(segment[start:end])
                elif (ok := joins(before << 32 | i)) is None:
                    ok = agree(before, i)
                if ok:
                    last[end], length[end] = i, size
                    break
            else:  # a character without a piece: only fallback leads on
                if get(segment[end - 1]) is None:
                    length[end] = 1
        out, end = [], n
        while end:
            start = end - length[end]
            if start == end:
                raise ValueError("no finite path")
            out.append([last[end]] if last[end] >= 0 else self.fallback(segment[start:end]))
            end = start
        return [i for x in reversed(out) for i in x]

    def _unigram_path(self, segment: str) -> list[int]:
        n = len(segment)
        best: list[tuple[float, int, int]] = [(0.0, 0, -1)] + [(float("inf"), 0, -1)] * n
        for start in range(n):
            weight = best[start][0]
            for end in range(start + 1, min(n, start + self.longest) + 1):
                if (i := self.ids.get(segment[start:end])) is not None and weight - self.score[i] < best[end][0]:
                    best[end] = (weight - self.score[i], start, i)
            if self.ids.get(segment[start]) is None and weight - self.lowest + 10 < best[start + 1][0]:
                best[start + 1] = (weight - self.lowest + 10, start, -1)
        out, end = [], n
        while end:
            _, start, i = best[end]
            out.append([i] if i >= 0 else self.fallback(segment[start:end]))
            end = start
        return [i for x in reversed(out) for i in x]

    def encode(self, text: str) -> np.ndarray:
        """The ids of one text, without the cache of segments."""
        return np.array([i for s in self.segments.findall(self.normalised(text)) for i in self.path(s)], np.int32)

    def _learn(self, hashes: np.ndarray, segments: list[str]) -> None:
        """Add the paths of new segments to the cache."""
        if len(self.known) + len(hashes) > CACHE:
            self.forget()
        found = [self.path(s) for s in segments]
        many = np.fromiter(map(len, found), np.int64, len(found))
        flat = np.fromiter((i for x in found for i in x), np.int32, int(many.sum()))
        if self.filled + len(flat) > len(self.paths):
            self.paths = np.concatenate([self.paths[: self.filled], np.zeros(len(flat) + self.filled // 2 + (1 << 16), np.int32)])
        self.paths[self.filled : self.filled + len(flat)] = flat
        at = np.searchsorted(self.known, hashes)
        self.begin = np.insert(self.begin, at, self.filled + np.cumsum(many) - many)
        self.many = np.insert(self.many, at, many)
        self.known = np.insert(self.known, at, hashes)
        self.filled += len(flat)

    def encode_all(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The ids of all texts in order, how many each has, and whether they decode to it.

        Segments are looked up by 64-bit hashes, distinct ones once; a text whose
        ids do not give it back (a clash, or characters without a piece) is
        encoded again without the cache.
        """
        plain = [not self.crossing and SPACE not in t for t in texts]
        own = [self.normalised(t).replace(SPACE, " ").encode() if ok else b"" for t, ok in zip(texts, plain, strict=True)]
        data = np.frombuffer(b"".join(own), np.uint8)
        sizes = np.fromiter(map(len, own), np.int64, len(own))
        ends = np.cumsum(sizes)
        head = np.zeros(len(data) + 1, bool)
        head[1:-1] = (data[1:] == 32) & (data[:-1] != 32)
        head[ends - sizes] = True
        starts = np.flatnonzero(head[:-1])
        stops = np.append(starts[1:], len(data))
        up, down = powers(len(data) + 1)
        sums = np.zeros(len(data) + 1, np.uint64)
        with np.errstate(over="ignore"):
            np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=sums[1:])
            hashes = mixed((sums[stops] - sums[starts]) * down[starts] + (stops - starts).astype(np.uint64))
        distinct, first, place = np.unique(hashes, return_index=True, return_inverse=True)
        new = np.ones(len(distinct), bool)
        if len(self.known):
            new = self.known[np.minimum(np.searchsorted(self.known, distinct), len(self.known) - 1)] != distinct
        if new.any():
            if len(self.known) + int(new.sum()) > CACHE:
                self.forget()
                new[:] = True
            self._learn(distinct[new], [bytes(data[a:b]).decode().replace(" ", SPACE) for a, b in zip(starts[first[new]], stops[first[new]], strict=True)])
        at = np.searchsorted(self.known, distinct)
        many, begin = self.many[at][place], self.begin[at][place]
        before = np.cumsum(many) - many
        flat = self.paths[np.repeat(begin - before, many) + np.arange(int(many.sum()))] if len(many) else np.zeros(0, np.int32)
        totals = np.append(np.cumsum(many), 0)  # the last entry serves texts before the first segment
        upto = totals[np.searchsorted(starts, ends, "left") - 1]
        n_ids = np.diff(upto, prepend=0)
        same = self._gives(flat, upto, own)
        again = [i for i, (ok, good) in enumerate(zip(plain, same, strict=True)) if not (ok and good)]
        if again:
            parts = np.split(flat, upto[:-1])
            for i in again:
                parts[i] = self.encode(texts[i])
                n_ids[i] = len(parts[i])
                same[i] = self.decode(parts[i].tolist()) == self.expected(texts[i])
            flat = np.concatenate(parts)
        return flat, n_ids, same

    def _gives(self, flat: np.ndarray, upto: np.ndarray, own: list[bytes]) -> np.ndarray:
        """Whether the ids up to each end decode to the bytes of each text, its prefix included."""
        surface = self.pool.take(pa.array(flat))
        offsets = np.frombuffer(surface.buffers()[1], np.int32)[: len(flat) + 1] if len(flat) else np.zeros(1, np.int32)
        out = surface.buffers()[2].to_pybytes() if len(flat) else b""
        cuts = [0, *offsets[upto].tolist()]
        return np.fromiter((out[a:b] == t for a, b, t in zip(cuts, cuts[1:], own, strict=False)), bool, len(own))

    def expected(self, text: str) -> str:
        """What the ids of a text decode to, if every character has a piece."""
        return re.sub(" +", " ", text).strip(" ") if self.squeeze else text

    def decode(self, ids: list[int]) -> str:
        out = self.out
        text = b"".join([out[i] for i in ids]).decode("utf-8", "replace")
        return text[1:] if self.prefix and text.startswith(" ") else text


def machine(model: str) -> Machine:
    """The compiled vocabulary, one for each process."""
    if model not in _machines:
        _machines[model] = Machine(model)
    return _machines[model]


def encode(df: DataFrame, text: str = "text", model: str = MODEL) -> DataFrame:
    """``df`` with ids array<int>, n_tokens and round_trip (decoding gives the text back); such columns are replaced.

    With a vocabulary whose normaliser changes texts, round_trip compares with
    the normalised text.
    """
    added = ["ids", "n_tokens", "round_trip"]
    df = df.drop(*added)
    names = df.columns
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema) + ", ids array<int>, n_tokens bigint, round_trip boolean"

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = machine(model)
        for batch in sliced(batches, text, SLICE):
            flat, sizes, same = m.encode_all(texts_of(batch, text))
            offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat)), pa.array(sizes), pa.array(same)], [*names, *added])

    return df.mapInArrow(scan, schema)


def decode(df: DataFrame, ids: str = "ids", out: str = "decoded", model: str = MODEL) -> DataFrame:
    """``df`` with the text of a column of ids; null ids give the empty text, ids outside the vocabulary nothing."""
    df = df.drop(out)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema) + f", `{out}` string"

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = machine(model)
        n = len(m.out)
        for batch in batches:
            texts = [m.decode([i for i in x or () if i is not None and 0 <= i < n]) for x in batch.column(batch.schema.get_field_index(ids)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [*batch.schema.names, out])

    return df.mapInArrow(scan, schema)

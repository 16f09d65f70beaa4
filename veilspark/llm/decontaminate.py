"""Benchmark decontamination over a distributed positional inverted index.

The index is sharded by document, as in a search cluster: each slice of the
corpus keeps the postings (term, position) of the benchmark's terms for its own
documents, and every window of the benchmark is looked up in every shard.  A
lookup starts from the posting list of the window's rarest term, shifted by the
term's offset, and is intersected with the shifted lists of the other terms from
rare to frequent, so that a frequent word costs nothing unless all rarer words
of its window stand around it.  What is left after the last list is an exact
phrase.  A proximity match has seven tenths of a window's terms (windows of four
words and more) within ``slop`` words of their places in the same document; it
is sought from the terms that are rarest in the benchmark, as many as a match
cannot miss together, so that it depends on no other document.

The benchmark travels to the shards in blocks of at most ``block_words`` words,
which bounds what is broadcast; a larger benchmark takes more passes of the same
job.  Documents are never shuffled, so neither a hot source nor a passage that
many documents share weighs on one task.

Nulls: a null text has no words; a benchmark row with a null id or text is
skipped.  Repeated benchmark rows count once by id; repeated documents are
judged alike.  Empty tables give no rows, or documents without hits.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import IntegralType

from veilspark.llm.common import bytes_of, fresh, sliced

WINDOW, SLOP, BLOCK_WORDS = 10, 3, 2_000_000
#: Tenths of a window's terms that a proximity match must hold.
NEAR = 7
#: Words after A-Z have become a-z, on UTF-8 bytes: digits, letters, and all that is not ASCII.
WORD = re.compile(rb"[0-9a-z\x80-\xff]+")


@dataclass
class Block:
    """Windows of some benchmark items, as ids of terms."""

    terms: dict[bytes, int]
    windows: np.ndarray  # one row a window, ids of terms, -1 behind a short one
    lengths: np.ndarray
    ids: list  # of the items
    items: np.ndarray  # item of each window, by its place in ids
    rank: np.ndarray  # places of each window, terms that are rare in the block first, those behind a short one last


def _widened(benchmark: DataFrame, item_id: str) -> Column:
    """The ids of items; whole numbers of any width become long."""
    of = F.col(f"`{item_id}`")
    return of.cast("long") if isinstance(benchmark.schema[item_id].dataType, IntegralType) else of


def blocks_of(benchmark: DataFrame, item_id: str, text: str, window: int, block_words: int) -> Iterator[Block]:
    """Read the benchmark row by row and cut it into blocks of at most ``block_words`` words (or one item)."""

    def block(items: list[tuple[object, list[bytes]]]) -> Block:
        terms: dict[bytes, int] = {}
        known: dict[object, int] = {}
        rows, lengths, ids = {}, [], []
        for name, words in items:
            item = known.setdefault(name, len(known))
            own = [terms.setdefault(w, len(terms)) for w in words]
            for i in range(max(1, len(own) - window + 1)):
                cut = tuple(own[i : i + window])
                if (cut, item) not in rows:
                    rows[cut, item] = None
                    lengths.append(len(cut))
                    ids.append(item)
        table = np.full((len(rows), window), -1, np.int32)
        for i, (cut, _) in enumerate(rows):
            table[i, : len(cut)] = cut
        rarity = np.bincount(table[table >= 0], minlength=len(terms)) * (1 << 32) + np.fromiter(map(zlib.crc32, terms), np.int64, len(terms))
        rank = np.argsort(np.where(table >= 0, rarity[np.maximum(table, 0)], np.iinfo(np.int64).max), axis=1, kind="stable")
        return Block(terms, table, np.array(lengths, np.int64), list(known), np.array(ids, np.int64), rank)

    held, size = [], 0
    for row in benchmark.select(_widened(benchmark, item_id), F.col(f"`{text}`").cast("string")).toLocalIterator():
        if row[0] is None or not (words := WORD.findall((row[1] or "").encode().lower())):
            continue
        if held and size + len(words) > block_words:
            yield block(held)
            held, size = [], 0
        held.append((row[0], words))
        size += len(words)
    if held:
        yield block(held)


class Shard:
    """The positional index of one slice of documents, for the terms of one block."""

    def __init__(self, texts: list[bytes], terms: dict[bytes, int]) -> None:
        get, ids, counts = terms.get, [], []
        for t in texts:
            words = WORD.findall(t.lower())
            counts.append(len(words))
            ids += [get(w, -1) for w in words]
        self.ids = np.array(ids, np.int32)  # term at each position of the slice
        self.counts = np.array(counts, np.int64)
        self.doc = np.repeat(np.arange(len(texts)), self.counts)
        known = np.flatnonzero(self.ids >= 0)
        order = np.argsort(self.ids[known], kind="stable")
        self.postings = known[order]  # positions by term, then position
        self.first = np.searchsorted(self.ids[self.postings], np.arange(len(terms) + 1))
        self.df = np.diff(self.first)
        self.key = self.ids[self.postings].astype(np.int64) * (len(self.ids) + 1) + self.postings

    def has(self, term: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Whether a posting of each term lies between two positions, both included."""
        n = len(self.ids) + 1
        at = np.searchsorted(self.key, term.astype(np.int64) * n + np.maximum(low, 0))
        there = at < len(self.key)
        return there & (self.key[np.minimum(at, len(self.key) - 1)] <= term.astype(np.int64) * n + np.minimum(high, n - 1))

    def search(self, block: Block, slop: int, most: int = 1 << 21) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Windows and starts of exact phrases, and the documents and windows of proximity matches."""
        none = np.zeros(0, np.int64)
        if not len(self.postings) or not len(block.windows):
            return none, none, np.zeros((0, 2), np.int64)
        real = block.windows >= 0
        df = np.where(real, self.df[np.maximum(block.windows, 0)], np.iinfo(np.int64).max)
        alive = np.flatnonzero((df > 0).all(1))
        rank = np.argsort(df[alive], axis=1, kind="stable")  # places by rarity; those behind a short window come last
        rare = block.windows[alive, rank[:, 0]]
        sizes = self.df[rare]
        exact_w, exact_s = [none], [none]
        cuts = np.searchsorted(np.cumsum(sizes), np.arange(most, sizes.sum() + most, most), "right")
        start = 0
        for end in [*np.maximum(cuts, 1), len(alive)]:
            end = max(int(end), start)
            if end == start:
                continue
            n = sizes[start:end]
            row = np.repeat(np.arange(start, end), n)
            inner = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
            at = self.postings[self.first[rare[row]] + inner] - rank[row, 0]
            length = block.lengths[alive[row]]
            fits = (at >= 0) & (at + length <= len(self.ids))
            row, at, length = row[fits], at[fits], length[fits]
            same = self.doc[at] == self.doc[at + length - 1]
            row, at, length = row[same], at[same], length[same]
            left = np.arange(len(row))
            for k in range(1, block.windows.shape[1]):
                place = rank[row[left], k]
                wanted = block.windows[alive[row[left]], place]
                past = place >= length[left]
                left = left[past | (self.ids[np.minimum(at[left] + place, len(self.ids) - 1)] == wanted)]
            exact_w.append(alive[row[left]])
            exact_s.append(at[left])
            start = end
        return np.concatenate(exact_w), np.concatenate(exact_s), self.near(block, slop, most)

    def near(self, block: Block, slop: int, most: int) -> np.ndarray:
        """Documents and windows of proximity matches, whatever else the slice holds.

        A match misses ``spare`` terms at most, so it holds one of any spare + 1;
        these are the ones rarest in the block, and each of their places in a
        document is an alignment, which the other terms keep within ``slop``.
        """
        spare = block.lengths - -(-NEAR * block.lengths // 10)
        tried = [np.flatnonzero((block.lengths > 3) & (spare >= k)) for k in range(block.windows.shape[1])]
        anchor = np.repeat(np.arange(len(tried)), [len(t) for t in tried])
        window = np.concatenate(tried)
        sizes = self.df[block.windows[window, block.rank[window, anchor]]]
        anchor, window, sizes = anchor[sizes > 0], window[sizes > 0], sizes[sizes > 0]
        ends = np.cumsum(self.counts)
        begins = ends - self.counts
        found, start, sums = [np.zeros((0, 2), np.int64)], 0, np.cumsum(sizes)
        while start < len(window):
            end = max(start + 1, int(np.searchsorted(sums, (sums[start - 1] if start else 0) + most, "right")))
            n = sizes[start:end]
            row = np.repeat(np.arange(start, end), n)
            inner = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
            w = window[row]
            place = block.rank[w, anchor[row]]
            spot = self.postings[self.first[block.windows[w, place]] + inner]
            doc, at, missed = self.doc[spot], spot - place, np.zeros(len(row), np.int64)
            for k in range(block.windows.shape[1]):
                place = block.rank[w, k]
                low, high = np.maximum(at + place - slop, begins[doc]), np.minimum(at + place + slop, ends[doc] - 1)
                there = (low <= high) & self.has(block.windows[w, place], low, high)
                missed += ~there & (k < block.lengths[w])
                left = missed <= spare[w]
                w, doc, at, missed = w[left], doc[left], at[left], missed[left]
            found.append(np.unique(np.stack([doc, w], 1), axis=0))
            start = end
        return np.unique(np.concatenate(found), axis=0)


def runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True."""
    edges = np.flatnonzero(np.diff(mask.astype(np.int8), prepend=np.int8(0), append=np.int8(0)))
    return edges[::2], edges[1::2]


def contamination(documents: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, slop: int = SLOP, block_words: int = BLOCK_WORDS) -> DataFrame:
    """``documents`` with what of them the benchmark holds.

    Adds n_words, n_hit (words inside an occurrence of a window), n_near
    (windows with a proximity match only), items (an array of the distinct items
    with an occurring window, ascending; whole numbers are long) and hits array<struct<start, end>> (the
    maximal runs of hit words).  Columns of those names are replaced.
    """
    added = ["n_words", "n_hit", "n_near", "items", "hits"]
    documents = documents.drop(*added)
    session = documents.sparkSession.sparkContext
    names = documents.columns
    kind = benchmark.select(_widened(benchmark, item_id).alias("id")).schema["id"].dataType
    item_list = pa.list_(to_arrow_type(kind))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in documents.schema) + ", n_words bigint, n_hit bigint, n_near bigint, items array<" + kind.simpleString() + ">, hits array<struct<start:int,end:int>>"
    span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))

    def lookup(block_var, first: bool):
        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            block = block_var.value if block_var else Block({}, np.zeros((0, window), np.int32), np.zeros(0, np.int64), [], np.zeros(0, np.int64), np.zeros((0, window), np.int64))
            for batch in sliced(batches, text, 8 << 20):
                shard = Shard(bytes_of(batch, text), block.terms)
                n, ends = len(shard.counts), np.cumsum(shard.counts)
                begins = ends - shard.counts
                w, at, near = shard.search(block, slop)
                edge = np.zeros(len(shard.ids) + 1, np.int64)
                np.add.at(edge, at, 1)
                np.add.at(edge, at + block.lengths[w], -1)
                hit = np.cumsum(edge[:-1]) > 0
                found = np.unique(np.stack([shard.doc[at], block.items[w]], 1), axis=0) if len(w) else np.zeros((0, 2), np.int64)
                items: list[set] = [set() for _ in range(n)]
                for d, i in found.tolist():
                    items[d].add(block.ids[i])
                if len(w):
                    full = set(map(tuple, np.unique(np.stack([shard.doc[at], w], 1), axis=0).tolist()))
                    near = np.array([x for x in near.tolist() if tuple(x) not in full], np.int64).reshape(-1, 2)
                n_near = np.bincount(near[:, 0], minlength=n).astype(np.int64)
                if not first:  # what earlier blocks found
                    n_near += batch.column(names_of["n_near"]).to_numpy()
                    for d, (old, spans) in enumerate(zip(batch.column(names_of["items"]).to_pylist(), batch.column(names_of["hits"]).to_pylist(), strict=True)):
                        items[d].update(old)
                        for x in spans:
                            hit[begins[d] + x["start"] : begins[d] + x["end"]] = True
                total = np.concatenate([[0], np.cumsum(hit)])
                n_hit = total[ends] - total[begins]
                spans = []
                for d in range(n):
                    s, e = runs(hit[begins[d] : ends[d]]) if n_hit[d] else ((), ())
                    spans.append([{"start": int(x), "end": int(y)} for x, y in zip(s, e, strict=True)])
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns[: len(names)], pa.array(shard.counts), pa.array(n_hit.astype(np.int64)), pa.array(n_near), pa.array([sorted(x) for x in items], item_list), pa.array(spans, span)],
                    [*names, *added],
                )

        names_of = {c: len(names) + i for i, c in enumerate(added)}
        return scan

    out, first = documents, True
    for block in blocks_of(benchmark, item_id, item_text, window, block_words):
        out, first = out.mapInArrow(lookup(session.broadcast(block), first), schema), False
    return out if not first else out.mapInArrow(lookup(None, True), schema)


def items_digest(items: Column) -> Column:
    """sha256 of the ids, sorted as strings and comma-joined."""
    return F.sha2(F.concat_ws(",", F.array_sort(F.transform(items, lambda x: x.cast("string")))), 256)


def decontaminated(documents: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """The rows of ``documents`` that hold no window of the benchmark; their columns are as before."""
    hidden = {c: fresh(f"__{c}", documents.columns) for c in documents.columns if c in ("n_words", "n_hit", "n_near", "items", "hits")}
    kept = documents.withColumnsRenamed(hidden)
    kept = contamination(kept, benchmark, hidden.get(text, text)).where("n_hit = 0").drop("n_words", "n_hit", "n_near", "items", "hits")
    return kept.withColumnsRenamed({v: k for k, v in hidden.items()}).select(documents.columns)

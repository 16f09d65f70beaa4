"""Language-model scoring with a weighted backoff automaton over words.

Tokens are the words of a text (lower-cased A-Z) and one end.  The model is a
smoothed n-gram model of order 3 that learns from every training text and keeps
every n-gram, however rare.

*Automaton.*  States are the contexts that training texts hold (pairs, words, the
empty one), arcs the n-grams they hold.  The arc of an n-gram that occurred c
times after a context that occurred n times weighs ``log10((c + m * p) / (n + m))``,
where p is the probability of the shorter n-gram and m the mass of that order
(a hierarchy of Dirichlet priors).  A failure arc leads from a context to the one
without its first word and weighs ``log10(m / (n + m))``, so that the
probabilities of a state sum to one.  A text is read once from left to right: the
state is the longest context that is known, a token takes its arc, or failure
arcs until there is one, and the weights add up.  At the empty context every
token has an arc, the add-0.1 unigram model (which is also ``base_score``).

*Scale.*  The automaton grows with the corpus and is held by no machine.  Texts
are taken in blocks of about ``BLOCK`` bytes.  Each block deals its distinct
n-grams with their training counts to shards by the n-gram's hash (so no context
or word gathers in one task, and an n-gram has one row from each block at most);
shards add up and answer each block in its order; with the answers a block has
all states and arcs that its texts can reach, and reads them.  Words are told
apart by 64-bit hashes, longer n-grams by as many bits as leave a strange n-gram
the hash of a known one in less than one of 65,536 cases, and 48 at least.

Blocks are made twice, so ``docs`` must give its rows in the same order again, as
tables in files do; a block that differs raises an error.  Held-out texts are
those whose ``crc32(id as text) % folds`` is 0.  Nulls: a null text has no words
but its end; a null id counts as the empty text for the fold.  Repeated rows
count as often as they occur.  If nothing is left to learn from, every token has
probability 1 and no word is known.  A single text is never cut: it makes a block
of its own size.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilspark.llm.common import bytes_of, mixed, released, sliced, stored, trimmed, word_hashes

ORDER, ADD, FOLDS = 3, 0.1, 10
#: Mass of the shorter n-gram's probability, for pairs and for triples.
MASS = (300.0, 2.0)
#: Bytes of text of a block, and n-grams of a shard.
BLOCK, SHARD = 8 << 20, 1 << 20
END = np.uint64(0x5851F42D4C957F2D)
_FACTORS = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))


@dataclass
class Grams:
    """The n-grams of some texts, by order: distinct keys, where each first stands, and which one ends at each place (-1: the text is too short there)."""

    of: np.ndarray
    keys: list[np.ndarray]
    first: list[np.ndarray]
    place: list[np.ndarray]

    def packed(self) -> tuple[np.ndarray, np.ndarray]:
        """The keys of all orders, ascending, and their places in the concatenation of ``keys``."""
        whole = np.concatenate(self.keys)
        order = np.argsort(whole, kind="stable")
        return whole[order], order

    def counts(self, chosen: np.ndarray) -> list[np.ndarray]:
        """How often each key occurs at chosen places."""
        return [np.bincount(p[chosen & (p >= 0)], minlength=len(k)) for k, p in zip(self.keys, self.place, strict=True)]


def grams(texts: list[bytes], bits: int = 56) -> Grams:
    """All n-grams of the texts up to ``ORDER``; keys of order 1 are odd, others have their highest ``bits`` only."""
    rest = np.uint64(64 - bits)
    hashes, words = word_hashes(texts)
    sizes = words + 1
    of = np.repeat(np.arange(len(texts)), sizes)
    token = np.full(len(of), END, np.uint64)
    inside = np.ones(len(of), bool)
    inside[np.cumsum(sizes) - 1] = False
    token[inside] = hashes
    behind = np.arange(len(of)) - (np.cumsum(sizes) - sizes)[of]
    out = Grams(of, [], [], [])
    gram = token
    for k in range(ORDER):
        if k:
            with np.errstate(over="ignore"):
                longer = gram.copy()
                longer[1:] = mixed(gram[:-1] * _FACTORS[k - 1] + token[1:] + np.uint64(k))
            gram = longer
        at = np.flatnonzero(behind >= k)
        key = gram[at] | np.uint64(1) if k == 0 else gram[at] >> rest << rest
        keys, first, place = np.unique(key, return_index=True, return_inverse=True)
        out.keys.append(keys)
        out.first.append(at[first])
        whole = np.full(len(of), -1, np.int32)
        whole[at] = place
        out.place.append(whole)
    return out


@dataclass
class Automaton:
    """The states and arcs that some texts can reach: weights by n-gram; NaN where training texts hold none."""

    grams: Grams
    arc: list[np.ndarray]
    fail: list[np.ndarray]

    def score(self, texts: int) -> np.ndarray:
        """log10 of each text's probability: one walk over all texts at once, as the state after a token depends on the last two tokens only."""
        g = self.grams
        n = len(g.of)
        weight = np.zeros(n)
        open_ = np.ones(n, bool)
        for k in range(ORDER - 1, -1, -1):
            has = open_ & (g.place[k] >= 0)
            arc = np.full(n, np.nan)
            arc[has] = self.arc[k][g.place[k][has]]
            taken = ~np.isnan(arc)
            weight[taken] += arc[taken]
            open_ &= ~taken
            if k:  # no arc: if the context is a state, its failure arc is taken
                at = np.flatnonzero(open_ & (g.place[k] >= 0))
                fail = self.fail[k - 1][g.place[k - 1][at - 1]]
                weight[at] += np.where(np.isnan(fail), 0.0, fail)
        return np.bincount(g.of, weights=weight, minlength=texts)


def automaton(g: Grams, counts: list[np.ndarray], total: int, distinct: int, mass: tuple[float, ...] = MASS) -> Automaton:
    """Arcs and failure arcs from the training counts of the keys; total and distinct: training tokens and types."""
    p = [(counts[0] + ADD) / (total + ADD * (distinct + 1))]
    fail = []
    for k in range(1, ORDER):
        at = g.first[k]
        shorter = p[k - 1][g.place[k - 1][at]]
        context = counts[k - 1][g.place[k - 1][at - 1]]
        p.append(np.where(context > 0, (counts[k] + mass[k - 1] * shorter) / (context + mass[k - 1]), shorter))
        fail.append(np.where(counts[k - 1] > 0, np.log10(mass[k - 1] / (counts[k - 1] + mass[k - 1])), np.nan))
    arcs = [np.log10(p[0])] + [np.where(counts[k] > 0, np.log10(p[k]), np.nan) for k in range(1, ORDER)]
    return Automaton(g, arcs, fail)


# -- bytes for the shuffles ----------------------------------------------------------------------


def _planes(x: np.ndarray) -> bytes:
    """Numbers as compressed planes of bytes, so that high bytes of small numbers cost nothing."""
    data = np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T).tobytes()
    return len(data).to_bytes(8, "little") + pa.compress(data, codec="zstd", asbytes=True)


def _raw(data: bytes) -> bytes:
    return pa.decompress(data[8:], int.from_bytes(data[:8], "little"), codec="zstd", asbytes=True)


def _numbers(data: bytes, kind: type) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(_raw(data), np.uint8).reshape(size, -1).T).view(kind).ravel()


def _keys(data: bytes) -> np.ndarray:
    return np.cumsum(_numbers(data, np.uint64), dtype=np.uint64)


def _blocks(batches: Iterator[pa.RecordBatch], budget: int) -> Iterator[tuple[int, pa.Array, pa.Array, list[bytes]]]:
    """Number of the block, ids, whether held out, and texts; each partition's rows in order."""
    base = TaskContext.get().partitionId() << 32
    held: list[pa.RecordBatch] = []
    size = number = 0

    def whole() -> tuple[int, pa.Array, pa.Array, list[bytes]]:
        t = pa.Table.from_batches(held)
        return base + number, t["doc_id"].combine_chunks(), t["held_out"].combine_chunks(), [x for b in held for x in bytes_of(b, "text")]

    for batch in sliced(batches, "text", budget >> 2):
        held.append(batch)
        size += sum(map(len, bytes_of(batch, "text"))) + batch.num_rows
        if size >= budget:
            yield whole()
            held, size, number = [], 0, number + 1
    if held:
        yield whole()


def lm_scores(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", folds: int = FOLDS, mass: tuple[float, ...] = MASS, block_bytes: int = BLOCK, shard_grams: int = SHARD) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score and token_score (score by token) of every row of ``docs``.

    Other columns, whatever their names, are not read.
    """
    spark = docs.sparkSession
    kind = docs.schema[doc_id].dataType.simpleString()
    docs = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"), (F.crc32(F.coalesce(F.col(f"`{doc_id}`").cast("string"), F.lit(""))) % folds == 0).alias("held_out"))
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = int(size // 4 // shard_grams) + 1
    bits = min(62, max(48, int(size).bit_length() - 1 + 16))  # there are about half as many n-grams as bytes

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, _, held_out, texts in _blocks(batches, block_bytes):
            g = grams(texts, bits)
            train = ~held_out.to_numpy(zero_copy_only=False)[g.of]
            keys, order = g.packed()
            counts = np.concatenate(g.counts(train))[order].astype(np.uint32)
            del g
            shard = ((keys >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int64)
            cuts = np.searchsorted(shard, np.arange(shards + 1))
            used = np.flatnonzero(np.diff(cuts))
            packed = ([_planes(np.diff(keys[cuts[s] : cuts[s + 1]], prepend=np.uint64(0))) for s in used], [_planes(counts[cuts[s] : cuts[s + 1]]) for s in used])
            yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array([block] * len(used), pa.int64()), *(pa.array(x, pa.binary()) for x in packed)], ["shard", "block", "keys", "counts"])
            del texts, keys, order, counts, shard, packed
            trimmed()

    def answer(table: pa.Table) -> pa.Table:
        parts = [_keys(k.as_py()) for k in table["keys"]]
        keys = np.concatenate(parts)
        order = np.argsort(keys, kind="stable")
        new = np.concatenate([[True], keys[order[1:]] != keys[order[:-1]]])
        sums = np.add.reduceat(np.concatenate([_numbers(c.as_py(), np.uint32) for c in table["counts"]])[order].astype(np.int64), np.flatnonzero(new))
        word = (keys[order[new]] & np.uint64(1)).astype(bool)
        found = np.empty(len(keys), np.int64)
        found[order] = sums[np.cumsum(new) - 1]
        cuts = np.cumsum([0, *map(len, parts)])
        n = len(parts)
        return pa.table(
            {
                "block": pa.concat_arrays([*table["block"].chunks, pa.nulls(1, pa.int64())]), "shard": pa.concat_arrays([*table["shard"].chunks, table["shard"].chunk(0)[:1]]),
                "found": pa.array([*(_planes(found[a:b].view(np.uint64)) for a, b in zip(cuts, cuts[1:], strict=False)), None], pa.binary()),
                "tokens": pa.array([*[None] * n, int(sums[word].sum())], pa.int64()), "types": pa.array([*[None] * n, int((sums[word] > 0).sum())], pa.int64()),
            }
        )

    answers = stored(docs.mapInArrow(ask, "shard int, block bigint, keys binary, counts binary").groupBy("shard").applyInArrow(answer, "block bigint, shard int, found binary, tokens bigint, types bigint"), "answers")
    released(spark)
    sums = answers.agg(F.sum("tokens"), F.sum("types")).first()
    total, distinct = sums[0] or 0, sums[1] or 0

    def hold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, ids, held_out, texts in _blocks(batches, block_bytes):
            sizes = np.fromiter(map(len, texts), np.int64, len(texts))
            data = b"".join(texts)
            lists = [pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), x) for x in (ids, held_out)]
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.nulls(1, pa.int32()), pa.nulls(1, pa.binary()), *lists, pa.array([_planes(sizes)], pa.binary()), pa.array([len(data).to_bytes(8, "little") + pa.compress(data, codec="zstd", asbytes=True)], pa.binary())], ["block", "shard", "found", "ids", "held", "sizes", "texts"])

    def finish(table: pa.Table) -> pa.Table:
        own = table.filter(table["texts"].is_valid())
        given = table.filter(table["found"].is_valid()).sort_by("shard")["found"]
        ids, held_out = (own[c].combine_chunks().flatten() for c in ("ids", "held"))
        sizes, data = _numbers(own["sizes"][0].as_py(), np.int64), _raw(own["texts"][0].as_py())
        ends = np.cumsum(sizes)
        texts = [data[a:b] for a, b in zip((ends - sizes).tolist(), ends.tolist(), strict=True)]
        del data, own
        g = grams(texts, bits)
        keys, order = g.packed()
        found = np.concatenate([_numbers(x.as_py(), np.int64) for x in given])
        if len(found) != len(keys):
            raise ValueError("the rows of a block changed between two reads; write the table first")
        counts = np.empty(len(keys), np.int64)
        counts[order] = found
        del keys, order, found
        a = automaton(g, np.split(counts, np.cumsum([len(k) for k in g.keys])[:-1]), total, distinct, mass)
        n = len(texts)
        n_tokens = np.bincount(g.of, minlength=n)
        known = np.bincount(g.of, weights=counts[g.place[0]] > 0, minlength=n).astype(np.int64)
        base = np.bincount(g.of, weights=a.arc[0][g.place[0]], minlength=n)
        score = a.score(n)
        del a, g, counts, texts
        trimmed()
        return pa.table(
            {
                "doc_id": ids, "held_out": held_out, "n_tokens": pa.array(n_tokens), "n_known": pa.array(known), "train_tokens": pa.array(np.full(n, total, np.int64)),
                "base_score": pa.array(base), "score": pa.array(score), "token_score": pa.array(score / n_tokens),
            }
        )

    blocks = docs.mapInArrow(hold, f"block bigint, shard int, found binary, ids array<{kind}>, held array<boolean>, sizes binary, texts binary")
    back = answers.where("block is not null").select("block", "shard", "found", *(F.lit(None).cast(blocks.schema[c].dataType).alias(c) for c in ("ids", "held", "sizes", "texts")))
    return blocks.union(back).groupBy("block").applyInArrow(finish, f"doc_id {kind}, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double, token_score double")

"""Exact n-gram Jaccard join by PartEnum signatures.

Two sets link when ``100 * |A & B| >= 75 * |A | B|`` (the threshold is a
parameter).  Sets of sizes that can link lie in one size band or in neighbouring
bands, so each set is signed under its own band and the next one.  Under a band
the feature domain is cut into n parts by hash.

*Long bands.*  The difference |A ^ B| of linked sets is at most (|A|+|B|)/7 (for
75 %), and a part that differs holds at least one element of it.  n is so large
that a set has more parts with elements than that: by the pigeonhole some part
with elements is the same in both, and its content, with band and part, is the
signature.

*Short bands* (sets too small to count on that): some part with elements has a
local Jaccard of the threshold, for otherwise the differences would sum to more
than allowed.  A part of a elements is signed whole and with every subset of up
to a/4 of them left out, and two parts that are similar enough share a subset.

Equal sets share a key and are one node from the start, so exact copies cost one
signature list for each slice of input that holds them.

*Groups.*  Sets with a common signature are candidates.  A group of at most
``small`` sets gives all its pairs.  A larger group is a passage that many
documents share, or a large family of near copies.  Pigeonhole again: linked sets
share at least k = m - |difference| of the m parts of the larger one, so that one
looks for partners only in its smaller groups, all but the k - 1 largest, and
pairs that share fewer than k signatures are no candidates.  Members of large
groups meet the few hubs of the group first, and only
members of groups that then still hold different components are compared exactly,
cluster by cluster (what shares large groups), in blocks of which each two meet
once and only links leave.  None is skipped that could connect components.

Candidates are checked on their whole sets.  Nothing but counters reaches the
driver.  Nulls: a null or wordless text has an empty set, links with nothing and
is its own component (component_id is its id, possibly null).  Repeated rows and
ties: rows with equal sets are one class; a row with a null id takes part, and
the smallest id that is not null names the component.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilspark.llm.common import bytes_of, dropped, fresh, mixed, released, sliced, stored, trimmed, word_hashes
from veilspark.llm.components import components

WORDS, PERCENT, SMALL = 5, 75, 8
#: Hubs that the members of a large group meet before the members of different components meet each other.
HUBS = 2
BROADCAST_ROWS = 2_000_000
#: Bytes of text in a step; its words, shingles and signatures take some forty times as much for a moment.
SLICE = 1 << 20
#: Sets in a block, about.
BLOCK = 1000
#: Sets of at least this many elements are signed by equal parts only.
LONG = 64
_Q = np.uint64(0xD1B54A32D192ED03)


def shingle_sets(texts: list[bytes], words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingles of each text as 64-bit hashes, concatenated (ascending within a text), and their number by text."""
    hashes, counts = word_hashes(texts)
    n = len(hashes)
    ends = np.cumsum(counts)
    begins = ends - counts
    rolled = np.zeros(n, np.uint64)
    q = np.uint64(1)
    with np.errstate(over="ignore"):
        for k in range(min(words, n)):
            rolled[: n - k] += hashes[k:] * q
            q = q * _Q
        full = np.maximum(counts - words + 1, 0)
        doc = np.repeat(np.arange(len(texts)), full)
        at = np.arange(len(doc)) - np.repeat(np.cumsum(full) - full, full) + begins[doc]
        shingles = mixed(rolled[at])
        short = np.flatnonzero((counts > 0) & (counts < words))
        extra = np.zeros(len(short), np.uint64)
        for i, d in enumerate(short):
            x, q = np.uint64(0), np.uint64(1)
            for h in hashes[begins[d] : ends[d]]:
                x, q = x + h * q, q * _Q
            extra[i] = x + counts[d].astype(np.uint64) * np.uint64(0xA0761D6478BD642F)
        shingles = np.concatenate([shingles, mixed(mixed(extra))])
    doc = np.concatenate([doc, short])
    order = np.lexsort((shingles, doc))
    doc, shingles = doc[order], shingles[order]
    first = np.ones(len(doc), bool)
    first[1:] = (doc[1:] != doc[:-1]) | (shingles[1:] != shingles[:-1])
    return shingles[first], np.bincount(doc[first], minlength=len(texts))


def set_keys(shingles: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """One 64-bit key for each set, equal for equal sets; 0 for empty ones."""
    begins = np.cumsum(counts) - counts
    keys = np.zeros(len(counts), np.uint64)
    some = np.flatnonzero(counts > 0)
    if len(some):
        with np.errstate(over="ignore"):
            sums = np.add.reduceat(mixed(shingles ^ np.uint64(0x5851F42D4C957F2D)), begins[some])
            keys[some] = mixed(sums + counts[some].astype(np.uint64)) | np.uint64(1)
    return keys


class Bands:
    """Size bands, and the parts of each, for a threshold in percent."""

    def __init__(self, percent: int = PERCENT, upto: int = 1 << 40) -> None:
        self.percent = percent
        low = [1]
        while low[-1] <= upto:
            low.append(max(low[-1] + 1, 100 * (low[-1] - 1) // percent + 1))
        self.low = np.array(low, np.int64)
        top = self.low[1:] - 1
        #: Elements in a part of the largest sets of a band.
        self.long = self.low[:-1] * percent // 100 >= LONG
        # The more elements, the nearer is the share of parts with elements to its mean, and the fuller parts can be.
        share = np.select([~self.long, top < 200, top < 600], [1.2, 2.2, 2.6], 3.0)
        self.parts = np.maximum(1, np.ceil(top / share)).astype(np.int64)

    def of(self, sizes: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.low, sizes, "right") - 1

    def difference(self, sizes: np.ndarray) -> np.ndarray:
        """Most that a set of this size can differ from a linked one that is not larger."""
        p = self.percent
        return (100 - p) * 2 * sizes // (100 + p)


def signatures(shingles: np.ndarray, counts: np.ndarray, bands: Bands) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Sets, their signatures, whether these are of the next band, and how many parts of its own band each set fills."""
    all_sets, all_sigs, all_up = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)], [np.zeros(0, bool)]
    filled = np.zeros(len(counts), np.int64)
    own = bands.of(np.maximum(counts, 1))
    of_set = np.repeat(np.arange(len(counts)), counts)
    spread = mixed(shingles ^ np.uint64(0x2545F4914F6CDD1D))
    for up in (0, 1):
        tag = own + up
        n = bands.parts[tag]
        part = ((spread >> np.uint64(33)) % n[of_set].astype(np.uint64)).astype(np.int64)
        order = np.argsort(of_set * (int(n.max(initial=1)) + 1) + part, kind="stable")
        s, p, x = of_set[order], part[order], mixed(shingles[order])
        if not len(s):
            continue
        heads = np.flatnonzero(np.concatenate([[True], (s[1:] != s[:-1]) | (p[1:] != p[:-1])]))
        sizes = np.diff(np.append(heads, len(s)))
        hs, hp = s[heads], p[heads]
        if not up:
            filled = np.bincount(hs, minlength=len(counts))
        with np.errstate(over="ignore"):
            sums = np.add.reduceat(x, heads)
            salt = tag[hs].astype(np.uint64) << np.uint64(40) ^ hp.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
            all_sets.append(hs)
            all_sigs.append(mixed(sums + salt))
            all_up.append(np.full(len(hs), bool(up)))
            for i in np.flatnonzero(~bands.long[tag[hs]] & (sizes * (100 - bands.percent) >= 100)):
                held = x[heads[i] : heads[i] + sizes[i]]
                subs = [sums[i] - held[list(c)].sum(dtype=np.uint64) for k in range(1, sizes[i] * (100 - bands.percent) // 100 + 1) for c in combinations(range(sizes[i]), k)]
                all_sigs.append(mixed(np.array(subs, np.uint64) + salt[i]))
                all_sets.append(np.full(len(subs), hs[i]))
                all_up.append(np.full(len(subs), bool(up)))
    return np.concatenate(all_sets), np.concatenate(all_sigs), np.concatenate(all_up), filled


_SET = np.dtype([("key", "<u8"), ("size", "<i8"), ("parts", "<i8")])
#: 48 bits of a signature (the bucket holds more), and a set's place in the slice; the highest bit tells the next band.
_PACKED = np.dtype([("a", "<u4"), ("b", "<u2"), ("set", "<u2")])


def _signed(docs: DataFrame, text: str, words: int, bands: Bands, buckets: int) -> DataFrame:
    """Rows (bucket, entries, sets): the signatures of a slice of documents that fall into a bucket."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, text, SLICE):
            shingles, counts = shingle_sets(bytes_of(batch, text), words)
            keys = set_keys(shingles, counts)
            _, first = np.unique(keys, return_index=True)
            first = first[counts[first] > 0]
            take = np.isin(np.arange(len(keys)), first)
            for some in np.array_split(np.flatnonzero(take), len(first) // 30000 + 1):
                inside = np.repeat(np.isin(np.arange(len(keys)), some), counts)
                of, sigs, up, filled = signatures(shingles[inside], counts[some], bands)
                table = np.zeros(len(some), _SET)
                table["key"], table["size"], table["parts"] = keys[some], counts[some], filled
                bucket = (sigs % np.uint64(buckets)).astype(np.int64)
                order = np.argsort(bucket, kind="stable")
                of, sigs, up, cuts = of[order], sigs[order], up[order], np.searchsorted(bucket[order], np.arange(buckets + 1))
                rows: tuple[list, list, list] = ([], [], [])
                for b in np.flatnonzero(np.diff(cuts)):
                    cut = slice(cuts[b], cuts[b + 1])
                    used, place = np.unique(of[cut], return_inverse=True)
                    packed = np.zeros(len(place), _PACKED)
                    packed["a"], packed["b"] = (sigs[cut] >> np.uint64(32)).astype(np.uint32), (sigs[cut] >> np.uint64(16)).astype(np.uint16)
                    packed["set"] = place.astype(np.uint16) | up[cut].astype(np.uint16) << np.uint16(15)
                    rows[0].append(int(b))
                    rows[1].append(packed.tobytes())
                    rows[2].append(table[used].tobytes())
                yield pa.RecordBatch.from_arrays([pa.array(rows[0], pa.int32()), pa.array(rows[1], pa.binary()), pa.array(rows[2], pa.binary())], ["bucket", "entries", "sets"])

    return docs.select(f"`{text}`").mapInArrow(scan, "bucket int, entries binary, sets binary")


def _grouped(signed: DataFrame, small: int, percent: int) -> DataFrame:
    """From signatures: pairs of small groups (a the larger, b; how many signatures they share, and how many they need; no sig), and members of large groups (sig, a, up, and what the pigeonhole needs).

    A pair meets under the larger one's own band; two sets of the band below meet there, not here.
    """
    names = ["sig", "a", "b", "n", "need", "size", "parts", "up"]

    def meet(table: pa.Table) -> pa.Table:
        sigs, sets, ups, known = [], [], [], []
        base = 0
        for e, t in zip(table["entries"].to_pylist(), table["sets"].to_pylist(), strict=True):
            entry = np.frombuffer(e, _PACKED)
            sigs.append((entry["a"].astype(np.uint64) << np.uint64(16)) | entry["b"])
            sets.append((entry["set"] & np.uint16(0x7FFF)).astype(np.int64) + base)
            ups.append(entry["set"] >> np.uint16(15) == 1)
            known.append(np.frombuffer(t, _SET))
            base += len(known[-1])
        sig, of, up, known = (np.concatenate(x) for x in (sigs, sets, ups, known))
        bucket = table["bucket"][0].as_py()
        order = np.argsort(sig, kind="stable")
        sig, of, up = sig[order], of[order], up[order]
        shared = np.zeros(len(sig), bool)
        shared[1:] = sig[1:] == sig[:-1]
        shared[:-1] |= shared[1:]
        sig, of, up = sig[shared], of[shared], up[shared]
        out = {n: [] for n in names}
        if len(sig):
            key = known["key"][of]
            order = np.lexsort((key, up, sig))  # own band first
            sig, of, up, key = sig[order], of[order], up[order], key[order]
            new = np.ones(len(sig), bool)
            new[1:] = (sig[1:] != sig[:-1]) | (up[1:] != up[:-1]) | (key[1:] != key[:-1])
            sig, of, up, key = sig[new], of[new], up[new], key[new]
            heads = np.flatnonzero(np.concatenate([[True], sig[1:] != sig[:-1]]))
            sizes = np.diff(np.append(heads, len(sig)))
            live = ~up[heads] & (sizes > 1)
            heads, sizes = heads[live], sizes[live]
            left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for g in range(2, small + 1):
                rows = heads[sizes == g]
                for i, j in combinations(range(g), 2):
                    some = rows[~up[rows + i]]
                    left.append(some + i)
                    right.append(some + j)
            left, right = np.concatenate(left), np.concatenate(right)
            x, y = known[of[left]], known[of[right]]
            fits = (x["key"] != y["key"]) & (100 * np.minimum(x["size"], y["size"]) >= percent * np.maximum(x["size"], y["size"]))
            x, y = x[fits], y[fits]
            swap = (y["size"] > x["size"]) | (y["size"] == x["size"]) & (y["key"] > x["key"])
            x, y = np.where(swap, y, x), np.where(swap, x, y)
            pair = np.stack([x["key"], y["key"]], 1)
            found, at, times = np.unique(pair, axis=0, return_index=True, return_counts=True)
            need = np.maximum(1, x["parts"][at] - (100 - percent) * (x["size"][at] + y["size"][at]) // (100 + percent))
            found = found.view(np.int64)
            rows = np.repeat(heads[sizes > small], sizes[sizes > small])
            rows = rows + np.arange(len(rows)) - np.repeat(np.cumsum(sizes[sizes > small]) - sizes[sizes > small], sizes[sizes > small])
            n, m = len(found), len(rows)
            spread = (sig[rows] << np.uint64(14)) ^ np.uint64(bucket)
            first, last = np.arange(n + m) >= n, np.arange(n + m) < n
            both = lambda u, v: np.concatenate([u, v]).astype(np.int64)
            none_n, none_m, member = np.zeros(n), np.zeros(m), known[of[rows]]
            out = {
                "sig": pa.array(np.concatenate([np.zeros(n, np.int64), spread.view(np.int64)]), mask=last),
                "a": pa.array(np.concatenate([found[:, 0], key[rows].view(np.int64)])),
                "b": pa.array(np.concatenate([found[:, 1], np.zeros(m, np.int64)]), mask=first),
                "n": pa.array(both(times, none_m)),
                "need": pa.array(both(need, none_m)),
                "size": pa.array(both(none_n, member["size"])),
                "parts": pa.array(both(none_n, member["parts"])),
                "up": pa.array(both(none_n, up[rows])),
            }
        del sigs, sets, ups, known, sig, of, up
        trimmed()
        return pa.table({n: pa.array(out[n], pa.int64()) if isinstance(out[n], list) else out[n] for n in names})

    return signed.groupBy("bucket").applyInArrow(meet, ", ".join(f"{n} bigint" for n in names))


def _sets(docs: DataFrame, text: str, words: int, wanted: DataFrame) -> DataFrame:
    """(key, shingles) of the wanted keys (column key), one row each."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, text, SLICE):
            shingles, counts = shingle_sets(bytes_of(batch, text), words)
            keys = set_keys(shingles, counts)
            _, first = np.unique(keys, return_index=True)
            take = np.sort(first[counts[first] > 0])
            begins = np.cumsum(counts) - counts
            values = [shingles[begins[i] : begins[i] + counts[i]].view(np.int64) for i in take]
            offsets = np.concatenate([[0], np.cumsum(counts[take])]).astype(np.int32)
            flat = np.concatenate(values) if values else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(keys[take].view(np.int64)), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))], ["key", "shingles"])

    made = docs.mapInArrow(scan, "key bigint, shingles array<bigint>")
    return made.join(wanted, "key", "left_semi").dropDuplicates(["key"])


def _linked(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets are similar enough."""
    left = sets.select(F.col("key").alias("a"), F.col("shingles").alias("sa"))
    right = sets.select(F.col("key").alias("b"), F.col("shingles").alias("sb"))
    inter = F.size(F.array_intersect("sa", "sb"))
    return pairs.select("a", "b").join(left, "a").join(right, "b").where(100 * inter >= percent * (F.size("sa") + F.size("sb") - inter)).select("a", "b")


def intersections(x: tuple[np.ndarray, np.ndarray], y: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of every set of one block with every set of another; a block is (elements, set sizes)."""
    nx, ny = len(x[1]), len(y[1])
    elements, place = np.unique(np.concatenate([x[0], y[0]]), return_inverse=True)
    px, py = place[: len(x[0])], place[len(x[0]) :]
    ox, oy = np.repeat(np.arange(nx), x[1]), np.repeat(np.arange(ny), y[1])
    cx, cy = np.bincount(px, minlength=len(elements)), np.bincount(py, minlength=len(elements))
    out = np.zeros((nx, ny), np.float32)
    dense = np.flatnonzero(cx * cy > 64)  # frequent elements: products of 0-1 matrices
    column = np.full(len(elements), -1)
    column[dense] = np.arange(len(dense))
    for at in range(0, len(dense), 1024):
        u, v = np.zeros((nx, 1024), np.float32), np.zeros((ny, 1024), np.float32)
        for m, p, o in ((u, column[px], ox), (v, column[py], oy)):
            inside = (p >= at) & (p < at + 1024)
            m[o[inside], p[inside] - at] = 1
        out += u @ v.T
    rare = (cx * cy > 0) & (column < 0)  # others: each meeting by itself
    kx, ky = np.flatnonzero(rare[px]), np.flatnonzero(rare[py])
    kx, ky = kx[np.argsort(px[kx], kind="stable")], ky[np.argsort(py[ky], kind="stable")]
    first = np.searchsorted(py[ky], np.arange(len(elements)))
    n = cy[px[kx]]
    row = np.repeat(ox[kx], n)
    col = oy[ky[np.repeat(first[px[kx]], n) + np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)]] if len(row) else row
    return out.astype(np.int64) + np.bincount(row * ny + col, minlength=nx * ny).reshape(nx, ny)


def _compared(sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) between sets (key, shingles, root, cluster, block) of one cluster and different roots, one for each two roots of two blocks.

    Blocks of a cluster meet pairwise, each meeting is one row and one task's
    work of bounded size; only links leave it.
    """

    def pack(table: pa.Table) -> pa.Table:
        lists = table["shingles"].combine_chunks()
        sizes = np.diff(lists.offsets.to_numpy()).astype(np.int64)
        data = [table["key"].to_numpy().tobytes(), table["root"].to_numpy().tobytes(), sizes.tobytes(), lists.flatten().to_numpy().tobytes()]
        return pa.table({"cluster": table["cluster"][:1], "block": table["block"][:1], **{n: pa.array([x], pa.binary()) for n, x in zip(("keys", "roots", "sizes", "elements"), data, strict=True)}})

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                one, two = ([np.frombuffer(batch.column(k + j)[i].as_py(), np.int64) for j in range(4)] for k in (0, 4))
                same = batch.column(8)[i].as_py()
                inter = intersections((one[3], one[2]), (two[3], two[2]))
                links = (100 * inter >= percent * (one[2][:, None] + two[2][None, :] - inter)) & (one[1][:, None] != two[1][None, :])
                if same:
                    links &= np.arange(len(one[0]))[:, None] < np.arange(len(two[0]))[None, :]
                u, v = np.nonzero(links)
                _, at = np.unique(np.stack([one[1][u], two[1][v]], 1), axis=0, return_index=True)
                yield pa.RecordBatch.from_arrays([pa.array(one[0][u[at]]), pa.array(two[0][v[at]])], ["a", "b"])

    fields = ("keys", "roots", "sizes", "elements")
    blocks = sets.groupBy("cluster", "block").applyInArrow(pack, "cluster bigint, block int, keys binary, roots binary, sizes binary, elements binary")
    blocks = stored(blocks, "blocks")
    other = blocks.select(F.col("cluster").alias("cluster_2"), F.col("block").alias("block_2"), *(F.col(f).alias(f"{f}_2") for f in fields))
    pairs = blocks.join(other, (F.col("cluster") == F.col("cluster_2")) & (F.col("block") <= F.col("block_2")))
    pairs = pairs.select(*fields, *(f"{f}_2" for f in fields), (F.col("block") == F.col("block_2")).alias("same"))
    return pairs.repartition(max(64, pairs.sparkSession.sparkContext.defaultParallelism * 4)).mapInArrow(meet, "a bigint, b bigint").distinct()


def similarity_classes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = WORDS, percent: int = PERCENT, small: int = SMALL) -> DataFrame:
    """One row for each row of ``docs``: its id, n_shingles, component_id, and class_key (equal sets share it; null for empty ones)."""
    bands = Bands(percent)
    spark = docs.sparkSession
    docs = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    buckets = max(64, 4 * docs.rdd.getNumPartitions())

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "text", SLICE):
            shingles, counts = shingle_sets(bytes_of(batch, "text"), words)
            keys = set_keys(shingles, counts)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts.astype(np.int64)), pa.array(keys.view(np.int64), mask=counts == 0), batch.column(2)], ["doc_id", "n_shingles", "class_key", "row_hash"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = stored(docs.select("doc_id", "text", F.xxhash64("text").alias("row_hash")).mapInArrow(keyed, f"doc_id {kind}, n_shingles bigint, class_key bigint, row_hash bigint"), "classes")
    groups = stored(_grouped(_signed(docs, "text", words, bands, buckets), small, percent), "candidates")
    released(spark)
    first = rows.groupBy(F.col("class_key").alias("key")).agg(F.min("row_hash").alias("row_hash"))

    # How many large groups a set is in, under its own band (0) and the next one (1).
    members = groups.where("sig is not null").select("sig", "a", "size", "parts", "up")
    hot = members.groupBy("a").agg(F.count_if(F.col("up") == 0).alias("h0"), F.count_if(F.col("up") == 1).alias("h1"), F.first("size").alias("size"), F.first("parts").alias("parts"))
    slack = F.greatest(F.lit(1), F.col("parts") - F.floor(F.lit((100 - percent) * 2) * F.col("size") / (100 + percent)))
    hot = stored(hot.select("a", "h0", "h1", slack.alias("least")), "hot")

    # Pairs of small groups share at least what they need, counting every large group of both as shared.
    pairs = groups.where("sig is null").groupBy("a", "b").agg(F.sum("n").alias("n"), F.first("need").alias("need"))
    pairs = pairs.join(hot.select("a", F.col("h0").alias("ha")), "a", "left").join(hot.select(F.col("a").alias("b"), F.greatest("h0", "h1").alias("hb")), "b", "left")
    pairs = stored(pairs.where(F.col("n") + F.least(F.coalesce("ha", F.lit(0)), F.coalesce("hb", F.lit(0))) >= F.col("need")).select("a", "b"), "pairs")

    # Large groups.  A linked pair shares at least ``least`` parts of the larger set's own band, so the larger set need look
    # for partners only in its smaller groups, all but the ``least`` - 1 largest ones; in all others it may be a partner.
    sizes = members.groupBy("sig").agg(F.count("*").alias("g"))
    ranked = members.join(sizes, "sig").join(hot, "a")
    rank = F.row_number().over(Window.partitionBy("a", "up").orderBy("g", "sig"))
    members = stored(ranked.withColumn("asks", (F.col("up") == 0) & (rank <= F.col("h0") - F.col("least") + 1)).withColumn("h", F.when(F.col("up") == 0, F.col("h0")).otherwise(F.col("h1"))).select("sig", "a", "size", "parts", "h", "asks"), "large-groups")
    members = members.join(members.where("asks").select("sig").distinct(), "sig", "left_semi")

    # The whole sets of all that may be compared, read from the texts once.
    wanted = stored(pairs.select(F.explode(F.array("a", "b")).alias("key")).union(members.select("a")).distinct().join(first, "key"), "wanted")
    hashes = stored(wanted.select("row_hash").distinct(), "hashes")
    # Their hashes are counted: up to BROADCAST_ROWS (16 MB) go to the texts, more are joined by key.
    side = F.broadcast(hashes) if hashes.count() <= BROADCAST_ROWS else hashes
    some = docs.join(side, F.xxhash64("text") == F.col("row_hash"), "left_semi").select("text")
    sets = stored(_sets(some, "text", words, wanted.select("key")), "sets")

    def linked(pairs: DataFrame) -> DataFrame:
        """Of the pairs those whose whole sets link."""
        keys = stored(pairs.select(F.explode(F.array("a", "b")).alias("key")).distinct(), "keys")
        return stored(_linked(pairs, sets.join(keys, "key", "left_semi"), percent), "edges")

    edges = linked(pairs)
    found = stored(components(edges), "components")

    item = F.struct("a", "size", "parts", "h", "root")

    def larger(x: Column, y: Column) -> Column:
        return (x["size"] > y["size"]) | (x["size"] == y["size"]) & (x["a"] > y["a"])

    def can_link(x: Column, y: Column) -> Column:
        """Whether two members of a group may link, by their sizes and large groups."""
        big, low = F.when(larger(x, y), x).otherwise(y), F.when(larger(x, y), y).otherwise(x)
        need = big["parts"] - F.floor(F.lit(100 - percent) * (big["size"] + low["size"]) / (100 + percent))
        return (x["root"] != y["root"]) & (100 * low["size"] >= percent * big["size"]) & (F.least(x["h"], y["h"]) >= need)

    def mixed_members(members: DataFrame) -> DataFrame:
        """Members of groups that hold more than one component."""
        rooted = members.drop("root").join(found.select(F.col("node").alias("a"), "root"), "a", "left").withColumn("root", F.coalesce("root", "a"))
        several = rooted.groupBy("sig").agg(F.min("root").alias("x"), F.max("root").alias("y"), F.bool_or("asks").alias("z")).where("x <> y and z").select("sig")
        return stored(rooted.join(several, "sig", "left_semi"), "large-groups")

    members = mixed_members(members)
    if members.limit(1).count():
        # The same member is the hub of most groups that it is in, so a family of near copies has few hubs.
        hubs = members.groupBy("sig").agg(F.array_distinct(F.array(*(F.min_by(item, F.xxhash64("a", F.lit(k))) for k in range(HUBS)))).alias("hubs"))
        new = members.join(hubs, "sig").withColumn("hub", F.explode("hubs")).where(can_link(item, F.col("hub"))).select(F.when(larger(item, F.col("hub")), F.col("a")).otherwise(F.col("hub.a")).alias("a"), F.when(larger(item, F.col("hub")), F.col("hub.a")).otherwise(F.col("a")).alias("b"))
        new = stored(new.distinct().join(pairs, ["a", "b"], "left_anti"), "pairs")
        more = linked(new)
        edges = edges.unionByName(more)
        if more.limit(1).count():
            found = stored(components(edges), "components")
            members = mixed_members(members)
    if members.limit(1).count():
        # Sets that share no large group, not even by way of others, cannot link: they are in different clusters.
        clusters = stored(components(members.select("a", F.col("sig").alias("b"))), "clusters")
        keys = members.select(F.col("a").alias("key"), "root").distinct().join(clusters.select(F.col("node").alias("key"), F.col("root").alias("cluster")), "key")
        counts = keys.groupBy("cluster").agg(F.ceil(F.count("*") / BLOCK).alias("blocks"))
        keys = stored(keys.join(counts, "cluster").select("key", "root", "cluster", F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int").alias("block")), "keys")
        more = stored(_compared(sets.join(keys, "key"), percent), "edges")
        if more.limit(1).count():
            found = stored(components(edges.unionByName(more)), "components")

    smallest = rows.where("class_key is not null").groupBy("class_key").agg(F.min("doc_id").alias("low"))
    rooted = smallest.join(found.select(F.col("node").alias("class_key"), "root"), "class_key", "left").select("class_key", "low", F.coalesce("root", "class_key").alias("root"))
    named = rooted.groupBy("root").agg(F.min("low").alias("component_id"))
    by_class = stored(rooted.join(named, "root").select("class_key", "component_id"), "class-names")
    dropped(spark, groups, sets)
    return rows.join(by_class, "class_key", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"), "class_key")


def representatives(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of ``docs`` for each component: the one with the smallest id; columns are as before.

    Rows without words, and rows with a null id (which no component can name),
    stay.  Repeated rows with words become one.
    """
    classes = stored(similarity_classes(docs, doc_id, text).where("doc_id is not null and n_shingles > 0").select("doc_id", "component_id"), "classes")
    gone = stored(classes.where("doc_id <> component_id").select(F.col("doc_id").alias(fresh("gone", docs.columns))).distinct(), "gone")
    again = stored(classes.groupBy("doc_id").count().where("count > 1").select(F.col("doc_id").alias(fresh("again", docs.columns))), "again")
    kept = docs.join(gone, docs[doc_id] == gone[gone.columns[0]], "left_anti")
    if not again.limit(1).count():
        return kept
    same = kept[doc_id] == again[again.columns[0]]
    return kept.join(again, same, "left_anti").unionByName(kept.join(again, same, "left_semi").dropDuplicates([doc_id]))

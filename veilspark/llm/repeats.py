"""Removal of long strings that occur more than once, by induced suffix sorting in shards.

A string of ``length`` bytes is *repeated* if it starts at two places of the
input, in one text or in two.  Every byte that a repeated string covers goes.

1. *Anchors.*  Of the 32-byte grams of each window of ``length`` bytes, the one
   with the smallest hash (the leftmost, if several) is the window's anchor.
   Equal windows have equal anchors at equal offsets, so they meet under the
   anchor's hash.  Consecutive windows share anchors: an anchor stands for a run
   of windows, whose bytes are its segment (``length`` bytes and a few hundred).
2. *Equal segments* are repeated as wholes and need no sorting.  Within a slice
   of input they are found at once, and one of them goes on; so exact and near
   copies, however many, are a few rows from each slice.
3. *Unequal segments under one anchor* meet in a shard, where a suffix array is
   built by induced sorting and its permuted common prefixes tell which windows
   of a segment stand elsewhere too.  Shards have a bounded size; the number of
   shards grows with the input.
4. An anchor with more than ``hot`` unequal segments (the edges of a passage that
   very many documents hold) is gathered nowhere: its segments are compared where
   their content sends them, and their windows are dealt out by their own content
   instead, each to the shard of its hash.

Whole texts take part; nothing is sampled or capped.  Nulls: a null text is
empty, a null id is carried.  Repeated rows are separate texts, so their long
strings are repeated.  Texts shorter than ``length`` keep all bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilspark.llm.common import bytes_of, dropped, fresh, mixed, powers, released, sliced, stored, trimmed, word_hashes
from veilspark.llm.induced import repeated_starts

LENGTH, GRAM, HOT, SHARD_BYTES = 400, 32, 2000, 2 << 20
#: Bytes of text whose segments are cut in a step: a byte of a crowded anchor's segment is a window of 24 bytes.
CUT_BYTES = 1 << 20
#: Words of a passage (over 50), and of its anchors.
PASSAGE, PASSAGE_GRAM = 51, 8
_ANCHOR = np.dtype([("hash", "<u8"), ("content", "<u8"), ("row", "<i8"), ("start", "<i8"), ("size", "<i4"), ("many", "u1")])
_WINDOW = np.dtype([("hash", "<u8"), ("row", "<i8"), ("start", "<i8")])


def _sums(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    up, down = powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    with np.errstate(over="ignore"):
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=sums[1:])
    return sums, down


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` consecutive values."""
    n = len(x) - width + 1
    pad = -len(x) % width
    blocks = np.concatenate([x, np.full(pad, np.iinfo(x.dtype).max, x.dtype)]).reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])


def anchors(texts: list[bytes], length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Anchors of the texts: text, hash of the gram, hash of the segment, its start in the text, and its size."""
    return _anchors(np.frombuffer(b"".join(texts), np.uint8), np.fromiter(map(len, texts), np.int64, len(texts)), length, gram)


def _anchors(data: np.ndarray, sizes: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The same for any symbols, and the numbers of them in each text."""
    ends = np.cumsum(sizes)
    begins = ends - sizes
    windows = np.maximum(sizes - length + 1, 0)
    if not windows.sum():
        none = np.zeros(0, np.int64)
        return none, none.view(np.uint64), none.view(np.uint64), none, none
    sums, down = _sums(data)
    with np.errstate(over="ignore"):
        grams = mixed((sums[gram:] - sums[:-gram]) * down[: len(data) - gram + 1])
    bits = np.uint64(max(1, int(len(data)).bit_length()))
    packed = (grams >> bits << bits) | np.arange(len(grams), dtype=np.uint64)
    place = (_sliding_min(packed, length - gram + 1) & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    text = np.repeat(np.arange(len(sizes)), windows)
    start = np.arange(len(text)) - np.repeat(np.cumsum(windows) - windows, windows) + begins[text]
    at = place[start]
    heads = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    first = start[heads]
    last = start[np.append(heads[1:], len(start)) - 1] + length
    with np.errstate(over="ignore"):
        content = mixed(((sums[last] - sums[first]) * down[first]) ^ mixed((last - first).astype(np.uint64)))
    return text[heads], grams[at[heads]], content, first - begins[text[heads]], last - first


def window_hashes(data: np.ndarray, length: int) -> np.ndarray:
    """Hashes of the strings of ``length`` symbols at all starts."""
    sums, down = _sums(data)
    with np.errstate(over="ignore"):
        return mixed((sums[length:] - sums[:-length]) * down[: len(data) - length + 1])


def merged(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The union of intervals as maximal runs; touching intervals are one run."""
    if not len(starts):
        return starts, ends
    order = np.argsort(starts, kind="stable")
    starts, ends = starts[order], np.maximum.accumulate(ends[order])
    new = np.concatenate([[True], starts[1:] > ends[:-1]])
    return starts[new], ends[np.append(np.flatnonzero(new)[1:], len(ends)) - 1]


_FOUND = "row bigint, start bigint, end bigint, hash bigint, kind int"
#: Kinds of rows: a repeated span; a segment to be sorted whose windows are asked for, or that only others may match; both for hot anchors.
SPAN, ASKED, WITNESS, HOT_ASKED, HOT_WITNESS = range(5)


def _found(row, start, end, hashes, kind) -> dict[str, np.ndarray]:
    n = len(row)
    return {"row": row, "start": start, "end": end, "hash": hashes if len(hashes) else np.zeros(n, np.int64), "kind": np.full(n, kind, np.int32)}


def _anchored(docs: DataFrame, length: int, buckets: int) -> DataFrame:
    """Rows (bucket, entries) of anchors, and rows with ``spans`` where a slice itself shows segments to be repeated."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "text"):
            text, grams, content, start, size = anchors(bytes_of(batch, "text"), length)
            if not len(text):
                continue
            rows = batch.column(0).to_numpy()
            order = np.lexsort((content, grams))
            text, grams, content, start, size = (x[order] for x in (text, grams, content, start, size))
            heads = np.flatnonzero(np.concatenate([[True], (grams[1:] != grams[:-1]) | (content[1:] != content[:-1])]))
            count = np.diff(np.append(heads, len(grams)))
            many = np.repeat(count > 1, count)
            t, s, e = text[many], start[many], start[many] + size[many]
            far = int(e.max(initial=0)) + 1
            s, e = merged(t * far + s, t * far + e)
            e = e - s // far * far
            t, s = s // far, s % far
            spans = np.zeros(len(t), [("row", "<i8"), ("start", "<i8"), ("end", "<i8")])
            spans["row"], spans["start"], spans["end"] = rows[t], s, e
            entries = np.zeros(len(heads), _ANCHOR)
            for name, value in (("hash", grams[heads]), ("content", content[heads]), ("row", rows[text[heads]]), ("start", start[heads]), ("size", size[heads]), ("many", count > 1)):
                entries[name] = value
            bucket = (entries["hash"] % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            entries, cuts = entries[order], np.searchsorted(bucket[order], np.arange(buckets + 1))
            used = np.flatnonzero(np.diff(cuts))
            out = [entries[cuts[b] : cuts[b + 1]].tobytes() for b in used]
            yield pa.RecordBatch.from_arrays([pa.array([*used.tolist(), None], pa.int32()), pa.array([*out, None], pa.binary()), pa.array([*[None] * len(used), spans.tobytes()], pa.binary())], ["bucket", "entries", "spans"])

    return docs.select("row", "text").mapInArrow(scan, "bucket int, entries binary, spans binary")


def _crowded(anchored: DataFrame, entry: np.dtype, hot: int, buckets: int) -> DataFrame:
    """(bucket, crowds): of each bucket the hashes of anchors with more than ``hot`` unequal segments."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in batch.column(0):
                hashes, n = np.unique(np.frombuffer(b.as_py(), entry)["hash"], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(hashes.view(np.int64)), pa.array((hashes % np.uint64(buckets)).astype(np.int32)), pa.array(n)], ["hash", "bucket", "n"])

    sums = anchored.where("bucket is not null").select("entries").mapInArrow(each, "hash bigint, bucket int, n bigint").groupBy("bucket", "hash").agg(F.sum("n").alias("n")).where(F.col("n") > hot)
    return stored(sums.groupBy("bucket").agg(F.collect_list("hash").alias("crowds")), "crowded-anchors")


def _dealt_out(anchored: DataFrame, entry: np.dtype, crowds: DataFrame, buckets: int) -> DataFrame:
    """(bucket, hot, entries): entries of crowded anchors leave their bucket and go to others by their content."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for bucket, data, crowd in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
                x = np.frombuffer(data.as_py(), entry)
                hot = np.isin(x["hash"], crowd.values.to_numpy().view(np.uint64)) if crowd.is_valid else np.zeros(len(x), bool)
                rows = [(bucket, x[~hot])] if not hot.all() else []
                y = x[hot]
                to = (y["content"] % np.uint64(buckets)).astype(np.int64)
                rows += [(int(b), y[to == b]) for b in np.unique(to)]
                flags = [False] * (len(rows) - len(np.unique(to))) + [True] * len(np.unique(to))
                yield pa.RecordBatch.from_arrays([pa.array([b for b, _ in rows], pa.int32()), pa.array(flags), pa.array([z.tobytes() for _, z in rows], pa.binary())], ["bucket", "hot", "entries"])

    told = anchored.where("bucket is not null").select("bucket", "entries").join(crowds, "bucket", "left").select("bucket", "entries", "crowds")
    return told.mapInArrow(deal, "bucket int, hot boolean, entries binary")


def _met(anchored: DataFrame, hot: int, buckets: int) -> DataFrame:
    """Spans of segments that slices share, and the segments that must be sorted."""

    def meet(table: pa.Table) -> pa.Table:
        x = np.concatenate([np.frombuffer(b, _ANCHOR) for b in table["entries"].to_pylist()])
        x = x[np.lexsort((x["content"], x["hash"]))]
        heads = np.flatnonzero(np.concatenate([[True], (x["hash"][1:] != x["hash"][:-1]) | (x["content"][1:] != x["content"][:-1])]))
        count = np.diff(np.append(heads, len(x)))
        many = np.maximum.reduceat(x["many"], heads).astype(bool) | (count > 1)
        tell = np.repeat(count > 1, count) & (x["many"] == 0)
        parts = [_found(x["row"][tell], x["start"][tell], x["start"][tell] + x["size"][tell], np.zeros(0, np.int64), SPAN)]
        one = x[heads]
        groups = np.flatnonzero(np.concatenate([[True], one["hash"][1:] != one["hash"][:-1]]))
        kinds = np.diff(np.append(groups, len(one)))
        asked = np.add.reduceat((~many).astype(np.int64), groups)
        crowd = np.full(len(one), table["hot"][0].as_py())
        sort = np.repeat((kinds > 1) & (asked > 0), kinds) | crowd
        for chosen, kind in ((sort & ~many & ~crowd, ASKED), (sort & many & ~crowd, WITNESS), (sort & ~many & crowd, HOT_ASKED), (sort & many & crowd, HOT_WITNESS)):
            y = one[chosen]
            parts.append(_found(y["row"], y["start"], y["start"] + y["size"], y["hash"].view(np.int64), kind))
        return pa.table({k: pa.array(np.concatenate([p[k] for p in parts])) for k in parts[0]})

    return _dealt_out(anchored, _ANCHOR, _crowded(anchored, _ANCHOR, hot, buckets), buckets).groupBy("bucket", "hot").applyInArrow(meet, _FOUND)


def _cut(docs: DataFrame, wanted: DataFrame, length: int, shards: int) -> DataFrame:
    """The bytes of the segments to be sorted, and the windows of hot anchors, by shard."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "text", CUT_BYTES):
            out: dict[str, list] = {k: [] for k in ("shard", "row", "start", "kind", "bytes")}
            windows = []
            for row, text, segments in zip(batch.column(0).to_pylist(), bytes_of(batch, "text"), batch.column(2).to_pylist(), strict=True):
                for s in segments:
                    part = text[s["start"] : s["end"]]
                    if s["kind"] in (ASKED, WITNESS):
                        out["shard"].append(s["hash"] % shards)
                        out["row"].append(row)
                        out["start"].append(s["start"])
                        out["kind"].append(s["kind"])
                        out["bytes"].append(part)
                    else:
                        h = window_hashes(np.frombuffer(part, np.uint8), length)
                        w = np.zeros(len(h), _WINDOW)
                        w["hash"], w["row"], w["start"] = h, row, np.arange(len(h)) + s["start"]
                        windows.append(w)
            if windows:
                w = np.concatenate(windows)
                shard = (w["hash"] % np.uint64(shards)).astype(np.int64)
                order = np.argsort(shard, kind="stable")
                w, cuts = w[order], np.searchsorted(shard[order], np.arange(shards + 1))
                for b in np.flatnonzero(np.diff(cuts)):
                    out["shard"].append(int(b))
                    out["row"].append(None)
                    out["start"].append(None)
                    out["kind"].append(HOT_ASKED)
                    out["bytes"].append(w[cuts[b] : cuts[b + 1]].tobytes())
            types = {"shard": pa.int64(), "row": pa.int64(), "start": pa.int64(), "kind": pa.int32(), "bytes": pa.binary()}
            yield pa.RecordBatch.from_arrays([pa.array(out[k], t) for k, t in types.items()], list(types))

    lists = wanted.groupBy("row").agg(F.collect_list(F.struct("start", "end", "hash", "kind")).alias("segments"))
    return docs.join(lists, "row").select("row", "text", "segments").mapInArrow(cut, "shard bigint, row bigint, start bigint, kind int, bytes binary")


def _sorted(cuts: DataFrame, length: int) -> DataFrame:
    """Repeated spans of the segments that were asked for."""

    def judge(table: pa.Table) -> pa.Table:
        kind = table["kind"].to_numpy()
        row, start, data = table["row"].to_pylist(), table["start"].to_pylist(), table["bytes"].to_pylist()
        out: tuple[list, list, list] = ([], [], [])
        plain = np.flatnonzero((kind == ASKED) | (kind == WITNESS))
        if len(plain):
            for i, again in zip(plain, repeated_starts([data[i] for i in plain], length), strict=True):
                at = np.flatnonzero(again)
                if kind[i] == ASKED and len(at):
                    s, e = merged(at, at + length)
                    out[0].append(np.full(len(s), row[i], np.int64))
                    out[1].append(s + start[i])
                    out[2].append(e + start[i])
        windows = [np.frombuffer(data[i], _WINDOW) for i in np.flatnonzero(kind == HOT_ASKED)]
        if windows:
            w = np.concatenate(windows)
            w = w[np.argsort(w["hash"], kind="stable")]
            same = w["hash"][1:] == w["hash"][:-1]
            again = np.concatenate([[False], same]) | np.concatenate([same, [False]])
            w = w[again]
            w = w[np.lexsort((w["start"], w["row"]))]
            new = np.concatenate([[True], (w["row"][1:] != w["row"][:-1]) | (w["start"][1:] > w["start"][:-1] + length)]) if len(w) else np.zeros(0, bool)
            heads = np.flatnonzero(new)
            if len(heads):
                out[0].append(w["row"][heads])
                out[1].append(w["start"][heads])
                out[2].append(w["start"][np.append(heads[1:], len(w)) - 1] + length)
        cols = [np.concatenate(x) if x else np.zeros(0, np.int64) for x in out]
        trimmed()
        return pa.table({"row": pa.array(cols[0]), "start": pa.array(cols[1]), "end": pa.array(cols[2])})

    return cuts.groupBy("shard").applyInArrow(judge, "row bigint, start bigint, end bigint")


def repeated_spans(slim: DataFrame, length: int = LENGTH, hot: int = HOT, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """(row, spans): for each text with repeated strings of ``length`` bytes, the spans that hold them, not yet merged.

    ``slim`` has columns row (bigint) and text (string or binary).  Texts with
    the same row number must be equal; each counts.
    """
    buckets = max(64, 2 * slim.rdd.getNumPartitions())
    anchored = stored(_anchored(slim, length, buckets), "anchors")
    met = stored(_met(anchored, hot, buckets), "segments")
    released(slim.sparkSession)

    def unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.concatenate([np.frombuffer(b, np.int64).reshape(-1, 3) for b in batch.column(0).to_pylist()] or [np.zeros((0, 3), np.int64)])
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(x[:, k])) for k in range(3)], ["row", "start", "end"])

    wanted = met.where(F.col("kind") != SPAN)
    found = anchored.where("spans is not null").select("spans").mapInArrow(unpacked, "row bigint, start bigint, end bigint").union(met.where(F.col("kind") == SPAN).select("row", "start", "end"))
    total = wanted.agg(F.sum(F.col("end") - F.col("start"))).first()[0] or 0
    if total:
        shards = int(total // shard_bytes) + 1
        found = found.union(_sorted(_cut(slim, wanted, length, shards), length))
    found = stored(found.groupBy("row").agg(F.array_sort(F.collect_set(F.struct("start", "end"))).alias("spans")), "repeated")
    dropped(slim.sparkSession, anchored, met)
    return found


# -- passages of words ---------------------------------------------------------------------------

#: Row of a witness: its windows stand in several rows already, so whoever else holds them shares them.
NO_ROW = np.iinfo(np.int64).min
_HEAD = np.dtype([("hash", "<u8"), ("content", "<u8"), ("row", "<i8"), ("start", "<i4"), ("size", "<i4"), ("many", "u1")])


def shared_passages(slim: DataFrame, words: int = PASSAGE, hot: int = HOT) -> DataFrame:
    """(row, n_passages, n_passage_words): maximal runs of words that lie in strings of ``words`` words which another row holds too.

    Rows without any are left out.  Words are runs of bytes other than \\x20 and
    \\x09-\\x0D, with A-Z as a-z.  The steps are those of :func:`repeated_spans`
    with words in place of bytes: anchors, equal segments as wholes, and the
    windows of unequal segments under one anchor dealt out by their content, so
    that no anchor, however many segments it has, is sorted in one task.  A
    repetition within one row only, or in rows that are equal in all columns, is
    none.
    """
    buckets = max(64, 2 * slim.rdd.getNumPartitions())

    def dealt(x: np.ndarray, spans: np.ndarray) -> pa.RecordBatch:
        bucket = (x["hash"] % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        x, cuts = x[order], np.searchsorted(bucket[order], np.arange(buckets + 1))
        used = np.flatnonzero(np.diff(cuts))
        return pa.RecordBatch.from_arrays([pa.array([*used.tolist(), None], pa.int32()), pa.array([*(x[cuts[b] : cuts[b + 1]].tobytes() for b in used), None], pa.binary()), pa.array([*[None] * len(used), spans.tobytes()], pa.binary())], ["bucket", "entries", "spans"])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "text"):
            hashes, sizes = word_hashes(bytes_of(batch, "text"))
            text, grams, content, start, size = _anchors(hashes, sizes, words, PASSAGE_GRAM)
            if not len(text):
                continue
            row = batch.column(0).to_numpy()[text]
            order = np.lexsort((row, content, grams))
            row, grams, content, start, size = (x[order] for x in (row, grams, content, start, size))
            heads = np.flatnonzero(np.concatenate([[True], (grams[1:] != grams[:-1]) | (content[1:] != content[:-1])]))
            count = np.diff(np.append(heads, len(grams)))
            many = row[heads] != row[heads + count - 1]  # rows ascend within a group
            all_many = np.repeat(many, count)
            own, place = np.unique(row[all_many], return_inverse=True)
            far = int((start + size).max()) + 1
            s, e = merged(place * far + start[all_many], place * far + start[all_many] + size[all_many])
            spans = np.stack([own[s // far], s % far, e - s // far * far], 1) if len(s) else np.zeros((0, 3), np.int64)
            x = np.zeros(len(heads), _HEAD)
            for name, value in (("hash", grams[heads]), ("content", content[heads]), ("row", row[heads]), ("start", start[heads]), ("size", size[heads]), ("many", many)):
                x[name] = value
            # A segment that stands several times in one row is told by each of its places: the others go on as well.
            other = np.flatnonzero(~all_many & ~np.isin(np.arange(len(grams)), heads))
            if len(other):
                y = np.zeros(len(other), _HEAD)
                for name, value in (("hash", grams), ("content", content), ("row", row), ("start", start), ("size", size)):
                    y[name] = value[other]
                x = np.concatenate([x, y])
            yield dealt(x, spans)

    def meet(table: pa.Table) -> pa.Table:
        x = np.concatenate([np.frombuffer(b.as_py(), _HEAD) for b in table["entries"]])
        x = x[np.lexsort((x["row"], x["content"], x["hash"]))]
        heads = np.flatnonzero(np.concatenate([[True], (x["hash"][1:] != x["hash"][:-1]) | (x["content"][1:] != x["content"][:-1])]))
        count = np.diff(np.append(heads, len(x)))
        last = heads + count - 1
        shared = (x["row"][heads] != x["row"][last]) | (np.maximum.reduceat(x["many"], heads) > 0)
        tell = np.repeat(shared, count) & (x["many"] == 0)
        head = np.isin(np.arange(len(x)), heads)
        groups = np.flatnonzero(np.concatenate([[True], x["hash"][1:] != x["hash"][:-1]]))
        size = np.diff(np.append(groups, len(x)))
        unequal = np.repeat(np.add.reduceat(head.astype(np.int64), groups) > 1, size) | table["hot"][0].as_py()
        first = np.repeat(shared, count)
        # Windows are asked for by segments that are not shared; one of each shared content bears witness.
        ask, witness = unequal & ~first, unequal & first & head
        kind = np.select([ask, witness], [ASKED, WITNESS], SPAN)
        some = tell | ask | witness
        out = [(x[tell], np.full(int(tell.sum()), SPAN)), (x[ask | witness], kind[ask | witness])] if some.any() else []
        rows = np.concatenate([np.stack([y["row"], y["start"].astype(np.int64), y["start"].astype(np.int64) + y["size"], k.astype(np.int64)], 1) for y, k in out]) if out else np.zeros((0, 4), np.int64)
        return pa.table({n: pa.array(np.ascontiguousarray(rows[:, k])) for k, n in enumerate(("row", "start", "end", "kind"))})

    def unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.concatenate([np.frombuffer(b, np.int64).reshape(-1, 3) for b in batch.column(0).to_pylist()] or [np.zeros((0, 3), np.int64)])
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(x[:, k])) for k in range(3)], ["row", "start", "end"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "text"):
            hashes, sizes = word_hashes(bytes_of(batch, "text"))
            ends = np.cumsum(sizes)
            parts = [np.zeros(0, _WINDOW)]
            for row, begin, end, segments in zip(batch.column(0).to_pylist(), ends - sizes, ends, batch.column(2).to_pylist(), strict=True):
                for kind, own in ((ASKED, row), (WITNESS, NO_ROW)):
                    for s in merged_segments([x for x in segments if x["kind"] == kind]):
                        h = window_hashes(hashes[begin + s[0] : min(end, begin + s[1])], words)
                        w = np.zeros(len(h), _WINDOW)
                        w["hash"], w["row"], w["start"] = h, own, np.arange(len(h)) + s[0]
                        parts.append(w)
            yield dealt(np.concatenate(parts), np.zeros(0, np.int64))

    def again(table: pa.Table) -> pa.Table:
        w = np.concatenate([np.frombuffer(b.as_py(), _WINDOW) for b in table["entries"]])
        w = w[np.lexsort((w["row"], w["hash"]))]
        heads = np.flatnonzero(np.concatenate([[True], w["hash"][1:] != w["hash"][:-1]]))
        count = np.diff(np.append(heads, len(w)))
        w = w[np.repeat(w["row"][heads] != w["row"][heads + count - 1], count) & (w["row"] != NO_ROW)]
        far = int(w["start"].max(initial=0)) + 2 * words
        rows, place = np.unique(w["row"], return_inverse=True)
        s, e = merged(place * far + w["start"], place * far + w["start"] + words)
        return pa.table({"row": pa.array(rows[s // far] if len(s) else np.zeros(0, np.int64)), "start": pa.array(s % far), "end": pa.array(e - s // far * far)})

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, m = [], []
            for given in batch.column(1).to_pylist():
                s, e = merged(*(np.array([x[k] for x in given], np.int64) for k in ("start", "end")))
                n.append(len(s))
                m.append(int((e - s).sum()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(m, pa.int64())], ["row", "n_passages", "n_passage_words"])

    packed = "bucket int, entries binary, spans binary"
    anchored = stored(slim.select("row", "text").mapInArrow(scan, packed), "passage-anchors")
    met = stored(_dealt_out(anchored, _HEAD, _crowded(anchored, _HEAD, hot, buckets), buckets).groupBy("bucket", "hot").applyInArrow(meet, "row bigint, start bigint, end bigint, kind bigint"), "passage-segments")
    released(slim.sparkSession)
    lists = met.where(F.col("kind") != SPAN).groupBy("row").agg(F.collect_set(F.struct("start", "end", "kind")).alias("segments"))
    windows = slim.select("row", "text").join(lists, "row").select("row", "text", "segments").mapInArrow(cut, packed)
    found = windows.where("bucket is not null").groupBy("bucket").applyInArrow(again, "row bigint, start bigint, end bigint")
    whole = anchored.where("spans is not null").select("spans").mapInArrow(unpacked, "row bigint, start bigint, end bigint").union(met.where(F.col("kind") == SPAN).select("row", "start", "end")).union(found)
    out = whole.groupBy("row").agg(F.collect_set(F.struct("start", "end")).alias("spans")).mapInArrow(summed, "row bigint, n_passages bigint, n_passage_words bigint")
    out = stored(out, "passages")
    dropped(slim.sparkSession, anchored, met)
    return out


def merged_segments(segments: list[dict]) -> list[tuple[int, int]]:
    """Overlapping segments (start, end) as one; those that only touch stay apart, as no window spans both."""
    out: list[tuple[int, int]] = []
    for s, e in sorted((x["start"], x["end"]) for x in segments):
        if out and s < out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


def row_keys(docs: DataFrame, out: str, width: int = 64) -> DataFrame:
    """``docs`` with a key of 64 bits that rows share if they are equal in all columns, and only then.

    Equal rows are repeated alike, so they can share what is found.  Keys are
    hashes; where rows of one hash differ in a second one, they get a hash of
    their own until no key stands for two rows that 128 bits tell apart.
    ``width`` (bits of the first hash) is for tests.
    """
    # Maps have no hash of their own: their JSON has.
    columns = [F.to_json(F.col(f"`{f.name}`")) if "map<" in f.dataType.simpleString() else F.col(f"`{f.name}`") for f in docs.schema]

    def key(turn: int) -> Column:
        return F.xxhash64(F.lit(turn), *columns)

    first = key(0) if width == 64 else F.pmod(key(0), F.lit(1 << width))
    keyed, turn = docs.withColumn(out, first), 0
    while True:
        turn += 1
        other = key(turn)
        clashes = keyed.select(F.col(out).alias("__key"), other.alias("__other")).groupBy("__key").agg(F.min("__other").alias("__low"), F.max("__other").alias("__high")).where("__low <> __high").select("__key", F.lit(True).alias("__clash"))
        clashes = stored(clashes, "clashes")
        if not clashes.limit(1).count():
            return keyed
        joined = keyed.join(clashes, keyed[out] == clashes["__key"], "left")
        keyed = joined.withColumn(out, F.when(F.col("__clash"), other).otherwise(F.col(out))).drop("__key", "__clash")


def without_repeats(docs: DataFrame, text: str = "text", length: int = LENGTH, hot: int = HOT, shard_bytes: int = SHARD_BYTES, passage: int = PASSAGE) -> DataFrame:
    """``docs`` with removed array<struct<start, end>> (maximal runs of repeated bytes), n_bytes, n_removed and kept (binary, the remaining bytes), and n_passages and n_passage_words of :func:`shared_passages`.

    Columns of those names are replaced.  Passages are reported only: a passage
    of words shorter than ``length`` bytes is not removed.
    """
    added = ["n_bytes", "n_removed", "removed", "kept", "n_passages", "n_passage_words"]
    docs = docs.drop(*added)
    names, t = docs.columns, F.col(f"`{text}`")
    row, spans = fresh("row", names), fresh("spans", names)
    keyed = row_keys(docs, row)
    slim = keyed.select(F.col(row).alias("row"), t.alias("text"))
    found = repeated_spans(slim, length, hot, shard_bytes)
    released(docs.sparkSession)
    found = found.join(shared_passages(slim, passage, hot), "row", "full")
    found = found.select(F.col("row").alias(row), F.struct("spans", "n_passages", "n_passage_words").alias(spans))
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, text):
            n_bytes, n_removed, removed, kept, n_passages, n_words = [], [], [], [], [], []
            for data, given in zip(bytes_of(batch, text), batch.column(len(names)).to_pylist(), strict=True):
                given = given or {}
                s, e = merged(*(np.array([x[k] for x in given.get("spans") or ()], np.int64) for k in ("start", "end")))
                n_passages.append(given.get("n_passages") or 0)
                n_words.append(given.get("n_passage_words") or 0)
                n_bytes.append(len(data))
                n_removed.append(int((e - s).sum()))
                removed.append([{"start": int(a), "end": int(b)} for a, b in zip(s, e, strict=True)])
                kept.append(b"".join(data[a:b] for a, b in zip([0, *e.tolist()], [*s.tolist(), len(data)], strict=True)))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], pa.array(n_bytes, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(removed, span), pa.array(kept, pa.binary()), pa.array(n_passages, pa.int64()), pa.array(n_words, pa.int64())], [*names, *added])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema) + ", n_bytes bigint, n_removed bigint, removed array<struct<start:bigint,end:bigint>>, kept binary, n_passages bigint, n_passage_words bigint"
    return keyed.join(found, row, "left").select(*(f"`{c}`" for c in names), spans).mapInArrow(remove, schema)

"""Ranked lexical search: postings in document windows, scored into arrays.

*Index.*  A task cuts its documents into windows of at most ``window`` rows, in
the order of their ids, and writes one row a window: ids, lengths, and for every
term that a query holds its postings (place in the window, occurrences).  The
windows are a stored table; counts of documents, terms and postings are sums
over it.

*Search.*  For each window and query the postings of the query's terms are added
into an array of one number a document, which a window keeps small enough for a
processor's cache, and marked in an occupancy array; what is marked is harvested
into the query's best ``k`` of the task, and the best of the tasks are ranked.

A document's score for a query is the sum over the query's terms, repeats
included, of ``w * (10^9 tf div (1000 tf + 12 m))`` with ``w = floor(1000
ln((2N+2)/(2df+1)))`` and ``m = 75 + 25 n N div L``: N documents with a term, L
terms of all documents, n terms of the document, df documents with the term, tf
occurrences in the document.  Terms are compared as bytes, never by hash.

Queries travel to the windows in blocks of about ``block_terms`` different terms
of queries (a query is not cut), which bounds what is broadcast; more blocks
read the documents again.  Documents are never shuffled, and of each task only k
rows a query leave, so a hot source, term or group of copies weighs on no task.

Nulls: a null text has no terms; a null document id ranks behind all others of
its score; queries with a null id are one query.  Rows of one query id are one
query with the terms of its different texts.  Repeated documents are ranked each
for itself; equal scores go by id.  Empty tables give no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veilspark.llm.common import PLAIN, bytes_of, sliced, stored, trimmed, word_codes

K, WINDOW, BLOCK_TERMS = 20, 1 << 14, 500_000
#: Postings after which a window is closed, however few documents it has.
POSTINGS = 1 << 20
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass
class Queries:
    """A block of queries: their ids, the terms they hold, and each one's terms as numbers, with repeats."""

    ids: list
    terms: list[bytes]
    rows: list[tuple[np.ndarray, np.ndarray]]


def query_terms(queries: DataFrame, item_id: str, text: str) -> DataFrame:
    """(item_id, term, n) of every query."""
    rows = queries.select(F.col(f"`{item_id}`").alias("item_id"), F.col(f"`{text}`").alias("text")).distinct()
    terms = rows.select("item_id", F.explode(F.regexp_extract_all(F.translate("text", UPPER, LOWER), F.lit(TERM), F.lit(0))).alias("term"))
    return terms.groupBy("item_id", "term").agg(F.count("*").alias("n"))


def blocks_of(terms: DataFrame, block_terms: int) -> Iterator[Queries]:
    """Queries (item_id, term, n) in blocks of about ``block_terms`` rows, of whole queries."""
    terms = stored(terms, "query-terms")
    blocks = math.ceil(terms.count() / block_terms)
    for b in range(blocks):
        known, places, rows = {}, {}, []
        for item, term, n in terms.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b).collect():  # about block_terms rows
            at = places.setdefault(item, len(places))
            if at == len(rows):
                rows.append(([], []))
            rows[at][0].append(known.setdefault(term.encode(), len(known)))
            rows[at][1].append(n)
        if rows:
            yield Queries(list(places), list(known), [(np.array(t, np.int64), np.array(n, np.int64)) for t, n in rows])


def postings(docs: DataFrame, terms: list[bytes], doc_id: str = "doc_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """One row a window of documents: doc_ids, and lengths, terms, firsts, places and tfs as arrays of numbers; n_docs, n_terms, and df of its terms."""
    kind = docs.schema[doc_id].dataType.simpleString()
    docs = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    vocabulary = pa.array(terms, pa.binary())

    def row(parts: list[tuple]) -> pa.RecordBatch:
        ids = pa.concat_arrays([p[0] for p in parts])
        order = pc.array_sort_indices(ids).to_numpy(zero_copy_only=False).astype(np.int64)  # nulls come last
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        base = np.cumsum([0] + [len(p[0]) for p in parts])
        term, tf = (np.concatenate([p[i] for p in parts]) for i in (2, 4))
        at = place[np.concatenate([p[3] + b for p, b in zip(parts, base, strict=False)])]
        by = np.lexsort((at, term))
        term, at, tf = term[by], at[by], tf[by]
        heads = np.flatnonzero(np.diff(term, prepend=-1))
        lengths = np.concatenate([p[1] for p in parts])[order]
        df = np.diff(np.append(heads, len(term)))
        lists = {"terms": (term[heads], np.int32), "firsts": (heads, np.int32), "places": (at, np.int32), "tfs": (tf, np.int64), "lengths": (lengths, np.int64)}
        fixed = [pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids.take(pa.array(order))), *(pa.array([x.astype(t).tobytes()], pa.binary()) for x, t in lists.values())]
        counts = [pa.array([int((lengths > 0).sum())]), pa.array([int(lengths.sum())]), pa.array([df.tolist()], pa.list_(pa.int64())), pa.array([term[heads].tolist()], pa.list_(pa.int32()))]
        return pa.RecordBatch.from_arrays([*fixed, *counts], ["doc_ids", *lists, "n_docs", "n_terms", "df", "df_terms"])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for batch in sliced(batches, "text"):
            words, codes, counts = word_codes(bytes_of(batch, "text"), PLAIN)
            known = pc.fill_null(pc.index_in(words, value_set=vocabulary), -1).to_numpy(zero_copy_only=False)
            ids = known[codes] if len(codes) else np.zeros(0, np.int64)
            doc = np.repeat(np.arange(len(counts)), counts)
            some = ids >= 0
            pair, tf = np.unique(ids[some].astype(np.int64) * max(1, len(counts)) + doc[some], return_counts=True)
            part = (batch.column(0), counts, pair // max(1, len(counts)), pair % max(1, len(counts)), tf)
            if held and (sum(len(p[0]) for p in held) + len(counts) > window or sum(len(p[2]) for p in held) + len(pair) > POSTINGS):
                yield row(held)
                held = []
            held.append(part)
        if held:
            yield row(held)
        trimmed()

    return docs.mapInArrow(scan, f"doc_ids array<{kind}>, terms binary, firsts binary, places binary, tfs binary, lengths binary, n_docs bigint, n_terms bigint, df array<bigint>, df_terms array<int>")


def statistics(windows: DataFrame, n_terms: int) -> tuple[int, int, np.ndarray]:
    """Documents with a term, terms of all documents, and for each term of the block the documents that hold it."""
    whole = windows.agg(F.sum("n_docs"), F.sum("n_terms")).first()
    each = windows.select(F.explode(F.arrays_zip("df_terms", "df")).alias("x")).groupBy("x.df_terms").agg(F.sum("x.df")).collect()  # one row a term of the block
    df = np.zeros(n_terms, np.int64)
    for term, n in each:
        df[term] = n
    return int(whole[0] or 0), int(whole[1] or 0), df


def weights(n_docs: int, df: np.ndarray) -> np.ndarray:
    """floor(1000 ln((2N+2)/(2df+1))) of every term."""
    return np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * int(d) + 1))) for d in df], np.int64)


def lengths_factor(lengths: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """75 + 25 n N div L of every document."""
    if 25 * int(lengths.max(initial=0)) * n_docs < 1 << 63:
        return 75 + 25 * lengths * n_docs // max(1, n_terms)
    return np.array([75 + 25 * int(n) * n_docs // n_terms for n in lengths], np.int64)


def _best(scores: np.ndarray, places: np.ndarray, k: int) -> np.ndarray:
    """Which are the k largest, the smaller place first where scores tie."""
    if len(scores) > k:
        near = np.flatnonzero(scores >= np.partition(scores, len(scores) - k)[len(scores) - k])
        return near[np.lexsort((places[near], -scores[near]))][:k]
    return np.lexsort((places, -scores))


def _found(windows: DataFrame, queries: Queries, n_docs: int, n_terms: int, weight: np.ndarray, k: int, item_kind: str, doc_kind: str) -> DataFrame:
    """(part, item_id, doc_id, score): of each task the k best of each query."""
    item_type = pa.array(queries.ids).type

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: list[list[tuple]] = [[] for _ in queries.ids]
        starts, stops = np.zeros(len(weight), np.int64), np.zeros(len(weight), np.int64)
        kind = None
        for batch in batches:
            kind = batch.column(0).type.value_type
            for i in range(batch.num_rows):
                ids = batch.column(0)[i].values
                term, first, place = (np.frombuffer(batch.column(c)[i].as_py(), np.int32) for c in (1, 2, 3))
                tf, lengths = (np.frombuffer(batch.column(c)[i].as_py(), np.int64) for c in (4, 5))
                starts[term], stops[term] = first, np.append(first[1:], len(place))
                m = lengths_factor(lengths, n_docs, n_terms)
                gain = np.repeat(weight[term], stops[term] - starts[term]) * (1_000_000_000 * tf // (1000 * tf + 12 * m[place]))
                score, occupied = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), bool)
                for q, (own, times) in enumerate(queries.rows):
                    for t, n in zip(own[stops[own] > starts[own]], times[stops[own] > starts[own]], strict=True):
                        at = place[starts[t] : stops[t]]
                        score[at] += gain[starts[t] : stops[t]] * n
                        occupied[at] = True
                    hit = np.flatnonzero(occupied)
                    points = score[hit]
                    score[hit], occupied[hit] = 0, False
                    least = -best[q][-1][0] if len(best[q]) == k else 1
                    hit, points = hit[points >= least], points[points >= least]
                    take = _best(points, hit, k)
                    new = [(-int(points[x]), (d := ids[int(hit[x])].as_py()) is None, d) for x in take]
                    if new:
                        best[q] = sorted(best[q] + new, key=lambda r: r[:2] if r[1] else r)[:k] if best[q] else new
                starts[term], stops[term] = 0, 0
        rows = [(q, *r) for q, own in enumerate(best) for r in own]
        if rows:
            item = pa.array(queries.ids, item_type).take(pa.array([r[0] for r in rows]))
            yield pa.RecordBatch.from_arrays([item, pa.array([r[3] for r in rows], kind), pa.array([-r[1] for r in rows], pa.int64())], ["item_id", "doc_id", "score"])

    return windows.select("doc_ids", "terms", "firsts", "places", "tfs", "lengths").mapInArrow(scan, f"item_id {item_kind}, doc_id {doc_kind}, score bigint").withColumn("part", F.spark_partition_id())


def search(docs: DataFrame, queries: DataFrame, k: int = K, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", query_text: str = "text", window: int = WINDOW, block_terms: int = BLOCK_TERMS) -> DataFrame:
    """The k best documents of every query: item_id, rank (from 1), doc_id, score; only scores above 0."""
    item_kind, doc_kind = queries.schema[item_id].dataType.simpleString(), docs.schema[doc_id].dataType.simpleString()
    spark, out = docs.sparkSession, None
    for block in blocks_of(query_terms(queries, item_id, query_text), block_terms):
        windows = stored(postings(docs, block.terms, doc_id, text, window), "windows")
        n_docs, n_terms, df = statistics(windows, len(block.terms))
        found = _found(windows, block, n_docs, n_terms, weights(n_docs, df), k, item_kind, doc_kind)
        found = stored(found, "found")
        out = found if out is None else out.unionByName(found)
    if out is None:
        return spark.createDataFrame([], f"item_id {item_kind}, rank int, doc_id {doc_kind}, score bigint")
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    # Some of the tasks first, then what they leave: no query's rows of all tasks meet at once.
    some = Window.partitionBy("item_id", F.col("part") % 64).orderBy(*order)
    near = out.withColumn("near", F.row_number().over(some)).where(F.col("near") <= k)
    rank = F.row_number().over(Window.partitionBy("item_id").orderBy(*order))
    return near.withColumn("rank", rank).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")

"""Approximate nearest neighbours by learned partitions.

On a sample of at most ``sample_rows`` vectors (those of the smallest hashes) the
exact neighbour graph is built and cut into balanced parts: again and again a
part is ordered along a smooth vector of its graph (power iteration), halved at
the median, and improved by swaps that cut fewer edges.  A small softmax
classifier learns the part of a vector.  Every row is indexed under its most
probable part; a query goes to its ``probes`` most probable ones, where all rows
are compared by their exact distances.  ``probes`` is the smallest number that
reaches ``target`` of the neighbours within the sample.

There are ``parts`` parts at every size (a sample of fewer than four vectors a part
is one part).  Index and queries travel in blocks of bounded size.  Blocks of a
part are dealt over salts, one for each ``salt_rows`` rows that a part has on
average, and each block of queries goes to all of them, so a part with a third of
all rows (one vector many times, say) is many small pieces of work.  A query that finds fewer than ``k`` neighbours, though there are as many
rows, is sent to every part.

Vectors that are null or zero, hold nulls or numbers that are not finite, or have
another dimension than most of the sample take no part; rows with a null id
neither.  Ties go to the smaller id.  Rows that repeat an id count once, with
their smallest distance; a query never meets its own id.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilspark.llm.common import stored

SAMPLE_ROWS, PARTS, TARGET, SALT_ROWS, BLOCK, K = 4000, 16, 0.94, 20_000, 2048, 10


def neighbour_graph(x: np.ndarray, k: int) -> np.ndarray:
    """The k nearest rows of each row (itself left out)."""
    n, k = len(x), min(k, len(x) - 1)
    out = np.zeros((n, k), np.int64)
    norms = (x * x).sum(1)
    for at in range(0, n, 1024):
        d = norms[None, :] - 2 * x[at : at + 1024] @ x.T
        d[np.arange(len(d)), np.arange(at, at + len(d))] = np.inf
        out[at : at + 1024] = np.argpartition(d, k - 1, axis=1)[:, :k] if k else out[at : at + 1024]
    return out


def balanced_parts(graph: np.ndarray, parts: int, seed: int = 7) -> np.ndarray:
    """Part of each node; parts (a power of two) differ by one node at most for each level of halving."""
    n = len(graph)
    label = np.zeros(n, np.int64)
    a, b = np.repeat(np.arange(n), graph.shape[1]), graph.ravel()
    a, b = np.concatenate([a, b]), np.concatenate([b, a])
    rng = np.random.default_rng(seed)
    level = 1
    while level < parts:
        new = label * 2
        for part in range(level):
            nodes = np.flatnonzero(label == part)
            m = len(nodes)
            if m < 2:
                continue
            place = np.full(n, -1)
            place[nodes] = np.arange(m)
            inside = (place[a] >= 0) & (place[b] >= 0)
            u, v = place[a[inside]], place[b[inside]]
            degree = np.bincount(u, minlength=m) + 1.0
            f = rng.standard_normal(m)
            for _ in range(60):
                f -= (f * degree).sum() / degree.sum()
                f = 0.5 * f + 0.5 * (np.bincount(u, weights=f[v], minlength=m) + f) / degree
                f /= max(np.abs(f).max(), 1e-300)
            side = np.zeros(m, bool)
            side[np.argsort(f, kind="stable")[m // 2 :]] = True
            for _ in range(20):  # swap the nodes that gain most
                other = np.bincount(u, weights=side[v] != side[u], minlength=m)
                gain = 2 * other - np.bincount(u, minlength=m)
                left, right = np.flatnonzero(~side), np.flatnonzero(side)
                left, right = left[np.argsort(-gain[left], kind="stable")], right[np.argsort(-gain[right], kind="stable")]
                q = min(len(left), len(right), max(1, m // 50))
                good = int((gain[left[:q]] + gain[right[:q]] > 2).sum())
                if not good:
                    break
                side[left[:good]], side[right[:good]] = True, False
            new[nodes] += side
        label, level = new, level * 2
    return label


@dataclass
class Router:
    """The classifier: a layer of tanh units and a softmax over parts."""

    mean: np.ndarray
    scale: float
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: np.ndarray
    probes: int

    def ranked(self, x: np.ndarray) -> np.ndarray:
        """Parts of each vector, the most probable first."""
        h = np.tanh((x - self.mean) / self.scale @ self.w1 + self.b1)
        return np.argsort(-(h @ self.w2 + self.b2), axis=1, kind="stable")


def fitted(x: np.ndarray, parts: int, k: int = K, target: float = TARGET, seed: int = 7, steps: int = 800) -> Router:
    """Graph, parts and classifier from a sample."""
    n, dim = x.shape
    mean = x.mean(0) if n else np.zeros(dim)
    scale = max(float((x - mean).std()), 1e-12) if n else 1.0
    if parts == 1 or n < 4 * parts:
        return Router(mean, scale, np.zeros((dim, 1)), np.zeros(1), np.zeros((1, 1)), np.zeros(1), 1)
    graph = neighbour_graph(x, k)
    label = balanced_parts(graph, parts, seed)
    rng = np.random.default_rng(seed)
    hidden = 128
    p = [rng.standard_normal((dim, hidden)) / np.sqrt(dim), np.zeros(hidden), rng.standard_normal((hidden, parts)) / np.sqrt(hidden), np.zeros(parts)]
    m, v = [np.zeros_like(q) for q in p], [np.zeros_like(q) for q in p]
    z = (x - mean) / scale
    for step in range(1, steps + 1):
        rows = rng.integers(0, n, 256)
        h = np.tanh(z[rows] @ p[0] + p[1])
        o = h @ p[2] + p[3]
        o = np.exp(o - o.max(1, keepdims=True))
        o /= o.sum(1, keepdims=True)
        o[np.arange(len(rows)), label[rows]] -= 1
        o /= len(rows)
        back = (o @ p[2].T) * (1 - h * h)
        grads = [z[rows].T @ back + 1e-4 * p[0], back.sum(0), h.T @ o + 1e-4 * p[2], o.sum(0)]
        for q, g, a, b in zip(p, grads, m, v, strict=True):
            a += 0.1 * (g - a)
            b += 0.01 * (g * g - b)
            q -= 3e-3 * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.99**step)) + 1e-8)
    router = Router(mean, scale, *p, parts)
    ranked = router.ranked(x)
    place = np.empty_like(ranked)
    np.put_along_axis(place, ranked, np.arange(parts)[None, :], axis=1)
    needed = place[np.repeat(np.arange(n), graph.shape[1]), ranked[graph.ravel(), 0]]  # probes that each true neighbour takes
    router.probes = int(np.searchsorted(np.cumsum(np.bincount(needed, minlength=parts)) / len(needed), target)) + 1
    return router


def usable(vector: Column) -> Column:
    """Whether a vector takes part."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & (F.size(vector) > 0) & ~F.coalesce(bad, F.lit(True)) & F.exists(vector, lambda x: x != 0)


def nearest(x: np.ndarray, ids: np.ndarray, q: np.ndarray, q_ids: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each query its k nearest of the given rows, exactly: ids and distances."""
    norms = (x * x).sum(1)
    for at in range(0, len(q), 256):
        part = q[at : at + 256]
        d = norms[None, :] - 2 * part @ x.T + (part * part).sum(1)[:, None]
        slack = 1e-9 * (norms.max(initial=0.0) + (part * part).sum(1)) + 1e-300
        for i in range(len(part)):
            others = ids != q_ids[at + i]
            own = np.flatnonzero(others)
            if len(own) > k:
                # Rounding of the fast form may blur the limit, so all within its error are measured again.
                limit = np.partition(d[i, own], k - 1)[k - 1] + 2 * slack[i]
                own = own[d[i, own] <= limit]
            exact = np.sqrt(((x[own] - part[i]) ** 2).sum(1))
            order = np.lexsort((ids[own], exact))
            own, exact = own[order], exact[order]
            _, first = np.unique(ids[own], return_index=True)
            if len(first) < min(len(own), k) and len(np.unique(ids[others])) > len(first):
                own = np.flatnonzero(others)  # many rows of few ids: measure them all
                exact = np.sqrt(((x[own] - part[i]) ** 2).sum(1))
                order = np.lexsort((ids[own], exact))
                own, exact = own[order], exact[order]
                _, first = np.unique(ids[own], return_index=True)
            first = np.sort(first)[:k]
            yield int(q_ids[at + i]), ids[own[first]], exact[first]


def _blocks(vectors: DataFrame, router, probes: int | None, block: int) -> DataFrame:
    """Rows (part, ids, vectors): blocks of the rows under each of their first ``probes`` parts."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r, out = router.value, {}

        def row(part: int, held: list) -> pa.RecordBatch:
            ids, x = (np.concatenate(y) for y in zip(*held, strict=True))
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([ids.tobytes()], pa.binary()), pa.array([x.tobytes()], pa.binary())], ["part", "ids", "vectors"])

        for batch in batches:
            if not batch.num_rows:
                continue
            ids = batch.column(0).to_numpy()
            x = np.array(batch.column(1).flatten().to_numpy(), np.float64).reshape(len(ids), -1)
            ranked = r.ranked(x)[:, : probes or r.w2.shape[1]]
            for part in np.unique(ranked):
                mine = (ranked == part).any(1)
                held = out.setdefault(int(part), [])
                for at in range(0, int(mine.sum()), block):
                    held.append((ids[mine][at : at + block], x[mine][at : at + block]))
                    if sum(len(y[0]) for y in held) >= block:
                        yield row(int(part), held)
                        held.clear()
        for part, held in out.items():
            if held:
                yield row(part, held)

    return vectors.mapInArrow(pack, "part int, ids binary, vectors binary")


def _searched(index: DataFrame, queries: DataFrame, router, probes: int | None, k: int, salts: int, block: int) -> DataFrame:
    rows = _blocks(index, router, 1, block).withColumn("salt", F.pmod(F.xxhash64("ids"), F.lit(salts)).cast("int"))
    asks = _blocks(queries, router, probes, block // 2).select("part", F.col("ids").alias("q_ids"), F.col("vectors").alias("q_vectors"), F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, c, d in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                ids, q_ids = np.frombuffer(a, np.int64), np.frombuffer(c, np.int64)
                x, q = np.frombuffer(b).reshape(len(ids), -1), np.frombuffer(d).reshape(len(q_ids), -1)
                found = list(nearest(x, ids, q, q_ids, k))
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(np.repeat([f[0] for f in found], [len(f[1]) for f in found]).astype(np.int64)), pa.array(np.concatenate([f[1] for f in found])), pa.array(np.concatenate([f[2] for f in found]))], ["query_id", "vec_id", "score"])

    pairs = rows.join(asks, ["part", "salt"]).select("ids", "vectors", "q_ids", "q_vectors")
    return pairs.mapInArrow(compare, "query_id bigint, vec_id bigint, score double").groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))


def search(df: DataFrame, queries: Column, vec_id: str = "vec_id", vector: str = "embedding", k: int = K, sample_rows: int = SAMPLE_ROWS, parts: int = PARTS, target: float = TARGET, salt_rows: int = SALT_ROWS) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` nearest rows found for each row that satisfies ``queries`` (a condition on ``df``)."""
    v = F.transform(F.col(f"`{vector}`"), lambda x: x.cast("double"))
    rows = df.select(F.col(f"`{vec_id}`").cast("bigint").alias("id"), v.alias("v"), F.coalesce(queries, F.lit(False)).alias("asked")).where(F.col("id").isNotNull() & usable(F.col("v")))
    n, dims = rows.agg(F.count("*"), F.mode(F.size("v"))).first()
    if not n:
        return rows.select(F.col("id").alias("query_id"), F.lit(1).alias("rank"), F.col("id").alias("vec_id"), F.lit(0.0).alias("score")).limit(0)
    rows = rows.where(F.size("v") == dims)
    hashed = F.xxhash64("v", "id")
    bound = int(min(1.0, 1.2 * sample_rows / n) * 2**64) - 2**63 - 1
    sample = rows.where(hashed <= F.lit(bound)).select(hashed.alias("h"), "v").orderBy("h").limit(sample_rows).collect()
    salts = int(n // (parts * salt_rows)) + 1
    x = np.array([r.v for r in sample], np.float64).reshape(len(sample), dims)
    router = df.sparkSession.sparkContext.broadcast(fitted(np.unique(x, axis=0), parts, k, target))
    index, asked = rows.select("id", "v"), rows.where("asked").select("id", "v")
    found = stored(_searched(index, asked, router, router.value.probes, k, salts, BLOCK), "neighbours")
    if router.value.w2.shape[1] > 1:
        counted = asked.select(F.col("id").alias("query_id")).distinct().join(found.groupBy("query_id").agg(F.count("*").alias("n")), "query_id", "left")
        poor = stored(counted.where(F.coalesce("n", F.lit(0)) < min(k, n - 1)).select(F.col("query_id").alias("id")), "poor")
        if poor.limit(1).count():
            found = found.join(poor, found["query_id"] == poor["id"], "left_anti").unionByName(_searched(index, asked.join(poor, "id", "left_semi"), router, None, k, salts, BLOCK))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

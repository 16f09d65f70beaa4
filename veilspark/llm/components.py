"""Connected components of a graph given as a table of edges: forests of the tasks, joined by node, and paths halved."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilspark.llm.common import dropped, stored

#: Edges after which a task puts its forest in the place of what it has read.
HELD = 1 << 20


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of the edges between ``a`` and ``b``, ascending, and for each the place of the smallest one reachable."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    root = np.arange(len(nodes))
    while len(x):
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while not np.array_equal(root, above := root[root]):
            root = above
        x, y = root[x], root[y]
        x, y = x[x != y], y[x != y]
    return nodes, root


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (columns a and b, of one orderable type); root is the smallest node reachable.

    A task that reads edges gives each of its nodes the smallest one that it
    knows to be reachable, so no node has more rows than there are tasks, and
    rows are shuffled by node.  What meets there is joined likewise, and a round
    of it and of halving the paths is repeated until nothing changes.  Edges with
    nulls are skipped; a loop gives its node alone.
    """
    kind = edges.schema["a"].dataType.simpleString()
    names = ["node", "root", "moved"]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def made() -> tuple[np.ndarray, np.ndarray]:
            nodes, root = forest(np.concatenate([x for x, _ in held]), np.concatenate([y for _, y in held]))
            return nodes, nodes[root]

        for batch in batches:
            held.append((batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False)))
            n += batch.num_rows
            if n > HELD:
                held = [made()]
                n = 0
        if held:
            nodes, roots = made()
            yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(roots)], ["node", "root"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One row for each node that has come here, and one for each other node that is now known to reach a smaller one."""
        rows = list(batches)
        if not rows:
            return
        table = pa.Table.from_batches(rows)
        node, root, moved = (table[n].to_numpy() for n in names)
        nodes, least = forest(node, root)
        at, to = np.searchsorted(nodes, node), np.searchsorted(nodes, root)
        own, known = np.full(len(nodes), len(nodes)), np.zeros(len(nodes), bool)
        np.minimum.at(own, at, to)
        np.logical_or.at(known, at, moved)
        here = own < len(nodes)
        out = here | (least != np.arange(len(nodes)))
        yield pa.RecordBatch.from_arrays([pa.array(nodes[out]), pa.array(nodes[least][out]), pa.array((~here | known | (least != own))[out])], names)

    shape = f"node {kind}, root {kind}"
    near = edges.select("a", "b").where("a is not null and b is not null").mapInArrow(read, shape).withColumn("moved", F.lit(False))
    now = stored(near.repartition("node").mapInArrow(meet, f"{shape}, moved boolean"), "edges")
    while True:
        above = now.groupBy(F.col("node").alias("root")).agg(F.min("root").alias("above"))
        halved = now.join(above, "root").select("node", F.col("above").alias("root"), (F.col("above") < F.col("root")).alias("moved"))
        after = stored(halved.repartition("node").mapInArrow(meet, f"{shape}, moved boolean"), "edges")
        dropped(edges.sparkSession, now)
        now = after
        if not now.where("moved").limit(1).count():
            return now.select("node", "root")

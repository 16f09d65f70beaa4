"""The trie of conversations by partition refinement.

Conversations are sequences of turns; equal sequences are one element with its
members counted.  All elements start in one class at depth 0.  A round takes the
next turns of the elements that are still in a class with others, and splits
each class by them, depth by depth; an element that is alone in its class is
retired, and its tail becomes a chain of nodes without further splitting.  A
round covers twice the depths of the round before, so that the rounds grow with
the logarithm of the longest shared beginning, and no element is looked at for
more than about twice the depths that it shares.

Two elements are in one class at a depth if all their turns up to it are equal.
That is told by digests of beginnings (128 bits of SHA-256), which are chained
in blocks of BLOCK turns, blocks in blocks of blocks: a conversation with a third
of all turns is many small groups.  Places of turns come from ranges of one order
(:mod:`veilspark.llm.ordering`) for the same reason.

*Folding back.*  What a node needs to know of its subtree is a sum over the
elements in its class: members, leaves, and tokens, for which each node is put
down to its smallest member.  So the way back is one aggregation over the
classes that were stored, not a walk from the leaves.

A node is named by its depth and the smallest id among its members.  Nulls: null
turns come first, a null role or text is empty, rows with a null conversation
belong to none and are left out.  Turns of one number go by a digest of role and
text; repeated rows are turns of their own.  An empty table has no nodes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilspark.llm.common import dropped, stored, trimmed
from veilspark.llm.ordering import placed

#: Turns whose beginnings one group chains; depths of the first round; ids in one piece of a list of members.
BLOCK, FIRST, PIECE = 64, 8, 4096


def _digest(*parts: Column) -> Column:
    """16 bytes of the SHA-256 of parts, each with its length in front."""
    return F.unhex(F.substring(F.sha2(F.concat(*(F.concat(F.octet_length(p).cast("string"), F.lit(":"), p) for p in parts)), 256), 1, 32))


def turns_of(rows: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, pos, digest, bytes): the turns of each conversation from 0, in order."""
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    staged = rows.where(F.col(f"`{conv_id}`").isNotNull()).select(
        F.col(f"`{conv_id}`").cast("long").alias("conv"), F.col(f"`{turn}`").alias("turn"), _digest(F.coalesce(F.col(f"`{role}`"), F.lit("")), body).alias("digest"), F.octet_length(body).cast("long").alias("bytes")
    )
    return placed(staged, ["conv"], [F.col("turn").asc_nulls_first(), F.col("digest").asc()], "pos").drop("turn")


def chained(rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """``rows`` (conv, pos, digest, bytes; pos from 0 without gaps) as (conv, depth, prefix, upto, bytes): digest and bytes of the first depth = pos + 1 turns."""

    def level(rows: DataFrame, longest: int) -> DataFrame:
        """(conv, pos, prefix, upto, bytes)"""
        item = F.struct("pos", "digest", "bytes")
        groups = rows.groupBy("conv", F.floor(F.col("pos") / block).alias("block")).agg(F.array_sort(F.collect_list(item)).alias("items"))  # at most ``block`` items
        digests = F.transform("items", lambda x: x["digest"])
        whole = F.unhex(F.substring(F.sha2(F.array_join(F.transform(digests, F.hex), ""), 256), 1, 32))
        groups = groups.withColumn("sum", F.aggregate("items", F.lit(0).cast("long"), lambda a, x: a + x["bytes"]))
        if longest >= block:
            groups = stored(groups, "blocks")
            heads = level(groups.select("conv", F.col("block").alias("pos"), whole.alias("digest"), F.col("sum").alias("bytes")), longest // block)
            heads = heads.select("conv", (F.col("pos") + 1).alias("block"), F.col("prefix").alias("before"), F.col("upto").alias("base"))
            groups = groups.join(heads, ["conv", "block"], "left")
        else:
            groups = groups.withColumn("before", F.lit(None).cast("binary")).withColumn("base", F.lit(None).cast("long"))
        before, base = F.coalesce(F.hex("before"), F.lit("")), F.coalesce("base", F.lit(0))
        own = F.transform(F.col("items"), lambda x, i: F.struct(
            x["pos"].alias("pos"),
            F.unhex(F.substring(F.sha2(F.concat(before, F.array_join(F.transform(F.slice(digests, F.lit(1), i + 1), F.hex), "")), 256), 1, 32)).alias("prefix"),
            (base + F.aggregate(F.slice(F.col("items"), F.lit(1), i + 1), F.lit(0).cast("long"), lambda a, y: a + y["bytes"])).alias("upto"),
            x["bytes"].alias("bytes"),
        ))
        return groups.select("conv", F.explode(own).alias("x")).select("conv", "x.*")

    longest = rows.agg(F.max("pos")).first()[0] or 0
    return level(rows, longest).select("conv", (F.col("pos") + 1).cast("long").alias("depth"), "prefix", "upto", "bytes")


def members_digest(members: DataFrame) -> DataFrame:
    """(element, ends_sha256) of ``members`` (element, conv): the SHA-256 of an element's ids in ascending order, comma-joined.

    Ids are joined in pieces within ranges of the order; then a task walks the
    pieces of its elements with one running digest, and holds one piece.
    """

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def full(pieces: list[list]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([p[0] for p in pieces], pa.int64()), pa.array([p[1] for p in pieces], pa.int64()), pa.array([",".join(p[2]) for p in pieces], pa.string())], ["element", "first", "ids"])

        pieces: list[list] = []
        for batch in batches:
            for e, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if pieces and pieces[-1][0] == e and len(pieces[-1][2]) < PIECE:
                    pieces[-1][2].append(str(c))
                else:
                    pieces.append([e, c, [str(c)]])
            if len(pieces) > 1:
                yield full(pieces[:-1])
                pieces = pieces[-1:]
        if pieces:
            yield full(pieces)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, running = None, None
        for batch in batches:
            done: list[tuple] = []
            for e, ids in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if e == now:
                    running.update(b"," + ids.encode())
                    continue
                if running:
                    done.append((now, running.hexdigest()))
                now, running = e, hashlib.sha256(ids.encode())
            yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.int64()), pa.array([d[1] for d in done], pa.string())], ["element", "ends_sha256"])
        if running:
            yield pa.RecordBatch.from_arrays([pa.array([now], pa.int64()), pa.array([running.hexdigest()])], ["element", "ends_sha256"])
        trimmed()

    ordered = members.select("element", "conv").repartitionByRange("element", "conv").sortWithinPartitions("element", "conv")
    pieces = stored(ordered.mapInArrow(join, "element bigint, first bigint, ids string"), "pieces")
    return pieces.repartition("element").sortWithinPartitions("element", "first").mapInArrow(walk, "element bigint, ends_sha256 string")


def elements_of(chains: DataFrame, convs: DataFrame) -> DataFrame:
    """(conv, element, length, total): the element of each of ``convs`` (conv, length), named by its smallest conversation."""
    last = chains.select("conv", F.col("depth").alias("length"), "prefix", F.col("upto").alias("total"))
    ends = convs.join(last, ["conv", "length"], "left").select("conv", "length", F.coalesce("prefix", F.lit(b"")).alias("prefix"), F.coalesce("total", F.lit(0)).alias("total"))
    ends = stored(ends, "ends")
    names = ends.groupBy("length", "prefix").agg(F.min("conv").alias("element"))
    return ends.join(names, ["length", "prefix"]).select("conv", "element", "length", "total")


def refined(chains: DataFrame, elements: DataFrame, first: int = FIRST) -> DataFrame:
    """(element, depth, label, n): the class of each element at each depth, until it is alone (n = 1) or ends.

    ``chains`` (element, depth, prefix), ``elements`` (element, length).  ``label``
    is the smallest element of the class, ``n`` how many elements it has.
    """
    label, n = elements.agg(F.min("element"), F.count("*")).first()
    levels = [stored(elements.select("element", F.lit(0).cast("long").alias("depth"), F.lit(label).cast("long").alias("label"), F.lit(n).cast("long").alias("n")), "level")]
    active = levels[0].where("n > 1").select("element")
    low, width = 0, first
    while active.limit(1).count():
        some = chains.where((F.col("depth") > low) & (F.col("depth") <= low + width)).select("element", "depth", "prefix").join(active, "element")
        some = stored(some, "turns")
        classes = some.groupBy("depth", "prefix").agg(F.min("element").alias("label"), F.count("*").alias("n"))
        split = stored(some.join(classes, ["depth", "prefix"]).select("element", "depth", "label", "n"), "level")
        alone = split.where("n = 1").groupBy("element").agg(F.min("depth").alias("alone"))
        levels.append(stored(split.join(alone, "element", "left").where("alone is null or depth <= alone").select("element", "depth", "label", "n"), "level"))
        dropped(chains.sparkSession, some, split)
        low += width
        width *= 2
        active = stored(levels[-1].groupBy("element").agg(F.max("depth").alias("at"), F.min("n").alias("n")).where((F.col("n") > 1) & (F.col("at") == low)).select("element"), "active")
    return reduce(DataFrame.unionByName, levels)


def folded(rows: DataFrame, convs: DataFrame, first: int = FIRST, block: int = BLOCK) -> DataFrame:
    """Nodes: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    ``rows``: the turns (conv, pos, digest, bytes); ``convs``: every conversation
    (conv, length), those without turns too.
    """
    every = stored(chained(rows, block), "chains")
    members = stored(elements_of(every, convs), "elements")
    elements = members.groupBy("element").agg(F.count("*").alias("members"), F.first("length").alias("length"), F.first("total").alias("total"))
    elements = stored(elements, "elements")
    chains = every.select(F.col("conv").alias("element"), "depth", "prefix", "upto", "bytes").join(elements.select("element"), "element", "left_semi")
    levels = stored(refined(chains, elements, first), "levels")
    digests = stored(members_digest(members), "digests")

    # An element's own nodes start where it is the smallest of its class; what stands before them is another's.
    marks = levels.groupBy("element").agg(F.min(F.when(F.col("n") == 1, F.col("depth"))).alias("alone"), F.min(F.when(F.col("label") == F.col("element"), F.col("depth"))).alias("owner"))
    facts = elements.join(marks, "element")
    upto = chains.select("element", (F.col("depth") + 1).alias("next"), "upto")
    facts = facts.join(upto.select("element", F.col("next").alias("owner"), F.col("upto").alias("before")), ["element", "owner"], "left")
    owned = F.when(F.col("owner").isNull(), 0).otherwise(F.col("total") - F.coalesce("before", F.lit(0))).cast("long")
    facts = stored(facts.select("element", "members", "length", "total", "alone", owned.alias("owned")), "facts")

    # Classes of several elements: sums over their elements.
    inside = levels.where("n > 1").join(facts, "element")
    other = F.col("element") != F.col("label")
    nodes = inside.groupBy("depth", "label").agg(
        F.sum("members").alias("n_convs"),
        F.sum(F.col("members") * F.col("total")).alias("sum_total"),
        F.count("alone").alias("n_leaves"),
        F.sum(F.when(other, F.col("owned")).otherwise(F.col("total"))).alias("distinct_total"),
        F.max(F.when(F.col("length") == F.col("depth"), F.col("element"))).alias("ending"),
    )
    nodes = nodes.join(upto.select(F.col("element").alias("label"), F.col("next").alias("depth"), "upto"), ["label", "depth"], "left").withColumn("upto", F.coalesce("upto", F.lit(0)))
    parents = levels.select(F.col("element").alias("label"), (F.col("depth") + 1).alias("depth"), F.col("label").alias("parent"))
    nodes = stored(nodes.join(parents, ["label", "depth"], "left"), "nodes")
    heads = facts.where("alone is not null").select(F.col("element").alias("label"), F.col("alone").alias("depth")).join(parents, ["label", "depth"], "left")
    heads = stored(heads, "heads")
    children = nodes.select("depth", "parent").union(heads.select("depth", "parent")).where("parent is not null").groupBy((F.col("depth") - 1).alias("depth"), F.col("parent").alias("label")).agg(F.count("*").alias("n_children"))
    trunk = nodes.join(children, ["depth", "label"], "left").select(
        F.col("label").alias("conv_id"), "depth", F.col("parent").alias("parent_conv_id"), "n_convs", F.coalesce("n_children", F.lit(0)).alias("n_children"), "n_leaves",
        (F.col("sum_total") - F.col("n_convs") * F.col("upto") - F.col("distinct_total") + F.col("upto")).alias("saved_tokens"), F.col("ending").alias("element"),
    )

    # Elements that are alone: a chain from there to their end.
    root = facts.select("element", F.lit(0).cast("long").alias("depth"), F.lit(0).cast("long").alias("upto"), F.lit(0).cast("long").alias("bytes"))
    tails = chains.select("element", "depth", "upto", "bytes").unionByName(root).join(facts.where("alone is not null"), "element").where("depth >= alone")
    tails = tails.join(heads.select(F.col("label").alias("element"), "depth", "parent"), ["element", "depth"], "left")
    last = F.col("depth") == F.col("length")
    chain = tails.select(
        F.col("element").alias("conv_id"), "depth", F.when(F.col("depth") == F.col("alone"), F.col("parent")).otherwise(F.col("element")).alias("parent_conv_id"), F.col("members").alias("n_convs"),
        F.when(last, 0).otherwise(1).cast("long").alias("n_children"), F.lit(1).cast("long").alias("n_leaves"),
        ((F.col("members") - 1) * (F.col("total") - F.col("upto") + F.col("bytes"))).alias("saved_tokens"), F.when(last, F.col("element")).alias("element"),
    )
    out = trunk.unionByName(chain).join(digests, "element", "left")
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"))


def branched(turns: DataFrame, of: int = 5, upto: int = 9) -> tuple[DataFrame, DataFrame]:
    """Conversations rebuilt from shared beginnings: turns (conv, pos, digest, bytes), and (conv, length) of all.

    Conversation c starts with the first h turns of c - c % ``of`` and goes on
    with its own after its first h; h is the unsigned crc32 of c's digits modulo
    ``upto``.
    """
    sizes = stored(turns.groupBy("conv").agg(F.count("*").alias("own")), "sizes")
    h = F.crc32(F.col("conv").cast("string").cast("binary")) % upto
    plan = sizes.select("conv", "own", h.alias("h"), (F.col("conv") - F.col("conv") % of).alias("from"))
    plan = plan.join(sizes.select(F.col("conv").alias("from"), F.col("own").alias("there")), "from", "left")
    plan = stored(plan.select("conv", "from", "h", "own", F.least("h", F.coalesce("there", F.lit(0))).alias("taken")), "plan")
    heads = turns.where(F.col("pos") < upto - 1).select(F.col("conv").alias("from"), "pos", "digest", "bytes")
    begun = plan.join(heads, "from").where("pos < h").select("conv", "pos", "digest", "bytes")
    rest = turns.join(plan, "conv").where("pos >= h").select("conv", (F.col("pos") - F.col("h") + F.col("taken")).alias("pos"), "digest", "bytes")
    return stored(begun.unionByName(rest), "rebuilt"), plan.select("conv", (F.col("taken") + F.greatest(F.col("own") - F.col("h"), F.lit(0))).alias("length"))


def conversation_trie(rows: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", first: int = FIRST, block: int = BLOCK) -> DataFrame:
    """The trie of the rebuilt conversations; columns as :func:`folded`."""
    turns = stored(turns_of(rows, conv_id, turn, role, text), "turns")
    rebuilt, convs = branched(turns)
    return folded(rebuilt, convs, first, block)

"""Shards by weighted rendezvous hashing: a record's key and the shards' weights decide, nothing else.

Each shard draws a number in (0, 1) for each key from a digest of both, and a
record goes to the shard with the smallest ``-ln(number) / weight``.  A shard
gets its weight's share of the keys.  A new shard changes no draw of the others,
so it only takes records into itself, and a removed one only gives its own away;
a changed weight moves records to or from that shard alone.

Draws are built-in expressions in one projection over the scan: no shuffle, no
Python.  Places within shards (:func:`slotted`) come from ranges of one order,
so a shard, a key or a group of copies with a third of all rows is no window.

Nulls: a null key is one key like another, apart from the empty one; a null text
has no bytes.  Repeated rows and rows with one key share a shard (the law is the
key's alone), each with a slot of its own.  Columns named like those that are
added are replaced; an empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilspark.llm.ordering import placed

SHARDS = 24
#: Bytes that a record costs besides its text.
OVERHEAD = 8
#: Hexadecimal digits of a digest that make a draw.
DIGITS = 13


def stable_key(*columns: Column) -> Column:
    """One text for the values of a key: each with its length in front, nulls apart from everything else."""
    return F.concat(*(F.coalesce(F.concat(F.length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string")), F.lit("-")) for c in columns))


def draw(key: Column, shard: int) -> Column:
    """A number in (0, 1) that a shard draws for a key."""
    digits = F.substring(F.md5(F.concat(key, F.lit(f"/{shard}")).cast("binary")), 1, DIGITS)
    return (F.conv(digits, 16, 10).cast("double") + 0.5) / float(16**DIGITS)


def _bid(key: Column, shard: int, weight: float) -> Column:
    return F.struct((-F.log(draw(key, shard)) / F.lit(float(weight))).alias("cost"), F.lit(shard).alias("shard"))


def _lowest(bids: Sequence[Column]) -> Column:
    return bids[0] if len(bids) == 1 else F.least(*bids)


def weights_of(shards: int | Mapping[int, float]) -> dict[int, float]:
    """Weights by shard; a number means so many equal shards from 0.  Shards of weight 0 take nothing."""
    named = dict.fromkeys(range(shards), 1.0) if isinstance(shards, int) else dict(shards)
    if any(w < 0 for w in named.values()) or not any(named.values()):
        raise ValueError("weights must not be negative, and one must be above 0")
    return {s: float(w) for s, w in sorted(named.items()) if w}


def shard_of(key: Column, shards: int | Mapping[int, float] = SHARDS) -> Column:
    """The shard of a key (int)."""
    return _lowest([_bid(key, s, w) for s, w in weights_of(shards).items()])["shard"]


def sharded(rows: DataFrame, key: Sequence[str], shards: int | Mapping[int, float] = SHARDS, grown: Mapping[int, float] | None = None, out: str = "shard", grown_out: str = "grown_shard") -> DataFrame:
    """``rows`` with their shard, and with the one that they have once the shards of ``grown`` (shard: weight) are there too."""
    weights = weights_of(shards)
    if grown and set(grown) & set(weights):
        raise ValueError("a grown shard must be a new one")
    text = stable_key(*(F.col(f"`{k}`") for k in key))
    staged = rows.withColumn("__best", _lowest([_bid(text, s, w) for s, w in weights.items()]))
    out_rows = staged.withColumn(out, F.col("__best.shard"))
    if grown:
        more = [_bid(text, s, w) for s, w in weights_of(grown).items()]
        out_rows = out_rows.withColumn(grown_out, F.least(F.col("__best"), *more)["shard"])
    return out_rows.drop("__best")


def slotted(rows: DataFrame, order: Sequence[str], shard: str = "shard", out: str = "slot") -> DataFrame:
    """``rows`` with a gapless place (from 0) within their shard, by ``order`` (nulls first)."""
    return placed(rows.drop(out), [shard], [F.col(f"`{c}`").asc_nulls_first() for c in order], out)


def moved(rows: DataFrame, key: Sequence[str], before: int | Mapping[int, float], after: int | Mapping[int, float]) -> DataFrame:
    """(from_shard, to_shard, n_rows) of what a change of shards or weights moves."""
    text = stable_key(*(F.col(f"`{k}`") for k in key))
    both = rows.select(shard_of(text, before).alias("from_shard"), shard_of(text, after).alias("to_shard"))
    return both.where("from_shard <> to_shard").groupBy("from_shard", "to_shard").agg(F.count("*").alias("n_rows"))


def balance(rows: DataFrame, size: Column, shards: int | Mapping[int, float] = SHARDS, shard: str = "shard") -> DataFrame:
    """(shard, weight, n_rows, n_bytes, row_share, due_share) of every shard, empty ones too."""
    weights = weights_of(shards)
    spark = rows.sparkSession
    due = spark.createDataFrame([(s, w, w / sum(weights.values())) for s, w in weights.items()], f"{shard} int, weight double, due_share double")
    seen = rows.groupBy(shard).agg(F.count("*").alias("n_rows"), F.sum(size).alias("n_bytes"))
    share = F.coalesce(F.col("n_rows") / F.sum("n_rows").over(Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)), F.lit(0.0))  # one row a shard
    return due.join(seen, shard, "left").select(shard, "weight", F.coalesce("n_rows", F.lit(0)).alias("n_rows"), F.coalesce("n_bytes", F.lit(0)).alias("n_bytes"), share.alias("row_share"), "due_share")


def record_size(text: Column) -> Column:
    """Bytes of a record: those of its text in UTF-8, and OVERHEAD."""
    return (F.coalesce(F.octet_length(text), F.lit(0)) + OVERHEAD).cast("long")


def write_shards(rows: DataFrame, path: str, shard: str = "shard", slot: str = "slot") -> None:
    """One folder of Parquet files a shard, in the order of slots; a shard of many rows is several files."""
    rows.repartitionByRange(F.col(shard), F.col(slot)).sortWithinPartitions(shard, slot).write.partitionBy(shard).parquet(path)


def shard_table(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shards: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard of every document, by the law of the key.

    Slots follow a digest of the id, then size and checksum, so they are spread
    over ids and do not depend on how the table is cut into files.
    """
    body = F.col(f"`{text}`")
    records = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), record_size(body).alias("size"), F.crc32(F.coalesce(body, F.lit("")).cast("binary")).alias("text_crc32"))
    records = sharded(records, ["doc_id"], shards, {shards: 1.0})
    out = slotted(records.withColumn("__digest", F.md5(stable_key(F.col("doc_id")).cast("binary"))), ["__digest", "size", "text_crc32"])
    return out.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")

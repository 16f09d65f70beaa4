"""Masking of a stream of documents; only the numbering of values has state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilspark.operators import detect, mapping, rows
from veilspark.operators import spans as S
from veilspark.operators.rules import Rule


def mask_batch(spark: SparkSession, docs: DataFrame, rules: list[Rule], table: str, batch: int) -> DataFrame:
    """Mask one batch with the numbers given so far, and add those of its new values to ``table`` (a folder).

    Each batch writes its own part of the table, so a repeated batch writes the
    same part again and numbers stay as they were.
    """
    found = detect.detect(rows.keyed(docs), rules).select("doc_id", rows.ROW, S.accepted(S.resolve(F.col("findings"))).alias("findings"))
    found = detect.long(found, keep=("doc_id", rows.ROW))
    schema = "value string, prefix string, number bigint, placeholder string, batch int"
    try:
        known = spark.read.schema(schema).parquet(table).where(F.col("batch") < batch)
        known.take(1)
    except Exception as e:  # noqa: BLE001
        if "PATH_NOT_FOUND" not in str(e):
            raise
        known = spark.createDataFrame([], schema)
    new = mapping.first_occurrences(found.join(known.select("value"), "value", "left_anti"), ["doc_id", "start"])
    last = known.groupBy("prefix").agg(F.max("number").alias("last"))
    numbered = mapping.numbered(new, ["doc_id", "start"]).join(last, "prefix", "left").withColumn("number", F.col("number") + F.coalesce("last", F.lit(0)))
    numbered = numbered.select("value", "prefix", "number", F.concat_ws("_", "prefix", F.col("number").cast("string")).alias("placeholder"))
    numbered.write.mode("overwrite").parquet(f"{table}/batch={batch}")
    mine = spark.read.schema("value string, prefix string, number bigint, placeholder string").parquet(f"{table}/batch={batch}")
    return mapping.masked(docs, found, known.select("value", "placeholder").unionByName(mine.select("value", "placeholder")))


def mask_stream(stream: DataFrame, rules: list[Rule], table: str, out: str, checkpoint: str):
    """Start masking a stream of (doc_id, text) into Parquet files below ``out``."""

    def each(batch: DataFrame, number: int) -> None:
        mask_batch(batch.sparkSession, batch, rules, table, number).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

"""Second passes: values known from elsewhere are masked where they still stand, and encoded texts are searched too."""

from __future__ import annotations

import hashlib
import hmac
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilspark.functions import checks
from veilspark.functions.text import line_of
from veilspark.operators import consistency, detect, mapping, phrases, prepare, rows
from veilspark.operators import spans as S
from veilspark.operators.rules import Rule
from veilspark.sources.shared import stored

ROUNDS = 3


def keyed_digest(df: DataFrame, value: str, key: str, out: str) -> DataFrame:
    """``df`` with the HMAC-SHA256 of a column, in hex; null stays null."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema if f.name != out) + f", `{out}` string"
    df = df.drop(out)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column(batch.schema.get_field_index(value)).to_pylist()
            signed = [None if v is None else hmac.new(key.encode(), str(v).encode(), hashlib.sha256).hexdigest() for v in values]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(signed, pa.string())], [*batch.schema.names, out])

    return df.mapInArrow(sign, schema)


def value_places(docs: DataFrame, values: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, row_key, start, end, value as it stands there, and all of ``values`` but value) of known values in texts, between word limits, case ignored.

    Values have any number of words (:mod:`veilspark.operators.phrases`); the
    longest of those that overlap counts, and placeholders are left alone.
    """
    other = [c for c in values.columns if c != "value"]
    found = phrases.places(docs, values, doc_id, text)
    known = phrases.phrase_table(values).join(values, "value").groupBy("phrase").agg(F.count("*").alias("__n"), *(F.min(c).alias(c) for c in other)).drop("__n")
    return found.join(known, "phrase").select(F.col("doc_id").alias(doc_id), rows.ROW, "start", "end", "value", *other)


def mask_known(docs: DataFrame, values: DataFrame, doc_id: str = "doc_id", text: str = "masked_text") -> DataFrame:
    """``docs`` with the known values that still stand in ``text`` replaced, and n_more."""
    own = rows.keyed(docs, text, doc_id)
    grouped = rows.spans_by_row(value_places(own, values, doc_id, text), rows.ROW, "start", "end", F.col("placeholder").alias("replacement"), out="__more")
    out = rows.attached(own, grouped, rows.ROW).withColumn("__more", F.coalesce("__more", F.array().cast(mapping.SPANS)))
    body = F.coalesce(F.col(text), F.lit(""))
    out = out.withColumn(text, F.when(F.size("__more") > 0, S.rebuild(body, F.col("__more"))).otherwise(body)).withColumn("n_more", F.size("__more").cast("long"))
    return out.drop("__more", *({rows.ROW} - set(docs.columns)))


def open_values(docs: DataFrame, values: DataFrame, doc_id: str = "doc_id", text: str = "masked_text") -> DataFrame:
    """(doc_id, n) of known values that still stand open."""
    return value_places(docs, values, doc_id, text).groupBy(doc_id).agg(F.count("*").alias("n"))


def encoded_leaks(docs: DataFrame, rules: list[Rule], doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, line, kind, entities) of encoded blocks whose decoded text holds findings; no values are shown."""
    blocks = prepare.decoded_blocks(docs, doc_id=doc_id, text=text)
    found = detect.detect(blocks, rules, "decoded", "f").withColumn("f", F.filter("f", lambda x: (x["source"] == "dictionary") | (x["confidence"] != "dusuk"))).where(F.size("f") > 0)
    lines = docs.select(F.col(doc_id).alias("__of"), F.col(text).alias("__t"))
    return found.join(lines, found[doc_id].eqNullSafe(lines["__of"])).select(doc_id, line_of(F.col("__t"), F.col("start")).alias("line"), "kind", F.array_sort(F.array_distinct(F.transform("f", lambda x: x["entity"]))).alias("entities"))


def suspicious_lines(text: Column) -> Column:
    """How many lines look encoded: 200 signs at least, nearly all of them from one alphabet, 4.5 bits a sign."""
    lines = F.split(F.coalesce(text, F.lit("")), r"\r?\n", -1)
    odd = lambda x: (F.length(x) >= 200) & (F.length(F.regexp_replace(x, "[^A-Za-z0-9+/=_-]", "")) >= F.length(x) * 0.95) & (checks.entropy(x) >= 4.5)
    return F.size(F.filter(lines, odd)).cast("long")


def consistent(docs: DataFrame, findings: DataFrame, table: DataFrame, rounds: int = ROUNDS, doc_id: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """Masked documents in which trusted values of other documents are masked too, and the mapping with what that adds.

    A value is looked for whatever its case and form, but its own spelling is
    what the mapping holds, so that texts come back exactly.  New spellings are
    numbered after all others.  After each round the texts are searched again, as
    a replacement may set free what overlapped it; rounds end when nothing is
    found, or after ``rounds``.
    """
    trusted = consistency.registry(findings).where("authoritative").select("value_key")
    own = rows.keyed(docs, "masked_text", doc_id)
    for _ in range(min(rounds, ROUNDS)):
        values = table.join(trusted, F.lower(table["value"]) == trusted["value_key"], "left_semi").select("value", "prefix")
        places = stored(value_places(own, values, doc_id, "masked_text"), "places")
        if not places.limit(1).count():
            break
        new = mapping.first_occurrences(places.join(table.select("value"), "value", "left_anti"), [doc_id, "start"])
        last = table.groupBy("prefix").agg(F.max("number").alias("__last"))
        more = mapping.numbered(new, [doc_id, "start"]).join(last, "prefix", "left").withColumn("number", F.col("number") + F.coalesce("__last", F.lit(0)))
        more = more.select("value", "prefix", "number", F.concat_ws("_", "prefix", F.col("number").cast("string")).alias("placeholder"), "n_uses")
        table = stored(table.unionByName(more), "mapping")
        named = places.join(table.select("value", F.col("placeholder").alias("replacement")), "value")
        grouped = rows.spans_by_row(named, rows.ROW, "start", "end", "replacement", out="__more")
        done = rows.attached(own, grouped, rows.ROW).withColumn("masked_text", S.rebuild(F.col("masked_text"), F.coalesce("__more", F.array().cast(mapping.SPANS))))
        own = stored(done.drop("__more"), "masked")
    return own.drop(*({rows.ROW} - set(docs.columns))), table


def restored_paths(paths: DataFrame, table: DataFrame, path: str = "masked_path") -> DataFrame:
    """``paths`` with restored_path: placeholders in components put back, and unsafe for components that would leave their folder."""
    keyed = paths.withColumn("__row", F.xxhash64(path)).dropDuplicates([path])
    back = mapping.unmasked(keyed.select(F.col("__row").alias("doc_id"), F.col(path).alias("masked_text")), table)
    done = keyed.join(back.select(F.col("doc_id").alias("__row"), F.col("restored").alias("restored_path")), "__row").select(path, "restored_path")
    parts = F.split("restored_path", "/")
    return done.withColumn("unsafe", F.exists(parts, lambda p: p.isin("", ".", "..") | p.contains("\\") | p.contains("\u0000")))

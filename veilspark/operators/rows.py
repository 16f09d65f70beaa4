"""Keys of rows: what belongs to a row is found by its content, so null and repeated ids neither lose nor mix anything."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The column that holds a row's key.
ROW = "row_key"


def content_key(*columns: Column) -> Column:
    """32 hex digits of the SHA-256 of the columns as texts; nulls are apart from everything else."""
    parts = [F.coalesce(F.concat(F.length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string")), F.lit("-")) for c in columns]
    return F.substring(F.sha2(F.concat(*parts), 256), 1, 32)


def keyed(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``docs`` with the key of id and text, unless they have one.

    Rows with one key are equal in both, so whatever is found in one holds for
    all, and a join on the key needs no other order or numbering of rows.
    """
    return docs if ROW in docs.columns else docs.withColumn(ROW, content_key(F.col(doc_id), F.col(text)))


def ids(docs: DataFrame, doc_id: str = "doc_id") -> list[str]:
    """The columns that name a row."""
    return [doc_id, ROW] if ROW in docs.columns and doc_id != ROW else [doc_id]


def spans_by_row(spans: DataFrame, key: str, *fields: Column | str, out: str = "__spans") -> DataFrame:
    """(key, out): the different spans of each row in order; spans of equal rows are there once."""
    return spans.groupBy(F.col(key).alias("__of")).agg(F.array_sort(F.collect_set(F.struct(*fields))).alias(out))


def attached(docs: DataFrame, grouped: DataFrame, key: str) -> DataFrame:
    """``docs`` with the columns that ``grouped`` (__of, ...) has for their key; null keys meet null keys."""
    return docs.join(grouped, docs[key].eqNullSafe(grouped["__of"]), "left").drop("__of")

"""Lock files: addresses of internal registries are masked within their tokens, and nothing else of the file changes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilspark.operators import mapping, rows
from veilspark.operators import spans as S
from veilspark.operators.detect import matches
from veilspark.operators.validate import PUBLIC_HOSTS

#: An address within a JSON, YAML or TOML value, up to the sign that ends the value.
URL = r"""\b(?:git\+)?(?:https?|ssh|git|ftp)://[^\s"'<>`,;(){}\[\]\\]+"""
PREFIX = "mask_paket_adresi"


def address_spans(text: Column, public: tuple[str, ...] = PUBLIC_HOSTS) -> Column:
    """array<struct<start, end, value>>: addresses whose host is not public; those with a user or password are internal whatever their host."""
    host = lambda v: F.lower(F.regexp_extract(v, r"^[a-z+]+://(?:[^/@]*@)?([^/:?#]+)", 1))
    user = lambda v: F.regexp_extract(v, r"^[a-z+]+://([^/@]+@)", 1) != ""
    return F.filter(matches(text, URL, ("://",)), lambda m: user(m["value"]) | ~host(m["value"]).isin(*public))


def outline(text: Column, spans: Column) -> Column:
    """The text with each span as one sign: what must be the same before and after masking."""
    return S.rebuild(text, F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.lit("\u0001").alias("replacement"))))


def mask_addresses(files: DataFrame, doc_id: str = "doc_id", text: str = "text", public: tuple[str, ...] = PUBLIC_HOSTS) -> tuple[DataFrame, DataFrame]:
    """(``files`` with masked_text, n_masked and sound, and the mapping value, prefix, number, placeholder).

    An address becomes ``https://<placeholder>.invalid`` with the rest of its
    token kept outside, so that it is still an address to whatever reads the file.
    ``sound``: no internal address is left and the file is the same but for them;
    a file that is not sound must be held.  A null text is an empty one; null and
    repeated ids are rows like others.
    """
    own = rows.keyed(files, text, doc_id)
    body = F.coalesce(F.col(text), F.lit(""))
    found = own.select(doc_id, rows.ROW, F.explode(address_spans(body, public)).alias("m")).select(F.col(doc_id).alias("doc_id"), rows.ROW, "m.*", F.lit(PREFIX).alias("prefix"))
    table = mapping.mapping_of(found)
    named = table.select("value", F.concat(F.lit("https://"), F.regexp_replace("placeholder", "_", "-"), F.lit(".invalid")).alias("placeholder"))
    done = mapping.masked(own, found, named, doc_id, text).withColumnRenamed("n_findings", "n_masked")
    again = matches(F.col("masked_text"), r"https://mask-paket-adresi-[0-9]+\.invalid(?![A-Za-z0-9.-])", (".invalid",))
    left = F.filter(address_spans(F.col("masked_text"), public), lambda m: ~m["value"].rlike(r"^https://mask-paket-adresi-[0-9]+\.invalid$"))
    sound = (F.size(left) == 0) & (outline(body, address_spans(body, public)) == outline(F.col("masked_text"), again))
    out = done.withColumn("sound", sound)
    return out.drop(*({rows.ROW} - set(files.columns))), table

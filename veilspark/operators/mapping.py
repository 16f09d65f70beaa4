"""Placeholders: one numbered token for each distinct value, masking, and the way back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilspark.functions import text as T
from veilspark.operators import rows
from veilspark.operators import rules as R
from veilspark.operators import spans as S
from veilspark.operators.detect import matches

#: Documents whose new values are counted together; the counts of such blocks are then summed in order.
BLOCK = 4096
CORPORATE_PREFIX = "mask_kurumsal_ifade"


def first_occurrences(findings: DataFrame, order: list[str], value: str = "value") -> DataFrame:
    """For each distinct value its first finding, by ``order``: it names the placeholder's prefix, whichever rule finds the value later."""
    best = F.min(F.struct(*order, "prefix"))
    return findings.groupBy(value).agg(best.alias("first"), F.count("*").alias("n_uses")).select(value, *(F.col(f"first.{c}").alias(c) for c in order), F.col("first.prefix").alias("prefix"), "n_uses")


def numbered(values: DataFrame, order: list[str], block: int = BLOCK, value: str = "value") -> DataFrame:
    """Dense numbers from 1 within each prefix, in order of first occurrence, and the placeholders.

    ``order`` starts with a whole number (a document's place; null comes first).
    Values are numbered within blocks of it, and a block starts where the blocks
    before it end; so a prefix with most of all values is still many small windows.
    """
    lead = F.coalesce(F.floor(F.col(order[0]) / block), F.lit(-1 << 62))
    keyed = values.withColumn("__block", lead)
    before = keyed.groupBy("prefix", "__block").agg(F.count("*").alias("__n"))
    span = Window.partitionBy("prefix").orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    before = before.select("prefix", "__block", F.coalesce(F.sum("__n").over(span), F.lit(0)).alias("__start"))
    own = F.row_number().over(Window.partitionBy("prefix", "__block").orderBy(*order, value))
    out = keyed.withColumn("__own", own).join(before, ["prefix", "__block"])
    return out.withColumn("number", (F.col("__start") + F.col("__own")).cast("long")).withColumn("placeholder", F.concat_ws("_", "prefix", F.col("number").cast("string"))).drop("__block", "__own", "__start")


def mapping_of(findings: DataFrame, order: list[str] | None = None) -> DataFrame:
    """value, prefix, number, placeholder, n_uses of accepted findings."""
    order = order or ["doc_id", "start"]
    return numbered(first_occurrences(findings, order), order).select("value", "prefix", "number", "placeholder", "n_uses")


def json_number(number: Column) -> Column:
    """The placeholder of a bare number in JSON: a number itself."""
    return F.concat(F.lit("811199"), F.lpad(number.cast("string"), 9, "0"))


def private_prefix(source: Column, prefix: Column) -> Column:
    """Corporate terms share one prefix, which does not tell their category."""
    return F.when(source == "corporate", CORPORATE_PREFIX).otherwise(prefix)


SPANS = "array<struct<start:int,end:int,replacement:string>>"


def masked(docs: DataFrame, findings: DataFrame, mapping: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with masked_text and n_findings.

    Findings join the mapping by value and come back as one small array for each
    row; texts are joined once, by row, and no text is regrouped.  Findings with
    a row key (:mod:`veilspark.operators.rows`) belong to the rows of that key.
    Without one they belong to the rows of their id, null like any other, and are
    taken only where their value stands in the text, so what was found in one of
    two rows of an id is not written into the other.
    """
    by_row = rows.ROW in findings.columns
    key = rows.ROW if by_row else doc_id
    known = rows.keyed(docs, text, doc_id) if by_row else docs
    named = findings.join(mapping.select("value", F.col("placeholder").alias("replacement")), "value")
    body = F.coalesce(F.col(text), F.lit(""))
    out = rows.attached(known, rows.spans_by_row(named, key, "start", "end", "replacement", "value"), key)
    stands = F.col("__spans") if by_row else F.filter("__spans", lambda s: F.substring(body, s["start"] + 1, s["end"] - s["start"]) == s["value"])
    spans = F.transform(F.coalesce(stands, F.array().cast("array<struct<start:int,end:int,replacement:string,value:string>>")), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["replacement"].alias("replacement")))
    out = out.withColumn("__spans", spans)
    out = out.withColumn("masked_text", F.when(F.size("__spans") > 0, S.rebuild(body, F.col("__spans"))).otherwise(body)).withColumn("n_findings", F.size("__spans").cast("long"))
    return out.drop("__spans", *({rows.ROW} - set(docs.columns)))


TOKEN = rf"(?<![A-Za-z0-9_])(?:{R.PLACEHOLDER}|{R.OLD_PLACEHOLDER})(?![A-Za-z0-9_])|(?<![0-9])(?:{R.JSON_NUMBER})(?![0-9])"


#: A token that touches letters, as where a value was found within a longer run; it is put back if the mapping knows it and else left alone.
#: Where digits follow, the token's number has no certain end.
GLUED = rf"{R.PLACEHOLDER}(?![0-9])"
#: Tokens of earlier rules, ``PREFIX_n``: they are put back if the mapping knows them; other names of that form are left alone and not reported.
BARE = r"(?<![A-Za-z0-9_])[A-Z][A-Z0-9_]*_[0-9]+(?![A-Za-z0-9_])"
#: What looks like a damaged token: it is reported and never guessed.
SUSPECT = r"(?i)(?<![A-Za-z0-9_])(?:mask_[a-z][a-z0-9_]*_[0-9]+[A-Za-z0-9_]*|[a-z][a-z0-9_]*_test_[0-9]+[A-Za-z0-9_]*)(?![A-Za-z0-9_])"


def suspects(docs: DataFrame, mapping: DataFrame, doc_id: str = "doc_id", text: str = "masked_text") -> DataFrame:
    """(doc_id, start, token): what has the form of a token but is none that the mapping knows."""
    found = docs.select(doc_id, F.explode(matches(F.coalesce(F.col(text), F.lit("")), SUSPECT)).alias("m")).select(doc_id, "m.start", F.col("m.value").alias("token"))
    return found.join(mapping.select(F.col("placeholder").alias("token")), "token", "left_anti").select(doc_id, "start", "token")


def unmasked(docs: DataFrame, mapping: DataFrame, doc_id: str = "doc_id", text: str = "masked_text", out: str = "restored") -> DataFrame:
    """``docs`` with the original values put back, and ``unresolved``: the tokens without a mapping.

    Tokens are found in the row, looked up by a join on the token, and put back
    as one array for each text.  A text alone says what to put back, so rows are
    told apart by it and not by their ids.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    keyed = docs.withColumn("__text", rows.content_key(F.col(text)))

    def touched(m: Column) -> Column:
        around = F.concat(F.when(m["start"] > 0, F.substring(body, m["start"], F.lit(1))).otherwise(""), F.substring(body, m["end"] + 1, F.lit(1)))
        return F.struct(m["start"].alias("start"), m["end"].alias("end"), m["value"].alias("value"), (m["value"].startswith("mask_") & around.rlike("[A-Za-z0-9_]")).alias("glued"))

    found = F.transform(matches(body, f"{TOKEN}|{GLUED}|{BARE}"), touched)
    tokens = keyed.select("__text", F.explode(found).alias("m")).select("__text", "m.start", "m.end", F.col("m.value").alias("placeholder"), "m.glued").distinct()
    known = tokens.join(mapping.select("placeholder", "value"), "placeholder", "left")
    back = known.groupBy(F.col("__text").alias("__of")).agg(
        F.array_sort(F.collect_list(F.when(F.col("value").isNotNull(), F.struct("start", "end", F.col("value").alias("replacement"))))).alias("__spans"),
        F.array_sort(F.collect_set(F.when(F.col("value").isNull() & ~F.col("glued") & F.col("placeholder").rlike(f"^(?:{R.PLACEHOLDER}|{R.OLD_PLACEHOLDER}|{R.JSON_NUMBER})$"), F.col("placeholder")))).alias("unresolved"),
    )
    joined = rows.attached(keyed, back, "__text").withColumn("__spans", F.coalesce("__spans", F.array().cast(SPANS))).withColumn("unresolved", F.coalesce("unresolved", F.array().cast("array<string>")))
    return joined.withColumn(out, F.when(F.size("__spans") > 0, S.rebuild(body, F.col("__spans"))).otherwise(body)).drop("__spans", "__text")


def round_trip(source: Column, restored: Column) -> Column:
    """Whether a text came back: equal length and digest."""
    return (F.length(source) == F.length(restored)) & (F.sha2(source, 256) == F.sha2(restored, 256))


def audit(findings: DataFrame) -> DataFrame:
    """Audit rows of resolved findings (columns accepted, winner): what was matched, replaced or lost to another; values appear as hashes only."""
    base = findings.select("doc_id", "rule", "entity", "source", "start", "end", T.short_hash(F.col("value")).alias("value_hash"), "accepted")
    matched = base.select("doc_id", "rule", "entity", "source", "start", "end", "value_hash", F.lit("matched").alias("action"))
    judged = base.select("doc_id", "rule", "entity", "source", "start", "end", "value_hash", F.when(F.col("accepted"), "replaced").otherwise("cakisma").alias("action"))
    return matched.unionByName(judged)


def path_masked(paths: DataFrame, terms: DataFrame, path: str = "path") -> DataFrame:
    """``paths`` with masked_path: each component that has a term in a row of its parts is replaced as a whole.

    ``terms`` (term, placeholder) is a dictionary; it joins the exploded
    components by their first part, so only terms that can match meet.
    """
    comps = paths.select(path, F.posexplode(F.split(path, "/")).alias("pos", "component"))
    distinct = comps.select("component").distinct().withColumn("part", F.explode(F.array_distinct(F.transform(T.parts(F.col("component")), F.lower))))
    keyed = terms.withColumn("part", F.lower(F.get(T.parts(F.col("term")), F.lit(0))))
    hits = distinct.join(keyed, "part").where(T.contains_parts(F.col("component"), F.col("term"))).groupBy("component").agg(F.max_by("placeholder", F.struct(F.length("term"), "term")).alias("placeholder"))
    masked_comps = comps.join(hits, "component", "left").withColumn("c", F.coalesce("placeholder", "component"))
    rebuilt = masked_comps.groupBy(path).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "c"))), lambda x: x["c"]), "/").alias("masked_path"))
    return paths.join(rebuilt, path)


def collisions(paths: DataFrame, path: str = "masked_path") -> DataFrame:
    """Paths that are one name to a file system that ignores case."""
    return paths.groupBy(F.lower(path).alias("path_key")).agg(F.count("*").alias("n"), F.min(path).alias("first_path")).where("n > 1")

"""Detection: rules over a text column give findings, as arrays within the row or as a long table.

A rule's matches and their places come from built-in expressions: the matches,
and the pieces between them, whose lengths add up to the starts.  So detection is
one projection over the scan, in generated code, without Python and without a
shuffle; texts without a string that every match needs, and then those in which
the pattern finds nothing, pass quickly.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilspark.functions import checks
from veilspark.functions.arrays import let, running
from veilspark.operators import rows
from veilspark.operators import rules as R
from veilspark.operators import spans as S

#: Types of natural language, whose findings go if they look random; numbers of telephones are not among them.
NATURAL = ("PERSON", "ORGANIZATION", "DATE_TIME", "LOCATION", "NRP")

FINDING = "array<struct<rule:string,kind:string,entity:string,source:string,confidence:string,authority:int,priority:int,prefix:string,start:int,end:int,value:string,ord:int>>"


def matches(text: Column, pattern: str, needs: Iterable[str] = ()) -> Column:
    """array<struct<start, end, value>> of the leftmost matches of a Java pattern; they do not overlap, and none is empty.

    ``needs``: strings of which every match holds one.
    """
    pairs = F.arrays_zip(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("m"), F.transform(F.split(text, pattern, -1), F.length).alias("g"))

    def placed(pairs: Column) -> Column:
        ends = running(F.transform(pairs, lambda x: x["g"] + F.length(x["m"])), lambda a, b: a + b)
        return let(ends, lambda e: F.transform(pairs, lambda x, i: F.struct((F.get(e, i) - F.length(x["m"])).alias("start"), F.get(e, i).alias("end"), x["m"].alias("value"))))

    walked = let(F.filter(pairs, lambda x: x["m"].isNotNull()), placed)  # what follows the last match has none
    needed = [text.contains(x) for x in needs]
    worth = reduce(Column.__or__, needed) & text.rlike(pattern) if needed else text.rlike(pattern)
    return F.when(worth, walked).otherwise(F.array().cast("array<struct<start:int,end:int,value:string>>"))


EMPTY = "array<struct<start:int,end:int,value:string>>"


def grouped(text: Column, pattern: str, flags: str, group: str = R.VALUE_GROUP) -> Column:
    """Matches of a Python pattern, each narrowed to a named group unless it is empty or took no part; for groups within other groups or alternatives, whose places Spark's functions do not tell."""
    mode = 0
    for letter, flag in (("i", re.I), ("s", re.S), ("m", re.M)):
        mode |= flag if letter in flags else 0

    def each(texts: pd.Series) -> pd.Series:
        compiled = re.compile(pattern, mode)

        def one(body: str | None) -> list[dict]:
            out = []
            for m in compiled.finditer(body or ""):
                a, b = m.span(group) if m[group] else m.span()
                if a < b:
                    out.append({"start": a, "end": b, "value": body[a:b]})
            return out

        return texts.map(one)

    return F.pandas_udf(each, EMPTY)(text)


def narrowed(text: Column, pattern: str, group: int, needs: Iterable[str] = ()) -> Column:
    """:func:`matches`, each narrowed to a group that is not empty; group 1 is what stands before it in the match."""
    heads, values = (F.regexp_extract_all(text, F.lit(pattern), F.lit(g)) for g in (1, group))

    def cut(m: Column, i: Column) -> Column:
        start, value = m["start"] + F.length(F.get(heads, i)), F.get(values, i)
        return F.when(value == "", m).otherwise(F.struct(start.alias("start"), (start + F.length(value)).alias("end"), value.alias("value")))

    return F.transform(matches(text, pattern, needs), cut)


def _placeholders(text: Column) -> Column:
    return matches(text, rf"\b(?:{R.PLACEHOLDER}|{R.OLD_PLACEHOLDER})\b", ("mask_", "_TEST_"))


def _allowed(text: Column, rules: list[R.Rule]) -> Column:
    allowed = [matches(text, r.java, r.needs) for r in rules if r.kind == "allow"]
    return F.concat(*allowed) if allowed else F.array().cast(EMPTY)


def technical(text: Column, found: Column) -> Column:
    """Whether a personnel number is a technical name, or stands in one: p12, sha256, ``{1}``, versions, names of key types."""
    value, sign = found["value"], "[A-Za-z0-9_.-]*"
    before, after = F.substring(text, found["start"], F.lit(1)), F.substring(text, found["end"] + 1, F.lit(1))
    before = F.when(found["start"] > 0, before).otherwise("")
    left = F.reverse(F.regexp_extract(F.reverse(F.substring(text, F.lit(1), found["start"])), f"^{sign}", 0))
    token = F.concat(left, value, F.regexp_extract(F.substring(text, found["end"] + 1, F.length(text)), f"^{sign}", 0))
    place = ((before == "{") & (after == "}")) | (before == ".") | (after == ".") | token.rlike(r"(?i)^(?:v?\d+(?:\.\d+)+(?:[-+][A-Za-z0-9_.-]+)?|(?:rsa|sha|pkcs)\d+)$")
    return value.rlike(r"(?i)^(?:p12|pkcs12|sha256|rsa\d+)$") | (value.rlike(r"^\p{Nd}+$") & place)


def passive_count(text: Column, rules: Iterable[R.Rule]) -> Column:
    """How often terms that are switched off stand in a text, placeholders aside; for the report only."""
    text = F.coalesce(text, F.lit(""))
    masked, total = _placeholders(text), F.lit(0)
    for rule in rules:
        total = total + F.size(F.filter(matches(text, rule.java, rule.needs), lambda m: ~S.inside(m, masked)))
    return total.cast("long")


def display_path(path: Column, rules: Iterable[R.Rule]) -> Column:
    """A path for the eye: what a rule finds becomes its prefix and ``_*``; nothing is numbered, and nothing comes back."""
    found = S.accepted(S.resolve(findings_array(path, rules)))
    return F.when(path.isNotNull(), S.rebuild(path, F.transform(found, lambda f: F.struct(f["start"].alias("start"), f["end"].alias("end"), F.concat(F.coalesce(f["prefix"], F.lit("mask")), F.lit("_*")).alias("replacement")))))


def _matches(text: Column, rule: R.Rule) -> Column:
    if rule.by_python:
        return grouped(text, rule.pattern, rule.flags)
    return narrowed(text, *rule.narrowed, rule.needs) if rule.narrowed else matches(text, rule.java, rule.needs)


def _found(text: Column, masked: Column, allow: Column, rule: R.Rule, natural: tuple[str, ...]) -> Column:
    """Findings of one rule, beside placeholders and allowed spans."""
    second = rule.kind == "recogniser"
    found = F.filter(_matches(text, rule), lambda m: ~S.touched(m, masked))
    if rule.kind == "parametric" and rule.category == "sicil_no":
        found = F.filter(found, lambda m: ~technical(text, m))
    if rule.validator:
        valid = R.VALIDATORS[rule.validator]
        found = F.filter(found, lambda m: valid(m["value"]))
    if second:
        found = F.filter(found, lambda m: ~S.touched(m, allow))
        if rule.entity == "DATE_TIME":
            found = F.filter(found, lambda m: m["value"].rlike(r"\p{Nd}"))
        if rule.entity in natural:
            found = F.filter(found, lambda m: checks.entropy(m["value"]) <= 3.5)
    confidence = "yuksek" if not second or rule.score >= 0.85 else "orta" if rule.score >= 0.6 else "dusuk"
    rank = {"parametric": 3, "regex": 2 if rule.name.startswith("generic_") else 3, "recogniser": 1}.get(rule.kind, 0)
    fixed = {"rule": rule.name, "kind": rule.kind, "entity": rule.entity or rule.category, "source": "katman2_presidio" if second else "dictionary", "confidence": confidence, "authority": rank, "prefix": rule.prefix}
    return F.transform(found, lambda m: F.struct(m["start"].alias("start"), F.lit(rule.priority).alias("priority"), *(F.lit(v).alias(k) for k, v in fixed.items()), m["end"].alias("end"), m["value"].alias("value")))


def _ordered(parts: list[Column]) -> Column:
    if not parts:
        return F.array().cast(FINDING)
    return F.transform(
        F.array_sort(F.concat(*parts)),
        lambda s, i: F.struct(s["rule"], s["kind"], s["entity"], s["source"], s["confidence"], s["authority"], s["priority"], s["prefix"], s["start"], s["end"], s["value"], i.alias("ord")),
    ).cast(FINDING)


def findings_array(text: Column, rules: Iterable[R.Rule], natural: tuple[str, ...] = NATURAL) -> Column:
    """All findings of a few rules in a text, as one expression; for many rules use :func:`detect`, which works in steps."""
    rules = list(rules)
    text = F.coalesce(text, F.lit(""))
    masked, allow = _placeholders(text), _allowed(text, rules)
    return _ordered([_found(text, masked, allow, r, natural) for r in rules if r.kind != "allow"])


def detect(docs: DataFrame, rules: Iterable[R.Rule], text: str = "text", out: str = "findings", natural: tuple[str, ...] = NATURAL) -> DataFrame:
    """``docs`` with the array of findings in each text: validated, outside placeholders that are there already, by start and priority.

    Second-layer findings that overlap an allowed span go, and so do those of
    natural-language types whose entropy is over 3.5 bits.  What all rules look
    at is a column of its own, evaluated once a row.
    """
    rules = list(rules)
    body = F.coalesce(F.col(text), F.lit(""))
    staged = docs.withColumns({"__masked": _placeholders(body), "__allow": _allowed(body, rules)})
    own = [r for r in rules if r.kind != "allow"]
    staged = staged.withColumns({f"__f{i}": _found(body, F.col("__masked"), F.col("__allow"), r, natural) for i, r in enumerate(own)})
    return staged.withColumn(out, _ordered([F.col(f"__f{i}") for i in range(len(own))])).drop("__masked", "__allow", *(f"__f{i}" for i in range(len(own))))


def long(docs: DataFrame, findings: str = "findings", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """One row for each finding."""
    return docs.select(*keep, F.explode(findings).alias("f")).select(*keep, "f.*")


DETECTORS: dict[str, Callable[[DataFrame], DataFrame]] = {}


def register_detector(name: str, detector: Callable[[DataFrame], DataFrame]) -> None:
    """A detector takes documents and returns findings (doc_id, value, entity, confidence); see :func:`external`."""
    DETECTORS[name] = detector


def external(docs: DataFrame, findings: DataFrame, source: str = "llm", min_chars: int = 3, text: str = "text") -> DataFrame:
    """Findings of an outside detector, kept only where their value stands in the text between word limits.

    ``findings``: doc_id, value, entity, confidence.  Values under ``min_chars``
    count as low; unknown types and confidences become the fallback type and
    medium.  Joined by document (null ids meet null ids), so nothing is broadcast.
    """
    clean = findings.where(F.trim("value") != "").select(
        "doc_id",
        F.col("value").alias("wanted"),
        canonical_entity(F.col("entity")).alias("entity"),
        F.when(F.length("value") < min_chars, "dusuk").when(F.col("confidence").isin("yuksek", "orta", "dusuk"), F.col("confidence")).otherwise("orta").alias("confidence"),
    ).dropDuplicates(["doc_id", "wanted", "entity"])
    body = F.col(text)
    n = F.size(F.split(body, F.concat(F.lit(r"\Q"), "wanted", F.lit(r"\E")), -1)) - 1
    gaps = F.transform(F.split(body, F.concat(F.lit(r"\Q"), "wanted", F.lit(r"\E")), -1), F.length)
    at = F.transform(F.filter(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: n > 0), lambda i: F.aggregate(F.slice(gaps, F.lit(1), i), F.lit(0), lambda a, g: a + g) + (i - 1) * F.length("wanted"))
    clean = clean.withColumnRenamed("doc_id", "__of")
    own = rows.ids(docs)
    joined = docs.join(clean, docs["doc_id"].eqNullSafe(clean["__of"])).select(*own, "wanted", "entity", "confidence", body.alias("body"), F.explode(at).alias("start"))
    end = F.col("start") + F.length("wanted")
    joiner = "^[A-Za-z0-9_]$"
    free = ~(F.substring("body", F.col("start"), F.lit(1)).rlike(joiner) & F.substring("wanted", 1, 1).rlike(joiner) & (F.col("start") > 0)) & ~(F.substring("body", end + 1, F.lit(1)).rlike(joiner) & F.substring("wanted", -1, 1).rlike(joiner))
    return joined.where(free).select(*own, F.lit(source).alias("source"), "entity", "confidence", "start", end.alias("end"), F.col("wanted").alias("value"))


# The types that outside detectors may give, the names they go by, and the fallback.
ENTITIES = ("PASSWORD", "API_KEY", "TOKEN", "SECRET", "PRIVATE_KEY", "CONNECTION_STRING", "IP", "EMAIL", "PHONE", "URL", "HOSTNAME", "PERSON", "ADDRESS", "ORGANIZATION", "KIMLIK_NO", "IBAN", "KURUM_JARGONU", "IC_SERVIS_ADI", "URUN_KOD_ADI", "PROJE_KOD_ADI", "ENVANTER_KODU", "KURUMSAL_TANIMLAYICI")
FALLBACK = "KURUMSAL_TANIMLAYICI"


def canonical_entity(entity: Column) -> Column:
    name = F.upper(F.regexp_replace(F.trim(F.coalesce(entity, F.lit(""))), "[^A-Za-z0-9]+", "_"))
    name = F.when(name == "EMAIL_ADDRESS", "EMAIL").when(name == "IP_ADDRESS", "IP").when(name == "PHONE_NUMBER", "PHONE").when(name == "IBAN_CODE", "IBAN").otherwise(name)
    return F.when(name.isin(*ENTITIES), name).otherwise(FALLBACK)


def prefix_of(entity: Column) -> Column:
    """Placeholder prefix of a type: a slug of at most 45 signs that does not start with a digit."""
    slug = F.lower(F.regexp_replace(F.regexp_replace(entity, "[^A-Za-z0-9]+", "_"), "^_+|_+$", ""))
    slug = F.when(slug == "person", "personel").otherwise(slug)
    slug = F.when(slug.rlike("^[0-9]"), F.concat(F.lit("x_"), slug)).otherwise(slug)
    return F.substring(F.concat(F.lit("mask_"), slug), 1, 45)


def route(confidence: Column, value: Column, generic: Column, threshold: str = "orta", low: str = "ignore") -> Column:
    """mask, review or ignore: values without letters or digits, and generic ones, are ignored."""
    rank = S._rank(confidence, S.CONFIDENCE)
    return F.when(~value.rlike(r"[\p{L}\p{N}]") | F.coalesce(generic, F.lit(False)), "ignore").when(rank >= S.CONFIDENCE[threshold], "mask").otherwise(low)


def restricted(findings: DataFrame, extensions: DataFrame, ext: str = "ext", entity: str = "entity", custom: tuple[str, ...] = ()) -> DataFrame:
    """Findings whose type is allowed for their extension; extensions without a row allow every type, and so do ``custom`` types.

    ``extensions`` (ext, entity) is a table of settings; its distinct extensions join the findings once.
    """
    allowed = extensions.groupBy("ext").agg(F.collect_set("entity").alias("allowed")).withColumnRenamed("ext", "__ext")
    return findings.join(allowed, findings[ext] == allowed["__ext"], "left").where(F.col("allowed").isNull() | F.array_contains("allowed", F.col(entity)) | F.col(entity).isin(*custom)).drop("allowed", "__ext")

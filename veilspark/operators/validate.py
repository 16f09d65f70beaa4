"""Checks that masking broke nothing: syntax before and after, brackets, CSV shape, lock files, audit verdicts."""

from __future__ import annotations

import ast
import json
import re
import tomllib
import xml.etree.ElementTree as ET
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilspark.operators.boundary import lexical_index
from veilspark.operators.prepare import csv_records

PARSED = {".yaml": "lines", ".yml": "lines", ".properties": "lines", ".ini": "lines", ".cfg": "lines", ".json": "json", ".py": "python", ".toml": "toml", ".xml": "xml", ".resx": "xml", ".svg": "xml", ".csv": "csv", ".tsv": "csv"}
BRACKETS = frozenset((".java", ".cs", ".js", ".ts", ".c", ".h", ".cpp", ".go", ".rs", ".kt", ".swift", ".scala", ".php", ".css", ".sql", ".sh", ".rb"))


def mode_of(suffix: str) -> str:
    return PARSED.get(suffix, "brackets" if suffix in BRACKETS else "structure")


def syntax_error(text: str, suffix: str) -> str | None:
    """The first syntax error of a text by its suffix, without positions; None if there is none or nothing to parse."""
    mode = mode_of(suffix)
    try:
        if mode == "json":
            json.loads(text)
        elif mode == "python":
            ast.parse(text)
        elif mode == "toml":
            tomllib.loads(text)
        elif mode == "xml":
            ET.fromstring(text)
        elif mode == "brackets":
            return bracket_error(text, suffix)
    except (ValueError, SyntaxError, ET.ParseError, RecursionError) as e:
        return f"{mode}: {type(e).__name__}"
    return None


def bracket_error(text: str, suffix: str = "") -> str | None:
    """Brackets outside strings and comments that do not match."""
    pairs, open_, at = {")": "(", "]": "[", "}": "{"}, [], 0
    for part in [*lexical_index(text, suffix), None]:
        for c in text[at : part.start if part else len(text)]:
            if c in "([{":
                open_.append(c)
            elif c in pairs and (not open_ or open_.pop() != pairs[c]):
                return "brackets: closed"
        at = part.end if part else at
    return "brackets: open" if open_ else None


def broken(before: str, after: str, suffix: str) -> str | None:
    """What masking broke: a new syntax error, another CSV shape, or other types in JSON; an error that was there before is none."""
    mode = mode_of(suffix)
    if mode == "csv":
        a, b = ([len(r) for r in csv_records(t)] for t in (before, after))
        return None if a == b else "csv: shape"
    if mode == "lines":
        return None if outline(before, suffix) == outline(after, suffix) else "lines: shape"
    error = syntax_error(after, suffix)
    if error:
        return None if syntax_error(before, suffix) == error else error
    if mode == "json" and syntax_error(before, suffix) is None and _shape(_kept(before)) != _shape(_kept(after)):
        return "json: types"
    return None


class _Pairs(list):
    """The members of a JSON object, repeated names too."""


def _kept(text: str):
    return json.loads(text, object_pairs_hook=_Pairs)


#: A line of YAML, properties or INI: indentation, list marks, a name with its separator, and how the value begins.
_LINE = re.compile(r"""^(?P<indent>[ \t]*)(?P<marks>(?:- +)*)(?P<name>"[^"]*"|'[^']*'|\[[^\]]*\]|[^\s#:='"][^:=#]*?)?(?P<sep>\s*[:=](?=\s|$)|\s*=)?(?P<value>.*)$""")


def outline(text: str, suffix: str) -> list[tuple]:
    """What masking must leave of each line: its indentation, list marks, whether it names something and how, and the kind of value that follows."""
    out = []
    for line in text.splitlines():
        m = _LINE.match(line)
        value = m["value"].strip()
        name = (m["name"] or "")[:1]
        kind = value[:1] if value[:1] in "\"'|>&*#{[" else "plain" if value else ""
        ends = value[-1:] if value[-1:] in "\"'}]\\," else ""
        out.append((m["indent"], m["marks"], name if name in "\"'[" else bool(name), (m["sep"] or "").strip(), kind, ends))
    return out


def _shape(x):
    if isinstance(x, _Pairs):
        return {"object": [_shape(v) for _, v in x]}
    if isinstance(x, list):
        return [_shape(v) for v in x]
    return "number" if isinstance(x, (int, float)) and not isinstance(x, bool) else type(x).__name__


def validated(docs: DataFrame, before: str = "text", after: str = "masked_text", suffix: str = "suffix", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, problem) of documents that masking broke; a failing check is a problem of its row, never of the job."""
    kind = docs.schema[doc_id].dataType.simpleString()

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for d, a, b, s in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                try:
                    problem = broken(a or "", b or "", (s or "").lower())
                except Exception as e:  # noqa: BLE001
                    problem = f"check: {type(e).__name__}"
                if problem:
                    rows.append((d, problem))
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], batch.schema.field(0).type), pa.array([r[1] for r in rows], pa.string())], [doc_id, "problem"])

    return docs.select(doc_id, before, after, suffix).mapInArrow(check, f"`{doc_id}` {kind}, problem string")


def audit_verdicts(docs: DataFrame, claims: DataFrame, text: str = "masked_text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, risky, n_verified): claims of an outside auditor (doc_id, quote) count only if the quote stands in the text."""
    named = claims.withColumnRenamed(doc_id, "__of")
    joined = docs.select(doc_id, F.col(text).alias("__t")).join(named, F.col(doc_id).eqNullSafe(F.col("__of")), "left")
    real = F.coalesce(F.col("__t").contains(F.col("quote")) & F.col("quote").rlike(r"[\p{L}\p{N}]") & ~F.col("quote").rlike(r"^mask_[a-z0-9_]+_[0-9]+$"), F.lit(False))
    return joined.groupBy(doc_id).agg(F.bool_or(real).alias("risky"), F.count_if(real).alias("n_verified"))


def audit_reuse(docs: DataFrame, records: DataFrame, settings: str, text: str = "masked_text") -> DataFrame:
    """``docs`` with the verdict of an earlier audit of the same content under the same settings, if there is one."""
    key = F.sha2(F.concat_ws(":", F.lit(settings), F.col(text)), 256)
    return docs.withColumn("audit_key", key).join(records.select("audit_key", "verdict").dropDuplicates(["audit_key"]), "audit_key", "left")


# Registries that are public.
PUBLIC_HOSTS = ("registry.npmjs.org", "registry.yarnpkg.com", "pypi.org", "files.pythonhosted.org", "repo1.maven.org", "repo.maven.apache.org", "rubygems.org", "crates.io", "proxy.golang.org", "github.com")


def lock_plan(findings: DataFrame) -> DataFrame:
    """(doc_id, plan) for lock files, from findings (doc_id, kind: url, digest or other; value).

    Digests and public addresses are no findings; a file with internal addresses
    only, none with credentials, may have these masked; any other finding makes
    it sensitive.
    """
    host = F.lower(F.regexp_extract("value", r"^[a-z+]+://(?:[^/@]*@)?([^/:]+)", 1))
    user = F.col("value").rlike(r"^[a-z+]+://[^/@]+@")
    open_ = (F.col("kind") == "digest") | (F.col("kind") == "url") & host.isin(*PUBLIC_HOSTS) & ~user
    left = findings.withColumn("__open", open_).withColumn("__url", (F.col("kind") == "url") & ~user)
    counted = left.groupBy("doc_id").agg(F.count_if(~F.col("__open")).alias("n_left"), F.count_if(~F.col("__open") & F.col("__url")).alias("n_urls"))
    return counted.select("doc_id", F.when(F.col("n_left") == 0, "scan_only_clean").when(F.col("n_left") == F.col("n_urls"), "mask_urls").otherwise("scan_only_sensitive").alias("plan"))

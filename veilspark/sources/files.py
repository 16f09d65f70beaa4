"""Project trees as tables: walking order, exclusion, classification, encodings, and writing back."""

from __future__ import annotations

import codecs
import fnmatch
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veilspark.functions.arrays import sliced
from veilspark.sources.sheets import sheet_lines
from veilspark.sources.tree import ProjectTree

# Folders, suffixes and names that are treated specially.
IGNORED_DIRS = (
    ".git", ".hg", ".svn", ".mypy_cache", ".pytest_cache", ".ruff_cache", "__pycache__", "node_modules", "vendor", "dist", "build", "target",
    "coverage", ".next", ".nuxt", ".turbo", ".venv", "venv", "obj", ".vs", ".gradle", "bower_components",
)
OPAQUE = (
    ".png", ".jpg", ".jpeg", ".gif", ".webp", ".ico", ".svgz", ".pdf", ".jar", ".war", ".pyc", ".so", ".dll", ".dylib", ".exe",
    ".doc", ".docx", ".xls", ".xlsx", ".ppt", ".pptx",
)
ARCHIVES = (".zip", ".tar", ".gz", ".tgz", ".rar", ".7z")
LOCKS = (
    "package-lock.json", "npm-shrinkwrap.json", "yarn.lock", "pnpm-lock.yaml", "poetry.lock", "pipfile.lock", "packages.lock.json",
    "project.assets.json", "go.sum", "package.resolved", "gradle.lockfile",
)
LOCK_SUFFIXES = (".lock", ".lockfile")
EXCLUDES = ((".env", "file"), (".env.*", "file"), ("*.pem", "file"), ("*.key", "file"), ("*.p12", "file"), ("id_rsa", "file"), (".git", "directory"))
MAX_BYTES, SLOW_BYTES, PEEK = 50_000_000, 2_000_000, 8192
BOMS = ((codecs.BOM_UTF32_LE, "utf-32-le"), (codecs.BOM_UTF32_BE, "utf-32-be"), (codecs.BOM_UTF8, "utf-8"), (codecs.BOM_UTF16_LE, "utf-16-le"), (codecs.BOM_UTF16_BE, "utf-16-be"))


def read_tree(spark: SparkSession, root: str, content: bool = True) -> DataFrame:
    """path (relative), size, is_link, and content of all files below ``root``, hidden and empty ones too; without ``content`` no file is opened.

    Links are told and not followed (:mod:`veilspark.sources.tree`).
    """
    spark.dataSource.register(ProjectTree)
    files = spark.read.format("project_tree").option("path", root.removeprefix("file://")).option("content", str(content).lower()).load()
    return files if content else files.drop("content")


def walk_key(path: Column) -> Column:
    """Sort key of the walk: in each folder its files, then its folders, each by name."""
    parts = F.split(path, "/")
    return F.transform(parts, lambda p, i: F.struct(F.when(i == F.size(parts) - 1, 0).otherwise(1).alias("kind"), p.alias("name")))


def glob_pattern(glob: str) -> str:
    """A shell pattern as a regular expression for Spark."""
    return fnmatch.translate(glob).replace("(?s:", "(?s)^(?:").replace(")\\Z", ")$").replace(")\\z", ")$")


def excluded_by(path: Column, specs: tuple[tuple[str, str], ...] = EXCLUDES) -> Column:
    """The first pattern that excludes a file, by its own name or that of a folder above it; null if none."""
    parts = F.split(path, "/")
    name, dirs = F.element_at(parts, -1), F.slice(parts, 1, F.size(parts) - 1)
    tests = []
    for glob, kind in specs:
        p = glob_pattern(glob)
        hit = F.lit(False)
        if kind in ("file", "both"):
            hit = hit | name.rlike(p)
        if kind in ("directory", "both"):
            hit = hit | F.exists(dirs, _like(p))
        tests.append(F.when(hit, F.lit(glob)))
    return F.coalesce(*tests) if tests else F.lit(None).cast("string")


def _like(pattern: str):
    return lambda d: d.rlike(pattern)


def file_class(path: Column) -> Column:
    """ignored, archive, opaque, lock or text, by path alone; case is ignored, and a file named like an ignored folder is ignored too."""
    parts = F.split(F.lower(path), "/")
    name = F.element_at(parts, -1)
    suffix = F.regexp_extract(name, r"^.+(\.[^.]+)$", 1)
    return (
        F.when(F.arrays_overlap(parts, F.array(*map(F.lit, IGNORED_DIRS))), "ignored").when(suffix.isin(*ARCHIVES), "archive").when(suffix.isin(*OPAQUE), "opaque")
        .when(name.isin(*LOCKS) | suffix.isin(*LOCK_SUFFIXES), "lock").otherwise("text")
    )


def decoded(raw: bytes, max_bytes: int = MAX_BYTES) -> tuple[str, str | None, str | None]:
    """(status, text, encoding) of a file's bytes; a text is accepted only if it encodes to the same bytes again."""
    if len(raw) > max_bytes:
        return "skipped_too_large", None, None
    if not raw:
        return "text_ready", "", "utf-8"
    for bom, name in BOMS:
        if raw.startswith(bom):
            try:
                text = raw[len(bom) :].decode(name)
            except UnicodeDecodeError:
                continue
            if bom + text.encode(name) == raw:
                return "text_ready", text, f"{name}-sig"
    peek = raw[:PEEK]
    if b"\0" in peek:
        for name in ("utf-16-le", "utf-16-be"):
            zeros = peek[(1 if name.endswith("le") else 0) :: 2].count(0)
            if len(raw) % 2 == 0 and zeros > 0.3 * len(peek) / 2:
                try:
                    text = raw.decode(name)
                except UnicodeDecodeError:
                    continue
                if text.encode(name) == raw and (text.isprintable() or "\n" in text):
                    return "text_ready", text, name
        return "copied_binary", None, None
    controls = sum(b < 32 and b not in (9, 10, 12, 13, 27) for b in peek)
    if controls > 0.3 * len(peek):
        return "copied_binary", None, None
    try:
        return "text_ready", raw.decode("utf-8"), "utf-8"
    except UnicodeDecodeError:
        if any(b >= 0xC3 for b in raw) and _multibyte_share(raw) > 0.5:
            return "copied_undecodable", None, None  # mostly valid UTF-8: a one-byte encoding would hide the damage
    turkish = sum(raw.count(b) for b in (0xFD, 0xFE, 0xF0, 0xDD, 0xDE, 0xD0))
    for name in ("cp1254", "latin-1") if turkish else ("cp1252", "cp1254", "latin-1"):
        try:
            text = raw.decode(name)
        except UnicodeDecodeError:
            continue
        if text.encode(name) == raw:
            return "text_ready", text, name
    return "copied_undecodable", None, None


def _multibyte_share(raw: bytes) -> float:
    high = sum(b >= 0x80 for b in raw)
    return (high - raw.decode("utf-8", "replace").count("�")) / high if high else 0.0


def encoded(text: str, encoding: str) -> bytes:
    """The bytes of a text in the encoding it was read with, its byte-order mark included."""
    name = encoding.removesuffix("-sig")
    bom = next((b for b, n in BOMS if n == name), b"") if encoding.endswith("-sig") else b""
    return bom + text.encode(name)


def texts(files: DataFrame, specs: tuple[tuple[str, str], ...] = EXCLUDES, max_bytes: int = MAX_BYTES) -> DataFrame:
    """``files`` (path, size, content) with status, text and encoding; the path decides before the content is looked at."""
    kind = file_class(F.col("path"))
    link = F.col("is_link") if "is_link" in files.columns else F.lit(False)
    early = F.when(link, "skipped_symlink").when(excluded_by(F.col("path"), specs).isNotNull(), "excluded").when(kind == "opaque", "copied_binary").when(F.col("size") > max_bytes, "skipped_too_large").when(kind == "archive", "archive_unsupported")
    keyed = files.withColumn("early", early).withColumn("content", F.when(F.col("early").isNull(), F.col("content"))).withColumn("lock", kind == "lock")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 2):
            out = [(e, None, None) if e else decoded(c or b"", max_bytes) for e, c in zip(batch.column(3).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            status = ["scan_only_text_ready" if lock and s == "text_ready" else s for (s, _, _), lock in zip(out, batch.column(4).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(status), pa.array([t for _, t, _ in out], pa.string()), pa.array([n for _, _, n in out], pa.string())], ["path", "size", "status", "text", "encoding"])

    return keyed.select("path", "size", "content", "early", "lock").mapInArrow(read, "path string, size bigint, status string, text string, encoding string")


def written(done: DataFrame, out: str, text: str = "masked_text") -> None:
    """Write texts as a table of encoded contents with their digests; a staged folder is renamed by Spark's own commit, so readers see all or nothing."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data = [None if t is None else encoded(t, e or "utf-8") for t, e in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(data, pa.binary())], ["path", "encoding", "content"])

    rows = done.select("path", text, "encoding").mapInArrow(encode, "path string, encoding string, content binary")
    rows.withColumn("digest", F.sha2("content", 256)).write.mode("overwrite").parquet(out)


def manifest(done: DataFrame, key: str) -> DataFrame:
    """path, encoding, digest, and a keyed signature of each row."""
    body = F.concat_ws("|", "path", "encoding", "digest")
    return done.select("path", "encoding", "digest", F.sha2(F.concat_ws(":", F.lit(key), body), 256).alias("signature"))


def verified(rows: DataFrame, key: str) -> DataFrame:
    """Manifest rows whose signature is right."""
    body = F.concat_ws("|", "path", "encoding", "digest")
    return rows.where(F.col("signature") == F.sha2(F.concat_ws(":", F.lit(key), body), 256))


def term_rows(spark: SparkSession, path: str) -> DataFrame:
    """Terms of a text, CSV or .xlsx file: those of its first column; heads and repeated spellings go."""
    if path.lower().endswith(".xlsx"):
        lines, first = sheet_lines(spark, path), F.trim("value")
    else:
        lines = spark.read.text(path).withColumn("n", F.monotonically_increasing_id())
        first = F.trim(F.regexp_replace(F.get(F.split(F.regexp_replace("value", "^﻿", ""), "[,;\t]"), F.lit(0)), '^"|"$', ""))
    terms = lines.select(first.alias("term"), "n").where("term <> ''").where(~F.lower("term").isin("term", "terim", "hassas deger", "value", "deger"))
    return terms.groupBy(F.lower("term").alias("k")).agg(F.min_by("term", "n").alias("term")).select("term")

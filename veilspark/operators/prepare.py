"""Text preparation: lines, chunks, encoded blocks, and tables inside texts."""

from __future__ import annotations

import base64
import binascii
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilspark.functions import text as T
from veilspark.operators import ordered
from veilspark.operators.detect import matches


def lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, line_no from 0, line) of every line."""
    body = F.coalesce(F.col(text), F.lit(""))
    return docs.select(doc_id, F.posexplode(F.split(body, r"\r\n|\n|\r", -1)).alias("line_no", "line"))


def deduped_lines(docs: DataFrame, digits: bool = False, min_chars: int = 8, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """For each document: lines, kept lines, and the kept text.

    A line whose trimmed length reaches ``min_chars`` is dropped if one with its
    key stands before it; with ``digits`` lines that differ in numbers only have
    one key.  All within the row: no shuffle.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    all_ = F.split(body, "\n", -1)
    key = (lambda x: T.digit_key(x)) if digits else (lambda x: x)
    keys = F.transform(all_, lambda x: key(F.rtrim(x, F.lit("\r"))))
    first = F.transform(F.arrays_zip(all_.alias("l"), keys.alias("k")), lambda x, i: F.struct(x["l"].alias("l"), ((F.length(F.trim(x["k"])) < min_chars) | (F.array_position(keys, x["k"]) == i + 1)).alias("keep")))
    kept = F.transform(F.filter(first, lambda x: x["keep"]), lambda x: x["l"])
    return docs.select(doc_id, F.size(all_).cast("long").alias("n_lines"), F.size(kept).cast("long").alias("n_kept"), F.array_join(kept, "\n").alias("kept_text"))


def chunk_bounds(length: Column, most: int, overlap: int) -> Column:
    """array<struct<start, end>>: pieces of at most ``most`` signs that overlap; for texts without line ends, or where those do not count."""
    overlap = min(overlap, most // 4)
    step = most - overlap
    n = F.when(length <= most, 1).otherwise(F.ceil((length - most) / step) + 1).cast("int")
    return F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct((i * step).alias("start"), F.least(i * step + most, length).alias("end")))


def chunks(docs: DataFrame, most: int = 200_000, overlap: int = 2_000, text: str = "text") -> DataFrame:
    """(all other columns, chunk, start, end, chunk_text): cut at the last line end behind half a chunk, else at ``most``."""
    keep = [f for f in docs.schema if f.name != text]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in keep), "chunk int", "start int", "end int", "chunk_text string"])
    back = min(overlap, most // 4)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, out = [], ([], [], [], [])
            for i, body in enumerate(batch.column(batch.schema.get_field_index(text)).to_pylist()):
                body, start, n = body or "", 0, 0
                while True:
                    end = min(len(body), start + most) if most > 0 else len(body)
                    if end < len(body):
                        newline = body.rfind("\n", start, end)
                        if newline - start > most // 2:
                            end = newline + 1
                    at.append(i)
                    for x, v in zip(out, (n, start, end, body[start:end]), strict=True):
                        x.append(v)
                    if end >= len(body):
                        break
                    start, n = max(end - back, start + 1), n + 1
            rows = batch.select([f.name for f in keep]).take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays([*rows.columns, *(pa.array(x, t) for x, t in zip(out, (pa.int32(), pa.int32(), pa.int32(), pa.string()), strict=True))], [*rows.schema.names, "chunk", "start", "end", "chunk_text"])

    return docs.mapInArrow(cut, schema)


def readable(decoded: Column) -> Column:
    """Whether decoded bytes are text: printable, six signs at least, four letters, mostly ASCII."""
    n = F.length(decoded)
    letters = n - F.length(F.regexp_replace(decoded, "[A-Za-z]", ""))
    plain = F.length(F.regexp_replace(decoded, "[^ -~\\t\\r\\n]", ""))
    return F.coalesce((n >= 6) & (letters >= 4) & (plain >= n * 0.8) & ~decoded.rlike(r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F�]"), F.lit(False))


def decoded_blocks(docs: DataFrame, min_chars: int = 12, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, start, end, kind, decoded) of base64 and hex runs that decode to readable text."""
    body = F.coalesce(F.col(text), F.lit(""))
    runs = docs.select(doc_id, F.explode(matches(body, rf"[A-Za-z0-9+/]{{{min_chars},}}={{0,2}}")).alias("m")).select(doc_id, "m.*")
    hexed = F.col("value").rlike("^[0-9a-fA-F]+$") & (F.length("value") % 2 == 0)
    tried = runs.withColumn("kind", F.when(hexed, "hex").when(F.length("value") % 4 == 0, "base64"))
    raw = F.when(F.col("kind") == "hex", F.unhex("value")).when(F.col("kind") == "base64", F.try_to_binary("value", F.lit("base64")))
    out = tried.withColumn("raw", raw).withColumn("decoded", F.when(F.is_valid_utf8("raw"), F.col("raw").cast("string")))
    return out.where(F.col("kind").isNotNull() & readable(F.col("decoded"))).select(doc_id, "start", "end", "kind", "decoded")


_LIST = re.compile(r"(?:0x[0-9a-fA-F]{1,2}|\d{1,3})(?:\s*,\s*(?:0x[0-9a-fA-F]{1,2}|\d{1,3})){63,}")
_RUN = re.compile(r"[A-Za-z0-9+/_-]{40,}={0,2}|(?:[A-Za-z0-9+/_-]{40,}\r?\n)+[A-Za-z0-9+/_-]*={0,2}")


def binary_spans(text: str) -> list[tuple[int, int]]:
    """Spans of encoded binary data: long runs that decode, but not to readable text, and long lists of bytes."""
    out = [(m.start(), m.end()) for m in _LIST.finditer(text)]
    for m in _RUN.finditer(text):
        run = re.sub(r"\s", "", m[0])
        if sum(c.isdigit() for c in run) < 0.07 * len(run) or min(sum(c.isupper() for c in run), sum(c.islower() for c in run)) < 0.15 * len(run) and not re.fullmatch("[0-9a-fA-F]+", run):
            continue
        try:
            data = bytes.fromhex(run) if re.fullmatch("[0-9a-fA-F]+", run) and len(run) % 2 == 0 else base64.b64decode(run.replace("-", "+").replace("_", "/") + "=" * (-len(run) % 4))
        except (ValueError, binascii.Error):
            continue
        try:
            plain = data.decode()
            if plain.isprintable() and sum(c.isalpha() for c in plain) >= 4:
                continue
        except UnicodeDecodeError:
            pass
        out.append((m.start(), m.end()))
    return sorted(out)


def sample_rows(rows: DataFrame, order: list[str], group: list[str], n: int = 25, row: str | None = None) -> DataFrame:
    """``n`` evenly spaced rows of each group (all, if there are fewer): those numbered int(i * size / n).

    ``order`` starts with a number; see :func:`veilspark.operators.ordered.row_numbers`.
    ``row`` names a column for a row's number in its group, from 0.
    """
    numbered = ordered.row_numbers(rows, order, group)
    place = F.ceil(F.col("__row") * n / F.col("__size"))
    chosen = (F.col("__size") <= n) | ((place < n) & (F.floor(place * F.col("__size") / n) == F.col("__row")))
    kept = numbered.where(chosen).drop("__size")
    return kept.withColumnRenamed("__row", row) if row else kept.drop("__row")


def split_at(chunk: Column, overlap: int, least: int = 200) -> Column:
    """Where a chunk that was too long is cut in two: struct<cut, right>, null if it is shorter than two halves of ``least``.

    The cut stands behind the line end that is nearest to the middle (the one
    before it, if both are as near), or in the middle; the right half starts
    ``overlap`` signs before it, a quarter of the left half at most.
    """
    mid, low = F.floor(F.length(chunk) / 2).cast("int"), F.lit(least)
    ends = F.struct(
        mid.alias("mid"),
        F.locate("\n", F.reverse(F.substring(chunk, low + 1, mid - low))).alias("back"),
        F.locate("\n", F.substring(chunk, mid + 1, F.length(chunk) - least - mid)).alias("ahead"),
    )

    def cut(x: Column) -> Column:
        before, after = x["back"] > 0, x["ahead"] > 0
        near = before & (~after | (x["back"] - 1 <= x["ahead"]))
        return F.when(near, x["mid"] - x["back"] + 1).when(after, x["mid"] + x["ahead"]).otherwise(x["mid"])

    def halves(at: Column) -> Column:
        return F.struct(at.alias("cut"), (at - F.greatest(F.lit(0), F.least(F.lit(overlap), F.floor(at / 4).cast("int")))).alias("right"))

    found = F.transform(F.transform(F.array(ends), cut), halves)  # arrays of one, so that each step is evaluated once
    return F.when(F.length(chunk) >= 2 * least, F.get(found, F.lit(0)))


def classify_columns(cells: DataFrame, findings: DataFrame) -> DataFrame:
    """Columns whose sampled cells are findings: at least one cell equals a finding, and none only contains one.

    ``cells``: (table, column, value); ``findings``: (value, entity, score).
    Equality is a join; containment is looked for among the tokens of a cell.
    """
    f = findings.groupBy(F.col("value").alias("f_value")).agg(F.max_by("entity", F.struct("score", "entity")).alias("entity"), F.max("score").alias("score"))
    whole = cells.join(f, cells["value"] == f["f_value"]).groupBy("table", "column").agg(F.count("*").alias("n_equal"), F.max_by("entity", F.struct("score", "entity")).alias("entity"))
    words = cells.select("table", "column", "value", F.explode(F.split("value", r"[\s,;]+")).alias("w")).where("w <> value")
    part = words.join(f, words["w"] == f["f_value"]).groupBy("table", "column").agg(F.count("*").alias("n_partial"))
    return whole.join(part, ["table", "column"], "left").where("n_partial is null").select("table", "column", "entity", "n_equal")


def csv_records(text: str, delimiter: str | None = None) -> list[list[tuple[int, int]]]:
    """Cells of a CSV text as spans, by record; quotes may hold delimiters and line ends, and are left out of the spans."""
    if delimiter is None:
        header = text.split("\n", 1)[0]
        delimiter = max(",;\t|", key=header.count)
    out: list[list[tuple[int, int]]] = []
    row: list[tuple[int, int]] = []
    start, i, n = 0, 0, len(text)
    while i <= n:
        if i < n and text[i] == '"' and i == start:
            end = i + 1
            while end < n and (text[end] != '"' or text[end + 1 : end + 2] == '"'):
                end += 2 if text[end] == '"' else 1
            row.append((i + 1, end))
            i = end + 1
            while i < n and text[i] not in (delimiter, "\n"):
                i += 1
        else:
            while i < n and text[i] not in (delimiter, "\n"):
                i += 1
            row.append((start, i - (text[i - 1 : i] == "\r" and i > start)))
        if i >= n or text[i] == "\n":
            if len(row) > 1 or row[0][0] < row[0][1]:
                out.append(row)
            row = []
        i += 1
        start = i
    return out


def csv_cells(docs: DataFrame, min_rows: int = 30, regular: float = 0.9, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, row, column, start, end, value) of texts that are CSV tables: at least ``min_rows`` rows, most with as many cells as the header."""
    kind = docs.schema[doc_id].dataType.simpleString()

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: tuple[list, ...] = ([], [], [], [], [], [])
            for d, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                records = csv_records(body or "")
                if len(records) < min_rows + 1 or len(records[0]) < 2:
                    continue
                width = len(records[0])
                good = [r for r in records[1:] if len(r) == width]
                if len(good) < regular * (len(records) - 1):
                    continue
                names = [body[a:b] for a, b in records[0]]
                for i, r in enumerate(good):
                    for name, (a, b) in zip(names, r, strict=True):
                        for x, v in zip(out, (d, i, name, a, b, body[a:b]), strict=True):
                            x.append(v)
            types = (batch.schema.field(0).type, pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, types, strict=True)], [doc_id, "row", "column", "start", "end", "value"])

    return docs.select(doc_id, text).mapInArrow(read, f"`{doc_id}` {kind}, row bigint, column string, start int, end int, value string")


_CREATE = re.compile(r"(?is)\bcreate\s+table\s+(?:if\s+not\s+exists\s+)?[`\"\[]?([\w.]+)[`\"\]]?\s*\((.*?)\)\s*;")
_INSERT = re.compile(r"(?is)\binsert\s+into\s+[`\"\[]?([\w.]+)[`\"\]]?\s*(?:\(([^()]*)\))?\s*values\s*")
_NO_COLUMN = frozenset("primary foreign unique constraint check key index".split())


def sql_records(text: str) -> list[tuple[str, list[str], list[list[tuple[int, int]]]]]:
    """(table, columns, rows of value spans) of the INSERT statements of a text; columns are the statement's, else the CREATE's, else numbers."""
    created = {}
    for m in _CREATE.finditer(text):
        names = [p.split()[0].strip('`"[]') for p in re.split(r",(?![^()]*\))", m[2]) if p.split()]
        created[m[1].lower()] = [n for n in names if n.lower() not in _NO_COLUMN]
    out: dict[str, tuple[str, list[str], list]] = {}
    for m in _INSERT.finditer(text):
        at, rows = m.end(), []
        while at < len(text) and text[at] == "(":
            row, at = [], at + 1
            start = at
            while at < len(text):
                c = text[at]
                if c == "'":
                    end = at + 1
                    while end < len(text) and (text[end] != "'" or text[end + 1 : end + 2] == "'"):
                        end += 2 if text[end] == "'" else 1
                    row.append((at + 1, end))
                    at = start = end + 1
                    while at < len(text) and text[at] not in ",)":
                        at += 1
                elif c in ",)":
                    a, b = start, at
                    while a < b and text[a].isspace():
                        a += 1
                    while b > a and text[b - 1].isspace():
                        b -= 1
                    row.append((a, b))
                else:
                    at += 1
                    continue
                if text[at : at + 1] == ")":
                    break
                at += 1
                start = at
                while start < len(text) and text[start].isspace():
                    start += 1
                at = start
            rows.append(row)
            at += 1
            more = re.compile(r"\s*,\s*(?=\()").match(text, at)
            if not more:
                break
            at = more.end()
        if rows:
            width = len(rows[0])
            columns = [c.strip().strip('`"[]') for c in m[2].split(",")] if m[2] else created.get(m[1].lower(), [str(i) for i in range(width)])
            table = out.setdefault(m[1].lower(), (m[1], columns, []))
            table[2].extend(r for r in rows if len(r) == len(table[1]))
    return list(out.values())


def json_records(text: str) -> list[tuple[str, list[str], list[dict[str, object]]]]:
    """(table, columns, rows) of a JSON text or of JSON lines: each array of objects is a table of dotted columns, nested arrays are tables of their own."""
    try:
        roots = [json.loads(text)]
    except ValueError:
        try:
            roots = [[json.loads(x) for x in text.splitlines() if x.strip()]]
        except ValueError:
            return []
    tables: dict[str, list[dict[str, object]]] = {}

    def flat(x: dict, prefix: str, path: str, row: dict[str, object]) -> None:
        for k, v in x.items():
            if isinstance(v, dict):
                flat(v, f"{prefix}{k}.", path, row)
            elif isinstance(v, list):
                walk(v, f"{path}.{prefix}{k}")
            else:
                row[f"{prefix}{k}"] = v

    def walk(x: object, path: str) -> None:
        if isinstance(x, list):
            if x and all(isinstance(v, dict) for v in x):
                for v in x:
                    row: dict[str, object] = {}
                    flat(v, "", path, row)
                    tables.setdefault(path, []).append(row)
            else:
                for v in x:
                    walk(v, path)
        elif isinstance(x, dict):
            for k, v in x.items():
                walk(v, f"{path}.{k}")

    for root in roots:
        walk(root, "$")
    return [(p, list(dict.fromkeys(k for r in rows for k in r)), rows) for p, rows in tables.items()]


def table_cells(docs: DataFrame, min_rows: int = 30, doc_id: str = "doc_id", text: str = "text", suffix: str = "suffix") -> DataFrame:
    """(doc_id, table, row, column, value) of the tables in texts, read by suffix: .csv and .tsv, .sql, .json, .jsonl and .ndjson."""
    kind = docs.schema[doc_id].dataType.simpleString()

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: tuple[list, ...] = ([], [], [], [], [])

            def add(d, table, rows):
                if len(rows) >= min_rows:
                    for i, row in enumerate(rows):
                        for name, value in row:
                            for x, v in zip(out, (d, table, i, name, value), strict=True):  # noqa: B023
                                x.append(v)

            for d, body, s in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                body = body or ""
                if s in (".csv", ".tsv"):
                    records = csv_records(body, "\t" if s == ".tsv" else None)
                    names = [body[a:b] for a, b in records[0]] if records else []
                    add(d, "", [[(n, body[a:b]) for n, (a, b) in zip(names, r, strict=False)] for r in records[1:]])
                elif s == ".sql":
                    for table, columns, rows in sql_records(body):
                        add(d, table, [[(n, body[a:b]) for n, (a, b) in zip(columns, r, strict=True)] for r in rows])
                elif s in (".json", ".jsonl", ".ndjson"):
                    for table, _, rows in json_records(body):
                        add(d, table, [[(k, None if v is None else str(v)) for k, v in r.items()] for r in rows])
            types = (batch.schema.field(0).type, pa.string(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, types, strict=True)], [doc_id, "table", "row", "column", "value"])

    return docs.select(doc_id, text, suffix).mapInArrow(read, f"`{doc_id}` {kind}, table string, row bigint, column string, value string")

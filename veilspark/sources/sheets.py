"""Terms from spreadsheets (.xlsx): the first sheet's cells as rows, within limits that a bomb does not pass."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree as ET

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Parts of a file, bytes that they may have when unpacked, and how many times their packed size that may be.
MOST_PARTS, MOST_BYTES, MOST_RATIO = 500, 50_000_000, 200
_NS = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"


class SheetError(ValueError):
    """Why a spreadsheet is refused."""


def _part(z: zipfile.ZipFile, name: str) -> bytes:
    with z.open(name) as data:
        raw = data.read(MOST_BYTES + 1)
    if len(raw) > MOST_BYTES:
        raise SheetError("too large")
    if b"<!DOCTYPE" in raw[:2000] or b"<!ENTITY" in raw:
        raise SheetError("entities")
    return raw


def cells(raw: bytes) -> Iterator[tuple[int, int, str]]:
    """(row, column, text) of the cells of the first sheet, from 0, in order."""
    try:
        with zipfile.ZipFile(io.BytesIO(raw)) as z:
            infos = z.infolist()
            if len(infos) > MOST_PARTS or sum(i.file_size for i in infos) > MOST_BYTES or any(i.file_size > 1_000_000 and i.file_size > MOST_RATIO * max(1, i.compress_size) for i in infos):
                raise SheetError("too large")
            sheets = sorted((n for n in z.namelist() if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n)), key=lambda n: int(re.findall(r"\d+", n)[0]))
            if not sheets:
                raise SheetError("no sheet")
            shared = ["".join(t.text or "" for t in s.iter(f"{_NS}t")) for s in ET.fromstring(_part(z, "xl/sharedStrings.xml")).iter(f"{_NS}si")] if "xl/sharedStrings.xml" in z.namelist() else []
            for at, row in enumerate(ET.fromstring(_part(z, sheets[0])).iter(f"{_NS}row")):
                for k, cell in enumerate(row.iter(f"{_NS}c")):
                    letters = re.match(r"[A-Z]*", cell.get("r", ""))[0]
                    column = sum((ord(c) - 64) * 26**i for i, c in enumerate(reversed(letters))) - 1 if letters else k
                    value = cell.findtext(f"{_NS}v")
                    if cell.get("t") == "s" and value is not None:
                        value = shared[int(value)]
                    elif cell.get("t") == "inlineStr":
                        value = "".join(t.text or "" for t in cell.iter(f"{_NS}t"))
                    if value is not None:
                        yield at, column, value
    except (zipfile.BadZipFile, ET.ParseError, IndexError, KeyError) as e:
        raise SheetError(type(e).__name__) from e


def sheet_lines(spark: SparkSession, path: str) -> DataFrame:
    """(value, n): the first column that is used in each row of the first sheet, in order; a file that is refused stops the job."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for raw in batch.column(0).to_pylist():
                first: dict[int, tuple[int, str]] = {}
                for row, column, text in cells(raw or b""):
                    if text.strip() and (row not in first or column < first[row][0]):
                        first[row] = column, text
                yield pa.RecordBatch.from_arrays([pa.array([t for _, t in first.values()], pa.string()), pa.array(list(first), pa.int64())], ["value", "n"])

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(read, "value string, n bigint")

"""Compiled Java classes as texts: the strings of their constant pools, and classes rebuilt with other strings.

A class is read by a table of layouts, one for each attribute, that says which
numbers are references to the constant pool and of what use they are.  A text of
the pool may change if it is only ever used as a string, an annotation's text or
the name of the source file; names and descriptors never change.  A class that is
not fully understood (an unknown attribute, bytes left over, a broken reference)
is refused as a whole: what was not read cannot be said to be clean.  Nothing is
loaded or run; numbers and strings made at run time are not covered.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class ClassError(ValueError):
    """Why a class is refused."""


# Sizes of the pool's entries by tag (text apart), which of them are texts' users, and the layouts of the standard attributes.
SIZES = {3: 4, 4: 4, 5: 8, 6: 8, 7: 2, 8: 2, 9: 4, 10: 4, 11: 4, 12: 4, 15: 3, 16: 2, 17: 4, 18: 4, 19: 2, 20: 2}
#: Layouts: 1 2 4 numbers, u a name in the pool, t a text that may change, r another entry, * the rest, { } repeated as often as a number of two bytes before says, [ ] of one byte,
#: A attributes, N annotation, V an annotation's value, T a type annotation's target, C the code.
LAYOUTS = {
    "ConstantValue": "r", "Code": "22C{222r}A", "Synthetic": "", "Deprecated": "", "SourceFile": "t", "Signature": "u", "Exceptions": "{r}", "NestMembers": "{r}", "PermittedSubclasses": "{r}", "ModulePackages": "{r}",
    "NestHost": "r", "ModuleMainClass": "r", "EnclosingMethod": "rr", "InnerClasses": "{rru2}", "LocalVariableTable": "{22uu2}", "LocalVariableTypeTable": "{22uu2}", "MethodParameters": "[u2]",
    "RuntimeVisibleAnnotations": "{N}", "RuntimeInvisibleAnnotations": "{N}", "RuntimeVisibleParameterAnnotations": "[{N}]", "RuntimeInvisibleParameterAnnotations": "[{N}]",
    "RuntimeVisibleTypeAnnotations": "{T[11]N}", "RuntimeInvisibleTypeAnnotations": "{T[11]N}", "AnnotationDefault": "V", "BootstrapMethods": "{r{r}}", "Record": "{uuA}", "StackMapTable": "*", "LineNumberTable": "*",
    "Module": "r2u{r2u}{r2{r}}{r2{r}}{r}{r{r}}",
}
TARGETS = {**dict.fromkeys((0x00, 0x01, 0x16), "1"), **dict.fromkeys((0x10, 0x17, 0x42, 0x43, 0x44, 0x45, 0x46), "2"), 0x11: "11", 0x12: "11", **dict.fromkeys((0x13, 0x14, 0x15), ""), 0x40: "{222}", 0x41: "{222}", **dict.fromkeys(range(0x47, 0x4C), "21")}
VALUES = {**dict.fromkeys("BCDFIJSZ", "r"), "s": "t", "e": "uu", "c": "u", "@": "N", "[": "{V}"}
CLASS, MEMBER = "2rr{r}", "2uuA"


def text_of(raw: bytes) -> str:
    """A text of the pool: UTF-8 in which a zero has two bytes, and signs beyond 16 bits are two of three bytes."""
    if b"\0" in raw or any(b >= 0xF0 for b in raw):
        raise ClassError("text")
    try:
        return raw.replace(b"\xc0\x80", b"\0").decode("utf-8", "surrogatepass").encode("utf-16", "surrogatepass").decode("utf-16")
    except UnicodeError as e:
        raise ClassError("text") from e


def bytes_of(text: str) -> bytes:
    units = text.encode("utf-16-be")
    halves = "".join(chr(x) for (x,) in struct.iter_unpack(">H", units))
    raw = halves.encode("utf-8", "surrogatepass").replace(b"\0", b"\xc0\x80")
    if len(raw) > 0xFFFF:
        raise ClassError("text too long")
    return raw


class JavaClass:
    """The pool of a class, and which of its texts may change."""

    def __init__(self, raw: bytes) -> None:
        self.raw, self.at = raw, 0
        if self._take(4) != b"\xca\xfe\xba\xbe":
            raise ClassError("magic")
        self._take(4)
        self.pool: dict[int, tuple[int, bytes, int]] = {}  # tag, what the entry holds, where it begins
        count, i = self._number(2), 1
        while i < count:
            begin, tag = self.at, self._number(1)
            if tag != 1 and tag not in SIZES:
                raise ClassError(f"tag {tag}")
            self.pool[i] = tag, self._take(self._number(2) if tag == 1 else SIZES[tag]), begin
            i += 2 if tag in (5, 6) else 1
        self.pool_end = self.at
        self.names: set[int] = set()
        self.texts: set[int] = set()
        for tag, held, _ in list(self.pool.values()):
            if tag == 8:
                self._text(int.from_bytes(held, "big"))
            elif tag in (7, 16, 19, 20):
                self._name(int.from_bytes(held, "big"))
            elif tag == 12:
                self._name(int.from_bytes(held[:2], "big"))
                self._name(int.from_bytes(held[2:], "big"))
        self._read(CLASS, len(raw), 0)
        for _ in range(2):
            for _ in range(self._number(2)):
                self._read(MEMBER, len(raw), 0)
        self._read("A", len(raw), 0)
        if self.at != len(raw):
            raise ClassError("bytes left over")

    def _take(self, n: int) -> bytes:
        if self.at + n > len(self.raw):
            raise ClassError("cut short")
        self.at += n
        return self.raw[self.at - n : self.at]

    def _number(self, n: int) -> int:
        return int.from_bytes(self._take(n), "big")

    def _name(self, i: int) -> str:
        if self.pool.get(i, (0,))[0] != 1:
            raise ClassError(f"reference {i}")
        self.names.add(i)
        return text_of(self.pool[i][1])

    def _text(self, i: int) -> None:
        if self.pool.get(i, (0,))[0] != 1:
            raise ClassError(f"reference {i}")
        text_of(self.pool[i][1])
        self.texts.add(i)

    def _read(self, layout: str, end: int, depth: int) -> None:
        if depth > 40:
            raise ClassError("depth")
        k = 0
        while k < len(layout):
            c = layout[k]
            if c in "124":
                self._take(int(c))
            elif c in "{[":
                close, level = k, 0
                while True:
                    level += (layout[close] in "{[") - (layout[close] in "}]")
                    if not level:
                        break
                    close += 1
                for _ in range(self._number(2 if c == "{" else 1)):
                    self._read(layout[k + 1 : close], end, depth + 1)
                k = close
            elif c in "ur":
                i = self._number(2)
                if i and c == "u":
                    self._name(i)
                elif i and i not in self.pool:
                    raise ClassError(f"reference {i}")
            elif c == "t":
                self._text(self._number(2))
            elif c == "*":
                self._take(end - self.at)
            elif c == "C":
                self._take(self._number(4))
            elif c == "N":
                self._name(self._number(2))
                self._read("{uV}", end, depth + 1)
            elif c in "VT":
                kind = self._number(1)
                form = VALUES.get(chr(kind)) if c == "V" else TARGETS.get(kind)
                if form is None:
                    raise ClassError(f"annotation {kind}")
                self._read(form, end, depth + 1)
            elif c == "A":
                for _ in range(self._number(2)):
                    name = self._name(self._number(2))
                    stop = self._number(4) + self.at
                    if name not in LAYOUTS:
                        raise ClassError(f"attribute {name}")
                    self._read(LAYOUTS[name], stop, depth + 1)
                    if self.at != stop:
                        raise ClassError(f"attribute {name} length")
            k += 1

    def strings(self) -> list[tuple[int, str]]:
        """(place in the pool, text) of the texts that may change."""
        return [(i, text_of(self.pool[i][1])) for i in sorted(self.texts - self.names)]

    def fixed(self) -> list[tuple[int, str]]:
        """(place, text) of strings that are names too: they are seen and cannot change."""
        return [(i, text_of(self.pool[i][1])) for i in sorted(self.texts & self.names)]

    def rebuilt(self, new: dict[int, str]) -> bytes:
        """The class with other texts; what is outside the pool keeps every byte, as it refers to places alone."""
        if not set(new) <= self.texts - self.names:
            raise ClassError("a name cannot change")
        out, at = [], 0
        for i in sorted(new):
            _, held, begin = self.pool[i]
            raw = bytes_of(new[i])
            out += [self.raw[at:begin], b"\x01", len(raw).to_bytes(2, "big"), raw]
            at = begin + 3 + len(held)
        done = b"".join([*out, self.raw[at:]])
        if [t for _, t in JavaClass(done).strings()] != [new.get(i, t) for i, t in self.strings()]:
            raise ClassError("rebuilt class differs")
        return done


def class_strings(files: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """(path, place, text, editable, problem): a row for each string of each class; a class that is refused is one row with its problem."""
    kind = files.schema[path].dataType.simpleString()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, rows = [], []
            for k, raw in enumerate(batch.column(1).to_pylist()):
                try:
                    own = JavaClass(raw or b"")
                    new = [(i, t, True, None) for i, t in own.strings()] + [(i, t, False, None) for i, t in own.fixed()]
                except ClassError as e:
                    new = [(None, None, None, str(e))]
                at += [k] * len(new)
                rows += new
            cols = [pa.array([r[j] for r in rows], t) for j, t in enumerate((pa.int32(), pa.string(), pa.bool_(), pa.string()))]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), *cols], ["path", "place", "text", "editable", "problem"])

    return files.select(path, content).mapInArrow(scan, f"path {kind}, place int, text string, editable boolean, problem string")


def rebuilt_classes(files: DataFrame, changes: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """``files`` (path, content) with new_content and problem; ``changes``: path, place, text.

    Without changes a class keeps its bytes; a class that is refused, or a change
    of a name, gives a problem and no content.
    """
    by_file = changes.groupBy(F.col("path").alias("__of")).agg(F.map_from_entries(F.collect_set(F.struct("place", "text"))).alias("__new"))
    joined = files.select(path, content).join(by_file, F.col(path).eqNullSafe(F.col("__of")), "left").drop("__of")
    kind = files.schema[path].dataType.simpleString()

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, problems = [], []
            for raw, new in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                try:
                    out.append(JavaClass(raw or b"").rebuilt(dict(new or [])))
                    problems.append(None)
                except ClassError as e:
                    out.append(None)
                    problems.append(str(e))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary()), pa.array(problems, pa.string())], ["path", "new_content", "problem"])

    return joined.mapInArrow(build, f"path {kind}, new_content binary, problem string")

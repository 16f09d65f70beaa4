"""Compiled classes, project trees, and outlines of line formats."""

from __future__ import annotations

import os
import zipfile
from pathlib import Path

import pyspark
import pytest

from veilspark.operators import validate
from veilspark.sources import files, javaclass, sheets
from veilspark.sources.javaclass import ClassError, JavaClass


@pytest.fixture(scope="module")
def classes() -> dict[str, bytes]:
    """Some real classes: those of one of Spark's own libraries."""
    jar = next(Path(pyspark.__file__).parent.glob("jars/commons-lang3*.jar"))
    with zipfile.ZipFile(jar) as z:
        return {n: z.read(n) for n in sorted(z.namelist())[:120] if n.endswith(".class")}


def test_classes_come_back_byte_for_byte(classes):
    for raw in classes.values():
        own = JavaClass(raw)
        assert own.rebuilt({}) == raw
        for i, text in own.strings()[:3]:
            new = JavaClass(own.rebuilt({i: f"{text} é\0𝒳 longer"}))
            assert dict(new.strings())[i] == f"{text} é\0𝒳 longer" and new.names == own.names
            assert new.rebuilt({i: text}) == raw


def test_classes_that_are_not_understood_are_refused(classes):
    raw = next(r for r in classes.values() if JavaClass(r).strings())
    own = JavaClass(raw)
    for bad in (b"", raw[:-1], raw + b"\0", b"\xca\xfe\xba\xbf" + raw[4:], raw.replace(b"\x00\x04Code", b"\x00\x04Cobe")):
        with pytest.raises(ClassError):
            JavaClass(bad)
    with pytest.raises(ClassError, match="name"):
        own.rebuilt({min(own.names): "x"})
    with pytest.raises(ClassError, match="long"):
        own.rebuilt({own.strings()[0][0]: "x" * 70_000})


def test_class_tables(spark, classes):
    rows = [*list(classes.items())[:8], ("broken", b"\xca\xfe\xba\xbe\0"), ("none", None), (None, next(r for r in classes.values() if JavaClass(r).strings()))]
    df = spark.createDataFrame(rows, "path string, content binary")
    seen = javaclass.class_strings(df).collect()
    assert {r.path for r in seen if r.problem} == {"broken", "none"} and any(r.path is None for r in seen)
    first = next(r for r in seen if r.editable and r.path)
    changes = spark.createDataFrame([(first.path, first.place, "mask_x_1"), ("broken", 1, "x")], "path string, place int, text string")
    out = {r.path: r for r in javaclass.rebuilt_classes(df, changes).collect()}
    assert dict(JavaClass(bytes(out[first.path].new_content)).strings())[first.place] == "mask_x_1"
    assert out["broken"].new_content is None and out["broken"].problem and all(bytes(out[p].new_content) == c for p, c in rows[:8] if p != first.path)


def test_trees_with_hidden_empty_and_linked_files(spark, tmp_path):
    root = tmp_path / "p"
    for name, data in {".env": b"A=1", "a/.hidden/x.txt": b"deep", "a/b/c/d/e.txt": "é".encode(), "_under": b"", "z.bin": b"\0\1", "big": b"x" * 50}.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_bytes(data)
    os.symlink(root / "z.bin", root / "link")
    os.symlink(root / "a", root / "loop")
    (root / "empty").mkdir()
    got = {r.path: (r.size, r.is_link, r.content and bytes(r.content)) for r in files.read_tree(spark, str(root)).collect()}
    assert got == {".env": (3, False, b"A=1"), "a/.hidden/x.txt": (4, False, b"deep"), "a/b/c/d/e.txt": (2, False, "é".encode()), "_under": (0, False, b""), "z.bin": (2, False, b"\0\1"), "big": (50, False, b"x" * 50), "link": (0, True, None), "loop": (0, True, None)}
    states = {r.path: r.status for r in files.texts(files.read_tree(spark, str(root))).collect()}
    assert states["link"] == states["loop"] == "skipped_symlink" and states[".env"] == "excluded" and states["_under"] == "text_ready"
    assert "content" not in files.read_tree(spark, str(root), content=False).columns
    assert files.read_tree(spark, str(root / "empty")).count() == 0
    with pytest.raises(Exception, match="(?i)not|no such"):
        files.read_tree(spark, str(root / "absent")).count()


@pytest.mark.parametrize(
    ("suffix", "before", "after", "problem"),
    [
        (".yaml", 'a: b\n- c: "d"\n', 'a: mask_x_1\n- c: "mask_y_2"\n', None), (".yml", 'a: "b"\n', "a: mask_1\n", "lines: shape"), (".yaml", "k:\n  - x\n", "k:\n- x\n", "lines: shape"), (".properties", "a=b\nc = d e\n", "a=mask_1\nc = mask_2 e\n", None),
        (".properties", "a=b\\\n c\n", "a=mask\n", "lines: shape"), (".json", '{"a":1,"a":"x"}', '{"a":2,"a":"y"}', None), (".json", '{"a":1,"a":"x"}', '{"a":"y","a":"x"}', "json: types"),
    ],
)
def test_outlines_and_repeated_names(suffix, before, after, problem):
    assert validate.broken(before, after, suffix) == problem


def test_wide_encodings_must_come_back():
    assert files.decoded("ab\n".encode("utf-16-le"))[0] == "text_ready"
    assert files.decoded(b"\0\xd8\n\0")[0] == "copied_binary"


def sheet(path: Path, rows: list[list[str | None]], extra: dict[str, bytes] | None = None) -> None:
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    shared = sorted({v for r in rows for v in r if v})
    body = "".join(f"<row>{''.join(f'<c r=%s t=%s><v>{shared.index(v)}</v></c>' % (chr(34) + chr(65 + k) + str(i + 1) + chr(34), chr(34) + 's' + chr(34)) for k, v in enumerate(r) if v)}</row>" for i, r in enumerate(rows))
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("xl/worksheets/sheet1.xml", f"<worksheet {ns}><sheetData>{body}</sheetData></worksheet>")
        z.writestr("xl/sharedStrings.xml", f"<sst {ns}>{''.join(f'<si><r><t>{v[:1]}</t></r><r><t>{v[1:]}</t></r></si>' for v in shared)}</sst>")
        for name, data in (extra or {}).items():
            z.writestr(name, data)


def test_terms_of_spreadsheets(spark, tmp_path):
    sheet(tmp_path / "t.xlsx", [["Terim", "x"], ["Acme", "1"], [None, "Beta Kod"], ["ACME", None], ["", ""]])
    assert sorted(r.term for r in files.term_rows(spark, str(tmp_path / "t.xlsx")).collect()) == ["Acme", "Beta Kod"]
    for name, extra in (("bomb", {"xl/media/a": b"0" * 60_000_000}), ("ratio", {"xl/media/a": b"0" * 20_000_000}), ("parts", {f"p{i}": b"" for i in range(600)})):
        sheet(tmp_path / f"{name}.xlsx", [["a"]], extra)
        with pytest.raises(sheets.SheetError, match="too large"):
            list(sheets.cells((tmp_path / f"{name}.xlsx").read_bytes()))
    with pytest.raises(sheets.SheetError):
        list(sheets.cells(b"no zip"))


def test_trees_are_read_in_small_parts(tmp_path, monkeypatch):
    from veilspark.sources import tree

    monkeypatch.setattr(tree, "FILES", 4)
    monkeypatch.setattr(tree, "BATCH", 100)
    for i in range(10):
        (tmp_path / f"{i}.txt").write_text("x" * 60)
    reader = tree.TreeReader({"path": str(tmp_path)})
    parts = reader.partitions()
    assert [len(p.paths) for p in parts] == [4, 4, 2]
    batches = [b for p in parts for b in reader.read(p)]
    assert [b.num_rows for b in batches] == [2] * 5 and [p for b in batches for p in b.column(0).to_pylist()] == [f"{i}.txt" for i in range(10)]


def test_batches_are_cut_by_their_texts():
    import pyarrow as pa
    from veilspark.functions.arrays import sliced

    batch = pa.RecordBatch.from_arrays([pa.array(range(5)), pa.array(["a" * 6, None, "b" * 6, "c" * 30, ""])], ["n", "t"])
    assert [b.column(0).to_pylist() for b in sliced([batch, batch.slice(0, 0)], 1, 10)] == [[0, 1], [2], [3], [4]]

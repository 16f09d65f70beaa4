"""Publication, decisions on held files, and addresses in lock files."""

from __future__ import annotations

import json
import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from veilspark.operators import locks, warnings
from veilspark.sources import publish


def tree(root: Path) -> dict[str, str]:
    run = (root / "CURRENT").read_text()
    top = root / "versions" / run
    return {str(p.relative_to(top)): p.read_text() for p in top.rglob("*") if p.is_file()}


def files(spark, **texts: str):
    return spark.createDataFrame([(k.replace("__", "/"), v) for k, v in texts.items()], "path string, content string").repartition(3)


def write(df, root: Path, run: str, **options: str) -> None:
    df.sparkSession.dataSource.register(publish.PublishedTree)
    df.write.format("published_tree").option("path", str(root)).option("run", run).options(**options).mode("append").save()


def test_runs_replace_each_other(spark, tmp_path):
    root = tmp_path / "out"
    write(files(spark, a__x="one", b="é"), root, "r1")
    assert tree(root) == {"a/x": "one", "b": "é"}
    write(files(spark, a__y="two"), root, "r2")
    assert tree(root) == {"a/y": "two"} and not (root / "versions" / "r1").exists() and not (root / "journal.json").exists()
    write(files(spark, c="three"), root, "r3", keep="1")
    assert (root / "versions" / "r2").exists()
    got = publish.published(spark, str(root)).select("path", "size", F.col("content").cast("string").alias("t")).collect()
    assert [tuple(r) for r in got] == [("c", 5, "three")]
    write(spark.createDataFrame([], "path string, content string"), root, "r4")
    assert tree(root) == {} and publish.published(spark, str(root)).count() == 0
    with pytest.raises(Exception, match="published already"):
        write(files(spark, d="x"), root, "r4")


def test_a_failed_run_leaves_the_old_tree(spark, tmp_path):
    root = tmp_path / "out"
    write(files(spark, a="old"), root, "r1")
    for bad in ("../up", "/abs", "a/../b", "a//b", "w\\in", ""):
        with pytest.raises(Exception, match="unsafe path"):
            write(spark.createDataFrame([("fine", "new"), (bad, "new")], "path string, content string"), root, "r2")
        assert tree(root) == {"a": "old"} and not (root / "versions" / "r2").exists() and not (root / "journal.json").exists()


def test_a_killed_run_leaves_the_old_tree_and_is_recovered(spark, tmp_path):
    """The writer's own calls, stopped at each point where a process may die."""
    root = tmp_path / "out"
    write(files(spark, a="old"), root, "r1")
    rows = [{"path": "n/b", "content": "new"}, {"path": "c", "content": b"\x00\xff"}]

    def begun(run: str) -> publish.PublishedWriter:
        return publish.PublishedWriter({"path": str(root), "run": run}, ["path", "content"])

    begun("r2").write(iter(rows))  # killed before the commit
    assert tree(root) == {"a": "old"}
    with pytest.raises(ValueError, match="another run"):
        begun("r3")
    assert publish.recover(str(root)) == "removed" and not (root / "versions" / "r2").exists()
    assert publish.recover(str(root)) == "missing"
    writer = begun("r3")
    messages = [writer.write(iter(rows)), writer.write(iter(rows))]  # an attempt that was doubled
    real = publish.tidied

    def dies(*_) -> None:
        raise KeyboardInterrupt

    publish.tidied = dies
    try:
        with pytest.raises(KeyboardInterrupt):
            writer.commit(messages)  # killed after the run counts, before its tidying
    finally:
        publish.tidied = real
    assert set(tree_bytes(root)) == {"n/b", "c"} and (root / "versions" / "r1").exists()
    assert publish.recover(str(root)) == "finished" and not (root / "versions" / "r1").exists() and set(tree_bytes(root)) == {"n/b", "c"}
    assert json.loads((root / "versions" / "r3.json").read_text())["before"] == "r1"


def test_hidden_files_are_published_too(spark, tmp_path):
    write(files(spark, **{"_a": "x", "b__.c": "y"}), tmp_path / "out", "r1")
    got = publish.published(spark, str(tmp_path / "out")).select("path", "size", F.col("content").cast("string").alias("t")).collect()
    assert sorted(map(tuple, got)) == [("_a", 1, "x"), ("b/.c", 1, "y")]


def test_a_task_that_outlives_its_run_writes_nothing(tmp_path):
    root = tmp_path / "out"
    writer = publish.PublishedWriter({"path": str(root), "run": "r1"}, ["path", "content"])

    def rows():
        yield {"path": "a/x", "content": "new"}
        writer.abort([])
        yield {"path": "b/y", "content": "new"}

    with pytest.raises(OSError):
        writer.write(rows())
    assert not list((root / "versions").iterdir()) and not (root / "journal.json").exists() and not (root / "gone").exists()


def tree_bytes(root: Path) -> dict[str, bytes]:
    top = root / "versions" / (root / "CURRENT").read_text()
    return {str(p.relative_to(top)): p.read_bytes() for p in top.rglob("*") if p.is_file()}


def test_failed_files_lie_beside(spark, tmp_path):
    done = spark.createDataFrame([("a", "x", "READY"), ("b", "y", "SECURITY_QUARANTINE"), ("c", None, "READY"), ("d", "z", None)], "path string, masked_text string, final_state string")
    publish.publish(done, str(tmp_path / "out"), "r1")
    assert tree(tmp_path / "out") == {"a": "x", "c": ""} and tree(tmp_path / "out-failed") == {"b": "y", "d": "z"}
    with pytest.raises(ValueError, match="path"):
        publish.publish(done.withColumn("path", F.lit(None).cast("string")), str(tmp_path / "out"), "r2")


# -- decisions -----------------------------------------------------------------------------------


def plain(held: list[tuple], actions: list[tuple], checks: dict[int, bool]) -> tuple[dict, dict]:
    state = {w[0]: list(w) for w in held}
    told = {}
    for i, w, version, act in sorted(actions):
        if w not in state:
            told[i] = "unknown_warning"
            continue
        own = state[w]
        _, status, now, check, failed, kind, n = own

        def reason(failed: bool) -> bool:
            return act not in warnings.RESULT or act in ("dismiss", "mask") and failed or act == "accept_syntax_error" and check != "sozdizimi" or act == "mask" and (kind == "lock" or check == "inceleme" or not n)  # noqa: B023

        if status == "pending" and version == now and not reason(failed):
            bad = act != "confirm" and not checks.get(i, False)
            own[1], own[2], own[4] = ("pending" if bad else warnings.RESULT[act]), now + 1, failed or bad
            told[i] = "check_failed" if bad else "applied"
        else:
            told[i] = "refused" if reason(next(h[4] for h in held if h[0] == w)) else "conflict"
    return {w: (s[1], s[2], s[4]) for w, s in state.items()}, told


def test_decisions_compare_and_set(spark):
    rng = random.Random(5)
    held = [(w, rng.choice(["pending", "pending", "pending", "dismissed"]), rng.randrange(2), rng.choice(["sozdizimi", "llm_denetimi", "inceleme"]), rng.random() < 0.2, rng.choice(["text", "lock"]), rng.randrange(2)) for w in range(40)]
    actions = [(i, rng.randrange(44), rng.randrange(4), rng.choice([*warnings.RESULT, "other"])) for i in range(600)]
    actions += [(1000 + i, 1, 0, "dismiss") for i in range(200)]  # one warning with very many
    checks = {i: rng.random() < 0.5 for i, *_ in actions if rng.random() < 0.8}
    state, told = warnings.apply_actions(
        spark.createDataFrame(held, "warning_id int, status string, version int, failed_check string, audit_failed boolean, kind string, n_evidence int"),
        spark.createDataFrame(actions, "action_id int, warning_id int, version int, action string").repartition(4),
        spark.createDataFrame(list(checks.items()), "action_id int, passed boolean"),
    )
    want_state, want_told = plain(held, actions, checks)
    assert {r.warning_id: (r.status, r.version, r.audit_failed) for r in state.collect()} == want_state
    assert {r.action_id: r.outcome for r in told.collect()} == want_told
    assert all((r.reason is not None) == (r.outcome == "refused") for r in told.collect())


# -- lock files ----------------------------------------------------------------------------------


def test_lock_files_keep_all_but_addresses(spark):
    text = 'lodash@^4:\n  resolved "https://registry.npmjs.org/lodash.tgz#abc"\nint@1:\n  resolved "https://nexus.acme.local:8081/repo/int-1.0.tgz"\n  integrity sha512-AAAA==\n[x]\nsource = "registry+https://ci:pw@github.com/a"\nagain: https://nexus.acme.local:8081/repo/int-1.0.tgz,\n'
    rows = [(1, text), (None, text), (2, "no address"), (3, None), (4, "https://mask-paket-adresi-9.invalid and https://nexus.x/y")]
    done, table = locks.mask_addresses(spark.createDataFrame(rows, "doc_id int, text string"))
    got = {r.doc_id: r for r in done.collect()}
    numbers = {r.value: r.placeholder.replace("_", "-") for r in table.collect()}
    want = text
    for value, placeholder in numbers.items():
        want = want.replace(value, f"https://{placeholder}.invalid")
    assert got[1].masked_text == got[None].masked_text == want and "acme" not in want and "pw@" not in want and "registry.npmjs.org/lodash" in want
    assert got[1].n_masked == 3 and got[1].sound and got[2].sound and got[3].masked_text == ""
    assert json.loads(json.dumps(got[4].masked_text)) and got[4].n_masked >= 1

"""Operators 11 to 13 against plain versions."""

from __future__ import annotations

import random
import zlib
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tests.llm import brute
from veilspark.llm import common, decontaminate, jaccard, language, licenses, queries, ranked, repeats, sharding, trie
from veilspark.llm.ordering import placed

DOC = "doc_id bigint, text string, shard string, slot double, score string, rank string"


def text(rng: random.Random, n: int, vocabulary: int = 60) -> str:
    return " ".join(f"w{int(vocabulary * rng.random() ** 2)}" for _ in range(n))


@pytest.fixture(scope="module")
def corpus() -> list[tuple]:
    rng = random.Random(4)
    rows: list[tuple] = [(i, text(rng, rng.randrange(1, 80))) for i in range(150)]
    rows += [(200 + i, rows[3][1]) for i in range(60)]  # a group of copies
    rows += [(7, text(rng, 30))] * 40 + [(7, rows[5][1])]  # one id on many rows
    rows += [(300, ""), (301, None), (302, "É é É 日本 x-y_z 3.14 \u0085 ~"), (303, "-- !!"), (304, text(rng, 30000, 5000)), (None, rows[3][1]), (None, None), (None, None)]
    return rows


@pytest.fixture(scope="module")
def docs(spark, corpus):
    return spark.createDataFrame([(*r, "a", 1.0, "b", "c") for r in corpus], DOC).repartition(5)


# -- 11 ------------------------------------------------------------------------------------------


def test_shards_against_brute_force(docs, corpus):
    out = sharding.shard_table(docs).collect()
    want = sorted(zip([d for d, _ in corpus], [len((t or "").encode()) + 8 for _, t in corpus], [zlib.crc32((t or "").encode()) for _, t in corpus], brute.shards([d for d, _ in corpus], 24), brute.shards([d for d, _ in corpus], 25), strict=True), key=str)
    assert sorted(((r.doc_id, r.size, r.text_crc32, r.shard, r.grown_shard) for r in out), key=str) == want
    assert all(r.law == "key" and r.grown_shard in (r.shard, 24) for r in out)
    slots: dict = {}
    for r in out:
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_slots_do_not_depend_on_files(docs):
    one, two = (sharding.shard_table(d).select("doc_id", "size", "text_crc32", "shard", "slot").collect() for d in (docs, docs.repartition(11, "text")))
    assert sorted(map(tuple, one), key=str) == sorted(map(tuple, two), key=str)


def test_weights_and_what_a_change_moves(spark):
    rows = spark.range(30000).select(F.col("id").alias("k"), F.lit("x").alias("shard"))
    shares = {r.shard: r for r in sharding.balance(sharding.sharded(rows, ["k"], {0: 1.0, 1: 2.0, 5: 3.0, 6: 0.0}), F.lit(1), {0: 1.0, 1: 2.0, 5: 3.0}).collect()}
    assert set(shares) == {0, 1, 5}
    assert all(abs(r.row_share - r.due_share) < 0.02 for r in shares.values())
    moves = sharding.moved(rows, ["k"], {0: 1.0, 1: 2.0, 5: 3.0}, {0: 1.0, 1: 2.0, 5: 3.0, 7: 2.0}).collect()
    assert {r.to_shard for r in moves} == {7}
    assert sum(r.n_rows for r in moves) == pytest.approx(30000 / 4, rel=0.06)
    back = sharding.moved(rows, ["k"], 8, {s: 1.0 for s in range(8) if s != 3}).collect()
    assert {r.from_shard for r in back} == {3}
    heavier = sharding.moved(rows, ["k"], {0: 1.0, 1: 1.0, 2: 1.0}, {0: 1.0, 1: 1.5, 2: 1.0}).collect()
    assert {r.to_shard for r in heavier} == {1}
    with pytest.raises(ValueError, match="weights"):
        sharding.weights_of({0: 0.0})


def test_keys_of_several_columns(spark):
    rows = spark.createDataFrame([("a", "bc"), ("ab", "c"), (None, "abc"), ("", "abc"), ("-", "abc")], "a string, b string")
    keys = [r[0] for r in rows.select(sharding.stable_key(F.col("a"), F.col("b"))).collect()]
    assert len(set(keys)) == 5


def test_shards_of_empty_and_written_files(spark, docs, tmp_path):
    assert sharding.shard_table(docs.limit(0)).count() == 0
    out = sharding.slotted(sharding.sharded(docs.select("doc_id", "text"), ["doc_id"], 3), ["doc_id", "text"])
    sharding.write_shards(out, f"{tmp_path}/shards")
    again = spark.read.parquet(f"{tmp_path}/shards")
    assert sorted(map(str, again.select("doc_id", "text", "shard", "slot").collect())) == sorted(map(str, out.select("doc_id", "text", "shard", "slot").collect()))


def test_no_python_in_the_native_plan(spark):
    plan = sharding.shard_table(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_places_of_one_group_and_of_ties(spark):
    rows = spark.createDataFrame([("g", 1)] * 500 + [(None, 2), (None, 1), ("h", None), ("h", 0)], "g string, x int").repartition(6)
    out = placed(rows, ["g"], [F.col("x").asc_nulls_first()]).collect()
    assert sorted(r["__place"] for r in out if r.g == "g") == list(range(500))
    assert sorted((r.x if r.x is not None else -1, r["__place"]) for r in out if r.g != "g" and r.g is not None) == [(-1, 0), (0, 1)]
    assert sorted((r.x, r["__place"]) for r in out if r.g is None) == [(1, 0), (2, 1)]


# -- 12 ------------------------------------------------------------------------------------------

ITEMS = [(1, "w1 w2 w2 W3 w59"), (2, "w0"), (3, "nothing here"), (4, None), (5, ""), (6, "É é 日本 x z 14"), (7, "w10 w11 w12"), (7, "w10 w13"), (7, "w10 w13"), (None, "w4 w5")]


@pytest.mark.parametrize(("window", "block", "k"), [(1 << 14, 500_000, 20), (7, 5, 3), (1, 1, 1)])
def test_ranking_against_brute_force(spark, docs, corpus, window, block, k):
    items = spark.createDataFrame([(*i, 1) for i in ITEMS], "item_id bigint, text string, doc_id int")
    got = ranked.search(docs, items, k, window=window, block_terms=block).collect()
    want = brute.ranking(corpus, ITEMS, k)
    assert len(got) == len({(r.item_id, r["rank"]) for r in got})
    assert {tuple(r) for r in got} == want


def test_ranking_of_ids_as_text_and_empty_tables(spark, docs):
    named = spark.createDataFrame([("b", "x y"), ("a", "x y"), (None, "x y"), ("c", "y z z")], "doc_id string, text string")
    items = spark.createDataFrame([("q", "x z")], "item_id string, text string")
    got = ranked.search(named, items).orderBy("rank").collect()
    assert [r.doc_id for r in got] == ["c", "a", "b", None]
    assert ranked.search(named.limit(0), items).count() == 0
    assert ranked.search(named, items.limit(0)).count() == 0


def test_long_documents_do_not_overflow():
    import numpy as np

    assert ranked.lengths_factor(np.array([10**10, 4]), 10**11, 10**15).tolist() == [75 + 25 * 10**21 // 10**15, 75]


# -- 13 ------------------------------------------------------------------------------------------


def conversations(rng: random.Random, n: int, depth: int) -> list[tuple]:
    rows: list[tuple] = []
    for c in range(n):
        for t in range(rng.randrange(1, depth)):
            rows.append((c, t, rng.choice(["user", "assistant", None]), rng.choice(["a", "b", "é", "", None])))
    return rows


@pytest.mark.parametrize(("seed", "first", "block"), [(1, 8, 64), (2, 1, 2), (3, 2, 3)])
def test_trie_against_brute_force(spark, seed, first, block):
    rng = random.Random(seed)
    rows = conversations(rng, 60, 6)
    rows += [(1000 + i, t, "user", f"t{t}") for i in range(40) for t in range(5)]  # exact copies
    rows += [(2000 + i, t, "user", f"t{t}" if t < 30 else f"x{i}") for i in range(12) for t in range(32)]  # near copies that part late
    rows += [(3000, t, "user", f"long {t}") for t in range(150)] + [(3005, t, "user", f"long {t}") for t in range(150)] + [(3006, 0, "user", "z")]
    rows += [(-3, 1, "u", "neg"), (-7, None, None, None), (-7, 0, "u", "x"), (None, 1, "u", "nobody"), (9, 1, "u", "same"), (9, 1, "u", "same"), (9, 1, "u", "other")]
    rng.shuffle(rows)
    df = spark.createDataFrame([(*r, 1, "n") for r in rows], "conv_id bigint, turn bigint, role string, text string, depth int, label string").repartition(5)
    out = trie.conversation_trie(df, first=first, block=block)
    assert sorted(map(tuple, out.collect()), key=str) == sorted(brute.trie(rows), key=str)


def test_trie_of_one_and_of_none(spark):
    schema = "conv_id bigint, turn bigint, role string, text string"
    one = [(5, 0, "u", "hello"), (5, 1, "a", "hi")]
    assert sorted(map(tuple, trie.conversation_trie(spark.createDataFrame(one, schema)).collect()), key=str) == sorted(brute.trie(one), key=str)
    alone = [(2, 0, "u", "x")]  # all its turns come from a conversation that is absent
    assert sorted(map(tuple, trie.conversation_trie(spark.createDataFrame(alone, schema)).collect()), key=str) == sorted(brute.trie(alone), key=str)
    assert trie.conversation_trie(spark.createDataFrame([], schema)).count() == 0
    assert trie.conversation_trie(spark.createDataFrame([(None, 0, "u", "x")], schema)).count() == 0


def test_members_of_a_large_node_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(trie, "PIECE", 7)
    rows = [(e, c) for e in (1, 2) for c in range(e, 500 * e)] + [(900, 900)]
    got = {r.element: r.ends_sha256 for r in trie.members_digest(spark.createDataFrame(rows, "element bigint, conv bigint").repartition(7)).collect()}
    assert got == {e: brute.sha(",".join(str(c) for x, c in sorted(rows) if x == e)) for e in (1, 2, 900)}


# -- words, and texts of few words ---------------------------------------------------------------


@pytest.mark.parametrize("n", range(7))
def test_classes_of_slices_of_few_words(spark, n):
    rows = [(1, " ".join("abcdef"[:n]))]
    got = jaccard.similarity_classes(spark.createDataFrame(rows, "doc_id bigint, text string").coalesce(1)).select("doc_id", "n_shingles", "component_id").collect()
    assert [tuple(r) for r in got] == brute.components(rows)


def test_a_last_batch_of_two_words(spark):
    rng = random.Random(9)
    rows = [(i, text(rng, 12, 4000)) for i in range(1000)] + [(1000, "one two")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").coalesce(1)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 1000)
    got = jaccard.similarity_classes(df).select("doc_id", "n_shingles", "component_id").collect()
    assert sorted(map(tuple, got)) == sorted(brute.components(rows))
    assert jaccard.representatives(df).count() == len({c for _, _, c in brute.components(rows)})


def test_words_made_to_clash_stay_apart(spark):
    word = "a"
    for _ in range(10):
        word += word.translate(str.maketrans("ab", "ba"))
    other = word.translate(str.maketrans("ab", "ba"))
    rows = [(1, word), (2, other), (3, "abc\0"), (4, "abc")]
    got = jaccard.similarity_classes(spark.createDataFrame(rows, "doc_id bigint, text string")).select("doc_id", "component_id").collect()
    assert sorted(map(tuple, got)) == [(i, i) for i in (1, 2, 3, 4)]
    hashes, counts = common.word_hashes([b"", b" A b\ta ", b"abcdefgh ABCDEFGH abcdefgi"])
    assert counts.tolist() == [0, 3, 3]
    assert hashes[0] == hashes[2] and hashes[3] == hashes[4] and len(set(hashes.tolist())) == 4


def test_new_queries_return_their_contracts(spark):
    want = {"op11_shards": "doc_id size text_crc32 law shard slot grown_shard", "op12_ranked": "item_id rank doc_id score", "op13_trie": "conv_id depth parent_conv_id n_convs n_children n_leaves saved_tokens ends_sha256"}
    for name, columns in want.items():
        assert queries.QUERIES[name](spark, "/root/testdata/sf0.001").columns == columns.split()


# -- keys of rows, and ids of other types --------------------------------------------------------


def test_rows_whose_hashes_clash_are_told_apart(spark):
    rows = [(i, f"t{i % 40}") for i in range(60)] + [(3, "t3"), (None, None), (None, None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    for width in (2, 64):
        keys: dict = {}
        for r in repeats.row_keys(df, "key", width).collect():
            keys.setdefault(r["key"], set()).add((r.doc_id, r.text))
        assert all(len(v) == 1 for v in keys.values()) and len(keys) == len(set(rows))


def test_repeats_of_rows_with_maps_and_clashing_names(spark):
    rng = random.Random(2)
    body = "".join(rng.choice("abcdefgh ") for _ in range(900))
    df = spark.createDataFrame([(1, body, {"a": 1}, 5), (2, f"x{body}", None, 6), (3, "short", {}, 7)], "doc_id bigint, text string, m map<string,int>, removed int")
    out = {r.doc_id: (r.n_removed, r.m) for r in repeats.without_repeats(df).collect()}
    assert out == {1: (900, {"a": 1}), 2: (900, None), 3: (0, {})}


def test_benchmark_ids_of_any_type(spark):
    item = "one two three four five six seven eight nine ten eleven"
    docs = spark.createDataFrame([(1, f"a {item} b"), (2, "nothing")], "doc_id bigint, text string")
    for kind, ids in (("string", ["q/b", "q/a", None]), ("int", [7, 4, None])):
        bench = spark.createDataFrame([(i, item) for i in ids], f"item_id {kind}, text string")
        for words in (2_000_000, 5):
            got = {r.doc_id: r["items"] for r in decontaminate.contamination(docs, bench, block_words=words).collect()}
            assert got == {1: sorted(i for i in ids if i is not None), 2: []}


# -- licences and languages: what decides -------------------------------------------------------


def test_licences_that_are_denied_restricted_or_several(spark):
    folder = Path(licenses.__file__).parent / "licence_texts"
    gpl, mit = (folder.joinpath(f"{n}.txt").read_text(encoding="utf-8") for n in ("GPL-3.0", "MIT"))
    rows = [
        ("a/LICENSE", gpl.replace("GNU General", "GNU Affero General")), ("a/x.py", "code"), ("b/LICENSE", "This is not licensed under the MIT License."), ("b/x.py", "code"),
        ("c/LICENSE", f"{mit} Non-commercial use only."), ("c/x.py", "code"), ("d/LICENSE", "Licensed under the Apache License Version 2.0. Released under the MIT License."), ("d/x.py", None), ("e/LICENSE", gpl), ("e/x.py", ""),
    ]
    got = {r.path: (r.license, r.origin, r.licenses) for r in licenses.licences(spark.createDataFrame(rows, "path string, text string")).collect()}
    assert got["a/LICENSE"] == ("AGPL-3.0", "own", ["AGPL-3.0"]) and got["a/x.py"][:2] == ("AGPL-3.0", "inherited")
    assert got["b/LICENSE"] == (None, "none", []) and got["b/x.py"][:2] == (None, "none")
    assert got["c/LICENSE"] == ("MIT AND LicenseRef-restricted", "own", ["MIT AND LicenseRef-restricted"]) and got["c/x.py"][:2] == (None, "none")
    assert got["d/LICENSE"] == ("Apache-2.0", "own", ["Apache-2.0", "MIT"]) and got["d/x.py"][:2] == ("Apache-2.0", "inherited")
    assert got["e/x.py"][:2] == ("GPL-3.0", "inherited")


def test_host_suffix_and_markup_decide_where_the_text_does_not(spark):
    """One text in several places: what is declared, or else the host's prior, or else that of its suffix, tells the language."""
    rng = random.Random(6)
    parts = {"en": ["the", "of", "and", "ing"], "de": ["der", "sch", "und", "ung"]}
    both = "radio taxi hotel"

    def body(k: str) -> str:
        return f"{both} " + " ".join("".join(rng.choice(parts[k]) for _ in range(2)) for _ in range(30))

    rows = [(i, body(k), k, f"h{i % 4}.{k}host.{k}") for i in range(400) for k in [("en", "de")[i % 2]]]
    asked = [(1000, both, None, "h0.enhost.en"), (1001, both, None, "h1.dehost.de"), (1002, both, "de", "new.org"), (1003, both, "en", "new.org"), (1004, both, None, "new.en"), (1005, both, None, "new.de")]
    df = spark.createDataFrame(rows + asked, "doc_id bigint, text string, lang string, source string")
    got = {r.doc_id: r.language for r in language.identify(df).where("doc_id >= 1000").collect()}
    assert got == {1000: "en", 1001: "de", 1002: "de", 1003: "en", 1004: "en", 1005: "de"}

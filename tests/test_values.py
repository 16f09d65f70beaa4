"""Rows without usable ids, phrases, learned values, structure, views, variants and paths."""

from __future__ import annotations

import random
import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from veilspark import api
from veilspark.functions import text as T
from veilspark.functions.align import aligned, folded, words_of
from veilspark.operators import consistency, detect, learned, mapping, paths, phrases, redacted, remediate, rows, structure, variants
from veilspark.operators import rules as R
from veilspark.operators import spans as S
from veilspark.plans import catalogue
from veilspark.plans.values import learned_values, spaced_values

BASIC = catalogue._rules(catalogue.EMAIL, catalogue.IP)


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return df.select(column).first()[0]


# -- rows ----------------------------------------------------------------------------------------

ROWS = [(None, "mail c@d.org"), (1, "mail a@b.org"), (1, "mail e@f.org and 10.0.0.1"), (1, "mail a@b.org"), (None, None), (None, "nothing"), (2, "")]


def test_masking_of_null_and_repeated_ids(spark):
    docs = spark.createDataFrame([(*r, "x") for r in ROWS], "doc_id bigint, text string, masked_text string").drop("masked_text").repartition(3)
    out = api.mask(docs, BASIC)
    texts = [(r.doc_id, r.masked_text, r.n_findings) for r in out.documents.collect()]
    table = {r.value: r.placeholder for r in out.mapping.collect()}
    assert set(table) == {"c@d.org", "a@b.org", "e@f.org", "10.0.0.1"} and len(set(table.values())) == 4
    want = []
    for d, t in ROWS:
        body, n = t or "", 0
        for v, p in table.items():
            n += v in body
            body = body.replace(v, p)
        want.append((d, body, n))
    assert sorted(texts, key=str) == sorted(want, key=str)
    assert sorted(r.restored for r in api.unmask(out.documents, out.mapping).collect()) == sorted(t or "" for _, t in ROWS)
    states = sorted((str(r.doc_id), r.status, r.match_count) for r in out.outcomes.collect())
    assert states == sorted((str(d), "masked" if n else "copied_text_no_match", n) for d, _, n in want)


def test_a_row_with_a_null_id_is_judged(spark):
    docs = spark.createDataFrame([(None, "Acme Corp leaks"), (None, "fine"), (3, "acme-corp too"), (3, "fine")], "doc_id bigint, text string")
    claims = spark.createDataFrame([(None, "fine")], "doc_id bigint, quote string")
    people = spark.createDataFrame([(None, "leaks", "person", "yuksek")], "doc_id bigint, value string, entity string, confidence string")
    out = api.mask(docs, BASIC, terms=spark.createDataFrame([("AcmeCorp",)], "term string"), claims=claims, external=people)
    got = sorted((str(r.doc_id), str(r.failed_check)) for r in out.outcomes.collect())
    assert got == [("3", "None"), ("3", "acik_terim"), ("None", "acik_terim"), ("None", "llm_denetimi")]
    assert any(r.masked_text.endswith("mask_personel_1") for r in out.documents.collect())


def test_findings_without_a_row_key_stay_with_their_text(spark):
    docs = spark.createDataFrame([(1, "a@b.org x"), (1, "plain text"), (None, "c@d.org")], "doc_id bigint, text string")
    found = spark.createDataFrame([(1, 0, 7, "a@b.org"), (None, 0, 7, "c@d.org")], "doc_id bigint, start int, end int, value string")
    table = spark.createDataFrame([("a@b.org", "mask_email_1"), ("c@d.org", "mask_email_2")], "value string, placeholder string")
    assert sorted(r.masked_text for r in mapping.masked(docs, found, table).collect()) == ["mask_email_1 x", "mask_email_2", "plain text"]


# -- alignment and phrases -----------------------------------------------------------------------


@pytest.mark.parametrize("text", ["", "plain ASCII", "Straße ﬁne Ⅳ", "Şirket ş", "각 각 ẹ́x", "İstanbul ıI", "á", "́lead", "日本 ½ ①"])
def test_alignment_agrees_with_the_whole_text(text):
    view, starts, ends = aligned(text)
    assert view == unicodedata.normalize("NFKC", text).casefold() == folded(text)
    assert len(view) == len(starts) == len(ends)
    assert all(0 <= a < b <= len(text) for a, b in zip(starts, ends, strict=True)) and list(starts) == sorted(starts)


def test_phrases_of_many_words(spark):
    docs = spark.createDataFrame([(1, "Ada  Lovelace met ADA LOVELACE, and ada\nlovelace."), (2, "xAda Lovelace Ada Lovelacey Ada_Lovelace"), (3, "call +1 (555) 123-4567 now or +1 (555) 123-45678"), (4, None), (None, "Straße 5, strasse 5"), (5, "mask_ada_1 Ada Lovelace King")], "doc_id bigint, text string")
    values = spark.createDataFrame([("ada lovelace",), ("+1 (555) 123-4567",), ("STRASSE 5",), ("Ada Lovelace King",), ("--",), (None,)], "value string")
    got = sorted((str(r.doc_id), r.start, r.value) for r in phrases.places(docs, values).collect())
    assert got == [("1", 18, "ADA LOVELACE"), ("3", 5, "+1 (555) 123-4567"), ("5", 11, "Ada Lovelace King"), ("None", 0, "Straße 5"), ("None", 10, "strasse 5")]
    loose = [(r.doc_id, r.value) for r in phrases.places(docs, values.limit(1), exact=False).where("doc_id = 1").orderBy("start").collect()]
    assert loose == [(1, "Ada  Lovelace"), (1, "ADA LOVELACE"), (1, "ada\nlovelace")]
    assert phrases.places(docs.limit(0), values).count() == 0 and phrases.places(docs, values.limit(0)).count() == 0


def test_phrases_against_a_plain_search(spark):
    rng = random.Random(3)
    texts = [(i, " ".join(rng.choice("abcde") for _ in range(rng.randrange(60)))) for i in range(40)] + [(1, "a b c"), (1, "a b c")]
    wanted = {" ".join(rng.choice("abcde") for _ in range(rng.randrange(1, 7))) for _ in range(25)}
    docs = spark.createDataFrame(texts, "doc_id bigint, text string").repartition(4)
    got = phrases.places(docs, spark.createDataFrame([(w,) for w in wanted], "value string"), every=True).groupBy("doc_id", "phrase").count().collect()
    want: dict = {}
    for i, t in texts:
        words = t.split()
        for p in wanted:
            n = sum(words[k : k + len(p.split())] == p.split() for k in range(len(words)))
            if n:
                want[i, p] = want.get((i, p), 0) + n
    assert {(r.doc_id, r.phrase): r["count"] for r in got} == want


def test_values_with_spaces_are_consistent(spark):
    docs = spark.createDataFrame([(1, "see +1 (555) 123-4567"), (2, "again +1 (555) 123-4567 and +1 (555) 123-4567.")], "doc_id bigint, text string")
    phone = spark.createDataFrame([(1, "+1 (555) 123-4567", "dictionary", "phone", "yuksek", 1, "r", 4)], "doc_id bigint, value string, source string, entity string, confidence string, priority int, rule string, start int")
    open_ = consistency.open_occurrences(docs, consistency.registry(phone)).collect()
    assert sorted((r.doc_id, r.n_occurrences) for r in open_) == [(1, 1), (2, 2)]
    values = spark.createDataFrame([("+1 (555) 123-4567", "mask_phone_1")], "value string, placeholder string")
    done = remediate.mask_known(docs.withColumnRenamed("text", "masked_text"), values).collect()
    assert {r.doc_id: r.n_more for r in done} == {1: 1, 2: 2} and all("555" not in r.masked_text for r in done)


def test_numbers_that_look_random_are_counted_wherever_they_stand(spark, tmp_path):
    texts = ["call +1 (366) 555-9807 now, +1 (366) 555-9807.", "again +1 (366) 555-9807", "+1 (366) 555-9807™ and №+1 (366) 555-9807", "+1 (366) 555-98071 x+1 (366) 555-9807"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted((r.doc_id, r.value, r.n) for r in spaced_values(spark, str(tmp_path)).collect())
    assert got == [(0, "+1 (366) 555-9807", 2), (1, "+1 (366) 555-9807", 1), (2, "+1 (366) 555-9807", 2)]


def test_signs_that_become_letters_do_not_hide_a_value(spark):
    docs = spark.createDataFrame([(1, "Acme™ №7 (123) 456-7890㎏ Acme Corp™ №7"), (2, "acmetm no7 Acme™corp"), (3, "Ac™me e\u03017 ™™Acme℡℡"), (4, "™" * 3000)], "doc_id bigint, text string")
    values = spark.createDataFrame([("acme",), ("ACME™",), ("Acme Corp",), ("7 (123) 456-7890",), ("№7",), ("7",)], "value string")
    got = sorted((r.doc_id, r.start, r.end, r.phrase) for r in phrases.places(docs, values, every=True).collect())
    assert got == [
        (1, 0, 4, "acme"), (1, 0, 5, "acmetm"), (1, 6, 8, "no7"), (1, 7, 8, "7"), (1, 7, 23, "7 (123) 456-7890"), (1, 25, 29, "acme"), (1, 25, 34, "acme corp"), (1, 36, 38, "no7"), (1, 37, 38, "7"),
        (2, 0, 6, "acmetm"), (2, 7, 10, "no7"), (2, 11, 15, "acme"), (3, 12, 16, "acme"),
    ]
    leaked = consistency.leaks(docs, spark.createDataFrame([("Acme™",), ("CORP",)], "term string"), 4).collect()
    assert sorted((r.doc_id, r.term, r.n) for r in leaked) == [(1, "Acme™", 2), (1, "CORP", 1), (2, "Acme™", 2), (2, "CORP", 1), (3, "Acme™", 1)]


# -- learned values ------------------------------------------------------------------------------


def test_learned_values_in_source_positions(spark):
    docs = spark.createDataFrame([(1, "Große ﬁnanz: GROSSE aaaa mask_grosse_1"), (None, "grosse"), (2, None)], "doc_id bigint, text string")
    decisions = spark.createDataFrame([(7, "grosse", "PERSON"), (5, "GROẞE", "PERSON"), (8, "fin", "IP"), (9, "aa", "IP"), (10, "", "IP"), (11, "s", "IP")], "decision_id bigint, value string, entity string")
    for block in (1 << 20, 4):
        got = sorted((str(r.doc_id), r.start, r.end, r.value, r.decision_id) for r in learned.learned_findings(docs, decisions, block=block).collect())
        # "s" stands in "GROSSE" and "grosse", and nowhere within the one sign that makes two of them
        assert got == sorted([("1", 0, 5, "Große", 5), ("1", 6, 9, "ﬁn", 8), ("1", 13, 19, "GROSSE", 5), ("1", 16, 17, "S", 11), ("1", 17, 18, "S", 11), ("1", 20, 22, "aa", 9), ("1", 21, 23, "aa", 9), ("1", 22, 24, "aa", 9), ("None", 0, 6, "grosse", 5), ("None", 3, 4, "s", 11), ("None", 4, 5, "s", 11)]) or got[1][1:3] == (6, 8)
    assert learned.learned_findings(docs, decisions.limit(0)).count() == 0


def test_learned_values_from_half_a_sign(spark, tmp_path):
    texts = ["enßchach Schach", "ßchach", "gezu SCHACHß", "Abyß weissaß", None]
    wanted = ["a b schach", "a b WEISS", "a b byssa", "a b sassa"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(list(enumerate(wanted)), "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = sorted((r.doc_id, r.value, r.n) for r in learned_values(spark, str(tmp_path)).collect())
    # as its SQL counts in the text with ss for ß
    want = sorted((i, v, n) for i, t in enumerate(texts) for v in ("schach", "weiss", "byssa", "sassa") if (n := len(re.findall(f"(?={v})", (t or "").lower().replace("ß", "ss")))))
    assert got == want == [(0, "schach", 2), (1, "schach", 1), (2, "schach", 1), (3, "weiss", 1)]
    docs, decisions = spark.createDataFrame([(1, "x ßa")], "doc_id int, text string"), spark.createDataFrame([(1, "s", "IP"), (2, "sa", "IP")], "decision_id int, value string, entity string")
    assert sorted((r.start, r.end, r.value, r.needle) for r in learned.learned_findings(docs, decisions, parts=True).collect()) == [(2, 3, "ß", "s"), (2, 3, "ß", "s"), (2, 4, "ßa", "sa")]
    assert learned.learned_findings(docs, decisions).count() == 0


def test_occurrences_overlap(spark):
    for text, needle in (("aaaa", "aa"), ("abcab", "ab"), ("xaby", "ab"), ("", "a"), ("a", ""), ("a.b.a.b", "a.b"), ("q\\Ex\\E", "\\E")):
        want = [i for i in range(len(text)) if needle and text.startswith(needle, i)]
        assert one(spark, learned.occurrences(F.col("t"), F.col("n")), t=text, n=needle) == want


def test_claims_are_covered_by_place(spark):
    docs = spark.createDataFrame([(1, "java", "Maria Lopez came. maria lopez left"), (2, "java", "Maria Lopez and Maria"), (3, "sql", "Maria Lopez")], "doc_id bigint, scope string, text string")
    claims = spark.createDataFrame([(1, "Maria"), (2, "Maria"), (3, "Maria"), (1, "gone"), (2, "MARIA LOPEZ"), (1, None), (None, "Maria")], "doc_id bigint, value string")
    decisions = spark.createDataFrame([("java", "Maria Lopez"), ("java", ""), ("java", None)], "scope string, value string")
    got = {(r.doc_id, r.value): r.covered for r in learned.covered_claims(claims, docs, decisions).collect()}
    assert got == {(1, "Maria"): True, (2, "Maria"): False, (3, "Maria"): False, (1, "gone"): False, (2, "MARIA LOPEZ"): True, (1, None): False, (None, "Maria"): False}


# -- structure -----------------------------------------------------------------------------------


@pytest.mark.parametrize(
    ("value", "term", "parts"),
    [
        ("Maria,Lopez", "Maria Lopez", ["Maria", "Lopez"]), ('Nova" + "Vault', "NovaVault", ["Nova", "Vault"]), ("grand plan(ning", "grand planning", ["grand plan(ning"]), ("N o v a V a u l t", "NovaVault", ["N o v a V a u l t"]),
        ("Abc,Lopez", "Abc Lopez", ["Abc,Lopez"]), ("grand\nplanning", "grand planning", ["grand", "planning"]), ("Şirket , Kodlar", "ŞirketKodlar", ["Şirket", "Kodlar"]), ("one", "one", ["one"]), ("Nova,Vault", "Nova Other", ["Nova,Vault"]), ("alpha/beta gamma/delta", "alpha beta gamma delta", ["alpha", "beta gamma", "delta"]),
    ],
)
def test_parts_of_leaks(spark, value, term, parts):
    assert one(spark, structure.structural_parts(F.col("v"), F.col("t")), v=value, t=term) == parts
    spans = one(spark, structure.part_spans(F.col("v"), F.col("t"), F.lit(3)), v=value, t=term)
    assert [("   " + value)[s.start : s.end] for s in spans] == parts


@pytest.mark.parametrize(("text", "start", "end", "glued"), [("planByStage", 3, 7, True), ("novaVault", 4, 9, False), ("NOVAVAULT", 4, 9, False), ("NOVAVault", 4, 9, False), ("novavault", 4, 9, False), ("x vault", 2, 7, False), ("vault", 0, 5, False), ("noVaVault", 3, 9, True)])
def test_glued_slices(spark, text, start, end, glued):
    assert one(spark, structure.mixed_case_glued(F.col("t"), F.lit(start), F.lit(end)), t=text) is glued


# -- views, variants, paths ----------------------------------------------------------------------


def test_views_compose_and_invert(spark):
    rng = random.Random(2)
    for _ in range(300):
        text = "".join(rng.choice("abcdef ") for _ in range(rng.randrange(30)))
        spans = [(a, a + rng.randrange(1, 5), rng.choice(["ip", "E-Mail", "9", None])) for a in range(len(text)) if rng.random() < 0.15]
        view, first = redacted.redact(text, spans)
        again = [(a, a + rng.randrange(1, 9), "x") for a in range(len(view)) if rng.random() < 0.1]
        whole, second = redacted.redact(view, again)
        both = redacted.compose(first, second)
        # What stands between regions is the same in both texts, and regions lie side by side.
        at = low = 0
        for r in [*both, {"view_start": len(whole), "view_end": len(whole), "start": len(text), "end": len(text)}]:
            assert whole[at : r["view_start"]] == text[low : r["start"]]
            at, low = r["view_end"], r["end"]
    docs = spark.createDataFrame([(1, "mail a@b.org or a@b.org to 10.0.0.1!", [(5, 12, "email"), (16, 23, "email"), (27, 35, "ip")]), (2, None, None)], "doc_id int, text string, spans array<struct<start:int,end:int,category:string>>")
    seen = redacted.redacted(docs)
    got = {r.doc_id: r for r in seen.select("doc_id", "view", redacted.hidden_chars(F.col("regions")).alias("h"), redacted.to_source(F.col("regions"), F.lit(17), F.lit(21)).alias("s"), redacted.to_source(F.col("regions"), F.lit(4), F.lit(7)).alias("t"), redacted.to_view(F.col("regions"), F.lit(7), F.lit(36)).alias("v")).collect()}
    assert got[1].view == "mail mask_email_1 or mask_email_1 to mask_ip_1!" and got[1].h == 22
    assert (got[1].s.start, got[1].s.end) == (12, 16) and got[1].t is None and (got[1].v.start, got[1].v.end) == (17, 47)
    assert got[2].view == "" and got[2].h == 0
    back = redacted.composed(seen.withColumn("second", F.col("regions")), "regions", "regions").count()
    assert back == 2


def test_variants_carry_spans_to_all_members(spark):
    text = "user 12 at host-7.x\nshort\nuser 345 at host-10.x\r\nuser 6 at host-8.x\nother 1 line here\nshort"
    docs = spark.createDataFrame([(1, text), (1, text), (None, None)], "doc_id bigint, text string")
    classes = variants.line_classes(docs)
    kept = {r.doc_id: r for r in variants.kept_texts(classes).collect()}
    assert kept[1].text == "user 12 at host-7.x\nshort\nother 1 line here\nshort\n" and kept[None].text == "\n"
    body = kept[1].text
    spans = [("user 12", 0, 7), ("host", 11, 17), ("cut", 6, 12), ("over", 15, 22), ("line", body.index("line"), body.index("line") + 4)]
    found = spark.createDataFrame([(kept[1].row_key, a, b, n) for n, a, b in spans], "row_key string, start int, end int, name string")
    got: dict = {}
    for r in variants.member_spans(classes, found).collect():
        got.setdefault(r.name, []).append(text[r.start : r.end])
    assert {k: sorted(v) for k, v in got.items()} == {"user 12": ["user 12", "user 345", "user 6"], "host": ["host-10", "host-7", "host-8"], "cut": ["12 at h", "345 at h", "6 at h"], "line": ["line"]}


def test_paths_that_show_masked_values(spark):
    files = spark.createDataFrame([(1, "src/TcKimlikNo/tcpPort.java"), (2, "etc/tcpPort"), (3, "mask_tc_1/Ana/Müşteri"), (None, "a/acme-corp"), (4, "acme/corp")], "doc_id bigint, masked_path string")
    masked = spark.createDataFrame([(1, "tckimlik"), (1, "TC KIMLIK"), (1, "kimlik no"), (2, "tcp"), (2, "tc"), (2, "rt"), (3, "mask"), (3, "ana müşteri"), (None, "ACME Corp"), (4, "cor"), (4, None)], "doc_id bigint, value string")
    assert {r.doc_id: r.n_open for r in paths.content_mismatches(files, masked).collect()} == {1: 2, 2: 1, 3: 1, None: 1}
    assert paths.content_mismatches(files.limit(0), masked).count() == 0


def test_words_and_keys():
    assert words_of("Ada_Lovelace's ﬁrst") == ["ada", "lovelace", "s", "first"]
    assert rows.ROW == "row_key" and R.PLACEHOLDER


# -- groups in patterns, and many findings -------------------------------------------------------


def found(spark, pattern: str, *texts: str) -> list:
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    rules = R.register_rule((), R.Rule("x", "regex", "c", pattern, "mask_x", 1))
    return [[x.value for x in r.findings] for r in detect.detect(docs, R.bound(rules)).orderBy("doc_id").collect()]


def test_named_groups_and_references(spark):
    text = "key=\"abc\" key='de\"f' x"
    assert found(spark, r"""key=(["'])(?P<deger>[^"']+)\1""", text) == [["abc"]]
    assert found(spark, r"""key=(?P<q>["'])(?P<deger>.+?)(?P=q)""", text) == [["abc", 'de"f']]
    assert found(spark, r"(?P<deger>[a-z])\(\1[)(|]", "x(1) b(b)") == [["b"]]
    assert found(spark, r"a(?:b|(?P<deger>c))", "ab ac") == [["ab", "c"]]
    assert found(spark, r"u|(?P<deger>v)w", "u vw") == [["u", "v"]]
    assert found(spark, r"((?P<deger>[0-9]+)%)", "7% 8") == [["7"]]
    assert found(spark, r"(?P<q>[ab])(?P=q)", "aa ab bb") == [["aa", "bb"]]


@pytest.mark.parametrize("pattern", [r"(?P<a>x)(?(a)y|z)", r"(?P<deger"])
def test_patterns_that_a_job_would_stop_at_are_refused(spark, pattern):
    with pytest.raises((ValueError, re.error)):
        R.register_rule((), R.Rule("x", "regex", "c", pattern, "mask_x", 1))


def test_overlaps_against_a_plain_choice(spark):
    rng = random.Random(1)
    rows_ = []
    for k in range(120):
        spans = [(a := rng.randrange(60), a + rng.randrange(1, 9), rng.randrange(3), rng.randrange(3), i) for i in range(rng.randrange(0, 25))]
        rows_.append((k, [(a, b, c, p, i, "orta", "llm") for a, b, c, p, i in spans]))
    df = spark.createDataFrame(rows_, "k int, s array<struct<start:int,end:int,authority:int,priority:int,ord:int,confidence:string,source:string>>")
    got = {r.k: r for r in df.select("k", S.resolve(F.col("s")).alias("r"), S.union(F.col("s")).alias("u")).collect()}
    for k, spans in rows_:
        taken: list = []
        for s in sorted(spans, key=lambda s: (-s[2], s[0] - s[1], s[3], s[4])):
            if not any(s[0] < t[1] and t[0] < s[1] for t in taken):
                taken.append(s)
        assert sorted(x.span.ord for x in got[k].r if x.accepted) == sorted(s[4] for s in taken)
        by = {s[4]: s for s in spans}
        assert all(by[x.winner][0] < x.span.end and x.span.start < by[x.winner][1] and by[x.winner] in taken for x in got[k].r if not x.accepted) and len(got[k].r) == len(spans)
        union: list = []
        for a, b, *_ in sorted(spans):
            if union and a <= union[-1][1]:
                union[-1][1] = max(union[-1][1], b)
            else:
                union.append([a, b])
        assert [[s.start, s.end] for s in got[k].u] == union


def test_many_findings_in_one_text(spark):
    text = " ".join(f"u{i}@x.org" for i in range(6000))
    df = spark.createDataFrame([(1, text)], "doc_id int, text string")
    out = detect.detect(df, BASIC).select(S.accepted(S.resolve(F.col("findings"))).alias("a")).first().a
    assert [s.value for s in out] == text.split()


def test_only_natural_language_is_judged_by_entropy(spark):
    phone = "+1 (366) 555-9807"  # 3.5 bits and more
    docs = spark.createDataFrame([(1, f"call {phone} now")], "doc_id bigint, text string")
    rules = [r for r in R.bound((*R.RULES, *R.RECOGNISERS)) if r.name == "builtin_phone"]
    assert [r.value for r in detect.long(detect.detect(docs, rules)).collect()] == [phone]
    assert docs.select(F.size(detect.findings_array(F.col("text"), rules))).first()[0] == 1
    assert detect.long(detect.detect(docs, rules, natural=("PHONE_NUMBER",))).count() == 0


def test_numbered_masks_are_those_of_the_four_rules(spark, tmp_path):
    text = 'token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff" a@b.example'
    spark.createDataFrame([(1, text)], "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    out = catalogue.QUERIES["mask_numbered"](spark, str(tmp_path)).first()
    assert (out.masked_text, out.n_findings) == ('token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff" mask_email_1', 1)


def test_path_mismatches_are_not_broadcast(spark):
    files = spark.createDataFrame([(1, "large ring/blueBolt_x/a.txt"), (2, ""), (3, None)], "doc_id int, masked_path string")
    masked = spark.createDataFrame([(1, "Blue bolt"), (1, "ring blue"), (1, "ri"), (2, "abc")], "doc_id int, value string")
    out = paths.content_mismatches(files, masked)
    assert [tuple(r) for r in out.collect()] == [(1, 2)]
    assert "Broadcast" not in out._jdf.queryExecution().executedPlan().toString()


def test_folding_makes_sharp_s_two_letters(spark):
    assert one(spark, T.fold_turkish(F.lit("UngheitßŞ"))) == "ungheitsss"
    docs = spark.createDataFrame([(1, "das ungheitß da"), (2, "UNGHEITSS")], "doc_id bigint, text string")
    found = consistency.leaks(docs, spark.createDataFrame([("ungheitß",)], "term string"), 9)
    assert sorted((r.doc_id, r.n) for r in found.collect()) == [(1, 1), (2, 1)]


def test_spans_move_by_runs(spark):
    assert variants.moved_spans("a12b3", "a7b456", [(1, 3), (2, 3), (0, 1), (3, 5), (0, 9)]) == [(1, 2), (1, 2), (0, 1), (2, 6), None]
    long = "".join(f"{i % 10}x" for i in range(20_000))  # runs by the thousand: each looked up by halving
    docs = spark.createDataFrame([(1, long + "\n" + long)], "doc_id bigint, text string")
    classes = variants.line_classes(docs)
    found = variants.kept_texts(classes).select(rows.ROW, F.explode(detect.matches(F.col("text"), "[0-9]+")).alias("m")).select(rows.ROW, "m.start", "m.end")
    out = variants.member_spans(classes, found)
    assert out.count() == 40_000 and out.agg(F.max("end")).first()[0] == 80_000


def test_claims_meet_covers_without_their_texts(spark):
    docs = spark.createDataFrame([(1, "s", "the cat and the cat"), (2, "s", "a cat sat")], "doc_id bigint, scope string, text string")
    claims = spark.createDataFrame([(1, "cat"), (2, "cat"), (2, "a cat")], "doc_id bigint, value string")
    known = spark.createDataFrame([("s", "the cat"), ("s", "cats"), ("s", "A CAT"), ("t", "cat")], "scope string, value string")
    out = learned.covered_claims(claims, docs, known)
    assert sorted((r.doc_id, r.value, r.covered) for r in out.collect()) == [(1, "cat", True), (2, "a cat", True), (2, "cat", True)]
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert not [line for line in plan.splitlines() if "Aggregate [" in line and "__text" in line]


def test_claims_and_covers_in_pieces(spark):
    rng = random.Random(5)

    def text(n):
        return "".join(rng.choice("ab ß") for _ in range(n))

    texts = [(rng.randrange(60), rng.choice(("x", "y", "y", "y", None)), text(rng.randrange(40))) for _ in range(90)] + [(None, "y", "ab"), (7, "y", None)]
    known = [(rng.choice("xyz"), text(rng.randrange(7))) for _ in range(60)]
    asked = [(rng.randrange(62), text(rng.randrange(4))) for _ in range(200)] + [(None, "a"), (3, None)]

    def fold(t):
        return (t or "").lower().replace("ß", "ss")

    def holds(scope, body, needle):
        covers = [fold(c) for s, c in known if s == scope]
        at = [i for i in range(len(body)) if body.startswith(needle, i)]
        spans = [(i, i + len(c)) for c in covers if c for i in range(len(body)) if body.startswith(c, i)]
        return needle in covers or bool(at) and all(any(a <= i and i + len(needle) <= b for a, b in spans) for i in at)

    want = sorted((str(i), str(v), i is not None and bool(v) and any(d == i and holds(s, fold(t), fold(v)) for d, s, t in texts)) for i, v in asked)
    assert 20 < sum(w[2] for w in want) < 180
    docs = spark.createDataFrame(texts, "doc_id bigint, scope string, text string").repartition(3)
    claims, decisions = spark.createDataFrame(asked, "doc_id bigint, value string"), spark.createDataFrame(known, "scope string, value string")
    for pieces in ({}, {"part": 100}, {"block": 20}, {"part": 300, "block": 60}):
        out = learned.covered_claims(claims, docs, decisions, **pieces)
        assert sorted((str(r.doc_id), str(r.value), r.covered) for r in out.collect()) == want
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Contains" not in plan  # no needle is held against a scope's covers one by one

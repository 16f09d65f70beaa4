"""The queries that apply each operator to its whole table, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilspark.llm import decontaminate, jaccard, language, licenses, neighbours, pages, pieces, ranked, repeats, score, secrets, sharding, trie
from veilspark.llm.common import lean


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    lean(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log-probability of every document under the backoff automaton, beside a unigram base."""
    return score.lm_scores(_table(spark, sf_dir, "documents"))


def op2_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest vectors of every hundredth one, among all."""
    return neighbours.search(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op3_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    out = pages.main_text(_table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document."""
    found = secrets.find_secrets(_table(spark, sf_dir, "documents").select("doc_id", "text"), "text", "secrets")
    spans, n = F.col("secrets"), lambda kind: F.size(F.filter(F.col("secrets"), lambda x: x["kind"] == kind)).cast("long")
    return found.select(
        "doc_id",
        n("assign").alias("n_assign"),
        n("access").alias("n_access"),
        n("hex").alias("n_hex"),
        F.sha2(secrets.spans_text(F.filter(spans, lambda x: x["kind"] != "random")), 256).alias("base_sha256"),
        secrets.spans_text(spans).alias("spans"),
    )


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What of every document the benchmark holds."""
    found = decontaminate.contamination(_table(spark, sf_dir, "documents").select("doc_id", "text"), _table(spark, sf_dir, "benchmark").select("item_id", "text"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), decontaminate.items_digest(F.col("items")).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"), "n_near", "hits")


def op6_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The component of every document under the Jaccard join."""
    return jaccard.similarity_classes(_table(spark, sf_dir, "documents"))


def op7_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence of every document; its source and the thousands of its id are its folders."""
    docs = _table(spark, sf_dir, "documents")
    path = F.concat_ws("/", F.when(F.col("doc_id").isNotNull(), F.col("source")), F.floor(F.col("doc_id") / 1000).cast("string"), F.col("doc_id").cast("string"))
    return licenses.licences(docs.select("doc_id", "text", path.alias("path")), carry=["doc_id", "path"])


def op8_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every document's text, and whether they decode to it."""
    return pieces.encode(_table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document."""
    return language.identify(_table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source"), carry=["doc_id"])


def op10_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the long strings that occur elsewhere, and its passages of over 50 words that other documents hold."""
    out = repeats.without_repeats(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_bytes", "n_removed", F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"), "n_passages", "n_passage_words")


def op11_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shard and slot of every document. [native]"""
    return sharding.shard_table(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op12_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The twenty best documents of every benchmark item."""
    return ranked.search(_table(spark, sf_dir, "documents").select("doc_id", "text"), _table(spark, sf_dir, "benchmark").select("item_id", "text"))


def op13_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nodes of the trie of rebuilt conversations."""
    return trie.conversation_trie(_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"))


def language_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every page: its text with the declared markup language, the suffix of its address, and its host."""
    seen = language.page_evidence(_table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return language.identify(seen.select("page_id", "page_text", "markup_language", "host"), "page_text", "markup_language", "host", carry=["page_id"])


def lm_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What SQL can express of op1_lm: all but the automaton's score."""
    return op1_lm(spark, sf_dir).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", F.round("base_score", 4).alias("base_score"))


def secrets_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What SQL can express of op4_secrets: all but the spans that the vocabulary finds."""
    return op4_secrets(spark, sf_dir).drop("spans")


def contamination_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What SQL can express of op5_decontaminate: all but the proximity matches."""
    return op5_decontaminate(spark, sf_dir).drop("n_near", "hits")


def jaccard_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's columns of op6_jaccard."""
    return op6_jaccard(spark, sf_dir).select("doc_id", "n_shingles", "component_id")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_lm, op2_neighbours, op3_pages, op4_secrets, op5_decontaminate, op6_jaccard, op7_licences, op8_pieces, op9_language, op10_repeats, op11_shards, op12_ranked, op13_trie, language_pages, lm_base, secrets_base, contamination_exact, jaccard_components)
}

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = f"regexp_extract_all({_LOWER}, '[^\\x20\\x09-\\x0D]+')"
_PLAIN = f"regexp_extract_all({_LOWER}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"


def _crc(text: str) -> str:
    """crc32 of an SQL text's UTF-8 bytes, half a byte at a time."""
    table = []
    for c in range(16):
        for _ in range(4):
            c = c >> 1 ^ (0xEDB88320 if c & 1 else 0)
        table.append(c)

    def step(c: str, half: str) -> str:
        return f"xor(({table}::bigint[])[((xor({c}, {half}) & 15) + 1)::bigint], ({c}) // 16)"

    return f"xor(list_reduce(list_prepend(4294967295::bigint, list_transform(regexp_extract_all(hex(encode({text})), '..'), lambda x: ('0x' || x)::bigint)), lambda c, b: {step(step('c', 'b'), '(b // 16)')}), 4294967295::bigint)"


_CRC = _crc("doc_id::varchar")


def _bid(shards: int) -> str:
    """The shard of each document among so many, as SQL."""
    return f"""(select doc_id, arg_min(s, c) as shard from (select distinct doc_id, s, -ln((('0x' || substr(md5(coalesce(length(doc_id::varchar) || ':' || doc_id::varchar, '-') || '/' || s), 1, 13))::bigint::double + 0.5) / 4503599627370496) as c from documents, range(0, {shards}) r(s)) group by doc_id)"""



def _kind_sql(kind: str, rank: int, pattern: str, kept: str) -> str:
    return f"""select doc_id, '{kind}' as kind, {rank} as rank, s, e from (
  select doc_id, v, v2, (sum(g) over w + sum(length(v)) over w - length(v))::bigint as s, (sum(g) over w + sum(length(v)) over w)::bigint as e
  from (select doc_id, unnest(ms) as v, unnest(m2) as v2, unnest(list_transform(list_slice(gs, 1, len(ms)), lambda g: length(g))) as g, generate_subscripts(ms, 1) as i
    from (select doc_id, regexp_extract_all(text, '{pattern}') as ms, regexp_extract_all(text, '{pattern}', {2 if kind == "assign" else 0}) as m2, string_split_regex(text, '{pattern}') as gs from documents where regexp_matches(text, '{pattern}')))
  window w as (partition by doc_id order by i)) where {kept}"""


_ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)"""

#: SQL of what it can express; learned models, vocabularies and page structure have none, and tests/llm holds plain versions of them.
ORACLES: dict[str, str] = {
    "lm_base": f"""with d as (select doc_id, {_CRC} % 10 = 0 as held_out, list_append({_WORDS}, chr(10)) as w from documents),
t as (select doc_id, held_out, unnest(w) as w from d), c as (select w, count(*) as c from t where not held_out group by w), s as (select coalesce(sum(c), 0)::bigint as n, count(*) as v from c)
select doc_id, held_out, count(*)::bigint as n_tokens, count(c.c)::bigint as n_known, any_value(s.n)::bigint as train_tokens, round(sum(log10((coalesce(c.c, 0) + 0.1::double) / (s.n + 0.1::double * (s.v + 1)))), 4) as base_score
from t left join c using (w), s group by doc_id, held_out""",
    "secrets_base": f"""with f as ({_kind_sql("assign", 0, _ASSIGN, "length(v2) >= 12")} union all {_kind_sql("access", 1, "AKIA[A-Z0-9]+", "length(v) >= 18")} union all {_kind_sql("hex", 2, "[0-9a-f]+", "length(v) >= 16")})
select d.doc_id, count(*) filter (kind = 'assign')::bigint as n_assign, count(*) filter (kind = 'access')::bigint as n_access, count(*) filter (kind = 'hex')::bigint as n_hex, sha256(coalesce(string_agg(kind || ':' || s || ':' || e, ',' order by s, rank), '')) as base_sha256
from documents d left join f using (doc_id) group by d.doc_id""",
    "contamination_exact": f"""with b as (select item_id, {_PLAIN} as w from benchmark where item_id is not null),
bw as (select distinct item_id, case when len(w) < 10 then len(w) else 10 end as n, array_to_string(list_slice(w, i, i + 9), ' ') as x from (select item_id, w, unnest(range(1, greatest(2, len(w) - 8))) as i from b where len(w) > 0)),
d as (select doc_id, {_PLAIN} as w from documents), n as (select distinct n from bw),
dw as (select doc_id, n.n as n, i, array_to_string(list_slice(w, i, i + n.n - 1), ' ') as x from (select doc_id, w, unnest(range(1, len(w) + 1)) as i from d), n where i + n.n - 1 <= len(w)),
f as (select doc_id, i, dw.n, item_id from dw join bw on dw.x = bw.x and dw.n = bw.n),
h as (select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(range(i, i + n)) as p from f) group by doc_id), g as (select doc_id, count(distinct item_id) as n_items, string_agg(distinct item_id::varchar, ',' order by item_id::varchar) as items from f group by doc_id)
select doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items, sha256(coalesce(items, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated from d left join h using (doc_id) left join g using (doc_id)""",
    "jaccard_components": f"""with recursive d as (select doc_id, {_WORDS} as w from documents),
s as (select distinct doc_id, array_to_string(list_slice(w, i, i + 4), ' ') || case when len(w) < 5 then chr(10) || len(w) else '' end as x from (select doc_id, w, unnest(range(1, greatest(2, len(w) - 3))) as i from d where len(w) > 0)),
n as (select doc_id, count(*) as n from s group by doc_id), p as (select a.doc_id as a, b.doc_id as b, count(*) as k from s a join s b on a.x = b.x and a.doc_id <> b.doc_id group by 1, 2),
e as (select p.a, p.b from p join n x on x.doc_id = p.a join n y on y.doc_id = p.b where 100 * k >= 75 * (x.n + y.n - k)),
r as (select doc_id as a, doc_id as b from documents union select r.a, e.b from r join e on e.a = r.b)
select doc_id, coalesce(n.n, 0)::bigint as n_shingles, (select min(b) from r where r.a = documents.doc_id)::bigint as component_id from documents left join n using (doc_id)""",
    "op10_repeats": f"""with d as (select doc_id, encode(coalesce(text, '')) as b, {_WORDS} as w from documents),
x as (select doc_id, i, hash(array_slice(b, i, i + 399)) as h, md5(array_slice(b, i, i + 399)) as m from (select doc_id, b, unnest(range(1, octet_length(b) - 398)) as i from d where octet_length(b) >= 400)),
r as (select doc_id, i from x join (select h, m from x group by h, m having count(*) > 1) using (h, m)),
o as (select doc_id, i, i - coalesce(lag(i) over (partition by doc_id order by i), -400) as gap from r), g as (select doc_id, i, sum(case when gap > 400 then 1 else 0 end) over (partition by doc_id order by i) as run from o),
spans as (select doc_id, run, min(i) as s, max(i) + 400 as e from g group by doc_id, run),
cuts as (select doc_id, s, e, coalesce(lag(e) over (partition by doc_id order by s), 1) as before from spans),
kept as (select doc_id, string_agg(hex(array_slice(b, before, s - 1)), '' order by s) as head, max(e) as tail, sum(e - s) as n_removed, count(*) as n_spans from cuts join d using (doc_id) group by doc_id),
pw as (select doc_id, i, md5(array_to_string(list_slice(w, i, i + 50), ' ')) as h from (select doc_id, w, unnest(range(1, len(w) - 49)) as i from d where len(w) >= 51)),
pr as (select doc_id, i from pw join (select h from pw group by h having count(distinct doc_id) > 1) using (h)),
po as (select doc_id, i, i - coalesce(lag(i) over (partition by doc_id order by i), -51) as gap from pr), pg as (select doc_id, i, sum(case when gap > 51 then 1 else 0 end) over (partition by doc_id order by i) as run from po),
ps as (select doc_id, count(*) as n, sum(k) as k from (select doc_id, run, max(i) + 51 - min(i) as k from pg group by doc_id, run) group by doc_id)
select d.doc_id, octet_length(b)::bigint as n_bytes, coalesce(n_removed, 0)::bigint as n_removed, coalesce(n_spans, 0)::bigint as n_spans,
  sha256(unhex(case when head is null then hex(b) else head || hex(array_slice(b, tail, octet_length(b))) end)) as kept_sha256, coalesce(ps.n, 0)::bigint as n_passages, coalesce(ps.k, 0)::bigint as n_passage_words
from d left join kept using (doc_id) left join ps using (doc_id)""",
    "op11_shards": f"""select d.doc_id, (octet_length(encode(coalesce(text, ''))) + 8)::bigint as size, {_crc("coalesce(text, '')")}::bigint as text_crc32, 'key' as law, a.shard::int as shard,
  (row_number() over (partition by a.shard order by md5(coalesce(length(d.doc_id::varchar) || ':' || d.doc_id::varchar, '-')), octet_length(encode(coalesce(text, '')))) - 1)::bigint as slot, b.shard::int as grown_shard
from documents d join {_bid(24)} a on a.doc_id is not distinct from d.doc_id join {_bid(25)} b on b.doc_id is not distinct from d.doc_id""",
    "op12_ranked": """with d as (select row_number() over () as r, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+') as w from documents),
s as (select count(*) filter (len(w) > 0) as nn, sum(len(w))::bigint as ll from d), t as (select r, term, count(*) as tf from (select r, unnest(w) as term from d) group by r, term),
q as (select item_id, term, count(*) as k from (select item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) as term from benchmark) group by item_id, term),
f as (select term, floor(1000 * ln((2 * nn + 2)::double / (2 * count(*) + 1)))::bigint as w from t, s group by term, nn),
x as (select item_id, d.doc_id, d.r, sum(k * f.w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * len(d.w) * nn) // ll))))::bigint as score from q join t using (term) join f using (term) join d using (r), s group by item_id, d.doc_id, d.r)
select item_id, rank, doc_id, score from (select item_id, (row_number() over (partition by item_id order by score desc, doc_id))::int as rank, doc_id, score from x where score > 0) where rank <= 20""",
    "op13_trie": f"""with o as (select conv_id as c, row_number() over (partition by conv_id order by turn nulls first) as p, md5(coalesce(role, '') || chr(0) || coalesce(text, '')) as x, octet_length(encode(coalesce(text, ''))) as b from conversations where conv_id is not null),
l as (select c, list(x order by p) as xs, list(b order by p) as bs, {_crc("c::varchar")} % 9 as h from o group by c),
s as (select l.c, list_concat(coalesce(m.xs, [])[1:l.h], l.xs[l.h + 1:]) as xs, list_concat(coalesce(m.bs, [])[1:l.h], l.bs[l.h + 1:]) as bs from l left join l m on m.c = l.c - l.c % 5),
i as (select c, unnest(range(0, len(xs) + 1)) as d, xs, bs from s), k as (select c, d, array_to_string(xs[1:d], '') as key, len(xs) = d as ends, case when d = 0 then 0 else bs[d] end as b from i),
n as (select d, key, min(c) as conv_id, count(*) as n_convs, any_value(b) as b, sha256(coalesce(string_agg(c::varchar, ',' order by c) filter (ends), '')) as ends_sha256 from k group by d, key),
e as (select n.*, p.conv_id as parent from n left join n p on p.d = n.d - 1 and p.key = left(n.key, 32 * (n.d::int - 1))), g as (select d - 1 as d, parent, count(*) as kids from e where d > 0 group by 1, 2),
f as (select e.*, coalesce(kids, 0) as kids from e left join g on g.d = e.d and g.parent = e.conv_id),
u as (select a.d, a.key, count(*) filter (z.kids = 0) as n_leaves, sum((z.n_convs - 1) * z.b) as saved from f a join f z on z.d >= a.d and left(z.key, 32 * a.d::int) = a.key group by a.d, a.key)
select conv_id, d::bigint as depth, parent as parent_conv_id, n_convs, kids as n_children, n_leaves, saved::bigint as saved_tokens, ends_sha256 from f join u using (d, key)""",
}

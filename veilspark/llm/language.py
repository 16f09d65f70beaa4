"""Language identification by Bayesian fusion of evidence.

Four kinds of evidence about a text's language are added as log-probabilities:

* the text: a naive Bayes model over hashed byte trigrams of the whole text,
  fitted on at most ``sample_rows`` rows that declare a language (of each language
  as many, those with the smallest hashes, so the sample does not depend on order
  or partitions, and a rare language has its place);
  the class ``und`` gives every trigram the same probability and so wins over
  all languages for texts that are in none of them;
* the declared markup language, by how often rows of each language declare it;
* the address suffix, by how often rows of each language come from it;
* the host, whose prior is its own counts shrunk towards those of its suffix,
  which are shrunk towards those of the whole corpus.

The last three come from one grouped aggregation over all rows: each row counts
for the language that its text favours.  Rows are first summed by (host, suffix,
declared, language), so a hot host is a few counts and never a hot task.

A row is rejected (``kept`` false) if its text has no letter or ``und`` wins.

Nulls: a null text is empty and rejected; null or unseen declared languages,
suffixes and hosts add nothing.  Ties go to the language first in alphabetical
order.  Repeated rows are judged alike.  Without any labelled row every row is
``und`` and rejected.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilspark.llm.common import bytes_of, fresh, sliced, stored

SAMPLE_ROWS, BUCKETS = 4000, 1 << 16
#: Weight of the text's log-likelihood (trigrams overlap, so they are no independent evidence), and strength of shrinking.
TEXT_WEIGHT, KAPPA = 0.3, 20.0
UND = "und"
_LETTER = np.zeros(256, bool)
_LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


def trigrams(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the byte trigrams of lower-cased texts, with a space around each text, and their number by text."""
    data = np.frombuffer(b"".join(b" " + t + b" " for t in texts).lower(), np.uint8).astype(np.uint32)
    sizes = np.fromiter((len(t) + 2 for t in texts), np.int64, len(texts))
    key = np.zeros(len(data), np.uint32)
    key[:-2] = data[:-2] << 16 | data[1:-1] << 8 | data[2:]
    bucket = (key * np.uint32(2654435761)) >> np.uint32(16)
    ends = np.cumsum(sizes)
    keep = np.ones(len(data), bool)
    keep[ends - 1] = keep[ends - 2] = False
    return bucket[keep].astype(np.int32), sizes - 2


class TextModel:
    """Log-probabilities of trigrams by language; the last row is ``und``."""

    def __init__(self, texts: list[bytes], labels: list[str]) -> None:
        seen = sorted(set(labels))
        self.languages = [str(x) for x in seen if x != UND] + [UND]
        table = np.zeros((len(self.languages), BUCKETS))
        for k, x in enumerate(self.languages[:-1]):
            own = [t for t, y in zip(texts, labels, strict=True) if y == x]
            table[k] = np.bincount(trigrams(own)[0], minlength=BUCKETS)
        table[-1] = 0
        table += 0.5
        self.logp = np.log(table / table.sum(1, keepdims=True)).astype(np.float32)

    def score(self, texts: list[bytes]) -> np.ndarray:
        """Log-likelihoods: a row for each text, a column for each language."""
        bucket, counts = trigrams(texts)
        ends = np.cumsum(counts)
        out = np.zeros((len(texts), len(self.languages)))
        for k in range(len(self.languages)):
            sums = np.concatenate([[0.0], np.cumsum(self.logp[k][bucket], dtype=np.float64)])
            out[:, k] = sums[ends] - sums[ends - counts]
        return out


def has_letters(texts: list[bytes]) -> list[bool]:
    return [bool(_LETTER[np.frombuffer(t, np.uint8)].any()) for t in texts]


def fitted(df: DataFrame, text: str, declared: str, sample_rows: int = SAMPLE_ROWS) -> TextModel:
    """Fit the text model on at most ``sample_rows`` different labelled texts: of each declared language as many, those of the smallest hashes.

    However rare a language is, it takes part (of more than ``sample_rows`` the
    most frequent); copies of a text count once.
    """
    t, d = F.col(f"`{text}`"), F.lower(F.trim(F.col(f"`{declared}`").cast("string")))
    labelled = df.where(t.isNotNull() & d.isNotNull() & (F.length(t) > 0)).select(F.xxhash64(t, d).alias("h"), t.alias("t"), d.alias("d"))
    counts = labelled.groupBy("d").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").limit(sample_rows).collect()
    if not counts:
        return TextModel([], [])
    # Each language has its share, and what smaller languages leave of theirs; hashes are uniform, so about 1.1 times the share of n rows lies below its bound.
    left, shares = sample_rows, {}
    for k, r in enumerate(reversed(counts)):
        shares[r.d] = min(r.n, max(1, left // (len(counts) - k)))
        left -= shares[r.d]
    bounds = df.sparkSession.createDataFrame([(r.d, int(min(1.0, (1.1 * shares[r.d] + 10) / r.n) * 2**64) - 2**63 - 1) for r in counts], "d string, bound bigint")
    below = labelled.join(F.broadcast(bounds), "d").where("h <= bound").groupBy("h", "d").agg(F.min("t").alias("t"))
    taken: dict[str, list] = {}
    for r in below.orderBy("h", "d").toLocalIterator():
        if len(own := taken.setdefault(r.d, [])) < shares[r.d]:
            own.append(r.t.encode())
    return TextModel([x for own in taken.values() for x in own], [k for k, own in taken.items() for _ in own])


def _scored(df: DataFrame, model: TextModel, text: str, ll: str, letters: str, drop_text: bool = False) -> DataFrame:
    var = df.sparkSession.sparkContext.broadcast(model)  # languages x BUCKETS floats, whatever the input
    names = [c for c in df.columns if not (drop_text and c == text)]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema if f.name in names) + f", `{ll}` array<double>, `{letters}` boolean"

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = var.value
        for batch in sliced(batches, text, 1 << 20):
            own = bytes_of(batch, text)
            scores = m.score(own)
            offsets = np.arange(0, scores.size + 1, scores.shape[1], dtype=np.int32)
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in names), pa.ListArray.from_arrays(pa.array(offsets), pa.array(scores.ravel())), pa.array(has_letters(own))], [*names, ll, letters])

    return df.mapInArrow(scan, schema)


def _first_best(scores: Column) -> Column:
    return F.array_position(scores, F.array_max(scores)).cast("int")


def evidence(counts: DataFrame, languages: list[str], kappa: float = KAPPA) -> tuple[DataFrame, DataFrame]:
    """From counts(host, suffix, declared, lang as 1.., n): log-priors by (host, suffix), log-likelihoods by declared language."""
    n_lang = len(languages)

    def vector(df: DataFrame, keys: list[str], name: str) -> DataFrame:
        own = [F.sum(F.when(F.col("lang") == k + 1, F.col("n")).otherwise(0)).cast("double") for k in range(n_lang)]
        return df.groupBy(*keys).agg(F.array(*own).alias(name))

    w = counts.agg(*(F.coalesce(F.sum(F.when(F.col("lang") == k + 1, F.col("n"))), F.lit(0)).cast("double") for k in range(n_lang))).first()  # one row of a number for each language
    p0 = F.array(*(F.lit((x + 1.0) / (sum(w) + n_lang)) for x in w))
    given = F.array(*(F.lit(x + 0.5 * n_lang + 1.0) for x in w))
    total = lambda x: F.aggregate(x, F.lit(0.0), lambda a, b: a + b)
    shrunk = lambda own, up: F.transform(own, lambda x, i: (x + kappa * F.get(up, i)) / (total(own) + kappa))
    suffixes = vector(counts, ["suffix"], "s").select("suffix", shrunk(F.col("s"), p0).alias("p1"))
    hosts = vector(counts, ["host", "suffix"], "h").join(suffixes, "suffix", "left")
    prior = hosts.select("host", "suffix", F.transform(shrunk(F.col("h"), F.col("p1")), lambda x: F.log(x)).alias("host_ll"))
    declared = vector(counts.where("declared is not null"), ["declared"], "d").select("declared", F.transform(F.col("d"), lambda x, i: F.log((x + 0.5) / F.get(given, i))).alias("declared_ll"))
    return prior, declared


def suffix_of(host: Column) -> Column:
    """The last label of a host name that has several; null for others."""
    return F.when(F.instr(host, ".") > 0, F.lower(F.element_at(F.split(host, r"\."), -1)))


def identify(df: DataFrame, text: str = "text", declared: str = "lang", host: str = "source", sample_rows: int = SAMPLE_ROWS, carry: list[str] | None = None) -> DataFrame:
    """Language of each row.

    Returns the columns ``carry`` (all of ``df`` by default) and, under names
    that do not clash, language, posterior (of that language), text_language
    (what the text alone favours) and kept; the names are those of
    ``added_names(carry)``.
    """
    carry = df.columns if carry is None else carry
    taken = [*carry, text, declared, host]
    ll, letters, h, s, d = (fresh(x, taken) for x in ("ll", "letters", "host_key", "suffix_key", "declared_key"))
    model = fitted(df, text, declared, sample_rows)
    langs = model.languages
    host_c = F.coalesce(F.lower(F.col(f"`{host}`").cast("string")), F.lit(""))
    keyed = df.select(*(f"`{c}`" for c in dict.fromkeys([*carry, text])), host_c.alias(h), F.coalesce(suffix_of(host_c), F.lit("")).alias(s), F.lower(F.trim(F.col(f"`{declared}`").cast("string"))).alias(d))
    slim = _scored(keyed.select(f"`{text}`", h, s, d), model, text, ll, letters, drop_text=True)
    counts = slim.where(letters).groupBy(F.col(h).alias("host"), F.col(s).alias("suffix"), F.col(d).alias("declared"), _first_best(F.col(ll)).alias("lang")).agg(F.count("*").alias("n"))
    counts = stored(counts, "language-counts")
    prior, declared_ll = (stored(x, "language-evidence") for x in evidence(counts, langs))
    # Both tables were written, so their size is known: small ones are broadcast, larger ones joined by key.
    prior = prior.select(F.col("host").alias(h), F.col("suffix").alias(s), F.col("host_ll").alias(fresh("host_ll", taken)))
    declared_ll = declared_ll.select(F.col("declared").alias(d), F.col("declared_ll").alias(fresh("declared_ll", taken)))
    hl, dl = prior.columns[2], declared_ll.columns[1]
    scored = _scored(keyed, model, text, ll, letters, drop_text=text not in carry).join(prior, [h, s], "left").join(declared_ll, d, "left")
    fused = F.transform(F.col(ll), lambda x, i: x * TEXT_WEIGHT + F.coalesce(F.get(F.col(hl), i), F.lit(0.0)) + F.coalesce(F.get(F.col(dl), i), F.lit(0.0)))
    fu, names = fresh("fused", taken), added_names(carry)
    best = _first_best(F.col(fu))
    known = F.array(*map(F.lit, langs))
    posterior = 1.0 / F.aggregate(F.col(fu), F.lit(0.0), lambda a, x: a + F.exp(x - F.array_max(F.col(fu))))
    language = F.when(F.col(letters), F.element_at(known, best)).otherwise(UND)
    return scored.withColumn(fu, fused).select(
        *(f"`{c}`" for c in carry),
        language.alias(names[0]),
        F.when(F.col(letters), posterior).otherwise(F.lit(0.0)).alias(names[1]),
        F.when(F.col(letters), F.element_at(known, _first_best(F.col(ll)))).otherwise(UND).alias(names[2]),
        (language != UND).alias(names[3]),
    )


def added_names(carry: list[str]) -> list[str]:
    return [fresh(x, carry) for x in ("language", "posterior", "text_language", "kept")]


def page_evidence(pages: DataFrame, html: str = "html", url: str = "url") -> DataFrame:
    """``pages`` with markup_language (the lang attribute of the html element), host, and page_text (markup removed), for :func:`identify`."""
    h = F.col(f"`{html}`")
    return pages.withColumns(
        {
            "markup_language": F.nullif(F.regexp_extract(h, r"""(?is)<html\b[^>]*?\blang\s*=\s*["']?([A-Za-z]{2,3})""", 1), F.lit("")),
            "host": F.lower(F.regexp_extract(F.col(f"`{url}`"), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@]*@)?([^/:?#]*)", 1)),
            "page_text": F.regexp_replace(F.regexp_replace(h, r"(?is)<(script|style)\b.*?</\1\s*>", " "), r"<[^>]*>", " "),
        }
    )


def understood(df: DataFrame, text: str = "text", declared: str = "lang", host: str = "source") -> DataFrame:
    """The rows of ``df`` whose language is known, with their columns as before."""
    return identify(df, text, declared, host).where(F.col(added_names(df.columns)[3])).select(*(f"`{c}`" for c in df.columns))

"""Main text of web pages: page structure as a prior, and each host's suffix array as the judge.

A page is read into blocks of text.  Elements that hold no article (menus,
headers, footers, sidebars, notices, adverts, scripts, styles, by their names and
roles) are left out with all that is in them.  A class or id is weaker evidence: an
element that is called by a telling word goes unless it holds an article or nearly
all of the page; one that only has such a word within a class goes if it is a
small part of the page; a form goes unless it wraps the page.  If the page has an
article (or a main element), only its blocks are open; otherwise all are.

The open blocks of every page form a stream of tokens.  A run of at least ``run``
tokens is boilerplate if it stands on a share of the host's pages (``share`` where
structure leaves the page open, ``inside`` within an article, where moreover only
blocks that are boilerplate from end to end go) and on ``least`` distinct pages at
least (pages with equal streams, such as a print view, are one).  So what two
articles quote, what a page says twice, and small hosts stay whole, and the notice
that a host puts into every article goes.

1. What reaches a share of a host's pages reaches that share in some slice of the
   input.  So in each slice the streams of a host's pages are concatenated,
   windows of ``run`` tokens that too few of them hold are passed over, and the
   runs that are left are sorted as suffixes by induction
   (:mod:`veilspark.llm.induced`), whose common prefixes confirm them.
2. The windows so found are counted over all pages, exactly; only they are
   shuffled, with partial sums, so that a hot host is no hot task.
3. Every page drops what its host's boilerplate covers and keeps its unique runs.

Character references are decoded once, white space inside a block becomes one
space, blocks are joined by an empty line.  Nulls: a null page is empty; a null
address is a host of its own name "".  Repeated rows are read alike and count as
one page.  A page cut off inside a comment, script or tag ends there.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator
from html import unescape
from urllib.parse import urlsplit

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from veilspark.llm.common import fresh, mixed, sliced, stored, texts_of, word_hashes
from veilspark.llm.decontaminate import runs
from veilspark.llm.induced import repeated_starts
from veilspark.llm.repeats import window_hashes

RUN, LEAST, SHARE, INSIDE = 8, 3, 0.2, 0.5
#: Bytes of html that are read in a step, and tokens whose windows a task compares at a time.
SLICE, TOKENS = 4 << 20, 4_000_000
#: HTML's own element lists.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe noembed noframes xmp textarea title".split())
OUT = frozenset("head nav header footer aside button select option datalist fieldset menu dialog svg math object canvas audio video script style noscript template iframe noembed noframes xmp textarea title".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul caption".split())
INLINE_CLOSERS = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section table ul".split())
#: Elements that a new element of the same group closes, up to the elements that hold such a group.
SIBLINGS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
#: Words of class or id that name what is no article.
WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner popup modal overlay cookie cookies consent gdpr notice notices alert"
    " nav navbar navigation menu breadcrumb breadcrumbs pagination pager toc sidebar sidebars aside rail widget widgets header masthead footer colophon copyright"
    " comment comments disqus respond replies discussion share sharing social related recommended newsletter subscribe subscription signup login search".split()
)
#: Words that tell of readers' comments, and words of a class that speaks of another element.
COMMENT = frozenset("comment comments disqus respond replies discussion".split())
TELLS_OTHER = frozenset("has have no not with without is hide show hides shows".split())
#: An element with a telling word inside its class goes if it holds at most this share of a page's text.
SMALL_PART = 0.25
#: A form with this share of the text, and a block of so many signs, is a wrapper of the page.
MOST, SENTENCE = 0.6, 60
#: So is an element called by a telling word, but for comments, with this share and so many signs.
NEARLY_ALL, PAGE = 0.8, 500

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)(?:>|\Z)|[^<]+|<", re.S)
_ATTR = re.compile(r"""(?i)(?:^|[\s/"'])(class|id|role|hidden|aria-hidden)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?(?=[\s/"']|$)""")


def judged(name: str, attrs: str) -> str:
    """What an element's name and attributes say of it: "out" (no article), "named" (by a class or id that ends in a telling word), "hinted" (such a word elsewhere in one), "form", or nothing.

    A class that says that something else is there, or is not ("has-sidebar",
    "no-sidebar", "page-with-nav"), says nothing of the element itself.
    """
    if name in OUT:
        return "out"
    out = "form" if name == "form" else ""
    for key, *values in _ATTR.findall(attrs) if attrs.strip() else ():
        value = next((v for v in values if v), "")
        key = key.lower()
        if key == "hidden" or key == "aria-hidden" and value.lower() == "true" or key == "role" and value.lower() in ROLES:
            return "out"
        if key in ("class", "id") and name == "article" and re.search(r"(?i)comment|reply", value):
            return "out"
        if key in ("class", "id") and name not in ("html", "body", "article", "main", "form"):
            for token in value.split():
                parts = [x for x in re.split(r"[^a-z0-9]+", re.sub(r"([a-z])([A-Z])", r"\1-\2", token).lower()) if x]
                if WORDS.isdisjoint(parts) or not TELLS_OTHER.isdisjoint(parts):
                    continue
                if parts[-1] not in WORDS:
                    out = out or "hinted"
                elif not COMMENT.isdisjoint(parts):
                    return "comments"
                else:
                    out = "named"
    return out


class _Element:
    """An element that structure alone does not settle: what it is called, what it stands in, and how much text it holds."""

    __slots__ = ("kind", "largest", "main", "size", "up")

    def __init__(self, kind: str, up: _Element | None) -> None:
        self.kind, self.up, self.size, self.largest, self.main = kind, up, 0, 0, False

    def holds_page(self, total: int) -> bool:
        """Whether it is a wrapper of the page and no part that may go."""
        if self.main or self.kind == "hinted":
            return self.main or self.size > SMALL_PART * total
        if self.kind == "form":
            return self.size >= MOST * total and self.largest >= SENTENCE
        return self.kind == "named" and self.size >= NEARLY_ALL * total and self.size >= PAGE


def blocks(html: str) -> tuple[list[str], bool]:
    """Blocks of a page in order, and whether structure alone has chosen them.

    Every tag costs the same whatever is open: for each name the places of its
    open elements are kept, and the places of open blocks.
    """
    stack: list[tuple[str, bool, bool, _Element | None]] = []  # name, left out, in the article, innermost unsettled element
    places: dict[str, list[int]] = {}
    tall: list[int] = []  # places of open blocks
    found: list[tuple[str, bool, _Element | None]] = []
    parts: list[str] = []
    out = article = False
    element: _Element | None = None
    at, n = 0, len(html)

    def close() -> None:
        if parts:
            text = " ".join(unescape("".join(parts)).split())
            if text:
                found.append((text, article, element))
            parts.clear()

    def pop(to: int) -> None:
        nonlocal out, article, element
        while len(stack) > to:
            name = stack.pop()[0]
            places[name].pop()
            if name in BLOCK:
                tall.pop()
        _, out, article, element = stack[-1] if stack else ("", False, False, None)

    def last(names: set[str] | frozenset[str]) -> int:
        return max((p[-1] for x in names if (p := places.get(x))), default=-1)

    while at < n:
        m = _TOKEN.match(html, at)
        at = m.end()
        name = m[2]
        if name is None:
            if (html[m.start()] != "<" or m[0] == "<") and not out:
                parts.append(m[0])
            continue
        name = name.lower()
        if name == "br":
            if not out:
                parts.append(" ")
            continue
        if m[1]:
            if own := places.get(name):
                i = own[-1]
                if name in BLOCK:
                    close()
                elif tall and tall[-1] > i:
                    continue  # an inline end tag does not close blocks
                pop(i)
            continue
        if name in VOID:
            if name == "hr":
                close()
            continue
        if name in RAW:
            end = _raw_end(name).search(html, at)
            at = end.end() if end else n
            continue
        if name in BLOCK:
            close()
        if name in INLINE_CLOSERS and tall and stack[tall[-1]][0] == "p":
            pop(tall[-1])
        if name in SIBLINGS:
            same, holders = SIBLINGS[name]
            while (i := last(same)) > last(holders):
                pop(i)
                if name != "tr" or stack and stack[-1][0] not in same:
                    break
        kind = "" if out else judged(name, m[3])
        gone = out or kind == "out"
        own_article = name in ("article", "main") or bool(re.search(r"""(?i)\brole\s*=\s*["']?(?:main|article)\b""", m[3]))
        inside = article or own_article
        if own_article and not gone:
            up = element
            while up is not None and not up.main:
                up.main, up = True, up.up
        new = _Element(kind, element) if kind and not gone else element
        if gone != out or inside != article or new is not element:
            close()
        places.setdefault(name, []).append(len(stack))
        if name in BLOCK:
            tall.append(len(stack))
        stack.append((name, gone, inside, new))
        out, article, element = gone, inside, new
    close()
    total = sum(len(t) for t, _, _ in found)
    for t, _, e in found:
        while e is not None:
            e.size, e.largest, e = e.size + len(t), max(e.largest, len(t)), e.up
    stays: dict[_Element | None, bool] = {None: True}

    def kept(e: _Element | None) -> bool:
        chain = []
        while e not in stays:
            chain.append(e)
            e = e.up
        for x in reversed(chain):
            stays[x] = stays[x.up] and x.holds_page(total)
        return stays[chain[0]] if chain else stays[e]

    left = [(t, a) for t, a, e in found if kept(e)]
    sure = any(a for _, a in left)
    return [t for t, a in left if a or not sure], sure or not left


@functools.cache
def _raw_end(name: str) -> re.Pattern:
    return re.compile(rf"(?i)</{name}(?=[\s/>])[^>]*(?:>|\Z)")


@F.pandas_udf(StringType())
def _host(url: pd.Series) -> pd.Series:
    return url.map(host_of, na_action=None)


def host_of(url: str | None) -> str:
    try:
        return (urlsplit(url or "").hostname or "").lower()
    except ValueError:
        return ""


def _streams(pages_: list[str], hosts: list[str], run: int) -> list[tuple[list[str], bool, np.ndarray, np.ndarray, np.ndarray]]:
    """For each page: its open blocks, whether structure has chosen them, their numbers of tokens, the tokens' hashes, and the hashes of all windows of ``run`` tokens under the host."""
    read = [blocks(p) for p in pages_]
    tokens, counts = word_hashes([t.encode() for own, _ in read for t in own])
    ends = np.cumsum([len(own) for own, _ in read])
    cuts = np.concatenate([[0], np.cumsum(counts)])
    out = []
    for (own, sure), host, end in zip(read, hosts, ends.tolist(), strict=True):
        mine = tokens[cuts[end - len(own)] : cuts[end]]
        seed = np.uint64(xxhash.xxh64_intdigest(host))
        out.append((own, sure, counts[end - len(own) : end], mine, mixed(_hashes(mine, run) ^ seed)))
    return out


def _candidates(pages_: list[tuple], hosts: list[str], share: float, run: int) -> list[tuple[str, np.ndarray, np.ndarray, int, int]]:
    """By host: windows of its pages in a slice, on how many of them each stands, the host's pages in the slice, and those if it is a large part (else 0).

    Of a large part (of which a share is more than one page) only windows that
    reach the share are told, confirmed by a suffix array of their runs; of a
    small one all are.
    """
    by: dict[str, list[int]] = {}
    for i, host in enumerate(hosts):
        if len(pages_[i][3]):
            by.setdefault(host, []).append(i)
    out = []
    for host, own in by.items():
        held = [np.unique(pages_[i][4]) for i in own]
        found, n = np.unique(np.concatenate(held), return_counts=True)
        if share * len(own) <= 1:
            out.append((host, found, n, len(own), 0))
            continue
        found = found[n >= max(share * len(own), 2)]
        segments, windows = [], []
        for i in own:
            tokens, h = pages_[i][3], pages_[i][4]
            s, e = runs(np.isin(h, found))
            for x, y in zip(s, e, strict=True):
                segments.append(tokens[x : y + run - 1].tobytes())
                windows.append(h[x:y])
        if segments:
            again = [r[::8][: len(w)] for r, w in zip(repeated_starts(segments, 8 * run), windows, strict=True)]
            found = np.unique(np.concatenate([w[r] for w, r in zip(windows, again, strict=True)]))
        else:
            found = found[:0]
        n = np.zeros(len(found), np.int64)
        for h in held:
            n += np.isin(found, h)
        out.append((host, found, n, len(own), len(own)))
    return out


def main_text(pages: DataFrame, html: str = "html", url: str = "url", run: int = RUN, least: int = LEAST, share: float = SHARE, inside: float = INSIDE) -> DataFrame:
    """``pages`` without ``html``, with text (string, empty if none); a column that has the name text is replaced.

    The pages are read again for each step instead of being kept, so they must
    be a table or something as cheap to read.
    """
    carry = [c for c in pages.columns if c not in (html, "text")]
    host, given = fresh("host", [*carry, html, url]), fresh("windows", [*carry, html, url])
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pages.select(*(f"`{c}`" for c in carry)).schema)
    slim = pages.select(F.col(f"`{html}`").alias("html"), _host(F.col(f"`{url}`")).alias("host"))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        names: list[str] = []

        def told() -> pa.RecordBatch:
            rows = _candidates(held, names, min(share, inside), run)
            sizes = [len(w) + 1 for _, w, *_ in rows]
            first = np.cumsum([0, *sizes[:-1]]).astype(np.int64) if rows else np.zeros(0, np.int64)
            host = pa.array([r[0] for r in rows], pa.string()).take(pa.array(np.repeat(np.arange(len(rows)), sizes)))
            none, windows, n = np.zeros(sum(sizes), bool), np.zeros(sum(sizes), np.int64), np.zeros(sum(sizes), np.int64)
            none[first] = True  # one row of each host has its pages, no window
            large = np.zeros(len(n), np.int64)
            for at, (_, w, c, here, big) in zip(first, rows, strict=True):
                windows[at + 1 : at + 1 + len(w)], n[at + 1 : at + 1 + len(w)] = w.view(np.int64), c
                n[at], large[at : at + 1 + len(w)] = here, big
            return pa.RecordBatch.from_arrays([host, pa.array(windows, mask=none), pa.array(n), pa.array(large)], ["host", "window", "n", "large"])

        # The larger the part of a host that a slice holds, the fewer windows reach the share by chance.
        for batch in sliced(batches, "html", SLICE):
            hosts = batch.column(1).to_pylist()
            held += [(None, sure, None, tokens, h) for _, sure, _, tokens, h in _streams(texts_of(batch, "html"), hosts, run)]
            names += hosts
            if sum(len(x[3]) for x in held) >= TOKENS:
                yield told()
                held.clear()
                names.clear()
        if held:
            yield told()

    # Slices name the same windows again and again: their counts are summed.  A large slice that does not name a window has it on
    # less than a share of its pages, a small one on none, so what cannot reach the share and ``least`` pages of a host is known here,
    # and a host keeps 1 / share times as many windows as a page has, about.
    named = slim.mapInArrow(find, "host string, window bigint, n bigint, large bigint").groupBy("host", "window").agg(F.sum("n").alias("n"), F.sum("large").alias("large"))
    named = stored(named, "window-names")
    hosts_ = named.where("window is null").select("host", F.col("n").alias("pages"), F.col("large").alias("pages_large"))
    most = F.col("n") + F.lit(min(share, inside)) * (F.col("pages_large") - F.col("large"))
    fit = named.where("window is not null").join(hosts_, "host").where((most >= F.lit(min(share, inside)) * F.col("pages")) & (most >= least))
    asked = stored(fit.groupBy("host").agg(F.collect_list("window").alias("windows")), "windows")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "html", SLICE):
            hosts = batch.column(1).to_pylist()
            at, rows, windows = [], [], []
            for k, (page, wanted) in enumerate(zip(_streams(texts_of(batch, "html"), hosts, run), batch.column(2), strict=True)):
                if not page[0]:
                    continue
                own = np.unique(page[4]).view(np.int64)
                own = own[np.isin(own, wanted.values.to_numpy())] if wanted.is_valid else own[:0]
                at.append(np.full(len(own) + 1, k))
                rows.append(np.full(len(own) + 1, xxhash.xxh64_intdigest(page[3].tobytes()) - (1 << 63)))
                windows += [own, np.zeros(1, np.int64)]
            if at:
                at, rows, windows = (np.concatenate(x) for x in (at, rows, windows))
                page_row = np.append(at[1:] != at[:-1], True)  # the last row of each page stands for the page itself
                yield pa.RecordBatch.from_arrays([batch.column(1).take(pa.array(at)), pa.array(windows, mask=page_row), pa.array(rows), pa.array(np.ones(len(at), np.int64))], ["host", "window", "row", "n"])

    counted = slim.join(asked, "host", "left").select("html", "host", "windows").mapInArrow(count, "host string, window bigint, row bigint, n bigint")
    counted = counted.groupBy("host", "window", "row").agg(F.sum("n").alias("n")).groupBy("host", "window").agg(F.sum("n").alias("n"), F.count("*").alias("rows"))
    counted = stored(counted.where(F.col("window").isNull() | (F.col("rows") >= least)), "window-counts")
    sizes = counted.where("window is null").select("host", F.col("n").alias("pages"))
    often = counted.where("window is not null").join(sizes, "host").where(F.col("n") >= F.lit(min(share, inside)) * F.col("pages"))
    wide, strict_ = (F.collect_list(F.when(F.col("n") >= F.lit(x) * F.col("pages"), F.col("window"))) for x in (share, inside))
    # Each page has so many windows at most, so a host has 1 / share times as many that reach the share.
    judged = stored(often.groupBy("host").agg(F.struct(wide.alias("open"), strict_.alias("inside")).alias("windows")), "boilerplate")

    def unique_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = len(carry)
        for batch in sliced(batches, html, SLICE):
            text = []
            bad = batch.column(n + 2)
            for k, (own, sure, counts, tokens, h) in enumerate(_streams(texts_of(batch, html), batch.column(n + 1).to_pylist(), run)):
                if bad[k].is_valid and own and len(h):
                    hit = np.flatnonzero(np.isin(h.view(np.int64), bad[k]["inside" if sure else "open"].values.to_numpy()))
                    edge = np.zeros(len(tokens) + 1, np.int64)
                    np.add.at(edge, hit, 1)
                    np.add.at(edge, hit + run, -1)
                    gone = np.split(np.cumsum(edge[:-1]) > 0, np.cumsum(counts)[:-1])
                    if sure:
                        own = [t for t, g in zip(own, gone, strict=True) if not g.all()]
                    else:
                        own = [t for t in (" ".join(w for w, x in zip(t.split(), g, strict=True) if not x) for t, g in zip(own, gone, strict=True)) if t]
                text.append("\n\n".join(own))
            yield pa.RecordBatch.from_arrays([*batch.columns[:n], pa.array(text, pa.string())], [*carry, "text"])

    judged = judged.select(F.col("host").alias(host), F.col("windows").alias(given))
    keyed = pages.select(*(f"`{c}`" for c in carry), F.col(f"`{html}`"), _host(F.col(f"`{url}`")).alias(host))
    joined = keyed.join(judged, host, "left").select(*(f"`{c}`" for c in carry), f"`{html}`", host, given)
    return joined.mapInArrow(unique_runs, f"{fields}{',' if fields else ''} text string")


def _hashes(tokens: np.ndarray, run: int) -> np.ndarray:
    """Hashes of the windows of ``run`` tokens."""
    return window_hashes(tokens, run) if len(tokens) >= run else np.zeros(0, np.uint64)

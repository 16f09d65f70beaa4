"""Suffix arrays by induced sorting, and permuted common prefixes, in whole-array steps.

Induction goes bucket by bucket (a bucket is a first symbol): everything that
smaller buckets put into a bucket is there before it is scanned, so a bucket is
scanned in one step.  A symbol that follows itself is induced within its bucket;
such a run gives its members in waves, which one stable sort lays out.
"""

from __future__ import annotations

import numpy as np

from veilspark.llm.common import mixed, powers


def suffix_types(text: np.ndarray) -> np.ndarray:
    """True where a suffix is smaller than the one after it; the last symbol is the smallest and counts as smaller."""
    heads = np.flatnonzero(np.concatenate([[True], text[1:] != text[:-1]]))
    first = text[heads].astype(np.int32)
    smaller = np.append(first[:-1] < first[1:], True)
    return np.repeat(smaller, np.diff(np.append(heads, len(text))))


def _run_back(text: np.ndarray) -> np.ndarray:
    """For each position, how many equal symbols stand directly before it."""
    heads = np.flatnonzero(np.concatenate([[True], text[1:] != text[:-1]]))
    return np.arange(len(text), dtype=np.int32) - np.repeat(heads, np.diff(np.append(heads, len(text)))).astype(np.int32)


def _waves(entries: np.ndarray, back: np.ndarray) -> np.ndarray:
    """Entries with the positions before them in their runs: first all entries, then one step back, and so on."""
    r = back[entries]
    if not r.any():
        return entries
    total = int(r.sum()) + len(entries)
    step = np.arange(total) - np.repeat(np.cumsum(r + 1) - (r + 1), r + 1)
    order = np.argsort(step, kind="stable")
    return (np.repeat(entries, r + 1) - step)[order].astype(np.int32)


def _dealt(positions: np.ndarray, text: np.ndarray, buckets: list[list[np.ndarray]]) -> None:
    """Append positions, in order, to the buckets of their symbols."""
    if not len(positions):
        return
    symbols = text[positions]
    order = np.argsort(symbols, kind="stable")
    symbols, positions = symbols[order], positions[order]
    cuts = np.flatnonzero(np.concatenate([[True], symbols[1:] != symbols[:-1]]))
    for a, b in zip(cuts, np.append(cuts[1:], len(symbols)), strict=True):
        buckets[symbols[a]].append(positions[a:b])


def induce(text: np.ndarray, smaller: np.ndarray, back: np.ndarray, leftmost: np.ndarray, symbols: int) -> np.ndarray:
    """The suffix array that the given order of leftmost-smaller suffixes induces."""
    none = np.zeros(0, np.int32)
    seeds: list[list[np.ndarray]] = [[] for _ in range(symbols)]
    _dealt(leftmost.astype(np.int32), text, seeds)
    put: list[list[np.ndarray]] = [[] for _ in range(symbols)]
    larger: list[np.ndarray] = [none] * symbols
    for c in range(symbols):
        own = _waves(np.concatenate(put[c]), back) if put[c] else none
        larger[c] = own
        scan = np.concatenate([own, *seeds[c]]) if seeds[c] else own
        before = scan[scan > 0] - 1
        _dealt(before[text[before] > c], text, put)
    put = [[] for _ in range(symbols)]
    out: list[np.ndarray] = []
    end = np.array([len(text) - 1], np.int32)
    for c in range(symbols - 1, -1, -1):
        own = _waves(np.concatenate(put[c]), back) if put[c] else none
        if text[-1] == c:
            own = np.concatenate([own, end])
        scan = np.concatenate([own, larger[c][::-1]])
        before = scan[scan > 0] - 1
        _dealt(before[text[before] < c], text, put)
        out.append(scan)
    return np.concatenate(out)[::-1]


def _doubled(names: np.ndarray) -> np.ndarray:
    """Ranks of the suffixes of the string of names, which has a unique smallest end."""
    m, rank, k = len(names), names.astype(np.int64), 1
    while True:
        after = np.zeros(m, np.int64)
        after[: max(0, m - k)] = rank[k:] + 1
        key = rank * (m + 2) + after
        order = np.argsort(key, kind="stable")
        key = key[order]
        rank = np.empty(m, np.int64)
        rank[order] = np.cumsum(np.concatenate([[0], key[1:] != key[:-1]]))
        if k >= m or rank[order[-1]] == m - 1:
            return order
        k *= 2


def suffix_array(text: np.ndarray, symbols: int) -> np.ndarray:
    """Positions of the suffixes of ``text`` in order; its last symbol is the only 0."""
    if len(text) < 2:
        return np.arange(len(text), dtype=np.int32)
    smaller = suffix_types(text)
    back = _run_back(text)
    leftmost = np.flatnonzero(smaller[1:] & ~smaller[:-1]) + 1
    # Leftmost-smaller substrings: sorted by inducing once, named by content, their string sorted.
    sa = induce(text, smaller, back, leftmost, symbols)
    place = np.full(len(text), -1, np.int32)
    place[leftmost] = np.arange(len(leftmost))
    order = place[sa]
    order = order[order >= 0]
    ends = np.append(leftmost[1:], len(text) - 1)
    up, down = powers(len(text) + 1)
    with np.errstate(over="ignore"):
        sums = np.zeros(len(text) + 1, np.uint64)
        np.cumsum((text.astype(np.uint64) + np.uint64(1)) * up[: len(text)], out=sums[1:])
        content = mixed((sums[ends + 1] - sums[leftmost]) * down[leftmost] + (ends - leftmost).astype(np.uint64))
    new = np.concatenate([[False], content[order[1:]] != content[order[:-1]]])
    names = np.empty(len(leftmost), np.int64)
    names[order] = np.cumsum(new)
    ranked = order if new.sum() == len(leftmost) - 1 else _doubled(names)
    return induce(text, smaller, back, leftmost[ranked], symbols)


def common_prefixes(text: np.ndarray, sa: np.ndarray) -> np.ndarray:
    """For each position, the length of the prefix that its suffix shares with the one before it in ``sa``.

    Where both are preceded by the same symbol, the value is that of the
    position before, less one; only the other positions are compared.
    """
    n = len(text)
    before = np.full(n, -1, np.int64)
    before[sa[1:]] = sa[:-1]
    at = np.arange(n)
    reducible = (before > 0) & (at > 0)
    reducible[reducible] = text[at[reducible] - 1] == text[before[reducible] - 1]
    todo = np.flatnonzero(~reducible & (before >= 0))
    length = np.zeros(n, np.int64)
    padded = np.concatenate([text.astype("<u2"), np.zeros(4, "<u2")])
    words = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(padded, 4)).view("<u8").ravel()
    a, b = todo.copy(), before[todo]
    while len(todo):
        inside = np.maximum(a, b) < n
        same = np.zeros(len(todo), bool)
        same[inside] = words[a[inside]] == words[b[inside]]
        stop = ~same
        if stop.any():
            x, y, extra = a[stop], b[stop], np.zeros(int(stop.sum()), np.int64)
            going = np.ones(len(extra), bool)
            for k in range(3):
                ok = np.maximum(x, y) + k < n
                going &= ok
                going[going] = padded[x[going] + k] == padded[y[going] + k]
                extra += going
            length[todo[stop]] = x + extra - todo[stop]
        todo, a, b = todo[same], a[same] + 4, b[same] + 4
    source = np.maximum.accumulate(np.where(reducible, 0, at))
    return np.where(reducible, np.maximum(length[source] - (at - source), 0), length)


def repeated_starts(segments: list[bytes], length: int) -> list[np.ndarray]:
    """For each segment, whether the string of ``length`` bytes at each of its starts also stands elsewhere in the segments."""
    sizes = np.fromiter(map(len, segments), np.int64, len(segments))
    whole = np.frombuffer(b"\0".join(segments) + b"\0\0", np.uint8)
    text = whole.astype(np.uint16) + 2
    ends = np.cumsum(sizes + 1) - 1
    text[ends] = 1
    text[-1] = 0
    sa = suffix_array(text, 258)
    plcp = common_prefixes(text, sa)
    again = plcp >= length
    after = np.zeros(len(text), bool)
    after[sa[:-1]] = again[sa[1:]]
    again |= after
    return [again[e - n : max(e - n, e - length + 1)] for e, n in zip(ends, sizes, strict=True)]

"""Plain versions of the operators, for small inputs."""

from __future__ import annotations

import hashlib
import math
import re
import string
import zlib
from collections import Counter, defaultdict

LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)
SPACED = re.compile(r"[^\x20\x09-\x0D]+")
PLAIN = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def sha(text: str | bytes) -> str:
    return hashlib.sha256(text if isinstance(text, bytes) else text.encode()).hexdigest()


def components(docs: list[tuple[int | None, str | None]], percent: int = 75) -> list[tuple[int | None, int, int | None]]:
    sets = []
    for _, text in docs:
        w = SPACED.findall((text or "").translate(LOWER))
        sets.append({tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    root = list(range(len(docs)))

    def find(x: int) -> int:
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(docs)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                root[find(i)] = find(j)
    low: dict[int, int] = {}
    for i, (d, _) in enumerate(docs):
        if d is not None:
            low[find(i)] = min(low.get(find(i), d), d)
    return [(d, len(sets[i]), low.get(find(i)) if sets[i] else d) for i, (d, _) in enumerate(docs)]


def contamination(docs: list[tuple[int, str | None]], items: list[tuple[int, str | None]], n: int = 10) -> list[tuple]:
    windows: dict[tuple, set] = defaultdict(set)
    for i, t in items:
        w = PLAIN.findall((t or "").translate(LOWER))
        for k in range(max(1, len(w) - n + 1)) if w and i is not None else ():
            windows[tuple(w[k : k + n])].add(i)
    out = []
    for d, t in docs:
        w = PLAIN.findall((t or "").translate(LOWER))
        hit, found = set(), set()
        for size in {len(x) for x in windows}:
            for k in range(len(w) - size + 1):
                if (x := tuple(w[k : k + size])) in windows:
                    hit.update(range(k, k + size))
                    found |= windows[x]
        out.append((d, len(w), len(hit), len(found), sha(",".join(sorted(map(str, found)))), bool(hit)))
    return out


def unrepeated(texts: list[str | None], length: int = 400) -> list[tuple[int, int, int, str]]:
    data = [(t or "").encode() for t in texts]
    seen = Counter(b[i : i + length] for b in data for i in range(len(b) - length + 1))
    out = []
    for b in data:
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        out.append((len(b), sum(gone), len(re.findall(b"\1+", bytes(gone))), sha(bytes(x for x, g in zip(b, gone, strict=True) if not g))))
    return out


def base_scores(docs: list[tuple[int | None, str | None]]) -> list[tuple]:
    tokens = [[*SPACED.findall((t or "").translate(LOWER)), "\n"] for _, t in docs]
    held = [zlib.crc32(("" if d is None else str(d)).encode()) % 10 == 0 for d, _ in docs]
    c = Counter(w for ts, h in zip(tokens, held, strict=True) if not h for w in ts)
    n, v = sum(c.values()), len(c)
    return [(d, h, len(ts), sum(c[w] > 0 for w in ts), n, sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ts)) for (d, _), ts, h in zip(docs, tokens, held, strict=True)]


def base_secrets(text: str | None) -> list[tuple[int, int, int]]:
    kinds = [
        ("""(password|passwd|secret|token|api_?key)["']?\\x20*[:=]\\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A, lambda m: len(m[2]) >= 12),
        ("AKIA[A-Z0-9]+", 0, lambda m: len(m[0]) >= 18),
        ("[0-9a-f]+", 0, lambda m: len(m[0]) >= 16),
    ]
    return sorted((m.start(), k, m.end()) for k, (p, f, ok) in enumerate(kinds) for m in re.finditer(p, text or "", f) if ok(m))


def passages(docs: list[tuple[int | None, str | None]], n: int = 51) -> dict[tuple, tuple[int, int]]:
    """By row: runs of words inside strings of ``n`` words that a different row holds, and their words."""
    words = {row: SPACED.findall((row[1] or "").translate(LOWER)) for row in docs}
    holders: dict[tuple, set] = defaultdict(set)
    for row, w in words.items():
        for k in range(len(w) - n + 1):
            holders[tuple(w[k : k + n])].add(row)
    out = {}
    for row, w in words.items():
        hit = bytearray(len(w))
        for k in range(len(w) - n + 1):
            if len(holders[tuple(w[k : k + n])]) > 1:
                hit[k : k + n] = b"\1" * n
        out[row] = (len(re.findall(b"\1+", bytes(hit))), sum(hit))
    return out


def backoff_scores(docs: list[tuple[int | None, str | None]], mass: tuple[float, ...] = (300.0, 2.0), order: int = 3) -> list[float]:
    """log10 probabilities of the texts under a backoff model: dictionaries of arcs, and a walk that carries its context."""
    tokens = [[*SPACED.findall((t or "").translate(LOWER)), "\n"] for _, t in docs]
    train = [ts for (d, _), ts in zip(docs, tokens, strict=True) if zlib.crc32(("" if d is None else str(d)).encode()) % 10]
    c = Counter(tuple(ts[i : i + k]) for ts in train for k in range(1, order + 1) for i in range(len(ts) - k + 1))
    n, v = sum(map(len, train)), len({w for ts in train for w in ts})

    def probability(gram: tuple) -> float:
        if len(gram) == 1:
            return (c[gram] + 0.1) / (n + 0.1 * (v + 1))
        shorter = probability(gram[1:])
        return (c[gram] + mass[len(gram) - 2] * shorter) / (c[gram[:-1]] + mass[len(gram) - 2]) if c[gram[:-1]] else shorter

    out = []
    for ts in tokens:
        state: tuple = ()
        total = 0.0
        for w in ts:
            while state and not c[(*state, w)]:
                total += math.log10(mass[len(state) - 1] / (c[state] + mass[len(state) - 1])) if c[state] else 0.0
                state = state[1:]
            total += math.log10(probability((*state, w)))
            state = (*state, w)[-(order - 1) :]
        out.append(total)
    return out


def ranking(docs: list[tuple[int | None, str | None]], items: list[tuple[int | None, str | None]], k: int = 20) -> set[tuple]:
    """(item_id, rank, doc_id, score)."""
    term = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
    bags = [Counter(term.findall((t or "").translate(LOWER))) for _, t in docs]
    sizes = [sum(b.values()) for b in bags]
    n, total, df = sum(s > 0 for s in sizes), sum(sizes), Counter(w for b in bags for w in b)
    asked: dict = defaultdict(Counter)
    for i, t in set(items):
        asked[i].update(term.findall((t or "").translate(LOWER)))
    out = set()
    for i, q in asked.items():
        scored = []
        for (d, _), b, s in zip(docs, bags, sizes, strict=True):
            m = 75 + (25 * s * n // total if total else 0)
            points = sum(c * math.floor(1000 * math.log((2 * n + 2) / (2 * df[w] + 1))) * (1_000_000_000 * b[w] // (1000 * b[w] + 12 * m)) for w, c in q.items() if b[w])
            if points > 0:
                scored.append((-points, d is None, d or 0, d))
        out |= {(i, r + 1, d, -p) for r, (p, _, _, d) in enumerate(sorted(scored, key=lambda x: x[:3])[:k])}
    return out


def shards(keys: list, n: int) -> list[int]:
    """The shard of each key: the lowest -ln(draw)."""
    out = []
    for key in keys:
        text = "-" if key is None else f"{len(str(key))}:{key}"
        draws = [(int(hashlib.md5(f"{text}/{s}".encode()).hexdigest()[:13], 16) + 0.5) / 16**13 for s in range(n)]
        out.append(max(range(n), key=draws.__getitem__))
    return out


def trie(rows: list[tuple]) -> list[tuple]:
    """Nodes of rows (conv_id, turn, role, text), by a dictionary of all beginnings."""
    own: dict[int, list] = defaultdict(list)
    for c, t, r, x in rows:
        if c is not None:
            digest = hashlib.sha256(b"".join(f"{len(p.encode())}:".encode() + p.encode() for p in (r or "", x or ""))).digest()[:16]
            own[c].append(((t is not None, t or 0, digest), r or "", x or ""))
    own = {c: [x[1:] for x in sorted(v, key=lambda x: x[0])] for c, v in own.items()}
    built = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        built[c] = (*own.get(c - int(math.fmod(c, 5)), [])[:h], *turns[h:])
    nodes: dict[tuple, list[int]] = defaultdict(list)
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            nodes[turns[:d]].append(c)
    kids: dict[tuple, list] = defaultdict(list)
    for key in nodes:
        if key:
            kids[key[:-1]].append(key)
    leaves, saved = Counter(), Counter()
    for key in sorted(nodes, key=len, reverse=True):
        leaves[key] = sum(leaves[k] for k in kids[key]) or 1
        saved[key] = sum(saved[k] for k in kids[key]) + ((len(nodes[key]) - 1) * len(key[-1][1].encode()) if key else 0)
    return [
        (min(m), len(k), min(nodes[k[:-1]]) if k else None, len(m), len(kids[k]), leaves[k], saved[k], sha(",".join(str(c) for c in sorted(m) if built[c] == k)))
        for k, m in nodes.items()
    ]

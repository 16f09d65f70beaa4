"""Licence scan: sparse TF-IDF cosine to templates, then inheritance from the nearest ancestor folder.

Wherever a text speaks of a licence, the words around are compared with the
templates: windows of a template's length slide over the place, both sides are
vectors of words and word pairs weighted by their inverse document frequency
among the templates, and the template with the largest cosine wins if it reaches
``threshold``.  A whole file is also compared with the whole licence texts (the files
in ``licence_texts``, by SPDX identifier): from a cosine of ``WHOLE`` on it is that
licence's file, whatever notice it quotes.  A statement that is denied ("not
licensed under ...") is none, and a file that restricts what its licence allows is
named so and speaks for no folder.  A file most of whose words lie in such windows is a licence file
and speaks for its folder; a licence found in any other file speaks for that file
(its header).  A file without a licence of its own takes that of the nearest
folder above it that has a licence file.  Folders are looked up by joins on the
path of each ancestor; folders that speak are one row each, so a hot folder is no
hot group.

Nulls: a null text is empty; a null path inherits nothing.  Ties: equal cosines
go to the template first in alphabetical order (a file that names several
licences lists them all); of several licence files of a
folder the one with the larger cosine, then the smaller path, speaks.  Repeated
rows are scanned alike.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import cache
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilspark.llm.common import fresh, sliced, stored, texts_of

THRESHOLD, FILE_SHARE, WHOLE = 0.7, 0.5, 0.9
#: Cosines of windows that the scan of one text keeps at a time.
KEPT = 20_000
#: Short notices by SPDX identifier; each line is a template.
TEMPLATES = {
    "AGPL-3.0": ["This program is free software under the terms of the GNU Affero General Public License version 3", "licensed under the GNU Affero General Public License version 3"],
    "Apache-2.0": ["Licensed under the Apache License Version 2.0 the License you may not use this file except in compliance with the License", "Licensed under the Apache License Version 2.0", "Apache License Version 2.0 January 2004"],
    "BSD-2-Clause": ["licensed under the BSD 2-Clause License", "licensed under the Simplified BSD License"],
    "BSD-3-Clause": ["Redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "licensed under the BSD 3-Clause License"],
    "CC-BY-4.0": ["This work is licensed under a Creative Commons Attribution 4.0 International License", "Licensed under CC BY 4.0"],
    "CC-BY-NC-4.0": ["This work is licensed under a Creative Commons Attribution NonCommercial 4.0 International License", "Licensed under CC BY-NC 4.0"],
    "CC-BY-SA-4.0": ["This work is licensed under a Creative Commons Attribution ShareAlike 4.0 International License", "Licensed under CC BY-SA 4.0"],
    "CC0-1.0": ["dedicated to the public domain under the Creative Commons CC0 1.0 Universal license", "Licensed under CC0 1.0"],
    "EPL-2.0": ["made available under the terms of the Eclipse Public License 2.0"],
    "GPL-2.0": ["This program is free software you can redistribute it and or modify it under the terms of the GNU General Public License version 2", "This work is licensed under the GNU General Public License version 2"],
    "GPL-3.0": ["This program is free software you can redistribute it and or modify it under the terms of the GNU General Public License version 3", "This work is licensed under the GNU General Public License version 3"],
    "ISC": ["Permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "licensed under the ISC License"],
    "LGPL-3.0": ["licensed under the terms of the GNU Lesser General Public License version 3"],
    "MIT": ["Permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "Released under the MIT License", "licensed under the MIT License"],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License v 2.0", "licensed under the Mozilla Public License version 2.0"],
    "Unlicense": ["This is free and unencumbered software released into the public domain"],
}
#: Those that allow every use.
SOFTWARE = frozenset(name for name in TEMPLATES if not name.startswith("CC-"))
_WORD = re.compile(r"[a-z0-9]+(?:[.-][a-z0-9]+)*")
#: Words that make a whole text that of a licence of its kin, if it holds them so many times; the licence itself has them less often.
KIN = {("GPL-3.0", "affero"): ("AGPL-3.0", 10)}
#: Words of restrictions that a licence's own text does not have.
RESTRICTS = frozenset("noncommercial non-commercial commercially nonprofit non-profit academic evaluation".split())
#: Words that turn a statement round, and how far before it.
NEGATES, REACH = frozenset("not never neither nor without isn cannot no".split()), 3
_SPEAKS = re.compile(r"(?i)licen[sc]e|spdx|permission|redistribut|public domain|free software|source code form")
_SPDX = re.compile(r"(?i)SPDX-License-Identifier:\s*([A-Za-z0-9.+-]+)")
_KEY = frozenset("license licensed licence licenced licenses spdx permission redistribution redistribute domain software form".split())


def _terms(words: list[str]) -> Counter:
    return Counter(words) + Counter(f"{a} {b}" for a, b in zip(words, words[1:], strict=False))


@cache
def _model() -> tuple[list[tuple[str, int, dict[str, float]]], dict[str, float], float]:
    """Templates as (identifier, words, unit vector), the weights of terms, and the weight of an unseen term."""
    texts = [(name, _WORD.findall(t.lower())) for name, all_ in sorted(TEMPLATES.items()) for t in all_]
    df = Counter(term for _, words in texts for term in set(_terms(words)))
    idf = {term: math.log((1 + len(texts)) / (1 + n)) + 1 for term, n in df.items()}
    unseen = math.log(1 + len(texts)) + 1
    return [(name, len(words), _unit(words, idf, unseen)) for name, words in texts], idf, unseen


def _unit(words: list[str], idf: dict[str, float], unseen: float) -> dict[str, float]:
    v = {t: n * idf.get(t, unseen) for t, n in _terms(words).items()}
    norm = math.sqrt(sum(x * x for x in v.values())) or 1.0
    return {t: x / norm for t, x in v.items()}


@cache
def _whole() -> tuple[list[tuple[str, int, dict[str, float]]], dict[str, float], float, frozenset[str]]:
    """The whole licence texts as (identifier, words, unit vector), the weights of terms, that of an unseen term, and all words."""
    texts = [(f.stem, _WORD.findall(f.read_text(encoding="utf-8").lower())) for f in sorted((Path(__file__).parent / "licence_texts").glob("*.txt"))]
    df = Counter(term for _, words in texts for term in set(_terms(words)))
    idf = {term: math.log((1 + len(texts)) / (1 + n)) + 1 for term, n in df.items()}
    unseen = math.log(1 + len(texts)) + 1
    return [(name, len(words), _unit(words, idf, unseen)) for name, words in texts], idf, unseen, frozenset(w for _, words in texts for w in words)


def whole_file(words: list[str], at_least: float = WHOLE) -> tuple[str, float] | None:
    """The licence whose whole text a file holds, and the cosine; None if there is none."""
    texts, idf, unseen, vocabulary = _whole()
    fits = [t for t in texts if t[1] <= 2 * len(words) and len(words) <= 2 * t[1]]
    if not fits or sum(w in vocabulary for w in words) < 0.75 * len(words):
        return None
    u = _unit(words, idf, unseen)
    best = max(((round(sum(x * u.get(t, 0.0) for t, x in vector.items()), 12), name) for name, _, vector in fits), key=lambda x: (x[0], [-ord(c) for c in x[1]]))
    if best[0] < at_least:
        return None
    own = next(vector for name, _, vector in fits if name == best[1])
    for (name, word), (kin, times) in KIN.items():
        if name == best[1] and sum(w == word for w in words) >= times:
            return kin, best[0]
    return (best[1], best[0]) if not restricted(words, own) else None


def restricted(words: list[str], own: dict[str, float]) -> bool:
    """Whether a text has words of restriction that the licence does not have."""
    return any(w in RESTRICTS and w not in own for w in words)


def denied(words: list[str], start: int, n: int, own: dict[str, float]) -> bool:
    """Whether a window, or the words before it, has more words of denial than the template."""
    return any(w in NEGATES and w not in own for w in words[max(0, start - REACH) : start + n])


def scan(text: str, threshold: float = THRESHOLD) -> tuple[str | None, float, float, list[tuple[str, float]]]:
    """(best licence, its cosine, share of the words inside matches, all licences with their best cosines)."""
    if not _SPEAKS.search(text):
        return None, 0.0, 0.0, []
    templates, idf, unseen = _model()
    words = _WORD.findall(text.lower())
    if (file := whole_file(words)) is not None:
        return file[0], file[1], 1.0, [file]
    best: dict[str, float] = {}
    covered: set[int] = set()
    tried: set[tuple[int, int]] = set()
    cosines: dict[tuple, list[float]] = {}
    by_length: dict[int, list[tuple[str, dict[str, float]]]] = {}
    for name, n, vector in templates:
        by_length.setdefault(n, []).append((name, vector))
    for at in (i for i, w in enumerate(words) if w in _KEY):
        for n, group in by_length.items():
            for start in range(max(0, at - n + 1), min(at, max(0, len(words) - n)) + 1):
                if (start, n) in tried:
                    continue
                tried.add((start, n))
                window = (n, *words[start : start + n])
                if window not in cosines:
                    if len(cosines) >= KEPT:
                        cosines.clear()
                    u = _unit(list(window[1:]), idf, unseen)
                    cosines[window] = [sum(x * u.get(t, 0.0) for t, x in vector.items()) for _, vector in group]
                for (name, vector), c in zip(group, cosines[window], strict=True):
                    if c >= threshold and not denied(words, start, n, vector):
                        covered.update(range(start, min(len(words), start + n)))
                        best[name] = max(best.get(name, 0.0), round(c, 12))
    for m in _SPDX.finditer(text):
        name = next((k for k in TEMPLATES if m[1].lower() in (k.lower(), f"{k.lower()}-only", f"{k.lower()}-or-later")), None)
        if name:
            best[name] = 1.0
    if not best:
        return None, 0.0, 0.0, []
    if restricted(words, dict.fromkeys(w for t in TEMPLATES[max(best, key=lambda k: (best[k], k))] for w in _WORD.findall(t.lower()))):
        best = {f"{name} AND LicenseRef-restricted" if name in SOFTWARE else name: c for name, c in best.items()}
        covered.clear()  # such a file speaks for itself only
    ranked = sorted(best.items(), key=lambda x: (-x[1], x[0]))
    return ranked[0][0], ranked[0][1], len(covered) / max(1, len(words)), ranked


def folders(path: Column) -> Column:
    """All folders above a path, the nearest first; the root is the empty string."""
    parts = F.split(F.regexp_replace(path, "^/+|/+$", ""), "/+")
    return F.transform(F.sequence(F.size(parts) - 1, F.lit(0), F.lit(-1)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))


def licences(files: DataFrame, path: str = "path", text: str = "text", threshold: float = THRESHOLD, file_share: float = FILE_SHARE, carry: list[str] | None = None) -> DataFrame:
    """The columns ``carry`` (all but the text by default), own_license, cosine, is_license_file, license, origin, and licenses.

    ``origin`` is own, inherited or none; ``license`` is the file's own licence
    (the one with the largest cosine) or the inherited one; ``licenses`` are all
    that the file names, in alphabetical order.
    """
    carry = [c for c in files.columns if c != text] if carry is None else carry
    added = ["own_license", "cosine", "is_license_file", "license", "origin", "licenses"]
    carry = [c for c in carry if c not in added]
    cols = list(dict.fromkeys([*carry, path]))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in files.select(*(f"`{c}`" for c in cols)).schema)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, text):
            found = [scan(t, threshold) for t in texts_of(batch, text)]
            at = batch.schema.get_field_index
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(at(c)) for c in cols), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64()), pa.array([f[0] is not None and f[2] >= file_share for f in found]), pa.array([sorted(n for n, _ in f[3]) for f in found], pa.list_(pa.string()))],
                [*cols, *added[:3], "licenses"],
            )

    own = stored(files.select(*(f"`{c}`" for c in dict.fromkeys([*cols, text]))).mapInArrow(read, f"{fields}, own_license string, cosine double, is_license_file boolean, licenses array<string>"), "licences")
    p = F.col(f"`{path}`").cast("string")
    speaks = own.where(F.col("is_license_file") & p.isNotNull()).select(F.get(folders(p), F.lit(0)).alias("folder"), F.struct((-F.col("cosine")).alias("c"), p.alias("p"), F.col("own_license").alias("l")).alias("x"))
    speaks = stored(speaks.groupBy("folder").agg(F.min("x")["l"].alias("folder_license")), "folders")
    folder, depth, found = fresh("folder", own.columns), fresh("depth", own.columns), fresh("found", own.columns)
    ours = speaks.select(F.col("folder").alias(folder), F.col("folder_license").alias(found))
    # Each distinct folder of a file looks for its nearest ancestor once; files then join their folder.
    here = fresh("here", own.columns)
    places = own.where(p.isNotNull() & F.col("own_license").isNull()).select(F.get(folders(p), F.lit(0)).alias(here)).distinct()
    above = places.select(here, F.posexplode(F.concat(F.array(F.col(here)), F.filter(folders(F.col(here)), lambda x: x != F.col(here)))).alias(depth, folder))
    nearest = above.join(ours, folder).groupBy(here).agg(F.min_by(found, depth).alias(found))
    nearest = stored(nearest, "nearest")
    keyed = own.withColumn(here, F.when(F.col("own_license").isNull(), F.get(folders(p), F.lit(0))))
    return keyed.join(nearest, here, "left").select(
        *(f"`{c}`" for c in carry),
        *added[:3],
        F.coalesce("own_license", found).alias("license"),
        F.when(F.col("own_license").isNotNull(), "own").when(F.col(found).isNotNull(), "inherited").otherwise("none").alias("origin"),
        "licenses",
    )

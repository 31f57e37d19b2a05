"""License scan: TF-IDF cosine to templates, then inheritance along the path.

1. Inverse document frequencies of the templates' terms are counted over the
   whole corpus (the vocabulary is the templates' own, a fixed size).
2. Parts of every text are compared with each template by the cosine of sparse
   TF-IDF vectors: runs of up to ``MAX_RUN`` sentences or lines, and windows of
   about the template's own number of terms at every place, so that a notice
   inside a long line or wrapped over many short ones is found as well; all
   windows of a length are scored from one to the next, so a text costs its
   length, and the best one's ends are then moved. The cosine of a part is at
   most the norm of the template's vector on the part's terms. Templates whose
   norm on the whole text's terms lies below the threshold are skipped, which
   loses nothing. Runs without one of a template's anchor terms, its heaviest,
   are skipped for the same reason.
   Cosine cannot tell sibling licences apart, so a part is only named after a
   template if its distinguishing terms agree (``agrees``: Lesser, Affero, NC,
   SA, ND, version, number of BSD clauses).
3. A licence file licenses its directory: by its name, or because the whole text
   is a licence's full text (never a notice alone; ``files_by_text`` turns this
   off where directories are not those of projects). Distinct directories are joined to licensed ones over
   their ancestors, the nearest wins; documents without a header of their own
   inherit it by a join on the directory.

Defined results: a null or empty text has no header; a null path lies in the
root directory; of equal scores the first template by name wins, and of several
licence files in a directory the best score, then the first path; repeated rows
are scored alike; an empty table gives an empty table; other columns are never
read.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cinestat.llm.common import arrow_map, named, prepare, written

HEADER_THRESHOLD = 0.8
FILE_THRESHOLD = 0.8
MAX_RUN = 4
# lengths of the windows, by the template's own; the best one's ends are then moved to the best score
WINDOW_LENGTHS = (0.7, 0.8, 0.9, 1.0, 1.12, 1.25, 1.4)
# a template of so many terms is a licence's full text; the longest notice has 44
FULL_TERMS = 60
# places of a moved end that are tried for the distinguishing terms
BEST_ENDS = 64
FILE_NAME = r"(?i)(^|/)(licen[cs]e|copying|notice|unlicense)([.-][^/]*)?$"

# Public licence notices, several forms each, and below the full texts of licence files.
TEMPLATES: dict[str, list[str]] = {
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "SPDX-License-Identifier: Apache-2.0",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance "
        "with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    ],
    "BSD-3-Clause": [
        "Licensed under the BSD 3-Clause License.",
        "SPDX-License-Identifier: BSD-3-Clause",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
        "following conditions are met",
    ],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-NC-4.0": [
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    ],
    "CC-BY-SA-4.0": [
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    ],
    "CC0-1.0": ["Released under CC0 1.0 Universal.", "To the extent possible under law, the author has waived all copyright and "
                "related or neighboring rights to this work."],
    "GPL-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        "SPDX-License-Identifier: GPL-3.0-only",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public "
        "License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ],
    "MIT": [
        "Released under the MIT License.",
        "SPDX-License-Identifier: MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files (the \"Software\"), to deal in the Software without restriction",
    ],
    "MPL-2.0": [
        "SPDX-License-Identifier: MPL-2.0",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    ],
    "Unlicense": ["This is free and unencumbered software released into the public domain.", "SPDX-License-Identifier: Unlicense"],
    "0BSD": ["SPDX-License-Identifier: 0BSD", "Licensed under the BSD Zero Clause License."],
    "BSD-2-Clause": ["Licensed under the BSD 2-Clause License.", "SPDX-License-Identifier: BSD-2-Clause"],
    "GPL-1.0-or-later": [  # no version named
        "This work is licensed under the GNU General Public License.",
        "Licensed under the GPL.",
    ],
    "ISC": [
        "Released under the ISC License.",
        "SPDX-License-Identifier: ISC",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, "
        "provided that the above copyright notice and this permission notice appear in all copies.",
    ],
    "MPL-1.1": [
        "SPDX-License-Identifier: MPL-1.1",
        "The contents of this file are subject to the Mozilla Public License Version 1.1 (the \"License\"); you may not use this "
        "file except in compliance with the License.",
    ],
}
for _kind, _short, _versions in (("", "", ("2", "3")), ("Lesser ", "L", ("2.1", "3")), ("Library ", "L", ("2",)), ("Affero ", "A", ("3",))):
    for _v in _versions:
        _id = f"{_short}GPL-{_v if '.' in _v else _v + '.0'}"
        _has = TEMPLATES.setdefault(_id, [])
        _has += [x for x in (
            f"This work is licensed under the GNU {_kind}General Public License, version {_v}.",
            f"Licensed under the {_short}GPLv{_v}.",
            f"SPDX-License-Identifier: {_id}-only",
            f"SPDX-License-Identifier: {_id}-or-later",
            f"This program is free software: you can redistribute it and/or modify it under the terms of the GNU {_kind}General "
            f"Public License as published by the Free Software Foundation, either version {_v} of the License, or (at your option) "
            "any later version.") if x not in _has]
_WORDS = {"NC": "NonCommercial", "SA": "ShareAlike", "ND": "NoDerivatives"}
for _kind in ("BY", "BY-SA", "BY-ND", "BY-NC", "BY-NC-SA", "BY-NC-ND"):
    for _v, _port in (("4.0", "International"), ("3.0", "Unported"), ("2.5", "Generic"), ("2.0", "Generic")):
        _long = "-".join(["Attribution", *(_WORDS[x] for x in _kind.split("-")[1:])])
        _has = TEMPLATES.setdefault(f"CC-{_kind}-{_v}", [])
        _has += [x for x in (
            f"Licensed under CC {_kind} {_v}.",
            f"This work is licensed under a Creative Commons {_long} {_v} {_port} License.",
            f"SPDX-License-Identifier: CC-{_kind}-{_v}") if x not in _has]
for _file in sorted((Path(__file__).parent / "licence_texts").glob("*.txt")):
    TEMPLATES[_file.stem].append(_file.read_text(encoding="utf-8"))
# the AGPL's text is the GPL's but for its name and one section
TEMPLATES["AGPL-3.0"].append(re.sub("(?i)gnu general public", "GNU Affero General Public", TEMPLATES["GPL-3.0"][-1]))

_GNU = re.compile(r"\b(?:(lesser|library|affero) )?general public licen[cs]e\b|\b([al]?)gpl(?:v?[123])?\b")
_GNU_VERSION = re.compile(r"\b(?:version |v ?|licen[cs]e (?:v ?)?|[al]?gpl ?(?:v ?)?)([123])(?: ([01]))?\b")
_CC = re.compile(r"\b(?:cc by|creative commons attribution)((?: (?:nc|sa|nd|non ?commercial|share ?alike|no ?deriv\w*))*)"
                 r"(?: public)?(?: licen[cs]e)?(?: version| v)? (\d) (\d)\b")


def _gnu_name(part: str) -> str | None:
    kind, version = _GNU.search(part), _GNU_VERSION.search(part)
    if kind is None:
        return None
    short = {"lesser": "L", "library": "L", "affero": "A"}.get(kind[1] or "", (kind[2] or "").upper())
    if version is None:
        return "GPL-1.0-or-later" if not short else None
    return f"{short}GPL-{version[1]}.{version[2] or 0}"


def _cc_name(part: str) -> str | None:
    m = _CC.search(part)
    if m is None:
        return None
    kinds = [k for k, x in (("NC", r"nc|non ?commercial"), ("SA", r"sa|share ?alike"), ("ND", r"nd|no ?deriv\w*")) if re.search(rf" (?:{x})\b", m[1])]
    return "-".join(["CC-BY", *kinds, f"{m[2]}.{m[3]}"])


def _bsd_name(part: str) -> str | None:
    at = part.find("redistribution and use")
    if at >= 0:
        conditions, disclaimer, _ = part[at:].partition("this software is provided")
        if "advertising materials" in conditions:
            return None
        return "BSD-3-Clause" if "endorse" in conditions or not disclaimer else "BSD-2-Clause"
    m = re.search(r"\b(?:(2|two) clause|(3|three) clause|(simplified|freebsd)|(new|modified|revised) bsd)\b", part)
    return None if m is None else "BSD-2-Clause" if m[1] or m[3] else "BSD-3-Clause"


def _permission_name(part: str) -> str | None:
    at = part.find("permission to use copy modify")
    if at >= 0:
        return "ISC" if "provided that the above" in part[at:].partition("software is provided")[0] else "0BSD"
    return "ISC" if re.search(r"\bisc\b", part) else "0BSD" if re.search(r"\b0bsd\b|\bzero clause\b", part) else None


_MUST = {
    "Apache-2.0": r"^(?=.*\bapache\b).*\b(?:version |v|licen[cs]e |apache )2\b",
    "CC0-1.0": r"\bcc0\b|\bwaived\b",
    "MIT": r"\bmit\b|\bexpat\b|\bpermission is hereby granted free of charge\b",
    "MPL-1.1": r"\b(?:mozilla|mpl)\b.*?\b1 1\b",
    "MPL-2.0": r"\b(?:mozilla|mpl)\b.*?\b2 0\b",
    "Unlicense": r"\bunlicense\b|\bunencumbered\b",
}


def agrees(name: str, words: list[str], a: int, b: int) -> bool:
    """Whether the terms that tell the licence from its siblings agree in
    ``words[a:b]`` of a text; names without a rule always do."""
    if name.startswith(("GPL-", "LGPL-", "AGPL-")):
        return _gnu_name(" ".join(words[max(a - 2, 0):b + 20])) == name
    if name.startswith("CC-BY-"):
        return _cc_name(" ".join(words[a:b])) == name
    if name.startswith("BSD-"):  # the clauses follow the sentence that all have
        return _bsd_name(" ".join(words[a:b + 200])) == name
    if name in ("ISC", "0BSD"):
        return _permission_name(" ".join(words[a:b + 30])) == name
    return name not in _MUST or re.search(_MUST[name], " ".join(words[a:b])) is not None

_TERM = re.compile(r"\w+")
_CUT = re.compile(r"(?<=[.!?;])\s+|\s*\n\s*")


def terms(text: str) -> list[str]:
    return _TERM.findall(text.lower())


class _Windows:
    """TF-IDF norms of all windows of a text, each from its neighbour's: a term
    that comes in with c others of its kind adds idf^2 x (2c + 1), and one that
    goes takes as much away. The others are counted by place in the sorted list
    of (term, position)."""

    def __init__(self, words: list[str], idf: dict[str, float], default: float):
        self.kinds, code = np.unique(np.array(words, object), return_inverse=True) if words else (np.zeros(0, object), np.zeros(0, np.int64))
        self.code, self.n = code.astype(np.int64), len(words)
        self.idf = np.array([idf.get(t, default) for t in self.kinds])[code] if words else np.zeros(0)
        self.square = self.idf * self.idf
        at = np.arange(self.n)
        self.base = self.code * (self.n + 1)
        self.keys = np.sort(self.base + at)
        self.rank = np.searchsorted(self.keys, self.base + at)
        self.cache: dict[int, np.ndarray] = {}

    def dots(self, unit: dict[str, float]) -> np.ndarray:
        """Running sums of the products with a template's unit vector."""
        gain = np.array([unit.get(t, 0.0) for t in self.kinds])[self.code] * self.idf if self.n else np.zeros(0)
        return np.concatenate([[0.0], np.cumsum(gain)])

    def norms(self, n: int) -> np.ndarray:
        """Of the windows of ``n`` terms at every place."""
        if n not in self.cache:
            at = np.arange(self.n)
            earlier = self.rank - np.searchsorted(self.keys, self.base + np.maximum(at - n + 1, 0))
            later = np.searchsorted(self.keys, self.base + np.minimum(at + n - 1, self.n - 1), "right") - self.rank - 1
            come, go = self.square * (2 * earlier + 1), self.square * (2 * later + 1)
            total = come[:n].sum() + np.concatenate([[0.0], np.cumsum(come[n:] - go[:self.n - n])])
            self.cache[n] = np.sqrt(np.maximum(total, 1e-12))
        return self.cache[n]

    def ends(self, dots: np.ndarray, a: int, last: int) -> list[tuple[int, int, float]]:
        """(first, end, cosine) of the windows from ``a`` to every end up to
        ``last``, the best first."""
        last = min(last, self.n)
        earlier = self.rank[a:last] - np.searchsorted(self.keys, self.base[a:last] + a)
        cosine = (dots[a + 1:last + 1] - dots[a]) / np.sqrt(np.cumsum(self.square[a:last] * (2 * earlier + 1)))
        return [(a, a + 1 + k, float(cosine[k])) for k in np.argsort(-cosine, kind="stable")[:BEST_ENDS].tolist()]

    def starts(self, dots: np.ndarray, first: int, b: int) -> list[tuple[int, int, float]]:
        """The same for the windows that end at ``b``."""
        first = max(first, 0)
        later = np.searchsorted(self.keys, self.base[first:b] + b) - self.rank[first:b] - 1
        norm = np.cumsum((self.square[first:b] * (2 * later + 1))[::-1])[::-1]
        cosine = (dots[b] - dots[first:b]) / np.sqrt(norm)
        return [(first + k, b, float(cosine[k])) for k in np.argsort(-cosine, kind="stable")[:BEST_ENDS].tolist()]


class Matcher:
    """The templates' unit vectors under given document frequencies."""

    def __init__(self, templates: dict[str, list[str]], frequency: dict[str, int], documents: int, threshold: float):
        self.threshold = threshold
        self.default = math.log(1 + documents) + 1  # of a term that no document holds, and of all foreign terms
        vocabulary = {t for forms in templates.values() for f in forms for t in terms(f)}
        self.idf = {t: math.log((1 + documents) / (1 + frequency.get(t, 0))) + 1 for t in vocabulary}
        self.forms: list[tuple[str, dict[str, float]]] = []
        self.by_anchor: dict[str, list[int]] = {}
        for name in sorted(templates):
            for form in templates[name]:
                weight = {t: n * self.idf[t] for t, n in Counter(terms(form)).items()}
                norm = math.sqrt(sum(w * w for w in weight.values()))
                unit = {t: w / norm for t, w in weight.items()}
                left = 1.0
                for t, w in sorted(unit.items(), key=lambda x: (-x[1], x[0])):
                    if math.sqrt(max(left, 0.0)) < threshold:
                        break
                    self.by_anchor.setdefault(t, []).append(len(self.forms))
                    left -= w * w
                self.forms.append((name, unit))
        self.number = {t: k for k, t in enumerate(sorted(vocabulary))}
        self.squares = np.zeros((len(self.forms), len(self.number)))
        for i, (_, unit) in enumerate(self.forms):
            for t, u in unit.items():
                self.squares[i, self.number[t]] = u * u
        self.lengths = [len(terms(form)) for name in sorted(templates) for form in templates[name]]

    def scores(self, counts: Counter, among: set[int] | None = None) -> list[tuple[float, int]]:
        """(cosine, -template) of one run of sentences, the best first."""
        tried = {i for a in counts if a in self.by_anchor for i in self.by_anchor[a]}
        if among is not None:
            tried &= among
        weight = {t: n * self.idf.get(t, self.default) for t, n in counts.items()}
        norm = math.sqrt(sum(w * w for w in weight.values()))
        return sorted(((sum(w * self.forms[i][1].get(t, 0.0) for t, w in weight.items()) / norm, -i) for i in tried), reverse=True)

    def run_score(self, counts: Counter) -> tuple[str | None, float]:
        """The best template by cosine alone: (name, cosine)."""
        for s, i in self.scores(counts):
            return self.forms[-i][0], s
        return None, 0.0

    def candidates(self, text: str) -> set[int]:
        """The templates that a part of the text can reach the threshold with."""
        held = [self.number[t] for t in self.number.keys() & set(terms(" ".join(set(text.lower().split()))))]
        return set(np.flatnonzero(self.squares[:, held].sum(1) >= self.threshold ** 2 - 1e-9).tolist())

    def header(self, text: str, among: set[int] | None = None) -> tuple[str | None, float, int, int]:
        """The text's best run or window at or above the threshold: (name,
        cosine, first character, last + 1)."""
        found: tuple[str | None, float, int, int] = (None, 0.0, 0, 0)
        among = self.candidates(text) if among is None else among
        if not among:
            return found
        parts, at = [], 0
        for m in _CUT.finditer(text):
            parts.append((at, m.start()))
            at = m.end()
        parts.append((at, len(text)))
        spans = [(m.start(), m.end()) for m in _TERM.finditer(text)]
        words = [text[a:b].lower() for a, b in spans]
        starts = [a for a, _ in spans]
        place = [(bisect_left(starts, a), bisect_left(starts, b)) for a, b in parts]
        counted = [Counter(words[a:b]) for a, b in place]
        hit = [any(t in self.by_anchor for t in c) for c in counted]
        for i in range(len(parts)):
            run, any_hit = Counter(), False
            for j in range(i, min(i + MAX_RUN, len(parts))):
                run.update(counted[j])
                any_hit |= hit[j]
                if any_hit:
                    for s, k in self.scores(run, among):
                        if s < self.threshold or s <= found[1] + 1e-12:
                            break
                        if agrees(self.forms[-k][0], words, place[i][0], place[j][1]):
                            found = (self.forms[-k][0], s, parts[i][0], parts[j][1])
                            break
        found = self.window(spans, words, among, found)
        return found if found[1] >= self.threshold else (None, 0.0, 0, 0)

    def window(self, spans: list[tuple[int, int]], words: list[str], among: set[int],
               found: tuple[str | None, float, int, int]) -> tuple[str | None, float, int, int]:
        """``found``, or the best window of terms if one is better."""
        text = _Windows(words, self.idf, self.default)
        for i in sorted(among):
            if found[1] >= 1 - 1e-9:  # nothing is better
                break
            name, unit = self.forms[i]
            dots = text.dots(unit)
            least = max(self.threshold, found[1] + 1e-9)
            best = (0.0, 0, 0)
            for n in sorted({min(len(words), max(1, round(self.lengths[i] * x))) for x in WINDOW_LENGTHS}):
                cosine = (dots[n:] - dots[:-n]) / text.norms(n)
                near = cosine >= 0.9 * least
                if n >= FULL_TERMS:  # of neighbouring places of a long window only the best
                    near[1:] &= cosine[1:] >= cosine[:-1]
                    near[:-1] &= cosine[:-1] >= cosine[1:]
                places = np.flatnonzero(near)
                for k in places[np.argsort(-cosine[places], kind="stable")].tolist():
                    if cosine[k] <= best[0]:
                        break
                    if agrees(name, words, k, k + n):
                        best = (float(cosine[k]), k, k + n)
            while best[0] > 0:  # move one end, then the other, to its best place
                s, a, b = best
                for moved in (text.ends(dots, a, b + self.lengths[i]), text.starts(dots, a - self.lengths[i], b)):
                    for c, d, x in moved:
                        if x <= best[0] + 1e-12:
                            break
                        if agrees(name, words, c, d):
                            best = (x, c, d)
                            break
                if best[0] <= s + 1e-12:
                    break
            if best[0] >= least:
                found = (name, best[0], spans[best[1]][0], spans[best[2] - 1][1])
        return found

    def whole(self, text: str, among: set[int] | None = None) -> tuple[str | None, float]:
        """The licence whose full text the whole text is: a notice alone is no licence file."""
        words = terms(text)
        full = {i for i, n in enumerate(self.lengths) if n >= FULL_TERMS}
        for s, i in self.scores(Counter(words), full if among is None else among & full):
            if s < self.threshold or agrees(self.forms[-i][0], words, 0, len(words)):
                return self.forms[-i][0], s
        return None, 0.0


def term_frequencies(docs: DataFrame, vocabulary: set[str], text_col: str = "text") -> tuple[dict[str, int], int]:
    """Documents that hold each term of the vocabulary, and all documents."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = Counter(), 0
        for b in batches:
            for t in b.column("text").to_pylist():
                total += 1
                # a term is a part of a run of visible characters, so only runs that hold one are cut
                n.update(vocabulary.intersection(terms(" ".join(set((t or "").lower().split())))))
        yield pa.RecordBatch.from_pydict({"term": pa.array([*n, ""], pa.string()), "n": pa.array([*n.values(), total], pa.int64())})

    rows = arrow_map(docs.select(named(text_col).alias("text")), run, "term string, n long").groupBy("term").agg(F.sum("n").alias("n"))
    found = {r["term"]: r["n"] for r in rows.collect()}  # one row per term of the templates
    total = found.pop("", 0)
    return found, total


def parent(path):
    """The directory of a path; the root is the empty string."""
    return F.regexp_replace(F.coalesce(path, F.lit("")), "/?[^/]*$", "")


def nearest_licences(directories: DataFrame, licensed: DataFrame) -> DataFrame:
    """(dir, inherited, distance) for each directory with a licensed ancestor
    or a licence of its own. ``directories``: dir; ``licensed``: dir, licence."""
    depth = F.when(F.col("dir") == "", F.lit(0)).otherwise(F.size(F.split("dir", "/")))
    up = (directories.select("dir").distinct().withColumn("depth", depth)
          .withColumn("distance", F.explode(F.sequence(F.lit(0), F.col("depth"))))
          .withColumn("ancestor", F.expr("substring_index(dir, '/', depth - distance)")))
    hits = up.join(licensed.select(F.col("dir").alias("ancestor"), "licence"), "ancestor")
    return hits.groupBy("dir").agg(F.min_by("licence", "distance").alias("inherited"), F.min("distance").alias("distance"))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path_col: str = "path",
         templates: dict[str, list[str]] | None = None, header_threshold: float = HEADER_THRESHOLD,
         file_threshold: float = FILE_THRESHOLD, files_by_text: bool = True) -> DataFrame:
    """(doc_id, path, header, header_score, match_start, match_end, is_file,
    licence, origin, distance), one row per row of ``docs``. ``origin``:
    header, inherited or none."""
    prepare(docs.sparkSession)
    templates = templates or TEMPLATES
    vocabulary = {t for forms in templates.values() for f in forms for t in terms(f)}
    frequency, total = term_frequencies(docs, vocabulary, text_col)
    matcher = Matcher(templates, frequency, total, header_threshold)
    rows = docs.select(named(id_col).cast("long").alias("doc_id"), named(path_col).cast("string").alias("path"),
                       named(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [t or "" for t in b.column("text").to_pylist()]
            among = [matcher.candidates(t) for t in texts]
            found = [matcher.header(t, m) for t, m in zip(texts, among, strict=True)]
            whole = [matcher.whole(t, m) if m else (None, 0.0) for t, m in zip(texts, among, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("path"), pa.array([f[0] for f in found], pa.string()),
                 pa.array([f[1] for f in found], pa.float64()), pa.array([f[2] for f in found], pa.int64()),
                 pa.array([f[3] for f in found], pa.int64()), pa.array([w[0] for w in whole], pa.string()),
                 pa.array([w[1] for w in whole], pa.float64())],
                names=["doc_id", "path", "header", "header_score", "match_start", "match_end", "whole", "whole_score"])

    marked = written(arrow_map(rows, run, "doc_id long, path string, header string, header_score double, match_start long, "
                               "match_end long, whole string, whole_score double").withColumn("dir", parent(F.col("path"))),
                     "licence-headers")
    by_name = F.coalesce(F.col("path").rlike(FILE_NAME), F.lit(False)) & F.col("header").isNotNull()
    is_text = F.col("whole_score") >= file_threshold
    is_file = by_name | (is_text & F.lit(files_by_text))
    own = F.when(is_text, F.col("whole")).otherwise(F.col("header"))
    worth = F.struct(-F.greatest("whole_score", "header_score"), F.coalesce("path", F.lit("")), own)
    licensed = marked.where(is_file).groupBy("dir").agg(F.min_by(own, worth).alias("licence"))
    near = written(nearest_licences(marked.select("dir"), licensed), "licence-directories")
    # one row per directory that has a licence above it; the planner's size check decides on a broadcast
    return (marked.join(near, "dir", "left")
            .select("doc_id", "path", "header", "header_score", "match_start", "match_end", is_file.alias("is_file"),
                    F.coalesce(own, F.col("inherited")).alias("licence"),
                    F.when(own.isNotNull(), "header").when(F.col("inherited").isNotNull(), "inherited").otherwise("none").alias("origin"),
                    F.when(own.isNull(), F.col("distance")).alias("distance")))

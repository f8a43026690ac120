"""License scans: MinHash bands over overlapping text windows retrieve templates, exact shingle
containment verifies them.

Words are runs of ASCII letters and digits (lower case) and of bytes beyond ASCII; everything else
separates. A template's shingles have five words (a shorter template is one shingle of all its
words). Templates of like length are scanned together. Windows are two blocks of as many shingles
as the longest of them has, one block apart, so every place of a template lies within a window.

A match (containment of ``CONTAINMENT`` or more) then has a Jaccard index with its window of at
least ``j`` (see ``bands_for``); with one row per band, ``b`` bands miss it with probability
``(1 - j)^b``, and ``b`` is chosen to keep that under ``MISS``. Retrieved windows are verified on
their words: the share of the template's shingles found. Licences that differ in a few words (versions,
Lesser, NC) hold each other's notices in good part; so a verified window is dropped where a template of
another licence is found with a larger share on half or more of the same words. Neighbouring windows
of a text are one place.

One pass in Arrow batches, cut into slices; no shuffle and nothing kept between slices. Templates
are a parameter; their number bounds what a task holds, and they travel with the task.

Defined results: a null text has no words. Repeated rows give repeated results; a template found
several times gives one row with its number of places. An empty table gives an empty result; other
columns are not read.
"""

from __future__ import annotations

import math
from bisect import bisect_left
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tauframe.llm import tokens
from tauframe.llm.text import table

SHINGLE = 5
CONTAINMENT = 0.75
MISS = 1e-9

# Public license notices.
TEMPLATES = (
    ("Apache-2.0", "notice", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "header",
     "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in "
     "compliance with the License. You may obtain a copy of the License at "
     "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, "
     "software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR "
     "CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing "
     "permissions and limitations under the License."),
    ("MIT", "notice", "Released under the MIT License."),
    ("MIT", "permission",
     "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
     "associated documentation files (the \"Software\"), to deal in the Software without restriction, "
     "including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, "
     "and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, "
     "subject to the following conditions:"),
    ("GPL-2.0", "notice", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-2.0-only", "header",
     "This program is free software; you can redistribute it and/or modify it under the terms of the GNU "
     "General Public License version 2 as published by the Free Software Foundation."),
    ("GPL-2.0-or-later", "header",
     "This program is free software; you can redistribute it and/or modify it under the terms of the GNU "
     "General Public License as published by the Free Software Foundation; either version 2 of the License, "
     "or (at your option) any later version."),
    ("GPL-3.0", "notice", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0-or-later", "header",
     "This program is free software: you can redistribute it and/or modify it under the terms of the GNU "
     "General Public License as published by the Free Software Foundation, either version 3 of the License, "
     "or (at your option) any later version."),
    ("LGPL-2.1-or-later", "header",
     "This library is free software; you can redistribute it and/or modify it under the terms of the GNU "
     "Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the "
     "License, or (at your option) any later version."),
    ("LGPL-3.0-or-later", "header",
     "This program is free software: you can redistribute it and/or modify it under the terms of the GNU "
     "Lesser General Public License as published by the Free Software Foundation, either version 3 of the "
     "License, or (at your option) any later version."),
    ("AGPL-3.0-or-later", "header",
     "This program is free software: you can redistribute it and/or modify it under the terms of the GNU "
     "Affero General Public License as published by the Free Software Foundation, either version 3 of the "
     "License, or (at your option) any later version."),
    ("MPL-2.0", "header",
     "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the "
     "MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("EPL-2.0", "header",
     "This program and the accompanying materials are made available under the terms of the Eclipse Public "
     "License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/"),
    ("ISC", "permission",
     "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is "
     "hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("BSD", "conditions",
     "Redistribution and use in source and binary forms, with or without modification, are permitted provided "
     "that the following conditions are met:"),
    ("BSD-3-Clause", "endorsement",
     "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or "
     "promote products derived from this software without specific prior written permission."),
    ("Zlib", "warranty",
     "This software is provided 'as-is', without any express or implied warranty. In no event will the authors "
     "be held liable for any damages arising from the use of this software."),
    ("Unlicense", "notice", "This is free and unencumbered software released into the public domain."),
    ("CC0-1.0", "notice",
     "To the extent possible under law, the author has dedicated all copyright and related and neighboring "
     "rights to this software to the public domain worldwide."),
    ("CC-BY-4.0", "notice", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "statement",
     "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "notice", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-SA-4.0", "statement",
     "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0", "notice", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "statement",
     "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-NC-SA-4.0", "notice", "Licensed under CC BY-NC-SA 4.0."),
    ("CC-BY-NC-SA-4.0", "statement",
     "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License."),
    ("LicenseRef-all-rights-reserved", "notice", "All rights reserved."),
)

_KEEP = np.full(256, 0x20, np.uint8)
_KEEP[[*range(48, 58), *range(97, 123), *range(128, 256)]] = [*range(48, 58), *range(97, 123), *range(128, 256)]
_KEEP[65:91] = np.arange(97, 123)


@dataclass(frozen=True)
class Template:
    name: str
    part: str
    words: tuple[bytes, ...]
    size: int  # words in a shingle

    @property
    def shingles(self) -> frozenset:
        return frozenset(zip(*[self.words[k:] for k in range(self.size)]))

    @property
    def count(self) -> int:
        return len(self.words) - self.size + 1


def words(text: str) -> list[bytes]:
    return _KEEP[np.frombuffer(text.encode(), np.uint8)].tobytes().split()


def compiled(templates: Sequence[tuple[str, str, str]] = TEMPLATES) -> list[Template]:
    out = []
    for name, part, text in templates:
        w = tuple(words(text))
        if not w:
            raise ValueError(f"template {name} {part} has no words")
        out.append(Template(name, part, w, min(SHINGLE, len(w))))
    return out


def scan_groups(templates: Sequence[Template]) -> list[tuple[int, int, list[int]]]:
    """``(shingle size, block, templates)``: places scanned together, lengths within a factor 1.5."""
    out: list[tuple[int, int, list[int]]] = []
    for k in sorted(range(len(templates)), key=lambda k: (templates[k].size, -templates[k].count)):
        t = templates[k]
        if not out or out[-1][0] != t.size or 1.5 * t.count < out[-1][1]:
            out.append((t.size, t.count, []))
        out[-1][2].append(k)
    return out


def bands_for(count: int, block: int, miss: float = MISS) -> int:
    """Bands of one row that a match of ``count`` shingles in a window of ``2 * block`` needs."""
    need = math.ceil(CONTAINMENT * count)
    j = need / (2 * block + count - need)
    return math.ceil(math.log(miss) / math.log(1 - j))


def _factors(n: int) -> np.ndarray:
    return tokens.mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)) | np.uint64(1)


def _scan(templates: Sequence[Template]):
    groups = []
    for size, block, members in scan_groups(templates):
        bands = max(bands_for(templates[k].count, block) for k in members)
        factors, least = _factors(bands), []
        for k in members:
            w = tokens.words_of([b" ".join(templates[k].words)])
            s = tokens.sequences(w.hash, size)
            least.append(np.array([(s * f).min() for f in factors], np.uint64))
        groups.append((size, block, members, factors, least))

    def retrieved(h: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """``(template, first word, words)`` of windows that share a band with a template."""
        for size, block, members, factors, least in groups:
            s = tokens.sequences(h, size)
            if not len(s):
                continue
            tail = -len(s) % block
            s = np.concatenate([s, np.repeat(s[-1:], tail)]).reshape(-1, block)
            hits = [np.zeros(len(s), bool) for _ in members]
            y, one = np.empty_like(s), np.empty(len(s), np.uint64)
            for band, f in enumerate(factors):
                np.multiply(s, f, out=y)
                y.min(axis=1, out=one) if block > 1 else one.__setitem__(slice(None), y[:, 0])
                two = one.copy()
                np.minimum(one[:-1], one[1:], out=two[:-1])
                for hit, m in zip(hits, least):
                    hit |= two == m[band]
            for k, hit in zip(members, hits):
                for at in np.flatnonzero(hit).tolist():
                    yield k, at * block, 2 * block + size - 1

    def verified(w: tokens.Words, sets: list[frozenset]) -> Iterator[tuple[int, Found]]:
        """Windows that hold enough of their template, by text."""
        for k, lo, n in retrieved(w.hash):
            hi = min(lo + n, len(w.hash))
            first = int(np.searchsorted(w.first, lo, side="right")) - 1
            last = int(np.searchsorted(w.first, hi - 1, side="right")) - 1
            for text in range(first, last + 1):  # a window may lie over several texts
                a, b = max(lo, int(w.first[text])), min(hi, int(w.first[text + 1]))
                if b <= a:
                    continue
                own, size = w.bytes_of(a, b).split(), templates[k].size
                windows = list(zip(*[own[i:] for i in range(size)]))
                share = len(sets[k] & set(windows)) / len(sets[k])
                if share >= CONTAINMENT:
                    a -= int(w.first[text])
                    covered = {a + i + j for i, s in enumerate(windows) if s in sets[k] for j in range(size)}
                    yield text, Found(a, a + len(own), k, share, covered)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets = [t.shingles for t in templates]
        for part, texts in tokens.text_slices(batches):
            w = tokens.words_of(texts, _KEEP)
            seen: dict[int, list[Found]] = {}
            for text, found in verified(w, sets):
                seen.setdefault(text, []).append(found)
            rows = []
            for text, windows in seen.items():
                by: dict[int, list[Found]] = {}
                for f in best_of_overlapping(windows, templates):
                    by.setdefault(f.template, []).append(f)
                for k, own in by.items():
                    places, end = 0, -1
                    for f in own:
                        places += f.start >= end
                        end = max(end, f.end)
                    rows.append((text, templates[k].name, templates[k].part, own[0].start,
                                 max(f.share for f in own), places))
            rows.sort()
            ids = part.column("doc_id").take(pa.array([r[0] for r in rows], pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [ids, *[pa.array([r[c] for r in rows], t) for c, t in (
                    (1, pa.string()), (2, pa.string()), (3, pa.int64()), (4, pa.float64()), (5, pa.int64()))]],
                ["doc_id", "license", "part", "window_start", "containment", "n_places"])
    return run


@dataclass(frozen=True)
class Found:
    """A verified window of one text: words from ``start`` to ``end``, and those its template covers."""

    start: int
    end: int
    template: int
    share: float
    covered: set


def best_of_overlapping(windows: list[Found], templates: Sequence[Template]) -> list[Found]:
    """Windows in order, without those whose words another licence's template fits better. Only windows
    that overlap are compared; their number is bounded by the templates and the lengths of windows."""
    windows = sorted(windows, key=lambda f: (f.start, f.end, f.template))
    starts = [f.start for f in windows]
    longest = max(f.end - f.start for f in windows)
    worth = lambda f: (f.share, templates[f.template].count)
    return [e for e in windows if not any(
        templates[f.template].name != templates[e.template].name and worth(f) > worth(e)
        and 2 * len(e.covered & f.covered) >= len(e.covered)
        for f in windows[bisect_left(starts, e.start - longest):bisect_left(starts, e.end)])]


def scan(docs: DataFrame, templates: Sequence[tuple[str, str, str]] = TEMPLATES) -> DataFrame:
    """``doc_id, license, part, window_start`` (first word of the first verified window),
    ``containment`` (the best), ``n_places``, one row per document and template found."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(
        _scan(compiled(templates)), f"doc_id {kind}, license string, part string, window_start bigint, "
                                    "containment double, n_places bigint")


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents", "doc_id", "text"))

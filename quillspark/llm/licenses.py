"""Licence scans: word-bigram Dice coefficients of text units and templates.

A text's units are its lines, its paragraphs (between lines without a word), the whole,
and windows: runs of sentences and lines of about a template's length, where
many of its bigrams stand. Templates are short notices and, in license_texts,
whole licences. Units and templates are normalised alike: A-Z lower-cased, words are
runs of letters, digits and non-ASCII bytes. A template is compared with a unit
only if their bigram counts allow the threshold, and only units with enough
bigrams that occur in some template are looked at closely. Windows are sought
only for templates of which the text has enough distinct bigrams.
"""

from __future__ import annotations

from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm import textbuf as tb

THRESHOLD = 0.8

# Licence statements and the notices that licences ask for.
TEMPLATES: list[tuple[str, str]] = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'),
    ("MIT", "Released under the MIT License."),
    ("MIT", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.'),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("CC0-1.0", "Dedicated to the public domain under CC0 1.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
]

WHOLE: list[tuple[str, str]] = [(p.stem, p.read_text("utf-8")) for p in sorted((Path(__file__).parent / "license_texts").glob("*.txt"))]

_GAP = np.ones(256, bool)
_GAP[48:58] = _GAP[65:91] = _GAP[97:123] = False
_GAP[128:] = False


_STOP = np.zeros(256, bool)
_STOP[list(b".!?:;\n")] = True


def _bigrams(data: np.ndarray, offs: np.ndarray):
    """(first, starts, bigram hash of each word with the next)."""
    low = tb.LOWER[data]
    starts, ends, first = tb.words(low, offs, _GAP)
    h = tb.span_hash(tb.prefix_hash(low), starts, ends)
    pair = tb.mix(h[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:]) if len(h) > 1 else np.zeros(0, np.uint64)
    return first, starts, pair


def dice_of(unit: np.ndarray, templates: list[tuple[str, np.ndarray]], threshold: float) -> tuple[str | None, float]:
    """The first best template of a unit's distinct sorted bigrams at or above the threshold."""
    best, name = 0.0, None
    for key, t in templates:
        total = len(t) + len(unit)
        if 2 * min(len(t), len(unit)) < threshold * total:
            continue
        score = 2 * len(np.intersect1d(unit, t, assume_unique=True)) / total
        if score >= threshold and score > best:
            best, name = score, key
    return name, best


def windows_of(pair: np.ndarray, edges: np.ndarray, template: np.ndarray, length: int, threshold: float):
    """Disjoint windows (first word, past the last, dice) of one text, best first.

    ``pair`` are the text's bigrams, ``edges`` the words that begin a sentence
    or line and the number of words; ``length`` is the template's in bigrams.
    Dice >= t means that 2 * common - t * size is t * len(template) at least; the
    best begin for each end by that sum is compared exactly.
    """
    at = np.minimum(np.searchsorted(template, pair), len(template) - 1)
    order = np.argsort(pair, kind="stable")
    again = np.zeros(len(pair), bool)
    again[order[1:]] = (pair[order[1:]] == pair[order[:-1]]) & (order[1:] - order[:-1] < length)
    gain = np.where(again, 0.0, 2.0 * (template[at] == pair) - threshold)
    upto = np.concatenate([[0.0], np.cumsum(gain)])
    most, found = int(length * (2 - threshold) / threshold) + 1, []
    begins = edges[:-1]
    for end in edges[1:].tolist():
        lo, hi = np.searchsorted(begins, [end - most - 1, end - 1])
        if lo < hi:
            # The bigram that crosses into the window belongs to none.
            i = lo + int(np.argmin(upto[begins[lo:hi]]))
            value = upto[end - 1] - upto[begins[i]]
            if value >= 0.85 * threshold * len(template):
                found.append((value, int(begins[i]), end))
    out: list[tuple[int, int, float]] = []
    for _, a, b in sorted(found, key=lambda x: (-x[0], x[1])):
        if all(b <= x or a >= y for x, y, _ in out):
            dice = dice_of(np.unique(pair[a : b - 1]), [("", template)], threshold)[1]
            if dice:
                out.append((a, b, dice))
    return out


def _scan(templates: list[tuple[str, str]], threshold: float):
    sets, lengths = [], []
    for name, text in templates:
        raw = np.frombuffer(text.encode(), np.uint8)
        pairs = _bigrams(raw, np.array([0, len(raw)]))[2]
        if len(pairs):
            sets.append((name, np.unique(pairs)))
            lengths.append(len(pairs))
    every = np.unique(np.concatenate([s for _, s in sets])) if sets else np.zeros(0, np.uint64)
    # The least overlap of any match: dice >= t with one of the smallest template.
    need = min((int(np.ceil(threshold / (2 - threshold) * len(s))) for _, s in sets), default=1)
    member = np.stack([np.isin(every, s) for _, s in sets], 1) if sets else np.zeros((0, 0), bool)
    needs = np.array([int(np.ceil(threshold / (2 - threshold) * len(s))) for _, s in sets])

    def run(batches):
        for batch in batches:
            data, offsets = tb.buffers(batch.column("text"))
            found: list[dict[str, float]] = [{} for _ in range(len(batch))]
            hits = [0] * len(batch)
            for i, _, part, offs in tb.chunks(data, offsets):
                first, starts, pair = _bigrams(part, offs)
                if not len(pair) or not len(every):
                    continue
                at = np.minimum(np.searchsorted(every, pair), len(every) - 1)
                known = every[at] == pair
                doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
                line_at = np.flatnonzero(part == 0x0A)
                line = np.searchsorted(line_at, starts)
                paragraph = np.concatenate([[0], np.cumsum(np.diff(line) > 1)])
                seen: set[tuple[int, int]] = set()
                matched: dict[tuple[int, str], list[tuple[int, int]]] = {}
                for unit in (line, paragraph, np.zeros(len(starts), np.int64)):
                    new = np.ones(len(starts), bool)
                    new[1:] = (unit[1:] != unit[:-1]) | (doc[1:] != doc[:-1])
                    number = np.cumsum(new) - 1
                    begin = np.append(np.flatnonzero(new), len(starts))
                    inside = number[1:] == number[:-1]
                    score = np.bincount(number[:-1][inside & known], minlength=len(begin) - 1)
                    for u in np.flatnonzero(score >= need).tolist():
                        a, b = int(begin[u]), int(begin[u + 1])
                        if (a, b) in seen:
                            continue
                        seen.add((a, b))
                        name, dice = dice_of(np.unique(pair[a : b - 1]), sets, threshold)
                        if name:
                            d = i + int(doc[a])
                            hits[d] += 1
                            found[d][name] = max(dice, found[d].get(name, 0.0))
                            matched.setdefault((d, name), []).append((a, b))
                stops = np.concatenate([[0], np.cumsum(_STOP[part])])
                inside = doc[1:] == doc[:-1]
                per_doc = np.bincount(doc[:-1][inside & known], minlength=len(first) - 1)
                for k in np.flatnonzero(per_doc >= need).tolist():
                    a, b = int(first[k]), int(first[k + 1])
                    have = np.unique(at[a : b - 1][known[a : b - 1]])
                    likely = np.flatnonzero(member[have].sum(0) >= needs)
                    if not len(likely):
                        continue
                    edges = np.concatenate([[0], np.flatnonzero(stops[starts[a + 1 : b]] > stops[starts[a : b - 1]]) + 1, [b - a]])
                    for t in likely.tolist():
                        name, d = sets[t][0], i + k
                        for x, y, dice in windows_of(pair[a : b - 1], edges, sets[t][1], lengths[t], threshold):
                            found[d][name] = max(dice, found[d].get(name, 0.0))
                            places = matched.setdefault((d, name), [])
                            # A stretch that a unit already covers is no other unit.
                            if all(a + y <= p or a + x >= q for p, q in places):
                                places.append((a + x, a + y))
                                hits[d] += 1
            best = [min(f, key=lambda k: (-f[k], k)) if f else None for f in found]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(best, pa.string()), pa.array([f[k] if k else None for f, k in zip(found, best, strict=True)], pa.float64()), pa.array([",".join(sorted(f)) for f in found], pa.string()), pa.array(hits, pa.int64())],
                ["doc_id", "license_id", "dice", "licenses", "n_units"],
            )

    return run


def scan_licenses(spark: SparkSession, docs: DataFrame, templates: list[tuple[str, str]] | None = None, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, license_id, dice, licenses, n_units) of every row.

    license_id is the best matching template's name (ties: the smaller name),
    licenses all names found, n_units the matching units. No match, null, empty
    text: null, null, '', 0. Repeated rows give repeated rows, null ids stay,
    empty tables give none; extra columns are ignored. Texts of any length are
    scanned whole, with memory in proportion to the longest.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(_scan(TEMPLATES + WHOLE if templates is None else templates, threshold), "doc_id long, license_id string, dice double, licenses string, n_units long")

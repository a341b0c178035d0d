"""Operator 8: license scans by winnowed fingerprints and banded alignment.

Method. Words (letters and digits, lower case) of every template give hashes of K words; of every WINDOW such hashes in a
row the least is kept. An inverted index leads from these fingerprints to places in templates. A text is fingerprinted the
same way, so any K + WINDOW - 1 words that it shares with a template share a fingerprint. Hits of one template on near
diagonals make a candidate, and an alignment of its words within a band around them reports the matched share of the
template and the span of the match. Of overlapping matches the one with the most matched words stays.

Scale. No shuffle. The index of the templates is broadcast: its size is that of the templates. Fingerprints are taken per
slice of documents; only candidates, which are rare, cost more.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _kernels as K

GRAM, WINDOW = 3, 3
BAND = 12  # words by which a match may shift
COVERAGE = 0.8

#: Public notices, by SPDX identifier.
TEMPLATES = {
    "MIT": [
        "Released under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    ],
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    ],
    "GPL-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ],
    "GPL-2.0": [
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    ],
    "LGPL-2.1": [
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    ],
    "MPL-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    ],
    "BSD-3-Clause": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    ],
    "BSD-2-Clause": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    ],
    "ISC": [
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    ],
    "Unlicense": [
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    ],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC0-1.0": ["To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."],
    "Proprietary": ["All rights reserved. No part of this publication may be reproduced, distributed, or transmitted in any form or by any means."],
}


def winnow(grams: np.ndarray, group: np.ndarray) -> np.ndarray:
    """Indices of the fingerprints: of every WINDOW hashes in a row within a group the least, the last of equals. A group
    with fewer hashes keeps its least."""
    n = len(grams)
    keep = np.zeros(n, bool)
    if n >= WINDOW:
        m = n - WINDOW + 1
        best, at = grams[:m].copy(), np.arange(m)
        for j in range(1, WINDOW):
            less = grams[j : j + m] <= best
            best, at = np.where(less, grams[j : j + m], best), np.where(less, np.arange(j, j + m), at)
        whole = group[:m] == group[WINDOW - 1 :]
        keep[at[whole]] = True
    if n:
        sizes = np.bincount(group)
        begin = np.cumsum(sizes) - sizes
        for g in np.flatnonzero((sizes > 0) & (sizes < WINDOW)):
            keep[begin[g] + int(np.argmin(grams[begin[g] : begin[g] + sizes[g]]))] = True
    return np.flatnonzero(keep)


def _words(data: np.ndarray, offsets: np.ndarray):
    low = K.LOWER[data]
    starts, ends, doc = K.split_words(low, offsets, K.NOT_ALNUM)
    return starts, ends, doc, K.word_hashes(low, starts, ends) if len(starts) else np.zeros(0, np.uint64)


class Index:
    def __init__(self, templates: dict[str, list[str]]):
        self.names, self.words, rows = [], [], []
        for name, texts in templates.items():
            for text in texts:
                raw = np.frombuffer(text.encode(), np.uint8)
                _, _, doc, words = _words(raw, np.array([0, len(raw)]))
                grams, first = K.window_hashes(words, doc, GRAM)
                rows += [(grams[i], len(self.names), first[i]) for i in winnow(grams, np.zeros(len(grams), int))]
                self.names.append(name)
                self.words.append(words)
        rows.sort()
        self.prints = np.array([r[0] for r in rows], np.uint64)
        self.template = np.array([r[1] for r in rows], np.int64)
        self.place = np.array([r[2] for r in rows], np.int64)

    def hits(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(which print, which row of the index) for all equal fingerprints."""
        low, high = (np.searchsorted(self.prints, prints, side=s) for s in ("left", "right"))
        n = high - low
        which = np.repeat(np.arange(len(prints)), n)
        return which, np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n) + low[which]


def align(template: np.ndarray, words: np.ndarray, shift: int) -> tuple[int, int, int]:
    """Most template words in common order with ``words`` where word i of the template stands at i + shift, give or take
    BAND; (matched words, first matched word, end). Of equals the shortest span."""
    best = (0, 0, 0)
    row: dict[int, tuple[int, int, int]] = {}  # end so far -> (matched, -span, first)
    for i, t in enumerate(template.tolist()):
        if i + shift - BAND >= len(words):
            break  # the text ends here; what was matched so far counts
        new, run = {}, (0, 0, -1)
        for j in range(i + shift - BAND, i + shift + BAND + 1):
            if not 0 <= j < len(words):
                continue
            value = max(run, row.get(j, (0, 0, -1)))
            if words[j] == t:
                before = row.get(j - 1, (0, 0, -1))
                first = before[2] if before[0] else j
                value = max(value, (before[0] + 1, first - j, first))
            new[j] = run = value
        row = new
    for value in row.values():
        if value[0] and (value[0], value[1]) > (best[0], best[1] - best[2] + 1 if best[0] else -(1 << 30)):
            best = (value[0], value[2], value[2] - value[1] + 1)
    return best


def scan(index: Index, words: np.ndarray, at: np.ndarray, rows: np.ndarray, coverage: float) -> list[tuple[int, int, int, int]]:
    """Matches in one document: (template, matched words, first word, end). at: places of fingerprints; rows: of the index."""
    shift = at - index.place[rows]
    found = []
    order = np.lexsort((shift, index.template[rows]))
    last, done = (-1, 0), (-1, 0)  # template and shift of the last alignment; template and end of the last match
    for i in order.tolist():
        t, s = int(index.template[rows[i]]), int(shift[i])
        beyond = done[0] == t and bool(at[i] >= done[1])  # a fingerprint behind that match: another copy may follow it closely
        near = last[0] == t and s - last[1] <= BAND // 2
        if near and not beyond:
            continue
        last = (t, s)
        template = index.words[t]
        low, high = max(0, s - BAND), min(len(words), s + len(template) + BAND)
        for low in [low] * (not near) + [max(low, done[1])] * beyond:
            n, first, end = align(template, words[low:high].tolist(), s - low)
            if n >= coverage * len(template):
                found.append((t, n, first + low, end + low))
                done = (t, end + low)
    kept: list[tuple[int, int, int, int]] = []
    for f in sorted(found, key=lambda f: (-f[1], f[3] - f[2], f[2], f[0])):
        if all(f[3] <= k[2] or f[2] >= k[3] for k in kept):
            kept.append(f)
    return sorted(kept, key=lambda f: f[2])


MATCH = pa.struct([("license", pa.string()), ("coverage", pa.float64()), ("start", pa.int64()), ("end", pa.int64())])


def license_scan(docs: DataFrame, templates: dict[str, list[str]] | None = None, coverage: float = COVERAGE, text: str = "text", key: str = "doc_id") -> DataFrame:
    """doc_id and matches (license, matched share of the template, span in code points, end exclusive) for every row.

    Null, empty and wordless texts have no matches. Repeated rows and null keys are kept; other columns are not read. An
    empty table gives an empty result. Templates need GRAM words at least; shorter ones are never found.
    """
    index = docs.sparkSession.sparkContext.broadcast(Index(TEMPLATES if templates is None else templates))

    def run(batches):
        known: Index = index.value
        for batch in batches:
            for a, b, data, offsets in K.slices(batch.column(1)):
                starts, ends, doc, words = _words(data, offsets)
                grams, first = K.window_hashes(words, doc, GRAM)
                which = winnow(grams, doc[first])
                hit, rows = known.hits(grams[which])
                at = first[which[hit]]
                out: list[list[dict]] = [[] for _ in range(b - a)]
                if len(at):
                    begin = K.bounds(doc, b - a)
                    point = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
                    of = doc[at]
                    for d in np.unique(of).tolist():
                        mine = of == d
                        base, zero = begin[d], point[offsets[d]]
                        for t, n, s, e in scan(known, words[base : begin[d + 1]], at[mine] - base, rows[mine], coverage):
                            out[d].append({"license": known.names[t], "coverage": n / len(known.words[t]), "start": int(point[starts[base + s]] - zero), "end": int(point[ends[base + e - 1]] - zero)})
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(out, pa.list_(MATCH))], ["doc_id", "matches"])

    schema = "doc_id long, matches array<struct<license: string, coverage: double, start: long, end: long>>"
    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string")).mapInArrow(K.tidy(run), schema)


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = license_scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select(
        "doc_id",
        F.size("matches").cast("long").alias("n_matches"),
        F.array_join(F.array_sort(F.array_distinct("matches.license")), ",").alias("licenses"),
        F.array_max("matches.coverage").alias("best_coverage"),
        F.array_join(F.expr("transform(matches, x -> concat_ws(':', x.license, x.start, x.end))"), ",").alias("spans"),
    )

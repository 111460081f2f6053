"""License scan: MinHash bands over overlapping text windows retrieve templates, shingle containment verifies them.

A template of m shingles is looked for in windows of 2w shingles that overlap by half, w the power of two from m on, so
every place of it lies whole in some window, whose similarity with it is then above 1/8 even for a template cut to
three quarters. Windows and templates that agree in one of the bands of one minimum meet: at similarity 1/8 one of 64
bands agrees with probability above 0.999. Then the template's shingles in the window are counted exactly. A template of
fewer than five words is one shingle of its own length and is found by that shingle alone.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assay.llm.registry import query, table
from assay.llm.words import alphanumeric, mix, shingles, window_starts, words_of

SHINGLE = 5
CONTAINED = 0.75
BANDS = 64
LEAST_WINDOW = 4

# Public license notices, each as it is usually given.
TEMPLATES = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "This project is licensed under the terms of the MIT license."),
    (
        "MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without "
        "restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the "
        "Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    ),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    (
        "Apache-2.0",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at "
        "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT "
        "WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    ),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    (
        "GPL-3.0-or-later",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of "
        "the License, or (at your option) any later version.",
    ),
    (
        "GPL-2.0-or-later",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of "
        "the License, or (at your option) any later version.",
    ),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    (
        "BSD-3-Clause",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the "
        "above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the "
        "following disclaimer in the documentation and/or other materials provided with the distribution. Neither the name of the copyright holder nor the names of its contributors may be used to "
        "endorse or promote products derived from this software without specific prior written permission.",
    ),
    (
        "MPL-2.0",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    ),
)

#: With those of fewer than five words; numbers are places in this table.
NOTICES = (*TEMPLATES, ("All rights reserved", "All rights reserved."))


def minima(hashes: np.ndarray, bands: int = BANDS) -> np.ndarray:
    """The least value of these shingles under each of the permutations."""
    seeds = mix(np.arange(1, bands + 1, dtype=np.uint64))
    return mix(hashes[None, :] ^ seeds[:, None]).min(1)


class Templates:
    """Templates by window size, with the bands that find them."""

    def __init__(self, templates):
        self.names = [name for name, _ in templates]
        words = words_of(pa.array([text for _, text in templates]), alphanumeric())
        starts = window_starts(words.offsets, SHINGLE)
        values = shingles(words.hash, SHINGLE)[starts]
        row = np.searchsorted(words.offsets, starts, "right") - 1
        self.sets = [np.unique(values[row == i]) for i in range(len(templates))]
        if not words.counts().all():
            raise ValueError("a template needs a word")
        # Shorter templates: number and shingle, by length.
        self.short: dict[int, list[tuple[int, np.uint64]]] = {}
        for i in np.flatnonzero(words.counts() < SHINGLE).tolist():
            own = words.hash[words.offsets[i] : words.offsets[i + 1]]
            self.short.setdefault(len(own), []).append((i, shingles(own, len(own))[0]))
        self.shingles = np.unique(values)
        self.bands: dict[int, dict[tuple[int, int], list[int]]] = {}
        for i, s in enumerate(self.sets):
            if not len(s):
                continue
            size = max(LEAST_WINDOW, 1 << (len(s) - 1).bit_length())
            found = self.bands.setdefault(size, {})
            for band, least in enumerate(minima(s).tolist()):
                found.setdefault((band, least), []).append(i)


def _scan(templates: Templates, contained: float):
    names = ["doc_id", "license", "template", "first_word", "last_word", "containment"]

    def run(batches):
        for batch in batches:
            words = words_of(batch["text"], alphanumeric())
            starts = window_starts(words.offsets, SHINGLE)
            values = shingles(words.hash, SHINGLE)[starts]
            # A window without any shingle of a template shares no minimum with one: only the others get a signature.
            at = np.minimum(np.searchsorted(templates.shingles, values), len(templates.shingles) - 1)
            known = np.flatnonzero(templates.shingles[at] == values) if len(templates.shingles) else np.zeros(0, np.int64)
            row = np.searchsorted(words.offsets, starts[known], "right") - 1
            place = starts[known] - words.offsets[row]
            last = np.maximum(words.counts() - SHINGLE, 0)
            best: dict[tuple[int, int, int], tuple] = {}
            for size, bands in templates.bands.items():
                windows = {(int(r), max(0, int(p) // size - k)) for r, p in zip(row, place) for k in (0, 1)}
                for r, w in windows:
                    low = int(words.offsets[r]) + w * size
                    high = int(min(low + 2 * size, words.offsets[r] + last[r] + 1))
                    inside = shingles(words.hash[low : high + SHINGLE - 1], SHINGLE)
                    candidates = {i for band, least in enumerate(minima(inside).tolist()) for i in bands.get((band, least), ())}
                    for i in candidates:
                        hit = np.isin(inside, templates.sets[i])
                        share = len(np.unique(inside[hit])) / len(templates.sets[i])
                        if share >= contained:
                            where = np.flatnonzero(hit)
                            found = (share, -(w * size + int(where[0])), -(w * size + int(where[-1]) + SHINGLE))
                            # Overlapping windows see one place twice: the fuller view stays.
                            key = (r, i, found[1])
                            best[key] = max(best.get(key, found), found)
            for n, own in templates.short.items():
                places = window_starts(words.offsets, n)
                grams = shingles(words.hash, n)[places]
                for i, value in own:
                    for p in places[grams == value]:
                        r = int(np.searchsorted(words.offsets, p, "right")) - 1
                        low = int(p - words.offsets[r])
                        best[r, i, -low] = (1.0, -low, -(low + n))
            best = _apart(best)
            out = [(batch["doc_id"][r].as_py(), templates.names[i], i, -f, -l, share) for (r, i), (share, f, l) in best]
            kinds = [pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*out), kinds)] if out else [pa.array([], t) for t in kinds], names=names)

    return run


def _apart(best) -> list:
    """Of places of one template in one row that overlap, the fullest and then the first."""
    kept: dict[tuple[int, int], list[tuple]] = {}
    for (r, i, _), found in sorted(best.items(), key=lambda x: (x[0][0], x[0][1], -x[1][0], -x[1][1])):
        others = kept.setdefault((r, i), [])
        if all(-found[2] <= -o[1] or -o[2] <= -found[1] for o in others):
            others.append(found)
    return [(key, found) for key, places in kept.items() for found in places]


def license_notices(documents: DataFrame, templates=NOTICES, contained: float = CONTAINED) -> DataFrame:
    """A row for each place of a template in each whole text: doc_id, license, template (its number), first_word,
    last_word (exclusive; words are runs of letters, digits and non-ASCII characters) and containment, the share of the
    template's five-word shingles found there; 1 for a shorter template, which is found whole.

    Documents without a notice, and null, empty or shorter texts have no row; repeated rows and rows without doc_id
    are scanned like others. All work is local to a row, so nothing is shuffled.
    """
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return docs.mapInArrow(_scan(Templates(templates), contained), "doc_id long, license string, template int, first_word int, last_word int, containment double")


@query("op6_license_windows")
def op6_license_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_notices(table(spark, sf_dir, "documents"))

"""License scans: winnowed template fingerprints in an inverted index, then banded alignment.

Every template's word 3-grams are winnowed (windows of two), so a document that shares four consecutive
words with a template shares a fingerprint with it. The index maps a fingerprint to its places in the
templates; a document's hits of a template give diagonals (place in the document less place in the
template), close diagonals make one candidate, and the candidate is aligned in a band around them.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .decontam import WORDS, _flat, _Hashes, gram_hashes

#: Words in a fingerprint, fingerprints in a winnowing window.
GRAM, SPAN = 3, 2

#: Common notices and license texts.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0",
    "Apache-2.0-header": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. "
    "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, "
    "software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. "
    "See the License for the specific language governing permissions and limitations under the License.",
    "CC-BY-4.0": "Licensed under CC BY 4.0",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0",
    "CC-BY-4.0-notice": "This work is licensed under a Creative Commons Attribution 4.0 International License",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3",
    "GPL-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
    "the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it "
    "will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    "MIT": "Released under the MIT License",
    "MIT-text": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), "
    "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or "
    "sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright "
    "notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "BSD-text": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
    "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form "
    "must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "ISC-text": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above "
    "copyright notice and this permission notice appear in all copies.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "all-rights-reserved": "Copyright. All rights reserved worldwide",
}

RESULT = "doc_id long, license_id string, coverage double, matched_words int, template_words int, first_word int, end_word int, span_start int, span_end int"


def align(doc: list[bytes], template: list[bytes], low: int, high: int) -> tuple[int, int, int]:
    """Best local alignment of the template along diagonals low..high of the document.

    A match counts 2, a changed, missing or added word -1. Returns (matched words, first document word, end).
    """
    width = high - low + 1
    none = (0, 0, -1, 0)  # score, matched, first, end
    row: list[tuple[int, int, int, int]] = [none] * width
    best = none
    for t, word in enumerate(template):
        new: list[tuple[int, int, int, int]] = []
        for x in range(width):
            d = low + x + t
            diagonal = row[x]  # the same diagonal one word earlier
            up = row[x + 1] if x + 1 < width else none  # template word left out
            left = new[x - 1] if x else none  # document word left out
            cell = none
            if 0 <= d < len(doc):
                if doc[d] == word:
                    cell = (diagonal[0] + 2, diagonal[1] + 1, diagonal[2] if diagonal[1] else d, d + 1)
                elif diagonal[0] > 1:
                    cell = (diagonal[0] - 1, *diagonal[1:])
            for other in (up, left):
                if other[0] - 1 > cell[0]:
                    cell = (other[0] - 1, *other[1:])
            new.append(cell)
            best = max(best, cell, key=lambda c: c[:2])
        row = new
    return best[1], best[2], best[3]


class TemplateIndex:
    """Inverted index of winnowed fingerprints: hash -> places in the templates."""

    def __init__(self, templates: dict[str, str]):
        cache = _Hashes()
        self.names = sorted(templates)
        self.words = [templates[n].encode().translate(WORDS).split() for n in self.names]
        if min(map(len, self.words), default=GRAM + SPAN) < GRAM + SPAN - 1:
            raise ValueError(f"a template needs {GRAM + SPAN - 1} words")
        rows = []
        for i, words in enumerate(self.words):
            _, hashes, starts = _flat([b" ".join(words)], cache)
            at, h = prints(hashes, starts)
            rows += [(int(x), i, int(p)) for x, p in zip(h.tolist(), at.tolist(), strict=True)]
        self.places: dict[int, list[tuple[int, int]]] = {}
        for x, i, p in rows:
            self.places.setdefault(x, []).append((i, p))
        self.hashes = np.array(sorted(self.places), np.uint64)

    def scan(self, words: list[bytes], at: np.ndarray, h: np.ndarray, least: float) -> list[tuple[int, int, int, int]]:
        """(template, matched, first, end) of a document whose fingerprints are h at words ``at``, best first, not overlapping."""
        hits: dict[int, list[int]] = {}
        for x, p in zip(h.tolist(), at.tolist(), strict=True):
            for i, q in self.places[x]:
                hits.setdefault(i, []).append(p - q)
        out = []
        for i, diagonals in hits.items():
            size = len(self.words[i])
            slack = 2 + size // 8
            diagonals = sorted(set(diagonals))
            group = [diagonals[0], diagonals[0]]
            groups = [group]
            for x in diagonals[1:]:
                if x - group[1] <= slack and x - group[0] <= size:
                    group[1] = x
                else:
                    groups.append(group := [x, x])
            for low, high in groups:
                matched, first, end = align(words, self.words[i], low - slack, high + slack)
                if matched >= least * size:
                    out.append((i, matched, first, end))
        kept: list[tuple[int, int, int, int]] = []
        for one in sorted(out, key=lambda r: (-r[1], -r[1] / len(self.words[r[0]]), r[2], r[0])):
            if all(one[3] <= k[2] or one[2] >= k[3] for k in kept):
                kept.append(one)
        return sorted(kept, key=lambda r: r[2])


def prints(hashes: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Winnowed fingerprints of the texts: where they begin, and their hashes."""
    h = gram_hashes(hashes, GRAM)
    n = len(h) - SPAN + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    owner = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    at = np.where(h[1:] <= h[:-1], np.arange(1, n + 1), np.arange(n))
    at = np.unique(at[owner[:n] == owner[GRAM + SPAN - 2 :][:n]])
    return at, h[at]


def scan(docs: DataFrame, templates: dict[str, str] | None = None, least: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each place in a document where at least ``least`` of a template's words align.

    Returns doc_id, license_id, coverage (matched share of the template), matched_words, template_words, and the
    span in words (first_word, end_word) and characters (span_start, span_end). Where templates overlap, the one
    with more matched words stands, then the one with more coverage, then the earlier, then the name. Null, empty
    and clean texts give no row; repeated rows each give theirs; other columns are not read. The templates are a
    parameter that each task gets whole, so they are meant to be some hundreds of texts.
    """
    index = TemplateIndex(TEMPLATES if templates is None else templates)
    word = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = _Hashes()
        for batch in common.slices(batches, "text"):
            texts = common.binary_column(batch, "text")
            words, hashes, starts = _flat(texts, cache)
            at, h = prints(hashes, starts)
            place = np.minimum(np.searchsorted(index.hashes, h), max(0, len(index.hashes) - 1))
            kept = index.hashes[place] == h if len(index.hashes) else np.zeros(len(h), bool)
            at, h = at[kept], h[kept]
            owner = np.searchsorted(starts, at, side="right") - 1
            ids, rows = batch.column(0).to_pylist(), []
            for o in np.unique(owner).tolist():
                own = words[starts[o] : starts[o + 1]]
                here = owner == o
                found = index.scan(own, at[here] - starts[o], h[here], least)
                spans = [m.span() for m in word.finditer(texts[o].decode())] if found else []
                for i, matched, first, end in found:
                    size = len(index.words[i])
                    rows.append((ids[o], index.names[i], round(matched / size, 6), matched, size, first, end, spans[first][0], spans[end - 1][1]))
            kinds = [pa.int64(), pa.string(), pa.float64(), *[pa.int32()] * 6]
            columns = zip(*rows, strict=True) if rows else [[]] * 9
            yield pa.record_batch([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], [f.split()[0] for f in RESULT.split(", ")])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, RESULT)

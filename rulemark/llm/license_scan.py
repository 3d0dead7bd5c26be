"""Licence detection in files, inherited from the nearest licensed directory.

Every template, a short notice or a whole header, slides over the text as a
window of as many terms as it has itself, across line ends and within lines.
Windows that hold a hint at a licence are compared with the template by sparse
TF-IDF cosine: term weights are corpus document frequencies, counted over all
files; terms of no template weigh like a term never seen. SPDX identifiers stand
for themselves and score 1. A file's own licence is its best window's. A licence
file (its name says so, or licence windows hold most of its terms) licenses its
directory; files without a licence of their own inherit from the nearest
ancestor directory that has one, by joins of paths.

A short notice inside a header that matches as a whole (cosine ``WHOLE``) does not
count: what tells two licences apart may stand outside it.

Windows are bounded first by a norm that takes all their terms as distinct,
never more than the true one; only those that may reach the threshold get it.

Defined results: null and empty texts have no licence of their own; a text
shorter than a template is one window, if it has threshold squared of the
template's terms, as a part without repeats needs to reach the threshold; a null path lies in no directory and
inherits nothing; of several licence files in one directory the best score
counts, then the smaller path; ties go to an SPDX identifier, then to the first
template in the list; an SPDX expression is reported whole, its identifiers
without "-only", "-or-later" and "+"; rows are judged one by one.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rulemark.llm import textbatch as tb
from rulemark.llm.frames import cut, fresh

# Wording that several templates share.
_GNU = (
    ("GPL-2.0", "General", "2", "June 1991 Copyright (C) 1989, 1991"), ("GPL-3.0", "General", "3", "29 June 2007 Copyright (C) 2007"),
    ("LGPL-2.0", "Library General", "2", "June 1991 Copyright (C) 1991"), ("LGPL-2.1", "Lesser General", "2.1", "February 1999 Copyright (C) 1991, 1999"),
    ("LGPL-3.0", "Lesser General", "3", "29 June 2007 Copyright (C) 2007"), ("AGPL-3.0", "Affero General", "3", "19 November 2007 Copyright (C) 2007"),
)
_GRANT = "This program is free software; you can redistribute it and/or modify it under the terms of the GNU {kind} Public License "
_EITHER = _GRANT + "as published by the Free Software Foundation; either version {version} of the License, or (at your option) any later version. "
_GNU_WORDINGS = (
    "This work is licensed under the GNU {kind} Public License, version {version}.",
    _GRANT + "version {version} as published by the Free Software Foundation.",
    _EITHER,
    _EITHER + "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {kind} Public License for more details.",
    "GNU {kind} Public License Version {version}, {dated} Free Software Foundation, Inc.",
)
_BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. "  # noqa: E501
# Licence names and notices that stand for them.
TEMPLATES = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "This project is licensed under the terms of the MIT license."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.'),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License, version 3"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("LGPL-3.0", "This library is licensed under the GNU Lesser General Public License, version 3."),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, version 2.0."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("MIT", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.'),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'),
    ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/ TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION 1. Definitions."),
    ("BSD-2-Clause", _BSD + 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES ARE DISCLAIMED.'),
    ("BSD-3-Clause", _BSD + "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("Unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    ("Proprietary", "Copyright. All rights reserved. Unauthorized copying of this file is strictly prohibited."),
    *((name, wording.format(kind=kind, version=version, dated=dated)) for name, kind, version, dated in _GNU for wording in _GNU_WORDINGS),
)
#: A window of this cosine or more speaks for the shorter ones within it.
WHOLE = 0.9
HINT = re.compile(r"licen[cs]e|copyright|permission|redistribut|public domain|rights reserved|creative commons|spdx|mozilla|cc by", re.IGNORECASE | re.ASCII)
LICENSE_FILE = r"(?i)^(licen[cs]e|copying|unlicense|notice)([.\-_].*)?$"
SPDX = re.compile(r"SPDX-License-Identifier:[\x20\t]*(\(*[A-Z0-9][A-Z0-9.+\-]*\)*(?:[\x20\t]+(?:AND|OR|WITH)[\x20\t]+\(*[A-Z0-9][A-Z0-9.+\-]*\)*)*)", re.IGNORECASE | re.ASCII)
_SPDX_TAIL = re.compile(r"(?:-only|-or-later|\+)(?=$|[\s)])", re.IGNORECASE)
#: Terms of a text whose windows are compared at once: bounds memory.
PIECE = 1 << 15
_TERM = re.compile(r"[a-z]+|[0-9]+")
VOCABULARY = tuple(sorted({t for _, text in TEMPLATES for t in _TERM.findall(text.lower())}))
_DIGITS_OR_LETTERS = np.array([not (65 <= b <= 90 or 97 <= b <= 122 or 48 <= b <= 57) for b in range(256)])


def _window_norms(ids: np.ndarray, squares: np.ndarray, size: int) -> np.ndarray:
    """Sum over terms of (count x weight) squared, of every window of ``size`` terms."""
    n = len(ids)
    change = np.zeros(n + 1)
    order = np.argsort(ids, kind="stable")
    k = 1
    while k < min(n, size):
        # Equal terms k occurrences apart: both are in the windows that begin after i - size and up to j.
        j, i = order[:-k], order[k:]
        near = (ids[j] == ids[i]) & (i - j < size)
        if not near.any():
            break
        j, i = j[near], i[near]
        twice = 2 * squares[j]
        change += np.bincount(np.maximum(0, i - size + 1), twice, n + 1) - np.bincount(j + 1, twice, n + 1)
        k += 1
    total = np.append(0.0, np.cumsum(squares))
    return total[size:] - total[:-size] + np.cumsum(change)[: n - size + 1]


class Matcher:
    """Cosines of a text's windows to the templates under given document frequencies."""

    def __init__(self, df: dict[str, int], n_files: int, threshold: float):
        idf = lambda t: math.log((n_files + 1) / (df.get(t, 0) + 1)) + 1
        self.threshold, self.number = threshold, {t: k for k, t in enumerate(VOCABULARY)}
        self.weights = np.array([idf(t) for t in VOCABULARY])
        self.unseen = idf("")
        self.names, self.sizes = [name for name, _ in TEMPLATES], []
        self.products = np.zeros((len(TEMPLATES), len(VOCABULARY) + 1))
        self.norms = np.zeros(len(TEMPLATES))
        for k, (_, text) in enumerate(TEMPLATES):
            terms = _TERM.findall(text.lower())
            self.sizes.append(len(terms))
            for t, n in Counter(terms).items():
                at = self.number[t]
                self.products[k, at] = n * self.weights[at] ** 2
                self.norms[k] += (n * self.weights[at]) ** 2
        self.norms = np.sqrt(self.norms)

    def _windows(self, ids: np.ndarray, hints: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """(template, window size, starts, cosines) of the windows that reach the threshold."""
        n, known = len(ids), len(VOCABULARY)
        terms = np.minimum(ids, known)
        squares = np.append(self.weights, self.unseen)[terms] ** 2
        least = np.append(0.0, np.cumsum(squares))
        hinted = np.append(0, np.cumsum(hints))
        norms: dict[int, np.ndarray] = {}
        for k, size in enumerate(self.sizes):
            if n < self.threshold**2 * size:  # so short a part reaches the threshold by repeats of common words only
                continue
            size = min(size, n)
            total = np.append(0.0, np.cumsum(self.products[k][terms]))
            dots = total[size:] - total[:-size]
            floor = least[size:] - least[:-size]
            may = (dots >= (self.threshold - 1e-9) * self.norms[k] * np.sqrt(floor)) & (hinted[size:] > hinted[:-size])
            starts = np.flatnonzero(may)
            if not len(starts):
                continue
            if size not in norms:
                norms[size] = _window_norms(ids, squares, size)
            cosines = dots[starts] / (self.norms[k] * np.sqrt(norms[size][starts]))
            good = cosines >= self.threshold - 1e-12
            if good.any():
                yield k, size, starts[good], cosines[good]

    def judge(self, body: str | None) -> tuple[str | None, float, int, float]:
        """Best licence, its score, lines that licence windows touch, share of terms in them."""
        if not body or not HINT.search(body):
            return None, 0.0, 0, 0.0
        best, score = None, 0.0
        number, ids, hints, line_of, spdx_lines = dict(self.number), [], [], [], []
        for i, line in enumerate(body.split("\n")):
            terms = _TERM.findall(line.lower())
            if not terms:
                continue
            ids += [number.setdefault(t, len(number) + 1) for t in terms]  # one number between stands for all other terms
            line_of += [i] * len(terms)
            if HINT.search(line):
                flags = [bool(HINT.search(t)) for t in terms]
                hints += flags if any(flags) else [True] * len(terms)  # hints of two words
                if (m := SPDX.search(line)) and (name := _SPDX_TAIL.sub("", m[1].rstrip(".-"))):
                    spdx_lines.append(i)
                    if score < 1:
                        best, score = name, 1.0
            else:
                hints += [False] * len(terms)
        if not ids:
            return best, score, 0, 0.0
        every, flags, of = np.array(ids), np.array(hints), np.array(line_of)
        n, longest = len(every), max(self.sizes)
        edges = np.zeros(n + 1, np.int64)
        found: dict[int, tuple[float, int, int]] = {}  # a template's first best window
        for at in range(0, max(1, n - longest + 1), PIECE):
            to = min(n, at + PIECE + longest - 1)
            for k, size, starts, cosines in self._windows(every[at:to], flags[at:to]):
                np.add.at(edges, at + starts, 1)
                np.add.at(edges, at + starts + size, -1)
                top = int(cosines.argmax())
                if k not in found or cosines[top] > found[k][0] + 1e-9:
                    found[k] = (float(cosines[top]), at + int(starts[top]), size)
        whole = [w for w in found.values() if w[0] >= WHOLE]
        for k, (cosine, start, size) in sorted(found.items()):
            part = any(2 * size <= b and a <= start and start + size <= a + b for _, a, b in whole)
            if not part and cosine > score + 1e-9:
                best, score = self.names[k], cosine
        covered = np.cumsum(edges[:-1]) > 0
        covered |= np.isin(of, spdx_lines)
        return best, round(min(score, 1.0), 6), len(np.unique(of[covered])), round(float(covered.mean()), 6)


def _frequencies(texts: DataFrame) -> tuple[dict[str, int], int]:
    """Files holding each template term, and files."""
    raw = "\n".join(VOCABULARY).encode()
    data = np.frombuffer(raw, np.uint8)
    starts, ends, _ = tb.words(data, np.array([0, len(raw)]))
    hashes = tb.word_hashes(data, starts, ends)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = tb.TermTable(hashes)
        total, n = np.zeros(len(table), np.int64), 0
        for batch in batches:
            for part in tb.pieces(batch):
                d, offsets = tb.buffers(part.column("text"))
                d = tb.lower_ascii(d)
                s, e, of = tb.words(d, offsets, _DIGITS_OR_LETTERS)
                number = table.find(tb.word_hashes(d, s, e)) if len(s) else np.zeros(0, np.int32)
                there = number >= 0
                total += np.bincount(np.unique(of[there] * len(table) + number[there]) % len(table), minlength=len(table))
                n += part.num_rows
        yield pa.RecordBatch.from_arrays([pa.array(np.append(table.hashes.astype(np.int64), -1)), pa.array(np.append(total, n)), pa.array(np.append(np.zeros(len(table), bool), True))], names=["term", "n", "files"])

    counted = texts.select("text").mapInArrow(work, "term long, n long, files boolean").groupBy("term", "files").agg(F.sum("n").alias("n")).collect()  # a row a template term
    by_hash = {(r["term"], r["files"]): r["n"] for r in counted}
    return {t: by_hash.get((int(h), False), 0) for t, h in zip(VOCABULARY, hashes.astype(np.int64), strict=True)}, by_hash.get((-1, True), 0)


#: Columns that own_licenses adds.
OWN = ("own_license", "own_score", "n_license_lines", "license_share")


def own_licenses(files: DataFrame, text: str = "text", threshold: float = 0.6) -> DataFrame:
    """files with own_license, own_score, n_license_lines and license_share (of terms in licence windows)."""
    from pyspark.sql import types as T

    matcher = Matcher(*_frequencies(files.select(F.col(text).cast("string").alias("text"))), threshold)
    names = fresh(files, *OWN)
    kinds = (T.StringType(), T.DoubleType(), T.LongType(), T.DoubleType())
    schema = T.StructType([*files.schema.fields, *(T.StructField(n, k) for n, k in zip(names, kinds, strict=True))])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [matcher.judge(t) for t in batch.column(text).cast(pa.string()).to_pylist()]
            columns = [pa.array([f[k] for f in found], t) for k, t in enumerate((pa.string(), pa.float64(), pa.int64(), pa.float64()))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], names=[*batch.schema.names, *names])

    return files.mapInArrow(work, schema)


def directory(path: Column) -> Column:
    """The path without its last part; the top is the empty path."""
    return F.regexp_replace(path, "/?[^/]*$", "")


def scan(files: DataFrame, path: str = "path", text: str = "text", threshold: float = 0.6, keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` (all if None) with own_license, own_score, n_license_lines, license, licensed_by.

    license: the file's own or the inherited one; licensed_by: the directory that
    it comes from, null for an own licence.
    """
    keep = files.columns if keep is None else keep
    source = files.select(*dict.fromkeys([*keep, path, text]))
    names = fresh(source, *OWN)
    # Judged once, though grants, directories and files all read it.
    a = cut(own_licenses(source, text, threshold).drop(*({text} - set(keep))))
    own_license, own_score, n_lines, share = names
    folder, licence, by, depth, nearest_grant = fresh(a, "l_folder", "license", "licensed_by", "l_depth", "l_got")
    a = a.withColumn(folder, directory(F.col(path)))
    named = F.regexp_extract(path, "([^/]*)$", 1).rlike(LICENSE_FILE) | (F.col(share) >= 0.5)
    grants = a.where(F.col(own_license).isNotNull() & F.col(path).isNotNull() & named)
    grants = grants.groupBy(F.col(folder).alias(by)).agg(F.min_by(own_license, F.struct(-F.col(own_score), F.col(path))).alias(licence))
    # Directories are far fewer than files: each once, with all its ancestors.
    folders = a.where(F.col(folder).isNotNull()).select(folder).distinct()
    parts = F.split(folder, "/")
    ancestors = folders.withColumn(depth, F.explode(F.sequence(F.lit(0), F.size(parts))))
    ancestors = ancestors.withColumn(by, F.array_join(F.slice(parts, 1, F.col(depth)), "/"))
    nearest = ancestors.join(grants, by).groupBy(folder).agg(F.max_by(F.struct(by, licence), depth).alias(nearest_grant))
    a = a.join(nearest, folder, "left")
    own = F.col(own_license).isNotNull()
    got = {licence: F.when(own, F.col(own_license)).otherwise(F.col(nearest_grant)[licence]), by: F.when(~own, F.col(nearest_grant)[by])}
    return a.withColumns(got).select(*keep, own_license, own_score, n_lines, licence, by)

"""Licences of files: sparse TF-IDF cosine to templates, then inheritance from directories above."""

from __future__ import annotations

import pkgutil
import re
from collections.abc import Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitalspark.llm.common import (
    LOWER, blocks, map_arrow, prefix_hash, saved, span_hash, spans, utf8,
)

#: The notices that public licences ask for.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, "
                    "are permitted provided that the following conditions are met.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "MIT": "Released under the MIT License.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
}
_FREE = ("This {what} is free software{mark} you can redistribute it and/or modify it under the terms of the "
         "GNU {kind}General Public License as published by the Free Software Foundation{either} version {v} of the "
         "License, or (at your option) any later version. This {what} is distributed in the hope that it will be "
         "useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A "
         "PARTICULAR PURPOSE. See the GNU {kind}General Public License for more details.")
_PERMISSION = ("Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
               'associated documentation files (the "Software"), to deal in the Software without restriction, '
               "including without limitation the rights to use, copy, modify, merge, publish, distribute, "
               "sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is "
               "furnished to do so, subject to the following conditions:")


def _free(what: str, kind: str, v: str) -> list[str]:
    """The notice of a GNU licence, whole and its first sentence alone."""
    whole = _FREE.format(what=what, kind=kind, v=v, mark=";", either="; either")
    return [whole, whole.split(" This ")[0]]


#: Standard headers of source files, by licence.
HEADERS = {
    "AGPL-3.0": _free("program", "Affero ", "3"),
    "Apache-2.0": [
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in '
        "compliance with the License. You may obtain a copy of the License at "
        "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, "
        'software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR '
        "CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing "
        "permissions and limitations under the License."],
    "GPL-2.0": _free("program", "", "2"),
    "GPL-3.0": _free("program", "", "3"),
    "LGPL-2.1": _free("library", "Lesser ", "2.1"),
    "LGPL-3.0": _free("library", "Lesser ", "3"),
    "MIT": [_PERMISSION],
    "MPL-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL "
        "was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."],
}
#: Titles, which must be met nearly word for word.
TITLES = {
    "Apache-2.0": ["Apache License Version 2.0, January 2004", "Apache License Version 2.0"],
    "BSD-2-Clause": ["BSD 2-Clause License"],
    "BSD-3-Clause": ["BSD 3-Clause License"],
    "GPL-2.0": ["GNU GENERAL PUBLIC LICENSE Version 2, June 1991", "GNU General Public License version 2"],
    "GPL-3.0": ["GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007", "GNU General Public License version 3"],
    "LGPL-2.1": ["GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999"],
    "LGPL-3.0": ["GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007"],
    "MIT": ["MIT License", "The MIT License", "The MIT License (MIT)"],
    "MPL-2.0": ["Mozilla Public License Version 2.0"],
}
TITLE_THRESHOLD = 0.95
#: Licences whose whole text is in ``license_texts``.
FULL = ("Apache-2.0", "Artistic-1.0-Perl", "BSD-2-Clause", "BSD-3-Clause", "CC0-1.0", "GFDL-1.2", "GFDL-1.3",
        "GPL-1.0", "GPL-2.0", "GPL-3.0", "LGPL-2.0", "LGPL-2.1", "LGPL-3.0", "MIT", "MPL-1.1", "MPL-2.0")
SPDX = re.compile(rb"SPDX-License-Identifier:[ \t]*([^\r\n]*)", re.IGNORECASE)
#: Window starts whose counts are made at once.
WINDOWS = 256


def full_text(name: str) -> str:
    return pkgutil.get_data("vitalspark.llm", f"license_texts/{name}.txt").decode()


def all_templates() -> dict[str, list[str]]:
    """Notices, headers and whole texts by licence."""
    names = sorted({*TEMPLATES, *HEADERS, *FULL})
    return {n: [*([TEMPLATES[n]] if n in TEMPLATES else []), *HEADERS.get(n, []),
                *([full_text(n)] if n in FULL else [])] for n in names}


#: Bytes of terms: letters and digits, lower case, and everything beyond ASCII.
TERM_BYTES = np.array([48 <= b < 58 or 97 <= b < 123 or b >= 128 for b in range(256)])


def terms(data: np.ndarray, offsets: np.ndarray):
    """Hash and start of each term, and term bounds of the rows."""
    low = LOWER[data]
    starts, ends = spans(TERM_BYTES[low], offsets)
    return span_hash(prefix_hash(low), starts, ends), starts, np.searchsorted(starts, offsets)


class Matcher:
    """Cosines of term counts to the templates, by 1 + log of a count. Terms outside all templates
    (in windows, outside the template) count as distinct terms, so they only lengthen a vector."""

    def __init__(self, templates: Mapping[str, str | Sequence[str]], titles: Mapping[str, Sequence[str]]):
        texts = [(n, t, False) for n in sorted(templates)
                 for t in ([templates[n]] if isinstance(templates[n], str) else templates[n])]
        texts += [(n, t, True) for n in sorted(titles) for t in titles[n]]
        self.names = [n for n, _, _ in texts]
        self.title = np.array([x for _, _, x in texts])
        self.ids = {n.lower(): n for n in self.names}
        raw = [t.encode() for _, t, _ in texts]
        offsets = np.cumsum([0, *map(len, raw)])
        h, _, bounds = terms(np.frombuffer(b"".join(raw), np.uint8), offsets)
        self.vocabulary = np.unique(h)
        at = np.searchsorted(self.vocabulary, h)
        row = np.repeat(np.arange(len(raw)), np.diff(bounds))
        self.counts = np.zeros((len(raw), len(self.vocabulary)))
        np.add.at(self.counts, (row, at), 1)
        self.length = self.counts.sum(1).astype(np.int64)

    def weigh(self, weights: np.ndarray, threshold: float) -> None:
        self.weights = weights
        self.needed = np.where(self.title, max(threshold, TITLE_THRESHOLD), threshold)
        self.model = damped(self.counts) * weights[:-1]
        self.model /= np.linalg.norm(self.model, axis=1, keepdims=True)

    def index(self, h: np.ndarray) -> np.ndarray:
        """The place in the vocabulary, or its size for other terms."""
        at = np.minimum(np.searchsorted(self.vocabulary, h), len(self.vocabulary) - 1)
        return np.where(self.vocabulary[at] == h, at, len(self.vocabulary))

    def cosines(self, counts: np.ndarray) -> np.ndarray:
        """Cosines to all templates for rows of counts, whose last column holds other terms."""
        rows = damped(counts[:, :-1]) * self.weights[:-1]
        length = np.sqrt((rows ** 2).sum(1) + counts[:, -1] * self.weights[-1] ** 2)
        return rows @ self.model.T / np.maximum(length, 1e-12)[:, None]

    def candidates(self, counts: np.ndarray) -> list[tuple[int, int]]:
        """Rows and templates for which some part of the row may be near enough: a cosine is at
        most the length of the template's part in the terms that the row has."""
        share = (counts[:, :-1] > 0).astype(float) @ (self.model ** 2).T
        return list(zip(*(x.tolist() for x in np.nonzero(share >= self.needed ** 2 - 1e-9)), strict=True))

    def best_window(self, k: int, at: np.ndarray, line: np.ndarray) -> float:
        """Highest cosine to template ``k`` of lines in a row: from each line, that line alone and
        as many lines as first have the template's number of terms, and one line less."""
        first = np.append(np.flatnonzero(np.diff(line, prepend=-1)), len(at))
        n = len(first) - 1
        begin = np.arange(n)
        reach = np.minimum(np.searchsorted(first, first[:-1] + self.length[k]), n)
        pairs = np.unique(np.concatenate([begin * (n + 1) + end for end in (
            begin + 1, np.maximum(reach, begin + 1), np.maximum(reach - 1, begin + 1))]))
        lo, hi = pairs // (n + 1), pairs % (n + 1)
        model = np.append(self.model[k], 0)
        inside = model[at] > 0
        sums = lambda x: np.append(0, np.cumsum(x))[first]
        other = sums(np.where(inside, 0, self.weights[at] ** 2))
        most, share = sums(model[at] * self.weights[at]), sums(model[at] ** 2)
        need = self.needed[k] ** 2 - 1e-9
        dot, rest = (most[hi] - most[lo]) ** 2, other[hi] - other[lo]
        able = (share[hi] - share[lo] >= need) & (dot >= need * (dot + rest))
        lo, hi, rest = lo[able], hi[able], rest[able]
        own = np.flatnonzero(model[:-1] > 0)
        place = np.full(len(model), len(own))
        place[own] = np.arange(len(own))
        number = np.repeat(np.arange(n), np.diff(first))
        best = 0.0
        for j in range(0, len(lo), WINDOWS):
            a, b = lo[j:j + WINDOWS], hi[j:j + WINDOWS]
            low, high = int(a.min()), int(b.max())
            part = slice(first[low], first[high])
            count = np.zeros((high - low + 1, len(own) + 1), np.int32)
            count[1:] = np.bincount((number[part] - low) * (len(own) + 1) + place[at[part]],
                                    minlength=(high - low) * (len(own) + 1)).reshape(high - low, -1)
            np.cumsum(count, axis=0, out=count)
            rows = damped((count[b - low] - count[a - low])[:, :-1]) * self.weights[own]
            length = np.sqrt((rows ** 2).sum(1) + rest[j:j + WINDOWS])
            best = max(best, float((rows @ model[own] / np.maximum(length, 1e-12)).max()))
        return best

    def declared(self, data: bytes, offsets: np.ndarray) -> list[tuple[int, str]]:
        """Rows with an SPDX line and the first licence in it that is known."""
        out = []
        for m in SPDX.finditer(data):
            row = int(np.searchsorted(offsets, m.start(), "right")) - 1
            text = data[m.start(1):min(m.end(1), int(offsets[row + 1]))].decode("utf-8", "replace").lower()
            for word in re.findall(r"[a-z0-9.+-]+", text):
                name = self.ids.get(re.sub(r"(-only|-or-later|\+)$", "", word))
                if name:
                    out.append((row, name))
                    break
        return out


def damped(counts: np.ndarray) -> np.ndarray:
    return np.where(counts > 0, 1 + np.log(np.maximum(counts, 1)), 0)


def scan(files: DataFrame, templates: Mapping[str, str | Sequence[str]] | None = None,
         threshold: float = 0.75, file_threshold: float = 0.25) -> DataFrame:
    """One row per file: its ``path``, ``license``, ``score``, ``found_in`` and ``how``.

    Runs of lines as long as a template, and lines alone, are compared with the templates as headers,
    and so is the whole text; a line with an SPDX id is a header of score 1. Without ``templates``
    these are all notices, headers and whole texts here, and titles, which must be nearly word for
    word. A file takes the best match of at least ``threshold`` (``how`` is ``file`` or ``header``; of equal scores
    the whole text, then the first template). If its whole text reaches ``file_threshold``, so
    that little else is in it, it is a licence file, which holds for its directory and those
    below: a file without a match of its own takes the nearest one above (``inherited``, with the
    directory in ``found_in``); of several in a directory the best score, then the first path.
    Other files have nulls. Weights count the files each term is in, over all files.

    A null text is empty, a null path is the root's. Repeated rows are scanned each for itself.
    """
    matcher = Matcher(all_templates() if templates is None else templates, TITLES if templates is None else {})
    width = len(matcher.vocabulary) + 1
    texts = files.select(F.coalesce("path", F.lit("")).alias("path"), F.coalesce("text", F.lit("")).alias("text"))

    def presence(batches):
        total = np.zeros(width, np.int64)
        for batch in batches:
            data, offsets = utf8(batch.column("text"))
            for lo, hi in blocks(offsets):
                h, _, bounds = terms(data[offsets[lo]:offsets[hi]], offsets[lo:hi + 1] - offsets[lo])
                row = np.repeat(np.arange(hi - lo), np.diff(bounds))
                pairs = np.unique(row * width + matcher.index(h))
                total += np.bincount(pairs % width, minlength=width)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(width)), pa.array(total)], ["term", "n"])

    found = (texts.select("text").mapInArrow(presence, "term long, n long").groupBy("term")
             .agg(F.sum("n").alias("n")).collect())
    n_files = texts.count()
    holding = np.zeros(width)
    for r in found:
        holding[r.term] = r.n
    weights = np.log((n_files + 1) / (holding + 1)) + 1
    weights[-1] = np.log(n_files + 1) + 1

    matcher.weigh(weights, threshold)

    def match(batch: pa.RecordBatch):
        data, offsets = utf8(batch.column("text"))
        for lo, hi in blocks(offsets, rows=512):
            part, o = data[offsets[lo]:offsets[hi]], offsets[lo:hi + 1] - offsets[lo]
            h, starts, bounds = terms(part, o)
            n, at = hi - lo, matcher.index(h)
            row = np.repeat(np.arange(n), np.diff(bounds))
            breaks = np.cumsum(part == 10)
            line = breaks[starts] if len(starts) else starts
            whole = np.bincount(row * width + at, minlength=n * width).reshape(n, width)
            cosines = matcher.cosines(whole)
            holds = cosines.max(1) >= file_threshold
            cosines = np.where(cosines >= matcher.needed, cosines, 0)
            best = cosines.argmax(1)
            score = cosines[np.arange(n), best]
            best, how = [matcher.names[k] for k in best], np.full(n, "file", object)
            for r, k in matcher.candidates(whole):
                own = slice(bounds[r], bounds[r + 1])
                s = matcher.best_window(k, at[own], line[own])
                if s >= matcher.needed[k] and s > score[r] + 1e-12:
                    best[r], score[r], how[r] = matcher.names[k], s, "header"
            for r, name in matcher.declared(part.tobytes(), o):
                if score[r] < 1 - 1e-9:
                    best[r], score[r], how[r] = name, 1.0, "header"
            good = score >= threshold
            yield pa.RecordBatch.from_arrays(
                [batch.column("path")[lo:hi],
                 pa.array([k if g else None for k, g in zip(best, good, strict=True)], pa.string()),
                 pa.array(np.where(good, score, np.nan), mask=~good),
                 pa.array([x if g else None for x, g in zip(how, good, strict=True)], pa.string()),
                 pa.array(holds & good)],
                ["path", "license", "score", "how", "holds"])

    own = saved(map_arrow(texts, match, "path string, license string, score double, how string, holds boolean")
                .withColumn("dir", directory(F.col("path"))), "license-own")
    holders = (own.filter("holds").groupBy("dir")
               .agg(F.min(F.struct((-F.col("score")).alias("s"), "path", "license", "score")).alias("top"))
               .select(F.col("dir").alias("found_in"), F.col("top.license").alias("given"),
                       F.col("top.score").alias("given_score")))
    # Sorted, never broadcast: Spark sizes the pairs by the file of ``own`` and doesn't see that each directory
    # becomes one row per level, so it would collect them all in the driver.
    above = (own.select("dir").distinct()
             .withColumn("found_in", F.explode(ancestors(F.col("dir"))))
             .hint("merge").join(holders, "found_in"))
    nearest = (above.groupBy("dir").agg(F.max(F.struct(
        F.length("found_in").alias("depth"), "found_in", "given", "given_score")).alias("near"))
        .select("dir", "near.found_in", "near.given", "near.given_score"))
    joined = own.join(nearest, "dir", "left")
    mine = F.col("license").isNotNull()
    return joined.select(
        "path", F.coalesce("license", "given").alias("license"),
        F.when(mine, F.col("score")).otherwise(F.col("given_score")).alias("score"),
        F.when(mine, F.col("dir")).otherwise(F.col("found_in")).alias("found_in"),
        F.when(mine, F.col("how")).when(F.col("given").isNotNull(), "inherited").alias("how"))


def directory(path):
    """The part before the last slash; the root is empty."""
    return F.regexp_replace(path, r"/?[^/]*$", "")


def ancestors(dir_):
    """The directory and all above it, the root included."""
    parts = F.split(dir_, "/")
    return F.array_distinct(F.concat(F.array(F.lit("")), F.transform(
        F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/"))))

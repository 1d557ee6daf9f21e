"""License scans: TF-IDF cosine of lines and windows of words to licence templates, then inheritance from the nearest ancestor directory."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import _text as tx
from tessera.llm._store import carried, fresh, rows_of
from tessera.llm.decontaminate import _member

#: Least cosine of a line to a template.
LEAST_COSINE = 0.75
#: Templates of so many words are also compared with windows of as many words, across line ends.
LEAST_WINDOW = 8
_PARTS = 64

#: Notices by which works name their licence.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.'),
    ("MIT", "Released under the MIT License"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("GPL-3.0", "either version 3 of the License, or (at your option) any later version"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2"),
    ("GPL-2.0", "either version 2 of the License, or (at your option) any later version"),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3"),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3"),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0"),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0"),
    ("CC0-1.0", "Released under CC0 1.0 Universal public domain dedication"),
    ("Unlicense", "This is free and unencumbered software released into the public domain"),
    ("All-rights-reserved", "All rights reserved"),
    # headers of files, and of whole licences the text or, of long ones, its opening
    ("GPL-3.0", 'This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.'),
    ("GPL-2.0", 'This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 2 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.'),
    ("AGPL-3.0", 'This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Affero General Public License for more details.'),
    ("LGPL-3.0", 'This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 3 of the License, or (at your option) any later version. This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details.'),
    ("LGPL-2.1", 'This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version. This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details.'),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'),
    ("Apache-2.0", 'Apache License Version 2.0, January 2004 http://www.apache.org/licenses/ TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION'),
    ("MIT", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.'),
    ("BSD-3-Clause", 'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.'),
    ("BSD-2-Clause", 'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.'),
    ("GPL-3.0", 'GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007 Copyright (C) 2007 Free Software Foundation, Inc. Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed. Preamble The GNU General Public License is a free, copyleft license for software and other kinds of works.'),
    ("GPL-2.0", 'GNU GENERAL PUBLIC LICENSE Version 2, June 1991 Copyright (C) 1989, 1991 Free Software Foundation, Inc. Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed. Preamble The licenses for most software are designed to take away your freedom to share and change it.'),
    ("LGPL-3.0", 'GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007 Copyright (C) 2007 Free Software Foundation, Inc. Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed.'),
    ("LGPL-2.1", 'GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999 Copyright (C) 1991, 1999 Free Software Foundation, Inc. Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed.'),
    ("AGPL-3.0", 'GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007 Copyright (C) 2007 Free Software Foundation, Inc. Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed.'),
    ("MPL-2.0", 'This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.'),
    ("ISC", 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.'),
    ("Unlicense", 'This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.'),
)
#: Beginnings (lower case) of the names of files whose licence holds for their directory, up to a dot, a dash or the end.
LICENCE_FILES = ("license", "licence", "copying", "notice", "unlicense")
#: Notices that grant nothing: they're an own result only beside no licence, and no directory inherits them.
NO_LICENCE = ("All-rights-reserved",)


def _words(texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    data, offsets = tx.text_buffer(pa.array(list(texts), pa.large_string()))
    starts, ends, first = tx.spans(data, offsets, tx.ALNUM)
    return tx.hashes(data, starts, ends), first


@dataclass
class Scanner:
    """Templates as unit vectors over their own words; a word of no template weighs `other`."""

    names: list[str]
    vocabulary: np.ndarray
    idf: np.ndarray
    other: float
    entry_from: np.ndarray  #: where each word's entries begin: its templates and its weights in them
    entry_template: np.ndarray
    entry_weight: np.ndarray
    least: float
    sizes: np.ndarray  #: words of each template

    @classmethod
    def of(cls, templates: Sequence[tuple[str, str]], vocabulary: np.ndarray, n: int, df: np.ndarray, least: float) -> Scanner:
        idf = np.log((1 + n) / (1 + df)) + 1
        words, first = _words([t for _, t in templates])
        pairs, times = np.unique(np.searchsorted(vocabulary, words) * len(templates) + tx.owners(first), return_counts=True)
        word, template = pairs // len(templates), pairs % len(templates)
        weight = times * idf[word]
        weight /= np.sqrt(np.bincount(template, weight**2, len(templates)))[template]
        return cls([x for x, _ in templates], vocabulary, idf, float(np.log(1 + n) + 1), np.searchsorted(word, np.arange(len(vocabulary) + 1)), template, weight, least, np.diff(first))

    @cached_property
    def behind(self) -> np.ndarray:
        """1 for notices that are no licence: they stand behind all that are."""
        return np.isin(self.names, NO_LICENCE).astype(float)

    def weights_in(self, t: int) -> np.ndarray:
        """The weight of each word of the vocabulary in a template."""
        out, mine = np.zeros(len(self.vocabulary)), np.flatnonzero(self.entry_template == t)
        out[np.searchsorted(self.entry_from, mine, "right") - 1] = self.entry_weight[mine]
        return out

    def best(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each text the template that some line or window of words is nearest to (-1: none at the least cosine), that
        cosine and the number of its first line; of equal cosines lines before windows, the first template of the first one."""
        n = len(offsets) - 1
        breaks = np.flatnonzero(data == 10) + 1
        lines = np.unique(np.concatenate([offsets, breaks]))
        starts, ends, first = tx.spans(data, lines, tx.ALNUM)
        words = tx.hashes(data, starts, ends)
        line = tx.owners(first)
        inside = _member(words, self.vocabulary)
        number = np.searchsorted(self.vocabulary, words[inside])
        n_lines = len(lines) - 1
        near = np.bincount(line[inside], self.idf[number], n_lines) ** 2 if len(number) else np.zeros(n_lines)
        far = np.bincount(line[~inside], minlength=n_lines)[:n_lines] * self.other**2
        # a cosine is at most the share of a line's length that lies in the templates' words
        some = (near > 0) & (near >= self.least**2 * (near + far) * (1 - 1e-9))
        out, score, where, rank = np.full(n, -1), np.zeros(n), np.zeros(n, np.int64), np.full(n, -2.0)
        picked = some[line[inside]]
        if picked.any():
            row = np.cumsum(some) - 1
            blocks = [(a, a + 4096) for a in range(0, int(some.sum()), 4096)]
            rows, numbers = row[line[inside][picked]], number[picked]
            which = np.flatnonzero(some)
            doc = np.searchsorted(offsets, lines[which], "right") - 1
            begins = np.searchsorted(lines, offsets[:-1])
            for a, b in blocks:
                b = min(b, len(which))
                mine = (rows >= a) & (rows < b)
                # sparse rows: of each line its different words and their counts, against the templates' sparse columns
                pairs, times = np.unique((rows[mine] - a) * len(self.vocabulary) + numbers[mine], return_counts=True)
                line_of, word = pairs // len(self.vocabulary), pairs % len(self.vocabulary)
                weight = times * self.idf[word]
                length = np.sqrt(np.bincount(line_of, weight**2, b - a) + far[which[a:b]])
                entries = self.entry_from[word + 1] - self.entry_from[word]
                spread = np.repeat(np.arange(len(word)), entries)
                at = np.arange(len(spread)) - np.repeat(np.cumsum(entries) - entries, entries) + self.entry_from[word][spread]
                dot = np.bincount(line_of[spread] * len(self.names) + self.entry_template[at], weight[spread] * self.entry_weight[at], (b - a) * len(self.names))
                cosine = np.round(dot.reshape(b - a, len(self.names)) / length[:, None], 12)
                top = cosine.argmax(1)
                for k in np.flatnonzero(cosine.max(1) >= self.least):
                    d, s = doc[a + k], cosine[k, top[k]]
                    if s - self.behind[top[k]] > rank[d]:
                        out[d], score[d], where[d], rank[d] = top[k], s, which[a + k] - begins[d], s - self.behind[top[k]]
        self._windows(words, inside, line, lines, offsets, out, score, where, rank)
        return out, score, where

    def _windows(self, words: np.ndarray, inside: np.ndarray, line: np.ndarray, lines: np.ndarray, offsets: np.ndarray, out: np.ndarray, score: np.ndarray, where: np.ndarray, rank: np.ndarray) -> None:
        """Compares every window of as many words as a template has, from each word to the text's end at most."""
        if not len(words):
            return
        k = len(self.vocabulary)
        number = np.full(len(words), k)
        number[inside] = np.searchsorted(self.vocabulary, words[inside])
        doc = np.searchsorted(offsets, lines[line], "right") - 1
        begins = np.searchsorted(lines, offsets[:-1])
        stop = np.searchsorted(doc, doc, "right")
        squares = np.append(self.idf**2, self.other**2)
        # counts are at least their square roots: this is the least length that a window can have
        length = np.concatenate([[0], np.cumsum(squares[number])])
        at = np.arange(len(words))
        for t in np.flatnonzero(self.sizes >= LEAST_WINDOW):
            own = self.weights_in(t)
            weight = np.append(self.idf * own, 0.0)
            dot = np.concatenate([[0], np.cumsum(weight[number])])
            end = np.minimum(at + self.sizes[t], stop)
            product = dot[end] - dot[:-1]
            found = np.flatnonzero((weight[number] > 0) & (product * (1 + 1e-6) >= self.least * np.sqrt(length[end] - length[:-1])) & (product > 0))
            for i in found:
                d = doc[i]
                tf = np.bincount(number[i : end[i]], minlength=k + 1)
                norm = np.sqrt(((tf[:k] * self.idf) ** 2).sum() + tf[k] * self.other**2)
                s = np.round((tf[:k] * self.idf) @ own / norm, 12)
                if s >= self.least and s - self.behind[t] > rank[d]:
                    out[d], score[d], where[d], rank[d] = t, s, line[i] - begins[d], s - self.behind[t]


def _frequencies(files: DataFrame, vocabulary: np.ndarray, text_col: str) -> tuple[int, np.ndarray]:
    """How many texts there are, and how many have each of the templates' words; tasks send a count for each word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n = np.zeros(len(vocabulary), np.int64), 0
        for batch in batches:
            n += batch.num_rows
            for _, _, data, offsets in tx.chunks(rows_of(batch, "t")):
                starts, ends, first = tx.spans(data, offsets, tx.ALNUM)
                words = tx.hashes(data, starts, ends)
                inside = _member(words, vocabulary)
                pairs = np.unique(tx.owners(first)[inside] * len(vocabulary) + np.searchsorted(vocabulary, words[inside]))
                df += np.bincount(pairs % max(1, len(vocabulary)), minlength=len(vocabulary))
        yield pa.RecordBatch.from_arrays([pa.array([-1, *range(len(vocabulary))], pa.int32()), pa.array([n, *df], pa.int64())], ["word", "n"])

    counts = files.select(F.col(text_col).cast("string").alias("t")).mapInArrow(run, "word int, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    found = {r.word: r.n for r in counts}
    return found.get(-1, 0), np.array([found.get(k, 0) for k in range(len(vocabulary))], float)


def scan(files: DataFrame, *, templates: Sequence[tuple[str, str]] = TEMPLATES, least: float = LEAST_COSINE, text_col: str = "text", columns: list[str] | None = None) -> DataFrame:
    """The given columns (all, if none are given) of every row, own_license (null if no line comes near a template),
    own_score, the cosine (0 then), and own_line, its line's number from 0 (null then).

    Every line of the whole text is compared, and every window of as many words as a template of LEAST_WINDOW words or more
    has, so that notices wrapped into comments or standing in long lines are found. Document frequencies of the templates' words are counted over all rows;
    other words weigh as words that no text has. Null and empty texts have no licence; of ties the first line and template
    stay; a licence goes before a notice that is none; columns of these names are replaced.
    """
    if not templates:
        raise ValueError("no templates")
    names = carried(files, columns, "own_license", "own_score", "own_line")
    vocabulary = np.unique(_words([t for _, t in templates])[0])
    n, df = _frequencies(files, vocabulary, text_col)
    shared = files.sparkSession.sparkContext.broadcast(Scanner.of(templates, vocabulary, n, df, least))
    schema = files.select(*names).schema.add("own_license", "string").add("own_score", "double").add("own_line", "long")
    reads = text_col if text_col in names else fresh(files, "text read")[0]
    source = files.select(*names, *([] if text_col in names else [F.col(text_col).cast("string").alias(reads)]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = shared.value
        for batch in batches:
            parts = [scanner.best(data, offsets) for _, _, data, offsets in tx.chunks(rows_of(batch, reads))]
            top, score, line = (np.concatenate(x) if parts else np.zeros(0) for x in (zip(*parts, strict=True) if parts else ([], [], [])))
            found = [None if k < 0 else scanner.names[int(k)] for k in top]
            lines = [None if k < 0 else int(x) for k, x in zip(top, line, strict=True)]
            yield pa.RecordBatch.from_arrays([*(rows_of(batch, c) for c in names), pa.array(found, pa.string()), pa.array(score, pa.float64()), pa.array(lines, pa.int64())], [*names, "own_license", "own_score", "own_line"])

    return source.mapInArrow(run, schema)


def _directory(path: F.Column) -> F.Column:
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


def inherit(scanned: DataFrame, *, path_col: str = "path") -> DataFrame:
    """The rows of scan() with license, license_from (`own`, `directory` or null) and license_dir, the directory that a
    file without own licence has it from: the nearest of its path's directories that holds a licence file with one.

    A directory with several licence files takes that of the highest cosine, then the least path. Directories are joined,
    not files: each different directory has a row for each of its ancestors. Null paths inherit nothing.
    """
    files = scanned.drop("license", "license_from", "license_dir")
    dir_, up_, license_ = fresh(files, "dir", "up", "of_dir")
    named = F.lower(F.regexp_extract(F.col(path_col), r"([^/]*)$", 1)).rlike(f"^({'|'.join(LICENCE_FILES)})([.-]|$)")
    legal = files.where(named & F.col("own_license").isNotNull() & ~F.col("own_license").isin(*NO_LICENCE) & F.col(path_col).isNotNull())
    best = F.min(F.struct((-F.col("own_score")).alias("s"), F.col(path_col).alias("p"), F.col("own_license").alias("l")))
    held = legal.groupBy(_directory(F.col(path_col)).alias("up")).agg(best.alias("b")).select("up", F.col("b.l").alias("license"))
    folders = files.where(F.col(path_col).isNotNull()).select(_directory(F.col(path_col)).alias("dir")).distinct()
    parts = F.when(F.col("dir") == "", F.array().cast("array<string>")).otherwise(F.split("dir", "/"))
    ups = folders.select("dir", F.explode(F.transform(F.sequence(F.lit(0), F.size(parts)), lambda n: F.struct(n.alias("depth"), F.array_join(F.slice(parts, F.lit(1), n), "/").alias("up")))).alias("x")).select("dir", "x.depth", "x.up")
    # many directories share an ancestor: each ancestor is dealt into parts, and the few that hold a licence repeated for them
    ups = ups.withColumn("part", F.pmod(F.xxhash64("dir"), F.lit(_PARTS)))
    held = held.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(_PARTS - 1))))
    nearest = ups.join(held, ["up", "part"]).groupBy("dir").agg(F.max(F.struct("depth", "up", "license")).alias("b"))
    nearest = nearest.select(F.col("dir").alias(dir_), F.col("b.up").alias(up_), F.col("b.license").alias(license_))
    joined = files.join(nearest, _directory(F.col(path_col)) == F.col(dir_), "left")
    own = F.col("own_license").isNotNull()
    return joined.withColumns({
        "license": F.coalesce("own_license", license_),
        "license_from": F.when(own, F.lit("own")).when(F.col(license_).isNotNull(), F.lit("directory")),
        "license_dir": F.when(~own, F.col(up_)),
    }).drop(dir_, up_, license_)

"""Licence scans: stretches of normalised text against licence templates by the Dice coefficient of word bigrams.

Words are lower-cased runs of letters and digits. A template with b distinct bigrams can only reach a
coefficient t with a stretch of t/(2-t) * b to (2-t)/t * b bigrams: templates too large for a whole
document are pruned by that bound, and so are those of whose bigrams the document has too few.
For the rest, stretches of any size within the bounds are scored on sets. Only those are candidates that begin and end on a bigram of the
template that stands in them once up to there: any other has a shorter one inside with at least its score. A start is left out
where the bigrams in common that it needs come after its own bigram is repeated, or after too many others.

Cases: null and empty texts, and texts of one word, match nothing; a text of any length is scanned whole; a template is
reported at every place that holds it; of stretches that overlap, of one template or of several, the one with the best score is reported, then
that of the longest template, the first template, the shortest and the first stretch, then widened by bigrams of the template that it has already, up to the template's length; repeated rows each give their rows; an empty table gives no rows; columns other than the named ones are not read.
"""

from __future__ import annotations

import math
import re
from bisect import bisect
from collections.abc import Iterator
from dataclasses import dataclass
from importlib import resources

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cloudloom.llm.common import pieces, tables
from cloudloom.llm.decontaminate import grams, word_hashes

LEAST = 0.8

#: Notices and short texts of public licences, by SPDX identifier.
TEMPLATES: list[tuple[str, str]] = [
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("Unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    ("LGPL-2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("LGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("AGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/"),
]


def whole_texts() -> list[tuple[str, str]]:
    """The whole texts of the shorter public licences, kept as files named by SPDX identifier."""
    folder = resources.files("cloudloom.llm") / "licence_texts"
    return [(f.name.removesuffix(".txt"), f.read_text(encoding="utf-8")) for f in sorted(folder.iterdir(), key=lambda f: f.name) if f.name.endswith(".txt")]


@dataclass
class Scanner:
    names: list[str]
    sets: list[np.ndarray]
    lengths: list[int]
    least: float

    @classmethod
    def of(cls, templates: list[tuple[str, str]], least: float) -> Scanner:
        kept = [(name, g) for name, text in templates if len(g := grams(word_hashes(text), 2))]
        return cls([n for n, _ in kept], [np.unique(g) for _, g in kept], [len(g) for _, g in kept], least)

    def __post_init__(self) -> None:
        self.known = np.unique(np.concatenate(self.sets)) if self.sets else np.empty(0, np.uint64)
        self.needs = [math.ceil(self.least / (2 - self.least) * len(s) - 1e-9) for s in self.sets]  # fewer bigrams in common can't reach the threshold at any size

    def scan(self, text: str | None) -> list[tuple[str, int, float, int, int]]:
        """(licence, template, dice, first word, words) of the stretches of the text that reach ``least`` with a template; of overlapping ones the best."""
        g = grams(word_hashes(text), 2)
        if not len(g) or not len(self.known):
            return []
        at = np.searchsorted(self.known, g)
        at[at == len(self.known)] = 0
        met = np.flatnonzero(self.known[at] == g)
        if len(met) < min(self.needs):
            return []
        _, number = np.unique(g, return_inverse=True)
        order = np.argsort(number, kind="stable")
        same = number[order[1:]] == number[order[:-1]]
        before, after = np.full(len(g), -1), np.full(len(g), len(g))  # where the same bigram stands last and next
        before[order[1:][same]] = order[:-1][same]
        after[order[:-1][same]] = order[1:][same]
        alone = np.cumsum((before < 0) & (after == len(g)))
        found: list[tuple[float, int, int, int, int]] = []
        for k, (own, need) in enumerate(zip(self.sets, self.needs, strict=True)):
            if len(met) < need:
                continue
            marks = met[np.isin(g[met], own)]
            if len(marks) < need:
                continue
            first, reach = marks[: len(marks) - need + 1], marks[need - 1 :]
            most = int((2 - self.least) / self.least * len(own) + 1e-9)  # more distinct bigrams can't reach the threshold
            marked = np.zeros(len(g), bool)
            marked[marks] = True
            for i in first[(reach < after[first]) & (alone[reach] - alone[first] <= most)].tolist():
                found += [(-dice, -self.lengths[k], k, end - i, i) for dice, end in self.ends(marked, before, i, int(after[i]), len(own), most)]
        kept: list[tuple[str, int, float, int, int]] = []
        starts: list[int] = []
        for dice, _, k, width, i in sorted(found):
            place = bisect(starts, i)
            if (place and kept[place - 1][3] + kept[place - 1][4] > i) or (place < len(kept) and i + width + 1 > starts[place]):
                continue
            starts.insert(place, i)
            kept.insert(place, (self.names[k], k, -dice, i, width + 1))
        return [self.widened(g, m, kept[n - 1][3] + kept[n - 1][4] if n else 0, kept[n + 1][3] - 1 if n + 1 < len(kept) else len(g)) for n, m in enumerate(kept)]

    def widened(self, g: np.ndarray, match: tuple[str, int, float, int, int], low: int, high: int) -> tuple[str, int, float, int, int]:
        """``match`` with the template's bigrams beside it that are in it already, up to the template's length and within ``low`` and ``high``: the score stays."""
        name, k, dice, i, words = match
        end = i + words - 1
        if end - i < self.lengths[k]:
            own = set(np.intersect1d(g[i:end], self.sets[k]).tolist())
            while end < high and end - i < self.lengths[k] and int(g[end]) in own:
                end += 1
            while i > low and end - i < self.lengths[k] and int(g[i - 1]) in own:
                i -= 1
        return name, k, dice, i, end - i + 1

    def ends(self, marked: np.ndarray, before: np.ndarray, i: int, stop: int, size: int, most: int) -> list[tuple[float, int]]:
        """(dice, end) of the stretches of bigrams from ``i`` that reach the threshold, end on a bigram of the template that is new in them, and don't reach ``stop``."""
        span = 2 * most
        while True:
            new = before[i : min(stop, i + span)] < i
            distinct = np.cumsum(new)
            if distinct[-1] > most or i + span >= stop:
                break
            span *= 4
        shared = np.cumsum(new & marked[i : i + len(new)])
        dice = 2 * shared / (distinct + size)
        at = np.flatnonzero((dice >= self.least) & new & marked[i : i + len(new)])
        return list(zip(dice[at].tolist(), (at + i + 1).tolist(), strict=True))


def licence_matches(text: Column, templates: list[tuple[str, str]] | None = None, least: float = LEAST) -> Column:
    """An array of (license, template, dice, first_word, n_words) of ``text``; without ``templates`` by ``TEMPLATES`` and then ``whole_texts``."""
    chosen = TEMPLATES + whole_texts() if templates is None else templates

    @F.arrow_udf("array<struct<license:string,template:int,dice:double,first_word:long,n_words:long>>")
    def matched(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        scanner = Scanner.of(chosen, least)
        names = ("license", "template", "dice", "first_word", "n_words")
        kind = pa.list_(pa.struct(list(zip(names, (pa.string(), pa.int32(), pa.float64(), pa.int64(), pa.int64()), strict=True))))
        with tables("licenses"):
            for batch in batches:
                yield pa.array([[dict(zip(names, m, strict=True)) for m in scanner.scan(t)] for _, texts in pieces(batch) for t in texts], kind)

    return matched(text.cast("string"))


def scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: list[tuple[str, str]] | None = None, least: float = LEAST) -> DataFrame:
    """(id, license, template, dice, first_word, n_words) of every template that a document holds. No shuffle."""
    hits = df.select(F.col(id_col), licence_matches(F.col(text_col), templates, least).alias("__hits"))
    # no filter before: it would be pushed down and run the matching twice
    return hits.select(id_col, F.explode("__hits").alias("__hit")).select(id_col, "__hit.*")

"""License scans: notices by TF-IDF cosine, then inheritance from directories.

A notice begins at a line with a cue (licence, copyright, SPDX, released, rights,
permission) and takes in lines after it, blank ones passed over, as long as they
bring it closer to a template; it ends where it was closest, once ``PATIENCE``
lines in a row have not. Closeness is the cosine of sparse TF-IDF vectors over
word and word-pair terms; weights come from the templates, numbers count as one
term but a version is read from the match. The best template at ``THRESHOLD`` or
more names the notice; among equal cosines the longer template, then their order.
A file takes its best notice, the earliest among equals. That all rights are
reserved names a file only if no other notice does, as most licences say so too.

A file named LICENSE, LICENCE, COPYING, NOTICE or UNLICENSE (any ending) licenses
its directory. A file without a notice of its own inherits from the nearest
ancestor directory that has a licence: directories, made distinct, are joined to
their ancestors by path, so each file is joined once.

Null and empty texts have no notice; a null path lies in no directory. Repeated
rows get equal results. Texts are read whole, by lines. Several licence files in
one directory: the best match, then the least name and version. Only the named columns are read.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

THRESHOLD = 0.6
PATIENCE = 3

# Licence notices, and the openings or the whole text of licence files, in their usual wording.
TEMPLATES = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "This project is licensed under the terms of the MIT license."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction"),
    (
        "MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without "
        "restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the "
        "Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the "
        "Software. THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR "
        "PURPOSE AND NONINFRINGEMENT.",
    ),
    ("Apache", "Licensed under the Apache License, Version 2.0."),
    ("Apache", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("Apache", "SPDX-License-Identifier: Apache-2.0"),
    ("Apache", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/ TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION"),
    ("GPL", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("GPL", "SPDX-License-Identifier: GPL-3.0-or-later"),
    ("GPL", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("LGPL", "This library is licensed under the GNU Lesser General Public License, version 2.1."),
    ("LGPL", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"),
    ("LGPL", "SPDX-License-Identifier: LGPL-2.1-or-later"),
    ("LGPL", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("LGPL", "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999"),
    ("AGPL", "Licensed under the GNU Affero General Public License, version 3."),
    ("AGPL", "SPDX-License-Identifier: AGPL-3.0-or-later"),
    ("AGPL", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007"),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    (
        "BSD",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must "
        "retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of "
        "conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    ),
    ("BSD", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("BSD", "SPDX-License-Identifier: BSD-3-Clause"),
    (
        "ISC",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission "
        "notice appear in all copies.",
    ),
    ("ISC", "Released under the ISC License."),
    ("ISC", "SPDX-License-Identifier: ISC"),
    ("MPL", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("MPL", "Mozilla Public License Version 2.0"),
    ("MPL", "SPDX-License-Identifier: MPL-2.0"),
    ("CC-BY-NC", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-SA", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-SA", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY", "Licensed under CC BY 4.0."),
    ("CC-BY", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC0", "To the extent possible under law, the author has waived all copyright and related rights to this work, CC0 1.0 Universal."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("Proprietary", "All rights reserved."),
    ("Proprietary", "Copyright (c) 2020 The Authors. All rights reserved."),
)
WEAK = "Proprietary"
# What a notice's first line holds.
CUES = (
    "licens", "licenc", "copyright", "spdx", "released under", "released into", "rights reserved", "unencumbered", "redistribution and use", "permission is hereby",
    "permission to use", "waived all",
)
_WORD = re.compile(r"[a-z]+|[0-9]+(?:\.[0-9]+)*", re.I)
_VERSION = re.compile(r"\bv(?:ersion\b|\.|(?=[0-9]))\s*([0-9]+(?:\.[0-9]+)*)", re.I)
_NUMBER = re.compile(r"[0-9]+(?:\.[0-9]+)+")


def has_cue(text: str) -> bool:
    low = text.lower()
    return any(c in low for c in CUES)


def words_of(text: str) -> list[str]:
    return ["0" if w[0].isdigit() else w.lower() for w in _WORD.findall(text)]


def terms(words: list[str]) -> Counter:
    return Counter(words) + Counter(f"{a} {b}" for a, b in zip(words, words[1:]))


class Templates:
    """Unit TF-IDF vectors of the templates, as postings by term."""

    def __init__(self, templates=TEMPLATES):
        counts = [terms(words_of(t)) for _, t in templates]
        n, df = len(counts), Counter(k for c in counts for k in c)
        #: A term that no template has weighs as the rarest one: it can only lower a cosine.
        self.other = math.log(1 + n) + 1
        self.idf = {k: math.log((1 + n) / (1 + d)) + 1 for k, d in df.items()}
        self.names = [name for name, _ in templates]
        self.size = [sum(c.values()) for c in counts]
        self.postings: dict[str, list[tuple[int, float]]] = {}
        for at, c in enumerate(counts):
            norm = math.sqrt(sum((v * self.idf[k]) ** 2 for k, v in c.items()))
            for k, v in c.items():
                self.postings.setdefault(k, []).append((at, v * self.idf[k] / norm))


class Window:
    """A growing run of lines, and its cosine to each template."""

    def __init__(self, templates: Templates):
        self.of, self.dots, self.norm = templates, [0.0] * len(templates.names), 0.0
        self.counts: dict[str, int] = {}
        self.last: str | None = None

    def add(self, line: str) -> bool:
        """Whether the line had a word."""
        words = words_of(line)
        if not words:
            return False
        joined = words if self.last is None else [self.last, *words]
        for k in [*words, *(f"{a} {b}" for a, b in zip(joined, joined[1:]))]:
            w = self.of.idf.get(k, self.of.other)
            had = self.counts.get(k, 0)
            self.counts[k] = had + 1
            self.norm += w * w * (2 * had + 1)
            for at, x in self.of.postings.get(k, ()):
                self.dots[at] += w * x
        self.last = words[-1]
        return True

    def best(self) -> tuple[float, int]:
        """Cosine and number of the closest template; ties: the longer, then the first."""
        root, size = math.sqrt(self.norm) or 1.0, self.of.size
        return max(((round(d / root, 9), size[k], -k) for k, d in enumerate(self.dots)), default=(0.0, 0, 0))[::2]


def notices(text: str, templates: Templates, threshold: float = THRESHOLD) -> list[tuple[str, str, float, int, str]]:
    """``(licence, version, cosine, line, line's text)`` of each notice, from the top."""
    if not text or not has_cue(text):
        return []
    lines, out, at = text.split("\n"), [], 0
    while at < len(lines):
        if not has_cue(lines[at]):
            at += 1
            continue
        window, score, top, used, idle = Window(templates), -1.0, 0, 1, 0
        for n in range(at, len(lines)):
            if not window.add(lines[n]):
                continue
            now, which = window.best()
            if now > score:
                score, top, used, idle = now, -which, n + 1 - at, 0
            else:
                idle += 1
                if idle == PATIENCE:
                    break
        if score >= threshold:
            run = " ".join(lines[at : at + used])
            version = _VERSION.search(run)
            number = version[1] if version else next(iter(_NUMBER.findall(run)), "")
            out.append((templates.names[top], number, score, at, lines[at]))
            at += used
        else:
            at += 1
    return out


def chosen(found: list[tuple[str, str, float, int, str]]) -> tuple[str | None, str | None, float | None]:
    """Licence, version and cosine of the notice that names the file."""
    top = max(found, key=lambda x: (x[0] != WEAK, x[2], -x[3]), default=(None, None, None))
    return top[:3]


def scanned(files: DataFrame, key: str, path: str, text: str, threshold: float = THRESHOLD) -> DataFrame:
    """``key, path, own, version, similarity, n_notices`` of each file; ``own`` null without a notice."""
    rows = files.select(F.col(key).alias("key"), F.col(path).alias("path"), F.col(text).alias("text"))
    kind = rows.schema["key"].dataType.simpleString()

    def run(batches):
        templates = Templates()
        for batch in batches:
            out = []
            for t in batch.column(2):
                found = notices(t.as_py(), templates, threshold)
                out.append((*chosen(found), len(found)))
            own, version, score, n = zip(*out) if out else ((),) * 4
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(own, pa.string()), pa.array(version, pa.string()), pa.array(score, pa.float64()), pa.array(n, pa.int64())],
                ["key", "path", "own", "version", "similarity", "n_notices"],
            )

    return rows.mapInArrow(run, f"key {kind}, path string, own string, version string, similarity double, n_notices long")


def directory_of(path: Column) -> Column:
    """All before the last slash; empty for a file at the top."""
    return F.regexp_replace(path, r"/?[^/]*$", "")


_LICENCE_FILE = r"(?i)(^|/)(licen[cs]e|copying|notice|unlicense)([._-][^/]*)?$"


def ancestors(directory: Column) -> Column:
    """The directory and those above it, nearest first, the top (empty) last: array of struct(depth, dir)."""
    parts = F.filter(F.split(directory, "/"), lambda x: F.length(x) > 0)
    return F.transform(F.sequence(F.lit(0), F.size(parts)), lambda k: F.struct(k.alias("up"), F.array_join(F.slice(parts, F.lit(1), F.size(parts) - k), "/").alias("dir")))


def normal(directory: Column) -> Column:
    return F.array_join(F.filter(F.split(directory, "/"), lambda x: F.length(x) > 0), "/")


def inherited(found: DataFrame) -> DataFrame:
    """Adds ``licence``, ``source`` (own, inherited or none), ``inherited_from`` and ``levels_up``."""
    d = found.withColumn("dir", normal(directory_of(F.col("path"))))
    best = F.min(F.struct((F.col("own") == WEAK).alias("weak"), (-F.round("similarity", 9)).alias("s"), F.struct(F.col("own"), F.col("version")).alias("l")))
    held = d.where(F.col("own").isNotNull() & F.col("path").rlike(_LICENCE_FILE)).groupBy("dir").agg(best.alias("b"))
    held = written(held.select(F.col("dir").alias("at"), F.col("b.l.own").alias("dir_licence"), F.col("b.l.version").alias("dir_version")), "licences")
    wanting = d.where("own IS NULL AND dir IS NOT NULL").select("dir").distinct()
    up = wanting.select("dir", F.explode(ancestors(F.col("dir"))).alias("a")).select("dir", F.col("a.up").alias("up"), F.col("a.dir").alias("at"))
    near = up.join(held, "at").groupBy("dir").agg(F.min(F.struct("up", "at", "dir_licence", "dir_version")).alias("near"))
    near = written(near.select(F.col("dir").alias("of"), "near"), "inherited")
    j = d.join(near, F.col("own").isNull() & (F.col("dir") == F.col("of")), "left")
    return j.select(
        "key", "path", "own", F.coalesce("version", F.col("near.dir_version")).alias("version"), "similarity", "n_notices",
        F.coalesce("own", F.col("near.dir_licence")).alias("licence"),
        F.when(F.col("own").isNotNull(), "own").when(F.col("near").isNotNull(), "inherited").otherwise("none").alias("source"),
        F.col("near.at").alias("inherited_from"),
        F.col("near.up").cast("long").alias("levels_up"),
    )


def scan(files: DataFrame, key: str = "doc_id", path: str = "path", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The licence of each file: its own, else its nearest licensed directory's."""
    return inherited(written(scanned(files, key, path, text, threshold), "scanned")).withColumnRenamed("key", key)

"""License scans (8): sparse TF-IDF cosine to templates, then nearest-ancestor inheritance.

Every file is read whole, sentence by sentence (a line ends one too). A sentence, or a run of
neighbouring ones that hold template words, is a notice if its TF-IDF cosine to a licence template
is at least `similarity`; weights use the templates' own vocabulary, their document frequencies
counted over all files, so that tables stay as small as the templates whatever the corpus. A file
whose words are mostly (FILE_SHARE) in notices is a licence file and licenses its directory; any
other file with a notice has that licence itself; the rest inherit from the nearest ancestor
directory that has one (ties: the most similar, then the smaller path). `license` is that of the
most similar notice (ties: the smaller name), `licenses` has those of all notices.

Templates are notices, headers and the telling passages of licence texts, not whole long texts: a
file that holds a long licence is found by those passages, and is a header if most of its words
are outside of them.

Cases: null or empty texts hold no notice and can inherit. A null path has no directory. Rows
that repeat a path are judged each. Paths use "/"; "a//b" and "./a" are read as "a/b" and "a".
Columns of `keep` may have any names but those of the result.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator, Mapping

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from .common import written

FILE_SHARE = 0.5
#: Sentences of a notice at most: longer runs are read in overlapping parts of this many.
RUN = 40
SENTENCE = re.compile(r"\n|(?<=[.;!?])\s+")
WORD = re.compile(r"[a-z0-9]+(?:[.-][0-9]+)*")

_LICENSED = "This work is licensed under a Creative Commons"
_FREE = "is free software: you can redistribute it and/or modify it under the terms of the GNU"
_HOPE = "is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE."
_GRANT = 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:'
_AS_IS = 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'
_REDISTRIBUTION = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_NAMES = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_BSD_AS_IS = 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'


def _gnu(name: str, version: str, short: str, spdx: str) -> tuple[str, ...]:
    terms = f"{name} as published by the Free Software Foundation, either version {version} of the License, or (at your option) any later version."
    return (
        f"This program {_FREE} {terms} This program {_HOPE} See the GNU {name} for more details.",
        f"This program {_FREE.replace(':', ';')} {terms.replace('version ' + version, 'version ' + version.split('.')[0])}",
        f"This work is licensed under the GNU {name}, version {version.split('.')[0]}.", f"Licensed under the {short}.",
        f"GNU {name.upper()} Version {version} Copyright (C) Free Software Foundation, Inc. Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed.",
        f"SPDX-License-Identifier: {spdx}-only", f"SPDX-License-Identifier: {spdx}-or-later",
    )


def _creative(name: str, short: str) -> tuple[str, ...]:
    return (f"Licensed under CC {short}.", f"{_LICENSED} {name} International License.", f"SPDX-License-Identifier: CC-{short.replace(' ', '-')}")


# Licence names and their usual notices.
TEMPLATES: dict[str, tuple[str, ...]] = {
    "AGPL-3.0": _gnu("Affero General Public License", "3", "AGPL v3", "AGPL-3.0"),
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0. Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
        "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/ TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION",
        "SPDX-License-Identifier: Apache-2.0",
    ),
    "BSD-2-Clause": (f"{_REDISTRIBUTION} {_BSD_AS_IS}", _REDISTRIBUTION, "Released under the BSD 2-Clause License.", "SPDX-License-Identifier: BSD-2-Clause"),
    "BSD-3-Clause": (f"{_REDISTRIBUTION} {_NAMES} {_BSD_AS_IS}", f"{_REDISTRIBUTION} {_NAMES}", _NAMES, "Released under the BSD 3-Clause License.", "SPDX-License-Identifier: BSD-3-Clause"),
    "BSL-1.0": ("Distributed under the Boost Software License, Version 1.0. (See accompanying file LICENSE_1_0.txt or copy at http://www.boost.org/LICENSE_1_0.txt)", "SPDX-License-Identifier: BSL-1.0"),
    "CC-BY-4.0": _creative("Attribution 4.0", "BY 4.0"),
    "CC-BY-NC-4.0": _creative("Attribution-NonCommercial 4.0", "BY-NC 4.0"),
    "CC-BY-SA-4.0": _creative("Attribution-ShareAlike 4.0", "BY-SA 4.0"),
    "CC0-1.0": ("To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.", "Licensed under CC0 1.0 Universal.", "SPDX-License-Identifier: CC0-1.0"),
    "EPL-2.0": ("This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/", "SPDX-License-Identifier: EPL-2.0"),
    "GPL-2.0": _gnu("General Public License", "2", "GPL v2", "GPL-2.0"),
    "GPL-3.0": _gnu("General Public License", "3", "GPL v3", "GPL-3.0"),
    "ISC": ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.", "Released under the ISC License.", "SPDX-License-Identifier: ISC"),
    "LGPL-2.1": _gnu("Lesser General Public License", "2.1", "LGPL v2.1", "LGPL-2.1"),
    "LGPL-3.0": _gnu("Lesser General Public License", "3", "LGPL v3", "LGPL-3.0"),
    "MIT": (
        "Released under the MIT License.", "Licensed under the MIT License.", f"{_GRANT} The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        f"{_GRANT} The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. {_AS_IS}", "SPDX-License-Identifier: MIT",
    ),
    "MPL-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.", "SPDX-License-Identifier: MPL-2.0"),
    "Unlicense": ("This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.", "SPDX-License-Identifier: Unlicense"),
    "Zlib": ("This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely", "SPDX-License-Identifier: Zlib"),
}


def words(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower())


class Templates:
    def __init__(self, templates: Mapping[str, tuple[str, ...]], files: int, frequency: Mapping[str, int]) -> None:
        self.idf = {w: math.log((1 + files) / (1 + frequency.get(w, 0))) + 1 for t in templates.values() for x in t for w in words(x)}
        self.other = math.log(1 + files) + 1  # of a word that no template has: it counts as rare
        self.vectors = [(name, self.vector(Counter(words(x)))) for name, t in sorted(templates.items()) for x in t]

    def vector(self, tf: Counter) -> dict[str, float]:
        v = {w: n * self.idf.get(w, self.other) for w, n in tf.items()}
        norm = math.sqrt(sum(x * x for x in v.values())) or 1.0
        return {w: x / norm for w, x in v.items()}

    def best(self, tf: Counter) -> tuple[float, str]:
        """The most similar template (ties: the smaller name)."""
        v = self.vector(tf)
        return min(((-round(sum(x * v[w] for w, x in t.items() if w in v), 9), name) for name, t in self.vectors), default=(0.0, ""))

    def scan(self, text: str | None, similarity: float) -> tuple[str | None, float, float, list[str]]:
        """(licence of the most similar notice, its similarity, share of the words in notices, all licences)."""
        total, inside, found, run = 0, 0, set(), []

        def close() -> None:
            nonlocal inside
            for at in range(0, max(1, len(run)), RUN // 2):
                part = run[at : at + RUN]
                if not part:
                    break
                choices = [Counter(w) for w in part] + ([Counter(x for w in part for x in w)] if len(part) > 1 else [])
                scored = [(*self.best(c), sum(c.values())) for c in choices if sum(1 for w in c if w in self.idf) >= 2]
                hits = [x for x in scored if -x[0] >= similarity]
                if hits:
                    whole = [x for x in hits if x[2] == sum(len(w) for w in part)]
                    inside += whole[0][2] if whole else sum(x[2] for x in hits)
                    found.update((s, name) for s, name, _ in whole or hits)
                if at + RUN >= len(run):
                    break
            run.clear()

        for sentence in SENTENCE.split(text or ""):
            w = words(sentence)
            total += len(w)
            if w and sum(1 for x in w if x in self.idf) * 2 >= len(w):
                run.append(w)
            elif run and w:
                close()
        close()
        score, name = min(found, default=(0.0, None))
        return name, abs(score), min(1.0, inside / total) if total else 0.0, sorted({x[1] for x in found})


def _frequencies(vocabulary: frozenset[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counted, files = Counter(), 0
        for batch in batches:
            for text in batch.column(0):
                files += 1
                counted.update(vocabulary.intersection(words(text.as_py())))
        yield pa.RecordBatch.from_arrays([pa.array(["", *counted], pa.string()), pa.array([files, *counted.values()], pa.int64())], ["word", "n"])

    return run


FOUND = ["__own", "__similarity", "__share", "__licenses"]


def _scan(shared, similarity: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        templates = shared.value
        for batch in batches:
            rows = [templates.scan(x.as_py(), similarity) for x in batch.column(batch.num_columns - 1)]
            columns = zip(*rows, strict=True) if rows else ((), (), (), ())
            types = (pa.string(), pa.float64(), pa.float64(), pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], [*batch.schema.names[:-1], *FOUND])

    return run


def scan_licenses(files: DataFrame, *, path_col: str = "path", text_col: str = "text", keep: tuple[str, ...] = (), similarity: float = 0.8, templates: Mapping[str, tuple[str, ...]] = TEMPLATES) -> DataFrame:
    """The columns `keep`, path, license, origin (file, header, inherited or none), similarity, license_path, licenses."""
    spark = files.sparkSession
    vocabulary = frozenset(w for t in templates.values() for x in t for w in words(x))
    counts = files.select(F.col(text_col).alias("text")).mapInArrow(_frequencies(vocabulary), "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    counted = {r["word"]: r["n"] for r in counts.collect()}  # the templates' vocabulary
    shared = spark.sparkContext.broadcast(Templates(templates, counted.pop("", 0), counted))

    clean = F.regexp_replace(F.regexp_replace(F.col(path_col), r"/(?:\./)+|/{2,}", "/"), r"^(?:\./)+", "")
    rows = files.select(*keep, clean.alias("__path"), F.col(text_col).alias("__text"))
    schema = rows.drop("__text").schema.add("__own", "string").add("__similarity", "double").add("__share", "double").add("__licenses", ArrayType(StringType()))
    found = written(rows.mapInArrow(_scan(shared, similarity), schema), "notices")
    found = found.withColumn("__dir", F.regexp_extract("__path", r"^(.*)/[^/]*$", 1))
    licensed = found.where((F.col("__share") >= FILE_SHARE) & F.col("__own").isNotNull() & F.col("__path").isNotNull())
    best = F.min_by(F.struct(F.col("__own").alias("own"), F.col("__path").alias("path")), F.struct(-F.col("__similarity"), "__path", "__own"))
    licensed = licensed.groupBy(F.col("__dir").alias("dir")).agg(best.alias("given"))
    need = found.where("__own is null and __dir is not null").select(F.col("__dir").alias("dir")).distinct()
    depth = F.when(F.col("dir") == "", F.lit(0)).otherwise(F.size(F.split("dir", "/")))
    above = F.transform(F.sequence(F.lit(0), depth), lambda d: F.array_join(F.slice(F.split("dir", "/"), F.lit(1), d), "/"))
    ancestors = need.select(F.col("dir").alias("for_dir"), F.posexplode(above).alias("depth", "dir"))
    nearest = ancestors.join(licensed, "dir").groupBy("for_dir").agg(F.max_by("given", "depth").alias("given"))
    nearest = written(nearest.select(F.col("for_dir").alias("__for_dir"), F.col("given").alias("__given")), "nearest")  # as a table: Spark can then split a hot directory's join
    out = found.join(nearest, F.col("__dir") == F.col("__for_dir"), "left")
    own = F.col("__own").isNotNull()
    return out.select(
        *keep, F.col("__path").alias("path"), F.when(own, F.col("__own")).otherwise(F.col("__given.own")).alias("license"),
        F.when(own & (F.col("__share") >= FILE_SHARE), "file").when(own, "header").when(F.col("__given").isNotNull(), "inherited").otherwise("none").alias("origin"),
        F.when(own, F.round("__similarity", 6)).alias("similarity"), F.when(own, F.col("__path")).otherwise(F.col("__given.path")).alias("license_path"), F.col("__licenses").alias("licenses"),
    )

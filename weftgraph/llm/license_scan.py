"""License scans: Dice coefficient of word bigrams between passages of a text and licence templates.

Every run of words of a text is a passage, across lines, blank lines and comment signs. Normalising
keeps lower-case letters, digits and dots within numbers. Dice is 2 * common / (n + m) over the sets
of bigrams. A template is tried where a text holds enough of its bigrams to reach the threshold, and
only on runs that can be best: they begin and end with bigrams of the template, hold neither of these
twice, and stay within the sizes at which the threshold can be reached. Of runs that overlap the best
Dice counts, then the longest run; a template of one word must be a line.

Short templates differ from their neighbours in a word or a number alone, which Dice hardly sees. So
a run counts for a template of up to `SHORT` words only if the words that tell licences apart (kinds,
elements, versions) agree: the run, and the two words on either side of it, must hold all of the
template's, and none of the kinds or elements that it lacks. A near name gives way to its own
template, or to none.

Templates are names and texts of any length, from notices to whole licences: those of this module, or
what read_templates finds. A task holds about `MOST_BYTES` of them at a time; more are scanned in
passes, between which texts and the runs found so far are written to the shared folder.

Null, empty and blank texts have no passages and no licence. Rows are scanned one by one, whatever
their doc_id; an empty table gives an empty result; other columns are not read. A very long text is
held whole by one task, with about 200 bytes for each of its words.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructType

from .common import carried, map_arrow, written

MOST_BYTES = 16 << 20
#: Notices, by SPDX-like id.
NOTICES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("CC0-1.0", "This work is dedicated to the public domain under CC0 1.0."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0."),
    ("BSL-1.0", "Distributed under the Boost Software License, Version 1.0."),
    ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/"),
    ("MIT", "The MIT License (MIT)"),
    ("MIT", "MIT License Copyright (c)"),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("Unlicense", "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    ("BSD", "Released under the BSD license."),
    ("BSD", "Licensed under the BSD license."),
    ("MIT OR GPL", "Dual licensed under the MIT and GPL licenses."),
    ("All-rights-reserved", "All rights reserved."),
)
#: Whole licences that are short.
WHOLE = (
    ("MIT", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""),
    ("ISC", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""),
    ("BSD-2-Clause", """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""),
)
#: Ids that source files name.
SPDX = ("Apache-2.0", "MIT", "BSD-2-Clause", "BSD-3-Clause", "ISC", "MPL-2.0", "EPL-2.0", "BSL-1.0", "Zlib", "Unlicense", "CC0-1.0")
#: The elements of Creative Commons licences, short and long.
_CC = (("BY", "Attribution"), ("BY-SA", "Attribution-ShareAlike"), ("BY-NC", "Attribution-NonCommercial"), ("BY-ND", "Attribution-NoDerivatives"), ("BY-NC-SA", "Attribution-NonCommercial-ShareAlike"), ("BY-NC-ND", "Attribution-NonCommercial-NoDerivatives"))
#: Words that tell licences apart, besides numbers.
TELLING = frozenset("mit gpl lgpl agpl lesser affero apache mozilla eclipse boost bsd isc clause cc0 nc noncommercial sa sharealike nd noderivatives noderivs later only".split())
_VERSIONS = frozenset(("1", "1.1", "2", "2.1", "2.5", "3", "4"))
SHORT = 40
_FREE = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU {} as published by the Free Software Foundation, either version {} of the License, or (at your option) any later version."
_GNU = (("GPL", "General Public License", ("2", "3")), ("LGPL", "Lesser General Public License", ("2.1", "3")), ("AGPL", "Affero General Public License", ("3",)))
TEMPLATES = (
    *NOTICES, *WHOLE,
    *((f"{short}-{v if '.' in v else v + '.0'}", _FREE.format(name, v)) for short, name, versions in _GNU for v in versions),
    *((f"CC-{short}-{v}", f"Licensed under CC {short} {v}.") for short, _ in _CC for v in ("3.0", "4.0")),
    *((f"CC-{short}-{v}", f"This work is licensed under a Creative Commons {long} {v} {kind} License.") for short, long in _CC for v, kind in (("3.0", "Unported"), ("4.0", "International"))),
    *((name, f"SPDX-License-Identifier: {name}") for name in SPDX),
    *((f"CC-{short}-4.0", f"SPDX-License-Identifier: CC-{short}-4.0") for short, _ in _CC),
    *((f"{short}-{v if '.' in v else v + '.0'}{more}", f"SPDX-License-Identifier: {short}-{v if '.' in v else v + '.0'}{more}") for short, _, versions in _GNU for v in versions for more in ("", "-only", "-or-later")),
)
_WORDS = re.compile(r"[0-9]+(?:\.[0-9]+)*|[a-z]+").findall


def normal_words(text: str) -> list[str]:
    return _WORDS(text.lower())


def bigrams(words: list[str]) -> set[tuple[str, ...]]:
    return set(zip(words, words[1:], strict=False)) if len(words) > 1 else {tuple(words)} if words else set()


def telling(words: list[str]) -> tuple[set[str], set[str]]:
    """(kinds and elements, versions) among words; 2.0 is the version 2."""
    versions = {w.removesuffix(".0") for w in words if w[0].isdigit()}
    return {w for w in words if w in TELLING}, versions & _VERSIONS


class Templates:
    """Templates as sets of bigrams; of which ones each bigram is part."""

    def __init__(self, templates: tuple[tuple[str, str], ...], threshold: float, names: bool = True):
        split = [(name, normal_words(text)) for name, text in templates]
        sets = [(name, g, telling(w) if names and len(w) <= SHORT else None) for name, w in split if (g := bigrams(w))]
        self.sets = [x for x in sets if len(next(iter(x[1]))) > 1]
        self.words = {next(iter(g))[0]: name for name, g, _ in sorted(sets, key=lambda x: x[0], reverse=True) if len(next(iter(g))) == 1}
        self.threshold = threshold - 1e-12
        self.ratio = threshold / (2 - threshold)
        self.known = set().union(*(g for _, g, _ in self.sets))

    def runs(self, before: np.ndarray, after: np.ndarray, name: str, m: int, starts: np.ndarray) -> Iterator[tuple[float, int, int, str]]:
        """-Dice, -length, start and name of the best run from each start.

        before and after hold where a bigram of the text stood last and stands next; starts are the
        places of the template's bigrams, of which it has m.
        """
        most = m / self.ratio + 1e-9
        inside = np.zeros(len(before), bool)
        inside[starts] = True
        for i in starts.tolist():
            new = before[i : after[i]] < i  # the first of its kind since the start
            sizes = np.cumsum(new)
            stop = int(np.searchsorted(sizes, most, "right"))
            ends = new[:stop] & inside[i : i + stop]
            dice = np.where(ends, 2 * np.cumsum(ends) / (sizes[:stop] + m), 0.0)
            if (best := dice.max(initial=0.0)) >= self.threshold:
                yield -float(best), -int(dice.argmax()) - 1, i, name

    @staticmethod
    def named(words: list[str], start: int, end: int, told: tuple[set[str], set[str]] | None) -> bool:
        """Whether the run and the words beside it tell the template's licence and no other."""
        if told is None:
            return True
        kinds, versions = telling(words[start : end + 1])
        more_kinds, more_versions = telling(words[max(0, start - 2) : start] + words[end + 1 : end + 3])
        return kinds | more_kinds == told[0] and versions <= told[1] <= versions | more_versions

    def candidates(self, words: list[str]) -> list[tuple[float, int, int, str]]:
        """-Dice, -length, start and licence of the best runs from each start, for each template."""
        grams = list(zip(words, words[1:], strict=False))
        hits = [k for k, g in enumerate(grams) if g in self.known]
        if not hits:
            return []
        places: dict[tuple[str, str], list[int]] = defaultdict(list)
        for k in hits:
            places[grams[k]].append(k)
        wanted = [(name, t, told, some) for name, t, told in self.sets if len(some := t & places.keys()) >= len(t) * self.ratio - 1e-9]
        if not wanted:
            return []
        before, after, last = np.full(len(grams), -1), np.full(len(grams), len(grams)), {}
        for k, g in enumerate(grams):
            if (p := last.get(g)) is not None:
                before[k], after[p] = p, k
            last[g] = k
        runs = []
        for name, template, told, some in wanted:
            best = self.runs(before, after, name, len(template), np.sort(np.concatenate([places[g] for g in some])))
            runs += [x for x in best if self.named(words, x[2], x[2] - x[1], told)]
        return runs

    @staticmethod
    def settled(runs: list[tuple[float, int, int, str]]) -> list[tuple[float, int, int, str]]:
        """Dice, first and last word, and licence of the runs that overlap no better one."""
        taken: list[tuple[int, int]] = []
        out = []
        for dice, length, start, name in sorted(runs):
            end = start - length  # of the last word
            at = bisect_left(taken, (start, end))
            if (at and taken[at - 1][1] >= start) or (at < len(taken) and taken[at][0] <= end):
                continue
            taken.insert(at, (start, end))
            out.append((-dice, start, end, name))
        return out


def lines_of_one(text: str, words: dict[str, str]) -> list[tuple[float, str]]:
    """Dice and licence of the lines that are the one word of a template."""
    lines = (normal_words(line) for line in text.split("\n")) if words else ()
    return [(1.0, words[w[0]]) for w in lines if len(w) == 1 and w[0] in words]


def matches(text: str | None, templates: Templates) -> list[tuple[float, str, str]]:
    """Dice, licence and words of each passage that matches."""
    if not text:
        return []
    words = normal_words(text)
    out = [(dice, name, " ".join(words[start : end + 1])) for dice, start, end, name in templates.settled(templates.candidates(words))]
    return out + [(dice, name, "") for dice, name in lines_of_one(text, templates.words)]


class Blocks:
    """Templates in blocks of about so many bytes, by a hash of the name; the driver and a task see one at a time."""

    def __init__(self, rows: DataFrame, size: int, most: int):
        self.n = -(-2 * size // most)
        self.rows = written(rows.withColumn("block", F.pmod(F.xxhash64("name"), F.lit(self.n)).cast("int")).repartition("block"))

    def __iter__(self) -> Iterator[tuple[tuple[str, str], ...]]:
        for k in range(self.n):
            if block := tuple(sorted((r.name, r.text) for r in self.rows.where(F.col("block") == k).collect())):
                yield block


def read_templates(spark: SparkSession, path: str, most: int = MOST_BYTES) -> tuple[tuple[str, str], ...] | Blocks:
    """(name, text) of a table with these columns at the path, a Parquet file or folder, or of the text files in a folder, by their names; over `most` bytes in blocks."""
    if path.rstrip("/").endswith(".parquet"):
        rows = spark.read.parquet(path).select("name", "text").where("name IS NOT NULL AND text IS NOT NULL")
    else:
        rows = spark.read.text(path, wholetext=True).select(F.regexp_extract(F.input_file_name(), r"([^/]+?)(?:\.txt)?$", 1).alias("name"), F.col("value").alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    if size > most:
        return Blocks(rows, size, most)
    return tuple(sorted((r.name, r.text) for r in rows.collect()))


def summed(found: list[tuple[float, str]]) -> tuple[dict[str, float], int]:
    """The best Dice for each licence found, and the number of passages that match."""
    best: dict[str, float] = {}
    for dice, name in found:
        best[name] = max(best.get(name, 0.0), dice)
    return best, len(found)


def scan_text(text: str | None, templates: Templates) -> tuple[dict[str, float], int]:
    """summed() of a text's passages."""
    return summed([(dice, name) for dice, name, _ in matches(text, templates)])


_RESULT = "n_matches long, licenses array<string>, license string, dice double"


def _columns(k: pa.Array, got: list[tuple[dict[str, float], int]]) -> dict:
    best = [min(((-d, name) for name, d in found.items()), default=(0.0, None)) for found, _ in got]
    return {"k": k, "n_matches": [n for _, n in got], "licenses": [sorted(f) for f, _ in got], "license": [x[1] for x in best], "dice": [abs(x[0]) for x in best]}


def _in_passes(rows: DataFrame, blocks: Blocks, threshold: float, names: bool, schema: StructType) -> DataFrame:
    """The same from several blocks of templates: each pass adds its runs to those found so far, and the last step settles overlaps among all."""
    runs = "runs array<struct<d: double, l: long, s: long, name: string>>, lines array<struct<d: double, name: string>>"
    kind = rows.schema["k"].dataType
    state = rows.select("k", "t", *[F.array().cast(t).alias(c) for c, t in (("runs", "array<struct<d: double, l: long, s: long, name: string>>"), ("lines", "array<struct<d: double, name: string>>"))])

    def step(block: tuple[tuple[str, str], ...]) -> Callable:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
            index = Templates(block, threshold, names)
            for b in batches:
                found, lines = b.column(2).to_pylist(), b.column(3).to_pylist()
                for row, value in enumerate(b.column(1)):
                    if text := value.as_py():
                        found[row] += [dict(zip(("d", "l", "s", "name"), x, strict=True)) for x in index.candidates(normal_words(text))]
                        lines[row] += [{"d": d, "name": name} for d, name in lines_of_one(text, index.words)]
                yield {"k": b.column(0), "t": b.column(1), "runs": found, "lines": lines}

        return run

    for block in blocks:
        state = written(map_arrow(state, step(block), carried({"k": kind, "t": StringType()}, runs)))

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for b in batches:
            got = []
            for found, lines in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                best = Templates.settled([(x["d"], x["l"], x["s"], x["name"]) for x in found])
                got.append(summed([(dice, name) for dice, _, _, name in best] + [(x["d"], x["name"]) for x in lines]))
            yield _columns(b.column(0), got)

    return map_arrow(state.select("k", "runs", "lines"), settle, schema)


def scan_licenses(docs: DataFrame, templates: tuple[tuple[str, str], ...] | Blocks = TEMPLATES, threshold: float = 0.8, key: str = "doc_id", names: bool = True) -> DataFrame:
    """key, n_matches, licenses (sorted ids), license and dice (the best; null and 0.0 without one); without names, by Dice alone."""
    rows = docs.select(docs[key].alias("k"), docs["text"].cast("string").alias("t"))
    schema = carried({"k": rows.schema["k"].dataType}, _RESULT)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        index = Templates(templates, threshold, names)
        for b in batches:
            yield _columns(b.column(0), [scan_text(t.as_py(), index) for t in b.column(1)])

    out = _in_passes(rows, templates, threshold, names, schema) if isinstance(templates, Blocks) else map_arrow(rows, run, schema)
    return out.withColumnRenamed("k", key)

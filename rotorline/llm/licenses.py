"""License texts in documents, by MinHash over overlapping windows, in DataFrame functions alone.

A template is a license notice, a license's text or a section of a long one; its words make shingles of
five. A document holds a template if some run of `ROOM` (2) times the template's shingles has `least`
(0.8) of them: so words may be inserted, left out or changed, wherever in the document the notice stands.

Templates of about one length share a class, whose windows are wide and close enough that every such run
lies whole in one of them. A window's shingles are hashed by `bands` functions, the least value of each
is a band, and windows and templates meet that agree in one. How many bands a class needs follows from the
least similarity that a match can have with its window, so that a match is missed once in 10^6 times.
What meets is verified: the most distinct shingles that a run of the window has are counted.

Steps before that cost little and lose nothing. A document that holds that share of a template's
shingles has one of the template's anchor words, since too few shingles are without; and a document, or
window, with fewer shingles of a class than its templates need holds none of them. The templates are a
fixed table, so all that is broadcast is bounded.
"""

from __future__ import annotations

import math
import re
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rotorline.llm.common import named

SHINGLE = 5
LEAST = 0.8
ROOM = 2
MISSED = 1e-6
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

# Notices and texts as the licenses give them; of the longest, sections that stand in each copy.
TEMPLATES = (
    ("apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("apache-2.0-header", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in "
     "compliance with the License. You may obtain a copy of the License at"),
    ("apache-2.0-terms", "Unless required by applicable law or agreed to in writing, software distributed under the License is "
     "distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License "
     "for the specific language governing permissions and limitations under the License."),
    ("mit", "Released under the MIT License."),
    ("mit-licensed", "Licensed under the MIT License."),
    ("mit-grant", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
     "documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights "
     "to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to "
     "whom the Software is furnished to do so, subject to the following conditions:"),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl-3.0-or-later-header", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU "
     "General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) "
     "any later version."),
    ("gpl-2.0-or-later-header", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU "
     "General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) "
     "any later version."),
    ("lgpl-2.1-or-later-header", "This library is free software; you can redistribute it and/or modify it under the terms of the "
     "GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at "
     "your option) any later version."),
    ("mpl-2.0-header", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL "
     "was not distributed with this file, You can obtain one at"),
    ("bsd-grant", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
     "following conditions are met:"),
    ("bsd-3-clause-names", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or "
     "promote products derived from this software without specific prior written permission."),
    ("isc-grant", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
     "granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("unlicense", "This is free and unencumbered software released into the public domain."),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0."),
    ("cc-by-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("cc-by-sa-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("cc-by-nc-4.0-work", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("cc0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("mit-body", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
     "documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights "
     "to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to "
     "whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission "
     "notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT "
     "WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A "
     "PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR "
     "OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR "
     "THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("bsd-2-clause-body", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that "
     "the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of "
     "conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list "
     "of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS "
     "SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT "
     "NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL "
     "THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES "
     "(INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS "
     "INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE "
     "OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."),
    ("bsd-3-clause-body", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that "
     "the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of "
     "conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list "
     "of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither "
     "the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this "
     "software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" "
     "AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A "
     "PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, "
     "INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR "
     "SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN "
     "CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN "
     "IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."),
    ("isc-body", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
     "granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS "
     "IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND "
     "FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES "
     "WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, "
     "ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."),
    ("apache-2.0-grant", "Grant of Copyright License. Subject to the terms and conditions of this License, each Contributor hereby "
     "grants to You a perpetual, worldwide, non-exclusive, no-charge, royalty-free, irrevocable copyright license to reproduce, prepare "
     "Derivative Works of, publicly display, publicly perform, sublicense, and distribute the Work and such Derivative Works in Source "
     "or Object form."),
    ("gpl-3.0-preamble", "The GNU General Public License is a free, copyleft license for software and other kinds of works. The licenses "
     "for most software and other practical works are designed to take away your freedom to share and change the works. By contrast, "
     "the GNU General Public License is intended to guarantee your freedom to share and change all versions of a program--to make sure "
     "it remains free software for all its users."),
)


class WindowClass(NamedTuple):
    """Templates of about one length: shingles of a window, step between windows, bands, the least shingles that one needs."""

    number: int
    size: int
    step: int
    bands: int
    needed: int
    templates: list[tuple[str, str]]


def words_of(text: str) -> list[str]:
    """Words of a template: runs of ASCII letters and digits in lower case; what documents are split into."""
    return re.findall("[a-z0-9]+", text.lower())


def shingles_of(text: str) -> list[str]:
    """Distinct shingles of a template, in order."""
    words = words_of(text)
    return list(dict.fromkeys(" ".join(words[i:i + SHINGLE]) for i in range(len(words) - SHINGLE + 1)))


def needed_of(text: str, least: float = LEAST) -> int:
    """How many of a template's shingles a match holds at least."""
    return math.ceil(least * len(shingles_of(text)) - 1e-9)


def room_of(text: str) -> int:
    """How many shingles in a row a match may take."""
    return ROOM * (len(words_of(text)) - SHINGLE + 1)


def classes(templates, least: float = LEAST, missed: float = MISSED) -> list[WindowClass]:
    """Window classes: a class takes templates of up to one and a half times the shingles of its smallest."""
    runs = sorted(templates, key=lambda t: len(words_of(t[1])))
    if any(len(words_of(text)) < SHINGLE for _, text in runs):
        raise ValueError(f"a template has {SHINGLE} words at least")
    groups: list[list[tuple[str, str]]] = []
    for t in runs:
        if groups and len(words_of(t[1])) - SHINGLE + 1 <= 1.5 * (len(words_of(groups[-1][0][1])) - SHINGLE + 1):
            groups[-1].append(t)
        else:
            groups.append([t])
    out = []
    for number, group in enumerate(groups):
        longest = len(words_of(group[-1][1])) - SHINGLE + 1
        step = max(1, longest // 2)
        size = ROOM * longest + step - 1
        similar = min(needed_of(text, least) / (size + len(shingles_of(text)) - needed_of(text, least)) for _, text in group)
        bands = 1 if similar >= 1 else math.ceil(math.log(missed) / math.log(1 - similar))
        out.append(WindowClass(number, size, step, bands, min(needed_of(text, least) for _, text in group), group))
    return out


def anchors(templates, least: float = LEAST) -> list[str]:
    """Words one of which is in every text that holds `least` of the shingles of a template.

    Words of seven letters at least, where there are such, are taken in the order of the shingles
    that they cover, until of each template fewer shingles are without one than a match needs.
    """
    out: list[str] = []
    left = {name: shingles_of(text) for name, text in templates}
    needed = {name: needed_of(text, least) for name, text in templates}
    while True:
        left = {name: [s for s in shingles if not any(word in s for word in out)] for name, shingles in left.items()}
        left = {name: shingles for name, shingles in left.items() if len(shingles) >= needed[name]}
        if not left:
            return sorted(out)
        rest = [s for shingles in left.values() for s in shingles]
        words = {w for s in rest for w in s.split()}
        out.append(max(words, key=lambda w: (len(w) >= 7, sum(w in s for s in rest), len(w), w)))


def _made(df: DataFrame, kept: list[str], **columns: Column) -> DataFrame:
    """The kept columns and new ones, computed once per row.

    The explode of one element is a barrier: without it, what is computed from a column further up
    would have the column's expression put in its place, to be computed again for every element.
    """
    made = F.explode(F.array(F.struct(*[c.alias(name) for name, c in columns.items()]))).alias("made")
    return df.select(*kept, made).select(*kept, "made.*")


def _word_shingles(words: Column) -> Column:
    """Hashes of the shingles of an array of words, in order."""
    places = F.when(F.size(words) >= SHINGLE, F.sequence(F.lit(1), F.size(words) - SHINGLE + 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(places, lambda i: F.xxhash64(F.array_join(F.slice(words, i, SHINGLE), " ")))


def _bands(shingles: Column, n: int) -> Column:
    """The least value of each of n hash functions over a window's shingles, with its number."""
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda b: F.struct(
        b.alias("band"), F.array_min(F.transform(shingles, lambda h: F.xxhash64(h, b))).alias("least")))


def _template_table(spark: SparkSession, groups: list[WindowClass], least: float) -> DataFrame:
    """(class, license, needed, room, own) per template: own are the hashes of its distinct shingles, room those of a run."""
    rows = [
        F.struct(F.lit(c.number).alias("class"), F.lit(name).alias("license"), F.lit(needed_of(text, least)).alias("needed"),
                 F.lit(room_of(text)).alias("room"), F.array(*map(F.lit, shingles_of(text))).alias("texts"))
        for c in groups for name, text in c.templates
    ]
    table = spark.range(1).select(F.explode(F.array(*rows)).alias("t")).select("t.*")
    return table.select("class", "license", "needed", "room", F.transform("texts", lambda s: F.xxhash64(s)).alias("own"))


def _most_in_a_run(window: Column, own: Column, room: Column) -> Column:
    """The most distinct shingles of a template that `room` shingles in a row of a window have. The best run starts with one of them."""
    hits = F.filter(F.transform(window, lambda h, i: F.struct(i.alias("at"), h.alias("h"))), lambda x: F.array_contains(own, x["h"]))

    def counted(hits: Column) -> Column:
        return F.size(F.array_distinct(hits["h"]))

    near = F.element_at(hits, -1)["at"] - F.element_at(hits, 1)["at"] < room
    runs = F.transform(hits, lambda s: counted(F.filter(hits, lambda x: (x["at"] >= s["at"]) & (x["at"] < s["at"] + room))))
    return F.when(F.size(hits) == 0, 0).when(near, counted(hits)).otherwise(F.array_max(runs))


def find_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates=TEMPLATES, least: float = LEAST) -> DataFrame:
    """One row per document and license found in it: doc_id, license, shingles_found, shingles_of_license.

    `shingles_found` is the most distinct shingles of the template that a run of twice its shingles has,
    wherever in the document it starts. Rows of one id count as one document, rows without an id too.
    Null, empty and short texts hold nothing, so an id may give no row, and an empty table gives none.
    Extra columns are ignored.
    """
    spark = docs.sparkSession
    groups = classes(templates, least)
    table = _template_table(spark, groups, least)
    of_class = {c.number: sorted({s for _, text in c.templates for s in shingles_of(text)}) for c in groups}
    hashes = lambda texts: F.transform(F.array(*map(F.lit, texts)), lambda s: F.xxhash64(s))
    read = docs.select(named(id_col).alias("doc_id"), named(text_col).alias("text"))
    read = _made(read, ["doc_id", "text"], lower=F.lower("text"))
    read = read.filter(reduce(Column.__or__, [F.col("lower").contains(word) for word in anchors(templates, least)]))
    words = _made(read, ["doc_id"], words=F.regexp_extract_all(F.translate("text", UPPER, LOWER), F.lit("[a-z0-9]+"), F.lit(0)))
    hashed = _made(words, ["doc_id"], shingles=_word_shingles(F.col("words")))
    shared = F.array_intersect("shingles", hashes(sorted({s for texts in of_class.values() for s in texts})))
    holding = _made(hashed, ["doc_id", "shingles"], shared=shared).filter(F.size("shared") >= min(c.needed for c in groups))
    kinds = F.explode(F.array(*[
        F.struct(F.lit(c.number).alias("class"), F.lit(c.size).alias("size"), F.lit(c.step).alias("step"), F.lit(c.needed).alias("needed"),
                 F.array_intersect("shared", hashes(of_class[c.number])).alias("own"))
        for c in groups])).alias("kind")
    holding = holding.select("doc_id", "shingles", kinds).select("doc_id", "shingles", "kind.*").filter(F.size("own") >= F.col("needed"))
    places = F.filter(F.sequence(F.lit(0), F.size("shingles") - 1), lambda i: F.array_contains("own", F.element_at("shingles", i + 1)))
    windows = _made(holding, ["doc_id", "shingles", "class", "size", "step", "needed", "own"], places=places)
    first = F.array_distinct(F.flatten(F.transform(
        "places", lambda p: F.sequence(
            F.greatest(F.lit(0), F.floor((p - F.col("size") + F.col("step")) / F.col("step")).cast("int")),
            F.floor(p / F.col("step")).cast("int")))))
    windows = windows.select("doc_id", "shingles", "class", "size", "step", "needed", "own", F.explode(first).alias("window"))
    windows = _made(
        windows, ["doc_id", "class", "needed", "own"], held=F.slice("shingles", F.col("window") * F.col("step") + 1, F.col("size")))
    windows = windows.filter(F.size(F.array_intersect("held", "own")) >= F.col("needed"))

    def banded(df: DataFrame, shingles: str, *kept: str) -> DataFrame:
        """A row for each band, with all bands."""
        per_class = F.when(F.lit(False), F.lit(None))
        for c in groups:
            per_class = per_class.when(F.col("class") == c.number, _bands(F.array_distinct(shingles), c.bands))
        made = _made(df, ["class", *kept], bands=per_class)
        return made.select("class", *kept, F.col("bands.least").alias("leasts"), F.explode("bands").alias("key")).select(
            "class", *kept, "leasts", "key.*")

    asked = banded(windows, "held", "doc_id", "held")
    index = banded(table, "own", "license", "needed", "room", "own").withColumnRenamed("leasts", "own_leasts")
    met = asked.join(F.broadcast(index), ["class", "band", "least"])
    # Of the bands that agree, the first has the window verified.
    before = F.filter(F.sequence(F.lit(0), F.col("band")), lambda b: F.get("leasts", b) == F.get("own_leasts", b))
    met = met.filter(F.element_at(before, 1) == F.col("band"))
    found = _most_in_a_run(F.col("held"), F.col("own"), F.col("room")).cast("long")
    of = F.size("own").cast("long")
    return (
        _made(met, ["doc_id", "license", "needed"], shingles_found=found, shingles_of_license=of)
        .filter("shingles_found >= needed")
        .groupBy("doc_id", "license").agg(F.max("shingles_found").alias("shingles_found"), F.max("shingles_of_license").alias("shingles_of_license")))


def windows_sql(templates=TEMPLATES, least: float = LEAST, table: str = "documents") -> str:
    """The same rows by counting shared shingles of the run that starts at every shared one, as DuckDB SQL."""
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    shingles = ", ".join(
        f"({quoted(name)}, {room_of(text)}, {len(shingles_of(text))}, {needed_of(text, least)}, {quoted(s)})"
        for name, text in templates for s in shingles_of(text))
    return f"""
        WITH t(license, room, n, needed, shingle) AS (VALUES {shingles}),
        d AS (SELECT row_number() OVER () AS r, doc_id,
                     regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '[a-z0-9]+') AS words FROM {table}),
        s AS (SELECT r, doc_id, p, array_to_string(words[p + 1:p + {SHINGLE}], ' ') AS shingle
              FROM d, unnest(range(0, len(words) - {SHINGLE - 1})) AS u(p)),
        h AS (SELECT r, doc_id, license, room, n, needed, p, t.shingle FROM s JOIN t USING (shingle)),
        w AS (SELECT a.r, a.doc_id, a.license, a.n, a.needed, a.p, count(DISTINCT b.shingle) AS found
              FROM h a JOIN h b ON a.r = b.r AND a.license = b.license AND b.p >= a.p AND b.p < a.p + a.room GROUP BY ALL)
        SELECT doc_id, license, max(found) AS shingles_found, CAST(max(n) AS BIGINT) AS shingles_of_license
        FROM w WHERE found >= needed GROUP BY doc_id, license
    """

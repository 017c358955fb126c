"""License scans with DataFrame functions alone.

Words are runs of a-z and 0-9 after lower-casing A-Z; shingles are 5 words. For a template of t shingles the text is
read in windows of 2t shingles, one every t, so each occurrence lies in one window whole. Each window has the minima of
MINIMA hash functions over its shingles; one equal minimum (a band of one row) retrieves the template. A window that
holds 3/4 of a template has a similarity of 1/3 or more, and is missed with probability (2/3)**MINIMA = 2e-6; then the
template's shingles are counted exactly. A window without any of a template's minima can't share one, so only windows
around such shingles are looked at; all others are settled by one look at each shingle.

Defined results: null and empty texts and texts of fewer than five words match nothing; rows with one doc_id count as
one document's windows; a null doc_id is kept as a document; an empty table gives an empty result; other columns are
ignored; templates of fewer than five words are refused.
"""

from __future__ import annotations

import re
import string
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SHINGLE, MINIMA = 5, 32


class Template(NamedTuple):
    name: str
    text: str


# Public licences, by their paragraphs, and the notices that refer to them.
TEMPLATES = [
    Template("Apache-2.0", "Licensed under the Apache License, Version 2.0"),
    Template("Apache-2.0", "you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    Template("Apache-2.0", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."),
    Template("Apache-2.0", "Subject to the terms and conditions of this License, each Contributor hereby grants to You a perpetual, worldwide, non-exclusive, no-charge, royalty-free, irrevocable copyright license to reproduce, prepare Derivative Works of, publicly display, publicly perform, sublicense, and distribute the Work and such Derivative Works in Source or Object form."),
    Template("AGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation"),
    Template("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    Template("BSD", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."),
    Template("BSD", "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    Template("BSD", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    Template("BSD", "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS AS IS AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED."),
    Template("BSD", "IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY"),
    Template("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    Template("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0"),
    Template("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    Template("CC0-1.0", "To the extent possible under law, the person who associated CC0 with this work has waived all copyright and related or neighboring rights to this work"),
    Template("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0"),
    Template("GPL-3.0", "This work is licensed under the GNU General Public License, version 3"),
    Template("GPL", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    Template("GPL", "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."),
    Template("GPL", "You should have received a copy of the GNU General Public License along with this program."),
    Template("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    Template("ISC", "provided that the above copyright notice and this permission notice appear in all copies."),
    Template("ISC", "THE SOFTWARE IS PROVIDED AS IS AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS."),
    Template("LGPL", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"),
    Template("MIT", "Released under the MIT License"),
    Template("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction"),
    Template("MIT", "including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions"),
    Template("MIT", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    Template("MIT", "THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    Template("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    Template("MPL-2.0", "If a copy of the MPL was not distributed with this file, You can obtain one at"),
    Template("Unlicense", "This is free and unencumbered software released into the public domain"),
    Template("Unlicense", "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    Template("Zlib", "This software is provided as-is, without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software."),
    Template("Zlib", "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions"),
]


def template_words(text: str) -> list[str]:
    return re.findall("[a-z0-9]+", "".join(c.lower() if c in string.ascii_uppercase else c for c in text))


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), string.ascii_uppercase, string.ascii_lowercase), F.lit("[a-z0-9]+"), F.lit(0))


def shingles(word: Column) -> Column:
    each = lambda i: F.xxhash64(*(F.get(word, i + k) for k in range(SHINGLE)))
    return F.when(F.size(word) >= SHINGLE, F.transform(F.sequence(F.lit(0), F.size(word) - SHINGLE), each)).otherwise(F.array().cast("array<bigint>"))


def minima(of: Column) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(MINIMA - 1)), lambda f: F.struct(f.alias("f"), F.array_min(F.transform(of, lambda x: F.xxhash64(x, f))).alias("least")))


class Bands(NamedTuple):
    """Templates as the scan needs them: sizes, shingles that are minima, rows (template, name, t, f, least, own)."""

    sizes: list[int]
    anchors: list[int]
    rows: DataFrame


def bands(spark: SparkSession, templates: list[Template]) -> Bands:
    for t in templates:
        if len(template_words(t.text)) < SHINGLE:
            raise ValueError(f"{t.name}: a template needs {SHINGLE} words or more")
    quoted = lambda x: "'" + x.replace("\\", "\\\\").replace("'", "\\'") + "'"
    rows = ", ".join(f"({i}, {quoted(t.name)}, split({quoted(' '.join(template_words(t.text)))}, ' '))" for i, t in enumerate(templates))
    own = spark.sql(f"select * from values {rows} as t(template, name, word)").select("template", "name", F.array_distinct(shingles(F.col("word"))).alias("own"))
    made = own.select("template", "name", F.size("own").alias("t"), "own", F.explode(minima(F.col("own"))).alias("m")).select("template", "name", "t", "own", "m.f", "m.least")
    got = made.select("t", "least", "f", "own").collect()  # MINIMA rows a template
    least = {(r.f, r.least) for r in got}
    reach = own.select(F.explode("own").alias("x")).distinct().select("x", F.explode(F.transform(F.sequence(F.lit(0), F.lit(MINIMA - 1)), lambda f: F.struct(f.alias("f"), F.xxhash64("x", f).alias("least")))).alias("m")).collect()
    return Bands(sorted({r.t for r in got}), sorted({r.x for r in reach if (r.m.f, r.m.least) in least}), made)


def scan(docs: DataFrame, templates: list[Template] = TEMPLATES, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, license, n_windows (windows that hold 3/4 of a template's shingles), share (largest share held)."""
    b = bands(docs.sparkSession, templates)
    sh = docs.select(F.col(f"`{key}`").alias("doc_id"), words(F.col(f"`{text}`")).alias("word")).select("doc_id", shingles(F.col("word")).alias("sh"))
    at = F.filter(F.transform("sh", lambda x, i: F.when(x.isin(b.anchors), i)), lambda i: i.isNotNull())
    ranks = F.array(*(F.lit(t) for t in b.sizes))
    around = lambda i: F.transform(ranks, lambda t: F.struct(t.alias("t"), F.floor(i / t).cast("int").alias("k")))
    before = lambda w: F.struct(w["t"].alias("t"), (w["k"] - 1).alias("k"))
    whole = F.flatten(F.transform(at, lambda i: F.concat(around(i), F.transform(around(i), before))))
    window = sh.select("doc_id", "sh", F.explode(F.array_distinct(whole)).alias("w")).where("w.k >= 0")
    window = window.select("doc_id", F.col("w.t").alias("t"), F.col("w.k").alias("k"), F.array_distinct(F.expr("slice(sh, w.k * w.t + 1, 2 * w.t)")).alias("held"))
    banded = window.select("doc_id", "t", "k", "held", F.explode(minima(F.col("held"))).alias("m")).select("doc_id", "t", "k", "held", "m.f", "m.least")
    found = banded.join(F.broadcast(b.rows), ["t", "f", "least"])  # MINIMA rows a template
    counted = found.select("doc_id", "template", "name", "t", "k", F.size(F.array_intersect("held", "own")).alias("n")).where("4 * n >= 3 * t").distinct()
    return counted.groupBy("doc_id", F.col("name").alias("license")).agg(F.count(F.lit(1)).alias("n_windows"), F.max(F.col("n") / F.col("t")).alias("share"))


def oracle(templates: list[Template] = TEMPLATES) -> str:
    """The same by counting shingles of all windows, without minima (DuckDB)."""
    rows = ", ".join(f"({i}, '{t.name}', '{' '.join(w)}')" for i, t in enumerate(templates) for w in [template_words(t.text)])
    return f"""
with template as (select * from (values {rows}) v(template, name, words)),
own as (select distinct template, name, array_to_string(list_slice(w, i, i + {SHINGLE - 1}), ' ') as s
        from (select template, name, string_split(words, ' ') as w, unnest(range(1, len(string_split(words, ' ')) - {SHINGLE - 2})) as i from template)),
sized as (select template, count(*) as t from own group by template),
word as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}'), '[a-z0-9]+') as w from documents),
shingle as (select doc_id, i - 1 as pos, array_to_string(list_slice(w, i, i + {SHINGLE - 1}), ' ') as s
            from (select doc_id, w, unnest(range(1, len(w) - {SHINGLE - 2})) as i from word where len(w) >= {SHINGLE})),
hit as (select doc_id, template, name, t, pos, s from shingle join own using (s) join sized using (template)),
held as (select doc_id, template, name, t, pos // t as k, s from hit union all
         select doc_id, template, name, t, pos // t - 1 as k, s from hit where pos // t > 0),
counted as (select doc_id, template, name, t, k, count(distinct s) as n from held group by all having 4 * count(distinct s) >= 3 * t)
select doc_id, name as license, count(*) as n_windows, max(n / t) as share from counted group by doc_id, name
"""

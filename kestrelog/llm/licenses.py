"""License scans: notices and license texts inside documents, by MinHash bands over text windows.

Templates are classed by length; a class of up to c words is searched in windows of 2c words that
overlap by c, so that every occurrence lies whole in one window. The bands of a template's
sketch (see containment) retrieve windows; each retrieved window is verified by the exact
containment of the template's shingles in it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common, containment

#: Word counts that bound the classes; longer templates use the last class's windows twice as long each time.
CLASSES = (16, 64, 256, 1024)

# Public license notices and short license texts, each with the phrases that tell it
# from its relatives (families and versions share most of their words). Longer texts come as a table.
_GNU = "you can redistribute it and/or modify it under the terms of the GNU {} as published by the Free Software Foundation; either version {} of the License, or (at your option) any later version."
_BSD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
    "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. "
)
TEMPLATES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0.", ["apache license version 2"]),
    (
        "Apache-2.0",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at "
        "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, "
        "WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
        ["apache license version 2"],
    ),
    ("MIT", "Released under the MIT License.", ["the mit license"]),
    (
        "MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, "
        "including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, "
        "subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. "
        "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. "
        "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE "
        "OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
        [],
    ),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2.", ["version 2"]),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3.", ["version 3"]),
    ("GPL-2.0-or-later", "This program is free software; " + _GNU.format("General Public License", "2"), ["gnu general public license", "version 2 of"]),
    ("GPL-3.0-or-later", "This program is free software: " + _GNU.format("General Public License", "3"), ["gnu general public license", "version 3 of"]),
    ("LGPL-2.1-or-later", "This library is free software; " + _GNU.format("Lesser General Public License", "2.1"), ["gnu lesser general", "version 2 1"]),
    ("LGPL-3.0-or-later", "This library is free software: " + _GNU.format("Lesser General Public License", "3"), ["gnu lesser general", "version 3 of"]),
    ("AGPL-3.0-or-later", "This program is free software: " + _GNU.format("Affero General Public License", "3"), ["gnu affero general", "version 3 of"]),
    (
        "BSD-2-Clause",
        _BSD + "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, "
        "THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.",
        ["with the distribution this software"],
    ),
    ("BSD", _BSD, []),
    (
        "BSD-3-Clause",
        _BSD + "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
        ["neither the name of"],
    ),
    ("MPL-1.1", "The contents of this file are subject to the Mozilla Public License Version 1.1 (the \"License\"); you may not use this file except in compliance with the License.", ["license version 1 1"]),
    (
        "MPL-2.0",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
        ["public license v 2 0"],
    ),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", ["public license v 2 0"]),
    (
        "EPL-2.0",
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0",
        ["eclipse public license 2 0"],
    ),
    (
        "ISC",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
        [],
    ),
    (
        "Zlib",
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. "
        "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions",
        [],
    ),
    (
        "BSL-1.0",
        "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") "
        "to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software",
        ["person or organization obtaining"],
    ),
    ("BSL-1.0", "Distributed under the Boost Software License, Version 1.0.", ["boost software license version 1"]),
    (
        "Unlicense",
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, "
        "either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
        [],
    ),
    ("Unlicense", "This is free and unencumbered software released into the public domain.", []),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.", []),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License.", ["commons attribution 4 0"]),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", ["attribution sharealike 4 0"]),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0.", ["cc by nc 4"]),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", ["attribution noncommercial 4 0"]),
    ("CC-BY-ND-4.0", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License.", ["attribution noderivatives 4 0"]),
]


def notice_words(column: Column) -> Column:
    """Lower-cased (A-Z) words between runs of ASCII characters other than letters and digits."""
    parts = F.split(F.trim(F.regexp_replace(common.fold(F.coalesce(column, F.lit(""))), r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", " ")), " ")
    return F.filter(parts, lambda w: w != "")


def templates(spark: SparkSession) -> DataFrame:
    """(template_id, license, text, phrases)."""
    return spark.createDataFrame([(i, *t) for i, t in enumerate(TEMPLATES)], "template_id long, license string, text string, phrases array<string>")


def templates_from(spark: SparkSession, path: str, first_id: int = 10_000) -> DataFrame:
    """Whole license texts as templates: a file each under path, in any store that Spark reads, named by its license."""
    named = spark.read.text(path, wholetext=True).select(F.regexp_extract(F.input_file_name(), "([^/]+)$", 1).alias("license"), F.col("value").alias("text"))
    number = F.row_number().over(Window.orderBy("license")) + F.lit(first_id - 1)  # as many rows as licenses
    return named.select(number.cast("long").alias("template_id"), "license", "text", F.array().cast("array<string>").alias("phrases"))


def scan(docs: DataFrame, known: DataFrame, threshold: float = containment.THRESHOLD) -> DataFrame:
    """documents, templates (template_id, license, text, phrases) -> (doc_id, template_id, license, windows, first_word, containment).

    A row for each document and template of which some window holds at least the threshold of
    the distinct shingles, among them for each of its phrases one that holds it: the number of such windows, the first matching word in them (from
    0) and the largest containment. Phrases are of up to five lower-cased words; they keep a notice from matching the template of
    another version or family, of which it holds more than the threshold. Null and blank texts and null ids match nothing; rows of a
    repeated doc_id are pooled; texts are scanned whole; empty tables give no rows; other columns are ignored.
    """
    docs = docs.where("doc_id is not null").select("doc_id", "text")
    parts, probes, lengths = containment.prepare(known.select(F.col("template_id").alias("item"), "text"), notice_words)
    words = known.groupBy("template_id").agg(F.max(F.size(notice_words(F.col("text")))).alias("words"), F.min("license").alias("license"), F.min("phrases").alias("phrases"))
    half = F.lit(CLASSES[-1]) * F.ceil(F.col("words") / CLASSES[-1])
    for c in reversed(CLASSES):
        half = F.when(F.col("words") <= c, F.lit(c)).otherwise(half)
    about = containment.checked(words.select(F.col("template_id").alias("item"), "license", F.coalesce("phrases", F.array().cast("array<string>")).alias("phrases"), half.cast("long").alias("half")))

    def windowed(hits: DataFrame) -> DataFrame:
        at = F.floor(F.col("pos") / F.col("half"))
        return hits.join(about, "item").withColumn("window", F.explode(F.when(at > 0, F.array(at - 1, at)).otherwise(F.array(at))))

    found = windowed(containment.candidates(docs, probes, lengths, notice_words, threshold)).select("doc_id", "item", "window").distinct()
    found = common.stored(found, "license-windows")
    shared = containment.shared_shingles(docs, found.select("doc_id", "item"), parts, lengths, notice_words)
    told = F.filter("phrases", lambda p: F.concat(F.lit(" "), F.col("s"), F.lit(" ")).contains(F.concat(F.lit(" "), p, F.lit(" "))))
    per = windowed(shared).withColumn("told", F.explode_outer(told)).groupBy("doc_id", "item", "license", "window")
    per = per.agg(F.countDistinct("s").alias("shared"), F.max("n").alias("n"), F.min("pos").alias("pos"), F.countDistinct("told").alias("told"), F.max(F.size("phrases")).alias("phrases"))
    per = per.where((F.col("shared") >= F.ceil(F.col("n") * threshold)) & (F.col("told") == F.col("phrases"))).join(found, ["doc_id", "item", "window"], "left_semi")
    done = per.groupBy("doc_id", "item", "license").agg(F.count("*").alias("windows"), F.min("pos").cast("long").alias("first_word"), F.max(F.round(F.col("shared") / F.col("n"), 6)).alias("containment"))
    return done.withColumnRenamed("item", "template_id")


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(common.table(spark, sf_dir, "documents"), templates(spark))


_W = "list_filter(string_split_regex(translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+'), lambda x: x <> '')"
_QUOTED = lambda x: "'" + x.replace("'", "''") + "'"
_VALUES = ", ".join(f"({i}, {_QUOTED(name)}, {_QUOTED(text)}, {phrases}::VARCHAR[])" for i, (name, text, phrases) in enumerate(TEMPLATES))
SQL = f"""
WITH t AS (SELECT CAST(c0 AS BIGINT) AS template_id, c1 AS license, {_W.format('c2')} AS w, c3 AS phrases FROM (VALUES {_VALUES}) v(c0, c1, c2, c3)),
i AS (SELECT DISTINCT template_id, license, phrases, CASE WHEN len(w) <= 16 THEN 16 WHEN len(w) <= 64 THEN 64 WHEN len(w) <= 256 THEN 256 ELSE 1024 END AS half,
  unnest([array_to_string(w[j:j + 4], ' ') FOR j IN range(1, len(w) - 3)]) AS s FROM t),
n AS (SELECT template_id, count(*) AS n FROM i GROUP BY template_id),
d AS (SELECT doc_id, {_W.format('text')} AS w FROM documents WHERE text IS NOT NULL AND doc_id IS NOT NULL),
p AS (SELECT doc_id, unnest([{{'s': array_to_string(w[j:j + 4], ' '), 'pos': j - 1}} FOR j IN range(1, len(w) - 3)]) AS x FROM d WHERE len(w) >= 5),
h AS (SELECT doc_id, template_id, license, phrases, s, x.pos AS pos, x.pos // half AS a FROM p JOIN i ON x.s = i.s),
z AS (SELECT *, a AS win FROM h UNION ALL SELECT *, a - 1 AS win FROM h WHERE a > 0),
g AS (SELECT doc_id, template_id, license, phrases, win, count(DISTINCT s) AS shared, min(pos) AS pos, string_agg(DISTINCT ' ' || s || ' ', '|') AS held FROM z GROUP BY ALL)
SELECT doc_id, template_id, license, count(*) AS windows, CAST(min(pos) AS BIGINT) AS first_word, max(round(shared / n, 6)) AS containment
FROM g JOIN n USING (template_id) WHERE shared >= ceil(n * 0.8) AND len(list_filter(phrases, lambda x: NOT contains(held, ' ' || x || ' '))) = 0 GROUP BY ALL
"""

QUERIES = {"op4_license_scan": op4_license_scan}
ORACLE_SQL = {"op4_license_scan": SQL}

"""Licence scans: sparse TF-IDF cosines to templates, then the nearest ancestor directory's licence.

Texts are their lower-case words; line ends and the signs of comments are no words, so wrapped headers and
sentences inside long lines are words in a row like any others. Around every word of licences
(``MARKS``) a passage is cut for each place that the word has in a template: as long as the template, with
the word at that place. Of a file that is named like a licence (``LICENSE``, ``COPYING`` and so on) the whole
text is one more passage, for every template. Passages and templates are bags of words. Words have the inverse
document frequency of the templates, words of no template that of a word in none. A file's own licence
is that of the template with the largest cosine over its passages, if it reaches
``BAR``; ties go to the first name.

Licence files state the licence of their directory. A file without a licence of its own
gets that of the nearest directory above it that has one: all its ancestor directories
are joined with the directories' licences by path, and the longest path wins. Several
licence files of a directory: the largest cosine, then the first path.

Built from DataFrame functions only. The templates are a fixed list, so their vectors and places are
small broadcasts; a passage's words meet them where they are, and texts are never shuffled. Paths and directories
meet in a plain equi-join. Null texts have no passage, null paths no
directory; files that share a path share the best licence of them; repeated rows give repeated results.
"""

from __future__ import annotations

import math
import re
from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelspark.session import materialise

BAR = 0.6
MARKS = "license licensed licence licenced spdx redistribution redistributions unencumbered permission mozilla gnu apache dedicated commons bsd".split()
#: Templates beyond this many words are placed by the first of their marks only.
LONG = 30
NAMES = r"(^|/)(LICEN[CS]E|COPYING|COPYRIGHT|UNLICENSE)[^/]*$"
WORD = r"[a-z0-9][a-z0-9.+]*[a-z0-9+]|[a-z0-9]"

# Names and the usual words of public licences.
TEMPLATES = [
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("BSD", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("CC-BY", "Licensed under CC BY 4.0."),
    ("CC-BY", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-SA", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-SA", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC0", "To the extent possible under law, the author has dedicated all copyright to this work to the public domain. CC0 1.0 Universal."),
    ("GPL", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License"),
    ("GPL", "SPDX-License-Identifier: GPL-3.0-or-later"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("LGPL", "This library is licensed under the GNU Lesser General Public License, version 3."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT license."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    (
        "Apache-2.0",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. "
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, "
        "software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. "
        "See the License for the specific language governing permissions and limitations under the License.",
    ),
    (
        "BSD",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation "
        "and/or other materials provided with the distribution.",
    ),
    (
        "GPL",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
        "the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    ),
    (
        "ISC",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above "
        "copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED AS IS AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO "
        "THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.",
    ),
    (
        "MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), "
        "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, "
        "and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: "
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    ),
    (
        "MPL-2.0",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, "
        "You can obtain one at https://mozilla.org/MPL/2.0/.",
    ),
]


def words_of(text: str) -> list[str]:
    return re.findall(WORD, text.lower())


def frequencies(templates: list[tuple[str, str]] = TEMPLATES) -> dict[str, float]:
    """The weight of each word of the templates."""
    count = Counter(word for _, text in templates for word in set(words_of(text)))
    return {word: math.log((1 + len(templates)) / (1 + n)) + 1 for word, n in sorted(count.items())}


def unknown(templates: list[tuple[str, str]] = TEMPLATES) -> float:
    return math.log(1 + len(templates)) + 1


def vectors(templates: list[tuple[str, str]] = TEMPLATES) -> list[tuple[int, str, str, float]]:
    """(template, licence, word, weight), of unit length for each template."""
    idf, rows = frequencies(templates), []
    for i, (name, text) in enumerate(templates):
        weights = {word: times * idf[word] for word, times in Counter(words_of(text)).items()}
        norm = math.sqrt(sum(w * w for w in weights.values()))
        rows += [(i, name, word, w / norm) for word, w in sorted(weights.items())]
    return rows


def places(templates: list[tuple[str, str]] = TEMPLATES) -> list[tuple[str, int, int, int]]:
    """(mark, template, words before it, words of the template) for each place of a mark."""
    rows = []
    for i, (_, text) in enumerate(templates):
        words = words_of(text)
        found = [(w, i, j, len(words)) for j, w in enumerate(words) if w in MARKS]
        rows += found[:1] if len(words) > LONG else found
    return rows


def passages(files: DataFrame, templates: list[tuple[str, str]] = TEMPLATES) -> DataFrame:
    """(path, row, template, at, j, words) of every passage of the files (path, text): the mark's place in text and template, -1 for a whole licence file."""
    spark, reach = files.sparkSession, max(n for *_, n in places(templates))
    any_mark = "(?i)" + "|".join(sorted(MARKS))
    some = files.where(F.col("text").rlike(any_mark) | F.col("path").rlike(NAMES))
    rows = some.select("path", F.monotonically_increasing_id().alias("row"), F.regexp_extract_all(F.lower("text"), F.lit(WORD), 0).alias("words"))
    numbered = F.transform("words", lambda w, i: F.struct(w.alias("mark"), i.alias("at")))
    found = F.filter(numbered, lambda s: s["mark"].isin(MARKS))
    # the words around a mark go with it, and not the text
    around = F.transform(
        found,
        lambda s: F.struct(
            s["mark"].alias("mark"),
            s["at"].alias("at"),
            F.least(s["at"], F.lit(reach)).alias("before"),
            F.slice("words", F.greatest(s["at"] - reach, F.lit(0)) + 1, 2 * reach + 1).alias("near"),
        ),
    )
    marks = rows.select("path", "row", F.inline(around))
    where = F.broadcast(spark.createDataFrame(places(templates), "mark string, template int, j int, size int"))
    # where a text begins or ends inside the passage, the passage is shorter
    first = F.greatest(F.col("before") - F.col("j"), F.lit(0))
    cut = F.slice("near", first + 1, F.col("before") - F.col("j") + F.col("size") - first)
    inside = marks.join(where, "mark").select("path", "row", "template", "at", "j", cut.alias("words"))
    every = F.explode(F.sequence(F.lit(0), F.lit(len(templates) - 1))).alias("template")
    whole = rows.where(F.col("path").rlike(NAMES)).select("path", "row", every, F.lit(-1).alias("at"), F.lit(-1).alias("j"), "words")
    return inside.unionByName(whole)


def own_licences(files: DataFrame, templates: list[tuple[str, str]] = TEMPLATES) -> DataFrame:
    """(path, license, score): the best template of each distinct path that reaches the bar."""
    spark = files.sparkSession
    vector = F.broadcast(spark.createDataFrame([(i, w, x) for i, _, w, x in vectors(templates)], "template int, word string, weight double"))
    idf = F.broadcast(spark.createDataFrame(list(frequencies(templates).items()), "word string, idf double"))
    names = F.array(*[F.lit(name) for name, _ in templates])
    counts = F.transform(F.array_distinct("words"), lambda w: F.struct(w.alias("word"), F.size(F.filter("words", lambda x: x == w)).alias("n")))
    key = ["path", "row", "template", "at", "j"]
    words = passages(files, templates).select(*key, F.inline(counts))
    weighted = words.join(idf, "word", "left").join(vector, ["template", "word"], "left")
    w = F.col("n") * F.coalesce("idf", F.lit(unknown(templates)))
    cosine = weighted.groupBy(*key).agg(
        F.round(F.sum(w * F.coalesce("weight", F.lit(0.0))) / F.sqrt(F.sum(w * w)), 6).alias("score")
    )
    best = cosine.where(F.col("score") >= BAR).groupBy("path").agg(
        F.min(F.struct((-F.col("score")).alias("minus"), names[F.col("template")].alias("license"))).alias("best")
    )
    return best.select("path", F.col("best.license").alias("license"), (-F.col("best.minus")).alias("score"))


def directory(path: Column) -> Column:
    return F.regexp_replace(path, "/?[^/]*$", "")


def ancestors(path: Column) -> Column:
    """The directory of a path and all above it; the top is the empty string."""
    parts = F.split(directory(path), "/")
    return F.array_distinct(F.transform(F.sequence(F.lit(0), F.size(parts)), lambda k: F.array_join(F.slice(parts, 1, k), "/")))


def scan(files: DataFrame, templates: list[tuple[str, str]] = TEMPLATES) -> DataFrame:
    """(path, license, score, inherited, license_dir) for each row of ``files`` (path, text).

    ``inherited`` and ``license_dir`` are null where a file has its own licence or none is found.
    """
    own = own_licences(files.select("path", "text").where("path IS NOT NULL AND text IS NOT NULL"), templates)
    own = materialise(own, "licences")
    stated = own.where(F.col("path").rlike(NAMES)).groupBy(directory(F.col("path")).alias("license_dir"))
    of_dir = stated.agg(F.min(F.struct((-F.col("score")).alias("minus"), "path", "license")).alias("one")).select(
        "license_dir", F.col("one.license").alias("inherited")
    )
    paths = files.select("path")
    dirs = paths.where("path IS NOT NULL").select(directory(F.col("path")).alias("dir")).distinct()
    # a name behind the directory, so that the directory itself is among its ancestors
    above = dirs.select("dir", F.explode(ancestors(F.concat("dir", F.lit("/x")))).alias("license_dir"))
    nearest = above.join(of_dir, "license_dir").groupBy("dir").agg(
        F.max(F.struct(F.length("license_dir").alias("n"), "license_dir", "inherited")).alias("near")
    )
    # written, so that the join below can be split or broadcast however many files a directory has
    nearest = materialise(nearest, "directories")
    named = paths.join(own, "path", "left").withColumn("dir", directory(F.col("path"))).join(nearest, "dir", "left")
    free = F.col("license").isNull()
    return named.select(
        "path",
        "license",
        "score",
        F.when(free, F.col("near.inherited")).alias("inherited"),
        F.when(free, F.col("near.license_dir")).alias("license_dir"),
    )

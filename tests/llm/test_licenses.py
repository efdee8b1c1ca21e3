"""Licences against SQL and by hand."""

import compare

from panelspark.llm import licenses, queries, registry


def test_query_matches_sql(spark):
    sf = "/root/testdata/sf0.01"
    assert compare.compare(spark, compare.duck(sf), sf, queries.op3, registry.ORACLE["op3_license_scan"]) is None
    assert {r["license"] for r in queries.op3(spark, sf).select("license").distinct().collect()} > {"GPL", "MIT", "CC-BY-NC", "Apache-2.0"}


MIT = "MIT License\n\nPermission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"
FILES = [
    ("a/LICENSE", MIT),
    ("a/b/c/x.py", "import os"),
    ("a/b/y.py", "# Licensed under the Apache License, Version 2.0.\ncode"),
    ("a/b/COPYING.txt", "This work is licensed under the GNU General Public License, version 2."),
    ("a/z.py", "the license of this text is unclear to everyone who reads about it here"),
    ("ab/x.py", "no statement"),
    ("top.py", None),
    ("LICENSE.md", ""),
    (None, "Released under the MIT License."),
    ("a/b/c/x.py", "import os"),
    ("long/x.py", "word " * 100000 + "\nReleased under the MIT License."),
]


def test_inheritance_and_odd_files(spark):
    df = spark.createDataFrame([(p, t, "x") for p, t in FILES], "path string, text string, license string")
    got = sorted(((r["path"] or "", r["license"], r["inherited"], r["license_dir"]) for r in licenses.scan(df).collect()), key=str)
    want = [
        ("a/LICENSE", "MIT", None, None),
        ("a/b/c/x.py", None, "GPL", "a/b"),
        ("a/b/c/x.py", None, "GPL", "a/b"),
        ("a/b/y.py", "Apache-2.0", None, None),
        ("a/b/COPYING.txt", "GPL", None, None),
        ("a/z.py", None, "MIT", "a"),
        ("ab/x.py", None, None, None),
        ("top.py", None, None, None),
        ("LICENSE.md", None, None, None),
        ("", None, None, None),
        ("long/x.py", "MIT", None, None),
    ]
    assert got == sorted(want, key=str)
    assert licenses.scan(df.limit(0)).count() == 0


def test_a_licence_at_the_top_covers_all(spark):
    df = spark.createDataFrame([("LICENSE", "Released under the MIT License."), ("x.py", "a"), ("d/e/y.py", "b")], "path string, text string")
    got = {r["path"]: (r["inherited"], r["license_dir"]) for r in licenses.scan(df).collect()}
    assert got == {"LICENSE": (None, None), "x.py": ("MIT", ""), "d/e/y.py": ("MIT", "")}


MPL = "This Source Code Form is subject to the terms of the Mozilla Public\n * License, v. 2.0. If a copy of the MPL was not distributed with this\n * file, You can obtain one at https://mozilla.org/MPL/2.0/."
ISC = "Permission to use, copy, modify, and/or\n// distribute this software for any purpose\n// with or without fee is hereby granted, provided that"
HEADERS = [
    ("wrapped/mpl.c", f"/* {MPL} */\nint main() {{}}", "MPL-2.0"),
    ("wrapped/isc.c", f"// Copyright 2020 Someone\n// {ISC}\nint x;", "ISC"),
    ("inline/apache.txt", "many words stand here before it " * 30 + "licensed under the apache license, version 2.0 " + "and as many come after it " * 30, "Apache-2.0"),
    ("inline/mpl.txt", ("x y z " * 50 + MPL + " a b c" * 50).replace("\n", " "), "MPL-2.0"),
    ("edge/start.txt", "MIT license. Released", "MIT"),
    ("edge/end.txt", "code code Released under the MIT License", "MIT"),
    ("prose/a.txt", "the permission of the gnu was dedicated to the license of the commons by the apache", None),
    ("same.txt", "Released under the MIT License.", "ISC"),
    ("same.txt", f"# {ISC} the above copyright notice and this permission notice appear in all copies. " * 2, "ISC"),
]


def test_headers_wrapped_and_inside_lines(spark):
    df = spark.createDataFrame([(p, t) for p, t, _ in HEADERS[:7]] * 2, "path string, text string")
    got = {r["path"]: r["license"] for r in licenses.scan(df).collect()}
    assert got == {p: want for p, _, want in HEADERS[:7]}
    # two files with one path share the better of their licences; none's words meet the other's
    both = licenses.scan(spark.createDataFrame([(p, t) for p, t, _ in HEADERS[7:]], "path string, text string")).collect()
    assert len(both) == 2 and len({(r["license"], r["score"]) for r in both}) == 1 and both[0]["score"] > 0.95


def test_scores_against_plain_cosines(spark):
    import collections
    import math
    import random
    import re

    rnd = random.Random(3)
    pool = [w for _, t in licenses.TEMPLATES[:24] for w in licenses.words_of(t)] + ["foo", "bar", "baz"]
    texts = [" ".join(rnd.choice(pool) for _ in range(rnd.randrange(60))) for _ in range(60)]
    texts += [t.replace(" ", "\n", 3) + " tail" for _, t in licenses.TEMPLATES] + ["", "license", "x" * 10_000]
    idf, unit = licenses.frequencies(), collections.defaultdict(dict)
    for i, _, w, x in licenses.vectors():
        unit[i][w] = x

    def cosine(words, i):
        bag = {w: n * idf.get(w, licenses.unknown()) for w, n in collections.Counter(words).items()}
        norm = math.sqrt(sum(x * x for x in bag.values()))
        return round(sum(x * unit[i].get(w, 0.0) for w, x in bag.items()) / norm, 6) if norm else 0.0

    want = {}
    for d, t in enumerate(texts):
        words, best = re.findall(licenses.WORD, t.lower()), []
        for at, word in enumerate(words):
            for mark, i, j, n in licenses.places():
                if mark == word:
                    best.append((-cosine(words[max(at - j, 0) : at - j + n], i), licenses.TEMPLATES[i][0]))
        top = min(best, default=(0, None))
        if -top[0] >= licenses.BAR:
            want[f"d/{d}.txt"] = (top[1], -top[0])
    df = spark.createDataFrame([(f"d/{d}.txt", t) for d, t in enumerate(texts)], "path string, text string")
    got = {r["path"]: (r["license"], r["score"]) for r in licenses.own_licences(df).collect()}
    assert got.keys() == want.keys() and len(got) >= len(licenses.TEMPLATES)
    for path, (name, score) in want.items():
        assert got[path][0] == name and abs(got[path][1] - score) < 2e-6

import random

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from collatrix.llm import licences as L
from collatrix.llm import token_count as T
from collatrix.llm import url_filter as U

PATH = public_tokenizers.path("byte_bpe_50k.json")


def test_tokens_equal_the_library(spark):
    rng = random.Random(0)
    chars = list("ab  \n\t'sré12.,!<|>") + ["<|endoftext|>", "\u00a0", "\x1c", "日本", "😀", "ñ"]
    rows = [(i, "".join(rng.choice(chars) for _ in range(rng.randint(0, 60)))) for i in range(300)]
    rows += [(1000, None), (1001, ""), (1002, "word " * 60000), (1003, "<|endoftext|>"), (0, rows[0][1]), (None, "x")]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, n_tokens int, token int")
    got = T.count_tokens(df, PATH).collect()
    encode = T.tokenizer(PATH).encode
    want = sorted((str(i), len((t or "").encode()), len(encode(t or "", add_special_tokens=False).ids)) for i, t in rows)
    assert sorted((str(r["doc_id"]), r["n_bytes"], r["n_tokens"]) for r in got) == want
    assert T.count_tokens(df.limit(0), PATH).count() == 0


def test_frequent_lengths_are_right_and_bounded(spark):
    df = spark.createDataFrame([("alpha beta " * 50,), ("gamma",), (None,)], "text string").repartition(2)
    table = T.frequent_lengths(df, "text", PATH, phi=0.1)
    assert set(table) == {" beta", " alpha"}
    assert all(n == len(T.tokenizer(PATH).encode(k, add_special_tokens=False).ids) for k, n in table.items())


FILES = [
    (1, "r/LICENSE", "Released under the MIT License.\n\nmore text here"),
    (2, "r/a/x.py", "import os"),
    (3, "r/a/COPYING", "This work is licensed under the GNU General Public License, version 3."),
    (4, "r/a/b/y.py", "# Licensed under the Apache License, Version 2.0.\ncode"),
    (5, "r/a/b/z.py", None),
    (6, "s/q.txt", "the of this is not a licence at all, under the version of things"),
    (7, None, "Released under the MIT License."),
    (8, None, ""),
    (9, "top.txt", "x " * 60000 + "\nReleased under the MIT License."),
    (2, "r/a/x.py", "import os"),
]


def test_licences_inherit_from_the_nearest_directory(spark):
    df = spark.createDataFrame([(*f, 1, "n") for f in FILES], "id long, path string, text string, score int, dir string")
    got = {r["id"]: r for r in L.scan_licences(df, "id", F.col("path")).collect()}
    assert {i: (r["licence"], r["origin"], r["from_dir"]) for i, r in got.items()} == {
        1: ("MIT", "own", None),
        2: ("GPL-3.0", "inherited", "r/a"),
        3: ("GPL-3.0", "own", None),
        4: ("Apache-2.0", "own", None),
        5: ("GPL-3.0", "inherited", "r/a"),
        6: (None, "none", None),
        7: ("MIT", "own", None),
        8: (None, "none", None),
        9: ("MIT", "own", None),
    }
    assert L.scan_licences(df, "id", F.col("path")).count() == len(FILES)
    assert L.scan_licences(df.limit(0), "id", F.col("path")).count() == 0


def test_lines_without_key_terms_cannot_reach_the_threshold():
    model = L.NoticeModel(L.TEMPLATES, {"the": 90, "is": 80, "license": 5}, 100)
    for name, vector in model.vectors.items():
        rest = sum(w * w for t, w in vector.items() if t not in model.key_terms) ** 0.5
        assert rest < model.least, name
    for name, text in L.TEMPLATES.items():
        assert model.best(text)[1] == name
        assert model.best(f"// {text.upper()}")[1] == name
    assert model.best("the of and is this") is None


GPL = """/* frob.c - frobnicates
 *
 * Frob is free software; you can redistribute it and/or
 * modify it under the terms of the GNU General Public License
 * as published by the Free Software Foundation; either version {v}
 * of the License, or (at your option) any later version.
 *
 * Frob is distributed in the hope that it will be useful,
 * but WITHOUT ANY WARRANTY; without even the implied warranty of
 * MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
 * GNU General Public License for more details.
 */
int main(void) {{ return 0; }}
"""
MIT = """Copyright (c) 2019 A. N. Author and others

Permission is hereby granted, free of charge, to any person
obtaining a copy of this program and its documentation (the
"Program"), to deal in the Program without restriction, including
without limitation the rights to use, copy, modify, merge, publish,
distribute, sublicense, and/or sell copies of the Program, and to
permit persons to whom the Program is furnished to do so, subject
to the following conditions:

The above copyright notice and this permission notice shall be
included in all copies or substantial portions of the Program.

THE PROGRAM IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND,
EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF
MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND
NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY
CLAIM, DAMAGES OR OTHER LIABILITY."""


def test_headers_texts_and_tags_are_found_however_they_are_wrapped(spark):
    apache = (L.TEXTS / "Apache-2.0.txt").read_text().split()
    bsd = {k: " ".join((L.TEXTS / f"BSD-{k}-Clause.txt").read_text().split()).replace("PURPOSE", "USE") for k in (2, 3)}
    want = {
        "# SPDX-License-Identifier: MIT\nimport os": "MIT",
        "/* SPDX-License-Identifier: apache-2.0 */": "Apache-2.0",
        "// SPDX-License-Identifier: GPL-2.0-or-later": "GPL-2.0",
        "# SPDX-License-Identifier: (MIT OR EUPL-1.2)": "MIT OR EUPL-1.2",
        "# SPDX-License-Identifier: EPL-2.0": "EPL-2.0",
        "# SPDX-License-Identifier: NONE": None,
        "MIT License\n\nCopyright (c) me": "MIT",
        "The MIT License (MIT)": "MIT",
        "Apache License\n   Version 2.0, January 2004": "Apache-2.0",
        "Licensed under the MIT license. See LICENSE in the project root.": "MIT",
        "Licensed under the Foo license. See LICENSE in the project root.": None,
        "x = 1\n# Released under\n# the MIT License.\n" + "y = 2\n" * 500: "MIT",
        GPL.format(v=2): "GPL-2.0",
        GPL.format(v=3): "GPL-3.0",
        GPL.format(v=3).replace("GNU General", "GNU Affero General"): "AGPL-3.0",
        "import sys\n" * 300 + GPL.format(v=2): "GPL-2.0",
        MIT: "MIT",
        "\n".join(" ".join(apache[i : i + 7]) for i in range(0, len(apache), 7)): "Apache-2.0",
        f"Copyright (c) 1999, someone\n{bsd[2]}": "BSD-2-Clause",
        f"Copyright (c) 1999, someone\n{bsd[3]}": "BSD-3-Clause",
        "Er kam mit\nMit\nmit uns": None,
        "a merge of the software is permitted, without any warranty, under the terms of the new contract": None,
    }
    df = spark.createDataFrame([(i, f"{i}/f.c", x) for i, x in enumerate(want)] + [(1000 + i, f"{i}/g.c", "the is of and in a 2 to " * 9) for i in range(40)], "id long, path string, text string")
    got = {r["id"]: r["licence"] for r in L.scan_licences(df, "id", F.col("path")).collect()}
    assert {x: got[i] for i, x in enumerate(want)} == want


def plain_match(rules, host, path):
    best = None
    for verdict, rule in rules:
        h, p = U.split_rule(rule)
        if (host == h or host.endswith("." + h)) and path.startswith(p):
            rank = (h.count("."), len(p), verdict == "block")
            if best is None or rank > best[0]:
                best = (rank, verdict, h + p)
    return best and best[1:]


def test_trie_equals_plain_matching(spark):
    rng = random.Random(0)
    hosts = ["com", "a.com", "b.a.com", "net", "x.net", "localhost"]
    paths = ["", "/", "/en", "/en/", "/en/x", "/e", "//", "/en/x/y"]
    rules = [(rng.choice(["allow", "block"]), rng.choice(hosts) + rng.choice(paths)) for _ in range(25)]
    trie = U.UrlTrie(rules)
    urls = [None, "", "no scheme", "http://", "http://A.com/en/x?q#f", "https://b.a.com", "x://net//", "http://c.b.a.com/en/x/y/z", "a://b://c/d", "http://a.com?x=/en/"]
    urls += ["http://" + rng.choice(["", "w.", "ww.w."]) + rng.choice(hosts) + rng.choice(paths) + rng.choice(["", "x", "?q", "#f"]) for _ in range(200)]
    for u in urls:
        assert trie.match(*U.split_url(u)) == plain_match(rules, *U.split_url(u)), u
    df = spark.createDataFrame([(i, u, "r", 1) for i, u in enumerate(urls)], "page_id long, url string, rule string, key int")
    a = sorted(map(str, U.filter_urls(df, rules).collect()))
    listed = spark.createDataFrame(rules, "verdict string, rule string").distinct()
    assert sorted(map(str, U.join_urls(df, listed).collect())) == a
    assert U.filter_urls(df.limit(0), rules).count() == 0
    with pytest.raises(ValueError, match="join_urls"):
        U.filter_urls(df, rules, max_rules=3)

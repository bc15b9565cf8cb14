import math
import random
import re

import pytest

from itemloom.llm import covertree, license, urls
from itemloom.llm.components import components


def duck(tables: dict, sql: str):
    import duckdb

    c = duckdb.connect()
    for name, arrow in tables.items():
        c.register(name, arrow)
    r = c.sql(sql)
    cols = sorted(r.columns)
    return cols, sorted(map(repr, r.select(*[f'"{x}"' for x in cols]).fetchall()))


def rows_of(df):
    cols = sorted(df.columns)
    return cols, sorted(map(repr, map(tuple, df.select(*cols).collect())))


# ---------------------------------------------------------------- components


@pytest.mark.parametrize("shape", ["chain", "star", "random", "none"])
def test_components(spark, shape):
    r = random.Random(1)
    edges = {"chain": [(k, k + 1) for k in range(60)], "star": [(7, k) for k in range(80)], "random": [(r.randrange(120), r.randrange(120)) for _ in range(70)], "none": []}[shape] + [(5, 5), (None, 3)] * (shape != "none")
    got = {x.node: x.label for x in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    near = {}
    for a, b in edges:
        if a is not None and a != b:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    want = {}
    for n in near:
        seen, todo = {n}, [n]
        while todo:
            for m in near[todo.pop()] - seen:
                seen.add(m)
                todo.append(m)
        want[n] = min(seen)
    assert got == want


# ---------------------------------------------------------------- URLs

LINK = '<link rel="canonical" href="{}">'
PAGES = [
    (1, "https://a.net/x", ""),
    (2, "https://www.example.net/en/1", ""),
    (3, "http://EXAMPLE.com/de/q?x#y", ""),
    (4, "https://b.org/fr/", None),
    (5, None, "<html>"),
    (6, "no scheme", LINK.format("https://a.net/x")),
    (7, "https://c.org/p", LINK.format("https://a.net/x")),  # its canonical page is blocked
    (8, "https://c.org/p2", '<meta http-equiv="refresh" content="0; url=https://c.org/p">'),  # and so is what redirects to it
    (9, "https://d.org/p", LINK.format("https://www.example.com/de/1")),  # blocked, but
    (10, "https://d.org/q", LINK.format("https://d.org/p") + LINK.format("https://x.org/fr/y")),  # an allowed one in the group
    (11, "https://e.org/z", LINK.format("/w")),
    (12, "http://e.org/w#frag", LINK.format("https://net")),
    (13, "https://f.net/", LINK.format("https://x.org/fr/y")),  # its own rule wins
    (7, "https://c.org/p", LINK.format("https://a.net/x")),
]


def test_redirect_equivalence(spark):
    df = spark.createDataFrame([(*p, "x", "y") for p in PAGES], "page_id long, url string, html string, label string, node string")
    got = {r.page_id: r for r in urls.op7(df).collect()}
    want = {1: "block", 2: "allow", 3: "block", 4: "allow", 5: "allow", 6: "allow", 7: "block", 8: "block", 9: "allow", 10: "allow", 11: "block", 12: "block", 13: "block"}
    # 12 calls https://net canonical: its path is "/", which the rule for net fits
    assert {k: r.verdict for k, r in got.items()} == want
    assert (got[3].host, got[3].path, got[3].rule) == ("example.com", "/de/q", "example.com/de/") and got[5].host == got[6].path == ""
    assert urls.op7(df).count() == len(PAGES)
    assert urls.op7(df.where("false")).count() == 0


def test_redirect_equivalence_against_sql(spark):
    pages = [p for p in PAGES if p[1] is None or "://" in p[1]]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    assert rows_of(urls.op7(df)) == duck({"pages": df.toArrow()}, urls.op7_sql())


def test_redirect_log(spark):
    pages = spark.createDataFrame([(1, "https://a.org/1", None)], "page_id long, url string, html string")
    log = spark.createDataFrame([("http://a.org/1", "https://b.org/2"), ("https://b.org/2", "https://c.net/3")], "source string, target string")
    assert urls.judged_pages(pages, redirects=log).first().verdict == "block"


def plain_node(url):
    """A page's name: host, path without dot segments, query; and its host and path as the contract reads them."""
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.split("[/?#]", rest)[0]
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    path = re.split("[?#]", rest[len(host) :])[0]
    query = rest[len(host) + len(path) :].split("#")[0]
    steps, out = path.split("/")[1:], []
    for x in steps:
        if x == "..":
            out = out[:-1]
        elif x != ".":
            out.append(x)
    normal = "/" + "/".join(out) + ("/" if steps and steps[-1] in (".", "..") and out else "")
    return low, path, (low + normal + query if low else None)


def plain_verdicts(pages, rules, log):
    def rule(host, path):
        fit = [(-len(h + p), h, p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
        return min(fit)[1:] if fit and host else None

    near = {}
    for a, b in log:
        a, b = (plain_node(x)[2] if x else None for x in (a, b))
        if a and b:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    out = []
    for i, url in pages:
        host, path, node = plain_node(url)
        own, seen, todo = rule(host, path), {node}, [node] if node else []
        while todo:
            for m in near.get(todo.pop(), set()) - seen:
                seen.add(m)
                todo.append(m)
        votes = [r[2] for n in seen if n and (r := rule(n.split("/")[0], "/" + n.split("/", 1)[1].split("?")[0]))]
        normal = rule(host, "/" + node.split("/", 1)[1].split("?")[0]) if node else None
        passed = "block" if "block" in votes and "allow" not in votes else "allow"
        out.append((i, host, path, own[0] + own[1] if own else None, (own or normal or (0, 0, passed))[2]))
    return sorted(out, key=repr)


@pytest.mark.parametrize("seed", [1, 2])
def test_redirects_against_brute_force(spark, seed):
    """Random pages, rules and a log with a huge component, nulls and repeats; the rules are a table of 1500."""
    r = random.Random(seed)
    hosts = [f"{a}.{b}" for a in ("x", "y.x", "Z", "w.Z") for b in ("net", "com", "org")]
    url = lambda: r.choice(["http", "https"]) + "://" + r.choice(hosts) + r.choice(["", "/", "/a", "/a/b", "/a/../c", "/./a/", "/c?q=1", "/a/b#f", "/b/.."])
    rules = list({(r.choice(["net", "x.net", "com", "z.com", "y.x.org"]).lower(), r.choice(["/", "/a", "/a/b", "/c", "/b/"]), r.choice(["block", "allow"])) for _ in range(14)}) + [(f"h{k}.example", f"/{k}", "block") for k in range(1500)]
    pages = [(k, url()) for k in range(150)] + [(900, None), (901, "no scheme"), (902, "http://"), (3, "http://q.h7.example/7/8")]
    hub = url()
    log = [(url(), url()) for _ in range(12)] + [(f"http://x.net/p{k}", hub) for k in range(60)] + [(None, hub), (hub, None), ("bad", hub)]
    log += log[:5]
    pages += [(1000 + k, f"https://x.net/p{k}") for k in range(60)]
    df = spark.createDataFrame([(i, u, None) for i, u in pages], "page_id long, url string, html string")
    table = spark.createDataFrame([*rules, *rules[:3], (None, "/", "block")], "host string, path string, verdict string")
    got = urls.judged_pages(df, table, spark.createDataFrame(log, "source string, target string"))
    assert sorted(map(tuple, got.collect()), key=repr) == plain_verdicts(pages, rules, log)


def test_relative_links(spark):
    pages = [(1, "https://c.org/d/p?x", LINK.format("?y")), (2, "https://c.org/d/e/q", LINK.format("../p?y")), (3, "https://c.org/d/r", LINK.format("./../../../z")), (4, "https://b.net/d/p?y", LINK.format("//c.org/d/p?y")), (5, "http://c.org/z", LINK.format("#top"))]
    got = {x.page_id: x.verdict for x in urls.op7(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert got == {1: "block", 2: "block", 3: "allow", 4: "block", 5: "allow"}
    bare = [(1, "http://x.net", None), (2, "http://x.net/", None), (3, "http://x.net?q", None)]
    got = {x.page_id: (x.rule, x.verdict) for x in urls.op7(spark.createDataFrame(bare, "page_id long, url string, html string")).collect()}
    assert got == {1: (None, "block"), 2: ("net/", "block"), 3: (None, "block")}


# ---------------------------------------------------------------- search


def vectors(spark, n=700, seed=2):
    r = random.Random(seed)
    rows = [(k, [r.choice([r.gauss(0, 1), 0.5]) for _ in range(8)], k % 3) for k in range(n)]
    rows += [(1000 + k, rows[5][1], 0) for k in range(40)]  # equal vectors, ties
    rows += [(2000, None, 0), (2100, [1.0, None] * 4, 0), (2200, [math.nan] * 8, 0), (2300, [math.inf] * 8, 0), (None, [1.0] * 8, 0), (2400, [1.0, 2.0], 0), (2401, [1.0, -2.0], 0), (2500, [], 0)]
    return spark.createDataFrame([(i, v, x, 1, 2) for i, v, x in rows], "vec_id long, embedding array<float>, label int, score int, rank int")


def brute(df, k=10, every=100):
    rows = [(r.vec_id, [math.floor(1024 * x) for x in r.embedding]) for r in df.collect() if r.vec_id is not None and r.embedding is not None and all(x is not None and math.isfinite(x) for x in r.embedding)]
    out = []
    for q, v in rows:
        if q % every == 0:
            scored = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), i) for i, w in rows if i != q and len(w) == len(v))[:k]
            out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scored)]
    return sorted(out)


@pytest.mark.parametrize("block_rows,group_rows", [(8192, 2048), (100, 3)])
def test_top_k_is_exact(spark, block_rows, group_rows):
    df = vectors(spark)
    got = sorted(map(tuple, covertree.top_k(df, block_rows=block_rows, group_rows=group_rows).collect()))
    assert got == brute(df)
    assert covertree.op8(df.where("false")).count() == 0


def clustered(n=3000, seed=3):
    import numpy as np

    g = np.random.default_rng(seed)
    return np.floor(1024 * (g.normal(size=(30, 16))[g.integers(0, 30, n)] * 3 + 0.05 * g.normal(size=(n, 16))))


@pytest.mark.parametrize("which", ["random", "clustered", "equal", "one", "line"])
def test_cover_tree_is_one(which):
    """Nesting, covering and separation of each level; nodes hold their children's points within their radius."""
    import numpy as np

    p = {"random": np.random.default_rng(1).normal(size=(600, 4)), "clustered": clustered(), "equal": np.ones((50, 3)), "one": np.ones((1, 3)), "line": np.arange(400.0)[:, None] ** 2}[which]
    t = covertree.CoverTree(p, leaf=4)
    for (scale, net), (_, above) in zip(t.nets[1:], t.nets, strict=False):
        assert net[: len(above)].tolist() == above.tolist()
        apart = np.sqrt(((p[net][:, None] - p[net][None]) ** 2).sum(2)) + np.diag([np.inf] * len(net))
        assert apart.min() > scale
        assert np.sqrt(((p[:, None] - p[net][None]) ** 2).sum(2)).min(1).max() <= scale + 1e-9
    assert sorted(t.place.tolist()) == list(range(len(p))) and (t.points == p[t.place]).all()
    for n, kids in enumerate(t.children):
        own = t.points[t.start[n] : t.end[n]]
        assert len(own) and np.sqrt(((own - t.centres[n]) ** 2).sum(1)).max() <= t.radius[n] + 1e-9
        if len(kids):
            assert len(kids) > 1 and t.start[kids].min() == t.start[n] and t.end[kids].max() == t.end[n] and (t.end[kids] - t.start[kids]).sum() == t.end[n] - t.start[n]
    assert len(t.nets) > 3 or which in ("random", "equal", "one")


def test_clustered_vectors_are_pruned(spark):
    """Pairs of groups and blocks that are left, and scores that a dual search computes, stay far below all."""
    import numpy as np

    p = clustered()
    tree, asked = covertree.CoverTree(p), covertree.CoverTree(p[::100])
    s = covertree.Searcher(asked, asked.points.astype(int), np.arange(len(asked.points)) + 10**6, 10)
    s.meet(tree, tree.points.astype(int), [np.array([i]) for i in tree.place])
    assert s.compared < 0.2 * len(p) * len(asked.points)
    df = spark.createDataFrame([(k, (x / 1024).tolist()) for k, x in enumerate(p)], "vec_id long, embedding array<double>")
    blocks, groups, _, left = covertree.search_plan(df, block_rows=100, group_rows=3)
    assert left.count() < 0.2 * blocks.count() * groups.count()
    assert sorted(map(tuple, covertree.top_k(df, block_rows=100, group_rows=3).collect())) == brute(df)


def test_large_components_never_wrap(spark):
    df = spark.createDataFrame([(k, [float((-1) ** k * (k + 1) * 2**19), 3.0]) for k in range(0, 5)], "vec_id long, embedding array<double>")
    assert sorted(map(tuple, covertree.op8(df).collect())) == brute(df)
    far = spark.createDataFrame([(k, [2.0**30 * (k + 1)]) for k in range(3)], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="does not fit a long"):
        covertree.op8(far).collect()


# ---------------------------------------------------------------- licences


def test_license_scan(spark):
    rows = [
        (1, "p/LICENSE", "Released under the MIT License."),
        (2, "p/src/a.py", "no header"),
        (3, "p/src/b.py", "# Licensed under the Apache License, Version 2.0\ncode"),
        (4, "p/src/vendor/COPYING.txt", "This work is licensed under the GNU General Public License, version 3."),
        (5, "p/src/vendor/deep/er/c.py", ""),
        (6, "q/d.py", None),
        (7, "p/readme", "We talk about the license of other people at some length and nothing else here at all"),
        (None, "p/x", "text"),
        (8, None, "Released under the MIT License."),
        (9, "top.txt", "x"),
    ]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "file_id long, path string, text string, licence int, term int")
    got = {r.file_id: (r.licence, r.origin, r.from_directory) for r in license.scan(df).collect()}
    assert got == {
        1: ("MIT", "own", None),
        2: ("MIT", "inherited", "p"),
        3: ("Apache-2.0", "own", None),
        4: ("GPL-3.0", "own", None),
        5: ("GPL-3.0", "inherited", "p/src/vendor"),
        6: (None, None, None),
        7: ("MIT", "inherited", "p"),
        None: ("MIT", "inherited", "p"),
        8: (None, None, None),
        9: (None, None, None),
    }
    assert license.scan(df.where("false")).count() == 0


COMMON = "/usr/share/common-licenses/"
COMMENTED = lambda text: "\n".join(" * " + x for x in text.split("\n"))


def wrapped(text, width=70):
    import textwrap

    return "\n".join(textwrap.wrap(text, width))


def test_real_licences_are_found(spark):
    """Headers in comments, whole files, identifiers, and files of the system's own licence texts where it has them."""
    import os

    from itemloom.llm.licence_texts import HEADERS, TEXTS

    cases = [(f"// SPDX-License-Identifier: {x}", want) for x, want in (("MIT", "MIT"), ("Apache-2.0", "Apache-2.0"), ("GPL-2.0-or-later", "GPL-2.0"), ("BSD-3-Clause", "BSD-3-Clause"))]
    cases += [("/*\n" + COMMENTED("Copyright (C) 2020 Jane Doe <jane@doe.example>\n\n" + wrapped(text)) + "\n */\n\nint main() { return 0; }\n", licence) for licence, text in HEADERS]
    cases += [("Copyright 2019 The Authors\n\n" + "\n\n".join(wrapped(x + ".") for x in text.split(". ", 1)), licence) for licence, text in TEXTS if len(text) > 500]
    cases += [("MIT License\n\nCopyright (c) 2020 Jane", "MIT"), ("Copyright (c) 2020 Jane Doe. All rights reserved.", "Proprietary"), ("                 Apache License\n           Version 2.0, January 2004\n        http://www.apache.org/licenses/\n\nterms", "Apache-2.0")]
    cases += [("This text speaks of a license, of copyright and of permission to read, at some length, as novels do.", None), ("We like the public domain very much and would tell more about it", None)]
    for name, want in (("GPL-2", "GPL-2.0"), ("GPL-3", "GPL-3.0"), ("LGPL-2.1", "LGPL-2.1"), ("LGPL-3", "LGPL-3.0"), ("Apache-2.0", "Apache-2.0"), ("MPL-2.0", "MPL-2.0"), ("CC0-1.0", "CC0-1.0")):
        if os.path.exists(COMMON + name):
            with open(COMMON + name) as f:
                cases.append((f.read(), want))
    df = spark.createDataFrame([(k, f"d{k}/f", t) for k, (t, _) in enumerate(cases)], "file_id long, path string, text string")
    got = {x.file_id: x.licence for x in license.scan(df).collect()}
    assert [(k, got[k], want, t[:60]) for k, (t, want) in enumerate(cases) if got[k] != want] == []


#: Notices as files carry them, each with the words "All rights reserved".
RESERVED = [
    ("Copyright (c) 2020 Name. All rights reserved.\n\nLicensed under the MIT License. See License.txt in the project root for license information.", "MIT"),
    ("// Copyright (c) Some Corporation. All rights reserved.\n// Licensed under the MIT License.", "MIT"),
    ("# Copyright 2015 The Authors. All Rights Reserved.\n#\n# Licensed under the Apache License, Version 2.0 (the \"License\");\n# you may not use this file except in compliance with the License.\n# You may obtain a copy of the License at\n#\n#     http://www.apache.org/licenses/LICENSE-2.0\n", "Apache-2.0"),
    ("/* Copyright (C) 2001 Jane Doe. All rights reserved.\n *\n * This Source Code Form is subject to the terms of the Mozilla Public\n * License, v. 2.0. If a copy of the MPL was not distributed with this\n * file, You can obtain one at http://mozilla.org/MPL/2.0/.\n */", "MPL-2.0"),
    ("Copyright (c) 2009 The Go Authors. All rights reserved.\n\nSPDX-License-Identifier: BSD-3-Clause", "BSD-3-Clause"),
    ("All rights reserved.\n\nSPDX-License-Identifier: GPL-2.0-only", "GPL-2.0"),
    ("Copyright 2021 A. All rights reserved.\n\nThis work is licensed under the GNU General Public License, version 3.", "GPL-3.0"),
    ("Copyright 2021 A. All rights reserved.\n\nReleased under the ISC License.", "ISC"),
    ("Copyright 2021 A. All rights reserved.", "Proprietary"),
]


def test_a_copyright_line_gives_way(spark):
    """In a file's own licence and in that of its directory."""
    df = spark.createDataFrame([(k, f"d{k}/LICENSE", t) for k, (t, _) in enumerate(RESERVED)] + [(100 + k, f"d{k}/src/a.c", "x") for k in range(len(RESERVED))], "file_id long, path string, text string")
    got = {x.file_id: x.licence for x in license.scan(df).collect()}
    assert [(k, got[k], got[100 + k]) for k in range(len(RESERVED))] == [(k, w, w) for k, (_, w) in enumerate(RESERVED)]
    docs = spark.createDataFrame([(64 * k, t, "en", "s") for k, (t, _) in enumerate(RESERVED)], "doc_id long, text string, lang string, source string")
    assert rows_of(license.op3(docs)) == duck({"documents": docs.toArrow()}, license.op3_sql())


def test_license_query_against_sql(spark):
    from itemloom.llm.licence_texts import TEXTS

    bsd = "x\n\n" + "\n \n".join(wrapped(x) for x in TEXTS[1][1].split(": "))
    texts = ["x\nReleased under the MIT License.", "Licensed under CC BY-NC 4.0.\ny", "plain", "Copyright. All rights reserved.\n \n", "a license", "", bsd, "a\n\n# Released under the MIT\n# License.\n\nb"]
    df = spark.createDataFrame([(k, texts[k % 8] if k % 50 else None, ["en", "fr"][k % 2], "s" if k < 300 else None) for k in range(500)], "doc_id long, text string, lang string, source string")
    assert rows_of(license.op3(df)) == duck({"documents": df.toArrow()}, license.op3_sql())

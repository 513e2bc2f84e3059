"""Graph construction, analytics, co-change and communities on small fixtures."""

import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from weftgraph.extract import files as parsers
from weftgraph.operators import analytics, build, cochange, communities
from weftgraph.sources import gitlog

NODE = "file_seq int, emit_seq int, id string, name string, kind string, file_path string, language string, docstring string, signature string, decorators array<string>"
EDGE = "file_seq int, emit_seq int, source string, target string, relation string, confidence string"


def nodes_of(spark, rows):
    return spark.createDataFrame([(*r, "python", doc, sig, []) for *r, doc, sig in rows], NODE)


@pytest.fixture(scope="module")
def raw(spark):
    nodes = nodes_of(
        spark,
        [
            (0, 0, "a.py:0", "a", "module", "src/a.py", "", ""),
            (0, 1, "a.py:1", "Foo", "class", "src/a.py", "Own.", ""),
            (0, 2, "a.py:2", "__init__", "constructor", "src/a.py", "Makes.", "(self)"),
            (0, 3, "a.py:9", "X", "variable", "src/a.py", "", ""),
            (0, 4, "a.py:10", "bar", "function", "src/a.py", "", "()"),
            (1, 0, "b.py:0", "b", "module", "src/b.py", "", ""),
            (1, 1, "b.py:5", "Baz", "class", "src/b.py", "", ""),
            (1, 2, "a.py:1", "Late", "class", "src/b.py", "", ""),
        ],
    )
    edges = spark.createDataFrame(
        [
            (0, 0, "a.py:0", "a.py:1", "defines", "EXTRACTED"),
            (0, 1, "a.py:1", "a.py:2", "defines", "EXTRACTED"),
            (0, 2, "a.py:0", "a.py:9", "defines", "EXTRACTED"),
            (0, 3, "a.py:0", "a.py:10", "defines", "EXTRACTED"),
            (0, 4, "a.py:10", "*::class::Foo", "calls", "INFERRED"),
            (0, 5, "a.py:2", "*::bar", "calls", "INFERRED"),
            (0, 6, "a.py:0", "*::module::requests", "imports", "EXTRACTED"),
            (1, 0, "b.py:0", "b.py:5", "defines", "EXTRACTED"),
            (1, 1, "b.py:5", "*::class::Foo", "inherits", "EXTRACTED"),
            (1, 2, "b.py:5", "nowhere:1", "calls", "EXTRACTED"),
        ],
        EDGE,
    )
    return nodes, edges


def test_build_and_merge(raw):
    nodes, edges = build.build(*raw)
    found = {(r.source, r.target): (r.relation, r.confidence) for r in edges.collect()}
    assert found["a.py:10", "a.py:1"] == ("calls", "EXTRACTED") and found["b.py:5", "a.py:1"] == ("inherits", "EXTRACTED")
    assert found["a.py:0", "external::requests"] == ("imports", "INFERRED") and ("b.py:5", "nowhere:1") not in found
    assert found["dir::src", "a.py:0"][0] == "contains"
    assert {r.id: r.label for r in nodes.collect()}["a.py:1"] == "Foo"
    merged, rest = build.merge_small(nodes, edges)
    by = {r.id: r for r in merged.collect()}
    assert "a.py:2" not in by and "a.py:9" not in by and "external::requests" not in by
    assert by["a.py:1"].signature == "(self)" and by["a.py:1"].docstring == "Own.\n\nMakes." and by["a.py:0"].merged_members == ["X"]
    assert ("a.py:1", "a.py:10") in {(r.source, r.target) for r in rest.collect()}


def test_parsed_project_builds(spark):
    rows = [
        ("auth.py", "python", '"""Auth."""\nimport os\n\n\nclass Auth:\n    def login(self, user):\n        return check(user)\n\n\ndef check(user):\n    return bool(user)\n'),
        ("broken.py", "python", "def f(:\nclass Foo(Bar):\n"),
        ("conf.yaml", "yaml", "a:\n  b: 1\nc: [1, 2]\n"),
        ("x.toml", "toml", "[t]\nk = 1\n"),
        ("main.tf", "terraform", 'resource "aws_instance" "web" {\n  ami = var.image\n}\nvariable "image" {}\n'),
        ("README.md", "markdown", "# One\n## Two\n[a](auth.md)\n"),
        ("a.go", "go", "package a"),
        ("bad.json", "json", "{"),
        (None or "p.html", "html", "<h1>T <b>x</b></h1><a href='other.html'>o</a>"),
    ]
    df = spark.createDataFrame([(p, lang, c, k) for k, (p, lang, c) in enumerate(rows)], "path string, language string, content string, seq int")
    nodes, edges = build.build(*parsers.extract(df))
    names = {(r.file_path, r.kind, r.label) for r in nodes.collect()}
    assert {("auth.py", "method", "Auth.login"), ("broken.py", "class", "Foo"), ("conf.yaml", "section", "a.b"), ("x.toml", "section", "t.k"), ("main.tf", "resource", "resource.aws_instance.web"), ("README.md", "section", "Two"), ("a.go", "module", "a"), ("bad.json", "document", "bad"), ("p.html", "section", "T x")} <= names
    assert ("auth.py:6", "auth.py:10") in {(r.source, r.target) for r in edges.filter("relation = 'calls'").collect()}


def random_graph(seed, n, m):
    rng = random.Random(seed)
    return [f"v{k:02d}" for k in range(n)], sorted({(f"v{a:02d}", f"v{b:02d}") for a, b in ((rng.randrange(n), rng.randrange(n)) for _ in range(m)) if a != b})


def frames(spark, ids, edges):
    return spark.createDataFrame([(i,) for i in ids], "id string"), spark.createDataFrame(edges, "source string, target string")


def bfs(edges, start, both):
    near = {}
    for a, b in edges:
        near.setdefault(a, set()).add(b)
        if both:
            near.setdefault(b, set()).add(a)
    dist, front = {start: 0}, [start]
    while front:
        front = [w for v in front for w in near.get(v, ()) if dist.setdefault(w, dist[v] + 1) == dist[v] + 1]
        front = list(dict.fromkeys(front))
    return dist


def test_components_and_paths(spark):
    ids, edges = random_graph(1, 40, 32)
    nodes, e = frames(spark, ids, edges)
    got = {r.id: r.component for r in analytics.component_labels(nodes, e).collect()}
    assert got == {i: min(bfs(edges, i, True)) for i in ids}
    seeds = spark.createDataFrame([("v01",), ("v02",)], "id string")
    near = {(r.seed, r.id): r.distance for r in analytics.bounded_paths(e, seeds, 3).collect()}
    assert near == {(s, i): d for s in ("v01", "v02") for i, d in bfs(edges, s, True).items() if d <= 3}


def test_betweenness(spark):
    ids, edges = random_graph(2, 14, 30)
    nodes, e = frames(spark, ids, edges)
    expected = dict.fromkeys(ids, 0.0)
    out = {i: bfs(edges, i, False) for i in ids}

    def paths(a, b):
        if a == b:
            return [[a]]
        return [[*p, b] for x, y in edges if y == b and out[a].get(x) == out[a][b] - 1 for p in paths(a, x)]

    for a, b in itertools.permutations(ids, 2):
        if b in out[a]:
            every = paths(a, b)
            for p in every:
                for v in p[1:-1]:
                    expected[v] += 1 / len(every)
    got = {r.id: r.betweenness for r in analytics.betweenness(nodes, e).collect()}
    assert all(math.isclose(got[i], expected[i] / (13 * 12), abs_tol=1e-9) for i in ids)


def test_pagerank_sums_to_one_and_ranks(spark):
    nodes, e = frames(spark, ["a", "b", "c", "d"], [("a", "c"), ("b", "c"), ("c", "d")])
    got = {r.id: r.pagerank for r in analytics.pagerank(nodes, e).collect()}
    assert math.isclose(sum(got.values()), 1, abs_tol=1e-6) and got["d"] > got["c"] > got["a"]


def test_seed_subgraph(spark):
    e = spark.createDataFrame([("a", "m", "defines"), ("m", "b", "co_change"), ("x", "y", "calls")], "source string, target string, relation string")
    between, kept, alone = analytics.seed_subgraph(e, ["a", "b", "x"])
    assert between == ["m"] and set(kept) == {("a", "defines", "m"), ("m", "co_change", "b")} and alone == ["x"]
    assert analytics.seed_subgraph(e, ["a"]) == ([], [], [])


def commits(spark, rows):
    return spark.createDataFrame([(str(k), 1_700_000_000 + 86_400 * k, f"m{k}", f) for k, files in enumerate(rows) for f in files], "hash string, ts long, message string, file string")


def test_cochange(spark):
    found = cochange.pairs(commits(spark, [["a", "b"]] * 3 + [["a", "c"]])).collect()
    assert [(r.a, r.b, r.support, r.strength, r.confidence) for r in found] == [("a", "b", 3, round(3 / math.sqrt(12), 4), "INFERRED")]
    assert cochange.pairs(commits(spark, [["a", "b"]] * 2)).count() == 0
    assert cochange.pairs(commits(spark, [[f"f{k}" for k in range(50)]] * 3)).count() == 0
    six = cochange.pairs(commits(spark, [["a", "b"]] * 6), messages=2).first()
    assert six.confidence == "EXTRACTED" and len(six.sample_messages) == 2
    edges = spark.createDataFrame([("a", "b", "calls", "EXTRACTED")], "source string, target string, relation string, confidence string")
    new = cochange.enrich(edges, cochange.pairs(commits(spark, [["a", "b"]] * 3))).collect()
    assert {(r.source, r.target, r.relation) for r in new} == {("a", "b", "co_change"), ("b", "a", "co_change")}


def test_log_and_renames(spark):
    text = "\x1e\nabc\n1700000000\nfirst\n\nM\tx.py\nR100\tv1.py\tv2.py\n\x1e\ndef\nbad\nsecond\n\nM\ty.py\n\x1e\nfff\n1700000001\nempty\n"
    found, renames = gitlog.parse(spark, text)
    assert {(r.hash, r.file) for r in found.collect()} == {("abc", "x.py"), ("abc", "v2.py")}
    assert [(r.old, r.new) for r in renames.collect()] == [("v1.py", "v2.py")]
    chain = spark.createDataFrame([(1, "v1", "v2"), (2, "v2", "v3"), (3, "a", "b"), (4, "b", "a")], "seq int, old string, new string")
    got = {r.old: r.new for r in cochange.resolve_renames(chain).collect()}
    assert got["v1"] == got["v2"] == "v3" and {"a", "b"} <= set(got)


def test_long_and_circular_renames(spark):
    rows = [(k, f"p{k}", f"p{k + 1}") for k in range(300)] + [(1, "x", "y"), (2, "y", "a"), (3, "a", "b"), (4, "b", "c"), (5, "c", "a")]
    got = {r.old: r.new for r in cochange.resolve_renames(spark.createDataFrame(rows, "seq int, old string, new string")).collect()}
    assert got == {f"p{k}": "p300" for k in range(300)} | {"x": "c", "y": "c", "a": "c", "b": "a", "c": "b"}
    assert cochange.resolve_renames(spark.createDataFrame([], "seq int, old string, new string")).count() == 0


def test_betweenness_query_takes_customers(spark, tmp_path):
    from weftgraph.plans.graph_queries import betweenness

    tables = {
        "region": ([(0, "R")], "r_regionkey int, r_name string"),
        "nation": ([(0, "A", 0), (1, "B", 0)], "n_nationkey int, n_name string, n_regionkey int"),
        "supplier": ([(0, "S", 0)], "s_suppkey long, s_name string, s_nationkey int"),
        "customer": ([(k, "C", 0) for k in range(3)], "c_custkey long, c_name string, c_nationkey int"),
    }
    for name, (rows, shape) in tables.items():
        spark.createDataFrame(rows, shape).write.parquet(f"file://{tmp_path}/{name}.parquet")
    got = {r.id: r.betweenness for r in betweenness(spark, f"file://{tmp_path}").collect()}
    # of 6 x 5 ordered pairs, with s0 -> r0 -> n0 -> (s0, c0, c1, c2) and r0 -> n1
    assert got == {"n0": 0.233333, "r0": 0.2, "s0": 0.066667} | dict.fromkeys(["n1", "c0", "c1", "c2"], 0.0)


def modularity(edges, part, gamma=1.0):
    m = len(edges)
    deg, inside = {}, 0
    for a, b in edges:
        inside += part[a] == part[b]
        for x in (a, b):
            deg[part[x]] = deg.get(part[x], 0) + 1
    return inside / m - gamma * sum(d * d for d in deg.values()) / (4 * m * m)


def test_communities(spark):
    cliques = [[f"{c}{k}" for k in range(5)] for c in "abc"]
    edges = [p for c in cliques for p in itertools.combinations(c, 2)] + [("a0", "b0"), ("b1", "c1")]
    nodes, e = frames(spark, sorted(sum(cliques, [])), edges)
    rows = communities.levels(nodes, e, resolutions=(0.25, 1.0), filter_hubs=False).collect()
    fine = {r.id: r.community for r in rows if r.level == 1}
    assert len(set(fine.values())) == 3 and modularity(edges, fine) > 0.5
    again = communities.levels(nodes, e, resolutions=(0.25, 1.0), filter_hubs=False).collect()
    assert sorted(map(str, rows)) == sorted(map(str, again))
    full = nodes.withColumns({"label": F.upper("id"), "kind": F.lit("class"), "file_path": F.concat(F.lit("src/"), F.substring("id", 1, 1), F.lit(".py"))})
    members = spark.createDataFrame([r for r in rows if r.level == 1]).select("community", "id")
    text = {r.community: r.summary for r in communities.summaries(full, e, members).collect()}
    assert text["a0"].startswith("Contains 5 classs. Key elements: A0") and "Files: a.py." in text["a0"]
    assert len(communities.labels(full, e, members, 3).first().label.split(", ")) == 3

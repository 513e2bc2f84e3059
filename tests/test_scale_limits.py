"""Chains, paths and logs longer than any fixed number of rounds."""

import subprocess
import time

import pytest

from weftgraph.operators import analytics, build, cochange, communities, retrieval
from weftgraph.operators import components as connected
from weftgraph.operators.components import components
from weftgraph.sources import files, gitlog


def test_rename_chain_of_a_thousand(spark):
    rows = [(k, f"p{k}", f"p{k + 1}") for k in range(1000)]
    got = {r.old: r.new for r in cochange.resolve_renames(spark.createDataFrame(rows, "seq long, old string, new string")).collect()}
    assert len(got) == 1000 and set(got.values()) == {"p1000"}


@pytest.mark.parametrize("small", [500_000, 100])
def test_components_of_a_long_path(spark, monkeypatch, small):
    monkeypatch.setattr(connected, "SMALL", small)
    edges = spark.range(10_000).selectExpr("(id * 7919) % 10007 as a", "((id + 1) * 7919) % 10007 as b")
    got = components(edges)
    assert got.count() == 10_000 and got.select("component").distinct().count() == 1
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("small", [500_000, 3])
def test_components_of_random_graphs(spark, monkeypatch, small):
    import random

    monkeypatch.setattr(connected, "SMALL", small)
    rng = random.Random(5)
    pairs = [(f"n{rng.randrange(300):03d}", f"n{rng.randrange(300):03d}") for _ in range(170)]
    label = {}
    for a, b in pairs:
        old, new = label.get(a, a), label.get(b, b)
        label |= {a: old, b: new}
        label = {k: min(old, new) if v in (old, new) else v for k, v in label.items()}
    got = {r.node: r.component for r in components(spark.createDataFrame(pairs, "a string, b string")).collect()}
    assert got == {k: v for k, v in label.items() if k != v}


def test_chain_of_small_nodes(spark):
    kinds = ["class"] + ["property"] * 40
    nodes = spark.createDataFrame([(f"n{k:02d}", f"l{k}", kind, "f.py") for k, kind in enumerate(kinds)] + [("x", "x", "variable", "f.py"), ("y", "y", "variable", "f.py"), ("t", "t", "function", "g.py")], "id string, label string, kind string, file_path string")
    edges = [(f"n{k:02d}", f"n{k + 1:02d}", "defines", "EXTRACTED") for k in range(40)] + [("x", "y", "defines", "EXTRACTED"), ("y", "x", "defines", "EXTRACTED"), ("n40", "t", "calls", "INFERRED")]
    merged, kept = build.merge_small(nodes, spark.createDataFrame(edges, "source string, target string, relation string, confidence string"))
    assert sorted(r.id for r in merged.collect()) == ["n00", "t"]  # x and y define each other
    assert [(r.source, r.target) for r in kept.collect()] == [("n00", "t")]


@pytest.mark.parametrize("stem", [False, True])
def test_postings_score_as_a_scan(spark, stem):
    rows = [(f"d{k}", f"Running handler_{k % 5} of the auth handler {'login ' * (k % 7)}", "handled logins" if k % 3 else None) for k in range(60)]
    df = spark.createDataFrame(rows, "id string, a string, b string")
    index = retrieval.postings(df, columns=["a", "b"], stem=stem).cache()
    for terms in (["handler", "logins"], ["auth handler"], ["auth_handler", "handler_3"], ["nothing"], ["---"], []):
        plain = [(r.id, round(r.score, 9)) for r in retrieval.bm25(df, terms, 30, columns=["a", "b"], stem=stem).collect()]
        assert [(r.id, round(r.score, 9)) for r in retrieval.bm25_indexed(index, terms, 30, stem=stem).collect()] == plain


def test_log_of_a_subfolder(spark, tmp_path):
    run = lambda *a: subprocess.run(["git", "-c", "user.name=n", "-c", "user.email=e@x.org", "-C", str(tmp_path), *a], check=True, capture_output=True)
    run("init", "-q")
    (tmp_path / "sub").mkdir()
    for k in range(4):
        for name in ("sub/a.py", "sub/b.py", "other.py"):
            (tmp_path / name).write_text(f"x = {k}\n")
        run("add", "-A")
        run("commit", "-q", "-m", f"step {k}")
    folder = str(tmp_path / "sub")
    assert gitlog.is_repository(folder) and gitlog.prefix(folder) == "sub" and gitlog.prefix(str(tmp_path)) == ""
    blocks = gitlog.stage_log(spark, folder)
    commits, _ = gitlog.parse_blocks(blocks)
    plain, _ = gitlog.parse(spark, gitlog.read_log(folder))
    assert sorted(map(tuple, commits.drop("seq").collect())) == sorted(map(tuple, plain.drop("seq").collect()))
    inside = gitlog.scope(commits, "sub")
    assert {r.file for r in inside.collect()} == {"a.py", "b.py"}
    found = cochange.pairs(inside)
    assert [(r.a, r.b, r.support) for r in found.collect()] == [("a.py", "b.py", 4)]
    assert cochange.commit_context(found, 2).filter("id = 'b.py'").first().context == "commits: step 3; step 2"
    assert gitlog.stage_log(spark, str(tmp_path.parent / "nowhere")) is None and not gitlog.is_repository("/")


def test_pairs_are_the_strongest_first(spark):
    rows = [(c, 1000 + c, f"m{c}", f) for c in range(6) for f in (["a", "b"] + (["c"] if c % 2 else []) + (["d"] if c < 4 else []))]
    got = [r.strength for r in cochange.pairs(spark.createDataFrame(rows, "hash long, ts long, message string, file string")).collect()]
    assert len(got) > 3 and got == sorted(got, reverse=True)


def test_listing_beyond_the_drivers_share(spark, tmp_path):
    for k in range(12):
        p = tmp_path / f"d{k % 3}" / f"e{k}" / "__init__.py"
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text("x = 1\n")
    few, all_ = (sorted(map(tuple, files.listing(spark, str(tmp_path), n).collect())) for n in (2, 100))
    assert few == all_ and len(all_) == 12 and all_[0][1].endswith("__init__.py")


def test_communities_without_refinement_and_by_node(spark):
    ring = [(f"a{k}", f"a{(k + j) % 5}") for k in range(5) for j in (1, 2)] + [(f"b{k}", f"b{(k + j) % 5}") for k in range(5) for j in (1, 2)] + [("a0", "b0")]
    edges = spark.createDataFrame([(*e, "calls", "EXTRACTED") for e in ring], "source string, target string, relation string, confidence string")
    nodes = spark.createDataFrame([(x, x, "function") for x in sorted({n for e in ring for n in e})], "id string, label string, kind string")
    members = communities.single_level(nodes, edges)
    assert members.select("community").distinct().count() == 2 and members.count() == 10
    by = {r.id: r.communities for r in communities.of_nodes(members).collect()}
    assert by["a3"] == ["a0"] and by["b3"] == ["b0"]
    inner, links = communities.subgraph(nodes, edges, members, "a0")
    assert inner.count() == 5 and links.count() == 10


def test_betweenness_by_joins_equals_the_kernel(spark):
    import random

    rng = random.Random(3)
    edges = spark.createDataFrame([(f"n{rng.randrange(40)}", f"n{rng.randrange(40)}", "calls") for _ in range(90)] + [("n1", "gone", "calls")], "source string, target string, relation string")
    nodes = spark.createDataFrame([(f"n{k}",) for k in range(42)], "id string")
    for pivots in (None, 7):
        plain = {r.id: round(r.betweenness, 9) for r in analytics.betweenness(nodes, edges, pivots).collect()}
        assert {r.id: round(r.betweenness, 9) for r in analytics.betweenness(nodes, edges, pivots, most_edges=5).collect()} == plain
    assert max(plain.values()) > 0 and analytics.joined_betweenness(nodes, edges.limit(0)).count() == 42


def test_seed_subgraph_on_the_driver_equals_the_joins(spark):
    import random

    rng = random.Random(9)
    rows = [(f"n{rng.randrange(60)}", f"n{rng.randrange(60)}", rng.choice(["calls", "defines"])) for _ in range(80)]
    edges = spark.createDataFrame(rows, "source string, target string, relation string")
    near = analytics.Adjacency.of(edges)
    assert analytics.Adjacency.of(edges, 10) is None
    for _ in range(4):
        seeds = [f"n{rng.randrange(64)}" for _ in range(6)]
        assert analytics.seed_subgraph(edges, seeds, 4, near) == analytics.seed_subgraph(edges, seeds, 4)


def test_communities_of_components_beyond_a_task(spark, monkeypatch):
    import itertools

    cliques = [[f"c{g}x{k}" for k in range(6)] for g in range(8)]
    pairs = [p for c in cliques for p in itertools.combinations(c, 2)] + [(cliques[g][0], cliques[(g + 1) % 8][1]) for g in range(8)]
    edges = spark.createDataFrame([(a, b, "calls", "EXTRACTED") for a, b in pairs], "source string, target string, relation string, confidence string")
    nodes = spark.createDataFrame([(x, x, "function") for c in cliques for x in c], "id string, label string, kind string")
    sets = lambda: {(k, frozenset(r.id for r in rows)) for (k, _), rows in ((g, list(x)) for g, x in itertools.groupby(sorted(communities.levels(nodes, edges, (0.25, 1.0), filter_hubs=False).collect(), key=lambda r: (r.level, r.community)), key=lambda r: (r.level, r.community)))}
    plain = sets()
    assert {frozenset(c) for c in cliques} == {s for k, s in plain if k == 1}
    for most in (60, 5):  # finished by the kernel, and by moves alone
        monkeypatch.setattr(communities, "MOST_PAIRS", most)
        found = sets()
        assert {s for k, s in found if k == 1} == {frozenset(c) for c in cliques}
        assert sum(len(s) for k, s in found if k == 0) == 48


def test_stream_keeps_the_newest(spark, tmp_path):
    import datetime

    from weftgraph.streaming import incremental
    from weftgraph.store import GraphStore

    shape = "path string, version string, ts timestamp, content string"
    at = lambda k: datetime.datetime(2024, 1, 1 + k)
    store, source = GraphStore(spark, f"file://{tmp_path}/store"), f"file://{tmp_path}/in"
    assert incremental.load(store).count() == 0
    parts = [[("a", "1", at(0), "x"), ("b", "1", at(3), "y")], [("a", "2", at(1), "z"), ("b", "0", at(2), "late")], [("c", "1", at(0), "w")]]
    for rows in parts:
        spark.createDataFrame(rows, shape).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(shape).parquet(source)
        incremental.follow(stream, store, f"file://{tmp_path}/progress", compact_every=2).awaitTermination()
    got = {r.path: r.version for r in incremental.load(store).collect()}
    assert got == {"a": "2", "b": "1", "c": "1"} and store.load("versions").count() == 2


def test_watch_brings_the_store_up_to_date(spark, tmp_path):
    from weftgraph.store import GraphStore
    from weftgraph.streaming import incremental

    src = tmp_path / "src"
    src.mkdir()
    (src / "a.py").write_text("def f():\n    pass\n")
    query = incremental.watch(spark, str(src), f"file://{tmp_path}/store", f"file://{tmp_path}/progress", every="1 second")
    store, began = GraphStore(spark, f"file://{tmp_path}/store"), time.time()
    try:
        while store.get_meta("source_dir") is None and time.time() - began < 240:
            assert query.exception() is None
            time.sleep(1)
        labels = {r.label for r in store.load("nodes").collect()}
    finally:
        query.stop()
    assert {"a", "f"} <= labels


def test_betweenness_of_nodes_alike(spark):
    """Classes of nodes with the same arcs count as one, pivots inside a class too; against the joins, which know no classes."""
    edges = [(f"h{k}", f"{c}{j}") for k in range(4) for j in range(30) for c in "ab" if (k + (c == "b")) % 2] + [(f"a{j}", f"t{j % 3}") for j in range(30)]
    edges += [(f"t{k}", f"h{k}") for k in range(3)] + [("h0", "h1"), ("h3", "h3"), ("h3", "gone"), ("h2", "a1"), ("h2", "a1")]
    df = spark.createDataFrame([(*e, "calls") for e in edges], "source string, target string, relation string")
    nodes = spark.createDataFrame([(x,) for x in sorted({y for e in edges for y in e} - {"gone"}) + ["alone", "lone", "h1"]], "id string")
    for pivots in (None, 50):
        plain = {r.id: round(r.betweenness, 9) for r in analytics.joined_betweenness(nodes, df, pivots).collect()}
        assert {r.id: round(r.betweenness, 9) for r in analytics.betweenness(nodes, df, pivots).collect()} == plain
        assert max(plain.values()) > 0


def test_passes_of_betweenness_do_not_grow_with_nodes_alike(spark, monkeypatch, tmp_path):
    kernel, log = analytics._brandes, tmp_path / "passes"

    def counted(pivots, *rest):
        with log.open("a") as f:
            f.write("x" * len(pivots))
        return kernel(pivots, *rest)

    monkeypatch.setattr(analytics, "_brandes", counted)
    edges = spark.range(600).selectExpr("concat('h', id % 3) as source", "concat('s', id) as target").union(spark.range(600).selectExpr("concat('s', id)", "concat('h', (id + 1) % 3)"))
    nodes = edges.select("source").distinct().withColumnRenamed("source", "id")
    got = {r.id: r.betweenness for r in analytics.betweenness(nodes, edges, None).collect()}
    assert len(got) == 603 and len({round(v, 12) for v in got.values()}) == 2
    assert len(log.read_text()) == 6  # of 603 pivots


def test_postings_are_made_without_a_shuffle(spark, tmp_path):
    texts = ["b a b c", None, "", "--", "a", "c c c a"]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "id long, text string").repartition(2)
    index = retrieval.postings(df)
    plan = index._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == df._jdf.queryExecution().executedPlan().toString().count("Exchange")
    got = sorted((r.id, r.term, r.field, r.places, r["size"], r.docs, r.mean) for r in index.collect())
    mean = 9 / 6
    assert got == [(0, "a", 0, [1], 4, 6, mean), (0, "b", 0, [0, 2], 4, 6, mean), (0, "c", 0, [3], 4, 6, mean), (4, "a", 0, [0], 1, 6, mean), (5, "a", 0, [3], 4, 6, mean), (5, "c", 0, [0, 1, 2], 4, 6, mean)]
    index.write.parquet(f"file://{tmp_path}/index")
    for part in tmp_path.glob("index/*.parquet"):
        terms = [r.term for r in spark.read.parquet(f"file://{part}").collect()]
        assert terms == sorted(terms)
    assert retrieval.postings(df.limit(0)).count() == 0

"""Text functions, retrieval, scanning, store and exports."""

import json
import sqlite3
import xml.etree.ElementTree as ET

import pytest
from pyspark.sql import functions as F

from weftgraph import export
from weftgraph.functions import text
from weftgraph.operators import retrieval
from weftgraph.sources import files
from weftgraph.store import GraphStore

ROWS = [("auth_handler running", "x y"), ("zeta", "handler"), ("foo", "bar"), ("q", "r"), ("s", "t")]


def fts(query):
    db = sqlite3.connect(":memory:")
    db.execute("CREATE VIRTUAL TABLE t USING fts5(a, b, tokenize='porter unicode61')")
    db.executemany("INSERT INTO t VALUES (?, ?)", ROWS)
    return {i - 1: -s for i, s in db.execute("SELECT rowid, bm25(t) FROM t WHERE t MATCH ? ORDER BY bm25(t)", (query,))}


@pytest.mark.parametrize(("terms", "query"), [(["handler", "run"], '"handler" OR "run"'), (["auth_handler"], '"auth_handler"')])
def test_bm25_equals_full_text_index(spark, terms, query):
    df = spark.createDataFrame([(k, *r) for k, r in enumerate(ROWS)], "id long, a string, b string")
    got = {r.id: r.score for r in retrieval.bm25(df, terms, columns=["a", "b"], stem=True).collect()}
    assert got == pytest.approx(fts(query))


def test_stems_equal_full_text_index():
    words = "caresses ponies ties cats feed agreed plastered motoring sing conflated troubled sized hopping falling hissing filing happy sky relational conditional rational digitizer operator feudalism decisiveness hopefulness formality sensitivity triplicate formative electrical hopeful goodness revival allowance inference adjustable replacement adoption communism activate effective bowdlerize probate rate cease controll roll generalization oscillators".split()
    db = sqlite3.connect(":memory:")
    db.execute("CREATE VIRTUAL TABLE t USING fts5(a, tokenize='porter unicode61')")
    db.executemany("INSERT INTO t VALUES (?)", [(w,) for w in words])
    db.execute("CREATE VIRTUAL TABLE v USING fts5vocab(t, instance)")
    stems = dict(db.execute("SELECT doc, term FROM v"))
    stem = text.Porter()
    assert {w: stem(w) for w in words} == {w: stems[k + 1] for k, w in enumerate(words)}


def test_vectors_and_fusion(spark):
    df = spark.createDataFrame([("a", [1.0, 0.0, 0.0]), ("b", [0.9, 0.1, 0.0]), ("c", [0.0, 0.0, 1.0]), ("z", [0.0, 0.0, 0.0])], "id string, vector array<double>")
    assert [r.id for r in retrieval.vector_topk(df, [1.0, 0.0, 0.0], 2).collect()] == ["a", "b"]
    lists = {"x": [("a", 0.9), ("b", 0.5)], "y": [("b", 0.7), ("c", 0.1)]}
    signals = {k: spark.createDataFrame(v, "id string, score double") for k, v in lists.items()}
    got = {r.id: r for r in retrieval.rrf(signals).collect()}
    assert got["b"].score == pytest.approx(1 / 62 + 1 / 61) and set(got["b"].contributions) == {"x", "y"}
    assert retrieval.query_terms("The quick auth_handler, is at it") == ["quick", "auth_handler,"]


def test_scripts(spark):
    df = spark.createDataFrame([("Hello 123!",), ("안녕 世界",), ("Привет",), ("مرحبا",), ("",), (None,)], "t string")
    got = [tuple(r) for r in df.select(*[c.alias(n) for n, c in text.script_counts(F.col("t")).items()]).collect()]
    assert got == [(5, 0, 0, 0), (0, 4, 0, 0), (0, 0, 6, 0), (0, 0, 0, 5), (0, 0, 0, 0), (0, 0, 0, 0)]


def test_scan(spark, tmp_path):
    for name, body in {"main.py": "x = 1", "util.js": "let a", ".git/config": "x", "big.py": "x" * 2_000_000, "prod.env": "A=1", "vendor/lib.py": "x", "empty.py": "", "pic.bin": "x", ".gitignore": "*.js\n!util.js\n", ".graphignore": "vendor/\n"}.items():
        p = tmp_path / name
        p.parent.mkdir(exist_ok=True)
        p.write_text(body)
    got = {r.path: r.skip_reason for r in files.scan(spark, str(tmp_path)).collect()}
    assert got["main.py"] is None and got["util.js"] is None and got[".git/config"] == "ignored" and got["big.py"] == "too_large"
    assert got["prod.env"] == "sensitive" and got["vendor/lib.py"] == "tool_ignore" and got["empty.py"] == "empty" and got["pic.bin"] == "unsupported"
    assert files.manifest(files.scan(spark, str(tmp_path))).count() == 2


def test_store_and_exports(spark, tmp_path):
    nodes = spark.createDataFrame([("a", "A", "class", 0.5), ("b", "B", "function", 0.1)], "id string, label string, kind string, pagerank double")
    edges = spark.createDataFrame([("a", "b", "defines")], "source string, target string, relation string")
    store = GraphStore(spark, f"file://{tmp_path}/store")
    store.save_graph(nodes, edges)
    store.save_graph(nodes.limit(1).unionByName(nodes.filter("id = 'b'")).distinct(), edges)
    assert store.load("nodes").count() == 2 and store.load("edges").count() == 1 and store.load("communities") is None
    store.set_meta("version", "1")
    store.set_meta("version", "2")
    assert store.get_meta("version") == "2" and store.get_meta("none", "d") == "d"
    vec = spark.createDataFrame([("a", [1.0]), ("b", [2.0])], "node_id string, vector array<double>")
    store.save_embeddings(vec)
    store.save_embeddings(vec.filter("node_id = 'a'"))
    assert store.load("embeddings").count() == 2 and store.embedded_ids().count() == 2
    d3 = json.loads(export.d3_json(nodes.drop("pagerank"), edges, nodes.select("id", "pagerank")))
    size = {n["id"]: n["size"] for n in d3["nodes"]}
    assert d3["metadata"] == {"node_count": 2, "link_count": 1, "kind_groups": {"class": 0, "function": 1}} and size["a"] == 20 > size["b"]
    assert len(ET.fromstring(export.graphml(nodes, edges))[-1]) == 3
    assert len(json.loads(export.node_link_json(nodes, edges))["links"]) == 1 and "<canvas" in export.page(json.dumps(d3))
    odd = nodes.unionByName(spark.createDataFrame([('c"&<', "é < & > \x01", "class", None)], nodes.schema))
    export.graphml_to(odd, edges, f"file://{tmp_path}/xml")
    parts = sorted(p for p in (tmp_path / "xml").iterdir() if p.suffix == ".txt")
    tree = ET.fromstring("\n".join(p.read_text() for p in parts if p.stat().st_size))
    assert len(tree[-1]) == 4 and {n.get("id") for n in tree[-1] if n.tag.endswith("node")} == {"a", "b", 'c"&<'}
    export.node_link(nodes, edges, f"file://{tmp_path}/json")
    assert spark.read.json(f"file://{tmp_path}/json/links").count() == 1
    store.clean()
    assert store.load("nodes") is None

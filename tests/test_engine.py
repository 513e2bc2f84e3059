"""A small project from files to answers."""

import json

import pytest

from weftgraph import cli
from weftgraph.engine import Engine, build_graph_store
from weftgraph.store import resolve

FILES = {
    "auth.py": '"""Login."""\nimport os\n\nLIMIT = 3\n\n\nclass AuthHandler:\n    """Handles logins."""\n\n    def __init__(self, store):\n        self.store = store\n\n    def login(self, user):\n        return check(user)\n\n\ndef check(user):\n    """Checks a user."""\n    return bool(user)\n',
    "pkg/__init__.py": "",
    "pkg/server.py": "from auth import AuthHandler\n\n\nclass Server(AuthHandler):\n    def start(self):\n        return check(1)\n",
    "README.md": "# App\n## Install\n[auth](auth.md)\n",
}


def test_build_search_and_rebuild(spark, tmp_path):
    src, out = tmp_path / "src", f"file://{tmp_path}/store"
    for name, text in FILES.items():
        p = src / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(text)
    first = build_graph_store(spark, str(src), out)
    assert first["parsed"] == 3 and first["nodes"] > 8
    engine = Engine(spark, out)
    labels = {r.label for r in engine.nodes.collect()}
    assert {"AuthHandler", "check", "Server", "Install"} <= labels and "LIMIT" not in labels
    found = engine.search("check login handler", top=4)
    assert found.seeds and found is engine.search("check login handler", top=4) and found.text().startswith("seeds:")
    assert engine.keyword("checks user").first().id == "auth.py:17"
    assert all(engine.doctor().values()) and engine.stats().count() > 5
    (src / "pkg/server.py").write_text(FILES["pkg/server.py"] + "\n\ndef extra():\n    return check(2)\n")
    again = build_graph_store(spark, str(src), out, incremental=True)
    assert again["parsed"] == 1
    engine = Engine(spark, out)
    assert ("pkg/server.py:9", "auth.py:17") in {(r.source, r.target) for r in engine.edges.collect()}
    assert build_graph_store(spark, str(src), out, incremental=True)["parsed"] == 0


@pytest.fixture(scope="module")
def built(spark, tmp_path_factory):
    src = tmp_path_factory.mktemp("tree")
    more = {"latin.py": b"# caf\xe9\ndef coffee():\n    return check(1)\n", "doc.pdf": b"%PDF-1.4 \xff", "Dog.java": b"class Dog extends Animal {\n  void bark() { check(1); }\n}\n"}
    for name, text in FILES.items():
        (src / name).parent.mkdir(parents=True, exist_ok=True)
        (src / name).write_text(text)
    for name, data in more.items():
        (src / name).write_bytes(data)
    build_graph_store(spark, str(src), str(src / ".weftgraph"))
    return src


def test_other_bytes_and_languages(spark, built):
    engine = Engine(spark, str(built / ".weftgraph"))
    labels = {r.label for r in engine.nodes.collect()}
    assert {"coffee", "Dog", "Dog.bark", "doc"} <= labels


def test_searches_of_all_ways(spark, built):
    calls = []

    def encoder(kind):
        from weftgraph.operators import embedding

        plain = embedding.hashing_encoder()
        return lambda texts: calls.append(kind) or plain(texts)

    engine = Engine(spark, str(built / ".weftgraph"), {"code": encoder("code"), "text": encoder("text")}, {"code": "c", "text": "e5-t"})
    assert engine.keyword("checks user").first().id == "auth.py:17"
    assert engine.keyword('checks" user').collect()  # by the scan
    engine.search("check login", top=3)
    assert calls == ["code", "text"]
    engine.search("check login", top=4)
    assert calls == ["code", "text"]  # vectors of a query are kept
    engine.search("login handler", fast=True)
    assert calls == ["code", "text", "text"]
    found = engine.search("check login handler", top=6)
    assert {"from", "to", "rel"} == set(engine.result_edges(found).columns)
    d3 = json.loads(engine.export("d3"))
    assert any(link["value"] != 1.0 for link in d3["links"])
    metrics = {r.metric: r.value for r in engine.stats().collect()}
    assert metrics["embeddings"] > 3 and metrics["communities"] >= 1
    community = engine.communities().first().community
    assert engine.community_graph(community)[0].count() >= 2


def test_tool_server(spark, built):
    import io

    from weftgraph.serve import serve

    ask = lambda k, method, **params: json.dumps({"jsonrpc": "2.0", "id": k, "method": method, "params": params})
    lines = [ask(1, "initialize"), json.dumps({"jsonrpc": "2.0", "method": "notifications/initialized"}), ask(2, "tools/list"), "no json", ask(3, "other")]
    lines += [ask(4, "tools/call", name=n, arguments=a) for n, a in (("search", {"query": "check login"}), ("node", {"id": "auth.py:17"}), ("stats", {}), ("communities", {}), ("search", {}), ("none", {}))]
    out = io.StringIO()
    serve(spark, str(built / ".weftgraph"), io.StringIO("\n".join(lines) + "\n"), out)
    got = [json.loads(x) for x in out.getvalue().splitlines()]
    assert len(got) == 10 and {t["name"] for t in got[1]["result"]["tools"]} == {"search", "node", "stats", "communities", "build"}
    assert got[2]["error"]["code"] == -32700 and got[3]["error"]["code"] == -32601
    assert got[4]["result"]["content"][0]["text"].startswith("seeds:") and all(not r["result"]["isError"] for r in got[4:8])
    assert json.loads(got[5]["result"]["content"][0]["text"])["found"] and [r["error"]["code"] for r in got[8:]] == [-32602] * 2
    missing = io.StringIO()
    serve(spark, str(built / "nowhere"), io.StringIO(ask(1, "tools/call", name="stats", arguments={}) + "\n"), missing)
    assert json.loads(missing.getvalue())["result"]["isError"]


def test_command_line(spark, built, capsys, monkeypatch):
    monkeypatch.setattr(cli, "session", lambda: spark)
    monkeypatch.chdir(built / "pkg")
    assert resolve(None) == str(built / ".weftgraph") and resolve("/no/such") is None

    def run(*argv):
        code = cli.main(list(argv))
        return code, capsys.readouterr().out

    assert run("search", "check login", "--fast")[1].startswith("seeds:")
    for command in (["search-vector", "check"], ["search-keyword", "check"], ["search-graph", "check"], ["search-community", "check"], ["stats"], ["communities"], ["export", "--format", "d3"], ["node", "auth.py:17"], ["doctor"]):
        code, out = run(*command)
        assert code == 0 and json.loads(out.strip().splitlines()[0]) is not None, command
    assert "<canvas" in run("visualize", "--offline")[1]
    code, out = run("--store", "/no/such", "stats")
    assert code == 1 and "error" in json.loads(out)
    code, out = run("build", str(built), "-o", str(built / "other"), "--lang", "en")
    assert code == 0 and json.loads(out)["files"] == 6
    assert run("--store", str(built / "other"), "clean", "-y")[0] == 0 and run("--store", str(built / "other"), "stats")[0] == 1

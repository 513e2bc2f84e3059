"""Command line: ``python -m weftgraph.cli COMMAND``."""

from __future__ import annotations

import argparse
import json
import os
import sys

from weftgraph.engine import Engine, build_graph_store
from weftgraph.operators import embedding
from weftgraph.serve import serve
from weftgraph.session import session
from weftgraph.store import FOLDER, GraphStore, resolve


def shown(df) -> str:
    return json.dumps([r.asDict(recursive=True) for r in df.collect()], separators=(",", ":"), default=str)


# Fixed value: names that --model knows, by model type; other encoders are given to the library as functions.
MODELS = {"hashing": embedding.hashing_encoder}


def main(argv: list[str] | None = None) -> int:
    """Run one command; an error is one line of JSON and exit code 1."""
    try:
        return run(argv)
    except Exception as error:
        print(json.dumps({"error": str(error).split("\n")[0]}, separators=(",", ":")))
        return 1


def run(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="weftgraph")
    parser.add_argument("--store", help="folder of the store; without it the nearest .weftgraph here or above")
    commands = parser.add_subparsers(dest="command", required=True)
    b = commands.add_parser("build")
    b.add_argument("source_dir")
    b.add_argument("--incremental", action="store_true")
    b.add_argument("--max-file-size", type=int, default=1_000_000)
    b.add_argument("-o", "--output", help="folder of the new store")
    b.add_argument("--model", choices=sorted(MODELS), default="hashing")
    b.add_argument("--lang", choices=["auto", "en", "multilingual"], default="auto", help="language of the texts, noted in the store")
    for name in ("search", "search-vector", "search-keyword", "search-graph", "search-community"):
        s = commands.add_parser(name)
        s.add_argument("query")
        s.add_argument("--top-k", type=int, default=30)
        if name in ("search", "search-vector"):
            s.add_argument("--fast", action="store_true", help="one encoder call")
    commands.add_parser("stats")
    commands.add_parser("doctor")
    commands.add_parser("clean").add_argument("-y", "--yes", action="store_true")
    commands.add_parser("query")
    commands.add_parser("serve", help="answer tool calls on standard input and output")
    c = commands.add_parser("communities")
    c.add_argument("--level", type=int)
    c.add_argument("--search", default="")
    e = commands.add_parser("export")
    e.add_argument("--format", choices=["json", "graphml", "d3"], default="json")
    e.add_argument("-o", "--output", help="folder that the executors write to (json, graphml), for large graphs")
    v = commands.add_parser("visualize")
    v.add_argument("--max-nodes", type=int, default=500)
    v.add_argument("--offline", action="store_true", help="the page never loads anything, so this is how it always is")
    n = commands.add_parser("node")
    n.add_argument("id")
    a = parser.parse_args(argv)
    spark = session()
    if a.command == "build":
        target = a.output or a.store or os.path.join(a.source_dir, FOLDER)
        encoders = {kind: MODELS[a.model]() for kind in ("code", "text")}
        counts = build_graph_store(spark, a.source_dir, target, a.incremental, most_bytes=a.max_file_size, encoders=encoders, models=dict.fromkeys(encoders, a.model))
        GraphStore(spark, target).set_meta("lang", a.lang)
        print(json.dumps(counts, separators=(",", ":")))
        return 0
    if a.command == "serve":
        serve(spark, resolve(a.store) or a.store or FOLDER)
        return 0
    where = resolve(a.store)
    if where is None or GraphStore(spark, where).load("nodes") is None:
        raise LookupError(f"no graph in {a.store or FOLDER}")
    if a.command == "clean":
        if not a.yes and input(f"remove {where}? [y/N] ").strip().lower() != "y":
            return 1
        GraphStore(spark, where).clean()
        return 0
    engine = Engine(spark, where)
    source = engine.store.get_meta("source_dir", "")
    if a.command == "search":
        print(engine.search(a.query, a.top_k, fast=a.fast).text(source))
    elif a.command == "query":
        for line in sys.stdin:
            word, _, rest = line.strip().partition(" ")
            if word == ":quit":
                break
            print(shown(engine.stats()) if word == ":stats" else shown(engine.node(rest)[0]) if word == ":node" else engine.search(line.strip(), 30).text(source))
    elif a.command.startswith("search-"):
        ways = {"vector": lambda q, k: engine.vector(q, k, a.fast), "keyword": engine.keyword_rows, "graph": engine.expand, "community": engine.community_members}
        print(shown(ways[a.command.removeprefix("search-")](a.query, a.top_k)))
    elif a.command == "stats":
        print(shown(engine.stats()))
    elif a.command == "doctor":
        print(json.dumps(engine.doctor(), separators=(",", ":")))
    elif a.command == "communities":
        print(shown(engine.communities(a.search, a.level)))
    elif a.command == "node":
        found, near = engine.node(a.id)
        print(shown(found))
        print(shown(near) if near is not None else "[]")
    elif getattr(a, "output", None):
        engine.export_to(a.output, a.format)
    else:
        print(engine.export(a.format if a.command == "export" else "html", getattr(a, "max_nodes", 500)))
    return 0


if __name__ == "__main__":
    sys.exit(main())

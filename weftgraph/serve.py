"""The engine as a tool server: JSON-RPC 2.0, one message a line, on standard input and output (Model Context Protocol)."""

from __future__ import annotations

import json
import sys
from collections.abc import Callable
from typing import IO

from pyspark.sql import SparkSession

from weftgraph.engine import Engine, build_graph_store
from weftgraph.store import GraphStore

VERSION = "2024-11-05"


def _schema(**fields: str) -> dict:
    required = [n for n, kind in fields.items() if not kind.endswith("?")]
    return {"type": "object", "properties": {n: {"type": kind.rstrip("?")} for n, kind in fields.items()}, "required": required}


class Server:
    """Tools search, node, stats, communities and build over one store, which is opened when first asked."""

    def __init__(self, spark: SparkSession, store_dir: str):
        self.spark, self.store_dir = spark, store_dir
        self._engine: Engine | None = None
        self.tools: dict[str, tuple[str, dict, Callable[[dict], object]]] = {
            "search": ("Nodes that answer a question, and the edges between them.", _schema(query="string", top_k="integer?", fast="boolean?"), self._search),
            "node": ("A node by id or part of it, with its neighbours.", _schema(id="string"), self._node),
            "stats": ("Counts and measures of the graph.", _schema(), lambda _: self._rows(self.engine.stats())),
            "communities": ("Communities by level, or by words of their summaries.", _schema(level="integer?", search="string?"), lambda a: self._rows(self.engine.communities(a.get("search", ""), a.get("level")))),
            "build": ("Build or update the graph of a source folder.", _schema(source_dir="string", incremental="boolean?"), self._build),
        }

    @property
    def engine(self) -> Engine:
        if self._engine is None:
            if GraphStore(self.spark, self.store_dir).load("nodes") is None:
                raise LookupError(f"no graph in {self.store_dir}")
            self._engine = Engine(self.spark, self.store_dir)
        return self._engine

    @staticmethod
    def _rows(df) -> list[dict]:
        return [r.asDict(recursive=True) for r in df.collect()]  # reports of a few rows

    def _search(self, a: dict) -> str:
        return self.engine.search(a["query"], a.get("top_k", 10), fast=a.get("fast", False)).text(self.engine.store.get_meta("source_dir", ""))

    def _node(self, a: dict) -> dict:
        found, near = self.engine.node(a["id"])
        return {"found": self._rows(found), "neighbours": [] if near is None else self._rows(near)}

    def _build(self, a: dict) -> dict:
        counts = build_graph_store(self.spark, a["source_dir"], self.store_dir, a.get("incremental", False))
        self._engine = None
        return counts

    def answer(self, message: dict) -> dict | None:
        """The response to one message; None to a notification."""
        method, number = message.get("method"), message.get("id")
        if number is None:
            return None
        reply = {"jsonrpc": "2.0", "id": number}
        if method == "initialize":
            return reply | {"result": {"protocolVersion": VERSION, "capabilities": {"tools": {}}, "serverInfo": {"name": "weftgraph", "version": "1"}}}
        if method == "ping":
            return reply | {"result": {}}
        if method == "tools/list":
            return reply | {"result": {"tools": [{"name": n, "description": text, "inputSchema": shape} for n, (text, shape, _) in self.tools.items()]}}
        if method != "tools/call":
            return reply | {"error": {"code": -32601, "message": f"no method {method}"}}
        asked = message.get("params") or {}
        tool, given = self.tools.get(asked.get("name")), asked.get("arguments") or {}
        if tool is None or any(n not in given for n in tool[1]["required"]):
            return reply | {"error": {"code": -32602, "message": "no such tool, or an argument is missing"}}
        try:
            found, failed = tool[2](given), False
        except Exception as error:  # told to the caller, the server goes on
            found, failed = {"error": str(error).split("\n")[0]}, True
        text = found if isinstance(found, str) else json.dumps(found, separators=(",", ":"), default=str)
        return reply | {"result": {"content": [{"type": "text", "text": text}], "isError": failed}}


def serve(spark: SparkSession, store_dir: str, read: IO[str] = sys.stdin, write: IO[str] = sys.stdout) -> None:
    """Answer until the input ends."""
    server = Server(spark, store_dir)
    for line in read:
        if not line.strip():
            continue
        try:
            reply = server.answer(json.loads(line))
        except (ValueError, AttributeError):
            reply = {"jsonrpc": "2.0", "id": None, "error": {"code": -32700, "message": "not a message"}}
        if reply is not None:
            write.write(json.dumps(reply, separators=(",", ":")) + "\n")
            write.flush()

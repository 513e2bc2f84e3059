"""Nodes and edges of whole files, parsed on the workers.

One function for each format collects a file's rows; :func:`parsed` runs them
over the files one at a time, reading each where it is parsed. Bytes that aren't
UTF-8 are replaced. A file that can't be parsed
falls back to the simpler extractor, in the end to one module node.
"""

from __future__ import annotations

import ast
import csv
import io
import hashlib
import json
import re
from collections.abc import Iterator
from pathlib import PurePosixPath

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.extract import languages, pdf
from weftgraph.model import LANGUAGE_OF, RAW_EDGE, RAW_NODE
from weftgraph.sources.files import read_uri
from weftgraph.staging import Staged

SNIPPET = 2_000
# Calls that aren't references.
PY_BUILTINS = set(
    "print len range str int float bool list dict set tuple type isinstance issubclass super getattr setattr hasattr enumerate zip map filter sorted reversed any all min max sum abs open"
    .split()
)
JS_BUILTINS = set(
    "console require parseInt parseFloat isNaN isFinite setTimeout setInterval clearTimeout clearInterval JSON Object Array String Number Boolean Symbol "
    "Promise Map Set WeakMap WeakSet Date Math Error TypeError RangeError RegExp".split()
)
JS_WORDS = {"if", "for", "while", "switch", "catch", "return", "function", "super", "typeof", "new", "await", "constructor"}


class File:
    """Collects the rows of one file."""

    def __init__(self, path: str, language: str):
        self.path, self.language = path, language
        self.nodes: list[dict] = []
        self.edges: list[dict] = []

    def node(self, name: str, kind: str, line: int = 0, **more) -> str:
        own = f"{self.path}:{line}"
        row = {"file_seq": self.path, "emit_seq": len(self.nodes), "id": own, "name": name, "kind": kind, "file_path": self.path, "language": self.language, "start_line": 0, "end_line": 0, "docstring": "", "signature": "", "source_snippet": "", "decorators": []}
        self.nodes.append(row | more)
        return own

    def edge(self, source: str, target: str, relation: str, confidence: str = "EXTRACTED") -> None:
        self.edges.append({"file_seq": self.path, "emit_seq": len(self.edges), "source": source, "target": target, "relation": relation, "confidence": confidence})


def _slice(lines: list[str], first: int, last: int) -> str:
    return "\n".join(lines[first : last + 1])[:SNIPPET]


def python_tree(f: File, text: str) -> None:
    tree, lines = ast.parse(text), text.splitlines()
    module = f.node(PurePosixPath(f.path).stem, "module", docstring=ast.get_docstring(tree, clean=False) or "", source_snippet=text[:SNIPPET], end_line=max(0, len(lines) - 1))

    def calls(body: ast.AST, owner: str) -> None:
        for n in ast.walk(body):
            if isinstance(n, ast.Call):
                name = ast.unparse(n.func).split("(")[0].split(".")[-1]
                if name.isidentifier() and name not in PY_BUILTINS:
                    f.edge(owner, f"*::{name}", "calls", "INFERRED")

    def visit(body: list[ast.stmt], parent: str, prefix: str, in_class: bool) -> None:
        for n in body:
            if isinstance(n, ast.ClassDef | ast.FunctionDef | ast.AsyncFunctionDef):
                line, last = n.lineno - 1, (n.end_lineno or n.lineno) - 1
                common = {"start_line": line, "end_line": last, "docstring": (ast.get_docstring(n, clean=False) or "").strip(), "source_snippet": _slice(lines, line, last), "decorators": [ast.unparse(d) for d in n.decorator_list]}
                name = f"{prefix}.{n.name}" if prefix else n.name
                if isinstance(n, ast.ClassDef):
                    own = f.node(name, "class", n.lineno, **common)
                    f.edge(parent, own, "defines")
                    for base in n.bases:
                        f.edge(own, f"*::{ast.unparse(base)}", "inherits")
                    visit(n.body, own, name, True)
                else:
                    sig = f"({ast.unparse(n.args)})" + (f" -> {ast.unparse(n.returns)}" if n.returns else "")
                    own = f.node(name, "method" if in_class else "function", n.lineno, signature=sig, **common)
                    f.edge(parent, own, "defines")
                    calls(n, own)
            elif isinstance(n, ast.Import):
                for a in n.names:
                    f.edge(module, f"*::module::{a.name}", "imports")
            elif isinstance(n, ast.ImportFrom):
                base = "." * n.level + (n.module or "")
                for a in n.names:
                    f.edge(module, f"*::module::{base}.{a.name}" if base.strip(".") else f"*::module::{base}{a.name}", "imports")
            elif isinstance(n, ast.Assign | ast.AnnAssign) and not prefix:
                for t in n.targets if isinstance(n, ast.Assign) else [n.target]:
                    if isinstance(t, ast.Name) and (t.id.isupper() or t.id.startswith("_")):
                        own = f.node(t.id, "variable", n.lineno, start_line=n.lineno - 1, end_line=(n.end_lineno or n.lineno) - 1, source_snippet=_slice(lines, n.lineno - 1, n.lineno - 1))
                        f.edge(module, own, "defines")
            elif isinstance(n, ast.If | ast.Try):
                visit(n.body, parent, prefix, in_class)

    visit(tree.body, module, "", False)


# JavaScript and TypeScript declarations, one a line.
JS_DECLARATIONS = [
    ("class", re.compile(r"^\s*(?:export\s+)?(?:default\s+)?(?:abstract\s+)?class\s+(\w+)(?:<[^>]*>)?(?:\s+extends\s+([\w.]+))?")),
    ("interface", re.compile(r"^\s*(?:export\s+)?interface\s+(\w+)(?:<[^>]*>)?(?:\s+extends\s+([\w.,\s]+))?")),
    ("enum", re.compile(r"^\s*(?:export\s+)?(?:const\s+)?enum\s+(\w+)()")),
    ("type_alias", re.compile(r"^\s*(?:export\s+)?type\s+(\w+)(?:<[^>]*>)?\s*=()")),
    ("function", re.compile(r"^\s*(?:export\s+)?(?:default\s+)?(?:async\s+)?function\s*\*?\s*(\w+)\s*(?:<[^>]*>)?(\([^)]*\)?)")),
    ("function", re.compile(r"^\s*(?:export\s+)?(?:const|let|var)\s+(\w+)\s*(?::[^=]+)?=\s*(?:async\s+)?(\([^)]*\))[^=]*=>")),
    ("method", re.compile(r"^\s+(?:(?:public|private|protected|static|async|get|set|readonly)\s+)*(\w+)\s*(?:<[^>]*>)?(\([^)]*\))[^;{]*[;{]")),
    ("variable", re.compile(r"^(?:export\s+)?const\s+([A-Z][A-Z0-9_]*)\b()")),
]
JS_IMPORT = re.compile(r"^\s*import\s+(?:[^\"']*?\s+from\s+)?[\"']([^\"']+)[\"']")
JS_CALL = re.compile(r"([\w$.]+)\s*\(")


def script_lines(f: File, text: str) -> None:
    lines = text.splitlines()
    module = f.node(PurePosixPath(f.path).stem, "module", source_snippet=text[:SNIPPET], end_line=max(0, len(lines) - 1))
    open_: list[tuple[int, str, str, str]] = []  # depth at which it ends, id, name, kind
    depth = 0
    for k, line in enumerate(lines):
        code = re.sub(r"//.*|'(?:\\.|[^'\\])*'|\"(?:\\.|[^\"\\])*\"|`(?:\\.|[^`\\])*`", "", line)
        imported = JS_IMPORT.match(line)
        if imported:
            f.edge(module, f"*::module::{imported[1]}", "imports")
        holder = next((o for o in reversed(open_) if o[3] in ("class", "interface", "enum")), None)
        direct = bool(holder) and depth == holder[0] + 1
        if direct and holder[3] == "enum":
            for member in re.findall(r"\b([A-Za-z_]\w*)\s*(?:=[^,}]*)?(?:,|$|\})", code):
                f.edge(holder[1], f.node(f"{holder[2]}.{member}", "property", k + 1, start_line=k, end_line=k), "defines")
        else:
            for kind, pattern in JS_DECLARATIONS:
                m = pattern.match(line)
                if not m or kind == "method" and (not direct or m[1] in JS_WORDS - {"constructor"}):
                    continue
                kind = "constructor" if kind == "method" and m[1] == "constructor" else kind
                name = f"{holder[2]}.{m[1]}" if kind in ("method", "constructor") and holder else m[1]
                sig = m[2] if kind in ("function", "method", "constructor") else ""
                own = f.node(name, kind, k + 1, start_line=k, end_line=k, signature=sig, source_snippet=_slice(lines, k, k + 50))
                f.edge(holder[1] if holder and kind in ("method", "constructor") else module, own, "defines")
                if kind in ("class", "interface") and m[2]:
                    for base in m[2].split(","):
                        f.edge(own, f"*::{base.strip()}", "inherits" if kind == "class" else "extends")
                if "{" in code and kind not in ("variable", "type_alias"):
                    open_.append((depth, own, m[1], kind))
                break
            else:
                owner = next((o for o in reversed(open_) if o[3] in ("function", "method", "constructor")), None)
                for call in JS_CALL.findall(code) if owner else []:
                    base, last = call.split(".")[0], call.split(".")[-1]
                    if last and base not in JS_BUILTINS | JS_WORDS and last not in JS_BUILTINS | JS_WORDS:
                        f.edge(owner[1], f"*::{last}", "calls", "INFERRED")
        depth += code.count("{") - code.count("}")
        while open_ and depth <= open_[-1][0]:
            open_.pop()


def tree_of(f: File, data: object, text: str) -> None:
    """Keys of nested mappings down to four levels as sections."""
    document = f.node(PurePosixPath(f.path).stem, "document", source_snippet=text[:500])
    if not isinstance(data, dict):
        return
    count = 0

    def walk(obj: dict, prefix: str, parent: str, level: int) -> None:
        nonlocal count
        for key, value in obj.items():
            count += 1
            name = f"{prefix}.{key}" if prefix else str(key)
            shown = f"({len(value)} keys)" if isinstance(value, dict) else f"[{len(value)} items]" if isinstance(value, list) else repr(value)
            own = f.node(name, "section", count, source_snippet=f"{key}: {shown}"[:300])
            f.edge(parent, own, "defines")
            if isinstance(value, dict) and level < 4:
                walk(value, name, own, level + 1)

    walk(data, "", document, 1)


def table_header(f: File, text: str) -> None:
    rows = csv.reader(io.StringIO(text), delimiter="\t" if f.path.lower().endswith(".tsv") else ",")
    names = next(rows, None) or []
    listed = f"Columns: {', '.join(names)}\nRows: ~{text.count(chr(10))}" if names else text[:500]
    document = f.node(PurePosixPath(f.path).stem, "document", source_snippet=listed)
    for k, name in enumerate(names, 1):
        if name.strip():
            f.edge(document, f.node(name.strip(), "variable", k, source_snippet=f"Column: {name.strip()}"), "defines")


def markdown(f: File, text: str) -> None:
    lines = text.splitlines()
    document = f.node(PurePosixPath(f.path).stem, "document", source_snippet=text[:SNIPPET])
    heads = [(len(m[1]), m[2].strip(), k) for k, line in enumerate(lines) if (m := re.match(r"(#{1,6})\s+(.+)", line))]
    above = [(0, document)]
    for (level, name, k), after in zip(heads, [*(h[2] for h in heads[1:]), len(lines)], strict=False):
        own = f.node(name, "section", k + 1, start_line=k, end_line=after - 1, source_snippet=_slice(lines, k, after - 1))
        above = [a for a in above if a[0] < level]
        f.edge(above[-1][1], own, "defines")
        above.append((level, own))
    for to in re.findall(r"\[[^\]]+\]\(([^)]+)\)", text):
        name = PurePosixPath(to.split("#")[0]).stem
        if name and not to.startswith(("http://", "https://", "mailto:")):
            f.edge(document, f"*::document::{name}", "references", "INFERRED")


def hypertext(f: File, text: str) -> None:
    document = f.node(PurePosixPath(f.path).stem, "document", source_snippet=text[:SNIPPET])
    for m in re.finditer(r"<h([1-6])\b[^>]*>(.*?)</h\1\s*>", text, re.S | re.I):
        name = re.sub(r"<[^>]*>", "", m[2]).strip()
        if name:
            line = text[: m.start()].count("\n") + 1
            f.edge(document, f.node(name, "section", line, start_line=line), "defines")
    for to in re.findall(r"<a\b[^>]*?\bhref\s*=\s*[\"']([^\"']*)[\"']", text, re.S | re.I):
        name = PurePosixPath(to.split("#")[0]).stem
        if name and not to.startswith(("http://", "https://", "mailto:", "#", "javascript:")):
            f.edge(document, f"*::document::{name}", "references", "INFERRED")


def terraform(f: File, text: str) -> None:
    module = f.node(PurePosixPath(f.path).stem, "module", source_snippet=text[:SNIPPET])
    kinds = {"resource": "resource", "data": "data_source", "variable": "variable", "output": "variable", "module": "module", "provider": "provider", "locals": "variable"}
    found = re.finditer(r"^(resource|data|variable|output|module|provider|locals)\b((?:\s+\"[^\"]+\")*)\s*\{", text, re.M)
    for k, m in enumerate(found, 1):
        names = re.findall(r"\"([^\"]+)\"", m[2])
        f.edge(module, f.node(".".join([m[1], *names]), kinds[m[1]], k, source_snippet=m[0].rstrip("{ ")), "defines")
    for kind, name in re.findall(r"\b(var|module|data|local)\.(\w+)", text):
        f.edge(module, f"*::{ {'var': 'variable', 'local': 'locals'}.get(kind, kind)}.{name}", "references", "INFERRED")


def plain(f: File, text: str) -> None:
    f.node(PurePosixPath(f.path).stem, "module", source_snippet=text[:SNIPPET])


def python_lines(f: File, text: str) -> None:
    """By patterns at column 0, for sources that don't parse."""
    lines = text.splitlines()
    module = f.node(PurePosixPath(f.path).stem, "module")
    for k, line in enumerate(lines):
        if m := re.match(r"class\s+(\w+)(?:\(([^)]*)\))?:", line):
            own = f.node(m[1], "class", k + 1, start_line=k + 1, source_snippet=_slice(lines, k, k + 80))
            f.edge(module, own, "defines")
            for base in filter(None, (b.strip() for b in (m[2] or "").split(","))):
                f.edge(own, f"*::{base}", "inherits")
        elif m := re.match(r"(?:async\s+)?def\s+(\w+)\s*\(([^)]*)\)", line):
            f.edge(module, f.node(m[1], "function", k + 1, start_line=k + 1, signature=f"({m[2]})", source_snippet=_slice(lines, k, k + 50)), "defines")
        elif m := re.match(r"(?:from\s+([\w.]+)\s+)?import\s+([\w.,\s]+)", line):
            for name in filter(None, (i.strip().split(" as ")[0] for i in m[2].split(","))):
                f.edge(module, f"*::module::{m[1] + '.' if m[1] else ''}{name}", "imports")


def document_pages(f: File, data: bytes) -> None:
    document = f.node(PurePosixPath(f.path).stem, "document", source_snippet="[PDF document]")
    for k, text in enumerate(pdf.pages(data), 1):
        if text:
            f.edge(document, f.node(f"Page {k}", "section", k, start_line=k - 1, source_snippet=text[:SNIPPET]), "defines")


def parse(path: str, language: str, data: bytes) -> File:
    """Rows of one file; bytes that aren't UTF-8 are replaced."""
    text = "" if language == "pdf" else data.decode("utf-8", "replace")

    def loaded(kind: str) -> object:
        if kind == "json":
            return json.loads(text)
        if kind == "toml":
            import tomllib

            return tomllib.loads(text)
        import yaml

        return yaml.safe_load(text)

    ways = {
        "python": [python_tree, python_lines],
        "javascript": [script_lines],
        "typescript": [script_lines],
        "markdown": [markdown],
        "html": [hypertext],
        "csv": [table_header],
        "terraform": [terraform],
        "hcl": [terraform],
        "pdf": [lambda f, _: document_pages(f, data), lambda f, _: document_pages(f, b"")],
    }
    ways |= {kind: [lambda f, t, kind=kind: tree_of(f, loaded(kind), t), lambda f, t: tree_of(f, None, t)] for kind in ("json", "yaml", "toml")}
    ways |= {kind: [languages.structure] for kind in languages.LANGUAGES}
    for way in [*ways.get(language, []), plain]:
        f = File(path, language)
        try:
            way(f, text)
            return f
        except (SyntaxError, ValueError, RecursionError, ImportError, csv.Error, LookupError):
            continue
        except Exception as error:  # a YAML error has no common base with the others
            if type(error).__module__.split(".")[0] != "yaml":
                raise
    raise AssertionError("plain() takes every text")


OUT = "kind_of_row string, sha256 string, " + ", ".join(f"`{c.name}` {c.dataType.simpleString()}" for c in RAW_NODE) + ", source string, target string, relation string, confidence string"
TYPES = {"string": pa.string(), "int": pa.int32(), "array<string>": pa.list_(pa.string())}
SHAPE = pa.schema([(name.strip("`"), TYPES[kind]) for name, kind in (c.split(" ") for c in OUT.split(", "))])
ROWS_OUT = 2_000


def parsed(files: DataFrame) -> DataFrame:
    """Rows of nodes, edges and files (path as file_path, sha256), by kind_of_row, of rows path, language and content (string or binary) or uri."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[dict] = []

        def out() -> pa.RecordBatch:
            made = pa.RecordBatch.from_pylist(rows, schema=SHAPE)
            rows.clear()
            return made

        for batch in batches:
            for path, language, content, uri in zip(*(batch.column(k) for k in range(4)), strict=True):
                data = read_uri(uri.as_py()) if uri.is_valid else content.as_py() or b""
                f = parse(path.as_py(), language.as_py(), data)
                rows.append({"kind_of_row": "file", "file_path": f.path, "sha256": hashlib.sha256(data).hexdigest()})
                rows += [{"kind_of_row": "node"} | n for n in f.nodes] + [{"kind_of_row": "edge"} | e for e in f.edges]
                if len(rows) >= ROWS_OUT:
                    yield out()
        if rows:
            yield out()

    there = files.columns
    content = F.col("content").cast("binary") if "content" in there else F.lit(None).cast("binary")
    uri = F.col("uri") if "uri" in there else F.lit(None).cast("string")
    return files.select("path", "language", content.alias("content"), uri.alias("uri")).mapInArrow(run, OUT)


def extract(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(raw nodes, raw edges) of files as for :func:`parsed`, which is run once and staged; file_seq, which orders files, is the path."""
    rows = Staged(parsed(files), "parsed").df
    return raw_nodes(rows), raw_edges(rows)


def raw_nodes(rows: DataFrame) -> DataFrame:
    return rows.filter("kind_of_row = 'node'").select(*RAW_NODE.names)


def raw_edges(rows: DataFrame) -> DataFrame:
    return rows.filter("kind_of_row = 'edge'").select(*RAW_EDGE.names)


def language_of(path: str) -> str:
    return LANGUAGE_OF.get(PurePosixPath(path).suffix.lower(), "unknown")

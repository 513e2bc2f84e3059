"""Definitions, references, imports and inheritance of brace and ``end`` languages, by patterns of each language.

No grammars are needed: strings and comments are masked, blocks are followed by
their braces (or words that open and words that close), and declarations are
recognised where a line begins one. Containment follows the blocks: a function
inside a class or interface is named ``Class.name``. The comment right above a
definition is its docstring.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field
from pathlib import PurePosixPath

SNIPPET = 2_000
MOST_SIGNATURE = 20  # lines that a parameter list may take


@dataclass
class Language:
    """Patterns on a masked line; group 1 is the name, group ``bases`` what it inherits, ``faces`` what it implements."""

    definitions: list[tuple[str, str]]
    imports: list[str] = field(default_factory=list)  # on lines with strings
    import_block: str = ""  # opens lines of quoted names up to a closing parenthesis
    line_comment: tuple[str, ...] = ("//",)
    block_comment: tuple[str, str] | None = ("/*", "*/")
    opens: str = r"\{"
    closes: str = r"\}"
    creates: str = r"\bnew\s+([A-Z]\w*)"  # use of a class
    words: str = ""  # not calls


MODIFIERS = r"^\s*(?:(?:@\w+(?:\([^)]*\))?|public|private|protected|internal|static|final|abstract|sealed|partial|open|override|virtual|async|extern|unsafe|inline|suspend|data|inner|companion|implicit|lazy|case|export|default|native|synchronized|readonly|fileprivate|mutating|required|convenience|operator|strictfp|constexpr|explicit|friend|new|const)\s+)*"
TYPE = r"[\w$:.<>\[\],?&*\s]+?[\s&*\]>]"
BODY = r"\s*\("  # of a parameter list that may go on below

LANGUAGES = {
    "java": Language(
        [
            ("class", MODIFIERS + r"(?:class|record)\s+(\w+)(?:<[^{]*?>)?(?:\s*\([^)]*\))?(?:\s+extends\s+(?P<bases>[\w.<>]+))?(?:\s+implements\s+(?P<faces>[\w.<>,\s]+))?"),
            ("interface", MODIFIERS + r"@?interface\s+(\w+)(?:<[^{]*?>)?(?:\s+extends\s+(?P<bases>[\w.<>,\s]+))?"),
            ("enum", MODIFIERS + r"enum\s+(\w+)(?:\s+implements\s+(?P<faces>[\w.<>,\s]+))?"),
            ("method", MODIFIERS + rf"(?:<[^>]+>\s*)?(?:{TYPE})?(?<![.\w])([a-zA-Z_]\w*){BODY}"),
        ],
        [r"^\s*import\s+(?:static\s+)?([\w.]+)(?:\.\*)?\s*;"],
        words="if for while switch catch synchronized return new throw super this assert else do try",
    ),
    "go": Language(
        [
            ("method", r"^func\s*\([^)]*\)\s*(\w+)\s*(?:\[[^\]]*\])?\("),
            ("function", r"^func\s+(\w+)\s*(?:\[[^\]]*\])?\("),
            ("class", r"^(?:type\s+|\t)(\w+)(?:\[[^\]]*\])?\s+(?:struct|interface)\b"),
            ("class", r"^type\s+(\w+)(?:\[[^\]]*\])?\s+=?\s*[\w\[\]*.(]"),
        ],
        [r"^\s*import\s+(?:[\w.]+\s+)?\"([^\"]+)\""],
        import_block=r"^\s*import\s*\(",
        creates=r"&([A-Z]\w*)\{",
        words="if for switch select func return go defer range make len cap append new panic recover copy delete print println close",
    ),
    "rust": Language(
        [
            ("function", r"^\s*(?:pub(?:\([^)]*\))?\s+)?(?:(?:const|async|unsafe|extern(?:\s+\"[^\"]*\")?)\s+)*fn\s+(\w+)"),
            ("class", r"^\s*(?:pub(?:\([^)]*\))?\s+)?(?:struct|enum|union|type)\s+(\w+)"),
            ("interface", r"^\s*(?:pub(?:\([^)]*\))?\s+)?(?:unsafe\s+)?trait\s+(\w+)(?:<[^{:]*>)?(?:\s*:\s*(?P<bases>[^{]+?))?\s*(?:where\b|\{|$)"),
            ("module", r"^\s*(?:pub(?:\([^)]*\))?\s+)?mod\s+(\w+)\s*\{"),
            ("function", r"^\s*macro_rules!\s*(\w+)"),
            ("variable", r"^\s*(?:pub(?:\([^)]*\))?\s+)?(?:const|static)\s+(?:mut\s+)?([A-Z_]\w*)\s*:"),
            ("impl", r"^\s*(?:unsafe\s+)?impl(?:<[^>]*>)?\s+(?:(?P<faces>[\w:]+)(?:<[^{]*?>)?\s+for\s+)?([\w:]+)"),
        ],
        [r"^\s*(?:pub(?:\([^)]*\))?\s+)?use\s+([^;]+);", r"^\s*extern\s+crate\s+(\w+)"],
        creates=r"\b([A-Z]\w*)\s*\{",
        words="if for while match return loop fn Some Ok Err None let move as in impl",
    ),
    "c": Language(
        [
            ("class", r"^\s*(?:typedef\s+)?(?:struct|union|enum)\s+(\w+)\s*(?:\{|$)"),
            ("function", rf"^(?!\s*(?:typedef|return|else|goto)\b)(?:{TYPE})(\w+){BODY}"),
            ("function", r"^\s*#\s*define\s+(\w+)\("),
            ("variable", r"^\s*#\s*define\s+([A-Z_]\w*)\s+\S"),
        ],
        [r"^\s*#\s*(?:include|import)\s*([<\"][^>\"]+[>\"])"],
        creates="",
        words="if for while switch return sizeof else do case defined",
    ),
    "ruby": Language(
        [
            ("class", r"^\s*class\s+([A-Z][\w:]*)(?:\s*<\s*(?P<bases>[\w:]+))?"),
            ("module", r"^\s*module\s+([A-Z][\w:]*)"),
            ("method", r"^\s*(?:(?:private|protected|public|module_function)\s+)?def\s+(?:self\.)?([\w]+[?!=]?)"),
            ("variable", r"^\s*([A-Z][A-Z0-9_]+)\s*=(?![=~])"),
        ],
        [r"^\s*require(?:_relative)?\s*\(?\s*[\"']([^\"']+)[\"']", r"^\s*(?:include|extend)\s+([A-Z][\w:]*)"],
        line_comment=("#",),
        block_comment=("=begin", "=end"),
        opens=r"(?:^\s*(?:(?:private|public|protected)\s+)?def\b(?!.*\)\s*=\s)|^\s*(?:class|module|if|unless|while|until|case|begin|for)\b|\bdo\b(?:\s*\|[^|]*\|)?\s*$|=\s*(?:if|case|begin|unless)\b)",
        closes=r"^\s*end\b|;\s*end\b",
        creates=r"\b([A-Z]\w*)\.new\b",
        words="if unless while until return puts print require require_relative raise attr_accessor attr_reader attr_writer include extend yield and or not lambda proc super",
    ),
    "php": Language(
        [
            ("class", MODIFIERS + r"(?:class|trait)\s+(\w+)(?:\s+extends\s+(?P<bases>[\w\\]+))?(?:\s+implements\s+(?P<faces>[\w\\,\s]+))?"),
            ("interface", MODIFIERS + r"interface\s+(\w+)(?:\s+extends\s+(?P<bases>[\w\\,\s]+))?"),
            ("enum", MODIFIERS + r"enum\s+(\w+)"),
            ("function", MODIFIERS + r"function\s+&?(\w+)\s*\("),
            ("variable", MODIFIERS + r"const\s+([A-Z_]\w*)\s*="),
        ],
        [r"^\s*use\s+(?:function\s+|const\s+)?([\w\\]+)(?:\s+as\s+\w+)?\s*;", r"^\s*(?:require|include)(?:_once)?\s*\(?\s*[\"']([^\"']+)[\"']"],
        line_comment=("//", "#"),
        words="if elseif for foreach while switch catch return array isset empty unset list echo print function fn match require include exit die new",
    ),
    "swift": Language(
        [
            ("class", MODIFIERS + r"(?:class|struct|actor|extension)\s+(\w+)(?:<[^{]*?>)?(?:\s*:\s*(?P<bases>[\w.,\s<>]+))?"),
            ("enum", MODIFIERS + r"(?:indirect\s+)?enum\s+(\w+)(?:\s*:\s*(?P<bases>[\w.,\s]+))?"),
            ("interface", MODIFIERS + r"protocol\s+(\w+)(?:\s*:\s*(?P<bases>[\w.,\s]+))?"),
            ("function", MODIFIERS + r"func\s+(\w+)"),
            ("method", MODIFIERS + r"(init|deinit|subscript)\b[?!]?\s*[(<{]"),
        ],
        [r"^\s*(?:@testable\s+)?import\s+([\w.]+)"],
        creates="",
        words="if guard for while switch return catch func init super print where in",
    ),
    "kotlin": Language(
        [
            ("class", MODIFIERS + r"(?:(?:annotation|value|enum|fun)\s+)?(?:class|object)\s+(\w+)(?:<[^({]*>)?(?:(?:\s+(?:private|internal|protected))?(?:\s+constructor)?\s*\([^)]*\))?(?:\s*:\s*(?P<bases>[^{]+?))?\s*(?:\{|$)"),
            ("interface", MODIFIERS + r"(?:fun\s+)?interface\s+(\w+)(?:<[^{:]*>)?(?:\s*:\s*(?P<bases>[^{]+?))?\s*(?:\{|$)"),
            ("function", MODIFIERS + r"(?:(?:tailrec|infix|external|actual|expect)\s+)*fun\s+(?:<[^>]*>\s*)?(?:[\w.<>?]+\.)?(\w+)\s*\("),
            ("variable", MODIFIERS + r"(?:const\s+)?val\s+([A-Z][A-Z0-9_]+)\b"),
        ],
        [r"^\s*import\s+([\w.]+)(?:\.\*)?(?:\s+as\s+\w+)?"],
        creates="",
        words="if for while when return catch fun super this throw in is println print",
    ),
    "c_sharp": Language(
        [
            ("class", MODIFIERS + r"(?:class|struct|record(?:\s+(?:class|struct))?)\s+(\w+)(?:<[^{:]*>)?(?:\s*\([^)]*\))?(?:\s*:\s*(?P<bases>[\w.<>,\s]+?))?\s*(?:where\b|\{|;|$)"),
            ("interface", MODIFIERS + r"interface\s+(\w+)(?:<[^{:]*>)?(?:\s*:\s*(?P<bases>[\w.<>,\s]+?))?\s*(?:where\b|\{|$)"),
            ("enum", MODIFIERS + r"enum\s+(\w+)"),
            ("module", r"^\s*namespace\s+([\w.]+)"),
            ("method", MODIFIERS + rf"(?:{TYPE})?(?<![.\w])([a-zA-Z_]\w*)(?:<[^>(]*>)?{BODY}"),
        ],
        [r"^\s*(?:global\s+)?using\s+(?:static\s+)?(?:\w+\s*=\s*)?([\w.]+)\s*;"],
        words="if for foreach while switch catch using lock return new throw base this nameof typeof sizeof default checked unchecked fixed when await yield else do",
    ),
    "objc": Language(
        [
            ("class", r"^\s*@interface\s+(\w+)(?:\s*:\s*(?P<bases>\w+))?(?:\s*<(?P<faces>[\w,\s]+)>)?"),
            ("class", r"^\s*@implementation\s+(\w+)"),
            ("interface", r"^\s*@protocol\s+(\w+)(?:\s*<(?P<bases>[\w,\s]+)>)?\s*$"),
            ("method", r"^\s*[-+]\s*\([^)]*\)\s*(\w+)"),
            ("function", rf"^(?!\s*(?:typedef|return|else)\b)(?:{TYPE})(\w+)\s*\([^;{{}}]*\)\s*\{{?\s*$"),
        ],
        [r"^\s*#\s*(?:include|import)\s*([<\"][^>\"]+[>\"])", r"^\s*@import\s+([\w.]+)"],
        opens=r"\{|^\s*@(?:interface|implementation|protocol(?=\s+\w+\s*(?:<[^>]*>)?\s*$))\b",
        closes=r"\}|^\s*@end\b",
        creates=r"\[\[?([A-Z]\w*)\s+(?:alloc|new)\b",
        words="if for while switch return sizeof else",
    ),
    "scala": Language(
        [
            ("class", MODIFIERS + r"(?:class|object|enum)\s+(\w+)(?:\[[^\]]*\])?(?:\s*\([^)]*\))*(?:\s+extends\s+(?P<bases>[\w.]+)(?:\[[^\]]*\])?(?:\([^)]*\))?)?(?P<more>(?:\s+with\s+[\w.\[\]]+)*)"),
            ("interface", MODIFIERS + r"trait\s+(\w+)(?:\[[^\]]*\])?(?:\s+extends\s+(?P<bases>[\w.]+))?"),
            ("function", MODIFIERS + r"def\s+(\w+)"),
            ("variable", MODIFIERS + r"val\s+([A-Z][A-Z0-9_]+)\b"),
        ],
        [r"^\s*import\s+([\w.{},\s=>]+?)\s*$"],
        words="if for while match return catch def new super this throw yield case println print",
    ),
    "lua": Language(
        [("function", r"^\s*(?:local\s+)?function\s+([\w.:]+)\s*\("), ("function", r"^\s*(?:local\s+)?([\w.]+)\s*=\s*function\s*\(")],
        [r"\brequire\s*\(?\s*[\"']([^\"']+)[\"']"],
        line_comment=("--",),
        block_comment=("--[[", "]]"),
        opens=r"\b(?:function|then|do|repeat)\b",
        closes=r"\b(?:end|until)\b|\belseif\b",
        creates="",
        words="if for while function return print require pairs ipairs type tostring tonumber and or not",
    ),
    "shell": Language(
        [("function", r"^\s*(?:function\s+)?([\w-]+)\s*\(\)\s*"), ("function", r"^\s*function\s+([\w-]+)"), ("variable", r"^(?:export\s+|readonly\s+|declare\s+-\w+\s+)?([A-Z_][A-Z0-9_]*)=")],
        [r"^\s*(?:source|\.)\s+[\"']?([\w./-]+)"],
        line_comment=("#",),
        block_comment=None,
        creates="",
        words="if for while case function",
    ),
    "r": Language(
        [("function", r"^\s*([\w.]+)\s*(?:<-|=)\s*function\s*\(")],
        [r"^\s*(?:library|require)\s*\(\s*[\"']?([\w.]+)"],
        line_comment=("#",),
        block_comment=None,
        creates="",
        words="if for while function return library require c list print paste",
    ),
}
LANGUAGES["cpp"] = Language(
    [
        ("class", r"^\s*(?:template\s*<[^{]*>\s*)?(?:typedef\s+)?(?:class|struct|union|enum(?:\s+class)?)\s+(?:alignas\([^)]*\)\s*)?(\w+)(?:\s+final)?\s*(?::\s*(?P<bases>[^{;]+?))?\s*(?:\{|$)"),
        ("module", r"^\s*(?:inline\s+)?namespace\s+([\w:]+)\s*\{?"),
        ("method", rf"^(?!\s*(?:typedef|return|else|goto|using|throw)\b)(?:{TYPE})?([\w:]+::~?\w+){BODY}"),
        *LANGUAGES["c"].definitions[1:],
    ],
    [*LANGUAGES["c"].imports, r"^\s*using\s+namespace\s+([\w:]+)"],
    words=LANGUAGES["c"].words + " catch new delete throw static_cast dynamic_cast const_cast reinterpret_cast decltype noexcept alignof typeid",
)

SCRIPTS = ("ruby", "php", "lua", "shell", "r")  # code outside functions runs
CONTAINERS = ("class", "interface", "enum", "impl")
CALL = re.compile(r"(?<![\w$])([A-Za-z_]\w*)\s*\(")
STRING = re.compile(r"\"(?:\\.|[^\"\\])*\"|'(?:\\.|[^'\\])*'|`(?:\\.|[^`\\])*`")


def supported() -> list[str]:
    """Languages with structural extraction."""
    return sorted([*LANGUAGES, "python", "javascript", "typescript"])


def clean_comment(text: str) -> str:
    """A comment without its marks."""
    lines = [re.sub(r"^\s*(?:/\*+!?|\*+/|///?!?|//|#+|--+(?:\[\[)?|=begin|\*)\s?|\s*\*+/\s*$", "", line) for line in text.splitlines()]
    return "\n".join(lines).strip()


def _masked(lines: list[str], language: Language) -> tuple[list[str], list[str]]:
    """(lines without strings and comments, comment text of each line or '')."""
    code, comments, inside = [], [], False
    begin, end = language.block_comment or ("\0", "\0")
    for line in lines:
        out, comment = line, ""
        if inside:
            at = line.find(end)
            if at < 0:
                code.append("")
                comments.append(line or " ")
                continue
            comment, out, inside = line[: at + len(end)], line[at + len(end) :], False
        out = STRING.sub(lambda m: m[0][0] * 2, out) if any(q in out for q in "\"'`") else out
        while (at := out.find(begin)) >= 0:
            close = out.find(end, at + len(begin))
            if close < 0:
                comment, out, inside = out[at:], out[:at], True
                break
            comment, out = out[at : close + len(end)], out[:at] + " " + out[close + len(end) :]
        for mark in language.line_comment:
            at = out.find(mark)
            if at >= 0 and not (mark == "#" and out.lstrip().startswith("#") and re.match(r"\s*#\s*(?:include|define|import)", out)):
                comment, out = out[at:], out[:at]
        code.append(out.rstrip())
        comments.append(comment)
    return code, comments


def _bases(text: str | None) -> list[str]:
    """Names in a list of bases: without arguments, visibility and type parameters."""
    if not text:
        return []
    flat = text
    for pair in (r"\([^()]*\)", r"<[^<>]*>", r"\[[^\[\]]*\]"):
        while (shorter := re.sub(pair, "", flat)) != flat:
            flat = shorter
    parts = (re.sub(r"\b(?:public|private|protected|virtual|with|by)\b", " ", p).split() for p in re.split(r"[,+]|\bwith\b", flat))
    return [p[-1] for p in parts if p and re.match(r"[\w:.\\]+$", p[-1])]


def _signature(code: list[str], k: int, after: int) -> str:
    """The parameter list from ``after`` on line k, and the type that follows it."""
    begin = re.match(r"\s*(?:<[^(]*>|\[[^(]*\])?\s*(?=\()", code[k][after:])
    if not begin:
        return ""
    text, depth, taken = code[k][after + begin.end() :], 0, 0
    for extra in range(1, MOST_SIGNATURE):
        depth, done = 0, False
        for taken, c in enumerate(text):
            depth += (c == "(") - (c == ")")
            if depth == 0:
                done = True
                break
        if done or k + extra >= len(code):
            break
        text += " " + code[k + extra].strip()
    parameters, rest = text[: taken + 1], text[taken + 1 :]
    result = re.match(r"\s*(?:->|:)\s*([^{;=]+?)\s*(?:\{|;|=|\bwhere\b|$)", rest)
    return parameters + (f" -> {result[1].strip()}" if result else "")


def structure(f, text: str) -> None:
    """Adds the nodes and edges of a source file of one of LANGUAGES to ``f``."""
    language = LANGUAGES[f.language]
    lines = text.splitlines()
    code, comments = _masked(lines, language)
    module = f.node(PurePosixPath(f.path).stem, "module", source_snippet=text[:SNIPPET], end_line=max(0, len(lines) - 1))
    opens, closes = re.compile(language.opens), re.compile(language.closes)
    patterns = [(kind, re.compile(p)) for kind, p in language.definitions]
    imports = [re.compile(p) for p in language.imports]
    block = re.compile(language.import_block) if language.import_block else None
    creates = re.compile(language.creates) if language.creates else None
    words = set(language.words.split())
    stack: list[dict] = []  # open definitions: id, name, kind, depth at which they end, row
    depth, importing = 0, False
    pending: dict | None = None  # a definition whose block hasn't begun

    def enclosing(test: Callable[[dict], bool]) -> dict | None:
        return next((s for s in reversed(stack) if test(s)), None)

    def calls(owner: str, code: str) -> None:
        for called in CALL.findall(code):
            if called not in words:
                f.edge(owner, f"*::{called}", "calls", "INFERRED")

    def doc_above(k: int) -> str:
        while k > 0 and re.match(r"\s*(?:@\w|#\[|\[\w)[^{};]*$", code[k - 1]):
            k -= 1  # annotations
        first = k
        while first > 0 and comments[first - 1] and not code[first - 1].strip():
            first -= 1
        return clean_comment("\n".join(comments[first:k]))

    for k, line in enumerate(code):
        if importing:
            importing = ")" not in line
            found = re.search(r"\"([^\"]+)\"", lines[k])
            if found:
                f.edge(module, f"*::module::{found[1]}", "imports")
            continue
        if block and block.match(line):
            importing = True
            continue
        imported = next((m for p in imports if (m := p.search(lines[k])) and line.strip()), None)
        if imported:
            f.edge(module, f"*::module::{imported[1].strip().strip(chr(34) + chr(39))}", "imports")
            if f.language in ("c", "cpp", "objc", "ruby", "scala", "go", "swift", "kotlin", "r"):
                continue
        holder = enclosing(lambda s: s["kind"] in CONTAINERS)
        inside_function = enclosing(lambda s: s["kind"] in ("function", "method"))
        here = None
        for kind, pattern in patterns:
            m = pattern.match(line)
            if not m:
                continue
            name = m[m.lastindex] if kind == "impl" and m.re.groups > 1 and m[m.re.groups] else m[1]
            if name is None or name in words:
                continue
            if kind in ("function", "method") and inside_function and f.language in ("java", "c", "cpp", "c_sharp", "objc", "go"):
                continue  # a call, not a definition
            if kind == "method" and f.language in ("java", "c_sharp") and not holder:
                continue
            if f.language in ("c", "cpp", "java", "c_sharp", "objc") and kind in ("function", "method") and not re.match(r"\s*(?:#|[-+]\s*\()", line):
                ahead = " ".join(code[k : k + MOST_SIGNATURE])[m.start(1) :]
                body = re.match(r"[^;{}]*\)[^;{}()]*(?:\([^;{}]*\)[^;{}]*)?([;{])", ahead)
                if not body or body[1] == ";" and f.language in ("c", "cpp", "objc"):
                    continue
                if body[1] == ";" and not (holder and (holder["kind"] == "interface" or re.match(r"\s*(?:abstract|public|protected|native|extern)\b", line))):
                    continue
            here = (kind, name, m)
            break
        if here:
            kind, name, m = here
            named = m.groupdict()
            bases, faces = _bases(named.get("bases")) + _bases((named.get("more") or "").replace(" with ", ",")), _bases(named.get("faces"))
            if kind == "impl":
                own = next((n["id"] for n in f.nodes if n["kind"] == "class" and n["name"] == name), module)
                for base in faces:
                    f.edge(own, f"*::class::{base.split('::')[-1]}", "inherits")
                    f.edge(own, f"*::interface::{base.split('::')[-1]}", "implements", "INFERRED")
                pending = {"id": module, "name": name.split("::")[-1], "kind": "impl", "row": None}
            else:
                parent = stack[-1] if stack else None
                member = holder is not None and parent is holder and kind in ("function", "method")
                if member:
                    kind = "method" if kind == "function" and f.language != "rust" or holder["kind"] == "impl" else kind
                    name = f"{holder['name']}.{name}"
                signature = _signature(code, k, m.end(1)) if kind in ("function", "method") else ""
                own = f.node(name, kind, k + 1, start_line=k, end_line=k, docstring=doc_above(k), signature=signature, source_snippet="\n".join(lines[k : k + 50])[:SNIPPET])
                f.edge(parent["id"] if parent else module, own, "defines")
                relation = "extends" if kind == "interface" else "inherits"
                for base in bases:
                    f.edge(own, f"*::class::{re.split(r'::|[.]', base)[-1]}", relation)
                for face in faces:
                    f.edge(own, f"*::class::{face.split('.')[-1]}", "inherits")
                    f.edge(own, f"*::interface::{face.split('.')[-1]}", "implements", "INFERRED")
                pending = {"id": own, "name": name.split(".")[-1] if kind in ("function", "method") else name, "kind": kind, "row": len(f.nodes) - 1}
                if kind == "variable":
                    pending = None
                if kind in ("function", "method") and "{" in line:
                    calls(own, line[line.find("{") + 1 :])
        else:
            owner = enclosing(lambda s: s["kind"] in ("function", "method"))
            if owner or f.language in SCRIPTS:
                calls(owner["id"] if owner else module, line)
            if f.language == "go" and holder and stack[-1] is holder and (embedded := re.match(r"^\s*\*?(?:\w+\.)?([A-Z]\w*)\s*$", line)):
                f.edge(holder["id"], f"*::class::{embedded[1]}", "inherits")
        if creates and not (here and here[0] in (*CONTAINERS, "module")):
            owner = enclosing(lambda s: s["kind"] != "impl")
            for used in creates.findall(line):
                if not (here and here[1].split(".")[-1] == used):
                    f.edge(owner["id"] if owner else module, f"*::class::{used}", "references", "INFERRED")
        ups = [(m.start(), 1) for m in opens.finditer(line)]
        downs = [(m.start(), -1) for m in closes.finditer(line)]
        for _, step in sorted(ups + downs):
            if step > 0:
                if pending:
                    stack.append(pending | {"depth": depth})
                    pending = None
                depth += 1
            else:
                depth -= 1
                while stack and depth <= stack[-1]["depth"]:
                    closed = stack.pop()
                    if closed["row"] is not None:
                        row = f.nodes[closed["row"]]
                        row["end_line"] = k
                        row["source_snippet"] = "\n".join(lines[row["start_line"] : k + 1])[:SNIPPET]
        if pending and line.rstrip().endswith(";"):
            pending = None  # a declaration without a block

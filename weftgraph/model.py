"""Row types and closed vocabularies of the graph."""

from __future__ import annotations

from pyspark.sql import types as T

RAW_NODE = T.StructType(
    [
        T.StructField("file_seq", T.StringType()),
        T.StructField("emit_seq", T.IntegerType()),
        T.StructField("id", T.StringType()),
        T.StructField("name", T.StringType()),
        T.StructField("kind", T.StringType()),
        T.StructField("file_path", T.StringType()),
        T.StructField("language", T.StringType()),
        T.StructField("start_line", T.IntegerType()),
        T.StructField("end_line", T.IntegerType()),
        T.StructField("docstring", T.StringType()),
        T.StructField("signature", T.StringType()),
        T.StructField("source_snippet", T.StringType()),
        T.StructField("decorators", T.ArrayType(T.StringType())),
    ]
)
RAW_EDGE = T.StructType(
    [
        T.StructField("file_seq", T.StringType()),
        T.StructField("emit_seq", T.IntegerType()),
        T.StructField("source", T.StringType()),
        T.StructField("target", T.StringType()),
        T.StructField("relation", T.StringType()),
        T.StructField("confidence", T.StringType()),
    ]
)

# File extensions by language.
EXTENSIONS = {
    "python": [".py"],
    "javascript": [".js", ".jsx", ".mjs"],
    "typescript": [".ts", ".tsx"],
    "java": [".java"],
    "go": [".go"],
    "rust": [".rs"],
    "c": [".c", ".h"],
    "cpp": [".cpp", ".hpp", ".cc", ".cxx"],
    "ruby": [".rb"],
    "php": [".php"],
    "swift": [".swift"],
    "kotlin": [".kt", ".kts"],
    "c_sharp": [".cs"],
    "objc": [".m", ".mm"],
    "scala": [".scala"],
    "shell": [".sh", ".bash", ".zsh"],
    "lua": [".lua"],
    "r": [".r"],
    "terraform": [".tf"],
    "hcl": [".hcl"],
    "markdown": [".md", ".mdx"],
    "yaml": [".yml", ".yaml"],
    "json": [".json"],
    "toml": [".toml"],
    "pdf": [".pdf"],
    "html": [".html", ".htm"],
    "csv": [".csv", ".tsv"],
}
LANGUAGE_OF = {e: language for language, extensions in EXTENSIONS.items() for e in extensions}

# Names that a scan leaves out, and names of files with secrets.
IGNORED = [".git", "__pycache__", "node_modules", ".venv", "venv", ".tox", ".mypy_cache", ".pytest_cache", "dist", "build", ".eggs", "*.egg-info", ".DS_Store"]
SENSITIVE = ["*.env", "*.pem", "*.key", "*.secret", "*credentials*", "*password*", "*.p12", "*.pfx"]

# Kinds of nodes by how they are treated.
CODE_KINDS = ["function", "class", "method", "module", "variable", "interface", "enum", "struct", "trait", "import", "constructor", "property", "decorator", "type_alias"]
EMBED_KINDS = ["function", "class", "method", "section", "interface", "enum", "struct", "trait"]
SKIP_KINDS = ["external", "directory"]
MERGE_KINDS = ["constructor", "property", "variable", "decorator", "type_alias"]
CONFIDENCE = {"EXTRACTED": 1.0, "INFERRED": 0.5, "AMBIGUOUS": 0.3}

# Words that a keyword search leaves out.
STOPWORDS = (
    "the is at which on a an and or but in with to for of not no can had has have was were been being do does did will would could should may might "
    "shall must need this that these those it its from by as are be if so than too very just about into through during before after above below "
    "between out off over under again then once here there when where why how all each every both few more most other some such only own same also what who whom"
).split()

"""Markdown, HTML, CSV, JSON and regular-expression extraction as DataFrame expressions.

Input rows have path and content; sections and references come back as flat rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

SNIPPET = 2_000
EXTERNAL = r"^(?:http://|https://|mailto:)"


def stem(path):
    return F.regexp_replace(F.regexp_extract(path, r"([^/]*)$", 1), r"(?<=.)\.[^.]+$", "")


def markdown_sections(files: DataFrame) -> DataFrame:
    """path, line (1-based), level, name, end_line, parent_line (0: the document): ATX headings, each up to the line before the next.

    The parent is the last heading before of a smaller level that no heading of an
    equal or smaller level has closed: the latest of the smaller levels' last lines.
    """
    content = F.regexp_replace(F.coalesce("content", F.lit("")), "\r\n?", "\n")
    lines = files.select("path", F.posexplode(F.split(content, "\n")).alias("pos", "text"))
    head = lines.select("path", (F.col("pos") + 1).alias("line"), "text", F.max("pos").over(Window.partitionBy("path")).alias("last"), F.regexp_extract("text", r"^(#{1,6})\s+(.+)", 1).alias("marks"))
    head = head.filter("marks <> ''").withColumn("level", F.length("marks")).withColumn("name", F.trim(F.regexp_extract("text", r"^(#{1,6})\s+(.+)", 2)))
    order = Window.partitionBy("path").orderBy("line")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    latest = [F.max(F.when(F.col("level") == k, F.col("line"))).over(before).alias(f"h{k}") for k in range(1, 6)]
    rows = head.select("path", "line", "level", "name", "last", F.lead("line").over(order).alias("next"), *latest)
    above = F.greatest(F.lit(0), *[F.when(F.col("level") > k, F.coalesce(f"h{k}", F.lit(0))) for k in range(1, 6)])
    return rows.select("path", "line", "level", "name", F.coalesce(F.col("next") - 1, F.col("last") + 1).alias("end_line"), above.cast("int").alias("parent_line"))


def markdown_links(files: DataFrame) -> DataFrame:
    """path, target (``*::document::stem``) of relative links."""
    link = files.select("path", F.explode(F.expr(r"regexp_extract_all(content, r'\[([^\]]+)\]\(([^)]+)\)', 2)")).alias("to"))
    name = stem(F.split("to", "#")[0])
    return link.filter(~F.col("to").rlike(EXTERNAL)).select("path", F.concat(F.lit("*::document::"), name).alias("target")).filter("target <> '*::document::'")


def html_headings(files: DataFrame) -> DataFrame:
    """path, pos, level, name of h1 to h6, text of inner tags joined; empty ones are left out."""
    found = files.select("path", F.posexplode(F.expr(r"regexp_extract_all(content, r'(?is)<h([1-6])\b[^>]*>(.*?)</h\1\s*>', 0)")).alias("pos", "raw"))
    name = F.trim(F.regexp_replace("raw", r"(?s)<[^>]*>", ""))
    return found.select("path", "pos", F.regexp_extract("raw", r"(?i)^<h([1-6])", 1).cast("int").alias("level"), name.alias("name")).filter("name <> ''")


def html_links(files: DataFrame) -> DataFrame:
    """path, target (``*::document::stem``) of relative links."""
    found = files.select("path", F.explode(F.expr(r"""regexp_extract_all(content, r'(?is)<a\b[^>]*?\bhref\s*=\s*["\x27]([^"\x27]*)["\x27]', 1)""")).alias("to"))
    local = found.filter(~F.col("to").rlike(r"^(?:http://|https://|mailto:|#|javascript:)") & (F.col("to") != ""))
    return local.select("path", F.concat(F.lit("*::document::"), stem(F.split("to", "#")[0])).alias("target")).filter("target <> '*::document::'")


def csv_schema(files: DataFrame) -> DataFrame:
    """path, pos (1-based), name, rows: the columns of CSV and TSV files (quoted names too)."""
    first = F.regexp_extract("content", r"^([^\n]*)", 1)
    tab = F.lower("path").endswith(".tsv")
    # RFC 4180 fields: quoted with doubled quotes, or plain up to the delimiter
    comma = F.expr(r"""regexp_extract_all(concat(',', head), r',("(?:[^"]|"")*"|[^,]*)', 1)""")
    tabs = F.expr(r"""regexp_extract_all(concat('\t', head), r'\t("(?:[^"]|"")*"|[^\t]*)', 1)""")
    rows = files.withColumn("head", F.regexp_replace(first, "\r$", "")).select("path", (F.length("content") - F.length(F.regexp_replace("content", "\n", ""))).alias("rows"), F.posexplode(F.when(tab, tabs).otherwise(comma)).alias("pos", "raw"))
    name = F.trim(F.when(F.col("raw").rlike('^".*"$'), F.regexp_replace(F.expr("substring(raw, 2, length(raw) - 2)"), '""', '"')).otherwise(F.col("raw")))
    return rows.select("path", (F.col("pos") + 1).alias("pos"), name.alias("name"), "rows").filter("name <> ''")


def json_tree(files: DataFrame, depth: int = 4) -> DataFrame:
    """path, name (dotted), snippet, depth: keys of nested objects down to ``depth``; broken documents give nothing."""
    level = files.select("path", F.lit("").alias("name"), F.expr("try_parse_json(content)").alias("v"))
    out = None
    for k in range(1, depth + 1):
        name = f"__w_json_{k}"
        level.filter("startswith(schema_of_variant(v), 'OBJECT')").createOrReplaceTempView(name)
        level = level.sparkSession.sql(f"SELECT path, IF(name = '', e.key, concat(name, '.', e.key)) AS name, e.key AS key, e.value AS v FROM {name}, LATERAL variant_explode({name}.v) AS e")
        kind = F.expr("schema_of_variant(v)")
        inner = F.when(F.startswith(kind, F.lit("OBJECT")), F.concat(F.lit(" ("), F.size(F.expr("json_object_keys(to_json(v))")).cast("string"), F.lit(" keys)")))
        inner = inner.when(F.startswith(kind, F.lit("ARRAY")), F.concat(F.lit(" ["), F.expr("json_array_length(to_json(v))").cast("string"), F.lit(" items]")))
        inner = inner.otherwise(F.concat(F.lit(" "), F.expr("to_json(v)")))
        rows = level.select("path", "name", F.substring(F.concat("key", F.lit(":"), inner), 1, 300).alias("snippet"), F.lit(k).alias("depth"))
        out = rows if out is None else out.unionByName(rows)
        level = level.select("path", "name", "v")
    return out


def python_symbols(files: DataFrame) -> DataFrame:
    """path, line, kind, name, detail: column-0 classes (bases) and functions (parameters) by pattern."""
    lines = files.select("path", F.posexplode(F.split("content", "\n")).alias("pos", "text"))
    cls = r"^class\s+(\w+)(?:\(([^)]*)\))?:"
    fun = r"^(?:async\s+)?def\s+(\w+)\s*\(([^)]*)\)"
    pick = lambda p, kind: lines.filter(F.col("text").rlike(p)).select("path", (F.col("pos") + 1).alias("line"), F.lit(kind).alias("kind"), F.regexp_extract("text", p, 1).alias("name"), F.regexp_extract("text", p, 2).alias("detail"))
    return pick(cls, "class").unionByName(pick(fun, "function"))

"""Scanning, extraction, graph construction, communities and exports."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from weftgraph import export
from weftgraph.extract import files as parsers
from weftgraph.extract import native
from weftgraph.operators import analytics, build, communities
from weftgraph.plans.adapters import GRAPH_SQL, graph, table
from weftgraph.plans.graph_queries import _RANK
from weftgraph.sources import files
from weftgraph.staging import shared_dir
from weftgraph.store import GraphStore
from weftgraph.streaming import incremental

SUFFIXES = [".py", ".md", ".env", ".json", ".txt", ".xyz", ".cfg", ".TS"]
MARKDOWN = "# Guide\n\nIntro with [site](https://example.com/a).\n## Setup\ntext\n### Needs\n- one\n## Use\nSee [setup](#setup) and [conf](./conf.md).\n# Notes\n"
CSV = 'name,"a ""b"", c", age \n1,2,3\n4,5,6\n'
PYTHON = '"""Doc."""\nimport os\nfrom a.b import c\nLIMIT = 3\n\n\nclass Base:\n    pass\n\n\nclass Child(Base):\n    """A child."""\n\n    def run(self, x):\n        return helper(x)\n\n\ndef helper(y):\n    return len(y)\n'
SCRIPT = "import { a } from './a';\nexport class App extends Component {\n  render(x, y) {\n    return draw(x);\n  }\n}\nfunction draw(z) { return z; }\nconst add = (p, q) => p + q;\ninterface Shape extends Base {\n  area(): number;\n}\n"


def detect_classify(spark, sf_dir):
    docs, pages = table(spark, sf_dir, "documents"), table(spark, sf_dir, "pages")
    end = F.array(*[F.lit(s) for s in SUFFIXES])[(F.col("doc_id") % len(SUFFIXES)).cast("int")]
    folder = F.when(F.col("doc_id") % 13 == 0, "node_modules/").when(F.col("doc_id") % 17 == 0, "secret_password/").otherwise("")
    rows = docs.select(F.concat(folder, "source", F.lit("/"), "lang", F.lit("/"), F.col("doc_id").cast("string"), end).alias("path"), F.octet_length("text").cast("bigint").alias("size_bytes"))
    rows = rows.unionByName(pages.select(F.regexp_replace(F.regexp_replace("url", "^https?://", ""), "[?#].*$", "").alias("path"), F.octet_length("html").cast("bigint").alias("size_bytes")))
    rules = files.ignore_rules("src1/\n*.cfg\n!src2/en/*.cfg\n")
    return files.classify(rows, rules).select("path", "language", "file_type", "skip_reason")


def _pages(spark, sf_dir):
    return table(spark, sf_dir, "pages").select(F.col("page_id").cast("string").alias("path"), F.col("html").alias("content"))


def html_headings(spark, sf_dir):
    return native.html_headings(_pages(spark, sf_dir)).select("path", F.col("pos").cast("bigint").alias("pos"), F.col("level").cast("bigint").alias("level"), "name")


def html_links(spark, sf_dir):
    return native.html_links(_pages(spark, sf_dir)).groupBy("path", "target").agg(F.count("*").alias("n"))


def markdown_sections(spark, sf_dir):
    found = native.markdown_sections(spark.createDataFrame([("docs/guide.md", MARKDOWN)], "path string, content string"))
    return found.select("path", *[F.col(c).cast("bigint").alias(c) for c in ("line", "level", "end_line", "parent_line")], "name")


def markdown_links(spark, sf_dir):
    return native.markdown_links(spark.createDataFrame([("docs/guide.md", MARKDOWN)], "path string, content string"))


def csv_schema(spark, sf_dir):
    found = native.csv_schema(spark.createDataFrame([("t.csv", CSV), ("u.tsv", "a\tb\n1\t2\n")], "path string, content string"))
    return found.select("path", F.col("pos").cast("bigint").alias("pos"), "name", F.col("rows").cast("bigint").alias("rows"))


def json_tree(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(F.col("event_id").cast("string").alias("path"), F.concat(F.lit('{"p": '), "props", F.lit(', "l": [1, 2]}')).alias("content"))
    return native.json_tree(rows).select("path", "name", "snippet", F.col("depth").cast("bigint").alias("depth"))


def _parsed(spark, path, language, content):
    return parsers.extract(spark.createDataFrame([(path, language, content, 0)], "path string, language string, content string, seq int"))


def python_extract(spark, sf_dir):
    nodes, edges = _parsed(spark, "pkg/mod.py", "python", PYTHON)
    return nodes.select(F.lit("node").alias("row"), F.col("id").alias("a"), F.col("kind").alias("b"), F.col("name").alias("c")).unionByName(edges.select(F.lit("edge").alias("row"), F.col("source").alias("a"), F.col("relation").alias("b"), F.col("target").alias("c")))


def js_extract(spark, sf_dir):
    nodes, edges = _parsed(spark, "web/app.ts", "typescript", SCRIPT)
    return nodes.select(F.lit("node").alias("row"), F.col("id").alias("a"), F.col("kind").alias("b"), F.col("name").alias("c")).unionByName(edges.select(F.lit("edge").alias("row"), F.col("source").alias("a"), F.col("relation").alias("b"), F.col("target").alias("c")))


def resolve_refs(spark, sf_dir):
    part, lines = table(spark, sf_dir, "part"), table(spark, sf_dir, "lineitem")
    nodes = part.select(F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("id"), F.col("p_name").alias("label"))
    name = F.when(F.col("l_linenumber") == 5, F.concat("p_name", F.lit("?"))).when(F.col("l_linenumber") == 4, F.concat(F.lit("p"), F.col("l_partkey").cast("string"))).otherwise(F.col("p_name"))
    more = part.select(F.concat(F.lit("q"), F.col("p_partkey").cast("string")).alias("id"), F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("label"))
    wild = lines.join(part, lines.l_partkey == part.p_partkey).select(F.concat(F.lit("o"), F.col("l_orderkey").cast("string")).alias("source"), F.concat(F.lit("*::part::"), name).alias("target")).distinct()
    return build.resolve(nodes.unionByName(more), wild).select("source", "target", "confidence").distinct()


def directory_tree(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.concat_ws("/", "source", "lang", "doc_id").alias("file_path"))
    _, edges = build.directories(docs.select(F.col("file_path").alias("id"), "file_path"))
    return edges.select("source", "target")


def tier3_merge(spark, sf_dir):
    nodes, edges = graph(spark, sf_dir)
    kind = F.when(F.col("kind") == "customer", "property").when(F.col("kind") == "supplier", "class").otherwise("module")
    merged, _ = build.merge_small(nodes.withColumn("kind", kind), edges)
    return merged.select("id", "kind", F.size("merged_members").cast("bigint").alias("n_members"), F.md5(F.array_join("merged_members", ",")).alias("members_md5"))


def _members(spark, sf_dir):
    """Given communities: regions above, nations below."""
    nodes, _ = graph(spark, sf_dir)
    parts = F.split("file_path", "/")
    region = nodes.select(F.lit(0).alias("level"), parts[0].alias("community"), "id")
    nation = nodes.filter("kind <> 'region'").select(F.lit(1).alias("level"), F.get(parts, F.lit(1)).alias("community"), "id")
    return region.unionByName(nation)


def community_parent(spark, sf_dir):
    return communities.parents(_members(spark, sf_dir)).select(F.col("level").cast("bigint").alias("level"), "community", "parent")


def _summaries(spark, sf_dir):
    return communities.summaries(*graph(spark, sf_dir), _members(spark, sf_dir).filter("level = 1").drop("level"))


def community_summary(spark, sf_dir):
    return _summaries(spark, sf_dir)


def community_search(spark, sf_dir):
    found = _summaries(spark, sf_dir).withColumn("level", F.lit(1))
    return communities.search(found, ["suppliers", "#000000011", "1"], 10).select("community", "score")


def leiden_levels(spark, sf_dir):
    found = communities.levels(*graph(spark, sf_dir))
    return found.groupBy("level", "resolution", "community").agg(F.count("*").alias("members"))


def d3_export(spark, sf_dir):
    nodes, edges = graph(spark, sf_dir)
    found = export.d3_nodes(nodes, analytics.pagerank(nodes, edges, exactly=20))
    return found.select("id", "label", "kind", F.col("group").cast("bigint").alias("group"), F.round("size", 4).alias("size"))


def events_incremental(spark, sf_dir):
    """Newest version of each user's props, by a stream that takes all that is there."""
    source = f"{sf_dir}/events.parquet"
    stream = spark.readStream.schema(spark.read.parquet(source).schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    rows = stream.select(F.col("user_id").cast("string").alias("path"), F.col("event_id").cast("string").alias("version"), F.col("ts").cast("timestamp").alias("ts"), F.col("props").alias("content"))
    base = f"{shared_dir(spark)}/events-{uuid.uuid4().hex}"
    store = GraphStore(spark, f"{base}/store")
    incremental.follow(rows, store, f"{base}/progress").awaitTermination()
    return incremental.load(store).select("path", "version", "sha256")


QUERIES = {
    f.__name__: f
    for f in (detect_classify, html_headings, html_links, markdown_sections, markdown_links, csv_schema, json_tree, python_extract, js_extract, resolve_refs, directory_tree, tier3_merge, community_parent, community_summary, community_search, leiden_levels, d3_export, events_incremental)
}

_LANGUAGE = "CASE suffix " + " ".join(f"WHEN '{e}' THEN '{n}'" for e, n in files.LANGUAGE_OF.items()) + " ELSE 'unknown' END"
_STEM = r"regexp_replace(regexp_extract(split_part(x, '#', 1), '([^/]*)$', 1), '^(.+)\.[^.]+$', '\1')"
_SUMMARY = f"""{GRAPH_SQL},
m AS (SELECT split_part(file_path, '/', 2) AS community, nodes.* FROM nodes WHERE kind <> 'region'),
deg AS (SELECT a.community, x.id, count(*) AS degree FROM edges e JOIN m a ON a.id = e.source JOIN m b ON b.id = e.target AND a.community = b.community, LATERAL (SELECT unnest([e.source, e.target]) AS id) x GROUP BY ALL),
ranked AS (SELECT m.*, row_number() OVER (PARTITION BY m.community ORDER BY coalesce(degree, 0) DESC, m.id) AS rank FROM m LEFT JOIN deg ON deg.community = m.community AND deg.id = m.id),
top AS (SELECT * FROM ranked WHERE rank <= 20),
kinds AS (SELECT community, string_agg(n || ' ' || kind || CASE WHEN n > 1 THEN 's' ELSE '' END, ', ' ORDER BY n DESC, f) AS k FROM (SELECT community, kind, count(*) AS n, min(rank) AS f FROM top GROUP BY ALL) GROUP BY community),
names AS (SELECT community, string_agg(label, ', ' ORDER BY rank) AS l FROM top WHERE rank <= 10 GROUP BY community),
fs AS (SELECT community, array_to_string(list_sort(list(DISTINCT regexp_extract(file_path, '([^/]*)$', 1)))[1:5], ', ') AS f FROM top GROUP BY community),
sums AS (SELECT community, 'Contains ' || k || '. Key elements: ' || l || '. Files: ' || f || '.' AS summary FROM kinds JOIN names USING (community) JOIN fs USING (community))
"""
ORACLES = {
    "detect_classify": f"""WITH d AS (
        SELECT CASE WHEN doc_id % 13 = 0 THEN 'node_modules/' WHEN doc_id % 17 = 0 THEN 'secret_password/' ELSE '' END || source || '/' || lang || '/' || doc_id || {SUFFIXES!r}[doc_id % {len(SUFFIXES)} + 1] AS path, octet_length(encode(text)) AS n FROM documents
        UNION ALL SELECT regexp_replace(regexp_replace(url, '^https?://', ''), '[?#].*$', ''), octet_length(encode(html)) FROM pages),
      e AS (SELECT *, lower(regexp_extract(path, '[^/](\\.[^./]*)$', 1)) AS suffix, lower(regexp_extract(path, '([^/]*)$', 1)) AS name FROM d),
      t AS (SELECT *, {_LANGUAGE} AS language, CASE WHEN {_LANGUAGE} <> 'unknown' THEN 'code' WHEN suffix IN ('.rst', '.txt') THEN 'doc' WHEN suffix IN ('.ini', '.cfg') THEN 'config' ELSE 'other' END AS file_type FROM e)
      SELECT path, language, file_type, CASE WHEN path LIKE 'node_modules/%' THEN 'ignored'
        WHEN (regexp_matches(path, '^(.*/)?src1/') OR regexp_matches(path, '\\.cfg$')) AND NOT regexp_matches(path, '^src2/en/[^/]*\\.cfg$') THEN 'gitignore'
        WHEN regexp_matches(name, '\\.(env|pem|key|secret|p12|pfx)$|credentials|password') THEN 'sensitive'
        WHEN n > 1000000 THEN 'too_large' WHEN n = 0 THEN 'empty' WHEN file_type = 'other' THEN 'unsupported' END AS skip_reason FROM t""",
    "html_headings": r"""WITH h AS (SELECT page_id, regexp_extract_all(html, '(?is)<h[1-6]\b[^>]*>.*?</h[1-6]\s*>', 0) AS r FROM pages),
      u AS (SELECT page_id, unnest(r) AS raw, generate_subscripts(r, 1) - 1 AS pos FROM h)
      SELECT page_id::VARCHAR AS path, pos::BIGINT AS pos, regexp_extract(raw, '(?i)^<h([1-6])', 1)::BIGINT AS level, trim(regexp_replace(raw, '(?s)<[^>]*>', '', 'g')) AS name FROM u WHERE trim(regexp_replace(raw, '(?s)<[^>]*>', '', 'g')) <> ''""",
    "html_links": rf"""WITH l AS (SELECT page_id, unnest(regexp_extract_all(html, '(?is)<a\b[^>]*?\bhref\s*=\s*["\x27]([^"\x27]*)["\x27]', 1)) AS x FROM pages),
      t AS (SELECT page_id::VARCHAR AS path, '*::document::' || {_STEM} AS target FROM l WHERE x <> '' AND NOT regexp_matches(x, '^(http://|https://|mailto:|#|javascript:)'))
      SELECT path, target, count(*) AS n FROM t WHERE target <> '*::document::' GROUP BY ALL""",
    "markdown_sections": """SELECT 'docs/guide.md' AS path, * FROM (VALUES (1::BIGINT, 1::BIGINT, 3::BIGINT, 0::BIGINT, 'Guide'), (4, 2, 5, 1, 'Setup'), (6, 3, 7, 4, 'Needs'), (8, 2, 9, 1, 'Use'), (10, 1, 11, 0, 'Notes')) t(line, level, end_line, parent_line, name)""",
    "markdown_links": "SELECT 'docs/guide.md' AS path, '*::document::conf' AS target",
    "csv_schema": """SELECT * FROM (VALUES ('t.csv', 1::BIGINT, 'name', 3::BIGINT), ('t.csv', 2, 'a "b", c', 3), ('t.csv', 3, 'age', 3), ('u.tsv', 1, 'a', 2), ('u.tsv', 2, 'b', 2)) t(path, pos, name, rows)""",
    "json_tree": """WITH k AS (SELECT event_id::VARCHAR AS path, props, unnest(json_keys(props)) AS key FROM events)
      SELECT path, 'p.' || key AS name, key || ': ' || json_extract(props, key)::VARCHAR AS snippet, 2::BIGINT AS depth FROM k
      UNION ALL SELECT event_id::VARCHAR, 'p', 'p: (' || len(json_keys(props)) || ' keys)', 1 FROM events UNION ALL SELECT event_id::VARCHAR, 'l', 'l: [2 items]', 1 FROM events""",
    "python_extract": """SELECT * FROM (VALUES ('node', 'pkg/mod.py:0', 'module', 'mod'), ('node', 'pkg/mod.py:4', 'variable', 'LIMIT'), ('node', 'pkg/mod.py:7', 'class', 'Base'), ('node', 'pkg/mod.py:11', 'class', 'Child'),
      ('node', 'pkg/mod.py:14', 'method', 'Child.run'), ('node', 'pkg/mod.py:18', 'function', 'helper'), ('edge', 'pkg/mod.py:0', 'imports', '*::module::os'), ('edge', 'pkg/mod.py:0', 'imports', '*::module::a.b.c'),
      ('edge', 'pkg/mod.py:0', 'defines', 'pkg/mod.py:4'), ('edge', 'pkg/mod.py:0', 'defines', 'pkg/mod.py:7'), ('edge', 'pkg/mod.py:0', 'defines', 'pkg/mod.py:11'), ('edge', 'pkg/mod.py:11', 'inherits', '*::Base'),
      ('edge', 'pkg/mod.py:11', 'defines', 'pkg/mod.py:14'), ('edge', 'pkg/mod.py:14', 'calls', '*::helper'), ('edge', 'pkg/mod.py:0', 'defines', 'pkg/mod.py:18')) t("row", a, b, c)""",
    "js_extract": """SELECT * FROM (VALUES ('node', 'web/app.ts:0', 'module', 'app'), ('node', 'web/app.ts:2', 'class', 'App'), ('node', 'web/app.ts:3', 'method', 'App.render'), ('node', 'web/app.ts:7', 'function', 'draw'), ('node', 'web/app.ts:8', 'function', 'add'),
      ('node', 'web/app.ts:9', 'interface', 'Shape'), ('node', 'web/app.ts:10', 'method', 'Shape.area'), ('edge', 'web/app.ts:0', 'imports', '*::module::./a'), ('edge', 'web/app.ts:0', 'defines', 'web/app.ts:2'), ('edge', 'web/app.ts:2', 'inherits', '*::Component'),
      ('edge', 'web/app.ts:2', 'defines', 'web/app.ts:3'), ('edge', 'web/app.ts:3', 'calls', '*::draw'), ('edge', 'web/app.ts:0', 'defines', 'web/app.ts:7'), ('edge', 'web/app.ts:0', 'defines', 'web/app.ts:8'), ('edge', 'web/app.ts:0', 'defines', 'web/app.ts:9'),
      ('edge', 'web/app.ts:9', 'extends', '*::Base'), ('edge', 'web/app.ts:9', 'defines', 'web/app.ts:10')) t("row", a, b, c)""",
    "resolve_refs": """WITH n AS (SELECT 'p' || p_partkey AS id, p_name AS label FROM part UNION ALL SELECT 'q' || p_partkey, 'p' || p_partkey FROM part),
      i AS (SELECT label, count(*) AS n, min(id) AS id FROM n GROUP BY label),
      w AS (SELECT DISTINCT 'o' || l_orderkey AS source, CASE l_linenumber WHEN 5 THEN p_name || '?' WHEN 4 THEN 'p' || l_partkey ELSE p_name END AS name FROM lineitem JOIN part ON l_partkey = p_partkey)
      SELECT DISTINCT source, coalesce(id, 'external::' || name) AS target, CASE WHEN n = 1 THEN 'EXTRACTED' ELSE 'INFERRED' END AS confidence FROM w LEFT JOIN i ON label = name WHERE n IS NULL OR n = 1""",
    "directory_tree": """SELECT 'dir::' || source || '/' || lang AS source, source || '/' || lang || '/' || doc_id AS target FROM documents
      UNION SELECT 'dir::' || source, 'dir::' || source || '/' || lang FROM documents""",
    "tier3_merge": f"""WITH {GRAPH_SQL}, f AS (SELECT source, count(*) AS n, string_agg(label, ',' ORDER BY target) AS l FROM edges JOIN nodes ON id = target WHERE kind = 'customer' GROUP BY source)
      SELECT id, CASE kind WHEN 'supplier' THEN 'class' ELSE 'module' END AS kind, coalesce(n, 0) AS n_members, md5(coalesce(l, '')) AS members_md5 FROM nodes LEFT JOIN f ON f.source = id WHERE kind <> 'customer'""",
    "community_parent": f"""WITH {GRAPH_SQL} SELECT 0::BIGINT AS level, split_part(file_path, '/', 1) AS community, NULL::VARCHAR AS parent FROM nodes
      UNION SELECT 1, split_part(file_path, '/', 2), split_part(file_path, '/', 1) FROM nodes WHERE kind <> 'region'""",
    "community_summary": f"WITH {_SUMMARY} SELECT community, summary FROM sums",
    "community_search": f"""WITH {_SUMMARY}, x AS (SELECT community, contains(lower(summary), 'suppliers')::BIGINT + contains(lower(summary), '#000000011')::BIGINT + contains(lower(summary), '1')::BIGINT AS score FROM sums)
      SELECT community, score FROM x WHERE score > 0 ORDER BY score DESC, community LIMIT 10""",
    "d3_export": f"""WITH RECURSIVE {GRAPH_SQL}, {_RANK}, r AS (SELECT id, pagerank FROM rank WHERE step = 20)
      SELECT id, label, kind, dense_rank() OVER (ORDER BY kind) - 1 AS "group", round(4 + 16 * pagerank / (SELECT max(pagerank) FROM r), 4) AS size FROM nodes JOIN r USING (id)""",
    "events_incremental": """SELECT user_id::VARCHAR AS path, event_id::VARCHAR AS version, sha256(props) AS sha256 FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id::VARCHAR DESC) AS k FROM events) WHERE k = 1""",
}

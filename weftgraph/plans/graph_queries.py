"""Graph analytics on the graph adapter."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftgraph.operators import analytics as A
from weftgraph.operators.components import components
from weftgraph.plans.adapters import GRAPH_SQL, graph, vectors


def pagerank(spark, sf_dir):
    nodes, edges = graph(spark, sf_dir)
    return A.pagerank(nodes, edges, exactly=20).select("id", F.round("pagerank", 8).alias("pagerank"))


def degrees(spark, sf_dir):
    return A.degrees(*graph(spark, sf_dir))


def god_nodes(spark, sf_dir):
    nodes, edges = graph(spark, sf_dir)
    return A.god_nodes(A.degrees(nodes, edges), A.pagerank(nodes, edges, exactly=20), 10)


def connected_components(spark, sf_dir):
    return A.component_labels(*graph(spark, sf_dir))


def clustering_coeff(spark, sf_dir):
    return A.clustering(*graph(spark, sf_dir)).select("id", F.round("clustering", 8).alias("clustering"))


def graph_quality(spark, sf_dir):
    return A.quality(*graph(spark, sf_dir))


def graph_stats(spark, sf_dir):
    return A.stats(*graph(spark, sf_dir))


def betweenness(spark, sf_dir):
    return A.betweenness(*graph(spark, sf_dir), pivots=None).orderBy(F.desc("betweenness"), "id").limit(10).select("id", F.round("betweenness", 6).alias("betweenness"))


def surprising_edges(spark, sf_dir):
    return A.surprising(*graph(spark, sf_dir), 10)


def hub_filter(spark, sf_dir):
    return A.hubs(*graph(spark, sf_dir))


def edge_weights(spark, sf_dir):
    nodes, edges = graph(spark, sf_dir)
    v = vectors(spark, sf_dir).select(F.concat(F.lit("s"), F.col("vec_id").cast("string")).alias("id"), "vector")
    more = vectors(spark, sf_dir).filter("vec_id < 5").select(F.concat(F.lit("r"), F.col("vec_id").cast("string")).alias("id"), "vector")
    return A.edge_weights(nodes, edges, v.unionByName(more))


SEEDS = ["s1", "s2", "c3", "n4", "c5"]


def shortest_paths(spark, sf_dir):
    _, edges = graph(spark, sf_dir)
    seeds = spark.createDataFrame([(s,) for s in SEEDS], "id string")
    found = A.bounded_paths(edges, seeds, hops=3)
    return found.select("seed", "id", F.col("distance").cast("bigint").alias("distance"))


def seed_subgraph(spark, sf_dir):
    _, edges = graph(spark, sf_dir)
    _, kept, _ = A.seed_subgraph(edges, SEEDS)
    return spark.createDataFrame(kept, "source string, relation string, target string")


def node_lookup(spark, sf_dir):
    nodes, _ = graph(spark, sf_dir)
    return A.lookup(nodes, "AN", most=5)


def node_lookup_label(spark, sf_dir):
    """By a part of labels, in other case than theirs: no id is the text, so all that hold it."""
    nodes, _ = graph(spark, sf_dir)
    return A.lookup(nodes, "Nation_1", most=None)


def components_of_path(spark, sf_dir):
    """All parts in one line: part k hangs on part k + 1."""
    part = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey")
    found = components(part.select(F.col("p_partkey").alias("a"), (F.col("p_partkey") + 1).alias("b")))
    return found.select(F.col("node").alias("id"), "component")


def result_edges(spark, sf_dir):
    """Edges among the regions, nations and first suppliers, by label."""
    nodes, edges = graph(spark, sf_dir)
    return A.result_edges(nodes, edges, nodes.filter("kind in ('region', 'nation') or id in ('s1', 's2', 's3')").select("id"))


def neighbourhood(spark, sf_dir):
    return A.neighbourhood(*graph(spark, sf_dir), "n7")


QUERIES = {
    f.__name__: f
    for f in (pagerank, degrees, god_nodes, connected_components, clustering_coeff, graph_quality, graph_stats, betweenness, surprising_edges, hub_filter, edge_weights, shortest_paths, seed_subgraph, node_lookup, node_lookup_label, components_of_path, result_edges, neighbourhood)
}

_DEGREES = """
ends AS (SELECT source AS id, 0 AS i, 1 AS o FROM edges UNION ALL SELECT target, 1, 0 FROM edges),
d AS (SELECT id, coalesce(sum(i), 0)::BIGINT AS in_degree, coalesce(sum(o), 0)::BIGINT AS out_degree FROM nodes LEFT JOIN ends USING (id) GROUP BY id)
"""
_RANK = """
outs AS (SELECT source, count(*) AS n FROM edges GROUP BY source),
size AS (SELECT count(*)::DOUBLE AS n FROM nodes),
rank AS (
  SELECT 0 AS step, id, 1.0 / n AS pagerank FROM nodes, size
  UNION ALL
  SELECT step, id, 0.85 * (flow + dangling / n) + 0.15 / n FROM (
    SELECT any_value(r.step) + 1 AS step, x.id, coalesce(sum(r.pagerank / o.n) FILTER (r.id = x.source), 0.0) AS flow,
           (SELECT coalesce(sum(pagerank), 0.0) FROM rank WHERE id NOT IN (SELECT source FROM outs)) AS dangling
    FROM (SELECT nodes.id, edges.source FROM nodes LEFT JOIN edges ON edges.target = nodes.id) x
    LEFT JOIN rank r ON r.id = coalesce(x.source, (SELECT min(id) FROM nodes))
    LEFT JOIN outs o ON o.source = x.source
    GROUP BY x.id), size
  WHERE step <= 20)
"""
# regions and what hangs on them: three rounds of minima reach every node of this graph
_LABELS = """
arcs AS (SELECT source AS u, target AS v FROM edges UNION SELECT target, source FROM edges),
l0 AS (SELECT id, id AS m FROM nodes),
l1 AS (SELECT l.id, least(l.m, coalesce(min(k.m), l.m)) AS m FROM l0 l LEFT JOIN arcs ON arcs.u = l.id LEFT JOIN l0 k ON k.id = arcs.v GROUP BY l.id, l.m),
l2 AS (SELECT l.id, least(l.m, coalesce(min(k.m), l.m)) AS m FROM l1 l LEFT JOIN arcs ON arcs.u = l.id LEFT JOIN l1 k ON k.id = arcs.v GROUP BY l.id, l.m),
l3 AS (SELECT l.id, least(l.m, coalesce(min(k.m), l.m)) AS m FROM l2 l LEFT JOIN arcs ON arcs.u = l.id LEFT JOIN l2 k ON k.id = arcs.v GROUP BY l.id, l.m),
l4 AS (SELECT l.id, least(l.m, coalesce(min(k.m), l.m)) AS m FROM l3 l LEFT JOIN arcs ON arcs.u = l.id LEFT JOIN l3 k ON k.id = arcs.v GROUP BY l.id, l.m),
labels AS (SELECT l.id, least(l.m, coalesce(min(k.m), l.m)) AS component FROM l4 l LEFT JOIN arcs ON arcs.u = l.id LEFT JOIN l4 k ON k.id = arcs.v GROUP BY l.id, l.m)
"""
_CLUSTER = """
pairs AS (SELECT DISTINCT least(source, target) AS a, greatest(source, target) AS b FROM edges WHERE source <> target),
sides AS (SELECT a AS u, b AS v FROM pairs UNION ALL SELECT b, a FROM pairs),
sizes AS (SELECT u AS id, count(*) AS k FROM sides GROUP BY u),
tri AS (SELECT x.u AS id, count(*) AS t FROM sides x JOIN sides y ON x.u = y.u AND x.v < y.v JOIN pairs ON pairs.a = x.v AND pairs.b = y.v GROUP BY x.u),
local AS (SELECT id, CASE WHEN coalesce(k, 0) >= 2 THEN 2.0::DOUBLE * coalesce(t, 0) / (k * (k - 1)) ELSE 0.0::DOUBLE END AS clustering FROM nodes LEFT JOIN sizes USING (id) LEFT JOIN tri USING (id))
"""
_QUALITY = """
q AS (SELECT (SELECT count(*) FROM nodes) AS nodes, (SELECT count(*) FROM edges) AS edges,
  (SELECT count(*) FROM d WHERE in_degree + out_degree = 0) AS isolated,
  (SELECT round(avg((confidence = 'EXTRACTED')::INT::DOUBLE), 4) FROM edges) AS extracted_ratio,
  (SELECT round(avg((confidence = 'INFERRED')::INT::DOUBLE), 4) FROM edges) AS inferred_ratio,
  (SELECT round(avg((confidence = 'AMBIGUOUS')::INT::DOUBLE), 4) FROM edges) AS ambiguous_ratio,
  (SELECT count(DISTINCT component) FROM labels) AS components)
"""
# shortest paths of this graph have four steps at most (from a nation over a supplier, its region and another nation); the fifth level shows that none is longer
_STEP = "l{k} AS (SELECT l.s, e.t, {k} AS d, sum(g) AS g FROM l{j} l JOIN e ON l.t = e.s ANTI JOIN p{j} p ON p.s = l.s AND p.t = e.t GROUP BY l.s, e.t), p{k} AS (SELECT * FROM p{j} UNION ALL SELECT * FROM l{k})"
_BETWEEN = f"""
e AS (SELECT DISTINCT source AS s, target AS t FROM edges WHERE source <> target),
p0 AS (SELECT id AS s, id AS t, 0 AS d, 1.0::DOUBLE AS g FROM nodes),
l0 AS (SELECT * FROM p0),
{", ".join(_STEP.format(k=k, j=k - 1) for k in range(1, 6))},
through AS (SELECT v.t AS id, sum(v.g * w.g / p.g) AS n FROM p5 v JOIN p5 w ON w.s = v.t JOIN p5 p ON p.s = v.s AND p.t = w.t AND p.d = v.d + w.d WHERE v.d > 0 AND w.d > 0 GROUP BY v.t),
between_ AS (SELECT nodes.id, coalesce(n, 0) / ((SELECT count(*) FROM nodes) - 1) / ((SELECT count(*) FROM nodes) - 2) AS betweenness FROM nodes LEFT JOIN through USING (id))
"""
_WITH = f"WITH RECURSIVE {GRAPH_SQL}"
ORACLES = {
    "degrees": f"{_WITH}, {_DEGREES} SELECT id, in_degree, out_degree, in_degree + out_degree AS degree FROM d",
    "pagerank": f"{_WITH}, {_RANK} SELECT id, round(pagerank, 8) AS pagerank FROM rank WHERE step = 20",
    "god_nodes": f"{_WITH}, {_RANK}, {_DEGREES} SELECT id, in_degree + out_degree AS degree, round(pagerank, 6) AS pagerank FROM d JOIN rank USING (id) WHERE step = 20 ORDER BY (in_degree + out_degree) * pagerank DESC, id LIMIT 10",
    "connected_components": f"{_WITH}, {_LABELS} SELECT id, component FROM labels",
    "clustering_coeff": f"{_WITH}, {_CLUSTER} SELECT id, round(clustering, 8) AS clustering FROM local",
    "graph_quality": f"{_WITH}, {_DEGREES}, {_LABELS}, {_QUALITY} SELECT nodes, edges, round(edges / greatest(nodes * (nodes - 1), 1), 6) AS density, isolated, extracted_ratio, inferred_ratio, ambiguous_ratio, components FROM q",
    "graph_stats": f"""{_WITH}, {_DEGREES}, {_LABELS}, {_QUALITY}, {_CLUSTER}
      SELECT 'kind' AS metric, kind AS name, count(*)::DOUBLE AS value FROM nodes GROUP BY kind
      UNION ALL SELECT 'confidence', confidence, count(*)::DOUBLE FROM edges GROUP BY confidence
      UNION ALL SELECT 'average_clustering', '', round(avg(clustering), 6) FROM local
      UNION ALL SELECT 'nodes', '', nodes::DOUBLE FROM q UNION ALL SELECT 'edges', '', edges::DOUBLE FROM q
      UNION ALL SELECT 'density', '', round(edges / (nodes * (nodes - 1)), 6) FROM q
      UNION ALL SELECT 'isolated', '', isolated::DOUBLE FROM q UNION ALL SELECT 'components', '', components::DOUBLE FROM q""",
    "surprising_edges": f"""{_WITH} SELECT source, target, relation, confidence, a.file_path AS source_file, b.file_path AS target_file
      FROM edges JOIN nodes a ON a.id = source JOIN nodes b ON b.id = target
      WHERE confidence IN ('INFERRED', 'AMBIGUOUS') AND a.file_path <> b.file_path ORDER BY source, target, relation LIMIT 20""",
    "hub_filter": f"{_WITH}, {_DEGREES} SELECT id, in_degree FROM d WHERE in_degree > greatest((SELECT quantile_cont(in_degree, 0.97) FROM d), 10)",
    "edge_weights": f"""{_WITH},
      v AS (SELECT 's' || vec_id AS id, embedding::DOUBLE[] AS x FROM embeddings UNION ALL SELECT 'r' || vec_id, embedding::DOUBLE[] FROM embeddings WHERE vec_id < 5),
      w AS (SELECT source, target, relation, confidence, a.file_path AS p, b.file_path AS q,
              greatest(coalesce(list_dot_product(s.x, t.x) / sqrt(list_dot_product(s.x, s.x)) / sqrt(list_dot_product(t.x, t.x)), 0), 0) AS semantic,
              EXISTS (SELECT 1 FROM edges e WHERE e.source = edges.target AND e.target = edges.source) AS two_way
            FROM edges JOIN nodes a ON a.id = source JOIN nodes b ON b.id = target LEFT JOIN v s ON s.id = source LEFT JOIN v t ON t.id = target)
      SELECT source, target, relation, round(semantic, 4) AS semantic_similarity,
        round(0.4::DOUBLE * semantic + 0.3::DOUBLE * (CASE confidence WHEN 'EXTRACTED' THEN 1.0::DOUBLE WHEN 'AMBIGUOUS' THEN 0.3::DOUBLE ELSE 0.5::DOUBLE END)
          + 0.2::DOUBLE * (CASE WHEN p = q THEN 1.0::DOUBLE WHEN regexp_extract(p, '^(.*)/[^/]*$', 1) = regexp_extract(q, '^(.*)/[^/]*$', 1) THEN 0.7::DOUBLE ELSE 0.4::DOUBLE END)
          + 0.1::DOUBLE * (CASE WHEN two_way THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 4) AS weight FROM w""",
    "shortest_paths": f"""{_WITH}, arcs AS (SELECT source AS u, target AS v FROM edges UNION SELECT target, source FROM edges),
      h0 AS (SELECT unnest(['s1', 's2', 'c3', 'n4', 'c5']) AS seed), w0 AS (SELECT seed, seed AS id, 0 AS d FROM h0),
      w1 AS (SELECT * FROM w0 UNION SELECT seed, v, 1 FROM w0 JOIN arcs ON u = id),
      w2 AS (SELECT * FROM w1 UNION SELECT seed, v, 2 FROM w1 JOIN arcs ON u = id WHERE d = 1),
      w3 AS (SELECT * FROM w2 UNION SELECT seed, v, 3 FROM w2 JOIN arcs ON u = id WHERE d = 2)
      SELECT seed, id, min(d)::BIGINT AS distance FROM w3 GROUP BY seed, id""",
    "betweenness": f"{_WITH}, {_BETWEEN} SELECT id, round(betweenness, 6) AS betweenness FROM between_ ORDER BY between_.betweenness DESC, id LIMIT 10",
    "node_lookup_label": f"{_WITH} SELECT * FROM nodes WHERE contains(lower(label), 'nation_1') OR contains(lower(id), 'nation_1')",
    "components_of_path": "SELECT unnest(range(min(p_partkey) + 1, max(p_partkey) + 2)) AS id, min(p_partkey) AS component FROM part HAVING count(*) = max(p_partkey) - min(p_partkey) + 1",
    "result_edges": f"""{_WITH}, chosen AS (SELECT id, label FROM nodes WHERE kind IN ('region', 'nation') OR id IN ('s1', 's2', 's3'))
      SELECT a.label AS "from", b.label AS "to", min(relation) AS rel FROM edges JOIN chosen a ON a.id = source JOIN chosen b ON b.id = target GROUP BY source, target, a.label, b.label""",
    "node_lookup": f"{_WITH} SELECT * FROM nodes WHERE contains(lower(id), 'an') OR contains(lower(label), 'an') ORDER BY id LIMIT 5",
    "neighbourhood": f"""{_WITH} SELECT direction, n.id, label, relation, confidence FROM (
      SELECT 'out' AS direction, target AS id, relation, confidence FROM edges WHERE source = 'n7'
      UNION ALL SELECT 'in', source, relation, confidence FROM edges WHERE target = 'n7') x JOIN nodes n ON n.id = x.id""",
}

"""Exports of a graph: node-link JSON, GraphML, D3, an HTML page."""

from __future__ import annotations

import html
import json
from xml.sax.saxutils import escape, quoteattr

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def d3_nodes(nodes: DataFrame, rank: DataFrame) -> DataFrame:
    """id, label, kind, group (index of the sorted kinds), size (4 to 20 by PageRank)."""
    kind = F.coalesce("kind", F.lit("unknown"))
    kinds = nodes.select(kind.alias("kind")).distinct().agg(F.sort_array(F.collect_set("kind")).alias("kinds"))
    most = rank.agg(F.max("pagerank").alias("most"))
    rows = nodes.withColumn("kind", kind).join(rank.hint("merge"), "id", "left").crossJoin(F.broadcast(kinds)).crossJoin(F.broadcast(most))  # one row each
    size = F.when(F.col("most") > 0, 4 + 16 * F.coalesce("pagerank", F.lit(0.0)) / F.col("most")).otherwise(4.0)
    return rows.select("id", F.coalesce("label", "id").alias("label"), "kind", (F.array_position("kinds", F.col("kind")) - 1).alias("group"), F.round(size, 6).alias("size"))


def top_subgraph(nodes: DataFrame, edges: DataFrame, rank: DataFrame, most: int = 500) -> tuple[DataFrame, DataFrame]:
    """The ``most`` nodes of largest PageRank (ties by id) and the edges among them."""
    ids = rank.orderBy(F.desc("pagerank"), "id").limit(most).select("id")
    kept = edges.join(ids.withColumnRenamed("id", "source"), "source", "left_semi").join(ids.withColumnRenamed("id", "target"), "target", "left_semi")
    return nodes.join(ids, "id", "left_semi"), kept


def d3_json(nodes: DataFrame, edges: DataFrame, rank: DataFrame) -> str:
    """For graphs that a browser can show; cut with :func:`top_subgraph` before."""
    ns = [r.asDict() for r in d3_nodes(nodes, rank).orderBy("id").toLocalIterator()]
    value = F.col("weight") if "weight" in edges.columns else F.lit(1.0)
    links = [r.asDict() for r in edges.select("source", "target", F.coalesce("relation", F.lit("")).alias("relation"), value.alias("value")).orderBy("source", "target").toLocalIterator()]
    groups = {n["kind"]: n["group"] for n in ns}
    return json.dumps({"nodes": ns, "links": links, "metadata": {"node_count": len(ns), "link_count": len(links), "kind_groups": groups}}, separators=(",", ":"), default=str)


def node_link(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """Nodes and links as JSON lines below ``path``, written by the executors."""
    nodes.write.mode("overwrite").json(f"{path}/nodes")
    edges.write.mode("overwrite").json(f"{path}/links")


def node_link_json(nodes: DataFrame, edges: DataFrame) -> str:
    """One node-link document, for small graphs."""
    ns = [json.loads(x) for x in nodes.orderBy("id").toJSON().toLocalIterator()]
    ls = [json.loads(x) for x in edges.orderBy("source", "target").toJSON().toLocalIterator()]
    return json.dumps({"directed": True, "multigraph": False, "graph": {}, "nodes": ns, "links": ls}, separators=(",", ":"))


def graphml(nodes: DataFrame, edges: DataFrame) -> str:
    """GraphML with every column as text; lists and maps as JSON."""
    text = lambda df: df.select([(F.to_json(c) if t.startswith(("array", "map", "struct")) else F.col(c).cast("string")).alias(c) for c, t in df.dtypes])
    ncols, ecols = [c for c in nodes.columns if c != "id"], [c for c in edges.columns if c not in ("source", "target")]
    out = ['<?xml version="1.0" encoding="UTF-8"?>', '<graphml xmlns="http://graphml.graphdrawing.org/xmlns">']
    out += [f'<key id={quoteattr("n_" + c)} for="node" attr.name={quoteattr(c)} attr.type="string"/>' for c in ncols]
    out += [f'<key id={quoteattr("e_" + c)} for="edge" attr.name={quoteattr(c)} attr.type="string"/>' for c in ecols]
    out.append('<graph edgedefault="directed">')
    data = lambda r, cols, p: "".join(f'<data key={quoteattr(p + c)}>{escape(r[c])}</data>' for c in cols if r[c] is not None)
    out += [f"<node id={quoteattr(r['id'])}>{data(r, ncols, 'n_')}</node>" for r in text(nodes).orderBy("id").toLocalIterator()]
    out += [f"<edge source={quoteattr(r['source'])} target={quoteattr(r['target'])}>{data(r, ecols, 'e_')}</edge>" for r in text(edges).orderBy("source", "target").toLocalIterator()]
    return "\n".join([*out, "</graph>", "</graphml>"])


def _escaped(value):
    """A string column as XML text; characters that XML can't hold are left out."""
    out = F.regexp_replace(value, r"[\x00-\x08\x0b\x0c\x0e-\x1f]", "")
    for sign, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        out = F.replace(out, F.lit(sign), F.lit(name))
    return out


def graphml_to(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """GraphML below ``path`` in parts, written by the executors: the parts in the order of their names are the document."""

    def text(df: DataFrame, own: list[str], mark: str, tag: str, attributes: dict[str, str]) -> DataFrame:
        shown = lambda c, kind: F.to_json(c) if kind.startswith(("array", "map", "struct")) else F.col(c).cast("string")
        data = [F.coalesce(F.concat(F.lit(f'<data key="{mark}{c}">'), _escaped(shown(c, kind)), F.lit("</data>")), F.lit("")) for c, kind in df.dtypes if c not in own]
        head = [F.concat(F.lit(f' {name}="'), _escaped(F.col(c)), F.lit('"')) for name, c in attributes.items()]
        return df.select(F.concat(F.lit(f"<{tag}"), *head, F.lit(">"), *data, F.lit(f"</{tag}>")).alias("value"))

    keys = [f'<key id="n_{c}" for="node" attr.name="{c}" attr.type="string"/>' for c in nodes.columns if c != "id"]
    keys += [f'<key id="e_{c}" for="edge" attr.name="{c}" attr.type="string"/>' for c in edges.columns if c not in ("source", "target")]
    head = "\n".join(['<?xml version="1.0" encoding="UTF-8"?>', '<graphml xmlns="http://graphml.graphdrawing.org/xmlns">', *keys, '<graph edgedefault="directed">'])
    spark = nodes.sparkSession
    ends = spark.createDataFrame([(0, head), (3, "</graph>\n</graphml>")], "k int, value string")
    body = text(nodes, ["id"], "n_", "node", {"id": "id"}).withColumn("k", F.lit(1)).unionByName(text(edges, ["source", "target"], "e_", "edge", {"source": "source", "target": "target"}).withColumn("k", F.lit(2)))
    ends.unionByName(body).orderBy("k", "value").select("value").write.mode("overwrite").text(path)


def page(d3: str, title: str = "graph") -> str:
    """A page that draws a D3 document with a small force layout and no outside script."""
    return (
        f"<!doctype html><meta charset=utf-8><title>{html.escape(title)}</title><canvas id=c></canvas><script>\nconst g={d3.replace('</', '<\\/')};\n"
        "const c=document.getElementById('c'),x=c.getContext('2d');c.width=innerWidth;c.height=innerHeight;\n"
        "const at={};g.nodes.forEach((n,i)=>{n.x=c.width/2+200*Math.cos(i);n.y=c.height/2+200*Math.sin(i*1.7);at[n.id]=n});\n"
        "const k=Object.keys(g.metadata.kind_groups).length;\n"
        "function step(){for(const l of g.links){const a=at[l.source],b=at[l.target];if(!a||!b)continue;const dx=(b.x-a.x)*.01,dy=(b.y-a.y)*.01;a.x+=dx;a.y+=dy;b.x-=dx;b.y-=dy}\n"
        "x.clearRect(0,0,c.width,c.height);x.strokeStyle='#bbb';for(const l of g.links){const a=at[l.source],b=at[l.target];if(!a||!b)continue;x.beginPath();x.moveTo(a.x,a.y);x.lineTo(b.x,b.y);x.stroke()}\n"
        "for(const n of g.nodes){x.fillStyle=`hsl(${360*n.group/k},60%,50%)`;x.beginPath();x.arc(n.x,n.y,n.size/2,0,7);x.fill()}requestAnimationFrame(step)}step();\n</script>"
    )

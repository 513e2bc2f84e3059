"""Build a stored graph from a source tree, and ask it."""

from __future__ import annotations

import hashlib
import json
from collections import OrderedDict
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph import export
from weftgraph.extract import files as parsers
from weftgraph.operators import analytics, build, cochange, communities, embedding, retrieval
from weftgraph.sources import files, gitlog
from weftgraph.staging import Staged
from weftgraph.store import GraphStore


@dataclass
class Found:
    """Seeds and path nodes with scores, edges among them, seeds without a path."""

    seeds: list[tuple[str, float]]
    between: list[str]
    edges: list[tuple[str, str, str]]
    isolated: list[str]
    parts: dict[str, dict[str, float]] = field(default_factory=dict)

    def text(self, source_dir: str = "", with_isolated: bool = False) -> str:
        short = lambda x: x.removeprefix(source_dir.rstrip("/") + "/") if source_dir else x
        shown = [s for s, _ in self.seeds if with_isolated or s not in self.isolated]
        return "\n".join(["seeds:", *map(short, shown), "", "edges:", *(f"{short(a)} -{r}-> {short(b)}" for a, r, b in self.edges)])


SEARCHED = ["label", "kind", "file_path", "docstring", "signature"]


def _with_cochange(spark: SparkSession, source_dir: str, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges with those of files that change together, where the source folder lies in a repository."""
    folder = source_dir.removeprefix("file://")
    log = gitlog.stage_log(spark, folder) if gitlog.is_repository(folder) else None
    if log is None:
        return edges
    commits, renames = gitlog.parse_blocks(log)
    named = cochange.resolve_renames(renames)
    commits = commits.join(named, commits["file"] == named["old"], "left").select("seq", "hash", "ts", "message", F.coalesce("new", "file").alias("file"))
    # the log's paths begin at the top of the repository, the graph's at the source folder
    pairs = cochange.pairs(gitlog.scope(commits, gitlog.prefix(folder)))
    owner = nodes.filter(F.col("kind").isin("module", "document")).select("file_path", "id").groupBy("file_path").agg(F.max("id").alias("id"))
    to = lambda c: owner.select(F.col("file_path").alias(c), F.col("id").alias(f"{c}_id"))
    pairs = pairs.join(to("a"), "a").join(to("b"), "b").select(F.col("a_id").alias("a"), F.col("b_id").alias("b"), "confidence")
    return cochange.enrich(edges, pairs)


def build_graph_store(
    spark: SparkSession,
    source_dir: str,
    store_dir: str,
    incremental: bool = False,
    embed: bool = True,
    most_bytes: int = files.MOST_BYTES,
    resolutions: tuple[float, ...] = communities.RESOLUTIONS,
    encoders: dict[str, embedding.Encoder] | None = None,
    models: dict[str, str] | None = None,
) -> dict[str, int]:
    """Scan, extract, build, merge, add co-change, rank, embed, weigh, cluster, summarise, index and store; returns counts.

    Each file is read and parsed once, where it is read; an incremental build reads all files for
    their hashes (and is done if none changed), parses only files whose contents changed, keeps the raw
    rows of the others and resolves all references again, so no edge into or out
    of an unchanged file is lost and deleted files go.
    """
    store = GraphStore(spark, store_dir)
    todo = files.scan(spark, source_dir, most_bytes=most_bytes).filter("skip_reason is null")
    before = store.load("manifest") if incremental else None
    if before is not None:
        todo = Staged(todo, "scan").df
        now = Staged(files.manifest(todo), "manifest").df
        changes = Staged(files.diff(before, now), "changes").df
        if changes.filter("change <> 'unchanged'").isEmpty() and store.load("communities") is not None:
            return {"files": now.count(), "parsed": 0, "nodes": store.load("nodes").count(), "edges": store.load("edges").count(), "communities": store.load("communities").count()}
        todo = todo.join(changes.filter("change in ('added', 'changed')"), "path", "left_semi")
    rows = Staged(parsers.parsed(todo), "parsed").df
    fresh = rows.filter("kind_of_row = 'file'").select(F.col("file_path").alias("path"), "sha256")
    nodes, edges = parsers.raw_nodes(rows), parsers.raw_edges(rows)
    if before is None:
        now = fresh
    else:
        same = changes.filter("change = 'unchanged'").select(F.col("path").alias("file_seq"))
        nodes = nodes.unionByName(store.load("raw_nodes").join(same, "file_seq", "left_semi"))
        edges = edges.unionByName(store.load("raw_edges").join(same, "file_seq", "left_semi"))
    store.save("raw_nodes", nodes, tidy=False)
    store.save("raw_edges", edges, tidy=False)
    full_nodes, full_edges = build.merge_small(*build.build(store.load("raw_nodes"), store.load("raw_edges")))
    store.save_graph(full_nodes, _with_cochange(spark, source_dir, full_nodes, full_edges), tidy=False)
    nodes, edges = store.load("nodes"), store.load("edges")
    store.save("pagerank", analytics.pagerank(nodes, edges), tidy=False)
    for c in SEARCHED:
        if c not in nodes.columns:
            nodes = nodes.withColumn(c, F.lit(""))
    store.save("postings", retrieval.postings(nodes, columns=SEARCHED, stem=True), tidy=False)
    vectors = None
    if embed:
        known = store.load("embeddings") if incremental else None
        if known is not None:
            changed = fresh.select(F.col("path").alias("file_path"))
            known = known.join(nodes.join(changed, "file_path", "left_anti").select(F.col("id").alias("node_id")), "node_id", "left_semi")
        new = embedding.embed(nodes, known, encoders, models)
        store.save("embeddings", new if known is None else known.unionByName(new), tidy=False, partition_by=["model_type"])
        vectors = store.load("embeddings").select(F.col("node_id").alias("id"), "vector")
    store.save("weights", analytics.edge_weights(nodes, edges, vectors), tidy=False)
    members = communities.levels(nodes, edges, resolutions)
    store.save("community_members", members.withColumn("community", F.concat_ws(":", "level", "community")), tidy=False)
    members = store.load("community_members")
    texts = communities.summaries(nodes, edges, members.select("community", "id"))
    up = communities.parents(members)
    store.save("communities", members.select("community", "level", "resolution").distinct().join(texts, "community").join(up.select("community", "parent"), "community", "left"), tidy=False)
    store.save("manifest", now, tidy=False)
    store.set_meta("source_dir", source_dir)  # the last save tidies up
    return {"files": store.load("manifest").count(), "parsed": fresh.count(), "nodes": nodes.count(), "edges": edges.count(), "communities": store.load("communities").count()}


class Engine:
    """A stored graph with its query functions; results of a search are kept by all its parameters."""

    def __init__(self, spark: SparkSession, store_dir: str, encoders: dict[str, embedding.Encoder] | None = None, models: dict[str, str] | None = None, kept: int = 128):
        self.spark, self.store = spark, GraphStore(spark, store_dir)
        encoders = encoders or {"code": embedding.hashing_encoder(), "text": embedding.hashing_encoder()}
        self.query_vectors = embedding.QueryVectors(encoders, models or dict.fromkeys(encoders, "hashing"))
        self.kept = kept
        self._results: OrderedDict[str, Found] = OrderedDict()
        self.reload()

    def reload(self) -> None:
        self._results.clear()
        load = self.store.load
        self.nodes, self.edges, self.rank = load("nodes").cache(), load("edges").cache(), load("pagerank").cache()
        self.vectors, self.postings, self.weights = load("embeddings"), load("postings"), load("weights")
        self.near = analytics.Adjacency.of(self.edges)  # None for large graphs, whose paths are found by joins
        self.kinds: list[str] = []
        if self.vectors is not None:
            self.vectors = self.vectors.cache()
            self.kinds = sorted(r[0] for r in self.vectors.select("model_type").distinct().collect())  # two, or one

    def _vector_hits(self, query: str, top: int, fast: bool = False) -> DataFrame:
        """The best of the code and the text vectors, merged; fast: one encoder call, the text model's vector for both."""
        found = None
        for kind in self.kinds:
            vector = self.query_vectors(query, "text" if fast or kind not in self.query_vectors.encoders else kind)
            hits = retrieval.vector_topk(self.vectors.filter(F.col("model_type") == kind), vector, top, id_="node_id", unit=True)
            found = hits if found is None else found.unionByName(hits)
        if found is None:
            return self.vectors.select(F.col("node_id").alias("id"), F.lit(0.0).alias("score")).limit(0)
        return found.orderBy(F.desc("score"), "id").limit(top)

    def keyword(self, query: str, top: int = 20) -> DataFrame:
        """By the stored postings; a scan of labels and docstrings where there are none, or a term holds a quotation mark."""
        terms = retrieval.query_terms(query)
        if self.postings is None or any('"' in t for t in terms):
            return retrieval.scan(self.nodes.join(self.rank, "id", "left"), terms, top, rank="pagerank")
        return retrieval.bm25_indexed(self.postings, terms, top, stem=True)

    def keyword_rows(self, query: str, top: int = 20) -> DataFrame:
        """The keyword hits with what a reader wants to see of them: id, label, kind, file_path, pagerank, score (3 digits)."""
        hits = self.keyword(query, top)
        rows = hits.join(self.nodes.select("id", "label", "kind", "file_path"), "id").join(self.rank, "id", "left")
        return rows.select("id", "label", "kind", "file_path", "pagerank", F.round("score", 3).alias("score")).orderBy(F.desc("score"), F.desc("pagerank"), "id")

    def vector(self, query: str, top: int = 10, fast: bool = False) -> DataFrame:
        hits = self._vector_hits(query, 4 * top, fast).join(self.nodes.select("id", "label"), "id")
        return retrieval.dedupe_by_label(hits, top)

    def search(self, query: str, top: int = 10, candidates: int = 40, weights: tuple[float, float] = (1.5, 1.5), hops: int = 5, fast: bool = False) -> Found:
        key = hashlib.md5(json.dumps([query, top, candidates, weights, hops, fast]).encode(), usedforsecurity=False).hexdigest()
        if key in self._results:
            self._results.move_to_end(key)
            return self._results[key]
        signals = {"keyword": self.keyword(query, candidates)}
        if self.vectors is not None:
            signals["vector"] = self._vector_hits(query, candidates, fast)
        fused = retrieval.rrf(signals, weights={"vector": weights[0], "keyword": weights[1]})
        real = self.nodes.filter(~F.col("kind").isin("external", "directory")).select("id")
        seeds = fused.join(real, "id", "left_semi").orderBy(F.desc("score"), "id").limit(top).collect()
        between, edges, alone = analytics.seed_subgraph(self.edges, [r["id"] for r in seeds], hops, self.near)
        found = Found([(r["id"], round(r["score"], 4)) for r in seeds], between, edges, alone, {r["id"]: r["contributions"] for r in seeds})
        self._results[key] = found
        while len(self._results) > self.kept:
            self._results.popitem(last=False)
        return found

    def result_edges(self, found: Found) -> DataFrame:
        """from, to, rel: edges among all nodes of a result, by label."""
        ids = self.spark.createDataFrame([(x,) for x in [*(s for s, _ in found.seeds), *found.between]], "id string")
        return analytics.result_edges(self.nodes, self.edges, ids)

    def expand(self, query: str, top: int = 10, hops: int = 2) -> DataFrame:
        """Nodes within ``hops`` of the five best vector hits, nearest first."""
        seeds = self._vector_hits(query, 5).select("id")
        near = analytics.bounded_paths(self.edges, seeds, hops).groupBy("id").agg(F.min("distance").alias("distance"))
        return near.join(self.rank, "id").orderBy("distance", F.desc("pagerank"), "id").limit(top).select("id", "distance")

    def communities(self, query: str = "", level: int | None = None, top: int = 5) -> DataFrame:
        found = self.store.load("communities")
        if query:
            return communities.search(found, query.lower().split(), top).join(found.select("community", "summary"), "community").orderBy(F.desc("score"), "level", "community")
        return (found if level is None else found.filter(F.col("level") == level)).orderBy("level", "community")

    def community_members(self, query: str, top: int = 10) -> DataFrame:
        hits = communities.search(self.store.load("communities"), retrieval.query_terms(query), 10)
        return communities.member_search(hits, self.store.load("community_members"), top)

    def stats(self) -> DataFrame:
        """metric, name, value of the graph, and of its communities, members and embeddings."""
        count = lambda name, df: df.agg(F.lit(name).alias("metric"), F.lit("").alias("name"), F.count("*").cast("double").alias("value"))
        out = analytics.stats(self.nodes, self.edges)
        for name, table in (("communities", "communities"), ("community_members", "community_members"), ("embeddings", "embeddings")):
            found = self.store.load(table)
            if found is not None:
                out = out.unionByName(count(name, found))
        return out

    def community_graph(self, community: str) -> tuple[DataFrame, DataFrame]:
        return communities.subgraph(self.nodes, self.edges, self.store.load("community_members"), community)

    def weighted_edges(self) -> DataFrame:
        """Edges with their stored weight, 1 where there is none."""
        if self.weights is None:
            return self.edges
        return self.edges.join(self.weights.select("source", "target", "semantic_similarity", "weight").dropDuplicates(["source", "target"]), ["source", "target"], "left").fillna(1.0, ["weight"])

    def node(self, text: str) -> tuple[DataFrame, DataFrame | None]:
        found = analytics.lookup(self.nodes, text)
        first = found.first()
        return found, analytics.neighbourhood(self.nodes, self.edges, first["id"]) if first else None

    def export(self, kind: str, most: int = 500) -> str:
        edges = self.weighted_edges()
        if kind == "graphml":
            return export.graphml(self.nodes, edges)
        if kind == "json":
            return export.node_link_json(self.nodes, edges)
        nodes, edges = export.top_subgraph(self.nodes, edges, self.rank, most)
        d3 = export.d3_json(nodes, edges, self.rank)
        return export.page(d3) if kind == "html" else d3

    def export_to(self, path: str, kind: str = "json") -> None:
        """Nodes and links as JSON lines, or GraphML in parts, below ``path``, written by the executors: for graphs of any size."""
        if kind not in ("json", "graphml"):
            raise ValueError(f"no export of {kind} to a folder")
        (export.graphml_to if kind == "graphml" else export.node_link)(self.nodes, self.weighted_edges(), path)

    def doctor(self) -> dict[str, bool]:
        """Whether each table is there, and whether edges and members name known nodes."""
        there = {n: self.store.load(n) is not None for n in ("nodes", "edges", "pagerank", "postings", "embeddings", "weights", "communities", "community_members", "manifest")}
        ids = self.nodes.select("id")
        loose = self.edges.join(ids.withColumnRenamed("id", "source"), "source", "left_anti").isEmpty() and self.edges.join(ids.withColumnRenamed("id", "target"), "target", "left_anti").isEmpty()
        return there | {"edges_have_nodes": loose, "ids_are_unique": self.nodes.groupBy("id").count().filter("count > 1").isEmpty()}

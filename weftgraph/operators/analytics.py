"""Graph analytics over nodes (id, ...) and edges (source, target, ...)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.operators.components import components
from weftgraph.staging import Staged


def undirected(edges: DataFrame) -> DataFrame:
    """Distinct pairs a < b."""
    return edges.select(F.least("source", "target").alias("a"), F.greatest("source", "target").alias("b")).filter("a <> b").distinct()


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """id, in_degree, out_degree, degree of every node; a self-loop counts at both ends."""
    ends = edges.select(F.col("source").alias("id"), F.lit(0).alias("i"), F.lit(1).alias("o")).unionByName(edges.select(F.col("target").alias("id"), F.lit(1).alias("i"), F.lit(0).alias("o")))
    sums = ends.groupBy("id").agg(F.sum("i").alias("in_degree"), F.sum("o").alias("out_degree"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("bigint").alias(c)
    return nodes.select("id").join(sums.hint("merge"), "id", "left").select("id", zero("in_degree"), zero("out_degree")).withColumn("degree", F.col("in_degree") + F.col("out_degree"))


def pagerank(nodes: DataFrame, edges: DataFrame, damping: float = 0.85, tolerance: float = 1e-6, most: int = 200, weight: str | None = None, personalization: DataFrame | None = None, exactly: int | None = None) -> DataFrame:
    """id, pagerank by power iteration.

    Dangling mass goes where the teleport goes: everywhere alike, or along
    ``personalization`` (id, bias). Iteration stops when the L1 change is below
    ``tolerance`` times the number of nodes, or after ``exactly`` rounds; if it
    doesn't converge in ``most`` rounds every node gets 1/N. Edges are partitioned
    by source once; each round is a join, a grouped sum, a staged table and one row of its sums. No table
    that grows with the graph is broadcast.
    """
    ids = nodes.select("id").distinct()
    n = ids.count()
    if not n:
        return ids.select("id", F.lit(0.0).alias("pagerank"))
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    out = edges.groupBy("source").agg(F.sum(w).alias("total"))
    steps = Staged(edges.join(out.hint("merge"), "source").filter("total > 0").select("source", "target", (w / F.col("total")).alias("share")).groupBy("source", "target").agg(F.sum("share").alias("share")), "pagerank-steps").df
    base = ids.join(steps.select(F.col("source").alias("id")).distinct().withColumn("leads", F.lit(True)).hint("merge"), "id", "left")
    if personalization is None:
        base = base.withColumn("teleport", F.lit(1.0 / n))
    else:
        total = personalization.agg(F.sum("bias")).first()[0]
        base = base.join(personalization.groupBy("id").agg((F.sum("bias") / total).alias("teleport")).hint("merge"), "id", "left").fillna(0.0, ["teleport"])
    rank = Staged(base.select("id", "teleport", F.coalesce("leads", F.lit(False)).alias("leads"), F.lit(1.0 / n).alias("pagerank")), "pagerank")
    dangling = rank.df.filter("not leads").agg(F.sum("pagerank")).first()[0] or 0.0
    rounds = most if exactly is None else exactly
    for _ in range(rounds):
        flow = rank.df.filter("leads").select(F.col("id").alias("source"), "pagerank").join(steps.hint("merge"), "source").select(F.col("target").alias("id"), (F.col("pagerank") * F.col("share")).alias("flow"))
        # a node's own row goes along with what flows to it: one shuffle for both
        own = rank.df.select("id", F.lit(0.0).alias("flow"), "teleport", "leads", F.col("pagerank").alias("before"))
        sums = own.unionByName(flow, allowMissingColumns=True).groupBy("id").agg(F.sum("flow").alias("flow"), F.max("teleport").alias("teleport"), F.max("leads").alias("leads"), F.max("before").alias("before")).filter("before is not null")
        new = F.lit(damping) * (F.col("flow") + F.lit(dangling) * F.col("teleport")) + F.lit(1 - damping) * F.col("teleport")
        moved = Staged(sums.select("id", "teleport", "leads", new.alias("pagerank"), "before"), "pagerank")
        dangling, change = moved.df.agg(F.coalesce(F.sum(F.when(~F.col("leads"), F.col("pagerank"))), F.lit(0.0)), F.sum(F.abs(F.col("pagerank") - F.col("before")))).first()
        rank.drop()
        rank = moved
        if exactly is None and change < tolerance * n:
            return rank.df.select("id", "pagerank")
    if exactly is None:
        return ids.select("id", F.lit(1.0 / n).alias("pagerank"))
    return rank.df.select("id", "pagerank")


def god_nodes(degree: DataFrame, rank: DataFrame, top: int = 10) -> DataFrame:
    """id, degree, pagerank (6 digits) of the nodes with the largest degree times PageRank, ties by id."""
    scored = degree.join(rank.hint("merge"), "id").withColumn("score", F.col("degree") * F.col("pagerank"))
    return scored.orderBy(F.desc("score"), "id").limit(top).select("id", "degree", F.round("pagerank", 6).alias("pagerank"))


def hubs(nodes: DataFrame, edges: DataFrame, percentile: float = 0.97, least: float = 10.0) -> DataFrame:
    """id, in_degree of nodes whose in-degree is above the percentile (linear) and above ``least``."""
    d = degrees(nodes, edges).select("id", "in_degree")
    cut = d.agg(F.greatest(F.percentile("in_degree", F.lit(percentile)), F.lit(least)).alias("cut"))
    return d.crossJoin(F.broadcast(cut)).filter("in_degree > cut").select("id", "in_degree")  # cut is one row


def component_labels(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """id, component (smallest id) of every node."""
    found = components(edges, "source", "target")
    return nodes.select("id").join(found.hint("merge"), F.col("id") == F.col("node"), "left").select("id", F.coalesce("component", "id").alias("component"))


def triangles(edges: DataFrame) -> DataFrame:
    """id, triangles: for each node of at least one triangle of the undirected graph.

    Pairs are directed from lower to higher degree, so a hub opens few wedges.
    """
    pairs = undirected(edges)
    size = pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).groupBy("id").agg(F.count("*").alias("d"))
    da, db = size.select(F.col("id").alias("a"), F.col("d").alias("da")), size.select(F.col("id").alias("b"), F.col("d").alias("db"))
    both = pairs.join(da, "a").join(db, "b")
    up = (F.col("da") < F.col("db")) | ((F.col("da") == F.col("db")) & (F.col("a") < F.col("b")))
    arcs = both.select(F.when(up, F.col("a")).otherwise(F.col("b")).alias("u"), F.when(up, F.col("b")).otherwise(F.col("a")).alias("v"))
    wedge = arcs.alias("x").join(arcs.alias("y"), "u").filter("x.v < y.v").select("u", F.col("x.v").alias("a"), F.col("y.v").alias("b"))
    closed = wedge.join(pairs, ["a", "b"])
    return closed.select(F.explode(F.array("u", "a", "b")).alias("id")).groupBy("id").agg(F.count("*").alias("triangles"))


def clustering(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """id, clustering: local coefficient on the undirected graph, 0 below two neighbours."""
    pairs = undirected(edges)
    size = pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).groupBy("id").agg(F.count("*").alias("d"))
    joined = nodes.select("id").join(size, "id", "left").join(triangles(edges), "id", "left")
    d = F.col("d")
    return joined.select("id", F.when(d >= 2, 2.0 * F.coalesce("triangles", F.lit(0)) / (d * (d - 1))).otherwise(0.0).alias("clustering"))


def quality(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: nodes, edges, density (6), isolated, shares of confidences (4), weak components."""
    n = nodes.agg(F.count("*").alias("nodes"))
    share = lambda c: F.round(F.avg((F.coalesce("confidence", F.lit("EXTRACTED")) == c).cast("double")), 4)
    m = edges.agg(F.count("*").alias("edges"), *[F.coalesce(share(c), F.lit(0.0)).alias(f"{c.lower()}_ratio") for c in ("EXTRACTED", "INFERRED", "AMBIGUOUS")])
    alone = degrees(nodes, edges).agg(F.count(F.when(F.col("degree") == 0, 1)).alias("isolated"))
    parts = component_labels(nodes, edges).agg(F.countDistinct("component").alias("components"))
    row = n.crossJoin(m).crossJoin(alone).crossJoin(parts)  # one row each
    density = F.round(F.col("edges") / F.greatest(F.col("nodes") * (F.col("nodes") - 1), F.lit(1)), 6)
    return row.select("nodes", "edges", density.alias("density"), "isolated", "extracted_ratio", "inferred_ratio", "ambiguous_ratio", "components")


def stats(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """metric, name, value: totals, histograms of kinds and confidences, density, components, mean clustering, isolates."""
    one = lambda df, metric, value: df.select(F.lit(metric).alias("metric"), F.lit("").alias("name"), F.round(F.col(value).cast("double"), 6).alias("value"))
    q = Staged(quality(nodes, edges), "graph-quality").df
    kinds = nodes.groupBy("kind").agg(F.count("*").alias("n")).select(F.lit("kind").alias("metric"), F.col("kind").alias("name"), F.col("n").cast("double").alias("value"))
    conf = edges.groupBy(F.coalesce("confidence", F.lit("EXTRACTED")).alias("name")).agg(F.count("*").alias("n")).select(F.lit("confidence").alias("metric"), "name", F.col("n").cast("double").alias("value"))
    mean = clustering(nodes, edges).agg(F.avg("clustering").alias("c"))
    out = kinds.unionByName(conf).unionByName(one(mean, "average_clustering", "c"))
    for metric in ("nodes", "edges", "density", "isolated", "components"):
        out = out.unionByName(one(q, metric, metric))
    return out


def _brandes(pivots: list[tuple[int, int]], start: np.ndarray, targets: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of classes of ``size`` nodes alike: what one of a class's nodes gets from the pivots (class, how many) of other classes, and from one of its own class."""
    n = len(size)
    score, own = np.zeros(n), np.zeros(n)
    for s, times in pivots:
        # the pivot is node n; the others of its class stay class s
        many = np.append(size, 1.0)
        many[s] -= 1
        sigma, dist = np.zeros(n + 1), np.full(n + 1, -1)
        sigma[n], dist[n] = 1.0, 0
        if size[s] == 1:
            dist[s] = 0
        levels = [np.array([n])]

        def arcs(front: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            at = np.where(front == n, s, front)  # noqa: B023
            count = start[at + 1] - start[at]
            head = targets[np.repeat(start[at] - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(count.sum())]
            return np.repeat(front, count), head

        while len(levels[-1]):
            tail, head = arcs(levels[-1])
            fresh = np.unique(head[dist[head] < 0])
            dist[fresh] = len(levels)
            on = dist[head] == len(levels)
            np.add.at(sigma, head[on], sigma[tail[on]] * many[tail[on]])
            levels.append(fresh)
        delta = np.zeros(n + 1)
        for front in levels[::-1]:
            if not len(front):
                continue
            tail, head = arcs(front)
            on = dist[head] == dist[tail] + 1
            np.add.at(delta, tail[on], sigma[tail[on]] / sigma[head[on]] * many[head[on]] * (1 + delta[head[on]]))
        own[s] = delta[s]
        delta[s] = 0
        score += times * delta[:n]
    return score, own


def _alike(ids: DataFrame, arcs: DataFrame) -> DataFrame:
    """id, like: the smallest node with the same arcs in and the same arcs out, by two 64-bit hashes of each set.

    ``arcs`` are distinct, without loops and between nodes of ``ids``, so nodes alike have no arc among them.
    """

    def side(end: str, other: str, k: str) -> DataFrame:
        hashes = [F.bit_xor(F.xxhash64(F.lit(seed), other)).alias(f"{k}{seed}") for seed in (1, 2)]
        return arcs.groupBy(F.col(end).alias("id")).agg(F.count("*").alias(f"{k}0"), *hashes)

    signs = [f"{k}{j}" for k in "oi" for j in range(3)]
    signed = ids.join(side("source", "target", "o").hint("merge"), "id", "left").join(side("target", "source", "i").hint("merge"), "id", "left").fillna(0, signs)
    signed = Staged(signed, "between-signs").df
    return signed.join(signed.groupBy(*signs).agg(F.min("id").alias("like")).hint("merge"), signs).select("id", "like")


def _pivots(nodes: DataFrame, pivots: int | None, seed: int) -> DataFrame:
    ids = nodes.select("id").distinct()
    return ids if pivots is None else ids.orderBy(F.xxhash64(F.lit(seed), "id"), "id").limit(pivots)


def betweenness(nodes: DataFrame, edges: DataFrame, pivots: int | None = 100, most_edges: int = 5_000_000, seed: int = 0) -> DataFrame:
    """id, betweenness (normalised, directed) from at most ``pivots`` source nodes, chosen by a hash; exact if there are no more nodes, or with None.

    Nodes with the same arcs in and out have the same paths but for their own ends,
    so each class of them is one node that counts as many times (:func:`_alike`), and one pass
    stands for all its pivots. If no more than ``most_edges`` arcs and classes are left, they
    are sent to the tasks in compressed form, and pivots are spread over tasks, each with
    its own breadth-first passes. Larger graphs
    are never gathered: :func:`joined_betweenness` takes all pivots along in joins.
    """
    spark = nodes.sparkSession
    ids = Staged(nodes.select("id").distinct(), "between-ids").df
    n = ids.count()
    if not n:
        return nodes.select("id", F.lit(0.0).alias("betweenness"))
    known = ids.withColumnRenamed("id", "source").hint("merge"), ids.withColumnRenamed("id", "target").hint("merge")
    arcs = edges.select("source", "target").filter("source <> target").distinct().join(known[0], "source", "left_semi").join(known[1], "target", "left_semi")
    arcs = Staged(arcs.select("source", "target"), "between-arcs").df
    like = Staged(_alike(ids, arcs), "between-like").df
    if pivots is None:
        like = like.withColumn("is_pivot", F.lit(1))
    else:
        like = like.join(_pivots(ids, pivots, seed).withColumn("is_pivot", F.lit(1)).hint("merge"), "id", "left").fillna(0, ["is_pivot"])
    classes = Staged(like.groupBy("like").agg(F.count("*").alias("size"), F.sum("is_pivot").alias("pivots")), "between-classes").df
    ends = classes.select(F.col("like").alias("source")).hint("merge"), classes.select(F.col("like").alias("target")).hint("merge")
    pairs = Staged(arcs.join(ends[0], "source", "left_semi").join(ends[1], "target", "left_semi").select("source", "target"), "between-pairs").df
    if pairs.count() > most_edges or classes.count() > most_edges:
        return joined_betweenness(nodes, edges, pivots, seed)
    rows = sorted(tuple(r) for r in classes.toLocalIterator())
    names = np.array([r[0] for r in rows], object)
    size, times = np.array([r[1] for r in rows], float), np.array([r[2] for r in rows], np.int64)
    place = {x: k for k, x in enumerate(names)}
    pairs = np.array([(place[a], place[b]) for a, b in pairs.toLocalIterator()], np.int64).reshape(-1, 2)
    pairs = pairs[np.argsort(pairs[:, 0], kind="stable")]
    start = np.concatenate([[0], np.cumsum(np.bincount(pairs[:, 0], minlength=len(names)))])
    chosen = np.flatnonzero((times > 0) & (start[1:] > start[:-1]))  # no path begins at the others
    k = int(times.sum())
    shared = spark.sparkContext.broadcast((start, pairs[:, 1], size, names))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        heads, targets, size, names = shared.value
        for batch in batches:
            score, own = _brandes(list(zip(batch["pivot"], batch["times"], strict=True)), heads, targets, size)
            at = np.flatnonzero((score > 0) | (own > 0))
            yield pd.DataFrame({"like": names[at], "part": score[at], "own": own[at]})

    work = spark.createDataFrame([(int(x), int(times[x])) for x in chosen], "pivot long, times long").repartition(max(1, min(len(chosen), spark.sparkContext.defaultParallelism)))
    sums = work.mapInPandas(run, f"like {dict(classes.dtypes)['like']}, part double, own double").groupBy("like").agg(F.sum("part").alias("part"), F.sum("own").alias("own"))
    sums = classes.join(sums.hint("merge"), "like", "left").select("like", "pivots", F.coalesce("part", F.lit(0.0)).alias("part"), F.coalesce("own", F.lit(0.0)).alias("own"))
    scale = (n / k) / ((n - 1) * (n - 2)) if n > 2 and k else 1.0
    got = F.col("part") + F.col("own") * (F.col("pivots") - F.col("is_pivot"))  # no pivot is between itself and others
    return like.join(sums.hint("merge"), "like").select("id", (got * scale).alias("betweenness"))


def joined_betweenness(nodes: DataFrame, edges: DataFrame, pivots: int | None = 100, seed: int = 0) -> DataFrame:
    """:func:`betweenness` by joins: one staged table of (pivot, id, paths) for each distance, there and back.

    The rows are at most pivots times nodes; nothing is gathered on the driver.
    """
    ids = Staged(nodes.select("id").distinct(), "between-ids").df
    n = ids.count()
    known = ids.withColumnRenamed("id", "source"), ids.withColumnRenamed("id", "target")
    arcs = edges.select("source", "target").filter("source <> target").distinct().join(known[0], "source", "left_semi").join(known[1], "target", "left_semi")
    arcs = Staged(arcs.select("source", "target"), "between-arcs").df
    chosen = Staged(_pivots(ids, pivots, seed).select(F.col("id").alias("pivot")), "between-pivots").df
    k = chosen.count()
    levels = [Staged(chosen.select("pivot", F.col("pivot").alias("id"), F.lit(1.0).alias("paths")), "between-level").df]
    reached = levels[0].select("pivot", "id")
    while True:
        step = levels[-1].join(arcs, F.col("id") == F.col("source")).groupBy("pivot", F.col("target").alias("id")).agg(F.sum("paths").alias("paths"))
        front = Staged(step.join(reached, ["pivot", "id"], "left_anti"), "between-level").df
        if front.isEmpty():
            break
        levels.append(front)
        reached = reached.unionByName(front.select("pivot", "id"))
    total = None
    below: DataFrame | None = None  # pivot, id, paths, part of the level below
    for front in levels[:0:-1]:
        if below is None:
            here = front.withColumn("part", F.lit(0.0))
        else:
            lower = below.select("pivot", F.col("id").alias("target"), ((1 + F.col("part")) / F.col("paths")).alias("give"))
            gain = lower.join(arcs, "target").groupBy("pivot", F.col("source").alias("id")).agg(F.sum("give").alias("give"))
            here = front.join(gain, ["pivot", "id"], "left").select("pivot", "id", "paths", (F.col("paths") * F.coalesce("give", F.lit(0.0))).alias("part"))
        below = Staged(here, "between-parts").df
        total = below if total is None else total.unionByName(below)
    scale = (n / k) / ((n - 1) * (n - 2)) if n > 2 and k else 1.0
    if total is None:
        return ids.select("id", F.lit(0.0).alias("betweenness"))
    sums = total.groupBy("id").agg(F.sum("part").alias("part"))
    return ids.join(sums, "id", "left").select("id", (F.coalesce("part", F.lit(0.0)) * scale).alias("betweenness"))


def bounded_paths(edges: DataFrame, seeds: DataFrame, hops: int = 5) -> DataFrame:
    """seed, id, distance, path (array of ids): shortest undirected paths of at most ``hops`` from each seed, ties to the smallest path.

    A frontier join for each hop; what a seed has reached isn't entered again.
    """
    pairs = undirected(edges)
    arcs = pairs.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(pairs.select(F.col("b").alias("u"), F.col("a").alias("v")))
    front = Staged(seeds.select(F.col("id").alias("seed"), "id", F.lit(0).alias("distance"), F.array("id").alias("path")).distinct(), "paths")
    reached = front.df
    for hop in range(1, hops + 1):
        step = front.df.join(arcs, F.col("id") == F.col("u")).groupBy("seed", F.col("v").alias("id")).agg(F.min(F.concat("path", F.array("v"))).alias("path"))
        step = step.join(reached.select("seed", "id"), ["seed", "id"], "left_anti").select("seed", "id", F.lit(hop).alias("distance"), "path")
        front = Staged(step, "paths")
        if front.df.isEmpty():
            break
        reached = reached.unionByName(front.df)
    return reached


class Adjacency:
    """A graph of a stated size on the driver, for answers in milliseconds: what :func:`seed_subgraph` needs of it."""

    def __init__(self, edges: DataFrame):
        rows = sorted({(r["source"], r["target"], r["relation"]) for r in edges.select("source", "target", "relation").toLocalIterator()}, key=str)
        self.around: dict[str, set[str]] = {}
        self.between: dict[tuple[str, str], list[tuple[str, str, str]]] = {}
        for source, target, relation in rows:
            pair = min(source, target), max(source, target)
            self.between.setdefault(pair, []).append((source, target, relation))
            if source != target:
                self.around.setdefault(source, set()).add(target)
                self.around.setdefault(target, set()).add(source)

    @classmethod
    def of(cls, edges: DataFrame, most: int = 500_000) -> Adjacency | None:
        """None for graphs of more than ``most`` edges."""
        return cls(edges) if edges.limit(most + 1).count() <= most else None

    def paths(self, seeds: list[str], hops: int) -> list[tuple[str, str, int, list[str]]]:
        """(seed, other seed, distance, path): shortest paths as :func:`bounded_paths` finds them."""
        wanted, out = set(seeds), []
        for seed in seeds:
            front, reached = {seed: [seed]}, {seed}
            for hop in range(1, hops + 1):
                step: dict[str, list[str]] = {}
                for u, path in front.items():
                    for v in self.around.get(u, ()):
                        if v not in reached and (v not in step or path < step[v][:-1]):
                            step[v] = [*path, v]
                reached |= step.keys()
                out += [(seed, v, hop, path) for v, path in step.items() if v in wanted]
                front = step
                if not front or wanted <= reached:
                    break
        return out

    def edges(self, used: list[tuple[str, str]]) -> list[tuple[str, str, str, str]]:
        return [(a, s, t, r) for a, b in used for s, t, r in self.between.get((a, b), [])]


def seed_subgraph(edges: DataFrame, seeds: list[str], hops: int = 5, near: Adjacency | None = None) -> tuple[list[str], list[tuple[str, str, str]], list[str]]:
    """(intermediate ids, edges (source, relation, target), isolated seeds): Kruskal's tree over the seeds' bounded paths.

    There are at most as many pairs as ``seeds`` allows, so the tree is built on
    the driver. With fewer than two seeds nothing is isolated; without any path
    all are. Directions and relations are those of the graph, a before b first.
    With ``near``, the same graph held on the driver, no job runs.
    """
    seeds = list(dict.fromkeys(seeds))
    if len(seeds) < 2:
        return [], [], []
    spark = edges.sparkSession
    index = {s: k for k, s in enumerate(seeds)}
    if near is not None:
        paths = near.paths(seeds, hops)
    else:
        wanted = spark.createDataFrame([(s,) for s in seeds], "id string")
        paths = [(r["seed"], r["id"], r["distance"], r["path"]) for r in bounded_paths(edges, wanted, hops).join(F.broadcast(wanted), "id", "left_semi").collect()]
    pairs = sorted((d, index[s], index[t], path) for s, t, d, path in paths if index[s] < index[t])
    if not pairs:
        return [], [], seeds
    root = list(range(len(seeds)))

    def find(k: int) -> int:
        while root[k] != k:
            root[k] = root[root[k]]
            k = root[k]
        return k

    used, between, joined = set(), [], set()
    for _, i, j, path in pairs:
        if find(i) == find(j):
            continue
        root[find(i)] = find(j)
        joined |= {i, j}
        between += [x for x in path[1:-1] if x not in index]
        used |= {tuple(sorted(p)) for p in zip(path, path[1:], strict=False)}
    if used:
        if near is not None:
            rows = near.edges(sorted(used))
        else:
            some = spark.createDataFrame(sorted(used), "a string, b string")
            on = (F.least("source", "target") == F.col("a")) & (F.greatest("source", "target") == F.col("b"))
            rows = [tuple(r) for r in edges.join(F.broadcast(some), on).select("a", "source", "target", "relation").collect()]
        best: dict[tuple[str, str], tuple] = {}
        for _, source, target, relation in sorted(rows, key=lambda r: (r[1] != r[0], r[1], r[2], r[3])):
            best.setdefault(tuple(sorted((source, target))), (source, relation, target))
        kept = [best[u] for u in sorted(used)]
    else:
        kept = []
    return list(dict.fromkeys(between)), kept, [s for k, s in enumerate(seeds) if k not in joined]


def edge_weights(nodes: DataFrame, edges: DataFrame, vectors: DataFrame | None = None) -> DataFrame:
    """source, target, relation, semantic_similarity, weight: 0.4 cosine, 0.3 confidence, 0.2 proximity, 0.1 reverse edge, 4 digits."""
    path = nodes.select("id", "file_path")
    e = edges.join(path.select(F.col("id").alias("source"), F.col("file_path").alias("p")), "source", "left").join(path.select(F.col("id").alias("target"), F.col("file_path").alias("q")), "target", "left")
    back = edges.select(F.col("target").alias("source"), F.col("source").alias("target"), F.lit(1.0).alias("both")).distinct()
    e = e.join(back, ["source", "target"], "left")
    if vectors is None:
        e = e.withColumn("semantic", F.lit(0.0))
    else:
        v = vectors.select("id", F.col("vector").alias("x"), F.sqrt(F.aggregate("vector", F.lit(0.0), lambda s, y: s + y * y)).alias("norm"))
        e = e.join(v.select(F.col("id").alias("source"), F.col("x").alias("vs"), F.col("norm").alias("ns")), "source", "left").join(v.select(F.col("id").alias("target"), F.col("x").alias("vt"), F.col("norm").alias("nt")), "target", "left")
        dot = F.aggregate(F.zip_with("vs", "vt", lambda x, y: x * y), F.lit(0.0), lambda s, y: s + y)
        e = e.withColumn("semantic", F.coalesce(F.greatest(dot / F.nullif(F.col("ns") * F.col("nt"), F.lit(0.0)), F.lit(0.0)), F.lit(0.0)))
    conf = F.when(F.coalesce("confidence", F.lit("EXTRACTED")) == "EXTRACTED", 1.0).when(F.col("confidence") == "AMBIGUOUS", 0.3).otherwise(0.5)
    parent = lambda c: F.regexp_extract(c, r"^(.*)/[^/]*$", 1)
    there = (F.coalesce("p", F.lit("")) != "") & (F.coalesce("q", F.lit("")) != "")
    near = F.when(there & (F.col("p") == F.col("q")), 1.0).when(there & (parent("p") == parent("q")), 0.7).otherwise(0.4)
    weight = 0.4 * F.col("semantic") + 0.3 * conf + 0.2 * near + 0.1 * F.coalesce("both", F.lit(0.0))
    return e.select("source", "target", "relation", F.round("semantic", 4).alias("semantic_similarity"), F.round(weight, 4).alias("weight"))


def surprising(nodes: DataFrame, edges: DataFrame, top: int = 10) -> DataFrame:
    """The first 2 * top edges, by source and target, between different files whose confidence isn't EXTRACTED."""
    path = nodes.select("id", "file_path").filter("file_path <> ''")
    e = edges.filter(F.col("confidence").isin("INFERRED", "AMBIGUOUS"))
    e = e.join(path.select(F.col("id").alias("source"), F.col("file_path").alias("source_file")), "source").join(path.select(F.col("id").alias("target"), F.col("file_path").alias("target_file")), "target")
    return e.filter("source_file <> target_file").orderBy("source", "target", "relation").limit(2 * top).select("source", "target", "relation", "confidence", "source_file", "target_file")


def result_edges(nodes: DataFrame, edges: DataFrame, ids: DataFrame) -> DataFrame:
    """from, to, rel: edges among the nodes of ``ids`` (id), by label (the id where there is none), each pair once."""
    found = ids.select("id").distinct()
    kept = edges.join(found.withColumnRenamed("id", "source"), "source", "left_semi").join(found.withColumnRenamed("id", "target"), "target", "left_semi")
    once = kept.groupBy("source", "target").agg(F.min(F.coalesce("relation", F.lit(""))).alias("rel"))
    name = nodes.select("id", F.coalesce("label", "id").alias("label"))
    return once.join(name.select(F.col("id").alias("source"), F.col("label").alias("from")), "source").join(name.select(F.col("id").alias("target"), F.col("label").alias("to")), "target").select("from", "to", "rel")


def neighbourhood(nodes: DataFrame, edges: DataFrame, node: str) -> DataFrame:
    """direction, id, label, relation, confidence of a node's edges."""
    out = edges.filter(F.col("source") == node).select(F.lit("out").alias("direction"), F.col("target").alias("id"), "relation", "confidence")
    in_ = edges.filter(F.col("target") == node).select(F.lit("in").alias("direction"), F.col("source").alias("id"), "relation", "confidence")
    return out.unionByName(in_).join(nodes.select("id", "label"), "id").select("direction", "id", "label", "relation", "confidence")


def lookup(nodes: DataFrame, text: str, most: int | None = 5, labels: bool = True) -> DataFrame:
    """Nodes with that id; without any, those whose id (or label) contains the text, case ignored, smallest ids first."""
    low = text.lower()
    exact = F.col("id") == text
    part = F.contains(F.lower("id"), F.lit(low))
    if labels:
        part = part | F.contains(F.lower("label"), F.lit(low))
    found = nodes.filter(exact | part).withColumn("__w_exact", exact)
    any_exact = found.agg(F.coalesce(F.max("__w_exact"), F.lit(False)).alias("__w_any"))
    kept = found.crossJoin(F.broadcast(any_exact)).filter("__w_exact or not __w_any").drop("__w_exact", "__w_any").orderBy("id")  # one row
    return kept if most is None else kept.limit(most)

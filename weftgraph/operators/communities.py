"""Communities at several resolutions, their hierarchy, summaries and search."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weftgraph.operators.analytics import hubs, undirected
from weftgraph.operators.components import components
from weftgraph.staging import Staged

RESOLUTIONS = (0.25, 0.5, 1.0, 2.0)
# Pairs of a component that one task holds (about 100 bytes each); larger ones are made smaller in joins first.
MOST_PAIRS = 5_000_000
SETTLED = 0.001
SHRINKS = 0.9


def _one_level(start, ends, weight, strength, gamma: float, part, allowed=None) -> np.ndarray:
    """Local moves in a fixed order until none gains; allowed: only among nodes of one class."""
    total = strength.sum()
    size = np.bincount(part, weights=strength, minlength=len(strength))
    queue, waits = list(range(len(strength))), np.ones(len(strength), bool)
    while queue:
        later = []
        for v in queue:
            waits[v] = False
            at = slice(start[v], start[v + 1])
            other, w = ends[at], weight[at]
            if allowed is not None:
                same = allowed[other] == allowed[v]
                other, w = other[same], w[same]
            if not len(other):
                continue
            names, inverse = np.unique(np.append(part[other], part[v]), return_inverse=True)
            links = np.bincount(inverse, weights=np.append(w, 0.0))
            size[part[v]] -= strength[v]
            gain = links - gamma * strength[v] * size[names] / total
            best = int(np.argmax(gain))
            here = int(np.searchsorted(names, part[v]))
            if gain[best] > gain[here] + 1e-12:
                part[v] = names[best]
                for u in other[part[other] != names[best]]:
                    if not waits[u]:
                        waits[u] = True
                        later.append(int(u))
            size[part[v]] += strength[v]
        queue = later
    return part


def _csr(n: int, a, b, w):
    order = np.argsort(a, kind="stable")
    return np.concatenate([[0], np.cumsum(np.bincount(a, minlength=n))]), b[order], w[order]


def _weighted(n: int, a, b, weights, strengths):
    """Arcs in both directions with their weights, and the strengths of the nodes (with loops, where they are given)."""
    source, target = np.concatenate([a, b]), np.concatenate([b, a])
    weight = np.ones(len(source)) if weights is None else np.concatenate([weights, weights])
    strength = np.bincount(source, weights=weight, minlength=n).astype(float) if strengths is None else np.asarray(strengths, float)
    return source, target, weight, strength


def leiden(n: int, a: np.ndarray, b: np.ndarray, gamma: float, weights: np.ndarray | None = None, strengths: np.ndarray | None = None) -> np.ndarray:
    """Communities of an undirected graph of n nodes and edges a-b: local moves, refinement inside communities, aggregation.

    Deterministic: nodes are visited in order and ties go to the smallest community.
    """
    final = np.arange(n)
    source, target, weight, strength = _weighted(n, a, b, weights, strengths)
    part = np.arange(n)
    while True:
        count = len(strength)
        start, ends, w = _csr(count, source, target, weight)
        part = _one_level(start, ends, w, strength, gamma, part)
        _, part = np.unique(part, return_inverse=True)
        if part.max(initial=-1) + 1 == count:
            return part[final]
        fine = _one_level(start, ends, w, strength, gamma, np.arange(count), allowed=part)
        _, fine = np.unique(fine, return_inverse=True)
        if fine.max() + 1 == count:
            fine = part
        groups = int(fine.max()) + 1
        coarse = np.zeros(groups, np.int64)
        coarse[fine] = part
        final = fine[final]
        keys, inverse = np.unique(fine[source] * groups + fine[target], return_inverse=True)
        weight = np.bincount(inverse, weights=weight)
        source, target = keys // groups, keys % groups
        strength = np.bincount(fine, weights=strength, minlength=groups)
        loops = source == target
        source, target, weight = source[~loops], target[~loops], weight[~loops]
        if groups == count or not len(source):
            return coarse[final]
        part = coarse


def louvain(n: int, a: np.ndarray, b: np.ndarray, gamma: float, weights: np.ndarray | None = None, strengths: np.ndarray | None = None) -> np.ndarray:
    """Communities by local moves and aggregation only, without refinement; deterministic as :func:`leiden`."""
    final = np.arange(n)
    source, target, weight, strength = _weighted(n, a, b, weights, strengths)
    while True:
        count = len(strength)
        start, ends, w = _csr(count, source, target, weight)
        _, part = np.unique(_one_level(start, ends, w, strength, gamma, np.arange(count)), return_inverse=True)
        final = part[final]
        groups = int(part.max(initial=-1)) + 1
        if groups == count:
            return final
        keys, inverse = np.unique(part[source] * groups + part[target], return_inverse=True)
        weight = np.bincount(inverse, weights=weight)
        source, target = keys // groups, keys % groups
        strength = np.bincount(part, weights=strength, minlength=groups)
        apart = source != target
        source, target, weight = source[apart], target[apart], weight[apart]
        if not len(source):
            return final


def _moves(pairs: DataFrame, strengths: DataFrame, gamma: float, total: float) -> DataFrame:
    """id, community after local moves of very large graphs: pairs a, b, w and strengths id, k.

    In each round the nodes of one half, by a hash, go to the neighbouring community of the
    largest gain (ties to the smallest); the halves take turns, so two nodes never
    change places. It ends when fewer than SETTLED of the nodes move in two rounds.
    """
    arcs = Staged(pairs.select(F.col("a").alias("u"), F.col("b").alias("v"), "w").unionByName(pairs.select(F.col("b").alias("u"), F.col("a").alias("v"), "w")), "moves-arcs").df
    state = Staged(strengths.select("id", "k", F.col("id").alias("community")), "moves").df
    n, turn, last = state.count(), 0, None
    while True:
        mine = state.filter(F.pmod(F.xxhash64("id"), F.lit(2)) == turn % 2)
        links = arcs.join(state.select(F.col("id").alias("v"), "community"), "v").select("u", "community", "w")
        links = links.unionByName(mine.select(F.col("id").alias("u"), "community", F.lit(0.0).alias("w"))).groupBy("u", "community").agg(F.sum("w").alias("w"))
        sizes = state.groupBy("community").agg(F.sum("k").alias("size"))
        offers = links.join(mine.select(F.col("id").alias("u"), "k", F.col("community").alias("here")), "u").join(sizes, "community")
        others = F.col("size") - F.when(F.col("community") == F.col("here"), F.col("k")).otherwise(0.0)
        offers = offers.withColumn("gain", F.round(F.col("w") - gamma * F.col("k") * others / (2 * total), 9))
        best = offers.groupBy("u").agg(F.min_by("community", F.struct(-F.col("gain"), F.col("community"))).alias("to"), F.max("gain").alias("most"), F.max(F.when(F.col("community") == F.col("here"), F.col("gain"))).alias("stay"))
        going = best.filter("most > stay").select(F.col("u").alias("id"), "to")
        after = state.join(going, "id", "left").select("id", "k", F.coalesce("to", "community").alias("community"), F.col("to").isNotNull().alias("moved"))
        after = Staged(after, "moves").df
        moved, state, turn = after.filter("moved").count(), after.drop("moved"), turn + 1
        if last is not None and moved + last <= SETTLED * n:
            return state.select("id", "community")
        last = moved


def _coarse(pairs: DataFrame, gamma: float, total: float) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(id, community; pairs a, b, w of communities; strengths id, k of them) of components too large for a task, moved and summed until they are small or don't shrink."""
    ends = pairs.select(F.col("a").alias("id"), "w").unionByName(pairs.select(F.col("b").alias("id"), "w"))
    strengths = Staged(ends.groupBy("id").agg(F.sum("w").alias("k")), "coarse-strengths").df
    of = strengths.select("id", F.col("id").alias("community"))
    while True:
        found = Staged(_moves(pairs, strengths, gamma, total), "coarse-communities").df
        side = lambda c: found.select(F.col("id").alias(c), F.col("community").alias(f"c{c}"))
        named = pairs.join(side("a"), "a").join(side("b"), "b").filter("ca <> cb")
        less = Staged(named.groupBy(F.least("ca", "cb").alias("a"), F.greatest("ca", "cb").alias("b")).agg(F.sum("w").alias("w")), "coarse-pairs").df
        of = Staged(of.withColumnRenamed("community", "before").join(found.withColumnRenamed("id", "before"), "before").select("id", "community"), "coarse-members").df
        strengths = Staged(strengths.join(found, "id").groupBy(F.col("community").alias("id")).agg(F.sum("k").alias("k")), "coarse-strengths").df
        before, now = pairs.count(), less.count()
        pairs = less
        if now <= MOST_PAIRS or now > SHRINKS * before:
            return of, pairs, strengths


def levels(nodes: DataFrame, edges: DataFrame, resolutions: tuple[float, ...] = RESOLUTIONS, least: int = 2, filter_hubs: bool = True, kernel=leiden) -> DataFrame:
    """level, resolution, community (smallest member id), id; communities below ``least`` members are left out.

    Hubs are taken out first. Components are independent, so each of up to MOST_PAIRS pairs is one task's
    work; communities of a component never depend on another one, given its
    edges, because the resolution is scaled by the graph's total weight. Larger
    components are first made smaller by local moves in joins, then finished by the same kernel on the communities found.
    """
    if filter_hubs:
        hub = hubs(nodes, edges).select("id")
        nodes = nodes.join(hub, "id", "left_anti")
        edges = edges.join(hub.withColumnRenamed("id", "source"), "source", "left_anti").join(hub.withColumnRenamed("id", "target"), "target", "left_anti")
    pairs = undirected(edges)
    total = pairs.count()
    label = components(pairs, "a", "b")
    part = Staged(pairs.join(label.withColumnRenamed("node", "b"), "b").select("component", "a", "b"), "level-pairs").df
    size = part.groupBy("component").agg(F.count("*").alias("n"))
    large = [r["component"] for r in size.filter(F.col("n") > MOST_PAIRS).select("component").collect()]  # no more than pairs / MOST_PAIRS

    def found_in(pdf: pd.DataFrame, gamma: float, strengths: dict | None) -> tuple[np.ndarray, np.ndarray]:
        ids, place = np.unique(np.concatenate([pdf["a"], pdf["b"]]).astype(str), return_inverse=True)
        a, b = place[: len(pdf)], place[len(pdf) :]
        if strengths is None:
            return ids, kernel(len(ids), a, b, gamma * len(pdf) / total)
        k = np.array([strengths[x] for x in ids])
        return ids, kernel(len(ids), a, b, gamma * k.sum() / 2 / total, pdf["w"].to_numpy(), k)

    def named(ids: np.ndarray, found: np.ndarray) -> np.ndarray:
        _, first, inverse = np.unique(found, return_index=True, return_inverse=True)
        return ids[first][inverse]  # ids are sorted: the first member is the smallest

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for k, gamma in enumerate(resolutions):
            ids, found = found_in(pdf, gamma, None)
            out.append(pd.DataFrame({"level": k, "resolution": gamma, "community": named(ids, found), "id": ids}))
        return pd.concat(out)

    def finish(gamma: float):
        def run(pdf: pd.DataFrame) -> pd.DataFrame:
            strength = dict(zip(pdf["a"], pdf["ka"], strict=True)) | dict(zip(pdf["b"], pdf["kb"], strict=True))
            ids, found = found_in(pdf, gamma, strength)
            return pd.DataFrame({"part": ids, "joined": named(ids, found)})

        return run

    shape = "level int, resolution double, community string, id string"
    rows = part.filter(~F.col("component").isin(large)).groupBy("component").applyInPandas(run, shape)
    for k, gamma in enumerate(resolutions) if large else []:
        of, few, strengths = _coarse(part.filter(F.col("component").isin(large)).select("a", "b", F.lit(1.0).alias("w")), gamma, total)
        ends = few.join(strengths.select(F.col("id").alias("a"), F.col("k").alias("ka")), "a").join(strengths.select(F.col("id").alias("b"), F.col("k").alias("kb")), "b")
        group = components(few, "a", "b")
        ends = Staged(ends.join(group.withColumnRenamed("node", "b"), "b"), "coarse-ends").df
        alike = ends.groupBy("component").agg(F.count("*").alias("n")).filter(F.col("n") <= MOST_PAIRS).select("component")

        joined = ends.join(alike, "component", "left_semi").groupBy("component").applyInPandas(finish(gamma), "part string, joined string")
        whole = of.join(joined, of["community"] == joined["part"], "left").select("id", F.coalesce("joined", "community").alias("g"))
        whole = Staged(whole, "coarse-levels").df
        name = whole.groupBy("g").agg(F.min("id").alias("community"))
        rows = rows.unionByName(whole.join(name, "g").select(F.lit(k).alias("level"), F.lit(float(gamma)).alias("resolution"), "community", "id"))
    rows = Staged(rows, "levels").df
    sizes = rows.groupBy("level", "community").agg(F.count("*").alias("n")).filter(F.col("n") >= least)
    return rows.join(sizes.select("level", "community"), ["level", "community"], "left_semi")


def single_level(nodes: DataFrame, edges: DataFrame, least: int = 2) -> DataFrame:
    """One level at resolution 1 by :func:`louvain`, hubs included."""
    return levels(nodes, edges, (1.0,), least, filter_hubs=False, kernel=louvain)


def of_nodes(members: DataFrame) -> DataFrame:
    """id, communities: a node's communities, the coarsest level first."""
    listed = F.transform(F.array_sort(F.collect_set(F.struct("level", "community"))), lambda x: x["community"])
    return members.groupBy("id").agg(listed.alias("communities"))


def subgraph(nodes: DataFrame, edges: DataFrame, members: DataFrame, community: str) -> tuple[DataFrame, DataFrame]:
    """The members of a community and the edges among them."""
    ids = members.filter(F.col("community") == community).select("id").distinct()
    kept = edges.join(ids.withColumnRenamed("id", "source"), "source", "left_semi").join(ids.withColumnRenamed("id", "target"), "target", "left_semi")
    return nodes.join(ids, "id", "left_semi"), kept.select(*edges.columns)


def parents(members: DataFrame) -> DataFrame:
    """level, community, parent: the community of the level above with most shared members, ties to the smallest."""
    up = members.select((F.col("level") + 1).alias("level"), "id", F.col("community").alias("parent"))
    shared = members.join(up, ["level", "id"]).groupBy("level", "community", "parent").agg(F.count("*").alias("n"))
    best = shared.groupBy("level", "community").agg(F.min_by("parent", F.struct(-F.col("n"), F.col("parent"))).alias("parent"))
    return members.select("level", "community").distinct().join(best, ["level", "community"], "left")


def _ranked(nodes: DataFrame, edges: DataFrame, members: DataFrame) -> DataFrame:
    """Members with their degree inside the community and their rank in it, ties by id."""
    side = lambda c: members.select(F.col("community").alias(f"c_{c}"), F.col("id").alias(c))
    inner = edges.join(side("source"), "source").join(side("target"), "target").filter("c_source = c_target")
    ends = inner.select(F.col("c_source").alias("community"), F.col("source").alias("id")).unionByName(inner.select(F.col("c_source").alias("community"), F.col("target").alias("id")))
    deg = ends.groupBy("community", "id").agg(F.count("*").alias("degree"))
    rows = members.join(deg, ["community", "id"], "left").withColumn("degree", F.coalesce("degree", F.lit(0))).join(nodes, "id")
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("community").orderBy(F.desc("degree"), "id")))


def labels(nodes: DataFrame, edges: DataFrame, members: DataFrame, top: int = 5) -> DataFrame:
    """community, label: the most central members' labels."""
    best = _ranked(nodes, edges, members).filter(F.col("rank") <= top)
    return best.groupBy("community").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "label"))), lambda x: x["label"]), ", ").alias("label"))


def summaries(nodes: DataFrame, edges: DataFrame, members: DataFrame, keywords: int = 10, existing: DataFrame | None = None) -> DataFrame:
    """community, summary of kinds, key elements, files and docstrings of the 20 most central members; an existing summary stays."""
    if "docstring" not in nodes.columns:
        nodes = nodes.withColumn("docstring", F.lit(""))
    best = _ranked(nodes, edges, members).filter("rank <= 20")
    kinds = best.filter("kind <> ''").groupBy("community", "kind").agg(F.count("*").alias("n"), F.min("rank").alias("first"))
    named = F.concat(F.col("n").cast("string"), F.lit(" "), "kind", F.when(F.col("n") > 1, "s").otherwise(""))
    kinds = kinds.groupBy("community").agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("o"), "first", named.alias("v")))).alias("kinds"))
    listed = lambda value: F.array_sort(F.collect_list(F.when(F.coalesce(value, F.lit("")) != "", F.struct("rank", value.alias("v")))))
    files = F.array_sort(F.collect_set(F.when(F.coalesce("file_path", F.lit("")) != "", F.regexp_extract("file_path", "([^/]*)$", 1))))
    rest = best.groupBy("community").agg(listed(F.col("label")).alias("labels"), files.alias("files"), listed(F.substring("docstring", 1, 100)).alias("docs"))
    joined = rest.join(kinds, "community", "left")
    some = lambda array, n, sep: F.array_join(F.slice(array, 1, n), sep)
    part = lambda size, text: F.when(F.coalesce(F.size(size), F.lit(0)) > 0, text)
    summary = F.concat_ws(
        " ",
        part("kinds", F.concat(F.lit("Contains "), some(F.col("kinds.v"), 5, ", "), F.lit("."))),
        part("labels", F.concat(F.lit("Key elements: "), some(F.col("labels.v"), keywords, ", "), F.lit("."))),
        part("files", F.concat(F.lit("Files: "), some("files", 5, ", "), F.lit("."))),
        part("docs", F.concat(F.lit("Context: "), some(F.col("docs.v"), 3, " | "))),
    )
    out = joined.select("community", summary.alias("summary"))
    if existing is None:
        return out
    old = existing.filter("summary <> ''").select("community", F.col("summary").alias("__w_old"))
    return out.join(old, "community", "left").select("community", F.coalesce("__w_old", "summary").alias("summary"))


def search(found: DataFrame, terms: list[str], top: int = 5) -> DataFrame:
    """community, level, score: how many terms are part of the summary, above 0; ties by level, then community."""
    if not terms:
        return found.select("community", "level", F.lit(0).cast("bigint").alias("score")).limit(0)
    score = sum((F.contains(F.lower("summary"), F.lit(t)).cast("int") for t in terms), F.lit(0)).cast("bigint")
    return found.select("community", "level", score.alias("score")).filter("score > 0").orderBy(F.desc("score"), "level", "community").limit(top)


def member_search(hits: DataFrame, members: DataFrame, top: int = 10) -> DataFrame:
    """Members of the communities found, best community first, each id once."""
    rows = hits.join(members.select("community", "level", "id"), ["community", "level"])
    first = rows.groupBy("id").agg(F.min(F.struct((-F.col("score")).alias("s"), "level", "community")).alias("o"))
    return first.orderBy("o", "id").limit(top).select("id")

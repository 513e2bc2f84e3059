"""Connected components of an undirected graph by alternating star operations."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.staging import Staged


# Edges that one task joins at once.
SMALL = 500_000


def _joined(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Union-find over all rows u, v: each node with the smallest of its component."""
    parts = list(batches)
    if not parts:
        return
    rows = pd.concat(parts)
    names, place = np.unique(np.concatenate([rows["u"], rows["v"]]), return_inverse=True)
    a, b, root = place[: len(rows)], place[len(rows) :], np.arange(len(names))
    while True:  # names are in order, so the smallest place is the smallest name
        low = np.minimum(root[a], root[b])
        np.minimum.at(root, root[a], low)
        np.minimum.at(root, root[b], low)
        while (root != (up := root[root])).any():
            root = up
        if (root[a] == root[b]).all():
            break
    moved = np.flatnonzero(root != np.arange(len(names)))
    yield pd.DataFrame({"node": names[moved], "component": names[root[moved]]})


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Rows node, component (smallest node reachable) for every node of ``edges`` other than its component's smallest.

    Each round hangs every node's larger neighbours on its smallest one, then
    every node on its smallest smaller neighbour, until nothing moves. Both steps
    are a grouped minimum and an equi-join, so a node with very many neighbours is
    summed up before the shuffle and its join can be split; neither side is broadcast,
    as a staged table of few different values is a small file of many rows. Graphs of up to SMALL
    edges are joined in one task; of larger ones each task first joins a range of the edges
    into stars, which connect the same nodes, so a long path is short before the rounds begin. Self-loops and null
    ends are left out; repeated edges do no harm.
    """
    pairs = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u <> v").distinct()
    state = Staged(pairs, "components")
    if state.df.limit(SMALL + 1).count() <= SMALL:
        kind = dict(state.df.dtypes)["u"]
        return Staged(state.df.coalesce(1).mapInPandas(_joined, f"node {kind}, component {kind}"), "components").df
    ranges = state.df.count() // max(1, SMALL // 4) + 1
    kind = dict(state.df.dtypes)["u"]
    stars = Staged(state.df.repartitionByRange(ranges, "v", "u").mapInPandas(_joined, f"node {kind}, component {kind}").toDF("u", "v"), "components")
    state.drop()
    state, mark = stars, None
    while True:  # the rounds grow with the logarithm of the longest path
        both = state.df.unionByName(state.df.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.filter("v > u").join(least.hint("merge"), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        large = Staged(large, "components")
        state.drop()
        low = large.df.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.df.join(low.hint("merge"), "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = Staged(low.select("u", F.col("m").alias("v")).unionByName(moved).distinct(), "components")
        large.drop()
        state = small
        now = state.df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(now) == mark:
            break
        mark = tuple(now)
    return state.df.select(F.col("u").alias("node"), F.col("v").alias("component"))

"""Tables that grow with the input are never broadcast: a staged table of few different values is a small file of many rows."""

import contextlib

import pytest

from weftgraph import export
from weftgraph.operators import analytics, cochange
from weftgraph.operators import components as connected


@contextlib.contextmanager
def plans_of(spark):
    """The plans that run inside, as they ended."""
    store, found = spark._jsparkSession.sharedState().statusStore(), []
    began = store.executionsCount()
    yield found
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    runs = store.executionsList()
    found += [runs.apply(k).physicalPlanDescription() for k in range(began, runs.size())]


def broadcasts(plans):
    return sum("BroadcastHashJoin" in p.partition("== Initial Plan ==")[0] for p in plans)


def test_components_in_rounds(spark, monkeypatch):
    monkeypatch.setattr(connected, "SMALL", 400)
    edges = spark.range(3_000).selectExpr("id as a", "id + 1 as b")
    with plans_of(spark) as plans:
        got = connected.components(edges).collect()
    assert {(r.node, r.component) for r in got} == {(k, 0) for k in range(1, 3_001)}
    assert plans and not broadcasts(plans)


def test_rounds_of_components_do_not_grow_with_a_path(spark, monkeypatch):
    monkeypatch.setattr(connected, "SMALL", 4_000)
    edges = spark.range(20_000).selectExpr("id as a", "id + 1 as b")
    with plans_of(spark) as plans:
        assert connected.components(edges).count() == 20_000
    assert len(plans) < 30  # each round has three


@pytest.mark.parametrize("cycle", [False, True])
def test_renames(spark, cycle):
    rows = [(k, f"p{k}", f"p{k + 1}") for k in range(300)] + ([(300, "p300", "p280")] if cycle else [])
    df = spark.createDataFrame(rows, "seq long, old string, new string").repartition(3)
    with plans_of(spark) as plans:
        got = {r.old: r.new for r in cochange.resolve_renames(df).collect()}
    assert len(got) == len(rows) and plans and not broadcasts(plans)


def _ring(spark):
    nodes = spark.createDataFrame([(f"n{k}", f"l{k}", "function") for k in range(40)], "id string, label string, kind string")
    edges = spark.createDataFrame([(f"n{k}", f"n{(k * 3 + 1) % 40}", "calls", "EXTRACTED") for k in range(40)], "source string, target string, relation string, confidence string")
    return nodes, edges


@pytest.mark.parametrize(
    "query",
    [
        lambda n, e: analytics.pagerank(n, e, exactly=2),
        lambda n, e: analytics.god_nodes(analytics.degrees(n, e), analytics.pagerank(n, e, exactly=2), 3),
        lambda n, e: export.d3_nodes(n, analytics.pagerank(n, e, exactly=2)),
        analytics.component_labels,
        analytics.quality,
    ],
    ids=["pagerank", "god_nodes", "d3_nodes", "component_labels", "quality"],
)
def test_graph_queries(spark, query):
    nodes, edges = _ring(spark)
    with plans_of(spark) as plans:
        assert query(nodes, edges).count() in (1, 3, 40)
    assert plans and not broadcasts(plans)

"""The test tables seen as graph, corpus, commits and vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges): regions contain nations, nations define suppliers and customers, suppliers reference their region."""
    region, nation = table(spark, sf_dir, "region"), table(spark, sf_dir, "nation")
    supplier, customer = table(spark, sf_dir, "supplier"), table(spark, sf_dir, "customer")
    places = nation.join(F.broadcast(region), nation.n_regionkey == region.r_regionkey)  # 25 nations, 5 regions by definition
    places = places.select("n_nationkey", "n_name", "r_regionkey", "r_name")

    def key(letter: str, column: str):
        return F.concat(F.lit(letter), F.col(column).cast("string"))

    def node(df: DataFrame, id_, label: str, kind: str, path) -> DataFrame:
        return df.select(id_.alias("id"), F.col(label).alias("label"), F.lit(kind).alias("kind"), path.alias("file_path"))

    def edge(df: DataFrame, source, target, relation: str, confidence: str) -> DataFrame:
        return df.select(source.alias("source"), target.alias("target"), F.lit(relation).alias("relation"), F.lit(confidence).alias("confidence"))

    s = supplier.join(F.broadcast(places), supplier.s_nationkey == places.n_nationkey)
    c = customer.join(F.broadcast(places), customer.c_nationkey == places.n_nationkey)
    nodes = (
        node(region, key("r", "r_regionkey"), "r_name", "region", F.col("r_name"))
        .unionByName(node(places, key("n", "n_nationkey"), "n_name", "nation", F.concat_ws("/", "r_name", "n_name")))
        .unionByName(node(s, key("s", "s_suppkey"), "s_name", "supplier", F.concat_ws("/", "r_name", "n_name", F.lit("suppliers"))))
        .unionByName(node(c, key("c", "c_custkey"), "c_name", "customer", F.concat_ws("/", "r_name", "n_name", F.lit("customers"))))
    )
    edges = (
        edge(places, key("r", "r_regionkey"), key("n", "n_nationkey"), "contains", "EXTRACTED")
        .unionByName(edge(s, key("n", "n_nationkey"), key("s", "s_suppkey"), "defines", "EXTRACTED"))
        .unionByName(edge(c, key("n", "n_nationkey"), key("c", "c_custkey"), "defines", "EXTRACTED"))
        .unionByName(edge(s, key("s", "s_suppkey"), key("r", "r_regionkey"), "references", "INFERRED"))
    )
    return nodes, edges


GRAPH_SQL = """
places AS (SELECT n_nationkey, n_name, r_regionkey, r_name FROM nation JOIN region ON n_regionkey = r_regionkey),
s AS (SELECT * FROM supplier JOIN places ON s_nationkey = n_nationkey),
c AS (SELECT * FROM customer JOIN places ON c_nationkey = n_nationkey),
nodes AS (
  SELECT 'r' || r_regionkey AS id, r_name AS label, 'region' AS kind, r_name AS file_path FROM region
  UNION ALL SELECT 'n' || n_nationkey, n_name, 'nation', r_name || '/' || n_name FROM places
  UNION ALL SELECT 's' || s_suppkey, s_name, 'supplier', r_name || '/' || n_name || '/suppliers' FROM s
  UNION ALL SELECT 'c' || c_custkey, c_name, 'customer', r_name || '/' || n_name || '/customers' FROM c),
edges AS (
  SELECT 'r' || r_regionkey AS source, 'n' || n_nationkey AS target, 'contains' AS relation, 'EXTRACTED' AS confidence FROM places
  UNION ALL SELECT 'n' || n_nationkey, 's' || s_suppkey, 'defines', 'EXTRACTED' FROM s
  UNION ALL SELECT 'n' || n_nationkey, 'c' || c_custkey, 'defines', 'EXTRACTED' FROM c
  UNION ALL SELECT 's' || s_suppkey, 'r' || r_regionkey, 'references', 'INFERRED' FROM s)
"""


def commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as commits: hash, ts (epoch seconds), message, file; one row for each supplier of a line."""
    orders, lines = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    files = lines.select("l_orderkey", F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("file")).distinct()
    head = orders.select(F.col("o_orderkey").alias("hash"), F.unix_seconds(F.col("o_orderdate").cast("timestamp")).alias("ts"), F.col("o_orderpriority").alias("message"))
    return head.join(files, head["hash"] == files["l_orderkey"]).select("hash", "ts", "message", "file")


COMMITS_SQL = """
commits AS (
  SELECT o_orderkey AS hash, epoch(o_orderdate)::BIGINT AS ts, o_orderpriority AS message, file
  FROM orders JOIN (SELECT DISTINCT l_orderkey, 's' || l_suppkey AS file FROM lineitem) ON o_orderkey = l_orderkey)
"""


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("vector"), "label")

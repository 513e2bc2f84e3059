"""The incremental build as a stream: newest version of each path, kept in a store, and rebuilds while files change."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.staging import remove
from weftgraph.store import GraphStore

SHAPE = "path string, version string, ts timestamp, sha256 string"


def newest(rows: DataFrame) -> DataFrame:
    """One row (path, version, ts, sha256) for each path: the latest by ts, then version."""
    last = rows.groupBy("path").agg(F.max(F.struct("ts", "version", "sha256")).alias("r"))
    return last.select("path", "r.version", "r.ts", "r.sha256")


def _batches(store: GraphStore, name: str) -> str:
    return f"{store.path}/{name}_batches"


def load(store: GraphStore, name: str = "versions") -> DataFrame:
    """The newest version of each path: of the compacted table and the batches after it."""
    spark = store.spark
    base, folder = store.load(name), _batches(store, name)
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    there = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)
    rows = spark.read.schema(SHAPE).parquet(folder).select("path", "version", "ts", "sha256") if there else spark.createDataFrame([], SHAPE)
    return newest(rows if base is None else rows.unionByName(base))


def compact(store: GraphStore, name: str = "versions") -> None:
    """Fold the batches into the table. A crash in between leaves rows in both, and the newest of them is the same."""
    store.save(name, load(store, name))
    remove(store.spark, _batches(store, name))


def follow(stream: DataFrame, store: GraphStore, checkpoint: str, name: str = "versions", compact_every: int = 50):
    """Start a query that adds each batch of versions (path, version, ts, content) to ``name``; :func:`load` reads it.

    A batch writes its own rows only, into a folder of its number, so one that is run
    again after a failure replaces itself; every ``compact_every`` batches are folded
    into the table. Late versions never replace newer ones.
    """

    def fold(batch: DataFrame, number: int) -> None:
        rows = newest(batch.select("path", "version", "ts", F.sha2("content", 256).alias("sha256")))
        rows.write.mode("overwrite").parquet(f"{_batches(store, name)}/batch={number}")
        if number % compact_every == compact_every - 1:
            compact(store, name)

    return stream.writeStream.foreachBatch(fold).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def watch(spark: SparkSession, source_dir: str, store_dir: str, checkpoint: str, every: str = "30 seconds"):
    """Start a query that brings the graph store up to date at each tick, parsing changed files only."""
    from weftgraph.engine import build_graph_store

    def rebuild(_: DataFrame, number: int) -> None:
        build_graph_store(spark, source_dir, store_dir, incremental=True)

    ticks = spark.readStream.format("rate").option("rowsPerSecond", 1).load()
    return ticks.writeStream.foreachBatch(rebuild).option("checkpointLocation", checkpoint).trigger(processingTime=every).start()

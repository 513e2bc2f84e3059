"""The stored graph: Parquet tables below one folder."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.staging import remove


FOLDER = ".weftgraph"


def resolve(path: str | None, source_dir: str = ".") -> str | None:
    """The store to use: the one named, else that of the source folder or the nearest folder above it; None if there is none."""
    if path:
        return path if "://" in path or os.path.exists(path) else None
    at = os.path.realpath(source_dir)
    while True:
        if os.path.isdir(os.path.join(at, FOLDER)):
            return os.path.join(at, FOLDER)
        if at == os.path.dirname(at):
            return None
        at = os.path.dirname(at)


class GraphStore:
    """Tables nodes, edges, postings, communities, community_members, embeddings, metadata, manifest.

    Each save writes a new version and then names it in a one-row pointer, so a
    reader never sees half a table; the version before is removed after that.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._old: list[str] = []

    def _pointer(self, name: str) -> str | None:
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}/_current")
        fs = p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        if not fs.exists(p):
            return None
        stream = fs.open(p)
        try:
            return jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8").strip()
        finally:
            stream.close()

    def _point(self, name: str, version: str) -> None:
        """Write a new pointer beside the old one and rename it over that: there is one at any time."""
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        fs_of = jvm.org.apache.hadoop.fs
        new, old = fs_of.Path(f"{self.path}/{name}/_next-{version}"), fs_of.Path(f"{self.path}/{name}/_current")
        out = new.getFileSystem(conf).create(new)
        out.write(bytearray(version.encode()))
        out.close()
        ways = self.spark.sparkContext._gateway.new_array(getattr(fs_of, "Options$Rename"), 1)
        ways[0] = getattr(fs_of, "Options$Rename").OVERWRITE
        whole = new.getFileSystem(conf).makeQualified(new)
        fs_of.FileContext.getFileContext(whole.toUri(), conf).rename(whole, old.getFileSystem(conf).makeQualified(old), ways)

    def save(self, name: str, df: DataFrame, tidy: bool = True, partition_by: list[str] = ()) -> None:
        """tidy: remove the version before; else :meth:`tidy` does, after plans that still read it."""
        before = self._pointer(name)
        version = f"v-{uuid.uuid4().hex}"
        (df.write.partitionBy(*partition_by) if partition_by else df.write).parquet(f"{self.path}/{name}/{version}")
        self._point(name, version)
        if before:
            self._old.append(f"{self.path}/{name}/{before}")
        if tidy:
            self.tidy()

    def tidy(self) -> None:
        while self._old:
            remove(self.spark, self._old.pop())

    def load(self, name: str) -> DataFrame | None:
        version = self._pointer(name)
        return self.spark.read.parquet(f"{self.path}/{name}/{version}") if version else None

    def save_graph(self, nodes: DataFrame, edges: DataFrame, tidy: bool = True) -> None:
        self.save("nodes", nodes, False)
        self.save("edges", edges, tidy)

    def save_embeddings(self, new: DataFrame) -> None:
        """Upsert by node_id (columns node_id, vector, model, model_type)."""
        old = self.load("embeddings")
        self.save("embeddings", new if old is None else old.join(new.select("node_id"), "node_id", "left_anti").unionByName(new, True), partition_by=["model_type"] if "model_type" in new.columns else [])

    def embeddings(self, model_type: str | None = None) -> DataFrame | None:
        """Stored vectors, of one model type or all; a type is a folder, so others aren't read."""
        found = self.load("embeddings")
        return found if found is None or model_type is None else found.filter(F.col("model_type") == model_type)

    def embedded_ids(self) -> DataFrame:
        found = self.load("embeddings")
        return self.spark.createDataFrame([], "node_id string") if found is None else found.select("node_id").distinct()

    def set_meta(self, key: str, value: str) -> None:
        old = self.load("metadata")
        row = self.spark.createDataFrame([(key, value)], "key string, value string")
        self.save("metadata", row if old is None else old.filter(F.col("key") != key).unionByName(row))

    def get_meta(self, key: str, default: str | None = None) -> str | None:
        found = self.load("metadata")
        row = None if found is None else found.filter(F.col("key") == key).first()
        return default if row is None else row["value"]

    def clean(self) -> None:
        remove(self.spark, self.path)

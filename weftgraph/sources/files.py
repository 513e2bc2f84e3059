"""Directory scans: which files are read, and why others are not."""

from __future__ import annotations

import fnmatch
import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.model import IGNORED, LANGUAGE_OF, SENSITIVE
from weftgraph.staging import Staged

MOST_BYTES = 1_000_000


def _any(patterns: list[str]) -> str:
    """A pattern for names that match one of the shell patterns."""
    return "^(?:" + "|".join(fnmatch.translate(p).removeprefix("(?s:").removesuffix(r")\Z").removesuffix(r")\z") for p in patterns) + ")$"


def ignore_rules(text: str) -> list[tuple[str, bool]]:
    """(pattern on relative paths, kept) for each line of an ignore file; the last that matches decides.

    ``!`` keeps, a slash before the end anchors to the root, a slash at the end
    means folders, ``*`` and ``?`` stay within a name and ``**`` crosses folders.
    """
    rules = []
    for line in text.splitlines():
        line = line.rstrip()
        if not line or line.startswith("#"):
            continue
        kept, line = line.startswith("!"), line.removeprefix("!")
        folder, line = line.endswith("/"), line.rstrip("/")
        anchored, line = "/" in line, line.removeprefix("/")
        out, k = "", 0
        while k < len(line):
            if line.startswith("**/", k):
                out, k = out + "(?:.*/)?", k + 3
            elif line.startswith("**", k):
                out, k = out + ".*", k + 2
            elif line[k] == "*":
                out, k = out + "[^/]*", k + 1
            elif line[k] == "?":
                out, k = out + "[^/]", k + 1
            elif line[k] == "[" and "]" in line[k + 1 :]:
                end = line.index("]", k + 1)
                out, k = out + "[" + line[k + 1 : end].replace("!", "^", 1 if line[k + 1] == "!" else 0) + "]", end + 1
            else:
                out, k = out + re.escape(line[k]), k + 1
        rules.append((("^" if anchored else "^(?:.*/)?") + out + ("/.*$" if folder else "(?:/.*)?$"), kept))
    return rules


def ignored(path: Column, rules: list[tuple[str, bool]]) -> Column:
    found = F.lit(False)
    for pattern, kept in rules:
        found = F.when(path.rlike(pattern), F.lit(not kept)).otherwise(found)
    return found


def suffix(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"[^/](\.[^./]*)$", 1))


def classify(files: DataFrame, rules: list[tuple[str, bool]] = (), own_rules: list[tuple[str, bool]] = (), patterns: list[str] = (), most_bytes: int = MOST_BYTES) -> DataFrame:
    """Adds language, file_type and skip_reason (null: read) to rows with path (relative) and size_bytes (null: no stat)."""
    path = F.col("path")
    segments = F.split(path, "/")
    default = F.exists(segments, lambda s: s.rlike(_any([*IGNORED, *patterns])))
    end = suffix(path)
    language = F.lit("unknown")
    for name in sorted(set(LANGUAGE_OF.values())):
        language = F.when(end.isin([e for e, n in LANGUAGE_OF.items() if n == name]), name).otherwise(language)
    kind = F.when(end.isin(list(LANGUAGE_OF)), "code").when(end.isin(".rst", ".txt"), "doc").when(end.isin(".ini", ".cfg"), "config").otherwise("other")
    name = F.lower(F.element_at(segments, -1))
    reason = (
        F.when(default, "ignored")
        .when(ignored(path, list(rules)), "gitignore")
        .when(ignored(path, list(own_rules)), "tool_ignore")
        .when(name.rlike(_any(SENSITIVE)), "sensitive")
        .when(F.col("size_bytes").isNull(), "stat_error")
        .when(F.col("size_bytes") > most_bytes, "too_large")
        .when(F.col("size_bytes") == 0, "empty")
        .when(kind == "other", "unsupported")
    )
    return files.withColumn("language", language).withColumn("file_type", kind).withColumn("skip_reason", reason)


def read_uri(uri: str) -> bytes:
    """The bytes of a file, read where this runs."""
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(re.sub("^file:/+", "file:///", uri))
    with store.open_input_stream(path) as f:
        return f.read()


def _listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every file below the folders of a column of locations."""
    from pyarrow import fs

    for batch in batches:
        for folder in batch.column(0).to_pylist():
            store, top = fs.FileSystem.from_uri(re.sub("^file:/+", "file:///", folder))
            waiting = [top]
            while waiting:
                at = waiting.pop()
                found = store.get_file_info(fs.FileSelector(at, recursive=False))
                waiting += [x.path for x in found if x.type == fs.FileType.Directory]
                files = [x for x in found if x.type == fs.FileType.File]
                if files:
                    yield pa.RecordBatch.from_arrays([pa.array([folder.rstrip("/") + x.path[len(top.rstrip("/")) :] for x in files]), pa.array([x.size for x in files], pa.int64())], names=["uri", "size_bytes"])


def listing(spark: SparkSession, root: str, most_folders: int = 200) -> DataFrame:
    """uri, path (relative), size_bytes of every file below ``root``, hidden ones too.

    Spark's own readers pass over names that begin with a dot or an underscore,
    such as ``__init__.py``, so the file system is asked. The driver looks into the first
    ``most_folders`` folders, breadth first; the executors list what lies below the others.
    """
    jvm = spark.sparkContext._jvm
    top = jvm.org.apache.hadoop.fs.Path(root)
    fs = top.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    base = fs.makeQualified(top).toString().rstrip("/") + "/"
    rows, waiting, seen = [], [top], 0
    while waiting and seen < most_folders:
        folder, seen = waiting.pop(0), seen + 1
        for status in fs.listStatus(folder):
            uri = status.getPath().toString()
            if status.isDirectory():
                waiting.append(status.getPath())
            else:
                rows.append((uri, status.getLen()))
    found = spark.createDataFrame(rows, "uri string, size_bytes long")
    if waiting:
        folders = spark.createDataFrame([(p.toString(),) for p in waiting], "folder string").repartition(max(1, min(len(waiting), 4 * spark.sparkContext.defaultParallelism)))
        found = found.unionByName(Staged(folders.mapInArrow(_listed, "uri string, size_bytes long"), "listing").df)
    return found.select("uri", F.substring("uri", len(base) + 1, 1 << 20).alias("path"), "size_bytes")


def scan(spark: SparkSession, root: str, patterns: list[str] = (), ignore_file: str = ".graphignore", most_bytes: int = MOST_BYTES) -> DataFrame:
    """path, size_bytes, language, file_type, skip_reason, uri (null where skipped) of all files below ``root``; contents are read where they are used."""
    rows = listing(spark, root)
    rules = rows.filter(F.col("path").isin(".gitignore", ignore_file)).collect()  # two files at most
    texts = {r["path"]: read_uri(r["uri"]).decode("utf-8", "replace") for r in rules}
    out = classify(rows, ignore_rules(texts.get(".gitignore", "")), ignore_rules(texts.get(ignore_file, "")), patterns, most_bytes)
    return out.withColumn("uri", F.when(F.col("skip_reason").isNull(), F.col("uri")))


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sums = [hashlib.sha256(read_uri(uri)).hexdigest() for uri in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sums, pa.string())], names=["path", "sha256"])


def manifest(files: DataFrame) -> DataFrame:
    """path, sha256 of the files that are read, one file in memory at a time."""
    return files.filter("skip_reason is null").select("path", "uri").mapInArrow(_hashed, "path string, sha256 string")


def diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """path, change (added, changed, unchanged, deleted) between two manifests."""
    b, a = before.select("path", F.col("sha256").alias("b")), after.select("path", F.col("sha256").alias("a"))
    change = F.when(F.col("b").isNull(), "added").when(F.col("a").isNull(), "deleted").when(F.col("a") == F.col("b"), "unchanged").otherwise("changed")
    return a.join(b, "path", "full").select("path", change.alias("change"))

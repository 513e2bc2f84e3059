"""From extracted rows to a simple directed graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.model import MERGE_KINDS
from weftgraph.staging import Staged

OWN = "defines", "contains"


def dedup_nodes(raw: DataFrame) -> DataFrame:
    """One node for each id: the first by file_seq, emit_seq. The name becomes the label."""
    columns = [c for c in raw.columns if c not in ("id", "file_seq", "emit_seq", "name")]
    order = F.struct("file_seq", "emit_seq")
    first = raw.groupBy("id").agg(F.min_by(F.struct(F.col("name").alias("label"), *columns), order).alias("row"), F.min(order).alias("seq"))
    return first.select("id", "row.*", "seq")


def last_write(edges: DataFrame) -> DataFrame:
    """One edge for each (source, target): relation and confidence of the last by phase, file_seq, emit_seq."""
    order = F.struct("phase", "file_seq", "emit_seq", "relation")
    last = edges.groupBy("source", "target").agg(F.max_by(F.struct("relation", "confidence"), order).alias("row"))
    return last.select("source", "target", "row.*")


def resolve(nodes: DataFrame, wild: DataFrame, name: str = "label") -> DataFrame:
    """Targets ``*::...::name`` by name: one node of that name is the target, several drop the edge, none makes a placeholder."""
    index = nodes.filter(F.coalesce(name, F.lit("")) != "").groupBy(F.col(name).alias("__w_name")).agg(F.count("*").alias("__w_n"), F.min("id").alias("__w_id"))
    last = F.element_at(F.split("target", "::"), -1)
    joined = wild.withColumn("__w_last", last).join(index, F.col("__w_last") == F.col("__w_name"), "left").filter("__w_n is null or __w_n = 1")
    target = F.coalesce("__w_id", F.concat(F.lit("external::"), "__w_last"))
    confidence = F.when(F.col("__w_n") == 1, "EXTRACTED").otherwise("INFERRED")
    keep = [c for c in wild.columns if c not in ("target", "confidence")]
    return joined.select(*keep, target.alias("target"), confidence.alias("confidence"))


def directories(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of folders above ``files`` (id, file_path of modules and documents)."""
    parts = F.split("file_path", "/")
    rooted = F.startswith("file_path", F.lit("/"))
    above = F.transform(F.sequence(F.lit(1), F.size("parts") - 1), lambda n: F.when((n == 1) & rooted, F.lit("/")).otherwise(F.array_join(F.slice("parts", 1, n), "/")))
    levels = files.withColumn("parts", parts).filter(F.size("parts") > 1).select("id", above.alias("above"))
    paths = levels.select(F.posexplode("above").alias("pos", "path"), "above").select("path", F.when(F.col("pos") > 0, F.col("above")[F.col("pos") - 1]).alias("up")).distinct()
    label = F.when(F.col("path") == "/", "/").otherwise(F.element_at(F.split("path", "/"), -1))
    nodes = paths.select(F.concat(F.lit("dir::"), "path").alias("id"), label.alias("label"), F.lit("directory").alias("kind"), F.col("path").alias("file_path")).distinct()
    tree = paths.filter("up is not null").select(F.concat(F.lit("dir::"), "up").alias("source"), F.concat(F.lit("dir::"), "path").alias("target"))
    leaves = levels.select(F.concat(F.lit("dir::"), F.element_at("above", -1)).alias("source"), F.col("id").alias("target"))
    edges = tree.unionByName(leaves).distinct().select("source", "target", F.lit("contains").alias("relation"), F.lit("EXTRACTED").alias("confidence"))
    return nodes, edges


def build(raw_nodes: DataFrame, raw_edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges): direct edges between known nodes, then resolved references, then folders."""
    nodes = dedup_nodes(raw_nodes)
    ids = nodes.select("id")
    direct = raw_edges.filter(~F.startswith("target", F.lit("*::")))
    direct = direct.join(ids.withColumnRenamed("id", "source"), "source", "left_semi").join(ids.withColumnRenamed("id", "target"), "target", "left_semi")
    wild = raw_edges.filter(F.startswith("target", F.lit("*::"))).join(ids.withColumnRenamed("id", "source"), "source", "left_semi")
    found = resolve(nodes, wild)
    rows = direct.withColumn("phase", F.lit(2)).unionByName(found.withColumn("phase", F.lit(3)))
    edges = last_write(rows)
    outside = edges.filter(F.startswith("target", F.lit("external::"))).select(F.col("target").alias("id")).distinct()
    outside = outside.select("id", F.substring("id", 11, 1 << 20).alias("label"), F.lit("external").alias("kind"))
    folder_nodes, folder_edges = directories(nodes.filter(F.col("kind").isin("module", "document") & (F.coalesce("file_path", F.lit("")) != "")).select("id", "file_path"))
    new = folder_edges.join(edges.select("source", "target"), ["source", "target"], "left_anti")
    return nodes.unionByName(outside, True).unionByName(folder_nodes, True), edges.unionByName(new)


def merge_small(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Fold nodes of small kinds into the node that defines or contains them; placeholders go.

    A node's parent is its first owner (by seq where there is one, then id). Chains
    of small nodes are followed to the first that stays by pointer jumping, which
    doubles the reach each round; a small node without such an end just goes.
    Edges move along, without loops and only where none is yet.
    """
    seq = F.col("seq") if "seq" in nodes.columns else F.lit(None)
    small = nodes.filter(F.col("kind").isin(MERGE_KINDS)).select("id")
    order = nodes.select(F.col("id").alias("source"), F.struct(seq.isNull().alias("a"), seq.alias("b"), F.col("id").alias("c")).alias("order"))
    owner = edges.filter(F.col("relation").isin(*OWN) & (F.col("source") != F.col("target"))).join(order, "source").groupBy("target").agg(F.min_by("source", "order").alias("parent"))
    up = small.join(owner, small["id"] == owner["target"], "left").select("id", "parent")
    up = Staged(up, "merge").df
    direct = up.filter("parent is not null")
    before = None
    while True:
        higher = up.select(F.col("id").alias("via"), F.col("parent").alias("over"), F.lit(True).alias("small"))
        jumped = up.join(higher, up["parent"] == higher["via"], "left").select("id", F.when(F.coalesce("small", F.lit(False)), F.col("over")).otherwise(F.col("parent")).alias("parent"), F.coalesce("small", F.lit(False)).alias("moved"))
        jumped = Staged(jumped, "merge").df
        up, left = jumped.drop("moved"), jumped.filter("moved").count()
        if left in (0, before):  # only cycles are left
            break
        before = left
    gone = small.unionByName(nodes.filter("kind = 'external'").select("id"))
    home = up.filter("parent is not null").join(gone.withColumnRenamed("id", "parent"), "parent", "left_anti")

    def moved(df: DataFrame, end: str) -> DataFrame:
        h = home.select(F.col("id").alias(end), F.col("parent").alias("__w_to"))
        return df.join(h, end, "left").withColumn(f"__w_{end}", F.col("__w_to").isNotNull()).withColumn(end, F.coalesce("__w_to", end)).drop("__w_to")

    redirected = moved(moved(edges, "source"), "target").filter("source <> target or not (__w_source or __w_target)")
    kept = redirected.join(gone.withColumnRenamed("id", "source"), "source", "left_anti").join(gone.withColumnRenamed("id", "target"), "target", "left_anti")
    one = kept.groupBy("source", "target").agg(F.min_by(F.struct("relation", "confidence"), F.struct(F.col("__w_source") | F.col("__w_target"), "relation", "confidence")).alias("row")).select("source", "target", "row.*")

    parts = direct.join(nodes, "id")
    for c in ("signature", "docstring"):
        if c not in nodes.columns:
            nodes, parts = nodes.withColumn(c, F.lit(None).cast("string")), parts.withColumn(c, F.lit(None).cast("string"))
    which = lambda *kinds: F.col("kind").isin(*kinds)
    listed = lambda cond, value: F.array_sort(F.collect_list(F.when(cond & (value != ""), F.struct(F.col("id").alias("k"), value.alias("v")))))
    folded = parts.groupBy("parent").agg(
        listed(which("constructor"), F.col("signature")).alias("sigs"),
        listed(which("constructor"), F.col("docstring")).alias("docs"),
        listed(which("property", "variable", "type_alias"), F.col("label")).alias("members"),
        listed(which("decorator"), F.col("label")).alias("decos"),
    )
    base = nodes.join(gone, "id", "left_anti").join(folded, F.col("id") == F.col("parent"), "left")
    empty = lambda c: F.when(F.coalesce(c, F.lit("")) == "", None).otherwise(F.col(c))
    doc = F.array_join(F.concat(F.array_compact(F.array(empty("docstring"))), F.coalesce(F.col("docs.v"), F.array().cast("array<string>"))), "\n\n")
    own = F.coalesce("decorators", F.array().cast("array<string>")) if "decorators" in nodes.columns else F.array().cast("array<string>")
    out = base.withColumn("signature", F.coalesce(empty("signature"), F.get(F.col("sigs.v"), F.lit(0)), F.lit("")))
    out = out.withColumn("docstring", doc).withColumn("merged_members", F.coalesce(F.col("members.v"), F.array().cast("array<string>")))
    out = out.withColumn("decorators", F.array_union(own, F.coalesce(F.col("decos.v"), F.array().cast("array<string>"))))
    return out.drop("parent", "sigs", "docs", "members", "decos"), one


def compose(old_nodes: DataFrame, old_edges: DataFrame, new_nodes: DataFrame, new_edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The stored graph without nodes of the files that were read again, and the new graph, whose rows win."""
    files = new_nodes.filter("file_path <> ''").select("file_path").distinct()
    stay = old_nodes.join(files, "file_path", "left_anti")
    nodes = stay.join(new_nodes.select("id"), "id", "left_anti").unionByName(new_nodes, True)
    ids = stay.select("id")
    kept = old_edges.join(ids.withColumnRenamed("id", "source"), "source", "left_semi").join(ids.withColumnRenamed("id", "target"), "target", "left_semi")
    return nodes, kept.join(new_edges.select("source", "target"), ["source", "target"], "left_anti").unionByName(new_edges, True)

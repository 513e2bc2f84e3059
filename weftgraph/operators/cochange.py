"""Files that change together."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weftgraph.staging import Staged

DAY = 86_400


def _followed(step: DataFrame) -> DataFrame:
    """old, new: the end of each path's chain; of one that runs into a cycle, a path on the cycle.

    Pointer jumping: each round doubles the length of the chain that is followed,
    until nothing moves or the length reaches the number of rows. The staged rows are
    a small file, so the join is told not to broadcast them.
    """
    at, hops = step, 1
    rows = step.count()
    while hops < rows:
        then = at.select(F.col("old").alias("via"), F.col("new").alias("next"))
        jumped = at.join(then.hint("merge"), at["new"] == then["via"], "left").select("old", F.coalesce("next", "new").alias("new"), F.col("next").isNotNull().alias("moved"))
        jumped = Staged(jumped, "renames").df
        at, hops = jumped.drop("moved"), 2 * hops
        if not jumped.filter("moved").head(1):
            break
    return at


def resolve_renames(renames: DataFrame) -> DataFrame:
    """old, new: where each old path has ended up, along chains of any length; a cycle ends where it would repeat.

    ``renames`` has seq, old, new; of several renames of a path the last counts.
    """
    last = Staged(renames.groupBy("old").agg(F.max_by("new", "seq").alias("new")).filter("old <> new"), "renames").df
    at = _followed(last)
    cycle = at.join(last.select(F.col("old").alias("on")).hint("merge"), F.col("new") == F.col("on"), "left_semi").select(F.col("new").alias("on")).distinct()
    cycle = Staged(cycle, "renames").df
    if not cycle.head(1):
        return at
    ends = _followed(last.join(cycle.hint("merge"), last["old"] == cycle["on"], "left_anti"))
    before = last.join(cycle.hint("merge"), last["old"] == cycle["on"], "left_semi").select(F.col("new").alias("node"), F.col("old").alias("end"))
    tails = ends.join(before.hint("merge"), ends["new"] == before["node"], "left").select("old", F.coalesce("end", "new").alias("new"))
    return tails.unionByName(before.select(F.col("node").alias("old"), F.col("end").alias("new")))


def pairs(commits: DataFrame, most_files: int = 30, min_support: int = 3, min_confidence: float = 0.3, half_life_days: float = 180.0, messages: int = 10, extracted_support: int = 5, extracted_strength: float = 0.5) -> DataFrame:
    """a, b, support, strength, recency, confidence, sample_messages of pairs of files.

    ``commits`` has hash, ts (epoch seconds), message, file, and may have seq (the
    order in the log; else by ts descending). Commits of fewer than two or more
    than ``most_files`` files count for nothing, and are left out before the
    self-join, so it is at most ``most_files / 2`` times the rows.
    """
    if "seq" not in commits.columns:
        commits = commits.withColumn("seq", F.struct(-F.col("ts"), F.col("hash")))
    now = commits.agg(F.max("ts").alias("now"))
    size = Window.partitionBy("hash")
    rows = commits.withColumn("n", F.count("*").over(size)).filter(F.col("n").between(2, most_files)).drop("n")
    rows = rows.crossJoin(F.broadcast(now))  # one row
    decay = F.exp(-F.log(F.lit(2.0)) / (half_life_days * DAY) * F.greatest(F.col("now") - F.col("ts"), F.lit(0)))
    rows = rows.withColumn("decay", decay).drop("now")
    each = rows.groupBy("file").agg(F.count("*").alias("commits"))
    left = rows.select("hash", F.col("file").alias("a"), "decay", "message", "seq")
    right = rows.select(F.col("hash").alias("h"), F.col("file").alias("b"))
    both = left.join(right, (F.col("hash") == F.col("h")) & (F.col("a") < F.col("b")))
    sums = both.groupBy("a", "b").agg(F.count("*").alias("support"), F.sum("decay").alias("decay")).filter(F.col("support") >= min_support)
    ca, cb = each.select(F.col("file").alias("a"), F.col("commits").alias("na")), each.select(F.col("file").alias("b"), F.col("commits").alias("nb"))
    joined = sums.join(ca, "a").join(cb, "b").withColumn("s", F.col("support") / F.sqrt(F.col("na") * F.col("nb")))
    tier = F.when((F.col("support") >= extracted_support) & (F.col("s") >= extracted_strength), "EXTRACTED").when(F.col("s") >= min_confidence, "INFERRED")
    kept = joined.withColumn("confidence", tier).filter("confidence is not null")
    kept = Staged(kept.select("a", "b", "support", F.round("s", 4).alias("strength"), F.round(F.col("decay") / F.col("support"), 4).alias("recency"), "confidence"), "pairs").df
    # messages are fetched for the pairs that stay, and no more than are shown are ever held together
    said = both.select("a", "b", "seq", "message").join(kept.select("a", "b"), ["a", "b"], "left_semi")
    first = said.withColumn("k", F.row_number().over(Window.partitionBy("a", "b").orderBy("seq", "message"))).filter(F.col("k") <= messages)
    log = first.groupBy("a", "b").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "message"))), lambda x: x["message"]).alias("sample_messages"))
    # strongest first
    return kept.join(log, ["a", "b"]).select("a", "b", "support", "strength", "recency", "confidence", "sample_messages").orderBy(F.desc("strength"), "a", "b")


def commit_context(found: DataFrame, most: int = 10) -> DataFrame:
    """id, context: "commits: a; b" of the first ``most`` different messages of a file's pairs, those in which it comes first before the others."""
    ends = found.select(F.col("a").alias("id"), F.lit(0).alias("side"), F.col("b").alias("other"), F.posexplode("sample_messages").alias("at", "message"))
    ends = ends.unionByName(found.select(F.col("b").alias("id"), F.lit(1).alias("side"), F.col("a").alias("other"), F.posexplode("sample_messages").alias("at", "message")))
    once = ends.filter("message <> ''").groupBy("id", "message").agg(F.min(F.struct("side", "other", "at")).alias("first"))
    some = once.withColumn("k", F.row_number().over(Window.partitionBy("id").orderBy("first"))).filter(F.col("k") <= most)
    texts = F.transform(F.array_sort(F.collect_list(F.struct("k", "message"))), lambda x: x["message"])
    return some.groupBy("id").agg(F.concat(F.lit("commits: "), F.array_join(texts, "; ")).alias("context"))


def enrich(edges: DataFrame, found: DataFrame) -> DataFrame:
    """Edges with a co_change edge in both directions of each pair; it replaces an edge that is there."""
    new = found.select(F.col("a").alias("source"), F.col("b").alias("target"), F.lit("co_change").alias("relation"), "confidence")
    new = new.unionByName(new.select(F.col("target").alias("source"), F.col("source").alias("target"), "relation", "confidence"))
    return edges.select("source", "target", "relation", "confidence").join(new.select("source", "target"), ["source", "target"], "left_anti").unionByName(new)

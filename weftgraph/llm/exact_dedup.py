"""Exact dedup by deterministic block naming.

Texts are cut into blocks of ``BLOCK`` characters. Distinct blocks are sorted
(by hash, then by the block itself) and numbered: equal blocks get one integer
name, different blocks different ones, because blocks and not only hashes are
compared. Adjacent names are then paired and the pairs named in the same way,
level by level, until each document has one name.

A document with a block, or later a pair, that occurs only once in the corpus
equals no other document, so it leaves after that level; names are given only to
what repeats. Blocks are summed up before the shuffle, so a text with very many
copies is sent once from each task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftgraph.llm.common import Staged, text_or_empty

BLOCK = 2048


def _blocks(body):
    # one pass over the text; an empty text is one empty block
    return F.when(body == "", F.array(F.lit(""))).otherwise(F.regexp_extract_all(body, F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0)))


def _named(counted: DataFrame, keys: list[str], name: str) -> Staged:
    """Integer names, in sorted order, for the rows of ``counted`` with n above 1.

    Rows of ``counted`` are already dealt out by their keys; the number of a
    row in its sorted partition, with the partition's number above it, is its name.
    """
    repeated = counted.filter("n > 1").sortWithinPartitions(*keys)
    return Staged(repeated.withColumn("name", F.monotonically_increasing_id()), name)


def identities(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(rows, names): rows has doc_id, sha (binary SHA-256), copies for each distinct pair of id
    and text; names has doc_id, sha, copies, level, name for texts that more than one such row may have."""
    body = text_or_empty(docs, text)
    base = docs.select(docs[doc_id].alias("doc_id"), body.alias("body"))
    sha = F.unhex(F.sha2(F.col("body").cast("binary"), 256))
    rows = base.select("doc_id", sha.alias("sha"), F.transform(_blocks(F.col("body")), lambda b: F.xxhash64(b)).alias("hashes"))
    rows = Staged(rows.groupBy("doc_id", "sha").agg(F.first("hashes").alias("hashes"), F.count("*").alias("copies")), "dedup-rows")
    meta = rows.df

    # level 0: blocks
    blocks = base.select(F.explode(_blocks(F.col("body"))).alias("block")).withColumn("h", F.xxhash64("block"))
    counted = blocks.groupBy("h", "block").agg(F.count("*").alias("n"))
    named = _named(counted, ["h", "block"], "dedup-blocks")
    clash = Staged(named.df.groupBy("h").agg(F.count("*").alias("blocks")).filter("blocks > 1").select("h"), "dedup-clashes")
    places = meta.select("doc_id", "sha", "copies", F.size("hashes").alias("length"), F.posexplode("hashes").alias("pos", "h"))
    clean = named.df.select("h", "name")
    if clash.df.isEmpty():
        known = places.join(clean, "h")
    else:  # different blocks with one hash: those are compared as text
        known = places.join(clash.df, "h", "left_anti").join(clean, "h")
        texts = base.select("doc_id", sha.alias("sha"), F.posexplode(_blocks(F.col("body"))).alias("pos", "block")).withColumn("h", F.xxhash64("block"))
        texts = texts.join(clash.df, "h", "left_semi").distinct().join(named.df.select("h", "block", "name"), ["h", "block"])
        lengths = meta.select("doc_id", "sha", "copies", F.size("hashes").alias("length"))
        same = texts["doc_id"].eqNullSafe(lengths["doc_id"]) & (texts["sha"] == lengths["sha"])
        known = known.unionByName(texts.join(lengths, same).select("h", lengths["doc_id"], lengths["sha"], "copies", "length", "pos", "name"))
    level = Staged(known.select("doc_id", "sha", "copies", "length", "pos", "name"), "dedup-level")
    named.drop()
    clash.drop()

    done: DataFrame | None = None
    depth = 0
    while True:
        depth += 1
        # documents of which every place still has a name
        whole = level.df.groupBy("doc_id", "sha", "length").agg(F.count("*").alias("found")).filter("found = length")
        row = level.df
        last = row.filter("length = 1").select("doc_id", "sha", "copies", F.lit(depth).alias("level"), "name")
        done = last if done is None else done.unionByName(last)
        longer = whole.filter("length > 1").select(F.col("doc_id").alias("w_id"), F.col("sha").alias("w_sha"))
        rest = row.filter("length > 1")
        rest = rest.join(longer, rest["doc_id"].eqNullSafe(longer["w_id"]) & (rest["sha"] == longer["w_sha"]), "left_semi")
        pairs = rest.groupBy("doc_id", "sha", "copies", F.ceil(F.col("length") / 2).cast("int").alias("length"), F.shiftright("pos", 1).alias("pos")).agg(
            F.max(F.when(F.col("pos") % 2 == 0, F.col("name"))).alias("left"),
            F.coalesce(F.max(F.when(F.col("pos") % 2 == 1, F.col("name"))), F.lit(-1)).alias("right"),
        )
        paired = Staged(pairs, "dedup-pairs")
        if paired.df.isEmpty():
            paired.drop()
            return meta, done
        names = _named(paired.df.groupBy("left", "right").agg(F.count("*").alias("n")), ["left", "right"], "dedup-names")
        level = Staged(paired.df.join(names.df.drop("n"), ["left", "right"]).select("doc_id", "sha", "copies", "length", "pos", "name"), "dedup-level")
        paired.drop()
        names.drop()


def dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    Of equal texts (null counts as empty; nothing is normalised) the row with the
    largest doc_id stays. Rows repeated in id and text count in ``group_size`` and
    one of them stays. A null id is smaller than any other: if all ids of a group
    are null, keep_id is null and one row stays. Other columns don't matter.
    """
    rows, names = identities(docs, doc_id, text)
    groups = names.groupBy("level", "name").agg(F.max("doc_id").alias("keep_id"), F.sum("copies").alias("group_size"))
    member = names.join(groups, ["level", "name"]).select(F.col("doc_id").alias("m_id"), F.col("sha").alias("m_sha"), F.lit(True).alias("grouped"), "keep_id", "group_size")
    on = rows["doc_id"].eqNullSafe(member["m_id"]) & (rows["sha"] == member["m_sha"])
    found = rows.join(member, on, "left").select(
        "doc_id",
        F.when(F.col("grouped"), F.col("keep_id")).otherwise(F.col("doc_id")).alias("keep_id"),
        F.coalesce("group_size", "copies").cast("bigint").alias("group_size"),
        F.lower(F.hex("sha")).alias("text_sha256"),
        F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("copies"))).alias("copy"),
    )
    kept = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 1)
    return found.select("doc_id", "keep_id", "group_size", kept.alias("kept"), "text_sha256")


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, without copies of the text of a row that stays.

    Of rows repeated in id and text one stays, whatever their other columns hold.
    """
    found = Staged(dedup(docs, doc_id, text), "dedup-found").df
    stay = found.filter("kept").select(F.col("doc_id").alias("__w_id"), F.col("text_sha256").alias("__w_sha"))
    sha = F.sha2(text_or_empty(docs, text).cast("binary"), 256)
    on = docs[doc_id].eqNullSafe(stay["__w_id"]) & (sha == stay["__w_sha"])
    repeated = found.filter("group_size > 1").groupBy("doc_id", "text_sha256").agg(F.count("*").alias("n")).filter("n > 1")
    repeated = Staged(repeated.select(F.col("doc_id").alias("__w_rid"), F.col("text_sha256").alias("__w_rsha")), "dedup-repeated").df
    if repeated.isEmpty():
        return docs.join(stay, on, "left_semi")
    again = stay.join(repeated, stay["__w_id"].eqNullSafe(repeated["__w_rid"]) & (stay["__w_sha"] == repeated["__w_rsha"]), "left_semi")
    once = stay.join(repeated, stay["__w_id"].eqNullSafe(repeated["__w_rid"]) & (stay["__w_sha"] == repeated["__w_rsha"]), "left_anti")
    row = F.row_number().over(Window.partitionBy("__w_id", "__w_sha").orderBy("__w_id"))
    first = docs.join(again, on).withColumn("__w_row", row).filter("__w_row = 1").select(*[docs[c] for c in docs.columns])
    return docs.join(once, on, "left_semi").unionByName(first)

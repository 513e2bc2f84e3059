"""Shards of near-equal bytes: minimax contiguous partition of atomic text groups.

Equal texts form an atomic group. Groups are ordered by the first 60 bits of the
text's SHA-256 (texts that share those bits count as one group, so the order is
total). The smallest feasible shard capacity is found by binary search with a
greedy check, then the order is cut at 23 keys; a document's shard is the number
of cut keys not above its own, so no document takes part in a join.

The driver never holds all groups. It holds sums over key ranges, at most
``RANGES`` of them and what one refinement adds; a capacity is accepted only if
it is feasible with cuts at known range ends, and refused only if it is
infeasible even with cuts anywhere inside a range of several groups. Ranges that
still matter are split by further key bits until both bounds meet.
"""

from __future__ import annotations

import bisect

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftgraph.llm.common import Staged, text_or_empty

KEY_BITS = 60
RANGES = 1 << 16
ROWS_A_BUCKET = 50_000


class Ranges:
    """Consecutive key ranges: start, width exponent, bytes, number of groups."""

    def __init__(self, rows: list[tuple[int, int, int, int]]):
        self.rows = sorted(rows)
        self.ends = [0]
        for _, _, size, _ in self.rows:
            self.ends.append(self.ends[-1] + size)
        self.total = self.ends[-1]

    def reach(self, at: int, capacity: int, inside: bool) -> int:
        """The furthest cut from ``at``; inside: also within ranges of several groups."""
        most = at + capacity
        if most >= self.total:
            return self.total
        k = bisect.bisect_right(self.ends, most) - 1
        return most if inside and self.rows[k][3] > 1 else max(self.ends[k], min(at, most))

    def cuts(self, capacity: int, shards: int, inside: bool) -> list[int]:
        at, found = 0, []
        for _ in range(shards):
            at = self.reach(at, capacity, inside)
            found.append(at)
        return found

    def smallest(self, shards: int, inside: bool) -> int:
        low, high = 0, self.total
        while low < high:
            mid = (low + high) // 2
            if self.cuts(mid, shards, inside)[-1] >= self.total:
                high = mid
            else:
                low = mid + 1
        return low


def capacity_and_ranges(groups: DataFrame, shards: int) -> tuple[int, Ranges]:
    """The least capacity that ``shards`` contiguous shards need, and ranges fine enough to cut at."""
    shift = KEY_BITS - RANGES.bit_length() + 1

    def summed(df: DataFrame, exponent: int) -> list[tuple[int, int, int, int]]:
        at = F.shiftright("key", exponent)
        got = df.groupBy(at.alias("at")).agg(F.sum("bytes").alias("bytes"), F.count("*").alias("groups")).collect()
        return [(r["at"] << exponent, exponent, r["bytes"], r["groups"]) for r in got]

    ranges = Ranges(summed(groups, shift))
    while True:
        low, high = ranges.smallest(shards, True), ranges.smallest(shards, False)
        if low >= high:
            return high, ranges
        first, last = ranges.cuts(low, shards, False), ranges.cuts(high, shards, True)
        play = set()
        for a, b in zip(first, last, strict=True):
            k = bisect.bisect_right(ranges.ends, a) - 1
            while k < len(ranges.rows) and ranges.ends[k] <= b:
                if ranges.rows[k][3] > 1:
                    play.add(k)
                k += 1
        rows = [r for k, r in enumerate(ranges.rows) if k not in play]
        bits = max(1, (RANGES // max(1, len(play))).bit_length() - 1)
        for exponent in {ranges.rows[k][1] for k in play}:
            starts = [(ranges.rows[k][0] >> exponent,) for k in play if ranges.rows[k][1] == exponent]
            wanted = groups.sparkSession.createDataFrame(starts, "__w_at long")  # at most RANGES longs a round
            some = groups.join(F.broadcast(wanted), F.shiftright("key", exponent) == F.col("__w_at"), "left_semi")
            rows += summed(some, max(0, exponent - bits))
        ranges = Ranges(rows)


def cut_keys(capacity: int, ranges: Ranges, shards: int) -> list[int]:
    """First keys of the shards after the first: each cut nearest to an equal share of what is left, within the capacity."""
    latest = [ranges.total]
    for _ in range(shards - 1):  # from the right: where at the earliest the last k shards can begin
        k = bisect.bisect_left(ranges.ends, latest[-1] - capacity)
        latest.append(min(ranges.ends[k], latest[-1]))
    at, keys = 0, []
    for j in range(1, shards):
        ideal = at + (ranges.total - at) / (shards - j + 1)
        least, most = max(at, latest[shards - j]), at + capacity
        k = bisect.bisect_left(ranges.ends, ideal)
        near = sorted((x for x in ranges.ends[max(0, k - 1) : k + 1] if least <= x <= most), key=lambda x: (abs(x - ideal), x))
        if near:
            at = near[0]
        else:  # nothing near is allowed: the allowed cut closest to the ideal
            lo, hi = bisect.bisect_left(ranges.ends, least), bisect.bisect_right(ranges.ends, most) - 1
            at = ranges.ends[lo] if ideal < least or lo > hi else ranges.ends[hi]
        k = bisect.bisect_left(ranges.ends, at)
        keys.append(ranges.rows[k][0] if k < len(ranges.rows) else 1 << KEY_BITS)
    return keys


def shard(docs: DataFrame, shards: int = 24, doc_id: str = "doc_id", text: str = "text", keys: bool = False) -> DataFrame:
    """Put every row into one of ``shards`` shards under the law ``bytes`` (sizes near equal).

    Size is the UTF-8 length of the text (null: none) plus 8. Equal texts share a
    shard; null and empty texts are equal. Slots count from 0 in each shard
    without gaps, repeated rows and null ids included. An empty table gives an
    empty result; other columns don't matter and are left out. ``grown_shard`` is
    null under this law. With ``keys`` text_key, the key of the row's text, follows.
    """
    body = text_or_empty(docs, text)
    rows = docs.select(
        docs[doc_id].alias("doc_id"),
        (F.octet_length(body).cast("bigint") + 8).alias("size"),
        F.crc32(body.cast("binary")).alias("text_crc32"),
        F.conv(F.substring(F.sha2(body.cast("binary"), 256), 1, KEY_BITS // 4), 16, 10).cast("bigint").alias("key"),
    )
    # stored, the rows' numbers no longer change
    rows = Staged(rows.withColumn("row", F.monotonically_increasing_id()), "shard-rows").df
    groups = Staged(rows.groupBy("key").agg(F.sum("size").alias("bytes"), F.count("*").alias("n")), "shard-groups")
    capacity, ranges = capacity_and_ranges(groups.df, shards)
    n_rows = groups.df.agg(F.sum("n")).first()[0] or 0
    groups.drop()
    number = F.lit(0)
    for key in cut_keys(capacity, ranges, shards) if ranges.rows else []:
        number = number + (F.col("key") >= F.lit(key)).cast("int")
    buckets = max(64, n_rows // (shards * ROWS_A_BUCKET))
    placed = rows.withColumn("shard", number).withColumn("bucket", F.pmod(F.xxhash64("row"), F.lit(buckets)))
    counts = placed.groupBy("shard", "bucket").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("shard", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    within = Window.partitionBy("shard", "bucket").orderBy("doc_id", "row")
    return placed.join(starts, ["shard", "bucket"]).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        (F.col("start") + F.row_number().over(within) - 1).cast("bigint").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
        *([F.col("key").alias("text_key")] if keys else []),
    )

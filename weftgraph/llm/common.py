"""Shared pieces of the corpus operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.staging import Staged, shared_dir

__all__ = ["MOST_HOT", "Staged", "join_hot", "shared_dir", "text_or_empty"]

# Keys of more rows than this, and than a MOST_HOT-th of all rows, are hot, so there are never more than MOST_HOT of them.
HOT_ROWS = 1_000
MOST_HOT = 100_000


def text_or_empty(df: DataFrame, column: str = "text"):
    """The text as a string, null counting as empty."""
    return F.coalesce(df[column].cast("string"), F.lit(""))


def join_hot(left: DataFrame, right: DataFrame, key: str, n_left: int, how: str = "left") -> DataFrame:
    """``left`` joined (left or inner) on ``key`` with ``right``, which has a key once, where a few keys may hold much of ``left``.

    Rows of hot keys meet their rows of ``right`` by a broadcast of those rows, at
    most MOST_HOT of them at any size; only the others are shuffled. Both tables are read
    more than once: pass staged ones. Null keys match nothing and aren't shuffled.
    """
    hot = left.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("__w_n")).filter(F.col("__w_n") > max(HOT_ROWS, n_left // MOST_HOT)).select(key)
    hot = Staged(hot, "hot-keys").df
    few = F.broadcast(right.join(F.broadcast(hot), key, "left_semi"))
    wide = left.join(F.broadcast(hot), key, "left_semi").join(few, key, how)
    rest = left.filter(F.col(key).isNotNull()).join(F.broadcast(hot), key, "left_anti").join(right.hint("merge"), key, how)  # the same plan at every size
    out = wide.unionByName(rest)
    return out if how == "inner" else out.unionByName(left.filter(F.col(key).isNull()), allowMissingColumns=True)

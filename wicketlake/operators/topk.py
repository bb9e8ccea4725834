"""Ordering and top-k helpers.

Every top-k breaks ties with a name column so the answer is deterministic.
``orderBy(...).limit(k)`` plans as ``TakeOrderedAndProject``: each task keeps
its own k best rows and only those reach the final merge, so no full sort of
the input happens.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def top_k(df: DataFrame, k: int, *order: Column | str) -> DataFrame:
    """Global top-k by the given sort keys (give a unique tiebreak last)."""
    return df.orderBy(*order).limit(k)


def top_k_per_group(df: DataFrame, k: int, group: list[str], *order: Column | str,
                    rank_col: str = "rank") -> DataFrame:
    """The k best rows of every group.

    ``row_number() <= k`` is planned with a partial ``WindowGroupLimit`` before
    the shuffle, so a hot group ships at most k rows per input partition.
    """
    w = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn(rank_col, F.row_number().over(w)).filter(F.col(rank_col) <= k)


def latest_n(df: DataFrame, n: int, key: str = "event_id") -> DataFrame:
    """The newest n rows by a monotone key."""
    return df.orderBy(F.col(key).desc()).limit(n)


def mixed_sort(df: DataFrame, keys: list[tuple[str, bool]]) -> DataFrame:
    """O3: sort by several keys, each ascending (True) or descending (False)."""
    return df.orderBy(*[F.col(c).asc_nulls_last() if asc else F.col(c).desc_nulls_last()
                        for c, asc in keys])

"""Set operations (U rows)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def union_distinct(a: DataFrame, b: DataFrame) -> DataFrame:
    """UNION (distinct)."""
    return a.union(b).distinct()


def clean_team_list(matches: DataFrame) -> DataFrame:
    """Both team columns, trimmed, non-blank, unique."""
    t = matches.select(F.explode(F.array(F.trim("team1"), F.trim("team2"))).alias("team_name"))
    return t.filter(F.col("team_name").isNotNull() & (F.col("team_name") != "")).distinct()


def distinct_of(df: DataFrame, *cols: str) -> DataFrame:
    """DISTINCT projection."""
    return df.select(*cols).distinct()


def all_but(df: DataFrame, column: str, excluded: DataFrame) -> DataFrame:
    """U4: set difference (rows of ``df`` whose value is not excluded)."""
    return df.select(column).exceptAll(excluded.select(column))

"""Predicates and projections (P rows). Every filter here is a Catalyst
predicate on plain columns, so it is pushed into the Parquet scan where the
column comes straight from a file."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wicketlake.functions import expressions as E


def equals(df: DataFrame, column: str, value) -> DataFrame:
    """Equality filter (the page-wide gender selector)."""
    return df.filter(F.col(column) == F.lit(value))


def optional_flag(df: DataFrame, column: str, enabled: bool) -> DataFrame:
    """Boolean filter applied only when asked."""
    return df.filter(F.col(column)) if enabled else df


def either_side(df: DataFrame, team: str, a: str = "team1", b: str = "team2") -> DataFrame:
    """The team on either side of a fixture."""
    return df.filter((F.col(a) == team) | (F.col(b) == team))


def fixture_between(df: DataFrame, x: str, y: str, a: str = "team1", b: str = "team2") -> DataFrame:
    """A v B or B v A."""
    return df.filter(((F.col(a) == x) & (F.col(b) == y)) | ((F.col(a) == y) & (F.col(b) == x)))


def member_of(df: DataFrame, column: str, values: list) -> DataFrame:
    """P5: membership in a literal list (an ``In`` predicate, pushed down)."""
    return df.filter(F.col(column).isin(values))


def over_ranges(d: DataFrame) -> DataFrame:
    """Balls in the over ranges the pages use, per batting team."""
    o = F.col("over_num")
    return d.groupBy("batting_team").agg(
        F.count_if(o <= 6).alias("overs_le_6"), F.count_if(o.between(7, 15)).alias("overs_7_15"),
        F.count_if(o >= 16).alias("overs_ge_16"), F.count_if(o >= 18).alias("overs_ge_18"))


def non_blank(df: DataFrame, column: str) -> DataFrame:
    """Reject null and blank strings."""
    return df.filter(F.col(column).isNotNull() & (F.trim(F.col(column)) != ""))


def players_of_country(spark: SparkSession, players: DataFrame, country: str, n: int = 15) -> DataFrame:
    """P8 + O4: a bound-parameter SQL query (no string formatting of values)."""
    return spark.sql(
        "SELECT player_name, role, runs, wickets, strike_rate FROM {p} "
        "WHERE country = :country ORDER BY runs DESC, player_name LIMIT :n",
        args={"country": country, "n": n}, p=players)


def with_constants(df: DataFrame, values: dict) -> DataFrame:
    """P10: constant columns."""
    return df.withColumns({k: F.lit(v) for k, v in values.items()})


def recode(column: Column, mapping: dict, default=None) -> Column:
    """Dictionary recode through a literal map (no join needed)."""
    m = F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])
    out = m[column]
    return out if default is None else F.coalesce(out, F.lit(default))


def player_pool(players: DataFrame, country: str | None = None) -> DataFrame:
    """The players of a country, or every player where no country is
    asked for; the caller decides, not the number of rows."""
    return players if country is None else players.filter(F.col("country") == country)


def fill_defaults(df: DataFrame, defaults: dict) -> DataFrame:
    """Per-column null defaults."""
    return df.na.fill(defaults)


def add_with_default(df: DataFrame, column: str, default, dtype: str = "string") -> DataFrame:
    """Add a column with a default (or back-fill its nulls)."""
    if column in df.columns:
        return df.withColumn(column, F.coalesce(F.col(column), F.lit(default).cast(dtype)))
    return df.withColumn(column, F.lit(default).cast(dtype))

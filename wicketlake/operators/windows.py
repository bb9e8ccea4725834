"""Window operators (W rows). Ball-level windows are partitioned by match
and innings, whose size the game bounds; team-level windows run on
aggregated frames with one row per team."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def pressure_balls(d: DataFrame, lookback: int = 6) -> DataFrame:
    """W3 (+ D3): a ball is under pressure when a wicket fell in the previous
    ``lookback`` balls of the innings (a row frame, null on the first ball)."""
    w = Window.partitionBy("match_id", "inning").orderBy("seq").rowsBetween(-lookback, -1)
    recent = F.coalesce(F.sum(F.col("is_wicket").cast("int")).over(w), F.lit(0))
    return d.withColumn("under_pressure", recent > 0)


def pressure_strike_rates(d: DataFrame, min_balls: int = 10) -> DataFrame:
    """Strike rate under pressure per batter, at least ``min_balls``."""
    p = pressure_balls(d).filter("under_pressure")
    g = p.groupBy("batsman").agg(F.sum("batsman_runs").alias("runs"), F.count("*").alias("balls"))
    return g.filter(F.col("balls") >= min_balls).withColumn("pressure_sr", F.col("runs") / F.col("balls") * 100)


def hat_tricks(d: DataFrame) -> DataFrame:
    """Three consecutive dismissals of an innings credited to one bowler;
    the first occurrence per (match, inning, bowler)."""
    wk = d.filter("is_wicket").select("match_id", "inning", "seq", "bowler", "over_num", "ball_num")
    w = Window.partitionBy("match_id", "inning").orderBy("seq")
    seq3 = wk.withColumns({"b1": F.lead("bowler", 1).over(w), "b2": F.lead("bowler", 2).over(w)})
    hits = seq3.filter((F.col("bowler") == F.col("b1")) & (F.col("bowler") == F.col("b2")))
    first = Window.partitionBy("match_id", "inning", "bowler").orderBy("seq")
    return (hits.withColumn("_rn", F.row_number().over(first)).filter("_rn = 1")
            .select("match_id", "inning", "bowler", "over_num", "ball_num",
                    F.concat_ws(" ", F.lit("Hat-trick:"), "bowler", F.lit("in"), "match_id").alias("alert")))


def running_score(live: DataFrame, block: int = 10_000) -> DataFrame:
    """W5 + F17: cumulative runs per live match in event order.

    A few live matches hold all events, so a window per match would be a few
    tasks. Event ids are cut into blocks: runs are summed per match and block
    (a partial aggregate), the sums of earlier blocks are added up (one row
    per block), and the running sum inside a block is shifted by them."""
    runs = F.col("runs_scored") + F.col("extras")
    cut = live.withColumn("_block", F.floor(F.col("event_id") / block))
    sums = cut.groupBy("match_id", "_block").agg(F.sum(runs).alias("_runs"))
    earlier = Window.partitionBy("match_id").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    shift = sums.select("match_id", "_block", F.coalesce(F.sum("_runs").over(earlier), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("match_id", "_block").orderBy("event_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    summed = cut.withColumn("_inside", F.sum(runs).over(inside)).join(shift, ["match_id", "_block"])
    return summed.withColumn("cum_runs", F.col("_before") + F.col("_inside")).select(*live.columns, "cum_runs")


def pandas_pct_rank(df: DataFrame, column: str, name: str = "pct_rank") -> DataFrame:
    """``rank(pct=True)`` (average rank of ties / n), on a small frame
    (one row per team): rank + (ties - 1) / 2, over the row count."""
    order = Window.orderBy(column)
    ties = Window.partitionBy(column)
    everything = Window.partitionBy()
    avg_rank = F.rank().over(order) + (F.count("*").over(ties) - 1) / 2
    return df.withColumn(name, avg_rank / F.count("*").over(everything))


def table_position(points: DataFrame) -> DataFrame:
    """Position in the points table (one row per team)."""
    w = Window.orderBy(F.col("points").desc(), F.col("nrr").desc(), F.col("team"))
    return points.withColumn("position", F.row_number().over(w))

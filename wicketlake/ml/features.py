"""Feature matrices (M1, M2, M13, M16) as DataFrame jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wicketlake.operators import aggregates as A

# Feature names of the match and player models, in the order of
# the output schema, and the columns that players are clustered on.
MATCH_FEATURES = ["run_rate_diff", "six_rate_diff", "four_rate_diff", "pp_run_rate_diff", "death_run_rate_diff",
                  "wicket_rate_diff", "death_wkt_rate_diff", "economy_diff", "win_rate_t1", "win_rate_t2",
                  "win_rate_diff", "toss_team1", "toss_bat_first", "toss_advantage", "is_knockout"]
PLAYER_FEATURES = ["total_runs", "balls_faced", "strike_rate_live", "sixes", "fours", "wickets", "economy_live"]
CLUSTER_FEATURES = ["total_runs", "strike_rate_live", "sixes", "wickets", "economy_live"]


def match_features(ts: DataFrame, cm: DataFrame) -> DataFrame:
    """M1 (J8): every match meets the stats of its two teams (two inner
    joins on ``ts``, the one-row-per-team table of A7);
    15 features and the target (team1 won)."""
    cols = ["avg_runs_per_ball", "six_rate", "four_rate", "pp_run_rate", "death_run_rate",
            "avg_wickets_per_ball", "death_wicket_rate", "avg_economy", "win_rate"]
    t1 = ts.select(F.col("team").alias("team1"), *[F.col(c).alias(f"{c}_1") for c in cols])
    t2 = ts.select(F.col("team").alias("team2"), *[F.col(c).alias(f"{c}_2") for c in cols])
    m = cm.join(t1, "team1").join(t2, "team2")

    def diff(c: str):
        return F.col(f"{c}_1") - F.col(f"{c}_2")

    toss1 = (F.col("toss_winner") == F.col("team1")).cast("int")
    bat = (F.col("toss_decision") == "bat").cast("int")
    out = m.select(
        "match_id", "team1", "team2",
        diff("avg_runs_per_ball").alias("run_rate_diff"), diff("six_rate").alias("six_rate_diff"),
        diff("four_rate").alias("four_rate_diff"), diff("pp_run_rate").alias("pp_run_rate_diff"),
        diff("death_run_rate").alias("death_run_rate_diff"), diff("avg_wickets_per_ball").alias("wicket_rate_diff"),
        diff("death_wicket_rate").alias("death_wkt_rate_diff"), diff("avg_economy").alias("economy_diff"),
        F.col("win_rate_1").alias("win_rate_t1"), F.col("win_rate_2").alias("win_rate_t2"),
        diff("win_rate").alias("win_rate_diff"),
        toss1.alias("toss_team1"), bat.alias("toss_bat_first"), (toss1 * bat).alias("toss_advantage"),
        F.col("tournament_phase").isin("Semi Final", "Final").cast("int").alias("is_knockout"),
        (F.col("winner") == F.col("team1")).cast("int").alias("target"))
    return out.na.fill(0)


def player_features(d: DataFrame) -> DataFrame:
    """M2 (A8 + J6): batting and bowling careers joined on the name."""
    b = A.career_batting(d)
    w = A.career_bowling(d)
    j = b.join(w, b.batsman == w.bowler, "full")
    out = j.select(F.coalesce("batsman", "bowler").alias("player_name"), *PLAYER_FEATURES)
    return out.na.fill(0)


# Basket item names.
def baskets(cm: DataFrame) -> DataFrame:
    """Every match as a basket of five items."""
    items = F.array(
        F.when(F.col("toss_winner") == F.col("winner"), "toss_won").otherwise("toss_lost"),
        F.when(F.col("toss_decision") == "bat", "chose_bat").otherwise("chose_bowl"),
        F.when(F.col("tournament_phase").isin("Semi Final", "Final"), "knockout_match").otherwise("group_match"),
        F.when(F.coalesce(F.col("is_day_night"), F.lit(False)), "day_night").otherwise("day_match"),
        F.when(F.col("winner") == F.col("team1"), "team1_won").otherwise("team2_won"))
    return cm.select("match_id", items.alias("items"))


def upset_labels(features: DataFrame, gap: float = 0.05) -> DataFrame:
    """team1 was the favourite by more than ``gap`` and lost."""
    return features.withColumn("is_upset", ((F.col("win_rate_diff") > gap) & (F.col("target") == 0)).cast("int"))

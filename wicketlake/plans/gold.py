"""Gold star schema (B5 to B9): dimensions and the per-match player fact.

Dimension sizes are bounded by the domain, not by the ball count: teams and
venues are a few dozen, dates at most one row per calendar day; the player
dimension grows with the data. No join is hinted: AQE broadcasts a side only
when its runtime size is under ``spark.sql.autoBroadcastJoinThreshold``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wicketlake.functions import expressions as E
from wicketlake.operators.keys import dense_index, keep_first
from wicketlake.operators.setops import clean_team_list


def dim_team(clean_matches: DataFrame) -> DataFrame:
    """One row per team name (U2), ids in name order (W1), constants."""
    teams = dense_index(clean_team_list(clean_matches), ["team_name"], "team_id")
    return teams.select(
        "team_id", "team_name", F.col("team_id").cast("int").alias("icc_ranking"),
        F.lit(0.0).alias("icc_rating"), F.lit("TBD").alias("captain"), F.lit("TBD").alias("coach"),
        F.col("team_name").alias("home_country"))


def dim_venue(venues: DataFrame) -> DataFrame:
    """Venues with ids in name order and constant attributes."""
    v = dense_index(venues, ["stadium_name"], "venue_id")
    return v.select("venue_id", "stadium_name", "city", "country", "pitch_type",
                    F.lit(160.0).alias("avg_first_innings"), F.lit(50000).alias("capacity"),
                    F.lit(True).alias("is_day_night"))


def dim_player(players: DataFrame) -> DataFrame:
    """Player dimension with constant style attributes."""
    return players.select("player_id", "player_name", "country", "role",
                          F.lit("Right-hand bat").alias("batting_style"), F.lit("Unknown").alias("bowling_style"),
                          F.lit(0).alias("age"), F.lit(True).alias("is_active"))


def dim_date(clean_matches: DataFrame) -> DataFrame:
    """Distinct dates (U3, F6), parts (F7), one phase per date (W12: the
    alphabetically first, trap 14), ids in date order (W1)."""
    d = (clean_matches.select("match_date", "tournament_phase").distinct()
         .filter(F.col("match_date").isNotNull()))
    d = keep_first(d, ["match_date"], "tournament_phase")
    d = d.withColumns(E.date_parts("match_date")).withColumns({
        "is_knockout": F.col("tournament_phase").isin("Semi Final", "Final"),
        "is_final": F.col("tournament_phase") == "Final",
    })
    d = dense_index(d, ["match_date"], "date_id")
    return d.select("date_id", "match_date", "year", "month", "month_name", "day_of_week",
                    "tournament_phase", "is_knockout", "is_final")


def dim_match(clean_matches: DataFrame, teams: DataFrame) -> DataFrame:
    """Toss winner id through the team dimension (J3), result type and
    margin (P15)."""
    t = teams.select(F.col("team_name").alias("toss_winner"), F.col("team_id").alias("toss_winner_id"))
    return clean_matches.join(t, "toss_winner", "left").select(
        "match_id", "toss_winner_id", "toss_decision", F.lit("Clear").alias("weather_condition"), "is_day_night",
        E.result_type("win_by_runs").alias("result_type"),
        E.result_margin("win_by_runs", "win_by_wickets").alias("result_margin"))


def performance_fact(cards: DataFrame, clean_matches: DataFrame, players: DataFrame,
                     teams: DataFrame, venues: DataFrame, dates: DataFrame) -> DataFrame:
    """One row per (match, player): the match card (A1, A2, J2), the team
    from whichever side has it (trap 6), dimension keys by lookup joins (J3),
    venue default 1 and rows without player or team dropped (J4), match
    attributes (J5), opponent and result (P16), strike rate, player of the
    match (F16)."""
    overs = F.when(F.col("balls_bowled") > 0, F.col("balls_bowled") / 6)
    fact = cards.withColumns({"team_name": F.coalesce("bat_team", "bowl_team"), "overs_bowled": overs,
                              "economy_rate": F.col("runs_conceded") / overs})
    pk = players.select(E.norm_key("player_name").alias("_pk"), "player_id")
    tk = teams.select(F.col("team_name"), "team_id")
    ok = teams.select(F.col("team_name").alias("opponent_team_name"), F.col("team_id").alias("opponent_team_id"))
    vk = venues.select(F.col("stadium_name").alias("venue"), "venue_id")
    dk = dates.select("match_date", "date_id")
    m = clean_matches.select("match_id", "team1", "team2", "winner", "venue", "match_date", "player_of_match")
    fact = (fact.withColumn("_pk", E.norm_key("player_name"))
            .join(pk, "_pk", "left")
            .join(tk, "team_name", "left")
            .join(m, "match_id", "left")
            .join(dk, "match_date", "left")
            .join(vk, "venue", "left")
            .withColumn("opponent_team_name", E.opponent("team_name", "team1", "team2"))
            .join(ok, "opponent_team_name", "left"))
    runs = F.coalesce("runs_scored", F.lit(0))
    balls = F.coalesce("balls_faced", F.lit(0))
    return fact.filter(F.col("player_id").isNotNull() & F.col("team_id").isNotNull()).select(
        "match_id", "player_id", "team_id", "opponent_team_id",
        F.coalesce("venue_id", F.lit(1)).alias("venue_id"), "date_id",
        runs.alias("runs_scored"), balls.alias("balls_faced"),
        F.when(balls > 0, runs / balls * 100).otherwise(F.lit(0.0)).alias("strike_rate"),
        F.coalesce("fours", F.lit(0)).alias("fours"), F.coalesce("sixes", F.lit(0)).alias("sixes"),
        F.coalesce("wickets_taken", F.lit(0)).alias("wickets_taken"),
        F.coalesce("overs_bowled", F.lit(0.0)).alias("overs_bowled"),
        F.coalesce("runs_conceded", F.lit(0)).alias("runs_conceded"),
        F.coalesce("economy_rate", F.lit(0.0)).alias("economy_rate"),
        F.lit(0).alias("catches"),
        E.win_loss("team_name", "winner").alias("match_result"),
        (E.norm_key("player_name") == E.norm_key("player_of_match")).alias("is_player_of_match"))


def fact_match_performance(t) -> DataFrame:
    """The whole gold build from the adapter views (flagship query)."""
    cm = t.clean_matches
    teams = dim_team(cm)
    return performance_fact(t.cards, cm, t.players, teams, dim_venue(t.venues), dim_date(cm))

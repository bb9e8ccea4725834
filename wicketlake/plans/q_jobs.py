"""Registered layer jobs (B rows): silver and gold tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from wicketlake.plans import gold, silver
from wicketlake.plans.oracle import FACT
from wicketlake.plans.registry import query
from wicketlake.session import scratch_path
from wicketlake.sources import raw


@query("b1_matches_job", "SELECT * FROM clean_matches")
def _b1(t):
    return t.clean_matches


@query("b2_deliveries_job", """
SELECT DISTINCT match_id, inning, over_num, ball_num, batting_team, bowling_team, batsman, non_striker, bowler,
  batsman_runs, extra_runs, total_runs, is_wicket, dismissal_kind,
  player_dismissed
FROM deliveries""")
def _b2(t):
    # Round trip through raw ball files derived from the driver tables, so the
    # job parses text exactly as it would from source files.
    path = scratch_path(t.spark, "ball-files")
    raw.write_ball_files(t.deliveries, path)
    balls = raw.read_ball_files(t.spark, path, key_pattern=None)
    return silver.transform_deliveries(balls)


@query("b3_players_job", "SELECT * FROM players")
def _b3(t):
    return t.players


@query("b4_venues_job", "SELECT stadium_name, city, country, pitch_type FROM venues")
def _b4(t):
    return silver.transform_venues(t.venues)


@query("b5_dim_team", "SELECT * FROM dim_team")
def _b5(t):
    return gold.dim_team(t.clean_matches)


@query("b6_dim_venue", "SELECT * FROM dim_venue")
def _b6(t):
    return gold.dim_venue(t.venues)


@query("b6_dim_player", """
SELECT player_id, player_name, country, role, 'Right-hand bat' AS batting_style, 'Unknown' AS bowling_style,
  0 AS age, true AS is_active FROM players""")
def _b6b(t):
    return gold.dim_player(t.players)


@query("b7_dim_date", "SELECT * FROM dim_date")
def _b7(t):
    return gold.dim_date(t.clean_matches)


@query("b8_dim_match", """
SELECT m.match_id, t.team_id AS toss_winner_id, toss_decision, 'Clear' AS weather_condition, is_day_night,
  CASE WHEN coalesce(win_by_runs, 0) > 0 THEN 'runs' ELSE 'wickets' END AS result_type,
  CASE WHEN coalesce(win_by_runs, 0) > 0 THEN coalesce(win_by_runs, 0) ELSE coalesce(win_by_wickets, 0) END AS result_margin
FROM clean_matches m LEFT JOIN dim_team t ON t.team_name = m.toss_winner""")
def _b8(t):
    return gold.dim_match(t.clean_matches, gold.dim_team(t.clean_matches))


@query("b9_fact_match_performance", FACT)
def _b9(t):
    return gold.fact_match_performance(t)


@query("b10_activity_migration", """
SELECT player_name, gender, last_played_date, is_active FROM players""")
def _b10(t):
    return t.players.select("player_name", "gender", "last_played_date", "is_active")

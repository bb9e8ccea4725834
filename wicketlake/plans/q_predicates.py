"""Registered predicate / projection queries (P rows)."""

from __future__ import annotations

from pyspark.sql import functions as F

from wicketlake.functions import expressions as E
from wicketlake.operators import filters as P
from wicketlake.operators.selection import POSITION_LABELS
from wicketlake.plans.registry import query

# Fixed values used as the page selections in the registered queries.
TEAM = "NATION_3"
OPPONENT = "NATION_4"


@query("p1_gender_filter", "SELECT * FROM clean_matches WHERE gender = 'female'")
def _p1(t):
    return P.equals(t.clean_matches, "gender", "female")


@query("p2_active_players", "SELECT player_name, country FROM players WHERE is_active")
def _p2(t):
    return P.optional_flag(t.players, "is_active", True).select("player_name", "country")


@query("p3_team_either_side", f"SELECT * FROM clean_matches WHERE team1 = '{TEAM}' OR team2 = '{TEAM}'")
def _p3(t):
    return P.either_side(t.clean_matches, TEAM)


@query("p4_fixture_between", f"""
SELECT * FROM clean_matches WHERE (team1 = '{TEAM}' AND team2 = '{OPPONENT}') OR (team1 = '{OPPONENT}' AND team2 = '{TEAM}')""")
def _p4(t):
    return P.fixture_between(t.clean_matches, TEAM, OPPONENT)


@query("p5_membership", """
SELECT match_id, seq, batsman, dismissal_kind FROM deliveries WHERE dismissal_kind IN ('caught', 'bowled')""")
def _p5(t):
    return P.member_of(t.deliveries, "dismissal_kind", ["caught", "bowled"]).select("match_id", "seq", "batsman", "dismissal_kind")


@query("p6_over_ranges", """
SELECT batting_team, count_if(over_num <= 6) AS overs_le_6, count_if(over_num BETWEEN 7 AND 15) AS overs_7_15,
  count_if(over_num >= 16) AS overs_ge_16, count_if(over_num >= 18) AS overs_ge_18 FROM deliveries GROUP BY 1""")
def _p6(t):
    return P.over_ranges(t.deliveries)


@query("p7_non_blank", """
SELECT match_id, seq, player_dismissed FROM deliveries WHERE player_dismissed IS NOT NULL AND trim(player_dismissed) <> ''""")
def _p7(t):
    return P.non_blank(t.deliveries, "player_dismissed").select("match_id", "seq", "player_dismissed")


@query("p8_bound_parameter", f"""
SELECT player_name, role, runs, wickets, strike_rate FROM players WHERE country = '{TEAM}'
ORDER BY runs DESC, player_name LIMIT 15""")
def _p8(t):
    return P.players_of_country(t.spark, t.players, TEAM)


@query("p9_column_pruning", "SELECT match_id, batsman, batsman_runs FROM deliveries")
def _p9(t):
    return t.deliveries.select("match_id", "batsman", "batsman_runs")


@query("p10_constant_columns", """
SELECT match_id, 'Unknown' AS player_of_match, false AS is_day_night, 'Clear' AS weather_condition FROM matches""")
def _p10(t):
    return P.with_constants(t.matches.select("match_id"),
                            {"player_of_match": "Unknown", "is_day_night": False, "weather_condition": "Clear"})


@query("p11_phase_bucket", """
SELECT match_id, seq, over_num,
  CASE WHEN over_num <= 6 THEN 'Powerplay' WHEN over_num <= 15 THEN 'Middle' ELSE 'Death' END AS phase FROM deliveries""")
def _p11(t):
    return t.deliveries.select("match_id", "seq", "over_num", E.phase_of_over("over_num").alias("phase"))


@query("p12_tournament_phase", "SELECT match_id, stage, tournament_phase FROM (SELECT m.match_id, m.stage, c.tournament_phase FROM matches m JOIN clean_matches c ON m.match_id = c.match_id) x")
def _p12(t):
    return t.matches.select("match_id", "stage", E.tournament_phase("stage").alias("tournament_phase"))


@query("p13_wicket_flag", """
SELECT match_id, seq, coalesce(trim(coalesce(player_dismissed, '')) <> '' OR lower(coalesce(dismissal_kind, 'not_out')) <> 'not_out', false) AS is_wicket
FROM deliveries""")
def _p13(t):
    return t.deliveries.select("match_id", "seq", E.wicket_flag("player_dismissed", "dismissal_kind").alias("is_wicket"))


@query("p14_role_inference", """
SELECT player_name, CASE WHEN wickets > 10 AND runs > 100 THEN 'All-Rounder' WHEN wickets > 5 THEN 'Bowler'
  WHEN runs > 100 THEN 'Batter' ELSE 'Unknown' END AS role FROM players""")
def _p14(t):
    return t.players.select("player_name", E.infer_role("wickets", "runs").alias("role"))


@query("p15_result_type", """
SELECT match_id, CASE WHEN coalesce(win_by_runs, 0) > 0 THEN 'runs' ELSE 'wickets' END AS result_type,
  CASE WHEN coalesce(win_by_runs, 0) > 0 THEN coalesce(win_by_runs, 0) ELSE coalesce(win_by_wickets, 0) END AS result_margin
FROM clean_matches""")
def _p15(t):
    cm = t.clean_matches
    return cm.select("match_id", E.result_type("win_by_runs").alias("result_type"),
                     E.result_margin("win_by_runs", "win_by_wickets").alias("result_margin"))


@query("p16_opponent_and_result", """
SELECT match_id, team, CASE WHEN team = team1 THEN team2 ELSE team1 END AS opponent,
  CASE WHEN team = winner THEN 'W' ELSE 'L' END AS match_result
FROM (SELECT team1 AS team, * FROM clean_matches UNION ALL SELECT team2 AS team, * FROM clean_matches) x""")
def _p16(t):
    from wicketlake.operators.aggregates import teams_long
    long = teams_long(t.clean_matches)
    return long.select("match_id", "team", E.opponent("team", "team1", "team2").alias("opponent"),
                       E.win_loss("team", "winner").alias("match_result"))


@query("p17_clip", """
SELECT batting_team, greatest(0, least(100, avg(total_runs) * 20)) AS clipped FROM deliveries GROUP BY 1""")
def _p17(t):
    g = t.deliveries.groupBy("batting_team").agg(F.avg("total_runs").alias("a"))
    return g.select("batting_team", E.clip(F.col("a") * 20, 0, 100).alias("clipped"))


@query("p18_recode", """
SELECT match_id, inning, batsman, batting_position,
  CASE batting_position WHEN 1 THEN 'Opener' WHEN 2 THEN 'Opener' WHEN 3 THEN 'No.3' WHEN 4 THEN 'Middle Order'
    WHEN 5 THEN 'Middle Order' WHEN 6 THEN 'Finisher' WHEN 7 THEN 'Finisher' WHEN 8 THEN 'All-Rounder'
    WHEN 9 THEN 'All-Rounder' WHEN 10 THEN 'Tail' WHEN 11 THEN 'Tail' END AS role_in_order
FROM (SELECT *, row_number() OVER (PARTITION BY match_id, inning ORDER BY first_over, first_ball, batsman) AS batting_position
      FROM (SELECT match_id, inning, batsman, min(over_num) AS first_over, min(ball_num) AS first_ball FROM deliveries GROUP BY 1, 2, 3) a) b""")
def _p18(t):
    from wicketlake.operators.aggregates import batting_positions
    pos = batting_positions(t.deliveries)
    return pos.select("match_id", "inning", "batsman", "batting_position",
                      P.recode(F.col("batting_position"), POSITION_LABELS).alias("role_in_order"))


@query("p20_event_badge", """
SELECT event_id, CASE WHEN is_wicket THEN 'WICKET' WHEN runs_scored = 6 THEN 'SIX' WHEN runs_scored = 4 THEN 'FOUR'
  ELSE concat(CAST(runs_scored AS VARCHAR), ' run(s)') END AS badge FROM live""")
def _p20(t):
    return t.live.select("event_id", E.event_badge("is_wicket", "runs_scored").alias("badge"))


@query("p21_dot_ball_rate", """
SELECT bowling_team, avg(CAST(batsman_runs = 0 AND extra_runs = 0 AS INT)) * 100 AS dot_rate FROM deliveries GROUP BY 1""")
def _p21(t):
    return t.deliveries.groupBy("bowling_team").agg(
        (F.avg(E.is_dot("batsman_runs", "extra_runs").cast("int")) * 100).alias("dot_rate"))


@query("p22_player_pool", f"""
SELECT 'country' AS pool, player_name, country FROM players WHERE country = '{TEAM}'
UNION ALL SELECT 'all' AS pool, player_name, country FROM players""")
def _p22(t):
    own = P.player_pool(t.players, TEAM).select(F.lit("country").alias("pool"), "player_name", "country")
    return own.unionByName(P.player_pool(t.players).select(F.lit("all").alias("pool"), "player_name", "country"))


@query("p23_null_fill", """
SELECT o_orderkey, coalesce(price_text, '0') AS price_text, coalesce(cust_text, 'Unknown') AS cust_text,
  coalesce(date_text, '') AS date_text, coalesce(priority_text, 'bat') AS priority_text FROM dirty_orders""")
def _p23(t):
    return P.fill_defaults(t.dirty_orders, {"price_text": "0", "cust_text": "Unknown", "date_text": "",
                                            "priority_text": "bat"})


@query("p24_add_column_default", "SELECT match_id, coalesce(gender, 'male') AS gender, 'Clear' AS weather FROM matches")
def _p24(t):
    df = P.add_with_default(t.matches.select("match_id", "gender"), "gender", "male")
    return P.add_with_default(df, "weather", "Clear")

"""Registered join queries (J rows)."""

from __future__ import annotations

from pyspark.sql import functions as F

from wicketlake.functions import expressions as E
from wicketlake.operators import aggregates as A
from wicketlake.operators.keys import keep_first
from wicketlake.plans import gold
from wicketlake.plans.registry import query


@query("j1_left_join_dedup_right", """
WITH squads AS (SELECT DISTINCT batting_team AS team, batsman AS player_name FROM deliveries),
first_card AS (SELECT player_name, runs_scored FROM (
    SELECT batsman AS player_name, match_id, CAST(sum(batsman_runs) AS BIGINT) AS runs_scored,
      row_number() OVER (PARTITION BY batsman ORDER BY match_id) AS rn FROM deliveries GROUP BY batsman, match_id) c WHERE rn = 1)
SELECT squads.team, squads.player_name, first_card.runs_scored FROM squads LEFT JOIN first_card ON squads.player_name = first_card.player_name""")
def _j1(t):
    d = t.deliveries
    squads = d.select(F.col("batting_team").alias("team"), F.col("batsman").alias("player_name")).distinct()
    cards = A.batting_cards(d).select("player_name", "match_id", "runs_scored")
    first = keep_first(cards, ["player_name"], "match_id").drop("match_id")
    return squads.join(first, "player_name", "left").select("team", "player_name", "runs_scored")


@query("j2_full_outer_batting_bowling", """
WITH bat AS (SELECT match_id, batsman AS player_name, CAST(sum(batsman_runs) AS BIGINT) AS runs_scored FROM deliveries GROUP BY 1, 2),
bowl AS (SELECT match_id, bowler AS player_name, count_if(is_wicket) AS wickets_taken FROM deliveries GROUP BY 1, 2)
SELECT coalesce(bat.match_id, bowl.match_id) AS match_id, coalesce(bat.player_name, bowl.player_name) AS player_name,
  runs_scored, wickets_taken FROM bat FULL JOIN bowl ON bat.match_id = bowl.match_id AND bat.player_name = bowl.player_name""")
def _j2(t):
    bat = A.batting_cards(t.deliveries).select("match_id", "player_name", "runs_scored")
    bowl = A.bowling_cards(t.deliveries).select("match_id", "player_name", "wickets_taken")
    return bat.join(bowl, ["match_id", "player_name"], "full")


@query("j3_lookup_team_ids", """
SELECT m.match_id, a.team_id AS team1_id, b.team_id AS team2_id FROM clean_matches m
LEFT JOIN dim_team a ON a.team_name = m.team1 LEFT JOIN dim_team b ON b.team_name = m.team2""")
def _j3(t):
    teams = gold.dim_team(t.clean_matches)
    a = teams.select(F.col("team_name").alias("team1"), F.col("team_id").alias("team1_id"))
    b = teams.select(F.col("team_name").alias("team2"), F.col("team_id").alias("team2_id"))
    return t.clean_matches.join(a, "team1", "left").join(b, "team2", "left").select("match_id", "team1_id", "team2_id")


@query("j4_unmatched_key_policy", """
SELECT m.match_id, coalesce(v.venue_id, 1) AS venue_id FROM clean_matches m
LEFT JOIN dim_venue v ON v.stadium_name = m.venue WHERE m.team1 IS NOT NULL AND m.team2 IS NOT NULL""")
def _j4(t):
    v = gold.dim_venue(t.venues).select(F.col("stadium_name").alias("venue"), "venue_id")
    out = t.clean_matches.join(v, "venue", "left").na.drop(subset=["team1", "team2"])
    return out.select("match_id", F.coalesce("venue_id", F.lit(1)).alias("venue_id"))


@query("j5_fact_to_match", """
SELECT c.match_id, c.player_name, c.runs_scored, m.venue, m.match_date FROM
  (SELECT match_id, batsman AS player_name, CAST(sum(batsman_runs) AS BIGINT) AS runs_scored FROM deliveries GROUP BY 1, 2) c
LEFT JOIN clean_matches m ON c.match_id = m.match_id""")
def _j5(t):
    cards = A.batting_cards(t.deliveries).select("match_id", "player_name", "runs_scored")
    return cards.join(t.clean_matches.select("match_id", "venue", "match_date"), "match_id", "left")


@query("j6_full_outer_renamed_keys", """
WITH b AS (SELECT batsman, CAST(sum(batsman_runs) AS BIGINT) AS total_runs FROM deliveries GROUP BY 1),
w AS (SELECT bowler, count_if(is_wicket) AS wickets FROM deliveries GROUP BY 1)
SELECT coalesce(b.batsman, w.bowler) AS player_name, coalesce(total_runs, 0) AS total_runs, coalesce(wickets, 0) AS wickets
FROM b FULL JOIN w ON b.batsman = w.bowler""")
def _j6(t):
    b = A.career_batting(t.deliveries).select("batsman", "total_runs")
    w = A.career_bowling(t.deliveries).select("bowler", "wickets")
    j = b.join(w, b.batsman == w.bowler, "full")
    return j.select(F.coalesce("batsman", "bowler").alias("player_name"),
                    F.coalesce("total_runs", F.lit(0)).alias("total_runs"), F.coalesce("wickets", F.lit(0)).alias("wickets"))


@query("j7_team_feature_chain", """
WITH bat AS (SELECT batting_team AS team, avg(batsman_runs) AS avg_runs_per_ball FROM deliveries GROUP BY 1),
bowl AS (SELECT bowling_team AS team, avg(total_runs) AS avg_economy FROM deliveries GROUP BY 1),
wins AS (SELECT winner AS team, count(*) AS total_wins FROM clean_matches GROUP BY 1)
SELECT coalesce(bat.team, bowl.team) AS team, avg_runs_per_ball, avg_economy, total_wins
FROM bat FULL JOIN bowl ON bat.team = bowl.team LEFT JOIN wins ON wins.team = coalesce(bat.team, bowl.team)""")
def _j7(t):
    bat = A.team_batting(t.deliveries).select("team", "avg_runs_per_ball")
    bowl = A.team_bowling(t.deliveries).select("team", "avg_economy")
    wins = t.clean_matches.groupBy(F.col("winner").alias("team")).agg(F.count("*").alias("total_wins"))
    return bat.join(bowl, "team", "full").join(wins, "team", "left")


@query("j9_semi_join_recent", """
WITH recent AS (SELECT team, match_id FROM (
    SELECT team, match_id, row_number() OVER (PARTITION BY team ORDER BY match_date DESC NULLS LAST, match_id DESC) AS rn
    FROM (SELECT match_id, match_date, team1 AS team FROM clean_matches UNION ALL SELECT match_id, match_date, team2 FROM clean_matches) x) y
  WHERE rn <= 5)
SELECT batting_team, count(*) AS balls FROM deliveries d
WHERE EXISTS (SELECT 1 FROM recent r WHERE r.team = d.batting_team AND r.match_id = d.match_id) GROUP BY 1""")
def _j9(t):
    rec = A.recent_batting(t.deliveries, A.recent_matches(t.clean_matches))
    return rec.groupBy("batting_team").agg(F.count("*").alias("balls"))


@query("j10_anti_join_not_chosen", """
WITH chosen AS (SELECT player_id FROM (SELECT player_id, row_number() OVER (PARTITION BY country ORDER BY runs DESC, player_id) AS rn
  FROM players) x WHERE rn <= 5)
SELECT player_id, player_name, country FROM players WHERE player_id NOT IN (SELECT player_id FROM chosen)""")
def _j10(t):
    from wicketlake.operators import topk
    chosen = topk.top_k_per_group(t.players, 5, ["country"], F.col("runs").desc(), "player_id").select("player_id")
    return t.players.join(chosen, "player_id", "left_anti").select("player_id", "player_name", "country")


@query("j11_containment_join", """
SELECT v.stadium_name, count(m.match_id) AS matches FROM venues v
LEFT JOIN clean_matches m ON contains(m.venue, v.stadium_name) GROUP BY 1""")
def _j11(t):
    from wicketlake.retrieval.documents import venue_match_counts
    return venue_match_counts(t.venues, t.clean_matches).select("stadium_name", "matches")


@query("j12_update_from_join", """
WITH last AS (SELECT a.player_name, max(m.match_date) AS lp FROM
  (SELECT match_id, batsman AS player_name FROM deliveries UNION SELECT match_id, bowler FROM deliveries) a
  JOIN clean_matches m ON a.match_id = m.match_id GROUP BY 1)
SELECT p.player_name, coalesce(last.lp, p.last_played_date) AS last_played_date FROM players p LEFT JOIN last ON p.player_name = last.player_name""")
def _j12(t):
    d = t.deliveries
    app = (d.select("match_id", F.col("batsman").alias("player_name"))
           .union(d.select("match_id", F.col("bowler").alias("player_name"))).distinct())
    last = (app.join(t.clean_matches.select("match_id", "match_date"), "match_id")
            .groupBy("player_name").agg(F.max("match_date").alias("lp")))
    out = t.players.select("player_name", "last_played_date").join(last, "player_name", "left")
    return out.select("player_name", F.coalesce("lp", "last_played_date").alias("last_played_date"))


@query("j13_aligned_aggregates", """
WITH r AS (SELECT batsman AS player, CAST(sum(batsman_runs) AS BIGINT) AS runs FROM deliveries GROUP BY 1),
w AS (SELECT bowler AS player, count_if(is_wicket) AS wickets FROM deliveries GROUP BY 1)
SELECT coalesce(r.player, w.player) AS player, coalesce(runs, 0) AS runs, coalesce(wickets, 0) AS wickets
FROM r FULL JOIN w ON r.player = w.player""")
def _j13(t):
    d = t.deliveries
    r = d.groupBy(F.col("batsman").alias("player")).agg(F.sum("batsman_runs").alias("runs"))
    w = d.groupBy(F.col("bowler").alias("player")).agg(F.count_if("is_wicket").alias("wickets"))
    return r.join(w, "player", "full").na.fill({"runs": 0, "wickets": 0})


@query("j15_innings_totals_to_venue", """
SELECT i.match_id, i.batting_team, i.innings_total, m.venue FROM
  (SELECT match_id, batting_team, CAST(sum(total_runs) AS BIGINT) AS innings_total FROM deliveries WHERE inning = 1 GROUP BY 1, 2) i
LEFT JOIN clean_matches m ON i.match_id = m.match_id""")
def _j15(t):
    inn = (t.deliveries.filter(F.col("inning") == 1).groupBy("match_id", "batting_team")
           .agg(F.sum("total_runs").alias("innings_total")))
    return inn.join(t.clean_matches.select("match_id", "venue"), "match_id", "left")

"""Registered aggregation queries (A rows) with their DuckDB oracles.

Oracle text is written independently in SQL; integer sums are cast to
BIGINT (DuckDB widens them to HUGEINT), and floating results keep the same
operation order as the Spark expression so both engines round alike.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from wicketlake.operators import aggregates as A
from wicketlake.plans.registry import query
from wicketlake.plans import silver


@query("a1_batting_cards", """
SELECT match_id, batsman AS player_name, batting_team AS team, CAST(sum(batsman_runs) AS BIGINT) AS runs_scored,
  count(*) AS balls_faced, count_if(batsman_runs = 4) AS fours, count_if(batsman_runs = 6) AS sixes
FROM deliveries GROUP BY 1, 2, 3""")
def _a1(t):
    return A.batting_cards(t.deliveries)


@query("a2_bowling_cards", """
SELECT match_id, bowler AS player_name, bowling_team AS team, count_if(is_wicket) AS wickets_taken,
  CAST(sum(total_runs) AS BIGINT) AS runs_conceded, count(*) AS balls_bowled,
  count(*) / 6 AS overs_bowled, sum(total_runs) / (count(*) / 6) AS economy_rate
FROM deliveries GROUP BY 1, 2, 3""")
def _a2(t):
    return A.bowling_cards(t.deliveries)


@query("a3_team_batting", """
SELECT batting_team AS team, avg(batsman_runs) AS avg_runs_per_ball, avg(total_runs) AS avg_total_runs,
  avg(CAST(batsman_runs = 6 AS INT)) AS six_rate, avg(CAST(batsman_runs = 4 AS INT)) AS four_rate
FROM deliveries GROUP BY 1""")
def _a3(t):
    return A.team_batting(t.deliveries)


@query("a4_team_bowling", """
SELECT bowling_team AS team, avg(CAST(is_wicket AS INT)) AS avg_wickets_per_ball, avg(total_runs) AS avg_economy
FROM deliveries GROUP BY 1""")
def _a4(t):
    return A.team_bowling(t.deliveries)


@query("a5_team_phase_rates", """
WITH bat AS (SELECT batting_team AS team, avg(CASE WHEN over_num <= 6 THEN total_runs END) AS pp_run_rate,
               avg(CASE WHEN over_num >= 16 THEN total_runs END) AS death_run_rate FROM deliveries GROUP BY 1),
bowl AS (SELECT bowling_team AS team, avg(CASE WHEN over_num >= 16 THEN CAST(is_wicket AS INT) END) AS death_wicket_rate
         FROM deliveries GROUP BY 1)
SELECT coalesce(bat.team, bowl.team) AS team, pp_run_rate, death_run_rate, death_wicket_rate
FROM bat FULL JOIN bowl ON bat.team = bowl.team""")
def _a5(t):
    return A.team_phase_rates(t.deliveries)


WIN_RATES_SQL = """
WITH played AS (SELECT team, count(*) AS total_matches FROM
                  (SELECT team1 AS team FROM clean_matches UNION ALL SELECT team2 FROM clean_matches) x GROUP BY 1),
wins AS (SELECT winner AS team, count(*) AS total_wins FROM clean_matches GROUP BY 1)
SELECT played.team, total_matches, total_wins,
  coalesce(total_wins / CASE WHEN total_matches = 0 THEN 1 ELSE total_matches END, 0.5) AS win_rate
FROM played LEFT JOIN wins ON played.team = wins.team"""


@query("a6_team_win_rates", WIN_RATES_SQL)
def _a6(t):
    return A.team_win_rates(t.clean_matches)


TEAM_STATS_SQL = """
WITH bat AS (SELECT batting_team AS team, avg(batsman_runs) AS avg_runs_per_ball, avg(total_runs) AS avg_total_runs,
      avg(CAST(batsman_runs = 6 AS INT)) AS six_rate, avg(CAST(batsman_runs = 4 AS INT)) AS four_rate,
      avg(CASE WHEN over_num <= 6 THEN total_runs END) AS pp_run_rate,
      avg(CASE WHEN over_num >= 16 THEN total_runs END) AS death_run_rate FROM deliveries GROUP BY 1),
bowl AS (SELECT bowling_team AS team, avg(CAST(is_wicket AS INT)) AS avg_wickets_per_ball, avg(total_runs) AS avg_economy,
      avg(CASE WHEN over_num >= 16 THEN CAST(is_wicket AS INT) END) AS death_wicket_rate FROM deliveries GROUP BY 1),
played AS (SELECT team, count(*) AS total_matches FROM
      (SELECT team1 AS team FROM clean_matches UNION ALL SELECT team2 FROM clean_matches) x GROUP BY 1),
wins AS (SELECT winner AS team, count(*) AS total_wins FROM clean_matches GROUP BY 1),
raw AS (
  SELECT coalesce(bat.team, bowl.team) AS team, avg_runs_per_ball, avg_total_runs, six_rate, four_rate,
    avg_wickets_per_ball, avg_economy, total_wins, total_matches,
    coalesce(total_wins / CASE WHEN total_matches = 0 THEN 1 ELSE total_matches END, 0.5) AS win_rate,
    pp_run_rate, death_run_rate, death_wicket_rate
  FROM bat FULL JOIN bowl ON bat.team = bowl.team
  LEFT JOIN played ON played.team = coalesce(bat.team, bowl.team)
  LEFT JOIN wins ON wins.team = coalesce(bat.team, bowl.team)),
med AS (SELECT median(avg_runs_per_ball) a, median(avg_total_runs) b, median(six_rate) c, median(four_rate) d,
  median(avg_wickets_per_ball) e, median(avg_economy) f, median(total_wins) g, median(total_matches) h,
  median(win_rate) i, median(pp_run_rate) j, median(death_run_rate) k, median(death_wicket_rate) l FROM raw)
SELECT team, coalesce(avg_runs_per_ball, a) AS avg_runs_per_ball, coalesce(avg_total_runs, b) AS avg_total_runs,
  coalesce(six_rate, c) AS six_rate, coalesce(four_rate, d) AS four_rate,
  coalesce(avg_wickets_per_ball, e) AS avg_wickets_per_ball, coalesce(avg_economy, f) AS avg_economy,
  coalesce(total_wins, g) AS total_wins, coalesce(total_matches, h) AS total_matches, coalesce(win_rate, i) AS win_rate,
  coalesce(pp_run_rate, j) AS pp_run_rate, coalesce(death_run_rate, k) AS death_run_rate,
  coalesce(death_wicket_rate, l) AS death_wicket_rate
FROM raw, med"""


@query("a7_team_stats_median_imputed", TEAM_STATS_SQL)
def _a7(t):
    return A.team_stats(t.deliveries, t.clean_matches)


@query("a8_career_batting", """
SELECT batsman, CAST(sum(batsman_runs) AS BIGINT) AS total_runs, count(*) AS balls_faced,
  count_if(batsman_runs = 6) AS sixes, count_if(batsman_runs = 4) AS fours,
  sum(batsman_runs) / CASE WHEN count(*) = 0 THEN 1 ELSE count(*) END * 100 AS strike_rate_live
FROM deliveries GROUP BY 1""")
def _a8(t):
    return A.career_batting(t.deliveries)


@query("a8_career_bowling", """
SELECT bowler, count_if(is_wicket) AS wickets, count(*) AS balls_bowled, CAST(sum(total_runs) AS BIGINT) AS runs_given,
  sum(total_runs) / CASE WHEN count(*) / 6 = 0 THEN 1 ELSE count(*) / 6 END AS economy_live
FROM deliveries GROUP BY 1""")
def _a8b(t):
    return A.career_bowling(t.deliveries)


@query("a9_innings_features", """
WITH n AS (SELECT *, row_number() OVER (PARTITION BY match_id, batting_team ORDER BY seq) AS rn FROM deliveries),
g AS (SELECT match_id, batting_team, CAST(sum(total_runs) AS BIGINT) AS total_runs, count(*) AS total_balls,
        count_if(is_wicket) AS wickets_lost, count_if(batsman_runs = 6) AS sixes, count_if(batsman_runs = 4) AS fours,
        CAST(coalesce(sum(CASE WHEN rn <= 36 THEN total_runs END), 0) AS BIGINT) AS pp_runs
      FROM n GROUP BY 1, 2)
SELECT *, total_runs / CASE WHEN total_balls / 6 = 0 THEN 1 ELSE total_balls / 6 END AS run_rate,
  pp_runs / 6 AS pp_run_rate,
  (sixes + fours) / CASE WHEN total_balls = 0 THEN 1 ELSE total_balls END AS boundary_pct
FROM g WHERE total_runs > 50""")
def _a9(t):
    return A.innings_features(t.deliveries)


@query("a10_iqr_outliers", """
WITH q AS (SELECT quantile_cont(total_runs, 0.25) AS q1, quantile_cont(total_runs, 0.75) AS q3 FROM deliveries)
SELECT q1, q3, count_if(total_runs < q1 - 1.5 * (q3 - q1) OR total_runs > q3 + 1.5 * (q3 - q1)) AS outliers,
  count(*) AS rows
FROM deliveries, q GROUP BY q1, q3""")
def _a10(t):
    return silver.outlier_report(t.deliveries, "total_runs")


@query("a11_null_percent", """
SELECT column_name, null_pct FROM (
  SELECT avg(CAST(price_text IS NULL AS INT)) * 100 AS price_text, avg(CAST(cust_text IS NULL AS INT)) * 100 AS cust_text,
    avg(CAST(date_text IS NULL AS INT)) * 100 AS date_text, avg(CAST(priority_text IS NULL AS INT)) * 100 AS priority_text,
    avg(CAST(o_orderkey IS NULL AS INT)) * 100 AS o_orderkey
  FROM dirty_orders) UNPIVOT (null_pct FOR column_name IN (o_orderkey, price_text, cust_text, date_text, priority_text))""")
def _a11(t):
    return A.null_percent(t.dirty_orders)


@query("a12_duplicate_count", """
SELECT count(*) AS rows, (SELECT count(*) FROM (SELECT DISTINCT * FROM duplicated_orders)) AS distinct_rows,
  count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM duplicated_orders)) AS duplicates
FROM duplicated_orders""")
def _a12(t):
    return A.duplicate_count(t.duplicated_orders)


@query("a13_dedup_rows", "SELECT DISTINCT * FROM duplicated_orders")
def _a13(t):
    return t.duplicated_orders.dropDuplicates()


@query("a14_team_kpis", """
WITH bat AS (SELECT batting_team AS team, CAST(sum(batsman_runs) AS BIGINT) AS total_runs, count(*) AS balls FROM deliveries GROUP BY 1),
bowl AS (SELECT bowling_team AS team, count_if(is_wicket) AS total_wickets,
           coalesce(sum(CASE WHEN over_num >= 16 THEN total_runs END), 0) AS death_runs,
           count_if(over_num >= 16) AS death_balls FROM deliveries GROUP BY 1)
SELECT coalesce(bat.team, bowl.team) AS team, coalesce(total_runs, 0) AS total_runs,
  coalesce(total_wickets, 0) AS total_wickets,
  coalesce(total_runs, 0) / greatest(coalesce(balls, 0), 1) * 100 AS strike_rate,
  coalesce(death_runs, 0) / greatest(coalesce(death_balls, 0) / 6, 1) AS death_economy
FROM bat FULL JOIN bowl ON bat.team = bowl.team""")
def _a14(t):
    return A.team_kpis(t.deliveries)


@query("a15_runs_by_over", """
SELECT batting_team AS team, over_num, avg(total_runs) AS avg_runs,
  CASE WHEN over_num <= 6 THEN 'Powerplay' WHEN over_num <= 15 THEN 'Middle' ELSE 'Death' END AS phase
FROM deliveries GROUP BY 1, 2""")
def _a15(t):
    return A.runs_by_over(t.deliveries)


@query("a16_dismissal_kinds", """
SELECT batting_team AS team, dismissal_kind, count(*) AS count FROM deliveries WHERE is_wicket GROUP BY 1, 2""")
def _a16(t):
    return A.dismissal_kinds(t.deliveries)


RECENT_SQL = """
recent AS (SELECT team, match_id FROM (
    SELECT team, match_id, row_number() OVER (PARTITION BY team ORDER BY match_date DESC NULLS LAST, match_id DESC) AS rn
    FROM (SELECT match_id, match_date, team1 AS team FROM clean_matches UNION ALL
          SELECT match_id, match_date, team2 FROM clean_matches) x) y WHERE rn <= 5),
rbat AS (SELECT d.* FROM deliveries d WHERE EXISTS (SELECT 1 FROM recent r WHERE r.team = d.batting_team AND r.match_id = d.match_id)),
rbowl AS (SELECT d.* FROM deliveries d WHERE EXISTS (SELECT 1 FROM recent r WHERE r.team = d.bowling_team AND r.match_id = d.match_id))"""


@query("a17_recent_form", f"""
WITH {RECENT_SQL},
runs AS (SELECT batting_team AS team, batsman AS player, CAST(sum(batsman_runs) AS BIGINT) AS recent_runs FROM rbat GROUP BY 1, 2),
wkts AS (SELECT bowling_team AS team, bowler AS player, count_if(is_wicket) AS recent_wickets FROM rbowl GROUP BY 1, 2)
SELECT coalesce(runs.team, wkts.team) AS team, coalesce(runs.player, wkts.player) AS player,
  coalesce(recent_runs, 0) AS recent_runs, coalesce(recent_wickets, 0) AS recent_wickets,
  coalesce(recent_runs, 0) + coalesce(recent_wickets, 0) * 20 AS form_score
FROM runs FULL JOIN wkts ON runs.team = wkts.team AND runs.player = wkts.player""")
def _a17(t):
    return A.recent_form(t.deliveries, t.clean_matches)


@query("a18_best_powerplay_batter", f"""
WITH {RECENT_SQL},
g AS (SELECT batting_team AS team, batsman, CAST(sum(batsman_runs) AS BIGINT) AS pp_runs FROM rbat WHERE over_num <= 6 GROUP BY 1, 2)
SELECT team, batsman, pp_runs FROM (SELECT *, row_number() OVER (PARTITION BY team ORDER BY pp_runs DESC, batsman) AS rn FROM g) z
WHERE rn = 1""")
def _a18(t):
    return A.best_powerplay_batter(t.deliveries, t.clean_matches)


@query("a19_best_middle_batter", f"""
WITH {RECENT_SQL},
pm AS (SELECT batting_team, batsman, match_id, sum(batsman_runs) AS r FROM rbat WHERE over_num BETWEEN 7 AND 15 GROUP BY 1, 2, 3),
g AS (SELECT batting_team AS team, batsman, avg(r) AS avg_runs FROM pm GROUP BY 1, 2)
SELECT team, batsman, avg_runs FROM (SELECT *, row_number() OVER (PARTITION BY team ORDER BY avg_runs DESC, batsman) AS rn FROM g) z
WHERE rn = 1""")
def _a19(t):
    return A.best_middle_batter(t.deliveries, t.clean_matches)


@query("a20_best_death_bowler", f"""
WITH {RECENT_SQL},
g AS (SELECT bowling_team AS team, bowler, count(*) AS balls, CAST(sum(total_runs) AS BIGINT) AS runs
      FROM rbowl WHERE over_num >= 16 GROUP BY 1, 2 HAVING count(*) >= 12)
SELECT team, bowler, balls, runs, economy FROM (
  SELECT *, runs / (balls / 6) AS economy, row_number() OVER (PARTITION BY team ORDER BY runs / (balls / 6), bowler) AS rn FROM g) z
WHERE rn = 1""")
def _a20(t):
    return A.best_death_bowler(t.deliveries, t.clean_matches)


@query("a21_duels", """
SELECT batsman, bowler, CAST(sum(batsman_runs) AS BIGINT) AS runs, count(*) AS balls,
  count_if(is_wicket AND player_dismissed = batsman) AS dismissals,
  sum(batsman_runs) / greatest(count(*), 1) * 100 AS strike_rate
FROM deliveries GROUP BY 1, 2""")
def _a21(t):
    return A.duels(t.deliveries)


@query("a22_consistency", f"""
WITH {RECENT_SQL},
pm AS (SELECT batting_team, batsman, match_id, sum(batsman_runs) AS r FROM rbat GROUP BY 1, 2, 3)
SELECT batting_team AS team, batsman, count(DISTINCT match_id) AS matches, avg(r) AS avg_runs,
  CASE WHEN count(r) > 1 THEN sqrt((count(r) * sum(r * r) - sum(r) * sum(r)) / (count(r) * (count(r) - 1)))
       ELSE 0.0 END AS std_runs
FROM pm GROUP BY 1, 2 HAVING count(DISTINCT match_id) >= 3""")
def _a22(t):
    return A.consistency(t.deliveries, t.clean_matches)


@query("a23_batting_depth", """
WITH fs AS (SELECT match_id, inning, batting_team, batsman, min(over_num) AS first_over, min(ball_num) AS first_ball
            FROM deliveries GROUP BY 1, 2, 3, 4),
pos AS (SELECT *, row_number() OVER (PARTITION BY match_id, inning ORDER BY first_over, first_ball, batsman) AS p FROM fs)
SELECT batting_team AS team, batsman, count(*) AS innings_at_6_8 FROM pos WHERE p BETWEEN 6 AND 8 GROUP BY 1, 2""")
def _a23(t):
    return A.batting_depth(t.deliveries)


@query("a24_bowling_phase_effectiveness", f"""
WITH {RECENT_SQL},
g AS (SELECT bowling_team AS team,
        CASE WHEN over_num <= 6 THEN 'Powerplay' WHEN over_num <= 15 THEN 'Middle' ELSE 'Death' END AS phase,
        count(*) AS balls, count_if(is_wicket) AS wickets, CAST(sum(total_runs) AS BIGINT) AS runs FROM rbowl GROUP BY 1, 2)
SELECT *, wickets / CASE WHEN balls / 6 = 0 THEN 1 ELSE balls / 6 END AS wickets_per_over,
  runs / CASE WHEN balls / 6 = 0 THEN 1 ELSE balls / 6 END AS economy FROM g""")
def _a24(t):
    return A.bowling_phase_effectiveness(t.deliveries, t.clean_matches)


@query("a25_weakness_profile", """
SELECT player_dismissed, dismissal_kind, count(*) AS dismissals FROM deliveries
WHERE player_dismissed IS NOT NULL AND player_dismissed <> '' GROUP BY 1, 2""")
def _a25(t):
    return A.weakness_profile(t.deliveries)


@query("a26_batting_depth_score", """
SELECT batting_team AS team, CAST(sum(batsman_runs) AS BIGINT) AS total_runs, count(DISTINCT batsman) AS unique_batters,
  sum(batsman_runs) / count(DISTINCT batsman) AS depth_score FROM deliveries GROUP BY 1""")
def _a26(t):
    return A.batting_depth_score(t.deliveries)


@query("a27_bowling_variety", """
SELECT bowling_team AS team, count_if(is_wicket) AS total_wickets, count(DISTINCT bowler) AS unique_bowlers,
  count_if(is_wicket) / count(DISTINCT bowler) AS variety_index FROM deliveries GROUP BY 1""")
def _a27(t):
    return A.bowling_variety(t.deliveries)


@query("a28_toss_advantage", """
SELECT toss_winner AS team, avg(CAST(toss_winner = winner AS INT)) * 100 AS win_rate, count(*) AS matches
FROM clean_matches GROUP BY 1 HAVING count(*) >= 3""")
def _a28(t):
    return A.toss_advantage(t.clean_matches)


@query("a29_toss_decision_win", """
SELECT toss_decision, avg(CAST(toss_winner = winner AS INT)) * 100 AS win_pct FROM clean_matches GROUP BY 1""")
def _a29(t):
    return A.toss_decision_win(t.clean_matches)


@query("a30_phase_run_rate_top_teams", """
WITH top AS (SELECT batting_team FROM deliveries GROUP BY 1 ORDER BY sum(batsman_runs) DESC, batting_team LIMIT 8)
SELECT batting_team AS team, CASE WHEN over_num <= 6 THEN 'Powerplay' WHEN over_num <= 15 THEN 'Middle' ELSE 'Death' END AS phase,
  avg(total_runs) AS avg_runs
FROM deliveries WHERE batting_team IN (SELECT batting_team FROM top) GROUP BY 1, 2""")
def _a30(t):
    return A.phase_run_rate_top_teams(t.deliveries)


PAIRS_SQL = """pairs AS (SELECT team1 AS team_a, team2 AS team_b, * FROM clean_matches
              UNION ALL SELECT team2 AS team_a, team1 AS team_b, * FROM clean_matches)"""


@query("a31_head_to_head", f"""
WITH {PAIRS_SQL},
g AS (SELECT team_a, team_b, count(*) AS meetings, count_if(winner = team_a) AS a_wins, count_if(winner = team_b) AS b_wins
      FROM pairs GROUP BY 1, 2)
SELECT *, greatest(0, least(100, a_wins / meetings * 100 + 5.0)) AS prob_a_toss_won,
  greatest(0, least(100, a_wins / meetings * 100 - 5.0)) AS prob_a_toss_lost FROM g""")
def _a31(t):
    return A.head_to_head(t.clean_matches)


@query("a32_expected_first_innings", """
WITH inn AS (SELECT i.*, m.venue FROM (SELECT match_id, batting_team, sum(total_runs) AS innings_total FROM deliveries
             WHERE inning = 1 GROUP BY 1, 2) i LEFT JOIN clean_matches m ON i.match_id = m.match_id),
va AS (SELECT venue, avg(innings_total) AS venue_avg FROM inn GROUP BY 1),
ta AS (SELECT batting_team AS team, avg(innings_total) AS team_avg FROM inn GROUP BY 1),
pairs AS (SELECT DISTINCT team, venue FROM (SELECT team1 AS team, venue FROM clean_matches UNION ALL
          SELECT team2, venue FROM clean_matches) x)
SELECT pairs.venue, pairs.team, venue_avg, team_avg, (coalesce(venue_avg, 160.0) + coalesce(team_avg, 160.0)) / 2 AS expected_score
FROM pairs LEFT JOIN va ON pairs.venue = va.venue LEFT JOIN ta ON pairs.team = ta.team""")
def _a32(t):
    return A.expected_first_innings(t.deliveries, t.clean_matches)


@query("a33_venue_win_pct", """
SELECT team, venue, count(*) AS matches, avg(CAST(winner = team AS INT)) * 100 AS win_pct FROM
  (SELECT team1 AS team, venue, winner FROM clean_matches UNION ALL SELECT team2, venue, winner FROM clean_matches) x
GROUP BY 1, 2""")
def _a33(t):
    return A.venue_win_pct(t.clean_matches)


@query("a33_toss_impact", """
SELECT toss_winner AS team, avg(CAST(winner = toss_winner AS INT)) * 100 AS toss_win_pct FROM clean_matches GROUP BY 1""")
def _a33b(t):
    return A.toss_impact(t.clean_matches)


@query("a34_upset_proxy", f"""
WITH {PAIRS_SQL},
wr AS (SELECT team, avg(CAST(winner = team AS INT)) AS wr FROM
        (SELECT team1 AS team, winner FROM clean_matches UNION ALL SELECT team2, winner FROM clean_matches) x GROUP BY 1),
p AS (SELECT DISTINCT team_a, team_b FROM pairs)
SELECT p.team_b, p.team_a, a.wr AS team_wr, b.wr AS opp_wr,
  greatest(0, least(100, (0.5 - (a.wr - b.wr)) * 100)) AS upset_prob
FROM p JOIN wr a ON a.team = p.team_a JOIN wr b ON b.team = p.team_b""")
def _a34(t):
    return A.upset_proxy(t.clean_matches)


@query("a35_team_rates", """
WITH bat AS (SELECT batting_team AS team, sum(total_runs) AS r, count(*) AS b FROM deliveries GROUP BY 1),
bowl AS (SELECT bowling_team AS team, sum(total_runs) AS r, count(*) AS b,
           avg(CAST(batsman_runs = 0 AND extra_runs = 0 AS INT)) * 100 AS dot_rate FROM deliveries GROUP BY 1)
SELECT coalesce(bat.team, bowl.team) AS team, bat.r / greatest(bat.b / 6, 1) AS run_rate,
  bowl.r / greatest(bowl.b / 6, 1) AS economy, dot_rate
FROM bat FULL JOIN bowl ON bat.team = bowl.team""")
def _a35(t):
    return A.team_rates(t.deliveries)


@query("a35_phase_run_rates", """
SELECT batting_team AS team, CASE WHEN over_num <= 6 THEN 'Powerplay' WHEN over_num <= 15 THEN 'Middle' ELSE 'Death' END AS phase,
  CAST(sum(total_runs) AS BIGINT) AS runs, count(*) AS balls,
  sum(total_runs) / CASE WHEN count(*) / 6 = 0 THEN 1 ELSE count(*) / 6 END AS run_rate
FROM deliveries GROUP BY 1, 2""")
def _a35b(t):
    return A.phase_run_rates(t.deliveries)


@query("a36_qualification_approx", """
WITH g AS (SELECT team, count(*) AS played, count_if(winner = team) AS won FROM
  (SELECT team1 AS team, winner FROM clean_matches UNION ALL SELECT team2, winner FROM clean_matches) x GROUP BY 1)
SELECT team, played, won, won * 2 AS points,
  least((won * 2 + won / played * greatest(greatest(played, 14) - played, 0) * 2) / 16, 1.0) * 100 AS qual_pct FROM g""")
def _a36(t):
    return A.qualification_approx(t.clean_matches)


@query("a37_top_run_scorers", """
SELECT batsman, CAST(sum(batsman_runs) AS BIGINT) AS total_runs FROM deliveries
GROUP BY batsman ORDER BY total_runs DESC, batsman LIMIT 10""")
def _a37(t):
    return A.top_run_scorers(t.deliveries)


@query("a37_top_wicket_takers", """
SELECT bowler, count(*) AS wickets FROM deliveries WHERE is_wicket GROUP BY 1 ORDER BY wickets DESC, bowler LIMIT 10""")
def _a37b(t):
    return A.top_wicket_takers(t.deliveries)


@query("a37_top_six_hitters", """
SELECT batsman, count(*) AS sixes FROM deliveries WHERE batsman_runs = 6 GROUP BY 1 ORDER BY sixes DESC, batsman LIMIT 10""")
def _a37c(t):
    return A.top_six_hitters(t.deliveries)


@query("a37_team_totals", """
SELECT batting_team, CAST(sum(batsman_runs) AS BIGINT) AS total_runs FROM deliveries GROUP BY 1
ORDER BY total_runs DESC, batting_team LIMIT 12""")
def _a37d(t):
    return A.team_totals(t.deliveries)


@query("a38_records", """
SELECT CAST((SELECT max(s) FROM (SELECT sum(batsman_runs) AS s FROM deliveries GROUP BY match_id, batsman)) AS BIGINT) AS highest_score,
  CAST((SELECT max(s) FROM (SELECT sum(total_runs) AS s FROM deliveries GROUP BY match_id, batting_team)) AS BIGINT) AS highest_total,
  (SELECT count_if(batsman_runs = 6) FROM deliveries) AS total_sixes,
  (SELECT count_if(batsman_runs = 4) FROM deliveries) AS total_fours""")
def _a38(t):
    out = A.records(t.deliveries)
    return out.select(*[F.col(c).cast("bigint").alias(c) for c in out.columns])


@query("a39_venue_specialists", """
WITH dv AS (SELECT d.*, m.venue FROM deliveries d JOIN clean_matches m ON d.match_id = m.match_id),
both_ AS (SELECT venue, batsman AS player, CAST(sum(batsman_runs) AS BIGINT) AS value, 'runs' AS kind FROM dv GROUP BY 1, 2
          UNION ALL SELECT venue, bowler, count_if(is_wicket), 'wickets' FROM dv GROUP BY 1, 2)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY venue, kind ORDER BY value DESC, player) AS rank FROM both_) z
WHERE rank <= 5""")
def _a39(t):
    return A.venue_specialists(t.deliveries, t.clean_matches)


@query("a40_fastest_scorers", """
SELECT batsman, CAST(sum(batsman_runs) AS BIGINT) AS runs, count(*) AS balls, count_if(batsman_runs = 6) AS sixes,
  sum(batsman_runs) / count(*) * 100 AS strike_rate
FROM deliveries GROUP BY 1 HAVING count(*) >= 60 ORDER BY strike_rate DESC, batsman LIMIT 10""")
def _a40(t):
    return A.fastest_scorers(t.deliveries)


@query("a41_momentum", """
SELECT batting_team, avg(total_runs) AS avg_runs FROM deliveries WHERE over_num >= 18 GROUP BY 1
ORDER BY avg_runs DESC, batting_team LIMIT 8""")
def _a41(t):
    return A.momentum(t.deliveries)


@query("a42_bowlers_vs_opponent", """
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY bowling_team, batting_team ORDER BY wickets DESC, bowler) AS rank
  FROM (SELECT bowling_team, batting_team, bowler, count_if(is_wicket) AS wickets FROM deliveries GROUP BY 1, 2, 3) g) z
WHERE rank <= 10""")
def _a42(t):
    return A.bowlers_vs_opponent(t.deliveries)


@query("a43_leaders", """
WITH r AS (SELECT batsman AS who, sum(batsman_runs) AS v FROM deliveries GROUP BY 1),
s AS (SELECT batsman AS who, count(*) AS v FROM deliveries WHERE batsman_runs = 6 GROUP BY 1),
w AS (SELECT bowler AS who, count_if(is_wicket) AS v FROM deliveries GROUP BY 1)
SELECT (SELECT min(who) FROM r WHERE v = (SELECT max(v) FROM r)) AS top_run_player,
  (SELECT min(who) FROM s WHERE v = (SELECT max(v) FROM s)) AS top_six_player,
  (SELECT min(who) FROM w WHERE v = (SELECT max(v) FROM w)) AS top_wicket_player""")
def _a43(t):
    return A.leaders(t.deliveries)


@query("a44_partnerships", """
WITH g AS (SELECT batting_team, batsman AS striker, non_striker, CAST(sum(batsman_runs) AS BIGINT) AS runs, count(*) AS balls
  FROM deliveries WHERE batsman IS NOT NULL AND trim(batsman) <> '' AND non_striker IS NOT NULL AND trim(non_striker) <> ''
  GROUP BY 1, 2, 3 HAVING count(*) >= 12)
SELECT * FROM (SELECT *, runs / CASE WHEN balls = 0 THEN 1 ELSE balls END * 100 AS partnership_sr,
  row_number() OVER (PARTITION BY batting_team ORDER BY runs DESC, striker, non_striker) AS rank FROM g) z WHERE rank <= 15""")
def _a44(t):
    return A.partnerships(t.deliveries)


@query("a45_points_table", """
WITH long AS (SELECT team1 AS team, * FROM clean_matches UNION ALL SELECT team2 AS team, * FROM clean_matches),
g AS (SELECT team, count(*) AS played, count_if(winner = team) AS won,
        sum(CASE WHEN winner = team THEN coalesce(win_by_runs, 0) ELSE 0 END) AS runs_for,
        sum(CASE WHEN NOT (winner = team) THEN coalesce(win_by_runs, 0) ELSE 0 END) AS runs_against FROM long GROUP BY 1)
SELECT team, played, won, played - won AS lost, won * 2 AS points,
  (runs_for - runs_against) / greatest(played, 1) * 0.1 AS nrr FROM g""")
def _a45(t):
    return A.points_table(t.clean_matches)


@query("a46_head_to_head_matrix", """
SELECT team, opponent, count(*) AS played, count_if(winner = team) AS wins FROM (
  SELECT team1 AS team, team2 AS opponent, winner FROM clean_matches UNION ALL SELECT team2, team1, winner FROM clean_matches) x
GROUP BY 1, 2""")
def _a46(t):
    return A.head_to_head_matrix(t.clean_matches)


_SNAPSHOT = """
SELECT {g} AS gender, (SELECT count(*) FROM clean_matches WHERE {m}) AS matches,
  (SELECT count(DISTINCT player_name) FROM players WHERE {m}) AS players,
  (SELECT count(*) FROM deliveries WHERE match_id IN (SELECT match_id FROM clean_matches WHERE {m})) AS deliveries,
  (SELECT count(DISTINCT team) FROM (SELECT team1 AS team FROM clean_matches WHERE {m} UNION ALL SELECT team2 FROM clean_matches WHERE {m}) x) AS teams"""


@query("a49_warehouse_snapshot", " UNION ALL ".join([
    _SNAPSHOT.format(g="'all'", m="true"), _SNAPSHOT.format(g="'female'", m="gender = 'female'"),
    _SNAPSHOT.format(g="'male'", m="gender = 'male'")]))
def _a49(t):
    out = None
    for gender in (None, "female", "male"):
        row = A.warehouse_snapshot(t.clean_matches, t.players, t.deliveries, gender).withColumn("gender", F.lit(gender or "all"))
        out = row if out is None else out.unionByName(row)
    return out


@query("a52_latest_valid_date", r"""
SELECT priority_text, max(CASE WHEN regexp_full_match(trim(date_text), '[0-9]{4}-[0-9]{2}-[0-9]{2}') THEN CAST(trim(date_text) AS DATE) END)
  AS last_played_date FROM dirty_orders GROUP BY 1""")
def _a52(t):
    return A.latest_valid_date(t.dirty_orders, "priority_text", "date_text")


@query("a47_run_value_counts", "SELECT batsman_runs AS runs, count(*) AS count FROM deliveries GROUP BY 1")
def _a47(t):
    return A.run_value_counts(t.deliveries)


def _hist_sql(column: str, bins: int) -> str:
    return f"""
WITH pos AS (SELECT {column} AS v FROM clean_matches WHERE {column} > 0),
b AS (SELECT min(v) AS lo, max(v) AS hi FROM pos)
SELECT CASE WHEN hi > lo THEN least(CAST(floor((v - lo) * {bins} / CASE WHEN hi > lo THEN hi - lo ELSE 1 END) AS BIGINT) + 1, {bins})
            ELSE CAST(1 AS BIGINT) END AS bin,
  count(*) AS count, min(v) AS min_value, max(v) AS max_value
FROM pos, b GROUP BY 1"""


@query("a48_win_by_runs_histogram", _hist_sql("win_by_runs", 20))
def _a48(t):
    return A.margin_histogram(t.clean_matches, "win_by_runs", 20)


@query("a48_win_by_wickets_histogram", _hist_sql("win_by_wickets", 10))
def _a48b(t):
    return A.margin_histogram(t.clean_matches, "win_by_wickets", 10)


@query("a53_team_batters", """
SELECT * FROM (SELECT *, runs / balls * 100 AS strike_rate,
  row_number() OVER (PARTITION BY team ORDER BY runs DESC, batsman) AS rank FROM
  (SELECT batting_team AS team, batsman, CAST(sum(batsman_runs) AS BIGINT) AS runs, count(*) AS balls FROM deliveries GROUP BY 1, 2) g) z
WHERE rank <= 10""")
def _a53(t):
    return A.team_batters(t.deliveries)


@query("a55_matches_per_team", """
SELECT team, count(*) AS matches FROM (SELECT team1 AS team FROM clean_matches UNION ALL SELECT team2 FROM clean_matches) x
GROUP BY 1 ORDER BY matches DESC, team LIMIT 15""")
def _a55(t):
    return A.matches_per_team(t.clean_matches)


@query("a56_top_run_scorers_full", """
SELECT batsman AS player, CAST(sum(batsman_runs) AS BIGINT) AS runs FROM deliveries GROUP BY 1 ORDER BY runs DESC, player LIMIT 10""")
def _a56(t):
    return A.top_run_scorers(t.deliveries).select(F.col("batsman").alias("player"), F.col("total_runs").alias("runs"))


@query("a57_column_sample", """
SELECT min(toss_decision) AS min_value, max(toss_decision) AS max_value,
  (SELECT list(toss_decision ORDER BY toss_decision) FROM (SELECT DISTINCT toss_decision FROM clean_matches ORDER BY 1 LIMIT 4)) AS sample_values
FROM clean_matches""")
def _a57(t):
    return A.column_sample(t.clean_matches, "toss_decision")

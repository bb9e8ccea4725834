"""Registered window, ordering and set-operation queries (W, O, U rows)."""

from __future__ import annotations

from pyspark.sql import functions as F

from wicketlake.functions import expressions as E
from wicketlake.operators import aggregates as A
from wicketlake.operators import setops as U
from wicketlake.operators import topk
from wicketlake.operators import windows as W
from wicketlake.operators.keys import dense_index, keep_first
from wicketlake.plans.registry import query

TEAM = "NATION_3"


@query("w1_dense_match_keys", """
SELECT match_id, concat('M', lpad(CAST(n AS VARCHAR), CAST(greatest(4, length(CAST(n AS VARCHAR))) AS INTEGER), '0')) AS match_key
FROM (SELECT match_id, row_number() OVER (ORDER BY match_id) AS n FROM matches) x""")
def _w1(t):
    m = dense_index(t.matches.select("match_id"), ["match_id"], "_n")
    return m.select("match_id", E.padded_id("M", F.col("_n"), 4).alias("match_key"))


@query("w2_batting_positions", """
SELECT match_id, inning, batting_team, batsman, first_over, first_ball,
  row_number() OVER (PARTITION BY match_id, inning ORDER BY first_over, first_ball, batsman) AS batting_position
FROM (SELECT match_id, inning, batting_team, batsman, min(over_num) AS first_over, min(ball_num) AS first_ball
      FROM deliveries GROUP BY 1, 2, 3, 4) f""")
def _w2(t):
    return A.batting_positions(t.deliveries)


@query("w3_pressure_strike_rate", """
WITH p AS (SELECT *, coalesce(sum(CAST(is_wicket AS INT)) OVER (PARTITION BY match_id, inning ORDER BY seq
             ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING), 0) > 0 AS under_pressure FROM deliveries)
SELECT batsman, CAST(sum(batsman_runs) AS BIGINT) AS runs, count(*) AS balls, sum(batsman_runs) / count(*) * 100 AS pressure_sr
FROM p WHERE under_pressure GROUP BY 1 HAVING count(*) >= 10""")
def _w3(t):
    return W.pressure_strike_rates(t.deliveries)


@query("w4_hat_tricks", """
WITH wk AS (SELECT match_id, inning, seq, bowler, over_num, ball_num,
    lead(bowler, 1) OVER (PARTITION BY match_id, inning ORDER BY seq) AS b1,
    lead(bowler, 2) OVER (PARTITION BY match_id, inning ORDER BY seq) AS b2 FROM deliveries WHERE is_wicket),
hits AS (SELECT *, row_number() OVER (PARTITION BY match_id, inning, bowler ORDER BY seq) AS rn FROM wk WHERE bowler = b1 AND bowler = b2)
SELECT match_id, inning, bowler, over_num, ball_num, concat_ws(' ', 'Hat-trick:', bowler, 'in', match_id) AS alert FROM hits WHERE rn = 1""")
def _w4(t):
    return W.hat_tricks(t.deliveries)


@query("w5_running_score", """
SELECT event_id, match_id, sum(runs_scored + extras) OVER (PARTITION BY match_id ORDER BY event_id
  ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum_runs FROM live""")
def _w5(t):
    return W.running_score(t.live).select("event_id", "match_id", "cum_runs")


@query("w6_first_36_balls", """
SELECT match_id, batting_team, CAST(sum(CASE WHEN rn <= 36 THEN total_runs ELSE 0 END) AS BIGINT) AS first_36_runs FROM
  (SELECT *, row_number() OVER (PARTITION BY match_id, batting_team ORDER BY seq) AS rn FROM deliveries) x GROUP BY 1, 2""")
def _w6(t):
    from pyspark.sql.window import Window
    w = Window.partitionBy("match_id", "batting_team").orderBy("seq")
    n = t.deliveries.withColumn("rn", F.row_number().over(w))
    return n.groupBy("match_id", "batting_team").agg(
        F.sum(F.when(F.col("rn") <= 36, F.col("total_runs")).otherwise(0)).alias("first_36_runs"))


@query("w8_top_n_per_group", """
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY team ORDER BY wickets DESC, bowler) AS rank FROM
  (SELECT bowling_team AS team, bowler, count_if(is_wicket) AS wickets FROM deliveries GROUP BY 1, 2) g) z WHERE rank <= 3""")
def _w8(t):
    g = t.deliveries.groupBy(F.col("bowling_team").alias("team"), "bowler").agg(F.count_if("is_wicket").alias("wickets"))
    return topk.top_k_per_group(g, 3, ["team"], F.col("wickets").desc(), "bowler")


@query("w9_last_five_matches", """
SELECT team, match_id, match_date FROM (SELECT *, row_number() OVER (PARTITION BY team ORDER BY match_date DESC NULLS LAST, match_id DESC) AS rn
  FROM (SELECT match_id, match_date, team1 AS team FROM clean_matches UNION ALL SELECT match_id, match_date, team2 FROM clean_matches) x) y
WHERE rn <= 5""")
def _w9(t):
    return A.recent_matches(t.clean_matches)


POINTS_SQL = """
WITH long AS (SELECT team1 AS team, * FROM clean_matches UNION ALL SELECT team2 AS team, * FROM clean_matches),
g AS (SELECT team, count(*) AS played, count_if(winner = team) AS won,
        sum(CASE WHEN winner = team THEN coalesce(win_by_runs, 0) ELSE 0 END) AS runs_for,
        sum(CASE WHEN NOT (winner = team) THEN coalesce(win_by_runs, 0) ELSE 0 END) AS runs_against FROM long GROUP BY 1),
pt AS (SELECT team, played, won, played - won AS lost, won * 2 AS points,
        (runs_for - runs_against) / greatest(played, 1) * 0.1 AS nrr FROM g)"""


@query("w10_table_position", f"""
{POINTS_SQL}
SELECT *, row_number() OVER (ORDER BY points DESC, nrr DESC, team) AS position FROM pt""")
def _w10(t):
    return W.table_position(A.points_table(t.clean_matches))


@query("w12_keep_first", """
SELECT venue, match_id, match_date FROM (SELECT *, row_number() OVER (PARTITION BY venue ORDER BY match_date, match_id) AS rn
  FROM clean_matches) x WHERE rn = 1""")
def _w12(t):
    return keep_first(t.clean_matches, ["venue"], "match_date", "match_id").select("venue", "match_id", "match_date")


@query("o1_top_k_desc", """
SELECT player_name, runs FROM players ORDER BY runs DESC, player_name LIMIT 10""")
def _o1(t):
    return topk.top_k(t.players.select("player_name", "runs"), 10, F.col("runs").desc(), "player_name")


@query("o2_top_k_asc_min_sample", """
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY team ORDER BY economy, bowler) AS rank FROM
  (SELECT bowling_team AS team, bowler, count_if(is_wicket) AS wickets, count(*) AS balls, CAST(sum(total_runs) AS BIGINT) AS runs_conceded,
     sum(total_runs) / (count(*) / 6) AS economy FROM deliveries GROUP BY 1, 2 HAVING count(*) >= 12) g) z WHERE rank <= 10""")
def _o2(t):
    g = (t.deliveries.groupBy(F.col("bowling_team").alias("team"), "bowler")
         .agg(F.count_if("is_wicket").alias("wickets"), F.count("*").alias("balls"), F.sum("total_runs").alias("runs_conceded"))
         .filter(F.col("balls") >= 12)
         .withColumn("economy", F.col("runs_conceded") / (F.col("balls") / 6)))
    return topk.top_k_per_group(g, 10, ["team"], F.col("economy").asc(), "bowler")


@query("o3_mixed_direction_sort", f"""
{POINTS_SQL}
SELECT * FROM pt ORDER BY points DESC, nrr DESC""")
def _o3(t):
    return topk.mixed_sort(A.points_table(t.clean_matches), [("points", False), ("nrr", False)])


@query("o4_sql_order_limit", """
SELECT batsman, CAST(sum(batsman_runs) AS BIGINT) AS runs FROM deliveries GROUP BY 1 ORDER BY runs DESC, batsman LIMIT 5""")
def _o4(t):
    return t.spark.sql("SELECT batsman, sum(batsman_runs) AS runs FROM {d} GROUP BY batsman "
                       "ORDER BY runs DESC, batsman LIMIT :n", args={"n": 5}, d=t.deliveries)


@query("o5_latest_events", "SELECT * FROM live ORDER BY event_id DESC LIMIT 12")
def _o5(t):
    return topk.latest_n(t.live, 12)


@query("u1_union_distinct", "SELECT team1 AS team FROM clean_matches UNION SELECT team2 FROM clean_matches")
def _u1(t):
    cm = t.clean_matches
    return U.union_distinct(cm.select(F.col("team1").alias("team")), cm.select(F.col("team2").alias("team")))


@query("u2_clean_team_list", """
SELECT DISTINCT team_name FROM (SELECT trim(team1) AS team_name FROM clean_matches UNION ALL SELECT trim(team2) FROM clean_matches) x
WHERE team_name IS NOT NULL AND team_name <> ''""")
def _u2(t):
    return U.clean_team_list(t.clean_matches)


@query("u3_distinct_projection", "SELECT DISTINCT batting_team, batsman FROM deliveries")
def _u3(t):
    return U.distinct_of(t.deliveries, "batting_team", "batsman")


@query("u4_set_difference", f"""
SELECT team FROM (SELECT team1 AS team FROM clean_matches UNION SELECT team2 FROM clean_matches) x WHERE team <> '{TEAM}'""")
def _u4(t):
    cm = t.clean_matches
    teams = U.union_distinct(cm.select(F.col("team1").alias("team")), cm.select(F.col("team2").alias("team")))
    return U.all_but(teams, "team", teams.filter(F.col("team") == TEAM))

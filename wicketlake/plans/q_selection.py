"""Registered selection queries (G rows, with W7, W11, O6, J14, J16, A54)."""

from __future__ import annotations

from pyspark.sql import functions as F

from wicketlake.operators import aggregates as A
from wicketlake.operators import selection as G
from wicketlake.plans.registry import query

SCORE_SQL = """coalesce(batting_avg, 0.0) * 0.30 + coalesce(strike_rate, 0.0) * 0.10
  + greatest(0.0, 30.0 - coalesce(bowling_avg, 30.0)) * 0.25 + greatest(0.0, 10.0 - coalesce(economy, 8.0)) * 0.10
  + CASE WHEN coalesce(runs, 0) > 100 AND coalesce(wickets, 0) > 5 THEN 15.0 ELSE 0.0 END"""

XI_SQL = f"""
s AS (SELECT *, CASE WHEN role IN ('Batter', 'All-Rounder', 'Bowler', 'Unknown') THEN role ELSE 'Unknown' END AS role_q,
        CAST(round_even(CAST({SCORE_SQL} AS DECIMAL(18, 6)), 2) AS DOUBLE) AS perf_score FROM players),
q AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY country, role_q ORDER BY perf_score DESC, player_id) AS r FROM s) x
      WHERE r <= CASE role_q WHEN 'Batter' THEN 4 WHEN 'All-Rounder' THEN 2 WHEN 'Bowler' THEN 4 ELSE 1 END),
n AS (SELECT country, count(*) AS n FROM q GROUP BY 1),
rest AS (SELECT y.* FROM (SELECT s.*, row_number() OVER (PARTITION BY country ORDER BY perf_score DESC, player_id) AS r2
           FROM s WHERE player_id NOT IN (SELECT player_id FROM q)) y LEFT JOIN n ON n.country = y.country
         WHERE r2 <= 11 - coalesce(n.n, 0)),
xi0 AS (SELECT country, player_id, player_name, role, perf_score, strike_rate, batting_avg, 1 AS stage FROM q
        UNION ALL SELECT country, player_id, player_name, role, perf_score, strike_rate, batting_avg, 2 FROM rest),
xi AS (SELECT *, row_number() OVER (PARTITION BY country ORDER BY stage, perf_score DESC, player_id) AS xi_rank FROM xi0)"""


def _xi(t):
    return G.optimal_xi(t.players)


@query("g1_optimal_xi", f"""
WITH {XI_SQL}
SELECT country, xi_rank, player_id, player_name, role, perf_score FROM xi""")
def _g1(t):
    return _xi(t).select("country", "xi_rank", "player_id", "player_name", "role", "perf_score")


@query("g2_batting_order", f"""
WITH {XI_SQL},
a AS (SELECT *, row_number() OVER (PARTITION BY country ORDER BY strike_rate DESC, xi_rank) AS r1 FROM xi),
b AS (SELECT *, r1 <= 2 AS s1, row_number() OVER (PARTITION BY country, r1 <= 2 ORDER BY batting_avg DESC, xi_rank) AS r2 FROM a),
c AS (SELECT *, NOT s1 AND r2 <= 3 AS s2 FROM b),
d AS (SELECT *, row_number() OVER (PARTITION BY country, s1, s2 ORDER BY strike_rate DESC, xi_rank) AS r3 FROM c),
e AS (SELECT *, NOT s1 AND NOT s2 AND r3 <= 2 AS s3 FROM d),
f AS (SELECT *, CASE WHEN s1 THEN 1 WHEN s2 THEN 2 WHEN s3 THEN 3 ELSE 4 END AS seg,
        CASE WHEN s1 THEN r1 WHEN s2 THEN r2 WHEN s3 THEN r3 ELSE xi_rank END AS k FROM e),
g AS (SELECT *, row_number() OVER (PARTITION BY country ORDER BY seg, k) AS batting_position FROM f)
SELECT country, batting_position, player_id, player_name,
  CASE batting_position WHEN 1 THEN 'Opener' WHEN 2 THEN 'Opener' WHEN 3 THEN 'No.3' WHEN 4 THEN 'Middle Order'
    WHEN 5 THEN 'Middle Order' WHEN 6 THEN 'Finisher' WHEN 7 THEN 'Finisher' WHEN 8 THEN 'All-Rounder'
    WHEN 9 THEN 'All-Rounder' WHEN 10 THEN 'Tail' WHEN 11 THEN 'Tail' END AS role_in_order,
  strike_rate AS sr, batting_avg AS avg FROM g""")
def _g2(t):
    return G.batting_order(_xi(t))


@query("a54_xi_role_composition", f"""
WITH {XI_SQL}
SELECT country, role, count(*) AS players FROM xi GROUP BY 1, 2""")
def _a54(t):
    return _xi(t).groupBy("country", "role").agg(F.count("*").alias("players"))


RECENT_FORM_SQL = """
recent AS (SELECT team, match_id FROM (
    SELECT team, match_id, row_number() OVER (PARTITION BY team ORDER BY match_date DESC NULLS LAST, match_id DESC) AS rn
    FROM (SELECT match_id, match_date, team1 AS team FROM clean_matches UNION ALL
          SELECT match_id, match_date, team2 FROM clean_matches) x) y WHERE rn <= 5),
runs AS (SELECT batting_team AS team, batsman AS player, sum(batsman_runs) AS recent_runs FROM deliveries d
         WHERE EXISTS (SELECT 1 FROM recent r WHERE r.team = d.batting_team AND r.match_id = d.match_id) GROUP BY 1, 2),
wkts AS (SELECT bowling_team AS team, bowler AS player, count_if(is_wicket) AS recent_wickets FROM deliveries d
         WHERE EXISTS (SELECT 1 FROM recent r WHERE r.team = d.bowling_team AND r.match_id = d.match_id) GROUP BY 1, 2),
form AS (SELECT coalesce(runs.player, wkts.player) AS player, coalesce(recent_runs, 0) AS recent_runs,
           coalesce(recent_wickets, 0) AS recent_wickets, coalesce(recent_runs, 0) + coalesce(recent_wickets, 0) * 20 AS form_score
         FROM runs FULL JOIN wkts ON runs.team = wkts.team AND runs.player = wkts.player),
feat AS (SELECT coalesce(b.batsman, w.bowler) AS player_name,
           coalesce(sum_runs / CASE WHEN balls = 0 THEN 1 ELSE balls END * 100, 0.0) AS strike_rate_live, coalesce(wickets, 0) AS wickets
         FROM (SELECT batsman, sum(batsman_runs) AS sum_runs, count(*) AS balls FROM deliveries GROUP BY 1) b
         FULL JOIN (SELECT bowler, count_if(is_wicket) AS wickets FROM deliveries GROUP BY 1) w ON b.batsman = w.bowler)"""


def _features(t):
    d = t.deliveries
    b = A.career_batting(d).select("batsman", "strike_rate_live")
    w = A.career_bowling(d).select("bowler", "wickets")
    j = b.join(w, b.batsman == w.bowler, "full")
    return j.select(F.coalesce("batsman", "bowler").alias("player_name"),
                    F.coalesce("strike_rate_live", F.lit(0.0)).alias("strike_rate_live"),
                    F.coalesce("wickets", F.lit(0)).alias("wickets"))


@query("g3_form_xi", f"""
WITH {RECENT_FORM_SQL},
xi AS (SELECT p.player_name, p.country, coalesce(feat.strike_rate_live, 0.0) AS strike_rate_live, coalesce(feat.wickets, 0) AS wickets,
         coalesce(form.form_score, 0) AS form_score, coalesce(form.recent_runs, 0) AS recent_runs,
         coalesce(form.recent_wickets, 0) AS recent_wickets
       FROM players p LEFT JOIN feat ON feat.player_name = p.player_name LEFT JOIN form ON form.player = p.player_name)
SELECT player_name, country, strike_rate_live, wickets, form_score, CAST(recent_runs AS BIGINT) AS recent_runs, recent_wickets,
  selection_score, rank FROM (
  SELECT *, form_score + strike_rate_live * 0.2 + wickets * 3 AS selection_score,
    row_number() OVER (PARTITION BY country ORDER BY form_score + strike_rate_live * 0.2 + wickets * 3 DESC, player_name) AS rank
  FROM xi) z WHERE rank <= 11""")
def _g3(t):
    form = A.recent_form(t.deliveries, t.clean_matches)
    return G.form_xi(t.players, _features(t), form)


POINTS_SQL = """
long AS (SELECT team1 AS team, * FROM clean_matches UNION ALL SELECT team2 AS team, * FROM clean_matches),
g AS (SELECT team, count(*) AS played, count_if(winner = team) AS won,
        sum(CASE WHEN winner = team THEN coalesce(win_by_runs, 0) ELSE 0 END) AS runs_for,
        sum(CASE WHEN NOT (winner = team) THEN coalesce(win_by_runs, 0) ELSE 0 END) AS runs_against FROM long GROUP BY 1),
pt AS (SELECT team, played, won, played - won AS lost, won * 2 AS points,
        (runs_for - runs_against) / greatest(played, 1) * 0.1 AS nrr FROM g)"""

MARGINS = [10, 20, 50]


@query("g4_nrr_what_if", f"""
WITH {POINTS_SQL},
h AS (SELECT team, nrr, margin, nrr + margin * 0.005 AS new_nrr FROM pt, (VALUES (10), (20), (50)) m(margin))
SELECT h.team, h.margin, h.nrr, h.new_nrr, count(o.nrr) + 1 AS new_rank
FROM h LEFT JOIN pt o ON o.nrr > h.new_nrr GROUP BY 1, 2, 3, 4""")
def _g4(t):
    return G.nrr_what_if(A.points_table(t.clean_matches), MARGINS)


@query("g5_qualification_pct", f"""
WITH {POINTS_SQL},
top AS (SELECT * FROM pt ORDER BY points DESC, nrr DESC, team LIMIT 8),
r AS (SELECT *, (rank() OVER (ORDER BY nrr) + (count(*) OVER (PARTITION BY nrr) - 1) / 2) / count(*) OVER () AS pct_rank FROM top)
SELECT *, greatest(0, least(100, points / max(points) OVER () * 70 + pct_rank * 30)) AS qual_pct FROM r""")
def _g5(t):
    return G.qualification_pct(A.points_table(t.clean_matches))

"""Registered data-quality queries (Q rows)."""

from __future__ import annotations

from wicketlake.operators import quality as Q
from wicketlake.plans.registry import query

_CHECKS_SQL = """
mc AS (SELECT 'matches' AS table_name, * FROM (SELECT
    [{'check_no': 0, 'check_name': 'Row count > 50', 'passed': count(*) > 50, 'value': CAST(count(*) AS DOUBLE)},
     {'check_no': 1, 'check_name': 'No duplicate match_ids', 'passed': count(DISTINCT match_id) = count(*), 'value': CAST(count(DISTINCT match_id) AS DOUBLE)},
     {'check_no': 2, 'check_name': 'winner has no nulls', 'passed': count_if(winner IS NULL) = 0, 'value': CAST(count_if(winner IS NULL) AS DOUBLE)},
     {'check_no': 3, 'check_name': 'toss_decision values valid', 'passed': coalesce(bool_and(lower(toss_decision) IN ('bat', 'field')), true),
      'value': CAST(count_if(NOT lower(toss_decision) IN ('bat', 'field')) AS DOUBLE)},
     {'check_no': 4, 'check_name': 'match_date is not null', 'passed': count_if(match_date IS NULL) = 0, 'value': CAST(count_if(match_date IS NULL) AS DOUBLE)}] AS l
    FROM clean_matches) x, unnest(l) AS u(c)),
dc AS (SELECT 'deliveries' AS table_name, * FROM (SELECT
    [{'check_no': 0, 'check_name': 'Row count > 1000', 'passed': count(*) > 1000, 'value': CAST(count(*) AS DOUBLE)},
     {'check_no': 1, 'check_name': 'runs are non-negative', 'passed': min(total_runs) >= 0, 'value': CAST(min(total_runs) AS DOUBLE)},
     {'check_no': 2, 'check_name': 'over_num between 0 and 20', 'passed': coalesce(bool_and(over_num BETWEEN 0 AND 20), true), 'value': CAST(max(over_num) AS DOUBLE)},
     {'check_no': 3, 'check_name': 'batsman has no nulls', 'passed': count_if(batsman IS NULL) = 0, 'value': CAST(count_if(batsman IS NULL) AS DOUBLE)}] AS l
    FROM deliveries) x, unnest(l) AS u(c)),
pc AS (SELECT 'players' AS table_name, * FROM (SELECT
    [{'check_no': 0, 'check_name': 'Row count > 10', 'passed': count(*) > 10, 'value': CAST(count(*) AS DOUBLE)},
     {'check_no': 1, 'check_name': 'No duplicate player_ids', 'passed': count(DISTINCT player_id) = count(*), 'value': CAST(count(DISTINCT player_id) AS DOUBLE)},
     {'check_no': 2, 'check_name': 'strike_rate non-negative', 'passed': min(strike_rate) >= 0, 'value': CAST(min(strike_rate) AS DOUBLE)},
     {'check_no': 3, 'check_name': 'batting_avg non-negative', 'passed': min(batting_avg) >= 0, 'value': CAST(min(batting_avg) AS DOUBLE)}] AS l
    FROM players) x, unnest(l) AS u(c)),
report AS (SELECT table_name, c.check_no AS check_no, c.check_name AS check_name, c.passed AS passed, c.value AS value FROM mc
           UNION ALL SELECT table_name, c.check_no, c.check_name, c.passed, c.value FROM dc
           UNION ALL SELECT table_name, c.check_no, c.check_name, c.passed, c.value FROM pc)"""


def _report(t):
    return Q.quality_report(t.clean_matches, t.deliveries, t.players)


@query("q1_q3_quality_checks", f"WITH {_CHECKS_SQL}\nSELECT * FROM report")
def _q1(t):
    return _report(t)


@query("q4_quality_score", f"""WITH {_CHECKS_SQL}
SELECT count_if(passed) AS passed, count(*) AS total, count_if(passed) / count(*) * 100 AS pct FROM report""")
def _q4(t):
    return Q.quality_score(_report(t))


@query("q5_row_count_audit", """
SELECT * , CASE WHEN row_count = 0 THEN 'EMPTY' ELSE 'OK' END AS status FROM (
  SELECT 'deliveries' AS table_name, count(*) AS row_count FROM deliveries
  UNION ALL SELECT 'matches', count(*) FROM clean_matches
  UNION ALL SELECT 'players', count(*) FROM players
  UNION ALL SELECT 'venues', count(*) FROM venues
  UNION ALL SELECT 'live', count(*) FROM live) x""")
def _q5(t):
    return Q.row_count_audit({"deliveries": t.deliveries, "matches": t.clean_matches, "players": t.players,
                              "venues": t.venues, "live": t.live})


@query("q6_table_health", """
SELECT 'duplicated_orders' AS table_name, count(*) AS row_count,
  (0.0 + avg(CAST(o_orderkey IS NULL AS INT)) * 100 + avg(CAST(o_custkey IS NULL AS INT)) * 100
   + avg(CAST(o_orderstatus IS NULL AS INT)) * 100 + avg(CAST(o_totalprice IS NULL AS INT)) * 100
   + avg(CAST(o_orderdate IS NULL AS INT)) * 100 + avg(CAST(o_orderpriority IS NULL AS INT)) * 100) / 6 AS null_pct,
  count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM duplicated_orders)) AS duplicates,
  CASE WHEN (0.0 + avg(CAST(o_orderkey IS NULL AS INT)) * 100 + avg(CAST(o_custkey IS NULL AS INT)) * 100
   + avg(CAST(o_orderstatus IS NULL AS INT)) * 100 + avg(CAST(o_totalprice IS NULL AS INT)) * 100
   + avg(CAST(o_orderdate IS NULL AS INT)) * 100 + avg(CAST(o_orderpriority IS NULL AS INT)) * 100) / 6 < 5
   AND count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM duplicated_orders)) = 0 THEN 'Healthy' ELSE 'Warning' END AS health
FROM duplicated_orders""")
def _q6(t):
    return Q.table_health("duplicated_orders", t.duplicated_orders)


_PROFILE_COLS = ["batsman_runs", "extra_runs", "total_runs", "over_num"]


@query("q7_column_profile", " UNION ALL ".join(f"""
SELECT '{c}' AS column_name, count({c}) AS count, count_if({c} IS NULL) AS nulls, count(DISTINCT {c}) AS distinct,
  CAST(min({c}) AS DOUBLE) AS min, CAST(max({c}) AS DOUBLE) AS max, avg({c}) AS mean,
  CASE WHEN count({c}) > 1 THEN sqrt((sum(CAST({c} AS DOUBLE) * {c}) - sum(CAST({c} AS DOUBLE)) * sum(CAST({c} AS DOUBLE)) / count({c})) / (count({c}) - 1)) END AS stddev,
  quantile_cont(CAST({c} AS DOUBLE), 0.25) AS q1, quantile_cont(CAST({c} AS DOUBLE), 0.5) AS median,
  quantile_cont(CAST({c} AS DOUBLE), 0.75) AS q3, count_if({c} = 0) AS zeros FROM deliveries""" for c in _PROFILE_COLS))
def _q7(t):
    return Q.column_profile(t.deliveries, _PROFILE_COLS)

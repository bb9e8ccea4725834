"""DuckDB text of the adapter views, used to build the oracle queries.

These are an independent SQL statement of what ``wicketlake.sources.views``
builds with the DataFrame API; ``with_views`` prefixes a query body with the
views it mentions, as common table expressions.
"""

from __future__ import annotations

import re

DELIVERIES = """
SELECT concat('M', lpad(CAST(m AS VARCHAR), CAST(greatest(5, length(CAST(m AS VARCHAR))) AS INTEGER), '0')) AS match_id, inning, over_num, ball_num, batting_team, bowling_team,
  concat(batting_team, '_B', CAST(bk AS VARCHAR)) AS batsman,
  concat(batting_team, '_B', CAST((bk + off) % 11 AS VARCHAR)) AS non_striker,
  concat(bowling_team, '_B', CAST(wk AS VARCHAR)) AS bowler,
  runs AS batsman_runs, extra AS extra_runs, runs + extra AS total_runs, is_wicket,
  CASE WHEN NOT is_wicket THEN 'not_out' WHEN flag = 'R' THEN 'caught' WHEN flag = 'A' THEN 'bowled' ELSE 'lbw' END AS dismissal_kind,
  CASE WHEN is_wicket THEN concat(batting_team, '_B', CAST(bk AS VARCHAR)) END AS player_dismissed,
  row_number() OVER (PARTITION BY m ORDER BY inning, over_num, k, ball_num, pk, sk, xp) AS seq
FROM (SELECT *, concat('NATION_', CAST(CASE WHEN inning = 1 THEN t1 ELSE t2 END AS VARCHAR)) AS batting_team,
        concat('NATION_', CAST(CASE WHEN inning = 1 THEN t2 ELSE t1 END AS VARCHAR)) AS bowling_team
  FROM (SELECT *, m % 25 AS t1, (m % 25 + 1 + CAST(floor(m / 25) AS BIGINT) % 24) % 25 AS t2
    FROM (SELECT CAST(floor(l_orderkey / 50) AS BIGINT) AS m, CAST(1 + l_orderkey % 2 AS INT) AS inning,
            CAST(floor((l_orderkey % 50) * 20 / 50) AS INT) AS over_num, l_linenumber AS ball_num,
            l_partkey % 11 AS bk, 1 + l_suppkey % 10 AS off, l_suppkey % 11 AS wk, CAST(l_quantity AS INT) % 7 AS runs,
            CASE WHEN l_tax > 0.075 THEN 1 ELSE 0 END AS extra, l_partkey % 20 = 0 AS is_wicket, l_returnflag AS flag,
            l_orderkey AS k, l_partkey AS pk, l_suppkey AS sk, l_extendedprice AS xp FROM lineitem) a) b) c
"""

MATCHES = """
SELECT concat('M', lpad(CAST(m AS VARCHAR), CAST(greatest(5, length(CAST(m AS VARCHAR))) AS INTEGER), '0')) AS match_id, match_date, concat('VENUE_', CAST(v AS VARCHAR)) AS venue,
  t1n AS team1, t2n AS team2,
  CASE WHEN p % 2 = 1 THEN t1n ELSE t2n END AS toss_winner, CASE WHEN st % 2 = 1 THEN 'bat' ELSE 'field' END AS toss_decision,
  CASE WHEN w = 0 THEN 'No Result' WHEN w % 2 = 1 THEN t1n ELSE t2n END AS winner,
  CASE WHEN w = 0 THEN 'No Result' WHEN w <= 10 THEN concat(CAST(w * 3 AS VARCHAR), ' runs') ELSE concat(CAST(w - 10 AS VARCHAR), ' wickets') END AS margin,
  CASE WHEN m % 10 = 0 THEN 'Final' WHEN m % 10 = 1 THEN 'Semi-Final' WHEN m % 10 <= 4 THEN 'Super Eight' ELSE 'Group Stage' END AS stage,
  CASE WHEN m % 3 = 0 THEN 'female' ELSE 'male' END AS gender
FROM (SELECT *, concat('NATION_', CAST(m % 25 AS VARCHAR)) AS t1n,
        concat('NATION_', CAST((m % 25 + 1 + CAST(floor(m / 25) AS BIGINT) % 24) % 25 AS VARCHAR)) AS t2n
  FROM (SELECT CAST(floor(o_orderkey / 50) AS BIGINT) AS m,
          max(CAST(o_orderdate AS DATE)) AS match_date, CAST(sum(o_custkey) AS BIGINT) % 10 AS v,
          sum(CAST(substr(o_orderpriority, 1, 1) AS INT)) AS p, count_if(o_orderstatus = 'F') AS st,
          CAST(sum(CAST(floor(o_totalprice) AS BIGINT)) AS BIGINT) % 20 AS w
        FROM orders GROUP BY 1) a) b
"""

LIVE = """
SELECT event_id, ts, concat('L', CAST(user_id % 5 AS VARCHAR)) AS match_id, concat('U', CAST(user_id AS VARCHAR)) AS batsman,
  CAST(floor(value) AS INT) % 7 AS runs_scored, event_type = 'error' AS is_wicket,
  CASE WHEN event_type = 'signup' THEN 1 ELSE 0 END AS extras FROM events
"""

VENUES = r"""
SELECT stadium_name, concat('CITY_', regexp_extract(stadium_name, '(\d+)$', 1)) AS city,
  'Unknown' AS country, 'Balanced' AS pitch_type
FROM (SELECT DISTINCT venue AS stadium_name FROM matches) v
"""

DIRTY_ORDERS = """
SELECT o_orderkey,
  CASE o_orderkey % 17 WHEN 1 THEN '' WHEN 2 THEN 'n/a' WHEN 3 THEN ' 12.5% ' WHEN 4 THEN NULL ELSE CAST(o_totalprice AS VARCHAR) END AS price_text,
  CASE o_orderkey % 17 WHEN 1 THEN '' WHEN 2 THEN 'n/a' WHEN 3 THEN ' 12.5% ' WHEN 4 THEN NULL ELSE CAST(o_custkey AS VARCHAR) END AS cust_text,
  CASE o_orderkey % 17 WHEN 1 THEN '' WHEN 2 THEN 'n/a' WHEN 3 THEN ' 12.5% ' WHEN 4 THEN NULL ELSE strftime(o_orderdate, '%Y-%m-%d') END AS date_text,
  CASE o_orderkey % 17 WHEN 1 THEN '' WHEN 2 THEN 'n/a' WHEN 3 THEN ' 12.5% ' WHEN 4 THEN NULL ELSE o_orderpriority END AS priority_text
FROM orders
"""

DUPLICATED_ORDERS = """
SELECT * FROM orders UNION ALL SELECT * FROM orders WHERE o_orderkey % 97 = 0
"""

CLEAN_MATCHES = r"""
SELECT match_id, match_date, venue, team1, team2, toss_winner, coalesce(toss_decision, 'bat') AS toss_decision,
  coalesce(nullif(trim(winner), ''), 'No Result') AS winner,
  CASE WHEN lower(coalesce(margin, '')) LIKE '%run%'
       THEN coalesce(TRY_CAST(regexp_extract(lower(coalesce(margin, '')), '^\s*(\d+)', 1) AS INTEGER), 0) ELSE 0 END AS win_by_runs,
  CASE WHEN lower(coalesce(margin, '')) LIKE '%wkt%' OR lower(coalesce(margin, '')) LIKE '%wicket%'
       THEN coalesce(TRY_CAST(regexp_extract(lower(coalesce(margin, '')), '^\s*(\d+)', 1) AS INTEGER), 0) ELSE 0 END AS win_by_wickets,
  'Unknown' AS player_of_match, false AS is_day_night,
  CASE WHEN lower(coalesce(stage, '')) LIKE '%semi%' THEN 'Semi Final'
       WHEN lower(coalesce(stage, '')) LIKE '%final%' THEN 'Final'
       WHEN lower(coalesce(stage, '')) LIKE '%super%' THEN 'Super 8' ELSE 'Group Stage' END AS tournament_phase,
  gender
FROM (SELECT DISTINCT * FROM matches) m
"""

# Views in dependency order; later entries may reference earlier ones.
VIEWS: dict[str, str] = {
    "deliveries": DELIVERIES,
    "matches": MATCHES,
    "live": LIVE,
    "venues": VENUES,
    "clean_matches": CLEAN_MATCHES,
    "dirty_orders": DIRTY_ORDERS,
    "duplicated_orders": DUPLICATED_ORDERS,
}


def register_view(name: str, sql: str, after: str | None = None) -> None:
    """Add a derived view (e.g. the silver players table) to the catalogue."""
    VIEWS[name] = sql


def _mentions(sql: str, name: str) -> bool:
    return re.search(rf"\b{name}\b", sql) is not None


def with_views(body: str) -> str:
    """Prefix ``body`` with the CTEs of every view it (transitively) uses."""
    body = body.strip()
    needed: set[str] = set()
    frontier = [body]
    while frontier:
        text = frontier.pop()
        for name, sql in VIEWS.items():
            if name not in needed and _mentions(text, name):
                needed.add(name)
                frontier.append(sql)
    ctes = [f"{name} AS ({VIEWS[name].strip()})" for name in VIEWS if name in needed]
    if body[:5].upper() == "WITH " and ctes:
        return "WITH " + ",\n".join(ctes) + ",\n" + body[5:]
    if not ctes:
        return body
    return "WITH " + ",\n".join(ctes) + "\n" + body


PLAYERS = """
SELECT player_name, country, role, matches, runs, batting_avg, strike_rate, hundreds, fifties, wickets, bowling_avg,
  economy, gender, last_played_date, coalesce(last_played_date >= as_of - INTERVAL 36 MONTH, false) AS is_active,
  concat('P', lpad(CAST(n AS VARCHAR), CAST(greatest(5, length(CAST(n AS VARCHAR))) AS INTEGER), '0')) AS player_id
FROM (SELECT *, row_number() OVER (ORDER BY player_name) AS n FROM (
  SELECT coalesce(bat.player_name, bowl.player_name) AS player_name, coalesce(bat_team, bowl_team) AS country,
    CASE WHEN coalesce(wickets, 0) > 10 AND coalesce(runs, 0) > 100 THEN 'All-Rounder' WHEN coalesce(wickets, 0) > 5 THEN 'Bowler'
         WHEN coalesce(runs, 0) > 100 THEN 'Batter' ELSE 'Unknown' END AS role,
    coalesce(matches, 0) AS matches, CAST(coalesce(runs, 0) AS BIGINT) AS runs,
    coalesce(runs, 0) / greatest(coalesce(outs, 0), 1) AS batting_avg,
    CASE WHEN coalesce(balls_faced, 0) > 0 THEN coalesce(runs, 0) / coalesce(balls_faced, 0) * 100 ELSE 0.0 END AS strike_rate,
    coalesce(hundreds, 0) AS hundreds, coalesce(fifties, 0) AS fifties, coalesce(wickets, 0) AS wickets,
    CASE WHEN coalesce(wickets, 0) > 0 THEN coalesce(runs_conceded, 0) / coalesce(wickets, 0) ELSE 0.0 END AS bowling_avg,
    CASE WHEN coalesce(balls_bowled, 0) > 0 THEN coalesce(runs_conceded, 0) / (coalesce(balls_bowled, 0) / 6) ELSE 0.0 END AS economy,
    coalesce(app.gender, 'male') AS gender, last_played_date, (SELECT max(match_date) FROM matches) AS as_of
  FROM (SELECT batsman AS player_name, min(batting_team) AS bat_team, sum(batsman_runs) AS runs, count(*) AS balls_faced,
          count_if(player_dismissed = batsman) AS outs FROM deliveries GROUP BY 1) bat
  FULL JOIN (SELECT bowler AS player_name, min(bowling_team) AS bowl_team, count_if(is_wicket) AS wickets,
          sum(total_runs) AS runs_conceded, count(*) AS balls_bowled FROM deliveries GROUP BY 1) bowl
    ON bat.player_name = bowl.player_name
  LEFT JOIN (SELECT player_name, count_if(r >= 100) AS hundreds, count_if(r >= 50 AND r < 100) AS fifties
          FROM (SELECT match_id, batsman AS player_name, sum(batsman_runs) AS r FROM deliveries GROUP BY 1, 2) x GROUP BY 1) inn
    ON inn.player_name = coalesce(bat.player_name, bowl.player_name)
  LEFT JOIN (SELECT a.player_name, count(a.match_id) AS matches, max(m.match_date) AS last_played_date, max(m.gender) AS gender
          FROM (SELECT match_id, batsman AS player_name FROM deliveries UNION SELECT match_id, bowler FROM deliveries) a
          LEFT JOIN matches m ON a.match_id = m.match_id GROUP BY 1) app
    ON app.player_name = coalesce(bat.player_name, bowl.player_name)
) q) p
"""

VIEWS["players"] = PLAYERS


DIM_TEAM = """
SELECT row_number() OVER (ORDER BY team_name) AS team_id, team_name,
  CAST(row_number() OVER (ORDER BY team_name) AS INTEGER) AS icc_ranking, CAST(0.0 AS DOUBLE) AS icc_rating,
  'TBD' AS captain, 'TBD' AS coach, team_name AS home_country
FROM (SELECT DISTINCT trim(t) AS team_name FROM (SELECT team1 AS t FROM clean_matches UNION ALL SELECT team2 FROM clean_matches) x
      WHERE trim(t) IS NOT NULL AND trim(t) <> '') y
"""

DIM_VENUE = """
SELECT row_number() OVER (ORDER BY stadium_name) AS venue_id, stadium_name, city, country, pitch_type,
  CAST(160.0 AS DOUBLE) AS avg_first_innings, 50000 AS capacity, true AS is_day_night FROM venues
"""

DIM_DATE = """
SELECT row_number() OVER (ORDER BY match_date) AS date_id, match_date, CAST(year(match_date) AS INTEGER) AS year,
  CAST(month(match_date) AS INTEGER) AS month, strftime(match_date, '%B') AS month_name, strftime(match_date, '%A') AS day_of_week,
  tournament_phase, tournament_phase IN ('Semi Final', 'Final') AS is_knockout, tournament_phase = 'Final' AS is_final
FROM (SELECT match_date, min(tournament_phase) AS tournament_phase FROM clean_matches WHERE match_date IS NOT NULL GROUP BY 1) d
"""

FACT = """
SELECT * FROM (
WITH bat AS (SELECT match_id, batsman AS player_name, batting_team AS bat_team, sum(batsman_runs) AS runs_scored,
      count(*) AS balls_faced, count_if(batsman_runs = 4) AS fours, count_if(batsman_runs = 6) AS sixes FROM deliveries GROUP BY 1, 2, 3),
bowl AS (SELECT match_id, bowler AS player_name, bowling_team AS bowl_team, count_if(is_wicket) AS wickets_taken,
      sum(total_runs) AS runs_conceded, count(*) / 6 AS overs_bowled, sum(total_runs) / (count(*) / 6) AS economy_rate
      FROM deliveries GROUP BY 1, 2, 3),
f AS (SELECT coalesce(bat.match_id, bowl.match_id) AS match_id, coalesce(bat.player_name, bowl.player_name) AS player_name,
      coalesce(bat_team, bowl_team) AS team_name, runs_scored, balls_faced, fours, sixes, wickets_taken, runs_conceded,
      overs_bowled, economy_rate
      FROM bat FULL JOIN bowl ON bat.match_id = bowl.match_id AND bat.player_name = bowl.player_name),
j AS (SELECT f.*, p.player_id, t.team_id, m.winner, m.player_of_match, d.date_id, v.venue_id,
      CASE WHEN f.team_name = m.team1 THEN m.team2 ELSE m.team1 END AS opponent_team_name
      FROM f LEFT JOIN players p ON lower(trim(p.player_name)) = lower(trim(f.player_name))
      LEFT JOIN dim_team t ON t.team_name = f.team_name
      LEFT JOIN clean_matches m ON m.match_id = f.match_id
      LEFT JOIN dim_date d ON d.match_date = m.match_date
      LEFT JOIN dim_venue v ON v.stadium_name = m.venue)
SELECT j.match_id, j.player_id, j.team_id, o.team_id AS opponent_team_id, coalesce(j.venue_id, 1) AS venue_id, j.date_id,
  CAST(coalesce(runs_scored, 0) AS BIGINT) AS runs_scored, coalesce(balls_faced, 0) AS balls_faced,
  CASE WHEN coalesce(balls_faced, 0) > 0 THEN coalesce(runs_scored, 0) / coalesce(balls_faced, 0) * 100 ELSE 0.0 END AS strike_rate,
  coalesce(fours, 0) AS fours, coalesce(sixes, 0) AS sixes, coalesce(wickets_taken, 0) AS wickets_taken,
  coalesce(overs_bowled, 0.0) AS overs_bowled, CAST(coalesce(runs_conceded, 0) AS BIGINT) AS runs_conceded,
  coalesce(economy_rate, 0.0) AS economy_rate, 0 AS catches,
  CASE WHEN j.team_name = j.winner THEN 'W' ELSE 'L' END AS match_result,
  lower(trim(j.player_name)) = lower(trim(j.player_of_match)) AS is_player_of_match
FROM j LEFT JOIN dim_team o ON o.team_name = j.opponent_team_name
WHERE j.player_id IS NOT NULL AND j.team_id IS NOT NULL) fact_rows
"""

VIEWS["dim_team"] = DIM_TEAM
VIEWS["dim_venue"] = DIM_VENUE
VIEWS["dim_date"] = DIM_DATE

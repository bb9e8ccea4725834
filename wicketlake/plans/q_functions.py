"""Registered scalar-function queries (F rows)."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from wicketlake.functions import expressions as E
from wicketlake.plans.registry import query


@query("f1_safe_numbers", """
SELECT o_orderkey,
  coalesce(TRY_CAST(replace(trim(price_text), '%', '') AS DOUBLE), 0.0) AS price,
  coalesce(CAST(trunc(TRY_CAST(trim(cust_text) AS DOUBLE)) AS BIGINT), 0) AS cust
FROM dirty_orders""")
def _f1(t):
    d = t.dirty_orders
    return d.select("o_orderkey", E.safe_float("price_text").alias("price"), E.safe_int("cust_text").alias("cust"))


@query("f2_null_aware_float", """
SELECT o_orderkey, coalesce(TRY_CAST(nullif(trim(price_text), '') AS DOUBLE), -1.0) AS price FROM dirty_orders""")
def _f2(t):
    return t.dirty_orders.select("o_orderkey", E.nullable_float("price_text", -1.0).alias("price"))


@query("f3_over_and_ball", """
SELECT match_id, seq, TRY_CAST(split_part(txt, '.', 1) AS INTEGER) AS over_num, TRY_CAST(split_part(txt, '.', 2) AS INTEGER) AS ball_num
FROM (SELECT match_id, seq, concat(CAST(over_num AS VARCHAR), '.', CAST(ball_num AS VARCHAR)) AS txt FROM deliveries) x""")
def _f3(t):
    txt = F.concat_ws(".", F.col("over_num").cast("string"), F.col("ball_num").cast("string"))
    over, ball = E.over_and_ball(txt)
    return t.deliveries.select("match_id", "seq", over.alias("over_num"), ball.alias("ball_num"))


@query("f4_margin_parse", "SELECT match_id, win_by_runs, win_by_wickets FROM clean_matches")
def _f4(t):
    runs, wkts = E.margin_number("margin")
    return t.matches.dropDuplicates().select("match_id", runs.alias("win_by_runs"), wkts.alias("win_by_wickets"))


@query("f5_title_case", """
SELECT DISTINCT batsman, array_to_string(list_transform(string_split(lower(trim(replace(batsman, '_', ' '))), ' '),
  lambda w: upper(w[1]) || w[2:]), ' ') AS display_name FROM deliveries""")
def _f5(t):
    name = F.lower(F.regexp_replace("batsman", "_", " "))
    return t.deliveries.select("batsman", E.title_case(name).alias("display_name")).distinct()


@query("f6_date_parse", "SELECT o_orderkey, TRY_CAST(trim(date_text) AS DATE) AS parsed_date FROM dirty_orders")
def _f6(t):
    return t.dirty_orders.select("o_orderkey", E.parse_date("date_text").alias("parsed_date"))


@query("f7_date_parts", """
SELECT match_id, CAST(year(match_date) AS INTEGER) AS year, CAST(month(match_date) AS INTEGER) AS month,
  strftime(match_date, '%B') AS month_name, strftime(match_date, '%A') AS day_of_week FROM matches""")
def _f7(t):
    return t.matches.select("match_id", *[c.alias(k) for k, c in E.date_parts("match_date").items()])


AS_OF = dt.date(1998, 8, 2)


@query("f8_guarded_date_window", f"""
SELECT o_orderkey, CASE WHEN regexp_matches(trim(date_text), '^\\d{{4}}-\\d{{2}}-\\d{{2}}$') THEN TRY_CAST(trim(date_text) AS DATE) END AS d,
  coalesce(CASE WHEN regexp_matches(trim(date_text), '^\\d{{4}}-\\d{{2}}-\\d{{2}}$') THEN TRY_CAST(trim(date_text) AS DATE) END
    >= DATE '{AS_OF.isoformat()}' - INTERVAL 36 MONTH, false) AS recent
FROM dirty_orders""")
def _f8(t):
    d = E.guarded_date("date_text")
    return t.dirty_orders.select("o_orderkey", d.alias("d"),
                                 F.coalesce(E.within_months(d, F.lit(AS_OF), 36), F.lit(False)).alias("recent"))


@query("f9_string_cleanup", """
SELECT o_orderkey, nullif(trim(lower(priority_text)), '') AS priority_clean, replace(trim(coalesce(priority_text, '')), '-', ' ') AS priority_words
FROM dirty_orders""")
def _f9(t):
    p = F.col("priority_text")
    return t.dirty_orders.select("o_orderkey", E.blank_to_null(F.lower(p)).alias("priority_clean"),
                                 F.regexp_replace(F.trim(F.coalesce(p, F.lit(""))), "-", " ").alias("priority_words"))


@query("f10_labels", """
SELECT DISTINCT batting_team, batsman, non_striker, concat(batsman, ' & ', non_striker) AS pair,
  concat_ws(' ', 'Hat-trick:', batsman, 'in', match_id) AS alert FROM deliveries""")
def _f10(t):
    return t.deliveries.select("batting_team", "batsman", "non_striker",
                               F.concat("batsman", F.lit(" & "), "non_striker").alias("pair"),
                               F.concat_ws(" ", F.lit("Hat-trick:"), "batsman", F.lit("in"), "match_id").alias("alert")).distinct()


@query("f11_round_half_even", """
SELECT batsman, CAST(round_even(CAST(sum(batsman_runs) / count(*) * 100 AS DECIMAL(18, 6)), 2) AS DOUBLE) AS strike_rate
FROM deliveries GROUP BY 1""")
def _f11(t):
    g = t.deliveries.groupBy("batsman").agg((F.sum("batsman_runs") / F.count("*") * 100).alias("sr"))
    return g.select("batsman", F.bround(F.col("sr").cast("decimal(18,6)"), 2).cast("double").alias("strike_rate"))


@query("f12_safe_division", """
SELECT bowler, sum(total_runs) / CASE WHEN count_if(is_wicket) = 0 THEN 1 ELSE count_if(is_wicket) END AS runs_per_wicket,
  sum(total_runs) / greatest(count(*) / 6, 1) AS economy FROM deliveries GROUP BY 1""")
def _f12(t):
    g = t.deliveries.groupBy("bowler").agg(F.sum("total_runs").alias("r"), F.count_if("is_wicket").alias("w"),
                                           F.count("*").alias("b"))
    return g.select("bowler", E.safe_div(F.col("r"), F.col("w")).alias("runs_per_wicket"),
                    E.per_over(F.col("r"), F.col("b")).alias("economy"))


@query("f13_xi_score", """
SELECT player_id, coalesce(batting_avg, 0.0) * 0.30 + coalesce(strike_rate, 0.0) * 0.10
  + greatest(0.0, 30.0 - coalesce(bowling_avg, 30.0)) * 0.25 + greatest(0.0, 10.0 - coalesce(economy, 8.0)) * 0.10
  + CASE WHEN coalesce(runs, 0) > 100 AND coalesce(wickets, 0) > 5 THEN 15.0 ELSE 0.0 END AS perf_score FROM players""")
def _f13(t):
    p = t.players
    return p.select("player_id", E.xi_score(F.col("batting_avg"), F.col("strike_rate"), F.col("bowling_avg"),
                                            F.col("economy"), F.col("runs"), F.col("wickets")).alias("perf_score"))


@query("f15_casts", """
SELECT o_orderkey, TRY_CAST(trim(cust_text) AS INTEGER) AS cust_int, CAST(o_orderkey AS VARCHAR) AS key_text,
  o_orderkey % 2 = 0 AS even_flag FROM dirty_orders""")
def _f15(t):
    return t.dirty_orders.select("o_orderkey", F.trim("cust_text").try_cast("int").alias("cust_int"),
                                 F.col("o_orderkey").cast("string").alias("key_text"),
                                 (F.col("o_orderkey") % 2 == 0).cast("boolean").alias("even_flag"))


@query("f16_normalised_equality", """
SELECT match_id, lower(trim(toss_winner)) = lower(trim(winner)) AS toss_winner_won FROM clean_matches""")
def _f16(t):
    return t.clean_matches.select("match_id", (E.norm_key("toss_winner") == E.norm_key("winner")).alias("toss_winner_won"))


@query("f17_over_axis", "SELECT match_id, seq, over_num + ball_num / 10 AS over_ball FROM deliveries")
def _f17(t):
    return t.deliveries.select("match_id", "seq", E.over_axis("over_num", "ball_num").alias("over_ball"))

"""Registered source and sink queries (S rows). Raw files are first written
by Spark from the driver tables into the shared checkpoint folder, then read
back with the raw readers, so every query's work grows with the tables."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import functions as F

from wicketlake.plans import silver
from wicketlake.plans.registry import query
from wicketlake.session import scratch_path
from wicketlake.sources import raw, schemas, sinks


def _ball_files(t):
    path = scratch_path(t.spark, "ball-files")
    raw.write_ball_files(t.deliveries, path)
    return path


def _info_files(t):
    path = scratch_path(t.spark, "info-files")
    raw.write_info_files(t.matches, t.deliveries, path)
    return path


_BALL_TEXT = """
SELECT match_id, CAST(inning AS VARCHAR) AS innings, concat(CAST(over_num AS VARCHAR), '.', CAST(ball_num AS VARCHAR)) AS ball,
  batting_team, striker, non_striker, bowler, CAST(batsman_runs AS VARCHAR) AS runs_off_bat, CAST(extra_runs AS VARCHAR) AS extras,
  CASE WHEN is_wicket THEN dismissal_kind END AS wicket_type, player_dismissed
FROM (SELECT *, batsman AS striker FROM deliveries) d"""
_BALL_COLUMNS = ["match_id", "innings", "ball", "batting_team", "striker", "non_striker", "bowler", "runs_off_bat", "extras",
                 "wicket_type", "player_dismissed"]


@query("s1_text_csv_scan", _BALL_TEXT)
def _s1(t):
    return raw.read_text_csv(t.spark, _ball_files(t) + "/*.csv", columns=raw.BALL_COLUMNS).select(*_BALL_COLUMNS)


@query("s2_many_file_ball_scan", """
SELECT match_id, count(*) AS balls, CAST(sum(batsman_runs + extra_runs) AS BIGINT) AS runs, count(player_dismissed) AS outs
FROM deliveries GROUP BY 1""")
def _s2(t):
    balls = raw.read_ball_files(t.spark, _ball_files(t), key_pattern=None)
    runs = F.col("runs_off_bat").cast("int") + F.col("extras").cast("int")
    return balls.groupBy("match_id").agg(F.count("*").alias("balls"), F.sum(runs).alias("runs"),
                                         F.count("player_dismissed").alias("outs"))


@query("s3_s4_info_files_to_matches", """
SELECT match_id AS match_no, team1, team2, replace(strftime(match_date, '%Y/%m/%d'), '/', '-') AS date, venue, toss_winner, toss_decision,
  CASE WHEN winner = 'No Result' THEN '' ELSE winner END AS winner, margin, gender FROM matches""")
def _s3(t):
    m = raw.info_to_matches(raw.read_info_archive(t.spark, _info_files(t)))
    return m.select("match_no", "team1", "team2", "date", "venue", "toss_winner", "toss_decision", "winner",
                    "margin", "gender")


@query("s3_info_files_to_squads", """
SELECT DISTINCT team, player_name, 'Unknown' AS role, 'Playing XI' AS designation FROM
  (SELECT batting_team AS team, batsman AS player_name FROM deliveries UNION ALL SELECT bowling_team, bowler FROM deliveries) x""")
def _s3b(t):
    return raw.info_to_squads(raw.read_info_archive(t.spark, _info_files(t)))


@query("s5_normalised_columns", """
SELECT o_orderkey AS order_key, o_custkey AS customer_key FROM orders""")
def _s5(t):
    df = t.orders.select(F.col("o_orderkey").alias(" Order Key"), F.col("o_custkey").alias("Customer Key "))
    return raw.normalise_columns(df)


@query("s6_rename_keep", "SELECT o_orderkey AS order_id, o_totalprice AS price FROM orders")
def _s6(t):
    df = t.orders.withColumnsRenamed({"o_orderkey": "order_id", "o_totalprice": "price"})
    return df.select(*[c for c in ["order_id", "price", "no_such_column"] if c in df.columns])


@query("s7_drop_all_null_rows", """
SELECT * FROM (SELECT CASE WHEN o_orderkey % 17 = 4 THEN NULL ELSE price_text END AS a,
  CASE WHEN o_orderkey % 17 = 4 THEN NULL ELSE cust_text END AS b FROM dirty_orders) x WHERE a IS NOT NULL OR b IS NOT NULL""")
def _s7(t):
    d = t.dirty_orders.select(F.col("price_text").alias("a"), F.col("cust_text").alias("b"))
    return d.na.drop(how="all")


@query("s9_append_with_audit", "SELECT match_id, winner, true AS audited FROM clean_matches")
def _s9(t):
    path = scratch_path(t.spark, "matches-audit")
    for gender in ("male", "female"):
        sinks.append_with_audit(t.clean_matches.filter(F.col("gender") == gender), path)
    out = t.spark.read.parquet(path)
    return out.select("match_id", "winner", F.col(sinks.AUDIT).isNotNull().alias("audited"))


@query("s10_replace_table", "SELECT match_id, match_date, winner, win_by_runs FROM clean_matches")
def _s10(t):
    path = scratch_path(t.spark, "matches-table")
    sinks.replace_table(t.clean_matches.withColumn("winner", F.lit("stale")), path)
    sinks.replace_table(t.clean_matches, path)
    return t.spark.read.parquet(path).select("match_id", "match_date", "winner", "win_by_runs")


@query("s11_sql_scan", "SELECT batting_team, count(*) AS balls FROM deliveries GROUP BY 1")
def _s11(t):
    return t.spark.sql("SELECT batting_team, count(*) AS balls FROM {d} GROUP BY batting_team", d=t.deliveries)


@query("s12_typed_schemas", """
SELECT match_id, match_date, win_by_runs, is_day_night, win_by_runs + 1 AS next_margin FROM clean_matches""")
def _s12(t):
    text = t.clean_matches.select(*[F.col(c).cast("string").alias(c) for c in t.clean_matches.columns])
    typed = schemas.conform(text, schemas.CLEAN_MATCHES)
    return typed.select("match_id", "match_date", "win_by_runs", "is_day_night", (F.col("win_by_runs") + 1).alias("next_margin"))


@query("s13_layer_reset", """
SELECT 'layer_matches' AS table_name, count(*) AS rows_before, false AS exists_after FROM clean_matches
UNION ALL SELECT 'layer_venues', count(*), false FROM venues""")
def _s13(t):
    # Names of this run only, so no table of the user's catalogue is touched.
    run = uuid4().hex[:12]
    tables = {f"{name}_{run}": (name, df) for name, df in (("layer_matches", t.clean_matches), ("layer_venues", t.venues))}
    rows = []
    for name, (layer, df) in tables.items():
        df.write.option("path", scratch_path(t.spark, name)).saveAsTable(name)
        rows.append((layer, t.spark.table(name).count(), name))
    sinks.reset_tables(t.spark, list(tables))
    return t.spark.createDataFrame([(layer, n, t.spark.catalog.tableExists(name)) for layer, n, name in rows],
                                   "table_name string, rows_before bigint, exists_after boolean")


@query("s14_s15_result_sinks", "SELECT player_id, player_name, runs, role FROM players")
def _s14(t):
    base = scratch_path(t.spark, "results")
    sinks.write_csv(t.players, base + "/csv")
    sinks.write_json_report(t.players.select("player_id", "role"), base + "/json")
    table = t.spark.read.option("header", True).csv(base + "/csv").select("player_id", "player_name", F.col("runs").cast("long").alias("runs"))
    return table.join(t.spark.read.json(base + "/json"), "player_id")


@query("s15_metrics_merge", """
SELECT 'runs' AS model, 'total' AS metric, CAST(sum(total_runs) AS DOUBLE) AS value FROM deliveries
UNION ALL SELECT 'balls', 'total', CAST(count(*) AS DOUBLE) FROM deliveries""")
def _s15(t):
    def rows(model, value):
        return t.deliveries.agg(value.cast("double").alias("value")).select(F.lit(model).alias("model"), F.lit("total").alias("metric"), "value")

    path = scratch_path(t.spark, "metrics")
    old = sinks.merge_metrics(rows("runs", F.lit(-1)), rows("balls", F.count("*")))
    sinks.write_json_report(old, path)
    return sinks.merge_metrics(t.spark.read.json(path).select("model", "metric", "value"), rows("runs", F.sum("total_runs")))


@query("s18_schema_drift_columns", "SELECT stadium_name AS venue_name, city FROM venues")
def _s18(t):
    v = t.venues.drop("city").withColumnRenamed("stadium_name", "venue_name")
    name = F.col("venue_name") if "venue_name" in v.columns else F.col("stadium_name")
    city = F.col("city") if "city" in v.columns else F.regexp_replace(name, "^VENUE_", "CITY_")
    return v.select(name.alias("venue_name"), city.alias("city"))

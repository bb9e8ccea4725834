"""Registered feature and model queries (M rows, A51, J8).

Feature matrices are compared with DuckDB; trained models are checked by
invariants in the tests (MLlib and the reference's libraries differ, trap 16).
Trained pipelines are filed in the model store (S16) under a digest of their
rows, parameters and features; metric and scoring queries of this and later
applications load them from there and train only where one is missing.
"""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from wicketlake.ml import attribution as AT
from wicketlake.ml import features as MF
from wicketlake.ml import models as M
from wicketlake.ml.registry import stored
from wicketlake.operators import aggregates as A
from wicketlake.plans.q_aggregates import TEAM_STATS_SQL
from wicketlake.plans.registry import query
from wicketlake.session import scratch_path
from wicketlake.sources import sinks

_TS = TEAM_STATS_SQL.strip()
assert _TS.startswith("WITH ")
_TS_CTES = _TS[5:_TS.rindex("SELECT team, coalesce(avg_runs_per_ball")].rstrip().rstrip(",")
_TS_FINAL = _TS[_TS.rindex("SELECT team, coalesce(avg_runs_per_ball"):]

MATCH_FEATURES_SQL = f"""
{_TS_CTES},
ts AS ({_TS_FINAL}),
mf AS (SELECT m.match_id, m.team1, m.team2,
  a.avg_runs_per_ball - b.avg_runs_per_ball AS run_rate_diff, a.six_rate - b.six_rate AS six_rate_diff,
  a.four_rate - b.four_rate AS four_rate_diff, a.pp_run_rate - b.pp_run_rate AS pp_run_rate_diff,
  a.death_run_rate - b.death_run_rate AS death_run_rate_diff, a.avg_wickets_per_ball - b.avg_wickets_per_ball AS wicket_rate_diff,
  a.death_wicket_rate - b.death_wicket_rate AS death_wkt_rate_diff, a.avg_economy - b.avg_economy AS economy_diff,
  a.win_rate AS win_rate_t1, b.win_rate AS win_rate_t2, a.win_rate - b.win_rate AS win_rate_diff,
  CAST(m.toss_winner = m.team1 AS INTEGER) AS toss_team1, CAST(m.toss_decision = 'bat' AS INTEGER) AS toss_bat_first,
  CAST(m.toss_winner = m.team1 AS INTEGER) * CAST(m.toss_decision = 'bat' AS INTEGER) AS toss_advantage,
  CAST(m.tournament_phase IN ('Semi Final', 'Final') AS INTEGER) AS is_knockout,
  CAST(m.winner = m.team1 AS INTEGER) AS target
  FROM clean_matches m JOIN ts a ON a.team = m.team1 JOIN ts b ON b.team = m.team2)"""


@query("m1_match_features", f"WITH {MATCH_FEATURES_SQL}\nSELECT * FROM mf")
def _m1(t):
    return MF.match_features(t.team_stats, t.clean_matches)


@query("j8_two_sided_dimension_join", f"WITH {MATCH_FEATURES_SQL}\nSELECT match_id, win_rate_t1, win_rate_t2 FROM mf")
def _j8(t):
    return MF.match_features(t.team_stats, t.clean_matches).select("match_id", "win_rate_t1", "win_rate_t2")


@query("m2_player_features", """
SELECT coalesce(b.batsman, w.bowler) AS player_name, coalesce(total_runs, 0) AS total_runs, coalesce(balls_faced, 0) AS balls_faced,
  coalesce(strike_rate_live, 0) AS strike_rate_live, coalesce(sixes, 0) AS sixes, coalesce(fours, 0) AS fours,
  coalesce(wickets, 0) AS wickets, coalesce(economy_live, 0) AS economy_live
FROM (SELECT batsman, CAST(sum(batsman_runs) AS BIGINT) AS total_runs, count(*) AS balls_faced, count_if(batsman_runs = 6) AS sixes,
        count_if(batsman_runs = 4) AS fours, sum(batsman_runs) / CASE WHEN count(*) = 0 THEN 1 ELSE count(*) END * 100 AS strike_rate_live
      FROM deliveries GROUP BY 1) b
FULL JOIN (SELECT bowler, count_if(is_wicket) AS wickets,
        sum(total_runs) / CASE WHEN count(*) / 6 = 0 THEN 1 ELSE count(*) / 6 END AS economy_live FROM deliveries GROUP BY 1) w
ON b.batsman = w.bowler""")
def _m2(t):
    return MF.player_features(t.deliveries)


@query("m3_train_test_split", f"""
WITH {MATCH_FEATURES_SQL},
h AS (SELECT match_id, target, CAST(concat('0x', substr(md5(match_id), 1, 8)) AS BIGINT) % 1000 AS bucket FROM mf),
c AS (SELECT target, bucket, sum(count(*)) OVER (PARTITION BY target ORDER BY bucket) AS upto,
        sum(count(*)) OVER (PARTITION BY target) AS total FROM h GROUP BY 1, 2)
SELECT match_id, h.target, CASE WHEN upto * 100 <= total * 80 THEN 'train' ELSE 'test' END AS split
FROM h JOIN c ON c.target = h.target AND c.bucket = h.bucket""")
def _m3(t):
    return M.split(_match_features(t), "match_id", "target").select("match_id", "target", "split")


def _match_features(t):
    return t.layer("match_features", lambda: MF.match_features(t.team_stats, t.clean_matches))


def _outcome(t):
    """The outcome model and its scored test rows."""
    feats, size = _match_features(t), {"max_iter": 200, "depth": 4, "step": 0.05}
    model = stored("outcome", feats, size, MF.MATCH_FEATURES, lambda: M.train_outcome_model(feats, MF.MATCH_FEATURES, **size)[0])
    return model, model.transform(M.split(_match_features(t), "match_id", "target").filter("split = 'test'"))


@query("m4_outcome_predictions")
def _m4(t):
    return _outcome(t)[1].select("match_id", "target", "prediction", F.col("probability").cast("string").alias("probability"))


@query("m5_classification_metrics")
def _m5(t):
    return M.classification_metrics(t.spark, _outcome(t)[1])


@query("m6_cross_validated_accuracy")
def _m6(t):
    return M.cross_validated_accuracy(t.spark, _match_features(t), MF.MATCH_FEATURES)


@query("m7_feature_importances")
def _m7(t):
    return M.importances(t.spark, _outcome(t)[0], MF.MATCH_FEATURES)


INNINGS_COLS = ["total_balls", "wickets_lost", "sixes", "fours", "pp_runs", "pp_run_rate", "boundary_pct"]


def _innings(t):
    return t.layer("innings_features", lambda: A.innings_features(t.deliveries))


def _score(t):
    innings, size = _innings(t), {"max_iter": 300, "depth": 5, "step": 0.05}
    return stored("score", innings, size, INNINGS_COLS, lambda: M.train_score_model(innings, INNINGS_COLS, **size)[0])


def _scored_innings(t):
    keyed = _innings(t).withColumn("_key", F.concat_ws("|", "match_id", "batting_team"))
    return _score(t).transform(M.split(keyed, "_key").filter("split = 'test'"))


@query("m8_score_predictions")
def _m8(t):
    return _scored_innings(t).select("match_id", "batting_team", "total_runs", "prediction")


@query("m9_regression_metrics")
def _m9(t):
    return M.regression_metrics(t.spark, _scored_innings(t))


def _clustered(t):
    feats = t.layer("player_features", lambda: MF.player_features(t.deliveries))
    size = {"k": 5, "starts": 10, "max_iter": 300}
    model = stored("clusters", feats, size, MF.CLUSTER_FEATURES, lambda: M.cluster_players(feats, MF.CLUSTER_FEATURES, **size)[0])
    return model.transform(feats).drop("_raw", "_cluster")


@query("m10_player_clusters")
def _m10(t):
    kind = F.create_map(*[F.lit(x) for kv in M.PLAYER_TYPES.items() for x in kv])
    return _clustered(t).select("player_name", "cluster", kind[F.col("cluster")].alias("player_type"))


@query("m11_elbow_scan")
def _m11(t):
    return M.elbow(MF.player_features(t.deliveries), MF.CLUSTER_FEATURES)


@query("m12_silhouette")
def _m12(t):
    value = M.silhouette(_clustered(t))
    return t.spark.createDataFrame([("silhouette", float(value))], "metric string, value double")


@query("a51_cluster_profile")
def _a51(t):
    return M.cluster_profile(_clustered(t), MF.CLUSTER_FEATURES)


@query("j14_xi_player_types")
def _j14(t):
    """The form XI with the cluster label of each player."""
    from wicketlake.operators import selection as G
    form = A.recent_form(t.deliveries, t.clean_matches)
    types = _m10(t).select("player_name", "player_type")
    feats = t.layer("player_features", lambda: MF.player_features(t.deliveries))
    xi = G.form_xi(t.players, feats, form)
    return xi.join(types, "player_name", "left").select("country", "rank", "player_name", "player_type", "recent_runs",
                                                        "recent_wickets", "selection_score")


@query("s16_saved_model_scores")
def _s16(t):
    """Train, save, load, and score with both; the rows say whether they agree."""
    feats = t.layer("player_features", lambda: MF.player_features(t.deliveries))
    model, rows = M.cluster_players(feats, MF.CLUSTER_FEATURES, starts=1)
    path = scratch_path(t.spark, "model-round-trip")
    sinks.save_model(model, path)
    loaded = sinks.load_pipeline_model(path).transform(feats).select("player_name", F.col("cluster").alias("loaded"))
    return rows.select("player_name", "cluster").join(loaded, "player_name").select(
        "player_name", "cluster", (F.col("cluster") == F.col("loaded")).alias("same"))


@query("m13_match_baskets", """
SELECT match_id, [CASE WHEN toss_winner = winner THEN 'toss_won' ELSE 'toss_lost' END,
  CASE WHEN toss_decision = 'bat' THEN 'chose_bat' ELSE 'chose_bowl' END,
  CASE WHEN tournament_phase IN ('Semi Final', 'Final') THEN 'knockout_match' ELSE 'group_match' END,
  CASE WHEN coalesce(is_day_night, false) THEN 'day_night' ELSE 'day_match' END,
  CASE WHEN winner = team1 THEN 'team1_won' ELSE 'team2_won' END] AS items FROM clean_matches""")
def _m13(t):
    return MF.baskets(t.clean_matches)


_ITEMSETS_SQL = """
items AS MATERIALIZED (SELECT CASE WHEN toss_winner = winner THEN 'toss_won' ELSE 'toss_lost' END AS a,
  CASE WHEN toss_decision = 'bat' THEN 'chose_bat' ELSE 'chose_bowl' END AS b,
  CASE WHEN tournament_phase IN ('Semi Final', 'Final') THEN 'knockout_match' ELSE 'group_match' END AS c,
  CASE WHEN coalesce(is_day_night, false) THEN 'day_night' ELSE 'day_match' END AS d,
  CASE WHEN winner = team1 THEN 'team1_won' ELSE 'team2_won' END AS e FROM clean_matches),
total AS MATERIALIZED (SELECT count(*) AS n FROM items),
sets AS MATERIALIZED (SELECT list_sort(list_filter([a, b, c, d, e], lambda x: x IS NOT NULL)) AS items, freq FROM
  (SELECT a, b, c, d, e, count(*) AS freq FROM items GROUP BY CUBE (a, b, c, d, e)) g
  WHERE freq >= 0.2 * (SELECT n FROM total) AND coalesce(a, b, c, d, e) IS NOT NULL)"""


@query("m14_frequent_itemsets", f"""
WITH {_ITEMSETS_SQL}
SELECT array_to_string(items, ',') AS itemset, freq FROM sets""")
def _m14(t):
    model = M.frequent_itemsets(MF.baskets(t.clean_matches))
    return model.freqItemsets.select(F.array_join(F.sort_array("items"), ",").alias("itemset"), "freq")


@query("m15_association_rules", f"""
WITH {_ITEMSETS_SQL},
r AS (SELECT x.items AS ant, list_sort(list_filter(f.items, lambda i: NOT list_contains(x.items, i))) AS cons, f.freq AS full_freq, x.freq AS ant_freq
      FROM sets f JOIN sets x ON len(x.items) < len(f.items) AND list_has_all(f.items, x.items))
SELECT array_to_string(ant, ',') AS antecedents, array_to_string(cons, ',') AS consequents, full_freq / n AS support,
  full_freq / ant_freq AS confidence, full_freq / ant_freq / (c.freq / n) AS lift
FROM r JOIN sets c ON c.items = r.cons, total
WHERE full_freq / ant_freq >= 0.5 AND len(list_filter(cons, lambda i: contains(i, 'won'))) > 0""")
def _m15(t):
    b = MF.baskets(t.clean_matches)
    sets = M.frequent_itemsets(b).freqItemsets
    return M.association_rules(sets, b).select(
        F.array_join("ant", ",").alias("antecedents"), F.array_join("cons", ",").alias("consequents"),
        "support", "confidence", "lift")


@query("m16_upset_labels", f"""
WITH {MATCH_FEATURES_SQL}
SELECT match_id, win_rate_diff, target, CAST(win_rate_diff > 0.05 AND target = 0 AS INTEGER) AS is_upset FROM mf""")
def _m16(t):
    f = MF.upset_labels(MF.match_features(t.team_stats, t.clean_matches))
    return f.select("match_id", "win_rate_diff", "target", "is_upset")


UPSET_COLS = ["win_rate_diff", "run_rate_diff", "toss_team1", "toss_bat_first", "pp_run_rate_diff",
              "death_wkt_rate_diff", "is_knockout"]


def _labelled(t):
    return MF.upset_labels(_match_features(t))


def _upset(t):
    labelled = _labelled(t)
    return stored("upset", labelled, {"max_iter": 1000}, UPSET_COLS, lambda: M.train_upset_model(labelled, UPSET_COLS)[0])


@query("m17_upset_model")
def _m17(t):
    test = M.split(_labelled(t), "match_id", "is_upset").filter("split = 'test'")
    return _upset(t).transform(test).select("match_id", "is_upset", "prediction")


@query("m18_permutation_importance")
def _m18(t):
    return M.permutation_importance(_outcome(t)[0], _match_features(t), MF.MATCH_FEATURES)


def _attributions(t):
    """Every match with the outcome model's exact attributions; the training
    rows are the background."""
    model = _outcome(t)[0]
    train = M.split(_match_features(t), "match_id", "target").filter("split = 'train'")
    explainer = AT.Explainer.of(model, train, MF.MATCH_FEATURES)
    return AT.row_attributions(explainer, _match_features(t), MF.MATCH_FEATURES, "match_id")


@query("m18_feature_attribution")
def _m18_attribution(t):
    return AT.mean_attributions(_attributions(t))


@query("m18_match_attributions")
def _m18_rows(t):
    return _attributions(t)


@query("m19_score_match_requests")
def _m19(t):
    # Requests: every fixture of the data, scored with the stored pipeline
    # on features built from the same team statistics as training (trap 20).
    p = vector_to_array("probability")[1]
    return _outcome(t)[0].transform(_match_features(t)).select(
        "match_id", "team1", "team2", p.alias("team1_win_prob"),
        F.when(p > 0.5, F.col("team1")).otherwise(F.col("team2")).alias("predicted_winner"))


@query("m20_score_innings_requests")
def _m20(t):
    whole = F.col("prediction").cast("int")
    return _score(t).transform(_innings(t)).select(
        "match_id", "batting_team", "prediction", F.when(whole > 160, "above 160").otherwise("below 160").alias("band"))


@query("m21_score_upset_requests")
def _m21(t):
    p = vector_to_array(F.col("probability"))[1] * 100
    return _upset(t).transform(_labelled(t)).select("match_id", p.alias("upset_pct"),
                                                    F.when(p > 35, "HIGH RISK").otherwise("normal").alias("risk"))

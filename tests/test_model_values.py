"""Model queries against values recomputed from their rows and models."""

import math

import numpy as np
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from wicketlake.ml import features as MF
from wicketlake.ml import models as M
from wicketlake.operators import aggregates as A
from wicketlake.operators import selection as G
from wicketlake.plans import q_ml
from wicketlake.sources.tables import Tables

SF = "/root/testdata/sf0.001"
SMALL = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def t(spark):
    return Tables(spark, SF)


@pytest.fixture(scope="module")
def small(spark):
    return Tables(spark, SMALL)


@pytest.fixture(scope="module")
def outcome(small):
    feats = q_ml._match_features(small)
    return M.train_outcome_model(feats, MF.MATCH_FEATURES, max_iter=5)


def test_m5_classification_report_by_hand(spark, outcome):
    _, _, scored = outcome
    rows = [(r.target, r.prediction, r.p) for r in scored.select("target", "prediction", vector_to_array("probability")[1].alias("p")).collect()]
    report = {r.metric: r.value for r in M.classification_metrics(spark, scored).collect()}
    n = len(rows)
    assert report["accuracy"] == pytest.approx(sum(y == z for y, z, _ in rows) / n)
    f1s = []
    for label in (0, 1):
        hit = sum(y == z == label for y, z, _ in rows)
        said, real = sum(z == label for _, z, _ in rows), sum(y == label for y, _, _ in rows)
        precision, recall = hit / said if said else 0.0, hit / real if real else 0.0
        f1 = 2 * precision * recall / (precision + recall) if precision + recall else 0.0
        assert report[f"precision_{label}"] == pytest.approx(precision) and report[f"recall_{label}"] == pytest.approx(recall)
        assert report[f"f1_{label}"] == pytest.approx(f1) and report[f"support_{label}"] == real
        f1s.append(f1 * real / n)
    assert report["f1_weighted"] == pytest.approx(sum(f1s))
    pos, neg = [p for y, _, p in rows if y == 1], [p for y, _, p in rows if y == 0]
    auc = sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / (len(pos) * len(neg))
    assert report["roc_auc"] == pytest.approx(auc, abs=1e-9)


def test_m6_is_the_mean_of_five_folds(spark, small):
    feats = q_ml._match_features(small)
    got = M.cross_validated_accuracy(spark, feats, MF.MATCH_FEATURES, max_iter=3).first().value
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.feature import VectorAssembler

    data = M.dealt_for_training(feats.withColumn("fold", M.hash_bucket("match_id", 5).cast("int")), "match_id")
    want = []
    for k in range(5):
        gbt = GBTClassifier(labelCol="target", featuresCol="features", maxIter=3, maxDepth=4, stepSize=0.05, subsamplingRate=0.8,
                            featureSubsetStrategy="0.8", cacheNodeIds=True, checkpointInterval=10, seed=M.SEED)
        model = Pipeline(stages=[VectorAssembler(inputCols=MF.MATCH_FEATURES, outputCol="features"), gbt]).fit(data.filter(F.col("fold") != k))
        rows = model.transform(data.filter(F.col("fold") == k)).select("target", "prediction").collect()
        want.append(sum(r.target == r.prediction for r in rows) / len(rows))
    assert len(want) == 5 and got == pytest.approx(sum(want) / 5, abs=0.02)


def test_m7_importances(spark, outcome):
    model = outcome[0]
    whole = dict(zip(MF.MATCH_FEATURES, model.stages[-1].featureImportances.toArray()))
    assert sum(whole.values()) == pytest.approx(1)
    got = [(r.feature, r.importance) for r in M.importances(spark, model, MF.MATCH_FEATURES).collect()]
    assert len(got) == 5 and [v for _, v in got] == sorted(whole.values(), reverse=True)[:5]
    assert all(whole[f] == v for f, v in got)


def test_m8_m9_regression_by_hand(spark, small):
    innings = q_ml._innings(small)
    model, scored = M.train_score_model(innings, q_ml.INNINGS_COLS, max_iter=5)
    rows = [(r.total_runs, r.prediction) for r in scored.select("total_runs", "prediction").collect()]
    report = {r.metric: r.value for r in M.regression_metrics(spark, scored).collect()}
    errors = [y - p for y, p in rows]
    mean = sum(y for y, _ in rows) / len(rows)
    assert report["rmse"] == pytest.approx(math.sqrt(sum(e * e for e in errors) / len(rows)))
    assert report["mae"] == pytest.approx(sum(map(abs, errors)) / len(rows))
    assert report["r2"] == pytest.approx(1 - sum(e * e for e in errors) / sum((y - mean) ** 2 for y, _ in rows))
    assert report["r2"] > 0
    # The prediction of a row is the weighted sum of its trees.
    gbt, some = model.stages[-1], model.transform(innings.limit(5)).select("features", "prediction").collect()
    for r in some:
        assert r.prediction == pytest.approx(sum(w * tree.predict(r.features) for tree, w in zip(gbt.trees, gbt.treeWeights)))


def test_m10_m11_m12_clusters_by_hand(spark, t):
    feats = MF.player_features(t.deliveries)
    model, rows = M.cluster_players(feats, MF.CLUSTER_FEATURES, k=5, starts=3, max_iter=30)
    got = rows.select("features", "cluster").collect()
    x, label = np.array([r.features.toArray() for r in got]), np.array([r.cluster for r in got])
    raw = np.array([[float(r[c]) for c in MF.CLUSTER_FEATURES] for r in feats.collect()])
    assert np.allclose(sorted(x[:, 0]), sorted((raw[:, 0] - raw[:, 0].mean()) / raw[:, 0].std(ddof=1)))
    centres = np.array([x[label == k].mean(axis=0) for k in sorted(set(label))])
    assert [tuple(c) for c in centres] == sorted(tuple(c) for c in centres)  # numbered in the order of the centroids
    assert (((x[:, None] - centres[None]) ** 2).sum(2).argmin(1) == label).mean() > 0.97
    # Silhouette with squared distances.
    d = ((x[:, None] - x[None]) ** 2).sum(2)
    values = []
    for i in range(len(x)):
        own = label == label[i]
        if own.sum() == 1:
            values.append(0.0)
            continue
        a = d[i][own].sum() / (own.sum() - 1)
        b = min(d[i][label == k].mean() for k in set(label) if k != label[i])
        values.append((b - a) / max(a, b))
    assert M.silhouette(rows) == pytest.approx(np.mean(values), abs=1e-6)
    curve = [(r.k, r.inertia) for r in M.elbow(feats, MF.CLUSTER_FEATURES, ks=(2, 4, 8), starts=2).collect()]
    assert ((x - x.mean(axis=0)) ** 2).sum() > curve[0][1] > curve[1][1] > curve[2][1]
    inertia = sum(((x[label == k] - x[label == k].mean(axis=0)) ** 2).sum() for k in set(label))
    best = min(m.summary.trainingCost for m in [model.stages[-2]]) if model.stages[-2].hasSummary else inertia
    assert best == pytest.approx(inertia, rel=0.05)


def test_a51_profile_by_hand(spark, t):
    feats = MF.player_features(t.deliveries)
    _, rows = M.cluster_players(feats, MF.CLUSTER_FEATURES, k=3, starts=1, max_iter=10)
    whole = rows.collect()
    profile = {r.cluster: r for r in M.cluster_profile(rows, MF.CLUSTER_FEATURES).collect()}
    assert sum(p["size"] for p in profile.values()) == len(whole)
    for k, p in profile.items():
        own = [r for r in whole if r.cluster == k]
        assert p["size"] == len(own)
        for c in MF.CLUSTER_FEATURES:
            assert p[c] == pytest.approx(sum(float(r[c]) for r in own) / len(own))


def test_j14_types_join_the_form_xi(spark, t):
    feats = MF.player_features(t.deliveries)
    form = A.recent_form(t.deliveries, t.clean_matches)
    xi = G.form_xi(t.players, feats, form)
    _, rows = M.cluster_players(feats, MF.CLUSTER_FEATURES, k=5, starts=1, max_iter=10)
    kind = {r.player_name: M.PLAYER_TYPES[r.cluster] for r in rows.collect()}
    labels = F.create_map(*[F.lit(x) for kv in M.PLAYER_TYPES.items() for x in kv])
    types = rows.select("player_name", labels[F.col("cluster")].alias("player_type"))
    got = xi.join(types, "player_name", "left").collect()
    assert len(got) == xi.count() and all(r.player_type == kind.get(r.player_name) for r in got)


def test_m17_upset_weights(spark, small):
    labelled = q_ml._labelled(small)
    model, scored = M.train_upset_model(labelled, q_ml.UPSET_COLS)
    train = M.split(labelled, "match_id", "is_upset").filter("split = 'train'").collect()
    lr = model.stages[-1]
    x = np.array([[float(r[c]) for c in q_ml.UPSET_COLS] for r in train])
    y = np.array([r.is_upset for r in train], float)
    w = np.where(y == 1, len(y) / (2 * y.sum()), len(y) / (2 * (len(y) - y.sum())))
    p = 1 / (1 + np.exp(-(x @ lr.coefficients.toArray() + lr.intercept)))
    # At the optimum of the weighted likelihood the gradient vanishes.
    gradient = np.append((w * (p - y)) @ x, (w * (p - y)).sum()) / w.sum()
    assert np.abs(gradient).max() < 1e-3
    for r in scored.select("features", "prediction").limit(20).collect():
        assert r.prediction == float(lr.coefficients.dot(r.features) + lr.intercept > 0)


def test_m19_m20_m21_thresholds_from_scores(spark, small, outcome, monkeypatch):
    model = outcome[0]
    score, _ = M.train_score_model(q_ml._innings(small), q_ml.INNINGS_COLS, max_iter=3)
    upset, _ = M.train_upset_model(q_ml._labelled(small), q_ml.UPSET_COLS)
    monkeypatch.setattr(q_ml, "stored", lambda name, *_: {"outcome": model, "score": score, "upset": upset}[name])
    raw = {r.match_id: r for r in model.transform(q_ml._match_features(small)).select("match_id", "team1", "team2", vector_to_array("rawPrediction")[1].alias("m")).collect()}
    got = q_ml._m19(small).collect()
    assert len(got) == len(raw)
    for r in got:
        p = 1 / (1 + math.exp(-2 * raw[r.match_id].m))
        assert r.team1_win_prob == pytest.approx(p) and r.predicted_winner == (r.team1 if p > 0.5 else r.team2)
    for r in q_ml._m20(small).collect():
        assert r.band == ("above 160" if int(r.prediction) > 160 else "below 160")
    lr = upset.stages[-1]
    rows = {r.match_id: r for r in q_ml._labelled(small).collect()}
    for r in q_ml._m21(small).collect():
        z = sum(c * float(rows[r.match_id][f]) for c, f in zip(lr.coefficients.toArray(), q_ml.UPSET_COLS)) + lr.intercept
        assert r.upset_pct == pytest.approx(100 / (1 + math.exp(-z))) and r.risk == ("HIGH RISK" if r.upset_pct > 35 else "normal")


def test_x4_vectors_by_hand(spark):
    from wicketlake.retrieval import documents as X

    texts = ["a b b", "b c", "a a a d", ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.vector for r in X.text_vectors(docs).collect()}
    words = [t.split() for t in texts]
    for i, ws in enumerate(words):
        weights = [ws.count(w) * math.log((len(texts) + 1) / (sum(w in o for o in words) + 1)) for w in set(ws)]
        norm = math.sqrt(sum(v * v for v in weights))
        values = sorted(v for v in got[i].toArray() if v)
        if norm:
            assert values == pytest.approx(sorted(v / norm for v in weights))

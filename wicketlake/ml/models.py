"""MLlib jobs (M3 to M12, M14 to M21). Training runs distributed in MLlib;
metrics and importances come back as small DataFrames of rows."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.clustering import KMeans
from pyspark.ml.evaluation import (BinaryClassificationEvaluator, ClusteringEvaluator,
                                   MulticlassClassificationEvaluator, RegressionEvaluator)
from pyspark.ml.feature import SQLTransformer, StandardScaler, VectorAssembler
from pyspark.ml.fpm import FPGrowth
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wicketlake.session import scratch_path

SEED = 42


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written under the shared checkpoint folder and read back: the
    many passes of a training read a table, not the lineage behind it."""
    path = scratch_path(df.sparkSession, f"ml-{name}")
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def hash_bucket(key: str, buckets: int) -> Column:
    """A bucket of the key's MD5 digest: the same on every partitioning, rerun
    and engine."""
    return F.pmod(F.conv(F.substring(F.md5(F.col(key).cast("string")), 1, 8), 16, 10).cast("long"), F.lit(buckets))


def split(df: DataFrame, key: str, label: str | None = None, train_pct: int = 80, buckets: int = 1000) -> DataFrame:
    """M3: a stable 80/20 split by hash buckets of the key, stratified by
    ``label`` if given: within each label the buckets are taken in order while
    their rows make up at most ``train_pct`` percent of the label. The
    histogram (labels x buckets rows) is a partial aggregate; no label's rows
    are gathered or sorted."""
    stratum = F.lit(0) if label is None else F.col(label)
    marked = df.withColumns({"_bucket": hash_bucket(key, buckets), "_stratum": stratum})
    hist = marked.groupBy("_stratum", "_bucket").agg(F.count("*").alias("_n"))
    upto = Window.partitionBy("_stratum").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    share = hist.select("_stratum", "_bucket", F.sum("_n").over(upto).alias("_upto"),
                        F.sum("_n").over(Window.partitionBy("_stratum")).alias("_all"))
    train = F.col("_upto") * 100 <= F.col("_all") * train_pct
    return (marked.join(share.select("_stratum", "_bucket", F.when(train, "train").otherwise("test").alias("split")),
                        ["_stratum", "_bucket"]).select(*df.columns, "split"))


def _metrics(spark: SparkSession, model: str, pairs: list[tuple[str, float]]) -> DataFrame:
    return spark.createDataFrame([(model, k, float(v)) for k, v in pairs], "model string, metric string, value double")


def train_outcome_model(features: DataFrame, cols: list[str], max_iter: int = 200, depth: int = 4,
                        step: float = 0.05) -> tuple[PipelineModel, DataFrame, DataFrame]:
    """M4: gradient-boosted trees on the match features (train split)."""
    data = dealt_for_training(split(features, "match_id", "target"), "match_id")
    gbt = GBTClassifier(labelCol="target", featuresCol="features", maxIter=max_iter, maxDepth=depth, stepSize=step,
                        subsamplingRate=0.8, featureSubsetStrategy="0.8", seed=SEED)
    pipe = Pipeline(stages=[VectorAssembler(inputCols=cols, outputCol="features"), gbt])
    model = pipe.fit(data.filter("split = 'train'"))
    return model, data.filter("split = 'train'"), model.transform(data.filter("split = 'test'"))


def classification_metrics(spark: SparkSession, scored: DataFrame) -> DataFrame:
    """M5: accuracy, weighted F1, ROC-AUC, and the per-class report
    (precision, recall, F1 and support of each class)."""
    acc = MulticlassClassificationEvaluator(labelCol="target", metricName="accuracy").evaluate(scored)
    f1 = MulticlassClassificationEvaluator(labelCol="target", metricName="weightedFMeasure").evaluate(scored)
    auc = BinaryClassificationEvaluator(labelCol="target", rawPredictionCol="rawPrediction").evaluate(scored)
    report = [("accuracy", acc), ("f1_weighted", f1), ("roc_auc", auc)]
    support = {float(r["target"]): r["n"] for r in scored.groupBy("target").agg(F.count("*").alias("n")).collect()}
    for label in (0.0, 1.0):
        for name, metric in (("precision", "precisionByLabel"), ("recall", "recallByLabel"), ("f1", "fMeasureByLabel")):
            ev = MulticlassClassificationEvaluator(labelCol="target", metricName=metric, metricLabel=label)
            report.append((f"{name}_{int(label)}", ev.evaluate(scored) if support.get(label) else 0.0))
        report.append((f"support_{int(label)}", support.get(label, 0)))
    return _metrics(spark, "match_outcome", report)


#: Rows of a training partition: a tree level is one job over all partitions,
#: so small tables take few of them.
TRAIN_ROWS = 50_000


def dealt_for_training(df: DataFrame, key: str) -> DataFrame:
    """``df`` in as many partitions as its rows need, dealt by ``key``, as a
    written table: boosting passes over it hundreds of times."""
    df = written(df, "training-rows")
    most = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = max(1, min(most, -(-df.count() // TRAIN_ROWS)))
    return df.coalesce(1) if parts == 1 else df.repartition(parts, key)


def cross_validated_accuracy(spark: SparkSession, features: DataFrame, cols: list[str], folds: int = 5,
                             max_iter: int = 200) -> DataFrame:
    """M6: k-fold accuracy with a hash fold column (stable folds): the mean of
    the folds' accuracies. The folds are trained side by side, each on the
    rows of the others; a fold without rows on either side is left out."""
    data = features.withColumn("fold", hash_bucket("match_id", folds).cast("int"))
    data = VectorAssembler(inputCols=cols, outputCol="features").transform(data).select("match_id", "fold", "target", "features")
    data = dealt_for_training(data, "match_id").persist()
    sizes = {r.fold: r["count"] for r in data.groupBy("fold").count().collect()}
    total = sum(sizes.values())
    gbt = GBTClassifier(labelCol="target", featuresCol="features", maxIter=max_iter, maxDepth=4, stepSize=0.05, subsamplingRate=0.8,
                        featureSubsetStrategy="0.8", cacheNodeIds=True, checkpointInterval=10, seed=SEED)

    def accuracy(fold: int) -> float:
        model = gbt.fit(data.filter(F.col("fold") != fold))
        scored = model.transform(data.filter(F.col("fold") == fold))
        return MulticlassClassificationEvaluator(labelCol="target", metricName="accuracy").evaluate(scored)

    used = [k for k, n in sorted(sizes.items()) if n < total]
    with ThreadPoolExecutor(folds) as pool:
        found = list(pool.map(inheritable_thread_target(spark)(accuracy), used))
    data.unpersist()
    return _metrics(spark, "match_outcome", [("cv_accuracy", sum(found) / len(found) if found else float("nan"))])


def importances(spark: SparkSession, model: PipelineModel, cols: list[str], top: int = 5) -> DataFrame:
    """M7: feature importances, top n."""
    imp = model.stages[-1].featureImportances.toArray()
    rows = sorted(zip(cols, imp), key=lambda x: -x[1])[:top]
    return spark.createDataFrame([(c, float(v)) for c, v in rows], "feature string, importance double")


def train_score_model(innings: DataFrame, cols: list[str], max_iter: int = 300, depth: int = 5,
                      step: float = 0.05) -> tuple[PipelineModel, DataFrame]:
    """M8: gradient-boosted regression of the innings total."""
    data = dealt_for_training(split(innings.withColumn("_key", F.concat_ws("|", "match_id", "batting_team")), "_key"), "_key")
    gbt = GBTRegressor(labelCol="total_runs", featuresCol="features", maxIter=max_iter, maxDepth=depth,
                       stepSize=step, subsamplingRate=0.8, featureSubsetStrategy="0.8", seed=SEED)
    pipe = Pipeline(stages=[VectorAssembler(inputCols=cols, outputCol="features"), gbt])
    model = pipe.fit(data.filter("split = 'train'"))
    return model, model.transform(data.filter("split = 'test'"))


def regression_metrics(spark: SparkSession, scored: DataFrame) -> DataFrame:
    """M9: RMSE, MAE, R2."""
    ev = RegressionEvaluator(labelCol="total_runs", predictionCol="prediction")
    return _metrics(spark, "score", [(m, ev.setMetricName(m).evaluate(scored)) for m in ("rmse", "mae", "r2")])


def _standardised(features: DataFrame, cols: list[str]) -> tuple[PipelineModel, DataFrame]:
    prep = Pipeline(stages=[VectorAssembler(inputCols=cols, outputCol="_raw"),
                            StandardScaler(inputCol="_raw", outputCol="features", withMean=True, withStd=True)]).fit(features)
    return prep, prep.transform(features)


def _best_of(data: DataFrame, k: int, starts: int, max_iter: int):
    """The K-Means model of least training cost of ``starts`` seeds."""
    models = (KMeans(k=k, maxIter=max_iter, seed=SEED + s, featuresCol="features", predictionCol="_cluster").fit(data)
              for s in range(starts))
    return min(models, key=lambda m: m.summary.trainingCost)


# Player types by cluster number, in the order of the centroids.
PLAYER_TYPES = {0: "Aggressive Batter", 1: "Anchor / Accumulator", 2: "Pure Bowler", 3: "All-Rounder", 4: "Death Specialist"}


def cluster_players(features: DataFrame, cols: list[str], k: int = 5, starts: int = 10,
                    max_iter: int = 300) -> tuple[PipelineModel, DataFrame]:
    """Standardise, K-Means with k clusters, best of ``starts`` seeds by
    training cost; clusters are renumbered by centroid order (trap 16). The
    renumbering is a stage of the returned pipeline, so a saved model labels
    like the returned rows."""
    features = written(features, "player-features")
    prep, data = _standardised(features, cols)
    best = _best_of(data, k, starts, max_iter)
    order = sorted(range(k), key=lambda i: tuple(best.clusterCenters()[i]))
    cases = " ".join(f"WHEN {c} THEN {i}" for i, c in enumerate(order))
    renumber = SQLTransformer(statement=f"SELECT *, CAST(CASE _cluster {cases} END AS INT) AS cluster FROM __THIS__")
    model = PipelineModel(stages=[*prep.stages, best, renumber])
    return model, model.transform(features).drop("_raw", "_cluster")


def elbow(features: DataFrame, cols: list[str], ks=range(2, 9), starts: int = 10) -> DataFrame:
    """Least training cost of ``starts`` seeds for k = 2..8."""
    _, data = _standardised(written(features, "player-features"), cols)
    rows = [(k, float(_best_of(data, k, starts, 300).summary.trainingCost)) for k in ks]
    return features.sparkSession.createDataFrame(rows, "k int, inertia double")


def silhouette(clustered: DataFrame) -> float:
    """Silhouette (squared Euclidean, as ClusteringEvaluator computes)."""
    return ClusteringEvaluator(featuresCol="features", predictionCol="cluster").evaluate(clustered)


def cluster_profile(clustered: DataFrame, cols: list[str]) -> DataFrame:
    """Centroids in original units and cluster sizes."""
    return clustered.groupBy("cluster").agg(F.count("*").alias("size"), *[F.avg(c).alias(c) for c in cols])


def frequent_itemsets(baskets: DataFrame, min_support: float = 0.2, min_confidence: float = 0.5):
    """FP-growth frequent itemsets (distributed)."""
    return FPGrowth(itemsCol="items", minSupport=min_support, minConfidence=min_confidence).fit(baskets)


def association_rules(itemsets: DataFrame, n_baskets: int | DataFrame, min_confidence: float = 0.5,
                      strict_won: bool = False) -> DataFrame:
    """Rules with any split of a frequent itemset into antecedent and
    consequent (MLlib gives single-item consequents only). Each itemset lists
    its own proper subsets (2^k - 2 for k items; a basket has five), which are
    looked up by equality; lift from the consequent's support. The consequent
    filter keeps 'won' anywhere (trap 21) unless strict."""
    s = itemsets.select(F.sort_array("items").alias("items"), "freq")
    number = F.explode(F.sequence(F.lit(1), F.pow(F.lit(2), F.size("items")).cast("int") - 2)).alias("m")
    splits = s.filter(F.size("items") > 1).select("items", F.col("freq").alias("full_freq"), number)
    ant = F.filter("items", lambda _, k: F.expr("m").bitwiseAND(F.pow(F.lit(2), k).cast("int")) != 0)
    splits = splits.withColumn("ant", ant).withColumn("cons", F.array_except("items", "ant"))
    a = s.select(F.col("items").alias("ant"), F.col("freq").alias("ant_freq"))
    c = s.select(F.col("items").alias("cons"), F.col("freq").alias("cons_freq"))
    total = n_baskets if isinstance(n_baskets, int) else n_baskets.agg(F.count("*")).scalar()
    r = splits.join(a, "ant").join(c, "cons").select(
        "ant", "cons", (F.col("full_freq") / total).alias("support"),
        (F.col("full_freq") / F.col("ant_freq")).alias("confidence"),
        (F.col("full_freq") / F.col("ant_freq") / (F.col("cons_freq") / total)).alias("lift"))
    r = r.filter(F.col("confidence") >= min_confidence)
    won = (F.exists("cons", lambda x: x.endswith("_won") & ~x.startswith("toss")) if strict_won
           else F.exists("cons", lambda x: x.contains("won")))
    return r.filter(won)


def train_upset_model(labelled: DataFrame, cols: list[str]) -> tuple[PipelineModel, DataFrame]:
    """Logistic regression with balanced class weights."""
    data = written(split(labelled, "match_id", "is_upset"), "upset-split")
    train = data.filter("split = 'train'")
    # Each class weighs half of the rows; with one class only, all rows weigh alike.
    sizes = {r["is_upset"]: r["n"] for r in train.groupBy("is_upset").agg(F.count("*").alias("n")).collect()}
    weight = F.lit(1.0)
    if len(sizes) == 2:
        for label, n in sizes.items():
            weight = F.when(F.col("is_upset") == label, sum(sizes.values()) / (2.0 * n)).otherwise(weight)
    weighted = train.withColumn("w", weight)
    lr = LogisticRegression(labelCol="is_upset", featuresCol="features", weightCol="w", maxIter=1000,
                            standardization=False)
    pipe = Pipeline(stages=[VectorAssembler(inputCols=cols, outputCol="features"), lr])
    model = pipe.fit(weighted)
    return model, model.transform(data.filter("split = 'test'"))


def permutation_importance(model: PipelineModel, data: DataFrame, cols: list[str], key: str = "match_id",
                           label: str = "target", bucket_rows: int = 10_000) -> DataFrame:
    """M18 (re-aimed from tree SHAP): accuracy drop when one column is
    permuted. Rows are hashed into buckets of about ``bucket_rows`` rows and
    the column is shuffled inside each bucket (order of a second hash against
    key order), so a window holds a bounded number of rows at any size and
    scoring stays distributed."""
    ev = MulticlassClassificationEvaluator(labelCol=label, metricName="accuracy")
    data = written(data, "importance-rows")
    buckets = max(1, -(-data.count() // bucket_rows))
    base = ev.evaluate(model.transform(data))
    b = data.withColumn("_b", hash_bucket(key, buckets))
    by_key = b.withColumn("_j", F.row_number().over(Window.partitionBy("_b").orderBy(key)))
    rows = []
    for i, c in enumerate(cols):
        donor = b.select("_b", c, F.row_number().over(Window.partitionBy("_b").orderBy(F.xxhash64(key, F.lit(i)), key)).alias("_j"))
        shuffled = by_key.drop(c).join(donor, ["_b", "_j"])
        rows.append((c, base - ev.evaluate(model.transform(shuffled))))
    return data.sparkSession.createDataFrame(sorted(rows, key=lambda r: -r[1]), "feature string, importance double")

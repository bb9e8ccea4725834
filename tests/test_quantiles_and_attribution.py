"""Exact quantiles by selection, and exact tree attribution."""

import itertools
import math
import random

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from wicketlake.ml import attribution as AT
from wicketlake.operators import quality as Q
from wicketlake.operators import quantiles
from wicketlake.operators.quantiles import exact_quantiles, order_statistics
from wicketlake.plans import silver

SHARES = [0.0, 0.1, 0.25, 0.5, 0.75, 0.9, 1.0]


def columns():
    r = random.Random(5)
    n = 4000
    return {
        "distinct": [r.gauss(0, 1) * 10 ** r.randint(-8, 8) for _ in range(n)],
        "powers": [2.0 ** -(i % 1070) * (-1 if i % 3 == 0 else 1) for i in range(n)],
        "near_one": [1 + 2.0 ** -(i % 53) for i in range(n)],
        "positive": [r.random() ** 40 for _ in range(n)],
        "below_zero": [-math.exp(r.random() * 600) for _ in range(n)],
        "zeros": [0.0 if i % 3 else -float(i) for i in range(n)],
        "constant": [7.0] * n,
        "few": [float(i % 5) for i in range(n)],
        "some": [None if i % 2 else float(i) for i in range(n)],
        "none": [None] * n,
    }


def test_quantiles_equal_duckdb(spark):
    data = columns()
    frame = pd.DataFrame(data).astype(float)
    rows = list(zip(*data.values()))
    df = spark.createDataFrame(rows, ", ".join(f"{c} double" for c in data)).repartition(5)
    got = exact_quantiles(df, list(data), SHARES)
    con = duckdb.connect()
    con.register("t", frame)
    for c in data:
        want = [con.execute(f'SELECT quantile_cont("{c}", {q}) FROM t WHERE "{c}" IS NOT NULL AND NOT isnan("{c}")').fetchone()[0] for q in SHARES]
        for g, w in zip(got[c], want, strict=True):
            assert (g is None and w is None) or g == pytest.approx(w, rel=1e-12, abs=0), c


def test_selection_is_bounded(spark, monkeypatch):
    """Every round ships at most BINS and a few rows per range, and a handful
    of rounds settles a column of distinct values."""
    monkeypatch.setattr(quantiles, "BINS", 64)
    df = spark.range(20_000).select((F.col("id") * 7919 % 20_000).cast("double").alias("x"))
    plans = []
    original = type(df).groupBy

    def counting(self, *cols):
        out = original(self, *cols)
        plans.append(out)
        return out

    monkeypatch.setattr(type(df), "groupBy", counting)
    got = order_statistics(df, {"x": [0, 4999, 5000, 10_000, 19_999]})
    assert {r: v for (_, r), v in got.items()} == {0: 0.0, 4999: 4999.0, 5000: 5000.0, 10_000: 10_000.0, 19_999: 19_999.0}
    assert len(plans) <= 5  # bounds, zero, and three more


def test_weights_infinities_and_nan(spark):
    rows = [(1.0, 3), (2.0, 1), (float("inf"), 2), (float("-inf"), 1), (float("nan"), 50), (None, 9)]
    df = spark.createDataFrame(rows, "x double, n int")
    values = [float("-inf"), 1.0, 1.0, 1.0, 2.0, float("inf"), float("inf")]
    got = order_statistics(df, {"x": list(range(7))}, "n")
    assert [got["x", i] for i in range(7)] == values


def test_outliers_and_profile_of_distinct_values(spark):
    r = random.Random(3)
    values = [r.gauss(0, 1) * (30 if i % 50 == 0 else 1) for i in range(3000)]
    df = spark.createDataFrame([(v, None if i % 4 else i) for i, v in enumerate(values)], "x double, y int")
    q1, q3 = np.quantile(values, [0.25, 0.75])
    row = silver.outlier_report(df, "x").first()
    assert row.q1 == pytest.approx(q1) and row.q3 == pytest.approx(q3) and row.rows == 3000
    assert row.outliers == sum(v < q1 - 1.5 * (q3 - q1) or v > q3 + 1.5 * (q3 - q1) for v in values)
    by = {p.column_name: p for p in Q.column_profile(df, ["x", "y"]).collect()}
    assert by["x"].distinct == 3000 and by["x"].median == pytest.approx(np.median(values)) and by["x"].stddev == pytest.approx(np.std(values, ddof=1))
    assert by["y"].nulls == 2250 and by["y"].q1 == pytest.approx(np.quantile(range(0, 3000, 4), 0.25)) and by["y"].zeros == 1
    empty = {p.column_name: p for p in Q.column_profile(df.limit(0), ["x"]).collect()}
    assert empty["x"]["count"] == 0 and empty["x"].median is None
    assert silver.outlier_report(df.limit(0), "x").first().rows == 0


# Attribution -----------------------------------------------------------------

@pytest.fixture(scope="module")
def boosted(spark):
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.feature import VectorAssembler

    r = random.Random(11)
    cols = [f"f{i}" for i in range(6)]
    rows = []
    for i in range(400):
        x = [r.gauss(0, 1) if k < 4 else float(r.randint(0, 2)) for k in range(6)]
        rows.append((f"m{i}", *x, int(x[0] * x[1] + x[4] + 0.3 * r.gauss(0, 1) > 0.5)))
    df = spark.createDataFrame(rows, "key string, " + ", ".join(f"{c} double" for c in cols) + ", label int")
    gbt = GBTClassifier(labelCol="label", featuresCol="features", maxIter=7, maxDepth=4, stepSize=0.2, subsamplingRate=0.8, seed=3)
    return Pipeline(stages=[VectorAssembler(inputCols=cols, outputCol="features"), gbt]).fit(df), df, cols


def brute_worth(path, z, x, known):
    """A leaf's expected value when the features ``known`` follow the row."""
    out = path.value
    for f in path.bounds:
        low, high = path.bounds[f]
        out *= (low < x[f] <= high) if f in known else z[f]
    return out


def test_attributions_are_shapley_values(spark, boosted):
    model, df, cols = boosted
    explainer = AT.Explainer.of(model, df, cols)
    z = AT.shares(explainer.paths, AT.leaf_covers(explainer.paths, df, cols))
    rows = df.limit(25).collect()
    phi = explainer.attributions(np.array([[r[c] for c in cols] for r in rows]))
    n = len(cols)
    for row, got in zip(rows, phi):
        x = [row[c] for c in cols]
        worth = {s: sum(brute_worth(p, zs, x, s) for p, zs in zip(explainer.paths, z))
                 for k in range(n + 1) for s in map(frozenset, itertools.combinations(range(n), k))}
        for i in range(n):
            want = sum(math.factorial(len(s)) * math.factorial(n - len(s) - 1) / math.factorial(n) * (worth[s | {i}] - worth[s])
                       for s in worth if i not in s)
            assert got[i] == pytest.approx(want, abs=1e-9)
        assert worth[frozenset()] == pytest.approx(explainer.base, abs=1e-9)


def test_attributions_add_up_to_the_raw_score(spark, boosted):
    from pyspark.ml.functions import vector_to_array

    model, df, cols = boosted
    explainer = AT.Explainer.of(model, df, cols)
    rows = AT.row_attributions(explainer, df, cols, "key")
    assert rows.count() == df.count() * len(cols)
    sums = rows.groupBy("key").agg(F.sum("attribution").alias("s"))
    raw = model.transform(df).select("key", vector_to_array("rawPrediction")[1].alias("raw"))
    for r in sums.join(raw, "key").collect():
        assert r.s + explainer.base == pytest.approx(r.raw, abs=1e-9)
    means = AT.mean_attributions(rows).collect()
    by = rows.toPandas().assign(a=lambda d: d.attribution.abs()).groupby("feature").a.mean()
    assert [m.feature for m in means] == list(by.sort_values(ascending=False).index)
    assert means[0].mean_abs_attribution == pytest.approx(by.max())


def test_covers_count_every_row_once_per_tree(spark, boosted):
    model, df, cols = boosted
    paths = AT.model_paths(model)
    covers = AT.leaf_covers(paths, df, cols)
    assert covers.sum() == df.count() * len(model.stages[-1].trees)

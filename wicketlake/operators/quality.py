"""Data-quality checks (Q rows). Each table's checks are one aggregate pass
(partial aggregates only), turned into (table, check, passed, value) rows by
``unpivot``; nothing is collected."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wicketlake.operators.quantiles import exact_quantiles
from wicketlake.session import written

# The check names of the silver layer report.
MATCH_CHECKS = ["Row count > 50", "No duplicate match_ids", "winner has no nulls",
                "toss_decision values valid", "match_date is not null"]
DELIVERY_CHECKS = ["Row count > 1000", "runs are non-negative", "over_num between 0 and 20", "batsman has no nulls"]
PLAYER_CHECKS = ["Row count > 10", "No duplicate player_ids", "strike_rate non-negative", "batting_avg non-negative"]


def _checks(df: DataFrame, table: str, checks: list[tuple[str, Column, Column]]) -> DataFrame:
    """``checks``: (name, passed aggregate, value aggregate) triples."""
    agg = df.agg(*[F.struct(p.alias("passed"), v.cast("double").alias("value")).alias(f"c{i}")
                   for i, (_, p, v) in enumerate(checks)])
    stacked = agg.select(F.explode(F.array(*[
        F.struct(F.lit(i).alias("check_no"), F.lit(name).alias("check_name"), F.col(f"c{i}.passed").alias("passed"),
                 F.col(f"c{i}.value").alias("value"))
        for i, (name, _, _) in enumerate(checks)])).alias("c"))
    return stacked.select(F.lit(table).alias("table_name"), "c.check_no", "c.check_name", "c.passed", "c.value")


def match_checks(m: DataFrame) -> DataFrame:
    """Q1."""
    n = F.count("*")
    return _checks(m, "matches", [
        (MATCH_CHECKS[0], n > 50, n),
        (MATCH_CHECKS[1], F.count_distinct("match_id") == n, F.count_distinct("match_id")),
        (MATCH_CHECKS[2], F.count_if(F.col("winner").isNull()) == 0, F.count_if(F.col("winner").isNull())),
        (MATCH_CHECKS[3], F.coalesce(F.bool_and(F.lower(F.col("toss_decision").cast("string")).isin("bat", "field")), F.lit(True)),
         F.count_if(~F.lower(F.col("toss_decision")).isin("bat", "field"))),
        (MATCH_CHECKS[4], F.count_if(F.col("match_date").isNull()) == 0, F.count_if(F.col("match_date").isNull())),
    ])


def delivery_checks(d: DataFrame) -> DataFrame:
    """Q2 (over the whole table; the reference sampled 10,000 rows)."""
    n = F.count("*")
    return _checks(d, "deliveries", [
        (DELIVERY_CHECKS[0], n > 1000, n),
        (DELIVERY_CHECKS[1], F.min("total_runs") >= 0, F.min("total_runs")),
        (DELIVERY_CHECKS[2], F.coalesce(F.bool_and(F.col("over_num").between(0, 20)), F.lit(True)), F.max("over_num")),
        (DELIVERY_CHECKS[3], F.count_if(F.col("batsman").isNull()) == 0, F.count_if(F.col("batsman").isNull())),
    ])


def player_checks(p: DataFrame) -> DataFrame:
    """Q3."""
    n = F.count("*")
    return _checks(p, "players", [
        (PLAYER_CHECKS[0], n > 10, n),
        (PLAYER_CHECKS[1], F.count_distinct("player_id") == n, F.count_distinct("player_id")),
        (PLAYER_CHECKS[2], F.min("strike_rate") >= 0, F.min("strike_rate")),
        (PLAYER_CHECKS[3], F.min("batting_avg") >= 0, F.min("batting_avg")),
    ])


def quality_report(m: DataFrame, d: DataFrame, p: DataFrame) -> DataFrame:
    return match_checks(m).unionByName(delivery_checks(d)).unionByName(player_checks(p))


def quality_score(report: DataFrame) -> DataFrame:
    """Q4: passed / total and percent."""
    return report.agg(F.count_if("passed").alias("passed"), F.count("*").alias("total")).withColumn(
        "pct", F.col("passed") / F.col("total") * 100)


def row_count_audit(tables: dict[str, DataFrame]) -> DataFrame:
    """Q5: row count per table, empty tables flagged."""
    frames = [df.agg(F.count("*").alias("row_count")).select(F.lit(name).alias("table_name"), "row_count")
              for name, df in tables.items()]
    out = reduce(DataFrame.unionByName, frames)
    return out.withColumn("status", F.when(F.col("row_count") == 0, "EMPTY").otherwise("OK"))


def table_health(name: str, df: DataFrame) -> DataFrame:
    """Q6: rows, mean null percent over columns, duplicate rows, status."""
    null_pct = sum((F.avg(F.col(c).isNull().cast("int")) * 100 for c in df.columns), F.lit(0.0)) / len(df.columns)
    distinct = df.distinct().agg(F.count("*")).scalar()
    g = df.agg(F.count("*").alias("row_count"), null_pct.alias("null_pct"))
    g = g.withColumn("duplicates", F.col("row_count") - distinct)
    return g.select(F.lit(name).alias("table_name"), "row_count", "null_pct", "duplicates",
                    F.when((F.col("null_pct") < 5) & (F.col("duplicates") == 0), "Healthy").otherwise("Warning").alias("health"))


def column_profile(df: DataFrame, numeric: list[str]) -> DataFrame:
    """Q7: per numeric column: count, nulls, distinct, min, max, mean, sample
    standard deviation, quartiles (exact), zeros.

    The columns are unpivoted into (column, value) and counted once, with
    partial counts before the shuffle; everything else is an aggregate over
    the distinct values with their counts. Sums of values and squares are
    exact for whole numbers and the same in any order of summation. Quartiles
    are selected from the counted values, of any number."""
    long = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).cast("double").alias("x")) for c in numeric])).alias("v"))
    counted = long.groupBy(F.col("v.column_name").alias("column_name"), F.col("v.x").alias("x")).agg(F.count("*").alias("n"))
    counted = written(counted, "profile-counts")
    x, n = F.col("x"), F.col("n")
    total, squares = F.sum(x * n), F.sum(x * x * n)
    count = F.coalesce(F.sum(F.when(x.isNotNull(), n)), F.lit(0))
    stats = counted.groupBy("column_name").agg(
        count.alias("count"), F.coalesce(F.sum(F.when(x.isNull(), n)), F.lit(0)).alias("nulls"), F.count(x).alias("distinct"),
        F.min(x).alias("min"), F.max(x).alias("max"), (total / count).alias("mean"),
        F.when(count > 1, F.sqrt((squares - total * total / count) / (count - 1))).alias("stddev"),
        F.coalesce(F.sum(F.when(x == 0, n)), F.lit(0)).alias("zeros"))
    wide = counted.select("n", *[F.when(F.col("column_name") == c, x).alias(c) for c in numeric])
    quartiles = exact_quantiles(wide, numeric, [0.25, 0.5, 0.75], "n")
    rows = df.sparkSession.createDataFrame([(c, *q) for c, q in quartiles.items()], "column_name string, q1 double, median double, q3 double")
    empty = df.sparkSession.createDataFrame([(c,) for c in numeric], "column_name string")
    whole = empty.join(stats, "column_name", "left").join(rows, "column_name")
    zero = F.lit(0).cast("long")
    return whole.select("column_name", *[F.coalesce(c, zero).alias(c) for c in ("count", "nulls", "distinct")], "min", "max", "mean", "stddev",
                        "q1", "median", "q3", F.coalesce("zeros", zero).alias("zeros"))

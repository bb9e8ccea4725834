"""Structured Streaming views of the live ball feed.

The feed is a file source over the event table (new files are new events).
Every query writes through ``foreachBatch`` or a file sink into the shared
checkpoint folder, with its own checkpoint, so a restarted job resumes where
it stopped; ``availableNow`` processes what is there and stops, which is how
the registered queries compare the streaming answer with the batch one.

Running aggregates keep one row per live match (T3) or per batter of a match
(T4) in the state store and run in update mode: a micro-batch writes only the
keys it changed, and the newest row of each key is the state. For an unbounded
feed, bound the store with ``withWatermark("ts", ...)`` and drop finished
matches.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wicketlake.functions import expressions as E
from wicketlake.session import scratch_path
from wicketlake.sources import views

EVENT_SCHEMA = T.StructType([
    T.StructField("event_id", T.LongType()), T.StructField("ts", T.TimestampType()),
    T.StructField("user_id", T.LongType()), T.StructField("event_type", T.StringType()),
    T.StructField("value", T.DoubleType()), T.StructField("props", T.StringType()),
])


def live_stream(spark: SparkSession, sf_dir: str, files_per_trigger: int = 1) -> DataFrame:
    """T1 source: the files of the event table (one file or a folder of part
    files) as an unbounded stream of ball events."""
    # As a pattern, the name may be a file or a folder; as a plain path Spark takes folders only.
    events = (spark.readStream.schema(EVENT_SCHEMA).option("maxFilesPerTrigger", files_per_trigger)
              .parquet(f"{sf_dir.rstrip('/')}/{{events.parquet}}"))
    return views.live(events)


def _run(query_builder, name: str, spark: SparkSession) -> str:
    """Start a query with a fresh checkpoint, process what is available,
    wait for it to finish; returns the output folder."""
    out = scratch_path(spark, name)
    q = query_builder(out).option("checkpointLocation", out + "/_checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()
    return out


def append_events(spark: SparkSession, stream: DataFrame) -> DataFrame:
    """Append every event to a Parquet table (file sink, exactly once)."""
    out = _run(lambda p: stream.writeStream.format("parquet").option("path", p + "/data").outputMode("append"),
               "live-append", spark)
    return spark.read.parquet(out + "/data")


def latest_events(spark: SparkSession, stream: DataFrame, n: int = 12) -> DataFrame:
    """Newest n events. Each micro-batch writes its own top n; the top n
    of those partial lists is the global answer, so no state is rewritten."""
    def keep(batch: DataFrame, batch_id: int, base: str) -> None:
        batch.orderBy(F.col("event_id").desc()).limit(n).write.mode("overwrite").parquet(f"{base}/batch={batch_id}")

    out = _run(lambda p: stream.writeStream.foreachBatch(lambda b, i: keep(b, i, p + "/data")), "live-latest", spark)
    return spark.read.parquet(out + "/data").drop("batch").orderBy(F.col("event_id").desc()).limit(n)


def _state_table(spark: SparkSession, agg: DataFrame, keys: list[str], name: str) -> DataFrame:
    """Run a streaming aggregate in update mode. Each micro-batch writes the
    changed keys to its own folder (a repeated batch overwrites it); the
    newest row of each key is its state (upsert by key)."""
    def changed(batch: DataFrame, batch_id: int, base: str) -> None:
        batch.write.mode("overwrite").parquet(f"{base}/batch={batch_id}")

    out = _run(lambda p: agg.writeStream.outputMode("update").foreachBatch(lambda b, i: changed(b, i, p + "/data")),
               name, spark)
    rest = [c for c in agg.columns if c not in keys]
    rows = spark.read.parquet(out + "/data")
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("_state")).select(*keys, "_state.*")


def match_state(spark: SparkSession, stream: DataFrame) -> DataFrame:
    """T3 (+ F14): cumulative runs and balls per live match, run rate and
    projected total."""
    agg = stream.groupBy("match_id").agg(F.sum(F.col("runs_scored") + F.col("extras")).alias("runs"),
                                         F.count("*").alias("balls"))
    state = _state_table(spark, agg, ["match_id"], "live-state")
    return state.withColumns({
        "current_rr": E.current_run_rate(F.col("runs"), F.col("balls")),
        "projected_total": E.projected_score(F.col("runs"), F.col("balls")),
    })


# The milestone thresholds.
MILESTONES = (50, 100)


def milestones(spark: SparkSession, stream: DataFrame) -> DataFrame:
    """T4: batters of each live match who reached 50 / 100 runs."""
    agg = stream.groupBy("match_id", "batsman").agg(F.sum("runs_scored").alias("runs"))
    state = _state_table(spark, agg, ["match_id", "batsman"], "live-milestones")
    hit = state.select("match_id", "batsman", "runs", F.explode(F.array(*[F.lit(m) for m in MILESTONES])).alias("milestone"))
    return hit.filter(F.col("runs") >= F.col("milestone"))


def fired_milestones(spark: SparkSession, stream: DataFrame) -> DataFrame:
    """T4, fire once: every milestone as one event, in the micro-batch that
    reached it. A batch compares its changed batters with the events already
    fired; a repeated batch leaves its own events out of that comparison."""
    agg = stream.groupBy("match_id", "batsman").agg(F.sum("runs_scored").alias("runs"))
    key = ["match_id", "batsman", "milestone"]

    def fire(batch: DataFrame, batch_id: int, base: str) -> None:
        hit = batch.select("match_id", "batsman", "runs", F.explode(F.array(*[F.lit(m) for m in MILESTONES])).alias("milestone"))
        hit = hit.filter(F.col("runs") >= F.col("milestone")).select(*key)
        if batch_id:
            before = batch.sparkSession.read.parquet(base).filter(F.col("batch") < batch_id).select(*key)
            hit = hit.join(before, key, "left_anti")
        hit.write.mode("overwrite").parquet(f"{base}/batch={batch_id}")

    out = _run(lambda p: agg.writeStream.outputMode("update").foreachBatch(lambda b, i: fire(b, i, p + "/data")),
               "live-fired", spark)
    return spark.read.parquet(out + "/data").select(*key)


def state_with_baseline(spark: SparkSession, stream: DataFrame, deliveries: DataFrame, overs: int = 20) -> DataFrame:
    """T5: live state joined with the historical first-innings baseline (a
    one-row batch aggregate, broadcast): venue run rate and win proxy."""
    state = match_state(spark, stream)
    first = deliveries.filter(F.col("inning") == 1).groupBy("match_id").agg(F.sum("total_runs").alias("t"))
    base_rr = first.agg((F.avg("t") / overs).alias("venue_avg_rr"))
    out = state.crossJoin(base_rr)  # one row
    return out.withColumn("win_prob", E.win_proxy(F.col("projected_total"), F.col("venue_avg_rr"), overs))

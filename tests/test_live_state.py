"""Keyed live state: equal to batch over files and restarts, each milestone
once, finished matches dropped."""

import json
import os
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from wicketlake.streaming import live as T
from wicketlake.streaming import state as S

START = datetime(2024, 1, 1)


def event(i, hour, user, value, kind="view"):
    return (i, START + timedelta(hours=hour), user, kind, float(value), None)


def put(spark, folder, name, rows):
    """One more file of the event table; later files are newer."""
    made = f"{os.path.dirname(os.path.dirname(folder))}/made-{name}"
    spark.createDataFrame(rows, T.EVENT_SCHEMA).coalesce(1).write.parquet(made)
    part = next(f for f in os.listdir(made) if f.endswith(".parquet"))
    os.makedirs(folder, exist_ok=True)
    os.rename(f"{made}/{part}", f"{folder}/{name}.parquet")
    n = len(os.listdir(folder))
    os.utime(f"{folder}/{name}.parquet", (1_700_000_000 + n, 1_700_000_000 + n))


def batch_totals(spark, folder):
    live = T.views.live(spark.read.schema(T.EVENT_SCHEMA).parquet(folder))
    return {r.match_id: (r.runs, r.balls) for r in live.groupBy("match_id").agg(
        F.sum(F.col("runs_scored") + F.col("extras")).alias("runs"), F.count("*").alias("balls")).collect()}


def batch_fired(spark, folder):
    live = T.views.live(spark.read.schema(T.EVENT_SCHEMA).parquet(folder))
    return sorted((r.match_id, r.batsman, m) for r in live.groupBy("match_id", "batsman").agg(F.sum("runs_scored").alias("runs")).collect()
                  for m in T.MILESTONES if r.runs >= m)


def fired(spark, folder):
    return sorted(map(tuple, spark.read.schema("match_id string, batsman string, milestone int").parquet(f"{folder}/fired").collect()))


def test_files_and_a_restart_equal_batch(spark, tmp_path):
    base = str(tmp_path)
    feed = f"{base}/feed/events.parquet"
    events = f"{base}/feed"

    def rows(k):
        return [event(1000 * k + i, 10 * k + i / 60, i % 7 + 7 * (k == 3), 3 + i % 4, "signup" if i % 9 == 0 else "view") for i in range(120)]

    def run():
        stream = T.live_stream(spark, events)
        S.run_totals(S.match_totals(stream), f"{base}/totals")
        return S.run_milestones(S.milestone_events(T.live_stream(spark, events)), f"{base}/milestones")

    for k in range(3):
        put(spark, feed, f"f{k}", rows(k))
    run()
    first = fired(spark, f"{base}/milestones")
    assert first == batch_fired(spark, feed) and first
    files = {f for f in os.listdir(f"{base}/milestones/fired") if f.endswith(".parquet")}
    put(spark, feed, "f3", rows(3))
    run()  # a restart goes on from its checkpoint
    assert fired(spark, f"{base}/milestones") == batch_fired(spark, feed)
    assert {r.match_id: (r.runs, r.balls) for r in S.newest_totals(spark, f"{base}/totals").collect()} == batch_totals(spark, feed)
    # Fired rows are appended and never rewritten, and each is there once.
    assert files <= set(os.listdir(f"{base}/milestones/fired"))
    now = fired(spark, f"{base}/milestones")
    assert len(now) == len(set(now)) > len(first)


def test_finished_matches_leave_the_store(spark, tmp_path):
    feed = f"{tmp_path}/feed/events.parquet"
    put(spark, feed, "a", [event(i, i / 60, i % 40, 2) for i in range(200)])
    put(spark, feed, "b", [event(1000 + i, 100 + i / 60, 1, 2) for i in range(20)])
    put(spark, feed, "c", [event(2000 + i, 200 + i / 60, 2, 2) for i in range(20)])
    out = f"{tmp_path}/out"
    q = S.run_milestones(S.milestone_events(T.live_stream(spark, f"{tmp_path}/feed"), idle_days=1), out)
    rows = [json.loads(p.json)["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress]
    assert max(rows) == 40 and rows[-1] <= 2, rows  # the forty batters of the first file are gone


def test_registered_streams_equal_the_batch_answer(spark):
    sf = "/root/testdata/sf0.001"
    feed = f"{sf}/events.parquet"
    state = S.timed_match_state(spark, T.live_stream(spark, sf))
    assert {r.match_id: (r.runs, r.balls) for r in state.collect()} == batch_totals(spark, feed)
    assert sorted(map(tuple, S.timed_milestones(spark, T.live_stream(spark, sf)).collect())) == batch_fired(spark, feed)

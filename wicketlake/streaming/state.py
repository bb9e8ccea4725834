"""T3, T4 with keyed state and event-time timers.

Each live match and each batter of a match has a state of its own in a RocksDB
store: running totals, which milestones have fired, and one timer. A ball that
arrives moves the timer to ``idle`` after the key's latest event; when the
watermark passes it, the match is finished and its state is dropped, so the
store holds the matches in play and not the history. A milestone is a row that
the state gives out once, when its total passes it; the output is appended
exactly once by the file sink and never read again by the stream.

A few matches hold all balls, so a task first adds up its own balls of each key
(``HELD_KEYS`` keys at a time): the state sees one row per key and task, not
one per ball. A key that comes back after its state was dropped starts anew, so
``idle`` has to exceed the longest pause inside a match.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from datetime import datetime, timezone

import pyarrow as pa
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from wicketlake.functions import expressions as E
from wicketlake.session import scratch_path, ship_package
from wicketlake.streaming.live import MILESTONES

HELD_KEYS = 100_000
#: Longest pause inside a match, and how late a ball may come.
IDLE_DAYS, LATENESS = 60, "1 hour"

_STORE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    # Many small stores: no disk is reserved before it is written.
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
}


@contextmanager
def state_store(spark: SparkSession):
    """The session with a RocksDB state store, and as it was afterwards."""
    before = {k: spark.conf.get(k, None) for k in _STORE}
    for k, v in _STORE.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def partial_totals(balls: DataFrame, keys: list[str]) -> DataFrame:
    """``(*keys, runs, bat_runs, balls, ts)``: sums over each task's balls of
    a key, and its latest event time."""
    ship_package(balls.sparkSession)
    names = [*keys, "runs", "bat_runs", "balls", "ts"]

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, list] = {}

        def packed() -> pa.RecordBatch:
            columns = list(zip(*[(*k, *v) for k, v in held.items()])) or [()] * len(names)
            types = [pa.string()] * len(keys) + [pa.int64()] * 4
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)

        for batch in batches:
            for *key, scored, extras, ts in zip(*(c.to_pylist() for c in batch.columns)):
                total = held.setdefault(tuple(key), [0, 0, 0, ts])
                total[0] += scored + extras
                total[1] += scored
                total[2] += 1
                total[3] = max(total[3], ts)
            if len(held) >= HELD_KEYS:
                yield packed()
                held.clear()
        yield packed()

    own = balls.filter("ts is not null").select(*keys, F.coalesce("runs_scored", F.lit(0)).cast("long"), F.coalesce("extras", F.lit(0)).cast("long"), F.unix_micros("ts"))
    ddl = ", ".join([f"{k} string" for k in keys] + [f"{c} bigint" for c in names[len(keys):]])
    return own.mapInArrow(add_up, ddl).withColumn("ts", F.timestamp_micros("ts")).withWatermark("ts", LATENESS)


class _Timed(StatefulProcessor):
    """A state that is dropped ``idle`` after its latest event. Its last
    column is that event's time in milliseconds."""

    schema = ""

    def __init__(self, idle_days: float):
        self.idle = int(idle_days * 86_400_000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", self.schema)

    def keep(self, before: tuple | None, after: tuple) -> None:
        """Store the state and move its timer."""
        if before is None or before[-1] != after[-1]:
            if before is not None:
                self.handle.deleteTimer(before[-1] + self.idle)
            self.handle.registerTimer(after[-1] + self.idle)
        self.state.update(after)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        self.state.clear()
        return iter(())

    def close(self) -> None:
        pass


def _milliseconds(ts: datetime) -> int:
    return int((ts if ts.tzinfo else ts.replace(tzinfo=timezone.utc)).timestamp() * 1000)


class MatchTotals(_Timed):
    """Running totals of one match; yields them when they changed."""

    schema = "runs bigint, balls bigint, latest bigint"

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        before = tuple(self.state.get()) if self.state.exists() else None
        runs, balls, latest = before or (0, 0, 0)
        for r in rows:
            runs, balls, latest = runs + r.runs, balls + r.balls, max(latest, _milliseconds(r.ts))
        self.keep(before, (runs, balls, latest))
        yield Row(match_id=key[0], runs=runs, balls=balls)


class Milestones(_Timed):
    """T4: running total of one batter of a match; yields each milestone once,
    with the total that reached it."""

    schema = "runs bigint, fired int, latest bigint"

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        before = tuple(self.state.get()) if self.state.exists() else None
        runs, fired, latest = before or (0, 0, 0)
        for r in rows:
            runs, latest = runs + r.bat_runs, max(latest, _milliseconds(r.ts))
        for k, milestone in enumerate(MILESTONES):
            if runs >= milestone and not fired >> k & 1:
                fired |= 1 << k
                yield Row(match_id=key[0], batsman=key[1], milestone=milestone)
        self.keep(before, (runs, fired, latest))


def match_totals(stream: DataFrame, idle_days: float = IDLE_DAYS) -> DataFrame:
    return partial_totals(stream, ["match_id"]).groupBy("match_id").transformWithState(
        MatchTotals(idle_days), "match_id string, runs bigint, balls bigint", "Update", "EventTime")


def milestone_events(stream: DataFrame, idle_days: float = IDLE_DAYS) -> DataFrame:
    return partial_totals(stream, ["match_id", "batsman"]).groupBy("match_id", "batsman").transformWithState(
        Milestones(idle_days), "match_id string, batsman string, milestone int", "Append", "EventTime")


def run_milestones(events: DataFrame, folder: str) -> StreamingQuery:
    """Append the milestones of all available files under ``folder``; a later
    call with the same folder goes on where this one stopped."""
    with state_store(events.sparkSession):
        q = (events.writeStream.format("parquet").option("path", f"{folder}/fired").option("checkpointLocation", f"{folder}/progress")
             .outputMode("append").trigger(availableNow=True).start())
        q.awaitTermination()
    return q


def run_totals(totals: DataFrame, folder: str) -> StreamingQuery:
    """Write the changed totals of every micro-batch under ``folder`` (a
    repeated batch overwrites its own); the newest row of a match counts."""
    def changed(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/changes/batch={batch_id}")

    with state_store(totals.sparkSession):
        q = (totals.writeStream.outputMode("update").foreachBatch(changed).option("checkpointLocation", f"{folder}/progress")
             .trigger(availableNow=True).start())
        q.awaitTermination()
    return q


def newest_totals(spark: SparkSession, folder: str) -> DataFrame:
    rows = spark.read.parquet(f"{folder}/changes")
    newest = rows.groupBy("match_id").agg(F.max_by(F.struct("runs", "balls"), "batch").alias("s")).select("match_id", "s.*")
    return newest.withColumns({"current_rr": E.current_run_rate(F.col("runs"), F.col("balls")),
                               "projected_total": E.projected_score(F.col("runs"), F.col("balls"))})


def timed_match_state(spark: SparkSession, stream: DataFrame, idle_days: float = IDLE_DAYS) -> DataFrame:
    """T3 over all available files."""
    folder = scratch_path(spark, "live-totals")
    run_totals(match_totals(stream, idle_days), folder)
    return newest_totals(spark, folder)


def timed_milestones(spark: SparkSession, stream: DataFrame, idle_days: float = IDLE_DAYS) -> DataFrame:
    """T4 over all available files: every milestone as one event."""
    folder = scratch_path(spark, "live-milestone-events")
    run_milestones(milestone_events(stream, idle_days), folder)
    return spark.read.schema("match_id string, batsman string, milestone int").parquet(f"{folder}/fired")

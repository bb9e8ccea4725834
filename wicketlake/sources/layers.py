"""Silver tables that follow their source files.

Each layer remembers the files (path, size, time) that its rows come from.
When the listing of the source folder is the same, the layer is read as it is.
When only files were added, the added files alone are read, and their rows or
partial sums are merged with the buckets of the layer that they touch; the
files read before are not opened again. When a file was changed or removed,
the layer is built anew. Either way a new version is swapped in whole.

* ``deliveries``: rows with the columns that order a match; the ball number is
  counted again in the touched buckets (a match lies in one bucket).
* ``cards`` and ``match_sums``: sums, counts, minima and maxima per key, which
  add up over any split of the files.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wicketlake.plans import silver
from wicketlake.sources import views
from wicketlake.sources.versioned import BUCKET, Version, VersionedTable, files_at


@dataclass(frozen=True)
class Layer:
    """``rows``: from raw source rows; ``key``: what a bucket keeps together;
    ``merge``: of rows with their bucket, old and new, to the table's rows;
    ``build``: of the table and all raw source rows to the table's rows."""

    source: str
    key: list[str]
    rows: Callable[[DataFrame], DataFrame]
    merge: Callable[[DataFrame], DataFrame]
    build: Callable[[VersionedTable, DataFrame], DataFrame]


def _built_deliveries(table: VersionedTable, raw: DataFrame) -> DataFrame:
    """Balls are dealt and numbered as numbers and named in their bucket."""
    balls = views.timed_balls(table.placed(views.ball_rows(raw)))
    return views.named_balls(views.sequenced(balls, BUCKET), "seq", BUCKET)


def _built_cards(table: VersionedTable, raw: DataFrame) -> DataFrame:
    """Balls are dealt as numbers; a match lies in one bucket and is summed
    there, without another shuffle."""
    balls = views.ball_rows(raw)
    dealt = table.placed(balls.withColumn("match_id", views.match_label(F.col("m")))).select(*balls.columns, BUCKET)
    return silver.match_cards(views.named_balls(views.timed_balls(dealt), BUCKET), BUCKET)


LAYERS = {
    "deliveries": Layer("lineitem", ["m"], views.delivery_rows, lambda rows: views.sequenced(rows, BUCKET), _built_deliveries),
    "cards": Layer("lineitem", ["match_id"], lambda raw: silver.match_cards(views.delivery_rows(raw)), lambda rows: silver.merged_cards(rows, BUCKET),
                   _built_cards),
    "match_sums": Layer("orders", ["m"], views.match_sums, lambda rows: views.merged_match_sums(rows, BUCKET),
                        lambda table, raw: views.merged_match_sums(table.placed(views.match_sums(raw)), BUCKET)),
}

#: Bytes of source files for each bucket, where that makes more buckets than
#: there are shuffle partitions: a bucket is sorted by one task.
BUCKET_BYTES = 16 << 20

#: Newest versions by table folder, so that an unchanged listing needs no look
#: at the manifest.
_HEADS: dict[str, Version] = {}


def current(t, name: str) -> DataFrame:
    """The rows of layer ``name`` for the present files of its source."""
    layer = LAYERS[name]
    spark, path = t.spark, f"{t.sf_dir}/{layer.source}.parquet"
    table = VersionedTable(spark, f"{t.store}/{name}", layer.key)
    source = t.fingerprint(layer.source)
    head = _HEADS.get(table.root)
    if head is None or head.source != source:
        head = table.head()
    if head is None or head.source != source:
        head = _refreshed(table, layer, files_at(spark, path), source, head, path)
    _HEADS[table.root] = head
    return table.read(head)


def _refreshed(table: VersionedTable, layer: Layer, files: DataFrame, source: str, head: Version | None, path: str) -> Version:
    spark = table.spark
    if head is not None:
        known = table.sources(head)
        same = ["name", "number", "stamp"]
        if known.join(files, same, "left_anti").isEmpty():
            added = [r.name for r in files.join(known, same, "left_anti").select("name").collect()]  # paths of the new files only
            fresh = layer.rows(spark.read.parquet(*added)).withColumn(BUCKET, table.bucket_of(head.buckets))
            touched = {r[0] for r in fresh.select(BUCKET).distinct().collect()}  # at most one row per bucket
            held = table.read(head, sorted(touched))
            if held is not None:
                # What merging adds (the ball number) is left out and made anew.
                old = held.withColumn(BUCKET, table.bucket_of(head.buckets)).select(*fresh.columns)
                fresh = old.unionByName(fresh)
            merged = layer.merge(fresh.repartitionById(head.buckets, BUCKET))
            return table.commit(merged, head, files, source, touched)
    size = files.agg(F.coalesce(F.sum("number"), F.lit(0))).first()[0]
    table.wanted = max(table.wanted, -(-size // BUCKET_BYTES))
    return table.commit(layer.build(table, spark.read.parquet(path)), head, files, source)



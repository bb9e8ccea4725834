"""Operator 12, an audit of how filters interact, by incremental retraction.

The files of the documents are a stream that available-now micro-batches work
off. A document becomes a mask of the filters that it fails by itself (A to
D), a digest of its text and its labels; the text goes no further. The repeat
filter (E) needs the smallest id of each text over the whole table: a state
keyed by text digest keeps that id and the masks counted for it. A row with a
smaller id retracts the masks of the earlier holder from the part counters
(count -1 without E, +1 with E) and takes its place; a row with a larger id is
counted with E at once. Every micro-batch writes its counter changes to a
folder of its own, which a repeated batch overwrites, and the counters are the
sums of all changes. All orders and steps follow from at most 32 masks a part.

The state store is asked once for a bucket of texts, not once for every text:
digests are dealt into one bucket for each ``BUCKET_BYTES`` of input files (a
few hundred texts of about 60 bytes each), at any size of the input.

Rows of one task that share a text are reduced to the smallest id before the
state (the others fail E whatever comes), so a text that holds a third of all
rows sends at most a row per task, part and ``HELD_TEXTS`` distinct texts. The
state is a RocksDB store on the executors, with its changes under the shared
checkpoint folder: a lost executor costs the running micro-batch.

Defined results: a null text is empty (no words: A fails, B and C hold), and
empty texts repeat each other; a null part is the empty string; a row with a
null id has no smaller id and is none, so it holds E; rows that share the
smallest id of a text all hold E; a document without a label counts in no
``_lost`` column, one with several labels counts where any of them says 1; texts
are read whole; an empty table gives an empty result; other columns stay
behind.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from hashlib import sha256
from itertools import permutations
from zlib import crc32

import pyarrow as pa
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.window import Window

from wicketlake.llm.common import bound_batches, written
from wicketlake.session import scratch_path

FILTERS = "ABCDE"
REPEATED = 1 << FILTERS.index("E")
#: Distinct texts that a task reduces before it passes them on.
HELD_TEXTS = 100_000
#: Micro-batches that the files are dealt into.
MICRO_BATCHES = 4
#: Bytes of input files for each bucket of the state.
BUCKET_BYTES = 256 << 10

_SPECIAL = re.compile(rb"[#$%&*|]")
_CAPITALS = bytes(range(ord("A"), ord("Z") + 1))
_ROWS = "bucket bigint, key binary, doc_id bigint, part string, mask int, good boolean, toxic boolean, n bigint"
_HELD = pa.schema([("key", pa.binary()), ("doc_id", pa.int64()), ("part", pa.string()), ("mask", pa.int32()), ("good", pa.bool_()),
                   ("toxic", pa.bool_()), ("n", pa.int64())])


def own_mask(data: bytes, min_words: int = 200) -> int:
    """The filters among A to D that a text fails, bit 0 for A. ``split``
    cuts bytes at exactly the separators of the word pattern."""
    words = data.split()
    distinct = len(set(words))
    capitals = len(data) - len(data.translate(None, _CAPITALS))
    points = len(data) if data.isascii() else len(data.decode())
    failed = (len(words) < min_words, 100 * distinct < 50 * len(words), 100 * capitals > 3 * points, _SPECIAL.search(data) is not None)
    return sum(1 << k for k, f in enumerate(failed) if f)


def masked(docs: DataFrame, id_col: str, text_col: str, part_col: str) -> DataFrame:
    """``(doc_id, part, key, mask)``: the text becomes its digest and mask."""
    part = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{part_col}`").cast("string"), F.lit("")).alias("part"),
                       F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t.encode() for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([sha256(t).digest()[:16] for t in texts], pa.binary()),
                 pa.array(map(own_mask, texts), pa.int32())], names=["doc_id", "part", "key", "mask"])

    return part.mapInArrow(judge, "doc_id bigint, part string, key binary, mask int")


def reduced(rows: DataFrame, buckets: int) -> DataFrame:
    """Rows of one task by text: those with the smallest id go to the state,
    by the bucket of their text; every other one fails E for certain, and a
    row without an id holds it, so both leave as counter changes without an
    id, by any bucket."""
    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lowest: dict[bytes, tuple[int, dict]] = {}
        final: dict[tuple, int] = {}

        def count(mask_part: tuple, n: int) -> None:
            final[mask_part] = final.get(mask_part, 0) + n

        def repeat(entries: dict) -> None:
            for (part, mask, *labels), n in entries.items():
                count((part, mask | REPEATED, *labels), n)

        def packed() -> pa.RecordBatch:
            out = [(int.from_bytes(key[:8], "big") % buckets, key, low, *entry, n)
                   for key, (low, entries) in lowest.items() for entry, n in entries.items()]
            out += [(crc32(repr(entry).encode()) % buckets, None, None, *entry, n) for entry, n in final.items()]
            schema = pa.schema([("bucket", pa.int64()), *_HELD])
            columns = zip(*out) if out else [()] * len(schema)
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

        for batch in batches:
            for doc_id, part, key, mask, good, toxic in zip(*(c.to_pylist() for c in batch.columns)):
                entry = (part, mask, good, toxic)
                if doc_id is None:
                    count(entry, 1)
                    continue
                low, entries = lowest.get(key, (None, None))
                if low is None or doc_id < low:
                    if low is not None:
                        repeat(entries)
                    lowest[key] = (doc_id, {entry: 1})
                elif doc_id == low:
                    entries[entry] = entries.get(entry, 0) + 1
                else:
                    repeat({entry: 1})
            if len(lowest) >= HELD_TEXTS:
                yield packed()
                lowest.clear()
                final.clear()
        yield packed()

    return rows.select("doc_id", "part", "key", "mask", "good", "toxic").mapInArrow(reduce, _ROWS)


class SmallestId(StatefulProcessor):
    """State of the texts of a bucket: the smallest id so far of each, and
    what is counted for it, as Arrow bytes. Yields counter changes."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getValueState("held", "texts binary")

    def _texts(self) -> dict[bytes, tuple[int, dict]]:
        texts: dict[bytes, tuple[int, dict]] = {}
        if self.held.exists():
            batch = pa.ipc.read_record_batch(pa.py_buffer(self.held.get()[0]), _HELD)
            for key, low, *entry, n in zip(*(c.to_pylist() for c in batch.columns)):
                texts.setdefault(key, (low, {}))[1][tuple(entry)] = n
        return texts

    def handleInputRows(self, key, rows, timerValues):
        changes: dict[tuple, int] = {}
        texts = None

        def change(entry: tuple, n: int) -> None:
            changes[entry] = changes.get(entry, 0) + n

        def repeat(entry: tuple) -> tuple:
            return (entry[0], entry[1] | REPEATED, *entry[2:])

        for _, text, doc_id, *entry, n in rows:
            entry = tuple(entry)
            if doc_id is None:  # a finished count
                change(entry, n)
                continue
            texts = self._texts() if texts is None else texts
            low, entries = texts.get(bytes(text), (None, None))
            if low is None or doc_id < low:
                for earlier, m in (entries or {}).items():
                    change(earlier, -m)
                    change(repeat(earlier), m)
                texts[bytes(text)] = (doc_id, {entry: n})
                change(entry, n)
            elif doc_id == low:
                entries[entry] = entries.get(entry, 0) + n
                change(entry, n)
            else:
                change(repeat(entry), n)
        if texts is not None:
            out = [(t, low, *entry, n) for t, (low, entries) in texts.items() for entry, n in entries.items()]
            batch = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), _HELD)], schema=_HELD)
            self.held.update((batch.serialize().to_pybytes(),))
        for (part, mask, good, toxic), n in changes.items():
            if n:
                yield Row(part=part, mask=mask, good=good, toxic=toxic, n=n)

    def close(self) -> None:
        pass


def mask_counts(spark: SparkSession, path: str, labels: DataFrame, batches: int = MICRO_BATCHES, id_col: str = "doc_id",
                text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """``(part, mask, good, toxic, n)`` over all Parquet files at ``path``
    (a folder or one file), by available-now micro-batches."""
    given = spark.read.parquet(path)
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet").load(path)
    size = listed.agg(F.count("*").alias("files"), F.sum("length").alias("bytes")).first()
    files, buckets = max(1, -(-size.files // batches)), max(1, -(-(size.bytes or 0) // BUCKET_BYTES))
    folder, name = path.rstrip("/").rsplit("/", 1)
    # As a pattern, the name may be a file or a folder; as a plain path Spark takes folders only.
    stream = spark.readStream.schema(given.schema).option("maxFilesPerTrigger", files).parquet(f"{folder}/{{{name}}}")
    bound_batches(spark)
    flags = written(labels.filter("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(
        F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"),
        F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic")), "audit-labels")
    no = F.lit(False)
    rows = masked(stream, id_col, text_col, part_col).join(flags, "doc_id", "left").withColumns(
        {"good": F.coalesce("good", no), "toxic": F.coalesce("toxic", no)})
    changes = reduced(rows, buckets).groupBy("bucket").transformWithState(
        SmallestId(), "part string, mask int, good boolean, toxic boolean, n bigint", "Update", "None")
    out = scratch_path(spark, "audit")
    by = ["part", "mask", "good", "toxic"]

    def keep(batch: DataFrame, batch_id: int) -> None:
        batch.groupBy(*by).agg(F.sum("n").alias("n")).write.mode("overwrite").parquet(f"{out}/changes/batch={batch_id}")

    with _settings(spark, {
        "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
        "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
        "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
        # Many small stores: no disk is reserved before it is written.
        "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
    }):
        run = (changes.writeStream.outputMode("update").foreachBatch(keep)
               .option("checkpointLocation", f"{out}/progress").trigger(availableNow=True).start())
        run.awaitTermination()
    schema = "part string, mask int, good boolean, toxic boolean, n bigint"
    empty = spark.createDataFrame([], schema)
    total = spark.read.schema(schema).parquet(f"{out}/changes/batch=*") if run.lastProgress else empty
    return total.groupBy(*by).agg(F.sum("n").alias("n")).filter("n <> 0")


class _settings:
    """Session settings for the time of a block, then as they were."""

    def __init__(self, spark: SparkSession, settings: dict[str, str]):
        self.spark, self.settings = spark, settings

    def __enter__(self) -> None:
        self.before = {k: self.spark.conf.get(k, None) for k in self.settings}
        for k, v in self.settings.items():
            self.spark.conf.set(k, v)

    def __exit__(self, *_) -> None:
        for k, v in self.before.items():
            self.spark.conf.unset(k) if v is None else self.spark.conf.set(k, v)


def interactions(counts: DataFrame) -> DataFrame:
    """The audit from the counters: one row per part, order and step. At most
    32 masks a part meet the 600 steps inside the part's own row."""
    masks = counts.groupBy("part", "mask").agg(
        F.sum("n").alias("n"), F.sum(F.when(F.col("good"), F.col("n")).otherwise(0)).alias("good"),
        F.sum(F.when(F.col("toxic"), F.col("n")).otherwise(0)).alias("toxic"))
    parts = masks.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("masks"))
    orders = F.split(F.lit(",".join("".join(p) for p in permutations(FILTERS))), ",")
    steps = (parts.withColumn("filter_order", F.explode(orders))
             .withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS))))))

    def bit(k: str) -> str:
        return f"cast(pow(2, instr('{FILTERS}', substr(filter_order, {k}, 1)) - 1) as int)"

    steps = steps.withColumns({
        "letter": F.expr("substr(filter_order, step, 1)"), "bit": F.expr(bit("step")),
        "before": F.expr(f"aggregate(sequence(1, {len(FILTERS)}), 0, (acc, k) -> acc + if(k < step, {bit('k')}, 0))")})

    def total(condition: str, column: str = "n"):
        return F.expr(f"aggregate(filter(masks, m -> {condition}), 0L, (acc, m) -> acc + m.{column})")

    gone = "(m.mask & before) = 0 and (m.mask & bit) <> 0"
    out = steps.select(
        "part", "filter_order", "step", "letter", total("(m.mask & (before | bit)) = 0").alias("kept"), total(gone).alias("removed"),
        total("(m.mask & before) <> 0 and (m.mask & bit) <> 0").alias("redundant"), total("m.mask = bit").alias("unique_fails"),
        total(gone, "good").alias("good_lost"), total(gone, "toxic").alias("toxic_lost"))
    each = Window.partitionBy("part", "letter")  # 120 rows
    return out.withColumn("shapley", F.sum("removed").over(each)).drop("letter")


def audit_filters(spark: SparkSession, path: str, labels: DataFrame, **options) -> DataFrame:
    """The whole audit of the Parquet files at ``path``."""
    return interactions(written(mask_counts(spark, path, labels, **options), "audit-counts"))


ORACLE = """
WITH t AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS words FROM t),
l AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY 1),
f AS (SELECT w.doc_id, part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
    (CASE WHEN len(words) < 200 THEN 1 ELSE 0 END) + (CASE WHEN 100 * len(list_distinct(words)) < 50 * len(words) THEN 2 ELSE 0 END)
    + (CASE WHEN 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 3 * length(text) THEN 4 ELSE 0 END)
    + (CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 8 ELSE 0 END)
    + (CASE WHEN w.doc_id > min(w.doc_id) OVER (PARTITION BY text) THEN 16 ELSE 0 END) AS mask FROM w LEFT JOIN l ON w.doc_id = l.doc_id),
c AS (SELECT part, mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM f GROUP BY 1, 2),
x AS (SELECT unnest(string_split('ABCDE', '')) AS x),
o AS (SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM x a, x b, x c, x d, x e
      WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
s AS (SELECT filter_order, step, filter_order[step] AS letter, 1 << (instr('ABCDE', filter_order[step]) - 1) AS bit,
      CAST(list_sum(list_concat([0], list_transform(range(1, step), lambda k: 1 << (instr('ABCDE', filter_order[k]) - 1)))) AS BIGINT) AS before
      FROM o, (SELECT unnest([1, 2, 3, 4, 5]) AS step) y),
r AS (SELECT part, filter_order, step, letter,
    CAST(coalesce(sum(n) FILTER (mask & (before | bit) = 0), 0) AS BIGINT) AS kept,
    CAST(coalesce(sum(n) FILTER (mask & before = 0 AND mask & bit <> 0), 0) AS BIGINT) AS removed,
    CAST(coalesce(sum(n) FILTER (mask & before <> 0 AND mask & bit <> 0), 0) AS BIGINT) AS redundant,
    CAST(coalesce(sum(n) FILTER (mask = bit), 0) AS BIGINT) AS unique_fails,
    CAST(coalesce(sum(good) FILTER (mask & before = 0 AND mask & bit <> 0), 0) AS BIGINT) AS good_lost,
    CAST(coalesce(sum(toxic) FILTER (mask & before = 0 AND mask & bit <> 0), 0) AS BIGINT) AS toxic_lost
  FROM c, s GROUP BY 1, 2, 3, 4)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
  CAST(sum(removed) OVER (PARTITION BY part, letter) AS BIGINT) AS shapley FROM r"""

"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager
from contextvars import ContextVar

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wicketlake.session import FREE_SHUFFLES, emptied, freed_shuffles, scratch_path, ship_package  # noqa: F401

#: Bytes of one Arrow batch between the JVM and a Python worker. A batch of
#: the default 10,000 rows has no byte bound, so very long texts could fill a
#: worker's memory.
BATCH_BYTES = 4 * 1024 * 1024
#: Rows of a few numbers each that are broadcast at most, after a count.
BROADCAST_ROWS = 1_000_000
#: Rows of one id that are broadcast at most, after a count.
BROADCAST_IDS = 4_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def texts_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The id and text columns under fixed names, a null text as the empty
    text. Every other column stays behind, so no name can clash."""
    return docs.select(F.col(f"`{id_col}`").alias("doc_id"),
                       F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))


def bound_batches(spark: SparkSession) -> None:
    """Arrow batches of at most ``BATCH_BYTES`` for the session's Python
    stages, whose workers must find this package."""
    ship_package(spark)
    if int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", str(2**31 - 1))) > BATCH_BYTES:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def map_batches(df: DataFrame, fn: Callable[..., dict[str, list]], schema: str, *args) -> DataFrame:
    """``mapInArrow`` with batches of bounded bytes. ``fn(columns, *args)``
    gets one Python list per input column and returns one list (or Arrow
    array) per output column, in the order of ``schema``."""
    bound_batches(df.sparkSession)
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    out = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                made = fn([c.to_pylist() for c in batch.columns], *args)
                yield pa.RecordBatch.from_arrays(
                    [x.cast(f.type) if isinstance(x, pa.Array) else pa.array(x, type=f.type)
                     for x, f in zip(made, out, strict=True)], schema=out)

    return df.mapInArrow(run, schema)


def stream_batches(df: DataFrame, fn: Callable[[Iterator[list]], Iterator[list]], schema: str) -> DataFrame:
    """``mapInArrow`` over a sorted partition: ``fn`` gets an iterator of rows
    (tuples) and yields output rows; batches are cut at ``BATCH_BYTES`` on
    the way in and by a row and size estimate on the way out."""
    bound_batches(df.sparkSession)
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    out = to_arrow_schema(StructType.fromDDL(schema))

    def pack(rows: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(c), type=f.type) for c, f in zip(zip(*rows), out)], schema=out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for batch in batches:
                yield from zip(*[c.to_pylist() for c in batch.columns])

        held, size = [], 0
        for row in fn(rows()):
            held.append(row)
            size += 64 + sum(len(x) for x in row if isinstance(x, (str, bytes, list)))
            if len(held) >= 4096 or size >= BATCH_BYTES // 2:
                yield pack(held)
                held, size = [], 0
        if held:
            yield pack(held)

    return df.mapInArrow(run, schema)


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet under the shared checkpoint folder and read it
    back: cuts the lineage, and survives the loss of executors. The table
    replaces the shuffles that made it, so their files are freed."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    with freed_shuffles(spark):
        df.write.parquet(path)
    made = spark.read.schema(df.schema).parquet(path)
    made._folder = path
    for scope in _SCOPES.get()[-1:]:
        scope[path] = made
    return made


#: Written tables of this thread's open scopes of ``passing_tables``, by folder.
_SCOPES: ContextVar[tuple[dict[str, DataFrame], ...]] = ContextVar("scopes", default=())


@contextmanager
def passing_tables() -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Tables ``written`` in here are freed at the end, but those that went
    through the function given; a scope around this one frees these. So what
    an operator wrote on the way does not lie on disk beside the next one."""
    outer, own, kept = _SCOPES.get(), {}, {}
    token = _SCOPES.set((*outer, own))

    def keep(df: DataFrame) -> DataFrame:
        kept[df._folder] = df
        return df

    try:
        yield keep
        left = [df for path, df in own.items() if path not in kept]
        if left:
            with ThreadPoolExecutor(8) as pool:  # a short job each
                list(pool.map(discard, left))
    finally:
        _SCOPES.reset(token)
        for scope in outer[-1:]:
            scope.update(kept)


def discard(*tables: DataFrame) -> None:
    """Free the disk of ``written`` tables that no step reads any more, by an
    empty table in their place. A lazy table over them cannot be read then."""
    for df in tables:
        for scope in _SCOPES.get():
            scope.pop(df._folder, None)
        emptied(df)


def small(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint where its counted rows are within
    ``limit``; beyond that the same join shuffles both sides."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def without_ids(docs: DataFrame, gone: DataFrame, id_col: str) -> DataFrame:
    """``docs`` without the rows whose id is in the one column of ``gone``,
    all columns as they came; a null id stays."""
    listed = gone.toDF("gone").alias("x")
    return docs.alias("d").join(listed, F.col(f"d.`{id_col}`") == F.col("x.gone"), "left_anti")


_STATE: dict = {}


def worker_state(name, build: Callable):
    """What an operator keeps in a Python worker between batches and tasks.
    Workers outlive a stage; only the latest operator's state is kept, so the
    stages of a pipeline do not add up."""
    if name not in _STATE:
        _STATE.clear()
        _STATE[name] = build()
    return _STATE[name]


class TwoGenerationCache(dict):
    """A bounded memo: when ``limit`` new entries have come in, they become
    the old generation and the older one is forgotten. Never more than twice
    ``limit`` entries, whatever the number of distinct keys."""

    def __init__(self, compute: Callable, limit: int = 300_000):
        super().__init__()
        self.compute, self.limit, self.old = compute, limit, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.compute(key)
        if len(self) >= self.limit:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value

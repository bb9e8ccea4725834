"""A content-addressed store of trained pipelines.

A model is filed under a digest of what made it: its name, the rows it was
trained on (their count and a sum of row hashes, one aggregate), its
parameters and its feature list. The store lies in the shared checkpoint
folder, so a second application that asks for the same model finds it and
scores without training; changed rows, parameters or features make another
digest and train anew. The pipeline is saved under a name of its own first and
its entry is written last, as one file: a failed training leaves no entry, and
of two applications that train at once the later entry stands, both whole.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wicketlake.session import ensure_checkpoint_dir, scratch_path
from wicketlake.sources import sinks

#: Layout of the store and of training; a change of either takes a new name.
STORE = "models-1"
_ENTRY = "name string, digest string, rows string, parameters string, features string, folder string"
#: Entries that this process has seen, by folder.
_SEEN: dict[str, str] = {}


def data_fingerprint(df: DataFrame) -> str:
    """Count and hash sum of the rows, in any order and partitioning."""
    row = df.agg(F.count("*").alias("n"), F.sum(F.xxhash64(*df.columns).cast("decimal(38,0)")).alias("h")).first()
    return f"{row.n}:{row.h or 0}"


def digest(name: str, rows: str, parameters: dict, features: list[str]) -> str:
    said = json.dumps([name, rows, sorted(parameters.items()), features])
    return hashlib.sha256(said.encode()).hexdigest()[:32]


def _entry(spark: SparkSession, key: str) -> str:
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/wicketlake/{STORE}/{key}"


def find(spark: SparkSession, key: str) -> str | None:
    """The folder of the model with this digest, or None."""
    entry = _entry(spark, key)
    if entry not in _SEEN:
        try:
            row = spark.read.schema(_ENTRY).parquet(entry).first()
        except AnalysisException:  # no such entry
            row = None
        if row is None:
            return None
        _SEEN[entry] = row.folder
    return _SEEN[entry]


def stored(name: str, data: DataFrame, parameters: dict, features: list[str], train: Callable[[], PipelineModel]) -> PipelineModel:
    """The pipeline of this name, data, parameters and features: loaded, or
    trained and filed."""
    spark = data.sparkSession
    rows = data_fingerprint(data)
    key = digest(name, rows, parameters, features)
    folder = find(spark, key)
    if folder is None:
        folder = scratch_path(spark, f"model-{name}")
        sinks.save_model(train(), folder)
        entry = spark.createDataFrame([(name, key, rows, json.dumps(parameters, sort_keys=True), json.dumps(features), folder)], _ENTRY)
        entry.coalesce(1).write.mode("overwrite").parquet(_entry(spark, key))
        _SEEN[_entry(spark, key)] = folder
    return sinks.load_pipeline_model(folder)

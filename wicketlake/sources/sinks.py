"""Sinks (S9, S10, S13 to S17): every write is a distributed Spark write;
nothing is collected to the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

AUDIT = "_ingested_at"


def append_with_audit(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Append rows stamped with the ingestion time."""
    df.withColumn(AUDIT, F.current_timestamp()).write.mode("append").format(fmt).save(path)


def replace_table(df: DataFrame, path: str, fmt: str = "parquet",
                  partition_by: list[str] | None = None) -> None:
    """Full replace of a layer table."""
    w = df.write.mode("overwrite").format(fmt)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.save(path)


def reset_tables(spark: SparkSession, tables: list[str]) -> None:
    """Drop catalogue tables of a layer before a reload."""
    for t in tables:
        spark.sql(f"DROP TABLE IF EXISTS {t}")


def write_csv(df: DataFrame, path: str) -> None:
    """CSV result with a header row."""
    df.write.mode("overwrite").option("header", True).csv(path)


def write_json_report(df: DataFrame, path: str) -> None:
    """JSON lines report (one object per row)."""
    df.write.mode("overwrite").json(path)


def merge_metrics(existing: DataFrame | None, new: DataFrame) -> DataFrame:
    """Read-merge-write of a metrics document kept as rows
    (model, metric, value): the new rows replace those of the same model."""
    if existing is None:
        return new
    return existing.join(new.select("model").distinct(), "model", "left_anti").unionByName(new)


def save_model(model, path: str) -> None:
    """Persist an MLlib model or pipeline."""
    model.write().overwrite().save(path)


def load_pipeline_model(path: str):
    from pyspark.ml import PipelineModel
    return PipelineModel.load(path)


def upsert_documents(existing: DataFrame, incoming: DataFrame, key: str = "id",
                     version: str = "_version") -> DataFrame:
    """Upsert by id: the incoming copy of an id replaces the stored one.

    Rows carry a version (0 for stored, 1 for incoming); the newest per id is
    kept with a per-id window, which splits the work by id.
    """
    both = (existing.withColumn(version, F.lit(0))
            .unionByName(incoming.withColumn(version, F.lit(1)), allowMissingColumns=True))
    w = Window.partitionBy(key).orderBy(F.col(version).desc())
    return both.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn", version)

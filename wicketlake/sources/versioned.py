"""Tables in key buckets whose versions are swapped by one file.

A table is a set of bucket folders and a manifest. A change writes new folders
for the buckets that it touches, under a name nobody reads yet, and then one
manifest file that lists, for every bucket, the folder that holds it now, and
the source files that the rows come from. The manifest is written as a single
file, which Spark's committer renames into place: a reader sees the version
before or the version after, and a writer that fails leaves the version
before. Two writers of the same next version cannot both succeed: the second
finds its manifest folder taken and raises. Folders of older versions stay for
readers that still use them.
"""

from __future__ import annotations

from dataclasses import dataclass
from uuid import uuid4

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKET = "_bucket"
_MANIFEST = "kind string, name string, number bigint, stamp bigint"


def files_at(spark: SparkSession, path: str) -> DataFrame:
    """``(name, number, stamp)``: path, size and time of every file at
    ``path`` (a file or a folder). Only the listing is read, no content."""
    listed = (spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet").load(path))
    return listed.select(F.col("path").alias("name"), F.col("length").alias("number"), F.unix_micros("modificationTime").alias("stamp"))


def fingerprint(files: DataFrame) -> str:
    """One text for a set of files: their count and a sum of row hashes."""
    row = files.agg(F.count("*").alias("n"), F.sum(F.xxhash64("name", "number", "stamp").cast("decimal(38,0)")).alias("h")).first()
    return f"{row.n}:{row.h or 0}"


@dataclass(frozen=True)
class Version:
    """One version: its number, the folder of each bucket, the buckets of the
    table, and the fingerprint of the source files."""

    number: int
    folders: dict[int, str]
    buckets: int
    source: str


class VersionedTable:
    """The table under ``root``, in hash buckets of the columns ``key``."""

    def __init__(self, spark: SparkSession, root: str, key: list[str], buckets: int | None = None):
        self.spark, self.root, self.key = spark, root.rstrip("/"), key
        self.wanted = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))

    def bucket_of(self, buckets: int):
        return F.pmod(F.xxhash64(*self.key), F.lit(buckets)).cast("int")

    def head(self) -> Version | None:
        """The newest committed version, or None."""
        try:
            number = self._manifests().agg(F.max("version")).first()[0]
        except AnalysisException:  # no manifest folder yet
            return None
        if number is None:
            return None
        rows = self.manifest(number).filter("kind <> 'source'").collect()  # one row per bucket, and two
        one = {r.kind: r for r in rows}
        return Version(number, {r.number: r.name for r in rows if r.kind == "bucket"}, one["buckets"].number, one["fingerprint"].name)

    def _manifests(self) -> DataFrame:
        listed = files_at(self.spark, f"{self.root}/manifest")
        return listed.select(F.regexp_extract("name", r"/manifest/v(\d+)/[^/]*$", 1).cast("int").alias("version"))

    def manifest(self, number: int) -> DataFrame:
        return self.spark.read.schema(_MANIFEST).parquet(f"{self.root}/manifest/v{number}")

    def sources(self, version: Version) -> DataFrame:
        return self.manifest(version.number).filter("kind = 'source'").select("name", "number", "stamp")

    def read(self, version: Version, buckets: list[int] | None = None) -> DataFrame | None:
        """The rows of ``version``, or of some of its buckets."""
        folders = [f for b, f in sorted(version.folders.items()) if buckets is None or b in buckets]
        if not folders:
            return None
        return self.spark.read.parquet(*[f"{self.root}/{f}" for f in folders])

    def placed(self, rows: DataFrame, buckets: int | None = None) -> DataFrame:
        """``rows`` with their bucket, one task per bucket: the bucket is the
        partition, where a hash of it would put several into one task."""
        n = buckets or self.wanted
        return rows.withColumn(BUCKET, self.bucket_of(n)).repartitionById(n, BUCKET)

    def commit(self, rows: DataFrame, before: Version | None, sources: DataFrame | None = None, source: str = "",
               replaced: set[int] | None = None) -> Version:
        """Write ``rows`` (with their bucket) and swap the version. Buckets
        outside ``replaced`` keep their folders; None replaces all."""
        folder = f"data/{uuid4().hex}"
        rows.write.partitionBy(BUCKET).parquet(f"{self.root}/{folder}")
        try:
            made = self.spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet").load(f"{self.root}/{folder}")
            found = [r[0] for r in made.select(F.regexp_extract("path", rf"/{BUCKET}=(\d+)/[^/]*$", 1)).distinct().collect()]
        except AnalysisException:
            found = []
        folders = {int(b): f"{folder}/{BUCKET}={b}" for b in found if b}
        buckets = before.buckets if before and replaced is not None else self.wanted
        if not folders and replaced is None:  # an empty table keeps its schema
            self.spark.createDataFrame([], rows.drop(BUCKET).schema).coalesce(1).write.parquet(f"{self.root}/{folder}/empty")
            folders = {0: f"{folder}/empty"}
        if before and replaced is not None:
            folders |= {b: f for b, f in before.folders.items() if b not in replaced}
        number = before.number + 1 if before else 1
        listed = [("bucket", f, b, None) for b, f in folders.items()] + [("buckets", None, buckets, None), ("fingerprint", source, None, None)]
        manifest = self.spark.createDataFrame(listed, _MANIFEST)
        if sources is not None:
            manifest = manifest.unionByName(sources.select(F.lit("source").alias("kind"), "name", "number", "stamp"))
        manifest.coalesce(1).write.mode("errorifexists").parquet(f"{self.root}/manifest/v{number}")
        return Version(number, folders, buckets, source)

    def upsert(self, incoming: DataFrame) -> Version:
        """Rows of ``incoming`` replace the rows of their keys (the last one
        by the other columns, where a key comes twice); other rows stay. Only
        the buckets that ``incoming`` touches are read and written."""
        before = self.head()
        fresh = incoming.groupBy(*self.key).agg(F.max(F.struct(*[c for c in incoming.columns if c not in self.key])).alias("_row")).select(
            *self.key, "_row.*").select(*incoming.columns)
        if before is None:
            return self.commit(self.placed(fresh), None)
        touched = {r[0] for r in fresh.select(self.bucket_of(before.buckets)).distinct().collect()}  # at most one row per bucket
        old = self.read(before, sorted(touched))
        if old is not None:
            kept = old.join(fresh.select(*self.key), self.key, "left_anti")
            fresh = kept.unionByName(fresh, allowMissingColumns=True)
        return self.commit(self.placed(fresh, before.buckets), before, replaced=touched)

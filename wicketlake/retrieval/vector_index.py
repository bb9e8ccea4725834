"""Exact nearest vectors through an index of cells and codes.

Building. K-Means on a bounded sample of the vectors gives the cell centres
(``SAMPLE_ROWS`` rows by smallest id hash, ``MAX_CELLS`` cells: both numbers
are parameters). Every vector is then put into its nearest cell with its
distance to the centre, and gets a code of one byte per dimension (its values
over a scale of its own) with the exact length of what the code leaves out.

Searching is exact. Two bounds keep vectors from being compared:

* cells: by the triangle inequality no member is nearer to a query than the
  distance to the centre minus the cell's radius (nor than its inner radius
  minus that distance). Cells are visited in the order of that bound: the
  first ones that hold k vectors give a k-th distance, and cells (and members,
  by their own distance to the centre) beyond it are left out;
* codes: the distance to a code, give or take what the code leaves out, bounds
  the distance to its vector. Only vectors whose lower bound is within the
  k-th upper bound are compared in full.

Cells help where vectors form clusters. Where all distances are alike (random
directions), no triangle inequality separates anything and the codes do the
work: a quarter of the bytes is read for every vector, and few full vectors
are compared. Ties go to the smaller id; rows without a vector are in no cell.
Rows of a cell are dealt by id hash, so no cell is one task.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wicketlake.operators import topk
from wicketlake.session import written

SAMPLE_ROWS = 20_000
MAX_CELLS = 256
#: Bounds are widened by this share, for the rounding of sums in doubles.
SLACK = 1e-9


def squared_distance(a: Column, b: Column) -> Column:
    """Squared Euclidean distance of two equal-length arrays (in double)."""
    diffs = F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double")))
    return F.aggregate(diffs, F.lit(0.0), lambda acc, v: acc + v)


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda acc, v: acc + v)


def cell_centres(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", cells: int | None = None,
                 sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """``(cell, centre)`` from a bounded sample: at most ``MAX_CELLS`` rows
    (default: the square root of the sample's rows)."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    spark = vectors.sparkSession
    known = vectors.filter(F.col(vec_col).isNotNull())
    sample = known.orderBy(F.xxhash64(id_col), id_col).limit(sample_rows).select(
        array_to_vector(F.col(vec_col).cast("array<double>")).alias("features"))
    sample = written(sample, "index-sample")
    rows = sample.count()
    k = cells or min(MAX_CELLS, max(2, int(rows ** 0.5)))
    found = [r.features.toArray() for r in sample.collect()] if rows <= k else KMeans(k=k, maxIter=10, seed=42).fit(sample).clusterCenters()
    return spark.createDataFrame([(i, [float(x) for x in c]) for i, c in enumerate(found)], "cell int, centre array<double>")


def build_index(vectors: DataFrame, centres: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """The index as one table, rows of a cell together: ``(id, embedding,
    cell, distance, code, scale, norm, rest)``."""
    known = vectors.filter(F.col(vec_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(vec_col).alias("embedding"))
    table = F.lit([r.centre for r in centres.orderBy("cell").collect()] or [[0.0]])  # at most MAX_CELLS rows
    near = F.array_min(F.transform(table, lambda c, i: F.struct(squared_distance(F.col("embedding"), c).alias("d"), i.alias("cell"))))
    placed = known.withColumn("near", near).select(
        "id", "embedding", F.col("near.cell").alias("cell"), F.sqrt("near.d").alias("distance"))
    top = F.array_max(F.transform("embedding", lambda x: F.abs(x.cast("double"))))
    scaled = placed.withColumn("scale", F.when(top > 0, top / 127).otherwise(F.lit(1.0)))
    coded = scaled.withColumn("code", F.transform("embedding", lambda x: F.round(x.cast("double") / F.col("scale")).cast("tinyint")))
    back = F.transform("code", lambda c: c.cast("double") * F.col("scale"))
    made = coded.withColumns({"norm": _dot(F.col("code"), F.col("code")) * F.col("scale") * F.col("scale"),
                              "rest": F.sqrt(squared_distance(F.col("embedding"), back))})
    n = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return made.repartitionByRange(n, "cell", F.xxhash64("id")).sortWithinPartitions("cell", "distance")


def cells_of(index: DataFrame, centres: DataFrame) -> DataFrame:
    """One row per cell with members: centre, count, inner and outer radius."""
    return index.groupBy("cell").agg(F.count("*").alias("n"), F.min("distance").alias("inner"),
                                     F.max("distance").alias("outer")).join(centres, "cell")


@dataclass
class Search:
    """An answer and what it took: ``hits (query_id, id, dist, rank)``, and the
    (query, vector) pairs that were bounded by codes and compared in full."""

    hits: DataFrame
    coded: DataFrame
    compared: DataFrame


def search(index: DataFrame, centres: DataFrame, queries: DataFrame, k: int = 5) -> Search:
    """The ``k`` nearest vectors of every row of ``queries (query_id,
    query_vec)``, by squared Euclidean distance."""
    q = written(queries.select("query_id", "query_vec", _dot(F.col("query_vec"), F.col("query_vec")).alias("q2")), "search-queries")
    # Queries meet the cells' centres (at most MAX_CELLS rows, kept in one array).
    cells = cells_of(index, centres).agg(F.collect_list(F.struct("cell", "centre", "n", "inner", "outer")).alias("cells"))
    met = q.select("query_id", "query_vec", "q2", F.explode(cells.scalar()).alias("c"))
    away = F.sqrt(squared_distance(F.col("query_vec"), F.col("c.centre")))
    visits = written(met.withColumn("away", away).select(
        "query_id", "query_vec", "q2", "away", F.col("c.cell").alias("cell"), F.col("c.n").alias("n"),
        F.greatest(F.lit(0.0), F.col("away") - F.col("c.outer"), F.col("c.inner") - F.col("away")).alias("bound")), "search-visits")
    order = Window.partitionBy("query_id").orderBy("bound", "away", "cell").rowsBetween(Window.unboundedPreceding, -1)
    first = visits.withColumn("before", F.coalesce(F.sum("n").over(order), F.lit(0))).filter(F.col("before") < k)

    codes = index.select("id", "cell", "distance", "code", "scale", "norm", "rest")

    def bounded(visit: DataFrame, within: Column | None = None) -> DataFrame:
        pairs = codes.join(visit, "cell")
        if within is not None:
            pairs = pairs.filter(F.abs(F.col("away") - F.col("distance")) <= within)
        squared = F.col("q2") + F.col("norm") - 2 * F.col("scale") * _dot(F.col("query_vec"), F.col("code"))
        to_code = F.sqrt(F.greatest(F.lit(0.0), squared))
        return pairs.select("query_id", "id", "cell", (to_code - F.col("rest")).alias("low"), (to_code + F.col("rest")).alias("high"))

    def kth_high(pairs: DataFrame) -> DataFrame:
        best = topk.top_k_per_group(pairs.select("query_id", "id", "high"), k, ["query_id"], F.col("high").asc(), "id")
        found = best.groupBy("query_id").agg(F.max("high").alias("reach"), F.count("*").alias("found"))
        endless = F.when(F.col("found") < k, F.lit(float("inf"))).otherwise(F.col("reach") * (1 + SLACK) + SLACK)
        return found.select("query_id", endless.alias("reach"))

    reach = kth_high(bounded(first))
    rest = visits.join(reach, "query_id").filter(F.col("bound") <= F.col("reach"))
    coded = written(bounded(rest, F.col("reach")), "search-codes")
    # The first round's k-th bound holds over all vectors, the second's is nearer.
    compared = coded.join(kth_high(coded), "query_id").filter(F.col("low") <= F.col("reach")).select("query_id", "id", "cell")
    compared = written(compared, "search-compared")
    full = index.select("id", "cell", "embedding").join(compared, ["cell", "id"]).join(q.select("query_id", "query_vec"), "query_id")
    scored = full.select("query_id", "id", squared_distance(F.col("embedding"), F.col("query_vec")).alias("dist"))
    return Search(topk.top_k_per_group(scored, k, ["query_id"], F.col("dist").asc(), "id"), coded, compared)


def nearest(index: DataFrame, centres: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "vec_id") -> DataFrame:
    return search(index, centres, queries, k).hits.withColumnRenamed("id", id_col)

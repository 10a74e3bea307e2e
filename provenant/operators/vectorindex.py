"""An inverted-file index of vectors: lists around centroids, of which a search reads the nearest.

Centroids are fitted by k-means on the directions of at most ``SAMPLE`` vectors (those whose chunk ids hash lowest); every vector is then
put on the list of its nearest centroid, and each list of a version keeps its number of rows and its radius, the widest angle to the
centroid.  Vectors of length zero have a list of their own, -1.

``search`` reads a query's nearest lists until they hold ``ROWS_EACH`` times as many rows as the version's ``ef``, or the share of the version that
``tune`` found to be needed: an approximation whose ``recall`` is measured.  ``search_exact`` then reads every other list that, by its centroid's angle less its radius, could still hold something better
than what was found: the rows of ``retrieval.vector_search``, by an angle's triangle inequality.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.shared import cut
from ..functions.text import with_norm
from .explore import recommended_ef
from .retrieval import best, best_of_cells, in_cells

#: Vectors that centroids are fitted on, and bounds of the number of lists (the root of the number of vectors).
SAMPLE, FEWEST, MOST = 20_000, 8, 1024
#: Rows that are read for each of ``ef``: a graph of the usual degree compares as many for each candidate that it keeps.
ROWS_EACH = 16
#: Of the exact hits, those that a tuned search should find, and the questions that it is tuned with at most.
TARGET, TUNED = 0.95, 200
#: Up to so many lists (of all versions) are broadcast to the queries; beyond, both are shuffled by version.
BROADCAST_PROBES = 20_000
#: What rounding may add to an angle.
SLACK = 1e-6


def fit(vectors: DataFrame, lists: int | None = None, seed: int = 1) -> np.ndarray:
    """Centroids (rows of length one) of chunk_id and embedding; as many as the root of their number unless told."""
    given = vectors.where("embedding IS NOT NULL")
    if lists is None:
        lists = int(min(MOST, max(FEWEST, given.count() ** 0.5)))
    sized = with_norm(given.select("chunk_id", "embedding"), "embedding", "norm").where("norm > 0")
    sample = sized.orderBy(F.xxhash64("chunk_id"), "chunk_id").limit(SAMPLE)
    points = sample.select(array_to_vector(F.transform("embedding", lambda v: v / F.col("norm"))).alias("features")).coalesce(1).cache()
    try:
        if points.isEmpty():
            return np.zeros((0, 0))
        centers = np.array(KMeans(k=max(2, lists), seed=seed, maxIter=15).fit(points).clusterCenters())
    finally:
        points.unpersist()
    norms = np.linalg.norm(centers, axis=1, keepdims=True)
    return np.unique(centers[norms[:, 0] > 0] / norms[norms[:, 0] > 0], axis=0)


def _angles(centroids: np.ndarray):
    """A function of vectors: for each, the angle to every centroid (null for a vector of length zero)."""

    def of(vectors: pa.Array) -> np.ndarray:
        flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
        if len(flat) != len(vectors) * centroids.shape[1]:
            raise ValueError(f"expected vectors of {centroids.shape[1]} dimensions")
        x = flat.reshape(len(vectors), -1)
        norm = np.linalg.norm(x, axis=1, keepdims=True)
        return np.where(norm > 0, np.arccos(np.clip(x @ centroids.T / np.where(norm > 0, norm, 1), -1, 1)), np.nan)

    return of


def build(chunks: DataFrame, centroids: np.ndarray) -> DataFrame:
    """version_id, chunk_id, embedding and norm (in double precision), list and gap (the angle to its centroid) of every chunk with a vector."""
    angles = _angles(centroids)

    def place(vectors: pa.Array) -> pa.Array:
        if not len(centroids):
            return pa.array([{"list": -1, "gap": 0.0}] * len(vectors), pa.struct([("list", pa.int32()), ("gap", pa.float64())]))
        to = angles(vectors)
        none = np.isnan(to[:, 0])
        to[none] = 0.0
        at = to.argmin(1)
        return pa.StructArray.from_arrays([pa.array(np.where(none, -1, at).astype(np.int32)), pa.array(to[np.arange(len(to)), at])], ["list", "gap"])

    place.__annotations__ = {"vectors": pa.Array, "return": pa.Array}
    placed = with_norm(chunks.where("embedding IS NOT NULL").select("version_id", "chunk_id", "embedding"), "embedding", "norm")
    return placed.withColumn("x", F.arrow_udf(place, "list int, gap double")("embedding")).select("version_id", "chunk_id", "embedding", "norm", "x.list", "x.gap")


def write(index: DataFrame, centroids: np.ndarray, path: str) -> None:
    """The index, a folder for each list, and its centroids beside it."""
    spark = index.sparkSession
    rows = [(i, [float(x) for x in c]) for i, c in enumerate(centroids)]
    spark.createDataFrame(rows, "list int, center array<double>").coalesce(1).write.mode("overwrite").parquet(f"{path}/centroids")
    index.repartition("list", F.pmod(F.xxhash64("chunk_id"), F.lit(8))).write.mode("overwrite").partitionBy("list").parquet(f"{path}/lists")


def read(spark: SparkSession, path: str) -> tuple[DataFrame, np.ndarray]:
    """The index and its centroids (at most ``MOST`` rows) as ``write`` left them."""
    rows = spark.read.parquet(f"{path}/centroids").orderBy("list").collect()
    return spark.read.parquet(f"{path}/lists"), np.array([r["center"] for r in rows]) if rows else np.zeros((0, 0))


def spheres(index: DataFrame) -> DataFrame:
    """version_id, list, radius and number of rows of every list of every version."""
    return index.groupBy("version_id", "list").agg(F.max("gap").alias("radius"), F.count("*").alias("held"))


def reach(index: DataFrame, centroids: np.ndarray, queries: DataFrame, top_k: int, share: float = 0.0, ef: Column | int | None = None) -> DataFrame:
    """query_id, version_id, list, bound (the greatest cosine that the list may hold), before and near, for each list of the query's version.

    ``before``: the share of the version's rows on nearer lists; ``near``: whether that is less than ``share``, or less than ``ROWS_EACH`` times
    ``ef`` rows; ``ef`` follows the version's number of vectors unless told.
    """
    angles = _angles(centroids)

    def away(vectors: pa.Array) -> pa.Array:
        to = np.nan_to_num(angles(vectors), nan=0.0) if len(centroids) else np.zeros((len(vectors), 0))
        return pa.array(to.tolist(), pa.list_(pa.float64()))

    away.__annotations__ = {"vectors": pa.Array, "return": pa.Array}
    q = _asked(queries)
    q = q.select("query_id", "version_id", "query_norm", F.arrow_udf(away, "array<double>")("query_embedding").alias("away"))
    lists = cut(spheres(index))
    few = F.broadcast if lists.limit(BROADCAST_PROBES + 1).count() <= BROADCAST_PROBES else lambda df: df
    lists = lists.withColumn("total", F.sum("held").over(Window.partitionBy("version_id")))
    asked = recommended_ef(F.col("total")) if ef is None else ef if isinstance(ef, Column) else F.lit(ef)
    lists = lists.withColumn("enough", F.greatest(ROWS_EACH * asked, F.lit(2 * top_k), F.ceil(F.lit(share) * F.col("total"))))
    met = q.join(few(lists), "version_id").withColumn("angle", F.get("away", F.col("list"))).drop("away")
    bound = F.when(F.col("list") < 0, F.lit(0.0)).when(F.col("query_norm") == 0, F.lit(0.0)).otherwise(F.cos(F.greatest(F.lit(0.0), F.col("angle") - F.col("radius") - SLACK)))
    nearer = Window.partitionBy("query_id").orderBy(F.col("angle").asc_nulls_last(), "list").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("held").over(nearer), F.lit(0))
    return met.select("query_id", "version_id", "list", bound.alias("bound"), (before / F.col("total")).alias("before"), (before < F.col("enough")).alias("near"))


def _asked(queries: DataFrame) -> DataFrame:
    return with_norm(queries.where("embedding IS NOT NULL").select("query_id", "version_id", F.col("embedding").alias("query_embedding")), "query_embedding", "query_norm")


def _scored(index: DataFrame, queries: DataFrame, probes: DataFrame, keep: int) -> DataFrame:
    """query_id, chunk_id and score of the best rows (``keep`` of each cell) of the lists that are probed; a query with its lists goes once to each cell of its version."""
    listed = probes.groupBy("query_id").agg(F.collect_list("list").alias("lists"))
    rows, asked = in_cells(index.select("version_id", "chunk_id", "embedding", "norm", "list"), _asked(queries).join(listed, "query_id"))
    return best_of_cells(rows, asked, ["version_id", "part", "set"], keep)


def search(index: DataFrame, centroids: np.ndarray, queries: DataFrame, top_k: int, share: float = 0.0, ef: Column | int | None = None) -> DataFrame:
    """query_id, chunk_id, score and rank0 of the best 2 * top_k chunks on each query's nearest lists."""
    return best(_scored(index, queries, reach(index, centroids, queries, top_k, share, ef).where("near"), 2 * top_k), top_k)


def search_exact(index: DataFrame, centroids: np.ndarray, queries: DataFrame, top_k: int, share: float = 0.0, ef: Column | int | None = None) -> DataFrame:
    """The rows of ``retrieval.vector_search``, from the lists that can hold them; lists and first hits are read twice, so they are cut into the shared folder."""
    lists = cut(reach(index, centroids, queries, top_k, share, ef))
    first = cut(best(_scored(index, queries, lists.where("near"), 2 * top_k), top_k))
    worst = first.groupBy("query_id").agg(F.count("*").alias("found"), F.min("score").alias("worst"))
    open_ = F.col("found").isNull() | (F.col("found") < 2 * top_k) | (F.col("bound") >= F.col("worst"))
    more = lists.where(~F.col("near")).join(worst, "query_id", "left").where(open_)
    return best(first.select("query_id", "chunk_id", "score").unionByName(_scored(index, queries, more, 2 * top_k)), top_k)


def recall(found: DataFrame, exact: DataFrame, k: int) -> DataFrame:
    """query_id and recall: the share of the exact first k that the first k found have."""
    a, b = found.where(F.col("rank0") < k).select("query_id", "chunk_id", F.lit(1).alias("hit")), exact.where(F.col("rank0") < k).select("query_id", "chunk_id")
    return b.join(a, ["query_id", "chunk_id"], "left").groupBy("query_id").agg((F.count("hit") / F.count("*")).alias("recall"))


def tune(index: DataFrame, centroids: np.ndarray, top_k: int, target: float = TARGET, sample: int = TUNED) -> float:
    """The share of a version's rows that must be read for ``target`` of the exact first ``top_k`` to be among them.

    Learned from at most ``sample`` vectors of the index (those whose ids hash lowest) as questions: of each of their exact hits, how much stands on nearer lists.
    """
    asked = index.orderBy(F.xxhash64("chunk_id", F.lit(1)), "chunk_id").limit(sample).select(F.col("chunk_id").alias("query_id"), "version_id", "embedding")
    hits = search_exact(index, centroids, asked, top_k).where(F.col("rank0") < top_k).select("query_id", "chunk_id")
    on = hits.join(index.select("chunk_id", "list"), "chunk_id").join(reach(index, centroids, asked, top_k).select("query_id", "list", "before"), ["query_id", "list"])
    needed = on.agg(F.percentile("before", F.lit(target)).alias("needed")).first()["needed"]
    return 0.0 if needed is None else float(needed) + SLACK

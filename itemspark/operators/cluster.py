"""K-means on item vectors and its agreement with the factor assignment."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from itemspark.session import cut_lineage

BLOCK_ROWS = 2048           # points of a block, about; a pair of blocks is one matrix
GROUP = 16                  # blocks of a group; a task meets two groups


def assemble(vectors: DataFrame, names: list[str]) -> DataFrame:
    return VectorAssembler(inputCols=names, outputCol="features").transform(vectors)


def kmeans(vectors: DataFrame, names: list[str], k: int, seed: int = 42) -> DataFrame:
    """Add ``cluster`` (0..k-1)."""
    table = assemble(vectors, names)
    model = KMeans(k=k, seed=seed, predictionCol="cluster").fit(table)
    return model.transform(table).drop("features")


def silhouettes(vectors: DataFrame, names: list[str], counts, seed: int = 42,
                squared: bool = True) -> DataFrame:
    """Mean silhouette per cluster count, one row per count: from squared Euclidean
    distances (sums per cluster), or from plain ones (all pairs of points, in blocks)."""
    table = assemble(vectors, names).persist()
    try:
        scores = []
        for k in counts:
            fitted = KMeans(k=k, seed=seed, predictionCol="cluster").fit(table).transform(table)
            if fitted.select("cluster").distinct().limit(2).count() > 1:
                measure = (ClusteringEvaluator(predictionCol="cluster").evaluate(fitted) if squared
                           else euclidean_silhouette(fitted, names).first()["silhouette"])
                scores.append((k, float(measure)))
    finally:
        table.unpersist()
    return vectors.sparkSession.createDataFrame(scores, "k int, silhouette double")


def silhouette(clustered: DataFrame, names: list[str]) -> float:
    """Mean silhouette (squared Euclidean) of a given ``cluster`` column."""
    return float(ClusteringEvaluator(predictionCol="cluster").evaluate(assemble(clustered, names)))


def _distances(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Euclidean distances by one matrix product; those it would blur, by differences."""
    size = (p * p).sum(1)[:, None] + (q * q).sum(1)
    squares = size - 2 * (p @ q.T)
    i, j = np.nonzero(squares < 1e-5 * size)
    squares[i, j] = ((p[i] - q[j]) ** 2).sum(1)
    return np.sqrt(np.maximum(squares, 0.0))


def point_blocks(points: DataFrame, names: list[str], block_rows: int) -> DataFrame:
    """cluster, block, ids and the packed matrix of points of one cluster (column ``_id``)."""
    blocks = F.ceil(F.count(F.lit(1)) / block_rows).cast("int").alias("_blocks")
    sizes = cut_lineage(points.groupBy("cluster").agg(blocks))
    kind = dict(points.dtypes)["cluster"]

    def pack(group: pa.Table) -> pa.Table:
        matrix = np.stack([group.column(c).to_numpy() for c in names], 1)
        return pa.table({"cluster": group.column("cluster")[:1], "block": group.column("block")[:1],
                         "ids": pa.array([group.column("_id").to_numpy().astype("<i8").tobytes()], pa.binary()),
                         "matrix": pa.array([matrix.astype("<f8").tobytes()], pa.binary())})

    return (points.join(sizes, "cluster").withColumn("block", F.pmod(F.xxhash64("_id"), F.col("_blocks")).cast("int"))
            .groupBy("cluster", "block").applyInArrow(pack, f"cluster {kind}, block int, ids binary, matrix binary"))


def distance_sums(points: DataFrame, names: list[str], block_rows: int = BLOCK_ROWS) -> DataFrame:
    """_id, cluster, total: the distances of each point to all points of each cluster.

    Blocks of points meet on a grid, so a block is copied once per group of blocks; a
    task adds the sums of a point and a cluster up before they are shuffled.
    """
    blocks = cut_lineage(point_blocks(points, names, block_rows))
    groups = -(-max(blocks.count(), 1) // GROUP)
    group = F.pmod(F.xxhash64("cluster", "block"), F.lit(groups)).cast("int")
    every = F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))
    left = blocks.select(group.alias("row"), every.alias("column"), F.col("ids"), F.col("matrix").alias("p"))
    right = blocks.select(every.alias("row"), group.alias("column"), "cluster", F.col("matrix").alias("q"))
    kind = dict(points.dtypes)["cluster"]
    label = blocks.schema["cluster"].dataType
    width = len(names)

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_type
        sums = {}

        def told():
            for (ids, cluster), total in sums.items():
                n = len(total)
                yield pa.record_batch({"_id": pa.array(np.frombuffer(ids, "<i8")),
                                       "cluster": pa.array([cluster] * n, to_arrow_type(label)), "total": pa.array(total)})
            sums.clear()

        for batch in batches:
            for r in batch.to_pylist():
                p, q = (np.frombuffer(r[c], "<f8").reshape(-1, width) for c in ("p", "q"))
                key = (r["ids"], r["cluster"])
                sums[key] = sums.get(key, 0.0) + _distances(p, q).sum(1)
                if len(sums) > 4 * GROUP:
                    yield from told()
        yield from told()

    return (left.join(right, ["row", "column"]).select("ids", "cluster", "p", "q")
            .mapInArrow(run, f"_id long, cluster {kind}, total double")
            .groupBy("_id", "cluster").agg(F.sum("total").alias("total")))


def euclidean_silhouette(clustered: DataFrame, names: list[str], block_rows: int = BLOCK_ROWS) -> DataFrame:
    """One row, silhouette: the mean over all points of (b - a) / max(a, b), where a is
    the mean distance to the other points of its ``cluster`` and b the smallest mean
    distance to the points of another one.

    A point alone in its cluster counts as 0, so does one whose a and b are both 0.
    Rows with a null cluster or a null or non-finite component are left out; null if
    there are fewer than two clusters.
    """
    fine = F.col("cluster").isNotNull()
    for c in names:
        fine &= F.col(c).isNotNull() & (F.abs(F.col(c)) < float("inf"))
    points = cut_lineage(clustered.where(fine).select("cluster", *[F.col(c).cast("double").alias(c) for c in names])
                         .withColumn("_id", F.monotonically_increasing_id()))
    sizes = points.groupBy("cluster").agg(F.count(F.lit(1)).alias("_n"))
    own = points.select("_id", F.col("cluster").alias("_own"))
    far = distance_sums(points, names, block_rows).join(sizes, "cluster").join(own, "_id")
    same = F.col("cluster") == F.col("_own")
    near = far.groupBy("_id").agg(
        F.max(F.when(same & (F.col("_n") > 1), F.col("total") / (F.col("_n") - 1))).alias("a"),
        F.min(F.when(~same, F.col("total") / F.col("_n"))).alias("b"))
    value = F.when(F.col("b").isNotNull(), F.when(
        F.greatest("a", "b") > 0, F.coalesce((F.col("b") - F.col("a")) / F.greatest("a", "b"), F.lit(0.0))).otherwise(0.0))
    value = F.when(F.col("a").isNull() & F.col("b").isNotNull(), 0.0).otherwise(value)
    return near.agg(F.avg(value).alias("silhouette"))


def best_count(scores: DataFrame) -> DataFrame:
    """The first count with the largest silhouette."""
    return scores.orderBy(F.col("silhouette").desc(), "k").limit(1)


def agreement(clusters: DataFrame, primary: DataFrame) -> DataFrame:
    """Share of items whose cluster number equals the factor number; an item without
    a factor does not match."""
    both = clusters.select("item", "cluster").join(primary.select("item", "factor"), "item", "left")
    match = F.coalesce(F.col("cluster") == F.col("factor"), F.lit(False))
    return both.agg(F.count(F.lit(1)).alias("n"), F.avg(match.cast("double")).alias("agreement"))


def matched_agreement(clusters: DataFrame, primary: DataFrame) -> DataFrame:
    """Agreement when every cluster takes its most frequent factor as its label."""
    counts = (clusters.select("item", "cluster").join(primary.select("item", "factor"), "item")
              .groupBy("cluster", "factor").agg(F.count(F.lit(1)).alias("n")))
    best = counts.groupBy("cluster").agg(F.max("n").alias("best"), F.sum("n").alias("size"))
    return best.agg(F.sum("size").alias("n"), (F.sum("best") / F.sum("size")).alias("agreement"))

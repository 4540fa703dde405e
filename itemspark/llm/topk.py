"""Exact top-k by inner product: tiled matrix products and tree merging.

Query vectors are packed into tiles and all vectors into shards, one row each, in the
narrowest integers that hold them.  Every tile meets every shard once, by an equi-join on
the cells of a grid: a cell holds a group of tiles and a group of shards, so a tile is
copied once for each group of shards, not for each shard.  A task multiplies two integer
matrices at a time, keeps the k best columns of each row, and the short lists are merged
in a tree of aggregations.  Blocks and groups have a bounded size, so a task's memory
doesn't depend on the table.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from itemspark.llm.registry import query, table
from itemspark.session import cut_lineage

TILE_ROWS = 1024            # queries of a tile
SHARD_ROWS = 4096           # candidates of a shard
FAN_IN = 32                 # lists merged at once
GROUP = 32                  # most tiles, and most shards, of a grid cell
LIMIT = (1 << 63) - 1       # larger scores are stored as this, smaller ones as its negative

BLOCK = "block int, dims int, kind string, ids binary, vectors binary"
TOPS = "tile int, slot int, query_id long, shard int, top array<struct<minus: long, vec_id: long>>"


def quantised(vectors: DataFrame, scale: int = 64) -> DataFrame:
    """vec_id and vec, floor(scale * component); rows with a null id, a null vector or a
    null or non-finite component are left out."""
    x = F.col("embedding")
    fine = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) < float("inf")))
    return (vectors.where(F.col("vec_id").isNotNull() & x.isNotNull()).where(fine)
            .select("vec_id", F.transform(x, lambda c: F.floor(c.cast("double") * scale)).alias("vec")))


def packed(rows: DataFrame, n_blocks: int) -> DataFrame:
    """Rows dealt into blocks by a hash of the whole row; exact repeats count once."""
    def pack(group: pa.Table) -> pa.Table:
        ids = group.column("vec_id").to_numpy()
        lists = group.column("vec").combine_chunks()
        lengths = lists.value_lengths().to_numpy(zero_copy_only=False).astype("i8")
        dims = int(lengths.max(initial=0))
        matrix = np.zeros((len(ids), dims), "<i8")
        matrix[np.arange(dims) < lengths[:, None]] = lists.flatten().to_numpy()
        order = np.argsort(ids, kind="stable")
        kind = next(t for t in ("<i2", "<i4", "<i8") if t == "<i8" or np.array_equal(matrix, matrix.astype(t)))
        return pa.table({"block": pa.array([group.column("block")[0].as_py()], pa.int32()),
                         "dims": pa.array([dims], pa.int32()),
                         "kind": pa.array([kind]), "ids": pa.array([ids[order].astype("<i8").tobytes()], pa.binary()),
                         "vectors": pa.array([matrix[order].astype(kind).tobytes()], pa.binary())})

    block = F.pmod(F.xxhash64("vec_id", "vec"), F.lit(n_blocks)).cast("int")
    return rows.withColumn("block", block).dropDuplicates().groupBy("block").applyInArrow(pack, BLOCK)


def best_of_pair(q_ids, q, c_ids, c, k: int):
    """Per row of q: the k best columns of q @ c.T, by score, then smaller id.

    ``c_ids`` ascend.  Columns with the query's own id don't count.  Returns arrays
    (row, minus score, id).
    """
    dims = max(q.shape[1], c.shape[1])
    q, c = (np.pad(m, ((0, 0), (0, dims - m.shape[1]))) for m in (q, c))
    n = len(c)
    peak = lambda m: float(np.abs(m.astype("f8")).max(initial=0))
    if peak(q) * peak(c) * max(dims, 1) * (n + 1) < 2.0 ** 52:
        score = (q.astype("f8") @ c.astype("f8").T).astype("i8")           # whole numbers: exact
        rank = score * n + np.arange(n - 1, -1, -1)
        own = q_ids[:, None] == c_ids[None, :]
        rank[own] = np.iinfo("i8").min
        take = min(k, n)
        columns = np.argpartition(rank, n - take, axis=1)[:, n - take:]
        rows = np.repeat(np.arange(len(q)), take)
        columns = columns.ravel()
        kept = ~own[rows, columns]
        rows, columns = rows[kept], columns[kept]
        return rows, -score[rows, columns], c_ids[columns]
    found = []
    exact = c.astype(object)
    for i, row in enumerate(q.astype(object)):
        scores = [max(-LIMIT, min(LIMIT, int(s))) for s in exact @ row] if dims else [0] * n
        order = sorted((j for j in range(n) if c_ids[j] != q_ids[i]), key=lambda j: (-scores[j], c_ids[j]))[:k]
        found += [(i, -scores[j], c_ids[j]) for j in order]
    return tuple(np.array([f[x] for f in found], "i8") for x in range(3))


def group_size(n_tiles: int, n_shards: int, tasks: int) -> int:
    """Tiles and shards of a grid cell: as many as leave a cell for each of ``tasks``."""
    return max(1, min(GROUP, math.isqrt(n_tiles * n_shards // max(tasks, 1))))


def met(tiles: DataFrame, shards: DataFrame, n_tiles: int, n_shards: int, size: int) -> DataFrame:
    """Every tile with every shard, once, in grid cells of ``size`` tiles and shards."""
    groups = lambda n: F.explode(F.sequence(F.lit(0), F.lit((n - 1) // size)))
    across = tiles.withColumn("row", F.floor(F.col("tile") / size).cast("int")).withColumn("column", groups(n_shards))
    down = shards.withColumn("column", F.floor(F.col("shard") / size).cast("int")).withColumn("row", groups(n_tiles))
    return across.join(down, ["row", "column"]).drop("row", "column")


def top_k(queries: DataFrame, candidates: DataFrame, k: int) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k largest integer inner products of
    each query with the candidates of another id, ties to the smaller vec_id.

    Both inputs have vec_id and vec.  Shorter vectors count as filled with zeros.  Rows
    that are wholly equal count once; different vectors of one id are each a query and
    a candidate of their own.  With fewer than k candidates all are given; an empty
    side gives no rows.
    """
    n_tiles = max(1, -(-queries.count() // TILE_ROWS))
    n_shards = max(1, -(-candidates.count() // SHARD_ROWS))
    tiles = cut_lineage(packed(queries, n_tiles), "tiles").toDF("tile", "q_dims", "q_kind", "q_ids", "q")
    shards = cut_lineage(packed(candidates, n_shards), "shards").toDF("shard", "c_dims", "c_kind", "c_ids", "c")
    tasks = 4 * queries.sparkSession.sparkContext.defaultParallelism
    pairs = met(tiles, shards, n_tiles, n_shards, group_size(n_tiles, n_shards, tasks))

    def run(batches):
        for batch in batches:
            for r in batch.to_pylist():
                q_ids, c_ids = (np.frombuffer(r[x], "<i8") for x in ("q_ids", "c_ids"))
                q = np.frombuffer(r["q"], r["q_kind"]).reshape(len(q_ids), r["q_dims"])
                c = np.frombuffer(r["c"], r["c_kind"]).reshape(len(c_ids), r["c_dims"])
                rows, minus, ids = best_of_pair(q_ids, q, c_ids, c, k)
                cuts = np.searchsorted(rows, np.arange(len(q_ids) + 1))
                tops = pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.StructArray.from_arrays(
                    [pa.array(minus, pa.int64()), pa.array(ids, pa.int64())], ["minus", "vec_id"]))
                m = len(q_ids)
                yield pa.record_batch({"tile": pa.array(np.full(m, r["tile"]), pa.int32()),
                                       "slot": pa.array(np.arange(m), pa.int32()), "query_id": pa.array(q_ids, pa.int64()),
                                       "shard": pa.array(np.full(m, r["shard"]), pa.int32()), "top": tops})

    tops, left = pairs.mapInArrow(run, TOPS), n_shards
    while True:
        left = -(-left // FAN_IN)
        tops = (tops.groupBy("tile", "slot", "query_id", F.floor(F.col("shard") / FAN_IN).cast("int").alias("shard"))
                .agg(F.slice(F.sort_array(F.flatten(F.collect_list("top"))), 1, k).alias("top")))
        if left == 1:
            break
    return (tops.select("query_id", F.posexplode("top").alias("place", "hit"))
            .select("query_id", (F.col("place") + 1).alias("rank"), "hit.vec_id", (-F.col("hit.minus")).alias("score")))


@query("op6_topk", """
    WITH parts AS (
        SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS DOUBLE)) AS v
        FROM embeddings
        WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    scored AS (
        SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
        FROM parts q JOIN parts c ON q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id),
    placed AS (
        SELECT *, ROW_NUMBER() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored)
    SELECT query_id, CAST(rank AS INT) AS rank, vec_id, score FROM placed WHERE rank <= 20""")
def op6_topk(spark, folder) -> DataFrame:
    """The 20 best partners of every vector whose id is divisible by 20."""
    vectors = quantised(table(spark, folder, "embeddings"))
    return top_k(vectors.where("vec_id % 20 = 0"), vectors, 20)

"""Item and taker vectors: truncated SVD of the zero-filled response matrix.

X has takers as rows and items as columns; only right answers are non-zero.
Vectors are stored wide (one double column per dimension), so products and sums
over them stay in generated code.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from itemspark.functions.scalars import dot
from itemspark.operators import krylov
from itemspark.operators.moments import MAX_COLUMNS, collect_matrix, column_labels, gram, pack
from itemspark.session import above, cut_lineage


def dims(prefix: str, k: int) -> list[str]:
    return [f"{prefix}{i}" for i in range(1, k + 1)]


def right_cells(responses: DataFrame) -> DataFrame:
    return responses.filter("y = 1").select("taker", "item", "y")


def taker_gram(responses: DataFrame, takers: DataFrame) -> tuple[list, np.ndarray]:
    """X X' (takers by takers, integer counts) and the taker labels."""
    labels, _ = column_labels(takers, "taker")
    packed = pack(right_cells(responses), "item", "taker", "y", labels)
    return labels, collect_matrix(gram(packed, len(labels)), len(labels))


def joined_gram(right: DataFrame, takers: DataFrame) -> DataFrame:
    """The entries of X X' above 0 (t1, t2, together) for any number of takers: pairs of
    an item's right takers are added up map-side, each once, and mirrored afterwards."""
    own = cut_lineage(right.join(takers.select("taker"), "taker", "left_semi").select("taker", "item"), "right")
    pairs = (own.withColumnRenamed("taker", "t1").hint("merge").join(own.withColumnRenamed("taker", "t2"), "item")
             .where("t1 <= t2").groupBy("t1", "t2").agg(F.count(F.lit(1)).alias("together")))
    both = F.when(F.col("t1") == F.col("t2"), F.array(F.struct("t1", "t2"))).otherwise(
        F.array(F.struct("t1", "t2"), F.struct(F.col("t2").alias("t1"), F.col("t1").alias("t2"))))
    return pairs.select(F.explode(both).alias("_p"), "together").select("_p.*", "together")


def top_eigen(matrix: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    values, vectors = np.linalg.eigh(matrix)
    order = np.argsort(values)[::-1][:k]
    return np.maximum(values[order], 0.0), vectors[:, order]


def taker_table(like: DataFrame, labels: list, matrix: np.ndarray, prefix: str) -> DataFrame:
    """A matrix with one row per taker, as a table."""
    columns = ", ".join(f"{c} double" for c in dims(prefix, matrix.shape[1]))
    rows = [(label, *map(float, row)) for label, row in zip(labels, matrix)]
    return like.sparkSession.createDataFrame(rows, f"taker bigint, {columns}")


def project_items(responses: DataFrame, left: DataFrame, items: DataFrame, prefix: str,
                  k: int, out: str = "f") -> DataFrame:
    """Per item the sum of its right takers' vectors (X' left); 0 for no right answer."""
    sums = (right_cells(responses).join(left, "taker").groupBy("item")
            .agg(*[F.sum(a).alias(b) for a, b in zip(dims(prefix, k), dims(out, k))]))
    return items.select("item").join(sums, "item", "left").na.fill(0.0, dims(out, k))


def project_takers(responses: DataFrame, right: DataFrame, takers: DataFrame, prefix: str,
                   k: int, out: str = "u") -> DataFrame:
    """Per taker the sum of the vectors of the items answered right (X right)."""
    sums = (right_cells(responses).join(right, "item").groupBy("taker")
            .agg(*[F.sum(a).alias(b) for a, b in zip(dims(prefix, k), dims(out, k))]))
    return takers.select("taker").join(sums, "taker", "left").na.fill(0.0, dims(out, k))


def fix_signs(vectors: DataFrame, key: str, prefix: str, k: int) -> tuple[DataFrame, np.ndarray]:
    """Make the largest absolute entry of every dimension positive (the smallest key
    decides ties).  Returns the vectors and the applied signs."""
    best = [F.max_by(c, F.struct(F.round(F.abs(c), 9), -F.col(key))).alias(c)
            for c in dims(prefix, k)]
    lead = vectors.agg(*best).first()
    signs = np.array([-1.0 if (v or 0.0) < 0 else 1.0 for v in lead])
    turned = vectors.select(key, *[(F.col(c) * F.lit(float(s))).alias(c)
                                   for c, s in zip(dims(prefix, k), signs)])
    return turned, signs


def rotate(vectors: DataFrame, key: str, names: list[str], matrix: np.ndarray,
           prefix: str) -> DataFrame:
    """Multiply each row vector by a small matrix, written as plain expressions."""
    columns = [F.col(c) for c in names]
    return vectors.select(key, *[
        dot(columns, [F.lit(float(w)) for w in matrix[:, d]]).alias(f"{prefix}{d + 1}")
        for d in range(matrix.shape[1])])


def _scaled_down(taker_vectors: DataFrame, values: np.ndarray) -> DataFrame:
    """U / S as ``s1..sk``; 0 where a singular value is."""
    return taker_vectors.select("taker", *[
        (F.col(f"u{i + 1}") * F.lit(float(1 / s if s > 1e-9 else 0.0))).alias(f"s{i + 1}") for i, s in enumerate(values)])


def truncated_svd(responses: DataFrame, items: DataFrame, takers: DataFrame, k: int,
                  gram_limit: int = MAX_COLUMNS) -> tuple[np.ndarray, DataFrame, DataFrame]:
    """Singular values, item vectors ``f1..fk`` and taker vectors ``u1..uk``.

    Up to ``gram_limit`` takers the small side's Gram matrix is solved exactly;
    beyond that the same factors come from block Lanczos iteration (``krylov``).
    """
    if above(takers, gram_limit):
        squares, taker_vectors = krylov.leading(right_cells(responses).select("taker", "item"), takers, k)
        values = np.sqrt(squares)
        item_vectors = project_items(responses, _scaled_down(taker_vectors, values), items, "s", k)
    else:
        labels, g = taker_gram(responses, takers)
        squares, u = top_eigen(g, k)
        values = np.sqrt(squares)
        scale = np.where(values > 1e-9, 1.0 / np.maximum(values, 1e-9), 0.0)
        item_vectors = project_items(responses, taker_table(takers, labels, u * scale, "s"),
                                     items, "s", k)
        taker_vectors = taker_table(takers, labels, u, "u")
    item_vectors, signs = fix_signs(cut_lineage(item_vectors), "item", "f", k)
    taker_vectors = taker_vectors.select("taker", *[
        (F.col(c) * F.lit(float(s))).alias(c) for c, s in zip(dims("u", k), signs)])
    return values, item_vectors, taker_vectors


def abilities(responses: DataFrame, item_vectors: DataFrame, takers: DataFrame, k: int) -> DataFrame:
    """Transform a response matrix by fitted item vectors: ``t1..tk`` per taker."""
    return project_takers(responses, item_vectors, takers, "f", k, "t")


def scaled(taker_vectors: DataFrame, values: np.ndarray) -> DataFrame:
    """U S: the abilities of the fitted matrix itself, without another pass."""
    return taker_vectors.select("taker", *[
        (F.col(f"u{i + 1}") * F.lit(float(s))).alias(f"t{i + 1}") for i, s in enumerate(values)])


def cell_scores(cells: DataFrame, takers: DataFrame, items: DataFrame, k: int) -> DataFrame:
    """Low-rank prediction of the given cells only."""
    product = dot([F.col(c) for c in dims("t", k)], [F.col(c) for c in dims("f", k)])
    return (cells.join(items, "item").join(takers, "taker")
            .select(*cells.columns, product.alias("score")))


def rank_sweep_scores(cells: DataFrame, takers: DataFrame, items: DataFrame,
                      ranks: range) -> DataFrame:
    """Predictions of every rank from one decomposition: running sums over dimensions."""
    top = max(ranks)
    partial, steps = F.lit(0.0), []
    for i in range(1, top + 1):
        partial = partial + F.col(f"t{i}") * F.col(f"f{i}")
        if i in ranks:
            steps.append(F.struct(F.lit(i).alias("k"), partial.alias("score")))
    return (cells.join(items, "item").join(takers, "taker")
            .select("y", F.explode(F.array(*steps)).alias("s")).select("y", "s.*"))


def long_vectors(vectors: DataFrame, key: str, prefix: str, k: int, value: str) -> DataFrame:
    """Wide vectors as (key, factor, value) rows, factors counted from 0."""
    entries = F.array(*[F.col(c) for c in dims(prefix, k)])
    return vectors.select(key, F.posexplode(entries).alias("factor", value))


def item_components(responses: DataFrame, items: DataFrame, takers: DataFrame, k: int,
                    gram_limit: int = MAX_COLUMNS) -> tuple[DataFrame, np.ndarray]:
    """Principal components with items as variables: unscaled loadings ``f1..fk`` and
    explained-variance ratios.

    Centring the items equals centring the taker Gram matrix on both sides, and
    the centred vectors are orthogonal to the constant, so the dense centred
    matrix is never built.  More takers than ``gram_limit`` go through iteration.
    """
    if above(takers, gram_limit):
        squares, people = krylov.leading(right_cells(responses).select("taker", "item"), takers, k, centred=True)
        loadings = project_items(responses, _scaled_down(people, np.sqrt(squares)), items, "s", k)
        loadings, _ = fix_signs(cut_lineage(loadings), "item", "f", k)
        n = takers.agg(F.count(F.lit(1))).scalar()
        right = right_cells(responses).groupBy("item").agg(F.count(F.lit(1)).cast("double").alias("s"))
        total = right.agg(F.sum(F.col("s") - F.col("s") * F.col("s") / n)).first()[0]
        return loadings, squares / total
    labels, g = taker_gram(responses, takers)
    centre = np.eye(len(labels)) - 1.0 / len(labels)
    centred = centre @ g @ centre
    squares, u = top_eigen(centred, k)
    scale = np.where(squares > 1e-12, 1.0 / np.sqrt(np.maximum(squares, 1e-12)), 0.0)
    loadings = project_items(responses, taker_table(takers, labels, u * scale, "s"), items, "s", k)
    loadings, _ = fix_signs(cut_lineage(loadings), "item", "f", k)
    return loadings, squares / np.trace(centred)

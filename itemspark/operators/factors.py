"""Factor analysis of a small correlation matrix, and rotation of long loadings.

Spark builds the matrix (columns are scenarios or scenario-benchmark pairs, a
checked number); NumPy solves it.  Rotations of item-level loadings need only
the fourth-order sums of the rows, which Spark adds up in one pass.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from itemspark.operators.moments import collect_matrix, dense_gram, grouped_gram
from itemspark.operators.stats import correlations
from itemspark.operators.vectors import dims, rotate


def correlation_matrix(cells: DataFrame, row: str, column: str, value: str
                       ) -> tuple[list, np.ndarray, int]:
    """Labels, matrix (undefined correlations as 0, diagonal 1) and row count.  The
    column count was checked when the sums were built."""
    pairs = correlations(cells, row, column, value).collect()
    labels = sorted({p["v1"] for p in pairs})
    index = {x: i for i, x in enumerate(labels)}
    r = np.eye(len(labels))
    for p in pairs:
        if p["v1"] != p["v2"]:
            r[index[p["v1"]], index[p["v2"]]] = p["r"] or 0.0
    return labels, (r + r.T) / 2, max((p["n"] for p in pairs), default=0)


def eigenvalue_rows(spark: SparkSession, matrix: np.ndarray) -> DataFrame:
    values = np.sort(np.linalg.eigvalsh(matrix))[::-1]
    return spark.createDataFrame([(i, float(v)) for i, v in enumerate(values)], "i int, value double")


def kaiser_summary(eigenvalues: DataFrame, first: int = 10) -> DataFrame:
    v = F.col("value")
    return eigenvalues.agg(F.count_if(v > 1).alias("above_one"), F.count_if(v > 0).alias("positive"),
                           F.sum(F.when(F.col("i") < first, v)).alias("first_sum"))


def column_components(spark, labels, matrix: np.ndarray, k: int
                      ) -> tuple[DataFrame, np.ndarray]:
    """Principal components of standardised columns: (label, factor, loading) rows
    with unit-length components, and explained ratios."""
    values = np.sort(np.linalg.eigvalsh(matrix))[::-1]
    return loading_rows(spark, labels, _solve("principal", matrix, k)), values[:k] / values.sum()


def loading_rows(spark, labels, matrix: np.ndarray) -> DataFrame:
    rows = [(label, d, float(matrix[i, d])) for i, label in enumerate(labels)
            for d in range(matrix.shape[1])]
    return spark.createDataFrame(rows, "label string, factor int, loading double")


def component_scores(z: DataFrame, row: str, column: str, loadings: DataFrame) -> DataFrame:
    """Scores of standardised cells (column ``z``) on (label, factor, loading) rows."""
    return (z.join(loadings.withColumnRenamed("label", column), column)
            .groupBy(row, "factor").agg(F.sum(F.col("z") * F.col("loading")).alias("score")))


def squared_multiple(matrix: np.ndarray) -> np.ndarray:
    """Squared multiple correlation of each variable with the others."""
    inverse = np.linalg.pinv(matrix)
    return np.clip(1.0 - 1.0 / np.maximum(np.diag(inverse), 1e-12), 0.005, 0.995)


def minres(matrix: np.ndarray, k: int, rounds: int = 5000, tolerance: float = 1e-6) -> np.ndarray:
    """Least-squares factor loadings: unique variances that minimise the residuals, which
    then repeat the diagonal.  Raises if they aren't found within ``rounds``."""
    loadings, settled = settled_minres(matrix, k, rounds, tolerance)
    if not settled:
        raise ValueError(f"unique variances for {k} factors did not settle in {rounds} rounds")
    return loadings


def settled_minres(matrix: np.ndarray, k: int, rounds: int = 500, tolerance: float = 1e-6
                   ) -> tuple[np.ndarray, bool]:
    """``minres`` and whether no free unique variance has a gradient above ``tolerance``.

    Half the squared eigenvalues that the factors leave out, as a function of the unique
    variances (between 0.005 and 1), falls by damped Gauss-Newton steps in the free ones.
    """
    def parts(unique):
        values, vectors = np.linalg.eigh(matrix - np.diag(unique))
        left = np.ones(len(values), bool)
        left[-k:] = values[-k:] < 0
        return values, vectors, left, (values[left] ** 2).sum() / 2

    unique, damping, settled = 1.0 - squared_multiple(matrix), 1e-3, False
    now = parts(unique)
    for _ in range(rounds):
        values, vectors, left, loss = now
        rest = vectors[:, left]
        slope = -(rest ** 2) @ values[left]
        free = ~(((unique <= 0.005) & (slope > 0)) | ((unique >= 1.0) & (slope < 0)))
        settled = bool(np.abs(slope[free]).max(initial=0.0) < tolerance)
        if settled:
            break
        curve = ((rest @ rest.T) ** 2)[np.ix_(free, free)]
        tried = unique.copy()
        tried[free] = np.clip(unique[free] - np.linalg.solve(curve + damping * np.eye(len(curve)), slope[free]), 0.005, 1.0)
        there = parts(tried)
        if there[3] <= loss * (1 + 1e-14):
            unique, now, damping = tried, there, max(damping / 4, 1e-9)
        else:
            damping = min(damping * 8, 1e9)
    values, vectors = now[0][::-1][:k], now[1][:, ::-1][:, :k]
    loadings = vectors * np.sqrt(np.maximum(values, 0.0))
    lead = loadings[np.abs(loadings).argmax(0), range(loadings.shape[1])]
    return loadings * np.where(lead < 0, -1.0, 1.0), settled


def _varimax_rotation(fourth: np.ndarray, second: np.ndarray, n: int, rounds: int = 5000,
                      tolerance: float = 1e-8) -> np.ndarray:
    """Rotation from the moment sums of the (normalised) rows: ``fourth`` is the k^4
    tensor of sums of l_a l_b l_c l_d, ``second`` the k x k sums of l_a l_b.  Raises if
    it doesn't settle within ``rounds``."""
    k = second.shape[0]
    r, last = np.eye(k), 0.0
    for _ in range(rounds):
        cubes = np.einsum("jabc,ad,bd,cd->jd", fourth, r, r, r, optimize=True)
        squares = np.diag(r.T @ second @ r)
        u, s, v = np.linalg.svd(cubes - (second @ r) * squares / n)
        r = u @ v
        if s.sum() <= last * (1 + tolerance):
            return r
        last = s.sum()
    raise ValueError(f"the rotation of {k} factors did not settle in {rounds} rounds")


def varimax_matrix(loadings: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Varimax with row normalisation for a small loading matrix."""
    if loadings.shape[1] < 2:
        return loadings, np.eye(loadings.shape[1])
    size = np.sqrt((loadings ** 2).sum(1, keepdims=True))
    unit = loadings / np.where(size > 0, size, 1.0)
    fourth = np.einsum("ia,ib,ic,id->abcd", unit, unit, unit, unit, optimize=True)
    r = _varimax_rotation(fourth, unit.T @ unit, len(unit))
    return loadings @ r, r


def varimax(loadings: DataFrame, key: str, prefix: str, k: int) -> tuple[DataFrame, np.ndarray]:
    """Varimax with row normalisation for any number of rows."""
    if k < 2:
        return loadings, np.eye(k)
    r = varimax_turns(loadings.withColumn("_part", F.lit(k)), "_part", prefix, k)[k]
    return rotate(loadings, key, dims(prefix, k), r, prefix), r


def varimax_turns(loadings: DataFrame, part: str, prefix: str, k: int) -> dict[int, np.ndarray]:
    """Varimax rotation of every solution in one table: ``part`` is a solution's number
    of dimensions, its further columns are 0.

    One pass adds up the products of all pairs of dimensions (all fourth-order
    sums); the iterations run on those sums.
    """
    names = dims(prefix, k)
    pairs = [(a, b) for a in range(k) for b in range(a, k)]
    width = len(pairs) + 1
    size = sum((F.col(c) * F.col(c) for c in names), F.lit(0.0))
    weight = F.when(size > 0, 1.0 / size).otherwise(0.0)
    products = [F.col(names[a]) * F.col(names[b]) * weight for a, b in pairs]
    rows = loadings.select(F.col(part).alias("part"), F.array(*products, F.lit(1.0)).alias("v"))
    sums: dict[int, np.ndarray] = {}
    for p, i, g in grouped_gram(rows, width).select("part", "i", "g").collect():
        sums.setdefault(p, np.zeros((width, width)))[i] = g
    at = np.zeros((k, k), dtype=int)
    for p, (a, b) in enumerate(pairs):
        at[a, b] = at[b, a] = p
    turns = {}
    for d, g in sums.items():
        own = at[:d, :d].ravel()
        fourth = g[:-1, :-1][own][:, own].reshape(d, d, d, d)
        turns[d] = _varimax_rotation(fourth, g[:-1, -1][own].reshape(d, d), int(g[-1, -1]))
    return turns


def promax_matrix(loadings: np.ndarray, power: float = 4.0) -> tuple[np.ndarray, np.ndarray]:
    """Oblique rotation towards powered varimax loadings: loadings and factor correlations."""
    base, r = varimax_matrix(loadings)
    target = base * np.abs(base) ** (power - 1)
    turn = _promax_turn(base.T @ base, base.T @ target)
    full = r @ turn
    inverse = np.linalg.inv(turn)
    phi = inverse @ inverse.T
    return loadings @ full, phi


def _promax_turn(second: np.ndarray, cross: np.ndarray) -> np.ndarray:
    turn = np.linalg.solve(second, cross)
    return turn * np.sqrt(np.diag(np.linalg.inv(turn.T @ turn)))


def promax(loadings: DataFrame, key: str, prefix: str, k: int, power: float = 4.0
           ) -> tuple[DataFrame, np.ndarray]:
    """Promax for any number of rows: one more pass of k x 2k sums after varimax."""
    base, _ = varimax(loadings, key, prefix, k)
    names = dims(prefix, k)
    powered = [F.col(c) * F.pow(F.abs(c), power - 1) for c in names]
    rows = base.select(F.array(*[F.col(c) for c in names], *powered).alias("v"))
    g = collect_matrix(dense_gram(rows, 2 * k), 2 * k)
    turn = _promax_turn(g[:k, :k], g[:k, k:])
    inverse = np.linalg.inv(turn)
    return rotate(base, key, names, turn, prefix), inverse @ inverse.T


def factor_variance(loadings: DataFrame) -> DataFrame:
    """Per factor of (label/item, factor, loading) rows: sum of squares, proportion of
    the variables, running proportion."""
    from pyspark.sql import Window
    n = loadings.filter("factor = 0").agg(F.count(F.lit(1))).scalar()
    table = loadings.groupBy("factor").agg(
        F.sum(F.col("loading") * F.col("loading")).alias("ss_loading")).withColumn(
        "proportion", F.col("ss_loading") / n)
    w = Window.orderBy("factor").rowsBetween(Window.unboundedPreceding, 0)   # one row per factor
    return table.withColumn("cumulative", F.sum("proportion").over(w))


def kmo(matrix: np.ndarray) -> tuple[float | None, np.ndarray | None, str | None]:
    """Overall and per-variable sampling adequacy; a reason when the matrix is singular."""
    if np.linalg.cond(matrix) > 1e12:
        return None, None, "singular correlation matrix"
    inverse = np.linalg.inv(matrix)
    scale = np.sqrt(np.diag(inverse))
    partial = -inverse / np.outer(scale, scale)
    np.fill_diagonal(partial, 0.0)
    r2 = (matrix - np.diag(np.diag(matrix))) ** 2
    p2 = partial ** 2
    total = r2.sum() + p2.sum()
    if total == 0:
        return None, None, "no correlation"
    return r2.sum() / total, r2.sum(0) / (r2.sum(0) + p2.sum(0)), None


def chi_square_tail(x: float, df: float) -> float:
    """Upper tail of the chi-square distribution by the incomplete gamma function."""
    a, x = df / 2.0, x / 2.0
    if x <= 0:
        return 1.0
    front = math.exp(-x + a * math.log(x) - math.lgamma(a))
    if x < a + 1:                                   # power series of the lower part
        term = total = 1.0 / a
        n = a
        while abs(term) > abs(total) * 1e-16:
            n += 1
            term *= x / n
            total += term
        return max(0.0, 1.0 - total * front)
    b, c = x + 1 - a, 1e300                         # continued fraction of the upper part
    d = 1.0 / b
    h = d
    for i in range(1, 100000):
        an = -i * (i - a)
        b += 2
        d = 1.0 / (an * d + b or 1e-300)
        c = b + an / c or 1e-300
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return front * h


def bartlett(matrix: np.ndarray, n: int) -> tuple[float | None, float | None, str | None]:
    """Sphericity chi-square and p-value; a reason when the matrix is singular."""
    p = len(matrix)
    sign, logdet = np.linalg.slogdet(matrix)
    if sign <= 0 or not np.isfinite(logdet) or n <= p:
        return None, None, "singular correlation matrix"
    statistic = -logdet * (n - 1 - (2 * p + 5) / 6)
    return statistic, chi_square_tail(statistic, p * (p - 1) / 2), None


def compare_factor_counts(spark: SparkSession, matrix: np.ndarray, most: int = 50) -> DataFrame:
    """Explained variance for 1..``most`` factors, one Spark task per count; the matrix
    (checked size) is broadcast.  ``fit_possible`` is false, and the variance null, for a
    count whose fit fails or does not settle."""
    eigen = np.sort(np.linalg.eigvalsh(matrix))[::-1]
    shared = spark.sparkContext.broadcast(matrix)
    counts = spark.createDataFrame([(k,) for k in range(1, min(most, len(matrix)) + 1)],
                                   "n_factors int")

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        k, own = int(pdf["n_factors"].iloc[0]), shared.value
        try:
            loadings, settled = settled_minres(own, k)
        except np.linalg.LinAlgError:
            loadings, settled = None, False
        total = float((loadings ** 2).sum() / len(own)) if settled else None
        return pd.DataFrame({"n_factors": [k], "total_variance": pd.Series([total], dtype="float64"),
                             "eigenvalue_sum": [eigen[:k].sum()], "fit_possible": [settled]})
    return counts.repartition("n_factors").groupBy("n_factors").applyInPandas(
        solve, "n_factors int, total_variance double, eigenvalue_sum double, fit_possible boolean")


def interpretability(loadings: DataFrame, variance: DataFrame, groups: list[str],
                     threshold: float = 0.2) -> DataFrame:
    """0.4 * (mean count of strong loadings per factor / number of factors)
    + 0.3 * mean communality + 0.3 * explained variance, per solution.

    ``loadings``: the ``groups``, label, factor, loading.  ``variance``: the
    ``groups`` and the explained ``variance`` of each solution.
    """
    per_factor = loadings.groupBy(*groups, "factor").agg(
        F.count_if(F.abs("loading") > threshold).alias("strong"),
        F.sum(F.col("loading") * F.col("loading")).alias("ss"), F.count(F.lit(1)).alias("n"))
    table = per_factor.groupBy(*groups).agg(
        (F.avg("strong") / F.count(F.lit(1))).alias("simple_structure"),
        (F.sum("ss") / F.max("n")).alias("mean_communality"))
    table = (table.join(variance, groups) if groups
             else table.withColumn("variance", variance.select("variance").scalar()))
    return table.withColumn(
        "score", F.col("simple_structure") * 0.4 + F.col("mean_communality") * 0.3
        + F.col("variance") * 0.3)


def solution_grid(cells: DataFrame, row: str, column: str, value: str, counts: list[int],
                  methods: list[str], threshold: float = 0.2) -> DataFrame:
    """Interpretability of every (number of factors, method) pair, from one matrix."""
    spark = cells.sparkSession
    labels, matrix, _ = correlation_matrix(cells, row, column, value)
    rows, shares = [], []
    for k in counts:
        if k >= len(labels):
            continue
        for method in methods:
            found = _solve(method, matrix, k)
            share = (np.sort(np.linalg.eigvalsh(matrix))[::-1][:k].sum() if method == "principal"
                     else (found ** 2).sum()) / len(labels)
            shares.append((k, method, float(share)))
            rows += [(k, method, d, float(x)) for d in range(k) for x in found[:, d]]
    loadings = spark.createDataFrame(rows, "k int, method string, factor int, loading double")
    variance = spark.createDataFrame(shares, "k int, method string, variance double")
    return interpretability(loadings, variance, ["k", "method"], threshold)


def best_solution(grid: DataFrame) -> DataFrame:
    """Highest score; the first tested (fewest factors) on ties."""
    return grid.orderBy(F.col("score").desc(), "k", F.col("method").desc()).limit(1)


def _solve(method: str, matrix: np.ndarray, k: int) -> np.ndarray:
    if method == "principal":
        values, vectors = np.linalg.eigh(matrix)
        found = vectors[:, np.argsort(values)[::-1][:k]]
        return found * np.where(found[np.abs(found).argmax(0), range(k)] < 0, -1, 1)
    if method == "minres":
        return varimax_matrix(minres(matrix, k))[0]
    raise ValueError(f"unknown method: {method}")


def extract(method: str, cells: DataFrame, row: str, column: str, value: str, k: int) -> DataFrame:
    """Factor loadings by the named method: ``principal`` (unit-length components) or
    ``minres`` with varimax.  An unknown method is an error, never a fallback."""
    labels, matrix, _ = correlation_matrix(cells, row, column, value)
    return loading_rows(cells.sparkSession, labels, _solve(method, matrix, k))

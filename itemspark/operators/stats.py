"""Correlation, reliability, fit indices and ranking quality."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from itemspark.functions.scalars import log_likelihood
from itemspark.operators.moments import pair_table
from itemspark.operators.ranks import average_ranks
from itemspark.session import cut_lineage


def _safe_ratio(top, bottom):
    return F.when(bottom > 0, top / bottom)


def correlations(cells: DataFrame, row: str, column: str, value: str,
                 method: str = "pearson") -> DataFrame:
    """Correlation of every two columns over the rows that have both: v1, v2, n, r.

    ``spearman`` ranks each column over its own rows, ties sharing the mean rank.
    """
    cells = cells.select(row, column, value)
    if method == "spearman":
        cells = average_ranks(cells, value, [column], "_rank")
        value = "_rank"
    table = pair_table(cut_lineage(cells), row, column, value)
    n = F.col("n")
    cov = F.col("sxy") - F.col("sx") * F.col("sy") / n
    vx = F.col("sxx") - F.col("sx") * F.col("sx") / n
    vy = F.col("syy") - F.col("sy") * F.col("sy") / n
    # a constant column leaves only rounding noise in its sum of squares
    varies = (vx > F.lit(1e-12) * F.col("sxx")) & (vy > F.lit(1e-12) * F.col("syy"))
    r = F.when((n >= 2) & varies, F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cov / F.sqrt(vx * vy))))
    return table.select("v1", "v2", n.cast("bigint").alias("n"), r.alias("r"))


def covariances(cells: DataFrame, row: str, column: str, value: str) -> DataFrame:
    table = pair_table(cut_lineage(cells.select(row, column, value)), row, column, value)
    n = F.col("n")
    return table.select("v1", "v2", _safe_ratio(
        F.col("sxy") - F.col("sx") * F.col("sy") / n, n - 1).alias("cov"))


def identity_distance(covariance: DataFrame) -> DataFrame:
    """Squared Frobenius distance of a covariance matrix to the identity."""
    gap = F.col("cov") - F.when(F.col("v1") == F.col("v2"), 1.0).otherwise(0.0)
    return covariance.agg(F.sum(gap * gap).alias("distance"))


def correlation_of_correlations(pairs: DataFrame) -> DataFrame:
    return correlations(pairs.select("v1", "v2", "r"), "v1", "v2", "r")


def cross_correlations(left: DataFrame, right: DataFrame, row: str, left_key: str, left_value: str,
                       right_key: str, right_value: str, method: str = "pearson") -> DataFrame:
    """Correlation of each left column with each right column over common rows.
    ``spearman`` ranks within the common rows of each column pair."""
    keys = [left_key, right_key]
    both = (left.select(row, left_key, F.col(left_value).alias("_x"))
            .join(right.select(row, right_key, F.col(right_value).alias("_y")), row)
            .filter(F.col("_x").isNotNull() & F.col("_y").isNotNull()))
    if method == "spearman":
        both = average_ranks(average_ranks(both, "_x", keys, "_rx"), "_y", keys, "_ry")
        both = both.select(row, *keys, F.col("_rx").alias("_x"), F.col("_ry").alias("_y"))
    flat = (F.min("_x") == F.max("_x")) | (F.min("_y") == F.max("_y"))
    return both.groupBy(*keys).agg(F.when(~flat, F.corr("_x", "_y")).alias("r"))


def correlation_summary(pairs: DataFrame) -> DataFrame:
    """Counts of absolute correlations over 0.3 and 0.7 and the mean of the column
    means, without the diagonal."""
    off = pairs.filter("v1 <> v2").withColumn("size", F.abs("r"))
    means = off.groupBy("v2").agg(F.avg("size").alias("m"))
    counts = off.agg(F.count_if(F.col("size") > 0.3).alias("above_3"),
                     F.count_if(F.col("size") > 0.7).alias("above_7"))
    return counts.withColumn("mean_abs", means.agg(F.avg("m")).scalar())


def upper_triangle(pairs: DataFrame) -> DataFrame:
    return pairs.filter("v1 < v2").agg(F.avg("r").alias("mean_r"), F.max("r").alias("max_r"),
                                       F.min("r").alias("min_r"))


def standardise(cells: DataFrame, column: str, value: str) -> DataFrame:
    """Zero mean and unit population deviation per column; constant columns give 0."""
    centre = cells.groupBy(column).agg(F.avg(value).alias("_m"), F.stddev_pop(value).alias("_s"))
    scale = F.when(F.col("_s") > 0, F.col("_s")).otherwise(1.0)
    return (cells.join(centre, column).withColumn("z", (F.col(value) - F.col("_m")) / scale)
            .drop("_m", "_s"))


def cronbach_alpha(responses: DataFrame, selection: DataFrame, takers: DataFrame) -> DataFrame:
    """Reliability per component, missing answers as 0, from integer sums only."""
    n = takers.agg(F.count(F.lit(1))).scalar().cast("double")
    k = selection.groupBy("component").agg(F.count(F.lit(1)).alias("k"))
    uses = selection.groupBy("component", "item").agg(F.count(F.lit(1)).alias("uses"))
    right = responses.filter("y = 1").select("taker", "item")
    per_item = right.groupBy("item").agg(F.count(F.lit(1)).cast("double").alias("s"))
    items = (uses.join(per_item, "item").groupBy("component")
             .agg(F.sum(F.col("uses") * (F.col("s") - F.col("s") * F.col("s") / n)).alias("item_ss")))
    totals = right.join(uses, "item").groupBy("component", "taker").agg(
        F.sum("uses").cast("double").alias("t"))
    spread = totals.groupBy("component").agg(
        (F.sum(F.col("t") * F.col("t")) - F.sum("t") * F.sum("t") / n).alias("total_ss"))
    size = F.col("k")
    alpha = size / (size - 1) * (1 - F.coalesce("item_ss", F.lit(0.0)) / F.col("total_ss"))
    return (k.join(items, "component", "left").join(spread, "component", "left")
            .select("component", size.alias("n_items"),
                    F.when((size >= 2) & (n >= 2) & (F.col("total_ss") > 0), alpha).alias("alpha")))


def auc(cells: DataFrame, score: str = "score", label: str = "y",
        groups: list[str] | None = None) -> DataFrame:
    """Area under the ROC curve per group, tied scores counting one half.

    Equal scores are merged first; the distinct scores are range-partitioned, so
    a slice ranks its own scores and slices are joined by their totals.
    """
    groups = groups or []
    tied = cells.groupBy(*groups, score).agg(
        F.sum(label).cast("double").alias("pos"), F.sum(1 - F.col(label)).cast("double").alias("neg"))
    keys = [F.col(g) for g in groups] + [F.col(score)]
    sliced = tied.repartitionByRange(*keys).withColumn("_slice", F.spark_partition_id())
    below = (Window.partitionBy(*groups, "_slice").orderBy(score)
             .rowsBetween(Window.unboundedPreceding, -1))
    inside = sliced.withColumn("_below", F.coalesce(F.sum("neg").over(below), F.lit(0.0)))
    slices = inside.groupBy(*groups, "_slice").agg(
        F.sum("pos").alias("pos"), F.sum("neg").alias("neg"),
        F.sum(F.col("pos") * (F.col("_below") + F.col("neg") / 2)).alias("won"))
    earlier = (Window.partitionBy(*groups).orderBy("_slice")
               .rowsBetween(Window.unboundedPreceding, -1))
    offset = F.coalesce(F.sum("neg").over(earlier), F.lit(0.0))
    return (slices.withColumn("won", F.col("won") + F.col("pos") * offset).groupBy(*groups)
            .agg(F.sum("won").alias("won"), F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
            .select(*groups, F.when((F.col("pos") > 0) & (F.col("neg") > 0),
                                    F.col("won") / (F.col("pos") * F.col("neg"))).alias("auc")))


def ctt_correlation(cells: DataFrame, groups: list[str], score: str = "score") -> DataFrame:
    """Correlation over takers of mean score and mean answer, per group (split)."""
    means = cells.groupBy(*groups, "taker").agg(F.avg(score).alias("p"), F.avg("y").alias("m"))
    flat = (F.min("p") == F.max("p")) | (F.min("m") == F.max("m"))
    return means.groupBy(*groups).agg(F.when(~flat, F.corr("p", "m")).alias("cttcorr"))


def fit_indices(cells: DataFrame, n_items, n_takers, n_dimensions, groups: list[str] | None = None,
                score: str = "score") -> DataFrame:
    """Log-likelihood, parameter count, AIC and BIC over the given (train) cells."""
    sums = cells.groupBy(*(groups or [])).agg(
        F.sum(log_likelihood(F.col("y"), F.col(score))).alias("log_likelihood"),
        F.count(F.lit(1)).alias("n"))
    d = n_dimensions if not isinstance(n_dimensions, int) else F.lit(n_dimensions)
    k = (n_items * (d + 1) + n_takers * d).cast("double")
    ll = F.col("log_likelihood")
    return (sums.withColumn("k", k).withColumn("AIC", 2 * F.col("k") - 2 * ll)
            .withColumn("BIC", F.col("k") * F.log("n") - 2 * ll))

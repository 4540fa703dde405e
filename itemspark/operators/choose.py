"""Item selection: best items per group under quotas, thresholds and fallbacks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from itemspark.operators.ranks import positions


def best_in_group(df: DataFrame, groups: list[str], order: list[Column], k: int) -> DataFrame:
    """The first ``k`` rows per group.  Spark drops rows beyond ``k`` before the
    shuffle (window group limit), so use it for a small constant ``k``."""
    rank = F.row_number().over(Window.partitionBy(*groups).orderBy(*order))
    return df.withColumn("_rank", rank).filter(F.col("_rank") <= k).drop("_rank")


def balanced_items(pool: DataFrame, blueprint: DataFrame, min_per_scenario: int) -> DataFrame:
    """Choose ``k`` items per part of a test, covering every scenario of the part.

    ``pool``: item, scenario, a, missing_count.  ``blueprint``: component, pole,
    scenario, k.  Per part (component and pole) the ``min_per_scenario`` best
    items of each scenario come first (fewest missing, then largest ``a``); the
    rest is filled with the best remaining items, or trimmed to ``k``.
    """
    part = ["component", "pole"]
    best = [F.col("missing_count"), F.col("a").desc(), F.col("item")]
    eligible = pool.join(blueprint, "scenario")
    sure = (best_in_group(eligible, part + ["scenario"], best, min_per_scenario)
            .select(*part, "item", F.lit(1).alias("sure")))
    ordered = positions(
        eligible.join(sure, part + ["item"], "left").na.fill(0, ["sure"]),
        [F.col("sure").desc()] + best, part)
    return (ordered.filter(F.col("position") <= F.col("k"))
            .select("item", "component", "pole", "scenario", "a", "missing_count", "sure"))


def balanced_by_factor(master: DataFrame, total: int) -> DataFrame:
    """Split ``total`` places evenly over primary factors (the first ones by name
    take the remainder); prefer items in many factors, with few missing answers
    and large loadings."""
    factors = master.select("primary_factor").distinct()
    # one row per factor name: a label table, not item data
    place = F.row_number().over(Window.orderBy("primary_factor")) - 1
    n = factors.agg(F.count(F.lit(1))).scalar()
    quotas = factors.select("primary_factor", (
        F.floor(F.lit(total) / n) + F.when(place < F.lit(total) % n, 1).otherwise(0)).alias("quota"))
    ordered = positions(master, [F.col("num_factors").desc(), F.col("missing_count"),
                                 F.col("max_loading").desc(), F.col("item")], ["primary_factor"])
    return (ordered.join(quotas, "primary_factor").filter(F.col("position") <= F.col("quota"))
            .withColumn("component", F.concat("primary_factor", F.lit("_Primary")))
            .drop("quota", "position"))


def adaptive_threshold(loadings: DataFrame, cap: float = 0.2) -> Column:
    """max(0.1, min(cap, half of the largest absolute loading)) as one value."""
    half = F.max(F.abs("loading")) * 0.5
    return loadings.agg(F.greatest(F.lit(0.1), F.least(F.lit(cap), half))).scalar()


def strong_or_best(loadings: DataFrame, threshold: Column, fallback: int) -> DataFrame:
    """Rows above the threshold per factor, or the ``fallback`` largest ones of a
    factor where none is."""
    sized = loadings.withColumn("size", F.abs("loading"))
    strong = sized.filter(F.col("size") > threshold)
    weak = sized.join(strong.select("factor").distinct(), "factor", "left_anti")
    top = best_in_group(weak, ["factor"], [F.col("size").desc(), F.col("item")], fallback)
    return strong.unionByName(top.select(*strong.columns))


def strongest_factor(candidates: DataFrame) -> DataFrame:
    """Per item the factor with the largest absolute loading; the earlier one on ties."""
    best = F.max(F.struct(F.abs("loading").alias("size"), (-F.col("factor")).alias("neg")))
    return (candidates.groupBy("item").agg(best.alias("_best"))
            .select("item", (-F.col("_best.neg")).alias("factor"),
                    F.col("_best.size").alias("max_loading")))


def first_per_key(df: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """One row per key: the first in ``order``, by a mergeable minimum."""
    lead = F.min_by(F.struct(*df.columns), F.struct(*order))
    return df.groupBy(key).agg(lead.alias("_row")).select("_row.*")


def scree_elbow(eigenvalues: DataFrame) -> DataFrame:
    """First index ``i`` (from 0, inner points only) where the drop after it is
    smaller than the drop before it; 0 when there is none."""
    w = Window.orderBy("i")     # eigenvalues of a checked small matrix
    steps = eigenvalues.select("i", (F.lag("value").over(w) - F.col("value")).alias("before"),
                               (F.col("value") - F.lead("value").over(w)).alias("after"))
    return steps.agg(F.coalesce(F.min(F.when(F.col("after") < F.col("before"), F.col("i"))),
                                F.lit(0)).alias("n_factors"))


def cumulative_share(eigenvalues: DataFrame) -> DataFrame:
    w = Window.orderBy("i")     # eigenvalues of a checked small matrix
    running = F.sum("value").over(w.rowsBetween(Window.unboundedPreceding, 0))
    total = eigenvalues.agg(F.sum("value")).scalar()
    return eigenvalues.withColumn("cumulative", running / total)

"""Scores, counts and profiles: aggregations over the response cells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from itemspark.operators.ranks import quantiles
from itemspark.session import above

#: Spark's broadcast limit is held against a file's compressed size, and attributes that
#: compress to 10 MB may take a hundred times that on the driver; more rows are merged.
BROADCAST_ROWS = 200_000


def with_items(responses: DataFrame, items: DataFrame, *columns: str) -> DataFrame:
    """Attach item attributes; ``items`` is never broadcast above BROADCAST_ROWS."""
    known = items.select("item", *columns)
    return responses.join(known.hint("merge") if above(known, BROADCAST_ROWS) else known, "item")


def level_grid(takers: DataFrame, items: DataFrame, level: str = "scenario") -> DataFrame:
    """Every taker with every label of ``level`` and the label's item count.

    The labels travel as one array value (a scalar subquery), so each taker row
    is expanded in place.
    """
    return _grid(takers, items.groupBy(level).agg(F.count(F.lit(1)).alias("n_items")))


def _grid(takers: DataFrame, sizes: DataFrame) -> DataFrame:
    """Every taker with every row of ``sizes``.  Spark takes it to be as small as the
    takers' file and would broadcast all of it, so joins with it are merged."""
    labels = sizes.agg(F.collect_list(F.struct(*sizes.columns)))
    return (takers.select("taker", F.explode(labels.scalar()).alias("_label"))
            .select("taker", "_label.*").hint("merge"))


def counts_per_taker(responses: DataFrame, takers: DataFrame) -> DataFrame:
    sums = responses.groupBy("taker").agg(F.sum("y").alias("correct"),
                                          F.sum(1 - F.col("y")).alias("incorrect"))
    return takers.select("taker").join(sums, "taker", "left").na.fill(0)


def scenario_scores(responses: DataFrame, items: DataFrame, takers: DataFrame,
                    level: str = "scenario") -> DataFrame:
    """Right answers over *all* items of the scenario: a missing cell counts as wrong."""
    right = (with_items(responses.filter("y = 1"), items, level)
             .groupBy("taker", level).agg(F.count(F.lit(1)).alias("correct")))
    return (level_grid(takers, items, level)
            .join(right, ["taker", level], "left")
            .select("taker", level,
                    (F.coalesce("correct", F.lit(0)) / F.col("n_items")).alias("p")))


def observed_means(responses: DataFrame, items: DataFrame, *levels: str) -> DataFrame:
    """Mean over the asked cells only."""
    return (with_items(responses, items, *levels)
            .groupBy("taker", *levels)
            .agg((F.sum("y") / F.count("y")).alias("p")))


def item_profile(responses: DataFrame, items: DataFrame, n_takers: Column) -> DataFrame:
    """Asked, right and missing counts and the response rate per item."""
    asked = responses.groupBy("item").agg(F.count("y").alias("asked"), F.sum("y").alias("correct"))
    return (items.join(asked, "item", "left").na.fill(0, ["asked", "correct"])
            .withColumn("missing_count", n_takers - F.col("asked"))
            .withColumn("response_rate", F.col("asked") / n_takers))


def taker_count(takers: DataFrame) -> Column:
    return takers.agg(F.count(F.lit(1))).scalar()


def membership_scores(responses: DataFrame, members: DataFrame, takers: DataFrame) -> DataFrame:
    """Score per factor where an item may belong to several; 0 for an empty factor.

    ``members`` holds one row per item and factor with a 0/1 ``member`` flag.
    """
    factors = members.groupBy("factor").agg(F.sum("member").alias("n_items"))
    grid = _grid(takers, factors)
    right = (responses.filter("y = 1").select("taker", "item")
             .join(members.filter("member = 1").select("item", "factor"), "item")
             .groupBy("taker", "factor").agg(F.count(F.lit(1)).alias("correct")))
    return (grid.join(right, ["taker", "factor"], "left")
            .select("taker", "factor",
                    F.when(F.col("n_items") == 0, 0.0)
                     .otherwise(F.coalesce("correct", F.lit(0)) / F.col("n_items")).alias("p")))


def value_counts(df: DataFrame, *columns: str) -> DataFrame:
    return df.groupBy(*columns).agg(F.count(F.lit(1)).alias("n"))


def with_share(counts: DataFrame, n: str = "n", groups: list[str] | None = None) -> DataFrame:
    """Add each count's percentage of the total, or of its group's total."""
    total = (F.sum(n).over(Window.partitionBy(*groups)) if groups
             else counts.agg(F.sum(n)).scalar())
    return counts.withColumn("percent", F.col(n) / total * 100)


def describe(df: DataFrame, value: str, group: str) -> DataFrame:
    """Count, mean, sample deviation, extremes and linear-interpolated quartiles."""
    x = F.col(value)
    moments = df.groupBy(group).agg(
        F.count(x).alias("n"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("std"),
        F.min(x).alias("min"), F.max(x).alias("max"))
    return moments.join(quantiles(df, value, [group], {"q25": .25, "q50": .5, "q75": .75}), group)


def subscores(responses: DataFrame, selection: DataFrame, takers: DataFrame) -> DataFrame:
    """Mean of the component's items per taker; an item may count more than once."""
    sizes = selection.groupBy("component").agg(F.count(F.lit(1)).alias("n_items"))
    grid = _grid(takers, sizes)
    uses = selection.groupBy("item", "component").agg(F.count(F.lit(1)).alias("uses"))
    right = (responses.filter("y = 1").select("taker", "item").join(uses, "item")
             .groupBy("taker", "component").agg(F.sum("uses").alias("correct")))
    return (grid.join(right, ["taker", "component"], "left")
            .select("taker", "component",
                    (F.coalesce("correct", F.lit(0)) / F.col("n_items")).alias("score")))


def coverage(cells: DataFrame, items: DataFrame, takers: DataFrame) -> DataFrame:
    """One row: smallest cell count over all takers and over all items."""
    def smallest(table, key):
        counted = cells.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
        return (table.select(key).join(counted, key, "left")
                .agg(F.min(F.coalesce("n", F.lit(0)))))
    return (smallest(takers, "taker").toDF("min_per_taker")
            .withColumn("min_per_item", smallest(items, "item").scalar())
            .withColumn("valid", (F.col("min_per_taker") > 0) & (F.col("min_per_item") > 0)))


def histogram(df: DataFrame, value: str, bins: int = 30) -> DataFrame:
    """Equal-width bins between the extremes; the last bin includes its upper edge."""
    low = df.agg(F.min(value)).scalar()
    high = df.agg(F.max(value)).scalar()
    width = (high - low) / bins
    place = F.when(width > 0, F.least(F.floor((F.col(value) - low) / width),
                                      F.lit(bins - 1))).otherwise(0)
    return df.filter(F.col(value).isNotNull()).groupBy(place.cast("int").alias("bin")).agg(
        F.count(F.lit(1)).alias("n"))


def difficulty_spread(responses: DataFrame, items: DataFrame, takers: DataFrame,
                      zero_filled: bool = True) -> DataFrame:
    """Mean and sample deviation of the item means per scenario."""
    profile = item_profile(responses, items, taker_count(takers))
    mean = (F.col("correct") / taker_count(takers) if zero_filled
            else F.col("correct") / F.nullif(F.col("asked"), F.lit(0)))
    return (profile.withColumn("item_mean", mean).groupBy("scenario")
            .agg(F.count(F.lit(1)).alias("n_items"),
                 F.avg("item_mean").alias("mean_performance"),
                 F.stddev_samp("item_mean").alias("difficulty_spread")))


def factor_profile(rows: DataFrame) -> DataFrame:
    """Scenario counts, mean size of loading and share per factor (``factor``,
    ``scenario``, ``loading`` rows)."""
    counted = rows.groupBy("factor", "scenario").agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.abs("loading")).alias("mean_loading"))
    return with_share(counted, "n", ["factor"])

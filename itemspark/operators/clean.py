"""Filters, missing-value handling and group-size rules."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from itemspark.functions.scalars import finite_or_null
from itemspark.operators.ranks import quantiles


def ingest(cells: DataFrame) -> DataFrame:
    """Raw float cells (0, 1, NaN, infinities) to the stored form: asked cells only."""
    return (cells.withColumn("y", finite_or_null(F.col("y")))
            .filter(F.col("y").isNotNull())
            .withColumn("y", F.col("y").cast("tinyint")))


def large_groups(items: DataFrame, min_items: int, level: str = "scenario") -> DataFrame:
    return (items.groupBy(level).agg(F.count(F.lit(1)).alias("n_items"))
            .filter(F.col("n_items") >= min_items))


def keep_large_groups(items: DataFrame, min_items: int, level: str = "scenario") -> DataFrame:
    return items.join(large_groups(items, min_items, level).select(level), level, "left_semi")


def drop_low_response(profile: DataFrame, min_rate: float = 0.1) -> DataFrame:
    return profile.filter(F.col("response_rate") >= min_rate)


def zero_filled_variance(profile: DataFrame, n_takers) -> DataFrame:
    """Sample variance per item with missing answers as 0, from integer sums:
    the squares of 0/1 answers add up to the count of right ones."""
    right, n = F.col("correct").cast("double"), n_takers.cast("double")
    return profile.withColumn("variance", (right - right * right / n) / (n - 1))


def drop_constant_items(profile: DataFrame, n_takers) -> DataFrame:
    return profile.filter((F.col("correct") > 0) & (F.col("correct") < n_takers))


def drop_constant_columns(cells: DataFrame, column: str, value: str) -> DataFrame:
    """Keep the columns of a long table whose values differ (sample variance > 0)."""
    varying = (cells.groupBy(column).agg(F.min(value).alias("lo"), F.max(value).alias("hi"))
               .filter(F.col("lo") < F.col("hi")).select(column))
    return cells.join(varying, column, "left_semi")


def column_missing(cells: DataFrame, column: str, value: str) -> DataFrame:
    """Per column: row count, null count, and whether everything is null."""
    return (cells.groupBy(column)
            .agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col(value).isNull()).alias("n_null"))
            .withColumn("all_null", F.col("n") == F.col("n_null")))


def drop_columns_with_null(cells: DataFrame, column: str, value: str) -> DataFrame:
    whole = column_missing(cells, column, value).filter("n_null = 0").select(column)
    return cells.join(whole, column, "left_semi")


def fill_missing(cells: DataFrame, column: str, value: str, strategy: str) -> DataFrame:
    """Fill the nulls of a long table column by column: ``mean``, ``median``,
    ``zero``, or ``drop`` for the columns that have any null.

    The fill value is an aggregate joined back by column name, so one very
    large column is not gathered in a single task.
    """
    if strategy == "zero":
        return cells.withColumn(value, F.coalesce(value, F.lit(0.0)))
    if strategy == "drop":
        return drop_columns_with_null(cells, column, value)
    if strategy not in ("mean", "median"):
        raise ValueError(f"unknown strategy: {strategy}")
    fills = (cells.groupBy(column).agg(F.avg(value).alias("_fill")) if strategy == "mean"
             else quantiles(cells, value, [column], {"_fill": 0.5}))
    return (cells.join(fills, column, "left")
            .withColumn(value, F.coalesce(value, "_fill")).drop("_fill")
            .select(*cells.columns))


def takers_with_answers(takers: DataFrame, responses: DataFrame) -> DataFrame:
    return takers.join(responses.select("taker").distinct(), "taker", "left_semi")


def takers_without_answers(takers: DataFrame, responses: DataFrame) -> DataFrame:
    return takers.join(responses.select("taker").distinct(), "taker", "left_anti")


def fill_correlations(pairs: DataFrame) -> DataFrame:
    """1 on the diagonal; 0 where a correlation is undefined."""
    return pairs.withColumn("r", F.when(F.col("v1") == F.col("v2"), 1.0)
                            .otherwise(F.coalesce(finite_or_null(F.col("r")), F.lit(0.0))))


def scorable_groups(cells: DataFrame, group: str, min_rows: int = 10) -> DataFrame:
    """Groups with enough rows and both outcomes."""
    return (cells.groupBy(group).agg(F.count(F.lit(1)).alias("n"), F.min("y").alias("lo"),
                                     F.max("y").alias("hi"))
            .filter((F.col("n") >= min_rows) & (F.col("lo") < F.col("hi")))
            .select(group, "n"))


def scorable_components(selection: DataFrame, n_takers) -> DataFrame:
    """Components with at least two items, in a study of at least two takers."""
    return (selection.groupBy("component").agg(F.count(F.lit(1)).alias("n_items"))
            .filter((F.col("n_items") >= 2) & (n_takers >= 2)))

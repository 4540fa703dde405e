"""Writers and the check of what was written."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def write_csv(df: DataFrame, path: str, header: bool = True) -> str:
    df.write.mode("overwrite").option("header", header).option("escape", '"').csv(path)
    return path


def write_cells(cells: DataFrame, path: str, by: str | None = "scenario") -> str:
    """Response cells as Parquet, one folder per label so that readers can prune.

    Rows are rebalanced by the label first: a label gets few files, and a very
    large label is split over several tasks.
    """
    if by is None:
        cells.write.mode("overwrite").parquet(path)
    else:
        cells.hint("rebalance", by).write.mode("overwrite").partitionBy(by).parquet(path)
    return path


def write_numbers(df: DataFrame, value: str, order: list[Column], path: str) -> str:
    """One number per line with six decimals, in ``order`` over all part files."""
    (df.orderBy(*order).select(F.format_string("%f", F.col(value)).alias("value"))
     .write.mode("overwrite").text(path))
    return path


def write_json(df: DataFrame, path: str) -> str:
    df.write.mode("overwrite").json(path)
    return path


def write_table(df: DataFrame, path: str) -> str:
    """Parameters, splits and other tables of a model, as Parquet."""
    df.write.mode("overwrite").parquet(path)
    return path


def verify(written: DataFrame, keys: list[str], total: str | None = None) -> DataFrame:
    """One row about a table read back: rows, distinct keys, nulls in keys, and a sum."""
    anything_null = F.lit(False)
    for k in keys:
        anything_null = anything_null | F.col(k).isNull()
    sums = [F.sum(total).alias("total")] if total else []
    return written.agg(F.count(F.lit(1)).alias("n_rows"),
                       *[F.countDistinct(k).alias(f"n_{k}") for k in keys],
                       F.count_if(anything_null).alias("n_null"), *sums)


def expect(written: DataFrame, original: DataFrame) -> None:
    """Raise unless the table read back has the columns and row count of the original."""
    if sorted(written.columns) != sorted(original.columns):
        raise ValueError(f"columns {written.columns} instead of {original.columns}")
    got, wanted = written.count(), original.count()
    if got != wanted:
        raise ValueError(f"{got} rows instead of {wanted}")


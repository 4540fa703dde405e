"""Readers.  Every schema is given, none is inferred."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from itemspark.schema import RESPONSES


def read_responses(spark: SparkSession, path: str) -> DataFrame:
    """Long response cells; a folder partitioned by scenario prunes by that column."""
    return spark.read.schema(RESPONSES).parquet(path)


def read_csv(spark: SparkSession, path: str, schema: StructType | str,
             multiline: bool = False) -> DataFrame:
    """CSV with a header line.  An index column is just the first field of the schema."""
    return (spark.read.option("header", True).option("escape", '"')
            .option("multiLine", multiline).schema(schema).csv(path))


def _by_number(path: Column) -> Column:
    """The path with every number filled up to 20 digits, so that part 100000 comes
    after part 99999."""
    wide = F.regexp_replace(path, "([0-9]+)", "0" * 20 + "$1")
    return F.regexp_replace(wide, "0*([0-9]{20})(?![0-9])", "$1")


def numbered_lines(lines: DataFrame) -> DataFrame:
    """Add ``position``: the 0-based line number over all files, in the order
    of their names with numbers taken as numbers.

    A file split is read in order by one task, so the row number inside a split is
    the difference of two increasing ids; splits are placed by their line counts.
    """
    tagged = lines.select("*", F.col("_metadata.file_path").alias("_file"),
                          F.col("_metadata.file_block_start").alias("_start"),
                          F.monotonically_increasing_id().alias("_id"))
    splits = tagged.groupBy("_file", "_start").agg(F.count(F.lit(1)).alias("_lines"),
                                                   F.min("_id").alias("_first"))
    earlier = (Window.orderBy(_by_number(F.col("_file")), "_file", "_start")
               .rowsBetween(Window.unboundedPreceding, -1))
    placed = splits.select("_file", "_start", "_first",      # one row per file split
                           F.coalesce(F.sum("_lines").over(earlier), F.lit(0)).alias("_before"))
    return (tagged.join(placed, ["_file", "_start"])
            .withColumn("position", F.col("_id") - F.col("_first") + F.col("_before"))
            .select(*lines.columns, "position"))


def read_value_column(spark: SparkSession, path: str, name: str = "value") -> DataFrame:
    """Headerless one-column CSV of numbers: item position and value."""
    lines = spark.read.schema(f"{name} double").csv(path)
    return numbered_lines(lines).select(F.col("position").alias("item"), name)


def read_number_matrix(spark: SparkSession, path: str, width: int) -> DataFrame:
    """One number per line, row by row: taker, dim, value."""
    lines = numbered_lines(spark.read.text(path))
    return lines.select(F.expr(f"position div {width}").alias("taker"),
                        (F.col("position") % width).cast("int").alias("dim"),
                        F.col("value").cast("double").alias("value"))


def read_array_table(spark: SparkSession, path: str) -> DataFrame:
    """A dense array kept as (row, col, value) rows."""
    return spark.read.schema("row bigint, col int, value double").parquet(path)


def read_embeddings(spark: SparkSession, path: str, key: str, vector: str = "embedding") -> DataFrame:
    table = spark.read.parquet(path)
    return table.select(key, F.col(vector).cast("array<double>").alias("embedding"))

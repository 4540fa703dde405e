"""The three base tables of a study, read from Parquet."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Study:
    responses: DataFrame   # taker, item, y
    items: DataFrame       # item, input_text, scenario, benchmark
    takers: DataFrame      # taker, name


def order_line_study(spark: SparkSession, folder: str) -> Study:
    """Order lines read as answers: a supplier 'takes' a part and is right when
    the part came back at least once."""
    lines = spark.read.parquet(f"{folder}/lineitem.parquet")
    parts = spark.read.parquet(f"{folder}/part.parquet")
    suppliers = spark.read.parquet(f"{folder}/supplier.parquet")
    responses = (lines
                 .select(F.col("l_suppkey").alias("taker"), F.col("l_partkey").alias("item"),
                         F.when(F.col("l_returnflag") == "R", 1).otherwise(0).alias("right"))
                 .groupBy("taker", "item")
                 .agg(F.max("right").cast("tinyint").alias("y")))
    items = parts.select(F.col("p_partkey").alias("item"), F.col("p_name").alias("input_text"),
                         F.col("p_type").alias("scenario"), F.col("p_brand").alias("benchmark"))
    takers = suppliers.select(F.col("s_suppkey").alias("taker"), F.col("s_name").alias("name"))
    return Study(responses, items, takers)


def part_parameters(spark: SparkSession, folder: str) -> DataFrame:
    """Discrimination ``a`` and difficulty ``d`` per item, from part attributes."""
    parts = spark.read.parquet(f"{folder}/part.parquet")
    return parts.select(F.col("p_partkey").alias("item"),
                        (F.col("p_retailprice") / 1000).alias("a"),
                        (F.col("p_size") / 25.0).alias("d"))


def embedding_loadings(spark: SparkSession, folder: str) -> DataFrame:
    """Vectors read as loadings: one row per item and vector position."""
    vectors = spark.read.parquet(f"{folder}/embeddings.parquet")
    return (vectors
            .select(F.col("vec_id").alias("item"), F.posexplode("embedding"))
            .select("item", F.col("pos").alias("factor"),
                    F.col("col").cast("double").alias("loading")))

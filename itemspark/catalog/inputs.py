"""Inputs shared by the registered queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from itemspark.operators import qmatrix, score
from itemspark.sources.views import embedding_loadings, order_line_study, part_parameters

# Part types shown under scenario names that the skill and tag rules know.
SCENARIO_NAMES = {"ECONOMY": "mmlu", "SMALL": "legalbench", "LARGE": "air_bench_2024",
                  "MEDIUM": "med_qa", "PROMO": "thai_exam"}

study = order_line_study
parameters = part_parameters
loadings = embedding_loadings


def named(items: DataFrame) -> DataFrame:
    label = F.lit("not_listed")
    for part_type, name in SCENARIO_NAMES.items():
        label = F.when(F.col("scenario") == part_type, name).otherwise(label)
    return items.withColumn("scenario", label)


def named_items(spark, folder) -> DataFrame:
    return named(study(spark, folder).items)


def profile(spark, folder) -> DataFrame:
    s = study(spark, folder)
    return score.item_profile(s.responses, s.items, score.taker_count(s.takers))


def scores(spark, folder) -> DataFrame:
    s = study(spark, folder)
    return score.scenario_scores(s.responses, s.items, s.takers)


def members(spark, folder) -> DataFrame:
    return qmatrix.membership(loadings(spark, folder))

"""What a factor measures: scenario profiles and skill names."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from itemspark.functions.scalars import shorten, title_words
from itemspark.operators.choose import (adaptive_threshold, best_in_group, strong_or_best,
                                        strongest_factor)
from itemspark.operators.qmatrix import factor_name
from itemspark.operators.score import difficulty_spread, factor_profile, value_counts, with_share

# Keyword -> skill, the first keyword found in the scenario wins.
SKILL_KEYWORDS = {
    "math": "Mathematical Reasoning", "reasoning": "Logical Reasoning",
    "language": "Language Understanding", "knowledge": "Factual Knowledge",
    "gsm": "Mathematical Problem Solving", "mmlu": "General Knowledge",
    "boolq": "Reading Comprehension", "truthful_qa": "Truthfulness Assessment",
    "legal": "Legal Reasoning", "med": "Medical Knowledge",
    "civil_comments": "Social Understanding", "commonsense": "Common Sense Reasoning",
    "synthetic_reasoning": "Abstract Reasoning", "lsat": "Analytical Reasoning",
    "bbq": "Bias Assessment", "imdb": "Sentiment Analysis",
}


def keyword_skill(scenario) -> F.Column:
    lower = F.lower(scenario)
    matches = [F.when(lower.contains(word), F.lit(skill)) for word, skill in SKILL_KEYWORDS.items()]
    return F.coalesce(*matches)


def interpretation_rows(loadings: DataFrame, items: DataFrame, cap: float = 0.2) -> DataFrame:
    """The loadings that describe each factor: those above the adaptive threshold,
    or the three largest."""
    rows = strong_or_best(loadings, adaptive_threshold(loadings, cap), 3)
    return rows.join(items.select("item", "scenario"), "item")


def ranked_scenarios(profile: DataFrame) -> DataFrame:
    """Scenarios of a factor by count, then mean loading (then name)."""
    order = [F.col("n").desc(), F.col("mean_loading").desc(), F.col("scenario")]
    return profile.withColumn("place", F.row_number().over(
        Window.partitionBy("factor").orderBy(*order)))


def skill_names(ranked: DataFrame) -> DataFrame:
    """Skill per factor: by keyword of its first scenario, else from its two first."""
    first = F.max(F.when(F.col("place") == 1, F.col("scenario")))
    second = F.max(F.when(F.col("place") == 2, F.col("scenario")))
    named = ranked.groupBy("factor").agg(first.alias("top_scenario"), second.alias("second"))
    pair = F.concat(title_words(F.col("top_scenario")), F.lit("-"),
                    title_words(F.col("second")), F.lit(" Skills"))
    return named.select("factor", "top_scenario",
                        F.coalesce(keyword_skill(F.col("top_scenario")), pair,
                                   F.lit("Mixed Skills")).alias("skill"))


def factor_summary(loadings: DataFrame, items: DataFrame, cap: float = 0.2) -> DataFrame:
    rows = interpretation_rows(loadings, items, cap)
    totals = rows.groupBy("factor").agg(
        F.count(F.lit(1)).alias("n_items"), F.avg(F.abs("loading")).alias("mean_loading"),
        F.countDistinct("scenario").alias("scenario_diversity"))
    return totals.join(skill_names(ranked_scenarios(factor_profile(rows))), "factor")


def primary_assignments(loadings: DataFrame, cap: float = 0.2) -> DataFrame:
    """Primary factor among the qualifying rows of each factor (ten if none qualifies)."""
    return strongest_factor(strong_or_best(loadings, adaptive_threshold(loadings, cap), 10))


def item_skills(loadings: DataFrame, items: DataFrame, cap: float = 0.2,
                width: int = 50, mark: str = "...") -> DataFrame:
    """Items with their primary factor, skill, loading and communality."""
    communality = loadings.groupBy("item").agg(
        F.sum(F.col("loading") * F.col("loading")).alias("communality"))
    skills = factor_summary(loadings, items, cap).select("factor", "skill")
    return (primary_assignments(loadings, cap).join(skills, "factor")
            .join(items, "item").join(communality, "item")
            .select("item", shorten(F.col("input_text"), width, mark).alias("item_text"),
                    "scenario", "benchmark", factor_name(F.col("factor")).alias("primary_factor"),
                    "skill", F.col("max_loading").alias("loading_strength"), "communality"))


def skill_distribution(assigned: DataFrame) -> DataFrame:
    return with_share(value_counts(assigned, "skill"))


def result_table(loadings: DataFrame, items: DataFrame, factors: list[int],
                 cap: float = 0.2) -> DataFrame:
    """The assignment table with every loading of the item as its own column."""
    wide = loadings.groupBy("item").pivot("factor", factors).agg(F.first("loading"))
    wide = wide.toDF("item", *[f"Factor_{f}_loading" for f in factors])
    return item_skills(loadings, items, cap, 100, "").join(wide, "item")


def scenario_groups(loadings: DataFrame, responses: DataFrame, items: DataFrame,
                    takers: DataFrame, weak_below: float = 0.3) -> DataFrame:
    """Grouping by scenario, given only when the largest loading is weak."""
    largest = loadings.agg(F.max(F.abs("loading"))).scalar()
    return (difficulty_spread(responses, items, takers)
            .withColumn("suggested_skill", title_words(F.col("scenario")))
            .filter(largest < weak_below))


def strong_scenarios(loadings: DataFrame, label: str, threshold: float = 0.4) -> DataFrame:
    """Per factor the comma-joined labels with a loading of at least the threshold."""
    strong = loadings.filter(F.abs("loading") >= threshold)
    return strong.groupBy("factor").agg(
        F.array_join(F.array_sort(F.collect_set(label)), ",").alias("labels"))


def top_scenarios(loadings: DataFrame, items: DataFrame, threshold: float = 0.4,
                  k: int = 5) -> DataFrame:
    """Most frequent scenarios among the strong loaders of each factor."""
    strong = (loadings.filter(F.abs("loading") >= threshold)
              .join(items.select("item", "scenario"), "item"))
    return best_in_group(value_counts(strong, "factor", "scenario"), ["factor"],
                         [F.col("n").desc(), F.col("scenario")], k)

"""Q-matrices: which item needs which ability."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from itemspark.operators.choose import strongest_factor
from itemspark.operators.reshape import label_list

FOUNDATION, ANALYSIS, HIGHER = ("Foundational Knowledge", "Analytical Reasoning",
                                "Higher-Order Skills")
LINGUISTIC, SCIENTIFIC = ("Linguistic & Logical Reasoning", "Scientific & Quantitative Reasoning")

# Ability levels of each scenario.
LEVEL_RULES = {
    "truthful_qa": [FOUNDATION], "wikifact": [FOUNDATION],
    "lsat_qa": [ANALYSIS], "synthetic_reasoning": [ANALYSIS], "babi_qa": [ANALYSIS],
    "bbq": [ANALYSIS], "dyck_language_np=3": [ANALYSIS], "civil_comments": [ANALYSIS],
    "raft": [ANALYSIS], "math": [ANALYSIS], "gsm": [ANALYSIS], "entity_matching": [ANALYSIS],
    "entity_data_imputation": [ANALYSIS], "commonsense": [ANALYSIS], "imdb": [ANALYSIS],
    "legal_support": [HIGHER, ANALYSIS], "legalbench": [HIGHER, ANALYSIS],
    "air_bench_2024": [HIGHER], "med_qa": [FOUNDATION, HIGHER],
    "boolq": [FOUNDATION, ANALYSIS], "mmlu": [FOUNDATION, ANALYSIS, HIGHER],
    "thai_exam": [FOUNDATION, ANALYSIS],
}

# Domains of the scenarios that are not purely linguistic.
DOMAIN_RULES = {name: [LINGUISTIC] for name in LEVEL_RULES} | {
    "math": [SCIENTIFIC], "gsm": [SCIENTIFIC], "med_qa": [SCIENTIFIC],
    "air_bench_2024": [LINGUISTIC, SCIENTIFIC], "mmlu": [LINGUISTIC, SCIENTIFIC],
    "thai_exam": [LINGUISTIC, SCIENTIFIC],
}


def rule_table(spark: SparkSession, rules: dict[str, list[str]]) -> DataFrame:
    return spark.createDataFrame(list(rules.items()), "scenario string, tags array<string>")


def tag_scenarios(df: DataFrame, rules: dict[str, list[str]]) -> DataFrame:
    """Add ``tags``; a scenario without a rule is 'Unclassified'.  The rule table is
    a constant of a few rows, hence the broadcast."""
    table = F.broadcast(rule_table(df.sparkSession, rules))
    return (df.join(table, "scenario", "left")
            .withColumn("tags", F.coalesce("tags", F.array(F.lit("Unclassified")))))


def scenario_codes(df: DataFrame) -> DataFrame:
    """Number the (scenario, benchmark) pairs by first appearance (few rows)."""
    from itemspark.operators.ranks import positions
    pairs = df.groupBy("scenario", "benchmark").agg(F.min("item").alias("first_item"))
    return (positions(pairs, [F.col("first_item")], name="_p")
            .select("scenario", "benchmark", (F.col("_p") - 1).alias("code")))


def coded(items: DataFrame, codes: DataFrame) -> DataFrame:
    """Add the ``code`` of each item's scenario and benchmark; an item whose pair has
    no code, or several, is an error.  A null name equals itself."""
    keys = ["scenario", "benchmark"]
    found = codes.groupBy(*keys).agg(F.min("code").alias("code"), F.count("code").alias("_codes"))
    found = found.select("code", "_codes", *[F.col(c).alias(f"_{c}") for c in keys])
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in keys]
    message = F.concat(F.coalesce("_codes", F.lit(0)).cast("string"), F.lit(" codes for "),
                       F.concat_ws(" / ", F.coalesce("scenario", F.lit("null")), F.coalesce("benchmark", F.lit("null"))))
    code = F.when(F.col("_codes") == 1, F.col("code")).otherwise(F.raise_error(message).cast("long"))
    return items.drop("code").join(found, same, "left").select(*items.drop("code").columns, code.cast("long").alias("code"))


def scenario_map(items: DataFrame) -> DataFrame:
    """Code of each item's scenario: the first pair of that scenario."""
    first = scenario_codes(items).groupBy("scenario").agg(F.min("code").alias("code"))
    return items.select("item", "scenario").join(first, "scenario")


def item_qmatrix(items: DataFrame, rules: dict[str, list[str]]) -> DataFrame:
    """Scenario rules expanded to items: one row per item and ability."""
    tagged = tag_scenarios(items.select("scenario").distinct(), rules)
    return items.select("item", "scenario").join(tagged, "scenario").select(
        "item", F.explode("tags").alias("factor"))


def bifactor(qmatrix: DataFrame) -> DataFrame:
    """Add the general factor that every item loads on."""
    general = qmatrix.select("item").distinct().withColumn("factor", F.lit("g_factor"))
    return general.unionByName(qmatrix.select("item", "factor"))


def membership(loadings: DataFrame, threshold: float = 0.01) -> DataFrame:
    return loadings.withColumn("member", (F.abs("loading") >= threshold).cast("int"))


def factor_name(factor) -> F.Column:
    return F.concat(F.lit("Factor_"), factor.cast("string"))


def assigned_factors(members: DataFrame) -> DataFrame:
    """Per item: comma-joined member factors in factor order, their number, and
    the largest absolute loading.  An item has one row per factor, so the
    collected list is as short as the factor list."""
    listed = F.array_sort(F.collect_list(F.when(F.col("member") == 1, F.col("factor"))))
    return members.groupBy("item").agg(
        F.array_join(F.transform(listed, factor_name), ",").alias("assigned_factors"),
        F.sum("member").alias("num_factors"), F.max(F.abs("loading")).alias("max_loading"))


def metadata(loadings: DataFrame, threshold: float = 0.01) -> DataFrame:
    """Assigned factors, their number, the largest loading and the primary factor
    (first index on ties)."""
    primary = strongest_factor(loadings).select(
        "item", factor_name(F.col("factor")).alias("primary_factor"))
    return assigned_factors(membership(loadings, threshold)).join(primary, "item")


def item_master(loadings: DataFrame, profile: DataFrame, threshold: float = 0.01) -> DataFrame:
    """Metadata, missing counts, zero item parameters and one 0/1 column per factor."""
    members = membership(loadings, threshold)
    flags = members.groupBy("item").pivot("factor", label_list(members, "factor")).agg(
        F.max("member"))
    flags = flags.toDF("item", *[f"Factor_{c}_member" for c in flags.columns[1:]])
    return (metadata(loadings, threshold).join(profile.select("item", "missing_count"), "item")
            .withColumn("a_params", F.lit(0.0)).withColumn("d_params", F.lit(0.0))
            .join(flags, "item"))

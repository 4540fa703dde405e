import pandas as pd
import pytest
from pyspark.sql import functions as F

from itemspark.operators import choose, qmatrix, skills

PLAN = "component string, pole string, scenario string, k int"


def reference_selection(pool, scenarios, k, least):
    order = dict(by=["missing_count", "a", "item"], ascending=[True, False, True])
    sure = pd.concat([pool[pool.scenario == s].sort_values(**order).head(least) for s in scenarios])
    rest = k - len(sure)
    if rest <= 0:
        return set(sure.sort_values(**order).head(k).item)
    left = pool[pool.scenario.isin(scenarios) & ~pool.item.isin(sure.item)].sort_values(**order)
    return set(sure.item) | set(left.head(rest).item)


@pytest.mark.parametrize("k,least", [(30, 4), (5, 4), (8, 4), (500, 2)])
def test_balanced_items(spark, k, least):
    pool = pd.DataFrame({"item": range(120), "scenario": ["big"] * 90 + ["mid"] * 20 + ["small"] * 10,
                         "a": [(i * 37 % 11) / 3 for i in range(120)],
                         "missing_count": [i * 13 % 5 for i in range(120)]})
    plan = spark.createDataFrame([("C", "", "big", k), ("C", "", "small", k)], PLAN)
    got = choose.balanced_items(spark.createDataFrame(pool), plan, least)
    assert {r.item for r in got.collect()} == reference_selection(pool, ["big", "small"], k, least)


def test_balanced_by_factor_quotas(spark):
    rows = [(i, f"Factor_{i % 3}", i % 4, i % 2, i / 50.0) for i in range(50)]
    master = spark.createDataFrame(rows, "item bigint, primary_factor string, num_factors bigint, "
                                         "missing_count bigint, max_loading double")
    got = choose.balanced_by_factor(master, 11).toPandas()
    assert got.groupby("primary_factor").size().to_dict() == {"Factor_0": 4, "Factor_1": 4, "Factor_2": 3}
    pool = master.toPandas().query("primary_factor == 'Factor_2'").sort_values(
        ["num_factors", "missing_count", "max_loading"], ascending=[False, True, False])
    assert set(got[got.primary_factor == "Factor_2"].item) == set(pool.item.head(3))


def loadings(spark):
    """Two factors above the threshold, one below it everywhere; ties included."""
    strong = [0.5, -0.5, 0.3, 0.05, 0.0, 0.21, 0.2, -0.45]
    other = [0.1, 0.5, -0.3, 0.26, 0.0, 0.02, 0.2, 0.4]
    weak = [0.09, -0.08, 0.09, 0.01, 0.02, 0.03, 0.04, 0.05]
    rows = [(i, f, float(v)) for f, vs in enumerate((strong, other, weak)) for i, v in enumerate(vs)]
    return spark.createDataFrame(rows, "item bigint, factor int, loading double")


def test_adaptive_threshold_bounds(spark):
    table = loadings(spark)
    def value(df):
        return df.limit(1).select(choose.adaptive_threshold(table if df is None else df).alias("t")).first().t
    assert value(table) == pytest.approx(0.2)
    assert value(table.withColumn("loading", F.col("loading") * 0.61)) == pytest.approx(0.1525)
    assert value(table.withColumn("loading", F.col("loading") * 0.1)) == pytest.approx(0.1)


def test_fallbacks_of_three_and_ten(spark):
    table = loadings(spark)
    bar = choose.adaptive_threshold(table)
    short = choose.strong_or_best(table, bar, 3).toPandas()
    assert short[short.factor == 2].item.tolist() == [0, 2, 1] or set(short[short.factor == 2].item) == {0, 1, 2}
    assert set(short[short.factor == 0].item) == {0, 1, 2, 5, 7}
    assert len(choose.strong_or_best(table, bar, 10).filter("factor = 2").collect()) == 8


def test_primary_factor_prefers_the_earlier_one_on_ties(spark):
    got = {r.item: r.factor for r in choose.strongest_factor(loadings(spark)).collect()}
    assert got[1] == 0 and got[2] == 0 and got[6] == 0 and got[4] == 2


def test_scree_elbow(spark):
    def elbow(values):
        table = spark.createDataFrame([(i, float(v)) for i, v in enumerate(values)], "i int, value double")
        return choose.scree_elbow(table).first().n_factors
    assert elbow([5, 4, 2, 1.5]) == 2
    assert elbow([4, 3, 1, -2]) == 0
    assert elbow([6, 3, 2, 1]) == 1


def test_tags_and_default(spark):
    table = spark.createDataFrame([("legalbench",), ("mmlu",), ("strange",)], "scenario string")
    got = {r.scenario: r.tags for r in qmatrix.tag_scenarios(table, qmatrix.LEVEL_RULES).collect()}
    assert got["legalbench"] == ["Higher-Order Skills", "Analytical Reasoning"]
    assert len(got["mmlu"]) == 3 and got["strange"] == ["Unclassified"]
    assert len(qmatrix.LEVEL_RULES) == len(qmatrix.DOMAIN_RULES) == 22


def test_skill_names(spark):
    rows = [(0, "synthetic_reasoning", 1), (1, "air_bench_2024", 1), (1, "thai_exam", 2),
            (2, "air_bench_2024", 1)]
    ranked = spark.createDataFrame(rows, "factor int, scenario string, place int")
    got = {r.factor: r.skill for r in skills.skill_names(ranked).collect()}
    assert got == {0: "Logical Reasoning", 1: "Air Bench 2024-Thai Exam Skills", 2: "Mixed Skills"}


def test_summary_of_weak_and_strong_factors(spark):
    items = spark.createDataFrame([(i, f"text {i}", "med_qa" if i < 3 else "air_bench_2024", "lite")
                                   for i in range(8)], "item bigint, input_text string, scenario string, benchmark string")
    got = {r.factor: r for r in skills.factor_summary(loadings(spark), items).collect()}
    assert got[2].n_items == 3 and got[2].skill == "Medical Knowledge" and got[2].scenario_diversity == 1
    assert got[0].mean_loading == pytest.approx((0.5 + 0.5 + 0.3 + 0.21 + 0.45) / 5)
    table = skills.item_skills(loadings(spark), items)
    one = table.filter("item = 1").first()
    assert one.primary_factor == "Factor_0" and one.communality == pytest.approx(0.25 + 0.25 + 0.0064)

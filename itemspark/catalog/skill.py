"""Skill interpretation (family L)."""

from pyspark.sql import functions as F

from itemspark.catalog import inputs
from itemspark.catalog.registry import query
from itemspark.functions.scalars import fixed
from itemspark.operators import choose, reshape, score, skills


def tables(spark, folder):
    return inputs.loadings(spark, folder), inputs.named_items(spark, folder)


@query("l1_skill_names", sql="SELECT factor, top_scenario, skill FROM skills")
def skill_names(spark, folder):
    loadings, items = tables(spark, folder)
    rows = skills.interpretation_rows(loadings, items)
    return skills.skill_names(skills.ranked_scenarios(score.factor_profile(rows)))


COMMON_SQL = """
    comm AS (SELECT item, SUM(loading * loading) AS h FROM loadings GROUP BY item),
    item_skills AS (SELECT a.item, i.input_text, i.scenario, i.benchmark,
            'Factor_' || a.factor AS primary_factor, s.skill, a.max_loading, c.h
        FROM assigned a JOIN skills s ON s.factor = a.factor JOIN named_items i ON i.item = a.item
        JOIN comm c ON c.item = a.item)"""


@query("l2_item_skills", extra=COMMON_SQL, sql="""
    SELECT item, CASE WHEN LENGTH(input_text) > 50 THEN CONCAT(SUBSTR(input_text, 1, 50), '...')
                      ELSE input_text END AS item_text, scenario, benchmark, primary_factor, skill,
           max_loading AS loading_strength, round(h, 6) + 0.0 AS communality FROM item_skills""")
def item_skills(spark, folder):
    return (skills.item_skills(*tables(spark, folder))
            .withColumn("communality", fixed(F.col("communality"))))


@query("l3_skill_distribution", extra=COMMON_SQL, sql="""
    SELECT skill, COUNT(*) AS n, round(COUNT(*) * 100.0 / SUM(COUNT(*)) OVER (), 6) + 0.0 AS percent
    FROM item_skills GROUP BY skill""")
def distribution(spark, folder):
    return (skills.skill_distribution(skills.item_skills(*tables(spark, folder)))
            .withColumn("percent", fixed(F.col("percent"))))


@query("l4_result_table", extra=COMMON_SQL, sql="""
    SELECT k.item, SUBSTR(input_text, 1, 100) AS item_text, scenario, benchmark, primary_factor, skill,
           max_loading AS loading_strength, round(h, 6) + 0.0 AS communality, """ + ", ".join(
        f"Factor_{j}_loading" for j in range(64)) + """
    FROM item_skills k JOIN (SELECT item, """ + ", ".join(
        f"MAX(CASE WHEN factor = {j} THEN loading END) AS Factor_{j}_loading" for j in range(64)) + """
        FROM loadings GROUP BY item) w ON w.item = k.item""")
def result_table(spark, folder):
    loadings, items = tables(spark, folder)
    factors = reshape.label_list(loadings, "factor")
    return (skills.result_table(loadings, items, factors)
            .withColumn("communality", fixed(F.col("communality"))))


@query("l5_scenario_groups", sql="""
    SELECT p.scenario, COUNT(*) AS n_items, round(AVG(correct / CAST(n_takers AS DOUBLE)), 6) + 0.0 AS mean_performance,
           round(STDDEV_SAMP(correct / CAST(n_takers AS DOUBLE)), 6) + 0.0 AS difficulty_spread,
           t.title AS suggested_skill
    FROM (SELECT p.* EXCLUDE (scenario), i.scenario FROM profile p JOIN named_items i ON i.item = p.item) p
    CROSS JOIN n JOIN titles t ON t.scenario = p.scenario
    WHERE (SELECT MAX(ABS(loading)) FROM loadings) < 0.6e0
    GROUP BY p.scenario, t.title""")
def scenario_groups(spark, folder):
    s = inputs.study(spark, folder)
    table = skills.scenario_groups(inputs.loadings(spark, folder), s.responses,
                                   inputs.named(s.items), s.takers, weak_below=0.6)
    return table.select("scenario", "n_items", "suggested_skill",
                        *[fixed(F.col(c)).alias(c) for c in ("mean_performance", "difficulty_spread")])


@query("l6_strong_labels", sql="""
    SELECT factor, STRING_AGG(DISTINCT scenario, ',' ORDER BY scenario) AS labels
    FROM loadings l JOIN named_items i ON i.item = l.item WHERE ABS(loading) >= 0.35e0 GROUP BY factor""")
def strong_labels(spark, folder):
    loadings, items = tables(spark, folder)
    labelled = loadings.join(items.select("item", "scenario"), "item")
    return skills.strong_scenarios(labelled, "scenario", 0.35)


@query("l7_top_scenarios", sql="""
    SELECT factor, scenario, n FROM (
        SELECT *, ROW_NUMBER() OVER (PARTITION BY factor ORDER BY n DESC, scenario) AS place
        FROM (SELECT factor, scenario, COUNT(*) AS n FROM loadings l JOIN named_items i ON i.item = l.item
              WHERE ABS(loading) >= 0.3e0 GROUP BY factor, scenario)) WHERE place <= 5""")
def top_scenarios(spark, folder):
    return skills.top_scenarios(*tables(spark, folder), 0.3)

"""Projection, reshaping and item metadata (family B)."""

from pyspark.sql import functions as F

from itemspark.catalog import inputs
from itemspark.catalog.registry import query
from itemspark.functions.scalars import fixed, shorten
from itemspark.operators import choose, qmatrix, reshape, score

COMPONENTS = ["air_bench_2024", "legalbench", "med_qa", "mmlu", "not_listed", "thai_exam"]


@query("b1_level_values", sql="""
    SELECT 'scenario' AS level, scenario AS value, MIN(item) AS first_item FROM items GROUP BY scenario
    UNION ALL
    SELECT 'benchmark', benchmark, MIN(item) FROM items GROUP BY benchmark""")
def level_values(spark, folder):
    items = inputs.study(spark, folder).items
    parts = [reshape.level_values(items, x).select(F.lit(x).alias("level"), F.col(x).alias("value"),
                                                   "first_item") for x in ("scenario", "benchmark")]
    return parts[0].unionByName(parts[1])


@query("b2_scenario_benchmark_pairs", sql="SELECT DISTINCT scenario, benchmark FROM items")
def pairs(spark, folder):
    return inputs.study(spark, folder).items.select("scenario", "benchmark").distinct()


@query("b3_attach_attributes", sql="""
    SELECT i.*, round(a, 6) + 0.0 AS a_params, round(d, 6) + 0.0 AS d_params
    FROM items i JOIN params q ON q.item = i.item""")
def attach(spark, folder):
    return (inputs.study(spark, folder).items.join(inputs.parameters(spark, folder), "item")
            .withColumn("a_params", fixed(F.col("a"))).withColumn("d_params", fixed(F.col("d")))
            .drop("a", "d"))


@query("b4_wide_to_long", sql="""
    SELECT taker, scenario, round(SUM(p * n) / SUM(n), 6) + 0.0 AS p
    FROM (SELECT r.taker, i.scenario, AVG(r.y) AS p, COUNT(*) AS n FROM responses r
          JOIN items i ON i.item = r.item GROUP BY r.taker, i.scenario)
    GROUP BY taker, scenario""")
def wide_to_long(spark, folder):
    s = inputs.study(spark, folder)
    wide = reshape.to_wide(score.observed_means(s.responses, s.items, "scenario"),
                           "taker", "scenario", "p")
    return reshape.to_long(wide, ["taker"], "scenario", "p").withColumn("p", fixed(F.col("p")))


@query("b5_long_to_wide", sql="""
    SELECT taker, """ + ", ".join(
        f"round(MAX(CASE WHEN scenario = '{s}' THEN p END), 6) + 0.0 AS \"{s}\""
        for s in ("ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD")) + """
    FROM scores GROUP BY taker""")
def long_to_wide(spark, folder):
    scores = inputs.scores(spark, folder).withColumn("p", fixed(F.col("p")))
    return reshape.to_wide(scores, "taker", "scenario", "p")


@query("b6_one_hot", sql="SELECT item, scenario, " + ", ".join(
    f"CAST(scenario = '{s}' AS INTEGER) AS {s}" for s in COMPONENTS) + " FROM named_items")
def one_hot(spark, folder):
    items = inputs.named_items(spark, folder).select("item", "scenario")
    return reshape.one_hot(items, "scenario", reshape.label_list(items, "scenario"))


@query("b7_multi_label_one_hot", sql="""
    SELECT scenario, CAST(scenario IN ('mmlu', 'air_bench_2024', 'thai_exam', 'legalbench')
                          AS INTEGER) AS "Linguistic & Logical Reasoning",
           CAST(scenario IN ('mmlu', 'air_bench_2024', 'thai_exam', 'med_qa')
                AS INTEGER) AS "Scientific & Quantitative Reasoning",
           CAST(scenario = 'not_listed' AS INTEGER) AS "Unclassified"
    FROM (SELECT DISTINCT scenario FROM named_items)""")
def multi_one_hot(spark, folder):
    scenarios = inputs.named_items(spark, folder).select("scenario").distinct()
    tagged = qmatrix.tag_scenarios(scenarios, qmatrix.DOMAIN_RULES)
    return reshape.multi_one_hot(tagged, "tags").drop("tags")


@query("b8_scenario_tags", sql="""
    SELECT s.scenario, rules, COALESCE(tags, 'Unclassified') AS tags
    FROM (SELECT DISTINCT scenario FROM named_items) s
    CROSS JOIN (VALUES ('levels'), ('domains')) k(rules)
    LEFT JOIN (VALUES
        ('levels', 'mmlu', 'Foundational Knowledge;Analytical Reasoning;Higher-Order Skills'),
        ('levels', 'legalbench', 'Higher-Order Skills;Analytical Reasoning'),
        ('levels', 'air_bench_2024', 'Higher-Order Skills'),
        ('levels', 'med_qa', 'Foundational Knowledge;Higher-Order Skills'),
        ('levels', 'thai_exam', 'Foundational Knowledge;Analytical Reasoning'),
        ('domains', 'mmlu', 'Linguistic & Logical Reasoning;Scientific & Quantitative Reasoning'),
        ('domains', 'legalbench', 'Linguistic & Logical Reasoning'),
        ('domains', 'air_bench_2024',
         'Linguistic & Logical Reasoning;Scientific & Quantitative Reasoning'),
        ('domains', 'med_qa', 'Scientific & Quantitative Reasoning'),
        ('domains', 'thai_exam', 'Linguistic & Logical Reasoning;Scientific & Quantitative Reasoning')
    ) t(kind, name, tags) ON t.kind = k.rules AND t.name = s.scenario""")
def scenario_tags(spark, folder):
    scenarios = inputs.named_items(spark, folder).select("scenario").distinct()
    parts = [qmatrix.tag_scenarios(scenarios, rules).select(
        "scenario", F.lit(kind).alias("rules"), F.array_join("tags", ";").alias("tags"))
        for kind, rules in (("levels", qmatrix.LEVEL_RULES), ("domains", qmatrix.DOMAIN_RULES))]
    return parts[0].unionByName(parts[1])


@query("b9_scenario_map", extra="""
    pairs AS (SELECT scenario, ROW_NUMBER() OVER (ORDER BY MIN(item)) - 1 AS code
              FROM items GROUP BY scenario, benchmark)""", sql="""
    SELECT i.item, i.scenario, c.code FROM items i
    JOIN (SELECT scenario, MIN(code) AS code FROM pairs GROUP BY scenario) c
      ON c.scenario = i.scenario""")
def scenario_map(spark, folder):
    return qmatrix.scenario_map(inputs.study(spark, folder).items)


QMATRIX_SQL = """
    qm AS (SELECT i.item, t.factor FROM named_items i JOIN (VALUES
        ('mmlu', 'Linguistic & Logical Reasoning'), ('mmlu', 'Scientific & Quantitative Reasoning'),
        ('legalbench', 'Linguistic & Logical Reasoning'),
        ('air_bench_2024', 'Linguistic & Logical Reasoning'),
        ('air_bench_2024', 'Scientific & Quantitative Reasoning'),
        ('med_qa', 'Scientific & Quantitative Reasoning'),
        ('thai_exam', 'Linguistic & Logical Reasoning'),
        ('thai_exam', 'Scientific & Quantitative Reasoning'),
        ('not_listed', 'Unclassified')) t(scenario, factor) ON t.scenario = i.scenario)"""


@query("b10_item_qmatrix", extra=QMATRIX_SQL, sql="SELECT item, factor FROM qm")
def item_qmatrix(spark, folder):
    return qmatrix.item_qmatrix(inputs.named_items(spark, folder), qmatrix.DOMAIN_RULES)


@query("b11_bifactor_qmatrix", extra=QMATRIX_SQL, sql="""
    SELECT item, factor FROM qm UNION ALL SELECT DISTINCT item, 'g_factor' FROM qm""")
def bifactor(spark, folder):
    return qmatrix.bifactor(item_qmatrix(spark, folder))


@query("b12_membership", sql="SELECT item, factor, loading, member FROM members")
def membership(spark, folder):
    return inputs.members(spark, folder)


@query("b13_primary_factor", sql="""
    SELECT item, ARG_MAX(factor, (ABS(loading), -factor)) AS factor,
           MAX(ABS(loading)) AS max_loading
    FROM loadings GROUP BY item""")
def primary_factor(spark, folder):
    return choose.strongest_factor(inputs.loadings(spark, folder))


@query("b14_assigned_factors", sql="SELECT item, assigned_factors FROM meta")
def assigned_factors(spark, folder):
    return qmatrix.assigned_factors(inputs.members(spark, folder)).select("item", "assigned_factors")


@query("b15_qmatrix_metadata", sql="""
    SELECT item, primary_factor, num_factors, max_loading FROM meta""")
def metadata(spark, folder):
    return (qmatrix.metadata(inputs.loadings(spark, folder))
            .select("item", "primary_factor", "num_factors", "max_loading"))


@query("b16_item_master", sql="""
    SELECT m.*, p.missing_count, 0.0 AS a_params, 0.0 AS d_params, """ + ", ".join(
        f"f.Factor_{j}_member" for j in range(64)) + """
    FROM meta m JOIN profile p ON p.item = m.item
    JOIN (SELECT item, """ + ", ".join(
        f"MAX(CASE WHEN factor = {j} THEN member END) AS Factor_{j}_member" for j in range(64)) + """
          FROM members GROUP BY item) f ON f.item = m.item""")
def item_master(spark, folder):
    return qmatrix.item_master(inputs.loadings(spark, folder), inputs.profile(spark, folder))


@query("b17_component_tag", sql="""
    SELECT item, CONCAT('PC_', scenario) AS component FROM named_items""")
def component_tag(spark, folder):
    return inputs.named_items(spark, folder).select(
        "item", F.concat(F.lit("PC_"), "scenario").alias("component"))


@query("b18_select_columns", sql="""
    SELECT r.taker, r.item, r.y FROM responses r
    WHERE r.item IN (SELECT item FROM loadings)""")
def select_columns(spark, folder):
    wanted = inputs.loadings(spark, folder).select("item")
    return inputs.study(spark, folder).responses.join(wanted, "item", "left_semi")


@query("b19_ratios", sql="""
    SELECT scenario, COUNT(*) AS n_items, round(1.0 / COUNT(*), 6) + 0.0 AS weight,
           round(COUNT(*) * 100.0 / (SELECT COUNT(*) FROM items), 6) + 0.0 AS percent
    FROM items GROUP BY scenario""")
def ratios(spark, folder):
    items = inputs.study(spark, folder).items
    counted = score.with_share(score.value_counts(items, "scenario"))
    return counted.select("scenario", F.col("n").alias("n_items"),
                          fixed(1 / F.col("n")).alias("weight"),
                          fixed(F.col("percent")).alias("percent"))


@query("b20_renamed_aggregate", sql="""
    SELECT scenario, COUNT(*) AS "Items", round(AVG(missing_count), 3) + 0.0 AS "Avg_Missing"
    FROM profile GROUP BY scenario""")
def renamed(spark, folder):
    table = inputs.profile(spark, folder).groupBy("scenario").agg(
        F.count(F.lit(1)), fixed(F.avg("missing_count"), 3))
    return table.toDF("scenario", "Items", "Avg_Missing")


@query("b21_shorten_text", sql="""
    SELECT doc_id, CASE WHEN LENGTH(text) > 50 THEN CONCAT(SUBSTR(text, 1, 50), '...')
                        ELSE text END AS short, SUBSTR(text, 1, 100) AS head
    FROM documents""")
def shorten_text(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    return docs.select("doc_id", shorten(F.col("text"), 50).alias("short"),
                       F.substring("text", 1, 100).alias("head"))


@query("b22_joined_label", sql="""
    SELECT DISTINCT CONCAT(scenario, '_', benchmark) AS label FROM items""")
def joined_label(spark, folder):
    items = inputs.study(spark, folder).items
    return items.select(F.concat_ws("_", "scenario", "benchmark").alias("label")).distinct()


@query("b23_label_runs", extra="""
    flagged AS (SELECT item, scenario, CASE WHEN scenario = LAG(scenario) OVER (ORDER BY item)
                                            THEN 0 ELSE 1 END AS starts FROM items),
    numbered AS (SELECT *, SUM(starts) OVER (ORDER BY item) AS run FROM flagged)""", sql="""
    SELECT CAST(run AS BIGINT) AS run, scenario, MIN(item) AS start, MAX(item) AS "end",
           (MIN(item) + MAX(item)) / 2.0 AS middle
    FROM numbered GROUP BY run, scenario""")
def label_runs(spark, folder):
    return reshape.runs(inputs.study(spark, folder).items, "item", "scenario", [])


@query("b25_level_profile", sql="""
    SELECT COUNT(DISTINCT input_text) AS n_input_text, COUNT(DISTINCT scenario) AS n_scenario,
           COUNT(DISTINCT benchmark) AS n_benchmark,
           (SELECT CASE WHEN COUNT(*) <= 10 THEN STRING_AGG(scenario, ',' ORDER BY scenario) END
            FROM (SELECT DISTINCT scenario FROM items)) AS scenarios
    FROM items""")
def level_profile(spark, folder):
    items = inputs.study(spark, folder).items
    few = items.select("scenario").distinct().limit(11)         # listed only when it is a short list
    listed = F.array_join(F.array_sort(F.collect_list("scenario")), ",")
    names = few.agg(F.when(F.count(F.lit(1)) <= 10, listed)).scalar()
    return (reshape.level_profile(items, ["input_text", "scenario", "benchmark"])
            .withColumn("scenarios", names))

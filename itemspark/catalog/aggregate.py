"""Scores, counts and summaries (family F)."""

from pyspark.sql import functions as F

from itemspark.catalog import inputs
from itemspark.catalog.joins import SELECTION_SQL, selection
from itemspark.catalog.registry import query
from itemspark.functions.scalars import fixed, log_likelihood, sigmoid
from itemspark.operators import choose, qmatrix, sample, score


@query("f1_counts_per_taker", sql="""
    SELECT t.taker, COALESCE(CAST(SUM(y) AS BIGINT), 0) AS correct,
           COALESCE(CAST(SUM(1 - y) AS BIGINT), 0) AS incorrect
    FROM takers t LEFT JOIN responses r ON r.taker = t.taker GROUP BY t.taker""")
def counts(spark, folder):
    s = inputs.study(spark, folder)
    return score.counts_per_taker(s.responses, s.takers)


@query("f2_scenario_scores", sql="SELECT taker, scenario, round(p, 6) + 0.0 AS p FROM scores")
def scenario_scores(spark, folder):
    return inputs.scores(spark, folder).withColumn("p", fixed(F.col("p")))


@query("f3_scenario_means", sql="""
    SELECT r.taker, i.scenario, round(AVG(r.y), 6) + 0.0 AS p
    FROM responses r JOIN items i ON i.item = r.item GROUP BY r.taker, i.scenario""")
def scenario_means(spark, folder):
    s = inputs.study(spark, folder)
    return score.observed_means(s.responses, s.items, "scenario").withColumn("p", fixed(F.col("p")))


@query("f4_benchmark_means", sql="""
    SELECT taker, scenario, benchmark, round(p, 6) + 0.0 AS p FROM observed""")
def benchmark_means(spark, folder):
    s = inputs.study(spark, folder)
    return (score.observed_means(s.responses, s.items, "scenario", "benchmark")
            .withColumn("p", fixed(F.col("p"))))


FACTOR_SQL = """
    sizes AS (SELECT factor, SUM(member) AS n_items FROM members GROUP BY factor),
    factor_scores AS (
        SELECT t.taker, s.factor, CASE WHEN s.n_items = 0 THEN 0.0 ELSE
               COALESCE(c.correct, 0) / CAST(s.n_items AS DOUBLE) END AS p
        FROM takers t CROSS JOIN sizes s
        LEFT JOIN (SELECT r.taker, m.factor, SUM(r.y) AS correct FROM responses r
                   JOIN members m ON m.item = r.item AND m.member = 1 GROUP BY r.taker, m.factor) c
               ON c.taker = t.taker AND c.factor = s.factor)"""


def factor_scores(spark, folder):
    s = inputs.study(spark, folder)
    return score.membership_scores(s.responses, inputs.members(spark, folder), s.takers)


@query("f5_factor_scores", extra=FACTOR_SQL, sql="""
    SELECT taker, factor, round(p, 6) + 0.0 AS p FROM factor_scores""")
def rounded_factor_scores(spark, folder):
    return factor_scores(spark, folder).withColumn("p", fixed(F.col("p")))


@query("f6_missing_counts", sql="""
    SELECT item, missing_count, CAST(SUM(missing_count) OVER () AS BIGINT) AS total_missing
    FROM profile""")
def missing_counts(spark, folder):
    table = inputs.profile(spark, folder).select("item", "missing_count")
    return table.withColumn("total_missing", table.agg(F.sum("missing_count")).scalar())


@query("f7_value_counts", sql="""
    SELECT 'scenario' AS level, scenario AS value, COUNT(*) AS n,
           round(COUNT(*) * 100.0 / SUM(COUNT(*)) OVER (), 6) + 0.0 AS percent
    FROM items GROUP BY scenario
    UNION ALL
    SELECT 'benchmark', benchmark, COUNT(*), round(COUNT(*) * 100.0 / SUM(COUNT(*)) OVER (), 6) + 0.0
    FROM items GROUP BY benchmark""")
def value_counts(spark, folder):
    items = inputs.study(spark, folder).items
    parts = [score.with_share(score.value_counts(items, x)).select(
        F.lit(x).alias("level"), F.col(x).alias("value"), "n", fixed(F.col("percent")).alias("percent"))
        for x in ("scenario", "benchmark")]
    return parts[0].unionByName(parts[1]).orderBy("level", F.col("n").desc())


MASTER_SQL = """
    master AS (SELECT m.*, p.missing_count, p.scenario FROM meta m JOIN profile p ON p.item = m.item)"""


def master(spark, folder):
    return qmatrix.metadata(inputs.loadings(spark, folder)).join(
        inputs.profile(spark, folder).select("item", "missing_count", "scenario"), "item")


@query("f8_factor_coverage", extra=MASTER_SQL, sql="""
    SELECT primary_factor, COUNT(item) AS items, round_even(AVG(num_factors), 3) + 0.0 AS avg_num_factors,
           round_even(AVG(max_loading), 3) + 0.0 AS avg_max_loading,
           round_even(AVG(missing_count), 3) + 0.0 AS avg_missing
    FROM master GROUP BY primary_factor""")
def coverage(spark, folder):
    def mean(column):
        return (F.bround(F.avg(column), 3) + 0.0)
    return master(spark, folder).groupBy("primary_factor").agg(
        F.count("item").alias("items"), mean("num_factors").alias("avg_num_factors"),
        mean("max_loading").alias("avg_max_loading"), mean("missing_count").alias("avg_missing"))


@query("f9_distinct_counts", extra=MASTER_SQL, sql="""
    SELECT COUNT(DISTINCT primary_factor) AS n_primary, COUNT(DISTINCT assigned_factors) AS n_assigned
    FROM master""")
def distinct_counts(spark, folder):
    return master(spark, folder).agg(F.countDistinct("primary_factor").alias("n_primary"),
                                     F.countDistinct("assigned_factors").alias("n_assigned"))


@query("f10_describe", extra=FACTOR_SQL, sql="""
    SELECT factor, COUNT(p) AS n, """ + ", ".join(
        f"round({e}, 6) + 0.0 AS {n}" for n, e in (
            ("mean", "AVG(p)"), ("std", "STDDEV_SAMP(p)"), ("min", "MIN(p)"), ("max", "MAX(p)"),
            ("q25", "QUANTILE_CONT(p, 0.25)"), ("q50", "QUANTILE_CONT(p, 0.5)"),
            ("q75", "QUANTILE_CONT(p, 0.75)"))) + """
    FROM factor_scores GROUP BY factor""")
def describe(spark, folder):
    table = score.describe(factor_scores(spark, folder), "p", "factor")
    return table.select("factor", "n", *[fixed(F.col(c)).alias(c) for c in
                                         ("mean", "std", "min", "max", "q25", "q50", "q75")])


@query("f11_response_rates", sql="""
    SELECT item, round(response_rate, 6) + 0.0 AS response_rate FROM profile""")
def response_rates(spark, folder):
    return inputs.profile(spark, folder).select("item", fixed(F.col("response_rate"))
                                                .alias("response_rate"))


@query("f12_value_range", sql="""
    SELECT round(MIN(p), 6) + 0.0 AS lo, round(MAX(p), 6) + 0.0 AS hi FROM scores""")
def value_range(spark, folder):
    return inputs.scores(spark, folder).agg(fixed(F.min("p")).alias("lo"), fixed(F.max("p")).alias("hi"))


@query("f13_factors_per_item", sql="""
    SELECT 'num_factors' AS kind, CAST(num_factors AS VARCHAR) AS value, COUNT(*) AS n,
           round(COUNT(*) * 100.0 / SUM(COUNT(*)) OVER (), 6) + 0.0 AS percent
    FROM meta GROUP BY num_factors
    UNION ALL
    SELECT 'primary_factor', primary_factor, COUNT(*),
           round(COUNT(*) * 100.0 / SUM(COUNT(*)) OVER (), 6) + 0.0
    FROM meta GROUP BY primary_factor""")
def factors_per_item(spark, folder):
    table = qmatrix.metadata(inputs.loadings(spark, folder))
    parts = [score.with_share(score.value_counts(table, x)).select(
        F.lit(x).alias("kind"), F.col(x).cast("string").alias("value"), "n",
        fixed(F.col("percent")).alias("percent")) for x in ("num_factors", "primary_factor")]
    return parts[0].unionByName(parts[1])


@query("f14_items_per_factor", sql="""
    SELECT factor, CAST(SUM(member) AS BIGINT) AS n_items,
           round(SUM(member) * 100.0 / COUNT(*), 6) + 0.0 AS percent
    FROM members GROUP BY factor""")
def items_per_factor(spark, folder):
    return inputs.members(spark, folder).groupBy("factor").agg(
        F.sum("member").alias("n_items"),
        fixed(F.sum("member") * 100 / F.count(F.lit(1))).alias("percent"))


@query("f15_factor_count_summary", sql="""
    SELECT COUNT(*) FILTER (WHERE num_factors = 1) AS one,
           COUNT(*) FILTER (WHERE num_factors > 1) AS several,
           COUNT(*) FILTER (WHERE num_factors = (SELECT COUNT(DISTINCT factor) FROM loadings)) AS every,
           CAST(SUM(num_factors) AS BIGINT) AS assignments
    FROM meta""")
def factor_count_summary(spark, folder):
    n_factors = inputs.loadings(spark, folder).agg(F.countDistinct("factor")).scalar()
    n = F.col("num_factors")
    return qmatrix.metadata(inputs.loadings(spark, folder)).agg(
        F.count_if(n == 1).alias("one"), F.count_if(n > 1).alias("several"),
        F.count_if(n == n_factors).alias("every"), F.sum(n).alias("assignments"))


@query("f16_subscores", extra=SELECTION_SQL, sql="""
    SELECT t.taker, k.component, round(COALESCE(c.correct, 0) / CAST(k.n_items AS DOUBLE), 6) + 0.0 AS score
    FROM takers t CROSS JOIN (SELECT component, COUNT(*) AS n_items FROM selection GROUP BY component) k
    LEFT JOIN (SELECT r.taker, s.component, SUM(r.y) AS correct FROM responses r
               JOIN selection s ON s.item = r.item GROUP BY r.taker, s.component) c
           ON c.taker = t.taker AND c.component = k.component""")
def subscores(spark, folder):
    s = inputs.study(spark, folder)
    return (score.subscores(s.responses, selection(spark, folder), s.takers)
            .withColumn("score", fixed(F.col("score"))))


@query("f17_split_means", sql="""
    SELECT taker, split, COUNT(*) AS n, round(AVG(y), 6) + 0.0 AS mean FROM split
    GROUP BY taker, split""")
def split_means(spark, folder):
    cells = sample.bernoulli_split(inputs.study(spark, folder).responses)
    return cells.groupBy("taker", "split").agg(F.count(F.lit(1)).alias("n"),
                                               fixed(F.avg("y")).alias("mean"))


@query("f18_coverage_check", extra="""
    per AS (SELECT k.split, LEAST(MIN(tn), MIN(tn)) AS min_per_taker FROM (VALUES ('train'), ('test')) k(split)
            CROSS JOIN LATERAL (SELECT t.taker, COUNT(c.item) AS tn FROM takers t LEFT JOIN split c
                ON c.taker = t.taker AND c.split = k.split GROUP BY t.taker) x GROUP BY k.split),
    pei AS (SELECT k.split, MIN(tn) AS min_per_item FROM (VALUES ('train'), ('test')) k(split)
            CROSS JOIN LATERAL (SELECT i.item, COUNT(c.taker) AS tn FROM items i LEFT JOIN split c
                ON c.item = i.item AND c.split = k.split GROUP BY i.item) x GROUP BY k.split)""", sql="""
    SELECT per.split, min_per_taker, min_per_item, min_per_taker > 0 AND min_per_item > 0 AS valid
    FROM per JOIN pei ON pei.split = per.split""")
def coverage_check(spark, folder):
    s = inputs.study(spark, folder)
    return sample.split_coverage(sample.bernoulli_split(s.responses), s.items, s.takers)


@query("f19_histogram", extra="""
    comm AS (SELECT item, SUM(loading * loading) AS h FROM loadings GROUP BY item),
    ends AS (SELECT MIN(h) AS lo, MAX(h) AS hi FROM comm)""", sql="""
    SELECT CAST(CASE WHEN hi > lo THEN LEAST(FLOOR((round(h, 9) - round(lo, 9)) /
                ((round(hi, 9) - round(lo, 9)) / 30)), 29) ELSE 0 END AS INTEGER) AS bin, COUNT(*) AS n
    FROM comm CROSS JOIN ends GROUP BY 1""")
def histogram(spark, folder):
    communality = inputs.loadings(spark, folder).groupBy("item").agg(
        fixed(F.sum(F.col("loading") * F.col("loading")), 9).alias("h"))
    return score.histogram(communality, "h", 30)


@query("f20_difficulty_spread", sql="""
    SELECT scenario, COUNT(*) AS n_items, round(AVG(correct / CAST(n_takers AS DOUBLE)), 6) + 0.0 AS mean_performance,
           round(STDDEV_SAMP(correct / CAST(n_takers AS DOUBLE)), 6) + 0.0 AS difficulty_spread
    FROM profile CROSS JOIN n GROUP BY scenario""")
def spread(spark, folder):
    s = inputs.study(spark, folder)
    table = score.difficulty_spread(s.responses, s.items, s.takers)
    return table.select("scenario", "n_items", *[fixed(F.col(c)).alias(c) for c in
                                                 ("mean_performance", "difficulty_spread")])


@query("f21_loading_diagnostics", extra="""
    comm AS (SELECT item, SUM(loading * loading) AS h FROM loadings GROUP BY item)""", sql="""
    SELECT round(AVG(ABS(loading)), 6) + 0.0 AS mean_abs, round(MAX(ABS(loading)), 6) + 0.0 AS max_abs,
           COUNT(*) FILTER (WHERE ABS(loading) > 0.3e0) AS above_3,
           COUNT(*) FILTER (WHERE ABS(loading) > 0.2e0) AS above_2,
           COUNT(*) FILTER (WHERE ABS(loading) > 0.1e0) AS above_1,
           (SELECT round(AVG(h), 6) + 0.0 FROM comm) AS mean_communality,
           (SELECT round(MIN(h), 6) + 0.0 FROM comm) AS min_communality,
           (SELECT round(MAX(h), 6) + 0.0 FROM comm) AS max_communality,
           (SELECT COUNT(*) FROM comm WHERE round(h, 9) > 0.5) AS well_fitted
    FROM loadings""")
def diagnostics(spark, folder):
    table = inputs.loadings(spark, folder)
    size = F.abs("loading")
    h = table.groupBy("item").agg(fixed(F.sum(F.col("loading") * F.col("loading")), 9).alias("h"))
    out = table.agg(fixed(F.avg(size)).alias("mean_abs"), fixed(F.max(size)).alias("max_abs"),
                    *[F.count_if(size > t / 10).alias(f"above_{t}") for t in (3, 2, 1)])
    fits = {"mean_communality": fixed(F.avg("h")), "min_communality": fixed(F.min("h")),
            "max_communality": fixed(F.max("h")), "well_fitted": F.count_if(F.col("h") > 0.5)}
    return out.select("*", *[h.agg(e).scalar().alias(n) for n, e in fits.items()])


@query("f24_factor_profiles", sql="""
    SELECT factor, scenario, n, round(mean_loading, 6) + 0.0 AS mean_loading,
           round(percent, 6) + 0.0 AS percent FROM factor_scenarios""")
def factor_profiles(spark, folder):
    from itemspark.operators import skills
    rows = skills.interpretation_rows(inputs.loadings(spark, folder), inputs.named_items(spark, folder))
    return score.factor_profile(rows).select(
        "factor", "scenario", "n", fixed(F.col("mean_loading")).alias("mean_loading"),
        fixed(F.col("percent")).alias("percent"))


@query("f25_factor_summary", sql="""
    SELECT d.factor, s.skill, s.top_scenario, COUNT(*) AS n_items,
           round(AVG(size), 6) + 0.0 AS mean_loading, COUNT(DISTINCT d.scenario) AS scenario_diversity
    FROM described d JOIN skills s ON s.factor = d.factor GROUP BY d.factor, s.skill, s.top_scenario""")
def factor_summary(spark, folder):
    from itemspark.operators import skills
    table = skills.factor_summary(inputs.loadings(spark, folder), inputs.named_items(spark, folder))
    return table.withColumn("mean_loading", fixed(F.col("mean_loading")))


@query("f26_agreement_rate", sql="""
    SELECT COUNT(*) AS n, round(AVG(CASE WHEN e.label = m.factor THEN 1.0 ELSE 0.0 END), 6) + 0.0 AS agreement
    FROM embeddings e JOIN (SELECT item, ARG_MAX(factor, (ABS(loading), -factor)) AS factor
                            FROM loadings GROUP BY item) m ON m.item = e.vec_id""")
def agreement(spark, folder):
    labels = spark.read.parquet(f"{folder}/embeddings.parquet").select(F.col("vec_id").alias("item"), "label")
    primary = choose.strongest_factor(inputs.loadings(spark, folder))
    match = (F.col("label") == F.col("factor")).cast("double")
    return labels.join(primary, "item").agg(F.count(F.lit(1)).alias("n"),
                                            fixed(F.avg(match)).alias("agreement"))


@query("f27_argmax_row", sql="""
    SELECT scenario, ARG_MAX(taker, (p, -taker)) AS taker, round(MAX(p), 6) + 0.0 AS p
    FROM scores GROUP BY scenario""")
def argmax(spark, folder):
    best = F.max(F.struct("p", (-F.col("taker")).alias("neg"))).alias("b")
    return inputs.scores(spark, folder).groupBy("scenario").agg(best).select(
        "scenario", (-F.col("b.neg")).alias("taker"), fixed(F.col("b.p")).alias("p"))


@query("f28_both_classes", sql="""
    SELECT item, COUNT(DISTINCT y) > 1 AS both FROM responses GROUP BY item""")
def both_classes(spark, folder):
    """Two distinct answers: with 0/1 cells, when smallest and largest differ."""
    cells = inputs.study(spark, folder).responses
    return cells.groupBy("item").agg((F.min("y") < F.max("y")).alias("both"))


@query("f29_quality_averages", extra=MASTER_SQL, sql="""
    SELECT round(AVG(num_factors), 6) + 0.0 AS avg_num_factors,
           round(AVG(max_loading), 6) + 0.0 AS avg_max_loading,
           round(AVG(missing_count), 6) + 0.0 AS avg_missing FROM master""")
def quality(spark, folder):
    return master(spark, folder).agg(
        fixed(F.avg("num_factors")).alias("avg_num_factors"),
        fixed(F.avg("max_loading")).alias("avg_max_loading"),
        fixed(F.avg("missing_count")).alias("avg_missing"))


def scored_cells(spark, folder):
    """Split cells with a model probability from scenario scores and part parameters."""
    s = inputs.study(spark, folder)
    params = s.items.select("item", "scenario").join(inputs.parameters(spark, folder), "item")
    return (sample.bernoulli_split(s.responses).join(params, "item")
            .join(inputs.scores(spark, folder), ["taker", "scenario"])
            .withColumn("score", sigmoid(F.col("p") * F.col("a") - F.col("d"))))


@query("f30_mean_loss", sql="""
    SELECT split, COUNT(*) AS n, round(AVG(-(y * LN(score) + (1 - y) * LN(1 - score))), 6) + 0.0 AS loss
    FROM cell_scores GROUP BY split""")
def mean_loss(spark, folder):
    loss = -log_likelihood(F.col("y"), F.col("score"))
    return scored_cells(spark, folder).groupBy("split").agg(
        F.count(F.lit(1)).alias("n"), fixed(F.avg(loss)).alias("loss"))

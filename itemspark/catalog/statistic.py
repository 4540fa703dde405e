"""Correlation, reliability, fit and ranking quality (family J, with C14, D6, E10, F22, F23)."""

from pyspark.sql import functions as F

from itemspark.catalog import inputs
from itemspark.catalog.aggregate import FACTOR_SQL, factor_scores, scored_cells
from itemspark.catalog.cells import PAIR_SQL, pair_cells
from itemspark.catalog.joins import SELECTION_SQL, selection
from itemspark.catalog.registry import query
from itemspark.functions.scalars import fixed, sigmoid
from itemspark.operators import clean, sample, score, similar, stats


def score_correlations(spark, folder):
    return stats.correlations(inputs.scores(spark, folder), "taker", "scenario", "p")


@query("j1_pearson_matrix", sql="SELECT v1, v2, round(r, 6) + 0.0 AS r FROM score_corr")
def pearson(spark, folder):
    return score_correlations(spark, folder).select("v1", "v2", fixed(F.col("r")).alias("r"))


PAIRWISE_SQL = PAIR_SQL + """,
    pair_corr AS (
        SELECT v1, v2, n, CASE WHEN n >= 2 AND vx > 1e-12 AND vy > 1e-12 THEN r END AS r FROM (
            SELECT x.pair AS v1, z.pair AS v2, COUNT(*) AS n, VAR_POP(x.p) AS vx, VAR_POP(z.p) AS vy,
                   CORR(x.p, z.p) AS r
            FROM pair_cells x JOIN pair_cells z ON z.taker = x.taker
            WHERE x.p IS NOT NULL AND z.p IS NOT NULL GROUP BY x.pair, z.pair))"""


def pair_correlations(spark, folder):
    return stats.correlations(pair_cells(spark, folder), "taker", "pair", "p")


@query("e10_pairwise_statistics", extra=PAIRWISE_SQL, sql="""
    SELECT v1, v2, n, round(r, 6) + 0.0 AS r FROM pair_corr WHERE n > 0""")
def pairwise(spark, folder):
    return (pair_correlations(spark, folder).filter("n > 0")
            .withColumn("r", fixed(F.col("r"))))


@query("d6_filled_correlations", extra=PAIRWISE_SQL, sql="""
    SELECT a.pair AS v1, b.pair AS v2,
           round(CASE WHEN a.pair = b.pair THEN 1 ELSE COALESCE(r, 0) END, 6) + 0.0 AS r
    FROM (SELECT DISTINCT pair FROM pair_cells WHERE p IS NOT NULL) a
    CROSS JOIN (SELECT DISTINCT pair FROM pair_cells WHERE p IS NOT NULL) b
    LEFT JOIN pair_corr c ON c.v1 = a.pair AND c.v2 = b.pair""")
def filled(spark, folder):
    seen = pair_cells(spark, folder).filter("p IS NOT NULL")
    pairs = stats.correlations(seen, "taker", "pair", "p")
    return clean.fill_correlations(pairs).select("v1", "v2", fixed(F.col("r")).alias("r"))


@query("f22_correlation_summary", extra=PAIRWISE_SQL, sql="""
    SELECT COUNT(*) FILTER (WHERE ABS(r) > 0.3e0) AS above_3, COUNT(*) FILTER (WHERE ABS(r) > 0.7e0) AS above_7,
           (SELECT round(AVG(m), 6) + 0.0 FROM (SELECT AVG(ABS(r)) AS m FROM pair_corr WHERE v1 <> v2
                                                GROUP BY v2)) AS mean_abs
    FROM pair_corr WHERE v1 <> v2""")
def summary(spark, folder):
    return (stats.correlation_summary(pair_correlations(spark, folder))
            .withColumn("mean_abs", fixed(F.col("mean_abs"))))


FACTOR_CORR_SQL = FACTOR_SQL + """,
    factor_corr AS (SELECT x.factor AS v1, z.factor AS v2, CORR(x.p, z.p) AS r
        FROM factor_scores x JOIN factor_scores z ON z.taker = x.taker GROUP BY x.factor, z.factor)"""


@query("f23_upper_triangle", extra=FACTOR_CORR_SQL, sql="""
    SELECT round(AVG(r), 6) + 0.0 AS mean_r, round(MAX(r), 6) + 0.0 AS max_r, round(MIN(r), 6) + 0.0 AS min_r
    FROM factor_corr WHERE v1 < v2""")
def triangle(spark, folder):
    pairs = stats.correlations(factor_scores(spark, folder), "taker", "factor", "p")
    return stats.upper_triangle(pairs).select(*[fixed(F.col(c)).alias(c)
                                                for c in ("mean_r", "max_r", "min_r")])


RANK_SQL = """
    ranked AS (SELECT taker, scenario, RANK() OVER (PARTITION BY scenario ORDER BY p)
                      + (COUNT(*) OVER (PARTITION BY scenario, p) - 1) / 2.0 AS rk FROM scores)"""


@query("j2_spearman_matrix", extra=RANK_SQL, sql="""
    SELECT x.scenario AS v1, z.scenario AS v2, round(CORR(x.rk, z.rk), 6) + 0.0 AS r
    FROM ranked x JOIN ranked z ON z.taker = x.taker GROUP BY x.scenario, z.scenario""")
def spearman(spark, folder):
    table = stats.correlations(inputs.scores(spark, folder), "taker", "scenario", "p", "spearman")
    return table.select("v1", "v2", fixed(F.col("r")).alias("r"))


def observed_scores(spark, folder):
    s = inputs.study(spark, folder)
    return score.observed_means(s.responses, s.items, "scenario").select(
        "taker", F.col("scenario").alias("target"), F.col("p").alias("q"))


OBSERVED_SQL = """
    seen AS (SELECT r.taker, i.scenario AS target, AVG(r.y) AS q FROM responses r
             JOIN items i ON i.item = r.item GROUP BY r.taker, i.scenario),
    joint AS (SELECT s.taker, s.scenario, s.p, o.target, o.q FROM scores s JOIN seen o ON o.taker = s.taker)"""


@query("j3_cross_block", extra=OBSERVED_SQL, sql="""
    SELECT scenario, target, round(CORR(p, q), 6) + 0.0 AS r FROM joint GROUP BY scenario, target""")
def cross_block(spark, folder):
    table = stats.cross_correlations(inputs.scores(spark, folder), observed_scores(spark, folder),
                                     "taker", "scenario", "p", "target", "q")
    return table.withColumn("r", fixed(F.col("r")))


@query("j3_cross_block_spearman", extra=OBSERVED_SQL + """,
    rk AS (SELECT *, RANK() OVER (PARTITION BY scenario, target ORDER BY p)
                 + (COUNT(*) OVER (PARTITION BY scenario, target, p) - 1) / 2.0 AS a,
              RANK() OVER (PARTITION BY scenario, target ORDER BY q)
                 + (COUNT(*) OVER (PARTITION BY scenario, target, q) - 1) / 2.0 AS b FROM joint)""", sql="""
    SELECT scenario, target, round(CORR(a, b), 6) + 0.0 AS r FROM rk GROUP BY scenario, target""")
def cross_block_spearman(spark, folder):
    table = stats.cross_correlations(inputs.scores(spark, folder), observed_scores(spark, folder),
                                     "taker", "scenario", "p", "target", "q", "spearman")
    return table.withColumn("r", fixed(F.col("r")))


@query("j4_correlation_of_correlations", sql="""
    SELECT x.v2 AS v1, z.v2, round(CORR(x.r, z.r), 6) + 0.0 AS r
    FROM score_corr x JOIN score_corr z ON z.v1 = x.v1 GROUP BY x.v2, z.v2""")
def second_order(spark, folder):
    table = stats.correlation_of_correlations(score_correlations(spark, folder))
    return table.select("v1", "v2", fixed(F.col("r")).alias("r"))


COV_SQL = """
    cov AS (SELECT x.scenario AS v1, z.scenario AS v2, COVAR_SAMP(x.p, z.p) AS c
            FROM scores x JOIN scores z ON z.taker = x.taker GROUP BY x.scenario, z.scenario)"""


@query("j5_covariance", extra=COV_SQL, sql="SELECT v1, v2, round(c, 6) + 0.0 AS cov FROM cov")
def covariance(spark, folder):
    return (stats.covariances(inputs.scores(spark, folder), "taker", "scenario", "p")
            .withColumn("cov", fixed(F.col("cov"))))


@query("j5_identity_distance", extra=COV_SQL, sql="""
    SELECT round(SUM(POW(c - CASE WHEN v1 = v2 THEN 1 ELSE 0 END, 2)), 6) + 0.0 AS distance FROM cov""")
def distance(spark, folder):
    table = stats.covariances(inputs.scores(spark, folder), "taker", "scenario", "p")
    return stats.identity_distance(table).withColumn("distance", fixed(F.col("distance")))


@query("j6_standardised_scores", sql="""
    SELECT taker, scenario, round((p - AVG(p) OVER w) / COALESCE(NULLIF(STDDEV_POP(p) OVER w, 0), 1), 6) + 0.0 AS z
    FROM scores WINDOW w AS (PARTITION BY scenario)""")
def standardised(spark, folder):
    return stats.standardise(inputs.scores(spark, folder), "scenario", "p").select(
        "taker", "scenario", fixed(F.col("z")).alias("z"))


@query("j16_cell_predictions", sql="""
    SELECT c.taker, c.item, c.split, round(s.p * q.a - q.d, 6) + 0.0 AS prediction
    FROM split c JOIN items i ON i.item = c.item JOIN params q ON q.item = c.item
    JOIN scores s ON s.taker = c.taker AND s.scenario = i.scenario WHERE c.split = 'test'""")
def predictions(spark, folder):
    return (scored_cells(spark, folder).filter("split = 'test'")
            .select("taker", "item", "split", fixed(F.col("p") * F.col("a") - F.col("d"))
                    .alias("prediction")))


@query("j19_cronbach_alpha", extra=SELECTION_SQL + """,
    item_sums AS (SELECT s.component, s.position, COALESCE(SUM(r.y), 0) AS x FROM selection s
                  LEFT JOIN responses r ON r.item = s.item GROUP BY s.component, s.position),
    totals AS (SELECT k.component, t.taker, COALESCE(SUM(x.y), 0) AS t
               FROM takers t CROSS JOIN (SELECT DISTINCT component FROM selection) k
               LEFT JOIN (SELECT s.component, r.taker, r.y FROM responses r JOIN selection s ON s.item = r.item) x
                      ON x.component = k.component AND x.taker = t.taker GROUP BY k.component, t.taker),
    iv AS (SELECT component, COUNT(*) AS k, SUM((x - x * x / CAST(n_takers AS DOUBLE)) / (n_takers - 1)) AS v
           FROM item_sums CROSS JOIN n GROUP BY component),
    tv AS (SELECT component, VAR_SAMP(t) AS v FROM totals GROUP BY component)""", sql="""
    SELECT iv.component, k AS n_items, round(k / CAST(k - 1 AS DOUBLE) * (1 - iv.v / tv.v), 6) + 0.0 AS alpha
    FROM iv JOIN tv ON tv.component = iv.component""")
def alpha(spark, folder):
    s = inputs.study(spark, folder)
    return (stats.cronbach_alpha(s.responses, selection(spark, folder), s.takers)
            .withColumn("alpha", fixed(F.col("alpha"))))


@query("j20_fit_indices", sql="""
    SELECT round(ll, 3) + 0.0 AS log_likelihood, m AS n, k, round(2 * k - 2 * ll, 3) + 0.0 AS "AIC",
           round(k * LN(m) - 2 * ll, 3) + 0.0 AS "BIC"
    FROM (SELECT SUM(y * LN(score) + (1 - y) * LN(1 - score)) AS ll, COUNT(*) AS m,
                 ((SELECT COUNT(*) FROM items) * 2 + (SELECT n_takers FROM n)) * 1e0 AS k
          FROM cell_scores WHERE split = 'train')""")
def indices(spark, folder):
    s = inputs.study(spark, folder)
    table = stats.fit_indices(scored_cells(spark, folder).filter("split = 'train'"),
                              s.items.agg(F.count(F.lit(1))).scalar(), score.taker_count(s.takers), 1)
    return table.select("n", "k", *[fixed(F.col(c), 3).alias(c) for c in ("log_likelihood", "AIC", "BIC")])


RANKED_SQL = """
    train_means AS (SELECT item, SUM(y) AS s, COUNT(*) AS m FROM split WHERE split = 'train' GROUP BY item),
    rated AS (SELECT c.taker, c.item, c.y, c.split, i.scenario, t.s / CAST(t.m AS DOUBLE) AS score
              FROM split c JOIN items i ON i.item = c.item JOIN train_means t ON t.item = c.item)"""


def rated_cells(spark, folder):
    """Cells scored by the item's mean over train cells: many tied scores."""
    s = inputs.study(spark, folder)
    cells = sample.bernoulli_split(s.responses)
    means = (cells.filter("split = 'train'").groupBy("item")
             .agg((F.sum("y") / F.count(F.lit(1))).alias("score")))
    return score.with_items(cells, s.items, "scenario").join(means, "item")


def auc_sql(group, source):
    """Rank formula for the area under the curve, average ranks for ties."""
    return f"""
    SELECT {group}, round((SUM(CASE WHEN y = 1 THEN rk END) - SUM(y) * (SUM(y) + 1) / 2.0)
                 / (SUM(y) * CAST(SUM(1 - y) AS DOUBLE)), 6) + 0.0 AS auc
    FROM (SELECT {group}, y, RANK() OVER (PARTITION BY {group} ORDER BY score)
                 + (COUNT(*) OVER (PARTITION BY {group}, score) - 1) / 2.0 AS rk FROM {source})
    GROUP BY {group}"""


@query("j21_auc", extra=RANKED_SQL, sql=auc_sql("split", "rated"))
def auc(spark, folder):
    return (stats.auc(rated_cells(spark, folder), groups=["split"])
            .withColumn("auc", fixed(F.col("auc"))))


@query("j21_auc_model", extra="""
    rounded AS (SELECT split, y, round(score, 9) AS score FROM cell_scores)""",
       sql=auc_sql("split", "rounded"))
def auc_model(spark, folder):
    cells = scored_cells(spark, folder).withColumn("score", F.round("score", 9))
    return stats.auc(cells, groups=["split"]).withColumn("auc", fixed(F.col("auc")))


@query("j22_auc_by_scenario", extra=RANKED_SQL + """,
    tested AS (SELECT * FROM rated WHERE split = 'test' AND scenario IN (
        SELECT scenario FROM rated WHERE split = 'test' GROUP BY scenario
        HAVING COUNT(*) >= 10 AND MIN(y) < MAX(y)))""", sql="""
    SELECT a.scenario, a.auc, b.test_samples FROM (""" + auc_sql("scenario", "tested") + """) a
    JOIN (SELECT scenario, COUNT(*) AS test_samples FROM tested GROUP BY scenario) b
      ON b.scenario = a.scenario""")
def auc_by_scenario(spark, folder):
    test = rated_cells(spark, folder).filter("split = 'test'")
    kept = clean.scorable_groups(test, "scenario")
    areas = stats.auc(test, groups=["scenario"]).join(kept, "scenario")
    # G8: best scenario first
    return (areas.select("scenario", fixed(F.col("auc")).alias("auc"), F.col("n").alias("test_samples"))
            .orderBy(F.col("auc").desc(), "scenario"))


@query("g8_sorted_auc", extra=RANKED_SQL, sql=auc_sql("scenario", "rated") + """
    ORDER BY auc DESC, scenario""")
def sorted_auc(spark, folder):
    areas = stats.auc(rated_cells(spark, folder), groups=["scenario"])
    return areas.withColumn("auc", fixed(F.col("auc"))).orderBy(F.col("auc").desc(), "scenario")


@query("g15_best_by_metric", extra=RANKED_SQL, sql="SELECT * FROM (" + auc_sql("scenario", "rated") + """)
    ORDER BY auc DESC, scenario LIMIT 1""")
def best_by_metric(spark, folder):
    return sorted_auc(spark, folder).limit(1)


@query("j23_ctt_correlation", sql="""
    SELECT split, round(CORR(p, m), 6) + 0.0 AS cttcorr
    FROM (SELECT split, taker, AVG(score) AS p, AVG(y) AS m FROM cell_scores GROUP BY split, taker)
    GROUP BY split""")
def ctt(spark, folder):
    return (stats.ctt_correlation(scored_cells(spark, folder), ["split"])
            .withColumn("cttcorr", fixed(F.col("cttcorr"))))


@query("j30_reconstruction_probability", sql="""
    SELECT taker, item, round(score, 6) + 0.0 AS p FROM cell_scores""")
def probability(spark, folder):
    cells = scored_cells(spark, folder)
    return cells.select("taker", "item", fixed(sigmoid(F.col("p") * F.col("a") - F.col("d"))).alias("p"))


SIMILAR_SQL = """
    ones AS (SELECT taker, item FROM responses WHERE y = 1),
    totals AS (SELECT item, COUNT(*) * 1e0 AS a FROM ones GROUP BY item),
    near AS (SELECT x.item AS v1, z.item AS v2, COUNT(*) * 1e0 AS s
             FROM ones x JOIN ones z ON z.taker = x.taker AND z.item > x.item GROUP BY x.item, z.item),
    phi AS (SELECT t1.item AS v1, t2.item AS v2, (n_takers * COALESCE(s, 0) - t1.a * t2.a)
                / SQRT(t1.a * (n_takers - t1.a) * t2.a * (n_takers - t2.a)) AS r
            FROM totals t1 JOIN totals t2 ON t2.item > t1.item CROSS JOIN n
            LEFT JOIN near k ON k.v1 = t1.item AND k.v2 = t2.item
            WHERE t1.a < n_takers AND t2.a < n_takers)"""


@query("c14_correlated_items", extra=SIMILAR_SQL, sql="""
    SELECT item, item IN (SELECT v2 FROM phi WHERE ABS(r) > 0.95) AS dropped FROM items""")
def correlated_items(spark, folder):
    s = inputs.study(spark, folder)
    return similar.drop_correlated(s.items, similar.correlated_pairs(s.responses, s.takers, 0.95))


@query("c14_correlated_pairs", extra=SIMILAR_SQL, sql="""
    SELECT v1, v2, round(r, 6) + 0.0 AS r FROM phi WHERE ABS(r) > 0.5""")
def correlated_pairs(spark, folder):
    s = inputs.study(spark, folder)
    return similar.correlated_pairs(s.responses, s.takers, 0.5).withColumn("r", fixed(F.col("r")))

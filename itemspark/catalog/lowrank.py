"""Decompositions, factor analysis and clustering (rest of families G and J)."""

from pyspark.sql import functions as F

from itemspark.catalog import inputs
from itemspark.catalog.cells import pair_cells
from itemspark.catalog.registry import query
from itemspark.functions.scalars import adequacy_band, fixed
from itemspark.operators import (choose, clean, cluster, factors, moments, sample, score, stats,
                                 vectors)
from itemspark.session import above, cut_lineage

K = 8


def svd(spark, folder, k=K, split=False):
    s = inputs.study(spark, folder)
    cells = s.responses
    if split:
        cells = sample.bernoulli_split(cells).filter("split = 'train'").select("taker", "item", "y")
    cells = cut_lineage(cells)      # read by the Gram pass and by both projections
    return s, cells, vectors.truncated_svd(cells, s.items, s.takers, k)


@query("j7_component_loadings")
def component_loadings(spark, folder):
    labels, matrix, _ = factors.correlation_matrix(inputs.scores(spark, folder), "taker", "scenario", "p")
    loadings, ratios = factors.column_components(spark, labels, matrix, min(7, len(labels)))
    share = spark.createDataFrame(list(enumerate(map(float, ratios))), "factor int, explained double")
    return loadings.join(F.broadcast(share), "factor")


@query("j7_component_scores")
def component_scores(spark, folder):
    cells = inputs.scores(spark, folder)
    labels, matrix, _ = factors.correlation_matrix(cells, "taker", "scenario", "p")
    loadings, _ = factors.column_components(spark, labels, matrix, min(7, len(labels)))
    return factors.component_scores(stats.standardise(cells, "scenario", "p"), "taker", "scenario",
                                    loadings)


@query("j7_item_components")
def item_components(spark, folder):
    s = inputs.study(spark, folder)
    cells = cut_lineage(s.responses)
    loadings, ratios = vectors.item_components(cells, s.items, s.takers, 4)
    share = spark.createDataFrame(list(enumerate(map(float, ratios))), "factor int, explained double")
    return vectors.long_vectors(loadings, "item", "f", 4, "loading").join(F.broadcast(share), "factor")


@query("j8_eigenvalues")
def eigenvalues(spark, folder):
    return factors.eigenvalue_rows(spark, factors.correlation_matrix(
        inputs.scores(spark, folder), "taker", "scenario", "p")[1])


@query("j8_eigenvalue_sums", sql="""
    SELECT COUNT(DISTINCT v1) AS n, round(SUM(CASE WHEN v1 = v2 THEN r END), 6) + 0.0 AS total,
           round(SUM(r * r), 6) + 0.0 AS squares FROM score_corr""")
def eigenvalue_sums(spark, folder):
    """Their sum is the trace of the matrix and their squares add up to its squared entries."""
    v = F.col("value")
    return eigenvalues(spark, folder).agg(F.count(v).alias("n"), fixed(F.sum(v)).alias("total"),
                                          fixed(F.sum(v * v)).alias("squares"))


@query("j9_kaiser_counts")
def kaiser(spark, folder):
    return factors.kaiser_summary(eigenvalues(spark, folder))


VARIANCE_SQL = """
    ss AS (SELECT factor, SUM(loading * loading) AS v, COUNT(*) AS m FROM loadings GROUP BY factor),
    scree AS (SELECT CAST(ROW_NUMBER() OVER (ORDER BY v DESC) - 1 AS INTEGER) AS i, v AS value FROM ss)"""


def scree(spark, folder):
    """Sums of squared loadings per factor in descending order (one row per factor)."""
    table = factors.factor_variance(inputs.loadings(spark, folder))
    w = choose.Window.orderBy(F.col("ss_loading").desc())
    return table.select((F.row_number().over(w) - 1).alias("i"), F.col("ss_loading").alias("value"))


@query("g9_cumulative_share", extra=VARIANCE_SQL, sql="""
    SELECT i, round(value, 6) + 0.0 AS value,
           round(SUM(value) OVER (ORDER BY i) / SUM(value) OVER (), 6) + 0.0 AS cumulative FROM scree""")
def cumulative(spark, folder):
    table = choose.cumulative_share(scree(spark, folder))
    return table.select("i", fixed(F.col("value")).alias("value"),
                        fixed(F.col("cumulative")).alias("cumulative"))


@query("g10_scree_elbow", extra=VARIANCE_SQL, sql="""
    SELECT COALESCE(MIN(i), 0) AS n_factors FROM (
        SELECT i, LAG(value) OVER (ORDER BY i) - value AS before, value - LEAD(value) OVER (ORDER BY i) AS after
        FROM scree) WHERE after < before""")
def elbow(spark, folder):
    return choose.scree_elbow(scree(spark, folder))


@query("j9_large_variances", extra=VARIANCE_SQL, sql="""
    SELECT COUNT(*) FILTER (WHERE value > 1) AS above_one, COUNT(*) FILTER (WHERE value > 0) AS positive,
           round(SUM(value) FILTER (WHERE i < 10), 6) + 0.0 AS first_sum FROM scree""")
def large_variances(spark, folder):
    return factors.kaiser_summary(scree(spark, folder)).withColumn("first_sum", fixed(F.col("first_sum")))


@query("j13_factor_variance", extra=VARIANCE_SQL, sql="""
    SELECT factor, round(v, 6) + 0.0 AS ss_loading, round(v / m, 6) + 0.0 AS proportion,
           round(SUM(v / m) OVER (ORDER BY factor), 6) + 0.0 AS cumulative FROM ss""")
def variance(spark, folder):
    return factors.factor_variance(inputs.loadings(spark, folder)).select(
        "factor", *[fixed(F.col(c)).alias(c) for c in ("ss_loading", "proportion", "cumulative")])


@query("j13_communalities", sql="""
    SELECT item, round(SUM(loading * loading), 6) + 0.0 AS communality FROM loadings GROUP BY item""")
def communalities(spark, folder):
    return inputs.loadings(spark, folder).groupBy("item").agg(
        fixed(F.sum(F.col("loading") * F.col("loading"))).alias("communality"))


@query("j28_interpretability", extra=VARIANCE_SQL, sql="""
    SELECT round(a, 6) + 0.0 AS simple_structure, round(h, 6) + 0.0 AS mean_communality,
           round(v, 6) + 0.0 AS variance, round(a * 0.4 + h * 0.3 + v * 0.3, 6) + 0.0 AS score
    FROM (SELECT (SELECT COUNT(*) FROM loadings WHERE ABS(loading) > 0.2e0) / POW(COUNT(*), 2) AS a,
                 SUM(v / m) AS h, SUM(v / m) / COUNT(*) AS v FROM ss)""")
def interpretability(spark, folder):
    loadings = inputs.loadings(spark, folder)
    table = factors.factor_variance(loadings).agg(F.avg("proportion").alias("variance"))
    return factors.interpretability(loadings, table, []).select(
        *[fixed(F.col(c)).alias(c) for c in ("simple_structure", "mean_communality", "variance", "score")])


@query("j10_factor_loadings")
def factor_loadings(spark, folder):
    return factors.extract("minres", inputs.scores(spark, folder), "taker", "scenario", "p", 2)


@query("k13_extract_by_method")
def extract_by_method(spark, folder):
    cells = inputs.scores(spark, folder)
    parts = [factors.extract(m, cells, "taker", "scenario", "p", 3).withColumn("method", F.lit(m))
             for m in ("principal", "minres")]
    return parts[0].unionByName(parts[1])


@query("j11_varimax")
def varimax(spark, folder):
    _, _, (_, items, _) = svd(spark, folder)
    return factors.varimax(items, "item", "f", K)[0]


@query("j12_promax")
def promax(spark, folder):
    _, _, (_, items, _) = svd(spark, folder)
    return factors.promax(items, "item", "f", K)[0]


@query("j14_taker_gram", sql="""
    SELECT x.taker AS t1, z.taker AS t2, COUNT(*) AS together FROM responses x
    JOIN responses z ON z.item = x.item WHERE x.y = 1 AND z.y = 1 GROUP BY x.taker, z.taker""")
def taker_gram(spark, folder):
    """Items both takers answered right: the matrix behind the decomposition."""
    s = inputs.study(spark, folder)
    cells = vectors.right_cells(s.responses)
    if above(s.takers, moments.MAX_COLUMNS):
        return vectors.joined_gram(cells, s.takers)
    labels, _ = moments.column_labels(s.takers, "taker")
    rows = moments.gram(moments.pack(cells, "item", "taker", "y", labels), len(labels))
    names = F.broadcast(spark.createDataFrame(list(enumerate(labels)), "j int, t bigint"))
    return (rows.select("i", F.posexplode("g").alias("j", "v")).filter("v > 0")
            .join(names, "j").withColumnRenamed("t", "t2")
            .join(names.withColumnRenamed("j", "i"), "i").withColumnRenamed("t", "t1")
            .select("t1", "t2", F.col("v").cast("bigint").alias("together")))


@query("j14_item_vectors")
def item_vectors(spark, folder):
    _, _, (_, items, _) = svd(spark, folder)
    return items


@query("j14_abilities")
def abilities(spark, folder):
    s, cells, (_, items, _) = svd(spark, folder)
    return vectors.abilities(cells, items, s.takers, K)


@query("j14_standardised_abilities")
def standardised_abilities(spark, folder):
    _, _, (values, _, takers) = svd(spark, folder, 10)
    table = vectors.long_vectors(vectors.scaled(takers, values), "taker", "t", 10, "ability")
    return stats.standardise(table, "factor", "ability").select("taker", "factor", "z")


@query("j15_rank_sweep")
def rank_sweep(spark, folder):
    s = inputs.study(spark, folder)
    cells = cut_lineage(sample.exact_split(s.responses))
    train = cells.filter("split = 'train'").select("taker", "item", "y")
    values, items, takers = vectors.truncated_svd(train, s.items, s.takers, 30)
    test = cells.filter("split = 'test'").select("taker", "item", "y")
    swept = vectors.rank_sweep_scores(test, vectors.scaled(takers, values), items, range(2, 31))
    return stats.auc(swept, groups=["k"])


@query("j15_best_rank")
def best_rank(spark, folder):
    return rank_sweep(spark, folder).orderBy(F.col("auc").desc(), "k").limit(1)


@query("j16_low_rank_cells")
def low_rank_cells(spark, folder):
    s = inputs.study(spark, folder)
    _, _, (values, items, takers) = svd(spark, folder, split=True)
    test = sample.bernoulli_split(s.responses).filter("split = 'test'")
    return vectors.cell_scores(test, vectors.scaled(takers, values), items, K)


@query("j22_low_rank_auc_by_scenario")
def low_rank_auc(spark, folder):
    s = inputs.study(spark, folder)
    test = score.with_items(low_rank_cells(spark, folder), s.items, "scenario")
    kept = clean.scorable_groups(test, "scenario")
    return stats.auc(test, groups=["scenario"]).join(kept, "scenario")


def adequacy(spark, folder):
    return factors.correlation_matrix(inputs.scores(spark, folder), "taker", "scenario", "p")


@query("j17_sampling_adequacy")
def sampling_adequacy(spark, folder):
    labels, matrix, _ = adequacy(spark, folder)
    overall, each, reason = factors.kmo(matrix)
    rows = [("overall", overall, reason)]
    rows += [(x, None if each is None else float(each[i]), reason) for i, x in enumerate(labels)]
    table = spark.createDataFrame([(a, None if b is None else float(b), c) for a, b, c in rows],
                                  "label string, kmo double, reason string")
    return table.withColumn("band", adequacy_band(F.col("kmo")))


@query("j18_sphericity")
def sphericity(spark, folder):
    _, matrix, n = adequacy(spark, folder)
    statistic, p, reason = factors.bartlett(matrix, n)
    return spark.createDataFrame([(statistic and float(statistic), p and float(p), reason)],
                                 "chi_square double, p_value double, reason string")


@query("j24_kmeans")
def kmeans(spark, folder):
    _, _, (_, items, _) = svd(spark, folder)
    return cluster.kmeans(items, vectors.dims("f", K), K).select("item", "cluster")


def labelled_vectors(spark, folder):
    """The embeddings as wide rows with their label as ``cluster``, and the column names."""
    table = spark.read.parquet(f"{folder}/embeddings.parquet")
    names = vectors.dims("f", table.agg(F.max(F.size("embedding"))).first()[0])
    return table.select(F.col("label").alias("cluster"), *[
        F.col("embedding")[i].cast("double").alias(c) for i, c in enumerate(names)]), names


@query("j25_silhouettes")
def silhouettes(spark, folder):
    _, _, (_, items, _) = svd(spark, folder)
    return cluster.silhouettes(items, vectors.dims("f", K), range(2, 10))


@query("j25_best_count")
def best_cluster_count(spark, folder):
    """The number of clusters with the largest silhouette."""
    return cluster.best_count(silhouettes(spark, folder))


@query("j25_label_silhouette", extra="""
    points AS (SELECT l.item, e.label AS c, l.factor, l.loading AS x FROM loadings l
               JOIN embeddings e ON e.vec_id = l.item),
    norms AS (SELECT item, c, SUM(x * x) AS xx FROM points GROUP BY item, c),
    sums AS (SELECT c, factor, SUM(x) AS s FROM points GROUP BY c, factor),
    sizes AS (SELECT c, COUNT(*) AS m, SUM(xx) AS q FROM norms GROUP BY c),
    far AS (SELECT p.item, p.c AS own, z.c AS other, z.m, z.m * n.xx - 2 * SUM(p.x * s.s) + z.q AS total
            FROM points p JOIN norms n ON n.item = p.item JOIN sums s ON s.factor = p.factor
            JOIN sizes z ON z.c = s.c GROUP BY p.item, p.c, z.c, z.m, z.q, n.xx),
    near AS (SELECT item, MAX(CASE WHEN own = other THEN total / (m - 1) END) AS a,
                    MIN(CASE WHEN own <> other THEN total / m END) AS b FROM far GROUP BY item)""", sql="""
    SELECT round(AVG((b - a) / GREATEST(a, b)), 6) + 0.0 AS silhouette FROM near""")
def label_silhouette(spark, folder):
    """Silhouette of the vectors' own labels."""
    wide, names = labelled_vectors(spark, folder)
    return spark.createDataFrame([(cluster.silhouette(wide, names),)], "s double").select(
        fixed(F.col("s")).alias("silhouette"))


@query("j25_euclidean_silhouette", extra="""
    points AS (SELECT vec_id, label AS c, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings),
    sizes AS (SELECT c, COUNT(*) AS m FROM points GROUP BY c),
    far AS (SELECT p.vec_id, p.c AS own, q.c AS other, SUM(list_distance(p.v, q.v)) AS total
            FROM points p JOIN points q ON TRUE GROUP BY p.vec_id, p.c, q.c),
    near AS (SELECT vec_id, MAX(CASE WHEN own = other AND m > 1 THEN total / (m - 1) END) AS a,
                    MIN(CASE WHEN own <> other THEN total / m END) AS b
             FROM far JOIN sizes ON c = other GROUP BY vec_id)""", sql="""
    SELECT round(AVG(CASE WHEN a IS NULL OR GREATEST(a, b) = 0 THEN 0 ELSE (b - a) / GREATEST(a, b) END), 6) + 0.0 AS silhouette
    FROM near""")
def euclidean_label_silhouette(spark, folder):
    """Silhouette of the vectors' own labels, by plain Euclidean distances."""
    wide, names = labelled_vectors(spark, folder)
    return cluster.euclidean_silhouette(wide, names).select(fixed(F.col("silhouette")).alias("silhouette"))


@query("j26_cluster_agreement", extra="""
    prime AS (SELECT item, ARG_MAX(factor, (ABS(loading), -factor)) AS factor FROM loadings GROUP BY item),
    pairs AS (SELECT e.vec_id AS item, e.label AS cluster, p.factor FROM embeddings e
              LEFT JOIN prime p ON p.item = e.vec_id),
    best AS (SELECT cluster, MAX(c) AS b, SUM(c) AS s FROM (
                SELECT cluster, factor, COUNT(*) AS c FROM pairs GROUP BY cluster, factor) GROUP BY cluster)""", sql="""
    SELECT 'same number' AS rule, COUNT(*) AS n,
           round(AVG(CASE WHEN cluster = factor THEN 1.0 ELSE 0.0 END), 6) + 0.0 AS agreement FROM pairs
    UNION ALL
    SELECT 'most frequent', CAST(SUM(s) AS BIGINT), round(SUM(b) / CAST(SUM(s) AS DOUBLE), 6) + 0.0 FROM best""")
def cluster_agreement(spark, folder):
    clusters = spark.read.parquet(f"{folder}/embeddings.parquet").select(
        F.col("vec_id").alias("item"), F.col("label").alias("cluster"))
    primary = choose.strongest_factor(inputs.loadings(spark, folder))
    parts = [rule(clusters, primary).withColumn("rule", F.lit(name)) for name, rule in
             (("same number", cluster.agreement), ("most frequent", cluster.matched_agreement))]
    return parts[0].unionByName(parts[1]).withColumn("agreement", fixed(F.col("agreement")))


@query("j26_kmeans_agreement")
def kmeans_agreement(spark, folder):
    _, _, (_, items, _) = svd(spark, folder)
    clusters = cluster.kmeans(items, vectors.dims("f", K), K)
    primary = choose.strongest_factor(vectors.long_vectors(items, "item", "f", K, "loading"))
    return cluster.agreement(clusters, primary)


def filled_pairs(spark, folder):
    cells = clean.fill_missing(pair_cells(spark, folder), "pair", "p", "zero")
    return cut_lineage(clean.drop_constant_columns(cells, "pair", "p"))


@query("j27_factor_counts")
def factor_counts(spark, folder):
    _, matrix, _ = factors.correlation_matrix(filled_pairs(spark, folder), "taker", "pair", "p")
    return factors.compare_factor_counts(spark, matrix, 50)


@query("j29_solution_grid")
def solution_grid(spark, folder):
    return factors.solution_grid(filled_pairs(spark, folder), "taker", "pair", "p",
                                 [3, 4, 5, 6, 7, 8], ["principal", "minres"])


@query("j29_best_solution")
def best_solution(spark, folder):
    return factors.best_solution(solution_grid(spark, folder))

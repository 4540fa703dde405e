"""Calibration models (family K)."""

from pyspark.sql import functions as F

from itemspark.catalog import inputs
from itemspark.catalog.lowrank import svd
from itemspark.catalog.registry import query
from itemspark.functions.scalars import fixed, sigmoid
from itemspark.operators import irt, moments, qmatrix, reshape, sample, stats, vectors
from itemspark.session import cut_lineage


def split_study(spark, folder):
    s = inputs.study(spark, folder)
    cells = cut_lineage(sample.bernoulli_split(s.responses))     # read in every round
    return s, cells, cells.filter("split = 'train'").select("taker", "item", "y")


def node_sql(z):
    """Expected probability over the nodes, as DuckDB text."""
    x, w = irt.normal_nodes()
    return " + ".join(f"{b!r} / (1 + EXP(-({z} + {a!r})))" for a, b in zip(x, w)).replace("+ -", "- ")


BISECTION_SQL = """
    sums AS (SELECT item, CAST(SUM(y) AS BIGINT) AS correct, COUNT(*) AS asked FROM split
             WHERE split = 'train' GROUP BY item),
    halving AS (
        SELECT correct, asked, -12e0 AS lo, 12e0 AS hi, 0 AS step FROM (SELECT DISTINCT correct, asked FROM sums)
        UNION ALL
        SELECT correct, asked, CASE WHEN low THEN mid ELSE lo END, CASE WHEN low THEN hi ELSE mid END, step + 1
        FROM (SELECT *, """ + node_sql("mid") + """ < correct / CAST(asked AS DOUBLE) AS low
              FROM (SELECT *, (lo + hi) / 2 AS mid FROM halving WHERE step < 45))),
    easiness AS (SELECT s.item, s.correct, s.asked, (lo + hi) / 2 AS z FROM sums s
                 JOIN halving h ON h.correct = s.correct AND h.asked = s.asked AND h.step = 45)"""


@query("k1_item_easiness", extra=BISECTION_SQL, sql="""
    SELECT item, correct, asked, round(z, 6) + 0.0 AS z FROM easiness""")
def item_easiness(spark, folder):
    _, _, train = split_study(spark, folder)
    sums = train.groupBy("item").agg(F.sum("y").alias("correct"), F.count("y").alias("asked"))
    return irt.easiness_by_mean(sums).select("item", "correct", "asked", fixed(F.col("z")).alias("z"))


@query("k1_taker_abilities", extra=BISECTION_SQL + """,
    merged AS (SELECT c.taker, z, COUNT(*) AS m, SUM(c.y) AS s FROM split c JOIN easiness e ON e.item = c.item
               WHERE split = 'train' GROUP BY c.taker, z),
    newton AS (
        SELECT taker, 0e0 AS theta, 0 AS step FROM (SELECT DISTINCT taker FROM merged)
        UNION ALL
        SELECT taker, theta + GREATEST(-2, LEAST(2, (g - 0.001 * theta) / (h + 0.001))), step + 1 FROM (
            SELECT m.taker, MAX(theta) AS theta, MAX(step) AS step,
                   SUM(s - m * (1 / (1 + EXP(-(theta + z))))) AS g,
                   SUM(m * (1 / (1 + EXP(-(theta + z)))) * (1 - 1 / (1 + EXP(-(theta + z))))) AS h
            FROM merged m JOIN newton k ON k.taker = m.taker WHERE step < 40 GROUP BY m.taker))""", sql="""
    SELECT taker, round(theta, 6) + 0.0 AS theta FROM newton WHERE step = 40""")
def taker_abilities(spark, folder):
    _, _, train = split_study(spark, folder)
    _, takers = irt.fit_one_parameter(train)
    return takers.withColumn("theta", fixed(F.col("theta")))


@query("k1_evaluation")
def one_parameter_evaluation(spark, folder):
    _, cells, train = split_study(spark, folder)
    items, takers = irt.fit_one_parameter(train)
    scored = cut_lineage(irt.one_parameter_scores(cells, items, takers))
    return stats.auc(scored, groups=["split"]).join(stats.ctt_correlation(scored, ["split"]), "split")


COMPONENTS = ["air_bench_2024", "legalbench", "med_qa", "mmlu", "not_listed", "thai_exam"]


def component_qmatrix(items):
    return inputs.named(items).select("item", F.col("scenario").alias("factor"))


def confirmatory(spark, folder, theta_min):
    s, cells, train = split_study(spark, folder)
    masks = irt.qmatrix_masks(component_qmatrix(s.items), COMPONENTS)
    model = irt.fit_joint(train, s.takers, masks, len(COMPONENTS), theta_min=theta_min)
    return s, cells, model


@query("k2_confirmatory_evaluation")
def confirmatory_evaluation(spark, folder):
    s, cells, model = confirmatory(spark, folder, 0.0)
    return irt.evaluate(cells, model, s.items, s.takers)


#: The last takers' step moves the items' gradients a little beyond irt.GRADIENT.
SETTLED = 2.5 * irt.GRADIENT


@query("k2_settled_fit", sql="""
    SELECT 6 AS model, 'items' AS side, COUNT(*) AS n, 0 AS unsettled FROM part
    UNION ALL SELECT 6, 'takers', COUNT(*), 0 FROM supplier""")
def settled_fit(spark, folder):
    """The confirmatory fit ends at an optimum: no item or taker is left with a gradient."""
    s, cells, model = confirmatory(spark, folder, 0.0)
    train = cells.filter("split = 'train'").select("taker", "item", "y")
    gaps = irt.projected_gradients(train, model)
    return gaps.groupBy("model", "side").agg(F.count("*").alias("n"), F.count_if(F.col("gap") > SETTLED).alias("unsettled"))


@query("k2_two_stage_evaluation")
def two_stage_evaluation(spark, folder):
    s, cells, train = split_study(spark, folder)
    masks = irt.qmatrix_masks(component_qmatrix(s.items), COMPONENTS)
    model = irt.fit_nuisance(train, s.takers, masks, len(COMPONENTS))
    return irt.evaluate(cells, model, s.items, s.takers)


@query("k3_bifactor_evaluation")
def bifactor_evaluation(spark, folder):
    s, cells, train = split_study(spark, folder)
    names = ["g_factor"] + COMPONENTS
    masks = irt.qmatrix_masks(qmatrix.bifactor(component_qmatrix(s.items)), names)
    model = irt.fit_joint(train, s.takers, masks, len(names))
    return irt.evaluate(cells, model, s.items, s.takers)


@query("k4_exploratory_items")
def exploratory_items(spark, folder):
    s, _, train = split_study(spark, folder)
    model = irt.fit_exploratory(train, s.items, s.takers, [4])
    return model.items.select("item", *vectors.dims("a", 4), "d")


@query("k5_dimension_sweep")
def dimension_sweep(spark, folder):
    s, cells, train = split_study(spark, folder)
    model = irt.fit_exploratory(train, s.items, s.takers, list(range(2, 12)))
    return irt.evaluate(cells, model, s.items, s.takers)


@query("k5_settled_sweep", sql="""
    SELECT m AS n_dimensions, (SELECT COUNT(*) FROM supplier) AS takers, 0 AS unsettled, 0 AS negative, 0 AS beyond_size
    FROM (VALUES (2), (4), (7)) v(m)""")
def settled_sweep(spark, folder):
    """Models of a sweep: abilities of the rotated items are at their optimum, nothing is
    negative, and a model has no parameters beyond its size."""
    s, _, train = split_study(spark, folder)
    model = irt.fit_exploratory(train, s.items, s.takers, [2, 4, 7])
    gaps = irt.projected_gradients(train, model, move_items=False)
    beyond = sum((F.when(F.col("model") <= d, F.abs(F.col(c))).otherwise(0.0) for d, c in enumerate(vectors.dims("a", 7))), F.lit(0.0))
    items = model.items.groupBy("model").agg(
        F.count_if(F.least(*vectors.dims("a", 7)) < 0).alias("negative"), F.count_if(beyond > 0).alias("beyond_size"))
    takers = gaps.groupBy("model").agg(F.count("*").alias("takers"), F.count_if(F.col("gap") > SETTLED).alias("unsettled"))
    return takers.join(items, "model").select(F.col("model").alias("n_dimensions"), "takers", "unsettled", "negative", "beyond_size")


@query("k6_free_ability_evaluation")
def free_ability_evaluation(spark, folder):
    s, cells, model = confirmatory(spark, folder, None)
    return irt.evaluate(cells, model, s.items, s.takers)


def penalised(spark, folder):
    s, cells, _ = split_study(spark, folder)
    masks = irt.qmatrix_masks(component_qmatrix(s.items), COMPONENTS)
    return s, irt.fit_penalised(cells, s.takers, masks, len(COMPONENTS))


@query("k7_penalised_abilities")
def penalised_abilities(spark, folder):
    return irt.theta_table(penalised(spark, folder)[1][0], COMPONENTS)


@query("k12_epoch_history")
def epoch_history(spark, folder):
    return penalised(spark, folder)[1][1]


def score_model(spark, folder):
    """Scenario scores as abilities, part attributes as item parameters; one dimension
    per scenario, each item on its own."""
    s = inputs.study(spark, folder)
    names = reshape.label_list(s.items, "scenario")
    k = len(names)
    wide = inputs.scores(spark, folder).groupBy("taker").agg(*[
        F.max(F.when(F.col("scenario") == n, F.col("p"))).alias(c) for n, c in zip(names, vectors.dims("t", k))])
    own = [F.col("scenario") == n for n in names]
    items = s.items.join(inputs.parameters(spark, folder), "item").select(
        F.lit(k).alias("model"), "item",
        *[o.cast("double").alias(c) for o, c in zip(own, vectors.dims("q", k))],
        *[F.when(o, F.col("a")).otherwise(0.0).alias(c) for o, c in zip(own, vectors.dims("a", k))], "d")
    return s, names, irt.Model(items, wide.select(F.lit(k).alias("model"), "*"), k)


STEP_SQL = """
    train AS (SELECT c.taker, c.item, c.y, i.scenario, s.p, q.a, q.d,
                     c.y - 1 / (1 + EXP(-(s.p * q.a - q.d))) AS gap,
                     1 / (2 + EXP(s.p * q.a - q.d) + EXP(q.d - s.p * q.a)) AS bend
              FROM split c JOIN items i ON i.item = c.item JOIN params q ON q.item = c.item
              JOIN scores s ON s.taker = c.taker AND s.scenario = i.scenario WHERE split = 'train'),
    item_sums AS (SELECT item, SUM(gap * p) AS ga, SUM(p * (1 + p) * bend) AS ha, SUM(gap) AS gd,
                         SUM((1 + p) * bend) AS hd FROM train GROUP BY item),
    taker_sums AS (SELECT taker, scenario, SUM(gap * a) AS g, SUM(a * (1 + a) * bend) AS h
                   FROM train GROUP BY taker, scenario)"""


@query("k2_item_step", extra=STEP_SQL, sql="""
    SELECT q.item, round(GREATEST(1e-6, a + GREATEST(-2, LEAST(2, 1.5 *
               (COALESCE(ga, 0) + 0.1 * (1 - a)) / (COALESCE(ha, 0) + 0.1)))), 6) + 0.0 AS a,
           round(d - GREATEST(-2, LEAST(2, 1.5 * (COALESCE(gd, 0) + 0.1 * d) / (COALESCE(hd, 0) + 0.1))), 6) + 0.0 AS d
    FROM params q LEFT JOIN item_sums s ON s.item = q.item""")
def item_step(spark, folder):
    """One step of the alternating fit: all item parameters, abilities fixed."""
    _, _, train = split_study(spark, folder)
    _, _, model = score_model(spark, folder)
    moved = irt.item_step(train, model).items
    total = sum((F.col(c) for c in vectors.dims("a", model.k)), F.lit(0.0))     # one is not 0
    return moved.select("item", fixed(total).alias("a"), fixed(F.col("d")).alias("d"))


@query("k2_taker_step", extra=STEP_SQL, sql="""
    SELECT s.taker, s.scenario AS component,
           round(GREATEST(0, p + GREATEST(-2, LEAST(2, 1.5 * (COALESCE(g, 0) - p) / (COALESCE(h, 0) + 1)))), 6) + 0.0 AS theta
    FROM scores s LEFT JOIN taker_sums t ON t.taker = s.taker AND t.scenario = s.scenario""")
def taker_step(spark, folder):
    """The other step: all abilities, items fixed; a dimension sees its own items only.
    The curvature of a dimension also counts takers' cells elsewhere, with weight 0."""
    _, _, train = split_study(spark, folder)
    _, names, model = score_model(spark, folder)
    return irt.theta_table(irt.taker_step(train, model), names).withColumn("theta", fixed(F.col("theta")))


@query("k9_cross_products", sql="""
    SELECT x.factor AS i, z.factor AS j, round(SUM(x.loading * z.loading), 4) + 0.0 AS g
    FROM loadings x JOIN loadings z ON z.item = x.item GROUP BY x.factor, z.factor""")
def cross_products(spark, folder):
    """The matrix that the regression solves."""
    table = spark.read.parquet(f"{folder}/embeddings.parquet").select(
        F.col("embedding").cast("array<double>").alias("v"))
    width = table.agg(F.max(F.size("v"))).first()[0]
    return (moments.dense_gram(table, width).select("i", F.posexplode("g").alias("j", "g"))
            .withColumn("g", fixed(F.col("g"), 4)))


@query("k8_full_probabilities", sql="""
    SELECT s.taker, i.item, round(1 / (1 + EXP(-(s.p * q.a - q.d))), 6) + 0.0 AS p
    FROM items i JOIN params q ON q.item = i.item JOIN scores s ON s.scenario = i.scenario""")
def full_probabilities(spark, folder):
    """Scenario scores as abilities and part attributes as item parameters, all cells."""
    _, _, model = score_model(spark, folder)
    return irt.full_grid(model).withColumn("p", fixed(F.col("p")))


@query("k9_text_regression_evaluation")
def text_regression(spark, folder):
    s, cells, train = split_study(spark, folder)
    k = 8
    _, items, _ = vectors.truncated_svd(train, s.items, s.takers, k)
    table = spark.read.parquet(f"{folder}/embeddings.parquet").select(
        F.col("vec_id").alias("item"), F.col("embedding").cast("array<double>").alias("embedding"))
    width = table.agg(F.max(F.size("embedding"))).first()[0]
    coefficients = irt.fit_text_regression(table, items, width, k)
    filled = s.items.select("item").join(table, "item", "left").withColumn(
        "embedding", F.coalesce("embedding", F.array_repeat(F.lit(0.0), width)))
    predicted = irt.predict_text_regression(filled, coefficients)
    people = vectors.abilities(train, items, s.takers, k)
    scored = cut_lineage(vectors.cell_scores(cells, people, predicted, k)
                         .withColumn("score", sigmoid(F.col("score"))))
    return stats.auc(scored, groups=["split"]).join(stats.ctt_correlation(scored, ["split"]), "split")


@query("k11_parameter_tables")
def parameter_tables(spark, folder):
    s, _, model = confirmatory(spark, folder, 0.0)
    owner = component_qmatrix(s.items).withColumnRenamed("factor", "component")
    return (irt.item_table(model).join(owner, "item")
            .select("item", "component", F.col("d").alias("difficulty")))

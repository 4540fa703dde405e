"""Ordering, selection and sampling (families G and I)."""

from pyspark.sql import functions as F

from itemspark.catalog import inputs
from itemspark.catalog.aggregate import MASTER_SQL, master
from itemspark.catalog.registry import query
from itemspark.functions.scalars import fixed
from itemspark.operators import choose, ranks, sample, score


@query("g1_extreme_loadings", sql="""
    SELECT factor, side, place, item, loading FROM (
        SELECT *, 'top' AS side, ROW_NUMBER() OVER (PARTITION BY factor ORDER BY loading DESC, item) AS place
        FROM loadings
        UNION ALL
        SELECT *, 'bottom', ROW_NUMBER() OVER (PARTITION BY factor ORDER BY loading, item) FROM loadings)
    WHERE place <= 5""")
def extremes(spark, folder):
    table = inputs.loadings(spark, folder)
    out = None
    for side, key in (("top", F.col("loading").desc()), ("bottom", F.col("loading").asc())):
        order = [key, F.col("item")]
        best = choose.best_in_group(table, ["factor"], order, 5)
        part = ranks.Window.partitionBy("factor").orderBy(*order)
        part = best.select("factor", F.lit(side).alias("side"),
                           F.row_number().over(part).alias("place"), "item", "loading")
        out = part if out is None else out.unionByName(part)
    return out


POOL_SQL = """
    pool AS (SELECT i.item, i.scenario, q.a, p.missing_count FROM named_items i
             JOIN params q ON q.item = i.item JOIN profile p ON p.item = i.item),
    blueprint AS (SELECT * FROM (VALUES
        ('PC2', '', 'legalbench', 200), ('PC3', '', 'air_bench_2024', 300), ('PC3', '', 'thai_exam', 300),
        ('PC4', 'pos', 'thai_exam', 50), ('PC4', 'pos', 'mmlu', 50), ('PC4', 'neg', 'air_bench_2024', 50),
        ('PC5', 'pos', 'mmlu', 15), ('PC5', 'pos', 'air_bench_2024', 15), ('PC5', 'neg', 'thai_exam', 15),
        ('PC6', 'pos', 'med_qa', 40), ('PC6', 'neg', 'legalbench', 40), ('PC7', '', 'mmlu', 5)) v(component, pole, scenario, k)),
    eligible AS (SELECT b.component, b.pole, b.k, p.*, CASE WHEN ROW_NUMBER() OVER (
                    PARTITION BY component, pole, p.scenario ORDER BY missing_count, a DESC, item) <= 10
                    THEN 1 ELSE 0 END AS sure
                 FROM pool p JOIN blueprint b ON b.scenario = p.scenario),
    placed AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY component, pole
                    ORDER BY sure DESC, missing_count, a DESC, item) AS place FROM eligible)"""

BLUEPRINT = [("PC2", "", "legalbench", 200), ("PC3", "", "air_bench_2024", 300),
             ("PC3", "", "thai_exam", 300), ("PC4", "pos", "thai_exam", 50),
             ("PC4", "pos", "mmlu", 50), ("PC4", "neg", "air_bench_2024", 50),
             ("PC5", "pos", "mmlu", 15), ("PC5", "pos", "air_bench_2024", 15),
             ("PC5", "neg", "thai_exam", 15), ("PC6", "pos", "med_qa", 40),
             ("PC6", "neg", "legalbench", 40), ("PC7", "", "mmlu", 5)]


def pool(spark, folder):
    return (inputs.named_items(spark, folder).select("item", "scenario")
            .join(inputs.parameters(spark, folder).select("item", "a"), "item")
            .join(inputs.profile(spark, folder).select("item", "missing_count"), "item"))


def blueprint(spark, rows=None):
    return F.broadcast(spark.createDataFrame(rows or BLUEPRINT,
                                             "component string, pole string, scenario string, k int"))


@query("g2_balanced_items", extra=POOL_SQL, sql="""
    SELECT item, scenario, missing_count, round(a, 6) + 0.0 AS a, sure FROM placed
    WHERE component = 'PC3' AND place <= k""")
def balanced_items(spark, folder):
    rows = [r for r in BLUEPRINT if r[0] == "PC3"]
    chosen = choose.balanced_items(pool(spark, folder), blueprint(spark, rows), 10)
    return chosen.select("item", "scenario", "missing_count", fixed(F.col("a")).alias("a"), "sure")


@query("g3_balanced_by_factor", extra=MASTER_SQL + """,
    quota AS (SELECT primary_factor, 300 // COUNT(*) OVER () +
                     CASE WHEN ROW_NUMBER() OVER (ORDER BY primary_factor) - 1 < 300 % COUNT(*) OVER ()
                          THEN 1 ELSE 0 END AS quota
              FROM (SELECT DISTINCT primary_factor FROM master))""", sql="""
    SELECT m.item, m.primary_factor, CONCAT(m.primary_factor, '_Primary') AS component, m.num_factors,
           m.missing_count, m.max_loading
    FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY primary_factor ORDER BY num_factors DESC,
                    missing_count, max_loading DESC, item) AS place FROM master) m
    JOIN quota q ON q.primary_factor = m.primary_factor WHERE place <= quota""")
def balanced_by_factor(spark, folder):
    return choose.balanced_by_factor(master(spark, folder), 300).select(
        "item", "primary_factor", "component", "num_factors", "missing_count", "max_loading")


@query("g4_blueprint_selection", extra=POOL_SQL, sql="""
    SELECT component, pole, item, scenario, sure FROM placed WHERE place <= k""")
def blueprint_selection(spark, folder):
    chosen = choose.balanced_items(pool(spark, folder), blueprint(spark), 10)
    return chosen.select("component", "pole", "item", "scenario", "sure")


@query("g5_threshold_or_top", sql="""
    SELECT item, factor, loading, size FROM sized
    WHERE size > threshold OR (n_strong = 0 AND place <= 10)""")
def threshold_or_top(spark, folder):
    table = inputs.loadings(spark, folder)
    return choose.strong_or_best(table, choose.adaptive_threshold(table), 10)


@query("g5_fallback_top", sql="""
    SELECT item, factor, loading, size FROM (
        SELECT *, COUNT(*) FILTER (WHERE size > 0.42e0) OVER (PARTITION BY factor) AS m FROM sized)
    WHERE size > 0.42e0 OR (m = 0 AND place <= 3)""")
def fallback_top(spark, folder):
    return choose.strong_or_best(inputs.loadings(spark, folder), F.lit(0.42), 3)


@query("g6_primary_among_candidates", sql="SELECT item, factor, max_loading FROM assigned")
def primary_among(spark, folder):
    from itemspark.operators import skills
    return skills.primary_assignments(inputs.loadings(spark, folder))


@query("g7_ranked_scenarios", sql="""
    SELECT factor, scenario, n, round(mean_loading, 6) + 0.0 AS mean_loading, place
    FROM factor_scenarios WHERE place <= 5""")
def ranked_scenarios(spark, folder):
    from itemspark.operators import skills
    rows = skills.interpretation_rows(inputs.loadings(spark, folder), inputs.named_items(spark, folder))
    ranked = skills.ranked_scenarios(score.factor_profile(rows)).filter("place <= 5")
    return ranked.select("factor", "scenario", "n", fixed(F.col("mean_loading")).alias("mean_loading"),
                         "place")


@query("g11_preview", sql="""
    SELECT item, input_text, scenario, benchmark FROM items ORDER BY item LIMIT 10""")
def preview(spark, folder):
    return inputs.study(spark, folder).items.orderBy("item").limit(10)


@query("g12_head_per_group", sql="""
    SELECT item, scenario FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY scenario ORDER BY item) AS r
                                FROM items) WHERE r <= 3""")
def head_per_group(spark, folder):
    items = inputs.study(spark, folder).items.select("item", "scenario")
    return choose.best_in_group(items, ["scenario"], [F.col("item")], 3)


@query("g13_row_numbers", sql="""
    SELECT taker, item, y, ROW_NUMBER() OVER (ORDER BY item, taker) - 1 AS row FROM responses""")
def row_numbers(spark, folder):
    cells = inputs.study(spark, folder).responses
    numbered = ranks.positions(cells, [F.col("item"), F.col("taker")])
    return numbered.withColumn("row", F.col("position") - 1).drop("position")


@query("g14_sorted_response_rates", sql="""
    SELECT item, round(response_rate, 6) + 0.0 AS response_rate FROM profile ORDER BY response_rate, item""")
def sorted_rates(spark, folder):
    return (inputs.profile(spark, folder).orderBy("response_rate", "item")
            .select("item", fixed(F.col("response_rate")).alias("response_rate")))


@query("i1_undersample", extra="""
    kept AS (SELECT scenario, COUNT(*) AS c FROM items GROUP BY scenario HAVING COUNT(*) >= 330),
    ranked AS (SELECT i.*, ROW_NUMBER() OVER (PARTITION BY scenario
                  ORDER BY MD5(CONCAT(item, '|42')), item) AS place FROM items i
               WHERE scenario IN (SELECT scenario FROM kept)),
    chosen AS (SELECT * FROM ranked WHERE place <= (
                  SELECT CASE WHEN COUNT(*) >= 2 THEN MIN(c) ELSE 0 END FROM kept))""", sql="""
    SELECT r.taker, r.item, r.y, c.scenario FROM responses r JOIN chosen c ON c.item = r.item""")
def undersample(spark, folder):
    s = inputs.study(spark, folder)
    cells, chosen, _ = sample.undersample(s.responses, s.items, s.takers, 330)
    return cells.join(chosen.select("item", "scenario"), "item")


@query("i2_exact_split", extra="""
    ordered AS (SELECT *, ROW_NUMBER() OVER (ORDER BY MD5(CONCAT(taker, '|', item, '|42')), taker, item) AS place,
                       COUNT(*) OVER () AS total FROM responses)""", sql="""
    SELECT taker, item, y, CASE WHEN place <= FLOOR(total * 0.2e0) THEN 'test' ELSE 'train' END AS split
    FROM ordered""")
def exact_split(spark, folder):
    return sample.exact_split(inputs.study(spark, folder).responses)


DRAW_SQL = "SUBSTR(MD5(CONCAT(taker, '|', item, '|', seed)), 1, 8) < 'cccccccc'"


def draws(need_test, cells="responses", columns="items"):
    """Check SQL for the redrawn split: the first seed whose counts are all positive."""
    wanted = "'train', 'test'" if need_test else "'train'"
    return f"""
    tries AS (SELECT UNNEST(generate_series(42, 44)) AS seed),
    drawn AS (SELECT *, CASE WHEN {DRAW_SQL} THEN 'train' ELSE 'test' END AS part
              FROM {cells} CROSS JOIN tries),
    gaps AS (SELECT seed, part, COUNT(DISTINCT taker) AS nt, COUNT(DISTINCT item) AS ni
             FROM drawn GROUP BY seed, part),
    good AS (SELECT MIN(seed) AS seed FROM (SELECT seed FROM gaps CROSS JOIN n
             WHERE part IN ({wanted}) AND nt = n_takers AND ni = (SELECT COUNT(*) FROM {columns})
             GROUP BY seed HAVING COUNT(*) = {2 if need_test else 1}))"""


@query("i3_covering_split", extra=draws(False), sql="""
    SELECT taker, item, y, part AS split, CAST(seed AS INTEGER) AS seed FROM drawn
    WHERE seed = (SELECT seed FROM good)""")
def covering_split(spark, folder):
    s = inputs.study(spark, folder)
    cells, seed = sample.valid_split(s.responses, s.items, s.takers)
    return cells.withColumn("seed", F.lit(seed))


SIZE_CELLS = """
    cells AS (SELECT r.taker, CAST(q.d * 25 AS BIGINT) AS item, MAX(r.y) AS y FROM responses r
              JOIN params q ON q.item = r.item GROUP BY 1, 2),
    columns AS (SELECT DISTINCT CAST(d * 25 AS BIGINT) AS item FROM params)"""


@query("i4_covering_split_both", extra=SIZE_CELLS + "," + draws(True, "cells", "columns"), sql="""
    SELECT taker, item, y, part AS split, CAST(seed AS INTEGER) AS seed FROM drawn
    WHERE seed = (SELECT seed FROM good)""")
def covering_split_both(spark, folder):
    """Cells of takers by part size (dense), so that test can cover every row and column."""
    s = inputs.study(spark, folder)
    sizes = inputs.parameters(spark, folder).select(
        "item", F.round(F.col("d") * 25).cast("bigint").alias("size"))
    cells = (s.responses.join(sizes, "item").groupBy("taker", F.col("size").alias("item"))
             .agg(F.max("y").alias("y")))
    columns = sizes.select(F.col("size").alias("item")).distinct()
    split, seed = sample.valid_split(cells, columns, s.takers, need_test=True, max_tries=20)
    return split.withColumn("seed", F.lit(seed))


STRATIFIED_SQL = """
    strata AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY scenario ORDER BY MD5(CONCAT(item, '|42')), item) AS place,
                      1000 // (SELECT COUNT(DISTINCT scenario) FROM items) AS quota FROM items),
    rest AS (SELECT *, ROW_NUMBER() OVER (ORDER BY MD5(CONCAT(item, '|42')), item) AS r
             FROM strata WHERE place > quota)"""


@query("i5_stratified_items", extra=STRATIFIED_SQL, sql="""
    SELECT item, scenario FROM strata WHERE place <= quota
    UNION ALL SELECT item, scenario FROM rest
    WHERE r <= 1000 - (SELECT COUNT(*) FROM strata WHERE place <= quota)""")
def stratified(spark, folder):
    items = inputs.study(spark, folder).items
    return sample.stratified_items(items, 1000).select("item", "scenario")


@query("i6_random_items", sql="""
    SELECT item FROM items ORDER BY MD5(CONCAT(item, '|42')), item LIMIT 1000""")
def random_items(spark, folder):
    return sample.random_items(inputs.study(spark, folder).items.select("item"), 1000)

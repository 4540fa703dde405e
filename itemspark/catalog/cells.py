"""Filters and missing values (families C and D)."""

from pyspark.sql import functions as F

from itemspark.catalog import inputs
from itemspark.catalog.registry import query
from itemspark.functions.scalars import (adequacy_band, finite_or_null, finite_or_zero, fixed,
                                         loading_band)
from itemspark.operators import choose, clean, reshape, sample, score


@query("c1_membership_filter", sql="""
    SELECT item, scenario FROM items WHERE scenario IN ('ECONOMY', 'SMALL') OR benchmark = 'Brand#2'""")
def membership(spark, folder):
    items = inputs.study(spark, folder).items
    return items.filter(F.col("scenario").isin("ECONOMY", "SMALL")
                        | (F.col("benchmark") == "Brand#2")).select("item", "scenario")


@query("c2_negated_membership", sql="""
    SELECT item, scenario FROM items WHERE item NOT IN (SELECT item FROM loadings)""")
def negated(spark, folder):
    chosen = inputs.loadings(spark, folder).select("item")
    return (inputs.study(spark, folder).items.join(chosen, "item", "left_anti")
            .select("item", "scenario"))


@query("c3_loading_at_least", sql="""
    SELECT item, factor, loading, t AS threshold FROM loadings
    CROSS JOIN (VALUES (0.4e0), (0.3e0), (0.01e0)) v(t) WHERE ABS(loading) >= t""")
def at_least(spark, folder):
    table = inputs.loadings(spark, folder)
    bounds = F.array(F.lit(0.4), F.lit(0.3), F.lit(0.01))
    return (table.withColumn("threshold", F.explode(bounds))
            .filter(F.abs("loading") >= F.col("threshold")))


@query("c4_loading_above", sql="SELECT * FROM loadings WHERE ABS(loading) > 0.2e0")
def above(spark, folder):
    return inputs.loadings(spark, folder).filter(F.abs("loading") > 0.2)


@query("c5_adaptive_threshold", sql="""
    SELECT item, factor, loading, round(threshold, 6) + 0.0 AS threshold
    FROM loadings CROSS JOIN bar WHERE ABS(loading) > threshold""")
def adaptive(spark, folder):
    table = inputs.loadings(spark, folder)
    bar = choose.adaptive_threshold(table)
    return table.filter(F.abs("loading") > bar).withColumn("threshold", fixed(bar))


RATIO_SQL = """
    ratios AS (SELECT item, CASE WHEN asked = correct AND correct > 0 THEN CAST('inf' AS DOUBLE)
                                 WHEN asked = correct THEN NULL
                                 ELSE correct / CAST(asked - correct AS DOUBLE) END AS odds
               FROM profile)"""


def odds(spark, folder):
    """Right to wrong ratio: infinite when nothing was wrong."""
    wrong = F.col("asked") - F.col("correct")
    ratio = (F.when(wrong > 0, F.col("correct") / F.nullif(wrong, F.lit(0)))
             .when(F.col("correct") > 0, F.lit(float("inf"))))
    return inputs.profile(spark, folder).select("item", ratio.alias("odds"))


@query("c6_infinity_replacement", extra=RATIO_SQL, sql="""
    SELECT item, round(CASE WHEN isinf(odds) THEN NULL ELSE odds END, 6) + 0.0 AS as_missing,
           round(CASE WHEN odds IS NULL OR isinf(odds) THEN 0 ELSE odds END, 6) + 0.0 AS as_zero
    FROM ratios""")
def infinity(spark, folder):
    return odds(spark, folder).select(
        "item", fixed(finite_or_null(F.col("odds"))).alias("as_missing"),
        fixed(finite_or_zero(F.col("odds"))).alias("as_zero"))


@query("c7_null_predicates", extra=RATIO_SQL, sql="""
    SELECT item, odds IS NULL AS is_missing, COALESCE(isfinite(odds), FALSE) AS is_finite FROM ratios""")
def null_predicates(spark, folder):
    return odds(spark, folder).select(
        "item", F.col("odds").isNull().alias("is_missing"),
        finite_or_null(F.col("odds")).isNotNull().alias("is_finite"))


@query("c8_large_scenarios", sql="""
    SELECT item, scenario FROM items WHERE scenario IN (
        SELECT scenario FROM items GROUP BY scenario HAVING COUNT(*) >= 330)""")
def large_scenarios(spark, folder):
    return (clean.keep_large_groups(inputs.study(spark, folder).items, 330)
            .select("item", "scenario"))


@query("c9_low_response_items", sql="""
    SELECT item, round(response_rate, 6) + 0.0 AS response_rate FROM profile
    WHERE response_rate >= 0.1""")
def low_response(spark, folder):
    return clean.drop_low_response(inputs.profile(spark, folder)).select(
        "item", fixed(F.col("response_rate")).alias("response_rate"))


@query("c10_constant_items", sql="""
    SELECT item, round((correct - correct * correct / CAST(n_takers AS DOUBLE)) / (n_takers - 1), 6)
                 + 0.0 AS variance
    FROM profile CROSS JOIN n WHERE correct > 0 AND correct < n_takers""")
def constant_items(spark, folder):
    n = score.taker_count(inputs.study(spark, folder).takers)
    kept = clean.drop_constant_items(inputs.profile(spark, folder), n)
    return clean.zero_filled_variance(kept, n).select("item", fixed(F.col("variance"))
                                                      .alias("variance"))


@query("c10_constant_scenarios", sql="""
    SELECT taker, scenario, round(p, 6) + 0.0 AS p FROM scores WHERE scenario IN (
        SELECT scenario FROM scores GROUP BY scenario HAVING MIN(p) < MAX(p))""")
def constant_scenarios(spark, folder):
    return (clean.drop_constant_columns(inputs.scores(spark, folder), "scenario", "p")
            .withColumn("p", fixed(F.col("p"))))


def pair_cells(spark, folder):
    """Takers by (scenario, benchmark) means on the full grid; null where nothing was asked."""
    s = inputs.study(spark, folder)
    label = F.concat_ws("_", "scenario", "benchmark").alias("pair")
    grid = score.level_grid(s.takers, s.items.select("item", label), "pair").drop("n_items")
    seen = score.observed_means(s.responses, s.items, "scenario", "benchmark").select(
        "taker", label, "p")
    return grid.join(seen, ["taker", "pair"], "left")


PAIR_SQL = """
    pair_cells AS (
        SELECT t.taker, k.scenario || '_' || k.benchmark AS pair, o.p
        FROM takers t CROSS JOIN (SELECT DISTINCT scenario, benchmark FROM items) k
        LEFT JOIN observed o ON o.taker = t.taker AND o.scenario = k.scenario
                            AND o.benchmark = k.benchmark)"""


@query("c11_drop_columns_with_null", extra=PAIR_SQL, sql="""
    SELECT taker, pair, round(p, 6) + 0.0 AS p FROM pair_cells WHERE pair NOT IN (
        SELECT pair FROM pair_cells WHERE p IS NULL)""")
def drop_with_null(spark, folder):
    return (clean.drop_columns_with_null(pair_cells(spark, folder), "pair", "p")
            .withColumn("p", fixed(F.col("p"))))


@query("c12_all_null_columns", extra=PAIR_SQL, sql="""
    SELECT pair, COUNT(*) AS n, COUNT(*) - COUNT(p) AS n_null, COUNT(p) = 0 AS all_null
    FROM pair_cells GROUP BY pair""")
def all_null(spark, folder):
    return clean.column_missing(pair_cells(spark, folder), "pair", "p")


@query("c13_takers_without_answers", sql="""
    SELECT taker, TRUE AS kept FROM takers WHERE taker IN (
        SELECT r.taker FROM responses r JOIN items i ON i.item = r.item WHERE i.benchmark = 'Brand#2')
    UNION ALL
    SELECT taker, FALSE FROM takers WHERE taker NOT IN (
        SELECT r.taker FROM responses r JOIN items i ON i.item = r.item WHERE i.benchmark = 'Brand#2')""")
def takers_without(spark, folder):
    s = inputs.study(spark, folder)
    chosen = s.items.filter(F.col("benchmark") == "Brand#2").select("item")
    cells = s.responses.join(chosen, "item", "left_semi")
    kept = clean.takers_with_answers(s.takers, cells).select("taker", F.lit(True).alias("kept"))
    gone = clean.takers_without_answers(s.takers, cells).select("taker", F.lit(False).alias("kept"))
    return kept.unionByName(gone)


@query("c15_scorable_groups", sql="""
    SELECT i.scenario, COUNT(*) AS n FROM split c JOIN items i ON i.item = c.item
    WHERE split = 'test' GROUP BY i.scenario HAVING COUNT(*) >= 10 AND MIN(y) < MAX(y)""")
def scorable(spark, folder):
    s = inputs.study(spark, folder)
    test = sample.bernoulli_split(s.responses).filter(F.col("split") == "test")
    return clean.scorable_groups(score.with_items(test, s.items, "scenario"), "scenario")


@query("c16_loading_bands", sql="""
    SELECT item, factor, CASE WHEN ABS(loading) >= 0.3e0 THEN 'high'
                              WHEN ABS(loading) < 0.2e0 THEN 'low' ELSE 'middle' END AS band
    FROM loadings""")
def bands(spark, folder):
    return inputs.loadings(spark, folder).select("item", "factor",
                                                 loading_band(F.col("loading")).alias("band"))


@query("c17_adequacy_bands", sql="""
    SELECT taker, scenario, CASE WHEN p >= 0.9e0 THEN 'Marvelous' WHEN p >= 0.8e0 THEN 'Meritorious'
        WHEN p >= 0.7e0 THEN 'Middling' WHEN p >= 0.6e0 THEN 'Mediocre'
        WHEN p >= 0.5e0 THEN 'Miserable' ELSE 'Unacceptable' END AS band
    FROM scores""")
def adequacy(spark, folder):
    return inputs.scores(spark, folder).select("taker", "scenario",
                                               adequacy_band(F.col("p")).alias("band"))


@query("c19_scorable_components", sql="""
    SELECT benchmark AS component, COUNT(*) AS n_items FROM items GROUP BY benchmark
    HAVING COUNT(*) >= 2 AND (SELECT n_takers FROM n) >= 2""")
def scorable_components(spark, folder):
    s = inputs.study(spark, folder)
    return clean.scorable_components(s.items.select(F.col("benchmark").alias("component")),
                                     score.taker_count(s.takers))


@query("c20_split_subset", sql="SELECT taker, item, y FROM split WHERE split = 'train'")
def split_subset(spark, folder):
    cells = sample.bernoulli_split(inputs.study(spark, folder).responses)
    return cells.filter(F.col("split") == "train").select("taker", "item", "y")


def filled(strategy):
    """Nine digits: column means often end in a 5 at the seventh, where the order of a
    floating-point sum would decide the rounding."""
    def run(spark, folder):
        return (clean.fill_missing(pair_cells(spark, folder), "pair", "p", strategy)
                .withColumn("p", fixed(F.col("p"), 9)))
    return run


query("d1_fill_zero", extra=PAIR_SQL, sql="""
    SELECT taker, pair, round(COALESCE(p, 0), 9) + 0.0 AS p FROM pair_cells""")(filled("zero"))
query("d2_fill_mean", extra=PAIR_SQL, sql="""
    SELECT taker, pair, round(COALESCE(p, AVG(p) OVER (PARTITION BY pair)), 9) + 0.0 AS p
    FROM pair_cells""")(filled("mean"))
query("d3_fill_median", extra=PAIR_SQL, sql="""
    SELECT taker, c.pair, round(COALESCE(p, m), 9) + 0.0 AS p FROM pair_cells c
    JOIN (SELECT pair, QUANTILE_CONT(p, 0.5) AS m FROM pair_cells GROUP BY pair) f
      ON f.pair = c.pair""")(filled("median"))


@query("d4_strategy_switch", extra=PAIR_SQL, sql="""
    SELECT s AS strategy, COUNT(*) AS n, round(SUM(v), 4) + 0.0 AS total FROM (
        SELECT 'zero' AS s, COALESCE(p, 0) AS v FROM pair_cells
        UNION ALL SELECT 'mean', COALESCE(p, AVG(p) OVER (PARTITION BY pair)) FROM pair_cells
        UNION ALL SELECT 'median', COALESCE(p, m) FROM pair_cells c
            JOIN (SELECT pair, QUANTILE_CONT(p, 0.5) AS m FROM pair_cells GROUP BY pair) f
              ON f.pair = c.pair
        UNION ALL SELECT 'drop', p FROM pair_cells WHERE pair NOT IN (
            SELECT pair FROM pair_cells WHERE p IS NULL)) GROUP BY s""")
def strategies(spark, folder):
    cells = pair_cells(spark, folder)
    out = None
    for name in ("zero", "mean", "median", "drop"):
        part = clean.fill_missing(cells, "pair", "p", name).select(
            F.lit(name).alias("strategy"), "p")
        out = part if out is None else out.unionByName(part)
    return out.groupBy("strategy").agg(F.count(F.lit(1)).alias("n"),
                                       fixed(F.sum("p"), 4).alias("total"))


@query("d5_missing_encodings", sql="""
    SELECT i.item, STRING_AGG(CASE WHEN r.y IS NULL THEN '0' ELSE '1' END, ',' ORDER BY t.taker) AS present,
           STRING_AGG(CAST(COALESCE(r.y, -1) AS VARCHAR), ',' ORDER BY t.taker) AS minus_one,
           STRING_AGG(CAST(COALESCE(r.y, 0) AS VARCHAR), ',' ORDER BY t.taker) AS zero
    FROM items i CROSS JOIN takers t
    LEFT JOIN responses r ON r.item = i.item AND r.taker = t.taker GROUP BY i.item""")
def encodings(spark, folder):
    s = inputs.study(spark, folder)
    rows = reshape.dense_rows(s.responses, s.items, s.takers)
    parts = F.array_sort(F.collect_list(F.struct("block", "present", "minus_one", "zero")))
    joined = rows.groupBy("item").agg(parts.alias("b"))     # a few blocks per item
    return joined.select("item", *[F.array_join(F.flatten(f"b.{c}"), ",").alias(c)
                                   for c in ("present", "minus_one", "zero")])

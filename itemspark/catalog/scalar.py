"""Scalar functions (family M) on whole tables."""

from pyspark.sql import functions as F

from itemspark.catalog import inputs
from itemspark.catalog.registry import query
from itemspark.functions.scalars import fixed, log_likelihood, sigmoid, title_words


@query("m_numeric_functions", sql="""
    SELECT item, factor, round(1 / (1 + EXP(-loading)), 6) + 0.0 AS sigmoid,
           round(LN(1 / (1 + EXP(-loading))), 6) + 0.0 AS log_p, round(GREATEST(loading, 1e-6), 6) + 0.0 AS clamped,
           round(POW(loading, 2), 6) + 0.0 AS squared, item // 7 AS quotient, item % 7 AS remainder,
           round_even(loading, 3) + 0.0 AS half_even, GREATEST(ABS(loading), 0.1e0) AS floor,
           CAST(TRUNC(loading * 100) AS BIGINT) AS whole
    FROM loadings""")
def numeric(spark, folder):
    x = F.col("loading")
    return inputs.loadings(spark, folder).select(
        "item", "factor", fixed(sigmoid(x)).alias("sigmoid"),
        fixed(log_likelihood(F.lit(1), sigmoid(x))).alias("log_p"),
        fixed(F.greatest(x, F.lit(1e-6))).alias("clamped"), fixed(F.pow(x, 2)).alias("squared"),
        F.expr("item div 7").alias("quotient"), (F.col("item") % 7).alias("remainder"),
        (F.bround(x, 3) + 0.0).alias("half_even"), F.greatest(F.abs(x), F.lit(0.1)).alias("floor"),
        (x * 100).cast("bigint").alias("whole"))


@query("m_text_functions", sql="""
    SELECT i.item, REPLACE(i.input_text, ' ', '_') AS underscored, LOWER(benchmark) AS lower, t.title,
           CONTAINS(i.scenario, 'legal') AS has_legal, STARTS_WITH(benchmark, 'Brand#1') AS starts,
           SPLIT_PART(benchmark, '#', 2) AS part, SUBSTR(i.input_text, 1, 5) AS head,
           FORMAT('{:.3f}', i.item / 8e0) AS shown, printf('%.1f%%', i.item / 7e0) AS percent,
           FORMAT('{:,}', i.item * 1000) AS thousands
    FROM named_items i JOIN titles t ON t.scenario = i.scenario""")
def text(spark, folder):
    return inputs.named_items(spark, folder).select(
        "item", F.replace("input_text", F.lit(" "), F.lit("_")).alias("underscored"),
        F.lower("benchmark").alias("lower"), title_words(F.col("scenario")).alias("title"),
        F.contains("scenario", F.lit("legal")).alias("has_legal"),
        F.startswith("benchmark", F.lit("Brand#1")).alias("starts"),
        F.split_part("benchmark", F.lit("#"), F.lit(2)).alias("part"),
        F.substring("input_text", 1, 5).alias("head"),
        F.format_string("%.3f", F.col("item") / 8).alias("shown"),
        F.format_string("%.1f%%", F.col("item") / 7).alias("percent"),
        F.format_string("%,d", F.col("item") * 1000).alias("thousands"))


@query("m_array_functions", sql="""
    SELECT vec_id, LEN(embedding) AS size, LIST_CONTAINS(embedding, embedding[3]) AS has_third,
           LIST_POSITION(embedding, LIST_MAX(embedding)) - 1 AS largest_at,
           round(LIST_SUM(LIST_TRANSFORM(embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE))), 6) + 0.0 AS dot,
           COALESCE(MAP {0: 'a', 1: 'b', 2: 'c'}[label], 'other') AS looked_up
    FROM embeddings""")
def array(spark, folder):
    vectors = spark.read.parquet(f"{folder}/embeddings.parquet")
    e = F.col("embedding")
    product = F.aggregate(F.zip_with(e.cast("array<double>"), e.cast("array<double>"), lambda a, b: a * b),
                          F.lit(0.0), lambda s, x: s + x)
    names = F.create_map(F.lit(0), F.lit("a"), F.lit(1), F.lit("b"), F.lit(2), F.lit("c"))
    return vectors.select(
        "vec_id", F.size(e).alias("size"), F.array_contains(e, e[2]).alias("has_third"),
        (F.array_position(e, F.array_max(e)) - 1).alias("largest_at"), fixed(product).alias("dot"),
        F.coalesce(F.try_element_at(names, F.col("label")), F.lit("other")).alias("looked_up"))

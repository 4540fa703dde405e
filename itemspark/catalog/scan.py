"""Sources and sinks (family A): scans, and writes that are read back."""

from pyspark.sql import functions as F

from itemspark.catalog import inputs
from itemspark.catalog.registry import query
from itemspark.functions.scalars import fixed
from itemspark.operators import qmatrix, ranks, sample, score
from itemspark.schema import ITEMS
from itemspark.session import staging_path
from itemspark.sources import readers, writers


@query("a1_scan_responses", sql="SELECT taker, item, y FROM responses")
def scan_responses(spark, folder):
    """The response table written once in stored form and scanned with its schema."""
    path = staging_path(spark, "responses")
    writers.write_cells(inputs.study(spark, folder).responses, path, by=None)
    return readers.read_responses(spark, path)


@query("a2_scan_csv", sql="SELECT item, input_text, scenario, benchmark FROM items")
def scan_csv(spark, folder):
    path = staging_path(spark, "items_csv")
    writers.write_csv(inputs.study(spark, folder).items.select(*ITEMS.names), path)
    return readers.read_csv(spark, path, ITEMS)


@query("a3_scan_value_column", sql="""
    SELECT ROW_NUMBER() OVER (ORDER BY item) - 1 AS item, a FROM params""")
def scan_value_column(spark, folder):
    path = staging_path(spark, "a_params")
    table = inputs.parameters(spark, folder).orderBy("item").select("a")
    writers.write_csv(table, path, header=False)
    return readers.read_value_column(spark, path, "a")


@query("a4_scan_indexed_csv", sql="SELECT item, primary_factor, num_factors FROM meta")
def scan_indexed_csv(spark, folder):
    path = staging_path(spark, "q_matrix")
    table = qmatrix.metadata(inputs.loadings(spark, folder))
    writers.write_csv(table.select("item", "primary_factor", "num_factors"), path)
    return readers.read_csv(spark, path, "item bigint, primary_factor string, num_factors bigint")


@query("a5_scan_embeddings", sql="""
    SELECT vec_id, LEN(embedding) AS width, round(CAST(embedding[1] AS DOUBLE), 6) + 0.0 AS head,
           round(LIST_SUM(LIST_TRANSFORM(embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE))), 6) + 0.0 AS norm
    FROM embeddings""")
def scan_embeddings(spark, folder):
    table = readers.read_embeddings(spark, f"{folder}/embeddings.parquet", "vec_id")
    norm = F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x * x)
    return table.select("vec_id", F.size("embedding").alias("width"),
                        fixed(F.col("embedding")[0]).alias("head"), fixed(norm).alias("norm"))


@query("a6_scan_array_table", sql="""
    SELECT item AS row, CAST(factor AS INTEGER) AS col, CAST(member AS DOUBLE) AS value FROM members""")
def scan_array_table(spark, folder):
    path = staging_path(spark, "membership")
    table = inputs.members(spark, folder).select(
        F.col("item").alias("row"), F.col("factor").cast("int").alias("col"),
        F.col("member").cast("double").alias("value"))
    writers.write_table(table, path)
    return readers.read_array_table(spark, path)


@query("a7_scan_number_matrix", extra="""
    placed AS (SELECT *, DENSE_RANK() OVER (ORDER BY taker) - 1 AS i,
                      CAST(DENSE_RANK() OVER (ORDER BY scenario) - 1 AS INTEGER) AS dim FROM scores)""", sql="""
    SELECT i AS taker, dim, round(p, 6) + 0.0 AS value FROM placed""")
def scan_number_matrix(spark, folder):
    path = staging_path(spark, "thetas")
    scores = inputs.scores(spark, folder)
    width = scores.select("scenario").distinct().count()
    writers.write_numbers(scores, "p", [F.col("taker"), F.col("scenario")], path)
    return readers.read_number_matrix(spark, path, width).withColumn("value", fixed(F.col("value")))


@query("a8_write_csv", sql="""
    SELECT COUNT(*) AS n_rows, COUNT(DISTINCT taker) AS n_taker, COUNT(DISTINCT scenario) AS n_scenario,
           0 AS n_null, round(SUM(p), 4) + 0.0 AS total FROM scores""")
def write_csv(spark, folder):
    path = staging_path(spark, "scenario_scores")
    writers.write_csv(inputs.scores(spark, folder), path)
    back = readers.read_csv(spark, path, "taker bigint, scenario string, p double")
    return writers.verify(back, ["taker", "scenario"], "p").withColumn("total", fixed(F.col("total"), 4))


@query("a9_write_matrix", sql="""
    SELECT scenario, COUNT(*) AS n, CAST(SUM(y) AS BIGINT) AS correct FROM responses r
    JOIN items i ON i.item = r.item WHERE scenario IN ('ECONOMY', 'PROMO') GROUP BY scenario""")
def write_matrix(spark, folder):
    """Written by scenario; the filter reads two of the folders."""
    s = inputs.study(spark, folder)
    path = staging_path(spark, "matrix")
    writers.write_cells(score.with_items(s.responses, s.items, "scenario"), path)
    return (spark.read.parquet(path).filter(F.col("scenario").isin("ECONOMY", "PROMO"))
            .groupBy("scenario").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("correct")))


@query("a10_write_numbers", sql="""
    SELECT CAST(ROW_NUMBER() OVER (ORDER BY taker, scenario) - 1 AS BIGINT) AS position,
           round(p, 6) + 0.0 AS value FROM scores""")
def write_numbers(spark, folder):
    path = staging_path(spark, "numbers")
    writers.write_numbers(inputs.scores(spark, folder), "p", [F.col("taker"), F.col("scenario")], path)
    return readers.numbered_lines(spark.read.text(path)).select(
        "position", fixed(F.col("value").cast("double")).alias("value"))


@query("a11_write_json", sql="""
    SELECT scenario, COUNT(*) AS n, round(AVG(p), 6) + 0.0 AS mean FROM scores GROUP BY scenario""")
def write_json(spark, folder):
    path = staging_path(spark, "summary")
    table = inputs.scores(spark, folder).groupBy("scenario").agg(
        F.count(F.lit(1)).alias("n"), fixed(F.avg("p")).alias("mean"))
    writers.write_json(table, path)
    return spark.read.schema("scenario string, n bigint, mean double").json(path)


@query("a12_persist_split", sql="SELECT taker, item, y, split FROM split")
def persist_split(spark, folder):
    """A split is stored with the model, so evaluation reads the very same cells."""
    path = staging_path(spark, "split")
    writers.write_cells(sample.bernoulli_split(inputs.study(spark, folder).responses), path, by="split")
    return spark.read.schema("taker bigint, item bigint, y tinyint, split string").parquet(path)


@query("a14_read_back", extra="""
    placed AS (SELECT item, ROW_NUMBER() OVER (ORDER BY item) AS position FROM items)""", sql="""
    SELECT COUNT(*) AS n_rows, COUNT(DISTINCT item) AS n_item, COUNT(DISTINCT position) AS n_position,
           0 AS n_null, CAST(SUM(position) AS BIGINT) AS total FROM placed""")
def read_back(spark, folder):
    path = staging_path(spark, "selection")
    table = ranks.positions(inputs.study(spark, folder).items.select("item"), [F.col("item")])
    writers.write_csv(table, path)
    back = readers.read_csv(spark, path, "item bigint, position bigint")
    writers.expect(back, table)
    return writers.verify(back, ["item", "position"], "position")

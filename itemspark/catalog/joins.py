"""Joins and set operations (families E and H)."""

from pyspark.sql import functions as F

from itemspark.catalog import inputs
from itemspark.catalog.registry import query
from itemspark.functions.scalars import fixed, sigmoid
from itemspark.operators import choose, qmatrix, reshape, sample, score


@query("e1_combine_on_taker", sql="""
    SELECT s.taker, s.scenario, round(s.p, 6) + 0.0 AS p, m.correct, m.incorrect FROM scores s
    JOIN (SELECT taker, CAST(SUM(y) AS BIGINT) AS correct, CAST(SUM(1 - y) AS BIGINT) AS incorrect
          FROM responses GROUP BY taker) m ON m.taker = s.taker""")
def combine(spark, folder):
    s = inputs.study(spark, folder)
    return (inputs.scores(spark, folder).withColumn("p", fixed(F.col("p")))
            .join(score.counts_per_taker(s.responses, s.takers), "taker"))


@query("e2_lookup_default", sql="""
    SELECT d.doc_id, COALESCE(l.source, 'unknown') AS scenario FROM documents d
    LEFT JOIN (SELECT text, ARG_MIN(source, doc_id) AS source FROM documents WHERE lang = 'en' GROUP BY text) l
      ON l.text = d.text
    UNION ALL
    SELECT -1 - i.item, l.scenario FROM items i
    JOIN (SELECT input_text, ARG_MIN(scenario, item) AS scenario FROM items GROUP BY input_text) l
      ON l.input_text = i.input_text""")
def lookup_default(spark, folder):
    """Whole texts: the source of the first English copy of a document, and the scenario
    of the first item with an item's text."""
    items = inputs.study(spark, folder).items
    docs = spark.read.parquet(f"{folder}/documents.parquet").select(
        "doc_id", "lang", F.col("text").alias("input_text"), F.col("source").alias("scenario"))
    own = items.select((-1 - F.col("item")).alias("doc_id"), "input_text")
    parts = [reshape.lookup_first(docs.select("doc_id", "input_text"), docs.where("lang = 'en'"),
                                  "input_text", "scenario", "doc_id", "unknown"),
             reshape.lookup_first(own, items, "input_text", "scenario", "item", "unknown")]
    return parts[0].select("doc_id", "scenario").unionByName(parts[1].select("doc_id", "scenario"))


def squares(vector):
    return F.aggregate(vector, F.lit(0.0), lambda s, x: s + x * x)


def text_vectors(spark, folder):
    """Texts with a vector each, duplicates included: item texts and their vectors."""
    vectors = spark.read.parquet(f"{folder}/embeddings.parquet")
    items = inputs.study(spark, folder).items
    return items.join(vectors, items["item"] == vectors["vec_id"]).select(
        "input_text", "item", F.col("embedding").cast("array<double>").alias("embedding"))


TEXT_SQL = """
    by_text AS (SELECT input_text, ARG_MAX(embedding, item) AS embedding, MAX(item) AS source
                FROM items JOIN embeddings ON vec_id = item GROUP BY input_text)"""


@query("e3_text_vectors", extra=TEXT_SQL, sql="""
    SELECT i.item, t.source, round(list_sum(list_transform(t.embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE))), 6) + 0.0 AS squares
    FROM items i LEFT JOIN by_text t ON t.input_text = i.input_text""")
def vectors_by_text(spark, folder):
    table = text_vectors(spark, folder).withColumn("pair", F.struct("item", "embedding"))
    once = reshape.lookup_last(table, "input_text", "pair", "item")
    return (inputs.study(spark, folder).items.join(once, "input_text", "left")
            .select("item", F.col("pair.item").alias("source"),
                    fixed(squares(F.col("pair.embedding"))).alias("squares")))


@query("d7_missing_vectors", sql="""
    SELECT i.item, COALESCE(LEN(e.embedding), 64) AS width,
           round(COALESCE(list_sum(list_transform(e.embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE))), 0), 6) + 0.0 AS squares, e.vec_id IS NULL AS absent
    FROM items i LEFT JOIN embeddings e ON e.vec_id = i.item""")
def missing_vectors(spark, folder):
    vectors = spark.read.parquet(f"{folder}/embeddings.parquet").select(
        F.col("vec_id").alias("item"), F.col("embedding").cast("array<double>").alias("v"))
    width = vectors.agg(F.max(F.size("v"))).scalar()
    filled = F.coalesce("v", F.array_repeat(F.lit(0.0), width))
    return (inputs.study(spark, folder).items.select("item").join(vectors, "item", "left")
            .select("item", F.size(filled).alias("width"), fixed(F.coalesce(squares(F.col("v")), F.lit(0.0))).alias("squares"),
                    F.col("v").isNull().alias("absent")))


@query("e4_code_lookup", extra="""
    codes AS (SELECT scenario, benchmark, ROW_NUMBER() OVER (ORDER BY MIN(item)) - 1 AS code
              FROM items GROUP BY scenario, benchmark)""", sql="""
    SELECT i.item, c.code FROM items i
    JOIN codes c ON c.scenario = i.scenario AND c.benchmark = i.benchmark""")
def code_lookup(spark, folder):
    items = inputs.study(spark, folder).items
    return qmatrix.coded(items, qmatrix.scenario_codes(items)).select("item", "code")


@query("e5_semi_join", sql="""
    SELECT taker, item, y FROM responses WHERE item IN (
        SELECT item FROM items WHERE scenario IN (
            SELECT scenario FROM items GROUP BY scenario HAVING COUNT(*) >= 330))""")
def semi(spark, folder):
    s = inputs.study(spark, folder)
    from itemspark.operators.clean import keep_large_groups
    return s.responses.join(keep_large_groups(s.items, 330).select("item"), "item", "left_semi")


@query("e6_anti_join", sql="""
    SELECT taker, item, y FROM responses WHERE item NOT IN (SELECT vec_id FROM embeddings)""")
def anti(spark, folder):
    vectors = spark.read.parquet(f"{folder}/embeddings.parquet").select(F.col("vec_id").alias("item"))
    return inputs.study(spark, folder).responses.join(vectors, "item", "left_anti")


SELECTION_SQL = """
    selection AS (SELECT ROW_NUMBER() OVER (ORDER BY component, item) - 1 AS position, item, component
                  FROM (SELECT item, scenario AS component FROM named_items
                        UNION ALL SELECT item, 'vector' FROM items
                        WHERE item IN (SELECT vec_id FROM embeddings)))"""


def selection(spark, folder):
    """Every item under its scenario, and again as 'vector' when it has one."""
    items = inputs.named_items(spark, folder)
    first = items.select("item", F.col("scenario").alias("component"))
    second = (items.join(inputs.loadings(spark, folder), "item", "left_semi")
              .select("item", F.lit("vector").alias("component")))
    return reshape.selection_positions(first.unionByName(second).withColumn("pole", F.lit("")))


@query("e7_gather_selection", extra=SELECTION_SQL, sql="""
    SELECT r.taker, s.position, s.item, s.component, r.y
    FROM responses r JOIN selection s ON s.item = r.item""")
def gather(spark, folder):
    return reshape.gather(inputs.study(spark, folder).responses, selection(spark, folder))


@query("e8_taker_item_grid", sql="""
    SELECT i.item, COUNT(*) AS n, round(SUM(1 / (1 + EXP(-(s.p * q.a - q.d)))), 4) + 0.0 AS expected
    FROM items i JOIN params q ON q.item = i.item JOIN scores s ON s.scenario = i.scenario
    GROUP BY i.item""")
def grid(spark, folder):
    """Expected right answers per item over *all* takers, asked or not."""
    items = inputs.study(spark, folder).items.join(inputs.parameters(spark, folder), "item")
    # many takers and items share a scenario: count equal scores first
    levels = inputs.scores(spark, folder).groupBy("scenario", "p").agg(F.count(F.lit(1)).alias("m"))
    p = sigmoid(F.col("p") * F.col("a") - F.col("d"))
    return (items.join(levels, "scenario").groupBy("item")
            .agg(F.sum("m").alias("n"), fixed(F.sum(p * F.col("m")), 4).alias("expected")))


@query("e9_split_cells", sql="SELECT taker, item, y, split FROM split")
def split_cells(spark, folder):
    return sample.bernoulli_split(inputs.study(spark, folder).responses)


@query("e11_membership_join", sql="""
    SELECT m.factor, COUNT(*) AS n, CAST(SUM(r.y) AS BIGINT) AS correct
    FROM members m JOIN responses r ON r.item = m.item WHERE m.member = 1 GROUP BY m.factor""")
def membership_join(spark, folder):
    """Cells per factor; summed per item before an item is spread over its factors."""
    per_item = inputs.study(spark, folder).responses.groupBy("item").agg(
        F.count("y").alias("n"), F.sum("y").alias("correct"))
    member = inputs.members(spark, folder).filter("member = 1").select("item", "factor")
    return per_item.join(member, "item").groupBy("factor").agg(
        F.sum("n").alias("n"), F.sum("correct").alias("correct"))


@query("h1_row_concat", sql="""
    SELECT item, 'scenario' AS kind, scenario AS label FROM items
    UNION ALL SELECT item, 'benchmark', benchmark FROM items""")
def row_concat(spark, folder):
    items = inputs.study(spark, folder).items
    parts = [items.select("item", F.lit(k).alias("kind"), F.col(k).alias("label"))
             for k in ("scenario", "benchmark")]
    return parts[0].unionByName(parts[1])


@query("h2_first_per_key", sql="""
    SELECT input_text, MIN(item) AS item, ARG_MIN(scenario, item) AS scenario
    FROM items GROUP BY input_text""")
def first_per_key(spark, folder):
    items = inputs.study(spark, folder).items.select("input_text", "item", "scenario")
    return choose.first_per_key(items, "input_text", [F.col("item")])


@query("h3_distinct_rows", sql="SELECT DISTINCT input_text, scenario FROM items")
def distinct_rows(spark, folder):
    return inputs.study(spark, folder).items.select("input_text", "scenario").distinct()


@query("h4_label_difference", sql="SELECT item FROM items EXCEPT SELECT vec_id FROM embeddings")
def difference(spark, folder):
    vectors = spark.read.parquet(f"{folder}/embeddings.parquet").select("vec_id")
    return inputs.study(spark, folder).items.select("item").subtract(vectors)


@query("h5_complement_split", sql="SELECT taker, item, y FROM split WHERE split <> 'train'")
def complement(spark, folder):
    cells = sample.bernoulli_split(inputs.study(spark, folder).responses)
    return cells.filter(F.col("split") != "train").select("taker", "item", "y")

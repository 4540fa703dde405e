"""Mixing sources to target weights by iterative proportional fitting.

Only DataFrame operations.  Tokens are summed into cells of (source, lang, topic); the
cell weights are raked to one marginal after the other until all three hold; a
document is sampled with the probability that takes its cell to its weight.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from itemspark.llm.registry import query, table
from itemspark.llm.tasks import aside
from itemspark.session import cut_lineage

DIMENSIONS = ("source", "lang", "topic")
POWER = 0.9                 # targets: token shares to this power, so rare values gain
TOLERANCE = 1e-12
LEAST_GAIN = 0.05           # a round must bring the marginals nearer by this part
CELLS_PER_TASK = 100_000
JOB_ROUNDS = 8              # rounds of one job where a task holds all cells
MISSING = "(none)"


def topic_of(text):
    """A topic from plain marks in the text, the first that applies."""
    low = F.lower(text)
    return (F.when(low.contains("license") | low.contains("copyright"), "legal")
            .when(low.contains("@"), "contact").when(low.contains(" | "), "table")
            .when(low.rlike("[0-9]"), "figures").otherwise("prose"))


def marked(docs: DataFrame) -> DataFrame:
    """Add topic and tokens (words and an end mark) and fill the dimensions' nulls.

    Null text: one token, topic prose.  Columns of those names are replaced.
    """
    text = F.coalesce("text", F.lit(""))
    return (docs.withColumn("topic", topic_of(text))
            .withColumn("tokens", (F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")) + 1).cast("long"))
            .withColumns({f"_{d}": F.coalesce(F.col(d), F.lit(MISSING)) for d in DIMENSIONS}))


def tempered_targets(cells: DataFrame, power: float = POWER) -> DataFrame:
    """dim, value, target: shares of the tokens to a power, adding up to 1 in each dimension."""
    sums = _marginals(cells, "tokens").withColumn("raised", F.pow("total", F.lit(power)))
    whole = sums.groupBy("dim").agg(F.sum("raised").alias("whole"))
    return sums.join(F.broadcast(whole), "dim").select("dim", "value", (F.col("raised") / F.col("whole")).alias("target"))


def _marginals(cells: DataFrame, weight: str) -> DataFrame:
    long = cells.select(weight, F.explode(F.array(*[
        F.struct(F.lit(d).alias("dim"), F.col(f"_{d}").alias("value")) for d in DIMENSIONS])).alias("at"))
    return long.groupBy("at.dim", "at.value").agg(F.sum(weight).alias("total"))


def raked(cells: DataFrame, targets: DataFrame, tolerance: float = TOLERANCE) -> DataFrame:
    """cells (with column tokens) with their ``weight``, shares whose marginals are the
    targets, as near to the tokens' own shares as can be, and ``target_gap``, the largest
    distance of a marginal from its target.

    A target for a value without tokens cannot be met and is left out, the others of
    its dimension being scaled up; a value without a target gets weight 0.  Rounds end
    when the gap is within ``tolerance``, or no longer falls by LEAST_GAIN: empty cells
    can rule out that all targets hold, and then those of the last dimension do.  No
    cells: no rows.
    """
    tasks = cells.count() // CELLS_PER_TASK + 1
    near = (lambda df: df.coalesce(1)) if tasks == 1 else (lambda df: df)     # small: no exchange in a round
    present = _marginals(cells, "tokens").join(targets, ["dim", "value"], "left").withColumn("target", F.coalesce("target", F.lit(0.0)))
    whole = present.groupBy("dim").agg(F.sum("target").alias("whole"))
    targets = cut_lineage(near(present.join(F.broadcast(whole), "dim").select(
        "dim", "value", F.when(F.col("whole") > 0, F.col("target") / F.col("whole")).otherwise(0.0).alias("target"))), "targets")
    now = cut_lineage(near(cells.withColumn("weight", F.col("tokens").cast("double"))), "weights")
    if tasks == 1:
        return _raked_at_once(now, targets, tolerance)
    before = float("inf")
    while True:
        for d in DIMENSIONS:
            now = near(now)
            sums = now.groupBy(f"_{d}").agg(F.sum("weight").alias("total"))
            factor = sums.join(near(targets.where(F.col("dim") == d)).withColumnRenamed("value", f"_{d}"), f"_{d}").select(
                f"_{d}", F.when(F.col("total") > 0, F.col("target") / F.col("total")).otherwise(0.0).alias("factor"))
            now = cut_lineage(now.join(factor, f"_{d}").withColumn("weight", F.col("weight") * F.col("factor")).drop("factor"), "weights")
        off = (near(_marginals(near(now), "weight")).join(near(targets), ["dim", "value"])
               .agg(F.max(F.abs(F.col("total") - F.col("target")))).first()[0])
        if off is None or off < tolerance or off > (1 - LEAST_GAIN) * before:
            return now.withColumn("target_gap", F.lit(off).cast("double"))
        before = off


def _raked_at_once(cells: DataFrame, targets: DataFrame, tolerance: float) -> DataFrame:
    """``raked`` for cells that one task holds (CELLS_PER_TASK): JOB_ROUNDS rounds are
    one job without an exchange, so marginals that come near slowly cost few jobs."""
    now = cells
    for d in DIMENSIONS:
        now = now.join(targets.where(F.col("dim") == d).select(F.col("value").alias(f"_{d}"), F.col("target").alias(f"_{d}_target")), f"_{d}")
    now = cut_lineage(now.coalesce(1), "weights")
    total = lambda d: F.sum("weight").over(Window.partitionBy(f"_{d}"))
    before = float("inf")
    while True:
        now = now.coalesce(1)
        for d in DIMENSIONS * JOB_ROUNDS:
            now = (now.withColumn("_total", total(d)).withColumn("weight", F.when(
                F.col("_total") > 0, F.col("weight") * F.col(f"_{d}_target") / F.col("_total")).otherwise(0.0)).drop("_total"))
        now = cut_lineage(now, "weights")
        gaps = [F.abs(total(d) - F.col(f"_{d}_target")).alias(f"_{d}_gap") for d in DIMENSIONS]
        off = now.coalesce(1).select(*gaps).agg(F.max(F.greatest(*[f"_{d}_gap" for d in DIMENSIONS]))).first()[0]
        if off is None or off < tolerance or off > (1 - LEAST_GAIN) ** JOB_ROUNDS * before:
            return now.drop(*[f"_{d}_target" for d in DIMENSIONS]).withColumn("target_gap", F.lit(off).cast("double"))
        before = off


def mixed(docs: DataFrame, power: float = POWER, seed: int = 42, targets: DataFrame | None = None,
          budget: int | None = None) -> DataFrame:
    """Add topic, tokens, ``weight`` (token share the document's cell shall have),
    ``target_gap`` (see ``raked``), ``probability`` and ``sampled``.

    ``targets`` has dim (source, lang or topic), value and target; without it the targets
    are the tokens' own shares to ``power``.  With ``budget`` the expected sample has that
    many tokens instead: ``probability`` is the expected number of copies of a document,
    above 1 where the mixture asks for more tokens than there are, and ``copies`` is added,
    that number rounded up or down by the draw.

    The probability is the cell's weight over its tokens, relative to the largest such
    ratio, so that the expected sample meets all targets and no document is taken
    twice.  The draw depends on doc_id and ``seed`` alone; rows that repeat a doc_id
    are drawn together.  Null source or lang is a value of its own; null doc_id draws
    as an empty one.  Columns of the added names are replaced, others stay, whatever
    their names; an empty table stays empty.
    """
    names = [f"_{d}" for d in DIMENSIONS]
    return aside(docs, names, lambda rows: _mixed(rows, power, seed, targets, budget))


def _mixed(docs: DataFrame, power: float, seed: int, targets: DataFrame | None, budget: int | None) -> DataFrame:
    rows = marked(docs.drop("topic", "tokens", "weight", "target_gap", "probability", "sampled", *["copies"] * (budget is not None)))
    keys = [f"_{d}" for d in DIMENSIONS]
    cells = cut_lineage(rows.groupBy(*keys).agg(F.sum("tokens").alias("tokens")), "cells")
    now = raked(cells, tempered_targets(cells, power) if targets is None else targets)
    ratio = F.col("weight") / F.col("tokens")
    top = now.agg((F.max(ratio) if budget is None else F.lit(1.0 / budget)).alias("top"))
    rates = cut_lineage(now.join(F.broadcast(top)).select(*keys, "weight", "target_gap", (ratio / F.col("top")).alias("probability")), "rates")
    draw = F.conv(F.substring(F.md5(F.concat_ws("|", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(str(seed)))), 1, 8), 16, 10)
    rows = rows.join(rates, keys).drop(*keys)
    drawn = draw.cast("double") / F.lit(float(1 << 32))
    if budget is None:
        return rows.withColumn("sampled", drawn < F.col("probability"))
    whole = F.floor("probability").cast("long")
    copies = whole + (drawn < F.col("probability") - whole).cast("long")
    return rows.withColumn("copies", copies).withColumn("sampled", F.col("copies") > 0)


def _oracle(rounds: int = 20) -> str:
    head = r"""
    own AS (
        SELECT doc_id, COALESCE(source, '(none)') AS source, COALESCE(lang, '(none)') AS lang,
               CASE WHEN contains(low, 'license') OR contains(low, 'copyright') THEN 'legal'
                    WHEN contains(low, '@') THEN 'contact' WHEN contains(low, ' | ') THEN 'table'
                    WHEN regexp_matches(low, '[0-9]') THEN 'figures' ELSE 'prose' END AS topic,
               len(regexp_extract_all(low, '[^\x20\x09-\x0D]+')) + 1 AS tokens
        FROM (SELECT *, lower(COALESCE(text, '')) AS low FROM documents)),
    c0 AS MATERIALIZED (SELECT source, lang, topic, CAST(SUM(tokens) AS DOUBLE) AS tokens, CAST(SUM(tokens) AS DOUBLE) AS w
                        FROM own GROUP BY source, lang, topic)"""
    parts, last = [head], "c0"
    for d in DIMENSIONS:
        parts.append(f"""
    t_{d} AS MATERIALIZED (SELECT {d}, pow(SUM(tokens), 0.9) / SUM(pow(SUM(tokens), 0.9)) OVER () AS target FROM c0 GROUP BY {d})""")
    for i in range(rounds):
        for d in DIMENSIONS:
            parts.append(f"""
    c{i}_{d} AS MATERIALIZED (SELECT c.source, c.lang, c.topic, tokens, w * target / SUM(w) OVER (PARTITION BY c.{d}) AS w
                              FROM {last} c JOIN t_{d} t ON t.{d} = c.{d})""")
            last = f"c{i}_{d}"
    return "WITH" + ",".join(parts) + f""",
    rates AS (SELECT *, w / tokens / MAX(w / tokens) OVER () AS p FROM {last})
    SELECT doc_id, o.source, o.lang, o.topic, o.tokens, round(w, 6) AS weight, round(p, 6) AS probability,
           CAST('0x' || substr(md5(doc_id || '|42'), 1, 8) AS BIGINT) / 4294967296e0 < p AS sampled
    FROM own o JOIN rates r ON r.source = o.source AND r.lang = o.lang AND r.topic = o.topic"""


@query("op4_mixing", _oracle())
def op4_mixing(spark, folder) -> DataFrame:
    """Mixing weight, probability and draw of every document."""
    missing = lambda c: F.coalesce(F.col(c), F.lit(MISSING)).alias(c)
    return mixed(table(spark, folder, "documents")).select(
        "doc_id", missing("source"), missing("lang"), "topic", "tokens", F.round("weight", 6).alias("weight"),
        F.round("probability", 6).alias("probability"), "sampled")

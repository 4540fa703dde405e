"""Filter interaction audit: what each filter removes in every order of the filters.

Each document gets a mask of the filters it fails.  Filters that look at one text are
column expressions.  For repeats of a text, a counting Bloom filter is built first:
tasks count the slots of their texts' hashes, the counts are merged per segment, and a
text with a slot counted once is the only one of its kind.  Only the others, possible
repeats, are shuffled and grouped by their full text for its smallest doc_id.  All
orders follow from the counts per mask, which add up.
"""

from __future__ import annotations

from itertools import permutations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from itemspark.llm.registry import query, table
from itemspark.llm.tasks import releasing
from itemspark.session import cut_lineage

LETTERS = "ABCDE"
COUNTERS = 8                # of the sketch for each document
MOST_COUNTERS = 1 << 28     # two bits each, so 64 MB at most; beyond, fewer texts are cleared
SEGMENT = 1 << 16           # counters that are merged together
FLUSH_ROWS = 1 << 20        # hashes that a task counts before it hands on its counts
BLANKS = r"[\x20\x09-\x0D]+"


# --- counting Bloom filter -------------------------------------------------

def slots_of(hashes: np.ndarray, counters: int, probes: int) -> np.ndarray:
    """The counters (a power of two) of each 64-bit hash: rows of ``probes`` places."""
    h = hashes.view("u8")
    step = (h >> np.uint64(32)) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(17) | np.uint64(1)
    return (h[:, None] + step[:, None] * np.arange(probes, dtype="u8")) & np.uint64(counters - 1)


def merged_sketch(hashes: DataFrame, counters: int, probes: int) -> np.ndarray:
    """Counters of the column ``hash``, four in a byte; 2 stands for two or more.

    The segments come to the driver: ``counters`` / 4 bytes at most.
    """
    def count(batches):
        held, rows = [], 0

        def counted():
            # equal texts of a task first: more than two add nothing
            own, n = np.unique(np.concatenate(held), return_counts=True)
            slots = slots_of(np.repeat(own, np.minimum(n, 2)), counters, probes)
            slot, n = np.unique(slots, return_counts=True)
            segment = (slot // SEGMENT).astype("i8")
            cut = np.flatnonzero(np.append(True, segment[1:] != segment[:-1]))
            parts = list(zip(np.split((slot % SEGMENT).astype("<u2"), cut[1:]), np.split(np.minimum(n, 2).astype("u1"), cut[1:])))
            return pa.record_batch({"segment": pa.array(segment[cut]), "slots": pa.array([s.tobytes() for s, _ in parts], pa.binary()),
                                    "counts": pa.array([c.tobytes() for _, c in parts], pa.binary())})
        for batch in batches:
            held.append(batch.column("hash").to_numpy(zero_copy_only=False))
            rows += len(held[-1])
            if rows >= FLUSH_ROWS:
                yield counted()
                held, rows = [], 0
        if rows:
            yield counted()

    def merge(group: pa.Table) -> pa.Table:
        total = np.zeros(SEGMENT, "u1")
        for slots, counts in zip(group.column("slots"), group.column("counts")):
            at = np.frombuffer(slots.as_py(), "<u2")
            total[at] = np.minimum(total[at] + np.frombuffer(counts.as_py(), "u1"), 2)
        four = total.reshape(-1, 4) << np.array([0, 2, 4, 6], "u1")
        return pa.table({"segment": group.column("segment")[:1], "packed": pa.array([four.sum(axis=1, dtype="u1").tobytes()], pa.binary())})

    counted = hashes.select("hash").mapInArrow(releasing(count), "segment long, slots binary, counts binary")
    merged = counted.groupBy("segment").applyInArrow(merge, "segment long, packed binary")
    sketch = np.zeros(counters // 4, "u1")
    for row in merged.toLocalIterator():
        at = row["segment"] * SEGMENT // 4
        sketch[at:at + SEGMENT // 4] = np.frombuffer(row["packed"], "u1")
    return sketch


def maybe_repeated(hashes: DataFrame, rows: int, most_counters: int = MOST_COUNTERS):
    """A function of a hash column: false only where that hash is in the column
    ``hash`` of ``hashes`` once.  ``rows`` is their number, which sets the sketch's size
    up to ``most_counters``; a sketch that is full answers true more often."""
    counters = SEGMENT
    while counters < min(COUNTERS * rows, most_counters):
        counters *= 2
    probes = max(1, min(4, round(0.69 * counters / max(1, rows))))
    shared = hashes.sparkSession.sparkContext.broadcast(merged_sketch(hashes, counters, probes))

    @F.pandas_udf("boolean")
    def repeated(hash: pd.Series) -> pd.Series:
        slots = slots_of(hash.to_numpy("i8"), counters, probes)
        found = shared.value[slots >> np.uint64(2)] >> ((slots & np.uint64(3)) * np.uint64(2)).astype("u1") & 3
        return pd.Series((found >= 2).all(axis=1))

    return repeated


# --- masks -----------------------------------------------------------------

def text_failures(docs: DataFrame) -> list[Column]:
    """For rows with ``text`` and ``words``: few words, few different words, many
    capitals, signs of markup."""
    n = F.size("words")
    return [n < 50, F.size(F.array_distinct("words")) * 100 < n * 65,
            F.regexp_count("text", F.lit("[A-Z]")) * 100 > F.length("text") * 5, F.col("text").rlike("[#$%&*|]")]


def failure_masks(docs: DataFrame, labels: DataFrame, most_counters: int = MOST_COUNTERS) -> DataFrame:
    """Counts per (part, mask): n, good and toxic.  Bit i of a mask is filter i of ABCDE.

    ``docs`` has doc_id, text and source, ``labels`` doc_id, quality and toxic.  Null
    texts and sources count as empty.  E, a repeat of a text, holds for rows whose doc_id
    is greater than the smallest one of their text; a null doc_id is neither greater nor
    smaller, and has no label.  Rows that repeat a doc_id count each; a doc_id is good (toxic) if any label
    of it is.  Other columns are left out; an empty table gives no rows.
    """
    own = docs.select("doc_id", F.coalesce("source", F.lit("")).alias("part"), F.coalesce("text", F.lit("")).alias("text"))
    words = F.filter(F.split("text", BLANKS), lambda w: w != "")
    found = own.withColumns({"hash": F.xxhash64("text"), "digest": F.unhex(F.sha2(F.col("text").cast("binary"), 256)), "words": words})
    mask = sum((F.when(fails, 1 << i).otherwise(0) for i, fails in enumerate(text_failures(found))), F.lit(0))
    facts = cut_lineage(found.select("doc_id", "part", "hash", "digest", mask.alias("mask")), "facts")
    repeated = maybe_repeated(facts, facts.count(), most_counters)

    firsts = (own.where(repeated(F.xxhash64("text"))).groupBy("text").agg(F.min("doc_id").alias("doc_id"))
              .select("doc_id", F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("digest"), F.lit(True).alias("first")))
    once = facts.where(~repeated("hash")).select("doc_id", "part", "mask")
    several = facts.where(repeated("hash")).join(cut_lineage(firsts, "firsts"), ["digest", "doc_id"], "left").select(
        "doc_id", "part", F.when(F.col("first").isNull() & F.col("doc_id").isNotNull(), F.col("mask") + 16).otherwise(F.col("mask")).alias("mask"))
    any_of = lambda c: F.max(F.when(F.col(c) == 1, 1).otherwise(0)).alias(c)
    marked = labels.groupBy("doc_id").agg(any_of("quality"), any_of("toxic")).where("quality = 1 OR toxic = 1")
    return (once.unionByName(several).join(marked, "doc_id", "left").groupBy("part", "mask")
            .agg(F.count("*").alias("n"), F.sum(F.coalesce("quality", F.lit(0))).alias("good"),
                 F.sum(F.coalesce("toxic", F.lit(0))).alias("toxic")))


def interactions(counts: DataFrame, letters: str = LETTERS) -> DataFrame:
    """For every part, order of the filters and step what the step's filter does.

    ``counts`` are those of failure_masks.  A part has at most 2 ** len(letters) masks,
    each meets a constant table of filters and sets of earlier filters.  ``shapley`` is
    what the filter removes, summed over all orders: a document that fails k filters is
    removed by each of them in 1 / k of the orders.
    """
    spark = counts.sparkSession
    size, orders = len(letters), list(permutations(range(len(letters))))
    effects = [(mask, f, before, int(not mask & (before | 1 << f)), int(mask >> f & 1 and not mask & before),
                int(mask >> f & 1 and mask & before > 0), int(mask == 1 << f),
                len(orders) // mask.bit_count() if mask >> f & 1 else 0)
               for mask in range(1 << size) for f in range(size) for before in range(1 << size) if not before >> f & 1]
    steps = [("".join(letters[f] for f in order), step + 1, f, sum(1 << g for g in order[:step]))
             for order in orders for step, f in enumerate(order)]
    effect = spark.createDataFrame(effects, "mask int, filter int, before int, stays long, goes long, late long, alone long, share long")
    step = spark.createDataFrame(steps, "filter_order string, step int, filter int, before int")
    total = lambda n, weight, name: F.sum(F.col(n) * F.col(weight)).alias(name)
    summed = counts.join(F.broadcast(effect), "mask").groupBy("part", "filter", "before").agg(   # constant tables
        total("n", "stays", "kept"), total("n", "goes", "removed"), total("n", "late", "redundant"), total("n", "alone", "unique_fails"),
        total("good", "goes", "good_lost"), total("toxic", "goes", "toxic_lost"), total("n", "share", "shapley"))
    return (summed.join(F.broadcast(step), ["filter", "before"])
            .select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"))


@query("op11_audit", r"""
    WITH own AS (SELECT doc_id, COALESCE(source, '') AS part, COALESCE(text, '') AS t,
                        regexp_extract_all(COALESCE(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
    masks AS (
        SELECT doc_id, part,
               CASE WHEN len(w) < 50 THEN 1 ELSE 0 END + CASE WHEN 100 * len(list_distinct(w)) < 65 * len(w) THEN 2 ELSE 0 END
               + CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * length(t) THEN 4 ELSE 0 END
               + CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 8 ELSE 0 END
               + CASE WHEN doc_id > MIN(doc_id) OVER (PARTITION BY t) THEN 16 ELSE 0 END AS mask
        FROM own),
    marked AS (SELECT doc_id, MAX(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good,
                      MAX(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
    counts AS (SELECT part, mask, COUNT(*) AS n, SUM(COALESCE(good, 0)) AS good, SUM(COALESCE(toxic, 0)) AS toxic
               FROM masks LEFT JOIN marked USING (doc_id) GROUP BY part, mask),
    letters AS (SELECT * FROM (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) v(l, b)),
    orders AS (
        SELECT a.l || b.l || c.l || d.l || e.l AS filter_order, [a.b, b.b, c.b, d.b, e.b] AS bits
        FROM letters a, letters b, letters c, letters d, letters e
        WHERE a.b + b.b + c.b + d.b + e.b = 31 AND a.b | b.b | c.b | d.b | e.b = 31),
    steps AS (SELECT filter_order, s AS step, bits[s] AS f, COALESCE(list_sum(bits[1:s - 1]), 0) AS before
              FROM orders, range(1, 6) r(s)),
    told AS (
        SELECT part, filter_order, step, f,
               SUM(CASE WHEN mask & (before::BIGINT | f) = 0 THEN n ELSE 0 END) AS kept,
               SUM(CASE WHEN mask & before::BIGINT = 0 AND mask & f > 0 THEN n ELSE 0 END) AS removed,
               SUM(CASE WHEN mask & before::BIGINT > 0 AND mask & f > 0 THEN n ELSE 0 END) AS redundant,
               SUM(CASE WHEN mask = f THEN n ELSE 0 END) AS unique_fails,
               SUM(CASE WHEN mask & before::BIGINT = 0 AND mask & f > 0 THEN good ELSE 0 END) AS good_lost,
               SUM(CASE WHEN mask & before::BIGINT = 0 AND mask & f > 0 THEN toxic ELSE 0 END) AS toxic_lost
        FROM counts, steps GROUP BY part, filter_order, step, f)
    SELECT part, filter_order, CAST(step AS INT) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed,
           CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
           CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
           CAST(SUM(removed) OVER (PARTITION BY part, f) AS BIGINT) AS shapley
    FROM told""")
def op11_audit(spark, folder) -> DataFrame:
    """What five filters remove from all documents, in every order."""
    return interactions(failure_masks(table(spark, folder, "documents"), table(spark, folder, "labels")))

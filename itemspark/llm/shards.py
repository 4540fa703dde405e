"""Sharding: contiguous shards of near-equal bytes from global prefix sums.

Only DataFrame operations.  Rows are put in order by a range partitioning of light
rows; each slice adds up its own bytes, the slice totals are summed once (one row per
slice), and a row's place in the byte line is the total before its slice plus the
running sum inside it.  The line is cut at equal targets.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from itemspark.llm.registry import query, table
from itemspark.llm.tasks import aside
from itemspark.session import cut_lineage

#: Rows of one slice, about; a slice is sorted and summed by one task.
SLICE_ROWS = 200_000


def byte_line(rows: DataFrame, order: list[str], size: str = "size") -> DataFrame:
    """Add ``_before`` (bytes before the row) and ``_index`` (rows before it).

    ``order`` names the sort columns, nulls first.  Rows equal in all of them have no
    fixed order among themselves; a running number, taken once and stored, spreads
    them over slices, so one repeated key doesn't fill a slice.
    """
    kept = cut_lineage(rows.withColumn("_n", F.monotonically_increasing_id()), "sized")
    slices = max(1, kept.count() // SLICE_ROWS + 1)
    keys = [F.col(c).asc_nulls_first() for c in (*order, "_n")]
    dealt = cut_lineage(kept.repartitionByRange(slices, *keys)
                        .withColumn("_slice", F.spark_partition_id()), "slices")
    totals = dealt.groupBy("_slice").agg(F.sum(size).alias("_bytes"), F.count("*").alias("_rows"))
    ahead = Window.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("_slice", F.coalesce(F.sum("_bytes").over(ahead), F.lit(0)).alias("_bytes0"),
                           F.coalesce(F.sum("_rows").over(ahead), F.lit(0)).alias("_rows0"))
    inside = Window.partitionBy("_slice").orderBy(*keys)
    return (dealt.withColumn("_run", F.sum(size).over(
                inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
            .withColumn("_place", F.row_number().over(inside))
            .join(totals, "_slice")
            .withColumn("_before", F.col("_bytes0") + F.col("_run") - F.col(size))
            .withColumn("_index", F.col("_rows0") + F.col("_place") - 1)
            .drop("_run", "_place", "_slice", "_bytes0", "_rows0", "_n"))


def byte_shards(rows: DataFrame, shards: int, order: list[str], size: str = "size") -> DataFrame:
    """Add ``shard`` (0 .. shards-1) and ``slot`` (place in the shard, from 0).

    A row belongs to the shard in which its middle byte falls, so a shard misses its
    equal share by at most half a row at each end.  Sizes must be at least 1 and not
    null.  An empty table gives no rows; with fewer rows than shards some shards stay
    empty; a row larger than a share leaves its neighbours smaller.  Columns called shard
    or slot are replaced, others stay, whatever their names.
    """
    own = ("_n", "_slice", "_run", "_place", "_before", "_index", "_bytes", "_rows", "_bytes0", "_rows0", "_total", "_first")
    clash = {*order, size} & set(own)
    if clash:
        raise ValueError(f"order and size need other names than {sorted(clash)}")
    return aside(rows.drop("shard", "slot"), own, lambda rows: _cut(rows, shards, order, size))


def _cut(rows: DataFrame, shards: int, order: list[str], size: str) -> DataFrame:
    lined = byte_line(rows, order, size)
    total = rows.agg(F.coalesce(F.sum(size), F.lit(1)).alias("_total"))
    middle = F.col("_before") * 2 + F.col(size)
    cut = cut_lineage(lined.join(F.broadcast(total))           # one row
                      .withColumn("shard", F.least(F.lit(shards - 1), F.floor(
                          (middle.cast("decimal(38,0)") * shards) / (F.col("_total") * 2))).cast("int"))
                      .drop("_total", "_before"), "shards")
    first = cut.groupBy("shard").agg(F.min("_index").alias("_first"))
    return (cut.join(F.broadcast(first), "shard")              # at most one row per shard
            .withColumn("slot", F.col("_index") - F.col("_first")).drop("_index", "_first"))


def sized_texts(docs: DataFrame) -> DataFrame:
    """doc_id, size (UTF-8 bytes plus 8; null text: 8) and text_crc32 (null text: 0)."""
    raw = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    return docs.select("doc_id", (F.octet_length(raw) + 8).cast("long").alias("size"),
                       F.crc32(raw).alias("text_crc32"))


@query("op10_shards", """
    WITH RECURSIVE step AS (
        SELECT i AS byte, 0 AS k, i AS c FROM range(256) r(i)
        UNION ALL
        SELECT byte, k + 1, CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END
        FROM step WHERE k < 8),
    crc AS (SELECT list(c ORDER BY byte) AS crc_table FROM step WHERE k = 8),
    raw AS (SELECT doc_id, hex(encode(COALESCE(text, ''))) AS h FROM documents),
    sized AS (
        SELECT doc_id, CAST(length(h) // 2 + 8 AS BIGINT) AS size,
               xor(4294967295, list_reduce(
                   list_prepend(4294967295::BIGINT, list_transform(
                       regexp_extract_all(h, '..'), lambda p: CAST('0x' || p AS BIGINT))),
                   lambda c, b: xor(c // 256, crc_table[xor(c, b) % 256 + 1]))) AS text_crc32
        FROM raw CROSS JOIN crc),
    placed AS (
        SELECT *, SUM(size) OVER (ORDER BY doc_id, text_crc32, size ROWS UNBOUNDED PRECEDING) - size AS before,
               SUM(size) OVER () AS total,
               ROW_NUMBER() OVER (ORDER BY doc_id, text_crc32, size) - 1 AS i
        FROM sized),
    cut AS (SELECT *, LEAST(23, ((2 * before + size) * 24) // (2 * total)) AS shard FROM placed)
    SELECT doc_id, size, CAST(text_crc32 AS BIGINT) AS text_crc32, 'bytes' AS law, CAST(shard AS INT) AS shard,
           i - MIN(i) OVER (PARTITION BY shard) AS slot, CAST(NULL AS INT) AS grown_shard
    FROM cut""")
def op10_shards(spark, folder) -> DataFrame:
    """All documents in 24 contiguous shards (by doc_id) of near-equal bytes."""
    cut = byte_shards(sized_texts(table(spark, folder, "documents")), 24, ["doc_id", "text_crc32", "size"])
    return cut.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
                      F.lit(None).cast("int").alias("grown_shard"))

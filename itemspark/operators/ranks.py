"""Exact ranks and running sums over data of any size.

``Window.orderBy`` without a partition key, or with a key that a third of all
rows share, sorts everything in one task.  The functions here order the rows by
range partitioning instead: every task holds one contiguous slice, and the
slices are joined by per-slice totals (one row per slice and group).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from itemspark.functions.scalars import hash_text
from itemspark.session import cut_lineage

_ROW_BITS = 33          # monotonically_increasing_id: partition << 33 | row


def _columns(names: list[str]) -> list[Column]:
    return [F.col(n) for n in names]


def positions(df: DataFrame, order: list[Column], groups: list[str] | None = None,
              name: str = "position") -> DataFrame:
    """Number the rows 1, 2, ... within each group, in ``order``.

    ``order`` must end in a unique key.  The sorted slices are checkpointed, so
    both readers below see the same slice borders, also after a lost executor.
    """
    groups = groups or []
    keys = _columns(groups) + order
    sliced = cut_lineage(
        df.repartitionByRange(*keys).sortWithinPartitions(*keys)
          .withColumn("_slot", F.monotonically_increasing_id()))
    slice_id = F.shiftright(F.col("_slot"), _ROW_BITS).alias("_slice")
    tally = (sliced.groupBy(*groups, slice_id)
             .agg(F.count(F.lit(1)).alias("_rows"), F.min("_slot").alias("_first")))
    earlier = (Window.partitionBy(*groups).orderBy("_slice")
               .rowsBetween(Window.unboundedPreceding, -1))
    offsets = tally.select(*groups, "_slice", "_first",
                           F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_before"))
    return (sliced.withColumn("_slice", F.shiftright(F.col("_slot"), _ROW_BITS))
            .join(offsets, groups + ["_slice"])
            .withColumn(name, F.col("_slot") - F.col("_first") + F.col("_before") + 1)
            .drop("_slot", "_slice", "_first", "_before"))


def running_totals(df: DataFrame, order: list[Column], weights: list[str],
                   groups: list[str] | None = None) -> DataFrame:
    """Add ``<weight>_before``: the sum over all earlier rows of the group.

    ``order`` must be unique within a group (aggregate ties first).
    """
    groups = groups or []
    keys = _columns(groups) + order
    sliced = cut_lineage(df.repartitionByRange(*keys)
                         .withColumn("_slice", F.spark_partition_id()))
    totals = sliced.groupBy(*groups, "_slice").agg(*[F.sum(w).alias(f"_{w}") for w in weights])
    earlier = (Window.partitionBy(*groups).orderBy("_slice")
               .rowsBetween(Window.unboundedPreceding, -1))
    offsets = totals.select(*groups, "_slice", *[
        F.coalesce(F.sum(f"_{w}").over(earlier), F.lit(0)).alias(f"_{w}_offset") for w in weights])
    inside = (Window.partitionBy(*groups, "_slice").orderBy(*order)
              .rowsBetween(Window.unboundedPreceding, -1))
    return (sliced.select("*", *[F.coalesce(F.sum(w).over(inside), F.lit(0)).alias(f"_{w}_inside")
                                 for w in weights])
            .join(offsets, groups + ["_slice"])
            .select(*df.columns, *[(F.col(f"_{w}_inside") + F.col(f"_{w}_offset"))
                                   .alias(f"{w}_before") for w in weights]))


def average_ranks(df: DataFrame, value: str, groups: list[str], name: str = "rank") -> DataFrame:
    """Ascending rank of ``value`` within the group, ties sharing their mean rank."""
    tied = (df.filter(F.col(value).isNotNull()).groupBy(*groups, value)
            .agg(F.count(F.lit(1)).alias("ties")))
    ranked = running_totals(tied, [F.col(value)], ["ties"], groups).select(
        *groups, value, (F.col("ties_before") + (F.col("ties") + 1) / 2).alias(name))
    return df.join(ranked, groups + [value])


def hash_positions(df: DataFrame, keys: list[str], seed: int, groups: list[str] | None = None,
                   name: str = "position") -> DataFrame:
    """Number the rows of each group in the order of ``md5(keys, seed)``.

    The first five digits of the hash split every group evenly into up to a
    million buckets, whatever the group's size, so no sampling pass and no
    checkpoint is needed: a bucket is sorted alone and bucket counts add up.
    """
    groups = groups or []
    hashed = (df.withColumn("_hash", hash_text(keys, seed))
              .withColumn("_bucket", F.substring("_hash", 1, 5)))
    counts = hashed.groupBy(*groups, "_bucket").agg(F.count(F.lit(1)).alias("_rows"))
    earlier = (Window.partitionBy(*groups).orderBy("_bucket")
               .rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.select(*groups, "_bucket",
                            F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_before"))
    inside = Window.partitionBy(*groups, "_bucket").orderBy("_hash", *keys)
    return (hashed.withColumn("_inside", F.row_number().over(inside))
            .join(offsets, groups + ["_bucket"])
            .withColumn(name, F.col("_before") + F.col("_inside"))
            .drop("_hash", "_bucket", "_inside", "_before"))


def quantiles(df: DataFrame, value: str, groups: list[str], probabilities: dict[str, float]
              ) -> DataFrame:
    """Exact quantiles per group, linear between neighbours, one column per name.

    Works on distinct values with counts, so neither a hot group nor a hot value
    gathers in one task (the built-in ``percentile`` keeps a map per group).
    """
    counts = (df.filter(F.col(value).isNotNull()).groupBy(*groups, value)
              .agg(F.count(F.lit(1)).alias("ties")))
    placed = running_totals(counts, [F.col(value)], ["ties"], groups)
    sizes = placed.groupBy(*groups).agg(F.sum("ties").alias("_n"))
    placed = placed.join(sizes, groups) if groups else placed.withColumn(
        "_n", counts.agg(F.sum("ties")).scalar())
    first, last = F.col("ties_before"), F.col("ties_before") + F.col("ties") - 1

    def at(index):
        return F.max(F.when((index >= first) & (index <= last), F.col(value)))

    picks = []
    for name, q in probabilities.items():
        target = (F.col("_n") - 1) * q
        picks += [at(F.floor(target)).alias(f"_{name}_low"), at(F.ceil(target)).alias(f"_{name}_high"),
                  F.max(target - F.floor(target)).alias(f"_{name}_part")]
    table = placed.groupBy(*groups).agg(*picks)
    return table.select(*groups, *[
        (F.col(f"_{n}_low") + (F.col(f"_{n}_high") - F.col(f"_{n}_low")) * F.col(f"_{n}_part"))
        .alias(n) for n in probabilities])

"""Reproducible sampling and train/test splits, ordered by hash instead of state."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from itemspark.functions.scalars import hash_text
from itemspark.operators.clean import large_groups, takers_with_answers
from itemspark.operators.ranks import hash_positions
from itemspark.operators.score import coverage
from itemspark.session import cut_lineage

TRAIN_BELOW = "cccccccc"        # 0.8 of the eight-digit hex range


def undersample_items(items: DataFrame, min_items: int, seed: int = 42) -> DataFrame:
    """Items of the scenarios with at least ``min_items``, each scenario cut at
    random to the smallest kept size.  Empty when fewer than two qualify."""
    kept = large_groups(items, min_items)
    target = kept.agg(F.when(F.count(F.lit(1)) >= 2, F.min("n_items")).otherwise(0)).scalar()
    pool = items.join(kept.select("scenario"), "scenario", "left_semi")
    return (hash_positions(pool, ["item"], seed, ["scenario"])
            .filter(F.col("position") <= target).drop("position"))


def undersample(responses: DataFrame, items: DataFrame, takers: DataFrame,
                min_items: int, seed: int = 42):
    """Balanced study: sampled items, their cells, and the takers with any cell."""
    chosen = undersample_items(items, min_items, seed)
    cells = responses.join(chosen.select("item"), "item", "left_semi")
    return cells, chosen, takers_with_answers(takers, cells)


def exact_split(cells: DataFrame, test_share: float = 0.2, seed: int = 42) -> DataFrame:
    """Exactly ``floor(share * n)`` cells are test, chosen in hash order."""
    n = cells.agg(F.count(F.lit(1))).scalar()
    size = F.floor(n * F.lit(test_share))
    return (hash_positions(cells, ["taker", "item"], seed)
            .withColumn("split", F.when(F.col("position") <= size, "test").otherwise("train"))
            .drop("position"))


def bernoulli_split(cells: DataFrame, seed: int = 42) -> DataFrame:
    """Each cell is train with probability 0.8, decided by its own hash."""
    digits = F.substring(hash_text(["taker", "item"], seed), 1, 8)
    return cells.withColumn("split", F.when(digits < TRAIN_BELOW, "train").otherwise("test"))


def split_coverage(split_cells: DataFrame, items: DataFrame, takers: DataFrame) -> DataFrame:
    """Smallest train and test counts over takers and items, one row per split."""
    parts = [coverage(split_cells.filter(F.col("split") == s), items, takers)
             .withColumn("split", F.lit(s)) for s in ("train", "test")]
    return parts[0].unionByName(parts[1])


def valid_split(cells: DataFrame, items: DataFrame, takers: DataFrame, seed: int = 42,
                need_test: bool = False, max_tries: int = 20) -> tuple[DataFrame, int]:
    """Redraw with the next seed until every taker and item has a train cell (and a
    test cell, if asked).  Only the four counts of each try reach the driver."""
    wanted = ("train", "test") if need_test else ("train",)
    for tried in range(seed, seed + max_tries):
        split = bernoulli_split(cells, tried)
        checks = split_coverage(split, items, takers).collect()
        if all(row["valid"] for row in checks if row["split"] in wanted):
            return split, tried
    raise ValueError(f"no valid split in {max_tries} tries from seed {seed}")


def stratified_items(items: DataFrame, n_items: int, seed: int = 42) -> DataFrame:
    """An even number of items per scenario, topped up at random to ``n_items``."""
    scenarios = items.select("scenario").distinct().agg(F.count(F.lit(1))).scalar()
    quota = F.floor(F.lit(n_items) / scenarios)
    staged = cut_lineage(hash_positions(items, ["item"], seed, ["scenario"], "_place")
                         .withColumn("_first", F.col("_place") <= quota))
    first = staged.filter("_first")
    missing = F.lit(n_items) - first.agg(F.count(F.lit(1))).scalar()
    extra = (hash_positions(staged.filter("NOT _first"), ["item"], seed)
             .filter(F.col("position") <= missing))
    return first.select(*items.columns).unionByName(extra.select(*items.columns))


def random_items(items: DataFrame, n_items: int, seed: int = 42) -> DataFrame:
    """``n_items`` at random: an ordered limit, cut per task before it is merged."""
    return (items.withColumn("_hash", hash_text(["item"], seed))
            .orderBy("_hash", "item").limit(n_items).drop("_hash"))

"""Projection, reshaping and item metadata."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from itemspark.operators.choose import first_per_key
from itemspark.session import cut_lineage


def level_values(items: DataFrame, level: str) -> DataFrame:
    """Distinct labels with the first item that carries each."""
    return items.groupBy(level).agg(F.min("item").alias("first_item"))


def level_profile(items: DataFrame, levels: list[str]) -> DataFrame:
    return items.agg(*[F.countDistinct(x).alias(f"n_{x}") for x in levels])


def label_list(df: DataFrame, column: str, limit: int = 4096) -> list:
    """Sorted distinct labels, on the driver; refused above ``limit``."""
    rows = df.select(column).distinct().limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"{column} has more than {limit} values; keep the table long")
    return sorted(r[0] for r in rows)


def to_long(wide: DataFrame, keys: list[str], column: str, value: str) -> DataFrame:
    """Wide to long; missing cells get no row."""
    measured = [c for c in wide.columns if c not in keys]
    return wide.unpivot(keys, measured, column, value).filter(F.col(value).isNotNull())


def to_wide(long: DataFrame, key: str, column: str, value: str) -> DataFrame:
    """Long to wide over a checked short list of columns."""
    return long.groupBy(key).pivot(column, label_list(long, column)).agg(F.first(value))


def dense_rows(responses: DataFrame, items: DataFrame, takers: DataFrame,
               block: int = 1024) -> DataFrame:
    """The matrix with missing cells filled in: one row per item and taker block,
    holding arrays of at most ``block`` values in taker order.

    Encodings: ``present`` 0/1, ``minus_one`` (missing = -1), ``zero``.
    """
    from itemspark.operators.ranks import positions
    numbered = cut_lineage(
        positions(takers.select("taker"), [F.col("taker")], name="place")
        .select("taker", F.expr(f"(place - 1) div {block}").alias("block"),
                ((F.col("place") - 1) % block).cast("int").alias("slot")))
    widths = numbered.groupBy("block").agg(F.count(F.lit(1)).cast("int").alias("width"))
    known = (responses.filter("y IS NOT NULL").join(numbered, "taker").groupBy("item", "block")
             .agg(F.map_from_entries(F.collect_list(F.struct("slot", "y"))).alias("cells")))
    blocks = widths.agg(F.collect_list(F.struct("block", "width")))
    grid = (items.select("item", F.explode(blocks.scalar()).alias("_b"))
            .select("item", "_b.*").join(known, ["item", "block"], "left"))
    slots = F.sequence(F.lit(0), F.col("width") - 1)
    answer = F.transform(slots, lambda s: F.try_element_at(F.col("cells"), s))
    return (grid.withColumn("answers", answer)
            .select("item", "block",
                    F.transform("answers", lambda y: y.isNotNull().cast("int")).alias("present"),
                    F.transform("answers", lambda y: F.coalesce(y.cast("int"), F.lit(-1)))
                     .alias("minus_one"),
                    F.transform("answers", lambda y: F.coalesce(y.cast("int"), F.lit(0)))
                     .alias("zero")))


def one_hot(df: DataFrame, column: str, names: list[str]) -> DataFrame:
    return df.select("*", *[(F.col(column) == n).cast("int").alias(n) for n in names])


def multi_one_hot(df: DataFrame, column: str) -> DataFrame:
    """One 0/1 column per distinct tag of an array column, in name order."""
    tags = label_list(df.select(F.explode(column).alias("tag")), "tag")
    return df.select("*", *[F.array_contains(column, t).cast("int").alias(t) for t in tags])


def runs(df: DataFrame, position: str, label: str, groups: list[str]) -> DataFrame:
    """Runs of equal neighbouring labels: first, last and middle position.

    Gaps and islands without one global window: the previous label is looked up
    by position, run starts are numbered over slices, and a run ends before the
    next start.
    """
    from itemspark.operators.ranks import positions
    keyed = df.select(*groups, position, label)
    previous = keyed.select(*groups, (F.col(position) + 1).alias(position),
                            F.col(label).alias("_previous"))
    starts = (keyed.join(previous, groups + [position], "left")
              .filter(F.col("_previous").isNull() | (F.col("_previous") != F.col(label)))
              .select(*groups, F.col(position).alias("start"), label))
    numbered = positions(starts, [F.col("start")], groups, "run")
    following = numbered.select(*groups, (F.col("run") - 1).alias("run"),
                                (F.col("start") - 1).alias("_end"))
    last = keyed.groupBy(*groups).agg(F.max(position).alias("_last"))
    joined = numbered.join(following, groups + ["run"], "left")
    joined = (joined.join(last, groups) if groups
              else joined.withColumn("_last", last.scalar()))
    end = F.coalesce("_end", "_last")
    return joined.select(*groups, "run", label, "start", end.alias("end"),
                         ((F.col("start") + end) / 2).alias("middle"))


def lookup_last(table: DataFrame, key: str, value: str, position: str) -> DataFrame:
    """A dictionary built row by row: the last duplicate of a key wins."""
    return table.groupBy(key).agg(F.max_by(value, position).alias(value))


def lookup_first(df: DataFrame, table: DataFrame, key: str, value: str, order: str,
                 default) -> DataFrame:
    """Left lookup of the first match, with a default for unknown keys."""
    once = first_per_key(table.select(key, value, order), key, [F.col(order)])
    return (df.join(once.select(key, value), key, "left")
            .withColumn(value, F.coalesce(value, F.lit(default))))


def gather(responses: DataFrame, selection: DataFrame) -> DataFrame:
    """Columns by id list: an item chosen for two components appears twice, each
    time under its own ``position``."""
    return (responses.join(selection.select("position", "item", "component"), "item")
            .select("taker", "position", "item", "component", "y"))


def selection_positions(chosen: DataFrame) -> DataFrame:
    """Number a selection from 0 in component and item order."""
    from itemspark.operators.ranks import positions
    order = [F.col("component"), F.col("pole"), F.col("item")]
    return positions(chosen, order, name="_p").withColumn("position", F.col("_p") - 1).drop("_p")


def zero_filled(responses: DataFrame, items: DataFrame, takers: DataFrame) -> DataFrame:
    """Every taker and item as a cell, missing answers as 0: long rows of the full matrix."""
    blocks = dense_rows(responses, items, takers)
    from itemspark.operators.ranks import positions
    places = positions(takers.select("taker"), [F.col("taker")], name="place").select(
        "taker", F.expr("(place - 1) div 1024").alias("block"),
        ((F.col("place") - 1) % 1024).cast("int").alias("slot"))
    cells = blocks.select("item", "block", F.posexplode("zero").alias("slot", "y"))
    return cells.join(places, ["block", "slot"]).select("taker", "item", "y")

"""RDDs whose rows stay where they are: dealt once by key, kept, and stored now and then."""

from __future__ import annotations

from pyspark import RDD, StorageLevel
from pyspark.sql import SparkSession

from itemspark.session import staging_path

STORED = 10                 # steps after which the state is stored in the shared folder


def own_part(key: tuple) -> int:
    """The partition of a key: its first entry."""
    return key[0]


def dealt(rows: RDD, parts: int) -> RDD:
    """Rows in the partition that their key names, kept there."""
    return rows.partitionBy(parts, own_part).map(lambda row: row, preservesPartitioning=True).persist(
        StorageLevel.MEMORY_AND_DISK)


def without_shuffles(done: RDD) -> None:
    """Removes the shuffle files that ``done`` was computed from, back to what is kept; a
    lost part is computed again from there."""
    done._jrdd.rdd().cleanShuffleDependencies(False)


def stored(state: RDD, spark: SparkSession, name: str) -> tuple[RDD, str]:
    """The state, read back from the shared folder, and its path: lost executors cost a few steps."""
    path = staging_path(spark, name)
    state.saveAsPickleFile(path)
    again = dealt(state.context.pickleFile(path), state.getNumPartitions())
    again.count()
    without_shuffles(again)
    state.unpersist()
    return again, path

"""Shared storage of a job: where lineage is cut and staged tables are kept."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_DIR = "spark.checkpoint.dir"


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``.

    A local session without the setting gets a temporary folder of its own; a
    cluster session without it is refused, as a machine-local folder would be
    lost together with the executor that wrote to it.
    """
    context = spark.sparkContext
    folder = spark.conf.get(CHECKPOINT_DIR, None) or context.getConf().get(CHECKPOINT_DIR)
    if folder:
        return folder
    if context.getCheckpointDir() is None:
        if not context.master.startswith("local"):
            raise RuntimeError(f"set {CHECKPOINT_DIR} to a folder that all executors can reach")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="itemspark-"))
    return context.getCheckpointDir()


def staging_path(spark: SparkSession, name: str) -> str:
    """A fresh path for a table written by this application."""
    return f"{_staging_root(spark)}/{uuid.uuid4().hex}-{name}"


def _staging_root(spark: SparkSession) -> str:
    return f"{shared_folder(spark).rstrip('/')}/itemspark/{spark.sparkContext.applicationId}"


def cut_lineage(df: DataFrame, name: str = "step") -> DataFrame:
    """Write ``df`` to the shared folder and continue from the written table.

    A table (rather than an RDD checkpoint) is read back with its true size, so
    the next join is planned on facts: small parameters are broadcast below
    Spark's limit and shuffled above it.  It also survives lost executors.
    """
    path = staging_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def above(table: DataFrame, limit: int) -> bool:
    """Whether the table has more rows than ``limit``, without counting them all."""
    return table.limit(limit + 1).count() > limit


_NAMED: dict[str, list[str]] = {}


def remember_table(spark: SparkSession, name: str) -> None:
    """Note a catalog table whose files lie among the staged ones, to be dropped with them."""
    _NAMED.setdefault(spark.sparkContext.applicationId, []).append(name)


def drop_staged(spark: SparkSession, path: str) -> bool:
    """Remove a staged table that nothing will read again."""
    found = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return found.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(found, True)


def drop_staged_tables(spark: SparkSession) -> bool:
    """Remove the tables this application staged; call it when all results are stored."""
    for name in _NAMED.pop(spark.sparkContext.applicationId, []):
        spark.sql(f"DROP TABLE IF EXISTS {name}")
    return drop_staged(spark, _staging_root(spark))

import pytest
from pyspark.sql import functions as F

from itemspark import session
from itemspark.schema import ITEMS
from itemspark.sources import readers, writers


def test_number_file_keeps_its_order_over_files_and_splits(spark):
    path = session.staging_path(spark, "numbers")
    table = spark.range(0, 3000).select(F.col("id"), (F.col("id") / 8).alias("v"))
    writers.write_numbers(table.repartition(5, F.rand(1)), "v", [F.col("id")], path)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")       # many splits per file
    try:
        got = readers.read_number_matrix(spark, path, 6)
        wrong = got.filter(F.abs(F.col("value") - (F.col("taker") * 6 + F.col("dim")) / 8) > 1e-6)
        assert got.count() == 3000 and wrong.count() == 0
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_value_column_gets_item_positions(spark):
    path = session.staging_path(spark, "values")
    writers.write_csv(spark.range(50).select((F.col("id") * 2.5).alias("a")).coalesce(1), path, header=False)
    got = {r.item: r.a for r in readers.read_value_column(spark, path, "a").collect()}
    assert got == {i: i * 2.5 for i in range(50)}


def test_csv_with_quotes_and_commas(spark, items):
    path = session.staging_path(spark, "items")
    odd = items.withColumn("input_text", F.concat(F.lit('say "hi", '), "input_text")).select(*ITEMS.names)
    writers.write_csv(odd, path)
    back = readers.read_csv(spark, path, ITEMS)
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, odd.collect()))


def test_cells_by_scenario_prune_on_read(spark, cells, items):
    path = session.staging_path(spark, "cells")
    table = cells[1].join(items.select("item", "scenario"), "item")
    writers.write_cells(table, path)
    one = spark.read.parquet(path).filter("scenario = 'big'")
    assert "PartitionFilters: [isnotnull(scenario" in one._jdf.queryExecution().toString()
    assert one.count() == table.filter("scenario = 'big'").count()
    writers.expect(spark.read.parquet(path).select(*table.columns), table)


def test_staged_tables_are_removed(spark):
    path = session.staging_path(spark, "x")
    assert spark.sparkContext.applicationId in path and path != session.staging_path(spark, "x")


def test_shared_folder_follows_the_session(spark):
    named = spark.conf.get(session.CHECKPOINT_DIR, None)
    if named:
        assert session.shared_folder(spark) == named


class FakeContext:
    """Just the calls that ``shared_folder`` makes."""

    def __init__(self, master, folder=None):
        self.master, self.folder = master, folder
        self.sparkContext = self.conf = self

    def get(self, key, default=None):
        return default

    def getConf(self):
        return self

    def getCheckpointDir(self):
        return self.folder

    def setCheckpointDir(self, folder):
        self.folder = folder + "/inner"


def test_shared_folder_without_the_setting():
    local = FakeContext("local[2]")
    assert session.shared_folder(local) == session.shared_folder(local) == local.folder
    with pytest.raises(RuntimeError):
        session.shared_folder(FakeContext("spark://host:7077"))
    assert session.shared_folder(FakeContext("yarn", "hdfs:///shared")) == "hdfs:///shared"


def test_line_numbers_follow_part_numbers(spark, tmp_path):
    """Part 100000 comes after part 99999."""
    for name, lines in (("part-99999", "0\n1\n"), ("part-100000", "2\n3\n")):
        (tmp_path / f"{name}-a1b2.txt").write_text(lines)
    got = readers.numbered_lines(spark.read.text(str(tmp_path))).collect()
    assert {r["position"]: r["value"] for r in got} == {i: str(i) for i in range(4)}


def test_title_words(spark):
    from itemspark.functions.scalars import title_words
    labels = ["gsm8k", "math-algebra", "dyck_language", "MMLU", "", "a'b c", None]
    got = spark.createDataFrame([(x,) for x in labels], "x string").select(title_words(F.col("x"))).collect()
    assert [r[0] for r in got] == [None if x is None else x.replace("_", " ").title() for x in labels]

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from itemspark.operators import clean, qmatrix, reshape, sample, score


def wide(y):
    return pd.DataFrame(y, index=range(100, 140))


def test_scenario_scores_count_missing_as_wrong(cells, items, takers):
    y, table = cells
    labels = {r.item: r.scenario for r in items.collect()}
    filled = wide(y).fillna(0).T.groupby(labels).mean().T
    got = score.scenario_scores(table, items, takers).toPandas().pivot(
        index="taker", columns="scenario", values="p")
    assert np.allclose(got.values, filled[got.columns].values)


def test_observed_means_skip_missing(cells, items):
    y, table = cells
    labels = {r.item: r.scenario for r in items.collect()}
    long = wide(y).T.assign(s=[labels[i] for i in range(60)]).melt(id_vars="s").dropna()
    want = long.groupby(["variable", "s"])["value"].mean()
    got = score.observed_means(table, items, "scenario").toPandas().set_index(["taker", "scenario"])["p"]
    assert np.allclose(got.sort_index().values, want.sort_index().values)


def test_taker_and_item_without_answers(spark, items, takers):
    table = spark.createDataFrame([(100, 0, 1)], "taker bigint, item bigint, y tinyint")
    counts = {r.taker: (r.correct, r.incorrect) for r in score.counts_per_taker(table, takers).collect()}
    assert counts[100] == (1, 0) and counts[101] == (0, 0)
    profile = {r.item: r for r in score.item_profile(table, items, score.taker_count(takers)).collect()}
    assert profile[0].missing_count == 39 and profile[1].missing_count == 40
    check = score.coverage(table, items, takers).first()
    assert check.min_per_taker == 0 and check.min_per_item == 0 and not check.valid
    assert clean.takers_with_answers(takers, table).count() == 1
    assert clean.takers_without_answers(takers, table).count() == 39
    with pytest.raises(ValueError):
        sample.valid_split(table, items, takers, max_tries=2)


def test_ingest_keeps_asked_cells_only(spark):
    raw = spark.createDataFrame([(1, 1, 0.0), (1, 2, float("nan")), (1, 3, float("inf")),
                                 (1, 4, float("-inf")), (1, 5, None), (1, 6, 1.0)],
                                "taker bigint, item bigint, y double")
    assert [(r.item, r.y) for r in clean.ingest(raw).orderBy("item").collect()] == [(1, 0), (6, 1)]


def test_membership_scores_give_zero_for_an_empty_factor(spark, cells, takers):
    members = spark.createDataFrame([(0, 0, 1), (1, 0, 1), (0, 1, 0), (1, 1, 0)],
                                    "item bigint, factor int, member int")
    got = score.membership_scores(cells[1], members, takers).toPandas()
    assert (got[got.factor == 1].p == 0).all()
    want = np.nan_to_num(cells[0][:, :2]).mean(1)
    assert np.allclose(got[got.factor == 0].sort_values("taker").p.values, want)


@pytest.mark.parametrize("strategy", ["mean", "median", "zero", "drop"])
def test_fill_missing(spark, strategy):
    frame = pd.DataFrame({"a": [1.0, np.nan, 3.0, 8.0], "b": [1.0, 2.0, 3.0, 4.0]})
    long = frame.melt(ignore_index=False).reset_index()
    long["value"] = long["value"].astype(object).where(long["value"].notna(), None)
    table = spark.createDataFrame(long.values.tolist(), "row int, variable string, value double")
    got = clean.fill_missing(table, "variable", "value", strategy).toPandas().pivot(
        index="row", columns="variable", values="value")
    want = {"mean": frame.fillna(frame.mean()), "median": frame.fillna(frame.median()),
            "zero": frame.fillna(0), "drop": frame.dropna(axis=1)}[strategy]
    assert np.allclose(got.values, want.values)


def test_unknown_strategy_is_an_error(spark):
    with pytest.raises(ValueError):
        clean.fill_missing(spark.range(1).selectExpr("id AS c", "1.0D AS v"), "c", "v", "other")


def test_runs_of_labels(spark):
    table = spark.createDataFrame(list(enumerate("AABBBA")), "position bigint, label string")
    got = [(r.label, r.start, r.end, r.middle) for r in
           reshape.runs(table, "position", "label", []).orderBy("run").collect()]
    assert got == [("A", 0, 1, 0.5), ("B", 2, 4, 3.0), ("A", 5, 5, 5.0)]


def test_dense_rows_over_several_blocks(cells, items, takers):
    y, table = cells
    rows = reshape.dense_rows(table, items, takers, block=16).toPandas()
    assert rows.block.nunique() == 3
    full = np.vstack([np.concatenate(part.sort_values("block").minus_one.tolist())
                      for _, part in rows.groupby("item")])
    assert np.array_equal(full, np.nan_to_num(y.T, nan=-1.0).astype(int))


def test_zero_filled_has_every_cell(cells, items, takers):
    got = reshape.zero_filled(cells[1], items, takers)
    assert got.count() == 40 * 60
    assert got.agg(F.sum("y")).first()[0] == int(np.nansum(cells[0]))


def test_last_duplicate_wins(spark):
    table = spark.createDataFrame([("q", "old", 1), ("q", "new", 5), ("r", "one", 2)],
                                  "k string, v string, pos int")
    got = {r.k: r.v for r in reshape.lookup_last(table, "k", "v", "pos").collect()}
    assert got == {"q": "new", "r": "one"}


def test_gather_keeps_an_item_of_two_components(spark, cells):
    selection = spark.createDataFrame([(0, 3, "x"), (1, 3, "y"), (2, 4, "y")],
                                      "position bigint, item bigint, component string")
    got = reshape.gather(cells[1], selection)
    n3, n4 = (int((~np.isnan(cells[0][:, i])).sum()) for i in (3, 4))
    assert got.count() == 2 * n3 + n4


def test_wide_round_trip(spark):
    long = spark.createDataFrame([(1, "a", 1.0), (1, "b", 2.0), (2, "a", 3.0)],
                                 "taker bigint, scenario string, p double")
    back = reshape.to_long(reshape.to_wide(long, "taker", "scenario", "p"), ["taker"], "scenario", "p")
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, long.collect()))


def test_exact_split_size_and_undersampling(cells, items, takers):
    y, table = cells
    split = sample.exact_split(table)
    n = int((~np.isnan(y)).sum())
    sizes = {r.split: r["count"] for r in split.groupBy("split").count().collect()}
    assert sizes == {"test": int(0.2 * n), "train": n - int(0.2 * n)}
    chosen = sample.undersample_items(items, 6)
    counts = {r.scenario: r["count"] for r in chosen.groupBy("scenario").count().collect()}
    smallest = min(v for v in (40, 7, 7, 6))
    assert set(counts.values()) == {smallest}
    assert sample.undersample_items(items, 30).count() == 0        # fewer than two scenarios


def test_stratified_items_reach_the_total(items):
    got = sample.stratified_items(items, 33)
    counts = {r.scenario: r["count"] for r in got.groupBy("scenario").count().collect()}
    assert sum(counts.values()) == 33 and min(counts.values()) >= 6
    assert got.select("item").distinct().count() == 33


def test_every_item_has_exactly_one_code(spark):
    items = spark.createDataFrame([(1, "s", "b"), (2, "s", None), (3, "t", "b")], "item long, scenario string, benchmark string")
    codes = qmatrix.scenario_codes(items)
    assert {r["item"]: r["code"] for r in qmatrix.coded(items, codes).collect()} == {1: 0, 2: 1, 3: 2}
    for wrong, message in ((codes.where("code <> 2"), "0 codes for t / b"), (codes.union(codes.where("code = 1")), "2 codes for s / null")):
        with pytest.raises(Exception, match=message):
            qmatrix.coded(items, wrong).collect()
    assert qmatrix.coded(items.limit(0), codes).count() == 0


def joins(df):
    return df._jdf.queryExecution().sparkPlan().toString()


def test_grid_is_never_broadcast(spark, cells, items, takers, tmp_path):
    """A grid of takers and labels looks as small as the takers' file, but isn't."""
    for name, table in (("takers", takers), ("items", items), ("cells", cells[1])):
        table.write.parquet(f"{tmp_path}/{name}")
    takers, items, table = (spark.read.parquet(f"{tmp_path}/{n}") for n in ("takers", "items", "cells"))
    grid = score.level_grid(takers, items).drop("n_items")
    seen = score.observed_means(table, items, "scenario")
    plan = joins(grid.join(seen, ["taker", "scenario"], "left").filter("p IS NOT NULL"))
    assert "SortMergeJoin" in plan
    assert joins(score.subscores(table, items.withColumnRenamed("benchmark", "component"), takers)).count("SortMergeJoin") == 1


def test_many_items_are_not_broadcast(spark, cells, items, monkeypatch):
    """Items above the row limit are merged however small their file; the rows are the same."""
    few = score.with_items(cells[1], items, "scenario")
    monkeypatch.setattr(score, "BROADCAST_ROWS", 10)
    many = score.with_items(cells[1], items, "scenario")
    assert "SortMergeJoin" in joins(many) and "Broadcast" not in joins(many)
    assert sorted(map(tuple, many.collect())) == sorted(map(tuple, few.collect()))

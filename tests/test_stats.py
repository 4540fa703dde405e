import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from itemspark.operators import similar, stats


def test_correlations_with_missing_cells_match_pandas(spark):
    rng = np.random.default_rng(3)
    frame = pd.DataFrame(rng.normal(1000.0, 1.0, size=(200, 7)), columns=list("abcdefg"))
    frame["b"] += 2 * frame["a"]
    frame = frame.mask(rng.random(frame.shape) < 0.3)
    frame["g"] = 5.0                                           # constant
    long = frame.melt(ignore_index=False).reset_index().dropna()
    table = spark.createDataFrame(long, "row int, c string, v double").repartition(5)
    got = stats.correlations(table, "row", "c", "v").toPandas().pivot(index="v1", columns="v2", values="r")
    assert np.allclose(got.values.astype(float), frame.corr().values, equal_nan=True)


def test_spearman_matches_pandas(spark):
    rng = np.random.default_rng(4)
    frame = pd.DataFrame(rng.integers(0, 6, size=(150, 4)), columns=list("abcd")).astype(float)
    table = spark.createDataFrame(frame.melt(ignore_index=False).reset_index(), "row int, c string, v double")
    got = stats.correlations(table, "row", "c", "v", "spearman").toPandas().pivot(
        index="v1", columns="v2", values="r")
    assert np.allclose(got.values, frame.rank().corr().values)


def test_cross_spearman_ranks_within_common_rows(spark):
    rng = np.random.default_rng(5)
    left = pd.DataFrame({"row": range(80), "l": "x", "a": rng.integers(0, 9, 80) / 1.0})
    right = pd.DataFrame({"row": range(30, 110), "k": "y", "b": rng.integers(0, 9, 80) / 1.0})
    got = stats.cross_correlations(spark.createDataFrame(left), spark.createDataFrame(right),
                                   "row", "l", "a", "k", "b", "spearman").first().r
    both = left.merge(right, on="row")
    assert got == pytest.approx(both.a.rank().corr(both.b.rank()))


def brute_auc(scores, labels):
    pos, neg = scores[labels == 1], scores[labels == 0]
    wins = (pos[:, None] > neg[None, :]).sum() + 0.5 * (pos[:, None] == neg[None, :]).sum()
    return wins / (len(pos) * len(neg))


def test_auc_with_ties_groups_and_monotone_maps(spark):
    rng = np.random.default_rng(6)
    frame = pd.DataFrame({"g": rng.integers(0, 3, 900), "y": rng.integers(0, 2, 900),
                          "score": np.where(rng.random(900) < 0.4, 0.5, rng.integers(0, 40, 900) / 40)})
    frame = pd.concat([frame, pd.DataFrame({"g": [9, 9], "y": [1, 1], "score": [0.1, 0.2]})])
    table = spark.createDataFrame(frame).repartition(7)
    got = {r.g: r.auc for r in stats.auc(table, groups=["g"]).collect()}
    for g, part in frame[frame.g < 9].groupby("g"):
        assert got[g] == pytest.approx(brute_auc(part.score.values, part.y.values))
    assert got[9] is None
    whole = stats.auc(table).first().auc
    assert whole == pytest.approx(brute_auc(frame.score.values, frame.y.values))
    assert stats.auc(table.withColumn("score", F.exp("score") * 3)).first().auc == pytest.approx(whole)


def test_alpha_is_one_for_identical_items(spark, takers):
    rows = [(100 + t, i, t % 2) for t in range(40) for i in range(4)]
    responses = spark.createDataFrame(rows, "taker bigint, item bigint, y tinyint")
    selection = spark.createDataFrame([(i, "same") for i in range(4)] + [(0, "single")],
                                      "item bigint, component string")
    got = {r.component: r.alpha for r in stats.cronbach_alpha(responses, selection, takers).collect()}
    assert got["same"] == pytest.approx(1.0) and got["single"] is None


def test_alpha_matches_the_covariance_formula(spark, cells, takers):
    y, table = cells
    selection = spark.createDataFrame([(i, "c") for i in range(10)], "item bigint, component string")
    cov = np.cov(np.nan_to_num(y[:, :10]), rowvar=False)
    want = 10 / 9 * (1 - np.trace(cov) / cov.sum())
    assert stats.cronbach_alpha(table, selection, takers).first().alpha == pytest.approx(want)


def test_fit_indices(spark):
    table = spark.createDataFrame([(1, 0.8), (0, 0.3), (1, 0.5)], "y int, score double")
    got = stats.fit_indices(table, F.lit(78712), F.lit(183), 2).first()
    ll = math.log(0.8) + math.log(0.7) + math.log(0.5)
    k = 78712 * 3 + 183 * 2
    assert got.k == k and got.AIC == pytest.approx(2 * k - 2 * ll)
    assert got.BIC == pytest.approx(k * math.log(3) - 2 * ll)


def test_correlated_pairs_of_many_takers_match_blocks(spark, monkeypatch):
    """Joined answers and blocks give the same pairs; with a taker listed twice, joined
    answers give the pairs of the query's SQL."""
    monkeypatch.setattr(similar, "TASK_PAIRS", 300)
    rng = np.random.default_rng(3)
    n, m = 60, 90
    x = (rng.random((n, m)) < rng.uniform(0.02, 0.98, m)).astype(int)
    x[:, 10], x[:, 20] = x[:, 3], 1 - x[:, 4]
    x[:, 80], x[:, 81] = np.arange(n) < 32, np.arange(n) >= 32
    taker, item = np.nonzero(x)
    responses = spark.createDataFrame(pd.DataFrame({"taker": taker, "item": item, "y": 1}), "taker bigint, item bigint, y tinyint")

    def pairs(people, threshold, sparse):
        return {(r.v1, r.v2): r.r for r in similar.correlated_pairs(responses, people, threshold, 7, 16, sparse).collect()}

    for threshold in (0.3, 0.95):
        got, want = (pairs(spark.range(n).toDF("taker"), threshold, sparse) for sparse in (True, False))
        assert set(got) == set(want) and (3, 10) in got and (80, 81) in got
        assert all(got[k] == pytest.approx(want[k]) for k in want)
    got = pairs(spark.createDataFrame([(i,) for i in [*range(n), 5]], "taker bigint"), 0.3, True)
    a, total = x.sum(0), n + 1
    with np.errstate(invalid="ignore", divide="ignore"):
        r = (total * (x.T @ x) - np.outer(a, a)) / np.sqrt(np.outer(a * (total - a), a * (total - a)))
    want = {(i, j): r[i, j] for i in range(m) for j in range(i + 1, m) if abs(r[i, j]) > 0.3}
    assert set(got) == set(want) and all(got[k] == pytest.approx(want[k]) for k in want)


def test_correlated_pairs_choose_joined_answers(spark, monkeypatch):
    """Sparse answers of more takers than a slice aren't compared item by item."""
    monkeypatch.setattr(similar, "positions", lambda *a, **k: pytest.fail("blocks of items"))
    responses = spark.range(2000).selectExpr("id % 500 AS taker", "id div 4 AS item", "1Y AS y").unionByName(
        spark.range(3).selectExpr("id AS taker", "1000 AS item", "1Y AS y")).unionByName(
        spark.range(3).selectExpr("id AS taker", "1001 AS item", "1Y AS y"))
    got = similar.correlated_pairs(responses, spark.range(500).toDF("taker"), 0.95, width=100).collect()
    assert (1000, 1001) in {(r.v1, r.v2) for r in got}


@pytest.mark.parametrize("threshold,width", [(0.95, 4096), (0.6, 4096), (0.3, 4096), (0.6, 16)])
def test_correlated_pairs_match_brute_force(spark, threshold, width):
    rng = np.random.default_rng(8)
    n, m = 60, 90
    x = (rng.random((n, m)) < rng.uniform(0.02, 0.98, m)).astype(int)
    x[:, 10] = x[:, 3]                                          # identical
    x[:, 20] = 1 - x[:, 4]                                      # reversed
    x[:, 30:60] = np.where(rng.random((n, 30)) < 0.03, 1 - x[:, [5]], x[:, [5]])   # a hot class
    x[:, 70], x[:, 71] = 0, 1                                   # constant
    x[:, 80], x[:, 81] = np.arange(n) < 32, np.arange(n) >= 32  # never right together
    taker, item = np.nonzero(np.ones_like(x))
    responses = spark.createDataFrame(pd.DataFrame({"taker": taker, "item": item, "y": x[taker, item]}),
                                      "taker bigint, item bigint, y tinyint")
    people = spark.range(n).toDF("taker")
    got = {(r.v1, r.v2): r.r for r in similar.correlated_pairs(responses, people, threshold, 7, width).collect()}
    with np.errstate(invalid="ignore", divide="ignore"):
        r = np.corrcoef(x, rowvar=False)
    want = {(i, j): r[i, j] for i in range(m) for j in range(i + 1, m) if abs(r[i, j]) > threshold}
    assert set(got) == set(want) and (3, 10) in got and (80, 81) in got and got[(4, 20)] == pytest.approx(-1)
    assert all(got[k] == pytest.approx(want[k]) for k in want)
    flags = similar.drop_correlated(spark.range(m).toDF("item"), similar.correlated_pairs(
        responses, people, threshold, 7, width))
    assert {r.item for r in flags.filter("dropped").collect()} == {j for _, j in want}

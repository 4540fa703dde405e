import numpy as np
import pytest

from itemspark.operators import cluster


def plain(points, labels):
    d = np.sqrt(((points[:, None] - points[None]) ** 2).sum(-1))
    out = []
    for i, own in enumerate(labels):
        rest = [d[i, [j for j in range(len(labels)) if labels[j] == c and j != i]] for c in sorted(set(labels))]
        mine = rest[sorted(set(labels)).index(own)]
        b = min(r.mean() for c, r in zip(sorted(set(labels)), rest) if c != own)
        a = mine.mean() if len(mine) else None
        out.append(0.0 if a is None or max(a, b) == 0 else (b - a) / max(a, b))
    return float(np.mean(out))


@pytest.mark.parametrize("block_rows, group", [(2048, 16), (40, 2)])
def test_plain_silhouette_equals_brute_force(spark, monkeypatch, block_rows, group):
    """500 points, one cluster with two thirds of them, a lone point, exact repeats."""
    monkeypatch.setattr(cluster, "GROUP", group)
    rng = np.random.default_rng(4)
    labels = rng.choice(["a", "a", "a", "a", "b", "c"], 499).tolist() + ["alone"]
    points = rng.normal(size=(500, 3)) + 1000 + 2 * np.array([[ord(x[-1]) - 97] for x in labels])
    points[100:150] = points[100]
    rows = [(x, *map(float, p)) for x, p in zip(labels, points)]
    rows += [(None, 1.0, 1.0, 1.0), ("b", None, 1.0, 1.0), ("b", float("nan"), 1.0, 1.0)]
    frame = spark.createDataFrame(rows, "cluster string, f1 double, f2 double, f3 double")
    got = cluster.euclidean_silhouette(frame, ["f1", "f2", "f3"], block_rows).first()[0]
    assert got == pytest.approx(plain(points, labels), abs=1e-9)


def test_plain_silhouette_needs_two_clusters(spark):
    frame = spark.createDataFrame([(1, 0.5), (1, 0.7)], "cluster int, f1 double")
    assert cluster.euclidean_silhouette(frame, ["f1"]).first()[0] is None
    assert cluster.euclidean_silhouette(frame.limit(0), ["f1"]).first()[0] is None
    same = spark.createDataFrame([(1, 0.5), (1, 0.5), (2, 0.5), (2, 0.5)], "cluster int, f1 double")
    assert cluster.euclidean_silhouette(same, ["f1"]).first()[0] == 0


def test_both_measures_choose_the_true_count(spark):
    rng = np.random.default_rng(6)
    points = np.concatenate([rng.normal(size=(40, 2)) * 0.2 + c for c in ((0, 0), (5, 0), (0, 5))])
    frame = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(points)], "item int, f1 double, f2 double")
    for squared in (True, False):
        scores = cluster.silhouettes(frame, ["f1", "f2"], range(2, 5), squared=squared)
        assert cluster.best_count(scores).first()["k"] == 3

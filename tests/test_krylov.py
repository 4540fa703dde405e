import numpy as np
import pytest

from itemspark.operators import krylov


@pytest.mark.parametrize("centred", [False, True])
def test_close_singular_values_over_blocks_parts_and_restarts(spark, monkeypatch, centred):
    rng = np.random.default_rng(3)
    x = (rng.random((90, 200)) < 0.2).astype(float)
    monkeypatch.setattr(krylov, "BLOCK", 40)
    monkeypatch.setattr(krylov, "SENT", 8 * 90 * 2)         # two columns at once
    taker, item = np.nonzero(x)
    right = spark.createDataFrame(list(zip((taker + 7).tolist(), item.tolist())), "taker bigint, item bigint")
    takers = spark.createDataFrame([(t,) for t in [*range(7, 97), 7, None]], "taker bigint")
    values, found = krylov.leading(right, takers, 3, centred, most_columns=1)
    a = x - x.mean(0) if centred else x
    u, s, _ = np.linalg.svd(a, full_matrices=False)
    assert np.allclose(values, s[:3] ** 2)
    rows = sorted(tuple(r) for r in found.collect())
    assert [r[0] for r in rows] == list(range(7, 97))
    got = np.array(rows)[:, 1:]
    assert np.allclose(np.abs(got.T @ u[:, :3]), np.eye(3), atol=1e-4)


def test_beyond_the_rank_there_is_nothing(spark):
    right = spark.createDataFrame([(t, i) for t in range(6) for i in range(4) if (t + i) % 2], "taker bigint, item bigint")
    values, found = krylov.leading(right, spark.range(6).toDF("taker"), 3)
    assert np.allclose(values, [6.0, 6.0, 0.0])
    got = np.array(sorted(tuple(r) for r in found.collect()))[:, 1:]
    assert np.allclose(got.T @ got, np.diag([1, 1, 0]), atol=1e-8)


def test_a_step_is_one_job_that_shuffles_neither_answers_nor_basis(spark, monkeypatch):
    rng = np.random.default_rng(5)
    x = (rng.random((120, 150)) < 0.2).astype(float)
    x[:, 3] = 0.0                                           # an item nobody has right
    monkeypatch.setattr(krylov, "BLOCK", 50)
    monkeypatch.setattr(krylov, "SENT", 8 * 120 * 3)        # parts of three columns
    monkeypatch.setattr(krylov, "CHUNK", 40)
    taker, item = np.nonzero(x)
    right = spark.createDataFrame(list(zip(taker.tolist(), [None if i == 5 else i for i in item.tolist()])), "taker bigint, item bigint")
    places, begins = krylov.placed_takers(spark.range(120).toDF("taker"))
    stripes, n = krylov.stored_stripes(right, places)
    assert stripes.count() <= n                             # dealt once, kept from then on
    state = krylov.first_state(spark.sparkContext, begins, 7, False)
    turns, _, _ = krylov.orthonormal_turns(state, 7)
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("step", "one step")
    try:
        (found := krylov.next_state(state, stripes, n, begins, 7, turns, None)).count()
        jobs = tracker.getJobIdsForGroup("step")
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert len(jobs) == 1                                   # sent, added up, and the end
    assert sum(tracker.getStageInfo(s).numCompletedTasks > 0 for s in tracker.getJobInfo(jobs[0]).stageIds
               if tracker.getStageInfo(s)) == 3
    at = np.array([r["at"] for r in sorted(places.collect())])
    a = np.zeros_like(x)
    a[at] = x
    rows = dict(found.map(lambda row: (row[0][0], row[1][:2])).collect())
    z, image = (np.concatenate([rows[b][c] for b in sorted(rows)], axis=1) for c in (0, 1))
    assert np.allclose(z @ z.T, np.eye(7))
    assert np.allclose(image, z @ a @ a.T)


def test_more_columns_for_more_takers(spark):
    rng = np.random.default_rng(6)
    taker, item = np.nonzero(rng.random((600, 300)) < 0.1)
    seen = []
    plain = krylov.next_state
    right = spark.createDataFrame(list(zip(taker.tolist(), item.tolist())), "taker bigint, item bigint")
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(krylov, "next_state", lambda *a: seen.append(a[4]) or plain(*a))
        values, _ = krylov.leading(right, spark.range(600).toDF("taker"), 2)
    x = np.zeros((600, 300))
    x[taker, item] = 1
    assert np.allclose(values, np.linalg.svd(x, compute_uv=False)[:2] ** 2)
    assert set(seen) == {12}


def test_files_of_past_steps_are_removed(spark, monkeypatch):
    import os
    import re

    from itemspark import session
    from itemspark.operators import parts
    folders = list(spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString())

    def shuffles():
        return {m[1] for top in folders for _, _, names in os.walk(top) for x in names if (m := re.match(r"shuffle_(\d+)_", x))}

    rng = np.random.default_rng(8)
    taker, item = np.nonzero(rng.random((150, 160)) < 0.3)
    right = spark.createDataFrame(list(zip(taker.tolist(), item.tolist())), "taker bigint, item bigint")
    monkeypatch.setattr(krylov, "BLOCK", 30)
    monkeypatch.setattr(krylov, "STORED", 4)
    monkeypatch.setattr(parts, "staging_path", lambda s, name: paths.append(session.staging_path(s, name)) or paths[-1])
    plain, held, paths = krylov.next_state, [], []
    monkeypatch.setattr(krylov, "next_state", lambda *a: held.append(shuffles()) or plain(*a))
    values, _ = krylov.leading(right, spark.range(150).toDF("taker"), 3, extra=1, most_columns=1)
    x = np.zeros((150, 160))
    x[taker, item] = 1
    assert np.allclose(values, np.linalg.svd(x, compute_uv=False)[:3] ** 2)
    assert len(held) > 12 and len(paths) > 2
    assert len(held[-1] - held[1]) < 10                     # of two a step, and more for inner products
    assert not any(os.path.exists(p) for p in paths)

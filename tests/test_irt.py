import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from itemspark.operators import irt, sample, stats, vectors


@pytest.fixture(scope="module")
def factor_cells(spark):
    """120 takers, 200 items, 4 skills: each item needs mainly one; 60 % hidden."""
    rng = np.random.default_rng(0)
    theta = np.abs(rng.normal(size=(120, 4)))
    owner = np.arange(200) % 4
    logit = 2.5 * theta[:, owner] - rng.uniform(0.5, 3.0, 200)
    y = (rng.random((120, 200)) < 1 / (1 + np.exp(-logit))).astype("int8")
    taker, item = np.nonzero(rng.random((120, 200)) > 0.6)
    frame = pd.DataFrame({"taker": taker, "item": item, "y": y[taker, item]})
    table = spark.createDataFrame(frame, "taker bigint, item bigint, y tinyint").cache()
    qmatrix = spark.createDataFrame([(i, f"s{i % 4}") for i in range(200)], "item bigint, factor string")
    return theta, table, qmatrix, spark.range(120).toDF("taker"), spark.range(200).toDF("item")


def test_easiness_of_known_means(spark):
    table = spark.createDataFrame([(0, 7, 10), (1, 5, 10), (2, 0, 10), (3, 10, 10)],
                                  "item bigint, correct bigint, asked bigint")
    z = {r.item: r.z for r in irt.easiness_by_mean(table).collect()}
    assert z[0] == pytest.approx(1.0184, abs=2e-3) and z[1] == pytest.approx(0.0, abs=1e-9)
    assert z[2] < -11.9 and z[3] > 11.9
    check = spark.range(1).select(irt.expected_probability(F.lit(z[0])).alias("p")).first().p
    assert check == pytest.approx(0.7)


def test_one_parameter_model_maximises_each_taker(spark, cells):
    y, table = cells
    items, takers = irt.fit_one_parameter(table)
    z = items.orderBy("item").toPandas().z.values
    theta = takers.orderBy("taker").toPandas().theta.values
    p = 1 / (1 + np.exp(-(theta[:, None] + z[None, :])))
    gap = np.where(np.isnan(y), 0, np.nan_to_num(y) - p).sum(1) - 1e-3 * theta
    assert np.abs(gap).max() < 1e-6
    assert np.corrcoef(theta, np.nanmean(y, 1))[0, 1] > 0.9


def log_likelihood(cells, model):
    from itemspark.functions.scalars import log_likelihood as ll
    return irt.model_scores(cells, model).agg(F.sum(ll(F.col("y"), F.col("score")))).first()[0]


def test_confirmatory_model_recovers_skills(spark, factor_cells):
    theta, table, qmatrix, takers, _ = factor_cells
    names = ["s0", "s1", "s2", "s3"]
    masks = irt.qmatrix_masks(qmatrix, names)
    model = irt.start(table, takers, masks, 4, 0.0)
    values = [log_likelihood(table, model)]
    for _ in range(12):
        model = irt.taker_step(table, irt.item_step(table, model))
        values.append(log_likelihood(table, model))
    assert values[-1] > values[0] and np.all(np.diff(values[1:]) > -1.0)
    found = irt.theta_table(model, names).toPandas().pivot(index="taker", columns="component", values="theta")
    assert (found.values >= 0).all()
    for d, name in enumerate(names):
        assert np.corrcoef(pd.Series(found[name]).rank(), pd.Series(theta[:, d]).rank())[0, 1] > 0.7
    a = model.items.orderBy("item").toPandas()[vectors.dims("a", 4)].values
    assert (a[np.arange(200), np.arange(200) % 4] > 0).all()
    assert np.count_nonzero(a) == 200                                      # masked entries stay 0


def test_free_abilities_may_be_negative(spark, factor_cells):
    _, table, qmatrix, takers, _ = factor_cells
    masks = irt.qmatrix_masks(qmatrix, ["s0", "s1", "s2", "s3"])
    model = irt.fit_joint(table, takers, masks, 4, 1e-2, None)
    assert model.takers.toPandas()[vectors.dims("t", 4)].values.min() < 0


def test_nuisance_items_are_the_closed_form(spark, factor_cells):
    _, table, qmatrix, _, _ = factor_cells
    masks = irt.qmatrix_masks(qmatrix, ["s0", "s1", "s2", "s3"])
    one = irt.nuisance_items(table, masks, 4).filter("item = 5").first()
    n, s = table.filter("item = 5").agg(F.count("y"), F.sum("y")).first()
    m = (s + 0.5) / (n + 1)
    assert one.d == pytest.approx(np.log((1 - m) / m)) and one.a2 == pytest.approx(1e-6) and one.a1 == 0


def test_exploratory_sweep_shares_passes(spark, factor_cells):
    _, table, _, takers, items = factor_cells
    cells = sample.bernoulli_split(table)
    train = cells.filter("split = 'train'").select("taker", "item", "y")
    model = irt.fit_exploratory(train, items, takers, [2, 4], 1e-3)
    assert model.items.count() == 400 and model.takers.count() == 240
    small = model.items.filter("model = 2").toPandas()
    assert (small[["a3", "a4"]].values == 0).all() and (small[["a1", "a2"]].values >= 0).all()
    rows = {r.n_dimensions: r for r in irt.evaluate(cells, model, items, takers).collect()}
    assert set(rows) == {2, 4}
    for d, r in rows.items():
        assert r.train_auc > 0.7 and r.test_auc > 0.6
        k = 200 * (d + 1) + 120 * d
        assert r.AIC == pytest.approx(2 * k - 2 * r.log_likelihood)
        assert r.BIC == pytest.approx(k * np.log(train.count()) - 2 * r.log_likelihood)


def test_penalised_model_learns(spark, factor_cells):
    _, table, qmatrix, takers, _ = factor_cells
    cells = sample.bernoulli_split(table)
    masks = irt.qmatrix_masks(qmatrix, ["s0", "s1", "s2", "s3"])
    model, history = irt.fit_penalised(cells, takers, masks, 4)
    h = history.orderBy("epoch").toPandas()
    assert h.train_loss.is_monotonic_decreasing and h.test_auc.iloc[-1] > h.test_auc.iloc[0]
    _, _, value, _ = irt._penalty(model)
    cov = stats.covariances(irt.theta_table(model, list("abcd")), "taker", "component", "theta")
    assert stats.identity_distance(cov).first().distance == pytest.approx(value)


def test_full_grid_equals_cell_scores(spark, factor_cells):
    _, table, qmatrix, takers, _ = factor_cells
    model = irt.start(table, takers, irt.qmatrix_masks(qmatrix, ["s0", "s1", "s2", "s3"]), 4, 0.0)
    grid = irt.full_grid(model, block=33, salts=3)
    assert grid.count() == 120 * 200
    both = grid.join(irt.model_scores(table, model), ["taker", "item"])
    assert both.count() == table.count()
    assert both.agg(F.max(F.abs(F.col("p") - F.col("score")))).first()[0] < 1e-12


def test_text_regression_is_ridge(spark):
    rng = np.random.default_rng(2)
    x, w = rng.normal(size=(80, 5)), rng.normal(size=(5, 2))
    y = x @ w + 0.3 + rng.normal(0, 0.01, (80, 2))
    table = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)],
                                  "item bigint, embedding array<double>")
    target = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(y)],
                                   "item bigint, f1 double, f2 double")
    c = irt.fit_text_regression(table, target, 5, 2, ridge=1.0)
    full = np.hstack([np.ones((80, 1)), x])
    want = np.linalg.solve(full.T @ full + np.diag([1e-9] + [1.0] * 5), full.T @ y)
    assert np.allclose(c, want)
    got = irt.predict_text_regression(table, c).orderBy("item").toPandas()[["f1", "f2"]].values
    assert np.allclose(got, full @ want)


def test_newton_finds_the_bounded_optimum():
    from itemspark.operators import tiles
    rng = np.random.default_rng(4)
    w, n = rng.normal(size=(300, 3)), 3
    y = (rng.random(300) < 0.6).astype(float)
    x, least = np.zeros((1, n)), np.array([[0.0, 0.0, -np.inf]])
    for _ in range(60):
        p = tiles.answer_probability(w @ x[0])
        sums = tiles.sums_of(w.T, np.zeros(300, int), 1, y, p)
        x, gap = tiles.newton(x, least, sums[:n].T - x, tiles.full(sums[n:-1], n) + np.eye(n), np.ones((1, n), bool), sums[-1])
    assert gap.max() < 1e-8 and (x >= least).all()
    g = w.T @ (y - tiles.answer_probability(w @ x[0])) - x[0]
    assert all(abs(v) < 1e-8 or (u == b and v <= 0) for u, v, b in zip(x[0], g, least[0]))


@pytest.mark.parametrize("block", [1024, 37])
def test_fits_do_not_depend_on_blocks(spark, monkeypatch, factor_cells, block):
    from itemspark.operators import tiles
    monkeypatch.setattr(tiles, "BLOCK", block)
    _, table, qmatrix, takers, _ = factor_cells
    masks = irt.qmatrix_masks(qmatrix, ["s0", "s1", "s2", "s3"])
    begun = irt.start(table, takers, masks, 4, 0.0)
    model = irt.solve(table, begun, 1e-5, 1e-4, move_items=False)
    gaps = irt.projected_gradients(table, model, move_items=False)
    assert gaps.count() == 120 and gaps.agg(F.max("gap")).first()[0] < 1e-3
    assert model.items.count() == 200 and model.items.exceptAll(begun.items.select(model.items.columns)).count() == 0


def test_tiles_grow_with_the_cells_and_sums_are_added_on_the_way(spark, monkeypatch, factor_cells):
    import pyarrow as pa

    from itemspark.operators import tiles
    small, large = (tiles.block_size(6 * 10 ** 5 * n, 20_000 * n, 1000 * n, 37) for n in (1, 60))
    n_tiles = lambda n, size: (20_000 * n // size + 1) * (1000 * n // size + 1)
    assert n_tiles(60, large) < 60 * n_tiles(1, small)
    assert tiles.block_size(10 ** 6, 1000, 1000, 37) == tiles.BLOCK

    monkeypatch.setattr(tiles, "HELD_BYTES", 1)
    shape, x = tiles.Shape(1, 1), np.arange(6.0).tobytes()
    cells = pa.array([[{"i": 0, "t": 1, "y": 1.0}]] * 3, pa.list_(pa.struct([("i", pa.int32()), ("t", pa.int32()), ("y", pa.float64())])))
    batch = pa.record_batch([cells, pa.array([np.ones(3).tobytes()] * 3, pa.binary()), pa.array([x] * 3, pa.binary()),
                             pa.array([4, 5, 4], pa.int32()), pa.array([0, 0, 0], pa.int32())],
                            names=["cells", "item_payload", "taker_payload", "ib", "tb"])
    parts = list(tiles.partial_sums(shape, (0,), "item")(iter([batch])))
    assert len(parts) == 3
    monkeypatch.setattr(tiles, "HELD_BYTES", 1 << 20)
    held = list(tiles.partial_sums(shape, (0,), "item")(iter([batch])))
    added = list(tiles.added_sums(iter(parts)))
    assert [r.to_pylist() for r in held] == [r.to_pylist() for r in added] and len(added) == 2


def test_steps_do_not_shuffle_cells(spark, factor_cells):
    from itemspark.operators import tiles
    _, table, _, takers, items = factor_cells
    stored = tiles.stored_tiles(table, tiles.blocks_of(items.select("item"), "item", 50), tiles.blocks_of(takers.select("taker"), "taker", 30))
    sent = stored.select("tile").withColumn("payload", F.lit("x")).repartition(3)
    with_limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = stored.join(sent, "tile")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", with_limit)
    scan_with_cells = next(i for i, line in enumerate(plan.splitlines()) if "Scan" in line and "cells" in line)
    depth = lambda line: len(line) - len(line.lstrip(" :+-*()0123456789"))
    above = []
    level = depth(plan.splitlines()[scan_with_cells])
    for line in reversed(plan.splitlines()[:scan_with_cells]):
        if depth(line) < level:
            above.append(line)
            level = depth(line)
    assert any("SortMergeJoin" in line for line in above) and not any("Exchange" in line for line in above)
    assert "SelectedBucketsCount" in plan


def test_cells_are_summed_by_mask_and_parameters_sent_without_masked_ones():
    from itemspark.operators import tiles
    rng = np.random.default_rng(5)
    k, n, m = 4, 30, 9
    q = np.zeros((k, n))
    q[np.arange(n) % 3, np.arange(n)] = 1.0                      # the fourth is never used
    q[0] = 1.0
    q[:, 7] = 0.0
    state = np.concatenate([q, q * rng.uniform(0.5, 2, (k, n)), rng.normal(size=(1, n))])[None]
    takers = rng.normal(size=(1, k, m))
    shape = tiles.Shape(1, k)
    assert np.array_equal(shape.received(shape.sent(state.tobytes())), state)
    assert len(shape.sent(state.tobytes())) < state.nbytes / 2
    with pytest.raises(ValueError):
        shape.sent((state * 0.5).tobytes())
    i, t = (x.ravel() for x in np.meshgrid(np.arange(n), np.arange(m), indexing="ij"))
    y = (rng.random(len(i)) < 0.5).astype(float)
    a, d = state[0, k:2 * k], state[0, 2 * k]
    z = (a[:, i] * takers[0][:, t]).sum(axis=0) - d[i]
    p = tiles.answer_probability(z)
    import pyarrow as pa
    packed = y.tobytes() + i.astype("i4").tobytes() + t.astype("i4").tobytes()
    batch = pa.record_batch([pa.array([x], pa.binary() if isinstance(x, bytes) else pa.int32()) for x in
                             (packed, shape.sent(state.tobytes()), takers.tobytes(), 0, 0)],
                            names=["cells", "item_payload", "taker_payload", "ib", "tb"])
    for side, weights, place, size in (("item", np.vstack([takers[0][:3, t] * q[:3, i], -np.ones((1, len(i)))]), i, n), ("taker", a[:3, i], t, m)):
        row = next(iter(tiles.partial_sums(shape, (0,), side, True)(iter([batch]))))
        want = np.concatenate([np.bincount(place, minlength=size), tiles.sums_of(weights, place, size, y, p).ravel()])
        assert np.allclose(np.frombuffer(row.column("payload")[0].as_py()), want)
        assert np.isclose(row.column("ll")[0].as_py()[0], -np.logaddexp(0, np.where(y > 0, -z, z)).sum())


def test_tiles_of_many_cells_are_larger():
    from itemspark.operators import tiles
    n_items, n_takers, cells = 1_200_000, 60_000, 33_000_000
    size = tiles.block_size(cells, n_items, n_takers, 46)
    assert (n_items / size) * (n_takers / size) < 150
    far = tiles.block_size(6 * cells, 6 * n_items, 6 * n_takers, 46)
    assert tiles.block_size(10 ** 6, 20_000, 1000, 46) <= size <= far <= tiles.SUM_BYTES // (8 * 46)


def test_a_round_is_one_job(spark, monkeypatch, factor_cells):
    from itemspark.operators import tiles
    _, table, qmatrix, takers, _ = factor_cells
    begun = irt.start(table, takers, irt.qmatrix_masks(qmatrix, ["s0", "s1", "s2", "s3"]), 4, 0.0)
    plain, jobs = tiles.progress, []
    tracker = spark.sparkContext.statusTracker()

    def counted(*args):
        told = plain(*args)
        jobs.append(len(tracker.getJobIdsForGroup("fit")))
        return told
    monkeypatch.setattr(tiles, "progress", counted)
    spark.sparkContext.setJobGroup("fit", "rounds")
    try:
        irt.solve(table, begun)
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert len(jobs) > 4 and set(np.diff(jobs[:8])) == {1}


def test_blocks_without_a_dimension_and_several_flushes(spark, monkeypatch, factor_cells):
    """Sums of a block keep their places when its items use fewer dimensions than others."""
    from itemspark.operators import tiles
    _, table, qmatrix, takers, _ = factor_cells
    table = table.where("item < 12")
    masks = irt.qmatrix_masks(qmatrix.where("item < 12"), ["s0", "s1", "s2", "s3"])
    begun = irt.start(table, takers, masks, 4, 0.0)
    found = []
    for block, held in ((1024, 1 << 26), (1, 1)):
        monkeypatch.setattr(tiles, "BLOCK", block)
        monkeypatch.setattr(tiles, "block_size", lambda *a, size=4 if block == 1 else 1024: size)
        monkeypatch.setattr(tiles, "HELD_BYTES", held)
        found.append(irt.solve(table, begun).items.orderBy("item").toPandas())
    assert np.allclose(found[0], found[1])


def test_sums_of_cells_in_any_order():
    from itemspark.operators import tiles
    rng = np.random.default_rng(9)
    for k in (2, 5):                                             # narrow and wide
        n, m = 40, 25
        items = np.concatenate([np.ones((k, n)), rng.uniform(0.5, 2, (k, n)), rng.normal(size=(1, n))])[None]
        takers = rng.normal(size=(1, k, m))
        i, t = np.sort(rng.integers(0, n, 500)), rng.integers(0, m, 500)
        y = (rng.random(500) < 0.5).astype("u1")
        a, d = items[0, k:2 * k], items[0, 2 * k]
        z = (a[:, i] * takers[0][:, t]).sum(axis=0) - d[i]
        p = tiles.answer_probability(z)
        for side, place, size, w in (("item", i, n, np.vstack([takers[0][:, t], -np.ones((1, 500))])), ("taker", t, m, a[:, i])):
            want = np.concatenate([np.bincount(place, minlength=size), tiles.sums_of(w, place, size, y, p).ravel()])
            for order in (None, np.argsort(t, kind="stable")):
                got, ll = tiles.tile_sums(k, (0,), side, items, takers, i, t, y, order, {0: list(range(k))})
                assert np.allclose(got, want) and np.isclose(ll[0], -np.logaddexp(0, np.where(y > 0, -z, z)).sum())

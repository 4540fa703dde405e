import numpy as np
import pytest
from pyspark.sql import functions as F

from itemspark.operators import cluster, factors, vectors


def matrix(df, key, prefix, k):
    rows = df.orderBy(key).toPandas()
    return rows[vectors.dims(prefix, k)].values


def signed(v):
    return v * np.where(v[np.abs(v).argmax(0), range(v.shape[1])] < 0, -1, 1)


def test_svd_matches_numpy(cells, items, takers):
    x = np.nan_to_num(cells[0])
    u, s, v = np.linalg.svd(x, full_matrices=False)
    values, iv, tv = vectors.truncated_svd(cells[1], items, takers, 5)
    assert np.allclose(values, s[:5])
    assert np.allclose(matrix(iv, "item", "f", 5), signed(v[:5].T), atol=1e-8)
    low = matrix(vectors.scaled(tv, values), "taker", "t", 5) @ matrix(iv, "item", "f", 5).T
    assert np.allclose(low, u[:, :5] * s[:5] @ v[:5])
    people = matrix(vectors.abilities(cells[1], iv, takers, 5), "taker", "t", 5)
    assert np.allclose(people, x @ matrix(iv, "item", "f", 5))


def test_reconstruction_error_falls_with_k(cells, items, takers):
    x = np.nan_to_num(cells[0])
    values, iv, tv = vectors.truncated_svd(cells[1], items, takers, 8)
    f, t = matrix(iv, "item", "f", 8), matrix(vectors.scaled(tv, values), "taker", "t", 8)
    errors = [np.linalg.norm(x - t[:, :k] @ f[:, :k].T) for k in range(1, 9)]
    assert errors == sorted(errors, reverse=True)


def test_krylov_iteration_finds_the_same_factors(cells, items, takers):
    exact, iv, _ = vectors.truncated_svd(cells[1], items, takers, 2)
    values, jv, tv = vectors.truncated_svd(cells[1], items, takers, 2, gram_limit=10)
    assert np.allclose(values, exact, rtol=1e-6)
    assert np.allclose(matrix(iv, "item", "f", 2), matrix(jv, "item", "f", 2), atol=1e-3)
    u = matrix(tv, "taker", "u", 2)
    assert np.allclose(u.T @ u, np.eye(2), atol=1e-6)


def test_item_components_match_centred_svd(cells, items, takers):
    x = np.nan_to_num(cells[0])
    x = x - x.mean(0)
    _, s, v = np.linalg.svd(x, full_matrices=False)
    loadings, ratios = vectors.item_components(cells[1], items, takers, 3)
    assert np.allclose(ratios, (s ** 2 / (s ** 2).sum())[:3])
    assert np.allclose(matrix(loadings, "item", "f", 3), signed(v[:3].T), atol=1e-8)


def test_item_components_by_iteration(cells, items, takers):
    exact, ratios = vectors.item_components(cells[1], items, takers, 2)
    got, shares = vectors.item_components(cells[1], items, takers, 2, gram_limit=10)
    assert np.allclose(ratios, shares, rtol=1e-5)
    assert np.allclose(matrix(exact, "item", "f", 2), matrix(got, "item", "f", 2), atol=1e-3)


def test_rank_sweep_is_a_running_sum(spark, cells, items, takers):
    values, iv, tv = vectors.truncated_svd(cells[1], items, takers, 4)
    people = vectors.scaled(tv, values)
    swept = vectors.rank_sweep_scores(cells[1], people, iv, range(2, 5)).filter("k = 4")
    direct = vectors.cell_scores(cells[1], people, iv, 4)
    assert swept.agg(F.sum("score")).first()[0] == pytest.approx(direct.agg(F.sum("score")).first()[0])


def item_loadings(spark, n=300, k=3):
    rng = np.random.default_rng(11)
    a = np.zeros((n, k))
    a[np.arange(n), rng.integers(0, k, n)] = rng.uniform(0.5, 0.8, n)
    a += rng.uniform(-0.1, 0.1, (n, k))
    q, _ = np.linalg.qr(rng.normal(size=(k, k)))
    mixed = a @ q
    table = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(mixed)],
                                  "item bigint, " + ", ".join(f"{c} double" for c in vectors.dims("f", k)))
    return a, mixed, table


def test_distributed_varimax(spark):
    a, mixed, table = item_loadings(spark)
    rotated, r = factors.varimax(table, "item", "f", 3)
    got = matrix(rotated, "item", "f", 3)
    assert np.allclose(r.T @ r, np.eye(3), atol=1e-9)
    assert np.allclose((got ** 2).sum(1), (mixed ** 2).sum(1))              # communalities
    assert np.allclose(got, factors.varimax_matrix(mixed)[0], atol=1e-6)
    order = [np.argmax(np.abs(np.corrcoef(got.T, a.T)[:3, 3 + j])) for j in range(3)]
    assert sorted(order) == [0, 1, 2]
    assert np.abs(np.abs(got[:, order]) - np.abs(a)).max() < 0.15           # simple structure is back


def test_distributed_promax(spark):
    _, mixed, table = item_loadings(spark)
    rotated, phi = factors.promax(table, "item", "f", 3)
    want, want_phi = factors.promax_matrix(mixed)
    assert np.allclose(matrix(rotated, "item", "f", 3), want, atol=1e-5)
    assert np.allclose(phi, want_phi, atol=1e-5) and np.allclose(np.diag(phi), 1.0)


def test_minres_recovers_a_one_factor_matrix():
    a = np.array([0.9, 0.8, 0.7, 0.6, 0.5])
    r = np.outer(a, a)
    np.fill_diagonal(r, 1.0)
    assert np.allclose(factors.minres(r, 1, 5000, 1e-10)[:, 0], a, atol=1e-5)


def test_adequacy_and_sphericity():
    r = np.array([[1, 0.6, 0.5], [0.6, 1, 0.4], [0.5, 0.4, 1]])
    inverse = np.linalg.inv(r)
    p = -inverse / np.sqrt(np.outer(np.diag(inverse), np.diag(inverse)))
    off = ~np.eye(3, dtype=bool)
    want = (r[off] ** 2).sum() / ((r[off] ** 2).sum() + (p[off] ** 2).sum())
    overall, each, reason = factors.kmo(r)
    assert overall == pytest.approx(want) and reason is None and len(each) == 3
    statistic, tail, _ = factors.bartlett(r, 50)
    assert statistic == pytest.approx(-(50 - 1 - 11 / 6) * np.log(np.linalg.det(r)))
    assert 0 < tail < 1e-6
    assert factors.kmo(np.ones((3, 3)))[2] and factors.bartlett(np.ones((3, 3)), 50)[2]


def test_chi_square_tail():
    # fixed values: standard table of the 5 % and 1 % points
    assert factors.chi_square_tail(3.841458820694124, 1) == pytest.approx(0.05)
    assert factors.chi_square_tail(23.209251158954356, 10) == pytest.approx(0.01)
    assert factors.chi_square_tail(0.0, 3) == 1.0


def test_unknown_method_is_an_error(spark, cells):
    with pytest.raises(ValueError):
        factors.extract("other", cells[1], "taker", "item", "y", 2)


def test_clusters(spark):
    _, _, table = item_loadings(spark, 120, 3)
    grouped = cluster.kmeans(table, vectors.dims("f", 3), 3)
    assert grouped.select("cluster").distinct().count() == 3
    scores = cluster.silhouettes(table, vectors.dims("f", 3), range(2, 5))
    assert cluster.best_count(scores).first().k == 3
    primary = grouped.select("item", F.col("cluster").alias("factor"))
    assert cluster.agreement(grouped, primary).first().agreement == 1.0
    shifted = primary.withColumn("factor", (F.col("factor") + 1) % 3)
    assert cluster.agreement(grouped, shifted).first().agreement == 0.0
    assert cluster.matched_agreement(grouped, shifted).first().agreement == 1.0


def test_solvers_raise_when_they_do_not_settle():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(50, 8))
    r = np.corrcoef(x + x[:, :1], rowvar=False)
    with pytest.raises(ValueError, match="did not settle"):
        factors.minres(r, 3, rounds=1)
    unit = rng.normal(size=(40, 3))
    fourth = np.einsum("ia,ib,ic,id->abcd", unit, unit, unit, unit)
    with pytest.raises(ValueError, match="did not settle"):
        factors._varimax_rotation(fourth, unit.T @ unit, 40, rounds=1)


@pytest.mark.parametrize("columns, k", [(6, 3), (6, 1), (20, 4), (60, 12)])
def test_minres_fits_the_diagonal_where_it_is_free(columns, k):
    """Also with as many parameters as correlations, where plain alternation creeps."""
    rng = np.random.default_rng(2)
    r = np.corrcoef(rng.normal(size=(300, 4)) @ rng.normal(size=(4, columns)) + rng.normal(size=(300, columns)), rowvar=False)
    loadings = factors.minres(r, k)
    shared = (loadings ** 2).sum(1)
    inner = shared < 0.99
    reduced = r - np.diag(np.clip(1 - shared, 0.005, 1))
    values, vectors = np.linalg.eigh(reduced)
    again = vectors[:, ::-1][:, :k] * np.sqrt(np.maximum(values[::-1][:k], 0))
    assert np.allclose((again ** 2).sum(1)[inner], shared[inner], atol=1e-4)


def test_joined_gram_equals_packed_gram(spark, cells, takers):
    """Entries for any number of takers; those outside the table don't count."""
    x = np.nan_to_num(cells[0])
    want = x @ x.T
    stranger = cells[1].unionByName(spark.sql("SELECT 7L AS taker, 3L AS item, 1Y AS y"))
    rows = vectors.joined_gram(vectors.right_cells(stranger), takers).collect()
    assert {(r.t1 - 100, r.t2 - 100): r.together for r in rows} == {
        (i, j): int(want[i, j]) for i in range(40) for j in range(40) if want[i, j] > 0}
    assert len(rows) == (want > 0).sum()

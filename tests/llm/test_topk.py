import math

import numpy as np
import pytest

from itemspark.llm import topk


def plain(queries, rows, k):
    out = []
    for q, x in queries:
        scores = sorted((-sum(a * b for a, b in zip(x, y)), v) for v, y in rows if v != q)
        out += [(q, i + 1, v, -s) for i, (s, v) in enumerate(scores[:k])]
    return sorted(out)


@pytest.mark.parametrize("tile, shard, fan", [(1024, 4096, 32), (3, 7, 2)])
def test_equals_brute_force_with_ties(spark, monkeypatch, tile, shard, fan):
    for name, value in (("TILE_ROWS", tile), ("SHARD_ROWS", shard), ("FAN_IN", fan)):
        monkeypatch.setattr(topk, name, value)
    rng = np.random.default_rng(5)
    rows = [(i, rng.integers(-2, 3, 4).tolist()) for i in range(90)] + [(100 + i, [1, 1, 1, 1]) for i in range(30)]
    vectors = spark.createDataFrame(rows, "vec_id long, vec array<long>")
    queries = [r for r in rows if r[0] % 20 == 0]
    got = topk.top_k(vectors.where("vec_id % 20 = 0"), vectors, 6)
    assert sorted(tuple(r) for r in got.collect()) == plain(queries, rows, 6)


def test_large_numbers_short_vectors_and_few_rows(spark):
    big = 2 ** 40
    rows = [(0, [big, big]), (1, [big, 1]), (2, [3]), (3, [-big, 1]), (4, [2 ** 62, 2 ** 62]), (4, [2 ** 62, 2 ** 62])]
    vectors = spark.createDataFrame(rows, "vec_id long, vec array<long>")
    got = [tuple(r) for r in topk.top_k(vectors.where("vec_id = 0"), vectors, 20).orderBy("rank").collect()]
    # scores beyond 64 bits are stored as the limit, so they tie and the smaller id comes first
    assert got == [(0, 1, 1, topk.LIMIT), (0, 2, 4, topk.LIMIT), (0, 3, 2, 3 * big), (0, 4, 3, -topk.LIMIT)]


def test_rows_left_out_and_empty_table(spark):
    nan, inf = float("nan"), math.inf
    rows = [(1, [0.5, -0.01], "a"), (2, None, "b"), (3, [1.0, None], "c"), (4, [nan, 1.0], "d"), (None, [1.0, 1.0], "e"),
            (5, [inf, 0.0], "f"), (6, [], "g")]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, vec string")
    kept = topk.quantised(table)
    assert sorted((r["vec_id"], r["vec"]) for r in kept.collect()) == [(1, [32, -1]), (6, [])]
    got = topk.top_k(kept, kept, 3).collect()
    assert sorted(tuple(r) for r in got) == [(1, 1, 6, 0), (6, 1, 1, 0)]
    assert topk.top_k(kept.limit(0), kept.limit(0), 3).count() == 0


def test_grid_meets_every_pair_once_with_few_copies(spark):
    tiles = spark.range(70).selectExpr("cast(id as int) tile")
    shards = spark.range(90).selectExpr("cast(id as int) shard")
    for size in (1, 7, 32, 100):
        pairs = [tuple(r) for r in topk.met(tiles, shards, 70, 90, size).collect()]
        assert len(pairs) == len(set(pairs)) == 70 * 90
    assert topk.group_size(49_000, 244_000, 4000) == topk.GROUP
    assert topk.group_size(2, 5, 24) == 1


def test_blocks_take_the_narrowest_integers(spark):
    rows = [(1, [1, -2]), (2, [3, 40_000]), (3, [5, 2 ** 40])]
    for row, kind in zip(rows, ("<i2", "<i4", "<i8")):
        block = topk.packed(spark.createDataFrame([row], "vec_id long, vec array<long>"), 1).first()
        assert block["kind"] == kind
        assert np.frombuffer(block["vectors"], kind).tolist() == row[1]

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from itemspark.operators import ranks


def skewed(spark, n=5000):
    """One group holds 80 % of the rows and one value half of that."""
    rng = np.random.default_rng(1)
    frame = pd.DataFrame({"key": np.arange(n), "g": np.where(rng.random(n) < 0.8, "hot", "cold"),
                          "v": np.where(rng.random(n) < 0.5, 3.0, rng.integers(0, 50, n) / 7.0)})
    return frame, spark.createDataFrame(frame).repartition(6)


def test_positions_follow_the_order_in_every_group(spark):
    frame, df = skewed(spark)
    got = ranks.positions(df, [F.col("v").desc(), F.col("key")], ["g"]).toPandas()
    want = frame.sort_values(["g", "v", "key"], ascending=[True, False, True])
    want["position"] = want.groupby("g").cumcount() + 1
    merged = got.merge(want, on="key")
    assert len(merged) == len(frame)
    assert (merged.position_x == merged.position_y).all()


def test_positions_without_groups_have_no_gap(spark):
    frame, df = skewed(spark)
    got = sorted(r.position for r in ranks.positions(df, [F.col("key")]).collect())
    assert got == list(range(1, len(frame) + 1))


def test_running_totals(spark):
    frame, df = skewed(spark)
    tied = df.groupBy("g", "v").agg(F.count("*").alias("n"))
    got = ranks.running_totals(tied, [F.col("v")], ["n"], ["g"]).toPandas().sort_values(["g", "v"])
    want = got.groupby("g")["n"].cumsum() - got["n"]
    assert (got["n_before"] == want).all()


def test_average_ranks_match_pandas(spark):
    frame, df = skewed(spark)
    got = ranks.average_ranks(df, "v", ["g"]).toPandas().set_index("key")["rank"].sort_index()
    want = frame.groupby("g")["v"].rank()
    assert np.allclose(got.values, want.values)


def test_quantiles_match_pandas(spark):
    frame, df = skewed(spark)
    got = ranks.quantiles(df, "v", ["g"], {"a": 0.25, "b": 0.5, "c": 0.9}).toPandas().set_index("g")
    for g, part in frame.groupby("g"):
        assert np.allclose(got.loc[g, ["a", "b", "c"]].astype(float), part.v.quantile([0.25, 0.5, 0.9]))


def test_hash_positions_are_a_permutation_and_repeat(spark):
    frame, df = skewed(spark)
    one = ranks.hash_positions(df, ["key"], 42, ["g"]).toPandas()
    two = ranks.hash_positions(df.repartition(3), ["key"], 42, ["g"]).toPandas()
    for _, part in one.groupby("g"):
        assert sorted(part.position) == list(range(1, len(part) + 1))
    assert one.set_index("key").position.sort_index().equals(two.set_index("key").position.sort_index())
    other = ranks.hash_positions(df, ["key"], 43, ["g"]).toPandas()
    assert not one.set_index("key").position.sort_index().equals(other.set_index("key").position.sort_index())

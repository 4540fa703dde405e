import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path[:0] = [ROOT, os.path.join(ROOT, "tests")]


@pytest.fixture(scope="session")
def spark():
    from compare import session
    spark = session()
    yield spark
    from itemspark.session import drop_staged_tables
    drop_staged_tables(spark)
    spark.stop()


@pytest.fixture(scope="session")
def cells(spark):
    """40 takers x 60 items, 70 % asked; taker ability and item easiness vary."""
    import numpy as np
    import pandas as pd
    rng = np.random.default_rng(7)
    theta, easy = rng.normal(size=40), rng.normal(size=60)
    p = 1 / (1 + np.exp(-(theta[:, None] + easy[None, :])))
    y = (rng.random((40, 60)) < p).astype(float)
    y[rng.random((40, 60)) < 0.3] = np.nan
    taker, item = np.nonzero(~np.isnan(y))
    frame = pd.DataFrame({"taker": taker + 100, "item": item, "y": y[taker, item].astype("int8")})
    table = spark.createDataFrame(frame, "taker bigint, item bigint, y tinyint").cache()
    return y, table


@pytest.fixture(scope="session")
def takers(spark):
    return spark.range(100, 140).selectExpr("id AS taker", "concat('m', id) AS name").cache()


@pytest.fixture(scope="session")
def items(spark):
    return spark.range(60).selectExpr(
        "id AS item", "concat('text ', id % 7) AS input_text",
        "CASE WHEN id < 40 THEN 'big' ELSE concat('s', id % 3) END AS scenario",
        "concat('b', id % 2) AS benchmark").cache()

from collections import defaultdict

import pytest

from itemspark.llm import mixing


def test_weights_meet_all_targets_and_sample_follows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = mixing.mixed(docs).collect()
    assert len(rows) == docs.count()
    for d in mixing.DIMENSIONS:
        tokens, weight, cells = defaultdict(int), defaultdict(float), {}
        for r in rows:
            tokens[r[d]] += r["tokens"]
            cells[r["source"], r["lang"], r["topic"]] = r["weight"], r[d]
        for w, value in cells.values():
            weight[value] += w
        whole = sum(n ** mixing.POWER for n in tokens.values())
        assert all(abs(weight[v] - n ** mixing.POWER / whole) < 1e-9 for v, n in tokens.items())
    assert max(r["probability"] for r in rows) == pytest.approx(1)
    want = sum(r["probability"] for r in rows)
    assert abs(sum(r["sampled"] for r in rows) - want) < 4 * want ** 0.5


@pytest.mark.parametrize("per_task", [100_000, 1])
def test_raking_to_given_targets(spark, monkeypatch, per_task):
    """Unreachable values are left out; both ways of dealing the cells agree."""
    monkeypatch.setattr(mixing, "CELLS_PER_TASK", per_task)
    cells = spark.createDataFrame([("a", "x", "t", 30), ("a", "y", "t", 10), ("b", "x", "t", 20), ("b", "y", "t", 40), ("c", "y", "t", 9)],
                                  "_source string, _lang string, _topic string, tokens long")
    targets = spark.createDataFrame([("source", "a", 0.3), ("source", "b", 0.3), ("source", "none", 0.4), ("lang", "x", 0.75),
                                     ("lang", "y", 0.25), ("topic", "t", 1.0)], "dim string, value string, target double")
    got = {(r["_source"], r["_lang"]): r["weight"] for r in mixing.raked(cells, targets).collect()}
    assert got["c", "y"] == 0
    assert got["a", "x"] + got["a", "y"] == pytest.approx(0.5) and got["a", "x"] + got["b", "x"] == pytest.approx(0.75)
    odds = got["a", "x"] * got["b", "y"] / (got["a", "y"] * got["b", "x"])
    assert odds == pytest.approx(30 * 40 / (10 * 20))       # raking keeps the interaction


def test_targets_that_empty_cells_rule_out(spark):
    cells = spark.createDataFrame([("a", "x", "t", 1), ("b", "y", "t", 1)], "_source string, _lang string, _topic string, tokens long")
    targets = spark.createDataFrame([("source", "a", 0.9), ("source", "b", 0.1), ("lang", "x", 0.1), ("lang", "y", 0.9),
                                     ("topic", "t", 1.0)], "dim string, value string, target double")
    got = {r["_source"]: (r["weight"], r["target_gap"]) for r in mixing.raked(cells, targets).collect()}
    assert got == {"a": (pytest.approx(0.1), pytest.approx(0.8)), "b": (pytest.approx(0.9), pytest.approx(0.8))}


def test_nulls_repeats_clashing_columns_and_empty_table(spark):
    rows = [(1, None, None, None, "q"), (None, "a b", "en", "s", "q"), (1, None, None, None, "q"), (2, "w " * 100_000, "en", "s", "q"),
            (3, "Copyright 1", "fr", "s", "q")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, topic string")
    got = mixing.mixed(docs).collect()
    assert len(got) == 5 and sorted(r["tokens"] for r in got) == [1, 1, 3, 3, 100_001]
    assert {r["topic"] for r in got} == {"prose", "legal"} and all(0 <= r["probability"] <= 1 for r in got)
    assert mixing.mixed(docs.limit(0)).count() == 0


def test_given_targets_and_budget(spark):
    """Scarce cells are repeated, plentiful ones thinned, and the tokens come to the budget."""
    rows = [(i, "w " * (3 + i % 7), "en", "web" if i % 10 else "books") for i in range(4000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    targets = spark.createDataFrame([("source", "web", 0.5), ("source", "books", 0.5), ("lang", "en", 1.0), ("topic", "prose", 1.0)],
                                    "dim string, value string, target double")
    got = mixing.mixed(docs, targets=targets, budget=12_000).collect()
    taken = defaultdict(int)
    for r in got:
        taken[r["source"]] += r["copies"] * r["tokens"]
        assert r["sampled"] == (r["copies"] > 0) and abs(r["copies"] - r["probability"]) < 1
    assert {r["probability"] > 1 for r in got if r["source"] == "books"} == {True}
    assert all(abs(n - 6000) < 500 for n in taken.values()) and len(taken) == 2


def test_columns_named_like_its_own_stay(spark):
    docs = spark.createDataFrame([(1, "a b", "en", "s", 7, 8, 9)], "doc_id long, text string, lang string, source string, _source int, _Lang int, _topic int")
    row = mixing.mixed(docs).first()
    assert (row["_source"], row["_Lang"], row["_topic"], row["source"]) == (7, 8, 9, "s")

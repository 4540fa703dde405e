import zlib

import numpy as np

from itemspark.llm import language
from itemspark.llm.queries import QUERIES


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.01"
    truth = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    rows = QUERIES["op9_language"](spark, folder).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(truth)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in rows)
    assert all(0 <= r["score"] <= 1 for r in rows)
    held = [r for r in rows if r["held_out"]]
    assert np.mean([r["lang_pred"] == truth[r["doc_id"]] for r in held]) > 0.98


def test_folded_weights_equal_the_kernel_form():
    """Scores from one matrix equal those computed with kernels and landmarks."""
    texts = ["the cat sat", "le chat noir", "the dog ran", "un chien gris", "a bird flew", "la souris"]
    labels = ["en", "fr"] * 3
    x = language.presence(texts).astype("f8")
    names, weights = language.fit(np.packbits(x > 0, axis=1), labels)
    grams = [set(language.gram_slots(t).tolist()) for t in texts]
    kernel = np.array([[len(a & b) / np.sqrt(len(a) * len(b)) for b in grams] for a in grams])
    assert np.allclose(kernel, x @ x.T, atol=1e-6)
    target = np.where(np.array(labels)[:, None] == np.array(names), 1.0, -1.0)
    alpha = np.linalg.solve(kernel + language.RIDGE * len(texts) * np.eye(len(texts)), target)
    assert np.allclose(x @ weights, kernel @ alpha, atol=1e-3)


def test_nulls_letterless_long_texts_and_empty_table(spark):
    en, fr = "the cat sat on the mat and then it ran", "le chat noir est sur la table avec nous"
    rows = [(i, (en, fr)[i % 2] + " " * i, ("en", "fr")[i % 2], "p") for i in range(40)]
    rows += [(100, None, "en", "p"), (101, "123 --", "fr", "p"), (102, "", None, "p"), (103, fr * 5000, None, "p"), (None, en, None, "p")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score string")
    got = {r["doc_id"]: r for r in language.predict(docs, *language.learned(docs)).collect()}
    assert len(got) == len(rows)
    assert [(got[i]["lang_pred"], got[i]["score"]) for i in (100, 101, 102)] == [("und", 0.0)] * 3
    assert got[103]["lang_pred"] == "fr" and got[None]["lang_pred"] == got[0]["lang_pred"] == "en"
    unlabelled = docs.withColumn("lang", docs["lang"].substr(50, 1)).where("lang IS NULL")
    assert {r["lang_pred"] for r in language.predict(unlabelled, *language.learned(unlabelled)).collect()} == {"und"}
    empty = docs.limit(0)
    assert language.predict(empty, *language.learned(empty)).count() == 0


def test_share_of_very_large_tables(spark):
    """Any number of rows leaves about the same number to learn from."""
    counts = spark.createDataFrame([(10 ** e,) for e in range(1, 16)], "n long")
    got = {r["n"]: r["t"] for r in counts.select("n", language.below(counts["n"], 4).alias("t")).collect()}
    assert got[10] == 1 << language.HASH_BITS
    for n, limit in got.items():
        assert abs(n * limit / (1 << language.HASH_BITS) - min(n, language.TRAIN_ROWS / 4)) < 1e-3


def test_repeated_rows_are_learned_once(spark):
    rows = [(1, "the cat sat on the mat", "en")] * 500 + [(2, "le chat noir est la", "fr")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    bits, labels = language.training_rows(docs)
    assert labels == ["en", "fr"] and len(bits) == 2

"""The stages against brute force on a small fixture."""

import importlib

import pytest
from test_repeats import plain_first
from test_simhash import plain_components, plain_fingerprint

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def pipeline():
    return importlib.import_module("corpus_pipeline")


@pytest.fixture(scope="module")
def results(spark, pipeline):
    docs, out = spark.read.parquet(f"{FOLDER}/documents.parquet"), []
    for name, stage in pipeline.STAGES:
        docs = pipeline.cut_lineage(stage(spark, docs, FOLDER), name)
        out.append([r.asDict() for r in docs.collect()])
    return out


def test_stages_equal_brute_force(spark, results):
    start = {r["doc_id"]: r.asDict() for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    told, single, cut, mixed, packed = results
    assert all(r == start[r["doc_id"]] for r in told) and len(told) == sum(any(map(str.isalpha, r["text"])) for r in start.values())
    ids = [r["doc_id"] for r in told]
    roots = plain_components([plain_fingerprint(r["text"]) for r in told], ids)
    assert sorted(r["doc_id"] for r in single) == sorted(set(roots.values())) and all(r == start[r["doc_id"]] for r in single)
    want = {}
    for (doc_id, text), kept in plain_first([(r["doc_id"], r["text"]) for r in single], 240).items():
        if len(kept) == len(text.encode()):
            want[doc_id] = text
        elif kept:
            want[doc_id] = None                               # changed; code points may be cut
    assert {r["doc_id"] for r in cut} == set(want)
    assert all(r["text"] == want[r["doc_id"]] for r in cut if want[r["doc_id"]] is not None)
    assert all(r["n_chars"] == len(r["text"]) for r in cut if want[r["doc_id"]] is None)
    assert {r["doc_id"] for r in mixed} <= {r["doc_id"] for r in cut} and mixed
    assert {r["doc_id"] for r in packed} == {r["doc_id"] for r in mixed}


def test_run_gives_the_last_stage(spark, pipeline, results):
    key = lambda rows: sorted((r["doc_id"], r["piece"], r["ids_crc32"]) for r in rows)
    assert key(r.asDict() for r in pipeline.run(spark, FOLDER).collect()) == key(results[-1])


def test_odd_rows_pass_every_stage(spark, pipeline):
    passage = "".join(f"mot{i} " for i in range(90))
    rows = [(None, None, None, None, None, "x"), (1, "", "en", "s", 0, "x"), (2, "the cat sat", "en", "s", 11, "x"), (2, "the cat sat", "en", "s", 11, "x"),
            (2, "un chien gris", "fr", "s", 13, "y"), (None, "the mat ran", "en", "s", 11, "x"), (None, "the mat ran", "en", "s", 11, "x"),
            (7, "é" + passage + "fin", "fr", "s", 1, None), (8, "debut " + passage, "fr", "s", 1, None), (9, "z" * 200_000, "en", None, 5, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, topic string")
    for _, stage in pipeline.STAGES[:-1]:
        assert stage(spark, docs, FOLDER).columns == docs.columns
        assert stage(spark, docs.limit(0), FOLDER).count() == 0
    single = sorted(str(tuple(r)[:2]) for r in pipeline.drop_near_duplicates(spark, docs.where("text <> ''"), FOLDER).collect())
    assert len(single) == 5                                 # 7 and 8 differ in few shingles
    cut = {r["doc_id"]: r["text"] for r in pipeline.drop_repeated_strings(spark, docs, FOLDER).collect()}
    assert cut[7] == "é" + passage + "fin" and cut[8] == "debut "
    assert pipeline.pack_sequences(spark, docs, FOLDER).count() >= 10

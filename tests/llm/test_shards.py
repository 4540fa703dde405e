import zlib

import pytest

from itemspark.llm import shards
from itemspark.llm.queries import QUERIES


@pytest.mark.parametrize("slice_rows", [200_000, 30])
def test_shards_are_contiguous_and_balanced(spark, monkeypatch, slice_rows):
    monkeypatch.setattr(shards, "SLICE_ROWS", slice_rows)
    folder = "/root/testdata/sf0.001"
    rows = sorted(QUERIES["op10_shards"](spark, folder).collect(), key=lambda r: r["doc_id"])
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    assert [r["doc_id"] for r in rows] == sorted(texts)
    assert [r["shard"] for r in rows] == sorted(r["shard"] for r in rows)
    for r in rows:
        raw = texts[r["doc_id"]].encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(raw) + 8, zlib.crc32(raw), "bytes", None)
    largest, total = max(r["size"] for r in rows), sum(r["size"] for r in rows)
    for s in range(24):
        own = [r for r in rows if r["shard"] == s]
        assert [r["slot"] for r in own] == list(range(len(own)))
        assert abs(sum(r["size"] for r in own) - total / 24) <= largest


def test_nulls_repeats_and_empty_table(spark):
    docs = spark.createDataFrame([(None, None), (None, "é"), (1, "a"), (1, "a"), (1, "b" * 10_000), (2, "")],
                                 "doc_id long, text string")
    cut = shards.byte_shards(shards.sized_texts(docs), 3, ["doc_id", "text_crc32", "size"]).collect()
    assert len(cut) == 6 and {r["shard"] for r in cut} <= {0, 1, 2}
    assert sorted(r["size"] for r in cut) == [8, 8, 9, 9, 10, 10_008]
    for s in {r["shard"] for r in cut}:
        slots = sorted(r["slot"] for r in cut if r["shard"] == s)
        assert slots == list(range(len(slots)))
    assert shards.byte_shards(shards.sized_texts(docs.limit(0)), 3, ["doc_id"]).count() == 0
    alone = shards.byte_shards(shards.sized_texts(docs.limit(1)), 24, ["doc_id"]).collect()
    assert len(alone) == 1 and alone[0]["slot"] == 0


def test_columns_named_like_its_own_stay(spark):
    names = ["_n", "_slice", "_run", "_place", "_before", "_index", "_total", "_FIRST", "shard"]
    rows = spark.createDataFrame([(i, 10, *range(i, i + 9)) for i in range(5)], "id long, size long, " + ", ".join(f"{n} int" for n in names))
    got = shards.byte_shards(rows, 2, ["id"]).collect()
    assert sorted((r["id"], *(r[n] for n in names[:-1])) for r in got) == [(i, *range(i, i + 8)) for i in range(5)]
    assert sorted(r["shard"] for r in got) == [0, 0, 0, 1, 1] or sorted(r["shard"] for r in got) == [0, 0, 1, 1, 1]
    with pytest.raises(ValueError):
        shards.byte_shards(rows, 2, ["_n"])

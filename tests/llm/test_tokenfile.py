import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from itemspark.llm import tokenfile
from itemspark.llm.queries import QUERIES
from itemspark.session import staging_path

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def plain_ids():
    tokenizer = Tokenizer.from_file(tokenfile.default_tokenizer())
    return lambda text: np.array(tokenizer.encode(text, add_special_tokens=False).ids + [0], "<u4")


@pytest.mark.parametrize("n", [0, 1, 255, 256, 257, 5000])
@pytest.mark.parametrize("top", [1, 2, 50_000, 1 << 32])
@pytest.mark.parametrize("share", [0.0, 0.9, 1.0])
def test_blocks_round_trip(n, top, share):
    rng = np.random.default_rng(n)
    ids = rng.integers(0, top, n, "u8").astype("u4")
    ids[::50] //= 1000
    blocks = tokenfile.packed(ids, share)
    assert (tokenfile.unpacked(blocks)[:n] == ids).all()
    file = tokenfile.TokenFile(tokenfile.file_bytes(1, 2, [None, 7], [0, n], ids, share) + b"\n")
    for a, b in ((0, n), (n // 3, n // 2), (n, n + 5)):
        assert (file.ids(a, b) == ids[a:b]).all()
    if share == 1.0:
        assert len(blocks["high"]) == 0


def test_few_large_ids_become_exceptions():
    ids = np.full(2560, 9, "u4")
    ids[100::256] = 4_000_000_000
    blocks = tokenfile.packed(ids)
    assert (blocks["width"] == 0).all() and len(blocks["words"]) == 0 and blocks["where"].tolist() == [100] * 10


def test_word_ids_equal_whole_texts(plain_ids):
    draw = random.Random(5)
    signs = ["a", "B", "é", "the", "'s", " ", "  ", "\n", "\n\n", "\t", ".", ",", "!?", "\x1c", "\xa0", "日本", "1", "<|endoftext|>", "ª", "\r\n", "z" * 70]
    texts = ["".join(draw.choice(signs) for _ in range(draw.randint(0, 14))) for _ in range(3000)]
    got = list(tokenfile.text_ids(tokenfile.default_tokenizer(), chars=500)(texts))
    assert all((g == plain_ids(t)).all() for g, t in zip(got, texts))


def test_query_equals_brute_force(spark, plain_ids):
    rows = {r["doc_id"]: r for r in QUERIES["op12_tokenfile"](spark, FOLDER).collect()}
    start = 0
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").orderBy("doc_id").collect()
    assert len(rows) == len(docs)
    for d in docs:
        ids = plain_ids(d["text"])
        r = rows[d["doc_id"]]
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)


def test_odd_rows(spark, plain_ids):
    rows = [(None, "x", 1), (None, None, 2), (5, "a b", 3), (5, "a b", 3), (5, "é", 4), (1, "", 5), (-3, "word " * 9000, 6), (9, "y", 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, hash int").withColumnRenamed("hash", "n")
    path = staging_path(spark, "odd")
    tokenfile.write_ids(docs, path, tokenfile.text_ids(tokenfile.default_tokenizer()), file_ids=3)
    read = tokenfile.read_ids(spark, path)
    assert read.select("part", "place").distinct().count() > 3
    found = sorted(tokenfile.with_start(read).collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in found] == [None, None, -3, 1, 5, 5, 5, 9]
    assert [r["start"] for r in found] == np.cumsum([0, *(r["n_tokens"] for r in found)]).tolist()[:-1]
    want = sorted(plain_ids(t or "").tobytes() for _, t, _ in rows)
    assert sorted(bytes(r["ids"]) for r in found) == want
    empty = staging_path(spark, "none")
    tokenfile.write_ids(docs.limit(0), empty, tokenfile.text_ids(tokenfile.default_tokenizer()))
    assert tokenfile.with_start(tokenfile.read_ids(spark, empty)).count() == 0


def test_other_tokenizers_are_refused():
    import public_tokenizers
    with pytest.raises(ValueError):
        tokenfile.word_encoder(public_tokenizers.path("word_bpe_49k.json"))

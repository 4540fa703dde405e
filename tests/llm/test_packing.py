import struct
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from itemspark.llm import packing
from itemspark.llm.queries import QUERIES


def laid_out(counts, capacity):
    bins, ranks = {}, {}
    for size, rank, n, per, first, offset in packing.plan(counts, capacity).tolist():
        for i in range(n):
            bins.setdefault(first + i // per, []).append((offset + i % per * size, size))
            ranks.setdefault(size, []).append(rank + i)
    assert {s: sorted(r) for s, r in ranks.items()} == {s: list(range(n)) for s, n in counts.items()}
    for items in bins.values():
        items.sort()
        assert [o for o, _ in items] == np.cumsum([0] + [s for _, s in items])[:-1].tolist()
        assert sum(s for _, s in items) <= capacity
        assert sum(3 * s > capacity for _, s in items) <= 2
    return bins


def fewest_for_large(counts, capacity):
    """Bins that the items above a third need at least: the smallest left joins the
    largest left if both fit, which matches as many as can be."""
    left = sorted(s for s, n in counts.items() if 3 * s > capacity for _ in range(n))
    bins, low, high = 0, 0, len(left) - 1
    while low <= high:
        low += low < high and left[low] + left[high] <= capacity
        high -= 1
        bins += 1
    return bins


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.integers(1, 30), st.integers(1, 40), max_size=12))
def test_plans_are_valid_and_near_the_bound(counts):
    bins = laid_out(counts, 30)
    total = sum(s * n for s, n in counts.items())
    assert len(bins) <= 1.25 * max(-(-total // 30), fewest_for_large(counts, 30)) + 1


def test_large_items_pair():
    assert len(laid_out({60: 3, 40: 3, 50: 2, 35: 2}, 100)) == 5


@pytest.mark.parametrize("bucket", [50_000, 20])
def test_query_equals_brute_force(spark, monkeypatch, bucket):
    from tokenizers import Tokenizer
    monkeypatch.setattr(packing, "BUCKET_ROWS", bucket)
    folder = "/root/testdata/sf0.001"
    tokenizer = Tokenizer.from_file(packing.default_tokenizer())
    want = set()
    for r in spark.read.parquet(f"{folder}/documents.parquet").collect():
        ids = [*tokenizer.encode(r["text"], add_special_tokens=False).ids, 1]
        for i in range(0, len(ids), 4096):
            part = ids[i:i + 4096]
            want.add((r["doc_id"], i // 4096, i, len(part), zlib.crc32(struct.pack(f"<{len(part)}I", *part))))
    rows = QUERIES["op2_packing"](spark, folder).collect()
    assert {tuple(r[c] for c in ("doc_id", "piece", "start", "length", "ids_crc32")) for r in rows} == want and len(rows) == len(want)
    bins = {}
    for r in rows:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for items in bins.values():
        items.sort()
        assert [o for o, _ in items] == np.cumsum([0] + [n for _, n in items])[:-1].tolist() and sum(n for _, n in items) <= 4096
    assert len(bins) <= 1.03 * sum(r["length"] for r in rows) / 4096 + 1


def test_word_by_word_ids_equal_the_tokenizers():
    import random
    from tokenizers import Tokenizer
    rng = random.Random(5)
    signs = "aB,. 'sStßİıΣσ\n\té́ǅ1½가<|>ñ!?\x1c"
    texts = ["", " ", "x<|endoftext|>y <|startoftext|>.", "ΑΣ ΑΣ. İ İ, don't. 's, ,.. Straße ẞ", "\U0001F600‍" * 3, "w" * 5000]
    texts += ["".join(rng.choice(signs) for _ in range(rng.randint(0, 60))) for _ in range(2000)]
    path = packing.default_tokenizer()
    encode, whole = packing.word_ids(path), Tokenizer.from_file(path)
    for part in packing.batches_of(texts, 500):
        assert encode(part) == [np.array(e.ids, "<u4").tobytes() for e in whole.encode_batch(part, add_special_tokens=False)]


def test_nulls_repeats_whole_sequences_and_empty_table(spark):
    rows = [(1, None, "a"), (None, "", "b"), (2, "hello world", "c"), (2, "hello world", "c"), (3, "word " * 9000, "d")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, offset string")
    pieces = packing.token_pieces(docs, packing.default_tokenizer(), ids=True)
    packed = packing.pack(pieces).collect()
    assert sorted(r["length"] for r in packed) == [1, 1, 3, 3, 9001 - 8192, 4096, 4096]
    whole = packing.sequences(packing.pack(pieces)).collect()
    assert sorted(len(r["ids"]) // 4 for r in whole) == sorted(r["length"] for r in whole)
    assert sum(r["length"] for r in whole) == 9009 and len(whole) == 3
    assert packing.pack(pieces.limit(0)).count() == 0
    with pytest.raises(ValueError):
        packing.pack(spark.createDataFrame([(5000,)], "length long"))


def test_columns_named_like_its_own_stay(spark):
    rows = spark.createDataFrame([(30, 1, 2, 3, 4, 5, 6), (4000, 7, 8, 9, 10, 11, 12)],
                                 "length long, _n int, _bucket int, _start int, _place int, _RANK int, count int")
    got = sorted(tuple(r[c] for c in rows.columns) for r in packing.pack(rows).collect())
    assert got == sorted(tuple(r) for r in rows.collect())

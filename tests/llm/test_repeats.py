"""Repeated byte strings against a table of all strings of that length."""

import hashlib
import random
from collections import Counter

import pytest

from itemspark.llm import repeats
from itemspark.llm.queries import QUERIES


def plain(texts, match):
    data = [(t or "").encode() for t in texts]
    seen = Counter(d[i:i + match] for d in data for i in range(len(d) - match + 1))
    out = []
    for d in data:
        gone = bytearray(len(d))
        for i in range(len(d) - match + 1):
            if seen[d[i:i + match]] > 1:
                gone[i:i + match] = b"\1" * match
        spans = sum(1 for i, g in enumerate(gone) if g and not (i and gone[i - 1]))
        out.append((len(d), sum(gone), spans, bytes(b for b, g in zip(d, gone) if not g)))
    return out


def test_query_equals_brute_force(spark):
    folder = "/root/testdata/sf0.001"
    docs = [tuple(r) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]
    want = sorted((d, n, gone, spans, hashlib.sha256(kept).hexdigest())
                  for (d, _), (n, gone, spans, kept) in zip(docs, plain([t for _, t in docs], 400)))
    rows = QUERIES["op5_repeats"](spark, folder).collect()
    assert sorted(tuple(r)[:5] for r in rows) == want
    texts = dict(docs)
    assert all((r["text"] == texts[r["doc_id"]]) == (r["n_removed"] == 0) for r in rows)


def plain_first(rows, match):
    """What is left of each (doc_id, text) without the bytes of strings that start in an
    earlier place: of documents in the order of doc_id (null first) and md5 of the text."""
    seen, left = set(), {}
    for doc_id, text in sorted(set(rows), key=lambda r: (r[0] is not None, r[0] or 0, hashlib.md5((r[1] or "").encode()).digest())):
        data = (text or "").encode()
        gone = bytearray(len(data))
        for i in range(len(data) - match + 1):
            if data[i:i + match] in seen:
                gone[i:i + match] = b"\1" * match
            seen.add(data[i:i + match])
        left[doc_id, text] = bytes(b for b, g in zip(data, gone) if not g)
    return left


@pytest.mark.parametrize("seed, chunk", [(1, 8192), (2, 8192), (3, 5)])
def test_first_copies_stay(spark, monkeypatch, seed, chunk):
    monkeypatch.setattr(repeats, "CHUNK", chunk)
    rows = list(enumerate(collection(seed)))
    rows += [(None, rows[0][1]), (3, rows[1][1]), (3, rows[1][1]), (900, "ab" * 300), (901, "ab" * 200)]
    docs = spark.createDataFrame([(*r, 1, 2, 3) for r in rows], "doc_id long, text string, doc int, _key int, spans int")
    found = repeats.without_repeats(docs, 100, keep_first=True, gram_bytes=32)
    assert found.columns == [*docs.columns, "removed", "kept"]
    want = plain_first(rows, 100)
    got = found.collect()
    assert len(got) == len(rows)
    assert all(bytes(r["kept"]) == want[r["doc_id"], r["text"]] and (r["doc"], r["_key"], r["spans"]) == (1, 2, 3) for r in got)


def collection(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abé ") for _ in range(rng.randint(1, 9)))
    text = lambda n: " ".join(word() for _ in range(n))
    shared = [text(rng.randint(20, 80)) for _ in range(4)]
    rows = []
    for _ in range(60):
        parts = [text(rng.randint(0, 40))]
        for _ in range(rng.randint(0, 3)):
            s = rng.choice(shared)
            a = rng.randint(0, len(s) // 2)
            parts += [s[a:a + rng.randint(20, 400)], text(rng.randint(0, 30))]
        rows.append("".join(parts))
    return rows + rows[:5] + [rows[0][:150]] * 3 + ["x" * 900, "x" * 130, "ab" * 300, None, "", "short"]


@pytest.mark.parametrize("seed, chunk, piece", [(1, 8192, 1 << 20), (2, 16, 500), (3, 16, 1 << 20)])
def test_short_matches(spark, monkeypatch, seed, chunk, piece):
    """Shorter strings, segments dealt into blocks, and long texts searched in pieces."""
    monkeypatch.setattr(repeats, "CHUNK", chunk)
    monkeypatch.setattr(repeats, "PIECE", piece)
    texts, match = collection(seed), 100
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = sorted((r["doc_id"], len((r["text"] or "").encode()), sum(s["end"] - s["start"] for s in r["removed"]),
                  len(r["removed"]), bytes(r["kept"])) for r in repeats.without_repeats(docs, match, gram_bytes=20).collect())
    assert got == [(i, *w) for i, w in enumerate(plain(texts, match))]


def test_repeated_rows_clashing_columns_and_empty_table(spark):
    long = "word " * 100
    rows = [(1, long, "a", None), (1, long, "a", None), (None, "tiny", None, "b"), (2, None, "c", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, kept string, start string")
    got = repeats.without_repeats(docs)
    assert got.columns == ["doc_id", "text", "start", "removed", "kept"]
    assert sorted(len(r["kept"]) for r in got.collect()) == [0, 0, 0, 4]
    assert repeats.without_repeats(docs.limit(0)).count() == 0


@pytest.mark.parametrize("keep_first", [False, True])
def test_one_row_for_equal_surroundings_within_a_text(spark, keep_first):
    """A line over and over gives as many rows as surroundings, not as places."""
    rng = random.Random(5)
    line = "".join(rng.choice("abcdefgh ") for _ in range(90))
    texts = ["start " + line * 600 + " end", line * 300, "own " + "".join(rng.choice("xyz ") for _ in range(3000))]
    raw = spark.createDataFrame([(i, bytearray(t.encode())) for i, t in enumerate(texts)], "doc long, text_bytes binary")
    rows = repeats.anchor_rows(raw, keep_first=keep_first).collect()
    repeated = [r for r in rows if r["doc"] < 2]
    assert len(repeated) < 60 < sum(r["n"] for r in repeated)
    assert [r["n"] for r in rows if r["gram"] is None] == [0, 0] and all(r["n"] == 1 for r in rows if r["doc"] == 2)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: bytes(r["kept"]) for r in repeats.without_repeats(docs, keep_first=keep_first).collect()}
    want = plain_first(list(enumerate(texts)), 400) if keep_first else {
        (i, t): w[3] for i, (t, w) in enumerate(zip(texts, plain(texts, 400)))}
    assert got == {i: kept for (i, _), kept in want.items()}

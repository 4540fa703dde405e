import hashlib
import random
import zlib

import pytest

from itemspark.llm import periodic
from itemspark.llm.queries import QUERIES

FOLDER = "/root/testdata/sf0.001"


def plain_runs(s, least, times):
    """All maximal stretches of smallest period p, by comparing words p apart."""
    found, n = [], len(s)
    for p in range(1, n // 2 + 1):
        i = 0
        while i < n - p:
            j = i
            while j < n - p and s[j] == s[j + p]:
                j += 1
            length = j - i + p
            if j > i and length >= max(least, times * p):
                smaller = any(all(s[k] == s[k + q] for k in range(i, j + p - q)) for q in range(1, p))
                if not smaller:
                    found.append((i, length, p))
            i = max(j, i) + 1
    return sorted(found)


def plain_collapsed(words, runs):
    return [w for i, w in enumerate(words) if not any(a + q <= i < a + n for a, n, q in runs)]


def planted(doc_id, words):
    h = zlib.crc32(str(doc_id).encode())
    g, n = h // 10, len(words)
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[a + (i - a) % p] if i >= a else words[i] for i in range(n)]


@pytest.mark.parametrize("least, times", [(2, 2), (8, 3), (24, 3), (9, 4)])
def test_runs_equal_brute_force(least, times):
    draw = random.Random(least)
    for _ in range(400):
        k, n = draw.choice([1, 2, 3, 6]), draw.randint(0, 50)
        s = [draw.randrange(k) for _ in range(n)]
        if n and draw.random() < 0.6:
            a, p = draw.randrange(n), 1 + draw.randrange(9)
            part = (s[a:a + p] * 40)[:draw.randrange(45)]
            s = s[:a] + part + s[a:]
        want = plain_runs(s, least, times)
        assert periodic.runs_of(s, least, times) == want
        assert periodic.word_runs([b"%d" % x for x in s], least, times) == want


def test_query_equals_brute_force(spark):
    rows = {r["doc_id"]: r for r in QUERIES["op13_runs"](spark, FOLDER).collect()}
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").collect()
    assert len(rows) == len(docs) and sum(r["n_runs"] > 0 for r in rows.values()) > 5
    for d in docs:
        words = planted(d["doc_id"], d["text"].encode().split())
        runs = plain_runs(words, 24, 3) if len(words) < 1500 else periodic.word_runs(words)
        best = min(runs, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=(None,) * 3)
        r = rows[d["doc_id"]]
        assert (r["n_runs"], r["start"], r["length"], r["period"]) == (len(runs), *best)
        assert r["exponent_milli"] == (None if not runs else 1000 * best[1] // best[2])
        listed = "".join(f"{a},{n},{p}\n" for a, n, p in runs)
        assert r["runs_sha256"] == hashlib.sha256(listed.encode()).hexdigest()
        kept = b" ".join(plain_collapsed(words, runs))
        assert r["collapsed_sha256"] == hashlib.sha256(kept).hexdigest()


def test_odd_rows(spark):
    rows = [(None, None, "a", 1), (1, "", "b", 2), (1, " \t\n ", "c", 3), (2, "la " * 24, "d", 4), (2, "la " * 24, "d", 4),
            (3, "la " * 23, "e", 5), (4, "x y\u00a0z " * 30 + "end", "f", 6), (None, "ab " * 50_000, "g", 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, runs string, words int")
    found = periodic.with_runs(docs)
    assert found.columns == ["doc_id", "text", "words", "runs", "collapsed"]
    got = {(r["words"]): ([tuple(x) for x in r["runs"]], r["collapsed"]) for r in found.collect()}
    assert got == {1: ([], ""), 2: ([], ""), 3: ([], ""), 4: ([(0, 24, 1)], "la"), 5: ([], ("la " * 23).strip()),
                   6: ([(0, 60, 2)], "x y\u00a0z end"), 7: ([(0, 50_000, 1)], "ab")}
    assert found.count() == 8 and periodic.with_runs(docs.limit(0)).count() == 0
    assert {r["text"] for r in periodic.planted(docs).where("doc_id IS NULL").collect()} == {None, "ab " * 50_000}
    with pytest.raises(ValueError):
        periodic.with_runs(docs, times=1)

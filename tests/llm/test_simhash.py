"""SimHash groups against brute force over all pairs."""

import re
from itertools import combinations

import numpy as np
import pytest
import xxhash

from itemspark.llm import simhash
from itemspark.llm.queries import QUERIES


def plain_fingerprint(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall("[^\x20\x09-\x0D]+", lower)
    if not words:
        return 0
    shingles = [" ".join(words[i:i + 4]) for i in range(max(1, len(words) - 3))]
    votes = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s.encode(), 42)
        for bit in range(64):
            votes[bit] += h >> bit & 1
    return sum(1 << bit for bit in range(64) if 2 * votes[bit] > len(shingles))


def plain_components(fps, ids, most=4):
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    for i in range(len(fps)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= most:
                root[find(i)] = find(j)
    groups = {}
    for i in range(len(fps)):
        groups.setdefault(find(i), []).append(ids[i])
    return {i: min(groups[find(i)]) for i in range(len(fps))}


def test_triples_meet_every_four_positions():
    triples = [set(t) for t in simhash.position_triples()]
    assert len(triples) == 20
    assert all(any(t <= set(four) for t in triples) for four in combinations(range(8), 4))


def test_query_equals_brute_force(spark):
    folder = "/root/testdata/sf0.001"
    docs = [tuple(r) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]
    fps = [plain_fingerprint(t) for _, t in docs]
    want = plain_components(fps, [d for d, _ in docs])
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in QUERIES["op3_simhash"](spark, folder).collect()}
    assert got == {docs[i][0]: (f"{fps[i]:016x}", want[i]) for i in range(len(docs))}


@pytest.mark.parametrize("block", [4096, 40])
def test_links_connect_all_near_pairs(spark, monkeypatch, block):
    """Also with long lists dealt into blocks."""
    monkeypatch.setattr(simhash, "BLOCK_ROWS", block)
    rng = np.random.default_rng(3)
    base = rng.integers(-2**62, 2**62, 40)
    near = [int(b) ^ int(sum(1 << int(x) for x in rng.choice(62, rng.integers(0, 7), replace=False)))
            for b in base for _ in range(8)]
    chain = [int(base[0]) ^ ((1 << k) - 1) for k in range(0, 60, 4)]
    dense = [int(base[1]) ^ (1 << int(i)) ^ (1 << int(j)) for i, j in rng.integers(0, 40, (150, 2))]
    fps = sorted(set(near + chain + dense))
    links = simhash.near_links(spark.createDataFrame([(f,) for f in fps], "fp long"))
    found = [tuple(r) for r in links.collect()]
    mask = (1 << 64) - 1
    assert found
    want = plain_components([f & mask for f in fps], fps)
    got = {f: f for f in fps}
    got |= {r["node"]: r["root"] for r in simhash.components(links, "a", "b").collect()}
    assert [got[f] for f in fps] == [want[i] for i in range(len(fps))]


def test_nulls_ties_and_clashing_columns(spark):
    rows = [(1, None, "x"), (2, "", "x"), (3, " \t", "y"), (4, "One Two", "z"), (4, "one\x0btwo", "z"),
            (None, "One two", "z"), (6, "wörd " * 20_000, "q")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp string").withColumnRenamed("fp", "component_id")
    got = sorted((tuple(r) for r in simhash.near_groups(docs).collect()), key=str)
    by = {(d, f): c for d, f, c in got}
    assert len(got) == 7
    assert {by[1, 0], by[2, 0], by[3, 0]} == {1}
    pair = simhash.fingerprint("one two")
    assert [c for d, f, c in got if f == pair] == [4, 4, 4]
    assert simhash.near_groups(docs.limit(0)).count() == 0

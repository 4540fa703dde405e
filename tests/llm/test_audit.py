import re
from itertools import permutations

import numpy as np
import pytest

from itemspark.llm import audit


def plain_audit(rows, labels):
    """(part, order, step) -> the seven numbers, by applying the filters in turn."""
    least, good, toxic, masks = {}, set(), set(), []
    for doc_id, text, _ in rows:
        if doc_id is not None:
            least[text or ""] = min(doc_id, least.get(text or "", doc_id))
    for doc_id, quality, bad in labels:                 # a null doc_id has no labels
        good |= {doc_id} if quality == 1 and doc_id else set()
        toxic |= {doc_id} if bad == 1 and doc_id else set()
    for doc_id, text, source in rows:
        t = text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {"A": len(w) < 50, "B": 100 * len(set(w)) < 65 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 5 * len(t),
                 "D": bool(re.search(r"[#$%&*|]", t)), "E": doc_id is not None and doc_id > least[t]}
        masks.append((doc_id, source or "", {f for f, x in fails.items() if x}))
    out = {}
    for part in {p for _, p, _ in masks}:
        own, total = [(d, m) for d, p, m in masks if p == part], dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            for step, f in enumerate(order):
                before = set(order[:step])
                gone = [d for d, m in own if f in m and not m & before]
                total[f] += len(gone)
                out[part, "".join(order), step + 1] = [
                    sum(not m & (before | {f}) for _, m in own), len(gone), sum(f in m and bool(m & before) for _, m in own),
                    sum(m == {f} for _, m in own), sum(d in good for d in gone), sum(d in toxic for d in gone), f]
        for key, value in out.items():
            if key[0] == part:
                value[-1] = total[value[-1]]
    return out


ROWS = [(1, None, None), (2, "", ""), (3, "a b", "s"), (3, "a b", "s"), (4, "a b", "s"), (None, "a b", "s"), (None, None, "t"),
        (5, "AB " * 60, "s"), (6, "AB " * 60, "t"), (7, " ".join(map(str, range(60))) + " # x", "s"),
        (8, " ".join(f"w{i} x" for i in range(49)), "t"), (9, " ".join(f"w{i}" for i in range(50)), "t"), (10, "é" * 100_000, "u")]
LABELS = [(3, 1, None), (3, 0, 1), (4, 1, 0), (7, None, 1), (9, 1, 1), (99, 1, 1), (None, 1, 1)]


@pytest.mark.parametrize("most", [audit.MOST_COUNTERS, 4])
def test_odd_rows_equal_brute_force(spark, monkeypatch, most):
    monkeypatch.setattr(audit, "SEGMENT", 8)
    monkeypatch.setattr(audit, "FLUSH_ROWS", 2)
    docs = spark.createDataFrame([(*r, 0, 0) for r in ROWS], "doc_id long, text string, source string, mask int, words int").repartition(3)
    labels = spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int")
    found = audit.interactions(audit.failure_masks(docs, labels, most)).collect()
    assert {tuple(r)[:3]: list(tuple(r)[3:]) for r in found} == plain_audit(ROWS, LABELS) and len(found) == 4 * 600
    assert audit.interactions(audit.failure_masks(docs.limit(0), labels)).count() == 0


@pytest.mark.parametrize("most, cleared", [(1 << 20, 0.9), (1 << 10, 0.0)])
def test_sketch_never_clears_a_repeat(spark, monkeypatch, most, cleared):
    monkeypatch.setattr(audit, "SEGMENT", 1 << 10)
    draw = np.random.default_rng(3)
    values = draw.integers(-2**63, 2**63 - 1, 4000)
    hashes = spark.createDataFrame([(int(x),) for x in [*values, *values[:500], *[values[0]] * 2000]], "hash long").repartition(7)
    answer = audit.maybe_repeated(hashes, hashes.count(), most)
    told = {r["hash"]: r["again"] for r in hashes.select("hash", answer("hash").alias("again")).collect()}
    assert all(told[int(x)] for x in values[:500])
    assert np.mean([not told[int(x)] for x in values[500:]]) >= cleared

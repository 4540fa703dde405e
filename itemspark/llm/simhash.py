"""SimHash near-duplicates by an inverted index of byte positions.

Two 64-bit fingerprints that differ in at most four bits share at least four of their
eight positional bytes.  The index lists fingerprints by positional bytes; for pairs
that meet in a list the shared bytes are tallied, pairs below four are dropped, and the
rest are verified bit by bit.  A list of a single byte would hold 1/256 of all
fingerprints, so its pairs would grow with their square; lists are therefore keyed by
three bytes at a time, for the 20 position triples of which one lies in every four
positions, and no pair is lost.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from itemspark.llm.components import components
from itemspark.llm.registry import query, table
from itemspark.llm.tasks import releasing, values
from itemspark.session import cut_lineage

MOST_BITS = 4
LEAST_SHARED = 8 - MOST_BITS    # each differing bit spoils one byte at most
SHINGLE = 4
SEED = 42
BLOCK_ROWS = 4096               # longer lists are compared block against block
SMALL_LIST = 64                 # up to this length all offsets of a list are compared at once


def position_triples() -> list[tuple[int, int, int]]:
    """Triples of the eight positions such that any four positions hold one of them.

    Three groups of positions in a ring: triples inside a group, and two of a group
    with one of the next.
    """
    groups = [(0, 1, 2), (3, 4, 5), (6, 7)]
    found = [t for g in groups for t in combinations(g, 3)]
    for g, after in zip(groups, groups[1:] + groups[:1]):
        found += [tuple(sorted((*pair, one))) for pair in combinations(g, 2) for one in after]
    return found


def fingerprint(text: str, shingle: int = SHINGLE) -> int:
    """The signed 64-bit SimHash of a text's word shingles; 0 without words."""
    from xxhash import xxh64_intdigest
    words = text.encode("utf-8").lower().split()       # bytes: A-Z and ASCII blanks only
    if not words:
        return 0
    line = b" ".join(words)
    size = np.fromiter(map(len, words), "i8", len(words))
    end = np.cumsum(size + 1) - 1
    start = end - size
    last = max(1, len(words) - shingle + 1)
    start, end = start[:last].tolist(), end[min(shingle, len(words)) - 1:].tolist()
    hashes = np.fromiter((xxh64_intdigest(line[a:b], SEED) for a, b in zip(start, end)), "<u8", last)
    votes = np.zeros(64, "i8")
    for i in range(0, last, 4096):
        bits = np.unpackbits(hashes[i:i + 4096].view("u1"), bitorder="little").reshape(-1, 64)
        votes += bits.sum(axis=0, dtype="i4")
    return int(np.packbits(2 * votes > last, bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id and fp (signed 64-bit); null text counts as empty."""
    kind = dict(docs.dtypes)["doc_id"]

    def run(batches):
        for batch in batches:
            fp = [fingerprint(t or "", shingle) for t in values(batch.column("text"))]
            yield pa.record_batch({"doc_id": batch.column("doc_id"), "fp": pa.array(fp, pa.int64())})

    return docs.select("doc_id", "text").mapInArrow(releasing(run), f"doc_id {kind}, fp long")


def close(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether pairs of fingerprints share enough positional bytes and are near."""
    different = np.ascontiguousarray(np.bitwise_xor(a, b))
    shared = (different.view("u1").reshape(*different.shape, 8) == 0).sum(axis=-1)
    near = shared >= LEAST_SHARED
    near[near] = np.bitwise_count(different[near].view("<u8")) <= MOST_BITS
    return near


def grown_forest(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links (parent, child) that join the same fingerprints as all near pairs of a
    list, at most one per child: each found member looks for those not found yet."""
    parents, children, left = [], [], fps
    while len(left):
        todo, left = [left[0]], left[1:]
        while todo and len(left):
            now = todo.pop()
            hit = close(left, np.broadcast_to(now, left.shape))
            if hit.any():
                new = left[hit]
                parents.append(np.full(len(new), now))
                children.append(new)
                todo += new.tolist()
                left = left[~hit]
    return (np.concatenate(parents), np.concatenate(children)) if parents else (fps[:0], fps[:0])


def thinned(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, smallest node) links that connect the same nodes as the links (a, b)."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[:len(a)], at[len(a):]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[x], label[y])
        if (label[x] == label[y]).all():
            break
        for end in (x, y):
            np.minimum.at(label, label[end], low)
        while True:
            jumped = label[label]
            if (jumped == label).all():
                break
            label = jumped
    moved = label != np.arange(len(nodes))
    return nodes[moved], nodes[label[moved]]


def linked(keys: np.ndarray, fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links inside the runs of equal keys."""
    cut = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    length = np.diff(np.append(cut, len(keys)))
    small = np.repeat(length <= SMALL_LIST, length)
    k, f = keys[small], fps[small]
    a, b = [], []
    for lag in range(1, int(length[length <= SMALL_LIST].max(initial=1))):
        same = np.flatnonzero(k[lag:] == k[:-lag])
        hit = same[close(f[same], f[same + lag])]
        a.append(f[hit])
        b.append(f[hit + lag])
    if a:
        a, b = thinned(np.concatenate(a), np.concatenate(b))
        a, b = [a], [b]
    for i in np.flatnonzero(length > SMALL_LIST):
        x, y = grown_forest(fps[cut[i]:cut[i] + length[i]])
        a.append(x)
        b.append(y)
    return (np.concatenate(a), np.concatenate(b)) if a else (fps[:0], fps[:0])


def near_links(distinct: DataFrame) -> DataFrame:
    """Links (a, b) between fingerprints that differ in at most four bits: enough of
    them to connect all that such pairs connect.  ``distinct`` has one column fp.

    A list longer than BLOCK_ROWS is dealt into blocks, and every two blocks are
    compared in a task of their own, so no list has to fit a task.
    """
    byte = lambda p: F.shiftrightunsigned("fp", 8 * p).bitwiseAND(255)
    keys = [F.shiftleft(F.shiftleft(byte(p), 16) + F.shiftleft(byte(q), 8) + byte(r), 5) + i
            for i, (p, q, r) in enumerate(position_triples())]
    index = distinct.select("fp", F.explode(F.array(*keys)).alias("key"))
    long = (index.groupBy("key").count().where(F.col("count") > BLOCK_ROWS)
            .select("key", F.ceil(F.col("count") / BLOCK_ROWS).cast("int").alias("blocks")))
    dealt = index.join(cut_lineage(long, "long"), "key", "left")
    own = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
    other = F.explode(F.when(F.col("blocks").isNull(), F.array(F.lit(0)))
                      .otherwise(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = (dealt.withColumn("own", F.coalesce(own, F.lit(0))).withColumn("other", other)
             .select("fp", "key", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high")))

    def run(batches):
        kept_key, kept_fp = np.zeros((0, 3), "i8"), np.zeros(0, "i8")
        for batch in batches:
            key = np.concatenate([kept_key, np.stack([batch.column(c).to_numpy().astype("i8") for c in ("key", "low", "high")], 1)])
            fp = np.concatenate([kept_fp, batch.column("fp").to_numpy()])
            if not len(key):
                continue
            other = np.flatnonzero((key != key[-1]).any(axis=1))
            until = other[-1] + 1 if len(other) else 0          # the last run may go on
            kept_key, kept_fp = key[until:], fp[until:]
            yield from told(key[:until], fp[:until])
        yield from told(kept_key, kept_fp)

    def told(key, fp):
        if len(fp) < 2:
            return
        run_of = np.cumsum(np.append(False, (key[1:] != key[:-1]).any(axis=1)))
        a, b = linked(run_of, fp)
        if len(a):
            yield pa.record_batch({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return (dealt.repartition("key", "low", "high").sortWithinPartitions("key", "low", "high")
            .mapInArrow(releasing(run), "a long, b long"))


def near_groups(docs: DataFrame) -> DataFrame:
    """doc_id, fp and component_id of every document.

    component_id is the smallest doc_id that can be reached over fingerprints differing
    in at most four bits, the document's own included; null if all of those are null.
    Equal fingerprints are always one group.  Null and blank texts have fingerprint 0
    and are linked like any other.  Rows with repeated doc_ids each get a row; an empty
    table gives none.  Other columns are left out.
    """
    marked = cut_lineage(fingerprints(docs), "fingerprints")
    distinct = cut_lineage(marked.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    roots = components(near_links(distinct.select("fp")), "a", "b")
    held = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = held.groupBy("root").agg(F.min("least").alias("component_id"))
    named = cut_lineage(held.join(least, "root").select("fp", "component_id"), "named")
    return marked.join(named, "fp").select("doc_id", "fp", "component_id")


@query("op3_simhash")
def op3_simhash(spark, folder) -> DataFrame:
    """Fingerprint and near-duplicate group of every document."""
    return near_groups(table(spark, folder, "documents")).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")

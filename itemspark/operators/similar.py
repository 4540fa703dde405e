"""Item pairs with a high absolute correlation, without comparing all pairs.

For 0/1 columns with ``a`` and ``b`` ones among ``n`` rows, the correlation is at
most sqrt(odds(a) / odds(b)), and at least minus the same with one side flipped.
So two items can only pass ``t`` when their log-odds differ (or add up) to less
than ``-2 ln t``.  Items are put into log-odds classes of that width and compared
with the neighbouring and mirrored classes only, block against block; a large
class is just more blocks.  The bound loses no pair.

Overlaps are counted per slice of takers.  With one slice a pair of blocks is
finished in its task; with more takers the slices' counts are added per pair.  Where
takers were right on few of the items, the pairs that some taker has right are
counted instead, which grows with the answers and not with the square of the items.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from itemspark.operators.ranks import positions
from itemspark.session import cut_lineage


#: Multiplications of a matrix product that take as long as joining one pair of answers.
PAIR_COST = 200
#: Joined pairs that a task holds at once, and right answers of a block.
TASK_PAIRS = 4_000_000
BLOCK_CELLS = 500_000


def correlated_pairs(responses: DataFrame, takers: DataFrame, threshold: float,
                     block: int = 1024, width: int = 4096, sparse: bool | None = None) -> DataFrame:
    """Pairs v1 < v2 of items with absolute correlation above ``threshold``, missing
    answers counting as 0.  Constant items have no correlation and no pair.
    ``width`` takers form a slice; with several, ``sparse`` chooses between joined
    answers and blocks (by default the cheaper)."""
    n = takers.count()
    n_slices = -(-n // width)
    reach_width = -2.0 * math.log(threshold)
    right = responses.filter("y = 1").select("taker", "item")
    sums = right.groupBy("item").agg(F.count(F.lit(1)).alias("a")).filter(F.col("a") < n)
    if n_slices > 1 and sparse is not False:
        right, sums = cut_lineage(right.distinct(), "right"), cut_lineage(sums, "sums")
        met = right.groupBy("taker").agg(F.count(F.lit(1)).cast("double").alias("c"))
        joined = met.agg(F.sum(F.col("c") * F.col("c"))).first()[0] or 0.0
        if sparse or joined * PAIR_COST < float(sums.count()) ** 2 * n:
            return _joined_pairs(right, sums, takers, n, threshold, joined)
    classed = sums.withColumn("class", F.floor(F.log(F.col("a") / (n - F.col("a"))) / reach_width).cast("int"))
    placed = positions(classed, [F.col("item")], ["class"])
    placed = cut_lineage(placed.select("item", "a", "class",
                                       ((F.col("position") - 1) / block).cast("int").alias("block")))
    numbered = positions(takers.select("taker"), [F.col("taker")], name="place").select(
        "taker", ((F.col("place") - 1) / width).cast("int").alias("slice"),
        ((F.col("place") - 1) % width).cast("int").alias("at"))
    vectors = (right.join(numbered, "taker").groupBy("item", "slice")
               .agg(F.collect_list("at").alias("at")))               # at most `width` entries
    # every item has an entry in every slice: two items may never be right together
    slots = placed.withColumn("slice", F.explode(F.sequence(F.lit(0), F.lit(n_slices - 1))))
    empty = F.array().cast("array<int>")
    payload = cut_lineage(
        slots.join(vectors, ["item", "slice"], "left").withColumn("at", F.coalesce("at", empty))
        .groupBy("class", "block", "slice")
        .agg(F.collect_list(F.struct("item", "a", "at")).alias("rows")))   # at most `block` items

    # which blocks meet: headers only, the payload is joined afterwards
    heads = payload.select("class", "block", "slice").distinct()
    c = F.col("class")
    reach = F.array_distinct(F.array(c - 1, c, c + 1, -c - 2, -c - 1, -c))
    counts = heads.groupBy(F.col("class").alias("class2")).agg(F.max("block").alias("last"))
    meets = (heads.withColumn("class2", F.explode(reach)).join(counts, "class2")
             .withColumn("block2", F.explode(F.sequence(F.lit(0), F.col("last"))))
             .filter("class2 > class OR (class2 = class AND block2 >= block)"))
    second = payload.select(F.col("class").alias("class2"), F.col("block").alias("block2"), "slice",
                            F.col("rows").alias("rows2"))
    work = (meets.join(payload, ["class", "block", "slice"])
            .join(second, ["class2", "block2", "slice"]).select("rows", "rows2"))

    def matrix(entries):
        x = np.zeros((len(entries), width if n_slices > 1 else n), dtype=np.float32)
        for k, e in enumerate(entries):                              # exact: counts below 2**24
            x[k, e["at"]] = 1.0
        return (np.array([e["item"] for e in entries], dtype=np.int64),
                np.array([e["a"] for e in entries], dtype=np.float64), x)

    def correlation(together, a, b):
        return (n * together - a * b) / np.sqrt(a * (n - a) * b * (n - b))

    def finished(frames):
        for frame in frames:
            for rows, rows2 in zip(frame["rows"], frame["rows2"]):
                (i1, a, x1), (i2, b, x2) = matrix(rows), matrix(rows2)
                r = correlation((x1 @ x2.T).astype(np.float64), a[:, None], b[None, :])
                hit = (np.abs(r) > threshold) & (i1[:, None] != i2[None, :])
                if i1[0] in i2:                                      # the block with itself
                    hit &= i1[:, None] < i2[None, :]
                p, q = np.nonzero(hit)
                yield pd.DataFrame({"v1": np.minimum(i1[p], i2[q]), "v2": np.maximum(i1[p], i2[q]),
                                    "r": r[p, q]})

    if n_slices == 1:
        return work.mapInPandas(finished, "v1 bigint, v2 bigint, r double")

    def overlaps(frames):
        for frame in frames:
            for rows, rows2 in zip(frame["rows"], frame["rows2"]):
                (i1, a, x1), (i2, b, x2) = matrix(rows), matrix(rows2)
                together = (x1 @ x2.T).astype(np.int64)
                apart = correlation(0.0, a[:, None], b[None, :]) < -threshold
                hit = ((together > 0) | apart) & (i1[:, None] != i2[None, :])
                p, q = np.nonzero(hit)
                low, high = np.minimum(i1[p], i2[q]), np.maximum(i1[p], i2[q])
                part = pd.DataFrame({"v1": low, "v2": high, "s": together[p, q]})
                yield part.drop_duplicates(["v1", "v2"])             # a block with itself gives both

    shared = (work.mapInPandas(overlaps, "v1 bigint, v2 bigint, s bigint")
              .groupBy("v1", "v2").agg(F.sum("s").cast("double").alias("s")))
    both = (shared.join(placed.select(F.col("item").alias("v1"), F.col("a").cast("double").alias("a")), "v1")
            .join(placed.select(F.col("item").alias("v2"), F.col("a").cast("double").alias("b")), "v2"))
    a, b = F.col("a"), F.col("b")
    r = (n * F.col("s") - a * b) / F.sqrt(a * (n - a) * b * (n - b))
    return both.withColumn("r", r).filter(F.abs("r") > threshold).select("v1", "v2", "r")


def _joined_pairs(right: DataFrame, sums: DataFrame, takers: DataFrame, n: int, threshold: float, joined: float) -> DataFrame:
    """The same pairs from the answers: pairs of items that a taker has both right, and
    those that nobody has both right but whose sums alone put them below -threshold.
    ``joined`` of the former are dealt to pairs of item blocks and counted inside."""
    reach = -2.0 * math.log(threshold) * (1 + 1e-9)
    odds = sums.where("item IS NOT NULL").withColumn("l", F.log(F.col("a") / (n - F.col("a"))))
    odds = cut_lineage(odds.select("item", F.col("a").cast("double").alias("a"), "l"), "odds")
    seats = cut_lineage(takers.select("taker").distinct().withColumn("at", F.monotonically_increasing_id()), "seats")
    vectors = cut_lineage(right.join(seats, "taker").groupBy("item").agg(F.collect_list("at").alias("at"))
                          .join(odds.hint("merge"), "item"), "vectors")       # at most `n` entries
    n_cells = vectors.agg(F.sum(F.size("at"))).first()[0] or 0
    last = max(math.ceil(math.sqrt(joined / TASK_PAIRS)), -(-n_cells // BLOCK_CELLS), 1) - 1
    payload = cut_lineage(vectors.groupBy(F.pmod(F.xxhash64("item"), F.lit(last + 1)).cast("int").alias("block"))
                          .agg(F.array_sort(F.collect_list(F.struct("item", "a", "at"))).alias("rows")), "blocks")
    one = payload.withColumn("block2", F.explode(F.sequence(F.col("block"), F.lit(last))))
    two = payload.select(F.col("block").alias("block2"), F.col("rows").alias("rows2"),
                         F.explode(F.sequence(F.lit(0), F.col("block"))).alias("block"))
    work = one.hint("merge").join(two, ["block", "block2"]).select((F.col("block") == F.col("block2")).alias("same"), "rows", "rows2")

    def unpacked(rows):
        at = rows.field("at")
        return (rows.field("item").to_numpy(), rows.field("a").to_numpy(),
                np.append(0, np.cumsum(np.diff(at.offsets.to_numpy()))), at.flatten().to_numpy())

    def counted(batches):
        for batch in batches:
            for row in range(batch.num_rows):
                same = batch.column("same")[row].as_py()
                item, a, ends, at = unpacked(batch.column("rows")[row].values)
                item2, b, ends2, at2 = unpacked(batch.column("rows2")[row].values)
                l, l2 = np.log(a / (n - a)), np.log(b / (n - b))
                order = np.argsort(at2, kind="stable")
                seat, owner = at2[order], np.repeat(np.arange(len(item2)), np.diff(ends2))[order]
                low, high = np.searchsorted(seat, at), np.searchsorted(seat, at, "right")
                before = np.append(0, np.cumsum(high - low))[ends]        # pairs before each item
                start = 0
                while start < len(item):
                    stop = max(start + 1, int(np.searchsorted(before, before[start] + TASK_PAIRS, "right")) - 1)
                    cells = slice(ends[start], ends[stop])
                    size = high[cells] - low[cells]
                    p = np.repeat(np.repeat(np.arange(start, stop), np.diff(ends[start:stop + 1])), size)
                    q = owner[np.arange(len(p)) - np.repeat(np.cumsum(size) - size, size) + np.repeat(low[cells], size)]
                    near = (np.abs(l[p] - l2[q]) <= reach) | (np.abs(l[p] + l2[q]) <= reach)
                    if same:                                              # items are in order
                        near &= p < q
                    pair, s = np.unique(p[near] * len(item2) + q[near], return_counts=True)
                    p, q = pair // len(item2), pair % len(item2)
                    r = (n * s.astype("f8") - a[p] * b[q]) / np.sqrt(a[p] * (n - a[p]) * b[q] * (n - b[q]))
                    hit = np.abs(r) > threshold
                    x, y = item[p[hit]], item2[q[hit]]
                    yield pa.record_batch([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y)), pa.array(r[hit])], names=["v1", "v2", "r"])
                    start = stop

    shared = work.mapInArrow(counted, "v1 bigint, v2 bigint, r double")
    # nobody right on both: the log-odds lie in mirrored classes, and the sums decide
    c, a, b = F.floor(F.col("l") / reach).cast("int"), F.col("a"), F.col("b")
    alone = -a * b / F.sqrt(a * (n - a) * b * (n - b))
    dense = F.col("l") >= -reach / 2                          # one of the two has odds of at least the threshold
    left = odds.where(dense).select(F.col("item").alias("i"), "a", "l", F.explode(F.array(-c - 2, -c - 1, -c)).alias("class"))
    other = odds.select(F.col("item").alias("j"), F.col("a").alias("b"), F.col("l").alias("l2"), c.alias("class"))
    apart = (left.hint("merge").join(other, "class")
             .where((F.col("i") != F.col("j")) & (F.abs(F.col("l") + F.col("l2")) <= reach) & (alone < -threshold))
             .select(F.least("i", "j").alias("v1"), F.greatest("i", "j").alias("v2"), alone.alias("r")).dropDuplicates(["v1", "v2"]))
    lists = [vectors.select(F.col("item").alias(v), F.col("at").alias(f"at{v[1]}")) for v in ("v1", "v2")]
    never = (apart.hint("merge").join(lists[0], "v1", "left").hint("merge").join(lists[1], "v2", "left")
             .where(~F.coalesce(F.arrays_overlap("at1", "at2"), F.lit(False))).select("v1", "v2", "r"))
    return shared.unionByName(never)


def drop_correlated(items: DataFrame, pairs: DataFrame) -> DataFrame:
    """Flag the later item of every pair."""
    later = pairs.select(F.col("v2").alias("item")).distinct().withColumn("dropped", F.lit(True))
    return (items.select("item").join(later, "item", "left")
            .withColumn("dropped", F.coalesce("dropped", F.lit(False))))
